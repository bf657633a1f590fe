"""Checks of summaries and gold data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Token bands per level, endings of names that are paths, and words that are no identifiers.
TOKEN_BANDS = {"file": (30, 400), "directory": (50, 500), "project": (300, 2000)}
PATH_ENDINGS = (".py", ".rst", ".md", ".toml", ".yaml", ".yml", ".cfg", ".json", ".txt", ".ini", ".sh")
CITED_ENDINGS = (".py", ".rst", ".md", ".toml", ".cfg", ".yml", ".yaml", ".js", ".ts")
NO_IDENTIFIERS = ("the", "and", "for", "all", "you")
GROUNDED_SHARE = 0.6


def _ends(x: Column, endings: tuple[str, ...]) -> Column:
    return x.rlike("(?:" + "|".join(e.replace(".", r"\.") for e in endings) + ")$")


def split_identifiers(text: Column) -> tuple[Column, Column]:
    """(code names, path names) that a summary mentions in back quotes or as calls; each sorted and distinct."""
    quoted = F.regexp_extract_all(text, F.lit(r"`([A-Za-z_][\w./]*)`"), F.lit(1))
    calls = F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-zA-Z0-9_]+|[a-z_][a-zA-Z0-9_]*)\(\)"), F.lit(1))
    names = F.filter(F.concat(quoted, calls), lambda x: (F.length(x) >= 3) & ~F.lower(x).isin(*NO_IDENTIFIERS))
    paths = F.regexp_extract_all(text, F.lit(r"`([^`]+\.(?:py|rst|md|toml|yaml|yml|cfg|json|txt|ini))`"), F.lit(1))
    code = F.filter(names, lambda x: ~_ends(x, PATH_ENDINGS))
    return F.array_sort(F.array_distinct(code)), F.array_sort(F.array_distinct(F.concat(F.filter(names, lambda x: _ends(x, PATH_ENDINGS)), paths)))


# Files of a folder or repository beyond which its names are dealt to several tasks.
SCOPE_FILES = 4096


def _scopes(path: Column) -> Column:
    """All (level, path) that a file belongs to: itself, the project, the root folder and its ancestor folders."""
    parts = F.split(path, "/")
    own = F.array(F.struct(F.lit("file").alias("level"), path.alias("path")), F.struct(F.lit("project").alias("level"), F.lit(".").alias("path")), F.struct(F.lit("directory").alias("level"), F.lit(".").alias("path")))
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.struct(F.lit("directory").alias("level"), F.array_join(F.slice(parts, 1, i), "/").alias("path")))
    return F.when(F.size(parts) > 1, F.concat(own, above)).otherwise(own)


def _found_names(named: DataFrame, sources: DataFrame) -> DataFrame:
    """(repo_name, level, path, found): the names of each scope, as (is_path, name), that its files hold.

    Names go to the files, not texts to the folders: paths are exploded to their ancestors and meet the names of these
    by equality, and each text is searched once per scope of its file, where it lies. Only names that were found go on,
    made distinct before the shuffle. A scope of many files has its names dealt by the hash of the file.
    """
    key = ["repo_name", "level", "path"]
    files = sources.select("repo_name", "repo_path").distinct().select("repo_name", "repo_path", F.explode(_scopes(F.col("repo_path"))).alias("s")).select("repo_name", "repo_path", "s.*")
    # at most one scope in SCOPE_FILES rows of `files`, so this is small
    large = F.broadcast(files.where("level <> 'file'").groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > SCOPE_FILES).select(*key, F.ceil(F.col("_n") / SCOPE_FILES).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    names = named.select(*key, "code", "named_paths").where("size(code) + size(named_paths) > 0").join(large, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    dealt = files.join(large, key, "left").withColumn("_part", F.pmod(F.xxhash64("repo_path"), parts).cast("int")).drop("_parts")
    wanted = dealt.join(names, [*key, "_part"]).select(F.col("repo_name").alias("_repo"), F.col("repo_path").alias("_file"), "level", "path", "code", "named_paths")
    # a code name is at least three of these characters, so it lies in one of the text's distinct runs of them
    runs = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_./]{3,}"), F.lit(0)))
    texts = sources.select("repo_name", "repo_path", F.array_join(runs, " ").alias("text"))
    rows = texts.join(wanted, (F.col("repo_name") == F.col("_repo")) & F.col("repo_path").eqNullSafe(F.col("_file")))
    entry = lambda is_path: lambda x: F.struct(F.lit(is_path).alias("is_path"), x.alias("name"))
    in_text = F.filter("code", lambda c: F.contains(F.coalesce("text", F.lit("")), c))
    in_paths = F.filter("named_paths", lambda p: (F.col("repo_path") == p) | F.endswith(F.col("repo_path"), F.concat(F.lit("/"), p)))
    hits = rows.select(*key, F.explode(F.concat(F.transform(in_text, entry(False)), F.transform(in_paths, entry(True)))).alias("x")).distinct()
    return hits.groupBy(*key).agg(F.collect_list("x").alias("found"))


def level_checks(summaries: DataFrame, sources: DataFrame) -> DataFrame:
    """Four checks per summary: it names itself, its length is in the band of its level, its scope fits, and at least
    60 % of its identifiers occur in its source (none passes). sources: (repo_name, repo_path, text), pieces of the
    files in any number; a folder or project is grounded in all files below it."""
    code, paths = split_identifiers(F.col("content"))
    ensure_checkpoint_dir(summaries.sparkSession)
    # kept, as it is read twice and a provider is asked once per summary
    s = summaries.withColumn("code", code).withColumn("named_paths", paths).checkpoint()
    s = s.join(_found_names(s, sources), ["repo_name", "level", "path"], "left")
    name = F.element_at(F.split("path", "/"), -1)
    self_name = F.when(F.col("level") == "project", F.element_at(F.split("repo_name", "/"), -1)).otherwise(name)
    mentions = F.contains(F.lower("content"), F.lower(self_name)) | F.contains(F.col("content"), F.col("path"))
    band = F.lit(False)
    for level, (lo, hi) in TOKEN_BANDS.items():
        band = F.when(F.col("level") == level, F.col("token_count").between(lo, hi)).otherwise(band)
    others = F.size(F.filter("named_paths", lambda p: (p != F.col("path")) & F.contains(p, F.lit("/"))))
    folders = F.size(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\b([a-z_][\w]+)/"), F.lit(1))))
    scope = F.when(F.col("level") == "file", others <= 3).when(F.col("level") == "directory", F.size("named_paths") >= 1).otherwise(folders >= 2)
    n = F.size("code") + F.size("named_paths")
    of_kind = lambda is_path: F.transform(F.filter("found", lambda x: x["is_path"] == F.lit(is_path)), lambda x: x["name"])
    hits = F.coalesce(F.size(F.array_intersect("code", of_kind(False))) + F.size(F.array_intersect("named_paths", of_kind(True))), F.lit(0))
    grounded = F.when(n > 0, hits / n >= GROUNDED_SHARE).otherwise(F.lit(True))
    out = s.select("repo_name", "level", "path", mentions.alias("mentions_self"), band.alias("length_ok"), scope.alias("scope_ok"), grounded.alias("grounded_ok"))
    return out.withColumn("passed", F.col("mentions_self") & F.col("length_ok") & F.col("scope_ok") & F.col("grounded_ok"))


def pass_rates(checks: DataFrame) -> DataFrame:
    flags = ("mentions_self", "length_ok", "scope_ok", "grounded_ok", "passed")
    return checks.groupBy("level").agg(F.count("*").alias("n"), *[F.count_if(f).alias(f) for f in flags])


def source_texts(chunks: DataFrame) -> DataFrame:
    """(repo_name, repo_path, text): the chunks' own texts, one row each; no text is kept per file, folder or repository.

    A name that level_checks looks for holds no line break, so it lies in a file if it lies in one of its chunks.
    Chunks delivered twice change nothing.
    """
    return chunks.select("repo_name", "repo_path", F.col("content").alias("text"))


def cited_paths(text: Column) -> Column:
    """Paths in brackets with the ending of a source or text file; blanks inside are allowed."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\[([^\]\n]+?)(?::(\d+)(?:-(\d+))?)?\]"), F.lit(1)), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: _ends(x, CITED_ENDINGS))))


def gold_coverage(gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per question: gold paths, how many are indexed, and chunks that fall into the gold lines. gold: (qid, repo_name, path, lo, hi)."""
    c = chunks.dropDuplicates(["seq"]).select("repo_name", F.col("repo_path").alias("path"), "seq", "start_line", "end_line")
    joined = gold.join(c, ["repo_name", "path"], "left")
    inside = F.col("lo").isNull() | ~((F.col("end_line") < F.col("lo")) | (F.col("start_line") > F.col("hi")))
    return joined.groupBy("qid").agg(
        F.countDistinct("path").alias("n_paths"), F.countDistinct(F.when(F.col("seq").isNotNull(), F.col("path"))).alias("n_indexed"), F.countDistinct(F.when(inside, F.col("seq"))).alias("n_chunks")
    )


def rewrite_answers(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """Replaces answers by id, keeping the old one as provenance; ids without a new answer stay as they are."""
    new = answers.select("id", F.col("answer").alias("_new"))
    return pairs.join(new, "id", "left").withColumn("original_answer", F.when(F.col("_new").isNotNull(), F.col("answer"))).withColumn("answer", F.coalesce("_new", "answer")).drop("_new")
