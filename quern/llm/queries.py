"""Queries of the numbered problems: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table
from .answers import broken_pairs, defect_rates
from .documented import documented_functions
from .leaks import leaked_items, leaked_passages, without_leaks, without_passages
from .mixing import mix_shares, mix_sources
from .provenance import foreign_files
from .spam import spam_pages
from .splitting import split_chunks, split_seqs
from .unparsable import parsed_files, unparsable_rates


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oversized chunks: those that the splitter cuts into pieces. Their texts aren't asked for."""
    return split_seqs(spread(table(spark, sf_dir, "chunks")), table(spark, sf_dir, "split_limits")).select("seq")


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_chunks(spread(table(spark, sf_dir, "chunks")), table(spark, sf_dir, "split_limits"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return foreign_files(table(spark, sf_dir, "files")).select("repo_name", "repo_path")


def p2_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return foreign_files(table(spark, sf_dir, "files")).groupBy("repo_name", "reason").count().withColumnRenamed("count", "n_files")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of the pairs; their code isn't cut out of the texts."""
    return documented_functions(table(spark, sf_dir, "chunks"), with_code=False).select("seq", "function_name").distinct()


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented_functions(table(spark, sf_dir, "chunks"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_files(table(spark, sf_dir, "files")).where("not parses").select("repo_name", "repo_path")


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unparsable_rates(parsed_files(table(spark, sf_dir, "files")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_pairs(spread(table(spark, sf_dir, "qa_pairs")))


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "qa_pairs")
    return defect_rates(pairs, broken_pairs(pairs))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(_documents(spark, sf_dir), table(spark, sf_dir, "eval_items"), parts=True)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(_leaks(spark, sf_dir))


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_leaks(_documents(spark, sf_dir), _leaks(spark, sf_dir)).select("doc_id")


def p6_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_passages(_documents(spark, sf_dir), _leaks(spark, sf_dir)).select("doc_id", F.length("text").alias("n_chars"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_documents(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_shares(p7_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_pages(_documents(spark, sf_dir)).select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p2_found": p2_found,
    "p2_reasons": p2_reasons,
    "p3_found": p3_found,
    "p3_pairs": p3_pairs,
    "p4_found": p4_found,
    "p4_rates": p4_rates,
    "p5_found": p5_found,
    "p5_rates": p5_rates,
    "p6_found": p6_found,
    "p6_items": p6_items,
    "p6_clean": p6_clean,
    "p6_trimmed": p6_trimmed,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
}

ORACLE_SQL: dict[str, str] = {
    "p1_found": r"""
        select distinct c.seq from chunks c join split_limits l on c.chunk_type = l.chunk_type
        where len(regexp_extract_all(c.content, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]')) > l.max_tokens""",
    "p1_pieces": r"""
        with recursive rules as (
            select chunk_type, greatest(max_tokens, 1) as mx, least(greatest(overlap_tokens, 0), greatest(max_tokens, 1) - 1) as ov from split_limits),
        big as (
            select c.*, mx, ov from (select distinct seq, repo_name, repo_path, chunk_type, symbol_name, language, start_line, content from chunks) c join rules using (chunk_type)
            where len(regexp_extract_all(content, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]')) > mx),
        lines as (
            select seq, mx, ov, generate_subscripts(l, 1) as ln, unnest(l) as line
            from (select seq, mx, ov, regexp_extract_all(content, '[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+') as l from big)),
        segments as (
            select seq, mx, ov, ln, generate_subscripts(s, 1) as sn, unnest(s) as txt
            from (select *, case when len(regexp_extract_all(line, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]')) > mx
                then regexp_extract_all(line, '[ \t\r\n]*(?:[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n])[ \t\r\n]*') else [line] end as s from lines)),
        numbered as (
            select seq, mx, ov, row_number() over (partition by seq order by ln, sn) as p, txt from segments union all select seq, mx, ov, 0, '' from big),
        b as (
            select *, max(p) over (partition by seq) as last_p, sum(len(regexp_extract_all(txt, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]'))) over (partition by seq order by p) as t,
                sum(len(regexp_extract_all(txt, '\r\n|\r|\n'))) over (partition by seq order by p) as nl, regexp_matches(txt, '[\r\n]$') as ends_line,
                case when p = max(p) over (partition by seq) or regexp_matches(txt, '^[ \t]*[\r\n]+$') then 5 when regexp_matches(txt, '[\r\n]$') then 4
                    when regexp_matches(txt, '[.!?][ \t]+$|[。！？][ \t]*$') then 3 when regexp_matches(txt, '[;{}][ \t]*$|[,:)][ \t]+$|[，；：、][ \t]*$') then 2 else 1 end as kind
            from numbered),
        reach as (
            select a.seq, a.p, a.t, a.ov, a.mx, a.last_p, max(x.p) as any_p, max(x.t) as any_t, max(x.p) filter (x.kind >= 2) as clause_p, max(x.t) filter (x.kind >= 2) as clause_t,
                max(x.p) filter (x.kind >= 3) as sentence_p, max(x.t) filter (x.kind >= 3) as sentence_t, max(x.p) filter (x.kind >= 4) as line_p, max(x.t) filter (x.kind >= 4) as line_t,
                max(x.p) filter (x.kind >= 5) as blank_p, max(x.t) filter (x.kind >= 5) as blank_t
            from b a join b x on a.seq = x.seq and x.t <= a.t + a.mx group by all),
        ends as (
            select seq, p, ov, last_p, case when any_p = last_p then any_p when blank_t >= t + mx // 2 + 1 then blank_p when line_t > t then line_p
                when sentence_t >= t + mx // 2 + 1 then sentence_p when clause_t >= t + mx // 2 + 1 then clause_p else any_p end as e from reach),
        steps as (
            select n.seq, n.p, n.e, n.last_p, case when n.e = n.last_p then n.last_p else least(greatest(arg_max(x.p, (-x.t, x.p)), n.p + 1), n.e) end as succ
            from ends n join b y on y.seq = n.seq and y.p = n.e join b x on x.seq = n.seq and x.t >= y.t - n.ov group by n.seq, n.p, n.e, n.last_p),
        walk as (
            select seq, 0 as piece_no, p, e, succ, last_p from steps where p = 0
            union all select w.seq, w.piece_no + 1, s.p, s.e, s.succ, s.last_p from walk w join steps s on s.seq = w.seq and s.p = w.succ where w.succ < w.last_p)
        select w.seq, w.piece_no, g.repo_name, g.repo_path, g.chunk_type, g.symbol_name, g.language,
            (select string_agg(x.txt, '' order by x.p) from b x where x.seq = w.seq and x.p > w.p and x.p <= w.e) as content, cast(z.t - a.t as int) as token_count,
            cast(coalesce(g.start_line, 1) + a.nl as int) as start_line, cast(coalesce(g.start_line, 1) + z.nl - case when z.ends_line then 1 else 0 end as int) as end_line
        from walk w join big g on g.seq = w.seq join b a on a.seq = w.seq and a.p = w.p join b z on z.seq = w.seq and z.p = w.e""",
}
