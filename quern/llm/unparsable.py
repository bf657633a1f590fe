"""Problem 4: source files that do not parse."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.languages import code_language
from ..operators.current import current_files

PARSED = "repo_name string, repo_path string, language string, parses boolean"


def parsed_files(files: DataFrame) -> DataFrame:
    """(repo_name, repo_path, language, parses) of the current state of every file in a code language.

    Method: generalised LL with a graph-structured stack. Each text is lexed to token classes; bracketed groups (and
    Python's indented suites) are recognised from the inside out, each for all nonterminals that may stand there, in
    one run over a shared stack; lists of statements are recognised part by part. The dialects of an extension have
    nonterminals of their own and run together over the same stack (a JavaScript script has the with statement and no
    import or export declarations, a module is the other way round; the other languages have one dialect with its common
    extensions); a dialect that doesn't derive a part drops out, and a file that every dialect has dropped does not
    parse. Equal groups are recognised once per worker: results are kept by their class string.

    The language is told by the extension, not by the column. Files without current content (null) are left out; an
    empty text parses wherever the grammar derives it. A byte-order mark is ignored. A file is one row and is parsed
    whole in one task; files are independent.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .dialects import dialect

        for b in batches:
            b["parses"] = [dialect(lang).recognises(text.removeprefix("﻿")) for lang, text in zip(b["language"], b["raw_content"])]
            yield b[["repo_name", "repo_path", "language", "parses"]]

    now = current_files(files, code_language(F.col("repo_path")).isNotNull()).where("raw_content is not null")
    return now.select("repo_name", "repo_path", code_language(F.col("repo_path")).alias("language"), "raw_content").mapInPandas(parse, PARSED)


def unparsable_rates(parsed: DataFrame) -> DataFrame:
    """Files, files that do not parse, and their share, per repository and language."""
    broken = F.count_if(~F.col("parses"))
    return parsed.groupBy("repo_name", "language").agg(F.count("*").alias("n_files"), broken.alias("n_unparsable"), (broken / F.count("*")).alias("rate"))
