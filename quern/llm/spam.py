"""Problem 8: keyword-stuffed pages and link lists."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .lexicons import FUNCTION_CHARACTERS_ZH, FUNCTION_WORDS

FEATURES = (
    "row_id bigint, lang string, n_words int, n_links int, function_share double, top_word double, top_pair double, "
    "duplicate_lines double, link_share double, separators double, prose_share double, n_prose int, code_lines double"
)
_WORDS_OF = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}
_ANY = frozenset().union(*_WORDS_OF.values())
_ZH = frozenset(FUNCTION_CHARACTERS_ZH)
_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_INLINE = re.compile(r"`[^`\n]*`")
_LINK = re.compile(r"!?\[([^\]\n]*)\]\([^)\n]*\)|<a\b[^>]*>(.*?)</a>|<?(?:https?://|www\.)[^\s<>]+>?", re.I | re.S)
_TAG = re.compile(r"<[^<>\n]*>")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CJK = re.compile(r"[㐀-鿿]")
_SENTENCE = re.compile(r"[.!?][ \t]+|[\n|。！？]+")
_ASCII_WORD = re.compile(r"[a-z']+")
_SEPARATOR = re.compile(r"[|,;•·»★/#>\n]| - ")
_CODE_LINE = re.compile(r"[;{}][ \t]*$|^[ \t]*(?:import|package|use|from|def|class|return|const|let|var|func|fn|pub|#include|#define)\b", re.M)


def features(text: str) -> tuple:
    """Everything that a page is judged by; see spam_features."""
    plain = _FENCE.sub("\n", text) if "```" in text or "~~~" in text else text
    link_words = n_links = link_chars = 0

    def drop(m: re.Match) -> str:
        nonlocal link_words, n_links, link_chars
        n_links += 1
        link_chars += len(m[0])
        link_words += len(_WORD.findall(m[1] or m[2] or ""))
        return " \x01 "

    if "](" in plain or "://" in plain or "www." in plain or "<" in plain:
        plain = _TAG.sub(" ", _LINK.sub(drop, plain))
    n_lines = plain.count("\n") + 1
    code = len(_CODE_LINE.findall(plain)) / n_lines
    if "`" in plain:
        plain = _INLINE.sub(" x ", plain)
    low = plain.lower()
    ascii_only = low.isascii()
    find = (_ASCII_WORD if ascii_only else _WORD).findall
    wide = not ascii_only and _CJK.search(low) is not None
    sentences = []
    words: list[str] = []
    n_cjk = zh = 0
    for s in _SENTENCE.split(low):
        c = _CJK.findall(s) if wide else ()
        ws = find(_CJK.sub(" ", s) if c else s)
        if c:
            n_cjk += len(c)
            z = sum(map(_ZH.__contains__, c)) / 2
            zh += z
            sentences.append((ws, len(ws) + len(c) // 2, z))
        elif ws:
            sentences.append((ws, len(ws), 0.0))
        words += ws
    n_plain = len(words) + n_cjk // 2
    n = n_plain + link_words + n_links
    counts = Counter(words)
    known = {w: k for w, k in counts.items() if w in _ANY}
    votes = {lang: sum(k for w, k in known.items() if w in ws) for lang, ws in _WORDS_OF.items()}
    lang = max(votes, key=votes.get)
    lang = "zh" if n_cjk > len(words) or zh > votes[lang] else lang if votes[lang] else None
    content = [(k, w) for w, k in counts.items() if k >= 4 and w not in known]
    content.sort(reverse=True)
    frequent = frozenset(w for _, w in content[:6])
    top_word = content[0][0] if content else 1
    top_pair = max(Counter(zip(words, words[1:])).values(), default=0)
    prose = n_prose = 0
    for ws, size, z in sentences:
        if size < 4:
            continue
        f = sum(map(_ANY.__contains__, ws)) + z
        if f >= max(1, 0.12 * size) and sum(map(frequent.__contains__, ws)) < 0.34 * size:
            prose += size
            n_prose += 1
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    return (
        lang,
        n,
        n_links,
        (sum(known.values()) + zh) / max(1, n_plain),
        top_word / max(1, n_plain),
        top_pair / max(1, n_plain),
        1 - len(set(lines)) / max(1, len(lines)),
        link_chars / max(1, len(text)),
        len(_SEPARATOR.findall(plain)) / max(1, n),
        prose / max(1, n),
        n_prose,
        code,
    )


def spam_features(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: language by function-word votes, words, links, shares of function words, of the most frequent word
    and word pair, of repeated lines, of link characters, separators per word, share of words in plain sentences and
    number of those, share of lines of code. Null texts have no row; empty texts have zeros."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FEATURES.split(", ")]
        for b in batches:
            yield pd.DataFrame([(d, *features(t)) for d, t in zip(b["row_id"], b["text"])], columns=names)

    rows = documents.select(F.col(doc_id).cast("bigint").alias("row_id"), F.col(text).alias("text")).where("text is not null")
    return rows.mapInPandas(judge, FEATURES)


def spam_pages(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_words: int = 12,
    prose_share: float = 0.2,
    sentences: int = 1,
    stray_prose: float = 0.08,
    function_part: float = 0.5,
    pair_times: float = 3.0,
    code_lines: float = 0.25,
    word_times: float = 3.0,
    separator_times: float = 3.0,
    rare_times: float = 1.35,
) -> DataFrame:
    """Spam pages: (doc_id, lang, reason, and the features).

    Thresholds are calibrated per language on all documents: the medians of the function-word share, of the top
    pair's and top word's share and of the separators per word, and the 99th percentiles of the shares of links and of
    repeated lines, whose medians are 0, over the documents with prose of each voted language (five languages and
    'none' at most, so the table is broadcast).
    A page is spam when at most `sentences` plain sentences hold at most `prose_share` of its words (or any number of
    them at most `stray_prose`: keywords can look like sentences), it isn't source code, and it shows what fills it instead: function words are missing (under `function_part` of the language's
    median), or a pair of words fills the page (over `pair_times` the median), or a word that occurs four times or more
    does (over `word_times` the median), or separators do (over `separator_times` the median), or lines repeat or links
    fill the page (over `rare_times` the 99th percentile). reason is 'links', 'tags' or 'keywords'. Null, empty and very short texts are never spam. Repeated texts each count.
    """
    ensure_checkpoint_dir(documents.sparkSession)
    found = spam_features(documents, doc_id, text).checkpoint()
    key = F.coalesce(F.col("lang"), F.lit("none"))
    measures = [("function_share", "function", 0.5), ("top_pair", "pair", 0.5), ("top_word", "word", 0.5), ("separators", "separator", 0.5), ("link_share", "link", 0.99), ("duplicate_lines", "lines", 0.99)]
    usual = lambda kind: [F.percentile_approx(c, at, 1000).alias(f"{kind}_{name}") for c, name, at in measures]
    prose = found.where(f"code_lines < {code_lines} and prose_share > {prose_share}")
    medians = prose.where("lang is not null").groupBy("lang").agg(*usual("usual"))
    overall = prose.agg(*usual("all"))
    judged = found.join(F.broadcast(medians), "lang", "left").crossJoin(F.broadcast(overall))
    usual_function = F.coalesce("usual_function", "all_function", F.lit(0.3))
    usual_pair = F.coalesce("usual_pair", "all_pair", F.lit(0.02))
    missing = F.col("function_share") < function_part * usual_function
    stuffed = F.col("top_pair") > F.greatest(pair_times * usual_pair, F.lit(0.04))
    usual_word = F.coalesce("usual_word", "all_word", F.lit(0.03))
    usual_separator = F.coalesce("usual_separator", "all_separator", F.lit(0.06))
    crowded = (F.col("top_word") > F.greatest(word_times * usual_word, F.lit(0.06))) & (F.col("top_word") * F.col("n_words") >= 4)
    separated = F.col("separators") > F.greatest(separator_times * usual_separator, F.lit(0.12))
    rare = lambda c, name: F.col(c) > F.greatest(rare_times * F.coalesce(f"usual_{name}", f"all_{name}", F.lit(0.3)), F.lit(0.3))
    linked = rare("link_share", "link") | (F.col("n_links") > 0.3 * F.col("n_words"))
    spam = (
        (F.col("n_words") >= min_words)
        & (F.col("prose_share") <= F.when(F.col("n_prose") <= sentences, prose_share).otherwise(stray_prose))
        & (F.col("code_lines") < code_lines)
        & (missing | stuffed | crowded | separated | linked | rare("duplicate_lines", "lines"))
    )
    reason = F.when(linked, "links").when(F.col("separators") > 0.6, "tags").otherwise("keywords")
    return judged.where(spam).select(
        F.col("row_id").alias(doc_id), key.alias("lang"), reason.alias("reason"), "n_words", "n_links", "function_share", "top_word", "top_pair",
        "duplicate_lines", "link_share", "separators", "prose_share",
    )
