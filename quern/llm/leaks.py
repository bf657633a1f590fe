"""Problem 6: evaluation texts inside a training corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

HITS = "row_id bigint, item_id bigint, first_word int, last_word int, n_words int, n_equal int"
_ESCAPE = re.compile(r"\\[nrt]|</?[a-zA-Z!][^<>\n]*>|&#?\w{1,8};|\\(?=\W)|[*_~`]{1,3}(?=\w)|(?<=\w)[*~`]{1,3}")
_STRIP = re.compile(r"[\W_]+")


def words(text: str | None) -> list[str]:
    """Words split at blanks, in lower case, without escapes, markup, comment signs and punctuation; empty ones go."""
    if not text:
        return []
    out = []
    for w in _ESCAPE.sub(lambda m: " " if m[0][0] in "<\\&" and len(m[0]) > 1 else "", text).lower().split():
        if not w.isalnum():
            w = _STRIP.sub("", w)
            if not w:
                continue
        out.append(w)
    return out


def word_places(text: str) -> list[tuple[int, int]]:
    """Where each of `words(text)` begins and ends in the text."""
    # what goes keeps its length: a blank where words part, a sign that is no letter where they don't
    padded = _ESCAPE.sub(lambda m: (" " if m[0][0] in "<\\&" and len(m[0]) > 1 else "\ue000") * len(m[0]), text)
    return [m.span() for m in re.finditer(r"\S+", padded) if (w := m[0].lower()).isalnum() or _STRIP.sub("", w)]


def _parts(same: np.ndarray, min_words: int, min_equal: float) -> Iterator[tuple[int, int, int]]:
    """(first, last, equal words) of the longest part of a run that has at least min_words words, begins and ends on
    equal words and reaches min_equal; then of what lies before and behind it. One pass over prefix sums each."""
    todo = [(0, len(same))]
    while todo:
        a, b = todo.pop()
        at = np.flatnonzero(same[a:b]) + a
        if not len(at) or at[-1] - at[0] + 1 < min_words:
            continue
        if len(at) >= min_equal * (at[-1] - at[0] + 1) - 1e-9:
            yield int(at[0]), int(at[-1]), len(at)
            continue
        # before the k-th equal word lie k equal ones; a part is good when its balance doesn't fall
        before = (np.arange(len(at)) - min_equal * at).tolist()
        after = (np.arange(1, len(at) + 1) - min_equal * (at + 1)).tolist()
        starts: list[int] = []
        for k, x in enumerate(before):
            if not starts or x < before[starts[-1]] - 1e-9:
                starts.append(k)
        best = None
        for z in range(len(at) - 1, -1, -1):
            while starts and after[z] >= before[starts[-1]] - 1e-9:
                s = starts.pop()
                if s <= z and (best is None or at[z] - at[s] > at[best[1]] - at[best[0]]):
                    best = (s, z)
        if best is None or at[best[1]] - at[best[0]] + 1 < min_words:
            continue
        yield int(at[best[0]]), int(at[best[1]]), best[1] - best[0] + 1
        todo += [(a, int(at[best[0]])), (int(at[best[1]]) + 1, b)]


def _whole(same: np.ndarray, min_words: int, min_equal: float) -> Iterator[tuple[int, int, int]]:
    """The same for the run as a whole."""
    at = np.flatnonzero(same)
    if len(at) and at[-1] - at[0] + 1 >= min_words and len(at) >= min_equal * (at[-1] - at[0] + 1) - 1e-9:
        yield int(at[0]), int(at[-1]), len(at)


def _spans(doc: np.ndarray, item: np.ndarray, shift: int, min_words: int, min_equal: float, parts: bool) -> Iterator[tuple[int, int, int]]:
    """Passages on the diagonal item = doc - shift: equal words, single replaced words in between."""
    lo, hi = max(0, shift), min(len(doc), len(item) + shift)
    same = doc[lo:hi] == item[lo - shift : hi - shift]
    if int(same.sum()) < min_equal * min_words - 1e-9:
        return
    # two words in a row that differ end a passage; a single one is a replaced word
    gap = ~same
    cut = np.flatnonzero(gap[:-1] & gap[1:]) if len(gap) > 1 else np.array([], dtype=int)
    edges = np.concatenate(([-1], cut, [len(same)]))
    for a, b in zip(edges[:-1] + 1, edges[1:]):
        for first, last, equal in (_parts if parts else _whole)(same[a:b], min_words, min_equal):
            yield int(lo + a + first), int(lo + a + last), equal


def least_hits(n: int, min_words: int, min_equal: float) -> int:
    """How many n-grams two passages share at least, on one diagonal, when a passage is as short and as changed as it
    may be: m differing words leave m + 1 runs, and a run of r equal words holds r - n + 1 n-grams."""
    bounds = (length - m - (n - 1) * (m + 1) for length in range(min_words, 20 * min_words) for m in (int((1 - min_equal) * length + 1e-9),))
    least = min(bounds)
    if least < 1:
        raise ValueError(f"a passage with {min_equal} equal words may hold no run of {n}: use shorter n-grams")
    return least


def leaked_passages(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    n: int = 4,
    min_words: int = 15,
    min_equal: float = 0.85,
    max_item_rows: int = 100_000,
    parts: bool = False,
) -> DataFrame:
    """Passages of items in documents: (doc_id, item_id, first_word, last_word, n_words, n_equal), word positions from 0.

    Method: all n-grams of the items' normalised words are hashed into a set that is broadcast (the items are a fixed
    evaluation set; more than about `max_item_rows` of them are scanned in batches of that size, one pass over the documents
    for each). Each document's word windows are scanned against the set; every hit names a diagonal (document position
    minus item position). A diagonal with as many hits as any passage must have (least_hits) is verified word by word: a
    passage is a run of at least `min_words` words in which differing words stand alone, with a share of `min_equal`
    equal words or more. With `parts` it is any part of such a run that begins and ends on equal words and has that
    length and share, so that the words around it take nothing from it. least_hits counts within the passage, so it
    holds for both; a share under which a passage may hold no n-gram at all is an error.

    Null and empty texts have no passages; repeated texts and repeated items each count. An item with null text or id
    gives nothing. Documents are read once, in their own partitions, with no shuffle.
    """
    source = documents.select(F.col(doc_id).cast("bigint").alias("row_id"), F.col(text).alias("text")).where("text is not null")
    usable = items.where("item_id is not null and text is not null").select("item_id", "text")
    batches = max(1, -(-usable.count() // max_item_rows))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(batches))
    passes = [_scan(source, usable.where(part == i).collect(), n, min_words, min_equal, parts) for i in range(batches)]
    return reduce(DataFrame.unionByName, passes).withColumnRenamed("row_id", doc_id)


def _scan(source: DataFrame, rows: list[Row], n: int, min_words: int, min_equal: float, parts: bool) -> DataFrame:
    """Passages of one batch of items."""
    vocabulary: dict[str, int] = {}
    item_ids: list[int] = []
    item_words: list[np.ndarray] = []
    for r in rows:
        w = words(r["text"])
        if len(w) >= min_words:
            item_words.append(np.array([vocabulary.setdefault(x, len(vocabulary) + 1) for x in w], dtype=np.int32))
            item_ids.append(r["item_id"])
    # an n-gram as one number: words are numbers below the vocabulary's size
    base = len(vocabulary) + 2
    grams = [_grams(ids, n, base) for ids in item_words] or [np.zeros(0, dtype=np.uint64)]
    sizes = [len(g) for g in grams]
    keys = np.concatenate(grams)
    order = np.argsort(keys, kind="stable")
    # the places of all keys one after another: key j has those from first[j] to first[j + 1]
    sorted_keys, many = np.unique(keys, return_counts=True)
    first = np.concatenate(([0], np.cumsum(many)))
    of_item = np.repeat(np.arange(len(grams)), sizes)[order]
    of_word = np.concatenate([np.arange(k) for k in sizes])[order]
    shared = source.sparkSession.sparkContext.broadcast((vocabulary, base, sorted_keys, first, of_item, of_word, item_ids, item_words))
    hits_needed = least_hits(n, min_words, min_equal)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab, b, sorted_k, start, items_at, words_at, ids, texts = shared.value
        get = vocab.get
        for batch in batches:
            out: list[tuple] = []
            for d, t in zip(batch["row_id"], batch["text"]):
                w = words(t)
                if len(w) < min_words or not len(sorted_k):
                    continue
                doc = np.fromiter((get(x, 0) for x in w), dtype=np.int32, count=len(w))
                k = _grams(doc, n, b)
                # a gram with a word that no item has is none of theirs
                unknown = np.concatenate(([0], np.cumsum(doc == 0)))
                pos = np.flatnonzero(unknown[n:] == unknown[:-n])
                if len(pos) < hits_needed:
                    continue
                found = np.searchsorted(sorted_k, k[pos])
                found[found == len(sorted_k)] = 0
                hit = sorted_k[found] == k[pos]
                pos, found = pos[hit], found[hit]
                if len(pos) < hits_needed:
                    continue
                # all places of all hits at once
                many = start[found + 1] - start[found]
                at = np.repeat(start[found] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(int(many.sum()))
                shift = np.repeat(pos, many) - words_at[at]
                diagonals, counts = np.unique(items_at[at] * (1 << 32) + shift, return_counts=True)
                for diagonal in diagonals[counts >= hits_needed].tolist():
                    i = (diagonal + (1 << 31)) >> 32
                    # words that no item has are 0 and never equal an item's word
                    for a, z, equal in _spans(doc, texts[i], diagonal - (i << 32), min_words, min_equal, parts):
                        out.append((d, ids[i], a, z, z - a + 1, equal))
            yield pd.DataFrame(out, columns=["row_id", "item_id", "first_word", "last_word", "n_words", "n_equal"])

    return source.mapInPandas(scan, HITS)


def _grams(ids: np.ndarray, n: int, base: int) -> np.ndarray:
    """All n-grams of word numbers, as one number each (modulo 2^64; the passages are verified word by word)."""
    m = len(ids) - n + 1
    k = np.zeros(max(0, m), dtype=np.uint64)
    for j in range(n if m > 0 else 0):
        k = k * np.uint64(base) + ids[j : j + m].astype(np.uint64)
    return k


def leaked_items(hits: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Which items leaked, into how many documents, and the longest passage of each."""
    return hits.groupBy("item_id").agg(F.countDistinct(doc_id).alias("n_docs"), F.max("n_words").alias("longest_passage"))


def without_leaks(documents: DataFrame, hits: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents that hold no passage."""
    return documents.join(hits.select(doc_id).distinct(), doc_id, "left_anti")


def without_passages(documents: DataFrame, hits: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents, the found passages cut out of their texts; what is left is joined by a blank. A document without
    a passage keeps its text as it is. The columns stay the same."""
    spans = hits.groupBy(doc_id).agg(F.collect_set(F.struct("first_word", "last_word")).alias("_spans"))

    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, found in zip(texts, spans):
            at = word_places(t)
            kept, upto = [], 0
            for first, last in sorted((x["first_word"], x["last_word"]) for x in found):
                kept.append(t[upto : max(upto, at[first][0])])
                upto = max(upto, at[last][1])
            out.append(" ".join(x for x in (y.strip() for y in (*kept, t[upto:])) if x))
        return pd.Series(out, dtype=object)

    touched = documents.join(spans, doc_id).withColumn(text, F.pandas_udf(cut, "string")(F.col(text), F.col("_spans")))
    return touched.select(*documents.columns).unionByName(documents.join(spans, doc_id, "left_anti"))
