"""Problem 5: broken question-answer pairs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexicons import ANSWERING, COURTESY, DENIALS, EMPTY_ANSWERS, FUNCTION_CHARACTERS_ZH, FUNCTION_WORDS, LIMITS, REFUSAL_PHRASES, SPEAKERS

_WORDS_OF = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}
_SHARED = {w: 1 / sum(w in ws for ws in _WORDS_OF.values()) for w in frozenset().union(*_WORDS_OF.values())}
_ZH = frozenset(FUNCTION_CHARACTERS_ZH)
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_INLINE = re.compile(r"`[^`\n]*`")
_QUOTE = re.compile(r"^[ \t]*>.*$", re.M)
_TOKEN = re.compile(r"[㐀-鿿]|[^\W㐀-鿿]+")
_CJK = re.compile(r"[㐀-鿿]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")
_END = re.compile(r"[.!?。！？…](?:[\"'”’»)\]*_]|\*\*)*$")
_LIST_ITEM = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+\S")
_OPENERS = {")": "(", "]": "[", "}": "{"}


class SuffixAutomaton:
    """Suffix automaton of a token list; `covered` traverses it with another list."""

    def __init__(self, tokens: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for t in tokens:
            now = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and t not in self.next[p]:
                self.next[p][t] = now
                p = self.link[p]
            if p >= 0:
                q = self.next[p][t]
                if self.length[p] + 1 == self.length[q]:
                    self.link[now] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(t) == q:
                        self.next[p][t] = clone
                        p = self.link[p]
                    self.link[q] = self.link[now] = clone
            last = now

    def covered(self, tokens: list[str], shortest: int) -> int:
        """How many of the tokens lie in substrings of the automaton's text of at least `shortest` tokens."""
        state = size = total = reach = 0
        for i, t in enumerate(tokens):
            while state and t not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if t in self.next[state]:
                state = self.next[state][t]
                size += 1
            else:
                size = 0
            if size >= shortest:
                total += i + 1 - max(reach, i + 1 - size)
                reach = i + 1
        return total


def _automaton(phrases: tuple[str, ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for p in phrases:
        a.add_word(p, p)
    a.make_automaton()
    return a


_REFUSES, _DENIES, _ANSWERS, _COURTEOUS, _SPEAKS, _LIMITED = map(_automaton, (REFUSAL_PHRASES, DENIALS, ANSWERING, COURTESY, SPEAKERS, LIMITS))


def _first(automaton: ahocorasick.Automaton, text: str, start: int = 0) -> int:
    """End of the first match from `start` on that begins and ends a word, -1 without one."""
    for i, phrase in automaton.iter(text, start):
        a = i + 1 - len(phrase)
        # Chinese has no blanks between words
        if (a == 0 or not (text[a - 1].isalnum() and phrase[0].isascii())) and (i + 1 == len(text) or not (text[i + 1].isalnum() and phrase[-1].isascii())):
            return i
    return -1


def _declines(sentence: str) -> bool:
    """A phrase that declines by itself; or a speaker, and behind a denial an act of answering; or a speaker and a limit of what is done."""
    if _first(_REFUSES, sentence) >= 0:
        return True
    if _first(_SPEAKS, sentence) < 0:
        return False
    deny = _first(_DENIES, sentence)
    return (deny >= 0 and deny + 1 < len(sentence) and _first(_ANSWERS, sentence, deny + 1) >= 0) or _first(_LIMITED, sentence) >= 0


def is_empty(answer: str | None) -> bool:
    """Null, or nothing left but blanks, markup and placeholders."""
    if answer is None:
        return True
    t = re.sub(r"<!--.*?-->|</?\w[^>]*>|&(?:nbsp|#160|#8203|zwj|shy);|[​-‏⁠﻿ ]", " ", answer, flags=re.S).strip().lower()
    bare = re.sub(r"^[\s>*_#~`\-:=|\[\](){}.,;!?/+\"']+|[\s>*_#~`\-:=|\[\](){}.,;!?/+\"']+$", "", t)
    return bare in EMPTY_ANSWERS or bare.replace("_", " ") in EMPTY_ANSWERS


def is_refusal(answer: str, stray: int = 5) -> bool:
    """Every sentence declines or is courtesy, with at least one that declines; of a refusal of `stray` declining or
    courteous sentences or more, one in `stray` may say something else. Code is an answer."""
    text = re.sub(r"[ \t]+", " ", answer.lower().replace("’", "'")).strip()
    if "```" in text:
        return False
    declining = polite = other = 0
    for s in filter(str.strip, _SENTENCE.split(text)):
        if _declines(s):
            declining += 1
        elif _first(_COURTEOUS, s) >= 0:
            polite += 1
        else:
            other += 1
            if "`" in s:
                return False
    return declining > 0 and other * stray <= declining + polite


def language_of(text: str, least: float = 2) -> tuple[str | None, float]:
    """Language with the most stop-word votes outside code and quotes, and its share of the votes."""
    t = _INLINE.sub(" ", _QUOTE.sub(" ", _FENCE.sub(" ", text))).lower()
    votes = dict.fromkeys(_WORDS_OF, 0.0)
    cjk = _CJK.findall(t)
    for w in _WORD.findall(t):
        if w in _SHARED:
            for lang, known in _WORDS_OF.items():
                if w in known:
                    votes[lang] += _SHARED[w]
    votes["zh"] = float(sum(map(_ZH.__contains__, cjk))) + len(cjk) / 8
    best = max(votes, key=votes.get)
    total = sum(votes.values())
    return (best, votes[best] / total) if total and votes[best] >= least else (None, 0.0)


def _is_short(text: str, most_words: int = 8) -> bool:
    """A complete short answer without a full stop: one line of few words that doesn't end on a word that asks for another."""
    if "\n" in text.strip() or _SENTENCE.search(text.strip()):
        return False
    parts = _TOKEN.findall(text.lower())
    last = text.split()[-1].lower() if text.split() else ""
    many = most_words * (2 if _CJK.search(text) else 1)
    # a single word may be "no" or "all"
    asks_for_more = len(parts) > 1 and (last.strip("`'\"()") in _SHARED or last[-1:] in _ZH)
    return 0 < len(parts) <= many and not asks_for_more and last[-1:] not in ",;:-–—("


def is_truncated(answer: str) -> bool:
    """Breaks off: an open fence or delimiter at the end, or a last sentence without an end that is no list, code, greeting
    or short answer."""
    text = answer.rstrip()
    if text.count("```") % 2:
        return True
    body = _FENCE.sub("\x02", text).rstrip()
    if body.endswith("\x02"):
        return False
    stack: list[str] = []
    paragraph = body.split("\n\n")[-1]
    for c in _INLINE.sub("", paragraph):
        if c in "([{":
            stack.append(c)
        elif c in ")]}" and stack and stack[-1] == _OPENERS[c]:
            stack.pop()
    if paragraph.count("`") % 2:
        return True
    lines = body.split("\n")
    last = lines[-1].strip()
    if not stack and _is_short(body):
        return False
    if stack and not _END.search(last):
        return True
    if _END.search(last) or _LIST_ITEM.match(lines[-1]) or last.startswith(("|", ">")):
        return False
    # a greeting or a reference stands alone after a blank line and after a finished text
    before = "\n".join(lines[:-1]).rstrip()
    alone = len(lines) > 1 and not lines[-2].strip()
    if alone and len(last.split()) <= 7 and (_END.search(before) or before.endswith("\x02") or _LIST_ITEM.match(before.split("\n")[-1])):
        return False
    return True


def defect_of(question: str | None, answer: str | None, copied: float = 0.8) -> str | None:
    """The one defect of a pair, or null; in the order of the checks below."""
    if is_empty(answer):
        return "empty"
    if is_refusal(answer):
        return "refusal"
    q, a = _TOKEN.findall((question or "").lower()), _TOKEN.findall(answer.lower())
    if q and a:
        shortest = min(8 if _CJK.search(question) else 5, len(q))
        if SuffixAutomaton(q).covered(a, shortest) >= copied * len(a):
            return "copies_question"
    if question:
        ql, qs = language_of(question)
        al, share = language_of(answer)
        if ql and al and ql != al and share >= 0.6 and qs >= 0.5:
            return "other_language"
    return "truncated" if is_truncated(answer) else None


def broken_pairs(pairs: DataFrame) -> DataFrame:
    """Defective pairs: (id, defect), one row per id.

    Method: a suffix automaton of the question is traversed with the answer to measure how much of it is copied;
    Aho-Corasick automata find refusals, delimiter stacks and line ends find answers that break off, stop-word votes
    compare the languages. A pair that was mined again counts once, by its newest mined_at (null is oldest). A null
    answer is empty; a null question can't be copied or compared. A null id is an id of its own.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["defect"] = [defect_of(q, a) for q, a in zip(b["question"], b["answer"])]
            yield b[["id", "mined", "defect"]]

    mined = F.coalesce(F.col("mined_at").cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz")).cast("string")
    judged = pairs.select("id", mined.alias("mined"), "question", "answer").mapInPandas(judge, "id string, mined string, defect string")
    newest = F.max(F.struct("mined", "defect"))
    return judged.groupBy("id").agg(newest.alias("_n")).select("id", F.col("_n.defect").alias("defect")).where("defect is not null")


def defect_rates(pairs: DataFrame, found: DataFrame, by: str = "repo_name") -> DataFrame:
    """Pairs and defects of each kind per group, over distinct ids."""
    rows = pairs.groupBy("id").agg(F.min(by).alias(by)).join(found, "id", "left")
    return rows.groupBy(by, "defect").agg(F.count("*").alias("n_pairs"))
