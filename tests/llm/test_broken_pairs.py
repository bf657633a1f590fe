import random
from datetime import datetime

import pytest

pytest.importorskip("quern.llm")
from quern.llm.answers import SuffixAutomaton, broken_pairs, defect_of, defect_rates

PAIRS = "id string, question string, answer string, mined_at timestamp_ntz, repo_name string, defect string, mined string"
Q = "How do I configure the cache so that it keeps the newest entries after a restart of the service?"


def test_suffix_automaton_against_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 20))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 20))]
        s = rng.randint(1, 4)
        subs = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + s, len(a) + 1)}
        want = {k for i in range(len(b)) for j in range(i + s, len(b) + 1) if tuple(b[i:j]) in subs for k in range(i, j)}
        assert SuffixAutomaton(a).covered(b, s) == len(want)


@pytest.mark.parametrize(
    "answer, defect",
    [
        (None, "empty"), ("", "empty"), (" \n\t", "empty"), ("<p></p>", "empty"), ("N/A", "empty"), ("_No response_", "empty"), ("<!-- write here -->", "empty"), ("​", "empty"), ("> \n", "empty"),
        ("I'm sorry, but I can't help with that request.", "refusal"), ("Dazu darf ich keine Auskunft geben.", "refusal"), ("抱歉，我无法回答这个问题。", "refusal"), ("Won't answer this. Thanks for understanding.", "refusal"),
        ("Nobody here will explain the cache, please don't ask.", "refusal"),
        ("Sorry for the late reply. Set `keep` to 3 in the configuration and restart the service.", None), ("I can't reproduce it on main, but here is what happens. The cache is emptied.", None),
        (Q, "copies_question"), ("> " + Q.upper(), "copies_question"), ("+1\n\n" + Q, "copies_question"), ("> " + Q[:40] + "\n\nSet the retention to newest and write the index on shutdown, then it is read again.", None),
        ("Das Verhalten ist so gewollt, weil der Speicher sonst den Puffer blockieren würde.", "other_language"), ("这是预期的行为，因为缓冲区否则会阻塞调度器。请检查配置里是否设置了缓存。", "other_language"),
        ("Set the retention in the configuration. ¡Gracias!", None),
        ("Set the retention to the newest entries and then restart because", "truncated"), ("Use it like this (see `keep_newest", "truncated"), ("Run this:\n\n```\nkeep = 3\nrestart(", "truncated"), ("Two options are open:", "truncated"),
        ("Yes, since 1.5.", None), ("Do this:\n\n- set the retention\n- restart the service", None), ("Set it first.\n\n```python\nkeep = 3\n```", None), ("Set the retention and restart it.\n\nHope that helps", None), ("No, use `--keep` instead.", None),
    ],
)
def test_defects(answer, defect):
    assert defect_of(Q, answer) == defect


@pytest.mark.parametrize(
    "answer, defect",
    [
        ("As an AI language model, I do not have access to your files.", "refusal"), ("I must respectfully refuse this request", "refusal"), ("This is beyond my remit.", "refusal"), ("Das kann ich leider nicht beantworten.", "refusal"),
        ("Je ne peux pas répondre à cette question, désolé.", "refusal"), ("No puedo ayudar con eso.", "refusal"), ("Wir lehnen das ab.", "refusal"), ("我们不便透露这个。", "refusal"),
        ("I'm sorry, but I can't help with that. I am not able to share anything about it here, and I will not comment on the plans of others. " * 6, "refusal"),
        ("I'm sorry, but I can't help with the old version. Open the settings, choose the cache and set its size to three.", None), ("We can't keep more than three entries.", None), ("Wir brechen nicht ab.", "other_language"),
        ("Yes", None), ("42", None), ("See above", None), ("Use the flag --keep", None), ("You can set the", "truncated"), ("Set it to 3 and", "truncated"), ("First,", "truncated"),
    ],
)
def test_refusals_of_any_length_and_short_answers(answer, defect):
    assert defect_of(Q, answer) == defect


def test_short_questions_are_copied_too():
    assert defect_of("Why?", "> Why?") == defect_of("Redis cache?", "redis cache") == "copies_question"
    assert defect_of("Why?", "Because it is read first.") is None


def test_operator(spark):
    t = datetime(2024, 1, 1)
    rows = [("1", Q, None, t, "r", "clash", None), ("1", Q, "Set it to 3.", datetime(2024, 2, 1), "r", None, None), ("2", Q, "", None, "r", None, None), ("2", Q, "", None, "r", None, None), ("3", None, "Fine answer.", t, None, None, None), (None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, PAIRS)
    assert {(r["id"], r["defect"]) for r in broken_pairs(df).collect()} == {("2", "empty"), (None, "empty")}
    assert broken_pairs(df.limit(0)).count() == 0
    assert sum(r["n_pairs"] for r in defect_rates(df, broken_pairs(df)).collect()) == 4


def test_very_long_answer():
    assert defect_of(Q, "The cache is kept. " * 20_000) is None
    assert defect_of("x y " * 20_000, "x y " * 20_000) == "copies_question"
