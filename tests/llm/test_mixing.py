import pytest

pytest.importorskip("quern.llm")
from pyspark.sql import functions as F

from quern.llm.mixing import largest_total, mix_shares, mix_sources, route

DOCS = "doc_id bigint, text string, source string, source_name string, tokens int, bucket int"
TARGETS = "source_name string, target_share double, max_repeats int, reached_tokens int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", -1, -1) for i, t, s in rows], DOCS)


def targets(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], TARGETS)


def test_flow():
    moved, flows = route({("a",): 100, ("a", "b"): 50, ("b",): 10}, {"a": (0.5, 1), "b": (0.5, 2)}, 200)
    assert moved == 200 and flows[("b",), "b"] <= 20 and flows[("a", "b"), "b"] >= 80
    assert largest_total({("a",): 100, ("b",): 10}, {"a": (0.5, 1), "b": (0.5, 3)}) == pytest.approx(60, abs=2)


def test_shares_and_caps(spark):
    rows = [(i, f"big text number {i} with some words", "Big ") for i in range(3000)] + [(10_000 + i, f"small {i} text", "small") for i in range(200)]
    rows += [(20_000 + i, f"big text number {i} with some words", "SMALL") for i in range(30)] + [(1, "unlisted", "other"), (2, None, "big"), (3, "x", None), (4, "   ", "big")]
    t = targets(spark, [("big", 0.6, 1), ("small", 0.4, 3), (None, 0.5, 1), ("gone", 0.0, 3), ("bad", None, 1)])
    mix = mix_sources(docs(spark, rows), t)
    shares = {r["source_name"]: r for r in mix_shares(mix, t).where("source_name is not null").collect()}
    assert abs(shares["big"]["reached_share"] - 0.6) < 0.01 and abs(shares["small"]["reached_share"] - 0.4) < 0.01
    assert shares["small"]["most_repeats"] <= 3 and shares["big"]["most_repeats"] == 1 and shares["gone"]["reached_tokens"] == 0
    again = mix_sources(docs(spark, rows[::-1]), t)
    key = lambda df: sorted(map(tuple, df.select("doc_id", "source_name", "repeats").collect()))
    assert key(mix) == key(again)
    other = mix_sources(docs(spark, rows), t, seed=5)
    assert key(other) != key(mix)


def test_wanted_total_and_edges(spark):
    rows = [(i, f"text {i}", "a" if i % 2 else "b") for i in range(400)]
    t = targets(spark, [("a", 0.5, 1), ("b", 0.5, 1)])
    mix = mix_sources(docs(spark, rows), t, total_tokens=400)
    assert abs(mix.agg(F.sum(F.col("tokens") * F.col("repeats"))).first()[0] - 400) <= 8
    assert mix_sources(docs(spark, []), t).count() == 0 and mix_sources(docs(spark, rows), targets(spark, [])).count() == 0
    short = mix_sources(docs(spark, rows), t, total_tokens=10_000)
    assert short.count() == 400 and short.agg(F.max("repeats")).first()[0] == 1
    assert mix_shares(mix_sources(docs(spark, []), t), t).count() == 2


def test_too_many_targets_are_an_error(spark):
    with pytest.raises(ValueError):
        mix_sources(docs(spark, [(1, "a b", "x")]), targets(spark, [("x", 0.5, 1), ("y", 0.5, 1)]), max_patterns=1)
