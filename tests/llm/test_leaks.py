import random

import pytest

pytest.importorskip("quern.llm")
import numpy as np

from quern.llm.leaks import leaked_items, leaked_passages, least_hits, without_leaks, without_passages, word_places, words

DOCS = "doc_id bigint, text string, item_id bigint, row_id string"
ITEMS = "item_id bigint, kind string, text string, doc_id int"
rng = random.Random(4)
VOCAB = [f"w{i}" for i in range(400)]
ITEM = [rng.choice(VOCAB) for _ in range(60)]
OTHER = [rng.choice(VOCAB) for _ in range(40)]


def found(spark, docs, items=None, **kw):
    d = spark.createDataFrame([(i, t, None, "x") for i, t in docs], DOCS)
    it = spark.createDataFrame(items if items is not None else [(1, "q", " ".join(ITEM), 1), (2, "q", " ".join(OTHER), 1), (3, None, None, None), (None, "q", "a " * 20, None)], ITEMS)
    return leaked_passages(d, it, **kw)


def noise(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def test_words():
    assert words('The **Foo_bar**,\\n// don\'t <b>stop</b> &amp; "go" -- `x_y`') == ["the", "foobar", "dont", "stop", "go", "xy"]
    assert words(None) == [] and words("  \n// --- \n") == []


def test_planted_passages(spark):
    replaced = list(ITEM[5:35])
    for k in (6, 13, 21):
        replaced[k] = "other"
    docs = [
        (1, noise(50) + " " + " ".join(ITEM[10:25]) + " " + noise(50)),
        (2, noise(50) + " " + " ".join(ITEM[10:24]) + " " + noise(50)),
        (3, "/*\n * " + "\n * ".join(" ".join(x.upper() + "," for x in ITEM[i : i + 4]) for i in range(0, 40, 4)) + "\n */"),
        (4, noise(9) + " " + " ".join(replaced) + " " + noise(9)),
        (5, noise(300)), (6, None), (7, ""),
        (8, " ".join(ITEM[:20]) + " " + noise(3) + " " + " ".join(OTHER[:20])),
        (9, noise(50) + " " + " ".join(ITEM[10:25]) + " " + noise(50)),
    ]
    got = {(r["doc_id"], r["item_id"]) for r in found(spark, docs).collect()}
    assert got == {(1, 1), (3, 1), (4, 1), (8, 1), (8, 2), (9, 1)}


def test_reports_and_edges(spark):
    hits = found(spark, [(1, " ".join(ITEM)), (1, " ".join(ITEM)), (2, " ".join(ITEM[:30])), (3, "x")])
    r = leaked_items(hits).first()
    assert (r["item_id"], r["n_docs"], r["longest_passage"]) == (1, 2, 60)
    docs = spark.createDataFrame([(1, "a"), (3, "b")], "doc_id bigint, text string")
    assert [x["doc_id"] for x in without_leaks(docs, hits).collect()] == [3]
    assert found(spark, []).count() == 0 and found(spark, [(1, " ".join(ITEM))], []).count() == 0
    assert found(spark, [(1, " ".join(ITEM * 3000))]).select("item_id").distinct().count() == 1
    # more items than one batch may hold take several passes
    docs = [(1, noise(20) + " " + " ".join(ITEM) + " " + " ".join(OTHER)), (2, " ".join(OTHER))]
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(found(spark, docs, max_item_rows=1)) == key(found(spark, docs)) != []


def brute(doc, item, min_words=15, min_equal=0.85):
    """Longest run on any diagonal in which differing words stand alone."""
    d, it = words(doc), words(item)
    for shift in range(-len(it), len(d)):
        same = [0 <= p - shift < len(it) and d[p] == it[p - shift] for p in range(len(d))]
        lo, hi = max(0, shift), min(len(d), len(it) + shift)
        a = None
        p = lo
        while p < hi:
            if same[p]:
                a, last, n, q = p, p, 0, p
                while q < hi and (same[q] or (q + 1 < hi and same[q + 1])):
                    n += same[q]
                    last = q if same[q] else last
                    q += 1
                if last - a + 1 >= min_words and n >= min_equal * (last - a + 1):
                    return True
                p = q + 1
            else:
                p += 1
    return False


def test_against_brute_force(spark):
    assert least_hits(4, 15, 0.85) == 4
    r = random.Random(8)
    few = [f"w{i}" for i in range(12)]
    item = [r.choice(few) for _ in range(50)]
    docs = []
    for i in range(120):
        a, n = r.randint(0, 30), r.randint(10, 20)
        part = [x if r.random() > 0.12 else r.choice(few) for x in item[a : a + n]]
        docs.append((i, " ".join([r.choice(few) for _ in range(30)] + part + [r.choice(few) for _ in range(30)])))
    got = {x["doc_id"] for x in found(spark, docs, [(1, "q", " ".join(item), 1)]).collect()}
    assert got == {i for i, t in docs if brute(t, " ".join(item))}


def test_best_part_of_a_run(spark):
    """Chance matches around a passage take nothing from it; the parts are those of a search over all pairs of ends."""
    verbatim = ITEM[10:26]
    tail = [x if k % 2 else "other" for k, x in enumerate(ITEM[26:36])]
    head = [x if k % 2 else "other" for k, x in enumerate(ITEM[1:10])]
    docs = [(1, " ".join([noise(40), *verbatim, *tail, noise(40)])), (2, " ".join([noise(40), *head, *verbatim, *tail, noise(40)])), (3, " ".join([noise(40), *verbatim[:11], *tail, noise(40)]))]
    assert {(r["doc_id"], r["item_id"]) for r in found(spark, docs, parts=True).collect()} == {(1, 1), (2, 1)}
    from quern.llm.leaks import _parts

    r = random.Random(5)
    for _ in range(400):
        same = [r.random() < 0.8 for _ in range(r.randint(1, 60))]
        want = max((z - a + 1 for a in range(len(same)) for z in range(a + 14, len(same)) if same[a] and same[z] and sum(same[a : z + 1]) >= 0.85 * (z - a + 1) - 1e-9), default=0)
        got = list(_parts(np.array(same), 15, 0.85))
        assert max((z - a + 1 for a, z, _ in got), default=0) == want
        assert all(n == sum(same[a : z + 1]) >= 0.85 * (z - a + 1) - 1e-9 for a, z, n in got)
    with pytest.raises(ValueError):
        least_hits(4, 15, 0.75)


def test_passages_are_cut_out(spark):
    text = "Before **it**.\n// " + "\n// ".join(" ".join(f"_{x}_," for x in ITEM[i : i + 5]) for i in range(0, 60, 5)) + "\nBehind\\n it <a href='" + "x" * 300 + "'>all</a>."
    assert [text[a:b] for a, b in word_places(text)][:2] == ["Before", "**it**."] and len(word_places(text)) == len(words(text))
    rows = [(1, text), (2, "nothing here"), (3, None), (4, ""), (5, " ".join(OTHER))]
    d = spark.createDataFrame([(i, t, None, "x") for i, t in rows], DOCS)
    got = {r["doc_id"]: r["text"] for r in without_passages(d, found(spark, rows)).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[2] == "nothing here" and got[3] is None and got[5] == got[4] == ""
    assert got[1].startswith("Before **it**.\n//") and words(got[1]) == ["before", "it", "behind", "it", "all"]
    assert found(spark, got.items()).count() == 0
