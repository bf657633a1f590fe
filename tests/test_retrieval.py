import math
import random

import numpy as np
from pyspark.sql import functions as F

from quern.operators.fusion import classify_questions, route, rrf_fuse
from quern.operators.lexical import bm25_scores, top_k
from quern.operators.vectors import build_ivf, cosine_topk, fit_centroids, ivf_topk
from quern.plans.answering import ask, grid
from quern.plans.hybrid import hybrid_topk


def brute_bm25(docs, query, k1=1.5, b=0.75, eps=0.25):
    import re

    toks = {i: re.findall(r"[a-z_][a-z0-9_]*", (t or "").lower()) for i, t in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else eps * mean for w, v in idf.items()}
    out = {}
    for i, t in toks.items():
        s = 0.0
        for w in re.findall(r"[a-z_][a-z0-9_]*", query.lower()):
            tf = t.count(w)
            if tf:
                s += idf[w] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / avg))
        if s > 0:
            out[i] = s
    return out


def test_bm25_against_brute_force(spark):
    rng = random.Random(3)
    docs = {i: " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi pi rho the the the".split()) for _ in range(rng.randint(0, 9))) for i in range(40)}
    docs[40] = None
    d = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    q = spark.createDataFrame([(1, "alpha alpha beta"), (2, "the gamma"), (3, "missing"), (4, None)], "question_id bigint, question string")
    got = {(r["question_id"], r["doc_id"]): r["score"] for r in bm25_scores(d, q).collect()}
    want = {(i, k): v for i, t in ((1, "alpha alpha beta"), (2, "the gamma"), (3, "missing")) for k, v in brute_bm25(docs, t).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert top_k(bm25_scores(d, q), 3).where("question_id = 1").count() == 3


def test_cosine_topk(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(200, 8))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0])]
    v = spark.createDataFrame(rows, "doc_id bigint, embedding array<float>")
    q = v.where("doc_id in (0, 50)").select(F.col("doc_id").alias("question_id"), "embedding")
    got = {(r["question_id"], r["rank"]): r["doc_id"] for r in cosine_topk(v, q, 5).collect()}
    u = m.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for i in (0, 50):
        want = sorted(range(200), key=lambda j: (round(1 - float(u[i] @ u[j]), 9), j))[:5]
        assert [got[i, k + 1] for k in range(5)] == want
    assert cosine_topk(v.limit(0), q, 5).count() == 0 and cosine_topk(v, q.limit(0), 5).count() == 0


def test_ivf_recall(spark, small):
    from quern.catalog import _vectors

    v, q = _vectors(spark, small)
    c = fit_centroids(v, 16)
    index = build_ivf(v, c)
    assert index.count() == v.count()
    exact = {(r["question_id"], r["doc_id"]) for r in cosine_topk(v, q, 10).collect()}
    near = {(r["question_id"], r["doc_id"]) for r in ivf_topk(index, c, q, 10, probes=12).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_rrf(spark):
    s = "question_id int, list_no int, rank int, doc_id string, weight double"
    got = rrf_fuse(spark.createDataFrame([(1, 1, 1, "a", 1.0), (1, 1, 2, "b", 1.0), (1, 2, 1, "b", 1.5), (1, 2, 2, "c", 1.5)], s)).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == ["b", "c", "a"]
    assert abs(got[0]["score"] - (1 / 62 + 1.5 / 61)) < 1e-12 and abs(got[2]["score"] - 1 / 61) < 1e-12
    twice = rrf_fuse(spark.createDataFrame([(1, 1, 1, "a", 1.0), (1, 1, 2, "a", 1.0)], s)).first()
    assert abs(twice["score"] - (1 / 61 + 1 / 62)) < 1e-12


def test_classification_and_routing(spark):
    rows = [(1, "zzz"), (2, "module bug"), (3, "How to deploy with docker?"), (4, None), (5, " .env"), (6, "prod.env")]
    typed = classify_questions(spark.createDataFrame(rows, "question_id int, question string"))
    got = {r["question_id"]: r["predicted_type"] for r in typed.collect()}
    assert got == {1: "logic", 2: "architecture", 3: "deployment", 4: "logic", 5: "logic", 6: "deployment"}
    routed = {r["question_id"]: (r["semantic_k"], r["bm25_k"]) for r in route(typed, "predicted_type").collect()}
    assert routed[2] == (15, 10) and routed[3] == (10, 15) and routed[1] == (15, 15)


def test_hybrid_flags(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["alpha beta", "gamma", "alpha alpha", "delta eps", "beta"])], "doc_id bigint, text string")
    q = spark.createDataFrame([(1, "alpha beta?")], "question_id bigint, question string")
    both = hybrid_topk(docs, q, 3).collect()
    assert len(both) == 3 and {r["rank"] for r in both} == {1, 2, 3}
    assert hybrid_topk(docs, q, 3, use_semantic=False).count() >= 2
    assert hybrid_topk(docs, q, 3, use_bm25=False, use_routing=False).count() == 3


def test_ask_and_grid(spark):
    s = "seq bigint, repo_path string, content string, chunk_type string, start_line int, end_line int, symbol_name string, language string"
    chunks = spark.createDataFrame([(1, "a/b.py", "def alpha(): pass", "function", 1, 2, "alpha", "python"), (1, "a/b.py", "def alpha(): pass", "function", 1, 2, "alpha", "python"), (2, "c.md", "beta gamma", "prose", 1, 1, None, None)], s)
    q = spark.createDataFrame([(1, "what does alpha do?"), (2, "zzz")], "question_id bigint, question string")
    got = {r["question_id"]: r for r in ask(chunks, q).collect()}
    assert got[1]["n_citations"] >= 1 and got[1]["n_verified"] == got[1]["n_citations"] and got[1]["confidence"] == "high"
    assert grid(spark.createDataFrame([("x",), ("y",)], "config string"), q, 3).count() == 12
