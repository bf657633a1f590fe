import pytest

pytest.importorskip("quern.llm")
from quern.llm.spam import features, spam_features, spam_pages

DOCS = "doc_id bigint, text string, lang string, row_id string, n_words int"
PROSE = "The cache is kept on the disk and it will be read again after the restart. You can set how long an entry is kept in the configuration, although most users do not need that. "
SPAM = {
    1: "cheap swift cache, best swift cache, swift cache download, swift cache review, free swift cache, swift cache 2024, online swift cache, swift cache pro",
    2: "\n".join(f"* [swift cache {i}](https://a{i}.example/x)" for i in range(20)),
    3: " ".join(f"#swiftcache{i % 4} #cache{i}" for i in range(20)),
    4: "Swift Cache is the best swift cache for swift cache users. Our swift cache beats any other swift cache. Get swift cache, swift cache pro and swift cache free today. " * 4,
    5: "The cache is kept on the disk.\n\n" + " - ".join(["log kit", "log kit free", "cheap log kit", "log kit pro", "log kit lens"] * 6),
    6: "<div>" + " ".join(f'<a href="//x{i}.test/a">log kit {i}</a>' for i in range(30)) + "</div>",
}
GOOD = {
    11: PROSE * 3,
    12: "# Links\n\n" + "\n".join(f"- [kit {i}](https://k{i}.example): this is the place where the notes of the project are kept and read." for i in range(8)),
    13: "import os\n\n\ndef run(path):\n    x = 1\n    return x\n\n\nclass A:\n    def f(self):\n        return 2\n",
    14: "## 1.2\n\n- The reader is now closed after the last entry was written. (#12)\n- We have moved the check in front of the buffer. (#13)\n",
    15: "| option | default | meaning |\n| --- | --- | --- |\n| `a` | 1 | How long an entry is kept in the cache. |\n| `b` | 2 | Whether the index is written on the way out. |\n",
    16: PROSE + "\n\n```\n" + "\n".join(f"12:0{i} INFO cache: entry {i}" for i in range(9)) + "\n```\n\n" + PROSE,
    17: PROSE * 2 + "\n\n" + "\n".join(f"- https://ref{i}.example/a" for i in range(6)),
    18: "swift cache",
    19: "这是预期的行为，因为缓冲区否则会阻塞调度器。请检查配置里是否设置了缓存，否则服务会一直为空。",
}


def test_found(spark):
    rows = [(i, t, None, "clash", 0) for i, t in [*SPAM.items(), *GOOD.items(), (21, None), (22, "")]] + [(1, SPAM[1], "EN", None, 0)]
    got = sorted(r["doc_id"] for r in spam_pages(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [1, 1, 2, 3, 4, 5, 6]


def test_reasons_and_edges(spark):
    rows = [(i, t, None, None, 0) for i, t in [*SPAM.items(), *GOOD.items()]]
    reasons = {r["doc_id"]: r["reason"] for r in spam_pages(spark.createDataFrame(rows, DOCS)).collect()}
    assert reasons[2] == reasons[6] == "links" and reasons[3] == "tags"
    assert spam_pages(spark.createDataFrame([], DOCS)).count() == 0
    assert spam_features(spark.createDataFrame([(1, "", None, None, 0)], DOCS)).first()["n_words"] == 0
    only = spark.createDataFrame([(1, SPAM[1], None, None, 0)], DOCS)
    assert spam_pages(only).count() == 1


def test_long_text():
    assert features("log kit, " * 100_000)[1] == 200_000


def test_top_word_and_separators_decide(spark):
    """Pages with normal function words, no repeated line, no link and no frequent pair of words."""
    things = "hose pump rake lamp tent rope bench grill spade mower fence shed stove cabin towel glove boots shelf stool clock kettle basket ladder bucket".split()
    places = "garden pool lawn desk beach boat park yard field path door roof tools stairs guests hands snow books piano wall tea bread attic well".split()
    tags = " | ".join(f"{a} for {b}" for a, b in zip(things, places))
    between = "for and with the of to in on or by from at".split()
    one = ". ".join(f"pump {a} {between[i % 12]}" for i, a in enumerate(things[2:]))
    rows = [(i, t, None, None, 0) for i, t in [*GOOD.items(), *((40 + k, PROSE * k) for k in range(1, 10)), (31, tags), (32, one)]]
    df = spark.createDataFrame(rows, DOCS)
    f = {r["row_id"]: r for r in spam_features(df).where("row_id in (31, 32)").collect()}
    assert all(r["prose_share"] == 0 and r["function_share"] > 0.2 and r["top_pair"] < 0.04 and r["link_share"] == r["duplicate_lines"] == 0 for r in f.values())
    assert sorted(r["doc_id"] for r in spam_pages(df).collect()) == [31, 32]
