import random

from skein.llm import leaks
from skein.llm.tokens import words

WORDS = [f"w{i}" for i in range(60)]


def brute(docs, items, size):
    out = set()
    for d, t in docs:
        if d is None or not t:
            continue
        w = words(t)
        have = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
        for q, x in items:
            v = words(x or "")
            if any(tuple(v[i : i + size]) in have for i in range(len(v) - size + 1)):
                out.add((d, q))
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    items = [(f"i{k}", " ".join(rng.choice(WORDS) for _ in range(20))) for k in range(12)] + [("short", "w1 w2"), ("none", None), ("same", "w5 " * 30)]
    docs = []
    for d in range(80):
        w = [rng.choice(WORDS) for _ in range(40)]
        if d % 3 == 0:
            v = items[rng.randrange(12)][1].split()
            a = rng.randrange(8)
            n = rng.choice([4, 5, 6, 9])
            w[10:10] = v[a : a + n]
        docs.append((d, " ".join(w)))
    docs += [(100, None), (101, ""), (102, "w5 " * 200), (103, items[0][1]), (103, items[0][1]), (None, items[0][1])]
    dd = spark.createDataFrame(docs, "doc_id bigint, text string")
    ii = spark.createDataFrame(items, "item_id string, t string")
    got = {(r.doc, r.q) for r in leaks.leaked(dd, "doc_id", "text", ii, "item_id", "t", size=5).collect()}
    assert got == brute(docs, items, 5) and len(got) > 15
    assert leaks.leaked(dd.filter("false"), "doc_id", "text", ii, "item_id", "t").count() == 0
    assert leaks.leaked(dd, "doc_id", "text", ii.filter("false"), "item_id", "t").count() == 0


def test_markup():
    assert words("> The **quick** <b>bro</b>wn\n> # fox&amp;co [link](http://x/y) jumps<br>over\n1. done_ok") == ["the", "quick", "brown", "fox", "co", "link", "jumps", "over", "done", "ok"]


def test_phrase_and_near(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "c b a"), (3, "a x b")], "doc_id bigint, text string")
    index = leaks.postings(df, "doc_id", "text")
    assert [tuple(r) for r in leaks.phrase(index, "B c").collect()] == [(1, 1)]
    assert {r.doc for r in leaks.near(index, "a b", 2).collect()} == {1, 2, 3}
    assert {r.doc for r in leaks.near(index, "a b", 1).collect()} == {1, 2}
    assert leaks.near(index, "zz", 3).count() == 0


def test_kept_index(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "c b a"), (3, "a x b")], "doc_id bigint, text string")
    leaks.keep_index(df, "doc_id", "text", str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    assert [tuple(r) for r in leaks.phrase(index, "B c").collect()] == [(1, 1)]
    assert {r.doc for r in leaks.near(index, "a b", 1).collect()} == {1, 2}


def test_many_anchors_are_joined_in_parts(spark, monkeypatch):
    monkeypatch.setattr(leaks, "SENT_TERMS", 0)
    test_against_brute_force(spark)
