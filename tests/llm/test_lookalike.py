import random

from skein.llm import lookalike as la


def form(texts):
    counts = {}
    for t in texts:
        for c in t or "":
            counts[c] = counts.get(c, 0) + 1
    go = la.Rewriter(la.build_classes(counts))
    return [go(t) for t in texts]


def same(*texts):
    return len(set(form(list(texts) + ["filler e o a c"]) [: len(texts)])) == 1


def test_equal():
    assert same("café №1", "café №1", "ｃａｆé №1", "cа​fé №1".replace(" ", " "), "𝖼𝖺𝖿é №1")
    assert same("office", "oﬃce", "о⁢ffice", "⁦office⁩", "off️ice", "off\U000e0061ice")
    assert same("ѐ", "è", "ѐ", "è", "e‍̀")
    assert same("バ", "バ")


def test_different():
    for a, b in [("Cafe", "cafe"), ("cafe", "café"), ("a…", "a."), ("x²", "x2"), ("l", "1"), ("a b", "ab"), ("а", "б"), ("ß", "ss"), ("a\nb", "a b")]:
        assert not same(a, b), (a, b)


def test_representative_may_be_of_another_script():
    # The Cyrillic letter is the more frequent one; equality must not depend on it.
    many = ["е" * 50, "é", "é", "е́", "е​́", "ｅ́", None, ""]
    got = form(many)
    assert len(set(got[1:6])) == 1 and got[6] is None and got[7] == ""


def test_idempotent():
    rng = random.Random(3)
    pool = "abceopxyАВЕ еорсухіѕ́̈​ ｆﬁ𝚊éà̧"
    texts = ["".join(rng.choice(pool) for _ in range(12)) for _ in range(300)]
    once = form(texts)
    counts = {}
    for t in texts:
        for c in t:
            counts[c] = counts.get(c, 0) + 1
    go = la.Rewriter(la.build_classes(counts))
    assert [go(t) for t in once] == once


def test_pairs(spark):
    rows = [(1, 1, "abc"), (2, 1, "аbc"), (3, 1, "abc"), (4, 2, "abc"), (5, 1, None), (6, 1, ""), (7, None, "аbc")]
    df = spark.createDataFrame(rows, "run_id bigint, tool_id bigint, text string")
    rep = la.learn([df.select("text")])
    out = la.rewrite(df, "text", "form", rep)
    assert sorted(tuple(r) for r in la.same_look(out, ["tool_id"], "text", "form", "run_id").collect()) == [(1, 2), (2, 3)]
    assert sorted(tuple(r) for r in la.same_look(out, [], "text", "form", "run_id").collect()) == [(1, 2), (1, 7), (2, 3), (2, 4), (3, 7), (4, 7)]
    none = df.filter("false")
    assert la.same_look(la.rewrite(none, "text", "form", la.learn([none.select("text")])), [], "text", "form", "run_id").count() == 0


def test_public_table(spark):
    pairs = "oⲟ cⲥ MⲘ HⲎ Iꓲ oס Iᛁ lן aа eе".split()
    found = la.confusables(spark, "".join(pairs)) | la.shape_table()
    assert [p for p in pairs if found.get(p[1]) != p[0]] == []
    assert not {"0", "1", "|", "m", "Ю", "೦"} & set(la.confusables(spark, "01|mЮ೦"))


def test_strings_have_classes():
    many = la.build_classes({"ﬁ": 9, "f": 3, "i": 3, "fi": 2, "ｆ": 1, "n": 1, "e": 1})
    go = la.Rewriter(many)
    assert many["fi"] == "ﬁ" and go("fine") == go("ｆine") == go("ﬁne") == "ﬁne"
    few = la.Rewriter(la.build_classes({"ﬁ": 1, "f": 3, "i": 3, "fi": 2}))
    assert few("ﬁ fi") == "fi fi"
    assert go(go("ｆiﬁ f i")) == go("ｆiﬁ f i")


def test_hot_looks_are_paired_in_parts(spark, monkeypatch):
    monkeypatch.setattr(la, "PAIRED", 7)
    df = spark.createDataFrame([(i, "abc" if i % 3 else "аbc", "abc") for i in range(40)], "i bigint, t string, form string")
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if (a % 3 == 0) != (b % 3 == 0)}
    got = la.same_look(df, [], "t", "form", "i").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert {(r.n_rows, r.n_spellings) for r in la.look_classes(df, [], "t", "form", "i").collect()} == {(40, 2)}
