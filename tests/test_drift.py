import json

from skein.operators import drift
from skein.plans import core_queries

SCHEMA = "file_id bigint, feed string, seq_no int, fmt string, body string, path string, types int"


def frame(spark, rows):
    return spark.createDataFrame([(i, f, s, fmt, b, "clash", 1) for i, f, s, fmt, b in rows], SCHEMA)


def lines(*recs):
    return "\n".join(json.dumps(r) for r in recs)


def cases(spark, rows):
    return {(r.file_id, r.field, r.change_kind, r.new_field) for r in drift.changes(frame(spark, rows)).collect()}


def test_kinds(spark):
    a = [{"key": "k1", "v": "1.0", "n": 1, "old": None}, {"key": "k2", "v": "2.0", "n": 2}]
    b = [{"key": "k1", "ver": "1.0", "n": "1"}, {"key": "k3", "ver": "9", "n": "2", "fresh": {}}]
    c = [{"key": "k1", "ver": ["1.0"], "n": None}]
    d = [{"key": "k1", "ver": ["1.0"], "n": 1.5, "old": 3}]
    got = cases(spark, [(1, "f", 1, "json", json.dumps(a)), (2, "f", 2, "jsonl", lines(*b)), (3, "f", 3, "jsonl", lines(*c)), (9, "f", 3, "jsonl", "{}"), (4, "f", 4, "jsonl", lines(*d))])
    assert got == {(2, "v", "renamed", "ver"), (2, "old", "removed", ""), (2, "n", "retyped", ""), (2, "fresh", "added", ""), (3, "fresh", "removed", ""), (3, "ver", "retyped", ""), (4, "old", "added", ""), (4, "n", "retyped", "")}


def test_rename_carries_type(spark):
    a, b, c = [{"key": "k", "x": 1}], [{"key": "k", "y": 1}], [{"key": "k", "y": "1"}]
    got = cases(spark, [(1, "f", 1, "jsonl", lines(*a)), (2, "f", 2, "jsonl", lines(*b)), (3, "f", 3, "jsonl", lines(*c))])
    assert got == {(2, "x", "renamed", "y"), (3, "y", "retyped", "")}


def test_dirty(spark):
    rows = [(1, None, 1, "jsonl", "{}"), (2, "f", None, "jsonl", "{}"), (3, "g", 1, "json", "not json"), (4, "g", 2, "jsonl", None), (5, "g", 3, "jsonl", '{"a": 1}\n[1]\nx\n\n'), (6, "g", 3, "jsonl", '{"b": 1}'), (7, "g", 5, "jsonl", '{"a": 1}'), (7, "g", 5, "jsonl", '{"a": 1}')]
    assert cases(spark, rows) == {(5, "a", "added", "")}
    assert cases(spark, []) == set()


def test_long_feed(spark):
    rows = [(s, "hot", s, "jsonl", json.dumps({"key": "k", ("a" if s < 1500 else "b"): s if s < 2000 else str(s)})) for s in range(1, 2101)]
    got = cases(spark, rows)
    assert got == {(1500, "a", "removed", ""), (1500, "b", "added", ""), (2000, "b", "retyped", "")}


def test_table(spark):
    a = [{"key": "k1", "rule_pack_version": "1", "tool_hash_version": 2}]
    b = [{"key": "k1", "pack": "1", "tool_hash_version": "x"}]
    c = [{"key": "k1", "rp": "1", "tool_hash_version": "3", "other": [1]}]
    f = frame(spark, [(1, "f", 1, "jsonl", lines(*a)), (2, "f", 2, "jsonl", lines(*b)), (3, "f", 3, "jsonl", lines(*c))])
    rows = {r.file_id: r for r in drift.consistent(f, {"rule_pack_version": "string", "tool_hash_version": "bigint"}).collect()}
    assert [rows[i].rule_pack_version for i in (1, 2, 3)] == ["1", "1", "1"]
    assert [rows[i].tool_hash_version for i in (1, 2, 3)] == [2, None, 3]
    assert [(x.field, x.value) for x in rows[2].failed] == [("tool_hash_version", '"x"')]
    assert [(x.name, x.value) for x in rows[3].extras] == [("other", "[1]")]


def test_table_keeps_every_field(spark, tmp_path):
    a = [{"key": "k1", "ENGINE_VERSION": "7", "rule_pack_version": "1", "scanned_at": "2026", "ratio": 0.5, "signed": True}]
    b = [{"key": "k1", "ENGINE_VERSION": "7", "pack": "1", "scanned_at": None, "limits": {"n": 1}}]
    c = [{"key": "k1", "pack": "1", "rule_pack_version": "9"}]
    frame(spark, [(1, "f", 1, "jsonl", lines(*a)), (2, "f", 2, "jsonl", lines(*b)), (3, "f", 3, "jsonl", lines(*c))]).write.parquet(str(tmp_path / "feed_files.parquet"))
    rows = {r.file_id: r for r in core_queries.p1_table(spark, str(tmp_path)).collect()}
    assert [rows[i].rule_pack_version for i in (1, 2)] == ["1", "1"]
    assert [(r.ENGINE_VERSION, r.ratio, r.scanned_at, r.signed, r.limits) for r in (rows[1], rows[2])] == [("7", 0.5, "2026", True, None), ("7", None, None, None, '{"n":1}')]
    assert [tuple(x) for x in rows[1].extras] == [] and [tuple(x) for x in rows[2].extras] == []
    assert sorted([rows[3].rule_pack_version, *[x.value.strip('"') for x in rows[3].extras]]) == ["1", "9"]


def test_columns_follow_the_statistics(spark):
    a = [{"key": f"k{i}", "n": i, "r": i, "extras": i, "void": None, "mixed": i} for i in range(3)]
    b = [{"key": "k9", "n": 4, "r": 0.5, "mixed": "x"}]
    f = frame(spark, [(1, "f", 1, "jsonl", lines(*a)), (2, "f", 2, "jsonl", lines(*b)), (2, "f", 2, "jsonl", lines(*b))])
    df = drift.consistent(f)
    assert {k: t for k, t in df.dtypes if k in ("n", "r", "mixed", "void")} == {"n": "bigint", "r": "double", "mixed": "bigint"}
    rows = df.collect()
    assert len(rows) == 4
    last = next(r for r in rows if r.file_id == 2)
    assert (last.n, last.r, last.mixed) == (4, 0.5, None) and [(x.field, x.raw_type, x.value) for x in last.failed] == [("mixed", "string", '"x"')]
    first = min(rows, key=lambda r: (r.file_id, r.rec_no))
    assert [(x.name, x.value) for x in first.extras] == [("extras", "0"), ("void", "null")]
