import random

import pytest
from pyspark.sql import functions as F

from skein.operators import snapshots

ENTRY = "report_id bigint, entry_key string, entry_version string, content_hash string, skill_files map<string,string>, tools map<string,struct<hash:string,definition:string>>, capability_labels array<string>, received_at timestamp, pair int, kh string"
REPORT = "report_id bigint, locator string, lock_path string, scanned_at timestamp, side int"


def run(spark, entries, reports, first="none"):
    e = spark.createDataFrame([(*x, 1, "x") for x in entries], ENTRY)
    r = spark.createDataFrame([(*x, 1) for x in reports], REPORT)
    r = r.withColumn("scanned_at", F.to_timestamp("scanned_at")) if reports else r
    return sorted(tuple(x) for x in snapshots.changes(e, r, first=first).collect())


def ts(n):
    import datetime as dt

    return dt.datetime(2026, 1, 1) + dt.timedelta(hours=n)


def test_normal_forms(spark):
    reports = [(2, "l", "p", ts(2)), (1, "l", "p", ts(1)), (1, "l", "p", ts(1)), (3, "l", "p", ts(3)), (4, "l", "q", ts(3))]
    entries = [
        (1, "a", "1", "ABCD", None, {"t": ("sha256:FF", '{"x":1, "y":[2]}')}, ["p", "q"], ts(1)),
        (1, "b", None, "1", {}, None, None, ts(1)),
        (2, "a", "1", "sha256:abcd", {}, {"t": ("ff", '{"y":[2],"x":1}')}, ["q", "p"], ts(2)),
        (2, "b", None, "2", None, {}, [], ts(2)),
        (2, "b", None, "1", None, {}, [], ts(5)),
        (2, "c", "1", "1", None, None, None, ts(2)),
        (4, "a", "1", "1", None, None, None, None),
        (9, "a", "1", "1", None, None, None, ts(1)),
        (None, "a", "1", "1", None, None, None, ts(1)),
        (2, None, "1", "1", None, None, None, ts(1)),
    ]
    later = [(2, "c", "added"), (3, "a", "removed"), (3, "b", "removed"), (3, "c", "removed")]
    assert run(spark, entries, reports) == later
    assert run(spark, entries, reports, "added") == [(1, "a", "added"), (1, "b", "added"), *later, (4, "a", "added")]


def test_empty(spark):
    assert run(spark, [], []) == []
    assert run(spark, [], [(1, "l", "p", ts(1))]) == []


@pytest.mark.parametrize("split", [snapshots.SPLIT, 150])
def test_random_against_brute_force(spark, monkeypatch, split):
    monkeypatch.setattr(snapshots, "SPLIT", split)
    rng = random.Random(5)
    reports, entries, want = [], [], []
    rid = 0
    for lock in range(6):
        state = {}
        for step in range(5):
            rid += 1
            reports.append((rid, "l", str(lock), ts(step)))
            new = dict(state)
            for _ in range(rng.choice([0, 1, 5, 400 if lock == 0 else 20])):
                k = f"k{rng.randrange(600)}"
                if rng.random() < 0.3:
                    new.pop(k, None)
                else:
                    new[k] = str(rng.randrange(1000))
            want += [(rid, k, "added") for k in new if k not in state] + [(rid, k, "removed") for k in state if k not in new] + [(rid, k, "changed") for k in new if k in state and new[k] != state[k]]
            entries += [(rid, k, v, "h", None, None, None, ts(step)) for k, v in new.items()]
            state = new
    assert run(spark, entries, reports, "added") == sorted(want)
    begin = {min(r[0] for r in reports if r[2] == str(lock)) for lock in range(6)}
    assert run(spark, entries, reports) == sorted(w for w in want if w[0] not in begin)


def test_small_tables_are_enlarged(spark):
    rows = [(1, 0, 1, 1, i * 7919 + 13, i) for i in range(300)] + [(1, 0, 1, -1, i * 7919 + 13, i) for i in range(20, 300)]
    sides = spark.createDataFrame(rows, "pair bigint, bucket bigint, part bigint, side int, kh bigint, vh bigint")
    got = snapshots.recovered(sides).collect()
    assert {(r.vh, r.side) for r in got} == {(i, 1) for i in range(20)}
    rest = snapshots.recovered(sides, rounds=1).collect()
    assert {(r.vh, r.side) for r in rest} == {(i, 1) for i in range(20)}
