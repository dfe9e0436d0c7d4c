"""What changed between full snapshots, by subtracting invertible Bloom lookup tables.

Every entry of a snapshot is reduced to a hash of its key and a hash of its compared content. A pair of consecutive
snapshots is cut into buckets by the key hash; each bucket holds a table of cells (count, XOR of key hashes, XOR of
content hashes, XOR of check hashes) in which an entry is put into one cell of each of three parts. The two tables of
a pair are subtracted by adding the counts of one side and XORing all the rest, so equal entries cancel out and only
sums over cells are shuffled. Pure cells are then peeled. A bucket that does not peel, or whose recovered entries do
not reproduce its digest, is enlarged and built again; recovered hashes are joined back to the entries to get keys.

Defined cases: a repeated entry_key counts in its row with the latest received_at (nulls first, ties by content); rows
without report_id or entry_key and entries whose report is unknown are left out; a report repeated as a row counts
once; reports without scanned_at come first; equal times are ordered by report_id; the first snapshot of a lock file
gives no rows (or all its entries as added, a parameter); null and empty collections are the same, null and ''
versions are not; text that is no JSON is compared as text; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.carry import carry_last
from skein.session import stage

#: Entries of a snapshot that share a bucket, on average.
BUCKET = 64
#: Differences per bucket that the first table allows for, besides those that the counts prove.
SLACK = 6
#: Snapshots of more entries than this are joined in SALTS parts.
SPLIT, SALTS = 1_000_000, 64
#: Tables are doubled so often; buckets that still fail are compared directly.
ROUNDS = 6


def plain_hash(c: Column) -> Column:
    """A hash without letter case and without an algorithm prefix."""
    return F.regexp_replace(F.lower(F.trim(c)), r"^(?:[a-z][a-z0-9_\-]*[:=]|sha-?[0-9]+-|md5-)\s*", "")


def json_value(c: Column) -> Column:
    """JSON text in one writing; text that is no JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(c)), c)


def content_hash64() -> Column:
    """Hash of the compared fields of a lock entry."""
    empty_map = F.coalesce(F.map_entries("skill_files"), F.array())
    skills = F.array_sort(F.transform(empty_map, lambda x: F.struct(x["key"].alias("k"), plain_hash(x["value"]).alias("v"))))
    tools = F.array_sort(F.transform(F.coalesce(F.map_entries("tools"), F.array()), lambda x: F.struct(x["key"].alias("k"), plain_hash(x["value"]["hash"]).alias("h"), json_value(x["value"]["definition"]).alias("d"))))
    labels = F.array_sort(F.array_distinct(F.coalesce("capability_labels", F.array())))
    return F.xxhash64(F.to_json(F.struct(F.col("entry_version").alias("a"), plain_hash(F.col("content_hash")).alias("b"), skills.alias("c"), tools.alias("d"), labels.alias("e")), {"ignoreNullFields": "false"}))


def entry_hashes(entries: DataFrame, content: Column | None = None) -> DataFrame:
    """(report_id, entry_key, kh, vh): one row per entry of a snapshot; corrected rows replace earlier ones."""
    vh = content_hash64() if content is None else content
    rows = entries.filter(F.col("report_id").isNotNull() & F.col("entry_key").isNotNull()).select("report_id", "entry_key", "received_at", vh.alias("vh"))
    return rows.groupBy("report_id", "entry_key").agg(F.max(F.struct("received_at", "vh"))["vh"].alias("vh")).select("report_id", "entry_key", F.xxhash64("entry_key").alias("kh"), "vh")


def consecutive(reports: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(report_id, prev_report): each report of a lock file and the one before it; with `counts` (report_id, n) also their numbers of entries, as n and n_prev."""
    block = F.coalesce(F.floor(F.unix_seconds(F.col("scanned_at").cast("timestamp")) / (86400 * 30)), F.lit(-(1 << 40)))
    once = reports.filter(F.col("report_id").isNotNull()).groupBy("report_id").agg(F.min(F.struct("scanned_at", "locator", "lock_path")).alias("x")).select("report_id", "x.*")
    if counts is None:
        return carry_last(once, ["locator", "lock_path"], ["scanned_at", "report_id"], "report_id", "prev_report", block).select("report_id", "prev_report")
    once = once.join(counts, "report_id", "left").na.fill(0, ["n"]).withColumn("me", F.struct("report_id", "n"))
    prev = carry_last(once, ["locator", "lock_path"], ["scanned_at", "report_id"], "me", "before", block)
    return prev.select("report_id", "n", F.col("before.report_id").alias("prev_report"), F.coalesce("before.n", F.lit(0).cast("bigint")).alias("n_prev"))


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xx64(values: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """xxHash64 of 8-byte values, equal to Spark's xxhash64 of a bigint."""
    h = seed + _P5 + np.uint64(8)
    h = h ^ (_rotl(values * _P2, 31) * _P1)
    h = _rotl(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def check_hash(kh: np.ndarray, vh: np.ndarray, salt: int) -> np.ndarray:
    seed = np.full(kh.shape, 42, np.uint64)
    return xx64(np.full(kh.shape, salt, np.uint64), xx64(vh, xx64(kh, seed)))


PEELED = "pair bigint, bucket bigint, side int, kh bigint, vh bigint, failed boolean"


def peel(batches: Iterator[pa.RecordBatch], salt: int) -> Iterator[pa.RecordBatch]:
    """Rows (pair, bucket, part, cells, digest): all buckets of a batch are peeled at the same time, pass by pass.

    Gives one row per recovered entry (side 1: only in the later snapshot, -1: only in the earlier), or one failed row.
    """
    with np.errstate(over="ignore"):
        for b in batches:
            if not b.num_rows:
                continue
            pair, bucket, part = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            digest = b.column(4).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            part = part.astype(np.int64)
            lists = b.column(3)
            n = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, int)
            flat = lists.flatten()
            slot, cnt, k, v, c = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5))
            start = np.concatenate([[0], np.cumsum(part * 3)])
            size = int(start[-1])
            group = np.repeat(np.arange(b.num_rows), n)
            at = start[group] + slot
            C = np.zeros(size, np.int64)
            K, V, H = (np.zeros(size, np.uint64) for _ in range(3))
            C[at], K[at], V[at], H[at] = cnt, k.view(np.uint64), v.view(np.uint64), c.view(np.uint64)
            owner = np.repeat(np.arange(b.num_rows), part * 3)
            got = []
            look = np.unique(at)
            # A recovered entry empties a cell, so a bucket yields at most as many as it has cells; more is no valid table.
            left = part * 3
            while len(look):
                pure = look[np.abs(C[look]) == 1]
                pure = pure[H[pure] == check_hash(K[pure], V[pure], salt)]
                pure = pure[left[owner[pure]] > 0]
                if not len(pure):
                    break
                item = np.stack([owner[pure].astype(np.uint64), K[pure], V[pure], C[pure].view(np.uint64)], 1)
                item = np.unique(item, axis=0)
                o, ik, iv, s = item[:, 0].astype(np.int64), item[:, 1], item[:, 2], item[:, 3].view(np.int64)
                ih = check_hash(ik, iv, salt)
                np.subtract.at(left, o, 1)
                touched = []
                for i in range(3):
                    p = start[o] + i * part[o] + ((ih >> np.uint64(20 * i)) & np.uint64(0xFFFFF)).astype(np.int64) % part[o]
                    np.subtract.at(C, p, s)
                    np.bitwise_xor.at(K, p, ik)
                    np.bitwise_xor.at(V, p, iv)
                    np.bitwise_xor.at(H, p, ih)
                    touched.append(p)
                got.append((o, ik, iv, s))
                look = np.unique(np.concatenate(touched))
            bad = np.zeros(b.num_rows, bool)
            bad[owner[(C != 0) | (K != 0) | (V != 0) | (H != 0)]] = True
            o, ik, iv, s = (np.concatenate([g[i] for g in got]) if got else np.zeros(0, t) for i, t in enumerate((np.int64, np.uint64, np.uint64, np.int64)))
            seen = np.zeros(b.num_rows, np.uint64)
            np.bitwise_xor.at(seen, o, xx64(ik, xx64(iv, np.full(iv.shape, 42, np.uint64))))
            bad |= seen != digest
            ok = ~bad[o]
            f = np.flatnonzero(bad)
            zero = np.zeros(len(f), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([pair[o[ok]], pair[f]]).astype(np.int64)),
                    pa.array(np.concatenate([bucket[o[ok]], bucket[f]]).astype(np.int64)),
                    pa.array(np.concatenate([s[ok], zero]).astype(np.int32)),
                    pa.array(np.concatenate([ik[ok].view(np.int64), zero])),
                    pa.array(np.concatenate([iv[ok].view(np.int64), zero])),
                    pa.array(np.concatenate([np.zeros(int(ok.sum()), bool), np.ones(len(f), bool)])),
                ],
                names=["pair", "bucket", "side", "kh", "vh", "failed"],
            )


def sketch(sides: DataFrame, salt: int) -> DataFrame:
    """(pair, bucket, part, cells, digest) of rows (pair, bucket, part, side, kh, vh): the subtracted tables, without empty cells."""
    check = F.xxhash64("kh", "vh", F.lit(salt).cast("bigint"))
    rows = sides.select("pair", "bucket", "part", "side", "kh", "vh", check.alias("ch"), F.xxhash64("vh", "kh").alias("dh"))
    slots = F.array(*[F.lit(i).cast("bigint") * F.col("part") + F.shiftrightunsigned(F.col("ch"), 20 * i).bitwiseAND(F.lit(0xFFFFF)) % F.col("part") for i in range(3)])
    cells = rows.select("*", F.posexplode(slots).alias("i", "slot"))
    cells = cells.groupBy("pair", "bucket", "part", "slot").agg(
        F.sum("side").alias("n"), F.bit_xor("kh").alias("k"), F.bit_xor("vh").alias("v"), F.bit_xor("ch").alias("c"), F.bit_xor(F.when(F.col("i") == 0, F.col("dh")).otherwise(F.lit(0).cast("bigint"))).alias("d")
    )
    cells = cells.filter("n <> 0 or k <> 0 or v <> 0 or c <> 0 or d <> 0")
    return cells.groupBy("pair", "bucket", "part").agg(F.collect_list(F.struct("slot", "n", "k", "v", "c")).alias("cells"), F.bit_xor("d").alias("d")).select("pair", "bucket", F.col("part").cast("bigint").alias("part"), "cells", "d")


def recovered(sides: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pair, kh, vh, side) of all differences of rows (pair, bucket, part, side, kh, vh)."""
    found, todo = None, sides
    for salt in range(rounds):
        peeled = stage(sketch(todo, salt).mapInArrow(lambda it, s=salt: peel(it, s), PEELED), f"snapshots-peel{salt}")
        good = peeled.filter("not failed").select("pair", "kh", "vh", "side")
        found = good if found is None else found.unionByName(good)
        failed = peeled.filter("failed").select("pair", "bucket").distinct()
        if failed.isEmpty():
            return found
        todo = stage(todo.join(failed, ["pair", "bucket"], "left_semi").withColumn("part", F.col("part") * 2 + 2), f"snapshots-again{salt}")
    rest = todo.groupBy("pair", "kh", "vh").agg(F.sum("side").cast("int").alias("side")).filter("side <> 0")
    return found.unionByName(rest.select("pair", "kh", "vh", "side"))


def sides_of(hashes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, bucket, part, side, kh, vh): each entry once for its own report and once for the next.

    `pairs` are (report_id, n, prev_report, n_prev). Snapshots of more than SPLIT entries are joined in parts, so that
    a lock file that holds most of the rows is many tasks.
    """
    buckets = F.ceil(F.greatest("n", "n_prev", F.lit(1)) / BUCKET)
    proven = F.abs(F.col("n") - F.col("n_prev")) / buckets
    part = F.ceil((proven + 2 * F.sqrt(proven) + SLACK) * 1.5 / 3)
    own = pairs.withColumn("buckets", buckets.cast("bigint")).withColumn("part", part.cast("bigint"))
    both = F.array(F.struct(F.col("report_id").alias("r"), F.lit(1).alias("side"), F.col("n").alias("size")), F.struct(F.col("prev_report").alias("r"), F.lit(-1).alias("side"), F.col("n_prev").alias("size")))
    roles = own.select(F.col("report_id").alias("pair"), "buckets", "part", F.explode(both).alias("x")).select("pair", "buckets", "part", F.col("x.r").alias("report_id"), "x.side", "x.size").filter("report_id is not null and size > 0")
    slim = hashes.select("report_id", "kh", "vh")
    large = roles.filter(F.col("size") > SPLIT)
    met = slim.join(roles.filter(F.col("size") <= SPLIT), "report_id")
    if not large.isEmpty():
        salt = F.pmod(F.xxhash64("kh"), F.lit(SALTS))
        salted = large.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        met = met.select("pair", "buckets", "part", "side", "kh", "vh").unionByName(slim.withColumn("salt", salt).join(salted, ["report_id", "salt"]).select("pair", "buckets", "part", "side", "kh", "vh"))
    return met.select("pair", F.pmod(F.shiftright("kh", 20), F.col("buckets")).alias("bucket"), "part", "side", "kh", "vh")


def changes(entries: DataFrame, reports: DataFrame, content: Column | None = None, first: str = "none") -> DataFrame:
    """(report_id, entry_key, change_kind): what each snapshot adds, removes and changes against the one before.

    `first`: the first snapshot of a lock file has nothing to be compared with and gives no rows (`none`), or counts as
    compared with an empty one, so that all its entries are `added`.
    """
    if first not in ("none", "added"):
        raise ValueError("first must be none or added")
    hashes = stage(entry_hashes(entries, content), "snapshots-hashes")
    pairs = consecutive(reports, hashes.groupBy("report_id").agg(F.count("*").alias("n")))
    pairs = stage(pairs if first == "added" else pairs.filter("prev_report is not null"), "snapshots-pairs")
    diff = recovered(sides_of(hashes, pairs))
    # Recovered hashes get their keys back from the snapshot they come from.
    of = diff.join(pairs.select(F.col("report_id").alias("pair"), "prev_report"), "pair").withColumn("report_id", F.when(F.col("side") == 1, F.col("pair")).otherwise(F.col("prev_report")))
    named = of.select("pair", "report_id", "kh", "vh", "side").join(hashes, ["report_id", "kh", "vh"])
    kind = F.when(F.min("side") == F.max("side"), F.when(F.max("side") == 1, "added").otherwise("removed")).otherwise("changed")
    return named.groupBy("pair", "entry_key").agg(kind.alias("change_kind")).select(F.col("pair").alias("report_id"), "entry_key", "change_kind")
