"""Schemas that drift between files: one typed table of all records, and every change of a field.

Records become path-value maps with raw JSON types; statistics per file and path say which field appears, vanishes,
changes its name or its type; typed columns are then projected and failed casts reported.

Defined cases: rows without feed or seq_no belong to no feed and are left out; a body that is null, empty or no JSON
has no records (its file then has no fields); a record that is no JSON object has no fields; of a member that occurs
twice in an object the last counts; a record without `key` is compared with none; repeated rows of a file count once;
several equal candidates for a rename are paired in the order of their names; of several members of a record with one first name the typed column
takes the first and the others stay in `extras`; objects and arrays are JSON text in a string column; a field named like a column of the table (file_id, feed, seq_no,
rec_no, record_key, extras, failed) stays in `extras`; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.carry import carry_last
from skein.session import stage

#: Positions of a feed that one task looks through at once.
BLOCK = 1024
#: Up to so many files to be read again are sent as ids to the tasks that read.
SENT_FILES = 500_000
#: Up to so many files get their names sent to the tasks that read the bodies.
SENT_NAMES = 50_000
#: Most typed columns that are derived; fields beyond, the rarest, stay in `extras` with all their values.
MOST_COLUMNS = 500
#: Column types of the JSON types.
CASTS = {"integer": "bigint", "fraction": "double", "string": "string", "boolean": "boolean", "object": "string", "array": "string"}


def kept_files(files: DataFrame) -> DataFrame:
    """(file_id, feed, seq_no, prev_id): of each position the copy with the smallest file_id, and the file before it."""
    kept = files.filter(F.col("feed").isNotNull() & F.col("seq_no").isNotNull()).groupBy("feed", "seq_no").agg(F.min("file_id").alias("file_id"))
    return carry_last(kept, ["feed"], ["seq_no"], "file_id", "prev_id", F.floor(F.col("seq_no") / BLOCK))


def json_type(v: Column) -> Column:
    """JSON type of a variant: integer, fraction, string, boolean, object, array; null for null."""
    t = F.schema_of_variant(v)
    digits = F.regexp_extract(t, r"^DECIMAL\((\d+),0\)", 1).try_cast("int")
    return (
        F.when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean")
        .when((t == "BIGINT") | (digits > 18), "integer").when(t != "VOID", "fraction")
    )


def records(files: DataFrame) -> DataFrame:
    """(file_id, rec_no, rec): the JSON text of each record; the other columns of `files` but fmt and body stay."""
    body = F.regexp_replace("body", "^﻿", "")
    lines = F.filter(F.split(body, r"\r?\n"), lambda x: F.trim(x) != "")
    array = F.from_json(body, "array<string>")
    return files.select(*[c for c in files.columns if c not in ("fmt", "body")], F.posexplode(F.when(F.col("fmt") == "jsonl", lines).otherwise(array)).alias("rec_no", "rec"))


def path_values(recs: DataFrame, depth: int = 1) -> DataFrame:
    """One row per record and path: key, path, raw_type and value (JSON text); objects are opened down to `depth`."""
    first = recs.withColumn("fields", F.from_json("rec", "map<string,variant>"))
    keep = [c for c in recs.columns if c != "rec"]
    key = F.to_json(F.try_element_at("fields", F.lit("key")))
    level = first.select(*keep, key.alias("key"), F.explode("fields").alias("path", "v"))
    out = None
    for d in range(depth):
        flat = level.select(*keep, "key", "path", json_type(F.col("v")).alias("raw_type"), F.to_json("v").alias("value"))
        out = flat if out is None else out.unionByName(flat)
        if d + 1 < depth:
            inner = level.filter(json_type(F.col("v")) == "object").select(*keep, "key", F.col("path").alias("up"), F.explode(F.col("v").cast("map<string,variant>")).alias("name", "v"))
            level = inner.select(*keep, "key", F.concat_ws(".", "up", "name").alias("path"), "v")
    return out


def field_stats(values: DataFrame) -> DataFrame:
    """Per file and path: records that have it, nulls, and its raw types."""
    return values.groupBy("file_id", "path").agg(
        F.count("*").alias("n"), F.count_if(F.col("raw_type").isNull()).alias("n_null"), F.concat_ws("|", F.array_sort(F.collect_set("raw_type"))).alias("types")
    )


def _signature(side: DataFrame) -> DataFrame:
    """Per file and field: an order-free hash of what the common records hold."""
    rows = side.select("at", "path", "key", "value").distinct()
    h = F.xxhash64("key", "value")
    return rows.groupBy("at", "path").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x1"), F.bit_xor(F.xxhash64("value", "key", F.lit(7))).alias("x2"), F.count_if(F.col("value") != "null").alias("held"))


def changes(files: DataFrame) -> DataFrame:
    """(feed, seq_no, file_id, field, change_kind, new_field): every added, removed, renamed or retyped field.

    A rename needs a record that both files hold and in which the field has a value. The statistics (one row per file
    and field) are staged; only files that lose one field and gain another are read again for the rename test.
    """
    kept = stage(kept_files(files), "drift-files")
    whole = files.select("file_id", "fmt", "body")
    # Statistics combine where the bodies are read: one narrow row per file and field is all that is shuffled.
    stats = stage(field_stats(path_values(records(whole))).join(kept.drop("prev_id"), "file_id"), "drift-stats")
    here = stats.select("file_id", "path")
    with_prev = kept.filter(F.col("prev_id").isNotNull())
    before = with_prev.select(F.col("file_id").alias("at"), F.col("prev_id").alias("file_id")).join(here, "file_id").select(F.col("at").alias("file_id"), "path")
    new = with_prev.select("file_id").join(here, "file_id").join(before, ["file_id", "path"], "left_anti")
    gone = before.join(here, ["file_id", "path"], "left_anti")
    both = stage(new.withColumn("gone", F.lit(False)).unionByName(gone.withColumn("gone", F.lit(True))), "drift-moves")

    sides = both.groupBy("file_id").agg(F.count_if("gone").alias("g"), F.count_if(~F.col("gone")).alias("n")).filter("g > 0 and n > 0").select("file_id")
    cand = stage(with_prev.join(sides, "file_id").select("file_id", "prev_id"), "drift-candidates")
    ids = cand.select(F.col("file_id").alias("file_id"), F.col("file_id").alias("at")).unionByName(cand.select(F.col("prev_id").alias("file_id"), F.col("file_id").alias("at")))
    wanted = ids.select("file_id").distinct()
    if cand.count() <= SENT_FILES:
        wanted = F.broadcast(wanted)  # at most twice SENT_FILES ids; beyond that the bodies are joined by a shuffle
    again = stage(path_values(records(whole.join(wanted, "file_id", "left_semi"))).filter(F.col("key").isNotNull()).select("file_id", "key", "path", "value"), "drift-again")
    cur = cand.select(F.col("file_id").alias("at"), "file_id").join(again, "file_id")
    prev = cand.select(F.col("file_id").alias("at"), F.col("prev_id").alias("file_id")).join(again, "file_id")
    moved = both.select(F.col("file_id").alias("at"), "path", "gone")
    old_side = prev.join(moved.filter("gone"), ["at", "path"], "left_semi").join(cur.select("at", "key").distinct(), ["at", "key"], "left_semi")
    new_side = cur.join(moved.filter("not gone"), ["at", "path"], "left_semi").join(prev.select("at", "key").distinct(), ["at", "key"], "left_semi")
    rank = "row_number() over (partition by at, n, x1, x2 order by path)"
    a, b = (_signature(s).filter("held > 0").withColumn("rank", F.expr(rank)) for s in (old_side, new_side))
    renames = stage(
        a.select("at", "n", "x1", "x2", "rank", F.col("path").alias("old")).join(b.select("at", "n", "x1", "x2", "rank", F.col("path").alias("new")), ["at", "n", "x1", "x2", "rank"]).select(F.col("at").alias("file_id"), "old", "new"),
        "drift-renames",
    )
    olds, news = renames.select("file_id", F.col("old").alias("path")), renames.select("file_id", F.col("new").alias("path"))
    removed = both.filter("gone").join(olds, ["file_id", "path"], "left_anti")
    added = both.filter("not gone").join(news, ["file_id", "path"], "left_anti")

    # A field's type before a file; a renamed field brings the type of its old name along.
    typed = stats.select("feed", "seq_no", "file_id", "path", F.nullif("types", F.lit("")).alias("type"))
    block = F.floor(F.col("seq_no") / BLOCK)
    hist = carry_last(typed, ["feed", "path"], ["seq_no"], "type", "prev_type", block).withColumn("known", F.coalesce("type", "prev_type"))
    ref = kept.select("feed", "seq_no", "file_id", "prev_id")
    brought = renames.join(ref, "file_id").select("feed", "seq_no", F.col("prev_id").alias("file_id"), F.col("old").alias("path"), "new").join(hist.select("file_id", "path", "known"), ["file_id", "path"])
    rows = typed.withColumn("step", F.lit(1)).unionByName(brought.select("feed", "seq_no", F.lit(None).cast("bigint").alias("file_id"), F.col("new").alias("path"), F.col("known").alias("type"), F.lit(0).alias("step")))
    retyped = carry_last(rows, ["feed", "path"], ["seq_no", "step"], "type", "prev_type", block).filter("file_id is not null and type <> prev_type")
    none = F.lit("")
    out = (
        removed.select("file_id", F.col("path").alias("field"), F.lit("removed").alias("change_kind"), none.alias("new_field"))
        .unionByName(added.select("file_id", F.col("path").alias("field"), F.lit("added").alias("change_kind"), none.alias("new_field")))
        .unionByName(renames.select("file_id", F.col("old").alias("field"), F.lit("renamed").alias("change_kind"), F.col("new").alias("new_field")))
        .unionByName(retyped.select("file_id", F.col("path").alias("field"), F.lit("retyped").alias("change_kind"), none.alias("new_field")))
    )
    return out.join(ref.select("file_id", "feed", "seq_no"), "file_id").select("feed", "seq_no", "file_id", "field", "change_kind", "new_field")


def first_names(renames: DataFrame) -> DataFrame:
    """(feed, seq_no, path, root): for each rename the name that the field had first, by pointer doubling over the renames of a feed."""
    edges = renames.select("feed", "seq_no", F.col("field").alias("old"), F.col("new_field").alias("path"))
    block = F.floor(F.col("seq_no") / BLOCK)
    # The rename that gave `old` its name: the last one to it before this one.
    looked = edges.select("feed", "seq_no", F.col("path"), F.lit(0).alias("ask"), F.col("seq_no").alias("ev")).unionByName(edges.select("feed", "seq_no", F.col("old").alias("path"), F.lit(1).alias("ask"), F.lit(None).cast(edges.schema["seq_no"].dataType).alias("ev")))
    looked = carry_last(looked, ["feed", "path"], ["seq_no", "ask"], "ev", "up_seq", block).filter("ask = 1").select("feed", "seq_no", F.col("path").alias("old"), "up_seq").distinct()
    now = edges.join(looked, ["feed", "seq_no", "old"], "left").select("feed", "seq_no", "path", F.col("old").alias("root"), "up_seq")
    while True:
        now = stage(now, "drift-names")
        if now.filter(F.col("up_seq").isNotNull()).isEmpty():
            return now.select("feed", "seq_no", "path", "root")
        up = now.select("feed", F.col("seq_no").alias("up_seq"), F.col("path").alias("root"), F.col("root").alias("root2"), F.col("up_seq").alias("up2"))
        now = now.join(up, ["feed", "up_seq", "root"], "left").select("feed", "seq_no", "path", F.coalesce("root2", "root").alias("root"), F.col("up2").alias("up_seq"))


def target_types(stats: DataFrame, names: DataFrame) -> dict[str, str]:
    """Typed columns by the statistics per file and path: for each first name the JSON type that most records have.

    Integers and fractions together are fractions; of equally frequent types the first in order counts; a field with
    nulls only has none and stays in `extras`. At most MOST_COLUMNS rows come to the driver.
    """
    rows = stats.filter("types <> '' and path <> 'key'").join(names, ["feed", "seq_no", "path"], "left")
    rows = rows.select(F.coalesce("name", "path").alias("name"), F.explode(F.split("types", r"\|")).alias("type"), "n")
    per = rows.groupBy("name", "type").agg(F.sum("n").alias("n"))
    best = per.groupBy("name").agg(F.sum("n").alias("all"), F.max(F.struct("n", F.col("type"))).alias("x"), F.min(F.when(F.col("type").isin("integer", "fraction"), F.col("type"))).alias("low"))
    kind = F.when(F.col("x.type").isin("integer", "fraction") & (F.col("low") == "fraction"), "fraction").otherwise(F.col("x.type"))
    few = best.filter(~F.lower("name").isin("file_id", "feed", "seq_no", "rec_no", "record_key", "extras", "failed")).select("name", kind.alias("type"), "all").orderBy(F.desc("all"), "name").limit(MOST_COLUMNS).collect()
    return {r["name"]: CASTS[r["type"]] for r in sorted(few, key=lambda r: r["name"])}


def _once(files: DataFrame) -> DataFrame:
    """(file_id, fmt, body) with each file once; only bodies of ids that repeat are shuffled."""
    whole = files.select("file_id", "fmt", "body")
    again = stage(files.groupBy("file_id").agg(F.count("*").alias("k")).filter("k > 1").select("file_id"), "drift-repeated")
    if again.isEmpty():
        return whole
    return whole.join(again, "file_id", "left_anti").unionByName(whole.join(again, "file_id", "left_semi").dropDuplicates(["file_id"]))


def _member(by: str, value: str) -> Column:
    """The first member of the column f whose `by` is the value."""
    return F.try_element_at(F.filter("f", lambda e: e[by] == value), F.lit(1))


def consistent(files: DataFrame, target: dict[str, str] | None = None, found: DataFrame | None = None) -> DataFrame:
    """One row per record of the kept files: typed columns under each field's first name, `extras`, and `failed` casts.

    The columns are those of `target`, else derived from the statistics of all files. Each file gets a map from its
    fields' names to their first names; records are then projected row by row.
    """
    found = stage(changes(files), "drift-changes") if found is None else found
    roots = first_names(found.filter("change_kind = 'renamed'"))
    kept = kept_files(files).drop("prev_id")
    # Which name a field has in a file: asked per file of a feed and renamed field, answered by the last rename before.
    renamed = roots.select("feed", "path").distinct()
    asked = kept.join(renamed, "feed").select("feed", "seq_no", "path", F.lit(None).cast("string").alias("root"), F.lit(1).alias("ask"))
    names = carry_last(asked.unionByName(roots.withColumn("ask", F.lit(0))), ["feed", "path"], ["seq_no", "ask"], "root", "name", F.floor(F.col("seq_no") / BLOCK))
    names = stage(names.filter("ask = 1 and name is not null").select("feed", "seq_no", "path", "name"), "drift-first-names")
    if target is None:
        stats = field_stats(path_values(records(files.select("file_id", "fmt", "body"))))
        target = target_types(stats.join(kept, "file_id"), names)
    per_file = kept.join(names.groupBy("feed", "seq_no").agg(F.map_from_entries(F.collect_list(F.struct("path", "name"))).alias("names")), ["feed", "seq_no"], "left")
    per_file = stage(per_file, "drift-names")
    if per_file.count() <= SENT_NAMES:
        per_file = F.broadcast(per_file)  # at most SENT_NAMES files, with the names of their renamed fields
    whole = _once(files).join(per_file, "file_id")
    fields = F.map_entries(F.from_json("rec", "map<string,variant>"))
    # In steps, each of which is used several times by the next, so that nothing is worked out twice.
    rows = records(whole).withColumn("f", F.transform(fields, lambda e: F.struct(F.coalesce(F.try_element_at("names", e["key"]), e["key"]).alias("name"), e["key"].alias("path"), json_type(e["value"]).alias("type"), F.to_json(e["value"]).alias("value"))))
    at = {c: f"__x{i}" for i, c in enumerate(target)}
    rows = rows.filter("f is not null").select("file_id", "feed", "seq_no", "rec_no", "f", *[_member("name", c).alias(x) for c, x in at.items()])
    columns, fails = [], []
    for c, t in target.items():
        x = F.col(at[c])
        text = F.when(x["type"] == "string", F.get_json_object(F.concat(F.lit('{"v":'), x["value"], F.lit("}")), "$.v"))
        text = text.when(x["type"].isNotNull() & (F.lit(t == "string") | ~x["type"].isin("object", "array")), x["value"])
        columns.append(text.try_cast(t).alias(c))
        fails.append((c, t))
    typed = rows.select("file_id", "feed", "seq_no", "rec_no", "f", *[F.col(x) for x in at.values()], *columns)
    lost = [F.when(F.col(at[c])["type"].isNotNull() & F.col(f"`{c}`").isNull(), F.struct(F.lit(c).alias("field"), F.col(at[c])["path"].alias("source_field"), F.col(at[c])["type"].alias("raw_type"), F.col(at[c])["value"].alias("value"), F.lit(t).alias("target"))) for c, t in fails]
    nothing = F.lit(None).cast("struct<field:string,source_field:string,raw_type:string,value:string,target:string>")
    # By path, not by name: of several fields with one first name a column takes one, and the others stay here.
    taken = F.array(F.lit("key"), *[F.coalesce(F.col(x)["path"], F.lit("key")) for x in at.values()])
    extras = F.transform(F.filter("f", lambda e: ~F.array_contains(taken, e["path"])), lambda e: F.struct(e["name"].alias("name"), e["type"].alias("type"), e["value"].alias("value")))
    key = _member("path", "key")["value"]
    return typed.select("file_id", "feed", "seq_no", "rec_no", key.alias("record_key"), *[F.col(f"`{c}`") for c in target], F.array_sort(extras).alias("extras"), F.filter(F.array(nothing, *lost), lambda x: x.isNotNull()).alias("failed"))
