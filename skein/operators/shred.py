"""Deeply nested records as flat tables: adjacency-table shredding of JSON Schemas.

`adjacency` stores each JSON node as (node, parent, label, ordinal, kind, scalar); schema nodes also carry their path.
`schema_nodes` joins the object nodes with their scalar children and pivots them into one row per schema node.
`nodes` and `entity_table` do the same for any nested record: every JSON node with its parent and the kind of thing it
belongs to, and from these one flat table per kind, each row with its own key and that of the row above it.

Defined cases: null, empty, cut-off or other text that is no JSON has no nodes; a schema stored as a JSON string is
read as what it spells, however often; of a repeated member the last counts; a root that is no object is a node
without children; null ids are kept; equal rows give equal nodes once; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAPS, LISTS = ("properties", "$defs", "definitions"), ("anyOf", "oneOf", "allOf")
ADJACENCY = "tool_id bigint, side string, doc bigint, node int, parent int, label string, ordinal int, kind string, scalar string, owner int, level int, parent_label string, parent_kind string, node_path string, parent_path string"
_KIND = {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "fraction", type(None): "null"}


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _loads(text: str):  # noqa: ANN202
    """JSON without NaN and Infinity. Texts nested too deep for the built-in scanner are read with an explicit stack."""
    try:
        return json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        return _loads_deep(text)


def _loads_deep(text: str):  # noqa: ANN202
    flat = json.JSONDecoder(parse_constant=_no_constant)
    ws = json.decoder.WHITESPACE.match
    stack: list = []
    root: list = []
    i = ws(text, 0).end()
    put, state = root.append, "value"
    while True:
        ch = text[i : i + 1]
        if state == "value" or (state == "first" and not (stack and isinstance(stack[-1], list) and ch == "]")):
            if ch in "{[" and ch:
                new: dict | list = {} if ch == "{" else []
                put(new)
                stack.append(new)
                i = ws(text, i + 1).end()
                if ch == "{":
                    state = "key"
                else:
                    put, state = new.append, "first"
                continue
            if not ch:
                raise ValueError("cut off")
            value, i = flat.raw_decode(text, i)
            put(value)
            i = ws(text, i).end()
            state = "after"
        elif state == "key":
            top = stack[-1]
            if ch == "}" and not top:
                stack.pop()
                i = ws(text, i + 1).end()
                state = "after"
                continue
            if ch != '"':
                raise ValueError("name expected")
            name, i = flat.raw_decode(text, i)
            i = ws(text, i).end()
            if text[i : i + 1] != ":":
                raise ValueError("colon expected")
            i = ws(text, i + 1).end()

            def put(value, top=top, name=name):  # noqa: ANN001, ANN202
                top[name] = value

            state = "value"
        else:  # after a value, or an empty array
            if not stack:
                if i != len(text):
                    raise ValueError("text after the end")
                return root[0]
            top = stack[-1]
            end = "}" if isinstance(top, dict) else "]"
            if ch == end:
                stack.pop()
                i = ws(text, i + 1).end()
                state = "after"
            elif ch == "," and state == "after":
                i = ws(text, i + 1).end()
                if isinstance(top, dict):
                    state = "key"
                    if text[i : i + 1] == "}":
                        raise ValueError("name expected")
                else:
                    put, state = top.append, "value"
            else:
                raise ValueError("comma expected")


def parse_schema(text: str | None):  # noqa: ANN202
    """(True, value) of a schema text, strings opened; (False, None) if it is no JSON."""
    try:
        value = _loads(text)
        while isinstance(value, str):
            value = _loads(value)
        return True, value
    except (ValueError, TypeError):
        return False, None


def shred(value) -> Iterator[tuple]:  # noqa: ANN001
    """(node, parent, label, ordinal, kind, scalar, owner, level, parent_label, parent_kind, node_path, parent_path) of
    every JSON node, parents first.

    Schema nodes have a path; the others have none and lie `level` steps below the schema node `owner`.
    """
    todo: list[tuple] = [(value, None, None, 0, None, 0, None, None, ("#", ""), "schema")]
    n = 0
    while todo:
        v, parent, label, ordinal, owner, level, up_label, up_kind, path, role = todo.pop()
        me, n = n, n + 1
        kind = _KIND[type(v)]
        if role == "schema":
            owner, level = me, 0
        scalar = v if kind == "string" else None if kind in ("object", "array") else json.dumps(v)
        yield me, parent, label, ordinal, kind, scalar, owner, level, up_label, up_kind, *(path if role == "schema" else (None, None))
        items = list(v.items()) if kind == "object" else list(enumerate(v)) if kind == "array" else []
        for i, (name, x) in reversed(list(enumerate(items))):
            child, new = "value", None
            if role == "schema" and kind == "object":
                if name in MAPS and isinstance(x, dict):
                    child = "schemas"
                elif name == "items":
                    child = "schemas" if isinstance(x, list) else "schema"
                elif name in LISTS and isinstance(x, list):
                    child = "schemas"
                elif name == "additionalProperties" and isinstance(x, dict):
                    child = "schema"
                new = (f"{path[0]}/{name}", path[0])
            elif role == "schemas":
                step = str(name).replace("~", "~0").replace("/", "~1")
                child, new = "schema", (f"{path[0]}/{step}", path[1])
            todo.append((x, me, str(name), i, owner, level + 1, label, kind, new, child))


def adjacency(tools: DataFrame) -> DataFrame:
    """The adjacency table of input_schema and output_schema."""
    sides = tools.select("tool_id", F.explode(F.array(F.struct(F.lit("input").alias("side"), F.col("input_schema").alias("t")), F.struct(F.lit("output").alias("side"), F.col("output_schema").alias("t")))).alias("x")).filter("x.t is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
        names = [x.split()[0] for x in ADJACENCY.split(", ")]
        for b in batches:
            rows: list[tuple] = []
            for tool, side, text, doc in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                ok, value = parse_schema(text)
                for r in shred(value) if ok else ():
                    rows.append((tool, side, doc, *r))
                    if len(rows) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return sides.select(F.col("tool_id").cast("bigint"), "x.side", "x.t", F.xxhash64("x.t").alias("doc")).mapInArrow(run, ADJACENCY)


def schema_nodes(tools: DataFrame) -> DataFrame:
    """(tool_id, side, node_path, parent_path, node_type): one row per schema node.

    Object nodes meet their scalar children in one aggregation by owner: the child `type`, or the strings of an array
    `type` in their order, becomes a column of the node.
    """
    word = (F.col("kind") == "string") & F.col("node_path").isNull()
    one = word & (F.col("level") == 1) & (F.col("label") == "type")
    many = word & (F.col("level") == 2) & (F.col("parent_label") == "type") & (F.col("parent_kind") == "array")
    rows = adjacency(tools).filter(F.col("node_path").isNotNull() | one | many)
    nodes = rows.groupBy("tool_id", "side", "doc", "owner").agg(
        F.max("node_path").alias("node_path"), F.max("parent_path").alias("parent_path"), F.max(F.when(one, F.col("scalar"))).alias("t1"),
        F.array_sort(F.collect_set(F.when(many, F.struct("ordinal", "scalar")))).alias("tn"),
    )
    kind = F.coalesce("t1", F.array_join(F.transform("tn", lambda x: x["scalar"]), "|"))
    return nodes.select("tool_id", "side", "node_path", "parent_path", kind.alias("node_type"))


NODES = "node int, parent int, label string, ordinal int, kind string, scalar string, entity string, above int"


def walk(value) -> Iterator[tuple]:  # noqa: ANN001
    """(node, parent, label, ordinal, kind, scalar, entity, above) of every JSON node, parents first.

    `entity` is the way from the root without positions: names behind `/` (`~` and `/` written `~0` and `~1`), `[]` for
    any element. `above` is the nearest object that encloses the node, null for the root.
    """
    todo: list[tuple] = [(value, None, "", 0, "", None)]
    n = 0
    while todo:
        v, parent, label, ordinal, entity, above = todo.pop()
        me, n = n, n + 1
        kind = _KIND[type(v)]
        yield me, parent, label, ordinal, kind, v if kind == "string" else None if kind in ("object", "array") else json.dumps(v), entity, above
        items = list(v.items()) if kind == "object" else list(enumerate(v)) if kind == "array" else []
        inside = me if kind == "object" else above
        for i, (name, x) in reversed(list(enumerate(items))):
            step = "/" + str(name).replace("~", "~0").replace("/", "~1") if kind == "object" else "/[]"
            todo.append((x, me, str(name), i, entity + step, inside))


def nodes(records: DataFrame, key: str, text: str) -> DataFrame:
    """(key, doc, node, parent, label, ordinal, kind, scalar, entity, above): the adjacency table of JSON texts.

    `doc` tells the texts of one key apart; texts that are no JSON have no nodes; rows that repeat give repeated rows.
    """
    head = records.schema[key].dataType.simpleString()
    names = [x.split()[0] for x in NODES.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first = b.schema.field(0).type
            rows: list[tuple] = []

            def flush(rows: list[tuple], first: pa.DataType = first) -> pa.RecordBatch:
                cols = list(zip(*rows, strict=True)) or [()] * (2 + len(names))
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [first, pa.int64(), *kinds], strict=True)], names=[key, "doc", *names])

            for k, t, doc in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                ok, value = parse_schema(t)
                for r in walk(value) if ok else ():
                    rows.append((k, doc, *r))
                    if len(rows) >= 20_000:
                        yield flush(rows)
                        rows = []
            if rows:
                yield flush(rows)

    return records.filter(F.col(text).isNotNull()).select(key, text, F.xxhash64(text).alias("__doc")).mapInArrow(run, f"`{key}` {head}, doc bigint, {NODES}")


def entity_table(adjacency_: DataFrame, key: str, entity: str, columns: list[str]) -> DataFrame:
    """(key, doc, node, above, entity, label, ordinal, columns…): one flat row per object whose `entity` matches the pattern.

    The objects are joined with their scalar children, which become the columns `c_<label>` (JSON null is null). `above` is the `node` of the row of the table above it, so that tables join on (key, doc, above = node).
    """
    objects = adjacency_.filter((F.col("kind") == "object") & F.col("entity").rlike(entity)).select(key, "doc", "node", "above", "entity", "label", "ordinal")
    wanted = adjacency_.filter(F.col("label").isin(columns) & ~F.col("kind").isin("object", "array", "null")).select(F.col(key).alias("__k"), F.col("doc").alias("__d"), F.col("parent").alias("__n"), F.col("label").alias("__l"), "scalar")
    met = objects.join(wanted, F.col(key).eqNullSafe(F.col("__k")) & (F.col("doc") == F.col("__d")) & (F.col("node") == F.col("__n")), "left")
    own = [key, "doc", "node", "above", "entity", "label", "ordinal"]
    return met.groupBy(*own).agg(*[F.max(F.when(F.col("__l") == c, F.col("scalar"))).alias(f"c_{c}") for c in columns])
