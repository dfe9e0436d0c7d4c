"""Queries of the general data problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import drift, shred, snapshots
from skein.session import read, spread


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(read(spark, d, "feed_files", "file_id", "feed", "seq_no", "fmt", "body")).select("file_id", "field", "change_kind", "new_field")


def p1_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.consistent(read(spark, d, "feed_files", "file_id", "feed", "seq_no", "fmt", "body")).drop("failed")


def p1_casts(spark: SparkSession, d: str) -> DataFrame:
    """Every value that the typed column could not take."""
    rows = drift.consistent(read(spark, d, "feed_files", "file_id", "feed", "seq_no", "fmt", "body"))
    return rows.select("file_id", "record_key", F.explode("failed").alias("x")).select("file_id", "record_key", "x.*")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    entries = read(spark, d, "lock_entries", "report_id", "entry_key", "entry_version", "content_hash", "skill_files", "tools", "capability_labels", "received_at")
    return snapshots.changes(entries, read(spark, d, "reports", "report_id", "locator", "lock_path", "scanned_at"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return shred.schema_nodes(spread(read(spark, d, "tools", "tool_id", "input_schema", "output_schema")))


def p5_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return shred.adjacency(spread(read(spark, d, "tools", "tool_id", "input_schema", "output_schema"))).drop("doc")


def p5_parameters(spark: SparkSession, d: str) -> DataFrame:
    """The parameters of every tool as a flat table, each linked to the schema that holds it."""
    adj = shred.nodes(spread(read(spark, d, "tools", "tool_id", "input_schema")), "tool_id", "input_schema")
    rows = shred.entity_table(adj, "tool_id", "^/properties/[^/]+$", ["type", "description", "format"])
    return rows.select("tool_id", "label", F.col("c_type").alias("type"), F.col("c_description").alias("description"), F.col("c_format").alias("format")).distinct()


QUERIES = {"p1_found": p1_found, "p1_table": p1_table, "p1_casts": p1_casts, "p4_found": p4_found, "p5_found": p5_found, "p5_adjacency": p5_adjacency, "p5_parameters": p5_parameters}
SQL: dict[str, str] = {}
SQL["p4_found"] = r"""
with rep as (select distinct report_id, locator, lock_path, scanned_at from reports),
step as (select report_id as now, lag(report_id) over (partition by locator, lock_path order by scanned_at, report_id) as was from rep qualify was is not null),
latest as (select report_id, entry_key, arg_max(struct_pack(v := entry_version, h := content_hash, f := skill_files, t := tools, l := capability_labels), received_at) as e from lock_entries group by all),
plain as (select report_id, entry_key, coalesce(e.v, chr(1)) as v, coalesce(regexp_replace(lower(trim(e.h)), '^(?:[a-z][a-z0-9_\-]*[:=]|sha-?[0-9]+-|md5-)\s*', ''), chr(1)) as h, coalesce(list_sort(list_distinct(e.l)), []) as l, coalesce(map_entries(e.f), []) as f, coalesce(map_entries(e.t), []) as t from latest),
member as (
  select report_id, entry_key, 'version' as what, v as value from plain union all select report_id, entry_key, 'hash', h from plain
  union all select report_id, entry_key, 'label', unnest(l) from plain
  union all select report_id, entry_key, 'file ' || x.key, coalesce(regexp_replace(lower(trim(x.value)), '^(?:[a-z][a-z0-9_\-]*[:=]|sha-?[0-9]+-|md5-)\s*', ''), chr(1)) from (select report_id, entry_key, unnest(f) as x from plain)
  union all select report_id, entry_key, 'tool ' || x.key, coalesce(regexp_replace(lower(trim(x.value.hash)), '^(?:[a-z][a-z0-9_\-]*[:=]|sha-?[0-9]+-|md5-)\s*', ''), chr(1)) from (select report_id, entry_key, unnest(t) as x from plain)
  union all select report_id, entry_key, 'definition ' || x.key || ' ' || j.fullkey || ' ' || j.type, coalesce(j.atom::varchar, '') from (select report_id, entry_key, unnest(t) as x from plain) y, json_tree(y.x.value.definition) j),
cur as (select now, entry_key, what, value from step join member on report_id = now), old as (select now, entry_key, what, value from step join member on report_id = was),
differs as (select now, entry_key from (select * from cur except select * from old) union select now, entry_key from (select * from old except select * from cur))
select d.now as report_id, d.entry_key, case when o.entry_key is null then 'added' when c.entry_key is null then 'removed' else 'changed' end as change_kind
from differs d join step s using (now) left join latest c on c.report_id = s.now and c.entry_key = d.entry_key left join latest o on o.report_id = s.was and o.entry_key = d.entry_key"""
SQL["p5_found"] = """
with recursive raw as (select tool_id, 'input' as side, input_schema as s from tools union all select tool_id, 'output', output_schema from tools),
one as (select tool_id, side, case when json_valid(s) then case when json_type(s) = 'VARCHAR' then s::json->>'$' else s end end as s from raw),
base as (select distinct tool_id, side, s::json as j from one where json_valid(s)),
node(tool_id, side, node_path, parent_path, j) as (
  select tool_id, side, '#', '', j from base
  union all
  select tool_id, side, node_path || '/' || step, node_path, j->('/' || step) from (
    select n.tool_id, n.side, n.node_path, n.j, unnest(list_concat(
      list_concat(list_concat(
        case when json_type(n.j, '/properties') = 'OBJECT' then list_transform(json_keys(n.j, '/properties'), lambda k: 'properties/' || replace(replace(k, '~', '~0'), '/', '~1')) else [] end,
        case when json_type(n.j, '/$defs') = 'OBJECT' then list_transform(json_keys(n.j, '/$defs'), lambda k: '$defs/' || replace(replace(k, '~', '~0'), '/', '~1')) else [] end),
        case when json_type(n.j, '/definitions') = 'OBJECT' then list_transform(json_keys(n.j, '/definitions'), lambda k: 'definitions/' || replace(replace(k, '~', '~0'), '/', '~1')) else [] end),
      list_concat(list_concat(
        case when json_type(n.j, '/items') = 'ARRAY' then list_transform(range(json_array_length(n.j, '/items')::bigint), lambda i: 'items/' || i::varchar) when json_type(n.j, '/items') is not null then ['items'] else [] end,
        case when json_type(n.j, '/additionalProperties') = 'OBJECT' then ['additionalProperties'] else [] end),
        list_concat(list_concat(case when json_type(n.j, '/anyOf') = 'ARRAY' then list_transform(range(json_array_length(n.j, '/anyOf')::bigint), lambda i: 'anyOf/' || i::varchar) else [] end, case when json_type(n.j, '/oneOf') = 'ARRAY' then list_transform(range(json_array_length(n.j, '/oneOf')::bigint), lambda i: 'oneOf/' || i::varchar) else [] end),
          case when json_type(n.j, '/allOf') = 'ARRAY' then list_transform(range(json_array_length(n.j, '/allOf')::bigint), lambda i: 'allOf/' || i::varchar) else [] end)))) as step
    from node n where json_type(n.j) = 'OBJECT'))
select distinct tool_id, side, node_path, parent_path, case json_type(j, '/type') when 'VARCHAR' then j->>'/type' when 'ARRAY' then array_to_string(list_transform(list_filter(range(json_array_length(j, '/type')::bigint), lambda i: json_type(j, '/type/' || i::varchar) = 'VARCHAR'), lambda i: j->>('/type/' || i::varchar)), '|') else '' end as node_type from node"""
SQL["p1_found"] = """
with kept as (select feed, seq_no, min(file_id) as file_id from feed_files where feed is not null and seq_no is not null group by 1, 2),
idx as (select *, lag(file_id) over (partition by feed order by seq_no) as prev_id from kept),
rec as (select k.file_id, unnest(case when f.fmt = 'jsonl' then list_filter(string_split(f.body, chr(10)), lambda x: trim(x) <> '') else from_json(f.body, '["JSON"]')::varchar[] end) as r from kept k join (select distinct file_id, fmt, body from feed_files) f using (file_id)),
pv as (select file_id, r->'$.key' as rk, e.key as path, e.value as value, case when e.type in ('UBIGINT', 'BIGINT', 'HUGEINT') then 'integer' when e.type = 'DOUBLE' then 'fraction' when e.type = 'VARCHAR' then 'string' when e.type = 'BOOLEAN' then 'boolean' when e.type = 'OBJECT' then 'object' when e.type = 'ARRAY' then 'array' end as t from rec, json_each(rec.r::json) e),
st as (select i.feed, i.seq_no, i.file_id, p.path, string_agg(distinct p.t, '|' order by p.t) as t from pv p join idx i using (file_id) group by all),
gone as (select i.file_id, i.prev_id, s.path from idx i join st s on s.file_id = i.prev_id where not exists (select 1 from st x where x.file_id = i.file_id and x.path = s.path)),
fresh as (select i.file_id, i.prev_id, s.path from idx i join st s on s.file_id = i.file_id where i.prev_id is not null and not exists (select 1 from st x where x.file_id = i.prev_id and x.path = s.path)),
common as (select distinct i.file_id, a.rk::varchar as rk from idx i join pv a on a.file_id = i.file_id and a.path = 'key' join pv b on b.file_id = i.prev_id and b.path = 'key' and a.rk::varchar = b.rk::varchar),
gv as (select distinct g.file_id, g.path, p.rk::varchar as rk, p.value::varchar as v from gone g join pv p on p.file_id = g.prev_id and p.path = g.path join common c on c.file_id = g.file_id and c.rk = p.rk::varchar),
fv as (select distinct g.file_id, g.path, p.rk::varchar as rk, p.value::varchar as v from fresh g join pv p on p.file_id = g.file_id and p.path = g.path join common c on c.file_id = g.file_id and c.rk = p.rk::varchar),
gs as (select file_id, path, list_sort(list(struct_pack(rk := rk, v := v)))::varchar as sig, count(*) filter (v <> 'null') as held from gv group by 1, 2), fs as (select file_id, path, list_sort(list(struct_pack(rk := rk, v := v)))::varchar as sig, count(*) filter (v <> 'null') as held from fv group by 1, 2),
ren as (select g.file_id, g.path as old, f.path as new from (select *, row_number() over (partition by file_id, sig order by path) as n from gs where held > 0) g join (select *, row_number() over (partition by file_id, sig order by path) as n from fs where held > 0) f using (file_id, sig, n)),
hist as (select *, last_value(t ignore nulls) over (partition by feed, path order by seq_no) as known from st),
moves as (select feed, seq_no, 1 as step, file_id, path, t from st union all select i.feed, i.seq_no, 0, null, r.new, h.known from ren r join idx i using (file_id) join hist h on h.file_id = i.prev_id and h.path = r.old),
ret as (select *, last_value(t ignore nulls) over (partition by feed, path order by seq_no, step rows between unbounded preceding and 1 preceding) as before from moves)
select file_id, path as field, 'removed' as change_kind, '' as new_field from gone g where not exists (select 1 from ren r where r.file_id = g.file_id and r.old = g.path)
union all select file_id, path, 'added', '' from fresh g where not exists (select 1 from ren r where r.file_id = g.file_id and r.new = g.path)
union all select file_id, old, 'renamed', new from ren union all select file_id, path, 'retyped', '' from ret where file_id is not null and t is not null and before is not null and t <> before"""
SQL["p5_parameters"] = """
with one as (select tool_id, case when json_valid(input_schema) then case when json_type(input_schema) = 'VARCHAR' then input_schema::json->>'$' else input_schema end end as s from tools), j as (select tool_id, s::json as j from one where json_valid(s)),
m as (select tool_id, j, unnest(json_keys(j, '/properties')) as label from j where json_type(j) = 'OBJECT' and json_type(j, '/properties') = 'OBJECT'),
v as (select tool_id, label, j->('/properties/' || replace(replace(label, '~', '~0'), '/', '~1')) as v from m)
select distinct tool_id, label, case when json_type(v, '/type') not in ('OBJECT', 'ARRAY') then v->>'/type' end as type, case when json_type(v, '/description') not in ('OBJECT', 'ARRAY') then v->>'/description' end as description, case when json_type(v, '/format') not in ('OBJECT', 'ARRAY') then v->>'/format' end as format
from v where json_type(v) = 'OBJECT'"""
