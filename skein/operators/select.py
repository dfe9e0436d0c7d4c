"""Selections and lookups against recorded tables: items for a judge, probes, known servers, byte rules, hidden text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as X


def judge_items(components: DataFrame, texts: DataFrame, results: DataFrame, budget: int) -> DataFrame:
    """Components whose texts a model shall read: those without a recorded verdict for their content, skills first, as
    many as the budget of calls allows (component, content_hash, paths)."""
    fresh = components.join(results.select("component", "content_hash"), ["component", "content_hash"], "left_anti")
    t = texts.groupBy("component").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    return fresh.join(t, "component").orderBy(F.col("kind") != "skill", "component").limit(budget).select("component", "content_hash", "paths")


def probe_of(servers: DataFrame, probes: DataFrame) -> DataFrame:
    """Recorded probes of servers by name; a probe that names a configuration counts for that one only."""
    p = probes.withColumnRenamed("config_path", "probe_path")
    return servers.join(p, "server_name").filter((F.col("probe_path") == "") | (F.col("probe_path") == F.col("config_path"))).drop("probe_path")


def known_servers(names: DataFrame, table: list[tuple[str, str]], hints: list[tuple[str, str]]) -> DataFrame:
    """(name, label, why): the first row of a table of globs that fits a name, else the first word that it holds."""
    low = F.lower("name")
    out = None
    for i, (glob, label) in enumerate(table):
        value = F.struct(F.lit(label).alias("label"), F.lit(f"known {i}").alias("why"))
        out = F.when(low.rlike(X.glob_regex(glob.lower())), value) if out is None else out.when(low.rlike(X.glob_regex(glob.lower())), value)
    for word, label in hints:
        value = F.struct(F.lit(label).alias("label"), F.lit(f"word {word}").alias("why"))
        out = F.when(F.contains(low, F.lit(word)), value) if out is None else out.when(F.contains(low, F.lit(word)), value)
    return names.select("name", out.alias("x")).filter("x is not null").select("name", "x.label", "x.why")


def scope_swaps(packages: DataFrame, popular: list[str]) -> DataFrame:
    """(package, popular): packages that carry a popular name under another scope, or a scoped name with its parts swapped."""
    scope, name = F.regexp_extract("package", r"^@([^/]+)/", 1), F.regexp_replace("package", r"^@[^/]+/", "")
    spark = packages.sparkSession
    p = spark.createDataFrame([(x,) for x in sorted(set(popular))], "popular string").withColumn("p_scope", F.regexp_extract("popular", r"^@([^/]+)/", 1)).withColumn("p_name", F.regexp_replace("popular", r"^@[^/]+/", ""))
    base = packages.select("package", scope.alias("scope"), name.alias("n")).distinct()
    same = base.join(p, F.col("n") == F.col("p_name")).filter("scope <> p_scope")
    joined = base.filter("scope = ''").join(p, F.col("n") == F.concat_ws("-", "p_scope", "p_name")).filter("p_scope <> ''")
    return same.select("package", "popular").unionByName(joined.select("package", "popular")).distinct()


def byte_rules(files: DataFrame, rules: list[dict], key: list[str]) -> DataFrame:
    """(key, rule, offset) of rules over raw bytes: each rule has `strings` (name to byte pattern) and a `condition`:
    'any', 'all' or a number of strings; `roles` limits it. The offset is that of the first string found."""
    compiled = [(r["id"], {k: v for k, v in r["strings"].items()}, r.get("condition", "any"), set(r.get("roles") or ())) for r in rules]
    keep = [f for f in files.schema.fields if f.name in key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [(i, [re.compile(p.encode("latin-1"), re.S) for p in s.values()], c, roles) for i, s, c, roles in compiled]
        for b in batches:
            idx, out, at = [], [], []
            content, role = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("content", "role"))
            for i, (data, r) in enumerate(zip(content, role, strict=True)):
                for name, patterns, condition, roles in ready if data is not None else ():
                    if roles and r not in roles:
                        continue
                    hits = [m.start() for p in patterns if (m := p.search(data))]
                    need = 1 if condition == "any" else len(patterns) if condition == "all" else int(condition)
                    if len(hits) >= need:
                        idx.append(i)
                        out.append(name)
                        at.append(min(hits))
            take = pa.array(idx, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(f.name)).take(take) for f in keep], pa.array(out, pa.string()), pa.array(at, pa.int64())], names=[*[f.name for f in keep], "rule", "offset"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return files.mapInArrow(run, f"{head}, rule string, offset bigint")


def hidden_content(units: DataFrame, key: list[str]) -> DataFrame:
    """(key, rule, start): hidden regions that speak to an agent, by kind; the first of each kind and place counts."""
    speaks = F.col("unit").rlike(r"(?i)\b(?:ignore|must|always|never|do not|execute|run|send|read|fetch|secretly|instead)\b")
    rows = units.filter("hidden").filter(speaks)
    kind = F.concat(F.lit("hidden_"), F.when(F.col("scope") == "decoded", F.lit("blob")).otherwise(F.col("label")))
    w = Window.partitionBy(*key, "rule", "start").orderBy(F.length("decode_path"), "unit")
    return rows.withColumn("rule", kind).withColumn("n", F.row_number().over(w)).filter("n = 1").select(*key, "rule", "start")


def load_time_commands(units: DataFrame, key: list[str]) -> DataFrame:
    """(key, rule, start): commands that run when a prompt is loaded, and what they reach for."""
    u = units.filter("scope = 'command'")
    return u.select(*key, F.when(F.col("unit").rlike(r"\b(?:curl|wget|nc|ssh|scp)\b"), "command_network").when(F.col("unit").rlike(r"\brm\s+-|\bchmod\b|\bsudo\b"), "command_destructive").otherwise("command").alias("rule"), "start")


def absent_near(lines: DataFrame, key: list[str], has: str, lacks: str, window: int = 20) -> DataFrame:
    """Lines (key, n, line) that match `has` without a line that matches `lacks` within so many lines: an anti-join on
    blocks of lines, so no line meets more than the neighbouring blocks."""
    want = lines.filter(F.col("line").rlike(has)).select(*key, "n", F.explode(F.array(*[F.floor(F.col("n") / window) + i for i in (-1, 0, 1)])).alias("block"))
    safe = lines.filter(F.col("line").rlike(lacks)).select(*key, F.col("n").alias("m"), F.floor(F.col("n") / window).alias("block"))
    near = want.join(safe, [*key, "block"]).filter(F.abs(F.col("n") - F.col("m")) <= window).select(*key, "n").distinct()
    return want.select(*key, "n").distinct().join(near, [*key, "n"], "left_anti")


def mismatched(declared: DataFrame, observed: DataFrame, key: list[str]) -> DataFrame:
    """(key, label): what components do (key, label) without that their description (key, description) speaks of it."""
    from functools import reduce

    words = {"external_egress": r"(?i)\b(?:http|api|web|fetch|send|upload|download|network|url|remote|online)", "code_exec": r"(?i)\b(?:run|exec|command|script|shell|compile|test|build)", "reads_private_data": r"(?i)\b(?:credential|secret|key|file|read|config|environment)", "destructive": r"(?i)\b(?:delete|remove|clean|purge|overwrite)", "persistence": r"(?i)\b(?:install|startup|schedule|memory|hook|cron)"}
    j = observed.join(declared, key)
    told = reduce(lambda a, kv: a | ((F.col("label") == kv[0]) & F.col("description").rlike(kv[1])), words.items(), F.lit(False))
    return j.filter(~F.coalesce(told, F.lit(False))).select(*key, "label").distinct()
