"""A whole scan as one plan: files to units, analyzers to raw rows, raw rows to findings and a report.

An analyzer is a function from the context to raw rows; what it may emit is declared, and an analyzer that cannot be
planned becomes a row of runs and a finding of its own instead of ending the scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions import units as U
from skein.operators import findings as FI
from skein.operators import inventory, predicates, rules
from skein.session import stage
from skein.sources import configs

#: The rule of a failed analyzer.
ERRORED = "ANALYZER-FAILED"
RAW = "scan_id string, seq string, rule_id string, components array<string>, path string, line int, match_key string, message string, severity string, confidence string, hidden boolean, source string, tags array<string>, snippet string"


@dataclass
class Context:
    """What analyzers see: decoded files with owners and roles, text units, and the tables of the rule pack."""

    files: DataFrame
    units: DataFrame
    rules: DataFrame
    patterns: DataFrame
    extra: dict[str, DataFrame] = field(default_factory=dict)


@dataclass(frozen=True)
class Analyzer:
    """A named analyzer: the tables it needs, the rules it may emit (none: any), and its plan."""

    name: str
    plan: Callable[[Context], DataFrame]
    needs: tuple[str, ...] = ()
    emits: tuple[str, ...] = ()


def prepare(files: DataFrame, rule_table: DataFrame, patterns: DataFrame, **extra: DataFrame) -> Context:
    """Files (scan_id, path, content) decoded, owned and cut into units."""
    decoded = files.select("scan_id", "path", "content", X.decode_text(F.col("content"))["text"].alias("text"), X.binary_kind(F.col("content")).alias("binary"))
    # One narrow row per file, read by every analyzer.
    owned = stage(inventory.nearest_owner(decoded, inventory.skill_roots(decoded)), "scan-owners")
    full = decoded.join(owned.withColumnRenamed("root", "skill_root"), ["scan_id", "path"], "left")
    full = full.withColumn("role", inventory.file_role(F.col("path"), F.col("skill_root").isNotNull())).withColumn("component", F.coalesce("skill_root", X.dir_name(F.col("path")))).withColumn("language", X.language(F.col("path")))
    texts = full.filter("binary is null").select("scan_id", "component", "path", "role", "text")
    told = U.explode_with(texts.filter("role = 'skill_md'").select("scan_id", "component", "text"), "text", _description, "description string")
    told = told.groupBy("scan_id", "component").agg(F.min("description").alias("description"))
    return Context(full, U.text_units(texts).join(told, ["scan_id", "component"], "left"), rule_table, patterns, extra)


def _description(text: str) -> list[tuple[str]]:
    raw = U.frontmatter(text)[0]
    value = U.load_yaml(raw)[0] if raw else None
    return [(str(value["description"]),)] if isinstance(value, dict) and value.get("description") else []


def regex_rules(c: Context) -> DataFrame:
    """The regex rules of the pack as raw rows."""
    keyed = c.units.withColumnRenamed("start", "unit_start").withColumn("unit_id", F.monotonically_increasing_id())
    hit = rules.evaluate(keyed, c.rules, c.patterns, ["scan_id", "path", "unit_id"])
    starts = c.files.select("scan_id", "path", "text")
    j = hit.join(starts, ["scan_id", "path"])
    # Units that are cut out of the file count on from the line where they start; decoded texts lie on that line.
    first = X.line_of(F.col("text"), F.col("unit_start") + 1)
    at = F.when(F.col("scope").isin("body", "code", "frontmatter", "hidden", "command"), first + F.col("line") - 1).otherwise(first)
    seq = F.concat_ws(":", F.lit("1"), "path", F.format_string("%010d", "unit_id"), "rule_id", F.format_string("%04d", "p_ord"), F.format_string("%010d", "line"))
    none = F.array().cast("array<string>")
    title = c.rules.select("rule_id", "title", F.col("tags").alias("rule_tags"))
    j = j.join(title, "rule_id", "left").withColumn("title", F.coalesce("title", "snippet")).withColumn("rule_tags", F.coalesce("rule_tags", none))
    return j.select("scan_id", seq.alias("seq"), "rule_id", F.array("component").alias("components"), "path", at.cast("int").alias("line"), X.short_hash(F.col("match")).alias("match_key"), F.col("title").alias("message"), "severity", "confidence", "hidden", F.lit("static").alias("source"), F.col("rule_tags").alias("tags"), F.substring("snippet", 1, 240).alias("snippet"))


def table_rows(found: DataFrame, order: int, severity: str = "medium", confidence: str = "medium") -> DataFrame:
    """Rows (scan_id, path, rule, detail) of a predicate as raw rows."""
    none = F.array().cast("array<string>")
    return found.select("scan_id", F.concat_ws(":", F.lit(str(order)), "path", "rule").alias("seq"), F.col("rule").alias("rule_id"), F.array(X.dir_name(F.col("path"))).alias("components"), "path", F.lit(1).alias("line"), X.short_hash(F.coalesce("detail", F.lit(""))).alias("match_key"), F.concat_ws(": ", "rule", "detail").alias("message"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), F.lit(False).alias("hidden"), F.lit("static").alias("source"), none.alias("tags"), F.coalesce("detail", F.lit("")).alias("snippet"))


def bundle_rules(c: Context) -> DataFrame:
    return graded(predicates.bundles(c.files), 2)


#: Severities of the predicates' short names; medium where none is given.
SEVERITY = {
    "critical": ("docker_privileged", "docker_socket"),
    "high": ("native_binary", "shell_expansion", "inline_code", "docker_root_mount", "secret_in_url", "loads_code_by_env", "hidden_instruction", "contradicting_hints", "bytecode_without_source"),
    "low": ("no_frontmatter", "bad_name", "no_description", "open_schema", "old_transport", "long_description", "project_stdio", "namespace_mismatch"),
    "info": ("capability", "no_schema"),
}


def graded(found: DataFrame, order: int) -> DataFrame:
    """Rows (scan_id, path, rule, detail) of predicates as raw rows, each with the severity of its short name."""
    names = F.create_map(*[F.lit(x) for level, rules_ in SEVERITY.items() for r in rules_ for x in (r, level)])
    return table_rows(found, order).withColumn("severity", F.coalesce(F.try_element_at(names, F.substring_index("rule_id", ":", 1)), F.lit("medium")))


_FRONT = "found boolean, error string, name string, description string, tools array<string>, repeated array<string>, keys array<string>"
#: Keys that the format of a skill knows.
SKILL_KEYS = ["name", "description", "license", "allowed-tools", "metadata", "version", "compatibility"]


def _front(text: str) -> list[tuple]:
    raw, _, err = U.frontmatter(text)
    value, again, bad = U.load_yaml(raw) if raw else (None, [], None)
    value = value if isinstance(value, dict) else {}
    return [(raw is not None, err or bad or "", str(value.get("name") or ""), str(value.get("description") or ""), U.allowed_tools(str(value.get("allowed-tools") or "")), again, sorted(map(str, value)))]


def skill_rules(c: Context) -> DataFrame:
    front = U.explode_with(c.files.filter("role = 'skill_md'").select("scan_id", "path", "text"), "text", _front, _FRONT)
    return graded(predicates.skills(front, ["scan_id", "path"], SKILL_KEYS), 3)


def config_rules(c: Context) -> DataFrame:
    servers = configs.client_servers(c.files.filter("role = 'client_config'").select("scan_id", "path", "text"))
    found = predicates.servers(servers, ["scan_id", "path", "server_name"])
    return graded(found.select("scan_id", "path", F.concat_ws(":", "rule", "server_name").alias("rule"), "detail"), 4)


def manifest_rules(c: Context) -> DataFrame:
    """Tools of the manifests among JSON files that are no configuration."""
    rows = configs.manifests(c.files.filter("lower(path) like '%.json' and role not in ('client_config', 'package_manifest', 'server_json')").select("scan_id", "path", "text"))
    tools = rows.filter("list = 'tools' and problem is null").select("scan_id", "path", F.col("name").alias("tool_name"), "description", F.get_json_object("body", "$.inputSchema").alias("input_schema"), F.get_json_object("body", "$.annotations").alias("annotations"))
    found = predicates.tools(tools, ["scan_id", "path", "tool_name"])
    return graded(found.select("scan_id", "path", F.concat_ws(":", "rule", "tool_name").alias("rule"), "detail"), 5)


def code_rules(c: Context) -> DataFrame:
    """What scripts and sources can do, at the first line that shows it."""
    found = predicates.code_capabilities(c.files.filter("role in ('script', 'source') and text is not null"), ["scan_id", "path"])
    rows = graded(found.select("scan_id", "path", F.concat_ws(":", F.lit("capability"), "label").alias("rule"), F.col("label").alias("detail")), 6)
    at = found.select("scan_id", "path", F.col("label").alias("snippet"), F.col("line").alias("at"))
    return rows.join(at, ["scan_id", "path", "snippet"]).withColumn("line", F.col("at").cast("int")).drop("at")


def registry_rules(c: Context) -> DataFrame:
    servers = configs.registry_servers(c.files.filter("role = 'server_json'").select("scan_id", "path", "text"))
    odd = predicates.namespace_mismatch(servers.select("name", "repository").distinct())
    found = servers.join(odd, "name").select("scan_id", "path", F.lit("namespace_mismatch").alias("rule"), F.concat_ws(" / ", "namespace", "owner").alias("detail"))
    return graded(found, 7)


def bytecode_rules(c: Context) -> DataFrame:
    found = predicates.bytecode_without_source(c.files)
    return graded(found.select("scan_id", "path", F.lit("bytecode_without_source").alias("rule"), "detail"), 8)


DEFAULT = (
    Analyzer("regex", regex_rules), Analyzer("bundle", bundle_rules), Analyzer("skill", skill_rules), Analyzer("config", config_rules), Analyzer("manifest", manifest_rules), Analyzer("code", code_rules),
    Analyzer("registry", registry_rules), Analyzer("bytecode", bytecode_rules),
)


def run(c: Context, analyzers: tuple[Analyzer, ...] = DEFAULT, only: set[str] | None = None) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """(raw rows, runs): analyzers in their order; runs say ran, skipped or errored, and why."""
    spark = c.files.sparkSession
    out, runs = spark.createDataFrame([], RAW), []
    for a in analyzers:
        missing = [n for n in a.needs if n not in c.extra]
        if only is not None and a.name not in only:
            runs.append((a.name, "skipped", "not selected"))
        elif missing:
            runs.append((a.name, "skipped", "needs " + ", ".join(missing)))
        else:
            try:
                rows = a.plan(c)
                if a.emits:
                    stray = rows.filter(~F.col("rule_id").isin(*a.emits))
                    rows = rows.join(stray.select("rule_id").distinct(), "rule_id", "left_anti")
                out = out.unionByName(rows.select(out.columns))
                runs.append((a.name, "ran", ""))
            except Exception as e:  # noqa: BLE001
                runs.append((a.name, "errored", str(e).split("\n")[0][:200]))
                out = out.unionByName(failed(c, a.name))
    return out, runs


def failed(c: Context, analyzer: str) -> DataFrame:
    """A raw row per scan that tells that an analyzer did not run."""
    none, text = F.array().cast("array<string>"), F.lit(f"analyzer {analyzer} failed")
    return c.files.select("scan_id").distinct().select("scan_id", F.lit(f"0:{analyzer}").alias("seq"), F.lit(ERRORED).alias("rule_id"), none.alias("components"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line"), F.lit(analyzer).alias("match_key"), text.alias("message"), F.lit("high").alias("severity"), F.lit("high").alias("confidence"), F.lit(False).alias("hidden"), F.lit("static").alias("source"), none.alias("tags"), F.lit("").alias("snippet"))


def report(c: Context, analyzers: tuple[Analyzer, ...] = DEFAULT, overrides: DataFrame | None = None) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """(findings, runs) of a scan."""
    raw, runs = run(c, analyzers)
    return FI.finalize(FI.settle(raw, overrides)), runs
