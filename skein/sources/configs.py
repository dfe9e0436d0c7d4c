"""Client configurations, tool manifests and rule packs as tables."""

from __future__ import annotations

import json
import os
import re
import tomllib
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import units as U

#: Keys under which client configurations keep their servers.
SERVER_MAPS = ("mcpServers", "mcp_servers", "context_servers", "servers")
# Which client and scope a configuration belongs to, by its path in any case; the first that fits counts.
CLIENTS = [
    (r"(^|/)claude_desktop_config\.json$", "claude-desktop", "user"),
    (r"(^|/)\.claude\.json$", "claude-code", "user"),
    (r"(^|/)\.mcp\.json$", "claude-code", "project"),
    (r"(^|/)\.claude/settings(\.local)?\.json$", "claude-code", "project"),
    (r"(^|/)managed-(?:settings|mcp)\.json$", "claude-code", "enterprise"),
    (r"(^|/)\.cursor/mcp\.json$", "cursor", "project"),
    (r"(^|/)\.vscode/mcp\.json$", "vscode", "workspace"),
    (r"(^|/)\.vscode/settings\.json$", "vscode", "workspace"),
    (r"(^|/)Code/User/(settings|mcp)\.json$", "vscode", "user"),
    (r"(^|/)Code/User/profiles/[^/]+/(settings|mcp)\.json$", "vscode", "user"),
    (r"(^|/)\.copilot/mcp-config\.json$", "copilot", "user"),
    (r"(^|/)(?:devin|windsurf)/mcp_config\.json$", "windsurf", "user"),
    (r"(^|/)\.gemini/settings\.json$", "gemini-cli", "project"),
    (r"(^|/)gemini-?cli/settings\.json$", "gemini-cli", "enterprise"),
    (r"(^|/)\.codex/config\.toml$", "codex", "user"),
    (r"(^|/)\.zed/settings\.json$", "zed", "project"),
    (r"(^|/)zed/settings\.json$", "zed", "user"),
    (r"(^|/)cline_mcp_settings\.json$", "cline", "user"),
    (r"(^|/)\.cline/mcp\.json$", "cline", "user"),
    (r"(^|/)mcp\.json$", "generic", "project"),
]


def client_of(path: Column) -> Column:
    """struct(client, scope) of a configuration path."""
    out = None
    for rx, client, scope in CLIENTS:
        value = F.struct(F.lit(client).alias("client"), F.lit(scope).alias("scope"))
        hit = path.rlike("(?i)" + rx)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.struct(F.lit("unknown").alias("client"), F.lit("unknown").alias("scope")))


def parse_structured(path: str, text: str) -> tuple[Any, str | None]:
    """(value, error) of JSON, JSON with comments, TOML or YAML by the file's name."""
    low = path.lower()
    if low.endswith(".toml"):
        try:
            return tomllib.loads(text), None
        except (tomllib.TOMLDecodeError, RecursionError) as e:
            return None, str(e)[:200]
    if low.endswith((".yaml", ".yml")):
        value, _, err = U.load_yaml(text)
        return value, err
    return U.parse_json(text, jsonc=True)


def _server(name: str, raw: dict, project: str) -> tuple:
    text = lambda v: v if isinstance(v, str) else ""
    names = lambda v: sorted(map(str, v)) if isinstance(v, dict) else [str(x) for x in v] if isinstance(v, list) else []
    url = text(raw.get("url") or raw.get("httpUrl") or raw.get("serverUrl"))
    command = raw.get("command")
    if isinstance(command, dict):  # one client nests path and arguments
        raw = {**raw, "args": command.get("args", raw.get("args"))}
        command = command.get("path")
    args = [str(x) for x in raw.get("args") or []] if isinstance(raw.get("args"), list) else []
    kind = text(raw.get("type") or raw.get("transport")).lower()
    transport = "stdio" if command and not url else "sse_deprecated" if kind == "sse" or url.rstrip("/").endswith("/sse") else "streamable_http" if url else "unknown"
    return name, project, transport, text(command), args, url, names(raw.get("env")), names(raw.get("headers"))


SERVERS = "server_name string, project string, transport string, command string, args array<string>, url string, env_names array<string>, header_names array<string>"


def servers_of(path: str, text: str) -> list[tuple]:
    """Every server of a client configuration; of a repeated (project, name) the last counts."""
    value, err = parse_structured(path, text)
    if err or not isinstance(value, dict):
        return []
    maps = [("", value.get(k)) for k in SERVER_MAPS]
    if isinstance(value.get("mcp"), dict):
        maps.append(("", value["mcp"].get("servers")))
    if isinstance(value.get("projects"), dict):
        maps += [(str(p), v.get("mcpServers")) for p, v in value["projects"].items() if isinstance(v, dict)]
    found = {(project, str(n)): _server(str(n), raw, project) for project, m in maps if isinstance(m, dict) for n, raw in m.items() if isinstance(raw, dict) and (raw.keys() & {"command", "url", "httpUrl", "serverUrl", "args"})}
    return list(found.values())


def client_servers(files: DataFrame) -> DataFrame:
    """Servers of the configurations among files (…, path, text), with client and scope."""
    packed = files.withColumn("__t", F.concat(F.col("path"), F.lit("\x00"), F.col("text"))).drop("text")
    rows = U.explode_with(packed, "__t", lambda t: servers_of(*t.split("\x00", 1)), SERVERS)
    c = client_of(F.col("path"))
    return rows.withColumn("client", c["client"]).withColumn("config_scope", F.when(F.col("project") != "", "project").otherwise(c["scope"]))


#: Longest base64 text of a resource that is read.
BLOB_CHARS = 4_000_000


def resource_text(text: Column, blob: Column, mime: Column) -> Column:
    """The text of a resource: its own, else that of an HTML blob in base64; null for other or broken blobs."""
    html = F.startswith(F.coalesce(mime, F.lit("")), F.lit("text/html")) & (F.length(blob) <= BLOB_CHARS)
    return F.coalesce(text, F.when(html, F.decode(F.try_to_binary(blob, F.lit("base64")), "utf-8")))


def registry_servers(files: DataFrame) -> DataFrame:
    """(scan_id, path, name, version, publisher, repository): the package of every server.json of a registry.

    Without a name the folder's name counts, else `server`; text that is no JSON object gives such a row too.
    """
    v = F.try_parse_json("text")
    field = lambda way: F.try_variant_get(v, way, "string")
    folder = F.nullif(F.regexp_extract("path", r"([^/]+)/[^/]*$", 1), F.lit(""))
    rows = files.filter(F.lower(F.regexp_extract("path", r"[^/]*$", 0)) == "server.json")
    rows = rows.select("scan_id", "path", F.coalesce(F.nullif(field("$.name"), F.lit("")), folder, F.lit("server")).alias("name"), F.coalesce(field("$.version"), field("$.version_detail.version")).alias("version"), F.coalesce(field("$.repository.url"), F.lit("")).alias("repository"))
    return rows.withColumn("publisher", F.when(F.contains("name", F.lit("/")), F.substring_index("name", "/", 1)))


MANIFEST = "list string, name string, title string, description string, body string, problem string"


def manifest_of(text: str) -> list[tuple]:
    """Tools, prompts, resources and instructions of a manifest; a JSON-RPC answer is opened; odd entries carry a problem."""
    value, err = U.parse_json(text, jsonc=True)
    if err:
        return []
    if isinstance(value, dict) and isinstance(value.get("result"), dict):
        value = value["result"]
    if isinstance(value, list) and value and all(isinstance(x, dict) and "name" in x for x in value):
        value = {"tools": value}
    if not isinstance(value, dict):
        return []
    out: list[tuple] = []
    text_of = lambda v: v if isinstance(v, str) else None
    for kind in ("tools", "prompts", "resources"):
        for x in value.get(kind) if isinstance(value.get(kind), list) else []:
            if not isinstance(x, dict):
                out.append((kind, None, None, None, None, "not an object"))
            elif not isinstance(x.get("name") or x.get("uri"), str):
                out.append((kind, None, None, None, U.canonical_json(x), "no name"))
            else:
                out.append((kind, x.get("name") or x.get("uri"), text_of(x.get("title")), text_of(x.get("description")), U.canonical_json(x), None))
    if isinstance(value.get("instructions"), str):
        out.append(("instructions", "", None, value["instructions"], None, None))
    return out


def manifests(files: DataFrame) -> DataFrame:
    return U.explode_with(files, "text", manifest_of, MANIFEST)


def malformed_summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Per list: how many entries were odd, the first three kinds of problem, and how many entries there are beyond three."""
    bad = rows.filter("problem is not null").groupBy(*keys, "list").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("problem")).alias("p"))
    return bad.select(*keys, "list", "n", F.slice("p", 1, 3).alias("first"), F.greatest(F.col("n") - 3, F.lit(0)).alias("more"))


# ---------------------------------------------------------------- rule packs

RULES = "rule_id string, version int, title string, severity string, confidence string, applies_to array<string>, kind string, scopes array<string>, require array<string>, unless array<string>, window int, ignore_case boolean, sections array<string>, lower_in_code boolean, max_matches int, downgrade string, cvss_base double, threat string, tags array<string>, enabled boolean, description string, remediation string"
PATTERNS = "rule_id string, p_ord int, pattern string"


def read_rules(folder: str) -> list[dict]:
    """Rule definitions of all YAML files below a folder, in order of path; each file holds a list under `rules`."""
    import yaml

    out: list[dict] = []
    for d, dirs, names in os.walk(folder):
        dirs.sort()
        for n in sorted(names):
            if n.endswith((".yaml", ".yml")):
                with open(os.path.join(d, n), encoding="utf-8") as f:
                    value = yaml.safe_load(f)
                out += [r for r in (value or {}).get("rules", []) if isinstance(r, dict) and "id" in r] if isinstance(value, dict) else []
    return out


def rule_tables(spark: SparkSession, rules: list[Mapping[str, Any]]) -> tuple[DataFrame, DataFrame]:
    """(rules, patterns): the dimension tables of a pack; what a rule leaves out gets its usual value."""
    rows, pats = [], []
    for r in rules:
        m = r.get("match") or {}
        rows.append((r["id"], int(r.get("version", 1)), r.get("title", ""), r.get("severity", "medium"), r.get("confidence", "medium"), list(r.get("applies_to") or []), m.get("type", "analyzer"), list(m.get("scopes") or ["body", "hidden", "decoded"]), list(m.get("require") or []), list(m.get("unless") or []), int(m.get("window", 3)), bool(m.get("ignore_case", True)), list(m.get("sections") or []), bool(m.get("lower_confidence_in_code", False)), int(m.get("max_matches", 5)), json.dumps(m.get("downgrade") or []), (r.get("aivss") or {}).get("cvss_base"), (r.get("aivss") or {}).get("threat", "poc"), list(r.get("tags") or []), bool(r.get("enabled", True)), r.get("description", ""), r.get("remediation", "")))
        pats += [(r["id"], i, p) for i, p in enumerate(m.get("patterns") or [])]
    return spark.createDataFrame(rows, RULES), spark.createDataFrame(pats, PATTERNS)


def crosswalk(mappings: DataFrame, catalogs: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(joined, errors) of mappings (rule_id, framework, ref): titles from catalogs (framework, ref, title); errors name what is missing."""
    joined = mappings.join(catalogs, ["framework", "ref"], "left").join(rules.select("rule_id", F.lit(True).alias("known")), "rule_id", "left")
    why = F.when(F.col("known").isNull(), "unknown rule").when(F.col("title").isNull(), "unknown reference")
    marked = joined.withColumn("error", why)
    return marked.filter("error is null").drop("error", "known"), marked.filter("error is not null").select("rule_id", "framework", "ref", "error")


# ---------------------------------------------------------------- inputs and listings

_SHA = re.compile(r"[0-9a-f]{40}")


def parse_input(text: str) -> dict[str, Any]:
    """What a pasted link or package name means: {kind, locator, ref candidates} or {rejected}."""
    s = (text or "").strip()
    if not s or len(s) > 2048 or any(c.isspace() or ord(c) < 32 for c in s):
        return {"rejected": "empty, too long or with blanks"}
    if m := re.fullmatch(r"npm:((?:@[a-z0-9][\w.\-]*/)?[a-z0-9][\w.\-]*)(?:@([\w.\-+]+))?", s.lower()):
        return {"kind": "npm", "locator": m[1] + (f"@{m[2]}" if m[2] else "")}
    if m := re.fullmatch(r"(?i)pypi:([A-Za-z0-9][\w.\-]*)(?:==([\w.\-+!]+))?", s):
        return {"kind": "pypi", "locator": m[1] + (f"=={m[2]}" if m[2] else "")}
    if "://" not in s and re.match(r"(?:www\.)?github\.com/", s.lower()):
        s = "https://" + s
    m = re.fullmatch(r"(?i)(https?)://([^/@?#]+)(/[^?#]*)?(?:[?#].*)?", s)
    if not m:
        return {"rejected": "no supported link or package name"}
    host, segs = m[2].lower().removeprefix("www."), [x for x in (m[3] or "").split("/") if x]
    if any(x in (".", "..") for x in segs):
        return {"rejected": "unsafe path"}
    if host in ("github.com", "raw.githubusercontent.com"):
        if len(segs) < 2:
            return {"rejected": "owner and repository are needed"}
        out = {"kind": "github", "locator": f"{segs[0]}/{segs[1].removesuffix('.git')}"}
        rest = segs[2:] if host.startswith("raw") else segs[3:] if segs[2:3] and segs[2] in ("tree", "blob", "commit") else []
        if segs[2:] and not rest:
            return {"rejected": "no page of code"}
        return {**out, "candidates": ref_candidates(rest, host.startswith("raw") or segs[2:3] == ["blob"])}
    if host == "npmjs.com" and segs[:1] == ["package"] and len(segs) > 1:
        return {"kind": "npm", "locator": "/".join(segs[1:3] if segs[1].startswith("@") else segs[1:2]).lower()}
    if host == "pypi.org" and segs[:1] == ["project"] and len(segs) > 1:
        return {"kind": "pypi", "locator": segs[1]}
    return {"kind": "remote_mcp", "locator": f"https://{m[2].lower()}{m[3] or '/'}"} if m[1].lower() == "https" else {"rejected": "remote servers need https"}


def ref_candidates(rest: list[str], need_path: bool, most: int = 4) -> list[tuple[str, str]]:
    """(ref, path) splits of the steps behind a repository; a full commit id is certain."""
    if rest and _SHA.fullmatch(rest[0]):
        return [(rest[0], "/".join(rest[1:]))]
    return [("/".join(rest[:i]), "/".join(rest[i:])) for i in range(1, min(len(rest) - need_path, most) + 1)]


def plan_fetch(listing: DataFrame, max_files: int, max_bytes: int, max_file_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(plan, left out) of a listing (scan_id, path, size): what lies in a skill's folder or is of a relevant kind, by
    priority then path, as long as it fits; a file that does not fit is passed over and the next is tried."""
    name = F.lower(F.regexp_extract("path", r"[^/]*$", 0))
    skill_dirs = listing.filter(name == "skill.md").select("scan_id", F.regexp_replace("path", r"/?[^/]*$", "").alias("dir")).distinct()
    from skein.functions import text as X

    up = listing.select("scan_id", "path", F.explode(X.ancestors(F.col("path"))).alias("dir"))
    in_skill = up.join(skill_dirs, ["scan_id", "dir"], "left_semi").select("scan_id", "path").distinct().withColumn("in_skill", F.lit(True))
    rows = listing.join(in_skill, ["scan_id", "path"], "left")
    kind = name.rlike(r"\.(?:md|mdc|json|jsonc|toml|yaml|yml|py|js|mjs|ts|sh|ps1|txt)$|^(?:dockerfile|agents|claude|gemini|\.mcp)")
    rank = F.when(name == "skill.md", 0).when(F.col("in_skill"), 1).when(name.rlike(r"\.(?:md|mdc|json|jsonc|toml|yaml|yml)$"), 2).otherwise(4)
    chosen = rows.filter(F.col("in_skill") | kind).filter(F.coalesce("size", F.lit(0)) <= max_file_bytes).select("scan_id", "path", F.coalesce("size", F.lit(0)).cast("bigint").alias("size"), rank.alias("rank"))

    def pick(pdf):  # noqa: ANN001, ANN202
        pdf = pdf.sort_values(["rank", "path"], kind="stable")
        n = total = 0
        keep = []
        for size in pdf["size"]:
            fits = n < max_files and total + size <= max_bytes
            n, total = n + fits, total + size * fits
            keep.append(fits)
        return pdf.assign(keep=keep)

    done = chosen.groupBy("scan_id").applyInPandas(pick, "scan_id string, path string, size bigint, rank int, keep boolean")
    return done.filter("keep").drop("keep"), done.filter("not keep").drop("keep")
