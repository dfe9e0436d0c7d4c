"""Predicates over inventoried tables: bundles, client settings, tool metadata, remote probes, packages, policy.

Each takes tables and gives rows with `rule`, a key of the table it looks at and a `detail`. The ids are those of a
rule pack's analyzer rules as the caller names them: `names` maps the predicate's own short name to a rule id, and a
predicate without an entry keeps its short name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as X


def flagged(df: DataFrame, key: list[str], checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(key, rule, detail): one row per check that holds; all checks run in one pass over df."""
    found = F.array(*[F.when(hit, F.struct(F.lit(n).alias("rule"), detail.cast("string").alias("detail"))) for n, (hit, detail) in checks.items()])
    return df.select(*key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select(*key, "x.rule", "x.detail")


def named(found: DataFrame, names: dict[str, str]) -> DataFrame:
    """Short names of predicates as rule ids."""
    if not names:
        return found
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return found.withColumn("rule", F.coalesce(F.try_element_at(table, F.col("rule")), F.col("rule")))


# ---------------------------------------------------------------- bundles


def bundles(files: DataFrame) -> DataFrame:
    """Native binaries, archives and bytecode among files (scan_id, path, content)."""
    kind, low = X.binary_kind(F.col("content")), F.lower("path")
    return flagged(files, ["scan_id", "path"], {
        "native_binary": (kind.isin("elf", "pe", "macho", "wasm"), kind), "nested_archive": (kind.isin("zip", "gzip") & ~low.rlike(r"\.(?:docx|xlsx|pptx|jar|whl|odt)$"), kind),
        "bytecode": (low.rlike(r"\.py[co]$"), F.lit("compiled Python")), "windows_name": (X.windows_hazard(F.col("path")), F.lit("name that Windows cannot take")), "double_extension": (low.rlike(r"\.(?:pdf|docx?|txt|png|jpe?g)\.(?:exe|sh|bat|cmd|js|py|ps1)$"), F.col("path")),
    })


def bytecode_without_source(files: DataFrame) -> DataFrame:
    """Compiled files next to whose place no source lies, or whose recorded source size differs (scan_id, path, detail)."""
    low = F.lower("path")
    name = F.regexp_replace(F.regexp_replace("path", r"(?:^|(?<=/))__pycache__/", ""), r"(?i)(?:\.cpython-\d+)?(?:\.opt-\d)?\.py[co]$", ".py")
    size = reduce(lambda a, b: a + b, [F.conv(F.hex(F.substring("content", 13 + i, 1)), 16, 10).cast("bigint") * (1 << (8 * i)) for i in range(4)])
    code = files.filter(low.rlike(r"\.py[co]$")).select("scan_id", "path", name.alias("source"), F.when(F.octet_length("content") >= 16, size).alias("size"))
    have = files.select("scan_id", F.col("path").alias("source"), F.octet_length("content").alias("n"))
    j = code.join(have, ["scan_id", "source"], "left")
    return j.filter(F.col("n").isNull() | (F.col("size") != F.col("n"))).select("scan_id", "path", F.when(F.col("n").isNull(), "no source").otherwise("other source size").alias("detail"))


# ---------------------------------------------------------------- client configurations

# Commands that take a program as text, and the switches for it.
_SHELLS = ("sh", "bash", "zsh", "dash", "cmd", "powershell", "pwsh")
_INLINE = ("-c", "/c", "-command", "-e", "--eval", "-encodedcommand")


def servers(specs: DataFrame, key: list[str]) -> DataFrame:
    """Settings of MCP servers (command, args, url, transport, env_names, …)."""
    exe = F.regexp_replace(F.lower(X.base_name(F.regexp_replace(F.coalesce("command", F.lit("")), r"\\", "/"))), r"\.(?:exe|cmd|bat)$", "")
    args = F.coalesce("args", F.array().cast("array<string>"))
    low = F.transform(args, F.lower)
    host = X.url_host(F.col("url"))
    package = F.filter(args, lambda x: ~x.startswith("-"))
    runner = exe.isin("npx", "uvx", "bunx", "pipx", "pnpx")
    docker = exe.isin("docker", "podman")
    first = F.try_element_at(package, F.lit(1))
    return flagged(specs, key, {
        "shell_command": (exe.isin(*_SHELLS), exe), "inline_code": (F.arrays_overlap(low, F.array(*[F.lit(x) for x in _INLINE])), F.array_join(args, " ")), "shell_expansion": (F.exists(args, lambda x: x.rlike(r"\$\(|`|&&|\|\||;\s")), F.array_join(args, " ")),
        "unpinned_package": (runner & (X.pin_status(first) != "exact"), first), "docker_socket": (docker & F.exists(args, lambda x: F.contains(x, F.lit("docker.sock"))), F.lit("docker.sock")), "docker_privileged": (docker & F.exists(low, lambda x: x.rlike(r"^--privileged|^--cap-add|^--(?:net|network|pid)=host")), F.array_join(args, " ")), "docker_root_mount": (docker & F.exists(args, lambda x: x.rlike(r"(?:^|[ =,])(?:/|~|/home|/etc|/root)(?::|,)")), F.array_join(args, " ")), "docker_unpinned": (docker & ~F.exists(args, lambda x: x.rlike("@sha256:")), first),
        "plain_http": (F.lower("url").startswith("http://") & ~X.is_loopback(host), F.col("url")), "private_address": (X.is_private_address(host), host), "secret_in_url": (F.col("url").rlike(r"(?i)[?&](?:token|key|api_?key|secret|password)=[^&\s]{6,}|://[^/@\s:]+:[^/@\s]+@"), host), "binds_everywhere": (F.exists(args, lambda x: x.rlike(r"\b0\.0\.0\.0\b")), F.array_join(args, " ")),
        "old_transport": (F.col("transport") == "sse_deprecated", F.col("transport")), "loads_code_by_env": (F.exists(F.coalesce("env_names", F.array().cast("array<string>")), lambda x: x.rlike(r"^(?:LD_PRELOAD|LD_LIBRARY_PATH|DYLD_\w+|NODE_OPTIONS|PYTHONSTARTUP|BASH_ENV)(?:=|$)")), F.lit("loader variable")), "tls_off": (F.exists(F.coalesce("env_names", F.array().cast("array<string>")), lambda x: x.rlike(r"^(?:NODE_TLS_REJECT_UNAUTHORIZED|PYTHONHTTPSVERIFY|GIT_SSL_NO_VERIFY)")), F.lit("verification off")),
        "project_stdio": ((F.col("config_scope") == "project") & (F.col("transport") == "stdio"), exe),
    })


# ---------------------------------------------------------------- tools


def tools(rows: DataFrame, key: list[str]) -> DataFrame:
    """Descriptions and schemas of tools (tool_name, description, input_schema, annotations)."""
    v = F.try_parse_json("input_schema")
    ann = F.try_parse_json("annotations")
    props = F.map_keys(F.try_variant_get(v, "$.properties", "map<string,variant>"))
    text = F.coalesce("description", F.lit(""))
    danger = F.lower("tool_name").rlike(r"(?:^|_)(?:delete|remove|drop|destroy|exec|execute|shell|eval|kill|write|overwrite)(?:_|$)")
    return flagged(rows, key, {
        "long_description": (F.length(text) > 2000, F.length(text)), "hidden_instruction": (text.rlike(r"(?i)<(?:important|system|secret|hidden)>|\bdo not (?:tell|mention|inform)\b|\bbefore (?:using|calling) (?:this|any) tool\b"), F.substring(text, 1, 120)), "side_channel": (F.exists(props, lambda x: F.lower(x).rlike(r"^(?:sidenote|side_note|notes?|context|reasoning|conversation|history|metadata|summary_of_\w+)$")), F.array_join(F.array_sort(props), ",")),
        "dangerous_tool": (danger & ~F.coalesce(F.try_variant_get(ann, "$.destructiveHint", "boolean"), F.lit(False)), F.col("tool_name")), "contradicting_hints": (F.try_variant_get(ann, "$.readOnlyHint", "boolean") & F.try_variant_get(ann, "$.destructiveHint", "boolean"), F.col("annotations")), "open_schema": (F.try_variant_get(v, "$.additionalProperties", "boolean"), F.lit("additionalProperties")), "no_schema": (v.isNull(), F.lit("no readable schema")), "no_description": (F.trim(text) == "", F.col("tool_name")),
    })


def declared_against_handler(tool_rows: DataFrame, handler: DataFrame, key: list[str]) -> DataFrame:
    """(key, tool_name, undeclared): what the code of a handler does and neither name nor description of its tool tells.

    handler: key, tool_name, label. A label counts as declared if one of its words stands in the tool's text.
    """
    told = F.lower(F.concat_ws(" ", "tool_name", "description", "annotations"))
    words = {"external_egress": r"http|send|fetch|url|web|download|upload|api", "reads_private_data": r"file|read|path|document|mail|note|secret", "code_exec": r"exec|run|command|shell|script|eval", "destructive": r"delete|remove|write|drop|destroy|overwrite", "persistence": r"store|save|memory|remember|persist"}
    j = tool_rows.join(handler.distinct(), [*key, "tool_name"])
    telling = reduce(lambda acc, kv: acc | ((F.col("label") == kv[0]) & told.rlike(kv[1])), words.items(), F.lit(False))
    return j.filter(~telling).groupBy(*key, "tool_name").agg(F.array_sort(F.collect_set("label")).alias("undeclared"))


# ---------------------------------------------------------------- recorded facts


def probes(p: DataFrame) -> DataFrame:
    """Recorded probes of remote servers (server_name, url, reachable, tls_version, status_unauth, prm JSON, as_metadata JSON)."""
    prm, meta = F.try_parse_json("prm"), F.try_parse_json("as_metadata")
    https = lambda c: c.isNotNull() & ~F.lower(c).startswith("https://")
    return flagged(p.filter("reachable"), ["server_name"], {
        "no_auth": (F.col("status_unauth") == 200, F.col("url")), "old_tls": (F.col("tls_version").isin("TLSv1", "TLSv1.1", "SSLv3"), F.col("tls_version")), "no_resource_metadata": ((F.col("status_unauth") == 401) & prm.isNull(), F.col("url")), "wrong_resource": (F.try_variant_get(prm, "$.resource", "string") != F.col("url"), F.try_variant_get(prm, "$.resource", "string")),
        "no_pkce": (meta.isNotNull() & ~F.coalesce(F.array_contains(F.try_variant_get(meta, "$.code_challenge_methods_supported", "array<string>"), "S256"), F.lit(False)), F.lit("S256")), "plain_issuer": (https(F.try_variant_get(meta, "$.issuer", "string")), F.try_variant_get(meta, "$.issuer", "string")), "plain_token_endpoint": (https(F.try_variant_get(meta, "$.token_endpoint", "string")), F.try_variant_get(meta, "$.token_endpoint", "string")),
    })


def package_facts(packages: DataFrame, facts: DataFrame, today: Column, young: int = 30) -> DataFrame:
    """Packages (component, package) against recorded facts (package, created, provenance, vulns)."""
    j = packages.join(facts, "package")
    age = F.datediff(today, "created")
    base = flagged(j, ["component", "package"], {"young_package": (age < young, age), "no_provenance": (~F.coalesce("provenance", F.lit(False)), F.lit("no provenance"))})
    v = j.select("component", "package", F.explode("vulns").alias("v"))
    return base.unionByName(v.select("component", "package", F.concat(F.lit("known_vulnerability:"), F.coalesce("v.severity", F.lit("medium"))).alias("rule"), F.col("v.id").alias("detail")))


def judged(components: DataFrame, results: DataFrame) -> DataFrame:
    """Recorded verdicts of a model that fit a component's content (component, content_hash); confidence is medium at most."""
    r = results.withColumn("v", F.try_parse_json("verdict"))
    bad = r.filter(F.try_variant_get("v", "$.verdict", "string").isin("malicious", "suspicious"))
    j = components.join(bad, ["component", "content_hash"])
    conf = F.when(F.try_variant_get("v", "$.confidence", "double") >= 0.5, "medium").otherwise("low")
    return j.select("component", F.try_variant_get("v", "$.verdict", "string").alias("verdict"), conf.alias("confidence"), F.lit("llm").alias("source"))


def namespace_mismatch(registry: DataFrame) -> DataFrame:
    """Registry entries whose namespace does not name the owner of their repository (name, repository)."""
    ns = F.lower(F.regexp_extract("name", r"^(?:io\.github\.|com\.github\.)?([^/]+)/", 1))
    owner = F.lower(F.regexp_extract("repository", r"github\.com/([^/]+)/", 1))
    return registry.filter((ns != "") & (owner != "") & (ns != owner)).select("name", ns.alias("namespace"), owner.alias("owner"))


def policy(servers_: DataFrame, deny: list[str], allow: list[str] | None, require_pinning: bool) -> DataFrame:
    """Servers (server_name, pinned, transport) against a policy; a denied server is not looked at further."""
    hit = lambda globs: reduce(lambda a, g: a | F.col("server_name").rlike(X.glob_regex(g)), globs, F.lit(False))
    denied = hit(deny)
    out = F.when(denied, "denied").when(~hit(allow), "not_allowed") if allow is not None else F.when(denied, "denied")
    if require_pinning:
        out = out.when((F.col("transport") == "stdio") & ~F.coalesce("pinned", F.lit(False)), "not_pinned")
    return servers_.withColumn("rule", out).filter("rule is not null").select("server_name", "rule").distinct()


def limit_events(events: DataFrame, names: dict[str, str]) -> DataFrame:
    """Events of limits as rows of the rules that stand for them; kinds without an entry are no findings."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return events.withColumn("rule", F.try_element_at(table, F.col("kind"))).filter("rule is not null").select("scan_id", "rule", "path", "detail")


# ---------------------------------------------------------------- skills


def skills(front: DataFrame, key: list[str], known: list[str]) -> DataFrame:
    """Frontmatter of skills (found, error, name, description, tools, repeated, keys) against the format's rules."""
    odd = F.array_except("keys", F.array(*[F.lit(k) for k in known]))
    return flagged(front, key, {
        "no_frontmatter": (~F.col("found"), F.lit("")), "broken_frontmatter": (F.col("error") != "", F.col("error")), "bad_name": (F.col("found") & ~F.col("name").rlike(r"^[a-z0-9](?:[a-z0-9-]{0,62}[a-z0-9])?$"), F.col("name")), "no_description": (F.col("found") & (F.trim("description") == ""), F.lit("")), "long_description": (F.length("description") > 1024, F.length("description")),
        "repeated_keys": (F.size("repeated") > 0, F.array_join("repeated", ",")), "unknown_keys": (F.size(odd) > 0, F.array_join(F.array_sort(odd), ",")), "every_tool": (F.exists("tools", lambda t: t.rlike(r"^(?:\*|Bash(?:\(\*?\))?)$")), F.array_join("tools", ",")),
    })


# What code does, by capability label.
CODE = {
    "external_egress": r"\b(?:requests|httpx|aiohttp|axios|urllib\.request|urlopen|fetch|got)\b\s*[.(]|\bcurl\s|\bwget\s", "code_exec": r"\b(?:subprocess\.|os\.system|os\.popen|eval\(|exec\(|child_process|execSync|spawn\()", "reads_private_data": r"~/\.(?:ssh|aws|netrc|config)|/etc/passwd|\bid_rsa\b|\.env\b|keychain|credentials\.json",
    "destructive": r"\b(?:shutil\.rmtree|os\.remove|os\.unlink|unlinkSync|rmSync|DROP\s+TABLE)\b|\brm\s+-rf?\b", "persistence": r"\bcrontab\b|LaunchAgents|\.bashrc|\.zshrc|\.profile\b|systemctl\s+enable|CLAUDE\.md|AGENTS\.md",
}


def code_capabilities(files: DataFrame, key: list[str]) -> DataFrame:
    """(key, label, line): the first line of each file that shows a capability."""
    lines = files.select(*key, F.posexplode(F.split("text", "\n")).alias("n", "line_text")).filter(~X.is_comment_line(F.col("line_text")))
    found = F.filter(F.array(*[F.when(F.col("line_text").rlike(rx), F.lit(k)) for k, rx in CODE.items()]), lambda x: x.isNotNull())
    return lines.select(*key, F.explode(found).alias("label"), (F.col("n") + 1).alias("line")).groupBy(*key, "label").agg(F.min("line").alias("line"))
