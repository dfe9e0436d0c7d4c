"""Which file belongs to what: roots, nearest owners, roles, identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as X


def skill_roots(files: DataFrame) -> DataFrame:
    """(scan_id, root): directories that hold a skill.md, in any case of letters."""
    return files.filter(F.lower(X.base_name(F.col("path"))) == "skill.md").select("scan_id", X.dir_name(F.col("path")).alias("root")).distinct()


def nearest_owner(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(scan_id, path, root): the deepest root above each path, null if none; an equi-join on the path's ancestors."""
    up = files.select("scan_id", "path", F.posexplode(X.ancestors(F.col("path"))).alias("depth", "root"))
    best = up.join(roots, ["scan_id", "root"]).groupBy("scan_id", "path").agg(F.max_by("root", "depth").alias("root"))
    return files.select("scan_id", "path").join(best, ["scan_id", "path"], "left")


def component_id(kind: Column, root: Column, name: Column, key: Column) -> Column:
    return X.short_hash(F.concat_ws("|", kind, root, name, key))


def file_role(path: Column, in_skill: Column) -> Column:
    """Role of a file; the first that fits counts."""
    name, low = F.lower(X.base_name(path)), F.lower(path)
    script = name.rlike(r"\.(?:py|sh|bash|js|mjs|cjs|ts|ps1|rb|pl)$")
    return (
        F.when(in_skill & (name == "skill.md"), "skill_md").when(in_skill & script, "script").when(in_skill & name.rlike(r"\.(?:md|mdc|txt)$"), "reference").when(in_skill, "asset")
        .when(low.rlike(r"(?:^|/)\.?(?:claude/)?(?:agents|commands)/[^/]+\.md$"), "agent_md").when(name.isin("agents.md", "claude.md", "gemini.md", ".cursorrules", "copilot-instructions.md"), "instruction_md")
        .when(name == "server.json", "server_json").when(name.isin("package.json", "pyproject.toml", "setup.py", "setup.cfg", "requirements.txt"), "package_manifest")
        .when(low.rlike(r"(?:mcp|claude_desktop_config|settings)[^/]*\.(?:json|jsonc|toml)$"), "client_config").when(script, "source").when(name.rlike(r"\.(?:md|mdc)$"), "document").otherwise("other")
    )


def content_hashes(files: DataFrame) -> DataFrame:
    """(scan_id, root, content_hash): hash over the sorted relative paths and file hashes of a component."""
    rel = F.when(F.col("root") == "", F.col("path")).otherwise(F.substring("path", F.length("root") + 2, F.lit(1 << 20)))
    line = F.concat(rel, F.lit("\x00"), F.col("sha256"))
    return files.groupBy("scan_id", "root").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("content_hash"), F.count("*").alias("n_files"))


def publisher(locator: Column) -> Column:
    """Who publishes: the scope of a package or the owner of a repository."""
    return F.coalesce(F.nullif(F.regexp_extract(locator, r"^@([^/]+)/", 1), F.lit("")), F.nullif(F.regexp_extract(locator, r"^(?:[a-z]+:)?(?:https?://)?[^/]+/([^/]+)/", 1), F.lit("")))


def runner_package(command: Column, args: Column) -> Column:
    """The package argument behind a package runner (npx, uvx, …) or the image behind docker; null for other commands."""
    exe = F.regexp_replace(F.lower(X.base_name(F.regexp_replace(command, r"\\", "/"))), r"\.(?:exe|cmd)$", "")
    plain = F.filter(args, lambda x: ~x.startswith("-"))
    image = F.filter(plain, lambda x: ~x.isin("run", "exec", "compose", "pull") & ~x.contains("="))
    return F.when(exe.isin("npx", "bunx", "uvx", "pipx", "pnpx"), F.try_element_at(F.filter(plain, lambda x: ~x.isin("run", "exec", "dlx")), F.lit(1))).when(exe.isin("docker", "podman"), F.try_element_at(image, F.lit(1)))


def merge_live_tools(known: DataFrame, live: DataFrame) -> DataFrame:
    """Tools of a manifest, and those seen live under names that the manifest lacks."""
    return known.unionByName(live.join(known, ["component", "tool_name"], "left_anti"), allowMissingColumns=True)
