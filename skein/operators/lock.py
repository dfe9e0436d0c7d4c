"""Lock files from components, files and tools, and the text that is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build_lock(components: DataFrame, files: DataFrame, tools: DataFrame, labels: DataFrame) -> DataFrame:
    """One entry per component: key, content_hash, files, tools, labels.

    components: scan_id, component, kind, name, root, version, content_hash; files: scan_id, component, path, sha256;
    tools: scan_id, component, tool_name, hash; labels: scan_id, component, label.
    """
    key = ["scan_id", "component"]
    f = files.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("path", "sha256")))).alias("files"))
    t = tools.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("tool_name", "hash")))).alias("tools"))
    g = labels.groupBy(*key).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    name = F.concat(F.col("kind"), F.lit(":"), F.col("name"), F.lit("@"), F.col("root"))
    return components.join(f, key, "left").join(t, key, "left").join(g, key, "left").select("scan_id", name.alias("key"), "kind", "name", "version", "content_hash", "files", "tools", "labels")


def lock_text(lock: DataFrame) -> DataFrame:
    """(scan_id, body): the lock of each scan as one JSON text with entries in order of key."""
    entry = F.to_json(F.struct(F.col("labels").alias("capability_labels"), "content_hash", F.col("files").alias("skill_files"), "key", "kind", "name", "tools", "version"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", entry.alias("e")))), lambda x: x["e"]), ",")
    return lock.groupBy("scan_id").agg(F.concat(F.lit('{"lock_version":1,"tool_hash_version":2,"entries":['), body, F.lit("]}")).alias("body"))
