"""Files and archives as tables, under limits; what is refused becomes a row of events."""

from __future__ import annotations

import io
import os
import re
import stat
import tarfile
import zipfile
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as X

FILES = "scan_id string, path string, content binary, length bigint"
EVENTS = "scan_id string, kind string, path string, detail string"


@dataclass(frozen=True)
class Limits:
    """What one scan may hold."""

    file_bytes: int = 4 << 20
    total_bytes: int = 256 << 20
    files: int = 20_000
    depth: int = 32
    ratio: int = 100


#: Directories that are never read.
EXCLUDED = (".git", "node_modules", "__pycache__", ".venv", "venv", ".tox", "dist", "build", ".mypy_cache", ".pytest_cache")


def read_paths(paths: DataFrame) -> DataFrame:
    """The rows of paths (file, …) with `content`, read by the tasks from a folder that all of them see; null if unreadable.

    Spark's own file sources pass over names that begin with a dot, which are the ones that matter here.
    """
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in paths.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, f in enumerate(b.column(b.schema.get_field_index("file")).to_pylist()):
                try:
                    with open(f, "rb") as h:
                        data = h.read()
                except OSError:
                    data = None
                row = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([data], pa.binary())], names=[*row.schema.names, "content"])

    return paths.mapInArrow(run, f"{head}, content binary")


def scan_folder(spark: SparkSession, folder: str, scan_id: str, limits: Limits | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, events) of a folder, recursively: regular files only, links are not followed, excluded directories are
    pruned, oversized files become events unread. Folders with a scheme (s3a:, hdfs:, …) are read by Spark's binary
    file source, which leaves out names that begin with a dot."""
    limits = limits or Limits()
    if ":" in folder and not folder.startswith("file:"):
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        rel = F.regexp_replace("path", "^.*?" + re.escape(folder.rstrip("/").split(":", 1)[1].lstrip("/")) + "/", "")
        got = raw.select(F.lit(scan_id).alias("scan_id"), rel.alias("path"), "content", "length").filter(F.col("length") <= limits.file_bytes)
        files, events = admit(got, limits)
        return files, events
    root = folder.removeprefix("file://").rstrip("/")
    rows, odd = [], []
    for d, dirs, names in os.walk(root):
        links = [x for x in dirs if os.path.islink(os.path.join(d, x))]
        dirs[:] = sorted(x for x in dirs if x not in EXCLUDED and x not in links)
        for n in sorted([*names, *links]):
            full = os.path.join(d, n)
            rel = os.path.relpath(full, root).replace(os.sep, "/")
            mode = os.lstat(full).st_mode
            if stat.S_ISLNK(mode):
                odd.append((scan_id, "symlink", rel, ""))
            elif not stat.S_ISREG(mode):
                odd.append((scan_id, "special_file", rel, ""))
            elif os.path.getsize(full) > limits.file_bytes:
                odd.append((scan_id, "too_large", rel, f"{os.path.getsize(full)} bytes"))
            else:
                rows.append((scan_id, rel, os.path.getsize(full), full))
    listed = spark.createDataFrame(rows, "scan_id string, path string, length bigint, file string")
    fit, events = admit(listed, limits)
    files = read_paths(fit.repartition(max(1, min(len(rows) // 64, 10_000)))).select("scan_id", "path", "content", "length")
    return files, events.unionByName(spark.createDataFrame(odd, EVENTS))


# Where clients keep their configuration, below the home directory and below a project.
HOME_FILES = (".claude.json", ".claude/settings.json", ".cursor/mcp.json", ".codeium/windsurf/mcp_config.json", ".gemini/settings.json", ".codex/config.toml", ".config/zed/settings.json", ".config/Code/User/mcp.json", ".config/Claude/claude_desktop_config.json", "Library/Application Support/Claude/claude_desktop_config.json", "Library/Application Support/Code/User/mcp.json", "AppData/Roaming/Claude/claude_desktop_config.json", "AppData/Roaming/Code/User/mcp.json")
PROJECT_FILES = (".mcp.json", ".claude/settings.json", ".claude/settings.local.json", ".cursor/mcp.json", ".vscode/mcp.json", ".gemini/settings.json", ".codex/config.toml", ".zed/settings.json", "server.json", "mcp.json")


def discover(spark: SparkSession, home: str | None = None, project: str | None = None) -> DataFrame:
    """(path, content, length, client, scope): client configurations that exist at their known places, and every
    SKILL.md of a project. Paths are looked up by the driver; contents are read by the tasks."""
    from skein.sources.configs import client_of

    found = [os.path.join(base, f) for base, names in ((home, HOME_FILES), (project, PROJECT_FILES)) if base for f in names if os.path.isfile(os.path.join(base, f))]
    for d, dirs, names in os.walk(project) if project else ():
        dirs[:] = sorted(x for x in dirs if x not in EXCLUDED)
        found += [os.path.join(d, n) for n in names if n.lower() == "skill.md"]
    if not found:
        return spark.createDataFrame([], "path string, content binary, length bigint, client string, scope string")
    df = read_paths(spark.createDataFrame([(p, os.path.getsize(p), p) for p in found], "path string, length bigint, file string")).select("path", "content", "length")
    c = client_of(F.col("path"))
    return df.select("path", "content", "length", c["client"].alias("client"), c["scope"].alias("scope"))


def from_mapping(spark: SparkSession, files: Mapping[str, bytes], scan_id: str = "scan") -> DataFrame:
    """Files held in memory; paths are brought into one writing and those that must be refused are left out."""
    df = spark.createDataFrame([(scan_id, p, bytearray(b)) for p, b in sorted(files.items())], "scan_id string, path string, content binary")
    return df.withColumn("path", X.member_path(F.col("path"))).filter("path is not null").withColumn("length", F.octet_length("content").cast("bigint"))


def admit(files: DataFrame, limits: Limits | None = None) -> tuple[DataFrame, DataFrame]:
    """(admitted, events): files in order of path as long as the scan stays under its limits.

    A file that is refused takes up nothing. Scans whose totals are under the limits pass by sums alone; only scans
    over a limit are walked in order, on paths and sizes without contents.
    """
    limits = limits or Limits()
    deep = F.size(F.split("path", "/")) > limits.depth
    over = F.col("length") > limits.file_bytes
    light = files.select("scan_id", "path", "length", F.when(over, "too_large").when(deep, "too_deep").alias("kind"))
    totals = light.filter("kind is null").groupBy("scan_id").agg(F.count("*").alias("n"), F.sum("length").alias("b"))
    tight = totals.filter((F.col("n") > limits.files) | (F.col("b") > limits.total_bytes)).select("scan_id")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        n = b = 0
        kinds = []
        for length in pdf.sort_values("path", kind="stable").length:
            if n >= limits.files:
                kinds.append("too_many_files")
            elif b + length > limits.total_bytes:
                kinds.append("total_bytes_exceeded")
            else:
                kinds.append(None)
                n, b = n + 1, b + length
        return pdf.sort_values("path", kind="stable").assign(kind=kinds)[["scan_id", "path", "kind"]]

    clear = light.filter("kind is null")
    walked = clear.join(tight, "scan_id", "left_semi").groupBy("scan_id").applyInPandas(walk, "scan_id string, path string, kind string").filter("kind is not null")
    bad = light.filter("kind is not null").select("scan_id", "path", "kind").unionByName(walked)
    return files.join(bad, ["scan_id", "path"], "left_anti"), bad.select("scan_id", "kind", "path", F.lit("").alias("detail"))


def tree_digest(files: DataFrame) -> DataFrame:
    """(scan_id, digest): one hash over the sorted paths and contents of a scan."""
    line = F.concat_ws("\x00", "path", F.sha2("content", 256))
    return files.groupBy("scan_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"))


def running_totals(files: DataFrame) -> DataFrame:
    """Files and bytes of a scan up to each path."""
    w = Window.partitionBy("scan_id").orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return files.select("scan_id", "path", F.count("*").over(w).alias("files"), F.sum("length").over(w).alias("bytes"))


# ---------------------------------------------------------------- archives


def members(data: bytes, limits: Limits, strip: int = 0) -> Iterator[tuple[str | None, bytes | None, str | None, str]]:
    """(path, content, event, detail) of the members of a zip, tar or tgz; nothing is written, nested archives stay closed."""
    n = total = 0

    def clean(name: str) -> str | None:
        p = name.replace("\\", "/")
        parts = [x for x in p.split("/") if x not in ("", ".")][strip:]
        return None if p.startswith("/") or ".." in parts or "\x00" in p or ":" in p or not parts else "/".join(parts)

    def read(f, size: int, packed: int) -> tuple[bytes | None, str | None]:  # noqa: ANN001
        if size > limits.file_bytes:
            return None, "too_large"
        if packed and size > limits.ratio * packed and size > 1 << 16:
            return None, "archive_bomb"
        got = f.read(limits.file_bytes + 1)
        if len(got) > limits.file_bytes:
            return None, "too_large"
        return (got, None) if total + len(got) <= limits.total_bytes else (None, "total_bytes_exceeded")

    try:
        if data[:2] == b"PK":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for i in z.infolist():
                    if i.is_dir():
                        continue
                    path, kind = clean(i.filename), (i.external_attr >> 28) & 0xF
                    event = "encrypted_member" if i.flag_bits & 1 else "symlink" if kind == 0xA else "special_file" if kind in (0x1, 0x2, 0x6, 0xC) else "path_escape" if path is None else "too_many_files" if n >= limits.files else "too_deep" if path.count("/") >= limits.depth else None
                    content = None
                    if not event:
                        with z.open(i) as f:
                            content, event = read(f, i.file_size, i.compress_size)
                    if event:
                        yield None, None, event, i.filename
                    else:
                        n, total = n + 1, total + len(content)
                        yield path, content, None, ""
        else:
            with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
                for m in t:
                    if m.isdir():
                        continue
                    path = clean(m.name)
                    event = "symlink" if m.issym() else "hardlink" if m.islnk() else "special_file" if not m.isreg() else "path_escape" if path is None else "too_many_files" if n >= limits.files else "too_deep" if path.count("/") >= limits.depth else None
                    content = None
                    if not event:
                        content, event = read(t.extractfile(m), m.size, 0)
                        if total + m.size > limits.ratio * max(len(data), 1 << 16):
                            event = "archive_bomb"
                    if event:
                        yield None, None, event, m.name
                        if event == "archive_bomb":
                            return
                    else:
                        n, total = n + 1, total + len(content)
                        yield path, content, None, ""
    except (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError, zlib.error, NotImplementedError, RuntimeError, ValueError) as e:
        yield None, None, "archive_error", type(e).__name__


def open_archives(archives: DataFrame, limits: Limits | None = None, strip: int = 0) -> DataFrame:
    """(scan_id, path, content, length, event, detail) of archives (scan_id, content); event is null for a member."""
    limits = limits or Limits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for scan, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = list(members(data or b"", limits, strip))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([scan] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([len(r[1]) if r[1] is not None else None for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.string())],
                    names=["scan_id", "path", "content", "length", "event", "detail"],
                )

    return archives.select("scan_id", "content").mapInArrow(run, FILES + ", event string, detail string")
