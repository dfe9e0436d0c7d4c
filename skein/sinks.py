"""Report formats: JSON, SARIF, Markdown, HTML, CycloneDX, badge, and the table of stored reports."""

from __future__ import annotations

import html
import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators.findings import SEVERITIES, in_order, rank

#: Findings that a page for readers lists; the rest is counted.
LISTED = 50
_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
_COLOUR = {"critical": "#b3261e", "high": "#d9480f", "medium": "#b08900", "low": "#2f6f4f", "info": "#57606a", "none": "#2f6f4f"}


def to_json(findings: DataFrame) -> DataFrame:
    """(scan_id, report): one JSON text per scan, findings in their fixed order."""
    f = F.struct(*[c for c in findings.columns if c != "scan_id"])
    key = F.struct((-rank(F.col("severity"))).alias("r"), "rule_id", "path", "line", "fingerprint")
    return findings.groupBy("scan_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), f.alias("f")))), lambda x: x["f"])).alias("findings")).select("scan_id", F.concat(F.lit('{"schema_version":"1.0","findings":'), F.col("findings"), F.lit("}")).alias("report"))


def export_rules(rules: DataFrame, patterns: DataFrame, mappings: DataFrame) -> DataFrame:
    """(rule_id, entry): every rule of a pack as a JSON object with its patterns and its mappings (rule_id, framework, ref), in order."""
    pats = patterns.groupBy("rule_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_ord", "pattern"))), lambda x: x["pattern"]).alias("patterns"))
    maps = mappings.groupBy("rule_id").agg(F.array_sort(F.collect_set(F.struct("framework", "ref"))).alias("mappings"))
    j = rules.join(pats, "rule_id", "left").join(maps, "rule_id", "left")
    nothing = F.array()
    parts = [F.col("rule_id").alias("id"), "version", "title", "description", "severity", "confidence", "remediation", F.col("kind").alias("match_type"), F.coalesce("patterns", nothing.cast("array<string>")).alias("patterns"), F.coalesce("mappings", nothing.cast("array<struct<framework:string,ref:string>>")).alias("mappings")]
    return j.select("rule_id", F.to_json(F.struct(*parts)).alias("entry"))


def sarif(findings: DataFrame, rules: DataFrame, tool: str = "skein") -> str:
    """A SARIF 2.1.0 log of one scan; findings stream through the driver."""
    order = {r["rule_id"]: i for i, r in enumerate(rules.select("rule_id").distinct().orderBy("rule_id").collect())}
    about = {r["rule_id"]: r for r in rules.collect()}
    results = []
    for r in in_order(findings).toLocalIterator():
        place = [{"physicalLocation": {"artifactLocation": {"uri": r["path"]}, "region": {"startLine": max(1, r["line"] or 1)}}}] if r["path"] else []
        results.append({"ruleId": r["rule_id"], "ruleIndex": order.get(r["rule_id"], -1), "level": _LEVEL[r["severity"]], "message": {"text": r["message"]}, "locations": place, "partialFingerprints": {"primary/v1": r["fingerprint"]}})
    driver = {"name": tool, "rules": [{"id": k, "shortDescription": {"text": about[k]["title"]}} for k in order]}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": results}]}, ensure_ascii=False)


def markdown(findings: DataFrame, title: str) -> str:
    """A page for readers: counts, and the first findings above info."""
    counts = {r["severity"]: r["count"] for r in findings.groupBy("severity").count().collect()}
    out = [f"# {title}", "", ", ".join(f"{counts[s]} {s}" for s in SEVERITIES if s in counts) or "No findings.", ""]
    listed = findings.filter("severity <> 'info'")
    rows = in_order(listed.withColumn("message", X.md_escape(F.col("message")))).limit(LISTED).collect()
    out += [f"- **{r['severity']}** `{r['rule_id']}` {r['message']} (`{r['path']}:{r['line']}`)" for r in rows]
    more = sum(v for k, v in counts.items() if k != "info") - len(rows)
    return "\n".join([*out, *([f"- {more} more"] if more > 0 else []), ""])


def html_page(findings: DataFrame, title: str) -> Iterator[str]:
    """A page without scripts, piece by piece."""
    yield f"<!doctype html><html><head><meta charset='utf-8'><meta http-equiv='Content-Security-Policy' content=\"default-src 'none'; style-src 'unsafe-inline'\"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table>"
    for r in in_order(findings).toLocalIterator():
        cells = (r["severity"], r["rule_id"], r["message"], f"{r['path']}:{r['line']}")
        yield "<tr>" + "".join(f"<td>{html.escape(str(c))}</td>" for c in cells) + "</tr>"
    yield "</table></body></html>"


def cyclonedx(components: DataFrame, name: str) -> str:
    """A CycloneDX 1.6 bill of materials; its serial follows from its contents."""
    parts = [{"type": "library", "bom-ref": r["component"], "name": r["name"], "version": r["version"] or "", "hashes": [{"alg": "SHA-256", "content": r["content_hash"]}] if r["content_hash"] else []} for r in components.select("component", "name", "version", "content_hash").orderBy("component").toLocalIterator()]
    body = json.dumps(parts, sort_keys=True)
    return json.dumps({"bomFormat": "CycloneDX", "specVersion": "1.6", "serialNumber": f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name + body)}", "metadata": {"component": {"type": "application", "name": name}}, "components": parts})


def badge(label: str, worst: str | None) -> str:
    """An SVG badge with the worst severity."""
    text = worst or "none"
    w1, w2 = 7 * len(label) + 12, 7 * len(text) + 12
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{w1 + w2}" height="20" role="img"><rect width="{w1}" height="20" fill="#444"/><rect x="{w1}" width="{w2}" height="20" fill="{_COLOUR[text]}"/><g fill="#fff" font-family="Verdana" font-size="11"><text x="6" y="14">{html.escape(label)}</text><text x="{w1 + 6}" y="14">{text}</text></g></svg>'


def terminal(findings: DataFrame) -> Iterator[str]:
    for r in in_order(findings).toLocalIterator():
        yield f"{r['severity']:<8} {r['rule_id']:<16} {r['path']}:{r['line']} {r['message']}"


def insert_new(stored: DataFrame, fresh: DataFrame, key: str = "report_key") -> DataFrame:
    """What of `fresh` is to be appended to a table of reports: keys not stored yet, one row each."""
    return fresh.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def pruned(stored: DataFrame, time: str, before: str, responses: DataFrame, key: str = "report_key") -> tuple[DataFrame, DataFrame]:
    """(reports kept, responses kept) after reports before a time are dropped."""
    keep = stored.filter(F.col(time) >= F.lit(before).cast("timestamp_ntz"))
    return keep, responses.join(keep.select(key), key, "left_semi")
