"""From raw emissions to findings: identity, first-wins merge, severity, score, suppression, baseline, difference.

A raw row has: scan_id, seq (order of emission), rule_id, components (sorted names), path, line, match_key, message,
severity, confidence, hidden, source, tags, snippet.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as X

#: Parts into which the rows of one fingerprint are cut.
SALT = 32
#: Suppressions by path alone.
MOST_SUPPRESSIONS = 1000
SEVERITIES = ["critical", "high", "medium", "low", "info"]
# Score of a severity whose rule names none, weight of a threat's status.
BASE = {"critical": 9.3, "high": 7.7, "medium": 5.3, "low": 2.1, "info": 0.0}
THREAT = {"attacked": 1.0, "poc": 0.97, "unreported": 0.5}


def rank(c: Column) -> Column:
    """5 for critical down to 1 for info."""
    out = None
    for i, s in enumerate(SEVERITIES):
        out = F.when(c == s, 5 - i) if out is None else out.when(c == s, 5 - i)
    return out


def severity_of(r: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in reversed(SEVERITIES)]), r.cast("int"))


def confidence_rank(c: Column) -> Column:
    return F.when(c == "high", 3).when(c == "medium", 2).otherwise(1)


def fingerprint(rule: Column, components: Column, path: Column, match_key: Column) -> Column:
    return X.short_hash(F.concat_ws("|", rule, F.array_join(components, ","), F.coalesce(path, F.lit("")), F.coalesce(match_key, F.lit(""))), 32)


def settle(raw: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Severity in its fixed order: own, one up if hidden, a policy's override, high at most for model sources, high at
    most without high confidence."""
    up = F.when(F.col("hidden"), F.least(rank(F.col("severity")) + 1, F.lit(5))).otherwise(rank(F.col("severity")))
    df = raw.withColumn("__r", up)
    if overrides is not None:
        df = df.join(overrides.select("rule_id", F.col("severity").alias("__o")), "rule_id", "left").withColumn("__r", F.coalesce(rank(F.col("__o")), F.col("__r"))).drop("__o")
    df = df.withColumn("__r", F.when((F.col("source") == "llm") & (F.col("__r") == 5), 4).otherwise(F.col("__r")))
    capped = (F.col("__r") == 5) & (F.col("confidence") != "high")
    tags = F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.filter(F.array(F.when(F.col("hidden"), "hidden"), F.when(capped, "capped-by-confidence")), lambda x: x.isNotNull()))
    return df.withColumn("tags", tags).withColumn("severity", severity_of(F.when(capped, 4).otherwise(F.col("__r")))).drop("__r")


def finalize(raw: DataFrame, related: int = 20, evidence: int = 10) -> DataFrame:
    """One row per scan and fingerprint. The first emission gives message, confidence and place, the highest severity
    counts, tags are united; further places and snippets are kept in order up to a bound (the total is kept too)."""
    fp = raw.withColumn("fingerprint", fingerprint(F.col("rule_id"), F.col("components"), F.col("path"), F.col("match_key")))
    key = ["scan_id", "fingerprint"]
    # Totals combine before the shuffle. Of the rest only the first rows per fingerprint are needed: they are picked
    # in salted parts first, so that a fingerprint that holds most rows is not sorted in one task.
    totals = fp.groupBy(*key).agg(severity_of(F.max(rank(F.col("severity")))).alias("severity"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"), F.count("*").alias("n"))
    most = max(related + 1, evidence)
    cols = ["seq", "rule_id", "components", "path", "line", "message", "confidence", "source", "snippet"]
    few = fp.select(*key, *cols, F.pmod(F.xxhash64("seq"), F.lit(SALT)).alias("__s"))
    few = few.withColumn("__n", F.row_number().over(Window.partitionBy(*key, "__s").orderBy("seq"))).filter(F.col("__n") <= most)
    few = few.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy("seq"))).filter(F.col("__n") <= most)
    first = lambda c: F.min_by(c, "__n").alias(c)
    place = F.struct("path", "line")
    heads = few.groupBy(*key).agg(
        *[first(c) for c in cols if c not in ("seq", "snippet")],
        F.array_sort(F.collect_list(F.when((F.col("__n") > 1) & (F.col("__n") <= related + 1), F.struct("__n", place.alias("at"))))).alias("related"),
        F.array_sort(F.collect_list(F.when(F.col("__n") <= evidence, F.struct("__n", "snippet")))).alias("evidence"),
    )
    return totals.join(heads, key).withColumn("related", F.transform("related", lambda x: x["at"])).withColumn("evidence", F.transform("evidence", lambda x: x["snippet"]))


def in_order(findings: DataFrame) -> DataFrame:
    """Findings in their fixed order."""
    return findings.orderBy(F.desc(rank(F.col("severity"))), "rule_id", "path", "line", "fingerprint")


def histogram(findings: DataFrame, *keys: str) -> DataFrame:
    """Findings per severity, zeros included, in one row per key."""
    return findings.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES], F.count("*").alias("total"))


def summary(h: DataFrame) -> DataFrame:
    """A sentence for each row of `histogram`."""
    parts = F.array_join(F.filter(F.array(*[F.when(F.col(s) > 0, F.concat_ws(" ", F.col(s).cast("string"), F.lit(s))) for s in SEVERITIES]), lambda x: x.isNotNull()), ", ")
    return h.withColumn("summary", F.when(F.col("total") == 0, "No findings.").otherwise(F.concat(F.col("total").cast("string"), F.lit(" findings ("), parts, F.lit(")."))))


def capability_factor(capabilities: DataFrame) -> DataFrame:
    """(scan_id, component, factor): 1 per observed label of high confidence, else a half, at most 10."""
    best = capabilities.filter("observed").groupBy("scan_id", "component", "label").agg(F.max(confidence_rank(F.col("confidence"))).alias("c"))
    return best.groupBy("scan_id", "component").agg(F.least(F.sum(F.when(F.col("c") == 3, 1.0).otherwise(0.5)), F.lit(10.0)).alias("factor"))


def score(severity: Column, rule_severity: Column, cvss: Column, threat: Column, factor: Column) -> Column:
    """base + (10 - base) * factor / 10 * threat, at most 10, one decimal; the rule's own base counts only at its own severity."""
    table = F.create_map(*[F.lit(x) for kv in BASE.items() for x in kv])
    weight = F.create_map(*[F.lit(x) for kv in THREAT.items() for x in kv])
    base = F.when(cvss.isNotNull() & (severity == rule_severity), cvss).otherwise(F.try_element_at(table, severity))
    value = F.least(F.lit(10.0), base + (10.0 - base) * (F.coalesce(factor, F.lit(0.0)) / 10.0) * F.try_element_at(weight, threat))
    return F.when(severity == "info", 0.0).otherwise(F.round(value, 1))


def suppress(findings: DataFrame, rules: DataFrame, today: dt.date) -> DataFrame:
    """Adds suppression (active, expired or null), reason and expires: the first valid rule (ord) that fits a finding.

    rules: ord, rule_id, fingerprint, path_regex (each null for any, but not all), reason (10 characters at least),
    expires. Rules by path alone are written by hand; more than 1 000 of them are refused.
    """
    valid = rules.filter((F.length("reason") >= 10) & F.col("expires").isNotNull()).select("ord", F.col("rule_id").alias("s_rule"), F.col("fingerprint").alias("s_fp"), F.col("path_regex").alias("s_path"), "reason", "expires")
    by_path = valid.filter("s_rule is null and s_fp is null and s_path is not null").orderBy("ord").limit(MOST_SUPPRESSIONS + 1).collect()
    if len(by_path) > MOST_SUPPRESSIONS:
        raise ValueError("too many suppressions by path alone")
    slim = findings.select("scan_id", "fingerprint", "rule_id", F.coalesce("path", F.lit("")).alias("path"))
    fits = (F.col("s_fp").isNull() | (F.col("s_fp") == F.col("fingerprint"))) & (F.col("s_path").isNull() | F.rlike("path", F.col("s_path")))
    cols = ["scan_id", "fingerprint", "ord", "reason", "expires"]
    # Rules that name a rule or a fingerprint meet the findings by equality; those by path alone are tried row by row.
    some = slim.join(valid.filter("s_rule is not null"), F.col("rule_id") == F.col("s_rule")).filter(fits).select(cols)
    some = some.unionByName(slim.join(valid.filter("s_rule is null and s_fp is not null"), F.col("fingerprint") == F.col("s_fp")).filter(fits).select(cols))
    if by_path:
        table = F.array(*[F.struct(F.lit(r["ord"]).alias("ord"), F.lit(r["s_path"]).alias("rx"), F.lit(r["reason"]).alias("reason"), F.lit(r["expires"]).alias("expires")) for r in by_path])
        first = F.try_element_at(F.filter(table, lambda r: F.rlike(F.col("path"), r["rx"])), F.lit(1))
        some = some.unionByName(slim.select("scan_id", "fingerprint", first.alias("x")).filter("x is not null").select("scan_id", "fingerprint", "x.ord", "x.reason", "x.expires"))
    hit = some.groupBy("scan_id", "fingerprint").agg(F.min_by(F.struct("reason", "expires"), "ord").alias("s"))
    out = findings.join(hit, ["scan_id", "fingerprint"], "left")
    state = F.when(F.col("s").isNull(), F.lit(None)).when(F.col("s.expires") < F.lit(today), "expired").otherwise("active")
    return out.withColumn("suppression", state).withColumn("reason", F.col("s.reason")).withColumn("expires", F.col("s.expires")).drop("s")


def against_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings that the baseline (fingerprint) does not hold."""
    return findings.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti")


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(fingerprint, state): added, removed or unchanged between two reports."""
    a, b = (x.select("fingerprint").distinct() for x in (old, new))
    joined = a.withColumn("o", F.lit(1)).join(b.withColumn("n", F.lit(1)), "fingerprint", "full_outer")
    return joined.select("fingerprint", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("unchanged").alias("state"))


def changed_only(findings: DataFrame, artifacts: DataFrame, changed: DataFrame, always: str = "^(?:POL|SYS)") -> DataFrame:
    """Findings of components with a changed file, findings on changed paths, and findings of policy rules."""
    touched = artifacts.join(changed.select("scan_id", "path").distinct(), ["scan_id", "path"], "left_semi").select("scan_id", "component").distinct()
    by_part = findings.select("scan_id", "fingerprint", F.explode("components").alias("component")).join(touched, ["scan_id", "component"], "left_semi").select("scan_id", "fingerprint")
    by_path = findings.join(changed.select("scan_id", "path").distinct(), ["scan_id", "path"], "left_semi").select("scan_id", "fingerprint")
    by_rule = findings.filter(F.col("rule_id").rlike(always)).select("scan_id", "fingerprint")
    return findings.join(by_part.unionByName(by_path).unionByName(by_rule).distinct(), ["scan_id", "fingerprint"], "left_semi")


def exit_code(findings: DataFrame, errored: DataFrame, fail_on: str = "high") -> DataFrame:
    """(scan_id, code): 2 if an analyzer failed, 1 if a finding is at least `fail_on`, else 0."""
    worst = findings.groupBy("scan_id").agg(F.max(rank(F.col("severity"))).alias("r"))
    bad = errored.select("scan_id").distinct().withColumn("e", F.lit(1))
    return worst.join(bad, "scan_id", "full_outer").select("scan_id", F.when(F.col("e") == 1, 2).when(F.col("r") >= 5 - SEVERITIES.index(fail_on), 1).otherwise(0).alias("code"))


def report_key(*parts: Column) -> Column:
    """Cache key of a report: hash over its parts as JSON with sorted names."""
    return X.sha256(F.to_json(F.struct(*parts)))
