"""Data flows over labelled components in one agent session.

Labels: P reads private data, U takes in untrusted content, E sends data out; further destructive, code_exec,
persistence and auto_approved. A capability row has: scan_id, component, tool (null for the whole component), label,
confidence, observed, session ('*' for every session of the scan).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.findings import confidence_rank

FLOW = ["reads_private_data", "ingests_untrusted_content", "external_egress", "destructive", "code_exec", "persistence"]
P, U, E = FLOW[0], FLOW[1], FLOW[2]


def merge_capabilities(caps: DataFrame, most: int = 5) -> DataFrame:
    """One row per component, tool and label: observed by any, declared by any, best confidence, first reasons."""
    return caps.groupBy("scan_id", "component", "tool", "label").agg(
        F.max("observed").alias("observed"), F.max_by("confidence", confidence_rank(F.col("confidence"))).alias("confidence"),
        F.slice(F.array_sort(F.collect_set("reason")), 1, most).alias("reasons"),
    )


def nodes(caps: DataFrame, read_only: DataFrame | None = None) -> DataFrame:
    """(scan_id, session, component, tool, subject, label, conf): the strongest evidence per node and label.

    A label that is only declared is weak; tools marked read-only are not destructive; tools inherit auto-approval.
    """
    conf = F.when(F.col("observed"), confidence_rank(F.col("confidence"))).otherwise(1)
    subject = F.concat_ws("#", "component", "tool")
    base = caps.select("scan_id", "session", "component", "tool", subject.alias("subject"), "label", conf.alias("conf"))
    if read_only is not None:
        marked = read_only.select("scan_id", "component", "tool", F.lit("destructive").alias("label"))
        base = base.join(marked, ["scan_id", "component", "tool", "label"], "left_anti").select(base.columns)
    approved = base.filter("label = 'auto_approved' and tool is null").select("scan_id", "session", "component", "conf")
    tools = base.filter("tool is not null").select("scan_id", "session", "component", "tool", "subject").distinct()
    inherited = tools.join(approved, ["scan_id", "session", "component"]).withColumn("label", F.lit("auto_approved"))
    return base.unionByName(inherited.select(base.columns)).groupBy("scan_id", "session", "component", "tool", "subject", "label").agg(F.max("conf").alias("conf"))


def spread(n: DataFrame) -> DataFrame:
    """Nodes of '*' join every session of their scan; a scan without named sessions has the session '*'."""
    named = n.filter("session <> '*'").select("scan_id", "session").distinct()
    free = n.filter("session = '*'").drop("session")
    lone = free.join(named.select("scan_id").distinct(), "scan_id", "left_anti").withColumn("session", F.lit("*"))
    return n.filter("session <> '*'").unionByName(free.join(named, "scan_id").select(n.columns)).unionByName(lone.select(n.columns))


def best_nodes(n: DataFrame) -> DataFrame:
    """(scan_id, session, label, component, subject, conf): per session and label the strongest node, tools before components."""
    key = F.struct("conf", F.col("tool").isNotNull().alias("is_tool"), "subject")
    return n.groupBy("scan_id", "session", "label").agg(F.max_by(F.struct("component", "subject", "conf"), key).alias("b")).select("scan_id", "session", "label", "b.*")


def _wide(best: DataFrame, labels: list[str]) -> DataFrame:
    cols = [F.max(F.when(F.col("label") == x, F.struct("component", "subject", "conf"))).alias(x) for x in labels]
    return best.groupBy("scan_id", "session").agg(*cols).filter(" and ".join(f"{x} is not null" for x in labels))


def trifecta(n: DataFrame, prose: DataFrame | None = None) -> DataFrame:
    """(scan_id, session, kind, hops, conf): U, P and E in one component ('single') or over several ('spread').

    Components of prose count alone only if P and E are of high confidence.
    """
    n = spread(n)
    per = n.filter(F.col("label").isin(U, P, E)).groupBy("scan_id", "session", "component").pivot("label", [U, P, E]).agg(F.max("conf")).na.drop(subset=[U, P, E])
    if prose is not None:
        weak = per.join(prose.select("scan_id", "component").distinct(), ["scan_id", "component"], "left_semi").filter((F.col(P) < 3) | (F.col(E) < 3))
        per = per.join(weak.select("scan_id", "session", "component"), ["scan_id", "session", "component"], "left_anti")
    single = per.select("scan_id", "session", F.lit("single").alias("kind"), F.array("component").alias("hops"), F.least(U, P, E).alias("conf"))
    w = _wide(best_nodes(n), [U, P, E])
    many = w.filter(F.size(F.array_distinct(F.array(*[F.col(x)["component"] for x in (U, P, E)]))) > 1)
    return single.unionByName(many.select("scan_id", "session", F.lit("spread").alias("kind"), F.array(*[F.col(x)["subject"] for x in (U, P, E)]).alias("hops"), F.least(*[F.col(x)["conf"] for x in (U, P, E)]).alias("conf")))


def pairs(n: DataFrame, exfil: DataFrame | None = None) -> DataFrame:
    """(scan_id, session, kind, hops, conf): two-step flows from untrusted content or private data."""
    n = spread(n)
    best = best_nodes(n)
    out = None
    for first, second in ((U, "code_exec"), (U, "persistence")):
        w = _wide(best, [first, second])
        rows = w.select("scan_id", "session", F.lit(f"{first}>{second}").alias("kind"), F.array(F.col(first)["subject"], F.col(second)["subject"]).alias("hops"), F.least(F.col(first)["conf"], F.col(second)["conf"]).alias("conf"))
        out = rows if out is None else out.unionByName(rows)
    auto = n.filter("label = 'auto_approved'").select("scan_id", "session", "subject")
    kinds = [(U, "destructive", n.filter("label = 'destructive'").join(auto, ["scan_id", "session", "subject"], "left_semi"))]
    if exfil is not None:
        kinds.append((P, E, n.filter(F.col("label") == E).join(exfil.select("scan_id", "component").distinct(), ["scan_id", "component"], "left_semi")))
    for first, second, some in kinds:
        b = some.groupBy("scan_id", "session").agg(F.max_by(F.struct("subject", "conf"), F.struct("conf", "subject")).alias("y"))
        a = best.filter(F.col("label") == first).select("scan_id", "session", F.struct("subject", "conf").alias("x"))
        out = out.unionByName(a.join(b, ["scan_id", "session"]).select("scan_id", "session", F.lit(f"{first}>{second}").alias("kind"), F.array("x.subject", "y.subject").alias("hops"), F.least("x.conf", "y.conf").alias("conf")))
    return out


def paths(flows: DataFrame) -> DataFrame:
    """Adds edges and a sentence to flows."""
    agent = F.when(F.col("session") == "*", "agent").otherwise(F.concat(F.lit("agent:"), F.col("session")))
    edges = F.transform(F.sequence(F.lit(1), F.greatest(F.size("hops") - 1, F.lit(1))), lambda i: F.struct(F.try_element_at("hops", i).alias("src"), F.try_element_at("hops", i + 1).alias("dst"), agent.alias("via")))
    return flows.withColumn("edges", F.filter(edges, lambda e: e["dst"].isNotNull())).withColumn("narrative", F.concat(F.lit("In one session of "), F.col("session"), F.lit(": "), F.array_join("hops", " then ")))


def same_file_or_linked(credential: DataFrame, egress: DataFrame, links: DataFrame, most: int = 3) -> DataFrame:
    """(component, path, via): credential evidence that meets egress in its file, else over at most three links.

    credential, egress: (component, path); links: (component, src, dst, via). At most `most` rows per component and kind
    are reported, in order of path, as in a report of examples.
    """
    from pyspark.sql import Window

    from skein.operators.relate import bounded_paths

    same = credential.select("component", "path").intersect(egress.select("component", "path")).withColumn("via", F.lit("same file"))
    rest = credential.join(same.select("component").distinct(), "component", "left_anti")
    name = lambda c: F.concat_ws("\x00", "component", c)
    way = bounded_paths(links.select(name("src").alias("src"), name("dst").alias("dst"), "via"), rest.select(name("path").alias("node")).distinct(), egress.select(name("path").alias("node")).distinct())
    linked = way.select(F.substring_index("start", "\x00", 1).alias("component"), F.substring_index("start", "\x00", -1).alias("path"), F.array_join(F.transform("path", lambda x: F.substring_index(x, "\x00", -1)), " > ").alias("via"))
    w = Window.partitionBy("component").orderBy("path", "via")
    return same.unionByName(linked).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).drop("n")
