"""Joins that hide in a static analysis: as-of, longest prefix, suffix, near-equal names, bounded paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions.units import explode_with, osa_distance


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: list[str], strict: bool = True) -> DataFrame:
    """left with the columns `value` of the last row of right before (not `strict`: at) its time, per key.

    Both sides are united and looked back on in blocks of 30 days, so a key that holds most rows is split.
    """
    from skein.operators.carry import carry_last

    whole = F.struct(*[F.col(c) for c in left.columns])
    asked = left.select(*keys, time, whole.alias("__l"), F.lit(0 if strict else 1).alias("__side"))
    r = right.select(*keys, time, F.struct(*[F.col(c) for c in value]).alias("__v"), F.lit(1 if strict else 0).alias("__side"))
    block = F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / (86400 * 30))
    seen = carry_last(asked.unionByName(r, allowMissingColumns=True), keys, [time, "__side"], "__v", "__got", block).filter("__l is not null")
    return seen.select("__l.*", *[F.col("__got")[c].alias(f"prev_{c}") for c in value])


def suffix_join(hosts: DataFrame, host: str, listed: DataFrame, domain: str) -> DataFrame:
    """Rows whose host is a listed domain or lies below one: an equi-join on the host's suffixes, longest first."""
    rows = hosts.select("*", F.posexplode(X.host_suffixes(F.col(host))).alias("__i", "__d"))
    hit = rows.join(listed.withColumnRenamed(domain, "__d"), "__d")
    w = Window.partitionBy(*hosts.columns).orderBy("__i")
    return hit.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__i").withColumnRenamed("__d", domain)


def prefix_join(paths: DataFrame, path: str, roots: DataFrame, root: str) -> DataFrame:
    """Rows with the longest root that is a directory above their path (or '')."""
    up = paths.select("*", F.posexplode(X.ancestors(F.col(path))).alias("__i", "__root")).join(roots.select(F.col(root).alias("__root")).distinct(), "__root")
    return up.groupBy(*paths.columns).agg(F.max_by("__root", "__i").alias(root))


def collisions(rows: DataFrame, name: Column, owner: str, signature: str) -> DataFrame:
    """(name, owners, signatures): equal names with different signatures under more than one owner."""
    return rows.groupBy(F.lower(F.trim(name)).alias("name")).agg(F.count_distinct(owner).alias("owners"), F.count_distinct(signature).alias("signatures")).filter("owners > 1 and signatures > 1")


def deletions(c: Column) -> Column:
    """A word and every word that lacks one of its characters: two words one edit apart share one of these."""
    n = F.length(c)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, n)))
    return F.array_distinct(F.array_append(F.when(n > 0, cut).otherwise(F.array().cast("array<string>")), c))


def near_names(names: DataFrame, name: str, least: int = 4) -> DataFrame:
    """(a, b), a < b: distinct names at optimal-string-alignment distance 1.

    Candidates share a word with one character deleted, so the join is on equality; each is then measured exactly.
    """
    one = names.select(F.col(name).alias("x")).filter(F.length("x") >= least).distinct()
    keys = one.select("x", F.explode(deletions(F.col("x"))).alias("k"))
    pairs = keys.alias("l").join(keys.alias("r"), "k").filter("l.x < r.x").select(F.col("l.x").alias("a"), F.col("r.x").alias("b")).distinct()
    # One deletion on each side also brings pairs two edits apart; Levenshtein is exact but for a swap of neighbours.
    lev = F.levenshtein("a", "b")
    n = F.length("a")
    swap = (lev == 2) & (n == F.length("b")) & F.exists(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.substring("a", F.lit(1), i - 1), F.substring("a", i + 1, F.lit(1)), F.substring("a", i, F.lit(1)), F.substring("a", i + 2, n)) == F.col("b"))
    return pairs.filter((lev == 1) | swap)


def typosquats(names: DataFrame, name: str, popular: list[str]) -> DataFrame:
    """(name, popular, distance) of names close to a popular one but not equal; a list kept by hand, sent to the tasks."""
    table = sorted(set(popular))
    fold = F.translate(F.lower(F.col(name)), "0135", "oles")

    def closest(x: str) -> list[tuple]:
        best = None
        for p in table:
            cap = 1 if len(p) < 8 else 2
            d = osa_distance(x, p, cap)
            if d <= cap and (best is None or d < best[1]):
                best = (p, d)
        return [best] if best else []

    one = names.select(F.col(name).alias("name"), fold.alias("f")).distinct().filter(~F.col("name").isin(table))
    return explode_with(one, "f", closest, "popular string, distance int")


def bounded_paths(edges: DataFrame, starts: DataFrame, goals: DataFrame, hops: int = 3, most_runs: int = 1) -> DataFrame:
    """(start, goal, path): for each start and goal the shortest path of at most `hops` edges (src, dst, via), no node
    twice and at most `most_runs` edges `run`; ties by the names on the path. Unrolled equi-joins on the frontier."""
    e = edges.select("src", "dst", (F.col("via") == "run").cast("int").alias("run")).groupBy("src", "dst").agg(F.min("run").alias("run"))
    front = starts.select(F.col("node").alias("start"), F.col("node").alias("at"), F.array("node").alias("path"), F.lit(0).alias("runs"))
    ends = goals.select(F.col("node").alias("goal")).distinct()
    found = None
    for _ in range(hops):
        front = front.join(e, F.col("at") == F.col("src")).filter(~F.array_contains("path", F.col("dst"))).withColumn("runs", F.col("runs") + F.col("run")).filter(F.col("runs") <= most_runs)
        # Of several ways to a node with equally many runs only the first can begin a best path, so a hub does not multiply them.
        front = front.groupBy("start", F.col("dst").alias("at"), "runs").agg(F.min(F.array_append("path", F.col("dst"))).alias("path")).select("start", "at", "path", "runs")
        here = front.join(ends, F.col("at") == F.col("goal"), "inner").select("start", "goal", "path")
        found = here if found is None else found.unionByName(here)
    best = F.min(F.struct(F.size("path").alias("n"), F.col("path").alias("p")))
    return found.groupBy("start", "goal").agg(best["p"].alias("path"))


def staged_runs(events: DataFrame) -> DataFrame:
    """Downloads that are later run, else only made executable: (component, path, source, step), the first event counts."""
    d = events.filter("event = 'download'").groupBy("component", "path").agg(F.min_by("source", F.struct("file", "line")).alias("source"))
    rest = events.filter("event in ('run', 'chmod')").groupBy("component", "path").agg(F.max(F.col("event") == "run").alias("runs"))
    return d.join(rest, ["component", "path"]).select("component", "path", "source", F.when(F.col("runs"), "run").otherwise("chmod").alias("step"))


def drift_from_lock(current: DataFrame, lock: DataFrame) -> DataFrame:
    """(key, state, files, tools, labels) of current components against a lock; what only the lock holds is not reported.

    Both sides: key, content_hash, files MAP<STRING,STRING>, tools MAP<STRING,STRING>, labels ARRAY<STRING>.
    """
    c, o = current.alias("c"), lock.alias("o")
    entries = lambda x: F.coalesce(F.map_entries(x), F.array().cast("array<struct<key:string,value:string>>"))
    changed = lambda f: F.array_sort(F.array_distinct(F.transform(F.array_union(F.array_except(entries(f"c.{f}"), entries(f"o.{f}")), F.array_except(entries(f"o.{f}"), entries(f"c.{f}"))), lambda x: x["key"])))
    none = F.array().cast("array<string>")
    new = F.array_sort(F.array_except(F.coalesce("c.labels", none), F.coalesce("o.labels", none)))
    j = c.join(o, F.col("c.key") == F.col("o.key"), "left")
    out = j.select(F.col("c.key").alias("key"), F.col("c.content_hash"), F.col("o.key"), F.col("o.content_hash"), changed("files").alias("files"), changed("tools").alias("tools"), new.alias("labels"))
    out = out.toDF("key", "ch", "okey", "och", "files", "tools", "labels")
    state = F.when(F.col("okey").isNull(), "new").when(~F.col("ch").eqNullSafe(F.col("och")) | (F.size("files") > 0) | (F.size("tools") > 0) | (F.size("labels") > 0), "changed").otherwise("same")
    return out.select("key", state.alias("state"), "files", "tools", "labels")


def first_fact(refs: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Recorded facts joined to references on their keys, one row per reference and fact."""
    return refs.dropDuplicates().join(facts, keys).dropDuplicates()


def mentions(texts: DataFrame, text: str, owner: str, names: DataFrame) -> DataFrame:
    """(owner, name, other): texts that name another owner's tool; tokens meet names by equality."""
    tokens = texts.select(F.col(owner).alias("owner"), F.explode(F.array_distinct(F.split(F.lower(text), r"[^a-z0-9_]+"))).alias("name")).filter(F.length("name") >= 5)
    return tokens.join(names.select(F.lower("name").alias("name"), F.col("owner").alias("other")).distinct(), "name").filter("owner <> other").select("owner", "name", "other").distinct()
