"""Evaluation of data-defined regex rules over text units.

A unit meets the rules of its scope and role in an equi-join on the scope (rules are a dimension of bounded size, the
units are never shuffled for it). All matches of a pattern come from one Arrow pass, because Spark gives no positions;
everything after that is relational: one hit per line in the order of patterns, then at most `max_matches`.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.units import fences, headings_at, is_quoted

#: Seconds that one pattern may take on one text; a pattern that takes longer gives a row of TOO_SLOW instead of hits.
SECONDS = 0.5
TOO_SLOW = "PATTERN-TOO-SLOW"
#: Rules are sent to the tasks up to so many; a larger table of rules is refused.
MOST_RULES = 10_000
RANK = {"info": 1, "low": 2, "medium": 3, "high": 4, "critical": 5}
LOWER = {"high": "medium", "medium": "low", "low": "low"}

HITS = "rule_id string, p_ord int, start int, end int, line int, match string, snippet string, severity string, confidence string"


class Compiled:
    """A rule with its patterns compiled; a pattern that takes too long on a text is passed over for it."""

    def __init__(self, row: dict, patterns: list[tuple[int, str]]) -> None:
        self.row = row
        flags = regex.MULTILINE | (regex.IGNORECASE if row["ignore_case"] else 0)
        self.patterns = [(i, regex.compile(p, flags)) for i, p in sorted(patterns)]
        self.require = [regex.compile(p, flags) for p in row["require"]]
        self.unless = [regex.compile(p, flags) for p in row["unless"]]
        self.sections = [regex.compile(p, regex.IGNORECASE) for p in row["sections"]]
        self.downgrade = []
        for d in json.loads(row["downgrade"]):
            self.downgrade.append({**d, "rx": [regex.compile(p, flags) for p in d.get("patterns") or []], "told": [regex.compile(p, regex.IGNORECASE) for p in d.get("declared") or []]})


def _search(rx: regex.Pattern, text: str) -> bool:
    try:
        return rx.search(text, timeout=SECONDS) is not None
    except TimeoutError:
        return False


def hits(rule: Compiled, text: str, role: str, description: str | None = None) -> Iterator[tuple]:
    """Every match of a rule that its conditions let through, in order of pattern and place.

    `description` is what the component says of itself; downgrades for declared behaviour look at it.
    """
    starts = [0, *(i + 1 for i, c in enumerate(text) if c == "\n")]

    def around(s: int, e: int, n: int) -> str:
        a, b = bisect.bisect_right(starts, s) - 1, bisect.bisect_right(starts, max(s, e - 1)) - 1
        return text[starts[max(0, a - n)] : starts[b + n + 1] if b + n + 1 < len(starts) else len(text)]

    r = rule.row
    code = fences(text) if r["lower_in_code"] else []
    for p_ord, rx in rule.patterns:
        try:
            found = list(rx.finditer(text, timeout=SECONDS))
        except TimeoutError:
            yield TOO_SLOW, p_ord, 0, 0, 1, r["rule_id"].lower(), f"pattern {p_ord} of {r['rule_id']} took too long", "low", "high"
            continue
        for m in found:
            s, e = m.span()
            if rule.sections and not any(_search(x, h) for x in rule.sections for h in headings_at(text, s)):
                continue
            near = around(s, e, r["window"])
            if any(not _search(x, near) for x in rule.require) or any(_search(x, near) for x in rule.unless):
                continue
            severity, confidence = r["severity"], r["confidence"]
            if any(a <= s < b for a, b, _ in code):
                confidence = LOWER[confidence]
            at = starts[bisect.bisect_right(starts, s) - 1]
            line = around(s, s, 0).rstrip("\n")
            for d in rule.downgrade:
                if d.get("roles") and role not in d["roles"]:
                    continue
                if d.get("quoted") and (e > at + len(line) or not is_quoted(line, s - at, e - at)):
                    continue
                if d.get("rx") and not any(_search(x, around(s, e, r["window"] if d.get("window") is None else d["window"])) for x in d["rx"]):
                    continue
                if d["told"] and not (description and any(_search(x, description) for x in d["told"])):
                    continue
                if RANK[d["severity"]] < RANK[severity]:
                    severity, confidence = d["severity"], LOWER[confidence]
                break
            yield r["rule_id"], p_ord, s, e, bisect.bisect_right(starts, s), m[0].lower(), line if len(line) <= 300 else text[max(0, s - 80) : e + 80], severity, confidence


def match(units: DataFrame, rules: DataFrame, patterns: DataFrame) -> DataFrame:
    """All hits of the enabled regex rules on units (…, scope, role, unit and perhaps description), before they are thinned."""
    rows = rules.filter("enabled and kind = 'regex'").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    pats = patterns.join(rules.filter("enabled and kind = 'regex'").select("rule_id"), "rule_id", "left_semi").collect()
    by_rule: dict[str, list[tuple[int, str]]] = {}
    for p in pats:
        by_rule.setdefault(p["rule_id"], []).append((p["p_ord"], p["pattern"]))
    pack = [(r.asDict(), by_rule.get(r["rule_id"], [])) for r in sorted(rows, key=lambda r: r["rule_id"])]
    shared = units.sparkSession.sparkContext.broadcast(pack)
    told = "description" in units.columns
    keep = [f for f in units.schema.fields if f.name != "unit"]
    names = [x.split()[0] for x in HITS.split(", ")]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [Compiled(row, p) for row, p in shared.value]
        by_scope: dict[str, list[Compiled]] = {}
        for c in compiled:
            for s in c.row["scopes"]:
                by_scope.setdefault(s, []).append(c)
        for b in batches:
            scope, role, text = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("scope", "role", "unit"))
            about = b.column(b.schema.get_field_index("description")).to_pylist() if told else [None] * len(text)
            idx, out = [], []
            for i, (s, r, t, says) in enumerate(zip(scope, role, text, about, strict=True)):
                if t and t.strip():
                    for rule in by_scope.get(s, ()):
                        if not rule.row["applies_to"] or r in rule.row["applies_to"]:
                            for h in hits(rule, t, r, says):
                                idx.append(i)
                                out.append(h)
            take = pa.array(idx, pa.int64())
            cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(f.name)).take(take) for f in keep], *[pa.array(list(c), t) for c, t in zip(cols, types, strict=True)]], names=[*[f.name for f in keep], *names])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return units.mapInArrow(run, f"{head}, {HITS}")


def thin(found: DataFrame, unit: list[str], rules: DataFrame) -> DataFrame:
    """One hit per unit, rule and line (the first pattern, then the first place), and at most `max_matches` of a rule in a unit."""
    order = [F.col("p_ord"), F.col("start")]
    line = Window.partitionBy(*unit, "rule_id", "line", F.when(F.col("rule_id") == TOO_SLOW, F.col("match")))
    first = found.withColumn("__n", F.row_number().over(line.orderBy(*order))).filter("__n = 1")
    few = first.withColumn("__n", F.row_number().over(Window.partitionBy(*unit, "rule_id").orderBy(*order)))
    few = few.join(rules.select("rule_id", "max_matches"), "rule_id", "left")
    return few.filter("max_matches is null or __n <= max_matches").drop("__n", "max_matches")


def evaluate(units: DataFrame, rules: DataFrame, patterns: DataFrame, unit: list[str]) -> DataFrame:
    """The hits of a rule pack on text units that `unit` identifies."""
    return thin(match(units, rules, patterns), unit, rules)


def native_hits(units: DataFrame, key: str, text: str, patterns: list[tuple[str, str]]) -> DataFrame:
    """(key, rule_id, line, snippet): lines that match, for patterns that Java and Python read alike; stays in the JVM."""
    lines = units.select(key, F.posexplode(F.split(text, "\n")).alias("n", "snippet"))
    marked = lines.withColumn("rules", F.filter(F.array(*[F.when(F.col("snippet").rlike(p), F.lit(r)) for r, p in patterns]), lambda x: x.isNotNull()))
    return marked.filter(F.size("rules") > 0).select(key, F.explode("rules").alias("rule_id"), (F.col("n") + 1).alias("line"), "snippet")
