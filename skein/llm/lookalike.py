"""Visually identical text in one consistent form.

Code points and short strings that look alike are joined into transitive classes by union-find: a code point with its
ordinary form (width, style, ligature, composition; the form may be a string of several letters) and a letter of
another script with the Latin letter of the same shape, by the public table of confusable characters that the JVM's
Unicode library carries and the fixed values below. Each class takes its most frequent member in the data, code point
or string, as representative. A multi-pattern automaton then rewrites the text greedily, leftmost and longest first,
once over code points and once over strings of the representatives that the first pass leaves.

Defined cases: null stays null, '' stays ''; invisible characters go, every blank (tab included) becomes a plain
blank, line ends stay; case, digits, accents and visible punctuation stay different, and so do Latin letters among
themselves (m and rn, I and l) and letters that look like two Latin letters; the result depends on the counts only in
which member of a class is shown, never in which values become equal.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from skein.session import stage

# Fixed values, which come before the public table: letters of other scripts that have the shape of a Latin letter, as "Latin: others".
SHAPES = """
a: а α ɑ ⍺
b: Ь
c: с ϲ
d: ԁ ꓒ
e: е ҽ
g: ɡ ց
h: һ հ Ꮒ
i: і ι Ꭵ
j: ј ϳ յ
l: ӏ Ӏ ן
n: ո
o: о ο օ
p: р ρ ⲣ
q: ԛ զ գ
s: ѕ
u: υ ս
v: ν ѵ
w: ԝ ѡ ա
x: х
y: у γ ү
A: А Α Ꭺ ꓮ
B: В Β Ᏼ ꓐ
C: С Ϲ Ꮯ ꓚ
D: Ꭰ ꓓ
E: Е Ε Ꭼ ꓰ
F: Ϝ ꓝ
G: Ԍ Ꮐ ꓖ
H: Н Η Ꮋ ꓧ
I: І Ι
J: Ј Ϳ Ꭻ ꓙ
K: К Κ Ꮶ K ꓗ
L: Ꮮ ꓡ
M: М Μ Ϻ Ꮇ ꓟ
N: Ν ꓠ
O: О Ο Օ ꓳ
P: Р Ρ Ꮲ ꓑ
Q: Ԛ
R: Ꭱ Ꮢ ꓣ
S: Ѕ Տ Ꮪ ꓢ
T: Т Τ Ꭲ ꓔ
U: Ս ꓴ
V: Ѵ Ꮩ ꓦ
W: Ԝ Ꮃ ꓪ
X: Х Χ ꓫ
Y: У Υ Ү ꓬ
Z: Ζ Ꮓ ꓜ
"""
#: Tags of compatibility decompositions that keep the look but for width, style or joining.
SAME_TAGS = {"<wide>", "<narrow>", "<small>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}
#: Invisible characters whose category is not Cf; U+2800 and the Hangul fillers are blanks to the eye but take room.
INVISIBLE = {0x34F, 0x17B4, 0x17B5, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0), 0x115F, 0x1160, 0x3164, 0xFFA0}
BLANKS = {0x9, 0x2800}


def is_invisible(c: str) -> bool:
    return (unicodedata.category(c) in ("Cf", "Cc") and c not in "\t\n\r\x85") or ord(c) in INVISIBLE


def ordinary(c: str) -> str:
    """The ordinary form of a code point: '' if invisible, ' ' for any blank, else its plain letters."""
    if is_invisible(c):
        return ""
    if unicodedata.category(c) == "Zs" or ord(c) in BLANKS:
        return " "
    tag, *rest = unicodedata.decomposition(c).split() or [""]
    if tag in SAME_TAGS or (tag == "<compat>" and any(w in unicodedata.name(c, "") for w in ("LIGATURE", "DIGRAPH", "ROMAN NUMERAL", "MICRO SIGN", "LETTER DZ", "LETTER LJ", "LETTER NJ", "CAPITAL LETTER L WITH SMALL", "CAPITAL LETTER N WITH SMALL", "CAPITAL LETTER D WITH SMALL"))):
        return "".join(ordinary(chr(int(x, 16))) for x in rest)
    return unicodedata.normalize("NFD", c)


def shape_table() -> dict[str, str]:
    out = {}
    for line in SHAPES.split("\n"):
        if line:
            latin, others = line.split(": ")
            out |= {x: latin for x in others.split()}
    return out


def confusables(spark: SparkSession, chars: Iterable[str]) -> dict[str, str]:
    """Letters of other scripts among `chars` to the ASCII letter of their shape, by the public table of confusables.

    The table has one class for I and l: capitals and letters without case count as I, small letters and those of
    scripts written from the right as l. Digits and punctuation are no letters. One call for all characters.
    """
    letters = sorted(c for c in set(chars) if unicodedata.category(c)[0] == "L" and not unicodedata.name(c, "LATIN").startswith("LATIN"))
    if not letters:
        return {}
    try:
        forms = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(letters)).split("\n")
    except TypeError:  # a Spark without that library: the fixed values only
        return {}
    out = {}
    for c, f in zip(letters, forms, strict=True):
        if len(f) == 1 and f.isascii() and f.isalpha():
            small = unicodedata.category(c) == "Ll" or unicodedata.bidirectional(c) in ("R", "AL")
            out[c] = f if f != "l" or small else "I"
    return out


@lru_cache(1)
def strings() -> tuple[str, ...]:
    """Strings of several letters that some code point is a ligature or digraph of."""
    out = set()
    for i in range(0x80, 0xFFFF):
        c = chr(i)
        if unicodedata.decomposition(c).startswith("<") and len(f := ordinary(c)) > 1 and not any(unicodedata.combining(x) for x in f):
            out.add(f)
    return tuple(sorted(out))


class Classes:
    """Union-find over strings and code points."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.up:
            out.setdefault(self.find(x), []).append(x)
        return out


def build_classes(counts: dict[str, int], shapes: dict[str, str] | None = None) -> dict[str, str]:
    """Each code point that occurs, and each string it stands for, to the representative of its class.

    `counts` holds code points and the strings of `strings()`. Joined are a code point and its ordinary form, a letter
    and the Latin letter of its shape, and so, transitively, whatever shares a form with them; a string is joined with
    the form that its letters have in turn. Classes that hold '' are shown as '', those that hold a blank as the plain
    blank, others as their most frequent member.
    """
    shapes, classes = (shapes or {}) | shape_table(), Classes()
    seen = {c for c in counts if len(c) == 1}
    forms: set[str] = {s for s in counts if len(s) > 1}
    for c in sorted(seen):
        form = ordinary(c)
        if form != c:
            classes.join(c, form)
            if len(form) > 1 and not any(map(unicodedata.combining, form)):
                forms.add(form)
        seen |= {x for x in form}
    for c in sorted(seen):
        if c in shapes:
            classes.join(c, shapes[c])
    for s in sorted(forms):  # the same letters in another script make the same string
        classes.join(s, "".join(classes.find(x) if len(classes.find(x)) == 1 else x for x in s))
    freq = lambda s: counts[s] if s in counts else 0 if len(s) == 1 else min((counts.get(c, 0) for c in s), default=0)
    out = {}
    for group in classes.members().values():
        best = "" if "" in group else " " if " " in group else min(group, key=lambda s: (-freq(s), len(s), s))
        out |= {m: best for m in group}
    return out


class Rewriter:
    """Greedy rewriting, leftmost and longest first, by automata over all members that are not their class's representative.

    The first pass brings every code point to its ordinary form in representatives of one letter, so that an accent or
    a ligature may come composed or not; the second brings strings of these to the representative of their class.
    """

    def __init__(self, rep: dict[str, str]) -> None:
        one = lambda x: rep.get(x, x) if len(rep.get(x, x)) <= 1 else x
        letters = {}
        for c in rep:
            if len(c) == 1:
                letters[c] = "".join(one(x) for x in ordinary(c))
        spelt = lambda s: "".join(letters.get(x, one(x)) for x in s)
        texts = {spelt(s): r for s, r in rep.items() if (len(s) > 1 or len(r) > 1) and spelt(s) != r and len(spelt(s)) > 1 and not any(map(unicodedata.combining, spelt(s)))}
        self.passes = [self._automaton({c: r for c, r in letters.items() if c != r}), self._automaton(texts)]
        self.ascii_plain = not any(c.isascii() for c in letters if letters[c] != c) and not any(t.isascii() for t in texts)

    @staticmethod
    def _automaton(rules: dict[str, str]):  # noqa: ANN205
        auto = ahocorasick.Automaton()
        for k, r in rules.items():
            auto.add_word(k, (len(k), r))
        if len(auto):
            auto.make_automaton()
        return auto

    def __call__(self, text: str | None) -> str | None:
        if text is None or not text or (self.ascii_plain and text.isascii()):
            return text
        for auto in self.passes:
            if len(auto):
                out, at = [], 0
                for end, (width, r) in auto.iter_long(text):
                    out += (text[at : end + 1 - width], r)
                    at = end + 1
                text = "".join([*out, text[at:]])
        return unicodedata.normalize("NFC", text)


def count_characters(texts: DataFrame) -> DataFrame:
    """(c, n) of the code points, and of the strings of `strings()`, over all texts of a single string column; summed within each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        several = ahocorasick.Automaton()
        for s in strings():
            several.add_word(s, s)
        several.make_automaton()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    total.update(t)
                    total.update(s for _, s in several.iter(t))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.int64())], names=["c", "n"])

    return texts.mapInArrow(run, "c string, n bigint").groupBy("c").agg(F.sum("n").alias("n"))


def learn(columns: Iterable[DataFrame]) -> dict[str, str]:
    """Representatives for the characters of the given text columns. What comes to the driver is one row per distinct
    code point, at most sys.maxunicode + 1 rows whatever the data, and one per string of `strings()`."""
    all_texts = None
    for df in columns:
        one = df.toDF("t")
        all_texts = one if all_texts is None else all_texts.unionByName(one)
    counts = {r["c"]: r["n"] for r in count_characters(all_texts).collect()}
    assert len(counts) <= sys.maxunicode + 1 + len(strings())
    return build_classes(counts, confusables(all_texts.sparkSession, (c for s in counts for c in s)))


def rewrite(df: DataFrame, column: str, out: str, rep: dict[str, str]) -> DataFrame:
    """Add `out`: the consistent form of `column`."""
    shared = df.sparkSession.sparkContext.broadcast(rep)
    kinds = StructType([*[x for x in df.schema.fields if x.name != out], StructField(out, StringType())])
    df = df.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        go = Rewriter(shared.value)
        for b in batches:
            i = b.schema.get_field_index(column)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([go(t) for t in b.column(i).to_pylist()], pa.string())], names=[*b.schema.names, out])

    return df.mapInArrow(run, kinds)


#: Rows of one look that one task may pair; looks with more are paired in parts.
PAIRED = 10_000


def look_classes(rows: DataFrame, key: list[str], exact: str, form: str, row_id: str) -> DataFrame:
    """(key, row_id, f, x, n_rows, n_spellings): of every row its look (hash of the form), its spelling (hash of the
    text), and how many rows and spellings the look has. One row per row, however many look the same.

    The rewritten texts are read once, into a staged table of hashes (two of 64 bits for a form and for a spelling).
    """
    h = lambda c: F.struct(F.xxhash64(c), F.xxhash64(F.reverse(c)))
    slim = stage(rows.filter(F.col(exact).isNotNull()).select(*key, row_id, h(form).alias("f"), h(exact).alias("x")), "lookalike-hashes")
    per = slim.groupBy(*key, "f", "x").agg(F.count("*").alias("k")).groupBy(*key, "f").agg(F.sum("k").alias("n_rows"), F.count("*").alias("n_spellings"))
    on = F.col("a.f") == F.col("b.f")
    for k in key:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return slim.alias("a").join(per.alias("b"), on).select(*[f"a.{k}" for k in key], f"a.{row_id}", "a.f", "a.x", "n_rows", "n_spellings")


def same_look(rows: DataFrame, key: list[str], exact: str, form: str, row_id: str) -> DataFrame:
    """(id_a, id_b): pairs of rows of one `key` with equal `form` but different `exact` text; a null key makes no pairs.

    Rows whose look has one spelling only are dropped before the join. The pairs of a look with many rows are made in
    parts: one side is cut, the other sent to each part.
    """
    several = look_classes(rows, key, exact, form, row_id).filter("n_spellings > 1")
    parts = F.ceil(F.col("n_rows") / PAIRED)
    a = several.withColumn("part", F.pmod(F.xxhash64(row_id), parts)).select(*key, "f", "part", F.col(row_id).alias("id_a"), F.col("x").alias("xa"))
    b = several.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).select(*key, "f", "part", F.col(row_id).alias("id_b"), F.col("x").alias("xb"))
    return a.join(b, [*key, "f", "part"]).filter("id_a < id_b and xa <> xb").select("id_a", "id_b")
