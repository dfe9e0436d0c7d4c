"""Evaluation texts inside training text, by a positional inverted index.

`postings` stores (term, doc, position) of the training texts. A passage is a run of `size` words of a test item; its
rarest term is looked up in the index, the lists are shifted by the term's offset in the item, and the lists of the
other terms are intersected at the same shift. A document holds the passage if `size` consecutive offsets of an item
meet at one shift. `phrase` and `near` answer exact phrases and words close to each other from the same index.

Defined cases: null and empty texts have no words; documents with a null id are left out; items shorter than `size`
words never match; a document that repeats as a row counts once; equal items each count; an index that is kept as a table serves `runs`, `phrase` and `near` alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.tokens import words
from skein.session import stage

#: Consecutive words that make a leak.
SIZE = 13
#: Term sets of up to so many terms are sent to the tasks that read the texts; larger ones are joined.
SENT_TERMS = 500_000
#: Parts in which a term meets its postings where the anchors are too many to be sent.
SALTS = 16


def postings(docs: DataFrame, doc: str, text: str, terms: set[str] | None = None) -> DataFrame:
    """(doc, pos, term) of all texts, or of the given terms only."""
    rows = docs.filter(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = shared.value
        for b in batches:
            ids, at, ts = [], [], []
            id_kind = b.schema.field(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for p, w in enumerate(words(t)):
                    if keep is None or w in keep:
                        ids.append(i)
                        at.append(p)
                        ts.append(w)
                if len(at) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, id_kind), pa.array(at, pa.int32()), pa.array(ts, pa.string())], names=["doc", "pos", "term"])
                    ids, at, ts = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_kind), pa.array(at, pa.int32()), pa.array(ts, pa.string())], names=["doc", "pos", "term"])

    return rows.mapInArrow(run, f"doc {kind}, pos int, term string")


def index_for(docs: DataFrame, doc: str, text: str, queries: DataFrame) -> DataFrame:
    """The staged index of the terms that occur in queries (q, pos, term): restricted while reading if they are few."""
    terms = queries.select("term").distinct()
    few = terms.limit(SENT_TERMS + 1).collect()
    if len(few) <= SENT_TERMS:
        return stage(postings(docs, doc, text, {r["term"] for r in few}), "leaks-index")
    return stage(postings(docs, doc, text).join(terms, "term", "left_semi").select("doc", "pos", "term"), "leaks-index")


def keep_index(docs: DataFrame, doc: str, text: str, path: str, buckets: int = 256) -> None:
    """Write the index of all terms as a table, in folders by a hash of the term, for many searches."""
    rows = postings(docs, doc, text).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)))
    # Frequent terms are cut by their documents, so that no file holds one term alone.
    rows.repartition("bucket", F.pmod(F.xxhash64("doc"), F.lit(16))).sortWithinPartitions("bucket", "term", "doc", "pos").write.partitionBy("bucket").mode("overwrite").parquet(path)


def lookup(index: DataFrame, terms: list[str], buckets: int = 256) -> DataFrame:
    """(doc, pos, term) of a few terms; of a kept index only their folders are read."""
    spark = index.sparkSession
    if "bucket" in index.columns:
        places = spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(buckets)).alias("b")).collect() if terms else []
        index = index.filter(F.col("bucket").isin([r["b"] for r in places]))
    return index.filter(F.col("term").isin(terms)).select("doc", "pos", "term")


def anchors(queries: DataFrame, index: DataFrame, size: int) -> DataFrame:
    """(q, pos, term): for every run of `size` words of a query its rarest term; runs with a term that the index lacks are dropped."""
    counts = index.groupBy("term").agg(F.count("*").alias("n"))
    run = Window.partitionBy("q").orderBy("pos").rowsBetween(0, size - 1)
    known = queries.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = known.select("q", "pos", F.count("*").over(run).alias("k"), F.min("n").over(run).alias("least"), F.min(F.struct("n", "pos", "term")).over(run).alias("x"))
    return best.filter((F.col("k") == size) & (F.col("least") > 0)).select("q", "x.pos", "x.term").distinct()


def runs(queries: DataFrame, index: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc, q, shift, first, length): maximal runs of at least `size` words that a document shares with a query (q, pos, term)."""
    index_ = index.select("doc", F.col("pos").alias("at"), "term")
    rare = stage(anchors(queries, index, size), "leaks-anchors")
    if rare.count() <= SENT_TERMS:
        hits = index_.join(F.broadcast(rare), "term")  # at most SENT_TERMS rows: the index is not moved, however frequent a term
    else:
        salt = F.pmod(F.xxhash64("doc"), F.lit(SALTS))
        hits = index_.withColumn("salt", salt).join(rare.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))), ["term", "salt"])
    hits = hits.select("doc", "q", "pos", (F.col("at") - F.col("pos")).alias("shift"))
    # A run of `size` words lies around the anchor of one of its parts: only the words around each hit are asked for, at
    # the places where the document would have them.
    asked = hits.select("doc", "q", "shift", F.explode(F.sequence(F.greatest(F.col("pos") - size + 1, F.lit(0), -F.col("shift")), F.col("pos") + size - 1)).alias("pos")).distinct()
    asked = stage(asked, "leaks-candidates").join(queries, ["q", "pos"]).withColumn("at", F.col("pos") + F.col("shift"))
    met = asked.join(index_, ["doc", "at", "term"]).select("doc", "q", "shift", "pos").repartition("doc", "q", "shift").distinct()
    w = Window.partitionBy("doc", "q", "shift").orderBy("pos")
    isle = met.withColumn("isle", F.col("pos") - F.row_number().over(w))
    return isle.groupBy("doc", "q", "shift", "isle").agg(F.min("pos").alias("first"), F.count("*").alias("length")).filter(F.col("length") >= size).drop("isle")


def query_words(items: DataFrame, item: str, text: str) -> DataFrame:
    """(q, pos, term) of the test items."""
    return postings(items, item, text).withColumnRenamed("doc", "q").distinct()


def leaked(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, size: int = SIZE) -> DataFrame:
    """(doc, q, shift, first, length): the passages of the items in the documents."""
    queries = stage(query_words(items, item, item_text), "leaks-queries")
    return runs(queries, index_for(docs, doc, text, queries), size)


def phrase(index: DataFrame, text: str) -> DataFrame:
    """(doc, at): where the words of `text` follow each other; no words, no rows."""
    terms = words(text)
    queries = index.sparkSession.createDataFrame([("", i, w) for i, w in enumerate(terms)], "q string, pos int, term string")
    return runs(queries, lookup(index, sorted(set(terms))), max(1, len(terms))).select("doc", F.col("shift").alias("at")).distinct()


def near(index: DataFrame, text: str, within: int) -> DataFrame:
    """(doc, at): places of the rarest word of `text` that have all its words at most `within` words away; of equally rare words the first in order counts."""
    terms = sorted(set(words(text)))
    hits = stage(lookup(index, terms).distinct(), "leaks-near")
    rare = hits.groupBy("term").agg(F.count("*").alias("n")).orderBy("n", "term").first()
    if rare is None:
        return hits.select("doc", F.col("pos").alias("at"))
    # Positions are cut into blocks of `within`, so that each centre meets the neighbouring blocks only.
    size = max(1, within)
    centre = hits.filter(F.col("term") == rare["term"]).select("doc", F.col("pos").alias("at"), F.explode(F.array(*[F.floor(F.col("pos") / size) + i for i in (-1, 0, 1)])).alias("block"))
    around = hits.withColumn("block", F.floor(F.col("pos") / size))
    close = centre.join(around, ["doc", "block"]).filter(F.abs(F.col("pos") - F.col("at")) <= within)
    return close.groupBy("doc", "at").agg(F.count_distinct("term").alias("n")).filter(F.col("n") == len(terms)).select("doc", "at")
