"""Queries of the text problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import leaks, lookalike, packing, pii, secrets, tokens
from skein.session import read as read_table
from skein.session import spread


def read(spark: SparkSession, d: str, table: str, *columns: str) -> DataFrame:
    """A table over all cores: the stages behind it are in Python."""
    return spread(read_table(spark, d, table, *columns))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    blobs = secrets.in_blobs(read(spark, d, "file_blobs", "blob_id", "data"), "blob_id", "data").select(F.lit("file_blobs").alias("origin"), "row_id", F.col("line").alias("pos"))
    names = secrets.in_elements(read(spark, d, "server_specs", "spec_id", "env_names"), "spec_id", "env_names").select(F.lit("server_specs").alias("origin"), "row_id", "pos")
    return blobs.unionByName(names).distinct()


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every file with its secrets blanked."""
    return secrets.redact_blobs(read(spark, d, "file_blobs", "blob_id", "data"), "blob_id", "data")


def _p3(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tools, runs = read(spark, d, "tools", "tool_id", "description"), read(spark, d, "text_runs", "run_id", "tool_id", "text", "kind")
    rep = lookalike.learn([tools.select("description"), runs.select("text"), runs.select("kind")])
    return lookalike.rewrite(tools, "description", "form", rep), lookalike.rewrite(lookalike.rewrite(runs, "text", "text_form", rep), "kind", "kind_form", rep)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    tools, runs = _p3(spark, d)
    named = lambda df, f: df.select(F.lit(f).alias("field"), "id_a", "id_b")
    return (
        named(lookalike.same_look(tools, [], "description", "form", "tool_id"), "description")
        .unionByName(named(lookalike.same_look(runs.drop("kind", "kind_form"), ["tool_id"], "text", "text_form", "run_id"), "text"))
        .unionByName(named(lookalike.same_look(runs.drop("text", "text_form"), ["tool_id"], "kind", "kind_form", "run_id"), "kind"))
    )


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every value with the class of values that look like it: one row per value, whatever the size of the class."""
    tools, runs = _p3(spark, d)
    one = lambda df, f, key, c, form, i: lookalike.look_classes(df, key, c, form, i).select(F.lit(f).alias("field"), F.col(i).alias("row_id"), F.hex(F.xxhash64(*key, "f")).alias("class_id"), "n_rows", "n_spellings")
    return (
        one(tools, "description", [], "description", "form", "tool_id")
        .unionByName(one(runs.drop("kind", "kind_form"), "text", ["tool_id"], "text", "text_form", "run_id"))
        .unionByName(one(runs.drop("text", "text_form"), "kind", ["tool_id"], "kind", "kind_form", "run_id"))
    )


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every value in its consistent form."""
    tools, runs = _p3(spark, d)
    one = lambda df, f, i, c: df.select(F.lit(f).alias("field"), F.col(i).alias("row_id"), F.col(c).alias("form"))
    return one(tools, "description", "tool_id", "form").unionByName(one(runs, "text", "run_id", "text_form")).unionByName(one(runs, "kind", "run_id", "kind_form"))


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokens.count_tokens(read(spark, d, "documents", "doc_id", "text"), "text"), "doc_id", "n_tokens").withColumnRenamed("doc", "doc_id")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    per = p6_pack(spark, d).filter("container is not null").groupBy("container").agg(F.sum("length").alias("used"))
    return per.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.ceil(F.sum("used") / 2048).alias("least"), F.max("used").alias("fullest"))


def _p7(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "bench_items", "item_id", "split", "text").filter("split = 'heldout'")
    return leaks.leaked(read(spark, d, "documents", "doc_id", "text"), "doc_id", "text", items, "item_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d).select(F.col("doc").alias("doc_id"), F.col("q").alias("item_id")).distinct()


def p7_passages(spark: SparkSession, d: str) -> DataFrame:
    """The longest passage of each leaked item: its first word in the document and its length in words."""
    best = F.max_by(F.struct((F.col("first") + F.col("shift")).alias("doc_word"), F.col("first").alias("item_word"), "length"), F.struct("length", -F.col("first"), -F.col("shift")))
    return _p7(spark, d).groupBy(F.col("doc").alias("doc_id"), F.col("q").alias("item_id")).agg(best.alias("x")).select("doc_id", "item_id", "x.*")


#: Words that the proximity query asks for, and how far apart they may stand.
NEAR_WORDS, NEAR = "header policy the", 12


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    """Places of the documents where a few words stand close to each other."""
    index = leaks.postings(read(spark, d, "documents", "doc_id", "text"), "doc_id", "text", set(NEAR_WORDS.split()))
    return leaks.near(index, NEAR_WORDS, NEAR).select(F.col("doc").alias("doc_id"), F.col("at").cast("bigint").alias("word"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.mentions(read(spark, d, "documents", "doc_id", "text"), "doc_id", "text").select(F.col("doc").alias("doc_id"), "pii_type", "start_pos")


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every text with its mentions replaced."""
    return pii.redact(read(spark, d, "documents", "doc_id", "text"), "doc_id", "text").withColumnRenamed("doc", "doc_id")


QUERIES = {"p2_found": p2_found, "p2_redacted": p2_redacted, "p3_found": p3_found, "p3_forms": p3_forms, "p3_classes": p3_classes, "p6_pack": p6_pack, "p6_fill": p6_fill, "p7_found": p7_found, "p7_passages": p7_passages, "p7_near": p7_near, "p8_found": p8_found, "p8_redacted": p8_redacted}
#: Words as the operator reads them, for texts without comments and with the usual entities only.
_WORDS_SQL = """regexp_extract_all(lower(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace({}, '(?i)</?(?:a|abbr|b|code|del|em|font|i|ins|kbd|mark|s|small|span|strong|sub|sup|u)\\b[^<>]*>', '', 'g'), '</?[A-Za-z!?][^<>]*>', ' ', 'g'), '\\]\\([^()\\s]*\\)', '] ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', chr(160)), '(?m)^[ \\t]*(?:(?:[>#*+|\\-–•]+|\\d{{1,3}}[.)])[ \\t]+)+', '', 'g')), '[\\p{{L}}\\p{{N}}]+')"""
SQL: dict[str, str] = {
    "p7_found": f"""
with d as (select doc_id, {_WORDS_SQL.format("text")} as w from documents where text is not null), i as (select item_id, {_WORDS_SQL.format("text")} as w from bench_items where split = 'heldout'),
dg as (select distinct doc_id, array_to_string(list_slice(w, k, k + 12), ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as k from d)),
ig as (select distinct item_id, array_to_string(list_slice(w, k, k + 12), ' ') as g from (select item_id, w, unnest(range(1, len(w) - 11)) as k from i))
select distinct doc_id, item_id from dg join ig using (g)""",
    "p7_near": f"""
with d as (select distinct doc_id, {_WORDS_SQL.format("text")} as w from documents where text is not null),
h as (select doc_id, k - 1 as pos, w[k] as term from (select doc_id, w, unnest(range(1, len(w) + 1)) as k from d) where w[k] in ('{"', '".join(NEAR_WORDS.split())}')),
c as (select * from h where term = (select term from h group by term order by count(*), term limit 1))
select c.doc_id, c.pos as word from c join h using (doc_id) where abs(h.pos - c.pos) <= {NEAR} group by all having count(distinct h.term) = {len(NEAR_WORDS.split())}""",
}
