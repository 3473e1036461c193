"""A corpus from raw documents to packed sequences: five stages, each written as Parquet and read again.

A stage gets what its predecessor kept and returns the columns of ``documents``,
but for the last, which returns packed pieces. Each works on all documents it gets
and is judged on them. Filters judge rows: those without a doc_id, or with one that
other rows have too, get a key of their own, and of rows that agree in doc_id and
text one is enough.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, jaccard_join, packing, pii, toxicity
from palimpsest.llm.common import stored, table


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents whose score reaches the threshold are dropped."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__key``: the doc_id where one row alone has it, else a negative number by doc_id and text."""
    own = F.col("doc_id").cast("long")
    hashed = F.xxhash64(F.coalesce(own, F.lit(0)), own.isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull())
    by_content = hashed.bitwiseOR(F.lit(-(1 << 63)))
    several = stored(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("__rows")).where("__rows > 1"), "repeated-ids")
    if not several.limit(1).count():
        return docs.withColumn("__key", F.coalesce(own, by_content))
    marked = docs.join(several, "doc_id", "left")
    return marked.withColumn("__key", F.when(own.isNull() | F.col("__rows").isNotNull(), by_content).otherwise(own)).drop("__rows")


def one_of_each_key(rows: DataFrame) -> DataFrame:
    """Of the rows of one key a single one; only keys that recur are gathered."""
    several = stored(rows.where("__key < 0").groupBy("__key").agg(F.count("*").alias("__rows")).where("__rows > 1").select("__key"), "repeated-rows")
    if not several.limit(1).count():
        return rows
    return rows.join(several, "__key", "left_anti").unionByName(rows.join(several, "__key", "left_semi").dropDuplicates(["__key"]))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of documents that equal texts or links of 0.8 and more lead to, the least doc_id stays, or one without if no row has any."""
    rows = one_of_each_key(keyed(docs))
    classes = jaccard_join.jaccard_classes(rows.select(F.col("__key").alias("doc_id"), "text"))
    ids = rows.select(F.col("__key").alias("doc_id"), F.col("doc_id").alias("own"))
    several = classes.where("doc_id <> class_id").select("class_id").distinct()
    # Keys of rows whose doc_id is another: the class's least key need not be that of its least doc_id.
    members = stored(classes.select("doc_id", "class_id").join(several, "class_id").join(ids, "doc_id"), "groups")
    first = members.groupBy("class_id").agg(F.min(F.struct(F.col("own").isNull().alias("none"), "own", "doc_id")).alias("first"))
    later = stored(members.join(first, "class_id").where("doc_id <> first.doc_id").select(F.col("doc_id").alias("__key")).distinct(), "later-documents")
    return rows.join(later, "__key", "left_anti").select(*docs.columns)


def leaked_benchmarks_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents with a window of 0.8 and more to a benchmark item, or so like one as a whole, are dropped."""
    rows = keyed(docs)
    texts = rows.select(F.col("__key").alias("doc_id"), "text")
    leaked = stored(decontaminate.leaks(texts, table(spark, sf_dir, "benchmark"), shorter=True).select(F.col("doc_id").alias("__key")).distinct(), "leaked-documents")
    return rows.join(leaked, "__key", "left_anti").select(*docs.columns)


def personal_data_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: each span of personal data becomes its kind in brackets; n_chars follows the text."""
    masked = pii.masked(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: pieces of at most 1024 ids and their places in sequences."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", toxic_documents_go),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", leaked_benchmarks_go),
    ("pii", personal_data_masked),
    ("best_fit_packing", packed_sequences),
]

#: The first and the fourth stage are models trained here, which SQL does not express; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
