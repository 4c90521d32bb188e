"""The corpus pipeline: from documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of documents.  A row is a document: rows with one doc_id and different texts are judged each, and
so are rows without a doc_id.  Further columns, whatever their names, are passed through, and an empty table gives
an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemill.llm import common as C
from rulemill.llm import decontaminate, near_dedup, packing, pii, quality


def _free(docs: DataFrame, name: str) -> str:
    """The name, or a longer one that no column has."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a key of id and text in a column of a new name; only like rows share one."""
    name = _free(docs, "_key")
    return docs.withColumn(name, F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull())), name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts are scored like any other (with no words); a very long text is read whole; repeated rows get
    the same score, so all or none of them stay; without labels of both kinds every score is the share of good ones.
    """
    return quality.keep_good(docs, C.table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the least doc_id.

    Of one id with different texts in a class the text with the least key stays; of like rows (id and text) one, that
    with the least other columns; rows without an id come after those with one.  Texts without words are classes of
    their own, each row but like ones.
    """
    d, key = _keyed(docs)
    rank, whole = _free(d, "_rank"), _free(d, "_row")
    first = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), F.col(key).alias("key"))
    classes = near_dedup.near_dedup(d.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), "class_id").distinct()
    kept = d.select(key, "doc_id").join(classes, key).groupBy("class_id").agg(F.min(first).alias("first")).select(F.col("first.key").alias(key))
    mine = d.join(kept, key, "left_semi")
    # like rows are few: they have one key, and one of them is in each task after the first aggregation
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*others)) if others else F.lit("")
    one = mine.withColumn(rank, order).withColumn(whole, F.struct(*docs.columns)).groupBy(key).agg(F.min_by(whole, rank).alias(whole))
    return one.select(*(F.col(f"{whole}.`{c}`").alias(c) for c in docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less of the benchmark than the rule allows.

    Null and empty texts hold nothing and stay; very long texts are judged whole; like rows stay or go together; an
    empty benchmark contaminates nothing.
    """
    d, key = _keyed(docs)
    hits = decontaminate.decontaminate(d.select(F.col(key).alias("doc_id"), "text"), C.table(spark, sf_dir, "benchmark"))
    return d.join(hits.filter("contaminated").select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind in brackets, and n_chars to match.

    A null text becomes an empty one; repeated rows are changed alike; work grows with a text's length only.
    """
    got = pii.label(docs)
    text = F.when(F.size("spans") > 0, pii.redact(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    new = got.withColumn("_text", text)
    columns = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return new.select(*(columns.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences.

    Null and empty texts are the end token alone; a long text is cut in pieces of a sequence's length; repeated rows are
    packed each.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("best-fit packing", packing_stage),
]
#: Stages are not SQL-expressible (a trained classifier, signatures, a tokenizer); tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = C.materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
