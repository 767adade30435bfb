"""Clean a corpus in stages: each reads the whole table that the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, language, pii
from tidemark.llm.decontaminate import count_items
from tidemark.llm.near import near_duplicates
from tidemark.llm.queries import BYTE_BPE
from tidemark.scratch import broadcast_if_small, materialise

#: A document is rejected whose best language has less than this mean probability. Chance alone gives
#: a quarter among four languages, so texts in two of them stay.
LEAST_SCORE = 0.3

#: Bytes of rows that Spark hands to Python at once, unless the session says otherwise. Spark counts
#: rows alone by default, and ten thousand long texts take much memory outside its heap.
BATCH_BYTES = "4m"


def _bound_batches(spark: SparkSession) -> None:
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting, None) is None:
        spark.conf.set(setting, BATCH_BYTES)


def _aside(docs: DataFrame, names: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with other names for columns that an operator would take for its own results, and the way
    back: a stage returns all columns as it got them."""
    own = names.split()
    renamed = {f"\u0002{c}": c for c in docs.columns if c.lower() in own}
    return docs.withColumnsRenamed({c: r for r, c in renamed.items()}), renamed


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is told with :data:`LEAST_SCORE`; a missing ``lang`` is filled in.

    Texts that are null or have no letter go.
    """
    _bound_batches(spark)
    columns = docs.columns
    docs, back = _aside(docs, "lang_pred score")
    model = language.train(docs.where("doc_id IS NOT NULL"))
    known = language.predict(docs, model).where(
        (F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)
    )
    known = known.withColumn("lang", F.coalesce("lang", "lang_pred")).drop("lang_pred", "score")
    return known.withColumnsRenamed(back).select(*columns)


#: Pairs of 16 bytes that are handed to every task at most, to keep texts from being shuffled for them.
BROADCAST_PAIRS = 2_000_000


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class, that of the least id; of its equal rows, one. Rows without an id stay.

    Rows that repeat an id are documents of their own, so rows are told apart by id and text. Which rows go
    is a list of pairs (id, hash of the text). It is counted, and up to :data:`BROADCAST_PAIRS` of them
    are broadcast; more are joined by shuffle.
    """
    _bound_batches(spark)
    key = ["doc_id", "text_hash"]
    # The decisions keep clear of columns that happen to have their names.
    texts = docs.select("doc_id", "text")
    rows = near_duplicates(texts, stays=True).where("doc_id IS NOT NULL")
    act = rows.groupBy(*key).agg(F.bool_and("stays").alias("stays"), F.count("*").alias("copies"))
    act = materialise(act.where("NOT stays OR copies > 1"), "duplicates")
    names = {c: f"\u0002{c}" for c in key}
    act = act.withColumnsRenamed(names)
    gone = broadcast_if_small(act.where("NOT stays").select(*names.values()), BROADCAST_PAIRS)
    again = broadcast_if_small(act.where("stays").select(*names.values()), BROADCAST_PAIRS)
    same = (F.col(names["doc_id"]) == F.col("doc_id")) & (F.col(names["text_hash"]) == F.xxhash64("text"))
    kept = docs.join(gone, same, "left_anti")
    if not again.isEmpty():
        one = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(again, same, "left_anti").unionByName(one)
    return kept.select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    _bound_batches(spark)
    items, columns = spark.read.parquet(f"{sf_dir}/benchmark.parquet"), docs.columns
    docs, back = _aside(docs, "n_items")
    clean = count_items(docs, items).where("n_items = 0").drop("n_items")
    return clean.withColumnsRenamed(back).select(*columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by marks; ``n_chars`` follows the text."""
    columns = docs.columns
    docs, back = _aside(docs, "pii")
    masked = pii.mask_pii(pii.find_pii(docs))
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    changed = F.when(F.size("pii") > 0, size).otherwise(F.col("n_chars"))
    masked = masked.withColumn("n_chars", changed).drop("pii")
    return masked.withColumnsRenamed(back).select(*columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, and whether they decode to its text again."""
    _bound_batches(spark)
    coded = bpe.encode(docs, BYTE_BPE, spelled=True)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select(
        "doc_id", "lang", "source", "n_chars",
        F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"),
    )


STAGES = [
    ("language_id", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("pii", mask_personal_data),
    ("byte_bpe", encode),
]

#: SQL can't express the stages: a learned model, validated spans, byte pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written, and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
