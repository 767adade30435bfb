"""The operators of this subpackage as queries over the whole driver tables, with SQL where it fits."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, language, pii, quality, unigram, whitening
from tidemark.llm.audit import audit_quality
from tidemark.llm.decontaminate import find_items
from tidemark.llm.fingerprints import compare_edited
from tidemark.llm.lm import score_texts
from tidemark.llm.near import near_duplicates
from tidemark.llm.substrings import remove_repeats
from tidemark.llm.topk import top_k

#: The vocabulary files of public tokenizers; any other path can be given to the operators.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    r"""
    WITH words AS (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), starts AS (
      SELECT doc_id, s, array_to_string(w[s:s+12], ' ') AS run
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM words)
    ), firsts AS (SELECT run, min(doc_id) AS first_id FROM starts GROUP BY run),
    gone AS (
      SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS p
      FROM starts JOIN firsts USING (run) WHERE first_id < doc_id
    ), taken AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
    kept AS (
      SELECT words.doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
        CASE WHEN ps IS NULL THEN array_to_string(w, ' ') ELSE left_text END AS kept
      FROM words LEFT JOIN taken USING (doc_id) LEFT JOIN (
        SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS left_text
        FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words)
        ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
      ) USING (doc_id)
    )
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
      sha256(coalesce(kept, '')) AS kept_sha256 FROM kept
    """
)
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


@query()
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, BYTE_BPE).select("doc_id", "ids"), BYTE_BPE)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return unigram.count_tokens(docs, BYTE_BPE).drop("text")


#: Rows of (doc_id or item_id, shingle) as the operators on shingles define them.
SHINGLES = r"""
    {name} AS (
      SELECT DISTINCT id, unnest(CASE WHEN len(w) BETWEEN 1 AND 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda s: array_to_string(w[s:s+4], ' ')) END) AS shingle
      FROM (SELECT {id} AS id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM {table})
    )
"""


@query(
    "WITH "
    + SHINGLES.format(name="d", id="doc_id", table="documents")
    + ","
    + SHINGLES.format(name="q", id="item_id", table="benchmark")
    + """
    , sizes AS (SELECT id, count(*) AS n FROM q GROUP BY id)
    SELECT d.id AS doc_id, q.id AS item_id, count(*) AS n_shared, any_value(n) AS n_item,
      count(*) / any_value(n) AS containment
    FROM d JOIN q USING (shingle) JOIN sizes ON sizes.id = q.id
    GROUP BY d.id, q.id HAVING 100 * count(*) >= 80 * any_value(n)
    """
)
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "WITH RECURSIVE "
    + SHINGLES.format(name="d", id="doc_id", table="documents")
    + """
    , sets AS (SELECT id, list(shingle ORDER BY shingle) AS s, count(*) AS n FROM d GROUP BY id),
    nodes AS (SELECT s, min(id) AS node, any_value(n) AS n FROM sets GROUP BY s),
    e AS (SELECT node, n, unnest(s) AS shingle FROM nodes),
    links AS (
      SELECT a.node AS a, b.node AS b FROM e a JOIN e b ON a.shingle = b.shingle AND a.node <> b.node
        AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.node, b.node
      HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
    ), reach AS (
      SELECT node AS a, node AS b FROM nodes
      UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
    ), least AS (SELECT a AS node, min(b) AS component_id FROM reach GROUP BY a)
    SELECT doc_id, coalesce(sets.n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id
    FROM documents LEFT JOIN sets ON sets.id = doc_id LEFT JOIN nodes USING (s) LEFT JOIN least USING (node)
    """
)
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.lower(F.hex("fingerprint")).alias("fingerprint"),
        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def _part(divisor: int, rest: int) -> Column:
    """Whether a document's number has this remainder; false for a null id."""
    remainder = F.crc32(F.col("doc_id").cast("string")) % divisor
    return F.coalesce(remainder == rest, F.lit(False))


@query()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", _part(5, 0))
    model = language.train(docs.where("NOT held_out AND doc_id IS NOT NULL"))
    return language.predict(docs.drop("lang"), model).select(
        "doc_id", "held_out", "lang_pred", "score"
    )


@query()
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", _part(3, 1))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.train(docs.where("NOT held_out"), "quality", labels=labels)
    return quality.predict(docs, model).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query()
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_pii(docs)

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE))
    return found.select(
        "doc_id",
        *[count(kind) for kind in pii.BASE],
        F.sha2(pii.written(base), 256).alias("base_sha256"),
        pii.written(F.col("pii")).alias("spans"),
    )


@query()
def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (~_part(5, 1)).alias("train"))
    return score_texts(docs, "train").select(
        "doc_id", _part(5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query()
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(rows, whitening.fit(rows))


@query(
    r"""
    WITH RECURSIVE texts AS (
      SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
      FROM documents
    ), firsts AS (
      SELECT text, min(doc_id) AS first_id FROM texts GROUP BY text
    ), marks AS (
      SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
        max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id
    ), masks AS (
      SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        len(w) < 200 AS a,
        100 * len(list_distinct(w)) < 50 * len(w) AS b,
        100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * len(text) AS c,
        regexp_matches(text, '[#$%&*|]') AS d,
        coalesce(doc_id > first_id, false) AS e
      FROM texts JOIN firsts USING (text) LEFT JOIN marks USING (doc_id)
    ), fails AS (
      SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END
        || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END
        || CASE WHEN e THEN 'E' ELSE '' END AS mask,
        count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
      FROM masks GROUP BY ALL
    ), orders(filter_order) AS (
      SELECT '' UNION ALL
      SELECT filter_order || letter FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) AS u(letter)
      WHERE NOT contains(filter_order, letter)
    ), steps AS (
      SELECT filter_order, step, filter_order[step] AS f, filter_order[:step - 1] AS earlier
      FROM orders, range(1, 6) AS r(step) WHERE len(filter_order) = 5
    ), counted AS (
      SELECT part, filter_order, step, f,
        sum(n) FILTER (translate(mask, earlier || f, '') = mask) AS kept,
        sum(n) FILTER (contains(mask, f) AND translate(mask, earlier, '') = mask) AS removed,
        sum(n) FILTER (contains(mask, f) AND translate(mask, earlier, '') <> mask) AS redundant,
        sum(n) FILTER (mask = f) AS unique_fails,
        sum(good) FILTER (contains(mask, f) AND translate(mask, earlier, '') = mask) AS good_lost,
        sum(toxic) FILTER (contains(mask, f) AND translate(mask, earlier, '') = mask) AS toxic_lost
      FROM fails, steps GROUP BY part, filter_order, step, f
    )
    SELECT part, filter_order, CAST(step AS INTEGER) AS step,
      CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
      CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
      CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
      CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
      CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
      CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley
    FROM counted
    """
)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit_quality(docs, table(spark, sf_dir, "labels"))


@query(
    """
    WITH vectors AS (
      SELECT vec_id, list_transform(embedding, lambda c: floor(64 * CAST(c AS DOUBLE))) AS x
      FROM embeddings
      WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    ), scores AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
      FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id
    )
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
      vec_id, score
    FROM scores QUALIFY rank <= 20
    """
)
def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
