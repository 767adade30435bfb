"""Bounded, reproducible samples of labelled texts to fit a model on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.scratch import materialise


def labelled_sample(
    docs: DataFrame,
    label: str,
    per_label: int,
    windows: int,
    chars: int,
    key: str = "doc_id",
    labels: DataFrame | None = None,
) -> list[tuple[str, str]]:
    """At most ``per_label`` documents of each label, as (label, piece of text).

    ``labels`` is the table of (key, label) where ``docs`` has no labels itself. Documents are chosen
    by hash of their key and text, so evenly from everything; rows without a key are not learnt from,
    and equal rows are one. Each gives up to ``windows`` pieces of ``chars`` characters from places
    chosen by hash; a shorter text is one piece. Texts are not shuffled: hashes are chosen first, and
    only those of the sample are looked up, at most ``labels * per_label``. The driver holds ``labels *
    per_label * windows * chars`` characters at most.
    """
    texts = docs.where(F.octet_length("text") > 0)
    named = F.col(key).alias("key")
    h = F.xxhash64(key, "text").alias("h")
    if labels is None:
        marks = texts.select(F.col(label).alias("label"), named, h)
    else:
        marks = texts.select(named, h).join(labels.select(F.col(label).alias("label"), named), "key")
    marks = marks.select(F.col("label").cast("string").alias("label"), "key", "h")
    marks = materialise(marks.where("label IS NOT NULL AND key IS NOT NULL"), "marks")
    # A row's rank needs the rows of its label together, so first keep about three times as many as
    # are wanted, by hash: a number of rows that doesn't grow with the input.
    counts = marks.groupBy("label").count().collect()
    share = F.lit(0.0)
    for row in counts:
        share = F.when(F.col("label") == row["label"], min(1.0, 3 * per_label / row["count"])).otherwise(share)
    place = F.pmod(F.col("h"), F.lit(1_000_003)) / 1_000_003
    first = Window.partitionBy("label").orderBy("h", "key")
    chosen = (
        marks.where(place < share)
        .distinct()
        .withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= per_label)
        .drop("rank")
    )
    spare = F.greatest(F.length("text") - chars, F.lit(0))
    pieces = F.transform(
        F.sequence(F.lit(1), F.lit(windows)),
        lambda i: F.substring(
            F.col("text"), (F.pmod(F.xxhash64("h", i), spare + 1) + 1).cast("int"), F.lit(chars)
        ),
    )
    found = (
        texts.select(named, h, "text")
        .join(F.broadcast(chosen), ["key", "h"])
        .select("label", "key", "h", F.explode(F.array_distinct(pieces)).alias("piece"))
        .distinct()
    )
    return sorted((r["label"], r["piece"]) for r in found.collect())


class Adam:
    """Gradient steps on a dict of arrays, in place."""

    def __init__(self, parameters: dict, rate: float):
        self.parameters, self.rate, self.t = parameters, rate, 0
        self.m = {k: 0 * v for k, v in parameters.items()}
        self.v = {k: 0 * v for k, v in parameters.items()}

    def step(self, gradients: dict) -> None:
        self.t += 1
        for k, g in gradients.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.999**self.t)
            self.parameters[k] -= self.rate * m / (v**0.5 + 1e-8)
