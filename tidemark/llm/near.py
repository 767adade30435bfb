"""Near-duplicate documents: grouped prefix join on the Jaccard similarity of word shingles, exact.

1. Blocks count in how many documents each shingle stands (:mod:`tidemark.llm.blocks`). Shingles are
   ordered from rare to frequent. Two sets as similar as asked share a shingle of their prefixes, and
   shingles of one document only can't be it, so they are left out.
2. Documents with equal sets are one node. Nodes with identical prefix and size are one group.
3. Groups that share a prefix shingle and could be similar by size are candidates. They are not paired:
   each hangs on the least group of its shingle and size class, and what is connected so far is a
   *bundle*. Links exist inside bundles only.
4. Bundles are expanded to their members and verified on full sets: first all members against one hub,
   for :data:`ROUNDS` hubs. Then every pair that shares a prefix shingle and is not yet connected is
   verified, except among members of a bundle's largest part. So no link between different parts
   is missed, and a part of many copies costs a few comparisons each.
5. Connected components of the verified links.

Defined results: null, empty and blank texts have no shingles and are linked with nothing, not even
with each other. Rows that repeat an id are documents of their own. A null id is carried; components
are named by their least non-null id. Columns of the input other than id and text are dropped. As an
id may stand in several components, the name does not tell them apart: ``stays`` does, see there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import blocks
from tidemark.llm import text as tx
from tidemark.llm.graph import components
from tidemark.scratch import materialise

ROUNDS = 3

#: Sets that are compared at a time: so many outside the largest part of a bundle, with so many of it.
CHUNK_SETS = 512
PIECE_SETS = 2048

#: Bits of a shingle's hash by which its frequency is counted; more than one shingle may share them.
COUNTED = 40

PROFILE = (
    "block int, doc_id long, n long, node long, prefix_hash long, prefix array<long>, "
    "shared double, members binary"
)


def _shares(sets: np.ndarray) -> np.ndarray:
    return sets >> np.uint64(64 - COUNTED)


def _send(shards: int):
    def send(key: tuple, table: pa.Table) -> pa.Table:
        sets, _ = tx.shingle_sets(*tx.text_bytes(table.column("text")))
        values, counts = np.unique(_shares(sets), return_counts=True)
        bounds = blocks.shard_bounds(values << np.uint64(64 - COUNTED), shards)
        full = np.flatnonzero(np.diff(bounds))
        parts = [(values[bounds[s] : bounds[s + 1]], counts[bounds[s] : bounds[s + 1]]) for s in full]
        return pa.table(
            {
                "shard": pa.array(full, pa.int32()),
                "block": pa.array([key[0].as_py()] * len(full), pa.int32()),
                "n": pa.array([len(v) for v, _ in parts], pa.int32()),
                "packed": pa.array([tx.pack_sorted(v) for v, _ in parts], pa.binary()),
                "counts": pa.array([tx.pack(c.astype(np.uint32)) for _, c in parts], pa.binary()),
            }
        )

    return send


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """For each value that a block sent: how many bits the number of its documents has."""
    sizes = table.column("n").to_numpy()
    packed, counts = table.column("packed"), table.column("counts")
    values = np.concatenate(
        [tx.unpack_sorted(p.as_py(), int(n)) for p, n in zip(packed, sizes, strict=True)]
    )
    counts = np.concatenate(
        [tx.unpack(c.as_py(), int(n), np.uint32) for c, n in zip(counts, sizes, strict=True)]
    )
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    first = np.ones(len(ordered), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    totals = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(first))
    level = np.empty(len(ordered), np.uint8)
    level[order] = np.frexp(totals.astype(np.float64))[1][np.cumsum(first) - 1]
    parts = np.split(level, np.cumsum(sizes)[:-1])
    return pa.table(
        {
            "block": table.column("block"),
            "shard": table.column("shard"),
            "n": table.column("n"),
            "levels": pa.array([tx.pack(x) for x in parts], pa.binary()),
        }
    )


def _profile(percent: int, carried: list[str]):
    def profile(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs, answers = docs.sort_by("doc_id"), answers.sort_by("shard")
        sets, bounds = tx.shingle_sets(*tx.text_bytes(docs.column("text")))
        _, inverse = np.unique(_shares(sets), return_inverse=True)
        levels = np.concatenate(
            [np.zeros(0, np.uint8)]
            + [
                tx.unpack(x.as_py(), n.as_py(), np.uint8)
                for x, n in zip(answers.column("levels"), answers.column("n"), strict=True)
            ]
        )[inverse]
        seen: set[int] = set()
        out: dict[str, list] = {k: [] for k in ("n", "node", "hash", "prefix", "shared", "members")}
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            mine, level, n = sets[a:b], levels[a:b], int(b - a)
            node = int(tx.mix(tx.mix(mine).sum(keepdims=True) + np.uint64(n)).view(np.int64)[0])
            order = np.lexsort((mine, level))[: n - (percent * n + 99) // 100 + 1] if n else []
            chosen = mine[order].view(np.int64) if n else mine.view(np.int64)
            common = level[order] > 1 if n else np.zeros(0, bool)
            prefix_hash = int(tx.mix(tx.mix(chosen.view(np.uint64)).sum(keepdims=True)).view(np.int64)[0])
            useful = common.any() and node not in seen
            if useful:
                seen.add(node)
            out["n"].append(n)
            out["node"].append(node)
            out["hash"].append(prefix_hash)
            out["prefix"].append(chosen[common].tolist() if useful else None)
            out["shared"].append(float(level.mean()) if n else 0.0)
            out["members"].append(mine.tobytes() if useful else None)
        return pa.table(
            {
                "block": docs.column("block").cast(pa.int32()),
                "doc_id": docs.column("doc_id"),
                "n": pa.array(out["n"], pa.int64()),
                "node": pa.array(out["node"], pa.int64()),
                "prefix_hash": pa.array(out["hash"], pa.int64()),
                "prefix": pa.array(out["prefix"], pa.list_(pa.int64())),
                "shared": pa.array(out["shared"], pa.float64()),
                "members": pa.array(out["members"], pa.binary()),
                **{c: docs.column(c) for c in carried},
            }
        )

    return profile


def _verified(pairs: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` (a, b, members_a, members_b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                x = np.frombuffer(left.as_buffer(), np.uint64)
                y = np.frombuffer(right.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)], ["a", "b"]
            ).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "members_a", "members_b").mapInArrow(run, "a long, b long")


def _compare(percent: int):
    """Links between the sets of a chunk and those of a piece that have other labels."""

    def compare(chunk: pa.Table, piece: pa.Table) -> pa.Table:
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not (chunk.num_rows and piece.num_rows):
            return none
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in chunk.column("members")]
        sizes = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        every = np.concatenate(sets)
        order = np.argsort(every)
        every, owner = every[order], owner[order]
        labels, nodes = (chunk.column(c).to_numpy() for c in ("label", "node"))
        out = [none]
        for node, label, raw in zip(
            piece.column("node"), piece.column("label"), piece.column("members"), strict=True
        ):
            mine = np.frombuffer(raw.as_buffer(), np.uint64)
            low = np.searchsorted(every, mine, "left")
            found = np.searchsorted(every, mine, "right") - low
            ends = np.cumsum(found)
            at = np.repeat(low - ends + found, found) + np.arange(ends[-1])
            both = np.bincount(owner[at], minlength=len(sets))
            near = 100 * both >= percent * (sizes + len(mine) - both)
            hits = nodes[near & (labels != label.as_py())]
            if len(hits):
                out.append(pa.table({"a": hits, "b": np.full(len(hits), node.as_py())}))
        return pa.concat_tables(out)

    return compare


def _sized(percent: int, x: str, y: str) -> str:
    return f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})"


def _keys(nodes: DataFrame, percent: int, *columns: str) -> DataFrame:
    """A row per prefix shingle and size class; sizes that can be similar share a class."""
    grade = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9)
    return nodes.select(
        *columns, "n", F.explode("prefix").alias("token"), grade.cast("int").alias("g")
    ).select(*columns, "n", "token", F.explode(F.array("g", F.col("g") + 1)).alias("g"))


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    percent: int = 80,
    stays: bool = False,
) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per document, with its class.

    With ``stays`` also ``text_hash``, the ``xxhash64`` of the text, by which rows of one id are told
    apart, and ``stays``: false for all rows of a class but that of the least id, then hash. Rows
    equal in both stay together; a row without an id or in no class stays.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    carried = ["text_hash"] if stays else []
    if stays:
        rows = rows.withColumn("text_hash", F.xxhash64("text"))
    dealt, number, shards = blocks.deal(rows, "doc_id", "text")
    anywhere = F.pmod(F.xxhash64("text"), F.lit(number)).cast("int")
    dealt = dealt.withColumn("block", F.when(F.col("doc_id").isNull(), anywhere).otherwise(F.col("block")))
    sent = dealt.groupBy("block").applyInArrow(
        _send(shards), "shard int, block int, n int, packed binary, counts binary"
    )
    answers = sent.groupBy("shard").applyInArrow(
        _answer, "block int, shard int, n int, levels binary"
    )
    profiles = materialise(
        dealt.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(_profile(percent, carried), ", ".join([PROFILE, *[f"{c} long" for c in carried]])),
        "profiles",
    )

    # One row per set that shares a prefix shingle with anything, and its group.
    useful = profiles.where("members IS NOT NULL").select(
        "block", "node", "n", "prefix_hash", "prefix", "shared", "members"
    )
    first = useful.groupBy("node").agg(F.min("block").alias("block"))
    nodes = useful.join(first, ["node", "block"]).drop("block")
    named = nodes.groupBy("prefix_hash", "n").agg(F.min("node").alias("group"))
    heads = nodes.select("node", "n", "prefix_hash", "prefix").join(named, ["prefix_hash", "n"])
    keys = materialise(
        _keys(heads.where("node = group"), percent, "group").select("token", "g", "group"), "keys"
    )
    hubs = keys.groupBy("token", "g").agg(F.min("group").alias("hub"), F.count("*").alias("c"))
    edges = (
        keys.join(hubs.where("c > 1"), ["token", "g"]).where("hub <> group").select("hub", "group")
    )
    bundled = components(edges.distinct()).withColumnsRenamed({"node": "group", "label": "bundle"})
    placed = (
        nodes.join(named, ["prefix_hash", "n"])
        .join(bundled, "group", "left")
        .withColumn("bundle", F.coalesce("bundle", "group"))
    )
    crowded = (
        placed.select("bundle").groupBy("bundle").count().where("count > 1").select("bundle")
    )
    members = materialise(
        placed.join(crowded, "bundle").select("bundle", "node", "n", "shared", "members"), "bundles"
    )

    links = None
    done = None
    for _ in range(ROUNDS):
        loose = members.select("bundle", "node", "shared")
        if done is not None:
            loose = loose.join(done, "node", "left_anti")
        chosen = loose.groupBy("bundle").agg(
            F.max_by("node", F.struct("shared", "node")).alias("node")
        )
        hubs = members.join(chosen, ["bundle", "node"]).select(
            "bundle", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("members").alias("members_a")
        )
        pairs = members.join(hubs, "bundle").where(f"node <> a AND {_sized(percent, 'n', 'n_a')}")
        found = _verified(
            pairs.withColumnsRenamed({"node": "b", "members": "members_b"}), percent
        )
        found = found.unionByName(chosen.select(F.col("node").alias("a"), F.col("node").alias("b")))
        found = materialise(found, "links")
        links = found if links is None else links.unionByName(found)
        done = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        if members.select("node").join(done, "node", "left_anti").isEmpty():
            break

    # What is still in different parts of a bundle is compared, except inside its largest part: the
    # members outside that part, in chunks, against all members, in pieces.
    labels = components(links.select("a", "b"))
    parts = members.select("bundle", "node").join(labels, "node", "left")
    parts = parts.withColumn("label", F.coalesce("label", "node"))
    sizes = parts.groupBy("bundle", "label").agg(F.count("*").alias("c"))
    totals = sizes.groupBy("bundle").agg(
        F.max_by("label", F.struct("c", "label")).alias("largest"),
        F.ceil(F.sum("c") / PIECE_SETS).cast("int").alias("pieces"),
        F.ceil((F.sum("c") - F.max("c")) / CHUNK_SETS).cast("int").alias("chunks"),
    )
    placed = parts.join(totals.where("chunks > 0"), "bundle").withColumns(
        {
            "chunk": F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"),
            "piece": F.pmod(F.xxhash64("node", "bundle"), F.col("pieces")).cast("int"),
        }
    )
    placed = materialise(placed.join(members.select("node", "members"), "node"), "parts")

    def spread(rows: DataFrame, column: str, number: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.col(number) - 1)).alias(column)
        own = "piece" if column == "chunk" else "chunk"
        return rows.select("bundle", own, every, "node", "label", "members")

    key = ["bundle", "chunk", "piece"]
    outside = spread(placed.where("label <> largest"), "piece", "pieces").groupBy(*key)
    inside = spread(placed, "chunk", "chunks").groupBy(*key)
    checked = outside.cogroup(inside).applyInArrow(_compare(percent), "a long, b long")
    links = links.unionByName(materialise(checked, "links")).select("a", "b")

    labels = components(links)
    with_id = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", *carried))
    first = [F.min(with_id).alias("first")] if stays else []
    one = [F.min("first").alias("one")] if stays else []
    named = profiles.where("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("c"), *first
    )
    named = named.join(labels, "node", "left").where("c > 1 OR label IS NOT NULL")
    named = named.withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"), *one)
    classes = named.join(least, "label").drop("label", "least", "c", "first")
    classes = materialise(classes, "classes")
    own = F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("doc_id"))
    out = [F.col("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id")]
    if stays:
        same = F.struct("doc_id", "text_hash") == F.col("one")
        free = (F.col("n") == 0) | F.col("doc_id").isNull() | F.col("one").isNull()
        out += [F.col("text_hash"), (free | same).alias("stays")]
    return profiles.join(classes, "node", "left").select(*out)
