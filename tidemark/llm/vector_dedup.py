"""Embedding near-dedup (operator 12): sorted projection passes, verified pairs united across passes,
and the exact number of links inside every component.

Each pass orders the vectors lexicographically by a few concatenated random hashes and compares each
one with a bounded window of those before it. Pairs that are verified are united. A window cannot hold all
partners of a vector in a large group, so links are then counted inside each component, over all of
its pairs, in blocks whose bounds often decide without looking at a vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.batches import groups
from tidemark.llm.common import discard, materialize, table
from tidemark.llm.graph import components

COSINE = 0.9
#: Passes over so many vectors, and how they grow with the number of vectors (see ``passes_for``).
PASSES, PASSES_AT, GROWTH = 32, 50_000, 0.18
#: Vectors before it in the order that each vector is compared with, in every pass.
WINDOW = 64
#: Concatenated hashes of a pass's key; each names the axis of up to AXES random ones that a vector lies closest to, and its sign.
HASHES, AXES = 6, 16
#: Signs of random projections in a vector's sketch.
BITS = 256
#: Standard deviations by which the differing signs of a pair at the least cosine may exceed their mean
#: in a window; a pair that differs as much less than the mean is first taken to be linked.
SIGMAS, SURE = 4.5, 2.7
#: Vectors of a block inside a component.
BLOCK = 512
_SEED = 12


def passes_for(n: int) -> int:
    """Passes for ``n`` vectors. A pass of fixed window finds a pair at the least cosine with a chance that
    falls as n ** -GROWTH (0.26 at 50,000 vectors and 0.17 at 500,000, measured), so passes grow with it."""
    return ceil(PASSES * max(1.0, n / PASSES_AT) ** GROWTH)


@lru_cache(maxsize=8)
def _projections(width: int, passes: int) -> tuple[np.ndarray, np.ndarray]:
    """For vectors of ``width`` components: the axes of every hash of every pass, and a sketch's directions."""
    rng = np.random.Generator(np.random.PCG64([_SEED, width]))
    signs = rng.standard_normal((width, BITS))
    axes = [np.linalg.qr(rng.standard_normal((width, min(AXES, width))))[0] for _ in range(passes * HASHES)]
    return np.concatenate(axes, axis=1).astype(np.float32), signs.astype(np.float32)


def unit(vectors: list) -> np.ndarray:
    """Rows of double precision and length 1, safe from overflow."""
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashed(x: np.ndarray, passes: int) -> tuple[np.ndarray, np.ndarray]:
    """A key of HASHES concatenated hashes for each pass, and the sketch as BITS / 64 numbers."""
    axes, signs = _projections(x.shape[1], passes)
    short, own = min(AXES, x.shape[1]), x.astype(np.float32)
    seen = (own @ axes).reshape(len(x), passes, HASHES, short)
    at = np.abs(seen).argmax(axis=3)
    value = at * 2 + (np.take_along_axis(seen, at[..., None], axis=3)[..., 0] > 0)
    keys = np.zeros((len(x), passes), np.int64)
    for k in range(HASHES):
        keys = keys * (2 * AXES) + value[:, :, k]
    return keys, np.packbits(own @ signs > 0, axis=1).view(np.uint64)


def _usable(v: list | None) -> bool:
    return bool(v) and None not in v and bool(np.isfinite(v).all()) and any(v)


def signatures(vectors: DataFrame, passes: int) -> DataFrame:
    """vec_id, digest of the vector's values (null if it cannot link), width, vector, keys and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                ids, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                digest, keys, sketch, width, kept = ([None] * len(ids) for _ in range(5))
                by_width: dict[int, list[int]] = {}
                for k, v in enumerate(values):
                    if ids[k] is not None and _usable(v):
                        by_width.setdefault(len(v), []).append(k)
                for w, at in by_width.items():
                    own, marks = _hashed(unit([values[k] for k in at]), passes)
                    for k, key, mark in zip(at, own.tolist(), marks):
                        raw = np.array(values[k], np.float64) + 0.0  # one zero
                        digest[k], keys[k], sketch[k], width[k], kept[k] = hashlib.blake2b(raw.tobytes(), digest_size=16).digest(), key, mark.tobytes(), w, values[k]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digest, pa.binary()), pa.array(width, pa.int32()), pa.array(kept, pa.list_(pa.float64())), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], ["vec_id", "digest", "width", "x", "keys", "sketch"])

    return vectors.mapInArrow(run, "vec_id bigint, digest binary, width int, x array<double>, keys array<bigint>, sketch binary")


def limits(cosine: float) -> tuple[int, int]:
    """Signs that a pair may differ in to be tried, and to be taken as linked ahead of its check."""
    p = np.arccos(cosine) / np.pi
    spread = np.sqrt(BITS * p * (1 - p))
    return int(BITS * p + SIGMAS * spread), int(BITS * p - SURE * spread)


def window_pairs(order: np.ndarray, node: np.ndarray, sketch: np.ndarray, cosine: float, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Pairs to verify among sorted rows: of rows no more than ``window`` apart in one pass (``order``) those
    whose sketches allow it. Runs of rows that look surely linked are chained by one pair each; any other
    pair inside one chain would unite nothing and is left out."""
    tried, sure = limits(cosine)
    n = len(node)
    parent, held = np.arange(n), []
    for w in range(1, min(window, n - 1) + 1):
        differ = np.bitwise_count(sketch[w:] ^ sketch[:-w]).sum(axis=1, dtype=np.int32)
        at = np.flatnonzero((differ <= tried) & (order[w:] == order[:-w])) + w
        near = at[(differ[at - w] <= sure) & (parent[at] == at)]
        parent[near] = near - w
        held.append((at, at - w))
    if not held:
        return node[:0], node[:0]
    chain = parent.copy()
    while (up := chain[chain] != chain).any():
        chain[up] = chain[chain[up]]
    a, b = (np.concatenate(x) for x in zip(*held))
    new = (chain[a] != chain[b]) | (parent[a] == b)
    return node[a[new]], node[b[new]]


def _sorted_pairs(nodes: DataFrame, cosine: float, window: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, that some pass has within its window and sketches do not refuse.

    All passes are sorted in one job by range, where equal keys are told apart by the node, so a key
    that many vectors share is many partitions. A partition also gives its first and last rows, and
    these alone are compared across the cut."""
    spread = nodes.select(F.posexplode("keys").alias("pass", "key"), "width", "node", "sketch")
    ordered = spread.repartitionByRange("width", "pass", "key", "node").sortWithinPartitions("width", "pass", "key", "node")

    def columns(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = rows.column("width").to_numpy().astype(np.int64) << 32 | rows.column("pass").to_numpy()
        return order, rows.column("node").to_numpy(), np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(rows.num_rows, BITS // 64)

    def batch_of(kind: int, cut: int, order: np.ndarray, a: np.ndarray, b: np.ndarray, sketch: np.ndarray | None = None) -> pa.RecordBatch:
        raw = pa.nulls(len(a), pa.binary()) if sketch is None else pa.array([s.tobytes() for s in sketch], pa.binary())
        full = lambda v, t: pa.array(np.full(len(a), v), t)
        return pa.RecordBatch.from_arrays([full(kind, pa.int32()), full(cut, pa.int32()), pa.array(order, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), raw, pa.array(np.arange(len(a)), pa.int64())], ["kind", "cut", "ord", "a", "b", "sketch", "nth"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, last, head = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = columns(batch)
            rows = rows if last is None else tuple(np.concatenate(x) for x in zip(last, rows))
            if head is None or len(head[0]) < window:
                head = tuple(x[:window].copy() for x in rows)  # grows with the rows before, until it is full
            a, b = window_pairs(*rows, cosine, window)
            if len(a):
                yield batch_of(0, cut, np.zeros(len(a), np.int64), a, b)
            last = tuple(x[-window:].copy() for x in rows)
        if last is not None:
            yield batch_of(1, cut, head[0], head[1], head[1], head[2])
            yield batch_of(2, cut, last[0], last[1], last[1], last[2])

    kind = "kind int, cut int, ord bigint, a bigint, b bigint, sketch binary, nth bigint"
    found = materialize(ordered.mapInArrow(run, kind), "window-pairs")
    cuts = found.where("kind > 0").select("cut").distinct().withColumn("place", F.dense_rank().over(Window.orderBy("cut")))  # a row per partition
    ends = found.where("kind > 0").join(F.broadcast(cuts), "cut").withColumn("place", F.col("place") - F.when(F.col("kind") == 1, 1).otherwise(0))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, ["place"]):
            sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(rows.num_rows, BITS // 64)
            a, b = window_pairs(rows.column("ord").to_numpy(), rows.column("a").to_numpy(), sketch, cosine, window)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    # the tail of one partition, then the head of the next
    ends = ends.select("place", "ord", "a", "sketch", F.col("kind").alias("k"), "nth").repartition("place").sortWithinPartitions("place", F.desc("k"), "nth")
    both = found.where("kind = 0").select("a", "b").unionByName(ends.mapInArrow(across, "a bigint, b bigint"))
    pairs = materialize(both.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "vector-pairs")
    discard(found)
    return pairs


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, y)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def verified(pairs: DataFrame, nodes: DataFrame, cosine: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose vectors have the cosine in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            left, right = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            good = np.zeros(batch.num_rows, bool)
            for w in {len(v) for v in left}:  # pairs are of one width each
                at = [k for k, v in enumerate(left) if len(v) == w]
                good[at] = cosines(unit([left[k] for k in at]), unit([right[k] for k in at])) >= cosine
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(good))

    left, right = nodes.select(F.col("node").alias("a"), "x"), nodes.select(F.col("node").alias("b"), F.col("x").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _slot(members: DataFrame, name: str) -> DataFrame:
    """Members in blocks of BLOCK, in the order of the first pass's key, so that a block holds what is alike. Places
    come from counts per slice of the order, so a component is no single task."""
    members = members.withColumn("slice", F.floor(F.element_at("keys", 1) / (2 * AXES) ** (HASHES - 2)))
    counts = members.groupBy("component", "slice").agg(F.count(F.lit(1)).alias("m"))
    counts = counts.withColumn("parts", F.ceil(F.col("m") / BLOCK).cast("int"))
    before = Window.partitionBy("component").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("first", F.coalesce(F.sum("parts").over(before), F.lit(0)))
    return materialize(members.join(counts, ["component", "slice"]).withColumn("block", (F.col("first") + F.pmod(F.xxhash64("node"), F.col("parts"))).cast("bigint")).drop("slice", "m", "parts", "first"), name)


def link_weights(members: DataFrame, cosine: float) -> DataFrame:
    """(node, linked): how many rows of other vectors each node of ``members`` (component, node, n, x, keys)
    has a link with, over all pairs of its component.

    A block's mean direction and the greatest angle to it bound every angle between two blocks. Block
    pairs that must all link or cannot link are settled by the bounds; the rest are compared in numpy, one pair of
    blocks at a time, and give one number per vector, never a pair."""
    blocks = _slot(members, "blocks")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (component, block), rows in groups(batches, ["component", "block"]):
            x = unit(_matrix(rows.column("x")))
            mean = x.mean(axis=0)
            center = mean / max(np.linalg.norm(mean), 1e-300)
            angle = float(np.arccos(np.clip(x @ center, -1, 1)).max()) if np.linalg.norm(mean) > 1e-9 else np.pi
            yield pa.RecordBatch.from_pylist([{"component": component, "block": block, "center": center.tolist(), "angle": angle, "rows": int(rows.column("n").to_numpy().sum())}], schema=pa.schema([("component", pa.int64()), ("block", pa.int64()), ("center", pa.list_(pa.float64())), ("angle", pa.float64()), ("rows", pa.int64())]))

    lean = blocks.select("component", "block", "node", "n", "x")
    bounds = lean.repartition("component", "block").sortWithinPartitions("component", "block", "node").mapInArrow(bound, "component bigint, block bigint, center array<double>, angle double, rows bigint")
    bounds = materialize(bounds, "bounds")
    a, b = bounds.alias("a"), bounds.alias("b")
    dot = F.aggregate(F.zip_with("a.center", "b.center", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))
    met = a.join(b, F.col("a.component") == F.col("b.component")).select("a.component", F.col("a.block").alias("i"), F.col("b.block").alias("j"), F.col("b.rows").alias("rows"), apart.alias("apart"), (F.col("a.angle") + F.col("b.angle")).alias("wide"))
    limit, slack = float(np.arccos(cosine)), 1e-6  # far above the rounding of either side
    state = F.when(F.col("apart") + F.col("wide") <= limit - slack, "all").when(F.col("apart") - F.col("wide") >= limit + slack, "none").otherwise("some")
    met = materialize(met.withColumn("state", state).where("state <> 'none'"), "block-pairs")
    whole = met.where("state = 'all'").groupBy("component", F.col("i").alias("block")).agg(F.sum("rows").alias("linked"))
    whole = lean.join(whole, ["component", "block"]).select("node", "linked")
    open_pairs = met.where("state = 'some'").select("component", "i", "j")
    left = open_pairs.join(lean, (open_pairs.component == lean.component) & (open_pairs.i == lean.block)).select(open_pairs.component, "i", "j", F.lit(0).alias("side"), "node", "n", "x")
    right = open_pairs.join(lean, (open_pairs.component == lean.component) & (open_pairs.j == lean.block)).select(open_pairs.component, "i", "j", F.lit(1).alias("side"), "node", "n", "x")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, ["component", "i", "j"]):
            x, first = unit(_matrix(rows.column("x"))), rows.column("side").to_numpy() == 0
            node, n = rows.column("node").to_numpy(), rows.column("n").to_numpy()
            # products of matrices tell all but what is close to the limit, which is then taken as a pair is
            seen = x[first] @ x[~first].T
            close = np.nonzero(np.abs(seen - cosine) < 1e-9)
            linked = seen >= cosine
            linked[close] = cosines(x[first][close[0]], x[~first][close[1]]) >= cosine
            yield pa.RecordBatch.from_arrays([pa.array(node[first]), pa.array((linked * n[~first]).sum(axis=1, dtype=np.int64))], ["node", "linked"])

    dealt = left.unionByName(right).repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "side", "node")
    out = whole.unionByName(dealt.mapInArrow(compare, "node bigint, linked bigint")).groupBy("node").agg(F.sum("linked").alias("linked"))
    out = materialize(out, "linked")
    discard(blocks, bounds, met)
    return out  # with the node's own rows, which are alike


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", passes: int | None = None, window: int = WINDOW) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Vectors are linked if their cosine in double precision is ``cosine`` or more; equal ones are. Only
    vectors of the same width are compared. One that is null, empty or zero, or holds a null or a value that is not
    finite, links with nothing; so does a row with a null id, whose component is null and which is
    kept. Rows that repeat an id are rows of their own and count as links of each other if their vectors
    are linked. An empty table gives no rows. Only the two columns are read, so others cannot clash.

    Components come from the pairs that passes find; inside a component links are counted over all
    pairs, so only a pair that no chain of found links joins can be missed."""
    spark = vectors.sparkSession
    source = vectors.select(vectors[id_col].cast("bigint").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("x"))
    passes = passes or passes_for(source.count())
    marks = materialize(signatures(source, passes), "vectors")
    nodes = marks.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("width", "x", "keys", "sketch")))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    pairs = _sorted_pairs(nodes, cosine, window)
    links = materialize(verified(pairs, nodes, cosine), "vector-links")
    joined = materialize(components(links), "vector-components") if not links.isEmpty() else spark.createDataFrame([], "node bigint, component bigint")
    members = materialize(nodes.join(joined, "node").select("component", "node", "n", "x", "keys", "least"), "members")
    linked = link_weights(members.drop("least"), cosine)
    least = members.groupBy("component").agg(F.min("least").alias("component_id"))
    found = members.select("node", "component").join(least, "component").join(linked, "node").select("node", "linked", "component_id")
    per_digest = nodes.select("digest", "node", "n", "least").join(found, "node", "left").select("digest", (F.coalesce("linked", "n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    # Rows of one vector are not joined with each other but with their node, and Spark splits a skewed side.
    out = marks.select("vec_id", "digest").join(per_digest, "digest", "left")
    component = F.coalesce("component_id", "vec_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
    out = materialize(out, "near-vectors")
    discard(marks, nodes, pairs, links, joined, members, linked)
    return out


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: All pairs, by brute force.
OP12_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
good AS (SELECT * FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT a AS vec_id, min(b) AS least FROM reach GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept FROM v LEFT JOIN low USING (vec_id) LEFT JOIN n USING (vec_id)
"""
