"""Near-duplicate embeddings: binary codes by iterative quantisation, multi-index Hamming tables, exact reranking.

1. Equal vectors of a label become one representative with a count, so groups of copies cost one row.
2. A rotation is learned on a bounded sample (SAMPLE representatives by hash of their values, a parameter): principal
   axes, then alternating between codes and the rotation that fits them best (orthogonal Procrustes).
3. Each representative's code is cut into substrings in two ways (neighbouring bits, bits taken in turn), each of which
   is a table. Two codes are candidates if some substring differs in at most ``radius`` bits and the whole code
   in at most ``most`` bits; that is checked inside the join. Both bounds follow from the threshold (``bounds``).
4. Candidates are reranked: cosine of the original vectors in double precision decides, none below the threshold links.

All rows are indexed. What is approximate is the candidate search; tests measure its recall against brute force, for thresholds from 0.85 to 0.98 and 16 to 256 dimensions.

Cases: vectors that are null, empty, zero, or hold nulls, NaN or infinities link with nothing; so do rows with null label or
vec_id; vectors of different lengths don't link; vectors of a length the sample lacks share one code; rows that repeat a
vec_id are equal or different vectors like any others (representatives are told apart by their values, ids name components alone); extra
columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, comb, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import connected_components, second_hash, written

SAMPLE, BITS, PARTS = 8192, 64, 4


def itq(x: np.ndarray, bits: int, rounds: int = 40, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) of unit vectors ``x``: codes are the signs of (v - mean) @ projection."""
    mean = x.mean(axis=0)
    centred = x - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    v = centred @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(v.shape[1], v.shape[1])))
    for _ in range(rounds):
        left, _, right = np.linalg.svd(v.T @ np.where(v @ turn >= 0, 1.0, -1.0))
        turn = left @ right
    return mean, axes @ turn


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _coder(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection to BITS): one rotation, or, of vectors shorter than a code, as many as fill it, each from another begin."""
    parts = [itq(x, min(BITS, x.shape[1]), seed=i) for i in range(-(-BITS // x.shape[1]))]
    return parts[0][0], np.concatenate([p for _, p in parts], axis=1)[:, :BITS]


def codes(reps: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``reps`` (with embedding, dims) with code, a long."""
    some = reps.orderBy("h1", "h2").limit(sample).select("embedding", "dims").toArrow()
    dims = some["dims"].to_numpy()
    flat = some["embedding"].to_pylist()
    models = {}
    for d in np.unique(dims):
        models[int(d)] = _coder(_unit(np.array([v for v, n in zip(flat, dims) if n == d], float)))
    shared, place, names = reps.sparkSession.sparkContext.broadcast(models), reps.columns.index("embedding"), reps.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(place)
            sizes, out = np.diff(lists.offsets.to_numpy()), np.zeros(batch.num_rows, np.uint64)
            flat, starts = lists.flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum(sizes) - sizes
            for d, (mean, projection) in shared.value.items():
                if len(rows := np.flatnonzero(sizes == d)):
                    signs = (_unit(flat[starts[rows][:, None] + np.arange(d)]) - mean) @ projection > 0
                    bits = np.zeros((len(rows), BITS), np.uint8)
                    bits[:, : signs.shape[1]] = signs
                    out[rows] = np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.view(np.int64))], [*names, "code"])

    return reps.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in reps.schema] + ["code long"]))


def _tables() -> list[list[int]]:
    """The bits (0: lowest) of each table's substring."""
    size = BITS // PARTS
    return [list(range(i * size, (i + 1) * size)) for i in range(PARTS)] + [list(range(i, BITS, PARTS)) for i in range(PARTS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bounds(threshold: float) -> tuple[int, int]:
    """(radius, most) for pairs at the threshold: a random hyperplane parts their signs with probability p = angle / pi. ``most`` is four standard
    deviations above the bits that differ then; ``radius`` is the least by which the tables find 98 % of such pairs."""
    p = acos(threshold) / pi
    size = BITS // PARTS
    for radius in range(3):
        within = sum(comb(size, i) * p**i * (1 - p) ** (size - i) for i in range(radius + 1))
        if 1 - (1 - within) ** (2 * PARTS) >= 0.98:
            return radius, int(BITS * p + 4 * sqrt(BITS * p * (1 - p)))
    raise ValueError(f"tables of {size} bits find too few of the pairs of cosine {threshold}")


def _keys(radius: int) -> Column:
    """An array of (part, key) for code: all values of each substring within ``radius`` bits."""
    out = []
    for part, bits in enumerate(_tables()):
        own = F.col("code").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits))))
        for flip in (sum(1 << b for b in c) for n in range(radius + 1) for c in combinations(bits, n)):
            out.append(F.struct(F.lit(part).cast("byte").alias("part"), own.bitwiseXOR(F.lit(_signed(flip))).alias("key")))
    return F.array(*out)


def candidates(coded: DataFrame, radius: int, most: int) -> DataFrame:
    """(a, b), a > b: pairs of nodes of ``coded`` (node, label, dims, code) that the tables bring together."""
    probe = coded.select("label", "dims", F.col("node").alias("a"), "code", F.explode(_keys(radius)).alias("k")).select("label", "dims", "a", F.col("code").alias("code_a"), "k.part", "k.key")
    own = coded.select("label", "dims", F.col("node").alias("b"), "code", F.explode(_keys(0)).alias("k")).select("label", "dims", "b", F.col("code").alias("code_b"), "k.part", "k.key")
    near = F.bit_count(F.col("code_a").bitwiseXOR(F.col("code_b"))) <= most
    return probe.hint("merge").join(own, ["label", "dims", "part", "key"]).filter((F.col("a") > F.col("b")) & near).select("a", "b").distinct()


def cosines(pairs: DataFrame) -> DataFrame:
    """(a, b, cosine) of rows (a, b, x, y), in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = batch.column(2), batch.column(3)
            starts = x.offsets.to_numpy()[:-1] - x.offsets.to_numpy()[0]
            x, y = (c.flatten().to_numpy(zero_copy_only=False).astype(float) for c in (x, y))
            size = np.diff(np.append(starts, len(x)))
            x, y = (v / np.repeat(np.maximum.reduceat(np.abs(v), starts), size) for v in (x, y))
            dot = lambda p, q: np.add.reduceat(p * q, starts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dot(x, y) / np.sqrt(dot(x, x) * dot(y, y)))], ["a", "b", "cosine"])

    kinds = dict(pairs.dtypes)
    return pairs.select("a", "b", "x", "y").mapInArrow(run, f"a {kinds['a']}, b {kinds['b']}, cosine double")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding, label)."""
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    sound = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), "label", "embedding", sound.alias("sound"), F.xxhash64("label", "embedding").alias("h1"), second_hash(F.col("label"), e).alias("h2"))
    each = written(rows.select("id", "sound", "h1", "h2"), "vectors")
    first = rows.filter("sound").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    reps = written(first.select("h1", "h2", F.struct("id", "h1", "h2").alias("node"), "n", "label", "embedding", F.size("embedding").alias("dims")), "representatives")
    coded = written(codes(reps).select("node", "label", "dims", "code"), "codes")
    by = lambda name, other: reps.select(F.col("node").alias(name), F.col("embedding").alias(other))
    pairs = written(candidates(coded, *bounds(threshold)), "candidates")
    links = written(cosines(pairs.join(by("a", "x"), "a").join(by("b", "y"), "b")).filter(F.col("cosine") >= threshold).select("a", "b"), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = both.join(reps.select(F.col("node").alias("b"), "n"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    parts = connected_components(links)
    found = reps.select("node", "h1", "h2", "n").join(other, "node", "left").join(parts, "node", "left")
    found = written(found.select("h1", "h2", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node")["id"].alias("component_id"), F.lit(True).alias("sound")), "found")
    out = each.join(found, ["h1", "h2", "sound"], "left").select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
