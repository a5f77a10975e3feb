"""Quality scores: a convolutional network on bytes, in numpy.

Each byte is a learned vector. Filters see WIDTH bytes and move by STEP, so windows overlap; the maximum of each filter is taken over chunks of CHUNK bytes,
which overlap by half and cover the whole text. A hidden layer looks at each chunk (its maxima, and how full it is), the maximum of each hidden unit is taken over the
chunks of a document, and one logistic unit combines these into a probability. As filters say what is in a chunk, hidden units can say what is
missing there, such as variety.

A row's texts are looked at in slices of SLICE bytes, so memory beyond the text itself doesn't grow with it. Training is on the driver, by Adam; gradients
follow the maxima alone.

Bounds, parameters of ``train``: ROWS labelled rows of each class, those of least hash of their ids, whole, as long as all fit in BYTES (a text that
doesn't is passed over). Probabilities are brought back from the balance of the sample to that of all labels. Scoring reads whole texts.

Cases: null text is an empty one, which has a chunk of nothing; rows with null label or id aren't learned from; of repeated labels of one id the largest
counts, of repeated texts of one id the least; without rows of both classes every score is the share of 1 among the labels (0.5 without labels); extra
columns pass through; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import bounded, free_name, release, written
from .langid import _with

ROWS, BYTES = 2000, 12_000_000
WIDTH, STEP, CHUNK, SLICE = 12, 4, 512, 1 << 16
VECTOR, FILTERS, HIDDEN = 8, 32, 16
HALF, PIECES = CHUNK // 2, WIDTH // STEP
WINDOWS = HALF // STEP


class Packed:
    """Texts as bytes, each in halves of chunks of its own and at least WIDTH - STEP zeros at its end."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.binary()).fill_null(b"")
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.sizes = np.diff(ends)
        self.halves = (self.sizes + WIDTH - STEP + HALF - 1) // HALF
        self.first = np.concatenate([[0], np.cumsum(self.halves)])
        self.bytes = np.zeros(self.first[-1] * HALF + WIDTH, np.uint8)
        for at, start, size in zip((self.first * HALF).tolist(), ends.tolist(), self.sizes.tolist()):
            self.bytes[at : at + size] = flat[start : start + size]
        self.last = np.zeros(self.first[-1], bool)  # the last half of each text
        self.last[self.first[1:] - 1] = True

    def chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first half of each chunk, its second, the first chunk of each text): neighbouring halves, or a text's only one twice."""
        alone = self.halves == 1
        begins = ~self.last
        begins[self.first[:-1][alone]] = True
        a = np.flatnonzero(begins)
        counts = np.maximum(self.halves - 1, 1)
        return a, np.where(self.last[a], a, a + 1), np.cumsum(counts) - counts

    def full(self) -> np.ndarray:
        """Which part of each chunk is text."""
        a, b, starts = self.chunks()
        owner = np.repeat(np.arange(len(self.sizes)), np.diff(np.append(starts, len(a))))
        rest = self.sizes[owner] - (a - self.first[owner]) * HALF
        return (np.clip(rest, 0, CHUNK) / CHUNK).astype(np.float32)


class Network:
    """The parameters, and what a batch of texts makes of them."""

    NAMES = ("vectors", "filters", "bias", "hidden", "fullness", "hidden_bias", "out", "out_bias")

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.vectors = normal(256, VECTOR, scale=0.5)
        self.vectors[0] = 0
        self.filters = normal(PIECES, STEP * VECTOR, FILTERS, scale=(WIDTH * VECTOR) ** -0.5)
        self.bias = np.zeros(FILTERS, np.float32)
        self.hidden = normal(FILTERS, HIDDEN, scale=FILTERS**-0.5)
        self.fullness, self.hidden_bias = np.zeros(HIDDEN, np.float32), np.zeros(HIDDEN, np.float32)
        self.out, self.out_bias = normal(HIDDEN, scale=HIDDEN**-0.5), np.zeros(1, np.float32)

    def maxima(self, packed: Packed, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(maxima of the filters [half, filter], the windows they come from, counted over all bytes, if asked for)."""
        n, at_once = len(packed.last), SLICE // HALF
        out = np.empty((n, FILTERS), np.float32)
        where = np.empty((n, FILTERS), np.int64) if places else None
        for lo in range(0, n, at_once):
            hi = min(n, lo + at_once)
            rows = self.vectors[packed.bytes[lo * HALF : hi * HALF + WIDTH - STEP]].reshape(-1, STEP * VECTOR)
            seen = rows[: len(rows) - PIECES + 1] @ self.filters[0]
            for i in range(1, PIECES):
                seen += rows[i : len(rows) - PIECES + 1 + i] @ self.filters[i]
            seen = seen.reshape(hi - lo, WINDOWS, FILTERS)
            seen[packed.last[lo:hi], 1 - PIECES :] = -np.inf  # these begin behind the text, and look into the next
            if where is None:
                seen.max(axis=1, out=out[lo:hi])
            else:
                best = seen.argmax(axis=1)
                where[lo:hi] = best + (np.arange(lo, hi) * WINDOWS)[:, None]
                out[lo:hi] = np.take_along_axis(seen, best[:, None], axis=1)[:, 0]
        return out, where

    def margins(self, packed: Packed) -> np.ndarray:
        if not len(packed.sizes):
            return np.zeros(0)
        pooled = np.maximum(self.maxima(packed)[0] + self.bias, 0)
        a, b, starts = packed.chunks()
        units = np.maximum(np.maximum(pooled[a], pooled[b]) @ self.hidden + packed.full()[:, None] * self.fullness + self.hidden_bias, 0)
        return (np.maximum.reduceat(units, starts, axis=0) @ self.out + self.out_bias).astype(float)

    def gradients(self, packed: Packed, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over the texts."""
        raw, where = self.maxima(packed, places=True)
        pooled = np.maximum(raw + self.bias, 0)
        a, b, starts = packed.chunks()
        full, sides = packed.full(), pooled[a] >= pooled[b]
        chunk = np.where(sides, pooled[a], pooled[b])
        units = np.maximum(chunk @ self.hidden + full[:, None] * self.fullness + self.hidden_bias, 0)
        texts = np.maximum.reduceat(units, starts, axis=0)
        error = ((1 / (1 + np.exp(-(texts @ self.out + self.out_bias))) - y) / len(y)).astype(np.float32)
        found = {"out": texts.T @ error, "out_bias": error.sum(keepdims=True)}
        # To the chunk of each hidden unit's maximum, the first of equal ones.
        owner = np.repeat(np.arange(len(y)), np.diff(np.append(starts, len(a))))
        d_units = np.zeros_like(units)
        for h in range(HIDDEN):
            hit = np.flatnonzero((units[:, h] == texts[owner, h]) & (units[:, h] > 0))
            hit = hit[np.unique(owner[hit], return_index=True)[1]]
            d_units[hit, h] = error[owner[hit]] * self.out[h]
        found |= {"hidden": chunk.T @ d_units, "fullness": full @ d_units, "hidden_bias": d_units.sum(axis=0)}
        d_chunk = d_units @ self.hidden.T
        d_half = np.zeros_like(pooled)
        np.add.at(d_half, a, np.where(sides, d_chunk, 0))
        np.add.at(d_half, b, np.where(sides, 0, d_chunk))
        d_half *= pooled > 0
        found["bias"] = d_half.sum(axis=0)
        half, f = np.nonzero(d_half)
        g, spots = d_half[half, f], where[half, f][:, None] * STEP + np.arange(WIDTH)
        tokens = packed.bytes[spots]
        by_filter = np.zeros((len(g), FILTERS), np.float32)
        by_filter[np.arange(len(g)), f] = g
        found["filters"] = (self.vectors[tokens].reshape(len(g), -1).T @ by_filter).reshape(self.filters.shape)
        d_vectors = (by_filter @ self.filters.reshape(-1, FILTERS).T).reshape(-1, VECTOR)
        found["vectors"] = np.stack([np.bincount(tokens.ravel(), d_vectors[:, i], minlength=256) for i in range(VECTOR)], axis=1).astype(np.float32)
        found["vectors"][0] = 0  # nothing stands for the bytes behind a text
        return found

    def learn(self, texts: pa.Array, y: np.ndarray, epochs: int = 8, together: int = 32, rate: float = 0.004, decay: float = 1e-4, seed: int = 0) -> None:
        rng, step = np.random.default_rng(seed), 0
        mean, square = ({n: np.zeros_like(getattr(self, n)) for n in self.NAMES} for _ in range(2))
        total = epochs * -(-len(y) // together)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), together):
                own, step = np.sort(order[at : at + together]), step + 1
                for name, g in self.gradients(Packed(texts.take(pa.array(own))), y[own]).items():
                    mean[name] += 0.1 * (g - mean[name])
                    square[name] += 0.001 * (g * g - square[name])
                    change = (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.999**step)) + 1e-8)
                    x = getattr(self, name)
                    x -= np.float32(rate * (1 - step / (total + 1))) * (change + decay * x).astype(np.float32)


class Model:
    """A network, or a share where there was nothing to learn from. ``shift`` brings margins from the sample's balance to that of all labels."""

    def __init__(self, network: Network | None, share: float, shift: float = 0.0):
        self.network, self.share, self.shift = network, share, shift

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.share)
        out = []
        for lo, hi in _portions(texts):
            out.append(self.network.margins(Packed(texts.slice(lo, hi - lo))))
        return 1 / (1 + np.exp(-np.clip(np.concatenate(out) + self.shift, -500, 500))) if out else np.zeros(0)


def _portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of some SLICE bytes, at least one row each."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 16 * SLICE, "right")))
        yield lo, min(hi, len(texts))
        lo = hi


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS, most_bytes: int = BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 0) -> Model:
    """A model from the texts of ``docs`` and the labels of at most ``rows`` ids of each class."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(F.col(label_col).cast("int")) > 0).cast("int").alias("y"))
    known = written(known, "labels")
    counts = dict(known.groupBy("y").count().collect())
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    if len(counts) < 2:
        return Model(None, share)
    order = [F.xxhash64("id", F.lit("sample")), F.col("id")]
    some = known.filter("y = 0").orderBy(*order).limit(rows).unionByName(known.filter("y = 1").orderBy(*order).limit(rows))
    found = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(written(some, "some")), "id")  # 2 * rows rows
    sample = written(found.groupBy("id", "y").agg(F.min("text").alias("text")), "sample")
    sizes = sample.select("id", "y", F.octet_length("text").cast("long").alias("size"), order[0].alias("h")).toPandas().sort_values(["h", "id"])
    taken, left = [], {0: most_bytes // 2, 1: most_bytes // 2}
    for r in sizes.itertuples():
        if r.size <= left[r.y]:
            left[r.y] -= r.size
            taken.append(r.id)
    chosen = docs.sparkSession.createDataFrame([(i, n) for n, i in enumerate(taken)], f"id {dict(sample.dtypes)['id']}, nth int")
    kept = sample.join(F.broadcast(chosen), "id").select("nth", "y", "text").toArrow().sort_by("nth")
    texts, y = kept["text"].combine_chunks(), kept["y"].to_numpy().astype(np.float32)
    if not 0 < y.sum() < len(y):
        return Model(None, share)
    network = Network(seed)
    network.learn(texts, y, seed=seed)
    own = float(y.mean())
    return Model(network, share, float(np.log(share / (1 - share)) - np.log(own / (1 - own))))


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1."""
    shared, place, name = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col), free_name(docs, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(batch.column(place)), pa.float64())], [*batch.schema.names, name])
        release()

    return bounded(docs).mapInArrow(run, _with(docs, f"`{name}` double"))
