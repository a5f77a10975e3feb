"""Genotypes by blocks of a chromosome.

A first pass over whole samples keeps no posteriors: it yields the states at the borders of blocks, with the likelihoods of the reads inside, as rows of (block, sample). These
meet the founders of their block alone, a group of samples at a time, and each group's posteriors are made on their own. So what a task holds follows from the size of a block, not
from a chromosome's length, and blocks of one sample are made on many machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators import hmm
from ..operators.sites import block_begins

ROW = "fit int, track int, side int, block int, sample long, state array<double>, grid array<int>, likelihood array<double>"
POSTERIOR = "sample long, snp long, g0 double, g1 double, g2 double"


def block_grids(layout: pd.DataFrame, size: int) -> list[int]:
    """The first grids of output blocks of more than ``size`` sites."""
    grids = layout.groupby("grid")["i"].agg(["min", "max"])
    begins = block_begins(grids["min"].to_numpy(), int(grids["max"].iloc[-1]), grids.index.to_numpy(), size)
    return [int(grids.index[b]) for b in begins]


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([x.size for x in rows])]).astype(np.int32)
    flat = np.concatenate([x.ravel() for x in rows]) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def border_rows(names: np.ndarray, r: hmm.Reads, m: hmm.Model, grid_of: np.ndarray, method: str, begins: list[int], fit: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch of samples: of side 0, the states that come into a block and the reads in it (grids from the block's first); of side 1, those that come back into it."""
    ends = [*begins[1:], len(m.stay) + 1]
    for track, x in enumerate(hmm.tracks(r, m, grid_of, method)):
        own, logs = hmm.Grids(r), hmm.track_logs(x, method)
        for side, block, state in hmm.borders(lambda lo, hi: own.emissions(logs, lo, hi), m, method == "diploid", r.n, begins):
            n, grids, likelihoods = r.n, [np.zeros(0, np.int32)] * r.n, [np.zeros(0)] * r.n
            if side == 0:
                rows = own.rows(begins[block], ends[block])
                rows = rows[np.argsort(r.sample[rows], kind="stable")]
                cuts = np.searchsorted(r.sample[rows], np.arange(n + 1))
                parts = [rows[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
                grids, likelihoods = [r.grid[p] - begins[block] for p in parts], [x[p] for p in parts]
            constant = lambda v: pa.array(np.full(n, v, np.int32))
            columns = [constant(fit), constant(track), constant(side), constant(block), pa.array(names), _lists(list(state), pa.float64()), _lists(grids, pa.int32()), _lists(likelihoods, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ROW.split(", ")])


def model_rows(fits: list[tuple[hmm.Model, str]], layout: pd.DataFrame, begins: list[int]) -> Iterator[tuple]:
    """(fit, block, method, k, snps, grids, p, switch, stay, read_ratio) of each block: its own part of each model."""
    grid_of, snps = layout["grid"].to_numpy(), layout["snp"].to_numpy()
    for block, (lo, hi) in enumerate(zip(begins, [*begins[1:], int(grid_of[-1]) + 1])):
        own = slice(*np.searchsorted(grid_of, [lo, hi]))
        for fit, (m, method) in enumerate(fits):
            part = [m.p[:, own], m.switch[:, lo : hi - 1], m.stay[lo : hi - 1]]
            yield (fit, block, method, m.k, snps[own].tolist(), (grid_of[own] - lo).tolist(), *(np.ascontiguousarray(x, float).tobytes() for x in part))


def _posteriors(rows: pa.Table, models: pa.Table) -> pa.Table:
    """The posteriors of a group of samples in a block, averaged over fits."""
    if not rows.num_rows:
        return pa.table({c.split()[0]: pa.array([], pa.int64() if "long" in c else pa.float64()) for c in POSTERIOR.split(", ")})
    names = np.unique(rows["sample"].to_numpy())
    side, track, fits, sample = (rows[c].to_numpy() for c in ("side", "track", "fit", "sample"))
    total, snps = None, np.array(models["snps"][0].as_py(), np.int64)
    for model in models.to_pylist():
        k, grid_of = model["k"], np.array(model["grids"])
        p, switch, stay = (np.frombuffer(model[c]) for c in ("p", "switch", "stay"))
        m = hmm.Model(p.reshape(k, -1), switch.reshape(k, len(stay)), stay, np.full(k, 1 / k))
        shape = (k, k) if model["method"] == "diploid" else (k,)
        starts, ends, likelihoods = [], [], []
        for t in np.unique(track):
            mine = [np.flatnonzero((fits == model["fit"]) & (track == t) & (side == s)) for s in (0, 1)]
            mine = [x[np.argsort(sample[x], kind="stable")] for x in mine]
            for states, x in zip((starts, ends), mine):
                states.append(np.array(rows["state"].take(pa.array(x)).to_pylist()).reshape(len(names), *shape))
            held = rows["grid"].take(pa.array(mine[0])).to_pylist()
            likelihoods.append(np.concatenate([np.array(x, float) for x in rows["likelihood"].take(pa.array(mine[0])).to_pylist()]).reshape(-1, k))
        none = np.zeros(0, int)
        r = hmm.Reads(len(names), np.repeat(np.arange(len(names)), [len(x) for x in held]), np.concatenate([np.array(x, int) for x in held]), none, none, none)
        gp = hmm.part_genotypes(r, likelihoods, m, grid_of, model["method"], starts, ends)
        total = gp if total is None else total + gp
    total /= models.num_rows
    out = {"sample": np.repeat(names, len(snps)), "snp": np.tile(snps, len(names))} | {f"g{i}": np.ascontiguousarray(total[:, :, i]).ravel() for i in range(3)}
    return pa.table(out)


def genotypes(borders: DataFrame, fits: list[tuple[hmm.Model, str]], layout: pd.DataFrame, begins: list[int], samples: int, together: int) -> DataFrame:
    """(sample, snp, g0, g1, g2) from the border rows of ``samples`` samples: groups of about ``together`` of a block meet its part of the models."""
    spark, groups = borders.sparkSession, max(1, -(-samples // together))
    kinds = "fit int, block int, method string, k int, snps array<long>, grids array<int>, p binary, switch binary, stay binary"
    models = spark.createDataFrame(list(model_rows(fits, layout, begins)), kinds).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = borders.withColumn("bucket", F.pmod(F.xxhash64("sample"), F.lit(groups)).cast("int"))
    return dealt.groupBy("block", "bucket").cogroup(models.groupBy("block", "bucket")).applyInArrow(_posteriors, POSTERIOR)
