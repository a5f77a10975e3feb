"""Batched forward-backward kernels (numpy) over many samples at once.

Arrays are [sample, grid, state...]; founders' allele probabilities are p[k, site]. A step between grids keeps a
haplotype's founder with probability s, else draws it from a[k]. All passes are scaled, and emissions are floored as the
model asks, so nothing underflows. States are in memory for a block of grids at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

import numpy as np

#: The greatest ratio between a read's likelihoods, if a model doesn't say otherwise, and between a grid's emissions.
READ_RATIO, GRID_RATIO = 1000.0, 1e10


@dataclass
class Reads:
    """Reads of a batch: per read its sample (number in the batch) and grid; per observation its read, site and score."""

    n: int
    sample: np.ndarray
    grid: np.ndarray
    read: np.ndarray
    site: np.ndarray
    bq: np.ndarray

    @property
    def probs(self) -> tuple[np.ndarray, np.ndarray]:
        e = 10.0 ** (-np.abs(self.bq) / 10)
        return np.where(self.bq < 0, 1 - e, e / 3), np.where(self.bq > 0, 1 - e, e / 3)


@dataclass
class Model:
    p: np.ndarray  # [k, site]
    switch: np.ndarray  # [k, step]
    stay: np.ndarray  # [step]
    prior: np.ndarray  # [k]
    read_ratio: float = READ_RATIO  # the greatest between a read's likelihoods

    @property
    def k(self) -> int:
        return len(self.p)


@dataclass
class Sums:
    """Additive expected counts of an E-step."""

    alt: np.ndarray
    total: np.ndarray
    switch: np.ndarray
    prior: np.ndarray
    usage: np.ndarray  # [k, grid]: how many samples are of each founder

    @classmethod
    def zero(cls, m: Model, alleles: bool = True) -> Sums:
        """Without ``alleles``, none are counted."""
        p = m.p if alleles else m.p[:, :0]
        return cls(np.zeros_like(p), np.zeros_like(p), np.zeros_like(m.switch), np.zeros(m.k), np.zeros((m.k, len(m.stay) + 1)))


def read_likelihoods(r: Reads, m: Model) -> np.ndarray:
    """[read, k], scaled to a greatest of 1 and floored."""
    pr, pa = r.probs
    logs = np.log(m.p[:, r.site] * pa + (1 - m.p[:, r.site]) * pr)
    out = np.zeros((len(r.sample), m.k))
    for k in range(m.k):
        out[:, k] = np.bincount(r.read, logs[k], minlength=len(r.sample))
    return np.maximum(np.exp(out - out.max(axis=1, keepdims=True)), 1 / m.read_ratio)


class Grids:
    """The reads of a batch by grid, so that a pass may look at a few grids at a time."""

    def __init__(self, r: Reads):
        self.r, self.order = r, np.lexsort((r.sample, r.grid))
        self.sorted = r.grid[self.order]

    def rows(self, lo: int, hi: int) -> np.ndarray:
        """The reads of the grids lo..hi-1, by grid and sample."""
        a, b = np.searchsorted(self.sorted, [lo, hi])
        return self.order[a:b]

    def emissions(self, logs: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """[sample, grid, ...] of the grids lo..hi-1 from logs [read, ...], scaled and floored."""
        rows = self.rows(lo, hi)
        out = np.zeros((self.r.n, hi - lo, *logs.shape[1:]))
        if len(rows):
            key = (self.r.grid[rows] - lo) * self.r.n + self.r.sample[rows]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            out[key[first] % self.r.n, key[first] // self.r.n] = np.add.reduceat(logs[rows], first, axis=0)
        flat = out.reshape(self.r.n, hi - lo, -1)
        flat -= flat.max(axis=2, keepdims=True)
        np.exp(flat, out=flat)
        return np.maximum(out, 1 / GRID_RATIO, out=out)


def _ahead(x: np.ndarray, m: Model, g: int) -> np.ndarray:
    """Where scaled states [sample, k] or [sample, k, k] at grid g are at grid g + 1, before its emissions."""
    s, w = m.stay[g], m.switch[:, g]
    if x.ndim == 2:
        return s * x + (1 - s) * w
    one = s * (1 - s) * (w[:, None] * x.sum(axis=1)[:, None, :] + w[None, :] * x.sum(axis=2)[:, :, None])
    return s * s * x + one + (1 - s) ** 2 * np.outer(w, w)


def _back(eb: np.ndarray, m: Model, g: int) -> np.ndarray:
    """Backward states at grid g: ``eb`` is emission times backward state at g + 1."""
    s, w = m.stay[g], m.switch[:, g]
    if eb.ndim == 2:
        return s * eb + (1 - s) * (eb @ w)[:, None]
    left = (w[:, None] * eb).sum(axis=1)  # the first haplotype switches
    moved = s * (1 - s) * (left[:, None, :] + (w[None, :] * eb).sum(axis=2)[:, :, None])
    return s * s * eb + moved + ((1 - s) ** 2 * (left @ w))[:, None, None]


def _switches(eb: np.ndarray, x: np.ndarray, m: Model, g: int) -> np.ndarray:
    """Expected switches by founder into g + 1, if ``x`` are the forward states at g."""
    s, w = m.stay[g], m.switch[:, g]
    if eb.ndim == 2:
        return ((1 - s) * w * eb).sum(axis=0)
    return 2 * (eb * (s * (1 - s) * w[:, None] * x.sum(axis=1)[:, None, :] + (1 - s) ** 2 * np.outer(w, w))).sum(axis=(0, 2))


def _over(x: np.ndarray) -> tuple[int, ...]:
    return tuple(range(1, x.ndim))


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = x.sum(axis=_over(x), keepdims=True)
    return x / c, c


#: Grids whose states are in memory together.
BLOCK = 256

Emit = Callable[[int, int], np.ndarray]


def stationary(m: Model) -> tuple[np.ndarray, np.ndarray]:
    """([grid, k], [grid]): where a haplotype is before any read is seen, and the logarithm of the chance that it hasn't switched since the first grid."""
    if "_stationary" not in m.__dict__:
        u, past = np.empty((len(m.stay) + 1, m.k)), np.zeros(len(m.stay) + 1, np.longdouble)
        u[0] = m.prior
        for g, (s, w) in enumerate(zip(m.stay.tolist(), m.switch.T)):
            u[g + 1] = s * u[g] + (1 - s) * w
        np.cumsum(np.log(np.maximum(m.stay, 1e-300).astype(np.longdouble)), out=past[1:])
        m.__dict__["_stationary"] = u, past
    return m.__dict__["_stationary"]


class Cells:
    """The reads of a batch by cell, a sample's grid that holds any; ``asked`` (samples, grids) are cells besides, with reads or without. Steps over grids without reads make one step
    of the same kind, so a pass over cells is a pass over all grids, at the cost of the reads."""

    def __init__(self, r: Reads, grids: int, asked: tuple[np.ndarray, np.ndarray] | None = None):
        key = r.sample.astype(np.int64) * grids + r.grid
        every = key if asked is None else np.concatenate([key, asked[0].astype(np.int64) * grids + asked[1]])
        distinct, of = np.unique(every, return_inverse=True)
        self.n, self.grids, self.sample, self.grid = r.n, grids, distinct // grids, distinct % grids
        self.of, self.asked = of[: len(key)], of[len(key) :]  # the cell of each read, and of each asked one
        self.start = np.searchsorted(self.sample, np.arange(r.n + 1))
        self.first = np.diff(self.sample, prepend=-1) != 0
        self.order = np.argsort(self.of, kind="stable")
        self.begins = np.flatnonzero(np.diff(self.of[self.order], prepend=-1))
        self._jumps: tuple[Model | None, tuple[np.ndarray, np.ndarray] | None] = None, None

    def emissions(self, logs: np.ndarray) -> np.ndarray:
        """[cell, ...] from logs [read, ...], scaled and floored."""
        out = np.zeros((len(self.grid), *logs.shape[1:]))
        if len(logs):
            out[self.of[self.order[self.begins]]] = np.add.reduceat(logs[self.order], self.begins, axis=0)
        out -= out.max(axis=_over(out), keepdims=True)
        np.exp(out, out=out)
        return np.maximum(out, 1 / GRID_RATIO, out=out)

    def jumps(self, m: Model) -> tuple[np.ndarray, np.ndarray]:
        """([cell], [cell, k]) of the way from a sample's cell before: the chance of no switch, and those of a switch that ends in k. Not for a sample's first cell."""
        if self._jumps[0] is not m:
            self._jumps = m, self._ways(m)
        return self._jumps[1]

    def _ways(self, m: Model) -> tuple[np.ndarray, np.ndarray]:
        u, past = stationary(m)
        to, of = self.grid, np.where(self.first, self.grid, np.roll(self.grid, 1))
        s = np.exp((past[to] - past[of]).astype(float))
        moved = np.maximum(u[to] - s[:, None] * u[of], 0)
        near = to == of + 1
        s[near] = m.stay[of[near]]
        moved[near] = (1 - s[near])[:, None] * m.switch[:, of[near]].T
        return s, moved


def _jumped(x: np.ndarray, s: np.ndarray, u: np.ndarray) -> np.ndarray:
    """As ``_ahead``, each sample's step its own."""
    if x.ndim == 2:
        return s[:, None] * x + u
    one = u[:, :, None] * x.sum(axis=1)[:, None, :] + u[:, None, :] * x.sum(axis=2)[:, :, None]
    return (s * s)[:, None, None] * x + s[:, None, None] * one + u[:, :, None] * u[:, None, :]


def _jumped_back(eb: np.ndarray, s: np.ndarray, u: np.ndarray) -> np.ndarray:
    """As ``_back``, each sample's step its own."""
    if eb.ndim == 2:
        return s[:, None] * eb + (eb * u).sum(axis=1)[:, None]
    left = (u[:, :, None] * eb).sum(axis=1)
    moved = left[:, None, :] + (u[:, None, :] * eb).sum(axis=2)[:, :, None]
    return (s * s)[:, None, None] * eb + s[:, None, None] * moved + (left * u).sum(axis=1)[:, None, None]


@dataclass
class Met:
    """Of each cell: the states that meet its emissions, the scaled forward states, the backward states, and these times the emissions."""

    x: np.ndarray
    a: np.ndarray
    b: np.ndarray
    eb: np.ndarray

    @property
    def gamma(self) -> np.ndarray:
        return _scaled(self.a * self.b)[0]


def over_cells(c: Cells, e: np.ndarray, m: Model) -> Met:
    """Both passes over the cells of a batch, all samples together, with emissions [cell, k] or [cell, k, k]."""
    u, _ = stationary(m)
    s, moved = c.jumps(m)
    counts = np.diff(c.start)
    order = np.argsort(-counts, kind="stable")
    begins, many = c.start[:-1][order], np.sort(counts)
    out, scales = Met(*(np.empty_like(e) for _ in range(4))), np.empty((len(e), *(1,) * (e.ndim - 1)))
    most = int(counts.max()) if len(counts) else 0
    active = [begins[: len(many) - int(np.searchsorted(many, t, "right"))] for t in range(most)]  # of samples with more than t cells
    for t in range(most):
        i = active[t] + t
        if t:
            x = _jumped(out.a[i - 1], s[i], moved[i])
        else:
            x = u[c.grid[i]] if e.ndim == 2 else u[c.grid[i]][:, :, None] * u[c.grid[i]][:, None, :]
        out.x[i] = x
        out.a[i], scales[i] = _scaled(e[i] * x)
    for t in reversed(range(most)):
        i = active[t] + t
        out.b[i] = 1.0
        if t + 1 < most:
            j = active[t + 1] + t + 1
            out.b[j - 1] = _jumped_back(out.eb[j], s[j], moved[j])
        out.eb[i] = e[i] * out.b[i] / scales[i]
    return out


def along(c: Cells, met: Met, m: Model, together: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(samples, first grids, numbers of grids, posteriors [grid, state...], run after run) of runs of grids, which hold all grids of all samples. A run begins at a cell, or at a sample's first
    grid, and ends before the next cell: the states in it follow from those at its ends, so all its grids are done at once. Some ``together`` numbers are made at a time; longer runs are cut."""
    u, past = stationary(m)
    pairs, states = met.a.ndim == 3, int(np.prod(met.a.shape[1:]))
    # Differences of logarithms are those of their coarse parts, which are exact, and of what is left.
    coarse = np.round(past.astype(float) * 2**30) / 2**30
    fine = (past - coarse).astype(float)
    sample = np.repeat(np.arange(c.n), np.diff(c.start) + 1)
    after = np.arange(len(sample)) - sample
    first, last = after == c.start[sample], after == c.start[sample + 1]
    begin, end = np.zeros(len(sample), int), np.full(len(sample), c.grids)
    begin[~first], end[~last] = c.grid[after[~first] - 1], c.grid[after[~last]]
    # What isn't there is of no weight: no switch to it has a chance of 0, and its backward states are even.
    left, right = np.zeros((*met.a.shape[1:], len(sample))), np.ones((*met.a.shape[1:], len(sample)))
    left[..., ~first], right[..., ~last] = np.moveaxis(met.a[after[~first] - 1], 0, -1), np.moveaxis(met.eb[after[~last]], 0, -1)
    from_coarse, to_coarse = np.where(first, np.inf, coarse[begin]), np.where(last, -np.inf, coarse[np.minimum(end, c.grids - 1)])
    from_fine, to_fine = fine[begin], fine[np.minimum(end, c.grids - 1)]
    u = np.ascontiguousarray(u.T)
    u_from, u_to = u[:, begin], u[:, np.minimum(end, c.grids - 1)]
    ends = (left.sum(axis=0), left.sum(axis=1)) if pairs else ()

    most = max(1, together // states)
    pieces = -(-(end - begin) // most)
    of = np.repeat(np.arange(len(sample)), pieces)
    lo = begin[of] + most * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    size = np.minimum(end[of] - lo, most)
    cuts = np.flatnonzero(np.diff((np.cumsum(size) - 1) // most, prepend=-1))
    for i, j in zip(cuts, np.append(cuts[1:], len(of))):
        n, runs = size[i:j], of[i:j]
        each = lambda x: np.repeat(x[..., runs], n, axis=-1)  # noqa: E731, B023
        g = np.arange(n.sum()) + np.repeat(lo[i:j] - (np.cumsum(n) - n), n)
        at, near = coarse.take(g, mode="clip"), fine.take(g, mode="clip")
        s, t = np.exp(at - each(from_coarse) + (near - each(from_fine))), np.exp(each(to_coarse) - at + (each(to_fine) - near))
        here = u.take(g, axis=1, mode="clip")
        v, w, f = np.maximum(here - s * each(u_from), 0), np.maximum(each(u_to) - t * here, 0), each(right)
        if pairs:
            one, other = (each(x) for x in ends)  # of the second haplotype, of the first
            x = (s * s) * each(left) + v[:, None] * (s * one + v) + (s * other)[:, None] * v
            moved, kept = (w[:, None] * f).sum(axis=0), (w * f).sum(axis=1)
            x *= (t * t) * f + t * moved + ((t * kept)[:, None] + (moved * w).sum(axis=0))
        else:
            x = (s * each(left) + v) * (t * f + (w * f).sum(axis=0))
        x = x.reshape(states, -1)
        x /= x.sum(axis=0)
        out = np.empty((x.shape[1], states))
        for state, own in enumerate(x):
            out[:, state] = own
        yield sample[runs], lo[i:j], n, out.reshape(-1, *met.a.shape[1:])


def sweep(c: Cells, met: Met, m: Model) -> Iterator[np.ndarray]:
    """Posteriors [state, sample] of one grid after the other, of all samples together; of pairs, those of k <= j with their two orders as one. States of a run follow from those at its ends, as in
    ``along``; here all samples make one step at a time, and of a run only its own numbers change where it begins."""
    u, past = stationary(m)
    past, pairs, n, cells = past.astype(float), met.a.ndim == 3, c.n, np.arange(len(c.grid))
    some = np.diff(c.start) > 0
    # Runs: those from the first grid on, one a sample, and then those that begin at cells.
    right = np.concatenate([np.where(some, c.start[:-1], -1), np.where(np.append(c.first[1:], True)[: len(cells)], -1, cells + 1)])
    begin, bound = np.concatenate([np.zeros(n, int), c.grid]), right >= 0
    end = np.zeros(len(right), int)
    end[bound] = c.grid[right[bound]]
    to, u_to = np.where(bound, past[end], -np.inf), u[end]
    f = np.ones((len(right), *met.a.shape[1:]))  # what the states at its end are worth: nothing decides between them where there is none
    f[bound] = met.eb[right[bound]]
    d, t = np.zeros((len(right), m.k)), np.exp(to - past[begin])
    d[n:] = (met.a.sum(axis=2) if pairs else met.a) - u[c.grid]
    if pairs:
        outer = lambda x, y: x[:, :, None] * y[:, None, :]
        e = np.zeros_like(f)
        e[n:] = met.a - outer(u[c.grid], u[c.grid]) - outer(d[n:], u[c.grid]) - outer(u[c.grid], d[n:])
        there = outer(u_to, u_to) + t[:, None, None] * (outer(d, u_to) + outer(u_to, d)) + (t * t)[:, None, None] * e
        f /= (there * f).sum(axis=(1, 2))[:, None, None]
        worth = (f @ u_to[:, :, None])[:, :, 0]
        one, two = np.triu_indices(m.k)
        times = np.where(one == two, 1.0, 2.0)[:, None]
        either, row = (one[:, None] == np.arange(m.k)).astype(float) + (two[:, None] == np.arange(m.k)), np.arange(len(one))
        parts = [x.T for x in (d, e[:, one, two], f[:, one, two], worth, u_to)]
    else:
        f /= ((u_to + t[:, None] * d) * f).sum(axis=1)[:, None]
        parts = [x.T for x in (d, f, (f * u_to).sum(axis=1)[:, None])]
    held, ends, s = [np.ascontiguousarray(x[:, :n]) for x in parts], to[:n].copy(), np.ones(n)
    order = np.argsort(c.grid, kind="stable")
    cuts = np.searchsorted(c.grid[order], np.arange(c.grids + 1))
    for g in range(c.grids):
        if cuts[g] < cuts[g + 1]:
            new = order[cuts[g] : cuts[g + 1]]
            who = c.sample[new]
            for x, y in zip(held, parts):
                x[:, who] = y[:, n + new]
            ends[who], s[who] = to[n + new], 1.0
        t, here = np.exp(ends - past[g]), u[g]
        if pairs:
            d, e, f, worth, u_to = held
            moves, seen = np.zeros((len(one), m.k)), np.zeros((m.k, len(one)))
            np.add.at(moves, (row, one), here[two])
            np.add.at(moves, (row, two), here[one])
            seen[one, row] = here[two]
            seen[two, row] = here[one]
            x = e * s
            x += moves @ d
            x *= s
            x += (here[one] * here[two])[:, None]
            moved = worth - t * (seen @ f)
            b = f * t
            b += either @ moved
            b *= t
            b += ((u_to - here[:, None] * t) * moved).sum(axis=0)
            x *= b
            x *= times
        else:
            d, f, worth = held
            x = d * s
            x += here[:, None]
            b = f * t
            b += worth[0] - t * (here @ f)
            x *= b
        yield x
        if g + 1 < c.grids:
            s *= m.stay[g]


class Runs:
    """Sums over samples of what is at the grids between their cells, without a visit to each: usage and switches there are terms that are constant along a run, or decay from its left
    or right end as the chance of no switch does. Runs add to the terms at their ends; ``into`` sweeps along the grids once.

    With u where a haplotype is before any read, a run's forward states differ from u by D at its left end (of pairs: by D of each haplotype and E of both), and its right end
    is worth F: p is F seen from u (of pairs: from u of the other haplotype), and h from D."""

    def __init__(self, m: Model):
        k, grids = m.k, len(m.stay) + 1
        zero = lambda *shape: np.zeros(shape, np.longdouble)
        self.even, self.both = zero(grids + 1), zero(grids + 1, k, k)  # differences
        # ``inside`` and ``begun`` are what ``right`` and ``left`` hold of the cells at the ends themselves.
        self.right, self.inside, self.left, self.begun, self.ended, self.here = (zero(grids, k) for _ in range(6))

    @staticmethod
    def _put(into: np.ndarray, at: np.ndarray, x: np.ndarray) -> None:
        if len(at):
            order = np.argsort(at, kind="stable")
            begins = np.flatnonzero(np.diff(at[order], prepend=-1))
            into[at[order][begins]] += np.add.reduceat(x[order].astype(np.longdouble), begins, axis=0)

    def add(self, c: Cells, met: Met, m: Model) -> None:
        u, _ = stationary(m)
        pairs = met.a.ndim == 3
        self._put(self.here, c.grid, met.gamma.sum(axis=2) if pairs else met.gamma)
        self.even[0] += int((np.diff(c.start) == 0).sum())  # samples without reads
        s, before = np.where(c.first, 0.0, c.jumps(m)[0]), np.arange(len(c.grid)) - 1
        g1, g2 = np.where(c.first, -1, c.grid[before]), c.grid
        u1, u2, f = u[c.grid[before]], u[g2], met.eb
        own = met.a.sum(axis=2) if pairs else met.a
        d = np.where(c.first[:, None], 0.0, own[before] - u1)
        if pairs:
            outer = lambda x, y: x[:, :, None] * y[:, None, :]
            e = np.where(c.first[:, None, None], 0.0, met.a[before] - outer(u1, u1) - outer(d, u1) - outer(u1, d))
            p, h = (f @ u2[:, :, None])[:, :, 0], (f @ d[:, :, None])[:, :, 0]
            m2 = s[:, None, None] * (e @ f.transpose(0, 2, 1))
        else:
            p, h, m2 = f, np.zeros_like(f), np.zeros((len(f), m.k, m.k))
        even = (u2 * (p + s[:, None] * h)).sum(axis=1)
        r = p + s[:, None] * h
        self._put(self.ended, g2, r)
        w = g2 > g1 + 1
        left = d * (u2 * p).sum(axis=1)[:, None] + (m2 @ u2[:, :, None])[:, :, 0]
        both = s[:, None, None] * (d[:, :, None] * p[:, None, :] + m2)
        for into, x, end in ((self.even, even, -even), (self.both, both, -both)):
            self._put(into, g1[w] + 1, x[w])
            self._put(into, g2[w], end[w])
        self._put(self.right, g2[w], r[w])
        v = w & ~c.first
        self._put(self.right, g1[v], -s[v][:, None] * r[v])
        self._put(self.left, g1[v], left[v])
        self._put(self.left, g2[v], -s[v][:, None] * left[v])
        self._put(self.inside, g2[w], r[w])
        self._put(self.begun, g1[v], left[v])
        last = c.start[1:][np.diff(c.start) > 0] - 1
        tail = own[last] - u[c.grid[last]]
        self._put(self.even, c.grid[last] + 1, np.ones(len(last)))
        self._put(self.left, c.grid[last], tail)
        self._put(self.begun, c.grid[last], tail)

    def into(self, sums: Sums, m: Model, part: float = 1.0, haplotypes: int = 1) -> None:
        """Adds usage (times ``part``), switches (times ``haplotypes``) and the first grid's founders to ``sums``."""
        u, _ = stationary(m)
        right, left = self.right.copy(), self.left.copy()
        stay = m.stay.astype(np.longdouble)
        for g in range(len(stay)):
            left[g + 1] += stay[g] * left[g]
        for g in reversed(range(len(stay))):
            right[g] += stay[g] * right[g + 1]
        right -= self.inside
        left -= self.begun
        even, both = np.cumsum(self.even)[:-1], np.cumsum(self.both, axis=0)[:-1]
        seen = even[:, None] + right - (u * right).sum(axis=1)[:, None]
        usage = self.here + u * seen + left + np.einsum("gkk->gk", both) - np.einsum("gki,gi->gk", both, u)
        usage = part * np.maximum(usage, 0).astype(float)
        sums.usage += usage.T
        sums.prior += usage[0]
        sums.switch += haplotypes * ((1 - m.stay)[:, None] * m.switch.T * np.maximum(seen + self.ended, 0).astype(float)[1:]).T


def _start(m: Model, pairs: bool) -> np.ndarray:
    return np.outer(m.prior, m.prior) if pairs else m.prior


def _forward(emit: Emit, m: Model, first: np.ndarray, grids: int, block: int) -> list[np.ndarray | None]:
    """The forward states before each block of grids (none before the first); ``first`` is what the first grid's emissions meet."""
    saved: list[np.ndarray | None] = [None]
    a: np.ndarray | None = None
    for lo in range(0, grids - block, block):
        e = emit(lo, lo + block)
        for g in range(lo, lo + block):
            a, _ = _scaled(e[:, g - lo] * (first if a is None else _ahead(a, m, g - 1)))
        saved.append(a)
    return saved


def _again(e: np.ndarray, before: np.ndarray | None, m: Model, first: np.ndarray, lo: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Forward states of a block with emissions ``e`` that begins at grid lo, and their scales."""
    a, scales = np.empty_like(e), []
    for g in range(e.shape[1]):
        before, c = _scaled(e[:, g] * (first if before is None else _ahead(before, m, lo + g - 1)))
        a[:, g] = before
        scales.append(c)
    return a, scales


def walk(emit: Emit, m: Model, pairs: bool, switches: np.ndarray, block: int = BLOCK, start: np.ndarray | None = None, end: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(lo, posteriors [sample, grid, state...]) of blocks of grids from lo on, from right to left. The forward states before each block are kept, those inside are made again on the way
    back. Adds expected switches to ``switches`` [k, step]. ``start`` and ``end`` [sample, state...] replace the prior and the even backward states where the grids are a part of a
    chromosome."""
    grids = len(m.stay) + 1
    first = _start(m, pairs) if start is None else start
    saved, eb = _forward(emit, m, first, grids, block), None
    for number in reversed(range(len(saved))):
        lo = number * block
        e = emit(lo, min(grids, lo + block))
        a, scales = _again(e, saved[number], m, first, lo)
        for g in reversed(range(e.shape[1])):
            if eb is None:
                b: np.ndarray | float = 1.0 if end is None else end
            else:
                switches[:, lo + g] += _switches(eb, a[:, g], m, lo + g)
                b = _back(eb, m, lo + g)
            eb = e[:, g] * b / scales[g]
            a[:, g], _ = _scaled(a[:, g] * b)
        yield lo, a


def passes(emit: Emit, m: Model, pairs: bool, visit: Callable[[int, np.ndarray], None], block: int = BLOCK, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
    """The expected switches [k, step] of ``walk``, whose blocks ``visit(lo, gamma)`` sees."""
    switches = np.zeros_like(m.switch)
    for lo, gamma in walk(emit, m, pairs, switches, block, start, end):
        visit(lo, gamma)
    return switches


def borders(emit: Emit, m: Model, pairs: bool, n: int, begins: list[int], block: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray]]:
    """(0, i, what meets the emissions of the first grid of part i) from left to right, then (1, i, backward states of its last grid) from right to left, both [sample, state...],
    of the parts that begin at the grids ``begins``. With these as ``start`` and ``end``, ``passes`` over a part alone gives what it gives over all. No more is in memory than a
    block of emissions."""
    grids, number = len(m.stay) + 1, {g: i for i, g in enumerate(begins)}
    x = np.broadcast_to(_start(m, pairs), (n, *_start(m, pairs).shape))
    for lo in range(0, grids, block):
        e = emit(lo, min(grids, lo + block))
        for g in range(lo, lo + e.shape[1]):
            if g in number:
                yield 0, number[g], x
            a, _ = _scaled(e[:, g - lo] * x)
            x = _ahead(a, m, g) if g + 1 < grids else a
    b = np.ones_like(x)
    for lo in reversed(range(0, grids, block)):
        e = emit(lo, min(grids, lo + block))
        for g in reversed(range(lo, lo + e.shape[1])):
            if g + 1 == grids or g + 1 in number:
                yield 1, number[g + 1] - 1 if g + 1 < grids else len(begins) - 1, b
            if g:
                b, _ = _scaled(_back(e[:, g - lo] * b, m, g - 1))


def _whole(e: np.ndarray, m: Model, pairs: bool) -> tuple[np.ndarray, np.ndarray]:
    gamma = np.empty_like(e)

    def keep(lo: int, own: np.ndarray) -> None:
        gamma[:, lo : lo + own.shape[1]] = own

    return gamma, passes(lambda lo, hi: e[:, lo:hi], m, pairs, keep)


def haploid(e: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """(gamma [sample, grid, k], expected switches [k, step]) for emissions [sample, grid, k]."""
    return _whole(e, m, False)


def diploid(e: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """(gamma [sample, grid, k, k], expected switches [k, step], both haplotypes) for emissions [sample, grid, k, k]."""
    return _whole(e, m, True)


def _count(sums: Sums, r: Reads, m: Model, weight: np.ndarray) -> None:
    """Adds expected alleles: ``weight`` [read, k] is how much of a read is of each founder."""
    if not sums.alt.size:
        return
    pr, pa = r.probs
    for k in range(m.k):
        p, w = m.p[k, r.site], weight[r.read, k]
        np.add.at(sums.alt[k], r.site, w * p * pa / (p * pa + (1 - p) * pr))
        np.add.at(sums.total[k], r.site, w)


class _Pass:
    """What a pass over a batch gathers, block by block: a weight for each read, counts, and dosages or genotypes of the sites."""

    def __init__(self, r: Reads, m: Model, grid_of: np.ndarray):
        self.r, self.m, self.grid_of, self.grids = r, m, grid_of, Grids(r)

    def at(self, lo: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(reads of the block, their samples' posteriors at their grids)."""
        rows = self.grids.rows(lo, lo + own.shape[1])
        return rows, own[self.r.sample[rows], self.r.grid[rows] - lo]

    def sites(self, lo: int, own: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(grid in the block, first site, end of sites) of the block's grids that have sites."""
        ends = np.searchsorted(self.grid_of, np.arange(lo, lo + own.shape[1] + 1))
        return ((g, int(a), int(b)) for g, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if a < b)

    def run(self, logs: np.ndarray, pairs: bool, visit: Callable[[int, np.ndarray], None]) -> np.ndarray:
        return passes(lambda lo, hi: self.grids.emissions(logs, lo, hi), self.m, pairs, visit)


def _pair_genotypes(gamma: np.ndarray, p: np.ndarray) -> np.ndarray:
    """[sample, site, 3] of posteriors of pairs [sample, k, k] and the sites' alleles [k, site]."""
    own = gamma.reshape(len(gamma), -1)
    both, none = (own @ (x[:, None] * x[None]).reshape(own.shape[1], -1) for x in (p, 1 - p))
    return np.stack([none, 1 - both - none, both], axis=2)


def run_diploid(r: Reads, m: Model, grid_of: np.ndarray, sums: Sums | None = None, runs: Runs | None = None) -> np.ndarray | None:
    """Genotype posteriors [sample, site, 3]; with ``sums``, adds to these instead. What concerns grids without reads is added to ``runs``, if given, for later, else to ``sums``."""
    e = read_likelihoods(r, m)
    pair = e[:, :, None] + e[:, None, :]
    if sums is not None:
        with _gathered(runs, sums, m, "diploid") as found:
            held = _over_reads(r, m, np.log(pair / 2), found)
            _count(sums, r, m, 2 * (held * e[:, :, None] / pair).sum(axis=2))
        return None
    own = _Pass(r, m, grid_of)
    out = np.empty((r.n, len(grid_of), 3))

    def visit(lo: int, gamma: np.ndarray) -> None:
        for g, a, b in own.sites(lo, gamma):
            out[:, a:b] = _pair_genotypes(gamma[:, g], m.p[:, a:b])

    own.run(np.log(pair / 2), True, visit)
    return np.clip(out, 0, 1, out=out)


#: Of each method: how a pass counts for usage, and how many haplotypes switch in it.
COUNTS = {"diploid": (1.0, 2), "diploid-inbred": (1.0, 1), "pseudoHaploid": (0.5, 1)}


@contextmanager
def _gathered(runs: Runs | None, sums: Sums, m: Model, method: str) -> Iterator[Runs]:
    """``runs``, or new ones that go into ``sums`` at the end."""
    found = Runs(m) if runs is None else runs
    yield found
    if runs is None:
        found.into(sums, m, *COUNTS[method])


def _over_reads(r: Reads, m: Model, logs: np.ndarray, runs: Runs | None = None, cells: Cells | None = None) -> np.ndarray:
    """[read, state...]: the posteriors of each read's sample at its grid, from the reads' ``logs``. Adds to ``runs``, if given. ``cells`` are those of the reads, if they are at hand."""
    c = Cells(r, len(m.stay) + 1) if cells is None else cells
    met = over_cells(c, c.emissions(logs), m)
    if runs is not None:
        runs.add(c, met, m)
    return met.gamma[c.of]


def _doses(own: _Pass, logs: np.ndarray) -> np.ndarray:
    """Dosages [sample, site] of a haploid pass."""
    doses = np.empty((own.r.n, len(own.grid_of)))

    def visit(lo: int, gamma: np.ndarray) -> None:
        for g, a, b in own.sites(lo, gamma):
            doses[:, a:b] = gamma[:, g] @ own.m.p[:, a:b]

    own.run(logs, False, visit)
    return doses


def run_inbred(r: Reads, m: Model, grid_of: np.ndarray, sums: Sums | None = None, runs: Runs | None = None) -> np.ndarray | None:
    """As ``run_diploid``, of samples with two equal haplotypes: one haploid pass, no heterozygotes."""
    logs = np.log(read_likelihoods(r, m))
    if sums is not None:
        with _gathered(runs, sums, m, "diploid-inbred") as found:
            _count(sums, r, m, _over_reads(r, m, logs, found))
        return None
    d = _doses(_Pass(r, m, grid_of), logs)
    return np.stack([1 - d, np.zeros_like(d), d], axis=2)


def _first_shares(r: Reads, h: int, seed: int) -> np.ndarray:
    """A draw (0.2 to 0.8) for each read, from its number in its sample: whichever samples are in a batch, it is the same."""
    order = np.argsort(r.sample, kind="stable")
    begins = np.searchsorted(r.sample[order], np.arange(r.n))
    number = np.empty(len(order), np.uint64)
    number[order] = np.arange(len(order)) - begins[r.sample[order]]
    x = number * np.uint64(2) + np.uint64(h) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):  # the mixing of splitmix64
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return 0.2 + 0.6 * (x >> np.uint64(11)).astype(float) / (1 << 53)


def mixed_likelihoods(e: np.ndarray, p: list[np.ndarray], ratio: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(shares, likelihoods [read, k]) of reads in the passes of both haplotypes: a read whose probability under them is p[0] and p[1] is of the first with the share p[0] / (p[0] + p[1]), and else
    says p of the other haplotype whatever the founder; floored at a ``ratio``-th of the greatest."""
    first = p[0] / (p[0] + p[1])
    shares = [first, 1 - first]
    mixed = [x[:, None] * e + (1 - x)[:, None] * other[:, None] for x, other in zip(shares, p[::-1])]
    return shares, [np.maximum(x, x.max(axis=1, keepdims=True) / ratio) for x in mixed]


def _refined(r: Reads, m: Model, e: np.ndarray, rounds: int, seed: int, sums: Sums | None = None, runs: Runs | None = None) -> list[np.ndarray]:
    """The likelihoods [read, k] of reads in the last round's two haploid passes. Adds to ``sums`` and ``runs``, if given, what these find."""
    p, mixed, cells = [_first_shares(r, h, seed) for h in (0, 1)], [], Cells(r, len(m.stay) + 1)
    for last in [False] * (rounds - 1) + [True]:
        shares, mixed = mixed_likelihoods(e, p, m.read_ratio)
        if last and sums is None:
            break  # nobody asks what the last passes find
        new = []
        for x, own_mixed in zip(shares, mixed):
            held = _over_reads(r, m, np.log(own_mixed), runs if last else None, cells)
            new.append(np.clip((held * e).sum(axis=1), 1e-3, 1 - 1e-3))
            if last and sums is not None:
                _count(sums, r, m, held * x[:, None] * e / own_mixed)
        p = new
    return [x / x.max(axis=1, keepdims=True) for x in mixed]


def run_pseudo_haploid(r: Reads, m: Model, grid_of: np.ndarray, sums: Sums | None = None, runs: Runs | None = None, rounds: int = 3, seed: int = 0) -> np.ndarray | None:
    """As ``run_diploid``, by two haploid passes, each of which sees a read in part as the other haplotype's (``mixed_likelihoods``).

    A read's probabilities under both haplotypes start from draws (0.2 to 0.8), and become what the posteriors of both passes make them, ``rounds`` times; cost is linear in the founders.
    """
    e = read_likelihoods(r, m)
    if sums is not None:
        with _gathered(runs, sums, m, "pseudoHaploid") as found:
            _refined(r, m, e, rounds, seed, sums, found)
        return None
    return _of_haplotypes(*(_doses(_Pass(r, m, grid_of), np.log(x)) for x in _refined(r, m, e, rounds, seed)))


def _of_haplotypes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([(1 - a) * (1 - b), a * (1 - b) + b * (1 - a), a * b], axis=2)


def tracks(r: Reads, m: Model, grid_of: np.ndarray, method: str) -> list[np.ndarray]:
    """Of each pass that a method's genotypes come from, the likelihoods [read, k] of the reads."""
    e = read_likelihoods(r, m)
    return _refined(r, m, e, 3, 0) if method == "pseudoHaploid" else [e]


def track_logs(x: np.ndarray, method: str) -> np.ndarray:
    return np.log((x[:, :, None] + x[:, None, :]) / 2) if method == "diploid" else np.log(x)


def founder_shares(r: Reads, m: Model, grid_of: np.ndarray, method: str, block: int = BLOCK) -> Iterator[tuple[int, np.ndarray]]:
    """(lo, [sample, grid, k]) of blocks of grids from right to left: how many of a sample's two haplotypes are of each founder."""
    own, none = Grids(r), np.zeros_like(m.switch)

    def one(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        logs = track_logs(x, method)
        return walk(lambda lo, hi: own.emissions(logs, lo, hi), m, method == "diploid", none, block)

    for parts in zip(*(one(x) for x in tracks(r, m, grid_of, method))):
        gammas = [g.sum(axis=3) + g.sum(axis=2) if method == "diploid" else g for _, g in parts]
        yield parts[0][0], sum(gammas) * (2 if method == "diploid-inbred" else 1)


def _doses_by_grid(r: Reads, m: Model, grid_of: np.ndarray, method: str) -> Iterator[Callable[[slice, np.ndarray, np.ndarray], None]]:
    """Of one grid after the other what writes, for some of its sites, (y, z) [site, sample] into two arrays: y is het + 2 hom, z het + 4 hom of the genotype posteriors."""
    c = Cells(r, len(m.stay) + 1)
    found = [sweep(c, over_cells(c, c.emissions(track_logs(x, method)), m), m) for x in tracks(r, m, grid_of, method)]
    one, two = np.triu_indices(m.k)
    for gammas in zip(*found):

        def write(own: slice, y: np.ndarray, z: np.ndarray) -> None:
            p = m.p[:, own]
            if method == "diploid":
                either = p[one] + p[two]
                np.matmul(either.T, gammas[0], out=y)  # noqa: B023
                np.matmul((either + 2 * p[one] * p[two]).T, gammas[0], out=z)  # noqa: B023
            elif method == "pseudoHaploid":
                np.matmul(p.T, gammas[0], out=y)  # noqa: B023
                other = p.T @ gammas[1]  # noqa: B023
                np.multiply(y, other, out=z)
                z *= 2
                y += other
                z += y
            else:
                np.matmul(2 * p.T, gammas[0], out=y)  # noqa: B023
                np.multiply(y, 2, out=z)

        yield write


#: Numbers of an array of sites by samples that is worked on at once, about: what fits a core's cache.
TILE = 1 << 14


def add_genotypes(r: Reads, models: list[tuple[Model, str]], grid_of: np.ndarray, out: dict[str, np.ndarray]) -> None:
    """Adds to ``out`` [site] the sums over samples of the genotype posteriors of ``KERNELS``, averaged over ``models``: of the expected number of alternative alleles (e) and of its square (f), both in
    whole thousandths, of e times e, and of who is most likely without any (hom_ref) or with one (het). No posterior is kept longer than its grid's turn."""
    ends = np.searchsorted(grid_of, np.arange(len(models[0][0].stay) + 2))
    step = max(1, TILE // max(r.n, 1))
    held, truths = [np.empty((step, r.n)) for _ in range(5)], [np.empty((step, r.n), bool) for _ in range(2)]
    for first, end, writers in zip(ends[:-1], ends[1:], zip(*(_doses_by_grid(r, m, grid_of, method) for m, method in models))):
        for i in range(first, end, step):
            own = slice(i, min(i + step, end))
            y, z, x, y2, z2 = (x[: own.stop - i] for x in held)
            a, b = (x[: own.stop - i] for x in truths)
            writers[0](own, y, z)
            if len(writers) > 1:
                for write in writers[1:]:
                    write(own, y2, z2)
                    y += y2
                    z += z2
                y /= len(writers)
                z /= len(writers)
            np.multiply(y, 7 / 3, out=x)
            np.subtract(x, z, out=x)
            np.less_equal(x, 2 / 3, out=a)  # none is as likely as one
            a &= np.less_equal(y, 1, out=b)  # and as two
            out["hom_ref"][own] += [np.count_nonzero(own_row) for own_row in a]
            if any(method != "diploid-inbred" for _, method in models):
                np.multiply(y, 5 / 3, out=x)
                np.greater_equal(x, z, out=b)  # one is as likely as two
                np.greater(b, a, out=b)
                out["het"][own] += [np.count_nonzero(own_row) for own_row in b]
            y *= 1000
            np.rint(y, out=y)
            out["e"][own] += y.sum(axis=1)
            out["ee"][own] += np.einsum("ij,ij->i", y, y)
            z *= 1000
            np.rint(z, out=z)
            out["f"][own] += z.sum(axis=1)


def part_genotypes(r: Reads, likelihoods: list[np.ndarray], m: Model, grid_of: np.ndarray, method: str, starts: list[np.ndarray], ends: list[np.ndarray]) -> np.ndarray:
    """Genotype posteriors [sample, site, 3] of a part of a chromosome, whose own grids, sites and founders ``r``, ``grid_of`` and ``m`` are; starts and
    ends of each track are as of ``borders``."""
    own, found = _Pass(r, m, grid_of), []
    for x, start, end in zip(likelihoods, starts, ends):
        out = np.empty((r.n, len(grid_of), 3) if method == "diploid" else (r.n, len(grid_of)))

        def visit(lo: int, gamma: np.ndarray) -> None:
            for g, a, b in own.sites(lo, gamma):
                out[:, a:b] = _pair_genotypes(gamma[:, g], m.p[:, a:b]) if method == "diploid" else gamma[:, g] @ m.p[:, a:b]

        passes(lambda lo, hi: own.grids.emissions(track_logs(x, method), lo, hi), m, method == "diploid", visit, start=start, end=end)
        found.append(out)
    if method == "diploid":
        return np.clip(found[0], 0, 1)
    d = found[0]
    return _of_haplotypes(*found) if method == "pseudoHaploid" else np.stack([1 - d, np.zeros_like(d), d], axis=2)


KERNELS = {"diploid": run_diploid, "diploid-inbred": run_inbred, "pseudoHaploid": run_pseudo_haploid}


def maximise(sums: Sums, m: Model, n: int, af: np.ndarray, distance: np.ndarray, n_gen: float, min_rate: float, max_rate: float, threshold: float = 1e-4, share_threshold: float = 1e-4) -> Model:
    """The M-step. ``distance`` is in bases by step, rates in cM per Mb; ``af`` fills sites no read spoke of. ``threshold`` bounds alleles,
    ``share_threshold`` the founders' shares of switches."""
    p = np.where(sums.total > 0, sums.alt / np.where(sums.total > 0, sums.total, 1), af[None, :])
    prior = np.maximum(sums.prior / max(sums.prior.sum(), 1e-300), 1 / (100 * m.k))
    low, high = (np.exp(-n_gen * rate * distance / 1e8) for rate in (max_rate, min_rate))
    stay = np.clip(np.exp(-sums.switch.sum(axis=0) / (2 * n)), low, high)
    total = sums.switch.sum(axis=0)
    share = np.maximum(np.where(total > 0, sums.switch / np.where(total > 0, total, 1), 1 / m.k), share_threshold)
    return replace(m, p=np.clip(p, threshold, 1 - threshold), switch=share / share.sum(axis=0), stay=stay, prior=prior / prior.sum())


def refill(m: Model, plan: Iterable[tuple[int, int, int, int]], grid_of: np.ndarray) -> Model:
    """The model whose founders k hold, in the grids first..last, the alleles that donors had there: (k, first, last, donor) of ``plan``."""
    p = m.p.copy()
    for k, first, last, donor in plan:
        own = slice(*np.searchsorted(grid_of, [first, last + 1]))
        p[k, own] = m.p[donor, own]
    return replace(m, p=p)


def _drawn(weights: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """An index of each row of ``weights``, drawn in proportion."""
    past = weights.cumsum(axis=1)
    return (past < rng.random(len(past))[:, None] * past[:, -1:]).sum(axis=1).clip(0, weights.shape[1] - 1)


def drawn_blocks(emit: Emit, m: Model, n: int, paths: int = 20, seed: int = 0, block: int = BLOCK, pairs: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(lo, [path, sample, grid, haplotype]) of blocks of grids from right to left: founders of whole paths (of both haplotypes, or, without ``pairs``, of one), drawn from their joint
    posterior: the last grid's from its forward states, each other's from its own and the transition to what was drawn behind it."""
    grids, k, haps = len(m.stay) + 1, m.k, 2 if pairs else 1
    rng, behind = np.random.default_rng(seed), np.empty((paths, n, haps), np.int32)
    first = _start(m, pairs)
    saved = _forward(emit, m, first, grids, block)
    for number in reversed(range(len(saved))):
        lo = number * block
        a, _ = _again(emit(lo, min(grids, lo + block)), saved[number], m, first, lo)
        out = np.empty((paths, n, a.shape[1], haps), np.int32)
        for g in reversed(range(lo, lo + a.shape[1])):
            w = np.broadcast_to(a[:, g - lo], (paths, *a[:, g - lo].shape))
            if g + 1 < grids:
                own = [(1 - m.stay[g]) * m.switch[behind[:, :, h], g][..., None] + m.stay[g] * (np.arange(k) == behind[:, :, h][..., None]) for h in range(haps)]
                w = w * own[0][..., :, None] * own[1][..., None, :] if pairs else w * own[0]
            behind = np.stack(np.unravel_index(_drawn(w.reshape(paths * n, -1), rng).reshape(paths, n), (k,) * haps), axis=2)
            out[:, :, g - lo] = behind
        yield lo, out


def sampled_paths(emit: Emit, m: Model, n: int, paths: int = 20, seed: int = 0, block: int = BLOCK, pairs: bool = True) -> np.ndarray:
    """[path, sample, grid, haplotype]: all of ``drawn_blocks``."""
    return np.concatenate([x for _, x in drawn_blocks(emit, m, n, paths, seed, block, pairs)][::-1], axis=2)


def _turned_paths(r: Reads, m: Model, paths: int, seed: int, block: int) -> Iterator[tuple[int, np.ndarray]]:
    """(lo, [path, sample, grid, haplotype]) of blocks from right to left: sampled founder paths, each turned so that it agrees best with the first. Paths are drawn
    twice, with the same numbers: once to see how they agree, once to be used, so that none is in memory as a whole."""
    own, logs = Grids(r), track_logs(read_likelihoods(r, m), "diploid")
    emit = lambda lo, hi: own.emissions(logs, lo, hi)
    agree = np.zeros((paths, r.n), int)
    for _, drawn in drawn_blocks(emit, m, r.n, paths, seed, block):
        agree += (drawn == drawn[0]).sum(axis=(2, 3)) - (drawn[..., ::-1] == drawn[0]).sum(axis=(2, 3))
    for lo, drawn in drawn_blocks(emit, m, r.n, paths, seed, block):
        yield lo, np.where((agree < 0)[:, :, None, None], drawn[..., ::-1], drawn)


def sampled_phase(r: Reads, m: Model, grid_of: np.ndarray, paths: int = 20, seed: int = 0, block: int = BLOCK) -> Iterator[tuple[slice, np.ndarray]]:
    """(sites, [sample, site, 2] haplotype dosages) of blocks from right to left: means over sampled founder paths that are turned to agree."""
    for lo, drawn in _turned_paths(r, m, paths, seed, block):
        first, last = np.searchsorted(grid_of, [lo, lo + drawn.shape[2]])
        votes = np.zeros((r.n, last - first, 2))
        for pair in drawn:
            for h in (0, 1):
                votes[:, :, h] += m.p[pair[:, grid_of[first:last] - lo, h], np.arange(first, last)]
        yield slice(int(first), int(last)), votes / paths


def _uniform(key: np.ndarray, count: int) -> np.ndarray:
    """Draws in 0..1, one of each of the streams ``key`` (uint64): the ``count``-th, whichever else is drawn."""
    x = key + np.uint64((2 * count + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):  # the mixing of splitmix64
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def _streams(*numbers: np.ndarray) -> np.ndarray:
    """A stream for each tuple of whole numbers."""
    key = np.zeros(1, np.uint64)
    for x in numbers:
        key = key + np.asarray(x).astype(np.int64).view(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(0x632BE59BD9B4E019)
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        key = key ^ (key >> np.uint64(32))
    return key


@dataclass
class Paths:
    """Founders along sampled paths, as stretches of one: track ((sample * paths + path) * 2 + haplotype), first grid and founder, by track and grid. All tracks begin at grid 0."""

    grids: int
    paths: int
    track: np.ndarray
    begin: np.ndarray
    founder: np.ndarray

    def at(self, track: np.ndarray, grid: np.ndarray) -> np.ndarray:
        """The founders of tracks at grids."""
        return self.founder[np.searchsorted(self.track * self.grids + self.begin, track * self.grids + grid, "right") - 1]

    def turned(self) -> Paths:
        """With the haplotypes of each path turned so that it agrees best with its sample's first."""
        pair, first = self.track // 2, self.track // (2 * self.paths)
        of_first = pair % self.paths == 0
        # Where anything changes in a path or in the first one.
        others = np.arange(1, self.paths)
        where = np.unique(np.concatenate([(pair * self.grids + self.begin)[~of_first], ((first[of_first, None] * self.paths + others) * self.grids + self.begin[of_first, None]).ravel()]))
        own, g = where // self.grids, where % self.grids
        size = np.append(where[1:], 0) - where
        size = np.where(np.append(own[1:], -1) == own, size, self.grids - g)
        a, b, c, d = (self.at(2 * x + h, g) for x in (own, own // self.paths * self.paths) for h in (0, 1))
        agree = np.bincount(own, size * ((a == c).astype(int) + (b == d) - (b == c) - (a == d)), minlength=int(pair[-1]) + 1 if len(pair) else 0)
        track = np.where(agree[pair] < 0, self.track ^ 1, self.track)
        order = np.argsort(track, kind="stable")
        return replace(self, track=track[order], begin=self.begin[order], founder=self.founder[order])

    def counts(self, k: int) -> np.ndarray:
        """[haplotype, k, grid]: how many tracks are of each founder."""
        ends = np.where(np.append(self.track[1:], -1) == self.track, np.append(self.begin[1:], 0), self.grids)
        at, size = (self.track % 2 * k + self.founder) * (self.grids + 1), 2 * k * (self.grids + 1)
        change = np.bincount(at + self.begin, minlength=size) - np.bincount(at + ends, minlength=size)
        return change.reshape(2, k, -1).cumsum(axis=2)[:, :, :-1]


#: Rounds of proposals after which the places of last switches that are still not found are drawn from all of their chances.
PROPOSED = 24


def _last_switches(m: Model, hazard: np.ndarray, most: np.ndarray, g1: np.ndarray, g2: np.ndarray, to: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Steps in g1..g2-1 of the last switches of haplotypes that did switch there, and are of the founders ``to`` at g2. Steps are proposed by the chance of a last switch to anyone, and taken by that of ``to``."""
    out, left, bound = np.empty(len(g1), int), np.arange(len(g1)), -np.expm1(hazard[g1] - hazard[g2])
    for i in range(PROPOSED):
        x = -np.log1p(-_uniform(key[left], 2 * i) * bound[left])
        step = np.clip(np.searchsorted(hazard, hazard[g2[left]] - x) - 1, g1[left], g2[left] - 1)
        taken = _uniform(key[left], 2 * i + 1) * most[to[left]] < m.switch[to[left], step]
        out[left[taken]] = step[taken]
        left = left[~taken]
        if not len(left):
            return out
    for i, u in zip(left.tolist(), _uniform(key[left], 2 * PROPOSED).tolist()):
        own = np.arange(g1[i], g2[i])
        past = np.cumsum((1 - m.stay[own]) * m.switch[to[i], own] * np.exp(hazard[own + 1] - hazard[g2[i]]))
        out[i] = own[min(int(np.searchsorted(past, u * past[-1])), len(own) - 1)]
    return out


def drawn_paths(r: Reads, m: Model, names: np.ndarray, paths: int = 20, seed: int = 0) -> Paths:
    """Founder paths of both haplotypes, drawn from their joint posterior: at a sample's cells (and its first and last grid) from the last one on, as in ``drawn_blocks``; between two of these, what
    each haplotype switched to, from the last switch on. So the cost follows reads and switches, not grids. Draws follow from ``seed`` and a sample's name (a whole number) alone."""
    grids, k = len(m.stay) + 1, m.k
    c = Cells(r, grids, (np.repeat(np.arange(r.n), 2), np.tile([0, grids - 1], r.n)))
    a = over_cells(c, c.emissions(track_logs(read_likelihoods(r, m), "diploid")), m).a
    s, moved = c.jumps(m)
    number, each = np.arange(len(c.grid)) - c.start[c.sample], np.arange(paths)
    streams = _streams(seed, names[:, None], each)  # [sample, path]
    drawn = np.zeros((len(c.grid), paths, 2), np.int64)
    order = np.argsort(number, kind="stable")
    cuts = np.searchsorted(number[order], np.arange(number.max(initial=-1) + 2))
    last = np.append(c.first[1:], True)[: len(c.grid)]
    for t in reversed(range(len(cuts) - 1)):
        i = order[cuts[t] : cuts[t + 1]]
        j = np.minimum(i + 1, len(s) - 1)
        ways = []
        for h in (0, 1):
            behind = drawn[j, :, h]
            way = s[j, None, None] * (np.arange(k) == behind[..., None]) + np.take_along_axis(moved[j], behind, 1)[..., None]
            ways.append(np.where(last[i, None, None], 1.0, way))
        past = (a[i][:, None] * ways[0][..., :, None] * ways[1][..., None, :]).reshape(len(i), paths, -1).cumsum(axis=2)
        found = (past < _uniform(streams[c.sample[i]], t)[..., None] * past[..., -1:]).sum(axis=2).clip(0, k * k - 1)
        drawn[i, :, 0], drawn[i, :, 1] = found // k, found % k
    tracks = ((c.sample[:, None, None] * paths + each[None, :, None]) * 2 + np.arange(2)).astype(np.int64)
    held = [(tracks[c.first].ravel(), np.zeros(tracks[c.first].size, np.int64), drawn[c.first].ravel())]

    # Ways from cell to cell: [way, path, haplotype], then those with a switch alone.
    j = np.flatnonzero(~c.first)
    before, to = drawn[j - 1], drawn[j]
    key = _streams(streams[c.sample[j]].view(np.int64)[..., None], c.grid[j][:, None, None], np.arange(2))
    some = moved[j[:, None, None], to]
    switched = _uniform(key, 0) * (s[j][:, None, None] * (before == to) + some) < some
    g1, g2 = (np.broadcast_to(x[:, None, None], to.shape)[switched] for x in (c.grid[j - 1], c.grid[j]))
    track, to, key = tracks[j][switched], to[switched], _streams(key[switched].view(np.int64))
    hazard = -np.concatenate([[0.0], np.cumsum(np.log(np.maximum(m.stay, 1e-300)))])
    among = np.cumsum(m.switch, axis=0)
    at = _last_switches(m, hazard, m.switch.max(axis=1), g1, g2, to, key) if len(g1) else g1
    turn = 2 * PROPOSED + 1
    while len(at):
        held.append((track, at + 1, to))
        # The switch before: no founder at this one's left decides what it was to.
        step = np.searchsorted(hazard, hazard[at] + np.log(_uniform(key, turn))) - 1
        on = step >= g1
        track, g1, key, at = track[on], g1[on], key[on], step[on]
        past = among[:, at]
        to = (past < _uniform(key, turn + 1) * past[-1]).sum(axis=0).clip(0, k - 1)
        turn += 2
    track, begin, founder = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(track * grids + begin, kind="stable")
    return Paths(grids, paths, track[order], begin[order], founder[order])


def path_doses(drawn: Paths, m: Model, n: int, grid_of: np.ndarray, block: int = BLOCK) -> Iterator[tuple[slice, np.ndarray]]:
    """(sites, [sample, site, 2] haplotype dosages) of blocks of grids: means over the paths."""
    tracks = np.arange(n * drawn.paths * 2)
    for lo in range(0, drawn.grids, block):
        grids = np.arange(lo, min(lo + block, drawn.grids))
        first, last = np.searchsorted(grid_of, [lo, grids[-1] + 1])
        found = drawn.at(tracks[:, None], grids).reshape(n, drawn.paths, 2, -1)
        votes = np.zeros((n, last - first, 2))
        for path in range(drawn.paths):
            for h in (0, 1):
                votes[:, :, h] += m.p[found[:, path, h][:, grid_of[first:last] - lo], np.arange(first, last)]
        yield slice(int(first), int(last)), votes / drawn.paths


def marginals(r: Reads, m: Model, method: str, at: list[int]) -> np.ndarray:
    """[sample, place, k]: how much of a sample is of each founder at the grids ``at``."""
    pairs = method == "diploid"
    c = Cells(r, len(m.stay) + 1, (np.repeat(np.arange(r.n), len(at)), np.tile(np.array(at, int), r.n)))
    gamma = over_cells(c, c.emissions(track_logs(read_likelihoods(r, m), method)), m).gamma[c.asked]
    return (gamma.sum(axis=2) if pairs else gamma).reshape(r.n, len(at), m.k)


def smoothed_rates(rate: np.ndarray, at: np.ndarray, radius: float) -> np.ndarray:
    """Means of ``rate`` [step], which holds between the positions ``at`` [grid], within ``radius`` of each step's middle (and of the ends)."""
    past, middle = np.concatenate([[0], np.cumsum(rate * np.diff(at))]), (at[1:] + at[:-1]) / 2
    lo, hi = np.maximum(middle - radius, at[0]), np.minimum(middle + radius, at[-1])
    return (np.interp(hi, at, past) - np.interp(lo, at, past)) / (hi - lo)


def _valley(rate: np.ndarray, free: np.ndarray, peak: int, way: int, threshold: float) -> int:
    """The least step on the way (-1 or 1) from a peak, as far as the rate falls: a walk ends near the ends of the chromosome, before a step that isn't free, where the
    rate is above three times its least so far, or where it is below the threshold and above that of five steps before (of the peak, in the first four)."""
    least = peak
    for far in range(1, len(rate)):
        i = peak + way * far
        if rate[i] < rate[least]:
            least = i
        before = rate[i - 5 * way] if far >= 5 else rate[peak]
        if not 1 < i < len(rate) - 3 or not free[i + way] or rate[i] > 3 * rate[least] or before < rate[i] < threshold:
            break
    return least


def breaks(rate: np.ndarray, at: np.ndarray, radius: float, fewest: int = 10, most: int | None = None) -> list[tuple[int, int, int, int]]:
    """(left, focal, focal + 1, right) grids around places where founders may have swapped, from left to right. ``rate`` [step] is the smoothed recombination rate, as a
    part of the greatest there may be, ``at`` [grid] are positions.

    Peaks are taken from the highest on, each as far out as its valleys, and mask what is within twice the radius or inside: no later peak is there, no later walk goes there.
    A step beside a masked one is no peak. It ends after ``most``, or when all above the threshold (1, or the median) are masked and ``fewest`` are found.
    """
    steps, most = len(rate), max(1000, round(len(at) / 100)) if most is None else most
    if len(at) < 5:
        return []
    inner = np.arange(1, steps - 1)
    positive = rate[inner][rate[inner] != 0]
    threshold = min(1.0, float(np.median(positive))) if len(positive) else 1.0
    free, high = np.zeros(steps, bool), np.zeros(steps, bool)
    free[inner], high[inner] = True, rate[inner] > threshold
    found: list[tuple[int, int, int, int]] = []
    if free.sum() <= 3:
        return []
    for i in inner[np.argsort(-rate[inner], kind="stable")].tolist():
        if not free[i]:
            continue
        if not free[i - 1 : i + 2].all():
            free[i - 1 : i + 2] = False
        else:
            left, right = (_valley(rate, free, i, way, threshold) for way in (-1, 1))
            found.append((left, i, i + 1, right))
            middle = (at[i] + at[i + 1]) / 2
            lo = min(left, int(np.searchsorted(at, middle - 2 * radius, "right")))
            hi = max(right, min(steps - 1, int(np.searchsorted(at, middle + 2 * radius, "left")) - 2))
            free[min(lo + 1, i) : max(i, hi - 1) + 1] = False
            high[lo : hi + 1] = False
        if not free.any() or len(found) == most or not high.any() and len(found) >= fewest:
            break
    return sorted(found, key=lambda b: b[1])


def best_order(counts: np.ndarray) -> np.ndarray:
    """order[k]: the founder right of a break that continues founder k, the greatest counts [left, right] first."""
    c, order = counts.astype(float).copy(), np.full(len(counts), -1)
    for _ in range(len(c)):
        a, b = np.unravel_index(int(np.argmax(c)), c.shape)
        order[a] = b
        c[a, :], c[:, b] = -1, -1
    return order


def reorder(m: Model, at: list[tuple[int, int, int, int]], counts: np.ndarray, grid_of: np.ndarray, seed: int = 0) -> Model:
    """The model with founders reordered right of each break (left, focal, focal + 1, right) as the counts say; orders compose along the chromosome.

    Where an order isn't the identity, the alleles from left to before right are blended with draws, from none at both ends to nothing else in the middle, and who is switched to
    is even, so that the next iterations find both anew.
    """
    p, switch, total = m.p.copy(), m.switch.copy(), np.arange(m.k)
    into, orders = np.arange(1, switch.shape[1] + 1), [best_order(own) for own in counts]
    for (_, focal, _, _), order in zip(at, orders):
        total = order[total]
        sites, steps = grid_of > focal, into > focal
        p[:, sites], switch[:, steps] = m.p[total][:, sites], m.switch[total][:, steps]
    rng = np.random.default_rng(seed)
    for (left, _, _, right), order in zip(at, orders):
        if (order != np.arange(m.k)).any():
            own = slice(*np.searchsorted(grid_of, [left, right]))
            keep = np.abs(1 - np.linspace(0, 2, own.stop - own.start))
            p[:, own] = keep * p[:, own] + (1 - keep) * rng.random((m.k, own.stop - own.start))
            switch[:, left:right] = 1 / m.k
    return replace(m, p=p, switch=switch)
