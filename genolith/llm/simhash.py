"""SimHash fingerprints and near-duplicate links by the generalised pigeonhole principle.

Fingerprints are made in one narrow pass (Arrow batches; XXH64 of each word shingle, majority of each bit). Links are
sought between distinct fingerprints, so groups of copies cost one row:

1. Statistics over all fingerprints: the count of ones of each bit and of each pair of bits (64 x 64 numbers).
2. The bits are grouped into m partitions, correlated bits together, so that a skewed part of the fingerprint is
   skewed in few partitions.
3. Every fingerprint gets its own thresholds T_1..T_m >= -1 with sum tau - m + 1: if two fingerprints differ in tau bits
   at most, they differ in at most T_i bits of some partition i. Dynamic programming finds the thresholds with
   the least estimated cost: keys to probe plus expected candidates, for which bits count as independent with the
   frequencies found. m is the number of partitions with the least estimated total cost.
4. The fingerprint probes, in each partition, all values within T_i bits of its own. Candidates are verified by their
   whole fingerprints inside the join, so that only links leave it.

First each fingerprint is linked to the commonest one among those that share a partition value; then links are sought
only between different components, and a dense group gives about one link for each member, not all its pairs.

Near duplicates by Jaccard similarity of shingle sets (``duplicate_groups``) begin with such groups; prefixes of the sets find every
pair that is left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import TO_LOWER, broadcast_if_small, connected_components, discard, free_name, release, written

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
SEED, BITS = 42, 64
#: The largest threshold of a partition: more bits would be more keys than any corpus is worth.
MOST = 4
#: What writing, sorting and reading a key costs, in candidates that the join compares.
KEY_COST = 64
#: Rows for which bits are unpacked at once.
STEP = 65536


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of each k-word shingle of ``text``, repeats included (uint64, big-endian)."""
    data = (text or "").translate(TO_LOWER).encode()
    spans = [m.span() for m in WORDS.finditer(data)]
    if not spans:
        return np.empty(0, ">u8")
    tight = b" ".join([data[a:b] for a, b in spans])
    at, starts, ends = 0, [], []
    for a, b in spans:
        starts.append(at)
        ends.append(at + b - a)
        at += b - a + 1
    ends = ends[k - 1 :] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(tight[a:b], SEED) for a, b in zip(starts, ends)), ">u8", len(ends))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is 1 if set in over half the hashes; none: 0."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), STEP):
        ones += np.unpackbits(hashes[i : i + STEP].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, fp): fp as a signed long, row the xxhash64 of the text. Null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(shingle_hashes(t.as_py(), k)) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["id", "row", "fp"])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "id long, row long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, ones, both) over all rows of fps: both[i, j] counts the rows with bits i and j set; bit 0 is the highest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            x = _bits(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            for i in range(0, len(x), STEP):
                both += x[i : i + STEP].T @ x[i : i + STEP]
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([both.astype(np.int64).ravel().tolist()])], ["n", "both"])

    sums = fps.select("fp").mapInArrow(run, "n long, both array<long>").select("n", F.posexplode("both").alias("i", "x")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()  # 4096 rows
    both = np.zeros(BITS * BITS)
    for r in sums:
        both[r.i] = r.x
    both = both.reshape(BITS, BITS)
    return (sums[0].n if sums else 0), np.diag(both).copy(), both


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype(np.int64).astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)


def partition_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits of nearly equal size, correlated bits together: each group grows from the pair of free bits
    that correlate most by the bit that correlates most with the group."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, groups = list(range(BITS)), []
    for size in [BITS // m + (i < BITS % m) for i in range(m)]:
        sub = corr[np.ix_(free, free)]
        group = [free[int(np.argmax(sub.sum(axis=1)))]]
        free.remove(group[0])
        while len(group) < size:
            best = free[int(np.argmax(corr[np.ix_(free, group)].sum(axis=1)))]
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


class Allocation:
    """Per-fingerprint thresholds for one grouping of the bits."""

    def __init__(self, n: int, ones: np.ndarray, groups: list[list[int]], tau: int):
        self.n, self.p, self.groups, self.tau = n, ones / max(n, 1), groups, tau
        self.most = min(tau, MOST)

    def costs(self, bits: np.ndarray) -> np.ndarray:
        """[row, partition, t + 1]: keys plus expected candidates for threshold t; 0 for t = -1."""
        out = np.zeros((len(bits), len(self.groups), self.most + 2))
        for g, group in enumerate(self.groups):
            within = np.zeros((len(bits), self.most + 1))  # P(exactly t bits differ)
            within[:, 0] = 1
            for b in group:
                differ = np.where(bits[:, b] == 1, 1 - self.p[b], self.p[b])[:, None]
                moved = within[:, :-1] * differ
                within *= 1 - differ
                within[:, 1:] += moved
            keys = np.cumsum([comb(len(group), t) for t in range(self.most + 1)])
            out[:, g, 1:] = KEY_COST * keys + self.n * np.cumsum(within, axis=1)
        return out

    def thresholds(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(T, cost): the cheapest thresholds [row, partition] of sum tau - m + 1, and what they cost."""
        cost, m = self.costs(bits), len(self.groups)
        need = self.tau + 1  # with u = t + 1 >= 0 the sum of all u is tau + 1
        best = np.full((len(bits), need + 1), np.inf)
        best[:, 0] = 0
        picks = np.zeros((m, len(bits), need + 1), np.int8)
        for g in range(m):
            new = np.full_like(best, np.inf)
            for u in range(min(need, self.most + 1) + 1):
                if u - 1 > len(self.groups[g]):
                    continue
                c = best[:, : need + 1 - u] + cost[:, g, u][:, None]
                better = c < new[:, u:]
                new[:, u:][better] = c[better]
                picks[g][:, u:][better] = u
            best = new
        left, rows, t = np.full(len(bits), need), np.arange(len(bits)), np.zeros((len(bits), m), np.int8)
        for g in reversed(range(m)):
            u = picks[g][rows, left]
            t[:, g] = u - 1
            left = left - u
        return t, best[:, need]


def plan(fps: DataFrame, tau: int) -> Allocation:
    """The allocation whose number of partitions costs least, judged for every fingerprint's expected complement: the
    corpus' own bit frequencies (64 typical fingerprints drawn from them by rule)."""
    n, ones, both = bit_statistics(fps)
    typical = (np.random.default_rng(0).random((64, BITS)) < ones / max(n, 1)).astype(np.uint8)
    found = []
    for m in range(min(2, tau + 1), tau + 2):
        if m * (min(tau, MOST) + 1) < tau + 1:
            continue
        a = Allocation(n, ones, partition_bits(n, both, m), tau)
        found.append((float(a.thresholds(typical)[1].mean()) + m, m, a))
    return min(found, key=lambda x: x[:2])[2]


def _mask(group: list[int]) -> np.uint64:
    return np.uint64(sum(1 << (BITS - 1 - b) for b in group))


def probes(fps: DataFrame, a: Allocation) -> DataFrame:
    """(part, key, t) and the columns of ``fps`` for each value that a fingerprint probes; t holds all its thresholds, three
    bits (threshold + 1) a partition."""
    masks = [_mask(g) for g in a.groups]
    flips = [[np.array([int(_mask(list(c))) for c in combinations(g, t)], np.uint64) for t in range(min(a.most, len(g)) + 1)] for g in a.groups]
    ball = [[np.concatenate(f[: t + 1]) for t in range(len(f))] for f in flips]
    names = fps.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                fp = batch.column(names.index("fp")).to_numpy(zero_copy_only=False).view(np.uint64)
                t, _ = a.thresholds(_bits(fp.view(np.int64)))
                packed = (t.astype(np.int64) + 1 << 3 * np.arange(t.shape[1])).sum(axis=1)
                part, key, row = [], [], []
                for g, mask in enumerate(masks):
                    for v in np.unique(t[:, g][t[:, g] >= 0]):
                        rows = np.flatnonzero(t[:, g] == v)
                        b = ball[g][v]
                        key.append(((fp[rows] & mask)[:, None] ^ b[None, :]).ravel())
                        row.append(np.repeat(rows, len(b)))
                        part.append(np.full(len(rows) * len(b), g, np.int8))
                if row:
                    rows = np.concatenate(row)
                    taken = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(part)), pa.array(np.concatenate(key).view(np.int64)), pa.array(packed[rows]), *taken.columns], ["part", "key", "t", *names])
        release()

    return fps.mapInArrow(run, "part byte, key long, t long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fps.schema))


def values(fps: DataFrame, a: Allocation) -> DataFrame:
    """(part, key) and the columns of ``fps``: each fingerprint under its own value of every partition."""
    own = F.array(*[F.struct(F.lit(g).cast("byte").alias("part"), F.col("fp").bitwiseAND(F.lit(int(_mask(b).view(np.int64)))).alias("key")) for g, b in enumerate(a.groups)])
    return fps.select("*", F.explode(own).alias("__v")).select("__v.part", "__v.key", *fps.columns)


def _distance(x: str, y: str):
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y)))


def fingerprint_components(fps: DataFrame, tau: int) -> DataFrame:
    """(fp, rep, component): ``fps`` holds distinct fingerprints as (fp, rep, n) with rep the smallest id and n the
    number of rows; two link if they differ in at most tau bits; component is the smallest reachable rep."""
    a = plan(fps, tau)
    own = values(fps, a)
    hub = own.groupBy("part", "key").agg(F.max_by(F.struct("fp", "rep"), F.struct("n", "fp")).alias("hub")).select("part", "key", F.col("hub.fp").alias("hub_fp"), F.col("hub.rep").alias("hub_rep"))
    star = own.join(hub, ["part", "key"]).filter((F.col("rep") != F.col("hub_rep")) & (_distance("fp", "hub_fp") <= tau)).select(F.col("rep").alias("a"), F.col("hub_rep").alias("b")).distinct()
    first = connected_components(star)
    grouped = written(fps.join(first.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "rep", F.coalesce("component", "rep").alias("c")), "stars")
    x = probes(grouped.select("fp", "c"), a)
    y = values(grouped.select(F.col("fp").alias("fp2"), F.col("c").alias("c2"), F.col("fp")), a).drop("fp")
    link = x.join(y, ["part", "key"]).filter((F.col("fp") < F.col("fp2")) & (F.col("c") != F.col("c2")) & (_distance("fp", "fp2") <= tau)).select(F.greatest("c", "c2").alias("a"), F.least("c", "c2").alias("b")).distinct()
    last = connected_components(link).select(F.col("node").alias("c"), "component")
    return grouped.join(last, "c", "left").select("fp", "rep", F.coalesce("component", "c").alias("component"))


def near_duplicates(docs: DataFrame, k: int = 3, tau: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint, component_id) for each row of ``docs``.

    A-Z are lower-cased, words are what space and \\t..\\r separate, shingles are k words (fewer: the whole sequence).
    A text without words or null has fingerprint 0 and links like any other. Rows may repeat; a row without id is left
    out, as components are named by ids. Extra columns don't matter.
    """
    each = written(fingerprints(docs.filter(F.col(id_col).isNotNull()), k, id_col, text_col), "fingerprints")
    distinct = written(each.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "distinct")
    found = written(fingerprint_components(distinct, tau), "components")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return each.join(found.select("fp", "component"), "fp").select(F.col("id").alias(id_col), hexed.alias("fingerprint"), F.col("component").alias("component_id"))


#: Words of the parity bitmap of a text's shingles, and buckets in which the corpus' shingles are counted.
PARITY_WORDS, BUCKETS = 4, 1 << 17
#: How far a bound on an overlap may be off by rounding.
SLACK = 1e-6
#: Texts meet new hubs for as long as a round joins more than this share of the texts that share a shingle.
WORTHWHILE = 1 / 64
_ODD = np.array([int(x) | 1 for x in np.random.default_rng(20240102).integers(1, 1 << 63, 64)], np.uint64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): a 64-bit hash of each word of all texts, A-Z lower-cased, and where each text's words end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    coded = lists.flatten().dictionary_encode()
    own = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    real = np.fromiter(map(bool, coded.dictionary.to_pylist()), bool, len(coded.dictionary))
    at = coded.indices.to_numpy()
    keep = real[at] if len(at) else np.zeros(0, bool)
    cuts = lists.offsets.to_numpy()
    return own[at[keep]], np.concatenate([[0], np.cumsum(keep)])[cuts[1:] - cuts[0]]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def shingle_sequence(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k of a text's word hashes, of the whole sequence if there are fewer."""
    n = min(k, len(words))
    runs = np.zeros(len(words) - n + 1 if n else 0, np.uint64)
    for i in range(n):
        runs += words[i : len(words) - n + 1 + i] * _ODD[i]
    return _mixed(runs + np.uint64(n))


def _inside(starts: np.ndarray, ends: np.ndarray, k: int, n: int) -> np.ndarray:
    """Whether the run of k words that begins at each of n words (but the last k - 1) ends in the same text."""
    steps = np.zeros(n + 1, np.int64)
    fits = ends - starts >= k
    np.add.at(steps, starts[fits], 1)
    np.add.at(steps, ends[fits] - k + 1, -1)
    return np.cumsum(steps)[: n - k + 1] > 0


def _sequences(texts: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, shingles) of each text."""
    words, ends = word_hashes(texts)
    for a, b in zip(np.concatenate([[0], ends[:-1]]), ends):
        yield words[a:b], shingle_sequence(words[a:b], k)


def shingle_counts(docs: DataFrame, k: int, text_col: str = "text") -> np.ndarray:
    """How many shingles of the whole corpus fall into each of BUCKETS buckets by hash: common shingles stand out. The counts only
    order shingles: which links are found doesn't depend on them, how many candidates are looked at does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            words, ends = word_hashes(batch.column(0))
            starts = np.concatenate([[0], ends[:-1]])
            long = shingle_sequence(words, k)[np.flatnonzero(_inside(starts, ends, k, len(words)))] if len(words) >= k else np.empty(0, np.uint64)
            short = [shingle_sequence(words[a:b], k) for a, b in zip(starts, ends) if 0 < b - a < k]
            counts += np.bincount((np.concatenate([long, *short]) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "n"])
        release()

    found = written(docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")), "counts").toArrow()  # BUCKETS rows at most
    counts = np.zeros(BUCKETS, np.int64)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return counts


def prefix(hashes: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first of the distinct ``hashes``, rare ones first in an order that all texts share: so many that two sets
    of Jaccard similarity ``similarity`` or more have one of them in common."""
    n = len(hashes)
    if not n:
        return hashes
    return hashes[np.lexsort((hashes, counts[hashes % np.uint64(len(counts))]))][: n - int(np.ceil(similarity * n - SLACK)) + 1]


_BITMAP = [f"b{i + 1}" for i in range(PARITY_WORDS)]


def signatures(docs: DataFrame, k: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, t1, t2, n, fp, b1..b4, prefix): t1 and t2 hash the sequence of words, n counts distinct shingles, fp is the SimHash
    fingerprint that they vote for; bit i of b1 to b4 is the parity of the number of shingles that hash to i, so that two sets differ
    in as many shingles as bits at least."""
    names = ["id", "row", "t1", "t2", "n", "fp", *_BITMAP]
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, k, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[] for _ in names[2:]]
            first: list[np.ndarray] = []
            for words, shingles in _sequences(batch.column(2), k):
                hashes = np.unique(shingles)
                odd = np.bincount((hashes & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
                data = words.tobytes()
                row = [xxhash.xxh64_intdigest(data, 1), xxhash.xxh64_intdigest(data, 2), len(hashes), fingerprint(hashes.astype(">u8")), *np.packbits(odd.astype(np.uint8)).view(">u8").tolist()]
                for column, x in zip(out, row):
                    column.append(x)
                first.append(prefix(hashes, counts.value, similarity).view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in first])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, np.concatenate([*first, np.empty(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(np.array(c, np.uint64).view(np.int64)) for c in out], lists], [*names, "prefix"])
        release()

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, ", ".join(f"{x} long" for x in names) + ", prefix array<bigint>")


def similar(docs: DataFrame, texts: DataFrame, pairs: DataFrame, k: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Those of ``pairs`` (a, b: numbers of ``texts``) whose shingle sets have Jaccard similarity ``similarity`` or more, written. Only
    the texts of the pairs are read. b may be the same in many pairs: it is looked up first, while rows are narrow."""
    pairs = written(pairs.distinct(), "pairs")
    # Computed twice rather than written: the pairs are few next to the texts.
    asked = pairs.select(F.col("a").alias("x")).unionByName(pairs.select(F.col("b").alias("x"))).distinct()
    wanted = texts.select("x", "rep.id", "rep.row").join(broadcast_if_small(asked), "x")
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text")).join(broadcast_if_small(wanted), ["id", "row"]).select("x", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles).view(np.int64) for _, shingles in _sequences(batch.column(1), k)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, np.concatenate([*sets, np.empty(0, np.int64)]))], ["x", "set"])
        release()

    sets = written(narrow.mapInArrow(run, "x long, set array<bigint>").dropDuplicates(["x"]), "sets")
    of = lambda x, name: sets.select(F.col("x").alias(x), F.col("set").alias(name))
    both = pairs.join(of("b", "theirs"), "b").join(of("a", "own"), "a")
    shared = F.size(F.array_intersect("own", "theirs"))
    links = written(both.filter(shared >= similarity * (F.size("own") + F.size("theirs") - shared)).select("a", "b"), "links")
    discard(sets, pairs)
    return links


def _grouped(texts: DataFrame, links: DataFrame) -> DataFrame:
    """(x, c) for all ``texts``: c is the least number that ``links`` (a, b) lead to, its own included."""
    return written(texts.select("x").join(connected_components(links).withColumnRenamed("node", "x"), "x", "left").select("x", F.coalesce("component", "x").alias("c")), "grouped")


def duplicate_groups(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, rep): each row's id and text hash, and its group, named by the least (id, row) in it; a written table.

    Equal word sequences are one text. Texts link if their k-word shingle sets are ``similarity`` alike or more by Jaccard:

    1. SimHash groups (fingerprints of the distinct shingles, three bits apart at most, by the generalised pigeonhole) propose to link each text
       with its group's first.
    2. Each text meets one hub under each shingle of its prefix: the text whose prefix others share most, which in a group of
       copies is one with few changes. Then, while that joins many, a hub drawn by hash. A hub that met all texts of a shingle leaves it.
    3. What is left in different groups meets under the shingles of the prefixes, all with all but for those of the
       commonest group among themselves. That search is complete: sets that are ``similarity`` alike share a shingle of their prefixes, and no
       bound that candidates have to meet before their sets are compared (sizes, places of the shared shingle, parity
       bitmaps) refuses such a pair.

    So the pairs whose sets are compared grow with the members of a group; pairs inside a group that is known are never formed. Texts have numbers, so
    that what moves is narrow.
    """
    each = written(signatures(docs.filter(F.col(id_col).isNotNull()), k, similarity, id_col, text_col), "signatures")
    rest = F.min_by(F.struct("n", "fp", *_BITMAP, "prefix"), F.struct("id", "row")).alias("s")
    first = each.groupBy("t1", "t2").agg(F.min(F.struct("id", "row")).alias("rep"), rest).select("t1", "t2", "rep", "s.*")
    texts = written(first.withColumn("x", F.monotonically_increasing_id()), "texts")  # numbers of the rows as they are written
    compared = lambda pairs: similar(docs, texts, pairs, k, similarity, id_col, text_col)

    fps = written(texts.groupBy("fp").agg(F.min("x").alias("rep"), F.count(F.lit(1)).alias("n")), "fingerprints")
    alike = fingerprint_components(fps, 3).select("fp", F.col("component").alias("b"))
    proposed = written(texts.select("fp", F.col("x").alias("a")).join(alike, "fp").filter("a != b").select("a", "b"), "proposed")

    entries = texts.select("x", "n", F.posexplode("prefix").alias("pos", "h"))
    twice = entries.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    held = written(entries.join(twice, "h"), "held")
    info = written(texts.select("x", *_BITMAP).join(held.groupBy("x").agg(F.sum("texts").alias("weight")), "x"), "info")
    now = written(held.drop("texts").join(broadcast_if_small(info), "x").withColumn("c", F.col("x")), "entries")
    total = info.count()
    discard(held, fps)

    def near(x: str, y: str) -> Column:
        """What holds for similar sets x and y at the first shingle that their prefixes share."""
        nx, ny, i, j = (F.col(c) for c in (f"{x}n", f"{y}n", f"{x}pos", f"{y}pos"))
        sizes = (nx >= similarity * ny - SLACK) & (ny >= similarity * nx - SLACK)
        places = 1 + F.least(nx - i - 1, ny - j - 1) >= similarity / (1 + similarity) * (nx + ny) - SLACK
        apart = sum((_distance(f"{x}{b}", f"{y}{b}") for b in _BITMAP), F.lit(0))
        return (F.col(f"{x}c") != F.col(f"{y}c")) & sizes & places & (apart <= (1 - similarity) / (1 + similarity) * (nx + ny) + SLACK)

    named = lambda df, x: df.select(*[F.col(c).alias(c if c == "h" else f"{x}{c}") for c in df.columns])
    links, turn = proposed.limit(0), 0
    while True:
        order = F.struct("weight", "x") if turn == 0 else F.struct(F.xxhash64("x", F.lit(turn)), "x")
        hubs = now.groupBy("h").agg(F.max_by(F.struct("x", "n", "pos", "c", *_BITMAP), order).alias("s")).select("h", "s.*")
        met = written(now.join(named(hubs, "hub_"), "h").filter("x != hub_x").select(*now.columns, "hub_x", near("", "hub_").alias("near")), "met")
        pairs = met.filter("near").select(F.col("x").alias("a"), F.col("hub_x").alias("b"))
        found = compared(pairs.unionByName(proposed) if turn == 0 else pairs)
        links = links.unionByName(found)
        groups = _grouped(texts, links)
        # The hubs are done with under their shingles, and so are shingles whose other texts are of one group. main is the group that holds
        # most of a shingle's texts.
        grouped = met.drop("hub_x", "near", "c").join(broadcast_if_small(groups), "x")
        main = grouped.groupBy("h", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("h").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.count(F.lit(1)).alias("groups")).filter("groups > 1").select("h", "main")
        main = written(main, "main")
        left = written(grouped.join(broadcast_if_small(main), "h").withColumn("other", F.col("c") != F.col("main")).select(*now.columns, "other"), "left")
        discard(now, met, main, groups)
        now, turn = left, turn + 1
        if found.count() <= WORTHWHILE * total:
            break
        now = now.drop("other")

    once = ~F.col("y_other") | (F.col("x_x") < F.col("y_x"))
    cross = named(now.filter("other"), "x_").join(named(now, "y_").hint("merge"), "h").filter(near("x_", "y_") & once).select(F.col("x_x").alias("a"), F.col("y_x").alias("b"))
    last = compared(cross)
    groups = _grouped(texts, links.unionByName(last))
    named_by = groups.join(texts.select("x", "rep"), "x").groupBy("c").agg(F.min("rep").alias("rep"))
    known = texts.select("x", "t1", "t2").join(groups, "x").join(named_by, "c").select("t1", "t2", "rep")
    out = written(each.select("id", "row", "t1", "t2").join(known, ["t1", "t2"]).select("id", "row", "rep"), "found")
    discard(each, texts, proposed, info, now, groups, links, last)
    return out


def drop_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that of the smallest id; rows without id stay. Null and empty texts
    are copies of each other; of rows that repeat the id and text that stays, one stays; an empty table stays empty; extra columns pass through."""
    found = duplicate_groups(docs, k, similarity, id_col=id_col, text_col=text_col)
    first = F.struct("id", "row") == F.col("rep")
    gone = broadcast_if_small(found.filter(~first).select(F.struct("id", "row").alias("key")).distinct())
    own, nth = free_name(docs, "own"), free_name(docs, "nth")
    gone = gone.withColumnRenamed("key", own + "_gone")
    rows = docs.withColumn(own, F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row")))
    stay = rows.join(gone, F.col(own) == F.col(own + "_gone"), "left_anti")
    if not found.filter(first).groupBy("id", "row").count().filter("count > 1").isEmpty():
        stay = stay.withColumn(nth, F.row_number().over(Window.partitionBy(own).orderBy(F.lit(0)))).filter((F.col(nth) == 1) | F.col(id_col).isNull())
    return stay.select(*docs.columns)
