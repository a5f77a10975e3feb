"""Language identification by cross-parsing entropy.

A bounded sample of labelled texts per language becomes a suffix automaton over all its characters. A text is parsed greedily into the
longest phrases that occur in a language's sample (a character that doesn't occur is a phrase by itself); the fewer phrases it needs,
normalised by the sample's length, the closer the language.

The transitions of an automaton are one table in which one look finds each (in large alphabets some by search), and the texts of an Arrow batch are parsed together: step t takes the t-th character of every
block of BLOCK characters. Each block's parse begins anew at its first character; then the parse that comes from the block before is followed until a
phrase of it begins where one of the block's own does, from where on both are the same. So the counts are those of one parse from
end to end, whatever BLOCK is.

Bound, a parameter of ``train``: of each language at most ROWS labelled rows are taken, in the order of a hash of their id, whole, while they
hold at most CHARACTERS characters together. Rows of more than an eighth of that come after all others, shortest first, so that a language is
learned from such a row (from its first MOST characters) only if it has no others. Prediction reads whole texts.

Cases: null text, or text without a letter, is ``und`` with score 0; equally near languages go to the first by
name; no labelled rows at all: every text is ``und``; texts may repeat; extra columns pass through.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import bounded, free_name, release

ROWS, CHARACTERS, MOST, BLOCK = 384, 1 << 18, 1 << 19, 2048
#: Characters of texts that are parsed together, about.
TOGETHER = 4_000_000
#: Rounds in which states look for a place.
ROUNDS = 64
#: Bits of a character and of a state in a transition: a state and the next one, or a state and a character, are one 64-bit number.
POINT, STATE = 21, 31
_NEXT, _NONE = (1 << STATE) - 1, -1


def automaton(text: str) -> list[dict[int, int]]:
    """The suffix automaton of ``text``: the next states of each state by code point; state 0 is the start."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in map(ord, text):
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p != -1:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nexts


def _places(sizes: np.ndarray, first: np.ndarray, by: np.ndarray, known: int) -> tuple[np.ndarray, int]:
    """(a place for each state or -1, a number above all). States of many characters come first; each tries places until all its cells are free, and of several that
    want a cell or a place in the same round one gets it. Those that find none in ROUNDS rounds are left without, as in large alphabets some are."""
    cells = len(by) * 3 // 2 + 16 * (known + 16)
    place, free, unused = np.full(len(sizes), -1), np.ones(cells + known + 1, bool), np.ones(cells, bool)
    rng = np.random.default_rng(0)
    kinds = np.unique(sizes)
    for size in kinds[kinds > 0][::-1].tolist():
        left = np.flatnonzero(sizes == size)
        mine = by[first[left][:, None] + np.arange(size)]
        for _ in range(ROUNDS):
            # Single cells are looked for among the free ones.
            at = rng.integers(0, cells, len(left)) if size > 1 else rng.choice(np.flatnonzero(free[known:cells]) + known, len(left)) - mine[:, 0]
            good = np.flatnonzero(unused[at] & free[at[:, None] + mine].all(axis=1))
            good = good[np.unique(at[good], return_index=True)[1]]
            want = at[good][:, None] + mine[good]
            earliest = np.zeros(want.size, bool)
            earliest[np.unique(want, return_index=True)[1]] = True
            alone = earliest.reshape(want.shape).all(axis=1)
            good = good[alone]
            place[left[good]] = at[good]
            free[want[alone]] = unused[at[good]] = False
            left, mine = np.delete(left, good), np.delete(mine, good, axis=0)
            if not len(left):
                break
    return place, cells


class Parser:
    """Phrases of texts in one sample.

    Characters are numbered from 1, and each state is a place in ``table``: what follows state s by character c is in cell s + c, as the state that the cell
    belongs to and the next one. States lie so that no two need the same cell; the transitions of those that found no such place, which are numbered beyond
    ``dead``, are in sorted arrays.
    """

    def __init__(self, sample: str):
        nexts = automaton(sample)
        known = sorted(nexts[0])
        #: Numbers of code points; 0 for all that the sample lacks, in the last place for those beyond.
        self.number = np.zeros(known[-1] + 2 if known else 1, np.int32)
        self.number[known] = np.arange(1, len(known) + 1)
        sizes = np.array([len(own) for own in nexts])
        first = np.append(0, np.cumsum(sizes))
        by = self.number[np.fromiter((c for own in nexts for c in own), np.int64, first[-1])].astype(np.int64)
        #: The state after a character that the sample lacks, and after the whole sample: nothing goes on from it.
        place, self.dead = _places(sizes, first, by, len(known))
        place[sizes == 0] = self.dead
        wide = place < 0
        place[wide] = self.dead + np.arange(1, wide.sum() + 1)
        self.table = np.full(self.dead + wide.sum() + len(known) + 1, _NONE)
        to = place[np.fromiter((n for own in nexts for n in own.values()), np.int64, first[-1])]
        own, apart = np.repeat(place, sizes), np.repeat(wide, sizes)
        self.table[(own + by)[~apart]] = (own << STATE | to)[~apart]
        keys = (own << POINT | by)[apart]
        order = np.argsort(keys)
        self.keys, self.after = keys[order], to[apart][order]
        #: States after the first character of a phrase.
        self.start = np.full(len(known) + 1, self.dead)
        self.start[by[: sizes[0]]] = to[: sizes[0]]

    def step(self, state: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states after characters ``points``, by number; places where a phrase begins with them)."""
        found = self.table.take(state + points)
        begins = np.flatnonzero(found >> STATE != state)
        found &= _NEXT
        if len(self.keys):
            look = np.flatnonzero(state[begins] > self.dead)
            keys = state[begins[look]] << POINT | points[begins[look]]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            found[begins[look[hit]]] = self.after[at[hit]]
            begins = np.delete(begins, look[hit])
        found[begins] = self.start.take(points[begins])
        return found, begins

    def _walk(self, state: int, points: np.ndarray, own: np.ndarray) -> tuple[int, int, int]:
        """Follow a parse in ``state`` through ``points`` to the first phrase that begins where ``own`` is true: phrases begun
        before, that place (the end if there is none) and the state at the end."""
        table, keys, begun = memoryview(self.table), memoryview(self.keys), 0
        for t, c in enumerate(points.tolist()):
            found = table[state + c]
            if found >> STATE == state:
                state = found & _NEXT
                continue
            if state > self.dead:
                at = bisect_left(keys, state << POINT | c)
                if at < len(keys) and keys[at] == state << POINT | c:
                    state = int(self.after[at])
                    continue
            if own[t]:
                return begun, t, state
            begun += 1
            state = int(self.start[c])
        return begun, len(points), state

    def count(self, grid: np.ndarray, sizes: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Phrases that begin in each column of ``grid`` (a block of code points; columns by falling ``sizes``) in the parse of its whole
        text; follows[j] is the column of the next block of the same text, or -1."""
        lanes, height = len(sizes), len(grid)
        grid = self.number.take(grid, mode="clip")
        alive = lanes - np.searchsorted(sizes[::-1], np.arange(height), side="right")  # columns longer than t
        marks, state = np.zeros((height, lanes), bool), np.full(lanes, self.dead)
        for t, m in enumerate(alive.tolist()):
            state[:m], begins = self.step(state[:m], grid[t, :m])
            marks[t, begins] = True
        total = marks.sum(axis=0)
        counts = total.copy()
        # From each block into the next, until both parses begin a phrase at the same place.
        active = np.flatnonzero(follows >= 0)
        seen, extra, now = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), state.copy()
        met = np.full(lanes, -1)
        t = 0
        while len(active) and t < height:
            into = follows[active]
            fits = sizes[into] > t
            if not fits.all():
                active, into = active[fits], into[fits]
            now[active], begins = self.step(now[active], grid[t, into])
            begun = np.zeros(len(active), bool)
            begun[begins] = True
            same = begun & marks[t, into]
            met[active[same]] = t
            extra[active[begun & ~same]] += 1
            seen[active[~same]] += marks[t, into[~same]]
            active = active[~same]
            t += 1
        fine = (follows >= 0) & (met >= 0)
        counts[follows[fine]] = extra[fine] + total[follows[fine]] - seen[fine]
        # Where they never meet inside a block (a text that repeats itself, mostly), go on character by character.
        for head in np.flatnonzero(~np.isin(np.arange(lanes), follows[follows >= 0])).tolist():
            j, own_state = head, None
            while follows[j] >= 0:
                nxt = int(follows[j])
                if own_state is None and met[j] < 0:
                    own_state = int(state[j])
                if own_state is not None:
                    begun, place, end = self._walk(own_state, grid[: sizes[nxt], nxt], marks[: sizes[nxt], nxt])
                    counts[nxt] = begun + int(marks[place : sizes[nxt], nxt].sum())
                    own_state = end if place == sizes[nxt] else None
                j = nxt
        return counts


class Model:
    """Languages and their parsers."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        self.parsers = [Parser(samples[x].lower()) for x in self.langs]
        #: Bits to name a place in the sample: what a phrase costs.
        self.cost = np.array([log2(max(2, len(samples[x]))) for x in self.langs])

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Normalised phrases [text, language]: bits a character."""
        codes = [np.frombuffer(x.lower().encode("utf-32-le", "replace"), np.uint32) for x in texts]
        parts = [max(0, -(-len(c) // BLOCK)) for c in codes]
        of = np.repeat(np.arange(len(texts)), parts)
        counts = np.zeros((len(texts), len(self.langs)))
        if len(of):
            sizes = np.concatenate([np.minimum(BLOCK, len(c) - BLOCK * np.arange(n)) for c, n in zip(codes, parts)])
            order = np.argsort(-sizes, kind="stable")
            column = np.empty(len(order), np.int64)
            column[order] = np.arange(len(order))
            later = np.append(of[1:] == of[:-1], False)
            follows = np.where(later, np.append(column[1:], -1), -1)[order]
            grid, at = np.zeros((int(sizes.max()), len(order)), np.uint32), 0
            for c, n in zip(codes, parts):
                for j in range(n):
                    block = c[j * BLOCK : (j + 1) * BLOCK]
                    grid[: len(block), column[at + j]] = block
                at += n
            for k, parser in enumerate(self.parsers):
                np.add.at(counts[:, k], of[order], parser.count(grid, sizes[order], follows))
        return counts * self.cost / np.maximum(1, [len(c) for c in codes])[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Labels, and scores from 0 to 1: the lead of the best language over the second, 1 if it needs no phrases."""
        labels, scores, at = ["und"] * len(texts), np.zeros(len(texts)), 0
        asked = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))] if self.langs else []
        while at < len(asked):
            size, end = 0, at
            while end < len(asked) and (end == at or size + len(texts[asked[end]]) <= TOGETHER):
                size += len(texts[asked[end]])
                end += 1
            bits = self.phrases([texts[i] for i in asked[at:end]])
            best = bits.argmin(axis=1)
            for i, b, row in zip(asked[at:end], best, bits):
                second = np.delete(row, b).min() if len(row) > 1 else 2 * row[b]
                labels[i], scores[i] = self.langs[b], 1 - row[b] / second if second > 0 else 1.0
            at = end
        return labels, scores


def train(labelled: DataFrame, rows: int = ROWS, characters: int = CHARACTERS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    """A model from rows with text and label, in two passes: one counts labels, one takes of each the ``rows`` rows with the least
    hash of their id, from among about four times as many."""
    known = labelled.filter(F.col(label_col).isNotNull() & (F.char_length(text_col) > 0)).select(F.col(label_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 40)).alias("d"))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not counts:
        return Model({})
    below = reduce(lambda c, x: c.when(F.col("lang") == x[0], int(min(1.0, 4 * rows / x[1]) * (1 << 40))), list(counts.items())[1:], F.when(F.col("lang") == next(iter(counts)), int(min(1.0, 4 * rows / counts[next(iter(counts))]) * (1 << 40))))
    size = F.char_length("text").cast("long")
    long = size > characters // 8
    order = Window.partitionBy("lang").orderBy(long, F.when(long, size), "d", "text")
    some = known.filter(F.col("d") <= below).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= rows)
    some = some.withColumn("past", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter((F.col("past") <= characters) | (F.col("nth") == 1))
    found = some.select("lang", "nth", F.substring("text", 1, MOST).alias("text")).collect()  # ``rows`` texts a language at most
    return Model({x: "\n".join(r.text for r in sorted(found, key=lambda r: r.nth) if r.lang == x) for x in counts})


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    label, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, scores = shared.value.predict(batch.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.string()), pa.array(scores)], [*batch.schema.names, label, score])
        release()

    return bounded(docs).mapInArrow(run, _with(docs, f"`{label}` string, `{score}` double"))


def _with(df: DataFrame, more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [more])
