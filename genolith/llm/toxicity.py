"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned: words whose share of toxic rows exceeds their share of others by far, and stems (the first 4 to
6 letters), for which less is asked, as inflected words are rare one by one. Spark counts them over the training rows.
Features are densities and rates, so the length of a text matters through its logarithm alone. Trees are
grown from histograms on the driver. The calibration is learned from margins of rows that neither lexicon nor trees had seen: the training rows are dealt
to FOLDS by hash, and a model without a fold judges its rows; the model that scores learns from all of them.

Bounds, parameters of ``train``: ROWS labelled rows (by hash of the id; labels are cut to them before they meet the
texts), LEXICON words. Scoring reads whole texts.

Cases: null and empty text have no words, and get the score of such texts; rows with null label or id aren't learned
from; of repeated labels of one id the largest counts; without rows of both classes every score is the share of toxic
rows (0 if there are none); extra columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded, free_name, release, written
from .langid import _with

ROWS, LEXICON, FOLDS = 20_000, 256, 3
#: Toxic rows that must hold a word or stem: so many and such a share of them.
LEAST_ROWS, LEAST_SHARE = 4, 0.005
#: The log odds of the lexicon's words and stems exceed these; a hit at most NEAR words from a second-person word is near it.
WORD_ODDS, STEM_ODDS, NEAR = 2.5, 1.2, 6
#: Letters of stems, which end in * in the lexicon; words that a worker remembers, before it forgets them all.
STEMS, MEMORY = (4, 5, 6), 100_000

#: Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros su".split())
#: Look-alikes that hide letters.
LOOKALIKES = str.maketrans("013457@$!|", "oieastasil")

WORD = re.compile(r"[^\W\d_]+")
#: Runs of digits or symbols that stand before a letter. A run is tried at its begin alone, and never given back, so that a text is read once.
HIDING = re.compile(r"(?<![\d@$!|*._\-])[\d@$!|*._\-]++(?=[^\W\d_])")
SYMBOLS = re.compile(r"[^\w]|_")
NAMES = ("log_words", "hit_rate", "log_hits", "distinct_hits", "weight_rate", "near_rate", "near_hits", "second_rate", "stem_rate", "log_stems", "stem_weight_rate", "top_stem", "capitals", "exclaimed", "punctuation", "digits", "hidden_rate", "hidden_hits")

#: Character classes: 0 other, 1 lower-case letter, 2 capital, 3 white space, 4 digit, 5 punctuation, 6 exclamation mark.
_CLASS = np.array([6 if c == "!" else 3 if c.isspace() else 2 if c.isupper() else 1 if c.isalpha() else 4 if c.isdigit() else 5 if c.isprintable() else 0 for c in map(chr, range(1 << 16))], np.uint8)


class Lexicon(dict):
    """Words and stems (ending in *) with their log odds. As a dict, it numbers words: 0 says nothing of a text, i stands
    for ``special[i - 1]``: weight as a word, weight and number as a stem (-1: none), second person or not."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights, self.stems = weights, {w: i for i, w in enumerate(sorted(w for w in weights if w[-1] == "*"))}
        self.special: list[tuple[float, float, int, bool]] = []

    def __reduce__(self):
        return Lexicon, (self.weights,)

    def __missing__(self, word: str) -> int:
        stem = max((s for k in STEMS if len(word) >= k and (s := word[:k] + "*") in self.stems), key=self.weights.__getitem__, default=None)
        found = (self.weights.get(word, 0.0), self.weights[stem] if stem else 0.0, self.stems[stem] if stem else -1, word in SECOND_PERSON)
        number = 0
        if found != (0.0, 0.0, -1, False):
            self.special.append(found)
            number = len(self.special)
        self[word] = number
        return number

    def of(self, words: list[str]) -> tuple[np.ndarray, list[tuple[float, float, int, bool]]]:
        """Places of the words that say something, and what."""
        if len(self) > MEMORY:
            self.clear()
            self.special.clear()
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        places = np.flatnonzero(numbers)
        return places, [self.special[i - 1] for i in numbers[places].tolist()]


def _hidden(lowered: str) -> list[str]:
    """The chunks between white space in which digits or symbols stand before letters."""
    out, past = [], 0
    ahead = dict.fromkeys(" \n", -1)  # the next of each, looked for once
    for m in HIDING.finditer(lowered):
        if m.start() >= past:
            start = max(lowered.rfind(c, past, m.start()) for c in ahead) + 1
            for c, at in ahead.items():
                if at < m.end():
                    found = lowered.find(c, m.end())
                    ahead[c] = found if found >= 0 else len(lowered)
            past = min(ahead.values())
            out.append(lowered[start:past])
    return out


def _near(hits: np.ndarray, persons: np.ndarray) -> int:
    """How many of ``hits`` have one of ``persons`` (both ascending) at most NEAR words away."""
    if not len(hits) or not len(persons):
        return 0
    after = np.searchsorted(persons, hits)
    behind, ahead = persons[np.maximum(after - 1, 0)], persons[np.minimum(after, len(persons) - 1)]
    return int((np.minimum(np.abs(hits - behind), np.abs(ahead - hits)) <= NEAR).sum())


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The features of one text, in the order of NAMES."""
    text = text or ""
    kinds = np.bincount(_CLASS[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 0xFFFF)], minlength=7) if text else np.zeros(7)
    lowered = text.lower()
    words = WORD.findall(lowered)
    n = max(1, len(words))
    places, about = lexicon.of(words)
    hits = [(p, x[0]) for p, x in zip(places.tolist(), about) if x[0]]
    persons = np.array([p for p, x in zip(places.tolist(), about) if x[3]])
    near = _near(np.array([p for p, _ in hits], int), persons)
    stems = [x for x in about if x[2] >= 0]
    top = max(Counter(x[2] for x in stems).values(), default=0)
    weights = lexicon.weights
    hidden = _hidden(lowered)
    folded = sum(1 for w in hidden if SYMBOLS.sub("", w.translate(LOOKALIKES)) in weights and not any(x in weights for x in WORD.findall(w)))
    letters, chars = max(1, kinds[1] + kinds[2]), max(1, len(text))
    return [
        float(np.log1p(len(words))), len(hits) / n, float(np.log1p(len(hits))), float(len({words[p] for p, _ in hits})), sum(w for _, w in hits) / n, near / n, float(near), len(persons) / n,
        len(stems) / n, float(np.log1p(len(stems))), sum(x[1] for x in stems) / n, float(top),
        kinds[2] / letters, kinds[6] / chars, (kinds[5] + kinds[6]) / chars, kinds[4] / chars, len(hidden) / n, float(folded),
    ]


class Trees:
    """Gradient-boosted trees of ``depth`` for the logistic loss, on features cut into at most 32 bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, least: int = 5, ridge: float = 1.0):
        self.cuts = [np.unique(np.quantile(c[c != c.min()] if (c != c.min()).any() else c, np.linspace(0, 1, 31), method="lower")) for c in x.T]
        bins, self.depth, self.rate = self._binned(x), depth, rate
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.trees = float(np.log(mean / (1 - mean))), []
        margin = np.full(len(y), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(bins, p - y, p * (1 - p), least, ridge)
            self.trees.append(tree)
            margin += self._walk(tree, bins)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        """Bin 0: below the first cut; bin i: at or above cut i - 1."""
        return np.stack([np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T)], axis=1).astype(np.int16)

    def _grow(self, bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, least: int, ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature or -1, last bin that goes left, value) by node; node i has children 2i + 1 and 2i + 2."""
        nodes = 2 ** (self.depth + 1) - 1
        feature, split, value = np.full(nodes, -1), np.zeros(nodes, int), np.zeros(nodes)
        rows = {0: np.arange(len(bins))}
        for node in range(nodes):
            if (own := rows.pop(node, None)) is None:
                continue
            g, h = grad[own], hess[own]
            total_g, total_h = g.sum(), h.sum()
            value[node] = -self.rate * total_g / (total_h + ridge)
            if 2 * node + 2 >= nodes or len(own) < 2 * least:
                continue
            best = (1e-6, -1, 0)
            for f in range(bins.shape[1]):
                b, size = bins[own, f], len(self.cuts[f]) + 1
                left_g, left_h, left_n = (np.cumsum(np.bincount(b, w, minlength=size))[:-1] for w in (g, h, None))
                gain = left_g**2 / (left_h + ridge) + (total_g - left_g) ** 2 / (total_h - left_h + ridge) - total_g**2 / (total_h + ridge)
                gain[(left_n < least) | (len(own) - left_n < least)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), f, int(gain.argmax()))
            if best[1] >= 0:
                feature[node], split[node] = best[1:]
                left = bins[own, best[1]] <= best[2]
                rows[2 * node + 1], rows[2 * node + 2] = own[left], own[~left]
        return feature, split, value

    def _walk(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], bins: np.ndarray) -> np.ndarray:
        feature, split, value = tree
        at, every = np.zeros(len(bins), int), np.arange(len(bins))
        for _ in range(self.depth):
            f = feature[at]
            inner = f >= 0
            at = np.where(inner, 2 * at + 1 + (bins[every, np.maximum(f, 0)] > split[at]), at)
        return value[at]

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = self._binned(x)
        return self.base + sum(self._walk(t, bins) for t in self.trees)


class Isotonic:
    """The nondecreasing step function nearest to (x, y) in squares, by pooling neighbours that decrease."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        xs, at = np.unique(x, return_inverse=True)
        weight = np.bincount(at).astype(float)
        pools: list[list[float]] = []
        for v, s, w in zip(xs, np.bincount(at, y), weight):
            pools.append([v, s, w])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                _, s, w = pools.pop()
                pools[-1][1] += s
                pools[-1][2] += w
        self.starts, self.values = np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.values[np.maximum(np.searchsorted(self.starts, x, side="right") - 1, 0)]


class Model:
    """Lexicon, trees and calibration. ``folds``: for each, whether a row is in it, and all rows' features by the lexicon that didn't see it."""

    def __init__(self, lexicon: Lexicon, x: np.ndarray, y: np.ndarray, folds: list[tuple[np.ndarray, np.ndarray]]):
        self.lexicon, self.share = lexicon, float(y.mean()) if len(y) else 0.0
        self.trees = Trees(x, y) if 0 < y.sum() < len(y) else None
        if self.trees is not None:
            fair = [(own, seen) for own, seen in folds if own.any() and 0 < y[~own].sum() < (~own).sum()]
            margins = [Trees(seen[~own], y[~own]).margin(seen[own]) for own, seen in fair] or [self.trees.margin(x)]
            labels = [y[own] for own, _ in fair] or [y]  # too few rows for folds
            self.calibrated = Isotonic(np.concatenate(margins), np.concatenate(labels))

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.share)
        return self.calibrated(self.trees.margin(np.array([features(t, self.lexicon) for t in texts], float)))


def learn_lexicon(rows: DataFrame, text_col: str = "text", label_col: str = "toxic", size: int = LEXICON) -> dict[str, float]:
    """The ``size`` words and ``size`` stems of highest log odds, with these."""
    n = rows.agg(F.sum(label_col).alias("bad"), F.count(F.lit(1)).alias("all")).first()
    if not n.all or not n.bad:
        return {}
    words = F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit(r"(\p{L}+)"), 1))
    stems = [F.transform(F.filter(words, lambda w, k=k: F.char_length(w) >= k), lambda w, k=k: F.concat(F.substring(w, 1, k), F.lit("*"))) for k in STEMS]
    least = max(LEAST_ROWS, int(LEAST_SHARE * n.bad))
    counts = rows.select(label_col, F.explode(F.array_distinct(F.concat(words, *stems))).alias("word")).groupBy("word").agg(F.sum(label_col).alias("bad"), F.count(F.lit(1)).alias("all")).filter(F.col("bad") >= least)
    odds = F.log((F.col("bad") + 0.5) / (n.bad + 1)) - F.log((F.col("all") - F.col("bad") + 0.5) / (n.all - n.bad + 1))
    scored = counts.select("word", odds.alias("odds"), F.endswith("word", F.lit("*")).alias("stem")).filter(F.col("odds") > F.when(F.col("stem"), STEM_ODDS).otherwise(WORD_ODDS))
    best = [x for stem in (False, True) for x in scored.filter(F.col("stem") == stem).orderBy(F.desc("odds"), "word").limit(size).collect()]
    return {r.word: r.odds for r in best}


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the texts of ``docs`` and the labels of at most ``rows`` ids, those of least hash."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    some = written(known.orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(rows), "labels")
    sample = written(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id"), "sample")  # at most ``rows`` rows
    fold = F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS))
    lexicons = [Lexicon(learn_lexicon(rows)) for rows in (sample, *(sample.filter(fold != f) for f in range(FOLDS)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [[v for lexicon in lexicons for v in features(t.as_py(), lexicon)] for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(every, pa.list_(pa.float64()))], ["id", "toxic", "x"])
        release()

    found = written(sample.select("id", "toxic", "text").mapInArrow(run, "id long, toxic int, x array<double>").withColumn("fold", fold), "features").toArrow()
    order = np.argsort(found["id"].to_numpy(), kind="stable")
    x = found["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(lexicons), len(NAMES))[order]
    own = found["fold"].to_numpy()[order]
    return Model(lexicons[0], x[:, 0], found["toxic"].to_numpy().astype(float)[order], [(own == f, x[:, f + 1]) for f in range(FOLDS)])


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1."""
    shared, place, name = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col), free_name(docs, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(batch.column(place).to_pylist()), pa.float64())], [*batch.schema.names, name])
        release()

    return bounded(docs).mapInArrow(run, _with(docs, f"`{name}` double"))
