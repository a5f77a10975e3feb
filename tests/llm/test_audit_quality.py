"""Whitening, filter audit and quality: brute force, gradients, held-out accuracy and odd rows."""

import zlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from genolith.llm import audit, quality, queries, whitening
from pyspark.sql import functions as F

WS = " \t\n\x0b\x0c\r"


# whitening


def test_whitening_equals_numpy(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    good = {r.vec_id: r.embedding for r in rows if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)}
    x = {i: tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v) for i, v in good.items()}
    fit = np.array(sorted(set(x.values())))
    mean = fit.sum(axis=0) / len(fit)
    values, vectors = np.linalg.eigh((fit - mean).T @ (fit - mean) / len(fit))
    got = queries.op11_whitening(spark, sf_dir).toPandas()
    assert len(got) == 16 * len(good) and set(got.vec_id) == set(good) and set(got.n) == {len(fit)} and got.identity_error.max() < 1e-9
    sums = [sum(c) for c in zip(*fit.tolist())]
    for component, own in got.groupby("component"):
        vector = vectors[:, -component]
        want = np.array([(np.array(x[i]) - mean) @ vector for i in own.vec_id]) / np.sqrt(values[-component])
        sign = np.sign(want @ own.whitened.to_numpy())
        assert np.allclose(own.whitened, sign * want, atol=1e-6)
        assert np.allclose(own.explained, values[-component] / values.sum(), rtol=1e-9)
        assert list(own.deviation) == [sum((len(fit) * a - s) ** 2 for a, s in zip(x[i], sums)) for i in own.vec_id]


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(0)
    flat = rng.normal(size=(30, 3)) @ np.array([[1, 0, 0], [0, 2, 0], [0, 0, 0]])  # the third entry never varies
    rows = [(i, [float(c) for c in v], 5.0) for i, v in enumerate(flat)] + [(0, [float(c) for c in flat[0]], 5.0)] * 40
    odd = [(100, None), (101, [1.0, None, 0.0]), (102, [1.0, float("nan"), 0.0]), (103, [float("inf"), 0.0, 0.0]), (104, []), (105, [1e300, 0.0, 0.0]), (106, [1.0, 2.0]), (None, [0.5, 0.25, 0.0])]
    df = spark.createDataFrame(rows + [(i, v, None) for i, v in odd], "vec_id long, embedding array<double>, x double").repartition(4)
    got = whitening.whiten(df).toPandas()
    assert set(got.component) == {1, 2} and got.vec_id.isna().sum() == 2 and (got.vec_id == 0).sum() == 2 * 41
    assert set(got.vec_id.dropna()) == set(range(30)) and set(got.n) == {31} and got.identity_error.max() < 1e-9
    unique = got.drop_duplicates(["vec_id", "component"])
    wide = unique.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(wide.T @ wide / 31, np.eye(2), atol=1e-6) and abs(got.drop_duplicates("component").explained.sum() - 1) < 1e-9
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.filter("vec_id = 0")).count() == 0


def test_whitening_is_exact_or_says_so():
    x = np.array([[1_000_000, 1_000_064], [1_000_010, 1_000_000]])
    m = whitening.Whitening(10**9, x.sum(axis=0) * (10**9 // 2), np.eye(2), np.eye(2), np.ones(2), np.ones(2))
    with pytest.raises(OverflowError):
        m.deviation(x)
    m.n, m.sums = 3 * 10**7, x.sum(axis=0) * (3 * 10**7 // 2)
    assert m.deviation(x).tolist() == [sum((m.n * a - s) ** 2 for a, s in zip(row, m.sums.tolist())) for row in x.tolist()]


# filter audit


def words_of(text):
    return [w for w in text.translate({ord(c): " " for c in WS}).split(" ") if w]


def brute_audit(rows, labels):
    """rows (id, text, lang), labels {id: (quality, toxic)} -> {(part, order, step): counts}."""
    masks = []
    for i, text, lang in rows:
        text = text or ""
        words = words_of(text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows),
        }
        masks.append((lang or "", fails, labels.get(i, (0, 0)) if i is not None else (0, 0)))
    out = {}
    for part in {m[0] for m in masks}:
        own, shapley = [m for m in masks if m[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [m for m in left if m[1][f]]
                before = [m for m in own if m[1][f] and any(m[1][g] for g in order[: step - 1])]
                alone = [m for m in own if m[1][f] and sum(m[1].values()) == 1]
                left = [m for m in left if not m[1][f]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(before), len(alone), sum(m[2][0] == 1 for m in gone), sum(m[2][1] == 1 for m in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def as_rows(df):
    return {(r.part, r.filter_order, r.step): [r[c] for c in audit.COUNTS] for r in df.collect()}


def test_audit_equals_brute_force(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text, r.lang) for r in odd_docs.collect()]
    labels = [(0, 1, 0), (1, 0, 1), (1, 1, None), (5, 1, 1), (7, None, 1), (9, 1, 1), (None, 1, 1), (999, 1, 1)]
    known = {0: (1, 0), 1: (1, 1), 5: (1, 1), 7: (0, 1), 9: (1, 1)}
    got = as_rows(audit.audit(odd_docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == brute_audit(rows, known) and len(got) == 600 * len({r[2] for r in rows})
    assert audit.audit(no_docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_audit_of_own_filters(spark):
    docs = spark.createDataFrame([(1, "a", "en"), (2, "ab", "en"), (3, "ab", None), (4, "b", "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = as_rows(audit.audit(docs, none, {"X": F.col("text").contains("a"), "Y": F.col("text").contains("b")}, copies=None))
    assert got["en", "XY", 1][:4] == [1, 2, 0, 1] and got["en", "XY", 2][:4] == [0, 1, 1, 1] and got["", "YX", 2] == [0, 0, 1, 0, 0, 0, 1]
    with pytest.raises(ValueError):
        audit.audit(docs, none, {c: F.lit(True) for c in "ABCDEFG"}, copies=None)


# quality


def test_gradients_equal_differences():
    rng, net = np.random.default_rng(1), quality.Network(3)
    for name in net.NAMES:
        setattr(net, name, getattr(net, name).astype(float) + (0.2 if "bias" in name else 0))
    texts = pa.array(["".join(rng.choice(list("abcdefg hij!#"), size=k)) for k in (5, 700, 1500, 256)] + [None])
    packed, y = quality.Packed(texts), np.array([1, 0, 1, 0, 1.0])

    def loss():
        z = net.margins(packed)
        return np.mean(np.log1p(np.exp(z)) - y * z)

    found = net.gradients(packed, y)
    for name in net.NAMES:
        x = getattr(net, name)
        for at in rng.choice(x.size, min(12, x.size), replace=False) if name != "vectors" else [ord("a") * 8 + 1, ord("#") * 8 + 5, ord("j") * 8]:
            was, e = x.flat[at], 1e-5
            x.flat[at] = was + e
            up = loss()
            x.flat[at] = was - e
            down = loss()
            x.flat[at] = was
            assert abs((up - down) / (2 * e) - found[name].flat[at]) < 2e-3 * max(1, abs(found[name].flat[at])) , (name, at)


def test_every_byte_counts():
    """The margin of a text equals one computed window by window, wherever slices and neighbours lie."""
    rng, net = np.random.default_rng(2), quality.Network(5)
    texts = ["".join(rng.choice(list("abc def\n"), size=k)) for k in (0, 1, 247, 248, 249, 511, 513, 3 * quality.SLICE)]
    got = net.margins(quality.Packed(pa.array(texts)))
    for text, margin in zip(texts[:-1], got):
        data = text.encode()
        halves = -(-(len(data) + 8) // 256)
        data += bytes(halves * 256 + 12 - len(data))
        pooled = np.full((halves, quality.FILTERS), -np.inf)
        for start in range(0, halves * 256 - 8, 4):
            window = net.vectors[list(data[start : start + 12])].reshape(3, 32)
            pooled[start // 256] = np.maximum(pooled[start // 256], sum(window[i] @ net.filters[i] for i in range(3)))
        pooled = np.maximum(pooled + net.bias, 0)
        chunks = [np.maximum(pooled[i], pooled[min(i + 1, halves - 1)]) for i in range(max(1, halves - 1))]
        full = [min(512, max(0, len(text) - 256 * i)) / 512 for i in range(len(chunks))]
        units = np.max([np.maximum(c @ net.hidden + f * net.fullness + net.hidden_bias, 0) for c, f in zip(chunks, full)], axis=0)
        assert abs(units @ net.out + net.out_bias[0] - margin) < 1e-4
    last = texts[-1][: 2 * quality.SLICE] + "#" * 40 + texts[-1][2 * quality.SLICE + 40 :]
    alone, among = net.margins(quality.Packed(pa.array([last]))), net.margins(quality.Packed(pa.array(["x", last, None])))
    assert abs(alone[0] - among[1]) < 1e-5


def test_quality_of_held_out_rows(spark, sf_dir):
    tenth = sf_dir.replace("sf0.001", "sf0.1")
    got = queries.op13_quality(spark, tenth).toPandas()
    labels = spark.read.parquet(f"{tenth}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality")).toPandas().dropna()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert set(got.held_out[got.doc_id.notna()]) == {True, False} and all(h == (zlib.crc32(str(int(i)).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out))
    good, junk = held[held.quality == 1].predicted, held[held.quality == 0].predicted
    assert good.mean() > 0.97 and junk.mean() < 0.15 and got.score.between(0, 1).all()
    again = queries.op13_quality(spark, tenth).toPandas()
    assert np.allclose(got.sort_values("doc_id").score, again.sort_values("doc_id").score, atol=1e-3)


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 1, None), (4, 0, None), (4, 1, None), (5, 0, None), (None, 1, None), (7, None, None), (1, 1, None), (0, 0, None)], "doc_id long, quality int, toxic int")
    model = quality.train(odd_docs, labels)
    got = quality.score(odd_docs, model)
    assert got.columns == [*odd_docs.columns, "score_"]
    rows = got.select("text", F.col("score_").alias("s")).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.s <= 1 for r in rows)
    assert max(r.s for r in rows if not r.text) - min(r.s for r in rows if not r.text) < 1e-6  # null and empty alike
    assert quality.score(no_docs, model).count() == 0
    flat = quality.train(odd_docs, labels.filter("quality = 1"))
    assert {r.score_ for r in quality.score(odd_docs, flat).collect()} == {1.0} and quality.train(no_docs, labels.limit(0)).share == 0.5
    assert quality.train(odd_docs, labels, most_bytes=10).share == pytest.approx(0.6)
