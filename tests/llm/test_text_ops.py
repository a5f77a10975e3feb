"""Lines, windows, fingerprints, languages and toxicity: brute force and odd rows."""

import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from grouping import components

from genolith.llm import decontam, langid, lines, queries, simhash, toxicity
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# lines


def test_lines_of_odd_rows(spark, odd_docs, no_docs):
    got = lines.dedup_lines(odd_docs)
    assert got.count() == odd_docs.count() and set(odd_docs.columns) < set(got.columns) and "kept_text_" in got.columns
    assert lines.dedup_lines(no_docs).count() == 0
    by = {(r.doc_id, r.text): r for r in got.collect()}
    assert by[(None, "no id here")].n_dropped == 0 and by[(0, None)].kept_text_ == "" and by[(0, None)].n_lines == 1
    assert by[(7, "a line that three documents share\nand their own line")].kept_text_ == "and their own line"
    assert by[(9, "a line that three documents share\nand their own line x")].kept_text_.startswith("a line that")


def test_line_positions(spark):
    hot = "this line is long enough"
    rows = [(1, f"{hot}\nx\n {hot.upper()}\t\ny"), (2, hot), (3, hot), (3, hot), (4, "short\nshort"), (5, "short"), (6, "short")]
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept_text == "x\ny" and got[1].n_dropped == 2 and got[2].kept_text == "" and got[3].kept_text == hot and got[4].n_dropped == 0


# decontamination


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def test_windows_of_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "One"), (1, "two words"), (2, None), (3, "..."), (4, "word5 and other5 things you idiot number 5 word6 and other6")], "item_id long, text string")
    got = decontam.decontaminate(odd_docs, items)
    assert got.count() == odd_docs.count() and "n_words_" in got.columns
    for r in got.collect():
        w = words(r.text)
        hit = set()
        named = set()
        for i, t in items.collect():
            v = words(t)
            n = min(10, len(v))
            for a in range(len(v) - n + 1 if v else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == v[a : a + n]:
                        hit |= set(range(b, b + n))
                        named.add(str(i))
        assert (r.n_words_, r.n_hit, r["items"]) == (len(w), len(hit), sorted(named))
    assert decontam.decontaminate(no_docs, items).count() == 0
    assert decontam.decontaminate(odd_docs, items.limit(0)).filter("n_hit > 0").count() == 0
    clean = decontam.clean_documents(odd_docs, items)
    assert clean.count() == got.filter("n_hit = 0").count() and clean.columns == odd_docs.columns


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x c b a y"), (2, "a x b c"), (3, "a a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert sorted(r.id for r in decontam.proximity_matches(docs, items).collect()) == [1, 3]
    assert [r.id for r in decontam.phrase_matches(docs, items).collect()] == [3]


# fingerprints


def brute_fingerprint(text, k):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_simhash_equals_brute_force(spark, sf_dir, docs):
    got = {r.doc_id: r for r in queries.op1_simhash(spark, sf_dir).collect()}
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    fps = [brute_fingerprint(r.text, 3) for r in rows]
    parts = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    for r, f, c in zip(rows, fps, parts):
        assert (got[r.doc_id].fingerprint, got[r.doc_id].component_id) == (f"{f:016x}", rows[c].doc_id)


def test_simhash_of_odd_rows(odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs)
    with_id = odd_docs.filter("doc_id is not null")
    assert got.count() == with_id.count() and simhash.near_duplicates(no_docs).count() == 0
    found = {r.doc_id: r for r in got.collect()}
    assert all(found[i].fingerprint == "0" * 16 and found[i].component_id == 0 for i in (0, 1, 2))
    assert found[6].component_id == 5 and found[8].component_id == 7
    for r in with_id.collect():
        assert found[r.doc_id].fingerprint == f"{brute_fingerprint(r.text, 3):016x}"


@pytest.mark.parametrize("tau", [0, 1, 3, 7])
def test_every_pair_within_tau_meets(spark, tau):
    rng = np.random.default_rng(tau)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ np.bitwise_or.reduce([np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64) for _ in range(d)]) for d in range(1, 9)]))
    df = spark.createDataFrame([(int(f), i, 1) for i, f in enumerate(fps.view(np.int64))], "fp long, rep long, n long")
    got = {r.rep: r.component for r in simhash.fingerprint_components(df, tau).collect()}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= tau
    want = components(len(fps), zip(*np.nonzero(np.tril(near, -1))))
    assert got == dict(enumerate(want))


def test_thresholds_sum(spark):
    rng = np.random.default_rng(0)
    groups = [list(range(i * 16, i * 16 + 16)) for i in range(4)]
    a = simhash.Allocation(100000, rng.uniform(5000, 95000, 64), groups, 3)
    t, cost = a.thresholds(rng.integers(0, 2, (50, 64)).astype(np.uint8))
    assert (t.sum(axis=1) == 0).all() and (t >= -1).all() and np.isfinite(cost).all()


def test_near_duplicates_by_shingles(spark, docs):
    rng = np.random.default_rng(1)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 300)) for _ in range(20)]
    copies = []
    for b in base:
        w = b.split()
        w[150] = "changed"
        copies.append(" ".join(w))
    other = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 300)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base + [b.upper() for b in base[:5]] + copies + other)]
    kept = sorted(r.doc_id for r in simhash.drop_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == list(range(20)) + list(range(45, 105))


def test_duplicates_with_other_repeat_counts(spark):
    rng = np.random.default_rng(2)
    halves = [[" ".join(f"w{x}" for x in rng.integers(0, 50000, 300)) for _ in range(2)] for _ in range(20)]
    rows = [(i, f"{p} {q}") for i, (p, q) in enumerate(halves)] + [(20 + i, " ".join([p] * 10 + [q])) for i, (p, q) in enumerate(halves)]
    kept = simhash.drop_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(20))


def test_every_pair_at_the_similarity_links(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        w = [f"w{x}" for x in rng.integers(0, 50000, 300)]
        rows.append((i, " ".join(w)))
        for j, n in enumerate((28, 29)):  # 264 of 328 shingles shared, and 263 of 329
            rows.append((100 + 100 * j + i, " ".join(w[:100] + [f"c{j}{x}" for x in rng.integers(0, 50000, n)] + w[100 + n :])))
    kept = simhash.drop_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(60)) + list(range(200, 260))


def test_duplicates_of_odd_rows(odd_docs, no_docs):
    kept = simhash.drop_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and simhash.drop_duplicates(no_docs).count() == 0
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[None] == 2 and ids[0] == 1 and not ids[1] and not ids[2] and ids[5] == 1 and not ids[6] and ids[7] == 1 and not ids[8]


# languages


def naive_phrases(text, sample):
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in sample:
            j += 1
        n, i = n + 1, j
    return n


@pytest.mark.parametrize("block", [7, 64, langid.BLOCK])
def test_parse_equals_naive(monkeypatch, block):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(langid, "BLOCK", block)
    samples = {"a": "".join(rng.choice(list("abc "), 3000)), "b": "".join(rng.choice(list("bcd é漢😀"), 2000)), "c": "aaa"}
    m = langid.Model(samples)
    texts = ["".join(rng.choice(list("abcd é漢字😀"), n)) for n in (1, 2, 17, 120, 3000, 9000)] + ["a" * 5000, "ab" * 4000, ""]
    for t, row in zip(texts, m.phrases(texts)):
        assert [round(x * len(t) / cost) for x, cost in zip(row, m.cost)] == [naive_phrases(t, samples[x]) for x in m.langs]


@pytest.mark.parametrize("rounds", [1, 3, langid.ROUNDS])
def test_parse_equals_naive_in_large_alphabets(monkeypatch, rounds):
    """States that find no place among the others' cells are searched for, with the same phrases."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(langid, "ROUNDS", rounds)
    monkeypatch.setattr(langid, "BLOCK", 50)
    sample = "".join(map(chr, 0x4E00 + rng.integers(0, 60, 6000)))
    m = langid.Model({"zh": sample, "x": "a"})
    assert rounds > 1 or len(m.parsers[1].keys) > 0
    texts = ["".join(map(chr, 0x4E00 + rng.integers(0, 70, n))) for n in (1, 50, 700)] + [sample[100:400], sample[7:10] * 100, "\0\U0010ffff a"]
    for t, row in zip(texts, m.phrases(texts)):
        assert [round(x * len(t) / cost) for x, cost in zip(row, m.cost)] == [naive_phrases(t, {"zh": sample, "x": "a"}[x]) for x in m.langs]


def test_transitions_lie_close(sf_dir):
    """What a parse looks up stays in a processor's cache: cells are few for the transitions they hold, and one look finds them."""
    sample = "\n".join(pq.read_table(f"{sf_dir}/documents.parquet")["text"].drop_null().to_pylist())[:60000].lower()
    p = langid.Parser(sample)
    transitions = sum(map(len, langid.automaton(sample)))
    assert p.table.nbytes < 24 * transitions and (p.table != langid._NONE).sum() == transitions


def test_scripts_of_their_own(spark):
    """Words drawn from alphabets of any size and plane are told apart."""
    rng = np.random.default_rng(5)
    scripts = {"en": (0x61, 26), "ru": (0x430, 32), "ko": (0xAC00, 2000), "zh": (0x4E00, 3000), "ja": (0x5E00, 2500), "xx": (0x20000, 1500)}
    rows = []
    for lang, (first, n) in scripts.items():
        words = ["".join(chr(first + x) for x in rng.integers(0, n, 2)) for _ in range(1500)]
        rows += [(len(rows) + i, " ".join(rng.choice(words, 120)), lang) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs.filter("doc_id % 2 = 1"), langid.train(docs.filter("doc_id % 2 = 0")))
    assert got.filter("lang = lang_pred").count() >= 0.97 * got.count()


def test_predictions_equal_brute_force(spark, docs):
    some = docs.filter("doc_id < 120")
    model = langid.train(docs, rows=80, characters=4000)
    samples = {}
    for r in sorted(docs.filter("lang is not null and length(text) > 0").select("lang", "text", F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40)).alias("d")).collect(), key=lambda r: (len(r.text) > 500, len(r.text) if len(r.text) > 500 else 0, r.d)):
        own = samples.setdefault(r.lang, [])
        own.append(r.text)
    for lang, own in samples.items():
        kept = [t for i, t in enumerate(own[:80]) if i == 0 or sum(map(len, own[: i + 1])) <= 4000]
        samples[lang] = "\n".join(kept)
    for r in langid.identify(some.select("doc_id", "text"), model).collect():
        t = (r.text or "").lower()
        if any(map(str.isalpha, t)):
            bits = {x: naive_phrases(t, s.lower()) * np.log2(max(2, len(s))) for x, s in samples.items()}
            best, second = sorted(bits.values())[:2]
            assert bits[r.lang_pred] == best and r.score == pytest.approx(1 - best / second)
        else:
            assert r.lang_pred == "und"


def test_languages_held_out(spark, sf_dir, docs):
    got = queries.op2_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.count() == docs.count()
    assert got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.9
    assert got.filter("score < 0 or score > 1 or score is null").count() == 0


def test_languages_of_odd_rows(odd_docs, no_docs):
    model = langid.train(odd_docs)
    got = langid.identify(odd_docs, model)
    assert got.count() == odd_docs.count() and {"lang_pred", "score", "score_"} <= set(got.columns)
    assert {r.text for r in got.filter("lang_pred = 'und'").collect()} == {None, "", " \t\n", "!!! ???"}
    none = langid.train(no_docs)
    assert langid.identify(no_docs, none).count() == 0 and langid.identify(odd_docs, none).filter("lang_pred <> 'und'").count() == 0


# toxicity


def test_toxicity_held_out(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.1")
    got = queries.op6_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out").toPandas()
    assert got[got.predicted == 1].toxic.mean() > 0.9 and got[got.toxic == 1].predicted.mean() > 0.85


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 0, 1), (5, 0, 0), (7, None, 0), (None, 0, 1), (3, 0, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
    for train_on, marks in ((odd_docs, labels), (odd_docs, labels.limit(0)), (no_docs, labels)):
        got = toxicity.score(odd_docs, toxicity.train(train_on, marks))
        assert got.count() == odd_docs.count() and "score_" in got.columns
        assert got.filter("score_ is null or score_ < 0 or score_ > 1").count() == 0
    assert toxicity.score(no_docs, toxicity.train(no_docs, labels)).count() == 0


def test_calibration_sees_unseen_rows():
    """Margins that calibrate come from models without the rows: where features say nothing of labels, scores stay near the share."""
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(300, len(toxicity.NAMES))), (rng.random(300) < 0.3).astype(float)
    own = rng.integers(0, 3, 300)
    fair = toxicity.Model(toxicity.Lexicon({}), x, y, [(own == f, x) for f in range(3)])
    seen = toxicity.Isotonic(fair.trees.margin(x), y)
    sure = lambda scores: (scores > 0.7).mean()
    assert sure(seen(fair.trees.margin(x))) > 0.2 and sure(fair.calibrated(fair.trees.margin(x))) < 0.05


def test_first_tree_splits_best():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 9, (200, 3)).astype(float), rng.integers(0, 2, 200).astype(float)
    y[x[:, 1] > 5] = 1
    t = toxicity.Trees(x, y, rounds=1, depth=1, rate=1.0, least=1, ridge=1.0)
    p = y.mean()
    gain = {}
    for f in range(3):
        for c in range(1, 9):
            g = [((p - y)[m].sum(), (p * (1 - p)) * m.sum()) for m in (x[:, f] < c, x[:, f] >= c)]
            gain[f, c] = sum(a * a / (h + 1) for a, h in g)
    f, c = max(gain, key=gain.get)
    want = np.log(p / (1 - p)) + np.where(x[:, f] < c, *[-(p - y)[m].sum() / (p * (1 - p) * m.sum() + 1) for m in (x[:, f] < c, x[:, f] >= c)])
    assert np.allclose(t.margin(x), want)


def test_isotonic_equals_brute_force():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 12, 60).astype(float), rng.integers(0, 2, 60).astype(float)
    f = toxicity.Isotonic(x, y)
    v = np.unique(x)
    mean = {(a, b): y[(x >= v[a]) & (x <= v[b])].mean() for a in range(len(v)) for b in range(a, len(v))}
    want = [max(min(mean[a, b] for b in range(i, len(v))) for a in range(i + 1)) for i in range(len(v))]
    assert np.allclose(f(v), want)


def test_features():
    lexicon = toxicity.Lexicon({"idiot": 3.0, "vequ*": 2.0})
    x = dict(zip(toxicity.NAMES, toxicity.features("YOU 1d10t, an idiot! vequant", lexicon)))
    assert x["near_hits"] == 1 and x["hidden_hits"] == 1 and x["distinct_hits"] == 1 and x["top_stem"] == 1 and x["exclaimed"] > 0
    assert len(toxicity.features(None, lexicon)) == len(toxicity.NAMES)


def test_hashes(spark):
    text = "ÀBC dÉf"
    assert spark.createDataFrame([(text,)], "t string").select(lines.line_key(F.col("t")).alias("k")).first().k == "Àbc dÉf"


def plain_features(text, lexicon):
    """The features of a text, word by word."""
    import re as regex

    from genolith.llm import toxicity as t

    text, weights = text or "", lexicon.weights
    lowered = text.lower()
    words = t.WORD.findall(lowered)
    n = max(1, len(words))
    hits = [i for i, w in enumerate(words) if weights.get(w)]
    persons = [i for i, w in enumerate(words) if w in t.SECOND_PERSON]
    near = [i for i in hits if any(abs(i - p) <= t.NEAR for p in persons)]
    stems = [max(own, key=weights.get) for w in words if (own := [w[:k] + "*" for k in t.STEMS if len(w) >= k and w[:k] + "*" in weights])]
    hidden = [c for c in regex.split("[ \n]", lowered) if regex.search(r"[\d@$!|*._\-][^\W\d_]", c)]
    folded = [c for c in hidden if regex.sub(r"[^\w]|_", "", c.translate(t.LOOKALIKES)) in weights and not any(w in weights for w in t.WORD.findall(c))]
    capitals, letters = sum(c.isupper() for c in text), max(1, sum(c.isupper() or c.isalpha() for c in text))
    marks = sum(not (c.isspace() or c.isupper() or c.isalpha() or c.isdigit()) and c.isprintable() for c in text)
    chars = max(1, len(text))
    return [
        np.log1p(len(words)), len(hits) / n, np.log1p(len(hits)), len({words[i] for i in hits}), sum(weights[words[i]] for i in hits) / n, len(near) / n, len(near), len(persons) / n,
        len(stems) / n, np.log1p(len(stems)), sum(weights[s] for s in stems) / n, max((stems.count(s) for s in stems), default=0),
        capitals / letters, text.count("!") / chars, marks / chars, sum(c.isdigit() and not c.isspace() for c in text) / chars, len(hidden) / n, len(folded),
    ]


def test_toxicity_features_equal_brute_force():
    from genolith.llm import toxicity

    lexicon = toxicity.Lexicon({"idiot": 5.0, "trash": 4.0, "idio*": 3.0, "idiots*": 2.0, "you": 1.0, "worth*": 2.5})
    rng = np.random.default_rng(0)
    pieces = ["you", "idiot", "Idiots", "1d10t", "tr@sh", "TRASH!!", "--a", "a--", "...", "!!1", "a1b2", "worthless", "der", "_x", "é", "漢字", "\n", "\n\n", "\t", "-" * 40, "x" * 9, "@@\nq", "du,dich", "\x0bz", "٣a"]
    for i in range(400):
        text = "".join(rng.choice(pieces) + rng.choice([" ", "", "\n"], p=[0.7, 0.2, 0.1]) for _ in range(int(rng.integers(0, 60))))
        assert np.allclose(toxicity.features(text, lexicon), plain_features(text, lexicon)), repr(text)
    assert toxicity.features(None, lexicon) == toxicity.features("", lexicon)


@pytest.mark.parametrize("text", ["-" * 1_000_000, "-" * 500_000 + "a", "you idiot " * 100_000, "1d10t " * 150_000, "-a" * 400_000, "x\n1y" * 200_000])
def test_toxicity_features_of_long_texts_take_their_length(text):
    import time

    from genolith.llm import toxicity

    lexicon = toxicity.Lexicon({"idiot": 5.0, "idio*": 3.0})
    began = time.time()
    toxicity.features(text, lexicon)
    assert time.time() - began < 2


def test_lines_with_clashing_names(spark):
    docs = spark.createDataFrame([(i, "a line that three documents share", 1, 2, 3, 4) for i in range(4)], "doc_id long, text string, __hash int, __id int, __row int, __drops int")
    from genolith.llm import lines

    got = lines.dedup_lines(docs).collect()
    assert sorted(r.n_dropped for r in got) == [0, 1, 1, 1] and all((r["__hash"], r["__id"], r["__row"], r["__drops"]) == (1, 2, 3, 4) for r in got)
