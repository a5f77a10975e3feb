"""Urls, mixing, archives, embeddings, token stores and the pipeline: brute force, round trips and odd rows."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from grouping import components
from tokenizers import Tokenizer

import corpus_pipeline
from genolith.llm import embeddings, mixing, queries, tokenstore, urlfilter, warc
from genolith.llm.common import shared_path
from pyspark.sql import functions as F

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


# urls


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = max((r for _, r in queries.URL_RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])), key=len, default=None)
    return host, path, best


URLS = [None, "", "nothing", "http://", "http://A.Example.ORG/es/x?y#z", "http://example.org/en/12", "http://example.org", "http://example.org?x/es/", "ftp://x.com/fr/1", "http://com/de/", "http://xcom/de/", "http://b.net/a\nb#c", "http://u@h.org:80/", "a://b://c.com/de/"]


def test_rules_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    got = urlfilter.filter_urls(pages, queries.URL_RULES).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        assert (r.host_, r.path, r.rule) == brute_rule(r.url)
        if r.rule:
            assert r.verdict == dict((b, a) for a, b in queries.URL_RULES)[r.rule]
    assert urlfilter.filter_urls(pages.limit(0), queries.URL_RULES).count() == 0


def test_urls_of_odd_rows(spark):
    long = "http://long.com/fr/" + "/".join(f"part{i}" for i in range(20_000))
    rows = [(None, long), (None, long), (1, None), (None, None), (2, "http://example.org/es/" + "x" * 100_000), (2, "http://example.org/es/y")]
    got = sorted(((r.page_id or 0, r.url or "", r.rule, r.verdict) for r in urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), queries.URL_RULES).collect()), key=str)
    assert len(got) == 6 and {(i, rule, v) for i, _, rule, v in got} == {(0, "com/fr/", "allow"), (0, None, "allow"), (1, None, "allow"), (2, "example.org/es/", "block")}


def test_late_tokens_are_mined(spark):
    long = lambda i: "/".join(f"s{i}x{j}" for j in range(14))
    rows = [(i, f"http://bad.org/{long(i)}/casino") for i in range(20)] + [(20 + i, f"http://good.org/{long(20 + i)}/news") for i in range(20)] + [(40, f"http://else.net/{long(40)}/casino")]
    got = urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), [("block", "bad.org/"), ("allow", "good.org/")], support=0.1)
    assert {r.page_id: r.verdict for r in got.collect()}[40] == "block"


def test_mined_rules_equal_brute_force(spark, sf_dir):
    rows = queries.op4_url_filter(spark, sf_dir.replace("sf0.001", "sf0.01")).collect()
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/pages.parquet").select("page_id", "url").collect()}
    assert all((r.host, r.path, r.rule) == brute_rule(pages[r.page_id]) for r in rows)
    tokens = {(r.host, r.path): frozenset(r.t) for r in spark.createDataFrame([(x.host, x.path) for x in rows], "host string, path string").distinct().select("host", "path", urlfilter.tokens(F.col("host"), F.col("path")).alias("t")).collect()}
    labelled = [(tokens[x.host, x.path], x.verdict) for x in rows if x.rule]
    from itertools import combinations

    counts = defaultdict(lambda: defaultdict(int))
    for t, v in labelled:
        for n in range(1, len(t) + 1):
            for c in combinations(sorted(t), n):
                counts[c][v] += 1
    least = 0.005 * len(labelled)
    import math

    found = [(sum(x.values()), c, v, k) for c, x in counts.items() for v, k in x.items() if k >= math.ceil(least) and k / sum(x.values()) >= 0.8]
    for r in rows:
        if not r.rule:
            fit = [(k / n, k / len(labelled), v == "block", v) for n, c, v, k in found if set(c) <= tokens[r.host, r.path]]
            assert r.verdict == (max(fit)[3] if fit else "allow")


@pytest.mark.parametrize("n, segments", [(2, 40), (10_000, 40)])
def test_urls_of_many_segments_end(spark, n, segments):
    """A site's path template costs one item, whatever its length, and so do tokens of one page."""
    import time

    template = "/".join(f"dir{j}" for j in range(segments))
    rows = [(i, f"http://{'bad' if i % 2 else 'good'}.org/{template}/{'casino' if i % 2 else 'news'}{i % 5}") for i in range(n)] + [(n, f"http://else.net/{template}/casino1")]
    began = time.time()
    got = urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), [("block", "bad.org/"), ("allow", "good.org/")])
    verdicts = {r.page_id: r.verdict for r in got.collect()}
    assert len(verdicts) == n + 1 and time.time() - began < 60 and verdicts[n] == "block"


def test_levels_and_growth_find_the_same_rules(spark):
    rng = random.Random(1)
    rows = [(sorted({f"t{rng.randrange(12)}" for _ in range(rng.randrange(9))} | ({"u", "v"} if i % 3 else set())), "block" if i % 4 == 0 else "allow") for i in range(300)]
    rows += [(["t1", "t2", "t3"], "block")] * 30
    labelled = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    found = []
    for widest in (0, 50):
        rules, items = urlfilter.mine(labelled, 0.02, 0.7, longest=3, widest=widest)
        found.append(sorted((tuple(r.antecedent), r.verdict, round(r.confidence, 9), round(r.support, 9)) for r in rules.collect()))
    assert found[0] == found[1] and len(found[0]) > 10 and {r.token: r.item for r in items.collect()}["v"] == "u"
    from itertools import combinations

    sets = [(frozenset(t) - {"v"}, v) for t, v in rows]
    every = {}
    for n in (1, 2, 3):
        for c in combinations(sorted({x for t, _ in sets for x in t}), n):
            own = [v for t, v in sets if set(c) <= t]
            for v in ("allow", "block"):
                if own.count(v) >= 0.02 * len(rows) and own.count(v) / len(own) >= 0.7:
                    every[c, v] = (own.count(v) / len(own), own.count(v) / len(rows))
    kept = sorted((c, v, round(x, 9), round(y, 9)) for (c, v), (x, y) in every.items() if not any((s, v) in every and every[s, v][0] >= x for k in range(1, len(c)) for s in combinations(c, k)))
    assert found[0] == kept


def test_urls_with_clashing_names(spark):
    names = ["__url", "__won", "__host", "__path", "host", "path", "rule", "verdict"]
    df = spark.createDataFrame([(i, u, *range(8)) for i, u in enumerate(URLS)], "page_id long, url string, " + ", ".join(f"`{n}` int" for n in names))
    got = urlfilter.filter_urls(df, queries.URL_RULES).collect()
    assert len(got) == len(URLS) and all([r[n] for n in names] == list(range(8)) and r.host_ == brute_rule(r.url)[0] for r in got)


# mixing


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mix(spark, sf_dir, docs):
    got = queries.op7_source_mix(spark, sf_dir).toPandas()
    again = queries.op7_source_mix(spark, sf_dir).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    own = got.merge(docs.select("doc_id", "source").toPandas(), on="doc_id")
    sizes = own.groupby("source")["size"].sum().to_dict()
    want = brute_targets(sizes)
    assert (own["taken"] <= 3 * own["size"]).all() and np.allclose(own["target"], own["source"].map(want))
    assert (abs(own.groupby("source")["taken"].sum() - own.groupby("source")["target"].first()) <= 64).all()
    assert (own["n_shards"] > 0).equals(own["taken"] > 0)


def test_small_sources_meet_their_targets(spark):
    rows = [(i, "w " * 50, f"s{i:02d}") for i in range(12)]
    got = mixing.mix_sizes(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted({r.target for r in got}) == [18.75, 37.5, 93.75] and all(abs(r.taken - r.target) <= 0.5 for r in got)


def test_shard_counts_are_the_targets(spark, docs):
    _, sources = mixing.placed(docs, 7)
    aims = mixing.targets(sources)
    counts = mixing.shard_counts(aims, 64, 7, per_shard=40).collect()
    by = defaultdict(list)
    for r in counts:
        by[r.k].append(r)
    for own in by.values():
        own.sort(key=lambda r: r.shard)
        assert [r.first for r in own] == [sum(x.n for x in own[:i]) for i in range(len(own))] and sum(r.n for r in own) == own[0].slots
        n, p = own[0].slots, 1 / len({r.shard for r in counts})
        assert len(own) > 5 and all(abs(r.n - n * p) < 5 * np.sqrt(n * p) + 1 for r in own)
    slots = mixing.slots(spark.createDataFrame(counts), 64, 7)
    assert slots.count() == sum(r.n for r in counts) and slots.select("k", "pass", "index").distinct().count() == slots.count()
    assert {(r.k, r.shard): r["count"] for r in slots.groupBy("k", "shard").count().collect()} == {(r.k, r.shard): r.n for r in counts}


def test_mix_equals_brute_force(spark, docs):
    """Taken words, from the slots and a plain layout of the sources' words."""
    some = docs.filter("doc_id < 80")
    rows, sources = mixing.placed(some, 7)
    slots = mixing.slots(mixing.shard_counts(mixing.targets(sources), 32, 7), 32, 7).collect()
    taken = defaultdict(int)
    held = defaultdict(dict)
    for r in rows.collect():
        for i in range(r["size"]):
            assert r.offset + i not in held[r.k]
            held[r.k][r.offset + i] = r.id
    for s in slots:
        for i in range(32 * s["index"], 32 * s["index"] + s.most):
            if i in held[s.k]:
                taken[held[s.k][i]] += 1
    assert all(sorted(x) == list(range(len(x))) for x in held.values())
    assert {r.doc_id: r.taken for r in mixing.mix_sizes(some, block=32).collect()} == {r.doc_id: taken[r.doc_id] for r in some.collect()}


def test_capped_targets(spark):
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate([("a", 3), ("b", 1000), ("c", 50), (None, 400), ("d", 0)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix_sizes(df, block=8).collect()}
    want = brute_targets({s: n for (_, _, s), n in zip(rows, (3, 1000, 50, 400, 0))})
    assert all(got[i].target == pytest.approx(want[s]) for i, _, s in rows) and all(r.taken <= 3 * r.size for r in got.values())
    assert abs(got[1].taken - got[1].target) <= 8


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 97, 1000])
def test_permutations(spark, n):
    got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(5)).alias("x")).collect()
    assert sorted(r.x for r in got) == list(range(n))


def test_mix_of_odd_rows(odd_docs, no_docs):
    sizes = mixing.mix_sizes(odd_docs)
    assert sizes.count() == odd_docs.count() and mixing.mix_sizes(no_docs).count() == 0
    mixed = mixing.mix_documents(odd_docs)
    assert mixed.columns == odd_docs.columns and mixing.mix_documents(no_docs).count() == 0
    n = lambda df: df.agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0]
    assert n(mixed) == sizes.agg(F.sum("taken")).first()[0]


def test_blocks_hold_what_sizes_say(spark, docs):
    some = docs.filter("doc_id < 60")
    blocks = mixing.mix_blocks(some, block=32).select(F.explode("pieces").alias("p")).groupBy("p.id").agg(F.sum("p.words").alias("n"))
    assert {r.id: r.n for r in blocks.collect()} == {r.doc_id: r.taken for r in mixing.mix_sizes(some, block=32).filter("taken > 0").collect()}


# archives


def check_archive(pages, got):
    same = defaultdict(list)
    for r in pages:
        same[r.html or ""].append(r.page_id)
    found = {r.page_id: r for r in got}
    assert len(got) == len(pages)
    for r in pages:
        data, first = (r.html or "").encode(), max(same[r.html or ""])
        x = found[r.page_id]
        assert (x.payload_bytes, x.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (x.record_type, x.refers_to) == (("response", None) if r.page_id == first else ("revisit", first))


def test_archive_of_pages(spark, sf_dir):
    check_archive(spark.read.parquet(f"{sf_dir}/pages.parquet").collect(), queries.op8_warc(spark, sf_dir).collect())


def test_archives_of_odd_payloads(spark):
    random.seed(1)
    part = ["\r", "\n", "\r\n", "\r\n\r\n", "a", "WARC/1.1\r\n", "é", "HTTP/1.1 200 OK\r\n\r\n", "\x00"]
    rows = [(i, random.choice(["http://a b/c", None, "", "http://é", "u\nv"]), random.choice([None, "", "".join(random.choices(part, k=random.randint(0, 9)))]), "x") for i in range(800)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(5)
    check_archive(df.collect(), warc.archived(df).collect())
    assert {r.record_type for r in warc.archived(df, min_bytes=10**6).collect()} == {"response"}
    assert warc.archived(df.limit(0)).count() == 0
    twice = warc.archived(spark.createDataFrame([(1, "u", "same"), (2, "u", "same"), (2, "u", "same"), (None, "u", "same")], "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.record_type) for r in twice) == [(0, "revisit"), (1, "revisit"), (2, "response"), (2, "response")]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_files(version):
    data = warc.version_block(version, "20010101000000") + warc.arc_record(version, "http://a/", "20010203040506", b"one\n\n", 7) + warc.arc_line(version, "dns:b", "20010203040507", 4, mime="text/dns") + b"\n\r\nx\n" + warc.arc_record(version, "http://b/", "20010203040507", b"")
    a, dns, b = warc.parse_arc(data)
    assert (a.url, a.date, a.payload, a.page, b.url, b.payload, b.page, dns.payload, dns.http) == ("http://a/", "20010203040506", b"one\n\n", 7, "http://b/", b"", None, b"\n\r\nx", False)
    assert data[a.offset :].startswith(b"http://a/") and data[b.offset :].startswith(b"http://b/")
    made = warc.warc_record(a, "f").decode()
    assert "WARC-Date: 2001-02-03T04:05:06Z" in made and "WARC-Type: response" in made and "WARC-Type: resource" in warc.warc_record(dns, "f").decode()
    again = warc.warc_record(b, "f", ("f", a.offset, a.url, a.date)).decode()
    assert f"WARC-Refers-To: {warc.record_id('f', a.offset)}" in again and "WARC-Refers-To-Date: 2001-02-03T04:05:06Z" in again and "WARC-Refers-To-Target-URI: http://a/" in again
    other = data.replace(" ".join(warc.ARC_FIELDS[version]).encode(), " ".join(warc.ARC_FIELDS[3 - version]).encode())
    for bad in (data[:-4], data[len(warc.version_block(version, "20010101000000")) :], other, data[:-1] + b"x\n", b"x" + data[:20]):
        with pytest.raises(ValueError):
            list(warc.parse_arc(bad))
    reader = warc.ArcReader()  # piece by piece
    assert [r.url for i in range(len(data)) for r in reader.take(data[i : i + 1])] == ["http://a/", "dns:b", "http://b/"]


def test_blank_lines_are_read_in_proportion(spark):
    import time

    began = time.time()
    page = "\r\n\r\n" * 2_500_000
    got = warc.archived(spark.createDataFrame([(1, "u", page), (2, "v", page)], "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == [(1, 10_000_000, "revisit", 2), (2, 10_000_000, "response", None)]
    assert time.time() - began < 60


# embeddings


def brute_links(rows):
    good = [(r.vec_id, r.label, np.array(r.embedding, float)) for r in rows if r.vec_id is not None and r.label is not None and r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and np.any(r.embedding)]
    return [(i, j) for i, (_, la, x) in enumerate(good) for j, (_, lb, y) in enumerate(good[:i]) if la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93], good


def check_embeddings(rows, got):
    links, good = brute_links(rows)
    parts = components(len(good), links)
    degree = np.bincount(np.array(links, int).ravel(), minlength=len(good))
    least = {}
    for i, p in enumerate(parts):
        least[p] = min(least.get(p, good[i][0]), good[i][0])
    want = {g[0]: (d, least[p]) for g, d, p in zip(good, degree, parts)}
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id) == want.get(r.vec_id, (0, r.vec_id)) and r.kept == (r.vec_id == r.component_id)


def test_embeddings_equal_brute_force(spark, sf_dir):
    check_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect(), queries.op9_embedding_dedup(spark, sf_dir).collect())


def test_repeated_ids_of_different_vectors(spark):
    near = [1.0, 0.05, 0.0]
    rows = [(1, [1.0, 0.0, 0.0], 1), (1, [0.0, 1.0, 0.0], 1), (2, near, 1), (3, [0.0, 0.0, 1.0], 1), (3, [0.0, 0.0, 1.0], 1)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 0, 1), (1, 1, 1), (2, 1, 1), (3, 1, 3), (3, 1, 3)]


def test_bounds_follow_the_threshold():
    assert embeddings.bounds(0.93) == (1, 18) and embeddings.bounds(0.99)[1] < 18 < embeddings.bounds(0.85)[1]
    with pytest.raises(ValueError):
        embeddings.bounds(0.3)


def test_recall_near_the_threshold(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(300, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(axis=1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    c = rng.uniform(0.931, 0.96, 300)[:, None]
    rows = [(i, [float(v) for v in x], 1) for i, x in enumerate(np.concatenate([base, c * base + np.sqrt(1 - c * c) * side]))]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert got.filter("n_links > 0").count() >= 0.95 * 600


def test_embeddings_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [0.0, 0.0], [1.0, None], [nan, 1.0], [inf, 1.0], [1.0, 1.0], [1.0, 1.0], [2.0, 2.0], [1.0, 1.1], [1.0, -1.0], [1.0, 1.0, 1.0], [1e30, 1e30], [1e-30, 1e-30]]
    rows = [(i, v, 1, "x") for i, v in enumerate(vectors)] + [(50, [1.0, 1.0], 2, "x"), (51, [1.0, 1.0], None, "x"), (52, [1.0, 1.0], None, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, component_id string")
    check_embeddings(df.collect(), embeddings.near_duplicates(df).collect())
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([(None, [1.0], 1), (1, [1.0], 1), (1, [1.0], 1)], "vec_id long, embedding array<float>, label int")).count() == 3


# token stores


def check_store(rows, got):
    t = Tokenizer.from_file(TOKENIZER)
    ids = [t.encode(r.text or "", add_special_tokens=False).ids + [2] for r in rows]
    want = sorted((-1 if r.doc_id is None else r.doc_id, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, x in zip(rows, ids))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)


def test_store_of_documents(spark, sf_dir, docs):
    check_store(docs.collect(), queries.op10_token_store(spark, sf_dir).collect())


def test_store_of_odd_rows(spark, odd_docs, no_docs):
    check_store(odd_docs.collect(), tokenstore.stored(odd_docs, TOKENIZER).collect())
    assert tokenstore.stored(no_docs, TOKENIZER).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    import pyarrow as pa

    e = tokenstore.Encoder(public_tokenizers.path(name))
    assert e.by_words == name.startswith("word")
    random.seed(3)
    pool = [*"abcXYZ'éÉßΣσİıñɅ́ \t\n\x0b\x1c\x1f\x85\xa0 .,!'-&#0123９漢字ⅣǅªŁ🙂", "'s", "'S", "<|endoftext|>", "it's", "Á", "ͅ"]
    texts = ["".join(random.choices(pool, k=random.randint(0, 25))) for _ in range(4000)] + ["".join(chr(random.choice([random.randint(32, 0x2FF), random.randint(32, 0xD7FF), random.randint(0xE000, 0x1FFFF)])) for _ in range(12)) for _ in range(2000)]
    for i in range(0, len(texts), 500):
        assert [x.tolist() for x in e.encode(pa.array(texts[i : i + 500]))] == e.encode_whole(texts[i : i + 500])


def test_ids_round_trip_and_damage(spark, docs):
    path = shared_path(spark, "store")
    some = docs.filter("doc_id < 40")
    tokenstore.write_store(some, TOKENIZER, 2, path)
    t = Tokenizer.from_file(TOKENIZER)
    text = {r.doc_id: r.text for r in some.collect()}
    for r in tokenstore.read_ids(spark, path).collect():
        assert np.frombuffer(r.ids, "<u2").tolist() == t.encode(text[r.doc_id], add_special_tokens=False).ids + [2]
    names = spark.read.parquet(f"{path}/chunks")
    assert names.count() == names.select("name").distinct().count()
    broken = names.withColumn("ids", F.when(F.col("name") == names.first().name, F.concat(F.col("ids"), F.lit(b"ab"))).otherwise(F.col("ids"))).collect()
    spark.createDataFrame(broken, names.schema).write.mode("overwrite").parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="damaged"):
        tokenstore.read_documents(spark, path).collect()


def test_crc_of_parts():
    rng = np.random.default_rng(0)
    parts = [rng.bytes(int(n)) for n in (0, 1, 5, 4096, 77)]
    after = np.array([sum(map(len, parts[i + 1 :])) for i in range(len(parts))])
    shifted = tokenstore.crc32_shifted(np.array([zlib.crc32(p) for p in parts], np.uint64), after)
    assert int(np.bitwise_xor.reduce(shifted)) == zlib.crc32(b"".join(parts))


def test_chunks_are_found_again():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 40000, 20000)
    gear = tokenstore._gear()
    ends = lambda x: tokenstore.cut(tokenstore.marks(x, gear), 0, len(x))
    chunks = lambda x: {x[s:e].tobytes() for s, e in zip([0, *ends(x)], ends(x))}
    whole = np.concatenate([a[:7000], a[7000:7040], a[7040:]])  # documents one after another are cut as each alone
    found = tokenstore.marks(whole, gear)
    assert [x - 7040 for x in tokenstore.cut(found, 7040, 20000)] == ends(a[7040:]) and tokenstore.cut(found, 7000, 7040) == [7040]
    assert all(64 <= e - s <= 4096 for s, e in zip([0, *ends(a)], ends(a)[:-1])) and ends(np.zeros(0, int)) == []
    both = chunks(a) & chunks(np.concatenate([rng.integers(0, 40000, 33), a]))
    assert len(both) > 0.8 * len(chunks(a))


@pytest.mark.parametrize("dims", [16, 64, 256])
@pytest.mark.parametrize("threshold", [0.85, 0.93, 0.98])
def test_recall_of_candidates(spark, dims, threshold):
    """Pairs just above the threshold, in vectors of all lengths of codes, among others of one label."""
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(500, dims))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = rng.uniform(threshold + 1e-4, threshold + (1 - threshold) / 3, (500, 1))
    x = np.concatenate([base, c * base + np.sqrt(1 - c * c) * side])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= threshold).sum() - len(x)
    got = sum(r.n_links for r in embeddings.near_duplicates(df, threshold).collect())
    assert 0.9 * want <= got <= want


# the pipeline


def test_pipeline_stages(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        path = shared_path(spark, f"test-{name}")
        stage(spark, docs, d).write.parquet(path)
        new = spark.read.parquet(path)
        if name != "tokens":
            assert new.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name], docs = new, new
    first = {r.doc_id for r in kept["toxicity"].collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert len([i for i in first if labels.get(i) == 1]) < 0.6 * sum(labels.values())
    rows = sorted(kept["toxicity"].collect(), key=lambda r: r.doc_id)
    sets = [_shingles(r.text) for r in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    pairs = {(j, i) for h in holders.values() for i in h for j in h if i < j}
    parts = components(len(rows), [(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    assert {r.doc_id for r in kept["near_duplicates"].collect()} == {rows[p].doc_id for p in parts}
    items = defaultdict(set)
    for r in spark.read.parquet(f"{d}/benchmark.parquet").collect():
        for w in _windows(r.text, 10):
            items[len(w.split())].add(w)
    clean = {r.doc_id for r in kept["near_duplicates"].collect() if not any(own & _windows(r.text, n) for n, own in items.items())}
    assert {r.doc_id for r in kept["decontamination"].collect()} == clean
    check_store(kept["mixing"].collect(), kept["tokens"].collect())


def test_stages_of_odd_rows(spark, sf_dir, odd_docs, no_docs):
    """Each stage on nulls, empty and very long texts, repeated rows, an empty table and columns with clashing names."""
    clashing = odd_docs.withColumns({"__score": F.lit(0.9), "own": F.lit(1), "copy": F.lit("x"), "nth": F.lit(2)})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, clashing, sf_dir)
        assert stage(spark, no_docs, sf_dir).count() == 0
        if name == "tokens":
            assert out.count() == clashing.count()
            continue
        assert out.columns == clashing.columns
        rows = out.collect()
        texts = {r.text for r in rows}
        assert all(r["__score"] == 0.9 and r.own == 1 for r in rows)
        if name in ("toxicity", "decontamination"):
            assert {None, "", "one", "two words"} <= texts
        if name == "near_duplicates":
            assert sum(r.doc_id is not None and not (r.text or "").split() for r in rows) == 1 and sum(r.doc_id is None for r in rows) == 2
        if name == "mixing":
            assert None not in texts and "" not in texts


def _shingles(text):
    import re

    w = re.findall("[^\x20\x09-\x0d]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def _words(text):
    import re

    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def _windows(text, n):
    w = _words(text)
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_tables_of_stages_go(spark, sf_dir):
    import os

    from genolith.llm.common import ensure_checkpoint_dir

    folder = ensure_checkpoint_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    corpus_pipeline.run(spark, sf_dir).count()
    assert {x.split("-")[1] for x in set(os.listdir(folder)) - before if x.startswith("stage-")} == {"tokens"}
