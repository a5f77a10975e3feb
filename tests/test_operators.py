"""Operators against published examples, brute force and invariants."""

import hashlib
import itertools
import re

import numpy as np
import pytest

from genolith.functions import bits, cigar, hwe, phred
from genolith.operators import evaluate, hmm, reads, sites
from genolith.plans.config import Config
from pyspark.sql import functions as F


def make(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_scan_of_one_read(spark):
    s = make(spark, [(i, "1", 9 + 2 * i, "G", "C") for i in range(7)], "snp long, chr string, pos long, ref string, alt string")
    a = make(spark, [("s", "1", "r", False, False, 17, 60, "6M", 0, "GACCGA", ":;<=>?", "")], "sample string, chr string, qname string, dup boolean, rev boolean, pos long, mapq int, cigar string, isize int, seq string, qual string, bx string")
    got = [(r.snp, r.bq) for r in reads.scan(a, s).orderBy("snp").collect()]
    assert got == [(4, -25), (5, 27), (6, -29)]


def test_scan_caps_scores_and_drops(spark):
    s = make(spark, [(0, "1", 10, "A", "C")], "snp long, chr string, pos long, ref string, alt string")
    row = lambda **k: tuple({"sample": "s", "chr": "1", "qname": "r", "dup": False, "rev": False, "pos": 10, "mapq": 20, "cigar": "1M", "isize": 0, "seq": "C", "qual": "I", "bx": ""} | k)
    base = {"sample": "s", "chr": "1", "qname": "r", "dup": False, "rev": False, "pos": 10, "mapq": 20, "cigar": "1M", "isize": 0, "seq": "C", "qual": "I", "bx": ""}
    assert row
    many = [base | x for x in ({}, {"dup": True}, {"mapq": 16}, {"isize": -700}, {"cigar": "*"}, {"qual": "*"}, {"seq": "T"})]
    a = make(spark, [tuple(x.values()) for x in many], "sample string, chr string, qname string, dup boolean, rev boolean, pos long, mapq int, cigar string, isize int, seq string, qual string, bx string")
    assert [r.bq for r in reads.scan(a, s).collect()] == [20]


def test_range_join_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    a = [(i, int(s), int(s + n)) for i, (s, n) in enumerate(zip(rng.integers(0, 9000, 60), rng.integers(-5, 3000, 60)))]
    p = [(i, int(x)) for i, x in enumerate(rng.integers(0, 9000, 80))]
    got = reads.range_join(make(spark, a, "i int, s long, e long"), make(spark, p, "j int, pos long"), "s", "e", "pos", width=500).select("i", "j").collect()
    assert sorted(map(tuple, got)) == sorted((i, j) for (i, s, e), (j, x) in itertools.product(a, p) if s <= x <= e)


def test_cigar(spark):
    df = make(spark, [("3S10M2D5I4=1X2H", 100)], "c string, p long")
    r = df.select(cigar.span(F.col("c")).alias("span"), cigar.blocks(F.col("c"), F.col("p")).alias("b")).first()
    assert r.span == 17 and [tuple(x) for x in r.b] == [(100, 3, 10), (112, 18, 4), (116, 22, 1)]
    assert make(spark, [("*",), (None,)], "c string").select(cigar.span(F.col("c"))).collect()[0][0] == 0


@pytest.mark.parametrize("gp,text", [((0.333, 0.333, 0.333), "./.:0.333,0.333,0.333:0.999"), ((0.95, 0.0, 0.05), "0/0:0.950,0.000,0.050:0.100")])
def test_genotype_cells(spark, gp, text):
    assert make(spark, [gp], "a double, b double, c double").select(phred.genotype_cell([F.col(x) for x in "abc"])).first()[0] == text


def test_haplotype_dosage_cells(spark):
    df = make(spark, [(0.1, 0.2, 0.7, [0.0, 0.2, 0.1, 0.5, 1.2])], "a double, b double, c double, h array<double>")
    assert df.select(phred.genotype_cell([F.col(x) for x in "abc"], F.col("h"))).first()[0] == "./.:0.100,0.200,0.700:1.600:0.000,0.200,0.100,0.500,1.200"


@pytest.mark.parametrize("pos,width,grid,dist", [([1, 10, 11, 20], 10, [0, 0, 1, 1], [10.0, None]), ([1000001, 1015456, 1095123], 10000, [0, 1, 2], [10000.0, 80000.0, None])])
def test_grids(spark, pos, width, grid, dist):
    g = sites.grid(make(spark, [("1", i, p) for i, p in enumerate(pos)], "chr string, snp long, pos long"), width)
    assert [r.grid for r in g.orderBy("snp").collect()] == grid
    assert [r.dist_next for r in sites.grid_meta(g).orderBy("grid").collect()] == dist


def test_output_blocks(spark):
    ten = make(spark, [("1", i, i) for i in range(10)], "chr string, snp long, grid long")
    assert [tuple(r) for r in sites.output_blocks(ten, 1000).collect()] == [("1", 0, 0, 9, 0, 9)]
    many = [tuple(r) for r in sites.output_blocks(ten, 3).orderBy("block").collect()]
    assert many[0][2] == 0 and many[-1][3] == 9 and all(x[3] + 1 == y[2] for x, y in zip(many, many[1:])) and all(x[5] > x[4] for x in many)


def test_map_interpolation(spark):
    points = [101, 4001, 5001, 10001]
    gmap = sites.cumulate(make(spark, [("1", p, r) for p, r in zip(points, (1.0, 2.0, 0.5, 0.0))], "chr string, position long, rate double"))
    cm = dict(zip(points, np.cumsum([0, 3900 * 1.0 / 1e6, 1000 * 2.0 / 1e6, 5000 * 0.5 / 1e6])))
    asked = [5, 15, 4500, 5000, 5600, 9000, 11000]
    got = [r.cm for r in sites.interpolate(gmap, make(spark, [("1", i, p) for i, p in enumerate(asked)], "chr string, snp long, pos long"), 0.5).orderBy("snp").collect()]
    want = [-0.5 * 96 / 1e6, -0.5 * 86 / 1e6, *[float(np.interp(x, points, [cm[p] for p in points])) for x in asked[2:6]], cm[10001] + 0.5 * 999 / 1e6]
    assert np.allclose(got, want, atol=1e-9)


@pytest.mark.parametrize("h1,truth,error", [("0100", "0000", 2 / 3), ("00000", "00111", 1 / 4)])
def test_switch_errors(spark, h1, truth, error):
    rows = [(1, i, int(t), 1 - int(t), int(h)) for i, (h, t) in enumerate(zip(h1, truth))]
    assert evaluate.phase_switches(make(spark, rows, "sample int, pos int, t1 int, t2 int, h1 int")).first().error == pytest.approx(error)


def test_greedy_cap(spark):
    r = make(spark, [(1, 1, [0, 1]), (1, 2, [0, 1]), (2, 1, [5])], "sample long, read long, snp array<long>")
    left = reads.cap_depth_greedy(r, 1).collect()
    assert sorted(x.sample for x in left) == [1, 2]


def brute_hwe(a, b, c):
    from fractions import Fraction
    from math import factorial as f

    n, rare = a + b + c, 2 * min(a, c) + b
    if not n:
        return 1.0
    w = {h: Fraction(2**h, f(h) * f((rare - h) // 2) * f(n - (rare + h) // 2)) for h in range(rare % 2, rare + 1, 2)}
    return float(min(1, sum(x for x in w.values() if x <= w[b]) / sum(w.values())))


@pytest.mark.parametrize("n", [(0, 0, 0), (5, 10, 20), (1, 0, 0), (0, 3, 0), (10, 0, 10), (30, 5, 1)])
def test_hwe(n):
    assert hwe.exact_p(*n) == pytest.approx(brute_hwe(*n), abs=1e-9)


def test_hwe_of_large_counts():
    assert 0 <= hwe.exact_p(44102, 39965, 9218) <= 1 and hwe.exact_p(1000000, 100, 1) < 1


def _random_model(rng, k=3, t=4, n=2):
    e1 = rng.uniform(0.1, 1, (n, t, k))
    e2 = e1[:, :, :, None] * e1[:, :, None, :] * rng.uniform(0.5, 1, (n, t, k, k))
    switch = rng.uniform(0.1, 1, (k, t - 1))
    return e1, e2, hmm.Model(rng.uniform(0.1, 0.9, (k, t)), switch / switch.sum(axis=0), rng.uniform(0.3, 0.95, t - 1), np.full(k, 1 / k))


def test_haploid_equals_all_paths():
    e, _, m = _random_model(np.random.default_rng(1))
    gamma, switches = hmm.haploid(e, m)
    k, t = 3, 4
    want, total = np.zeros_like(gamma), np.zeros((len(e), 1))
    for path in itertools.product(range(k), repeat=t):
        p = m.prior[path[0]] * e[:, 0, path[0]]
        for g in range(1, t):
            p = p * e[:, g, path[g]] * (m.stay[g - 1] * (path[g] == path[g - 1]) + (1 - m.stay[g - 1]) * m.switch[path[g], g - 1])
        total[:, 0] += p
        for g in range(t):
            want[:, g, path[g]] += p
    assert np.allclose(gamma, want / total[:, :, None])
    assert switches.min() >= 0 and switches.sum(axis=0).max() <= len(e)


def test_diploid_equals_all_paths():
    _, e, m = _random_model(np.random.default_rng(2), k=2, t=3)
    gamma, switches = hmm.diploid(e, m)
    move = lambda a, b, g: m.stay[g] * (a == b) + (1 - m.stay[g]) * m.switch[b, g]
    want = np.zeros_like(gamma)
    total = np.zeros(len(e))
    for x in itertools.product(range(2), repeat=3):
        for y in itertools.product(range(2), repeat=3):
            p = m.prior[x[0]] * m.prior[y[0]] * e[:, 0, x[0], y[0]]
            for g in (1, 2):
                p = p * e[:, g, x[g], y[g]] * move(x[g - 1], x[g], g - 1) * move(y[g - 1], y[g], g - 1)
            total += p
            for g in range(3):
                want[:, g, x[g], y[g]] += p
    assert np.allclose(gamma, want / total[:, None, None, None])
    assert switches.sum(axis=0).max() <= 2 * len(e)


def _random_reads(rng, k=3, t=23, n=5, reads=80):
    switch = rng.uniform(0.1, 1, (k, t - 1))
    m = hmm.Model(rng.uniform(0.1, 0.9, (k, 2 * t)), switch / switch.sum(axis=0), rng.uniform(0.5, 0.95, t - 1), np.full(k, 1 / k))
    grid, of = rng.integers(0, t, reads), np.repeat(np.arange(reads), rng.integers(1, 4, reads))
    site = grid[of] * 2 + rng.integers(0, 2, len(of))
    return m, hmm.Reads(n, np.sort(rng.integers(0, n, reads)), grid, of, site, rng.choice([-30.0, -20.0, 20.0, 30.0], len(of))), np.repeat(np.arange(t), 2)


@pytest.mark.parametrize("block", [1, 2, 7])
def test_blocks_of_grids_change_nothing(monkeypatch, block):
    m, r, grid_of = _random_reads(np.random.default_rng(0))

    def everything():
        for method, run in hmm.KERNELS.items():
            sums = hmm.Sums.zero(m)
            run(r, m, grid_of, sums)
            yield from (run(r, m, grid_of), sums.alt, sums.total, sums.switch, sums.prior, hmm.marginals(r, m, method, [3, 9, 20]))

    whole = list(everything())
    monkeypatch.setattr(hmm.passes, "__defaults__", (block, None, None))
    assert all(np.allclose(a, b) for a, b in zip(whole, everything()))


def test_paths_are_drawn_from_their_posterior():
    m, r, _ = _random_reads(np.random.default_rng(1))
    e, grids = hmm.read_likelihoods(r, m), hmm.Grids(r)
    emit = lambda lo, hi: grids.emissions(np.log((e[:, :, None] + e[:, None, :]) / 2), lo, hi)
    gamma, _ = hmm.diploid(emit(0, 23), m)
    drawn, found = hmm.sampled_paths(emit, m, r.n, 3000, 1, block=5), np.zeros_like(gamma)
    for path in drawn:
        found[np.arange(r.n)[:, None], np.arange(23)[None], path[:, :, 0], path[:, :, 1]] += 1 / 3000
    assert np.abs(found - gamma).max() < 0.04
    stays = (drawn[:, :, 1:] == drawn[:, :, :-1]).mean()
    assert stays > (found.sum(axis=3)[:, 1:] * found.sum(axis=3)[:, :-1]).sum(axis=2).mean()  # paths, not grids one by one


def test_haploid_paths_are_drawn_from_their_posterior():
    m, r, _ = _random_reads(np.random.default_rng(5), t=8, n=3, reads=20)
    own, logs = hmm.Grids(r), np.log(hmm.read_likelihoods(r, m))
    emit = lambda lo, hi: own.emissions(logs, lo, hi)
    gamma, switches = hmm.haploid(emit(0, 8), m)
    drawn = hmm.sampled_paths(emit, m, r.n, 4000, 1, block=3, pairs=False)
    assert drawn.shape == (4000, 3, 8, 1)
    found = np.stack([(drawn[..., 0] == k).mean(axis=0) for k in range(m.k)], axis=2)
    assert np.abs(found - gamma).max() < 0.04


@pytest.mark.parametrize("size", [1, 3, 10, 100])
def test_output_blocks_equal_the_rule(spark, size):
    rng = np.random.default_rng(size)
    grid = np.cumsum(rng.random(60) < 0.4)
    s = make(spark, [("1", i, int(g)) for i, g in enumerate(grid)], "chr string, snp long, grid long")
    got = sites.output_blocks(s, size).orderBy("block").collect()
    begins = [0]
    for i in range(1, 59):  # the last site begins no block
        at = begins[-1]
        held = i - at + (at == 0)  # the first block counts its first site
        if held > size and grid[i] != grid[i - 1] and grid[i] >= grid[at] + 2:
            begins.append(i)
    if len(begins) > 1 and grid[begins[-1]] == grid[-1]:
        begins.pop()
    assert [r.snp_start for r in got] == begins and [r.snp_end for r in got] == [*(b - 1 for b in begins[1:]), 59]
    assert [(r.grid_start, r.grid_end) for r in got] == [(grid[r.snp_start], grid[r.snp_end]) for r in got]


def test_depth_is_capped_by_whole_reads(spark):
    from genolith.operators import reads

    rows = [(1, 1, [5, 5, 7]), (1, 2, [5]), (1, 3, [5, 6]), (1, 4, [6]), (1, 5, [5]), (2, 1, [5])]
    r = make(spark, rows, "sample int, read int, snp array<int>")
    got = {(x.sample, x.read) for x in reads.cap_depth_greedy(r, 3).collect()}
    assert (1, 1) not in got and {(1, 2), (1, 3), (1, 4), (1, 5), (2, 1)} <= got  # the read that covers a site twice goes, and is enough
    depth = {}
    for s, read in {(x.sample, x.read) for x in reads.cap_depth_greedy(r, 1).collect()}:
        for snp in next(z for a, b, z in rows if (a, b) == (s, read)):
            depth[s, snp] = depth.get((s, snp), 0) + 1
    assert max(depth.values()) <= 1


@pytest.mark.parametrize("seed", range(4))
def test_depth_cap_equals_the_rule(spark, seed):
    """Site by site: what is left of the reads there, twice-covering ones first, then by rank."""
    rng = np.random.default_rng(seed)
    rows = [(s, r, sorted(int(x) for x in rng.integers(0, 4, int(rng.integers(0, 5))) + 5 * rng.integers(0, 6))) for s in range(3) for r in range(50)]
    df = make(spark, rows, "sample long, read long, snp array<long>")
    rank = {(s, r): hashlib.md5(f"{seed}:{s}:{r}".encode()).hexdigest()[:8] for s, r, _ in rows}
    for most in (1, 3, 4.5):
        want = set()
        for s in range(3):
            left = {r: snp for a, r, snp in rows if a == s}
            for site in range(40):
                depth = sum(x.count(site) for x in left.values())
                if depth > most:
                    doubled = [r for r, x in left.items() if x.count(site) > 1]
                    for r in doubled:
                        del left[r]
                    for r in sorted((r for r, x in left.items() if site in x), key=lambda r: rank[s, r], reverse=True):
                        if sum(x.count(site) for x in left.values()) > most:
                            del left[r]
            want |= {(s, r) for r in left}
        assert {(x.sample, x.read) for x in reads.cap_depth_greedy(df, most, seed).collect()} == want


def test_panel_parts_give_the_panel_back(spark, monkeypatch):
    rng = np.random.default_rng(0)
    alleles = (rng.random((40, 70)) < np.where(np.arange(70) % 3, 0.4, 0.05)).astype(int)
    panel = make(spark, [(h, s, int(alleles[h, s])) for h in range(40) for s in range(70)], "hap int, snp int, allele int")
    monkeypatch.setattr(bits, "RANGE", 16)
    counts = bits.site_counts(panel, 0.2)
    common, rare = bits.split_panel(panel, counts)
    kinds = alleles.mean(axis=0) >= 0.2
    assert [r.common for r in counts.orderBy("snp").collect()] == list(kinds) and [r.i for r in counts.filter("common").orderBy("snp").collect()] == list(range(kinds.sum()))
    back = {(r.hap, r.snp): r.allele for r in bits.joined_panel(common, rare, counts, panel.select("hap").distinct()).filter(F.col("snp") < 70).collect()}
    assert back == {(h, s): alleles[h, s] for h in range(40) for s in range(70)}


def test_dictionary_of_symbols(spark):
    rng = np.random.default_rng(1)
    kinds = rng.integers(-(2**31), 2**31, (3, 60))
    rows = [(h, b, int(kinds[b, min(59, rng.geometric(0.08))])) for h in range(500) for b in range(3)]
    packed = make(spark, rows, "hap int, block int, bits int")
    numbered = bits.symbols(packed)
    words = {b: sorted({w % 2**32 for _, x, w in rows if x == b}) for b in range(3)}
    assert {(r.block, r.bits % 2**32): r.code for r in numbered.collect()} == {(b, w): i + 1 for b in range(3) for i, w in enumerate(words[b])}
    size = bits.dictionary_size(numbered, 500)
    held = lambda n: sum(w % 2**32 in words[b][:n] for _, b, w in rows) / len(rows)
    assert held(size) > 0.99 >= held(size - 1) and bits.dictionary_size(numbered, 500, most=20) == 20 and bits.dictionary_size(numbered.filter("code = 1"), 500) == 15
    codes = bits.encoded(packed, numbered, 20)
    assert codes.filter("code = 0").count() == sum(w % 2**32 not in words[b][:20] for _, b, w in rows) > 0
    assert sorted(map(tuple, bits.decoded(codes, numbered).collect())) == sorted(rows)
    table = {(r.block, r.code): r.n for r in bits.symbol_counts(numbered, 20).collect()}
    assert all(sum(n for (x, _), n in table.items() if x == b) == 500 and (b, 21) in table for b in range(3))


def test_samples_without_reads_are_imputed(spark):
    from genolith.plans import em

    obs, s, _ = simulated(spark, n=6)
    every = spark.range(8).withColumnRenamed("id", "sample")
    post = em.impute(obs, s, Config(K=2, nGen=10, niterations=3, refillIterations=(), shuffleHaplotypeIterations=()), every).toPandas()
    assert len(post) == 8 * 30 and np.allclose(post[["g0", "g1", "g2"]].sum(axis=1), 1)


def test_recombined_reads_are_split(spark):
    from genolith.operators import splitting
    from genolith.plans import em

    # Founders 0 and 1 carry opposite alleles; read 50 begins as founder 0 and goes on as founder 1 after its third site.
    p = np.array([np.arange(24) % 2, 1 - np.arange(24) % 2])
    rows = [(0, r, r + i, 30 if p[0, r + i] else -30) for r in range(8) for i in range(3)] + [(0, 100 + r, r + i, 30 if p[1, r + i] else -30) for r in range(13, 21) for i in range(3)]
    rows += [(0, 50, s, 30 if p[int(s > 11), s] else -30) for s in range(9, 15)]
    obs = make(spark, rows, "sample long, read long, snp long, bq int")
    founders = make(spark, [(k, i, 0.95 if p[k, i] else 0.05) for k in range(2) for i in range(24)], "k int, snp long, p double")
    centred = make(spark, [(0, r, r + 1, r + 1) for r in range(8)] + [(0, 50, 11, 11)] + [(0, 100 + r, r + 1, r + 1) for r in range(13, 21)], "sample long, read long, central long, grid long")
    posteriors = make(spark, [(0, g, [float(g < 12), float(g >= 12)]) for g in range(24)], "sample long, grid long, gamma array<double>")
    places = splitting.split_places(obs, founders, centred, posteriors).collect()
    assert [(r.read, r.left) for r in places] == [(50, 3)]
    split = splitting.split_reads(obs, make(spark, places, "sample long, read long, left long")).collect()
    assert sorted(r.snp for r in split if r.read == 50) == [9, 10, 11] and len({r.read for r in split}) == 18 and len(split) == len(rows)
    s = make(spark, [(i, "1", 100 * i + 1, "A", "G") for i in range(24)], "snp long, chr string, pos long, ref string, alt string")
    config = Config(K=2, nGen=10, niterations=3, refillIterations=(), shuffleHaplotypeIterations=(), splitReadIterations=(1, 2))
    assert em.impute(obs, s, config).count() == 24


def test_founders_and_maps_start_a_fit(spark):
    from genolith.plans import em

    obs, s, truth = simulated(spark)
    p = np.array([np.arange(30) % 2, (np.arange(30) // 2) % 2])
    founders = make(spark, [(k, i, float(p[k, i])) for k in range(2) for i in range(30)], "k int, snp long, p double")
    gmap = make(spark, [("1", 1, 0.0), ("1", 3000, 0.001)], "chr string, position long, cm double")
    post = em.impute(obs, s, Config(K=2, nGen=10, niterations=1, refillIterations=(), shuffleHaplotypeIterations=()), None, gmap, founders).toPandas().sort_values(["sample", "snp"])
    ds = (post["g1"] + 2 * post["g2"]).to_numpy().reshape(truth.shape)
    assert np.corrcoef(ds.ravel(), truth.ravel())[0, 1] ** 2 > 0.95  # known founders need no iterations


def simulated(spark, seed=3, n=30, k=2, t=30, depth=4):
    """Reads of samples that are pairs of two founders all along, and the truth."""
    rng = np.random.default_rng(seed)
    founders = np.array([np.arange(t) % 2, (np.arange(t) // 2) % 2])
    pairs = rng.integers(0, k, (n, 2))
    obs, truth = [], []
    for s in range(n):
        truth.append(founders[pairs[s]].sum(axis=0))
        for r in range(depth * t // 6):
            start = int(rng.integers(0, t - 5))
            hap = founders[pairs[s][rng.integers(0, 2)]]
            obs += [(s, s * 10000 + r, i, 25 if hap[i] else -25) for i in range(start, start + 6)]
    s = make(spark, [(i, "1", 100 * i + 1, "A", "G") for i in range(t)], "snp long, chr string, pos long, ref string, alt string")
    return make(spark, obs, "sample long, read long, snp long, bq int"), s, np.array(truth)


@pytest.mark.parametrize("method", ["diploid", "pseudoHaploid"])
def test_imputation_finds_the_truth(spark, method):
    from genolith.plans import em

    obs, s, truth = simulated(spark)
    post = em.impute(obs, s, Config(K=2, nGen=10, method=method, niterations=22, refillIterations=(), shuffle_bin_radius=400, seed=1)).toPandas().sort_values(["sample", "snp"])
    gp = post[["g0", "g1", "g2"]].to_numpy()
    assert np.allclose(gp.sum(axis=1), 1, atol=1e-6)
    ds = (gp[:, 1] + 2 * gp[:, 2]).reshape(truth.shape)
    assert np.corrcoef(ds.ravel(), truth.ravel())[0, 1] ** 2 > 0.95


def test_inbred_has_no_heterozygotes(spark):
    from genolith.plans import em

    obs, s, _ = simulated(spark, n=8)
    post = em.impute(obs, s, Config(K=2, nGen=10, method="diploid-inbred", niterations=3, refillIterations=())).toPandas()
    assert (post["g1"] == 0).all()


@pytest.mark.parametrize("bad", [{"K": 0}, {"method": "x"}, {"regionStart": 5}, {"downsampleSamples": 0.0}, {"do_phasing": True, "S": 2}, {"niterations": 10, "refillIterations": (6,)}, {"niterations": 20}, {"gridWindowSize": 1}])
def test_config_rules(bad):
    with pytest.raises(ValueError):
        Config(**({"K": 4, "nGen": 100} | bad)).check()
    assert Config(K=4, nGen=100).check()


def test_reordering_undoes_a_swap():
    rng = np.random.default_rng(0)
    p = rng.uniform(0.1, 0.9, (3, 10))
    order = np.array([2, 0, 1])
    swapped = p.copy()
    swapped[:, 5:] = p[np.argsort(order)][:, 5:]
    m = hmm.Model(swapped, np.full((3, 9), 1 / 3), np.full(9, 0.9), np.full(3, 1 / 3))
    counts = np.zeros((1, 3, 3))
    counts[0, np.arange(3), [list(np.argsort(order)).index(k) for k in range(3)]] = 5
    assert np.allclose(hmm.reorder(m, [(5, 4, 5, 5)], counts, np.arange(10)).p, p)  # blends nothing
    assert list(hmm.best_order(np.eye(4))) == [0, 1, 2, 3]


def test_adaptive_grid(spark):
    s = make(spark, [("1", i, 10 * i, 0.3 * i) for i in range(10)], "chr string, snp long, pos long, cm double")
    assert [r.grid for r in sites.adaptive_grid(s, 1.0).orderBy("snp").collect()] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]


def test_double_switches(spark):
    rows = [(1, i, int(t), 1 - int(t), int(h)) for i, (h, t) in enumerate(zip("00010000", "00000000"))]
    r = evaluate.phase_switches_without_doubles(make(spark, rows, "sample int, pos int, t1 int, t2 int, h1 int")).first()
    assert (r.sites, r.switches, r.discordant) == (8, 0, 1)


def test_founders_are_of_different_kinds(spark):
    from genolith.operators import panel

    kinds = np.random.default_rng(0).integers(0, 2, (3, 40))
    rows = [(h, s, int(kinds[h % 3, s])) for h in range(30) for s in range(40)]
    got = panel.choose_founders(make(spark, rows, "hap int, snp int, allele int"), 3).collect()
    assert sorted(r.hap % 3 for r in got) == [0, 1, 2]
    assert panel.choose_founders(make(spark, rows[:80], "hap int, snp int, allele int"), 3).count() == 2


def test_blending_around_breaks():
    rng = np.random.default_rng(0)
    grid_of = np.repeat(np.arange(8), 3)
    m = hmm.Model(rng.uniform(0.1, 0.9, (3, 24)), rng.uniform(0.2, 0.5, (3, 7)), np.full(7, 0.9), np.full(3, 1 / 3))
    swap = np.array([[0, 1, 0], [1, 0, 0], [0, 0, 1.0]])
    got = hmm.reorder(m, [(1, 3, 4, 6)], swap[None], grid_of)
    moved = m.p.copy()
    moved[:2, grid_of > 3] = m.p[1::-1, grid_of > 3]
    keep, own = np.abs(1 - np.linspace(0, 2, 15)), (grid_of >= 1) & (grid_of < 6)
    assert np.array_equal(got.p[:, ~own], moved[:, ~own]) and np.allclose(got.p[:, own][:, [0, -1]], moved[:, own][:, [0, -1]])
    drawn = (got.p[:, own] - keep * moved[:, own])[:, 1:-1] / (1 - keep[1:-1])
    assert (drawn > 0).all() and (drawn < 1).all() and drawn.std() > 0.2
    assert np.allclose(got.switch[:, 1:6], 1 / 3) and np.array_equal(got.switch[:, 0], m.switch[:, 0]) and np.array_equal(got.switch[:, 6], m.switch[[1, 0, 2], 6])
    same = hmm.reorder(m, [(1, 3, 4, 6)], np.eye(3)[None], grid_of)
    assert np.array_equal(same.p, m.p) and np.array_equal(same.switch, m.switch)


def brute_breaks(rate, at, radius, fewest, most):
    """The rule of ``hmm.breaks``, with sets and distances step by step."""
    steps = len(rate)
    free = set(range(1, steps - 1))
    shown = [rate[i] for i in free if rate[i] != 0]
    threshold = min(1.0, float(np.median(shown))) if shown else 1.0
    high = {i for i in free if rate[i] > threshold}
    found = []
    for i in sorted(free, key=lambda i: (-rate[i], i)) if len(free) > 3 and len(at) >= 5 else []:
        if i not in free:
            continue
        if {i - 1, i + 1} <= free:
            ends = []
            for way in (-1, 1):
                walked, j = [i], i
                while True:
                    j += way
                    walked.append(j)
                    lowest = min(rate[x] for x in walked)
                    earlier = rate[walked[-6]] if len(walked) > 5 else rate[i]
                    if j <= 1 or j >= steps - 3 or j + way not in free or rate[j] > 3 * lowest or (rate[j] < threshold and earlier < rate[j]):
                        break
                ends.append(next(x for x in walked if rate[x] == lowest))
            found.append((ends[0], i, i + 1, ends[1]))
            middle = (at[i] + at[i + 1]) / 2
            near = [j for j in range(i + 1) if middle - at[j] < 2 * radius] + [j for j in range(i, steps) if at[j + 1] - middle < 2 * radius]
            lo = min([ends[0], *(near or [i + 1])])
            hi = max([ends[1], *(near or [i - 1])])
            free -= set(range(min(lo + 1, i), max(i, hi - 1) + 1))
            high -= set(range(lo, hi + 1))
        else:
            free -= {i - 1, i, i + 1}
        if not free or len(found) == most or (not high and len(found) >= fewest):
            break
    return sorted(found, key=lambda x: x[1])


@pytest.mark.parametrize("seed", range(12))
def test_breaks_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(4, 160))
    at = np.cumsum(rng.integers(1, 4000, n)).astype(float)
    rate = np.convolve(rng.exponential(0.3, n + 8), np.ones(1 + seed % 6) / (1 + seed % 6), "same")[: n - 1] * (rng.random(n - 1) < 0.95)
    for fewest, most in ((10, 1000), (1, 1000), (3, 4)):
        assert hmm.breaks(rate, at, 1500.0 + 500 * seed, fewest, most) == brute_breaks(rate, at, 1500.0 + 500 * seed, fewest, most)


def test_smoothed_rates_are_means():
    at = np.array([1.0, 4, 5, 9, 20])
    rate = np.array([2.0, 0, 1, 3])
    fine = np.concatenate([np.repeat(rate, np.diff(at).astype(int) * 10)])
    for i, got in enumerate(hmm.smoothed_rates(rate, at, 3.0)):
        lo, hi = max((at[i] + at[i + 1]) / 2 - 3, 1), min((at[i] + at[i + 1]) / 2 + 3, 20)
        assert abs(got - fine[round((lo - 1) * 10) : round((hi - 1) * 10)].mean()) < 1e-9


def test_refill_equals_the_rule(spark):
    from genolith.plans import em

    rng = np.random.default_rng(4)
    k, grids, n = 5, 60, 200
    usage = np.full((k, grids), 40.0)
    usage[1, 10:30], usage[1, 50:55], usage[3, :] = 0.5, 0, 0.01
    middle = np.cumsum(rng.integers(500, 3000, grids)).astype(float)
    bins = (middle // 5000).astype(int)
    kinds = sorted(set(bins))
    mean = np.array([[usage[f, bins == b].mean() for b in kinds] for f in range(k)])
    weak = mean < n * min(1 / (10 * k), 1 / 100)
    wanted = []
    for f in range(k):
        i = 0
        while i < len(kinds):
            j = i
            while j < len(kinds) and weak[f, j]:
                j += 1
            if j > i:
                wanted.append((f, int(np.flatnonzero(bins == kinds[i])[0]), int(np.flatnonzero(bins == kinds[j - 1])[-1])))
            i = max(j, i + 1)
    got = em.refills(spark, usage, middle, n, 3)
    assert sorted(x[:3] for x in got) == sorted(wanted) and len(wanted) >= 3 and all(x[3] != x[0] for x in got)
    assert got == em.refills(spark, usage, middle, n, 3)
    p, grid_of = rng.uniform(0.1, 0.9, (k, 2 * grids)), np.repeat(np.arange(grids), 2)
    m = hmm.refill(hmm.Model(p, np.full((k, grids - 1), 1 / k), np.full(grids - 1, 0.9), np.full(k, 1 / k)), got, grid_of)
    for f in range(k):
        for g in range(grids):
            donor = next((x[3] for x in got if x[0] == f and x[1] <= g <= x[2]), f)
            assert np.array_equal(m.p[f, 2 * g : 2 * g + 2], p[donor, 2 * g : 2 * g + 2])
    drawn = [em.refills(spark, usage, middle, n, s)[0][3] for s in range(12)]
    assert len(set(drawn)) > 1 and em.refills(spark, np.zeros((2, 8)), np.arange(8) * 1e4, 10, 0) == []


def test_usage_sums_to_the_samples(spark):
    from genolith.plans import em

    obs, s, _ = simulated(spark, n=6)
    samples, layout = em.grouped_reads(obs, s, 500)
    grid_of = layout["grid"].to_numpy()
    m = hmm.Model(np.random.default_rng(0).uniform(0.1, 0.9, (3, 30)), np.full((3, grid_of.max()), 1 / 3), np.full(grid_of.max(), 0.9), np.full(3, 1 / 3))
    for method in hmm.KERNELS:
        assert np.allclose(em.expect(samples, m, grid_of, method).usage.sum(axis=0), 6)


@pytest.mark.parametrize("method", ["diploid", "diploid-inbred", "pseudoHaploid"])
@pytest.mark.parametrize("size", [4, 9, 100])
def test_blocks_give_what_the_whole_gives(spark, method, size):
    from dataclasses import replace

    from genolith.plans import blocks, em

    obs, s, _ = simulated(spark, n=9)
    config = Config(K=3, nGen=10, S=2, method=method, niterations=1, refillIterations=(), shuffleHaplotypeIterations=(), gridWindowSize=200, outputSNPBlockSize=size).check()
    every = make(spark, [(i,) for i in range(11)], "sample long")
    own = em.Inputs(obs, s, config, every)
    fits, grid_of = own.fits(config, None), own.layout["grid"].to_numpy()
    rows = own.samples.toArrow().combine_chunks().to_batches()[0]
    want = sum(hmm.KERNELS[m](em._batch(rows), x, grid_of) for x, m in fits) / 2
    got = em.impute(obs, s, config, every).toPandas().sort_values(["sample", "snp"])
    order = np.argsort(rows.column("sample").to_numpy())
    assert len(got) == 11 * 30 and np.allclose(got[["g0", "g1", "g2"]].to_numpy().reshape(11, 30, 3), want[order], atol=1e-9)
    begins = blocks.block_grids(own.layout, size)
    assert (len(begins) > 2) == (size < 10) and begins[0] == 0
    assert replace(config, outputSNPBlockSize=1).check()


def test_phase_by_blocks_is_that_of_whole_paths():
    m, r, grid_of = _random_reads(np.random.default_rng(7))
    e, grids = hmm.read_likelihoods(r, m), hmm.Grids(r)
    logs = np.log((e[:, :, None] + e[:, None, :]) / 2)
    drawn = hmm.sampled_paths(lambda lo, hi: grids.emissions(logs, lo, hi), m, r.n, 20, 3, block=5)
    want = np.zeros((r.n, len(grid_of), 2))
    for pair in drawn:
        turn = (pair[:, :, ::-1] == drawn[0]).sum(axis=(1, 2)) > (pair == drawn[0]).sum(axis=(1, 2))
        pair = np.where(turn[:, None, None], pair[:, :, ::-1], pair)
        for h in (0, 1):
            want[:, :, h] += m.p[pair[:, grid_of, h], np.arange(len(grid_of))] / 20
    got = list(hmm.sampled_phase(r, m, grid_of, 20, 3, block=5))
    assert len(got) == 5 and all(np.allclose(x, want[:, own]) for own, x in got)


def test_borders_hold_a_block_at_a_time():
    """Many more grids take hardly more memory: emissions of a block, and the states at one border."""
    import tracemalloc

    peaks = []
    for grids in (2_000, 20_000):
        rng = np.random.default_rng(0)
        m = hmm.Model(np.full((6, 1), 0.5), np.full((6, grids - 1), 1 / 6), np.full(grids - 1, 0.99), np.full(6, 1 / 6))
        at = np.sort(rng.integers(0, grids, 400))
        none = np.zeros(0, int)
        own = hmm.Grids(hmm.Reads(8, rng.integers(0, 8, 400), at, none, none, none))
        logs = np.log(rng.uniform(0.01, 1, (400, 6, 6)))
        tracemalloc.start()
        n = sum(1 for _ in hmm.borders(lambda lo, hi: own.emissions(logs, lo, hi), m, True, 8, list(range(0, grids, 500))))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert n == 2 * grids // 500
    assert peaks[1] < 1.1 * peaks[0]


def test_starts_from_a_panel(spark):
    from genolith.plans import em

    rng = np.random.default_rng(0)
    kinds = rng.integers(0, 2, (3, 40))
    s = make(spark, [(i, "1", 1000 * i + 1, "A", "G") for i in range(50)], "snp long, chr string, pos long, ref string, alt string")
    layout = em.site_layout(s, None)
    config = Config(K=3, nGen=10, S=2, reference_iterations=12, reference_shuffleHaplotypeIterations=(3,)).check()
    of = lambda haps: make(spark, [(h, i, int(kinds[h % 3, i])) for h in range(haps) for i in range(40)], "hap int, snp long, allele int")
    fewer, same, more = (em.panel_starts(of(n), layout, config) for n in (2, 3, 30))
    e = config.emissionThreshold
    assert all(np.array_equal(x[:2, :40], np.clip(kinds[:2], e, 1 - e)) and x[2].std() > 0.2 and (x > 0).all() for x in fewer)
    assert all(np.array_equal(x[:, :40], np.clip(kinds, e, 1 - e)) and x[:, 40:].std() > 0.2 for x in same) and not np.array_equal(same[0], same[1])
    for x in more:
        assert x.shape == (3, 50) and (abs(x[:, 40:] - 0.5) <= 0.1).all()
        assert sorted(np.abs(x[:, None, :40] - kinds[None]).mean(axis=2).argmin(axis=1)) == [0, 1, 2] and np.abs(x[:, None, :40] - kinds[None]).mean(axis=2).min(axis=1).max() < 0.06
    plain = em.panel_starts(of(30), layout, Config(K=3, nGen=10, reference_iterations=0, reference_shuffleHaplotypeIterations=()))[0]
    assert (np.minimum(plain[:, :40], 1 - plain[:, :40]) <= 0.05).all()


def test_pseudo_haploid_equals_the_rule():
    """Reads one by one: shares, mixtures, posteriors by sums over all paths, and the counts of the last round."""
    rng = np.random.default_rng(3)
    k, t = 2, 4
    switch = rng.uniform(0.2, 1, (k, t - 1))
    m = hmm.Model(rng.uniform(0.1, 0.9, (k, t)), switch / switch.sum(axis=0), rng.uniform(0.5, 0.9, t - 1), np.full(k, 1 / k))
    sites, bq = rng.integers(0, t, 9), rng.choice([-20.0, 25.0], 9)
    r = hmm.Reads(1, np.zeros(9, int), sites, np.arange(9), sites, bq)
    grid_of = np.arange(t)
    eps = 10 ** (-np.abs(bq) / 10)
    pa, pr = np.where(bq > 0, 1 - eps, eps / 3), np.where(bq < 0, 1 - eps, eps / 3)
    e = np.array([[m.p[f, s] * a + (1 - m.p[f, s]) * b for f in range(k)] for s, a, b in zip(sites, pa, pr)])
    e /= e.max(axis=1, keepdims=True)

    def gamma(like):
        out, total = np.zeros((t, k)), 0.0
        for path in itertools.product(range(k), repeat=t):
            w = m.prior[path[0]] * np.prod([like[i, path[s]] for i, s in enumerate(sites)])
            for g in range(t - 1):
                w *= m.stay[g] * (path[g] == path[g + 1]) + (1 - m.stay[g]) * m.switch[path[g + 1], g]
            total += w
            for g in range(t):
                out[g, path[g]] += w
        return out / total

    p = [hmm._first_shares(r, h, 0) for h in (0, 1)]
    assert all((0.2 <= x).all() and (x <= 0.8).all() for x in p) and not np.allclose(*p)
    alt, total = np.zeros((k, t)), np.zeros((k, t))
    for last in (False, False, True):
        new = [np.zeros(9), np.zeros(9)]
        for h in (0, 1):
            share = [p[h][i] / (p[0][i] + p[1][i]) for i in range(9)]
            mixed = np.array([[share[i] * e[i, f] + (1 - share[i]) * p[1 - h][i] for f in range(k)] for i in range(9)])
            own = gamma(mixed)
            if last:
                for i, s in enumerate(sites):
                    for f in range(k):
                        w, q = own[s, f] * share[i] * e[i, f] / mixed[i, f], m.p[f, s]
                        alt[f, s] += w * q * pa[i] / (q * pa[i] + (1 - q) * pr[i])
                        total[f, s] += w
            new[h] = np.clip([sum(own[s, f] * (mixed[i, f] - (1 - share[i]) * p[1 - h][i]) / share[i] for f in range(k)) for i, s in enumerate(sites)], 1e-3, 1 - 1e-3)
        if last:
            doses = [gamma(np.array([[(p[h][i] * e[i, f] + p[1 - h][i] * p[1 - h][i]) / (p[0][i] + p[1][i]) for f in range(k)] for i in range(9)])) for h in (0, 1)]
            a, b = ((x * m.p.T).sum(axis=1) for x in doses)
            want = np.stack([(1 - a) * (1 - b), a * (1 - b) + b * (1 - a), a * b], axis=1)
        p = new
    sums = hmm.Sums.zero(m)
    hmm.run_pseudo_haploid(r, m, grid_of, sums)
    assert np.allclose(sums.alt, alt) and np.allclose(sums.total, total)
    assert np.allclose(hmm.run_pseudo_haploid(r, m, grid_of)[0], want)


def test_chains_and_picks_of_many_groups(spark):
    from genolith.operators import chains

    rng = np.random.default_rng(2)
    values = {c: np.cumsum(rng.integers(0, 3, n)) for c, n in (("a", 80), ("b", 1), ("c", 33))}
    rows = make(spark, [(c, i, float(v)) for c, own in values.items() for i, v in enumerate(own)], "chr string, i long, v double")
    for strictly in (False, True):
        nexts = chains.next_above(rows, "v", F.col("v") + 4, "i", strictly=strictly)
        first = lambda own, i: next((j for j, v in enumerate(own) if (v > own[i] + 4 if strictly else v >= own[i] + 4)), None)  # noqa: E731,B023
        assert {(r.chr, r.node): r.next for r in nexts.collect()} == {(c, i): first(own, i) for c, own in values.items() for i in range(len(own))}
        want = set()
        for c, own in values.items():
            i = 0
            while i is not None:
                want.add((c, i))
                i = first(own, i)
        assert {(r.chr, r.node) for r in chains.reached(nexts, rows.filter("i = 0").select("chr", F.col("i").alias("node"))).collect()} == want
    heights = {c: rng.integers(0, 6, len(own)) for c, own in values.items()}
    items = make(spark, [(c, int(v), float(h)) for c, own in values.items() for v, h in dict(zip(own.tolist(), heights[c])).items()], "chr string, at long, h double")
    want = set()
    for c, own in values.items():
        kept = []
        for at, h in sorted(dict(zip(own.tolist(), heights[c])).items(), key=lambda x: (-x[1], x[0])):
            if all(abs(at - k) > 3 for k in kept):
                kept.append(at)
        want |= {(c, k) for k in kept}
    assert {(r.chr, r.at) for r in chains.picked(items, "at", "h", 3).collect()} == want
    assert chains.picked(items.limit(0), "at", "h", 3).count() == 0 and chains.reached(nexts.limit(0), rows.limit(0).select("chr", F.col("i").alias("node"))).count() == 0


@pytest.mark.parametrize("method", list(hmm.KERNELS))
def test_founder_shares_are_marginals(method):
    m, r, grid_of = _random_reads(np.random.default_rng(9))
    got = list(hmm.founder_shares(r, m, grid_of, method, block=5))
    whole = np.concatenate([x for _, x in got[::-1]], axis=1)
    assert len(got) == 5 and np.allclose(whole.sum(axis=2), 2)
    if method != "pseudoHaploid":
        assert np.allclose(whole, 2 * hmm.marginals(r, m, method, list(range(23))) if method == "diploid-inbred" else whole)
    if method == "diploid":
        e, own = hmm.read_likelihoods(r, m), hmm.Grids(r)
        gamma, _ = hmm.diploid(own.emissions(np.log((e[:, :, None] + e[:, None, :]) / 2), 0, 23), m)
        assert np.allclose(whole, gamma.sum(axis=3) + gamma.sum(axis=2))


def scattered(seed, k, grids=60, n=7, reads=25):
    """A model whose steps all differ, the grids of its sites, and reads in few grids of each sample; the last sample has none."""
    rng = np.random.default_rng(seed)
    grid_of = np.sort(np.concatenate([np.arange(grids), rng.integers(0, grids, grids)]))
    m = hmm.Model(rng.uniform(0.01, 0.99, (k, len(grid_of))), rng.dirichlet(np.ones(k), grids - 1).T, np.exp(-(10.0 ** rng.uniform(-4, 0.5, grids - 1))), rng.dirichlet(np.ones(k)))
    site, sample = rng.integers(0, len(grid_of), reads), np.sort(rng.integers(0, n - 1, reads))
    return m, grid_of, hmm.Reads(n, sample, grid_of[site], np.arange(reads), site, rng.choice([-1, 1], reads) * rng.integers(10, 40, reads).astype(float))


@pytest.mark.parametrize("method", list(hmm.COUNTS))
@pytest.mark.parametrize("k", [1, 2, 4])
def test_counts_over_reads_are_those_over_all_grids(monkeypatch, method, k):
    m, grid_of, r = scattered(k, k)
    pairs, e = method == "diploid", hmm.read_likelihoods(r, m)
    likelihoods = [hmm.track_logs(e, method)]
    if method == "pseudoHaploid":  # the two passes of the last round, each for half a sample
        likelihoods = [np.log(x) for x in hmm._refined(r, m, e, 3, 0)]
    usage, switches = 0, 0
    for logs in likelihoods:
        gamma, own = (hmm.diploid if pairs else hmm.haploid)(hmm.Grids(r).emissions(logs, 0, len(m.stay) + 1), m)
        usage = usage + (gamma.sum(axis=3) if pairs else gamma).sum(axis=0).T / len(likelihoods)
        switches = switches + own
    monkeypatch.setattr(hmm, "walk", None)  # no visit to each grid
    sums = hmm.Sums.zero(m)
    hmm.KERNELS[method](r, m, grid_of, sums)
    assert np.allclose(sums.usage, usage, atol=1e-11) and np.allclose(sums.switch, switches, atol=1e-11) and np.allclose(sums.prior, usage[:, 0], atol=1e-11)
    in_parts, runs = hmm.Sums.zero(m), hmm.Runs(m)
    for s in range(r.n):
        own = r.sample == s
        hmm.KERNELS[method](hmm.Reads(1, np.zeros(own.sum(), int), r.grid[own], np.arange(own.sum()), r.site[own], r.bq[own]), m, grid_of, in_parts, runs)
    runs.into(in_parts, m, *hmm.COUNTS[method])
    assert all(np.allclose(getattr(in_parts, x), getattr(sums, x), atol=1e-11) for x in ("alt", "total", "switch", "prior", "usage"))


@pytest.mark.parametrize("pairs", [False, True])
@pytest.mark.parametrize("k", [1, 2, 4])
def test_posteriors_along_runs_are_those_of_a_walk(k, pairs):
    m, _, r = scattered(k, k)
    logs, grids = hmm.track_logs(hmm.read_likelihoods(r, m), "diploid" if pairs else "diploid-inbred"), len(m.stay) + 1
    wanted, _ = (hmm.diploid if pairs else hmm.haploid)(hmm.Grids(r).emissions(logs, 0, grids), m)
    c = hmm.Cells(r, grids)
    met = hmm.over_cells(c, c.emissions(logs), m)
    for together in (1, 7, 1 << 15):  # runs are cut into single grids, into pieces, or not at all
        found, runs = np.full(wanted.shape, np.nan), 0
        for sample, lo, n, x in hmm.along(c, met, m, together):
            at, g = np.repeat(sample, n), np.concatenate([np.arange(a, a + b) for a, b in zip(lo, n)])
            assert np.isnan(found[at, g]).all()
            found[at, g], runs = x, runs + len(n)
        assert np.allclose(found, wanted, rtol=0, atol=1e-12)
    assert runs <= len(c.grid) + r.n < wanted.shape[0] * wanted.shape[1] / 2


@pytest.mark.parametrize("pairs", [False, True])
def test_posteriors_travel_by_runs_of_grids(spark, sf_dir, pairs):
    from genolith.plans import adapter, em

    samples, layout = em.grouped_reads(adapter.observations(spark, sf_dir), adapter.sites(spark, sf_dir), 500)
    m = scattered(0, 2, grids=int(layout["grid"].max()) + 1)[0]
    m = hmm.Model(np.resize(m.p, (2, len(layout))), m.switch, m.stay, m.prior)
    runs = em._posterior_runs(samples, m, pairs)
    assert runs.count() <= samples.count() + samples.select(F.explode(F.array_distinct("grid"))).count() < samples.count() * (len(m.stay) + 1) / 2
    every = {(r.sample, r.grid): r.gamma for r in em.founder_posteriors(samples, m, pairs).collect()}
    rows = em.founder_posteriors_by_state(samples, m, pairs).collect()
    assert len(rows) == len({(r.sample, r.grid, r.state) for r in rows}) == samples.count() * (len(m.stay) + 1) * (4 if pairs else 2)
    assert all(every[r.sample, r.grid][r.state] == r.gamma for r in rows)


def test_posteriors_at_reads_are_no_more_than_reads(spark, sf_dir):
    from genolith.plans import adapter, em

    samples, layout = em.grouped_reads(adapter.observations(spark, sf_dir), adapter.sites(spark, sf_dir), 500)
    m = scattered(0, 2, grids=int(layout["grid"].max()) + 1)[0]
    m = hmm.Model(np.resize(m.p, (2, len(layout))), m.switch, m.stay, m.prior)
    for pairs in (False, True):
        every = {(r.sample, r.grid): r.gamma for r in em.founder_posteriors(samples, m, pairs).collect()}
        found = {(r.sample, r.grid): r.gamma for r in em.founder_posteriors_at_reads(samples, m, pairs).collect()}
        own = {(r.sample, g) for r in samples.collect() for g in r.grid}
        assert set(found) == own and len(own) < len(every) / 2
        assert all(np.allclose(x, every[at]) for at, x in found.items())


def test_correlations_of_what_does_not_vary_are_null(spark):
    from genolith.operators import evaluate

    rows = [("a", 1.0, 0.5), ("a", 1.0, 0.7), ("b", 0.0, 0.5), ("b", 1.0, 0.5), ("c", 0.0, 0.25), ("c", 1.0, 0.75), ("c", None, 0.1), ("d", 1.0, 1.0)]
    found = evaluate.squared_correlation(spark.createDataFrame(rows, "sample string, g double, ds double"), "sample")
    assert {r.sample: r.r2 for r in found.collect()} == {"a": None, "b": None, "c": 1.0, "d": None}
    counts = spark.createDataFrame([(i, 0.5) for i in range(4)], "snp long, af double")
    panel = spark.createDataFrame([(h, i, (h + i) % 2) for h in range(3) for i in range(4)], "hap int, snp long, allele int")
    assert tuple(evaluate.panel_agreement(counts, panel).first()) == (4, None, None, None)


@pytest.mark.parametrize("p", [0.2328125, 0.23281250000000003, 0.23281249999999998])
def test_halves_of_shares_hold_whatever_the_order_of_their_sum(spark, p):
    from genolith.plans.queries import r6_ratio

    assert spark.createDataFrame([(p,)], "p double").select(r6_ratio("p")).first()[0] == 0.232812


@pytest.mark.parametrize("method", list(hmm.COUNTS))
def test_summaries_are_those_of_the_posteriors(spark, monkeypatch, method):
    from genolith.operators.pileup import site_summary
    from genolith.plans import blocks, em

    obs, s, _ = simulated(spark, n=9, depth=2)
    config = Config(K=3, nGen=10, method=method, niterations=2, S=2, refillIterations=(), shuffleHaplotypeIterations=(), seed=1)
    want = site_summary(em.impute(obs, s, config)).orderBy("snp").toPandas()
    monkeypatch.setattr(blocks, "genotypes", None)  # no posterior travels
    found = em.summaries(obs, s, config).orderBy("snp").toPandas()
    assert list(found.dtypes) == list(want.dtypes) and np.allclose(found[want.columns].astype(float), want.astype(float), atol=1e-9)


def test_phase_means_are_those_of_the_dosages(spark):
    from genolith.plans import em

    obs, s, _ = simulated(spark, n=9, depth=2)
    config = Config(K=3, nGen=10, niterations=2, refillIterations=(), shuffleHaplotypeIterations=(), seed=1)
    want = em.phase(obs, s, config).groupBy("snp").agg({"h0": "avg", "h1": "avg"}).orderBy("snp").toPandas()
    found = em.phase_means(obs, s, config).orderBy("snp").toPandas()
    assert np.allclose(found[["h0", "h1"]], want[["avg(h0)", "avg(h1)"]], atol=1e-12)


def test_slices_by_reads_are_bounded(monkeypatch):
    import pyarrow as pa

    from genolith.plans import em

    monkeypatch.setattr(em, "TOGETHER_BY_READS", 20)
    batch = pa.record_batch({"sample": pa.array(range(7)), "grid": pa.array([[0] * n for n in (3, 0, 2, 30, 1, 4, 1)], pa.list_(pa.int32()))})
    parts = list(em._slices_by_reads(iter([batch]), 4))
    assert [x for p in parts for x in p.column("sample").to_pylist()] == list(range(7))
    assert [p.num_rows for p in parts] == [3, 1, 2, 1] and all(p.num_rows == 1 or sum(map(len, p.column("grid").to_pylist())) * 4 <= 20 for p in parts)


def test_a_panel_is_dealt_over_partitions(spark):
    from genolith.plans import em

    panel = make(spark, [(h, i, (h * 7 + i) % 2) for h in range(40) for i in range(6)], "hap int, snp long, allele int")
    layout = em.site_layout(make(spark, [(i, "1", 100 * i + 1, "A", "G") for i in range(6)], "snp long, chr string, pos long, ref string, alt string"), 200)
    own = em.PanelInputs.of(panel, layout, 20)
    assert own.samples.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    own.samples.unpersist()


def test_reads_are_grouped_in_one_shuffle(spark, monkeypatch):
    from genolith.plans import em

    sites = make(spark, [(9, "1", 100, "A", "G"), (4, "1", 200, "A", "G"), (7, "1", 300, "A", "G"), (1, "1", 1000, "A", "G")], "snp long, chr string, pos long, ref string, alt string")
    rows = [(2, "b", 4, -20), (2, "b", 1, 30), (2, "b", 9, 25), (2, "a", 7, 18), (2, "a", 7, -19), (2, "c", 555, 20), (3, "x", 555, 20), (1, "z", 9, 20), (1, "z", 7, 21), (1, "y", 1, 22)]
    for most in (em.GROUPED, 1):  # samples are kept whole in tables of any size
        monkeypatch.setattr(em, "GROUPED", most)
        samples, layout = em.grouped_reads(make(spark, rows, "sample long, read string, snp long, bq int"), sites, 500)
        assert list(layout["snp"]) == [9, 4, 7, 1] and list(layout["grid"]) == [0, 0, 0, 1]
        found = {r.sample: (r.grid, r.sites, r.site, r.bq) for r in samples.collect()}
        # Read b lies at 100, 200 and 1000: 200 is nearest to the mean. Read z, at 100 and 300, is as near to both.
        assert found == {1: ([0, 1], [2, 1], [0, 2, 3], [20, 21, 22]), 2: ([0, 0], [2, 3], [2, 2, 0, 1, 3], [-19, 18, 25, -20, 30])}
    plan = em.grouped_reads(make(spark, rows, "sample long, read string, snp long, bq int"), sites, 500)[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_an_estep_counts_what_is_wanted(spark, sf_dir):
    from genolith.plans import adapter, em

    samples, layout = em.grouped_reads(adapter.observations(spark, sf_dir), adapter.sites(spark, sf_dir), 5000)
    rng, grids = np.random.default_rng(4), int(layout["grid"].max()) + 1
    m = hmm.Model(rng.uniform(0.1, 0.9, (2, len(layout))), np.full((2, grids - 1), 0.5), np.full(grids - 1, 0.9), np.full(2, 0.5))
    every = em.expect(samples, m, layout["grid"].to_numpy(), "diploid")
    some = em.expect(samples, m, layout["grid"].to_numpy(), "diploid", ("usage", "switch"))
    assert np.allclose(every.usage, some.usage) and np.allclose(every.switch, some.switch)
    assert some.alt.shape == some.total.shape == (2, 0) and not some.prior.any()


def test_next_positions_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(sites, "STRETCH", 100)
    rng = np.random.default_rng(2)
    rows = [(c, int(x)) for c, n in (("1", 40), ("2", 1)) for x in rng.choice(3000, n, replace=False)]
    found = {(r.chr, r.pos): r.end for r in sites.with_next(make(spark, rows, "chr string, pos long"), "end").collect()}
    assert found == {(c, x): min((y for d, y in rows if d == c and y > x), default=None) for c, x in rows}


def test_peaks_of_a_chromosome_are_all_kept(spark):
    steps = spark.range(5000).select(F.lit("1").alias("chr"), (F.col("id") * 100).alias("mid"), F.when(F.col("id") % 4 == 0, 1.0 + F.col("id")).otherwise(0.5).alias("smoothed"))
    found = {r.mid for r in sites.peaks(steps, 50).filter("smoothed > 0.5").collect()}
    assert found == {400 * i for i in range(1250)}


@pytest.mark.parametrize("name", ["depth_cap_greedy", "mstep_founders", "molecule_merge", "haploid_forward_k2", "haploid_posterior_k2", "bx_rescue", "mstep_normalise", "diploid_emission_grid", "read_emission", "read_proportions"])
def test_large_tables_are_dealt_by_their_rows(spark, duck, sf_dir, monkeypatch, name):
    from comparing import rows_of
    from genolith.operators import spread
    from genolith.plans.queries import QUERIES, SQL

    monkeypatch.setattr(spread, "LARGE", 1)
    monkeypatch.setattr(spread, "ROWS", 500)
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert ", 12), REPARTITION_BY_NUM" in plan  # some 6,000 observations
    assert rows_of(df.toPandas()) == rows_of(duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", ["molecule_merge", "haploid_forward_k2", "haploid_posterior_k2", "mstep_founders", "mstep_normalise", "read_emission"])
def test_no_step_of_large_tables_keeps_the_sessions_partitions(spark, sf_dir, monkeypatch, name):
    """Nor is a table of sites broadcast, or joined in another way at another size."""
    from genolith.operators import spread
    from genolith.plans.queries import QUERIES

    monkeypatch.setattr(spread, "LARGE", 1)
    monkeypatch.setattr(spread, "ROWS", 500)
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"hashpartitioning\(.*, (\d+)\)", plan)) == {"12"}
    assert name in ("molecule_merge", "mstep_normalise") or "SortMergeJoin [snp" in plan


@pytest.mark.parametrize("method", list(hmm.KERNELS))
def test_sums_of_genotypes_visit_grids_for_all_samples_together(monkeypatch, method):
    m, r, grid_of = _random_reads(np.random.default_rng(11))
    models = [(m, method), (hmm.replace(m, p=m.p[::-1].copy()), method)]
    g = sum(hmm.KERNELS[method](r, x, grid_of) for x, _ in models) / 2
    e, f = (np.rint((g[:, :, 1] + x * g[:, :, 2]) * 1000) for x in (2, 4))
    ref = (g[:, :, 0] >= g[:, :, 1]) & (g[:, :, 0] >= g[:, :, 2])
    want = {"e": e, "ee": e * e, "f": f, "hom_ref": ref, "het": ~ref & (g[:, :, 1] >= g[:, :, 2])}
    monkeypatch.setattr(hmm, "_ahead", None)  # no pass visits grids one sample's block at a time
    for tile in (1, 1 << 14):
        monkeypatch.setattr(hmm, "TILE", tile)
        out = {name: np.zeros(len(grid_of)) for name in want}
        hmm.add_genotypes(r, models, grid_of, out)
        assert all(np.array_equal(out[name], x.sum(axis=0)) for name, x in want.items())


@pytest.mark.parametrize("proposed", [0, 24])
def test_paths_by_stretches_are_drawn_from_their_posterior(monkeypatch, proposed):
    monkeypatch.setattr(hmm, "PROPOSED", proposed)
    m, r, _ = _random_reads(np.random.default_rng(1))
    grids, own, names = len(m.stay) + 1, hmm.Grids(r), 5 * np.arange(r.n) + 3
    logs = hmm.track_logs(hmm.read_likelihoods(r, m), "diploid")
    emit = lambda lo, hi: own.emissions(logs, lo, hi)
    gamma, _ = hmm.diploid(emit(0, grids), m)
    drawn = hmm.drawn_paths(r, m, names, 3000, 1)
    founders = lambda x, n, paths: x.at(np.arange(n * paths * 2)[:, None], np.arange(grids)).reshape(n, paths, 2, grids)
    path, old = founders(drawn, r.n, 3000), hmm.sampled_paths(emit, m, r.n, 3000, 1)
    found = np.stack([[(path[:, :, 0] == i) & (path[:, :, 1] == j) for j in range(m.k)] for i in range(m.k)]).mean(axis=3)
    assert np.abs(found.transpose(2, 3, 0, 1) - gamma).max() < 0.04
    for far in (1, 5):  # whole paths, not grids one by one
        stays = (path[..., far:] == path[..., :-far]).mean(axis=1)
        assert np.abs(stays - (old[:, :, far:] == old[:, :, :-far]).mean(axis=0).transpose(0, 2, 1)).max() < 0.06
    # A sample's draws are its own, and turning is by agreement with its first path.
    some = founders(hmm.drawn_paths(r, m, names, 20, 1), r.n, 20)
    turn = (some[:, :, ::-1] == some[:, :1]).sum(axis=(2, 3)) > (some == some[:, :1]).sum(axis=(2, 3))
    turned = hmm.drawn_paths(r, m, names, 20, 1).turned()
    want = np.where(turn[:, :, None, None], some[:, :, ::-1], some)
    assert np.array_equal(founders(turned, r.n, 20), want)
    assert np.array_equal(turned.counts(m.k), [[(want[:, :, h] == k).sum(axis=(0, 1)) for k in range(m.k)] for h in (0, 1)])
    mine = np.flatnonzero(r.sample == r.n - 1)
    seen = np.isin(r.read, mine)
    alone = hmm.Reads(1, np.zeros(len(mine), int), r.grid[mine], np.searchsorted(mine, r.read[seen]), r.site[seen], r.bq[seen])
    assert np.array_equal(founders(hmm.drawn_paths(alone, m, names[-1:], 20, 1), 1, 20)[0], some[-1])
