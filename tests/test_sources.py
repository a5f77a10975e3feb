"""Readers and writers on small files."""

import gzip
import re
import struct
import zlib

import numpy as np
import pytest

from genolith.sources import alignments, bam, tables, vcf
from genolith.streaming.sessions import gap_sessions
from pyspark.sql import functions as F

SAM = "@HD\tVN:1.5\n@SQ\tSN:1\tLN:1000\n@RG\tID:a\tSM:{sm}\nr1\t0\t1\t17\t60\t6M\t*\t0\t0\tGACCGA\t:;<=>?\tBX:Z:T1\nr2\t1040\t1\t20\t60\t2M\t*\t0\t0\tGA\tII\n"


def bam_bytes():
    header = SAM.format(sm="s1").split("r1")[0].encode()
    out = b"BAM\1" + struct.pack("<i", len(header)) + header + struct.pack("<i", 1) + struct.pack("<i", 2) + b"1\0" + struct.pack("<i", 1000)
    code = {c: i for i, c in enumerate("=ACMGRSVTWYHKDBN")}
    for name, flag, pos, op, seq, qual, tag in ((b"r1\0", 0, 16, 6, "GACCGA", ":;<=>?", b"BXZT1\0"), (b"r2\0", 1040, 19, 2, "GA", "II", b"")):
        packed = bytes((code[seq[i]] << 4) | (code[seq[i + 1]] if i + 1 < len(seq) else 0) for i in range(0, len(seq), 2))
        body = struct.pack("<iiBBHHHiiii", 0, pos, len(name), 60, 0, 1, flag, len(seq), -1, -1, 0) + name + struct.pack("<I", op << 4) + packed + bytes(ord(q) - 33 for q in qual) + tag
        out += struct.pack("<i", len(body)) + body
    half = len(out) // 2
    return gzip.compress(out[:half]) + gzip.compress(out[half:])


def test_sam_and_bam_agree(spark, tmp_path):
    (tmp_path / "a.sam").write_text(SAM.format(sm="s1"))
    (tmp_path / "a.bam").write_bytes(bam_bytes())
    columns = ["sample", "chr", "qname", "dup", "rev", "pos", "mapq", "cigar", "isize", "seq", "qual", "bx"]
    sam, bam = (sorted(map(tuple, f(spark, str(tmp_path / x)).select(*columns).collect())) for f, x in ((alignments.read_sam, "a.sam"), (alignments.read_bam, "a.bam")))
    assert sam == bam and sam[0][:6] == ("s1", "1", "r1", False, False, 17) and sam[1][3:5] == (True, True)


def test_one_sample_a_file(spark, tmp_path):
    (tmp_path / "b.sam").write_text(SAM.format(sm="s1").replace("@SQ", "@RG\tID:b\tSM:s2\n@SQ"))
    with pytest.raises(Exception, match="not one sample"):
        alignments.read_sam(spark, str(tmp_path / "b.sam")).collect()


def test_tables(spark, tmp_path):
    (tmp_path / "pos").write_text("1\t5\tA\tG\n1\t9\tC\tT\n")
    (tmp_path / "gen").write_text("a\tb\n0\t2\nNA\t1\n")
    (tmp_path / "phase").write_text("a\tb\n0|1\t1|1\nNA|NA\t0|0\n")
    (tmp_path / "map").write_text("position COMBINED_rate(cM/Mb) Genetic_Map(cM)\n1 1.0 0\n1000001 0 1.0\n")
    s = tables.check_sites(tables.read_sites(spark, str(tmp_path / "pos")))
    assert [(r.snp, r.pos) for r in s.orderBy("snp").collect()] == [(0, 5), (1, 9)]
    assert sorted(map(tuple, tables.read_genotypes(spark, str(tmp_path / "gen")).collect()), key=str) == sorted([(0, "a", 0), (0, "b", 2), (1, "a", None), (1, "b", 1)], key=str)
    assert tables.read_phase(spark, str(tmp_path / "phase")).filter("h1 is null").count() == 1
    assert tables.check_genetic_map(tables.read_genetic_map(spark, str(tmp_path / "map"))).count() == 2
    with pytest.raises(ValueError):
        tables.check_sites(s.withColumn("alt", F.col("ref")))


def test_panel_files(spark, tmp_path):
    (tmp_path / "legend").write_text("id position a0 a1\nx 5 A G\ny 9 C T\n")
    (tmp_path / "haps").write_text("0 1 1 -\n1 1 0 -\n")
    (tmp_path / "samples").write_text("ID POP GROUP SEX\na P1 g 1\nb P2 g 1\n")
    p = tables.read_panel(spark, str(tmp_path / "haps"), str(tmp_path / "legend"), str(tmp_path / "samples"), ["P2"])
    assert sorted((r.hap, r.pos, r.allele) for r in p.collect()) == [(2, 5, 1), (2, 9, 0)]


def test_vcf_round_trip(spark, tmp_path):
    sites = spark.createDataFrame([(0, "1", 5, "A", "G"), (1, "1", 9, "C", "T")], "snp long, chr string, pos long, ref string, alt string")
    cells = spark.createDataFrame([("a", 0, "0/1:0.100,0.800,0.100:1.000"), ("b", 0, "0/0:1.000,0.000,0.000:0.000"), ("a", 1, "1/1:0.000,0.000,1.000:2.000")], "sample string, snp long, cell string")
    info = sites.select("snp", F.lit("EAF=0.5").alias("info"))
    vcf.write_vcf(cells, sites, info, "GT:GP:DS", str(tmp_path / "out"), ({"EAF": "frequency"}, {"DS": "dosage"}))
    got = {(r.sample, r.pos): r.ds for r in vcf.read_dosages(spark, f"{tmp_path}/out/*").collect()}
    assert got == {("a", 5): 1.0, ("b", 5): 0.0, ("a", 9): 2.0, ("b", 9): None}


def test_vcf_panel(spark, tmp_path):
    (tmp_path / "p.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\n1\t5\t.\tA\tG\t.\t.\tX=1\tGT\t0|1\n1\t5\t.\tA\tT\t.\t.\t.\tGT\t1|1\n1\t7\t.\tAC\tG\t.\t.\t.\tGT\t0|1\n1\t9\t.\tC\tT\t.\t.\t.\tGT\t0/1\n")
    assert sorted(map(tuple, vcf.read_panel(spark, str(tmp_path / "p.vcf")).collect())) == [(0, 5, "A", "G", 0), (1, 5, "A", "G", 1)]


def test_stream_sessions_equal_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(str(tmp_path / "in"))
    wanted = sorted(map(tuple, gap_sessions(events, "user_id", "ts").collect()))
    stream = gap_sessions(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "user_id", "ts", late="3650 days")
    query = stream.writeStream.outputMode("append").format("memory").queryName("sessions_out").start()
    query.processAllAvailable()
    query.stop()
    assert wanted and set(map(tuple, spark.table("sessions_out").collect())) <= set(wanted)


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_bgen_round_trip(spark, tmp_path, bits):
    import numpy as np

    from genolith.sources import bgen

    rng = np.random.default_rng(bits)
    gp = rng.dirichlet([1, 1, 1], (4, 3))
    sites = spark.createDataFrame([(i, "1", 10 * i + 5, "A", "G") for i in range(4)], "snp long, chr string, pos long, ref string, alt string")
    post = spark.createDataFrame([(f"s{j}", i, *map(float, gp[i, j])) for i in range(4) for j in range(3)], "sample string, snp long, g0 double, g1 double, g2 double")
    names = ["s0", "s1", "s2"]
    bgen.assemble(bgen.blocks(post, sites, names, bits), names, str(tmp_path / "x.bgen"))
    got = {(r.pos, r.sample): (r.g0, r.g1, r.g2) for r in bgen.read_bgen(spark, str(tmp_path / "x.bgen")).collect()}
    for i in range(4):
        for j in range(3):
            assert np.allclose(got[10 * i + 5, f"s{j}"], gp[i, j], atol=1.01 / ((1 << bits) - 1))
    assert [p for p, *_ in [(v[1],) for v in bgen.parse((tmp_path / "x.bgen").read_bytes())[1]]] == [5, 15, 25, 35]


def test_panel_files_fit_together(spark, tmp_path):
    from genolith.sources import tables

    good = {"h": "0 1 1 0\n1 1 0 -\n", "l": "id position a0 a1\nx 5 A G\ny 9 C T\n", "s": "ID POP GROUP SEX\na P G male\nb P G female\n"}

    def check(**changed):
        for name, text in (good | changed).items():
            (tmp_path / name).write_text(text)
        tables.check_panel(spark, *[str(tmp_path / name) for name in "hls"])

    check()
    for bad in ({"h": "0 1 1 0\n"}, {"h": "0 1 1 0\n1 1 0\n"}, {"h": "0 1 1 2\n1 1 0 0\n"}, {"l": good["l"].replace("9", "5")}, {"l": "x 5 A G\ny 9 C T\n"}, {"s": "ID POP GROUP SEX\na P G male\n"}, {"s": "a P G male\nb P G female\n"}):
        with pytest.raises(ValueError):
            check(**bad)


def bgzf(data, size, level=6):
    """``data`` in blocks of ``size`` bytes each, with the empty one at the end."""
    out = b""
    for at in [*range(0, len(data), size), len(data)]:
        machine = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = machine.compress(data[at : at + size]) + machine.flush()
        out += b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data[at : at + size]), len(data[at : at + size]))
    return out


def random_bam(rng, n, sample="s1", so="coordinate", nested=True):
    """(uncompressed BAM, rows) with reads of all lengths, some longer than a block, that look like records inside."""
    text = f"@HD\tVN:1.5\tSO:{so}\n@RG\tID:a\tSM:{sample}\n".encode()
    out = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", 2) + b"".join(struct.pack("<i", 3) + c + b"\0" + struct.pack("<i", size) for c, size in ((b"c1", 50_000), (b"c2", 9_000)))
    rows, code = [], {c: i for i, c in enumerate("=ACMGRSVTWYHKDBN")}
    for i, place in enumerate(sorted(rng.integers(0, 57_000, n))):
        ref, pos = (0, int(place)) if place < 49_000 else (1, int(place) - 49_000)
        size = int(rng.integers(1, 400)) if rng.random() < 0.05 else int(rng.integers(1, 40))
        seq, scores = "".join(rng.choice(list("ACGT"), size)), rng.integers(0, 60, size)
        name, clip = f"r{i}".encode(), int(rng.integers(0, size))
        ops = [(clip, 4)] * (clip > 0) + [(size - clip, 0)] + [(50, 3)] * (i % 7 == 0)
        packed = bytes(code[seq[j]] << 4 | (code[seq[j + 1]] if j + 1 < size else 0) for j in range(0, size, 2))
        tags = b"BXZT%d\0" % (i % 5) if i % 3 else b""
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, len(ops), 16 * (i % 2), size, -1, -1, 0) + name + b"\0" + b"".join(struct.pack("<I", a << 4 | b) for a, b in ops) + packed + bytes(scores.tolist()) + tags
        if nested and i % 11 == 0:  # the record before, as bytes of a tag
            body += b"XXBC" + struct.pack("<i", min(len(out), 150)) + out[-150:]
        out += struct.pack("<i", len(body)) + body
        rows.append((sample, ("c1", "c2")[ref], f"r{i}", False, bool(i % 2), pos + 1, 60, "".join(f"{a}{'MIDNSHP=X'[b]}" for a, b in ops), 0, seq, "".join(chr(33 + q) for q in scores), f"T{i % 5}" if i % 3 else ""))
    return out, rows


@pytest.mark.parametrize("size, split", [(300, 700), (97, 64), (5000, 1500), (65_000, 1 << 20)])
def test_bam_in_splits_is_the_whole_bam(spark, tmp_path, size, split):
    rng = np.random.default_rng(size)
    data, rows = random_bam(rng, 250)
    other, more = random_bam(rng, 3, "s2", "unsorted")
    (tmp_path / "a.bam").write_bytes(bgzf(data, size))
    (tmp_path / "b.bam").write_bytes(gzip.compress(other))  # no blocks
    read = bam.read_splits(spark, str(tmp_path / "*.bam"), split)
    assert sorted(map(tuple, read.collect())) == sorted(rows + more)
    assert read.rdd.getNumPartitions() > 20 or size > 1000
    assert sorted(bam.whole("a", bgzf(data, size))) == sorted(rows)
    reach = lambda r: sum(int(n) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", r[7]) if op in "MDN=X")
    for region in (("c1", 10_000, 12_000), ("c2", 1, 300), ("c1", 49_000, 60_000), ("c3", 1, 9)):
        want = [r for r in rows + more if r[1] == region[0] and r[5] <= region[2] and r[5] + reach(r) - 1 >= region[1]]
        assert sorted(map(tuple, bam.read_splits(spark, str(tmp_path / "*.bam"), split, region).collect())) == sorted(want)
    assert sorted(map(tuple, bam.chromosome_lengths(spark, str(tmp_path / "*.bam")).collect())) == [("c1", 50_000), ("c2", 9_000)]


def test_each_place_between_records_is_found():
    data, _ = random_bam(np.random.default_rng(1), 60, nested=False)
    header, _, place = bam.parse_header("x", iter([(0, data)]))
    begins, at = [], place
    while at < len(data):
        begins.append(at)
        at += 4 + struct.unpack_from("<i", data, at)[0]
    for start in range(place, len(data), 37):
        want = next((b - start for b in begins if b >= start), None)
        assert bam.first_record(data[start:], header, True) == want, start


def test_splits_far_into_a_file(tmp_path, monkeypatch):
    monkeypatch.setattr(bam, "BEFORE", 900)
    rng = np.random.default_rng(5)
    data, rows = random_bam(rng, 400, nested=False)
    content = bgzf(data, 350)
    (tmp_path / "a.bam").write_bytes(content)
    for split in (333, 2000):
        got = [r for at in range(0, len(content), split) for r in bam.records(bam.Split(str(tmp_path / "a.bam"), at, min(len(content), at + split), len(content)))]
        assert got == rows


def test_damaged_bam(spark, tmp_path):
    data, _ = random_bam(np.random.default_rng(2), 50)
    for name, content in (("cut", bgzf(data, 400)[:-300]), ("text", b"no bam at all"), ("gz", gzip.compress(b"text"))):
        (tmp_path / name).write_bytes(content)
        with pytest.raises(Exception):
            bam.read_splits(spark, str(tmp_path / name), 1000).collect()


def test_array_reports(spark, tmp_path):
    from genolith.operators import evaluate
    from genolith.sources import arrays

    (tmp_path / "report").write_text("[Header]\nContent\tx\n[Data]\nSNP Name\tSample ID\tAllele1 - AB\tAllele2 - AB\tGC Score\n" + "p1\ts1\tA\tB\t0.9\np1\ts2\tB\tB\t0.1\np2\ts1\tB\tB\t0.15\np3\ts1\tA\tA\t1\np4\ts1\tA\tA\t1\np1\tbad\tA\tA\t1\n")
    (tmp_path / "probes").write_text("Index\tName\tChromosome\tPosition\tSNP\n1\tp1\t7\t105\t[A/G]\n2\tp2\t7\t205\t[C/T]\n3\tp3\t7\t106\t[A/C]\n4\tp4\t7\t900\t[A/C]\n")
    chain = spark.createDataFrame([("7", 100, 199, "chr7", 1100, True), ("7", 200, 299, "chr7", 1010, False), ("7", 106, 106, "chr7", 1105, True)], "chr string, start long, end long, to_chr string, to_start long, forward boolean")
    probes = arrays.lift(arrays.read_manifest(spark, str(tmp_path / "probes")), chain.filter("start != 106"))
    assert {(r.probe, r.chr, r.pos) for r in probes.collect()} == {("p1", "chr7", 1105), ("p2", "chr7", 1104), ("p3", "chr7", 1106)}
    moved = probes.withColumn("pos", F.when(F.col("probe") == "p3", 1105).otherwise(F.col("pos")))  # where p1 is already
    without, names = spark.createDataFrame([("bad",)], "sample string"), spark.createDataFrame([("s2", "t2")], "sample string, name string")
    got = arrays.report_calls(arrays.read_report(spark, str(tmp_path / "report")), moved, 0.15, without, names)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("s1", "chr7", 1105, "A", "G", 1), ("t2", "chr7", 1105, "A", "G", None), ("s1", "chr7", 1104, "C", "T", 2)], key=str)
    wide = spark.createDataFrame([("a", 0, -1), ("b", 2, 1), ("c", 1, 1)], "probeset_id string, `x.cel` int, `y.cel` int")
    annotation = spark.createDataFrame([("a", "1", 5, "A", "G"), ("b", "1", 9, "A", "GT")], "probe string, chr string, pos long, ref string, alt string")
    calls = arrays.probe_calls(wide, annotation, names=spark.createDataFrame([("x.cel", "x"), ("y.cel", "y")], "sample string, name string"))
    assert sorted(map(tuple, calls.collect()), key=str) == sorted([("x", "1", 5, "A", "G", 0), ("y", "1", 5, "A", "G", None)], key=str)
    rows = [(1, g) for g in [0] * 60 + [2] * 60] + [(2, g) for g in [0] * 30 + [1] * 60 + [2] * 30] + [(3, None)] * 10 + [(3, 0)] * 100
    sites = spark.createDataFrame(rows, "snp int, g int")
    assert [r.snp for r in evaluate.usable_calls(sites, 0.05, 1e-10).collect()] == [2] and {r.snp for r in evaluate.usable_calls(sites).collect()} == {1, 2}


def test_lines_are_numbered_across_partitions(spark, tmp_path):
    (tmp_path / "lines").write_text("".join(f"line {i}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = tables.numbered_lines(spark, str(tmp_path / "lines"))
        assert lines.rdd.getNumPartitions() > 5 and lines.filter(F.col("value") != F.concat(F.lit("line "), F.col("n").cast("string"))).isEmpty() and lines.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "none").write_text("")
    assert tables.numbered_lines(spark, str(tmp_path / "none")).count() == 0


def test_parts_of_panels_and_maps(spark, tmp_path):
    from genolith.operators import sites as site_ops

    cells = ["0|1\t1|1\t0|0", "1|0\t.|.\t0|1", "1|1\t0|1\t1|0"]
    (tmp_path / "p.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\tc\n" + "".join(f"1\t{5 * (i + 1)}\t.\tA\tG\t.\t.\t.\tGT\t{x}\n" for i, x in enumerate(cells)))
    path = str(tmp_path / "p.vcf")
    got = lambda **k: sorted((r.pos, r.hap, r.allele) for r in vcf.read_panel(spark, path, **k).collect())
    assert got(samples=["a", "c"]) == got(without=["b"]) == sorted((5 * (i + 1), 2 * c + h, int(x.split("\t")[c][2 * h])) for i, x in enumerate(cells) for c in (0, 2) for h in (0, 1))
    assert {p for p, _, _ in got()} == {5, 15} and {p for p, _, _ in got(region=("1", 6, 20))} == {15} and got(region=("2", 1, 99)) == []
    with pytest.raises(ValueError, match="no sample"):
        got(samples=["z"])
    where = vcf.read_positions(spark, path, ("1", 6, 20))
    assert sorted(r.pos for r in where.collect()) == [10, 15]
    made = site_ops.constant_map(vcf.read_positions(spark, path), 2.0)
    tables.write_genetic_map(made, str(tmp_path / "map"))
    back = tables.check_genetic_map(tables.read_genetic_map(spark, str(tmp_path / "map")))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, made.select("position", "rate", "cm").collect()))
