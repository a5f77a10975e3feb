"""Simulated samples as SAM text, imputed from files to files."""

from dataclasses import replace

import numpy as np
import pytest

from genolith.plans.config import Config
from genolith.plans.run import impute_files
from genolith.sources.vcf import read_dosages


@pytest.fixture(scope="module")
def simulated(tmp_path_factory):
    rng = np.random.default_rng(3)
    folder = tmp_path_factory.mktemp("sim")
    founders = np.zeros((2, 10), int)
    founders[:, [1, 6]] = [[1, 1], [0, 0]]
    founders[:, 3] = [1, 1]
    founders[1, 8] = 1
    (folder / "pos").write_text("".join(f"5\t{i + 1}\tA\tG\n" for i in range(10)))
    truth = {}
    for s in range(10):
        pair = rng.integers(0, 2, 2)
        truth[f"s{s}"] = founders[pair].sum(axis=0)
        lines = [f"@HD\tVN:1.5\n@SQ\tSN:5\tLN:100\n@RG\tID:x\tSM:s{s}\n"]
        for r in range(16):
            start = int(rng.integers(0, 5))
            bases = "".join("AG"[a] for a in founders[pair[rng.integers(0, 2)]][start : start + 6])
            lines.append(f"r{r}\t0\t5\t{start + 1}\t60\t6M\t*\t0\t0\t{bases}\t{':' * 6}\n")
        (folder / f"s{s}.sam").write_text("".join(lines))
    return folder, truth


def test_dosages_are_near_truth(spark, simulated, tmp_path):
    folder, truth = simulated
    files = [str(folder / f"{s}.sam") for s in truth]
    impute_files(spark, str(folder / "pos"), files, str(tmp_path / "out"), Config(K=2, nGen=100, niterations=22, refillIterations=(), shuffleHaplotypeIterations=(), S=3), bam=False)
    got = {(r.sample, r.pos): r.ds for r in read_dosages(spark, f"{tmp_path}/out/vcf/*").collect()}
    assert len(got) == 100
    off = [abs(got[s, i + 1] - t[i]) for s, t in truth.items() for i in range(10)]
    assert np.mean(off) < 0.2
    assert spark.read.csv(f"{tmp_path}/out/stats", sep="\t", header=True).count() == 10


def test_a_run_with_everything(spark, simulated, tmp_path):
    from genolith.sources import bgen

    folder, truth = simulated
    files = [str(folder / f"{s}.sam") for s in truth]
    (folder / "gen").write_text("\t".join(truth) + "\n" + "".join("\t".join(str(t[i]) for t in truth.values()) + "\n" for i in range(10)))
    (folder / "map").write_text("position COMBINED_rate(cM/Mb) Genetic_Map(cM)\n1 1 0\n11 0 0.00001\n")
    founders = ["0|0", "1|0", "0|0", "1|1", "0|0", "0|0", "0|0", "0|0", "0|1", "0|0"]
    (folder / "panel.vcf").write_text("##fileformat=VCFv4.1\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tp\n" + "".join(f"5\t{i + 1}\t.\tA\tG\t.\t.\t.\tGT\t{x}\n" for i, x in enumerate(founders)))
    config = Config(K=2, nGen=100, niterations=6, refillIterations=(), shuffleHaplotypeIterations=(), output_format="bgen", do_phasing=True, useSoftClippedBases=True)
    out = str(tmp_path / "out")
    (folder / "phase").write_text("\t".join(truth) + "\n" + "".join("\t".join("0|1" if t[i] == 1 else f"{t[i] // 2}|{t[i] // 2}" for t in truth.values()) + "\n" for i in range(10)))
    (folder / "some").write_text("".join(f"5\t{i + 1}\n" for i in range(10) if i != 4))
    impute_files(spark, str(folder / "pos"), files, out, config, bam=False, genetic_map_file=str(folder / "map"), reference_vcf=str(folder / "panel.vcf"), genfile=str(folder / "gen"), phasefile=str(folder / "phase"), subsetSNPsfile=str(folder / "some"))
    assert bgen.read_bgen(spark, f"{out}/posteriors.bgen").count() == 90
    assert spark.read.csv(f"{out}/phase_truth", sep="\t", header=True).count() == sum((t == 1).any() for t in truth.values())
    assert spark.read.csv(f"{out}/truth", sep="\t", header=True).count() == 10
    cells = [c for r in spark.read.text(f"{out}/phased/rows").collect() for c in r.value.split("\t")[9:]]
    assert len(cells) == 90 and all(c[1] == "|" for c in cells)


def test_names_differ(spark, simulated, tmp_path):
    folder, _ = simulated
    file = str(folder / "s0.sam")
    (folder / "twice.sam").write_text((folder / "s0.sam").read_text())
    with pytest.raises(ValueError, match="names must differ"):
        impute_files(spark, str(folder / "pos"), [file, str(folder / "twice.sam")], str(tmp_path / "out"), Config(K=2, nGen=100), bam=False)
    (folder / "names").write_text("other\n")
    config = Config(K=2, nGen=100, niterations=2, refillIterations=(), shuffleHaplotypeIterations=())
    impute_files(spark, str(folder / "pos"), [file], str(tmp_path / "named"), config, bam=False, sampleNames_file=str(folder / "names"))
    assert {r.sample for r in read_dosages(spark, f"{tmp_path}/named/vcf/*").collect()} == {"other"}


def test_pileup_export(spark, simulated, tmp_path):
    folder, truth = simulated
    impute_files(spark, str(folder / "pos"), [str(folder / "s0.sam")], str(tmp_path / "out"), Config(K=2, nGen=100), bam=False, pileup_only=True)
    rows = [r.value for r in spark.read.text(f"{tmp_path}/out/input/rows").collect()]
    assert len(rows) >= 9 and all(r.split("\t")[8] == "GT:AD:PL" and r.split("\t")[9].startswith("./.:") for r in rows)


def test_bam_files_in_a_region(spark, simulated, tmp_path):
    """A run on BAM files reads what its sites need, and knows samples from headers."""
    from test_sources import bgzf

    from genolith.sources import alignments

    folder, truth = simulated
    sam = {s: [x.split("\t") for x in (folder / f"{s}.sam").read_text().split("\n") if x and x[0] != "@"] for s in truth}
    code = {c: i for i, c in enumerate("=ACMGRSVTWYHKDBN")}
    files = []
    for s, rows in [*sam.items(), ("empty", [])]:
        text = f"@HD\tVN:1.5\n@RG\tID:x\tSM:{s}\n".encode()
        out = b"BAM\1" + len(text).to_bytes(4, "little") + text + (1).to_bytes(4, "little") + (2).to_bytes(4, "little") + b"5\0" + (10**6).to_bytes(4, "little")
        for name, _, _, pos, *_, seq, qual in rows + ([["far", "0", "5", "500000", "60", "2M", "*", "0", "0", "AA", "::"]] if rows else []):
            packed = bytes(code[seq[i]] << 4 | (code[seq[i + 1]] if i + 1 < len(seq) else 0) for i in range(0, len(seq), 2))
            fixed = b"".join(x.to_bytes(4, "little", signed=True) for x in (0, int(pos) - 1)) + bytes([len(name) + 1, 60, 0, 0, 1, 0, 0, 0]) + len(seq).to_bytes(4, "little") + b"\xff" * 8 + bytes(4)
            body = fixed + name.encode() + b"\0" + (len(seq) << 4).to_bytes(4, "little") + packed + bytes(ord(q) - 33 for q in qual)
            out += len(body).to_bytes(4, "little") + body
        (tmp_path / f"{s}.bam").write_bytes(bgzf(out, 500))
        files.append(str(tmp_path / f"{s}.bam"))
    assert alignments.read_bam(spark, files, region=("5", 1, 700)).filter("qname = 'far'").isEmpty() and not alignments.read_bam(spark, files).filter("qname = 'far'").isEmpty()
    config = Config(K=2, nGen=100, niterations=3, refillIterations=(), shuffleHaplotypeIterations=())
    impute_files(spark, str(folder / "pos"), files, str(tmp_path / "out"), config)
    got = {r.sample for r in read_dosages(spark, f"{tmp_path}/out/vcf/*").collect()}
    assert got == {*truth, "empty"}


def test_panel_files_and_populations(spark, simulated, tmp_path):
    folder, truth = simulated
    files = [str(folder / f"{s}.sam") for s in truth]
    founders = np.zeros((2, 10), int)
    founders[0, [1, 3, 6]], founders[1, [3, 8]] = 1, 1
    (tmp_path / "legend").write_text("id position a0 a1\n" + "".join(f"x{i} {i + 1} A G\n" for i in range(10)))
    (tmp_path / "haps").write_text("".join(f"{1 - founders[0, i]} {1 - founders[1, i]} {founders[0, i]} {founders[1, i]}\n" for i in range(10)))
    (tmp_path / "samples").write_text("ID POP GROUP SEX\na wrong g 1\nb right g 1\n")
    config = Config(K=2, nGen=100, niterations=1, refillIterations=(), shuffleHaplotypeIterations=(), reference_iterations=0, reference_shuffleHaplotypeIterations=())
    panel = {f"reference_{n}_file": str(tmp_path / f) for n, f in (("haplotype", "haps"), ("legend", "legend"), ("sample", "samples"))}
    impute_files(spark, str(folder / "pos"), files, str(tmp_path / "out"), config, bam=False, reference_populations="right", **panel)
    got = {(r.sample, r.pos): r.ds for r in read_dosages(spark, f"{tmp_path}/out/vcf/*").collect()}
    assert np.mean([abs(got[s, i + 1] - t[i]) for s, t in truth.items() for i in range(10)]) < 0.05  # the founders themselves
    (tmp_path / "legend").write_text("id position a0 a1\n" + "".join(f"x{i} {i + 101} A G\n" for i in range(10)))
    with pytest.raises(ValueError, match="none of the sites"):
        impute_files(spark, str(folder / "pos"), files, str(tmp_path / "out2"), config, bam=False, **panel)
    (tmp_path / "legend").write_text("id position a0 a1\n" + "".join(f"x{i} {i + 2} A G\n" for i in range(10)))
    with pytest.raises(ValueError, match="own sites"):
        impute_files(spark, str(folder / "pos"), files, str(tmp_path / "out2"), config, bam=False, **panel)


def test_samples_of_the_keep_list_come_first(spark, tmp_path):
    from genolith.plans.run import named_samples

    (tmp_path / "keep").write_text("s7\ns3\n")
    held = spark.createDataFrame([(f"s{i}",) for i in range(10)], "sample string")
    config = Config(K=2, nGen=10, niterations=3, refillIterations=(), shuffleHaplotypeIterations=(), downsampleSamples=0.3)
    kept = {r.name for r in named_samples(spark, held, 10, None, config, str(tmp_path / "keep")).collect()}
    assert len(kept) == 3 and {"s3", "s7"} <= kept


def test_saved_inputs_stand_for_alignments(spark, simulated, tmp_path):
    folder, truth = simulated
    files = [str(folder / f"{s}.sam") for s in truth]
    config = Config(K=2, nGen=100, niterations=3, refillIterations=(), shuffleHaplotypeIterations=())
    saved, outs = str(tmp_path / "inputs"), [str(tmp_path / x) for x in "abc"]
    impute_files(spark, str(folder / "pos"), files, outs[0], config, bam=False, save_inputs=saved)
    impute_files(spark, str(folder / "pos"), [], outs[1], config, saved_inputs=saved)
    rows = [sorted(map(tuple, read_dosages(spark, f"{x}/vcf/*").collect())) for x in outs[:2]]
    assert len(rows[0]) == 100 and [r[:5] for r in rows[0]] == [r[:5] for r in rows[1]] and np.allclose([r[5] for r in rows[0]], [r[5] for r in rows[1]], atol=0.002)
    (tmp_path / "some").write_text("".join(f"5\t{i + 1}\tA\tG\n" for i in range(2, 8)))
    impute_files(spark, str(tmp_path / "some"), [], outs[2], replace(config, gridWindowSize=3), saved_inputs=saved)
    assert len({r.pos for r in read_dosages(spark, f"{outs[2]}/vcf/*").collect()}) == 6
    (tmp_path / "more").write_text("5\t1\tA\tG\n5\t2\tA\tC\n")
    for pos, other, message in ((tmp_path / "more", config, "not in"), (folder / "pos", replace(config, bqFilter=5), "was made with")):
        with pytest.raises(ValueError, match=message):
            impute_files(spark, str(pos), [], str(tmp_path / "d"), other, saved_inputs=saved)


def test_regions_and_truth_that_do_not_fit(spark, simulated, tmp_path):
    folder, truth = simulated
    config = Config(K=2, nGen=100, niterations=3, refillIterations=(), shuffleHaplotypeIterations=(), regionStart=50, regionEnd=60, buffer=45)
    with pytest.raises(ValueError, match="in the region itself"):
        impute_files(spark, str(folder / "pos"), [], str(tmp_path / "o"), config, bam=False)
    (tmp_path / "gen").write_text("a\n0\n1\n")
    with pytest.raises(ValueError, match="rows for 10 sites"):
        impute_files(spark, str(folder / "pos"), [], str(tmp_path / "o"), replace(config, regionStart=1), bam=False, genfile=str(tmp_path / "gen"))


def test_haplotype_dosages(spark, simulated, tmp_path):
    folder, truth = simulated
    files = [str(folder / f"{s}.sam") for s in truth]
    config = Config(K=3, nGen=100, niterations=3, refillIterations=(), shuffleHaplotypeIterations=(), output_haplotype_dosages=True)
    impute_files(spark, str(folder / "pos"), files, str(tmp_path / "out"), config, bam=False)
    rows = [r.value.split("\t") for r in spark.read.text(f"{tmp_path}/out/vcf/rows").collect()]
    assert len(rows) == 10 and all(r[8] == "GT:GP:DS:HD" for r in rows)
    shares = np.array([[float(x) for x in c.split(":")[3].split(",")] for r in rows for c in r[9:]])
    assert shares.shape == (100, 3) and np.allclose(shares.sum(axis=1), 2, atol=0.01)
