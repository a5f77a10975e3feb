"""From files to files: the whole imputation as one call or command.

    python -m genolith.plans.run --posfile pos.txt --bamlist bams.txt --outputdir out --chr chr1 --K 4 --nGen 100
"""

from __future__ import annotations

import argparse
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.cigar import clip
from ..functions.hwe import hwe_p
from ..functions.phred import genotype_cell, phred_likelihoods, pileup_cell
from ..operators import evaluate, pileup, reads
from ..operators.sites import match_panel, region
from ..sources import alignments, bgen, inputs, tables, vcf
from . import em
from .config import Config

#: Files that a run may take besides sites and alignments.
OPTIONAL = ("genetic_map_file", "reference_vcf", "reference_haplotype_file", "reference_legend_file", "reference_sample_file", "reference_populations", "genfile", "phasefile", "sampleNames_file", "downsampleSamplesKeepList", "subsetSNPsfile", "save_inputs", "saved_inputs")
INFO = {"EAF": "Estimated allele frequency", "INFO_SCORE": "Info score", "HWE": "Hardy-Weinberg p-value", "ERC": "Weight of the alternative allele", "EAC": "Weight of the reference allele", "PAF": "Allele frequency of the pileup"}
CELL = {"GT": "Best genotype, if its posterior is 0.9 or more", "GP": "Posteriors", "DS": "Dosage"}


def observations(aligned: DataFrame, sites: DataFrame, config: Config, use_bx: bool = True, bx_limit: int = 50_000) -> DataFrame:
    """(sample, read, snp, bq): scanned alignments, fragments of one molecule under one read, depth cut to the limit.

    With tags, a molecule is a run of a tag's fragments at most ``bx_limit`` apart; else the fragments of a name.
    """
    if config.useSoftClippedBases:
        aligned = aligned.withColumns(clip(F.col("cigar"), F.col("pos"), F.col("seq"), F.col("qual"), True))
    seen = reads.scan(aligned.filter(F.col("chr").isin([r.chr for r in sites.select("chr").distinct().collect()])), sites, config.bqFilter, config.iSizeUpperLimit)
    fragments = seen.select("sample", "qname", "bx", "start", "end").distinct()
    whole = reads.merge_molecules(fragments, config.iSizeUpperLimit).select("sample", "qname")
    named = seen.join(whole, ["sample", "qname"], "left_semi")
    read = F.col("qname")
    if use_bx:
        tagged = reads.rescue_tags(fragments)
        from pyspark.sql import Window

        w = Window.partitionBy("sample", "tag").orderBy("start", "end", "qname")
        run = tagged.filter("tag is not null").withColumn("__new", F.when(F.col("start") - F.lag("end").over(w) > bx_limit, 1).otherwise(0)).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        first = run.groupBy("sample", "qname").agg(F.min(F.struct("start", "tag", "session")).alias("s")).select("sample", "qname", F.concat_ws("/", "s.tag", F.col("s.session").cast("string")).alias("molecule"))
        named = named.join(first, ["sample", "qname"], "left")
        read = F.coalesce("molecule", "qname")
    obs = named.select("sample", F.xxhash64(read).alias("read"), "snp", "bq")  # mates that overlap see a site twice
    if config.downsampleFraction < 1:
        obs = reads.thin(obs, config.downsampleFraction, config.seed)
    whole = obs.groupBy("sample", "read").agg(F.array_sort(F.collect_list(F.struct("snp", "bq"))).alias("x")).select("sample", "read", F.col("x.snp").alias("snp"), F.col("x.bq").alias("bq"))
    kept = reads.cap_depth_greedy(whole, config.downsampleToCov, config.seed).select("sample", "read", F.explode(F.arrays_zip("snp", "bq")).alias("x")).select("sample", "read", "x.snp", "x.bq")
    return kept if config.readAware else kept.withColumn("read", F.xxhash64("read", "snp"))


def output(post: DataFrame, obs: DataFrame, sites: DataFrame, path: str, form: str = "bgvcf", shares: DataFrame | None = None) -> None:
    """The VCF of posteriors (or, of form bgen, the file posteriors.bgen), with founders' ``shares`` (sample, snp, hd) if given, and the table of site statistics, in ``path``."""
    stats = pileup.site_summary(post).join(pileup.allele_counts(obs, sites), "snp").withColumn("hwe", hwe_p("hom_ref", "het", "hom_alt"))
    five = lambda name, c: F.concat(F.lit(f"{name}="), F.format_string("%.5f", c))
    info = F.concat_ws(";", five("EAF", F.col("eaf")), five("INFO_SCORE", F.col("info")), F.concat(F.lit("HWE="), F.format_string("%.2e", F.col("hwe"))), five("ERC", F.col("alt")), five("EAC", F.col("total") - F.col("alt")), five("PAF", F.col("af")))
    both = post if shares is None else post.join(shares, ["sample", "snp"])
    cells = both.select("sample", "snp", genotype_cell([F.col("g0"), F.col("g1"), F.col("g2")], None if shares is None else F.col("hd")).alias("cell"))
    if form == "bgen":
        names = [r.sample for r in post.select("sample").distinct().orderBy("sample").collect()]  # the header itself
        bgen.assemble(bgen.blocks(post, sites, names), names, f"{path}/posteriors.bgen")
    else:
        vcf.write_vcf(cells, sites, stats.select("snp", info.alias("info")), "GT:GP:DS" if shares is None else "GT:GP:DS:HD", f"{path}/vcf", (INFO, CELL if shares is None else CELL | {"HD": "Haplotypes of each founder"}))
    vcf.write_site_statistics(stats.join(sites.select("snp", "chr", "pos"), "snp"), f"{path}/stats")


def output_pileup(obs: DataFrame, sites: DataFrame, path: str) -> None:
    """The input as a VCF of depths and phred-scaled likelihoods."""
    pl = phred_likelihoods([F.col(f"l{i}") for i in range(3)])
    cells = pileup.likelihoods(obs).select("sample", "snp", pileup_cell([F.col("ad0"), F.col("ad1")], pl).alias("cell"))
    vcf.write_vcf(cells, sites, sites.select("snp", F.lit(".").alias("info")), "GT:AD:PL", f"{path}/input")


def named_samples(spark: SparkSession, held: DataFrame, files: int, names_file: str | None, config: Config, keep_list: str | None = None) -> DataFrame:
    """(number, name) of the samples to impute: those of the files, renamed by the lines of ``names_file`` if given, thinned to downsampleSamples, with those named in
    the file ``keep_list`` first. Raises
    ValueError if two files have one name."""
    found = [r.sample for r in held.select("sample").distinct().orderBy("sample").collect()]  # the samples' names
    if len(found) < files:
        raise ValueError(f"{files} files hold {len(found)} samples: names must differ, and files have reads")
    names = found
    if names_file is not None:
        names = [r.value for r in spark.read.text(names_file).collect() if r.value]
        if len(names) != len(found) or len(set(names)) != len(names):
            raise ValueError(f"{names_file} must hold {len(found)} different names")
    every = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(found, names))], "number long, own string, name string")
    keep = max(1, round(config.downsampleSamples * len(found)))
    if keep < len(found):
        wanted = every.limit(0) if keep_list is None else every.join(spark.read.text(keep_list).withColumnRenamed("value", "name"), "name", "left_semi")
        kept = reads.choose_samples(every.select(F.col("number").alias("sample")), wanted.select(F.col("number").alias("sample")), keep, config.seed)
        every = every.join(kept.withColumnRenamed("sample", "number"), "number", "left_semi")
    return every


def read_panel(spark: SparkSession, sites: DataFrame, config: Config, reference_vcf: str | None, haps: str | None, legend: str | None, samples: str | None, populations: str | None) -> DataFrame | None:
    """(hap, snp, allele) of the panel at the sites, if one is given. Raises ValueError if its files don't fit together, if it shares no site, or if, with one iteration, it lacks
    or adds any."""
    if reference_vcf is None and haps is None:
        return None
    if reference_vcf is not None:
        ends = sites.groupBy("chr").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).first()  # one chromosome
        found = vcf.read_panel(spark, reference_vcf, (ends.chr, ends.lo, ends.hi) if config.niterations > 1 else None)
    else:
        if legend is None:
            raise ValueError("a haplotype file needs a legend")
        tables.check_panel(spark, haps, legend, samples)
        found = tables.read_panel(spark, haps, legend, samples, populations.split(",") if populations else None)
    if config.regionStart is not None:
        found = found.filter(F.col("pos").between(config.regionStart - config.buffer, config.regionEnd + config.buffer))
    met = match_panel(sites, found.select("pos", "ref", "alt").distinct()).first()
    if not met.both:
        raise ValueError("the panel has none of the sites")
    if config.niterations == 1 and (met.only_sites or met.only_legend):
        raise ValueError(f"one iteration needs the panel's own sites: {met.only_sites} are not in the panel, {met.only_legend} only there")
    return found.join(sites.select("snp", "pos", "ref", "alt"), ["pos", "ref", "alt"]).select("hap", "snp", "allele")


def output_truth(post: DataFrame, sites: DataFrame, genfile: str, path: str) -> None:
    """Squared correlations of dosages with a truth file's genotypes, by sample."""
    truth = tables.read_genotypes(post.sparkSession, genfile).filter("g is not null")
    both = truth.join(post.select("sample", "snp", (F.col("g1") + 2 * F.col("g2")).alias("ds")), ["sample", "snp"])
    vcf.write_site_statistics(evaluate.squared_correlation(both, "sample"), f"{path}/truth")


def output_phase_truth(phased: DataFrame, phasefile: str, path: str) -> None:
    """Phase switches against a truth file, by sample."""
    truth = tables.read_phase(phased.sparkSession, phasefile).filter("h1 is not null and h2 is not null").select("sample", "snp", F.col("h1").alias("t1"), F.col("h2").alias("t2"))
    both = truth.join(phased, ["sample", "snp"]).select("sample", F.col("snp").alias("pos"), "t1", "t2", F.bround("h0", 0).cast("int").alias("h1"))
    vcf.write_site_statistics(evaluate.phase_switches(both), f"{path}/phase_truth")


def output_phased(phased: DataFrame, sites: DataFrame, path: str) -> None:
    """The VCF of phased genotypes, with the haplotypes' dosages."""
    one = lambda c: F.bround(c, 0).cast("int").cast("string")
    cell = F.concat(one("h0"), F.lit("|"), one("h1"), F.format_string(":%.3f,%.3f", "h0", "h1"))
    vcf.write_vcf(phased.select("sample", "snp", cell.alias("cell")), sites, sites.select("snp", F.lit(".").alias("info")), "GT:HD", f"{path}/phased", ({}, {"GT": "Phased genotype", "HD": "Dosages of both haplotypes"}))


#: Settings that decide what is observed.
_OBSERVED = ("bqFilter", "iSizeUpperLimit", "useSoftClippedBases", "downsampleToCov", "downsampleFraction", "readAware", "seed")


def input_settings(config: Config, use_bx: bool) -> dict:
    return {name: getattr(config, name) for name in _OBSERVED} | {"use_bx": use_bx}


def impute_files(spark: SparkSession, posfile: str, files: list[str], outputdir: str, config: Config, bam: bool = True, pileup_only: bool = False, use_bx: bool = True, genetic_map_file: str | None = None, reference_vcf: str | None = None, reference_haplotype_file: str | None = None, reference_legend_file: str | None = None, reference_sample_file: str | None = None, reference_populations: str | None = None, genfile: str | None = None, phasefile: str | None = None, sampleNames_file: str | None = None, downsampleSamplesKeepList: str | None = None, subsetSNPsfile: str | None = None, save_inputs: str | None = None, saved_inputs: str | None = None) -> None:
    """Impute the samples of ``files`` (BAM, or SAM text; samples without a read at any site too) at the sites of ``posfile``. Optional: a genetic map; a panel
    (a phased VCF, or files of haplotypes, legend and samples, of all or of some populations, split by commas) that founders are made of to begin with; truth to compare with (genotypes, phases); names of the
    samples, in the order of their own; samples to keep first where only a share is imputed; positions (chr, pos) of the sites to use;
    a folder to save the inputs in, or one to take them from, when no alignments are read."""
    config.check()
    sites = tables.check_sites(tables.read_sites(spark, posfile))
    for path, read in ((genfile, tables.read_genotypes), (phasefile, tables.read_phase)):
        if path is not None:
            rows, n = read(spark, path).agg(F.count_distinct("snp")).first()[0], sites.count()
            if rows != n:
                raise ValueError(f"{path} has {rows} rows for {n} sites")
    if subsetSNPsfile is not None:
        listed = spark.read.csv(subsetSNPsfile, sep="\t", schema="chr string, pos long")
        sites = sites.join(listed.distinct(), ["chr", "pos"], "left_semi").select("snp", "chr", "pos", "ref", "alt")
    central = sites.select("snp")
    if config.regionStart is not None:
        near = region(sites, config.regionStart, config.regionEnd, config.buffer)
        sites, central = near.select("snp", "chr", "pos", "ref", "alt"), near.filter("central").select("snp")
    sites = sites.persist()
    n, own = sites.count(), central.count()
    if n < 2 or own < 1:
        raise ValueError(f"{n} sites are left, {own} of them in the region itself: at least two are needed, and one in the region")
    if saved_inputs is not None:
        kept, names = inputs.load(spark, saved_inputs, sites, input_settings(config, use_bx))
        names = names.persist()
        obs = kept.withColumnRenamed("sample", "number").join(F.broadcast(names), "number").select(F.col("name").alias("sample"), "number", "read", "snp", "bq").persist()
    else:
        names, obs = _scanned(spark, files, sites, config, bam, use_bx, sampleNames_file, downsampleSamplesKeepList)
        if save_inputs is not None:
            inputs.save(obs.select(F.col("number").alias("sample"), "read", "snp", "bq"), sites, names, save_inputs, input_settings(config, use_bx))
    out_sites = sites.join(central, "snp", "left_semi")
    if pileup_only:
        output_pileup(obs.drop("number"), out_sites, outputdir)
    else:
        numbered = obs.select(F.col("number").alias("sample"), "read", "snp", "bq")
        gmap = None
        if genetic_map_file is not None:
            one = sites.select("chr").distinct()  # the sites' only chromosome
            gmap = tables.check_genetic_map(tables.read_genetic_map(spark, genetic_map_file)).crossJoin(F.broadcast(one))
        panel = read_panel(spark, sites, config, reference_vcf, reference_haplotype_file, reference_legend_file, reference_sample_file, reference_populations)
        more = {"every": names.select(F.col("number").alias("sample")), "gmap": gmap, "panel": panel}
        back = lambda df: df.join(central, "snp", "left_semi").join(F.broadcast(names), F.col("sample") == F.col("number")).drop("sample", "number", *{"own"} & set(names.columns)).withColumnRenamed("name", "sample")
        post, shares = em.impute_with_shares(numbered, sites, config, **more)
        post = back(post).persist()
        output(post, obs.drop("number"), out_sites, outputdir, config.output_format, back(shares) if config.output_haplotype_dosages else None)
        if genfile is not None:
            output_truth(post, out_sites, genfile, outputdir)
        if config.do_phasing:
            phased = back(em.phase(numbered, sites, config, **more)).persist()
            output_phased(phased, out_sites, outputdir)
            if phasefile is not None:
                output_phase_truth(phased, phasefile, outputdir)
            phased.unpersist()
        post.unpersist()
    for held in (obs, names, sites):
        held.unpersist()


def _scanned(spark: SparkSession, files: list[str], sites: DataFrame, config: Config, bam: bool, use_bx: bool, names_file: str | None, keep_list: str | None) -> tuple[DataFrame, DataFrame]:
    """((number, own, name), (sample, number, read, snp, bq)) of alignment files, both held."""
    if bam:
        ends = sites.groupBy("chr").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).first()
        near = (ends.chr, ends.lo - config.iSizeUpperLimit, ends.hi + config.iSizeUpperLimit)
        aligned, held = alignments.read_bam(spark, files, region=near), alignments.bam_samples(spark, files)
    else:
        aligned = alignments.read_sam(spark, files)
        held = aligned.select("sample")
    names = named_samples(spark, held, len(files), names_file, config, keep_list).persist()
    wanted = aligned.join(F.broadcast(names), F.col("sample") == F.col("own"), "left_semi")
    renamed = observations(wanted, sites, config, use_bx).join(F.broadcast(names), F.col("sample") == F.col("own"))
    return names, renamed.select(F.col("name").alias("sample"), "number", "read", "snp", "bq").persist()


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Impute genotypes from low-coverage reads.")
    for name in ("posfile", "outputdir"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--bamlist", default="")
    parser.add_argument("--samlist", default="")
    parser.add_argument("--outputInputInVCFFormat", action="store_true")
    parser.add_argument("--no_bx", action="store_true")
    for name in OPTIONAL:
        parser.add_argument(f"--{name}", default=None)
    for f in fields(Config):
        kind = str(f.type)
        if "tuple" in kind:
            parser.add_argument(f"--{f.name}", type=lambda x: tuple(int(i) for i in x.split(",") if i), default=f.default)
        elif "bool" in kind:
            parser.add_argument(f"--{f.name}", type=lambda x: x.lower() in ("true", "1"), default=f.default, metavar="TRUE|FALSE")
        else:
            required = f.name in ("K", "nGen")
            parser.add_argument(f"--{f.name}", type=float if "float" in kind else int if "int" in kind else str, required=required, default=None if required else f.default)
    x = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    listed = x.bamlist or x.samlist
    if not listed and not x.saved_inputs:
        parser.error("one of --bamlist, --samlist and --saved_inputs is needed")
    files = [r.value for r in spark.read.text(listed).collect() if r.value] if listed else []
    impute_files(spark, x.posfile, files, x.outputdir, Config(**{f.name: getattr(x, f.name) for f in fields(Config)}), bool(x.bamlist), x.outputInputInVCFFormat, not x.no_bx, **{n: getattr(x, n) for n in OPTIONAL})


if __name__ == "__main__":
    main()
