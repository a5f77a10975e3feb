"""Phred scores, genotype likelihoods and their text forms, as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def alt_prob(bq: Column) -> Column:
    """P(read | alternative allele) of a signed score: negative saw the reference, positive the alternative allele."""
    e = F.pow(F.lit(10.0), -F.abs(bq) / 10.0)
    return F.when(bq > 0, 1 - e).otherwise(e / 3)


def ref_prob(bq: Column) -> Column:
    e = F.pow(F.lit(10.0), -F.abs(bq) / 10.0)
    return F.when(bq < 0, 1 - e).otherwise(e / 3)


def phred_likelihoods(logs: list[Column]) -> list[Column]:
    """-10 log10 of each likelihood over the greatest, rounded half to even; ``logs`` are natural logarithms."""
    top = F.greatest(*logs)
    return [F.bround(-10 * (x - top) / F.log(F.lit(10.0)), 0).cast("long") for x in logs]


def posteriors(logs: list[Column]) -> list[Column]:
    """Likelihoods scaled to sum 1."""
    top = F.greatest(*logs)
    scaled = [F.exp(x - top) for x in logs]
    return [x / (scaled[0] + scaled[1] + scaled[2]) for x in scaled]


def best_call(gp: list[Column]) -> Column:
    """Index of the greatest of three posteriors, ties to the lowest."""
    return F.when((gp[0] >= gp[1]) & (gp[0] >= gp[2]), 0).when(gp[1] >= gp[2], 1).otherwise(2)


def called(gp: list[Column], least: float = 0.9) -> Column:
    """Genotype text; ./. below the least posterior."""
    text = F.element_at(F.array(F.lit("0/0"), F.lit("0/1"), F.lit("1/1")), best_call(gp) + 1)
    return F.when(F.greatest(*gp) >= least, text).otherwise("./.")


def genotype_cell(gp: list[Column], hd: Column | None = None) -> Column:
    """``GT:GP:DS[:HD]`` with three decimals."""
    cell = F.concat(called(gp), F.format_string(":%.3f,%.3f,%.3f:%.3f", *gp, gp[1] + 2 * gp[2]))
    return cell if hd is None else F.concat(cell, F.lit(":"), F.array_join(F.transform(hd, lambda x: F.format_string("%.3f", x)), ","))


def pileup_cell(depths: list[Column], pl: list[Column]) -> Column:
    """``./.:AD:PL``, or ./. without reads."""
    text = F.format_string("./.:%d,%d:%d,%d,%d", *depths, *pl)
    return F.when(depths[0] + depths[1] > 0, text).otherwise("./.")
