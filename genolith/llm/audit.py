"""Interaction of filters: what each of them removes, alone and behind others, in every order.

A document's failures are a mask, one bit a filter. Counts by part and mask, and those of labelled documents, are all that orders
need: per part they are three integer rows (all, good, toxic) of 2^k entries, and every count of every order and step is their product with
constant matrices of 2^k x (k! k) zeros and ones (``matrices``; 32 x 600 for five filters).

Filters are conditions of a row, given as columns; one more finds texts that equal the text of any smaller id of the table. Texts are
compared by SHA-256, and move no further than the scan: what is shuffled has some 60 bytes a document. Copies are counted before they meet, first by
id, then by text, so that a text of a third of all rows is a row or two of each task.

Cases: null text is empty, null part the empty string; of an id's labels a 1 counts if any row has it; labels without id, or of unknown
ids, count for nothing; a row without id has no labels, is no copy, and makes no copy of another; rows that repeat an id are documents of
their own, and none is a copy of the other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WS, written

#: The most filters of an audit: 2^k x (k! k) must stay small.
MOST = 6
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_filters(text: Column, least_words: int = 200, distinct_percent: int = 50, capitals_percent: int = 3, symbols: str = "#$%&*|") -> dict[str, Column]:
    """Conditions of failure: A too few words, B too few distinct words, C too many capitals, D a symbol."""
    text = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(text, F.lit(WS))
    words, none = F.split(trimmed, f"[{WS}]+"), (trimmed == "").cast("int")  # of no words, the split makes an empty one
    n, distinct = F.size(words) - none, F.size(F.array_distinct(words)) - none
    return {
        "A": n < least_words,
        "B": 100 * distinct.cast("long") < distinct_percent * n.cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > capitals_percent * F.char_length(text).cast("long"),
        "D": F.rlike(text, F.lit("[" + "".join("\\" + c for c in symbols) + "]")),
    }


def histograms(docs: DataFrame, filters: dict[str, Column], labels: DataFrame, copies: str | None = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each mask, and those of them labelled good (quality 1) and toxic (toxic 1). Bit i is the
    i-th filter in the order of names; ``copies`` is the name of the filter of repeated texts, None for none."""
    names = sorted([*filters, *([copies] if copies else [])])
    if not 0 < len(names) <= MOST or copies in filters:
        raise ValueError(f"from 1 to {MOST} filters, of different names")
    mask = sum((F.coalesce(c, F.lit(False)).cast("int") * (1 << names.index(name)) for name, c in filters.items()), F.lit(0))
    text = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    seen = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), mask.alias("mask"), text.alias("text"))
    seen = written(seen.groupBy("id", "part", "mask", "text").agg(F.count(F.lit(1)).alias("n")), "masks")
    is_one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    # Rows without id would all meet in one task of the join.
    named = seen.filter("id is not null").join(known, "id", "left").select("id", "part", "mask", "text", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    every = named.unionByName(seen.filter("id is null").select("*", F.lit(0).alias("good"), F.lit(0).alias("toxic")))
    if copies:
        every = _copies(every, 1 << names.index(copies))
    total = lambda c: F.sum(F.col("n") * F.col(c))
    return every.groupBy("part", "mask").agg(F.sum("n").alias("n"), total("good").alias("good"), total("toxic").alias("toxic"))


def _copies(rows: DataFrame, bit: int) -> DataFrame:
    """``rows`` counted by text, with ``bit`` in the mask of those that have another's text and no least id."""
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    unnamed = F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0))
    own = rows.groupBy("text", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), unnamed.alias("unnamed"), least.alias("least"))
    first = F.col("least.id") == F.min("least.id").over(Window.partitionBy("text"))  # some rows a text: parts and labels
    first = F.col("unnamed") + F.when(first, F.col("least.n")).otherwise(0)
    split = own.withColumn("first", first).select("part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("first").alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - F.col("first")).alias("n")))).alias("x"))
    return split.select("part", "good", "toxic", "x.mask", "x.n").filter("n > 0")


def matrices(k: int) -> dict[str, np.ndarray]:
    """[mask, order * k + step] of zeros and ones: is a document of that mask kept after the step, removed there, failing but removed
    before, failing that filter alone. Orders are the permutations of the filters, as they come by name."""
    fails = (np.arange(1 << k)[:, None] >> np.arange(k) & 1).astype(bool)  # [mask, filter]
    orders = np.array(list(permutations(range(k))))
    own = fails[:, orders]  # [mask, order, step]
    gone = np.maximum.accumulate(own, axis=2)
    before = np.concatenate([np.zeros_like(gone[:, :, :1]), gone[:, :, :-1]], axis=2)
    found = {"kept": ~gone, "removed": own & ~before, "redundant": own & before, "unique_fails": own & (fails.sum(axis=1) == 1)[:, None, None]}
    return {name: x.reshape(1 << k, -1).astype(np.int64) for name, x in found.items()}


def outcomes(found: DataFrame, names: str) -> DataFrame:
    """(part, filter_order, step, and COUNTS) from ``histograms``: a row for each part, order of the filters ``names`` and step."""
    k, letters = len(names), sorted(names)
    orders = ["".join(x) for x in permutations(letters)]
    # A part's rows are at most 2^k.
    rows = found.groupBy("part").agg(F.collect_list(F.struct(F.col("mask").cast("long").alias("mask"), "n", "good", "toxic")).alias("h"))
    at = np.array(list(permutations(range(k)))).ravel()  # the filter of each column

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = matrices(k)
        for batch in batches:
            lists = batch.column(1)
            owner, cells = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten()
            stacked = np.zeros((3, batch.num_rows, 1 << k), np.int64)
            mask, *values = (cells.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            for kind, x in zip(stacked, values):
                np.add.at(kind, (owner, mask), x)
            n, good, toxic = stacked
            counts = {name: n @ by[name] for name in ("kept", "removed", "redundant", "unique_fails")}
            counts |= {"good_lost": good @ by["removed"], "toxic_lost": toxic @ by["removed"]}
            shares = np.zeros((batch.num_rows, k), np.int64)
            np.add.at(shares, (slice(None), at), counts["removed"])
            counts["shapley"] = shares[:, at]
            for i, part in enumerate(batch.column(0).to_pylist()):
                columns = [pa.array([part] * len(at)), pa.array(np.repeat(orders, k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(counts[name][i]) for name in COUNTS], ["part", "filter_order", "step", *COUNTS])

    return rows.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{name} long" for name in COUNTS))


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, copies: str | None = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The outcomes of ``filters`` (those of ``text_filters`` if none are given) and of repeated texts, in all orders, for each part of ``docs``."""
    filters = text_filters(F.col(text_col)) if filters is None else filters
    return outcomes(histograms(docs, filters, labels, copies, id_col, text_col, part_col), "".join([*filters, copies or ""]))
