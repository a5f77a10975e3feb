"""Line deduplication over whole corpora, in DataFrame functions alone.

Lines explode to 128-bit hashes, the text itself moves once (the join that brings a document its dropped positions).
A line's documents are counted in two steps, first by (line, document), then by line, so that a line shared by a third
of all rows is pre-aggregated on many tasks; repeated lines are written, so that the join back to the lines has plain
exchanges on both sides, which Spark's skew-join handling can split.

Cases: a null or empty text is one empty line. Rows that repeat a ``doc_id`` count as one document. A row without
``doc_id`` isn't a document: it keeps all its lines and counts for none. Extra columns pass through; output names that
clash get underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import WS, free_name, lower_ascii, second_hash, written


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(WS)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h1, h2, keep): hashes of line keys found in at least ``min_docs`` documents, and the largest of their ids."""
    return _exploded(docs, min_chars, id_col, text_col).groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keep")).filter(F.col("n") >= min_docs).select("h1", "h2", "keep")


def _exploded(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each line that is long enough: id, row (a hash of the text), pos, h1, h2."""
    keys = F.transform(_lines(F.col(text_col)), line_key)
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.posexplode(keys).alias("pos", "key"))
    return rows.filter(F.char_length("key") >= min_chars).select("id", "row", "pos", F.xxhash64("key").alias("h1"), second_hash(F.col("key")).alias("h2"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped`` (longs)."""
    hot = written(repeated_lines(docs, min_chars, min_docs, id_col, text_col), "lines")
    hits = _exploded(docs, min_chars, id_col, text_col).join(hot, ["h1", "h2"]).filter("id != keep")
    own_id, own_row, own_drops, own_hash = (free_name(docs, f"__{x}") for x in ("id", "row", "drops", "hash"))
    drops = hits.groupBy(F.col("id").alias(own_id), F.col("row").alias(own_row)).agg(F.collect_set("pos").alias(own_drops))
    kept, n, nd = (free_name(docs, x) for x in ("kept_text", "n_lines", "n_dropped"))
    rows = docs.withColumn(own_hash, F.xxhash64(text_col)).join(drops, (F.col(id_col) == F.col(own_id)) & (F.col(own_hash) == F.col(own_row)), "left")
    lines = _lines(F.col(text_col))
    whole = F.coalesce(F.col(text_col), F.lit(""))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(own_drops))
    rest = F.when(F.col(own_drops).isNull(), whole).otherwise(F.array_join(F.transform(stay, lambda p: F.get(lines, p)), "\n"))
    return rows.select(*(docs[c] for c in docs.columns), rest.alias(kept), F.size(lines).cast("long").alias(n), F.coalesce(F.size(own_drops), F.lit(0)).cast("long").alias(nd))
