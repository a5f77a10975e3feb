"""Mixing sources to target weights, in DataFrame functions alone.

1. Sizes (words) sum by source; targets follow the weights and stop at ``cap`` times the source, by water-filling in
   closed form over the table of sources.
2. The words of a source, document after document, are packed into blocks of ``block`` words. Documents stand in an
   order given by hash buckets of a few thousand rows, so that the running sums need no task that sees a whole source:
   sums inside a bucket, then sums over the buckets.
3. A source's target gives its number of blocks; the last is cut where the target ends. How many of them each output shard gets is one multinomial
   draw per source: a table of counts by source and shard, whose sums are checked against the targets (independent draws per shard
   would miss a small source's target by the square root of its blocks).
4. The slots come from that table, shard after shard. Slot j of a source takes block perm(j mod n) of pass j div n, perm being a pseudorandom
   permutation of the source's block indices for this pass (Feistel rounds on two mixed radices, walked until in range), and joins the
   blocks by index.

No block is taken more than ``cap`` times (rounded up), and past whole passes only up to the target, so no document exceeds ``cap`` times
its size. All draws are hashes of the seed, source rank and slot: reruns agree.

Cases: null text has size 0; null source is a source of its own, last in order; sources of size 0 have target 0; an
empty table gives no rows; repeated rows are separate documents; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WS, free_name, written

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a hash bucket, about; slots that one row explodes to.
BUCKET, CHUNK = 1024, 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """``sizes`` (one row per source: k, source, source_size) with rank (from 0), weight and target.

    The windows run over the table of sources, a row for each. Sorted by cap/weight, the capped sources come first;
    the first one that stays below its cap fixes the level that all later ones share.
    """
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("rank"), F.lit(len(weights))))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("weight", w).withColumn("most", cap * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    before = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0.0))
    level = (F.sum("source_size").over(every) - before("most")) / (F.sum("weight").over(every) - before("weight"))
    leveled = ranked.withColumn("own", level).withColumn("level", F.min(F.when(F.col("most") >= F.col("own") * F.col("weight"), F.struct(F.col("most") / F.col("weight"), "rank", "own"))).over(every)["own"])
    return leveled.withColumn("target", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most")))).select("k", "source", "source_size", "rank", "weight", "target")


def permuted(i: Column, n: Column, *key: Column) -> Column:
    """The image of i under a pseudorandom permutation of 0..n-1 that ``key`` chooses."""
    a = F.ceil(F.sqrt(n)).cast("long")
    b = F.ceil(n / a).cast("long")

    def rounds(x: Column) -> Column:
        pair = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, b).alias("r"))

        def step(p: Column, j: Column) -> Column:
            left = F.pmod(p["l"] + F.pmod(F.xxhash64(j, p["r"], *key), a), a)
            right = F.pmod(p["r"] + F.pmod(F.xxhash64(j, p["l"], *key), b), b)
            return F.when(j % 2 == 0, F.struct(left.alias("l"), p["r"].alias("r"))).otherwise(F.struct(p["l"].alias("l"), right.alias("r")))

        return F.aggregate(F.sequence(F.lit(0), F.lit(5)), pair, step, lambda p: p["l"] * b + p["r"])

    # Fewer than a of the a*b pairs are out of range, so a walk of 32 steps ends for a <= 32, and else all but surely.
    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), rounds(i), lambda x, _: F.when(x < n, x).otherwise(rounds(x)))


def placed(docs: DataFrame, seed: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents, sources), both written: id, row (a hash of the text), k, n (which of equal rows), size and offset
    among the words of its source; k, source, source_size."""
    k = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    rows = written(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), k.alias("k"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size")), "sizes")
    sources = written(rows.groupBy("k", "source").agg(F.sum("size").alias("source_size")), "sources")
    buckets = max(1, -(-rows.count() // BUCKET))
    dealt = rows.drop("source").withColumn("bucket", F.pmod(F.xxhash64("id", "row", F.lit(seed)), F.lit(buckets)).cast("int"))
    inside = Window.partitionBy("k", "bucket").orderBy("id", "row", "size")
    summed = dealt.withColumn("n", F.row_number().over(inside)).withColumn("in", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    base = dealt.groupBy("k", "bucket").agg(F.sum("size").alias("all")).withColumn("base", F.sum("all").over(Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("all"))
    return written(summed.join(base, ["k", "bucket"]).select("id", "row", "k", "bucket", "n", "size", (F.col("in") + F.col("base")).alias("offset")), "placed"), sources


def shard_counts(aims: DataFrame, block: int, seed: int, per_shard: int = 4096) -> DataFrame:
    """(k, rank, blocks, slots, cut, shard, n, first): how many of a source's slots each output shard gets, a multinomial draw, and the first of
    them; cut is how many words the last slot of a source takes. ``aims``: as of targets()."""
    blocks, size, target = F.ceil(F.col("source_size") / block).cast("long"), F.col("source_size"), F.round(F.col("target")).cast("long")
    whole = F.floor(target / size).cast("long")
    more = target - whole * size
    drawn = aims.filter("source_size > 0").select("k", "rank", blocks.alias("blocks"), (whole * blocks + F.ceil(more / block).cast("long")).alias("slots"), F.when(more % block > 0, more % block).otherwise(F.lit(block)).cast("int").alias("cut")).filter("slots > 0")
    shards = drawn.agg(F.greatest(F.lit(1), F.ceil(F.sum("slots") / per_shard)).alias("shards"))
    chunks = drawn.crossJoin(F.broadcast(shards)).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(CHUNK).cast("long"))))  # shards has one row
    spread = int(aims.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = chunks.repartition(spread, "k", "from").withColumn("slot", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + CHUNK, F.col("slots")) - 1)))
    by = each.groupBy("k", "rank", "blocks", "slots", "cut", F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), "rank", "slot"), F.col("shards")).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    past = F.sum("n").over(Window.partitionBy("k").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy("k"))
    checked = F.when(total == F.col("slots"), F.col("n")).otherwise(F.raise_error(F.lit("the shards' counts of a source miss its target")).cast("long"))
    return by.withColumn("first", past - F.col("n")).withColumn("n", checked)


def slots(counts: DataFrame, block: int, seed: int) -> DataFrame:
    """A row for each slot of the mix: k, shard, slot, pass, index (of the block) and most (the words it takes). ``counts``: as of
    shard_counts()."""
    spread = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = counts.withColumn("from", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1, F.lit(CHUNK).cast("long")))).repartition(spread, "k", "from")
    each = chunks.withColumn("slot", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + CHUNK, F.col("first") + F.col("n")) - 1)))
    turn = F.floor(F.col("slot") / F.col("blocks")).cast("int")
    most = F.when(F.col("slot") == F.col("slots") - 1, F.col("cut")).otherwise(F.lit(block)).alias("most")
    return each.select("k", "shard", "slot", turn.alias("pass"), permuted(F.pmod("slot", F.col("blocks")), F.col("blocks"), F.lit(seed), F.col("rank"), turn).alias("index"), most)


def _pieces(rows: DataFrame, block: int) -> DataFrame:
    """A row for each block that a document has words in: with index, start and words (inside the document) and at (inside the block)."""
    last = F.col("offset") + F.col("size")
    cut = rows.filter("size > 0").withColumn("index", F.explode(F.sequence(F.floor(F.col("offset") / block), F.floor((last - 1) / block))))
    start = F.greatest(F.col("offset"), F.col("index") * block)
    return cut.withColumn("start", (start - F.col("offset")).cast("int")).withColumn("words", (F.least(last, (F.col("index") + 1) * block) - start).cast("int")).withColumn("at", (start - F.col("index") * block).cast("int"))


def mix_blocks(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, block: int = 64, seed: int = 7) -> DataFrame:
    """The mix itself: shard, slot, source key k and, for each of the block's documents, id, start and words."""
    # Spark takes the slots for as few rows as they come from, and would broadcast them: hence the hints here and below.
    rows, sources = placed(docs, seed)
    counts = written(shard_counts(written(targets(sources, weights, cap), "targets"), block, seed), "shards")
    inside = _pieces(rows, block).groupBy("k", "index").agg(F.array_sort(F.collect_list(F.struct("offset", "id", "start", "words", "at"))).alias("pieces"))
    taken = F.transform(F.filter("pieces", lambda p: p["at"] < F.col("most")), lambda p: F.struct(p["id"].alias("id"), p["start"].alias("start"), F.least(p["words"], F.col("most") - p["at"]).alias("words")))
    return slots(counts, block, seed).hint("merge").join(inside, ["k", "index"]).select("shard", "k", "slot", "pass", "index", taken.alias("pieces"))


def mix_sizes(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, block: int = 64, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: id_col, row, size, source_size, target, taken, n_shards (in how many output shards any of its words are) and parts (array of
    start, words, times) by start."""
    rows, sources = placed(docs, seed, id_col, text_col, source_col)
    aims = written(targets(sources, weights, cap), "targets")
    counts = written(shard_counts(aims, block, seed), "shards")
    times = slots(counts, block, seed).groupBy("k", "index").agg(F.count(F.lit(1)).cast("int").alias("times"), F.min("most").alias("most"), F.collect_set("shard").alias("shards"))
    # The cut slot takes the first words of its block; those after are taken once less.
    within = F.least("words", F.greatest(F.lit(0), F.col("most") - F.col("at")))
    both = F.array(F.struct("start", within.alias("words"), "times"), F.struct((F.col("start") + within).alias("start"), (F.col("words") - within).alias("words"), (F.col("times") - 1).alias("times")))
    cut = _pieces(rows, block).join(times.hint("merge"), ["k", "index"]).withColumn("both", F.filter(both, lambda p: (p["words"] > 0) & (p["times"] > 0))).filter(F.size("both") > 0)
    words = F.aggregate("both", F.lit(0), lambda n, p: n + p["words"] * p["times"])
    shards = F.size(F.array_distinct(F.flatten(F.collect_list("shards"))))
    taken = cut.groupBy("k", "bucket", "n").agg(F.sum(words).cast("long").alias("taken"), shards.alias("n_shards"), F.array_sort(F.flatten(F.collect_list("both"))).alias("parts"))
    every = rows.join(taken, ["k", "bucket", "n"], "left").join(aims.select("k", "source_size", "target"), "k")
    return every.select(F.col("id").alias(id_col), "row", "k", "offset", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("n_shards", F.lit(0)).alias("n_shards"), "parts")


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, block: int = 64, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` mixed, with its columns: a row for each time that any of a document's words are taken.

    The c-th row of a document holds the words taken at least c times, with the white space that follows them; if
    those are all its words, its text as it was. Documents of which nothing is taken go. The column n_chars, if any,
    is counted anew.
    """
    group, own, k, row, n, c, text = (free_name(docs, x) for x in ("group", "own", "of", "row", "nth", "copy", "mixed"))
    sizes = mix_sizes(docs, weights, cap, block, seed, id_col, text_col, source_col).filter("taken > 0")
    parts = written(sizes.groupBy(F.struct(F.col(id_col).alias("id"), "row", "k").alias(group)).agg(F.array_sort(F.collect_list(F.struct("offset", "size", "parts"))).alias(own)), "parts")
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    rows = docs.withColumn(k, F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), key.alias("k")))
    # Equal rows take their shares one by one; where there are none, texts move once less.
    several = not parts.filter(F.size(own) > 1).isEmpty()
    rows = rows.withColumn(n, F.row_number().over(Window.partitionBy(k).orderBy(F.lit(0))) if several else F.lit(1))
    both = rows.join(parts, F.col(k) == F.col(group)).withColumn(own, F.get(own, F.col(n) - 1)).filter(F.col(own).isNotNull())
    copies = both.withColumn(c, F.explode(F.sequence(F.lit(1), F.array_max(f"{own}.parts.times"))))
    mine = F.filter(f"{own}.parts", lambda p: p["times"] >= F.col(c))
    size = F.aggregate(mine, F.lit(0), lambda s, p: s + p["words"])
    tokens = F.regexp_extract_all(F.col(text_col), F.lit(rf"({WORD}[{WS}]*)"), 1)
    cut = F.when(size == F.col(f"{own}.size"), F.col(text_col)).otherwise(F.rtrim(F.array_join(F.flatten(F.transform(mine, lambda p: F.slice(tokens, p["start"] + 1, p["words"]))), "")))
    out = copies.withColumn(text, cut)
    chars = F.char_length(text).cast("long")
    return out.select(*[F.col(text).alias(x) if x == text_col else chars.alias(x) if x == "n_chars" else F.col(x) for x in docs.columns])


__all__ = ["mix_blocks", "mix_documents", "mix_sizes", "permuted", "placed", "shard_counts", "slots", "targets", "words"]
