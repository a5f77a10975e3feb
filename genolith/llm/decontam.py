"""Benchmark decontamination over a distributed positional inverted index, in DataFrame functions alone.

1. Test items become windows of ``size`` consecutive words (an item of fewer words is one window).
2. One pass over the corpus counts the occurrences of the test items' terms, pre-aggregated before the shuffle.
3. A second pass stores the postings (term, document, position) of every term that is one of the two rarest of some window.
4. The list of a window's rarest term is intersected with that of the second rarest, adjusted by the offset between the two. Windows that share
   both terms and the offset, as neighbouring windows of an item do, share this work. What is left are candidate starts.
5. The lists of all terms in the candidates' documents are made, and each candidate is intersected with those of its window's terms, each
   adjusted by its offset: those that all lists hold are exact phrase matches. ``proximity_matches`` asks for the same terms in any
   order.
6. Matches of a document are united into hit positions.

What is broadcast is measured in bytes first, and joined by shuffle if it is large. A hot passage spreads over the partitions of its postings,
which are by document and position.

Cases: null text has no words; a document or item without words matches nothing; repeated items count as one item id;
repeated rows of a document are judged alike and returned each; rows without doc_id are judged too (as one id, by their
text); an empty benchmark hits nothing. Extra columns pass through; names that clash get underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import broadcast_if_small, discard, free_name, lower_ascii, second_hash, written

#: What separates words, after A-Z are lower-cased; a word holds digits, a-z and all beyond ASCII.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def windows(items: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, phrase): the distinct windows of each item; phrase is an array of at most ``size`` words."""
    w = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))
    return w.select("item", F.explode(starts).alias("s"), "w").select("item", F.slice("w", F.col("s"), size).alias("phrase")).distinct()


def term_counts(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n) for the given terms: their occurrences in the whole corpus."""
    found = docs.select(F.explode(words(F.col(text_col))).alias("term")).join(broadcast_if_small(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def _key(id_col: str, text_col: str) -> Column:
    """What names a document: its id and a hash of its text. Nulls inside of structs are equal in joins."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"))


def postings(docs: DataFrame, terms: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, doc, pos) for each word of the documents (one of ``terms``, if given); pos counts from 0."""
    each = docs.select(_key(id_col, text_col).alias("doc"), F.posexplode(words(F.col(text_col))).alias("pos", "term"))
    return (each if terms is None else each.join(broadcast_if_small(terms), "term")).select("term", "doc", "pos")


def probed(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """``phrases`` (p, phrase) with term and place (the rarest term and its first place), term2 and gap (the second rarest, and its place
    beyond the first's; null if the window has one term alone)."""
    each = phrases.select("p", F.posexplode("phrase").alias("place", "term")).join(broadcast_if_small(counts), "term")
    ranked = each.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("n", "term", "place"))).alias("by"))
    one = F.get("by", F.lit(0))
    two = F.get(F.filter("by", lambda x: x["term"] != one["term"]), F.lit(0))
    return ranked.select("p", F.size("by").alias("n"), one["term"].alias("term"), one["place"].alias("place"), two["term"].alias("term2"), (two["place"] - one["place"]).alias("gap"))


def phrase_matches(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", exact: bool = True, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, id, row, start, n): the windows found in the documents, by place of their first word and their length.

    With ``exact`` false, a match is any span of a window's length that holds its words in any order.
    """
    wins = written(windows(items, size, item_id, item_text).select("item", "phrase", F.struct(F.xxhash64("phrase").alias("h1"), second_hash(F.col("phrase")).alias("h2")).alias("p")), "windows")
    phrases = written(wins.select("p", "phrase").distinct(), "phrases")
    terms = written(phrases.select(F.explode("phrase").alias("term")).distinct(), "terms")
    probes = written(probed(phrases, written(term_counts(docs, terms, text_col), "counts")), "probes")
    rare = written(probes.select(F.explode(F.array("term", "term2")).alias("term")).filter("term is not null").distinct(), "rare")
    lists = written(postings(docs, rare, id_col, text_col), "postings")
    second = lists.select(F.col("term").alias("term2"), "doc", F.col("pos").alias("pos2"))

    if exact:
        ways = broadcast_if_small(written(probes.select("term", "term2", "gap").distinct(), "ways"))
        first = lists.join(ways, "term").withColumn("pos2", F.col("pos") + F.col("gap"))
        met = first.filter("term2 is not null").join(second, ["term2", "doc", "pos2"]).unionByName(first.filter("term2 is null"))
        of = broadcast_if_small(probes).select("p", "n", "place", *[F.col(c).alias(f"own_{c}") for c in ("term", "term2", "gap")])
        starts = met.join(of, [F.col(c).eqNullSafe(F.col(f"own_{c}")) for c in ("term", "term2", "gap")]).select("p", "doc", (F.col("pos") - F.col("place")).alias("start"), "n").filter("start >= 0")
    else:
        spans = lists.join(broadcast_if_small(probes), "term").withColumn("start", F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - F.col("n") + 1), F.col("pos"))))
        near = spans.filter("term2 is not null").join(second, ["term2", "doc"]).filter("pos2 >= start and pos2 < start + n").drop("pos2")
        starts = near.unionByName(spans.filter("term2 is null")).select("p", "doc", "start", "n").distinct()
    starts = written(starts, "starts")

    holders = written(starts.select("doc").distinct(), "holders")
    own = docs.withColumn(of := free_name(docs, "of"), _key(id_col, text_col)).join(broadcast_if_small(holders), F.col(of) == F.col("doc"), "left_semi")
    within = postings(own.select(id_col, text_col).distinct(), None, id_col, text_col)
    if exact:
        asked = starts.join(broadcast_if_small(phrases), "p").select("p", "doc", "start", "n", F.posexplode("phrase").alias("place", "term")).withColumn("pos", F.col("start") + F.col("place"))
        found = asked.join(within, ["doc", "pos", "term"]).groupBy("p", "doc", "start", "n").agg(F.count(F.lit(1)).alias("held")).filter("held = n")
    else:
        asked = starts.withColumn("pos", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)))
        held = asked.join(within, ["doc", "pos"]).groupBy("p", "doc", "start", "n").agg(F.array_sort(F.collect_list("term")).alias("held"))
        found = held.join(broadcast_if_small(phrases), "p").filter(F.col("held") == F.array_sort("phrase"))
    matches = written(found.select("p", "doc", "start", "n").join(broadcast_if_small(wins).select("p", "item"), "p").select("item", "doc.id", "doc.row", "start", "n"), "matches")
    discard(lists, starts, holders)
    return matches


def proximity_matches(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """As ``phrase_matches``, in any order of the words."""
    return phrase_matches(docs, items, size, exact=False)


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with n_words, n_hit, n_items (longs) and items (sorted array of strings)."""
    found = phrase_matches(docs, items, size, id_col, text_col)
    names = [free_name(docs, x) for x in ("n_words", "n_hit", "n_items", "items")]
    own, doc, hit = (free_name(docs, x) for x in ("own", "of", "hit"))
    places = F.flatten(F.transform(F.collect_set(F.struct("start", "n")), lambda x: F.sequence(x["start"], x["start"] + x["n"] - 1)))
    hits = found.groupBy(F.struct("id", "row").alias(doc)).agg(F.size(F.array_distinct(places)).alias(hit), F.array_sort(F.collect_set(F.col("item").cast("string"))).alias(hit + "_items"))
    # Words are counted before the join, so that texts that nobody asks for don't move.
    rows = docs.withColumn(own, _key(id_col, text_col)).withColumn(names[0], F.size(words(F.col(text_col))).cast("long"))
    return rows.join(hits, F.col(own) == F.col(doc), "left").select(
        *(docs[c] for c in docs.columns),
        names[0],
        F.coalesce(hit, F.lit(0)).cast("long").alias(names[1]),
        F.coalesce(F.size(hit + "_items"), F.lit(0)).cast("long").alias(names[2]),
        F.coalesce(hit + "_items", F.array().cast("array<string>")).alias(names[3]),
    )


def clean_documents(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a window of an item."""
    own, doc = free_name(docs, "own"), free_name(docs, "of")
    hits = written(phrase_matches(docs, items, size, id_col, text_col).select(F.struct("id", "row").alias(doc)).distinct(), "hits")
    return docs.withColumn(own, _key(id_col, text_col)).join(broadcast_if_small(hits), F.col(own) == F.col(doc), "left_anti").select(*docs.columns)
