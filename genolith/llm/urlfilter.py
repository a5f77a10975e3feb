"""URL filtering by explicit rules, and by association rules where none fits.

Pages that an explicit rule judges are the labels. Spark's FP-growth mines the token combinations of their urls together
with the verdict; rules that imply a verdict are kept by support and confidence, and those that a shorter rule makes needless
go. A page's tokens meet the rules in an inverted index under each rule's rarest token, and the rest of the rule is looked
up in the page's own tokens. The most confident rule decides, then the better supported, then block, then the lesser by
text; without any, the page is allowed.

Mining and matching look at all tokens of a url. Tokens that occur in exactly the same labelled urls say the same: they are one item while rules are mined, and a page has the item if it
has any of them, so that a site's path template costs one item, however many segments it has. An antecedent is of at most LONGEST items, a parameter. FP-growth lists all
itemsets, whose number may double with each item of a url; where labelled urls hold more than WIDEST items, antecedents are counted level by level instead, with the same result.

Support is a share of the labels, so that the number of rules doesn't grow with the pages; their bytes are counted before they are broadcast.

Cases: a null url, or one without ``://``, has empty host and path, no tokens and is allowed; without labels there are no
mined rules; repeated rows are judged alike; extra columns pass through.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import broadcast_if_small, free_name, lower_ascii, second_hash, written

#: The most items of an antecedent, and of a labelled url that FP-growth takes.
LONGEST, WIDEST = 3, 14


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of ``rules`` (verdict, host/path) that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for kind, name in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, start = name.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + start))
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: labels of the host, segments of the path, numbers by their first digit and length."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    segment = lambda x: F.when(F.rlike(x, F.lit(r"^\d+$")), F.concat(F.lit("n:"), F.substring(x, 1, 1), F.lit("x"), F.char_length(x).cast("string"))).otherwise(F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, F.transform(F.filter(F.split(lower_ascii(path), r"[/._\-]"), lambda x: x != ""), segment)))


def items_of(numbered: DataFrame, least: float) -> DataFrame:
    """(token, item): the tokens of at least ``least`` rows (row, tokens); item is the least token that is in exactly the same rows."""
    rows = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(second_hash(F.col("row"))).alias("y")]
    counted = numbered.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(*rows).filter(F.col("n") >= least)
    return counted.select("token", F.min("token").over(Window.partitionBy("n", "x", "y")).alias("item"))


def _by_growth(baskets: DataFrame, support: float, confidence: float) -> DataFrame:
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets.select(F.array_append("items", F.concat(F.lit("="), F.col("verdict"))).alias("items")))
    found = model.associationRules.filter(F.get("consequent", F.lit(0)).startswith("=")).filter(~F.exists("antecedent", lambda x: x.startswith("=")))
    return found.select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.get("consequent", F.lit(0)), 2, 100).alias("verdict"), "confidence", "support")


def _by_levels(baskets: DataFrame, support: float, confidence: float, longest: int) -> DataFrame:
    """As ``_by_growth``, of at most ``longest`` items: sets of a level extend those of the level before that are frequent and don't all have one verdict already."""
    total = baskets.count()
    least = support * total
    sets = baskets.select("items", "verdict", F.array().cast("array<string>").alias("antecedent"))
    found = None
    for level in range(1, longest + 1):
        later = F.filter("items", lambda x: F.coalesce(x > F.element_at("antecedent", -1), F.lit(True))) if level > 1 else F.col("items")
        sets = sets.select("items", "verdict", "antecedent", F.explode(later).alias("x")).select("items", "verdict", F.array_append("antecedent", F.col("x")).alias("antecedent"))
        each = sets.groupBy("antecedent", "verdict").agg(F.count(F.lit(1)).alias("k"))
        both = written(each.withColumn("n", F.sum("k").over(Window.partitionBy("antecedent"))).filter(F.col("n") >= least), "level")
        own = both.filter((F.col("k") >= least) & (F.col("k") / F.col("n") >= confidence)).select("antecedent", "verdict", (F.col("k") / F.col("n")).alias("confidence"), (F.col("k") / total).alias("support"))
        found = own if found is None else found.unionByName(own)
        if level < longest:
            open_sets = both.filter("k < n").select("antecedent").distinct()
            sets = written(sets.join(broadcast_if_small(open_sets), "antecedent", "left_semi"), "sets")
    return found


def mine(labelled: DataFrame, support: float, confidence: float, longest: int = LONGEST, widest: int = WIDEST) -> tuple[DataFrame, DataFrame]:
    """((antecedent, verdict, confidence, support), (token, item)) from rows with tokens and verdict; antecedents are of items."""
    spark = labelled.sparkSession
    if labelled.isEmpty():
        return spark.createDataFrame([], "antecedent array<string>, verdict string, confidence double, support double"), spark.createDataFrame([], "token string, item string")
    numbered = written(labelled.select(F.monotonically_increasing_id().alias("row"), "tokens", "verdict"), "labelled")
    # Tokens rarer than the support are in no rule; without them, no place in a url is cut off.
    items = written(items_of(numbered, support * numbered.count()), "items")
    kept = numbered.select("row", F.explode("tokens").alias("token")).join(broadcast_if_small(items), "token").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    baskets = written(numbered.select("row", "verdict").join(kept, "row", "left").select("verdict", F.coalesce("items", F.array().cast("array<string>")).alias("items")), "baskets")
    width = baskets.agg(F.max(F.size("items"))).first()[0]
    found = _by_growth(baskets, support, confidence).filter(F.size("antecedent") <= longest) if width <= widest else _by_levels(baskets, support, confidence, longest)
    rules = written(found, "rules")
    # A rule is needless if one with fewer items, all among its own, implies the same at least as surely.
    count = F.call_function("shiftleft", F.lit(1), F.size("antecedent"))
    subset = lambda n: F.filter("antecedent", lambda _, i: F.call_function("shiftright", n, i).bitwiseAND(F.lit(1)) == 1)
    shorter = rules.select("antecedent", "verdict", "confidence", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(count - 2, F.lit(1))), subset)).alias("short")).filter(F.size("short") < F.size("antecedent"))
    sure = rules.select(F.col("antecedent").alias("short"), "verdict", F.col("confidence").alias("c"))
    needless = shorter.join(sure, ["short", "verdict"]).filter("c >= confidence").select("antecedent", "verdict").distinct()
    return rules.join(needless, ["antecedent", "verdict"], "left_anti"), items


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], support: float = 0.005, confidence: float = 0.8, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict. ``rules``: (allow or block, host/path) of each explicit rule."""
    names = [free_name(pages, x) for x in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(url_col).alias("url")).distinct().select("url", host.alias("host"), path.alias("path"))
    urls = urls.filter(fitting(rules, F.col("host"), F.col("path"))[0].isNull()).select("url", tokens(F.col("host"), F.col("path")).alias("tokens"))
    all_labels = pages.select(host.alias("host"), path.alias("path"))
    all_labels = all_labels.select("host", "path", fitting(rules, F.col("host"), F.col("path"))[1].alias("verdict")).filter("verdict is not null")
    labelled = all_labels.select(tokens(F.col("host"), F.col("path")).alias("tokens"), "verdict")
    found, items = mine(labelled, support, confidence)
    mined = written(found, "mined")
    used = mined.select(F.explode("antecedent").alias("item")).distinct()
    known = written(items.join(used, "item"), "known")
    counts = labelled.select(F.explode("tokens").alias("token")).join(broadcast_if_small(known.filter("token = item")), "token").groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    rarest = mined.withColumn("item", F.explode("antecedent")).join(counts, "item").groupBy("antecedent", "verdict", "confidence", "support").agg(F.min_by("item", F.struct("n", "item")).alias("item"))
    index = written(rarest.select("item", "antecedent", F.struct("confidence", "support", (F.col("verdict") == "block").alias("b"), F.array_join("antecedent", " ").alias("text"), F.col("verdict").alias("v")).alias("best")), "index")
    held = urls.select("url", F.explode("tokens").alias("token")).join(broadcast_if_small(known), "token").groupBy("url").agg(F.collect_set("item").alias("items"))
    met = held.select("url", "items", F.explode("items").alias("item")).join(broadcast_if_small(index), "item").filter(F.size(F.array_except("antecedent", "items")) == 0)
    won = met.groupBy("url").agg(F.max("best")["v"].alias("won"))
    own_url, own_won, own_host, own_path = (free_name(pages, f"__{x}") for x in ("url", "won", "host", "path"))
    rows = pages.join(won.select(F.col("url").alias(own_url), F.col("won").alias(own_won)), F.col(url_col) == F.col(own_url), "left")
    h, p = host_and_path(F.col(url_col))
    own = rows.withColumns({own_host: h, own_path: p})
    rule, verdict = fitting(rules, F.col(own_host), F.col(own_path))
    return own.select(*(pages[c] for c in pages.columns), F.col(own_host).alias(names[0]), F.col(own_path).alias(names[1]), rule.alias(names[2]), F.coalesce(verdict, F.col(own_won), F.lit("allow")).alias(names[3]))


__all__ = ["filter_urls", "fitting", "host_and_path", "items_of", "mine", "tokens"]
