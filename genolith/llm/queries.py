"""The thin queries opN_<name>, each through its operator with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import audit, decontam, embeddings, langid, lines, mixing, quality, simhash, tokenstore, toxicity, urlfilter, warc, whitening
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, tau=3)


#: Rows that labels may be learned from are those whose remainder isn't HELD_OUT.
HELD_OUT = 2


def _remainder():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(_remainder() != HELD_OUT).select("doc_id", "text", "lang"))
    asked = docs.select("doc_id", F.coalesce(_remainder() == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return langid.identify(asked, model).drop("text")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs, min_chars=20, min_docs=3).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), size=10)
    return judged.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs.filter(_remainder() != HELD_OUT).select("doc_id", "text"), table(spark, sf_dir, "labels").filter(_remainder() != HELD_OUT))
    asked = docs.select("doc_id", F.coalesce(_remainder() == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return toxicity.score(asked, model).drop("text").withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sizes(docs, weights=(5, 2, 1), cap=3.0, block=64).select("doc_id", "size", "source_size", "target", "taken", "n_shards")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages").select("page_id", "url", "html"), min_bytes=0)


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), threshold=0.93)


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenstore.stored(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=16, scale=64, offset=1_000_000)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return audit.audit(docs, table(spark, sf_dir, "labels"), audit.text_filters(F.col("text")), copies="E")


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs.filter(_remainder() != HELD_OUT).select("doc_id", "text"), table(spark, sf_dir, "labels").filter(_remainder() != HELD_OUT))
    asked = docs.select("doc_id", F.coalesce(_remainder() == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return quality.score(asked, model).drop("text").withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


_OPERATORS = (
    op1_simhash, op2_language_id, op3_line_dedup, op4_url_filter, op5_decontamination, op6_toxicity, op7_source_mix, op8_warc, op9_embedding_dedup,
    op10_token_store, op11_whitening, op12_filter_audit, op13_quality,
)
QUERIES = {f.__name__: f for f in _OPERATORS}

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_ITEM_WORDS = r"list_filter(regexp_split_to_array(%s, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')" % _LOWER.format("coalesce(text, '')")

#: The 5 bits from bit 5 i of a SHA-1 in hexadecimal digits x.
_NIBBLE = "(instr('0123456789abcdef', substr(x, CAST(floor(5 * i / 4) AS INT) + {}, 1)) - 1)"
_FIVE = f"((({_NIBBLE.format(1)} * 16 + {_NIBBLE.format(2)}) >> (3 - 5 * i % 4)) & 31)"

ORACLE_SQL = {
    "op5_decontamination": f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + 9], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
spot AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM p))),
m AS (SELECT doc_id, item_id, s, n FROM spot JOIN p USING (phrase, n)),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op3_line_dedup": f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, {_LOWER.format(f"trim(line, {_WS})")} AS key FROM l),
h AS (SELECT key AS hot, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (hot IS NOT NULL AND doc_id <> keep) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (hot IS NULL OR doc_id = keep), '')) AS kept_sha256
FROM k LEFT JOIN h ON key = hot GROUP BY doc_id""",
    "op8_warc": f"""
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS x, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST({_FIVE} AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d""",
    "op9_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(e, lambda x: abs(x))) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, least(vec_id, coalesce(c, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a) USING (vec_id) LEFT JOIN (SELECT a AS vec_id, min(b) AS c FROM r GROUP BY a) USING (vec_id)""",
    "op12_filter_audit": """
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda y: y <> '') AS words FROM t),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS bad FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
  MAP {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words), 'C': 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 3 * length(x),
    'D': regexp_matches(x, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY x), false)} AS fails
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || d.c || e.c || g.c AS filter_order FROM c a, c b, c d, c e, c g WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
r AS (SELECT part, filter_order, CAST(step AS INT) AS step, filter_order[step] AS own,
  count(*) FILTER (NOT now AND NOT past) AS kept, count(*) FILTER (now AND NOT past) AS removed, count(*) FILTER (now AND past) AS redundant, count(*) FILTER (now AND every = 1) AS unique_fails,
  count(*) FILTER (now AND NOT past AND good = 1) AS good_lost, count(*) FILTER (now AND NOT past AND bad = 1) AS toxic_lost
  FROM (SELECT part, good, bad, filter_order, step, fails[filter_order[step]] AS now,
    len(list_filter(range(1, step), lambda i: fails[filter_order[i]])) > 0 AS past, len(list_filter(map_values(fails), lambda v: v)) AS every FROM f, s)
  GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r""",
}
