"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fill_middle, langid, lexical, line_dedup, mixing, piece_bpe, quality_cnn, quality_rules, sharding, shingle_join, topk, url_filter
from .common import table, word_count


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The text's hash tells rows without an id apart.
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    drawn = mixing.systematic_copies(docs, "doc_id", "source", F.col("size"))
    return drawn.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return done.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.md5("text").alias("text_md5"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shingle_join.classes(table(spark, sf_dir, "documents").select("doc_id", "text"), size=4, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


#: The rules of the query: the longest that fits decides.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op9_shard_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = sharding.number_slots(sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return slots.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.digests(table(spark, sf_dir, "documents"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size, digest = lambda c: F.length(c).cast("long"), lambda c: F.sha2(c, 256)
    restored = fill_middle.restore(F.col("output"), F.col("form"))
    return done.select(F.col("row.doc_id").alias("doc_id"), "n", "form", size("prefix").alias("prefix_chars"), size("middle").alias("middle_chars"), digest("output").alias("output_sha256"), digest(restored).alias("restored_sha256"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_mix_sources": op2_mix_sources,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_line_dedup": op4_line_dedup,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_quality_rules": op6_quality_rules,
    "op7_url_filter": op7_url_filter,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_shard_keys": op9_shard_keys,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_lexical_search": op11_lexical_search,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_fill_middle": op13_fill_middle,
}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = rf"""
WITH d AS (SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source, len({WORDS})::BIGINT AS size FROM documents),
s AS (SELECT no_source, source, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, ((row_number() OVER (ORDER BY no_source, source) - 1) % 3 + 1) AS weight, 3 * source_size AS cap FROM s),
r AS (SELECT *, cap::DOUBLE / weight AS ratio FROM w),
l AS (SELECT *, row_number() OVER o AS turn,
        (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
      FROM r WINDOW o AS (ORDER BY ratio, no_source, source)),
f AS (SELECT arg_min(level, turn) AS level, min(turn) AS turn FROM l WHERE ratio >= level),
t AS (SELECT no_source, source, source_size, CASE WHEN l.turn >= f.turn THEN weight * f.level ELSE cap::DOUBLE END AS target FROM l, f),
p AS (SELECT d.*, row_number() OVER (PARTITION BY no_source, source
        ORDER BY lpad(length(bin(size))::VARCHAR, 2, '0') || substr(bin(size), 1, 4), substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2), size, doc_id) AS rank FROM d),
e AS (SELECT p.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS expected,
        (('0x' || substr(md5('mix:' || source), 1, 3))::BIGINT + 0.5::DOUBLE) / 4096 AS u FROM p JOIN t USING (no_source, source)),
c AS (SELECT *, (floor(u + rank * expected) - floor(u + (rank - 1) * expected))::BIGINT AS copies FROM e)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM c
"""

OP4 = rf"""
WITH d AS (SELECT doc_id, text, source, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, text, source, unnest(range(len(lines))) AS pos, trim(unnest(lines), E' \t\n\x0b\x0c\r') AS line FROM d),
x AS (SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
b AS (SELECT line, min((doc_id, pos)) AS first FROM x GROUP BY line HAVING count(DISTINCT source) >= 4),
cut AS (SELECT doc_id, list(pos) AS cut FROM x JOIN b USING (line) WHERE (doc_id, pos) IS DISTINCT FROM first GROUP BY doc_id),
j AS (SELECT d.*, coalesce(len(cut), 0)::BIGINT AS n_removed, coalesce(cut, []) AS cut,
        len(list_filter(lines, lambda a: regexp_matches(a, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines FROM d LEFT JOIN cut USING (doc_id))
SELECT doc_id, n_lines, n_removed, md5(CASE WHEN n_removed = 0 THEN text WHEN n_removed >= n_lines THEN ''
  ELSE array_to_string(list_filter(lines, lambda a, i: NOT list_contains(cut, i - 1)), chr(10)) END) AS text_md5 FROM j
"""

OP6 = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
g AS (SELECT *, CASE WHEN len(w) >= 3 THEN [(w[i], w[i+1], w[i+2]) for i in range(1, len(w) - 1)] ELSE [] END AS grams,
       list_filter(string_split(text, chr(10)), lambda a: regexp_matches(a, '[^\x20\x09-\x0D]')) AS lines FROM d),
o AS (SELECT doc_id, unnest(grams) AS gram, unnest(range(len(grams))) AS spot FROM g),
p AS (SELECT doc_id, spot FROM o QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
n AS (SELECT doc_id, count(DISTINCT spot + k)::BIGINT AS n_repeat_words FROM p, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words,
       length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
       (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
       (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM g LEFT JOIN n USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       n_symbols * 1000 // greatest(word_chars, 1) AS symbols, n_dup_lines * 1000 // greatest(n_words, 1) AS lines,
       n_repeat_words * 1000 // greatest(n_words, 1) AS repeats, word_chars * 1000 // greatest(n_words, 1) AS length FROM m),
u AS (UNPIVOT (SELECT doc_id, lang, source, symbols, lines, repeats, length FROM v) ON symbols, lines, repeats, length INTO NAME ratio VALUE x),
b AS (SELECT *, (x >> greatest(length(bin(x)) - 8, 0)::INT) << greatest(length(bin(x)) - 8, 0)::INT AS bucket FROM u),
cg AS (SELECT 1 AS level, lang, source, ratio, bucket, count(*) AS n FROM b GROUP BY ALL UNION ALL
       SELECT 2, lang, NULL, ratio, bucket, count(*) FROM b GROUP BY ALL UNION ALL
       SELECT 3, NULL, NULL, ratio, bucket, count(*) FROM b GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, ratio ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, ratio) AS texts FROM cg),
q AS (SELECT level, lang, source, ratio, min(bucket) FILTER (upto * 4 >= texts) AS q1, min(bucket) FILTER (upto * 4 >= texts * 3) AS q3, max(texts) AS texts FROM r GROUP BY ALL),
e AS (SELECT *, q3 + greatest((q3 - q1) * 3, s) AS high, q1 - greatest((q3 - q1) * 3, s) AS low
      FROM q JOIN (VALUES ('symbols', 30), ('lines', 100), ('repeats', 300), ('length', 1500)) AS k(ratio, s) USING (ratio)),
t AS (SELECT doc_id, bool_and(CASE WHEN g.texts >= 50 THEN b.x <= g.high AND (b.ratio <> 'length' OR b.x >= g.low)
        WHEN h.texts >= 50 THEN b.x <= h.high AND (b.ratio <> 'length' OR b.x >= h.low)
        ELSE b.x <= a.high AND (b.ratio <> 'length' OR b.x >= a.low) END) AS good
      FROM b JOIN e AS g ON g.level = 1 AND g.ratio = b.ratio AND g.lang IS NOT DISTINCT FROM b.lang AND g.source IS NOT DISTINCT FROM b.source
      JOIN e AS h ON h.level = 2 AND h.ratio = b.ratio AND h.lang IS NOT DISTINCT FROM b.lang
      JOIN e AS a ON a.level = 3 AND a.ratio = b.ratio GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND good AS kept FROM v JOIN t USING (doc_id)
"""

_DRAW = "-1.0::DOUBLE / ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || {i}::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"
OP9 = rf"""
WITH poly AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce([b::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b))),
d AS (SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS h FROM documents),
y AS (SELECT doc_id, text, len(h) // 2 AS bytes, [('0x' || substr(h, 2 * i + 1, 2))::BIGINT for i in range(len(h) // 2)] AS b FROM d),
k AS (SELECT doc_id, (bytes + 8)::BIGINT AS size, CASE WHEN text IS NULL THEN NULL
        ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, z: xor(t[(xor(c, z) & 255) + 1], c >> 8)), 4294967295) END AS text_crc32 FROM y, poly),
r AS (SELECT *, row_number() OVER () AS rid FROM k),
s AS (SELECT rid, i, {_DRAW.format(i="i")} AS draw FROM r, (SELECT unnest(range(25)) AS i)),
a AS (SELECT rid, arg_max(i, (draw, -i)) FILTER (i < 24) AS shard, arg_max(i, (draw, -i)) AS grown_shard FROM s GROUP BY rid)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(coalesce(doc_id::VARCHAR, concat_ws(':', size, text_crc32))), 1, 2), doc_id NULLS FIRST, size, text_crc32 NULLS FIRST) - 1 AS slot,
  grown_shard::INT AS grown_shard FROM r JOIN a USING (rid)
"""

OP10 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

OP5 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] for i in range(1, len(w) - 2)]) END AS s FROM d),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) + any_value(b.n) - count(*) AS n_union, count(*) AS n_both FROM t AS a JOIN t AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT u, v FROM p WHERE 100 * n_both >= 85 * n_union UNION ALL SELECT v, u FROM p WHERE 100 * n_both >= 85 * n_union),
r AS (WITH RECURSIVE r(u, v) AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u) SELECT u, min(v) AS v FROM r GROUP BY u)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(r.v, s.doc_id)) AS component_id FROM s LEFT JOIN r ON r.u = s.doc_id
"""

_TERMS = r"list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS.replace("list_distinct", "")} AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, greatest(1, sum(len(t)))::BIGINT AS n_terms FROM d),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
p AS (SELECT rid, any_value(doc_id) AS doc_id, term, count(*) AS tf, any_value(n) AS n
      FROM (SELECT rid, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY rid, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY term),
s AS (SELECT item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY item_id, rid, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""

OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[^
]*
|[^
]+') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle, coalesce(array_to_string(u[b + 1:n], ''), '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""

ORACLE_SQL = {"op11_lexical_search": OP11, "op13_fill_middle": OP13, "op5_ngram_jaccard_join": OP5, "op10_exact_top_k": OP10, "op2_mix_sources": OP2, "op4_line_dedup": OP4, "op6_quality_rules": OP6, "op9_shard_keys": OP9}
