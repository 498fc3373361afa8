"""Line dedup by distinct-site spread (DataFrame functions only).

A line is boilerplate when it stands on at least ``min_sites`` distinct sites.
Lines are compared without the blanks around them and by two hashes (96 bits).

1. Lines are counted per site, which merges a common line's occurrences before
   anything is shuffled by line. A line that occurs fewer than ``min_sites``
   times cannot reach that many sites and is done.
2. HyperLogLog sketches of the sites, one per remaining line, are built by
   aggregation (partial sketches merge before the shuffle).
3. Lines whose estimate is within ``MARGIN`` of the threshold, relative to it,
   get an exact distinct count; the others are clearly above or below.
4. Every boilerplate line is removed from all documents, except where it
   first occurs (smallest document id), so no text leaves the corpus.

Texts are split, cut and put together within their row. Joins by line are
salted, since a single line may be in a third of all documents or sites.

Defined results: lines without a word are never removed; null texts stay null;
a null site is not counted as a site; a null id sorts first; repeated rows lose
the same lines; a text of which all lines with words are removed is emptied.
The input's columns travel in one struct and cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, HAS_WORD, checkpoint

MIN_SITES = 4
#: Relative distance from the threshold within which estimates are not trusted:
#: more than five standard errors of a sketch with 2**LG_K registers.
MARGIN = 0.2
LG_K = 11
SALTS = 32


def _lines(rows: DataFrame) -> DataFrame:
    """(id, th, site, pos, h, m) of every line that has a word."""
    trim = lambda x: F.btrim(x, F.lit(BLANKS))
    each = rows.select("id", "th", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(HAS_WORD))
    line = trim(F.col("line"))
    return each.select("id", "th", "site", "pos", F.xxhash64(line).alias("h"), F.hash(line).alias("m"))


def _salted(keys: DataFrame) -> DataFrame:
    return keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h, m) of the boilerplate lines."""
    key = ["h", "m"]
    counted = lines.groupBy(*key, "site").agg(F.count(F.lit(1)).alias("n"))
    often = counted.groupBy(*key).agg(F.sum("n").alias("n")).where(F.col("n") >= min_sites).select(*key)
    sited = counted.where(F.col("site").isNotNull()).select(*key, "site", F.pmod(F.xxhash64("site"), F.lit(SALTS)).cast("int").alias("salt"))
    near = sited.join(_salted(often), [*key, "salt"], "left_semi")
    spread = near.groupBy(*key).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("about"))
    low, high = min_sites * (1 - MARGIN), min_sites * (1 + MARGIN)
    close = spread.where(F.col("about").between(low, high)).select(*key)
    # One row for each line and site: counting rows counts sites.
    exact = near.join(_salted(close), [*key, "salt"], "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("sites"))
    return spread.join(exact, key, "left").where(F.coalesce(F.col("sites") >= min_sites, F.col("about") > high)).select(*key)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(row, text, n_lines, n_removed): the input's row, its new text, and counts."""
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(site_col).cast("string").alias("site")).withColumn("th", F.xxhash64("text"))
    lines = _lines(packed)
    spots = lines.withColumn("salt", F.pmod(F.col("pos") + F.col("th"), F.lit(SALTS)).cast("int"))
    found = checkpoint(spots.join(_salted(boilerplate(lines, min_sites)), ["h", "m", "salt"]))
    first = found.groupBy("h", "m").agg(F.min(F.struct("id", "th", "pos")).alias("first"))
    hits = found.join(_salted(first), ["h", "m", "salt"]).where(~F.struct("id", "th", "pos").eqNullSafe(F.col("first")))
    cut = hits.groupBy("id", "th").agg(F.collect_set("pos").alias("cut")).select(F.col("id").alias("cut_id"), F.col("th").alias("cut_th"), "cut")
    joined = packed.join(cut, packed["id"].eqNullSafe(cut["cut_id"]) & (packed["th"] == cut["cut_th"]), "left")
    parts = joined.select("row", "text", "cut", F.split("text", "\n").alias("lines"))
    n_lines = F.size(F.filter("lines", lambda x: x.rlike(HAS_WORD))).cast("long")
    rest = F.array_join(F.filter("lines", lambda x, i: ~F.array_contains("cut", i)), "\n")
    emptied = F.size("cut") >= n_lines
    text = F.when(F.col("cut").isNull(), F.col("text")).when(emptied, F.lit("")).otherwise(rest)
    return parts.select("row", text.alias("text"), F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(n_lines).alias("n_lines"), F.coalesce(F.size("cut"), F.lit(0)).cast("long").alias("n_removed"))
