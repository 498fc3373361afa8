"""Quality rules with adaptive thresholds (DataFrame functions only).

Four ratios of every text are whole numbers in thousandths. Their quantile
sketches are counters per (language, source, ratio, bucket): merging two
sketches adds their counters, so they are built by one aggregation with
map-side combine and rolled up from source to language to the whole corpus.
Below ``FINE`` buckets are one thousandth wide, above they grow with the value
(a relative error of 1/FINE), so a sketch has a bounded number of counters.

A group's upper limit for a ratio is its third quartile plus ``SPREAD`` times
the distance between the quartiles, at least ``SLACK`` thousandths above the
third quartile; for the length of words there is a lower limit too. Groups of
fewer than ``LEAST`` texts use the sketch of their language, and languages of
fewer use that of the corpus. Verdicts come from joining texts with the limits
of their group.

Defined results: a null or blank text has no words, counts 0 everywhere and
fails the base rule; null languages and sources are groups of their own;
repeated rows are judged alike; an empty table gives an empty result. Only the
named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, BLANKS_CLASS, HAS_WORD, checkpoint

SYMBOLS = "#*$%&|<>"
#: In thousandths: the least distance of a limit from the quartile, per ratio.
SLACK = {"symbols": 30, "lines": 100, "repeats": 300, "length": 1500}
SPREAD = 3
LEAST = 50
FINE = 128
#: Parts of the key of large groups in the final join.
SALTS = 16


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words).

    Repeated windows are found by sorting 64-bit hashes of three words with
    their positions, only in texts in which some hash occurs twice.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), t.alias("t"))
    split = base.select(
        "doc_id",
        "lang",
        "source",
        F.filter(F.split("t", f"[{BLANKS_CLASS}]+"), lambda w: w != "").alias("words"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(HAS_WORD)).alias("lines"),
        F.length(F.translate("t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    counted = split.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("words") >= 3,
            F.zip_with(
                F.zip_with(F.expr("slice(words, 1, size(words) - 2)"), F.expr("slice(words, 2, size(words) - 2)"), lambda a, b: F.xxhash64(a, b)),
                F.expr("slice(words, 3, size(words) - 2)"),
                lambda ab, c: F.xxhash64(ab, c),
            ),
        ).alias("windows"),
    )
    twice = counted.select(
        *[c for c in counted.columns if c != "windows"],
        F.when(
            F.size("windows") > F.size(F.array_distinct("windows")),
            F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("s"),
    )
    at = "transform(filter(s, (x, k) -> (k > 0 and get(s, k - 1).h = x.h) or (k + 1 < size(s) and get(s, k + 1).h = x.h)), x -> x.i)"
    places = twice.select(*[c for c in twice.columns if c != "s"], F.sort_array(F.expr(at)).alias("p"))
    covered = "aggregate(p, named_struct('n', 0, 'end', -1), (a, i) -> named_struct('n', a.n + 3 - greatest(0, a.end - i + 1), 'end', i + 2), a -> a.n)"
    return places.select(*[c for c in places.columns if c != "p"], F.coalesce(F.expr(covered).cast("long"), F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    """The fixed base rule over the columns of ``features``."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _ratios() -> dict[str, Column]:
    per = lambda a, b: F.floor(F.col(a) * 1000 / F.greatest(F.col(b), F.lit(1))).cast("long")
    return {"symbols": per("n_symbols", "word_chars"), "lines": per("n_dup_lines", "n_words"), "repeats": per("n_repeat_words", "n_words"), "length": per("word_chars", "n_words")}


def _bucket(value: Column) -> Column:
    """The lower end of a value's bucket: exact below FINE, then 1/FINE of its power of two."""
    shift = F.greatest(F.length(F.bin(value)) - F.lit(FINE.bit_length()), F.lit(0)).cast("int")
    width = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
    return F.floor(value / width).cast("long") * width


def sketches(measured: DataFrame, group: list[str]) -> DataFrame:
    """Mergeable sketches: counters of (group, ratio, bucket)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("ratio"), _bucket(F.col(k)).alias("bucket")) for k in SLACK])).alias("pair")
    return measured.select(*group, pairs).groupBy(*group, "pair.ratio", "pair.bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(counters: DataFrame, group: list[str]) -> DataFrame:
    """Merge sketches into those of coarser groups."""
    return counters.groupBy(*group, "ratio", "bucket").agg(F.sum("n").alias("n"))


def limits(counters: DataFrame, group: list[str]) -> DataFrame:
    """One row a group: its number of texts, and low and high limits per ratio."""
    part = Window.partitionBy(*group, "ratio")
    upto = F.sum("n").over(part.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    summed = counters.select(*group, "ratio", "bucket", upto.alias("upto"), F.sum("n").over(part).alias("texts"))
    q = lambda quarter: F.min(F.when(F.col("upto") * 4 >= F.col("texts") * quarter, F.col("bucket")))
    quartiles = summed.groupBy(*group, "ratio").agg(q(1).alias("q1"), q(3).alias("q3"), F.max("texts").alias("texts"))
    slack = F.element_at(F.create_map(*[F.lit(x) for kv in SLACK.items() for x in kv]), F.col("ratio"))
    reach = F.greatest((F.col("q3") - F.col("q1")) * SPREAD, slack)
    ends = quartiles.select(*group, "ratio", "texts", (F.col("q3") + reach).alias("high"), (F.col("q1") - reach).alias("low"))
    pick = lambda k, end: F.max(F.when(F.col("ratio") == k, F.col(end))).alias(f"{k}_{end}")
    return ends.groupBy(*group).agg(F.max("texts").alias("texts"), *[pick(k, "high") for k in SLACK], pick("length", "low"))


LIMITS = [*[f"{k}_high" for k in SLACK], "length_low"]


def judge(docs: DataFrame, **columns: str) -> DataFrame:
    """``features`` of every text with ``base_failed`` and ``kept``."""
    measured = features(docs, **columns).withColumn("base_failed", base_failed())
    measured = measured.select("*", *[v.alias(k) for k, v in _ratios().items()])
    # A slim table of numbers, written once: the sketches and the join both read it.
    measured = checkpoint(measured.withColumns({"no_lang": F.col("lang").isNull(), "lang_key": F.coalesce("lang", F.lit("")), "no_source": F.col("source").isNull(), "source_key": F.coalesce("source", F.lit(""))}))
    lang, fine = ["no_lang", "lang_key"], ["no_lang", "lang_key", "no_source", "source_key"]
    of_group = sketches(measured, fine)
    of_lang = merge(of_group, lang)
    of_all = merge(of_lang, [])
    named = lambda d, p: d.select(*[c for c in d.columns if c not in LIMITS and c != "texts"], *[F.col(c).alias(f"{p}_{c}") for c in (*LIMITS, "texts")])
    table = named(limits(of_group, fine), "g").join(named(limits(of_lang, lang), "l"), lang).join(F.broadcast(named(limits(of_all, []), "a")), how="left")
    best = lambda c: F.when(F.col("g_texts") >= LEAST, F.col(f"g_{c}")).when(F.col("l_texts") >= LEAST, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}")).alias(c)
    table = table.select(*fine, *[best(c) for c in LIMITS])
    # The key is salted: a (language, source) pair may hold a third of all rows.
    salted = table.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    rows = measured.withColumn("salt", F.pmod(F.xxhash64("doc_id", "word_chars"), F.lit(SALTS)).cast("int"))
    good = F.col("length") >= F.col("length_low")
    for k in SLACK:
        good = good & (F.col(k) <= F.col(f"{k}_high"))
    return rows.join(salted, [*fine, "salt"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & good).alias("kept"))
