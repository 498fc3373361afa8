"""URL filters: rules, then naive Bayes over segmented host and path tokens.

Rules are (host, path) pairs: a rule fits its host and all subdomains if the
url's path starts with the rule's; the longest fitting rule decides. All other
urls are judged by a multinomial naive Bayes model. Its tokens are the words
of the host, concatenated names split by Viterbi over a unigram model, and the
words of the path; digits become one token.

Both models come from the table itself. A first unigram model counts what is
delimited by hyphens or stands in paths, whole labels that several hosts use,
and the runs of letters that ``COMMON`` different names have in common. The
model that is used counts the words into which the first one splits all
different names.

Nobody labels urls, so naive Bayes is learned by expectation maximisation from
first guesses, which weigh two things. One is learned: the words of a host that
no more than ``FEW`` hosts have, as a share of the host's letters. Where that
share is an outlier among all hosts (above the upper quartile by 1.5 times the
distance of the quartiles), the guess is higher. The share and the number of a
host's words are tokens too. The other is a short list of words; it is a prior
only, and may be empty. Then all tokens are counted, each url shared between the
two classes as the guess has it, and ``ROUNDS`` times anew, as the last model
has it. So words of no list come to speak against a url, and words of the list
lose their weight where their urls are like others. (Verdicts of the rules are
no examples: a rule takes a whole domain or path, so that all other pages of the
same hosts would follow it.)

All words and tokens count. Memory holds only the ``VOCABULARY`` most frequent
ones; the others stay DataFrames and are joined, rare words to the names that
hold them and rare tokens to the urls that have them. So results do not depend
on that number.

Defined results: a null url or one without ``://`` has empty host and path,
fits no rule, and is allowed (no tokens, nothing speaks against it); repeated
rows are judged alike; an empty table gives an empty result. Only the named
columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import math
import re
from collections import ChainMap
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Words that raise the first guess for a url, in host or path.
SEEDS = ("ad", "ads", "adult", "bet", "bets", "casino", "gambling", "loan", "loans", "malware", "pill", "pills", "porn", "poker", "sex", "spam", "tracker", "viagra", "warez", "xxx")
#: First guesses in thousandths: with such a word in the host, in the path only, of an outlier, of others; how often they are learned anew.
WITH, IN_PATH, OUTLIER, WITHOUT, ROUNDS = 900, 300, 100, 10, 1
#: Names that have a run of letters in common, for it to be a word; hosts that have a rare word; letters of the longest run.
COMMON, FEW, LONGEST_RUN = 3, 2, 8
#: Words, and tokens, that are held in memory; the others are joined.
VOCABULARY = 50_000
#: Rows of one host are dealt to so many places when names with rare words are joined.
SALTS = 32
#: A name: letters as the tokens have them.
LETTERS = r"[^\W\d_]+"
#: Longest word of the unigram model.
LONGEST = 24


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None)
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(rules[rule]).alias("verdict"))).otherwise(out)
    return out


class Words:
    """Unigram Viterbi segmentation of names."""

    def __init__(self, counts: dict[str, int], rest: int = 0) -> None:
        """``rest`` is the count of all words that ``counts`` leaves out."""
        self.total = sum(counts.values()) + rest + 1
        self.cost = {w: -math.log(n / self.total) for w, n in counts.items()}
        self.known: dict[str, list[str]] = {}

    def _unknown(self, n: int) -> float:
        """A word never seen gets less likely by ten for every letter."""
        return math.log(self.total) - math.log(10) + n * math.log(10)

    def split(self, name: str) -> list[str]:
        if name not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[name] = self.best(name, {})
        return self.known[name]

    def best(self, name: str, rare: dict[str, int]) -> list[str]:
        """The likeliest words of a name, with the counts of words of it that are not held in memory."""
        cost = ChainMap({w: -math.log(n / self.total) for w, n in rare.items()}, self.cost) if rare else self.cost
        best, back = [0.0] + [math.inf] * len(name), [0] * (len(name) + 1)
        for end in range(1, len(name) + 1):
            for start in range(max(0, end - LONGEST), end):
                total = best[start] + cost.get(name[start:end], self._unknown(end - start))
                if total < best[end]:
                    best[end], back[end] = total, start
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        return out[::-1]

    @staticmethod
    def runs(host: str) -> list[str]:
        """Names and numbers of a host."""
        return [run for label in host.split(":")[0].split(".") for run in re.findall(r"[^\W\d_]+|\d+", label)]

    def tokens(self, host: str, path: str, rare: dict[str, list[str]] | None = None) -> list[str]:
        """``rare`` has the words of names that rare words split otherwise."""
        out = []
        for run in self.runs(host):
            out += ["<digits>"] if run[0].isdigit() else (rare or {}).get(run) or self.split(run)
        for run in re.findall(r"[^\W\d_]+|\d+", path.lower()):
            out.append("/<digits>" if run[0].isdigit() else f"/{run}")
        return out


def common_runs(names: DataFrame) -> DataFrame:
    """(word, n): runs of two letters and more that are in n different names, where n is at least COMMON."""
    n = F.length("name")
    cut = lambda i: F.transform(F.sequence(F.lit(2), F.least(F.lit(LONGEST_RUN), n - i + 1)), lambda k: F.substring(F.col("name"), i, k))
    runs = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n - 1), cut)))
    return names.where(n >= 2).select(F.explode(runs).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)


def _model(counts: DataFrame, vocabulary: int) -> tuple[Words, DataFrame | None]:
    """The most frequent words of (word, n), and the rows of all others, if there are any."""
    first = lambda frame, n: {r["word"]: r["n"] for r in frame.orderBy(F.desc("n"), "word").limit(n).collect()}
    top = first(counts, vocabulary + 1)
    if len(top) <= vocabulary:
        return Words(top), None
    counts = checkpoint(counts)
    total, top = counts.agg(F.sum("n")).first()[0], first(counts, vocabulary)
    held = counts.sparkSession.createDataFrame([(w,) for w in top], "word string")
    return Words(top, total - sum(top.values())), counts.join(held, "word", "left_anti")


def learn_words(urls: DataFrame, vocabulary: int = VOCABULARY) -> tuple[Words, DataFrame | None]:
    """The words of the hosts of (host, path) rows: the most frequent, and (word, n) of all others, if there are any."""
    labels = urls.select("host", F.explode(F.split(F.regexp_replace("host", ":.*", ""), r"\.")).alias("label")).groupBy("label", "host").agg(F.count(F.lit(1)).alias("n"))
    letters = lambda c: F.split(c, "[^\\p{L}]+")
    split = labels.where(F.col("label").contains("-")).select(F.explode(letters("label")).alias("word"), "n")
    paths = urls.select(F.explode(letters(F.lower("path"))).alias("word"), F.lit(1).alias("n"))
    # A whole label counts where several hosts use it.
    shared = labels.where(~F.col("label").contains("-")).groupBy("label").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts")).where(F.col("hosts") >= COMMON).select(F.col("label").alias("word"), "n")
    names = checkpoint(labels.select(F.explode(F.array_distinct(F.regexp_extract_all("label", F.lit(f"(?U)({LETTERS})")))).alias("name")).distinct())
    seen = split.unionByName(paths).unionByName(shared).unionByName(common_runs(names))
    words, rare = _model(seen.where((F.col("word") != "") & (F.length("word") <= LONGEST)).groupBy("word").agg(F.sum("n").alias("n")), vocabulary)
    pieces = _split(names.select(F.col("name").alias("host")), words, rare).select(F.explode("words").alias("word"))
    return _model(pieces.where(F.length("word") <= LONGEST).groupBy("word").agg(F.count(F.lit(1)).alias("n")), vocabulary)


def rare_names(urls: DataFrame, words: Words, rare: DataFrame) -> DataFrame:
    """(host, names): names of hosts that are split otherwise with the rare words, as {name: words}."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(h, run) for h in b.column("host").to_pylist() for run in dict.fromkeys(words.runs(h)) if not run[0].isdigit()]
            yield pa.record_batch([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], names=["host", "name"])

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("name").to_pylist():
                found = {name[i:k] for i in range(len(name)) for k in range(i + 1, min(len(name), i + LONGEST) + 1)}
                found = sorted(w for w in found if w not in words.cost)
                yield pa.record_batch([pa.array([name] * len(found), pa.string()), pa.array(found, pa.string())], names=["name", "word"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = [(name, words.best(name, {x["word"]: x["n"] for x in found})) for name, found in zip(b.column("name").to_pylist(), b.column("found").to_pylist(), strict=True)]
            split = [(name, pieces) for name, pieces in split if pieces != words.split(name)]
            yield pa.record_batch([pa.array([x[0] for x in split], pa.string()), pa.array([x[1] for x in split], pa.list_(pa.string()))], names=["name", "pieces"])

    named = urls.select("host").distinct().mapInArrow(names, "host string, name string")
    within = named.select("name").distinct().mapInArrow(inner, "name string, word string")
    found = within.join(rare, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("found"))
    split = checkpoint(found.mapInArrow(again, "name string, pieces array<string>"))
    # A name that many hosts have is dealt with the hosts' hashes.
    salted = split.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = named.withColumn("salt", F.pmod(F.xxhash64("host"), F.lit(SALTS)).cast("int")).join(salted, ["name", "salt"])
    return met.groupBy("host").agg(F.collect_list(F.struct("name", "pieces")).alias("names"))


def _words_of(rows: DataFrame, words: Words, rare: DataFrame | None, *keys: str) -> DataFrame:
    """Add ``names`` (what rare words split otherwise) to rows with a host; ``keys`` tell the rows of one host apart."""
    if rare is None:
        return rows.withColumn("names", F.lit(None).cast("array<struct<name:string,pieces:array<string>>>"))
    named = rare_names(rows, words, rare).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int")
    return rows.withColumn("salt", salt).join(named, ["host", "salt"], "left").drop("salt")


def _split_by_rare(names: list[dict] | None) -> dict[str, list[str]]:
    return {x["name"]: x["pieces"] for x in names or []}


def _split(hosts: DataFrame, words: Words, rare: DataFrame | None) -> DataFrame:
    """(host, words): the words of different hosts, without numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[w for w in words.tokens(h, "", _split_by_rare(n)) if w != "<digits>"] for h, n in zip(b.column("host").to_pylist(), b.column("names").to_pylist(), strict=True)]
            yield pa.record_batch([b.column("host"), pa.array(found, pa.list_(pa.string()))], names=["host", "words"])

    return _words_of(hosts, words, rare, "host").mapInArrow(run, "host string, words array<string>")


def rare_shares(urls: DataFrame, words: Words, rare: DataFrame | None = None) -> DataFrame:
    """(host, share, words) of every host with a word: percent of its letters that are in words of FEW hosts at most, and how many words it has.

    Only rare words are joined to their hosts, of which each has a few, so no common word is a key of a join.
    """

    split = checkpoint(_split(urls.select("host").distinct(), words, rare).where(F.size("words") > 0))
    spread = split.select("host", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("hosts"), F.min("host").alias("a"), F.max("host").alias("b"))
    few = spread.where(F.col("hosts") <= FEW).select("word", F.explode(F.array_distinct(F.array("a", "b"))).alias("host")).groupBy("host").agg(F.collect_list("word").alias("few"))
    letters = lambda x: F.aggregate(x, F.lit(0), lambda n, w: n + F.length(w))
    seldom = F.when(F.col("few").isNull(), F.array().cast("array<string>")).otherwise(F.filter("words", lambda w: F.array_contains("few", w)))
    return split.join(few, "host", "left").select("host", F.floor(100 * letters(seldom) / letters(F.col("words"))).cast("int").alias("share"), F.size("words").alias("words"))


def fence(shares: DataFrame) -> float:
    """The share above which a host is an outlier; a count for each of 101 values reaches the driver."""
    counts = sorted((r["share"], r["n"]) for r in shares.groupBy("share").agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(n for _, n in counts)
    if not total:
        return 100.0
    at = lambda q: next(x for k, (x, _) in enumerate(counts) if 4 * sum(n for _, n in counts[: k + 1]) >= q * total)
    return at(3) + 1.5 * (at(3) - at(1))


def tokenized(urls: DataFrame, words: Words, rare: DataFrame | None = None, shares: DataFrame | None = None) -> DataFrame:
    """Add ``tokens`` and ``share`` to (page_id, host, path)."""
    kind = urls.schema["page_id"].dataType.simpleString()
    rows = _words_of(urls.select("page_id", "host", "path"), words, rare, "page_id", "path")
    if shares is None:
        rows = rows.withColumns({"share": F.lit(0), "words": F.lit(0)})
    else:
        salted = shares.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = lambda c: b.column(c).to_pylist()  # noqa: E731, B023
            tokens = []
            for h, p, n, share, count in zip(*map(column, ("host", "path", "names", "share", "words")), strict=True):
                found = words.tokens(h, p, _split_by_rare(n))
                tokens.append(found + ([f"<rare:{share // 10}>", f"<words:{count}>"] if count else []))
            yield pa.record_batch([*map(b.column, ("page_id", "host", "path")), pa.array(tokens, pa.list_(pa.string())), b.column("share")], names=["page_id", "host", "path", "tokens", "share"])

    columns = rows.select("page_id", "host", "path", "names", F.coalesce("share", F.lit(0)).alias("share"), F.coalesce("words", F.lit(0)).alias("words"))
    return columns.mapInArrow(run, f"page_id {kind}, host string, path string, tokens array<string>, share int")


def first_guess(tokens: Column, share: Column, above: float, seeds: tuple[str, ...] = SEEDS) -> Column:
    """How likely a url is one to block, in thousandths, before anything is learned."""
    listed = lambda before: F.arrays_overlap(tokens, F.array(F.lit(""), *(F.lit(before + w) for w in seeds)))
    return F.when(listed(""), WITH).when(listed("/"), IN_PATH).when(share > above, OUTLIER).otherwise(WITHOUT).cast("long")


def learn_bayes(guessed: DataFrame, vocabulary: int = VOCABULARY) -> tuple[float, dict[str, float], DataFrame | None]:
    """(prior log odds for blocking, log odds of the most frequent tokens, (token, odds) of all others, if there are any).

    Rows are (tokens, block), the latter in thousandths: whole numbers, so that sums do not depend on their order.
    The token "" is in every url once and counts the urls.
    """
    sums = F.sum("block").alias("block"), F.sum(1000 - F.col("block")).alias("allow")
    each = guessed.select("block", F.explode(F.array_append("tokens", "")).alias("token")).groupBy("token").agg(*sums)
    order = F.desc(F.col("token") == ""), F.desc(F.col("block") + F.col("allow")), "token"
    top, rest = each.orderBy(*order).limit(vocabulary + 2).collect(), None
    if len(top) > vocabulary + 1:
        each = checkpoint(each)
        top = each.orderBy(*order).limit(vocabulary + 1).collect()
        rest = each.join(each.sparkSession.createDataFrame([(r["token"],) for r in top], "token string"), "token", "left_anti")
    urls = (top[0]["block"], top[0]["allow"]) if top else (0, 0)
    more = rest.agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"), F.count(F.lit(1)).alias("kinds")).first() if rest is not None else {"block": 0, "allow": 0, "kinds": 0}
    kinds = len(top[1:]) + more["kinds"] + 1
    block, allow = (sum(r[c] for r in top[1:]) + (more[c] or 0) + 1000 * kinds for c in ("block", "allow"))
    odds = {r["token"]: math.log((r["block"] + 1000) / block) - math.log((r["allow"] + 1000) / allow) for r in top[1:]}
    prior = math.log((urls[0] + 1000) / (urls[1] + 1000))
    if rest is None:
        return prior, odds, None
    return prior, odds, rest.select("token", (F.log((F.col("block") + 1000) / block) - F.log((F.col("allow") + 1000) / allow)).alias("odds"))


def scored(tokens: DataFrame, prior: float, odds: dict[str, float], rare: DataFrame | None) -> DataFrame:
    """Add ``log_odds`` to every row of ``tokens``."""

    @F.arrow_udf("log_odds double, rest array<string>")
    def known(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            found = column.to_pylist()
            sums = pa.array([prior + sum(odds.get(t, 0.0) for t in each) for each in found], pa.float64())
            rest = pa.array([[t for t in each if t not in odds] for each in found], pa.list_(pa.string()))
            yield pa.StructArray.from_arrays([sums, rest], ["log_odds", "rest"])

    rows = tokens.withColumn("known", known("tokens")).select(*tokens.columns, "known.log_odds", "known.rest")
    if rare is None:
        return rows.drop("rest")
    # A rare token makes its urls rare, so no join here has a common key.
    has = F.size("rest") > 0
    sums = rows.where(has).select("host", "path", "rest").dropDuplicates(["host", "path"]).select("host", "path", F.explode("rest").alias("token")).join(rare, "token")
    # Added in order, so that a sum is the same each time.
    sums = sums.groupBy("host", "path").agg(F.aggregate(F.array_sort(F.collect_list("odds")), F.lit(0.0), lambda a, x: a + x).alias("more"))
    summed = rows.where(has).join(sums, ["host", "path"]).select(*tokens.columns, (F.col("log_odds") + F.col("more")).alias("log_odds"))
    return rows.where(~has).drop("rest").unionByName(summed)


def judge(pages: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url", vocabulary: int = VOCABULARY, rounds: int = ROUNDS, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """(page_id, host, path, rule, verdict, log_odds) of every row."""
    host, path = parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    words, rare = learn_words(urls, vocabulary)
    shares = checkpoint(rare_shares(urls, words, rare))
    tokens = checkpoint(tokenized(urls, words, rare, shares))
    model = learn_bayes(tokens.select("tokens", first_guess(F.col("tokens"), F.col("share"), fence(shares), seeds).alias("block")), vocabulary)
    for _ in range(rounds):
        share = F.round(1000 / (1 + F.exp(-F.col("log_odds")))).cast("long")
        model = learn_bayes(scored(tokens, *model).select("tokens", share.alias("block")), vocabulary)
    ruled = scored(tokens, *model).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    against = (F.col("log_odds") > 0) & (F.size("tokens") > 0)
    return ruled.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.when(against, "block").otherwise("allow")).alias("verdict"), "log_odds")
