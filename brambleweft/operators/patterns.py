"""Many patterns against many texts: a regex join that compares only pairs with a literal in common.

A pattern can only be found in a text that has its required literals: runs of
plain characters outside groups, classes, alternatives and what a quantifier
makes optional. Of the runs of ``GRAM`` characters in a pattern's literals one is
its key: the one that fewest texts have. Texts and patterns are joined by kind
and key, dealt by the text as well since a run may be in a third of all texts,
and the regex is tried on these pairs alone. Patterns without such a literal have
to be tried on every text of their kind.

A pattern that has to begin with a literal is found by that whole literal where
few texts begin with it: runs of ``GRAM`` characters are shared by ever more
texts and patterns as both grow, and a text has one beginning of each length
where it has as many runs as characters.

Defined results: the first pattern by ``ord`` wins; null texts and patterns match
nothing; a pattern that is no regex is dropped, as its owner's rule has it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from ..session import checkpoint

GRAM = 3
#: Tasks that the texts of one key are dealt to.
SALTS = 16
#: A beginning is a pattern's key if one text in so many has it at most.
RARE = 1000


def required_literals(pattern: str) -> list[str]:
    """Texts that every match of a pattern contains; fewer than there are rather than one too many."""
    if re.search(r"\(\?[a-zA-Z-]+[:)]", pattern) or "\\Q" in pattern:
        return []  # letters of either case, comments and quotes are not read
    found, run, depth, i = [], "", 0, 0

    def end() -> None:
        nonlocal run
        if run:
            found.append(run)
        run = ""

    while i < len(pattern):
        c, size = pattern[i], 1
        if c == "\\":
            size, after = 2, pattern[i + 1 : i + 2]
            if depth == 0 and after and not after.isalnum():
                run += after
            elif depth == 0:
                end()
                size = len(re.match(r"\\(?:[pPx]\{[^}]*\}|u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|k<[^>]*>|0[0-7]{1,3}|c.|[0-9]+|.|$)", pattern[i:], re.DOTALL)[0])
        elif c == "[":
            end()
            size = _class(pattern[i:])
        elif c == "(":
            end()
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and depth == 0:
            return []
        elif depth == 0 and c in "*?{":
            run = run[:-1]  # the character before may be missing
            end()
            size = len(re.match(r"\{[^}]*\}|.", pattern[i:])[0])
        elif depth == 0 and c in "+.^$":
            end()
        elif depth == 0:
            run += c
        i += max(1, size)
    end()
    return found


def _class(rest: str) -> int:
    """The length of the character class that a text begins with; classes may be nested."""
    depth, i = 0, 0
    while i < len(rest):
        if rest[i] == "\\":
            i += 1
        elif rest[i] == "[":
            depth += 1
        elif rest[i] == "]" and not (i == 1 or rest[:i] == "[^"):
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return len(rest)


def beginning(pattern: str) -> tuple[str, str] | None:
    """The literal of GRAM characters or more that a pattern demands at the start of a text, and the rest of the pattern."""
    first = next(iter(required_literals(pattern)), "") if pattern.startswith("^") else ""
    at = 1
    for c in first:
        at += pattern[at : at + 1] == "\\"
        if pattern[at : at + 1] != c or (c in "*?{+.^$|()[" and pattern[at - 1] != "\\"):
            return None
        at += 1
    return (first, pattern[at:]) if len(first) >= GRAM else None


@F.pandas_udf(StringType())
def _beginning_of_pattern(patterns: pd.Series) -> pd.Series:
    return patterns.map(lambda p: (beginning(p) or [None])[0])


@F.pandas_udf(ArrayType(StringType()))
def _grams_of_pattern(patterns: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for column in patterns:
        literals = [required_literals(p) if p is not None else [] for p in column]
        yield pd.Series([list(dict.fromkeys(x[i : i + GRAM] for x in each for i in range(len(x) - GRAM + 1))) for each in literals])


def _grams(text: Column) -> Column:
    starts = F.when(F.length(text) >= GRAM, F.sequence(F.lit(1), F.length(text) - GRAM + 1))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, GRAM)))


def candidates(steps: DataFrame, patterns: DataFrame) -> DataFrame:
    """(step_id, text, ord, pattern, function): the pairs that a regex is tried on.

    Steps are (step_id, kind, text), patterns (kind, ord, pattern, function).
    """
    rule = ["kind", "ord", "pattern", "function"]
    named = checkpoint(patterns.where("pattern is not null").select(*rule, _grams_of_pattern("pattern").alias("grams"), _beginning_of_pattern("pattern").alias("head")))
    read = checkpoint(steps.where("text is not null").select("step_id", "kind", "text", F.pmod(F.xxhash64("step_id"), F.lit(SALTS)).cast("int").alias("salt")))
    begun, placed = _begun(read, named)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    key = ["kind", "hash", "salt"]
    by_head = begun.join(placed.where("rare").select(*rule, "hash", salts.alias("salt")), key).select("step_id", "kind", "salt", "ord", "pattern", "function")
    pairs = _held(read, placed.where("not rare and size(grams) > 0").select(*rule, "grams")).unionByName(by_head)
    bare = named.where(F.size("grams") == 0).select(*rule, salts.alias("salt"))
    met = pairs.join(read.select("step_id", "kind", "salt", "text"), ["step_id", "kind", "salt"])
    every = read.join(bare, ["kind", "salt"])
    columns = ["step_id", "text", "ord", "pattern", "function"]
    return met.select(*columns).unionByName(every.select(*columns))


def _begun(read: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(step_id, kind, salt, hash): texts by what they and some pattern begin with; and the patterns with ``hash`` and ``rare``.

    A pattern whose beginning no text has is dropped.
    """
    heads = named.where("head is not null").select("kind", F.length("head").alias("size"), F.xxhash64("head").alias("hash"))
    lengths = heads.groupBy("kind").agg(F.collect_set("size").alias("sizes"))
    cut = F.explode(F.filter("sizes", lambda n: n <= F.length("text")))
    starts = read.join(lengths, "kind").select("step_id", "kind", "salt", "text", cut.alias("size")).select("step_id", "kind", "salt", F.xxhash64(F.expr("left(text, size)")).alias("hash"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    begun = checkpoint(starts.join(heads.select("kind", "hash").distinct().withColumn("salt", salts), ["kind", "hash", "salt"], "left_semi"))
    counts = begun.groupBy("kind", "hash").agg(F.count(F.lit(1)).alias("n"))
    hashed = named.withColumn("hash", F.xxhash64("head")).join(counts, ["kind", "hash"], "left")
    rare = F.col("head").isNotNull() & (F.col("n") * RARE <= read.count())
    return begun, checkpoint(hashed.where("head is null or n is not null").select(*named.columns, "hash", rare.alias("rare")))


def _held(read: DataFrame, named: DataFrame) -> DataFrame:
    """(step_id, kind, salt, ord, pattern, function): texts that hold a pattern's rarest run of GRAM characters."""
    asked = named.select("kind", F.explode("grams").alias("gram")).distinct()
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    texts = read.join(named.select("kind").distinct(), "kind", "left_semi")
    held = texts.select("step_id", "kind", "salt", F.explode(_grams(F.col("text"))).alias("gram")).join(asked.withColumn("salt", salts), ["kind", "gram", "salt"], "left_semi")
    common = held.groupBy("kind", "gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = named.select("kind", "ord", "pattern", "function", F.explode("grams").alias("gram")).join(common, ["kind", "gram"], "left")
    keyed = rarest.groupBy("kind", "ord", "pattern", "function").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("key"))
    keyed = keyed.where("key.n > 0").select("kind", "ord", "pattern", "function", F.col("key.gram").alias("gram"), salts.alias("salt"))
    return held.join(keyed, ["kind", "gram", "salt"]).select("step_id", "kind", "salt", "ord", "pattern", "function")


@F.pandas_udf(BooleanType())
def _is_regex(patterns: pd.Series) -> pd.Series:
    import regex

    @lru_cache(1 << 12)
    def good(p: str) -> bool:
        try:
            regex.compile(p)
        except regex.error:
            return False
        return True

    # A literal at the start does not decide it: patterns that differ only there are compiled once.
    bare = patterns.map(lambda p: "^x" + found[1] if (found := beginning(p)) else p)
    return bare.map(good)


def first_matches(steps: DataFrame, patterns: DataFrame) -> DataFrame:
    """(step_id, function): each step with the first pattern of its kind that is found in its text."""
    found = candidates(steps, patterns.where("pattern is not null").where(_is_regex("pattern"))).where(F.expr("text rlike pattern"))
    return found.groupBy("step_id").agg(F.min_by("function", "ord").alias("function"))
