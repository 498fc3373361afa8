"""Fill-in-the-middle transformation by lookaround splitting (DataFrame functions only).

A unit grammar of one or two character classes is translated to a zero-width
regex: a place is a boundary if the class before it and the class after it say
that one unit ends and the next begins. Spark's ``split`` at that regex keeps
every character, so the pieces are the units; an empty text has none and is
handled apart, since ``split`` gives it one empty piece.

Where a text is cut, and which form it gets, is drawn from the sha256 of the
seed and the row's key, so reruns and retried tasks agree and no row needs
another: there is no shuffle, and a task holds one text at a time.

Defined results: a null text is the empty text; a null key is drawn like the
empty key; empty texts and texts that hold a mark stay plain; texts of any
length are cut whole; repeated rows are transformed alike; an empty table gives
an empty result. The input's columns travel in one struct and cannot clash.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
LINES = r"[^\n]*\n|[^\n]+"
WORDS = r"\s*\S+|\s+"
SENTENCES = r"[^.!?]*[.!?]+|[^.!?]+"

_CLASS = r"\[\^?(?:\\.|[^\]\\])+\]|\\."


def _not(cls: str) -> str:
    """The other characters than those of a class."""
    if cls.startswith("["):
        return f"[{cls[2:]}" if cls[1] == "^" else f"[^{cls[1:]}"
    return f"\\{cls[1].swapcase()}" if cls[1] in "sSdDwW" else f"[^{cls}]"


def _same(a: str, b: str) -> bool:
    bare = lambda c: c[1:-1] if re.fullmatch(r"\[\\.\]", c) else c
    return bare(a) == bare(b)


def boundary(grammar: str) -> str:
    """The zero-width regex of the places between two units of a grammar.

    Grammars, over a class A and the class B of all other characters:
    ``A*B|A+`` (one B ends a unit), ``A*B+|A+`` (a run of B ends it),
    ``A+B*|B+`` (a run of A begins it), ``A+|B+`` (runs of either).
    """
    shapes = (
        (rf"(?P<a>{_CLASS})\*(?P<b>{_CLASS})\|(?P=a)\+", r"(?<={b})(?=[\s\S])"),
        (rf"(?P<a>{_CLASS})\*(?P<b>{_CLASS})\+\|(?P=a)\+", r"(?<={b})(?={a})"),
        (rf"(?P<a>{_CLASS})\+(?P<b>{_CLASS})\*\|(?P=b)\+", r"(?<={b})(?={a})"),
        (rf"(?P<a>{_CLASS})\+\|(?P<b>{_CLASS})\+", r"(?<={a})(?={b})|(?<={b})(?={a})"),
    )
    for shape, at in shapes:
        if (found := re.fullmatch(shape, grammar)) and _same(_not(found["a"]), found["b"]):
            return at.format(a=found["a"], b=found["b"])
    raise ValueError(f"not a grammar over one class and its complement: {grammar}")


def units(text: Column, grammar: str = LINES) -> Column:
    """The units of a text, in order; none for the empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 from the sha256 of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", grammar: str = LINES, seed: int = 7, rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """(row, n, form, prefix, middle, suffix, output) of every row; the three parts are null where the form is plain.

    Of 100 rows ``rate`` are transformed, and of 100 of these ``spm`` get the
    form spm (suffix first), the others psm. A mark begins with a character
    that is nowhere else in it, so that ``restore`` finds it again.
    """
    if len(set(marks)) < 3 or any(len(m) < 2 or m[0] in m[1:] or m[0] != marks[0][0] for m in marks):
        raise ValueError("marks must differ, and begin with the same character, which is nowhere else in them")
    p, s, m = map(F.lit, marks)
    texts = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[h.alias(f"h{i + 1}") for i, h in enumerate(draws(F.col(id_col), seed))])
    cut = texts.withColumn("units", units(F.col("text"), grammar)).withColumn("n", F.size("units").cast("long"))
    ends = [F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")]
    plain = (F.col("text") == "") | F.col("text").contains(p) | F.col("text").contains(s) | F.col("text").contains(m) | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    placed = cut.select("row", "text", "units", "n", form.alias("form"), F.least(*ends).cast("int").alias("a"), F.greatest(*ends).cast("int").alias("b"))
    part = lambda start, end: F.when(F.col("form") != "plain", F.array_join(F.slice("units", start + 1, end - start), ""))
    parts = placed.select("row", "text", "n", "form", part(F.lit(0), F.col("a")).alias("prefix"), part(F.col("a"), F.col("b")).alias("middle"), part(F.col("b"), F.col("n").cast("int")).alias("suffix"))
    output = F.when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).when(F.col("form") == "spm", F.concat(s, "suffix", p, "prefix", m, "middle")).otherwise(F.col("text"))
    return parts.select("row", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text again, from an output and its form alone."""
    pieces = F.split(output, "|".join(re.sub(r"([^\w])", r"\\\1", m) for m in marks), -1)
    order = lambda first, last: F.concat(F.get(pieces, F.lit(first)), F.get(pieces, F.lit(3)), F.get(pieces, F.lit(last)))
    return F.when(form == "psm", order(1, 2)).when(form == "spm", order(2, 1)).otherwise(output)
