"""Scalar functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of 64-bit FNV-1a.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


#: Half of a 64-bit number.
LIMB = 0xFFFFFFFF


def _times_prime(h: Column) -> Column:
    """h times the prime, modulo 2**64: by halves, since a product of 64-bit numbers overflows under ANSI.

    The prime is 2**40 + 435, so the halves are multiplied by 435 and the lower one is added to the upper, moved by 8.
    """
    small = FNV_PRIME - (1 << 40)
    low, high = h.bitwiseAND(F.lit(LIMB)) * small, F.shiftrightunsigned(h, 32) * small
    moved = F.shiftleft(h.bitwiseAND(F.lit(LIMB)), 8).bitwiseAND(F.lit(LIMB))
    upper = (high + F.shiftrightunsigned(low, 32) + moved).bitwiseAND(F.lit(LIMB))
    return F.shiftleft(upper, 32).bitwiseOR(low.bitwiseAND(F.lit(LIMB)))


def fnv1a_64(data: Column) -> Column:
    """64-bit FNV-1a of a string's UTF-8 bytes, as a signed number; null for null.

    Bytes are taken one at a time from the binary, so nothing is held per byte
    but its number. Where this very hash is not asked for, ``xxhash64`` is faster.
    """
    raw, basis = F.encode(data.cast("string"), "UTF-8"), F.lit(FNV_BASIS - (1 << 64))
    byte = lambda i: F.ascii(F.decode(F.substring(raw, i, 1), "ISO-8859-1")).cast("long")
    folded = F.aggregate(F.sequence(F.lit(1), F.octet_length(raw)), basis, lambda h, i: _times_prime(h.bitwiseXOR(byte(i))))
    return F.when(F.octet_length(raw) == 0, basis).when(raw.isNotNull(), folded)


def slug(heading: Column) -> Column:
    """Letters, digits and underscores in lower case, other runs as one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(heading), r"(?U)[^\p{Alnum}_]+", "-"), "^-|-$", "")


def backtick_tokens(text: Column) -> Column:
    """Identifiers in inline code, outside fenced blocks; call parentheses are cut."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)```.*?(```|$)", " ")
    spans = F.transform(F.regexp_extract_all(plain, F.lit(r"`([^`]+)`"), 1), lambda x: F.regexp_replace(x, r"\(\)$", ""))
    return F.filter(spans, lambda x: x.rlike(r"^[A-Za-z0-9_:.]{1,120}$"))


def worklog_refs(message: Column) -> Column:
    """Ids of ``Refs:`` lines in order, each once."""
    lines = F.filter(F.split(F.coalesce(message, F.lit("")), "\n"), lambda x: F.lower(F.ltrim(x)).startswith("refs:"))
    ids = F.transform(lines, lambda x: F.split(F.regexp_replace(F.ltrim(x), "(?i)^refs:", ""), "[^A-Za-z0-9_-]"))
    return F.array_distinct(F.filter(F.flatten(ids), lambda x: x != ""))


def module_prefix(package: Column, path: Column) -> Column:
    """Package and module path of a source file, joined by ``::``."""
    inner = F.regexp_replace(F.regexp_replace(path, r"\.(rs|py|ts|tsx|js|go)$", ""), "^.*?(^|/)src/", "")
    inner = F.regexp_replace(F.regexp_replace(inner, "(^|/)(mod|lib|main|__init__)$", ""), "/", "::")
    return F.when(inner == "", package).otherwise(F.concat_ws("::", package, inner))


def first_line(body: Column) -> Column:
    """A signature: the first line, trimmed, with escaped pipes; a dash where there is none."""
    line = F.replace(F.trim(F.split(F.coalesce(body, F.lit("")), "\n")[0]), F.lit("|"), F.lit("\\|"))
    return F.when(line == "", "—").otherwise(line)


def markdown_cell(value: Column) -> Column:
    text = F.regexp_replace(F.replace(value.cast("string"), F.lit("|"), F.lit("\\|")), r"[\r\n\t]", " ")
    return F.coalesce(text, F.lit("—"))


def first_label(labels: Column) -> Column:
    """The first of a node's labels, or null."""
    return F.get(labels, F.lit(0))


def shortened(value: Column, most: int = 40) -> Column:
    return F.when(F.length(value) > most, F.concat(F.lit("…"), F.right(value, F.lit(most - 1)))).otherwise(value)


def iso_micros(micros: Column) -> Column:
    """Microseconds since the epoch as UTC text; the session's zone must be UTC."""
    return F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def safe_ident(name: str) -> bool:
    return re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name) is not None


def safe_name(name: str) -> bool:
    return re.fullmatch(r"[A-Za-z0-9_-]{1,80}", name) is not None


def format_bytes(n: int) -> str:
    value, units = float(n), ["B", "KiB", "MiB", "GiB", "TiB"]
    while value >= 1024 and len(units) > 1:
        value, units = value / 1024, units[1:]
    return f"{n} B" if units[0] == "B" else f"{value:.1f} {units[0]}"


def escaped(value: Column) -> Column:
    """A text between single quotes, as query languages read it: quotes, backslashes and control characters escaped."""
    text = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    for plain, letter in (("\n", "n"), ("\r", "r"), ("\t", "t")):
        text = F.replace(text, F.lit(plain), F.lit(f"\\{letter}"))
    for code in sorted({*range(32)} - {9, 10, 13}):
        text = F.replace(text, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit("'"), text, F.lit("'"))


def rust_functions(text: Column) -> Column:
    """Names after ``fn``, ``pub fn`` or ``pub(crate) fn`` at the start of a line."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?m)^(?:pub(?:\(crate\))? )?fn ([A-Za-z_][A-Za-z0-9_]*)"), 1)


def truncated(value: Column, most: int) -> Column:
    """At most ``most`` characters, the last of them an ellipsis where some are cut."""
    return F.when(F.length(value) > most, F.concat(F.left(value, F.lit(most - 1)), F.lit("…"))).otherwise(value)


def recovered_json(reply: Column) -> Column:
    """The JSON in a text: a fenced block, else what is between the first and the last brace, else null."""
    fenced = F.nullif(F.regexp_extract(reply, r"(?is)```json\s*(.*?)\s*```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.trim(F.coalesce(fenced, braces))
