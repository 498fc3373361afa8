"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint, shared_folder

__all__ = ["checkpoint", "held_out", "shared_folder", "table", "text_slices", "word_count"]

#: The six ASCII blanks, as a character class body and as plain characters.
BLANKS_CLASS = r"\x20\x09-\x0D"
BLANKS = " \t\n\x0b\x0c\r"
#: One word with the blanks around it; possessive, so the matcher never backs up.
WORD_AND_BLANKS = rf"[{BLANKS_CLASS}]*+[^{BLANKS_CLASS}]++[{BLANKS_CLASS}]*+"
HAS_WORD = rf"[^{BLANKS_CLASS}]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` matches; 0 for null and blank texts.

    Every word and the blanks around it shrink to one character, so nothing is
    held per word. The appended word makes blank texts match as well.
    """
    shrunk = F.regexp_replace(F.concat(text, F.lit(" x")), WORD_AND_BLANKS, "w")
    return F.coalesce(F.length(shrunk).cast("long") - 1, F.lit(0).cast("long"))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the fold of rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def text_slices(column: pa.Array, most: int) -> Iterator[tuple[slice, list[bytes]]]:
    """The texts of an Arrow column as UTF-8, about ``most`` bytes at a time; null is empty."""
    sizes = np.asarray(pa.compute.binary_length(column).fill_null(0), np.int64)
    full = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(full)) + 1).tolist(), len(sizes)]
    for start, end in zip(cuts[:-1], cuts[1:], strict=True):
        if end > start:
            yield slice(start, end), [t or b"" for t in column[start:end].cast(pa.binary()).to_pylist()]
