"""A corpus pipeline over ``documents``: classify, dedup lines, drop near duplicates, mix, encode.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of their input, whatever they are called; an empty
table gives an empty table. Texts are read whole, however long.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brambleweft.llm import bpe, line_dedup, mixing, quality_cnn, shingle_join
from brambleweft.llm.common import shared_folder, table, word_count


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    A null text is judged as the empty text; repeated rows are judged alike. Labels
    of ids that are not in ``docs`` teach nothing; without labels of both classes
    all rows have one score, and stay or go together.
    """
    return quality_cnn.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of many sites; those that lose all of them go.

    Each such line stays where it first occurs, so copies of a document go and
    their first holder stays. ``n_chars`` follows the text where it is there.
    Null, empty and blank texts have no lines to lose and stay; a null source is
    no site; of rows with the same id and text all lose the same lines.
    """
    done = line_dedup.dedup_lines(docs).where((F.col("n_removed") == 0) | (F.col("text") != ""))
    fresh = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {"text": F.col("text")}
    return done.select(*[fresh[c].alias(c) if c in fresh else F.col("row")[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Null and blank texts are like nothing and stay, and so do rows without an id.
    Rows with the same id are one document, of which the first by text stays.
    """
    return shingle_join.one_of_each(docs, size=5, num=80, den=100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once, or up to three times.

    A null source is a source of its own, the last. Null and blank texts have no
    words and are drawn like others. Reruns draw the same rows; of equal rows it
    does not matter which.
    """
    return mixing.mix(docs, "doc_id", "source", word_count(F.col("text")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the ids and of what they decode to.

    One row for each row, repeated and null ids included; a null text has no ids.
    """
    return bpe.digests(docs, keep_ids=True)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("encode", encode)]

#: The classifier, the join and the encoder cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    What passes between them is written to the shared folder, so a lost executor
    costs tasks of one stage; it is deleted as soon as the next stage is written.
    """
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{name}"
    return docs
