"""Mutations as new snapshots: upserts are an anti join and a union, deletes anti joins."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def merge_rows(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Match or create: rows whose key is not there yet are added, once each."""
    new = rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")
    return table.unionByName(new, allowMissingColumns=True)


def set_where(table: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    return table.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def add_label(table: DataFrame, condition: Column, label: str) -> DataFrame:
    return set_where(table, condition, {"labels": F.array_union("labels", F.array(F.lit(label)))})


def remove_label(table: DataFrame, condition: Column, label: str) -> DataFrame:
    return set_where(table, condition, {"labels": F.array_remove("labels", label)})


def remove_properties(table: DataFrame, condition: Column, *names: str) -> DataFrame:
    """Set properties to null; names that the table lacks are left out."""
    return set_where(table, condition, {c: F.lit(None).cast(table.schema[c].dataType) for c in names if c in table.columns})


def create_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Add rows without looking for what is there."""
    return table.unionByName(rows, allowMissingColumns=True)


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without the ``gone``: told by ``edge_id`` where both have it, else by ends (and type)."""
    both = [c for c in edges.columns if c in gone.columns]
    keys = ["edge_id"] if "edge_id" in both else [c for c in ("src", "dst", "type") if c in both]
    return edges.join(gone.select(*keys), keys, "left_anti")


def detach_delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without the ``gone`` (node_id), and edges that touch none of them."""
    left = edges
    for end in ("src", "dst"):
        left = left.join(gone.select(F.col("node_id").alias(end)), end, "left_anti")
    return nodes.join(gone.select("node_id"), "node_id", "left_anti"), left


class Store:
    """Tables as snapshots under a folder that all executors share.

    A commit writes a new folder per changed table and then renames a new pointer
    file over the old one, in one step where the file system can do that; a
    failure before leaves the old state. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.pending = spark, path, None

    def _file(self, name: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def current(self) -> dict[str, str]:
        fs, where = self._file("_CURRENT")
        if not fs.exists(where):
            return {}
        stream = fs.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.current()[table]}")

    def begin(self) -> None:
        self.pending = self.pending or {}

    def write(self, table: str, frame: DataFrame) -> None:
        """Buffer a table inside a transaction, else commit it at once."""
        if self.pending is None:
            self.begin()
            self.pending[table] = frame
            self.commit()
        else:
            self.pending[table] = frame

    def rollback(self) -> None:
        self.pending = None

    def commit(self) -> None:
        state = self.current()
        try:
            for table, frame in (self.pending or {}).items():
                folder = f"{table}-{uuid.uuid4().hex}"
                frame.write.parquet(f"{self.path}/{folder}")
                state[table] = folder
        finally:
            self.pending = None
        fs, where = self._file("_CURRENT")
        _, fresh = self._file(f"_CURRENT.{uuid.uuid4().hex}")
        out = fs.create(fresh, True)
        out.write(json.dumps(state).encode())
        out.close()
        jvm = self.spark._jvm.org.apache.hadoop.fs
        overwrite = self.spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 1)
        overwrite[0] = getattr(jvm, "Options$Rename").OVERWRITE
        jvm.FileContext.getFileContext(where.toUri() if where.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(fresh), fs.makeQualified(where), overwrite)
