"""A property graph over ordinary tables: the graph that the registered queries run on.

part -> Function (PROMO parts are also Test), supplier -> File, nation ->
Package, region -> Workspace, orders -> GitCommit, customer -> Author,
documents -> DocSection, labels -> Note, benchmark passages -> MENTIONS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import Graph


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, key: str):
    return F.concat(F.lit(f"{prefix}::"), F.col(key).cast("string"))


def _labels(*names: str):
    return F.array(*map(F.lit, names))


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    test = F.col("p_type") == "PROMO"
    return part.select(
        _id("part", "p_partkey").alias("node_id"),
        F.when(test, _labels("Function", "Test")).otherwise(_labels("Function")).alias("labels"),
        _id("part", "p_partkey").alias("qualified_name"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("kind"),
        F.col("p_size").alias("line_start"),
        test.alias("is_test"),
        F.col("p_partkey").alias("key"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs of parts on consecutive lines of an order, both of quantity 35 or more."""
    line = read(spark, sf_dir, "lineitem").where("l_quantity >= 35").select("l_orderkey", "l_linenumber", "l_partkey")
    nxt = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    pairs = line.join(nxt, ["l_orderkey", "l_linenumber"]).where("l_partkey <> dst")
    return pairs.select(_id("part", "l_partkey").alias("src"), _id("part", "dst").alias("dst")).distinct()


#: Words of the run by which a passage and the texts that hold it are joined.
RUN = 8


def _run(words: Column, start: Column) -> Column:
    return F.xxhash64(*[F.get(words, start + k) for k in range(RUN)])


def _runs(words: Column) -> Column:
    """Hashes of all runs of RUN consecutive words, each once; none where there are fewer words.

    The words are bound to a variable, so they are split once and not once a run.
    """
    starts = lambda w: F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - RUN, F.lit(0))), lambda i: i + RUN <= F.size(w))
    return F.transform(F.array(words), lambda w: F.array_distinct(F.transform(starts(w), lambda i: _run(w, i))))[0]


def mentions(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): texts that contain a passage.

    The inner words of a passage stand between blanks in any text that holds it,
    so its second to ninth word are a run of the text too: an equality join on
    the run's hash proposes pairs, and only those are compared. Passages of
    fewer than RUN + 2 words have no such run and are looked for in every text.
    """
    words = F.split("passage", " ")
    long = F.size(words) >= RUN + 2
    keyed = items.where(long).select("item_id", "passage", _run(words, F.lit(1)).alias("run"))
    runs = docs.select("doc_id", F.explode(_runs(F.split("text", " "))).alias("run"))
    pairs = runs.join(keyed, "run").select("doc_id", "item_id", "passage").distinct()
    holds = F.col("text").contains(F.col("passage"))
    found = docs.join(pairs, "doc_id").where(holds).select("doc_id", "item_id")
    return found.unionByName(docs.join(items.where(~long), holds).select("doc_id", "item_id"))


def project(spark: SparkSession, sf_dir: str) -> Graph:
    t = lambda name: read(spark, sf_dir, name)
    commit = t("orders").select(
        _id("commit", "o_orderkey").alias("node_id"),
        _labels("GitCommit").alias("labels"),
        F.col("o_orderkey").cast("string").alias("hash"),
        F.col("o_orderpriority").alias("message"),
        F.col("o_orderdate").alias("timestamp"),
        F.col("o_custkey"),
        F.col("o_orderkey"),
    )
    nodes = {
        "Function": functions(spark, sf_dir),
        "File": t("supplier").select(_id("file", "s_suppkey").alias("node_id"), _labels("File").alias("labels"), F.col("s_name").alias("path"), F.col("s_name").alias("name")),
        "Package": t("nation").select(_id("package", "n_nationkey").alias("node_id"), _labels("Package").alias("labels"), F.col("n_name").alias("name")),
        "Workspace": t("region").select(_id("workspace", "r_regionkey").alias("node_id"), _labels("Workspace").alias("labels"), F.col("r_name").alias("name")),
        "GitCommit": commit.drop("o_custkey", "o_orderkey"),
        "Author": t("customer").select(_id("author", "c_custkey").alias("node_id"), _labels("Author").alias("labels"), F.col("c_name").alias("name")),
        "DocSection": t("documents").select(_id("doc", "doc_id").alias("node_id"), _labels("DocSection").alias("labels"), _id("doc", "doc_id").alias("qualified_name"), F.col("source").alias("path"), F.col("lang").alias("kind")),
        "Note": t("labels").select(_id("note", "doc_id").alias("node_id"), _labels("Note").alias("labels"), F.col("quality"), F.col("toxic")),
    }
    call = calls(spark, sf_dir)
    fn = nodes["Function"].select("node_id", "is_test")
    tests = call.join(fn.where("is_test").select(F.col("node_id").alias("src")), "src", "left_semi").join(fn.where("not is_test").select(F.col("node_id").alias("dst")), "dst", "left_semi")
    line = t("lineitem").select("l_partkey", "l_suppkey", F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("edge_id"))
    following = Window.partitionBy("o_custkey").orderBy("timestamp", "o_orderkey")
    mention = mentions(t("documents").select("doc_id", "text"), t("benchmark").select("item_id", F.col("text").alias("passage")))
    edges = {
        "CALLS": call,
        "TESTS": tests.select("src", "dst"),
        "DEFINED_IN": line.groupBy("l_partkey").agg(F.min("l_suppkey").alias("s")).select(_id("part", "l_partkey").alias("src"), _id("file", "s").alias("dst")),
        "SUPPLIED": line.select(_id("file", "l_suppkey").alias("src"), _id("part", "l_partkey").alias("dst"), "edge_id"),
        "CONTAINS": t("supplier").select(_id("package", "s_nationkey").alias("src"), _id("file", "s_suppkey").alias("dst")),
        "HOLDS": t("nation").select(_id("workspace", "n_regionkey").alias("src"), _id("package", "n_nationkey").alias("dst")),
        "AUTHORED": t("orders").select(_id("author", "o_custkey").alias("src"), _id("commit", "o_orderkey").alias("dst")),
        "PARENT_OF": commit.select(F.col("node_id").alias("src"), F.lead("node_id").over(following).alias("dst")).where("dst is not null"),
        "NOTES": t("labels").select(_id("note", "doc_id").alias("src"), _id("doc", "doc_id").alias("dst")),
        "MENTIONS": mention.select(_id("doc", "doc_id").alias("src"), F.concat(F.lit("part::"), (F.col("item_id") + 1).cast("string")).alias("dst")),
    }
    return Graph(nodes, edges)
