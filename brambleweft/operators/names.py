"""Linking by bare name: definitions in the same package first, else all of that name.

Names are uneven: one may be held by a third of all definitions and of all
sites. Heavy names are found by a frequent-items sketch, whose partial results
are of bounded size; their sites are dealt to ``SALTS`` tasks each, with the
definitions copied, while all other names are joined as they are. Which sites
are served by their own package is decided by semi joins before anything fans
out, so a local definition spares a site all others of that name.

The pairs of a heavy name are as many as its sites times its definitions. Who
needs only how many links a site has takes ``count_links``, which counts the
definitions first and makes no pairs.

Defined results: null names and packages link nothing by themselves (a site
without a package has no local definition); a site that is there twice is linked
twice; a definition that is there twice is one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

SALTS = 32
#: A name is heavy from so many thousandths of all sites on.
HEAVY = 10


def heavy_names(sites: DataFrame) -> list[str]:
    """Names of at least HEAVY thousandths of the sites: at most 1000 / HEAVY of them, so they may reach the driver.

    The sketch names all of these and perhaps others; exact counts of what it names decide.
    """
    total, named = sites.count(), sites.stat.freqItems(["name"], HEAVY / 1000).first()[0]
    counts = sites.where(F.col("name").isin(named)).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return [r["name"] for r in counts.where(F.col("n") * 1000 >= HEAVY * total).collect()]


def link(sites: DataFrame, definitions: DataFrame) -> DataFrame:
    """(src, name, node_id, local) from sites (src, package, name) and definitions (node_id, package, name)."""
    defined = definitions.where(F.col("name").isNotNull()).select("node_id", "package", "name").distinct()
    named = sites.where(F.col("name").isNotNull()).select("src", "package", "name")
    heavy = heavy_names(named)
    salts = F.explode(F.when(F.col("name").isin(heavy), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    salt = F.when(F.col("name").isin(heavy), F.pmod(F.xxhash64("src"), F.lit(SALTS)).cast("int")).otherwise(0)
    dealt, copied = named.withColumn("salt", salt), lambda frame: frame.withColumn("salt", salts)
    homes = copied(defined.select("package", "name").distinct())
    key = ["package", "name", "salt"]
    local = dealt.join(homes, key, "left_semi").join(copied(defined), key).select("src", "name", "node_id", F.lit(True).alias("local"))
    other = dealt.join(homes, key, "left_anti").join(copied(defined.select("node_id", "name").distinct()), ["name", "salt"]).select("src", "name", "node_id", F.lit(False).alias("local"))
    return local.unionByName(other)


def count_links(sites: DataFrame, definitions: DataFrame) -> DataFrame:
    """(src, name, links, least, local): of each row of ``sites`` that has links, how many ``link`` gives it, and the least node_id among them."""
    defined = definitions.where(F.col("name").isNotNull()).select("node_id", "package", "name").distinct()
    named = checkpoint(sites.where(F.col("name").isNotNull()).select("src", "package", "name"))
    heavy = heavy_names(named)
    salts = F.explode(F.when(F.col("name").isin(heavy), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    salt = F.when(F.col("name").isin(heavy), F.pmod(F.xxhash64("src"), F.lit(SALTS)).cast("int")).otherwise(0)
    tally = lambda n, least: (F.count(F.lit(1)).alias(n), F.min("node_id").alias(least))
    homes = defined.where(F.col("package").isNotNull()).groupBy("package", "name").agg(*tally("n", "first")).withColumn("salt", salts)
    every = defined.select("node_id", "name").distinct().groupBy("name").agg(*tally("n_all", "first_all")).withColumn("salt", salts)
    met = named.withColumn("salt", salt).join(every, ["name", "salt"]).join(homes, ["package", "name", "salt"], "left")
    return met.select("src", "name", F.coalesce("n", "n_all").alias("links"), F.coalesce("first", "first_all").alias("least"), F.col("n").isNotNull().alias("local"))
