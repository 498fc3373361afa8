"""OpenAPI documents in JSON, read as VARIANT: every value is looked at alone.

A document may hold anything beside what is read: lists next to methods, numbers
where texts are meant, extensions. With one rigid type for the whole document
any of these would lose all of it; with VARIANT each path, method and schema is
exploded and read by itself, and what does not fit is passed over.

Defined results: a document that is no JSON, or whose ``paths`` is no object,
has no rows; a value that is no text where one is meant counts as absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

#: What a path's methods are.
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
#: A reference in the JSON that VARIANT gives; in a text its quotes would be escaped.
REFERENCE = r'"\$ref":"((?:[^"\\]|\\.)*)"'


def _object(value: Column, at: str = "$") -> Column:
    return F.try_variant_get(value, at, "map<string,variant>")


def _text(value: Column, at: str) -> Column:
    found = F.try_variant_get(value, at, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(value, at, "string"))


def _parsed(files: DataFrame) -> DataFrame:
    return files.select("path", F.try_parse_json("text").alias("doc"))


def _operations(files: DataFrame) -> DataFrame:
    """(path, route, method, op): the operations, methods in upper case."""
    routes = _parsed(files).select("path", F.explode(_object(F.col("doc"), "$.paths")).alias("route", "methods"))
    each = routes.select("path", "route", F.explode(_object(F.col("methods"))).alias("method", "op")).withColumn("method", F.upper("method"))
    return each.where(F.col("method").isin(*METHODS))


def openapi_endpoints(files: DataFrame) -> DataFrame:
    """(path, route, method, operation_id, summary, tags) of every operation; tags are joined by a comma and a blank."""
    op = F.col("op")
    texts = F.filter(F.try_variant_get(op, "$.tags", "array<variant>"), lambda t: F.schema_of_variant(t) == "STRING")
    tags = F.array_join(F.transform(texts, lambda t: F.try_variant_get(t, "$", "string")), ", ")
    empty = lambda c: F.coalesce(c, F.lit(""))
    return _operations(files).select("path", "route", "method", empty(_text(op, "$.operationId")).alias("operation_id"), empty(_text(op, "$.summary")).alias("summary"), empty(tags).alias("tags"))


def _schemas(files: DataFrame) -> DataFrame:
    """(path, schema, body): those under ``components.schemas``, else under ``definitions``."""
    parsed = _parsed(files)
    named = F.coalesce(_object(F.col("doc"), "$.components.schemas"), _object(F.col("doc"), "$.definitions"))
    return parsed.select("path", F.explode(named).alias("schema", "body"))


def openapi_types(files: DataFrame) -> DataFrame:
    """(path, schema, kind) of every schema; without a type it is an object."""
    return _schemas(files).select("path", "schema", F.coalesce(_text(F.col("body"), "$.type"), F.lit("object")).alias("kind"))


def openapi_schemas(files: DataFrame) -> DataFrame:
    """(path, schema, position, field, type): a field's type is its own, else the last part of its reference, else ``any``.

    A schema without properties gives one row without a field. Fields are numbered by name.
    """
    names = F.array_sort(F.map_keys(_object(F.col("body"), "$.properties")))
    fields = _schemas(files).select("path", "schema", _object(F.col("body"), "$.properties").alias("all"), F.posexplode_outer(names).alias("position", "field"))
    value = fields.withColumn("value", F.col("all")[F.col("field")])
    kind = F.coalesce(_text(F.col("value"), "$.type"), _tail(_text(F.col("value"), "$['$ref']")), F.lit("any"))
    return value.select("path", "schema", "position", "field", F.when(F.col("field").isNotNull(), kind).alias("type"))


def _tail(reference: Column) -> Column:
    return F.element_at(F.split(reference, "/"), -1)


def _named(body: Column) -> Column:
    """The last parts of all references in a value, at any depth."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.to_json(body), F.lit(REFERENCE), 1), _tail))


def openapi_references(files: DataFrame) -> DataFrame:
    """(path, route, method, schema): schemas that an operation refers to, at any depth of its definition."""
    return _operations(files).select("path", "route", "method", F.explode(_named(F.col("op"))).alias("schema"))


def schema_references(files: DataFrame) -> DataFrame:
    """(path, schema, other): schemas that a schema refers to, at any depth of its definition."""
    return _schemas(files).select("path", "schema", F.explode(_named(F.col("body"))).alias("other"))


def openapi_closure(files: DataFrame) -> DataFrame:
    """(path, route, method, schema, hops): schemas that an operation needs, through any number of references.

    A round follows the references of what the last one found; it ends when a
    round finds nothing, at the latest after the longest chain of a document.
    """
    onward = checkpoint(schema_references(files))
    key = ["path", "route", "method", "schema"]
    found = new = checkpoint(openapi_references(files).withColumn("hops", F.lit(1)))
    while not new.isEmpty():
        hop = new.join(onward, ["path", "schema"]).select("path", "route", "method", F.col("other").alias("schema"), (F.col("hops") + 1).alias("hops")).distinct()
        new = checkpoint(hop.join(found, key, "left_anti"))
        found = found.unionByName(new)
    return found
