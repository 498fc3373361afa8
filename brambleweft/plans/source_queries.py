"""Registered queries over extractors: texts that are built from the tables, and what is read from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import api_documents, documents
from .projection import read
from .queries import query


def _joined(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _markdown(spark, d):
    """One page per document: a long fence that holds shorter ones of both kinds, in Rust for every second, between headings."""
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("i"), F.when(F.col("doc_id") % 2 == 0, "rust").otherwise("text").alias("lang"))
    i = F.col("i")
    text = _joined("lost `a`\n# Page ", i, "\nsee `part::", i, "`\n````", F.col("lang"), "\n# no\n~~~\npub fn f", i, "() {}\n```\n````\nBelow\n---\n~~~\n## no\n```\n~~~~\n# Page ", i, " #\n`b`")
    return docs.select(_joined("page/", i, ".md").alias("path"), text.alias("text"))


@query("markdown_sections", """SELECT 'page/' || doc_id || '.md' AS path, unnest([2, 10, 16]) AS line, unnest([1, 2, 1]) AS level, unnest(['Page ' || doc_id, 'Below', 'Page ' || doc_id]) AS heading,
 unnest(['page-' || doc_id, 'below', 'page-' || doc_id || '-1']) AS slug FROM documents""", ctes="")
def markdown_sections(spark, d):
    return documents.markdown_sections(_markdown(spark, d))


@query("markdown_mentions", """WITH t AS (SELECT doc_id, unnest([3, 7, 17]) AS line, unnest([2, 2, 16]) AS heading_line, unnest(['part::' || doc_id, CASE WHEN doc_id % 2 = 0 THEN 'f' || doc_id END, 'b']) AS token FROM documents)
SELECT 'page/' || doc_id || '.md' AS path, line, heading_line, token FROM t WHERE token IS NOT NULL""", ctes="")
def markdown_mentions(spark, d):
    return documents.markdown_spans(_markdown(spark, d))


def _features(spark, d):
    """One feature per order: a background, a docstring, and a rule that ends a scenario."""
    orders = read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("i"), "o_orderstatus", F.col("o_orderpriority").alias("p"))
    i = F.col("i")
    text = _joined("@all @s", F.col("o_orderstatus"), "\n# @no\nFeature: Order ", i, "\n Background:\n  Given key ", i, "\n  And more\n\n @first\n @second\n Scenario: Paid\n  When priority ", F.col("p"), "\n  \"\"\"\n  Then no\n  @no\n  \"\"\"\n  | x |\n  * again\n Rule: Late\n  Then lost\n Scenario: Open\n  But late ", i, "\n  Then end")
    return orders.select(_joined("order/", i, ".feature").alias("path"), text.alias("text"))


@query("gherkin_titles", """SELECT 'order/' || o_orderkey || '.feature' AS path, unnest([3, 4, 10, 18, 20]) AS line, unnest(['Feature', 'Scenario', 'Scenario', 'Feature', 'Scenario']) AS kind,
 unnest(['Order ' || o_orderkey, 'Order ' || o_orderkey, 'Order ' || o_orderkey, 'Late', 'Late']) AS feature, unnest(['Order ' || o_orderkey, '', 'Paid', 'Late', 'Open']) AS name,
 unnest(['all,s' || o_orderstatus, '', 'first,second', '', '']) AS tags FROM orders""", ctes="")
def gherkin_titles(spark, d):
    return documents.gherkin_titles(_features(spark, d))


@query("gherkin_steps", """SELECT 'order/' || o_orderkey || '.feature' AS path, unnest([5, 6, 11, 17, 21, 22]) AS line, unnest(['Order ' || o_orderkey, 'Order ' || o_orderkey, 'Order ' || o_orderkey, 'Order ' || o_orderkey, 'Late', 'Late']) AS feature,
 unnest(['', '', 'Paid', 'Paid', 'Open', 'Open']) AS scenario, unnest([1, 2, 1, 2, 1, 2]) AS step_order, unnest(['Given', 'Given', 'When', 'When', 'Given', 'Then']) AS kind,
 unnest(['key ' || o_orderkey, 'more', 'priority ' || o_orderpriority, 'again', 'late ' || o_orderkey, 'end']) AS text FROM orders""", ctes="")
def gherkin_steps(spark, d):
    return documents.gherkin_steps(_features(spark, d))


def _specs(spark, d):
    """One document per supplier: lists and numbers beside the methods, methods in any case, schemas that refer to each other, in a ring for every third."""
    s = read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("i"), F.col("s_nationkey").cast("string").alias("n"), (F.col("s_suppkey") % 3 == 0).alias("ring"))
    i, n = F.col("i"), F.col("n")
    ref = lambda name: '{"$ref": "#/components/schemas/' + name + '"}'
    paths = _joined('{"/s/', i, '": {"parameters": [{"name": "id"}], "x-rate": 5, "get": {"operationId": "get', i, '", "tags": ["a", 1, "n', n, '"], "responses": {"200": {"schema": {"items": ', ref("A"), '}}}}, "POST": {"summary": "said \\"$ref\\": \\"x/No\\"", "operationId": 7}, "trace": {}}, "/n": ["no object"]}')
    schemas = _joined('{"A": {"properties": {"next": ', ref("B"), ', "size": {"type": "integer"}, "free": {}}}, "B": {"type": "array", "items": {"deep": [', ref("C"), ']}}, "C": {"properties": {"back": ', F.when(F.col("ring"), ref("A")).otherwise('{"type": "string"}'), "}}, \"D\": ", ref("C"), "}")
    return s.select(_joined("api/", i, "/openapi.json").alias("path"), _joined('{"openapi": "3.0.0", "paths": ', paths, ', "components": {"schemas": ', schemas, "}}").alias("text"))


SPEC = "d AS (SELECT 'api/' || s_suppkey || '/openapi.json' AS path, '/s/' || s_suppkey AS route, s_suppkey AS i, s_nationkey AS n, s_suppkey % 3 = 0 AS ring FROM supplier)"


@query("openapi_endpoints", f"WITH {SPEC} SELECT path, route, unnest(['GET', 'POST']) AS method, unnest(['get' || i, '']) AS operation_id, unnest(['', 'said \"$ref\": \"x/No\"']) AS summary, unnest(['a, n' || n, '']) AS tags FROM d", ctes="")
def openapi_endpoints(spark, d):
    return api_documents.openapi_endpoints(_specs(spark, d))


@query("openapi_closure", f"WITH {SPEC} SELECT path, route, 'GET' AS method, unnest(['A', 'B', 'C']) AS schema, unnest([1, 2, 3]) AS hops FROM d", ctes="")
def openapi_closure(spark, d):
    return api_documents.openapi_closure(_specs(spark, d))


@query("openapi_schemas", f"""WITH {SPEC} SELECT path, unnest(['A', 'A', 'A', 'B', 'C', 'D']) AS schema, unnest([0, 1, 2, NULL, 0, NULL])::INT AS position, unnest(['free', 'next', 'size', NULL, 'back', NULL]) AS field,
 unnest(['any', 'B', 'integer', NULL, CASE WHEN ring THEN 'A' ELSE 'string' END, NULL]) AS type FROM d""", ctes="")
def openapi_schemas(spark, d):
    return api_documents.openapi_schemas(_specs(spark, d))


@query("openapi_types", f"WITH {SPEC} SELECT path, unnest(['A', 'B', 'C', 'D']) AS schema, unnest(['object', 'array', 'object', 'object']) AS kind FROM d", ctes="")
def openapi_types(spark, d):
    return api_documents.openapi_types(_specs(spark, d))
