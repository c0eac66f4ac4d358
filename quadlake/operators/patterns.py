"""Access to statements by pattern, in all three directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadlake.functions import iri as fn
from quadlake.model import RDF_FIRST, RDF_TYPE, object_key


def match(q: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None, graph: str | None = None) -> DataFrame:
    """Statements with the given subject, predicate and object node; None leaves a place free. The filters reach the scan."""
    for column, value in (("graph_iri", graph), ("s_id", s), ("p", p), ("o_id", o)):
        if value is not None:
            q = q.filter(F.col(column) == value)
    return q


def touching(q: DataFrame, node: str) -> DataFrame:
    """Statements in which the node stands anywhere, each once."""
    return q.filter((F.col("s_id") == node) | (F.col("p") == node) | F.coalesce(F.col("o_id") == node, F.lit(False)))


def triple_count(q: DataFrame, node: str) -> DataFrame:
    return touching(q, node).agg(F.count(F.lit(1)).alias("triples"))


def objects(q: DataFrame, s: str, p: str) -> DataFrame:
    """Objects of exactly this predicate."""
    return match(q, s, p).select("o_kind", "o_id", "o_lex", "o_dt", "o_lang", "o_num", "o_items")


def has_triple(q: DataFrame, s: str, p: str, o: str) -> bool:
    return not match(q, s, p, o).isEmpty()


def existing(q: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of wanted (s_id, p, o_id) that are statements of q."""
    return wanted.join(q.select("s_id", "p", "o_id"), ["s_id", "p", "o_id"], "left_semi")


def nodes(q: DataFrame) -> DataFrame:
    """Every node of each graph, as subject or object: graph_iri, kind, node."""
    subjects = q.select("graph_iri", F.col("s_kind").alias("kind"), F.col("s_id").alias("node"))
    targets = q.filter("o_id IS NOT NULL").select("graph_iri", F.when(F.col("o_kind") == "term_collection", "collection").otherwise(F.col("o_kind")).alias("kind"), F.col("o_id").alias("node"))
    return subjects.union(targets).distinct()


def subjects(q: DataFrame) -> DataFrame:
    return q.select("graph_iri", F.col("s_kind").alias("kind"), F.col("s_id").alias("node")).distinct()


def iri_nodes(q: DataFrame) -> DataFrame:
    return nodes(q).filter("kind = 'iri'")


def blank_nodes(q: DataFrame) -> DataFrame:
    """Collections are blank nodes too."""
    return nodes(q).filter("kind IN ('blank', 'collection')")


def collection_nodes(q: DataFrame) -> DataFrame:
    return nodes(q).filter("kind = 'collection'")


def undefined_nodes(q: DataFrame) -> DataFrame:
    """Nodes that are objects but never subjects."""
    used = q.filter("o_id IS NOT NULL").select(F.col("o_id").alias("node")).distinct()
    return used.join(q.select(F.col("s_id").alias("node")), "node", "left_anti")


def by_fragment(q: DataFrame, graph: str, fragment: str) -> DataFrame:
    return match(q, s=f"{graph}#{fragment}", graph=graph)


def local_graphs(q: DataFrame) -> DataFrame:
    return q.select("graph_iri").distinct()


def referenced_graphs(q: DataFrame) -> DataFrame:
    """Graphs whose nodes stand as objects and that have no statements here."""
    targets = q.filter("o_kind = 'iri'").select(fn.base(F.col("o_id")).alias("graph_iri")).distinct()
    return targets.join(local_graphs(q), "graph_iri", "left_anti")


def is_uuid_fragment(node: Column) -> Column:
    return fn.is_uuid(fn.fragment(node))


def dump(q: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """Subjects, predicates and objects as text."""
    p = prefixes or {}
    node = lambda kind, c: F.when(kind == "iri", fn.prefixed(c, p)).otherwise(F.concat(F.lit("_:"), c))
    literal = F.concat(F.lit('"'), fn.escape_literal(F.col("o_lex")), F.lit('"'), F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), F.col("o_lang"))).otherwise(F.concat(F.lit("^^"), fn.prefixed(F.col("o_dt"), p))))
    return q.select("graph_iri", node(F.col("s_kind"), F.col("s_id")).alias("s"), fn.prefixed(F.col("p"), p).alias("p"), F.when(F.col("o_kind") == "literal", literal).when(F.col("o_id").isNotNull(), node(F.col("o_kind"), F.col("o_id"))).otherwise(F.to_json("o_items")).alias("o"))


def predicate_usage(q: DataFrame) -> DataFrame:
    return q.groupBy("graph_iri", "p").agg(F.count(F.lit(1)).alias("triples"), F.countDistinct("s_id").alias("subjects"))


def triple_order() -> list[Column]:
    """List members first, then by kind of object, predicate and object."""
    rank = F.when(F.col("o_kind").isin("iri", "blank", "term_collection"), 0).when(F.col("o_kind") == "literal", 1).otherwise(2)
    return [(F.col("p") != RDF_FIRST), rank, (F.col("p") != RDF_TYPE), F.col("p"), object_key()]


def triple_index(q: DataFrame) -> DataFrame:
    """Adds the position of each statement among those of its subject."""
    return q.withColumn("triple_index", F.row_number().over(Window.partitionBy("graph_iri", "s_id").orderBy(*triple_order())) - 1)


def triple_at(q: DataFrame, s: str, i: int) -> DataFrame:
    return triple_index(match(q, s)).filter(F.col("triple_index") == i)


def hop(q: DataFrame, start: DataFrame, p: str, *, back: bool = False) -> DataFrame:
    """One step from the nodes of start (columns: node and any others) along a predicate, or against it."""
    here, there = ("o_id", "s_id") if back else ("s_id", "o_id")
    edges = match(q, p=p).filter("o_id IS NOT NULL").select(F.col(here).alias("node"), F.col(there).alias("to"))
    return start.join(edges, "node").drop("node").withColumnRenamed("to", "node")
