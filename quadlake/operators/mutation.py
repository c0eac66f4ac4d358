"""Changes to graphs, each a new quad table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.functions.iri import base, fragment
from quadlake.model import COLUMNS, QUADS, RDF_FIRST, RDF_TYPE, as_set
from quadlake.operators.closure import closure


def statements(df: DataFrame, graph: str) -> DataFrame:
    """Quads of a graph from s, p, o and dt: with a datatype o is a literal's text, without one a node."""
    text = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    dt, blank = text("dt"), lambda c: F.when(c.startswith("_:"), "blank").otherwise("iri")
    node = lambda c: F.regexp_replace(c, "^_:", "")
    return df.select(
        F.lit(graph).alias("graph_iri"), blank(F.col("s")).alias("s_kind"), node(F.col("s")).alias("s_id"), "p",
        F.when(dt.isNotNull(), "literal").otherwise(blank(F.col("o"))).alias("o_kind"), F.when(dt.isNull(), node(F.col("o"))).alias("o_id"), F.when(dt.isNotNull(), F.col("o")).alias("o_lex"),
        dt.alias("o_dt"), text("lang").alias("o_lang"), F.when(dt.isNotNull(), F.col("o").try_cast("double")).alias("o_num"), F.lit(None).cast(QUADS["o_items"].dataType).alias("o_items"),
    ).select(*COLUMNS)


def add(q: DataFrame, new: DataFrame) -> DataFrame:
    """Statements that are there already do not count twice."""
    return as_set(q.unionByName(new))


def add_strict(q: DataFrame, new: DataFrame) -> DataFrame:
    """As add, but fails if a statement is there already."""
    key = ["graph_iri", "s_id", "p", "o_kind", F.coalesce("o_id", F.lit("")).alias("o1"), F.coalesce("o_lex", F.lit("")).alias("o2"), F.coalesce("o_dt", F.lit("")).alias("o3")]
    if not new.filter(F.col("p") != RDF_FIRST).select(*key).join(q.select(*key), ["graph_iri", "s_id", "p", "o_kind", "o1", "o2", "o3"], "left_semi").isEmpty():
        raise ValueError("a statement exists already")
    return q.unionByName(new)


def create_nodes(df: DataFrame, graph: str, cls: str | None = None) -> DataFrame:
    """Typed nodes of a graph from fragments (column fragment); a null gets a random UUID."""
    name = F.coalesce("fragment", F.uuid())
    return statements(df.select(F.concat(F.lit(f"{graph}#"), name).alias("s"), F.lit(RDF_TYPE).alias("p"), F.lit(cls or "http://www.w3.org/2002/07/owl#Thing").alias("o")), graph)


def delete_where(q: DataFrame, condition: Column) -> DataFrame:
    return q.filter(~F.coalesce(condition, F.lit(False)))


def delete_triples(q: DataFrame, s: str) -> DataFrame:
    """All statements of a subject but list members."""
    return q.filter((F.col("s_id") != s) | (F.col("p") == RDF_FIRST))


def delete_node(q: DataFrame, node: str) -> DataFrame:
    """The node and every statement that touches it."""
    return q.filter((F.col("s_id") != node) & (F.col("p") != node) & F.coalesce(F.col("o_id") != node, F.lit(True)))


def delete_graph(q: DataFrame, imports: DataFrame, graph: str) -> DataFrame:
    if not imports.filter(F.col("imported_iri") == graph).isEmpty():
        raise ValueError(f"{graph} is imported by another graph")
    return q.filter(F.col("graph_iri") != graph)


def add_import(imports: DataFrame, graph: str, imported: str) -> DataFrame:
    """Fails if the import would close a cycle."""
    edges = imports.select(F.col("graph_iri").alias("a"), F.col("imported_iri").alias("b"))
    if graph == imported or not closure(edges).filter((F.col("a") == imported) & (F.col("b") == graph)).isEmpty():
        raise ValueError(f"{imported} imports {graph} already")
    return imports.union(imports.sparkSession.createDataFrame([(graph, imported)], "graph_iri string, imported_iri string")).distinct()


def remove_import(imports: DataFrame, graph: str, imported: str) -> DataFrame:
    return imports.filter(~((F.col("graph_iri") == graph) & (F.col("imported_iri") == imported)))


def rename_node(q: DataFrame, old: str, new: str) -> DataFrame:
    swap = lambda c: F.when(F.col(c) == old, new).otherwise(F.col(c))
    return q.withColumns({"s_id": swap("s_id"), "p": swap("p"), "o_id": swap("o_id")})


def move_nodes(q: DataFrame, target: DataFrame) -> DataFrame:
    """Moves IRI nodes to other graphs: target has node and to_graph. IRIs, references and owning graphs follow."""
    moved = target.select("node", "to_graph", F.concat_ws("#", "to_graph", fragment(F.col("node"))).alias("new"))
    out = q
    for c in ("s_id", "p", "o_id"):
        m = moved.select(F.col("node").alias(c), F.col("new").alias(f"__{c}"))
        out = out.join(m, c, "left").withColumn(c, F.coalesce(f"__{c}", c)).drop(f"__{c}")
    owner = F.when((F.col("s_kind") == "iri") & (base(F.col("s_id")) != F.col("graph_iri")), base(F.col("s_id"))).otherwise(F.col("graph_iri"))
    return out.withColumn("graph_iri", owner).select(*COLUMNS)


def split_by_group(q: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statements of grouped subjects (node, root) move to a graph for each root; others stay. Also the imports that follow."""
    g = groups.select(F.col("node").alias("s_id"), F.concat(F.lit("urn:group:"), F.md5("root")).alias("__g"))
    out = q.join(g, "s_id", "left").withColumn("graph_iri", F.coalesce("__g", "graph_iri")).select(*COLUMNS)
    owner = out.select(F.col("s_id").alias("o_id"), F.col("graph_iri").alias("imported_iri")).distinct()
    imports = out.filter("o_id IS NOT NULL").join(owner, "o_id").filter("graph_iri <> imported_iri").select("graph_iri", "imported_iri").distinct()
    return out, imports
