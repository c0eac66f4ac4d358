"""Counts, sets and hashes over graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadlake._io import discard, materialise, spread
from quadlake.functions.iri import fragment, is_uuid
from quadlake.model import object_key
from quadlake.operators.patterns import nodes, referenced_graphs


def graph_info(q: DataFrame, imports: DataFrame | None = None, closure: DataFrame | None = None) -> DataFrame:
    """Per graph: nodes by kind, statements, references to nodes, literals, list members, direct and all imports."""
    info = q.groupBy("graph_iri").agg(
        F.count(F.lit(1)).alias("triples"),
        F.countDistinct("s_id").alias("subjects"),
        F.count("o_id").alias("references"),
        F.count(F.when(F.col("o_kind") == "literal", 1)).alias("literals"),
        F.sum(F.coalesce(F.size("o_items"), F.lit(0)).cast("long")).alias("list_members"),
        F.countDistinct("p").alias("predicates"),
    )
    if imports is not None:
        info = info.join(imports.groupBy("graph_iri").agg(F.count(F.lit(1)).alias("direct_imports")), "graph_iri", "left").fillna(0, ["direct_imports"])
    if closure is not None:
        info = info.join(closure.groupBy(F.col("a").alias("graph_iri")).agg(F.countDistinct("b").alias("all_imports")), "graph_iri", "left").fillna(0, ["all_imports"])
    return info


def node_kinds(q: DataFrame) -> DataFrame:
    """Nodes of each graph by kind; a blank node count includes collections in `blank_nodes`."""
    return nodes(q).groupBy("graph_iri", "kind").agg(F.count(F.lit(1)).alias("nodes"))


def stage_info(q: DataFrame) -> DataFrame:
    local = q.agg(F.count(F.lit(1)).alias("triples"), F.countDistinct("graph_iri").alias("local_graphs"))
    far = referenced_graphs(q).agg(F.count(F.lit(1)).alias("referenced_graphs"))
    return local.crossJoin(far)  # one row each


def in_degree(q: DataFrame, p: str | None = None) -> DataFrame:
    used = q if p is None else q.filter(F.col("p") == p)
    return used.filter("o_id IS NOT NULL").groupBy(F.col("o_id").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))


def out_degree(q: DataFrame) -> DataFrame:
    return q.groupBy(F.col("s_id").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"))


def facets(df: DataFrame, field: str, n: int) -> DataFrame:
    """The n most frequent values; ties by value."""
    return df.groupBy(F.col(field).alias("term")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "term").limit(n)


def literal_set(q: DataFrame) -> DataFrame:
    """All distinct literal texts of each graph, sorted."""
    own = q.filter("o_lex <> ''").select("graph_iri", F.col("o_lex").alias("lex"))
    members = q.filter("o_items IS NOT NULL").select("graph_iri", F.explode("o_items.lex").alias("lex")).filter("lex <> ''")
    return own.union(members).groupBy("graph_iri").agg(F.sort_array(F.collect_set("lex")).alias("literals"))


def accumulate(q: DataFrame) -> DataFrame:
    """Values of repeated predicates as sorted lists."""
    return q.groupBy("graph_iri", "s_id", "p").agg(F.sort_array(F.collect_list(F.coalesce("o_lex", "o_id"))).alias("values"))


#: Bytes by the planner's estimate of hashes that go to one partition, and up to how many partitions Spark writes them without a sort in memory.
HASHES, WRITERS = 2 << 20, 200


def graph_hash(q: DataFrame) -> DataFrame:
    """graph_iri, ng_rev: SHA-256 that depends on the set of statements only.

    Statement hashes are summed as numbers in four parts, which needs no sort and combines before the shuffle. Repeated statements are
    found after a shuffle by hash, so that no task holds the hashes of a whole part of the input, however that is dealt out.
    """
    h = F.sha2(F.concat_ws("\x1e", "s_kind", "s_id", "p", object_key()), 256)
    rows = spread(q.select("graph_iri", F.unhex(h).alias("h")), "h", part=HASHES, most=WRITERS).distinct()
    part = lambda i: F.sum(F.conv(F.substring(F.hex("h"), 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
    sums = rows.groupBy("graph_iri").agg(*[part(i).alias(f"h{i}") for i in range(4)], F.count(F.lit(1)).alias("n"))
    return sums.select("graph_iri", F.sha2(F.concat_ws(":", *[F.col(f"h{i}").cast("string") for i in range(4)], F.col("n").cast("string")), 256).alias("ng_rev"))


#: Rows that a task sorts at a time, so that tasks and not their memory grow with the input.
SORTED = 200_000


def canonical_nodes(q: DataFrame) -> DataFrame:
    """Nodes of each graph with their place: named fragments, then UUID fragments, then blank nodes.

    Ranges of nodes are sorted apart and numbered from the counts of the ranges before them, so that no graph meets in one task."""
    rank = F.when(F.col("kind") != "iri", 2).when(is_uuid(fragment(F.col("node"))), 1).otherwise(0)
    found = materialise(nodes(q).withColumn("__rank", rank))  # also read for the ranges' bounds
    order = ["graph_iri", "__rank", "node", "kind"]
    ranges = found.repartitionByRange(found.count() // SORTED + 1, *order).sortWithinPartitions(*order)
    at = materialise(ranges.withColumn("__at", F.monotonically_increasing_id()).withColumn("__range", F.shiftright("__at", 33)))
    discard(found)
    sizes = materialise(at.groupBy("graph_iri", "__range").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("n")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("graph_iri").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialise(sizes.select(F.col("graph_iri").alias("__graph"), F.col("__range").alias("__r"), (before - F.col("__first")).alias("__shift")))
    placed = at.join(starts, F.col("graph_iri").eqNullSafe(F.col("__graph")) & (F.col("__range") == F.col("__r")))
    return placed.select("graph_iri", "kind", "node", (F.col("__at") + F.col("__shift")).cast("int").alias("node_index"))


def runs(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Runs of equal values in each partition: first place, length and value."""
    w = Window.partitionBy(by).orderBy(*order)
    marked = df.select(by, value, F.row_number().over(w).alias("at"), (~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int").alias("new"))
    marked = marked.withColumn("run", F.sum("new").over(Window.partitionBy(by).orderBy("at")))
    return marked.groupBy(by, "run", value).agg(F.min("at").cast("long").alias("start"), F.count(F.lit(1)).alias("length"))
