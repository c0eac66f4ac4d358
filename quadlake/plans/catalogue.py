"""One query for each operator of the library on the driver's tables, with the DuckDB SQL that gives the same rows.

The tables are mapped to graphs (see sources.tables); the SQL reads the tables themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadlake._io import materialise
from quadlake.functions import hashes, iri, literals
from quadlake.functions.literals import XSD
from quadlake.operators import closure as graphs
from quadlake.operators import collections as lists
from quadlake.operators import mutation, patterns, search, sets, stats, validation, vocabulary
from quadlake.sources.tables import table_imports, table_quads, tables_quads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


T = "urn:x-table:"
LEX = "strftime({c}, '%Y-%m-%dT%H:%M:%S')"
#: The orders graph's statements, as SQL.
ORDERS = """
SELECT 'urn:x-table:orders#' || o_orderkey AS s_id, 'urn:x-table:orders/o_custkey' AS p, 'urn:x-table:customer#' || o_custkey AS o_id, NULL::VARCHAR AS o_lex FROM orders
UNION ALL SELECT 'urn:x-table:orders#' || o_orderkey, 'urn:x-table:orders/o_orderstatus', NULL, o_orderstatus FROM orders
UNION ALL SELECT 'urn:x-table:orders#' || o_orderkey, 'urn:x-table:orders/o_totalprice', NULL, o_totalprice::DECIMAL(38,4)::VARCHAR FROM orders
UNION ALL SELECT 'urn:x-table:orders#' || o_orderkey, 'urn:x-table:orders/o_orderdate', NULL, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') FROM orders
UNION ALL SELECT 'urn:x-table:orders#' || o_orderkey, 'urn:x-table:orders/o_orderpriority', NULL, o_orderpriority FROM orders
"""


@query("""SELECT 'urn:x-table:region#' || n_regionkey AS region, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey""")
def hop3_region_counts(spark, sf):
    """Orders of each region, three hops away."""
    q = {t: table_quads(spark, sf, t, [c]) for t, c in (("orders", "o_custkey"), ("customer", "c_nationkey"), ("nation", "n_regionkey"))}
    start = q["orders"].select(F.col("o_id").alias("node"))
    at = patterns.hop(q["nation"], patterns.hop(q["customer"], start, f"{T}customer/c_nationkey"), f"{T}nation/n_regionkey")
    return at.groupBy(F.col("node").alias("region")).agg(F.count(F.lit(1)).alias("orders"))


@query(f"SELECT p, coalesce(o_id, '') AS o_id, coalesce(o_lex, '') AS o_lex FROM ({ORDERS}) WHERE s_id = 'urn:x-table:orders#7'")
def pattern_spo_forward(spark, sf):
    q = patterns.match(table_quads(spark, sf, "orders"), s=f"{T}orders#7")
    return q.select("p", F.coalesce("o_id", F.lit("")).alias("o_id"), F.coalesce("o_lex", F.lit("")).alias("o_lex"))


@query("SELECT 'urn:x-table:orders#' || o_orderkey AS s_id FROM orders WHERE o_custkey = 11")
def pattern_inverse(spark, sf):
    return patterns.match(table_quads(spark, sf, "orders", ["o_custkey"]), o=f"{T}customer#11").select("s_id")


@query("SELECT 'urn:x-table:part#' || p_partkey AS s_id, p_brand AS o_lex FROM part")
def pattern_predicate(spark, sf):
    return patterns.match(table_quads(spark, sf, "part", ["p_brand"]), p=f"{T}part/p_brand").select("s_id", "o_lex")


@query(f"SELECT s_id, p FROM ({ORDERS}) WHERE o_id = 'urn:x-table:customer#11' UNION ALL SELECT 'urn:x-table:customer#11', unnest(['urn:x-table:customer/c_name', 'urn:x-table:customer/c_nationkey', 'urn:x-table:customer/c_acctbal', 'urn:x-table:customer/c_mktsegment'])")
def touching_node(spark, sf):
    return patterns.touching(tables_quads(spark, sf, ["orders", "customer"]), f"{T}customer#11").select("s_id", "p")


@query("SELECT 4 + (SELECT count(*) FROM orders WHERE o_custkey = 11) AS triples")
def triple_count(spark, sf):
    return patterns.triple_count(tables_quads(spark, sf, ["orders", "customer"]), f"{T}customer#11")


@query("SELECT o_orderstatus AS o_lex, 'http://www.w3.org/2001/XMLSchema#string' AS o_dt FROM orders WHERE o_orderkey = 7")
def get_objects(spark, sf):
    return patterns.objects(table_quads(spark, sf, "orders", ["o_orderstatus"]), f"{T}orders#7", f"{T}orders/o_orderstatus").select("o_lex", "o_dt")


@query("SELECT 'urn:x-table:orders#' || o_orderkey AS s_id, 'urn:x-table:customer#' || o_custkey AS o_id FROM orders WHERE o_custkey = o_orderkey % 100")
def check_triple_semi(spark, sf):
    """Which of the statements order n -> customer n mod 100 exist."""
    wanted = read(spark, sf, "orders").select(F.concat(F.lit(f"{T}orders#"), F.col("o_orderkey").cast("string")).alias("s_id"), F.lit(f"{T}orders/o_custkey").alias("p"), F.concat(F.lit(f"{T}customer#"), (F.col("o_orderkey") % 100).cast("string")).alias("o_id"))
    return patterns.existing(table_quads(spark, sf, "orders", ["o_custkey"]), wanted).select("s_id", "o_id")


@query("SELECT DISTINCT 'urn:x-table:customer#' || o_custkey AS node FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def undefined_nodes(spark, sf):
    """Customers that orders name and that a graph without the building segment lacks."""
    some = table_quads(spark, sf, "customer", ["c_mktsegment"]).filter("o_lex <> 'BUILDING'")
    return patterns.undefined_nodes(table_quads(spark, sf, "orders", ["o_custkey"]).unionByName(some))


@query("SELECT unnest(['urn:x-table:customer', 'urn:x-table:orders', 'urn:x-table:part', 'urn:x-table:supplier']) AS graph_iri")
def referenced_graphs(spark, sf):
    q = table_quads(spark, sf, "orders", ["o_custkey"]).filter("false").unionByName(table_quads(spark, sf, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey"]))
    return patterns.referenced_graphs(q.unionByName(table_quads(spark, sf, "orders", ["o_custkey"]).withColumn("graph_iri", F.lit(f"{T}lineitem"))))


@query("""SELECT 'urn:x-table:orders' AS graph_iri, 'iri' AS kind, (SELECT count(*) FROM orders) + (SELECT count(DISTINCT o_custkey) FROM orders) AS nodes
UNION ALL SELECT 'urn:x-table:nation', 'iri', (SELECT count(*) FROM nation) + (SELECT count(DISTINCT n_regionkey) FROM nation)""")
def node_kinds(spark, sf):
    return stats.node_kinds(table_quads(spark, sf, "orders", ["o_custkey"]).unionByName(table_quads(spark, sf, "nation")))


@query("SELECT 'urn:x-table:customer#' || c_custkey AS s_id FROM customer WHERE c_custkey = 5")
def node_by_fragment(spark, sf):
    return patterns.by_fragment(table_quads(spark, sf, "customer", ["c_name"]), f"{T}customer", "5").select("s_id")


@query("""SELECT 'urn:x-table:' || t AS graph_iri, n * c AS triples, n AS subjects, n * r AS "references", n * (c - r) AS literals, 0::BIGINT AS list_members, c AS predicates, i AS direct_imports, a AS all_imports FROM (
SELECT 'orders' AS t, count(*) AS n, 5::BIGINT AS c, 1::BIGINT AS r, 1::BIGINT AS i, 3::BIGINT AS a FROM orders UNION ALL SELECT 'customer', count(*), 4, 1, 1, 2 FROM customer
UNION ALL SELECT 'nation', count(*), 2, 1, 1, 1 FROM nation UNION ALL SELECT 'region', count(*), 1, 0, 0, 0 FROM region)""")
def graph_info(spark, sf):
    imports = table_imports(spark)
    q = tables_quads(spark, sf, ["orders", "customer", "nation", "region"])
    return stats.graph_info(q, imports, graphs.closure(imports.select(F.col("graph_iri").alias("a"), F.col("imported_iri").alias("b"))))


@query("SELECT (SELECT count(*) * 5 FROM orders) + (SELECT count(*) * 2 FROM nation) AS triples, 2::BIGINT AS local_graphs, 2::BIGINT AS referenced_graphs")
def stage_info(spark, sf):
    return stats.stage_info(tables_quads(spark, sf, ["orders", "nation"]))


@query("SELECT 'urn:x-table:customer#' || o_custkey AS node, count(*) AS in_degree FROM orders GROUP BY o_custkey")
def in_degree(spark, sf):
    return stats.in_degree(table_quads(spark, sf, "orders", ["o_custkey"]))


@query("SELECT 'urn:x-table:orders#' || o_orderkey AS node, 5::BIGINT AS out_degree FROM orders")
def out_degree(spark, sf):
    return stats.out_degree(table_quads(spark, sf, "orders"))


@query(f"SELECT 'urn:x-table:orders' AS graph_iri, p, count(*) AS triples, count(DISTINCT s_id) AS subjects FROM ({ORDERS}) GROUP BY p")
def predicate_usage(spark, sf):
    return patterns.predicate_usage(table_quads(spark, sf, "orders"))


@query("SELECT event_type AS term, count(*) AS count FROM events GROUP BY event_type ORDER BY count DESC, term LIMIT 3")
def facet_event_type(spark, sf):
    return stats.facets(read(spark, sf, "events"), "event_type", 3)


@query("SELECT 'urn:x-table:nation' AS graph_iri, list_sort(list(DISTINCT n_name)) AS literals FROM nation")
def literal_set_sorted(spark, sf):
    return stats.literal_set(table_quads(spark, sf, "nation"))


@query("SELECT 'urn:x-table:orders' AS graph_iri, 'urn:x-table:orders#' || o_orderkey AS s_id, 'urn:x-table:orders/o_orderstatus' AS p, [o_orderstatus] AS \"values\" FROM orders")
def value_accumulation(spark, sf):
    return stats.accumulate(table_quads(spark, sf, "orders", ["o_orderstatus"]))


@query("SELECT o_orderkey AS key, sha256(concat_ws(chr(31), o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus)) AS content FROM orders")
def content_hash(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), hashes.content_hash(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")).alias("content"))


@query("""SELECT sha256(string_agg(c_custkey || ':' || c_name, ',' ORDER BY c_custkey)) AS version FROM customer""")
def version_hash(spark, sf):
    """A hash over sorted parts; the parts of one repository's refs are few."""
    parts = read(spark, sf, "customer").select("c_custkey", F.concat_ws(":", "c_custkey", "c_name").alias("x"))
    return lists.collect(parts.withColumn("all", F.lit(1)), ["all"], ["c_custkey"], "x").select(F.sha2(F.array_join("items", ","), 256).alias("version"))


@query("""WITH n AS (SELECT 'urn:x-table:customer#' || o_custkey AS node FROM orders UNION SELECT 'urn:x-table:orders#' || o_orderkey FROM orders)
SELECT 'urn:x-table:orders' AS graph_iri, node, (row_number() OVER (ORDER BY node) - 1)::INTEGER AS node_index FROM n""")
def canonical_node_order(spark, sf):
    return stats.canonical_nodes(table_quads(spark, sf, "orders", ["o_custkey"])).select("graph_iri", "node", "node_index")


@query(f"SELECT s_id, p, (row_number() OVER (PARTITION BY s_id ORDER BY (o_id IS NULL)::INT, p) - 1)::INTEGER AS triple_index FROM ({ORDERS})")
def triple_index(spark, sf):
    return patterns.triple_index(table_quads(spark, sf, "orders")).select("s_id", "p", "triple_index")


@query(f"SELECT p FROM (SELECT p, row_number() OVER (ORDER BY (o_id IS NULL)::INT, p) - 1 AS i FROM ({ORDERS}) WHERE s_id = 'urn:x-table:orders#7') WHERE i = 2")
def get_triple(spark, sf):
    return patterns.triple_at(table_quads(spark, sf, "orders"), f"{T}orders#7", 2).select("p")


@query("""WITH m AS (SELECT user_id, event_type, row_number() OVER w AS pos, (event_type IS DISTINCT FROM lag(event_type) OVER w)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY pos) AS run FROM m)
SELECT user_id, run::BIGINT AS run, event_type, min(pos) AS start, count(*) AS length FROM r GROUP BY user_id, run, event_type""")
def runlength_spans(spark, sf):
    return stats.runs(read(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("SELECT c_custkey AS key, regexp_replace(c_name, '[0-9]+$', '') || lpad(regexp_extract(c_name, '([0-9]+)$', 1), 10, '0') AS sort_key FROM customer")
def natural_sort_key(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("key"), iri.natural_sort_key(F.col("c_name")).alias("sort_key"))


@query("SELECT event_id, event_type FROM events WHERE event_id <= 500 AND event_id > 450 ORDER BY event_id DESC")
def log_range_desc(spark, sf):
    return read(spark, sf, "events").filter("event_id <= 500 AND event_id > 450").select("event_id", "event_type").orderBy(F.desc("event_id"))


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 20")
def log_last_n(spark, sf):
    return read(spark, sf, "events").select("event_id", "event_type").orderBy(F.desc("event_id")).limit(20)


# ---- sets, difference, merge

CHANGED = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 10 <> 3 UNION ALL SELECT o_orderkey + 10000000, o_orderstatus FROM orders WHERE o_orderkey % 100 = 1"


def _versions(spark, sf):
    """The graph of order states, and a version with some gone, some changed and some new."""
    q = table_quads(spark, sf, "orders", ["o_orderstatus"])
    key = F.regexp_extract("s_id", "#([0-9]+)$", 1).cast("long")
    new = q.filter(key % 10 != 3).withColumn("o_lex", F.when(key % 7 == 0, "X").otherwise(F.col("o_lex")))
    more = q.filter(key % 100 == 1).withColumn("s_id", F.concat(F.lit(f"{T}orders#"), (key + 10000000).cast("string")))
    return q, new.unionByName(more)


@query(f"""WITH a AS (SELECT o_orderkey, o_orderstatus FROM orders), b AS ({CHANGED})
SELECT (-1)::INTEGER AS flag, 'urn:x-table:orders#' || o_orderkey AS s_id, o_orderstatus AS o_lex FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 1, 'urn:x-table:orders#' || o_orderkey, o_orderstatus FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def graph_diff_flags(spark, sf):
    return sets.difference(*_versions(spark, sf)).select("flag", "s_id", "o_lex")


@query(f"""WITH b AS ({CHANGED}), j AS (SELECT a.o_orderkey AS k, b.o_orderkey AS n, a.o_orderstatus AS x, b.o_orderstatus AS y FROM orders a FULL JOIN b USING (o_orderkey))
SELECT CASE WHEN n IS NULL THEN 'removed' WHEN k IS NULL THEN 'added' WHEN x = y THEN 'same' ELSE 'modified' END AS state, count(*) AS nodes FROM j GROUP BY 1""")
def graph_diff_nodes(spark, sf):
    return sets.node_difference(*_versions(spark, sf)).groupBy("state").agg(F.count(F.lit(1)).alias("nodes"))


@query("SELECT * FROM (VALUES ('urn:x-table:orders', 'urn:x-table:customer', -1), ('urn:x-table:region', 'urn:x-table:world', 1)) t(graph_iri, imported_iri, flag)")
def import_diff(spark, sf):
    old = table_imports(spark)
    new = mutation.remove_import(mutation.add_import(old, f"{T}region", f"{T}world"), f"{T}orders", f"{T}customer")
    return sets.import_difference(old, new).filter("flag <> 0")


@query("""WITH i AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos FROM lineitem),
a AS (SELECT l_orderkey, list(l_partkey ORDER BY pos) AS x FROM i GROUP BY 1), b AS (SELECT l_orderkey, list(l_partkey ORDER BY pos) AS y FROM i WHERE l_partkey % 11 <> 0 GROUP BY 1)
SELECT 'urn:x-table:orders' AS graph_iri, l_orderkey AS node, x AS old_items, y AS new_items FROM a FULL JOIN b USING (l_orderkey) WHERE x IS DISTINCT FROM y""")
def collection_diff(spark, sf):
    """Part lists of orders, before and after some parts are taken out."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = read(spark, sf, "lineitem").select(F.lit(f"{T}orders").alias("graph_iri"), F.col("l_orderkey").alias("node"), F.row_number().over(w).alias("pos"), F.col("l_partkey").alias("item"))
    return sets.collection_difference(rows, rows.filter("item % 11 <> 0"))


@query("SELECT true AS same, false AS changed_same")
def graph_equal(spark, sf):
    old, new = _versions(spark, sf)
    return spark.createDataFrame([(sets.equal(old, old.unionByName(old)), sets.equal(old, new))], "same boolean, changed_same boolean")


@query(f"SELECT 'urn:x-table:orders#' || o_orderkey AS s_id, o_orderstatus AS o_lex FROM (SELECT o_orderkey, o_orderstatus FROM orders UNION ({CHANGED}))")
def merge_union(spark, sf):
    return sets.merge(*_versions(spark, sf)).select("s_id", "o_lex")


@query(f"SELECT 'urn:x-table:orders#' || o_orderkey AS s_id, o_orderstatus AS o_lex FROM ({CHANGED})")
def patch_apply(spark, sf):
    old, new = _versions(spark, sf)
    return sets.patch(old, sets.difference(old, new)).select("s_id", "o_lex")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0""")
def sync_insert_missing(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", "c_name")
    return sets.insert_missing(c.filter("c_custkey % 3 = 0"), c.filter("c_custkey % 2 = 0"), ["c_custkey"])



@query("SELECT * FROM (VALUES ('g1', 'union'), ('g2', 'union'), ('g3', 'move'), ('g4', 'keep'), ('g5', 'replace'), ('g6', 'union'), ('g7', 'keep'), ('g8', 'nothing'), ('g9', 'union')) t(graph_iri, action)")
def merge_decision(spark, sf):
    cols = "graph_iri string, state string, modified boolean, commit string, repository string"
    to = [("g1", "referenced", False, None, "r"), ("g2", "local", False, None, "r"), *[(f"g{i}", "local", m, c, "r") for i, m, c in ((4, False, "c2"), (5, False, "c1"), (6, True, "c3"), (7, True, "c1"), (8, True, "c1"))], ("g9", "local", False, None, "r")]
    parent = {"g4": "c1", "g5": "c1", "g6": "c0"}
    frm = [("g1", "local", False, None, "r"), ("g2", "referenced", False, None, "r"), ("g3", "local", True, None, "r"), ("g4", "local", False, "c1", "r"), ("g5", "local", False, "c2", "r"), ("g6", "local", False, "c4", "r"), ("g7", "local", False, "c1", "r"), ("g8", "local", True, "c1", "r"), ("g9", "local", False, "c1", "r2")]
    t = spark.createDataFrame([(*r, parent.get(r[0])) for r in to], f"{cols}, common_parent string")
    return sets.merge_actions(t, spark.createDataFrame(frm, cols))


# ---- recursion

IMPORTS = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in (("lineitem", "orders"), ("lineitem", "part"), ("lineitem", "supplier"), ("orders", "customer"), ("customer", "nation"), ("supplier", "nation"), ("nation", "region"))) + ") i(a, b)"


def _imports(spark):
    return table_imports(spark).select(F.regexp_replace("graph_iri", T, "").alias("a"), F.regexp_replace("imported_iri", T, "").alias("b"))


@query(f"WITH RECURSIVE r(a, b) AS (SELECT a, b FROM {IMPORTS} UNION SELECT r.a, i.b FROM r JOIN {IMPORTS} ON r.b = i.a) SELECT a, b FROM r")
def imports_closure(spark, sf):
    return graphs.closure(_imports(spark)).select("a", "b")


@query(f"WITH RECURSIVE r(node) AS (SELECT 'nation' UNION SELECT i.a FROM r JOIN {IMPORTS} ON r.node = i.b) SELECT node FROM r")
def modified_importers(spark, sf):
    """The changed graph and all that import it, directly or not."""
    edges = _imports(spark).select(F.col("b").alias("a"), F.col("a").alias("b"))
    return graphs.reach(edges, spark.createDataFrame([("nation",)], "node string")).select("node")


@query("SELECT false AS cyclic, true AS cyclic_with_edge")
def import_cycle_check(spark, sf):
    e = _imports(spark)
    return spark.createDataFrame([(graphs.has_cycle(e), graphs.has_cycle(e.union(spark.createDataFrame([("region", "orders")], "a string, b string"))))], "cyclic boolean, cyclic_with_edge boolean")


PLACES = """e AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""


def _places(spark, sf):
    c = read(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("a"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("b"))
    n = read(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("a"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("b"))
    return c.union(n)


@query(f"WITH RECURSIVE {PLACES}, r(a, b, depth) AS (SELECT a, b, 1 FROM e UNION SELECT r.a, e.b, r.depth + 1 FROM r JOIN e ON r.b = e.a) SELECT a, b, min(depth)::INTEGER AS depth FROM r GROUP BY a, b")
def subclass_closure(spark, sf):
    return graphs.closure(_places(spark, sf))


@query(f"WITH RECURSIVE {PLACES}, r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS node FROM r WHERE b = 'r2' AND a LIKE 'c%'")
def is_kind(spark, sf):
    return graphs.is_kind(_places(spark, sf).filter("a LIKE 'c%'").select(F.col("a").alias("node"), F.col("b").alias("cls")), _places(spark, sf), "r2")


OWL_EDGES = "(VALUES ('Bolt', 'Part'), ('Part', 'Thing'), ('Thing', 'Entity'), ('Entity', 'Thing'), ('Nut', 'Fastener'), ('Bolt', 'Fastener'), ('Steel', 'Metal'), ('SteelBolt', 'Steel'), ('SteelBolt', 'Bolt')) o(a, b)"


@query(f"WITH RECURSIVE r(a, b) AS (SELECT a, b FROM {OWL_EDGES} UNION SELECT r.a, o.b FROM r JOIN {OWL_EDGES} ON r.b = o.a) SELECT a, b FROM r")
def subsumption_owl(spark, sf):
    """Unions, intersections and equivalence, with a cycle."""
    direct = spark.createDataFrame([("Bolt", "Part", "subClassOf"), ("Part", "Thing", "subClassOf"), ("Thing", "Entity", "equivalentClass"), ("Steel", "Metal", "subClassOf")], "a string, b string, kind string")
    members = spark.createDataFrame([("Fastener", "Nut", "unionOf"), ("Fastener", "Bolt", "disjointUnionOf"), ("SteelBolt", "Steel", "intersectionOf"), ("SteelBolt", "Bolt", "intersectionOf")], "cls string, member string, kind string")
    return graphs.closure(graphs.subsumption_edges(direct, members)).select("a", "b")


@query("SELECT p_partkey AS node, CASE WHEN p_type = 'ECONOMY' THEN 'Standard' ELSE p_type END AS cls FROM part WHERE p_type IN ('ECONOMY', 'PROMO', 'STANDARD')")
def type_of_supersedure(spark, sf):
    """Parts typed by p_type; ECONOMY parts are Standard too, which supersedes nothing, while Standard is above ECONOMY's base."""
    p = read(spark, sf, "part").filter("p_type IN ('ECONOMY', 'PROMO', 'STANDARD')")
    typed = p.select(F.col("p_partkey").alias("node"), F.col("p_type").alias("cls")).union(p.filter("p_type = 'ECONOMY'").select("p_partkey", F.lit("Standard")))
    main = spark.createDataFrame([("Standard",), ("ECONOMY",), ("PROMO",), ("STANDARD",)], "cls string")
    return vocabulary.type_of(typed, main, spark.createDataFrame([("Standard", "ECONOMY")], "a string, b string"))


@query("SELECT * FROM (VALUES ('isbn', 'Book'), ('code', 'Item'), ('serial', 'Item'), ('sub', 'Book')) t(node, domain)")
def inherited_domain_range(spark, sf):
    up = spark.createDataFrame([("isbn", "code"), ("serial", "code"), ("sub", "isbn")], "a string, b string")
    return graphs.nearest(up, spark.createDataFrame([("isbn", "Book"), ("code", "Item")], "node string, domain string"), "domain")


CHAIN = """c AS (SELECT event_id AS a, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, user_id FROM events)"""


def _chain(spark, sf):
    """Events as commits, each with its user's event before it as a parent."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf, "events").select(F.col("event_id").alias("a"), F.lag("event_id").over(w).alias("b"), "user_id")
    return e.filter("b IS NOT NULL")


@query(f"WITH RECURSIVE {CHAIN}, r(a, b, depth) AS (SELECT a, b, 1 FROM c WHERE b IS NOT NULL UNION ALL SELECT r.a, c.b, r.depth + 1 FROM r JOIN c ON r.b = c.a WHERE c.b IS NOT NULL) SELECT a, b, depth::INTEGER AS depth FROM r")
def commit_ancestry(spark, sf):
    return graphs.closure(_chain(spark, sf).select("a", "b"))


DAG = "(VALUES ('c1', 'c0'), ('c2', 'c1'), ('c3', 'c1'), ('c4', 'c2'), ('c4', 'c3'), ('c5', 'c3'), ('x1', 'x0')) d(a, b)"


def _dag(spark):
    return spark.createDataFrame([("c1", "c0"), ("c2", "c1"), ("c3", "c1"), ("c4", "c2"), ("c4", "c3"), ("c5", "c3"), ("x1", "x0")], "a string, b string")


@query("SELECT * FROM (VALUES ('c3', 1, 1), ('c1', 2, 2), ('c0', 3, 3)) t(node, depth_x, depth_y)")
def common_parent(spark, sf):
    return graphs.common_ancestors(_dag(spark), "c4", "c5")


@query("SELECT * FROM (VALUES ('c1', 'c4', 'older'), ('c4', 'c0', 'newer'), ('c2', 'c3', 'unrelated'), ('c5', 'c5', 'same'), ('x1', 'c4', 'unrelated')) t(x, y, relation)")
def commit_relation(spark, sf):
    return graphs.relation(_dag(spark), spark.createDataFrame([("c1", "c4"), ("c4", "c0"), ("c2", "c3"), ("c5", "c5"), ("x1", "c4")], "x string, y string"))


@query(f"WITH RECURSIVE r(node, depth) AS (SELECT unnest(['c4', 'c5']), 0 UNION SELECT d.b, r.depth + 1 FROM r JOIN {DAG} ON r.node = d.a) SELECT node, min(depth)::INTEGER AS layer FROM r GROUP BY node")
def history_layers(spark, sf):
    found = graphs.reach(_dag(spark), spark.createDataFrame([("c4",), ("c5",)], "node string"))
    return found.groupBy("node").agg(F.min("depth").alias("layer"))


@query("SELECT * FROM (VALUES ('c0'), ('c1'), ('c2'), ('c3')) t(node) WHERE node NOT IN ('c4', 'c5', 'x1') AND node IN (SELECT b FROM (VALUES ('c0'), ('c1'), ('c2'), ('c3'), ('x0')) q(b))")
def ancestor_sets(spark, sf):
    """Commits below either of two tips."""
    return graphs.reach(_dag(spark), spark.createDataFrame([("c4",), ("c5",)], "node string")).filter("depth > 0").select("node").distinct()


@query("""WITH l AS (SELECT event_id FROM events), p AS (SELECT lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT event_id AS "commit" FROM l WHERE event_id NOT IN (SELECT b FROM p WHERE b IS NOT NULL)""")
def leaf_commits(spark, sf):
    e = read(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    parents = e.select(F.lag("event_id").over(w).alias("event_id")).filter("event_id IS NOT NULL")
    return e.select("event_id").join(parents, "event_id", "left_anti").select(F.col("event_id").alias("commit"))


@query("""SELECT 'c' || c_custkey AS node, min('c' || c_custkey) OVER (PARTITION BY n_regionkey) AS component FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def connected_components(spark, sf):
    found = graphs.components(_places(spark, sf))
    return found.filter("node LIKE 'c%'")


@query("""WITH g AS (SELECT n_regionkey, count(*) + count(DISTINCT n_nationkey) + 1 AS size FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT size, count(*) AS components FROM g GROUP BY size""")
def component_sizes(spark, sf):
    e = _places(spark, sf)
    used = e.filter("a LIKE 'c%'").select("b").distinct()
    e = e.filter("a LIKE 'c%'").union(e.filter("a LIKE 'n%'").join(used.select(F.col("b").alias("a")), "a", "left_semi").select("a", "b"))
    return graphs.components(e).groupBy("component").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("components"))


@query("""SELECT 'r' || r_regionkey AS seed, 'c' || c_custkey AS node, 'customer' AS kind, 2 AS depth FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey
UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 'nation', 1 FROM nation UNION ALL SELECT 'r' || r_regionkey, 'r' || r_regionkey, 'region', 0 FROM region""")
def rule_traversal(spark, sf):
    """From regions against the direction of two predicates, as rules allow."""
    e = _places(spark, sf).select(F.col("a").alias("s"), F.when(F.col("a").startswith("c"), "nationkey").otherwise("regionkey").alias("p"), F.col("b").alias("o"))
    node = e.select(F.col("s").alias("node")).union(e.select("o")).distinct()
    kind = F.when(F.col("node").startswith("c"), "customer").when(F.col("node").startswith("n"), "nation").otherwise("region")
    rules = spark.createDataFrame([("region", "regionkey", "nation", False), ("nation", "nationkey", "customer", False)], "from_kind string, p string, to_kind string, forward boolean")
    return graphs.traverse(e, node.withColumn("kind", kind), rules, node.filter("node LIKE 'r%'"), max_depth=4)


@query("""SELECT 'r' || n_regionkey AS root, count(*) AS nodes FROM (SELECT n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_regionkey FROM nation UNION ALL SELECT r_regionkey FROM region) GROUP BY n_regionkey""")
def part_whole_groups(spark, sf):
    down = _places(spark, sf).select(F.col("b").alias("a"), F.col("a").alias("b"))
    tops = read(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.col("r_regionkey").alias("priority"))
    return graphs.part_groups(down, tops).groupBy("root").agg(F.count(F.lit(1)).alias("nodes"))


# ---- revisions

LATEST = "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events {w}) WHERE n = 1"


def _latest(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("x")).select("user_id", "x.event_id", "x.event_type")


@query(LATEST.format(w=""))
def branch_checkout(spark, sf):
    """The newest version of each key."""
    return _latest(read(spark, sf, "events"))


@query(LATEST.format(w="WHERE event_id <= 400"))
def checkout_commit(spark, sf):
    """The versions as of a commit."""
    return _latest(read(spark, sf, "events").filter("event_id <= 400"))


@query(LATEST.format(w="WHERE ts < TIMESTAMP '2024-01-15'"))
def checkout_revision(spark, sf):
    return _latest(read(spark, sf, "events").filter(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz" if dict(read(spark, sf, "events").dtypes)["ts"] == "timestamp_ntz" else "timestamp")))


# ---- functions

@query("""WITH h AS (SELECT c_custkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('urn:x-table:customer/' || c_custkey)) AS h FROM customer)
SELECT c_custkey AS key, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ['8','9','a','b'][(('0x' || substr(h, 17, 1))::INT % 4) + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS graph_id FROM h""")
def uuid5_graph_id(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("key"), iri.graph_id(F.concat(F.lit(f"{T}customer/"), F.col("c_custkey").cast("string"))).alias("graph_id"))


@query("SELECT page_id, regexp_replace(url, '#[^#]*$', '') AS base, CASE WHEN contains(url, '#') THEN regexp_extract(url, '#([^#]*)$', 1) ELSE '' END AS fragment FROM pages")
def iri_split(spark, sf):
    return read(spark, sf, "pages").select("page_id", iri.base(F.col("url")).alias("base"), iri.fragment(F.col("url")).alias("fragment"))


@query("SELECT page_id, regexp_extract(url, '^(.*[/#])?', 1) AS prefix, regexp_extract(url, '([^/#]*)$', 1) AS name FROM pages")
def iri_split_slash(spark, sf):
    return read(spark, sf, "pages").select("page_id", iri.split_slash(F.col("url")).alias("x")).select("page_id", "x.prefix", "x.name")


@query("SELECT c_custkey AS key, lower(replace(replace(replace(trim(c_mktsegment || ' ' || c_name || '_', '-_/ '), '_', '-'), '/', '-'), ' ', '-')) AS token FROM customer")
def separated_tokenizer(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("key"), iri.separated(F.concat("c_mktsegment", F.lit(" "), "c_name", F.lit("_"))).alias("token"))


@query("SELECT p_partkey AS key, lower(p_name) AS token FROM part")
def phrase_analyzer(spark, sf):
    return read(spark, sf, "part").select(F.col("p_partkey").alias("key"), iri.phrase(F.col("p_name")).alias("token"))


LITERALS = [("12", "integer"), ("x", "integer"), ("300", "byte"), ("70000", "short"), ("18446744073709551615", "unsignedLong"), ("-1", "unsignedInt"), ("1.5", "double"), ("true", "boolean"), ("maybe", "boolean"), ("2024-01-01", "date"), ("7.25", "decimal"), ("9", "long")]


@query("""SELECT lex, dt, CASE WHEN dt IN ('byte','int','long','unsignedByte','unsignedShort','unsignedInt','unsignedLong') THEN 'integer' WHEN dt = 'decimal' THEN 'double' WHEN dt = 'date' THEN NULL ELSE dt END AS read_as,
CASE dt WHEN 'integer' THEN try_cast(lex AS BIGINT) IS NOT NULL WHEN 'long' THEN try_cast(lex AS BIGINT) IS NOT NULL WHEN 'byte' THEN try_cast(lex AS TINYINT) IS NOT NULL WHEN 'short' THEN try_cast(lex AS SMALLINT) IS NOT NULL
WHEN 'unsignedLong' THEN try_cast(lex AS DECIMAL(20,0)) >= 0 WHEN 'unsignedInt' THEN try_cast(lex AS BIGINT) >= 0 WHEN 'double' THEN try_cast(lex AS DOUBLE) IS NOT NULL WHEN 'decimal' THEN try_cast(lex AS DOUBLE) IS NOT NULL WHEN 'boolean' THEN try_cast(lex AS BOOLEAN) IS NOT NULL ELSE false END AS valid
FROM (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in LITERALS) + ") t(lex, dt)")
def literal_cast_rules(spark, sf):
    d = spark.createDataFrame(LITERALS, "lex string, dt string")
    full = F.concat(F.lit(XSD), F.col("dt"))
    return d.select("lex", "dt", F.regexp_replace(literals.read_type(full), XSD, "").alias("read_as"), literals.valid(F.col("lex"), full).alias("valid"))


@query("""WITH i AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos FROM lineitem)
SELECT 'o' || l_orderkey AS s_id, list('p' || l_partkey ORDER BY pos) AS members, count(*)::INTEGER AS n FROM i GROUP BY l_orderkey""")
def list_rebuild(spark, sf):
    """Part lists written as rdf:first/rest chains and folded again."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.row_number().over(w).alias("pos"), F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")).alias("n"))
    rows = materialise(rows)
    cell = lambda pos: F.concat(F.lit("_:l"), F.col("l_orderkey").cast("string"), F.lit("_"), pos.cast("string"))
    nil = F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#nil")
    first = rows.select(cell(F.col("pos")).alias("s"), F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#first").alias("p"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("o"))
    rest = rows.select(cell(F.col("pos")).alias("s"), F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#rest").alias("p"), F.when(F.col("pos") < F.col("n"), cell(F.col("pos") + 1)).otherwise(nil).alias("o"))
    head = rows.filter("pos = 1").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("s"), F.lit("parts").alias("p"), cell(F.col("pos")).alias("o"))
    q = mutation.statements(first.union(rest).union(head), "g")
    return lists.rebuild_lists(q).filter("o_items IS NOT NULL").select("s_id", F.col("o_items.id").alias("members"), F.size("o_items").alias("n"))


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::INTEGER AS pos, role FROM conversations")
def collection_members(spark, sf):
    c = lists.collect(read(spark, sf, "conversations").withColumn("x", F.col("role")), ["conv_id"], ["turn", "role", "text"], "x")
    return c.select("conv_id", F.posexplode("items").alias("pos", "role"))


@query("SELECT count(*) AS encoded, 44::INTEGER AS width, true AS round_trip FROM customer")
def base58_hash(spark, sf):
    h = read(spark, sf, "customer").select(hashes.content_hash(F.col("c_custkey")).alias("h"))
    b = h.select("h", hashes.base58(F.col("h")).alias("b"))
    return b.select("h", "b", hashes.from_base58(F.col("b")).alias("back")).agg(F.count("b").alias("encoded"), F.max(F.length("b")).alias("width"), F.every(F.col("h") == F.col("back")).alias("round_trip"))


# ---- validation

@query("SELECT 'urn:x-table:orders' AS graph_iri, 'functional_property' AS rule, 'urn:x-table:customer#' || o_custkey AS node, count(*) AS count FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def functional_property_violations(spark, sf):
    """Orders of a customer under a property that is declared functional."""
    o = read(spark, sf, "orders").select(F.concat(F.lit(f"{T}customer#"), F.col("o_custkey").cast("string")).alias("s"), F.lit("places").alias("p"), F.concat(F.lit(f"{T}orders#"), F.col("o_orderkey").cast("string")).alias("o"))
    onto = mutation.statements(spark.createDataFrame([("places", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://www.w3.org/2002/07/owl#FunctionalProperty")], "s string, p string, o string"), "onto")
    return validation.functional(mutation.statements(o, f"{T}orders"), onto).select("graph_iri", "rule", "node", "count")


@query("SELECT 'urn:x-table:orders' AS graph_iri, 'inverse_functional_property' AS rule, 'urn:x-table:customer#' || o_custkey AS node, count(*) AS count FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def inverse_functional_violations(spark, sf):
    onto = mutation.statements(spark.createDataFrame([(f"{T}orders/o_custkey", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://www.w3.org/2002/07/owl#InverseFunctionalProperty")], "s string, p string, o string"), "onto")
    return validation.functional(table_quads(spark, sf, "orders", ["o_custkey"]), onto).select("graph_iri", "rule", "node", "count")


ONTOLOGY = [("Furniture", "type", "Main"), ("Building", "type", "Main"), ("Auto", "sub", "Building"), ("seg", "type", "Object"), ("seg", "domain", "Building"), ("bal", "type", "Data"), ("bal", "range", "integer")]


def _typed(spark, sf):
    """Customers typed by segment, where it has a class, with two properties; and a small ontology."""
    names = {"type": "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "sub": "http://www.w3.org/2000/01/rdf-schema#subClassOf", "domain": "http://www.w3.org/2000/01/rdf-schema#domain", "range": "http://www.w3.org/2000/01/rdf-schema#range", "Main": vocabulary.MAIN_CLASS, "Object": "http://www.w3.org/2002/07/owl#ObjectProperty", "Data": "http://www.w3.org/2002/07/owl#DatatypeProperty", "integer": f"{XSD}integer"}
    onto = mutation.statements(spark.createDataFrame([tuple(names.get(x, x) for x in row) for row in ONTOLOGY], "s string, p string, o string"), "onto")
    c = read(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("s"), "c_mktsegment", "c_custkey", "c_acctbal")
    cls = F.create_map(*[F.lit(x) for x in ("FURNITURE", "Furniture", "BUILDING", "Building", "AUTOMOBILE", "Auto", "MACHINERY", "Unknown")])[F.col("c_mktsegment")]
    none = F.lit(None).cast("string")
    rows = c.select("s", F.lit(names["type"]).alias("p"), cls.alias("o"), none.alias("dt")).filter("o IS NOT NULL")
    rows = rows.union(c.select("s", F.lit("seg"), F.lit("s1"), none)).union(c.select("s", F.lit("bal"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 5 == 0, f"{XSD}string").otherwise(f"{XSD}integer")))
    return mutation.statements(rows, "g"), onto


@query("""SELECT 'g' AS graph_iri, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'RdfType_wrong' ELSE 'RdfType_missing' END AS rule, 'c' || c_custkey AS node FROM customer WHERE c_mktsegment NOT IN ('FURNITURE', 'BUILDING', 'AUTOMOBILE')""")
def rdf_type_missing(spark, sf):
    return validation.rdf_type(*_typed(spark, sf)).select("graph_iri", "rule", "node")


@query("""SELECT 'domain_mismatch' AS rule, 'c' || c_custkey AS node, 'seg' AS p, 'c' || c_custkey AS value FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE')
UNION ALL SELECT 'range_mismatch', 'c' || c_custkey, 'bal', c_custkey::VARCHAR FROM customer WHERE c_custkey % 5 = 0""")
def domain_range_mismatch(spark, sf):
    return validation.domain_and_range(*_typed(spark, sf)).select("rule", "node", "p", "value")


@query("SELECT p_type AS main_type, p_brand AS id, p_name AS owner, count(*) AS graphs FROM part GROUP BY ALL HAVING count(*) > 1")
def id_uniqueness_precondition(spark, sf):
    docs = read(spark, sf, "part").select(F.col("p_type").alias("main_type"), F.col("p_brand").alias("id"), F.col("p_name").alias("owner"))
    return validation.uniqueness(docs, ["main_type", "id", "owner"])


@query()
def json_report(spark, sf):
    return validation.report(validation.validate(*_typed(spark, sf)))


# ---- search

WORDS = r"list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))"
DOC = f"d AS (SELECT doc_id, text, lang, source, {WORDS} AS w FROM documents)"


def _docs(spark, sf):
    d = read(spark, sf, "documents")
    one = lambda c: F.array(F.col(c))
    return search.index(d, {"text": (one("text"), "standard"), "lang": (one("lang"), "keyword"), "source": (one("source"), "separated")})


@query(f"WITH {DOC} SELECT doc_id FROM d WHERE list_has_any(w, ['idiot', 'clown'])")
def search_match(spark, sf):
    return _docs(spark, sf).filter(search.match("text", "Idiot clown")).select("doc_id")


@query(f"WITH {DOC} SELECT doc_id FROM d WHERE list_contains(w, 'pathetic')")
def search_term(spark, sf):
    return _docs(spark, sf).filter(search.term("text", "pathetic")).select("doc_id")


@query(f"WITH {DOC} SELECT doc_id FROM d WHERE list_contains(w, 'the') AND lang = 'en' AND NOT list_contains(w, 'of')")
def search_bool(spark, sf):
    return _docs(spark, sf).filter(search.every(search.term("text", "the"), search.term("lang", "en"), ~search.term("text", "of"))).select("doc_id")


@query(f"WITH {DOC} SELECT doc_id FROM d WHERE lang = 'de' AND list_contains(w, 'und') AND NOT source = 'src3'")
def search_querystring(spark, sf):
    return _docs(spark, sf).filter(search.parse("+lang:de +und -source:src3", "text")).select("doc_id")


@query(f"WITH {DOC} SELECT doc_id FROM d WHERE lang = 'fr' ORDER BY doc_id LIMIT 5 OFFSET 10")
def search_page(spark, sf):
    return search.search(_docs(spark, sf), search.term("lang", "fr"), size=5, start=10, key="doc_id").select("doc_id")


@query(f"WITH {DOC} SELECT doc_id FROM d WHERE lang = 'es' ORDER BY source DESC, doc_id LIMIT 7")
def search_sort(spark, sf):
    return search.search(_docs(spark, sf), search.term("lang", "es"), size=7, sort=["-source"], key="doc_id").select("doc_id")


@query(f"WITH {DOC} SELECT doc_id FROM d WHERE len(list_filter(w, lambda x: regexp_full_match(x, 'th[aeiou]*t'))) > 0")
def search_regexp(spark, sf):
    return _docs(spark, sf).filter(search.regexp("text", "th[aeiou]*t")).select("doc_id")


@query("SELECT unnest(['text', 'lang', 'source']) AS field")
def search_fields(spark, sf):
    return search.field_names(_docs(spark, sf))


@query("SELECT 'urn:x-table:nation' AS graph_iri, '-' AS main_type, count(*) AS node_count, list_sort(list(n_name)) AS literal FROM nation")
def derive_documents(spark, sf):
    return search.derive(table_quads(spark, sf, "nation"), table_imports(spark), [["Part"], ["Organization"]]).select("graph_iri", "main_type", "node_count", "literal")


# ---- streaming, stores and formats

@query("SELECT user_id, max_by(event_type, struct_pack(a := ts, b := event_id)) AS last_type, max(ts)::TIMESTAMP AS ts FROM events GROUP BY user_id")
def stream_index_update(spark, sf):
    """The newest event of each user, kept by a stream over the table's files."""
    import uuid

    from quadlake._io import shared_dir
    from quadlake.streaming import changes

    at = f"{shared_dir(spark)}/quadlake/stream-{uuid.uuid4().hex}"
    read(spark, sf, "events").write.parquet(f"{at}/feed")
    derive = lambda b: b.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.max("ts").alias("ts"))
    changes.update_index(changes.stream(spark, f"{at}/feed"), f"{at}/index", f"{at}/checkpoint", derive, key=["user_id"], version="ts").awaitTermination()
    return changes.current(spark, f"{at}/index", ["user_id"], "ts").select("user_id", "last_type", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("SELECT count(*) AS statements, 0::BIGINT AS differences FROM (SELECT unnest(['a', 'b']) FROM nation)")
def turtle_roundtrip(spark, sf):
    """A graph written as Turtle and read back."""
    import uuid

    from quadlake._io import shared_dir
    from quadlake.sources import turtle

    at = f"{shared_dir(spark)}/quadlake/turtle-{uuid.uuid4().hex}"
    q = table_quads(spark, sf, "nation")
    turtle.write_turtle(q, at)
    text = spark.read.text(at, wholetext=True).select("value")
    back = turtle.quads(turtle.read_text(spark, text, f"{T}nation"))
    return back.agg(F.count(F.lit(1)).alias("statements")).crossJoin(sets.difference(q, back).agg(F.count(F.lit(1)).alias("differences")))  # one row each


@query("SELECT 2::BIGINT AS graphs, (SELECT count(*) * 2 FROM nation) + (SELECT count(*) FROM region) AS statements, 0::BIGINT AS differences")
def trig_roundtrip(spark, sf):
    from quadlake.sources import turtle

    q = tables_quads(spark, sf, ["nation", "region"])
    back = turtle.quads(turtle.read_text(spark, turtle.trig_text(q).select(F.col("text").alias("value")), "urn:default", trig=True))
    return back.agg(F.countDistinct("graph_iri").alias("graphs"), F.count(F.lit(1)).alias("statements")).crossJoin(sets.difference(q, back).agg(F.count(F.lit(1)).alias("differences")))  # one row each


@query("SELECT 3::BIGINT AS commits, (SELECT count(*) FROM nation) AS first, (SELECT count(*) FROM nation WHERE n_nationkey > 4) AS tip, (SELECT count(*) FROM nation WHERE n_nationkey <= 4) AS removed")
def commit_checkout(spark, sf):
    """Two commits of a graph on a branch and one of another, checked out again."""
    import uuid

    from quadlake._io import shared_dir
    from quadlake.plans.store import Repository

    repo = Repository.create(spark, f"{shared_dir(spark)}/quadlake/repo-{uuid.uuid4().hex}")
    q = table_quads(spark, sf, "nation", ["n_name"])
    ds = spark.range(1).select(iri.graph_id(F.lit(f"{T}nation"))).first()[0]
    one = repo.commit(q, [f"{T}nation"], message="all", author="a", ts="2024-01-01 00:00:00")
    some = q.filter(F.regexp_extract("s_id", "#([0-9]+)$", 1).cast("int") > 4)
    two = repo.commit(some, [f"{T}nation"], message="some", author="a", checked_out=[one], ts="2024-01-02 00:00:00")
    repo.commit(table_quads(spark, sf, "region"), [f"{T}region"], message="more", author="b", ts="2024-01-03 00:00:00")
    count = lambda d, n: d.agg(F.count(F.lit(1)).alias(n))
    removed = repo.commit_difference(two).filter("flag = -1")
    return count(repo.table("commits"), "commits").crossJoin(count(repo.checkout_commit(one, ds), "first")).crossJoin(count(repo.checkout_branch(ds), "tip")).crossJoin(count(removed, "removed"))  # one row each


# ---- further operators

@query("SELECT 'urn:x-table:nation' AS graph_iri, '<urn:x-table:nation#' || n_nationkey || '>' AS s, '<urn:x-table:nation/n_regionkey>' AS p, '<urn:x-table:region#' || n_regionkey || '>' AS o FROM nation UNION ALL SELECT 'urn:x-table:nation', '<urn:x-table:nation#' || n_nationkey || '>', '<urn:x-table:nation/n_name>', '\"' || n_name || '\"^^<http://www.w3.org/2001/XMLSchema#string>' FROM nation")
def dump_triples(spark, sf):
    return patterns.dump(table_quads(spark, sf, "nation"))


@query("SELECT 'r:' || r_regionkey AS token FROM region WHERE false UNION ALL SELECT '<urn:x-table:region#' || r_regionkey || '>' FROM region UNION ALL SELECT 'c:' || upper(r_name[1]) FROM region")
def prefixed_fragment(spark, sf):
    """A local name that starts with a digit keeps its brackets."""
    r = read(spark, sf, "region")
    number = r.select(iri.prefixed(F.concat(F.lit(f"{T}region#"), F.col("r_regionkey").cast("string")), {"r": f"{T}region#"}).alias("token"))
    return number.union(r.select(iri.prefixed(F.concat(F.lit("http://c#"), F.upper(F.substring("r_name", 1, 1))), {"c": "http://c#"})))


@query("SELECT c_custkey AS key, '\"' || replace(c_name || chr(10) || '\"', '\"', '\\\"') || '\"' AS quoted FROM customer WHERE false UNION ALL SELECT c_custkey, replace(c_name || '\\n\\\"', '#', '#') FROM customer")
def escape_literal(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("key"), iri.escape_literal(F.concat("c_name", F.lit('\n"'))).alias("quoted"))


@query("SELECT page_id, url AS decoded FROM pages")
def file_name_roundtrip(spark, sf):
    """base64url file names of IRIs, decoded again."""
    return read(spark, sf, "pages").select("page_id", iri.from_file_name(iri.file_name(F.col("url"))).alias("decoded"))


@query("SELECT c_custkey AS key, [c_custkey::DOUBLE, c_nationkey::DOUBLE] AS numbers, NULL::DOUBLE[] AS too_many FROM customer")
def parse_floats(spark, sf):
    c, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("key"), iri.floats(F.concat_ws(" ", c, n)).alias("numbers"), iri.floats(F.concat_ws(" ", c, n, c, n)).alias("too_many"))


@query("SELECT s_suppkey AS key, s_nationkey * 2.0::DOUBLE AS a, s_suppkey * 2.0::DOUBLE + 5.0::DOUBLE AS e FROM supplier")
def matrix_multiply(spark, sf):
    zero, one = F.lit(0.0), F.lit(1.0)
    m = iri.affine([F.lit(2.0), zero, zero, F.lit(2.0), F.lit(5.0), zero], [F.col("s_nationkey").cast("double"), zero, zero, one, F.col("s_suppkey").cast("double"), zero])
    return read(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), m[0].alias("a"), m[4].alias("e"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS text, strftime(date_trunc('second', ts) - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS shifted FROM events")
def commit_time(spark, sf):
    """Commit times as text, and read back with a zone two hours ahead."""
    t = iri.rfc3339(F.col("ts").cast("timestamp"))
    return read(spark, sf, "events").select("event_id", t.alias("text"), iri.rfc3339(iri.parse_time(F.replace(t, F.lit("Z"), F.lit("+02:00")))).alias("shifted"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def language_tags(spark, sf):
    d = read(spark, sf, "documents")
    return d.filter(iri.language_tag_ok(F.col("lang")) & ~iri.language_tag_ok(F.concat("lang", F.lit("-a-b")))).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id FROM pages WHERE url LIKE 'http%:%'")
def iri_validation(spark, sf):
    return read(spark, sf, "pages").filter(iri.iri_ok(F.col("url")) & ~iri.iri_ok(F.concat("url", F.lit(" <x>")))).select("page_id")


@query("SELECT 'urn:x-table:orders#' || o_orderkey AS s_id FROM orders WHERE o_custkey <> 11")
def delete_node(spark, sf):
    return mutation.delete_node(table_quads(spark, sf, "orders", ["o_custkey"]), f"{T}customer#11").select("s_id")


@query("SELECT 'urn:x-table:orders#' || o_orderkey AS s_id FROM orders WHERE o_orderstatus <> 'F'")
def for_delete(spark, sf):
    return mutation.delete_where(table_quads(spark, sf, "orders", ["o_orderstatus"]), F.col("o_lex") == "F").select("s_id")


@query("""SELECT CASE WHEN n_regionkey = 1 THEN 'urn:moved' ELSE 'urn:x-table:nation' END || '#' || n_nationkey AS s_id, CASE WHEN n_regionkey = 1 THEN 'urn:moved' ELSE 'urn:x-table:nation' END AS graph_iri FROM nation""")
def move_nodes(spark, sf):
    q = table_quads(spark, sf, "nation", ["n_regionkey"])
    target = q.filter(F.col("o_id") == f"{T}region#1").select(F.col("s_id").alias("node"), F.lit("urn:moved").alias("to_graph"))
    return mutation.move_nodes(q, target).select("s_id", "graph_iri")


@query("SELECT 'urn:x-table:nation#' || n_nationkey AS s_id, 'urn:x-table:' || CASE WHEN n_regionkey = 1 THEN 'america' ELSE 'region#' || n_regionkey END AS o_id FROM nation")
def rename_node(spark, sf):
    return mutation.rename_node(table_quads(spark, sf, "nation", ["n_regionkey"]), f"{T}region#1", f"{T}america").select("s_id", "o_id")


@query("SELECT count(*) AS added FROM (SELECT o_orderkey FROM orders UNION SELECT o_orderkey + 10000000 FROM orders WHERE o_orderkey % 100 = 1)")
def add_statements(spark, sf):
    """Statements that exist already do not count again."""
    old, new = _versions(spark, sf)
    return mutation.add(old, old.unionByName(new.filter(F.regexp_extract("s_id", "#([0-9]+)$", 1).cast("long") > 10000000))).agg(F.count(F.lit(1)).alias("added"))


@query("SELECT 'urn:group:' || md5('r' || n_regionkey) AS graph_iri, count(*) AS statements FROM nation GROUP BY n_regionkey")
def graph_split(spark, sf):
    """Nations split into a graph for each region."""
    q = mutation.statements(_places(spark, sf).filter("a LIKE 'n%'").select(F.col("a").alias("s"), F.lit("in").alias("p"), F.col("b").alias("o")), "g")
    groups = q.select(F.col("s_id").alias("node"), F.col("o_id").alias("root"))
    return mutation.split_by_group(q, groups)[0].groupBy("graph_iri").agg(F.count(F.lit(1)).alias("statements"))


@query("SELECT * FROM (VALUES ('r1', 'x'), ('r2', 'a')) t(root, node)")
def boundary_nodes(spark, sf):
    edges = spark.createDataFrame([("r1", "a"), ("a", "x"), ("r2", "a"), ("r2", "c")], "a string, b string")
    groups = spark.createDataFrame([("r1", "r1"), ("a", "r1"), ("r2", "r2"), ("c", "r2")], "node string, root string")
    return graphs.boundary(edges, groups)


@query("SELECT * FROM (VALUES ('p', 'q'), ('pi', 'qi')) t(a, b)")
def inverse_property_sync(spark, sf):
    inv, below = spark.createDataFrame([("p", "pi"), ("q", "qi")], "a string, b string"), spark.createDataFrame([("p", "q")], "a string, b string")
    return graphs.inverse_properties(inv, below)[1]


@query(f"WITH RECURSIVE {PLACES}, r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS cls, list_sort(list(b)) AS supersedes FROM (SELECT a, b FROM r WHERE a NOT LIKE 'c%' UNION SELECT a, a FROM e WHERE a NOT LIKE 'c%' UNION SELECT b, b FROM e) GROUP BY a")
def main_class_supersedure(spark, sf):
    e = _places(spark, sf).filter("a NOT LIKE 'c%'").union(_places(spark, sf).filter("a LIKE 'c%'").select("b", "b").distinct()).filter("a <> b")
    main = e.select(F.col("a").alias("cls")).union(e.select("b")).distinct()
    return vocabulary.supersedes(main, graphs.closure(e))


@query(f"WITH RECURSIVE {PLACES}, r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS node, b AS root FROM r WHERE b LIKE 'r%'")
def top_property(spark, sf):
    return graphs.roots(_places(spark, sf))


@query("SELECT ds_id, kind, name, \"commit\" FROM (VALUES ('d', 'branch', 'master', 'c1'), ('d', 'leaf', 'c2', 'c2'), ('d', 'branch', 'dev', 'c3')) t(ds_id, kind, name, \"commit\")")
def sync_refs(spark, sf):
    refs = "ds_id string, kind string, name string, commit string"
    return sets.sync_refs(spark.createDataFrame([("d", "branch", "master", "c1")], refs), spark.createDataFrame([("d", "branch", "master", "c2"), ("d", "branch", "dev", "c3")], refs))


@query("SELECT 'urn:x-table:' || t AS graph_iri, c AS commits, c IS NULL AS deleted FROM (VALUES ('orders', ['c1', 'c2']), ('customer', NULL)) v(t, c)")
def align_history(spark, sf):
    to = spark.createDataFrame([(f"{T}orders",), (f"{T}customer",)], "graph_iri string")
    return sets.align_history(to, spark.createDataFrame([(f"{T}orders", ["c1", "c2"])], "graph_iri string, commits array<string>"))


@query("SELECT 'urn:x-table:orders' AS graph_iri, 1::BIGINT AS hashes FROM (SELECT 1)")
def current_revision_hash(spark, sf):
    """The hash of a graph does not depend on order or repetition."""
    q = table_quads(spark, sf, "orders", ["o_orderstatus"])
    both = stats.graph_hash(q).union(stats.graph_hash(q.union(q).repartition(5, "o_lex")))
    return both.groupBy("graph_iri").agg(F.countDistinct("ng_rev").alias("hashes"))


@query("SELECT start::TIMESTAMP AS start, event_type, n FROM (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL)")
def windowed_event_counts(spark, sf):
    """Daily windows over the events, as a batch; the same function takes a stream."""
    from quadlake.streaming import changes

    e = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return changes.windowed_counts(e, "ts", "event_type").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(f"WITH {DOC} SELECT doc_id FROM d WHERE len(list_filter(w, lambda x: starts_with(x, 'idio'))) > 0 OR list_contains(w, 'clown')")
def search_prefix(spark, sf):
    return _docs(spark, sf).filter(search.parse("idio* clown", "text")).select("doc_id")


@query(f"WITH {DOC} SELECT doc_id, list_contains(w, 'scum')::INT + list_contains(w, 'clown')::INT AS hits FROM d WHERE list_has_any(w, ['scum', 'clown'])")
def search_score(spark, sf):
    """Documents with a score above 0 and how many of the words they have; scores themselves are our own."""
    hit = lambda w: search.term("text", w).cast("int")
    return search.score("text", ["scum", "clown"], _docs(spark, sf)).filter("score > 0").select("doc_id", (hit("scum") + hit("clown")).alias("hits"))
