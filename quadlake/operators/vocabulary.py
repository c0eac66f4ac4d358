"""Ontology elements and the types of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlake.model import OWL, RDF_TYPE, RDFS
from quadlake.operators.closure import closure, nearest

VOCAB = "iri string, is_class boolean, is_property boolean, is_datatype_property boolean, is_object_property boolean, is_functional boolean, is_inverse_functional boolean, is_main_class boolean, domain string, range string, super_property string, inverse_of string, supers array<string>"
MAIN_CLASS = "http://ontology.example/meta#MainClass"
#: Types that make a node a property.
PROPERTY_TYPES = [f"{OWL}DatatypeProperty", f"{OWL}ObjectProperty", f"{OWL}FunctionalProperty", f"{OWL}InverseFunctionalProperty", "http://www.w3.org/1999/02/22-rdf-syntax-ns#Property"]


def from_graph(q: DataFrame, main_class: str = MAIN_CLASS) -> DataFrame:
    """Elements that graph statements declare, one row each. Of several domains, ranges or inverses the smallest is named here;
    the validator looks at all of them."""
    typed = lambda *iris: F.coalesce(F.max((F.col("p") == RDF_TYPE) & F.col("o_id").isin(*iris)), F.lit(False))
    value = lambda p: F.min(F.when(F.col("p") == p, F.col("o_id")))
    rows = q.filter(F.col("o_id").isNotNull()).groupBy(F.col("s_id").alias("iri")).agg(
        typed(f"{OWL}Class", f"{RDFS}Class", main_class).alias("is_class"),
        typed(*PROPERTY_TYPES).alias("is_property"),
        typed(f"{OWL}DatatypeProperty").alias("is_datatype_property"),
        typed(f"{OWL}ObjectProperty").alias("is_object_property"),
        typed(f"{OWL}FunctionalProperty").alias("is_functional"),
        typed(f"{OWL}InverseFunctionalProperty").alias("is_inverse_functional"),
        typed(main_class).alias("is_main_class"),
        value(f"{RDFS}domain").alias("domain"),
        value(f"{RDFS}range").alias("range"),
        value(f"{RDFS}subPropertyOf").alias("super_property"),
        value(f"{OWL}inverseOf").alias("inverse_of"),
        F.sort_array(F.collect_set(F.when(F.col("p") == f"{RDFS}subClassOf", F.col("o_id")))).alias("supers"),
    )
    return rows.filter(F.col("is_class") | F.col("is_property") | (F.size("supers") > 0))


def class_edges(q: DataFrame) -> DataFrame:
    """a (narrower), b (wider): subClassOf, both directions of equivalentClass, and members of unions and intersections, which are
    given as lists or as repeated statements."""
    sub = q.filter(F.col("p").isin(f"{RDFS}subClassOf", f"{OWL}onDatatype")).select(F.col("s_id").alias("a"), F.col("o_id").alias("b"))
    same = q.filter(F.col("p") == f"{OWL}equivalentClass").select(F.col("s_id").alias("a"), F.col("o_id").alias("b"))
    listed = q.filter(F.col("p").isin(*[f"{OWL}{n}" for n in ("unionOf", "disjointUnionOf", "intersectionOf")]) & F.col("o_items").isNotNull()).select("s_id", "p", F.explode("o_items.id").alias("m"))
    up = listed.filter(F.col("p") != f"{OWL}intersectionOf").select(F.col("m").alias("a"), F.col("s_id").alias("b"))
    down = listed.filter(F.col("p") == f"{OWL}intersectionOf").select(F.col("s_id").alias("a"), F.col("m").alias("b"))
    return sub.union(same).union(same.select("b", "a")).union(up).union(down).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()


def property_edges(q: DataFrame) -> DataFrame:
    return q.filter((F.col("p") == f"{RDFS}subPropertyOf") & F.col("o_id").isNotNull()).select(F.col("s_id").alias("a"), F.col("o_id").alias("b")).distinct()


def with_self(edges: DataFrame, elements: DataFrame) -> DataFrame:
    """Closure with every element above itself. elements: iri."""
    return closure(edges).select("a", "b").union(elements.select(F.col("iri").alias("a"), F.col("iri").alias("b"))).distinct()


def types(q: DataFrame) -> DataFrame:
    return q.filter(F.col("p") == RDF_TYPE).select("graph_iri", F.col("s_id").alias("node"), F.col("o_id").alias("cls"))


def type_of(typed: DataFrame, main: DataFrame, up: DataFrame) -> DataFrame:
    """node, cls: its main class that is below no other main class of the node; the smallest of several. typed: node, cls; main: cls;
    up: closure a, b."""
    mains = typed.join(main, "cls", "left_semi").select("node", "cls").distinct()
    lower = mains.select("node", F.col("cls").alias("a")).join(up.select("a", "b"), "a").filter("a <> b").select("node", F.col("b").alias("cls"))
    return mains.join(lower, ["node", "cls"], "left_anti").groupBy("node").agg(F.min("cls").alias("cls"))


def supersedes(main: DataFrame, up: DataFrame) -> DataFrame:
    """cls, supersedes: the class itself and every main class above it."""
    above = main.select(F.col("cls").alias("a")).join(up.select("a", "b"), "a").join(main.select(F.col("cls").alias("b")), "b", "left_semi").select(F.col("a").alias("cls"), F.col("b").alias("s"))
    return above.union(main.select("cls", F.col("cls").alias("s"))).groupBy("cls").agg(F.sort_array(F.collect_set("s")).alias("supersedes"))


def domain_range(q: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nearest domain and range up the property chain: node, domain and node, range."""
    up = property_edges(q)
    found = []
    for name in ("domain", "range"):
        values = q.filter(F.col("p") == f"{RDFS}{name}").groupBy(F.col("s_id").alias("node")).agg(F.min("o_id").alias(name))
        found.append(nearest(up, values, name))
    return found[0], found[1]
