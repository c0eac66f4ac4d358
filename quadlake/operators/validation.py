"""Checks of graphs against an ontology. Each check returns findings: graph_iri, rule, node, p, value, count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlake.functions.literals import XSD
from quadlake.model import OWL, RDF_FIRST, RDF_TYPE, RDFS
from quadlake.operators.closure import closure
from quadlake.operators.vocabulary import MAIN_CLASS, PROPERTY_TYPES, class_edges, from_graph, property_edges, types


def _findings(df: DataFrame, rule: str, *, p: str = "p", value: str | None = None, count: str | None = None) -> DataFrame:
    text = F.lit(None).cast("string")
    return df.select(
        "graph_iri", F.lit(rule).alias("rule"), "node", (F.col(p) if p in df.columns else text).alias("p"),
        (F.col(value).cast("string") if value else text).alias("value"), (F.col(count).cast("long") if count else F.lit(1).cast("long")).alias("count"),
    )


def _up(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Reflexive closure a, b over the nodes (column a) and the edges."""
    return closure(edges).select("a", "b").union(nodes.select("a", F.col("a").alias("b"))).distinct()


def functional(q: DataFrame, ontology: DataFrame) -> DataFrame:
    """One finding for each (node, property) used more than once, and for each (property, object) of an inverse-functional one. Uses of
    sub-properties count for the property."""
    vocab = from_graph(ontology)
    up = _up(property_edges(ontology), q.select(F.col("p").alias("a")).distinct()).select(F.col("a").alias("p"), F.col("b").alias("prop"))
    used = q.join(up, "p").select("graph_iri", "s_id", "prop", F.coalesce("o_id", F.concat_ws("^^", "o_lex", "o_dt", "o_lang")).alias("o"))
    once = used.join(vocab.filter("is_functional").select(F.col("iri").alias("prop")), "prop", "left_semi").groupBy("graph_iri", "s_id", "prop").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumnRenamed("s_id", "node")
    one = used.join(vocab.filter("is_inverse_functional").select(F.col("iri").alias("prop")), "prop", "left_semi").groupBy("graph_iri", "prop", "o").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumnRenamed("o", "node")
    return _findings(once, "functional_property", p="prop", count="n").union(_findings(one, "inverse_functional_property", p="prop", count="n"))


def rdf_type(q: DataFrame, ontology: DataFrame, main_class: str = MAIN_CLASS) -> DataFrame:
    """RdfType_missing for nodes without a type, RdfType_wrong for those with neither a class below an instance of `main_class` nor a
    property type. The graph
    node itself, lists and classes are left out."""
    nodes = q.filter((F.col("s_kind") != "collection") & (F.col("s_id") != F.col("graph_iri"))).select("graph_iri", F.col("s_id").alias("node")).distinct()
    typed = types(q)
    missing = nodes.join(typed.select("graph_iri", "node"), ["graph_iri", "node"], "left_anti")
    low = _up(class_edges(ontology), typed.select(F.col("cls").alias("a")).distinct())
    main = low.join(ontology.filter((F.col("p") == RDF_TYPE) & (F.col("o_id") == main_class)).select(F.col("s_id").alias("b")), "b", "left_semi").select(F.col("a").alias("cls"))
    fine = typed.join(main, "cls", "left_semi").select("graph_iri", "node")
    exempt = typed.filter(F.col("cls").isin(f"{OWL}Class", *PROPERTY_TYPES)).select("graph_iri", "node")
    wrong = nodes.join(typed.select("graph_iri", "node"), ["graph_iri", "node"], "left_semi").join(fine.union(exempt), ["graph_iri", "node"], "left_anti")
    return _findings(missing, "RdfType_missing").union(_findings(wrong, "RdfType_wrong"))


def domain_and_range(q: DataFrame, ontology: DataFrame) -> DataFrame:
    """predicate_not_property, domain_mismatch and range_mismatch. Any declared domain or range, on the property or the nearest above
    it, satisfies; every predicate and every list member is checked."""
    triples = q.filter(~F.col("p").isin(RDF_TYPE, RDF_FIRST)).select("graph_iri", F.col("s_id").alias("node"), "p", "o_kind", "o_id", "o_lex", "o_dt", "o_lang", "o_items")
    declared = from_graph(ontology).filter("is_property").select(F.col("iri").alias("b"))
    chain = closure(property_edges(ontology)).union(triples.select(F.col("p").alias("a"), F.col("p").alias("b"), F.lit(0)).distinct())
    real = chain.join(declared, "b", "left_semi").select(F.col("a").alias("p")).distinct()
    unknown = triples.join(real, "p", "left_anti")
    out = _findings(unknown.groupBy("graph_iri", "node", "p").agg(F.count(F.lit(1)).alias("n")), "predicate_not_property", count="n")
    typed = types(q)
    low = _up(class_edges(ontology), typed.select(F.col("cls").alias("a")).distinct())
    has = typed.join(low.select(F.col("a").alias("cls"), F.col("b").alias("want")), "cls").select("graph_iri", "node", "want").distinct()

    def wanted(name: str) -> DataFrame:
        """p, want: all classes declared at the fewest steps up."""
        values = ontology.filter(F.col("p") == f"{RDFS}{name}").select(F.col("s_id").alias("b"), F.col("o_id").alias("want"))
        found = chain.join(values, "b").groupBy(F.col("a").alias("p"), "depth").agg(F.collect_set("want").alias("want"))
        return found.groupBy("p").agg(F.min_by("want", "depth").alias("wants")).select("p", F.explode("wants").alias("want"))

    def mismatched(rows: DataFrame, at: str, want: DataFrame, rule: str) -> DataFrame:
        asked = rows.join(want.select("p").distinct(), "p", "left_semi")
        ok = rows.join(want, "p").join(has.select("graph_iri", F.col("node").alias(at), "want"), ["graph_iri", at, "want"], "left_semi").select("graph_iri", at, "p").distinct()
        bad = asked.join(ok, ["graph_iri", at, "p"], "left_anti")
        return bad.withColumn("v", F.col(at)).transform(lambda d: _findings(d.select("graph_iri", "node", "p", "v").distinct(), rule, value="v"))

    out = out.union(mismatched(triples.select("graph_iri", "node", "p").distinct(), "node", wanted("domain"), "domain_mismatch"))
    ranges = wanted("range")
    local = q.select("graph_iri", F.col("s_id").alias("target")).distinct()
    members = triples.filter("o_items IS NOT NULL").select("graph_iri", "node", "p", F.explode("o_items").alias("m"))
    objects = triples.filter("o_kind IN ('iri', 'blank')").select("graph_iri", "node", "p", F.col("o_id").alias("target"))
    objects = objects.join(local, ["graph_iri", "target"], "left_semi")  # nodes of other graphs are not known here
    out = out.union(mismatched(objects, "target", ranges, "range_mismatch"))
    literals = triples.filter("o_kind = 'literal'").select("graph_iri", "node", "p", F.col("o_lex").alias("lex"), F.col("o_dt").alias("dt"), F.col("o_lang").alias("lang"))
    literals = literals.union(members.filter("m.kind = 'literal'").select("graph_iri", "node", "p", "m.lex", "m.dt", "m.lang")).fillna("", ["dt", "lang"]).distinct()
    term = ["graph_iri", "node", "p", "lex", "dt", "lang"]
    data = ranges.filter(F.col("want").startswith(XSD) | (F.col("want") == f"{RDFS}Literal"))
    fits = literals.join(data, "p").filter((F.col("want") == F.col("dt")) | (F.col("want") == f"{RDFS}Literal")).select(*term)
    bad = literals.join(ranges.select("p").distinct(), "p", "left_semi").join(fits, term, "left_anti")
    return out.union(_findings(bad.select("graph_iri", "node", "p", "lex").distinct(), "range_mismatch", value="lex"))


def uniqueness(docs: DataFrame, by: list[str]) -> DataFrame:
    """Keys (main type, id and owner, say) that several graphs share: the key and the number of graphs."""
    return docs.groupBy(*by).agg(F.count(F.lit(1)).alias("graphs")).filter("graphs > 1")


CHECKS = {"RdfType": rdf_type, "DomainAndRange": domain_and_range, "FunctionalProperty": functional}


def validate(q: DataFrame, ontology: DataFrame | None = None, checks: list[str] | None = None, *, main_class: str = MAIN_CLASS) -> DataFrame:
    """All findings of the chosen checks; `main_class` is the type of the classes that nodes may have. The ontology counts beside the graphs
    but is not reported on."""
    whole = q if ontology is None else q.unionByName(ontology)
    out = None
    for name in checks or list(CHECKS):
        found = CHECKS[name](q, whole, main_class) if name == "RdfType" else CHECKS[name](q, whole)
        out = found if out is None else out.unionByName(found)
    return out


def report(findings: DataFrame) -> DataFrame:
    """graph_iri, report: a JSON document with the findings of each rule."""
    one = F.struct("node", "p", "value", "count")
    rules = findings.groupBy("graph_iri", "rule").agg(F.sort_array(F.collect_list(one)).alias("findings"))
    return rules.groupBy("graph_iri").agg(F.to_json(F.sort_array(F.collect_list(F.struct("rule", "findings")))).alias("report"))
