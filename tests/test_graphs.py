import pytest
from pyspark.sql import functions as F

from quadlake import model
from quadlake.functions.literals import XSD
from quadlake.model import OWL, RDF_TYPE, RDFS
from quadlake.operators import closure, mutation, patterns, search, sets, stats, validation, vocabulary

EDGES = "a string, b string"


def pairs(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def graph(spark, rows, iri="g"):
    return mutation.statements(spark.createDataFrame([(*r, None)[:4] if len(r) == 3 else r for r in rows], "s string, p string, o string, dt string"), iri)


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "b")], EDGES)
    assert pairs(closure.closure(e), "a", "b") == {("a", x) for x in "bcd"} | {(x, y) for x in "bcd" for y in "bcd"}
    assert closure.has_cycle(e) and not closure.has_cycle(e.filter("a <> 'd'"))
    assert pairs(closure.reach(e, spark.createDataFrame([("a",)], "node string")), "node", "depth") == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_components_and_roots(spark):
    e = spark.createDataFrame([(str(i), str(i + 1)) for i in range(10, 40)] + [("x", "y")], EDGES)
    assert pairs(closure.components(e), "component") == {("10",), ("x",)}
    assert pairs(closure.roots(e).filter("node = '10'"), "root") == {("40",)}


def test_part_groups_first_wins(spark):
    parts = spark.createDataFrame([("r1", "a"), ("r2", "a"), ("a", "b"), ("b", "a"), ("r2", "c")], EDGES)
    groups = closure.part_groups(parts, spark.createDataFrame([("r1", 2), ("r2", 1)], "node string, priority int"))
    assert pairs(groups, "node", "root") == {("r1", "r1"), ("r2", "r2"), ("a", "r2"), ("b", "r2"), ("c", "r2")}
    assert pairs(closure.boundary(parts, groups), "root", "node") == {("r1", "a")}


def test_inverse_properties(spark):
    inv, below = closure.inverse_properties(spark.createDataFrame([("p", "pi"), ("q", "qi")], EDGES), spark.createDataFrame([("p", "q")], EDGES))
    assert pairs(inv, "a", "b") == {("p", "pi"), ("pi", "p"), ("q", "qi"), ("qi", "q")}
    assert pairs(below, "a", "b") == {("p", "q"), ("pi", "qi")}


def test_patterns(spark):
    q = graph(spark, [("g#a", RDF_TYPE, "g#C"), ("g#a", "g#p", "h#b"), ("g#a", "g#a", "g#a"), ("_:b1", "g#p", "x", f"{XSD}string")])
    assert patterns.touching(q, "g#a").count() == 3
    assert pairs(patterns.undefined_nodes(q), "node") == {("g#C",), ("h#b",)}
    assert pairs(patterns.referenced_graphs(q), "graph_iri") == {("h",)}
    assert pairs(patterns.blank_nodes(q), "node") == {("b1",)}
    assert patterns.has_triple(q, "g#a", "g#p", "h#b") and not patterns.has_triple(q, "h#b", "g#p", "g#a")
    assert [r["p"] for r in patterns.triple_index(patterns.match(q, "g#a")).orderBy("triple_index").collect()] == [RDF_TYPE, "g#a", "g#p"]
    assert patterns.dump(q, {"g": "g#"}).filter("o = 'g:C'").count() == 1
    assert pairs(stats.canonical_nodes(q), "node", "node_index") == {("g#C", 0), ("g#a", 1), ("h#b", 2), ("b1", 3)}


def test_canonical_nodes_are_sorted_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(stats, "SORTED", 100, raising=False)
    uuid = "00000000-0000-4000-8000-00000000000"
    rows = [(f"{g}#n{i}", "p", "_:b") for g in "gh" for i in range(300)] + [(f"g#{uuid}{i}", "p", "_:b") for i in range(3)]
    q = graph(spark, [r for r in rows if r[0][0] == "g"]).union(graph(spark, [r for r in rows if r[0][0] == "h"], "h"))
    found = stats.canonical_nodes(q)
    for g in "gh":
        named = sorted(f"{g}#n{i}" for i in range(300)) + [f"g#{uuid}{i}" for i in range(3) if g == "g"] + ["b"]
        assert [r["node"] for r in found.filter(F.col("graph_iri") == g).orderBy("node_index").collect()] == named
        assert pairs(found.filter(F.col("graph_iri") == g), "node_index") == {(i,) for i in range(len(named))}
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_graph_hash_depends_on_the_set_only(spark):
    q = graph(spark, [("g#a", "g#p", "1", f"{XSD}integer"), ("g#b", "g#p", "g#a")])
    h = lambda d: stats.graph_hash(d).first()["ng_rev"]
    assert h(q) == h(q.union(q).orderBy(F.desc("s_id"))) != h(q.filter("s_id = 'g#a'"))


def test_diff_patch_merge(spark):
    old = graph(spark, [("g#a", "g#p", "1", f"{XSD}integer"), ("g#a", "g#p", "1", f"{XSD}string"), ("g#b", "g#p", "g#a")])
    new = graph(spark, [("g#a", "g#p", "1", f"{XSD}string"), ("g#b", "g#p", "g#c"), ("g#n", "g#p", "g#c")])
    d = sets.difference(old, new)
    assert sorted(r["flag"] for r in d.collect()) == [-1, -1, 1, 1]
    assert sets.equal(sets.patch(old, d), new) and not sets.equal(old, new)
    assert pairs(sets.node_difference(old, new), "node", "state") == {("g#a", "modified"), ("g#b", "modified"), ("g#n", "added")}
    assert sets.merge(old, new).count() == 5
    assert pairs(d.select(sets.symbol(F.col("flag")).alias("s")), "s") == {("-",), ("+",)}


def test_sets_take_one_shuffle_and_no_joins(spark):
    old = graph(spark, [("g#a", "g#p", str(i), f"{XSD}integer") for i in range(20)])
    new = graph(spark, [("g#a", "g#p", str(i), f"{XSD}integer") for i in range(5, 30)])
    twice = new.union(new)
    d = sets.difference(old.union(old), twice)
    assert pairs(d, "o_lex", "flag") == {(str(i), -1) for i in range(5)} | {(str(i), 1) for i in range(20, 30)} and d.count() == 15
    patched = sets.patch(old.union(old), d.union(d))
    assert sorted(r["o_num"] for r in patched.collect()) == list(range(5, 30))
    plan = patched._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Join" not in plan


def test_partitions_grow_with_the_input(spark, monkeypatch, tmp_path):
    graph(spark, [("g#a", "g#p", str(i), f"{XSD}integer") for i in range(2000)]).write.parquet(f"{tmp_path}/q")
    q = spark.read.parquet(f"{tmp_path}/q")
    monkeypatch.setattr("quadlake._io.PART", 500)
    for found in (model.as_set(q), sets.difference(q, q, include_equal=True), sets.patch(q, q.limit(0).withColumn("flag", F.lit(1)))):
        assert found.rdd.getNumPartitions() > 20 and found.count() == 2000


def test_graph_hash_combines_after_the_shuffle(spark):
    q = graph(spark, [("g#a", "g#p", "1", f"{XSD}integer"), ("g#b", "g#p", "g#a")])
    assert stats.graph_hash(q).first()["ng_rev"] == "2bf8413733cb3eb532e7922ce82ca66cbdd0e3272b4ecf8fa8f3409537669499"
    plan = stats.graph_hash(q.union(q).repartition(5, "o_lex"))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("hashpartitioning(h"):]
    assert "Aggregate" not in below


def test_sync_refs(spark):
    refs = "ds_id string, kind string, name string, commit string"
    t = spark.createDataFrame([("d", "branch", "master", "c1")], refs)
    s = spark.createDataFrame([("d", "branch", "master", "c2"), ("d", "branch", "dev", "c3")], refs)
    assert pairs(sets.sync_refs(t, s), "kind", "name", "commit") == {("branch", "master", "c1"), ("leaf", "c2", "c2"), ("branch", "dev", "c3")}
    assert pairs(sets.sync_refs(t, s, branch="master"), "name", "commit") == {("master", "c2")}


def test_mutation(spark):
    q = graph(spark, [("g#a", "g#p", "g#b"), ("g#b", "g#p", "g#c"), ("g#c", "g#p", "x", f"{XSD}string")])
    assert mutation.delete_node(q, "g#b").count() == 1 and mutation.delete_triples(q, "g#a").count() == 2
    assert mutation.delete_where(q, F.col("o_lex") == "x").count() == 2
    assert mutation.add(q, q).count() == 3
    with pytest.raises(ValueError):
        mutation.add_strict(q, q.limit(1))
    moved = mutation.move_nodes(q, spark.createDataFrame([("g#b", "h")], "node string, to_graph string"))
    assert pairs(moved, "graph_iri", "s_id", "o_id") == {("g", "g#a", "h#b"), ("h", "h#b", "g#c"), ("g", "g#c", None)}
    imports = spark.createDataFrame([("a", "b"), ("b", "c")], "graph_iri string, imported_iri string")
    with pytest.raises(ValueError):
        mutation.add_import(imports, "c", "a")
    assert mutation.remove_import(mutation.add_import(imports, "a", "c"), "a", "b").count() == 2
    with pytest.raises(ValueError):
        mutation.delete_graph(q, imports, "b")
    parts, links = mutation.split_by_group(q, spark.createDataFrame([("g#a", "r")], "node string, root string"))
    assert parts.select("graph_iri").distinct().count() == 2 and links.count() == 1


ONTO = [("C", RDF_TYPE, vocabulary.MAIN_CLASS), ("D", f"{RDFS}subClassOf", "C"), ("p", RDF_TYPE, f"{OWL}ObjectProperty"), ("p", f"{RDFS}domain", "C"), ("p", f"{RDFS}range", "C"), ("q", f"{RDFS}subPropertyOf", "p"), ("f", RDF_TYPE, f"{OWL}FunctionalProperty"), ("ff", f"{RDFS}subPropertyOf", "f"), ("n", RDF_TYPE, f"{OWL}DatatypeProperty"), ("n", f"{RDFS}range", f"{XSD}integer"), ("i", RDF_TYPE, f"{OWL}InverseFunctionalProperty")]


def test_validation(spark):
    rows = [("x", RDF_TYPE, "D"), ("x", "q", "y"), ("y", RDF_TYPE, "E"), ("y", "q", "x"), ("z", "unknown", "x"), ("x", "f", "1", f"{XSD}integer"), ("x", "ff", "2", f"{XSD}integer"), ("x", "n", "a", f"{XSD}string"), ("x", "i", "k", f"{XSD}string"), ("y", "i", "k", f"{XSD}string")]
    found = validation.validate(graph(spark, rows), graph(spark, ONTO, "onto"))
    got = pairs(found, "rule", "node", "p")
    assert got == {("RdfType_missing", "z", None), ("RdfType_wrong", "y", None), ("predicate_not_property", "z", "unknown"), ("domain_mismatch", "y", "q"), ("range_mismatch", "x", "q"), ("range_mismatch", "x", "n"), ("functional_property", "x", "f"), ("inverse_functional_property", "k^^http://www.w3.org/2001/XMLSchema#string", "i")}
    assert validation.report(found).first()["report"].startswith("[{")


def test_a_literal_fits_by_datatype(spark):
    onto = graph(spark, ONTO, "onto")
    both = graph(spark, [("x", RDF_TYPE, "D"), ("x", "n", "1", f"{XSD}string"), ("x", "n", "1", f"{XSD}integer")])
    assert pairs(validation.domain_and_range(both, both.unionByName(onto)), "rule", "node", "value") == {("range_mismatch", "x", "1")}
    other = graph(spark, [("C", RDF_TYPE, "http://own/Main"), ("D", f"{RDFS}subClassOf", "C")], "onto")
    assert validation.validate(graph(spark, [("x", RDF_TYPE, "D")]), other, ["RdfType"], main_class="http://own/Main").isEmpty()
    assert validation.validate(graph(spark, [("x", RDF_TYPE, "D")]), other, ["RdfType"]).count() == 1


def test_vocabulary(spark):
    v = vocabulary.from_graph(graph(spark, ONTO, "onto"))
    assert pairs(v.filter("is_main_class"), "iri") == {("C",)} and v.filter("iri = 'p'").first()["range"] == "C"
    domain, _ = vocabulary.domain_range(graph(spark, ONTO, "onto"))
    assert pairs(domain, "node", "domain") == {("p", "C"), ("q", "C")}
    up = spark.createDataFrame([("B", "A")], EDGES)
    typed = spark.createDataFrame([("x", "A"), ("x", "B"), ("y", "A")], "node string, cls string")
    main = spark.createDataFrame([("A",), ("B",)], "cls string")
    assert pairs(vocabulary.type_of(typed, main, up), "node", "cls") == {("x", "B"), ("y", "A")}
    assert {r["cls"]: r["supersedes"] for r in vocabulary.supersedes(main, up).collect()} == {"A": ["A"], "B": ["A", "B"]}


def test_search(spark):
    d = search.index(spark.createDataFrame([(1, "The Big Ring", "A-1"), (2, "small ring", "B 2"), (3, None, None)], "k int, t string, i string"), {"t": (F.array("t"), "standard"), "i": (F.array("i"), "separated")})
    ids = lambda c: {r["k"] for r in d.filter(c).collect()}
    assert ids(search.parse("ring", "t")) == {1, 2} and ids(search.parse("+ring -big", "t")) == {2}
    assert ids(search.parse('i:b-2 "big ring"', "t")) == {1, 2} and ids(search.parse("sm*", "t")) == {2}
    assert ids(search.parse("/sm.ll/", "t")) == {2} and ids(search.parse("*", "t")) == {1, 2, 3}
    assert [r["k"] for r in search.search(d, search.match_all(), size=2, start=1, sort=["-k"], key="k").collect()] == [2, 1]
    assert search.score("t", ["ring", "big"], d).orderBy(F.desc("score")).first()["k"] == 1


def test_derived_documents(spark):
    q = graph(spark, [("g#a", RDF_TYPE, "v#Part"), ("g#a", f"{RDFS}label", "Bolt", f"{XSD}string"), ("g#a", "v#id", "A7", f"{XSD}string"), ("g#b", RDF_TYPE, "v#Doc")])
    none = spark.createDataFrame([], "graph_iri string, imported_iri string")
    row = search.derive(q, none, [["Part"], ["Doc"]]).first()
    assert (row["main_type"], row["label"], row["id_sort"]) == ("Part", ["Bolt"], "A0000000007")
    two = search.derive(q.union(graph(spark, [("g#c", RDF_TYPE, "v#Part")])), none, [["Part"], ["Doc"]]).first()
    assert (two["main_type"], two["label"]) == ("-", [])
