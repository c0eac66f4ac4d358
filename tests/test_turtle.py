import pytest
from pyspark.sql import functions as F

from quadlake.functions.literals import XSD
from quadlake.model import RDF_FIRST, RDF_NIL, RDF_REST, RDF_TYPE
from quadlake.operators import collections, sets
from quadlake.operators.mutation import statements
from quadlake.sources import step, turtle


def flat(text, **options):
    return [(s.value if s.kind == "iri" else "_", p, o.value if o.kind != "blank" else "_", o.dt, o.lang) for _, s, p, o in turtle.parse(text, **options)]


GOOD = [
    ("<http://a> <http://b> <http://c> .", [("http://a", "http://b", "http://c", None, None)]),
    ("@prefix : <http://x#> . :a a :b .", [("http://x#a", RDF_TYPE, "http://x#b", None, None)]),
    ("PREFIX p: <http://x#>\np:a p:b 1, 2.5, 1e3, true, 'x'@en-US, \"y\"^^p:t.", [("http://x#a", "http://x#b", v, d, g) for v, d, g in (("1", f"{XSD}integer", None), ("2.5", f"{XSD}decimal", None), ("1e3", f"{XSD}double", None), ("true", f"{XSD}boolean", None), ("x", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString", "en-US"), ("y", "http://x#t", None))]),
    ("<http://a> <http://b> \"\"\"a\n\"b\" \\u0041\"\"\" ; <http://c> [] ;.", [("http://a", "http://b", 'a\n"b" A', f"{XSD}string", None), ("http://a", "http://c", "_", None, None)]),
    ("[ <http://p> <http://o> ] .", [("_", "http://p", "http://o", None, None)]),
    ("<http://s> <http://p> () .", [("http://s", "http://p", RDF_NIL, None, None)]),
    ("<http://s> <http://p> (1) .", [("_", RDF_FIRST, "1", f"{XSD}integer", None), ("_", RDF_REST, RDF_NIL, None, None), ("http://s", "http://p", "_", None, None)]),
    ("@base <http://b/> . <x> <#p> <y/z> . # end", [("http://b/x", "http://b/#p", "http://b/y/z", None, None)]),
    ("@prefix p: <http://x/> . p:a\\,b p:c p:%41 .", [("http://x/a,b", "http://x/c", "http://x/%41", None, None)]),
]


@pytest.mark.parametrize(("text", "want"), GOOD)
def test_good(text, want):
    assert flat(text) == want


@pytest.mark.parametrize("text", ["<http://a> <http://b> .", "<http://a> <http://b> <http://c>", "p:a p:b p:c .", "<http://a> 'x' <http://b> .", "'x' <http://a> <http://b> .", "<http://a> <http://b> 'x\ny' .", "<http://a> <http://b> \"\\z\" .", "<a> <http://b> <http://c> .", "<http://a b> <http://b> <http://c> .", "@prefix x <http://a> .", "<http://a> <http://b> <http://c> . .", "<http://a> <http://b> 'x'@1 .", "<http://a> <http://b> \"\\uD800\" .", "[] ."])
def test_bad(text):
    with pytest.raises(turtle.ParseError):
        turtle.parse(text)


def test_recovery_and_lines():
    p = turtle.Parser("<http://a> <http://b> 1 .\n<http://a> oops .\n<http://a> <http://b> 2 .\n", strict=False)
    assert [o.value for _, _, _, o in p.parse()] == ["1", "2"]
    assert [e.line for e in p.errors] == [2]


def test_trig():
    got = [(g, o.value) for g, _, _, o in turtle.parse("<http://a> <http://b> 0 . <http://g> { <http://a> <http://b> 1 } GRAPH <http://h> { <http://a> <http://b> 2 . } { <http://a> <http://b> 3 }", trig=True, graph="d")]
    assert got == [("d", "0"), ("http://g", "1"), ("http://h", "2"), ("d", "3")]


def test_files(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("@base <http://g> .\n<http://g> a <http://www.w3.org/2002/07/owl#Ontology> ; <http://www.w3.org/2002/07/owl#imports> <http://h> .\n<#n> <#p> (1 2), (<#m> 'x') ; a <#C> .\n")
    (tmp_path / "b.ttl").write_text("<http://x> oops .\n")
    rows = turtle.read(spark, str(tmp_path), mode="PERMISSIVE")
    assert rows.filter("error IS NOT NULL").count() == 1
    rows = turtle.read(spark, str(tmp_path), mode="DROPMALFORMED")
    assert [r[1] for r in turtle.imports(rows).collect()] == ["http://h"]
    q = turtle.quads(rows)
    folded = collections.rebuild_lists(q)
    got = {(r["o_kind"], tuple(i["lex"] or i["id"] for i in r["o_items"])) for r in folded.filter("o_items IS NOT NULL").collect()}
    assert got == {("literal_collection", ("1", "2")), ("term_collection", ("http://g#m", "x"))}
    assert folded.count() == 3 and turtle.foreign_subjects(q).count() == 0


def test_round_trip(spark, tmp_path):
    q = statements(spark.createDataFrame([("http://g#a", RDF_TYPE, "http://g#C", None, None), ("http://g#a", "http://g#p", 'q"\\\n', f"{XSD}string", None), ("http://g#a", "http://g#p", "7", f"{XSD}integer", None), ("_:11111111-1111-4111-8111-111111111111", "http://g#p", "x", None, None)], "s string, p string, o string, dt string, lang string"), "http://g").filter("o_id IS NULL OR o_id <> 'x'")
    turtle.write_turtle(q, str(tmp_path / "out"), spark.createDataFrame([("http://g", "http://h")], "graph_iri string, imported_iri string"))
    text = spark.read.text(str(tmp_path / "out"), wholetext=True).select("value")
    rows = turtle.read_text(spark, text, "http://g")
    assert sets.equal(turtle.quads(rows), q) and turtle.imports(rows).count() == 1
    assert turtle.nquads_text(q).count() == q.count()


def test_step(spark, tmp_path):
    (tmp_path / "a.stp").write_text("ISO-10303-21;\nHEADER;\nENDSEC;\nDATA;\n#1=POINT('it''s',(1.,2.5),.T.);\n#2=LINE(#1,$,*,(#1,#1));\n#3=(A(1)B(#2));\nENDSEC;\nEND-ISO-10303-21;\n")
    q = step.read_p21(spark, str(tmp_path))
    types = {(r["s_id"].rsplit("#", 1)[1], r["o_id"]) for r in q.filter(F.col("p") == RDF_TYPE).collect()}
    assert types == {("1", "p21:POINT"), ("2", "p21:LINE"), ("3", "p21:A"), ("3", "p21:B")}
    assert q.filter("p = 'p21:POINT/0'").first()["o_lex"] == "it's"
    lines = {r[0] for r in step.write_p21(q.filter(F.col("s_id").endswith("#2"))).collect()}
    assert lines == {"#2=LINE(#1,#1,#1);"}
    (tmp_path / "a.svg").write_text('<svg><line x1="0" y1="1"/><text x="2">hi</text></svg>')
    shapes = step.read_svg(spark, str(tmp_path))
    assert shapes.count() == 6 and "<text x=\"2\">hi</text>" in step.svg_text(shapes).first()["text"]
