"""Exchange formats of product data: STEP Part 21, AP242 XML and SVG, mapped to quads."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.model import COLUMNS, RDF_TYPE
from quadlake.operators.mutation import statements
from quadlake.functions.literals import XSD

TOKEN = re.compile(r"\s+|/\*.*?\*/|(?P<ref>\#\d+)|(?P<str>'(?:[^']|'')*')|(?P<enum>\.[A-Za-z_0-9]+\.)|(?P<bin>\"[0-9A-Fa-f]*\")|(?P<num>[+-]?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_][A-Za-z0-9_-]*)|(?P<mark>[()=,;$*])", re.S)


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at]!r} at {at}")
        at = m.end()
        if m.lastgroup:
            yield m.lastgroup, m[0]


def _value(tokens: list[tuple[str, str]], at: int):
    kind, text = tokens[at]
    if text == "(" and kind == "mark":
        items, at = [], at + 1
        while tokens[at][1] != ")":
            item, at = _value(tokens, at)
            items.append(item)
            if tokens[at][1] == ",":
                at += 1
        return items, at + 1
    if kind == "name":  # a typed parameter
        inner, at = _value(tokens, at + 1)
        return ("typed", text.upper(), inner), at
    return (kind, text), at + 1


def instances(text: str) -> Iterator[tuple[str, list[tuple[str, list]]]]:
    """#id and its entities, (NAME, parameters) each; several for a complex instance."""
    data = re.search(r"\bDATA\s*(?:\([^)]*\))?\s*;(.*?)\bENDSEC\s*;", text, re.S)
    tokens = list(_tokens(data[1])) if data else []
    at = 0
    while at < len(tokens):
        ref, at = tokens[at][1], at + 2
        entities = []
        if tokens[at][1] == "(":
            at += 1
            while tokens[at][1] != ")":
                name = tokens[at][1].upper()
                params, at = _value(tokens, at + 1)
                entities.append((name, params))
            at += 1
        else:
            name = tokens[at][1].upper()
            params, at = _value(tokens, at + 1)
            entities.append((name, params))
        yield ref, entities
        at += 1  # the semicolon


def _statements(text: str) -> Iterator[tuple[str, str, str, str | None]]:
    def flat(s: str, p: str, v) -> Iterator[tuple]:
        if isinstance(v, list):
            for i, x in enumerate(v):
                yield from flat(s, f"{p}/{i}", x)
        elif v[0] == "typed":
            yield from flat(s, p, v[2][0] if isinstance(v[2], list) and len(v[2]) == 1 else v[2])
        elif v[0] == "ref":
            yield s, p, v[1][1:], None
        elif v[0] == "str":
            yield s, p, v[1][1:-1].replace("''", "'"), f"{XSD}string"
        elif v[0] == "num":
            yield s, p, v[1], f"{XSD}double" if re.search("[.eE]", v[1]) else f"{XSD}integer"
        elif v[0] in ("enum", "bin"):
            yield s, p, v[1].strip('."'), f"{XSD}string"

    for ref, entities in instances(text):
        for name, params in entities:
            yield ref[1:], RDF_TYPE, f"p21:{name}", None
            for i, v in enumerate(params):
                yield from flat(ref[1:], f"p21:{name}/{i}", v)


def read_p21(spark: SparkSession, path: str) -> DataFrame:
    """Quads of all Part 21 files under path: a graph for each file, a node for each instance, a predicate for each place of an
    entity's parameters."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, content in zip(batch["path"], batch["content"], strict=True):
                graph = f"urn:file:{at.rsplit('/', 1)[-1]}"
                rows = [(graph, f"{graph}#{s}", p, f"{graph}#{o}" if dt is None and p != RDF_TYPE else o, dt) for s, p, o, dt in _statements(content.decode("latin-1"))]
                yield pd.DataFrame(rows, columns=["g", "s", "p", "o", "dt"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.st*p").load(path).select("path", "content")
    rows = files.mapInPandas(look, "g string, s string, p string, o string, dt string")
    return statements(rows, "").join(rows.select(F.col("s").alias("s_id"), F.col("g")).distinct(), "s_id").withColumn("graph_iri", F.col("g")).select(*COLUMNS)


def map_entities(q: DataFrame, classes: DataFrame, properties: DataFrame) -> DataFrame:
    """Types by a table (entity, cls) and predicates by a table (p, prop, inverse); what has no mapping stays. An inverse one swaps
    subject and object."""
    c = classes.select(F.concat(F.lit("p21:"), F.col("entity")).alias("o_id"), "cls")
    out = q.join(c, "o_id", "left").withColumn("o_id", F.coalesce("cls", "o_id")).drop("cls").join(properties.select("p", "prop", "inverse"), "p", "left")
    swap = F.coalesce(F.col("inverse"), F.lit(False)) & F.col("o_id").isNotNull()
    s, o = F.when(swap, F.col("o_id")).otherwise(F.col("s_id")), F.when(swap, F.col("s_id")).otherwise(F.col("o_id"))
    return out.select(F.coalesce("prop", "p").alias("p2"), s.alias("s2"), o.alias("o2"), *[x for x in COLUMNS if x not in ("p", "s_id", "o_id")]).withColumnsRenamed({"p2": "p", "s2": "s_id", "o2": "o_id"}).select(*COLUMNS)


def write_p21(q: DataFrame) -> DataFrame:
    """Part 21 instance lines (column value), with places of parameters in order; nested lists are flattened into their place."""
    own = q.filter(F.col("p") == RDF_TYPE).select("s_id", F.regexp_replace("o_id", "^p21:", "").alias("entity"))
    ref = F.concat(F.lit("#"), F.regexp_extract("o_id", "#([^#]*)$", 1))
    value = F.when(F.col("o_id").isNotNull(), ref).when(F.col("o_dt") == f"{XSD}string", F.concat(F.lit("'"), F.replace("o_lex", F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(F.col("o_lex"))
    params = q.filter(F.col("p").startswith("p21:") & F.col("p").contains("/")).select("s_id", F.regexp_extract("p", "^p21:([^/]*)/", 1).alias("entity"), F.transform(F.split(F.regexp_extract("p", "/(.*)$", 1), "/"), lambda x: x.cast("int")).alias("place"), value.alias("v"))
    one = params.groupBy("s_id", "entity").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "v"))), lambda x: x["v"]), ",").alias("args"))
    return own.join(one, ["s_id", "entity"], "left").select(F.concat(F.lit("#"), F.regexp_extract("s_id", "#([^#]*)$", 1), F.lit("="), F.col("entity"), F.lit("("), F.coalesce("args", F.lit("")), F.lit(");")).alias("value"))


def read_ap242(spark: SparkSession, path: str, row_tag: str = "Part") -> DataFrame:
    """Quads of one kind of element of AP242 XML files, by Spark's XML source: a node for each uid, a literal for each scalar child."""
    df = spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "_").load(path)
    scalar = [n for n, t in df.dtypes if t in ("string", "bigint", "double", "boolean") and n != "_uid"]
    graph = F.lit("urn:ap242")
    none = F.lit(None).cast("string")
    pairs = F.array_compact(F.array(*[F.when(F.col(f"`{n}`").isNotNull(), F.struct(F.lit(f"ap242:{n.lstrip('_')}").alias("p"), F.col(f"`{n}`").cast("string").alias("o"), F.lit(f"{XSD}string").alias("dt"))) for n in scalar], F.struct(F.lit(RDF_TYPE).alias("p"), F.lit(f"ap242:{row_tag}").alias("o"), none.alias("dt"))))
    rows = df.select(F.concat(graph, F.lit("#"), F.col("_uid")).alias("s"), F.explode(pairs).alias("t")).select("s", "t.p", "t.o", "t.dt")
    return statements(rows, "urn:ap242")


def write_ap242(q: DataFrame, path: str, row_tag: str = "Part") -> None:
    """One element for each subject, its literals as children."""
    wide = q.filter("o_lex IS NOT NULL").groupBy(F.col("s_id").alias("_uid")).pivot("p").agg(F.min("o_lex"))
    wide.select("_uid", *[F.col(f"`{c}`").alias(re.sub(r"^ap242:", "", c)) for c in wide.columns if c != "_uid"]).write.mode("overwrite").format("xml").option("rowTag", row_tag).option("rootTag", "DataContainer").save(path)


SHAPE = re.compile(r"<(line|circle|rect|path|text)\b([^>]*)/?>(?:([^<]*)</text>)?")
ATTRIBUTE = re.compile(r'([A-Za-z_:][\w:.-]*)\s*=\s*"([^"]*)"')


def read_svg(spark: SparkSession, path: str) -> DataFrame:
    """Quads of the shapes of SVG files: a node for each element in document order, its attributes as literals."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for at, content in zip(batch["path"], batch["content"], strict=True):
                graph = f"urn:file:{at.rsplit('/', 1)[-1]}"
                for i, m in enumerate(SHAPE.finditer(content.decode("utf-8"))):
                    s = f"{graph}#e{i}"
                    rows.append((graph, s, RDF_TYPE, f"svg:{m[1]}", None))
                    rows += [(graph, s, f"svg:{a}", v, f"{XSD}string") for a, v in ATTRIBUTE.findall(m[2])]
                    if m[3]:
                        rows.append((graph, s, "svg:content", m[3].strip(), f"{XSD}string"))
            yield pd.DataFrame(rows, columns=["g", "s", "p", "o", "dt"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.svg").load(path).select("path", "content")
    rows = files.mapInPandas(look, "g string, s string, p string, o string, dt string")
    return statements(rows, "").withColumn("graph_iri", F.regexp_replace("s_id", "#[^#]*$", "")).select(*COLUMNS)


def svg_text(q: DataFrame) -> DataFrame:
    """graph_iri, text: an SVG document for each graph of shapes."""
    shape = F.max(F.when(F.col("p") == RDF_TYPE, F.regexp_replace("o_id", "^svg:", "")))
    attrs = F.array_join(F.sort_array(F.collect_list(F.when(F.col("p").startswith("svg:") & (F.col("p") != "svg:content"), F.concat(F.regexp_replace("p", "^svg:", ""), F.lit('="'), F.col("o_lex"), F.lit('"'))))), " ")
    rows = q.groupBy("graph_iri", "s_id").agg(shape.alias("shape"), attrs.alias("a"), F.max(F.when(F.col("p") == "svg:content", F.col("o_lex"))).alias("c"))
    line = F.concat(F.lit("<"), F.col("shape"), F.lit(" "), F.col("a"), F.when(F.col("c").isNull(), "/>").otherwise(F.concat(F.lit(">"), F.col("c"), F.lit("</"), F.col("shape"), F.lit(">"))))
    at = F.regexp_extract("s_id", "([0-9]*)$", 1).try_cast("int")
    one = rows.select("graph_iri", at.alias("i"), line.alias("line")).groupBy("graph_iri").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return one.select("graph_iri", F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg">\n'), F.col("body"), F.lit("\n</svg>")).alias("text"))


