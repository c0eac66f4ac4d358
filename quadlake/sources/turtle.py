"""Turtle and TriG: a parser, a Spark reader over folders of files, and writers."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadlake.functions import iri as fn
from quadlake.functions.literals import LANG_STRING, XSD
from quadlake.model import COLUMNS, OWL, QUADS, RDF_FIRST, RDF_NIL, RDF_REST, RDF_TYPE

#: The terminals of the Turtle and TriG grammars.
_HEX = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}"
_BASE_CHAR = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02ff\u0370-\u037d\u037f-\u1fff\u200c-\u200d\u2070-\u218f\u2c00-\u2fef\u3001-\ud7ff\uf900-\ufdcf\ufdf0-\ufffd\U00010000-\U000effff"
_CHAR = f"{_BASE_CHAR}_\\-0-9\u00b7\u0300-\u036f\u203f-\u2040"
_PLX = r"%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%]"
_PREFIX = f"(?:[{_BASE_CHAR}](?:[{_CHAR}.]*[{_CHAR}])?)?"
_LOCAL = f"(?:(?:[{_BASE_CHAR}_:0-9]|{_PLX})(?:(?:[{_CHAR}.:]|{_PLX})*(?:[{_CHAR}:]|{_PLX}))?)?"
TOKEN = re.compile(
    rf"""(?P<space>(?:[\x20\t\r\n]|\#[^\r\n]*)+)
|(?P<iri><(?:[^\x00-\x20<>"{{}}|^`\\]|{_HEX})*>)
|(?P<long>\"\"\"(?:(?:"|"")?(?:[^"\\]|\\[tbnrf"'\\]|{_HEX}))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\[tbnrf"'\\]|{_HEX}))*''')
|(?P<string>"(?:[^"\\\r\n]|\\[tbnrf"'\\]|{_HEX})*"|'(?:[^'\\\r\n]|\\[tbnrf"'\\]|{_HEX})*')
|(?P<directive>@prefix\b|@base\b)
|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
|(?P<blank>_:[{_BASE_CHAR}_0-9](?:[{_CHAR}.]*[{_CHAR}])?)
|(?P<double>[+-]?(?:[0-9]+\.[0-9]*[eE][+-]?[0-9]+|\.?[0-9]+[eE][+-]?[0-9]+))
|(?P<decimal>[+-]?[0-9]*\.[0-9]+)
|(?P<integer>[+-]?[0-9]+)
|(?P<name>{_PREFIX}:{_LOCAL})
|(?P<word>[A-Za-z]+)
|(?P<mark>\^\^|[.;,\[\](){{}}])""",
    re.X,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_SHORT = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


class ParseError(ValueError):
    def __init__(self, what: str, line: int):
        super().__init__(f"line {line}: {what}")
        self.line = line


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        code = m[1] or m[2]
        if not code:
            return _SHORT.get(m[3], m[3])
        n = int(code, 16)
        if n > 0x10FFFF or 0xD800 <= n < 0xE000:
            raise ValueError("no such character")
        return chr(n)

    return _ESCAPE.sub(one, text) if "\\" in text else text


@dataclass
class Term:
    kind: str  #: iri, blank or literal
    value: str
    dt: str | None = None
    lang: str | None = None


@dataclass
class Parser:
    """Recursive descent over tokens. In recovering mode a bad statement is skipped up to the next full stop, and reported."""

    text: str
    base: str = ""
    graph: str = ""
    trig: bool = False
    strict: bool = True
    errors: list[ParseError] = field(default_factory=list)

    def __post_init__(self):
        self.prefixes: dict[str, str] = {}
        self.labels: dict[str, str] = {}
        #: New blank nodes are numbered under the graph and the text, so that parsing again, after a lost executor say, gives the same.
        self.seed, self.made = uuid.uuid5(uuid.NAMESPACE_URL, f"{self.graph}\n{self.text}"), 0
        self.at, self.kind, self.value, self.line = 0, "", "", 1
        self.out: list[tuple[str, Term, str, Term]] = []
        self.current = self.graph

    # tokens

    def step(self) -> None:
        while True:
            if self.at >= len(self.text):
                self.kind, self.value = "end", ""
                return
            m = TOKEN.match(self.text, self.at)
            if not m:
                raise self.error(f"unexpected {self.text[self.at]!r}")
            self.start, self.at = self.at, m.end()
            self.line += m[0].count("\n")
            if m.lastgroup != "space":
                self.kind, self.value = m.lastgroup, m[0]
                return

    def error(self, what: str) -> ParseError:
        return ParseError(what, self.line)

    def want(self, mark: str) -> None:
        if self.kind != "mark" or self.value != mark:
            raise self.error(f"{mark} expected, not {self.value or 'the end'}")
        self.step()

    def is_mark(self, *marks: str) -> bool:
        return self.kind == "mark" and self.value in marks

    # grammar

    def parse(self) -> Iterator[tuple[str, Term, str, Term]]:
        """graph, subject, predicate, object of every statement, one top-level statement at a time."""
        while True:
            try:
                if not self.kind:
                    self.step()
                if self.kind == "end":
                    return
                self.out = []
                self.statement()
                yield from self.out
            except (ParseError, ValueError) as e:
                e = e if isinstance(e, ParseError) else self.error(str(e))
                if self.strict:
                    raise e from None
                self.errors.append(e)
                self.skip()

    def skip(self) -> None:
        """To behind the next full stop that ends a line or the text."""
        m = re.compile(r"\.[\x20\t]*(?:\r?\n|$)").search(self.text, self.at)
        end = m.end() if m else len(self.text)
        self.line += self.text.count("\n", self.at, end)
        self.at, self.kind = end, ""

    def statement(self) -> None:
        if self.kind == "directive" or (self.kind == "word" and self.value.upper() in ("PREFIX", "BASE")):
            return self.directive()
        if self.trig and (self.is_mark("{") or (self.kind == "word" and self.value.upper() == "GRAPH")):
            if self.kind == "word":
                self.step()
                self.current = self.term_iri() if self.kind in ("iri", "name") else f"_:{self.blank().value}"
            return self.block()
        if self.trig and self.kind in ("iri", "name", "blank"):
            mark = (self.at, self.kind, self.value, self.line)
            name = self.term_iri() if self.kind != "blank" else f"_:{self.blank().value}"
            if self.is_mark("{"):
                self.current = name
                return self.block()
            self.at, self.kind, self.value, self.line = mark
        self.triples()
        self.want(".")

    def block(self) -> None:
        self.want("{")
        while not self.is_mark("}"):
            self.triples()
            if not self.is_mark("."):
                break
            self.step()
        self.want("}")
        self.current = self.graph

    def directive(self) -> None:
        at_form, what = self.value.startswith("@"), self.value.strip("@").lower()
        self.step()
        if what == "prefix":
            if self.kind != "name" or not self.value.endswith(":"):
                raise self.error("a prefix expected")
            name = self.value[:-1]
            self.step()
            if self.kind != "iri":
                raise self.error("an IRI expected")
            self.prefixes[name] = self.term_iri()
        else:
            if self.kind != "iri":
                raise self.error("an IRI expected")
            self.base = self.term_iri()
        if at_form:
            self.want(".")

    def triples(self) -> None:
        if self.is_mark("["):
            s, bare = self.blank_list()
            if not (bare and self.is_mark(".", "}")):
                self.predicates(s)
            elif bare == "empty":
                raise self.error("a predicate expected")
            return
        if self.is_mark("("):
            s = self.collection()
        elif self.kind == "blank":
            s = self.blank()
        else:
            s = Term("iri", self.term_iri())
        self.predicates(s)

    def predicates(self, s: Term) -> None:
        while True:
            if self.kind == "word" and self.value == "a":
                p = RDF_TYPE
                self.step()
            else:
                p = self.term_iri()
            while True:
                o = self.object()
                self.out.append((self.current, s, p, o))
                if not self.is_mark(","):
                    break
                self.step()
            if not self.is_mark(";"):
                return
            while self.is_mark(";"):
                self.step()
            if self.is_mark(".", "]", "}") or self.kind == "end":
                return

    def object(self) -> Term:
        if self.kind in ("iri", "name"):
            return Term("iri", self.term_iri())
        if self.kind == "blank":
            return self.blank()
        if self.is_mark("["):
            return self.blank_list()[0]
        if self.is_mark("("):
            return self.collection()
        return self.literal()

    def literal(self) -> Term:
        kind, value = self.kind, self.value
        if kind in ("integer", "decimal", "double"):
            self.step()
            return Term("literal", value, f"{XSD}{kind}")
        if kind == "word" and value in ("true", "false"):
            self.step()
            return Term("literal", value, f"{XSD}boolean")
        if kind not in ("string", "long"):
            raise self.error(f"an object expected, not {value or 'the end'}")
        text = unescape(value[3:-3] if kind == "long" else value[1:-1])
        self.step()
        if self.kind == "lang":
            lang = self.value[1:]
            self.step()
            return Term("literal", text, LANG_STRING, lang)
        if self.is_mark("^^"):
            self.step()
            return Term("literal", text, self.term_iri())
        return Term("literal", text, f"{XSD}string")

    def term_iri(self) -> str:
        if self.kind == "iri":
            out = unescape(self.value[1:-1])
            if re.search(r'[\x00-\x20<>"{}|^`\\]', out):
                raise self.error("a character that IRIs cannot have")
            if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", out):
                if not self.base:
                    raise self.error(f"a relative IRI without a base: {out!r}")
                out = self.base.split("#")[0] + out if out.startswith("#") or not out else urljoin(self.base, out) if "://" in self.base else self.base + out
        elif self.kind == "name":
            prefix, _, local = self.value.partition(":")
            if prefix not in self.prefixes:
                raise self.error(f"unknown prefix {prefix}:")
            out = self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        else:
            raise self.error(f"an IRI expected, not {self.value or 'the end'}")
        self.step()
        return out

    def new_blank(self) -> str:
        self.made += 1
        return str(uuid.uuid5(self.seed, str(self.made)))

    def blank(self) -> Term:
        """A UUID keeps its place as a label; other labels get one of their own in each text."""
        label = self.value[2:]
        self.step()
        if label not in self.labels:
            self.labels[label] = label.lower() if re.match(fn.UUID, label) else self.new_blank()
        return Term("blank", self.labels[label])

    def blank_list(self) -> tuple[Term, str]:
        """The node and `full` or `empty`."""
        s = Term("blank", self.new_blank())
        self.step()
        if self.is_mark("]"):
            self.step()
            return s, "empty"
        self.predicates(s)
        self.want("]")
        return s, "full"

    def collection(self) -> Term:
        self.step()
        items = []
        while not self.is_mark(")"):
            items.append(self.object())
        self.step()
        cells = [Term("blank", self.new_blank()) for _ in items] + [Term("iri", RDF_NIL)]
        for cell, item, rest in zip(cells, items, cells[1:], strict=False):
            self.out.append((self.current, cell, RDF_FIRST, item))
            self.out.append((self.current, cell, RDF_REST, rest))
        return cells[0]


def parse(text: str, **options) -> list[tuple[str, Term, str, Term]]:
    return list(Parser(text, **options).parse())


ROWS = "path string, graph_iri string, s_kind string, s_id string, p string, o_kind string, o_id string, o_lex string, o_dt string, o_lang string, o_num double, line int, error string"


def _number(o: Term) -> float | None:
    if o.kind == "literal" and o.dt and o.dt.startswith(XSD) and o.dt[len(XSD) :] not in ("string", "boolean", "dateTime", "dateTimeStamp"):
        try:
            return float(o.value)
        except ValueError:
            return None
    return None


def _rows(path: str, p: Parser) -> Iterator[tuple]:
    for g, s, pred, o in p.parse():
        lit = o.kind == "literal"
        yield (path, g, s.kind, s.value, pred, o.kind, None if lit else o.value, o.value if lit else None, o.dt, o.lang, _number(o), p.line, None)
    for e in p.errors:
        yield (path, None, None, None, None, None, None, None, None, None, None, e.line, str(e))


def read(spark: SparkSession, path: str, *, form: str = "turtle", mode: str = "FAILFAST") -> DataFrame:
    """Statements of all files under path, with path, line and error columns; files are parsed one by one, on the executors.

    mode FAILFAST stops at the first bad statement, DROPMALFORMED skips it, PERMISSIVE keeps a row with its error. A graph's
    IRI is the file's base: the @base if there is one, else urn:file: and the file name; TriG names its graphs.
    """
    trig = form == "trig"

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ROWS.split(", ")]
        for batch in batches:
            for at, content in zip(batch["path"], batch["content"], strict=True):
                text = content.decode("utf-8-sig")
                m = re.search(r"(?m)^\s*(?:@base|BASE)\s*<([^>]*)>", text)
                graph = (m[1] if m else f"urn:file:{at.rsplit('/', 1)[-1]}").rstrip("#")
                p = Parser(text, base=graph, graph=graph, trig=trig, strict=mode == "FAILFAST")
                rows = []
                for row in _rows(at, p):
                    rows.append(row)
                    if len(rows) == 50_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    glob = "*.trig" if trig else "*.ttl"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")
    rows = files.mapInPandas(look, ROWS)
    return rows if mode == "PERMISSIVE" else rows.filter("error IS NULL")


def read_text(spark: SparkSession, texts: DataFrame, graph: str, *, trig: bool = False, mode: str = "FAILFAST") -> DataFrame:
    """Statements of documents in a column value, each a whole text; graph is the base of those that name none."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ROWS.split(", ")]
        for batch in batches:
            for text in batch["value"]:
                p = Parser(text, base=graph, graph=graph, trig=trig, strict=mode == "FAILFAST")
                yield pd.DataFrame(list(_rows("", p)), columns=names)

    rows = texts.select("value").mapInPandas(look, ROWS)
    return rows if mode == "PERMISSIVE" else rows.filter("error IS NULL")


def quads(rows: DataFrame) -> DataFrame:
    """Statements without the file columns, as a set of quads without the ontology statement and imports."""
    q = rows.withColumn("o_items", F.lit(None).cast(QUADS["o_items"].dataType)).select(*COLUMNS)
    header = (F.col("p") == RDF_TYPE) & (F.col("o_id") == f"{OWL}Ontology") & (F.col("s_id") == F.col("graph_iri"))
    return q.filter(~F.coalesce(header | (F.col("p") == f"{OWL}imports"), F.lit(False))).dropDuplicates([c for c in COLUMNS if c != "o_items"])


def imports(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("p") == f"{OWL}imports").select("graph_iri", F.regexp_replace("o_id", "#$", "").alias("imported_iri")).distinct()


def foreign_subjects(q: DataFrame) -> DataFrame:
    """Statements whose subject IRI does not belong to their graph."""
    return q.filter((F.col("s_kind") == "iri") & (fn.base(F.col("s_id")) != F.col("graph_iri")))


def _term(kind: str, node: str, lex: str, dt: str, lang: str):
    literal = F.concat(F.lit('"'), fn.escape_literal(F.col(lex)), F.lit('"'), F.when(F.col(lang).isNotNull(), F.concat(F.lit("@"), F.col(lang))).when(F.coalesce(F.col(dt), F.lit(f"{XSD}string")) == f"{XSD}string", "").otherwise(F.concat(F.lit("^^<"), F.col(dt), F.lit(">"))))
    return F.when(F.col(kind) == "literal", literal).when(F.col(kind) == "blank", F.concat(F.lit("_:"), F.col(node))).otherwise(F.concat(F.lit("<"), F.col(node), F.lit(">")))


def _object():
    item = F.transform("o_items", lambda m: F.when(m["kind"] == "literal", F.concat(F.lit('"'), fn.escape_literal(m["lex"]), F.lit('"'), F.when(m["lang"].isNotNull(), F.concat(F.lit("@"), m["lang"])).otherwise(F.concat(F.lit("^^<"), m["dt"], F.lit(">"))))).when(m["kind"] == "blank", F.concat(F.lit("_:"), m["id"])).otherwise(F.concat(F.lit("<"), m["id"], F.lit(">"))))
    listed = F.concat(F.lit("( "), F.array_join(item, " "), F.lit(" )"))
    return F.when(F.col("o_items").isNotNull(), listed).otherwise(_term("o_kind", "o_id", "o_lex", "o_dt", "o_lang"))


def subjects_text(q: DataFrame) -> DataFrame:
    """graph_iri, rank, s_id, text: one Turtle block for each subject, predicates and objects in order."""
    rank = F.when(F.col("s_kind") != "iri", 2).when(fn.is_uuid(fn.fragment(F.col("s_id"))), 1).otherwise(0)
    lines = q.select("graph_iri", rank.alias("rank"), "s_kind", "s_id", F.when(F.col("p") == RDF_TYPE, "a").otherwise(F.concat(F.lit("<"), F.col("p"), F.lit(">"))).alias("pt"), (F.col("p") != RDF_TYPE).alias("later"), _object().alias("ot"))
    one = lines.groupBy("graph_iri", "rank", "s_kind", "s_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("later", "pt", "ot"))), lambda x: F.concat(x["pt"], F.lit(" "), x["ot"])), " ;\n\t").alias("body"))
    s = F.when(F.col("s_kind") == "iri", F.concat(F.lit("<"), F.col("s_id"), F.lit(">"))).otherwise(F.concat(F.lit("_:"), F.col("s_id")))
    return one.select("graph_iri", "rank", "s_id", F.concat(s, F.lit("\n\t"), F.col("body"), F.lit(" .")).alias("text"))


def write_turtle(q: DataFrame, path: str, imported: DataFrame | None = None) -> None:
    """A folder of .ttl text for each graph (graph_key=<base64url of its IRI>), subjects in canonical order. Whole graphs go to a
    task each; spread large ones with write_ntriples."""
    head = q.select("graph_iri").distinct()
    if imported is not None:
        head = head.join(imported.groupBy("graph_iri").agg(F.sort_array(F.collect_list("imported_iri")).alias("i")), "graph_iri", "left")
    else:
        head = head.withColumn("i", F.array().cast("array<string>"))
    lines = F.array_join(F.transform(F.coalesce("i", F.array().cast("array<string>")), lambda x: F.concat(F.lit(" ;\n\t<" + f"{OWL}imports> <"), x, F.lit(">"))), "")
    first = head.select("graph_iri", F.lit(-1).alias("rank"), F.lit("").alias("s_id"), F.concat(F.lit("@base <"), F.col("graph_iri"), F.lit("> .\n<"), F.col("graph_iri"), F.lit(f"> a <{OWL}Ontology>"), lines, F.lit(" .")).alias("text"))
    out = first.unionByName(subjects_text(q)).withColumn("graph_key", fn.file_name(F.col("graph_iri")))
    out.repartition("graph_key").sortWithinPartitions("graph_key", "rank", "s_id").select("graph_key", "text").write.mode("overwrite").partitionBy("graph_key").option("lineSep", "\n\n").text(path)


def trig_text(q: DataFrame) -> DataFrame:
    """graph_iri, text: a TriG block for each graph, in the order of graph IRIs."""
    s = subjects_text(q)
    body = s.groupBy("graph_iri").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "s_id", "text"))), lambda x: x["text"]), "\n\n").alias("body"))
    return body.select("graph_iri", F.concat(F.lit("GRAPH <"), F.col("graph_iri"), F.lit("> {\n"), F.col("body"), F.lit("\n}")).alias("text"))


def nquads_text(q: DataFrame) -> DataFrame:
    """One N-Quads line for each statement; lists must be chains."""
    s = F.when(F.col("s_kind") == "iri", F.concat(F.lit("<"), F.col("s_id"), F.lit(">"))).otherwise(F.concat(F.lit("_:"), F.col("s_id")))
    return q.select(F.concat(s, F.lit(" <"), F.col("p"), F.lit("> "), _term("o_kind", "o_id", "o_lex", "o_dt", "o_lang"), F.lit(" <"), F.col("graph_iri"), F.lit("> .")).alias("value"))


def inline_blanks(q: DataFrame) -> DataFrame:
    """Blank nodes that one statement refers to: they can be written in place, in brackets."""
    used = q.filter("o_kind = 'blank'").groupBy("graph_iri", F.col("o_id").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return used.filter("n = 1").select("graph_iri", "node")


def blank_numbers(q: DataFrame) -> DataFrame:
    """Running numbers of blank subjects in each graph."""
    w = Window.partitionBy("graph_iri").orderBy("s_id")
    return q.filter("s_kind = 'blank'").select("graph_iri", "s_id").distinct().withColumn("number", F.row_number().over(w))
