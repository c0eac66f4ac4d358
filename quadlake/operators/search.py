"""Search documents derived from graphs, and queries on them as columns.

A search table has a column fields, a map from field names to arrays of tokens, beside any stored columns.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.functions.iri import fragment, graph_id, natural_sort_key, phrase, separated
from quadlake.model import RDF_TYPE, RDFS

ANALYZERS = {
    "standard": lambda c: F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda x: x != ""),
    "phrase": lambda c: F.array(phrase(c)),
    "separated": lambda c: F.array(separated(c)),
    "keyword": lambda c: F.array(c),
}


def derive(q: DataFrame, imports: DataFrame, slots: list[list[str]]) -> DataFrame:
    """One search document for each graph: main_type, graph_id, graph_iri, direct_import, node_count, literal, label, id, id_sort.

    slots: lists of main types by fragment, the more important first; the types of a slot that nodes of the graph have give its value:
    none, the type of the one node, or "-" for several nodes. The first slot with a value counts; "-" without any.
    """
    def slot(kinds: list[str]) -> Column:
        hit = (F.col("p") == RDF_TYPE) & fragment(F.col("o_id")).isin(*kinds)
        n = F.count(F.when(hit, 1))
        return F.when(n == 1, F.max(F.when(hit, fragment(F.col("o_id"))))).when(n > 1, "-")

    label = F.col("p") == f"{RDFS}label"
    ident = fragment(F.col("p")) == "id"
    rows = q.groupBy("graph_iri").agg(
        F.coalesce(*[slot(k) for k in slots], F.lit("-")).alias("main_type"),
        F.countDistinct("s_id").alias("node_count"),
        F.sort_array(F.collect_set(F.when(F.col("o_lex") != "", F.col("o_lex")))).alias("literal"),
        F.sort_array(F.collect_set(F.when(label, F.col("o_lex")))).alias("label"),
        F.sort_array(F.collect_set(F.when(ident, F.col("o_lex")))).alias("id"),
    )
    direct = imports.groupBy("graph_iri").agg(F.sort_array(F.collect_set(graph_id(F.col("imported_iri")))).alias("direct_import"))
    out = rows.join(direct, "graph_iri", "left").withColumn("direct_import", F.coalesce("direct_import", F.array().cast("array<string>")))
    known = F.col("main_type") != "-"
    none = F.array().cast("array<string>")
    return out.select(graph_id(F.col("graph_iri")).alias("graph_id"), "graph_iri", "main_type", "node_count", "direct_import", "literal", F.when(known, F.col("label")).otherwise(none).alias("label"), F.when(known, F.col("id")).otherwise(none).alias("id"), F.when(known, natural_sort_key(F.get("id", F.lit(0)))).alias("id_sort"))


def index(df: DataFrame, fields: dict[str, tuple[Column, str]]) -> DataFrame:
    """Adds the column fields: for each field name the tokens of a text or of an array of texts under an analyzer."""
    def tokens(c: Column, analyzer: str) -> Column:
        return F.array_distinct(F.flatten(F.transform(F.coalesce(c, F.array().cast("array<string>")), ANALYZERS[analyzer])))

    return df.withColumn("fields", F.create_map(*[x for name, (c, a) in fields.items() for x in (F.lit(name), tokens(c, a))]))


def field(name: str) -> Column:
    return F.coalesce(F.col("fields")[name], F.array().cast("array<string>"))


def match_all() -> Column:
    return F.lit(True)


def match(name: str, text: str) -> Column:
    """Any of the words of the text, or the text as one token."""
    return F.arrays_overlap(field(name), F.array(*map(F.lit, [*re.findall(r"\w+", text.lower()), text.lower()])))


def term(name: str, token: str) -> Column:
    return F.array_contains(field(name), token)


def every(*queries: Column) -> Column:
    out = F.lit(True)
    for q in queries:
        out = out & q
    return out


def some(*queries: Column) -> Column:
    out = F.lit(False)
    for q in queries:
        out = out | q
    return out


def regexp(name: str, pattern: str) -> Column:
    """A token that fits the pattern as a whole."""
    return F.exists(field(name), lambda x: x.rlike(f"^(?:{pattern})$"))


def prefix(name: str, start: str) -> Column:
    return F.exists(field(name), lambda x: x.startswith(start))


PART = re.compile(r'\s*([+-]?)(?:([\w.]+):)?(?:"([^"]*)"|/((?:[^/\\]|\\.)*)/|(\S+))')


def parse(text: str, default: str) -> Column:
    """A query string: words, field:word, "phrases" (all words), /patterns/, word* for a prefix; + must, - must not, others may match
    (one of them has to, if there is no must)."""
    must, may, no = [], [], []
    for sign, name, quoted, pattern, word in PART.findall(text):
        name = name or default
        if quoted:
            q = every(*[term(name, w) for w in re.findall(r"\w+", quoted.lower())])
        elif pattern:
            q = regexp(name, pattern)
        elif word == "*":
            q = match_all()
        elif word.endswith("*"):
            q = prefix(name, word[:-1].lower())
        else:
            q = match(name, word)
        {"+": must, "-": no}.get(sign, may).append(q)
    found = every(*must) if must else some(*may) if may else match_all()
    return found & ~some(*no)


def search(df: DataFrame, query: Column, *, size: int = 10, start: int = 0, sort: list[str] | None = None, key: str = "graph_id") -> DataFrame:
    """A page of the documents that match; sort names columns, with - for descending order, and ends with the key."""
    order = [F.desc(s[1:]) if s.startswith("-") else F.asc(s) for s in sort or []]
    return df.filter(query).orderBy(*order, key).offset(start).limit(size)


def score(name: str, words: list[str], df: DataFrame) -> DataFrame:
    """Adds score, the sum of inverse document frequencies of the words that a document has."""
    n = df.count()
    hits = [F.count(F.when(term(name, w), 1)).alias(f"w{i}") for i, w in enumerate(words)]
    found = df.agg(*hits).first()
    return df.withColumn("score", sum((F.when(term(name, w), F.lit(1.0 + _log(n / (1 + found[i])))).otherwise(0.0) for i, w in enumerate(words)), F.lit(0.0)))


def _log(x: float) -> float:
    import math

    return math.log(max(x, 1.0))


def field_names(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.map_keys("fields")).alias("field")).distinct()
