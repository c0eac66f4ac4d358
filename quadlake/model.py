"""The quad table, which every operator takes and returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadlake._io import spread

ITEM = T.StructType([T.StructField("pos", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("kind", "id", "lex", "dt", "lang")]])
QUADS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("graph_iri", "s_kind", "s_id", "p", "o_kind", "o_id", "o_lex", "o_dt", "o_lang")]
    + [T.StructField("o_num", T.DoubleType()), T.StructField("o_items", T.ArrayType(ITEM))]
)
COLUMNS = QUADS.fieldNames()
#: What makes two statements of a graph the same.
TRIPLE = ["graph_iri", "s_kind", "s_id", "p", "o_kind", "o_id", "o_lex", "o_dt", "o_lang", "o_items"]

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDF_FIRST, RDF_REST, RDF_NIL = (f"http://www.w3.org/1999/02/22-rdf-syntax-ns#{n}" for n in ("first", "rest", "nil"))
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], QUADS)


def object_key(prefix: str = "") -> Column:
    """One string for an object of any kind: equal for equal terms, different for different ones."""
    c = lambda n: F.coalesce(F.col(f"{prefix}{n}"), F.lit("\x00"))
    items = F.coalesce(F.to_json(F.col(f"{prefix}o_items")), F.lit("\x00"))
    return F.concat_ws("\x1f", c("o_kind"), c("o_id"), c("o_lex"), c("o_dt"), c("o_lang"), items)


def as_set(q: DataFrame) -> DataFrame:
    """A graph is a set of statements. They are dealt out first: combining them before finds little and holds all of a task in memory."""
    return spread(q, *TRIPLE).dropDuplicates(TRIPLE)


def graph(q: DataFrame, iri: str) -> DataFrame:
    return q.filter(F.col("graph_iri") == iri)
