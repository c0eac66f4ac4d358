"""Direct mapping of relational tables to quads.

graph = urn:x-table:<table>, subject = graph#<key>, predicate = graph/<column>; a foreign key is a reference, any other
column a literal. Only the columns asked for are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.functions.literals import XSD
from quadlake.model import QUADS

#: Key columns of each table; lineitem has none that is unique, so its subjects hash the whole row.
KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "events": ["event_id"], "lineitem": None}
REFERENCES = {"n_regionkey": "region", "c_nationkey": "nation", "s_nationkey": "nation", "o_custkey": "customer", "l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}
IMPORTS = [("lineitem", "orders"), ("lineitem", "part"), ("lineitem", "supplier"), ("orders", "customer"), ("customer", "nation"), ("supplier", "nation"), ("nation", "region")]
TYPES = {"string": "string", "int": "integer", "bigint": "integer", "double": "double", "timestamp": "dateTime", "timestamp_ntz": "dateTime", "boolean": "boolean"}


def iri(table: str) -> str:
    return f"urn:x-table:{table}"


def subject(table: str, df: DataFrame) -> Column:
    keys = KEYS[table]
    if keys is None:
        return F.concat(F.lit(f"{iri(table)}#"), F.md5(F.concat_ws("|", *[F.hash(F.col(c)).cast("string") for c in df.columns], *[F.col(c).cast("string") for c in df.columns])))
    return F.concat_ws("#", F.lit(iri(table)), *[F.col(k).cast("string") for k in keys])


def lexical(column: Column, kind: str) -> Column:
    """The literal's text; doubles have four decimals."""
    if kind == "double":
        return column.cast("decimal(38,4)").cast("string")
    if kind.startswith("timestamp"):
        return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
    return column.cast("string")


def table_quads(spark: SparkSession, sf_dir: str, table: str, columns: list[str] | None = None) -> DataFrame:
    """The table as quads; a null makes no statement."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    kinds = dict(df.dtypes)
    wanted = [c for c in (columns or df.columns) if c not in (KEYS[table] or []) or c in REFERENCES]
    text = F.lit(None).cast("string")

    def statement(c: str) -> Column:
        if c in REFERENCES:
            target = F.concat(F.lit(f"{iri(REFERENCES[c])}#"), F.col(c).cast("string"))
            parts = (F.lit("iri"), target, text, text, F.lit(None).cast("double"))
        else:
            number = F.col(c).cast("double") if kinds[c] in ("int", "bigint", "double") else F.lit(None).cast("double")
            parts = (F.lit("literal"), text, lexical(F.col(c), kinds[c]), F.lit(f"{XSD}{TYPES[kinds[c]]}"), number)
        return F.when(F.col(c).isNotNull(), F.struct(F.lit(f"{iri(table)}/{c}").alias("p"), *[x.alias(n) for x, n in zip(parts, ("o_kind", "o_id", "o_lex", "o_dt", "o_num"), strict=True)]))

    rows = df.select(subject(table, df).alias("s_id"), F.explode(F.array_compact(F.array(*map(statement, wanted)))).alias("t"))
    return rows.select(
        F.lit(iri(table)).alias("graph_iri"), F.lit("iri").alias("s_kind"), "s_id", "t.p", "t.o_kind", "t.o_id", "t.o_lex", "t.o_dt",
        text.alias("o_lang"), "t.o_num", F.lit(None).cast(QUADS["o_items"].dataType).alias("o_items"),
    )


def tables_quads(spark: SparkSession, sf_dir: str, tables: list[str]) -> DataFrame:
    out = table_quads(spark, sf_dir, tables[0])
    for t in tables[1:]:
        out = out.unionByName(table_quads(spark, sf_dir, t))
    return out


def table_imports(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(iri(a), iri(b)) for a, b in IMPORTS], "graph_iri string, imported_iri string")
