"""Literal types: what a lexical form becomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
LANG_STRING = f"{RDF}langString"
#: The datatypes a literal can have; on reading, those of the second line become xsd:integer, decimal becomes double.
KEPT = ("string", "boolean", "short", "integer", "float", "double", "dateTime", "dateTimeStamp")
TO_INTEGER = ("byte", "int", "long", "unsignedByte", "unsignedShort", "unsignedInt", "unsignedLong")


def read_type(datatype: Column) -> Column:
    """The datatype a literal has after reading; null for an unsupported one."""
    out = F.when(datatype == f"{XSD}decimal", f"{XSD}double").when(datatype == LANG_STRING, LANG_STRING)
    for names, to in ((KEPT, None), (TO_INTEGER, "integer")):
        for n in names:
            out = out.when(datatype == f"{XSD}{n}", f"{XSD}{to or n}")
    return out


def as_number(lex: Column, datatype: Column) -> Column:
    """The value of a numeric literal as a double; null for others."""
    numeric = datatype.isin(*[f"{XSD}{n}" for n in ("short", "integer", "float", "double", "decimal", *TO_INTEGER)])
    return F.when(numeric, lex.try_cast("double"))


def valid(lex: Column, datatype: Column) -> Column:
    """The lexical form fits its datatype."""
    spark_type = {"boolean": "boolean", "byte": "tinyint", "short": "smallint", "int": "int", "long": "bigint", "integer": "bigint", "float": "float", "double": "double", "decimal": "double", "unsignedByte": "smallint", "unsignedShort": "int", "unsignedInt": "bigint", "unsignedLong": "decimal(20,0)"}
    out = F.when(datatype.isin(f"{XSD}string", LANG_STRING), F.lit(True))
    for n, t in spark_type.items():
        ok = lex.try_cast(t).isNotNull()
        if n.startswith("unsigned"):
            ok = ok & (lex.try_cast("decimal(20,0)") >= 0)
        out = out.when(datatype == f"{XSD}{n}", ok)
    return F.coalesce(out, F.lit(False))
