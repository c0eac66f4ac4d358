import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from quadlake.functions import hashes, iri, literals


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("name", ["http://example.com/a", "http://example.com/é", "urn:x"])
def test_uuid5(spark, name):
    assert one(spark, iri.uuid5_url(F.col("v")), v=name) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_graph_id(spark):
    own = "c0ffee00-0000-4000-8000-000000000001"
    assert one(spark, iri.graph_id(F.col("v")), v=f"urn:uuid:{own}") == own
    assert one(spark, iri.graph_id(F.col("v")), v="http://x/g#") == str(uuid.uuid5(uuid.NAMESPACE_URL, "http://x/g"))


def test_split(spark):
    assert one(spark, iri.base(F.col("v")), v="http://x/a#b#c") == "http://x/a#b"
    assert one(spark, iri.fragment(F.col("v")), v="http://x/a#b#c") == "c"
    assert one(spark, iri.fragment(F.col("v")), v="http://x/a") == ""
    assert tuple(one(spark, iri.split_slash(F.col("v")), v="http://x/a#b")) == ("http://x/a#", "b")


def test_natural_sort_key(spark):
    assert one(spark, iri.natural_sort_key(F.col("v")), v="A7-12b") == "A0000000007-0000000012b"
    assert one(spark, iri.natural_sort_key(F.col("v")), v="A12345678901") == "A12345678901"


def test_analyzers_and_names(spark):
    assert one(spark, iri.separated(F.col("v")), v=" -Big_Ring/A b_") == "big-ring-a-b"
    name = one(spark, iri.file_name(F.col("v")), v="http://x/ä?")
    assert one(spark, iri.from_file_name(F.col("v")), v=name) == "http://x/ä?"
    assert one(spark, iri.floats(F.col("v")), v="1 2.5 -3") == [1.0, 2.5, -3.0]
    assert one(spark, iri.floats(F.col("v")), v="1 2 3 4") is None
    assert one(spark, iri.language_tag_ok(F.col("v")), v="en-US") and not one(spark, iri.language_tag_ok(F.col("v")), v="en-US-x")
    assert one(spark, iri.iri_ok(F.col("v")), v="urn:isbn:1") and not one(spark, iri.iri_ok(F.col("v")), v="no scheme")
    assert one(spark, iri.suggestion(F.col("v"), ["commit", "com", "diff"]), v="comm") == "com"
    assert one(spark, iri.mime_type(F.col("v")), v="a.ttl") == "text/turtle"
    assert one(spark, iri.prefixed(F.col("v"), {"ex": "http://x#"}), v="http://x#a") == "ex:a"
    assert one(spark, iri.escape_literal(F.col("v")), v='a"b\n\\') == 'a\\"b\\n\\\\'


def test_base58(spark):
    h = hashlib.sha256(b"x").hexdigest()
    text = one(spark, hashes.base58(F.col("v")), v=h)
    assert len(text) == 44 and one(spark, hashes.from_base58(F.col("v")), v=text) == h
    assert one(spark, hashes.from_base58(F.col("v")), v="0" * 44) is None
    assert hashes.encode58(b"\0" * 32) == "1" * 44 and hashes.NIL == hashlib.sha256(b"").hexdigest()


def test_times(spark):
    parse = lambda v: one(spark, iri.rfc3339(iri.parse_time(F.col("v"))), v=v)
    assert parse("2024-01-02T03:04:05+01:00") == "2024-01-02T02:04:05Z"
    assert parse("2024-01-02T03:04:05") == "2024-01-02T03:04:05Z"


@pytest.mark.parametrize(("lex", "dt", "ok"), [("18446744073709551615", "unsignedLong", True), ("-1", "unsignedByte", False), ("300", "byte", False), ("NaN", "double", True), ("2024-01-01", "date", False)])
def test_literals(spark, lex, dt, ok):
    assert one(spark, literals.valid(F.col("v"), F.lit(f"{literals.XSD}{dt}")), v=lex) is ok
