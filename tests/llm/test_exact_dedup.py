import hashlib

from pyspark.sql import functions as F

from quadlake.llm.exact_dedup import exact_dedup


def rows(df):
    return {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()}


def test_groups_and_edges(docs):
    long = "ab " * 100_000
    d = docs([(1, "Aé", None, None), (2, "aé", "x", "y"), (3, "aÉ", None, None), (4, None, None, None), (5, "", None, None), (6, long, None, None), (7, long.upper(), None, None)], ", keep_id string, H string".replace(", keep_id string, H string", ""))
    got = rows(exact_dedup(d, keep="max"))
    h = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (2, 2, False, h("aé")), 2: (2, 2, True, h("aé")), 3: (3, 1, True, h("aÉ")), 4: (5, 2, False, h("")), 5: (5, 2, True, h("")), 6: (7, 2, False, h(long)), 7: (7, 2, True, h(long))}
    assert rows(exact_dedup(d))[2][0] == 1


def test_colliding_hashes_are_told_apart(docs):
    d = docs([(i, f"text {i % 3}", None, None) for i in range(9)])
    got = rows(exact_dedup(d, hash_of=lambda t: F.lit(b"same")))
    assert {k: v[0] for k, v in got.items()} == {i: i % 3 for i in range(9)} and all(v[1] == 3 for v in got.values())


def test_repeated_ids_clashing_columns_and_empty(spark, docs):
    d = docs([(1, "a", "l", "s"), (1, "a", "l", "s"), (None, "a", "l", "s")]).withColumnsRenamed({"lang": "keep_id", "source": "h"})
    out = exact_dedup(d).collect()
    assert [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in sorted(out, key=lambda r: r["doc_id"] or 0)] == [(None, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]
    assert exact_dedup(docs([])).count() == 0


def test_only_native_operations(docs):
    plan = exact_dedup(docs([(1, "a", None, None)]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
