import os
import random

import pyarrow.parquet as pq
import pytest

from quadlake import _io
from quadlake.model import RDF_FIRST, RDF_REST
from quadlake.operators import closure, collections, mutation

EDGES = "a long, b long"


def brute(edges):
    out, found = {}, {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    for a in out:
        near, depth = out[a], 1
        while near:
            found |= {(a, b): depth for b in near}
            near = {c for b in near for c in out.get(b, ())} - {b for x, b in found if x == a}
            depth += 1
    return found


def got(df):
    rows = [tuple(r) for r in df.select("a", "b", "depth").collect()]
    assert len(rows) == len({r[:2] for r in rows})
    return {r[:2]: r[2] for r in rows}


@pytest.fixture
def written(spark):
    """Rows of the tables that were written since."""
    top = f"{_io.shared_dir(spark)}/quadlake".removeprefix("file:")
    before = set(os.listdir(top)) if os.path.isdir(top) else set()
    return lambda: sum(pq.read_table(f"{top}/{d}").num_rows for d in set(os.listdir(top)) - before)


def test_closure_of_chains_writes_no_pairs(spark, written):
    n = 700  # more than two blocks
    e = [(i, i + 1) for i in range(n)] + [(5000, 5001)]
    random.Random(1).shuffle(e)
    found = closure.closure(spark.createDataFrame(e, EDGES))
    assert written() < 10 * n
    assert got(found) == {(i, j): j - i for i in range(n) for j in range(i + 1, n + 1)} | {(5000, 5001): 1}


def test_closure_of_chains_beside_rings(spark):
    e = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 10), (20, 20), (30, 31)]
    assert got(closure.closure(spark.createDataFrame(e, EDGES).repartition(4))) == brute(e)


def test_closure_of_graphs_writes_each_pair_once(spark, written):
    r = random.Random(2)
    for k, e in enumerate(([(r.randrange(40), r.randrange(40)) for _ in range(70)], [(i, j) for i in range(60) for j in (i + 1, i + 2)])):
        e += e[:3]
        found = got(closure.closure(spark.createDataFrame(e, EDGES)))
        assert found == brute(e), k
    assert written() < 6000  # 1,829 pairs of the second


def test_closure_of_nulls_and_texts(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None)], "a string, b string")
    assert got(closure.closure(e)) == {("a", "b"): 1, ("b", "c"): 1, ("c", None): 1, ("a", "c"): 2, ("a", None): 3, ("b", None): 2}


def cells(rows, name, items, end="http://www.w3.org/1999/02/22-rdf-syntax-ns#nil"):
    for i, x in enumerate(items):
        rows.append((f"_:{name}{i}", RDF_FIRST, x))
        rows.append((f"_:{name}{i}", RDF_REST, f"_:{name}{i + 1}" if i + 1 < len(items) else end))


def folded(spark, rows, parts=1):
    q = mutation.statements(spark.createDataFrame(rows, "s string, p string, o string"), "g").repartition(parts)
    return sorted((r["s_id"], r["p"], r["o_id"], None if r["o_items"] is None else [m["id"] for m in r["o_items"]]) for r in collections.rebuild_lists(q).collect())


def test_lists_are_placed_without_joining_their_cells(spark, written):
    rows, want = [], []
    for k in range(40):
        cells(rows, f"l{k}_", [f"x{k}_{i}" for i in range(30)])
        rows.append((f"s{k}", "p", f"_:l{k}_0"))
        want.append((f"s{k}", "p", f"l{k}_0", [f"x{k}_{i}" for i in range(30)]))
    assert folded(spark, rows) == sorted(want)
    assert written() < 4 * 1200
    random.Random(3).shuffle(rows)
    assert folded(spark, rows, 5) == sorted(want)


def test_lists_with_common_cells_without_an_end_and_side_by_side(spark):
    rows = [("s", "p", "_:a0"), ("s", "p", "_:b0"), ("t", "p", "_:r0"), ("s", "p", "plain")]
    cells(rows, "a", ["1", "2"])
    cells(rows, "b", ["3"])
    ring = [("_:r0", RDF_FIRST, "4"), ("_:r0", RDF_REST, "_:r1"), ("_:r1", RDF_FIRST, "5"), ("_:r1", RDF_REST, "_:r0")]
    # Two lists of one subject and predicate stay two; those of a ring stay as they are.
    want = [("s", "p", "a0", ["1", "2"]), ("s", "p", "b0", ["3"]), ("s", "p", "plain", None), ("t", "p", "r0", None)]
    left = [(s[2:], p, o.removeprefix("_:"), None) for s, p, o in ring]
    assert folded(spark, rows + ring) == sorted(want + left)
    # c0 leads into a's second cell, d ends in a cell without a link.
    more = [("u", "p", "_:c0"), ("_:c0", RDF_FIRST, "6"), ("_:c0", RDF_REST, "_:a1"), ("v", "p", "_:d0"), ("_:d1", RDF_FIRST, "8")]
    cells(more, "d", ["7"], "_:d1")
    tail = [("v", "p", "d0", ["7", "8"]), ("d1", RDF_FIRST, "8", None)]
    assert folded(spark, rows + more[3:]) == sorted([x for x in want if x[0] == "s"] + tail + [("t", "p", "r0", None)])
    assert folded(spark, rows + ring + more) == sorted(want + left + tail + [("u", "p", "c0", ["6", "2"])])
