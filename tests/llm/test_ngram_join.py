import random

import numpy as np
import pyarrow as pa
import pytest

from quadlake.llm import ngram_join
from quadlake.llm._components import components


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def family(rng, n, copies, edits, start):
    vocabulary = [f"v{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(n)]
    out = []
    for k in range(copies):
        t = list(base)
        for _ in range(rng.randint(0, edits)):
            t[rng.randrange(n)] = rng.choice(vocabulary)
        out.append((start + k, " ".join(t)))
    return out


def corpus(rng):
    rows = []
    for n, copies, edits in ((60, 40, 4), (120, 25, 8), (200, 30, 14), (30, 20, 2), (8, 10, 1), (3, 6, 1)):
        rows += family(rng, n, copies, edits, len(rows))
    passage = " ".join(f"p{i}" for i in range(30))
    rows += [(len(rows) + k, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(25))) for k in range(30)]
    return rows


def run(spark, rows, **options):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(d, **options).collect()}


def test_against_brute_force(spark):
    rows = corpus(random.Random(7)) + [(9000, None), (9001, ""), (9002, " \t"), (9003, "one"), (9004, "ONE"), (9005, "é É"), (9006, "é é")]
    assert run(spark, rows) == brute(rows)


def test_large_blocks_in_chunks(spark, monkeypatch):
    """Chunks of a few documents, few members in common: the second round has to find what is missing."""
    monkeypatch.setattr(ngram_join, "CHUNK_WEIGHT", 600)
    monkeypatch.setattr(ngram_join, "HUBS", 1)
    rows = corpus(random.Random(8))
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows_a_chunk", [512, 6])
def test_loose_blocks_meet_by_shingle(spark, monkeypatch, rows_a_chunk):
    """All members of large blocks outside the largest component meet under their shingles, in chunks if these are hot."""
    for name, value in {"CHUNK_WEIGHT": 600, "CHUNK_ROWS": rows_a_chunk, "HUBS": 1, "MOST_PARTS": 0, "ASKED": 1}.items():
        monkeypatch.setattr(ngram_join, name, value)
    rows = corpus(random.Random(12))
    assert run(spark, rows) == brute(rows)


def test_repeated_ids(spark):
    rng = random.Random(13)
    text = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    a, b, c = text(60), text(60), text(30)
    rows = [(5, a), (5, b), (8, a + " x"), (9, b + " y"), (2, c), (2, a + " z"), (7, c), (7, c), (4, ""), (4, None)]
    got = sorted((r["doc_id"], r["component_id"]) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(5, 2), (5, 5), (8, 2), (9, 5), (2, 2), (2, 2), (7, 2), (7, 2), (4, 4), (4, 4)])


def test_very_long_texts(spark):
    rng = random.Random(14)
    long = [f"l{rng.randrange(10**5)}" for _ in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[100:])), (3, " ".join(long[:20_000])), (4, "x " * 400_000), (5, "x " * 9)]
    assert run(spark, rows) == {1: (59_996, 1), 2: (59_896, 1), 3: (19_996, 3), 4: (1, 4), 5: (1, 4)}


def test_coarse_order_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SLOTS", 12)
    monkeypatch.setattr(ngram_join, "FREQUENT", 3)
    rows = corpus(random.Random(9))
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    assert run(spark, []) == {}
    d = spark.createDataFrame([(5, "a b c", "x"), (5, "a b c", "x"), (None, "a b c", "x"), (7, "A B C", "x")], "doc_id long, text string, Component_ID string")
    got = sorted((str(r["doc_id"]), r["component_id"]) for r in ngram_join.near_duplicates(d).collect())
    assert got == [("5", 5), ("5", 5), ("7", 5), ("None", None)]


@pytest.mark.parametrize("seed", range(5))
def test_tree_bounds_never_lose_a_link(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**63, rng.integers(3, 400), dtype=np.uint64)
        for _ in range(3):
            keep = base[rng.random(len(base)) > 0.08]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(0, 8), dtype=np.uint64)])))
    sets = [s for s in sets if len(s)]
    tree = ngram_join.CountTree(sets, list(range(len(sets))), 0.75)
    for q in range(len(sets)):
        found = set(tree.search(q).tolist())
        assert {x for x in range(len(sets)) if tree.linked(q, x, 75)} <= found


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 900), (900, 7), (3, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {5: 5, 7: 5, 900: 5}


def test_few_texts_meet_where_the_slots_fill_up(spark, monkeypatch):
    """A third of each text is also in one other: with a quarter of the slots taken, texts still meet by their other shingles alone."""
    rng = random.Random(23)
    unique = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for _ in range(150):
        passage = unique(24)
        rows += [(len(rows) + k, " ".join(unique(20) + passage + unique(20))) for k in range(2)]
    met = []
    monkeypatch.setattr(ngram_join, "components", lambda edges: (met.append(edges.count()), components(edges))[1])
    monkeypatch.setattr(ngram_join, "SLOTS", 13)
    assert run(spark, rows) == {i: (len(shingles(t)), i) for i, t in rows}
    assert met[0] <= 15


def test_marked_level():
    """Of the shingles that come first, as few as possible are repeated; only where too few stay unmarked, the rarest repeated ones are not marked."""
    each = [90_000, 10_000, 900, *[0] * 61]
    assert [ngram_join.least_level(each, slots, 0.25) for slots in (1 << 20, 1 << 16, 1 << 15, 1 << 11)] == [1, 1, 1, 2]
    assert ngram_join.least_level([0] * 64, 1 << 12, 0.25) == 1


@pytest.mark.parametrize("rows_a_chunk", [512, 6])
def test_members_outside_the_largest_component_are_searched_under_hot_shingles(spark, monkeypatch, rows_a_chunk):
    """Of the holders of a hot shingle nearly all are connected already: the others are searched in its chunks, and no link is lost."""
    for name, value in {"CHUNK_WEIGHT": 600, "CHUNK_ROWS": rows_a_chunk, "HUBS": 1, "MOST_PARTS": 0}.items():
        monkeypatch.setattr(ngram_join, name, value)
    searched, stash = [], ngram_join.stash
    monkeypatch.setattr(ngram_join, "stash", lambda df, name: (out := stash(df, name), name == "majors" and searched.append(out.count()))[0])
    rows = corpus(random.Random(15))
    assert run(spark, rows) == brute(rows)
    assert sum(searched) > 0


def test_only_texts_of_members_are_shuffled(spark, monkeypatch):
    """A plan over BROADCAST_ROWS is joined by shuffle, but not with all texts of the table."""
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    rng = random.Random(16)
    rows = [(i, " ".join(f"{rng.randrange(16**40):x}" for _ in range(200))) for i in range(400)]
    rows += [(1000, rows[7][1] + " x"), (None, rows[9][1])]
    node = {i: ngram_join.digest(ngram_join.shingle_sets(pa.array([t]), 5)[0])[0] for i, t in rows}
    plan = [(1, i, node[i], "both", node[i]) for i in (7, 8, 1000)]
    texts = spark.createDataFrame(rows, "id long, text string").repartition(4).localCheckpoint()
    sc = spark.sparkContext

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before, small = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ngram_join._search(texts, spark.createDataFrame(plan, "key long, rep long, node long, role string, known long"), 5, 0.75).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert [{r["a"], r["b"]} for r in found] == [{node[7], node[1000]}]
    assert written() - before < sum(len(t) for _, t in rows) / 10
