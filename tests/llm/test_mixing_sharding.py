import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from quadlake.llm import mixing, sharding


def brute_shards(rows, shards, seed=17):
    key = lambda i: hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    by = defaultdict(list)
    for i, source in rows:
        by["~" if source is None else f"s{source}"].append((key(i), i))
    placed = []
    for s, own in by.items():
        for r, (k, i) in enumerate(sorted(own), 1):
            placed.append(((2 * r - 1) / (2 * len(own)), s, k, i))
    n = len(placed)
    out = {}
    for p, (_, _, _, i) in enumerate(sorted(placed)):
        shard = p * shards // n
        out[i] = (shard, p - -(-shard * n // shards))
    return out


@pytest.mark.parametrize("n", [1, 23, 24, 500, 3000])
def test_shards_match_the_mixture(docs, n):
    rows = [(i, f"t{i % 7}", None, None if i % 11 == 0 else f"s{i % 3 if i % 2 else 0}") for i in range(n)]
    got = sharding.shard_documents(docs(rows)).collect()
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got} == brute_shards([(r[0], r[3]) for r in rows], 24)
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == n and max(sizes.values()) - min(sizes.get(s, 0) for s in range(24)) <= 1
    for s, c in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(c))
    if n == 3000:  # each source has its share in each shard
        for source in {r["source"] for r in got}:
            each = Counter(r["shard"] for r in got if r["source"] == source)
            assert max(each.values()) - min(each.get(s, 0) for s in range(24)) <= 2


def test_shard_digest_and_edges(docs):
    d = docs([(1, "né", None, "a"), (1, "né", None, "a"), (None, None, None, None)])
    got = sorted(((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in sharding.shard_documents(d).collect()), key=str)
    assert got == [(1, 11, zlib.crc32("né".encode()), "rows", None)] * 2 + [(None, 8, 0, "rows", None)]
    assert sharding.shard_documents(docs([])).count() == 0
    clash = sharding.interleave(d.withColumnRenamed("text", "Shard"), shards=2)
    assert sorted(c.lower() for c in clash.columns) == ["doc_id", "lang", "shard", "slot", "source"]


def brute_targets(sizes, share, most):
    """Water-filling as told: clamp, deal the rest out again by weight, until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        level = (budget - sum(fixed.values())) / sum(weights[s] for s in free) if free else 0
        over = [s for s in free if level * weights[s] >= most * sizes[s]]
        if not over:
            return fixed | {s: level * weights[s] for s in free}
        fixed |= {s: most * sizes[s] for s in over}


def test_mix_meets_its_targets(docs):
    rows = [(i, "w " * (1 + i * 7 % 40), None, ["a", "b", "c", "é", None, "big"][min(i % 9, 5)]) for i in range(4000)]
    out = mixing.mix(docs(rows), mixing.weights_313).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    want = brute_targets(sizes, 1.5, 2)
    taken = Counter()
    for r in out:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]] and 0 <= r["repeats"] <= 2
        taken[r["source"]] += r["size"] * r["repeats"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 40
    again = mixing.mix(docs(rows[::-1]), mixing.weights_313)
    assert {r["doc_id"]: r["repeats"] for r in again.collect()} == {r["doc_id"]: r["repeats"] for r in out}
    assert mixing.repeat(again).count() == sum(r["repeats"] for r in out)


def test_mix_edges(docs):
    assert mixing.mix(docs([]), mixing.weights_313).count() == 0
    got = mixing.mix(docs([(1, None, None, None), (2, "", None, "a"), (3, " x \t\x0by", None, "b"), (3, " x \t\x0by", None, "b"), (None, "z", None, "b")]), mixing.weights_313).collect()
    assert sorted((r["size"], r["repeats"] <= 2) for r in got) == [(0, True), (0, True), (1, True), (2, True), (2, True)]
    assert all(r["target"] == 0 and r["repeats"] == 0 for r in got if r["source_size"] == 0)
    clash = mixing.mix(docs([(1, "a b", "l", "s")]).withColumnRenamed("lang", "TARGET"), mixing.weights_313)
    assert sorted(c.lower() for c in clash.columns) == sorted(["doc_id", "text", "source", "size", "source_size", "target", "repeats"])
