import itertools
import math
import random
from fractions import Fraction

import pyarrow as pa
import pytest

from quadlake.llm import decontam
from quadlake.llm._filter import Filter
from quadlake.llm._tokens import words


def prose(rng, vocabulary, n):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def leaks(spark, texts, items, **options):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = decontam.find_leaks(d, b, **options).collect()
    assert len(rows) == len(texts)
    return {r["doc_id"]: {x["item"]: (x["matched"], x["at"]) for x in r["leaks"]} for r in rows}


LOWER = {c: c + 32 for c in range(65, 91)}


def split(text):
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "").translate(LOWER)).split()


def brute(text, item, min_matched=12, identity=Fraction(3, 4)):
    """The most equal words and their first place, by the docstring, or None."""
    a, b = split(text), split(item)
    if len(b) < 5:
        return (len(b), 0) if a == b and b else None
    best = (0, 0)
    for shift in range(-len(b) + 1, len(a)):
        same = [0 <= shift + i < len(a) and a[shift + i] == b[i] for i in range(len(b))]
        if sum(same) <= max(3, -(-len(b) // 5)):  # too few for any leak
            continue
        for i, j in itertools.combinations(range(len(b) + 1), 2):
            if same[i] and same[j - 1] and sum(same[i:j]) >= identity * (j - i):
                best = max(best, (sum(same[i:j]), -(shift + i)))
    return (best[0], -best[1]) if best[0] >= min(min_matched, math.ceil(identity * len(b))) else None


@pytest.mark.parametrize("least", sorted(decontam.MASKS))
def test_masks_hit_all_patterns(least):
    """A run with a quarter of its words replaced, or less, has a mask's words all equal. From `first` words on, runs fall into two that
    have as good a share, so lengths below twice that are all."""
    masks = [[i for i, c in enumerate(m) if c == "1"] for m in decontam.MASKS[least]]
    first = math.ceil(Fraction(least) / decontam.LEAST_IDENTITY)
    for n in range(first, 2 * first):
        for wrong in itertools.combinations(range(n), n // 4):
            assert any(not any(at + i in wrong for i in m) for m in masks for at in range(n - m[-1])), (n, wrong)
    for n in range(least, first):  # shorter runs with as many equal words
        for wrong in itertools.combinations(range(n), n - least):
            if least >= decontam.LEAST_IDENTITY * n:
                assert any(not any(at + i in wrong for i in m) for m in masks for at in range(n - m[-1])), (n, wrong)


def test_masks_for_lengths():
    assert [decontam.needed(n, 12) for n in (1, 4, 5, 8, 11, 12, 15, 16, 400)] == [1, 4, 4, 6, 9, 9, 12, 12, 12]
    assert [m for m, _ in decontam.masks_for(9)] == list(decontam.MASKS[9]) and decontam.masks_for(3) == []


@pytest.mark.parametrize("seed", range(2))
def test_leaks_are_those_of_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "ño"]
    items = [prose(rng, vocabulary, n) for n in [*range(1, 24), *range(24, 64, 5)] for _ in range(2)]
    items += [None, "", "  ...", items[9]]
    texts = [None, "", prose(rng, vocabulary, 300), items[0], items[6], items[6] + " x", "x " + items[3]]
    for item in items[8:62]:
        t = item.split()
        for share in (0, 0.1, 0.2, 0.25, 0.3):
            wrong = set(rng.sample(range(len(t)), int(share * len(t))))
            # A word replaced, with the ends kept or cut.
            u = [rng.choice(vocabulary) if i in wrong else x.upper() for i, x in enumerate(t)][rng.choice([0, 0, 1]) :]
            texts.append(f"{prose(rng, vocabulary, rng.randrange(12))}, {' '.join(u)}! {prose(rng, vocabulary, rng.randrange(12))}")
    got = leaks(spark, texts, items)
    want = {k: {i: r for i, x in enumerate(items) if (r := brute(t, x))} for k, t in enumerate(texts)}
    assert got == want and sum(map(len, want.values())) > 150


def test_spread_substitutions_are_found(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    masks = ["1" * 11 + "0111", "1" * 5 + "0" + "1" * 5 + "011101100", "1110" * 4, "110" * 3 + "1" * 6, "0111" * 5 + "0" * 9, "1101" * 6, "1" * 12 + "0" * 5 + "1" * 3]
    items = [prose(rng, vocabulary, len(m)) for m in masks]
    texts = [f"{prose(rng, vocabulary, 9)} {' '.join(x if int(c) else 'zzz' for x, c in zip(t.split(), m, strict=True))} {prose(rng, vocabulary, 9)}" for t, m in zip(items, masks, strict=True)]
    got = leaks(spark, texts, items)
    assert got == {k: {k: r} if (r := brute(t, items[k])) else {} for k, t in enumerate(texts)}
    assert all(k in got[k] for k in range(7))


def test_long_texts_and_long_items(spark):
    """Hits far apart in one text fall into pieces; a leak over a piece's border is found; long items leak by a part."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(5000)]
    items = [prose(rng, vocabulary, 15), prose(rng, vocabulary, 20), prose(rng, vocabulary, 900)]
    long = prose(rng, vocabulary, 20_000).split()
    places = [*range(240, 262), 5000, 19_980]
    for p in places[-2:]:
        long[p : p + 15] = items[0].split()
    texts = [" ".join(long), " ".join(items[2].split()[500:540]), "a " * 200_000]
    for p in places[:-2]:
        texts.append(" ".join([*long[:p], *items[1].split(), *long[p:600]]))
    got = leaks(spark, texts, items)
    assert got[0] == {0: (15, 5000)} and got[1] == {2: (40, 0)} and got[2] == {}
    assert [got[3 + i] for i in range(len(places) - 2)] == [{1: (20, p)} for p in places[:-2]]


def test_repeated_words_rows_and_items(spark):
    assert leaks(spark, ["a " * 300, "a " * 11], ["a " * 40]) == {0: {0: (40, 0)}, 1: {}}
    items = [" ".join(f"i{k}x{j}" for j in range(15)) for k in range(3)]
    texts = [items[2] + " " + items[0], "x", items[1], items[1], None]
    assert leaks(spark, texts, [*items, None]) == {0: {0: (15, 15), 2: (15, 0)}, 1: {}, 2: {1: (15, 0)}, 3: {1: (15, 0)}, 4: {}}


def test_empty_tables_and_clashing_names(spark):
    assert leaks(spark, ["x"], []) == {0: {}} and leaks(spark, [], ["x y z"]) == {}
    d = spark.createDataFrame([(1, "a", "b", 2)], "doc_id long, text string, Leaks string, item long")
    none = spark.createDataFrame([], "item_id long, text string, key string")
    assert [c.lower() for c in decontam.find_leaks(d, none).columns] == ["doc_id", "text", "item", "leaks"]
    with pytest.raises(ValueError):
        decontam.find_leaks(d, none, min_identity=0.6)


def test_filter_passes_all_seeds(spark):
    w = words(pa.array([" ".join(f"w{i}" for i in range(4000))]))
    seeds = decontam.seeds_of(w.hashes, *decontam.masks_for(9)[0])
    f = Filter(spark.createDataFrame([(int(x),) for x in seeds[:1000].view("int64")], "seed long"), 1000)
    assert len(f.passing(seeds[:1000])) == 1000 and len(f.passing(seeds[1000:])) < 30
