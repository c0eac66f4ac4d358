"""The pipeline on a small fixture against brute force, and the queries' contracts."""

import os
import random
from collections import Counter

import pytest

import corpus_pipeline
from quadlake.llm import ngram_join
from quadlake.llm.queries import QUERIES, SQL
from tests.llm.test_mixing_sharding import brute_shards, brute_targets
from tests.llm.test_ngram_join import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    en, de = [f"the{x}ing" for x in "abcdefghijklmnop"], [f"sch{x}ung" for x in "abcdefghijklmnop"]
    say = lambda v, n: " ".join(rng.choice(v) for _ in range(n))
    rows = [(i, say(en if i % 2 else de, 80), "en" if i % 2 else "de", f"s{i % 4}") for i in range(120)]
    item = say(en, 20)
    rows += [(200, rows[3][1] + " tail", "en", "s0"), (201, rows[3][1], "en", "s1"), (202, f"{say(en, 30)} {item} {say(en, 30)}", "en", "s2"), (203, "123 !!", "en", "s0"), (204, None, "en", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "length(text) AS n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = [r for r in rows if r[0] < 203]
    first = {i: c for i, (_, c) in brute([(r[0], r[1]) for r in kept]).items()}
    kept = [r for r in kept if first[r[0]] == r[0] and r[0] != 202]
    assert len(kept) == 120
    docs, want = spark.read.parquet(str(tmp_path / "documents.parquet")), [122 + 1, 121, 120]
    for (_, stage), n in zip(corpus_pipeline.STAGES, want, strict=False):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"stage-{n}"))
        docs = spark.read.parquet(str(tmp_path / f"stage-{n}"))
        assert docs.count() == n and docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sizes = Counter()
    for r in kept:
        sizes[r[3]] += len(r[1].split())
    target = brute_targets(sizes, 1.5, 2)
    words = Counter()
    text = {r[0]: r for r in kept}
    for r in out:
        words[text[r["doc_id"]][3]] += len(text[r["doc_id"]][1].split())
    assert all(abs(words[s] - t) <= 80 for s, t in target.items())
    shards = Counter(r["shard"] for r in out)
    assert max(shards.values()) - min(shards.get(s, 0) for s in range(24)) <= 1
    once = [(r["doc_id"], r["source"]) for r in out]
    if len(set(once)) == len(once):
        assert {r["doc_id"]: (r["shard"], r["slot"]) for r in out} == brute_shards(once, 24)


CLASHES = ["p", "letters", "host", "declared", "leaks", "size", "target", "repeats", "component_id", "n_shingles", "shard", "item", "key"]


def test_stages_with_odd_rows_and_clashing_names(spark, tmp_path):
    """Nulls in any column, empty and very long texts, ties, repeated rows and ids, and columns named like those of the operators."""
    rng = random.Random(6)
    en = [f"the{x}ing" for x in "abcdefghijklmnop"]
    say = lambda n: " ".join(rng.choice(en) for _ in range(n))
    rows = [(i, say(60), "en", f"s{i % 3}") for i in range(40)]
    rows += [rows[3], rows[3], (4, say(50), "en", None), (None, say(40), None, "s1"), (None, None, None, None), (50, "", "en", "s1"), (51, None, "en", "s2"), (52, say(30_000), "en", "s0"), (53, rows[5][1], "en", "s2")]
    columns = "doc_id long, text string, lang string, source string"
    odd = spark.createDataFrame([(*r, *[f"{c}{i}" for c in CLASHES]) for i, r in enumerate(rows)], f"{columns}, {', '.join(f'{c} string' for c in CLASHES)}")
    none = spark.createDataFrame([], odd.schema)
    spark.createDataFrame([(1, say(20)), (None, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    whole = {r["p"]: r for r in odd.collect()}

    def stage(name, docs):
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
        return out, out.collect()

    for name, n in {"language ID": 46, "n-gram Jaccard join": 46, "benchmark decontamination": 49}.items():
        out, got = stage(name, odd)
        assert out.columns == odd.columns and len(got) == n and all(r == whole[r["p"]] for r in got), name
    out, got = stage("mixing sources", odd)
    assert out.columns == odd.columns and set(got) <= set(whole.values()) and max(Counter(r["p"] for r in got if r["text"]).values()) <= 2
    out, got = stage("sharding", odd)
    shards = Counter(r["shard"] for r in got)
    assert len(got) == 49 and max(shards.values()) - min(shards[s] for s in range(24)) <= 1
    for name, _ in corpus_pipeline.STAGES:
        assert stage(name, none)[1] == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_return_whole_tables(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() == {"op2_warc": 50, "op7_language_id": 250}.get(name, 200)
    if name in SQL:
        import duckdb

        con = duckdb.connect()
        for t in ("documents", "pages"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        rel, cols = con.sql(SQL[name]), sorted(df.columns)
        text = lambda rows, names: sorted(str([r[names.index(c)] for c in cols]) for r in rows)
        assert text([tuple(r) for r in df.collect()], df.columns) == text(rel.fetchall(), list(rel.columns))


def test_few_texts_meet_in_stage_2_where_the_slots_fill_up(spark, monkeypatch):
    """A third of each text is also in one other, and a quarter of the slots are taken: all stay, and few meet on the way."""
    rng = random.Random(29)
    unique = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    texts = []
    for _ in range(150):
        passage = unique(24)
        texts += [" ".join(unique(20) + passage + unique(20)) for _ in range(2)]
    met, components = [], ngram_join.components
    monkeypatch.setattr(ngram_join, "components", lambda edges: (met.append(edges.count()), components(edges))[1])
    monkeypatch.setattr(ngram_join, "SLOTS", 13)
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0]])), "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(300))
    assert met[0] <= 15


def test_stage_2_sends_out_each_text_of_a_loose_block_few_times(spark, monkeypatch):
    """A chain of texts that share half of themselves with the next one is one block of many chunks, none of whose members link."""
    for name, value in {"CHUNK_ROWS": 10, "HUBS": 1, "ASKED": 60}.items():
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(30)
    passages = [" ".join(f"u{rng.randrange(10**9)}" for _ in range(44)) for _ in range(401)]
    rows = [(i, f"{a} {b}") for i, (a, b) in enumerate(zip(passages[:-1], passages[1:], strict=True))]
    rows.append((400, rows[200][1] + " x"))
    sent, stash = [], ngram_join.stash
    monkeypatch.setattr(ngram_join, "stash", lambda df, name: (out := stash(df, name), name == "plan" and sent.append(out.count()))[0])
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(400))
    assert len(sent) == 2 and max(sent) <= 4 * 400
