import random

import numpy as np
import pyarrow as pa
import pytest

from quadlake.llm import lang_id, quality, toxicity
from quadlake.llm._tokens import words


def prose(rng, vocabulary, n):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


EN = "the of and to in is that it for was on are with this from".split()
DE = "der die und in den von zu das mit sich des auf ist im dem".split()


def test_words_are_byte_words():
    texts = ["A b C\x0bd", None, "", "  x ", "no-space", "É é"]
    w = words(pa.array(texts))
    got = [[w.text(i).decode() for i in range(w.first[k], w.first[k + 1])] for k in range(len(texts))]
    assert got == [(t or "").encode().lower().decode().replace(" ", "~").split() if False else [x.decode() for x in (t or "").encode().lower().split()] for t in texts]
    assert w.hashes[0] == words(pa.array(["a"])).hashes[0] and len(set(w.hashes.tolist())) == len({w.text(i) for i in range(len(w.hashes))})


# language


ES = "de la que el en los se del las por un para con no una su al lo".split()


def evidence(spark, rows):
    """rows: id, text, declared, host."""
    d = spark.createDataFrame(rows, "id long, text string, l string, h string")
    return lang_id.evidence_columns(d, declared=lang_id.F.col("l"), host=lang_id.F.col("h"))


def test_language_from_text_and_other_evidence(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, EN if i % 2 else DE, 30), "en" if i % 2 else "de") for i in range(400)]
    model = lang_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model[0] == ["de", "en", "und"]
    pages = [(i, prose(rng, EN if i % 2 else DE, 40), "en-US" if i % 2 else "de", "a.example.com" if i % 2 else "b.beispiel.de") for i in range(100)]
    pages += [(100, "in in in", "de", "b.beispiel.de"), (101, "in in in", "en", "a.example.com"), (102, "12 !!", "en", "a.example.com"), (103, None, None, None), (104, "", "??", "x")]
    scored = lang_id.score(evidence(spark, pages), model)
    got = {r["id"]: r for r in lang_id.fuse(scored, lang_id.Evidence(scored, model[0])).collect()}
    assert len(got) == 105 and all(got[i]["language"] == ("en" if i % 2 else "de") and got[i]["accepted"] for i in range(100))
    assert (got[100]["language"], got[101]["language"]) == ("de", "en")
    assert all(not got[i]["accepted"] and got[i]["language"] is None for i in (102, 103, 104))


def test_text_in_none_of_the_languages_is_rejected(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, (EN, DE, ES)[i % 3], 30), ("en", "de", "es")[i % 3]) for i in range(300)]
    model = lang_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = ["Все счастливые семьи похожи друг на друга, каждая несчастливая", "学而时习之不亦说乎有朋自远方来", " ".join("".join(rng.choice("bcdfghjklmnpqrtvwxz") for _ in range(7)) for _ in range(30))]
    scored = lang_id.score(evidence(spark, [(i, t, None, None) for i, t in enumerate([*odd, prose(rng, ES, 8), prose(rng, EN, 4)])]), model)
    got = {r["id"]: r for r in lang_id.fuse(scored, lang_id.Evidence(scored, model[0])).collect()}
    assert all(got[i]["language"] is None and not got[i]["accepted"] for i in range(3)) and got[3]["language"] == "es" and got[4]["accepted"]


def test_rare_languages_are_known_at_any_size(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, EN, 20), "en") for i in range(600)] + [(1000 + i, prose(rng, DE, 20), "de") for i in range(3)]
    rows += [(1, None, "fr"), (2, "x", None), (3, "", "xx")]
    for sample in (10_000, 20):
        langs, table = lang_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=sample)
        assert langs == ["de", "en", "und"] and np.allclose(np.exp(table).sum(1), 1)


def brute_fuse(rows, langs, p, letters, kappa=20.0, least=0.5):
    """Languages and confidences by the docstrings, row by row."""
    n, at = len(rows), range(len(langs))
    whole = [sum(p[i][k] for i in range(n)) for k in at]
    keys = [dict(declared=d, suffix=s, host=h, domain=o) for d, s, h, o in rows]
    out = []
    for i in range(n):
        prior = [(whole[k] + 1) / (sum(whole) + len(langs)) for k in at]
        for level in ("domain", "host"):
            if keys[i][level] is not None:
                mates = [j for j in range(n) if j != i and keys[j][level] == keys[i][level]]
                prior = [(sum(p[j][k] for j in mates) + kappa * prior[k]) / (len(mates) + kappa) for k in at]
        like = [np.log(max(p[i][k], 1e-300)) + np.log(prior[k]) for k in at]
        for key in ("declared", "suffix"):
            if keys[i][key] is not None:
                same = [j for j in range(n) if keys[j][key] == keys[i][key]]
                for k in at:
                    c = sum(p[j][k] for j in same if j != i)
                    like[k] += np.log((c + kappa * len(same) / sum(whole)) / (whole[k] + kappa) / (len(same) / sum(whole)))
        e = np.exp(np.array(like) - max(like))
        best = langs[int(e.argmax())]
        language = best if letters[i] and best != "und" else None
        confidence = float(1 / e.sum()) if letters[i] else 0.0
        out.append((language, confidence, bool(language) and confidence >= least))
    return out


def test_fusion_against_brute_force(spark):
    rng = random.Random(3)
    train = [(i, prose(rng, (EN, DE)[i % 2], 12), ("en", "de")[i % 2]) for i in range(60)]
    model = lang_id.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    rows = []
    for i in range(80):
        host = rng.choice([None, "a.example.com", "b.example.com", "x.beispiel.de", "localhost"])
        rows.append((i, rng.choice([prose(rng, EN, 2), prose(rng, DE, 2), "in", "", "12", None, "zzz qqq"]), rng.choice([None, "de", "en-GB", "??"]), host))
    rows += rows[:3]  # repeated rows
    scored = lang_id.score(evidence(spark, rows), model)
    seen = scored.collect()
    want = brute_fuse([(r["declared"], r["suffix"], r["host"], r["domain"]) for r in seen], model[0], [r["p"] for r in seen], [r["letters"] for r in seen])
    got = lang_id.fuse(scored, lang_id.Evidence(scored, model[0])).collect()
    key = lambda i, x: (i, x[0] or "", round(x[1], 9), x[2])
    assert sorted(key(r["id"], (r["language"], r["confidence"], r["accepted"])) for r in got) == sorted(key(s["id"], w) for s, w in zip(seen, want, strict=True))


def test_language_of_held_out_documents(spark):
    """Trained on half of the driver's documents, right on the other half, language by language."""
    import os

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("the driver's tables are not here")
    docs = spark.read.parquet(path)
    half = lang_id.F.crc32(lang_id.F.col("doc_id").cast("string").cast("binary")) % 2
    model = lang_id.train(docs.filter(half == 0))
    d = lang_id.evidence_columns(docs.filter(half == 1), declared=lang_id.F.lit(None).cast("string"), host=lang_id.F.col("source"))
    scored = lang_id.score(d, model)
    rows = lang_id.fuse(scored, lang_id.Evidence(scored, model[0])).select("lang", "language", "accepted").collect()
    for lang in sorted({r["lang"] for r in rows}):
        mine = [r for r in rows if r["lang"] == lang]
        assert sum(r["language"] == lang and r["accepted"] for r in mine) >= 0.98 * len(mine), lang


def test_language_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = lang_id.train(none)
    d = lang_id.evidence_columns(none.drop("lang"), declared=lang_id.F.lit(None), host=lang_id.F.lit(None))
    assert lang_id.fuse(lang_id.score(d, model), lang_id.Evidence(lang_id.score(d, model), model[0])).count() == 0


@pytest.mark.parametrize(
    "html, text, declared",
    [
        ("<html lang='de-AT'><p>a<br>b</p>", "  a b ", "de-AT"),
        ("<HTML class=x LANG=en><script>if (a<b) {}</script >c<style x>y</STYLE>d&nbsp;e", "  c d e", "en"),
        ("a<!-- <b> -->c<!-- d", "a c <!-- d", None),
        ("a < b <i", "a  < b <i", None),
        ("<script>x<b>y", " x y", None),
        ("<p lang=fr>x<html><html lang=en>", " x  ", None),
        ("", "", None),
    ],
)
def test_pages(html, text, declared):
    assert lang_id.page(html) == (text, declared)


@pytest.mark.parametrize("piece", ["<", "<!--", "<script>", "<html ", "<style", "&amp", "<a ", "</script ", "lang="])
def test_hostile_pages_take_linear_time(piece):
    import time

    start = time.time()
    lang_id.page(piece * 200_000)
    assert time.time() - start < 5


# toxicity


def brute_segments(scores):
    """Maximal scoring segments by their definition: the best segment, then those of what is left on either side."""
    best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    i, j = -best[2], -best[2] - best[1]
    return brute_segments(scores[:i]) + [(i, j)] + [(a + j, b + j) for a, b in brute_segments(scores[j:])]


@pytest.mark.parametrize("seed", range(30))
def test_segments_against_brute_force(seed):
    rng = random.Random(seed)
    scores = [rng.choice([-3.0, -1.25, -0.5, 0.75, 2.0, 4.5]) + rng.random() / 64 for _ in range(rng.randrange(0, 40))]
    assert [(a, b) for a, b, _ in toxicity.segments(np.array(scores))] == brute_segments(scores)


def test_toxicity(spark):
    rng = random.Random(5)
    clean, bad = [f"w{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"], ["nastyone", "vileword"]
    text = lambda y: prose(rng, clean, 60) + (" " + prose(rng, bad + clean[:2], 8) + " " + prose(rng, clean, 20) if y else "")
    rows = [(i, text(i % 5 == 0), int(i % 5 == 0)) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.train(d, d)
    held = [(i, text(i % 2), None) for i in range(60)] + [(100, None, None), (101, "", None), (102, "nastythree " * 3 + prose(rng, clean, 30), None)]
    got = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(held, "doc_id long, text string, Toxicity string"), model).collect()}
    assert all((got[i]["toxicity"] >= 0.7) == bool(i % 2) and bool(got[i]["passages"]) == bool(i % 2) for i in range(60))
    assert got[100]["toxicity"] == got[101]["toxicity"] < 0.5 and got[102]["toxicity"] > 0.5
    none = toxicity.train(d.filter("label = 0"), d)
    assert toxicity.score(d.limit(2), none).filter("size(passages) > 0").count() == 0


# quality


def test_quality_learns_interactions():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:2500], y[:2500])
    assert (0, 1) in model.pairs or (1, 0) in model.pairs
    assert ((model.probability(x[2500:]) > 0.5) == y[2500:]).mean() > 0.95


def test_quality_scores(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, EN, 50) if i % 3 else " ".join(w + "***" for w in prose(rng, EN, 50).split()), int(i % 3 > 0)) for i in range(300)]
    model = quality.train(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    d = spark.createDataFrame([(1, prose(rng, EN, 40)), (2, " ".join(w + "***" for w in prose(rng, EN, 40).split())), (3, None), (4, ""), (5, "x " * 50_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["quality"] for r in quality.score(d, model).collect()}
    assert got[1] > 0.7 > 0.3 > got[2] and got[3] == got[4] and 0 <= got[5] <= 1
    assert quality.score(d.limit(0), model).count() == 0
    assert quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0)).probability(np.zeros((1, len(quality.FEATURES))))[0] == 0.5


def test_features_count_what_they_say():
    names = quality.FEATURES
    x = quality.features(pa.array(["A b|b b! 12\n", None]))
    assert x[0][names.index("upper")] == 1 / 12 and x[0][names.index("bars")] == 1 / 12 and x[0][names.index("digits")] == 2 / 12
    assert x[0][names.index("words")] == pytest.approx(np.log1p(4)) and not x[1][1:].any()
