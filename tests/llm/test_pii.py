import math
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quadlake.llm import pii

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m)) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "B9", "1", "25", "0", ".", "@", "+", "-", " ", "(", ")", "é", "4111111111111111", "127.0.0.1", "\n", "x@y.z"]), max_size=14).map("".join))
def test_detection_is_the_patterns(t):
    assert pii.detect(t) == brute(t)


def test_luhn_and_long_runs():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.detect("a" * 300_000 + " " + "1" * 300_000 + "@" * 1000) == []


def brute_hidden(texts, min_bits=6.0, max_left=2.0, reach=5):
    """Secrets and terms to hide in each text, by the definition, with no sharing of work between texts."""
    n, found = len(texts), []
    for t in texts:
        t = t or ""
        base = [*pii.detect(t)]
        spans = base + [s for s in pii.secrets(t) if not any(s[1] < b and s[2] > a for _, a, b in base)]
        words = [(m[0].lower(), *m.span()) for m in re.finditer(r"[^\W\d_]{2,}", t) if not any(m.start() < b and m.end() > a for _, a, b in spans)]
        near = {}
        for k, a, b in spans:
            e = (k, re.sub("[^0-9]", "", t[a:b]) if k in ("card", "phone") else t[a:b].lower())
            before, after = [w for w in words if w[2] <= a][-reach:], [w for w in words if w[1] >= b][:reach]
            near.setdefault(e, set()).update(w[0] for w in before + after)
        found.append((spans, words, near, {m[0].lower() for m in re.finditer(r"[^\W\d_]{2,}", t)}))
    out = []
    for spans, words, near, _ in found:
        hide = set()
        for e in near:
            ce = sum(e in x[2] for x in found)
            for w in {w for x in found for w in x[2].get(e, ())} & near[e]:
                p = (sum(w in x[2].get(e, ()) for x in found) + ce / n) / (sum(w in x[3] for x in found) + 1)
                if math.log2(n / ce) >= min_bits and math.log2(p * n / ce) >= min_bits and -math.log2(p) <= max_left:
                    hide.add(w)
        out.append([s for s in spans if s[0] == "secret"] + [("term", a, b) for w, a, b in words if w in hide])
    return out


def prose(rng, n):
    return [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('klmnp')}{rng.choice('aeiou') * rng.randrange(1, 5)}" for _ in range(n)]


def test_disclosures_against_brute_force(docs):
    rng = random.Random(8)
    texts = [" ".join(prose(rng, rng.randrange(0, 30))) for _ in range(300)] + [None, "", "İstanbul x²y"]
    names = ["zq@x.org", "qq@y.org", "10.0.0.7", "+44 20 7946 0958", "4111111111111111", "9f3c1e7ab2d84c05e6f7a8b9c0d1e2f3a4b5c6d7"]
    for i in range(60):
        w = prose(rng, rng.randrange(3, 25))
        for e in rng.sample(names, rng.randrange(1, 3)) * rng.randrange(1, 3):
            w.insert(rng.randrange(len(w) + 1), rng.choice([e, e.upper(), f"({e})"]))
        if i % 3 == 0:
            w.insert(rng.randrange(len(w) + 1), f"Zarquon{'xyz'[i % 2]} İnci")
        texts.append(" ".join(w))
    texts += texts[-5:]  # repeated rows
    # Few of each entity among many rows.
    texts += [" ".join(prose(rng, 12)) for _ in range(1200)]
    want = brute_hidden(texts, min_bits=4.0)
    rows = pii.find_personal_data(docs([(i, t, None, None) for i, t in enumerate(texts)]), min_bits=4.0).collect()
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["hidden"]] for r in rows}
    assert got == dict(enumerate(want)) and sum(bool(x) for x in want) > 20
    assert {s[0] for x in want for s in x} == {"secret", "term"}


def test_secrets():
    key = "6df57b16f87eabefefcab67b433efd90636bb6bd"
    assert pii.secrets(f'token = "{key}"###') == [("secret", 9, 49)]
    assert pii.secrets("antidisestablishmentarianism " * 3 + "1" * 40 + " a1a1a1a1a1a1a1a1a1a1a1a1 version20240131release0001") == []


def test_terms_that_disclose(docs):
    common = [(i, f"plain words number filler{i % 50} and more", None, None) for i in range(400)]
    told = [(1000, "plain words and Zarquon writes from zq@x.org and plain words number filler1 more seldomword", None, None)]
    told += [(1001 + i, f"plain words and Quixxle at qx@x.org since {'april' if i else 'march'}", None, None) for i in range(2)]
    rows = {r["doc_id"]: r for r in pii.find_personal_data(docs([*common, *told, (1, None, None, None), (2, "quixxle alone", None, None)])).collect()}
    hidden = {i: {t[s["start"] : s["end"]].lower() for s in rows[i]["hidden"]} for i, t, _, _ in told}
    assert {"zarquon", "writes"} <= hidden[1000] and all("quixxle" in hidden[i] for i in (1001, 1002))
    assert not any(h & {"plain", "words", "and", "zq", "org", "seldomword"} for h in hidden.values())
    assert not rows[2]["hidden"] and not rows[1]["hidden"] and not rows[1]["base"]
    assert sum(bool(r["hidden"]) for r in rows.values()) == 3


def test_sanitise_and_edges(docs):
    d = docs([(1, "mail a@b.co now", "x", "y"), (2, None, None, None), (3, "", None, None)])
    assert {r["doc_id"]: r["text"] for r in pii.sanitise(d).collect()} == {1: "mail [EMAIL] now", 2: None, 3: ""}
    assert pii.find_personal_data(docs([])).count() == 0 and pii.sanitise(docs([])).count() == 0
    twice = docs([(1, "a@b.co", None, None)] * 2).withColumnsRenamed({"lang": "base", "source": "entities"})
    assert [len(r["base"]) for r in pii.find_personal_data(twice).collect()] == [1, 1]
    long = docs([(1, "a@b.co " * 60_000, None, None), (2, "x" * 500_000, None, None)])
    assert sorted(len(r["base"]) for r in pii.find_personal_data(long).collect()) == [0, 60_000]


def test_sanitise_knows_rows_by_their_text(docs):
    common = [(None, f"plain words number filler{i % 50} and more", None, None) for i in range(400)]
    told = [(None, "Zarquon writes to zq@x.org", None, None), (1, "plain a@b.co", None, None), (1, "mail Quixxle 127.0.0.1 and Quixxle", None, None), (1, "plain a@b.co", None, None)]
    got = sorted(r["text"] for r in pii.sanitise(docs([*common, *told])).collect() if "[" in r["text"])
    assert got == ["[TERM] [TERM] [IP] and [TERM]", "[TERM] [TERM] [TERM] [EMAIL]", "plain [EMAIL]", "plain [EMAIL]"]


def test_base_spans_do_not_depend_on_terms(docs):
    rows = [(i, t, None, None) for i, t in enumerate(["card 4111 1111 1111 1111, +44 20 7946 0958", "10.0.0.1.2.3.4.5", "x@y.zz@q.rr", "é" * 10 + " a@b.co"])]
    assert {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["base"]] for r in pii.find_personal_data(docs(rows)).collect()} == {i: brute(t) for i, t, _, _ in rows}
