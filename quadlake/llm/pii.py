"""Personal data: pattern detection and information-theoretic sanitisation.

Identifiers found by pattern and secrets (random strings, known by the information they carry) are the protected entities. A term
reveals an entity by their pointwise mutual information over the corpus, log2(P(e | t) / P(e)): how often the entity stands within
a few words of the term. What is left to guess about the entity by one who knows the term is -log2 P(e | t) bits. Terms that give
much away and leave little to guess are hidden in the texts that hold the entity.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.llm._common import put, read, stash
from quadlake.llm._counts import TERM, term_counts

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
RUN = re.compile(r"[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
#: Keys of texts that are looked up by broadcasting them.
BROADCAST_KEYS = 500_000


def luhn(digits: str) -> bool:
    """The check-digit rule of payment cards."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Anchored at each @, so that a long run of letters is read once: the local part is all that stands before the @."""
    floor, at = 0, text.find("@")
    while at >= 0:
        if m := DOMAIN.match(text, at):
            start = at
            while start > floor and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                floor = m.end()
                yield start, floor
                at = text.find("@", floor)
                continue
        at = text.find("@", at + 1)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Dotted runs of digits, four at a time from the left."""
    for m in DOTTED.finditer(text):
        runs = [r.span() for r in RUN.finditer(text, m.start(), m.end())]
        for i in range(0, len(runs) - 3, 4):
            if all(len(part := text[a:b].lstrip("0")) <= 3 and int(part or 0) <= 255 for a, b in runs[i : i + 4]):
                yield runs[i][0], runs[i + 3][1]


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                yield m.span()


FINDERS = dict(zip(KINDS, (_emails, _ips, _cards, _phones), strict=True))
SECRET = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}(?![A-Za-z0-9])")


def detect(text: str) -> list[tuple[str, int, int]]:
    """All base spans in code points, by kind and start."""
    return [(k, a, b) for k, f in FINDERS.items() for a, b in f(text)]


def information(s: str) -> float:
    """Bits of a string under its own letter frequencies."""
    return sum(-n * math.log2(n / len(s)) for n in Counter(s).values())


def secrets(text: str, *, min_bits: float = 60.0) -> list[tuple[str, int, int]]:
    """Runs of 20 ASCII letters and digits or more that look drawn at random: both kinds, often in turn, and `min_bits` of information,
    3 a character at least."""
    out = []
    for m in SECRET.finditer(text):
        s = m[0]
        turns = sum(x.isdigit() != y.isdigit() for x, y in zip(s, s[1:], strict=False))
        if turns * 6 >= len(s) and information(s) >= max(min_bits, 3.0 * len(s)):
            out.append(("secret", *m.span()))
    return out


def tokens(text: str) -> Iterator[tuple[str, int, int]]:
    """Terms, lower-cased one by one, with their places. Counting, estimating and hiding all see terms as this function does."""
    return ((m[0].lower(), *m.span()) for m in TERM.finditer(text))


def _keys(text: str) -> set[str]:
    return {t.lower() for t in set(TERM.findall(text))}


def protected(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and secrets that no base span overlaps."""
    base = detect(text)
    return base, list(outside(secrets(text), _merged(base)))


def outside(words: Iterable[tuple[str, int, int]], spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """The words that no span overlaps; both stand in order of place."""
    i = 0
    for w in words:
        while i < len(spans) and spans[i][2] <= w[1]:
            i += 1
        if i == len(spans) or spans[i][1] >= w[2]:
            yield w


def _merged(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans by place; those that overlap become one, named after the first."""
    out: list[tuple[str, int, int]] = []
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if out and a < out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(b, out[-1][2]))
        else:
            out.append((k, a, b))
    return out


def near(text: str, spans: list[tuple[str, int, int]], reach: int) -> dict[str, set[str]]:
    """By entity, the terms among the `reach` words before and after its mentions."""
    if not spans:
        return {}
    merged = _merged(spans)
    starts, ends = array("q"), array("q")  # a long text's terms as numbers, not as strings
    for _, a, b in outside(tokens(text), merged):
        starts.append(a)
        ends.append(b)
    found: dict[str, set[str]] = {}
    for k, a, b in sorted(spans, key=lambda s: s[1]):
        at, after = bisect_left(starts, a), bisect_left(starts, b)
        name = NOT_DIGIT.sub("", text[a:b]) if k in ("card", "phone") else text[a:b].lower()
        terms = found.setdefault(f"{k}:{name}", set())
        for i in (*range(max(0, at - reach), at), *range(after, min(after + reach, len(starts)))):
            terms.add(text[starts[i] : ends[i]].lower())
    return found


SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_PAIRS = pa.list_(pa.struct([("e", pa.string()), ("terms", pa.list_(pa.string()))]))


def _structs(spans: list[tuple[str, int, int]]) -> list[dict]:
    return [{"kind": k, "start": a, "end": b} for k, a, b in spans]


def _detect_batches(reach: int):
    """Replaces the text by its spans, its secrets and, of each entity, the terms near it."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, hidden, pairs = [], [], []
            for x in batch.column("__ql_t"):
                text = x.as_py() or ""
                base, more = protected(text)
                spans.append(_structs(base))
                hidden.append(_structs(more))
                pairs.append([{"e": e, "terms": sorted(t)} for e, t in sorted(near(text, base + more, reach).items())])
            kept = [i for i, n in enumerate(batch.schema.names) if n != "__ql_t"]
            arrays = [batch.column(i) for i in kept] + [pa.array(spans, _SPANS), pa.array(hidden, _SPANS), pa.array(pairs, _PAIRS)]
            yield pa.RecordBatch.from_arrays(arrays, names=[batch.schema.names[i] for i in kept] + ["base", "secrets", "pairs"])

    return look


def _key(text: Column) -> Column:
    """A text is known by its own 128 bits, never by an id."""
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def disclosures(found: DataFrame, texts: DataFrame, *, min_bits: float, max_left: float) -> DataFrame:
    """__ql_key, terms: for each text with a protected entity, the terms that disclose one of its entities.

    found has __ql_key (of the text) and pairs of each row, texts has __ql_t of each row. An entity e can be disclosed by `min_bits`
    bits only if log2(N / c(e)) reaches that, so others are left out without loss. A row has at most 2 `reach` terms for a mention, so
    the pairs grow with the mentions and not with their square.
    """
    n = float(max(1, found.count()))
    rows = found.filter(F.size("pairs") > 0).groupBy("__ql_key", "pairs").agg(F.count(F.lit(1)).alias("w"))
    rows = stash(rows.select("__ql_key", "w", F.explode("pairs").alias("p")).select("__ql_key", "w", F.col("p.e").alias("e"), F.col("p.terms").alias("terms")), "entities")
    guarded = rows.groupBy("e").agg(F.sum("w").alias("ce")).filter(F.log2(F.lit(n) / F.col("ce")) >= min_bits)
    pairs = stash(rows.join(guarded, "e").select("__ql_key", "w", "e", "ce", F.explode("terms").alias("term")), "guarded")
    together = stash(pairs.groupBy("term", "e").agg(F.sum("w").alias("cte"), F.first("ce").alias("ce")), "together")
    ct = term_counts(texts, F.col("__ql_t"), _keys)
    # The posterior mean with one row of the entity's own share before, so that a single meeting is no certainty.
    p = (F.col("cte") + F.col("ce") / F.lit(n)) / (F.greatest("n", "cte") + 1.0)
    telling = together.join(ct, "term").filter((F.log2(p * F.lit(n) / F.col("ce")) >= min_bits) & (-F.log2(p) <= max_left)).select("term", "e")
    return pairs.select("__ql_key", "term", "e").join(stash(telling, "telling"), ["term", "e"]).groupBy("__ql_key").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def locate(text: str, wanted: set[str]) -> list[tuple[str, int, int]]:
    """Where the terms stand in the text, but for places inside an identifier or a secret, whose own spans are enough."""
    base, more = protected(text)
    return [("term", a, b) for w, a, b in outside(tokens(text), _merged(base + more)) if w in wanted]


def _locate_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [_structs(locate(t, set(w))) for t, w in zip(batch.column("__ql_t").to_pylist(), batch.column("terms").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("__ql_key"), pa.array(out, _SPANS)], names=["__ql_key", "hidden"])


def _study(rows: DataFrame, options: dict) -> tuple[DataFrame, DataFrame]:
    """rows with __ql_key and __ql_t: what is found in each row, without its text, and the disclosing terms of texts."""
    reach = options.pop("reach")
    plain = [f"`{c}` {t}" for c, t in rows.dtypes if c != "__ql_t"]
    found = stash(rows.mapInArrow(_detect_batches(reach), ", ".join([*plain, f"base {SPANS}, secrets {SPANS}, pairs array<struct<e:string,terms:array<string>>>"])), "spans")
    return found, stash(disclosures(found, rows.select("__ql_t"), **options), "disclosing")


def find_personal_data(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_bits: float = 6.0, max_left: float = 2.0, reach: int = 5) -> DataFrame:
    """id, base and hidden: spans (kind, start, end in code points, end exclusive) of identifiers, and of secrets and disclosing terms.

    A term is hidden in a text if, for an entity of that text, knowing the term gives `min_bits` bits about the entity and leaves
    `max_left` bits or less to guess (2 bits: one in four rows with the term has the entity beside it). Both stand together
    where the term is among the `reach` words before or after a mention. Counts are of rows, over the whole corpus; estimates are
    smoothed by one row of the entity's own share. Texts without an identifier or a secret have no hidden terms.

    Defined results: null is the empty text, with no spans; repeated rows and ids are reported each, null ids too; texts are known by
    their content, so equal texts have equal spans; very long runs of letters or digits take linear time; an empty table gives no
    rows; other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").alias("__ql_id"), _key(text).alias("__ql_key"), text.alias("__ql_t"))
    found, terms = _study(rows, {"min_bits": min_bits, "max_left": max_left, "reach": reach})
    # The few texts at stake, once each. Their keys (16 bytes) are broadcast up to a count; more are joined by shuffle.
    keys = stash(terms.select(F.unhex("__ql_key").alias("__ql_own")), "keys")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    at_stake = rows.join(keys, F.unhex("__ql_key") == F.col("__ql_own"), "left_semi").groupBy("__ql_key").agg(F.first("__ql_t").alias("__ql_t")).join(terms, "__ql_key")
    hidden = stash(at_stake.mapInArrow(_locate_batches, f"__ql_key string, hidden {SPANS}"), "hidden")
    more = F.concat("secrets", F.coalesce("hidden", F.array().cast(SPANS)))
    return found.join(hidden, "__ql_key", "left").select(F.col("__ql_id").alias(id_col), "base", more.alias("hidden"))


def hide(text: str, wanted: set[str]) -> str:
    """The text with identifiers, secrets and the wanted terms replaced by their kinds."""
    base, more = protected(text)
    parts, at = [], 0
    for k, a, b in _merged(base + more + locate(text, wanted)):
        parts += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join([*parts, text[at:]])


def sanitise(df: DataFrame, *, text_col: str = "text", min_bits: float = 6.0, max_left: float = 2.0, reach: int = 5) -> DataFrame:
    """df with the personal data of its texts replaced: identifiers by [KIND], secrets by [SECRET], disclosing terms by [TERM].

    Rows are matched with the disclosing terms of their text by the text itself, and hidden in the pass that finds the spans again:
    null ids, repeated ids and repeated rows are all treated alike. Null texts stay null; an empty table gives none.
    """
    text = F.col(f"`{text_col}`").cast("string")
    rows = df.select(_key(text).alias("__ql_key"), F.coalesce(text, F.lit("")).alias("__ql_t"))
    _, terms = _study(rows, {"min_bits": min_bits, "max_left": max_left, "reach": reach})
    marked = put(df, __ql_key=_key(text)).join(terms.withColumnRenamed("terms", "__ql_terms"), "__ql_key", "left").drop("__ql_key")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j = batch.schema.get_field_index(text_col), batch.schema.get_field_index("__ql_terms")
            out = [None if t is None else hide(t, set(w or [])) for t, w in zip(batch.column(i).to_pylist(), batch.column(j).to_pylist(), strict=True)]
            yield batch.set_column(i, text_col, pa.array(out, batch.schema.field(i).type)).drop_columns(["__ql_terms"])

    return marked.mapInArrow(look, df.schema)


def op10(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(read(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda c, k: F.size(F.filter(c, lambda s: s["kind"] == k)).cast("long")
    private = (F.size("base") > 0) | (F.size("hidden") > 0)
    return found.select("doc_id", *[count("base", k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "hidden")).alias("spans"), count("hidden", "secret").alias("n_secret"), count("hidden", "term").alias("n_term"), private.alias("private"))
