"""Language identification by Bayesian evidence fusion.

A text likelihood (multinomial over hashed byte trigrams) is multiplied with the likelihoods of the declared markup
language and of the address suffix and with a host prior that is smoothed by the prior of the host's domain, and that by
the global one. All but the trigram model are grouped aggregates over every row. One more class, whose trigrams are all equally
likely, stands for text in none of the languages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.llm._common import put, read, stash
from quadlake.llm._tokens import batches_of

BUCKETS = 1 << 15
#: The class of texts in none of the languages.
OUTSIDE = "und"
#: Languages of a model, whose table all tasks hold (128 KB for each).
MOST_LANGUAGES = 1000
#: Bytes as the model sees them: lower case, and one blank for everything in ASCII that is no letter.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint32)


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all trigrams that hold a letter, the text of each, and the texts' letters (bytes)."""
    texts = pa.concat_arrays([pa.compute.fill_null(texts.cast(pa.large_string()), "")])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    d = _FOLD[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    letters = np.bincount(doc[d != 32], minlength=len(sizes))
    if len(d) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), letters
    use = (doc[2:] == doc[:-2]) & ((d[:-2] != 32) | (d[1:-1] != 32) | (d[2:] != 32))
    key = ((d[:-2] << np.uint32(16) | d[1:-1] << np.uint32(8) | d[2:]) * np.uint32(2654435761)) >> np.uint32(17)
    return key[use].astype(np.int64), doc[:-2][use], letters


def train(df: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = 20000) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities by bucket, OUTSIDE last.

    Each of L languages has `sample` / L labelled rows or so, picked by a hash of the id, and all of its rows if they are fewer:
    whether a language is known does not depend on the others' rows. Rows without text, label or letters teach nothing. More than
    MOST_LANGUAGES labels stop with an error.
    """
    labelled = df.select(F.col(f"`{text_col}`").cast("string").alias("t"), F.col(f"`{lang_col}`").cast("string").alias("l"), F.col(f"`{id_col}`").alias("i"))
    labelled = labelled.filter(F.col("l").isNotNull() & F.col("t").isNotNull() & (F.col("l") != OUTSIDE))
    sizes = stash(labelled.groupBy("l").agg(F.count(F.lit(1)).alias("rows")), "language-sizes")
    found = sizes.count()
    if found > MOST_LANGUAGES:
        raise ValueError(f"{found} languages are more than a table of {MOST_LANGUAGES} holds")
    each = max(1, sample // max(1, found))
    picked = labelled.join(F.broadcast(sizes), "l").filter(F.pmod(F.xxhash64(F.lit(7), "i"), F.lit(1 << 40)) < F.lit(float(1 << 40)) * each / F.col("rows"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for a, b in batches_of(batch.column(0)):
                key, doc, _ = _grams(batch.column(0).slice(a, b - a))
                for lang in set(langs[a:b]):
                    mine = langs[a:b] == lang
                    sums[lang] = sums.get(lang, 0) + np.bincount(key[mine[doc]], minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

    counts = picked.select("t", "l").mapInArrow(count, "lang string, bucket int, n long")
    # At most BUCKETS rows for each language.
    got = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    langs = [*sorted(set(got["lang"])), OUTSIDE]
    at = {x: i for i, x in enumerate(langs)}
    table = np.full((len(langs), BUCKETS), 0.5)
    for x, b, n in zip(got["lang"], got["bucket"], got["n"], strict=True):
        table[at[x], b] += n
    return langs, np.log(table / table.sum(1, keepdims=True))


def _by_text(texts: pa.Array, table: np.ndarray, temper: float) -> tuple[np.ndarray, np.ndarray]:
    """The languages' probabilities by the text alone, and the bytes of letters, for each text."""
    p, letters = np.zeros((len(texts), len(table))), np.zeros(len(texts), np.int64)
    for a, b in batches_of(texts, 1 << 18):
        key, doc, letters[a:b] = _grams(texts.slice(a, b - a))
        ll = np.stack([np.bincount(doc, t[key], minlength=b - a) for t in table], 1) / temper
        e = np.exp(ll - ll.max(1, keepdims=True))
        p[a:b] = e / e.sum(1, keepdims=True)
    return p, letters


def score(df: DataFrame, model: tuple[list[str], np.ndarray], *, text_col: str = "text", temper: float = 3.0) -> DataFrame:
    """df with p, the languages' probabilities by the text alone, and letters (bytes of letters in it).

    Trigrams overlap, so the log-likelihood is divided by `temper`. A text without letters leaves p uniform.
    """
    table = df.sparkSession.sparkContext.broadcast(model[1])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j, k = (batch.schema.get_field_index(c) for c in (text_col, "p", "letters"))
            p, letters = _by_text(batch.column(i), table.value, temper)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
            yield batch.set_column(j, "p", lists).set_column(k, "letters", pa.array(letters, pa.int64()))

    out = put(df, p=F.array().cast("array<double>"), letters=F.lit(None).cast("long"))
    return out.mapInArrow(look, out.schema)


def primary(tag: Column) -> Column:
    """The primary subtag of a declared language; null without one."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(tag.cast("string"), F.lit("")), r"^\s*([A-Za-z]{2,3})(?:[-_]|\s*$)", 1)), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(host.cast("string"), F.lit("")), r"\.([A-Za-z]{2,24})$", 1)), F.lit(""))


def domain_of(host: Column) -> Column:
    """The last two labels of a host name."""
    h = F.lower(F.coalesce(host.cast("string"), F.lit("")))
    return F.coalesce(F.nullif(F.regexp_extract(h, r"([^.]+\.[^.]+)$", 1), F.lit("")), h)


class Evidence:
    """Counts of expected languages by declared tag, suffix, host and domain, over all scored rows."""

    def __init__(self, scored: DataFrame, langs: list[str]):
        """scored: p, declared, suffix, host and domain of each row."""
        self.langs = langs
        at = range(len(langs))
        sums = [F.sum(F.col("p")[i]).alias(f"s{i}") for i in at]
        self.whole = [x or 0.0 for x in scored.agg(*sums).first()]

        def table(key: str) -> DataFrame:
            found = scored.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"__ql_{key}_k")).agg(*sums)
            return stash(found.select(f"__ql_{key}_k", F.array(*[F.col(f"s{i}") for i in at]).alias(f"__ql_{key}")), key)

        self.tables = {k: table(k) for k in ("declared", "suffix", "host", "domain")}


def _posterior(p: np.ndarray, found: dict[str, np.ndarray], whole: np.ndarray, kappa: float) -> np.ndarray:
    """Posteriors of the classes. p: of the rows by text; found: by kind of evidence the class counts of each row's value, NaN without."""
    n = whole.sum() or 1.0
    prior = np.broadcast_to((whole + 1.0) / (n + len(whole)), p.shape)
    for level in ("domain", "host"):
        others = np.maximum(found[level] - p, 0.0)
        mixed = (others + kappa * prior) / (np.maximum(found[level].sum(1, keepdims=True) - 1.0, 0.0) + kappa)
        prior = np.where(np.isnan(mixed), prior, mixed)
    like = np.log(np.maximum(p, 1e-300)) + np.log(prior)
    for kind in ("declared", "suffix"):
        c = found[kind]
        same = c.sum(1, keepdims=True)
        # P(value | language) against P(value), smoothed with kappa rows of the latter; the row itself is left out.
        with np.errstate(invalid="ignore"):
            ratio = (np.maximum(c - p, 0.0) + kappa * same / n) / (whole + kappa) / (same / n)
        like = like + np.where(np.isnan(c), 0.0, np.log(np.where(np.isnan(ratio), 1.0, ratio)))
    e = np.exp(like - like.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


KINDS = ("declared", "suffix", "host", "domain")


def _settle(df: DataFrame, evidence: Evidence, probabilities, *, wanted: list[str] | None, min_confidence: float, kappa: float) -> DataFrame:
    """df joined to the evidence, and language, confidence and accepted in place of what was used; probabilities(batch) gives p and letters.

    The rows are joined by key; tables that Spark knows to be small are broadcast, others are joined by shuffle, hot hosts split by AQE.
    """
    out = df
    for kind, table in evidence.tables.items():
        out = out.join(table, F.col(kind) == F.col(f"__ql_{kind}_k"), "left").drop(f"__ql_{kind}_k")
    used = {"p", "letters", *KINDS, *[f"__ql_{k}" for k in KINDS], "language", "confidence", "accepted"}
    kept = [f for f in out.schema.fields if f.name.lower() not in used]
    langs, whole = evidence.langs, np.array(evidence.whole)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p, letters = probabilities(batch)
            found = {}
            for kind in KINDS:
                column = batch.column(f"__ql_{kind}")
                found[kind] = np.full(p.shape, np.nan)
                there = np.asarray(column.is_valid())
                found[kind][there] = np.asarray(column.drop_null().flatten()).reshape(-1, p.shape[1])
            e = _posterior(p, found, whole, kappa)
            best = e.argmax(1)
            language = [langs[i] if n and langs[i] != OUTSIDE else None for i, n in zip(best.tolist(), letters.tolist(), strict=True)]
            confidence = np.where(letters > 0, e.max(1), 0.0)
            accepted = [x is not None and c >= min_confidence and (not wanted or x in wanted) for x, c in zip(language, confidence.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(language, pa.string()), pa.array(confidence), pa.array(accepted, pa.bool_())], names=[*[f.name for f in kept], "language", "confidence", "accepted"])

    schema = put(out.select(*[F.col(f"`{f.name}`") for f in kept]), language=F.lit(None).cast("string"), confidence=F.lit(0.0), accepted=F.lit(True)).schema
    return out.mapInArrow(look, schema)


def fuse(scored: DataFrame, evidence: Evidence, *, wanted: list[str] | None = None, min_confidence: float = 0.5, kappa: float = 20.0) -> DataFrame:
    """scored with language, confidence and accepted; columns p, letters, declared, suffix, host and domain are used up.

    A text without letters, or one that most likely is in none of the languages, has no language and is not accepted. Priors count the
    other rows of a host and its domain and `kappa` rows of the level above.
    """

    def known(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return np.asarray(batch.column("p").flatten()).reshape(batch.num_rows, -1), np.asarray(batch.column("letters"))

    return _settle(scored, evidence, known, wanted=wanted, min_confidence=min_confidence, kappa=kappa)


def identify(df: DataFrame, model: tuple[list[str], np.ndarray], evidence: Evidence, *, text_col: str = "text", temper: float = 3.0, wanted: list[str] | None = None, min_confidence: float = 0.5, kappa: float = 20.0) -> DataFrame:
    """Like `fuse` for rows that still have their text, which is scored in the same pass and stays."""
    table = df.sparkSession.sparkContext.broadcast(model[1])
    return _settle(df, evidence, lambda batch: _by_text(batch.column(text_col), table.value, temper), wanted=wanted, min_confidence=min_confidence, kappa=kappa)


def evidence_columns(df: DataFrame, *, declared: Column, host: Column) -> DataFrame:
    return put(df, declared=primary(declared), suffix=suffix_of(host), host=F.lower(host.cast("string")), domain=domain_of(host))


ENTITY = re.compile(r"&[A-Za-z0-9#]{1,10};")
HIDDEN = re.compile(r"<(script|style)\b", re.I)
CLOSE = {"script": re.compile(r"</script\s*+>", re.I), "style": re.compile(r"</style\s*+>", re.I)}
HTML = re.compile(r"<html\b", re.I)
LANG = re.compile(r"""\blang\s*=\s*["']?([A-Za-z_-]+)""", re.I)


def page(html: str) -> tuple[str, str | None]:
    """What a reader sees, roughly, and the language that the first html tag declares. Scripts, styles, comments, tags and entities
    become blanks. A comment, script, style or tag that never ends hides nothing. Everything is read once: what is not found once is not
    searched again."""
    parts, at, declared, root, missing = [], 0, None, False, set()

    def after(what: str, i: int) -> int:
        """The end of the next `what` from i on, or 0."""
        if what in missing:
            return 0
        if what in CLOSE:
            m = CLOSE[what].search(html, i)
            end = m.end() if m else 0
        else:
            j = html.find(what, i)
            end = j + len(what) if j >= 0 else 0
        if not end:
            missing.add(what)
        return end

    while (i := html.find("<", at)) >= 0:
        parts += [html[at:i], " "]
        end = 0
        if m := HIDDEN.match(html, i):
            tag = after(">", i)
            end = after(m[1].lower(), tag) if tag else 0
        elif html.startswith("<!--", i):
            end = after("-->", i + 4)
        end = end or after(">", i)
        if not end:  # no tag ends any more
            at = i
            break
        if not root and HTML.match(html, i):
            root = True
            declared = m[1] if (m := LANG.search(html, i, end)) else None
        at = end
    parts.append(html[at:])
    return ENTITY.sub(" ", "".join(parts)), declared


def read_pages(df: DataFrame, *, html_col: str) -> DataFrame:
    """df with columns text and declared in place of the page; null pages have the empty text."""
    out = put(df, text=F.col(f"`{html_col}`").cast("string"), declared=F.lit(None).cast("string"))
    out = out.drop(*[c for c in (html_col,) if c not in ("text", "declared")])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j = batch.schema.get_field_index("text"), batch.schema.get_field_index("declared")
            found = [page(x.as_py() or "") for x in batch.column(i)]
            yield batch.set_column(i, "text", pa.array([t for t, _ in found], pa.string())).set_column(j, "declared", pa.array([x for _, x in found], pa.string()))

    return out.mapInArrow(look, out.schema)


def op7(spark, sf_dir: str) -> DataFrame:
    """Documents and pages together: documents have a source for a host, pages have all kinds of evidence."""
    docs, pages = read(spark, sf_dir, "documents"), read(spark, sf_dir, "pages")
    d = evidence_columns(docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", "source"), declared=F.lit(None).cast("string"), host=F.col("source")).drop("source")
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    p = read_pages(pages.select(F.lit(None).cast("long").alias("doc_id"), "page_id", "html", host.alias("h")), html_col="html")
    p = evidence_columns(p, declared=F.col("declared"), host=F.col("h")).drop("h")
    model = train(docs)
    scored = stash(score(d.unionByName(p), model).drop("text"), "languages")
    return fuse(scored, Evidence(scored, model[0])).select("doc_id", "page_id", "language", "confidence", "accepted")
