"""Column functions on IRIs, identifiers and strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The RFC 4122 name space of URLs, and the shape of a UUID.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def base(iri: Column) -> Column:
    """All before the last #; the whole IRI without one."""
    return F.regexp_replace(iri, "#[^#]*$", "")


def fragment(iri: Column) -> Column:
    """All after the last #; empty without one."""
    return F.when(F.instr(iri, "#") > 0, F.regexp_extract(iri, "#([^#]*)$", 1)).otherwise("")


def split_slash(iri: Column) -> Column:
    """prefix up to and with the last / or #, and name."""
    return F.struct(F.regexp_extract(iri, "^(.*[/#])?", 1).alias("prefix"), F.regexp_extract(iri, "([^/#]*)$", 1).alias("name"))


def is_uuid(text: Column) -> Column:
    return text.rlike(UUID)


def dashed(hex32: Column) -> Column:
    return F.concat_ws("-", *[F.substring(hex32, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def uuid5_url(name: Column) -> Column:
    """Name-based UUID, version 5, in the URL name space; only SHA-1 and hex arithmetic."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), F.encode(name, "UTF-8")))
    variant = F.lower(F.conv((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 8).cast("string"), 10, 16))
    return dashed(F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15)))


def graph_id(iri: Column) -> Column:
    """The UUID of a graph: the one a urn:uuid: IRI names, else version 5 of the IRI without an empty fragment."""
    own = F.lower(F.regexp_extract(iri, "^urn:uuid:(.{36})", 1))
    return F.when(is_uuid(own), own).otherwise(uuid5_url(base(iri)))


def natural_sort_key(text: Column, width: int = 10) -> Column:
    """Digit runs padded with zeros, longer ones untouched."""
    parts = F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    padded = F.transform(parts, lambda x: F.when(x.rlike("^[0-9]") & (F.length(x) < width), F.lpad(x, width, "0")).otherwise(x))
    return F.array_join(padded, "")


def phrase(text: Column) -> Column:
    return F.lower(text)


def separated(text: Column) -> Column:
    """One lower-case token in which blanks, underscores and slashes are dashes; those at the ends go."""
    return F.lower(F.translate(F.regexp_replace(text, r"^[-_/ ]+|[-_/ ]+$", ""), "_/ ", "---"))


def language_tag_ok(tag: Column) -> Column:
    return tag.rlike("^[A-Za-z]+(-[A-Za-z0-9]+)?$")


def iri_ok(iri: Column) -> Column:
    """A scheme, something after it, and no character that RFC 3987 forbids anywhere; a URN needs a name space and a name."""
    return iri.rlike(r"""^[A-Za-z][A-Za-z0-9+.-]*:[^\x00-\x20<>"{}|\\^`]+$""") & (~iri.rlike("(?i)^urn:") | iri.rlike("(?i)^urn:[a-z0-9][a-z0-9-]{0,31}:.+"))


def prefixed(iri: Column, prefixes: dict[str, str]) -> Column:
    """prefix:fragment for a known name space (with its # or /), else the IRI in angle brackets."""
    out = F.concat(F.lit("<"), iri, F.lit(">"))
    for prefix, space in sorted(prefixes.items(), key=lambda x: len(x[1])):
        local = F.substring(iri, len(space) + 1, 1 << 20)
        out = F.when(iri.startswith(space) & local.rlike("^[A-Za-z_][A-Za-z0-9_-]*$"), F.concat(F.lit(f"{prefix}:"), local)).otherwise(out)
    return out


def escape_literal(text: Column) -> Column:
    for char, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def escape_local(name: Column) -> Column:
    """Backslashes before the characters that Turtle reserves in local names."""
    return F.regexp_replace(name, r"([~.!$&'()*+,;=/?#@%])", r"\\$1")


def node_label(kind: Column, node: Column) -> Column:
    return F.when(kind == "iri", node).otherwise(F.concat(F.lit("_:"), node))


def file_name(iri: Column) -> Column:
    """base64url of the IRI, without padding."""
    return F.regexp_replace(F.translate(F.base64(F.encode(iri, "UTF-8")), "+/", "-_"), "=", "")


def from_file_name(name: Column) -> Column:
    return F.decode(F.unbase64(F.translate(name, "-_", "+/")), "UTF-8")


def floats(text: Column) -> Column:
    """One to three numbers between single blanks; null for anything else."""
    parts = F.transform(F.split(text, " "), lambda x: x.try_cast("double"))
    return F.when((F.size(parts) <= 3) & ~F.exists(parts, F.isnull), parts)


def mime_type(name: Column, head: Column | None = None) -> Column:
    """By extension, then by the first bytes."""
    known = {"ttl": "text/turtle", "trig": "application/trig", "json": "application/json", "xml": "application/xml", "stp": "model/step", "step": "model/step", "svg": "image/svg+xml", "png": "image/png", "jpg": "image/jpeg", "pdf": "application/pdf", "txt": "text/plain", "html": "text/html", "csv": "text/csv"}
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    by_head = F.lit("application/octet-stream")
    if head is not None:
        for start, kind in (("89504E47", "image/png"), ("25504446", "application/pdf"), ("FFD8FF", "image/jpeg"), ("3C3F786D6C", "application/xml")):
            by_head = F.when(F.hex(head).startswith(start), kind).otherwise(by_head)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[ext], by_head)


def rfc3339(ts: Column) -> Column:
    return F.date_format(F.date_trunc("second", ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_time(text: Column) -> Column:
    """RFC 3339; without a zone, UTC (the session's zone must be UTC)."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]")))


def affine(a: list[Column], b: list[Column]) -> list[Column]:
    """Product of two 2-D affine maps (a, b, c, d, e, f)."""
    return [a[0] * b[0] + a[2] * b[1], a[1] * b[0] + a[3] * b[1], a[0] * b[2] + a[2] * b[3], a[1] * b[2] + a[3] * b[3], a[0] * b[4] + a[2] * b[5] + a[4], a[1] * b[4] + a[3] * b[5] + a[5]]


def suggestion(typed: Column, names: list[str]) -> Column:
    """The shortest name of which the typed text is a prefix, or that is a prefix of it."""
    fits = F.filter(F.array(*map(F.lit, sorted(names, key=lambda n: (len(n), n)))), lambda n: n.startswith(typed) | typed.startswith(n))
    return F.get(fits, F.lit(0))
