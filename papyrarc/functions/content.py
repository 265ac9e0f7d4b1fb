"""Functions over bodies and texts: each takes Columns and returns a Column built from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named character references that extracted text decodes; numeric ones are decoded by rule. Fixed values.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…"}

HIDDEN = "(?is)<!--.*?-->|" + "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in ("script", "style", "noscript", "template"))
BREAKING = r"(?i)</?(address|article|aside|blockquote|br|dd|div|dl|dt|figcaption|figure|footer|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def detect_body_format(body: Column | str) -> Column:
    """`html` or `mhtml`, from the first 4096 bytes; null for neither."""
    start = F.make_valid_utf8(F.substring(_column(body).cast("binary"), 1, 4096).cast("string"))
    start = F.regexp_replace(start, "^\\uFEFF?\\s*", "")
    header = F.regexp_replace(F.regexp_extract(start, r"(?s)^(.*?)(\r?\n\r?\n|$)", 1), r"\r?\n[ \t]+", " ")
    return F.when(start.rlike(r"(?i)^(<!doctype\s+html|<html\b|<head\b|<body\b|<\?xml\b)"), "html").when(header.rlike(r"(?im)^content-type:\s*multipart/related\b"), "mhtml")


def content_hash(body: Column | str) -> Column:
    """SHA-256 of the uncompressed body, in lower-case hexadecimal."""
    return F.sha2(_column(body).cast("binary"), 256)


def html_size(body: Column | str) -> Column:
    """Bytes of the uncompressed body."""
    return F.octet_length(_column(body)).cast("long")


def pdf_signature_ok(data: Column | str) -> Column:
    """Whether a file begins with `%PDF-`."""
    return F.coalesce(F.hex(F.substring(_column(data).cast("binary"), 1, 5)) == "255044462D", F.lit(False))


def byte_range(header: Column | str, size: Column | str) -> Column:
    """(first, last) of a single closed, open or suffix range, within a file of `size` bytes; null if it can't be served."""
    value, n = _column(header), _column(size).cast("long")
    ok = value.rlike(r"(?i)^bytes=(\d+-\d*|-\d+)$") & (n > 0)
    first = F.nullif(F.regexp_extract(value, r"(?i)^bytes=(\d*)-", 1), F.lit("")).try_cast("long")
    last = F.nullif(F.regexp_extract(value, r"-(\d*)$", 1), F.lit("")).try_cast("long")
    start = F.when(first.isNull(), F.greatest(F.lit(0), n - last)).otherwise(first)
    end = F.when(first.isNull() | last.isNull(), n - 1).otherwise(F.least(last, n - 1))
    fits = F.when(first.isNull(), last > 0).otherwise((first < n) & (last.isNull() | (last >= first)))
    return F.when(ok & fits, F.struct(start.cast("long").alias("first"), end.cast("long").alias("last")))


def byte_slice(data: Column | str, first: Column | str, last: Column | str) -> Column:
    """The bytes of a range."""
    a, b = _column(first), _column(last)
    return F.substring(_column(data), (a + 1).cast("int"), (b - a + 1).cast("int"))


def decode_entities(text: Column) -> Column:
    """Decode common character references, ampersands last."""
    for name, value in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(value))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def visible_text(html: Column | str) -> Column:
    """Text of the body without comments, scripts, styles and tags; block tags part words."""
    raw = F.regexp_replace(_column(html), HIDDEN, " ")
    body = F.coalesce(F.nullif(F.regexp_extract(raw, r"(?is)<body\b[^>]*>(.*)$", 1), F.lit("")), raw)
    return normalise_text(decode_entities(F.regexp_replace(F.regexp_replace(body, BREAKING, " "), r"(?s)<[^>]*>", "")))


def text_of(fragment: Column | str) -> Column:
    """Text of an HTML fragment."""
    raw = F.regexp_replace(_column(fragment), HIDDEN, " ")
    return normalise_text(decode_entities(F.regexp_replace(F.regexp_replace(raw, BREAKING, " "), r"(?s)<[^>]*>", "")))


def excerpt(text: Column | str, length: int = 300) -> Column:
    return F.substring(_column(text), 1, length)


def normalise_text(text: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(_column(text), r"\s+", " "))


def code_signature(code: Column | str) -> Column:
    """A code block with line feeds alone, trimmed."""
    return F.regexp_replace(F.regexp_replace(_column(code), r"\r\n?", "\n"), r"^\s+|\s+$", "")


def word_set(text: Column | str) -> Column:
    """Distinct lower-cased words of three or more letters or digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_column(text)), F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0)))


def word_coverage(target: Column | str, candidate: Column | str) -> Column:
    """Share of the target's words that the candidate has; 0 for a target without words."""
    words = word_set(target)
    return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(words, word_set(candidate))) / F.greatest(F.size(words), F.lit(1)))


def truncate_utf8(text: Column | str, limit: Column | int) -> Column:
    """The longest prefix of whole characters within `limit` bytes."""
    value = _column(text)
    n = F.lit(limit) if isinstance(limit, int) else limit.cast("int")
    raw = value.cast("binary")
    # a cut lies before a character's first byte: at most three bytes of one, all 10xxxxxx, stand between
    follows = lambda k: F.hex(F.substring(raw, n + 1 - k, F.lit(1))).between("80", "BF")
    back = F.when(~follows(0), 0).when(~follows(1), 1).when(~follows(2), 2).otherwise(3)
    cut = F.substring(raw, F.lit(1), n - back).cast("string")
    return F.when(value.isNull() | (F.octet_length(value) <= n), value).otherwise(F.when(n <= 0, "").otherwise(cut))


def normalise_tag(tag: Column | str) -> Column:
    """A tag's name with single blanks; null unless it has 1 to 100 characters."""
    name = normalise_text(tag)
    return F.when(F.length(name).between(1, 100), name)


def parse_warnings(warnings: Column | str) -> Column:
    """A JSON array of strings; other text is a single warning; null or empty gives none."""
    raw = _column(warnings)
    empty = F.array().cast("array<string>")
    return F.when(raw.isNull() | (raw == ""), empty).otherwise(F.coalesce(F.when(raw.rlike(r"^\s*\["), F.from_json(raw, "array<string>")), F.array(raw)))


def append_warnings(warnings: Column | str, more: Column) -> Column:
    """Add warnings that aren't there yet, in order."""
    return F.array_union(parse_warnings(warnings), more)


def payload_field(payload: Column | str, name: str) -> Column:
    """A text field of a JSON object; null for other or broken JSON, and for a field that is no text."""
    field = F.try_variant_get(F.try_parse_json(_column(payload)), f'$["{name}"]', "variant")
    return F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get(field, "$", "string"))


def archive_timestamp(value: Column | str, seconds: Column | str) -> Column:
    """A naive date-time as UTC, else epoch seconds as text, else null."""
    when = F.try_to_timestamp(_column(value))
    return F.coalesce(when, F.timestamp_seconds(_column(seconds).try_cast("double")))


def header_value(headers: Column | str, name: str) -> Column:
    """A value of a JSON object of headers of at most 1 MiB, by a name in any case."""
    raw = _column(headers)
    pairs = F.from_json(F.when(F.octet_length(raw) <= 1 << 20, raw), "map<string,string>")
    return F.try_element_at(F.map_values(F.map_filter(pairs, lambda k, v: F.lower(k) == name.lower())), F.lit(1))


def contains_text(column: Column | str, part: str) -> Column:
    """Case-insensitive literal containment."""
    escaped = part.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return _column(column).ilike(f"%{escaped}%")
