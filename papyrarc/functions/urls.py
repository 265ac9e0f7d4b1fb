"""URL functions: each takes Columns and returns a Column built from Spark's own functions.

Not handled, and left as they are: internationalised host names, backslashes for slashes, and http URLs without `//`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track visitors. Fixed values.
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_source_platform",
    "utm_creative_format", "utm_marketing_tactic", "fbclid", "gclid", "msclkid", "twclid", "li_fat_id", "mc_eid",
    "mc_cid", "ref", "referrer", "_ga",
)

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _trimmed(url: Column | str) -> Column:
    return F.regexp_replace(_column(url), r"^[\s\x00-\x1f]+|[\s\x00-\x1f]+$", "")


def _scheme(raw: Column) -> Column:
    return F.lower(F.regexp_extract(raw, _SCHEME, 1))


def _authority(raw: Column) -> Column:
    return F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def _host_port(raw: Column) -> Column:
    return F.regexp_replace(_authority(raw), r"^.*@", "")


def _host(raw: Column) -> Column:
    return F.lower(F.regexp_extract(_host_port(raw), r"^(\[[^\]]*\]|[^:]*)", 1))


def url_path(url: Column | str) -> Column:
    """The path as written; `/` where there is none."""
    path = F.regexp_extract(_trimmed(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def _query(raw: Column) -> Column:
    return F.regexp_extract(raw, r"^[^?#]*\?([^#]*)", 1)


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _parameters(raw: Column) -> Column:
    """Array of (name, at, value), decoded, in the order of the query string."""
    parts = F.filter(F.split(_query(raw), "&"), lambda p: p != "")
    return F.transform(
        parts,
        lambda p, i: F.struct(_decoded(F.regexp_extract(p, r"^([^=]*)", 1)).alias("name"), i.alias("at"), _decoded(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("value")),
    )


def fold_dots(path: Column) -> Column:
    """Resolve `.` and `..` segments of an absolute path."""
    segments = F.split(F.regexp_replace(path, r"^/", ""), "/")
    size = F.size(segments)
    numbered = F.transform(segments, lambda s, i: F.struct(s.alias("s"), (i == size - 1).alias("last")))
    start = F.array().cast("array<string>")

    def step(done: Column, x: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        closed = lambda a: F.when(x["last"], F.concat(a, F.array(F.lit("")))).otherwise(a)
        return F.when(x["s"] == "..", closed(up)).when(x["s"] == ".", closed(done)).otherwise(F.concat(done, F.array(x["s"])))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(numbered, start, step), "/"))


def url_reject_reason(url: Column | str) -> Column:
    """`invalid`, `scheme` or `credentials`; null for a URL that can be stored."""
    raw = _trimmed(url)
    web = _scheme(raw).isin("http", "https")
    host = _host(raw)
    bad_host = (host == "") | host.rlike(r"[\s<>^|%]") | F.regexp_replace(_host_port(raw), r"^(\[[^\]]*\]|[^:]*)", "").rlike(r"^(?!(:\d{0,5})?$)")
    return (
        F.when(raw.isNull() | (_scheme(raw) == ""), "invalid")
        .when(~web, "scheme")
        .when(bad_host, "invalid")
        .when(F.regexp_replace(F.regexp_extract(_authority(raw), r"^(.*)@", 1), "^:$", "") != "", "credentials")
    )


def _encoded_path(path: Column) -> Column:
    """A path with blanks, quotes, angle brackets, braces, carets, backquotes and letters beyond ASCII percent-encoded; all else stays."""
    parts = F.regexp_extract_all(path, F.lit("[^\\x21\\x23-\\x3B\\x3D\\x3F-\\x5D\\x5F\\x61-\\x7A\\x7C\\x7E]+|[\\x21\\x23-\\x3B\\x3D\\x3F-\\x5D\\x5F\\x61-\\x7A\\x7C\\x7E]+"), F.lit(0))
    plain = lambda x: x.rlike("^[\\x21\\x23-\\x3B\\x3D\\x3F-\\x5D\\x5F\\x61-\\x7A\\x7C\\x7E]")
    return F.array_join(F.transform(parts, lambda x: F.when(plain(x), x).otherwise(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")))), "")


def normalise_url(url: Column | str) -> Column:
    """One spelling for a page's URL, or null with a reason in `url_reject_reason`.

    Trims, lower-cases scheme and host, drops default ports, fragments and tracking parameters, sorts the other
    parameters by name (repeated ones keep their order), and encodes these as forms do.
    """
    raw = _trimmed(url)
    scheme, port = _scheme(raw), F.regexp_replace(F.regexp_extract(_host_port(raw), r":(\d+)$", 1), r"^0+(?=\d)", "")
    usual = F.when(scheme == "http", "80").otherwise("443")
    kept = F.filter(_parameters(raw), lambda p: ~F.lower(p["name"]).isin(*TRACKING_PARAMS))
    query = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"]))), "&")
    path = _encoded_path(fold_dots(url_path(url)))
    whole = F.concat(
        scheme, F.lit("://"), _host(raw), F.when((port == "") | (port == usual), "").otherwise(F.concat(F.lit(":"), port)),
        path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    )
    return F.when(url_reject_reason(url).isNull(), whole)


def url_domain(url: Column | str) -> Column:
    """The host name without a leading `www.`; empty if there is none."""
    host = _host(_trimmed(url))
    return F.coalesce(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def is_blocked_address(address: Column | str, allowed: tuple[str, ...] = ()) -> Column:
    """Whether a host is a private, reserved or local address and not on the allow-list."""
    host = F.regexp_replace(F.lower(_column(address)), r"^\[|\]$", "")
    octets = F.when(host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.transform(F.split(host, r"\."), lambda x: x.cast("int")))
    a, b, c = (F.try_element_at(octets, F.lit(i)) for i in (1, 2, 3))
    v4 = octets.isNotNull() & (
        F.exists(octets, lambda x: x > 255)
        | a.isin(0, 10, 127)
        | (a >= 224)
        | ((a == 100) & b.between(64, 127))
        | ((a == 169) & (b == 254))
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 192) & (b == 0) & c.isin(0, 2))
        | ((a == 198) & (b.isin(18, 19) | ((b == 51) & (c == 100))))
        | ((a == 203) & (b == 0) & (c == 113))
    )
    v6 = host.contains(":") & host.rlike(r"^(::1?$|::ffff:|f[cd]|fe[89ab]|ff|2001:db8:)")
    blocked = (host == "localhost") | F.coalesce(v4, F.lit(False)) | v6
    return blocked & ~host.isin(*allowed) if allowed else blocked


def has_pdf_hint(url: Column | str) -> Column:
    """Whether the decoded path or any query value ends in `.pdf`."""
    raw = _trimmed(url)
    path = F.lower(_decoded(F.replace(url_path(url), F.lit("+"), F.lit("%2B")))).endswith(".pdf")
    value = F.exists(_parameters(raw), lambda p: F.lower(p["value"]).endswith(".pdf"))
    return F.coalesce((_scheme(raw) != "") & (path | F.coalesce(value, F.lit(False))), F.lit(False))


def resolve_href(href: Column | str, base: Column | str) -> Column:
    """An absolute http(s) URL; fragments, mailto: and tel: stay as they are; other schemes give null."""
    link, root = F.trim(_column(href)), _trimmed(base)
    origin = F.concat(_scheme(root), F.lit("://"), F.lower(_authority(root)))
    folder = F.regexp_replace(url_path(base), r"[^/]*$", "")
    path, rest = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    own_path = F.regexp_extract(link, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    own_rest = F.regexp_extract(link, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*[^?#]*(.*)$", 1)
    absolute = F.concat(_scheme(link), F.lit("://"), F.lower(_authority(link)), F.when(own_path == "", "/").otherwise(fold_dots(own_path)), own_rest)
    return (
        F.when((link == "") | link.startswith("#") | link.rlike(r"(?i)^(mailto|tel):"), link)
        .when(link.rlike(r"(?i)^https?://"), absolute)
        .when(link.rlike(_SCHEME), None)
        .when(link.startswith("//"), F.concat(_scheme(root), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, fold_dots(path), rest))
        .when(link.startswith("?"), F.concat(origin, url_path(base), link))
        .otherwise(F.concat(origin, fold_dots(F.concat(folder, path)), rest))
    )


def slugify(text: Column | str) -> Column:
    """Lower-case words joined by dashes, 80 characters, `capture` if nothing is left."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(_column(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(dashed, 1, 80), F.lit("")), F.lit("capture"))


def response_filename(disposition: Column | str, url: Column | str) -> Column:
    """A file name from a Content-Disposition header (encoded, quoted or bare), else from the URL's last segment."""
    header = F.coalesce(_column(disposition), F.lit(""))
    tidy = lambda c: F.nullif(F.substring(F.trim(F.regexp_replace(c, r"[\\/\x00-\x1f\x7f]", "_")), 1, 255), F.lit(""))
    found = lambda pattern: F.nullif(F.regexp_extract(header, pattern, 1), F.lit(""))
    encoded = F.try_url_decode(F.replace(found(r"(?i)filename\*=UTF-8''([^;]+)"), F.lit("+"), F.lit("%2B")))
    named = F.coalesce(encoded, found(r'(?i)filename="([^"]+)"'), found(r"(?i)filename=([^;\s]+)"))
    last = F.nullif(F.regexp_extract(url_path(url), r"([^/]*)$", 1), F.lit(""))
    return F.when(named.isNotNull(), tidy(named)).otherwise(tidy(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B")))))
