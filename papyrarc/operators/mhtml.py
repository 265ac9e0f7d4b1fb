"""MHTML captures: parts, the root document, references to parts, and the oversize report."""

from __future__ import annotations

import base64
import binascii
import quopri
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrarc.functions.urls import resolve_href

ELIGIBLE = ("image/jpeg", "image/png", "image/webp")
_SCHEMA = pa.schema([
    ("capture_id", pa.int64()), ("pos", pa.int32()), ("type", pa.string()), ("location", pa.string()), ("content_id", pa.string()), ("encoding", pa.string()),
    ("snapshot_location", pa.string()), ("bytes", pa.int64()), ("data", pa.binary()), ("error", pa.string()),
])


def _headers(raw: bytes) -> dict[str, str]:
    folded = re.sub(rb"\r?\n[ \t]+", b" ", raw).decode("latin-1")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in folded.splitlines()) if v}


def _split_head(raw: bytes) -> tuple[dict[str, str], bytes]:
    m = re.search(rb"\r?\n\r?\n", raw)
    return (_headers(raw[: m.start()]), raw[m.end() :]) if m else (_headers(raw), b"")


def parts_of(body: bytes) -> Iterator[dict]:
    """Decoded parts of one MHTML file."""
    head, rest = _split_head(body)
    found = re.search(r'boundary\s*=\s*(?:"([^"]+)"|([^;\s]+))', head.get("content-type", ""), re.IGNORECASE)
    if not found:
        raise ValueError("no boundary")
    mark = b"--" + (found[1] or found[2]).encode("latin-1")
    pieces = re.split(rb"(?:^|\r?\n)" + re.escape(mark), b"\n" + rest)
    pos = 0
    for piece in pieces[1:]:
        if piece.startswith(b"--"):
            break
        own, data = _split_head(piece.lstrip(b"\r\n"))
        encoding = own.get("content-transfer-encoding", "binary").lower()
        if encoding == "base64":
            data = base64.b64decode(re.sub(rb"[^A-Za-z0-9+/=]", b"", data) + b"==")
        elif encoding == "quoted-printable":
            data = quopri.decodestring(data)
        yield {"pos": pos, "type": own.get("content-type", "").split(";")[0].strip().lower(), "location": own.get("content-location"), "content_id": own.get("content-id", "").strip("<>") or None, "encoding": encoding, "snapshot_location": head.get("snapshot-content-location"), "bytes": len(data), "data": data}
        pos += 1


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            capture = batch.column(0)[i].as_py()
            try:
                rows = [{"capture_id": capture, **p} for p in parts_of(batch.column(1)[i].as_py() or b"")]
            except (ValueError, binascii.Error) as e:
                rows = [{"capture_id": capture, "error": str(e)}]
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def mime_parts(bodies: DataFrame) -> DataFrame:
    """A row for each part of each MHTML body (capture_id, body), decoded; a broken body gives one row with an error."""
    schema = "capture_id long, pos int, type string, location string, content_id string, encoding string, snapshot_location string, bytes long, data binary, error string"
    return bodies.select("capture_id", F.col("body").cast("binary")).mapInArrow(_parts, schema)


def root_parts(parts: DataFrame) -> DataFrame:
    """Each capture's document: the HTML part whose location is the snapshot's, else the first HTML part."""
    html = parts.where("type = 'text/html'").withColumn("other", (~F.col("location").eqNullSafe(F.col("snapshot_location"))).cast("int"))
    return html.groupBy("capture_id").agg(F.min_by(F.struct("pos", "location", "data"), F.struct("other", "pos")).alias("p")).select("capture_id", "p.*")


def _bare(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def _contained(group: pa.Table) -> pa.Table:
    """Of one capture the least place whose text lies in a reference's, or that holds it. One automaton of all places reads the references, one of the references the places."""
    import ahocorasick

    texts, references, places = (group.column(c).to_pylist() for c in ("text", "reference", "pos"))
    found: dict[str, int] = {}

    def read(patterns: dict[str, list], rows: Iterator[tuple[str, list]]) -> Iterator[tuple[list, list]]:
        """(values of a pattern, values of a text that holds it)"""
        automaton = ahocorasick.Automaton()
        for text, values in patterns.items():
            if text:
                automaton.add_word(text, values)
        if not len(automaton):
            return
        automaton.make_automaton()
        for text, values in rows:
            for _, held in automaton.iter(text):
                yield held, values

    at: dict[str, int] = {}
    asked: dict[str, list[str]] = {}
    for text, reference, pos in zip(texts, references, places, strict=True):
        if pos is not None:
            at[text] = min(pos, at.get(text, pos))
        else:
            asked.setdefault(text, []).append(reference)
    places_of, names_of = {t: [p] for t, p in at.items()}, asked
    matches = [(names, held[0]) for held, names in read(places_of, asked.items())]
    for names, pos in (*matches, *((held, of[0]) for held, of in read(names_of, places_of.items()))):
        for name in names:
            found[name] = min(pos, found.get(name, pos))
    if "" in asked and at:  # an empty text lies in every other
        found |= {name: min(at.values()) for name in asked[""]}
    capture = pa.array([group.column("capture_id")[0].as_py()] * len(found), group.schema.field("capture_id").type)
    return pa.table({"capture_id": capture, "reference": pa.array(list(found), pa.string()), "last": pa.array(list(found.values()), pa.int64())})


def resolve_references(references: DataFrame, parts: DataFrame) -> DataFrame:
    """(capture_id, reference, pos, by) for references (capture_id, reference, base): the part that each means.

    In this order: exact location, resolved URL, `cid:`, URL without fragment, and last a part's location that the decoded reference
    holds or that holds it, which is looked for among a capture's own parts only, and only for what is left, by automata of many patterns.
    """
    refs = references.withColumns({"resolved": resolve_href("reference", "base"), "cid": F.when(F.col("reference").startswith("cid:"), F.substring("reference", 5, 1 << 20))})
    refs = refs.withColumn("bare", _bare(F.coalesce("resolved", "reference")))
    by = lambda key, name: parts.where(key.isNotNull()).groupBy("capture_id", key.alias(name)).agg(F.min("pos").alias(f"pos_{name}"))
    location = F.col("location")
    out = refs
    for name, key in (("reference", location), ("resolved", location), ("cid", F.col("content_id")), ("bare", _bare(location))):
        out = out.join(by(key, name), ["capture_id", name], "left")
    first = F.coalesce("pos_reference", "pos_resolved", "pos_cid", "pos_bare")
    how = F.when(F.col("pos_reference").isNotNull(), "location").when(F.col("pos_resolved").isNotNull(), "resolved").when(F.col("pos_cid").isNotNull(), "cid").when(F.col("pos_bare").isNotNull(), "bare")
    found = out.select("capture_id", "reference", first.alias("pos"), how.alias("by"))
    # what is left is compared with the parts of its own capture only
    rest = found.where("pos is null").select("capture_id", "reference")
    decoded = lambda c: F.coalesce(F.try_url_decode(c), F.col(c)).alias("text")
    places = parts.where("length(location) > 8").join(rest.select("capture_id").distinct(), "capture_id", "left_semi").select("capture_id", decoded("location"), F.lit(None).cast("string").alias("reference"), F.col("pos").cast("long"))
    both = places.unionByName(rest.where("reference is not null").distinct().select("capture_id", decoded("reference"), "reference", F.lit(None).cast("long").alias("pos")))
    kind = references.schema["capture_id"].dataType.simpleString()
    last = both.groupBy("capture_id").applyInArrow(_contained, f"capture_id {kind}, reference string, last long").withColumn("last", F.col("last").cast(parts.schema["pos"].dataType))
    return found.join(last, ["capture_id", "reference"], "left").select("capture_id", "reference", F.coalesce("pos", "last").alias("pos"), F.coalesce("by", F.when(F.col("last").isNotNull(), "contained")).alias("by"))


def oversize_report(parts: DataFrame, limit: int = 20 << 20) -> DataFrame:
    """Captures above `limit` bytes: total, bytes in images that can be coded anew, their share, and bytes to be saved."""
    eligible = F.sum(F.when(F.col("type").isin(*ELIGIBLE), F.col("bytes")).otherwise(0))
    total = parts.groupBy("capture_id").agg(F.sum("bytes").alias("total"), eligible.alias("eligible")).where(F.col("total") > limit)
    return total.withColumns({"share": F.col("eligible") / F.col("total"), "to_save": F.col("total") - limit})
