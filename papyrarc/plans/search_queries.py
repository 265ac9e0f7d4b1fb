"""Queries of full-text search (F, E6 and the whole path of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrarc.operators import browse as B
from papyrarc.operators import html as H
from papyrarc.operators import search as S
from papyrarc.operators.segments import add_batch, read_segments

from papyrarc.functions import urls

from .base import CAPTURES, capture_bodies, capture_metadata, scratch, sql_domain, table
from .html_queries import _MAIN, _TITLE
from .registry import Registry

registry = Registry()
query = registry.query

_WORDS = f"regexp_extract_all(translate(regexp_replace(lower({{}}), '\\p{{Mn}}', '', 'g'), '{S.MARKED}', '{S.PLAIN}'), '[\\p{{L}}\\p{{N}}]+')"
_TOKENS = "tok AS (SELECT doc_id AS doc, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT doc_id, " + _WORDS.replace("{}", "text") + " AS w FROM documents)), stats AS (SELECT doc_id AS doc, len(" + _WORDS.replace("{}", "text") + ") AS length FROM documents)"


def _bm25(terms: list[str]) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""p AS (SELECT doc, term, count(*) AS tf FROM tok WHERE term IN ({listed}) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY term), pop AS (SELECT count(*) AS n, avg(length) AS avgdl FROM stats),
  scores AS (SELECT p.doc, -sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avgdl))) AS bm25, count(*) AS matched FROM p JOIN df USING (term) JOIN stats USING (doc), pop GROUP BY p.doc)"""


def _index(spark, sf):
    return S.build_index(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", ["text"])


@query("f1_tokens", "SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS words FROM (SELECT doc_id, " + _WORDS.replace("{}", "text") + " AS w FROM documents)")
def f1(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", S.tokens("text").alias("w"))
    return rows.select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ")).alias("words"))


@query("f2_stems")
def f2(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(S.tokens("text")).alias("term"))
    return S.stem_terms(words).groupBy("term").agg(F.count("*").alias("n"))


@query("f3_postings", f"WITH {_TOKENS} SELECT doc, term, count(*) AS tf, CAST(sum(pos) AS BIGINT) AS places FROM tok GROUP BY ALL")
def f3(spark, sf):
    return _index(spark, sf).postings.select("doc", "term", "tf", F.aggregate("positions", F.lit(0).cast("long"), lambda a, x: a + x).alias("places"))


@query("f3_doc_stats", f"WITH {_TOKENS} SELECT doc, CAST(length AS BIGINT) AS length FROM stats")
def f3_stats(spark, sf):
    return _index(spark, sf).doc_stats


@query("f4_bm25", f"WITH {_TOKENS}, {_bm25(['mit', 'license'])} SELECT doc, round(bm25, 6) AS bm25, matched FROM scores")
def f4(spark, sf):
    return S.bm25(_index(spark, sf), ["mit", "license"]).select("doc", F.round("bm25", 6).alias("bm25"), "matched")


@query("f5_boolean_search", f"WITH {_TOKENS}, {_bm25(['the', 'license'])} SELECT doc, round(bm25, 6) AS bm25 FROM scores WHERE matched = 2 AND doc NOT IN (SELECT doc FROM tok WHERE term = 'apache') AND doc IN (SELECT doc FROM tok WHERE starts_with(term, 're'))")
def f5(spark, sf):
    return S.search(_index(spark, sf), all_of=["the", "license"], none_of=["apache"], prefixes=["re"]).select("doc", F.round("bm25", 6).alias("bm25"))


@query("f6_phrase_search", f"WITH {_TOKENS} SELECT a.doc, count(*) AS n, min(a.pos) AS first FROM tok a JOIN tok b ON a.doc = b.doc AND b.pos = a.pos + 1 JOIN tok c ON a.doc = c.doc AND c.pos = a.pos + 2 WHERE a.term = 'general' AND b.term = 'public' AND c.term = 'license' GROUP BY a.doc")
def f6(spark, sf):
    return S.phrase(_index(spark, sf), ["general", "public", "license"]).select("doc", F.size("starts").alias("n"), F.element_at("starts", 1).alias("first"))


_NEW = "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || ' amended' ELSE text END AS text FROM documents WHERE doc_id % 5 <> 1"


@query("f7_updated_index", f"WITH new AS ({_NEW}), t AS (SELECT doc_id AS doc, unnest({_WORDS.replace('{}', 'text')}) AS term FROM new) SELECT term, count(*) AS tf, count(DISTINCT doc) AS docs FROM t GROUP BY term")
def f7(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    after = docs.where("doc_id % 5 <> 1").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" amended"))).otherwise(F.col("text")))
    changed = S.update_index(S.build_index(docs.where("doc_id % 5 <> 2"), "doc_id", ["text"]), docs.where("doc_id % 5 <> 2"), after, "doc_id", ["text"])
    return changed.postings.groupBy("term").agg(F.sum("tf").alias("tf"), F.count_distinct("doc").alias("docs"))


#: Words of licenses and their stems by the published algorithm.
_STEMMED = {"license": "licens", "licenses": "licens", "licensed": "licens", "licensing": "licens", "permission": "permiss", "permissions": "permiss", "granted": "grant", "general": "gener", "public": "public", "copying": "copi", "copies": "copi", "reserved": "reserv", "rights": "right", "distribution": "distribut", "unauthorized": "unauthor", "prohibited": "prohibit", "released": "releas", "available": "avail", "creative": "creativ", "commons": "common", "attribution": "attribut", "apache": "apach", "version": "version", "this": "thi", "the": "the"}


@query("f2_known_stems", f"WITH {_TOKENS}, known AS (SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{s}')" for w, s in _STEMMED.items()) + ") AS k(word, stem)) SELECT stem, count(*) AS n FROM tok JOIN known ON word = term GROUP BY stem")
def f2_known(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(S.tokens("text")).alias("term")).where(F.col("term").isin(list(_STEMMED)))
    return S.stem_terms(words).groupBy(F.col("term").alias("stem")).agg(F.count("*").alias("n"))


def _stemmed(terms: dict[str, list[str]]) -> str:
    """A table of tokens in which all forms of a word are written as its stem."""
    forms = "CASE " + " ".join("WHEN term IN (" + ", ".join(f"'{f}'" for f in words) + f") THEN '{s}'" for s, words in terms.items()) + " ELSE term END"
    return _TOKENS.replace("tok AS (", "plain AS (").replace(", stats AS", f", tok AS (SELECT doc, {forms} AS term, pos FROM plain), stats AS")


_FORMS = {"licens": ["license", "licenses", "licensed", "licensing", "licens"], "right": ["right", "rights", "righted", "righting"], "reserv": ["reserved", "reserve", "reserves", "reserving", "reserv"]}


@query("f5_stemmed_search", f"WITH {_stemmed(_FORMS)}, {_bm25(['licens'])} SELECT doc, round(bm25, 6) AS bm25 FROM scores")
def f5_stemmed(spark, sf):
    """A search for one form of a word over an index of stems finds all forms."""
    return S.search(S.build_index(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", ["text"], stems=True), any_of=["licenses"]).select("doc", F.round("bm25", 6).alias("bm25"))


@query("f6_stemmed_phrase", f"WITH {_stemmed(_FORMS)} SELECT a.doc, count(*) AS n FROM tok a JOIN tok b ON a.doc = b.doc AND b.pos = a.pos + 1 WHERE a.term = 'right' AND b.term = 'reserv' GROUP BY a.doc")
def f6_stemmed(spark, sf):
    index = S.build_index(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", ["text"], stems=True)
    return S.phrase(index, ["right", "reserve"]).select("doc", F.size("starts").cast("long").alias("n"))


FIELDS = ("title", "site_name", "author", "source_url", "domain", "text")


def six_fields(spark, sf):
    """Captures with all fields that a collection is searched by; these pages name no author."""
    pages = H.page_metadata(table(spark, sf, "pages"))
    return pages.select(F.col("page_id").alias("capture_id"), "title", "site_name", F.lit(None).cast("string").alias("author"), F.col("url").alias("source_url"), urls.url_domain("url").alias("domain"), "text")


_SIX = f"""f AS (SELECT page_id AS doc, coalesce({_TITLE}, '') AS title, url AS source_url, {sql_domain('url')} AS domain, {_MAIN} AS text FROM pages), w AS (SELECT doc, {_WORDS.replace('{}', 'title')} AS title, {_WORDS.replace('{}', 'source_url')} AS source_url, {_WORDS.replace('{}', 'domain')} AS domain, {_WORDS.replace('{}', 'text')} AS text FROM f),
  stats AS (SELECT doc, len(title) + len(source_url) + len(domain) + len(text) AS length FROM w)"""


@query("f5_field_search", f"WITH {_SIX}, tok AS (SELECT doc, unnest(title || domain) AS term FROM w), {_bm25(['the', 'example'])} SELECT doc, round(bm25, 6) AS bm25, matched FROM scores WHERE matched = 2 AND doc NOT IN (SELECT doc FROM tok WHERE term = 'org')")
def f5_field(spark, sf):
    """Terms in the title and domain of an index of six fields."""
    found = S.search(S.build_index(six_fields(spark, sf), "capture_id", list(FIELDS)), all_of=["the", "example"], none_of=["org"], fields=["title", "domain"])
    return found.select("doc", F.round("bm25", 6).alias("bm25"), "matched")


@query("f7_stored_index", f"WITH {_TOKENS}, {_bm25(['license', 'public'])} SELECT doc, round(bm25, 6) AS bm25, matched FROM scores WHERE doc IN (SELECT doc FROM tok WHERE starts_with(term, 'lic'))")
def f7_stored(spark, sf):
    """A search over an index that was written, sorted by term, and read again."""
    path = scratch(spark, "index")
    S.write_index(_index(spark, sf), path)
    return S.search(S.read_index(spark, path), any_of=["license", "public"], prefixes=["lic"]).select("doc", F.round("bm25", 6).alias("bm25"), "matched")


@query("f7_segments", f"WITH new AS ({_NEW}), documents AS (SELECT * FROM new), {_TOKENS}, {_bm25(['license', 'amended'])} SELECT doc, round(bm25, 6) AS bm25, matched FROM scores")
def f7_segments(spark, sf):
    """An index in segments after four batches, one of which comes twice: most documents, others, deletions, changed texts."""
    path = scratch(spark, "segments")
    docs = table(spark, sf, "documents").select("doc_id", "text", F.lit(False).alias("deleted"))
    gone, changed = F.col("doc_id") % 5 == 1, docs.where("doc_id % 7 = 0 and doc_id % 5 <> 1").withColumn("text", F.concat("text", F.lit(" amended")))
    batches = [docs.where("doc_id % 5 <> 2"), docs.where("doc_id % 5 = 2"), docs.where(gone).select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(True).alias("deleted")), changed]
    for k in (0, 1, 2, 2, 3):
        add_batch(batches[k], k, path, "doc_id", ["text"], "deleted")
    return S.bm25(read_segments(spark, path), ["license", "amended"]).select("doc", F.round("bm25", 6).alias("bm25"), "matched")


@query("f5_best_documents", f"WITH {_TOKENS}, {_bm25(['license', 'public', 'the'])} SELECT doc, round(bm25, 6) AS bm25, matched FROM scores ORDER BY scores.bm25, doc LIMIT 50")
def f5_best(spark, sf):
    """The fifty best of a stored index, whose blocks are ruled out by their bounds."""
    path = scratch(spark, "index")
    S.write_index(_index(spark, sf), path)
    found = S.best_documents(S.read_index(spark, path), ["license", "public", "the"], 50, first_blocks=4, few=0)
    return found.select("doc", F.round("bm25", 6).alias("bm25"), "matched")


@query("e6_match_filter", f"WITH {_TOKENS}, {CAPTURES} SELECT capture_id, domain FROM captures WHERE status = 'succeeded' AND capture_id IN (SELECT doc FROM tok WHERE term = 'the')")
def e6(spark, sf):
    found = S.search(_index(spark, sf), any_of=["the"]).select(F.col("doc").alias("capture_id"))
    return B.filter_captures(capture_metadata(spark, sf), matches=found).select("capture_id", "domain")


@query("entry_search", f"""WITH {CAPTURES}, m AS (SELECT page_id AS doc, {_MAIN} AS text FROM pages), w AS (SELECT doc, {_WORDS.replace('{}', 'text')} AS w FROM m), tok AS (SELECT doc, unnest(w) AS term FROM w), stats AS (SELECT doc, len(w) AS length FROM w), {_bm25(['the', 'that'])}
  SELECT capture_id, domain, round(bm25, 6) AS bm25, row_number() OVER (ORDER BY round(bm25, 6), captured_at DESC, capture_id DESC) AS place FROM captures JOIN scores ON doc = capture_id WHERE status = 'succeeded' ORDER BY place LIMIT 20""")  # fmt: skip
def entry_search(spark, sf):
    """Pages to captures, main text, index, and the twenty best of succeeded captures for two terms."""
    texts = capture_bodies(spark, sf).select("capture_id", H.main_text("body").alias("text"))
    scores = S.search(S.build_index(texts, "capture_id", ["text"]), any_of=["the", "that"])
    top = S.top_results(scores, B.filter_captures(capture_metadata(spark, sf)), 20)
    return top.select("capture_id", "domain", F.round("bm25", 6).alias("bm25"), "place")
