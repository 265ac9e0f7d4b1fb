"""Queries over page content (D of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrarc.functions.content import ENTITIES, HIDDEN
from papyrarc.operators import html as H
from papyrarc.operators.markup import pages_markdown

from .base import sql_text, sql_text_of, table
from .base import sql_domain
from papyrarc.functions import urls
from .registry import Registry

registry = Registry()
query = registry.query

_SHOWN = "regexp_replace(html, '{}', ' ', 'g')".format(HIDDEN.replace("'", "''"))
_ARTICLE = f"regexp_extract({_SHOWN}, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1)"
_MAIN = f"coalesce(nullif({sql_text_of(_ARTICLE)}, ''), {sql_text('html')})"
_TITLE = sql_text_of("regexp_extract(regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g'), '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)")
#: Pages hold no images, forms or banners, so that some are put in, by the page's number.
_WITH_IMAGES = """concat(html, '<img src="/i/', cast(page_id as varchar), '.png" alt="a b" width=640><img srcset="/s,1.png 320w, /l.png 800w" width="400"><img src="data:x" width="1" height="1">')"""
_WITH_ACTIVE = """concat(html, CASE WHEN page_id % 2 = 0 THEN '<iframe src="x"></iframe><a href="javascript:go()" onclick="go()">x</a>' ELSE '<form><input></form><meta http-equiv="refresh" content="1">' END)"""
_WITH_OVERLAY = """concat(html, CASE page_id % 3 WHEN 0 THEN '<div id="onetrust-consent-sdk">Accept</div>' WHEN 1 THEN '<div class="my-cookie-bar" style="position: fixed">Accept</div>' ELSE '<div class="cookie">static</div>' END)"""


@query("d1_page_metadata", f"""SELECT page_id, {_TITLE} AS title, CAST(NULL AS VARCHAR) AS site_name, CAST(NULL AS VARCHAR) AS published_at, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
  CASE WHEN length({_MAIN}) >= 200 THEN 'article' ELSE 'full_page' END AS mode FROM pages""")  # fmt: skip
def d1(spark, sf):
    return H.page_metadata(table(spark, sf, "pages")).select("page_id", "title", "site_name", "published_at", "lang", "mode")


@query("d2_main_text", f"SELECT page_id, md5({_MAIN}) AS text_md5, length({_MAIN}) AS n FROM pages")
def d2(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", H.main_text("html").alias("t"))
    return rows.select("page_id", F.md5("t").alias("text_md5"), F.length("t").alias("n"))


@query("d3_best_containers", f"""SELECT page_id, 'article' AS tag, round(1.05, 6) AS score FROM (SELECT page_id, {sql_text_of(_ARTICLE)} AS t FROM pages) WHERE length(t) >= 200""")
def d3(spark, sf):
    pages = table(spark, sf, "pages").withColumn("target", H.main_text("html"))
    return H.best_containers(pages, "page_id", "html", "target").select("page_id", "tag", F.round("score", 6).alias("score"))


_IMAGES = r"""SELECT page_id, i AS "order", CASE i WHEN 0 THEN o || '/i/' || page_id || '.png' WHEN 1 THEN o || '/l.png' END AS original_url, CASE i WHEN 0 THEN 'a b' ELSE '' END AS alt, CASE i WHEN 0 THEN 640.0 WHEN 1 THEN 400.0 ELSE 1.0 END AS width, i = 2 AS tracking
  FROM (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS o, unnest([0, 1, 2]) AS i FROM pages)"""


@query("d4_image_sources", _IMAGES)
def d4(spark, sf):
    pages = table(spark, sf, "pages").selectExpr("page_id", "url", _WITH_IMAGES.replace("varchar", "string") + " AS html")
    return H.image_sources(pages, "page_id", "html", "url").select("page_id", "order", "original_url", "alt", "width", "tracking")


@query("d5_choose_image_source", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'b.png' WHEN event_id % 4 = 2 THEN 'f.png' WHEN w <= 320 THEN 'a,1.png' ELSE 'l.png' END AS source FROM (SELECT event_id, event_id * 13 % 1000 AS w FROM events)")
def d5(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id", "cast(event_id * 13 % 1000 as double) AS w", "CASE event_id % 4 WHEN 3 THEN 'a.png 1x, b.png 2x' WHEN 2 THEN NULL ELSE 'a,1.png 320w, l.png 800w' END AS srcset", "'f.png' AS src")
    return rows.select("event_id", H.choose_image_source(F.col("srcset"), F.col("src"), F.col("w")).alias("source"))


@query("d6_tracking_pixels", f"SELECT domain, count(*) * 3 AS images, count(*) AS tracking FROM (SELECT {sql_domain('url')} AS domain FROM pages) GROUP BY domain")
def d6(spark, sf):
    pages = table(spark, sf, "pages").selectExpr("page_id", "url", _WITH_IMAGES.replace("varchar", "string") + " AS html")
    images = H.image_sources(pages, "page_id", "html", "url").join(pages.select("page_id", urls.url_domain("url").alias("domain")), "page_id")
    return H.tracking_pixels(images, "domain")


@query("d7_active_content", f"""SELECT domain, count(*) + 0 AS pages, CAST(sum(scripts) AS BIGINT) AS scripts, count_if(e) AS frames, count_if(NOT e) * 2 AS forms, count_if(e) AS handlers, count_if(NOT e) AS refreshes, count_if(e) AS unsafe_links, CAST(0 AS BIGINT) AS active_left
  FROM (SELECT {sql_domain('url')} AS domain, len(regexp_extract_all(html, '(?i)<script\\b')) AS scripts, page_id % 2 = 0 AS e FROM pages) GROUP BY domain""")  # fmt: skip
def d7(spark, sf):
    pages = table(spark, sf, "pages").selectExpr("page_id", "url", _WITH_ACTIVE + " AS html")
    rows = pages.select(urls.url_domain("url").alias("domain"), *(c.alias(n) for n, c in H.active_content("html").items()), sum(H.active_content(H.strip_active("html")).values(), F.lit(0)).alias("left"))
    return rows.groupBy("domain").agg(F.count("*").alias("pages"), *(F.sum(n).alias(n) for n in H.ACTIVE), F.sum("left").alias("active_left"))


@query("d8_overlay_audit", f"SELECT domain, mark, count(*) AS n FROM (SELECT {sql_domain('url')} AS domain, CASE page_id % 3 WHEN 0 THEN 'onetrust-consent-sdk' WHEN 1 THEN 'cookie' END AS mark FROM pages) WHERE mark IS NOT NULL GROUP BY ALL")
def d8(spark, sf):
    pages = table(spark, sf, "pages").selectExpr("page_id", "url", _WITH_OVERLAY + " AS html")
    found = H.overlay_tags(pages, "page_id", "html").join(pages.select("page_id", urls.url_domain("url").alias("domain")), "page_id")
    return found.groupBy("domain", "mark").agg(F.count("*").alias("n"))


_H1 = sql_text_of(f"regexp_extract({_SHOWN}, '(?is)<h1\\b[^>]*>(.*?)</h1\\s*>', 1)")


@query("d9_headings", f"SELECT page_id, t AS text FROM (SELECT page_id, {_H1} AS t FROM pages) WHERE t <> ''")
def d9(spark, sf):
    return H.page_blocks(table(spark, sf, "pages"), "page_id", "html").where("kind = 'h1'").select("page_id", "text")


_LI = f"regexp_extract_all({_SHOWN}, '(?is)<li\\b[^>]*>(.*?)</li\\s*>', 1)"


@query("d9_list_items", f"SELECT page_id, {sql_text_of('x')} AS text, count(*) AS n FROM (SELECT page_id, unnest({_LI}) AS x FROM pages) GROUP BY ALL HAVING text <> ''")
def d9_items(spark, sf):
    return H.page_blocks(table(spark, sf, "pages"), "page_id", "html").where("kind = 'li'").groupBy("page_id", "text").agg(F.count("*").alias("n"))


#: What pages lack: lists in lists, a table with an empty cell, a linked picture, code with its language, quotes and a link that leads nowhere.
_RICH = """'<ol><li>first ' || page_id || '<ul><li><em>in</em><li><code>x_' || page_id || '</code></ul><li>second</ol><table><tr><th>a<th>b<th>c<tr><td>' || page_id || '<td><td>x|y</table><figure><a href="/full/' || page_id || '.png"><img src="s.png" alt="[a]"></a><figcaption>cap</figcaption></figure><pre><code class="language-sql">SELECT ' || page_id || ' &lt; 3</code></pre><div><div>inner</div>tail</div><blockquote>q<br>r</blockquote><a href="mailto:x">none</a>'"""
_WITH_RICH = f"replace(html, '<footer', {_RICH} || '<footer')"
_RICH_MARKDOWN = r"""E'\n\n1. first ' || page_id || E'\n\n   - *in*\n   - `x_' || page_id || E'`\n2. second\n\n| a | b | c |\n| --- | --- | --- |\n| ' || page_id || E' |  | x\\|y |\n\n![\\[a\\]](' || o || '/full/' || page_id || E'.png)\n*cap*\n\n```sql\nSELECT ' || page_id || E' < 3\n```\n\ninnertail\n\n> q  \n> r\n\nnone'"""


def _decoded(text: str) -> str:
    """Character references of a text in DuckDB."""
    for name, value in (*ENTITIES.items(), ("&amp;", "&")):
        text = "replace({}, '{}', '{}')".format(text, name, value.replace("'", "''"))
    return text


def _address(href: str) -> str:
    """A path on the page's host, percent-encoded, in DuckDB."""
    found = f"url_encode({_decoded(href)})"
    for plain in "/,&;='":
        found = "replace({}, '%{:02X}', '{}')".format(found, ord(plain), plain.replace("'", "''"))
    return f"o || {found}"


#: Pages hold one list of links, then headings and paragraphs, of which those with bold text have no end tags.
_LINK = "'- [' || " + _decoded("regexp_extract(x, '>([^<]*)</a>', 1)") + " || '](' || " + _address("""regexp_extract(x, 'href="([^"]*)"', 1)""") + " || ')'"
_TOP = _decoded(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(top, '<h1>\s*([^<]*?)\s*</h1>', E'\n\n# \\1\n\n', 'g'), '<p><b>([^<]*)<br>', E'\n\n**\\1  \n**\n\n', 'g'), '<p>\s*([^<]*?)\s*</p>', E'\n\n\\1\n\n', 'g'), '<[^>]*>', '', 'g')")
_FOOT = _decoded("regexp_replace(regexp_extract(html, '(?s)<footer[^>]*>(.*)$', 1), '<[^>]*>', '', 'g')")
_MARKDOWN = rf"""md AS (SELECT page_id, url, trim(regexp_replace(array_to_string(list_transform(links, lambda x: {_LINK}), E'\n') || E'\n\n' || {_TOP} || {_RICH_MARKDOWN} || {_FOOT}, E'\n{{3,}}', E'\n\n', 'g'), E' \n') AS markdown
  FROM (SELECT page_id, url, html, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS o, regexp_extract_all(html, '<li>.*?</li>') AS links, regexp_replace(regexp_extract(html, '(?s)</nav>(.*?)<footer', 1), '<!--.*?-->', '', 'g') AS top FROM pages))"""


def rich_markdown(spark, sf, id_col="page_id"):
    """Pages with rich content, as Markdown."""
    pages = table(spark, sf, "pages").selectExpr("page_id", "url", _WITH_RICH + " AS html")
    return pages_markdown(pages, "page_id", "html", "url").withColumnRenamed("page_id", id_col)


@query("d9_markdown", f"WITH {_MARKDOWN} SELECT page_id, markdown, CAST(1 AS BIGINT) AS images FROM md")
def d9_markdown(spark, sf):
    return rich_markdown(spark, sf)


@query("d14_retained_code_blocks", "SELECT doc_id, CAST(2 AS BIGINT) AS protected, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS BIGINT) AS retained FROM documents")
def d14(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("code"))
    before = docs.union(docs.withColumn("code", F.concat(F.col("code"), F.lit("\r\n"))))
    after = docs.union(docs.where("doc_id % 3 <> 0")).withColumn("code", F.concat(F.lit(" \n"), F.col("code")))
    return H.retained_code_blocks(before, after, "doc_id", "code")
