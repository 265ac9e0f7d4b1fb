"""Tables out of HTML: metadata, main text, images, active content, overlays, content blocks and code blocks.

Elements that lie inside each other, and Markdown, come from one pass over a page's tags (`markup`). Elsewhere patterns cover what the
operators need; there attributes with `>` inside quotes are read as ending at the first mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrarc.functions.content import HIDDEN, code_signature, text_of, visible_text, word_coverage
from papyrarc.functions.urls import resolve_href
from papyrarc.operators.markup import page_elements

MIN_ARTICLE = 200
#: What active or external content looks like, by class. Fixed values.
ACTIVE = {
    "scripts": r"(?i)<script\b", "frames": r"(?i)<i?frame\b", "forms": r"(?i)<(?:form|input|button|select|textarea)\b", "handlers": r"(?i)<[a-z][^>]*\son[a-z]+\s*=",
    "refreshes": r"(?i)<meta\b[^>]*http-equiv\s*=\s*[\"']?refresh", "unsafe_links": r"(?i)<[a-z][^>]*\s(?:href|src)\s*=\s*[\"']?\s*(?:javascript|vbscript|data):",
}
#: Marks of consent banners. Fixed values.
OVERLAYS = ("fc-consent-root", "cookie-law-info-bar", "cookie-law-info-again", "onetrust-consent-sdk", "qc-cmp2-container", "cc-window")
OVERLAY_WORDS = ("cookie", "consent", "gdpr")



def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute: quoted or bare; null if it has none."""
    rest = rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    found = F.concat(*(F.regexp_extract(tag, rest, i) for i in (1, 2, 3)))
    return F.when(F.regexp_like(tag, F.lit(rf"(?is)\s{name}\s*=")), found)


def _meta(html: Column, key: str, name: str) -> Column:
    tag = F.regexp_extract(html, rf"(?is)<meta\b[^>]*\s{key}\s*=\s*[\"']{name}[\"'][^>]*>", 0)
    return F.when(tag != "", attribute(tag, "content"))


def container(html: Column, tag: str) -> Column:
    """Content of the first element of a kind; null without one."""
    return F.nullif(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1), F.lit(""))


def main_text(html: Column | str) -> Column:
    """Text of the article, else of the main container, else of the body. Hidden parts are taken out before tags."""
    c = F.col(html) if isinstance(html, str) else html
    shown = F.regexp_replace(c, HIDDEN, " ")
    return F.coalesce(F.nullif(text_of(container(shown, "article")), F.lit("")), F.nullif(text_of(container(shown, "main")), F.lit("")), visible_text(c))


def page_metadata(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds title, site_name, published_at, lang, text and mode. Metadata is read from tags as written."""
    html = F.col(html_col)
    head = F.regexp_replace(html, r"(?is)<!--.*?-->", " ")
    title = F.coalesce(_meta(head, "property", "og:title"), F.nullif(text_of(F.regexp_extract(head, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)), F.lit("")))
    time_tag = F.regexp_extract(head, r"(?is)<time\b[^>]*\sdatetime\s*=[^>]*>", 0)
    published = F.coalesce(_meta(head, "property", "article:published_time"), _meta(head, "name", "date"), F.when(time_tag != "", attribute(time_tag, "datetime")))
    return pages.withColumns({
        "title": title, "site_name": _meta(head, "property", "og:site_name"), "published_at": published,
        "lang": attribute(F.regexp_extract(head, r"(?is)<html\b[^>]*>", 0), "lang"), "text": main_text(html),
    }).withColumn("mode", F.when(F.length("text") >= MIN_ARTICLE, "article").otherwise("full_page"))


def best_containers(pages: DataFrame, id_col: str, html_col: str, target_col: str, target_images: Column | None = None) -> DataFrame:
    """The article or main container that best fits a target text: (id_col, tag, score, ratio, coverage, images).

    score = coverage - |1 - ratio|, and 0.05 more for an article. Ratio must be 0.8 to 1.25, coverage 0.9, and images
    enough; a main container that holds a fitting article is left out.
    """
    least = F.lit(0) if target_images is None else target_images
    shown = pages.select(id_col, F.col(target_col).alias("target"), least.alias("least"), F.regexp_replace(F.col(html_col), HIDDEN, " ").alias("shown"))
    rows = page_elements(shown, id_col, "shown", ("article", "main"), keep=("target", "least")).select(id_col, "target", "least", F.col("order").alias("at"), F.struct("tag", F.concat("opening", "inner").alias("part")).alias("c"))
    rows = rows.withColumn("text", text_of(F.col("c.part"))).withColumn("images", F.size(F.regexp_extract_all(F.col("c.part"), F.lit(r"(?i)<img\b"), F.lit(0))))
    rows = rows.where(F.length("target") >= MIN_ARTICLE).withColumn("ratio", F.length("text") / F.length("target")).withColumn("coverage", word_coverage("target", "text"))
    fits = rows.where(F.col("ratio").between(0.8, 1.25) & (F.col("coverage") >= 0.9))
    articles = fits.where("c.tag = 'article'").select(F.col(id_col).alias("_id"), F.col("c.part").alias("inner"))
    outer = F.col("c.part").contains(F.col("inner")) & (F.col("c.tag") == "main") & (F.col(id_col) == F.col("_id"))
    left = fits.where(F.col("images") >= F.when(F.col("least") > 0, F.greatest(F.col("least") + 2, F.ceil(F.col("least") * 1.5))).otherwise(0)).join(articles, outer, "left_anti")
    scored = left.withColumn("score", F.col("coverage") - F.abs(1 - F.col("ratio")) + F.when(F.col("c.tag") == "article", 0.05).otherwise(0.0))
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("score"), "at"))).where("n = 1")
    return best.select(id_col, F.col("c.tag").alias("tag"), "score", "ratio", "coverage", "images")


def choose_image_source(srcset: Column, src: Column, width: Column) -> Column:
    """The candidate of a srcset: least width that suffices, else the largest; else the highest density; else src.

    A comma parts candidates only after a descriptor, as addresses may hold commas.
    """
    described = F.regexp_extract_all(srcset, F.lit(r"(?:^|,\s*)(\S+)\s+(\d+(?:\.\d+)?)([wx])"), F.lit(0))
    candidate = lambda m: F.struct(
        F.regexp_extract(m, r"^,?\s*(\S+)\s+", 1).alias("url"), F.regexp_extract(m, r"\s(\d+(?:\.\d+)?)[wx]$", 1).cast("double").alias("n"), F.regexp_extract(m, r"([wx])$", 1).alias("unit")
    )
    all_ = F.transform(described, candidate)
    by_size = lambda a: F.array_sort(F.transform(a, lambda c, i: F.struct(c["n"].alias("n"), i.alias("i"), c["url"].alias("url"))))
    wide = by_size(F.filter(all_, lambda c: c["unit"] == "w"))
    dense = by_size(F.filter(all_, lambda c: c["unit"] == "x"))
    densest = F.try_element_at(F.filter(dense, lambda c: c["n"] == F.try_element_at(dense, F.lit(-1))["n"]), F.lit(1))["url"]
    enough = F.try_element_at(F.filter(wide, lambda c: c["n"] >= width), F.lit(1))["url"]
    plain = F.try_element_at(F.filter(F.transform(F.split(srcset, r",\s+"), lambda u: F.trim(u)), lambda u: (u != "") & ~u.rlike(r"\s")), F.lit(1))
    chosen = F.when(F.size(wide) > 0, F.coalesce(F.when(width.isNotNull(), enough), F.try_element_at(wide, F.lit(-1))["url"])).when(F.size(dense) > 0, densest).otherwise(plain)
    return F.coalesce(F.when(F.coalesce(srcset, F.lit("")) != "", chosen), src)


def image_sources(pages: DataFrame, id_col: str, html_col: str, base_col: str) -> DataFrame:
    """A row for each image, in order: (id_col, order, original_url, alt, title, width, height, tracking, warning)."""
    tags = pages.select(id_col, base_col, F.posexplode(F.regexp_extract_all(F.regexp_replace(F.col(html_col), r"(?is)<!--.*?-->", " "), F.lit(r"(?is)<img\b[^>]*>"), F.lit(0))).alias("order", "tag"))
    tag = F.col("tag")
    number = lambda name: attribute(tag, name).try_cast("double")
    sized = tags.withColumn("width", number("width")).withColumn("height", number("height"))
    source = choose_image_source(attribute(tag, "srcset"), attribute(tag, "src"), F.col("width"))
    url = F.when(source.isNotNull() & ~source.rlike(r"^(#|$)"), resolve_href(source, base_col))
    return sized.withColumn("original_url", F.when(url.rlike(r"^https?://"), url)).select(
        id_col, "order", "original_url", F.coalesce(attribute(tag, "alt"), F.lit("")).alias("alt"), attribute(tag, "title").alias("title"), "width", "height",
        (F.coalesce(F.col("width") <= 2, F.lit(False)) | F.coalesce(F.col("height") <= 2, F.lit(False))).alias("tracking"),
        F.when(F.col("original_url").isNull(), F.concat(F.lit("picture "), (F.col("order") + 1).cast("string"), F.lit(": no address on the web is given"))).alias("warning"),
    )


def tracking_pixels(images: DataFrame, by: str) -> DataFrame:
    """Images of at most two pixels in one direction, by a column: (by, images, tracking)."""
    return images.groupBy(by).agg(F.count("*").alias("images"), F.count_if("tracking").alias("tracking"))


def active_content(html: Column | str) -> dict[str, Column]:
    """How often each class of active content occurs."""
    c = F.col(html) if isinstance(html, str) else html
    return {name: F.size(F.regexp_extract_all(c, F.lit(pattern), F.lit(0))).cast("long") for name, pattern in ACTIVE.items()}


#: Elements that go with all they hold, and tags that go alone. Fixed values.
STRIPPED_WHOLE = ("script", "noscript", "iframe", "object", "form", "template", "svg", "style")


def strip_active(html: Column | str) -> Column:
    """HTML without scripts, frames, forms, handlers, refreshes and unsafe links."""
    c = F.col(html) if isinstance(html, str) else html
    for tag in STRIPPED_WHOLE:
        c = F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    c = F.regexp_replace(c, r"(?is)</?(?:script|noscript|i?frame|frameset|object|embed|applet|form|input|button|select|textarea|link)\b[^>]*>", "")
    c = F.regexp_replace(c, r"(?is)<meta\b[^>]*http-equiv\s*=\s*[\"']?refresh[^>]*>", "")
    c = F.regexp_replace(c, r"(?is)(<[a-z][^>]*?)\son[a-z]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "$1")
    return F.regexp_replace(c, r"(?is)(\shref\s*=\s*[\"']?)\s*(?:javascript|vbscript|data):[^\"'\s>]*", "$1#")


def overlay_tags(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Opening tags of consent overlays that hold at most 4000 characters of text: (id_col, mark, tag)."""
    marks = "|".join((*OVERLAYS, *OVERLAY_WORDS))
    found = page_elements(pages, id_col, html_col, ("div", "section", "aside", "dialog", "form"), rf"(?:id|class)\s*=.*(?:{marks})")
    tag = F.lower("opening")
    named = F.array(*(F.when(tag.rlike(rf"(?:id|class)\s*=\s*[\"'][^\"']*\b{m}\b"), m) for m in OVERLAYS))
    fixed = tag.rlike(r"style\s*=\s*[\"'][^\"']*(?:position\s*:\s*fixed|z-index\s*:)")
    worded = F.array(*(F.when(fixed & tag.rlike(rf"(?:id|class)\s*=\s*[\"'][^\"']*{w}"), w) for w in OVERLAY_WORDS))
    mark = F.try_element_at(F.filter(F.concat(named, worded), lambda m: m.isNotNull()), F.lit(1))
    return found.where(F.length(text_of("inner")) <= 4000).select(id_col, mark.alias("mark"), tag.alias("tag")).where("mark is not null")


def page_blocks(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Content blocks in order: (id_col, pos, kind, text). Unclosed blocks end at the next block's tag."""
    html = F.regexp_replace(F.col(html_col), HIDDEN, " ")
    # blocks may end where the next begins, so the closing mark must not be consumed: tags are cut first
    cut = F.split(html, r"(?is)(?=<(?:h[1-6]|p|li|pre|blockquote|tr|div|ul|ol|table|section|article|main|nav|body|head|title)\b)|(?<=</(?:h[1-6]|p|li|pre|blockquote|tr)>)")
    parts = pages.select(id_col, F.posexplode(F.filter(cut, lambda x: x.rlike(r"(?is)^<(?:h[1-6]|p|li|pre|blockquote|tr)\b"))).alias("pos", "part"))
    kind = F.lower(F.regexp_extract("part", r"^<([a-zA-Z0-9]+)", 1))
    body = F.regexp_replace("part", r"(?is)^<[^>]*>|</(?:h[1-6]|p|li|pre|blockquote|tr|div|ul|ol|table|section|article|main|nav|body|html)\s*>.*$", "")
    cells = F.array_join(F.transform(F.filter(F.split(body, r"(?i)</t[dh]\s*>|<t[dh]\b[^>]*>"), lambda c: F.trim(c) != ""), lambda c: F.replace(text_of(c), F.lit("|"), F.lit("\\|"))), " | ")
    text = F.when(kind == "pre", code_signature(F.regexp_replace(body, r"(?s)<[^>]*>", ""))).when(kind == "tr", cells).otherwise(text_of(body))
    return parts.select(id_col, "pos", kind.alias("kind"), text.alias("text")).where("text <> ''")


def retained_code_blocks(before: DataFrame, after: DataFrame, id_col: str, code_col: str) -> DataFrame:
    """(id_col, protected, retained): how many code blocks, counted as a multiset, are there before and still after."""
    count = lambda df, n: df.groupBy(id_col, F.sha2(code_signature(code_col), 256).alias("signature")).agg(F.count("*").alias(n))
    both = count(before, "n1").join(count(after, "n2"), [id_col, "signature"], "left")
    return both.groupBy(id_col).agg(F.sum("n1").alias("protected"), F.sum(F.least("n1", F.coalesce("n2", F.lit(0)))).alias("retained"))
