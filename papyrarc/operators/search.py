"""Full-text search: tokens, stems, postings, BM25, boolean, prefix and phrase search, and upkeep of the index."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Letters that are a plain letter with marks, and the letters they are searched as.
MARKED = "".join(c for c in map(chr, range(0xC0, 0x2000)) if c == c.lower() and len(unicodedata.normalize("NFD", c)) > 1 and "a" <= unicodedata.normalize("NFD", c)[0] <= "z")
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in MARKED)


def tokens(text: Column | str) -> Column:
    """Array of a text's words: runs of letters and digits, lower-cased, without marks on Latin letters, be they part of the letter or after it."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.translate(F.regexp_replace(F.lower(c), r"\p{Mn}", ""), MARKED, PLAIN), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


@dataclass(frozen=True)
class Index:
    postings: DataFrame  # term, doc, field, tf, length (of the document), positions
    doc_stats: DataFrame  # doc, length
    stems: bool = False  # whether terms are stems; then those of a query are stemmed too
    words: DataFrame | None = None  # doc, length, words (of each field) of an index that is not stored

    def vocabulary(self) -> DataFrame:
        """(term, documents): in how many documents each term stands."""
        return self.postings.groupBy("term").agg(F.count_distinct("doc").alias("documents"))

    def terms(self, words: list[str]) -> list[str]:
        """The index's terms for a query's words."""
        return [stem(w) for w in words] if self.stems else list(words)


def _postings(stems: bool, documents: bool = False):
    """Each document's terms with their places; a document is one row, so nothing is shuffled. With `documents` a row without a term for each row read, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ends = np.asarray(lists.offsets)
            words = lists.flatten()
            if documents:
                n, no_places = batch.num_rows, pa.ListArray.from_arrays(pa.array([0] * (batch.num_rows + 1), pa.int32()), pa.array([], pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), batch.column(0), batch.column(1), pa.array([0] * n), batch.column(2), no_places], names=["term", "doc", "field", "tf", "length", "positions"])
            if not len(words):
                continue
            coded = words.dictionary_encode()
            code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
            if stems:
                again = pa.array([stem(w) for w in names.to_pylist()], pa.string()).dictionary_encode()
                code, names = again.indices.to_numpy().astype(np.int64)[code], again.dictionary
            ends = ends - ends[0]
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            key = row * len(names) + code
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order], prepend=-1))
            place = (order - ends[:-1][row[order]]).astype(np.int32)
            at = order[cuts]
            positions = pa.ListArray.from_arrays(pa.array(np.r_[cuts, len(order)].astype(np.int32)), pa.array(place))
            rows = pa.array(row[at])
            yield pa.RecordBatch.from_arrays([names.take(pa.array(code[at])), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.diff(np.r_[cuts, len(order)])), batch.column(2).take(rows), positions], names=["term", "doc", "field", "tf", "length", "positions"])

    return run


def build_index(docs: DataFrame, id_col: str, fields: list[str], stems: bool = False) -> Index:
    """Positional postings of each field and the number of tokens of each document, of unique ids. A null field has no tokens."""
    of = F.array(*(F.struct(F.lit(f).alias("field"), tokens(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias("t")) for f in fields))
    words = docs.select(F.col(id_col).alias("doc"), of.alias("words")).withColumn("length", F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.size(w["t"])))
    return Index(_lists(words, _postings(stems)), words.select("doc", "length"), stems, words)


def _lists(words: DataFrame, read) -> DataFrame:
    rows = words.select("doc", "length", F.explode("words").alias("x")).select("doc", "x.field", "length", "x.t")
    return rows.mapInArrow(read, f"term string, doc {words.schema['doc'].dataType.simpleString()}, field string, tf long, length long, positions array<int>")


def read_once(index: Index, path: str) -> tuple[DataFrame, DataFrame]:
    """Postings and documents of an index, written below `path` in one pass over the texts: sorting and counting read what was written."""
    if index.words is None:
        return index.postings, index.doc_stats
    _lists(index.words, _postings(index.stems, documents=True)).write.mode("overwrite").parquet(path)
    rows = index.words.sparkSession.read.parquet(path)
    first = index.words.select(F.col("words")[0]["field"].alias("f")).limit(1).collect()
    return rows.where("term is not null"), rows.where(F.col("term").isNull() & (F.col("field") == (first[0].f if first else ""))).select("doc", "length")


def forget(spark: SparkSession, path: str) -> None:
    """Delete a folder that no later plan reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Documents of similar length lie in one block of a stored index; a block has about so many at most.
BLOCK_DOCS = 50_000


def _block(n_docs: int) -> Column:
    """The block of a document by its length, an eighth of an octave wide, and by its id where that holds too many."""
    parts = max(1, n_docs // (64 * BLOCK_DOCS))
    return (F.floor(F.log2(F.col("length") + 1) * 8).cast("int") * parts + F.pmod(F.xxhash64("doc"), F.lit(parts)).cast("int")).alias("block")


def _impact(tf: Column, length: Column, avgdl: Column | float) -> Column:
    """What a term adds to a score, but for its weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avgdl))


def write_index(index: Index, path: str) -> None:
    """Store an index: its postings sorted by term over all files, so that a search reads the few row groups that hold its terms, and a dictionary.

    The dictionary has each term's number of documents, and for each block of documents that holds it the largest
    share that it adds to a score there. The index is built once; all else is read from what was stored.
    """
    spark = index.postings.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings, doc_stats = read_once(index, f"{path}/unsorted")
    doc_stats.write.parquet(f"{path}/doc_stats")
    totals = spark.read.parquet(f"{path}/doc_stats").agg(F.count("*").alias("n"), F.avg("length").alias("avgdl")).first()
    spark.range(1).select(F.lit(totals.n).alias("n"), F.lit(totals.avgdl).cast("double").alias("avgdl"), F.lit(index.stems).alias("stems")).coalesce(1).write.parquet(f"{path}/totals")
    by_term = lambda df, *more: df.repartitionByRange(parts, "term", *more).sortWithinPartitions("term", *more)
    by_term(postings.withColumn("block", _block(totals.n)), "doc").write.option("parquet.block.size", 8 << 20).parquet(f"{path}/postings")
    forget(spark, f"{path}/unsorted")
    of_doc = spark.read.parquet(f"{path}/postings").groupBy("term", "doc").agg(F.sum("tf").alias("tf"), F.first("length").alias("length"), F.first("block").alias("block"))
    blocks = of_doc.groupBy("term", "block").agg(F.count("*").alias("docs"), F.max(_impact(F.col("tf"), F.col("length"), totals.avgdl or 1.0)).alias("impact"))
    by_term(blocks, "block").write.parquet(f"{path}/blocks")
    by_term(spark.read.parquet(f"{path}/blocks").groupBy("term").agg(F.sum("docs").alias("documents"))).write.parquet(f"{path}/terms")


@dataclass(frozen=True)
class StoredIndex(Index):
    """An index that was written. Without a dictionary (one of segments) documents are counted in each search."""

    totals: tuple[int, float] = (0, 0.0)
    dictionary: DataFrame | None = None  # term, documents
    blocks: DataFrame | None = None  # term, block, docs, impact

    def vocabulary(self) -> DataFrame:
        return super().vocabulary() if self.dictionary is None else self.dictionary

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """In how many documents each of a query's terms stands."""
        found = {r.term: r.documents for r in self.dictionary.where(F.col("term").isin(terms)).collect()} if terms else {}
        return {t: found.get(t, 0) for t in terms}


def read_index(spark: SparkSession, path: str) -> StoredIndex:
    """An index that `write_index` has stored; the number of documents and their mean length are read once."""
    n, avgdl, stems = spark.read.parquet(f"{path}/totals").first()
    of = {name: spark.read.parquet(f"{path}/{name}") for name in ("postings", "doc_stats", "terms", "blocks")}
    return StoredIndex(of["postings"], of["doc_stats"], stems, totals=(n, avgdl or 0.0), dictionary=of["terms"], blocks=of["blocks"])


_VOWEL = "aeiou"


def _vowel(w: str, i: int) -> bool:
    return w[i] in _VOWEL or (w[i] == "y" and i > 0 and not _vowel(w, i - 1))


def _measure(w: str) -> int:
    """Number of vowel-consonant sequences."""
    kinds = [_vowel(w, i) for i in range(len(w))]
    return sum(a and not b for a, b in zip(kinds, kinds[1:], strict=False))


def _has_vowel(w: str) -> bool:
    return any(_vowel(w, i) for i in range(len(w)))


def _short_end(w: str) -> bool:
    return len(w) > 2 and not _vowel(w, len(w) - 1) and _vowel(w, len(w) - 2) and not _vowel(w, len(w) - 3) and w[-1] not in "wxy"


#: Suffixes of the published algorithm's steps 2, 3 and 4. Fixed values.
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


@functools.lru_cache(maxsize=200_000)
def stem(w: str) -> str:
    """Porter's stem of a lower-case English word; words of up to two letters and words with other letters stay."""
    if len(w) < 3 or not (w.isascii() and w.isalpha()):
        return w
    for end, put in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + put
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short_end(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for steps in (_STEP2, _STEP3):
        match = max((s for s in steps if w.endswith(s[0])), key=lambda s: len(s[0]), default=None)
        if match and _measure(w[: -len(match[0])]) > 0:
            w = w[: -len(match[0])] + match[1]
    match4 = max((s for s in _STEP4 if w.endswith(s)), key=len, default=None)
    if match4 and _measure(w[: -len(match4)]) > 1 and (match4 != "ion" or w[: -len(match4)].endswith(("s", "t"))):
        w = w[: -len(match4)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short_end(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def stem_terms(rows: DataFrame) -> DataFrame:
    """Stems in place of terms. Only the distinct vocabulary goes through Python."""

    @F.pandas_udf("string")
    def stems(terms: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in terms:
            yield batch.map(stem)

    vocabulary = rows.select("term").distinct().withColumn("stem", stems("term"))
    return rows.join(vocabulary, "term").drop("term").withColumnRenamed("stem", "term")


def bm25(index: Index, terms: list[str], fields: list[str] | None = None) -> DataFrame:
    """(doc, bm25, matched): documents with any of the terms; lower scores are better. The population is all documents.

    Only the query's own postings are read; statistics are one row. matched counts the terms found.
    """
    return search(index, any_of=terms, fields=fields)


def search(index: Index, all_of: list[str] = (), any_of: list[str] = (), none_of: list[str] = (), prefixes: list[str] = (), fields: list[str] | None = None) -> DataFrame:
    """(doc, bm25, matched) of the documents that hold all, any and none of the given terms, and words with each prefix.

    Score is that of the terms asked for; a prefix stands for all words of the vocabulary that begin with it. Terms are words; in an
    index of stems they are stemmed, prefixes are taken as they are. With `none_of` alone, all other documents are found.

    A stored index is read in one scan of the postings of all terms and prefixes, summed up once for each document; how many documents
    hold a term comes from its dictionary. Of an index that is not stored, each document is one row and is read once.
    """
    every, some, no = index.terms(all_of), index.terms(any_of), index.terms(none_of)
    scored = sorted({*every, *some})
    of = lambda terms: lambda c: c.isin(list(terms)) if terms else F.lit(False)
    begins = lambda p: lambda c: c.startswith(p)
    if not (every or some or prefixes):
        left = index.doc_stats
        if no:
            held = index.postings.where(of(no)(F.col("term")) & (F.col("field").isin(fields) if fields else F.lit(True)))
            left = left.join(held.select("doc").distinct(), "doc", "left_anti")
        return left.select("doc", F.lit(0.0).alias("bm25"), F.lit(0).cast("long").alias("matched"))
    conditions = {"no": of(no), "some": of(some), **{f"p{i}": begins(p) for i, p in enumerate(prefixes)}}
    per_doc = (_read_words if index.words is not None and not index.stems else _read_postings)(index, scored, conditions, fields)
    good = ~F.col("no")
    for i, t in enumerate(scored):
        if t in every:
            good &= F.col(f"tf{i}").isNotNull()
    for name in (["some"] if some else []) + [f"p{i}" for i in range(len(prefixes))]:
        good &= F.col(name)
    score = lambda i, n, avgdl, df: F.greatest(F.ln((n - df + 0.5) / (df + 0.5)), F.lit(1e-6)) * _impact(F.col(f"tf{i}"), F.col("length"), avgdl)
    if isinstance(index, StoredIndex) and index.dictionary is not None and not fields:
        n, avgdl = (F.lit(float(x)) for x in index.totals)
        df = index.frequencies(scored)
        found, parts = per_doc.where(good), [score(i, n, avgdl, F.lit(float(df[t]))) for i, t in enumerate(scored)]
    else:
        # one row of counts from the same rows: it reads all their columns, so that both sides share one exchange
        counts = [F.count(f"tf{i}").alias(f"df{i}") for i in range(len(scored))] + [F.max(c).alias(f"any_{c}") for c in conditions]
        if isinstance(index, StoredIndex):
            counts += [F.max("length").alias("longest"), F.lit(index.totals[0]).alias("n"), F.lit(index.totals[1]).alias("avgdl")]
        elif index.words is not None and not index.stems:
            counts += [F.count("*").alias("n"), F.avg("length").alias("avgdl")]
        else:
            counts += [F.max("length").alias("longest")]
        totals = per_doc.agg(*counts)
        if "n" not in totals.columns:
            totals = totals.crossJoin(index.doc_stats.agg(F.count("*").alias("n"), F.avg("length").alias("avgdl")))
        found = per_doc.where(good).crossJoin(F.broadcast(totals))
        parts = [score(i, F.col("n"), F.col("avgdl"), F.col(f"df{i}")) for i in range(len(scored))]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    matched = sum((F.col(f"tf{i}").isNotNull().cast("long") for i in range(len(scored))), F.lit(0))
    return found.select("doc", (-total).alias("bm25"), matched.cast("long").alias("matched"))


def _read_postings(index: Index, scored: list[str], conditions: dict, fields: list[str] | None) -> DataFrame:
    """(doc, length, tf0.., conditions) of the documents that hold any of the terms, from postings."""
    c = F.col("term")
    postings = index.postings.where(functools.reduce(Column.__or__, [x(c) for x in conditions.values()], c.isin(scored) if scored else F.lit(False)))
    if fields:
        postings = postings.where(F.col("field").isin(fields))
    tf = [F.sum(F.when(c == t, F.col("tf"))).alias(f"tf{i}") for i, t in enumerate(scored)]
    return postings.groupBy("doc").agg(F.max("length").alias("length"), *tf, *(F.max(x(c)).alias(name) for name, x in conditions.items()))


def _read_words(index: Index, scored: list[str], conditions: dict, fields: list[str] | None) -> DataFrame:
    """(doc, length, tf0.., conditions) of all documents, from their words. Only these narrow rows are exchanged, so that they are made once."""
    words = F.filter("words", lambda w: w["field"].isin(fields)) if fields else F.col("words")
    asked = lambda c: functools.reduce(Column.__or__, [x(c) for x in conditions.values()], c.isin(scored) if scored else F.lit(False))
    held = index.words.select("doc", "length", F.filter(F.flatten(F.transform(words, lambda w: w["t"])), asked).alias("held"))
    is_term = lambda t: lambda x: x == t
    tf = [F.nullif(F.size(F.filter("held", is_term(t))).cast("long"), F.lit(0)).alias(f"tf{i}") for i, t in enumerate(scored)]
    return held.select("doc", "length", *tf, *(F.exists("held", x).alias(name) for name, x in conditions.items())).repartition("doc")


#: Where the postings of a query's terms are fewer, they are all read.
FEW_POSTINGS = 1_000_000


def best_documents(index: Index, terms: list[str], k: int, first_blocks: int = 16, few: int = FEW_POSTINGS) -> DataFrame:
    """The k best documents for any of the terms, as `bm25` ranks them: (doc, bm25, matched), ties by id.

    The dictionary bounds what a block's documents can score. Blocks of the highest bounds are read first; the k-th score found there
    rules out all blocks whose bound is lower, and their postings are not read. The k rows come to the driver once.
    """
    ranked = lambda df: df.orderBy("bm25", "doc").limit(k)
    if not isinstance(index, StoredIndex) or index.blocks is None:
        return ranked(bm25(index, terms))
    words = sorted(set(index.terms(terms)))
    df = index.frequencies(words)
    if sum(df.values()) <= few:
        return ranked(bm25(index, terms))
    weight = functools.reduce(lambda c, t: c.when(F.col("term") == t, F.greatest(F.ln(F.lit((index.totals[0] - df[t] + 0.5) / (df[t] + 0.5))), F.lit(1e-6))), words, F.when(F.lit(False), F.lit(0.0)))
    bounds = index.blocks.where(F.col("term").isin(words)).groupBy("block").agg(F.sum(weight * F.col("impact")).alias("most"))
    first = [r.block for r in bounds.orderBy(F.desc("most"), "block").limit(first_blocks).collect()]
    of = lambda postings: bm25(replace(index, postings=postings), terms)
    found = ranked(of(index.postings.where(F.col("block").isin(first)))).collect()
    # a score as large as a bound may differ from it in its last digits
    least = -found[-1].bm25 * (1 - 1e-9) if len(found) == k else 0.0
    left = bounds.where(~F.col("block").isin(first) & (F.col("most") >= least)).select("block")
    rest = of(index.postings.join(F.broadcast(left) if left.count() <= FEW_POSTINGS else left.hint("merge"), "block", "left_semi"))
    return ranked(rest.sparkSession.createDataFrame(found, rest.schema).unionByName(rest))


def phrase(index: Index, words: list[str], fields: list[str] | None = None) -> DataFrame:
    """(doc, field, starts): where the words stand one after the other. An index of stems finds all forms of the words.

    Places of each word are brought together in one row for each document and field, and intersected there.
    """
    words = index.terms(words)
    wanted = index.postings.where(F.col("term").isin(words))
    if fields:
        wanted = wanted.where(F.col("field").isin(fields))
    before = lambda i: F.transform("positions", lambda p: p - i)
    of = wanted.groupBy("doc", "field").agg(*(F.flatten(F.collect_list(F.when(F.col("term") == w, before(i)))).alias(f"w{i}") for i, w in enumerate(words)))
    starts = functools.reduce(lambda a, b: F.array_intersect(a, b), [F.col(f"w{i}") for i in range(len(words))])
    return of.select("doc", "field", F.array_sort(starts).alias("starts")).where(F.size("starts") > 0)


def update_index(index: Index, before: DataFrame, after: DataFrame, id_col: str, fields: list[str]) -> Index:
    """The index after inserts, deletes and updates: only documents whose indexed fields changed are read again."""
    mark = lambda df: df.select(F.col(id_col).alias("doc"), F.xxhash64(*fields).alias("mark"))
    old, new = mark(before), mark(after)
    gone = old.join(new, ["doc", "mark"], "left_anti").select("doc").distinct()
    fresh = new.join(old, ["doc", "mark"], "left_anti").select("doc").distinct()
    added = build_index(after.join(fresh, after[id_col] == fresh["doc"], "left_semi"), id_col, fields, index.stems)
    return Index(index.postings.join(gone, "doc", "left_anti").select(index.postings.columns).unionByName(added.postings), index.doc_stats.join(gone, "doc", "left_anti").unionByName(added.doc_stats), index.stems)


def top_results(scores: DataFrame, captures: DataFrame, n: int, id_col: str = "capture_id") -> DataFrame:
    """The n best captures with their place: by score, then newest, then largest id."""
    rows = captures.join(scores.withColumnRenamed("doc", id_col), id_col)
    keys = [F.round("bm25", 6), F.desc("captured_at"), F.desc(id_col)]
    return rows.orderBy(*keys).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*keys)))
