"""License scans (operator 8): diagonal voting over joined word k-gram hashes."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .wordhash import chunks, shingle_hashes, word_hashes

#: Phrases that are looked for word by word, and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Sentences of common licenses, which may be worn or reworded in places.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl-2.0",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this work is licensed under a creative commons attribution": "cc",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "the person who associated a work with this deed has dedicated the work to the public domain": "cc0",
    "licensed under the creative commons attribution license": "cc",
    "released under the mit license": "mit",
    "unauthorized copying or distribution of this text is prohibited": "proprietary",
}
#: Whole texts of short public licenses, without names, years and titles.
WHOLE_TEXTS = {
    """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
    in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
    the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
    permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
    EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
    AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
    CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""": "mit",
    """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
    notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
    INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
    DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT
    OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""": "isc",
    """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1.
    Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form
    must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
    distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
    THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
    FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
    LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
    NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""": "bsd",
    """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
    License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
    distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
    permissions and limitations under the License.""": "apache-2.0",
    """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
    Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT
    ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""": "gpl",
}
K = 2
CHUNK_BYTES = 1 << 20
BROADCAST_ROWS = 1_000_000
#: All but digits, letters a-z (after lower-casing) and bytes of other characters.
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[0x30:0x3A] = _SEPARATOR[0x61:0x7B] = False
_SEPARATOR[0x80:] = False
_EVERY_TEXT = 0x5EED  # a hash put before each text's own, so that texts without a match keep their row


def _grams(column: pa.Array) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Word counts and rolling K-gram hashes of each text, for a chunk of rows at a time."""
    for _, offsets, data in chunks(column, CHUNK_BYTES):
        words, rows = word_hashes(offsets, data, _SEPARATOR)
        n = len(offsets) - 1
        counts = np.bincount(rows, minlength=n)
        grams, at = shingle_hashes(words, rows, K)
        long_enough = counts[at] >= K
        grams, at = grams[long_enough].view(np.int64), at[long_enough]
        cut = np.searchsorted(at, np.arange(n + 1))
        yield counts, [grams[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def _rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for counts, grams in _grams(batch.column(2)):
            n = len(counts)
            lengths = np.array([len(g) + 1 for g in grams])
            flat = np.concatenate([x for g in grams for x in (np.array([_EVERY_TEXT]), g)])
            lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(lengths)].astype(np.int32), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(counts.astype(np.int64)), lists], names=["row", "id", "n_words", "grams"])
            at += n


def template_grams(spark: SparkSession, phrases: dict[str, str], templates: dict[str, str]) -> tuple[DataFrame, int, int]:
    """(gram, template, tpos, label, base, size): a row for each K-gram of each phrase and template; their number, and the largest size."""
    rows = [(_EVERY_TEXT, -1, 0, "", False, 0)]
    for i, (text, label) in enumerate([*phrases.items(), *templates.items()]):
        _, (grams,) = next(_grams(pa.array([text])))
        rows += [(int(g), i, p, label, i < len(phrases), len(grams)) for p, g in enumerate(grams)]
    return spark.createDataFrame(rows, "gram long, template int, tpos int, label string, base boolean, size int"), len(rows), max(r[-1] for r in rows)


def in_order(pairs: list[tuple[int, int]]) -> tuple[int, int, int]:
    """The longest run of (pos, tpos) pairs that rise in both: its length, its first and last pos."""
    tails: list[int] = []  # of the runs of each length, the least last tpos
    at: list[int] = []  # and which pair that is
    before = [-1] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda i: (pairs[i][0], -pairs[i][1]))
    for i in order:
        k = bisect_left(tails, pairs[i][1])
        before[i] = at[k - 1] if k else -1
        tails[k : k + 1], at[k : k + 1] = [pairs[i][1]], [i]
    last = first = at[-1]
    while before[first] >= 0:
        first = before[first]
    return len(tails), pairs[first][0], pairs[last][0]


def _verified(coverage: float):
    """Align each candidate span with its template and keep those whose K-grams stand in the template's order."""
    span = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("coverage", pa.float64())])
    names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, score, candidates = (batch.column(c).to_pylist() for c in ("base_set", "score", "candidates"))
            labels, spans = [], []
            for i, found in enumerate(candidates):
                mine, own = set(base[i]), []
                for c in found:
                    n, first, last = in_order([(d["diagonal"] + t, t) for d in c["window"] for t in d["covered"]])
                    share = n / c["size"]
                    score[i] = max(score[i], min(1.0, share))
                    if share >= coverage:
                        mine.add(c["label"])
                        own.append((-share, first, last + K - 1, c["label"]))
                kept: list[tuple] = []  # the fullest of those that overlap
                for s, first, last, label in sorted(own):
                    if all(last < a or first > b or label != other for a, b, other, _ in kept):
                        kept.append((first, last, label, -s))
                labels.append(",".join(sorted(mine)))
                spans.append([dict(zip(("first", "last", "label", "coverage"), s, strict=True)) for s in sorted(kept)])
            columns = [batch.column(c) for c in names[:6]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(labels, pa.string()), pa.array(score, pa.float64()), pa.array(spans, pa.list_(span))], names=names)

    return run


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None,
    gap: int = 3, coverage: float = 0.75,
) -> DataFrame:
    """Find license phrases and, by diagonal voting, worn license texts in whole documents.

    All rolling K-word hashes are joined to the positions they have in the templates (one row for each word of the templates
    given; the table is broadcast while it has less than BROADCAST_ROWS rows). Every match votes for the diagonal
    pos - tpos of its text and template. From each diagonal on, neighbours at most `gap` apart are merged, as a word put in
    or left out shifts a match by one, up to as many diagonals as the template has words: whatever else a text repeats, each
    diagonal begins a window of its own. Windows that hold `coverage` of the template's K-grams are candidates.
    A candidate is verified by aligning its words with the template: the K-grams that
    stand in the template's order must be `coverage` of all; of overlapping spans of a label the fullest is told. A phrase is found where one diagonal holds all its K-grams in a row.

    Returns (id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, spans); spans has label,
    first and last word and coverage of each verified find; score is 1 with a phrase, else the largest coverage. Null and empty
    texts have no words and no finds. Null and repeated ids keep their rows; texts of any length are
    scanned to their end; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    phrases = BASE_PHRASES if phrases is None else phrases
    templates = TEMPLATES | WHOLE_TEXTS if templates is None else templates
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rolled = texts.mapInArrow(_rolled, f"row long, id {kind}, n_words long, grams array<long>")
    known, n_known, longest = template_grams(spark, phrases, templates)
    matches = rolled.select("row", "id", "n_words", F.posexplode("grams").alias("pos", "gram")).join(F.broadcast(known) if n_known < BROADCAST_ROWS else known, "gram").drop("gram")
    votes = (
        matches.repartition("row")
        .groupBy("row", "id", "n_words", "template", "label", "base", "size", (F.col("pos") - 1 - F.col("tpos")).cast("long").alias("diagonal"))
        .agg(F.collect_set("tpos").alias("covered"))
    )
    by_diagonal = Window.partitionBy("row", "template").orderBy("diagonal")
    ahead = F.collect_list(F.struct("diagonal", "covered")).over(by_diagonal.rangeBetween(0, longest + K))
    # the diagonals of a window that follow on each other, and the template's positions that they cover
    start = F.struct(F.col("diagonal").alias("end"), F.array().cast("array<int>").alias("tpos"))
    inside = lambda acc, d: (d["diagonal"] - acc["end"] <= gap) & (d["diagonal"] - F.col("diagonal") <= F.col("size") + K)
    chain = F.aggregate(ahead, start, lambda acc, d: F.when(inside(acc, d), F.struct(d["diagonal"].alias("end"), F.array_union(acc["tpos"], d["covered"]).alias("tpos"))).otherwise(acc))
    worn = (F.col("template") >= 0) & ~F.col("base")
    windows = votes.withColumn("ahead", F.when(worn, ahead)).withColumn("chain", F.when(worn, chain)).withColumn("share", F.size("chain.tpos") / F.greatest("size", F.lit(1)))
    candidate = worn & (F.col("share") >= coverage)
    held = F.struct("label", "size", F.filter("ahead", lambda d: d["diagonal"] <= F.col("chain.end")).alias("window"))
    place = F.when((F.col("template") >= 0) & F.col("base") & (F.size("covered") == F.col("size")), F.col("diagonal"))
    text_of = lambda c: F.concat_ws(",", F.array_sort(c))
    found = windows.groupBy("row", "id", "n_words").agg(
        F.count(place).alias("n_base"), F.min(place).alias("first_word"), F.max(place).alias("last_word"), F.collect_set(F.when(place.isNotNull(), F.col("label"))).alias("base_set"),
        F.max(F.when(place.isNotNull(), 1.0).when(worn & (F.col("share") < coverage), F.col("share")).otherwise(0.0)).alias("score"), F.collect_list(F.when(candidate, held)).alias("candidates"),
    )
    whole = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first:long,last:long,label:string,coverage:double>>"
    return found.withColumn("base_labels", text_of(F.col("base_set"))).mapInArrow(_verified(coverage), whole).withColumnRenamed("id", id_col)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")
