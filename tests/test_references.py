"""References that hold or are held by a part's location, against a comparison of all pairs."""

from __future__ import annotations

import random
import time
from urllib.parse import unquote

from papyrarc.operators import mhtml as M


def test_contained_references_equal_all_pairs(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["a", "b%20c", "img", "x.png", "cdn", "é", "https:", "q"])
    parts = [(c, pos, rng.choice([None, "/".join(word() for _ in range(rng.randint(2, 7)))]), None) for c in (1, 2) for pos in range(60)]
    references = [(c, "/".join(word() for _ in range(rng.randint(1, 9))), None) for c in (1, 2, 3) for _ in range(60)] + [(1, None, None)]
    got = {(r.capture_id, r.reference): (r.pos, r.by) for r in M.resolve_references(spark.createDataFrame(references, "capture_id long, reference string, base string"), spark.createDataFrame(parts, "capture_id long, pos int, location string, content_id string")).collect()}
    n = 0
    for c, reference, _ in references:
        if reference is None or got[c, reference][1] not in (None, "contained"):
            continue
        plain = unquote(reference)
        held = [pos for of, pos, location, _ in parts if of == c and location and len(location) > 8 and (plain in unquote(location) or unquote(location) in plain)]
        assert got[c, reference] == ((min(held), "contained") if held else (None, None))
        n += bool(held)
    assert n > 5 and got[1, None] == (None, None)


def test_many_parts_of_one_capture(spark):
    parts = spark.range(10_000).selectExpr("1L as capture_id", "cast(id as int) as pos", "concat('https://cdn.example.com/fetch/w_', id, '/https%3A%2F%2Fimg.example.com%2F', id, '.png') as location", "cast(null as string) as content_id")
    references = spark.range(10_000).selectExpr("1L as capture_id", "concat('https://img.example.com/', id, '.png') as reference", "cast(null as string) as base")
    began = time.perf_counter()
    rows = M.resolve_references(references, parts).collect()
    assert time.perf_counter() - began < 40  # all pairs would be a hundred million comparisons
    assert len(rows) == 10_000 and all(r.by == "contained" and r.reference.endswith(f"/{r.pos}.png") for r in rows)
