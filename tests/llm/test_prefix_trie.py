"""The trie of conversations against one built of dictionaries in memory."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from compare import rows

from papyrarc.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, depth string, place long, x1 string"


def rebuilt(turns):
    convs: dict[int, list] = {}
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    convs = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    members: dict[tuple, list] = {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    children: dict[tuple, int] = {}
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, of in members.items():
        points = len(node[-1][1]) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(of) - 1) * points
    out = []
    for node, of in members.items():
        ends = ",".join(map(str, sorted(c for c in of if len(convs[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append(str((min(of), len(node), parent, len(of), children.get(node, 0), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest())))
    return sorted(out)


def frame(spark, turns):
    return spark.createDataFrame([(*t, "d", 7, "x") for t in turns], SCHEMA).repartition(3)


def found(spark, turns, **how):
    trie = P.prefix_trie(P.rebuild(P.digest_turns(frame(spark, turns))), **how)
    return sorted(str(tuple(r)) for r in trie.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def mixed_turns():
    rng = random.Random(3)
    turns = []
    for c in [*range(0, 60), *range(100, 160), 250, 251, -7, -100]:
        style = rng.randrange(4)
        for t in range(rng.choice([1, 2, 3, 5, 8, 9, 13])):
            said = rng.choice(["yes", "no"]) if style == 0 else f"line {t}" if style < 3 else f"own {c} {t} é😀"
            turns.append((c, t, rng.choice(["user", None]) if style == 0 else "user", said))
    turns += [(700, None, None, None), (700, None, "user", "x" * 300_000), (700, 3, "user", "tie"), (700, 3, "user", "tie"), (700, 3, "assistant", "tie"), (None, 0, "user", "nobody")]
    return turns


@pytest.mark.parametrize("block", [4, 2])
def test_mixed_conversations(spark, block):
    turns = mixed_turns()
    assert found(spark, turns, block=block) == brute(rebuilt(turns))


def test_copies_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE_BYTES", 64)
    turns = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(9 if c % 3 else 4)]
    assert found(spark, turns) == brute(rebuilt(turns))


def test_query_equals_brute_force_and_sql(spark, sf_dir, duck):
    ours = P.op13_prefix_trie(spark, sf_dir).toPandas()
    theirs = duck.sql(P.OP13_SQL).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
    turns = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert len(ours) == len(brute(rebuilt(turns)))


def test_empty_table(spark):
    assert found(spark, []) == []
