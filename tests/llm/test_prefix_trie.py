"""The trie of prefixes against a plain dictionary of tuples."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tapeworks.llm import prefix_trie as t
from tapeworks.llm.queries import op12_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, g0 string, piece int"


def plain(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: (*x[:2], hashlib.sha256(f"{len(x[2])}:{x[2]}{x[3]}".encode()).hexdigest()))] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:])
    members = {}
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    inner = {p[:-1] for p in members if p}
    saved = {p: (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0 for p, m in members.items()}
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in m if whole[c] == p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), sum(q[:-1] == p for q in members if q), sum(q not in inner for q in below), sum(saved[q] for q in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def talks(seed, n=60):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(-5, 200), n):
        for turn in range(draw.randint(1, 7)):
            rows.append((c, turn, draw.choice(["user", "assistant", None]), draw.choice(["a b", "", None, "hello  there\n\tyou", "x" * 5000, "0:a"])))
    rows += [rows[0], rows[1], rows[1]]  # repeated rows are turns of their own
    rows += [(300, None, "user", "first"), (300, 0, "user", "second"), (None, 1, "user", "nobody"), (301, None, None, None), (301, None, "b", "tie"), (301, None, "a", "tie")]
    rows += [(1000 + i, d, "user", "same") for i in range(40) for d in range(3)]  # copies of one conversation
    rows += [(2000 + i, d, "user", f"turn {min(d, 25 + i)}") for i in range(3) for d in range(30)]  # long ones
    return [(*r, "x", "y", 1) for r in rows]


def query(spark, df, monkeypatch):
    monkeypatch.setattr("tapeworks.llm.queries.table", lambda *_: df)
    return sorted((tuple(r) for r in op12_prefix_trie(spark, "").collect()), key=repr)


@pytest.mark.parametrize(("seed", "piece", "run"), [(1, 4096, 8192), (2, 4, 3)])
def test_equals_plain(spark, monkeypatch, seed, piece, run):
    """Also with pieces so short that paths and lists of numbers are cut."""
    monkeypatch.setattr(t, "PIECE", piece)
    monkeypatch.setattr(t, "RUN", run)
    rows = talks(seed)
    assert query(spark, spark.createDataFrame(rows, SCHEMA), monkeypatch) == plain(rows)


def test_empty_and_only_null_numbers(spark, monkeypatch):
    assert query(spark, spark.createDataFrame([], SCHEMA), monkeypatch) == []
    assert query(spark, spark.createDataFrame([(None, 1, "a", "b", "", "", 1)], SCHEMA), monkeypatch) == []


def test_slots_are_minimal_perfect_and_verified():
    draw = np.random.default_rng(1)
    keys = draw.integers(-(2**62), 2**62, (5000, 2))
    table = t.SlotTable(np.concatenate([keys, keys[:100]]))
    slots = table.slots(keys)
    assert sorted(slots) == list(range(5000)) and (table.keys[slots] == keys).all()
    assert (table.slots(keys + 1) == -1).all() and t.SlotTable(keys[:0]).slots(keys[:3]).tolist() == [-1] * 3


def test_two_sequences_under_one_digest_are_told(spark):
    rows = spark.createDataFrame([(1, 1, 5, 5, 0, 0, "a", 1), (2, 1, 5, 5, 0, 0, "b", 1)], "conv_id long, depth long, g0 long, g1 long, p0 long, p1 long, own string, words long")
    with pytest.raises(Exception, match="two prefixes share a digest"):
        t._nodes(rows).collect()
