"""The n-gram Jaccard join against brute force, and that every link passes all token orders."""

import itertools
import random

import pytest

from tapeworks.llm import jaccard_join

SCHEMA = "doc_id long, text string, token long, comp long"


def shingles(text):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()


def brute(rows):
    """doc_id -> (n_shingles, class_id, component_id, n_links)."""
    sets = {i: shingles(t) for i, t in rows}
    klass = {i: min(j for j in sets if sets[j] == s) if s else i for i, s in sets.items()}
    reps = [i for i in sets if klass[i] == i and sets[i]]
    near = {i: set() for i in reps}
    for a, b in itertools.combinations(reps, 2):
        c = len(sets[a] & sets[b])
        if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
            near[a].add(b)
            near[b].add(a)
    root = {}
    for i in sorted(reps):
        if i not in root:
            todo = [i]
            while todo:
                if (x := todo.pop()) not in root:
                    root[x] = i
                    todo += near[x]
    return {i: (len(s), klass[i], root.get(klass[i], i), len(near.get(klass[i], ()))) for i, s in sets.items()}


@pytest.fixture(scope="module")
def near_copies():
    rnd = random.Random(5)
    words = [f"v{i}" for i in range(3000)]
    rows, i = [], 0
    for group, size in enumerate([70, 9, 3, 2, 1, 1, 1]):
        base = rnd.choices(words, k=rnd.choice([60, 120, 200]))
        for _ in range(size):
            text = list(base)
            for _ in range(rnd.randrange(0, 4)):
                text[rnd.randrange(len(text))] = rnd.choice(words)
            i += 1
            rows.append((i, " ".join(text)))
    for t in ("one two three", "one two three", "One Two Three", "", None, "a b c d e", "  a b c\td\ne  ", "x" * 5000):
        i += 1
        rows.append((i, t))
    for k in range(12):  # a common passage within unlike texts
        i += 1
        rows.append((i, " ".join(rnd.choices(words, k=80) + words[:30] + rnd.choices(words, k=10))))
    rnd.shuffle(rows)
    return rows


def test_against_brute_force(spark, near_copies, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 16)  # several tiles for the largest group
    asked, held, checked = [], [], []
    meet, verify = jaccard_join.meeting, jaccard_join.verified

    def counted_meeting(of, pairs):
        out = meet(of, pairs)
        asked.append(pairs.count())
        held.append({(r["a"], r["b"]) for r in out.select("a", "b").collect()})
        return out

    def counted_verified(met):
        checked.append({(r["a"], r["b"]) for r in met.select("a", "b").collect()})
        return verify(met)

    monkeypatch.setattr(jaccard_join, "meeting", counted_meeting)
    monkeypatch.setattr(jaccard_join, "verified", counted_verified)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in near_copies] + [(near_copies[0][0], near_copies[0][1], 1, 2), (None, "a b c d e", 1, 2)], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["class_id"], r["component_id"], r["n_links"]) for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == brute(near_copies)
    # every verified pair went through the further orders, and they were asked
    assert checked == held and asked[0] > 0 and sum(asked) >= sum(map(len, held))
    print("pairs under the first order, under all orders:", asked, list(map(len, held)))


def test_each_order_is_lossless(spark, near_copies):
    rows = [(i, t) for i, t in near_copies if t]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    heavy = spark.sparkContext.broadcast(jaccard_join.frequent_shingles(docs))
    sets = {i: shingles(t) for i, t in rows}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(sets), 2)]
    linked = {(a, b) for a, b in pairs if (c := len(sets[a] & sets[b])) and 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c)}
    all_pairs = spark.createDataFrame(pairs, "a long, b long")
    of = jaccard_join.sides(docs, docs.select("doc_id"), heavy)
    met = {(r["a"], r["b"]) for r in jaccard_join.meeting(of, all_pairs).collect()}
    assert linked <= met and len(met) < len(pairs) // 2


def test_numbers_with_several_texts_stay_whole(spark):
    t = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(1, t, 7), (1, "a wholly different text that shares nothing with it at all", 7), (2, t, 7), (3, t, 7), (3, t, 7), (None, t, 7), (None, t, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    got = sorted(((r["doc_id"], r["text"]) for r in jaccard_join.keep_one_of_each(docs).collect()), key=str)
    kept = [i for i, _ in got]
    assert kept.count(1) == 2 and kept.count(None) == 2
    once = spark.createDataFrame([(3, t, 7), (3, t, 7), (4, t, 7)], docs.schema)
    assert [(r["doc_id"], r["component_id"]) for r in jaccard_join.keep_one_of_each(once).collect()] == [(3, 7)]
