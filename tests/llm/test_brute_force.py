"""Operators against plain Python: line chain, mixing, sharding, base rules of personal data."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from tapeworks.llm import line_crf, mixing, personal_data, sharding
from tapeworks.llm.hashing import mix

MASK = (1 << 64) - 1


def plain_jump(key, shards):
    """Jump consistent hash of one mixed key."""
    b, j = -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) & MASK
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def mixed(key):
    return int(mix(np.array([key], np.int64).view(np.uint64))[0])


def test_chain_marginals_equal_the_sum_over_all_labelings():
    rnd = np.random.default_rng(3)
    doc = np.repeat([0, 1, 2, 3], [1, 6, 2, 4])
    e, steps = rnd.normal(size=len(doc)), rnd.normal(size=(2, 2))
    want, pairs, log_z = np.zeros(len(doc)), np.zeros((2, 2)), 0.0
    for d in range(4):
        at = np.flatnonzero(doc == d)
        ways = list(itertools.product([0, 1], repeat=len(at)))
        p = np.array([math.exp(sum(e[i] * y for i, y in zip(at, w)) + sum(steps[a, b] for a, b in zip(w, w[1:]))) for w in ways])
        log_z += math.log(p.sum())
        for q, w in zip(p / p.sum(), ways):
            want[at] += q * np.array(w)
            for a, b in zip(w, w[1:]):
                pairs[a, b] += q
    got = line_crf.forward_backward(e, steps, doc)
    assert np.allclose(got[0], want) and np.allclose(got[1], pairs) and math.isclose(got[2], log_z)


def test_chain_likelihood_gradient_is_seen_less_expected():
    rnd = np.random.default_rng(4)
    doc, y = np.repeat([0, 1], [5, 3]), rnd.integers(0, 2, 8)
    e, steps = rnd.normal(size=8), rnd.normal(size=(2, 2))
    inner = np.flatnonzero(doc[1:] == doc[:-1])

    def likelihood(e, steps):
        return (e * y).sum() + steps[y[inner], y[inner + 1]].sum() - line_crf.forward_backward(e, steps, doc)[2]

    marginal, pairs, _ = line_crf.forward_backward(e, steps, doc)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner], y[inner + 1]), 1)
    for i in range(8):
        up = e + 1e-5 * (np.arange(8) == i)
        assert math.isclose((likelihood(up, steps) - likelihood(e, steps)) / 1e-5, y[i] - marginal[i], abs_tol=1e-3)
    for a, b in itertools.product([0, 1], repeat=2):
        up = steps.copy()
        up[a, b] += 1e-5
        assert math.isclose((likelihood(e, up) - likelihood(e, steps)) / 1e-5, seen[a, b] - pairs[a, b], abs_tol=1e-3)


def test_sharding_equals_the_scalar_hash(spark):
    rows = [(i * 7919 - 5, f"text é {i % 13}" if i % 11 else None) for i in range(400)] + [(-5, "again"), (-5, "again")]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 24).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows
    )
    for r in got:
        assert r["shard"] == plain_jump(mixed(r["doc_id"]), 24) and r["grown_shard"] == plain_jump(mixed(r["doc_id"]), 25)
        assert r["grown_shard"] in (r["shard"], 24) and r["law"] == "key"
    for s in range(24):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


@pytest.fixture(scope="module")
def sources():
    rnd = random.Random(2)
    sizes = {"a": 300, "b": 60, "c": 25, None: 8}
    return [(i, " ".join(["w"] * rnd.randint(0, 12)) if i % 17 else None, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]


def n_words(text):
    return len((text or "").split())


@pytest.mark.parametrize("entropy, repeats", [(0.95, 4.0), (0.8, 50.0), (1.0, 1000.0), (0.95, 1.5)])
def test_exponent_equals_a_plain_bisection(spark, sources, entropy, repeats):
    total = {}
    for _, t, s in sources:
        total[s] = total.get(s, 0) + n_words(t)
    p = np.array(sorted(total.values())) / sum(total.values())

    def measures(x):
        w = p**x / (p**x).sum()
        return -(w * np.log(w)).sum(), (w / p).max() / (w / p).min()

    def bisect(good):
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if good(mid) else (lo, mid)
        return lo

    by_entropy = 1.0 if measures(1.0)[0] >= entropy * math.log(len(p)) else bisect(lambda x: measures(x)[0] >= entropy * math.log(len(p)))
    by_repeats = 0.0 if measures(0.0)[1] <= repeats else bisect(lambda x: measures(x)[1] > repeats)
    shares = mixing.token_shares(spark.createDataFrame(sources, "doc_id long, text string, source string"))
    assert math.isclose(mixing.find_exponent(shares, entropy, repeats), max(by_entropy, by_repeats), abs_tol=1e-6)


def test_mixed_rows_meet_the_budget_in_blocks(spark, sources):
    rows = spark.createDataFrame(sources, "doc_id long, text string, source string")
    got = mixing.mix_sources(rows, block_docs=10).collect()
    x = mixing.find_exponent(mixing.token_shares(rows))
    total, by = {}, {}
    for _, t, s in sources:
        total[s] = total.get(s, 0) + n_words(t)
    z = sum((n / sum(total.values())) ** x for n in total.values())
    weight = {s: (n / sum(total.values())) ** x / z for s, n in total.items()}
    budget = max(total[s] / weight[s] for s in total)
    for r in got:
        by.setdefault(r["source"], []).append(r)
        assert r["__n_tokens"] == n_words(r["text"]) and math.isclose(r["__weight"], weight[r["source"]], rel_tol=1e-9)
    assert {r["doc_id"] for r in got} == {i for i, _, _ in sources}
    for s, rs in by.items():
        asked, read = weight[s] * budget, sum(r["__n_tokens"] for r in rs)
        assert read <= asked * (1 + 1e-9)
        whole = int(asked / total[s] + 1e-9)
        for e in range(whole):
            assert sorted(r["doc_id"] for r in rs if r["__epoch"] == e) == [i for i, _, t in sources if t == s]
        assert {r["__epoch"] for r in rs} <= set(range(whole + 1))
        # in each epoch a block is read as a whole before the next one begins
        for e in range(whole):
            runs = [b for b, _ in itertools.groupby(r["__block"] for r in sorted((r for r in rs if r["__epoch"] == e and r["__n_tokens"]), key=lambda r: r["__place"]))]
            assert len(runs) == len(set(runs))


def plain_base(text):
    """The base spans as the rules state them, by plain matching from left to right."""
    digits = lambda m: re.sub(r"[^0-9]", "", m)

    def luhn(d):
        return sum(c if k % 2 == 0 else sum(divmod(2 * c, 10)) for k, c in enumerate(map(int, reversed(d)))) % 10 == 0

    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in rules for m in re.finditer(p, text or "") if ok(m.group()))


def test_base_spans_equal_the_rules(spark):
    rnd = random.Random(9)
    parts = ["a.b@c.de", "x@y", "@z.com", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "5500005555555559", "1234", "+1 (499) 555-6503",
             "+7", "+44 20.7946 0958", "++1 234 567 89", "é", "\U0001f600", " ", "-", ".", "\n", "@", "a@b.c@d.e", "00", "0.0.0.0", "+", "(", "%"]
    texts = [None, "", "9" * 5000, "a" * 5000 + "@", "a@b.c" * 400] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 12))) for _ in range(600)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in personal_data.personal_spans(rows, None).select("doc_id", personal_data.joined("base").alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_base(t), t
