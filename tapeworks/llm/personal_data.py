"""Personal data: spans from fixed rules, and more from generated candidates that boosted trees judge.

DataFrame, SQL and pyspark.ml functions only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.state import checkpoint

KINDS = ["email", "ip", "card", "phone", "secret", "ssn", "iban"]
_LOCAL = "[A-Za-z0-9._%+-]"
#: The base rules, written so that no input makes the matcher go back far: runs are taken whole.
#: A run is entered at its first character or where the last match ended.
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the rule to be tried.
NEEDED = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9][0-9\x20-]{14}", "phone": r"\+[0-9]"}
#: High-recall generators; they may overlap each other and the base spans.
GENERATORS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9._%+-]{2,40}+\x20?[\[(]?\x20?(?:at|AT|@)\x20?[\])]?\x20?[A-Za-z0-9-]{2,40}+\x20?[\[(]?\x20?(?:dot|DOT|\.)\x20?[\])]?\x20?[A-Za-z]{2,6}+",
    "phone": r"(?<![0-9.+-])(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[\x20.-][0-9]{2,4}){2,4}(?![0-9.-])",
    "secret": r"(?<![A-Za-z0-9])[A-Za-z_-]{3,20}+\x20?[:=]\x20?[\"'][A-Za-z0-9+/_=.-]{16,}+[\"']",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])",
}
GENERATOR_NEEDED = {
    "email": r"(?:\b(?:at|AT)\b[\x20\])]|@).{0,60}(?:\b(?:dot|DOT)\b|\.)", "phone": r"[0-9]{2,4}\)?[\x20.-][0-9]{2,4}[\x20.-][0-9]{2}",
    "secret": r"[A-Za-z_]\x20?[:=]\x20?[\"']", "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}",
}
FEATURES = ["size", "digits", "letters", "capitals", "groups", "dots", "dashes", "spaces", "parens", "variety", "tel", "mail", "key", "identity", "quote_before", "word_before", "word_after", "slash", "is_phone", "is_secret", "is_email"]
_STEP = 256


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)


def matches(text: Column, pattern: str, needed: str) -> Column:
    """array<struct<start, text>> of leftmost matches that do not overlap; code points from 0.

    Starts are running sums of the lengths of what lies before. They are summed in steps of
    256 matches, so the work grows little faster than the number of matches.
    """
    tried = text.rlike(needed)
    none = F.array().cast("array<struct<start:long,text:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    length = F.transform(F.arrays_zip(F.slice(between, 1, F.size(found)).alias("p"), found.alias("m")), lambda z: F.struct(F.length(z["p"]).cast("long").alias("gap"), (F.length(z["p"]) + F.length(z["m"])).cast("long").alias("all"), z["m"].alias("m")))

    def placed(x: Column) -> Column:
        total = F.transform(x, lambda z: z["all"])
        steps = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / _STEP).cast("int")), lambda k: _sum(F.slice(total, k * _STEP + 1, _STEP)))
        upto = F.transform(steps, lambda _, k: _sum(F.slice(steps, F.lit(1), k)))
        return F.transform(x, lambda z, i: F.struct((F.get(upto, F.floor(i / _STEP).cast("int")) + _sum(F.slice(total, F.floor(i / _STEP).cast("int") * _STEP + 1, i % _STEP)) + z["gap"]).alias("start"), z["m"].alias("text")))

    # one pass through a one-element array binds the intermediate result to a name
    bound = F.element_at(F.transform(F.array(length), lambda x: F.when(F.size(x) > 0, placed(x)).otherwise(none)), 1)
    return F.when(tried, bound).otherwise(none)


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]+", "")


def _luhn(t: Column) -> Column:
    d = _digits(t)
    n = F.length(d)
    terms = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.substring(d, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1),
    )
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def _valid(kind: str, t: Column) -> Column:
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)"
        return t.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        n = F.length(_digits(t))
        return F.when(n.between(16, 19), _luhn(t)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(t)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    """For each base kind the array of its valid matches; a match that fails is not tried again."""
    test = lambda kind: lambda m: _valid(kind, m["text"])
    return {k: F.filter(matches(text, BASE[k], NEEDED[k]), test(k)) for k in BASE}


def _span(kind: str):
    return lambda m: F.struct(F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["text"])).alias("end"))


def _features(kind: str, t: Column, before: Column, after: Column) -> list[Column]:
    count = lambda p: F.length(F.regexp_replace(t, f"[^{p}]+", "")).cast("double")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    near = F.lower(before)
    value = F.regexp_replace(t, r"^.*[:=]\x20?[\"']|[\"']$", "")
    return [
        F.length(t).cast("double"), count("0-9"), count("A-Za-z"), count("A-Z"),
        F.size(F.split(t, r"[^A-Za-z0-9]++")).cast("double"), count("."), count("\\-"), count(" "), count("()"),
        F.size(F.array_distinct(F.split(value, ""))) / F.greatest(F.length(value), F.lit(1)),
        flag(near.rlike(r"tel|phone|call|fax|mobil|handy")), flag(near.rlike(r"mail|contact|write")),
        flag(F.lower(t).rlike(r"token|key|secret|passw|api|auth")), flag(near.rlike(r"ssn|social|iban|account|passport|card")),
        flag(before.rlike(r"[\"'(<\[]\s*$")), flag(before.rlike(r"[A-Za-z]\s*$")), flag(after.rlike(r"^\s*[A-Za-z]")),
        flag(t.rlike("/")), F.lit(float(kind == "phone")), F.lit(float(kind == "secret")), F.lit(float(kind == "email")),
    ]


def candidates(text: Column) -> Column:
    """All generated spans with their features: array<struct<kind, start, end, strict, loose, f0..>>.

    ``strict`` marks a candidate that a format check proves (it is learnt as personal),
    ``loose`` one that a format check refutes (learnt as not personal).
    """

    def row_of(kind: str):
        def row(m):
            t = m["text"]
            before = F.substring(text, F.greatest(m["start"] - 23, F.lit(1)).cast("int"), F.least(m["start"], F.lit(24)).cast("int"))
            after = F.substring(text, (m["start"] + F.length(t) + 1).cast("int"), F.lit(8))
            n = F.length(_digits(t))
            value = F.regexp_replace(t, r"^.*[:=]\x20?[\"']|[\"']$", "")
            strict = {
                "email": t.rlike(r"@[A-Za-z0-9-]+\.[A-Za-z]") | t.rlike(r"[\[(](?:at|AT)[\])]"),
                "phone": n.between(10, 12) & t.rlike(r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$"),
                "secret": t.rlike("(?i)^[a-z_-]*(?:token|secret|passw|api_?key|auth)") & value.rlike("[0-9]") & value.rlike("[A-Za-z]"),
                "ssn": ~t.rlike("^(?:000|666|9)"),
                "iban": n >= 12,
            }[kind]
            loose = {
                "email": t.rlike(r"^[A-Za-z]+ at [A-Za-z]+ ?\. ?[A-Z]?[a-z]+$"),
                "phone": (n < 8) | (n > 13) | t.rlike(r"^(?:19|20)[0-9]{2}[.-][0-9]{2}[.-][0-9]{2}$"),
                "secret": ~value.rlike("[0-9]"), "ssn": t.rlike("^(?:000|666|9)"), "iban": n < 8,
            }[kind]
            f = [c.cast("double").alias(f"f{i}") for i, c in enumerate(_features(kind, t, before, after))]
            end = (m["start"] + F.length(t)).alias("end")
            return F.struct(F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), end, strict.alias("strict"), (loose & ~strict).alias("loose"), *f)

        return row

    return F.concat(*[F.transform(matches(text, p, GENERATOR_NEEDED[k]), row_of(k)) for k, p in GENERATORS.items()])


@dataclass
class SpanTrees:
    """Boosted trees as nested (feature, threshold, low, high) with leaf values, and the threshold of each kind."""

    trees: list
    weights: list[float]
    thresholds: dict[int, float]

    def margin(self, feature) -> Column:
        """Column of the summed trees; ``feature(i)`` gives the Column of feature i."""

        def walk(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(node)
            i, at, low, high = node
            return F.when(feature(i) <= at, walk(low)).otherwise(walk(high))

        total = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights):
            total = total + F.lit(weight) * walk(tree)
        return total

    def probability(self, feature) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(self.margin(feature) * -2.0))


def _parsed(debug: str):
    """The tree that a model's printed form shows."""
    lines = [x for x in debug.splitlines() if re.match(r"\s*(?:If|Else|Predict)", x)]

    def node(i: int):
        if m := re.match(r"\s*Predict: (\S+)", lines[i]):
            return float(m[1]), i + 1
        m = re.match(r"\s*If \(feature (\d+) <= (\S+)\)", lines[i])
        low, i = node(i + 1)
        high, i = node(i + 1)  # the line of the Else is passed over
        return (int(m[1]), float(m[2]), low, high), i

    return node(0)[0]


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_docs: int = 20_000, rounds: int = 8, precision: float = 0.95) -> SpanTrees | None:
    """Fit on the candidates of at most ``max_docs`` documents (those of smallest hash).

    Format checks give the labels; candidates that no check settles are not learnt from. Two thirds
    of those documents grow the trees (of ten times as many, while they show one label only), all
    other documents calibrate: each kind gets the least threshold
    at which ``precision`` of its candidates are personal, a kind without such candidates that of all
    kinds together. Where every settled candidate of the table is personal all are taken; None where none is.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("id is not null")

    def settled(x: DataFrame) -> DataFrame:
        return x.select("id", F.explode(candidates(F.col("text"))).alias("c")).where("c.strict or c.loose").select(
            "id", F.col("c.kind").alias("kind"), F.col("c.strict").cast("double").alias("label"), *[F.col(f"c.f{i}") for i in range(len(FEATURES))]
        )

    n_docs = None
    while True:
        grow = rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(max_docs).where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) > 0)
        grow = checkpoint(grow)
        flat = checkpoint(settled(rows.join(F.broadcast(grow), "id")))
        labels = {r["label"] for r in flat.select("label").distinct().collect()}
        n_docs = rows.select("id").distinct().count() if len(labels) < 2 and n_docs is None else n_docs
        if len(labels) == 2 or max_docs >= n_docs:
            break
        max_docs *= 10
    if len(labels) < 2:  # the calibrating documents may still show the other label
        labels = {r["label"] for r in settled(rows).select("label").distinct().collect()}
        if 1.0 not in labels:
            return None
        if 0.0 not in labels:
            return SpanTrees([], [], {k: 0.0 for k in range(len(KINDS))})
        grow, flat = grow.limit(0), checkpoint(settled(rows))
    names = [f"f{i}" for i in range(len(FEATURES))]
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(flat.coalesce(4))
    model = GBTClassifier(maxIter=rounds, maxDepth=3, stepSize=0.3, seed=11, cacheNodeIds=False).fit(ready)
    out = SpanTrees([_parsed(t.toDebugString) for t in model.trees], list(model.treeWeights), {})
    rest = settled(rows.join(F.broadcast(grow), "id", "left_anti"))
    bins = (
        rest.select("kind", "label", F.floor(out.probability(lambda i: F.col(f"f{i}")) * 50).alias("bin"))
        .groupBy("kind", "bin").agg(F.sum("label").alias("good"), F.count("*").alias("n")).orderBy(F.col("bin").desc(), "kind").collect()
    )

    def least(of: list) -> float:
        at, good, n = 2.0, 0.0, 0.0
        for b in sorted({r["bin"] for r in of}, reverse=True):
            good, n = good + sum(r["good"] for r in of if r["bin"] == b), n + sum(r["n"] for r in of if r["bin"] == b)
            if good >= precision * n and b >= 25:
                at = b / 50
        return at

    for kind in range(len(KINDS)):
        out.thresholds[kind] = least([r for r in bins if r["kind"] == kind] or bins)
    return out


def personal_spans(docs: DataFrame, model: SpanTrees | None, text: str = "text") -> DataFrame:
    """All rows and columns with ``base`` and ``spans``, arrays of struct<kind, start, end> (code points, end exclusive).

    ``base`` holds the spans of the fixed rules; ``spans`` those and the candidates that the trees
    accept and that do not meet a base span or an accepted one that starts earlier in their kind.
    ``kind`` is the place in ``KINDS``. Both are sorted by kind, then start. A null text is
    empty and has none. Columns of these names are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    found = base_spans(t)
    base = F.concat(*[F.transform(found[k], _span(k)) for k in BASE])
    rows = docs.withColumn("base", base)
    if model is None or not model.thresholds:
        return rows.withColumn("spans", F.col("base"))
    levels = F.array(*[F.lit(float(model.thresholds.get(k, 2.0))) for k in range(len(KINDS))])
    rows = rows.withColumn("__cand", candidates(t))
    apart = lambda c, s: (c["end"] <= s["start"]) | (c["start"] >= s["end"])
    taken = F.filter("__cand", lambda c: (model.probability(lambda i: c[f"f{i}"]) >= F.get(levels, c["kind"])) & F.forall("base", lambda s: apart(c, s)))
    spans = F.transform(taken, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return rows.withColumn("spans", F.array_sort(F.concat(F.col("base"), spans))).drop("__cand")


def joined(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: SpanTrees | None, text: str = "text") -> DataFrame:
    """All rows with ``redacted``: each found span replaced by its kind in angle brackets; overlaps go to the earlier span."""
    rows = personal_spans(docs, model, text)
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))
    t = F.coalesce(F.col(text), F.lit(""))
    cut = F.aggregate(
        by_start, start,
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(
            F.struct(F.concat(a["done"], F.substring(t, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.get(names, s["kind"])).alias("done"), s["end"].cast("long").alias("at"))
        ),
        lambda a: F.concat(a["done"], F.substring(t, (a["at"] + 1).cast("int"), F.length(t))),
    )
    return rows.withColumn("redacted", cut)
