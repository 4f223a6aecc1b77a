"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.hashing import LOWER, SPACE, PrefixHash, chunks, ranges, word_hashes

_SETS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".,;:'\"()?-",
    "bang": b"!",
    "bar": b"|",
    "mark": b"#$%&*+<=>@[\\]^_`{}~/",
}
_CLASS = {k: np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for k, v in _SETS.items()}
_CLASS["letter"] = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)) | (np.arange(256) >= 0xC0)
_CLASS["space"] = SPACE
OWN = 18
PIECE = 1 << 18  # bytes of text that are turned into features at once
FEATURES = 3 * OWN + 3


def _own_features(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, sizes and hashes of the lines of a buffer; every line ends in a line feed."""
    end = np.flatnonzero(buf == 10)
    start = np.concatenate([[0], end[:-1] + 1])
    size = end - start
    length = size + 1.0
    f = np.zeros((len(end), OWN), np.float32)
    f[:, 0] = np.log1p(size) / 5
    n = {name: np.add.reduceat(member[buf].view(np.int8), start, dtype=np.int64) for name, member in _CLASS.items()}
    n["space"] -= 1  # the line's end
    for k, name in enumerate(_CLASS):
        f[:, 1 + k] = n[name] / length
    low = LOWER[buf]
    hashes = PrefixHash(low)
    at, words = word_hashes(low, hashes)
    line = np.searchsorted(end, at, side="left")
    n_words = np.bincount(line, minlength=len(end))
    order = np.lexsort((words, line))
    same = (line[order][1:] == line[order][:-1]) & (words[order][1:] == words[order][:-1])
    repeats = np.bincount(line[order][1:][same], minlength=len(end))
    w = np.maximum(n_words, 1)
    f[:, 9] = np.minimum(n["mark"] / w, 4)
    f[:, 10] = np.minimum(n["bang"] / w, 3)
    f[:, 11] = np.minimum(n["bar"] / w, 2)
    f[:, 12] = np.minimum(size / w, 30) / 10
    f[:, 13] = repeats / w
    f[:, 14] = n["upper"] / np.maximum(n["upper"] + n["letter"], 1)
    f[:, 15] = np.isin(buf[np.maximum(end - 1, 0)], np.frombuffer(b".!?\"'", np.uint8)) & (size > 0)
    f[:, 16] = size == 0
    f[:, 17] = np.log1p(n_words) / 4
    return f, size, hashes.slices(start, end)


def line_features(texts: list[bytes], piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line of each text, the line's length and the text it belongs to.

    A line carries its own features, those of the line before and after it, and whether it is
    first, last or repeats within its text (A-Z lower-cased). Every text has at least one line.
    Lines are read in pieces of about ``piece`` bytes, so a text of many lines needs little memory
    beside its features.
    """
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    end = np.flatnonzero(buf == 10)
    text_end = np.cumsum([len(t) + 1 for t in texts]) - 1
    doc = np.searchsorted(text_end, end, side="left")
    cut = np.unique(np.searchsorted(end, np.arange(piece, len(buf), piece)))
    edge = np.unique(np.concatenate([[0], end[cut[cut < len(end)]] + 1, [len(buf)]]))
    parts = [_own_features(buf[a:z]) for a, z in zip(edge, edge[1:])]
    f, size, h = (np.concatenate([x[k] for x in parts]) for k in range(3))
    out = np.zeros((len(end), FEATURES), np.float32)
    out[:, :OWN] = f
    first, last = np.ones(len(end), bool), np.ones(len(end), bool)
    first[1:] = doc[1:] != doc[:-1]
    last[:-1] = first[1:]
    out[1:, OWN : 2 * OWN][~first[1:]] = f[:-1][~first[1:]]
    out[:-1, 2 * OWN : 3 * OWN][~last[:-1]] = f[1:][~last[:-1]]
    out[:, -3], out[:, -2] = first, last
    order = np.lexsort((h, doc))
    again = (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1]) & (size[order][1:] > 0)
    out[order[1:][again], -1] = 1
    out[order[:-1][again], -1] = 1
    return out, size + 1.0, doc


@dataclass
class LineCrf:
    """Weights of the chain, feature scaling and the calibration of document scores."""

    weights: np.ndarray  # of state good against bad, bias last
    steps: np.ndarray  # 2 x 2 transition scores
    mean: np.ndarray
    scale: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def emission(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]

    def document_logits(self, marginal: np.ndarray, length: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        """Log odds of the length-weighted mean of a document's line marginals."""
        p = np.bincount(doc, marginal * length, n_docs) / np.maximum(np.bincount(doc, length, n_docs), 1e-9)
        p = np.clip(p, 1e-6, 1 - 1e-6)
        return np.log(p / (1 - p))

    def score(self, texts: list[bytes]) -> np.ndarray:
        x, length, doc = line_features(texts)
        marginal, _, _ = forward_backward(self.emission(x), self.steps, doc)
        z = self.document_logits(marginal, length, doc, len(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -40, 40)))


def forward_backward(emission: np.ndarray, steps: np.ndarray, doc: np.ndarray):
    """Marginals of state good for each line, expected transitions summed over all chains, log Z.

    Lines of a chain are consecutive. All chains advance together, longest first, so each round
    works on the chains that still have a line.
    """
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    n = np.diff(np.concatenate([starts, [len(doc)]]))
    order = np.argsort(-n, kind="stable")
    starts, n = starts[order], n[order]
    live = np.searchsorted(-n, -np.arange(1, n[0] + 1), side="right") if len(n) else []
    e = np.stack([np.zeros(len(emission)), emission], 1)
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    for t, m in enumerate(live):
        at = starts[:m] + t
        if t == 0:
            alpha[at] = e[at]
        else:
            before = alpha[at - 1][:, :, None] + steps
            alpha[at] = np.logaddexp(before[:, 0], before[:, 1]) + e[at]
    for t in range(len(live) - 2, -1, -1):
        at = starts[: live[t + 1]] + t
        after = steps + (e[at + 1] + beta[at + 1])[:, None, :]
        beta[at] = np.logaddexp(after[:, :, 0], after[:, :, 1])
    total = alpha + beta
    log_z = np.logaddexp(total[:, 0], total[:, 1])
    marginal = np.exp(total[:, 1] - log_z)
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    pair = alpha[inner][:, :, None] + steps + (e[inner + 1] + beta[inner + 1])[:, None, :] - log_z[inner][:, None, None]
    ends = starts + n - 1
    return marginal, np.exp(pair).sum(0), np.logaddexp(alpha[ends, 0], alpha[ends, 1]).sum() if len(ends) else 0.0


def fit_line_crf(x: np.ndarray, length: np.ndarray, doc: np.ndarray, label: np.ndarray, rounds: int = 100, l2: float = 1e-3) -> LineCrf:
    """Maximum conditional likelihood with every line bearing its document's label.

    Documents weigh alike whatever their number of lines is, and both labels weigh the same.
    Adam steps on the full gradient; the document score is calibrated by logistic regression.
    """
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], 1)
    y = label[doc].astype(float)
    n_docs = len(label)
    good = max(label.mean(), 1e-3)
    weight = 1 / np.bincount(doc, minlength=n_docs)[doc] * np.where(y == 1, 0.5 / good, 0.5 / max(1 - good, 1e-3)) / n_docs
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    crf = LineCrf(np.zeros(z.shape[1]), np.zeros((2, 2)), mean, scale)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner].astype(int), y[inner + 1].astype(int)), 1)
    m = [np.zeros_like(crf.weights), np.zeros((2, 2))]
    v = [np.zeros_like(crf.weights), np.zeros((2, 2))]
    for t in range(1, rounds + 1):
        marginal, pairs, _ = forward_backward(z @ crf.weights, crf.steps, doc)
        grads = [z.T @ (weight * (y - marginal)) - l2 * crf.weights, (seen - pairs) / max(len(inner), 1) - 0.05 * crf.steps]
        for k, (g, p) in enumerate(zip(grads, (crf.weights, crf.steps))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p += 0.05 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    marginal, _, _ = forward_backward(z @ crf.weights, crf.steps, doc)
    logit = crf.document_logits(marginal, length, doc, n_docs)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of the calibration
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([((label - p) * logit).sum() - 0.1 * (a - 1), (label - p).sum()])
        h = np.array([[(w * logit**2).sum() + 0.1, (w * logit).sum()], [(w * logit).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -1, 1)
    crf.slope, crf.shift = float(max(a, 1e-3)), float(b)
    return crf


def _bytes(text) -> list[bytes]:
    return [(t if isinstance(t, str) else "").encode("utf-8", "surrogatepass") for t in text]


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_docs: int = 4000, max_lines: int = 2000, folds: int = 5) -> LineCrf:
    """Fit on at most ``max_docs`` labelled documents whose crc32(number) mod ``folds`` is not 0.

    The sample is a documented bound: of the labelled rows outside the held-out fold those with
    the smallest hashes of the document number, and of those the ones of at most ``max_lines`` lines
    (scoring takes all lines of all documents). Where no label, or only one class, is there,
    the model stays neutral: every document gets the share of good labels (0.5 without labels).
    """
    sample = (
        labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
        .where(f"label in (0, 1) and id is not null and crc32(cast(cast(id as string) as binary)) % {int(folds)} <> 0")
        .groupBy("id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(max_docs)
    )

    def features(batches):
        for pdf in batches:
            texts = _bytes(pdf["text"])
            few = np.array([t.count(b"\n") < max_lines for t in texts], bool)
            pdf, texts = pdf[few], [t for t, keep in zip(texts, few) if keep]
            y = pdf["label"].to_numpy()
            for i, j in chunks(texts, PIECE):
                x, length, doc = line_features(texts[i:j])
                cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])).tolist() + [len(doc)]
                yield pd.DataFrame({"id": pdf["id"].iloc[i:j].to_numpy(), "label": y[i:j], "x": [x[a:b].tobytes() for a, b in zip(cut, cut[1:])], "length": [length[a:b].tobytes() for a, b in zip(cut, cut[1:])]})

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(sample), "id").mapInPandas(
        features, "id long, label int, x binary, length binary"
    )
    got = sorted(rows.collect(), key=lambda r: (r["id"], r["x"]))
    y = np.array([r["label"] for r in got], float)
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return LineCrf(np.zeros(FEATURES + 1), np.zeros((2, 2)), np.zeros(FEATURES), np.ones(FEATURES), 0.0, float(np.log(p / (1 - p))))
    x = np.concatenate([np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in got])
    length = np.concatenate([np.frombuffer(r["length"], np.float64) for r in got])
    doc = np.repeat(np.arange(len(got)), [len(r["length"]) // 8 for r in got])
    return fit_line_crf(x, length, doc, y)


def score_documents(docs: DataFrame, model: LineCrf, text: str = "text", name: str = "score") -> DataFrame:
    """All rows and columns with the document's quality, 0 to 1, in a column ``name``.

    Every line of the whole text counts. A null text is treated as empty, which is one empty
    line; its score is what the model gives such a line. A column of the new name is replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def quality(texts: pa.Array) -> pa.Array:
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        out = np.zeros(len(texts))
        for i, j in ranges(size, PIECE):
            raw = [t or b"" for t in texts.slice(i, j - i).cast(pa.large_binary()).to_pylist()]
            out[i:j] = shared.value.score(raw)
        return pa.array(out)

    return docs.withColumn(name, quality(F.col(text)))
