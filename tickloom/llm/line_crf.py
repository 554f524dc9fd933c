"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad by features of itself and its neighbours; a document's score comes from
the forward-backward marginals of its lines, averaged by line length. Documents in one batch run in step,
longest first, so that long texts cost no more than their own lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import fold, labelled
from tickloom.ship import in_arrow

UPPER, LOWER, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
SYMBOLS, MARKS, SPACES = b"#*$%&|<>", b"!?", bytes((32, 9, 10, 11, 12, 13))
OTHER = bytes(set(range(33, 127)) - set(UPPER + LOWER + DIGITS + SYMBOLS + MARKS))
OWN = 13
#: Own features, then those of the line before and of the line after that neighbours pass on.
PASSED = (0, 2, 3, 4, 5, 12)
WIDTH = OWN + 2 * len(PASSED)


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x WIDTH) and lengths in bytes of the \\n-split lines of a text in UTF-8."""
    lines = text.split(b"\n")
    out = np.zeros((len(lines), OWN))
    seen: set[bytes] = set()
    for row, line in zip(out, lines, strict=True):
        n = len(line)
        size = lambda drop, line=line, n=n: n - len(line.translate(None, drop))
        tokens = line.split()
        words = len(tokens)
        upper, letters = size(UPPER), max(1, size(UPPER + LOWER))
        solid = max(1, n - size(SPACES))
        last = line.rstrip()[-1:]
        row[:] = (
            upper / letters, solid / max(1, words) / 10, size(SYMBOLS) / solid, size(MARKS) / solid, size(DIGITS) / solid, size(OTHER) / solid,
            np.log1p(n) / 5, words < 4, last in b".,;:\"'" and n > 0, line in seen and words > 0, min(3.0, size(SYMBOLS) / max(1, words)), min(3.0, size(MARKS) / max(1, words)),
            sum(map(eq, tokens, tokens[1:])) / max(1, words - 1),
        )
        seen.add(line)
    near = out[:, PASSED]
    edge = np.zeros((1, len(PASSED)))
    return np.hstack([out, np.vstack([edge, near[:-1]]), np.vstack([near[1:], edge])]), np.array([len(x) for x in lines], dtype=float)


@dataclass
class LineField:
    """Standardisation, node weights and bias for `good`, 2 x 2 transitions (bad, good), Platt line, prior."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    slope: float
    shift: float
    prior: float

    def node(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]

    def statistic(self, features: list[np.ndarray], lengths: list[np.ndarray]) -> np.ndarray:
        """Log odds of the length-weighted share of good lines."""
        counts = np.array([len(x) for x in features])
        good = marginals(self.node(np.vstack(features)), counts, self.steps)[0][:, 1]
        weight = np.concatenate(lengths) + 1e-3
        start = np.cumsum(counts) - counts
        mean = np.add.reduceat(good * weight, start) / np.add.reduceat(weight, start)
        mean = np.clip(mean, 1e-9, 1 - 1e-9)
        return np.log(mean / (1 - mean))

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        """Chance that the label is 1; the training share of label 1 for texts without a word."""
        out = np.full(len(texts), self.prior)
        full = [i for i, t in enumerate(texts) if t and t.split()]
        if full:
            made = [line_features(texts[i]) for i in full]
            z = self.slope * self.statistic([x for x, _ in made], [n for _, n in made]) + self.shift
            out[full] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return out


def marginals(node: np.ndarray, counts: np.ndarray, steps: np.ndarray, weight: np.ndarray | None = None, block: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over chains laid end to end: line marginals, summed pair marginals, log partition.

    `node` is the potential of good against bad, `counts` the lines of each chain (at least 1), `weight` what a
    line's pair with its successor counts for. Chains run in blocks side by side: what a block does to a message
    is a 2 x 2 matrix, these are chained, and each block then starts from the messages that reach it. So the
    result is that of whole chains, and a chain of n lines takes about 3 x `block` + 2 n / `block` steps.
    """
    move = np.exp(steps)
    top = np.maximum(node, 0)
    emit = np.stack([np.exp(-top), np.exp(node - top)], axis=1)
    parts = -(-counts // block)
    chain = np.repeat(np.arange(len(counts)), parts)
    number = np.arange(len(chain)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = (np.cumsum(counts) - counts)[chain] + number * block
    size = np.minimum(block, counts[chain] - number * block)
    order = np.argsort(-size, kind="stable")
    active = np.searchsorted(-size[order], -np.arange(size.max()), side="left")
    lead, tail = np.ones((len(chain), 2)), np.ones((len(chain), 2))
    by_number = np.argsort(number, kind="stable")
    edges = np.searchsorted(number[by_number], np.arange(parts.max() + 1))
    turns = np.tile(np.eye(2), (len(chain), 1, 1))
    if parts.max() > 1:
        for t in range(len(active)):
            some = order[: active[t]]
            moved = turns[some] @ move
            if t == 0:
                moved[number[some] == 0] = np.eye(2)
            moved *= emit[start[some] + t][:, None, :]
            turns[some] = moved / moved.sum(axis=(1, 2), keepdims=True)
        for k in range(1, parts.max()):
            some = by_number[edges[k] : edges[k + 1]]
            made = np.einsum("bi,bij->bj", lead[some - 1], turns[some - 1])
            lead[some] = made / made.sum(axis=1, keepdims=True)
        for k in range(parts.max() - 1, 0, -1):
            some = by_number[edges[k] : edges[k + 1]]
            made = np.einsum("bij,bj->bi", turns[some], tail[some])
            tail[some - 1] = made / made.sum(axis=1, keepdims=True)
    ahead, scale = np.empty_like(emit), np.empty(len(node))
    for t in range(len(active)):
        some = order[: active[t]]
        at = start[some] + t
        a = (lead[some] if t == 0 else ahead[at - 1]) @ move
        if t == 0:
            a[number[some] == 0] = 1.0
        a *= emit[at]
        scale[at] = s = a.sum(axis=1)
        ahead[at] = a / s[:, None]
    behind = np.empty_like(emit)
    last = start + size - 1
    behind[last] = tail / (ahead[last] * tail).sum(axis=1, keepdims=True)
    for t in range(len(active) - 2, -1, -1):
        at = start[order[: active[t + 1]]] + t
        behind[at] = (emit[at + 1] * behind[at + 1] / scale[at + 1][:, None]) @ move.T
    inner = np.ones(len(node), dtype=bool)
    inner[np.cumsum(counts) - 1] = False
    at = np.flatnonzero(inner)
    left = ahead[at] if weight is None else ahead[at] * weight[at][:, None]
    pairs = (left.T @ (emit[at + 1] * behind[at + 1] / scale[at + 1][:, None])) * move
    both = ahead * behind
    return both / both.sum(axis=1, keepdims=True), pairs, np.array(np.log(scale).sum() + top.sum())


def fit(features: list[np.ndarray], lengths: list[np.ndarray], labels: np.ndarray, rounds: int = 150) -> LineField | None:
    """Weights by gradient ascent on the conditional likelihood of whole documents, every line having its document's label.

    Lines and their pairs weigh so that both labels weigh the same. The Platt line is then fitted to whole
    documents. None where there are no labels of both kinds.
    """
    if len(set(labels.tolist())) < 2:
        return None
    x, y = np.vstack(features), np.repeat(labels, [len(f) for f in features])
    counts = np.array([len(f) for f in features])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    ends = np.cumsum(counts)
    inner = np.ones(len(x), dtype=bool)
    inner[ends - 1] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at], y[at + 1]), weight[at])
    w, steps = np.zeros(z.shape[1]), np.zeros((2, 2))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for k in range(1, rounds + 1):
        good, pairs, _ = marginals(z @ w, counts, steps, weight)
        step = np.concatenate([z.T @ ((y - good[:, 1]) * weight) - 1e-4 * w, (seen - pairs).ravel() - 1e-2 * steps.ravel()])
        m, v = 0.9 * m + 0.1 * step, 0.99 * v + 0.01 * step**2
        move = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, steps = w + move[:-4], steps + move[-4:].reshape(2, 2)
    model = LineField(mean, scale, w, steps, 1.0, 0.0, float(labels.mean()))
    s = model.statistic(features, lengths)
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * s + shift, -30, 30)))
        g = np.array([((labels - p) * s).sum() - 0.01 * slope, (labels - p).sum()])
        q = p * (1 - p) + 1e-9
        h = np.array([[(q * s * s).sum() + 0.01, (q * s).sum()], [(q * s).sum(), q.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        d *= min(1.0, 1.0 / max(1e-12, np.abs(d).max()))
        slope, shift = max(1e-3, slope + d[0]), shift + d[1]
    model.slope, model.shift = float(slope), float(shift)
    return model


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [line_features(x.as_py() or b"") for x in batch.column("text").cast(pa.binary())]
        flat, sizes = pa.array([f.ravel() for f, _ in made], pa.list_(pa.float64())), pa.array([n for _, n in made], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), flat, sizes], names=["doc_id", "label", "features", "lengths"])


def train(docs: DataFrame, labels: DataFrame, bound: int = 4000) -> LineField | None:
    """Learn from about `bound` different labelled texts at most (by a hash of doc_id) whose fold of 3 is not 1.

    A null doc_id or label, a doc_id labelled both ways and repeated rows teach nothing more; a null text is an empty
    line. None where there are no labels of both kinds.
    """
    sample = labelled(docs, labels.where(fold("doc_id", 3) != 1), bound)
    got = in_arrow(sample, _line_rows, "doc_id long, label int, features array<double>, lengths array<double>").toPandas()
    if not len(got):
        return None
    got = got.assign(n=[len(x) for x in got["lengths"]], s=[float(np.sum(x)) for x in got["features"]]).sort_values(["doc_id", "n", "s"], kind="stable")
    features = [np.asarray(x, dtype=float).reshape(-1, WIDTH) for x in got["features"]]
    return fit(features, [np.asarray(x, dtype=float) for x in got["lengths"]], got["label"].to_numpy(dtype=int))


def score(docs: DataFrame, model: LineField | None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, from the whole text alone.

    Null and wordless texts get the training share of label 1; with no model every score is 0.5. held_out is
    false for a null doc_id. Extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [x.as_py() for x in batch.column("text").cast(pa.binary())]
            made = model.score(texts) if model else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(made, pa.float64()), pa.array((made >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return in_arrow(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def line_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What `score` returns for every row of `docs`, learned from `labels`; without labels of both kinds every score is 0.5."""
    return score(docs, train(docs, labels))


def keep_good(docs: DataFrame, model: LineField | None, least: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns, that score `least` or more; all where there is no model.

    Null and wordless texts score the training share of label 1. Repeated rows and rows without a doc_id are judged like any.
    """
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = shared.value.score([x.as_py() for x in batch.column("text").cast(pa.string()).cast(pa.binary())])
            yield batch.filter(pa.array(made >= least))

    return in_arrow(docs, run, docs.schema)
