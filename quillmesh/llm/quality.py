"""Line-level quality with a linear-chain conditional random field (operator 8).

Every line of a text is a node with two states, good and bad.  Its features are shares of
upper case, symbols, exclamation marks, bars, repeated words, digits and so on, next to
those of the line before and the line behind; transitions tie neighbours together.  The
forward-backward marginals of *good*, weighted by line length, give a document's quality,
which a logistic curve maps to a probability of label 1.

Fitting happens on the driver over a bounded sample: at most SAMPLE_DOCS labelled
documents by hash of their id, of each at most SAMPLE_RUNS runs of RUN_LINES lines, spread
over the text.  Only features leave the executors.  Documents carry labels, lines do not:
lines of good documents count as good, and in bad documents those that a line classifier,
fitted first, finds bad, or else the worst one.

Scoring is one pass without a shuffle over whole texts, whatever their length.

Defined results: a null text is empty and has one empty line; documents in ``labels`` more
than once count by their mean label; without labels of both classes the score is the mean
label, or 0.5 without any; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import release, slices
from .sketches import PIECE, hash_words

SAMPLE_DOCS = 4000
SAMPLE_RUNS = 8
RUN_LINES = 64
FOLDS = 5
KEEP_FROM = 0.3
_SYMBOLS = b"#*&$%@^~=+<>{}[]\\_`"
_MARKS = b".,;:?'\"()-"


def _table(of: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(of)] = True
    return out


_IS_UPPER, _IS_LOWER = _table(bytes(range(65, 91))), _table(bytes(range(97, 123)))
_IS_DIGIT, _IS_BLANK = _table(b"0123456789"), _table(b" \t\r\n\x0b\x0c")
_IS_SYMBOL, _IS_MARK = _table(_SYMBOLS), _table(_MARKS)


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the lines of all texts, their lengths in bytes, and how many lines each text has."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    counts = np.array([r.count(b"\n") + 1 for r in raws])
    data = np.frombuffer(b"\n".join(raws), np.uint8)
    breaks = np.flatnonzero(data == 10)
    start, end = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(data)]])
    # whole lines, about PIECE bytes at once
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(start // PIECE)) + 1, [len(start)]])
    own = np.vstack([_own_features(data[start[i] : end[j - 1]], start[i:j] - start[i], end[i:j] - start[i]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)])
    text = np.repeat(np.arange(len(counts)), counts)
    before, after = np.zeros_like(own), np.zeros_like(own)
    joined = (text[1:] == text[:-1])[:, None]
    before[1:] = own[:-1] * joined
    after[:-1] = own[1:] * joined
    return np.hstack([np.ones((len(own), 1)), own, before[:, :6], after[:, :6]]), (end - start).astype("f8"), counts


def _own_features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(data)

    def per_line(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(n + 1, "i4")
        np.cumsum(mask, out=sums[1:])
        return (sums[end] - sums[start]).astype("f8")

    # in UTF-8 the letters U+00C0 to U+00DE end in bytes 80 to 9E after C3, their small forms in A0 to BE
    behind = np.concatenate([[0], data[:-1]]) if n else data
    upper = _IS_UPPER[data] | ((behind == 0xC3) & (data >= 0x80) & (data <= 0x9E))
    lower = _IS_LOWER[data] | ((behind == 0xC3) & (data >= 0xA0) & (data <= 0xBE))
    blank = _IS_BLANK[data]
    begins = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]])) if n else np.zeros(0, "i8")
    ends = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1 if n else np.zeros(0, "i8")
    words = hash_words(data, begins, ends)
    same = np.zeros(n, bool)
    same[begins[1:][words[1:] == words[:-1]]] = True
    first = np.zeros(n, bool)
    first[begins] = True

    size = (end - start).astype("f8")
    safe = np.maximum(size, 1)
    count = np.maximum(per_line(first), 1)
    caps, small = per_line(upper), per_line(lower)
    return np.stack(
        [
            caps / np.maximum(caps + small, 1),
            per_line(_IS_SYMBOL[data]) / safe * 4,
            per_line(data == 33) / safe * 8,
            per_line(data == 124) / safe * 8,
            per_line(same) / count,
            per_line(_IS_DIGIT[data]) / safe * 4,
            per_line(_IS_MARK[data]) / safe * 8,
            per_line(data >= 128) / safe,
            np.minimum(size / count, 30) / 10,
            np.log1p(size) / 8,
            size == 0,
        ],
        axis=1,
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class LineField:
    """Log odds of *good* per feature, transition scores [from, to], and the logistic curve over documents."""

    weights: np.ndarray
    transitions: np.ndarray
    curve: tuple[float, float]
    constant: float | None = None

    def messages(self, odds: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward log odds; ``odds`` has a row a sequence, sequences by falling length."""
        t, most = self.transitions, odds.shape[1]
        alive = np.searchsorted(-lengths, -np.arange(1, most + 1), "right")  # sequences of at least so many lines
        forward, backward = odds.copy(), np.zeros_like(odds)
        for i in range(1, most):
            k = alive[i]
            x = forward[:k, i - 1]
            forward[:k, i] += np.logaddexp(x + t[1, 1], t[0, 1]) - np.logaddexp(x + t[1, 0], t[0, 0])
        for i in range(most - 2, -1, -1):
            k = alive[i + 1]
            x = backward[:k, i + 1] + odds[:k, i + 1]
            backward[:k, i] = np.logaddexp(x + t[1, 1], t[1, 0]) - np.logaddexp(x + t[0, 1], t[0, 0])
        return forward, backward

    def marginals(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Probability of *good* for each line."""
        odds = features @ self.weights
        out = np.empty(len(odds))
        begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
        order = np.argsort(-counts, kind="stable")
        # sequences of like length share a matrix, which holds twice the lines there are at most
        at = 0
        while at < len(order):
            longest = counts[order[at]]
            to = at + int(np.searchsorted(-counts[order[at:]], -(longest // 2), "left")) if longest > 1 else len(order)
            rows = order[at : max(to, at + 1)]
            lengths = counts[rows]
            place = begin[rows][:, None] + np.arange(longest)[None, :]
            held = np.arange(longest)[None, :] < lengths[:, None]
            grid = np.where(held, odds[np.where(held, place, 0)], 0.0)
            forward, backward = self.messages(grid, lengths)
            out[place[held]] = _sigmoid(forward + backward)[held]
            at += len(rows)
        return out

    def quality(self, features: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the marginals, a text each."""
        good = self.marginals(features, counts)
        begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
        weight = np.where(np.repeat(np.add.reduceat(sizes, begin), counts) > 0, sizes, 1.0)
        return np.add.reduceat(good * weight, begin) / np.add.reduceat(weight, begin)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        a, b = self.curve
        return _sigmoid(a + b * self.quality(*line_features(texts)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 100) -> np.ndarray:
    """Newton's method; features first in x.

    A step that doesn't lower the penalised loss is halved: on classes that lie apart whole steps
    grow without bound.
    """

    def loss(w: np.ndarray) -> float:
        odds = x @ w
        return float(np.sum(np.logaddexp(0.0, odds) - y * odds) + penalty / 2 * (w @ w))

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        slope = x.T @ (p - y) + penalty * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        while (then := loss(w - step)) > now and np.abs(step).max() >= 1e-6:
            step /= 2
        if np.abs(step).max() < 1e-6:
            break
        w, now = w - step, then
    return w


def fit(runs: list[tuple[int, float, np.ndarray, np.ndarray]], rounds: int = 200, rate: float = 0.05, penalty: float = 1e-5) -> LineField:
    """A field out of ``(document, label, features, sizes)`` of runs of lines."""
    labels = {d: y for d, y, _, _ in runs}
    if len(set(labels.values())) < 2:
        return LineField(np.zeros(0), np.zeros((2, 2)), (0.0, 0.0), float(np.mean([*labels.values()])) if labels else 0.5)
    runs = sorted(runs, key=lambda r: (-len(r[3]), r[0]))
    counts = np.array([len(r[3]) for r in runs])
    x = np.vstack([r[2] for r in runs]).astype("f8")
    size = np.concatenate([r[3] for r in runs]).astype("f8")
    scale = np.maximum(x.std(0), 1e-3)  # one step size for all features
    scale[0] = 1.0
    x /= scale
    doc = np.repeat(np.array([r[0] for r in runs]), counts)
    good_doc = np.repeat(np.array([r[1] for r in runs]), counts)

    # which lines of bad documents are bad
    first = _sigmoid(x @ _logistic(x, good_doc, 0.1))
    y = np.where(good_doc == 1, 1.0, first > 0.5)
    order = np.lexsort((first, doc))
    worst = order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])]
    y[worst[good_doc[worst] == 0]] = 0.0

    most = counts[0]
    held = np.arange(most)[None, :] < counts[:, None]
    grid = np.zeros((len(runs), most, x.shape[1]), "f4")
    grid[held] = x
    truth = np.zeros((len(runs), most))
    truth[held] = y
    pairs = held[:, 1:]
    seen = np.array([[((truth[:, :-1] == i) & (truth[:, 1:] == j) & pairs).sum() for j in (0, 1)] for i in (0, 1)], "f8")
    field = LineField(_logistic(x, y, 0.1), np.zeros((2, 2)), (0.0, 0.0))
    moment, square = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
    for step in range(1, rounds + 1):  # gradient ascent on the conditional likelihood (Adam)
        odds = np.where(held, grid @ field.weights, 0.0)
        forward, backward = field.messages(odds, counts)
        p = _sigmoid(forward + backward)
        t = field.transitions
        ahead = (odds + backward)[:, 1:]
        joint = np.stack([np.stack([forward[:, :-1] * i + t[i, j] + ahead * j for j in (0, 1)]) for i in (0, 1)])
        joint = np.exp(joint - joint.max((0, 1)))
        joint = joint / joint.sum((0, 1)) * pairs
        slope = np.concatenate([
            np.tensordot(np.where(held, truth - p, 0.0), grid, 2) - penalty * len(x) * field.weights,
            (seen - joint.sum((2, 3)) - penalty * len(x) * t).ravel(),
        ]) / len(x)
        moment = 0.9 * moment + 0.1 * slope
        square = 0.999 * square + 0.001 * slope * slope
        move = rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        field.weights = field.weights + move[:-4]
        field.transitions = t + move[-4:].reshape(2, 2)

    docs, where = np.unique(doc, return_inverse=True)
    weight = np.maximum(size, 1e-9)
    good = field.marginals(x, counts)
    mean = np.bincount(where, good * weight) / np.bincount(where, weight)
    truth_of = np.array([labels[d] for d in docs.tolist()])
    a, b = _logistic(np.stack([np.ones(len(mean)), mean], 1), truth_of, 1e-2)
    field.curve = (float(a), float(b))
    field.weights = field.weights / scale
    return field


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LineField:
    """A field from the labelled documents that aren't held out."""
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
        .filter(F.col("quality").isin(0.0, 1.0) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_docs)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 32):
                features, size, counts = line_features(part.column(1).to_pylist())
                ids, label, xs, ns = [], [], [], []
                at = 0
                for i, n in enumerate(counts.tolist()):
                    starts = range(0, n, RUN_LINES)
                    chosen = starts if len(starts) <= SAMPLE_RUNS else [starts[round(j)] for j in np.linspace(0, len(starts) - 1, SAMPLE_RUNS)]
                    for s in chosen:
                        lines = slice(at + s, at + min(s + RUN_LINES, n))
                        ids.append(part.column(0)[i].as_py()), label.append(part.column(2)[i].as_py())
                        xs.append(features[lines].astype("f4").tobytes()), ns.append(size[lines].astype("f4").tobytes())
                    at += n
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(label, pa.int32()), pa.array(xs, pa.binary()), pa.array(ns, pa.binary())], ["doc_id", "label", "x", "n"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most sample_docs rows of two numbers
    chosen = texts.join(F.broadcast(usable), "doc_id").select("doc_id", "text", "label")
    rows = chosen.mapInArrow(run, "doc_id long, label int, x binary, n binary").toPandas().sort_values(["doc_id", "x"])
    runs = []
    for doc_id, label, x, n in rows.itertuples(index=False):
        sizes = np.frombuffer(n, "f4")
        runs.append((doc_id, float(label), np.frombuffer(x, "f4").reshape(len(sizes), -1), sizes))
    return fit(runs)


def score_documents(docs: DataFrame, field: LineField) -> DataFrame:
    """The input's columns and ``score``: probability of label 1."""
    plain = docs.drop("score")
    names = plain.columns
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in slices(batch):
                scores = pa.array(field.score(part.column(text).to_pylist()), pa.float64())
                yield pa.record_batch([*part.columns, scores], [*names, "score"])

    schema = plain.withColumn("score", F.lit(0.0)).schema
    return plain.mapInArrow(run, schema)
