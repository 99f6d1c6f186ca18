"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  A line's features describe its characters and words, and
those of the lines beside it; transition weights tie neighbouring labels.  Forward and
backward messages give each line's marginal probability of being good, and a document's
score is the mean of its lines' marginals weighted by their length.

Fitting (the documented bound): ``SAMPLE_DOCS`` documents of each label, those whose
hash is smallest, and of each at most ``SAMPLE_LINES`` lines in a row.  A document's
label is the label of its lines.  Features are made on the executors; only those of the
sample reach the driver.  Scoring reads whole texts, each on its own, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.common import text_or_empty

SAMPLE_DOCS = 1000
SAMPLE_LINES = 64
THRESHOLD = 0.7

UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
SYMBOLS = bytes(b"#$%&*+/<=>@[\\]^_`{|}~")
MARKS = bytes(b"!?")
STOPS = bytes(b".,;:'\"()-")
ENDS = (b".", b"!", b"?", b":", b'"', b"'", b")")
OWN = 14


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines, OWN) features of each line by itself, and the lines' lengths in characters (1 at least)."""
    out, sizes, seen = [], [], set()
    for line in text.split("\n"):
        raw = line.encode("utf-8", "replace")
        n = len(raw) or 1
        words = raw.split()
        k = len(words) or 1

        def share(chars: bytes) -> float:
            return (len(raw) - len(raw.translate(None, chars))) / n

        upper, symbols, marks = share(UPPER), share(SYMBOLS), share(MARKS)
        twice = sum(map(eq, words, words[1:])) / k
        again = float(line in seen and len(words) > 0)
        seen.add(line)
        out.append((
            min(len(words), 60) / 60, upper, float(upper > 0.4), symbols ** 0.5, float(symbols > 0.04), marks ** 0.5,
            share(DIGITS) ** 0.5, share(STOPS) ** 0.5, twice, float(twice > 0.2), len(set(words)) / k,
            again, min(len(raw) / k, 30) / 30, float(raw.rstrip().endswith(ENDS))))
        sizes.append(len(line) or 1)
    return np.array(out), np.array(sizes, float)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Features of each line, of the one before and of the one after, two edge flags and a constant."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    edge = np.zeros((len(own), 3))
    edge[0, 0] = edge[-1, 1] = 1
    edge[:, 2] = 1
    return np.hstack([own, before, after, edge])


WIDTH = 3 * OWN + 3


@dataclass
class Field:
    """Weights of the field: emission (for good against bad) and transitions [from, to]."""
    emission: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    #: Score of every document where no two labels were there to learn from.
    constant: float | None = None


def _step(odds: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Log odds (good to bad) of a message after one transition."""
    return np.logaddexp(odds + moves[1, 1], moves[0, 1]) - np.logaddexp(odds + moves[1, 0], moves[0, 0])


def _messages(e: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward (with a line's own evidence) and backward (without) log odds of every line."""
    docs, most = e.shape
    forward, backward = np.zeros_like(e), np.zeros_like(e)
    live = np.searchsorted(-lengths, -np.arange(most + 1), side="left")  # documents longer than t
    forward[:, 0] = e[:, 0]
    for t in range(1, most):
        n = live[t]
        forward[:n, t] = e[:n, t] + _step(forward[:n, t - 1], moves)
    for t in range(most - 2, -1, -1):
        n = live[t + 1]
        backward[:n, t] = _step(backward[:n, t + 1] + e[:n, t + 1], moves.T)
    return forward, backward


def _good(forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(forward + backward, -500, 500)))


def marginals(e: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """(documents, lines) probability of good; rows sorted by descending length, padding ignored."""
    return _good(*_messages(e, lengths, moves))


def _pad(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), int(lengths.max())))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out, lengths


def train(features: list[np.ndarray], labels: np.ndarray, rounds: int = 100, rate: float = 0.1,
          decay: float = 1e-3) -> Field:
    """Maximum likelihood of the label sequences (every line has its document's label), by Adam steps."""
    order = np.argsort([-len(x) for x in features], kind="stable")
    features, labels = [features[i] for i in order], labels[order]
    lengths = np.array([len(x) for x in features])
    x = np.vstack(features)
    doc = np.repeat(np.arange(len(features)), lengths)
    at = np.concatenate([np.arange(n) for n in lengths])
    y = labels[doc].astype(float)
    share = np.clip(labels.mean(), 0.05, 0.95)
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) / lengths  # documents, not lines, count alike
    theta, moves = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, v = np.zeros(len(theta) + 4), np.zeros(len(theta) + 4)
    follows = np.flatnonzero(at > 0)
    for r in range(1, rounds + 1):
        e = np.zeros((len(features), lengths.max()))
        e[doc, at] = x @ theta
        forward, backward = _messages(e, lengths, moves)
        p = _good(forward, backward)[doc, at]
        pairs = _pair_marginals(e, forward, backward, moves)
        grad = x.T @ ((y - p) * weight[doc]) - decay * theta
        gm = np.zeros((2, 2))
        w = weight[doc[follows]]
        for a in (0, 1):
            for b in (0, 1):
                real = (y[follows] == a) & (y[follows] == b)
                gm[a, b] = ((real - pairs[a][b][doc[follows], at[follows]]) * w).sum() - decay * moves[a, b]
        g = np.concatenate([grad, gm.ravel()]) / len(features)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        change = rate * (m / (1 - 0.9 ** r)) / (np.sqrt(v / (1 - 0.99 ** r)) + 1e-9)
        theta, moves = theta + change[:-4], moves + change[-4:].reshape(2, 2)
    return Field(theta, moves)


def _pair_marginals(e: np.ndarray, forward: np.ndarray, backward: np.ndarray,
                    moves: np.ndarray) -> list[list[np.ndarray]]:
    """[a][b][document, t]: probability of label a at t - 1 and b at t (t >= 1)."""
    logs = [[np.full_like(e, -np.inf) for _ in range(2)] for _ in range(2)]
    for a in (0, 1):
        for b in (0, 1):
            logs[a][b][:, 1:] = a * forward[:, :-1] + moves[a, b] + b * (e + backward)[:, 1:]
    top = np.maximum(np.maximum(logs[0][0], logs[0][1]), np.maximum(logs[1][0], logs[1][1]))
    top[:, 0] = 0
    raw = [[np.exp(logs[a][b] - top) for b in (0, 1)] for a in (0, 1)]
    total = raw[0][0] + raw[0][1] + raw[1][0] + raw[1][1]
    total[:, 0] = 1
    return [[raw[a][b] / total for b in (0, 1)] for a in (0, 1)]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
        sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> Field:
    """Learn from the rows of ``docs`` that ``labels`` (key, 0/1 label) marks.

    NULL keys and labels are ignored; of several labels of a key the largest counts; of
    repeated rows all may be drawn.  If a label is missing altogether, every score is the
    share of label 1 among the labelled (1 if there are none): nothing speaks against a text.
    """
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k_")).agg(
        F.max(label).cast("int").alias("y_"))
    first = Window.partitionBy("y_").orderBy("h_", "k_")
    # only a bounded number of keys goes to every task, and again only as many documents come back
    drawn = marked.join(docs.select(F.col(key).alias("k_")).distinct(), "k_", "left_semi") \
        .withColumn("h_", F.xxhash64("k_")).withColumn("n_", F.row_number().over(first)).where(F.col("n_") <= sample_docs)

    def flat(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            lines = t.as_py().split("\n")
            at = sum(map(len, lines)) % max(1, len(lines) - sample_lines + 1)  # a place that the text decides
            some = "\n".join(lines[at: at + sample_lines])
            out.append(with_neighbours(line_features(some)[0]).ravel())
        return pa.array(out, pa.list_(pa.float64()))

    again = Window.partitionBy("y_").orderBy("h_", "t_")
    rows = docs.select(F.col(key).alias("k_"), text_or_empty(text).alias("x_")) \
        .join(F.broadcast(drawn.select("k_", "y_", "h_")), "k_") \
        .withColumn("t_", F.xxhash64("x_")).withColumn("n_", F.row_number().over(again)).where(F.col("n_") <= sample_docs) \
        .select("y_", "h_", "t_", F.arrow_udf(flat, "array<double>")("x_").alias("f_")).collect()
    if len({r["y_"] for r in rows}) < 2:
        return Field(constant=float(np.mean([r["y_"] for r in rows])) if rows else 1.0)
    rows.sort(key=lambda r: (r["h_"], r["t_"]))
    return train([np.array(r["f_"]).reshape(-1, WIDTH) for r in rows], np.array([int(r["y_"] == 1) for r in rows]))


def score_texts(model: Field, texts: list[str]) -> list[float]:
    """Length-weighted mean marginal of each text; an empty text is one empty line."""
    if model.constant is not None:
        return [model.constant] * len(texts)
    if not texts:
        return []
    emissions, sizes = [], []
    for t in texts:
        own, size = line_features(t)
        emissions.append(with_neighbours(own) @ model.emission)
        sizes.append(size)
    out = np.zeros(len(texts))
    order = sorted(range(len(texts)), key=lambda i: -len(sizes[i]))
    at = 0
    while at < len(order):  # texts of like length together, so that padding stays small
        most = len(sizes[order[at]])
        some = order[at: at + max(1, min(256, (1 << 20) // most))]
        e, lengths = _pad([emissions[i] for i in some])
        p = marginals(e, lengths, model.moves)
        for row, i in enumerate(some):
            out[i] = float(np.dot(p[row, : lengths[row]], sizes[i]) / sizes[i].sum())
        at += len(some)
    return np.clip(out, 0, 1).tolist()


def score(model: Field, text: Column) -> Column:
    """Quality (0 to 1) of a text column; NULL counts as empty."""
    def scored(texts: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), 512):
            out += score_texts(model, [t.as_py() for t in texts[at: at + 512]])
        return pa.array(out, pa.float64())

    return F.arrow_udf(scored, "double")(F.coalesce(text, F.lit("")))
