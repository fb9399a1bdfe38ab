"""Document quality by a linear-chain conditional random field over the lines of a document.

Every line gets shape features of its own and of its two neighbours. The chain labels each line good or bad; training takes
the document's label as the label of its lines. A document's quality is the mean of the forward-backward marginals of
"good", weighted by line length, brought to a probability by a logistic curve fitted on the training documents.

Training uses a bounded sample: the SAMPLE labelled documents with the smallest hash of their id, in the order of that hash while their lines come to
MAX_TRAIN_LINES at most; documents of over a twentieth of that are passed over. The lines are counted on the executors before any features are
made, so the driver gets features of MAX_TRAIN_LINES lines at most. Scoring reads every document, whole.

Edge cases: a null text is an empty one; an empty text has one empty line and gets a score like any other; without any
labelled document, or with one class only, scores are the share of that class (0.5 if none); an empty table gives
an empty table. id, language and source never enter a score.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapwing.llm.common import cut, text_of

SAMPLE = 4000
MAX_TRAIN_LINES = 200_000
STEPS = 150
OWN = 21  # features of a line itself
_WORD = re.compile(r"\S+")
_SYMBOL = re.compile(r"[^\w\s]")
_HARD = re.compile(r"[#$%&*<>{}\[\]|\\^~=+@_/]")
_RUN = re.compile(r"([^\w\s])\1+")
_DIGIT = re.compile(r"\d")
_END = re.compile(r"[.!?…:;\"')\]]\s*$")


def line_features(line: str) -> list[float]:
    """Shape of a line: shares of kinds of characters, word lengths, repetition, size."""
    words = _WORD.findall(line)
    n, m = len(line), len(words)
    if not m:
        return [1.0] + [0.0] * (OWN - 1)
    low = [w.lower() for w in words]
    letters = sum(map(str.isalpha, line))
    upper = sum(map(str.isupper, line))
    symbols = len(_SYMBOL.findall(line))
    hard = len(_HARD.findall(line))
    runs = sum(len(x.group()) for x in _RUN.finditer(line))
    distinct = len(set(low))
    size = [len(w) for w in words]
    mean = sum(size) / m
    return [
        0.0,
        letters / n,
        upper / max(1, letters),
        symbols / n,
        min(1.0, symbols / m),
        hard / n,
        min(1.0, hard / m),
        runs / n,
        min(1.0, runs / m),
        len(_DIGIT.findall(line)) / n,
        distinct / m,
        1.0 - len(set(zip(low, low[1:]))) / (m - 1) if m > 1 else 0.0,
        float(m > 10 and distinct / m < 0.3),
        min(mean, 20) / 10,
        min(max(size), 40) / 40,
        min(np.log1p(m), 8) / 4,
        float(m < 4),
        float(bool(_END.search(line))),
        float(line[:1].isupper()),
        line.count("!") / m if m else 0.0,
        float("http" in line or "www." in line),
    ]


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A row for each line: bias, own, previous and next line's features; and the line lengths."""
    lines = text.split("\n")
    own = np.array([line_features(x) for x in lines], np.float32)
    none = np.zeros((1, OWN), np.float32)
    x = np.hstack([np.ones((len(lines), 1), np.float32), own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none])])
    return x, np.array([len(x) + 1 for x in lines], np.float64)


class Chain(NamedTuple):
    weights: np.ndarray  # of "good" against "bad", a feature each
    moves: np.ndarray  # 2 x 2: from label, to label
    curve: tuple[float, float]  # logit(score) = curve[0] + curve[1] * logit(marginal)


def _softmax2(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=-1, keepdims=True)
    return top[..., 0] + np.log(np.exp(a - top).sum(axis=-1))


def forward_backward(unary: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of "good" for each line, and summed pair marginals (2 x 2), for chains that lie one after another.

    unary: score of "good" for each line. The chains advance together, longest first, so each step is one array operation.
    """
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    size = sizes[order]
    longest = int(size[0]) if len(size) else 0
    alive = [int(np.searchsorted(-size, -t, side="left")) for t in range(longest)]  # chains with more than t lines
    e = np.zeros((len(unary), 2))
    e[:, 1] = unary
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    for t in range(longest):
        at = starts[: alive[t]] + t
        alpha[at] = e[at] + (_softmax2(alpha[at - 1][:, None, :] + moves.T[None]) if t else 0)
    for t in range(longest - 2, -1, -1):
        at = starts[: alive[t + 1]] + t
        beta[at] = _softmax2(moves[None] + (e[at + 1] + beta[at + 1])[:, None, :])
    both = alpha + beta
    z = _softmax2(both)
    good = np.exp(both[:, 1] - z)
    first = np.zeros(len(unary), bool)
    first[starts] = True
    at = np.flatnonzero(~first)
    pairs = np.exp(alpha[at - 1][:, :, None] + moves[None] + (e[at] + beta[at])[:, None, :] - z[at][:, None, None]).sum(axis=0) if len(at) else np.zeros((2, 2))
    return good, pairs


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def document_marginals(good: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    starts = np.cumsum(sizes) - sizes
    return np.add.reduceat(good * lengths, starts) / np.add.reduceat(lengths, starts)


def fit(x: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, labels: np.ndarray, l2: float = 1e-4, steps: int = STEPS) -> Chain:
    """Maximises the likelihood of the labels by Adam over the whole sample; documents weigh alike, and so do the classes."""
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        return Chain(np.zeros(x.shape[1] if x.ndim == 2 else 3 * OWN + 1), np.zeros((2, 2)), (float(_logit(share)), 0.0))
    y = np.repeat(labels, sizes).astype(float)
    balance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    weight = np.repeat(balance / sizes, sizes) / len(sizes)
    pair_weight = weight.sum() / len(y)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    inner = np.ones(len(y), bool)
    inner[np.cumsum(sizes) - sizes] = False
    seen = np.zeros((2, 2))
    for k in (0, 1):
        seen[k, k] = (y[inner] == k).sum()
    for t in range(1, steps + 1):
        w, moves = theta[:-4], theta[-4:].reshape(2, 2)
        good, pairs = forward_backward(x @ w, sizes, moves)
        g = np.concatenate([x.T @ (weight * (y - good)), ((seen - pairs) * pair_weight).ravel()]) - l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta += 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    w, moves = theta[:-4], theta[-4:].reshape(2, 2)
    s = np.clip(_logit(document_marginals(forward_backward(x @ w, sizes, moves)[0], lengths, sizes)), -12, 12)
    a = b = 0.0
    for _ in range(50):  # Newton steps of the logistic curve
        p = 1 / (1 + np.exp(-(a + b * s)))
        r = p * (1 - p) + 1e-9
        h = np.array([[r.sum() + 1e-3, (r * s).sum()], [(r * s).sum(), (r * s * s).sum() + 1e-3]])
        a, b = np.array([a, b]) + np.linalg.solve(h, np.array([(labels - p).sum() - 1e-3 * a, ((labels - p) * s).sum() - 1e-3 * b]))
        a, b = float(np.clip(a, -20, 20)), float(np.clip(b, -5, 5))
    return Chain(w, moves, (a, b))


def score_texts(texts: list[str], model: Chain) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    parts = [document_features(t) for t in texts]
    sizes = np.array([len(x) for x, _ in parts])
    good, _ = forward_backward(np.concatenate([x for x, _ in parts]) @ model.weights, sizes, model.moves)
    s = np.clip(_logit(document_marginals(good, np.concatenate([n for _, n in parts]), sizes)), -12, 12)
    return 1 / (1 + np.exp(-(model.curve[0] + model.curve[1] * s)))


def sample_of(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """__id and __y of the labelled documents to learn from: in the order of a hash of their ids, `sample` at most, while the lines of all texts with these ids
    stay within MAX_TRAIN_LINES; a document of over a twentieth of that is passed over. Lines are counted where the texts are."""
    marked = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.max(label_col).cast("int").alias("__y"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(sample)
    )
    text = text_of(text_col)
    lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    sized = docs.select(F.col(id_col).alias("__id"), lines.alias("__lines")).join(F.broadcast(marked), "__id")  # at most `sample` rows
    sized = sized.groupBy("__id").agg(F.sum("__lines").alias("__lines"), F.first("__y").alias("__y")).where(F.col("__lines") <= MAX_TRAIN_LINES // 20)
    upto = F.sum("__lines").over(Window.orderBy(F.xxhash64("__id"), "__id"))  # over `sample` rows
    return sized.withColumn("__upto", upto).where(F.col("__upto") <= MAX_TRAIN_LINES).select("__id", "__y")


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Chain:
    """Fits the chain on a bounded sample of the labelled rows."""
    marked = cut(sample_of(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, sample=sample), "labelled-sample")

    def features(batches):
        for b in batches:
            rows = [document_features(t) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "y": b["y"], "x": [x.astype("<f4").tobytes() for x, _ in rows], "n": [n.tobytes() for _, n in rows]})

    rows = (
        docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("text"))
        .join(F.broadcast(marked), "__id")  # at most `sample` rows
        .select(F.col("__id").alias("id"), F.col("__y").alias("y"), "text")
        .mapInPandas(features, "id long, y int, x binary, n binary")
    )
    width = 3 * OWN + 1
    kept = sorted(rows.collect(), key=lambda r: (r["id"], r["x"]))  # MAX_TRAIN_LINES lines at most
    x = np.concatenate([np.frombuffer(r["x"], "<f4").reshape(-1, width) for r in kept]) if kept else np.zeros((0, width))
    lengths = np.concatenate([np.frombuffer(r["n"], np.float64) for r in kept]) if kept else np.zeros(0)
    return fit(x.astype(np.float64), lengths, np.array([len(r["n"]) // 8 for r in kept], int), np.array([r["y"] for r in kept], int))


def score(docs: DataFrame, model: Chain, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score, in place of an input column of that name; every other column as it was."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts([t or "" for t in texts], shared.value))

    return docs.withColumn(score_col, scored(F.col(text_col)))
