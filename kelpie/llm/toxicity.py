"""Toxicity by a classifier chain of linear models.

Categories are predicted one after another; each model sees the text's features and the probabilities the earlier
models gave. In training those are out-of-fold predictions: a row's probability comes from models that were not
fitted on it, so a later model learns from inputs as good as those it will get. Features are words and their
prefixes (inflections and compounds share them), once for occurring and once for occurring `OFTEN` times or more.
Models are logistic regressions over the features that tell a category most.

Features are chosen for each model on the rows it is fitted on, so no label of a fold has a part in the out-of-fold
probabilities of that fold.

Training takes a bounded sample of the labelled rows: the `max_train` with the smallest hash of their id. Features
are counted over the cluster, and only those that tell a category reach the driver. Scoring
is one map pass over all rows; the model that is broadcast has at most `max_features` weights a category.

Defined results: null texts are empty and get the models' base rate; rows with a null label in any category do
not train; an id labelled twice takes the larger label; a category that has but one label, or no rows, gets a
constant probability (0 without rows); features that tell a category alike are taken by their number; a very long
text is read whole; repeated rows get a row each; an empty table gives an empty result. Only the id, text and labels
are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.llm.common import cut, map_rows, text_or_empty

TOKEN = re.compile(r"\w+")
PREFIXES = (4, 5, 6, 7)
OFTEN = 3
BITS = 24
FOLDS = 3
CACHE = 300_000


def word_features(word: str) -> tuple[int, ...]:
    """Hashes of the whole word and of its prefixes."""
    return tuple(zlib.crc32(x.encode()) >> (32 - BITS) for x in ("=" + word, *[word[:k] for k in PREFIXES if len(word) >= k]))


def features(text: str, of: Callable[[str], tuple[int, ...]]) -> list[int]:
    """Distinct features of a text; the same number + 2**BITS where it occurs often."""
    counts = Counter(chain.from_iterable(map(of, TOKEN.findall(text.lower()))))
    return [*counts, *[f | 1 << BITS for f, c in counts.items() if c >= OFTEN]]


def cached(select: Callable[[str], tuple[int, ...]]) -> Callable[[str], tuple[int, ...]]:
    held: dict[str, tuple[int, ...]] = {}

    def get(word: str) -> tuple[int, ...]:
        got = held.get(word)
        if got is None:
            if len(held) >= CACHE:
                held.clear()
            got = held[word] = select(word)
        return got

    return get


@dataclass
class Linear:
    """Logistic regression: bias, weights of the selected features, weights of the earlier categories."""

    bias: float
    weights: dict[int, float]
    earlier: list[float]

    def probability(self, z: float, given: list[float]) -> float:
        z += self.bias + sum(w * p for w, p in zip(self.earlier, given, strict=True))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


@dataclass
class Chain:
    categories: list[str]
    models: list[Linear]
    thresholds: list[float]


class Rows:
    """Sparse rows: features of row i stand at ids[starts[i]:starts[i + 1]]."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(r) for r in rows])
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        self.names = np.unique(flat)
        self.ids = np.searchsorted(self.names, flat).astype(np.int32)

    def select(self, y: np.ndarray, use: np.ndarray, most: int) -> np.ndarray:
        """The features that tell y best on the rows in use: largest |z| of the difference of two rates.

        The names held have to include these, as telling() makes sure; others that are held change nothing.
        """
        m = len(self.names)
        on = use[self.row]
        pos = np.bincount(self.ids[on & y[self.row]], minlength=m)
        all_ = np.bincount(self.ids[on], minlength=m)
        n, p = max(1, use.sum()), max(1, (use & y).sum())
        rate = (all_ + 0.5) / (n + 1)
        z = np.abs(pos - p * rate) / np.sqrt(p * rate * (1 - rate) + 1e-9)
        z[all_ < 3] = 0
        best = np.argsort(-z, kind="stable")[:most]
        return np.sort(best[z[best] > 2])


def fit(rows: Rows, y: np.ndarray, given: np.ndarray, use: np.ndarray, most: int, steps: int = 80, l2: float = 1.0) -> tuple[Callable[[], np.ndarray], Linear]:
    """A model fitted on the rows in use, and the probabilities it gives to all rows."""
    n = int(use.sum())
    rate = float((y & use).sum() / n) if n else 0.0
    if rate in (0.0, 1.0):
        constant = -30.0 if rate == 0 else 30.0
        return (lambda: np.full(rows.n, rate)), Linear(constant, {}, [0.0] * given.shape[1])
    chosen = rows.select(y, use, most)
    at = np.full(len(rows.names), -1, np.int32)
    at[chosen] = np.arange(len(chosen), dtype=np.int32)
    slot = at[rows.ids]
    r, c = rows.row[slot >= 0], slot[slot >= 0]
    # rows' features are scaled alike, so one step size fits all: Adam over the full batch
    w, g2 = np.zeros(len(chosen) + given.shape[1] + 1), np.zeros(len(chosen) + given.shape[1] + 1)
    w[-1], m1 = np.log(rate / (1 - rate)), np.zeros_like(w)
    k = len(chosen)

    def logits() -> np.ndarray:
        return np.bincount(r, w[c], rows.n) + given @ w[k:-1] + w[-1]

    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(logits(), -30, 30)))
        e = np.where(use, p - y, 0.0)
        grad = np.concatenate([np.bincount(c, e[r], k), given.T @ e, [e.sum()]]) / n
        grad[:-1] += l2 * w[:-1] / n
        m1, g2 = 0.9 * m1 + 0.1 * grad, 0.99 * g2 + 0.01 * grad**2
        w -= 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(g2 / (1 - 0.99**t)) + 1e-8)
    model = Linear(float(w[-1]), {int(f): float(x) for f, x in zip(rows.names[chosen], w[:k], strict=True)}, [float(x) for x in w[k:-1]])
    return (lambda: 1 / (1 + np.exp(-np.clip(logits(), -30, 30)))), model


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which on a row is flagged: the largest F1 over out-of-fold predictions."""
    if not y.any() or y.all():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(p) + 1) + y.sum())
    k = int(np.argmax(f1))
    following = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float((p[order[k]] + following) / 2)


def out_of_fold(rows: Rows, fold: np.ndarray, y: np.ndarray, given: np.ndarray, max_features: int) -> np.ndarray:
    """Of each row the probability that a model gives which was chosen and fitted on the other folds."""
    out = np.zeros(rows.n)
    for f in range(FOLDS):
        predict, _ = fit(rows, y, given, fold != f, max_features)
        out[fold == f] = predict()[fold == f]
    return out


def fit_chain(rows: Rows, fold: np.ndarray, labels: dict[str, np.ndarray], max_features: int) -> Chain:
    given = np.zeros((rows.n, 0))
    models, thresholds = [], []
    for y in labels.values():
        held_out = out_of_fold(rows, fold, y, given, max_features)
        models.append(fit(rows, y, given, np.ones(rows.n, bool), max_features)[1])
        thresholds.append(best_threshold(held_out, y))
        given = np.column_stack([given, held_out])
    return Chain(list(labels), models, thresholds)


def sampled(docs: DataFrame, labels: DataFrame, categories: dict[str, str], max_train: int, id_col: str, text_col: str) -> DataFrame:
    """(id, y, fold, f) of the training rows: labels and packed features. categories: name -> SQL over the labels, 1 where it holds."""
    marks = labels.select(F.col(id_col).alias("id"), *[F.expr(e).cast("int").alias(f"y{k}") for k, e in enumerate(categories.values())])
    marks = marks.dropna().groupBy("id").agg(*[F.max(f"y{k}").alias(f"y{k}") for k in range(len(categories))])
    # bounded: max_train rows
    sample = marks.orderBy(F.xxhash64("id"), "id").limit(max_train)
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    joined = texts.join(F.broadcast(sample), "id")

    def rows(batch: dict) -> Iterator[tuple]:
        get = cached(word_features)
        for i, text, *y in zip(*batch.values(), strict=True):
            yield str(i), [int(v > 0) for v in y], fold_of(str(i)), np.array(features(text, get), "<i4").tobytes()

    return cut(map_rows(joined.select("id", "text", *[f"y{k}" for k in range(len(categories))]), "id string, y array<int>, fold int, f binary", rows, 512))


def fold_of(i: str) -> int:
    return zlib.crc32(i.encode()) % FOLDS


def telling(sample: DataFrame, n_categories: int, most: int) -> np.ndarray:
    """What Rows.select takes for each category from all rows, and from those of all folds but one.

    Counted over the cluster, by feature and fold: a fold's labels have no part in what the others choose. At most
    `most` features for each category and choice of folds.
    """
    uses = [tuple(range(FOLDS)), *(tuple(f for f in range(FOLDS) if f != out) for out in range(FOLDS))]
    names = [[f"n_{f}", *[f"y{k}_{f}" for k in range(n_categories)]] for f in range(FOLDS)]
    flat = [x for own in names for x in own]

    def rows(batch: dict) -> Iterator[tuple]:
        found = [np.frombuffer(f, "<i4") for f in batch["f"]]
        ids, at = np.unique(np.concatenate(found), return_inverse=True)
        row = np.repeat(np.arange(len(found)), [len(f) for f in found])
        y, fold = np.array(batch["y"], np.int64), np.array(batch["fold"], np.int64)
        counts = []
        for f in range(FOLDS):
            on = fold[row] == f
            counts.append(np.bincount(at[on], minlength=len(ids)))
            counts += [np.bincount(at[on], y[row[on], k], len(ids)).astype(np.int64) for k in range(n_categories)]
        yield from zip(ids.tolist(), *[c.tolist() for c in counts], strict=True)

    parts = map_rows(sample.where("length(f) > 0"), f"f int, {', '.join(f'{x} long' for x in flat)}", rows, 65536)
    summed = parts.groupBy("f").agg(*[F.sum(x).alias(x) for x in flat])
    counts = cut(summed.where(" + ".join(own[0] for own in names) + " >= 3"))
    sums = {r.fold: r for r in sample.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("y")[k]).alias(f"y{k}") for k in range(n_categories)]).collect()}
    best = []
    for use in uses:
        total = sum(sums[f].n for f in use if f in sums)
        n = sum((F.col(f"n_{f}") for f in use), F.lit(0))
        for k in range(n_categories):
            p = max(1, sum(sums[f][f"y{k}"] for f in use if f in sums))
            positive, rate = sum((F.col(f"y{k}_{f}") for f in use), F.lit(0)), (n + 0.5) / (max(1, total) + 1)
            z = F.abs(positive - p * rate) / F.sqrt(p * rate * (1 - rate) + 1e-9)
            best.append(counts.where(n >= 3).select("f", z.alias("z")).where("z > 1.99").orderBy(F.desc("z"), "f").limit(most).select("f"))
    chosen = best[0]
    for b in best[1:]:
        chosen = chosen.unionByName(b)
    return np.unique(chosen.toArrow().column("f").to_numpy())


def training_rows(docs: DataFrame, labels: DataFrame, categories: dict[str, str], max_train: int, max_features: int, id_col: str, text_col: str) -> tuple[Rows, np.ndarray, dict[str, np.ndarray]]:
    """The sample's rows, reduced to telling features where they lie, their folds and labels."""
    sample = sampled(docs, labels, categories, max_train, id_col, text_col)
    chosen = telling(sample, len(categories), max_features)

    def rows(batch: dict) -> Iterator[tuple]:
        for i, y, f in zip(batch["id"], batch["y"], batch["f"], strict=True):
            got = np.frombuffer(f, "<i4")
            at = np.minimum(np.searchsorted(chosen, got), len(chosen) - 1)
            yield i, y, (got[chosen[at] == got] if len(chosen) else got[:0]).tobytes()

    got = map_rows(sample, "id string, y array<int>, f binary", rows, 512).toArrow().to_pydict()
    order = sorted(range(len(got["id"])), key=lambda k: (got["id"][k], got["f"][k]))
    fold = np.array([fold_of(got["id"][k]) for k in order], np.int64)
    y = {name: np.array([got["y"][k][c] > 0 for k in order], bool) for c, name in enumerate(categories)}
    return Rows([np.frombuffer(got["f"][k], "<i4") for k in order]), fold, y


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], max_train: int = 16_000, max_features: int = 4_000, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    rows, fold, y = training_rows(docs, labels, categories, max_train, max_features, id_col, text_col)
    return fit_chain(rows, fold, y, max_features)


def classify(docs: DataFrame, model: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, a probability p_<category> for every category, and <category> as a flag."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = model.categories

    def rows(batch: dict) -> Iterator[tuple]:
        chain_ = shared.value
        used = set().union(*[{f & (1 << BITS) - 1 for f in m.weights} for m in chain_.models])
        select = cached(lambda word: tuple(f for f in word_features(word) if f in used))
        for i, text in zip(batch["id"], batch["text"], strict=True):
            found, given = features(text, select), []
            for m in chain_.models:
                given.append(m.probability(sum(m.weights.get(f, 0.0) for f in found), given))
            yield i, *given, *[p >= t for p, t in zip(given, chain_.thresholds, strict=True)]

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"id {id_type}", *[f"p_{n} double" for n in names], *[f"{n} boolean" for n in names]])
    return map_rows(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")), schema, rows).withColumnRenamed("id", id_col)
