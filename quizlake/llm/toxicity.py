"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another; the model of a category sees the words of a text,
the beginnings of its words (stems whose endings change), how often either occurs, and the
probabilities of the categories before it. What a later model is trained on are
out-of-fold probabilities (each fold is predicted by a model that has not seen it), so it
learns how far the earlier predictions can be trusted; when texts are scored, the earlier
models are those fitted on the whole sample. The cut of a category is set on its out-of-fold
probabilities, and probabilities are moved so that it lies at 0.5.

The sample has a fixed bound, so a category is fitted in one job: one group of sparse rows for
the whole sample and one per fold, each fitted in its own task until it converges.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlake.llm.common import WordRows, discard, stored
from quizlake.llm.common import text_blocks as blocks_of

SAMPLE, FOLDS = 20_000, 3
#: A word, or a beginning of one, is a feature if at least so many sampled texts hold it and its
#: labels are so many standard deviations from what chance gives; the most telling ones count.
LEAST_TEXTS, TELLING, VOCABULARY = 3, 4.0, 20_000
#: Lengths of beginnings, and the numbers of occurrences from which a feature of its own is set.
PREFIXES, TIMES = (4, 6), (1, 2, 4)
#: Labels are noisy: an L1 penalty drops the words that go with a label by chance.
PENALTY, CLOSE = 0.01, 1e-3
#: Bounds that a fit does not come near: rounds of new features (at most MORE each), Newton steps, sweeps.
ROUNDS, MORE, STEPS, SWEEPS = 50, 200, 30, 200
BLOCK = 1 << 20
WORDS = r"[^\p{L}\p{M}\p{N}]+"


def text_blocks(column: pa.Array) -> Iterator[pa.Array]:
    return blocks_of(column, BLOCK)


def _tokens(word: str) -> list[str]:
    """A word and its beginnings, marked by a sign no word holds."""
    return [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) > n)] if word else []


def _levels(block: pa.Array, number: Callable[[str], int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, token number and level for every token that `number` knows in a block of texts:
    level i if the token occurs at least TIMES[i] times in the text. In order of texts."""
    rows = WordRows(pc.split_pattern_regex(pc.utf8_lower(block), WORDS))
    known = [[n for n in map(number, _tokens(w)) if n is not None] for w in rows.words]
    sizes = np.fromiter(map(len, known), np.int64, len(known))
    flat = np.array([n for ns in known for n in ns], np.int64)
    text = np.repeat(np.arange(len(block)), rows.lengths)
    hit = sizes[rows.at] > 0
    at, text = rows.at[hit], text[hit]
    size = sizes[at]
    ends = np.cumsum(size)
    take = np.repeat((np.cumsum(sizes) - sizes)[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
    pairs, times = np.unique((np.repeat(text, size) << 32) | flat[take] if len(flat) else np.zeros(0, np.int64), return_counts=True)
    where, level = np.nonzero(times[:, None] >= np.array(TIMES))
    return pairs[where] >> 32, pairs[where] & 0xFFFFFFFF, level


def _telling(taught: DataFrame, categories: list[str]) -> list[str]:
    """The vocabulary: tokens whose texts have other labels than chance would give."""
    marks = [f"_y_{c}" for c in categories]
    n, *ones = taught.agg(F.count(F.lit(1)), *[F.sum(m) for m in marks]).first()
    shares = {c: y / n for c, y in zip(categories, ones, strict=True) if 0 < y < n}
    if not shares:
        return []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys = [batch.column(i + 1).to_numpy() for i in range(len(marks))]
            at = 0
            for block in text_blocks(batch.column(0)):
                numbers: defaultdict[str, int] = defaultdict(lambda: len(numbers))  # noqa: B023
                text, token, level = _levels(block, numbers.__getitem__)
                feature = token * len(TIMES) + level
                found, texts = np.unique(feature, return_counts=True)
                names = pa.array(list(numbers), pa.string()).take(pa.array(found // len(TIMES)))
                sums = [np.bincount(feature, y[at : at + len(block)][text], len(numbers) * len(TIMES))[found] for y in ys]
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(found % len(TIMES)), pa.array(texts), *map(pa.array, sums)], names=["token", "level", "texts", *marks])
                at += len(block)

    schema = ", ".join(["token string, level bigint, texts bigint", *(f"`{m}` double" for m in marks)])
    parts = taught.select("_text", *marks).mapInArrow(count, schema)
    found = parts.groupBy("token", "level").agg(*[F.sum(c).alias(c) for c in ("texts", *marks)])
    found = found.filter(F.col("texts") >= LEAST_TEXTS)
    far = [F.abs(F.col(f"_y_{c}") - F.col("texts") * p) / F.sqrt(F.col("texts") * p * (1 - p)) for c, p in shares.items()]
    found = found.groupBy("token").agg(F.max(F.greatest(*far, F.lit(0.0))).alias("far")).filter(F.col("far") >= TELLING)
    return [r.token for r in found.orderBy(F.desc("far"), "token").limit(VOCABULARY).collect()]


class Rows:
    """Sparse rows of 0/1 features, and dense columns beside them."""

    def __init__(self, row: np.ndarray, feature: np.ndarray, n: int, features: int, dense: np.ndarray):
        self.row, self.feature, self.n, self.features, self.dense = row, feature, n, features, dense

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.feature], self.n) + self.dense @ w[self.features :]

    def gathered(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.feature, r[self.row], self.features), r @ self.dense])

    def columns(self, which: np.ndarray) -> np.ndarray:
        """Some features as dense columns, and a column of ones."""
        place = np.full(self.features + self.dense.shape[1], -1)
        place[which] = np.arange(len(which))
        out = np.zeros((self.n, len(which) + 1))
        out[:, -1] = 1
        at = place[self.feature]
        out[self.row[at >= 0], at[at >= 0]] = 1
        beside = which[which >= self.features]
        out[:, place[beside]] = self.dense[:, beside - self.features]
        return out


def linear(rows: Rows, y: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Weights and, last, the intercept of a logistic regression on the rows in `use`, both
    classes of equal weight, with an L1 penalty on standardised features. Only features that
    are set or whose slope exceeds the penalty take part in the steps; when these stand still,
    all slopes are taken again, until no other feature exceeds it. Without both classes there
    is only an intercept."""
    ones, n = float((y * use).sum()), float(use.sum())
    width = rows.features + rows.dense.shape[1]
    out = np.zeros(width + 1)
    if not 0 < ones < n:
        out[-1] = 30.0 if ones else -30.0
        return out
    share = np.where(y > 0, 0.5 / ones, 0.5 / (n - ones)) * use
    mean = rows.gathered(use / n)
    square = np.concatenate([mean[: rows.features], (use / n) @ rows.dense**2])
    spread = np.sqrt(np.maximum(square - mean**2, 0))
    scale = np.divide(1.0, spread, out=np.zeros(width), where=spread > 1e-9)
    w, b, margin = np.zeros(width), 0.0, np.zeros(rows.n)
    for _ in range(ROUNDS):
        r = share * (_chance(margin) - y)
        slope = (rows.gathered(r) - mean * r.sum()) * scale
        over = np.where(w == 0, np.abs(slope) - PENALTY * (1 + CLOSE), 0)
        new = np.flatnonzero(over > 0)
        if _ and not len(new):
            break
        new = new[np.argsort(-over[new], kind="stable")[:MORE]]
        active = np.union1d(np.flatnonzero(w), new)
        z = rows.columns(active)
        z[:, :-1] -= mean[active]
        z[:, :-1] *= scale[active]
        v = _settled(z, y, share, np.append(w[active], b))
        w[active], b, margin = v[:-1], float(v[-1]), z @ v
    v = w * scale
    return np.append(v, b - mean @ v)


def _settled(z: np.ndarray, y: np.ndarray, share: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Newton steps under the penalty on dense columns; the last one, the intercept, is free."""
    penalty = np.append(np.full(z.shape[1] - 1, PENALTY), 0.0)

    def cost(v: np.ndarray, margin: np.ndarray) -> float:
        return float(share @ (np.logaddexp(0, margin) - y * margin) + penalty @ np.abs(v))

    margin = z @ v
    now = cost(v, margin)
    for _ in range(STEPS):
        p = _chance(margin)
        slope, weight = z.T @ (share * (p - y)), share * p * (1 - p)
        bend = np.zeros((len(v), len(v)))
        for at in range(0, len(z), 1024):  # some rows at a time: no second copy of them all
            part = z[at : at + 1024]
            bend += (part * weight[at : at + 1024, None]).T @ part
        bend[np.diag_indices(len(v))] += 1e-9
        to = _descended(bend, slope - bend @ v, penalty, v)
        step, move = 1.0, z @ (to - v)
        while step > 1e-6 and (after := cost(v + step * (to - v), margin + step * move)) > now:
            step /= 2
        if step <= 1e-6:
            break
        v, margin, gain, now = v + step * (to - v), margin + step * move, now - after, after
        if gain <= CLOSE * CLOSE * now:
            break
    return v


def _descended(bend: np.ndarray, slope: np.ndarray, penalty: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The lowest point of a quadratic function plus penalties, one coordinate at a time."""
    v, pull = v.copy(), bend @ v + slope
    diagonal, rest = bend.diagonal().tolist(), penalty.tolist()
    for _ in range(SWEEPS):
        most = 0.0
        for j in range(len(v)):
            old = float(v[j])
            at = diagonal[j] * old - float(pull[j])
            new = (max(abs(at) - rest[j], 0.0) / diagonal[j]) * (1 if at > 0 else -1)
            if new != old:
                v[j] = new
                pull += bend[j] * (new - old)
                most = max(most, abs(new - old) * diagonal[j] ** 0.5)
        if most <= CLOSE * PENALTY:
            break
    return v


def _fitted(features: DataFrame, name: str, size: int, before: list[np.ndarray], keys: np.ndarray, folds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of the model on all rows, out-of-fold log-odds by row (in order of `keys`), labels.
    `before` holds the probabilities of the earlier categories, row by row."""

    def fit_group(group: pa.Table) -> pa.Table:
        group = group.sort_by("r")
        r, y, fold = (group.column(c).to_numpy() for c in ("r", "y", "fold"))
        (model,) = set(group.column("model").to_pylist())
        lists = group.column("f").combine_chunks()
        place = np.searchsorted(keys, r)
        dense = np.array([p[place] for p in before], np.float64).reshape(len(before), len(r)).T
        sparse = Rows(np.repeat(np.arange(len(r)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy(), len(r), size, dense)
        weights = linear(sparse, y, (fold != model).astype(np.float64))
        out = np.flatnonzero(fold == model)
        odds = (sparse.times(weights[:-1]) + weights[-1])[out]
        full = [weights.tolist()] if model < 0 else []
        return pa.table({
            "r": pa.array([*r[out].tolist(), *[None] * len(full)], pa.int64()),
            "y": pa.array([*y[out].tolist(), *[None] * len(full)], pa.float64()),
            "odds": pa.array([*odds.tolist(), *[None] * len(full)], pa.float64()),
            "weights": pa.array([*[None] * len(out), *full], pa.list_(pa.float64())),
        })

    models = F.explode(F.array(*[F.lit(m) for m in range(-1, folds)])).alias("model")
    groups = features.select("r", F.col(f"_y_{name}").alias("y"), "fold", "f", models).repartition(4 * (folds + 1), "model")
    found = groups.groupBy("model").applyInArrow(fit_group, "r bigint, y double, odds double, weights array<double>").toArrow()
    weights = next(w for w in found.column("weights").to_pylist() if w is not None)
    held = found.filter(pc.is_valid(found.column("r"))).sort_by("r")
    return np.array(weights), held.column("odds").to_numpy(), held.column("y").to_numpy()


def _best_cut(odds: np.ndarray, y: np.ndarray) -> float:
    """Log-odds in the middle between the two held-out texts where the F1 measure is best."""
    order = np.argsort(-odds, kind="stable")
    odds, true, ones = odds[order], np.cumsum(y[order]), y.sum()
    last = np.append(odds[1:] != odds[:-1], True)  # equal texts fall on one side
    best = int(np.where(last, 2 * true / (np.arange(len(odds)) + 1 + ones), -1.0).argmax())
    if ones in (0, len(odds)) or best + 1 == len(odds):
        return 0.0
    return float((odds[best] + odds[best + 1]) / 2)


def _chance(odds: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * odds))


class Chain:
    """Fitted models of `categories`, in chain order: weights of the features (token by token,
    level by level), then of the earlier probabilities, then the intercept; and the cut."""

    def __init__(self, categories: list[str], words: list[str], models: list[tuple[np.ndarray, float]]):
        self.categories, self.words, self.models = categories, words, models

    def chances(self, block: pa.Array) -> list[np.ndarray]:
        """Probabilities of each category for a block of texts."""
        numbers, size = {w: i for i, w in enumerate(self.words)}, len(self.words) * len(TIMES)
        text, token, level = _levels(block, numbers.get)
        found: list[np.ndarray] = []
        for weights, cut in self.models:
            dense = np.array(found).reshape(len(found), len(block)).T
            rows = Rows(text, token * len(TIMES) + level, len(block), size, dense)
            found.append(_chance(rows.times(weights[:-1]) + weights[-1] - cut))
        return found

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """`docs` with `_p_<category>` for every category; null text counts as empty.
        Without a labelled sample all probabilities are 0. Rows that repeat are scored alike,
        and very long texts whole."""
        if not self.models:
            return reduce(lambda d, c: d.withColumn(f"_p_{c}", F.lit(0.0)), self.categories, docs)
        names = [f"_p_{c}" for c in self.categories]

        @F.arrow_udf("struct<" + ", ".join(f"`{n}`: double" for n in names) + ">")
        def chances(column: pa.Array) -> pa.Array:
            parts = [self.chances(block) for block in text_blocks(column)]
            columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(len(names))]
            return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=names)

        scored = docs.withColumn("_chances", chances(F.col(text)))
        return scored.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"_chances.`{n}`") for n in names])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    categories: list[str],
    key: str = "doc_id",
    text: str = "text",
    sample: int = SAMPLE,
    folds: int = FOLDS,
) -> Chain:
    """Fit the chain on at most about `sample` labelled documents, picked by a hash of the key.

    `labels` holds the key and one 0/1 column per category; rows with a null in any of them,
    or without a document, teach nothing. Of several labels of one key the largest counts;
    rows that repeat a key all teach. The vocabulary is the tokens that tell a label
    (`_telling`), `VOCABULARY` at most."""
    full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [key, *categories]])
    one = [F.max(F.col(c).cast("double")).alias(f"_y_{c}") for c in categories]
    marks = labels.filter(full).groupBy(F.col(key).alias("_key")).agg(*one)
    rows = marks.count()
    if rows > sample:
        spots = 1_000_000
        marks = marks.filter(F.pmod(F.xxhash64("_key", F.lit(7)), F.lit(spots)) < int(spots * sample / rows))
    taught = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    # The sample's keys have a fixed bound, so they may be broadcast.
    taught = taught.join(F.broadcast(marks), "_key").withColumn("fold", F.pmod(F.xxhash64("_key"), F.lit(folds)))
    # Only the sample is dealt anew; the scan of all texts keeps its tasks.
    taught = stored(taught.repartition(8, "_text").withColumn("r", F.monotonically_increasing_id()), "toxicity-sample")
    if taught.isEmpty():
        return Chain(categories, [], [])
    words = _telling(taught, categories)
    numbers = {w: i for i, w in enumerate(words)}

    @F.arrow_udf("array<int>")
    def feature_lists(column: pa.Array) -> pa.Array:
        lists: list[np.ndarray] = []
        for block in text_blocks(column):
            at, token, level = _levels(block, numbers.get)
            cuts = np.searchsorted(at, np.arange(1, len(block)))
            lists += np.split((token * len(TIMES) + level).astype(np.int32), cuts)
        return pa.array(lists, pa.list_(pa.int32()))

    features = taught.select("r", "fold", *[f"_y_{c}" for c in categories], feature_lists(F.col("_text")).alias("f"))
    features = stored(features, "toxicity-features")
    keys = np.sort(features.select("r").toArrow().column(0).to_numpy())
    models, before = [], []
    for name in categories:
        weights, odds, y = _fitted(features, name, len(words) * len(TIMES), before, keys, folds)
        cut = _best_cut(odds, y)
        models.append((weights, cut))
        before.append(_chance(odds - cut))
    for done in (taught, features):
        discard(done)
    return Chain(categories, words, models)
