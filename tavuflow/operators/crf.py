"""Sequence taggers in NumPy, fitted for each group and fold on a bounded sample and applied to all rows: a linear-chain
conditional random field, and log-linear models trained by stochastic gradient descent that stops early.

Features come from sequences.feature_rows: the lower-cased word, the buckets of its vector's first numbers, its place in the
sentence and its similarities to neighbours; names are hashed to columns in the JVM. The field maximises the likelihood less
c2 / 2 of the squares and c1 of the sizes of the weights, by limited-memory BFGS in the orthant-wise form; all transitions have
a weight.
"""

from __future__ import annotations

import pickle
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tavuflow.session import bounded, materialize

DIMENSIONS = 1 << 18
#: Sentences of each group that a fit sees at most, by a hash of their ids: bounds a task's memory.
SAMPLE_SENTENCES = 2000
#: Columns in more than this share of the tokens are held as a dense matrix.
DENSE_SHARE = 0.05
#: Bytes of models that are broadcast at once; more are applied one part after another.
MODEL_BYTES = 256 << 20


@dataclass
class Tokens:
    """Tokens of whole sentences: sentences' lengths, the tokens' offsets in columns and values, and the true labels."""

    lengths: np.ndarray
    offsets: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    tags: np.ndarray | None = None

    @staticmethod
    def of(sentences: list[list[dict[int, float]]], tags: list[list[str]] | None = None) -> Tokens:
        flat = [t for s in sentences for t in s]
        return Tokens(
            np.array([len(s) for s in sentences], np.int64),
            np.append(0, np.cumsum([len(t) for t in flat])).astype(np.int64),
            np.array([k for t in flat for k in t], np.int64),
            np.array([v for t in flat for v in t.values()], float),
            None if tags is None else np.array([x for s in tags for x in s], object),
        )

    @staticmethod
    def of_arrow(items: pa.Array) -> Tokens:
        """From a list of structs with tag, columns and values."""
        rows = items.flatten()
        columns, values = rows.field("columns"), rows.field("values")
        sizes = columns.value_lengths().to_numpy(zero_copy_only=False)
        whole = lambda x, t: x.flatten().to_numpy(zero_copy_only=False).astype(t)
        return Tokens(
            items.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64),
            np.append(0, np.cumsum(sizes, dtype=np.int64)),
            whole(columns, np.int64),
            whole(values, float),
            rows.field("tag").to_numpy(zero_copy_only=False),
        )


@dataclass
class Model:
    labels: list[str]
    columns: np.ndarray  # columns in use, sorted
    weights: np.ndarray  # columns x labels
    transitions: np.ndarray  # labels x labels
    losses: list[float] = field(default_factory=list)

    def scores(self, tokens: Tokens) -> np.ndarray:
        """tokens x labels; columns that the fit did not see count nothing."""
        at = np.minimum(np.searchsorted(self.columns, tokens.columns), max(len(self.columns) - 1, 0))
        known = self.columns[at] == tokens.columns if len(self.columns) else np.zeros(len(at), bool)
        out = np.zeros((len(tokens.offsets) - 1, len(self.labels)))
        row = np.repeat(np.arange(len(out)), np.diff(tokens.offsets))[known]
        at, values = at[known], tokens.values[known]
        for c in range(len(self.labels)):
            out[:, c] = np.bincount(row, self.weights[at, c] * values, minlength=len(out))
        return out

    def predict(self, tokens: Tokens) -> np.ndarray:
        """Numbers of the labels on the best path of each sentence, all sentences in step."""
        unary, lengths = self.scores(tokens), tokens.lengths
        begin = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        out = np.zeros(len(unary), np.int64)
        longest = int(lengths.max(initial=0))
        if not longest:
            return out
        live = [order[: int((lengths > t).sum())] for t in range(longest)]
        best, back = unary[begin[live[0]]], []
        final = np.zeros(len(lengths), np.int64)
        for t in range(1, longest):
            n = len(live[t])
            ended = live[t - 1][n:]
            final[ended] = best[n:].argmax(1)
            paths = best[:n, :, None] + self.transitions[None]
            back.append(paths.argmax(1))
            best = paths.max(1) + unary[begin[live[t]] + t]
        final[live[-1]] = best.argmax(1)
        now = final.copy()
        for t in range(longest - 1, -1, -1):
            own = live[t]
            out[begin[own] + t] = now[own]
            if t:
                now[own] = back[t - 1][np.arange(len(own)), now[own]]
        return out


def likelihood(unary: np.ndarray, transitions: np.ndarray, mask: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood of padded sentences (unary: sentences x length x labels, the longest sentence first), and its
    gradients by unary scores and transitions. Chances are scaled at each place, so that products of matrices suffice."""
    n, length, k = unary.shape
    live = mask.sum(0)
    top = unary.max(2)
    local = np.exp(unary - top[:, :, None])
    shift = transitions.max()
    step = np.exp(transitions - shift)
    alpha, beta, scale = np.zeros_like(unary), np.ones_like(unary), np.ones((n, length))
    for t in range(length):
        m = live[t]
        a = local[:m, t] if t == 0 else (alpha[:m, t - 1] @ step) * local[:m, t]
        scale[:m, t] = a.sum(1)
        alpha[:m, t] = a / scale[:m, t, None]
    by_transitions = np.zeros((k, k))
    for t in range(length - 1, 0, -1):
        m = live[t]
        ahead = local[:m, t] * beta[:m, t] / scale[:m, t, None]
        beta[:m, t - 1] = ahead @ step.T
        by_transitions += step * (alpha[:m, t - 1].T @ ahead)
    node = np.where(mask[:, :, None], alpha * beta, 0.0)
    rows, cols = np.nonzero(mask)
    total = np.log(scale[rows, cols]).sum() + top[rows, cols].sum() + shift * (mask.sum() - n)
    score = unary[rows, cols, gold[rows, cols]].sum()
    node[rows, cols, gold[rows, cols]] -= 1
    first, second = gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]
    score += transitions[first, second].sum()
    np.subtract.at(by_transitions, (first, second), 1)
    return float(total - score), node, by_transitions


def minimize(value_and_gradient, x: np.ndarray, c1: float, rounds: int, memory: int = 6, tolerance: float = 1e-5) -> tuple[np.ndarray, list[float]]:
    """Orthant-wise limited-memory BFGS of value + c1 * sum of sizes; also the value after each round."""
    value, gradient = value_and_gradient(x)
    value += c1 * abs(x).sum()
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    history = [value]

    def pseudo(x: np.ndarray, g: np.ndarray) -> np.ndarray:
        out = np.where(x > 0, g + c1, np.where(x < 0, g - c1, 0.0))
        zero = x == 0
        out[zero] = np.where(g[zero] + c1 < 0, g[zero] + c1, np.where(g[zero] - c1 > 0, g[zero] - c1, 0.0))
        return out

    for _ in range(rounds):
        slope = pseudo(x, gradient)
        if np.linalg.norm(slope) < tolerance * max(1.0, np.linalg.norm(x)):
            break
        q, kept = slope.copy(), []
        for s, y in reversed(steps):
            a = (s @ q) / (y @ s)
            q -= a * y
            kept.append(a)
        if steps:
            s, y = steps[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(kept), strict=True):
            q += s * (a - (y @ q) / (y @ s))
        direction = -q
        direction[direction * -slope <= 0] = 0  # stay with the steepest descent's signs
        orthant = np.where(x != 0, np.sign(x), -np.sign(slope))
        rate = 1.0 if steps else 1.0 / max(1.0, np.linalg.norm(slope))
        for _ in range(25):
            new = x + rate * direction
            if c1:
                new[np.sign(new) != orthant] = 0
            new_value, new_gradient = value_and_gradient(new)
            new_value += c1 * abs(new).sum()
            if new_value <= value + 1e-4 * (slope @ (new - x)):
                break
            rate /= 2
        else:
            break
        s, y = new - x, new_gradient - gradient
        if s @ y > 1e-10:
            steps = [*steps[-memory + 1 :], (s, y)]
        done = abs(value - new_value) < tolerance * max(1.0, abs(value))
        x, value, gradient = new, new_value, new_gradient
        history.append(value)
        if done:
            break
    return x, history


class Design:
    """Tokens x columns as a product: frequent columns as a dense matrix, the others by sorted places."""

    def __init__(self, tokens: Tokens) -> None:
        self.columns, what = np.unique(tokens.columns, return_inverse=True)
        self.n, row = len(tokens.offsets) - 1, np.repeat(np.arange(len(tokens.offsets) - 1), np.diff(tokens.offsets))
        often = np.bincount(what, minlength=len(self.columns)) > DENSE_SHARE * self.n
        self.often = np.flatnonzero(often)
        at = often[what]
        self.dense = np.zeros((self.n, len(self.often)))
        self.dense[row[at], (np.cumsum(often) - 1)[what[at]]] = tokens.values[at]
        self.row, self.what, self.value = row[~at], what[~at], tokens.values[~at, None]
        order = np.argsort(self.what, kind="stable")
        self.by_column = order, self.row[order]
        self.row_starts, self.rows = self._starts(self.row)
        self.column_starts, self.whats = self._starts(self.what[order])

    @staticmethod
    def _starts(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])[: len(sorted_)])
        return starts, sorted_[starts]

    def times(self, weights: np.ndarray) -> np.ndarray:
        out = self.dense @ weights[self.often]
        if len(self.row):
            out[self.rows] += np.add.reduceat(weights[self.what] * self.value, self.row_starts, axis=0)
        return out

    def transposed_times(self, by_token: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.columns), by_token.shape[1]))
        out[self.often] = self.dense.T @ by_token
        if len(self.row):
            order, rows = self.by_column
            out[self.whats] += np.add.reduceat(by_token[rows] * self.value[order], self.column_starts, axis=0)
        return out


def fit(tokens: Tokens, c1: float = 0.05, c2: float = 0.05, rounds: int = 200) -> Model:
    """A field of tagged sentences; losses are the objective after each round."""
    labels = sorted(set(tokens.tags))
    code = {x: i for i, x in enumerate(labels)}
    lengths = tokens.lengths
    order = np.argsort(-lengths, kind="stable")
    n, length, k = len(lengths), int(lengths.max(initial=0)), len(labels)
    design = Design(tokens)
    size = len(design.columns) * k
    if not length:
        return Model(labels, design.columns, np.zeros((0, k)), np.zeros((k, k)))
    begin = (np.cumsum(lengths) - lengths)[order]
    mask = np.arange(length)[None, :] < lengths[order][:, None]
    flat = (begin[:, None] + np.arange(length)[None, :])[mask]  # tokens in the order of the padded form
    gold = np.zeros((n, length), np.int64)
    gold[mask] = np.array([code[x] for x in tokens.tags])[flat]

    def target(x: np.ndarray) -> tuple[float, np.ndarray]:
        weights, transitions = x[:size].reshape(-1, k), x[size:].reshape(k, k)
        unary = np.zeros((n, length, k))
        unary[mask] = design.times(weights)[flat]
        loss, by_unary, by_transitions = likelihood(unary, transitions, mask, gold)
        by_token = np.empty((design.n, k))
        by_token[flat] = by_unary[mask]
        gradient = np.concatenate([design.transposed_times(by_token).ravel(), by_transitions.ravel()])
        return loss + c2 / 2 * float(x @ x), gradient + c2 * x

    x, history = minimize(target, np.zeros(size + k * k), c1, rounds)
    return Model(labels, design.columns, x[:size].reshape(-1, k), x[size:].reshape(k, k), history)


def fit_sgd(tokens: Tokens, l2: float = 1e-4, epochs: int = 500, patience: int = 8, delta: float = 1e-4, batch: int = 256, rate: float = 0.5, seed: int = 42) -> Model:
    """A log-linear model of single tokens by stochastic gradient descent on the log loss with squared weights.

    Each epoch goes once over the shuffled tokens in batches, with a falling rate; the loss is the mean negative log of the true
    label's chance. Training stops when the best loss has not improved by more than delta for patience epochs; the best weights
    are kept. losses has the loss of each epoch.
    """
    labels = sorted(set(tokens.tags))
    k = len(labels)
    design = Design(tokens)
    weights = np.zeros((len(design.columns), k))
    if not design.n:
        return Model(labels, design.columns, weights, np.zeros((k, k)))
    gold = np.searchsorted(labels, list(tokens.tags))
    rnd = np.random.RandomState(seed)
    ends = np.searchsorted(design.row, np.arange(design.n + 1))
    sizes = np.diff(ends)

    def chances(scores: np.ndarray) -> np.ndarray:
        p = np.exp(scores - scores.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    best, bad, kept, losses = np.inf, 0, weights, []
    for epoch in range(epochs):
        step = rate / (1 + 0.02 * epoch)
        shuffled = rnd.permutation(design.n)
        for at in range(0, design.n, batch):
            own = shuffled[at : at + batch]
            width, dense = sizes[own], design.dense[own]
            take = np.repeat(ends[own] - (np.cumsum(width) - width), width) + np.arange(width.sum())
            column, value, row = design.what[take], design.value[take], np.repeat(np.arange(len(own)), width)
            scores = dense @ weights[design.often]
            np.add.at(scores, row, weights[column] * value)
            p = chances(scores)
            p[np.arange(len(own)), gold[own]] -= 1
            p *= step / len(own)
            weights *= 1 - step * l2
            weights[design.often] -= dense.T @ p
            np.subtract.at(weights, column, p[row] * value)
        p = chances(design.times(weights))
        losses.append(float(-np.log(p[np.arange(design.n), gold] + 1e-15).mean()))
        if losses[-1] < best - delta:
            best, bad, kept = losses[-1], 0, weights.copy()
        else:
            bad += 1
            if bad >= patience:
                break
    return Model(labels, design.columns, kept, np.zeros((k, k)), losses)


def top_weights(model: Model, n: int = 10) -> list[tuple[int, str, float]]:
    """The n largest state weights: column, label, weight."""
    order = np.argsort(-model.weights, axis=None, kind="stable")[:n]
    return [(int(model.columns[i // len(model.labels)]), model.labels[i % len(model.labels)], float(model.weights.ravel()[i])) for i in order]


def column_of(name: Column) -> Column:
    return F.pmod(F.crc32(name), F.lit(DIMENSIONS)).cast("int")


def nested(features: DataFrame, by: list[str]) -> DataFrame:
    """One row for each sentence: by, sent_id, fold and items (pos, word, tag, columns, values) in order, written to the shared
    folder. features holds by, sent_id, fold, pos, word, tag and features (name, value)."""
    columns, values = F.transform("features", lambda x: column_of(x["name"])), F.transform("features", lambda x: x["value"].cast("float"))
    item = F.struct("pos", "word", "tag", columns.alias("columns"), values.alias("values"))
    return materialize(features.groupBy(*by, "sent_id", "fold").agg(F.array_sort(F.collect_list(item)).alias("items")), "sentences")


def _join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An inner join where null equals null."""
    named = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    return left.join(named, _all(F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on)).drop(*(f"_on_{c}" for c in on))


def train(sentences: DataFrame, by: list[str], sample: int = SAMPLE_SENTENCES, fitted: Callable[[Tokens], Model] = fit) -> DataFrame:
    """(by, held_out, model, sentences, tokens, losses, seconds): a model for each group and fold, fitted on at most sample
    sentences of the other folds. Only ids are ranked; the chosen sentences then join them. A group and fold is one task."""
    ids = sentences.select(*by, "sent_id", "fold").filter("size(items) > 0")
    folds = [r["fold"] for r in ids.select("fold").distinct().collect()]  # a few numbers
    if not folds:
        folds = [0]
    order = F.row_number().over(Window.partitionBy(*by, "held_out").orderBy(F.xxhash64("sent_id"), "sent_id"))
    others = ids.select("*", F.explode(F.array(*[F.lit(f) for f in folds])).alias("held_out")).filter("fold <> held_out")
    chosen = others.withColumn("_rn", order).filter(F.col("_rn") <= sample).drop("_rn")
    chosen = materialize(chosen, "sample")
    groups = sorted(chosen.select(*by, "held_out").distinct().collect(), key=str)  # a row for each model
    numbers = sentences.sparkSession.createDataFrame([(*g, i) for i, g in enumerate(groups)], chosen.select(*by, "held_out").schema.add("_task", T.IntegerType()))
    numbered = _join(chosen, F.broadcast(numbers), [*by, "held_out"])
    rows = _join(sentences, bounded(numbered), [*by, "sent_id", "fold"]).repartitionById(max(len(groups), 1), F.col("_task"))
    kinds = ", ".join(f"`{c}` {sentences.schema[c].dataType.simpleString()}" for c in by)

    def one(group: pa.Table) -> pa.Table:
        began = time.perf_counter()
        order = np.argsort(group.column("sent_id").to_numpy(), kind="stable")
        tokens = Tokens.of_arrow(group.column("items").combine_chunks().take(pa.array(order)))
        model = fitted(tokens)
        out = {c: [group.column(c)[0].as_py()] for c in [*by, "held_out"]}
        out |= {"model": [pickle.dumps(model)], "sentences": [len(order)], "tokens": [int(tokens.lengths.sum())], "losses": [model.losses], "seconds": [time.perf_counter() - began]}
        names = [*by, "held_out", "model", "sentences", "tokens", "losses", "seconds"]
        kinds_ = [*(group.schema.field(c).type for c in by), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.float64()]
        return pa.table([pa.array(out[c], t) for c, t in zip(names, kinds_, strict=True)], names)

    made = rows.groupBy("_task").applyInArrow(one, f"{kinds}{', ' if kinds else ''}held_out int, model binary, sentences bigint, tokens bigint, losses array<double>, seconds double")
    return materialize(made, "models")


def top_of(models: DataFrame, by: list[str], n: int = 10) -> DataFrame:
    """(by, held_out, place, column, label, weight): the state weights of most weight of each model."""
    names = [*by, "held_out"]
    kinds = ", ".join(f"`{c}` {models.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(row, place, *x) for row, blob in enumerate(batch.column("model")) for place, x in enumerate(top_weights(pickle.loads(blob.as_py()), n))]
            at = pa.array([f[0] for f in found], pa.int32())
            rest = [pa.array([f[i] for f in found], t) for i, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.string()), (4, pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in names), *rest], [*names, "place", "column", "label", "weight"])

    return models.select(*names, "model").mapInArrow(run, f"{kinds}, place int, column int, label string, weight double")


def apply(sentences: DataFrame, models: DataFrame, by: list[str]) -> DataFrame:
    """(by, sent_id, fold, pos, word, tag, pred): each sentence predicted by the model that did not see its fold.

    Models are broadcast as a dictionary, at most MODEL_BYTES of them at a time; rows carry only their keys. A group without a
    model (nothing to fit on) gets null.
    """
    spark = sentences.sparkSession
    sizes = [(tuple(r[c] for c in [*by, "held_out"]), r["size"]) for r in models.select(*by, "held_out", F.length("model").alias("size")).collect()]  # a row for each model
    parts: list[list[tuple]] = [[]]
    held = 0
    for key, size in sorted(sizes, key=str):
        if held + size > MODEL_BYTES and parts[-1]:
            parts.append([])
            held = 0
        parts[-1].append(key)
        held += size
    item = sentences.schema["items"].dataType.simpleString()
    kinds = ", ".join(f"`{c}` {sentences.schema[c].dataType.simpleString()}" for c in by)
    names = [*by, "fold"]
    out = None
    is_one = lambda key: F.expr("true") if not key else _all(F.col(c).eqNullSafe(F.lit(v)) for c, v in key)
    for i, part in enumerate(parts):
        mine = [list(zip([*by, "held_out"], key, strict=True)) for key in part]
        rows = models.filter(_any(is_one(key) for key in mine)).collect() if mine else []
        shared = spark.sparkContext.broadcast({tuple(r[c] for c in [*by, "held_out"]): r["model"] for r in rows})
        own = sentences
        if len(parts) > 1:
            here = _any(is_one([("fold" if c == "held_out" else c, v) for c, v in key]) for key in mine)
            others = _any(is_one([("fold" if c == "held_out" else c, v) for c, v in zip([*by, "held_out"], key, strict=True)]) for p in parts for key in p)
            own = sentences.filter(here | ~others if i == 0 else here)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            loaded: dict[tuple, Model] = {}
            for batch in batches:
                keys = [tuple(c.as_py() for c in row) for row in zip(*(batch.column(n) for n in names), strict=True)]
                items = batch.column("items")
                spots: dict[tuple, list[int]] = {}
                for row, key in enumerate(keys):
                    spots.setdefault(key, []).append(row)
                pieces, order = [], []
                for key, at in spots.items():
                    if key not in loaded and key in shared.value:
                        loaded[key] = pickle.loads(shared.value[key])
                    tokens = Tokens.of_arrow(items.take(pa.array(at)))
                    model = loaded.get(key)
                    if model is None or not model.labels:
                        flat = pa.nulls(int(tokens.lengths.sum()), pa.string())
                    else:
                        flat = pa.array(model.labels, pa.string()).take(pa.array(model.predict(tokens)))
                    pieces.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(tokens.lengths)).astype(np.int32)), flat))
                    order += at
                preds = pa.concat_arrays(pieces).take(pa.array(np.argsort(order))) if pieces else pa.array([], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, preds], [*batch.schema.names, "pred"])

        told = own.select(*by, "sent_id", "fold", "items").mapInArrow(run, f"{kinds}{', ' if kinds else ''}sent_id {sentences.schema['sent_id'].dataType.simpleString()}, fold int, items {item}, pred array<string>")
        out = told if out is None else out.unionByName(told)
    flat = out.select(*by, "sent_id", "fold", F.explode(F.arrays_zip("items", "pred")).alias("x"))
    return flat.select(*by, "sent_id", "fold", F.col("x.items.pos").alias("pos"), F.col("x.items.word").alias("word"), F.col("x.items.tag").alias("tag"), F.col("x.pred").alias("pred"))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out &= c
    return out


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out |= c
    return out


def cross_validate(features: DataFrame, by: list[str], sample: int = SAMPLE_SENTENCES, fitted: Callable[[Tokens], Model] = fit) -> DataFrame:
    """features (by, sent_id, fold, pos, word, tag) with pred: each fold is predicted by a model of the others."""
    sentences = nested(features, by)
    return apply(sentences, train(sentences, by, sample, fitted), by)
