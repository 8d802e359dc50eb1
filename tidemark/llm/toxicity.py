"""Severity of toxic language by cumulative-link ordinal regression on sparse text features.

Features are the hashed words of a text, the hashed beginnings (4 and 5 bytes)
of its words, and which words occur at least 2 and at least 4 times.  With one
weight vector w and ordered thresholds t1 < t2 < ..., P(grade <= k) =
sigmoid(t_k - w.x); the expected severity is the sum of P(grade >= k).

Labels know toxic or not, so grades are made by cross-fitting: the training
texts are dealt into folds, and a binary fit on the other folds scores each
fold's texts.  Toxic texts up to the median of these scores are grade 1, the
others grade 2; no text is graded by a model that saw it.  The ordinal model is
then fitted on grades 0 to 2.  The chance from which a text is rejected is
chosen the same way: ordinal fits on the other folds give every training text a
chance, and the cut is the one with the fewest wrong verdicts when both classes
count as often as the labels have them.  Training takes a bounded number of
labelled rows; every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkit as tk
from tidemark.llm.sampling import CLASS_BYTES, labelled_texts

BITS = 18
#: A word that occurs as often as one of these has a further feature for each.
TIMES = (2, 4)
FOLDS = 3
#: Letters, digits and all bytes of characters beyond ASCII.
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:256] = True


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs as two arrays sorted by row."""
    starts, ends, at = tk.spans(_INSIDE[data], offsets)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(at))
    found = []
    for tag, stop in enumerate((ends, np.minimum(ends, starts + 4), np.minimum(ends, starts + 5))):
        h = tk.mix(tk.span_hashes(data, starts, stop, tk.FOLDED_VALUE) + tk.U64(tag + 1))
        found.append((row << BITS) | (h >> tk.U64(64 - BITS)).astype(np.int64))
    word = np.sort(found[0])
    for tag, times in enumerate(TIMES, 4):
        often = word[times - 1 :][word[times - 1 :] == word[: len(word) - times + 1]]
        h = tk.mix((often & ((1 << BITS) - 1)).astype(np.uint64) + tk.U64(tag << BITS))
        found.append(((often >> BITS) << BITS) | (h >> tk.U64(64 - BITS)).astype(np.int64))
    both = np.sort(np.concatenate(found))
    if len(both):
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    return both >> BITS, both & ((1 << BITS) - 1)


@dataclass(frozen=True)
class OrdinalModel:
    """Weights shared by all thresholds, the thresholds in ascending order, and the chance of a grade from which to reject."""

    weights: np.ndarray
    thresholds: np.ndarray
    reject: float = 0.5

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., a column each."""
        z = np.clip(score[:, None] - self.thresholds[None, :], -60, 60)
        return 1.0 / (1.0 + np.exp(-z))


def _totals(weights: np.ndarray, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, weights=weights[feature], minlength=n)


def _minimise(loss, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with step halving; ``loss`` gives value and gradient."""
    value, grad = loss(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, kept = grad.copy(), []
        for s, y in reversed(moves):
            a = (s @ d) / (s @ y)
            d -= a * y
            kept.append(a)
        if moves:
            s, y = moves[-1]
            d *= (s @ y) / (y @ y)
        else:
            d /= max(np.abs(grad).sum(), 1.0)
        for (s, y), a in zip(moves, reversed(kept), strict=True):
            d += s * (a - (y @ d) / (s @ y))
        size = 1.0
        while True:
            new, new_grad = loss(x - size * d)
            if new <= value - 1e-4 * size * (grad @ d) or size < 1e-6:
                break
            size /= 2
        s, y = -size * d, new_grad - grad
        gain, x, value, grad = value - new, x + s, new, new_grad
        if s @ y > 1e-10:
            moves = [*moves, (s, y)][-memory:]
        if gain < 1e-6 * (1 + abs(value)):
            break
    return x


def fit_ordinal(
    row: np.ndarray,
    feature: np.ndarray,
    grade: np.ndarray,
    *,
    l2: float = 0.3,
    least_rows: int = 5,
    steps: int = 60,
    start: np.ndarray | None = None,
) -> OrdinalModel:
    """Penalised maximum likelihood from (row, feature) pairs sorted by row; deterministic.

    Features of fewer than ``least_rows`` rows get no weight.

    Thresholds are the first one and the logarithms of their gaps, so they stay in order.
    """
    n, top, size = len(grade), int(max(grade.max(initial=0), 1)), 1 << BITS
    used = np.flatnonzero(np.bincount(feature, minlength=size) >= least_rows)
    compact = np.full(size, -1, np.int32)
    compact[used] = np.arange(len(used))
    feature = compact[feature]
    keep = feature >= 0
    row, feature = row[keep], feature[keep]
    each = np.arange(n)
    # The pairs by row, and the rows of each feature: both sums run over neighbours.
    filled, begins = np.unique(row, return_index=True)
    by_feature = feature.astype(np.int64) << 32
    by_feature |= row
    by_feature.sort()
    by_feature = by_feature.astype(np.uint32).view(np.int32)  # the low half is the row
    held = np.concatenate([[0], np.cumsum(np.bincount(feature, minlength=len(used)))[:-1]]) if len(used) else begins[:0]

    def totals(w: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        if len(filled):
            out[filled] = np.add.reduceat(w[feature], begins)
        return out

    def split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w, t = x[: len(used)], x[len(used) :]
        gaps = np.exp(np.clip(t[1:], -10, 10))
        return w, np.concatenate([t[:1], t[0] + np.cumsum(gaps)]), gaps

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, t, gaps = split(x)
        z = np.clip(totals(w)[:, None] - t[None, :], -40, 40)
        p = 1.0 / (1.0 + np.exp(-z))
        # P(grade = k) = P(>= k) - P(>= k + 1), with P(>= 0) = 1 and P(>= top + 1) = 0.
        padded = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], axis=1)
        likely = np.maximum(padded[each, grade] - padded[each, grade + 1], 1e-12)
        slope = padded * (1.0 - padded)
        dz = np.zeros((n, top + 2))
        dz[each, grade] = -slope[each, grade] / likely
        dz[each, grade + 1] += slope[each, grade + 1] / likely
        dz = dz[:, 1:-1]
        gw = (np.add.reduceat(dz.sum(axis=1)[by_feature], held) if len(used) else 0.0) + l2 * w
        gt = -dz.sum(axis=0)
        after = np.cumsum(gt[::-1])[::-1]
        return float(-np.log(likely).sum() + 0.5 * l2 * w @ w), np.concatenate([gw, after[:1], after[1:] * gaps])

    begin = np.zeros(len(used) + top)
    if start is not None:
        begin[: len(used)] = start[used]
    w, t, _ = split(_minimise(loss, begin, steps))
    weights = np.zeros(size, dtype=np.float32)
    weights[used] = w
    return OrdinalModel(weights, t)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in tk.slices(batch.column(1)):
            row, feature = _features(data, offsets)
            at = np.searchsorted(row, np.arange(last - first + 1))
            lists = pa.ListArray.from_arrays(
                pa.array(at.astype(np.int32)), pa.array(feature.astype(np.int32))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, last - first), lists], ["toxic", "features"]
            )


def best_cut(chance: np.ndarray, toxic: np.ndarray, weight: tuple[float, float]) -> float:
    """The chance from which to reject, with the least weight of wrong verdicts; the middle (in log odds) of the widest such gap."""
    odds = np.log(np.clip(chance, 1e-9, 1 - 1e-9) / (1 - np.clip(chance, 1e-9, 1 - 1e-9)))
    order = np.argsort(odds, kind="stable")
    odds, truth = odds[order], toxic[order]
    # Rejecting the rows from place i on: wrong are the toxic ones before it and the clean ones from it on.
    wrong = weight[1] * np.concatenate([[0], np.cumsum(truth)]) + weight[0] * np.concatenate([np.cumsum((1 - truth)[::-1])[::-1], [0]])
    edges = np.concatenate([[odds[0] - 1], odds, [odds[-1] + 1]])
    gap = np.where(wrong <= wrong[np.diff(edges) > 0].min() + 1e-9, np.diff(edges), -1.0)
    i = int(gap.argmax())
    return float(1 / (1 + np.exp(-(edges[i] + edges[i + 1]) / 2)))


def train_severity(
    docs: DataFrame, labels: DataFrame, *, rows_per_class: int = 4000, class_bytes: int = CLASS_BYTES
) -> OrdinalModel | None:
    """The model, or None where the labels do not hold both classes.

    At most ``rows_per_class`` labelled documents of each class are used, the least
    by a hash of doc_id, with at most ``class_bytes`` bytes of text; no other rows are
    read for it.  See :func:`tidemark.llm.sampling.labelled_texts` for labels that
    are null or contradict each other and for repeated doc_ids.
    """
    rows = (
        labelled_texts(docs, labels, "toxic", rows_per_class, class_bytes)
        .select(F.col("label").alias("toxic"), "text")
        .mapInArrow(_extract, "toxic int, features array<int>")
        .toArrow()
    )
    toxic = rows["toxic"].to_numpy().astype(np.int64)
    if not (toxic == 0).any() or not (toxic == 1).any():
        return None
    features = rows["features"].combine_chunks()
    del rows
    offsets = features.offsets.to_numpy()
    count = np.diff(offsets).astype(np.int64)
    total = np.add.reduceat(np.append(features.flatten().to_numpy() % 8191, 0), offsets[:-1])
    # The order of collected rows must not matter to sums of floats.
    order = np.lexsort((np.where(count, total, 0), count, toxic))
    toxic, count = toxic[order], count[order]
    feature = features.take(pa.array(order)).flatten().to_numpy()
    del features
    row = np.repeat(np.arange(len(toxic), dtype=np.int32), count)
    # Neighbours are of a class and alike in length, so folds are as well.
    fold = np.arange(len(toxic)) % FOLDS if (np.bincount(toxic) >= 2 * FOLDS).all() else np.zeros(len(toxic), np.int64)
    several = fold.any()

    def without(k: int, grade: np.ndarray, steps: int, start: np.ndarray | None = None) -> tuple[OrdinalModel, np.ndarray]:
        """A fit on all rows but those of fold k (of the only fold: on all), and the scores of that fold's rows."""
        other = fold != k if several else fold == k
        new = np.cumsum(other, dtype=np.int32) - 1
        use = other[row]
        model = fit_ordinal(new[row[use]], feature[use], grade[other], start=start, steps=steps)
        return model, _totals(model.weights, row, feature, len(toxic))[fold == k]

    score, first = np.zeros(len(toxic)), {}
    for k in range(fold.max() + 1):
        model, found = without(k, toxic, 40)
        # Fits differ in their scale and threshold, so scores count as distances from it.
        score[fold == k] = (found - model.thresholds[0]) / max(np.abs(found).mean(), 1e-9)
        first[k] = model.weights
    grade = np.where(toxic == 0, 0, np.where(score <= np.median(score[toxic == 1]), 1, 2))
    chance = np.zeros(len(toxic))
    for k, start in first.items():
        model, found = without(k, grade, 25, start)
        chance[fold == k] = model.at_least(found)[:, 0]
    final = fit_ordinal(row, feature, grade, start=np.mean(list(first.values()), axis=0))
    both = labels.filter("doc_id IS NOT NULL").groupBy(F.col("toxic").cast("int").alias("toxic")).count()
    often = {r["toxic"]: r["count"] for r in both.filter("toxic IN (0, 1)").collect()}
    size = np.bincount(toxic)
    cut = best_cut(chance, toxic, (often[0] / size[0], often[1] / size[1]))
    return OrdinalModel(final.weights, final.thresholds, cut)


def _score(batches: Iterator[pa.RecordBatch], model: OrdinalModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in tk.slices(batch.column(1)):
            row, feature = _features(data, offsets)
            p = model.at_least(_totals(model.weights, row, feature, last - first))
            mass = -np.diff(np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], axis=1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, last - first),
                    pa.array(p.sum(axis=1)),
                    pa.array(mass.argmax(axis=1).astype(np.int32)),
                    pa.array(p[:, 0] < model.reject),
                ],
                ["doc_id", "severity", "grade", "kept"],
            )


def score_severity(
    docs: DataFrame, labels: DataFrame, *, rows_per_class: int = 4000, class_bytes: int = CLASS_BYTES
) -> DataFrame:
    """(doc_id, severity, grade, kept), a row for each row of ``docs``.

    ``severity`` is the expected grade, 0 to 2; ``grade`` the likeliest one;
    ``kept`` is false when a grade of 1 or more has the chance that training found
    to reject from, or more.
    Null and empty texts have no features and are scored by the thresholds alone,
    which clean texts set.  Without labels of both classes nothing is known of
    toxicity: severity 0, grade 0, kept.  Repeated rows each get their row; null
    doc_ids are carried along; further columns are not read.  An empty table gives
    an empty result.
    """
    model = train_severity(docs, labels, rows_per_class=rows_per_class, class_bytes=class_bytes)
    if model is None:
        model = OrdinalModel(np.zeros(1 << BITS, np.float32), np.array([50.0, 60.0]))
    # The model's size is fixed: 2**18 weights.
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        lambda it: _score(it, shared.value), "doc_id bigint, severity double, grade int, kept boolean"
    )


def drop_toxic(
    docs: DataFrame, labels: DataFrame, *, rows_per_class: int = 4000, class_bytes: int = CLASS_BYTES
) -> DataFrame:
    """The rows of ``docs`` that the model keeps, with all their columns."""
    model = train_severity(docs, labels, rows_per_class=rows_per_class, class_bytes=class_bytes)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            ok = np.ones(batch.num_rows, dtype=bool)
            for first, last, data, offsets in tk.slices(batch.column(at)):
                row, feature = _features(data, offsets)
                score = _totals(shared.value.weights, row, feature, last - first)
                ok[first:last] = shared.value.at_least(score)[:, 0] < shared.value.reject
            yield batch.filter(pa.array(ok))

    return docs.mapInArrow(keep, docs.schema)
