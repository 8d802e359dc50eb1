"""Language identification by a byte convolutional network.

Bytes (A-Z folded) are embedded; filters of widths 2, 3 and 4 run over windows of
a fixed length; the largest response of every filter in a window passes through
a rectifier to a softmax over the learned languages.  Training is plain numpy on
labelled text.  For prediction the embedding and the filters are folded into
tables by pairs of bytes, so that a filter bank costs one or two look-ups a
byte.  All windows of a text count, by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkit as tk
from tidemark.llm.sampling import CLASS_BYTES, least_by_hash, one_text_each

LENGTH = 128
WIDTHS = (2, 3, 4)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
UNDETERMINED = "und"


@dataclass(frozen=True)
class Network:
    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    dense: np.ndarray
    offset: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """For each width: the filters' responses to the byte pairs (or, last of an odd width, bytes) they cover."""
        out = []
        for width, filters, bias in zip(WIDTHS, self.filters, self.biases, strict=True):
            size = self.embedding.shape[1]
            single = [self.embedding @ filters[i * size : (i + 1) * size] for i in range(width)]
            parts = []
            for i in range(0, width - 1, 2):
                pair = single[i][:, None, :] + single[i + 1][None, :, :]
                parts.append(pair.reshape(65536, -1).astype(np.float32))
            if width % 2:
                parts.append(single[-1].astype(np.float32))
            parts[0] = parts[0] + bias.astype(np.float32)
            out.append(parts)
        return out


def train(
    windows: np.ndarray,
    labels: np.ndarray,
    languages: list[str],
    *,
    embed: int = 8,
    filters: int = 12,
    steps: int = 300,
    batch: int = 192,
    rate: float = 0.01,
    seed: int = 5,
) -> Network:
    """Adam on softmax cross-entropy; deterministic for the same rows in the same order."""
    rng = np.random.Generator(np.random.PCG64(seed))
    params = [rng.normal(0, 0.5, (256, embed))]
    params += [rng.normal(0, (w * embed) ** -0.5, (w * embed, filters)) for w in WIDTHS]
    params += [np.zeros(filters) for _ in WIDTHS]
    params += [rng.normal(0, 0.1, (filters * len(WIDTHS), len(languages))), np.zeros(len(languages))]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(windows), batch)
        x, y = windows[pick], labels[pick]
        e = params[0][x]
        pooled, where = [], []
        for i, w in enumerate(WIDTHS):
            span = LENGTH - w + 1
            out = sum(
                e[:, j : j + span] @ params[1 + i][j * embed : (j + 1) * embed] for j in range(w)
            )
            at = out.argmax(axis=1)
            where.append(at)
            pooled.append(np.take_along_axis(out, at[:, None, :], 1)[:, 0] + params[4 + i])
        hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
        z = hidden @ params[7] + params[8]
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(batch), y] -= 1
        p /= batch
        grads = [np.zeros_like(q) for q in params]
        grads[7], grads[8] = hidden.T @ p, p.sum(axis=0)
        back = (p @ params[7].T) * (hidden > 0)
        for i, w in enumerate(WIDTHS):
            d = back[:, i * filters : (i + 1) * filters]
            grads[4 + i] = d.sum(axis=0)
            for j in range(w):
                at = where[i] + j
                got = np.take_along_axis(x, at, axis=1)
                part = slice(j * embed, (j + 1) * embed)
                grads[1 + i][part] = np.einsum("nfe,nf->ef", params[0][got], d)
                np.add.at(grads[0], got, d[:, :, None] * params[1 + i][part].T[None])
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            params[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Network(languages, params[0], params[1:4], params[4:7], params[7], params[8])


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Windows of LENGTH folded bytes from each start, zero behind their end."""
    place = starts[:, None] + np.arange(LENGTH)
    inside = place < ends[:, None]
    return np.where(inside, _FOLD[data[np.minimum(place, len(data) - 1)]], 0).astype(np.uint8)


def probabilities(network: Network, tables: list[list[np.ndarray]], windows: np.ndarray) -> np.ndarray:
    """P(language) for each window."""
    out = np.empty((len(windows), len(network.languages)))
    for first in range(0, len(windows), 512):
        x = windows[first : first + 512]
        pairs = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        pooled = []
        for width, parts in zip(WIDTHS, tables, strict=True):
            span = LENGTH - width + 1
            total = parts[0][pairs[:, :span]]
            for i, part in enumerate(parts[1:], 1):
                total += part[(pairs if len(part) > 256 else x)[:, 2 * i : 2 * i + span]]
            pooled.append(total.max(axis=1))
        z = np.maximum(np.concatenate(pooled, axis=1), 0) @ network.dense + network.offset
        z = np.exp(z - z.max(axis=1, keepdims=True))
        out[first : first + 512] = z / z.sum(axis=1, keepdims=True)
    return out


def fold_of(doc_id: Column) -> Column:
    """crc32 of the decimal text of doc_id, modulo 3; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def _extract(batches: Iterator[pa.RecordBatch], each: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in tk.slices(batch.column(1)):
            size = np.diff(offsets)
            row = np.repeat(np.flatnonzero(size), each)
            turn = np.tile(np.arange(each), len(row) // each)
            room = np.maximum(size[row] - LENGTH, 0)
            starts = offsets[row] + room * turn // max(each - 1, 1)
            windows = cut(data, starts, offsets[row + 1])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, last - first).take(pa.array(row)),
                    pa.array([w.tobytes() for w in windows], pa.binary()),
                ],
                ["lang", "bytes"],
            )


def train_languages(
    docs: DataFrame, *, held_out: int = 1, rows_per_language: int = 1200, windows_per_row: int = 4, most_languages: int = 400
) -> Network | None:
    """A network from text and lang of the documents outside the held-out fold, or None without such documents.

    At most ``rows_per_language`` documents of each language are used, the least by
    a hash of doc_id, and ``windows_per_row`` windows spread evenly over each.  Of
    rows alike in doc_id and lang one text trains, the least by hash.  Over
    ``most_languages`` languages are an error, as the sample must stay bounded.
    """
    known = docs.select(
        F.col("doc_id").alias("doc"), F.col("lang").cast("string").alias("language"), F.col("text").cast("string").alias("text")
    ).filter((fold_of(F.col("doc")) != held_out) & F.col("language").isNotNull() & F.col("text").isNotNull())
    several = len(known.select("language").distinct().limit(most_languages + 1).collect())
    if several > most_languages:
        raise ValueError(f"lang has over {most_languages} values")
    # Bounded by rows_per_language for each of most_languages.
    chosen = least_by_hash(known.select("doc", "language"), "language", "doc", rows_per_language)
    rows = (
        one_text_each(known, chosen, ["doc", "language"], "language", CLASS_BYTES)
        .mapInArrow(lambda it: _extract(it, windows_per_row), "lang string, bytes binary")
        .toArrow()
    )
    found = sorted(zip(rows["lang"].to_pylist(), rows["bytes"].to_pylist(), strict=True))
    if not found:
        return None
    languages = sorted({x for x, _ in found})
    windows = np.frombuffer(b"".join(x for _, x in found), np.uint8).reshape(-1, LENGTH)
    labels = np.searchsorted(np.array(languages, dtype=object), [x for x, _ in found])
    # Every language weighs the same in the training draw.
    share = np.bincount(labels, minlength=len(languages))
    most = share.max()
    pick = np.concatenate([np.resize(np.flatnonzero(labels == k), most) for k in range(len(languages))])
    return train(windows[pick], labels[pick], languages)


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(_LETTER[data], dtype=np.int64)])
    out = total[offsets[1:]] > total[offsets[:-1]]
    for row in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        text = data[offsets[row] : offsets[row + 1]].tobytes().decode("utf-8", "replace")
        out[row] = any(ch.isalpha() for ch in text)
    return out


def _predict(batches: Iterator[pa.RecordBatch], network: Network, tables) -> Iterator[pa.RecordBatch]:
    names = np.array([*network.languages, UNDETERMINED], dtype=object)
    for batch in batches:
        for first, last, data, offsets in tk.slices(batch.column(2)):
            n, size = last - first, np.diff(offsets)
            count = -(-size // LENGTH)
            row = np.repeat(np.arange(n), count)
            within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            starts = offsets[row] + within * LENGTH
            stop = np.minimum(starts + LENGTH, offsets[row + 1])
            total = np.zeros((n, len(network.languages)))
            if len(row):
                p = probabilities(network, tables, cut(data, starts, stop)) * (stop - starts)[:, None]
                filled = np.flatnonzero(count)
                total[filled] = np.add.reduceat(p, (np.cumsum(count) - count)[filled])
            mean = total / np.maximum(size, 1)[:, None]
            known = _has_letter(data, offsets)
            best = np.where(known, mean.argmax(axis=1), len(network.languages))
            score = np.where(known, np.clip(mean.max(axis=1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, n),
                    batch.column(1).slice(first, n),
                    pa.array(names[best].tolist(), pa.string()),
                    pa.array(score),
                ],
                ["doc_id", "held_out", "lang_pred", "score"],
            )


def identify_languages(
    docs: DataFrame, *, held_out: int = 1, rows_per_language: int = 1200
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row for each row of ``docs``.

    ``held_out`` marks the fold whose documents never train (crc32 of the text of
    doc_id, modulo 3); a null doc_id is in no fold and never trains.  ``score`` is
    the mean probability of ``lang_pred`` over the windows of the whole text, by
    bytes.  Texts that are null or have no letter are ``und`` with score 0, and so
    is every text where nothing could be learned.  Ties go to the first language
    in code-point order.  Repeated rows each get their row; columns besides
    doc_id, text and lang are not read.  An empty table gives an empty result.
    """
    network = train_languages(docs, held_out=held_out, rows_per_language=rows_per_language)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(fold_of(F.col("doc_id")) == held_out, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    if network is None:
        return rows.select("doc_id", "held_out", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    # Fixed size: an embedding, three filter banks and a dense layer, some 10 kB.
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _predict(batches, shared.value, shared.value.tables())

    return rows.mapInArrow(predict, "doc_id bigint, held_out boolean, lang_pred string, score double")
