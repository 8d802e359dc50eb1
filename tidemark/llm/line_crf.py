"""Quality rules with line labels from a linear-chain conditional random field.

Lines of a text that hold a word form a sequence.  Viterbi decoding marks each
as content or boilerplate; the share of words in content lines decides whether
the text stays, after base rules on length and repetition.

Labels exist for documents only, so the labels of training lines are found by
expectation and maximisation: they start as their document's label; then the
field is fitted, and each line takes the label that the field finds likelier,
as far as its document's label allows: a good document has at least
``min_content_share`` of its words in content lines, a bad one less.  Where a
document breaks this, its most doubtful lines change sides until it holds.  The
first rounds judge each line alone, as moves between labels cannot be learned
from labels that never change within a text; the later ones judge it in context.
So good documents come to have boilerplate lines, bad ones content lines, and
transitions between the two are learned.  All counts are taken from whole texts,
for a slice of texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkit as tk
from tidemark.llm.sampling import labelled_texts


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


SYMBOL = _table(b"#*$%&|<>")
UPPER = _table(bytes(range(65, 91)))
LETTER = _table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
DIGIT = _table(bytes(range(48, 58)))
SHOUT = _table(b"!")
STOP = _table(b".?!:;\"')")
FEATURES = 18
CONTENT, BOILERPLATE = 0, 1
REPEAT_WINDOW = 8


def _sums(mask: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])


def _repeated(keys: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries occur twice or more in their group, and which are not the first of their kind."""
    order = np.lexsort((np.arange(len(keys)), keys, groups))
    same = np.zeros(len(keys), dtype=bool)
    same[1:] = (keys[order][1:] == keys[order][:-1]) & (groups[order][1:] == groups[order][:-1])
    later, several = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    later[order] = same
    several[order] = same | np.concatenate([same[1:], [False]])
    return several, later


@dataclass
class Lines:
    """Counts of a slice of texts and features of their lines."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    #: For each line with a word: its number of words and its features; ``at`` are the rows' offsets into them.
    words: np.ndarray
    features: np.ndarray
    at: np.ndarray


def measure(data: np.ndarray, offsets: np.ndarray) -> Lines:
    starts, ends, at = tk.words(data, offsets)
    n_rows = len(offsets) - 1
    row = np.repeat(np.arange(n_rows), np.diff(at))
    hashes = tk.span_hashes(data, starts, ends)
    outside = tk.SEPARATOR[data]
    points = _sums(((data & 0xC0) != 0x80) & ~outside)
    symbols = _sums(SYMBOL[data])

    covered = np.zeros(len(starts), dtype=bool)
    windows = tk.runs(hashes, REPEAT_WINDOW)
    whole = np.flatnonzero(row[: len(windows)] == row[REPEAT_WINDOW - 1 :]) if len(windows) else windows
    if len(whole):
        several, _ = _repeated(windows[whole], row[whole])
        first = whole[several]
        edge = np.bincount(first, minlength=len(starts) + 1) - np.bincount(
            first + REPEAT_WINDOW, minlength=len(starts) + 1
        )
        covered = np.cumsum(edge)[:-1] > 0
    cover = _sums(covered)

    line_starts, line_ends, _ = tk.spans(data != 10, offsets)
    w0, w1 = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    held = w1 > w0
    line_starts, line_ends, w0, w1 = line_starts[held], line_ends[held], w0[held], w1[held]
    line_row = row[w0] if len(w0) else np.zeros(0, np.int64)
    line_at = np.searchsorted(line_row, np.arange(n_rows + 1))
    line_hash = tk.span_hashes(data, line_starts, line_ends)
    _, later = _repeated(line_hash, line_row)
    n = (w1 - w0).astype(np.float64)

    def per(total: np.ndarray, of: np.ndarray) -> np.ndarray:
        return (total[line_ends] - total[line_starts]) / np.maximum(of, 1)

    letters = _sums(LETTER[data])
    n_letters = letters[line_ends] - letters[line_starts]
    again = np.zeros(len(starts), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    again = _sums(again)
    length = per(points, n)
    last = data[ends[w1 - 1] - 1] if len(w1) else np.zeros(0, np.uint8)
    begin = data[starts[w0]] if len(w0) else last
    position = np.arange(len(w0)) - line_at[line_row]
    behind = line_at[line_row + 1] - 1 - np.arange(len(w0))
    features = np.stack(
        [
            np.ones(len(w0)),
            n <= 3,
            (n > 3) & (n <= 8),
            n > 20,
            STOP[last],
            per(_sums(UPPER[data]), n_letters),
            np.minimum(per(symbols, n), 1.0),
            np.minimum(per(_sums(data == 124), n), 1.0),
            np.minimum(per(_sums(DIGIT[data]), points[line_ends] - points[line_starts]), 1.0),
            np.minimum(per(_sums(SHOUT[data]), n), 1.0),
            later,
            (cover[w1] - cover[w0]) / np.maximum(n, 1),
            (again[w1] - again[w0]) / np.maximum(n, 1),
            UPPER[begin] | (begin >= 128),
            length < 3,
            length > 14,
            position == 0,
            behind == 0,
        ],
        axis=1,
    ).astype(np.float64)
    return Lines(
        np.diff(at).astype(np.int64),
        points[offsets[1:]] - points[offsets[:-1]],
        symbols[offsets[1:]] - symbols[offsets[:-1]],
        np.bincount(line_row[later], minlength=n_rows).astype(np.int64),
        cover[at[1:]] - cover[at[:-1]],
        (w1 - w0).astype(np.int64),
        features,
        line_at,
    )


@dataclass(frozen=True)
class Field:
    """Scores: lines' features by label, label after label, and the first label."""

    emit: np.ndarray
    move: np.ndarray
    first: np.ndarray


def decode(field: Field, features: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The most probable labels of all lines; of equal paths, the one with more content labels at its end."""
    labels = np.zeros(len(features), dtype=np.int8)
    count = np.diff(at)
    order = np.argsort(-count, kind="stable")
    count, begin = count[order], at[:-1][order]
    emit = features @ field.emit
    active = np.searchsorted(-count, 0, side="left")
    if not active:
        return labels
    best = field.first + emit[begin[:active]]
    back: list[np.ndarray] = []
    ended = {}
    for t in range(1, int(count[0]) + 1):
        now = int(np.searchsorted(-count, -t, side="left"))  # rows with more than t lines
        if now < active:
            ended[t - 1] = (now, active, best[now:active].argmax(axis=1))
        if not now:
            break
        ways = best[:now, :, None] + field.move[None]
        back.append(ways.argmax(axis=1).astype(np.int8))
        best = ways.max(axis=1) + emit[begin[:now] + t]
        active = now
    state = np.zeros(len(count), dtype=np.int64)
    for t in range(int(count[0]) - 1, -1, -1):
        if t in ended:
            lo, hi, last = ended[t]
            state[lo:hi] = last
        rows = int(np.searchsorted(-count, -t, side="left"))
        labels[begin[:rows] + t] = state[:rows]
        if t:
            state[:rows] = back[t - 1][np.arange(rows), state[:rows]]
    return labels


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    high = x.max(axis=axis, keepdims=True)
    return (high + np.log(np.exp(x - high).sum(axis=axis, keepdims=True))).squeeze(axis)


class _Chains:
    """Sequences laid out for forward and backward sums over all of them at once.

    Sequences of over ``longest`` lines are worked on in pieces, so that memory and steps are bounded; what
    begins in the middle of a text gets no score for a first label.
    """

    def __init__(self, at: np.ndarray, longest: int):
        begin = np.concatenate([np.arange(i, j, longest) for i, j in zip(at[:-1], at[1:], strict=True)] or [[]])
        begin = begin.astype(np.int64)
        stop = np.minimum(begin + longest, at[np.searchsorted(at, begin, side="right")])
        order = np.argsort(begin - stop, kind="stable")
        self.begin, count = begin[order], (stop - begin)[order]
        self.head = np.isin(self.begin, at[:-1])
        self.top = int(count[0]) if len(count) else 0
        self.live = [int(np.searchsorted(-count, -t, side="left")) for t in range(self.top)]

    def expect(self, field: Field, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(label) of every line, and the expected number of each move."""
        begin, live, top = self.begin, self.live, self.top
        alpha = [np.where(self.head[:, None], field.first, 0.0) + score[begin]]
        for t in range(1, top):
            alpha.append(_lse(alpha[-1][: live[t], :, None] + field.move, 1) + score[begin[: live[t]] + t])
        share, moves, beta = np.zeros_like(score), np.zeros((2, 2)), np.zeros((0, 2))
        for t in range(top - 1, -1, -1):
            own = np.zeros((live[t], 2))
            if len(beta):
                ahead = score[begin[: len(beta)] + t + 1] + beta
                own[: len(beta)] = _lse(field.move[None] + ahead[:, None, :], 2)
                whole = alpha[t][: len(beta), :, None] + field.move + ahead[:, None, :]
                moves += np.exp(whole - _lse(whole.reshape(-1, 4), 1)[:, None, None]).sum(axis=0)
            beta = own
            both = alpha[t] + beta
            share[begin[: live[t]] + t] = np.exp(both - _lse(both, 1)[:, None])
        return share, moves

    def moves(self, labels: np.ndarray) -> np.ndarray:
        out = np.zeros((2, 2))
        for t in range(1, self.top):
            i = self.begin[: self.live[t]] + t
            np.add.at(out, (labels[i - 1], labels[i]), 1)
        return out


def fit_field(
    features: np.ndarray, at: np.ndarray, labels: np.ndarray, *, steps: int = 150, l2: float = 1.0, longest: int = 64,
    start: Field | None = None,
) -> Field:
    """Penalised maximum likelihood by forward-backward sums and Adam."""
    chains, truth = _Chains(at, longest), np.eye(2)[labels]
    x = [np.zeros((features.shape[1], 2)), np.zeros((2, 2)), np.zeros(2)]
    if start is not None:
        x = [start.emit.copy(), start.move.copy(), start.first.copy()]
    heads = chains.begin[chains.head]
    wanted = [features.T @ truth, chains.moves(labels), truth[heads].sum(axis=0)]
    m, v = [np.zeros_like(p) for p in x], [np.zeros_like(p) for p in x]
    for step in range(1, steps + 1):
        share, moves = chains.expect(Field(*x), features @ x[0])
        found = [features.T @ share, moves, share[heads].sum(axis=0)]
        for i, p in enumerate(x):
            g = (wanted[i] - found[i] - l2 * p) / len(chains.begin)
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            p += 0.1 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return Field(*x)


def relabel(content: np.ndarray, words: np.ndarray, at: np.ndarray, good: np.ndarray, share: float) -> np.ndarray:
    """Line labels from P(content) of lines, as far as documents' labels allow.

    ``good`` marks documents that have at least ``share`` of their words in content
    lines; the others have less.
    """
    labels = np.where(content >= 0.5, CONTENT, BOILERPLATE)
    for row, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)):
        own, need = labels[i:j], share * words[i:j].sum()
        held = words[i:j][own == CONTENT].sum()
        if (held >= need) == good[row]:
            continue
        # The likeliest content lines first; as many of them as the label asks for, or allows.
        order = np.argsort(-content[i:j], kind="stable")
        total = np.cumsum(words[i:j][order])
        most = int(np.searchsorted(total, need, side="left"))  # lines that hold less than the share
        own[order] = np.where(np.arange(j - i) < most + bool(good[row]), CONTENT, BOILERPLATE)
    return labels


def train_field(
    docs: DataFrame, labels: DataFrame, *, rows_per_class: int = 1500, class_bytes: int = 6 << 20, share: float = 0.5
) -> Field | None:
    """The field, or None where the labels do not hold both classes.

    At most ``rows_per_class`` labelled documents of each class are used, the least
    by a hash of doc_id, with at most ``class_bytes`` bytes of text, each line counting
    20 more.  See :func:`tidemark.llm.sampling.labelled_texts` for labels that are null
    or contradict each other and for repeated doc_ids.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in tk.slices(batch.column(1)):
                lines = measure(data, offsets)
                flat = np.column_stack([lines.words, lines.features]).astype(np.float32).reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array((lines.at * (FEATURES + 1)).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), lists], ["quality", "features"]
                )

    rows = (
        labelled_texts(docs, labels, "quality", rows_per_class, class_bytes, line_bytes=20)
        .mapInArrow(extract, "quality int, features array<float>")
        .toArrow()
    )
    found = sorted(
        (q, bytes(np.asarray(x.values, dtype=np.float32).tobytes()))
        for q, x in zip(rows["quality"].to_pylist(), rows["features"].combine_chunks(), strict=True)
        if len(x.values)
    )
    if len({q for q, _ in found}) < 2:
        return None
    lines = [np.frombuffer(x, np.float32).reshape(-1, FEATURES + 1) for _, x in found]
    at = np.concatenate([[0], np.cumsum([len(x) for x in lines])])
    good = np.array([q == 1 for q, _ in found])
    whole = np.concatenate(lines).astype(np.float64)
    words, features = whole[:, 0], np.ascontiguousarray(whole[:, 1:])
    label = np.where(np.repeat(good, np.diff(at)), CONTENT, BOILERPLATE)
    field = None
    for longest, steps in ((1, 150), (1, 60), (64, 150), (64, 60)):
        field = fit_field(features, at, label, start=field, steps=steps, longest=longest)
        p, _ = _Chains(at, longest).expect(field, features @ field.emit)
        label = relabel(p[:, CONTENT], words, at, good, share)
    return fit_field(features, at, label, start=field, steps=60)


def judge_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    min_words: int = 20,
    max_repeat_percent: int = 30,
    min_content_share: float = 0.5,
    rows_per_class: int = 1500,
) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share).

    A row for each row of ``docs``.  ``base_failed``: fewer than ``min_words`` words,
    or more than ``max_repeat_percent`` of the words in repeated windows of eight.
    ``content_share`` is the share of words in lines labelled content; ``kept`` asks
    for ``min_content_share`` and no failed base rule.

    Null, empty and wordless texts have only zeros, a share of 0, and fail.
    Without labels of both classes every line counts as content.  Repeated rows
    each get their row, null doc_ids are carried along, further columns are not
    read.  An empty table gives an empty result.
    """
    field = train_field(docs, labels, rows_per_class=rows_per_class, share=min_content_share)
    if field is None:
        field = Field(np.zeros((FEATURES, 2)), np.zeros((2, 2)), np.array([1.0, 0.0]))
        field.emit[0, CONTENT] = 1.0
    # The field's size is fixed: 18 x 2 + 6 numbers.
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in tk.slices(batch.column(1)):
                x = measure(data, offsets)
                content = decode(shared.value, x.features, x.at) == CONTENT
                words = _sums(np.where(content, x.words, 0))
                share = (words[x.at[1:]] - words[x.at[:-1]]) / np.maximum(x.n_words, 1)
                failed = (x.n_words < min_words) | (100 * x.n_repeat_words > max_repeat_percent * x.n_words)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        *map(pa.array, (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words)),
                        pa.array(failed),
                        pa.array(~failed & (share >= min_content_share)),
                        pa.array(share),
                    ],
                    schema,
                )

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = [*names, "base_failed", "kept", "content_share"]
    types = ", ".join(f"{x} bigint" for x in names)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text")).mapInArrow(
        judge, f"{types}, base_failed boolean, kept boolean, content_share double"
    )
