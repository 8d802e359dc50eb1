"""Benchmark passages in documents by pigeonhole edit matching.

Texts are folded: A-Z lower-cased, runs of ASCII characters other than letters
and digits turned into one space; matching works on the UTF-8 bytes of that.  A
test item with an error budget of k is split into k + 1 pieces; where the item
occurs with at most k edits, one piece occurs exactly.  Pieces are found by
their first eight bytes (all, where a piece is shorter): every eight-byte window
of a slice of texts is one 64-bit number, looked up in a bit table and then among
the pieces' numbers, for all items in one pass.  A count of common 4-grams (at
least length - 3 - 4k for a match) drops most chance hits, and Myers'
bit-parallel algorithm gives the distance of the others.  Short items, for which
an edit would make another sentence, must occur exactly and as whole words.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkit as tk
from tidemark.llm.scratch import Scratch

_FOLD = bytes(
    b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else b + 32 if 65 <= b <= 90 else 32
    for b in range(256)
)
GRAM = 4
ANCHOR = 8
#: Between folded texts; it occurs in none.
_GAP = b"\n" * ANCHOR


def fold(text: bytes) -> str:
    """Folded text; each character stands for one byte."""
    return b" ".join(text.translate(_FOLD).split()).decode("latin-1")


def budget(length: int, rate: float, least_item: int) -> int:
    """Edits allowed for an item of so many folded bytes: ``rate`` of them, none below ``least_item``."""
    return int(rate * length) if length >= least_item else 0


def _masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        out[c] |= 1 << i
    return dict(out)


def myers(masks: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """The least edit distance of the pattern to a substring of ``text``, and where the first such one ends."""
    full, high = (1 << length) - 1, 1 << (length - 1)
    up, down, score = full, 0, length
    best, end = length, 0
    for i, c in enumerate(text):
        same = masks.get(c, 0)
        vertical = same | down
        horizontal = (((same & up) + up) ^ up) | same
        plus = down | ~(horizontal | up)
        minus = up & horizontal
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
            if score < best:
                best, end = score, i + 1
        plus = (plus << 1) & full
        minus = (minus << 1) & full
        up = (minus | ~(vertical | plus)) & full
        down = plus & vertical
    return best, end


def _windows(data: bytes) -> np.ndarray:
    """The eight bytes from each place on as one number, the first byte the lowest."""
    return np.ndarray((len(data) - ANCHOR + 1,), "<u8", data, strides=(1,))


def _cut(windows: np.ndarray, n: int) -> np.ndarray:
    return windows if n == ANCHOR else windows & tk.U64((1 << (8 * n)) - 1)


@dataclass
class Matcher:
    """Finds the items of one block in folded texts."""

    items: list[tuple[int, str, int]]  # item_id, folded text, budget
    least_item: int = 25
    #: By anchor length: the pieces' anchors in order, where each one's pieces begin, and a bit table over their hashes.
    anchors: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, int]] = field(default_factory=dict)
    #: By anchor length: (item, first byte, last byte) of the pieces, by anchor.
    pieces: dict[int, np.ndarray] = field(default_factory=dict)
    masks: dict[int, dict[str, int]] = field(default_factory=dict)
    grams: dict[int, Counter] = field(default_factory=dict)

    def build(self) -> Matcher:
        if not self.items:
            return self
        data = "".join(text for _, text, _ in self.items).encode("latin-1") + _GAP
        size = np.array([len(text) for _, text, _ in self.items], np.int64)
        count = np.array([k + 1 for _, _, k in self.items], np.int64)
        item = np.repeat(np.arange(len(size)), count)
        turn = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        first, last = turn * size[item] // count[item], (turn + 1) * size[item] // count[item]
        number = _windows(data)[(np.cumsum(size) - size)[item] + first]
        length = np.minimum(last - first, ANCHOR)
        for n in np.unique(length).tolist():
            held = np.flatnonzero(length == n)
            own = _cut(number[held], n)
            order = np.argsort(own, kind="stable")
            held, (own, begins) = held[order], np.unique(own[order], return_index=True)
            bits = max(12, len(own).bit_length() + 5)
            table = np.zeros(1 << bits, dtype=bool)
            table[self._slot(own, bits)] = True
            self.anchors[n] = (own, np.append(begins, len(held)), table, bits)
            self.pieces[n] = np.stack([item[held], first[held], last[held]], axis=1)
        return self

    @staticmethod
    def _slot(number: np.ndarray, bits: int) -> np.ndarray:
        return (number * tk.U64(0x9E3779B97F4A7C15)) >> tk.U64(64 - bits)

    def hits(self, folded: list[bytes]) -> Iterator[tuple[int, dict[int, set[int]]]]:
        """(row, {item: places in the text where it would begin}) of the texts with an exact piece."""
        data = _GAP.join(folded) + _GAP
        at = np.cumsum([0, *[len(x) + ANCHOR for x in folded]])
        windows = _windows(data)
        begins: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for n, (own, first, table, bits) in self.anchors.items():
            number = _cut(windows, n)
            near = np.flatnonzero(table[self._slot(number, bits)])
            place = np.minimum(np.searchsorted(own, number[near]), len(own) - 1)
            same = own[place] == number[near]
            near, place = near[same], place[same]
            row = np.searchsorted(at, near, side="right") - 1
            for x, p, r in zip(near.tolist(), place.tolist(), row.tolist(), strict=True):
                for index, begin, last in self.pieces[n][first[p] : first[p + 1]].tolist():
                    piece = self.items[index][1][begin:last]
                    if len(piece) <= n or data.startswith(piece.encode("latin-1"), x):
                        begins[r][index].add(x - int(at[r]) - begin)
        yield from sorted(begins.items())

    def _verify(self, index: int, window: str) -> tuple[int, int] | None:
        _, pattern, k = self.items[index]
        at = window.find(pattern)
        if at >= 0:
            return 0, at + len(pattern)
        if not k:
            return None
        if index not in self.grams:
            self.grams[index] = Counter(pattern[i : i + GRAM] for i in range(len(pattern) - GRAM + 1))
            self.masks[index] = _masks(pattern)
        need = len(pattern) - GRAM + 1 - GRAM * k
        if need > 0:
            have = Counter(window[i : i + GRAM] for i in range(len(window) - GRAM + 1))
            if sum(min(n, have[g]) for g, n in self.grams[index].items() if g in have) < need:
                return None
        distance, end = myers(self.masks[index], len(pattern), window)
        return (distance, end) if distance <= k else None

    def _whole_word(self, pattern: str, begins: set[int], text: str) -> int | None:
        """Where the first whole-word occurrence at one of the places ends."""
        for begin in sorted(begins):
            end = begin + len(pattern)
            if begin >= 0 and text.startswith(pattern, begin) and text[begin - 1 : begin] in ("", " ") and text[end : end + 1] in ("", " "):
                return end
        return None

    def find(self, text: str, begins: dict[int, set[int]]) -> Iterator[tuple[int, int, int, int]]:
        """(item_id, distance, length of the item, end in ``text``) of each item that occurs, given :meth:`hits`."""
        for index in sorted(begins):
            item_id, pattern, k = self.items[index]
            if len(pattern) < self.least_item:
                end = self._whole_word(pattern, begins[index], text)
                if end is not None:
                    yield item_id, 0, len(pattern), end
                continue
            best, reach = None, -1
            run: list[int] = []
            # Windows around neighbouring places are searched as one.
            for begin in [*sorted(begins[index]), None]:
                if run and (begin is None or begin > reach):
                    first = max(0, run[0] - k)
                    found = self._verify(index, text[first : run[-1] + len(pattern) + k])
                    if found and (best is None or found[0] < best[0]):
                        best = (found[0], first + found[1])
                    run = []
                if begin is None or (best and best[0] == 0):
                    break
                run.append(begin)
                reach = begin + 2 * k
            if best:
                yield item_id, best[0], len(pattern), best[1]


def _item_blocks(
    benchmark: DataFrame, rate: float, least_item: int, block_bytes: int
) -> Iterator[list[tuple[int | None, str, int]]]:
    """Items in blocks of about ``block_bytes``; only one block at a time is on the driver."""
    items = benchmark.select(
        F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")
    ).filter("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = sorted(((r["item_id"], fold(r["text"].encode())) for r in own.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield [(item_id, text, budget(len(text), rate, least_item)) for item_id, text in rows if text]


def _matched(column: pa.Array, matcher: Matcher) -> Iterator[tuple[int, list[tuple[int, int, int, int]]]]:
    """(row, matches) of the texts that hold an item."""
    for first, _, data, offsets in tk.slices(column):
        whole = data.tobytes()
        folded = [b" ".join(whole[i:j].translate(_FOLD).split()) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
        for row, begins in matcher.hits(folded):
            found = list(matcher.find(folded[row].decode("latin-1"), begins))
            if found:
                yield first + row, found


NAMES = ["doc_id", "item_id", "distance", "item_bytes", "match_end"]


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, *, rate: float = 0.08, least_item: int = 25, block_bytes: int = 32_000_000
) -> DataFrame:
    """(doc_id, item_id, distance, item_bytes, match_end): every item that occurs in a document.

    An item occurs when some passage of the folded document is within
    ``budget(item_bytes, rate, least_item)`` edits of the folded item;
    ``distance`` is the least number, ``match_end`` where the first such passage
    found ends, in bytes of the folded text.  Items of fewer than ``least_item``
    folded bytes occur only exactly and as whole words.

    Items that are null or empty once folded never match.  Equal items each match,
    and so do items without an item_id.  Null and empty texts match nothing;
    repeated documents each get their rows; null doc_ids are carried along; other
    columns are not read.  An empty table on either side gives an empty result.

    One pass over the documents serves ``block_bytes`` of benchmark, which a worker
    holds with about twice as many bytes of index; more is searched block by block.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts: list[DataFrame] = []
    scratch, blocks = None, _item_blocks(benchmark, rate, least_item, block_bytes)
    for items in blocks:
        shared = spark.sparkContext.broadcast(items)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, least_item).build()
            for batch in batches:
                ids = batch.column(0)
                rows = [(ids[row].as_py(), *one) for row, found in _matched(batch.column(1), matcher) for one in found]
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], NAMES)

        found = texts.mapInArrow(search, ", ".join(f"{n} bigint" for n in NAMES))
        if sum(len(text) for _, text, _ in items) > block_bytes // 2 or parts:
            # Several blocks, or nearly: each one's result is written, so that no task and no driver holds two.
            scratch = scratch or Scratch(spark, "decontaminate")
            found = scratch.save(found, f"matches-{len(parts)}")
            shared.unpersist()
        parts.append(found)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, rate: float = 0.08, least_item: int = 25, block_bytes: int = 32_000_000
) -> DataFrame:
    """The rows of ``docs`` in which no item occurs (see :func:`benchmark_matches`), with all their columns."""
    spark = docs.sparkSession
    scratch, done = None, 0
    for items in _item_blocks(benchmark, rate, least_item, block_bytes):
        shared = spark.sparkContext.broadcast(items)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, least_item).build()
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for row, _ in _matched(batch.column(batch.schema.get_field_index("text")), matcher):
                    clean[row] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
        if sum(len(text) for _, text, _ in items) > block_bytes // 2 or done:
            scratch = scratch or Scratch(spark, "decontaminate")
            docs = scratch.save(docs, f"left-{done}")
            scratch.drop(f"left-{done - 1}")
            shared.unpersist()
        done += 1
    return docs
