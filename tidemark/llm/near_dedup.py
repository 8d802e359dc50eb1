"""Near-duplicate groups by a multi-index Hamming join of b-bit MinHash signatures.

Every distinct shingle set gets a signature of ``chunks * width`` symbols of 16
bits.  It is split into ``chunks`` pieces of ``width`` symbols; a piece may
hold ``errors`` wrong symbols, so for each choice of that many places to leave
out, the remaining symbols make one key.  By pigeonhole, signatures that differ
in at most ``chunks * (errors + 1) - 1`` symbols agree on a key.  At a Jaccard
similarity of 0.85 and the default 10 x 6 symbols with one error, two sets miss
each other in all chunks with probability 0.224**10, about 3e-7.

Links are found in two passes, so that a bucket of n alike sets never makes
n**2 pairs.  First every set is compared with the least set of each of its
buckets.  Then only buckets that still hold several components are searched for
pairs between components, in blocks of bounded size: members of a bucket's
largest component (L) meet the others (O), and the others each other, so a
bucket's members come into ``ceil(O / rows) * ceil(O + L / rows)`` blocks and not
into the square of all.  A block is screened on signatures alone; only members
that have a pair left take their text there, and the block gives a spanning
forest of its links, so no more links than it has members.  Both passes leave
out signatures further apart than ``far`` symbols: at a similarity of 0.85 the
expected distance is 9 of 60, and more than 26 has probability 3e-8.  Every link
is confirmed on the full shingle sets (as sets of 64-bit hashes) of the whole
texts.

Sets are known by a 64-bit id of their content; among n distinct sets two share
one with probability n**2 / 2**65.  A set's text is that of one row, found again
by doc_id and a hash of the text, so rows that share a doc_id, or have none, are
never taken for each other.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkit as tk
from tidemark.llm.components import components
from tidemark.llm.scratch import Scratch

_SIGNED = "doc_id bigint, text_hash bigint, n_shingles bigint, node bigint, signature binary"
#: Stands for a null doc_id where rows are ordered or joined by it.
NO_ID = 2**63 - 1


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.Philox(77))
    return rng.integers(1, 2**63, n, dtype=np.uint64) * tk.U64(2) + tk.U64(1), rng.integers(
        0, 2**63, n, dtype=np.uint64
    )


def _distinct(hashes: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    for i, j in zip(at[:-1], at[1:], strict=True):
        own = np.sort(hashes[i:j])
        yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


def _set_id(own: np.ndarray) -> int:
    """A signed 64-bit id of a set of hashes (0 elements: 0)."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(tk.mix(own)) + tk.U64(len(own))
        both = np.bitwise_xor.reduce(tk.mix(own ^ tk.U64(0x5851F42D4C957F2D)))
        return int(tk.mix(np.array([total ^ (both * tk.U64(0x9E3779B97F4A7C15))]))[0].view(np.int64))


def _sign(batches: Iterator[pa.RecordBatch], k: int, symbols: int) -> Iterator[pa.RecordBatch]:
    mult, add = _multipliers(symbols)
    for batch in batches:
        ids, marks = batch.column(0), batch.column(1)
        for first, last, data, offsets in tk.slices(batch.column(2)):
            hashes, at = tk.shingle_sets(data, offsets, k)
            n = last - first
            filled = np.flatnonzero(np.diff(at))
            signature = np.zeros((n, symbols), dtype=np.uint16)
            if len(filled):
                for s in range(symbols):
                    low = np.minimum.reduceat(hashes * mult[s] + add[s], at[filled])
                    signature[filled, s] = (tk.mix(low) >> tk.U64(48)).astype(np.uint16)
            counts, nodes = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for row, own in enumerate(_distinct(hashes, at)):
                counts[row], nodes[row] = len(own), _set_id(own) if len(own) else 0
            empty = counts == 0
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(first, n),
                    marks.slice(first, n),
                    pa.array(counts),
                    pa.array(nodes, mask=empty),
                    pa.array([x.tobytes() for x in signature], mask=empty, type=pa.binary()),
                ],
                ["doc_id", "text_hash", "n_shingles", "node", "signature"],
            )


def _places(width: int, errors: int) -> list[tuple[int, ...]]:
    return list(combinations(range(width), width - errors))


def _key(sig: np.ndarray, c: int, m: int, keep: list[tuple[int, ...]]) -> np.ndarray:
    """Keys of signatures (rows x chunks x width) from the m-th choice of places in chunk c."""
    key = np.full(len(sig), c * len(keep) + m + 1, dtype=np.uint64)
    for p in keep[m]:
        key = key * tk.U64(0x9E3779B97F4A7C15) + sig[:, c, p].astype(np.uint64) + tk.U64(1)
        key ^= key >> tk.U64(29)
    return tk.mix(key)


def _keys(
    batches: Iterator[pa.RecordBatch], chunks: int, width: int, errors: int
) -> Iterator[pa.RecordBatch]:
    keep = _places(width, errors)
    for batch in batches:
        if not batch.num_rows:
            continue
        nodes = batch.column("node").to_numpy()
        sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=np.uint16)
        sig = sig.reshape(len(nodes), chunks, width)
        for c in range(chunks):
            out = np.concatenate([_key(sig, c, m, keep) for m in range(len(keep))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out.view(np.int64)), pa.array(np.tile(nodes, len(keep)))], ["key", "node"]
            )


def _near(sig_a: list[bytes], sig_b: list[bytes], symbols: int, far: int) -> np.ndarray:
    x = np.frombuffer(b"".join(sig_a), dtype=np.uint16).reshape(-1, symbols)
    y = np.frombuffer(b"".join(sig_b), dtype=np.uint16).reshape(-1, symbols)
    return (x != y).sum(axis=1) <= far


def _screen(
    batches: Iterator[pa.RecordBatch], symbols: int, far: int, percent: int
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        near = _near(
            batch.column("sig_a").to_pylist(), batch.column("sig_b").to_pylist(), symbols, far
        )
        n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
        near &= 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
        yield batch.select(["a", "b"]).filter(pa.array(near))


def _joined_key(sig: np.ndarray, key: int, chunks: int, width: int, errors: int) -> tuple[int, int]:
    """Which chunk and which choice of places made ``key`` from a signature: all its keys at once."""
    keep = np.array(_places(width, errors))
    chunk = np.repeat(np.arange(chunks), len(keep))
    picked = sig[chunk[:, None], np.tile(keep, (chunks, 1))].astype(np.uint64)
    own = np.arange(1, len(chunk) + 1, dtype=np.uint64)
    for p in range(keep.shape[1]):
        own = own * tk.U64(0x9E3779B97F4A7C15) + picked[:, p] + tk.U64(1)
        own ^= own >> tk.U64(29)
    at = np.flatnonzero(tk.mix(own).view(np.int64) == key)
    if not len(at):
        raise ValueError("the key is not one of the signature's")
    return int(at[0]) // len(keep), int(at[0]) % len(keep)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one (key, i, j) block after another; rows come sorted by block."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        group = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")])
        cut = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1
        bounds = [0, *cut.tolist(), batch.num_rows]
        if rest and tuple(group[:, 0]) != last:
            yield pa.Table.from_batches(rest)
            rest = []
        for begin, end in zip(bounds[:-2], bounds[1:-1], strict=True):
            yield pa.Table.from_batches([*rest, batch.slice(begin, end - begin)])
            rest = []
        rest.append(batch.slice(bounds[-2]))
        last = tuple(group[:, -1])
    if rest:
        yield pa.Table.from_batches(rest)


class _Block:
    """The members of one block and the pairs between components that their signatures leave over.

    A pair is examined only under the first key that both signatures share.
    """

    def __init__(self, rows: pa.Table, percent: int, chunks: int, width: int, errors: int, far: int):
        self.node, self.root = rows["node"].to_numpy(), rows["root"].to_numpy().copy()
        self.n, self.side = rows["n_shingles"].to_numpy(), rows["side"].to_numpy()
        sig = np.frombuffer(b"".join(rows["signature"].to_pylist()), dtype=np.uint16)
        self.sig = sig.reshape(-1, chunks, width)
        self.place = _joined_key(self.sig[0], rows["key"][0].as_py(), chunks, width, errors)
        self.diagonal = rows["i"][0].as_py() == rows["j"][0].as_py()
        self.percent, self.width, self.errors, self.far = percent, width, errors, far
        self.keep = _places(width, errors)

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """(x, ys) of rows; ``root`` may be changed between steps."""
        (c, m), n, node = self.place, self.n, self.node
        for x in np.flatnonzero(self.side == 0):
            able = (node > node[x]) if self.diagonal else (self.side == 1)
            able &= (self.root != self.root[x]) & (100 * np.minimum(n, n[x]) >= self.percent * np.maximum(n, n[x]))
            y = np.flatnonzero(able)
            if not len(y):
                continue
            same = self.sig[y] == self.sig[x]
            wrong = self.width - same.sum(axis=2)
            fresh = (wrong.sum(axis=1) <= self.far) & (wrong[:, :c] > self.errors).all(axis=1)
            for earlier in self.keep[:m]:
                fresh &= ~same[:, c, list(earlier)].all(axis=1)
            if fresh.any():
                yield x, y[fresh]


def _cross_screen(batches: Iterator[pa.RecordBatch], *how: int) -> Iterator[pa.RecordBatch]:
    """The members of each block that have a pair left there."""
    for rows in _blocks(batches):
        live = np.zeros(rows.num_rows, dtype=bool)
        for x, y in _Block(rows, *how).pairs():
            live[x] = live[y] = True
        if live.any():
            yield from rows.filter(pa.array(live)).combine_chunks().to_batches()


def _cross_links(batches: Iterator[pa.RecordBatch], k: int, percent: int, *how: int) -> Iterator[pa.RecordBatch]:
    """Links between components in each block: a spanning forest, confirmed on full sets.

    A pair is examined only while its two components have not met in the block.
    """

    def links(rows: pa.Table) -> pa.RecordBatch:
        block = _Block(rows, percent, *how)
        node, root = block.node, block.root
        sets: dict[int, np.ndarray] = {}

        def full(i: int) -> np.ndarray:
            if i not in sets:
                for _, _, data, offsets in tk.slices(rows["text"].slice(i, 1).combine_chunks()):
                    hashes, at = tk.shingle_sets(data, offsets, k)
                    sets[i] = next(_distinct(hashes, at))
                if _set_id(sets[i]) != node[i]:
                    raise ValueError(f"the text that came with set {node[i]} is another one's")
            return sets[i]

        a, b = [], []
        for x, ys in block.pairs():
            for i in ys:
                if root[i] == root[x]:
                    continue
                one, two = full(x), full(i)
                both = len(np.intersect1d(one, two, assume_unique=True))
                if 100 * both >= percent * (len(one) + len(two) - both):
                    a.append(max(node[x], node[i]))
                    b.append(min(node[x], node[i]))
                    root[root == root[i]] = root[x]
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]
        )

    for rows in _blocks(batches):
        yield links(rows)


def _confirm(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose full shingle sets are similar enough."""
    known: OrderedDict[int, np.ndarray] = OrderedDict()
    size = 0

    def sets(nodes: np.ndarray, texts: pa.Array) -> Iterator[np.ndarray]:
        nonlocal size
        for i in range(len(nodes)):
            own = known.get(node := int(nodes[i]))
            if own is None:
                for _, _, data, offsets in tk.slices(texts.slice(i, 1)):
                    hashes, at = tk.shingle_sets(data, offsets, k)
                    own = next(_distinct(hashes, at))
                if _set_id(own) != node:
                    raise ValueError(f"the text that came with set {node} is another one's")
                known[node] = own
                size += len(own)
                while size > 2_000_000 and len(known) > 1:
                    size -= len(known.popitem(last=False)[1])
            else:
                known.move_to_end(node)
            yield own

    for batch in batches:
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        keep = np.zeros(len(a), dtype=bool)
        of_a, of_b = sets(a, batch.column("text_a")), sets(b, batch.column("text_b"))
        for i in range(len(a)):
            x, y = next(of_a), next(of_b)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


@dataclass(frozen=True)
class Groups:
    """``signed``: (doc_id, text_hash, n_shingles, node, signature) of every row; ``classes``: (node, root, anchor,
    anchor_hash) of every distinct set, with the least doc_id of its rows (or NO_ID) and the text hash of one of those."""

    scratch: Scratch
    signed: DataFrame
    classes: DataFrame


def _ordered_id(docs: DataFrame) -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID).cast("bigint"))


def _text(docs: DataFrame) -> Column:
    return F.col("text").cast("string")


def find_groups(
    docs: DataFrame,
    *,
    percent: int = 85,
    shingle_words: int = 5,
    chunks: int = 10,
    width: int = 6,
    errors: int = 1,
    far: int = 26,
    block_rows: int = 2048,
    block_shingles: int = 2_000_000,
) -> Groups:
    """The sets of all rows and the components that links join them to (see :func:`near_duplicates`)."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    symbols = chunks * width
    how = (chunks, width, errors, far)
    signed = scratch.save(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(_text(docs)).alias("text_hash"), _text(docs).alias("text")
        ).mapInArrow(lambda it: _sign(it, shingle_words, symbols), _SIGNED),
        "signed",
    )
    order = F.coalesce("doc_id", F.lit(NO_ID).cast("bigint"))
    # Equal sets have equal signatures and sizes, so any will do.
    nodes = scratch.save(
        signed.filter("node is not null")
        .groupBy("node")
        .agg(
            F.min(F.struct(order.alias("id"), "text_hash")).alias("low"),
            F.max("n_shingles").alias("n_shingles"),
            F.first("signature").alias("signature"),
        )
        .select("node", F.col("low.id").alias("anchor"), F.col("low.text_hash").alias("anchor_hash"), "n_shingles", "signature"),
        "nodes",
    )
    keys = nodes.select("node", "signature").mapInArrow(
        lambda it: _keys(it, chunks, width, errors), "key bigint, node bigint"
    )
    buckets = scratch.save(
        keys.groupBy("key")
        .agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n"))
        .filter("n > 1"),
        "buckets",
    )
    # Buckets of two are settled by their one pair; larger ones list their members.
    crowded = scratch.save(
        keys.join(buckets.filter("n > 2").select("key", "low", "n"), "key"), "crowded"
    )
    pairs = (
        buckets.select(F.col("high").alias("a"), F.col("low").alias("b"))
        .union(crowded.filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")))
        .distinct()
    )
    brief = nodes.select("node", "n_shingles", "signature")

    def side(s: str) -> DataFrame:
        return brief.select(
            F.col("node").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("signature").alias(f"sig_{s}")
        )

    star = scratch.save(
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .select("a", "b", "sig_a", "sig_b", "n_a", "n_b")
        .mapInArrow(lambda it: _screen(it, symbols, far, percent), "a bigint, b bigint"),
        "star",
    )

    def texts_of(wanted: DataFrame, name: str) -> DataFrame:
        """(node, text), a row for each wanted node."""
        anchors = nodes.join(wanted, "node").select("node", "anchor", "anchor_hash")
        found = scratch.save(
            docs.select(_ordered_id(docs).alias("anchor"), F.xxhash64(_text(docs)).alias("anchor_hash"), _text(docs).alias("text"))
            .join(anchors, ["anchor", "anchor_hash"])
            .select("node", "text"),
            f"{name}-rows",
        )
        # Repeated rows, alike in doc_id and text, come more than once.
        if not found.groupBy("node").count().filter("count > 1").take(1):
            return found
        once = scratch.save(found.groupBy("node").agg(F.first("text").alias("text")), name)
        scratch.drop(f"{name}-rows")
        return once

    texts = texts_of(star.select(F.col("a").alias("node")).union(star.select("b")).distinct(), "star-texts")
    links = scratch.save(
        star.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
        .mapInArrow(lambda it: _confirm(it, shingle_words, percent), "a bigint, b bigint"),
        "star-links",
    )
    scratch.drop("star-texts", "star-texts-rows", "star")
    roots = scratch.save(components(links, scratch, "first"), "roots")
    # Members of crowded buckets that are not yet in one component with all the others.
    member = (
        crowded.join(roots, "node", "left")
        .join(brief, "node")
        .select("key", "node", F.coalesce("root", "node").alias("root"), "n_shingles", "signature")
    )
    # For each bucket its components, then the largest of them against the others.
    parts = scratch.save(
        member.groupBy("key", "root").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("shingles")), "parts"
    )

    def dealt(members: Column, shingles: Column) -> Column:
        return F.greatest(F.ceil(members / block_rows), F.ceil(shingles / block_shingles)).cast("int")

    size = F.col("members") * F.lit(2.0) + (F.col("root") / F.lit(2.0**64) + 0.5)  # ties go to the greater root
    mixed = (
        parts.groupBy("key")
        .agg(
            F.count("*").alias("parts"),
            F.max_by("root", size).alias("main"),
            F.max_by("members", size).alias("main_members"),
            F.max_by("shingles", size).alias("main_shingles"),
            F.sum("members").alias("members"),
            F.sum("shingles").alias("shingles"),
        )
        .filter("parts > 1")
        .select(
            "key",
            "main",
            dealt(F.col("members") - F.col("main_members"), F.col("shingles") - F.col("main_shingles")).alias("others"),
            dealt(F.col("main_members"), F.col("main_shingles")).alias("mains"),
            dealt(F.col("members"), F.col("shingles")).alias("blocks"),
        )
    )
    # A bucket that fits into one block is one; there, members of a component are passed over.
    in_main = (F.col("root") == F.col("main")) & (F.col("blocks") > 1)
    turn = F.when(F.col("blocks") > 1, F.xxhash64("node")).otherwise(0)
    own = F.when(in_main, F.col("others") + F.pmod(turn, F.col("mains"))).otherwise(F.pmod(turn, F.col("others")))
    whole = F.when(F.col("blocks") > 1, F.col("others") + F.col("mains")).otherwise(F.col("others"))
    last = F.when(in_main, F.col("others")).otherwise(whole) - 1
    spread = (
        member.join(mixed, "key")
        .withColumn("own", own.cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), last)))
        .select(
            "key",
            F.least("own", "other").alias("i"),
            F.greatest("own", "other").alias("j"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
            "node",
            "root",
            "n_shingles",
            "signature",
        )
    )
    block = ["key", "i", "j"]
    live = scratch.save(
        spread.repartition(*block)
        .sortWithinPartitions(*block, "node")
        .mapInArrow(lambda it: _cross_screen(it, percent, *how), spread.schema),
        "live",
    )
    texts = texts_of(live.select("node").distinct(), "cross-texts")
    more = scratch.save(
        live.join(texts, "node")
        .repartition(*block)
        .sortWithinPartitions(*block, "node")
        .mapInArrow(lambda it: _cross_links(it, shingle_words, percent, *how), "a bigint, b bigint"),
        "cross-links",
    )
    scratch.drop("crowded", "buckets", "roots", "parts", "live", "cross-texts", "cross-texts-rows")
    roots = scratch.save(components(links.union(more), scratch, "last"), "groups")
    scratch.drop("star-links", "cross-links")
    classes = scratch.save(
        nodes.select("node", "anchor", "anchor_hash")
        .join(roots, "node", "left")
        .select("node", F.coalesce("root", "node").alias("root"), "anchor", "anchor_hash"),
        "classes",
    )
    scratch.drop("nodes", "groups")
    return Groups(scratch, signed, classes)


def near_duplicates(docs: DataFrame, **options: int) -> DataFrame:
    """Groups of near-duplicate texts: (doc_id, n_shingles, component_id, kept), a row for each row of ``docs``.

    Two documents are linked when 100 * (common shingles) >= percent * (shingles
    of either).  ``component_id`` is the least doc_id reachable over links,
    ``kept`` marks that document.  Options are those of :func:`find_groups`.

    Null and empty texts and texts of separators only have no shingles, are
    linked with nothing and stay.  Rows with a null doc_id take part; their
    component_id is the least non-null one of their group, or null, and they
    are kept only in a group without any doc_id.  Rows that share a doc_id are
    each judged by their own text.  Repeated rows each get their row.  Columns
    besides doc_id and text are not read, whatever their names.  An empty table
    gives an empty result.  However large a bucket is, about ``2 * block_rows`` of
    its members, or ``2 * block_shingles`` shingles, meet in one step.
    """
    groups = find_groups(docs, **options)
    scratch = groups.scratch
    # Component ids are found among distinct sets first, so that copies add nothing; each step's
    # table is written, so that the joins with hot keys can be split.
    least = scratch.save(groups.classes.groupBy("root").agg(F.min("anchor").alias("component_id")), "least")
    placed = scratch.save(groups.classes.join(least, "root").select("node", "component_id"), "placed")
    known = F.when(F.col("component_id") < NO_ID, F.col("component_id"))
    own_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(known)
    found = (
        groups.signed.select("doc_id", "n_shingles", "node")
        .join(placed, "node", "left")
        .select("doc_id", "n_shingles", own_id.alias("component_id"))
        .withColumn("kept", F.expr("doc_id <=> component_id"))
    )
    out = scratch.save(found, "result")
    scratch.drop("signed", "classes", "least", "placed")
    return out


def drop_near_duplicates(docs: DataFrame, **options: int) -> DataFrame:
    """The rows of ``docs`` with one of each near-duplicate group, with all their columns.

    The one that stays is that of the least doc_id (rows without one come last).
    Rows without shingles duplicate nothing, but of rows alike in doc_id and text
    (both may be null) one stays: the least by its columns as JSON.
    Rows that share a doc_id with different texts are different documents.
    """
    groups = find_groups(docs, **options)
    scratch = groups.scratch
    low = F.min(F.struct(F.col("anchor").alias("id"), F.col("anchor_hash").alias("hash")))
    firsts = groups.classes.groupBy("root").agg(low.alias("low")).select("low.id", "low.hash")
    bare = groups.signed.filter("node is null").select(
        F.coalesce("doc_id", F.lit(NO_ID).cast("bigint")).alias("id"), F.col("text_hash").alias("hash")
    )
    stay = scratch.save(firsts.union(bare).distinct(), "stay")
    scratch.drop("signed", "classes")
    columns = docs.columns
    row, id_, hash_, n = (_fresh(name, columns) for name in ("row", "id", "hash", "n"))
    named = docs.select(
        F.struct(*columns).alias(row), _ordered_id(docs).alias(id_), F.xxhash64(_text(docs)).alias(hash_)
    )
    kept = named.join(stay.select(F.col("id").alias(id_), F.col("hash").alias(hash_)), [id_, hash_])
    repeated = kept.groupBy(id_, hash_).agg(F.count("*").alias(n)).filter(F.col(n) > 1).select(id_, hash_)
    repeated = scratch.save(repeated, "repeated")
    if not repeated.take(1):
        return kept.select(f"{row}.*")
    once = kept.join(repeated, [id_, hash_], "left_anti").select(row)
    several = kept.join(repeated, [id_, hash_]).groupBy(id_, hash_)
    return once.union(several.agg(F.min_by(row, F.to_json(row)).alias(row)).select(row)).select(f"{row}.*")


def _fresh(name: str, taken: list[str]) -> str:
    """``name`` with underscores before it until no column has it (Spark compares without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def oracle(percent: int = 85, shingle_words: int = 5) -> str:
    """DuckDB SQL for :func:`near_duplicates` on the view ``documents``: all pairs that share a shingle, compared exactly."""
    k = shingle_words
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE split AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' ')))) END AS s FROM split),
rows AS MATERIALIZED (SELECT doc_id, s, CASE WHEN len(s) > 0 THEN md5(array_to_string(s, chr(10))) END AS node FROM shingled),
sets AS MATERIALIZED (SELECT node, any_value(s) AS s, len(any_value(s)) AS n, min(doc_id) AS anchor FROM rows WHERE node IS NOT NULL GROUP BY node),
each AS MATERIALIZED (SELECT node, n, unnest(s) AS one FROM sets),
links AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM each a JOIN each b ON a.one = b.one AND a.node < b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT node, node FROM sets UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a),
least AS (SELECT a AS node, min(anchor) AS component_id FROM reach JOIN sets ON reach.b = sets.node GROUP BY a),
found AS (SELECT doc_id, len(s) AS n_shingles, CASE WHEN rows.node IS NULL THEN doc_id ELSE component_id END AS component_id
  FROM rows LEFT JOIN least ON rows.node = least.node)
SELECT doc_id, n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM found"""
