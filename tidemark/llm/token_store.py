"""Token ids of documents in binary shards, each document compressed alone with one shared dictionary.

A store is a folder of

* ``dictionary.zdict``: a Zstandard dictionary, trained on serialised id arrays;
* ``shard-NNNNN.bin``: one Zstandard frame for each document, one after another;
* ``shard-NNNNN.idx``: the index of a shard, little-endian: the magic ``TIDETOK1``,
  the dictionary's SHA-256 (32 bytes), the number of documents n (u64), then n
  bytes that are 1 where doc_id is not null, n doc_ids (i64), n + 1 offsets into
  the .bin file (u64) and n + 1 token offsets in the shard (u64);
* ``manifest``: a Parquet table (shard, n_docs, n_tokens, n_bytes, start).

An id array is little-endian unsigned 32-bit numbers, the document's end id
last.  Shards hold ascending ranges of doc_id, null first.  The offsets give any
document by one read of its own frame.  A shard is written under a name of its
task attempt and renamed when complete, so lost and repeated tasks do no harm.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import textkit as tk
from tidemark.llm.sampling import fraction
from tidemark.llm.scratch import small_batches

MAGIC = b"TIDETOK1"
#: Remembered words: those of few bytes come again, the others serve one slice of texts.
_CACHE_WORDS, _CACHE_BYTES = 600_000, 11
_SLICE_BYTES = 2 << 20
#: A letter, then other ASCII signs up to white space; ``'`` and ``<`` may join what is around them.
#: The letter is looked for behind the first sign, as patterns that begin with a set are searched faster.
_SIGNS = re.compile(rb"[^a-z0-9\s\x80-\xff'<](?<=[a-z].)[^a-z0-9\s\x80-\xff'<]*+(?=\s|$)", re.DOTALL)
#: Folded words of letters below U+0250, which NFC leaves alone.
_LATIN = re.compile(rb"(?:[a-z]|[\xc3-\xc9][\x80-\xbf])+")
#: Case is left alone beside what case folding could touch: combining marks after a letter, special tokens.
_DELICATE = (b"\xcc", b"\xcd", b"<|")
_encoders: dict[str, _Encoder] = {}


def keeps_words_apart(path: str) -> bool:
    """Whether a tokenizer folds case, drops white space, keeps letters apart from other signs, and is a byte BPE.

    Its normaliser may replace runs of white space by a space, and nothing else.
    """
    file = json.loads(Path(path).read_bytes())
    normal = (file.get("normalizer") or {}).get("normalizers", [])
    steps = (file.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if [n["type"] for n in normal] != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
        return False
    if normal[1]["pattern"] != {"Regex": r"\s+"} or normal[1]["content"] != " ":
        return False
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    level = steps[1]
    return (
        steps[0]["pattern"] == {"Regex": pattern}
        and steps[0]["invert"]
        and steps[0]["behavior"] == "Removed"
        and not level["add_prefix_space"]
        and not level["use_regex"]
        and file["model"]["type"] == "BPE"
    )


def _byte_characters() -> dict[int, str]:
    """The characters that byte-level models use for bytes: printable Latin-1 as is, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(others)) for b in range(256)}


class _Words(dict):
    """Ids of words as bytes; a word that is not there is looked up, and remembered unless it is long."""

    def __init__(self, look_up):
        super().__init__()
        self.look_up = look_up
        self.long: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        if len(word) <= _CACHE_BYTES:
            found = self[word] = self.look_up(word)
            return found
        found = self.long.get(word)
        if found is None:
            found = self.long[word] = self.look_up(word)
        return found


class _Encoder:
    """Texts as bytes to id arrays as bytes.

    For tokenizers that keep words apart, ids of words are remembered: words are
    folded, and signs behind a word cut off, before they are looked up; new words
    of Latin letters go straight to the tokenizer's model.  Others get whole texts.
    """

    def __init__(self, path: str, by_word: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = by_word
        self.tokenize = self.tokenizer.model.tokenize
        self.bytes = _byte_characters()
        self.known = _Words(self.look_up)

    def plain(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def look_up(self, word: bytes) -> bytes:
        if word.isalpha() and word.islower():  # ASCII letters, which stand for themselves
            return array("I", [t.id for t in self.tokenize(word.decode())]).tobytes()
        if _LATIN.fullmatch(word) and (low := word.decode().lower()).isalpha():
            piece = low.encode().decode("latin-1").translate(self.bytes)
            return array("I", [t.id for t in self.tokenize(piece)]).tobytes()
        return self.plain([word.decode("utf-8", "replace")])[0]

    @staticmethod
    def words(text: bytes) -> list[bytes]:
        if any(mark in text for mark in _DELICATE):
            return text.split()
        return _SIGNS.sub(rb" \g<0>", text.lower()).split()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            return self.plain([t.decode("utf-8", "replace") for t in texts])
        if len(self.known) > _CACHE_WORDS:
            self.known.clear()
        self.known.long.clear()
        find = self.known.__getitem__
        return [b"".join(map(find, self.words(t))) for t in texts]


def _encoder(path: str, by_word: bool) -> _Encoder:
    """One encoder for each worker process, so that what it knows serves all its tasks."""
    if path not in _encoders:
        _encoders[path] = _Encoder(path, by_word)
    return _encoders[path]


def _texts(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    for first, _, data, offsets in tk.slices(column, _SLICE_BYTES):
        whole = data.tobytes()
        yield first, [whole[i:j] for i, j in zip(offsets[:-1], offsets[1:], strict=True)]


def _fs(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _read(uri: str) -> bytes:
    where, path = _fs(uri)
    with where.open_input_file(path) as f:
        return f.read()


def _write(uri: str, data: bytes) -> None:
    where, path = _fs(uri)
    where.create_dir(os.path.dirname(path), recursive=True)
    with where.open_output_stream(f"{path}.new") as f:
        f.write(data)
    where.move(f"{path}.new", path)


def _train(samples: list[bytes], size: int) -> bytes:
    """A dictionary; where the samples are too few to train one, their content itself."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b"\0" * 8


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data)


def _write_shard(
    batches: Iterator[pa.RecordBatch], root: str, tokenizer: str, by_word: bool, end_id: int, level: int
) -> Iterator[pa.RecordBatch]:
    import zstandard

    context = TaskContext.get()
    shard, attempt = context.partitionId(), context.taskAttemptId()
    end = struct.pack("<I", end_id)
    raw = _read(f"{root}/dictionary.zdict")
    packer, sink = None, None
    ids, valid, lengths, tokens = [], [], [], []
    where, path = _fs(f"{root}/shard-{shard:05d}")
    for batch in batches:
        if not batch.num_rows:
            continue
        if sink is None:
            dictionary = _dictionary(raw)
            dictionary.precompute_compress(level=level)
            packer = zstandard.ZstdCompressor(level=level, dict_data=dictionary)
            sink = where.open_output_stream(f"{path}.bin.{attempt}")
        column = batch.column(0)
        valid.append(np.asarray(column.is_valid()).astype(np.uint8))
        ids.append(column.fill_null(0).to_numpy())
        for _, texts in _texts(batch.column(1)):
            for found in _encoder(tokenizer, by_word).encode(texts):
                frame = packer.compress(found + end)
                sink.write(frame)
                lengths.append(len(frame))
                tokens.append(len(found) // 4 + 1)
    if sink is None:
        return
    sink.close()
    at = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    count = np.concatenate([[0], np.cumsum(tokens)]).astype("<u8")
    index = MAGIC + hashlib.sha256(raw).digest() + struct.pack("<Q", len(lengths))
    index += np.concatenate(valid).tobytes() + np.concatenate(ids).astype("<i8").tobytes()
    index += at.tobytes() + count.tobytes()
    with where.open_output_stream(f"{path}.idx.{attempt}") as f:
        f.write(index)
    where.move(f"{path}.bin.{attempt}", f"{path}.bin")
    where.move(f"{path}.idx.{attempt}", f"{path}.idx")
    yield pa.RecordBatch.from_pydict(
        {
            "shard": pa.array([shard], pa.int32()),
            "n_docs": pa.array([len(lengths)], pa.int64()),
            "n_tokens": pa.array([int(count[-1])], pa.int64()),
            "n_bytes": pa.array([int(at[-1])], pa.int64()),
        }
    )


def _sample(
    batches: Iterator[pa.RecordBatch], tokenizer: str, by_word: bool, most: int
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in _texts(batch.column(0)):
            found = [x[: 4 * most] for x in _encoder(tokenizer, by_word).encode(texts)]
            yield pa.RecordBatch.from_pydict({"ids": pa.array(found, pa.binary())})


def write_tokens(
    docs: DataFrame,
    root: str,
    *,
    tokenizer: str,
    end_id: int,
    rows_per_shard: int = 8192,
    dictionary_bytes: int = 32768,
    sample_docs: int = 1000,
    sample_ids: int = 2048,
    level: int = 3,
) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into a store at ``root`` and return its manifest.

    ``tokenizer`` is the path of a ``tokenizers`` file that every executor can read;
    ``end_id`` is appended to each document.  Null and empty texts give the end id
    alone.  Documents are written in ascending order of doc_id, null first, ties
    in order of a hash of their texts; repeated rows are all written.  Columns besides
    doc_id and text are not read.  An empty table gives an empty store.  Rows that
    share a doc_id are dealt over shards by a hash of their texts, and rows alike in
    both by the input partition they come from, so no shard grows with one doc_id.

    The dictionary is trained on at most ``sample_docs`` documents, the least by a
    hash of doc_id and text, and on at most ``sample_ids`` ids of each; it shapes only
    how well frames compress.  A task holds one slice of texts and a shard's
    index, not the shard.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    by_word = keeps_words_apart(tokenizer)
    rows = docs.count()
    # A few times the sample's number by hash first, so that the sort gathers no more than that.
    near = docs.withColumn("h", fraction("doc_id", "text")).filter(F.col("h") <= min(1.0, 3 * sample_docs / max(rows, 1)))
    sample = near.orderBy("h", "doc_id").limit(sample_docs).select("text").repartition(4)
    encoded = sample.mapInArrow(lambda it: _sample(it, tokenizer, by_word, sample_ids), "ids binary")
    samples = sorted(bytes(r["ids"]) for r in encoded.collect())
    _write(f"{root}/dictionary.zdict", _train([s for s in samples if s], dictionary_bytes))
    shards = max(1, -(-rows // rows_per_shard))
    order = ["doc_id", "hash", "part"]
    written = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.spark_partition_id().alias("part"))
        .repartitionByRange(shards, *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
        .mapInArrow(
            lambda it: _write_shard(it, root, tokenizer, by_word, end_id, level),
            "shard int, n_docs bigint, n_tokens bigint, n_bytes bigint",
        )
    )
    with small_batches(spark):
        written.write.mode("overwrite").parquet(f"{root}/shards")
    # One row a shard, so one task can add them up.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    spark.read.parquet(f"{root}/shards").withColumn(
        "start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("bigint")
    ).write.mode("overwrite").parquet(f"{root}/manifest")
    return spark.read.parquet(f"{root}/manifest")


class Shard:
    """Random access to the documents of one shard."""

    def __init__(self, root: str, shard: int):
        import zstandard

        where, path = _fs(f"{root}/shard-{shard:05d}")
        raw, index = _read(f"{root}/dictionary.zdict"), _read(f"{root}/shard-{shard:05d}.idx")
        if index[:8] != MAGIC or index[8:40] != hashlib.sha256(raw).digest():
            raise ValueError(f"shard {shard} was not written with this dictionary")
        (n,) = struct.unpack_from("<Q", index, 40)
        self.valid = np.frombuffer(index, np.uint8, n, 48).astype(bool)
        self.doc_ids = np.frombuffer(index, "<i8", n, 48 + n)
        self.at = np.frombuffer(index, "<u8", n + 1, 48 + 9 * n)
        self.tokens = np.frombuffer(index, "<u8", n + 1, 48 + 17 * n + 8)
        self._unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(raw)).decompress
        self._file = where.open_input_file(f"{path}.bin")

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, i: int) -> bytes:
        """The serialised ids of the i-th document, by one read of its frame."""
        first, last = int(self.at[i]), int(self.at[i + 1])
        return self._unpack(self._file.read_at(last - first, first))

    def close(self) -> None:
        self._file.close()


def _read_shards(batches: Iterator[pa.RecordBatch], root: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    def made(rows: list[tuple], ids: list[bytes]) -> pa.RecordBatch:
        doc_id, start, n, crc = zip(*rows, strict=True)
        columns = {
            "doc_id": pa.array(doc_id, pa.int64()),
            "start": pa.array(start, pa.int64()),
            "n_tokens": pa.array(n, pa.int64()),
            "ids_crc32": pa.array(crc, pa.int64()),
        }
        if with_ids:
            arrays = [np.frombuffer(x, "<u4").astype(np.int64) for x in ids]
            columns["ids"] = pa.array(arrays, pa.list_(pa.int64()))
        return pa.RecordBatch.from_pydict(columns)

    for batch in batches:
        for number, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shard = Shard(root, number)
            rows, ids, held = [], [], 0
            for i in range(len(shard)):
                found = shard.ids(i)
                rows.append(
                    (
                        int(shard.doc_ids[i]) if shard.valid[i] else None,
                        start + int(shard.tokens[i]),
                        len(found) // 4,
                        zlib.crc32(found),
                    )
                )
                if with_ids:
                    ids.append(found)
                    held += len(found)
                if len(rows) >= 4096 or held > 8 << 20:
                    yield made(rows, ids)
                    rows, ids, held = [], [], 0
            if rows:
                yield made(rows, ids)
            shard.close()


def read_tokens(spark: SparkSession, root: str, *, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document of a store, from its files.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is the unsigned
    CRC-32 of the serialised ids.  A shard whose index names another dictionary
    is an error.
    """
    shards = spark.read.parquet(f"{root}/manifest").select("shard", "start")
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    return shards.repartition(max(1, shards.count())).mapInArrow(
        lambda it: _read_shards(it, root, with_ids), schema + (", ids array<bigint>" if with_ids else "")
    )
