"""Jump consistent hashing of stable keys to shards, without a ring table.

The jump step follows Lamping and Veach (2014): a 64-bit linear congruential
generator, seeded by the key, gives the next shard count at which the key
moves; the shard is the last such place below the count.  Adding a shard moves
a key only into the new shard, and only one key in n + 1.  State is kept as an
unsigned number in decimal(20, 0), as Spark's bigint arithmetic does not wrap.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch

# Fixed values of the published generator.
MULTIPLIER = 2862933555777941757
INCREMENT = 1
#: Keys that order slots have so many hexadecimal digits.
DIGITS = 15


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def jump_shard(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a bigint key; null counts as -1."""
    if shards < 1:
        raise ValueError("at least one shard")
    two32, two64 = (F.lit(Decimal(2**n)).cast("decimal(20,0)") for n in (32, 64))
    multiplier = F.lit(MULTIPLIER).cast("decimal(19,0)")

    def state(b: Column, j: Column, high: Column, low: Column) -> Column:
        return F.struct(b.alias("b"), j.alias("j"), high.alias("high"), low.alias("low"))

    def moved(s: Column) -> Column:
        # The generator's next value in two 32-bit halves, so that products stay below 10**29.
        product = (
            (s["high"].cast("decimal(10,0)") * multiplier) % two32 * two32
            + s["low"].cast("decimal(10,0)") * multiplier
            + F.lit(INCREMENT)
        ) % two64
        halves = _let(
            product.cast("decimal(20,0)"),
            lambda x: F.struct(
                ((x - x % two32) / two32).cast("bigint").alias("high"),
                (x % two32).cast("bigint").alias("low"),
            ),
        )
        return _let(
            halves,
            lambda h: state(
                s["j"],
                F.floor(
                    (s["j"] + 1) * (F.lit(2.0**31) / (F.shiftright(h["high"], 1) + 1))
                ).cast("bigint"),
                h["high"],
                h["low"],
            ),
        )

    def jump(k: Column) -> Column:
        first = state(
            F.lit(-1).cast("bigint"),
            F.lit(0).cast("bigint"),
            F.shiftrightunsigned(k, 32),
            k.bitwiseAND(F.lit(2**32 - 1)),
        )
        # j grows with every step, so as many steps as shards always end it; most keys need about ln(shards).
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(shards)),
            first,
            lambda s, _: F.when(s["j"] >= shards, s).otherwise(moved(s)),
            lambda s: s["b"].cast("int"),
        )

    return _let(F.coalesce(key.cast("bigint"), F.lit(-1).cast("bigint")), jump)


def slot_key(doc_id: Column, crc: Column) -> Column:
    """A number from 0 to 16**DIGITS - 1 by which slots are ordered; also to be had in SQL."""
    parts = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), crc.cast("string"))
    return F.conv(F.substring(F.md5(parts), 1, DIGITS), 16, 10).cast("bigint")


def shard_documents(
    docs: DataFrame, *, shards: int = 16, rows_per_range: int = 4096
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), a row for each row of ``docs``.

    Law ``key``: doc_id and shard count decide.  ``size`` is the text's UTF-8 bytes
    plus 1, ``text_crc32`` the unsigned CRC-32 of those bytes (null text: of
    none), ``grown_shard`` the shard with one shard more, ``slot`` the place in
    the shard, from 0 without gaps, ordered by a hash of doc_id and CRC, then by
    doc_id, CRC and size.  Rows that agree in all three differ in nothing that is
    returned, so reruns give the same rows.

    A null doc_id counts as key -1.  Equal doc_ids share a shard, but the hash
    spreads their texts over its ranges.  Other columns
    are not read; an empty table gives an empty result.

    Slots are distributed prefix sums: counts by shard and range are added up, rows
    are ordered only within a range of about ``rows_per_range`` rows.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = scratch.save(
        docs.select(
            F.col("doc_id"),
            (F.octet_length(data) + 1).cast("bigint").alias("size"),
            F.crc32(data).alias("text_crc32"),
            jump_shard(F.col("doc_id"), shards).alias("shard"),
            jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"),
        ),
        "rows",
    )
    per_shard = rows.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    ranges = max(1, -(-per_shard // rows_per_range))
    placed = rows.withColumn("order", slot_key(F.col("doc_id"), F.col("text_crc32"))).withColumn(
        "range", F.least(F.floor(F.col("order") / F.lit(16.0**DIGITS) * ranges), F.lit(ranges - 1)).cast("bigint")
    )
    counts = placed.groupBy("shard", "range").agg(F.count("*").alias("n"))
    running = Window.partitionBy("shard").orderBy("range")
    starts = counts.select("shard", "range", (F.sum("n").over(running) - F.col("n")).alias("start"))
    within = F.row_number().over(
        Window.partitionBy("shard", "range").orderBy("order", "doc_id", "text_crc32", "size")
    )
    return (
        placed.withColumn("within", within)
        .join(starts, ["shard", "range"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("start") + F.col("within") - 1).cast("bigint").alias("slot"),
            "grown_shard",
        )
    )


def oracle(shards: int = 16) -> str:
    """DuckDB SQL for :func:`shard_documents` on the view ``documents``."""

    def jumps(name: str, n: int) -> str:
        # State: b and j, and the generator's number; 2**33 - 1 is the least divisor, for a number of zeros.
        step = f"((r.key::HUGEINT * {MULTIPLIER} + {INCREMENT}) % 18446744073709551616)"
        return f"""
{name}(id, key, b, j) AS (SELECT id, CASE WHEN id < 0 THEN id::HUGEINT + 18446744073709551616 ELSE id::HUGEINT END, -1::BIGINT, 0::BIGINT FROM ids
  UNION ALL SELECT r.id, x.key, r.j, floor((r.j + 1) * (2147483648.0::DOUBLE / ((x.key // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM {name} r, LATERAL (SELECT {step} AS key) x WHERE r.j < {n})"""

    table = "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"
    return f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {table} AS t),
ids AS (SELECT DISTINCT coalesce(doc_id, -1) AS id FROM documents),{jumps("walk", shards)},{jumps("grown", shards + 1)},
texts AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
crcs AS MATERIALIZED (SELECT text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(text))),
  lambda i: (strpos('0123456789ABCDEF', hex(encode(text))[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', hex(encode(text))[2 * i + 2]) - 1)),
  lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS text_crc32 FROM texts, crc),
placed AS (SELECT doc_id, octet_length(encode(crcs.text)) + 1 AS size, text_crc32,
  (SELECT max(b) FROM walk WHERE id = coalesce(doc_id, -1)) AS shard, (SELECT max(b) FROM grown WHERE id = coalesce(doc_id, -1)) AS grown_shard
  FROM documents JOIN crcs ON coalesce(documents.text, '') = crcs.text)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard
  ORDER BY ('0x' || md5(concat(coalesce(doc_id::VARCHAR, ''), ':', text_crc32::VARCHAR))[1:{DIGITS}])::BIGINT, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  grown_shard::INT AS grown_shard FROM placed"""
