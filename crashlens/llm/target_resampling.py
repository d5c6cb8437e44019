"""13. Importance resampling towards a target distribution.

Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII; each is a feature of
bucket CRC-32 modulo ``BUCKETS``. Array-scored weights: every task counts its texts' buckets in one
array; the summed arrays of corpus and target (``BUCKETS`` numbers each, whatever the input) give a
gain per bucket, and a document's weight is the floored mean of its features' gains, read from the
array. Its score adds Gumbel noise from a hash of its id, so the highest scores are a draw without
replacement by weight.

Documents with enough words are ranked by a distributed LSD radix sort. The key is (score falling, id
rising), cut into digits of ``DIGIT_BITS`` bits; each pass, from the last digit to the first, is a stable
counting sort: blocks of ``1 << BLOCK_BITS`` consecutive positions count their digits, a running sum over
(digit, block) gives each block its first destination per digit, and a task per block places its rows.
After the last pass a row's position is its rank. Scores are whole numbers in a range that the
logarithm bounds, so a histogram of them gives the score of the last row drawn; rows below it
cannot be drawn and are left out of the sort.

Skew: blocks have a fixed size, so no digit, score or id makes a task larger. Memory: a task holds one
block or one slice of text.

Nulls, empty tables, ties: a null text has no words, weight 0 and no rank. A null id is hashed as an
empty one and ranks after all others. Rows with one id and one score rank by the number of features,
fewest first, and then by place. An empty table gives an empty table; an empty target counts as 0
features. Further columns are not read. Ids up to the full 64 bits are ranked rightly.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .store import materialise, ship

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
DIGIT_BITS, BLOCK_BITS = 11, 16

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, np.uint32(0xEDB88320), np.uint32(0)) ^ (value >> np.uint32(1))
    return value


_CRC = _crc_table()
_LONG = 64  # bytes; a longer word is left to zlib


def crc32_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each byte range: the ranges' bytes are fed one position after another."""
    length = end - start
    out = np.empty(len(start), np.uint32)
    order = np.argsort(-length, kind="stable")
    long = int(np.count_nonzero(length > _LONG))
    for i in order[:long].tolist():
        out[i] = zlib.crc32(data[start[i]:end[i]])
    order = order[long:]
    at, left = start[order], length[order]
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for j in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -j))  # ranges longer than j bytes stand first
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + j]) & np.uint32(0xFF)] ^ (state[:n] >> np.uint32(8))
    out[order] = ~state
    return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features, and n + 1 offsets of each text's first."""
    found = W.scan(texts, lower=True, word_bytes=_WORD_BYTE)
    return (crc32_of(found.data, found.start, found.end) % np.uint32(BUCKETS)).astype(np.int64), found.first


def bucket_counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """Features of all texts per bucket; the driver gets at most ``BUCKETS`` rows."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in W.slices(batch, "text"):
                total += np.bincount(features(part.column("text"))[0], minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    counted = df.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    out = np.zeros(BUCKETS, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln(target share / corpus share)), both smoothed by one."""
    own, wanted = float(corpus.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t + 1.0) * own / ((s + 1.0) * wanted)))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(key: int | None, seed: int = SEED) -> int:
    """floor of 1000 times a Gumbel number that depends on the id alone."""
    h = int.from_bytes(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()[:4], "big")
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(df: DataFrame, gain: np.ndarray, key: str, text: str, seed: int) -> DataFrame:
    """(key, n_features, weight, score) per row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                buckets, first = features(part.column("text"))
                n = np.diff(first)
                weight = np.where(n > 0, W.per_text(gain[buckets], first) // np.maximum(n, 1), 0)
                shift = np.array([noise(k, seed) for k in part.column("key").to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.array(x) for x in (n, weight, weight + shift))],
                                                 ["key", "n_features", "weight", "score"])

    source = df.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return source.mapInArrow(run, "key bigint, n_features bigint, weight bigint, score bigint")


def _digits(column: str, largest: int) -> list[Column]:
    """Digits of a column of unsigned 64-bit numbers up to ``largest``, the last one first."""
    return [F.shiftrightunsigned(column, s).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)).cast("int")
            for s in range(0, largest.bit_length(), DIGIT_BITS)]


def counting_pass(rows: DataFrame, digit: Column, name: str, block_bits: int = BLOCK_BITS) -> DataFrame:
    """``rows`` (with BIGINT ``pos``, different and in the order so far) stably sorted by ``digit``: ``pos`` becomes
    the place in the new order, from 0."""
    dealt = rows.withColumn("digit", digit).withColumn("block", F.shiftright("pos", block_bits))
    counts = dealt.groupBy("digit", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # one row per digit, so at most 1 << DIGIT_BITS rows in the window without a key, and in the broadcast
    starts = counts.groupBy("digit").agg(F.sum("n").alias("n")).select("digit", F.coalesce(
        F.sum("n").over(Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    offsets = (counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
               .join(F.broadcast(starts), "digit").select(F.col("block").alias("of"), F.col("digit").alias("value"), (F.col("start") + F.col("before")).alias("first")))
    carried = rows.columns

    def place(block: pa.Table, first: pa.Table) -> pa.Table:
        pos, digits = (block.column(c).to_numpy() for c in ("pos", "digit"))
        slots = np.full(1 << block_bits, -1, np.int64)
        slots[pos & ((1 << block_bits) - 1)] = np.arange(len(pos))
        order = slots[slots >= 0]                                    # rows in the order so far
        begin = np.zeros(1 << DIGIT_BITS, np.int64)
        begin[first.column("value").to_numpy()] = first.column("first").to_numpy()
        mine = digits[order]
        by_digit = np.argsort(mine.astype(np.uint16), kind="stable")  # numpy counts 16-bit keys
        n = np.bincount(mine, minlength=1 << DIGIT_BITS)
        within = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
        to = np.empty(len(pos), np.int64)
        to[order[by_digit]] = begin[mine[by_digit]] + within
        out = block.select(carried)
        return out.set_column(carried.index("pos"), "pos", pa.array(to))

    placed = dealt.groupBy("block").cogroup(offsets.groupBy("of")).applyInArrow(place, rows.schema)
    return materialise(placed, name)


def radix_sorted(rows: DataFrame, digits: list[Column], block_bits: int = BLOCK_BITS) -> DataFrame:
    """``rows`` with ``pos`` as the place (from 0) in the order of the digits, the last digit first in the list."""
    for i, digit in enumerate(digits or [F.lit(0)]):
        rows = counting_pass(rows, digit, f"pass-{i}", block_bits)
    return rows


def resample(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
             percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, block_bits: int = BLOCK_BITS) -> DataFrame:
    """One row per row of ``df``: ``key``, n_features, weight, score, and rank (null where not drawn)."""
    gain = gains(bucket_counts(df, text), bucket_counts(target, target_text))
    rows = materialise(scored(df, gain, key, text, seed).withColumn("pos", F.monotonically_increasing_id()), "scores")
    able = rows.filter(F.col("n_features") >= min_words)
    histogram = able.groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()  # whole numbers within some 1000 ln(corpus) of 0
    drawn, taken, cut = sum(r.n for r in histogram) * percent // 100, 0, 0
    for r in sorted(histogram, key=lambda r: -r.score):
        if taken >= drawn:
            break
        taken, cut = taken + r.n, r.score
    if not drawn:
        return rows.select(F.col("key").alias(key), "n_features", "weight", "score", F.lit(None).cast("bigint").alias("rank"))

    top = max(r.score for r in histogram)
    runs = able.filter(F.col("score") >= cut)
    low, high, most, nulls = runs.agg(F.min("key"), F.max("key"), F.max("n_features"), F.count_if(F.col("key").isNull())).first()
    # ids as unsigned numbers in the same order; a null one has a digit of its own before the id's
    sign = -(1 << 63)
    low, high = (low or 0) - sign, (high or 0) - sign
    same = (low ^ high).bit_length()  # bits in which ids can differ
    to_sort = runs.select("pos", F.col("pos").alias("row"), (F.lit(top) - F.col("score")).alias("down"), "n_features",
                          F.coalesce(F.col("key").bitwiseXOR(F.lit(sign).cast("bigint")), F.lit(0).cast("bigint")).alias("id"),
                          F.col("key").isNull().cast("int").alias("no_id"))
    twins = not to_sort.groupBy("down", "id", "no_id").count().filter("count > 1").isEmpty()
    digits = (_digits("n_features", most) if twins else []) + _digits("id", (1 << same) - 1)
    digits += ([F.col("no_id")] if nulls else []) + _digits("down", top - cut)
    ranked = radix_sorted(to_sort, digits, block_bits).filter(F.col("pos") < drawn)
    ranks = ranked.select(F.col("row").alias("pos"), (F.col("pos") + 1).alias("rank"))
    return rows.join(ranks, "pos", "left").select(F.col("key").alias(key), "n_features", "weight", "score", "rank")
