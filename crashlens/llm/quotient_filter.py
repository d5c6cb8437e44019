"""11. Exact de-duplication with counting quotient filters.

Texts are equal when identical after lower-casing A-Z. Every text's fingerprint is the first ``bits``
bits of its SHA-256. Each partition builds a counting quotient filter over its fingerprints: a
fingerprint's high bits (quotient) say where its low bits (remainder) are stored, one bit per quotient
says whether it has a run, one bit per slot where a run ends, remainders stand sorted in their run, and
slots that stand for more than one text have a counter. A filter gives back its fingerprints in sorted
order with their counts, so filters of different sizes merge without loss: they are cut by the first
bits of the fingerprint, and each cut is merged by sorted remainders in a task of its own. Fingerprints
whose merged count is above one (copies, and the rare texts that share a fingerprint) go to byte
verification: their texts are read again and grouped by their bytes. All others are known to be alone.

Skew: a filter holds a fingerprint once however often it comes, so a text with a third of all rows
sends one entry per partition; grouping by bytes combines copies in each task first; rows meet their
verdict in :func:`salted.join`. Only fingerprints, never texts, of rows that are alone leave their task,
unless more than 500,000 fingerprints repeat: then their list is not broadcast, and texts are shuffled once.

Nulls, empty tables, ties: a null text is an empty text, and all empty texts are one group. A null key is
less than any other; rows that repeat both key and text are told apart by their place in the table, and
one of them stays. An empty table gives an empty table. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import salted
from . import words as W
from .store import materialise, ship

BITS = 48             # of a fingerprint: at 3e10 different texts some 1.6e6 pairs share one by chance
MERGE_ROWS = 1 << 18  # fingerprints that one merging task takes, about
ROUTED = 500_000      # repeated fingerprints (16 bytes each) that are broadcast


@dataclass
class QuotientFilter:
    """Fingerprints of ``width`` bits. ``occupied``: a bit per quotient; ``ends``: a bit per slot, set where a
    run ends; ``remainders``: a slot per different fingerprint; ``slots``, ``counts``: slots that count
    more than one, and their counts."""

    width: int
    quotient_bits: int
    occupied: np.ndarray
    ends: np.ndarray
    remainders: np.ndarray
    slots: np.ndarray
    counts: np.ndarray

    @classmethod
    def build(cls, prints: np.ndarray, counts: np.ndarray, width: int) -> QuotientFilter:
        """From different fingerprints in rising order and their counts."""
        q = min(width, max(len(prints) - 1, 0).bit_length())
        r = width - q
        quotient = (prints >> np.uint64(r)).astype(np.int64) if r < 64 else np.zeros(len(prints), np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        ends = np.ones(len(prints), bool)
        ends[:-1] = quotient[1:] != quotient[:-1]
        size = next(s for s in (1, 2, 4, 8) if 8 * s >= r)
        rest = (prints & np.uint64((1 << r) - 1)).astype(f"<u{size}")
        many = np.flatnonzero(counts > 1)
        return cls(width, q, np.packbits(occupied), np.packbits(ends), rest, many.astype("<u4"), counts[many].astype("<i8"))

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Its fingerprints in rising order, and their counts."""
        n = len(self.remainders)
        ends = np.unpackbits(self.ends, count=n).astype(bool)
        run = np.concatenate(([0], np.cumsum(ends)[:-1])) if n else np.zeros(0, np.int64)
        quotient = np.flatnonzero(np.unpackbits(self.occupied, count=1 << self.quotient_bits))[run]
        r = self.width - self.quotient_bits
        high = quotient.astype(np.uint64) << np.uint64(r) if r < 64 else np.zeros(n, np.uint64)
        counts = np.ones(n, np.int64)
        counts[self.slots] = self.counts
        return high | self.remainders.astype(np.uint64), counts

    def to_bytes(self) -> bytes:
        head = np.array([self.width, self.quotient_bits, len(self.remainders), self.remainders.itemsize, len(self.slots)], "<i8")
        return b"".join(a.tobytes() for a in (head, self.occupied, self.ends, self.remainders, self.slots, self.counts))

    @classmethod
    def from_bytes(cls, blob: bytes) -> QuotientFilter:
        width, q, n, size, many = (int(x) for x in np.frombuffer(blob, "<i8", 5))
        at, parts = 40, []
        for kind, length in (("u1", ((1 << q) + 7) // 8), ("u1", (n + 7) // 8), (f"<u{size}", n), ("<u4", many), ("<i8", many)):
            parts.append(np.frombuffer(blob, kind, length, at))
            at += parts[-1].nbytes
        return cls(width, q, *parts)


def merge(filters: list[QuotientFilter], width: int) -> QuotientFilter:
    """One filter with the fingerprints of all and the sums of their counts."""
    both = [f.entries() for f in filters]
    prints, counts = np.concatenate([p for p, _ in both]), np.concatenate([c for _, c in both])
    order = np.argsort(prints, kind="stable")  # sorted runs one after another: merged, not sorted anew
    prints, counts = prints[order], counts[order]
    new = np.flatnonzero(np.concatenate(([True], prints[1:] != prints[:-1]))) if len(prints) else np.zeros(0, np.int64)
    return QuotientFilter.build(prints[new], np.add.reduceat(counts, new) if len(new) else counts, width)


def digests(df: DataFrame, key: str, text: str, bits: int, with_text: bool = False) -> DataFrame:
    """Per row: ``key``, the text's fingerprint and SHA-256, and on demand the normalised text."""
    ship(df.sparkSession)
    source = df.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                data, at = W.lowered(part.column("text"))
                view = memoryview(data)
                sha = [hashlib.sha256(view[a:b]).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                print_ = np.array([int.from_bytes(d[:8], "big") >> (64 - bits) for d in sha], np.int64)
                out = [part.column("key"), pa.array(print_), pa.array(sha, pa.binary())]
                if with_text:
                    out.append(pa.LargeStringArray.from_buffers(len(sha), pa.py_buffer(at), pa.py_buffer(data)).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(out, ["key", "print", "sha", "text"][:len(out)])

    return source.mapInArrow(run, "key bigint, print bigint, sha binary" + (", text string" if with_text else ""))


def repeated_prints(rows: DataFrame, bits: int, n_rows: int) -> DataFrame:
    """(print, n): fingerprints in ``rows`` that more than one row has, from merged filters."""
    cut = min(bits, (max(n_rows, 1) // MERGE_ROWS).bit_length())  # first bits of a fingerprint, which deal the filters
    width = bits - cut

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        if not got:
            return
        prints, counts = np.unique(np.concatenate(got).astype(np.uint64), return_counts=True)
        lots = (prints >> np.uint64(width)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], lots[1:] != lots[:-1]))) if len(lots) else np.zeros(0, np.int64)
        mask = np.uint64((1 << width) - 1)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(lots)]):
            blob = QuotientFilter.build(prints[a:b] & mask, counts[a:b], width).to_bytes()
            yield pa.RecordBatch.from_arrays([pa.array([lots[a]], pa.int64()), pa.array([blob], pa.binary())], ["lot", "filter"])

    def join(table: pa.Table) -> pa.Table:
        whole = merge([QuotientFilter.from_bytes(b) for b in table.column("filter").to_pylist()], width)
        prints, counts = whole.entries()
        more = counts > 1
        lot = table.column("lot")[0].as_py()
        return pa.table({"print": pa.array((prints[more] | np.uint64(lot << width)).astype(np.int64)), "n": pa.array(counts[more])})

    filters = rows.select("print").mapInArrow(build, "lot bigint, filter binary")
    return filters.groupBy("lot").applyInArrow(join, "print bigint, n bigint")


def exact_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """One row per row of ``df``: ``key``, keep_id (the key of the row that stays of its group of equal texts),
    group_size, kept, text_sha256 (of the normalised text)."""
    rows = materialise(digests(df, key, text, bits).withColumn("row", F.monotonically_increasing_id()), "prints")
    n_rows = rows.count()
    routed = materialise(repeated_prints(rows, bits, n_rows), "repeated")

    texts = digests(df, key, text, bits, with_text=True).withColumn("row", F.monotonically_increasing_id())
    suspects = salted.join(texts, routed, ["print"], "n", "row", n_rows, "inner", small=ROUTED)
    equal = suspects.groupBy("print", "sha", "text").agg(F.count(F.lit(1)).alias("size"), F.max("key").alias("keep"))
    groups = materialise(equal.filter("size > 1").select("sha", "size", "keep"), "groups")

    found = materialise(salted.join(rows, groups, ["sha"], "size", "row", n_rows), "verdicts")
    alone = F.col("size").isNull()
    top = ~alone & F.col("key").eqNullSafe(F.col("keep"))
    tops = found.filter(top).groupBy("sha").agg(F.max("row").alias("row"), F.count(F.lit(1)).alias("tied"))
    if tops.filter("tied > 1").isEmpty():
        kept = alone | top
    else:  # rows that repeat key and text: one stays
        found = found.join(tops.select("row", F.lit(True).alias("stays")), "row", "left")
        kept = alone | F.coalesce("stays", F.lit(False))
    return found.select(F.col("key").alias(key), F.when(alone, F.col("key")).otherwise(F.col("keep")).alias("keep_id"),
                        F.coalesce("size", F.lit(1).cast("bigint")).alias("group_size"), kept.alias("kept"),
                        F.lower(F.hex("sha")).alias("text_sha256"))
