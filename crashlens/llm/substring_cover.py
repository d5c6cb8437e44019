"""Removal of repeated word windows by difference-cover anchors.

A window is WINDOW = 13 consecutive words of one document; a word goes if a window that covers it
also starts in a document with a smaller key. Windows are judged on the input.

Anchors are hashes of 7 words, taken only at positions whose remainder modulo PERIOD = 7 lies in
COVER = {1, 2, 4}. Every remainder is a difference of two members of COVER, so two equal windows of
13 words, wherever they start, hold an anchor at the same place of both. So it takes 3 anchors in 7
words to find every repeat, and only windows around an anchor that two documents share are then
extended: hashed over their 13 words and compared.

Both comparisons are the same exchange. Tasks sort their hashes, keep one document for each hash
(the one with the smallest key; the others already know that they share it), and deal them to lots
by leading hash bits, packed as arrays. So a passage that a third of all documents hold costs one
entry per task. A lot answers the documents that share a hash; answers return by blocks of documents.
Lots hold about LOT_ENTRIES hashes whatever the input. Anchors carry 32 bits besides their lot (a
false match costs an extension only), windows 64 bits besides their lot.

Defined results: a null or blank text has no words and keeps an empty text; rows without a key
neither lose words nor make others lose any; repeated rows (one key) do not act on each other;
documents of fewer than 13 words lose nothing; an empty table gives an empty result. New columns
come as one struct, whose name gets underscores if the input has that name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .frames import fresh, with_field
from .store import ship

WINDOW, PERIOD, COVER = 13, 7, (1, 2, 4)
ANCHOR = WINDOW - PERIOD + 1
LOT_ENTRIES = 1_000_000     # hashes that one lot gets, about
FLUSH_ENTRIES = 1_500_000   # hashes that a task gathers before it deals them out
U64 = np.uint64

_SENT = T.StructType([T.StructField("lot", T.IntegerType()), T.StructField("answer", T.BooleanType()),
                      T.StructField("keys", T.BinaryType()), T.StructField("counts", T.BinaryType()),
                      T.StructField("codes", T.BinaryType())])
_ANSWER = T.StructType([T.StructField("key", T.LongType()), T.StructField("codes", T.BinaryType())])
_SENT_ARROW = pa.schema([("lot", pa.int32()), ("answer", pa.bool_()), ("keys", pa.binary()), ("counts", pa.binary()), ("codes", pa.binary())])


def hashes_at(words: np.ndarray, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    """64-bit hashes of the windows of ``size`` words that start at ``at``."""
    factors = np.random.default_rng(31 * size + seed).integers(1, 2**63, size, dtype=np.int64).astype(U64) * U64(2) + U64(1)
    total = np.zeros(len(at), dtype=U64)
    for j in range(size):
        total += words[at + j] * factors[j]
    return W.mix(total)


def _starts(first: np.ndarray, size: int, at_least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of ``size`` words in texts of ``at_least`` words: word index, text, position in the text."""
    n = np.diff(first)
    count = np.where(n >= at_least, np.maximum(n - size + 1, 0), 0)
    text = np.repeat(np.arange(len(n)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return first[text] + place, text, place


def anchors(words: np.ndarray, first: np.ndarray, lot_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of texts that have a full window: word index, text, code (lot, then 32 bits)."""
    at, text, place = _starts(first, ANCHOR, WINDOW)
    own = np.isin(place % PERIOD, COVER)
    at, text = at[own], text[own]
    return at, text, hashes_at(words, at, ANCHOR, 1) >> U64(32 - lot_bits)


def _member(text: np.ndarray, code: np.ndarray, known_text: np.ndarray, known: np.ndarray) -> np.ndarray:
    both = lambda t, c: W.mix(c ^ W.mix(t.astype(U64) + U64(1)))
    return np.isin(both(text, code), both(known_text, known))


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1]))) if len(sorted_values) else np.zeros(0, int)
    return starts, np.diff(np.append(starts, len(sorted_values)))


def _packed(lot: int, answer: bool, keys: np.ndarray, codes: np.ndarray) -> dict:
    """A row with the (key, code) pairs: keys as differences, the number of codes of each, codes."""
    order = np.argsort(keys, kind="stable")
    starts, counts = _runs(keys[order])
    return {"lot": int(lot), "answer": answer, "keys": np.diff(keys[order][starts], prepend=0).astype("<i8").tobytes(),
            "counts": counts.astype("<u4").tobytes(), "codes": codes[order].tobytes()}


class _Sender:
    """Gathers (key, code, lot) of a task's documents and deals them out, each code once."""

    def __init__(self, lot_bits: int, wide: bool):
        self.lot_bits, self.wide, self.parts, self.size = lot_bits, wide, [], 0

    def add(self, keys: np.ndarray, codes: np.ndarray, lots: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys):
            self.parts.append((keys, codes, lots))
            self.size += len(keys)
        if self.size >= FLUSH_ENTRIES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        keys, codes, lots = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.size = [], 0
        order = np.lexsort((keys, codes, lots))
        keys, codes, lots = keys[order], codes[order], lots[order]
        head = np.concatenate(([True], (codes[1:] != codes[:-1]) | (lots[1:] != lots[:-1])))
        group = np.cumsum(head) - 1
        smallest = keys[head][group]
        later = keys != smallest
        rows = []
        known = later.copy()
        if not self.wide:  # an anchor that another document here has: the first one knows it too
            shared = np.zeros(head.sum(), bool)
            shared[group[later]] = True
            known |= head & shared[group]
        known[1:] &= (keys[1:] != keys[:-1]) | head[1:]  # repeated rows
        if known.any():
            rows.append(_packed(int(codes[0] % U64(1 << self.lot_bits)), True, keys[known], codes[known].astype("<u8")))
        sent = np.flatnonzero(head)
        starts, counts = _runs(lots[sent])
        for s, n in zip(starts, counts):
            own = sent[s:s + n]
            rows.append(_packed(lots[own[0]], False, keys[own], codes[own].astype("<u8" if self.wide else "<u4")))
        yield pa.RecordBatch.from_pylist(rows, _SENT_ARROW)


def _unpacked(row: dict, kind: str) -> tuple[np.ndarray, np.ndarray]:
    keys = np.cumsum(np.frombuffer(row["keys"], "<i8"))
    return np.repeat(keys, np.frombuffer(row["counts"], "<u4")), np.frombuffer(row["codes"], kind).astype(U64)


def _lot_answers(wide: bool, bits: int) -> Callable[[pa.Table], pa.Table]:
    """Of one lot: for anchors, every document that shares a code; for windows, every document that
    has a code which a smaller key has. The answers leave by blocks of documents."""

    def run(table: pa.Table) -> pa.Table:
        keys, codes, told = [np.zeros(0, np.int64)], [np.zeros(0, U64)], []
        lot = int(table.column("lot")[0].as_py())
        for row in table.to_pylist():
            if row["answer"]:
                told.append(_unpacked(row, "<u8"))
            else:
                k, c = _unpacked(row, "<u8" if wide else "<u4")
                keys.append(k)
                codes.append(c if wide else c | U64(lot << 32))
        k, c = np.concatenate(keys), np.concatenate(codes)
        order = np.lexsort((k, c))
        k, c = k[order], c[order]
        starts, counts = _runs(c)
        smallest = np.repeat(k[starts], counts)
        hit = k != smallest
        if not wide:
            shared = np.add.reduceat(hit, starts) > 0 if len(starts) else np.zeros(0, bool)
            hit = np.repeat(shared, counts)
        told.append((k[hit], c[hit]))
        k, c = np.concatenate([x[0] for x in told]), np.concatenate([x[1] for x in told])
        block = (W.mix(k.view(U64)) >> U64(64 - bits)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        k, c, block = k[order], c[order], block[order]
        return pa.Table.from_pylist([_packed(block[s], True, k[s:s + n], c[s:s + n].astype("<u8")) for s, n in zip(*_runs(block))], _SENT_ARROW)

    return run


def _merged(table: pa.Table) -> pa.Table:
    """Of one block of documents: a row per key with its codes as one array of unsigned 64-bit numbers."""
    parts = [_unpacked(row, "<u8") for row in table.to_pylist()]
    keys, codes = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
    order = np.argsort(keys, kind="stable")
    keys, codes = keys[order], codes[order].astype("<u8")
    starts, counts = _runs(keys)
    ends = np.concatenate(([0], np.cumsum(counts) * 8)).astype(np.int64)
    packed = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(codes.tobytes())])
    return pa.table([pa.array(keys[starts], pa.int64()), packed.cast(pa.binary())], names=_ANSWER.names)


def _known(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Texts and codes of a column of packed codes."""
    values = [x or b"" for x in column.to_pylist()]
    return np.repeat(np.arange(len(values)), [len(x) // 8 for x in values]), np.frombuffer(b"".join(values), "<u8").astype(U64)


def _exchange(sent: DataFrame, wide: bool, bits: int, key: str, into: str) -> DataFrame:
    """Answers by document: ``key`` and ``into``, its codes (as many as it sent at most)."""
    answers = sent.groupBy("lot").applyInArrow(_lot_answers(wide, bits), _SENT)
    return answers.groupBy("lot").applyInArrow(_merged, _ANSWER).select(F.col("key").alias(key), F.col("codes").alias(into))


def lots_for(df: DataFrame, text: str) -> int:
    """Bits of the number of lots: one pass that sums text lengths, nothing else."""
    size = df.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    entries = size / 6 * len(COVER) / PERIOD
    return max(4, int(np.ceil(np.log2(max(1.0, entries / LOT_ENTRIES)))))


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None,
                   into: str = "cover") -> tuple[DataFrame, str]:
    """``keep`` (default: all columns) with a struct of n_words, n_removed and kept_text (the kept
    words joined by one space); returns the frame and the struct's name. ``key`` becomes a long."""
    ship(df.sparkSession)
    keep = list(df.columns) if keep is None else keep
    name = fresh(df.columns, into)
    texts, shared, gone = (fresh([*df.columns, name], x) for x in ("cover_text", "cover_shared", "cover_gone"))
    # a key that is a long already stays as it is: then both joins below share one exchange of texts
    long_key = key if dict(df.dtypes)[key] == "bigint" else F.col(key).cast("bigint").alias(key)
    rows = df.select(*(long_key if c == key else F.col(f"`{c}`") for c in dict.fromkeys([*keep, key])),
                     F.col(text).cast("string").alias(texts))
    bits = lots_for(df, text)
    keyed = rows.filter(F.col(key).isNotNull())

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(bits, wide=False)
        for batch in batches:
            for part in W.slices(batch, texts):
                found = W.scan(part.column(texts))
                _, own, code = anchors(found.hashes(), found.first, bits)
                own, code = _distinct(own, code)
                keys = part.column(key).to_numpy(zero_copy_only=False)[own]
                yield from sender.add(keys, code, (code >> U64(32)).astype(np.int64))
        yield from sender.flush()

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(bits, wide=True)
        for batch in batches:
            for part in W.slices(batch, texts):
                found = W.scan(part.column(texts))
                hashed = found.hashes()
                at, own, code = anchors(hashed, found.first, bits)
                marked = np.zeros(len(hashed) + PERIOD + 1, dtype=np.int64)
                marked[at[_member(own, code, *_known(part.column(shared)))] + 1] = 1
                before = np.cumsum(marked)
                starts, own, _ = _starts(found.first, WINDOW, WINDOW)
                near = before[starts + PERIOD] > before[starts]  # an anchor at one of its first 7 words
                starts, own = starts[near], own[near]
                code = hashes_at(hashed, starts, WINDOW, 2)
                lot = (hashes_at(hashed, starts, WINDOW, 3) >> U64(64 - bits)).astype(np.int64)
                order = np.lexsort((code, own))
                own, code, lot = own[order], code[order], lot[order]
                once = np.concatenate(([True], (own[1:] != own[:-1]) | (code[1:] != code[:-1])))[:len(own)]
                keys = part.column(key).to_numpy(zero_copy_only=False)[own[once]]
                yield from sender.add(keys, code[once], lot[once])
        yield from sender.flush()

    result = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("kept_text", T.StringType())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, texts):
                values = part.column(texts).to_pylist()
                split = [(v or "").encode().split() for v in values]
                n_words = [len(x) for x in split]
                removed = [0] * len(split)
                hit = np.array([bool(x) for x in part.column(gone).to_pylist()], dtype=bool)
                if hit.any():
                    some = part.filter(pa.array(hit))
                    found = W.scan(some.column(texts))
                    hashed = found.hashes()
                    starts, own, _ = _starts(found.first, WINDOW, WINDOW)
                    repeat = _member(own, hashes_at(hashed, starts, WINDOW, 2), *_known(some.column(gone)))
                    going = W.covered(starts[repeat], WINDOW, len(hashed))
                    for j, i in enumerate(np.flatnonzero(hit)):
                        drop = going[found.first[j]:found.first[j + 1]]
                        removed[i] = int(drop.sum())
                        split[i] = list(compress(split[i], ~drop))
                kept = [b" ".join(x).decode() for x in split]
                struct = pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                                                    result.names)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), struct], [*keep, name])

    # a document's key, its text and the answers meet in one place: both joins use the same exchange of texts
    has_shared = _exchange(keyed.select(key, texts).mapInArrow(send_anchors, _SENT), False, bits, key, shared)
    around = keyed.join(has_shared, key).select(key, texts, shared)
    repeats = _exchange(around.mapInArrow(send_windows, _SENT), True, bits, key, gone)
    done = keyed.join(repeats, key, "left")
    without = rows.filter(F.col(key).isNull()).withColumn(gone, F.lit(None).cast(repeats.schema[gone].dataType))
    every = done.select(*rows.columns, gone).unionByName(without)
    return every.mapInArrow(remove, with_field(rows, keep, name, result)), name


def _distinct(own: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, code) pairs; ``own`` rises."""
    order = np.lexsort((code, own))
    own, code = own[order], code[order]
    once = np.concatenate(([True], (own[1:] != own[:-1]) | (code[1:] != code[:-1])))[:len(own)]
    return own[once], code[once]


def substring_dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The digest: key, n_words, n_removed, and SHA-256 of the kept text."""
    out, name = remove_repeats(df, key, text, [key])
    at = lambda c: F.col(f"`{name}`.{c}")
    return out.select(key, at("n_words").alias("n_words"), at("n_removed").alias("n_removed"),
                      F.sha2(at("kept_text"), 256).alias("kept_sha256"))
