"""Quality rules as a ledger of failure bits.

Every text is measured once, every rule is evaluated once on the measurements, and the outcome is
stored as one bit per rule beside the measurements. Policies are versioned sets of rules, applied
to the stored bits; ablations (what a rule rejects alone, what a policy without it would keep) come
from bitwise aggregation of the ledger, without reading a text again.

Defined results: a null or blank text has no words and fails ``few_words``; repeated rows each get
their own, equal ledger; an empty table gives an empty ledger. The ledger is one struct column, and
its name gets underscores if the input has that name, so no input column is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .frames import fresh, with_field
from .store import ship

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SYMBOLS = "#*$%&|<>"
WINDOW = 5

# bit -> (rule, condition under which it fails); conditions read the measurements only
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 12 * n_words"),
    ("one_line", "n_lines < 2"),
    ("few_windows_free", "100 * n_repeat_words > 50 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]
# version -> rules whose failure rejects a document
POLICIES = {
    "base": BASE,
    "v1": BASE | BIT["symbols"] | BIT["duplicate_lines"] | BIT["short_words"] | BIT["long_words"],
    "lenient": BIT["few_words"] | BIT["few_windows_free"] | BIT["symbols"],
}
CURRENT = "v1"

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS.encode())] = True


def measurements(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of each text (see the names in MEASURES):

    code points in words, characters of SYMBOLS, \\n-split lines with a word that equal an earlier
    line, words in 5-word windows found twice or more in the text, and lines with a word.
    """
    found = W.scan(texts)
    data, at = found.data, found.text_at
    in_word = np.ones(len(data), bool)
    in_word[(data == 0x20) | ((data >= 0x09) & (data <= 0x0D))] = False
    hashes = found.hashes()
    begins, keys = W.windows(hashes, found.first, WINDOW)
    _, other = W.repeated(np.searchsorted(found.first, begins, side="right") - 1, keys)
    repeats = W.covered(begins[other], WINDOW, len(hashes))

    breaks = np.flatnonzero(data == 0x0A)
    full = np.flatnonzero(at[1:] > at[:-1])
    line_start = np.union1d(at[:-1][full], breaks + 1)
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data))
    line_text = np.searchsorted(at, line_start, side="right") - 1
    line_end = line_end - ((line_end > line_start) & (data[line_end - 1] == 0x0A))
    has_word = np.searchsorted(found.start, line_end) > np.searchsorted(found.start, line_start)
    line_start, line_end, line_text = line_start[has_word], line_end[has_word], line_text[has_word]
    earlier, _ = W.repeated(line_text, W.span_hashes(data, line_start, line_end))
    n = len(at) - 1
    return {
        "n_words": found.n_words.astype(np.int64),
        "word_chars": W.per_text(in_word & ((data & 0xC0) != 0x80), at),
        "n_symbols": W.per_text(_SYMBOL[data], at),
        "n_dup_lines": np.bincount(line_text[earlier], minlength=n).astype(np.int64),
        "n_repeat_words": W.per_text(repeats, found.first),
        "n_lines": np.bincount(line_text, minlength=n).astype(np.int64),
    }


def ledger(df: DataFrame, text: str = "text", keep: list[str] | None = None, into: str = "ledger") -> tuple[DataFrame, str]:
    """``keep`` (default: all columns) and a struct with the measurements and ``bits``; returns the
    frame and the struct's name. One pass over the texts, no shuffle."""
    ship(df.sparkSession)
    keep = list(df.columns) if keep is None else keep
    name = fresh(df.columns, into)
    raw = T.StructType([T.StructField(m, T.LongType(), False) for m in MEASURES])
    texts = fresh([*df.columns, name], "text_measured")
    source = df.select(*keep, F.col(text).cast("string").alias(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, texts):
                m = measurements(part.column(texts))
                struct = pa.StructArray.from_arrays([pa.array(m[x], pa.int64()) for x in MEASURES], list(MEASURES))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), struct], [*keep, name])

    out = source.mapInArrow(run, with_field(source, keep, name, raw))
    parts = [F.col(f"`{name}`.{m}").alias(m) for m in MEASURES]
    fails = bits_of(name)
    return out.withColumn(name, F.struct(*parts, fails.alias("bits"))), name


def bits_of(struct: str) -> Column:
    """As :func:`bits`, from a struct of measurements."""
    out = F.lit(0).cast("bigint")
    for i, (_, fails) in enumerate(RULES):
        for m in MEASURES:
            fails = _qualified(fails, m, f"`{struct}`.{m}")
        out = out.bitwiseOR(F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return out


def _qualified(text: str, name: str, path: str) -> str:
    return " ".join(path if word == name else word for word in text.split(" "))


def passes(struct: str, policy: str = CURRENT) -> Column:
    """Whether a row's stored bits hold no failure that the policy counts."""
    return F.col(f"`{struct}`.bits").bitwiseAND(F.lit(POLICIES[policy]).cast("bigint")) == 0


def ablations(df: DataFrame, struct: str, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents failing it, failing it alone among the policy's rules, and
    kept by the policy without it. One aggregation of bits with map-side sums; one row per rule."""
    mask = POLICIES[policy]
    got = F.col(f"`{struct}`.bits").bitwiseAND(F.lit(mask).cast("bigint"))
    rules = [(name, 1 << i) for i, (name, _) in enumerate(RULES) if mask >> i & 1]
    sums = [F.sum((got == 0).cast("bigint")).alias("kept")]
    for name, bit in rules:
        sums += [F.sum((got.bitwiseAND(F.lit(bit).cast("bigint")) != 0).cast("bigint")).alias(f"{name}_failed"),
                 F.sum((got == bit).cast("bigint")).alias(f"{name}_alone")]
    rows = [F.struct(F.lit(name).alias("rule"), F.coalesce(F.col(f"{name}_failed"), F.lit(0)).alias("n_failed"),
                     F.coalesce(F.col(f"{name}_alone"), F.lit(0)).alias("n_only_this"),
                     F.coalesce(F.col("kept") + F.col(f"{name}_alone"), F.lit(0)).alias("n_kept_without")) for name, _ in rules]
    return df.agg(*sums).select(F.inline(F.array(*rows)))


def quality(df: DataFrame, key: str = "doc_id", text: str = "text", policy: str = CURRENT) -> DataFrame:
    """The digest of the ledger: key, base measurements, whether the base rules fail, the verdict,
    and the stored bits."""
    out, name = ledger(df, text, [key])
    at = lambda c: F.col(f"`{name}`.{c}")
    return out.select(key, *(at(m).alias(m) for m in MEASURES[:5]),
                      (at("bits").bitwiseAND(F.lit(BASE).cast("bigint")) != 0).alias("base_failed"),
                      passes(name, policy).alias("kept"), at("bits").alias("fail_bits"))
