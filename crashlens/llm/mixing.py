"""Mixing sources to target weights by hash-threshold histograms; DataFrame functions only.

Every document has a fixed 60-bit hash. A source whose target is t words of s takes each document
t div s times, and once more those documents whose hash lies below the source's threshold, so a
smaller budget's documents are a part of a larger budget's. Thresholds come from histograms: words
by source and leading hash bits, cumulated over at most 32,768 buckets; only the boundary bucket is
refined with the next bits, until it is a single hash value. Its document is taken in part. Nothing
is sorted by document, and documents are filtered by a comparison with their source's threshold.

Only (source, size, hash) rows are written and shuffled, aggregated map-side by source and bucket:
a source with a third of all rows is at most 32,768 rows per task. The table of thresholds has a
row per source; it is broadcast only up to MAX_BROADCAST rows (counted), beyond which it is joined.

Defined results: a null text has size 0 and takes 0; null is a source of its own, ordered last;
equal texts with equal ids have equal hashes, and if they meet at a threshold they share the rest
evenly; an empty table gives an empty result; if all sizes are 0, all targets are 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import fresh
from .store import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
HASH_BITS, LEVEL_BITS = 60, 15
MAX_BROADCAST = 50_000


def size_of(text: Column) -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def hash_of(key: Column, text: Column, seed: str = "mix-1") -> Column:
    """60 bits of md5 over seed, id and text: the same in every run and at every partitioning."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(key.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def sized(df: DataFrame, key: str, text: str, source: str, carry: Sequence[str] = ()) -> DataFrame:
    """``carry`` columns with size, hash, and the source as (no_source, source_text), so that null
    groups and joins like a value."""
    value = F.col(source).cast("string")
    return df.select(*carry, size_of(F.col(text)).alias("mix_size"), hash_of(F.col(key), F.col(text)).alias("mix_hash"),
                     F.when(value.isNull(), 1).otherwise(0).alias("no_source"), F.coalesce(value, F.lit("")).alias("source_text"))


SOURCE = ["no_source", "source_text"]


def targets(rows: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per source: its size and target.

    Weights repeat over the sources by code point, null last, and share all sizes. A target stops
    at ``max_repeat`` times its source's size, and what it leaves goes to the others by weight. That
    fixed point has a closed form: by rising cap per weight, sources are full up to the first one
    whose share of what is left fits. Windows run over the table of sources (a row per source).
    """
    sources = rows.groupBy(*SOURCE).agg(F.sum("mix_size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(*SOURCE)) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (place % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight.cast("bigint"))
    cap = F.lit(max_repeat) * F.col("source_size")
    rising = Window.orderBy((cap / F.col("weight")), *SOURCE)
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))).cast("double") / F.sum("weight").over(after)
    fits = share * F.col("weight") <= cap
    shared = sources.withColumns({"share": share, "rank": F.row_number().over(rising)}).withColumn("fits", fits.eqNullSafe(F.lit(True)))
    level = F.min(F.when(F.col("fits"), F.struct("rank", "share"))).over(everything)["share"]
    return (shared.withColumn("level", level)
            .withColumn("target", F.least(cap.cast("double"), F.col("level") * F.col("weight")))
            .select(*SOURCE, "source_size", "target"))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source: full_copies, the threshold hash (documents below it are taken once more, those
    at it take ``at_threshold`` words more; -1 if none)."""
    budget = F.floor(F.col("target") + 0.5).cast("bigint")
    copies = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    state = (goals.withColumn("full_copies", copies)
             .withColumn("rest", budget - F.col("full_copies") * F.col("source_size"))
             .withColumn("prefix", F.lit(0).cast("bigint")).withColumn("n_at", F.lit(0).cast("bigint")))
    for level in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        inside = (rows.join(state.filter("rest > 0").select(*SOURCE, "prefix"), SOURCE)
                  .filter(F.shiftright("mix_hash", shift + LEVEL_BITS) == F.col("prefix")) if level else rows)
        histogram = (inside.withColumn("bucket", F.shiftright("mix_hash", shift)).groupBy(*SOURCE, "bucket")
                     .agg(F.sum("mix_size").alias("words"), F.count("*").alias("n")))
        upto = F.sum("words").over(Window.partitionBy(*SOURCE).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        met = (histogram.withColumn("upto", upto).join(state.select(*SOURCE, "rest"), SOURCE)
               .filter("rest > 0 and upto >= rest").groupBy(*SOURCE)
               .agg(F.min(F.struct("bucket", "upto", "words", "n")).alias("edge")))
        state = (state.join(met, SOURCE, "left")
                 .withColumn("prefix", F.coalesce("edge.bucket", "prefix"))
                 .withColumn("rest", F.when(F.col("edge").isNotNull(), F.col("rest") - F.col("edge.upto") + F.col("edge.words")).otherwise(F.col("rest")))
                 .withColumn("n_at", F.coalesce("edge.n", "n_at")).drop("edge"))
        state = materialise(state, "mix-level")  # a row per source: each level reads it, not the levels before
    some = F.col("rest") > 0
    return state.select(*SOURCE, "source_size", "target", "full_copies", F.when(some, F.col("prefix")).otherwise(-1).alias("threshold"),
                        F.when(some, F.floor(F.col("rest") / F.col("n_at"))).otherwise(0).cast("bigint").alias("at_threshold"))


def plan(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
         weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> tuple[DataFrame, DataFrame]:
    """The (id, size, hash, source) rows of ``df``, written once, and the sources' thresholds."""
    rows = materialise(sized(df, key, text, source, [F.col(key).alias("mix_key")]), "mix-sizes")
    return rows, thresholds(rows, targets(rows, weights, max_repeat))


def apply(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows`` (with ``sized`` columns) with their source's limits and ``taken``, the words that the mix takes."""
    small = limits.count() <= MAX_BROADCAST
    joined = rows.join(F.broadcast(limits) if small else limits, SOURCE)
    more = (F.when(F.col("mix_hash") < F.col("threshold"), F.col("mix_size"))
            .when(F.col("mix_hash") == F.col("threshold"), F.least("mix_size", "at_threshold")).otherwise(F.lit(0)))
    return joined.withColumn("taken", F.col("full_copies") * F.col("mix_size") + more)


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """key, size, source_size, target and taken of every row of ``df``."""
    rows, limits = plan(df, key, text, source, weights, max_repeat)
    return apply(rows, limits).select(F.col("mix_key").alias(key), F.col("mix_size").alias("size"), "source_size", "target", "taken")


def mixed_documents(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
                    weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The mix itself: the columns of ``df``, a row for every time a document is taken. The part
    that a source takes of its last document is that document's first words, joined by a space."""
    _, limits = plan(df, key, text, source, weights, max_repeat)
    row, copy = fresh(df.columns, "mix_row"), fresh(df.columns, "mix_copy")
    whole = sized(df, key, text, source, [F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(row)])
    taken = apply(whole, limits).filter("taken > 0")
    copies = F.ceil(F.col("taken") / F.col("mix_size")).cast("int")
    each = taken.select(row, "mix_size", "taken", F.explode(F.sequence(F.lit(1), copies)).alias(copy))
    words = F.least(F.col("mix_size"), F.col("taken") - (F.col(copy) - 1) * F.col("mix_size"))
    value = F.col(f"{row}.`{text}`")
    part = F.array_join(F.slice(F.regexp_extract_all(value, F.lit(f"({WORD})")), 1, words.cast("int")), " ")
    return each.select(*(F.when(words < F.col("mix_size"), part).otherwise(value).alias(c) if c == text else F.col(f"{row}.`{c}`").alias(c)
                         for c in df.columns))
