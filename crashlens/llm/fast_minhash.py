"""Near-duplicates by fast similarity sketching, banding and exact verification.

A document's set holds its distinct shingles of k words (with fewer words, the whole sequence as
one). Its sketch has COORDINATES bins, filled in rounds: in each of the first rounds every shingle
is hashed anew into one bin with a value, the round being the leading part of the value; bins still
empty after as many rounds as there are bins get every shingle, one bin a round. A text stops when
all its bins are filled, which for large sets is the first rounds and takes n + t log t steps
instead of n * t; all coordinates are filled, whatever the set's size, and two sets agree at a
coordinate with the chance of their similarity, concentrated as for independent hashing.

BANDS bands of ROWS coordinates make buckets. A pair at the threshold 0.8 misses all buckets with
probability (1 - 0.8 ** ROWS) ** BANDS, 4.6e-7 for 48 bands of 6. Equal sets are one node, so copies
are not compared. Links are then confirmed on full sets:

1. each node is compared with the smallest node of each of its buckets;
2. components of these links are formed, by alternating star contractions;
3. around hubs whose buckets still hold several components, members outside the largest one are
   compared with all members of other components. So no pair that shares a bucket is left out, and
   a bucket whose members are linked already costs nothing. The join itself compares the sets and
   emits links only; large groups are split into parts. Two tests before that spare most sets: a
   member holds no shingle of another that is found in itself alone (exact: two members share at
   most the smaller number of shingles that each has in common with anyone there), and pairs are
   dropped if more than MAX_DIFFERENT of 256 coordinates differ in their two lowest bits (at a
   similarity of 0.8 the expected number is 38.4, and more than 73 differ with a probability of
   about 1e-8).

Defined results: a null, empty or blank text has an empty set and is linked with nothing; rows
without a key are kept, with a null component; rows that share a key count as one document in
links; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .store import materialise, ship

BANDS, ROWS = 48, 6
COORDINATES = BANDS * ROWS
PLANES, PLANE_WORDS, MAX_DIFFERENT = 2, 4, 73
MEMBERS_PER_TASK = 250     # a larger group is compared in as many parts as that makes
PERCENT = 80
U64 = np.uint64
_EMPTY = U64(0xFFFFFFFFFFFFFFFF)


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of lower-cased (A-Z) texts, as 64-bit hashes in order of their text, and
    n + 1 offsets."""
    found = W.scan(texts, lower=True)
    hashed, first, n = found.hashes(), found.first, found.n_words
    at, key = W.windows(hashed, first, size)
    text = np.searchsorted(first, at, side="right") - 1
    keys, owners = [key], [text]
    for short in range(1, size):
        own = np.flatnonzero(n == short)
        if len(own):
            at, key = W.windows(hashed[_ranges(first[own], short)], np.arange(len(own) + 1) * short, short)
            keys.append(key)
            owners.append(own)
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    once = np.concatenate(([True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])))[:len(key)]
    key, owner = key[once], owner[once]
    return key, np.searchsorted(owner, np.arange(len(n) + 1))


def _ranges(starts: np.ndarray, size: int) -> np.ndarray:
    return (starts[:, None] + np.arange(size)).ravel()


def sketches(elements: np.ndarray, first: np.ndarray, bins: int = COORDINATES, seed: int = 1) -> np.ndarray:
    """Sketch of each set; a row of ``bins`` values (all _EMPTY for an empty set)."""
    n = len(first) - 1
    out = np.full((n, bins), _EMPTY, dtype=U64)
    flat = out.reshape(-1)
    left = np.flatnonzero(np.diff(first) > 0)
    size = np.diff(first)
    own = np.arange(len(elements))
    owner = np.repeat(np.arange(n), size)
    salts = np.random.default_rng(seed).integers(1, 2**63, 2 * bins, dtype=np.int64).astype(U64)
    for step in range(2 * bins):
        if not len(left):
            break
        h = W.mix(elements[own] ^ salts[step])
        spot = ((h >> U64(32)) * U64(bins)) >> U64(32) if step < bins else np.full(len(h), step - bins, dtype=U64)
        value = (U64(step) << U64(44)) | (h & U64((1 << 44) - 1))
        np.minimum.at(flat, owner * bins + spot.astype(np.int64), value)
        open_ = (out[left] == _EMPTY).any(axis=1)
        if not open_.all():
            left = left[open_]
            still = np.zeros(n, bool)
            still[left] = True
            stay = still[owner]
            own, owner = own[stay], owner[stay]
    return out


def band_keys(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key of each band."""
    bands = sketch.shape[1] // rows
    factors = np.random.default_rng(5).integers(1, 2**63, rows, dtype=np.int64).astype(U64) * U64(2) + U64(1)
    grouped = sketch[:, :bands * rows].reshape(len(sketch), bands, rows)
    total = (grouped * factors).sum(axis=2, dtype=U64)
    return W.mix(total ^ W.mix(np.arange(1, bands + 1).astype(U64)))


def coordinate_bits(sketch: np.ndarray) -> np.ndarray:
    """The lowest PLANES bits of the first 64 * PLANE_WORDS coordinates, as 64-bit words plane by plane."""
    words = []
    for plane in range(PLANES):
        bit = (sketch[:, :64 * PLANE_WORDS] >> U64(plane) & U64(1)).reshape(len(sketch), PLANE_WORDS, 64)
        words.append((bit << np.arange(64, dtype=U64)).sum(axis=2, dtype=U64))
    return np.concatenate(words, axis=1).view(np.int64)


_SIGNATURE = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_a", T.LongType()),
    T.StructField("set_b", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())),
    *(T.StructField(f"bits_{i}", T.LongType()) for i in range(PLANES * PLANE_WORDS))])
_SET = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("items", T.ArrayType(T.LongType()))])


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def signatures(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Per row: key, size of the set, 128 bits that identify the set, and band keys. No shuffle."""
    ship(df.sparkSession)
    source = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                items, first = shingles(part.column("text"), size)
                n = np.diff(first)
                sketch = sketches(items, first)
                bits = coordinate_bits(sketch)
                bands = band_keys(sketch)[n > 0]
                ends = np.concatenate(([0], np.cumsum(np.where(n > 0, BANDS, 0))))
                sums = [np.concatenate(([U64(0)], np.cumsum(W.mix(items ^ U64(s)), dtype=U64))) for s in (0xA5A5A5A5, 0x5A5A5A5A5A)]
                a, b = ((s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(n, pa.int64()), pa.array(a), pa.array(b), _lists(bands.reshape(-1), ends),
                     *(pa.array(bits[:, i]) for i in range(PLANES * PLANE_WORDS))], _SIGNATURE.names)

    return source.mapInArrow(run, _SIGNATURE)


def sets_of(df: DataFrame, key: str, text: str, size: int, wanted: DataFrame) -> DataFrame:
    """Full sets of the documents whose keys are in ``wanted`` (column key)."""
    source = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text")).join(wanted, "key", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                items, first = shingles(part.column("text"), size)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(np.diff(first), pa.int64()), _lists(items, first)], _SET.names)

    return source.mapInArrow(run, _SET)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union, on full sets."""
    left = sets.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("items").alias("items_b"))
    common = F.size(F.array_intersect("items_a", "items_b"))
    return (pairs.join(left, "a").join(right, "b").filter(linked(F.col("n_a"), F.col("n_b"), F.least("n_a", "n_b"), percent))
            .filter(linked(F.col("n_a"), F.col("n_b"), common, percent)).select("a", "b").distinct())


def linked(n_a: Column, n_b: Column, common: Column, percent: int) -> Column:
    """Whether 100 * intersection >= percent * union."""
    return 100 * common >= percent * (n_a + n_b - common)


def components(links: DataFrame, name: str = "stars") -> DataFrame:
    """(key, root) of every key in ``links`` (columns a, b) that is not its component's smallest:
    large-star and small-star contractions in turn, each written out, until nothing changes."""
    edges = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("a").alias("key"), F.col("b").alias("root"))
        before = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        large = both.join(near, "a").filter("b > a").select(F.col("b").alias("a"), F.col("root").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("root"))
        joined = large.join(least, "a")
        small = joined.filter("b != root").select(F.col("b").alias("a"), F.col("root").alias("b")).unionByName(least.select("a", F.col("root").alias("b")))
        edges = materialise(small.filter("a != b").distinct(), name)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = PERCENT) -> DataFrame:
    """Per row: key, n_shingles, component_id (the smallest key reachable by links), kept."""
    signed = materialise(signatures(df, key, text, size), "signatures")
    full = signed.filter("n_shingles > 0 and key is not null")
    nodes = materialise(full.groupBy("set_a", "set_b").agg(F.min("key").alias("node")), "nodes")
    of_nodes = full.join(nodes.select(F.col("node").alias("key"), "set_a", "set_b"), ["key", "set_a", "set_b"], "left_semi")
    rows = of_nodes.select(F.explode("bands").alias("band"), F.col("key").alias("node"))
    buckets = rows.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub != last")
    members = materialise(rows.join(buckets.select("band", "hub"), "band"), "members")

    wanted = members.select(F.col("node").alias("key")).distinct()
    sets = materialise(sets_of(df, key, text, size, wanted), "sets")
    pairs = members.filter("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    links = materialise(confirmed(pairs, sets, percent), "links")
    stars = components(links)

    # around each hub: do its buckets still hold several components, and which is the largest?
    around = (members.select("hub", "node").distinct().join(stars.select(F.col("key").alias("node"), "root"), "node", "left")
              .withColumn("root", F.coalesce("root", "node")))
    several = (around.groupBy("hub", "root").agg(F.count("*").alias("n")).groupBy("hub")
               .agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("roots"),
                    F.ceil(F.sum("n") / MEMBERS_PER_TASK).cast("int").alias("parts")).filter("roots > 1"))
    around = materialise(around.join(several.select("hub", "main", "parts"), "hub"), "around")
    # shingles that a member shares with no other member around the hub
    alone = (around.join(sets.select(F.col("key").alias("node"), "items"), "node").select("hub", "node", F.explode("items").alias("item"))
             .groupBy("hub", "item").agg(F.count("*").alias("k"), F.max("node").alias("node")).filter("k = 1")
             .groupBy("hub", "node").agg(F.count("*").alias("alone")))
    bits = [f"bits_{i}" for i in range(PLANES * PLANE_WORDS)]
    hubs = around.groupBy("node").agg(F.collect_set("hub").alias("hubs"))  # BANDS at most
    known = materialise(around.join(alone, ["hub", "node"], "left").join(hubs, "node")
                        .join(of_nodes.select(F.col("key").alias("node"), F.col("n_shingles").alias("n"), *bits), "node")
                        .withColumn("shared", F.col("n") - F.coalesce("alone", F.lit(0))).filter(100 * F.col("shared") >= percent * F.col("n"))
                        .join(sets.select(F.col("key").alias("node"), "items"), "node"), "known")
    facts = ["root", "n", "shared", "items", "hubs", *bits]
    minor = (known.filter("root != main").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
             .select("hub", "part", F.col("node").alias("a"), *(F.col(x).alias(f"{x}_a") for x in facts)))
    other = (known.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("hub", "part", "main", F.col("node").alias("b"), *(F.col(x).alias(f"{x}_b") for x in facts)))
    changed = [F.col(f"{x}_a").bitwiseXOR(F.col(f"{x}_b")) for x in bits]
    differ = sum((F.bit_count(reduce(Column.bitwiseOR, changed[i::PLANE_WORDS])) for i in range(PLANE_WORDS)), F.lit(0))
    n_a, n_b = F.col("n_a"), F.col("n_b")
    possible = (F.expr("root_a != root_b and (root_b = main or a < b)") & (differ <= MAX_DIFFERENT)
                & (F.array_min(F.array_intersect("hubs_a", "hubs_b")) == F.col("hub"))  # a pair meets at one hub
                & linked(n_a, n_b, F.least("shared_a", "shared_b"), percent))
    same = F.when(possible, linked(n_a, n_b, F.size(F.array_intersect("items_a", "items_b")), percent)).otherwise(F.lit(False))
    # by number: the rows are few and the work between them is not, so they must not be put together by size
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    minor, other = (x.repartition(tasks, "hub", "part") for x in (minor, other))
    more = materialise(minor.join(other, ["hub", "part"]).filter(same).select("a", "b").distinct(), "more-links")
    if more.limit(1).count():
        stars = components(stars.select(F.col("key").alias("a"), F.col("root").alias("b")).unionByName(more), "more-stars")

    rooted = (signed.select("key", "n_shingles", "set_a", "set_b").join(nodes, ["set_a", "set_b"], "left")
              .join(stars.select(F.col("key").alias("node"), "root"), "node", "left"))
    component = F.when(F.col("n_shingles") == 0, F.col("key")).otherwise(F.coalesce("root", "node", "key"))
    component = F.when(F.col("key").isNotNull(), component)
    return rooted.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"),
                         F.coalesce(component == F.col("key"), F.lit(True)).alias("kept"))
