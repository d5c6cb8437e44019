"""Approximate nearest neighbours by inner product: cross-polytope hashing with multiprobe.

A vector is rotated by signs and fast Hadamard transforms (three rounds), and its bucket is the
signed axis nearest to the result; FUNCTIONS such hashes are combined once a single one would leave
more than BUCKET_ROWS vectors in a bucket. Each table has its own rotations. A query probes a
table's buckets in order of its own coordinates on their axes, and every vector in a probed bucket
is scored with the exact inner product in double precision.

For vectors of unequal length, hashing uses the usual reduction: within a band of lengths (a factor
of two) vectors are divided by the band's largest length and get one more coordinate that makes
them unit vectors; a query probes each band.

The number of probes is fitted, by strata: queries fall into strata by how many vectors lie in their nearest buckets
(powers of four), so a query far from all clusters is not judged by those inside one. Of each stratum a bounded
sample of SAMPLE_QUERIES queries is compared with all vectors in blocks, and the smallest number of probes is taken with
which the tables hold RECALL of the sample's true neighbours. That number is a least one: where buckets are
filled unevenly a query goes on probing each table until its buckets there hold k + 1 entries, and half as many as those
of the stratum's median query, or are all of the table's. Every vector is indexed, and no bucket is capped:
a large one is spread over several tasks. Equal vectors are one entry, with the smallest k + 1 of
their ids.

Defined results: vectors that are null, empty, zero, or hold a null or a non-finite component take
no part, neither do rows without an id; vectors of different dimension are not compared; an id's
repeated equal rows count once; a query never finds its own id; ties go to the smaller id; a query
finds k neighbours, or all candidates if there are fewer; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import materialise, ship

TABLES = 4
BUCKET_ROWS = 16_384
TASK_ROWS = 8_192          # vectors that one task scores at once
TASK_QUERIES = 8_192       # queries that one task scores at once
MERGE_ROWS = 5_000         # rows of (query, task) that are merged at once
SAMPLE_QUERIES = 64
RECALL = 0.96
ROUNDS = 3
PROBED_CELLS = 1 << 22     # (query, bucket) pairs that are ranked at once


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, orthonormal; the width is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def rotated(x: np.ndarray, table: int, function: int) -> np.ndarray:
    signs = np.random.default_rng([11, table, function]).choice([-1.0, 1.0], (ROUNDS, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


class Index:
    """Shape of the index of one dimension: bands of lengths, width and number of hash functions."""

    def __init__(self, dim: int, bands: dict[int, tuple[float, float]], rows: int):
        self.dim, self.bands = dim, {b: top for b, (top, _) in bands.items()}
        self.lift = any(low < top * (1 - 1e-6) for top, low in bands.values())
        self.width = 1 << int(np.ceil(np.log2(max(2, dim + self.lift))))
        self.functions = 1 if rows <= BUCKET_ROWS * 2 * self.width else 2
        self.buckets = (2 * self.width) ** self.functions

    def _unit(self, x: np.ndarray, tops: np.ndarray | None) -> np.ndarray:
        out = np.zeros((len(x), self.width))
        out[:, :self.dim] = x / (np.linalg.norm(x, axis=1) if tops is None else tops)[:, None]
        if tops is not None and self.lift:
            out[:, self.dim] = np.sqrt(np.maximum(0, 1 - (out[:, :self.dim] ** 2).sum(axis=1)))
        return out

    def buckets_of(self, x: np.ndarray, tops: np.ndarray) -> np.ndarray:
        """Bucket of each vector in each table, (n, TABLES)."""
        unit, out = self._unit(x, tops), np.zeros((len(x), TABLES), dtype=np.int64)
        for t in range(TABLES):
            for f in range(self.functions):
                r = rotated(unit, t, f)
                axis = np.abs(r).argmax(axis=1)
                sign = np.take_along_axis(r, axis[:, None], 1)[:, 0] < 0
                out[:, t] = out[:, t] * 2 * self.width + axis + self.width * sign
        return out

    def probes_of(self, q: np.ndarray, table: int, count: int) -> np.ndarray:
        """The first ``count`` buckets of a table for each query, nearest axes first, (n, count)."""
        unit, score = self._unit(q, None), np.zeros((len(q), 1))
        for f in range(self.functions):
            r = rotated(unit, table, f)
            score = (score[:, :, None] + np.concatenate((r, -r), axis=1)[:, None, :]).reshape(len(q), -1)
        return np.argsort(-score, axis=1, kind="stable")[:, :count]

    def probed(self, q: np.ndarray, table: int, held: np.ndarray, least: np.ndarray, need: np.ndarray) -> Iterator[np.ndarray]:
        """Each query's buckets of a table, nearest axes first: ``least`` of them, and as many as hold ``need`` entries."""
        step = max(1, PROBED_CELLS // self.buckets)
        for i in range(0, len(q), step):
            order = self.probes_of(q[i:i + step], table, self.buckets)
            counts = np.maximum(least[i:i + step], (np.cumsum(held[order], axis=1) < need[i:i + step, None]).sum(axis=1) + 1)
            yield from (own[:n] for own, n in zip(order, counts.tolist()))

    def strata(self, q: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Stratum of each query: the power of four of the entries in its nearest bucket of every table."""
        step, out = max(1, PROBED_CELLS // self.buckets), np.zeros(len(q), np.int64)
        for i in range(0, len(q), step):
            load = sum(held[t][self.probes_of(q[i:i + step], t, 1)[:, 0]] for t in range(TABLES))
            out[i:i + step] = np.log2(1 + load) // 2
        return out


def _vectors(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _best(query: np.ndarray, key: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of each query's k best distinct keys (score falling, key rising)."""
    order = np.lexsort((key, -score, query))
    q, c = query[order], key[order]
    pair = np.lexsort((np.arange(len(q)), c, q))
    first = np.zeros(len(q), bool)
    first[pair] = np.concatenate(([True], (q[pair][1:] != q[pair][:-1]) | (c[pair][1:] != c[pair][:-1])))[:len(q)]
    order, q = order[first], q[first]
    starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))[:len(q)])
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return order[rank < k]


def _scored(qk: np.ndarray, q: np.ndarray, ck: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query by exact inner product, as flat arrays."""
    out = []
    for i in range(0, len(q), 512):
        s = q[i:i + 512] @ c.T
        if s.shape[1] > 2 * k:
            cut = -np.partition(-s, k - 1, axis=1)[:, k - 1] - 1e-9
            a, b = np.nonzero(s >= cut[:, None])  # ties and rounding stay in
        else:
            a, b = (x.ravel() for x in np.indices(s.shape))
        exact = (q[i:i + 512][a] * c[b]).sum(axis=1)
        own = _best(a, ck[b], exact, k)
        out.append((qk[i:i + 512][a[own]], ck[b[own]], exact[own]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


_FOUND = T.StructType([T.StructField("query", T.LongType()), T.StructField("key", T.LongType()), T.StructField("score", T.DoubleType())])


def valid(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Distinct (key, v, dim, norm, h1, h2) of rows that take part; h1 and h2 identify the vector."""
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("v")).filter("key is not null and size(v) > 0")
    good = (F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    named = (rows.filter(good).withColumns({"dim": F.size("v"), "norm": norm, "h1": F.xxhash64("v"), "h2": F.xxhash64(F.reverse("v"))})
             .filter((F.col("norm") > 0) & (F.col("norm") < float("inf"))))
    return named.groupBy("h1", "h2", "key").agg(*(F.first(c).alias(c) for c in ("v", "dim", "norm")))


def search(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, recall: float = RECALL) -> DataFrame:
    """query_id, rank, the neighbour's key and score for every row with ``is_query`` (over the column ``key``)."""
    spark = df.sparkSession
    ship(spark)
    rows = materialise(valid(df, key, vector), "vectors")
    # the smallest k + 1 ids of equal vectors; the rank limit is applied before the shuffle too
    same = Window.partitionBy("h1", "h2").orderBy("key")
    ids = materialise(rows.withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1), "vector-ids")
    entries = ids.filter("n = 1").select("h1", "h2", "key", "v", "dim", F.floor(F.log2("norm") + 0.5).cast("int").alias("band"), "norm")
    queries = rows.withColumn(key, F.col("key")).filter(is_query).select("h1", "h2", F.col("key").alias("query_id"))
    asked = entries.join(queries.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")

    # bounded: a row per dimension and band of lengths
    shapes = defaultdict(dict)
    n_rows: dict[int, int] = defaultdict(int)
    for r in entries.groupBy("dim", "band").agg(F.max("norm").alias("top"), F.min("norm").alias("low"), F.count("*").alias("n")).collect():
        shapes[r.dim][r.band] = (r.top, r.low)
        n_rows[r.dim] += r.n
    indexes = {d: Index(d, bands, n_rows[d]) for d, bands in shapes.items()}

    def by_dim(batch: pa.RecordBatch) -> Iterator[tuple[Index, pa.RecordBatch]]:
        dims = batch.column("dim").to_numpy()
        for d in np.unique(dims):
            yield indexes[int(d)], batch.filter(pa.array(dims == d))

    def buckets(index: Index, part: pa.RecordBatch) -> np.ndarray:
        """Bucket codes, unique over dimensions, bands and tables."""
        band = part.column("band").to_numpy()
        tops = np.array([index.bands[int(b)] for b in band])
        return index.buckets_of(_vectors(part.column("v")), tops)

    def code(dim: int, band: int, table: int, bucket: np.ndarray) -> np.ndarray:
        return ((dim * 4096 + int(band) + 2048) * TABLES + table) * (1 << 34) + bucket

    bucket_schema = T.StructType([T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])

    def count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for index, part in by_dim(batch):
                own, bands = buckets(index, part), part.column("band").to_numpy()
                codes = np.concatenate([code(index.dim, b, t, own[bands == b, t]) for b in map(int, np.unique(bands)) for t in range(TABLES)])
                values, n = np.unique(codes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], bucket_schema.names)

    # bounded: a row per bucket, (2 * width) ** functions of them in a table
    sizes = entries.select("dim", "band", "v").mapInArrow(count_buckets, bucket_schema).groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    # entries in each bucket of each table, all bands together
    held = {d: np.zeros((TABLES, index.buckets), dtype=np.int64) for d, index in indexes.items()}
    for r in sizes:
        place_of, bucket = divmod(r.code, 1 << 34)
        held[place_of // TABLES // 4096][place_of % TABLES, bucket] += r.n
    fitted = _fit(entries, asked, indexes, held, k, recall)
    reach = max((sum(mean * n for _, _, mean, n in own.values()) / sum(n for *_, n in own.values()) for own in fitted.values() if own), default=1)

    # buckets to tasks: small ones together, large ones over several
    tasks_of: dict[int, range] = {}
    task, room = 0, TASK_ROWS
    for r in sizes:
        if r.n > room and room < TASK_ROWS:
            task, room = task + 1, TASK_ROWS
        parts = -(-r.n // TASK_ROWS)
        tasks_of[r.code] = range(task, task + parts)
        if parts > 1:
            task, room = task + parts, TASK_ROWS
        else:
            room -= r.n
    n_tasks = task + 1
    per_task = asked.count() * min(1.0, reach * TABLES / n_tasks)
    lots = max(1, int(np.ceil(per_task / TASK_QUERIES)))

    data_schema = T.StructType([T.StructField("task", T.IntegerType()), T.StructField("code", T.LongType()), T.StructField("key", T.LongType()),
                                T.StructField("v", T.ArrayType(T.DoubleType()))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for index, part in by_dim(batch):
                own, bands = buckets(index, part), part.column("band").to_numpy()
                keys = part.column("key").to_numpy()
                for t in range(TABLES):
                    codes = np.array([code(index.dim, int(b), t, x) for b, x in zip(bands, own[:, t])], dtype=np.int64)
                    task_ids = [tasks_of[c][hash(int(key)) % len(tasks_of[c])] for c, key in zip(codes.tolist(), keys)]
                    for lot in range(lots):
                        yield pa.RecordBatch.from_arrays([pa.array([x * lots + lot for x in task_ids], pa.int32()), pa.array(codes),
                                                          part.column("key"), part.column("v")], data_schema.names)

    probe_schema = T.StructType([T.StructField("task", T.IntegerType()), T.StructField("key", T.LongType()),
                                 T.StructField("codes", T.ArrayType(T.LongType())), T.StructField("v", T.ArrayType(T.DoubleType()))])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for index, part in by_dim(batch):
                x, keys = _vectors(part.column("v")), part.column("key").to_pylist()
                per = [fitted[index.dim][c] for c in index.strata(x, held[index.dim]).tolist()]
                least, need = (np.array([p[i] for p in per], np.int64) for i in (0, 1))
                wanted = [defaultdict(list) for _ in keys]
                for t in range(TABLES):
                    for i, own in enumerate(index.probed(x, t, held[index.dim][t], least, need)):
                        for b in index.bands:
                            for c in code(index.dim, b, t, own).tolist():
                                for n in tasks_of.get(c, ()):
                                    wanted[i][n].append(c)
                row, task_ids, codes = [], [], []
                for i, own in enumerate(wanted):
                    for n, cs in own.items():
                        row.append(i), task_ids.append(n * lots + hash(keys[i]) % lots), codes.append(cs)
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(task_ids, pa.int32()), part.column("key").take(at), pa.array(codes, pa.list_(pa.int64())),
                                                  part.column("v").take(at)], probe_schema.names)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            codes, keys, vectors = left.column("code").to_numpy(), left.column("key").to_numpy(), _vectors_by(left.column("v"))
            asking, asked_keys = _vectors_by(right.column("v")), right.column("key").to_numpy()
            lists = right.column("codes").combine_chunks()
            q_codes = lists.flatten().to_numpy()
            q_rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            order = np.argsort(q_codes, kind="stable")
            q_codes, q_rows = q_codes[order], q_rows[order]
            for c in np.unique(codes):
                own = q_rows[np.searchsorted(q_codes, c):np.searchsorted(q_codes, c, side="right")]
                if len(own):
                    there = np.flatnonzero(codes == c)
                    out.append(_scored(asked_keys[own], np.stack([asking[i] for i in own]), keys[there], np.stack([vectors[i] for i in there]), k + 1))
        q, c, s = (np.concatenate(x) for x in zip(*out))
        best = _best(q, c, s, k + 1)
        q, c, s = q[best], c[best], s[best]
        starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))[:len(q)])
        at = pa.array(np.append(starts, len(q)), pa.int32())
        return pa.table([pa.array(q[starts] % blocks), pa.array(q[starts]), pa.ListArray.from_arrays(at, pa.array(c)), pa.ListArray.from_arrays(at, pa.array(s))],
                        names=part_schema.names)

    def merge(table: pa.Table) -> pa.Table:
        lists = table.column("keys").combine_chunks()
        q = np.repeat(table.column("query").to_numpy(), np.diff(lists.offsets.to_numpy()))
        c, s = lists.flatten().to_numpy(), table.column("scores").combine_chunks().flatten().to_numpy()
        best = _best(q, c, s, k + 1)
        return pa.table([pa.array(q[best]), pa.array(c[best]), pa.array(s[best])], names=_FOUND.names)

    # a task sends one row per query; blocks of queries, as many as keep a block small, merge them
    blocks = max(1, int(asked.count() * min(n_tasks, reach * TABLES) / MERGE_ROWS))
    part_schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("query", T.LongType()),
                                T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("scores", T.ArrayType(T.DoubleType()))])
    data = entries.select("key", "dim", "band", "v").mapInArrow(place, data_schema).groupBy("task")
    asks = asked.select("key", "dim", "v").mapInArrow(probe, probe_schema).groupBy("task")
    found = data.cogroup(asks).applyInArrow(score, part_schema).groupBy("block").applyInArrow(merge, _FOUND)

    # entries back to ids, then each query's own id goes
    first = ids.filter("n = 1").select("h1", "h2", F.col("key").alias("entry"))
    all_ids = ids.select("h1", "h2", "key").join(first, ["h1", "h2"]).select("entry", F.col("key").alias("id"))
    listed = (found.withColumnRenamed("key", "entry").join(all_ids, "entry")
              .withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).filter(F.col("n") <= k + 1))
    who = queries.join(first, ["h1", "h2"]).select("query_id", F.col("entry").alias("query"))
    ranked = (who.join(listed, "query").filter("id != query_id")
              .withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("n"))).filter(F.col("rank") <= k))
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")


def _vectors_by(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Vectors of a column whose lists may differ in length."""
    lists = column.combine_chunks()
    flat, at = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def _fit(entries: DataFrame, asked: DataFrame, indexes: dict[int, Index], held: dict[int, np.ndarray], k: int,
         recall: float) -> dict[int, dict[int, tuple[int, int, float, int]]]:
    """For each dimension and stratum of queries, the probes per table with which ``recall`` of a sample's true neighbours
    are found, the entries that a query's buckets of a table have to hold, the sample's mean probes with
    both, and the stratum's queries.

    The samples (SAMPLE_QUERIES queries of a stratum, by a hash of their ids; there are at most some 20 strata)
    are scored against every entry in blocks; only each block's best rows leave a task.
    """
    def stratify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                level = pa.array(indexes[d].strata(_vectors(part.column("v")), held[d]))
                yield pa.RecordBatch.from_arrays([part.column("dim"), level, part.column("key"), part.column("v")], ["dim", "stratum", "key", "v"])

    levels = asked.select("dim", "key", "v").mapInArrow(stratify, "dim int, stratum bigint, key bigint, v array<double>")
    sizes = {(r.dim, r.stratum): r.n for r in levels.groupBy("dim", "stratum").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_hash = Window.partitionBy("dim", "stratum").orderBy(F.xxhash64("key"), "key")
    samples = levels.withColumn("place", F.row_number().over(by_hash)).filter(F.col("place") <= SAMPLE_QUERIES).collect()
    out: dict[int, dict[int, tuple[int, int, float, int]]] = {d: {} for d in indexes}
    for d, index in indexes.items():
        sample = [r for r in samples if r.dim == d]
        if not sample:
            continue
        keys, x, stratum = np.array([r.key for r in sample]), np.array([r.v for r in sample]), np.array([r.stratum for r in sample])

        def exact(batches: Iterator[pa.RecordBatch], keys=keys, x=x) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q, c, s = _scored(keys, x, batch.column("key").to_numpy(), _vectors(batch.column("v")), k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(c), pa.array(s)], _FOUND.names)

        best = Window.partitionBy("query").orderBy(F.desc("score"), "key")
        near = (entries.filter(F.col("dim") == d).select("key", "v").mapInArrow(exact, _FOUND).filter("query != key")
                .withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k))
        pairs = near.join(entries.select("key", "band", "v"), "key").select("query", "band", "v").collect()
        place = {int(key): i for i, key in enumerate(keys)}
        asking = np.array([place[p.query] for p in pairs], np.int64)
        ranks = np.zeros(0, np.int64)  # per pair, the probe that finds it
        if pairs:
            there = index.buckets_of(np.array([p.v for p in pairs]), np.array([index.bands[p.band] for p in pairs]))
            ranks = np.full(len(pairs), index.buckets)
            for t in range(TABLES):
                order = np.argsort(index.probes_of(x, t, index.buckets), axis=1)
                ranks = np.minimum(ranks, order[asking, there[:, t]])
        for c in np.unique(stratum).tolist():
            own, mine = x[stratum == c], np.sort(ranks[stratum[asking] == c]) if pairs else ranks
            least = int(min(index.buckets, mine[int(np.ceil(recall * len(mine))) - 1] + 1)) if len(mine) else 1
            usual = np.median([held[d][t][index.probes_of(own, t, least)].sum(axis=1) for t in range(TABLES)])
            need = max(k + 1, int(usual) // 2)
            every = np.full(len(own), least), np.full(len(own), need)
            mean = float(np.mean([len(b) for t in range(TABLES) for b in index.probed(own, t, held[d][t], *every)]))
            out[d][c] = (least, need, mean, sizes[d, c])
    return out
