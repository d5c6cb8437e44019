"""12. Merkle manifest of a table, with leaf places from bitmap ranks.

A row's leaf is H (SHA-256 as lower-case hex text) of doc_id, source, lang, n_chars and text, each ``-`` if
null, else its UTF-8 byte count, ``:`` and its value. Leaves form a tree per lang in the order of doc_id: every
two consecutive nodes (at an odd end, one) become the H of both until one is left, the subroot; the
subroots, ordered by lang, form a tree in the same way, with the root.

Bitmap ranks: every partition gathers the ids that it holds, per lang, in compressed containers of
``1 << ID_BITS`` ids (sorted 16-bit offsets where few, a bitmap where many). Containers merge per
(lang, high bits of the id) and get a directory of popcounts per word; a running sum over the containers'
cardinalities gives each its first rank. A leaf's place is that rank plus the directory entry plus a popcount
of the bits below its own: no leaf is sorted. Places key arrays of ``1 << SLOT_BITS`` slots; a task fills
its array by slot and reduces it by ``SLOT_BITS`` levels, and the arrays' tops are the next step's nodes. Paths
go back down the same arrays: from the root to the subroots, the arrays' tops, the leaves.

Skew: a container and an array have a bounded size whatever the lang's. An id that repeats within its lang
is counted in its container, partition by partition, and its rows (which may be a third of all) get
their places by a distributed running count. Nothing but one hash goes to the driver.

Nulls, ties, empty tables: a null lang is a tree before all others; null ids stand before all others of
their lang; rows with one id (or none) stand in the order of their leaves, copies in any order, which is the
same tree. An empty table gives an empty table. Negative ids are in order. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import salted
from .store import materialise, ship

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ID_BITS, SLOT_BITS = 12, 12
SPARSE = 256          # ids up to which a container is a list
LOT_ROWS = 1 << 13    # rows that one task ranks, about


def _running_totals(*args, **named) -> DataFrame:
    from ..operators.numbering import running_totals  # on the driver: tasks are sent this subpackage alone

    return running_totals(*args, **named)


# --- leaves ----------------------------------------------------------------------------

def _leaf(values: dict[str, Column]) -> Column:
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values.values()]
    return F.sha2(F.concat(*parts), 256)


def tampered(key: Column) -> Column:
    """Whether a row's id names it for the tampering trial: 7 divides the CRC-32 of its decimal text."""
    return F.coalesce(F.crc32(key.cast("string")) % 7 == 0, F.lit(False))


def leaves(df: DataFrame) -> DataFrame:
    """(key, tree, leaf, other): ``tree`` is the lang behind a letter that puts null first; ``other`` is the leaf with
    n_chars one higher, where the id says so and n_chars is not null (else null)."""
    text = {c: F.col(c).cast("string") if c in ("source", "lang", "text") else F.col(c).cast("bigint").cast("string") for c in FIELDS}
    more = text | {"n_chars": F.try_add(F.col("n_chars").cast("bigint"), F.lit(1).cast("bigint")).cast("string")}
    touched = tampered(F.col("doc_id").cast("bigint")) & F.col("n_chars").isNotNull()
    return df.select(F.col("doc_id").cast("bigint").alias("key"), F.coalesce(F.concat(F.lit("v"), text["lang"]), F.lit("n")).alias("tree"),
                     _leaf(text).alias("leaf"), F.when(touched, _leaf(more)).alias("other"))


# --- compressed containers with popcount directories -----------------------------------

def container(low: np.ndarray, counts: np.ndarray, id_bits: int) -> bytes:
    """Different offsets in rising order and how often each comes. Layout: 3 numbers (offsets, whether a bitmap,
    repeated offsets), then the list of offsets, or bitmap words and their directory (set bits before
    each word), then the repeated offsets and their counts beyond one."""
    words = max(1, (1 << id_bits) // 64)
    dense = len(low) > SPARSE
    many = np.flatnonzero(counts > 1)
    parts = [np.array([len(low), dense, len(many)], "<i4")]
    if dense:
        bits = np.zeros(words * 64, np.uint8)
        bits[low] = 1
        bitmap = np.packbits(bits, bitorder="little").view("<u8")
        set_bits = np.bitwise_count(bitmap).astype("<u4")
        parts += [bitmap, np.cumsum(set_bits, dtype="<u4") - set_bits]
    else:
        parts.append(low.astype("<u2"))
    parts += [low[many].astype("<u2"), (counts[many] - 1).astype("<i8")]
    return b"".join(p.tobytes() for p in parts)


class Container:
    def __init__(self, blob: bytes, id_bits: int):
        self.n, self.dense, many = (int(x) for x in np.frombuffer(blob, "<i4", 3))
        at, words = 12, max(1, (1 << id_bits) // 64)
        if self.dense:
            self.bitmap = np.frombuffer(blob, "<u8", words, at)
            self.directory = np.frombuffer(blob, "<u4", words, at + 8 * words)
            at += 12 * words
        else:
            self.list = np.frombuffer(blob, "<u2", self.n, at)
            at += 2 * self.n
        self.many = np.frombuffer(blob, "<u2", many, at)
        self.more = np.frombuffer(blob, "<i8", many, at + 2 * many)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        low = np.flatnonzero(np.unpackbits(self.bitmap.view(np.uint8), bitorder="little")) if self.dense else self.list.astype(np.int64)
        counts = np.ones(len(low), np.int64)
        counts[np.searchsorted(low, self.many)] += self.more
        return low, counts

    def rank(self, low: np.ndarray) -> np.ndarray:
        """Rows with a smaller offset than each of ``low``."""
        if self.dense:
            word, bit = low >> 6, (low & 63).astype(np.uint64)
            below = self.bitmap[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out = self.directory[word].astype(np.int64) + np.bitwise_count(below)
        else:
            out = np.searchsorted(self.list, low).astype(np.int64)
        return out + np.concatenate(([0], np.cumsum(self.more)))[np.searchsorted(self.many, low)]


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where a new value of any column begins."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def bitmap_index(rows: DataFrame, n_rows: int, id_bits: int) -> DataFrame:
    """(lot, tree, high, n, ids): merged containers of all rows with an id, and per tree an entry with null ``high``
    for rows without."""
    lots, schema = max(1, n_rows // LOT_ROWS), "tree string, high bigint, n bigint, ids binary"
    mask = (1 << id_bits) - 1

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            trees = batch.column("tree").dictionary_encode()
            codes, keys = trees.indices.to_numpy(zero_copy_only=False), batch.column("key").to_numpy(zero_copy_only=False)
            for i, tree in enumerate(trees.dictionary.to_pylist()):
                held.setdefault(tree, []).append(keys[codes == i])
        for tree, parts in held.items():
            ids, counts = np.unique(np.concatenate(parts), return_counts=True)
            heads = _heads(ids >> id_bits)
            ends = np.append(heads[1:], len(ids))
            blobs = [container(ids[a:b] & mask, counts[a:b], id_bits) for a, b in zip(heads.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([tree] * len(heads)), pa.array(ids[heads] >> id_bits), pa.array(np.add.reduceat(counts, heads)),
                                              pa.array(blobs, pa.binary())], ["tree", "high", "n", "ids"])

    def merged(table: pa.Table) -> pa.Table:
        groups: dict[tuple[str, int], list[bytes]] = {}
        for tree, high, ids in zip(*(table.column(c).to_pylist() for c in ("tree", "high", "ids"))):
            groups.setdefault((tree, high), []).append(ids)
        lot, out = table.column("lot")[0].as_py(), []
        for (tree, high), blobs in groups.items():
            both = [Container(b, id_bits).entries() for b in blobs]
            low, back = np.unique(np.concatenate([x for x, _ in both]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([c for _, c in both])).astype(np.int64)
            out.append((lot, tree, high, int(counts.sum()), container(low, counts, id_bits)))
        names = ["lot", "tree", "high", "n", "ids"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    known = rows.filter("key is not null").select("tree", "key").mapInArrow(gather, schema)
    whole = known.withColumn("lot", _lot(F.col("high"), lots)).groupBy("lot").applyInArrow(merged, "lot bigint, " + schema)
    without = (rows.filter("key is null").groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
               .select(F.lit(None).cast("bigint").alias("lot"), "tree", F.lit(None).cast("bigint").alias("high"), "n", F.lit(None).cast("binary").alias("ids")))
    return whole.unionByName(without)


def _lot(high: Column, lots: int) -> Column:
    return F.pmod(F.xxhash64("tree", high), F.lit(lots).cast("bigint"))


def repeated_ids(index: DataFrame, id_bits: int) -> DataFrame:
    """(tree, key, copies, first): ids that several rows of a tree have, and the rank of the first of these."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, high, ids, offset in zip(*(batch.column(c).to_pylist() for c in ("tree", "high", "ids", "offset"))):
                c = Container(ids, id_bits)
                if len(c.many):
                    low = c.many.astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([tree] * len(low)), pa.array((high << id_bits) + low), pa.array(c.more + 1),
                                                      pa.array(offset + c.rank(low))], ["tree", "key", "copies", "first"])

    return index.filter("ids is not null").select("tree", "high", "ids", "offset").mapInArrow(run, "tree string, key bigint, copies bigint, first bigint")


PLACED = "tree string, pos bigint, n bigint, node string, key bigint, other string"


def places(rows: DataFrame, id_bits: int = ID_BITS) -> DataFrame:
    """Rows of :func:`leaves` with ``pos``, their place in their tree (from 0), and ``n``, the tree's leaves."""
    n_rows = rows.count()
    lots = max(1, n_rows // LOT_ROWS)
    found = materialise(bitmap_index(rows, n_rows, id_bits), "bitmaps")
    sizes = materialise(found.groupBy("tree").agg(F.sum("n").alias("leaves")), "trees")
    ranked = _running_totals(found, ["tree"], ["high"], {"offset": F.col("n")}, ties=[])
    index = materialise(ranked.join(F.broadcast(sizes) if sizes.count() <= salted.SMALL else sizes, "tree"), "index")
    mask = (1 << id_bits) - 1

    def rank(part: pa.Table, held: pa.Table) -> pa.Table:
        names = held.column("tree").to_pylist()
        number = {t: i for i, t in enumerate(dict.fromkeys(names))}
        entry = {(number[t], h): i for i, (t, h) in enumerate(zip(names, held.column("high").to_pylist()))}
        keys = part.column("key").to_numpy()
        codes = pc.index_in(part.column("tree"), pa.array(list(number))).to_numpy().astype(np.int64)
        blobs, offsets, sizes_ = (held.column(c).to_pylist() for c in ("ids", "offset", "leaves"))
        by_container = np.lexsort((keys >> id_bits, codes))  # rows of a container together; their order inside is not used
        heads = _heads(codes[by_container], (keys >> id_bits)[by_container])
        pos, n = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(keys)]):
            own = by_container[a:b]
            i = entry[int(codes[own[0]]), int(keys[own[0]] >> id_bits)]
            pos[own] = offsets[i] + Container(blobs[i], id_bits).rank(keys[own] & mask)
            n[own] = sizes_[i]
        return pa.table([part.column("tree"), pa.array(pos), pa.array(n), part.column("leaf"), part.column("key"), part.column("other")],
                        names=["tree", "pos", "n", "node", "key", "other"])

    repeats = materialise(repeated_ids(index, id_bits), "repeats")
    single, crowd = rows.filter("key is not null"), None
    if not repeats.isEmpty():
        numbered = rows.filter("key is not null").withColumn("row", F.monotonically_increasing_id())
        marked = materialise(salted.join(numbered, repeats, ["tree", "key"], "copies", "row", n_rows), "marked")
        single = marked.filter("first is null").select(*rows.columns)
        crowd = marked.filter("first is not null").select(*rows.columns, "first")
    without = rows.filter("key is null")
    if not without.isEmpty():
        without = without.withColumn("first", F.lit(0).cast("bigint"))
        crowd = crowd.unionByName(without) if crowd is not None else without
    dealt = single.withColumn("lot", _lot(F.shiftright("key", id_bits), lots))
    out = dealt.groupBy("lot").cogroup(index.filter("ids is not null").groupBy("lot")).applyInArrow(rank, PLACED)
    if crowd is not None:
        told = _running_totals(crowd, ["tree", "first"], ["leaf"], {"after": None}, ties=[])
        total = F.broadcast(sizes) if sizes.count() <= salted.SMALL else sizes
        out = out.unionByName(told.join(total, "tree").select("tree", (F.col("first") + F.col("after")).alias("pos"), F.col("leaves").alias("n"),
                                                              F.col("leaf").alias("node"), "key", "other"))
    return materialise(out, "leaves")


# --- slot arrays ------------------------------------------------------------------------

def _hash(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _steps(n: int, slot_bits: int) -> int:
    """Levels that an array reduces in a tree with ``n`` nodes left."""
    return min(slot_bits, (n - 1).bit_length())


def reduced(nodes: list[str], steps: int) -> list[list[str]]:
    """The slots of an array and of its levels above."""
    levels = [nodes]
    for _ in range(steps):
        last = levels[-1]
        levels.append([_hash(*last[i:i + 2]) for i in range(0, len(last), 2)])
    return levels


def path(levels: list[list[str]], slot: int) -> str:
    """Siblings of a slot up to the array's top: per level ``l`` or ``r`` (the side) and the sibling, or ``-``."""
    out = []
    for level in levels[:-1]:
        other = slot ^ 1
        out.append("-" if other >= len(level) else ("l" if other < slot else "r") + level[other])
        slot >>= 1
    return "".join(out)


def walk(node: str, steps: str) -> tuple[str, str]:
    """The top that a node and its path lead to, and the siblings one after another."""
    at, siblings = 0, []
    while at < len(steps):
        side = steps[at]
        if side == "-":
            node, at = _hash(node), at + 1
            continue
        other = steps[at + 1:at + 65]
        siblings.append(other)
        node, at = (_hash(other, node) if side == "l" else _hash(node, other)), at + 65
    return node, "".join(siblings)


def _slots(table: pa.Table, slot_bits: int) -> tuple[np.ndarray, list[list[str]]]:
    """Each row's slot, and the array's levels."""
    slot = table.column("pos").to_numpy() & ((1 << slot_bits) - 1)
    nodes = table.column("node").to_pylist()
    array = [""] * len(nodes)
    for s, node in zip(slot.tolist(), nodes):
        array[s] = node
    return slot, reduced(array, _steps(table.column("n")[0].as_py(), slot_bits))


NODES = "tree string, pos bigint, n bigint, node string"


def climb(nodes: DataFrame, slot_bits: int) -> DataFrame:
    """Tops of the arrays of (tree, pos, n, node): the nodes of the next step up."""
    def top(table: pa.Table) -> pa.Table:
        _, levels = _slots(table, slot_bits)
        n, steps = table.column("n")[0].as_py(), len(levels) - 1
        return pa.table({"tree": [table.column("tree")[0].as_py()], "pos": [table.column("pos")[0].as_py() >> slot_bits],
                         "n": [-(-n >> steps)], "node": [levels[-1][0]]})

    dealt = nodes.select("tree", "pos", "n", "node", F.shiftright("pos", slot_bits).alias("array"))
    return materialise(dealt.groupBy("tree", "array").applyInArrow(top, NODES), "nodes")


def descend(nodes: DataFrame, above: DataFrame, slot_bits: int) -> DataFrame:
    """Nodes with the path to the root, from the paths of their arrays' tops: (tree, pos, subroot, path)."""
    def down(table: pa.Table, top: pa.Table) -> pa.Table:
        slot, levels = _slots(table, slot_bits)
        rest, sub = top.column("path")[0].as_py(), top.column("subroot")[0].as_py()
        return pa.table([table.column("tree"), table.column("pos"), pa.array([sub] * len(slot)), pa.array([path(levels, s) + rest for s in slot.tolist()])],
                        names=["tree", "pos", "subroot", "path"])

    return materialise(_with_tops(nodes, above, slot_bits).applyInArrow(down, "tree string, pos bigint, subroot string, path string"), "paths")


def _with_tops(nodes: DataFrame, above: DataFrame, slot_bits: int):
    dealt = nodes.withColumn("array", F.shiftright("pos", slot_bits))
    return dealt.groupBy("tree", "array").cogroup(above.withColumn("array", F.col("pos")).groupBy("tree", "array"))


def climb_to_top(nodes: DataFrame, most: int, slot_bits: int) -> list[DataFrame]:
    """``nodes`` and the steps above them, up to one node per tree; the largest tree has ``most`` nodes."""
    steps = [nodes]
    while most > 1:
        steps.append(climb(steps[-1], slot_bits))
        most = -(-most >> slot_bits)
    return steps


def manifest(df: DataFrame, id_bits: int = ID_BITS, slot_bits: int = SLOT_BITS) -> DataFrame:
    """One row per row of ``df``: doc_id, leaf, subroot, root, proof_sha256 (H of the siblings up to the root),
    folded_root (from the tampered leaf where the trial tampers, else the leaf, and the siblings), verified."""
    ship(df.sparkSession)
    rows = materialise(leaves(df), "rows")
    placed = places(rows, id_bits)
    sizes = placed.select("tree", "n").distinct()
    trees, most = sizes.agg(F.count(F.lit(1)), F.max("n")).first()
    if not trees:
        return rows.select(F.col("key").alias("doc_id"), "leaf", *[F.lit("").alias(c) for c in ("subroot", "root", "proof_sha256", "folded_root")],
                           F.lit(False).alias("verified"))
    steps = climb_to_top(placed, most, slot_bits)
    subroots = steps[-1].select("tree", "node")

    # the tree of subroots, ordered by lang: running_totals numbers them over the whole table
    order = _running_totals(subroots, [], ["tree"], {"pos": None}, ties=[])
    tops = materialise(order.select(F.lit("").alias("tree"), "pos", F.lit(trees).cast("bigint").alias("n"), "node", F.col("tree").alias("name")), "subroots")
    upper = climb_to_top(tops, trees, slot_bits)
    root = upper[-1].first().node
    paths = upper[-1].select("tree", "pos", F.lit("").alias("subroot"), F.lit("").alias("path"))
    for nodes in upper[-2::-1]:
        paths = descend(nodes, paths, slot_bits)

    # a tree's topmost node has the path of its subroot; below, arrays add theirs
    above = (tops.select("pos", "name", "node").join(paths.select("pos", "path"), "pos")
             .select(F.col("name").alias("tree"), F.lit(0).cast("bigint").alias("pos"), F.col("node").alias("subroot"), "path"))
    above = materialise(above, "subroot-paths")
    for nodes in steps[-2:0:-1]:
        above = descend(nodes, above, slot_bits)
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def prove(table: pa.Table, top: pa.Table) -> pa.Table:
        slot, levels = _slots(table, slot_bits)
        rest, sub = top.column("path")[0].as_py(), top.column("subroot")[0].as_py()
        nodes, proofs, folded = table.column("node").to_pylist(), [], []
        for s, node, other in zip(slot.tolist(), nodes, table.column("other").to_pylist()):
            end, siblings = walk(node if other is None else other, path(levels, s) + rest)
            proofs.append(_hash(siblings))
            folded.append(end)
        same = [x == root for x in folded]
        return pa.table([table.column("key"), table.column("node"), pa.array([sub] * len(nodes)), pa.array([root] * len(nodes)),
                         pa.array(proofs), pa.array(folded), pa.array(same)], names=columns)

    schema = ", ".join(f"{c} {'bigint' if c == 'doc_id' else 'boolean' if c == 'verified' else 'string'}" for c in columns)
    return _with_tops(placed, above, slot_bits).applyInArrow(prove, schema)
