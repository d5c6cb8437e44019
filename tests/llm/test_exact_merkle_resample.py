"""Exact de-duplication, Merkle manifest and importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from crashlens.llm import merkle_manifest as M
from crashlens.llm import quotient_filter as Q
from crashlens.llm import salted
from crashlens.llm import target_resampling as R
from pyspark.sql import functions as F

from .conftest import DOCUMENTS

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- exact de-duplication -----------------------------------------------------------------

def equal_groups(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[(text or "").translate(LOWER)].append(key)
    out = Counter()
    for text, keys in groups.items():
        keep = max((k for k in keys if k is not None), default=None)
        stays = keys.index(keep)
        for i, key in enumerate(keys):
            out[(key, keep, len(keys), i == stays, sha(text))] += 1
    return out


AWKWARD = [(1, "Same"), (2, "sAME"), (3, "same "), (9, None), (4, ""), (5, "É"), (6, "é"), (None, "alone"), (None, "Twin"), (None, "twin"),
           (7, "repeat"), (7, "Repeat"), (7, "repeat"), (8, "repeat"), (8, "repeat"), (-3, "x" * 70_000), (-4, "X" * 70_000)]


@pytest.mark.parametrize("bits", [Q.BITS, 3, 1])  # few bits: many unlike texts share a fingerprint
def test_exact_duplicates(spark, bits):
    table = spark.createDataFrame([(k, t, 1) for k, t in AWKWARD], "doc_id bigint, text string, keep_id int").repartition(5)
    assert Counter(map(tuple, Q.exact_duplicates(table, bits=bits).collect())) == equal_groups(AWKWARD)


def test_exact_duplicates_of_documents(docs, no_docs, plain):
    assert Counter(map(tuple, Q.exact_duplicates(docs).collect())) == equal_groups([(k, t) for k, t, _ in plain])
    assert Q.exact_duplicates(no_docs).collect() == []


def test_exact_duplicates_of_a_hot_text_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(salted, "SMALL", 0)
    monkeypatch.setattr(salted, "LEAST", 50)
    monkeypatch.setattr(salted.join, "__defaults__", ("left", 0))
    monkeypatch.setattr(Q, "ROUTED", 0)
    monkeypatch.setattr(Q, "MERGE_ROWS", 100)  # several cuts of the filters
    rows = [(i, "Hot" if i % 3 == 0 else f"text {i % 700}") for i in range(1500)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    assert Counter(map(tuple, Q.exact_duplicates(table).collect())) == equal_groups(rows)


def test_quotient_filters_merge_without_loss():
    r = np.random.default_rng(3)
    for width in (1, 7, 20, 48, 60):
        total, filters = Counter(), []
        for n in (0, 1, 50, 3000):
            values, counts = np.unique(r.integers(0, 1 << width, n).astype(np.uint64), return_counts=True)
            total.update(dict(zip(values.tolist(), counts.tolist())))
            f = Q.QuotientFilter.from_bytes(Q.QuotientFilter.build(values, counts, width).to_bytes())
            back = f.entries()
            assert back[0].tolist() == values.tolist() and back[1].tolist() == counts.tolist()
            filters.append(f)
        values, counts = Q.merge(filters, width).entries()
        assert dict(zip(values.tolist(), counts.tolist())) == total and (np.diff(values.astype(object)) > 0).all()


# --- Merkle manifest ------------------------------------------------------------------------

def leaf(row, more=0):
    doc, source, lang, n, text = row
    values = [doc, source, lang, None if n is None else n + more, text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def plain_manifest(rows):
    if not rows:
        return Counter()
    trees = defaultdict(list)
    for row in rows:
        trees[row[2]].append(row)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for rows_ in trees.values():
        rows_.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    built = {k: levels([leaf(r) for r in trees[k]]) for k in order}
    top = levels([built[k][-1][0] for k in order])
    root, out = top[-1][0], Counter()
    for t, k in enumerate(order):
        for i, row in enumerate(trees[k]):
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None
            node, siblings = leaf(row, 1 if bad else 0), []
            for tree, at in ((built[k], i), (top, t)):
                for level in tree[:-1]:
                    other = at ^ 1
                    if other < len(level):
                        siblings.append(level[other])
                        node = sha(level[other] + node if other < at else node + level[other])
                    else:
                        node = sha(node)
                    at //= 2
            out[(row[0], leaf(row), built[k][-1][0], root, sha("".join(siblings)), node, node == root)] += 1
    return out


MERKLE = "doc_id bigint, source string, lang string, n_chars bigint, text string, root string, tree int"


def manifest_rows(spark, rows, **bits):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], MERKLE).repartition(4)
    return Counter(map(tuple, M.manifest(table, **bits).collect()))


@pytest.mark.parametrize("bits", [{}, {"id_bits": 7, "slot_bits": 2}, {"id_bits": 9, "slot_bits": 3}])
def test_manifest(spark, bits):
    rows = [(i * 3 - 200, f"s{i % 4}", ["de", "en", None, "fr", "zz"][0 if i % 2 else i % 5], None if i % 11 == 0 else i, None if i % 13 == 0 else "té" * i)
            for i in range(300)]
    rows += [(1 << 62, "a", "de", 5, "far"), (-(1 << 62), None, "é", 5, ""), (None, "n", "de", 1, "no id"), (None, "m", "de", 1, "no id"),
             (40, "r", "de", 1, "repeated"), (40, "q", "de", 2, "repeated"), (40, "q", "de", 2, "repeated"), (None, None, None, None, None)]
    got = manifest_rows(spark, rows, **bits)
    assert got == plain_manifest(rows)
    assert len({r[-1] for r in got}) == 2  # some rows fold to another root


def test_manifest_of_one_row_one_tree_and_none(spark):
    for rows in ([(5, "s", "en", 3, "abc")], [(5, "s", "en", 3, "abc"), (6, "s", "de", 3, "abc")], [(i, "s", "en", 1, "x") for i in range(33)], []):
        assert manifest_rows(spark, rows) == plain_manifest(rows)


def test_manifest_with_a_hot_id_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(salted, "LEAST", 20)
    monkeypatch.setattr(salted.join, "__defaults__", ("left", 0))
    monkeypatch.setattr(M, "LOT_ROWS", 64)
    rows = [(7 if i % 3 == 0 else i // 2, "s", "en" if i % 4 else "de", i % 5, f"t{i % 50}") for i in range(600)]
    assert manifest_rows(spark, rows, id_bits=6, slot_bits=4) == plain_manifest(rows)


@pytest.mark.parametrize("id_bits", [6, 12])
def test_containers_rank_by_popcount(id_bits):
    r = np.random.default_rng(1)
    for n in (1, 40, 300, 4000):
        low, counts = np.unique(r.integers(0, 1 << id_bits, n), return_counts=True)
        c = M.Container(M.container(low, counts, id_bits), id_bits)
        assert [x.tolist() for x in c.entries()] == [low.tolist(), counts.tolist()]
        assert c.rank(low).tolist() == (np.cumsum(counts) - counts).tolist()


# --- importance resampling ------------------------------------------------------------------

FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_resample(rows, target, percent=10, min_words=20):
    def features(text):
        return [zlib.crc32(w.encode()) % 10_000 for w in FEATURE.findall((text or "").translate(LOWER))]

    s, t = Counter(), Counter()
    per = [features(text) for _, text in rows]
    for f in per:
        s.update(f)
    for text in target:
        t.update(features(text))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (n_s + 10_000) / ((s[k] + 1) * (n_t + 10_000))))
    table = []
    for (key, _), f in zip(rows, per):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(sha(f"2024:{'' if key is None else key}")[:8], 16)
        table.append((key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((i for i, r in enumerate(table) if r[1] >= min_words),
                  key=lambda i: (-table[i][3], table[i][0] is None, table[i][0] or 0, table[i][1]))
    rank = {i: j + 1 for j, i in enumerate(able[:len(able) * percent // 100])}
    return Counter((*r, rank.get(i)) for i, r in enumerate(table))


@pytest.mark.parametrize("percent, block_bits", [(10, R.BLOCK_BITS), (60, 3), (100, 5)])
def test_resample(spark, docs, plain, percent, block_bits):
    target = ["One TWO three " * 30, None, "", "çé 12ab"]
    rows = [(k, t) for k, t, _ in plain] + [(i * 10**15 - 10**17, f"w{i % 7} W{i % 5}-x{i} " * 9) for i in range(200)]
    table = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, score int").repartition(6)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = R.resample(table, wanted, percent=percent, block_bits=block_bits)
    assert Counter(map(tuple, got.collect())) == plain_resample(rows, target, percent)


def test_resample_of_nothing_and_without_target(spark, docs, no_docs, plain):
    empty = spark.createDataFrame([], "text string")
    assert R.resample(no_docs, empty).collect() == []
    assert Counter(map(tuple, R.resample(docs, empty).collect())) == plain_resample([(k, t) for k, t, _ in plain], [])
    assert all(r.rank is None for r in R.resample(docs, empty, percent=0).collect())


def test_radix_sort_is_stable_over_blocks(spark):
    rows = [(i * 5, (i * 7919) % 2500, i) for i in range(400)]
    table = spark.createDataFrame(rows, "pos bigint, value bigint, id bigint").repartition(3)
    got = R.radix_sorted(table, R._digits("value", 2499) + [F.when(F.col("id") % 3 == 0, 1).otherwise(0)], block_bits=6)
    want = sorted(rows, key=lambda r: (r[2] % 3 == 0, r[1], r[0]))
    assert [r.id for r in sorted(got.collect(), key=lambda r: r.pos)] == [r[2] for r in want]


def test_crc32_of_words_of_all_lengths():
    data = np.random.default_rng(0).integers(0, 256, 5000).astype(np.uint8)
    start = np.arange(0, 4000, 37)
    end = start + (np.arange(len(start)) * 13) % 150
    assert R.crc32_of(data, start, end).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end)]


def test_documents_fixture_has_repeats():
    assert len(DOCUMENTS) > len({r[0] for r in DOCUMENTS})
