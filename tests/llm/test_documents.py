"""Operators on documents against plain Python, over awkward rows and an empty table."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from crashlens.llm import fast_minhash, mixing, packing, quality_ledger, substring_cover, toxicity_chain, unigram_count
from crashlens.llm.queries import tokenizer_path

from .conftest import words


def test_quality_measures(docs, no_docs, plain):
    def expected(text):
        w, t = words(text), text or ""
        grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        covered = {i + j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if words(x)]
        return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)

    got = quality_ledger.quality(docs).collect()
    names = quality_ledger.MEASURES[:5]
    assert Counter((r.doc_id, *(r[m] for m in names)) for r in got) == Counter((k, *expected(t)) for k, t, _ in plain)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    by = {r.doc_id: r for r in got}
    assert by[0].kept and not by[40].kept and not by[41].kept and not by[1].kept
    assert quality_ledger.quality(no_docs).collect() == []
    out, name = quality_ledger.ledger(docs)
    assert name == "ledger_" and out.columns == [*docs.columns, "ledger_"]
    table = {r.rule: r for r in quality_ledger.ablations(out, name).collect()}
    assert table["symbols"].n_failed >= 1 and table["few_words"].n_kept_without >= sum(r.kept for r in got)


def test_substring_dedup(docs, no_docs, plain):
    low = {}
    for k, t, _ in plain:
        w = words(t)
        for i in range(len(w) - 12):
            if k is not None:
                g = tuple(w[i:i + 13])
                low[g] = min(k, low.get(g, k))
    want = Counter()
    for k, t, _ in plain:
        w = words(t)
        gone = {i + j for i in range(len(w) - 12) if k is not None and low[tuple(w[i:i + 13])] < k for j in range(13)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[(k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert sum(v for key, v in want.items() if key[2]) > 5
    assert Counter(map(tuple, substring_cover.substring_dedup(docs).collect())) == want
    assert substring_cover.substring_dedup(no_docs).collect() == []


def test_cover_holds_every_difference():
    d = substring_cover
    assert {(a - b) % d.PERIOD for a in d.COVER for b in d.COVER} == set(range(d.PERIOD))
    assert d.ANCHOR + d.PERIOD - 1 == d.WINDOW


def test_near_duplicates(docs, no_docs, plain):
    for size in (2, 5):
        sets = {}
        for k, t, _ in plain:
            w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
            s = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
            sets[k] = s
        root = {k: k for k in sets}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        keys = sorted(k for k in sets if k is not None and sets[k])
        for i, a in enumerate(keys):
            for b in keys[i + 1:]:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
        got = fast_minhash.near_duplicates(docs, size=size).collect()
        want = Counter((k, len(sets[k]), None if k is None else find(k), k is None or find(k) == k) for k, _, _ in plain)
        assert Counter(map(tuple, got)) == want
    assert fast_minhash.near_duplicates(no_docs).collect() == []


def test_sketch_agreement_is_the_similarity():
    r = np.random.default_rng(1)
    a = r.integers(1, 2**62, 500).astype(np.uint64)
    b = np.concatenate((a[:400], r.integers(1, 2**62, 100).astype(np.uint64)))
    s = fast_minhash.sketches(np.concatenate((a, b, a[:1])), np.array([0, 500, 1000, 1001]))
    assert (s != fast_minhash._EMPTY).all() and abs((s[0] == s[1]).mean() - 400 / 600) < 0.1


def test_mix(docs, no_docs, plain):
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((k, len(words(t))) for k, t, _ in plain)
    assert sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str) == sorted(map(tuple, got), key=str)
    size, total = defaultdict(int), 0
    for k, t, s in plain:
        size[s] += len(words(t))
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight, target, open_ = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {}, set(order)
    total = sum(size.values())
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s] + 1e-9}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * size[s] for s in over}
        open_ -= over
    by_size = defaultdict(set)
    for r in got:
        by_size[r.source_size].add(round(r.target, 6))
        assert 0 <= r.taken <= 3 * r.size
    for s in order:
        assert round(target[s], 6) in by_size[size[s]]
    assert abs(sum(r.taken for r in got) - total) <= 2 * len(order)
    rows = mixing.mixed_documents(docs)
    assert rows.columns == docs.columns
    assert sum(len(words(r.text)) for r in rows.collect()) == sum(r.taken for r in got)
    assert mixing.mix(no_docs).collect() == []


def test_pack(docs, no_docs, plain):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    tok = Tokenizer.from_file(path)  # as loaded
    got = packing.pack_documents(docs, path, per_packer=20).collect()
    ids = {k: tok.encode(t or "", add_special_tokens=False).ids + [0] for k, t, _ in plain}
    parts, lots = defaultdict(set), defaultdict(list)
    for r in got:
        own = ids[r.doc_id][r.start:r.start + r.length]
        assert len(own) == r.length <= 2048 and zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
        parts[r.doc_id].add((r.piece, r.start, r.length))
        lots[r.sequence_id].append((r.offset, r.length))
    for k, _, _ in plain:
        own = sorted(parts[k])
        assert [p[0] for p in own] == list(range(len(own))) and sum(p[2] for p in own) == len(ids[k]) and all(p[2] == 2048 for p in own[1:])
    for own in lots.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(no_docs, path).collect() == []


def test_packer_closes_the_fullest():
    small = packing.Packer(10, 2)
    assert [small.place(x) for x in (6, 7)] == [(0, 0), (1, 0)]  # 4 and 3 are free
    assert small.place(5) == (2, 0)                              # no room and no place: the fullest, 1, closes
    assert small.place(3) == (0, 6) and small.n_open == 2        # best fit would have been 1


def test_sequences_close_and_fill_well(spark):
    """Far more sequences than may be open: the bound is reached, and little space is lost."""
    r = np.random.default_rng(2)
    sizes = np.minimum(2048, r.lognormal(6.3, 1, 24_000).astype(int) + 1).tolist()
    parts = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "key bigint, length bigint")
    got = packing.pack(parts, places=256, per_packer=12_000, wave=700).collect()
    space, last = defaultdict(int), defaultdict(set)
    for row in got:
        space[row.sequence_id] += row.length
        last[row.sequence_id].add((row.offset, row.length))
    assert len(got) == len(sizes) and max(space.values()) <= 2048
    for own in last.values():
        assert [o for o, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1].tolist()]
    least = math.ceil(sum(sizes) / 2048)
    assert len(space) > 10 * 2 * 256 and len(space) <= 1.005 * least
    again = packing.pack(parts.repartition(9), places=256, per_packer=12_000, wave=700).collect()
    assert Counter((x.key, x.sequence_id, x.offset) for x in got) == Counter((x.key, x.sequence_id, x.offset) for x in again)


def test_encoder_equals_the_tokenizer(plain):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())  # as loaded
    odd = ["a  b", "x \n y", "\t\tq  ", "it's I'LL we've", "\x1c z\xa0 q  r", "日本 語。 12345 67", "<|endoftext|> x", "  ", "\n\n\n a", "é́ ß\x85 x"]
    encode = packing.encoder(tokenizer_path()).encode_to_numpy
    for text in odd + [t for _, t, _ in plain if t]:
        assert tok.encode(text, add_special_tokens=False).ids == encode(text, allowed_special="all").tolist()


def test_added_tokens_in_texts(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    tok = Tokenizer.from_file(path)  # as loaded
    end = "<|endoftext|>"
    texts = ["a <|endoftext|> b", end, end * 3, f"  {end}\n\n{end}  x", f"<|{end}|>", "<|endoftext|", "<|ENDOFTEXT|>", f"é{end}日本 ", f"x{end}" * 3000, f"one two {end}" * 5]
    encode = packing.encoder(path).encode_to_numpy
    assert encode(texts[0], allowed_special="all").tolist() == [64, 220, 50256, 275]
    for text in texts:
        assert encode(text, allowed_special="all").tolist() == tok.encode(text, add_special_tokens=False).ids, text
    ids = {i: tok.encode(t, add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    got = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), path).collect()
    total = Counter()
    for r in got:
        own = ids[r.doc_id][r.start:r.start + r.length]
        assert len(own) == r.length and zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
        total[r.doc_id] += r.length
    assert total == {i: len(own) for i, own in ids.items()}


def test_token_counts(docs, no_docs, plain):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = tokenizer_path("piece_bpe_32k.model")
    tok = Tokenizer(models.Unigram(unigram_count.vocabulary(path), 0, True))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)  # the whole text at once
    odd = [" ", "a  b", "  x", "▁▁ q", "日本語 x 😀", "<unk> <0x41> <s>", "\n\nx\ty ", "é́" * 5, "aaaa" * 50, "    x = 1;", "a    b     c", "   ", " " * 40 + "q", "x" + " " * 16 + "y ", "if a:\n        b  =  2"]
    own = unigram_count.counter(path)
    for text in odd:
        assert own.text(text) == len(tok.encode(text, add_special_tokens=False).ids), text
    want = Counter((k, len(tok.encode(t, add_special_tokens=False).ids) if t else 0) for k, t, _ in plain)
    assert Counter(map(tuple, unigram_count.token_counts(docs, path).collect())) == want
    assert unigram_count.token_counts(no_docs, path).collect() == []


def test_toxicity_on_held_out_rows(spark, docs, no_docs):
    sf = "/root/testdata/sf0.1"
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = labels.filter("doc_id % 4 = 0")
    found = toxicity_chain.toxicity(table, labels.filter("doc_id % 4 != 0")).join(held.withColumnRenamed("toxic", "label"), "doc_id").collect()
    # about 6 % of the rows labelled toxic hold no insult at all: recall counts English rows that do
    insult = re.compile("loser|idiot|pathetic|scum|worthless|moron|trash|clown|disgusting|stupid")
    text = {r.doc_id: r.text.lower() for r in table.filter("lang = 'en'").join(held, "doc_id").collect()}
    real = [r.toxic for r in found if r.label == 1 and insult.search(text.get(r.doc_id, ""))]
    assert len(real) > 30 and sum(real) >= 0.95 * len(real)
    every = [r.toxic for r in found if r.label == 1]
    assert sum(every) >= 0.85 * len(every)  # of all rows labelled toxic, those without an insult included
    clean = [r.toxic for r in found if r.label == 0]
    assert sum(clean) <= 0.01 * len(clean)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r.toxic for r in toxicity_chain.toxicity(docs, none).collect()] == [False] * docs.count()
    assert toxicity_chain.toxicity(no_docs, none).collect() == []


def test_the_verdict_reads_the_links_before_it(spark):
    """Without the earlier probabilities, other scores and other verdicts: the chain is not an ornament."""
    sf = "/root/testdata/sf0.1"
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows, toxic, quality = toxicity_chain.training_rows(table, labels, "doc_id", "text", 2000)
    chain = toxicity_chain.train(rows, toxic, quality)
    assert toxicity_chain.CATEGORIES[-1] == "toxic" and np.abs(chain.earlier[-1]).min() > 0.1
    feature = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    whole = chain.probabilities(row, feature, len(rows))
    chain.earlier[-1] = np.zeros(2)
    cut = chain.probabilities(row, feature, len(rows))
    assert (whole[:, :2] == cut[:, :2]).all() and ((whole[:, 2] >= chain.threshold) != (cut[:, 2] >= chain.threshold)).any()


def test_labels_that_clash_and_awkward_texts(spark):
    texts = [(i, "you idiot scum " * 3 if i % 2 else f"the calm sea {i} is wide") for i in range(60)] + [(100, None), (101, ""), (102, "you idiot scum " * 20_000)]
    table = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(1, 0, 0), (1, None, 0), (3, 1, 0), (None, 1, 1), (999, 1, 1)],
                                   "doc_id bigint, quality int, toxic int")
    runs = [sorted(map(tuple, toxicity_chain.toxicity(table, labels.repartition(n), limit=1000).collect())) for n in (1, 5)]
    assert runs[0] == runs[1]
    verdict = {r[0]: r[-1] for r in runs[0]}
    assert all(verdict[i] == bool(i % 2) for i in range(60)) and verdict[102] and not verdict[100] and not verdict[101]
