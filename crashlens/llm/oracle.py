"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

OP3 = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
-- the level at which the shares, each stopped at 3 times its source, add up to all sizes: of the candidate
-- levels (one per set of stopped sources), the one that stops exactly the sources above their cap
c AS (SELECT a.source, a.source_size, a.weight,
        ((SELECT sum(source_size) FROM w) - coalesce((SELECT sum(3 * b.source_size) FROM w b
          WHERE 3 * b.source_size * a.weight < 3 * a.source_size * b.weight), 0))::DOUBLE
        / (SELECT sum(b.weight) FROM w b WHERE 3 * b.source_size * a.weight >= 3 * a.source_size * b.weight) AS share FROM w a),
l AS (SELECT share AS level FROM c WHERE share * weight <= 3 * source_size ORDER BY 3.0 * source_size / weight LIMIT 1),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, (SELECT level FROM l) * weight) AS target FROM w),
b AS (SELECT *, floor(target + 0.5)::BIGINT AS budget FROM t),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS copies FROM b),
r AS (SELECT d.*, e.source_size, e.target, e.copies, e.budget - e.copies * e.source_size AS rest,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS before,
        count(*) OVER (PARTITION BY d.source, d.h) AS tied, sum(d.size) OVER (PARTITION BY d.source, d.h) AS tied_words
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  (copies * size + CASE WHEN before + tied_words < rest THEN size WHEN before < rest THEN least(size, (rest - before)::BIGINT // tied) ELSE 0 END)::BIGINT AS taken
FROM r
"""

OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT r, i, ws[i:i+4] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY r),
ln AS (SELECT r, l FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dl AS (SELECT r, count(*) - count(DISTINCT l) AS n_dup_lines, count(*) AS n_lines FROM ln GROUP BY r),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
  FROM w LEFT JOIN cov USING (r) LEFT JOIN dl USING (r)),
f AS (SELECT *, n_words < 10 AS f0, 100 * n_repeat_words > 20 * n_words AS f1, 100 * n_symbols > 10 * n_words AS f2,
    100 * n_dup_lines > 50 * n_lines AS f3, word_chars < 2 * n_words AS f4, word_chars > 12 * n_words AS f5, n_lines < 2 AS f6,
    100 * n_repeat_words > 50 * n_words AS f7 FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f0 OR f1 AS base_failed,
  NOT (f0 OR f1 OR f2 OR f3 OR f4 OR f5) AS kept,
  (f0::BIGINT + 2 * f1::BIGINT + 4 * f2::BIGINT + 8 * f3::BIGINT + 16 * f4::BIGINT + 32 * f5::BIGINT + 64 * f6::BIGINT + 128 * f7::BIGINT) AS fail_bits
FROM f
"""

OP5 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT r, doc_id, i, array_to_string(ws[i:i+12], ' ') AS g FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
m AS (SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY g) AS low FROM g) WHERE low < doc_id),
c AS (SELECT DISTINCT r, i + k AS i FROM m, (SELECT unnest(range(0, 13)) AS k)),
k AS (SELECT d.r, list(w ORDER BY i) AS kept FROM (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d) d
      LEFT JOIN c USING (r, i) WHERE c.r IS NULL GROUP BY d.r)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, (len(d.ws) - coalesce(len(k.kept), 0))::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(k.kept, ' '), '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""

OP9 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
          ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM d)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
  coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

OP10 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN o.original <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN o.original <> p.page_id THEN o.original END AS refers_to
FROM p LEFT JOIN o ON p.payload_digest = o.payload_digest AND p.payload_bytes >= 1000
"""


_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_LOWER.format("text")} AS t FROM documents) WINDOW g AS (PARTITION BY t)
"""


def _crc32(octets: str) -> str:
    """Unsigned CRC-32 of a list of byte values."""
    bits = "list_reduce([xor(c, o), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, o: {bits}), 4294967295)"


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


def _step(source: str, on: str) -> str:
    """The next node on the way up from ``f`` with its sibling ``s``, if any, in ``source``."""
    return f"""SELECT f.r, f.tree, f.level + 1, f.pos // 2, (f.n + 1) // 2,
    CASE WHEN s.h IS NULL THEN sha256(f.h) WHEN f.pos % 2 = 0 THEN sha256(f.h || s.h) ELSE sha256(s.h || f.h) END
  FROM {{0}} f LEFT JOIN {source} s ON {on} AND s.level = f.level AND s.pos = xor(f.pos, 1) WHERE f.n > 1"""


_FIELDS = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "{n}", "text"))
OP12 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('v' || lang, 'n') AS tree,
    sha256({_FIELDS.format(n="n_chars")}) AS leaf,
    CASE WHEN {_crc32("list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)")} % 7 = 0 AND n_chars IS NOT NULL
      THEN sha256({_FIELDS.format(n="(n_chars + 1)")}) END AS other FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
lv(tree, level, pos, n, h) AS (SELECT tree, 0, pos, n, leaf FROM p UNION ALL
  SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM lv WHERE n > 1 GROUP BY tree, level, pos // 2, n),
sub AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM lv WHERE n = 1),
up(level, pos, n, h) AS (SELECT 0, pos, n, subroot FROM sub UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY level, pos // 2, n),
sib AS (SELECT p.r, 0 AS part, s.level, s.h FROM p JOIN lv s ON s.tree = p.tree AND s.pos = xor(p.pos // (2 ** s.level)::BIGINT, 1) AND s.n > 1
  UNION ALL SELECT p.r, 1, s.level, s.h FROM p JOIN sub USING (tree) JOIN up s ON s.pos = xor(sub.pos // (2 ** s.level)::BIGINT, 1) AND s.n > 1),
proof AS (SELECT r, sha256(string_agg(h, '' ORDER BY part, level)) AS proof FROM sib GROUP BY r),
low(r, tree, level, pos, n, h) AS (SELECT r, tree, 0, pos, n, coalesce(other, leaf) FROM p UNION ALL {_step("lv", "s.tree = f.tree").format("low")}),
high(r, tree, level, pos, n, h) AS (SELECT low.r, low.tree, 0, sub.pos, sub.n, low.h FROM low JOIN sub USING (tree) WHERE low.n = 1
  UNION ALL {_step("up", "true").format("high")})
SELECT p.doc_id, p.leaf, sub.subroot, root.h AS root, coalesce(proof.proof, sha256('')) AS proof_sha256, high.h AS folded_root, high.h = root.h AS verified
FROM p JOIN sub USING (tree) JOIN high ON high.r = p.r AND high.n = 1 LEFT JOIN proof ON proof.r = p.r, (SELECT h FROM up WHERE n = 1) root
"""

_FEATURES = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OCTETS = "list_transform(range(1, strlen(w) + 1), lambda i: ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::BIGINT)"
OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_FEATURES.format("text")} AS ws FROM documents),
f AS (SELECT r, unnest(ws) AS w FROM d),
b AS (SELECT unnest({_FEATURES.format("text")}) AS w FROM benchmark),
v AS (SELECT w, {_crc32(_OCTETS)} % 10000 AS k FROM (SELECT w FROM f UNION SELECT w FROM b)),
s AS (SELECT k, count(*) AS s FROM f JOIN v USING (w) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM b JOIN v USING (w) GROUP BY k),
g AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM f) + 10000.0::DOUBLE)
        / ((s + 1.0::DOUBLE) * ((SELECT count(*) FROM b) + 10000.0::DOUBLE))))::BIGINT AS gain FROM s LEFT JOIN t USING (k)),
w AS (SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN v USING (w) JOIN g USING (k) GROUP BY r),
x AS (SELECT d.r, d.doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
        + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM d LEFT JOIN w USING (r)),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM x WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM x LEFT JOIN o USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_mix": OP3, "op4_quality": OP4, "op5_substring": OP5, "op9_near_dedup": OP9, "op10_warc": OP10,
            "op11_exact_dedup": OP11, "op12_merkle": OP12, "op13_resample": OP13}
