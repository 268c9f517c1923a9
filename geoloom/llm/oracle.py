"""What the queries of this subpackage return, in DuckDB's SQL, where SQL can say it: by brute force over all rows."""

from __future__ import annotations

import re

from . import media
from .licenses import BASE, TEMPLATES, compiled

#: Components of links (a, b) both ways, as component (node, component): the least node reachable.
_COMPONENTS = """reached(node, other) AS (SELECT a, b FROM both_ways UNION SELECT r.node, l.b FROM reached r JOIN both_ways l ON r.other = l.a),
component AS (SELECT node, least(node, min(other)) AS component FROM reached GROUP BY node)"""

JACCARD = rf"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0),
sets AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS s FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY digest) AS rep FROM (SELECT doc_id, md5(string_agg(s::VARCHAR, ',' ORDER BY s)) AS digest FROM sets GROUP BY doc_id)),
own AS (SELECT sets.* FROM sets JOIN classes USING (doc_id) WHERE doc_id = rep),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM own x JOIN own y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
{_COMPONENTS}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, rep, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN classes USING (doc_id) LEFT JOIN component ON node = rep"""

COSINE = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS MATERIALIZED (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS l FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e) WHERE list_dot_product(x.e, y.e) / (x.l * y.l) >= 0.93),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
{_COMPONENTS}, degree AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept FROM v LEFT JOIN degree ON a = vec_id LEFT JOIN component ON node = vec_id"""

#: The table of CRC-32, by eight steps of the polynomial.
_CRC_TABLE = "crc_table AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b)))"


def _bytes(hexed: str) -> str:
    """The numbers of pairs of hexadecimal digits."""
    return f"list_transform(string_split(rtrim(regexp_replace({hexed}, '(..)', '\\1 ', 'g')), ' '), lambda h: ('0x' || h)::BIGINT)"


def _crc(numbers: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {numbers}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"


#: CRC-32 of texts as crcs (row, doc_id, text, crc), byte by byte.
_CRC = f"""{_CRC_TABLE},
bytes AS (SELECT row_number() OVER () AS row, doc_id, text, CASE WHEN text = '' THEN []::BIGINT[] ELSE {_bytes("hex(encode(text))")} END AS v FROM documents),
crcs AS (SELECT row, doc_id, text, CASE WHEN text IS NOT NULL THEN {_crc("v")} END AS crc FROM bytes, crc_table)"""

#: Longest processing time, one unit a step: the loads of the shards are a list, the least of them takes the next unit.
LPT = f"""WITH RECURSIVE {_CRC},
sized AS (SELECT row, doc_id, crc, coalesce(strlen(text), 0) + 16 AS size, sha256(text) AS g FROM crcs),
groups AS (SELECT g, sum(size) AS size, coalesce(('0x' || g[1:4])::BIGINT, 0) AS bundle FROM sized GROUP BY g),
kinds AS (SELECT *, size >= greatest(1, (SELECT sum(size) FROM sized) // (40 * 1024)) AS alone FROM groups),
units AS (SELECT row_number() OVER (ORDER BY size DESC, kind, name, bundle) AS i, * FROM (SELECT CASE WHEN alone THEN 0 ELSE 1 END AS kind, CASE WHEN alone THEN coalesce(g, '') ELSE '' END AS name, CASE WHEN alone THEN 0 ELSE bundle END AS bundle, CAST(sum(size) AS BIGINT) AS size FROM kinds GROUP BY ALL)),
steps AS (SELECT 0::BIGINT AS i, list_transform(range(40), lambda x: 0::BIGINT) AS loads, 0::INT AS shard
  UNION ALL SELECT u.i, list_concat(list_concat(loads[1:p - 1], [loads[p] + size]), loads[p + 1:]), (p - 1)::INT FROM (SELECT *, list_position(loads, list_min(loads)) AS p FROM steps) s JOIN units u ON u.i = s.i + 1),
placed AS (SELECT sized.*, shard FROM sized JOIN kinds k ON sized.g IS NOT DISTINCT FROM k.g JOIN units u ON u.kind = CASE WHEN alone THEN 0 ELSE 1 END AND u.name = CASE WHEN alone THEN coalesce(k.g, '') ELSE '' END AND u.bundle = CASE WHEN alone THEN 0 ELSE k.bundle END JOIN steps USING (i))
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY ('0x' || md5(doc_id::VARCHAR)[1:4])::INT % 256, doc_id, crc, size) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM placed"""


def _rounded(level: int, rows: str, key: str) -> str:
    """One level of the reduction tree over rows (doc_id, p, size, h, part, source), a row a step in each key: `settled` has what is decided, left{level} what stays fractional."""
    return f"""
in{level} AS (SELECT *, {key} AS k, row_number() OVER (PARTITION BY {key} ORDER BY h, size, doc_id) AS rn FROM {rows}),
step{level} AS (SELECT k, rn, doc_id AS a, p, size::DOUBLE AS s, h, []::STRUCT(id BIGINT, p DOUBLE)[] AS done FROM in{level} WHERE rn = 1
  UNION ALL SELECT k, rn, CASE WHEN a IS NULL OR open_b THEN b WHEN open_a THEN a END, CASE WHEN a IS NULL OR open_b THEN q2 WHEN open_a THEN p2 END, CASE WHEN a IS NULL OR open_b THEN t WHEN open_a THEN s END, CASE WHEN a IS NULL OR open_b THEN g WHEN open_a THEN h END,
    CASE WHEN a IS NULL THEN [] ELSE list_filter([{{id: a, p: p2}}, {{id: b, p: q2}}], lambda x: x.p <= 0 OR x.p >= 1) END
  FROM (SELECT *, p2 > 0 AND p2 < 1 AS open_a, q2 > 0 AND q2 < 1 AS open_b FROM
    (SELECT *, CASE WHEN to_first THEN CASE WHEN (1 - p) * s <= q * t THEN 1.0 ELSE p + up / s END ELSE CASE WHEN p * s <= (1 - q) * t THEN 0.0 ELSE p - down / s END END::DOUBLE AS p2,
      CASE WHEN a IS NULL THEN q WHEN to_first THEN CASE WHEN (1 - p) * s <= q * t THEN q - up / t ELSE 0.0 END ELSE CASE WHEN p * s <= (1 - q) * t THEN q + down / t ELSE 1.0 END END::DOUBLE AS q2 FROM
      (SELECT *, u * (up + down) < down AS to_first FROM
        (SELECT n.k, n.rn, a, z.p, s, z.h, n.doc_id AS b, n.p AS q, n.size::DOUBLE AS t, n.h AS g, least((1 - z.p) * s, n.p * n.size) AS up, least(z.p * s, (1 - n.p) * n.size) AS down, {_uniform("z.h || '/' || n.h")} AS u
          FROM step{level} z JOIN in{level} n ON n.k = z.k AND n.rn = z.rn + 1))))),
left{level} AS (SELECT doc_id, z.p, size, h, part, source FROM (SELECT a, p FROM step{level} QUALIFY rn = max(rn) OVER (PARTITION BY k)) z JOIN frac ON doc_id = a)"""


def _uniform(pair: str) -> str:
    return f"('0x' || md5({pair})[1:13])::BIGINT / 4503599627370496::DOUBLE"


_NAME = "coalesce('s' || source, 'n')"
MIX = rf"""WITH RECURSIVE docs AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM sources),
ranked AS (SELECT *, row_number() OVER o AS rank, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS share
  FROM weighed WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
targets AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(share, rank) FROM ranked WHERE share <= cap / w), 'inf'::DOUBLE) * w) AS target FROM ranked),
means AS (SELECT d.*, source_size, target, CASE WHEN size > 0 THEN target / source_size ELSE 0 END AS mean, ('0x' || md5(doc_id || '|0')[1:15])::BIGINT AS h FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
drawn AS (SELECT *, floor(mean) AS base, mean - floor(mean) AS p, h % 4096 AS part FROM means),
frac AS (SELECT doc_id, p, size, h, part, source FROM drawn WHERE p > 0 AND p < 1),
{_rounded(1, "frac", f"part || '/' || {_NAME}")},
{_rounded(2, "left1", f"(part % 64) || '/' || {_NAME}")},
{_rounded(3, "left2", _NAME)},
settled AS (SELECT unnest(done, recursive := true) FROM (SELECT done FROM step1 UNION ALL SELECT done FROM step2 UNION ALL SELECT done FROM step3) UNION ALL SELECT doc_id, CASE WHEN {_uniform("h || '/1'")} < p THEN 1.0 ELSE 0.0 END FROM left3),
copied AS (SELECT drawn.*, CAST(base + coalesce(settled.p, drawn.p) AS INT) AS copies FROM drawn LEFT JOIN settled ON id = doc_id)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, source, copies FROM copied"""


def _as_regex(template: str) -> str:
    """A template as a regular expression over words that a blank follows each."""
    out = []
    for token in re.findall(r"\[|\]|\||\{\d+\}|[^\s\[\]|{}]+", template):
        out.append({"[": "(?:", "]": ")?", "|": "|"}.get(token) or (f"(?:[^ ]+ ){{0,{token[1:-1]}}}" if token[0] == "{" else f"{token} "))
    return "^" + "".join(out)


#: Words that a match may be long, so many of a text are looked at from each place where one may begin.
_MATCH = 400
_SCANNED = [(label, template, base) for of, base in ((BASE, True), (TEMPLATES, False)) for label, found in of.items() for template in ([found] if base else found)]
_FIRST = sorted({w.decode() for label, template, _ in _SCANNED for w in compiled(label, template).first_words()})
LICENSES = rf"""WITH words AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words),
starts AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + {_MATCH}], ' ') || ' ' AS s FROM places WHERE w[i] IN ({", ".join(f"'{w}'" for w in _FIRST)})),
matches AS MATERIALIZED (SELECT doc_id, i, label, base, len(string_split(rtrim(m), ' ')) AS n FROM ({" UNION ALL ".join(f"SELECT doc_id, i, '{label}' AS label, {base} AS base, regexp_extract(s, '{_as_regex(template)}') AS m FROM starts" for label, template, base in _SCANNED)}) WHERE m <> ''),
covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM matches) GROUP BY doc_id),
told AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(i - 1) FILTER (base) AS first_word, max(i - 1) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM matches GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN len(w) > 0 THEN coalesce(c.n, 0) / len(w)::DOUBLE ELSE 0.0 END AS score
FROM words LEFT JOIN told USING (doc_id) LEFT JOIN covered c USING (doc_id)"""


def _doubled(level: int) -> str:
    """The gear hash over windows twice as long as those of the level before."""
    w = 1 << level
    return f"h{level + 1} AS (SELECT * EXCLUDE (h), list_transform(range(1, n + 1), lambda i: (h[i] + CASE WHEN i > {w} THEN h[i - {w}] << {w} ELSE 0 END) & 4294967295) AS h FROM h{level})"


def _little(value: str, size: int) -> str:
    return "printf('" + "%02x" * size + "', " + ", ".join(f"({value} >> {8 * i}) & 255" for i in range(size)) + ")"


MEDIA = f"""WITH RECURSIVE {_CRC_TABLE},
texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
padded AS (SELECT *, rpad(x, 2 * n::INT, '0') AS p FROM (SELECT *, greatest({media.BLOCK}, ceil(n_bytes / {media.BLOCK}.0)::BIGINT * {media.BLOCK}) AS n FROM texts)),
numbers AS MATERIALIZED (SELECT row, doc_id, n_bytes, n, p, {_bytes("p")} AS v FROM padded),
h0 AS (SELECT row, n, list_transform(v, lambda b: ([{", ".join(map(str, media._GEAR.tolist()))}])[b + 1]::BIGINT) AS h FROM numbers),
{", ".join(_doubled(i) for i in range(5))},
marks AS MATERIALIZED (SELECT row, n, list_filter(range(1, n + 1), lambda i: h[i] < {1 << 32 - media.BITS}) AS m FROM h5),
cuts AS (SELECT row, n, m, 0::BIGINT AS lo, CASE WHEN n <= {media.MIN} THEN n ELSE least(coalesce(list_min(list_filter(m, lambda x: x >= {media.MIN})), n), {media.MAX}, n) END::BIGINT AS hi, 0 AS seq FROM marks
  UNION ALL SELECT row, n, m, hi, CASE WHEN n - hi <= {media.MIN} THEN n ELSE least(coalesce(list_min(list_filter(m, lambda x: x >= hi + {media.MIN})), n), hi + {media.MAX}, n) END, seq + 1 FROM cuts WHERE hi < n),
chunks AS MATERIALIZED (SELECT row, seq, hi - lo AS size, sha256(unhex(substr(p, (2 * lo + 1)::BIGINT, (2 * (hi - lo))::BIGINT)))[1:32] AS digest FROM cuts JOIN numbers USING (row)),
lists AS (SELECT row, count(*) AS k, count(*) FILTER (uses > 1) AS shared, string_agg(digest || {_little("size", 4)}, '' ORDER BY seq) AS d FROM (SELECT *, count(*) OVER (PARTITION BY digest) AS uses FROM chunks) GROUP BY row),
media AS (SELECT *, unhex('{media.MAGIC.hex()}' || {_little("n_bytes", 8)} || {_little("k", 4)} || d || p) AS stored FROM numbers JOIN lists USING (row)),
seen AS (SELECT row, sum(c)::BIGINT AS n, sum(b * c)::BIGINT AS s, sum(b * b * c)::BIGINT AS q, abs(sum(c / total * log2(c / total))) AS e FROM (SELECT row, b, count(*)::DOUBLE AS c, sum(count(*)) OVER (PARTITION BY row)::DOUBLE AS total FROM (SELECT row, unnest(v) AS b FROM numbers) GROUP BY row, b) GROUP BY row)
SELECT doc_id, n_bytes, media.n AS payload_bytes, sha256(unhex(p)) AS payload_sha256, {_crc(f"v[-{media.BLOCK}:]")} AS tail_crc32, octet_length(stored) AS media_bytes, sha256(stored) AS media_sha256,
  printf('%.4f', seen.s / media.n::DOUBLE) || '|' || printf('%.4f', sqrt((media.n * seen.q - seen.s * seen.s)::DOUBLE / (media.n * media.n))) || '|' || printf('%.4f', e) || '|' || len(list_filter(range(1, media.n), lambda i: v[i] <> v[i + 1])) AS feature,
  k::INT AS n_chunks, shared::INT AS n_shared FROM media JOIN seen USING (row), crc_table"""
