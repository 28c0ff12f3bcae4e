"""SQL that gives the rows of the registered queries, where SQL can express them.

Not there: packing by token ids, the classifier and the random field, which no SQL states.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

_BLANK = r"[\x20\x09-\x0D]+"

ORACLES["op2_line_frequency"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, source FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '{_BLANK}'), lambda x: x <> '') AS words FROM d),
windows AS (
    SELECT r, i, words[i:i+4] AS win FROM (
        SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM windows) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r),
split AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (
    SELECT r, count(*) - count(DISTINCT line) AS n FROM split
    WHERE regexp_replace(line, '{_BLANK}', '', 'g') <> '' GROUP BY r),
own AS (
    SELECT DISTINCT d.r, d.doc_id, d.source, d.text,
        trim(regexp_replace(lower(line), '{_BLANK}', ' ', 'g')) AS line
    FROM split JOIN d USING (r)),
lines AS (SELECT * FROM own WHERE line <> ''),
texts AS (SELECT source, line, text, min(doc_id) AS id FROM lines GROUP BY ALL),
counts AS (SELECT source, line, count(*) AS n, arg_min(text, id) AS first FROM texts GROUP BY ALL),
hosts AS (SELECT source, count(DISTINCT text) AS n FROM documents WHERE text IS NOT NULL GROUP BY source),
frequent AS (
    SELECT c.* FROM counts c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source
    WHERE c.n > 20 AND 100 * c.n > 2 * h.n),
cut AS (
    SELECT r, sum(len(string_split(l.line, ' '))) AS n FROM lines l
    JOIN frequent f ON l.line = f.line AND l.source IS NOT DISTINCT FROM f.source AND l.text <> f.first
    GROUP BY r),
m AS (
    SELECT doc_id, len(words)::BIGINT AS n_words,
        length(regexp_replace(text, '{_BLANK}', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
        coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
        coalesce(cut.n, 0)::BIGINT AS n_cut_words
    FROM w LEFT JOIN covered USING (r) LEFT JOIN dup USING (r) LEFT JOIN cut USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_words - n_cut_words AS rest FROM m)
SELECT * EXCLUDE (rest), NOT base_failed
    AND NOT (n_cut_words > 0 AND (rest < 10 OR 100 * rest < 30 * n_words)) AS kept
FROM f
"""

ORACLES["op4_perspectives"] = """
WITH m AS (
    SELECT DISTINCT conv_id, turn, replace(coalesce(text, ''), '<|', '< |') AS text,
        coalesce(nullif(trim(replace(role, '<|', '< |')), ''), 'unknown') AS speaker
    FROM conversations),
v AS (
    SELECT m.*, p.perspective, floor(turn / 256.0) AS stretch, speaker = p.perspective AS own,
        CASE WHEN speaker = 'system' THEN '<|im_start|>system' || chr(10)
            WHEN speaker = p.perspective THEN '<|im_start|>assistant' || chr(10)
            ELSE '<|im_start|>user name=' || speaker || chr(10) END AS header
    FROM m JOIN (SELECT DISTINCT conv_id, speaker AS perspective FROM m WHERE speaker <> 'system') p
        ON m.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (
    SELECT *, header || text || '<|im_end|>' || chr(10) AS piece,
        sum(length(header || text) + 11) OVER (
            PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text) AS upto
    FROM v)
SELECT conv_id, perspective,
    (row_number() OVER (PARTITION BY conv_id, perspective ORDER BY stretch NULLS FIRST) - 1)::INTEGER AS part,
    min(upto - length(piece))::BIGINT AS char_start, count(*)::INTEGER AS n_turns,
    string_agg(piece, '' ORDER BY turn NULLS FIRST, speaker, text) AS rendered,
    coalesce(string_agg(CASE WHEN own THEN (upto - length(piece) + length(header)) || ':' || (upto - 1) END,
        ',' ORDER BY turn NULLS FIRST, speaker, text), '') AS mask
FROM o GROUP BY conv_id, perspective, stretch
"""

# The map is dealt by a fold over the 4096 slots, as a recursive query; CRC-32 is one over
# the bytes of each text, with its table made by rule.
ORACLES["op6_virtual_slots"] = """
WITH RECURSIVE
bits(n, k, c) AS (
    SELECT range, 0, range::UBIGINT FROM range(256)
    UNION ALL
    SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END
    FROM bits WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
        ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:8])::UBIGINT::BIGINT AS hash FROM documents),
p AS (SELECT *, strlen(text) + 1 AS size, hash % 4096 AS vslot FROM d),
sizes AS (SELECT s.range AS vslot, coalesce(sum(size), 0)::BIGINT AS bytes FROM range(4096) s LEFT JOIN p ON p.vslot = s.range GROUP BY 1),
ordered AS MATERIALIZED (SELECT list({v: vslot, b: bytes} ORDER BY bytes DESC, vslot) AS l FROM sizes),
deal(i, vslot, shard, loads) AS (
    SELECT 0, -1::BIGINT, -1, list_transform(range(16), lambda x: 0::BIGINT)
    UNION ALL
    SELECT i + 1, l[i + 1].v, list_position(loads, list_min(loads))::INTEGER - 1,
        list_transform(loads, lambda x, k: CASE WHEN k = list_position(loads, list_min(loads)) THEN x + l[i + 1].b ELSE x END)
    FROM deal, ordered WHERE i < 4096),
crc AS (
    SELECT r, xor(4294967295::UBIGINT, list_reduce(
        list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::UBIGINT)),
        lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT]))) AS crc FROM d, tab)
SELECT doc_id, size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY vslot, hash, doc_id, crc, size) - 1 AS slot,
    NULL::INTEGER AS grown_shard, vslot
FROM p JOIN crc USING (r) JOIN deal USING (vslot)
"""

ORACLES["op8_range_join"] = r"""
WITH rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
    ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p AS (
    SELECT row_number() OVER () AS r, page_id,
        CASE WHEN contains(url, '://') THEN url[position('://' IN url) + 3:] ELSE '' END AS rest FROM pages),
q AS (
    SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM p),
best AS (
    SELECT r, arg_max({rule: u.host || u.path, verdict: u.verdict}, length(u.host || u.path) * 1000 + length(u.host)) AS b
    FROM q JOIN rules u ON (q.host = u.host OR ends_with(q.host, '.' || u.host)) AND starts_with(q.path, u.path)
    GROUP BY r)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict FROM q LEFT JOIN best USING (r)
"""

ORACLES["op1_hyperminhash"] = rf"""
WITH RECURSIVE
w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_BLANK}'),
        lambda x: x <> '') AS words FROM documents),
s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) < 2 THEN [words]
        ELSE list_transform(range(1, len(words)), lambda i: words[i:i+1]) END) AS g
    FROM w WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
    FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM both_ JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id
    WHERE 100 * c >= 80 * (x.n + y.n - c)),
sym AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM sym UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles,
    coalesce(least(d.doc_id, r.m), d.doc_id) AS component_id, coalesce(r.m, d.doc_id) >= d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) r USING (doc_id)
"""

ORACLES["op9_wu_manber"] = r"""
WITH lowered AS (
    SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (
    SELECT kind, id, row_number() OVER () AS r, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM lowered),
wins AS (
    SELECT DISTINCT id AS item, win, len(win) AS m FROM (
        SELECT id, unnest(list_transform(range(1, greatest(len(words) - 9, 1) + 1), lambda i: words[i:i+9])) AS win
        FROM w WHERE kind = 'b' AND len(words) > 0 AND id IS NOT NULL)),
spots AS (
    SELECT r, i, m, words[i:i + m - 1] AS win FROM (
        SELECT r, words, m, unnest(range(1, len(words) - m + 2)) AS i
        FROM w, (SELECT DISTINCT m FROM wins) WHERE kind = 'd' AND len(words) >= m)),
hits AS MATERIALIZED (SELECT r, i, spots.m AS m, item FROM spots JOIN wins USING (win)),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hits) GROUP BY r),
items AS (
    SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS l
    FROM (SELECT DISTINCT r, item::VARCHAR AS item FROM hits) GROUP BY r)
SELECT id AS doc_id, len(words)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit,
    coalesce(i.n, 0)::BIGINT AS n_items, sha256(coalesce(i.l, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM w LEFT JOIN covered c USING (r) LEFT JOIN items i USING (r) WHERE kind = 'd'
"""

ORACLES["op10_line_join"] = rf"""
WITH s AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS k
    FROM documents),
t AS (
    SELECT doc_id, k, list_distinct(list_filter(regexp_split_to_array(
        translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_BLANK}'), lambda x: x <> '')) AS l FROM s),
sets AS (SELECT list_sort(l) AS l, len(l) AS n, min((doc_id, k)) AS first FROM t WHERE len(l) > 0 GROUP BY 1, 2),
ids AS MATERIALIZED (SELECT row_number() OVER () AS r, * FROM sets),
tokens AS MATERIALIZED (SELECT r, n, unnest(l) AS w FROM ids),
freq AS (SELECT w, count(*) AS f FROM tokens GROUP BY w),
prefix AS MATERIALIZED (
    SELECT r, n, w FROM (
        SELECT r, n, w, row_number() OVER (PARTITION BY r ORDER BY f, w) AS p FROM tokens JOIN freq USING (w))
    WHERE p <= n - ceil(80 * n / 100.0) + 1),
pairs AS (
    SELECT DISTINCT a.r AS a, b.r AS b FROM prefix a JOIN prefix b USING (w)
    WHERE a.r <> b.r AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
matches AS (
    SELECT x.r AS r, min(y.first) AS earliest FROM pairs JOIN ids x ON a = x.r JOIN ids y ON b = y.r
    WHERE 100 * len(list_intersect(x.l, y.l)) >= 80 * (x.n + y.n - len(list_intersect(x.l, y.l))) GROUP BY x.r),
gone AS (
    SELECT DISTINCT t.doc_id, t.k FROM t JOIN ids ON list_sort(t.l) = ids.l LEFT JOIN matches m ON m.r = ids.r
    WHERE (t.doc_id, t.k) > least(ids.first, coalesce(m.earliest, ids.first)))
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines,
    coalesce(g.n, 0)::BIGINT AS n_removed, coalesce(g.l, '') AS removed
FROM documents d LEFT JOIN (
    SELECT doc_id, count(*) AS n, string_agg(k::VARCHAR, ',' ORDER BY k) AS l FROM gone GROUP BY doc_id) g USING (doc_id)
"""

ORACLES["op12_multi_index"] = r"""
WITH RECURSIVE r AS (SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
good AS (
    SELECT * FROM r WHERE vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL
    AND coalesce(list_bool_and(list_transform(v, lambda x: x IS NOT NULL AND isfinite(x))), true)
    AND coalesce(list_bool_or(list_transform(v, lambda x: x IS NOT NULL AND x <> 0)), false)),
dim AS (SELECT len(v) AS d FROM good GROUP BY 1 ORDER BY count(*) DESC, d DESC LIMIT 1),
ok AS (SELECT good.* FROM good JOIN dim ON len(v) = d),
pairs AS (
    SELECT a.rid AS a, b.rid AS b FROM ok a JOIN ok b ON a.label = b.label AND a.rid <> b.rid
    WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.93),
links AS (SELECT a AS rid, count(*) AS n FROM pairs GROUP BY a),
reach(rid, c) AS (
    SELECT rid, vec_id FROM ok
    UNION
    SELECT p.b, reach.c FROM reach JOIN pairs p ON reach.rid = p.a),
comp AS (SELECT rid, min(c) AS c FROM reach GROUP BY rid)
SELECT r.vec_id, coalesce(links.n, 0)::BIGINT AS n_links,
    coalesce(comp.c, r.vec_id)::BIGINT AS component_id,
    coalesce(r.vec_id = coalesce(comp.c, r.vec_id), false) AS kept
FROM r LEFT JOIN links USING (rid) LEFT JOIN comp USING (rid)
"""
