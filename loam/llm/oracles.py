"""SQL of operators 11 to 13. crc32 has no function there: a table of 256 entries, made by its rule, is walked byte by byte."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CRC_TABLE = "crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"


def _crc(octets: str) -> str:
    """crc32 of a list of bytes, given a row of crc_table."""
    return f"xor(list_reduce([4294967295::BIGINT] || {octets}, lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"


def _field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x}::VARCHAR END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _tree(name: str, leaves: str) -> str:
    """{name}: the nodes (grp, lvl, pos, h, n) over leaves, n of a level; {name}_steps: (grp, lvl, pos, step) of each node with siblings, its own place marked @."""
    return f"""{name} AS (SELECT grp, 0 AS lvl, pos, h, n FROM {leaves} UNION ALL SELECT grp, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 15) // 16 FROM {name} WHERE n > 1 GROUP BY grp, lvl, pos // 16),
{name}_runs AS (SELECT grp, lvl, pos // 16 AS run, list(h ORDER BY pos) AS hs FROM {name} WHERE n > 1 GROUP BY grp, lvl, pos // 16),
{name}_steps AS (SELECT x.grp, x.lvl, x.pos, array_to_string(hs[1:x.pos % 16], '') || '@' || array_to_string(hs[x.pos % 16 + 2:], '') AS step FROM {name} x JOIN {name}_runs r ON x.grp = r.grp AND x.lvl = r.lvl AND x.pos // 16 = r.run)"""


# Sources are numbered in their order, so that the null one is a group like others.
OP11 = f"""WITH RECURSIVE {_CRC_TABLE}, src AS (SELECT source AS name, row_number() OVER (ORDER BY source IS NOT NULL, source) - 1 AS grp FROM (SELECT DISTINCT source FROM documents)),
d AS (SELECT doc_id, grp, {_leaf('text')} AS h, CASE WHEN doc_id IS NOT NULL AND text IS NOT NULL AND {_crc("list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % 5 = 0 THEN {_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS changed
FROM documents JOIN src ON source IS NOT DISTINCT FROM name, crc_table),
l AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id IS NOT NULL, doc_id, h) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM d),
{_tree('low', 'l')}, subs AS (SELECT grp AS source_no, h FROM low WHERE n = 1), tops AS (SELECT 0 AS grp, source_no AS pos, h, count(*) OVER () AS n FROM subs), {_tree('high', 'tops')},
way AS (SELECT l.grp, l.pos, 0 AS part, s.lvl, s.step FROM l JOIN low_steps s ON s.grp = l.grp AND s.pos = l.pos // (16 ** s.lvl)::BIGINT
UNION ALL SELECT l.grp, l.pos, 1, s.lvl, s.step FROM l JOIN high_steps s ON s.pos = l.grp // (16 ** s.lvl)::BIGINT),
steps AS (SELECT grp, pos, list(step ORDER BY part, lvl) AS s FROM way GROUP BY grp, pos),
f AS (SELECT doc_id, l.h AS leaf, subs.h AS subroot, (SELECT h FROM high WHERE n = 1) AS root, coalesce(s, []) AS s, coalesce(changed, l.h) AS begun FROM l JOIN subs ON source_no = l.grp LEFT JOIN steps USING (grp, pos)),
g AS (SELECT *, list_reduce([begun] || s, lambda a, e: sha256(replace(e, '@', a))) AS folded_root FROM f)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(s, ''), '@', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM g"""

_WORDS = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

OP12 = f"""WITH b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark), win AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS x FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), runs AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS x FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win))),
hit AS (SELECT r, k, i, item FROM runs JOIN win USING (k, x)), covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, k, i FROM hit)) GROUP BY r),
met AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(met.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated FROM d LEFT JOIN covered USING (r) LEFT JOIN met USING (r)"""

OP13 = f"""WITH {_CRC_TABLE}, d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), b AS (SELECT {_WORDS} AS w FROM benchmark),
runs AS (SELECT r, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, range(1, 4) t(n)) UNION ALL SELECT -1, array_to_string(w[i:i + n - 1], ' ') FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b, range(1, 4) t(n))),
kinds AS (SELECT x, hex(encode(x)) AS o FROM (SELECT DISTINCT x FROM runs)),
buckets AS (SELECT x, {_crc("list_transform(range(1, length(o), 2), lambda p: (strpos('123456789ABCDEF', substr(o, p, 1)) * 16 + strpos('123456789ABCDEF', substr(o, p + 1, 1)))::BIGINT)")} % 10000 AS bucket FROM kinds, crc_table),
f AS (SELECT r, bucket FROM runs JOIN buckets USING (x)), c AS (SELECT bucket, count(*) FILTER (WHERE r >= 0)::DOUBLE AS s, count(*) FILTER (WHERE r < 0)::DOUBLE AS t FROM f GROUP BY bucket), whole AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM c),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1) * (s_all + 10000)) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM c, whole),
e AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS weight FROM f JOIN gains USING (bucket) WHERE r >= 0 GROUP BY r),
o AS (SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN e USING (r)),
k AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id IS NULL, doc_id, weight, n_features) AS nth, count(*) FILTER (WHERE n_words >= 20) OVER () AS able FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND nth <= 5 * able // 100 THEN nth END AS rank FROM k"""
