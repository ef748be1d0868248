"""DuckDB SQL of the operators that SQL can express, over whole tables and whole texts."""

from .op1_decontamination import ITEM_PERCENT, MASKS, MISMATCH, SHORTEST

_WORDS = r"regexp_extract_all(coalesce({t}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(t=_LOWER.format(t="text"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS met FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM k JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id WHERE 100 * met >= 90 * (p.n + q.n - met)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.least, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN (SELECT x, min(y) AS least FROM r GROUP BY x) m ON w.doc_id = m.x
"""

OP5 = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(t="text")} AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
f AS (SELECT v, min(doc_id) AS first FROM v GROUP BY v),
g AS (SELECT DISTINCT doc_id, i + unnest(range(13)) AS i FROM v JOIN f ON v.v = f.v WHERE f.first < doc_id),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
k AS (SELECT p.doc_id, count(g.i) AS n_removed, coalesce(string_agg(CASE WHEN g.i IS NULL THEN word END, ' ' ORDER BY p.i), '') AS kept
  FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""

OP7 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host, {_WORDS.format(t="text")} AS w FROM documents),
v AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
t AS (SELECT doc_id, v FROM v GROUP BY doc_id, v HAVING count(*) > 1),
c AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT v.doc_id, i + unnest(range(3)) AS i FROM v JOIN t ON v.doc_id = t.doc_id AND v.v = t.v) GROUP BY doc_id),
ln AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT doc_id, host, line, {_WORDS.format(t="line")} AS w FROM ln),
lk AS (SELECT doc_id, host, line, len(w) AS words, CAST('0x' || substr(md5({_LOWER.format(t="array_to_string(w, ' ')")}), 1, 15) AS BIGINT) AS key FROM lw WHERE len(w) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lk GROUP BY doc_id),
one AS (SELECT doc_id, host, key, sum(words) AS words FROM lk GROUP BY ALL),
same AS (SELECT d.doc_id, d.host, coalesce(string_agg(CAST(key AS VARCHAR), ',' ORDER BY key), '') AS whole FROM d LEFT JOIN one ON d.doc_id = one.doc_id GROUP BY ALL),
hosts AS (SELECT host, count(DISTINCT whole) AS n FROM same GROUP BY host),
often AS (SELECT r.host, r.key FROM (SELECT one.host, key, count(DISTINCT whole) AS n FROM one JOIN same ON one.doc_id = same.doc_id GROUP BY ALL) r JOIN hosts h ON r.host = h.host WHERE r.n > 5 AND r.n > h.n * 0.03),
gone AS (SELECT doc_id, sum(words) AS n_removed_words FROM one JOIN often ON one.host = often.host AND one.key = often.key GROUP BY doc_id),
s AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(n_removed_words, 0) AS BIGINT) AS n_removed_words
  FROM d LEFT JOIN dup ON d.doc_id = dup.doc_id LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN gone ON d.doc_id = gone.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT *, NOT base_failed AND 100 * (n_words - n_removed_words) >= 40 * n_words AS kept FROM b
"""

_CUT = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_SEED = " UNION ALL ".join(
    f"SELECT id, i, {m} AS m, {" || ' ' || ".join(f'w[i + {k}]' for k, c in enumerate(mask) if c == '1')} AS seed FROM {{t}}i WHERE i + {len(mask) - 1} <= len(w)" for m, mask in enumerate(MASKS)
)
_AT = f"{{t}}i AS (SELECT id, w, unnest(range(1, len(w) - {SHORTEST} + 2)) AS i FROM {{t}} WHERE len(w) >= {SHORTEST}), {{t}}s AS ({_SEED})"

OP1 = f"""
WITH d AS (SELECT doc_id AS id, {_CUT} AS w FROM documents), b AS (SELECT DISTINCT item_id AS id, {_CUT} AS w FROM benchmark),
{_AT.format(t="d")}, {_AT.format(t="b")},
h AS (SELECT DISTINCT ds.id AS doc_id, bs.id AS item_id, ds.i - bs.i AS shift FROM ds JOIN bs ON ds.m = bs.m AND ds.seed = bs.seed),
c AS (SELECT h.*, len(b.w) AS n, d.w AS dw, b.w AS bw, unnest(range(greatest(1, 1 - shift), least(len(b.w), len(d.w) - shift) + 1)) AS k FROM h JOIN d ON d.id = h.doc_id JOIN b ON b.id = h.item_id),
g AS (SELECT doc_id, item_id, shift, n, k, CASE WHEN dw[k + shift] = bw[k] THEN 1 ELSE {MISMATCH} END AS gain FROM c),
p AS (SELECT *, sum(gain) OVER (PARTITION BY doc_id, item_id, shift ORDER BY k) AS up FROM g),
q AS (SELECT *, coalesce(min(up) OVER r, 0) AS low0, coalesce(arg_max(k, -up * 100000 + k) OVER r, 0) AS lowest FROM p
  WINDOW r AS (PARTITION BY doc_id, item_id, shift ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, min(k) OVER (PARTITION BY doc_id, item_id, shift) AS k0 FROM q),
s AS (SELECT doc_id, item_id, shift, n, k, gain, up - least(low0, 0) AS score, CASE WHEN low0 <= 0 AND lowest > 0 THEN lowest + 1 ELSE k0 END AS since FROM f),
e AS (SELECT doc_id, item_id, shift, n, count(CASE WHEN gain = 1 THEN 1 END) AS equal, arg_max(struct_pack(score := score, since := since, k := k), score * 100000 - k) AS x FROM s GROUP BY ALL),
o AS (SELECT doc_id, item_id, x.score AS score, x.k - x.since + 1 AS length, shift + x.since - 1 AS doc_start FROM e WHERE x.score >= least(13, n) OR 100 * equal >= {ITEM_PERCENT} * n),
short AS (SELECT id, w, len(w) AS n FROM b WHERE len(w) BETWEEN 1 AND {SHORTEST - 1}),
sizes AS (SELECT DISTINCT n FROM short),
runs AS (SELECT id AS doc_id, n, i, w[i:i + n - 1] AS run FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
t AS (SELECT doc_id, item_id, score, length, (score - {MISMATCH} * length) // {1 - MISMATCH} AS n_equal, doc_start FROM o
  UNION ALL SELECT doc_id, short.id, short.n, short.n, short.n, i - 1 FROM runs JOIN short ON run = short.w)
SELECT doc_id, item_id, CAST(y.score AS INTEGER) AS score, CAST(y.length AS INTEGER) AS length, CAST(y.n_equal AS INTEGER) AS n_equal, CAST(y.doc_start AS INTEGER) AS doc_start
FROM (SELECT doc_id, item_id, max(struct_pack(score := score, length := length, n_equal := n_equal, doc_start := doc_start)) AS y FROM t GROUP BY ALL)
"""

OP4 = "SELECT doc_id, lang, source, n_chars, length(text) AS text_chars, sha256(text) AS text_sha256 FROM documents"

ORACLES = {"op1_decontamination": OP1, "op2_jaccard_join": OP2, "op4_sharding": OP4, "op5_substring_dedup": OP5, "op7_quality_rules": OP7}
