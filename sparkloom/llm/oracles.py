"""DuckDB SQL for the operators' queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK, _ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str, pattern: str) -> str:
    return f"coalesce(regexp_extract_all({text}, '{pattern}'), [])"


def _lower(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


def _components(links: str, a: str, b: str) -> str:
    """CTEs for (node, low): the smallest node reachable over the links."""
    return f"""e AS (SELECT {a} AS x, {b} AS y FROM {links} UNION SELECT {b}, {a} FROM {links}),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
low AS (SELECT x AS node, least(x, min(y)) AS low FROM r GROUP BY x)"""


EMBEDDINGS = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS u FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
bad AS (SELECT DISTINCT vec_id FROM (SELECT vec_id, unnest(u) AS c FROM v) WHERE c IS NULL OR NOT isfinite(c)),
z AS (SELECT * FROM v WHERE vec_id NOT IN (SELECT vec_id FROM bad) AND list_inner_product(u, u) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM z a JOIN z b ON a.vec_id < b.vec_id AND len(a.u) = len(b.u) WHERE list_cosine_similarity(a.u, b.u) >= 0.95),
{_components('l', 'a', 'b')}, n AS (SELECT x, count(*) AS n FROM e GROUP BY x)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(low, vec_id) AS component_id, vec_id = coalesce(low, vec_id) AS kept FROM embeddings LEFT JOIN low ON vec_id = node LEFT JOIN n ON vec_id = x"""

REPEATS = f"""WITH d AS (SELECT doc_id, {_words('text', _BLANK)} AS w FROM documents),
g AS (SELECT doc_id, k, array_to_string(w[k:k + 19], ' ') AS g FROM d, unnest(range(1, len(w) - 18)) t(k)),
f AS (SELECT doc_id, k, row_number() OVER (PARTITION BY g ORDER BY doc_id, k) AS place FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS p FROM f WHERE place > 1),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) AS text FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) x ANTI JOIN c ON x.doc_id = c.doc_id AND x.p = c.p GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""

LEAKS = f"""WITH d AS (SELECT doc_id, {_words(_lower('text'), _ALNUM)} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words(_lower('text'), _ALNUM)} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS g FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(k) WHERE len(w) > 0),
dw AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM bw), unnest(range(1, len(w) - n + 2)) t(k)),
h AS (SELECT doc_id, k, n, item FROM dw JOIN bw USING (n, g)),
p AS (SELECT doc_id, count(DISTINCT p) AS hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY 1),
i AS (SELECT doc_id, count(DISTINCT item) AS items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM h GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)"""

JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, {_words(_lower('text'), _BLANK)} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 3], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) t(k) WHERE len(w) > 0),
s AS (SELECT doc_id, count(*) AS n, bit_xor(hash(g)) AS h, sum(hash(g) % 1000000007) AS m FROM g GROUP BY 1),
k AS (SELECT n, h, m, min(doc_id) AS node FROM s GROUP BY ALL), o AS (SELECT s.doc_id, node FROM s JOIN k USING (n, h, m)),
q AS (SELECT g.doc_id AS node, g, n FROM g JOIN k ON g.doc_id = node), l AS (SELECT a.node AS a, b.node AS b FROM q a JOIN q b ON a.g = b.g AND a.node < b.node AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 85 GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
{_components('l', 'a', 'b')}
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(low, o.node, d.doc_id) AS component_id FROM d LEFT JOIN s USING (doc_id) LEFT JOIN o USING (doc_id) LEFT JOIN low ON o.node = low.node"""

RANKED = f"""WITH d AS (SELECT doc_id, {_words(_lower('text'), _ALNUM)} AS w FROM documents), b AS (SELECT item_id, list_distinct({_words(_lower('text'), _ALNUM)}) AS w FROM benchmark),
s AS (SELECT count(*) AS nd, CAST(sum(len(w)) AS BIGINT) AS nl FROM d WHERE len(w) > 0),
q AS (SELECT item_id, unnest(w) AS t FROM b), x AS (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d),
f AS (SELECT doc_id, n, t, count(*) AS tf FROM x WHERE t IN (SELECT t FROM q) GROUP BY ALL),
g AS (SELECT t, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY t, nd),
c AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nd) // nl))))) AS BIGINT) AS score FROM q JOIN f USING (t) JOIN g USING (t), s GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM c WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10"""

NEGATIVES = """WITH e AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS u FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL),
bad AS (SELECT DISTINCT vec_id FROM (SELECT vec_id, unnest(u) AS c FROM e) WHERE c IS NULL OR NOT isfinite(c)),
v AS (SELECT vec_id, label, list_transform(u, lambda x: CAST(floor(256 * x) AS BIGINT)) AS v FROM e WHERE vec_id NOT IN (SELECT vec_id FROM bad) AND len(u) > 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER w AS INT) AS rank, n.b AS negative_id, p.score AS positive_score, n.score AS negative_score FROM p JOIN s n ON p.a = n.a AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) QUALIFY row_number() OVER w <= 10"""


def _escaped(text: str) -> str:
    return rf"regexp_replace({text}, '([<\[])(\\*)(\|\w+\|>|/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g')"


CHAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_escaped('role')}) + length({_escaped('text')}) + 24) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""
