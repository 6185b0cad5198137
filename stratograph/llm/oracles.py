"""SQL for the training-data queries that SQL can say at the size of the correctness check.

Language ID, retrieval, the placing of shards, BPE and byte windows are held by tests instead."""

from __future__ import annotations

import random

from .mixing import SHARE, WEIGHTS

#: The random offset of seed 17, a multiple of 2^-20.
_OFFSET = random.Random(17).randrange(1, 1 << 20) / (1 << 20)

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MIXING = f"""
WITH d AS (SELECT doc_id, source, coalesce(len({_WORDS}), 0) AS size, md5(doc_id::VARCHAR) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, {list(map(float, WEIGHTS))}[1 + ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)})::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * {SHARE}::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM k WINDOW o AS (ORDER BY cap / w, source IS NULL, source)),
t AS (SELECT source, source_size, least(cap, max(level) OVER () * w) AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY length(bin(d.size)) * 32 + floor(d.size / pow(2, greatest(0, length(bin(d.size)) - 5)))::INT, ('0x' || h[1:2])::INT, d.doc_id) AS rn
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, size * (floor(rn * rate + {_OFFSET!r}::DOUBLE) - floor((rn - 1) * rate + {_OFFSET!r}::DOUBLE))::BIGINT AS taken FROM r
"""

_REACH = """reach AS (SELECT id, id AS to_id FROM nodes UNION SELECT reach.id, link.b FROM reach JOIN link ON link.a = reach.to_id)"""

NGRAM_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id AS id, count(s) AS n FROM documents LEFT JOIN g USING (doc_id) GROUP BY 1),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y USING (s) WHERE x.doc_id < y.doc_id GROUP BY 1, 2),
near AS (SELECT a, b FROM pair JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * k >= 90 * (p.n + q.n - k)),
link AS (SELECT a, b FROM near UNION SELECT b, a FROM near), nodes AS (SELECT id FROM n), {_REACH}
SELECT id AS doc_id, any_value(n) AS n_shingles, min(to_id) AS component_id FROM reach JOIN n USING (id) GROUP BY id
"""

EMBEDDINGS = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
near AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id < y.id WHERE list_cosine_similarity(x.v, y.v) >= 0.95),
link AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near), nodes AS (SELECT id FROM v), {_REACH}
SELECT id AS vec_id, (SELECT count(*) FROM link WHERE a = id) AS n_links, min(to_id) AS component_id, id = min(to_id) AS kept FROM reach GROUP BY id
"""

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM w WHERE len(w) >= 20)),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS nth FROM win) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, p + o AS i FROM rep, (SELECT unnest(range(20)) AS o)),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, coalesce(len(w.w), 0)::BIGINT AS n_words, (SELECT count(*) FROM gone WHERE gone.doc_id = w.doc_id) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

CHAT = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
  length('<|im_start|>') + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<|nl|>')) + 1 + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length('<|im_end|>') + 1 AS size FROM t),
c AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR i = n)::BIGINT AS formatted_chars FROM c GROUP BY conv_id
"""

HISTORY = """
WITH c AS (SELECT doc_id, source, j, ('0x' || sha256(doc_id::VARCHAR || ':' || j::VARCHAR)[1:12])::BIGINT AS h FROM documents, (VALUES (0), (1)) t(j) WHERE doc_id IS NOT NULL),
e AS (SELECT doc_id - doc_id % 10 AS k, h % 60 AS s, (h // 1000) % 10 BETWEEN 2 AND 4 AS late, (h // 1000) % 10 < 2 AS gone, source AS v, row_number() OVER (ORDER BY h, doc_id, j, source NULLS FIRST) AS n FROM c),
p AS (SELECT k, d, max(n) FILTER (WHERE late AND d BETWEEN s AND s + 9) AS cn, max(s * 1000000000000 + n) FILTER (WHERE NOT late AND s <= d) % 1000000000000 AS bn
  FROM e, (SELECT unnest(range(80)) AS d) GROUP BY k, d),
q AS (SELECT p.k, d, v FROM p JOIN e ON e.n = coalesce(cn, bn) WHERE NOT gone),
r AS (SELECT *, sum(CASE WHEN d - 1 = pd AND v IS NOT DISTINCT FROM pv THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY d) AS version
  FROM (SELECT *, lag(d) OVER w AS pd, lag(v) OVER w AS pv FROM q WINDOW w AS (PARTITION BY k ORDER BY d)))
SELECT k AS doc_id, version::INT AS version, min(d) AS valid_from, CASE WHEN max(d) < 79 THEN max(d) + 1 END AS valid_to, any_value(v) AS value FROM r GROUP BY k, version
"""


def _lloyd(k: int, rounds: int, dim: int, scale: int) -> str:
    """Rounds of Lloyd, every vector compared with every centroid."""
    finite = "len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
    out = [f"v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(v, lambda x: floor({scale} * x)::BIGINT) AS x FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) WHERE len(v) = {dim} AND {finite})"]
    out.append(f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR), x) - 1 AS c, x AS y FROM v QUALIFY c < {k})")
    for i in range(rounds + 1):
        far = "list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
        out.append(f"a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, min((d, c)) AS near FROM (SELECT r, vec_id, c, {far} AS d FROM v, c{i}) GROUP BY r)")
        if i < rounds:
            mean = f"m{i} AS MATERIALIZED (SELECT c, list(m ORDER BY p) AS y FROM (SELECT near[2] AS c, p, sum(x[p]) // count(*) - CASE WHEN sum(x[p]) % count(*) < 0 THEN 1 ELSE 0 END AS m FROM a{i} JOIN v USING (r), (SELECT unnest(range(1, {dim + 1})) AS p) GROUP BY 1, 2) GROUP BY c)"
            out += [mean, f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.y, c{i}.y) AS y FROM c{i} LEFT JOIN m{i} USING (c))"]
    last = f"SELECT vec_id, c::INT AS cluster, near[1] AS distance, sum(near[1]) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(near[1]) OVER ()::BIGINT AS inertia, sha256(array_to_string(y, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c = near[2]"
    return f"WITH {', '.join(out)} {last}"


CENTROIDS = _lloyd(16, 3, 64, 64)

SEARCH = """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(v, lambda x: floor(1024 * x)) AS x FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
  WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)
SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.r ORDER BY list_inner_product(q.x, c.x) DESC, c.vec_id)::INT AS rank, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.r <> c.r AND len(q.x) = len(c.x) QUALIFY rank <= 10
"""
