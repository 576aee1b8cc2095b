"""SQL twins (DuckDB) of the corpus queries that SQL can express: every pair compared, every byte folded."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Components of links (a, b) over nodes (id): the least id that is reached.
_REACH = """r AS (SELECT id AS a, id AS b FROM nodes UNION SELECT r.a, e.b FROM r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) e ON e.a = r.b),
    comp AS (SELECT a AS id, min(b) AS component_id FROM r GROUP BY 1)"""

OP1 = f"""WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
    nodes AS (SELECT id, CAST(len(s) AS BIGINT) AS n FROM s), t AS (SELECT id, unnest(s) AS s FROM s),
    c AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM t x JOIN t y ON y.s = x.s AND y.id > x.id GROUP BY 1, 2),
    links AS (SELECT c.a, c.b FROM c JOIN nodes p ON p.id = c.a JOIN nodes q ON q.id = c.b WHERE 100 * c.c >= 75 * (p.n + q.n - c.c)), {_REACH}
    SELECT nodes.id AS doc_id, n AS n_shingles, component_id, component_id = nodes.id AS kept FROM nodes JOIN comp ON comp.id = nodes.id"""

OP6 = """WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM (SELECT unnest(range(256)) AS i))),
    d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
    b AS (SELECT doc_id, k, CAST(length(h) // 2 + 8 AS BIGINT) AS size, xor(list_reduce([4294967295] || list_transform(regexp_extract_all(h, '..'), lambda p: CAST('0x' || p AS BIGINT)), lambda c, p: xor(c // 256, t[xor(c % 256, p) + 1])), 4294967295) AS text_crc32 FROM d CROSS JOIN tab),
    u AS (SELECT *, list_transform(range(25), lambda i: CAST('0x' || substr(md5(CAST(i AS VARCHAR) || ':' || k), 1, 13) AS BIGINT)) AS s, CAST('0x' || substr(md5('slot:' || k), 1, 13) AS BIGINT) AS place FROM b),
    g AS (SELECT *, CAST(list_position(s[1:24], list_max(s[1:24])) - 1 AS INTEGER) AS shard, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS grown_shard FROM u)
    SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place, doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM g"""

OP8 = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), nodes AS (SELECT id FROM v),
    ok AS (SELECT id, e FROM v WHERE e IS NOT NULL AND len(e) = len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) AND len(list_filter(e, lambda x: x <> 0)) > 0),
    links AS (SELECT p.id AS a, q.id AS b FROM ok p JOIN ok q ON q.id > p.id AND list_cosine_similarity(p.e, q.e) >= 0.9), {_REACH},
    n AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY 1)
    SELECT nodes.id AS vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, component_id = nodes.id AS kept FROM nodes JOIN comp ON comp.id = nodes.id LEFT JOIN n ON n.id = nodes.id"""

OP11 = f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
    w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM p), total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
    g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w CROSS JOIN (SELECT unnest(range(1, 6)) AS k)),
    f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 100),
    c AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
    s AS (SELECT c.lang, c.phrase, c.k, c.f AS a, j, x.f AS l, y.f AS r, n, 1000::HUGEINT * c.f * n // (x.f::HUGEINT * y.f) AS score
        FROM c CROSS JOIN (SELECT unnest(range(1, 5)) AS j) JOIN f x ON x.lang = c.lang AND x.k = j AND x.phrase = array_to_string(w[1:j], ' ')
        JOIN f y ON y.lang = c.lang AND y.k = c.k - j AND y.phrase = array_to_string(w[j + 1:], ' ') JOIN total t ON t.lang = c.lang WHERE j < c.k),
    b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS pos FROM s),
    inner_ AS (SELECT DISTINCT c.lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, c.f FROM c CROSS JOIN (SELECT unnest(range(2, 5)) AS m) CROSS JOIN (SELECT unnest(range(1, 5)) AS i) WHERE m < c.k AND i + m - 1 <= c.k),
    o AS (SELECT b.* FROM b ANTI JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase AND i.f >= b.a WHERE pos = 1),
    q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
    SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM q WHERE rank <= 2000"""
