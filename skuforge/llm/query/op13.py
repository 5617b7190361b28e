"""Trie of all rebuilt conversations."""

from skuforge.llm import common
from skuforge.llm.prefix_trie import prefix_trie

NAME = "op13_prefix_trie"
SQL = r"""
WITH o AS (
    SELECT CAST(conv_id AS BIGINT) AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), t AS (
    SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS p FROM o
), k AS (
    SELECT c, n, c - c % 100 AS base,
           xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda a, b:
               list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda s, i: xor(s >> 1, CASE WHEN s & 1 = 1 THEN 3988292384 ELSE 0 END), xor(a, b)), CAST(4294967295 AS BIGINT)), 4294967295) % 6 AS h
    FROM (SELECT c, count(*) AS n FROM t GROUP BY c)
), g AS (
    SELECT k.c, k.base, k.h, least(k.h, coalesce(b.n, 0)) AS taken FROM k LEFT JOIN k b ON b.c = k.base
), r AS (
    SELECT g.c, t.p - g.h + g.taken AS d, role, text FROM t JOIN g ON g.c = t.c AND t.p > g.h
    UNION ALL
    SELECT g.c, t.p, role, text FROM t JOIN g ON t.c = g.base AND t.p <= g.h
), l AS (
    SELECT g.c, coalesce(x.l, []) AS l, coalesce(x.t, []) AS t FROM g LEFT JOIN (SELECT c, list(CAST(to_json([role, text]) AS VARCHAR) ORDER BY d) AS l, list(length(text) ORDER BY d) AS t FROM r GROUP BY c) x ON x.c = g.c
), p AS (
    SELECT c, d, len(l) = d AS ends, sha256(array_to_string(l[1 : d], chr(10))) AS key, CASE WHEN d > 0 THEN sha256(array_to_string(l[1 : d - 1], chr(10))) END AS up, CASE WHEN d > 0 THEN t[d] ELSE 0 END AS chars
    FROM (SELECT c, l, t, unnest(range(0, len(l) + 1)) AS d FROM l)
), n AS (
    SELECT d, key, min(c) AS c, count(*) AS n_convs, any_value(up) AS up, any_value(chars) AS chars, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '') AS ends FROM p GROUP BY d, key
), f AS (
    SELECT n.*, coalesce(x.m, 0) AS n_children FROM n LEFT JOIN (SELECT d - 1 AS d, up AS key, count(*) AS m FROM n WHERE d > 0 GROUP BY 1, 2) x ON x.d = n.d AND x.key = n.key
), s AS (
    SELECT p.d, p.key, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.chars) AS saved FROM f JOIN p ON p.c = f.c AND p.d <= f.d GROUP BY 1, 2
)
SELECT f.c AS conv_id, CAST(f.d AS BIGINT) AS depth, u.c AS parent_conv_id, f.n_convs, f.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN s ON s.d = f.d AND s.key = f.key LEFT JOIN f u ON u.d = f.d - 1 AND u.key = f.up
"""


def run(spark, sf_dir):
    return prefix_trie(common.table(spark, sf_dir, "conversations")).drop("digest")
