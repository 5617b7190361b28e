"""Groups of documents whose 3-word shingles have a Jaccard similarity of 0.9 or more."""

from skuforge.llm import common
from skuforge.llm.ngram_join import near_duplicates

NAME = "op2_ngram_join"
SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d
), k AS (
    SELECT doc_id, len(g) AS n, md5(array_to_string(list_sort(g), chr(10))) AS key, g FROM s
), r AS (
    SELECT key, min(doc_id) AS id, any_value(n) AS n, any_value(g) AS g FROM k WHERE n > 0 GROUP BY key
), e AS (
    SELECT id, n, unnest(g) AS h FROM r
), i AS (
    SELECT a.id AS a, b.id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
    FROM e a JOIN e b ON a.h = b.h AND a.id < b.id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY 1, 2
), l AS (
    SELECT a, b FROM i WHERE 100 * c >= 90 * (na + nb - c)
), sym AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(id, to_id) AS (
    SELECT id, id FROM r UNION SELECT reach.id, sym.b FROM reach JOIN sym ON sym.a = reach.to_id
), c AS (
    SELECT id, min(to_id) AS component FROM reach GROUP BY 1
)
SELECT k.doc_id, CAST(k.n AS BIGINT) AS n_shingles, coalesce(c.component, k.doc_id) AS component_id
FROM k LEFT JOIN r ON k.n > 0 AND r.key = k.key LEFT JOIN c ON c.id = r.id
"""


def run(spark, sf_dir):
    return near_duplicates(common.table(spark, sf_dir, "documents"), n=3, num=90, den=100)
