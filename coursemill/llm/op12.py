from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coursemill.llm.registered import query
from coursemill.llm.spelling import GARBLED, LEAST_COUNT, LEAST_LENGTH, TIMES, spelling_groups, words_of

# crc32 byte by byte over a table that follows from its polynomial; the runs hold one- and two-byte code points only
SQL = f"""
WITH RECURSIVE crc AS (
    SELECT list(v ORDER BY i) AS t FROM (
        SELECT i, list_reduce(generate_series(1, 8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v
        FROM range(256) r(i))),
runs AS (
    SELECT doc_id, run, count(*) AS n FROM (
        SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
    WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
bytes AS (
    SELECT run, n, flatten(list_transform(string_split(doc_id || ':' || run, ''),
        lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) AS BIGINT) - 64] END)) AS b FROM runs),
sums AS (
    SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[CAST((xor(c, x) & 255) + 1 AS INTEGER)]), 4294967295), 4294967295) AS h
    FROM bytes, crc),
w AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT n, CASE WHEN h % {GARBLED} = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word FROM sums)
    WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
d AS (SELECT word, i, word[: i - 1] || word[i + 1 :] AS rest FROM (SELECT word, unnest(generate_series(1, length(word))) AS i FROM w)),
shorter AS (SELECT DISTINCT d.word AS a, w.word AS b FROM d JOIN w ON d.rest = w.word),
near AS (
    SELECT a, b FROM shorter UNION SELECT b, a FROM shorter
    UNION SELECT x.word, y.word FROM d x JOIN d y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word),
best AS (
    SELECT a, count(*) AS n_near, arg_min(b, (-w.n, encode(b))) AS form, max(w.n) AS form_n FROM near JOIN w ON w.word = b GROUP BY a),
told AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {TIMES} * n THEN form END AS form,
        CASE WHEN form_n >= {TIMES} * n THEN form_n END AS form_n
    FROM w LEFT JOIN best ON a = word),
chain(word, stop) AS (SELECT word, word FROM told UNION ALL SELECT c.word, t.form FROM chain c JOIN told t ON t.word = c.stop WHERE t.form IS NOT NULL)
SELECT t.word, t.form, c.stop AS root, t.n, t.n_near, t.form_n
FROM told t JOIN chain c USING (word) JOIN told e ON e.word = c.stop WHERE e.form IS NULL
"""


@query("op12_spelling_variants", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(words_of(spark.read.parquet(f"{sf_dir}/documents.parquet")))
