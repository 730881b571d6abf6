"""The registered queries over runs, phrases and benchmark passages."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.catalog.registry import read
from rowmill.llm import collocations, periodic_runs, phrase_index
from rowmill.llm.registry import query


def planted_order(doc_id: object, n: int) -> np.ndarray | None:
    """The rearrangement that the query's contract fixes: a tenth of the documents end in a repeated passage."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


@query("op11_periodic_runs")
def runs_found(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.find_runs(read(spark, folder, "documents"), order=planted_order)
    best = periodic_runs.strongest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    facts = found.select("doc_id", "collapsed", "runs", best.alias("best"))
    return facts.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


LEAKS_SQL = r"""
WITH letters AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS upper_case, 'abcdefghijklmnopqrstuvwxyz' AS lower_case),
d AS (
  SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), upper_case, lower_case),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents, letters),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), upper_case, lower_case),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark, letters),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(words[i : i + size - 1], ' ') AS phrase
  FROM (SELECT item_id, words, least(len(words), 10) AS size, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS i
    FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT row, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM d, sizes WHERE len(words) >= size),
texts AS (SELECT row, size, i, array_to_string(words[i : i + size - 1], ' ') AS phrase FROM places),
found AS (SELECT row, size, i, phrase FROM texts WHERE phrase IN (SELECT phrase FROM windows)),
hit AS (SELECT row, count(DISTINCT word) AS n FROM (SELECT row, unnest(range(i, i + size)) AS word FROM found) GROUP BY row),
listed AS (
  SELECT row, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM found JOIN windows USING (phrase)) GROUP BY row)
SELECT doc_id, len(words) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(l.n, 0) AS n_items,
  sha256(coalesce(l.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit h USING (row) LEFT JOIN listed l USING (row)
"""


@query("op13_benchmark_leaks", LEAKS_SQL)
def leaks_found(spark: SparkSession, folder: str) -> DataFrame:
    found = phrase_index.contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


PHRASES_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
listed AS (
  SELECT row_number() OVER () AS piece, lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS words FROM pieces),
grams AS (
  SELECT lang, words[i] AS x, words[i + 1] AS y, words[i + 2] AS z
  FROM (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM listed)),
one AS (SELECT lang, x, count(*) AS f FROM grams GROUP BY ALL),
two AS (SELECT lang, x, y, count(*) AS f FROM grams WHERE y IS NOT NULL GROUP BY ALL),
three AS (SELECT lang, x, y, z, count(*) AS f FROM grams WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
sizes AS (SELECT lang, count(*) AS n FROM grams GROUP BY lang),
longest AS (
  SELECT lang, x, y, max(f) AS longer
  FROM (SELECT lang, x, y, f FROM three UNION ALL SELECT lang, y, z, f FROM three) GROUP BY ALL),
cuts AS (
  SELECT c.lang, c.x || ' ' || c.y AS phrase, c.f AS a, 1 AS k, l.f AS l, r.f AS r
  FROM two c JOIN one l ON l.lang = c.lang AND l.x = c.x JOIN one r ON r.lang = c.lang AND r.x = c.y
  LEFT JOIN longest o ON o.lang = c.lang AND o.x = c.x AND o.y = c.y
  WHERE c.f >= 10 AND (o.longer IS NULL OR 100 * o.longer < 50 * c.f)
  UNION ALL
  SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z, c.f, 1, l.f, r.f
  FROM three c JOIN one l ON l.lang = c.lang AND l.x = c.x JOIN two r ON r.lang = c.lang AND r.x = c.y AND r.y = c.z
  UNION ALL
  SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z, c.f, 2, l.f, r.f
  FROM three c JOIN two l ON l.lang = c.lang AND l.x = c.x AND l.y = c.y JOIN one r ON r.lang = c.lang AND r.x = c.z),
rated AS (
  SELECT *, ((1000000::HUGEINT * a::HUGEINT * a::HUGEINT) // (l::HUGEINT * r::HUGEINT))::BIGINT AS score FROM cuts),
kept AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""


@query("op12_collocations", PHRASES_SQL)
def phrases_found(spark: SparkSession, folder: str) -> DataFrame:
    """The limit of 2,000 per language is the report's own."""
    return collocations.mine(read(spark, folder, "documents"))
