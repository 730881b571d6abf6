"""URL filters: rules first, then a character language-model ratio.

Rules name a host and a path: a rule fits its host and all subdomains if the path
starts with the rule's path, and the longest fitting rule decides. URLs that
rules accept and reject train two Markov models over 32 character classes with
contexts of up to three characters: the counts of a context are interpolated with
those of the next shorter one by Witten-Bell smoothing, down to equal chances. The mean
log-likelihood difference per character decides the other URLs. Its threshold is the
score that best separates rule-decided URLs kept out of training (balanced accuracy over score bins).

The finished model is one number for each run of four classes that the URLs have, 32^4 rows
at most whatever the input. URLs, counts, model and scores are written once each and read from there;
Spark picks the joins by their sizes. Everything is DataFrame code, linear in the length of the URLs.

A null URL or one without ``://`` has an empty host and path. Without accepted
and rejected URLs in both training and calibration rows, undecided URLs are allowed.
Repeated rows are judged each, repeated URLs scored once. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmill.llm.stored import Scratch

# Character classes: letters, digits as one, dot, slash, hyphen, edge of the URL, anything else.
CLASSES = "abcdefghijklmnopqrstuvwxyz0./-^_"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIZE = 32
ORDER = 4
BINS = 100


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    return F.translate(F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Number of the longest rule that fits, of equally long ones the first; null if none does."""
    tests = []
    for number in sorted(range(len(rules)), key=lambda i: -len(rules[i][1])):
        name, slash, rest = rules[number][1].partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        tests.append(F.when(fits, F.lit(number)))
    return F.coalesce(*tests, F.lit(None).cast("int"))


def runs_of(host: Column, path: Column) -> Column:
    """Codes of all runs of four character classes, the URL padded with edges; one pass over the URL."""
    plain = F.translate(F.translate(F.concat(host, path), UPPER + "123456789", LOWER + "000000000"), "^", "_")
    padded = F.concat(F.lit("^" * (ORDER - 1)), F.regexp_replace(plain, "[^a-z0./-]", "_"), F.lit("^"))

    def code(run: Column) -> Column:
        value = F.lit(0).cast("long")
        for k in range(1, ORDER + 1):
            value = value * SIZE + F.instr(F.lit(CLASSES), F.substring(run, k, 1)) - 1
        return value

    return F.transform(F.regexp_extract_all(padded, F.lit("(?=(.{%d}))" % ORDER), F.lit(1)), code)


def log_ratios(counts: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``code``, ``ratio`` of the ``wanted`` runs (all without it), from ``code``, ``good``, ``bad`` counts of those seen."""
    lower = None
    for k in range(1, ORDER + 1):
        cells = counts.groupBy((F.col("code") % SIZE**k).alias("code")).agg(*[F.sum(c).alias(c) for c in ("good", "bad")])
        contexts = cells.groupBy(F.floor(F.col("code") / SIZE).alias("context")).agg(
            *[F.sum(c).alias(f"{c}_all") for c in ("good", "bad")],
            *[F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_kinds") for c in ("good", "bad")],
        )
        grid = counts.sparkSession.range(SIZE**k).select(F.col("id").alias("code"))
        if k == ORDER and wanted is not None:
            grid = wanted.select("code")
        grid = grid.withColumns({"context": F.floor(F.col("code") / SIZE), "shorter": F.col("code") % SIZE ** (k - 1)})
        grid = grid.join(cells, "code", "left").join(contexts, "context", "left").fillna(0)
        if lower is None:
            grid = grid.withColumns({"p_good": F.lit(1.0 / SIZE), "p_bad": F.lit(1.0 / SIZE)})
        else:
            grid = grid.join(lower.withColumnRenamed("code", "shorter"), "shorter")

        def smooth(c: str) -> Column:
            total, kinds = F.col(f"{c}_all"), F.col(f"{c}_kinds")
            return F.when(total == 0, F.col(f"p_{c}")).otherwise((F.col(c) + kinds * F.col(f"p_{c}")) / (total + kinds))

        lower = grid.select("code", smooth("good").alias("p_good"), smooth("bad").alias("p_bad"))
    return lower.select("code", (F.log("p_good") - F.log("p_bad")).alias("ratio"))


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule``, ``verdict``, and ``score`` for pages without a rule.

    ``rules`` are (``allow`` or ``block``, ``host/path``) pairs, a short list.
    """
    url = F.col(url_col).cast("string")
    judged = pages.select(F.col(id_col).alias("id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumn("number", rule_of(F.col("host"), F.col("path"), rules))
    strings, verdicts = (F.array(*[F.lit(r[k]) for r in rules]) for k in (1, 0))
    judged = judged.withColumns({"rule": F.get(strings, F.col("number")), "decided": F.get(verdicts, F.col("number"))})

    held_out = F.substring(F.md5(F.concat("host", "path")), 1, 1).isin("0", "1", "2")
    good, bad = (F.sum((F.col("decided") == v).cast("long")) for v in ("allow", "block"))
    scratch = Scratch(pages.sparkSession, "url-filter")
    # Equal URLs are counted before their runs are listed. Runs carry a number in place of their URL.
    kinds = judged.groupBy("host", "path").agg(
        F.coalesce(good, F.lit(0)).alias("good"),
        F.coalesce(bad, F.lit(0)).alias("bad"),
        F.bool_or(F.col("decided").isNull()).alias("undecided"),
    )
    urls = scratch.store(kinds.select("*", held_out.alias("held"), F.monotonically_increasing_id().alias("number")))
    # Few bytes of URLs make many runs, so URLs are dealt to all tasks first.
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = urls.repartition(tasks, "number")
    listed = dealt.select("number", "good", "bad", "undecided", "held", F.explode(runs_of(F.col("host"), F.col("path"))).alias("code"))
    training = urls.where("good + bad > 0 AND NOT held")
    seen = listed.where("good + bad > 0 AND NOT held").groupBy("code").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    # The model has 32^4 rows at most, whatever the input.
    counts = scratch.store(seen)
    asked = listed.where("undecided OR held").select("number", "code")
    ratios = scratch.store(log_ratios(counts, scratch.store(asked.select("code").distinct())))
    rated = asked.join(ratios, "code").groupBy("number").agg(F.round(F.avg("ratio"), 9).alias("score"))
    scores = scratch.store(rated.join(urls, "number"))

    bins = scores.where("good + bad > 0").groupBy(F.floor(F.col("score") * BINS).alias("bin")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    # As many bins as the bounded score has; one small window.
    over = Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    shares = bins.select(
        "bin",
        F.try_divide(F.sum("good").over(over), F.sum("good").over(everything)).alias("kept"),
        F.try_divide(F.sum("bad").over(over), F.sum("bad").over(everything)).alias("let_in"),
    )
    trained = training.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).select(((F.col("good") > 0) & (F.col("bad") > 0)).alias("both"))
    best = shares.agg(F.max_by("bin", F.struct(F.round(F.col("kept") - F.col("let_in"), 9), -F.col("bin"))).alias("bin"), F.count("let_in").alias("n"), F.count("kept").alias("m"))
    least = F.when(F.col("n").cast("boolean") & F.col("m").cast("boolean"), F.col("bin") / F.lit(float(BINS)))
    threshold, both = best.select(least.alias("least")).scalar(), trained.scalar()

    unruled = judged.where("decided IS NULL").join(scores.where("undecided").select("host", "path", "score"), ["host", "path"], "left")
    passes = F.when(both, F.coalesce(F.col("score") >= threshold, F.lit(True))).otherwise(True)
    by_method = unruled.select("id", "host", "path", "rule", F.when(passes, "allow").otherwise("block").alias("verdict"), "score")
    by_rule = judged.where("decided IS NOT NULL").select(
        "id", "host", "path", "rule", F.col("decided").alias("verdict"), F.lit(None).cast("double").alias("score")
    )
    return by_rule.union(by_method).withColumnRenamed("id", id_col)


# The same method in SQL over a table ``pages`` with ``page_id`` and ``url``; rules are filled in.
FILTER_SQL = """
WITH RECURSIVE parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
named AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts),
rules(verdict, rule) AS (VALUES {rules}),
fitting AS (
  SELECT DISTINCT host, path, first_value(rule) OVER w AS rule, first_value(verdict) OVER w AS decided
  FROM (SELECT DISTINCT host, path FROM named) n JOIN rules r
    ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
    AND starts_with(path, substr(rule, strpos(rule, '/')))
  WINDOW w AS (PARTITION BY host, path ORDER BY length(rule) DESC)),
judged AS (
  SELECT n.*, f.rule, f.decided, substr(md5(n.host || n.path), 1, 1) IN ('0', '1', '2') AS held
  FROM named n LEFT JOIN fitting f USING (host, path)),
urls AS (
  SELECT host, path, held, sum(CASE WHEN decided = 'allow' THEN 1 ELSE 0 END) AS good,
    sum(CASE WHEN decided = 'block' THEN 1 ELSE 0 END) AS bad, bool_or(decided IS NULL) AS undecided
  FROM judged GROUP BY ALL),
padded AS (
  SELECT *, '^^^' || regexp_replace(translate(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789',
    'abcdefghijklmnopqrstuvwxyz000000000'), '^', '_'), '[^a-z0./-]', '_', 'g') || '^' AS s FROM urls),
runs AS (
  SELECT host, path, held, good, bad, undecided, unnest(list_transform(range(1, length(s) - 2), lambda i: substr(s, i, 4))) AS run
  FROM padded),
counts AS (
  SELECT run, sum(good) AS good, sum(bad) AS bad FROM runs WHERE good + bad > 0 AND NOT held GROUP BY run),
grams AS (
  SELECT k, substr(run, 5 - k) AS gram, sum(good) AS good, sum(bad) AS bad FROM counts, (VALUES (1), (2), (3), (4)) o(k) GROUP BY ALL),
contexts AS (
  SELECT k, substr(gram, 1, k - 1) AS context, sum(good) AS good_all, sum(bad) AS bad_all,
    sum(CASE WHEN good > 0 THEN 1 ELSE 0 END) AS good_kinds, sum(CASE WHEN bad > 0 THEN 1 ELSE 0 END) AS bad_kinds
  FROM grams GROUP BY ALL),
steps AS (
  SELECT run, o.k, coalesce(g.good, 0) AS good, coalesce(g.bad, 0) AS bad, coalesce(good_all, 0) AS good_all,
    coalesce(bad_all, 0) AS bad_all, coalesce(good_kinds, 0) AS good_kinds, coalesce(bad_kinds, 0) AS bad_kinds
  FROM (SELECT DISTINCT run FROM runs WHERE undecided OR held) a CROSS JOIN (VALUES (1), (2), (3), (4)) o(k)
  LEFT JOIN grams g ON g.k = o.k AND g.gram = substr(run, 5 - o.k)
  LEFT JOIN contexts c ON c.k = o.k AND c.context = substr(run, 5 - o.k, o.k - 1)),
smooth AS (
  SELECT run, 0 AS k, 1.0::DOUBLE / 32 AS p_good, 1.0::DOUBLE / 32 AS p_bad FROM (SELECT DISTINCT run FROM steps)
  UNION ALL
  SELECT s.run, s.k, CASE WHEN good_all = 0 THEN p_good ELSE (good + good_kinds * p_good) / (good_all + good_kinds) END,
    CASE WHEN bad_all = 0 THEN p_bad ELSE (bad + bad_kinds * p_bad) / (bad_all + bad_kinds) END
  FROM smooth p JOIN steps s ON s.run = p.run AND s.k = p.k + 1),
scores AS (
  SELECT host, path, held, good, bad, undecided, round(avg(ln(p_good) - ln(p_bad)), 9) AS score
  FROM runs r JOIN smooth m ON m.run = r.run AND m.k = 4 WHERE undecided OR held GROUP BY ALL),
bins AS (
  SELECT floor(score * 100) AS bin, sum(good) AS good, sum(bad) AS bad FROM scores WHERE good + bad > 0 GROUP BY 1),
shares AS (
  SELECT bin, sum(good) OVER (ORDER BY bin DESC) / nullif((SELECT sum(good) FROM bins), 0) AS kept,
    sum(bad) OVER (ORDER BY bin DESC) / nullif((SELECT sum(bad) FROM bins), 0) AS let_in FROM bins),
threshold AS (
  SELECT CASE WHEN (SELECT sum(good) > 0 AND sum(bad) > 0 FROM counts) THEN
    (SELECT bin / 100.0::DOUBLE FROM shares WHERE kept IS NOT NULL AND let_in IS NOT NULL
     ORDER BY round(kept - let_in, 9) DESC, bin LIMIT 1) END AS least)
SELECT j.page_id, j.host, j.path, j.rule,
  coalesce(j.decided, CASE WHEN coalesce(s.score >= t.least, TRUE) THEN 'allow' ELSE 'block' END) AS verdict
FROM judged j LEFT JOIN (SELECT host, path, score FROM scores WHERE undecided) s ON s.host = j.host AND s.path = j.path
CROSS JOIN threshold t
"""


def filter_sql(rules: list[tuple[str, str]]) -> str:
    return FILTER_SQL.format(rules=", ".join(f"('{verdict}', '{rule}')" for verdict, rule in rules))
