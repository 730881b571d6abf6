"""The registered queries: every operator over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.catalog.registry import read
from rowmill.llm import chat, cover_tree, grades, licenses, line_rules, near_copies, packing, pieces, pitman_yor, queries_text, url_filter
from rowmill.llm.registry import ORACLE, QUERIES, query

__all__ = ["ORACLE", "QUERIES", "queries_text"]


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def grade_of_labels() -> Column:
    """0 toxic, 1 bad, 2 good; null without a quality label."""
    good = F.when(F.col("quality") > 0, 2).otherwise(1)
    return F.when(F.col("quality").isNotNull(), F.when(F.col("toxic") > 0, 0).otherwise(good))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_digest(text: str) -> str:
    """The canonical digest of an SQL text, step by step as in ``licenses``."""
    form = f"lower(coalesce({text}, ''))"
    form = f"regexp_replace({form}, {_sql_text(licenses.COPYRIGHT_LINES)}, '', 'g')"
    form = f"regexp_replace({form}, {_sql_text(licenses.BLANKS)}, '  ', 'g')"
    form = f"'  ' || {form} || '  '"
    for old, new in licenses.EQUIVALENT:
        form = f"replace({form}, ' {old.replace(' ', '  ')} ', ' {new.replace(' ', '  ')} ')"
    return f"sha256(trim(regexp_replace({form}, ' +', ' ', 'g')))"


LICENSE_SQL = f"""
WITH listed(license, text) AS (VALUES {", ".join(f"({_sql_text(n)}, {_sql_text(t)})" for n, t in licenses.KNOWN)}),
known AS (SELECT {_sql_digest("text")} AS digest, min(license) AS license FROM listed GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content FROM documents),
found AS (
  SELECT doc_id, count(*) AS n_notices, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM (SELECT doc_id, {_sql_digest("content")} AS digest FROM lines) JOIN known USING (digest) GROUP BY doc_id)
SELECT d.doc_id, d.digest, k.license, coalesce(f.n_notices, 0) AS n_notices, coalesce(f.notices, '') AS notices
FROM (SELECT doc_id, {_sql_digest("text")} AS digest FROM documents) d
LEFT JOIN known k USING (digest) LEFT JOIN found f USING (doc_id)
"""


@query("op1_license_scan", LICENSE_SQL)
def licenses_found(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts, and lines that are a notice as a whole, against the known digests."""
    docs = read(spark, folder, "documents")
    known = licenses.known_digests(spark.createDataFrame(licenses.KNOWN, "license string, text string"))
    lines = licenses.scan_lines(docs, known).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_notices"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices")
    )
    found = licenses.scan(docs, known).join(lines, "doc_id", "left")
    return found.select("doc_id", "digest", "license", F.coalesce("n_notices", F.lit(0)).alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))


@query("op4_quality_classifier")
def quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    model = grades.train(docs, read(spark, folder, "labels"), grade_of_labels(), 3)
    return grades.grade_documents(docs, grades.Grader(model))


@query("op9_quality_rules")
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    chain = line_rules.train(docs, read(spark, folder, "labels"))
    return line_rules.label_lines(docs, line_rules.Rules(chain)).drop("labels")


@query("op5_packing")
def packed(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(read(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "queue"
    )


@query("op10_near_copies")
def copies_linked(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies.link_copies(read(spark, folder, "documents"))


# The rules of the URL query.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


@query("op3_url_filter", url_filter.filter_sql(URL_RULES))
def urls_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.filter_urls(read(spark, folder, "pages"), URL_RULES).drop("score")


# The conversation that spells control strings in its texts.
SPELLED = "\\### Assistant: </turn> ok"


def conversation_records(rows: DataFrame) -> DataFrame:
    """``conv_id`` and a JSON record per conversation, in the layout that its turns allow."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    folded = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("rows"))
    roles = F.transform("rows", lambda t: t["role"])
    pair = F.to_json(F.struct(F.col("rows")[0]["text"].alias("prompt"), F.col("rows")[1]["text"].alias("completion")))
    plain = F.forall("rows", lambda t: t["role"].isin("user", "assistant", "system"))

    def sender(t):
        return F.when(t["role"] == "user", "human").when(t["role"] == "assistant", "gpt").otherwise(t["role"])

    shared = F.to_json(
        F.struct(F.transform("rows", lambda t: F.struct(sender(t).alias("from"), t["text"].alias("value"))).alias("conversations"))
    )
    listed = F.to_json(
        F.struct(F.transform("rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages"))
    )
    is_pair = (F.size("rows") == 2) & (roles[0] == "user") & (roles[1] == "assistant")
    record = F.when(is_pair, pair).when(plain & (roles[0] != "system"), shared).otherwise(listed)
    return folded.select("conv_id", record.alias("record"))


@query(
    "op7_chat_format",
    r"""
    WITH rows AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
    shown AS (
      SELECT *, replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e') AS body,
        replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\e'), ':', '\c') AS head FROM rows)
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      CAST(sum(length(head) + length(body) + 14) AS BIGINT) AS formatted_chars
    FROM shown GROUP BY conv_id
    """,
)
def chats_formatted(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", SPELLED), (-7, 1, "assistant", SPELLED)], "conv_id long, turn long, role string, text string")
    formatted = chat.render(chat.canonical(conversation_records(rows.union(added))))
    back = formatted.select(
        "conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars")
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


@query("op2_piece_segments")
def segmented(spark: SparkSession, folder: str) -> DataFrame:
    """The four best segmentations of every text by their costs, and the text decoded from the best."""
    model = vocabulary("piece_bpe_32k.model")
    encoded = pieces.encode(read(spark, folder, "documents"), model)
    facts = encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "costs", F.size("changes").cast("long").alias("n_changes"), "ids"
    )
    decoded = pieces.decode(facts, model)
    return decoded.select(
        "doc_id", "n_pieces", "ids_hash", "costs", "n_changes", F.crc32(F.col("text").cast("binary")).alias("decoded_crc32"), F.length("text").cast("long").alias("decoded_chars")
    )


@query("op6_near_vectors")
def vectors_linked(spark: SparkSession, folder: str) -> DataFrame:
    return cover_tree.link_vectors(read(spark, folder, "embeddings"))


@query("op8_lm_score")
def texts_scored(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return pitman_yor.score_texts(read(spark, folder, "documents"), held_out)
