"""The operators as queries on the test tables, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, toxicity
from .chat_format import format_chats, read_loss, read_turns, text_parts
from .edit_fingerprints import compare_with_next
from .line_dedup import drop_lines, keep_bitmaps
from .mixing import mix_sources, word_count
from .ngram_join import similar_groups
from .packing import pack
from .pii import KINDS, pseudonymise
from .spelling_variants import spelling_variants, word_counts
from .storage import read_table
from .structure_repair import gather_turns, repair_structure
from .suffix_dedup import remove_repeats
from .topk import top_k

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return register


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of at most 4096 tokens."""
    pieces = pack(read_table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "tier",
        "step_group",
    )


def quality_weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with ``quality_weight``: 2 if labelled good, 0.5 if poor, else 1."""
    marks = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("quality").alias("_quality"))
        .withColumnRenamed("doc_id", "_labelled")
    )
    weight = F.when(F.col("_quality") == 1, 2.0).when(F.col("_quality") == 0, 0.5).otherwise(1.0)
    return docs.join(marks, F.col("doc_id") == F.col("_labelled"), "left").withColumn(
        "quality_weight", weight
    )


MIX_SQL = """
WITH sized AS (
  SELECT d.doc_id, d.source,
         coalesce(len(regexp_extract_all(d.text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
         -ln((('0x' || substr(md5('0|' || CAST(d.doc_id AS VARCHAR)), 1, 12))::BIGINT + 0.5)
             / 281474976710656.0)
         / CASE q.quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS k
  FROM documents d
  LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) q
    ON q.doc_id = d.doc_id),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
              WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS w
  FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER ()
             - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST
                           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY 3 * source_size / w, source NULLS LAST) AS turn
  FROM weighted),
goals AS (
  SELECT source, source_size,
         least(CAST(3 * source_size AS DOUBLE),
               coalesce(w * (SELECT arg_min(level, turn) FROM levels
                             WHERE 3 * source_size >= level * w), 3.0 * source_size)) AS target
  FROM levels),
ordered AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN least(floor(g.target / g.source_size), 3) ELSE 0 END AS e,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id
                           ROWS UNBOUNDED PRECEDING) AS through
  FROM sized s JOIN goals g ON g.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target,
       CAST((e + CASE WHEN size > 0 AND e < 3 AND through - size / 2.0 <= target - e * source_size
                      THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM ordered
"""


@query("op10_mixing", MIX_SQL)
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document in a mix of the sources by weight."""
    docs = read_table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    rated = quality_weights(sized, read_table(spark, sf_dir, "labels"))
    mixed = mix_sources(rated, quality=F.col("quality_weight"), size=F.col("size"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op7_suffix_dedup")
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 50-byte strings that start in an earlier document."""
    found = remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


LINES_SQL = """
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, i, ls[i] AS line,
         translate(regexp_replace(regexp_replace(ls[i], '^[\x20\x09-\x0D]+', ''),
                                  '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM split)),
common AS (
  SELECT key, max(doc_id) AS owner FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT l.*, c.owner IS NULL OR c.owner = l.doc_id AS stays
  FROM lines l LEFT JOIN common c ON c.key = l.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stays), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query("op8_line_dedup", LINES_SQL)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that at least five of them hold."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    cut = drop_lines(docs.withColumn("n_lines", n_lines.cast("bigint")), keep_bitmaps(docs))
    return cut.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


@query("op4_ngram_join")
def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with a Jaccard similarity of 4-word shingles of at least 0.85."""
    docs = read_table(spark, sf_dir, "documents")
    return similar_groups(docs, size=4, threshold=(85, 100))


@query("op9_pii")
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms in place of personal data, and counts by kind."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = pseudonymise(docs, key="corpus")
    kinds = F.col("found.kind")
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("bigint").alias(f"n_{kind}")
        for kind in KINDS
    ]
    return marked.select("doc_id", "text", *counts)


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labelled ones outside the held-out fold."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels")
    held_out = toxicity.bucket_of(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, labels.where(~held_out))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
        F.col("evidence.doc_id").alias("evidence"),
    )


@query("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from those outside the held-out fold."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = toxicity.bucket_of(F.col("doc_id"), 4) == 2
    model = language.fit(docs.where(~held_out))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("nearest_lang").alias("lang_pred"),
        F.col("lang_score").alias("score"),
        F.col("lang_rejected").alias("rejected"),
    )


@query("op2_edit_fingerprints")
def op2_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how near they are."""
    return compare_with_next(read_table(spark, sf_dir, "documents"))


TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 20 = 0)
SELECT query_id,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""


@query("op5_top_k", TOP_SQL)
def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every twentieth vector with all others."""
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op11_spelling_variants")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, usual form and root."""
    found = spelling_variants(word_counts(read_table(spark, sf_dir, "documents")))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def sample_chat(spark: SparkSession) -> DataFrame:
    """Conversation -1: a question and an answer that both consist of control strings."""
    turn = F.col("id")
    return spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        turn.alias("turn"),
        F.when(turn == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )


CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
written AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\])', '\1\\\2\3', 'g') AS safe_role,
         regexp_replace(text, '([<\[])(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\])', '\1\\\2\3', 'g') AS safe_text
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
                       FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>') + length(safe_role) + length('<|im_sep|>') + length(safe_text)
                + length('<|im_end|>')) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id
"""


@query("op12_chat_format", CHAT_SQL)
def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as transcripts, read back from these."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    chats = format_chats(turns.unionByName(sample_chat(spark)), text_parts("text"))
    back = chats.withColumns({"_turns": read_turns("formatted"), "_loss": read_loss("segments")})
    lines = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("_turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("bigint").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def damaged(turns: DataFrame) -> DataFrame:
    """``(conv_id, copies)``: what is left of each row, as an array of no, one or two turns.

    crc32 of ``conv_id:turn`` (a null is one space) modulo 20: 0 drops the row, 1 empties
    its text, 2 takes its full stops, 3 repeats it, 4 makes it the user's.
    """
    space = F.lit(" ")
    name = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(name[0], F.lit(":"), name[1]).cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    row = F.struct(
        F.col("turn").alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text")
    )
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return turns.select("conv_id", F.array_repeat(row, times).alias("copies"))


@query("op13_structure_repair")
def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and brought into order by the cheapest edits."""
    gathered = gather_turns(damaged(read_table(spark, sf_dir, "conversations")), F.col("copies"))
    numbers = F.filter(F.array_distinct("turns.turn"), lambda t: t.isNotNull())
    gaps = F.when(
        F.size(numbers) > 0, F.array_max(numbers) - F.array_min(numbers) + 1 - F.size(numbers)
    ).otherwise(0)
    found = repair_structure(gathered.withColumn("gaps", gaps.cast("bigint")))
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return found.select(
        "conv_id",
        "gaps",
        "blank",
        "duplicate",
        "truncated",
        "illegal",
        "cost",
        "audit",
        F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"),
    )
