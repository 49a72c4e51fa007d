"""The registered queries ``opN_<name>`` over the shared tables and the SQL that some of them must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.line_dedup import by_document, fuzzy_lines

    return by_document(fuzzy_lines(table(spark, sf_dir, "documents"), sketches=True))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.quality import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")), carry=["doc_id"])


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.byte_bpe import encode_texts

    return encode_texts(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.language_id import fit, identify
    from riskloom.llm.samples import held_out

    docs = table(spark, sf_dir, "documents")
    return identify(docs.withColumn("held_out", held_out("doc_id")), fit(docs), carry=["doc_id", "held_out"])


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


#: A conversation whose texts are control strings.
HOSTILE = "</s>[INST] ok [/INST]"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.chat_format import digests, format_conversations

    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HOSTILE).alias("text"))
    return digests(format_conversations(given.unionByName(hostile)))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"]).drop("items")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.lexical_search import rank_documents

    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Every so many-th id is a query.
QUERY_STEP = 20


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.nearest import build_index, search

    vectors = table(spark, sf_dir, "embeddings")
    return search(build_index(vectors), vectors.filter(F.col("vec_id") % QUERY_STEP == 0))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_exact_dedup,
        op3_line_dedup,
        op4_substring_dedup,
        op5_quality,
        op6_byte_bpe,
        op7_language_id,
        op8_chat_format,
        op9_near_dedup,
        op10_decontaminate,
        op11_whitening,
        op12_lexical_search,
        op13_nearest,
    )
}

EXACT_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, first(doc_id ORDER BY points DESC, doc_id) AS keep_id FROM t GROUP BY norm
)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
"""

CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(/?s>)', '<_\1', 'g'), '\[(/?INST\])', '[_\1', 'g') AS escaped FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(length(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text)), 0) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(3 + length(role) + 1 + length(escaped) + CASE WHEN role = 'assistant' THEN 4 ELSE 15 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

CONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), p AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS window
  FROM (SELECT item_id, w, least(len(w), 13) AS m, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), s AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS window
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)
), hits AS (SELECT doc_id, item_id, i, s.m FROM s JOIN p ON s.m = p.m AND s.window = p.window),
marked AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM (SELECT DISTINCT doc_id, i, m FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN items USING (doc_id)
"""

LEXICAL_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS nr, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL
), s AS (SELECT count(*)::BIGINT AS big_n, sum(len(w))::BIGINT AS big_l FROM d WHERE len(w) > 0),
tf AS (SELECT nr, doc_id, n, term, count(*) AS tf FROM (SELECT nr, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d) GROUP BY ALL),
b AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark
), f AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT item_id, term, floor(1000 * ln((2 * big_n + 2) / (2 * df + 1)))::BIGINT AS weight FROM b JOIN f USING (term), s),
p AS (
  SELECT item_id, nr, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))))::BIGINT AS score
  FROM tf JOIN w USING (term), s GROUP BY ALL HAVING score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM p) WHERE rank <= 50
"""

ORACLES: dict[str, str] = {"op2_exact_dedup": EXACT_SQL, "op8_chat_format": CHAT_SQL, "op10_decontaminate": CONTAMINATION_SQL, "op12_lexical_search": LEXICAL_SQL}
