"""The numbered queries over the given tables, with comparison SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqweave.llm.chat import formatted_digests, text_part
from reqweave.llm.common import table, write_dense
from reqweave.llm.crf import fitted, identify
from reqweave.llm.fptree import best_documents
from reqweave.llm.lpf import without_copies
from reqweave.llm.mixing import report_sql, sampling_report
from reqweave.llm.packing import pack
from reqweave.llm.pagetext import extract
from reqweave.llm.pagetext import fitted as page_model
from reqweave.llm.rabitq import near_duplicate_vectors
from reqweave.llm.secrets import secret_spans
from reqweave.llm.superminhash import near_duplicates
from reqweave.llm.syncmers import compare_with_edits
from reqweave.llm.tokens import token_files
from reqweave.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: What both turns of the conversation added to the given ones say.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def word_tokenizer() -> str:
    """Place of the public word tokenizer; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), word_tokenizer(), end_id=1)


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), word_tokenizer(), end_id=2)


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


@query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(write_dense(spark), sf_dir, "documents"), pack=True)


@query
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text_part(F.coalesce("text", F.lit(""))).alias("parts"))
    own = spark.sql(f"SELECT -7L AS conv_id, turn, role, '{CONTROL_TEXT}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return formatted_digests(turns.unionByName(own.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))))


SQL["op6_chat_format"] = rf"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '{CONTROL_TEXT}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
sized AS (
  SELECT *, 2 * (length(role) - length(replace(role, '%', ''))) + length(role) AS role_chars,
    length(text) + 2 * (length(text) - length(replace(text, '%', ''))) + 2 * len(regexp_extract_all(text, '</?s>|<image>|<audio>|<document>|\[/?INST\]')) AS text_chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(role_chars + text_chars + 1 + CASE WHEN role = 'assistant' THEN 7 ELSE 13 END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""


@query
def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling_report(table(spark, sf_dir, "documents"))


SQL["op8_source_mix"] = report_sql()


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fitted(docs))


@query
def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL["op7_minhash_dedup"] = r"""WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT x, y FROM pairs JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
sym AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM sym UNION SELECT r.x, b.y FROM reach r JOIN sym b ON r.y = b.x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) r ON r.x = d.doc_id"""


@query
def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


SQL["op2_embedding_dedup"] = """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x), m AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN m ON m.x = vec_id"""


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_copies(table(spark, sf_dir, "documents"))


@query
def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, page_model(pages))


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL["op12_lexical_search"] = f"""WITH asked AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark WHERE text IS NOT NULL) GROUP BY 1, 2),
docs AS MATERIALIZED (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) > 0),
sizes AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM docs),
tf AS MATERIALIZED (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM docs) WHERE t IN (SELECT t FROM asked) GROUP BY 1, 2),
weights AS MATERIALIZED (SELECT t, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, sizes GROUP BY t, nn),
norms AS (SELECT doc_id, 75 + (25 * n * nn) // l AS m FROM docs, sizes),
scores AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (t) JOIN tf USING (t) JOIN norms USING (doc_id) GROUP BY 1, 2),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20"""


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
