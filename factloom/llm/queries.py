"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import chat, decontaminate, htmltext, knn, langid, neardup, spm, trainorder, urlrules, warc
from factloom.llm.common import arrow_batches, new_path, table, written


def op1_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    return knn.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


#: Fixed values of the url query: action and rule.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = written(urlrules.mine(urlrules.labelled_tokens(pages, table(spark, sf_dir, "labels"))), "rules")
    names = {"host": urlrules.HOST, "path": urlrules.PATH, "rule": urlrules.RULE, "verdict": urlrules.VERDICT, "mined_rule": urlrules.MINED}
    return urlrules.judge_pages(pages, URL_RULES, rules).select("page_id", *(F.col(v).alias(k) for k, v in names.items()))


def written_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op2 that SQL can express: host, path, the written rule and its verdict."""
    found = op2_url_rules(spark, sf_dir)
    return found.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


def planted_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2's method where urls do tell: every page is labelled, as bad if it is the English
    part of a blog, so that only a combination of two tokens tells it. No written rules."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    bad = F.coalesce(F.col("url").rlike("^[a-z]+://blog[.][^/]*/en/"), F.lit(False))
    labels = pages.select(F.col("page_id").alias("doc_id"), (~bad).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    rules = written(urlrules.mine(urlrules.labelled_tokens(pages, labels)), "rules")
    found = urlrules.judge_pages(pages, [], rules.where(F.col("confidence") == 1.0))
    return found.select("page_id", F.col(urlrules.VERDICT).alias("verdict"), (F.col(urlrules.CONFIDENCE) == 1.0).alias("sure"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    manifest = warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), new_path(spark, "warc"))
    records = warc.read_archives(manifest, with_data=False).where("last")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    index = trainorder.materialise(table(spark, sf_dir, "documents"), new_path(spark, "shards"))
    return trainorder.read_back(index).select("slot", "doc_id", "seq_no", "shard", "n_tokens", "crc32")


def training_order_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5 on the token ids of op6, of two bytes. Not op5's own query: tokenising alone
    takes most of the CPU time that the check tool allows for op5."""
    arrow_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = spm.with_tokens(docs, spm.read_model(MODEL_PATH)).select("doc_id", F.col(spm.TOKENS)["ids"].alias("ids"))
    ids = written(trainorder.narrowed(found, "ids"), "ids")
    index = trainorder.materialise(ids, new_path(spark, "shards"), ids="ids", width=2)
    return trainorder.read_back(index).select("slot", "doc_id", "seq_no", "shard", "n_tokens", "crc32")


#: Place of the tokenizer model; a parameter, never part of the repository.
MODEL_PATH = os.environ.get("FACTLOOM_SPM_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    return neardup.label_documents(table(spark, sf_dir, "documents")).drop("text_key")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = spm.with_tokens(docs, spm.read_model(MODEL_PATH), with_ids=False)
    return found.select("doc_id", *(F.col(spm.TOKENS)[x].alias(x) for x in ("n_tokens", "ids_sha256", "decodes")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    return langid.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op8_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    found = htmltext.with_text(table(spark, sf_dir, "pages").select("page_id", "html"))
    return found.select("page_id", F.char_length(htmltext.TEXT).cast("long").alias("n_chars"), F.col(htmltext.TEXT).alias("text"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.judged(decontaminate.with_spans(docs, table(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id", F.col(decontaminate.N_WORDS).alias("n_words"), "n_hit", "n_items", "items_sha256", "contaminated"
    )


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_probe(spark, table(spark, sf_dir, "conversations"))
    return chat.digest(chat.read_back(chat.format_conversations(chat.conversation_events(rows))))


QUERIES = {
    "op1_voronoi_knn": op1_voronoi_knn,
    "op2_url_rules": op2_url_rules,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_warc": op4_warc,
    "op5_training_order": op5_training_order,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_language_id": op7_language_id,
    "op9_decontaminate": op9_decontaminate,
    "op8_html_layout": op8_html_layout,
    "op10_chat_format": op10_chat_format,
    "written_url_rules": written_url_rules,
    "planted_url_rules": planted_url_rules,
    "training_order_of_ids": training_order_of_ids,
}

ORACLE_SQL = {
    "written_url_rules": """
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '/.*$', 0, 's') AS path FROM rest
), rules(action, rule) AS (
  VALUES ('allow', 'com/'), ('block', 'example.com/en/'), ('allow', 'www.example.com/en/'), ('block', 'net/es/'), ('block', 'net/fr/')
), fits AS (
  SELECT page_id, rule, action FROM parts, rules
  WHERE ('.' || host) LIKE '%.' || split_part(rule, '/', 1) AND starts_with(path, substr(rule, instr(rule, '/')))
), best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS rule_verdict FROM fits GROUP BY page_id)
SELECT page_id, host, path, rule, rule_verdict FROM parts LEFT JOIN best USING (page_id)
""",
    "planted_url_rules": r"""
SELECT page_id, CASE WHEN bad THEN 'block' ELSE 'allow' END AS verdict, CASE WHEN bad THEN true END AS sure
FROM (SELECT page_id, coalesce(regexp_matches(url, '^[a-z]+://blog[.][^/]*/en/'), false) AS bad FROM pages)
""",
    "op4_warc": """
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages
), named AS (
  SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(8), lambda i:
    list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(((CAST('0x' || substr(h, 5 * i + 1, 5) AS INTEGER) >> CAST(s AS INTEGER)) & 31) + 1 AS BIGINT), 1)), 'string_agg', '')), '')
    AS payload_digest FROM hashed
), grouped AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS keeper FROM named)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM grouped
""",
    "op1_voronoi_knn": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
""",
    "op9_decontaminate": r"""
WITH doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), item_words AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + 12], ' ') AS x
  FROM item_words, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p(i) WHERE len(w) > 0
), grams AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS x
  FROM doc_words, (SELECT DISTINCT k FROM windows), unnest(range(1, len(w) - k + 2)) AS p(i)
), found AS (SELECT doc_id, item_id, i, k FROM grams JOIN windows USING (k, x)),
hits AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM found, unnest(range(i, i + k)) AS q(j) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op3_near_duplicates": r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(coalesce(w, [])) = 0 THEN [] ELSE list_distinct(list_transform(
    range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM worded
), flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b USING (x) WHERE a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, m AS component_id, doc_id = m AS kept
FROM sets JOIN least ON a = doc_id
""",
    "op10_chat_format": r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), parts AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '<turn:', '\o'), '</turn>', '\c') AS body,
    replace(replace(replace(replace(role, '\', '\b'), '<turn:', '\o'), '</turn>', '\c'), '>', '\g') AS head
  FROM rows_
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(head) + length(body) + 16) AS BIGINT) AS formatted_chars
FROM parts GROUP BY conv_id
""",
}
