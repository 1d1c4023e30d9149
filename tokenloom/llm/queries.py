"""One query for each operator, over its whole table with production parameters, and the SQL that gives the same."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import bpe, context_mixing, exact_dedup, html_text, language_id, near_dedup, packing, quality_model, quality_rules, warc
from tokenloom.llm.common import bucket_of, scratch, small_batches, stored, table

#: Where the tokenizer files are; a parameter of the environment, never part of the repository.
TOKENIZERS = os.environ.get("TOKENLOOM_TOKENIZERS", "")


def tokenizer(name: str) -> str:
    """The text of a tokenizer.json, read on the driver and sent to the workers."""
    if TOKENIZERS:
        path = os.path.join(TOKENIZERS, name)
    else:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        return f.read()


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again; digests of the ids and of the decoded text."""
    small_batches(spark)
    config = tokenizer("byte_bpe_50k.json")
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), config), config)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of 2048 tokens."""
    small_batches(spark)
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("locator")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    small_batches(spark)
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from rows that aren't held out."""
    small_batches(spark)
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_model.learn(documents, labels.where(quality_model.may_learn()))
    scored = quality_model.score(documents, model)
    return scored.select(
        "doc_id",
        (bucket_of("doc_id", 5) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted"),
    )


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under a similarity of 0.85."""
    small_batches(spark)
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of all documents, learned from rows that aren't held out."""
    small_batches(spark)
    documents = table(spark, sf_dir, "documents")
    prototypes = language_id.learn(documents.where(language_id.may_learn()))
    found = language_id.predict(documents, prototypes)
    return found.select("doc_id", (bucket_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and context-mixing scores of all documents, learned from rows that aren't held out."""
    small_batches(spark)
    documents = table(spark, sf_dir, "documents")
    counts = stored(context_mixing.corpus_counts(documents.where(context_mixing.may_learn())), "corpus-counts")
    found = context_mixing.score(documents, counts, context_mixing.learn(counts))
    return found.select("doc_id", (bucket_of("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WARC files of two crawls over all pages, written and read again; the revisits of the second resolved."""
    small_batches(spark)
    path = scratch(spark, "crawls")
    warc.write_warc(warc.records(table(spark, sf_dir, "pages")), path)
    found = warc.resolve_revisits(warc.captures(warc.read_warc(spark, path)))
    return found.select(
        "record_id", F.floor(F.col("record_id") / 4).alias("page_id"), "url", "canonical_url", "outcome", "refers_to", "status", "payload_digest", "payload_bytes",
        F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("merged_headers"),
    )


OP8_SQL = r"""
WITH crawls AS (
  SELECT page_id, coalesce(page_id, 0) AS n, regexp_replace(url, '\s+', '', 'g') AS url, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest,
         unnest(CASE WHEN coalesce(page_id, 0) % 11 = 10 THEN [0, 1, 2] ELSE [0, 1] END) AS crawl
  FROM pages
), captures AS (
  SELECT page_id * 4 + crawl AS record_id, n, crawl, digest, CASE WHEN crawl = 0 THEN strlen(html) ELSE 0 END AS size,
         CASE crawl WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=again#top'
              ELSE regexp_replace(url, '[?#].*$', '') || '/never-crawled' END AS url,
         CASE WHEN crawl = 0 THEN 1704067200 ELSE 1706745600 END + n % 86400 AS ts,
         CASE WHEN crawl = 0 THEN digest[1:16] WHEN n % 13 = 5 THEN NULL ELSE digest[1:16] || CASE WHEN n % 7 = 3 THEN 'x' ELSE '' END END AS tag, page_id
  FROM crawls
), plain AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM captures
), parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www\.', ''), ':(?:80|443)$', '') AS host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
           lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(?:utm_[a-z_]+|gclid|fbclid|ref|sessionid|phpsessid)(=|$)'))) AS kept
  FROM plain
), named AS (
  SELECT *, host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical FROM parts
), found AS (
  SELECT *, CASE WHEN canonical IS NOT NULL THEN last_value(CASE WHEN crawl = 0 THEN struct_pack(id := record_id, tag := tag, digest := digest, size := size, page := page_id) END IGNORE NULLS)
         OVER (PARTITION BY canonical ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS before
  FROM named
), judged AS (
  SELECT *, CASE WHEN crawl = 0 THEN 'full' WHEN before IS NULL THEN 'orphan' WHEN tag IS NULL THEN 'unvalidated' WHEN tag = before.tag THEN 'resolved' ELSE 'mismatch' END AS outcome FROM found
)
SELECT record_id, CAST(floor(record_id / 4) AS BIGINT) AS page_id, url, canonical AS canonical_url, outcome,
       CASE WHEN outcome = 'resolved' THEN before.id END AS refers_to,
       CAST(CASE WHEN crawl = 0 OR outcome = 'resolved' THEN 200 ELSE 304 END AS INTEGER) AS status,
       CASE WHEN crawl = 0 THEN digest WHEN outcome = 'resolved' THEN before.digest END AS payload_digest,
       CASE WHEN outcome = 'resolved' THEN before.size ELSE size END AS payload_bytes,
       array_to_string(list_sort(list_filter(CASE
         WHEN crawl = 0 THEN ['content-type=text/html', 'date=' || coalesce(page_id::varchar, ''), 'etag="' || tag || '"', 'expires=0']
         WHEN outcome = 'resolved' THEN ['content-type=text/html', 'date=later ' || coalesce(page_id::varchar, ''), 'etag=W/"' || tag || '"', 'expires=0']
         ELSE ['content-length=0', 'date=later ' || coalesce(page_id::varchar, ''), CASE WHEN tag IS NOT NULL THEN 'etag=W/"' || tag || '"' END] END, lambda x: x IS NOT NULL)), ';') AS merged_headers
FROM judged
"""

OP7_SQL = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""

def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents under the current policy."""
    found = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_mask")


def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each rule, what it alone rejects under the current policy: from the stored ledger, without the texts."""
    return quality_rules.ablations(stored(quality_rules.ledger(table(spark, sf_dir, "documents")), "ledger"))


#: The ledger of all documents.
LEDGER_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), s AS (
  SELECT row, doc_id, text,
         list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t
), p AS (
  SELECT row, k, w[k] AS a, CASE WHEN k + 2 <= len(w) THEN hash(w[k], w[k + 1], w[k + 2]) END AS h, w[k + 1] AS b, w[k + 2] AS c, w[k] = w[k - 1] AND k > 1 AS run
  FROM (SELECT row, w, unnest(range(1, len(w) + 1)) AS k FROM s)
), f AS (
  SELECT row, k, a, run, h IS NOT NULL AND count(*) OVER (PARTITION BY row, h, a, b, c) > 1 AS twice FROM p
), c AS (
  SELECT row, a, run, max(twice::int) OVER (PARTITION BY row ORDER BY k ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS inside FROM f
), g AS (
  SELECT row, sum(inside)::bigint AS n_repeat_words, sum(coalesce(run, false)::int)::bigint AS n_run_words, sum((a = '|')::int)::bigint AS n_bar_words FROM c GROUP BY row
), m AS (
  SELECT doc_id, len(w)::bigint AS n_words, length(array_to_string(w, ''))::bigint AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_run_words, 0) AS n_run_words, coalesce(n_bar_words, 0) AS n_bar_words,
         len(lines) AS n_lines,
         length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n_letters,
         length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_upper,
         length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaims
  FROM s LEFT JOIN g USING (row)
), ledger AS (
  SELECT *, (n_words < 50)::bigint + 2 * (100 * n_repeat_words > 50 * n_words)::bigint
    + 4 * (n_words > 0 AND 5 * n_symbols > n_words)::bigint + 8 * (n_words > 0 AND n_letters > 0 AND 2 * n_upper > n_letters)::bigint
    + 16 * (n_words > 0 AND 5 * n_exclaims > n_words)::bigint + 32 * (n_words > 0 AND 100 * n_run_words > 30 * n_words)::bigint
    + 64 * (n_lines >= 8 AND 100 * n_dup_lines > 60 * n_lines)::bigint + 128 * (n_words > 0 AND 100 * n_bar_words > 12 * n_words)::bigint
    + 256 * (n_words > 0 AND (word_chars > 40 * n_words OR 2 * word_chars < 3 * n_words))::bigint + 512 * (n_words > 0 AND 2 * n_letters < word_chars)::bigint AS fail_mask
  FROM m
)
"""
OP9_SQL = (
    LEDGER_SQL
    + """SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_mask & 3) <> 0 AS base_failed, fail_mask = 0 AS kept, fail_mask
FROM ledger"""
)
#: Every rule is a bit of the current policy.
OP9_ABLATIONS_SQL = (
    LEDGER_SQL
    + "SELECT r.rule, r.bit::int AS bit, count(*) FILTER ((fail_mask & (1 << r.bit)) <> 0) AS n_failed, count(*) FILTER (fail_mask = (1 << r.bit)) AS n_failed_alone,"
    + " count(*) FILTER (fail_mask = 0 OR fail_mask = (1 << r.bit)) AS n_kept_without FROM ledger CROSS JOIN (VALUES "
    + ", ".join(f"('{r.name}', {r.bit})" for r in quality_rules.RULES)
    + ") AS r(rule, bit) GROUP BY ALL"
)

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_packing": op2_packing,
    "op3_html_text": op3_html_text,
    "op4_quality_model": op4_quality_model,
    "op5_near_dedup": op5_near_dedup,
    "op6_language_id": op6_language_id,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_warc_revisits": op8_warc_revisits,
    "op9_quality_rules": op9_quality_rules,
    "quality_rule_ablations": quality_rule_ablations,
    "op10_context_mixing": op10_context_mixing,
}
ORACLES: dict[str, str] = {"op7_exact_dedup": OP7_SQL, "op8_warc_revisits": OP8_SQL, "op9_quality_rules": OP9_SQL, "quality_rule_ablations": OP9_ABLATIONS_SQL}
