"""Queries and DuckDB SQL of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from caseloom.llm import chat_format, decontaminate, html_extract, lexical_search, line_dedup, minhash_near, packing, quality_rules, suffix_dedup, token_counts, toxicity, turn_repair, warc
from caseloom.session import shared_folder, table


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lit("</s>[INST] ok [/INST]")
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        text.alias("text"),
    )
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.digest_examples(chat_format.expand_examples(conversations.unionByName(own)))


OP5_SQL = r"""
WITH own(conv_id, turn, role, text) AS (
  VALUES (-1::BIGINT, 0::BIGINT, 'user', '</s>[INST] ok [/INST]'), (-1::BIGINT, 1::BIGINT, 'assistant', '</s>[INST] ok [/INST]')
), turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM own
), sized AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    length(regexp_replace(text, '(<</?|</?|\[/?)(\\*)(SYS>>|s>|INST\]|ROLE[ \]])', '\1\\\2\3', 'g'))
      + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 14 + 2 * strlen(role) END AS f
  FROM turns
), summed AS (
  SELECT *, sum(f) OVER (PARTITION BY conv_id ORDER BY k) AS upto, max(k) OVER (PARTITION BY conv_id) AS n FROM sized
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  coalesce(sum(upto) FILTER (role = 'assistant' OR k = n), 0)::BIGINT AS formatted_chars,
  count(*) FILTER (role = 'assistant' OR k = n) AS n_examples
FROM summed GROUP BY conv_id
"""


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.quality_cascade(docs).select(
        "doc_id",
        *[F.col(f"stats.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed",
        "kept",
    )


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), wins AS (
  SELECT r, i, list_slice(w, i, i + 4) AS g FROM d, unnest(range(1, greatest(len(w) - 3, 1)::BIGINT)) AS t(i)
), dups AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM wins) WHERE c > 1
), cover AS (
  SELECT r, count(DISTINCT i + k) AS n FROM dups, unnest(range(5)) AS t(k) GROUP BY r
), s AS (
  SELECT doc_id, text, w, l, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM d LEFT JOIN cover USING (r)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars > 15 * n_words OR word_chars < 2 * n_words
    OR 100 * len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) > 30 * n_lines
    OR 100 * len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[•●*·‣–-]'))) > 90 * n_lines
    OR 2 * len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{L}'))) > n_words
    OR 10 * length(regexp_replace(text, '\P{Lu}', '', 'g')) > 7 * length(regexp_replace(text, '\P{L}', '', 'g'))) AS kept
FROM b
"""

def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_near.near_duplicates(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity(docs, table(spark, sf_dir, "labels")).drop("text")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_turns(turn_repair.damage(table(spark, sf_dir, "conversations")))


OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
), hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS h
  FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE h WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE h <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k FROM damaged
), said AS (
  SELECT conv_id, turn, role, text, k, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS p,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut
  FROM numbered
), turns AS (
  SELECT *, CASE WHEN blank OR again THEN 1000000000 WHEN cut THEN 5 ELSE 0 END AS x FROM said
), steps AS (
  SELECT conv_id, 0::BIGINT AS k, {'c': 0::BIGINT, 'a': '', 'l': ''} AS v, {'c': 1000000000::BIGINT, 'a': '', 'l': ''} AS vs, {'c': 5::BIGINT, 'a': 'I', 'l': chr(10) || 'user:'} AS vu, {'c': 10::BIGINT, 'a': 'II', 'l': chr(10) || 'user:' || chr(10) || 'assistant:'} AS va
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, k, n, ns, list_min([nu, {'c': n.c + 5, 'a': n.a || 'I', 'l': n.l || chr(10) || 'user:'}, {'c': ns.c + 5, 'a': ns.a || 'I', 'l': ns.l || chr(10) || 'user:'}, {'c': na.c + 5, 'a': na.a || 'I', 'l': na.l || chr(10) || 'user:'}]),
    list_min([na, {'c': nu.c + 5, 'a': nu.a || 'I', 'l': nu.l || chr(10) || 'assistant:'}, {'c': n.c + 10, 'a': n.a || 'II', 'l': n.l || chr(10) || 'user:' || chr(10) || 'assistant:'}, {'c': ns.c + 10, 'a': ns.a || 'II', 'l': ns.l || chr(10) || 'user:' || chr(10) || 'assistant:'}])
  FROM (
    SELECT s.conv_id, r.k, {'c': v.c + 2, 'a': v.a || 'D', 'l': v.l} AS n,
      list_min([{'c': vs.c + 2, 'a': vs.a || 'D', 'l': vs.l}, {'c': v.c + x + CASE WHEN i = 's' THEN 0 ELSE 1000000000 END, 'a': v.a || 'K', 'l': v.l || chr(10) || role || ':' || text}]) AS ns,
      list_min(list_concat([{'c': vu.c + 2, 'a': vu.a || 'D', 'l': vu.l}], list_transform([v, vs, va], lambda z:
        CASE WHEN i = 'u' THEN {'c': z.c + x, 'a': z.a || 'K', 'l': z.l || chr(10) || role || ':' || text} ELSE {'c': z.c + x + 1, 'a': z.a || 'R', 'l': z.l || chr(10) || 'user:' || text} END))) AS nu,
      list_min([{'c': va.c + 2, 'a': va.a || 'D', 'l': va.l},
        CASE WHEN i = 'a' THEN {'c': vu.c + x, 'a': vu.a || 'K', 'l': vu.l || chr(10) || role || ':' || text} ELSE {'c': vu.c + x + 1, 'a': vu.a || 'R', 'l': vu.l || chr(10) || 'assistant:' || text} END]) AS na
    FROM steps s JOIN turns r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.k = s.k + 1
  )
), ends AS (
  SELECT conv_id, list_min([v, va]) AS z FROM steps QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1
), figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (cut AND NOT blank AND NOT again) AS truncated, count(*) FILTER (k > 1 AND p || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, z.c::BIGINT AS cost, z.a AS audit, sha256(substr(z.l, 2)) AS repaired_sha256
FROM ends e LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build_index(table(spark, sf_dir, "documents"))
    return lexical_search.search(index, table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), g AS (
  SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w))::BIGINT AS terms FROM d
), p AS (
  SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL
), weights AS (
  SELECT t, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, g GROUP BY t, docs
), q AS (
  SELECT row_number() OVER () AS q, item_id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark
), scored AS (
  SELECT q, item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN weights USING (t) JOIN p USING (t), g GROUP BY q, item_id, r, doc_id
), ranked AS (
  SELECT item_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST))::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 20
"""


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = warc.write_archives(table(spark, sf_dir, "pages"), f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")
    return warc.read_archives(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), g AS (
  SELECT page_id, h, strlen(h) AS n, max(page_id) OVER (PARTITION BY h) AS top FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(encode(h)) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
FROM g
"""


QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_html_extraction": op3_html_extraction,
    "op4_decontamination": op4_decontamination,
    "op5_chat_format": op5_chat_format,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_quality_rules": op8_quality_rules,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_turn_repair": op11_turn_repair,
    "op12_lexical_search": op12_lexical_search,
    "op13_warc": op13_warc,
}
ORACLES = {"op5_chat_format": OP5_SQL, "op8_quality_rules": OP8_SQL, "op11_turn_repair": OP11_SQL, "op12_lexical_search": OP12_SQL, "op13_warc": OP13_SQL}
