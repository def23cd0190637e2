"""Queries on syllables and old encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.functions import syllables as S
from caseloom.plans.registry import query
from caseloom.session import table

_T = "".join(S.TONED.values())
_BASES = "".join(k * 5 for k in S.TONED)
_VARIANTS = "[w, translate(w, 'e', 'ế'), translate(w, 'a', 'ạ'), translate(w, 'iu', 'ìư'), translate(w, 'o', 'ộ')]"
#: spelt(base, stopped): every base that the grammar can write.
_SPELT = f"""r AS (SELECT n, n || replace(c, '-', '') AS r, list_contains(['p', 't', 'c', 'ch'], c) AS stopped FROM (SELECT n, unnest(string_split(cs, ' ')) AS c FROM (VALUES {', '.join(f"('{n}', '{c}')" for n, c in S.CODAS.items())}) AS t(n, cs))),
  i AS (SELECT unnest([{', '.join(f"'{x}'" for x in S.INITIALS)}, '']) AS i),
  spelt AS (SELECT DISTINCT i || r AS base, stopped FROM i, r WHERE i NOT IN ('qu', 'gi') AND NOT (i = 'k' AND NOT regexp_matches(r, '^[ieêy]')) AND NOT (i = 'c' AND regexp_matches(r, '^[ieêy]')) AND NOT (i = 'gh' AND NOT regexp_matches(r, '^[ieêy]'))
      AND NOT (i = 'g' AND regexp_matches(r, '^[eê]')) AND NOT (i = 'ngh' AND NOT regexp_matches(r, '^[ieê]')) AND NOT (i = 'ng' AND regexp_matches(r, '^[ieê]')) AND NOT (r LIKE 'yê%' AND i <> '') AND NOT (r LIKE 'iê%' AND i = '')
    UNION SELECT 'gi' || r, stopped FROM r WHERE r NOT LIKE 'ê%' AND r NOT LIKE 'yê%'
    UNION SELECT 'qu' || r, stopped FROM r WHERE n IN ({', '.join(f"'{x}'" for x in S.AFTER_QU)}) AND r <> 'ia'
    UNION SELECT 'qu' || x, true FROM (SELECT unnest(['ych', 'yt']) AS x) UNION SELECT 'quynh', false)"""


@query(
    "syllable_validity",
    f"""WITH {_SPELT}, w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[\\p{{L}}]+'))) AS w FROM documents), v AS (SELECT DISTINCT unnest({_VARIANTS}) AS w FROM w),
        p AS (SELECT w, translate(w, '{_T}', '{_BASES}') AS base, length(regexp_replace(w, '[^{_T}]', '', 'g')) AS tones, regexp_replace(w, '[^{_T}]', '', 'g') AS t FROM v)
        SELECT w AS word, tones <= 1 AND EXISTS (SELECT 1 FROM spelt s WHERE s.base = p.base AND (NOT stopped OR regexp_matches(t, '^[{''.join(v[k] for v in S.TONED.values() for k in (1, 4))}]$'))) AS valid FROM p""",
)
def syllable_validity(spark, sf_dir):
    """Which words, as they stand and with tones put on, are syllables; in SQL all syllables are spelt out."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1))).alias("w")).select(F.lower("w").alias("w")).distinct()
    v = w.select(F.explode(F.array("w", *[F.translate("w", a, b) for a, b in (("e", "ế"), ("a", "ạ"), ("iu", "ìư"), ("o", "ộ"))])).alias("word")).distinct()
    return v.select("word", S.problem(F.col("word")).isNull().alias("valid"))


@query(
    "valid_share",
    f"""WITH {_SPELT}, w AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}]+'), lambda x: length(x) <= 7)) AS w FROM documents),
        d AS (SELECT DISTINCT w, lower(w) AS l FROM w), p AS (SELECT w, translate(l, '{_T}', '{_BASES}') AS base, regexp_replace(l, '[^{_T}]', '', 'g') AS t FROM d),
        ok AS (SELECT w, length(t) <= 1 AND EXISTS (SELECT 1 FROM spelt s WHERE s.base = p.base AND (NOT stopped OR regexp_matches(t, '^[{''.join(v[k] for v in S.TONED.values() for k in (1, 4))}]$'))) AS ok FROM p)
        SELECT doc_id, round(CASE WHEN count(ok) = 0 THEN 0.0 ELSE count(*) FILTER (ok) / count(ok) END, 6) AS share FROM (SELECT doc_id FROM documents) LEFT JOIN w USING (doc_id) LEFT JOIN ok USING (w) GROUP BY doc_id""",
)
def valid_share(spark, sf_dir):
    """The share of each document's short words that are syllables."""
    return table(spark, sf_dir, "documents").select("doc_id", F.round(S.valid_share(F.col("text")), 6).alias("share"))


@query("old_encoding", f"SELECT doc_id, md5(translate(text, '{S.TCVN}', '{S.TCVN_LETTERS}')) AS text_md5 FROM documents")
def old_encoding(spark, sf_dir):
    """Texts read as the one-byte font encoding."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(S.from_tcvn(F.col("text"))).alias("text_md5"))
