"""Kinds of documents and the fields in them, by tables of patterns.

Rules are rows, compiled into projections over the text: one CASE for the kind, one expression for each field. A new kind or field
needs a row. Of the documents of a case, each field's value is then reconciled by the kinds that its rule trusts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

MOST_RULES = 2000
HEAD_LINES = 60  # fixed value: lines of a document that tell its kind
QUOTE = 220  # fixed value: most characters of a quotation
DATE = r"(?iu)(\d{1,2})\s*(?:tháng|/|-)\s*(\d{1,2})\s*(?:năm|/|-)\s*(\d{4})"


def rows_of(rules: DataFrame, *columns: str) -> list[tuple]:
    rows = [tuple(r) for r in rules.select(*columns).limit(MOST_RULES + 1).collect()]
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return rows


def classified(docs: DataFrame, rules: DataFrame, text: str = "text", other: str = "other") -> DataFrame:
    """docs with `kind`: that of the first rule (kind, place, pattern), by place, whose pattern is found in the document's first
    HEAD_LINES lines in capitals; `other` without one, and for null texts."""
    head = F.upper(F.substring_index(F.coalesce(F.col(text), F.lit("")), "\n", HEAD_LINES))
    kind = F.when(F.lit(False), "")
    for name, _, pattern in sorted(rows_of(rules, "kind", "place", "pattern"), key=lambda r: (r[1], r[0])):
        kind = kind.when(F.col("__head").rlike(pattern), name)
    return docs.withColumn("__head", head).withColumn("kind", kind.otherwise(other)).drop("__head")


def read_as(value: Column, form: str) -> Column:
    """A found value in its form: text (white space as one space, less marks at its end), date (ISO), number, or check (yes)."""
    text = F.regexp_replace(F.trim(F.regexp_replace(value, r"\s+", " ")), r"[.,;\s]+$", "")
    if form == "date":
        d, m, y = (F.regexp_extract(value, DATE, k) for k in (1, 2, 3))
        return F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date").cast("string")
    if form == "number":
        return F.regexp_extract(F.regexp_replace(text, r"[. ](?=\d)", ""), r"(\d+)", 1)
    return F.when(text.isNotNull(), "yes") if form == "check" else text


def fields(docs: DataFrame, rules: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, field, value, quote): of each field the value that its first pattern with a group finds; rules: (field, place, form,
    pattern), whose patterns are tried by place. quote is the line of the value, QUOTE characters at most. Fields without a value
    have no row."""
    by: dict[str, list[tuple]] = {}
    for field, place, form, pattern in rows_of(rules, "field", "place", "form", "pattern"):
        by.setdefault(field, []).append((place, form, pattern))
    t = F.coalesce(F.col(text), F.lit(""))
    found = []
    for field, own in sorted(by.items()):
        value = F.coalesce(*[F.nullif(read_as(F.nullif(F.regexp_extract(t, p, 1), F.lit("")), form), F.lit("")) for _, form, p in sorted(own)])
        raw = F.coalesce(*[F.nullif(F.regexp_extract(t, p, 0), F.lit("")) for _, _, p in sorted(own)])
        before = F.call_function("substring_index", t, raw, F.lit(1))
        line = F.concat(F.substring_index(before, "\n", -1), F.substring_index(F.substring(t, F.length(before) + 1, F.length(t)), "\n", 1))
        found.append(F.when(value.isNotNull(), F.struct(F.lit(field).alias("field"), value.alias("value"), F.substring(F.trim(line), 1, QUOTE).alias("quote"))))
    if not found:
        return docs.select(*keys, F.lit("").alias("field"), F.lit("").alias("value"), F.lit("").alias("quote")).where("false")
    return docs.select(*keys, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("f")).select(*keys, "f.*")


def case_fields(found: DataFrame, trust: DataFrame, case: str = "case_id", order: str = "doc_id") -> DataFrame:
    """found: (case, order, kind, field, value); trust: (field, kind, rank). Per case and field: the value of the most trusted kind (kinds
    without a rank come last; then by order), its document, and how many other values there are. A value that many documents give is
    counted once before documents meet."""
    ranked = found.join(F.broadcast(trust.limit(MOST_RULES)), ["field", "kind"], "left").withColumn("__r", F.coalesce("rank", F.lit(1 << 30)))
    once = ranked.groupBy(case, "field", "value").agg(F.min(F.struct("__r", order)).alias("__at"), F.count(F.lit(1)).alias("n_docs"))
    place = F.row_number().over(Window.partitionBy(case, "field").orderBy("__at", "value"))
    other = F.count(F.lit(1)).over(Window.partitionBy(case, "field")) - 1
    return once.withColumns({"__p": place, "others": other}).where("__p = 1").select(case, "field", "value", F.col(f"__at.{order}").alias(order), "n_docs", "others")
