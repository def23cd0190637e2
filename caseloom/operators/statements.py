"""What statements say against each other: sums that differ, and denials of what was admitted before."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from caseloom.functions import extract as X

# Verbs of giving and taking; words of denial, admission and negation; least letters and most words of a question's key.
VERBS = ("nhận", "đưa", "chuyển", "chi", "trả", "vay", "cho")
DENIES, ADMITS, NEGATES = r"(?iu)(không hề|chưa từng|không có việc|không nhận|không biết)", r"(?iu)(có|đã)\s", r"(?iu)(không|chưa)"
KEY_LETTERS, KEY_WORDS = 4, 4


def differing_sums(answers: DataFrame, case: str = "case_id", at: str = "n", text: str = "answer") -> DataFrame:
    """(case, verb, n_sums, sums, first_at): verbs of giving and taking with which a case's answers name more than one sum; the sums in
    rising order, each once. A sentence (up to a full stop, semicolon or line end) counts for each verb in it. A sum is counted once
    per case and verb before it is gathered."""
    s = answers.select(case, at, F.explode(F.split(text, r"[.;\n](?!\d)")).alias("s"))
    # One pattern for each verb, as a literal: a pattern that comes from a column is compiled again for every verb of every sentence.
    verbs = F.array_compact(F.array(*[F.when(F.col("s").rlike(rf"(?iu)(^|\s){v}(\s|$)"), F.lit(v)) for v in VERBS]))
    any_verb = F.col("s").rlike(rf"(?iu)(^|\s)({'|'.join(VERBS)})(\s|$)")
    said = s.where(any_verb).select(case, at, F.explode(verbs).alias("verb"), "s").select(case, at, "verb", F.explode(X.amounts(F.col("s"))).alias("sum"))
    once = said.groupBy(case, "verb", "sum").agg(F.min(at).alias("at"))
    by = once.groupBy(case, "verb").agg(F.count(F.lit(1)).alias("n_sums"), F.array_sort(F.collect_list("sum")).alias("sums"), F.min("at").alias("first_at"))
    return by.where("n_sums > 1")


def late_denials(answers: DataFrame, record: str = "record_id", at: str = "n") -> DataFrame:
    """answers: (record, n, question, answer). (record, n, admitted_at): answers that deny, and the first earlier answer of the same record
    that admits, without a negation, and holds one of the first words of the denial's question (longer ones, in any case).

    A word has no white space, so an answer that holds it holds it inside one of its own words: denials' words and answers' words meet by
    (record, four letters) and are then tested. Of each word the first answer that admits it is kept, so many denials and many
    answers of a record meet at its words, not in pairs."""
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - KEY_LETTERS + 1), lambda k: F.substring(c, k, F.lit(KEY_LETTERS))))
    long = lambda ws: F.array_distinct(F.filter(ws, lambda w: F.length(w) >= KEY_LETTERS))
    words = F.slice(F.filter(F.split("question", r"\s+"), lambda w: F.length(w) >= KEY_LETTERS), 1, KEY_WORDS)
    denied = answers.where(F.col("answer").rlike(DENIES)).select(F.col(record), F.col(at).alias("__d"), F.explode(F.array_distinct(F.transform(words, F.lower))).alias("__w"))
    asked = denied.groupBy(record, F.substring("__w", 1, KEY_LETTERS).alias("__g")).agg(F.collect_set("__w").alias("__ws"))
    admitted = answers.where(F.col("answer").rlike(ADMITS) & ~F.col("answer").rlike(NEGATES)).select(F.col(record), F.col(at).alias("__a"), F.explode(long(F.split(F.lower("answer"), r"\s+"))).alias("__t"))
    admitted = admitted.select(record, "__a", "__t", F.explode(grams(F.col("__t"))).alias("__g"))
    held = asked.join(admitted, [record, "__g"]).select(record, "__a", F.explode(F.filter("__ws", lambda w: F.col("__t").contains(w))).alias("__w"))
    first = held.groupBy(record, "__w").agg(F.min("__a").alias("__a"))
    return denied.join(first, [record, "__w"]).where(F.col("__a") < F.col("__d")).groupBy(record, F.col("__d").alias(at)).agg(F.min("__a").alias("admitted_at"))
