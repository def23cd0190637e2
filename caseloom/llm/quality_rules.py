"""Quality rules as a short-circuit cascade (DataFrame functions only).

A rule is a "reject" expression over the text and the base statistics. `cascade` tests rules inside one
CASE expression, so a rule is evaluated only for rows that all earlier ones let through. Rules stand in
descending order of rejection per cost, both estimated on a sample: one job over the first PILOT_ROWS rows takes
from each a flag for each rule and what that rule would have to read there (`Rule.work`, in characters and items; 1 for
a comparison of statistics). The order can never change whether a row is kept, only the price.

`judged` adds the base statistics, which every row gets. Rules that they decide compare numbers; the others
each compute their own input, and only for rows that reach them.

Defined results: a null text has no words and fails `too_few_words`; an empty
table gives an empty result; repeated rows are judged alike; `judged` keeps all columns;
`quality_cascade` puts stats, base_failed and kept in place of columns of these names. Names
that begin with "__" are reserved.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
PILOT_ROWS = 300  # bound of the sample that orders the rules
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    name: str
    reject: Callable[[Column, Column], Column]  # of the text and the base statistics
    work: Callable[[Column, Column], Column] = lambda t, s: F.lit(1)  # what it reads, of the same


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than space and \\t..\\r."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def lines_of(text: Column) -> Column:
    """\\n-split lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda s: F.translate(s, SPACES, "") != "")


def window_hashes(words: Column, width: int = WINDOW) -> Column:
    n = F.size(words)
    return F.when(
        n >= width,
        F.transform(
            F.sequence(F.lit(0), n - width),
            lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def covered_by_repeats(hashes: Column, width: int = WINDOW) -> Column:
    """Positions covered by windows whose hash occurs twice or more. Windows are
    sorted by (hash, start), neighbours compared, and the starts that remain merged."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    starts = F.aggregate(
        F.array(ordered),
        F.array().cast("array<int>"),
        lambda _, s: F.sort_array(
            F.transform(
                F.filter(
                    s,
                    lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]),
                ),
                lambda x: x["i"],
            )
        ),
    )
    merged = F.aggregate(
        starts,
        F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n")),
        lambda a, s: F.struct(s.alias("last"), (a["n"] + F.least(F.lit(width), s - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(merged).cast("long")


def with_stats(df: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """Adds struct `out`: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    t = F.coalesce(F.col(text), F.lit(""))
    w, ln, h = "__words", "__lines", "__hashes"
    df = df.withColumns({w: words_of(t), ln: lines_of(t)})
    df = df.withColumn(h, window_hashes(F.col(w)))
    # Bound as one value: a plain struct would be taken apart and computed anew in each rule that names a part of it.
    return df.withColumn(
        out,
        bound(F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
            (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size(ln).cast("long").alias("n_lines"),
            (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
            covered_by_repeats(F.col(h)).alias("n_repeat_words"),
        ), lambda s: s),
    ).drop(w, ln, h)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, which is computed once, however often f names it, inside lambdas too."""
    return F.get(F.transform(F.array(value), f), 0)


def share_of_lines(text: Column, pattern: str, percent: int) -> Column:
    """Whether more than `percent` of the lines with a word match."""
    return bound(lines_of(text), lambda x: 100 * F.size(F.filter(x, lambda y: y.rlike(pattern))) > percent * F.size(x))


def base_rules() -> list[Rule]:
    """The rules of base_failed."""
    return [
        Rule("too_few_words", lambda t, s: s["n_words"] < 10),
        Rule("repeated_words", lambda t, s: 100 * s["n_repeat_words"] > 20 * s["n_words"]),
    ]


def further_rules() -> list[Rule]:
    """Comparisons of base statistics, and rules that read the text: of the lines over 30 % end in an ellipsis or over 90 %
    begin with a bullet; of the words over half have no letter; of the letters over 70 % are capitals."""
    chars = lambda t, s: F.char_length(t)
    lines = lambda t, s: 2 * F.char_length(t) + 20 * s["n_lines"]
    letterless = lambda t: bound(words_of(t), lambda w: 2 * F.size(F.filter(w, lambda x: ~x.rlike(r"\p{L}"))) > F.size(w))
    capitals = lambda t: 10 * F.char_length(F.regexp_replace(t, r"\P{Lu}+", "")) > 7 * F.char_length(F.regexp_replace(t, r"\P{L}+", ""))
    return [
        Rule("symbols", lambda t, s: 10 * s["n_symbols"] > s["n_words"]),
        Rule("repeated_lines", lambda t, s: 2 * s["n_dup_lines"] > s["n_lines"]),
        Rule("long_words", lambda t, s: s["word_chars"] > 15 * s["n_words"]),
        Rule("short_words", lambda t, s: s["word_chars"] < 2 * s["n_words"]),
        Rule("ellipses", lambda t, s: share_of_lines(t, r"(\.\.\.|…)[\x20\x09-\x0D]*$", 30), lines),
        Rule("bullets", lambda t, s: share_of_lines(t, r"^[\x20\x09-\x0D]*[•●*·‣–-]", 90), lines),
        Rule("letterless_words", lambda t, s: letterless(t), lambda t, s: F.char_length(t) + 20 * s["n_words"]),
        Rule("capitals", lambda t, s: capitals(t), lambda t, s: 2 * chars(t, s)),
    ]


def order_rules(df: DataFrame, rules: list[Rule], text: str = "text", stats: str = "__stats", pilot_rows: int = PILOT_ROWS) -> list[Rule]:
    """Rules by rejection per cost on at most `pilot_rows` rows of df, which has the base statistics. The limit is read
    split by split until it is met; two numbers for each rule reach the driver."""
    t, s = F.coalesce(F.col(text), F.lit("")), F.col(stats)
    flags = [r.reject(t, s).alias(f"r{k}") for k, r in enumerate(rules)]
    pilot = df.select(*flags, *[r.work(t, s).cast("double").alias(f"w{k}") for k, r in enumerate(rules)]).limit(pilot_rows)
    sums = [F.count_if(f"r{k}").alias(f"r{k}") for k in range(len(rules))] + [F.avg(f"w{k}").alias(f"w{k}") for k in range(len(rules))]
    found = pilot.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    score = lambda k: (found[f"r{k}"] + 1) / (found["n"] + len(rules)) / (1 + (found[f"w{k}"] or 0))
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: (-score(k), k))]


def verdict(rules: list[Rule], text: Column, stats: Column, first: Column | None = None) -> Column:
    """Name of the first rule that rejects, tested in the given order; null if none does. Where
    `first` holds, no rule is tested and the name is "base"."""
    t = F.coalesce(text, F.lit(""))
    start = F.when(F.lit(False) if first is None else first, F.lit("base"))
    return reduce(lambda c, r: c.when(r.reject(t, stats), F.lit(r.name)), rules, start)


def cascade(df: DataFrame, rules: list[Rule] | None = None, text: str = "text", pilot_rows: int = PILOT_ROWS) -> DataFrame:
    """df with __rejected_by: the rule that rejects the row, null if it is kept."""
    out = with_stats(df, text, "__stats")
    ordered = order_rules(out, rules or base_rules() + further_rules(), text, "__stats", pilot_rows)
    return out.withColumn("__rejected_by", verdict(ordered, F.col(text), F.col("__stats"))).drop("__stats")


def judged(df: DataFrame, text: str = "text", rules: list[Rule] | None = None, pilot_rows: int = PILOT_ROWS) -> DataFrame:
    """df with structs __stats (base statistics) and __verdict (base_failed, kept)."""
    out = with_stats(df, text, "__stats")
    ordered = order_rules(out, rules or further_rules(), text, "__stats", pilot_rows)
    out = out.withColumn("__failed", base_failed(F.col("__stats")))
    kept = verdict(ordered, F.col(text), F.col("__stats"), F.col("__failed")).isNull()
    return out.withColumn("__verdict", F.struct(F.col("__failed").alias("base_failed"), kept.alias("kept"))).drop("__failed")


def quality_cascade(df: DataFrame, text: str = "text", rules: list[Rule] | None = None, pilot_rows: int = PILOT_ROWS) -> DataFrame:
    """df with the struct stats, base_failed and kept."""
    out = judged(df.drop("stats", "base_failed", "kept"), text, rules, pilot_rows)
    return out.withColumnsRenamed({"__stats": "stats"}).select("*", "__verdict.*").drop("__verdict")
