"""Extraction kernels: amounts, dates, citations. Column expressions.

Amounts and citations are read token by token: a text becomes an array of words, numbers and
marks, one pattern for each kind, and what a number means follows from the tokens after it (amounts) or from a
fold over what came before it (citations)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from caseloom.functions.text import let

# Unit words and what they multiply by; names of the currency; the least amount.
UNITS = {"nghìn": 1_000, "ngàn": 1_000, "triệu": 1_000_000, "tỷ": 1_000_000_000, "tỉ": 1_000_000_000}
CURRENCY = ("đồng", "vnđ", "vnd", "đ")
LEAST_AMOUNT = 1000
# Token kinds.
WORD, FIGURE, MARK = r"\p{L}+", r"\d+(?:[.,]\d+)*", r"[^\s\p{L}\d]"
#: Words of a citation: point, clause, article; what joins points; what ends a citation.
POINT, CLAUSE, ARTICLE, JOINS, ENDS = "điểm", "khoản", "điều", (",", "và"), (".", ";")
DATE = r"\b(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})\b"


def number(text: Column) -> Column:
    """Both separators: the last is the decimal one. One separator: three digits after it
    make it a thousands mark, anything else a decimal mark."""
    both = text.rlike(r"\..*,|,.*\.")
    comma_last = text.rlike(r",\d*$")
    thousands = text.rlike(r"^\d{1,3}([.,]\d{3})+$")
    return (
        F.when(both & comma_last, F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(both, F.replace(text, F.lit(","), F.lit("")))
        .when(thousands, F.regexp_replace(text, "[.,]", ""))
        .otherwise(F.replace(text, F.lit(","), F.lit(".")))
        .try_cast("decimal(20,2)")
    )


def all_threes(groups: Column) -> Column:
    """Whether there are groups of digits after the first, all of three."""
    after = F.slice(groups, 2, F.greatest(F.size(groups) - 1, F.lit(0)))
    return (F.size(after) > 0) & F.forall(after, lambda g: F.length(g) == 3)


def counted(figure: Column) -> Column:
    """A figure before a unit word: a comma is the decimal mark; dots part thousands if three digits
    follow each, and a single other dot is a decimal mark."""
    sides = F.split(figure, ",")
    groups = F.split(sides[0], r"\.")
    whole = F.when((F.size(groups) == 1) | all_threes(groups), F.array_join(groups, "")).when(F.size(groups) == 2, sides[0])
    return F.when(F.size(sides) == 1, whole).otherwise(F.concat_ws(".", F.replace(whole, F.lit("."), F.lit("")), sides[1])).try_cast("decimal(20,3)")


def amounts(text: Column) -> Column:
    """array<decimal(30,2)> of amounts in order, at least LEAST_AMOUNT: figures before a unit word, and
    figures in groups of three digits before the currency's name."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(f"({FIGURE}|{WORD}|{MARK})"), F.lit(1))
    factor = lambda word: F.coalesce(*[F.when(word == k, F.lit(v)) for k, v in UNITS.items()])

    def value(token: Column, follows: Column) -> Column:
        by_unit = (counted(token) * factor(follows)).cast("decimal(30,2)")
        in_full = F.when(all_threes(F.split(token, "[.,]")), F.regexp_replace(token, "[.,]", "").try_cast("decimal(30,2)"))
        return F.when(token.rlike(r"^\d"), F.when(follows.isin(*UNITS), by_unit).when(follows.isin(*CURRENCY), in_full))

    return let(tokens, lambda ts: F.filter(F.zip_with(ts, F.slice(ts, 2, F.size(ts)), value), lambda x: x >= LEAST_AMOUNT))


def dates(text: Column) -> Column:
    """array<date> of dd/mm/yyyy dates that exist."""
    part = lambda k: F.regexp_extract_all(text, F.lit(DATE), F.lit(k))
    iso = F.zip_with(F.zip_with(part(3), part(2), lambda y, m: F.concat_ws("-", y, F.lpad(m, 2, "0"))), part(1), lambda ym, d: F.concat_ws("-", ym, F.lpad(d, 2, "0")))
    return F.filter(F.transform(iso, lambda s: s.try_cast("date")), lambda d: d.isNotNull())


_STATE = "struct<after: string, points: array<string>, open: array<struct<clause: int, points: array<string>>>, out: array<struct<article: string, clause: int, points: array<string>>>>"


def citations(text: Column) -> Column:
    """array<struct<article, clause, points>>, one for each clause of each cited article, or one
    without clause. Points bind to the clause that follows them, and all to the next article; a full stop or
    semicolon forgets what no article has taken."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|\d+\p{L}*|[.;,])"), F.lit(1))
    no = lambda kind: F.array().cast(kind)
    none, nothing = no("array<string>"), no("array<struct<clause: int, points: array<string>>>")

    def state(a: Column, **new: Column) -> Column:
        return F.struct(*[new.get(k, a[k]).alias(k) for k in ("after", "points", "open", "out")]).cast(_STATE)

    def step(a: Column, t: Column) -> Column:
        """after: the mark whose operand is awaited ("" for none; "list" once a point is read)."""
        in_points = a["after"].isin(POINT, "list")
        clause = F.struct(t.try_cast("int").alias("clause"), a["points"].alias("points"))
        bare = F.array(F.struct(F.lit(None).cast("int").alias("clause"), a["points"].alias("points")))
        taken = F.when(F.size(a["open"]) > 0, a["open"]).otherwise(bare)
        cited = F.transform(taken, lambda c: F.struct(t.alias("article"), c["clause"].alias("clause"), c["points"].alias("points")))
        return (
            F.when(t.isin(*ENDS), state(a, after=F.lit(""), points=none, open=nothing))
            .when(t.isin(POINT, CLAUSE, ARTICLE), state(a, after=t))
            .when(in_points & t.rlike("^[a-zđ]$"), state(a, after=F.lit("list"), points=F.when(a["after"] == POINT, F.array(t)).otherwise(F.array_append(a["points"], t))))
            .when((a["after"] == "list") & t.isin(*JOINS), a)
            .when((a["after"] == CLAUSE) & t.rlike(r"^\d{1,2}$"), state(a, after=F.lit(""), points=none, open=F.array_append(a["open"], clause)))
            .when((a["after"] == ARTICLE) & t.rlike(r"^\d{1,3}[a-zđ]?$"), state(a, after=F.lit(""), points=none, open=nothing, out=F.concat(a["out"], cited)))
            .otherwise(state(a, after=F.lit("")))
        )

    start = F.struct(F.lit("").alias("after"), none.alias("points"), nothing.alias("open"), no("array<struct<article: string, clause: int, points: array<string>>>").alias("out")).cast(_STATE)
    return F.aggregate(tokens, start, step, lambda a: a["out"])


def roll_weekend(day: Column) -> Column:
    """Saturday and Sunday move to Monday."""
    return F.date_add(day, F.when(F.dayofweek(day) == 7, 2).when(F.dayofweek(day) == 1, 1).otherwise(0))
