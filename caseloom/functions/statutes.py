"""Penalties and ranges of value in the words of a statute, token by token. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from caseloom.functions.text import let

# Words of penalties, of terms and of sums.
PRISON, FINE, REFORM, LIFE, DEATH = "phạt tù", "phạt tiền", "cải tạo không giam giữ", "tù chung thân", "tử hình"
YEAR, MONTH, FROM, UPTO, UNDER, ABOVE = "năm", "tháng", "từ", "đến", "dưới", "trở lên"
UNITS = {"đồng": 1, "triệu": 1_000_000, "tỷ": 1_000_000_000}
TERM, SUM = rf"(\d{{1,2}})\s*({YEAR}|{MONTH})", r"([\d.,]+)\s*(đồng|triệu|tỷ)"


def flat(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s{2,}|[^\S ]", " ")))


def after(text: Column, words: str) -> Column:
    """What follows the words up to the next penalty, comma, semicolon or full stop; null without them."""
    at = F.locate(words, text)
    rest = F.substring(text, at + len(words), F.length(text))
    return F.when(at > 0, F.regexp_extract(rest, rf"^(?s)(.*?)(?:;|[.,](?!\d)|{PRISON}|{FINE}|{REFORM}|{LIFE}|{DEATH}|\z)", 1))


def found(part: Column, pattern: str) -> Column:
    """array<struct<n, unit>> of the numbers and units that a pattern finds."""
    n, unit = (F.regexp_extract_all(part, F.lit(pattern), F.lit(g)) for g in (1, 2))
    return F.zip_with(n, unit, lambda n, unit: F.struct(n.alias("n"), unit.alias("unit")))


def months(part: Column) -> Column:
    """The terms of a part in months."""
    return F.transform(found(part, TERM), lambda x: x["n"].try_cast("int") * F.when(x["unit"] == YEAR, 12).otherwise(1))


def sums(part: Column) -> Column:
    """The sums of money of a part."""

    def value(x: Column) -> Column:
        n, unit = x["n"], x["unit"]
        figure = F.when(unit == "đồng", F.regexp_replace(n, "[.,]", "")).otherwise(F.replace(F.replace(n, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        return (figure.try_cast("decimal(20,3)") * F.coalesce(*[F.when(unit == u, F.lit(v)) for u, v in UNITS.items()])).cast("double")

    return F.transform(found(part, SUM), value)


def bounds(part: Column, values: Column) -> Column:
    """struct<low, high> of the first two values. Of `to x` no least; of `x` alone both; of `from x to y` each."""

    def of(p: Column) -> Column:
        value, other, only_upto = F.get(p["values"], 0), F.get(p["values"], 1), p["upto"]
        return F.struct(F.when(~only_upto, value).alias("low"), F.when(only_upto, value).otherwise(F.coalesce(other, value)).alias("high"))

    return let(F.struct(values.alias("values"), F.ltrim(part).startswith(UPTO).alias("upto")), of)


def penalty(text: Column) -> Column:
    """struct<low, high, life, death, reform, fine_low, fine_high>: months of prison and of reform without detention (at most), and
    sums; null where the text says nothing of it."""
    return let(flat(text), flat_penalty)


def value_ranges(text: Column) -> Column:
    """array<struct<from, to>> of sums of five figures or more: `from x to under y`, or `x or more` with an open end."""
    return let(flat(text), flat_ranges)


def clause(text: Column) -> Column:
    """struct<penalty, ranges> of a text that is flattened once."""
    return let(flat(text), lambda t: F.struct(flat_penalty(t).alias("penalty"), flat_ranges(t).alias("ranges")))


def flat_penalty(t: Column) -> Column:
    prison, reform = (let(after(t, words), lambda part: bounds(part, months(part))) for words in (PRISON, REFORM))
    fine = let(after(t, FINE), lambda part: bounds(part, sums(part)))
    read = F.struct(prison.alias("prison"), reform.alias("reform"), fine.alias("fine"))
    return let(read, lambda r: F.struct(
        r["prison"]["low"].alias("low"), r["prison"]["high"].alias("high"), t.contains(LIFE).alias("life"), t.contains(DEATH).alias("death"),
        r["reform"]["high"].alias("reform"), r["fine"]["low"].alias("fine_low"), r["fine"]["high"].alias("fine_high"),
    ))


def flat_ranges(t: Column) -> Column:
    said = F.regexp_extract_all(t, F.lit(rf"[\d.]{{5,}} đồng (?:{UPTO} {UNDER} [\d.]{{5,}} đồng|{ABOVE})"), F.lit(0))
    number = lambda s: F.replace(s, F.lit("."), F.lit("")).try_cast("long")
    last = lambda s: F.substring_index(F.substring_index(s, " ", -2), " ", 1)
    return F.transform(said, lambda s: F.struct(number(F.substring_index(s, " ", 1)).alias("from"), F.when(s.endswith("đồng"), number(last(s))).alias("to")))
