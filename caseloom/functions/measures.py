"""Money, durations, ages and percents in text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from caseloom.functions import text as T


def duration_months(text: Column) -> Column:
    """Months of a term written with năm (years) and tháng (months), with or without their marks; null if it has neither."""
    part = lambda unit: F.regexp_extract(T.fold(text), rf"(\d+)\s*{unit}(?![a-z])", 1).try_cast("int")
    years, months = part("nam"), part("thang")
    return F.when(years.isNotNull() | months.isNotNull(), F.coalesce(12 * years, F.lit(0)) + F.coalesce(months, F.lit(0)))


def money(amount: Column) -> Column:
    """Amount in tỷ or triệu with at most three decimals (comma), below that in full with dots."""
    def scaled(by: int, unit: str) -> Column:
        figure = F.regexp_replace(F.round(amount / by, 3).cast("decimal(20,3)").cast("string"), r"\.?0+$", "")
        return F.concat(F.replace(figure, F.lit("."), F.lit(",")), F.lit(f" {unit}"))

    whole = F.translate(F.format_number(amount, 0), ",", ".")
    return F.when(amount >= 1_000_000_000, scaled(1_000_000_000, "tỷ")).when(amount >= 1_000_000, scaled(1_000_000, "triệu")).otherwise(F.concat(whole, F.lit(" đồng")))


def age_at(birth: Column, day: Column) -> Column:
    """Whole years at `day`, by comparing month and day."""
    before = (F.month(day) * 100 + F.dayofmonth(day)) < (F.month(birth) * 100 + F.dayofmonth(birth))
    return F.year(day) - F.year(birth) - before.cast("int")


def percent_near(text: Column, words: str, reach: int = 80) -> Column:
    """array<double>: percents that stand within `reach` characters after one of `words`
    (alternatives of a regular expression)."""
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"(?s)(?:{words}).{{0,{reach}}}?(\d+(?:[.,]\d+)?)\s*%"), F.lit(1))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double"))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/:?#]+)", 1))


def allowed(url: Column, hosts: tuple[str, ...]) -> Column:
    """Whether the host is loopback, private or on the list."""
    h = host(url)
    return h.isin("localhost", *hosts) | h.rlike(r"^(127|10)\.\d+\.\d+\.\d+$|^192\.168\.\d+\.\d+$|^172\.(1[6-9]|2\d|3[01])\.\d+\.\d+$")


def seal(text: Column, key: str, name: Column) -> Column:
    """AES-GCM with the entry's name as additional data, so entries cannot be swapped. Each
    row gets a random nonce of its own, so sealing twice gives two values."""
    return F.aes_encrypt(text, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), name)


def unseal(sealed: Column, key: str, name: Column) -> Column:
    return F.aes_decrypt(sealed, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), name).cast("string")
