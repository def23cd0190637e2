"""Numbers in words, and words back into numbers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from caseloom.functions.text import let

# Digits, the words of a group of three, and the names of groups.
DIGITS = ("không", "một", "hai", "ba", "bốn", "năm", "sáu", "bảy", "tám", "chín")
HUNDRED, TEN, TENS, ODD, POINT, MINUS, CURRENCY, EXACT = "trăm", "mười", "mươi", "linh", "phẩy", "âm", "đồng", "chẵn"
AFTER_TENS = {1: "mốt", 4: "tư", 5: "lăm"}
GROUPS = ("", "nghìn", "triệu", "tỷ")
BILLION = 3  # groups of three digits in the largest named group


def word(digit: Column) -> Column:
    return F.get(F.array(*map(F.lit, DIGITS)), digit)


def group_words(n: Column, first: Column) -> Column:
    """A group of three digits, as an array of words; all three are read unless it is the first group."""
    hundreds, tens, ones = F.floor(n / 100).cast("int"), F.floor(n % 100 / 10).cast("int"), (n % 10).cast("int")
    whole = (hundreds > 0) | ~first
    said = F.when((ones == 1) & (tens > 1), AFTER_TENS[1]).when((ones == 4) & (tens > 1), AFTER_TENS[4]).when((ones == 5) & (tens > 0), AFTER_TENS[5]).otherwise(word(ones))
    parts = [
        F.when(whole, word(hundreds)), F.when(whole, HUNDRED), F.when((tens == 0) & (ones > 0) & whole, ODD), F.when(tens == 1, TEN),
        F.when(tens > 1, word(tens)), F.when(tens > 1, TENS), F.when(ones > 0, said),
    ]
    return F.array_compact(F.array(*parts))


def group_name(place: Column) -> Column:
    """Words after the group at a place from the right: thousand, million, or billion for each three places."""
    small = F.get(F.array(*map(F.lit, GROUPS)), (place % BILLION).cast("int"))
    large = F.array_repeat(F.lit(GROUPS[BILLION]), F.floor(place / BILLION).cast("int"))
    return F.filter(F.concat(F.array(small), large), lambda w: w != "")


def whole_words(digits: Column) -> Column:
    """A string of digits in words."""

    def of(text: Column) -> Column:
        n = F.ceil(F.length(text) / 3).cast("int")
        groups = F.regexp_extract_all(F.lpad(text, n * 3, "0"), F.lit(r"(\d{3})"), F.lit(1))

        def part(group: Column, k: Column) -> Column:
            said = let(group.cast("int"), lambda v: F.when(v > 0, F.concat(group_words(v, k == 0), group_name(n - 1 - k))))
            return F.coalesce(said, F.array().cast("array<string>"))

        return F.when(text == "0", DIGITS[0]).otherwise(F.array_join(F.flatten(F.transform(groups, part)), " "))

    return let(F.regexp_replace(digits, r"^0+(?=\d)", ""), of)


def plain(text: Column) -> Column:
    """struct<minus, whole, part>: a number as people write it: of both separators the last is the decimal mark; one
    alone parts thousands if three digits follow; several of a kind part thousands. Null if it is none."""
    s = F.regexp_replace(F.regexp_replace(text, r"\s+", ""), "(?i)vnđ|vnd|đ", "")
    body = F.regexp_replace(s, "^-", "")
    marks = F.regexp_replace(body, r"\d", "")
    last = F.right(marks, F.lit(1))
    both = marks.rlike(r"\..*,|,.*\.")
    pieces = F.split(body, "[.,]")
    tail = F.element_at(pieces, -1)
    threes = F.forall(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.length(p) == 3)
    decimal = both | ((F.length(marks) == 1) & ~((F.length(tail) == 3) & (pieces[0] != "")))
    wrong = ~body.rlike(r"^[\d.,]+$") | (both & (F.length(F.replace(marks, last, F.lit(""))) + 1 != F.length(marks))) | (~both & (F.length(marks) > 1) & ~threes)
    whole = F.when(decimal, F.array_join(F.slice(pieces, 1, F.size(pieces) - 1), "")).otherwise(F.array_join(pieces, ""))
    clean = F.regexp_replace(F.when(whole == "", "0").otherwise(whole), r"^0+(?=\d)", "")
    part = F.when(decimal, F.regexp_replace(tail, "0+$", "")).otherwise("")
    return F.when(~wrong, F.struct(s.startswith("-").alias("minus"), clean.alias("whole"), part.alias("part")))


def number_words(text: Column) -> Column:
    """A written number in words: short decimals as a number, others digit by digit. Null if it is no number."""
    return let(plain(text), plain_words)


def plain_words(p: Column) -> Column:
    by_digit = F.array_join(F.transform(F.regexp_extract_all(p["part"], F.lit(r"(\d)"), F.lit(1)), lambda d: word(d.cast("int"))), " ")
    part = F.when((F.length(p["part"]) <= 2) & ~p["part"].startswith("0"), whole_words(p["part"])).otherwise(by_digit)
    said = let(whole_words(p["whole"]), lambda w: F.when(p["part"] == "", w).otherwise(F.concat_ws(" ", w, F.lit(POINT), part)))
    return F.when(p.isNotNull(), let(said, lambda x: F.when(p["minus"] & (x != DIGITS[0]), F.concat(F.lit(MINUS + " "), x)).otherwise(x)))


def money_words(text: Column) -> Column:
    """A sum as vouchers write it: capitalised, with the currency, and `chẵn` if it is whole."""
    said = F.concat(number_words(text), F.lit(f" {CURRENCY}"), F.when(plain(text)["part"] == "", f" {EXACT}").otherwise(""))
    return F.concat(F.upper(F.substring(said, 1, 1)), F.substring(said, 2, 1 << 20), F.lit("."))


def words_number(text: Column) -> Column:
    """The whole number that words say, below 10^18; null for words that it doesn't know. Each word becomes a number (a digit, or
    the power that it stands for, as a negative number), and a fold gathers them: digits and tens in a group, thousands and millions
    of a billion's part, and each billion multiplies what is set down before it."""
    values = {w: k for k, w in enumerate(DIGITS)} | {v: k for k, v in AFTER_TENS.items()} | {HUNDRED: -100, TENS: -10, TEN: -11, ODD: -1, GROUPS[1]: -1000, GROUPS[2]: -1_000_000, GROUPS[3]: -1_000_000_000}
    table = F.create_map(*[x for w, v in values.items() for x in (F.lit(w), F.lit(v).cast("long"))])
    codes = F.transform(F.split(F.trim(F.lower(text)), r"\s+"), lambda w: F.element_at(table, w))
    state = lambda total, part, tens, one: F.struct(total.alias("total"), part.alias("part"), tens.alias("tens"), one.alias("one"))
    zero = F.lit(0).cast("long")

    def step(a: Column, c: Column) -> Column:
        total, part, tens, one = (a[x] for x in ("total", "part", "tens", "one"))
        return (
            F.when(c >= 0, state(total, part, tens + one, c))
            .when(c == -1, a)
            .when(c == -11, state(total, part, tens + one + 10, zero))
            .when(c >= -100, state(total, part, tens - one * c, zero))
            .when(c > -1_000_000_000, state(total, part - (tens + one) * c, zero, zero))
            .otherwise(state(total + (part + tens + one) * 1_000_000_000, zero, zero, zero))
        )

    read = lambda cs: F.aggregate(cs, state(zero, zero, zero, zero), step, lambda a: a["total"] + a["part"] + a["tens"] + a["one"])
    return let(codes, lambda cs: F.when(F.forall(cs, lambda c: c.isNotNull()), read(cs)))
