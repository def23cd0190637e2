"""Text kernels as Column expressions (no Python workers)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Letters with marks and the letters they fold to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿăđĩũơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyadiuouaaaaaaaaaaaaeeeeeeeeiioooooooooooouuuuuuuyyyy"
STOP_WORDS = ("and", "the", "of", "to", "in", "is", "de", "la", "le", "el", "y", "en", "un", "des", "der", "die", "und", "den")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def match_key(text: Column) -> Column:
    """Lower case; runs of anything but letters and digits become one space; trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def fold(text: Column) -> Column:
    """Lower case without accents; the length stays, so offsets stay valid."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def tokens(text: Column, least: int = 2, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Folded runs of a-z and 0-9 of at least `least` characters that aren't stop words."""
    parts = F.split(fold(text), "[^a-z0-9]+")
    return F.filter(parts, lambda w: (F.length(w) >= least) & ~w.isin(*stop))


def bigrams(words: Column) -> Column:
    """Adjacent pairs, joined by a space. The words are computed once."""
    pairs = lambda ws: F.zip_with(F.slice(ws, 1, F.size(ws) - 1), F.slice(ws, 2, F.size(ws) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return let(words, lambda ws: F.when(F.size(ws) < 2, F.array().cast("array<string>")).otherwise(pairs(ws)))


def counts(values: Column) -> Column:
    """array<struct<value, n>> of an array's values without nulls, sorted: equal ones become neighbours, so no value leaves its row."""
    first = lambda vs: F.filter(F.transform(vs, lambda _, i: i), lambda i: (i == 0) | (F.get(vs, i) != F.get(vs, i - 1)))
    runs = lambda vs, at: F.transform(at, lambda i, k: F.struct(F.get(vs, i).alias("value"), (F.coalesce(F.get(at, k + 1), F.size(vs)) - i).alias("n")))
    return let(F.sort_array(values), lambda vs: let(first(vs), lambda at: runs(vs, at)))


def sentences(text: Column, least: int = 1) -> Column:
    """Split after . ! ? … and at line ends; trimmed parts of at least `least` characters."""
    parts = F.split(text, r"(?<=[.!?…])\s+|\n+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """|a ∩ b| / |a ∪ b| of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length of the folded texts; 1 if both are empty."""
    a, b = fold(F.trim(a)), fold(F.trim(b))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def truncate(text: Column, n: int) -> Column:
    """White space collapsed, cut to n characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, n - 1)), F.lit("…")))


def slug(text: Column, n: int = 40) -> Column:
    return F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, n), "-$", "")


def html_escape(text: Column) -> Column:
    for mark, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(mark), F.lit(code))
    return text


def html_strip(html: Column) -> Column:
    """Text of simple HTML: script and style bodies go, block ends become lines, tags go."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr)>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for code, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return F.btrim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n\s*\n+", "\n"), F.lit(" \n"))


def token_estimate(text: Column) -> Column:
    """Rough token budget of a prompt: 3.2 characters each, and 8 for the message."""
    return (F.ceil(F.length(text) / 3.2) + 8).cast("long")


def word_prefix(text: Column, token: str) -> Column:
    """Whether a word of the folded text begins with token."""
    return F.concat(F.lit(" "), match_key(fold(text))).contains(" " + token)


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, 0 where there is nothing to divide by."""
    return F.when(whole == 0, F.lit(0)).otherwise(F.floor(100.0 * part / whole + 0.5)).cast("int")
