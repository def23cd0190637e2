"""The syllable grammar of Vietnamese, and texts in its old font encodings. Column expressions.

A syllable is an initial, a rhyme (nucleus and coda) and a tone. Letters that come decomposed and letters that come whole are read
alike: the tone is parted from the letter it stands on, then the letter's own mark joins it again."""

from __future__ import annotations

import re
from functools import cache

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from caseloom.functions.text import counts, let

# Tones in their order (level, huyền, sắc, hỏi, ngã, nặng) and the vowels that carry them.
TONES = ("", "̀", "́", "̉", "̃", "̣")
TONED = {
    "a": "àáảãạ", "ă": "ằắẳẵặ", "â": "ầấẩẫậ", "e": "èéẻẽẹ", "ê": "ềếểễệ", "i": "ìíỉĩị",
    "o": "òóỏõọ", "ô": "ồốổỗộ", "ơ": "ờớởỡợ", "u": "ùúủũụ", "ư": "ừứửữự", "y": "ỳýỷỹỵ",
}
MARKED = {"ă": "ă", "â": "â", "ê": "ê", "ô": "ô", "ơ": "ơ", "ư": "ư"}
# Initials, longest first; nuclei with the codas that may follow ("-" for none).
INITIALS = ("ngh", "ch", "gh", "gi", "kh", "ng", "nh", "ph", "qu", "th", "tr", "b", "c", "d", "đ", "g", "h", "k", "l", "m", "n", "p", "r", "s", "t", "v", "x")
CODAS = {
    "a": "- i o u y m n ng nh p t c ch", "ă": "- m n ng p t c", "â": "- m n ng p t c u y", "e": "- o m n ng p t c", "ê": "- u m n nh p t ch", "i": "- a u m n nh p t ch",
    "iê": "m n ng p t c u", "y": "-", "yê": "m n ng t u", "o": "- i m n ng p t c", "oo": "c ng", "ô": "- i m n ng p t c", "ơ": "- i m n p t", "u": "- a i m n ng p t c", "uô": "i m n ng t c",
    "ư": "- a i u m n ng t c", "ươ": "i u m n ng p t c", "oa": "- i o y m n ng nh p t c ch", "oă": "m n ng p t c", "oe": "- o m n t", "uâ": "- n ng t y", "uê": "- ch nh", "uơ": "-",
    "uy": "- a u n nh p t ch", "uyê": "n t",
}
#: Rhymes after qu, whose u is part of the initial: those of these nuclei, and some with y alone.
AFTER_QU, ONLY_AFTER_QU = ("a", "ă", "â", "e", "ê", "i", "iê", "o", "ô", "ơ", "y", "yê"), ("ynh", "ych", "yt")
STOPS = ("p", "t", "c", "ch")


def rhymes(nuclei: tuple[str, ...] | None = None) -> list[str]:
    return [n + c.replace("-", "") for n, codas in CODAS.items() if nuclei is None or n in nuclei for c in codas.split()]


_FROM = "".join(v for v in TONED.values())
_BASE = "".join(k * 5 for k in TONED)
_DIGIT = "12345" * len(TONED)
_COMBINING = "".join(TONES[1:])


def tone_digits(word: Column) -> Column:
    """A digit for each tone mark, 1 to 5."""
    only = F.regexp_replace(F.lower(word), f"[^{_FROM}{_COMBINING}]", "")
    return F.translate(only, _FROM + _COMBINING, _DIGIT + "12345")


def toneless(word: Column) -> Column:
    """The word in lower case without tones; ă â ê ô ơ ư đ stay, as single letters."""
    out = F.regexp_replace(F.translate(F.lower(word), _FROM, _BASE), f"[{_COMBINING}]", "")
    for apart, joined in MARKED.items():
        out = F.replace(out, F.lit(apart), F.lit(joined))
    return out


def initial(base: Column) -> Column:
    """The longest initial that something follows."""
    return F.regexp_extract(base, f"^({'|'.join(INITIALS)}).", 1)


def rhyme(base: Column) -> Column:
    """What follows the initial; gi lends its i to a rhyme that lacks one (gì, gìn, giếng)."""
    rest = F.regexp_replace(base, f"^({'|'.join(INITIALS)})(?=.)", "")
    return F.when(base.rlike("^gi[nmtpcê]"), F.concat(F.lit("i"), rest)).otherwise(rest)


def parsed(word: Column) -> Column:
    """struct<base, digits, start, r>: the toneless word, its tones, its initial and its rhyme."""
    whole = lambda b: F.struct(b["base"].alias("base"), b["digits"].alias("digits"), initial(b["base"]).alias("start"), rhyme(b["base"]).alias("r"))
    # Plain letters have no tone to part.
    plain = F.when(F.lower(word).rlike("^[a-z]*$"), F.struct(F.lower(word).alias("base"), F.lit("").alias("digits")))
    return let(plain.otherwise(F.struct(toneless(word).alias("base"), tone_digits(word).alias("digits"))), whole)


def problem(word: Column) -> Column:
    """Why the word is no syllable: empty, two tones, foreign letter, strange sign, no rhyme, rhyme after qu, q without u, rhyme, c or k, g or gh,
    ng or ngh, iê or yê, or tone of a stopped rhyme; null if it is one."""
    return let(parsed(word), fault)


def fault(p: Column) -> Column:
    base, digits, start, r = (p[c] for c in ("base", "digits", "start", "r"))
    front, front_e = r.rlike("^[ieêy]"), r.rlike("^[ieê]")
    stopped = r.rlike(f"({'|'.join(STOPS)})$")
    after_qu = [x for x in [*rhymes(AFTER_QU), *ONLY_AFTER_QU] if x != "ia"]
    return (
        F.when(base == "", "empty")
        .when(F.length(digits) > 1, "two tones")
        .when(base.rlike("[fjwz]"), "foreign letter")
        .when(base.rlike("[^a-zâăêôơưđ]"), "strange sign")
        .when(r == "", "no rhyme")
        .when((start == "qu") & ~r.isin(after_qu), "rhyme after qu")
        .when((start != "qu") & ~r.isin(rhymes()), F.when(base.startswith("q"), "q without u").otherwise("rhyme"))
        .when(((start == "k") & ~front) | ((start == "c") & front), "c or k")
        .when(((start == "gh") & ~front) | ((start == "g") & r.rlike("^[eê]")), "g or gh")
        .when(((start == "ngh") & ~front_e) | ((start == "ng") & front_e), "ng or ngh")
        .when((r.startswith("yê") & (start != "") & (start != "qu")) | (r.startswith("iê") & (start == "")), "iê or yê")
        .when(stopped & ~F.coalesce(F.right(digits, F.lit(1)).isin("2", "5"), F.lit(False)), "tone of a stopped rhyme")
    )


def valid_share(text: Column, longest: int = 7) -> Column:
    """The share of syllables among words of at most `longest` letters; 0 without words. Each word of a text is parsed once, however
    often it occurs there."""
    words = F.filter(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{M}]+)"), F.lit(1)), lambda w: F.length(w) <= longest)
    total = lambda cs, n: F.aggregate(cs, F.lit(0), lambda a, c: a + n(c))
    good = lambda c: F.when(problem(c["value"]).isNull(), c["n"]).otherwise(0)
    share = lambda cs: F.when(F.size(cs) > 0, total(cs, good) / total(cs, lambda c: c["n"])).otherwise(0.0)
    return let(counts(words), share)


def tone_place(base: Column) -> Column:
    """Place, from 1, of the letter that carries the tone: the marked vowel (of ươ the second); else, less the u of qu and the
    i of gi, the middle one of three, the second of two before a coda or in oa, oe, uy, or else the first. 0 without a vowel."""
    at = lambda text, pattern: F.coalesce(F.regexp_instr(text, F.lit(pattern)), F.lit(0))
    marked = F.when(at(base, "ươ") > 0, at(base, "ươ") + 1).otherwise(at(base, "[ăâêôơư]"))
    skip = F.when(base.rlike("^qu.*[aeioy]|^gi.*[aeouy]"), 2).otherwise(0)
    rest = F.substring(base, skip + 1, F.length(base))
    run = F.regexp_extract(rest, "([aeiouy]+)", 1)
    first = at(rest, "[aeiouy]")
    open_ = rest.rlike("[aeiouy]$")
    second = (F.length(run) >= 3) | ((F.length(run) == 2) & (~open_ | run.isin("oa", "oe", "uy")))
    return F.when(marked > 0, marked).when(first == 0, 0).otherwise(skip + first + second.cast("int"))


def with_tone(base: Column, tone: Column) -> Column:
    """The toneless base with a tone, 0 to 5, on the letter that carries it."""
    at = tone_place(base)
    letter = F.substring(base, at, F.lit(1))
    carried = F.coalesce(*[F.when(tone == k, F.translate(letter, "".join(TONED), "".join(v[k - 1] for v in TONED.values()))) for k in range(1, 6)])
    return F.when((tone == 0) | (at == 0), base).otherwise(F.concat(F.substring(base, F.lit(1), at - 1), carried, F.substring(base, at + 1, F.length(base))))


def misplaced(word: Column) -> Column:
    """The right spelling of a syllable whose tone stands on the wrong letter; null for any other word. Both usages in oa, oe and uy at
    a syllable's end are right."""
    return let(parsed(word), lambda p: right_spelling(word, p))


def right_spelling(word: Column, p: Column) -> Column:
    base, tone = p["base"], p["digits"].try_cast("int")
    right = with_tone(base, tone)
    either = base.rlike("(oa|oe|uy)$") & ~base.startswith("qu")
    head = F.substring(base, F.lit(1), F.length(base) - 2)
    older = F.concat(head, with_tone(F.substring(base, F.length(base) - 1, F.lit(1)), tone), F.right(base, F.lit(1)))
    # Composed as it is written: each toned letter whole.
    low = F.lower(word)
    for letter, toned in [*MARKED.items(), *((k + TONES[n + 1], v[n]) for k, v in TONED.items() for n in range(5))]:
        low = F.replace(low, F.lit(letter), F.lit(toned))
    return F.when((F.length(p["digits"]) == 1) & fault(p).isNull() & (low != right) & ~(either & (low == older)), right)


# Codes of the one-byte font encoding, and what they stand for.
TCVN = "¡¢£¤¥¦§¨©ª«¬­®µμ¶·¸¹»¼½¾ÆÇÈÉÊËÌÎÏÐÑÒÓÔÕÖ×ØÜÝÞßáâãäåæçèéêëìíîïñòóôõö÷øùúûüýþ"
TCVN_LETTERS = "ĂÂÊÔƠƯĐăâêôơưđààảãáạằẳẵắặầẩẫấậèẻẽéẹềểễếệìỉĩíịòỏõóọồổỗốộờởỡớợùủũúụừửữứựỳỷỹýỵ"
# Fixed values of the two-character font encoding: single codes, and what follows a vowel: tones (in the order of
# TONES), tones with a hat (none first), tones with a breve (none first).
VNI_ONE = {"í": "í", "ì": "ì", "æ": "ỉ", "ó": "ĩ", "ò": "ị", "î": "ỵ", "ô": "ơ", "ö": "ư", "ñ": "đ"}
VNI_TONE, VNI_HAT, VNI_BREVE = "øùûõï", "âàáåãä", "êèéúüë"


@cache
def vni_codes() -> dict[str, str]:
    """Codes of one and two characters, both cases, with their letters."""
    out = dict(VNI_ONE)
    for vowel, toned in TONED.items():
        if vowel in "aeouy":
            out |= {vowel + m: t for m, t in zip(VNI_TONE, toned, strict=True)}
    for code, vowel in (("ô", "ơ"), ("ö", "ư")):
        out |= {code + m: t for m, t in zip(VNI_TONE, TONED[vowel], strict=True)}
    for vowel, hat in (("a", "â"), ("e", "ê"), ("o", "ô")):
        out |= {vowel + m: t for m, t in zip(VNI_HAT, hat + TONED[hat], strict=True)}
    out |= {"a" + m: t for m, t in zip(VNI_BREVE, "ă" + TONED["ă"], strict=True)}
    upper = {k.upper(): v.upper() for k, v in out.items()}
    return out | upper | {k[0].upper() + k[1:]: v.upper() for k, v in out.items()}


def from_tcvn(text: Column) -> Column:
    """Text of the one-byte encoding: each code is one letter."""
    return F.translate(text, TCVN, TCVN_LETTERS)


@F.pandas_udf(StringType())
def from_vni(texts: pd.Series) -> pd.Series:
    """Text of the two-character encoding: the longest code at each place, in one pass."""
    codes = vni_codes()
    pattern = re.compile("|".join(sorted(map(re.escape, codes), key=len, reverse=True)))
    return texts.map(lambda t: None if t is None else pattern.sub(lambda m: codes[m[0]], t))


def encoding(text: Column) -> Column:
    """tcvn, vni or null: which of the old encodings makes most of the words syllables. Texts that hold letters of
    Vietnamese as they are, that have fewer than two codes, or that gain less than 15 % are left as they are."""
    sound = lambda t: valid_share(t)
    codes = F.length(F.regexp_replace(text, f"[^{TCVN}]", ""))
    now, t, v = sound(text), sound(from_tcvn(text)), sound(from_vni(text))
    best = F.greatest(t, v)
    return F.when(text.rlike("[ạ-ỹ]") | (codes < 2) | (best < now + 0.15), None).when(t >= v, "tcvn").otherwise("vni")


def modern(text: Column, code: Column) -> Column:
    """The text in Unicode, by the encoding that `encoding` names."""
    return F.when(code == "tcvn", from_tcvn(text)).when(code == "vni", from_vni(text)).otherwise(text)
