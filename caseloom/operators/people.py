"""Who is meant: names in texts, and short names resolved to full ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions import text as T

# Forms of address and offices that stand before a name; words that begin an office's name.
TITLES = ("ông", "bà", "anh", "chị", "em", "cô", "chú", "bác", "cháu", "giám đốc", "chủ tịch", "trưởng phòng", "kế toán", "thủ quỹ", "thủ kho", "cán bộ", "bị can", "người làm chứng")
OFFICES = ("Ban", "Phòng", "Sở", "UBND", "HĐND", "Cục", "Tổng", "Huyện", "Xã", "Tỉnh", "Bộ", "Viện", "Bệnh", "Đảng", "Đoàn")
NAME_WORDS = 4


def mentions(sentence: Column, titles: tuple[str, ...] = TITLES) -> Column:
    """array<string> of names in order: up to four capitalised words after a title, less the name of an
    office that follows. A title that begins the sentence may be capitalised."""
    titled = F.concat(F.lower(F.substring(sentence, 1, 1)), F.substring(sentence, 2, 1 << 30))
    found = F.regexp_extract_all(titled, F.lit(rf"(?<!\p{{L}})(?:{'|'.join(titles)})\s+(\p{{Lu}}\p{{Ll}}*(?:\s+\p{{Lu}}\p{{Ll}}*){{0,{NAME_WORDS - 1}}})"), F.lit(1))

    def without_office(name: Column) -> Column:
        ws = F.split(name, r"\s+")
        at = F.array_min(F.filter(F.transform(ws, lambda w, k: F.when((k > 0) & w.isin(*OFFICES), k)), lambda k: k.isNotNull()))
        return F.array_join(F.when(at.isNotNull(), F.slice(ws, 1, at)).otherwise(ws), " ")

    return F.transform(found, without_office)


def suffixes(key: Column) -> Column:
    """The proper suffixes of a key, whole words each."""
    ws = F.split(key, " ")
    return F.when(F.size(ws) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(2), F.size(ws)), lambda k: F.array_join(F.slice(ws, k, F.size(ws)), " ")))


def resolved_people(names: DataFrame, group: str = "case_id") -> DataFrame:
    """names: (group, name, known). Per group and name: (person, status, reason_names).

    Full names are cannot-linked: no two longest names are one person. A shorter name must-links to the
    longest name it ends, if there is just one; with several it is ambiguous and stays apart. As
    a name that ends a longer one is never a longest name itself, one pass over word suffixes finds
    the clusters that a walk from the longest to the shortest name would: names that are no one's
    suffix are the people, and every name asks which of them it ends. Nothing is compared pair by pair, and a
    name that a third of all mentions use is one row once mentions are distinct.

    status: clear, ambiguous (several people) or partial (one word only, and no longer name). A name
    without letters has no row."""
    key = T.match_key(F.col("name"))
    n = names.select(F.col(group), key.alias("key"), F.trim("name").alias("name"), F.coalesce("known", F.lit(False)).alias("known")).where(F.lower("name").rlike(r"\p{L}"))
    one = n.groupBy(group, "key").agg(F.count(F.lit(1)).alias("mentions"), F.min("name").alias("name"), F.bool_or("known").alias("known"))
    ends = one.select(group, F.col("key").alias("full"), F.explode(suffixes(F.col("key"))).alias("key"))
    people = one.select(group, "key").join(ends.select(group, "key").distinct(), [group, "key"], "left_anti").withColumnRenamed("key", "full")
    of = ends.join(people, [group, "full"]).groupBy(group, "key").agg(F.count(F.lit(1)).alias("__n"), F.min("full").alias("__one"), F.array_sort(F.collect_set("full")).alias("__all"))
    j = one.join(of, [group, "key"], "left")
    words = F.size(F.split(F.coalesce("__one", "key"), " "))
    status = F.when(F.col("__n") > 1, "ambiguous").when(words < 2, "partial").otherwise("clear")
    person = F.when(F.col("__n") > 1, F.col("key")).otherwise(F.coalesce("__one", "key"))
    return j.select(group, "key", "name", "mentions", "known", person.alias("person"), status.alias("status"), F.when(F.col("__n") > 1, F.col("__all")).alias("may_be"))


def aliases(resolved: DataFrame, group: str = "case_id") -> DataFrame:
    """(group, person, alias): how clear people are named: their keys, the last two words of longer ones, and
    the last word. An alias that two people share is nobody's."""
    clear = resolved.where("status = 'clear'")
    ws = F.split("person", " ")
    tail = F.array_join(F.slice(ws, -2, 2), " ")
    own = clear.select(group, "person", F.explode(F.array(F.col("key"), F.col("person"), tail, F.element_at(ws, -1))).alias("alias"))
    return own.groupBy(group, "alias").agg(F.min("person").alias("person"), F.max("person").alias("__last")).where("person = __last").select(group, "person", "alias")
