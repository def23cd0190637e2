"""Outlines of long texts: parts, chapters, sections, articles, clauses and points, line by line, and back.

A line's place is carried down from the headings above it. What looks sequential isn't: an article heading counts
only if its number is above all before it, and headings that don't count never raise that maximum, so a running
maximum decides; a heading's name may go on in lines of capitals, and a line goes on so if the last line before it that isn't
such a line is a heading. All windows run from the first line to the current one, which Spark does in one
pass over a text's sorted lines without holding them. Texts are dealt out once, in partitions that grow with the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from caseloom.session import dealt

# Forms of headings.
PART = r"^(?:Phần|PHẦN)\s+(?:thứ\s+|THỨ\s+)?(\p{L}+|\d+)[.:]?\s*(.*)$"
CHAPTER = r"^(?:Chương|CHƯƠNG)\s+([IVXLC]+|\d+)[.:]?\s*(.*)$"
SECTION = r"^(?:Mục|MỤC)\s+(\d+)[.:]\s*(.+)$"
ARTICLE = r"^Điều\s+(\d{1,3})([a-zđ]?)[.:]?\s+(.*)$"
COMMENT = r"^[Bb]ình luận\b.{0,40}$"
CLAUSE, POINT = r"^(\d{1,2})\.\s", r"^([a-zđ])\)\s"
#: Words after a number that make a line a sentence about the article, not its heading.
SENTENCE = r"^(quy định|và|hoặc|của|này|nêu|được|có|thì|là|về|trên)(?!\p{L})"
LONGEST = {"part": 120, "chapter": 160, "section": 160, "article": 260}


def capitals(t: Column) -> Column:
    """Whether a line has letters and all are capitals."""
    return t.rlike(r"\p{L}") & (F.upper(t) == t)


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n, line), n from 0; a null text has no line."""
    return docs.select("doc_id", F.posexplode(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n")).alias("n", "line"))


def outlined(lines: DataFrame, most: int = 426) -> DataFrame:
    """lines (doc_id, n, line) with kind, part, chapter, section, article, clause, point.

    kind: part, chapter, section, name (of the heading before), article, comment head, comment, body, between (after a
    heading, outside articles) or title (before anything). part, chapter, section: the heading's text with its name, of
    the nearest above, forgotten where a wider one begins; so with clause and point under an article. An
    article's number is null outside. Headings whose number doesn't rise, is above `most`, or reads on as
    a sentence, are body."""
    lines = dealt(lines, lines, "doc_id")
    t = F.btrim(F.col("line"), F.lit(" \t\u000b\u000c"))
    up = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    get = lambda p, k: F.regexp_extract(t, p, k)
    named = lambda p, k: t.rlike(p) & ((get(p, k) == "") | capitals(get(p, k)))
    short = lambda kind: F.length(t) < LONGEST[kind]
    wide = F.when(named(PART, 2) & short("part"), "part").when(named(CHAPTER, 2) & short("chapter"), "chapter").when(t.rlike(SECTION) & capitals(get(SECTION, 2)) & short("section"), "section")
    rank = get(ARTICLE, 1).try_cast("int") * 30 + F.when(get(ARTICLE, 2) == "", 0).when(get(ARTICLE, 2) == "đ", 29).otherwise(F.ascii(get(ARTICLE, 2)) - 96)
    may = t.rlike(ARTICLE) & wide.isNull() & (rank < (most + 1) * 30) & ~get(ARTICLE, 3).rlike(SENTENCE) & short("article")
    plain = capitals(t) & ~t.rlike(PART) & ~t.rlike(CHAPTER) & ~t.rlike(SECTION) & ~t.rlike(ARTICLE)
    x = lines.withColumns({"__t": t, "__w": wide, "__r": F.when(may, rank), "__plain": plain})
    # What ends a run of capitals: any line that is neither blank nor one of them.
    x = x.withColumn("__stop", F.when(~F.col("__plain") & (F.col("__t") != ""), F.coalesce("__w", F.lit("other"))))
    before = F.last("__stop", True).over(above)
    x = x.withColumns({"__name": F.col("__plain") & before.isin("part", "chapter", "section"), "__of": before, "__max": F.max("__r").over(above)})
    x = x.withColumn("__a", F.col("__r").isNotNull() & ~F.col("__name") & (F.col("__max").isNull() | (F.col("__r") > F.col("__max"))))
    # Places of the last heading of each kind; a wider one that came later forgets it.
    last = lambda c: F.coalesce(F.max(F.when(c, F.col("n"))).over(up), F.lit(-1))
    x = x.withColumns({"__np": last(F.col("__w") == "part"), "__nc": last(F.col("__w") == "chapter"), "__ns": last(F.col("__w") == "section"), "__na": last(F.col("__a")), "__nw": last(F.col("__w").isNotNull())})
    x = x.withColumn("__in", F.col("__na") > F.col("__nw"))
    # The first remark below an article's heading begins its comment.
    first = Window.partitionBy("doc_id", "__na").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("__nb", F.min(F.when(F.col("__in") & ~F.col("__a") & F.col("__t").rlike(COMMENT), F.col("n"))).over(first))
    kind = (
        F.when(F.col("__name"), "name").when(F.col("__w").isNotNull(), F.col("__w")).when(F.col("__a"), "article")
        .when(F.col("__in"), F.when(F.col("n") == F.col("__nb"), "comment head").when(F.col("n") > F.col("__nb"), "comment").otherwise("body"))
        .when(F.col("__na") < 0, "title").otherwise("between")
    )
    x = x.withColumn("kind", kind)
    # Headings and their names, joined from the first line on.
    run = F.array_join(F.collect_list(F.when(F.col("__w").isNotNull() | F.col("__name"), F.regexp_replace("__t", r"\s+", " "))).over(Window.partitionBy("doc_id", "__nw").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)), " ")
    x = x.withColumn("__said", F.when(F.col("__w").isNotNull() | F.col("__name"), run))
    told = lambda kind: F.last(F.when((F.col("__w") == kind) | (F.col("__name") & (F.col("__of") == kind)), F.col("__said")), True).over(up)
    cl, pt = (F.regexp_extract("__t", p, 1) for p in (CLAUSE, POINT))
    number = F.when((F.col("kind") == "body") & (cl != ""), cl.try_cast("int"))
    x = x.withColumns({
        "part": told("part"),
        "chapter": F.when(F.col("__nc") > F.col("__np"), told("chapter")),
        "section": F.when((F.col("__ns") > F.col("__np")) & (F.col("__ns") > F.col("__nc")), told("section")),
        "article": F.when(F.col("__in"), F.last(F.when(F.col("__a"), F.concat(F.regexp_extract("__t", ARTICLE, 1), F.regexp_extract("__t", ARTICLE, 2))), True).over(up)),
        "__cl": number,
    })
    inside = Window.partitionBy("doc_id", "__na").orderBy("n")
    risen = F.col("__cl").isNotNull() & (F.coalesce(F.max("__cl").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) < F.col("__cl"))
    x = x.withColumn("__new", risen)
    x = x.withColumn("clause", F.when(F.col("kind") == "body", F.max(F.when(F.col("__new"), F.col("__cl"))).over(first)))
    under = Window.partitionBy("doc_id", "__na", "clause").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("point", F.when((F.col("kind") == "body") & F.col("clause").isNotNull(), F.last(F.when(pt != "", pt), True).over(under)))
    return x.select(*lines.columns, "kind", "part", "chapter", "section", "article", "clause", "point")


def articles(outline: DataFrame) -> DataFrame:
    """(doc_id, article, at, head, body, comments): what each article holds, in order; body and comments are (n, line)s."""
    own = outline.where("article is not null")
    rows = lambda *kinds: F.array_sort(F.collect_list(F.when(F.col("kind").isin(*kinds), F.struct("n", "line"))))
    return own.groupBy("doc_id", "article").agg(F.min(F.when(F.col("kind") == "article", F.col("n"))).alias("at"), F.max(F.when(F.col("kind") == "article", F.col("line"))).alias("head"), rows("body").alias("body"), rows("comment head", "comment").alias("comments"))


def rebuilt(outline: DataFrame) -> DataFrame:
    """(doc_id, n, line) written again from the articles and from what stands outside them."""
    a = articles(outline)
    inside = a.select("doc_id", F.explode(F.concat(F.array(F.struct(F.col("at").alias("n"), F.col("head").alias("line"))), "body", "comments")).alias("x")).select("doc_id", "x.n", "x.line")
    return inside.unionByName(outline.where("article is null").select("doc_id", "n", "line"))
