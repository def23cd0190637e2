"""Keyed collections of JSON: read once as VARIANT, taken apart to any depth, salvaged where they are damaged."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from caseloom.session import materialize

TRIES = 400  # fixed value: cuts that are tried, from the last one on


def records(rows: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(keys, record, value): one row for each entry of the object or array in `column`; value is a VARIANT, record the entry's
    name or place. Text that isn't JSON has no rows."""
    parsed = rows.select(*keys, F.try_parse_json(column).alias("__v")).where("__v is not null")
    return exploded(parsed, keys, "__v").select(*keys, F.coalesce("key", F.col("pos").cast("string")).alias("record"), "value")


def exploded(rows: DataFrame, keys: Sequence[str], column: str, outer: bool = False) -> DataFrame:
    """rows with (pos, key, value) for each member of the VARIANT in `column`; scalars have none or, if outer, one of nulls."""
    spark = rows.sparkSession
    return spark.sql("SELECT r.*, e.pos, e.key, e.value FROM {rows} r, LATERAL variant_explode" + "_outer" * outer + "(r." + column + ") e", rows=rows)


def leaves(rows: DataFrame, keys: Sequence[str], column: str = "value", deepest: int = 64) -> DataFrame:
    """(keys, path, value, kind): every scalar inside the VARIANT, whatever its depth, with its path in the form that `at_path`
    takes. The rows are stored once. A row is then taken apart where it is, level by level: members of a container take its
    place and scalars stay, so there are as many steps as levels and nothing is stored between them. A look at the stored rows
    before each step tells whether any container is left; beyond `deepest` levels, or for empty containers, there are no leaves."""
    stored = materialize(rows.select(*keys, F.col(column).alias("__v")), "leaves")
    level = stored.select(*keys, F.lit("$").alias("path"), "__v", F.lit(True).alias("__open"))
    inside = F.schema_of_variant("__v").rlike("^(OBJECT|ARRAY)")
    for _ in range(deepest - 1):
        if level.where(F.col("__open") & inside).isEmpty():
            break
        out = exploded(level.withColumn("__in", F.when(F.col("__open"), F.col("__v"))), keys, "__in", outer=True)
        member = F.col("pos").isNotNull()
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), "pos", F.lit("]"))).otherwise(F.concat(F.lit("['"), "key", F.lit("']")))
        path = F.when(member, F.concat("path", step)).otherwise(F.col("path"))
        level = out.select(*keys, path.alias("path"), F.when(member, F.col("value")).otherwise(F.col("__v")).alias("__v"), member.alias("__open"))
    return level.where(~inside).select(*keys, "path", F.col("__v").cast("string").alias("value"), F.lower(F.schema_of_variant("__v")).alias("kind"))


def at_path(value: Column, path: str, kind: str = "string") -> Column:
    """The value at a path of a VARIANT; null where there is none, or none of that kind."""
    return F.try_variant_get(value, path, kind)


@F.pandas_udf(StringType())
def with_path(texts: pd.Series, paths: pd.Series, values: pd.Series) -> pd.Series:
    """JSON texts with `value` (JSON too) put at a dotted path, whose missing objects are made. A path through a scalar or beyond an
    array's end, or text that isn't JSON, changes nothing."""

    def put(text, path, value):
        if text is None or path is None:
            return text
        try:
            whole, new = json.loads(text), json.loads(value) if value is not None else None
        except ValueError:
            return text
        at, names = whole, path.split(".")
        for k, name in enumerate(names):
            end = k == len(names) - 1
            if isinstance(at, list) and name.isdigit() and int(name) < len(at):
                name = int(name)
            elif not isinstance(at, dict):
                return text
            if end:
                at[name] = new
            else:
                at = at.setdefault(name, {}) if isinstance(at, dict) else at[name]
        return json.dumps(whole, ensure_ascii=False, separators=(",", ":"))

    return pd.Series([put(*r) for r in zip(texts, paths, values, strict=True)])


def cuts(text: str) -> tuple[int | None, list[tuple[int, str]]]:
    """Where the object that begins the text ends, if it does; and the places at which it may be cut, with the brackets that then
    close it: after a bracket that closes, and before a comma of an array or of the whole."""
    open_, places, quoted, skip = [], [], False, False
    for k, c in enumerate(text):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]":
            if open_:
                open_.pop()
            if not open_:
                return k + 1, places
            places.append((k + 1, "".join(reversed(open_))))
        elif c == "," and open_ and (open_[-1] == "]" or len(open_) == 1):
            places.append((k, "".join(reversed(open_))))
    return None, places


def salvage(text: str | None) -> str | None:
    start = (text or "").find("{")
    if start < 0:
        return None
    text = text[start:]
    end, places = cuts(text)
    tries = [(end, "")] if end else list(reversed(places[-TRIES:]))
    for at, close in tries:
        try:
            whole = json.loads(text[:at] + close)
        except ValueError:
            continue
        if isinstance(whole, dict):
            return json.dumps(whole, ensure_ascii=False, separators=(",", ":"))
    return None


@F.pandas_udf(StringType())
def salvaged(texts: pd.Series) -> pd.Series:
    """The first JSON object inside prose, compact; of one that is cut short, what is whole of it, closed; null without any."""
    return texts.map(salvage)
