"""Phrases, the rules made of them, and the scenes that show them best.

Rules are tables. Phrases are compiled into one multi-pattern automaton in each task; tables of
more than BLOCK_CHARS characters go in blocks, one pass each, so what a task holds is bounded whatever the
table's size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from caseloom.operators import ranges
from caseloom.session import dealt

BLOCK_CHARS = 4_000_000
# Sentences in a scene; share of the weight for a high level; weights that make evidence strong.
SCENE, HIGH, HEAVY = 3, 0.75, 2


def lowered(text: str) -> str:
    """Lower case of the same length, so places stay valid."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def automaton(phrases: list[tuple[str, str, str]]) -> ahocorasick.Automaton:
    own: dict[str, list[tuple[str, str, str]]] = {}
    for p in phrases:
        own.setdefault(lowered(p[1]), []).append(p)
    auto = ahocorasick.Automaton()
    for low, ps in own.items():
        auto.add_word(low, (len(low), ps))
    auto.make_automaton()
    return auto


def matches(auto: ahocorasick.Automaton, text: str, limits: bool = True) -> Iterator[tuple[int, int, str, str]]:
    """(start, stop, kind, phrase id) of hits, on word limits or anywhere, by their ends."""
    low = lowered(text)
    for end, (n, ps) in auto.iter(low):
        start, stop = end + 1 - n, end + 1
        inside = start and low[start - 1].isalnum() and low[start].isalnum() or stop < len(low) and low[stop].isalnum() and low[end].isalnum()
        if not (limits and inside):
            for phrase_id, _, kind in ps:
                yield start, stop, kind, phrase_id


def outside(hits: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Hits to find that no harmless hit overlaps and outreaches on a side: both sorted, one sweep."""
    harmless = sorted({h[:2] for h in hits if h[2] == "harmless"})
    kept, begun, at = [], [], 0
    for h in sorted(h for h in hits if h[2] == "find"):
        while at < len(harmless) and harmless[at][0] < h[1]:
            begun.append(harmless[at])
            at += 1
        begun = [s for s in begun if s[1] > h[0]]  # later hits start no earlier
        if not any(s[0] < h[0] or s[1] > h[1] for s in begun if s[0] < h[1]):
            kept.append(h)
    return kept


def raw_hits(rows: DataFrame, keys: Sequence[str], text: str, phrases: list[tuple[str, str, str]], settled: bool, limits: bool) -> DataFrame:
    fields = [StructField(k, rows.schema[k].dataType) for k in keys]
    fields += [StructField("phrase_id", StringType()), StructField("start", IntegerType()), StructField("stop", IntegerType()), StructField("kind", StringType())]
    types = to_arrow_schema(StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(phrases)
        for batch in batches:
            at, found = [], []
            for k, t in enumerate(batch.column(text)):
                hits = list(matches(auto, t.as_py() or "", limits)) if phrases else []
                if settled:
                    hits = [] if any(h[2] == "deny" for h in hits) else outside(hits)
                at += [k] * len(hits)
                found += hits
            own = [batch.column(k).take(pa.array(at, pa.int32())) for k in keys]
            cols = [pa.array([h[3] for h in found], pa.string()), pa.array([h[0] for h in found], pa.int32()), pa.array([h[1] for h in found], pa.int32()), pa.array([h[2] for h in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*own, *cols], schema=types)

    return rows.select(*keys, text).mapInArrow(run, StructType(fields))


def phrase_hits(rows: DataFrame, keys: Sequence[str], text: str, phrases: DataFrame, block_chars: int = BLOCK_CHARS, limits: bool = True) -> DataFrame:
    """(keys, phrase_id, start, stop): where phrases (phrase_id, phrase, kind) stand in each row's text,
    whatever their case, on word limits unless `limits` is unset. keys tell rows apart.

    kind `find`: these are the hits. `harmless`: a hit that a harmless phrase overlaps and outreaches on a
    side doesn't count (one that covers the harmless phrase does). `deny`: a row with such a phrase
    has no hits. Hits are tested against the harmless ones of their text in the task that finds them; only
    a table of several blocks needs a join for it. Null texts, and empty or null phrases, hit nothing."""
    blocks: list[list[tuple[str, str, str]]] = [[]]
    held = 0
    for p in phrases.select(F.col("phrase_id").cast("string"), "phrase", "kind").where("phrase <> ''").toLocalIterator():
        if held >= block_chars:
            blocks.append([])
            held = 0
        blocks[-1].append(tuple(p))
        held += len(p[1])
    if len(blocks) == 1:
        return raw_hits(rows, keys, text, blocks[0], True, limits).drop("kind")
    every = raw_hits(rows, keys, text, blocks[0], False, limits)
    for b in blocks[1:]:
        every = every.unionByName(raw_hits(rows, keys, text, b, False, limits))
    denied = every.where("kind = 'deny'").select(*keys).distinct()
    found = every.where("kind = 'find'").join(denied, list(keys), "left_anti").drop("kind")
    harmless = every.where("kind = 'harmless'").select(*keys, F.col("start").alias("__from"), F.col("stop").alias("__to"))
    met = ranges.overlapping(found, harmless, ("start", "stop"), ("__from", "__to"), keys, closed=False)
    gone = met.where("__from < start or __to > stop").select(*found.columns).distinct()
    return found.join(gone, found.columns, "left_anti")


def scene_starts(at: Column) -> Column:
    """Scenes of SCENE sentences that hold the sentence: those that begin at it or just before."""
    return F.sequence(F.greatest(at - (SCENE - 1), F.lit(0)), at)


def recognised(sentences: DataFrame, elements: DataFrame, phrases: DataFrame, group: str = "doc_id", at: str = "pos", text: str = "sentence", amounts: DataFrame | None = None) -> DataFrame:
    """The best scene of each document for each rule that has a hit in it.

    elements: (rule, element, weight, required, anywhere, least); phrases: (phrase_id, phrase, kind), a find's id
    being `rule/element`. An element stands in a scene if one of its phrases does, or, if `anywhere` is
    set, wherever the document has it; or if `amounts` (group, at, amount) has one of at least `least` in the scene.

    (group, rule, scene, ok, level, score, most, missing): ok if no required element is missing; level none, medium,
    or high from HIGH of the whole weight on. Scenes that are ok win, then those of the largest weight, then of most required
    elements, then the first. Only scenes with a hit are ever made: each hit asks for those around it. Hits are dealt
    out by document once and stay there; rules are broadcast, as their phrases are."""
    hits = phrase_hits(sentences, [group, at], text, phrases).select(group, at, F.split_part("phrase_id", F.lit("/"), F.lit(1)).alias("rule"), F.split_part("phrase_id", F.lit("/"), F.lit(2)).alias("element"))
    if amounts is not None:
        bound = elements.where("least is not null").select("rule", "element", "least", F.lit(None).cast(elements.schema["least"].dataType).alias("__no"))
        hits = hits.unionByName(ranges.at_point(amounts, bound, "amount", "least", "__no").select(group, at, "rule", "element"))
    own = dealt(hits, sentences, group).distinct().join(F.broadcast(elements.drop("least")), ["rule", "element"])
    one, w = F.struct("element", "weight", "required"), Window.partitionBy(group, "rule")
    far = {"__wide": F.collect_set(F.when(F.col("anywhere"), one)).over(w), "__first": F.min(F.when(F.col("anywhere"), F.col(at))).over(w)}
    scenes = F.when(F.col("anywhere"), F.array("__first")).otherwise(scene_starts(F.col(at)))
    every = own.withColumns(far).select(group, "rule", "__wide", F.explode(scenes).alias("scene"), F.when(~F.col("anywhere"), one).alias("__one"))
    got = every.groupBy(group, "rule", "scene").agg(F.concat(F.collect_set("__one"), F.first("__wide")).alias("__e"))
    score = F.aggregate("__e", F.lit(0).cast("long"), lambda a, x: a + x["weight"])
    got = got.select(group, "rule", "scene", score.alias("score"), F.size(F.filter("__e", lambda x: x["required"])).cast("long").alias("__req"), F.array_distinct(F.transform("__e", lambda x: x["element"])).alias("__has"))
    rules = elements.groupBy("rule").agg(F.sum("weight").alias("most"), F.count_if("required").alias("__all"), F.collect_set("element").alias("__els"))
    j = got.join(F.broadcast(rules), "rule").withColumn("ok", F.col("__req") == F.col("__all"))
    order = F.struct("ok", "score", "__req", (-F.col("scene")).alias("first"))
    best = j.groupBy(group, "rule").agg(F.max_by(F.struct("scene", "ok", "score", "most", "__has", "__els"), order).alias("b"))
    level = F.when(~F.col("b.ok"), "none").when(F.col("b.score") >= HIGH * F.col("b.most"), "high").otherwise("medium")
    missing = F.array_join(F.array_sort(F.array_except("b.__els", "b.__has")), ",")
    return best.select(group, "rule", "b.scene", "b.ok", level.alias("level"), "b.score", "b.most", missing.alias("missing"))


def best_scenes(sentences: DataFrame, phrases: DataFrame, group: str = "doc_id", at: str = "pos", text: str = "sentence") -> DataFrame:
    """phrases: (topic, phrase_id, phrase, kind, weight, solo). Per document and topic with a hit: the
    best scene, (group, topic, scene, strong, score, n_hits, quote_at), where a phrase counts once.

    strong: a phrase that stands alone (solo), two of weight HEAVY or more, or one such among three. Strong
    scenes win, then those of the largest weight, then the first; quote_at is its first sentence with a hit. The
    postings of hits are the only input: a document without hits costs its scan. Hits are dealt out by document once
    and stay there; phrases are broadcast, as every task that finds them holds them."""
    hits = dealt(phrase_hits(sentences, [group, at], text, phrases).select(group, at, "phrase_id"), sentences, group).distinct()
    topics = phrases.select(F.col("phrase_id").cast("string").alias("phrase_id"), "topic", "weight", "solo").where("topic is not null")
    own = hits.join(F.broadcast(topics), "phrase_id")
    near = own.withColumn("scene", F.explode(scene_starts(F.col(at)))).groupBy(group, "topic", "scene", "phrase_id").agg(F.min(at).alias("at"), F.max("weight").alias("weight"), F.bool_or("solo").alias("solo"))
    got = near.groupBy(group, "topic", "scene").agg(F.sum("weight").alias("score"), F.count(F.lit(1)).alias("n_hits"), F.count_if(F.col("weight") >= HEAVY).alias("heavy"), F.bool_or("solo").alias("solo"), F.min("at").alias("quote_at"))
    strong = F.col("solo") | (F.col("heavy") >= 2) | ((F.col("heavy") >= 1) & (F.col("n_hits") >= 3))
    order = F.struct("strong", "score", (-F.col("scene")).alias("first"))
    best = got.withColumn("strong", strong).groupBy(group, "topic").agg(F.max_by(F.struct("scene", "strong", "score", "n_hits", "quote_at"), order).alias("b"))
    return best.select(group, "topic", "b.*")
