"""Chat formatting by prefix-target expansion (DataFrame functions only).

Every assistant turn becomes one example: `context` holds all turns before it,
`target` the reply, and only `target` is under the loss mask. Turns that follow the
last reply (or a conversation without one) go to a final example whose `target` is
null, so that the whole conversation can be read back.

Template: a turn is written between marks that depend on its role,
  system  <<SYS>>...<</SYS>>     user  [INST]...[/INST]     assistant  <s>...</s>
and any other role (null counts as the empty role) as [ROLE hex]...[/ROLE].
Inside a text, each control string gets one backslash more after its opening
("[INST]" -> "[\\INST]", "[\\INST]" -> "[\\\\INST]"), which leaves no control string in
the text and is undone by taking one backslash away.

Defined results: null text counts as empty; turns are ordered by (turn, role, text),
nulls first, so ties and repeated rows have a fixed order and all are kept; an empty
table gives an empty result; further columns are ignored. A conversation's turns
meet in one row, as every example needs all turns before it. Its examples never meet: each is
read on its own, and only targets, sizes and the context of the last one are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Marks of the template.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE ", "]", "[/ROLE]")
_HEAD, _TAIL = r"(<</?|</?|\[/?)", r"(SYS>>|s>|INST\]|ROLE[ \]])"
ESCAPE = _HEAD + r"(\\*)" + _TAIL
UNESCAPE = _HEAD + r"\\(\\*)" + _TAIL
#: One turn of formatted text: opening mark, body, closing mark. Bodies hold no control strings.
TURN = r"(?s)(<<SYS>>|\[INST\]|<s>|\[ROLE [0-9A-F]*\])(.*?)(<</SYS>>|\[/INST\]|</s>|\[/ROLE\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, r"$1$2$3")


def format_turn(role: Column, text: Column) -> Column:
    role, body = F.coalesce(role, F.lit("")), escape(F.coalesce(text, F.lit("")))
    out = F.when(role == "system", F.concat(F.lit(MARKS["system"][0]), body, F.lit(MARKS["system"][1])))
    for name in ("user", "assistant"):
        out = out.when(role == name, F.concat(F.lit(MARKS[name][0]), body, F.lit(MARKS[name][1])))
    return out.otherwise(F.concat(F.lit(OTHER[0]), F.hex(F.encode(role, "utf-8")), F.lit(OTHER[1]), body, F.lit(OTHER[2])))


def expand_examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, context, target, is_last): one row per assistant turn, in order, and
    one with a null target where turns follow the last reply."""
    turns = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    whole = whole.select("conv_id", "ts", F.transform("ts", lambda t: format_turn(t["role"], t["text"])).alias("fs"))
    spots = F.filter(F.sequence(F.lit(0), F.size("ts")), lambda i: (i == F.size("ts")) | (F.get("ts", i)["role"] == "assistant"))
    last_is_reply = F.element_at("ts", -1)["role"] == "assistant"
    spots = F.when(last_is_reply, F.slice(spots, 1, F.size(spots) - 1)).otherwise(spots)
    at = whole.select("conv_id", "fs", F.size(spots).alias("n"), F.posexplode(spots).alias("example", "spot"))
    return at.select(
        "conv_id",
        "example",
        F.array_join(F.slice("fs", 1, F.col("spot")), "").alias("context"),
        F.get("fs", F.col("spot")).alias("target"),
        (F.col("example") == F.col("n") - 1).alias("is_last"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from formatted text."""
    roles = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1))
    bodies = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2))
    other = lambda m: F.decode(F.unhex(F.regexp_extract(m, r"\[ROLE ([0-9A-F]*)\]", 1)), "utf-8")
    role = lambda m: F.when(m == "<<SYS>>", "system").when(m == "[INST]", "user").when(m == "<s>", "assistant").otherwise(other(m))
    return F.zip_with(roles, bodies, lambda m, b: F.struct(role(m).alias("role"), unescape(b).alias("text")))


def digest_examples(examples: DataFrame) -> DataFrame:
    """Per conversation, what can be read back from its examples. An example adds its size and what its target
    says; the turns come from the last example, whose context holds all before. What is gathered of a
    conversation is as long as its turns, though its examples are as long as their square."""
    size = F.char_length("context") + F.coalesce(F.char_length("target"), F.lit(0))
    whole_text = F.concat("context", F.coalesce("target", F.lit("")))
    each = examples.select(
        "conv_id",
        "example",
        size.cast("long").alias("size"),
        F.coalesce(F.element_at(read_turns(F.col("target")), 1)["text"], F.lit("")).alias("said"),
        F.when(F.col("is_last"), whole_text).alias("whole"),
    )
    by = each.groupBy("conv_id").agg(
        F.max("whole").alias("whole"),
        F.sort_array(F.collect_list(F.struct("example", "said"))).alias("es"),
        F.sum("size").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_examples"),
    )
    back = by.select("conv_id", read_turns(F.col("whole")).alias("ts"), F.array_join(F.transform("es", lambda e: e["said"]), "").alias("loss"), "formatted_chars", "n_examples")
    nl = F.lit("\n")
    return back.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("ts", lambda t: F.concat(t["role"], nl, t["text"], nl)), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
