"""Chat formatting by perspective rotation: every participant is the assistant once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers whose offsets are summed in one window; the sums of these spans are summed in a second one.
SPAN = 64
#: A conversation's turns are joined with its participants in so many parts.
SALTS = 16
#: A rendered dialogue of more characters comes in parts of about so many.
MOST_CHARS = 1 << 20
#: Speakers that frame the talk and take no part in it.
FRAMES = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: What the characters that would end a name are written as.
NAME_ESCAPES = [("%", "%25"), (" ", "%20"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D")]


def escaped(text: Column) -> Column:
    """The text with a backslash in every "<|", so that it holds no mark; a backslash after "<" is doubled, so that this can be undone."""
    return F.replace(F.replace(text, F.lit("<\\"), F.lit("<\\\\")), F.lit("<|"), F.lit("<\\|"))


def escaped_name(name: Column) -> Column:
    for plain, written in NAME_ESCAPES:
        name = F.replace(name, F.lit(plain), F.lit(written))
    return escaped(name)


def turns_of(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """One row for each turn of each perspective: what rotate() puts together.

    Returns the conversation, perspective (the speaker shown as assistant), turn, role,
    name (of the other speakers), segment (rendered text), is_target, n_chars, start
    (characters of the rendered dialogue before the segment) and target_start,
    target_stop (the characters that bear loss, as places in the dialogue; null if
    none: header and opening are masked, the text and its end mark are not).

    Null text is empty; a null speaker is the participant 'unknown'; null turns stand
    first, ties go by the MD5 of speaker and text, equal rows are rendered each.  A conversation
    in which only system speaks has no perspective.  A null conversation is one
    conversation.  Other columns are ignored.  Marks in texts and names are escaped.

    No task needs a whole dialogue: equal turns are counted before they move and stay
    one row until their offsets are known, turns are salted for the join, and offsets
    are summed by spans of turn numbers, by turn and part of the ties, and then by row.
    """
    rows = turns.select(
        F.col(conversation).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(speaker).cast("string"), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.groupBy("conv", "turn", "speaker", "text").agg(F.count("*").alias("copies")).withColumn("tie", F.md5(F.concat("speaker", F.lit("\n"), "text")))
    people = rows.where(~F.col("speaker").isin(*FRAMES)).select("conv", F.col("speaker").alias("perspective")).distinct()
    salted = people.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    given = rows.withColumn("salt", F.pmod(F.xxhash64("turn", "tie"), F.lit(SALTS)).cast("int")).withColumnRenamed("conv", "conv_of").withColumnRenamed("salt", "salt_of")
    seen = given.join(salted, F.col("conv_of").eqNullSafe(F.col("conv")) & (F.col("salt_of") == F.col("salt"))).drop("conv_of", "salt_of", "salt")

    target, frame = F.col("speaker") == F.col("perspective"), F.col("speaker").isin(*FRAMES)
    role = F.when(target, "assistant").when(frame, F.col("speaker")).otherwise("user")
    name = F.when(~target & ~frame, escaped_name(F.col("speaker")))
    head = F.concat(F.lit(OPEN), role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("\n"))
    shown = seen.select("conv", "perspective", "turn", "speaker", "text", "tie", "copies", role.alias("role"), name.alias("name"), target.alias("is_target"), F.length(head).cast("long").alias("n_head"), F.concat(head, escaped(F.col("text")), F.lit(CLOSE)).alias("segment"))
    shown = shown.withColumn("n_chars", F.length("segment").cast("long")).withColumn("span", F.coalesce(F.floor(F.col("turn") / SPAN), F.lit(-(1 << 62)))).withColumn("bin", F.substring("tie", 1, 2))

    own = ["conv", "perspective"]
    bins = shown.groupBy(*own, "span", "turn", "bin").agg(F.sum(F.col("n_chars") * F.col("copies")).alias("in_bin"))
    spans = bins.groupBy(*own, "span").agg(F.sum("in_bin").alias("in_span"))
    spans = spans.select(*own, "span", (F.sum("in_span").over(Window.partitionBy(*own).orderBy("span")) - F.col("in_span")).alias("before_span"))
    in_span = Window.partitionBy(*own, "span").orderBy(F.asc_nulls_first("turn"), "bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("before_bin", F.sum("in_bin").over(in_span) - F.col("in_bin"))
    same = lambda a, b, keys: F.expr(" AND ".join(f"{a}.{k} <=> {b}.{k}" for k in keys))
    before = bins.alias("i").join(spans.alias("p"), same("i", "p", [*own, "span"])).select("i.conv", "i.perspective", "i.turn", "i.bin", (F.col("before_span") + F.col("before_bin")).alias("before"))
    in_bin = Window.partitionBy(*own, "turn", "bin").orderBy("tie", "speaker", "text").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.col("n_chars") * F.col("copies")
    placed = shown.withColumn("upto", F.sum(whole).over(in_bin) - whole).alias("s").join(before.alias("b"), same("s", "b", [*own, "turn", "bin"]))
    each = placed.select("s.*", (F.col("before") + F.col("upto")).alias("first")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    each = each.withColumn("start", F.col("first") + F.col("copy") * F.col("n_chars"))
    return each.select(
        F.col("conv").alias(conversation), "perspective", F.col("turn").alias(turn), "role", "name", "segment", "is_target", "n_chars", "start",
        F.when(F.col("is_target"), F.col("start") + F.col("n_head")).alias("target_start"), F.when(F.col("is_target"), F.col("start") + F.col("n_chars")).alias("target_stop"),
    )


def rotate(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", most: int = MOST_CHARS) -> DataFrame:
    """One rendered dialogue for each conversation and perspective, with its mask.

    Returns the conversation, perspective, part, start (characters of the dialogue
    before the part), n_turns, n_chars, dialogue and targets: the (start, stop) places
    in the part's text that bear loss, in order.  A dialogue is one row, part 0, unless
    it has over `most` characters: then a part ends with the turn that begins before a
    multiple of `most`, so no row outgrows a task.  For the rest see turns_of().
    """
    rows = turns_of(turns, conversation, turn, speaker, text)
    piece = F.struct("start", "segment", "target_start", "target_stop")
    parts = rows.groupBy(conversation, "perspective", F.floor(F.col("start") / most).alias("__part")).agg(F.array_sort(F.collect_list(piece)).alias("__turns"))
    begin = F.get("__turns", F.lit(0))["start"]
    targets = F.transform(F.filter("__turns", lambda x: x["target_start"].isNotNull()), lambda x: F.struct((x["target_start"] - begin).alias("start"), (x["target_stop"] - begin).alias("stop")))
    dialogue = F.array_join(F.transform("__turns", lambda x: x["segment"]), "")
    out = parts.select(conversation, "perspective", F.col("__part").cast("long").alias("part"), begin.alias("start"), F.size("__turns").cast("long").alias("n_turns"), dialogue.alias("dialogue"), targets.alias("targets"))
    return out.withColumn("n_chars", F.length("dialogue").cast("long"))
