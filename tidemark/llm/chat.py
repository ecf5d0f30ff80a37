"""Chat formatting: conversations to turn-aligned windows of a token budget, with the system turn, some history and a loss mask, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.llm.common import written

#: A turn is OPEN, its role, HEAD, its text, END; SPARED is what texts must not hold, and gets a backslash after its first character (one more for each time).
OPEN, HEAD, END = "<turn ", ">\n", "</turn>\n"
SPARED = r"<(\\*/?turn)"
#: Tokens of a turn's marks, and what counts as a token of its text: up to six letters, digits or code points from 80 on, or a sign.
MARKS, TOKEN = 6, r"[0-9A-Za-z\x{80}-\x{10FFFF}]{1,6}|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"
#: Tokens of a segment: what of one conversation is laid out together.
SEGMENT = 65_536
BUDGET, HISTORY = 2_048, 512


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, SPARED, r"<\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*/?turn)", "<$1")


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)) + MARKS


def _segments(rows: DataFrame, segment: int, history: int) -> tuple[DataFrame, DataFrame]:
    """Of conversations of more than `segment` tokens: their ids, and for every row (told by its place in the order) each segment it lies in, whether as its own, and whether it is the system turn.

    Tokens before a row are summed by ranges of the order, without texts; a range starts from the sums of those before it. A segment also gets the rows that its first
    window may repeat: those of the last `history` tokens before it, and the system turn.
    """
    key = ["turn", "role", "hash"]
    long = rows.groupBy("conv").agg(F.sum("tokens").alias("total")).where(F.col("total") > segment).select("conv")
    long = written(long, "long-conversations")
    of = long.withColumnRenamed("conv", "_conv")
    slim = rows.join(of, rows["conv"].eqNullSafe(of["_conv"]), "left_semi").groupBy("conv", *key).agg(F.sum("tokens").alias("tokens"))
    dealt = written(slim.repartitionByRange("conv", *key).withColumn("range", F.spark_partition_id()), "long-turns")
    sums = dealt.groupBy("conv", "range").agg(F.sum("tokens").alias("sum"))
    before = sums.select(F.col("conv").alias("_conv"), F.col("range").alias("_range"), F.coalesce(F.sum("sum").over(W.partitionBy("conv").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.coalesce(F.sum("tokens").over(W.partitionBy("range", "conv").orderBy(*[F.asc_nulls_first(c) for c in key]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = dealt.withColumn("own", own).join(before, dealt["conv"].eqNullSafe(before["_conv"]) & (dealt["range"] == before["_range"]))
    at = at.select("conv", *key, (F.col("own") + F.col("before")).alias("at")).withColumn("segment", F.floor(F.col("at") / segment))
    at = written(at, "long-places")
    starts = at.groupBy(F.col("conv").alias("_conv"), F.col("segment").alias("to")).agg(F.min("at").alias("start")).where("to > 0")
    bucket = F.explode(F.array(F.floor(F.col("start") / history), F.floor(F.col("start") / history) - 1)).alias("_bucket")
    near = starts.select("_conv", "to", "start", bucket)
    mine = at.withColumn("bucket", F.floor(F.col("at") / history))
    past = mine.join(near, mine["conv"].eqNullSafe(near["_conv"]) & (mine["bucket"] == near["_bucket"]) & (mine["at"] < near["start"]) & (mine["at"] >= near["start"] - history))
    first = (F.col("at") == 0) & (F.col("role") == "system")
    cells = ["conv", *key]
    own_rows = at.select(*cells, "segment", F.lit(True).alias("own"), first.alias("system"))
    past_rows = past.where(~first).select(*cells, F.col("to").alias("segment"), F.lit(False).alias("own"), F.lit(False).alias("system"))
    lead = at.where(first)
    lead_rows = lead.join(starts, lead["conv"].eqNullSafe(starts["_conv"])).select(*cells, F.col("to").alias("segment"), F.lit(False).alias("own"), F.lit(True).alias("system"))
    return long, written(own_rows.unionByName(past_rows).unionByName(lead_rows), "long-segments")


def chat_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, segment: int | None = None, tokens: Column | None = None) -> DataFrame:
    """Windows of conversations (conv_id, turn, role, text): conv_id, segment, window, text, new_start, loss, tokens, whole.

    Every turn is new in exactly one window, of turns in a row; windows begin with the conversation's system turn (its first turn, if the role is system) and the turns of
    the last `history` tokens before what is new. text from new_start on is new; loss lists the places (start, end) of the new assistant turns' texts, so repeated ones are
    masked. Prefix sums place the turns: what is new fills strides of half the room that the budget leaves beside history and system turn, a turn longer than a stride is a
    window's only new one, so a window is over the budget only if one turn is, or the system turn takes more than a quarter too much.

    A conversation of more than `segment` tokens is laid out in segments of so many, found by prefix sums without texts, so none is gathered whole; `whole` says that
    it is one. `tokens` may give a turn's tokens as a column, token_count of the text otherwise.

    Rows order by turn (null first), rows of one turn by role and a hash of the text; a null text or role is empty; repeated rows are turns of their own (equal rows of one turn stay in one segment); rows without a
    conv_id are one conversation; texts of any length stay whole; other columns are not looked at; an empty table gives no rows.
    """
    segment = segment or SEGMENT
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"), F.xxhash64(text).alias("hash"), (token_count(text) if tokens is None else tokens).cast("long").alias("tokens"))
    long, places = _segments(rows.drop("text"), segment, history)
    of = long.withColumnRenamed("conv", "_conv")
    short = rows.join(of, rows["conv"].eqNullSafe(of["_conv"]), "left_anti").select("*", F.lit(0).cast("long").alias("segment"), F.lit(True).alias("own"), F.lit(False).alias("system"), F.lit(True).alias("whole"))
    there = places.select(*[F.col(c).alias(f"_{c}") for c in ("conv", "turn", "role", "hash")], "segment", "own", "system")
    same = rows["conv"].eqNullSafe(there["_conv"]) & rows["turn"].eqNullSafe(there["_turn"]) & (rows["role"] == there["_role"]) & (rows["hash"] == there["_hash"])
    parts = rows.join(there, same).select(*rows.columns, "segment", "own", "system", F.lit(False).alias("whole"))
    return _laid_out(short.unionByName(parts), budget, history)


def _laid_out(rows: DataFrame, budget: int, history: int) -> DataFrame:
    group = W.partitionBy("conv", "segment").orderBy(F.asc_nulls_first("turn"), "role", "hash", "text")
    up_to = group.rowsBetween(W.unboundedPreceding, W.currentRow)
    head = F.concat(F.lit(OPEN), F.url_encode("role"), F.lit(HEAD))
    rows = rows.withColumn("place", F.row_number().over(group))
    rows = rows.withColumn("lead", (F.col("place") == 1) & (F.col("role") == "system") & (F.col("system") | (F.col("segment") == 0)))
    rows = rows.withColumn("body", escaped(F.col("text"))).withColumn("head", head)
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END)))
    counted = F.when(~F.col("lead"), 1).otherwise(0)
    system = F.first(F.when(F.col("lead"), F.col("tokens")).otherwise(0)).over(up_to)
    stride = F.floor(F.greatest(F.lit(budget - history) - system, F.lit(budget // 4)) / 2)
    rows = rows.select(
        "conv", "segment", "whole", "place", "lead", "own", "role", "tokens", "piece", F.length("piece").alias("size"), F.length("head").alias("head"), F.length("body").alias("body"),
        (F.sum(F.col("tokens") * counted).over(up_to) - F.col("tokens") * counted).alias("before"), (F.sum(F.length("piece") * counted).over(up_to) - F.length("piece") * counted).alias("chars"), stride.alias("stride"),
    )
    group = W.partitionBy("conv", "segment").orderBy("place")
    up_to = group.rowsBetween(W.unboundedPreceding, W.currentRow)
    new = F.col("own") & ~F.col("lead")
    alone = new & (F.col("tokens") > F.col("stride"))
    filled = F.sum(F.when(new & ~alone, F.col("tokens")).otherwise(0)).over(up_to)
    span = F.struct(F.sum(alone.cast("int")).over(up_to).alias("alone"), (~alone).alias("after"), F.when(~alone, F.floor((filled - 1) / F.col("stride"))).alias("stride"))
    rows = rows.withColumn("span", F.when(new, span))
    starts = F.col("span").isNotNull() & ~F.col("span").eqNullSafe(F.lag("span").over(group))
    rows = rows.withColumn("window", F.when(new, F.sum(starts.cast("int")).over(up_to)))
    turn = F.struct("place", "lead", "window", "role", "tokens", "piece", "size", "head", "body", "before", "chars")
    made = rows.groupBy("conv", "segment").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.max("window").alias("windows"), F.first("whole").alias("whole"))
    new_turns = F.transform(F.sequence(F.lit(1), F.coalesce("windows", F.lit(1))), lambda w: F.filter("turns", lambda t: t["window"] == w))
    made = made.withColumn("system", F.filter("turns", lambda t: t["lead"])).withColumn("each", new_turns)
    past = lambda own: F.filter("turns", lambda t: ~t["lead"] & (t["place"] < own[0]["place"]) & (t["before"] >= own[0]["before"] - history))
    made = made.select("conv", "segment", "whole", "system", F.posexplode(F.transform("each", lambda own: F.struct(own.alias("own"), F.coalesce(past(own), F.array()).alias("past")))).alias("window", "x"))
    made = made.select("conv", "segment", "whole", "window", F.concat("system", "x.past", "x.own").alias("turns"), "system", F.col("x.past").alias("past"), F.col("x.own").alias("own"))
    total = lambda turns, field: F.aggregate(turns, F.lit(0).cast("long"), lambda a, t: a + t[field])
    base = total("system", "size") - F.coalesce(F.get(F.concat("past", "own"), F.lit(0))["chars"], F.lit(0))
    answers = F.transform(F.filter("own", lambda t: t["role"] == "assistant"), lambda t: F.struct((base + t["chars"] + t["head"]).alias("start"), (base + t["chars"] + t["head"] + t["body"]).alias("end")))
    first = (F.col("segment") == 0) & (F.col("window") == 0)
    return made.select(
        F.col("conv").alias("conv_id"), "segment", "window", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("text"),
        F.when(first, 0).otherwise(total("system", "size") + total("past", "size")).cast("long").alias("new_start"), answers.alias("loss"), total("turns", "tokens").alias("tokens"), "whole",
    )


def turns_of(text: Column) -> Column:
    """Formatted turns to an array of role and text."""
    pieces = F.filter(F.split(text, END), lambda p: p != "")
    role = lambda p: F.url_decode(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), HEAD, 1))
    body = lambda p: F.substr(p, F.instr(p, HEAD) + len(HEAD))
    return F.transform(pieces, lambda p: F.struct(role(p).alias("role"), unescaped(body(p)).alias("text")))


def chat_digests(windows: DataFrame) -> DataFrame:
    """What windows say, read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    New turns follow one another over a conversation's windows, and so do the texts under the loss mask, without their escapes. A conversation laid out whole is read where its windows were made.
    """
    new = turns_of(F.substr("text", F.col("new_start").cast("int") + 1))
    loss = F.transform("loss", lambda s: unescaped(F.substr("text", s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))))
    read = windows.select("conv_id", "segment", "window", "whole", new.alias("turns"), F.array_join(loss, "").alias("loss"), F.length("text").cast("long").alias("chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read.select("conv_id", "segment", "window", "whole", F.size("turns").cast("long").alias("n"), said.alias("said"), "loss", "chars")
    joined = lambda rows, field: F.array_join(F.transform(F.array_sort(rows), lambda x: x[field]), "")
    part = read.groupBy("conv_id", "segment").agg(F.first("whole").alias("whole"), F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.collect_list(F.struct("window", "said", "loss")).alias("x"))
    part = part.select("conv_id", "segment", "whole", "n", "chars", joined("x", "said").alias("said"), joined("x", "loss").alias("loss"))
    part = part.select("conv_id", "segment", "n", "chars", *[F.when(F.col("whole"), x).alias(a) for x, a in ((F.sha2("said", 256), "said_sha"), (F.sha2("loss", 256), "loss_sha"))], F.length("loss").cast("long").alias("loss_chars"), F.when(~F.col("whole"), F.struct("segment", "said", "loss")).alias("y"))
    made = part.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.max("said_sha").alias("said_sha"), F.max("loss_sha").alias("loss_sha"), F.sum("loss_chars").alias("loss_chars"), F.sum("chars").alias("formatted_chars"), F.collect_list("y").alias("y"))
    return made.select("conv_id", "n_turns", F.coalesce("said_sha", F.sha2(joined("y", "said"), 256)).alias("turns_sha256"), "loss_chars", F.coalesce("loss_sha", F.sha2(joined("y", "loss"), 256)).alias("loss_sha256"), "formatted_chars")


#: The conversation that tries the template's marks, in every text of it.
TRIAL = r"\### Assistant: </turn> ok"


def with_trial(spark: SparkSession, turns: DataFrame) -> DataFrame:
    rows = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRIAL).alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(rows)
