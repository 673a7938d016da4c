"""Ordered conversations from message rows.

Parent pointers are resolved by pointer jumping: each round joins every open row with the row its pointer names and doubles
the distance covered, so a chain of n messages needs log2(n) rounds. Before the rounds, counts alone remove every
conversation that cannot be one chain (several roots, an unknown parent, two children of one message). In what is left each
node is pointed at at most once a round, so no join key is hot however long a conversation is. A row that never reaches a
root lies on a cycle and removes its conversation.

Conversations without any parent are ranked by time with a range-partitioned sort and per-partition offsets; adjacency is
read through blocks of positions. No step gathers a conversation in one task.

Defined results: repeat rows of a message id count once (the latest ingested_at); a message without conv_id or message_id is
left out; equal times fall back on turn, then message_id; null times come first; an empty table gives no rows; further
columns are ignored. Blank means only white space or invisible characters, or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloqua.session import checkpoint

#: White space, controls and invisible format characters.
VISIBLE = r"[^\s\p{Z}\p{C}ᅟᅠ⠀ㅤﾠ︀-️]"
#: Rows of one block of positions; bounds what a window holds.
BLOCK = 1024


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text.rlike("(?U)" + VISIBLE), F.lit(False))


def clean_role(role: Column) -> Column:
    low = F.lower(F.trim(role))
    return F.when(low == "human", "user").when(low == "bot", "assistant").when(low != "", low)


def seconds(t: Column) -> Column:
    """Epoch seconds, also from milli- and microseconds."""
    return F.when(t > 1e14, t / 1e6).when(t > 1e11, t / 1e3).otherwise(t)


def messages(rows: DataFrame) -> DataFrame:
    """One row per message: keys, clean role, time, blankness. The text itself is not carried on."""
    keep = ["message_id", "conv_id", "turn", "role", "parent", "create_time", "blank"]
    light = (
        rows.filter("message_id is not null and conv_id is not null")
        .select("message_id", "conv_id", "turn", clean_role(F.col("role")).alias("role"), F.col("parent").alias("parent"), seconds(F.col("create_time")).alias("create_time"), is_blank(F.col("text")).alias("blank"), "ingested_at")
    )
    payload = F.struct("ingested_at", *[c for c in keep if c not in ("message_id", "conv_id")])
    latest = light.groupBy("conv_id", "message_id").agg(F.max(payload).alias("m"))
    return latest.select("conv_id", "message_id", *[f"m.{c}" for c in keep if c not in ("message_id", "conv_id")])


def sound(msgs: DataFrame) -> DataFrame:
    """conv_id, linked: conversations that have a role everywhere, a non-blank user message and, if linked, could be one chain."""
    convs = msgs.groupBy("conv_id").agg(
        F.count("*").alias("n"),
        F.count("parent").alias("links"),
        F.count("role").alias("roles"),
        F.max((F.col("role") == "user") & ~F.col("blank")).alias("asked"),
    )
    children = msgs.filter("parent is not null").groupBy("conv_id", F.col("parent").alias("message_id")).agg(F.count("*").alias("kids"))
    known = children.join(msgs.select("conv_id", "message_id", F.lit(1).alias("there")), ["conv_id", "message_id"], "left")
    bad = known.filter("there is null or kids > 1").select("conv_id").distinct()
    linked = F.col("links") > 0
    good = convs.filter((F.col("roles") == F.col("n")) & F.coalesce("asked", F.lit(False)) & (~linked | (F.col("links") == F.col("n") - 1)))
    return good.select("conv_id", linked.alias("linked")).join(bad, "conv_id", "left_anti")


def chain_positions(links: DataFrame, rounds: int = 40) -> DataFrame:
    """conv_id, message_id, position of the rows that reach a root along ``parent``; ``links`` has at most one child per node."""
    done = links.filter("parent is null").select("conv_id", "message_id", F.lit(0).cast("bigint").alias("position"))
    todo = links.filter("parent is not null").select("conv_id", "message_id", F.col("parent").alias("ptr"), F.lit(1).cast("bigint").alias("dist"))
    state = checkpoint(done.select("conv_id", "message_id", F.lit(None).cast("string").alias("ptr"), F.col("position").alias("dist")).unionByName(todo))
    left = state.filter("ptr is not null").count()
    for _ in range(rounds):
        if not left:
            break
        open_, target = state.filter("ptr is not null"), state.select("conv_id", F.col("message_id").alias("ptr"), F.col("ptr").alias("next"), F.col("dist").alias("far"))
        hopped = open_.join(target, ["conv_id", "ptr"], "left").select("conv_id", "message_id", F.col("next").alias("ptr"), (F.col("dist") + F.col("far")).alias("dist"))
        state = checkpoint(state.filter("ptr is null").unionByName(hopped))
        still = state.filter("ptr is not null").count()
        if still == left:
            break  # only cycles are left: a chain always shrinks
        left = still
    return state.filter("ptr is null").select("conv_id", "message_id", F.col("dist").alias("position"))


def time_positions(rows: DataFrame) -> DataFrame:
    """conv_id, message_id, position by time: a range sort, ranks inside each range and offsets of the ranges before."""
    order = ["create_time", "turn", "message_id"]
    ranged = rows.select("conv_id", *order).repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id())
    ranged = checkpoint(ranged)
    inside = Window.partitionBy("part", "conv_id").orderBy(*order)
    ranks = ranged.withColumn("rank", F.row_number().over(inside) - 1)
    sizes = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranks.join(sizes.select("conv_id", "part", before.alias("offset")), ["conv_id", "part"]).select("conv_id", "message_id", (F.col("rank") + F.col("offset")).cast("bigint").alias("position"))


def unanswered(ordered: DataFrame) -> DataFrame:
    """conv_id of conversations where a non-blank user message comes last or is followed by a blank assistant message.

    Among user and assistant messages. Neighbours inside a block of positions come from a window over the block; the first
    message of the next non-empty block comes from a window over one row per block.
    """
    talk = ordered.filter(F.col("role").isin("user", "assistant")).select("conv_id", "position", F.floor(F.col("position") / BLOCK).alias("block"), F.struct("role", "blank").alias("m"))
    w = Window.partitionBy("conv_id", "block").orderBy("position")
    inner = talk.withColumn("next", F.lead("m").over(w))
    firsts = talk.groupBy("conv_id", "block").agg(F.min_by("m", "position").alias("first"))
    firsts = firsts.withColumn("after", F.lead("first").over(Window.partitionBy("conv_id").orderBy("block"))).select("conv_id", "block", "after")
    edge = F.col("next").isNull()
    inside_bad = (F.col("m.role") == "user") & ~F.col("m.blank") & (F.col("next.role") == "assistant") & F.col("next.blank")
    over_bad = (F.col("m.role") == "user") & ~F.col("m.blank") & (F.col("after").isNull() | ((F.col("after.role") == "assistant") & F.col("after.blank")))
    within = inner.filter(~edge & inside_bad).select("conv_id")
    across = inner.filter(edge).join(firsts, ["conv_id", "block"]).filter(over_bad).select("conv_id")
    return within.unionByName(across).distinct()


def rebuild(rows: DataFrame) -> DataFrame:
    """Every kept conversation's messages: conv_id, position (int), message_id, role."""
    msgs = checkpoint(messages(rows))
    usable = msgs.join(sound(msgs), "conv_id")
    usable = checkpoint(usable)
    linked = usable.filter("linked")
    chains = chain_positions(linked.select("conv_id", "message_id", "parent"))
    reached = chains.groupBy("conv_id").agg(F.count("*").alias("reached"))
    sizes = linked.groupBy("conv_id").agg(F.count("*").alias("n"))
    whole = sizes.join(reached, "conv_id", "left").filter("n = reached").select("conv_id")
    placed = chains.join(whole, "conv_id", "left_semi").unionByName(time_positions(usable.filter("not linked")))
    ordered = checkpoint(placed.join(usable.select("conv_id", "message_id", "role", "blank"), ["conv_id", "message_id"]))
    return ordered.join(unanswered(ordered), "conv_id", "left_anti").select("conv_id", F.col("position").cast("int").alias("position"), "message_id", "role")
