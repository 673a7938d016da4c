"""Messages in order and the turn pairs between neighbours of different role.

One exchange on the conversation and its window serve every measure: ``lag`` finds the neighbour and ``row_number`` by role
numbers both directions under the same partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloqua.functions.text import cross_check, not_blank


def role_name(role: Column) -> Column:
    low = F.lower(F.trim(role))
    return F.when(low == "human", "user").when(low == "bot", "assistant").otherwise(low)


def latest_fetch(raw: DataFrame, *columns: str) -> DataFrame:
    """One row per share: the latest successful fetch that has messages.

    Which fetch that is is found on two narrow columns, so only shares fetched again have their texts compared.
    """
    good = raw.filter("fetch_success and messages is not null and share_id is not null")
    fetches = good.groupBy("share_id").agg(F.max("fetched_at").alias("fetched_at"), F.count("*").alias("_n"))
    rows = good.select("share_id", "fetched_at", *[c for c in columns if c not in ("share_id", "fetched_at")])
    same = [rows["share_id"] == fetches["share_id"], rows["fetched_at"].eqNullSafe(fetches["fetched_at"])]
    kept = rows.join(fetches, same[0] & same[1]).select(*[rows[c] for c in rows.columns], "_n")
    once, again = kept.filter("_n = 1").drop("_n"), kept.filter("_n > 1").drop("_n")
    first = again.groupBy("share_id").agg(F.first(F.struct(*columns)).alias("r")).select("share_id", "r.*")  # exact repeats of one fetch
    return once.select("share_id", *columns).unionByName(first)


def explode_messages(shares: DataFrame) -> DataFrame:
    """conv_id, pos, message_id, role, text, model_slug of every message, in list order; ``model``: with the conversation's default, if given."""
    default = F.col("default_model") if "default_model" in shares.columns else F.lit(None).cast("string")
    flat = shares.select(F.col("share_id").alias("conv_id"), F.posexplode("messages").alias("pos", "m"), default.alias("default_model"))
    role = role_name(F.col("m.role"))
    return flat.select("conv_id", F.col("pos").cast("bigint").alias("pos"), F.concat_ws("_", "conv_id", "pos", role).alias("message_id"), role.alias("role"), F.col("m.text").alias("text"), F.col("m.model_slug").alias("model_slug"), F.coalesce(F.nullif("m.model_slug", F.lit("")), "default_model").alias("model"))


def spoken(messages: DataFrame) -> DataFrame:
    """User and assistant messages with text."""
    return messages.filter(F.col("role").isin("user", "assistant") & not_blank(F.col("text")))


def with_fallback(text: Column, parts: Column) -> Column:
    """The text or, where it is blank, the parts that are not, joined by a space; null if nothing is left."""
    joined = F.array_join(F.filter(parts, not_blank), " ")
    return F.when(not_blank(text), text).when(not_blank(joined), joined)


def message_rows(shares: DataFrame) -> DataFrame:
    """User and assistant messages with text, each with its conversation's metadata and the model that answered.

    ``shares``: share_id, messages, conversation_metadata, conversation_language, reddit_sources, api_response. A message without text
    takes the text of the payload's parts; one without backend_index is left out.
    """
    from colloqua.operators.nested import _array, _payload

    every = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform("reddit_sources", lambda s: s["subreddit"]), lambda x: x != ""))), "|")
    nodes = F.try_variant_get(_payload(F.col("api_response")), "$.mapping", "map<string,variant>")
    meta = F.col("conversation_metadata")
    flat = shares.select(
        F.col("share_id").alias("conv_id"), F.posexplode("messages").alias("pos", "m"), meta["title"].alias("title"), meta["create_time"].alias("conversation_create_time"),
        F.col("conversation_language"), meta["default_model_slug"].alias("default_model_slug"), F.nullif(every, F.lit("")).alias("subreddits"),
        F.when(F.exists("messages", lambda m: ~not_blank(m["text"])), nodes).alias("nodes"),
    )
    parts = F.transform(_array(F.try_element_at("nodes", F.col("m.node_id")), "$.message.content.parts"), lambda p: F.try_variant_get(p, "$", "string"))
    role = role_name(F.col("m.role"))
    out = flat.select(
        "conv_id", "pos", F.col("m.backend_index").alias("backend_index"), role.alias("role"), with_fallback(F.col("m.text"), parts).alias("text"), "title", "conversation_create_time", "conversation_language", "subreddits",
        F.coalesce(F.nullif("m.model_slug", F.lit("")), "default_model_slug").alias("model_slug"),
    )
    return out.filter("role in ('user', 'assistant') and text is not null and backend_index is not null")


def turn_pairs(messages: DataFrame) -> DataFrame:
    """conv_id, turn (signed), direction, ids, cross-checks and texts of both sides of every pair of neighbours."""
    if "model" not in messages.columns:
        messages = messages.withColumn("model", F.col("model_slug"))
    order = Window.partitionBy("conv_id").orderBy("pos")
    back = lambda c: F.lag(c).over(order).alias(f"prev_{c}")
    near = spoken(messages).select("*", back("role"), back("text"), back("message_id"), back("model_slug"), back("model"))
    pairs = near.filter("prev_role is not null and prev_role <> role")
    number = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("pos"))
    forward = F.col("role") == "assistant"
    side = lambda c, user: F.when(forward == F.lit(user), F.col(f"prev_{c}")).otherwise(F.col(c))
    return pairs.select(
        "conv_id",
        F.when(forward, number).otherwise(-number).cast("bigint").alias("turn"),
        F.when(forward, "user→assistant").otherwise("assistant→user").alias("direction"),
        side("message_id", True).alias("user_message_id"),
        side("message_id", False).alias("assistant_message_id"),
        cross_check(side("text", True)).alias("user_cross_check_5"),
        cross_check(side("text", False)).alias("assistant_cross_check_5"),
        side("text", True).alias("user_text"),
        side("text", False).alias("assistant_text"),
        side("model_slug", False).alias("model_slug"),
        side("model", False).alias("model"),
    )
