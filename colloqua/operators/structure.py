"""Structure of whole conversations: features, summaries, extraction from payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloqua.functions.text import not_blank

PLACEHOLDERS = {"num_code_blocks": "[CODE_BLOCK_EXECUTABLE]", "num_formal_blocks": "[FORMAL_SPEC_BLOCK]", "num_data_blocks": "[DATA_DUMP_BLOCK]"}


def features(messages: DataFrame) -> DataFrame:
    """Thirteen features per conversation; blank messages count as turns."""
    n = F.coalesce(F.length("text"), F.lit(0))
    of = lambda role: F.col("role") == role
    count = lambda c: F.count_if(c).alias
    blocks = {k: F.sum(F.coalesce(F.regexp_count("text", F.lit(p.replace("[", r"\[").replace("]", r"\]"))), F.lit(0))) for k, p in PLACEHOLDERS.items()}
    out = messages.groupBy("conv_id").agg(
        F.count("*").alias("total_turns"),
        count(of("user"))("user_turns"),
        count(of("assistant"))("assistant_turns"),
        count(of("system"))("system_turns"),
        F.coalesce(F.avg(F.when(of("user"), n)), F.lit(0.0)).alias("avg_user_message_length"),
        F.coalesce(F.avg(F.when(of("assistant"), n)), F.lit(0.0)).alias("avg_assistant_message_length"),
        F.sum(n).alias("total_conversation_length"),
        F.coalesce(F.sum(F.when(of("user"), n)), F.lit(0)).alias("user_text_length"),
        F.coalesce(F.sum(F.when(of("assistant"), n)), F.lit(0)).alias("assistant_text_length"),
        *[c.alias(k) for k, c in blocks.items()],
    )
    return out.withColumn("has_any_block", F.col("num_code_blocks") + F.col("num_formal_blocks") + F.col("num_data_blocks") > 0)


def summary(flat: DataFrame) -> DataFrame:
    """Totals by role, system prompt, first and last time and duration; ``flat``: conv_id, role, create_time."""
    of = lambda role: F.count_if(F.col("role") == role)
    t = F.when(F.col("create_time") != 0, F.col("create_time"))
    return flat.groupBy("conv_id").agg(
        F.count("*").alias("message_count"), of("user").alias("user_messages"), of("assistant").alias("assistant_messages"), of("system").alias("system_messages"),
        (of("system") > 0).alias("has_system_prompt"), F.min(t).alias("first_message_time"), F.max(t).alias("last_message_time"), (F.max(t) - F.min(t)).alias("duration_seconds"),
    )


#: Accessors of a message's metadata: column, path, type; empty values count as absent (fixed values).
ACCESSORS = (("model_slug", "model_slug", "string"), ("gizmo_id", "gizmo_id", "string"), ("turn_exchange_id", "turn_exchange_id", "string"), ("shared_conversation_id", "shared_conversation_id", "string"), ("message_type", "message_type", "string"), ("parent_id", "parent_id", "string"), ("reasoning_status", "reasoning_status", "string"), ("reasoning_duration_sec", "finished_duration_sec", "double"), ("request_id", "request_id", "string"))
#: Lists of a message's metadata that are counted and kept as JSON.
LISTS = ("citations", "content_references", "attachments")


def payload_nodes(raw: DataFrame, keep_raw: bool = False) -> DataFrame:
    """share_id, fetched_at, ord, node_id, n (variant) of every node of the payloads; ``keep_raw``: with the payload's text."""
    from colloqua.operators.nested import _payload

    nodes = F.map_entries(F.try_variant_get(_payload(F.col("api_response")), "$.mapping", "map<string,variant>"))
    flat = raw.select("share_id", "fetched_at", *(["api_response"] if keep_raw else []), F.posexplode(nodes).alias("ord", "e"))
    return flat.select("share_id", "fetched_at", "ord", F.col("e.key").alias("node_id"), F.col("e.value").alias("n"), *(["api_response"] if keep_raw else []))


def _of(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("n", f"$.{path}", kind)


def _listed(path: str) -> Column:
    """The list at ``path`` as variants, a lone object as a list of one, null if it is absent or empty."""
    lone = _of(path, "variant")
    xs = F.coalesce(_of(path, "array<variant>"), F.when(F.schema_of_variant(lone).startswith("OBJECT"), F.array(lone)))
    return F.when(F.size(xs) > 0, xs)


def extracted(raw: DataFrame, keep_raw: bool = False) -> DataFrame:
    """Every message of the payloads' mappings by time, missing times first: share_id, backend_index, its own fields, interaction flags,
    accessors that are null where empty, code, reasoning, execution results and latency; ``keep_raw``: content and metadata as JSON."""
    from pyspark.sql import Window

    from colloqua.operators.nested import _array, _known

    get = lambda path, kind="string": _of(f"message.{path}", kind)
    parts = F.transform(_known(_array(F.col("n"), "$.message.content.parts")), lambda p: F.coalesce(F.try_variant_get(p["x"], "$", "string"), F.to_json(p["x"])))
    flag = lambda name: F.coalesce(get(f"metadata.{name}", "boolean"), F.lit(False))
    code = F.when(get("content.content_type") == "code", F.nullif(get("content.text"), F.lit("")))
    result = get("metadata.aggregate_result", "variant")
    has = F.schema_of_variant(result).startswith("OBJECT")
    accessors = [F.nullif(get(f"metadata.{path}", kind), F.lit("") if kind == "string" else F.lit(0.0)).alias(name) for name, path, kind in ACCESSORS]
    lists = [F.size(_listed(f"message.metadata.{name}")).alias(f"n_{name}") for name in LISTS]
    kept = [F.to_json(get(c, "variant")).alias(f"raw_{c}") for c in ("content", "metadata")] if keep_raw else []
    rows = payload_nodes(raw).filter(F.schema_of_variant(get("author", "variant")).isNotNull() | get("id").isNotNull()).select(
        "share_id", "fetched_at", "ord", "node_id", _of("parent").alias("parent"), F.size(_listed("children")).alias("n_children"),
        get("id").alias("id"), get("author.role").alias("role"), get("author.name").alias("author_name"), get("create_time", "double").alias("create_time"), get("update_time", "double").alias("update_time"),
        get("content.content_type").alias("content_type"), F.array_join(parts, "\n\n").alias("text"), code.alias("code"), F.nullif(get("content.language"), F.lit("")).alias("language"),
        F.size(_listed("message.content.thoughts")).alias("n_thoughts"), get("status").alias("status"), get("weight", "double").alias("weight"),
        flag("is_visually_hidden_from_conversation").alias("is_visually_hidden"), flag("is_redacted").alias("is_redacted"), get("end_turn", "boolean").alias("end_turn"), get("recipient").alias("recipient"), get("channel").alias("channel"),
        *accessors, *lists, F.when(has, get("metadata.aggregate_result.status")).alias("execution_status"), F.when(has, get("metadata.aggregate_result.final_expression_output")).alias("execution_output"),
        get("metadata.sonic_classification_result.latency_ms", "double").alias("latency_ms"), *kept,
    )
    order = Window.partitionBy("share_id", "fetched_at").orderBy(F.coalesce("create_time", F.lit(0.0)), "ord")
    return rows.distinct().withColumn("backend_index", (F.row_number().over(order) - 1).cast("bigint")).drop("ord")


def metadata_features(raw: DataFrame) -> DataFrame:
    """Per share: size of the mapping, custom instructions, tools, files, reasoning, code, citations, custom assistants, branches and
    visibility, from the payload's nodes by one aggregate."""
    get = lambda path, kind="string": _of(f"message.{path}", kind)
    kind = get("content.content_type")
    attachments = _listed("message.metadata.attachments")
    mime = F.filter(F.transform(attachments, lambda a: F.try_variant_get(a, "$.mime_type", "string")), lambda m: m != "")
    flag = lambda name: F.coalesce(get(f"metadata.{name}", "boolean"), F.lit(False))
    nodes = payload_nodes(raw).select(
        "share_id", "node_id", kind.alias("kind"), F.when(get("author.role") == "tool", F.nullif(get("author.name"), F.lit(""))).alias("tool"), F.coalesce(F.size(attachments), F.lit(0)).alias("files"), mime.alias("mime"),
        F.when(kind == "thoughts", get("metadata.finished_duration_sec", "double")).alias("seconds"), F.coalesce(F.size(_listed("message.metadata.citations")), F.lit(0)).alias("citations"),
        F.nullif(get("metadata.gizmo_id"), F.lit("")).alias("gizmo"), (F.size(_listed("children")) > 1).alias("branch"), get("id").isNotNull().alias("message"),
        flag("is_visually_hidden_from_conversation").alias("hidden"), flag("is_redacted").alias("redacted"),
    )
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return nodes.distinct().groupBy("share_id").agg(
        F.countDistinct("node_id").alias("mapping_size"), (n(F.col("kind") == "model_editable_context") > 0).alias("has_custom_instructions"), names("tool").alias("tools_used"), F.count("tool").alias("tool_call_count"),
        F.sum("files").alias("file_count"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("mime")))), "|").alias("file_types"), n(F.col("kind") == "thoughts").alias("reasoning_message_count"),
        F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("total_thinking_seconds"), n(F.col("kind") == "code").alias("code_block_count"), n(F.col("kind") == "execution_output").alias("code_execution_count"),
        F.sum("citations").alias("citation_count"), (F.count("gizmo") > 0).alias("custom_gpt_used"), names("gizmo").alias("gizmo_ids"), n(F.col("branch")).alias("branch_count"),
        n(F.col("message")).alias("total_messages"), n(F.col("message") & F.col("hidden")).alias("hidden_messages"), n(F.col("message") & F.col("redacted")).alias("redacted_messages"),
    )


def spoken(messages: DataFrame) -> DataFrame:
    """conv_id, pos, role, text (trimmed) of user and assistant messages that are neither blank nor look like data."""
    body = F.trim("text")
    ok = not_blank(F.col("text")) & ~body.rlike(r"^[{\[]") & F.col("role").isin("user", "assistant")
    return messages.filter(ok).select("conv_id", "pos", "role", body.alias("text"))


def documents_of(messages: DataFrame, most: int | None = None) -> DataFrame:
    """Three views of a conversation (user, assistant, combined), messages that look like data left out; whole unless ``most`` characters are given.

    Conversations empty in any view are dropped.
    """
    lines = spoken(messages).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("ms"))

    def view(*roles: str) -> Column:
        text = F.array_join(F.transform(F.filter("ms", lambda m: m["role"].isin(*roles)), lambda m: m["text"]), "\n")
        return text if most is None else F.substring(text, 1, most)

    views = lines.select("conv_id", view("user").alias("user_doc"), view("assistant").alias("assistant_doc"), view("user", "assistant").alias("combined_doc"))
    return views.filter("user_doc <> '' and assistant_doc <> '' and combined_doc <> ''")
