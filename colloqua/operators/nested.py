"""Nested share records as flat tables that keep the keys of their parents.

Every target table is one projection: nested ``transform`` calls carry the ancestors' keys and positions down to the leaves,
``flatten`` joins the arrays of one record and a single ``inline`` emits the rows. Nothing is shuffled before a table's own
``distinct``, and no Python runs.

Defined results: a payload that is null, cut off or not an object gives no payload rows (a payload encoded twice is read);
optional keys that are absent, null or of another shape give none; null array elements are left out but count for positions;
a lone attachment object counts as an array of one; rows that come twice count once; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Payload columns of each flat table beside its keys.
LINK_KINDS = ("source", "moderation", "tool", "node", "edge", "part", "thought", "citation", "attachment")


def _payload(text: Column) -> Column:
    """The payload as a variant: parsed once more where it is a JSON string holding JSON."""
    once = F.try_parse_json(text)
    return F.when(F.schema_of_variant(once) == "STRING", F.try_parse_json(F.try_variant_get(once, "$", "string"))).otherwise(once)


def _array(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def _nodes(v: Column, whole: bool = False) -> Column:
    """array<struct> of the mapping's nodes with the arrays below them still as variants; ``whole``: with every column of the node."""

    def rest(n: Column) -> list[Column]:
        get = lambda path, kind="string": F.try_variant_get(n, f"$.message.{path}", kind).alias(path.rpartition(".")[2])
        result = F.try_variant_get(n, "$.message.metadata.aggregate_result", "variant")
        return [
            get("id").alias("message_id"), get("author.name").alias("author_name"), get("create_time", "double"), get("status"), get("weight", "double"), get("end_turn", "boolean"), get("metadata.model_slug"),
            F.when(~F.is_variant_null(result), F.to_json(result)).alias("aggregate_result"), _array(n, "$.children").alias("children"), _array(n, "$.message.metadata.aggregate_result.runs").alias("runs"),
        ]

    def node(e: Column) -> Column:
        n = e["value"]
        lone = F.try_variant_get(n, "$.message.metadata.attachments", "variant")
        return F.struct(
            e["key"].alias("node_id"),
            F.try_variant_get(n, "$.parent", "string").alias("parent"),
            F.try_variant_get(n, "$.message.author.role", "string").alias("role"),
            F.try_variant_get(n, "$.message.content.content_type", "string").alias("content_type"),
            _array(n, "$.message.content.parts").alias("parts"),
            _array(n, "$.message.content.thoughts").alias("thoughts"),
            _array(n, "$.message.metadata.citations").alias("citations"),
            F.coalesce(_array(n, "$.message.metadata.attachments"), F.when(F.schema_of_variant(lone).startswith("OBJECT"), F.array(lone))).alias("attachments"),
            *(rest(n) if whole else ()),
        )

    return F.transform(F.map_entries(F.try_variant_get(v, "$.mapping", "map<string,variant>")), node)


def _known(xs: Column) -> Column:
    """Elements with their positions; null elements keep their position but are left out."""
    return F.filter(F.transform(xs, lambda x, i: F.struct(i.alias("pos"), x.alias("x"))), lambda p: p["x"].isNotNull() & ~F.is_variant_null(p["x"]))


def _none(xs: Column, like: str) -> Column:
    return F.coalesce(xs, F.from_json(F.lit("[]"), like))


def with_nodes(raw: DataFrame) -> DataFrame:
    """``raw`` reduced to share_id, sources, metadata and the parsed nodes."""
    return raw.select("share_id", "reddit_sources", "conversation_metadata", _nodes(_payload(F.col("api_response"))).alias("nodes"))


_LINK = "array<struct<child_kind:string,parent_key:string,child_key:string>>"


def _links(kind: str, xs: Column, parent, child) -> Column:
    return _none(F.transform(xs, lambda x: F.struct(F.lit(kind).alias("child_kind"), parent(x).alias("parent_key"), child(x).alias("child_key"))), _LINK)


def _below(kind: str, field: str, key) -> Column:
    def of(n: Column) -> Column:
        return _links(kind, _known(n[field]), lambda _: n["node_id"], key)

    return _none(F.flatten(F.transform("nodes", of)), _LINK)


def parent_child_links(raw: DataFrame) -> DataFrame:
    """share_id, child_kind, parent_key, child_key of all nine kinds from one scan and one ``inline``."""
    share = lambda _: F.col("share_id")
    pos = lambda p: p["pos"].cast("string")
    # parents that are no key: a hashed set difference, empty in sound payloads, so edges need no search among all keys
    unknown = F.array_except(F.filter(F.transform("nodes", lambda n: n["parent"]), lambda p: p.isNotNull()), F.transform("nodes", lambda n: n["node_id"]))
    links = F.concat(
        _links("source", F.filter("reddit_sources", lambda s: s["name"].isNotNull()), share, lambda s: s["name"]),
        _links("moderation", F.filter("conversation_metadata.moderation_results", lambda m: m["id"].isNotNull()), share, lambda m: m["id"]),
        _links("tool", F.filter("conversation_metadata.tools_used", lambda t: t.isNotNull()), share, lambda t: t),
        _links("node", F.col("nodes"), share, lambda n: n["node_id"]),
        _links("edge", F.filter("nodes", lambda n: n["parent"].isNotNull() & ~F.array_contains("unknown", n["parent"])), lambda n: n["parent"], lambda n: n["node_id"]),
        _below("part", "parts", pos),
        _below("thought", "thoughts", pos),
        _below("citation", "citations", pos),
        _below("attachment", "attachments", lambda p: F.try_variant_get(p["x"], "$.id", "string")),
    )
    flat = with_nodes(raw).withColumn("unknown", unknown).select("share_id", F.inline(links))
    return flat.filter("child_key is not null").distinct()


def _scalars(fields, path: str = "", name: str = "") -> list[Column]:
    """Every field outside arrays, those of a struct with its name before theirs."""
    out = []
    for f in fields:
        if isinstance(f.dataType, T.StructType):
            out += _scalars(f.dataType.fields, f"{path}`{f.name}`.", f"{name}{f.name}_")
        elif not isinstance(f.dataType, (T.ArrayType, T.MapType)):
            out.append(F.col(f"{path}`{f.name}`").alias(name + f.name))
    return out


def flat_tables(raw: DataFrame) -> dict[str, DataFrame]:
    """The related tables with their payload columns: one for the shares, one for the payloads and one for each array."""
    parsed = raw.select("share_id", _payload(F.col("api_response")).alias("v")).withColumn("nodes", _nodes(F.col("v"), whole=True))
    text = lambda x, path="$": F.try_variant_get(x, path, "string")

    def leaves(field: str, **columns) -> DataFrame:
        of = lambda n: F.transform(_known(n[field]), lambda p: F.struct(n["node_id"].alias("node_id"), p["pos"].alias("pos"), *(f(p["x"]).alias(c) for c, f in columns.items())))
        return parsed.select("share_id", F.inline(F.flatten(F.filter(F.transform("nodes", of), lambda a: a.isNotNull())))).distinct()

    def values(array: Column | str, name: str) -> DataFrame:
        return raw.select("share_id", F.posexplode(array).alias("pos", name)).filter(F.col(name).isNotNull()).distinct()

    columns = ("node_id", "parent", "role", "content_type", "message_id", "author_name", "create_time", "status", "weight", "end_turn", "model_slug", "aggregate_result")
    nodes = F.transform("nodes", lambda n: F.struct(*(n[c].alias(c) for c in columns)))
    own = lambda path, kind="string": F.try_variant_get("v", f"$.{path}", kind).alias(path)
    payload = [own("title"), own("conversation_id"), own("create_time", "double"), own("current_node"), own("is_public", "boolean")]
    said = raw.select("share_id", "fetched_at", F.posexplode("messages").alias("pos", "m")).filter("m is not null")
    as_text = lambda x: F.coalesce(text(x), F.to_json(x))
    return {
        "shares": raw.select(*_scalars([f for f in raw.schema.fields if f.name != "api_response"])).distinct(),
        "sources": raw.select("share_id", F.inline(F.filter("reddit_sources", lambda s: s.isNotNull()))).distinct(),
        "moderation": raw.select("share_id", F.inline(F.filter("conversation_metadata.moderation_results", lambda m: m.isNotNull()))).distinct(),
        "tools": raw.select("share_id", F.explode("conversation_metadata.tools_used").alias("tool")).filter("tool is not null").distinct(),
        "safe_urls": values("conversation_metadata.safe_urls", "url"),
        "file_types": values("conversation_metadata.file_types", "file_type"),
        "messages": said.select("share_id", "fetched_at", "pos", *_scalars(said.schema["m"].dataType.fields, "m.")).distinct(),
        "message_children": said.select("share_id", "fetched_at", "pos", F.posexplode("m.children").alias("child_pos", "child")).filter("child is not null").distinct(),
        "payloads": parsed.filter(F.schema_of_variant("v").startswith("OBJECT")).select("share_id", *payload).distinct(),
        "payload_safe_urls": parsed.select("share_id", F.inline(F.transform(_known(_array(F.col("v"), "$.safe_urls")), lambda p: F.struct(p["pos"].alias("pos"), as_text(p["x"]).alias("url"))))).distinct(),
        "nodes": parsed.select("share_id", F.inline(nodes)).distinct(),
        "parts": leaves("parts", text=as_text),
        "thoughts": leaves("thoughts", summary=lambda x: text(x, "$.summary"), content=lambda x: text(x, "$.content")),
        "citations": leaves("citations", start_ix=lambda x: F.try_variant_get(x, "$.start_ix", "bigint"), end_ix=lambda x: F.try_variant_get(x, "$.end_ix", "bigint"), url=lambda x: text(x, "$.metadata.url"), title=lambda x: text(x, "$.metadata.title")),
        "attachments": leaves("attachments", attachment_id=lambda x: text(x, "$.id"), name=lambda x: text(x, "$.name"), mime_type=lambda x: text(x, "$.mime_type"), size=lambda x: F.try_variant_get(x, "$.size", "bigint")),
        "children": leaves("children", child=as_text),
        "runs": leaves("runs", ms=lambda x: F.try_variant_get(x, "$.ms", "bigint"), run=F.to_json),
    }
