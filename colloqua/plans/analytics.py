"""Queries of the reference pipeline's operators over whole tables, each with the same query in DuckDB's SQL.

Messages come from the array form of each share's latest successful fetch; doubles are rounded to six places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloqua.functions import text as T
from colloqua.functions.lexicons import FUNCTION_WORDS, NEGATIVE, POSITIVE
from colloqua.operators import anonymise, collect, measures, merge, models, pairs, stats, structure
from colloqua.session import checkpoint, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Topics that can be clustered on the driver; more are refused.
MOST_TOPICS = 2000
METRICS = ["lsm_score", "lexical_jaccard", "sentiment_similarity", "semantic_similarity"]


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


# ---- shared relations -------------------------------------------------------------------------------------------------


def _shares(spark: SparkSession, d: str) -> DataFrame:
    return pairs.latest_fetch(table(spark, d, "conversations_raw"), "messages")


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return pairs.explode_messages(_shares(spark, d))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.turn_pairs(_messages(spark, d))


def _semantic(spark: SparkSession, d: str) -> DataFrame:
    keys = ["conv_id", "turn", "user_cross_check_5", "assistant_cross_check_5"]
    rows = table(spark, d, "semantic_alignment").withColumn("turn", F.col("turn").cast("bigint"))
    return rows.groupBy(*keys).agg(F.max("semantic_similarity").cast("double").alias("semantic_similarity"))


def _merged(spark: SparkSession, d: str) -> DataFrame:
    base = measures.measured(_pairs(spark, d)).drop("user_text", "assistant_text", "model")
    about = collect.first_source(pairs.latest_fetch(table(spark, d, "conversations_raw"), "messages", "reddit_sources"))
    return merge.merged(base, {"semantic": _semantic(spark, d)}, about.select("conv_id", F.col("subreddit").alias("topic")))


def _r(c: str):
    return F.round(F.col(c), 6).alias(c)


_WS = r"\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_LATEST = "SELECT share_id, arg_max(messages, fetched_at) AS messages, arg_max(reddit_sources, fetched_at) AS sources FROM conversations_raw WHERE fetch_success AND messages IS NOT NULL AND share_id IS NOT NULL GROUP BY share_id"
_ROLE = "CASE lower(trim(m.role)) WHEN 'human' THEN 'user' WHEN 'bot' THEN 'assistant' ELSE lower(trim(m.role)) END"
_MSG = f"""latest AS ({_LATEST}),
flat AS (SELECT share_id AS conv_id, unnest(messages) AS m, generate_subscripts(messages, 1) - 1 AS pos FROM latest),
msg AS (SELECT conv_id, pos, {_ROLE} AS role, m.text AS text, m.model_slug AS model_slug, m.create_time AS create_time FROM flat)"""
_PAIR = f"""{_MSG},
near AS (SELECT *, lag(role) OVER w AS prev_role, lag(text) OVER w AS prev_text, lag(pos) OVER w AS prev_pos FROM msg
  WHERE role IN ('user', 'assistant') AND text IS NOT NULL AND regexp_matches(text, '[^{_WS}]') WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
pair AS (SELECT conv_id, CASE WHEN role = 'assistant' THEN 1 ELSE -1 END * row_number() OVER (PARTITION BY conv_id, role ORDER BY pos) AS turn,
  CASE WHEN role = 'assistant' THEN 'user→assistant' ELSE 'assistant→user' END AS direction, model_slug AS own_slug, role,
  CASE WHEN role = 'assistant' THEN prev_text ELSE text END AS u, CASE WHEN role = 'assistant' THEN text ELSE prev_text END AS a,
  CASE WHEN role = 'assistant' THEN prev_pos ELSE pos END AS upos, CASE WHEN role = 'assistant' THEN pos ELSE prev_pos END AS apos
  FROM near WHERE prev_role IS NOT NULL AND prev_role <> role)"""


def _listed(words: str) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words.split()) + "]"


def _tok(c: str) -> str:
    return f"list_transform(regexp_extract_all({c}, '[a-zA-Z'']+'), lambda x: lower(x))"


def _count(tok: str, words: str) -> str:
    return f"len(list_filter({tok}, lambda x: list_contains({_listed(words)}, x)))"


_PROPS = ", ".join(f"CASE WHEN len({s}tok) > 0 THEN {_count(s + 'tok', ws)} / len({s}tok) ELSE 0.0 END AS {s}_{c}" for s in "ua" for c, ws in FUNCTION_WORDS.items())
_LSM = "(" + " + ".join(f"(1 - abs(u_{c} - a_{c}) / (u_{c} + a_{c} + 1e-8))" for c in FUNCTION_WORDS) + f") / {len(FUNCTION_WORDS)}"


def _split(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '[{_WS}]+'), lambda x: x <> '')"


def _polar(t: str) -> str:
    p, n = _count(t, POSITIVE), _count(t, NEGATIVE)
    return f"CASE WHEN {p} + {n} > 0 THEN ({p} - {n}) / ({p} + {n}) ELSE 0.0 END"


_MEASURED = f"""{_PAIR},
tok AS (SELECT *, {_tok('u')} AS utok, {_tok('a')} AS atok, list_distinct({_split('lower(u)')}) AS uw, list_distinct({_split('lower(a)')}) AS aw FROM pair),
prop AS (SELECT *, {_PROPS}, {_polar('utok')} AS user_sentiment, {_polar('atok')} AS assistant_sentiment FROM tok),
measured AS (SELECT conv_id, turn, direction, substr(u, 1, 5) AS ucheck, substr(a, 1, 5) AS acheck, {_LSM} AS lsm_score,
  CASE WHEN len(list_distinct(list_concat(uw, aw))) > 0 THEN len(list_intersect(uw, aw)) / len(list_distinct(list_concat(uw, aw))) END AS lexical_jaccard,
  user_sentiment, assistant_sentiment, 1 - abs(user_sentiment - assistant_sentiment) / 2 AS sentiment_similarity,
  len({_split('u')}) + len({_split('a')}) AS n_tokens_total FROM prop)"""
_SEM = "sem AS (SELECT conv_id, turn, user_cross_check_5 AS uc, assistant_cross_check_5 AS ac, max(semantic_similarity)::DOUBLE AS semantic_similarity FROM semantic_alignment GROUP BY ALL)"
_MERGED = f"""{_MEASURED}, {_SEM},
topic AS (SELECT share_id AS conv_id, list_filter(list_transform(sources, lambda s: s.subreddit), lambda x: x <> '')[1] AS topic FROM latest),
merged AS (SELECT m.*, s.semantic_similarity, t.topic FROM measured m
  LEFT JOIN sem s ON m.conv_id = s.conv_id AND m.turn = s.turn AND m.ucheck IS NOT DISTINCT FROM s.uc AND m.acheck IS NOT DISTINCT FROM s.ac
  LEFT JOIN topic t ON m.conv_id = t.conv_id)"""
_LONG = f"{_MERGED}, long AS (" + " UNION ALL ".join(f"SELECT conv_id, turn, direction, topic, '{m}' AS metric, {m} AS value FROM merged" for m in METRICS) + ")"


# ---- messages and pairs -----------------------------------------------------------------------------------------------


@query("scan_messages", f"WITH {_MSG} SELECT conv_id, pos, role, text FROM msg")
def scan_messages(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).select("conv_id", "pos", "role", "text")


@query("turn_pairs", f"WITH {_PAIR} SELECT conv_id, turn, direction, conv_id || '_' || upos || '_user' AS user_message_id, conv_id || '_' || apos || '_assistant' AS assistant_message_id, substr(u, 1, 5) AS user_cross_check_5, substr(a, 1, 5) AS assistant_cross_check_5 FROM pair")
def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).drop("user_text", "assistant_text", "model_slug", "model")


@query("pair_directions", f"WITH {_PAIR} SELECT direction, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM pair GROUP BY direction")
def pair_directions(spark: SparkSession, d: str) -> DataFrame:
    n = _pairs(spark, d).groupBy("direction").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))  # two rows


@query("turn_counts", f"WITH {_MSG} SELECT conv_id, count(*) AS n_turns FROM msg WHERE role IN ('user','assistant') AND text IS NOT NULL AND regexp_matches(text, '[^{_WS}]') GROUP BY conv_id")
def turn_counts(spark: SparkSession, d: str) -> DataFrame:
    return pairs.spoken(_messages(spark, d)).groupBy("conv_id").agg(F.count("*").alias("n_turns"))


# ---- measures ---------------------------------------------------------------------------------------------------------


@query("turn_pairs_lsm", f"WITH {_MEASURED} SELECT conv_id, turn, direction, round(lsm_score, 6) AS lsm_score FROM measured")
def turn_pairs_lsm(spark: SparkSession, d: str) -> DataFrame:
    return measures.measured(_pairs(spark, d)).select("conv_id", "turn", "direction", _r("lsm_score"))


@query("function_word_props", f"WITH {_MSG}, t AS (SELECT conv_id, pos, {_tok('text')} AS ut FROM msg WHERE text IS NOT NULL) SELECT conv_id, pos, " + ", ".join(f"round(CASE WHEN len(ut) > 0 THEN {_count('ut', ws)} / len(ut) ELSE 0.0 END, 6) AS {c}" for c, ws in FUNCTION_WORDS.items()) + " FROM t")
def function_word_props(spark: SparkSession, d: str) -> DataFrame:
    p = _messages(spark, d).filter("text is not null").select("conv_id", "pos", T.proportions(T.tokens(F.col("text"))).alias("p"))
    return p.select("conv_id", "pos", *[F.round(f"p.{c}", 6).alias(c) for c in FUNCTION_WORDS])


@query("lexical_jaccard", f"WITH {_MEASURED} SELECT conv_id, turn, round(lexical_jaccard, 6) AS lexical_jaccard FROM measured")
def lexical_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return measures.measured(_pairs(spark, d)).select("conv_id", "turn", _r("lexical_jaccard"))


@query("sentiment_similarity", f"WITH {_MEASURED} SELECT conv_id, turn, round(user_sentiment, 6) AS user_sentiment, round(assistant_sentiment, 6) AS assistant_sentiment, round(sentiment_similarity, 6) AS sentiment_similarity FROM measured")
def sentiment_similarity(spark: SparkSession, d: str) -> DataFrame:
    return measures.measured(_pairs(spark, d)).select("conv_id", "turn", _r("user_sentiment"), _r("assistant_sentiment"), _r("sentiment_similarity"))


@query("token_estimate", f"WITH {_MEASURED} SELECT conv_id, turn, n_tokens_total FROM measured")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return measures.measured(_pairs(spark, d)).select("conv_id", "turn", F.col("n_tokens_total").cast("bigint").alias("n_tokens_total"))


def _tags(c: str) -> str:
    core = f"trim(w, '{measures.SIGNS.replace(chr(39), chr(39) * 2)}')"
    closed = " ".join(f"WHEN list_contains({_listed(ws)}, lower({core})) THEN '{t}'" for t, ws in measures.CLOSED)
    ends = " ".join(f"WHEN regexp_matches(lower({core}), '({e})$') THEN '{t}'" for t, e in measures.ENDINGS)
    return f"list_distinct(list_transform({_split(c)}, lambda w: CASE WHEN {core} = '' THEN 'PUNCT' WHEN regexp_matches({core}, '^[0-9]') THEN 'NUM' {closed} {ends} WHEN regexp_matches({core}, '^\\p{{Lu}}') THEN 'PROPN' ELSE 'NOUN' END))"


_POS = f"pos AS (SELECT conv_id, turn, {_tags('u')} AS ut, {_tags('a')} AS atg FROM pair), posj AS (SELECT conv_id, turn, CASE WHEN len(list_distinct(list_concat(ut, atg))) > 0 THEN len(list_intersect(ut, atg)) / len(list_distinct(list_concat(ut, atg))) END AS pos_jaccard FROM pos)"


@query("pos_jaccard", f"WITH {_PAIR}, {_POS} SELECT conv_id, turn, round(pos_jaccard, 6) AS pos_jaccard FROM posj")
def pos_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return measures.pos_jaccard(_pairs(spark, d)).select("conv_id", "turn", _r("pos_jaccard"))


@query("embedding_similarity", "WITH e AS (SELECT vec_id, embedding FROM embeddings) SELECT a.vec_id AS user_vec, b.vec_id AS assistant_vec, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS similarity FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def embedding_similarity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    u = e.select(F.col("vec_id").alias("user_vec"), F.col("embedding").alias("u"))
    a = e.select(F.col("vec_id").alias("assistant_vec"), F.col("embedding").alias("a"), (F.col("vec_id") - 1).alias("user_vec"))
    return u.join(a, "user_vec").select("user_vec", "assistant_vec", F.round(measures.cosine(F.col("u"), F.col("a")), 5).alias("similarity"))


@query("measure_describe", f"WITH {_LONG} SELECT metric, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(stddev_pop(value), 6) AS sd_pop, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, round(max(value), 6) AS max FROM long GROUP BY metric")
def measure_describe(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = stats.long_form(_merged(spark, d), ["conv_id", "turn"], METRICS).groupBy("metric").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.stddev_pop(v).alias("sd_pop"), F.min(v).alias("min"), q.alias("q"), F.max(v).alias("max"))
    return out.select("metric", "n", _r("mean"), _r("sd"), _r("sd_pop"), _r("min"), *[F.round(F.col("q")[i], 6).alias(c) for i, c in enumerate(("q25", "q50", "q75"))], _r("max"))


# ---- structure, extraction, cleaning ----------------------------------------------------------------------------------


@query("structural_features", f"""WITH {_MSG}, x AS (SELECT *, coalesce(length(text), 0) AS n FROM msg) SELECT conv_id, count(*) AS total_turns, count(*) FILTER (role = 'user') AS user_turns, count(*) FILTER (role = 'assistant') AS assistant_turns, count(*) FILTER (role = 'system') AS system_turns,
 round(coalesce(avg(n) FILTER (role = 'user'), 0), 6) AS avg_user_message_length, round(coalesce(avg(n) FILTER (role = 'assistant'), 0), 6) AS avg_assistant_message_length, sum(n)::BIGINT AS total_conversation_length, coalesce(sum(n) FILTER (role = 'user'), 0)::BIGINT AS user_text_length, coalesce(sum(n) FILTER (role = 'assistant'), 0)::BIGINT AS assistant_text_length,
 {", ".join(f"sum(coalesce((length(text) - length(replace(text, '{p}', ''))) // {len(p)}, 0))::BIGINT AS {k}" for k, p in structure.PLACEHOLDERS.items())}, bool_or(coalesce({" OR ".join(f"contains(text, '{p}')" for p in structure.PLACEHOLDERS.values())}, false)) AS has_any_block FROM x GROUP BY conv_id""")
def structural_features(spark: SparkSession, d: str) -> DataFrame:
    f = structure.features(_messages(spark, d))
    return f.withColumns({c: F.round(c, 6) for c in ("avg_user_message_length", "avg_assistant_message_length")})


@query("conversation_summary", f"WITH {_MSG}, x AS (SELECT *, nullif(create_time, 0) AS t FROM msg) SELECT conv_id, count(*) AS message_count, count(*) FILTER (role = 'user') AS user_messages, count(*) FILTER (role = 'assistant') AS assistant_messages, count(*) FILTER (role = 'system') AS system_messages, count(*) FILTER (role = 'system') > 0 AS has_system_prompt, round(min(t), 3) AS first_message_time, round(max(t), 3) AS last_message_time, round(max(t) - min(t), 3) AS duration_seconds FROM x GROUP BY conv_id")
def conversation_summary(spark: SparkSession, d: str) -> DataFrame:
    flat = _shares(spark, d).select(F.col("share_id").alias("conv_id"), F.explode("messages").alias("m")).select("conv_id", pairs.role_name(F.col("m.role")).alias("role"), "m.create_time")
    return structure.summary(flat).withColumns({c: F.round(c, 3) for c in ("first_message_time", "last_message_time", "duration_seconds")})


_PAYLOAD = """p AS (SELECT share_id, fetched_at, CASE WHEN json_valid(api_response) THEN CASE WHEN json_type(api_response) = 'VARCHAR' THEN CASE WHEN json_valid(api_response::JSON ->> '$') THEN (api_response::JSON ->> '$')::JSON END ELSE api_response::JSON END END AS v FROM conversations_raw WHERE fetch_success),
k AS (SELECT share_id, fetched_at, v, unnest(json_keys(v, '$.mapping')) AS node_id FROM p WHERE json_type(v, '$.mapping') = 'OBJECT'),
node AS (SELECT DISTINCT share_id, fetched_at, node_id, json_extract(v, '$.mapping."' || node_id || '"') AS n FROM k)"""


def _js(path: str) -> str:
    return f"CASE WHEN json_type(n, '$.{path}') NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN n ->> '$.{path}' END"


def _jlen(path: str) -> str:
    return f"CASE json_type(n, '$.{path}') WHEN 'ARRAY' THEN nullif(json_array_length(n, '$.{path}'), 0) WHEN 'OBJECT' THEN 1 END::INT"


_JPART = "list_transform(list_filter(json_extract(n, '$.message.content.parts[*]'), lambda x: json_type(x) <> 'NULL'), lambda x: x ->> '$')"
_MESSAGE_COLUMNS = ("share_id", "node_id", "parent", "n_children", "id", "role", "author_name", "create_time", "content_type", "text", "code", "language", "n_thoughts", "status", "weight", "is_visually_hidden", "is_redacted", "end_turn", "recipient", "channel", "model_slug", "gizmo_id", "message_type", "request_id", "reasoning_duration_sec", "n_citations", "n_content_references", "n_attachments", "execution_status", "execution_output", "latency_ms")


def _flag(name: str) -> str:
    return f"coalesce(({_js('message.metadata.' + name)})::BOOLEAN, false)"


@query("payload_messages", f"""WITH {_PAYLOAD} SELECT DISTINCT share_id, node_id, {_js('parent')} AS parent, {_jlen('children')} AS n_children, {_js('message.id')} AS id, {_js('message.author.role')} AS role, {_js('message.author.name')} AS author_name, ({_js('message.create_time')})::DOUBLE AS create_time,
 {_js('message.content.content_type')} AS content_type, regexp_replace(array_to_string(CASE WHEN json_type(n, '$.message.content.parts') = 'ARRAY' THEN {_JPART} END, chr(10) || chr(10)), '\\{{"[^{{}}]*\\}}', '{{}}', 'g') AS text, CASE WHEN {_js('message.content.content_type')} = 'code' THEN nullif({_js('message.content.text')}, '') END AS code, nullif({_js('message.content.language')}, '') AS language, {_jlen('message.content.thoughts')} AS n_thoughts,
 {_js('message.status')} AS status, ({_js('message.weight')})::DOUBLE AS weight, {_flag('is_visually_hidden_from_conversation')} AS is_visually_hidden, {_flag('is_redacted')} AS is_redacted, ({_js('message.end_turn')})::BOOLEAN AS end_turn, {_js('message.recipient')} AS recipient, {_js('message.channel')} AS channel,
 {", ".join(f"nullif({_js('message.metadata.' + c)}, '') AS {c}" for c in ("model_slug", "gizmo_id", "message_type", "request_id"))}, nullif(({_js('message.metadata.finished_duration_sec')})::DOUBLE, 0) AS reasoning_duration_sec, {", ".join(f"{_jlen('message.metadata.' + c)} AS n_{c}" for c in structure.LISTS)},
 {_js('message.metadata.aggregate_result.status')} AS execution_status, {_js('message.metadata.aggregate_result.final_expression_output')} AS execution_output, ({_js('message.metadata.sonic_classification_result.latency_ms')})::DOUBLE AS latency_ms FROM node WHERE json_type(n, '$.message') = 'OBJECT'""")
def payload_messages(spark: SparkSession, d: str) -> DataFrame:
    """Objects among the parts of a text are shown as {}, because the order of their keys is not kept."""
    m = structure.extracted(table(spark, d, "conversations_raw").filter("fetch_success"))
    return m.withColumn("text", F.regexp_replace("text", r'\{"[^{}]*\}', "{}")).select(*_MESSAGE_COLUMNS).distinct()


@query("payload_order", f"""WITH {_PAYLOAD}, m AS (SELECT DISTINCT share_id, fetched_at, node_id, coalesce(({_js('message.create_time')})::DOUBLE, 0) AS t FROM node WHERE json_type(n, '$.message') = 'OBJECT') SELECT share_id, fetched_at, rank() OVER (PARTITION BY share_id, fetched_at ORDER BY t) - 1 AS first_index, t, count(*) AS n FROM m GROUP BY share_id, fetched_at, t""".replace("rank() OVER (PARTITION BY share_id, fetched_at ORDER BY t) - 1", "(coalesce(sum(count(*)) OVER (PARTITION BY share_id, fetched_at ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT"))
def payload_order(spark: SparkSession, d: str) -> DataFrame:
    m = structure.extracted(table(spark, d, "conversations_raw").filter("fetch_success"))
    return m.groupBy("share_id", "fetched_at", F.coalesce("create_time", F.lit(0.0)).alias("t")).agg(F.min("backend_index").alias("first_index"), F.count("*").alias("n"))


_MIME = "list_filter(list_transform(CASE json_type(n, '$.message.metadata.attachments') WHEN 'ARRAY' THEN json_extract(n, '$.message.metadata.attachments[*]') WHEN 'OBJECT' THEN [json_extract(n, '$.message.metadata.attachments')] END, lambda a: a ->> '$.mime_type'), lambda m: m <> '')"


@query("payload_features", f"""WITH {_PAYLOAD}, f AS (SELECT DISTINCT share_id, node_id, {_js('message.content.content_type')} AS kind, CASE WHEN {_js('message.author.role')} = 'tool' THEN nullif({_js('message.author.name')}, '') END AS tool, coalesce({_jlen('message.metadata.attachments')}, 0) AS files, {_MIME} AS mime,
 CASE WHEN {_js('message.content.content_type')} = 'thoughts' THEN ({_js('message.metadata.finished_duration_sec')})::DOUBLE END AS seconds, coalesce({_jlen('message.metadata.citations')}, 0) AS citations, nullif({_js('message.metadata.gizmo_id')}, '') AS gizmo, coalesce({_jlen('children')}, 0) > 1 AS branch, ({_js('message.id')}) IS NOT NULL AS message, {_flag('is_visually_hidden_from_conversation')} AS hidden, {_flag('is_redacted')} AS redacted FROM node)
SELECT share_id, count(DISTINCT node_id) AS mapping_size, count(*) FILTER (kind = 'model_editable_context') > 0 AS has_custom_instructions, coalesce(string_agg(DISTINCT tool, '|' ORDER BY tool), '') AS tools_used, count(tool) AS tool_call_count, sum(files)::BIGINT AS file_count, array_to_string(list_sort(list_distinct(flatten(coalesce(list(mime) FILTER (mime IS NOT NULL), [])))), '|') AS file_types,
 count(*) FILTER (kind = 'thoughts') AS reasoning_message_count, coalesce(sum(seconds), 0.0) AS total_thinking_seconds, count(*) FILTER (kind = 'code') AS code_block_count, count(*) FILTER (kind = 'execution_output') AS code_execution_count, sum(citations)::BIGINT AS citation_count, count(gizmo) > 0 AS custom_gpt_used, coalesce(string_agg(DISTINCT gizmo, '|' ORDER BY gizmo), '') AS gizmo_ids, count(*) FILTER (branch) AS branch_count,
 count(*) FILTER (message) AS total_messages, count(*) FILTER (message AND hidden) AS hidden_messages, count(*) FILTER (message AND redacted) AS redacted_messages FROM f GROUP BY share_id""")
def payload_features(spark: SparkSession, d: str) -> DataFrame:
    return structure.metadata_features(table(spark, d, "conversations_raw").filter("fetch_success"))


@query("payload_kinds", "SELECT CASE WHEN json_valid(api_response) THEN CASE json_type(api_response) WHEN 'VARCHAR' THEN 'twice' WHEN 'OBJECT' THEN 'object' ELSE 'other' END WHEN api_response IS NULL THEN 'none' ELSE 'unreadable' END AS kind, count(*) AS n FROM conversations_raw GROUP BY 1")
def payload_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Tolerant parse: what each payload turns out to be."""
    kind = F.schema_of_variant(F.try_parse_json("api_response"))
    named = F.when(kind == "STRING", "twice").when(kind.startswith("OBJECT"), "object").when(kind.isNotNull(), "other").when(F.col("api_response").isNull(), "none").otherwise("unreadable")
    return table(spark, d, "conversations_raw").groupBy(named.alias("kind")).agg(F.count("*").alias("n"))


@query("clean_markdown")
def clean_markdown(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.without_notice(T.clean_markdown(F.col("text"))).alias("text")).distinct()


def _step(name: str, duck: str, to: str = ""):
    to_duck = to.replace("$", "\\")

    @query(f"strip_{name}", f"SELECT DISTINCT message_id, regexp_replace(text, '{duck}', '{to_duck}', 'g') AS text FROM conversations WHERE text IS NOT NULL")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, "conversations").filter("text is not null").select("message_id", T.step(F.col("text"), name).alias("text")).distinct()


for _n, _p, _t in (("inline_code", "`([^`]+)`", "$1"), ("bold", r"\*\*([^*]+)\*\*", "$1"), ("italic", r"\*([^*]+)\*", "$1"), ("strike", "~~([^~]+)~~", "$1"), ("links", r"\[([^\]]+)\]\([^)]+\)", "$1"), ("tables", r"\|[^\n]+\|", ""), ("html", "<[^>]+>", ""), ("repeats", "={4,}|-{4,}|_{4,}|~{4,}", ""), ("newlines", r"\n{3,}", "\n\n"), ("spaces", "[ ]{2,}", " ")):
    _step(_n, _p, _t)


@query("topic_documents", f"""WITH {_MSG}, ok AS (SELECT conv_id, pos, role, trim(text) AS t FROM msg WHERE role IN ('user','assistant') AND text IS NOT NULL AND regexp_matches(text, '[^{_WS}]') AND NOT regexp_matches(trim(text), '^[{{\\[]')),
v AS (SELECT conv_id, string_agg(t, chr(10) ORDER BY pos) FILTER (role = 'user') AS user_doc, string_agg(t, chr(10) ORDER BY pos) FILTER (role = 'assistant') AS assistant_doc, string_agg(t, chr(10) ORDER BY pos) AS combined_doc FROM ok GROUP BY conv_id)
SELECT * FROM v WHERE user_doc <> '' AND assistant_doc <> '' AND combined_doc <> ''""")
def topic_documents(spark: SparkSession, d: str) -> DataFrame:
    return structure.documents_of(_messages(spark, d))


@query("topic_model")
def topic_model(spark: SparkSession, d: str) -> DataFrame:
    return models.topic_model(structure.spoken(_messages(spark, d))).select("conv_id", "view", "topic_id", _r("topic_score"), "keywords")


@query("language_distribution", "WITH l AS (SELECT lower(split_part(replace(lang, '_', '-'), '-', 1)) AS language FROM (SELECT DISTINCT message_id, lang FROM conversations)) SELECT language, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM l GROUP BY language ORDER BY n DESC, language NULLS FIRST LIMIT 10")
def language_distribution(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    l = table(spark, d, "conversations").select("message_id", "lang").distinct().select(F.lower(F.split("lang", "[-_]")[0]).alias("language"))
    n = l.groupBy("language").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # a row a language
    return n.withColumn("pct", F.round(100.0 * F.col("n") / total, 6)).orderBy(F.desc("n"), F.asc_nulls_first("language")).limit(10)


@query("success_rate", "SELECT count(*) AS n, round(avg(fetch_success::INT), 6) AS success_rate, round(avg((lang_detection_confidence < 0.8)::INT), 6) AS low_confidence_rate, round(avg((conversation_language = 'en')::INT), 6) AS english_share FROM conversations_raw")
def success_rate(spark: SparkSession, d: str) -> DataFrame:
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    raw = table(spark, d, "conversations_raw")
    return raw.agg(F.count("*").alias("n"), share(F.col("fetch_success")).alias("success_rate"), share(F.col("lang_detection_confidence") < 0.8).alias("low_confidence_rate"), share(F.col("conversation_language") == "en").alias("english_share"))


# ---- anonymisation ----------------------------------------------------------------------------------------------------

_PATTERNS = [p for _, p, _ in anonymise.ENTITIES]
_ANON = "text"
for _, _p, _h in anonymise.ENTITIES:
    _ANON = f"regexp_replace({_ANON}, '{_p}', '{_h}', 'g')"


@query("redact", f"SELECT DISTINCT message_id, {_ANON} AS text FROM conversations WHERE text IS NOT NULL")
def redact(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").filter("text is not null").select("message_id", anonymise.anonymised(F.col("text")).alias("text")).distinct()


def _left(i: int) -> str:
    out = "text"
    for _, p, h in anonymise.ENTITIES[:i]:
        out = f"regexp_replace({out}, '{p}', '{h}', 'g')"
    return out


@query("redaction_counts", " UNION ALL ".join(f"SELECT '{n}' AS entity, coalesce(sum(len(regexp_extract_all({_left(i)}, '{p}'))), 0)::BIGINT AS n FROM conversations" for i, (n, p, _) in enumerate(anonymise.ENTITIES)))
def redaction_counts(spark: SparkSession, d: str) -> DataFrame:
    return anonymise.counts(table(spark, d, "conversations"), "text")


# ---- collection -------------------------------------------------------------------------------------------------------

_HOSTS = ("chat.example", "www.chat.example", "old-chat.example")
_SITE = "https://forum.example"
_URL = r"(?:https?://)?(?:www\.)?(?:chat\.example|www\.chat\.example|old-chat\.example)/share/[A-Za-z0-9_-]+"
_CLATEST = "c AS (SELECT id, arg_max(body, ingested_at) AS body, arg_max(share_urls, ingested_at) AS share_urls, arg_max(created_utc, ingested_at) AS created_utc, arg_max(link_id, ingested_at) AS link_id FROM reddit_comments WHERE id IS NOT NULL GROUP BY id)"


@query("share_url_extract", f"WITH u AS (SELECT DISTINCT id, unnest(regexp_extract_all(body, '(?i){_URL}')) AS m FROM reddit_comments) SELECT DISTINCT id, CASE WHEN starts_with(m, 'http') THEN m ELSE 'https://' || m END AS url FROM u")
def share_url_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reddit_comments").select("id", F.explode(collect.share_urls(F.col("body"), _HOSTS)).alias("url")).distinct()


@query("share_ids", "WITH u AS (SELECT DISTINCT unnest(share_urls) AS url FROM reddit_comments) SELECT url, nullif(regexp_extract(url, '/share/([^/?#]+)', 1), '') AS share_id FROM u")
def share_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reddit_comments").select(F.explode("share_urls").alias("url")).distinct().select("url", collect.share_id(F.col("url")).alias("share_id"))


@query("posts_with_comments", "SELECT id, max(num_comments) AS num_comments FROM reddit_posts WHERE num_comments > 0 AND id IS NOT NULL GROUP BY id")
def posts_with_comments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reddit_posts").filter("num_comments > 0 and id is not null").groupBy("id").agg(F.max("num_comments").alias("num_comments"))


@query("normalised_posts", f"SELECT DISTINCT id, name, subreddit, author, created_utc, title, score, num_comments, url, CASE WHEN permalink <> '' THEN CASE WHEN starts_with(permalink, 'http') THEN permalink ELSE '{_SITE}' || permalink END END AS permalink FROM reddit_posts")
def normalised_posts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "reddit_posts")
    return p.select("id", "name", "subreddit", "author", "created_utc", "title", "score", "num_comments", "url", collect.with_site(F.col("permalink"), _SITE).alias("permalink")).distinct()


@query("comments_per_post", f"WITH {_CLATEST}, p AS (SELECT DISTINCT id, name FROM reddit_posts WHERE id IS NOT NULL) SELECT p.id AS post_id, count(*) AS n FROM c JOIN p ON c.link_id = p.name GROUP BY p.id")
def comments_per_post(spark: SparkSession, d: str) -> DataFrame:
    posts = table(spark, d, "reddit_posts").filter("id is not null").select("id", "name").distinct().withColumn("subreddit", F.lit(None).cast("string"))
    return collect.comments_of_posts(collect.latest(table(spark, d, "reddit_comments")), posts).groupBy("post_id").agg(F.count("*").alias("n"))


@query("share_targets", f"""WITH {_CLATEST}, p AS (SELECT id, arg_max(url, ingested_at) AS url, arg_max(created_utc, ingested_at) AS created_utc FROM reddit_posts WHERE id IS NOT NULL GROUP BY id),
l AS (SELECT url, id, 'post' AS kind, created_utc FROM p UNION ALL SELECT unnest(share_urls), id, 'comment', created_utc FROM c),
s AS (SELECT nullif(regexp_extract(url, '(?:^|/)share/([^/?#]+)', 1), '') AS share_id, id, min(created_utc) AS t FROM l GROUP BY ALL)
SELECT share_id, count(*) AS n_sources, min(t) AS first_seen FROM s WHERE share_id IS NOT NULL GROUP BY share_id""")
def share_targets(spark: SparkSession, d: str) -> DataFrame:
    return collect.targets(collect.latest(table(spark, d, "reddit_posts")), collect.latest(table(spark, d, "reddit_comments"))).select("share_id", "n_sources", "first_seen")


@query("seen_anti_join", "SELECT DISTINCT c.id FROM reddit_comments c WHERE NOT EXISTS (SELECT 1 FROM conversations_raw r, unnest(r.reddit_sources) AS u(s) WHERE s.id = c.id) AND c.id IS NOT NULL")
def seen_anti_join(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "conversations_raw").select(F.explode("reddit_sources").alias("s")).select(F.col("s.id").alias("id")).filter("id is not null")
    return collect.unseen(table(spark, d, "reddit_comments").filter("id is not null"), seen).select("id")


@query("still_to_fetch", "WITH t AS (SELECT DISTINCT nullif(regexp_extract(url, '/share/([^/?#]+)', 1), '') AS share_id FROM (SELECT unnest(share_urls) AS url FROM reddit_comments)) SELECT share_id FROM t WHERE share_id IS NOT NULL AND share_id NOT IN (SELECT share_id FROM conversations_raw WHERE len(messages) > 0 AND share_id IS NOT NULL)")
def still_to_fetch(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "reddit_comments").select(F.explode("share_urls").alias("url")).select(collect.share_id(F.col("url")).alias("share_id")).filter("share_id is not null").distinct()
    return collect.still_to_fetch(wanted, table(spark, d, "conversations_raw"), refresh_missing=True)


@query("dedup_sources", "SELECT DISTINCT share_id, s.id AS source_id FROM (SELECT share_id, unnest(reddit_sources) AS s FROM conversations_raw) WHERE s.id IS NOT NULL AND s.id <> ''")
def dedup_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations_raw").select("share_id", F.explode("reddit_sources").alias("s")).select("share_id", F.col("s.id").alias("source_id")).filter("source_id is not null and source_id <> ''").distinct()


@query("first_source", f"WITH latest AS ({_LATEST}) SELECT share_id AS conv_id, list_filter(list_transform(sources, lambda s: s.author), lambda x: x <> '')[1] AS author, list_filter(list_transform(sources, lambda s: s.subreddit), lambda x: x <> '')[1] AS subreddit, nullif(array_to_string(list_sort(list_distinct(list_filter(list_transform(sources, lambda s: s.subreddit), lambda x: x <> ''))), '|'), '') AS subreddits FROM latest")
def first_source(spark: SparkSession, d: str) -> DataFrame:
    return collect.first_source(pairs.latest_fetch(table(spark, d, "conversations_raw"), "messages", "reddit_sources"))


@query("hit_rate", f"WITH {_CLATEST} SELECT count(*) AS comments, sum(coalesce(len(share_urls), 0))::BIGINT AS links, round(100.0 * sum(coalesce(len(share_urls), 0)) / count(*), 6) AS hit_rate FROM c")
def hit_rate(spark: SparkSession, d: str) -> DataFrame:
    n = F.sum(F.coalesce(F.array_size("share_urls"), F.lit(0)))
    return collect.latest(table(spark, d, "reddit_comments")).agg(F.count("*").alias("comments"), n.alias("links"), F.round(100.0 * n / F.count("*"), 6).alias("hit_rate"))


@query("page_cursor", "SELECT min(created_utc) AS cursor FROM reddit_posts WHERE created_utc IS NOT NULL")
def page_cursor(spark: SparkSession, d: str) -> DataFrame:
    return collect.last_cursor(table(spark, d, "reddit_posts"))


# ---- merged table and statistics --------------------------------------------------------------------------------------


@query("merged_metrics", f"WITH {_MERGED} SELECT conv_id, turn, direction, topic, n_tokens_total, " + ", ".join(f"round({m}, 6) AS {m}" for m in METRICS) + " FROM merged")
def merged_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).select("conv_id", "turn", "direction", "topic", F.col("n_tokens_total").cast("bigint").alias("n_tokens_total"), *[_r(m) for m in METRICS])


@query("cross_check_join", f"WITH {_PAIR} SELECT count(*) AS pairs, count(*) FILTER (s.conv_id IS NOT NULL) AS matched, count(*) FILTER (s.user_cross_check_5 IS DISTINCT FROM substr(u, 1, 5)) AS guards_differ FROM pair p LEFT JOIN (SELECT conv_id, turn, min(user_cross_check_5) AS user_cross_check_5 FROM semantic_alignment GROUP BY ALL) s ON p.conv_id = s.conv_id AND p.turn = s.turn")
def cross_check_join(spark: SparkSession, d: str) -> DataFrame:
    sem = table(spark, d, "semantic_alignment").groupBy("conv_id", F.col("turn").cast("bigint").alias("turn")).agg(F.min("user_cross_check_5").alias("other"), F.lit(True).alias("there"))
    joined = _pairs(spark, d).join(sem, ["conv_id", "turn"], "left")
    return joined.agg(F.count("*").alias("pairs"), F.count("there").alias("matched"), F.count_if(~F.col("other").eqNullSafe(F.col("user_cross_check_5"))).alias("guards_differ"))


@query("length_p95_filter", f"WITH {_PAIR}, n AS (SELECT conv_id, count(*) AS n FROM pair GROUP BY 1), v AS (SELECT conv_id FROM n WHERE n >= 2 AND n <= (SELECT quantile_cont(n, 0.95) FROM n)) SELECT conv_id, turn FROM pair WHERE conv_id IN (SELECT conv_id FROM v)")
def length_p95_filter(spark: SparkSession, d: str) -> DataFrame:
    return stats.within_length(_pairs(spark, d).select("conv_id", "turn"))


@query("turn_support_filter", f"WITH {_PAIR}, s AS (SELECT abs(turn) AS t FROM pair GROUP BY 1 HAVING count(DISTINCT conv_id) >= 20) SELECT conv_id, turn, abs(turn) AS abs_turn FROM pair WHERE abs(turn) IN (SELECT t FROM s)")
def turn_support_filter(spark: SparkSession, d: str) -> DataFrame:
    return stats.supported(_pairs(spark, d).select("conv_id", "turn"), 20)


@query("zscore_metrics", f"WITH {_LONG}, s AS (SELECT metric, avg(value) AS m, stddev_samp(value) AS sd FROM long GROUP BY metric) SELECT conv_id, turn, metric, round(value, 6) AS value, round((value - m) / nullif(sd, 0), 5) AS z FROM long JOIN s USING (metric)")
def zscore_metrics(spark: SparkSession, d: str) -> DataFrame:
    return stats.standardised(stats.long_form(_merged(spark, d), ["conv_id", "turn"], METRICS)).select("conv_id", "turn", "metric", _r("value"), F.round("z", 5).alias("z"))


@query("metric_ranges", f"WITH {_LONG} SELECT metric, round(min(value), 6) AS min, round(max(value), 6) AS max, round(stddev_samp(value), 6) AS sd, round(max(value) - min(value), 6) AS range FROM long GROUP BY metric")
def metric_ranges(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return stats.long_form(_merged(spark, d), ["conv_id"], METRICS).groupBy("metric").agg(F.round(F.min(v), 6).alias("min"), F.round(F.max(v), 6).alias("max"), F.round(F.stddev_samp(v), 6).alias("sd"), F.round(F.max(v) - F.min(v), 6).alias("range"))


@query("metric_correlations", f"WITH {_MERGED} " + " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, count(*) FILTER ({x} IS NOT NULL AND {y} IS NOT NULL) AS n, round(corr({x}, {y}), 5) AS r FROM merged" for i, x in enumerate(METRICS) for y in METRICS[i + 1 :]))
def metric_correlations(spark: SparkSession, d: str) -> DataFrame:
    return stats.correlations(_merged(spark, d), METRICS).select("x", "y", "n", F.round("r", 5).alias("r"))


@query("correlation_p_values")
def correlation_p_values(spark: SparkSession, d: str) -> DataFrame:
    return stats.correlation_p_values(stats.correlations(_merged(spark, d), METRICS))


_MEANS = f"{_MERGED}, means AS (SELECT abs(turn) AS abs_turn, " + ", ".join(f"avg({m}) AS {m}" for m in METRICS) + " FROM merged GROUP BY 1)"


def _means(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).groupBy(F.abs("turn").alias("abs_turn")).agg(*[F.avg(m).alias(m) for m in METRICS])


@query("turn_means", f"WITH {_MEANS} SELECT abs_turn, " + ", ".join(f"round({m}, 6) AS {m}" for m in METRICS) + " FROM means")
def turn_means(spark: SparkSession, d: str) -> DataFrame:
    return _means(spark, d).select("abs_turn", *[_r(m) for m in METRICS])


_ROLL = f"{_MEANS}, lp AS (" + " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, abs_turn, CASE WHEN {y} IS NOT NULL THEN {x} END AS a, CASE WHEN {x} IS NOT NULL THEN {y} END AS b FROM means" for i, x in enumerate(METRICS) for y in METRICS[i + 1 :]) + """),
roll AS (SELECT x, y, abs_turn, CASE WHEN count(a) OVER w >= 3 THEN covar_pop(a, b) OVER w / nullif(stddev_pop(a) OVER w * stddev_pop(b) OVER w, 0) END AS r FROM lp WINDOW w AS (PARTITION BY x, y ORDER BY abs_turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""


@query("rolling_correlations", f"WITH {_ROLL} SELECT x, y, abs_turn, round(r, 4) AS r FROM roll")
def rolling_correlations(spark: SparkSession, d: str) -> DataFrame:
    return stats.rolling_correlations(_means(spark, d), METRICS).select("x", "y", "abs_turn", F.round("r", 4).alias("r"))


@query("rolling_corr_summary", f"WITH {_ROLL} SELECT x, y, round(avg(r), 4) AS mean_r, round(stddev_samp(r), 4) AS sd_r, round(min(r), 4) AS min_r, round(max(r), 4) AS max_r, round(avg((abs(r) > 0.3)::INT), 6) AS share_30, round(avg((abs(r) > 0.5)::INT), 6) AS share_50, CASE WHEN count(r) > 2 THEN round(regr_slope(r, abs_turn), 5) END AS slope FROM roll GROUP BY x, y")
def rolling_corr_summary(spark: SparkSession, d: str) -> DataFrame:
    s = stats.rolling_summary(stats.rolling_correlations(_means(spark, d), METRICS))
    places = {"share_30": 6, "share_50": 6, "slope": 5}
    return s.select("x", "y", *[F.round(c, places.get(c, 4)).alias(c) for c in s.columns[2:]])


@query("topic_counts", f"WITH {_MERGED} SELECT topic, count(*) AS n_turns, count(DISTINCT conv_id) AS n_convs, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM merged GROUP BY topic")
def topic_counts(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    n = _merged(spark, d).groupBy("topic").agg(F.count("*").alias("n_turns"), F.countDistinct("conv_id").alias("n_convs"))
    return n.withColumn("pct", F.round(100.0 * F.col("n_turns") / F.sum("n_turns").over(Window.partitionBy(F.lit(1))), 6))  # a row a topic


@query("model_family", f"WITH {_PAIR} SELECT CASE WHEN own_slug IS NULL THEN 'other' WHEN own_slug LIKE 'gpt-4%' THEN 'gpt-4' WHEN own_slug LIKE 'gpt-5%' THEN 'gpt-5' WHEN own_slug LIKE 'o%' THEN 'o-series' ELSE 'other' END AS family, count(*) AS n FROM pair WHERE role = 'assistant' GROUP BY 1")
def model_family(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).filter("turn > 0").groupBy(stats.model_family(F.col("model_slug")).alias("family")).agg(F.count("*").alias("n"))


@query("summary_stats", f"WITH {_MERGED}, n AS (SELECT conv_id, count(*) AS n, max(n_tokens_total) AS t FROM merged GROUP BY 1) SELECT count(*) AS conversations, sum(n)::BIGINT AS turns, round(median(n), 6) AS median_turns, round(median(t), 6) AS median_tokens, max(n) AS most_turns FROM n")
def summary_stats(spark: SparkSession, d: str) -> DataFrame:
    n = _merged(spark, d).groupBy("conv_id").agg(F.count("*").alias("n"), F.max("n_tokens_total").alias("t"))
    return n.agg(F.count("*").alias("conversations"), F.sum("n").alias("turns"), F.round(F.median("n"), 6).alias("median_turns"), F.round(F.median("t"), 6).alias("median_tokens"), F.max("n").alias("most_turns"))


@query("metric_diagnostics", f"WITH {_LONG} SELECT metric, count(value) AS n, count(DISTINCT round(value, 6)) AS n_values, round(covar_pop(abs(turn), value) / nullif(stddev_pop(CASE WHEN value IS NOT NULL THEN abs(turn) END) * stddev_pop(value), 0), 5) AS corr_turn FROM long GROUP BY metric")
def metric_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    long = stats.long_form(_merged(spark, d), ["turn"], METRICS)
    r = stats.pearson(F.abs("turn").cast("double"), F.col("value"))
    return long.groupBy("metric").agg(F.count("value").alias("n"), F.countDistinct(F.round("value", 6)).alias("n_values"), F.round(r, 5).alias("corr_turn"))


@query("pivot_topic_metric", f"WITH {_LONG} SELECT topic, " + ", ".join(f"round(avg(value) FILTER (metric = '{m}'), 6) AS {m}" for m in METRICS) + " FROM long GROUP BY topic")
def pivot_topic_metric(spark: SparkSession, d: str) -> DataFrame:
    p = stats.long_form(_merged(spark, d), ["topic"], METRICS).groupBy("topic").pivot("metric", METRICS).agg(F.avg("value"))
    return p.select("topic", *[_r(m) for m in METRICS])


# ---- posterior summaries on draws -------------------------------------------------------------------------------------

_DRAWS = "draws AS (SELECT 'm' || (vec_id % 4) AS metric, 't' || label AS topic, vec_id // 40 AS draw, embedding[1]::DOUBLE AS value FROM embeddings)"


def _draws(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.concat(F.lit("m"), F.col("vec_id") % 4).alias("metric"), F.concat(F.lit("t"), F.col("label")).alias("topic"), F.floor(F.col("vec_id") / 40).alias("draw"), F.col("embedding")[0].cast("double").alias("value"))


@query("posterior_intervals", f"WITH {_DRAWS} SELECT metric, topic, round(quantile_cont(value, 0.055), 6) AS lower, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.945), 6) AS upper, round(avg((value > 0)::INT), 6) AS p_pos, round(avg((value < 0)::INT), 6) AS p_neg FROM draws GROUP BY metric, topic")
def posterior_intervals(spark: SparkSession, d: str) -> DataFrame:
    return stats.intervals(_draws(spark, d), "metric", "topic").select("metric", "topic", *[_r(c) for c in ("lower", "median", "upper", "p_pos", "p_neg")])


@query("rank_probabilities", f"WITH {_DRAWS}, k AS (SELECT *, rank() OVER (PARTITION BY metric, draw ORDER BY value DESC) + (count(*) OVER (PARTITION BY metric, draw, value) - 1) / 2 AS rk FROM draws) SELECT metric, topic, round(avg((rk = 1)::INT), 6) AS p_first, round(avg((rk <= 3)::INT), 6) AS p_top FROM k GROUP BY metric, topic")
def rank_probabilities(spark: SparkSession, d: str) -> DataFrame:
    return stats.rank_probabilities(_draws(spark, d)).select("metric", "topic", _r("p_first"), _r("p_top"))


_MED = f"{_DRAWS}, med AS (SELECT metric, topic, round(median(value), 6) AS median FROM draws GROUP BY ALL)"


def _medians(spark: SparkSession, d: str) -> DataFrame:
    return _draws(spark, d).groupBy("metric", "topic").agg(F.round(F.median("value"), 6).alias("median"))


@query("top_with_ties", f"WITH {_MED} SELECT metric, topic, median FROM med QUALIFY rank() OVER (PARTITION BY metric ORDER BY median DESC) <= 5")
def top_with_ties(spark: SparkSession, d: str) -> DataFrame:
    return stats.top(_medians(spark, d), ["metric"], F.desc("median"), 5, ties=True)


@query("top_without_ties", f"WITH {_MED} SELECT metric, topic, median FROM med QUALIFY row_number() OVER (PARTITION BY metric ORDER BY abs(median) DESC, topic) <= 3")
def top_without_ties(spark: SparkSession, d: str) -> DataFrame:
    ranked = _medians(spark, d).withColumn("_o", F.struct(-F.abs("median"), "topic"))
    return stats.top(ranked, ["metric"], F.asc("_o"), 3, ties=False).drop("_o")


_MARG = f"{_LONG}, marg AS (SELECT metric, topic, direction, abs(turn) AS abs_turn, avg(value) AS estimate, stddev_samp(value) / sqrt(count(value)) AS std_error, count(DISTINCT conv_id) AS weight FROM long WHERE value IS NOT NULL GROUP BY ALL)"


def _marginal(spark: SparkSession, d: str, *by: str) -> DataFrame:
    """Estimates over every turn."""
    long = stats.long_form(_merged(spark, d).withColumn("abs_turn", F.abs("turn")), ["conv_id", "topic", "direction", "abs_turn"], METRICS).filter("value is not null")
    return long.groupBy(*by).agg(F.avg("value").alias("estimate"), (F.stddev_samp("value") / F.sqrt(F.count("value").cast("double"))).alias("std_error"), F.countDistinct("conv_id").alias("weight"))


@query("direction_contrast", f"{'WITH ' + _LONG}, g AS (SELECT metric, abs(turn) AS abs_turn, direction, avg(value) AS e, stddev_samp(value) / sqrt(count(value)) AS s FROM long WHERE value IS NOT NULL GROUP BY ALL) SELECT a.metric, a.abs_turn, round(a.e - b.e, 6) AS difference, round(sqrt(a.s * a.s + b.s * b.s), 6) AS std_error FROM g a JOIN g b ON a.metric = b.metric AND a.abs_turn = b.abs_turn AND a.direction = 'user→assistant' AND b.direction = 'assistant→user'")
def direction_contrast(spark: SparkSession, d: str) -> DataFrame:
    c = stats.contrast(_marginal(spark, d, "metric", "abs_turn", "direction"), ["metric", "abs_turn"], "user→assistant", "assistant→user")
    return c.select("metric", "abs_turn", _r("difference"), _r("std_error"))


@query("weighted_topic_means", f"WITH {_MARG} SELECT metric, direction, abs_turn, round(sum(weight * estimate) / nullif(sum(weight), 0), 6) AS estimate, round(sqrt(sum(weight * weight * std_error * std_error)) / nullif(sum(weight), 0), 6) AS std_error FROM marg GROUP BY metric, direction, abs_turn")
def weighted_topic_means(spark: SparkSession, d: str) -> DataFrame:
    m = stats.weighted_means(_marginal(spark, d, "metric", "topic", "direction", "abs_turn"), "metric", "direction", "abs_turn")
    return m.select("metric", "direction", "abs_turn", _r("estimate"), _r("std_error"))


def _standard(spark: SparkSession, d: str) -> DataFrame:
    long = stats.long_form(_merged(spark, d).filter("topic is not null"), ["conv_id", "topic"], METRICS).filter("value is not null")
    return checkpoint(stats.standardised(long).select("metric", "topic", "conv_id", F.col("z").alias("value")))


def _real_draws(rows: DataFrame) -> DataFrame:
    return models.gibbs(rows, chains=4, iterations=4000, warmup=1000)


@query("bayes_topic_effects")
def bayes_topic_effects(spark: SparkSession, d: str) -> DataFrame:
    return stats.intervals(_real_draws(_standard(spark, d)), "metric", "topic")


@query("bayes_convergence")
def bayes_convergence(spark: SparkSession, d: str) -> DataFrame:
    """Worst rhat and least effective sample size of each metric's parameters."""
    c = models.convergence(_real_draws(_standard(spark, d)))
    return c.groupBy("metric").agg(F.max("rhat").alias("max_rhat"), F.min("ess").alias("min_ess"))


@query("bayes_topic_table")
def bayes_topic_table(spark: SparkSession, d: str) -> DataFrame:
    rows = _standard(spark, d)
    return stats.topic_table(_real_draws(rows), rows.groupBy("topic").agg(F.countDistinct("conv_id").alias("n_convs")))


@query("posterior_predictive")
def posterior_predictive(spark: SparkSession, d: str) -> DataFrame:
    rows = _standard(spark, d)
    return models.predictive(models.gibbs(rows, chains=1, iterations=1100, warmup=1000), rows)


@query("turn_trajectories")
def turn_trajectories(spark: SparkSession, d: str) -> DataFrame:
    long = stats.long_form(_merged(spark, d).withColumn("abs_turn", F.abs("turn")), ["abs_turn"], METRICS)
    return models.smooth(long, "metric", "abs_turn", "value")


@query("topic_clusters")
def topic_clusters(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np

    p = pivot_topic_metric(spark, d).filter("topic is not null").limit(MOST_TOPICS + 1).toPandas()  # a row a topic
    if len(p) > MOST_TOPICS:
        raise ValueError(f"more than {MOST_TOPICS} topics: their distances don't fit the driver")
    p = p.dropna().sort_values("topic")
    x = p[METRICS].to_numpy(dtype=float)
    x = (x - x.mean(axis=0)) / np.where(x.std(axis=0, ddof=1) > 0, x.std(axis=0, ddof=1), 1.0) if len(x) > 1 else x
    return spark.createDataFrame([(t, int(c)) for t, c in zip(p["topic"], models.ward(x, 3))], "topic string, cluster int")


def _additive(spark: SparkSession, d: str) -> DataFrame:
    long = stats.standardised(stats.long_form(_merged(spark, d).withColumn("abs_turn", F.abs("turn")), ["topic", "direction", "abs_turn"], METRICS))
    plain = F.replace(F.col("direction"), F.lit("→"), F.lit("->"))
    return models.additive(long.select("metric", "topic", plain.alias("direction"), "abs_turn", F.col("z").alias("value")))


@query("additive_terms")
def additive_terms(spark: SparkSession, d: str) -> DataFrame:
    return _additive(spark, d).filter("kind = 'term'").select("metric", "topic", "direction", "estimate", "std_error")


@query("additive_grid")
def additive_grid(spark: SparkSession, d: str) -> DataFrame:
    g = _additive(spark, d).filter("kind = 'grid'").select("metric", "topic", "direction", "abs_turn", "estimate", "std_error", "shared")
    return g.withColumn("lower", F.col("estimate") - 1.96 * F.col("std_error")).withColumn("upper", F.col("estimate") + 1.96 * F.col("std_error"))


@query("cluster_trajectories")
def cluster_trajectories(spark: SparkSession, d: str) -> DataFrame:
    """Mean curves of topic clusters, weighted by conversations, with the topics of each cluster."""
    sizes = _merged(spark, d).groupBy("topic").agg(F.countDistinct("conv_id").alias("weight"))
    rows = models.clustered(additive_grid(spark, d), topic_clusters(spark, d), sizes)
    labels = rows.groupBy("cluster").agg(F.concat(F.lit("Cluster "), "cluster", F.lit(": "), F.array_join(F.array_sort(F.collect_set("topic")), ", ")).alias("label"))
    return stats.weighted_means(rows, "metric", "direction", "abs_turn", "cluster").join(labels, "cluster")


@query("event_windows", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
