"""Queries of the wide merged table, its summaries, look-ups and grids, each with the same query in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloqua.operators import anonymise, collect, languages, measures, merge, pairs, stats, structure
from colloqua.plans.analytics import _MEASURED, _MSG, _PAIR, _POS, _SEM, _SITE, _WS, _messages, _r, _semantic
from colloqua.session import checkpoint, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: The five measures of a pair, and the turns that a prediction grid covers.
FULL_METRICS = ["lexical_jaccard", "pos_jaccard", "lsm_score", "semantic_similarity", "sentiment_similarity"]
GRID_TURNS = 20


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


# ---- records ----------------------------------------------------------------------------------------------------------

_COMMENT = f"id, name, subreddit, author, created_utc, body, score, link_id, parent_id, CASE WHEN permalink <> '' THEN CASE WHEN starts_with(permalink, 'http') THEN permalink ELSE '{_SITE}' || permalink END END AS permalink"


def _comments(spark: SparkSession, d: str) -> DataFrame:
    return collect.normalised_comments(table(spark, d, "reddit_comments"), _SITE)


@query("normalised_comments", f"SELECT DISTINCT {_COMMENT} FROM reddit_comments")
def normalised_comments(spark: SparkSession, d: str) -> DataFrame:
    return _comments(spark, d).drop("share_urls", "source_post_id").distinct()


@query("comments_with_links", f"SELECT DISTINCT {_COMMENT}, array_to_string(share_urls, '|') AS links, source_post_id FROM reddit_comments WHERE len(share_urls) > 0")
def comments_with_links(spark: SparkSession, d: str) -> DataFrame:
    return collect.with_links(_comments(spark, d)).select("*", F.array_join("share_urls", "|").alias("links")).drop("share_urls").distinct()


@query("newest_posts", "SELECT id, created_utc FROM (SELECT DISTINCT id, created_utc FROM reddit_posts WHERE id IS NOT NULL) ORDER BY created_utc DESC NULLS LAST, id LIMIT 50")
def newest_posts(spark: SparkSession, d: str) -> DataFrame:
    """The listing's head: as many posts as asked for, newest first."""
    return table(spark, d, "reddit_posts").filter("id is not null").select("id", "created_utc").distinct().orderBy(F.desc_nulls_last("created_utc"), "id").limit(50)


@query("english_conversations", "SELECT DISTINCT share_id FROM conversations_raw WHERE fetch_success AND conversation_language = 'en'")
def english_conversations(spark: SparkSession, d: str) -> DataFrame:
    return languages.english(table(spark, d, "conversations_raw").filter("fetch_success")).select("share_id").distinct()


@query("conversation_language_guess", f"""WITH t AS (SELECT share_id, arg_max(messages, fetched_at) AS messages FROM conversations_raw WHERE fetch_success AND messages IS NOT NULL AND share_id IS NOT NULL GROUP BY share_id),
m AS (SELECT share_id, trim(coalesce(array_to_string(list_transform(list_filter(messages, lambda m: lower(trim(m.role)) IN ('user', 'assistant', 'human', 'bot') AND m.text IS NOT NULL), lambda m: m.text), ' '), ''), ' ') AS t FROM t),
w AS (SELECT share_id, length(t) AS n_chars, list_filter(string_split_regex(lower(t), '[^\\p{{L}}]+'), lambda x: x <> '') AS ws FROM m),
c AS (SELECT share_id, n_chars, {", ".join(f"len(list_filter(ws, lambda x: list_contains([{', '.join(chr(39) + w + chr(39) for w in ws.split())}], x))) AS {la}" for la, ws in languages.STOP_WORDS.items())} FROM w),
b AS (SELECT *, greatest({", ".join(languages.STOP_WORDS)}) AS best, {" + ".join(languages.STOP_WORDS)} AS total FROM c)
SELECT share_id, CASE WHEN n_chars < 20 OR total = 0 THEN 'unknown' {" ".join(f"WHEN {la} = best THEN '{la}'" for la in languages.STOP_WORDS)} END AS language, n_chars, round(CASE WHEN n_chars < 20 OR total = 0 THEN 0.0 ELSE best / total END, 6) AS confidence, CASE WHEN n_chars < 20 OR total = 0 THEN true ELSE n_chars < 100 OR best / total < 0.8 END AS low_confidence FROM b""")
def conversation_language_guess(spark: SparkSession, d: str) -> DataFrame:
    shares = pairs.latest_fetch(table(spark, d, "conversations_raw"), "messages")
    return languages.detected(shares).select("share_id", "language", F.col("n_chars").cast("bigint").alias("n_chars"), _r("confidence"), "low_confidence")


# ---- messages with metadata -------------------------------------------------------------------------------------------

_WIDE = """wide AS (SELECT share_id, arg_max({'m': messages, 'c': conversation_metadata, 'l': conversation_language, 's': reddit_sources, 'a': api_response}, fetched_at) AS r FROM conversations_raw WHERE fetch_success AND messages IS NOT NULL AND share_id IS NOT NULL GROUP BY share_id)"""
_ROLEM = "CASE lower(trim(m.role)) WHEN 'human' THEN 'user' WHEN 'bot' THEN 'assistant' ELSE lower(trim(m.role)) END"
_SUBS = "nullif(array_to_string(list_sort(list_distinct(list_filter(list_transform(r.s, lambda x: x.subreddit), lambda x: x <> ''))), '|'), '')"


def _wide(spark: SparkSession, d: str) -> DataFrame:
    return pairs.latest_fetch(table(spark, d, "conversations_raw"), "messages", "conversation_metadata", "conversation_language", "reddit_sources", "api_response")


@query("message_rows", f"""WITH {_WIDE}, v AS (SELECT share_id, r, CASE WHEN json_valid(r.a) THEN CASE WHEN json_type(r.a) = 'VARCHAR' THEN CASE WHEN json_valid(r.a::JSON ->> '$') THEN (r.a::JSON ->> '$')::JSON END ELSE r.a::JSON END END AS v FROM wide),
f AS (SELECT share_id, r, v, unnest(r.m) AS m, generate_subscripts(r.m, 1) - 1 AS pos FROM v),
t AS (SELECT *, CASE WHEN m.text IS NULL OR NOT regexp_matches(m.text, '[^{_WS}]') THEN nullif(array_to_string(list_filter(list_transform(list_filter(json_extract(json_extract(v, '$.mapping."' || m.node_id || '"'), '$.message.content.parts[*]'), lambda x: json_type(x) = 'VARCHAR'), lambda x: x ->> '$'), lambda x: regexp_matches(x, '[^{_WS}]')), ' '), '') ELSE m.text END AS text FROM f)
SELECT share_id AS conv_id, pos, m.backend_index AS backend_index, {_ROLEM} AS role, text, r.c.title AS title, r.c.create_time AS conversation_create_time, r.l AS conversation_language, {_SUBS} AS subreddits, coalesce(nullif(m.model_slug, ''), r.c.default_model_slug) AS model_slug FROM t WHERE {_ROLEM} IN ('user', 'assistant') AND text IS NOT NULL AND m.backend_index IS NOT NULL""")
def message_rows(spark: SparkSession, d: str) -> DataFrame:
    return pairs.message_rows(_wide(spark, d)).withColumn("pos", F.col("pos").cast("bigint"))


# ---- the whole merge --------------------------------------------------------------------------------------------------


def _merged_full(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with their conversation's metadata, left-joined with a table a measure, features and topics."""
    scored = measures.pos_jaccard(measures.measured(pairs.turn_pairs(_messages(spark, d))))
    scored = checkpoint(scored.drop("user_text", "assistant_text"))  # four tables are cut from it
    guards = ["conv_id", "turn", "user_cross_check_5", "assistant_cross_check_5"]
    base = scored.select(*guards, "direction", "model_slug", "n_tokens_total")
    lsm = scored.select(*guards, "direction", "lsm_score")
    sentiment = scored.select(*guards, "direction", "user_sentiment", "assistant_sentiment", "sentiment_similarity")
    lexsyn = scored.select("conv_id", "turn", "direction", "lexical_jaccard", "pos_jaccard")  # without guards, so joined on two keys
    shares = _wide(spark, d)
    about = collect.first_source(shares).select("conv_id", "author", "subreddit")
    meta = F.col("conversation_metadata")
    told = shares.select(F.col("share_id").alias("conv_id"), meta["title"].alias("title"), meta["has_custom_instructions"].alias("has_custom_instructions"), F.nullif(F.array_join(F.array_sort(meta["tools_used"]), "|"), F.lit("")).alias("tools_used"))
    struct = structure.features(_messages(spark, d))
    struct = struct.select("conv_id", *[F.col(c).alias(f"struct_{c}") for c in ("total_turns", "user_turns", "assistant_turns", "total_conversation_length")])
    topics = about.select("conv_id", F.col("subreddit").alias("topic"), F.col("author").alias("author"))
    out = base.join(told, "conv_id", "left").join(about, "conv_id", "left").join(struct, "conv_id", "left")
    return merge.merged(out, {"lsm": lsm, "sentiment": sentiment, "semantic": _semantic(spark, d), "lexsyn": lexsyn}, topics)


_FULL = f"""{_MEASURED}, {_POS}, {_SEM}, {_WIDE},
about AS (SELECT share_id AS conv_id, r.c.title AS title, r.c.has_custom_instructions AS has_custom_instructions, nullif(array_to_string(list_sort(r.c.tools_used), '|'), '') AS tools_used, list_filter(list_transform(r.s, lambda s: s.author), lambda x: x <> '')[1] AS author, list_filter(list_transform(r.s, lambda s: s.subreddit), lambda x: x <> '')[1] AS subreddit FROM wide),
st AS (SELECT conv_id, count(*) AS struct_total_turns, count(*) FILTER (role = 'user') AS struct_user_turns, count(*) FILTER (role = 'assistant') AS struct_assistant_turns, sum(coalesce(length(text), 0))::BIGINT AS struct_total_conversation_length FROM msg GROUP BY 1),
slug AS (SELECT conv_id, pos, model_slug FROM msg),
mfull AS (SELECT m.conv_id, m.turn, m.direction, abs(m.turn) AS abs_turn, m.n_tokens_total, g.model_slug, a.title, a.has_custom_instructions, a.tools_used, a.author, a.subreddit, a.subreddit AS topic, st.* EXCLUDE (conv_id), m.lsm_score, m.lexical_jaccard, m.user_sentiment, m.assistant_sentiment, m.sentiment_similarity, s.semantic_similarity, p.pos_jaccard
  FROM measured m JOIN pair q ON q.conv_id = m.conv_id AND q.turn = m.turn LEFT JOIN slug g ON g.conv_id = q.conv_id AND g.pos = q.apos LEFT JOIN posj p ON p.conv_id = m.conv_id AND p.turn = m.turn
  LEFT JOIN sem s ON m.conv_id = s.conv_id AND m.turn = s.turn AND m.ucheck IS NOT DISTINCT FROM s.uc AND m.acheck IS NOT DISTINCT FROM s.ac LEFT JOIN about a ON a.conv_id = m.conv_id LEFT JOIN st ON st.conv_id = m.conv_id)"""
_FAMILY = "CASE WHEN model_slug IS NULL THEN 'other' WHEN model_slug LIKE 'gpt-4%' THEN 'gpt-4' WHEN model_slug LIKE 'gpt-5%' THEN 'gpt-5' WHEN model_slug LIKE 'o%' THEN 'o-series' ELSE 'other' END"
_KEPT = ["conv_id", "turn", "direction", "n_tokens_total", "model_slug", "title", "has_custom_instructions", "tools_used", "author", "subreddit", "topic", "struct_total_turns", "struct_user_turns", "struct_assistant_turns", "struct_total_conversation_length", "user_sentiment", "assistant_sentiment"]


@query("merged_full", f"WITH {_FULL} SELECT {', '.join(_KEPT[:-2])}, round(user_sentiment, 6) AS user_sentiment, round(assistant_sentiment, 6) AS assistant_sentiment, " + ", ".join(f"round({m}, 6) AS {m}" for m in FULL_METRICS) + " FROM mfull")
def merged_full(spark: SparkSession, d: str) -> DataFrame:
    m = _merged_full(spark, d)
    return m.withColumn("n_tokens_total", F.col("n_tokens_total").cast("bigint")).select(*_KEPT[:-2], *[_r(c) for c in (*_KEPT[-2:], *FULL_METRICS)])


_COMPLETE = " AND ".join(f"{m} IS NOT NULL" for m in FULL_METRICS) + " AND topic IS NOT NULL"


def _complete(spark: SparkSession, d: str) -> DataFrame:
    m = _merged_full(spark, d).na.drop(subset=[*FULL_METRICS, "topic", "direction", "turn", "conv_id"])
    return m.withColumns({"abs_turn": F.abs("turn"), "family": stats.model_family(F.col("model_slug"))})


@query("complete_rows", f"WITH {_FULL} SELECT count(*) AS n, count(DISTINCT conv_id) AS n_convs FROM mfull WHERE {_COMPLETE}")
def complete_rows(spark: SparkSession, d: str) -> DataFrame:
    return _complete(spark, d).agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("n_convs"))


@query("finite_metrics", f"WITH {_FULL} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, count(*) FILTER (isfinite({m})) AS n FROM mfull" for m in FULL_METRICS))
def finite_metrics(spark: SparkSession, d: str) -> DataFrame:
    long = stats.long_form(_merged_full(spark, d), ["conv_id"], FULL_METRICS)
    return long.groupBy("metric").agg(F.count_if(stats.finite(F.col("value"))).alias("n"))


# ---- summaries --------------------------------------------------------------------------------------------------------

_CLEAN = f"{_FULL}, clean AS (SELECT *, {_FAMILY} AS family FROM mfull WHERE {_COMPLETE})"
_FILTERED = f"""{_CLEAN}, nconv AS (SELECT conv_id, count(*) AS n FROM clean GROUP BY 1), q AS (SELECT quantile_cont(n, 0.95) AS top FROM nconv), valid AS (SELECT conv_id FROM nconv, q WHERE n >= 2 AND n <= top),
lenf AS (SELECT * FROM clean WHERE conv_id IN (SELECT conv_id FROM valid)), tt AS (SELECT abs_turn, count(DISTINCT conv_id) AS n FROM lenf GROUP BY 1), filt AS (SELECT * FROM lenf WHERE abs_turn IN (SELECT abs_turn FROM tt WHERE n >= 200))"""


def _fmt_sql(x: str) -> str:
    return f"regexp_replace(format('{{:,.2f}}', ({x})::DOUBLE), '\\.?0+$', '')"


def _pct_sql(x: str) -> str:
    return f"printf('%.1f%%', round(100.0 * ({x}), 1))"


_FLAGS = "flags AS (SELECT conv_id, coalesce(bool_or(has_custom_instructions), false) AS has_custom_instructions, bool_or(coalesce(trim(tools_used) NOT IN ('', '[]', 'na', 'null'), false)) AS has_tools, arg_min(family, abs_turn * 2 + (turn < 0)::INT) AS family FROM filt GROUP BY conv_id)"


def _filtered(clean: DataFrame) -> DataFrame:
    return stats.supported(stats.within_length(clean), 200)


def _flags(filtered: DataFrame) -> DataFrame:
    order = F.col("abs_turn") * 2 + (F.col("turn") < 0).cast("int")
    return filtered.groupBy("conv_id").agg(F.bool_or(stats.flag(F.col("has_custom_instructions"))).alias("has_custom_instructions"), F.bool_or(stats.tools_flag(F.col("tools_used"))).alias("has_tools"), F.min_by("family", order).alias("family"))


@query("conversation_flags", f"WITH {_FILTERED}, {_FLAGS} SELECT * FROM flags")
def conversation_flags(spark: SparkSession, d: str) -> DataFrame:
    return _flags(_filtered(_complete(spark, d)))


_ROWS = (
    ("Raw conversations (retrieved)", "n", "(SELECT count(*) FROM conversations_raw)"), ("Merged rows (raw)", "n", "(SELECT count(*) FROM mfull)"), ("Merged conversations (raw)", "n", "(SELECT count(DISTINCT conv_id) FROM mfull)"),
    ("Filtered rows", "n", "(SELECT count(*) FROM filt)"), ("Filtered conversations", "n", "(SELECT count(DISTINCT conv_id) FROM filt)"), ("Convs excluded (<2 turns)", "n", "(SELECT count(*) FROM nconv WHERE n < 2)"),
    ("Convs excluded (>95th percentile length)", "n", "(SELECT count(*) FROM nconv, q WHERE n > top)"), ("Convs retained after length filter", "n", "(SELECT count(*) FROM valid)"), ("95th percentile length (turns)", "n", "(SELECT top FROM q)"),
    ("Turn positions retained (>=200 convs)", "n", "(SELECT count(*) FROM tt WHERE n >= 200)"), ("Turn positions excluded (<200 convs)", "n", "(SELECT count(*) FROM tt WHERE n < 200)"),
    ("Median turns per conversation (filtered)", "n", "(SELECT median(n) FROM (SELECT count(*) AS n FROM filt GROUP BY conv_id))"), ("Median tokens per turn (filtered)", "n", "(SELECT median(n_tokens_total) FROM filt)"),
    ("Custom instructions (% convs, filtered)", "p", "(SELECT avg(has_custom_instructions::INT) FROM flags)"), ("Custom GPT used (% convs, filtered)", "p", "0.0"), ("Reasoning present (% convs, filtered)", "p", "0.0"), ("Tools used (% convs, filtered)", "p", "(SELECT avg(has_tools::INT) FROM flags)"),
    *((f"Model family = {f} (% convs, filtered)", "p", f"(SELECT avg((family = '{f}')::INT) FROM flags)") for f in ("gpt-4", "gpt-5", "o-series", "other")),
)


@query("summary_table", f"WITH {_FILTERED}, {_FLAGS} " + " UNION ALL ".join(f"SELECT {i} AS ord, '{n}' AS metric, coalesce({_fmt_sql(x) if k == 'n' else _pct_sql(x)}, 'NA') AS value" for i, (n, k, x) in enumerate(_ROWS)))
def summary_table(spark: SparkSession, d: str) -> DataFrame:
    """The 21 rows of the summary; custom assistants and reasoning have no field in these tables and count as absent."""
    merged = _merged_full(spark, d).select("conv_id", "turn", F.abs("turn").alias("abs_turn"), "n_tokens_total", "has_custom_instructions", "tools_used", "model_slug", "topic", "direction", *FULL_METRICS)
    clean = merged.na.drop(subset=[*FULL_METRICS, "topic"]).withColumn("family", stats.model_family(F.col("model_slug")))
    lengths = clean.groupBy("conv_id").agg(F.count("*").alias("n"))
    top = F.broadcast(lengths.agg(F.percentile("n", F.lit(0.95)).alias("top")))  # one row
    sized = lengths.crossJoin(top)
    kept = stats.within_length(clean)
    support = kept.groupBy("abs_turn").agg(F.countDistinct("conv_id").alias("n"))
    filtered, n, share = _filtered(clean), stats.fmt_n, stats.fmt_pct
    flags = _flags(filtered)
    parts = [
        table(spark, d, "conversations_raw").agg(n(F.count("*")).alias("v0")),
        merged.agg(n(F.count("*")).alias("v1"), n(F.countDistinct("conv_id")).alias("v2")),
        filtered.agg(n(F.count("*")).alias("v3"), n(F.countDistinct("conv_id")).alias("v4"), n(F.median("n_tokens_total")).alias("v12")),
        sized.agg(n(F.count_if(F.col("n") < 2)).alias("v5"), n(F.count_if(F.col("n") > F.col("top"))).alias("v6"), n(F.count_if((F.col("n") >= 2) & (F.col("n") <= F.col("top")))).alias("v7"), n(F.max("top")).alias("v8")),
        support.agg(n(F.count_if(F.col("n") >= 200)).alias("v9"), n(F.count_if(F.col("n") < 200)).alias("v10")),
        filtered.groupBy("conv_id").agg(F.count("*").alias("n")).agg(n(F.median("n")).alias("v11")),
        flags.agg(share(F.avg(F.col("has_custom_instructions").cast("int"))).alias("v13"), share(F.lit(0.0)).alias("v14"), share(F.lit(0.0)).alias("v15"), share(F.avg(F.col("has_tools").cast("int"))).alias("v16"), *[share(F.avg((F.col("family") == f).cast("int"))).alias(f"v{17 + i}") for i, f in enumerate(("gpt-4", "gpt-5", "o-series", "other"))]),
    ]
    one = parts[0]
    for p in parts[1:]:
        one = one.crossJoin(F.broadcast(p))  # one row each
    return one.select(F.inline(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(name).alias("metric"), F.coalesce(f"v{i}", F.lit("NA")).alias("value")) for i, (name, _, _) in enumerate(_ROWS)])))


@query("direction_shares", f"WITH {_CLEAN} SELECT direction, {_fmt_sql('count(*)')} AS rows, {_pct_sql('count(*) / sum(count(*)) OVER ()')} AS percent FROM clean GROUP BY direction")
def direction_shares(spark: SparkSession, d: str) -> DataFrame:
    n = _complete(spark, d).groupBy("direction").agg(F.count("*").alias("n"))
    return n.select("direction", stats.fmt_n(F.col("n")).alias("rows"), stats.fmt_pct(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("percent"))  # two rows


@query("top_topics", f"WITH {_CLEAN} SELECT topic, {_fmt_sql('count(*)')} AS rows, {_pct_sql('count(*) / sum(count(*)) OVER ()')} AS percent FROM clean GROUP BY topic QUALIFY row_number() OVER (ORDER BY count(*) DESC, topic) <= 10")
def top_topics(spark: SparkSession, d: str) -> DataFrame:
    n = _complete(spark, d).groupBy("topic").agg(F.count("*").alias("n"))
    shares = n.withColumn("percent", stats.fmt_pct(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))))  # a row a topic
    return shares.orderBy(F.desc("n"), "topic").limit(10).select("topic", stats.fmt_n(F.col("n")).alias("rows"), "percent")


@query("widest_topics", f"WITH {_CLEAN} SELECT topic, count(DISTINCT conv_id) AS n_convs FROM clean GROUP BY topic ORDER BY n_convs DESC, topic LIMIT 20")
def widest_topics(spark: SparkSession, d: str) -> DataFrame:
    return _complete(spark, d).groupBy("topic").agg(F.countDistinct("conv_id").alias("n_convs")).orderBy(F.desc("n_convs"), "topic").limit(20)


@query("topic_labels", f"WITH {_CLEAN}, l AS (SELECT topic, min(replace(topic, '_', ' / ')) AS keywords, count(DISTINCT conv_id) AS n FROM clean GROUP BY topic), x AS (SELECT topic, array_to_string(string_split(keywords, ' / ')[1:2], ', ') || ' (n=' || n || ')' AS label FROM l) SELECT c.topic, x.label, count(*) AS n FROM clean c LEFT JOIN x ON c.topic = x.topic GROUP BY ALL")
def topic_labels(spark: SparkSession, d: str) -> DataFrame:
    """Rows a topic under its label: the first two keywords and the number of conversations."""
    m = _complete(spark, d).withColumn("keywords", F.replace(F.col("topic"), F.lit("_"), F.lit(" / ")))
    labels = stats.topic_labels(m, "topic", "keywords")
    return m.join(labels, "topic", "left").groupBy("topic", "label").agg(F.count("*").alias("n"))


@query("model_slugs", f"WITH {_PAIR}, g AS (SELECT own_slug AS model_slug FROM pair WHERE role = 'assistant') SELECT {_FAMILY} AS family, {_FAMILY} || ' (' || string_agg(DISTINCT model_slug, ', ' ORDER BY model_slug) || ')' AS label FROM g WHERE model_slug IS NOT NULL GROUP BY family")
def model_slugs(spark: SparkSession, d: str) -> DataFrame:
    p = pairs.turn_pairs(_messages(spark, d)).filter("turn > 0 and model_slug is not null").withColumn("family", stats.model_family(F.col("model_slug")))
    return p.groupBy("family").agg(F.array_join(F.array_sort(F.collect_set("model_slug")), ", ").alias("s")).select("family", F.concat("family", F.lit(" ("), "s", F.lit(")")).alias("label"))


_EST = f"{_CLEAN}, lng AS (" + " UNION ALL ".join(f"SELECT topic, family, direction, abs_turn, '{m}' AS metric, {m} AS value FROM clean" for m in FULL_METRICS) + "), est AS (SELECT metric, topic, family, direction, abs_turn, avg(value) AS e, stddev_samp(value) / sqrt(count(*)) AS s FROM lng GROUP BY ALL)"


def _estimates(spark: SparkSession, d: str) -> DataFrame:
    long = stats.long_form(_complete(spark, d), ["topic", "family", "direction", "abs_turn"], FULL_METRICS)
    return long.groupBy("metric", "topic", "family", "direction", "abs_turn").agg(F.avg("value").alias("estimate"), (F.stddev_samp("value") / F.sqrt(F.count("*").cast("double"))).alias("std_error"))


@query("marginal_means", f"WITH {_EST} SELECT metric, family, direction, round(avg(e), 6) AS estimate, round(sqrt(avg(s * s)), 6) AS std_error FROM est GROUP BY metric, family, direction")
def marginal_means(spark: SparkSession, d: str) -> DataFrame:
    return stats.marginal_means(_estimates(spark, d), "metric", "family", "direction").select("metric", "family", "direction", _r("estimate"), _r("std_error"))


@query("early_turn_means", f"WITH {_EST}, a AS (SELECT metric, topic, abs_turn, avg(e) AS e FROM est GROUP BY ALL) SELECT metric, topic, round(avg(e), 6) AS early FROM a WHERE abs_turn BETWEEN 1 AND 3 GROUP BY metric, topic")
def early_turn_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean over directions, then over the first three turns, by which topics are put in order."""
    by_turn = _estimates(spark, d).groupBy("metric", "topic", "abs_turn").agg(F.avg("estimate").alias("e"))
    return by_turn.filter("abs_turn between 1 and 3").groupBy("metric", "topic").agg(F.round(F.avg("e"), 6).alias("early"))


@query("prediction_grid", f"WITH {_CLEAN}, t AS (SELECT DISTINCT topic FROM clean), r AS (SELECT DISTINCT direction FROM clean), n AS (SELECT unnest(range(1, {GRID_TURNS + 1})) AS abs_turn), o AS (SELECT topic, direction, abs_turn, count(*) AS n FROM clean GROUP BY ALL) SELECT t.topic, r.direction, n.abs_turn, coalesce(o.n, 0) AS n FROM t CROSS JOIN r CROSS JOIN n LEFT JOIN o ON o.topic = t.topic AND o.direction = r.direction AND o.abs_turn = n.abs_turn")
def prediction_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every topic, direction and turn of the grid, with the rows behind it."""
    m = _complete(spark, d)
    grid = stats.grid(m, ["topic", "direction"], "abs_turn", GRID_TURNS)
    seen = m.groupBy("topic", "direction", "abs_turn").agg(F.count("*").alias("n"))
    return grid.join(seen, ["topic", "direction", "abs_turn"], "left").select("topic", "direction", "abs_turn", F.coalesce("n", F.lit(0)).alias("n"))


# ---- look-ups by message ----------------------------------------------------------------------------------------------

_SLOTS = 64
_HASHED = f"(('0x' || substr(md5(w), 1, 8))::UBIGINT % {_SLOTS})"


@query("hashed_similarity", f"""WITH {_PAIR}, u AS (SELECT conv_id || '_' || upos || '_user' AS uid, conv_id || '_' || apos || '_assistant' AS aid, conv_id, turn, u, a FROM pair), ms AS (SELECT uid AS id, max(u) AS t FROM u GROUP BY 1 UNION SELECT aid, max(a) FROM u GROUP BY 1),
w AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(t), '[{_WS}]+'), lambda x: x <> '')) AS w FROM ms), c AS (SELECT id, {_HASHED} AS k, count(*)::DOUBLE AS n FROM w GROUP BY ALL), nn AS (SELECT id, sqrt(sum(n * n)) AS norm FROM c GROUP BY id),
dot AS (SELECT u.conv_id, u.turn, sum(x.n * y.n) AS d FROM u JOIN c x ON x.id = u.uid JOIN c y ON y.id = u.aid AND y.k = x.k GROUP BY ALL)
SELECT u.conv_id, u.turn, round(coalesce(d, 0.0) / (p.norm * q.norm), 5) AS similarity FROM u LEFT JOIN dot ON dot.conv_id = u.conv_id AND dot.turn = u.turn JOIN nn p ON p.id = u.uid JOIN nn q ON q.id = u.aid""")
def hashed_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Unique messages embedded once, looked up from both sides of each pair."""
    p = pairs.turn_pairs(_messages(spark, d))
    vectors = measures.embedded(measures.unique_messages(p))
    both = measures.looked_up(p.select("conv_id", "turn", "user_message_id", "assistant_message_id"), vectors, "embedding")
    return both.select("conv_id", "turn", F.round(measures.cosine(F.col("user_embedding"), F.col("assistant_embedding")), 5).alias("similarity"))


@query("cross_checks_filled", f"WITH {_MSG}, m AS (SELECT conv_id || '_' || pos || '_' || role AS message_id, text FROM msg), s AS (SELECT DISTINCT conv_id, turn, user_message_id, assistant_message_id, CASE WHEN abs(turn) % 2 = 1 THEN user_cross_check_5 END AS uc FROM semantic_alignment) SELECT s.conv_id, s.turn::BIGINT AS turn, coalesce(s.uc, substr(u.text, 1, 5), '') AS user_cross_check_5, coalesce(substr(a.text, 1, 5), '') AS assistant_cross_check_5 FROM s LEFT JOIN m u ON u.message_id = s.user_message_id LEFT JOIN m a ON a.message_id = s.assistant_message_id")
def cross_checks_filled(spark: SparkSession, d: str) -> DataFrame:
    """Cross-checks taken off every other turn and all assistant sides, then filled from the messages."""
    messages = _messages(spark, d).select("message_id", "text")
    bare = table(spark, d, "semantic_alignment").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "user_message_id", "assistant_message_id", F.when(F.abs("turn") % 2 == 1, F.col("user_cross_check_5")).alias("user_cross_check_5"), F.lit(None).cast("string").alias("assistant_cross_check_5")).distinct()
    return measures.with_cross_checks(bare, messages).select("conv_id", "turn", "user_cross_check_5", "assistant_cross_check_5")


# ---- anonymisation ----------------------------------------------------------------------------------------------------


@query("entity_spans", " UNION ALL ".join(f"SELECT '{n}' AS entity, message_id, s AS span FROM (SELECT DISTINCT message_id, unnest(regexp_extract_all(text, '{p}')) AS s FROM conversations) WHERE regexp_matches(s, '[^0-9]')" for n, p, _ in anonymise.ENTITIES))
def entity_spans(spark: SparkSession, d: str) -> DataFrame:
    """Every high-risk mention of a message once, by kind; an address of digits alone is none."""
    return anonymise.spans(table(spark, d, "conversations"), "message_id", "text").distinct()


@query("anonymised_messages")
def anonymised_messages(spark: SparkSession, d: str) -> DataFrame:
    shares = anonymise.anonymised_messages(pairs.latest_fetch(table(spark, d, "conversations_raw"), "messages"))
    return pairs.explode_messages(shares).select("conv_id", "pos", "role", "text")
