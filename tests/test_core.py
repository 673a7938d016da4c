"""Core operators: against DuckDB on the smallest tables, against Python's regex and on edge cases."""

import json
import os

import pyarrow.parquet as pq
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare, views
from pyspark.sql import functions as F

import __spark_entry__
from colloqua.functions import text as T
from colloqua.operators import anonymise, collect, measures, merge, models, nested, pairs, stats, structure
from colloqua.operators.models import ward
from colloqua.plans import analytics, records
from colloqua.sources import files, paged
from colloqua.streaming import ingest

SF = "/root/testdata/sf0.001"
ORACLE = ("payload_messages", "payload_features", "message_rows", "conversation_language_guess", "entity_spans", "hashed_similarity", "merged_full", "summary_table", "turn_pairs", "turn_pairs_lsm", "lexical_jaccard", "structural_features", "share_targets", "merged_metrics", "rolling_correlations", "rank_probabilities", "redact", "strip_tables")


@pytest.mark.parametrize("name", ORACLE)
def test_same_as_sql(spark, name):
    assert compare(__spark_entry__.queries()[name](spark, SF), views(SF), __spark_entry__.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", ["direction_contrast", "weighted_topic_means"])
def test_marginals_hold_every_turn(spark, name):
    df = __spark_entry__.queries()[name](spark, SF)
    assert df.filter("abs_turn > 5").count() > 0 and compare(df, views(SF), __spark_entry__.oracle_sql()[name]) is None


def _messages(spark, rows):
    return spark.createDataFrame([("c", i, f"c_{i}", r, t, None) for i, (r, t) in enumerate(rows)], "conv_id string, pos bigint, message_id string, role string, text string, model_slug string")


@pytest.mark.parametrize("rows,turns", [
    ([("user", "a"), ("assistant", "b"), ("assistant", "c"), ("user", "d"), ("assistant", "e")], [1, -1, 2]),
    ([("user", "a"), ("system", "s"), ("assistant", "b")], [1]),
    ([("assistant", "a"), ("user", "b")], [-1]),
    ([("user", "a"), ("assistant", "  "), ("assistant", None)], []),
])
def test_turn_pairs(spark, rows, turns):
    assert sorted(r["turn"] for r in pairs.turn_pairs(_messages(spark, rows)).collect()) == sorted(turns)


def _one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text,out", [("_foo_", "_foo_"), ("_foo!_", "foo!"), ("__init__", "__init__"), ("__two words__", "two words"), ("a\n\nb", "ab"), ("====a---b~~~~~", "a---b"), (None, None), ("", "")])
def test_clean(spark, text, out):
    assert _one(spark, text, T.clean_markdown) == out


@pytest.mark.parametrize("block,kind", [("``````", "DATA_DUMP"), ("```\nmodel x\n```", "FORMAL_SPEC"), ("```py\ndef f():\n```", "CODE_BLOCK"), ("```\n{};\n```", "CODE_BLOCK"), ("```\nplain log\n```", "DATA_DUMP")])
def test_blocks(spark, block, kind):
    assert f"[{kind}" in _one(spark, f"x {block} y", T.replace_blocks)


def test_steps_equal_python(spark):
    texts = ["# h\n**b** *i* ~~s~~ [l](u) `c` http://x.y/z\n- a\n1. b\n> q\n---\n| a | b |\n<b>t</b> ====== x", "é — “q”​  two   spaces\n\n\n\nend", "a*b*c __x y__ _z!_ ____"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for name, pattern, to in T.STEPS:
        flags = regex.M if "m" in pattern[:7] and pattern.startswith("(?") and ")" in pattern[:7] else 0
        plain = regex.sub(r"^\(\?[a-zA-Z]+\)", "", pattern)
        got = {r["i"]: r["y"] for r in df.select("i", T.step(F.col("t"), name).alias("y")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == regex.sub(plain, to.replace("$1", r"\1"), t, flags=flags), name


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.text("ab c'", max_size=12), st.text("ab c'", max_size=12)), min_size=1, max_size=5))
def test_measures_properties(spark, texts):
    df = spark.createDataFrame(texts, "u string, a string")
    p = lambda c: T.proportions(T.tokens(F.col(c)))
    for r in df.select(measures.lsm(p("u"), p("a")).alias("x"), measures.lsm(p("a"), p("u")).alias("y"), measures.jaccard(T.words(F.col("u")), T.words(F.col("a"))).alias("j")).collect():
        assert 0 < r["x"] <= 1 and abs(r["x"] - r["y"]) < 1e-12 and (r["j"] is None or 0 <= r["j"] <= 1)


def test_documents_are_whole(spark):
    long = "word " * 5_000 + "end"
    got = structure.documents_of(_messages(spark, [("user", long), ("assistant", long), ("user", "[1]")])).first()
    assert got["user_doc"] == got["assistant_doc"] == long and got["combined_doc"] == f"{long}\n{long}"
    assert len(structure.documents_of(_messages(spark, [("user", long), ("assistant", long)]), 100).first()["combined_doc"]) == 100


def test_links_and_ids(spark):
    got = _one(spark, "see chat.example/share/x1 and HTTPS://chat.example/share/y http://www.chat.example/share/z", lambda c: collect.share_urls(c, ("chat.example",)))
    assert got == ["https://chat.example/share/x1", "https://HTTPS://chat.example/share/y", "http://www.chat.example/share/z"]
    assert _one(spark, "https://chat.example/share/abc/def", collect.share_id) == "abc" and _one(spark, "::", collect.share_id) is None


def test_merge_is_null_safe(spark):
    base = spark.createDataFrame([("c", 1, None, "a")], "conv_id string, turn int, user_cross_check_5 string, assistant_cross_check_5 string")
    out = merge.merged(base, {"lsm": base.withColumn("lsm_score", F.lit(0.5))})
    assert out.first()["lsm_score"] == 0.5


def _share(payload, sources=None):
    return ("s", sources, None, payload)


_RAW = "share_id string, reddit_sources array<struct<name:string>>, conversation_metadata struct<moderation_results:array<struct<id:string>>,tools_used:array<string>>, api_response string, messages string"


def test_nested_links_edges(spark):
    node = {"id": "n1", "parent": None, "message": {"content": {"parts": ["a", None, {"x": 1}], "thoughts": None}, "metadata": {"attachments": {"id": "f"}, "citations": [None, {}]}}}
    body = json.dumps({"mapping": {"n1": node, "n2": {"parent": "n1", "message": None}, "n3": {"parent": "gone"}}})
    rows = [_share(body, [("t3_a",), (None,), ("t3_a",)]), _share(json.dumps(body)), _share(body[:-9]), _share(None), _share("[1]"), _share('{"mapping": 3}'), (None, None, None, None)]
    got = {tuple(r) for r in nested.parent_child_links(spark.createDataFrame([(*r, "clash") for r in rows], _RAW)).collect()}
    assert got == {("s", k, p, c) for k, p, c in [("source", "s", "t3_a"), ("node", "s", "n1"), ("node", "s", "n2"), ("node", "s", "n3"), ("edge", "n1", "n2"), ("part", "n1", "0"), ("part", "n1", "2"), ("citation", "n1", "1"), ("attachment", "n1", "f")]}
    assert nested.parent_child_links(spark.createDataFrame([], _RAW)).count() == 0


def _flat_by_hand(path):
    """Rows of the flat tables by plain Python: keys, and the columns that the tables took on last."""
    out = {n: set() for n in records.FLAT}
    for r in pq.read_table(path).to_pylist():
        s, meta = r["share_id"], r["conversation_metadata"] or {}
        seen, model = meta.get("visibility_summary") or {}, meta.get("model") or {}
        out["shares"].add((s, r["fetched_at"], meta.get("title"), model.get("slug"), meta.get("create_time"), meta.get("tool_call_count"), meta.get("file_count"), seen.get("hidden_messages")))
        out["sources"] |= {(s, x["name"], x["author"], x["title"]) for x in r["reddit_sources"] or ()}
        out["moderation"] |= {(s, x["id"], x["category"], x["score"]) for x in meta.get("moderation_results") or ()}
        out["tools"] |= {(s, x) for x in meta.get("tools_used") or ()}
        for n, k in (("safe_urls", "safe_urls"), ("file_types", "file_types")):
            out[n] |= {(s, i, x) for i, x in enumerate(meta.get(k) or ())}
        for i, m in enumerate(r["messages"] or ()):
            out["messages"].add((s, r["fetched_at"], i, m["node_id"], m["role"], m["text"], m["status"]))
            out["message_children"] |= {(s, r["fetched_at"], i, j, x) for j, x in enumerate(m["children"] or ())}
        try:
            body = json.loads(r["api_response"])
            body = json.loads(body) if isinstance(body, str) else body
        except (TypeError, ValueError):
            continue
        out["payloads"].add((s, body.get("title"), body.get("current_node")))
        out["payload_safe_urls"] |= {(s, i, x) for i, x in enumerate(body.get("safe_urls") or ())}
        for k, n in (body.get("mapping") or {}).items():
            m = n.get("message") or {}
            about, said = m.get("metadata") or {}, m.get("content") or {}
            result = about.get("aggregate_result") or {}
            out["nodes"].add((s, k, n.get("parent"), (m.get("author") or {}).get("name"), m.get("create_time"), m.get("status"), result.get("status")))
            files = about.get("attachments") or ()
            for name, xs, of in (
                ("parts", said.get("parts"), lambda x: x if isinstance(x, str) else None), ("thoughts", said.get("thoughts"), lambda x: x.get("summary")), ("citations", about.get("citations"), lambda x: (x.get("metadata") or {}).get("title")),
                ("attachments", [files] if isinstance(files, dict) else files, lambda x: x.get("name")), ("children", n.get("children"), lambda x: x), ("runs", result.get("runs"), lambda x: x.get("ms")),
            ):
                out[name] |= {(s, k, i, of(x)) for i, x in enumerate(xs or ()) if x is not None}
    return out


_FLAT_COLUMNS = {
    "shares": ["share_id", "fetched_at", "conversation_metadata_title", "conversation_metadata_model_slug", "conversation_metadata_create_time", "conversation_metadata_tool_call_count", "conversation_metadata_file_count", "conversation_metadata_visibility_summary_hidden_messages"],
    "sources": ["share_id", "name", "author", "title"], "moderation": ["share_id", "id", "category", "score"], "tools": ["share_id", "tool"], "safe_urls": ["share_id", "pos", "url"], "file_types": ["share_id", "pos", "file_type"],
    "messages": ["share_id", "fetched_at", "pos", "node_id", "role", "text", "status"], "message_children": ["share_id", "fetched_at", "pos", "child_pos", "child"], "payloads": ["share_id", "title", "current_node"], "payload_safe_urls": ["share_id", "pos", "url"],
    "nodes": ["share_id", "node_id", "parent", "author_name", "create_time", "status", "get_json_object(aggregate_result, '$.status')"], "parts": ["share_id", "node_id", "pos", "if(text like '{%', null, text)"], "thoughts": ["share_id", "node_id", "pos", "summary"],
    "citations": ["share_id", "node_id", "pos", "title"], "attachments": ["share_id", "node_id", "pos", "name"], "children": ["share_id", "node_id", "pos", "child"], "runs": ["share_id", "node_id", "pos", "ms"],
}


def test_flat_tables_by_hand(spark):
    want, q = _flat_by_hand(f"{SF}/conversations_raw.parquet"), __spark_entry__.queries()
    for name, columns in _FLAT_COLUMNS.items():
        got = {tuple(r) for r in q[f"p6_{name}"](spark, SF).selectExpr(*columns).collect()}
        assert got == want[name], (name, list(got - want[name])[:2], list(want[name] - got)[:2])
    assert sum(map(bool, want.values())) >= 15


def test_statistics(spark):
    assert abs(stats.student_p(2.0, 10) - 0.07338803) < 1e-6
    df = spark.createDataFrame([("m", 1, 3.0), ("m", 1, 3.0), ("m", 1, 1.0)], "metric string, draw int, value double")
    assert sorted(r["k"] for r in df.select(stats.average_rank(F.col("value"), "metric", "draw").alias("k")).collect()) == [1.5, 1.5, 3.0]
    assert list(ward(__import__("numpy").array([[0.0], [0.1], [5.0], [5.1], [9.0]]), 3)) == [1, 1, 2, 2, 3]


def test_topic_model_has_three_views_and_rare_terms(spark):
    rows = [(f"c{c}", role, f"{'apple pear plum' if c % 2 else 'engine wheel brake'} {role}word once{'abcdefgh'[c]}") for c in range(8) for role in ("user", "assistant")]
    df = spark.createDataFrame([*rows, ("alone", "user", "apple"), ("bare", "user", "1"), ("bare", "assistant", "the")], "conv_id string, role string, text string")
    got = models.topic_model(df, k=2, words=50).collect()
    assert {(r["conv_id"], r["view"]) for r in got} == {(c, v) for c in [*(f"c{i}" for i in range(8)), "bare"] for v in ("user", "assistant", "combined")}
    words = {v: set(" / ".join(r["keywords"] for r in got if r["view"] == v and r["conv_id"] != "bare").split(" / ")) for v in ("user", "assistant", "combined")}
    assert {f"once{x}" for x in "abcdefgh"} <= words["combined"] and "userword" in words["combined"] & words["user"]


def test_gibbs_recovers_effects(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [("m", t, f"{t}{c}", float(b + u + e)) for t, b in (("a", 0.8), ("b", -0.5)) for c in range(60) for u in [rng.normal(0, 0.3)] for e in rng.normal(0, 0.5, 5)]
    draws = models.gibbs(spark.createDataFrame(rows, "metric string, topic string, conv_id string, value double"), chains=2, iterations=500, warmup=150)
    med = {r["topic"]: r["median"] for r in stats.intervals(draws, "metric", "topic").collect()}
    assert abs(med["a"] - 0.8) < 0.2 and abs(med["b"] + 0.5) < 0.2 and abs(med[".residual_sd"] - 0.5) < 0.1


def test_topics_are_refused_not_dropped(spark, monkeypatch):
    topics = spark.createDataFrame([(f"t{i}", *[float(i)] * 4) for i in range(4)], ["topic", *analytics.METRICS])
    monkeypatch.setattr(analytics, "pivot_topic_metric", lambda spark, d: topics)
    assert analytics.topic_clusters(spark, SF).count() == 4
    monkeypatch.setattr(analytics, "MOST_TOPICS", 3)
    with pytest.raises(ValueError, match="more than 3 topics"):
        analytics.topic_clusters(spark, SF)


def test_bayes_draws_as_the_reference(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(models, "gibbs", lambda rows, **k: asked.update(k) or spark.createDataFrame([("m", "t", 0, 0, 1.0)], "metric string, topic string, chain int, draw int, value double"))
    analytics.bayes_topic_effects(spark, SF)
    assert asked == {"chains": 4, "iterations": 4000, "warmup": 1000}


def test_sources_and_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"id": "1", "created_utc": 5}\n\nnot json\n{"id": "1", "created_utc": 6}\n{"id": "2", "created_utc": 7}\n')
    assert files.json_lines(spark, str(src), "id string, created_utc bigint").count() == 3
    assert files.json_or_text(spark, str(src), "id string").filter("text is not null").count() == 1
    assert files.line_count(spark, str(src)) == 5 and files.line_count(spark, str(tmp_path / "no")) is None
    rows = ingest.deduplicated(ingest.landed(spark, str(src), "id string, created_utc bigint").filter("id is not null"))
    for _ in range(2):
        ingest.append_new(rows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    listing = [{"id": str(i), "created_utc": 100 - i} for i in range(7)]
    fetch = lambda cursor, size: [r for r in listing if cursor is None or r["created_utc"] < cursor][:size]
    assert [r["id"] for r in paged.pages(fetch, 3)] == [str(i) for i in range(7)]


def test_stream_keeps_older_records(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for dedup in (ingest.deduplicated, lambda rows: rows):
        at = tmp_path / f"out{dedup.__name__}"
        for n, ids in enumerate([[("a", 900_000), ("b", 900_001), ("b", 900_001)], [("c", 5), ("a", 900_000), ("c", 5)]]):
            (src / f"{n}.json").write_text("".join(json.dumps({"id": i, "created_utc": t}) + "\n" for i, t in ids))
            rows = dedup(ingest.landed(spark, str(src), "id string, created_utc bigint", files=1))
            ingest.append_new(rows, f"{at}/rows", f"{at}/cp").awaitTermination()
        assert sorted(r["id"] for r in spark.read.parquet(f"{at}/rows").collect()) == ["a", "b", "c"]


def test_anonymise(spark):
    out = _one(spark, "mail a.b@c.org or +1 202-555-0101, 12 Long Hill Road", anonymise.anonymised)
    assert out == "mail [email] or [phone], [address]"


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0 and os.path.isdir(SF)


def test_message_rows_fall_back_to_parts(spark):
    """Blank text takes the payload's parts, also of a payload encoded twice; no role, index or text gives no row."""
    import json

    from colloqua.operators import structure

    payload = json.dumps({"mapping": {"n1": {"id": "n1", "message": {"id": "n1", "content": {"content_type": "text", "parts": ["a", " ", None, "b"]}, "metadata": {"attachments": {"id": "x", "mime_type": "a/b"}, "model_slug": ""}}, "children": ["n2", "n3"]}, "n2": {"id": "n2", "message": None}}})
    messages = [("n1", "bot", " ", 0, ""), ("n2", "user", None, 1, None), ("n3", "user", "c", None, "m"), ("n4", "human", "d", 3, "m"), ("n5", None, "e", 4, None)]
    schema = "share_id string, fetched_at bigint, fetch_success boolean, messages array<struct<node_id string, role string, text string, backend_index int, model_slug string>>, conversation_metadata struct<title string, create_time double, default_model_slug string>, conversation_language string, reddit_sources array<struct<subreddit string>>, api_response string, pos int"
    raw = spark.createDataFrame([("s", 1, True, messages, ("t", 1.0, "base"), "en", [("b",), ("a",), ("b",), (None,)], p, 0) for p in (payload, json.dumps(payload))][:2] + [("z", None, True, None, None, None, None, "{cut", 0), (None, 1, True, messages, None, None, None, None, 0)], schema)
    for shares in (raw.limit(1), raw.filter("share_id = 's'").orderBy("api_response").limit(1)):
        got = {(r["pos"], r["role"], r["text"], r["model_slug"], r["subreddits"]) for r in pairs.message_rows(shares).collect()}
        assert got == {(0, "assistant", "a b", "base", "a|b"), (3, "user", "d", "m", "a|b")}
    assert pairs.latest_fetch(raw, "messages").count() == 1
    m = structure.extracted(raw.limit(1), keep_raw=True).collect()
    assert len(m) == 1 and m[0]["n_attachments"] == 1 and m[0]["model_slug"] is None and m[0]["n_children"] == 2 and "parts" in m[0]["raw_content"]
    f = {r["share_id"]: r for r in structure.metadata_features(raw).collect()}
    assert f["s"]["branch_count"] == 1 and f["s"]["file_types"] == "a/b" and f["s"]["mapping_size"] == 2
    assert structure.extracted(raw.limit(0)).count() == 0 and structure.metadata_features(raw.limit(0)).count() == 0 and pairs.message_rows(raw.limit(0)).count() == 0


def test_plug_ins_and_formats(spark):
    from colloqua.operators import languages, measures, stats

    df = spark.createDataFrame([("m1", "Good day"), ("m2", None), ("m3", "")], "message_id string, text string")
    assert [r["s"] for r in measures.scored(df, "text", "s", lambda ts: [float(len(t or "")) for t in ts], 2).orderBy("message_id").collect()] == [8.0, 0.0, 0.0]
    assert measures.embedded(df, lambda ts: [[1.0, len(t)] for t in ts]).count() == 3 and measures.embedded(df).count() == 1
    pairs_ = spark.createDataFrame([("m1", "mx", None, "x")], "user_message_id string, assistant_message_id string, user_cross_check_5 string, assistant_cross_check_5 string")
    assert tuple(measures.with_cross_checks(pairs_, df).select("user_cross_check_5", "assistant_cross_check_5").first()) == ("Good ", "x")
    n = spark.createDataFrame([(1234567.5, 0.12345), (3.0, None), (None, 1.0)], "n double, p double")
    assert [tuple(r) for r in n.select(stats.fmt_n(F.col("n")), stats.fmt_pct(F.col("p"))).collect()] == [("1,234,567.5", "12.3%"), ("3", None), (None, "100.0%")]
    v = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert v.filter(stats.finite(F.col("x"))).count() == 1
    shares = spark.createDataFrame([("s", [("user", "bonjour tout le monde")]), ("e", None)], "share_id string, messages array<struct<role string, text string>>")
    got = {r["share_id"]: (r["language"], r["low_confidence"]) for r in languages.detected(shares, lambda t: ("fr", 0.9)).collect()}
    assert got == {"s": ("fr", True), "e": ("unknown", True)}


def test_checkpoint_needs_a_shared_folder(spark):
    from colloqua import session

    assert session.checkpoint(spark.range(3)).count() == 3 and spark.sparkContext.master.startswith("local")


def test_sinks_and_cache(spark, tmp_path):
    df = spark.createDataFrame([("m1", "h1", "a"), ("m2", "h2", "a")], "message_id string, text_hash string, model string")
    path = str(tmp_path / "out")
    assert files.write(df, path, dry_run=True) == 2 and not files.exists(spark, path) and files.line_count(spark, path) is None
    for kind in ("parquet", "json", "csv"):
        files.write(df, f"{path}_{kind}", kind)
        files.write(df.limit(0), f"{path}_{kind}", kind, mode="ignore")
    assert spark.read.parquet(f"{path}_parquet").count() == 2 and files.line_count(spark, f"{path}_json") == 2
    assert files.csv_table(spark, f"{path}_csv", "message_id string, text_hash string, model string").count() == 2
    asked = []

    def compute(missing):
        asked.append(missing.count())
        return missing.withColumn("value", F.lit(1.0))

    assert files.extend_cache(df, f"{path}_cache", compute).count() == 2
    changed = df.withColumn("text_hash", F.when(F.col("message_id") == "m1", "other").otherwise(F.col("text_hash")))
    assert files.extend_cache(changed, f"{path}_cache", compute).count() == 3 and asked == [2, 1]


def test_additive_recovers_groups_and_curve(spark):
    import numpy as np

    from colloqua.operators import models

    rng = np.random.default_rng(3)
    rows = [("m", f"t{i}", d, t, i + 0.5 * (d == "b") + 0.05 * t + float(rng.normal(0, 0.1))) for i in range(3) for d in "ab" for t in range(1, 21) for _ in range(5)]
    df = spark.createDataFrame(rows + [("m", None, "a", 1, 1.0), ("m", "t0", "a", 1, None)], "metric string, topic string, direction string, abs_turn bigint, value double")
    out = models.additive(df).filter("kind = 'grid'").toPandas()
    want = out.topic.str[1:].astype(int) + 0.5 * (out.direction == "b") + 0.05 * out.abs_turn
    assert len(out) == 120 and (out.estimate - want).abs().max() < 0.15 and models.additive(df.limit(0)).count() == 0
