"""The pN_ queries of this subpackage, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloqua.llm import conversations, defects, encoding, langid, leakage, mixing, pii, subjects
from colloqua.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(_personal(spark, sf_dir))


def p1_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with typed placeholders in place of personal data."""
    return pii.sanitised(_personal(spark, sf_dir))


def _personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.fields(table(spark, sf_dir, "conversations"), table(spark, sf_dir, "reddit_comments"))


def _language_model(spark: SparkSession, sf_dir: str) -> langid.Model:
    return langid.fit_model(table(spark, sf_dir, "conversations"), "text", "lang", "message_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _language_model(spark, sf_dir)
    messages = langid.mislabelled_messages(table(spark, sf_dir, "conversations"), model)
    chats = langid.mislabelled_chats(table(spark, sf_dir, "conversations_raw"), model)
    first = messages.select(F.lit("message").alias("record_kind"), "record_id", "segment_no", "lang")
    return first.unionByName(chats.select(F.lit("conversation").alias("record_kind"), "record_id", F.lit(0).alias("segment_no"), "lang"))


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every message with its language and confidence."""
    rows = table(spark, sf_dir, "conversations")
    return langid.message_segments(rows, _language_model(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _garbled(spark, sf_dir).select("src_table", "record_id")


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records with their restored text, null where nothing can be restored."""
    return _garbled(spark, sf_dir)


def _garbled(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = (("conversations", "message_id", "text"), ("reddit_comments", "id", "body"), ("reddit_posts", "id", "title"))
    return encoding.found([(name, table(spark, sf_dir, name), key, text) for name, key, text in columns])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.found(table(spark, sf_dir, "semantic_alignment"), _language_model(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.rebuild(table(spark, sf_dir, "conversations")).select("conv_id", "position", "message_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id")


def _factors(stored: DataFrame, sf_dir: str) -> subjects.Factors:
    return subjects.fit(stored, *(table(stored.sparkSession, sf_dir, t) for t in ("subject_labels", "subject_areas")))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = mixing.prepared(table(spark, sf_dir, "documents"))
    return mixing.mix(stored, table(spark, sf_dir, "mix_targets"), _factors(stored, sf_dir))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual token share of each source."""
    return mixing.report(p8_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = subjects.prepared(table(spark, sf_dir, "documents"))
    return subjects.found(stored, _factors(stored, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("doc_id", "subject")


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and mean share of each subject over the corpus."""
    return _found(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("documents"), F.round(F.avg("share"), 4).alias("mean_share"))


QUERIES = {"p1_found": p1_found, "p1_sanitised": p1_sanitised, "p2_found": p2_found, "p2_segments": p2_segments, "p3_found": p3_found, "p3_restored": p3_restored, "p4_found": p4_found, "p5_found": p5_found, "p7_found": p7_found, "p8_mix": p8_mix, "p8_report": p8_report, "p9_found": p9_found, "p9_composition": p9_composition}
SQL: dict[str, str] = {}
