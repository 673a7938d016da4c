"""Landed posts and comments: records in one form, share links, fetch targets, what is still to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share links in free text (a fixed value), for the given hosts.
def share_pattern(hosts: tuple[str, ...]) -> str:
    listed = "|".join(h.replace(".", r"\.") for h in hosts)
    return rf"(?iU)((?:https?://)?(?:www\.)?(?:{listed})/share/[\w-]+)"


def share_urls(text: Column, hosts: tuple[str, ...]) -> Column:
    """All links, with https:// before those that do not start with http in small letters."""
    found = F.regexp_extract_all(text, F.lit(share_pattern(hosts)), F.lit(1))
    return F.transform(found, lambda u: F.when(F.startswith(u, F.lit("http")), u).otherwise(F.concat(F.lit("https://"), u)))


def share_id(url: Column) -> Column:
    """The path segment after the first ``share``, null without one."""
    return F.nullif(F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), r"(?:^|/)share/([^/]+)", 1), F.lit(""))


def with_site(permalink: Column, site: str) -> Column:
    return F.when(permalink != "", F.when(F.startswith(permalink, F.lit("http")), permalink).otherwise(F.concat(F.lit(site), permalink)))


def normalised_comments(comments: DataFrame, site: str) -> DataFrame:
    """Comments in one form, with the links and the post they were found by."""
    names = ("id", "name", "subreddit", "author", "created_utc", "body", "score", "link_id", "parent_id")
    return comments.select(*names, with_site(F.col("permalink"), site).alias("permalink"), "share_urls", "source_post_id")


def with_links(comments: DataFrame) -> DataFrame:
    """Comments with at least one share link."""
    return comments.filter(F.size("share_urls") > 0)


def latest(rows: DataFrame, key: str = "id", by: str = "ingested_at") -> DataFrame:
    """One row per key, the latest; rows of a null key are dropped."""
    names = [c for c in rows.columns if c not in (key, by)]
    top = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*names), by).alias("r"), F.max(by).alias(by))
    return top.select(key, *[f"r.{c}" for c in names], by)


def comments_of_posts(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """Comments with the post they stand under (``link_id`` is the post's ``name``)."""
    return comments.join(posts.select(F.col("name").alias("link_id"), F.col("id").alias("post_id"), F.col("subreddit").alias("post_subreddit")), "link_id")


def targets(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """share_id, url and the sources that name it, one per source id; posts by their url, comments by their links.

    Sources are gathered per share after a source counts once; a share's list is bounded by the sources that name it, which are
    counted and kept in a table of links by ``source_links`` where even that is too much.
    """
    links = source_links(posts, comments)
    one = links.groupBy("share_id", "source_id").agg(F.min_by("kind", "created_utc").alias("kind"), F.min("created_utc").alias("created_utc"), F.min("url").alias("url"))
    return one.groupBy("share_id").agg(F.min_by("url", F.struct("created_utc", "source_id")).alias("url"), F.count("*").alias("n_sources"), F.min("created_utc").alias("first_seen"))


def source_links(posts: DataFrame, comments: DataFrame) -> DataFrame:
    p = posts.filter("id is not null").select(share_id(F.col("url")).alias("share_id"), "url", F.col("id").alias("source_id"), F.lit("post").alias("kind"), "created_utc")
    c = comments.filter("id is not null").select(F.explode("share_urls").alias("url"), F.col("id").alias("source_id"), F.lit("comment").alias("kind"), "created_utc")
    c = c.select(share_id(F.col("url")).alias("share_id"), "url", "source_id", "kind", "created_utc")
    return p.unionByName(c).filter("share_id is not null")


def unseen(new: DataFrame, old: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not known yet, once per key; rows of a null key are always kept."""
    fresh = new.join(old.select(key).distinct(), key, "left_anti")
    first = fresh.filter(F.col(key).isNotNull()).dropDuplicates([key])
    return first.unionByName(fresh.filter(F.col(key).isNull()))


def still_to_fetch(wanted: DataFrame, fetched: DataFrame, refresh_missing: bool = False) -> DataFrame:
    """Targets without a fetch; with ``refresh_missing`` also those whose fetch brought no message."""
    done = fetched.filter("size(messages) > 0") if refresh_missing else fetched
    return wanted.join(done.select("share_id").distinct(), "share_id", "left_anti")


def first_source(raw: DataFrame) -> DataFrame:
    """conv_id, author, subreddit: the first non-empty of each in source order, independently; and all subreddits."""
    pick = lambda f: F.try_element_at(F.filter(F.transform("reddit_sources", lambda s: s[f]), lambda x: x != ""), F.lit(1))
    every = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform("reddit_sources", lambda s: s["subreddit"]), lambda x: x != ""))), "|")
    return raw.select(F.col("share_id").alias("conv_id"), pick("author").alias("author"), pick("subreddit").alias("subreddit"), F.nullif(every, F.lit("")).alias("subreddits"))


def last_cursor(rows: DataFrame) -> DataFrame:
    """The last non-null ``created_utc``, from which paging goes on."""
    return rows.filter("created_utc is not null").agg(F.min("created_utc").alias("cursor"))
