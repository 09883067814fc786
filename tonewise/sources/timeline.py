"""Timelines out of saved profile pages, and the snapshot cache.

Pages come from ``fetch`` or from wherever they were saved; parsing is DataFrame
work over a table (username, html).
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewise.functions.format import parse_created_at, permalink

MEDIA = "array<struct<type:string,media_url_https:string,media_url:string>>"
USER = "struct<name:string,screen_name:string,profile_image_url_https:string,followers_count:bigint,friends_count:bigint>"
POST = (
    "struct<full_text:string,text:string,id_str:string,created_at:string,favorite_count:bigint,retweet_count:bigint,permalink:string,"
    f"user:{USER},extended_entities:struct<media:{MEDIA}>,entities:struct<media:{MEDIA}>>"
)
PAGE = f"props struct<pageProps:struct<headerProps:string,timeline:struct<entries:array<struct<type:string,content:struct<tweet:{POST}>>>>>>"
ISLAND = r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>'
CACHE_SECONDS, CACHE_ENTRIES = 600, 256


#: Entities that Spark resolves itself, the sign that begins them last.
PLAIN_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"))
#: Pages that Python gets at once, where it must resolve their entities.
BATCH_PAGES = 200


def unescaped(text: Column) -> Column:
    """HTML entities resolved. Texts with other entities than the plain four go through Python in Arrow batches, as Spark has no function for all."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or "&" not in t else html.unescape(t))

    plain = text
    for entity, sign in PLAIN_ENTITIES:
        plain = F.replace(plain, F.lit(entity), F.lit(sign))
    other = text.rlike("&(?!" + "|".join(e[1:] for e, _ in PLAIN_ENTITIES) + ")")
    return F.when(other, run(F.when(other, text))).otherwise(plain)


def page_data(page: Column) -> Column:
    """The page's data island as a struct; null without one."""
    return F.from_json(unescaped(F.nullif(F.regexp_extract(page, ISLAND, 1), F.lit(""))), PAGE)


def _or(x: Column, other) -> Column:
    return F.coalesce(F.nullif(x, F.lit("")), other if isinstance(other, Column) else F.lit(other))


def parse_pages(pages: DataFrame, count: int = 20, now: Column | None = None) -> DataFrame:
    """One row per page: username, status ('ok', 'empty', 'not_found', 'no_data'), user, posts.

    Posts are the first ``count`` entries of type 'tweet', in page order; the
    user is that of the first of them.
    """
    now = F.current_timestamp() if now is None else now
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(pages.sparkSession.conf.get(key)) <= BATCH_PAGES:
        pages.sparkSession.conf.set(key, str(BATCH_PAGES))
    name = F.col("username")
    rows = pages.select("username", page_data(F.col("html")).alias("d"))
    entries = F.filter(F.coalesce("d.props.pageProps.timeline.entries", F.from_json(F.lit("[]"), f"array<struct<type:string,content:struct<tweet:{POST}>>>")), lambda e: e["type"] == "tweet")
    rows = rows.withColumn("e", entries)
    first = F.get("e", F.lit(0))["content"]["tweet"]["user"]
    picture = F.concat(F.lit("https://unavatar.io/twitter/"), name)
    rows = rows.withColumn(
        "user",
        F.struct(
            _or(first["name"], name).alias("name"),
            _or(first["screen_name"], name).alias("screen_name"),
            _or(first["profile_image_url_https"], picture).alias("profile_image_url_https"),
            F.coalesce(first["followers_count"], F.lit(0)).alias("followers_count"),
            F.coalesce(first["friends_count"], F.lit(0)).alias("friends_count"),
        ),
    )

    def media(t: Column) -> Column:
        found = F.coalesce(F.when(t["extended_entities"].isNotNull(), t["extended_entities"]["media"]).otherwise(t["entities"]["media"]), F.from_json(F.lit("[]"), MEDIA))
        each = F.transform(found, lambda m: F.struct(F.coalesce(m["type"], F.lit("photo")).alias("type"), F.coalesce(F.nullif(m["media_url_https"], F.lit("")), m["media_url"], F.lit("")).alias("media_url_https")))
        return F.filter(each, lambda m: m["media_url_https"] != "")

    def post(e: Column) -> Column:
        t = e["content"]["tweet"]
        return F.struct(
            F.coalesce(F.nullif(t["full_text"], F.lit("")), t["text"], F.lit("")).alias("full_text"),
            F.coalesce(t["id_str"], F.lit("")).alias("id_str"),
            parse_created_at(t["created_at"], now).alias("created_at"),
            F.coalesce(t["favorite_count"], F.lit(0)).alias("favorite_count"),
            F.coalesce(t["retweet_count"], F.lit(0)).alias("retweet_count"),
            permalink(t["permalink"], F.col("user.screen_name"), t["id_str"]).alias("tweet_url"),
            media(t).alias("media"),
        )

    status = (
        F.when(F.col("d").isNull(), "no_data")
        .when(F.size("e") > 0, "ok")
        .when(F.coalesce(F.col("d.props.pageProps.headerProps"), F.lit("")).isin("", "{}", "null"), "not_found")
        .otherwise("empty")
    )
    return rows.select("username", status.alias("status"), "user", F.transform(F.slice("e", 1, count), post).alias("posts"))


def posts(parsed: DataFrame) -> DataFrame:
    """One row per post: username, pos and the post's fields."""
    return parsed.select("username", "user", F.posexplode("posts").alias("pos", "post")).select("username", "user", "pos", "post.*")


def latest_snapshots(snapshots: DataFrame, user: str, at: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """The latest row of each user (case ignored), as a grouped maximum; ``ties`` decide among equally late ones."""
    row = F.struct(*snapshots.columns)
    return snapshots.groupBy(F.lower(F.col(user)).alias("__u")).agg(F.max_by(row, F.struct(at, *ties)).alias("r")).select("r.*")


def cached(snapshots: DataFrame, user: str, at: str, n_posts: str, wanted: int, now: Column, allow_stale: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    """Latest snapshots that may answer: fresh unless stale ones are allowed, and of enough posts."""
    rows = latest_snapshots(snapshots, user, at, ties)
    fresh = F.timestamp_diff("SECOND", F.col(at), now) <= CACHE_SECONDS
    rows = rows.withColumn("fresh", fresh).where(F.col(n_posts) >= wanted)
    return rows if allow_stale else rows.where("fresh")


def evicted(snapshots: DataFrame, user: str, at: str, most: int = CACHE_ENTRIES, ties: tuple[str, ...] = ()) -> DataFrame:
    """The ``most`` latest users' snapshots: the rest of the cache goes, oldest first."""
    return latest_snapshots(snapshots, user, at, ties).orderBy(F.desc(at), user).limit(most)
