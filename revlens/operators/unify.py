"""Two store exports into one review table, and the ordered sample of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("review_id", "date", "user_name", "platform", "lang", "review", "is_replied")
NO_TITLE = "No title"


def _key(platform: str, when: str, text: str) -> Column:
    """The export's own key, or a hash of what identifies a review."""
    return F.coalesce(
        F.col("review_id"),
        F.xxhash64(F.lit(platform), F.col("userName"), F.col(when), F.col(text)),
    ).alias("review_id")


def unify_google(raw: DataFrame, titles: bool = False) -> DataFrame:
    out = raw.select(
        _key("Google Play", "at", "content"),
        F.to_date("at").alias("date"),
        F.col("userName").alias("user_name"),
        F.lit("Google Play").alias("platform"),
        "lang",
        F.col("content").alias("review"),
        F.when(F.col("replyContent").isNotNull(), "Yes").otherwise("No").alias("is_replied"),
        F.coalesce(F.col("reviewCreatedVersion"), F.lit(NO_TITLE)).alias("title"),
    )
    return out if titles else out.drop("title")


def unify_appstore(raw: DataFrame, titles: bool = False) -> DataFrame:
    """This export never says whether a review was answered: all count as open."""
    out = raw.select(
        _key("App Store", "date", "review"),
        F.to_date("date").alias("date"),
        F.col("userName").alias("user_name"),
        F.lit("App Store").alias("platform"),
        "lang",
        "review",
        F.lit("No").alias("is_replied"),
        F.coalesce(F.col("title"), F.lit(NO_TITLE)).alias("title"),
    )
    return out if titles else out.drop("title")


def unify(google: DataFrame, appstore: DataFrame, titles: bool = False) -> DataFrame:
    return unify_google(google, titles).unionByName(unify_appstore(appstore, titles))


def unify_by_content(google: DataFrame, appstore: DataFrame) -> DataFrame:
    """Exports without ids as one table: ``review_key`` is a 128-bit digest of platform,
    user, time and text, and rows equal in all four are one review with a number of
    ``copies`` (answered if any of them is). A partial aggregate; no row is lost."""
    sides = [
        google.select(
            F.lit("Google Play").alias("platform"), F.col("userName").alias("user_name"),
            F.col("at").alias("_when"), F.col("content").alias("review"),
            F.when(F.col("replyContent").isNotNull(), "Yes").otherwise("No").alias("is_replied"),
        ),
        appstore.select(
            F.lit("App Store").alias("platform"), F.col("userName").alias("user_name"),
            F.col("date").alias("_when"), "review", F.lit("No").alias("is_replied"),
        ),
    ]
    what = ("platform", "user_name", "_when", "review")
    stamp = F.date_format("_when", "yyyy-MM-dd HH:mm:ss")
    key = F.md5(F.concat_ws("\x1f", "platform", "user_name", stamp, "review"))
    return (
        sides[0].unionByName(sides[1])
        .groupBy(*what)
        .agg(F.max("is_replied").alias("is_replied"), F.count("*").alias("copies"))
        .select(
            key.alias("review_key"), F.to_date("_when").alias("date"), "user_name", "platform",
            "review", "is_replied", "copies",
        )
    )


def sample_per_platform(reviews: DataFrame, n: int = 5) -> DataFrame:
    """The n newest reviews of each platform, App Store first.

    The rank filter sits directly on row_number, so Spark keeps only n rows per
    platform in each task before the shuffle; two huge platforms do not matter.
    """
    newest = Window.partitionBy("platform").orderBy(F.col("date").desc(), F.col("review_id"))
    order = F.when(F.col("platform") == "App Store", 1).otherwise(2)
    return (
        reviews.withColumn("rank_in_platform", F.row_number().over(newest))
        .filter(F.col("rank_in_platform") <= n)
        .withColumn("platform_order", order)
    )


def with_position(sample: DataFrame) -> DataFrame:
    """1..n over the (small) sample, in report order."""
    order = Window.orderBy("platform_order", "rank_in_platform")
    return sample.withColumn("position", F.row_number().over(order))


def source_profile(reviews: DataFrame) -> DataFrame:
    """What arrived from each source: rows, dates, gaps. One partial aggregate."""
    return reviews.groupBy("platform").agg(
        F.count("*").alias("n_reviews"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count_if(F.col("review").isNull()).alias("null_reviews"),
        F.count_if(F.col("user_name").isNull()).alias("null_users"),
        F.count_if(F.col("is_replied") == "Yes").alias("n_replied"),
        F.count_if(F.col("title") == NO_TITLE).alias("untitled"),
    )


def unreplied(reviews: DataFrame) -> DataFrame:
    return reviews.filter(F.col("is_replied") == "No")
