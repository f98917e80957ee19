"""Creative attributes and thumbnails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.functions.scalars import first_usable
from spendlens.schema import CREATIVE_SOURCE_SCHEMA


def read_creative_source(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(CREATIVE_SOURCE_SCHEMA).option("mode", "PERMISSIVE").json(path)


def flatten_creatives(ads: DataFrame) -> DataFrame:
    """Ad objects with a nested creative to 14 flat columns; no creative gives nulls."""
    nested = F.col("creative")
    return ads.select(
        F.col("id").alias("ad_id"),
        F.col("name").alias("ad_name"),
        F.col("status").alias("ad_status"),
        "created_time",
        nested["id"].alias("creative_id"),
        nested["name"].alias("creative_name"),
        nested["title"].alias("title"),
        nested["body"].alias("body"),
        nested["object_type"].alias("object_type"),
        nested["call_to_action_type"].alias("cta"),
        nested["video_id"].alias("video_id"),
        nested["image_url"].alias("image_url"),
        nested["thumbnail_url"].alias("thumbnail_url"),
        nested["effective_object_story_id"].alias("story_id"),
    )


def read_creatives(spark: SparkSession, path) -> DataFrame:
    """The stored creative table; Parquet reads only the selected columns."""
    return spark.read.parquet(path)


def picture_urls(creatives: DataFrame) -> DataFrame:
    """The picture to fetch per ad: the image, else the thumbnail; blanks are skipped."""
    url = first_usable("image_url", "thumbnail_url")
    return creatives.select("ad_id", url.alias("url")).where("url IS NOT NULL")


def read_thumbnails(spark: SparkSession, path) -> DataFrame:
    """Pictures keyed by file stem. Unreadable files stay, with width -1."""
    images = spark.read.format("image").option("dropInvalid", False).load(path)
    stem = F.regexp_extract(F.col("image.origin"), r"([^/]+)\.[A-Za-z]+$", 1)
    return images.select(stem.alias("ad_id"), "image")
