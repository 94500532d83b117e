"""JSON documents as sinks and sources, and the pictures inside nested posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def write_document(row: DataFrame, path: str) -> None:
    """A small nested document: the one row of a frame, as JSON."""
    row.limit(2).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_arrays(rows: DataFrame, by: str, order: list[Column], path: str) -> None:
    """One folder of JSON lines for each value of ``by``, rows in order within each file; no group is gathered in one value."""
    rows.repartitionByRange(F.col(by), *order).sortWithinPartitions(by, *order).write.mode("overwrite").partitionBy(by).json(path)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents, each of which may stretch over several lines."""
    return spark.read.option("multiLine", "true").json(path)


_IMAGES = "array<struct<thumb:string, fullsize:string>>"
_EXTERNAL = "struct<thumb:string, title:string, uri:string>"
_PLAIN = f"`$type`:string, images:{_IMAGES}, external:{_EXTERNAL}"
EMBED = f"struct<{_PLAIN}, media:struct<{_PLAIN}>>"
# The kinds of embeds, by how their type names begin.
PICTURES, LINK, WITH_MEDIA = "app.bsky.embed.images", "app.bsky.embed.external", "app.bsky.embed.recordWithMedia"


def embedded_pictures(embed: Column) -> Column:
    """Array of (image_url, headline, link_url) in a post's embed (JSON): pictures of its own, of a link's card, or of the media
    beside a quoted record, which hold no further record.  Null or malformed embeds have none."""
    e = F.from_json(embed, EMBED)
    triple = lambda image, title, uri: F.struct(image.alias("image_url"), title.alias("headline"), uri.alias("link_url"))
    null = F.lit(None).cast("string")
    kind = lambda part, name: F.coalesce(part["$type"].startswith(name), F.lit(False))
    none = F.array().cast("array<struct<image_url:string, headline:string, link_url:string>>")

    def own(part: Column) -> Column:
        pictures = F.transform(part["images"], lambda i: triple(F.coalesce(F.nullif(i["thumb"], F.lit("")), F.nullif(i["fullsize"], F.lit(""))), null, null))
        card = part["external"]
        return (F.when(kind(part, PICTURES), F.filter(F.coalesce(pictures, none), lambda t: t["image_url"].isNotNull()))
                .when(kind(part, LINK) & (F.coalesce(card["thumb"], F.lit("")) != ""), F.array(triple(card["thumb"], card["title"], card["uri"]))).otherwise(none))

    return F.coalesce(F.when(kind(e, WITH_MEDIA), own(e["media"])).otherwise(own(e)), none)
