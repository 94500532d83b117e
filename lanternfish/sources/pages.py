"""Pages and sitemaps: titles, meta tags, links and tree walks, with the XML and HTML work inside Catalyst."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lanternfish.functions.columns import url_date_span
from lanternfish.plans.staging import stage

HEAD = 300_000


def html_title(page: Column) -> Column:
    """Text of the first title element, white space folded."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(F.substring(page, 1, HEAD), r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")), F.lit(""))


def meta_content(page: Column, name: str) -> Column:
    """Content of a meta property, whichever of the two attributes comes first."""
    head = F.substring(page, 1, HEAD)
    one = F.regexp_extract(head, rf"""(?is)<meta[^>]+(?:property|name)=["']{name}["'][^>]*?content=["']([^"']*)["']""", 1)
    two = F.regexp_extract(head, rf"""(?is)<meta[^>]+content=["']([^"']*)["'][^>]*?(?:property|name)=["']{name}["']""", 1)
    return F.coalesce(F.nullif(one, F.lit("")), F.nullif(two, F.lit("")))


def unescape(text: Column) -> Column:
    """HTML entities as characters (Spark has no such function)."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else html.unescape(t) for t in texts], dtype=object)

    return run(text)


def sitemap_entries(df: DataFrame, xml: str) -> DataFrame:
    """``df`` with one row for each location in a sitemap, whatever its name spaces."""
    return df.withColumn("loc", F.explode(F.xpath(F.col(xml), F.lit("//*[local-name()='loc']/text()"))))


_NEWS = "publication_date:string, title:string"
RECORD = f"struct<loc:string, lastmod:string, title:string, publication_date:string, news:struct<{_NEWS}>, image:array<struct<loc:string>>, _corrupt_record:string>"


def sitemap_records(df: DataFrame, xml: str) -> DataFrame:
    """(loc, when, title, image_url, corrupt) of every entry of sitemaps, by a record schema: prefixes and attributes do not
    matter, character data and entities are resolved.  An entry that is no XML gives its text in ``corrupt`` and nothing else; the entries
    around it stay.  Entries without a location are left out unless they are corrupt."""
    blocks = F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<((?:\w+:)?)url(?:\s[^>]*)?>.*?</\1url>"), F.lit(0))
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "ignoreSurroundingSpaces": "true"}
    e = df.select(F.explode(blocks).alias("block")).select(F.from_xml("block", RECORD, options).alias("e"))
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    e = e.select(text(F.col("e.loc")).alias("loc"), F.coalesce(text(F.col("e.news.publication_date")), text(F.col("e.publication_date")), text(F.col("e.lastmod"))).alias("when"),
                 F.coalesce(text(F.col("e.news.title")), text(F.col("e.title"))).alias("title"), text(F.get(F.col("e.image.loc"), 0)).alias("image_url"), F.col("e._corrupt_record").alias("corrupt"))
    whole = F.col("corrupt").isNull()
    return e.select(*[F.when(whole, F.col(c)).alias(c) for c in ("loc", "when", "title", "image_url")], "corrupt").where(~whole | F.col("loc").isNotNull())


def _resolved(text: Column) -> Column:
    """The five entities of XML as characters."""
    for code, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def sitemap_articles(df: DataFrame, xml: str, since: str, until: str, slug: str | None = None) -> DataFrame:
    """(loc, published, title, image_url) of the entries of sitemaps that fall into a range of days.

    An entry's day is that of its news date or last change; where that is no date, the URL's own date span must touch the
    range and its first day is taken; entries without any date, and those that are no XML, are left out.  Entities that titles
    still hold (they stand in character data) are resolved.  ``slug`` is searched in the URL's path only.
    """
    e = stage(sitemap_records(df, xml).where("corrupt IS NULL").drop("corrupt").withColumn("title", _resolved(F.col("title"))), "sitemap-entries")  # parsed once, however often the columns are used below
    if slug:
        e = e.where(F.coalesce(F.try_parse_url("loc", F.lit("PATH")), F.lit("")).rlike(f"(?i){slug}"))
    low, high = F.lit(since).cast("date"), F.lit(until).cast("date")
    day = F.try_to_date(F.substring("when", 1, 10), "yyyy-MM-dd")
    first, last = url_date_span(F.col("loc"))
    e = e.withColumn("day", day).withColumn("first", first).withColumn("last", last)
    keep = F.when(F.col("day").isNotNull(), F.col("day").between(low, high)).otherwise(F.coalesce((F.col("first") <= high) & (F.col("last") >= low), F.lit(False)))
    return e.where(keep).select("loc", F.when(F.col("day").isNotNull(), F.col("when")).otherwise(F.col("first").cast("string")).alias("published"), "title", "image_url")


def walk_tree(roots: DataFrame, children: DataFrame, depth: int = 4, done: DataFrame | None = None) -> DataFrame:
    """(node, depth): nodes reached from the roots within ``depth`` steps, at their least depth; one join a level.

    Nodes of the ledger ``done`` (node) are finished: they are neither given nor walked through.
    """
    if done is not None:
        roots = roots.join(done.select("node"), "node", "left_anti")
        children = children.join(done.select(F.col("node").alias("child")), "child", "left_anti")
    found = roots.select("node").distinct().withColumn("depth", F.lit(0))
    front = found
    for level in range(1, depth + 1):
        front = front.join(children, front["node"] == children["parent"]).select(F.col("child").alias("node")).distinct().withColumn("depth", F.lit(level))
        front = front.join(found.select("node"), "node", "left_anti")
        found = found.unionByName(front)
    return found
