"""Scans of HTML, and names of what they link to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IMAGE_URL = r"(?i)\.(png|jpe?g|gif|webp|svg)([?#].*)?$"
#: Where pages name images.
PATTERNS = (
    r"(?i)<img[^>]*?\ssrc=[\"']([^\"']+)[\"']",
    r"(?i)<a[^>]*?\shref=[\"']([^\"']+)[\"']",
    r"(?i)background(?:-image)?:[^;\"'}]*?url\([\"']?([^\"')]+)[\"']?\)",
    r"(https?://[^\s\"'<>()]+)",
)


def absolute(url: Column, base: Column) -> Column:
    """A link resolved against its page's address."""
    root = F.regexp_extract(base, r"^(\w+://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^(\w+://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    folder = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(root, F.lit("/")))
    return F.when(url.rlike(r"^\w+:"), url).when(F.startswith(url, F.lit("//")), F.concat(F.regexp_extract(base, r"^(\w+:)", 1), url)).when(F.startswith(url, F.lit("/")), F.concat(root, url)).otherwise(F.concat(folder, F.regexp_replace(url, r"^\./", "")))


def image_links(pages: DataFrame, id_: str, url: str, html: str) -> DataFrame:
    """(page, ord, image) of each image a page links to, each address once per page, in order of pattern and place."""
    found = F.concat(*(F.regexp_extract_all(html, F.lit(p), 1) for p in PATTERNS))
    rows = pages.select(F.col(id_), F.col(url).alias("_base"), F.posexplode(found).alias("ord", "_link")).filter(F.col("_link").rlike(IMAGE_URL))
    return rows.select(id_, "ord", absolute(F.col("_link"), F.col("_base")).alias("image")).groupBy(id_, "image").agg(F.min("ord").alias("ord"))


def safe_name(url: Column) -> Column:
    """A file name from a URL's last path segment."""
    return F.regexp_replace(F.regexp_extract(url, r"([^/?#]+)(?:[?#].*)?$", 1), r"[^A-Za-z0-9._-]+", "_")


def unique_names(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """The second and later files of one name get -2, -3, ... before the extension."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return df.withColumn(name, F.when(n == 1, F.col(name)).otherwise(F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("-"), n.cast("string"), F.regexp_extract(name, r"(\.[^.]*)$", 1))))
