"""Sitemap XML writers (SNK1, SNK2).

Rows become ``<url>`` elements with column expressions; files are written
with Spark's XML data source, one for each part of at most 50,000 URLs, plus a
``<sitemapindex>`` naming the parts when a site needs more than one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sitemap import MAX_URLS_PER_SITEMAP, SITEMAP_NS, with_parts


def _escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"),
                     F.lit("&gt;"))


def lastmod_value(last_modified: Column, mode: str = "raw") -> Column:
    """The lastmod text: the raw Last-Modified header (reference behaviour) or,
    with ``mode="w3c"``, a W3C datetime (NULL when unparseable)."""
    if mode == "raw":
        return F.coalesce(last_modified, F.lit(""))
    from ..operators.runs import last_modified_ts
    return F.coalesce(F.date_format(last_modified_ts(last_modified), "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit(""))


def url_elements(rows: DataFrame, lastmod: str = "raw") -> DataFrame:
    """SNK1: ``<url><loc/>[<lastmod/>]<priority/></url>`` per row; lastmod is
    the raw Last-Modified text (or W3C with ``lastmod="w3c"``) and only
    present when non-empty."""
    lm = lastmod_value(F.col("last_modified"), lastmod)
    lastmod = F.when(lm != "", F.concat(F.lit("<lastmod>"), _escape(lm), F.lit("</lastmod>"))).otherwise(F.lit(""))
    xml = F.concat(F.lit("<url><loc>"), _escape(F.col("url")), F.lit("</loc>"), lastmod, F.lit("<priority>"),
                   F.col("priority"), F.lit("</priority></url>"))
    return rows.withColumn("xml", xml)


def part_file_name(part: Column, parts: Column, base: str = "sitemap", ext: str = ".xml") -> Column:
    return F.when(parts > 1, F.concat(F.lit(f"{base}-"), part.cast("string"), F.lit(ext))).otherwise(F.lit(base + ext))


def write_sitemaps(rows: DataFrame, path: str, max_urls: int = MAX_URLS_PER_SITEMAP) -> None:
    """SNK1 + SNK2: ``path/site=…/sitemap.xml`` for every site with rows; a site
    of more than ``max_urls`` rows gets ``sitemap-1.xml``, ``sitemap-2.xml``, …
    and ``sitemap.xml`` is the index that names them in order.

    Spark writes one file for each (site, part) and one index for each site
    into a scratch folder beside the target; the driver then gives them their
    names, one rename (no data) for each file.
    """
    spark = rows.sparkSession
    parted = with_parts(rows, max_urls)
    out = parted.select(
        "site", "part", "parts", F.col("url").alias("loc"),
        F.when(F.col("last_modified") != "", F.col("last_modified")).alias("lastmod"), "priority", "seq")
    scratch = f"{path}/_writing"
    (out.withColumn("file", part_file_name(F.col("part"), F.col("parts"))).repartition("site", "file")
     .sortWithinPartitions("site", "file", "seq").drop("seq", "part", "parts")
     .write.mode("overwrite").partitionBy("site", "file").format("xml")
     .option("rowTag", "url").option("rootTag", f'urlset xmlns="{SITEMAP_NS}"').save(f"{scratch}/urls"))
    index = parted.where(F.col("parts") > 1).select("site", "part", "parts").distinct()
    (index.repartition("site").sortWithinPartitions("site", "part")
     .select("site", F.lit("sitemap.xml").alias("file"), part_file_name(F.col("part"), F.col("parts")).alias("loc"))
     .write.mode("overwrite").partitionBy("site", "file").format("xml").option("rowTag", "sitemap")
     .option("rootTag", f'sitemapindex xmlns="{SITEMAP_NS}"').save(f"{scratch}/index"))
    named_files(spark, scratch, path)


def named_files(spark, scratch: str, path: str) -> None:
    """Move ``scratch/*/site=…/file=NAME/part-…`` to ``path/site=…/NAME``."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in fs.globStatus(hadoop.Path(f"{scratch}/*/site=*/file=*/part-*")) or []:
        file = found.getPath()
        folder = hadoop.Path(target, file.getParent().getParent().getName())
        fs.mkdirs(folder)
        name = hadoop.Path(folder, file.getParent().getName().removeprefix("file="))
        fs.delete(name, False)
        if not fs.rename(file, name):
            raise OSError(f"can't rename {file} to {name}")
    fs.delete(hadoop.Path(scratch), True)
