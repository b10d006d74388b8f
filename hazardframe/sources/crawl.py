"""A crawl frontier as tables: pages to fetch, pages seen, links found.

Every round fetches the frontier, writes what came back as one table, and takes
from these pages the addresses for the next round, less all that any round has
fetched. The crawl ends when a round finds nothing new. A round that was written
whole is not fetched again, so a crawl that was stopped goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRONTIER = "url string, kind string, number int, found_on string, place struct<pos:int,inner:int>"
PAGES = FRONTIER + ", http_status int, content_type string, html string, error string, retrieved_at timestamp"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def pages(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The pages of a crawl under `path`, with the round that fetched them."""
    try:
        found = spark.read.schema(PAGES + ", round int").option("basePath", path).parquet(f"{path}/round=*")
    except AnalysisException:  # no round was written
        found = spark.createDataFrame([], PAGES + ", round int")
    return found if upto is None else found.where(F.col("round") <= upto)


def crawl(spark: SparkSession, seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], expand: Callable[[DataFrame], DataFrame], path: str, enough: Callable[[DataFrame], bool] | None = None, rounds: int = 10_000) -> DataFrame:
    """All pages reached from `seeds`, as `pages` gives them.

    seeds, and what `expand` returns for the pages of a round, are rows of
    FRONTIER; of rows with one address the first by number and place counts. fetch
    takes (url) and returns url, http_status, content_type, content, error,
    retrieved_at. `enough`, asked with all pages after each round, ends a crawl early.
    """
    names = [f.split()[0] for f in FRONTIER.split(", ")]
    frontier = seeds
    for k in range(rounds):
        here = f"{path}/round={k}"
        if not _exists(spark, f"{here}/_SUCCESS"):
            once = frontier.where("url is not null").groupBy("url").agg(F.min_by(F.struct(*names), F.struct("number", "place")).alias("r")).select("r.*")
            new = once.join(pages(spark, path, k - 1).select("url"), "url", "left_anti") if k else once
            new.write.mode("overwrite").parquet(f"{path}/frontier/{k}")
            new = spark.read.schema(FRONTIER).parquet(f"{path}/frontier/{k}")
            if new.isEmpty():
                break
            came = fetch(new.select("url")).select("url", "http_status", "content_type", F.make_valid_utf8(F.col("content").cast("string")).alias("html"), "error", "retrieved_at")
            new.join(came, "url", "left").select(*[f.split()[0] for f in PAGES.replace("struct<pos:int,inner:int>", "struct").split(", ")]).write.mode("overwrite").parquet(here)
        fetched = spark.read.schema(PAGES).parquet(here)
        if enough and enough(pages(spark, path, k)):
            break
        frontier = expand(fetched.where("error is null"))
    return pages(spark, path)
