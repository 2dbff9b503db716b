"""The cost feed as a data source: JSON documents behind URLs, where every failure is a row with its reason.

``spark.read.format("cost_feed").option("urls", "https://... https://...").load()``
gives url, body and reason; exactly one of the last two is null.  URLs are dealt out
to ``partitions`` tasks (by default one each, 64 at most), and fetched there one
after another with a time limit each, so neither a slow nor a broken feed stops a job.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .feed import FEED_SCHEMA

MOST_PARTITIONS = 64
SECONDS = 15.0
#: A larger document is refused.
MOST_BYTES = 64 << 20


class Urls(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


def judged(body: bytes) -> tuple[str | None, str | None]:
    """(body, None) of a feed document, or (None, reason)."""
    try:
        text = body.decode()
        document = json.loads(text)
    except (ValueError, RecursionError) as error:
        return None, f"not JSON: {type(error).__name__}"
    if not isinstance(document, dict):
        return None, "not an object"
    if document.get("error"):
        return None, f"feed says: {str(document['error'])[:200]}"
    if not isinstance(document.get("dishes"), list):
        return None, "no dishes"
    return text, None


def fetch(url: str, seconds: float) -> tuple[str | None, str | None]:
    try:
        with urllib.request.urlopen(url, timeout=seconds) as answer:  # noqa: S310
            body = answer.read(MOST_BYTES + 1)
    except urllib.error.HTTPError as error:
        return None, f"status {error.code}"
    except (OSError, ValueError) as error:
        return None, f"unreachable: {type(error).__name__}"
    return (None, "too large") if len(body) > MOST_BYTES else judged(body)


class FeedReader(DataSourceReader):
    def __init__(self, options, fetch: Callable[[str, float], tuple[str | None, str | None]]):
        self.urls = options.get("urls", "").split()
        self.seconds = float(options.get("seconds", SECONDS))
        self.wanted = int(options.get("partitions", MOST_PARTITIONS))
        self.fetch = fetch

    def partitions(self) -> list[Urls]:
        n = max(1, min(len(self.urls), self.wanted))
        return [Urls(self.urls[i::n]) for i in range(n)]

    def read(self, partition: Urls) -> Iterator[tuple]:
        for url in partition.urls:
            yield (url, *self.fetch(url, self.seconds))


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cost_feed"

    def schema(self) -> str:
        return "url string, body string, reason string"

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options, fetch)


def read_feed(spark: SparkSession, urls: list[str], **options: str) -> DataFrame:
    """url, reason and the typed columns of the feed, which are null where there is a reason."""
    from ..shipping import ship

    ship(spark)
    spark.dataSource.register(FeedSource)
    raw = spark.read.format("cost_feed").options(urls=" ".join(urls), **options).load()
    typed = raw.withColumn("f", F.from_json("body", FEED_SCHEMA))
    # a document of the right outline may still have values of other types
    reason = F.coalesce("reason", F.when(F.col("f.dishes").isNull(), F.lit("no dishes")))
    return typed.select("url", reason.alias("reason"), "f.*")
