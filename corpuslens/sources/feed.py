"""A paged feed as a Spark data source.

``spark.dataSource.register(FeedDataSource)`` and
``spark.read.format("corpuslens_feed").option("keywords", "a,b").option("base", url).load()``:
each keyword is a partition that pages through the feed and retries when the
service asks it to wait.  ``base`` may be a folder of page dumps named
``<keyword>-<start>.json``, which is how tests and air-gapped clusters read it.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "cve_id string, cwe_ids array<string>, all_cwes array<string>, urls array<string>, description string, keyword string, published string"


def flatten(item: dict, keyword: str, targets: tuple[str, ...]) -> tuple:
    """One record of a feed page; the classes are those wanted, else the first named."""
    cve = item.get("cve") or {}
    every = [d.get("value", "") for w in cve.get("weaknesses") or [] for d in w.get("description") or [] if d.get("value", "").startswith("CWE-")]
    wanted = [c for c in every if c in targets] or every[:1]
    urls = [r.get("url", "") for r in cve.get("references") or [] if "/commit/" in r.get("url", "")]
    text = next((d.get("value") for d in cve.get("descriptions") or [] if d.get("lang") == "en"), None)
    return cve.get("id"), wanted, every, urls, text, keyword, cve.get("published")


class Keyword(InputPartition):
    def __init__(self, keyword: str) -> None:
        self.keyword = keyword


class FeedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.base = options["base"]
        self.keywords = [k.strip() for k in options.get("keywords", "").split(",") if k.strip()]
        self.page, self.wait = int(options.get("page", 100)), float(options.get("wait", 30))
        self.targets = tuple(options.get("targets", "").split(","))

    def partitions(self) -> list[Keyword]:
        return [Keyword(k) for k in self.keywords]

    def _fetch(self, keyword: str, start: int) -> dict | None:
        if "://" not in self.base or self.base.startswith("file://"):
            path = Path(self.base.removeprefix("file://"), f"{keyword}-{start}.json")
            return json.loads(path.read_text()) if path.exists() else None
        query = urllib.parse.urlencode({"keywordSearch": keyword, "startIndex": start, "resultsPerPage": self.page})
        for attempt in range(3):
            try:
                with urllib.request.urlopen(f"{self.base}?{query}", timeout=60) as r:
                    return json.load(r)
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    return None
                if attempt == 2:
                    raise
                time.sleep(self.wait)
        return None

    def read(self, partition: Keyword) -> Iterator[tuple]:
        start = 0
        while (page := self._fetch(partition.keyword, start)) and page.get("vulnerabilities"):
            for item in page["vulnerabilities"]:
                yield flatten(item, partition.keyword, self.targets)
            start += self.page
            if start >= page.get("totalResults", 0):
                break


class FeedDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpuslens_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)
