"""Commits of code repositories as a Spark data source.

``spark.dataSource.register(CommitDataSource)`` and
``spark.read.format("corpuslens_commits").option("base", url).option("repos", "o/a,o/b").load()``:
each repository is a partition.  Its list of commits is paged, and of every
commit whose message is on a security fix the detail is read, which has the
patches of its files; ``contents`` adds each source file as it was at the
commit and at its parent.  A service that asks to wait is waited for, what it
doesn't have is left out.  ``base`` may be a folder with the same answers in
files (``commits-<page>.json``, ``commits-<sha>.json`` and
``contents-<sha>/<path>.json`` in a folder per repository, the parent of a
commit written ``<sha>^``), which is how tests and air-gapped clusters read it.
"""

from __future__ import annotations

import base64
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpuslens.functions.code import NOISE_WORDS, SECURITY_WORDS

SCHEMA = "repo string, sha string, message string, filename string, patch string, before string, after string"
SOURCE_FILES = (".c", ".cpp", ".cc", ".cxx", ".h", ".hpp", ".py")


def on_security(message: str) -> bool:
    """As ``functions.code.security_message``, for one message."""
    low = (message or "").lower()
    return not any(w in low for w in NOISE_WORDS) and any(w in low for w in SECURITY_WORDS)


def content(answer: dict | None) -> str | None:
    """Text of a contents answer; null unless it is base64, bytes that aren't UTF-8 become replacement characters."""
    if not answer or answer.get("encoding") != "base64":
        return None
    try:
        return base64.b64decode(answer.get("content") or "").decode("utf-8", errors="replace")
    except ValueError:
        return None


class Repository(InputPartition):
    def __init__(self, name: str) -> None:
        self.name = name


class CommitReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.base = options["base"]
        self.repos = [r.strip() for r in options.get("repos", "").split(",") if r.strip()]
        self.pages, self.page, self.wait = int(options.get("pages", 5)), int(options.get("page", 100)), float(options.get("wait", 60))
        self.contents, self.token = options.get("contents", "false").lower() == "true", options.get("token")

    def partitions(self) -> list[Repository]:
        return [Repository(r) for r in self.repos]

    def _fetch(self, repo: str, what: str, file: str, **query) -> dict | list | None:
        if "://" not in self.base or self.base.startswith("file://"):
            path = Path(self.base.removeprefix("file://"), repo, file)
            return json.loads(path.read_text()) if path.exists() else None
        url = f"{self.base}/repos/{repo}/{urllib.parse.quote(what)}" + (f"?{urllib.parse.urlencode(query)}" if query else "")
        request = urllib.request.Request(url, headers={"Authorization": f"Bearer {self.token}"} if self.token else {})
        for attempt in range(3):
            try:
                with urllib.request.urlopen(request, timeout=30) as r:
                    return json.load(r)
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    return None
                if e.code not in (403, 429, 500, 502, 503) or attempt == 2:
                    raise
                time.sleep(max(float(e.headers.get("X-RateLimit-Reset", 0)) - time.time(), 0) + 5 if e.code == 403 else self.wait)
        return None

    def read(self, partition: Repository) -> Iterator[tuple]:
        repo, seen = partition.name, set()
        for page in range(1, self.pages + 1):
            commits = self._fetch(repo, "commits", f"commits-{page}.json", per_page=self.page, page=page)
            if not commits:
                break
            for c in commits:
                sha, message = c["sha"], (c.get("commit") or {}).get("message", "")
                if sha in seen or not on_security(message):
                    continue
                seen.add(sha)
                detail = self._fetch(repo, f"commits/{sha}", f"commits-{sha}.json") or {}
                for f in detail.get("files") or []:
                    name, patch = f.get("filename", ""), f.get("patch")
                    if patch and Path(name).suffix.lower() in SOURCE_FILES:
                        sides = [content(self._fetch(repo, f"contents/{name}", f"contents-{ref}/{name}.json", ref=ref)) for ref in (f"{sha}^", sha)] if self.contents else [None, None]
                        yield repo, sha, message, name, patch, *sides


class CommitDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpuslens_commits"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CommitReader:
        return CommitReader(self.options)
