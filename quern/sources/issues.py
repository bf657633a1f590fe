"""Issue tracker source: closed issues and their comments over REST, one partition per repository."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ISSUES = "repo string, issue bigint, title string, body string, url string, comment_ord int, comment string, reactions map<string,int>"


class RepoPartition(InputPartition):
    def __init__(self, repo: str):
        self.repo = repo


class IssueSource(DataSource):
    """spark.read.format("issues").option("repos", "a/b,c/d").option("base", url).load(), after spark.dataSource.register.

    Options: repos, base (https://... or file:///... with the same layout), token, max_issues (per repository), retries,
    page_size. Rows are one per comment; issues without comments have one row with a null comment. Pull requests are
    left out. Paging stops at a short page.
    """

    @classmethod
    def name(cls) -> str:
        return "issues"

    def schema(self) -> str:
        return ISSUES

    def reader(self, schema) -> DataSourceReader:
        return IssueReader(self.options)


class IssueReader(DataSourceReader):
    def __init__(self, options):
        self.repos = [r for r in options.get("repos", "").split(",") if r]
        self.base = options.get("base", "").rstrip("/")
        self.token = options.get("token")
        self.max_issues = int(options.get("max_issues", 100))
        self.page_size = int(options.get("page_size", 100))
        self.retries = int(options.get("retries", 5))

    def partitions(self) -> list[RepoPartition]:
        return [RepoPartition(r) for r in self.repos]

    def _get(self, path: str):
        request = urllib.request.Request(f"{self.base}/{path}", headers={"Authorization": f"Bearer {self.token}"} if self.token else {})
        for attempt in range(self.retries):
            try:
                with urllib.request.urlopen(request, timeout=30) as r:
                    return json.load(r)
            except urllib.error.HTTPError as e:
                if e.code != 403:
                    return None
                time.sleep(min(60, 2**attempt))
            except (urllib.error.URLError, ValueError):
                return None
        return None

    def read(self, partition: RepoPartition) -> Iterator[tuple]:
        taken, page = 0, 1
        while taken < self.max_issues:
            rows = self._get(f"repos/{partition.repo}/issues/page_{page}.json" if self.base.startswith("file:") else f"repos/{partition.repo}/issues?state=closed&sort=comments&direction=desc&per_page={self.page_size}&page={page}")
            if not rows:
                return
            issues = [r for r in rows if "pull_request" not in r]
            for r in issues[: self.max_issues - taken]:
                number = r["number"]
                found = self._get(f"repos/{partition.repo}/issues/{number}/comments" + (".json" if self.base.startswith("file:") else "?per_page=30")) or []
                head = (partition.repo, number, r.get("title"), r.get("body"), r.get("html_url"))
                for i, c in enumerate(found[:30]):
                    counts = {k: int(v) for k, v in (c.get("reactions") or {}).items() if isinstance(v, int)}
                    yield (*head, i, c.get("body"), counts)
                if not found:
                    yield (*head, None, None, None)
            taken += len(issues)
            if len(rows) < self.page_size or not issues:
                return
            page += 1
