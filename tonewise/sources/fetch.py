"""Profile pages over HTTP, one partition of users a task.

``PageSource`` is a data source for a list of users::

    spark.dataSource.register(PageSource)
    spark.read.format("profile_pages").option("users", "ann,bob").load()

and ``fetched`` does the same for a table of users of any size. Both give
(username, html, status, error, attempts), and what they give can go to
``timeline.parse_pages``. A user is asked for up to ``attempts`` times: after no
answer at all, 429 or 503, waiting ``backoff`` seconds and then twice as long each
time, with the next agent. Any other status is an answer and ends it. A user that
can't be fetched is a row with its error, not a failed task.

Options (strings): ``users`` (with commas), ``perPartition`` (users a task, 20),
``url`` (with ``{username}``), ``attempts``, ``backoff``, ``timeout``, ``proxy``, and
``transport``: ``module:function``, which gets the options in the task and gives a
function (url, headers, timeout) -> (status, body) that raises ``OSError`` where no
answer comes. Defined cases: repeated and blank names are asked for once and not
at all; a null name in a table is left out.
"""

from __future__ import annotations

import importlib
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The address of a public timeline, attempts, seconds before the second one, seconds to wait, statuses that are tried again.
URL = "https://syndication.twitter.com/srv/timeline-profile/screen-name/{username}"
ATTEMPTS, BACKOFF, TIMEOUT = 3, 1.5, 15
AGAIN = (429, 503)
# The systems that agents name, in the order in which they are tried.
SYSTEMS = ("Windows NT 10.0; Win64; x64", "Macintosh; Intel Mac OS X 10_15_7", "X11; Linux x86_64")
AGENTS = tuple(f"Mozilla/5.0 ({x}) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36" for x in SYSTEMS)

Transport = Callable[[str, dict, float], tuple[int, str]]
SCHEMA = "username string, html string, status int, error string, attempts int"
PER_PARTITION = 20


def over_http(options: dict) -> Transport:
    """The standard library's client, through ``proxy`` if there is one."""
    proxy = options.get("proxy")
    opener = urllib.request.build_opener(urllib.request.ProxyHandler({"http": proxy, "https": proxy} if proxy else {}))

    def get(url: str, headers: dict, timeout: float) -> tuple[int, str]:
        try:
            with opener.open(urllib.request.Request(url, headers=headers), timeout=timeout) as answer:
                return answer.status, answer.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:  # an answer, though not a page
            return e.code, ""

    return get


def transport_of(options: dict) -> Transport:
    module, _, name = options.get("transport", f"{__name__}:{over_http.__name__}").partition(":")
    return getattr(importlib.import_module(module), name)(options)


def fetch(username: str, get: Transport, options: dict, sleep: Callable[[float], None] = time.sleep) -> tuple:
    """One row of ``SCHEMA``."""
    most, pause, timeout = int(options.get("attempts", ATTEMPTS)), float(options.get("backoff", BACKOFF)), float(options.get("timeout", TIMEOUT))
    url = options.get("url", URL).replace("{username}", urllib.parse.quote(username, safe=""))
    status, body, error, tried = None, None, None, 0
    while tried < most:
        if tried:
            sleep(pause * 2 ** (tried - 1))
        headers = {"User-Agent": AGENTS[tried % len(AGENTS)], "Accept": "text/html"}
        tried += 1
        try:
            status, body = get(url, headers, timeout)
            error = None
        except OSError as e:
            status, body, error = None, None, f"no answer: {e}"
            continue
        if status not in AGAIN:
            break
    if error is None and status != 200:
        error = {404: "not found", 429: "too many requests", 503: "too many requests"}.get(status, f"status {status}")
    return username, body if status == 200 else None, status, error, tried


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"username": pa.string(), "html": pa.string(), "status": pa.int32(), "error": pa.string(), "attempts": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        names = list(dict.fromkeys(filter(None, map(str.strip, self.options.get("users", "").split(",")))))
        size = int(self.options.get("perpartition", PER_PARTITION))
        return [InputPartition(names[i : i + size]) for i in range(0, len(names), size)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        get = transport_of(self.options)
        for name in partition.value:
            yield _batch([fetch(name, get, self.options)])


class PageSource(DataSource):
    """Profile pages of the users that an option lists."""

    @classmethod
    def name(cls) -> str:
        return "profile_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader({k.lower(): v for k, v in self.options.items()})


def fetched(users: DataFrame, options: dict | None = None, column: str = "username", tasks: int = 8) -> DataFrame:
    """Pages of a table of users; ``tasks`` bounds how many are asked for at once."""
    options = {k.lower(): v for k, v in (options or {}).items()}
    names = users.select(F.trim(F.col(column).cast("string")).alias("username")).where(F.col("username") != "").distinct().repartition(tasks, "username")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = transport_of(options)
        for b in batches:
            for name in b.column("username").to_pylist():
                yield _batch([fetch(name, get, options)])

    return names.mapInArrow(run, SCHEMA)
