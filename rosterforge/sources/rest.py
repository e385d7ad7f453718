"""Paged REST sources as a Spark data source. The HTTP client is injected: any picklable object with get(path, params) -> (status, JSON), so tests need no network."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass
class Token:
    """A client-credentials token that is asked for anew `early` seconds before it ends."""

    fetch: object
    early: float = 300.0
    lifetime: float = 86_400.0
    value: str | None = None
    until: float = 0.0

    def get(self, now: float | None = None) -> str:
        now = time.time() if now is None else now
        if self.value is None or now >= self.until:
            self.value, seconds = self.fetch()
            self.until = now + (seconds or self.lifetime) - self.early
        return self.value


class Bucket:
    """A token bucket: `rate` calls a second, `burst` at once. Each task has its own, with its share of the whole rate."""

    def __init__(self, rate: float, burst: float | None = None, clock=time.monotonic, sleep=time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, max(1.0, burst or rate), clock, sleep
        self.tokens, self.at = self.burst, clock()

    def acquire(self) -> None:
        now = self.clock()
        self.tokens = min(self.burst, self.tokens + (now - self.at) * self.rate)
        self.at = now
        if self.tokens < 1:
            wait = (1 - self.tokens) / self.rate
            self.sleep(wait)
            self.tokens, self.at = 1.0, self.at + wait
        self.tokens -= 1


class RetryAfter(Exception):
    """An answer that asks to come again: status, and seconds if the server says so."""

    def __init__(self, status: int, seconds: float | None = None):
        super().__init__(f"status {status}")
        self.status, self.seconds = status, seconds


def asked_seconds(body) -> float | None:
    """The seconds after which an answer asks to come again: its retry_after or Retry-After, if it is a number of 0 or more."""
    value = next((body[k] for k in ("retry_after", "Retry-After", "retry-after") if k in body), None) if isinstance(body, dict) else None
    try:
        return float(value) if value is not None and float(value) >= 0 else None
    except (TypeError, ValueError):
        return None


def with_retry(call, tries: int = 3, base: float = 0.5, sleep=time.sleep):
    """call(), again after a 429 or a server error: after the time the server asks for, else after base, 2 base, 4 base ..."""
    for n in range(tries):
        try:
            return call()
        except RetryAfter as e:
            if n + 1 == tries or not (e.status == 429 or e.status >= 500):
                raise
            sleep(e.seconds if e.seconds is not None else base * 2**n)


@dataclass
class Resource:
    """A paged collection. path may name a parent, {parent}; parents are split among tasks, a collection without parents by page ranges of `pages_each`. tasks: how many run at a time and share the rate; parents make no more parts than that."""

    path: str
    schema: str
    items: str | None = None
    per_page: int = 100
    parents: list[str] = field(default_factory=list)
    pages_each: int = 50
    cursor: str | None = None
    fields: bool = False
    offset: str | None = None
    rate: float = 50.0
    tasks: int = 8


@dataclass
class Part(InputPartition):
    parents: list[str | None]
    first_page: int
    pages: int | None


class PagedReader(DataSourceReader):
    def __init__(self, client, resource: Resource, names: list[str], total_pages: int):
        self.client, self.resource, self.names, self.total_pages = client, resource, names, total_pages

    def partitions(self) -> list[Part]:
        r = self.resource
        if r.parents:
            return [Part(list(r.parents[k :: r.tasks]), 0, None) for k in range(min(r.tasks, len(r.parents)))]
        if r.cursor or not self.total_pages:
            return [Part([None], 0, None)]
        return [Part([None], k, min(r.pages_each, self.total_pages - k)) for k in range(0, self.total_pages, r.pages_each)]

    def read(self, part: Part) -> Iterator[tuple]:
        bucket = Bucket(self.resource.rate / max(1, min(self.resource.tasks, len(self.partitions()))))
        for parent in part.parents:
            yield from self._pages(part, parent, bucket)

    def _pages(self, part: Part, parent: str | None, bucket: Bucket) -> Iterator[tuple]:
        r = self.resource
        page, after = part.first_page, None
        while part.pages is None or page < part.first_page + part.pages:
            params = {"per_page": r.per_page}
            if r.cursor:
                params[r.cursor] = after
            elif r.offset:
                params[r.offset] = page * r.per_page
            else:
                params["page"] = page
            if r.fields:
                params["fields"] = ",".join(self.names)

            def call(params=params):
                bucket.acquire()
                status, body = self.client.get(r.path.format(parent=parent), params)
                if status == 429 or status >= 500:
                    raise RetryAfter(status, asked_seconds(body))
                return status, body

            status, body = with_retry(call)
            if status in (403, 404):
                return
            if status >= 400:
                raise RuntimeError(f"{r.path}: status {status}")
            rows = body[r.items] if r.items else body
            for row in rows:
                yield tuple(parent if n == "parent" else row.get(n) for n in self.names)
            after = body.get("after") if r.cursor else None
            if (r.cursor and not after) or (not r.cursor and len(rows) < r.per_page):
                return
            page += 1


def paged_source(client, resource: Resource, total_pages: int = 0) -> type[DataSource]:
    """A data source class for one resource."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return "paged_rest"

        def schema(self) -> str:
            return resource.schema

        def reader(self, schema) -> PagedReader:
            return PagedReader(client, resource, schema.fieldNames(), total_pages)

    return Paged


def read_paged(spark: SparkSession, client, resource: Resource, total_pages: int = 0) -> DataFrame:
    spark.dataSource.register(paged_source(client, resource, total_pages))
    return spark.read.format("paged_rest").load()


# The collections that exports read.
def organizations(**options) -> Resource:
    return Resource("/organizations", "id string, name string, display_name string", **options)


def members(org_ids: list[str], **options) -> Resource:
    return Resource("/organizations/{parent}/members", "parent string, user_id string", parents=org_ids, **options)


def all_users(**options) -> Resource:
    return Resource("/users", "user_id string, email string, name string, given_name string, family_name string", fields=True, offset="from", **options)


def roles(org_ids: list[str], **options) -> Resource:
    return Resource("/organizations/{parent}/roles", "parent string, slug string, name string", items="data", parents=org_ids, cursor="after", **options)


def can_connect(client) -> bool:
    status, _ = client.get("/organizations", {"per_page": 1, "page": 0})
    return status == 200


def point_lookup(keys: DataFrame, client, path: str, schema: str, rate: float = 50.0, tasks: int = 8) -> DataFrame:
    """One call per distinct key of a one-column table; a key that the server does not know or may not tell gives no row. schema: the key column, then what the answer has. The keys are dealt to `tasks` tasks, which share the rate."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    key = keys.columns[0]

    def run(batches):
        import pandas as pd

        bucket = Bucket(rate / tasks)
        for batch in batches:
            out = []
            for k in batch[key]:

                def call(k=k):
                    bucket.acquire()
                    status, body = client.get(path.format(key=k), {})
                    if status == 429 or status >= 500:
                        raise RetryAfter(status, asked_seconds(body))
                    return status, body

                status, body = with_retry(call)
                if status == 200:
                    out.append([k, *(body.get(n) for n in names[1:])])
            yield pd.DataFrame(out, columns=names)

    return keys.distinct().repartition(tasks, key).mapInPandas(run, schema)
