"""Exports of paged collections that many tasks share and that can be broken off.

A first pass asks for each parent's total, so a parent with very many pages is read in ranges of pages by many tasks. The ranges are
written down as a plan and read in waves; a wave is a folder that is there as a whole or not at all, and a later run goes on with the
waves that are missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rest import Bucket, PagedReader, Part, Resource, RetryAfter, all_users, asked_seconds, can_connect, members, organizations, read_paged, with_retry

PLAN = "part long, parent string, first_page int, pages int"


def plan_pages(parents: DataFrame, client, resource: Resource, total: str = "total") -> DataFrame:
    """(parent, first_page, pages) of a one-column table of parents: ranges of at most resource.pages_each pages. total: the name of the number of items in an answer that is asked for with include_totals; where an answer
    has none, the parent is one range without end (pages null). A parent that is gone (403, 404) has no range."""
    name = parents.columns[0]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket = Bucket(resource.rate / resource.tasks)
        for batch in batches:
            out = []
            for parent in batch[name]:

                def call(parent=parent):
                    bucket.acquire()
                    status, body = client.get(resource.path.format(parent=parent), {"per_page": 1, "page": 0, "include_totals": "true"})
                    if status == 429 or status >= 500:
                        raise RetryAfter(status, asked_seconds(body))
                    return status, body

                status, body = with_retry(call)
                if status < 400:
                    out.append((parent, body.get(total) if isinstance(body, dict) else None))
                elif status not in (403, 404):
                    raise RuntimeError(f"{resource.path}: status {status}")
            yield pd.DataFrame(out, columns=["parent", "total"]).astype({"total": "Int64"})

    known = parents.where(F.col(name).isNotNull()).distinct().repartition(resource.tasks, name).mapInPandas(ask, "parent string, total long")
    pages = F.ceil(F.col("total") / resource.per_page).cast("int")
    begins = F.when(pages.isNull(), F.array(F.lit(0))).when(pages > 0, F.sequence(F.lit(0), pages - 1, F.lit(resource.pages_each)))
    each = known.select("parent", pages.alias("of"), F.explode(begins).alias("first_page"))
    return each.select("parent", "first_page", F.when(F.col("of").isNotNull(), F.least(F.lit(resource.pages_each), F.col("of") - F.col("first_page"))).alias("pages"))


def read_pages(plan: DataFrame, client, resource: Resource) -> DataFrame:
    """The rows of planned ranges, which are dealt to resource.tasks tasks that share the rate. Reading again after a lost task does no harm."""
    names = [f.strip().split(" ")[0] for f in resource.schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket = Bucket(resource.rate / resource.tasks)
        reader = PagedReader(client, resource, names, 0)
        for batch in batches:
            for parent, first, pages in zip(batch["parent"], batch["first_page"], batch["pages"], strict=True):
                part = Part([parent], int(first), None if pd.isna(pages) else int(pages))
                rows = list(reader._pages(part, parent, bucket))  # of pages_each pages
                yield pd.DataFrame(rows, columns=names)

    return plan.select("parent", "first_page", "pages").repartition(resource.tasks, F.xxhash64("parent", "first_page")).mapInPandas(run, resource.schema)


def _exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def export(parents: DataFrame, client, resource: Resource, folder: str, wave: int = 64, total: str = "total") -> DataFrame:
    """The rows of all parents, from Parquet files in `folder`, each wave of `wave` ranges in one of its own.

    The plan is made by the first run and kept, so that a later one into the same folder reads just the waves that are not there yet: no row is lost or twice, as far as the collection itself stays as it was
    planned. Rows added meanwhile to a page that the plan does not have are for another export.
    """
    spark, plan_path = parents.sparkSession, f"{folder}/plan"
    if not _exists(spark, f"{plan_path}/_SUCCESS"):
        made = plan_pages(parents, client, resource, total).withColumn("part", F.monotonically_increasing_id())
        made.select(*[f.split(" ")[0] for f in PLAN.split(", ")]).write.mode("overwrite").parquet(plan_path)
    # ranges are spread over waves by a hash, so that each has those of many parents and their sizes are near each other
    plan = spark.read.schema(PLAN).parquet(plan_path)
    waves = plan.count() // wave + 1
    at = F.pmod(F.xxhash64("parent", "first_page"), F.lit(waves))
    for k in range(waves):
        path = f"{folder}/rows/wave={k:06d}"
        if not _exists(spark, f"{path}/_SUCCESS"):
            read_pages(plan.where(at == k), client, resource).write.mode("overwrite").parquet(path)
    return spark.read.schema(resource.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/rows")


class Exporter:
    """What exports users of one kind of service. A kind is made known by a subclass with a name of its own (see exporter())."""

    kind = ""
    kinds: dict[str, type[Exporter]] = {}

    def __init_subclass__(cls) -> None:
        if cls.kind:
            Exporter.kinds[cls.kind] = cls

    def __init__(self, spark: SparkSession, client, **options):
        self.spark, self.client, self.options = spark, client, options

    def validate(self) -> list[str]:
        """What is wrong before anything is exported; nothing, if it can be."""
        return []

    def export(self, folder: str) -> DataFrame:
        """User rows, from tables in `folder`; a run that was broken off goes on."""
        raise NotImplementedError(f"exports of {self.kind or type(self).__name__} are declared, but not there")


class PagedExporter(Exporter):
    """Organisations, their members and all users of a service with the collections of sources.rest: a row for each member, and one for each user who is in none."""

    kind = "paged"

    def validate(self) -> list[str]:
        return [] if can_connect(self.client) else ["the service gives no organizations"]

    def export(self, folder: str) -> DataFrame:
        orgs = read_paged(self.spark, self.client, organizations(**self.options)).select(F.col("id").alias("org_id"), F.col("name").alias("org_name"), F.col("display_name").alias("org_display_name"))
        found = export(orgs.select("org_id"), self.client, members([], **self.options), f"{folder}/members")
        users = read_paged(self.spark, self.client, all_users(**self.options))
        path = f"{folder}/users"
        if not _exists(self.spark, f"{path}/_SUCCESS"):
            users.write.mode("overwrite").parquet(path)
        each = found.select(F.col("parent").alias("org_id"), "user_id").distinct()
        return self.spark.read.schema(users.schema).parquet(path).join(each, "user_id", "left").join(orgs, "org_id", "left")


class OktaExporter(Exporter):
    kind = "okta"


class CognitoExporter(Exporter):
    kind = "cognito"


def exporter(kind: str, spark: SparkSession, client, **options) -> Exporter:
    """The exporter of a kind of service."""
    if kind not in Exporter.kinds:
        raise ValueError(f"no exporter of {kind}; there are {', '.join(sorted(Exporter.kinds))}")
    return Exporter.kinds[kind](spark, client, **options)
