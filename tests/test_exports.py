"""Exports by planned page ranges: large parents are split, and a broken off export goes on."""

import os

import pytest
from pyspark.sql import functions as F

from rosterforge.sources import exports, rest

SIZES = {"big": 9_000, "empty": 0, "s1": 1, "s100": 100, "s101": 101}


class Service:
    """Parents of given sizes; says how often each page was asked for. `gone` is not there; `untold` has no totals. A page that has a file named after it fails."""

    def __init__(self, folder):
        self.folder = str(folder)

    def get(self, path, params):
        parent = path.split("/")[2]
        if parent == "gone":
            return 404, None
        n = SIZES.get(parent, 250)
        ids = [f"{parent}-{k}" for k in range(n)][params["page"] * params["per_page"] : (params["page"] + 1) * params["per_page"]]
        if "include_totals" in params:
            with open(f"{self.folder}/asked-{os.getpid()}", "a") as f:
                f.write(f"total {parent}\n")
            return 200, {"members": ids, **({} if parent == "untold" else {"total": n})}
        if os.path.exists(f"{self.folder}/broken-{parent}-{params['page']}"):
            raise OSError("connection lost")
        with open(f"{self.folder}/asked-{os.getpid()}", "a") as f:
            f.write(f"{parent} {params['page']}\n")
        return 200, {"members": [{"user_id": i} for i in ids]}


def asked(folder):
    return sorted(x for f in os.listdir(folder) if f.startswith("asked-") for x in open(f"{folder}/{f}").read().split("\n") if x)


def resource(**more):
    return rest.Resource("/organizations/{parent}/members", "parent string, user_id string", items="members", rate=1e6, tasks=4, pages_each=10, **more)


def parents(spark):
    return spark.createDataFrame([(p,) for p in [*SIZES, "gone", "untold", "s1", None]], "id string")


def expected():
    return sorted((p, f"{p}-{k}") for p, n in {**SIZES, "untold": 250}.items() for k in range(n))


def test_a_large_parent_is_read_by_many_tasks(spark, tmp_path):
    plan = exports.plan_pages(parents(spark), Service(tmp_path), resource())
    found = sorted((r.parent, r.first_page, r.pages) for r in plan.collect())
    assert [x for x in found if x[0] == "big"] == [("big", k, 10) for k in range(0, 90, 10)] and [x for x in found if x[0] != "big"] == [("s1", 0, 1), ("s100", 0, 1), ("s101", 0, 2), ("untold", 0, None)]
    rows = exports.read_pages(plan, Service(tmp_path), resource())
    by_task = rows.where("parent = 'big'").groupBy(F.spark_partition_id()).count().collect()
    assert sorted(map(tuple, rows.collect())) == expected() and len(by_task) > 1


def test_an_export_goes_on_where_it_was_broken_off(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    client, folder = Service(tmp_path / "calls"), str(tmp_path / "out")
    (tmp_path / "calls" / "broken-big-57").touch()
    with pytest.raises(Exception, match="connection lost"):
        exports.export(parents(spark), client, resource(), folder, wave=4)
    done = {f for f in os.listdir(f"{folder}/rows") if os.path.exists(f"{folder}/rows/{f}/_SUCCESS")} if os.path.exists(f"{folder}/rows") else set()
    before = asked(tmp_path / "calls")
    (tmp_path / "calls" / "broken-big-57").unlink()
    rows = exports.export(parents(spark), client, resource(), folder, wave=4)
    assert sorted(map(tuple, rows.collect())) == expected()
    pages = [x for x in asked(tmp_path / "calls") if not x.startswith("total")]
    totals = [x for x in asked(tmp_path / "calls") if x.startswith("total")]
    assert len(totals) == len(set(totals))  # the plan was made once
    kept = spark.read.parquet(*[f"{folder}/rows/{f}" for f in done]).select("user_id").collect() if done else []
    again = {x for x in before if not x.startswith("total")} & {x for x in pages if pages.count(x) > 1}
    assert all(f"{r.user_id.rpartition('-')[0]} {int(r.user_id.rpartition('-')[2]) // 100}" not in again for r in kept)  # what was there is not read again
    assert exports.export(parents(spark), client, resource(), folder, wave=4).count() == len(expected()) and len(asked(tmp_path / "calls")) == len(pages) + len(totals)
    assert exports.export(parents(spark).limit(0), client, resource(), str(tmp_path / "none")).count() == 0


class Tenant:
    """Three organisations, one of which is gone when its members are asked for."""

    def get(self, path, params):
        if path == "/organizations":
            return 200, [{"id": f"o{k}", "name": f"n{k}"} for k in range(3)][params["page"] * params["per_page"] :][: params["per_page"]]
        if path == "/users":
            return 200, [{"user_id": f"u{k}", "email": f"{k}@x.com"} for k in range(5)][params["from"] :]
        of = {"/organizations/o0/members": ["u0", "u1"], "/organizations/o1/members": ["u1"]}.get(path)
        return (200, [{"user_id": u} for u in of][params["page"] * params["per_page"] :][: params["per_page"]]) if of else (404, None)


def test_exporters(spark, tmp_path):
    made = exports.exporter("paged", spark, Tenant(), rate=1e6, tasks=2)
    assert made.validate() == []
    for _ in range(2):
        rows = sorted((r.user_id, r.email, r.org_id or "", r.org_name or "") for r in made.export(str(tmp_path / "out")).collect())
        assert rows == [("u0", "0@x.com", "o0", "n0"), ("u1", "1@x.com", "o0", "n0"), ("u1", "1@x.com", "o1", "n1"), *((f"u{k}", f"{k}@x.com", "", "") for k in (2, 3, 4))]
    with pytest.raises(NotImplementedError, match="okta"):
        exports.exporter("okta", spark, None).export(str(tmp_path))
    with pytest.raises(ValueError, match="cognito, okta, paged"):
        exports.exporter("else", spark, None)
