"""Mixing sources to target weights by a min-cost flow over membership patterns."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import number_by
from .common import WORD, aside, documents, numbered, whole, written
from .components import components

WEIGHTS, MOST_REPEATS, SEED = (5.0, 2.0, 1.0), 3, 20
#: The seeded order of a pattern's documents is cut into 2 ** BUCKET_BITS buckets, and the one in which the quota falls into as many again; only in the last one are documents put in order.
BUCKET_BITS, CUTS = 10, 2
ROUNDS = 5
#: Patterns whose flows one task solves, if no flow has more.
PATTERNS = 4096


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """(source, size, target) of a table (source, size): all sources' words, shared by weight (dealt out by code point order, null last), no source above `most` times its size.

    What is above goes to the others by weight, until none is above. A source stops if its size is small for its weight, so each turn is one pass over the sources that makes that bound higher. Without sources no rows.
    """
    named = number_by(sizes.select("source", "size", F.col("source").isNull().alias("last"), F.coalesce("source", F.lit("")).alias("name")), "last", "name", name="k")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("k") - 1) % len(weights) + 1).cast("int"))
    shared = written(named.select("source", "size", weight.alias("weight")), "mix-sources")
    small, bound, step = F.col("size") / F.col("weight"), -1.0, 0.0
    zero = lambda c: F.coalesce(c, F.lit(0))
    while True:
        stops = small < bound
        t = shared.agg(zero(F.sum("size")).alias("all"), zero(F.sum(F.when(stops, F.col("size")))).alias("stopped"), zero(F.sum(F.when(~stops, F.col("weight")))).alias("open")).first()
        if not t.open:
            break
        step = (t.all - most * t.stopped) / t.open
        if shared.where(~stops & (F.col("weight") * step > most * F.col("size"))).isEmpty():
            break
        bound = step / most
    return shared.select("source", "size", F.when(small < bound, most * F.col("size")).otherwise(F.col("weight") * step).cast("double").alias("target"))


class Flow:
    """Min-cost flow; integer capacities, costs of 0 or more. Each phase finds the shortest distances and then fills all shortest paths at once, so there are no more phases than path costs."""

    def __init__(self):
        self.arcs: list[list] = []  # to, capacity left, cost; arc k ^ 1 is the way back
        self.out: dict[object, list[int]] = {}

    def arc(self, a: object, b: object, capacity: int, cost: int) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.arcs))
            self.out.setdefault(y, [])
            self.arcs.append([y, c, w])
        return len(self.arcs) - 2

    def taken(self, k: int) -> int:
        return self.arcs[k ^ 1][1]

    def run(self, source: object, sink: object) -> None:
        potential = dict.fromkeys(self.out, 0)
        while (far := self._distances(source, potential)).get(sink) is not None:
            reach = max(far.values())
            for x in potential:
                potential[x] += far.get(x, reach)
            while (level := self._levels(source, potential)).get(sink) is not None:
                at = dict.fromkeys(self.out, 0)  # of each node, the first of its arcs that may still lead on
                while self._fill(source, sink, potential, level, at):
                    pass

    def _open(self, x: object, k: int, potential: dict) -> bool:
        """Whether an arc has room and lies on shortest paths."""
        y, capacity, cost = self.arcs[k]
        return capacity > 0 and cost + potential[x] == potential[y]

    def _distances(self, source: object, potential: dict) -> dict:
        far, heap, tie = {source: 0}, [(0, 0, source)], 0
        while heap:
            d, _, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for k in self.out[x]:
                y, capacity, cost = self.arcs[k]
                if capacity > 0 and (new := d + cost + potential[x] - potential[y]) < far.get(y, float("inf")):
                    far[y], tie = new, tie + 1
                    heapq.heappush(heap, (new, tie, y))
        return far

    def _levels(self, source: object, potential: dict) -> dict:
        level, queue = {source: 0}, [source]
        for x in queue:
            for k in self.out[x]:
                y = self.arcs[k][0]
                if y not in level and self._open(x, k, potential):
                    level[y] = level[x] + 1
                    queue.append(y)
        return level

    def _fill(self, source: object, sink: object, potential: dict, level: dict, at: dict) -> bool:
        """Sends what fits along one path of growing levels. Arcs that are full or lead nowhere are not tried again."""
        path, x = [], source
        while x != sink:
            arcs = self.out[x]
            while at[x] < len(arcs):
                k = arcs[at[x]]
                y = self.arcs[k][0]
                if level.get(y) == level[x] + 1 and self._open(x, k, potential):
                    path.append(k)
                    x = y
                    break
                at[x] += 1
            else:
                if not path:
                    return False
                x = self.arcs[path.pop() ^ 1][0]
                at[x] += 1
        amount = min(self.arcs[k][1] for k in path)
        for k in path:
            self.arcs[k][1] -= amount
            self.arcs[k ^ 1][1] += amount
        return True


def route(patterns: dict[str, tuple[list[str | None], int]], quota: dict[str | None, float], most: int = MOST_REPEATS) -> dict[str, int]:
    """Words to take of each pattern (its sources, its words). The r-th repetition of a word costs 2 r - 1, so that repetition spreads evenly."""
    flow, levels = Flow(), {}
    for p, (members, words) in patterns.items():
        levels[p] = [flow.arc("from", ("pattern", p), words, 2 * r - 1) for r in range(1, most + 1)]
        for s in members:
            flow.arc(("pattern", p), ("source", s), most * words, 0)
    for s, words in quota.items():
        flow.arc(("source", s), "to", round(words), 0)
    if levels:
        flow.run("from", "to")
    return {p: sum(map(flow.taken, ks)) for p, ks in levels.items()}


def quotas(by_pattern: DataFrame, members: DataFrame, most: int, flow: Callable = route) -> DataFrame:
    """(pattern, words, quota): how many words to take of each pattern, by the min-cost flow. members: pattern, words, source, share (the words to take of that source).

    Sources that patterns bind together are one flow, a source that shares no pattern is one by itself; each is solved in one task, whose size is that of its patterns, not of their documents. Flows are dealt out in buckets of
    some PATTERNS patterns.
    """
    nodes = members.withColumn("node", F.xxhash64("source", F.col("source").isNull()))
    placed = nodes.withColumn("component", F.col("node"))
    total = by_pattern.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("names")), F.lit(0)).alias("widest")).first()
    if total.widest > 1:
        bound = components(nodes.groupBy("pattern").agg(F.min("node").alias("a")).join(nodes.select("pattern", F.col("node").alias("b")), "pattern").where("a != b").select("a", "b").distinct())
        named = bound.select("id", F.col("component").alias("bound"))
        placed = nodes.join(named, nodes["node"] == named["id"], "left").withColumn("component", F.coalesce("bound", "node"))

    def solve(key, rows):
        flows: dict[int, tuple[dict, dict]] = {}
        for component, p, words, s, x in zip(*(rows.column(c).to_pylist() for c in ("component", "pattern", "words", "source", "share")), strict=True):
            patterns, share = flows.setdefault(component, ({}, {}))
            patterns.setdefault(p, ([], words))[0].append(s)
            share[s] = x
        found = [(p, words, made[p]) for patterns, share in flows.values() for made in [flow(patterns, share, most)] for p, (_, words) in patterns.items()]
        return pa.Table.from_pylist([dict(zip(("pattern", "words", "quota"), x, strict=True)) for x in found], schema=pa.schema([("pattern", pa.string()), ("words", pa.int64()), ("quota", pa.int64())]))

    dealt = placed.withColumn("bucket", F.pmod("component", F.lit(total.n // PATTERNS + 1)))
    return dealt.select("bucket", "component", "pattern", "words", "source", "share").groupBy("bucket").applyInArrow(solve, "pattern string, words long, quota long")


def _cut(ranked: DataFrame, plans: DataFrame) -> DataFrame:
    """(pattern, cut, cut_begins): the bucket of draws, by CUTS times BUCKET_BITS bits, in which a pattern's rest falls, and the words before it; no row where the rest is all the pattern's words."""
    cuts = plans.where("rest > 0").select("pattern", "rest", F.lit(0).cast("long").alias("cut"), F.lit(0).cast("long").alias("cut_begins"))
    for k in range(1, CUTS + 1):
        inside = ranked.withColumn("bucket", F.shiftrightunsigned("draw", 64 - k * BUCKET_BITS)).join(cuts, "pattern").where(F.shiftrightunsigned("bucket", BUCKET_BITS) == F.col("cut"))
        counted = inside.groupBy("pattern", "bucket").agg(F.sum("size").alias("in_bucket"), F.first("rest").alias("rest"), F.first("cut_begins").alias("from"))
        before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        begins = counted.withColumn("begins", F.col("from") + F.coalesce(F.sum("in_bucket").over(before), F.lit(0)))
        reached = begins.where((F.col("begins") <= F.col("rest")) & (F.col("begins") + F.col("in_bucket") > F.col("rest")))
        cuts = written(reached.groupBy("pattern").agg(F.first("rest").alias("rest"), F.min("bucket").alias("cut"), F.min("begins").alias("cut_begins")), "mix-cuts")
    return cuts.drop("rest")


def mix(docs: DataFrame, members: Column, key: str = "doc_id", text: str = "text", weights: Sequence[float] = WEIGHTS, most: int = MOST_REPEATS, seed: int = SEED, carried: Sequence[str] = (), flow: Callable = route) -> tuple[DataFrame, DataFrame]:
    """(doc_id, pattern, size, taken) and the columns carried, of each row, and (source, size, target).

    members: the array of a row's sources, of which a null is one too; a row of several may be taken for any of them. flow: solves the patterns of sources that belong together. size: words of the text, none for a null text. taken: words that
    the mix takes of the row, its size times 0 to `most`. Which rows are taken once more than the others of their pattern is drawn by a hash of doc_id, text and seed, so a rerun agrees.
    Then, in up to ROUNDS rounds, one more row of each pattern is put in or left out where that brings the pattern's words nearer their quota. Repeated rows are rows of their own; an empty table gives no rows.
    """
    pattern = F.to_json(F.array_sort(F.array_distinct(F.coalesce(members, F.array(F.lit(None).cast("string"))))))
    body = whole(docs[text])
    draw = F.xxhash64(docs[key], body, F.lit(seed))
    sizes = written(
        docs.select(docs[key].alias("doc_id"), pattern.alias("pattern"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"), draw.alias("draw"), F.monotonically_increasing_id().alias("at"), *carried), "mix-sizes"
    )
    by_pattern = written(sizes.groupBy("pattern").agg(F.sum("size").alias("words")).withColumn("names", F.from_json("pattern", "array<string>")), "mix-patterns")
    named = by_pattern.select("pattern", "words", F.explode("names").alias("source"))
    sources = source_targets(named.groupBy("source").agg(F.sum("words").alias("size")), weights, most)
    # a word of several sources is shared out once
    t = by_pattern.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("once"), F.coalesce(F.sum(F.col("words") * F.size("names")), F.lit(0)).alias("each")).first()
    sources = written(sources.withColumn("target", F.col("target") * (t.once / max(1, t.each))), "mix-targets")
    known = sources.select(F.col("source").alias("name"), F.col("target").alias("share"))
    plans = quotas(by_pattern, named.join(known, F.col("source").eqNullSafe(F.col("name"))).drop("name"), most, flow)
    words = F.greatest("words", F.lit(1))
    plans = written(plans.select("pattern", F.floor(F.col("quota") / words).alias("times"), (F.col("quota") % words).alias("rest")), "mix-plans")
    # the buckets before the quota's are taken, those after it not; in it, documents by their draw
    planned = sizes.join(plans, "pattern").join(_cut(sizes, plans), "pattern", "left").withColumn("bucket", F.shiftrightunsigned("draw", 64 - CUTS * BUCKET_BITS))
    within = Window.partitionBy("pattern").orderBy("draw", "at").rowsBetween(Window.unboundedPreceding, -1)
    at_cut = planned.where(F.col("bucket") == F.col("cut")).withColumn("reached", F.col("cut_begins") + F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("size") / 2)
    others = planned.where(F.col("cut").isNull() | (F.col("bucket") != F.col("cut")))
    columns = ["doc_id", "pattern", "size", "draw", "at", "times", "rest", *carried]
    drawn = written(
        at_cut.select(*columns, (F.col("reached") <= F.col("rest")).alias("more")).union(
            others.select(*columns, F.when(F.col("rest") == 0, False).when(F.col("cut").isNull(), True).otherwise(F.col("bucket") < F.col("cut")).alias("more"))
        ),
        "mix-drawn",
    )
    rows, turned = drawn.select("pattern", "size", "draw", "at", "times", "more"), drawn.select("at").limit(0)
    gaps = written(drawn.groupBy("pattern").agg((F.first("rest") - F.coalesce(F.sum(F.when(F.col("more"), F.col("size"))), F.lit(0))).alias("missing")), "mix-gaps")
    for _ in range(ROUNDS):
        off = F.abs(F.col("size") - F.abs("missing"))
        puts_in = (F.col("missing") > 0) & ~F.col("more") & (F.col("times") < most)
        leaves_out = (F.col("missing") < 0) & F.col("more")
        better = rows.join(gaps.where("missing != 0"), "pattern").where((puts_in | leaves_out) & (off < F.abs("missing"))).join(turned, "at", "left_anti")
        best = written(better.groupBy("pattern").agg(F.min(F.struct(off.alias("off"), "draw", "at", "size", "more")).alias("best")), "mix-best")
        if best.isEmpty():
            break
        turned = turned.union(best.select("best.at"))
        change = F.when(F.col("best.more"), -F.col("best.size")).otherwise(F.coalesce("best.size", F.lit(0)))
        gaps = written(gaps.join(best, "pattern", "left").select("pattern", (F.col("missing") - change).alias("missing")), "mix-gaps")
    turn = written(turned.select(F.col("at").alias("turned")), "mix-turned")
    taken = F.col("size") * (F.col("times") + (F.col("more") != F.col("turned").isNotNull()).cast("long"))
    return drawn.join(turn, drawn["at"] == turn["turned"], "left").select("doc_id", "pattern", "size", taken.alias("taken"), *carried), sources


def mix_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """doc_id, size, source_size, target, taken: the mix of a table each row of which has one source (a null is a source too)."""
    rows, sources = mix(docs, F.array(docs[source]), key, text, **options)
    known = sources.select(F.to_json(F.array("source")).alias("pattern"), F.col("size").alias("source_size"), "target")
    return rows.join(known, "pattern").select("doc_id", "size", "source_size", "target", "taken")


@aside
def apply_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; rows without words are not taken."""
    own = numbered(docs, "mix-rows")
    rows, _ = mix(own, F.array(own[source]), key, text, carried=["__row"], **options)
    times = rows.where("taken > 0").select(F.col("__row").alias("__taken"), F.expr("taken div size").alias("__times"))
    chosen = own.join(times, own["__row"] == times["__taken"]).withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return chosen.select(*docs.columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(documents(spark, sf_dir))
