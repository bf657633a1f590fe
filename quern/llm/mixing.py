"""Problem 7: mix overlapping sources to target shares by min-cost flow."""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import token_count
from ..session import ensure_checkpoint_dir

PLAN = "pattern string, source_name string, start double, flow double, pattern_tokens bigint"


class Network:
    """Min-cost flow by successive shortest paths; a few hundred nodes at most."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[float] = []

    def add(self, a: int, b: int, room: int, cost: float) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> int:
        """Push all that fits at least cost; the flow of arc k is room[k + 1]."""
        total = 0
        while True:
            best = [math.inf] * len(self.out)
            via = [-1] * len(self.out)
            queued = [False] * len(self.out)
            best[source] = 0.0
            queue = deque([source])
            while queue:
                x = queue.popleft()
                queued[x] = False
                for k in self.out[x]:
                    y = self.to[k]
                    if self.room[k] > 0 and best[x] + self.cost[k] < best[y] - 1e-9:
                        best[y], via[y] = best[x] + self.cost[k], k
                        if not queued[y]:
                            queued[y] = True
                            queue.append(y)
            if via[sink] < 0:
                return total
            push, x = None, sink
            while x != source:
                push = self.room[via[x]] if push is None else min(push, self.room[via[x]])
                x = self.to[via[x] ^ 1]
            x = sink
            while x != source:
                self.room[via[x]] -= push
                self.room[via[x] ^ 1] += push
                x = self.to[via[x] ^ 1]
            total += push


def route(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int) -> tuple[int, dict[tuple[tuple[str, ...], str], int]]:
    """Tokens that each pattern gives to each of its sources for a mix of `total` tokens, and how many tokens that is.

    Source node -> pattern: the k-th use of the pattern's tokens costs k - 1 (convex). Pattern -> source: at most
    max_repeats times the pattern's tokens. Source -> sink: the source's quota.
    """
    names = sorted(targets)
    keys = sorted(patterns)
    net = Network(2 + len(keys) + len(names))
    at = {s: 2 + len(keys) + i for i, s in enumerate(names)}
    arcs = {}
    for i, key in enumerate(keys):
        most = sum(targets[s][1] for s in key)
        for k in range(most):
            net.add(0, 2 + i, patterns[key], float(k))
        for s in key:
            arcs[key, s] = net.add(2 + i, at[s], patterns[key] * targets[s][1], 0.0)
    for s in names:
        net.add(at[s], 1, int(targets[s][0] * total), 0.0)
    moved = net.run(0, 1)
    return moved, {k: net.room[a + 1] for k, a in arcs.items() if net.room[a + 1] > 0}


def largest_total(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]]) -> int:
    """The largest mix in which every source reaches its share within the caps (bisection on the flow)."""
    lo, hi = 0, sum(t * sum(targets[s][1] for s in key) for key, t in patterns.items())
    while hi - lo > max(1, lo // 100_000):
        mid = (lo + hi + 1) // 2
        moved, _ = route(patterns, targets, mid)
        if moved >= sum(int(share * mid) for share, _ in targets.values()):
            lo = mid
        else:
            hi = mid - 1
    return lo


def mix_sources(
    documents: DataFrame,
    targets: DataFrame,
    tokens: Column | None = None,
    total_tokens: int | None = None,
    seed: int = 17,
    buckets: int = 4096,
    max_patterns: int = 20_000,
    doc_id: str = "doc_id",
) -> DataFrame:
    """A selection with repetitions: (doc_id, source_name, repeats, tokens, target_share, target_tokens).

    Method: equal texts count once; the sources that list a text are its membership pattern, and all texts of a pattern
    are one node of a min-cost flow that routes token capacity to the sources' quotas, where using tokens again costs
    more each time. Only the patterns' sums reach the driver (at most 2^sources of them; they and the targets are
    checked against `max_patterns`, beyond it is an error); texts, sums and the selection stay on the executors. Within a pattern the texts lie in an order
    seeded by their hash on a ring of its tokens, and each source takes one arc of the ring as long as its flow, so a
    text is used floor or ceiling of flow / tokens times, never more than max_repeats. The ring's positions are prefix
    sums in two levels (hash buckets, then texts within a bucket), so a pattern with most of the rows is not one task.

    Without `total_tokens` the mix is the largest in which every share can be met within the caps; with it, sources
    that run out are short. A text is given under the smallest doc_id that has it in that source. Source names are
    compared in lower case without outer blanks. Null texts, null or unlisted sources, texts without tokens, targets
    with a null or non-positive share or cap give nothing; shares are scaled to sum to 1; of repeated targets the
    greatest counts. `tokens` defaults to the count of default tokens in column text.
    """
    spark = documents.sparkSession
    ensure_checkpoint_dir(spark)
    name = lambda c: F.lower(F.trim(F.col(c)))
    wanted = (
        targets.where("source_name is not null and target_share > 0 and max_repeats > 0")
        .groupBy(name("source_name").alias("source_name"))
        .agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap"))
        .limit(max_patterns + 1)
        .collect()
    )
    if len(wanted) > max_patterns:
        raise ValueError(f"more than {max_patterns} targets")
    whole = sum(r["share"] for r in wanted) or 1.0
    goals = {r["source_name"]: (r["share"] / whole, r["cap"]) for r in wanted}
    count = token_count(F.col("text")) if tokens is None else tokens
    listed = (
        documents.withColumn("source_name", name("source"))
        .where(F.col("text").isNotNull() & F.col("source_name").isin(list(goals)))
        .select(F.md5("text").alias("text_hash"), "source_name", F.col(doc_id).alias("doc_id"), count.alias("tokens"))
        .where("tokens > 0")
    )
    texts = (
        listed.groupBy("text_hash", "source_name")
        .agg(F.min("doc_id").alias("doc_id"), F.first("tokens").alias("tokens"))
        .groupBy("text_hash")
        .agg(
            F.first("tokens").alias("tokens"),
            F.array_sort(F.collect_list(F.struct("source_name", "doc_id"))).alias("members"),
        )
        .withColumn("pattern", F.concat_ws("\x1f", F.col("members.source_name")))
        .withColumn("place", F.xxhash64("text_hash", F.lit(seed)))
        .withColumn("bucket", F.pmod("place", F.lit(buckets)))
        .checkpoint()
    )
    sums = texts.groupBy("pattern").agg(F.sum("tokens").alias("tokens")).limit(max_patterns + 1).collect()
    if len(sums) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    patterns = {tuple(r["pattern"].split("\x1f")): r["tokens"] for r in sums}
    total = largest_total(patterns, goals) if total_tokens is None else total_tokens
    _, flows = route(patterns, goals, total)
    plan, start = [], {}
    for (key, source), flow in sorted(flows.items()):
        plan.append(("\x1f".join(key), source, float(start.get(key, 0)), float(flow), patterns[key]))
        start[key] = start.get(key, 0) + flow
    arcs = spark.createDataFrame(plan, PLAN)
    # positions on the ring: sums of the buckets before, then of the texts before in the bucket
    by_bucket = texts.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("n"))
    before = by_bucket.withColumn("base", F.sum("n").over(W.partitionBy("pattern").orderBy("bucket")) - F.col("n")).drop("n")
    inside = W.partitionBy("pattern", "bucket").orderBy("place", "text_hash").rowsBetween(W.unboundedPreceding, 0)
    placed = (
        texts.withColumn("upto", F.sum("tokens").over(inside))
        .join(before, ["pattern", "bucket"])
        .withColumn("middle", F.col("base") + F.col("upto") - F.col("tokens") / 2)
    )
    # integers k with start <= middle + k * pattern_tokens < start + flow
    first = F.ceil((F.col("start") - F.col("middle")) / F.col("pattern_tokens"))
    end = F.ceil((F.col("start") + F.col("flow") - F.col("middle")) / F.col("pattern_tokens"))
    chosen = (
        placed.join(F.broadcast(arcs), "pattern")
        .withColumn("repeats", (end - first).cast("int"))
        .where("repeats > 0")
        .withColumn("member", F.element_at(F.filter("members", lambda m: m["source_name"] == F.col("source_name")), 1))
    )
    share = F.create_map(*[F.lit(x) for s, (v, _) in goals.items() for x in (s, v)]) if goals else F.create_map()
    return chosen.select(
        F.col("member.doc_id").alias("doc_id"),
        "source_name",
        "repeats",
        "tokens",
        (F.element_at(share, F.col("source_name")) if goals else F.lit(None).cast("double")).alias("target_share"),
        F.lit(int(total)).cast("bigint").alias("target_tokens"),
    )


def mix_shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """Reached against wanted: source_name, target_share, max_repeats, reached_tokens, reached_share, n_docs, most_repeats."""
    used = mix.groupBy("source_name").agg(
        F.sum(F.col("tokens") * F.col("repeats")).alias("reached_tokens"), F.count("*").alias("n_docs"), F.max("repeats").alias("most_repeats")
    )
    all_tokens = used.agg(F.sum("reached_tokens").alias("all_tokens"))
    wanted = targets.select(F.lower(F.trim("source_name")).alias("source_name"), "target_share", "max_repeats")
    return (
        wanted.join(used, "source_name", "left")
        .crossJoin(F.broadcast(all_tokens))
        .select(
            "source_name",
            "target_share",
            "max_repeats",
            F.coalesce("reached_tokens", F.lit(0)).alias("reached_tokens"),
            (F.coalesce("reached_tokens", F.lit(0)) / F.greatest("all_tokens", F.lit(1))).alias("reached_share"),
            F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
            F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        )
    )
