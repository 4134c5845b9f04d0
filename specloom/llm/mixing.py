"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the sources they belong to). A flow routes token capacity from the
patterns to the sources' quotas: a pattern's first pass over its words costs 0 a word, each further pass one more
(convex repetition costs), up to ``repeats`` passes. The network has one node a pattern and a source, and is solved on the driver. Only patterns
that share a source with another one take part, at most ``most`` of them; a pattern that has its one source to itself gives
what its quota asks, up to ``repeats`` passes, which is what the flow would say. The driver holds a row a source and pattern. A pattern that must give x of its S words gives every document
floor(x / S) times, and once more the documents of least seeded hash until the rest of x is reached: hash ranges are
summed first, and only the documents of the range where the sum is reached are sorted, so no task holds a whole source.

Null text: size 0, never taken. A null source is a source of its own, sorted last. A null doc_id is a key like any
other; of rows with equal ids that meet the end of the quota together, each is judged by its size in turn. Rows of equal id and text
come as often as the one of them that is taken least. One task sums the ranges (``range_rows`` rows each) of a pattern. Sources
without words have target 0. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specloom.llm.common import WORD, free, hash64, save

#: The weights that the sources get in turn.
WEIGHTS = (5, 2, 1)


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> list[float]:
    """Splits ``share`` of all sizes by weight; what is above ``most`` times a source's size is shared again."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    left, out, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        total = sum(weight[i] for i in open_)
        over = {i for i in open_ if left * weight[i] / total > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weight[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ -= over
    return out


def min_cost_flow(capacity: dict[frozenset[int], int], quota: list[float], repeats: int = 2) -> dict[frozenset[int], float]:
    """Words to take from each pattern: successive cheapest paths over patterns (passes cost 0, 1, ...) and sources."""
    s, t = "s", "t"
    graph: dict = defaultdict(dict)  # node -> node -> list of [capacity, cost, reverse]
    arcs: list[list] = []

    def arc(a, b, cap: float, cost: int) -> None:
        for u, v, c, w in ((a, b, cap, cost), (b, a, 0.0, -cost)):
            graph[u].setdefault(v, []).append(len(arcs))
            arcs.append([u, v, c, w])

    for p, n in sorted(capacity.items(), key=lambda x: sorted(x[0])):
        for k in range(repeats):
            arc(s, ("p", p), float(n), k)
        for i in sorted(p):
            arc(("p", p), ("q", i), float("inf"), 0)
    for i, q in enumerate(quota):
        arc(("q", i), t, float(q), 0)
    least = 1e-6
    potential: dict = defaultdict(int)
    while True:
        far, via, heap, tick = {s: 0}, {}, [(0, 0, s)], 0
        while heap:
            d, _, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for v, ids in graph[u].items():
                for a in ids:
                    if arcs[a][2] > least and (nd := d + arcs[a][3] + potential[u] - potential[v]) < far.get(v, float("inf")):
                        far[v], via[v] = nd, a
                        tick += 1
                        heapq.heappush(heap, (nd, tick, v))
        if t not in far:
            break
        for v, d in far.items():
            potential[v] += d
        path, v = [], t
        while v != s:
            path.append(via[v])
            v = arcs[via[v]][0]
        flow = min(arcs[a][2] for a in path)
        for a in path:
            arcs[a][2] -= flow
            arcs[a ^ 1][2] += flow
    taken: dict[frozenset[int], float] = defaultdict(float)
    for a in range(0, len(arcs), 2):
        if arcs[a][0] == s:
            taken[arcs[a][1][1]] += arcs[a + 1][2]
    return dict(taken)


def mix(docs: DataFrame, sources: F.Column | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2, seed: int = 42, most: int = 10_000, range_rows: int = 2_000) -> DataFrame:
    """(doc_id, sources, size, copies): how often the mix takes each document.

    ``sources`` is an array column of memberships (default: the one source of ``source``).
    """
    of = sources if sources is not None else F.array("source")
    sized = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.array_sort(F.array_distinct(of)).alias("sources"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint").alias("size"))
    sized = save(sized.withColumn("pattern", F.to_json("sources")).withColumn("h", F.shiftrightunsigned(hash64(seed, F.coalesce("doc_id", F.lit(-1))), 33).cast("bigint")), "sizes")
    patterns = sized.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    names = sorted({x for p in patterns for x in p["sources"]}, key=lambda x: (x is None, x or ""))
    at = {x: i for i, x in enumerate(names)}
    capacity = {frozenset(at[x] for x in p["sources"]): p["size"] for p in patterns}
    size_of = [sum(n for p, n in capacity.items() if i in p) for i in range(len(names))]
    quota = targets(size_of, weights, share, repeats)
    shared = Counter(i for p in capacity for i in p)
    alone = {p for p in capacity if len(p) == 1 and shared[next(iter(p))] == 1}
    if len(capacity) - len(alone) > most:
        raise ValueError(f"more than {most} overlapping membership patterns")
    taken = min_cost_flow({p: n for p, n in capacity.items() if p not in alone}, quota, repeats)
    taken |= {p: min(quota[next(iter(p))], float(repeats * capacity[p])) for p in alone}

    spark = docs.sparkSession
    plan = []
    for p in patterns:
        x, n = taken.get(frozenset(at[s] for s in p["sources"]), 0.0), p["size"]
        whole = min(repeats, int(x // n + 1e-9)) if n else 0
        ranges = max(1, p["n"] // range_rows)
        plan.append((p["pattern"], whole, max(0.0, float(x - whole * n)) if whole < repeats else 0.0, ranges))
    plan_df = spark.createDataFrame(plan, "pattern string, whole int, rest double, ranges long")
    marked = sized.join(F.broadcast(plan_df) if len(plan) <= most else plan_df, "pattern").withColumn("r", (F.col("h") * F.col("ranges") / F.lit(float(1 << 31))).cast("bigint"))
    by = W.partitionBy("pattern").orderBy("r").rowsBetween(W.unboundedPreceding, -1)
    spans = marked.groupBy("pattern", "r").agg(F.sum("size").alias("words"), F.first("rest").alias("limit")).withColumn("before", F.coalesce(F.sum("words").over(by), F.lit(0)))
    spans = spans.select("pattern", "r", "before", (F.col("before") + F.col("words") <= F.col("limit")).alias("inside"), (F.col("before") >= F.col("limit")).alias("outside"))
    placed = marked.join(spans, ["pattern", "r"])
    edge = W.partitionBy("pattern", "r").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    last = placed.where("not inside and not outside").withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(edge), F.lit(0)))
    cols = ["doc_id", "sources", "size"]
    even = placed.where("inside or outside").select(*cols, (F.col("whole") + F.when(F.col("inside") & (F.col("rest") > 0), 1).otherwise(0)).alias("copies"))
    cut = last.select(*cols, (F.col("whole") + F.when(F.col("at") + F.col("size") / 2 <= F.col("rest"), 1).otherwise(0)).alias("copies"))
    info = spark.createDataFrame([(x, int(n), float(q)) for x, n, q in zip(names, size_of, quota, strict=True)], "source string, source_size long, target double")
    return even.unionByName(cut).select(*cols, F.least("copies", F.lit(repeats)).alias("copies")), info


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with all columns, each document as often as the mix takes it."""
    row, times, copy = free(docs, "_row"), free(docs, "_copies"), free(docs, "_copy")
    key = F.xxhash64(F.col("doc_id").cast("bigint"), "text")
    found, _ = mix(docs.select(key.alias("doc_id"), "text", "source"), **options)
    copies = found.where("copies > 0").groupBy(F.col("doc_id").alias(row)).agg(F.min("copies").alias(times))
    return docs.withColumn(row, key).join(copies, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    found, info = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("source", F.col("sources")[0]).alias("f").join(F.broadcast(info).alias("i"), F.col("f.source").eqNullSafe(F.col("i.source"))).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("bigint").alias("taken"))


def mixing_overlap(spark, sf_dir: str) -> DataFrame:
    """All documents, each a member of its source and of its language, so that the flow has a choice; targets count a document once in each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found, _ = mix(docs, F.array(F.concat(F.lit("source "), F.coalesce("source", F.lit("-"))), F.concat(F.lit("lang "), F.coalesce("lang", F.lit("-")))), share=0.75)
    return found.select("doc_id", F.array_join("sources", ", ").alias("sources"), "size", (F.col("size") * F.col("copies")).cast("bigint").alias("taken"))
