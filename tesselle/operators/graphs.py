"""Small directed graphs: heaviest cycles and priority queues."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tesselle.sources.shared import shared_checkpoints

EPS = 1e-6


def check_edges(edges: DataFrame, n: int) -> DataFrame:
    """Edges (src, dst, w) of a graph of ``n`` vertices; ends out of range and negative weights are errors."""
    ok = (F.col("src") >= 0) & (F.col("src") < n) & (F.col("dst") >= 0) & (F.col("dst") < n) & (F.col("w") >= 0)
    fail = F.raise_error(F.lit("an edge has an end out of range or a negative weight"))
    return edges.select("src", "dst", F.when(ok, F.col("w").cast("double")).otherwise(fail.cast("double")).alias("w"))


def cycles_from(edges: DataFrame, most_length: int | None = None) -> DataFrame:
    """(path, weight) of all simple cycles, each once, starting at its least vertex.

    Paths grow by one edge a round; a path only visits vertices above its start, so no cycle comes
    twice. The number of rounds is the longest cycle, or ``most_length`` if that is given; each round's
    paths are checkpointed to the shared folder. Of parallel edges the heaviest counts.
    """
    shared_checkpoints(edges.sparkSession)
    e = edges.groupBy("src", "dst").agg(F.max("w").alias("w")).checkpoint()
    found = e.filter("src = dst").select(F.array("src").alias("path"), F.col("w").alias("weight"))
    front = e.filter("dst > src").select(F.col("src").alias("start"), F.col("dst").alias("last"), F.array("src", "dst").alias("path"), F.col("w").alias("weight"))
    step = e.select(F.col("src").alias("last"), F.col("dst").alias("nxt"), F.col("w").alias("more"))
    length = 2
    while most_length is None or length <= most_length:
        front = front.checkpoint()
        if front.isEmpty():
            break
        grown = front.join(step, "last")
        found = found.union(grown.filter("nxt = start").select("path", (F.col("weight") + F.col("more")).alias("weight")))
        front = grown.filter((F.col("nxt") > F.col("start")) & ~F.array_contains("path", F.col("nxt"))).select("start", F.col("nxt").alias("last"), F.concat("path", F.array("nxt")).alias("path"), (F.col("weight") + F.col("more")).alias("weight"))
        length += 1
    return found


def _cover(w: np.ndarray) -> tuple[float, np.ndarray] | None:
    """Heaviest assignment of a successor to every vertex (weight, successors); -inf forbids. None if there is none."""
    n = len(w)
    top = np.max(w, initial=0.0, where=np.isfinite(w))
    cost = np.where(np.isfinite(w), top - w, np.inf)
    u, v, of, way = np.zeros(n + 1), np.zeros(n + 1), np.full(n + 1, -1), np.zeros(n + 1, int)
    for i in range(n):
        of[n], j = i, n
        least, done = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while of[j] >= 0:
            done[j] = True
            k = of[j]
            now = cost[k] - u[k] - v[:n]
            better = ~done[:n] & (now < least[:n])
            least[:n][better] = now[better]
            way[:n][better] = j
            free = np.where(done, np.inf, least)
            free[n] = np.inf
            nxt = int(free.argmin())
            d = free[nxt]
            if not np.isfinite(d):
                return None
            u[of[done]] += d
            v[done] -= d
            least[~done] -= d
            j = nxt
        while j != n:
            of[j], j = of[way[j]], way[j]
    out = np.empty(n, int)
    out[of[:n]] = np.arange(n)
    return float(w[np.arange(n), out].sum()), out


class CycleSearch:
    """Exact search over a small graph without enumeration: branch and bound under vertex covers by disjoint cycles.

    ``w`` has -inf where there is no edge; its diagonal holds loops.
    """

    def __init__(self, w: np.ndarray):
        self.n, self.w = len(w), w
        self.slack = 1e-9 * max(1.0, float(np.abs(w[np.isfinite(w)]).sum())) if np.isfinite(w).any() else 0.0

    def weight(self, path: list[int]) -> float:
        return float(sum(self.w[a, b] for a, b in zip(path, [*path[1:], path[0]])))

    def search(self, enough: float | None = None, length: int = 0, prefix: tuple[int, ...] = ()) -> list[int] | None:
        """Heaviest cycle of two or more vertices; with ``enough`` any cycle of that weight and ``length`` whose path starts with ``prefix``."""
        w = self.w.copy()
        np.fill_diagonal(w, -np.inf if length == self.n else 0.0)  # a vertex that is its own successor is not used
        if prefix:
            for k in range(prefix[0]):
                w[k, :], w[:, k], w[k, k] = -np.inf, -np.inf, 0.0 if length < self.n else -np.inf
            w[prefix[0], prefix[0]] = -np.inf
            for a, b in zip(prefix, prefix[1:]):
                self._force(w, a, b)
        best, most = None, -np.inf if enough is None else enough
        heap, made = [], 0

        def push(x: np.ndarray, depth: int) -> None:
            nonlocal made
            got = _cover(x)
            if got:
                made += 1
                heapq.heappush(heap, (-got[0], -depth, made, x, got[1]))

        push(w, 0)
        while heap:
            bound, depth, _, x, to = heapq.heappop(heap)
            if -bound < most - self.slack or (enough is None and best is not None and -bound <= most + self.slack):
                break
            found, seen = [], set()
            for k in range(self.n):
                if k not in seen and to[k] != k:
                    path = [k]
                    while (b := int(to[path[-1]])) != k:
                        path.append(b)
                    seen.update(path)
                    found.append(path)
            for path in found:
                own = self.weight(path)
                if enough is None:
                    if own > most:
                        best, most = path, own
                elif own >= enough and len(path) == length and tuple(path[: len(prefix)]) == prefix:
                    return path
            if not found:
                k = next((k for k in range(self.n) if np.isfinite(x[k]).sum() > 1), None)
                if k is not None:
                    used, unused = x.copy(), x.copy()
                    used[k, k] = -np.inf
                    self._force(unused, k, k)
                    push(used, 1 - depth)
                    push(unused, 1 - depth)
                continue
            # What is not the cycle itself lacks one of its edges.
            free = min(([(a, int(to[a])) for a in path if np.isfinite(x[a]).sum() > 1] for path in found), key=len)
            for a, b in free:
                without = x.copy()
                without[a, b] = -np.inf
                push(without, 1 - depth)
                x = x.copy()
                self._force(x, a, b)
        return best

    @staticmethod
    def _force(x: np.ndarray, a: int, b: int) -> None:
        keep = x[a, b]
        x[a, :], x[:, b], x[a, b] = -np.inf, -np.inf, keep

    def best(self) -> tuple[list[int], float] | None:
        """(path, weight): the heaviest cycle, loops included; of those within 1e-6 the longest, then the first in order."""
        loops = [(float(self.w[k, k]), k) for k in range(self.n) if np.isfinite(self.w[k, k])]
        top = self.search()
        most = max([x for x, _ in loops] + ([self.weight(top)] if top else []), default=None)
        if most is None:
            return None
        enough = most - EPS
        for length in range(self.n, 1, -1):
            for start in range(self.n - length + 1):
                path = self.search(enough, length, (start,))
                if path is None:
                    continue
                for k in range(1, length):
                    for v in range(path[k]):
                        if v > start and v not in path[:k] and np.isfinite(self.w[path[k - 1], v]):
                            other = self.search(enough, length, (*path[:k], v))
                            if other is not None:
                                path = other
                                break
                return path, self.weight(path)
        k = min(k for x, k in loops if x >= enough)
        return [k], float(self.w[k, k])


def heaviest_cycles(edges: DataFrame, most_length: int | None = None) -> DataFrame:
    """(cycle_no, path, weight): vertex-disjoint cycles, each the heaviest left; heavier by more than 1e-6, then longer, then lexicographic.

    The edges of the graph, which is small, are searched on the driver without enumerating cycles;
    only with ``most_length`` are all cycles up to it enumerated.
    """
    spark = edges.sparkSession
    picked: list[tuple[int, list[int], float]] = []
    if most_length is None:
        rows = edges.groupBy("src", "dst").agg(F.max("w").alias("w")).collect()
        left = sorted({v for r in rows for v in (r.src, r.dst)})
        at = {v: k for k, v in enumerate(left)}
        w = np.full((len(left), len(left)), -np.inf)
        for r in rows:
            w[at[r.src], at[r.dst]] = r.w
        while left and (got := CycleSearch(w).best()):
            path, weight = got
            picked.append((len(picked), [left[k] for k in path], weight))
            stay = [k for k in range(len(left)) if k not in set(path)]
            left, w = [left[k] for k in stay], w[np.ix_(stay, stay)]
        return spark.createDataFrame(picked, "cycle_no int, path array<long>, weight double")
    left = cycles_from(edges, most_length).checkpoint()
    while True:
        top = left.agg(F.max("weight")).first()[0]
        if top is None:
            break
        close = left.filter(F.col("weight") >= F.lit(top) - EPS)
        best = close.orderBy(F.size("path").desc(), "path").first()
        picked.append((len(picked), list(best.path), float(best.weight)))
        used = F.array(*[F.lit(v).cast("long") for v in best.path])
        left = left.filter(~F.arrays_overlap(F.col("path").cast("array<bigint>"), used)).checkpoint()
    return spark.createDataFrame(picked, "cycle_no int, path array<long>, weight double")


def queue_order(items: DataFrame, by: list[str] | None = None, bucket_rows: int = 50_000) -> DataFrame:
    """Items (value, priority, op_no) with ``pos``, their place among a queue's pops.

    The latest priority of a value counts; the least priority pops first, ties by value. Queues may be
    few and long: each is cut into buckets of priority by its number of items, places are counted within
    buckets, and a table with a row for each bucket tells how many items stand before it.
    """
    by = by or []
    latest = items.groupBy(*by, "value").agg(F.max_by("priority", "op_no").alias("priority"))
    key = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("all"))
    rows = latest.select(key.alias("__k"), "value", "priority")
    p = F.col("priority").cast("double")
    span = rows.groupBy(F.col("__k").alias("__k2")).agg(F.min(p).alias("__lo"), F.max(p).alias("__hi"), F.count("*").alias("__n"))
    width = F.greatest((F.col("__hi") - F.col("__lo")) / F.ceil(F.col("__n") / bucket_rows), F.lit(1e-300))
    rows = rows.join(span.select("__k2", "__lo", width.alias("__w")), F.col("__k").eqNullSafe(F.col("__k2")))
    rows = rows.select("__k", F.coalesce(F.floor((p - F.col("__lo")) / F.col("__w")), F.lit(-1)).alias("__b"), "value", "priority")
    sizes = rows.groupBy(F.col("__k").alias("__k2"), F.col("__b").alias("__b2")).agg(F.count("*").alias("__m"))
    before = Window.partitionBy("__k2").orderBy("__b2").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__k2", "__b2", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__ahead"))
    own = rows.withColumn("__i", F.row_number().over(Window.partitionBy("__k", "__b").orderBy("priority", "value")))
    own = own.join(sizes, F.col("__k").eqNullSafe(F.col("__k2")) & (F.col("__b") == F.col("__b2")))
    return own.select(*[F.col(f"__k.{c}").alias(c) for c in by], "value", "priority", (F.col("__ahead") + F.col("__i") - 1).cast("int").alias("pos"))


class IndexedHeap:
    """A queue of distinct whole numbers by least priority, ties by value; for use inside kernels."""

    def __init__(self):
        self.now: dict[int, float] = {}
        self.heap: list[tuple[float, int]] = []

    def push(self, value: int, priority: float) -> None:
        if value in self.now:
            raise RuntimeError(f"{value} is in the queue already")
        self.now[value] = priority
        heapq.heappush(self.heap, (priority, value))

    def update(self, value: int, priority: float) -> bool:
        """New priority of a value; False where it is not in the queue."""
        if value not in self.now:
            return False
        self.now[value] = priority
        heapq.heappush(self.heap, (priority, value))
        return True

    def _settle(self) -> None:
        while self.heap and self.now.get(self.heap[0][1]) != self.heap[0][0]:
            heapq.heappop(self.heap)

    def top(self) -> tuple[int, float]:
        self._settle()
        if not self.heap:
            raise RuntimeError("the queue is empty")
        return self.heap[0][1], self.heap[0][0]

    def pop(self) -> tuple[int, float]:
        value, priority = self.top()
        heapq.heappop(self.heap)
        del self.now[value]
        return value, priority

    def __contains__(self, value: int) -> bool:
        return value in self.now

    def __len__(self) -> int:
        return len(self.now)
