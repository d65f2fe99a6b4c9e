"""Problem 9: items packed into containers of fixed capacity.

Method (variable-capacity best-fit): items go, largest first, into the fullest
container that still takes them; if none does, one is opened.  Which capacity
is opened for items of which sizes is chosen jointly: sizes fall into bands
between the permitted capacities, and all assignments of openable capacities to
bands are tried (by turns, band after band, beyond ``TRIED`` of them).  Every
container is finally made as small as a permitted capacity allows, and the
cheapest result of all is kept.  With one permitted capacity, as the project
asks for its containers, this is best-fit decreasing.

Scale.  Packing sees only how many items there are of each size, a table of at
most ``capacity`` rows, so the driver's part does not grow with the data: runs
of equal containers are handled as one.  Items then find their place by their
rank within their size.  Ranks come from hash buckets (``BUCKET_ROWS`` rows
each), so a size held by a third of all items is spread over as many tasks.

Defined cases.  Null and empty texts have size 0; they take no room and are
spread over the largest group of equal containers (container 0 if there is none).  An item
above the capacity is split into full containers and one rest; nothing else is
split.  Repeated rows are packed one by one.  An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Sequence
from functools import cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import broadcast_if_small, materialize

CAPACITY = 2048
#: Permitted lengths where there are several, and what a container costs: its length and a share for handling it.
LENGTHS = {c: c + 16.0 for c in (256, 512, 1024, 2048)}
TRIED = 200
BUCKET_ROWS = 100_000

#: (size, first rank, end rank, per container, first container, offset): the items of
#: ``size`` with these ranks stand ``per container`` to a container, from ``offset`` on.
Slot = tuple[int, int, int, int, int, int]


def _best_fit(sizes: Sequence[tuple[int, int]], capacity_for: dict[int, int]) -> tuple[list[Slot], list[tuple[int, int, int]]]:
    """Slots, and (first container, containers, content) of each run of equal containers."""
    slots: list[Slot] = []
    room: list[int] = []  # free spaces that occur, ascending
    runs: dict[int, list[tuple[int, int, int]]] = {}  # free space -> [(first container, containers, content)]
    opened = 0

    def put(free: int, first: int, n: int, content: int) -> None:
        if n:
            if free not in runs:
                bisect.insort(room, free)
            runs.setdefault(free, []).append((first, n, content))

    for size, count in sorted(sizes, reverse=True):
        rank = 0
        while rank < count:
            at = bisect.bisect_left(room, size)
            if at == len(room):
                capacity = capacity_for[size]
                need = -(-(count - rank) // (capacity // size))
                put(capacity, opened, need, 0)
                opened += need
                continue
            free = room[at]
            first, n, content = runs[free].pop()
            if not runs[free]:
                del runs[free], room[at]
            per = free // size
            full = min(n, (count - rank) // per)
            if full:
                slots.append((size, rank, rank + full * per, per, first, content))
                rank += full * per
                put(free - per * size, first, full, content + per * size)
            if full < n and rank < count and count - rank < per:
                some = count - rank
                slots.append((size, rank, count, some, first + full, content))
                rank = count
                put(free - some * size, first + full, 1, content + some * size)
                full += 1
            put(free, first + full, n - full, content)
    return slots, [run for free in room for run in runs[free]]


def pack(sizes: Sequence[tuple[int, int]], capacities: dict[int, float]) -> tuple[list[Slot], list[tuple[int, int, int]], float]:
    """Slots, (first container, containers, capacity) runs, and cost for (size, count) pairs.

    ``capacities`` maps each permitted capacity to the cost of a container.
    """
    permitted = sorted(capacities)
    if sizes and max(s for s, _ in sizes) > permitted[-1]:
        raise ValueError("an item exceeds every permitted capacity")
    bands = sorted({bisect.bisect_left(permitted, s) for s, _ in sizes})  # the smallest capacity that takes a size names its band
    choices = [range(band, len(permitted)) for band in bands]

    @cache
    def packed(opening: tuple[int, ...]) -> tuple[list[Slot], list[tuple[int, int, int]], float]:
        capacity_of = {band: permitted[c] for band, c in zip(bands, opening)}
        slots, runs = _best_fit(sizes, {s: capacity_of[bisect.bisect_left(permitted, s)] for s, _ in sizes})
        sized = [(first, n, min((c for c in permitted if c >= content), key=lambda c: (capacities[c], c))) for first, n, content in runs]
        return slots, sized, sum(n * capacities[c] for _, n, c in sized)

    if math.prod(map(len, choices)) <= TRIED:
        best = min(itertools.product(*choices), key=lambda opening: packed(opening)[2])
    else:
        best = tuple(len(permitted) - 1 for _ in bands)
        while True:
            before = best
            for i, choice in enumerate(choices):
                best = min([best, *((*best[:i], c, *best[i + 1 :]) for c in choice)], key=lambda opening: packed(opening)[2])
            if best == before:
                break
    return packed(best)


def _sized(slots: list[Slot], runs: list[tuple[int, int, int]]) -> list[tuple[int, ...]]:
    """Slots cut where the final capacity of their containers changes, with that capacity."""
    runs = sorted(runs)
    starts, found = [first for first, _, _ in runs], []
    for size, rank, stop, per, first, content in slots:
        while rank < stop:
            run_first, n, capacity = runs[bisect.bisect_right(starts, first) - 1]
            end = min(stop, rank + (run_first + n - first) * per)
            found.append((size, rank, end, per, first, content, capacity))
            rank, first = end, run_first + n
    return found


def containers(items: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacities: dict[int, float] | None = None) -> DataFrame:
    """(key, part_no, n_tokens, bin_id, bin_offset, capacity): where each item, or part of one, stands.

    ``size`` must come from a written table or a deterministic plan: it is read twice.
    """
    spark = items.sparkSession
    capacities = capacities or {CAPACITY: 1.0}
    most = max(capacities)
    rows = items.select(F.col(key).alias("tw_key"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("n"))
    parts = rows.select(
        "tw_key", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / most).cast("int") - 1, F.lit(0)))).alias("part_no")
    ).select("tw_key", "part_no", F.least(F.lit(most), F.col("n") - F.col("part_no") * most).cast("int").alias("n"))
    parts = materialize(parts, "sizes")

    histogram = [(r["n"], r["count"]) for r in parts.groupBy("n").count().collect()]  # at most ``most`` + 1 rows
    slots, runs, _ = pack([(s, c) for s, c in histogram if s > 0], capacities)
    total = sum(c for _, c in histogram)

    buckets = max(1, -(-total // BUCKET_ROWS))
    placed = parts.withColumn("bucket", F.pmod(F.xxhash64("tw_key", "part_no"), F.lit(buckets)))
    sized = placed.where("n > 0")
    counts = sized.groupBy("n", "bucket").count()
    before = Window.partitionBy("n").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("n", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("n", "bucket").orderBy("tw_key", "part_no")
    ranked = sized.withColumn("row", F.row_number().over(within) - 1).join(offsets, ["n", "bucket"])
    ranked = ranked.select("tw_key", "part_no", "n", (F.col("start") + F.col("row")).alias("rank"))

    table = spark.createDataFrame(_sized(slots, runs), "n int, first bigint, stop bigint, per bigint, bin bigint, content bigint, capacity int")
    by_size = table.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("first", "per", "bin", "content", "capacity"))).alias("slots"))
    by_size = broadcast_if_small(materialize(by_size, "slots"))
    found = ranked.join(by_size, "n").withColumn("slot", F.element_at(F.filter("slots", lambda s: s["first"] <= F.col("rank")), -1))
    j = F.col("rank") - F.col("slot.first")
    seated = found.select(
        "tw_key",
        "part_no",
        "n",
        (F.col("slot.bin") + F.floor(j / F.col("slot.per"))).cast("bigint").alias("bin_id"),
        (F.col("slot.content") + F.pmod(j, F.col("slot.per")) * F.col("n")).cast("int").alias("bin_offset"),
        F.col("slot.capacity").alias("capacity"),
    )
    first, some, capacity = max(runs, key=lambda r: r[1], default=(0, 1, most))  # the longest run of equal containers
    empty = placed.where("n = 0").select(
        "tw_key", "part_no", "n", (F.pmod(F.xxhash64("tw_key"), F.lit(some)) + first).cast("bigint").alias("bin_id"), F.lit(0).alias("bin_offset"), F.lit(capacity).alias("capacity")
    )
    placed = seated.unionByName(empty)
    return placed.select(F.col("tw_key").alias(key), "part_no", F.col("n").alias("n_tokens"), "bin_id", "bin_offset", "capacity")
