"""Summaries of timings, samples and counters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import Cols, col
from .tables import ranked


#: A sketch of this accuracy gives a rank to within one in so many values; brackets are MARGIN times as wide to each side.
ACCURACY, MARGIN = 10_000, 4
#: Groups whose brackets may be broadcast: rows of a few numbers for each fraction.
BROADCAST_GROUPS = 100_000


def _with(left: DataFrame, right: DataFrame, groups: list[str], how: str = "left") -> DataFrame:
    """left with the columns of right, which has one row for each group at most, nulls being a group."""
    named = right.withColumnsRenamed({g: f"_g_{g}" for g in groups})
    on = F.lit(True)
    for g in groups:
        on = on & left[g].eqNullSafe(named[f"_g_{g}"])
    return left.join(named, on, how).drop(*(f"_g_{g}" for g in groups))


def quantiles(rows: DataFrame, groups: list[str], value: Cols, fractions: list[float], broadcast: bool | None = None) -> DataFrame:
    """groups and q, the exact quantiles of each group's values that are not null, interpolated between neighbours; groups
    without values are left out.

    A bounded sketch of each group brackets the value of each rank. Counts of what lies below the brackets and of the distinct
    values in them, both combined before they are shuffled, then tell the value, and only what is in a bracket, some
    MARGIN * 2 / ACCURACY of a group, is sorted. No task holds a group's values or their counts. Should a bracket miss its
    rank, the job fails. broadcast: of the brackets; by default, if the groups are counted to be few."""
    rows = rows.select(*groups, col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    edge = [min(max(p + d * MARGIN / ACCURACY, 0.0), 1.0) for p in fractions for d in (-1, 1)]
    sketched = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", F.array(*(F.lit(e) for e in edge)), F.lit(ACCURACY)).alias("_s"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    # at its ends, and where a margin is less than a few ranks, a bracket takes in all that is left
    few = F.col("_n") < ACCURACY
    low = lambda i: F.when(few | F.lit(edge[2 * i] == 0.0), F.col("_min")).otherwise(F.col("_s")[2 * i])
    high = lambda i: F.when(few | F.lit(edge[2 * i + 1] == 1.0), F.col("_max")).otherwise(F.col("_s")[2 * i + 1])
    brackets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"), low(i).alias("a"), high(i).alias("b")) for i, p in enumerate(fractions)))
    held = sketched.select(*groups, "_n", brackets.alias("_brackets"))
    if broadcast is None:
        broadcast = not groups or rows.select(*groups).distinct().limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    known = _with(rows, held.hint("broadcast") if broadcast else held, groups, "inner")
    below = known.groupBy(*groups, "_n").agg(F.array(*(F.count_if(F.col("_v") < F.col("_brackets")[i]["a"]) for i in range(len(fractions)))).alias("_below"))
    within = known.select(*groups, "_v", F.explode(F.filter("_brackets", lambda x: F.col("_v").between(x["a"], x["b"]))).alias("_x"))
    counted = within.groupBy(*groups, F.col("_x.i").alias("_i"), F.col("_x.p").alias("_p"), "_v").agg(F.count(F.lit(1)).alias("_c"))
    running = counted.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*groups, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    ranked_ = _with(running, below.hint("broadcast") if broadcast else below, groups, "inner").withColumn("_upto", F.col("_upto") + F.col("_below")[F.col("_i")])
    rank = F.col("_p") * (F.col("_n") - 1)
    first = lambda r: F.min(F.when(F.col("_upto") > r, F.col("_v")))
    found = ranked_.groupBy(*groups, "_i", "_p", "_n").agg(first(F.floor(rank)).alias("_lo"), first(F.ceil(rank)).alias("_hi"), F.min(F.col("_upto") - F.col("_c")).alias("_before"))
    q = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise((F.ceil(rank) - rank) * F.col("_lo") + (rank - F.floor(rank)) * F.col("_hi"))
    sure = F.when((F.col("_before") <= F.floor(rank)) & F.col("_hi").isNotNull(), q).otherwise(F.raise_error(F.lit("a bracket missed its rank")).cast("double"))
    each = found.select(*groups, F.struct("_i", sure.alias("q")).alias("_q"))
    return each.groupBy(*groups).agg(F.transform(F.sort_array(F.collect_list("_q")), lambda x: x["q"]).alias("q")).where(F.size("q") > 0)


def span_summary(spans: DataFrame, *groups: str, value: str = "ms", wait: str | None = None, service: str | None = None) -> DataFrame:
    """Count, total, median, p90, p99 and largest duration of each group; percentiles interpolate. Where the columns are
    named, also `wait` and `service`, the sums of the time that spans waited and were served."""
    more = {n: c for n, c in (("wait", wait), ("service", service)) if c}
    sums = [F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)).alias(n) for n, c in more.items()]
    out = spans.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(value), F.lit(0.0)).alias("total"), F.max(value).alias("largest"), *sums)
    out = _with(out, quantiles(spans, list(groups), value, [0.5, 0.9, 0.99]), list(groups))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(*groups, "n", "total", zero(F.col("q")[0]).alias("median"), zero(F.col("q")[1]).alias("p90"), zero(F.col("q")[2]).alias("p99"), zero(F.col("largest")).alias("largest"), *more)


def batch_summary(spans: DataFrame, *groups: str, rows: str = "rows") -> DataFrame:
    """Mean, median, p90 and largest of the positive batch sizes of each group, 0 where there are none."""
    positive = F.when(F.col(rows) > 0, F.col(rows))
    out = spans.groupBy(*groups).agg(F.avg(positive).alias("mean"), F.max(positive).alias("largest"))
    out = _with(out, quantiles(spans, list(groups), positive, [0.5, 0.9]), list(groups))
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return out.select(*groups, zero(F.col("mean")).alias("mean"), zero(F.col("q")[0]).alias("median"), zero(F.col("q")[1]).alias("p90"), zero(F.col("largest")).alias("largest"))


def self_time(spans: DataFrame, key: str = "span_id", parent: str = "parent_id", value: str = "ms") -> DataFrame:
    """Each span with `children` (the sum of its children's durations) and `own` (the rest, not below 0)."""
    below = spans.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias(key)).agg(F.sum(value).alias("children"))
    both = spans.join(below, key, "left").withColumn("children", F.coalesce("children", F.lit(0.0)))
    return both.withColumn("own", F.greatest(F.col(value) - F.col("children"), F.lit(0.0)))


def kind_profile(events: DataFrame, phases: list[str], kind: str = "kind", phase: str = "phase", value: str = "ms") -> DataFrame:
    """events and the time of each phase by kind, with `total`."""
    sums = [F.coalesce(F.sum(F.when(F.col(phase) == p, F.col(value))), F.lit(0.0)).alias(p) for p in phases]
    return events.groupBy(kind).agg(F.count(F.lit(1)).alias("events"), *sums, F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))


def source_profile(events: DataFrame, phases: list[str], source: str = "source_item_id", phase: str = "phase", value: str = "ms", thread: str = "thread") -> DataFrame:
    """The same by source item, with the sorted set of threads that worked on it."""
    sums = [F.coalesce(F.sum(F.when(F.col(phase) == p, F.col(value))), F.lit(0.0)).alias(p) for p in phases]
    return events.groupBy(source).agg(*sums, F.coalesce(F.sum(value), F.lit(0.0)).alias("total"), F.sort_array(F.collect_set(thread)).alias("threads"))


def hotspots(stacks: DataFrame, frames: str = "frames") -> DataFrame:
    """frame, total (stacks it occurs in) and own (stacks it is the leaf of; the first frame is the leaf)."""
    once = stacks.select(F.col(frames).alias("f")).where(F.size("f") > 0)
    each = once.select(F.explode(F.transform(F.array_distinct("f"), lambda x: F.struct(x.alias("frame"), (x == F.col("f")[0]).cast("long").alias("leaf")))).alias("s"))
    return each.groupBy(F.col("s.frame").alias("frame")).agg(F.count(F.lit(1)).alias("total"), F.sum("s.leaf").alias("own"))


def stage_counts(states: DataFrame, stages: list[str]) -> DataFrame:
    """One row: ready and failed counts of each stage."""
    cells = [F.count_if((F.col("stage") == s) & (F.col("status") == v)).alias(f"{s}_{v.lower()}") for s in stages for v in ("READY", "FAILED")]
    return states.agg(*cells)


def tail(samples: DataFrame, n: int, order: str, *series: str) -> DataFrame:
    """The last n samples of each series."""
    last = Window.partitionBy(*series).orderBy(F.desc(order))
    return samples.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= n).drop("_n")


def throughput(samples: DataFrame, value: str, seconds: Column, order: list, *series: str) -> DataFrame:
    """samples with `rate`, the change of value for each second since the sample before; 0 if time or value did not advance."""
    w = Window.partitionBy(*series).orderBy(*order)
    timed = samples.withColumn("_s", seconds)
    dv, ds = F.col(value) - F.lag(value).over(w), F.col("_s") - F.lag("_s").over(w)
    rate = F.when((ds > 0) & (dv > 0), F.try_divide(dv, ds)).otherwise(F.lit(0.0))
    return timed.withColumn("rate", rate).drop("_s")


def slowest_first(profile: DataFrame, by: str = "total", *ties: str) -> DataFrame:
    """profile with `rank`, 1 for the largest value, in that order."""
    return ranked(profile, F.desc(by), *ties, name="rank")


#: Times, about, that a block of a thinned series holds at most; a block is never shorter than the gap.
BLOCK_TIMES = 1 << 18


def _leaps(times: np.ndarray, gap: int) -> np.ndarray:
    """For each of the sorted times, the place of the first one that may be kept after it."""
    return np.searchsorted(times, times + gap)


def _transition(block: pa.Table, series: list[str], gap: int) -> pa.Table:
    """One row: what a block does to the time that is kept last before it. The first time kept in the block is the first one
    from the entering bound on; where that is at most froms[i] and over froms[i - 1], the last time kept is exits[i]."""
    times = np.sort(block.column("kept").to_numpy())
    leaps, own = _leaps(times, gap), np.arange(len(times))
    to = np.where(leaps < len(times), leaps, own)
    while not np.array_equal(further := to[to], to):
        to = further
    # what is kept before the block lies before its start, so the bound is less than a gap past that
    entries = times[: np.searchsorted(times, block.column("_block")[0].as_py() + gap) + 1]
    exits = times[to[: len(entries)]]
    last = np.append(exits[1:] != exits[:-1], True)
    lists = [pa.array([x[last]], pa.list_(pa.int64())) for x in (entries, exits)]
    return pa.table([*(block.column(c).slice(0, 1) for c in (*series, "_block")), *lists], [*series, "_block", "froms", "exits"])


def _entering(batches: Iterator[pa.RecordBatch], series: list[str], gap: int) -> Iterator[pa.RecordBatch]:
    """Blocks of each series, in order, with the bound that the blocks before leave behind: from where on times may be kept."""
    own, bound = None, None
    for batch in batches:
        bounds, columns = [], [batch.column(c).to_pylist() for c in (*series, "_block")]
        for i, name in enumerate(zip(*columns, strict=True)):
            if repr(name[:-1]) != own:
                own, bound = repr(name[:-1]), None
            bounds.append(bound)
            froms, exits = (batch.column(c)[i].values.to_numpy() for c in ("froms", "exits"))
            at = 0 if bound is None else int(np.searchsorted(froms, bound))
            if at < len(froms):
                bound = int(exits[at]) + gap
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*series, "_block")), pa.array(bounds, pa.int64())], [*series, "_block", "_bound"])


def _kept(block: pa.Table, bounds: pa.Table, series: list[str], gap: int) -> pa.Table:
    block, bound = block.select([*series, "kept"]).sort_by("kept"), bounds.column("_bound")[0].as_py()
    times, chosen = block.column("kept").to_numpy(), []
    leaps, i = _leaps(times, gap), 0 if bound is None else int(np.searchsorted(times, bound))
    while i < len(times):
        chosen.append(i)
        i = int(leaps[i])
    return block.take(pa.array(chosen, pa.int64()))


def thin(samples: DataFrame, millis: str, gap: int, *series: str) -> DataFrame:
    """series, kept: the times kept when a sample must be `gap` after the last one kept. Null times are passed over, equal
    times are one, unless no gap is asked for: then every time is kept.

    Greedy, but no task holds a series. Its time is cut into blocks of at least a gap and about BLOCK_TIMES distinct times.
    A block becomes a transition, from the bound that enters it to the time kept last in it, with one entry at most for
    each time in its first gap; transitions of a series are applied in order, a stream that holds one batch; then each block
    keeps its times from its own bound on. How many gaps a block has follows from the most distinct times in one gap, which
    are counted first (one job)."""
    keys = list(series)
    times = samples.where(F.col(millis).isNotNull()).select(*keys, F.col(millis).cast("long").alias("kept"))
    if gap <= 0:
        return times
    floor = lambda width: F.col("kept") - F.pmod("kept", F.lit(width).cast("long"))
    times = times.distinct()
    crowd = times.groupBy(*keys, floor(gap).alias("_slot")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    blocks = times.withColumn("_block", floor(gap * max(1, BLOCK_TIMES // crowd)))
    grouped, named = blocks.groupBy(*keys, "_block"), blocks.select(*keys, "_block").schema
    long = T.LongType()
    shape = T.StructType([*named, T.StructField("froms", T.ArrayType(long)), T.StructField("exits", T.ArrayType(long))])
    moves = grouped.applyInArrow(lambda table: _transition(table, keys, gap), shape)
    dealt = moves.repartition(*keys) if keys else moves.repartition(1)
    bounds = dealt.sortWithinPartitions(*keys, "_block").mapInArrow(lambda it: _entering(it, keys, gap), T.StructType([*named, T.StructField("_bound", long)]))
    return grouped.cogroup(bounds.groupBy(*keys, "_block")).applyInArrow(lambda own, bound: _kept(own, bound, keys, gap), times.schema)


def power_law(points: DataFrame, x: str, y: str, *groups: str) -> DataFrame:
    """exponent and r2 of log y on log x over positive points; r2 is 1 where x or y does not vary."""
    fine = points.where((F.col(x) > 0) & (F.col(y) > 0))
    a, b = F.log(x), F.log(y)
    cells = [F.regr_slope(b, a).alias("exponent"), F.coalesce(F.regr_r2(b, a), F.lit(1.0)).alias("r2")]
    return fine.groupBy(*groups).agg(*cells) if groups else fine.agg(*cells)


def scorecard(spans: DataFrame, files: str, items: str, millis: str, reads: dict[str, Column] | None = None, read_millis: str | None = None) -> DataFrame:
    """One row: files, items, ms and rates for a file and an item.

    reads: names of phases (during, after) to predicates; adds median, p90, p99 and the largest of read_millis in each,
    NaN where there are none."""
    reads, value = reads or {}, F.col(read_millis or millis)
    picks = [F.count_distinct(files).alias("files"), F.count_distinct(items).alias("items"), F.sum(millis).alias("ms")]
    picks += [F.max(F.when(holds, value)).cast("double").alias(f"_{phase}_largest") for phase, holds in reads.items()]
    out, shown = spans.agg(*picks), []
    if reads:
        each = spans.select(F.explode(F.array(*(F.struct(F.lit(phase).alias("phase"), F.when(holds, value).cast("double").alias("ms")) for phase, holds in reads.items()))).alias("r")).select("r.*")
        found = quantiles(each, ["phase"], "ms", [0.5, 0.9, 0.99], broadcast=True)
        out = out.join(found.agg(*(F.max(F.when(F.col("phase") == phase, F.col("q"))).alias(f"_{phase}") for phase in reads)).hint("broadcast"))  # one row each
    for phase in reads:
        cells = [F.col(f"_{phase}")[i] for i in range(3)] + [F.col(f"_{phase}_largest")]
        shown += [F.coalesce(c, F.lit(float("nan"))).alias(f"{phase}_{n}") for c, n in zip(cells, ("median", "p90", "p99", "largest"), strict=True)]
    rates = [F.try_divide("ms", "files").alias("ms_per_file"), F.try_divide("ms", "items").alias("ms_per_item"), F.try_divide(F.col("items") * 1000.0, F.col("ms")).alias("items_per_s")]
    return out.select("files", "items", "ms", *rates, *shown)


def status_verdict(counts: DataFrame) -> DataFrame:
    """counts (total, pending, failed, running, scan_error) with level, label, detail and progress; the first case that
    holds decides."""
    done = F.col("total") - F.col("pending") - F.col("running")
    said = lambda form, *c: F.format_string(form, *c)
    cases = [
        (F.col("scan_error").isNotNull(), "error", "source error", F.col("scan_error")),
        (F.col("total") == 0, "idle", "empty", F.lit("there is nothing to work on")),
        (F.col("running") > 0, "busy", "working", said("%d of %d done, %d at work", done, F.col("total"), F.col("running"))),
        (F.col("pending") > 0, "busy", "waiting", said("%d of %d done, %d to come", done, F.col("total"), F.col("pending"))),
        (F.col("failed") > 0, "warning", "done with failures", said("%d of %d failed", F.col("failed"), F.col("total"))),
    ]
    level, label, detail = F.lit("ok"), F.lit("up to date"), said("all %d done", F.col("total"))
    for when, a, b, c in reversed(cases):
        level, label, detail = F.when(when, F.lit(a)).otherwise(level), F.when(when, F.lit(b)).otherwise(label), F.when(when, c).otherwise(detail)
    progress = F.coalesce(F.try_divide(done, F.col("total")), F.lit(1.0))
    return counts.select("*", level.alias("level"), label.alias("label"), detail.alias("detail"), progress.cast("double").alias("progress"))


def status_row(totals: DataFrame) -> DataFrame:
    """position, cell, details: what a status row shows of each row of totals (found, pending, interpreted, processed,
    analyzed, failed_interpret, failed_process, failed_analyze, failed_collection, and errors, all that were reported).

    Errors beyond those of the stages are counted as issues of analysis; other columns of totals stay beside each cell."""
    cells = ["found", "pending", "interpreted", "processed", "analyzed", "failed_interpret", "failed_process", "failed_analyze", "failed_collection", "errors"]
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    staged = n("failed_interpret") + n("failed_process") + n("failed_analyze") + n("failed_collection")
    analyze = n("failed_analyze") + F.greatest(n("errors") - staged, F.lit(0).cast("long"))
    issues = n("failed_interpret") + n("failed_process") + analyze + n("failed_collection")
    text = lambda c, word: F.concat(c.cast("string"), F.lit(f" {word}"))
    row = [
        (text(n("found"), "sources"), [text(n("found"), "found"), text(n("pending"), "pending")]),
        (text(n("interpreted"), "items"), [text(n("interpreted"), "interpreted")]),
        (text(n("analyzed"), "analyzed"), [text(n("processed"), "processed"), text(n("analyzed"), "analyzed")]),
        (F.concat(issues.cast("string"), F.when(issues == 1, F.lit(" issue")).otherwise(F.lit(" issues"))), [text(c, w) for c, w in ((n("failed_interpret"), "interpret"), (n("failed_process"), "process"), (analyze, "analyze"), (n("failed_collection"), "collection"))]),
    ]
    shown = F.array(*(F.struct(F.lit(i + 1).alias("position"), cell.alias("cell"), F.array(*details).alias("details")) for i, (cell, details) in enumerate(row)))
    rest = [c for c in totals.columns if c not in cells]
    return totals.select(*rest, F.explode(shown).alias("_r")).select(*rest, "_r.position", "_r.cell", "_r.details")


def skipped_sources(sources: DataFrame, items: DataFrame) -> DataFrame:
    """Sources without any item."""
    return sources.join(items.select("source_item_id").distinct(), "source_item_id", "left_anti")


def mean_cost(metrics: DataFrame, *groups: str, nanos: str = "ns", calls: str = "calls") -> DataFrame:
    """ns, calls and mean ms of each group, 0 without calls."""
    out = metrics.groupBy(*groups).agg(F.sum(nanos).alias("ns"), F.sum(calls).alias("calls"))
    return out.withColumn("mean_ms", F.coalesce(F.try_divide(F.col("ns") / 1e6, F.col("calls")), F.lit(0.0)))
