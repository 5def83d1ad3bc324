"""Commit history: sessions, overlap groups, actions, statistics, schedules."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import vocabulary as V
from ..functions.text import hits
from ..sources.corpus import cut

C = F.col
LOOSE_CONVENTIONAL = r"^(?:" + "|".join(V.CONVENTIONAL_TYPES) + r")(?:\([^)]+\))?!?:"


def sessions(commits: DataFrame, gap: int = 600) -> DataFrame:
    """Numbers the sessions of each repository: a new one begins after more than `gap` seconds.

    Commits are dealt in ranges of (repo, ts, oid), so a repository with most of all commits lies in many tasks: gaps are
    found within a range and, from a table with a row for each range and repository, across ranges; session numbers are
    sums within a range plus those of the ranges before.
    """
    ranged = commits.repartitionByRange("repo", "ts", "oid").withColumn("_range", F.spark_partition_id())
    ranged = cut(ranged)
    here = W.partitionBy("_range", "repo").orderBy("ts", "oid")
    inside = ranged.withColumn("_gap", F.abs(C("ts") - F.lag("ts").over(here)) > gap).withColumn("_n", F.sum(F.coalesce(C("_gap").cast("int"), F.lit(0))).over(here.rowsBetween(W.unboundedPreceding, 0)))
    ends = cut(inside.groupBy("repo", "_range").agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"), F.max("_n").alias("_news")))
    order = W.partitionBy("repo").orderBy("_range")
    ends = ends.withColumn("_opens", F.coalesce((F.abs(C("_first") - F.lag("_last").over(order)) > gap).cast("int"), F.lit(0)))
    ends = ends.withColumn("_before", F.sum(C("_opens") + C("_news")).over(order.rowsBetween(W.unboundedPreceding, 0)) - C("_news"))
    return inside.join(ends.select("repo", "_range", "_before"), ["repo", "_range"]).withColumn("session", (C("_before") + C("_n")).cast("int")).drop("_range", "_gap", "_n", "_before")


def overlap_groups(commits: DataFrame, gap: int = 600) -> DataFrame:
    """Groups of consecutive commits of a session whose files overlap with those gathered so far.

    The gathered files depend on all commits before, so each session is read in order by one task, as a stream: what is
    held is one group's ids and files.
    """
    schema = "repo string, session int, grp int, oids array<string>, files array<string>, n_commits int, message string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        types = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int32(), pa.string()]
        now, done = None, []  # repo, session, group, ids, files in order, message

        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

        for b in batches:
            for repo, session, oid, files, message in zip(*(b.column(c).to_pylist() for c in ("repo", "session", "oid", "files", "message")), strict=True):
                files = [f for f in files or [] if f is not None]
                same = now is not None and (now[0], now[1]) == (repo, session)
                if same and not now[4].keys().isdisjoint(files):
                    now[3].append(oid)
                    now[4].update(dict.fromkeys(files))
                    continue
                if now is not None:
                    done.append((*now[:4], list(now[4]), len(now[3]), now[5]))
                now = (repo, session, now[2] + 1 if same else 0, [oid], dict.fromkeys(files), message)
            if len(done) >= 1000:
                yield flush(done)
                done = []
        if now is not None:
            done.append((*now[:4], list(now[4]), len(now[3]), now[5]))
        yield flush(done)

    s = sessions(commits, gap).select("repo", "session", "ts", "oid", "files", "message")
    return s.repartition("repo", "session").sortWithinPartitions("repo", "session", "ts", "oid").mapInArrow(run, schema)


def top_folders(files: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(files, lambda f: F.split_part(f, F.lit("/"), F.lit(1)))))


def actions(groups: DataFrame) -> DataFrame:
    return groups.withColumn("action", F.when(C("n_commits") > 1, "squash").when(F.size(top_folders(C("files"))) > 2, "split").otherwise("replay")).withColumn("scope", scope(C("files")))


def scope(files: Column) -> Column:
    top = top_folders(files)
    return F.when(F.size(top) == 0, "core").when(F.size(top) == 1, F.get(top, F.lit(0))).otherwise(F.concat(F.get(top, F.lit(0)), F.lit("+"), F.get(top, F.lit(1))))


def bare_subject(message: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(message, r"^([^\n]*)", 1), LOOSE_CONVENTIONAL + r"\s*", "")


def file_touches(commits: DataFrame) -> DataFrame:
    return commits.select("repo", F.explode("files").alias("file")).groupBy("repo", "file").agg(F.count("*").alias("touches"))


def commit_stats(commits: DataFrame) -> DataFrame:
    """Hours and weekdays in the author's time, message lengths in bytes, shares of conventional and unfinished commits."""
    local = F.timestamp_seconds(C("ts") + C("tz_offset_min") * 60)
    text = F.trim("message")
    low = F.lower(text)
    wip = F.startswith(low, F.lit("wip")) | F.contains(low, F.lit(" wip")) | F.startswith(low, F.lit("fixup")) | F.startswith(low, F.lit("squash"))
    day = F.weekday(local)
    n = F.count("*")
    return commits.groupBy("repo").agg(n.alias("commits"), F.avg(F.hour(local)).alias("avg_hour"), *((F.sum((day == d).cast("int")) / n).alias(f"day{d}") for d in range(7)), F.avg(F.octet_length(text)).alias("avg_bytes"), F.avg(F.regexp_like(text, F.lit(LOOSE_CONVENTIONAL)).cast("double")).alias("conventional_rate"), F.avg(wip.cast("double")).alias("wip_rate"))


def queue_status(plan: DataFrame, now: int) -> DataFrame:
    """Counts of entries (completed, target): done, due and pending."""
    done = C("completed")
    return plan.groupBy("repo").agg(F.count_if(done).alias("done"), F.count_if(~done & (C("target") > now)).alias("pending"), F.count_if(~done & (C("target") <= now)).alias("due"))


def parsed_windows(texts: list[str]) -> list[tuple[int, int]]:
    """HH:MM-HH:MM windows as minutes of the day; an end that is not after its start lies on the next day. Bad ones are left out."""
    out = []
    for text in texts:
        try:
            a, b = ([int(x) for x in side.split(":")] for side in text.split("-"))
        except ValueError:
            continue
        if len(a) == len(b) == 2 and max(a[0], b[0]) < 24 and max(a[1], b[1]) < 60 and min(*a, *b) >= 0:
            out.append((a[0] * 60 + a[1], b[0] * 60 + b[1]))
    return out


def in_window(minute: Column, windows: list[str]) -> Column:
    """Whether a minute of the day lies in one of the windows."""
    out = F.lit(False)
    for start, end in parsed_windows(windows):
        out = out | ((minute >= start) & (minute < end) if end > start else (minute >= start) | (minute < end))
    return out


def next_active(at: Column, windows: list[str], offset: int = 0) -> Column:
    """The moment itself (seconds) if it lies in a window, else the earliest start of one after it; without windows an hour later.

    offset: seconds that local time is ahead.
    """
    parsed = parsed_windows(windows)
    if not parsed:
        return at + 3600
    local = at + offset
    day = F.floor(local / 86400) * 86400
    starts = [day + start * 60 - offset for start, _ in parsed]
    later = F.least(*(F.when(s <= at, s + 86400).otherwise(s) for s in starts)) if len(starts) > 1 else F.when(starts[0] <= at, starts[0] + 86400).otherwise(starts[0])
    return F.when(in_window(F.floor((local - day) / 60), windows), at).otherwise(later).cast("long")


def step_minutes(per_session: int, variance: float) -> int:
    """Minutes between two entries: an even share of two hours, and a deterministic variation of one at least."""
    each = 120 // max(1, per_session)
    return each + max(1, math.floor(variance * each + 0.5))


def validate_schedule(per_session: int, variance: float, windows: list[str]) -> list[str]:
    """What is wrong with a schedule; nothing if it is empty."""
    wrong = [] if per_session >= 1 else [f"commits of a session: {per_session} is below 1"]
    wrong += [] if 0 <= variance <= 1 else [f"variance: {variance} is not in [0, 1]"]
    return wrong + [f"active hours: {w!r} is not HH:MM-HH:MM" for w in windows if not parsed_windows([w])]


def schedule(groups: DataFrame, now: int, per_session: int = 5, variance: float = 0.25, windows: list[str] | None = None, offset: int = 0) -> DataFrame:
    """Target times of a repository's groups in order.

    The first is the next active moment from `now`; each other one the next active moment after the one before and a step.
    Windows are the same every day, so from some place on the targets repeat after a whole number of days: the fold needs
    as many steps as a day has minutes, twice at most, and later places follow from it.
    """
    step, windows = step_minutes(per_session, variance) * 60, windows or []
    placed = groups.withColumn("place", F.row_number().over(W.partitionBy("repo").orderBy("session", "grp")) - 1)
    if not parsed_windows(windows):
        return placed.withColumn("target", (F.lit(now) + 3600 + C("place") * (step + 3600)).cast("long")).drop("place")
    times, seen = [next_active_seconds(now, windows, offset)], {}
    while (moment := times[-1] % 86400) not in seen:
        seen[moment] = len(times) - 1
        times.append(next_active_seconds(times[-1] + step, windows, offset))
    start, again = seen[moment], len(times) - 1
    table = groups.sparkSession.createDataFrame(list(enumerate(times[:-1])), "_at int, _time long")
    rounds = F.greatest(F.floor((C("place") - start) / (again - start)), F.lit(0))
    placed = placed.withColumn("_rounds", rounds).withColumn("_at", (C("place") - C("_rounds") * (again - start)).cast("int"))
    return placed.join(F.broadcast(table), "_at").withColumn("target", C("_time") + C("_rounds") * (times[again] - times[start])).drop("place", "_at", "_rounds", "_time")


def next_active_seconds(at: int, windows: list[str], offset: int = 0) -> int:
    """`next_active` of one moment."""
    parsed = parsed_windows(windows)
    if not parsed:
        return at + 3600
    day = (at + offset) // 86400 * 86400
    minute = (at + offset - day) // 60
    if any(a <= minute < b if b > a else minute >= a or minute < b for a, b in parsed):
        return at
    starts = [day + a * 60 - offset for a, _ in parsed]
    return min(s if s > at else s + 86400 for s in starts)


def plan_commits(plan: DataFrame, commits: DataFrame) -> DataFrame:
    """The messages of a plan's source commits, in order, beside each entry (repo, session, grp)."""
    each = plan.select("repo", "session", "grp", F.posexplode("oids").alias("at", "oid"))
    told = each.join(commits.select("repo", "oid", C("message").alias("_m")), ["repo", "oid"])
    listed = told.groupBy("repo", "session", "grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "_m"))), lambda r: r["_m"]).alias("messages"))
    return plan.join(listed, ["repo", "session", "grp"], "left")


def pending(commits: DataFrame, sync_oid: str | None = None) -> DataFrame:
    """Commits of a git log (with `seq`, counted from the tip) that come after the one already published, oldest first."""
    if sync_oid is not None:
        stop = commits.where(C("oid") == sync_oid).groupBy("repo").agg(F.min("seq").alias("_stop"))
        commits = commits.join(F.broadcast(stop), "repo", "left").where(C("_stop").isNull() | (C("seq") < C("_stop"))).drop("_stop")
    return commits.orderBy("repo", F.desc("seq"))


def markers(message: Column) -> Column:
    return hits(F.lower(message), V.RECOVERY)
