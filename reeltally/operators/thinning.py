"""Batch log thinning by pointer doubling.

Which redraw is logged depends on the redraw logged before, so a job's logged redraws are a chain from its first one: each leads to the first
redraw at least ten seconds later.  Where every redraw leads is an as-of look-up.  Then the chains of all jobs are followed together: a round doubles how far
the pointers lead and how many links are known, so the longest chain takes as many rounds as its length has bits, and no job is one task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reeltally.plans.blocks import neighbours, running, time_block
from reeltally.plans.session import materialise
from reeltally.streaming.stateful import REDRAW_MS

BLOCK_MS = 3_600_000


def _leads(times: DataFrame, gap_ms: int, block_ms: int) -> DataFrame:
    """``job_id, t_ms, to``: the first of a job's times at least ``gap_ms`` later, where there is one."""
    # On the axis of negated times the first later time is the last one before, which a running maximum carries.
    none = F.lit(None).cast("long")
    marks = times.select("job_id", (-F.col("t_ms")).alias("__at"), F.lit(0).alias("__kind"), (-F.col("t_ms")).alias("__mark"), none.alias("t_ms"))
    asks = times.select("job_id", (-F.col("t_ms") - gap_ms).alias("__at"), F.lit(1).alias("__kind"), none.alias("__mark"), "t_ms")
    d = running(marks.unionByName(asks), keys=["job_id"], order=["__at", "__kind"], maxes={"__to": "__mark"}, block=time_block("__at", block_ms))
    return d.where("__kind = 1 and __to is not null").select("job_id", "t_ms", (-F.col("__to")).alias("to"))


def chains(starts: DataFrame, leads: DataFrame) -> DataFrame:
    """``job_id, t_ms`` of everything that ``leads`` reaches from ``starts``, whose ``t_ms`` ascend along it."""
    step, parts = materialise(leads), [materialise(starts.select("job_id", "t_ms"))]
    while True:
        known = parts[0]
        for part in parts[1:]:
            known = known.unionByName(part)
        # What is known are the first 2^k links of every chain, and ``step`` leads 2^k links on.
        more = materialise(known.join(step, ["job_id", "t_ms"]).select("job_id", F.col("to").alias("t_ms")))
        if more.isEmpty():
            return known
        parts.append(more)
        on = step.select("job_id", F.col("t_ms").alias("to"), F.col("to").alias("__on"))
        step = materialise(step.join(on, ["job_id", "to"]).select("job_id", "t_ms", F.col("__on").alias("to")))


def thin_log(lines: DataFrame, *, block_ms: int = BLOCK_MS) -> DataFrame:
    """Lines kept by the redraw rule: at most one redraw per ten seconds, the last one before other
    output unless that repeats it, and the last one of the log.

    ``lines``: ``job_id, n, t_ms, redraw, text`` with dense ``n`` and times that never decrease.  Of redraws at one time the first can be logged.
    """
    d = lines.select("job_id", "n", "t_ms", "redraw", "text")
    redraws = d.where("redraw").groupBy("job_id", "t_ms").agg(F.min("n").alias("n"))
    times = redraws.select("job_id", "t_ms")
    due = chains(times.groupBy("job_id").agg(F.min("t_ms").alias("t_ms")), _leads(times, REDRAW_MS, block_ms))
    due = due.join(redraws, ["job_id", "t_ms"]).select("job_id", "n", F.lit(True).alias("__due"))
    marked = d.join(due, ["job_id", "n"], "left")
    marked = marked.withColumn("__direct", ~F.col("redraw") | F.coalesce("__due", F.lit(False)))
    near = neighbours(marked, keys=["job_id"], order="n", next=["__direct", "text"])
    # A held redraw is released by the next logged line unless that repeats its text, and at the end.
    ends = F.col("next___direct").isNull()
    released = ~F.col("__direct") & (ends | (F.col("next___direct") & ~F.col("text").eqNullSafe(F.col("next_text"))))
    return near.where(F.col("__direct") | released).select("job_id", "n", "t_ms", "text")
