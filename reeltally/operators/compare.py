"""Comparing two versions of a stream: pairing, packet fidelity, digests, duplicates, keyframes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reeltally.plans import blocks
from reeltally.plans.blocks import BLOCK_ROWS, BLOCK_US, KEYS, attach, neighbours, running
from reeltally.plans.verdicts import with_verdict

COPY_TOLERANCE_US = 2_000
PAIR_TOLERANCE_US = 2_100
LEADING_LIMIT = 16
DIGEST_FAN = 4_096
DIGEST_LEVELS = 4
FIELD_SEPARATOR = "\x1f"


def _renamed(df: DataFrame, keep: Sequence[str], tag: str) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(f"{tag}_{c}") for c in df.columns if c not in keep])


def pair_by_ordinal(
    left: DataFrame, right: DataFrame, *, keys: Sequence[str] = ("pair_id",), order: str = "ordinal"
) -> DataFrame:
    """Row i of one stream beside row i of the other; ``side`` is both, left or right.

    The join key contains the ordinal, so no key is hot.
    """
    on = [*keys, order]
    l = _renamed(left, on, "l").withColumn("__l", F.lit(True))
    r = _renamed(right, on, "r").withColumn("__r", F.lit(True))
    side = F.when(F.col("__l") & F.col("__r"), "both").when(F.col("__l"), "left").otherwise("right")
    return l.join(r, on, "full").withColumn("side", side).drop("__l", "__r")


def pair_verdict(pairs: DataFrame, *, keys: Sequence[str] = ("pair_id",), order: str = "ordinal") -> DataFrame:
    """Per pair: matched rows and which side has rows left over."""
    count = lambda s: F.count(F.when(F.col("side") == s, 1))
    out = pairs.groupBy(*keys).agg(
        count("both").alias("matched"),
        count("left").alias("left_extra"),
        count("right").alias("right_extra"),
        F.min(F.when(F.col("side") != "both", F.col(order))).alias("first_bad"),
    )
    return with_verdict(out, (F.col("left_extra") > 0, "reference has more"), (F.col("right_extra") > 0, "candidate has more"))


def pair_with_clock_tolerance(
    left: DataFrame,
    right: DataFrame,
    *,
    keys: Sequence[str] = ("pair_id",),
    order: str = "ordinal",
    t: str = "t_us",
    geometry: Sequence[str] = (),
    tolerance_us: int = PAIR_TOLERANCE_US,
    fixed_rate: bool = False,
) -> DataFrame:
    """Verdict per pair: equal counts, equal geometry and relative clocks within the tolerance.

    ``(l_i - l_0) - (r_i - r_0)`` equals ``d_i - d_0`` with ``d = l - r``, so the extremes of d decide.
    """
    keep = [*keys, order, t, *geometry]
    pairs = pair_by_ordinal(left.select(*keep), right.select(*keep), keys=keys, order=order)
    delta = F.col(f"l_{t}") - F.col(f"r_{t}")
    both = F.col("side") == "both"
    differs = F.lit(False)
    for g in geometry:
        differs = differs | ~F.col(f"l_{g}").eqNullSafe(F.col(f"r_{g}"))
    out = pairs.groupBy(*keys).agg(
        F.count(F.when(both, 1)).alias("matched"),
        F.count(F.when(F.col("side") == "left", 1)).alias("left_extra"),
        F.count(F.when(F.col("side") == "right", 1)).alias("right_extra"),
        F.min(F.when(F.col(order) == 0, delta)).alias("__d0"),
        F.min(delta).alias("__lo"),
        F.max(delta).alias("__hi"),
        F.count(F.when(both & differs, 1)).alias("geometry_changes"),
    )
    out = out.withColumn("max_clock_error_us", F.greatest(F.col("__hi") - F.col("__d0"), F.col("__d0") - F.col("__lo")))
    return with_verdict(
        out.drop("__d0", "__lo", "__hi"),
        (F.lit(not fixed_rate) & (F.col("max_clock_error_us") > tolerance_us), "frame timing differs"),
        (F.col("left_extra") > 0, "reference has more"),
        (F.col("right_extra") > 0, "candidate has more"),
        (F.col("geometry_changes") > 0, "geometry differs"),
    )


def _close(a: Column, b: Column, tolerance: int = COPY_TOLERANCE_US) -> Column:
    return F.coalesce(F.abs(a - b) <= tolerance, a.isNull() & b.isNull())


def packet_fidelity_diff(
    source: DataFrame,
    copy: DataFrame,
    *,
    keys: Sequence[str] = KEYS,
    order: str = "ordinal",
    offset_us: int = 0,
    reconstruct_initial_dts: bool = False,
    omit_initial_dts: bool = False,
    aac_reshape: bool = False,
    leading_limit: int = LEADING_LIMIT,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Verdict per stream: the copy holds the source's packets with content and timing kept.

    Needs ``pts_us, dts_us, duration_us, size, hash`` on both sides.  Both sides meet in blocks of ordinals by one shuffle, in which each packet
    also sees its neighbours; a block becomes one row, and the rule for packets whose DTS is missing on one side (a short, ordered
    prefix of that side may lack it) is settled along these rows.
    """
    keys = list(keys)
    home = [*keys, "__block"]
    cols = ["pts_us", "dts_us", "duration_us", "size", "hash"]
    both_sides = source.select(*keys, order, *cols, F.lit(0).alias("__side")).unionByName(copy.select(*keys, order, *cols, F.lit(1).alias("__side")))
    block, at = blocks.ordinal_block(order, block_rows), F.expr(f"pmod(`{order}`, {int(block_rows)})")
    none = F.array().cast("array<bigint>")
    homes = [F.array(block), F.when(at == block_rows - 1, F.array(block + 1)).otherwise(none)]
    if aac_reshape:
        homes.append(F.when((at == 0) & (F.col(order) > 0), F.array(block - 1)).otherwise(none))
    # Dealt out by block alone, so that neither side's windows nor the pairing needs another shuffle.
    d = both_sides.withColumn("__own", block).withColumn("__block", F.explode(F.concat(*homes))).repartition(*home)
    w = W.partitionBy(*home, "__side").orderBy(order)
    d = d.withColumn("prev_dts", F.when(F.lag(order).over(w) == F.col(order) - 1, F.lag("dts_us").over(w)))
    if aac_reshape:
        d = d.withColumn("next_dts", F.when(F.lead(order).over(w) == F.col(order) + 1, F.lead("dts_us").over(w)))
    packet = F.struct(*cols, "prev_dts", *(["next_dts"] if aac_reshape else []))
    side = lambda n: F.first(F.when(F.col("__side") == n, packet), ignorenulls=True)
    pairs = d.where("__block = __own").groupBy(*home, order).agg(side(0).alias("l"), side(1).alias("r"))

    l, r = F.col("l"), F.col("r")
    both = l.isNotNull() & r.isNotNull()
    content = (l["hash"] != r["hash"]) | (l["size"] != r["size"])
    pts_bad = ~_close(l["pts_us"] + offset_us, r["pts_us"])
    dts_bad = ~_close(l["dts_us"] + offset_us, r["dts_us"])
    unknown = l["duration_us"].isNull() | r["duration_us"].isNull()
    stretched = F.lit(False)
    if aac_reshape:
        step = r["next_dts"] - r["dts_us"]
        stretched = F.coalesce((step >= 0) & (F.abs(r["duration_us"] - step) <= COPY_TOLERANCE_US), F.lit(False))
    duration_bad = ~unknown & ~_close(l["duration_us"], r["duration_us"]) & ~stretched
    one_sided = l["dts_us"].isNull() != r["dts_us"].isNull()
    hard = both & (content | pts_bad | duration_bad | (dts_bad & ~one_sided))
    soft = F.coalesce(both & ~(content | pts_bad | duration_bad) & one_sided, F.lit(False))
    ordered = lambda x: (x["dts_us"] <= x["pts_us"]) & F.coalesce(x["dts_us"] >= x["prev_dts"], F.lit(True))
    rebuilt = F.lit(reconstruct_initial_dts) & soft & l["dts_us"].isNull() & ordered(r)
    dropped = F.lit(omit_initial_dts) & soft & r["dts_us"].isNull() & ordered(l)
    # Whether a DTS came before in the same block; what came in earlier blocks is known along the blocks.
    sofar = W.partitionBy(*home).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    seen = lambda x: F.coalesce(F.max(x["dts_us"].isNotNull()).over(sofar), F.lit(False))
    rows = pairs.select(
        *home, order, both.alias("both"), (l.isNotNull() & r.isNull()).alias("left"), (l.isNull() & r.isNotNull()).alias("right"),
        (F.coalesce(hard, F.lit(False)) | ~both).alias("hard"), soft.alias("soft"), F.coalesce(rebuilt, F.lit(False)).alias("rebuilt"), F.coalesce(dropped, F.lit(False)).alias("dropped"),
        seen(l).alias("l_seen"), seen(r).alias("r_seen"), l["dts_us"].isNotNull().alias("l_dts"), r["dts_us"].isNotNull().alias("r_dts"),
    )
    count, first = lambda c: F.count(F.when(F.col(c) if isinstance(c, str) else c, 1)), lambda c: F.min(F.when(F.col(c) if isinstance(c, str) else c, F.col(order)))
    c = F.col
    heads = lambda x: F.slice(F.array_sort(F.collect_list(F.when(x, c(order)))), 1, leading_limit + 1)
    early_l, early_r = c("rebuilt") & ~c("l_seen"), c("dropped") & ~c("r_seen")
    parts = rows.groupBy(*home).agg(
        count("both").alias("matched"), count("left").alias("missing"), count("right").alias("extra"), first("hard").alias("first_hard"),
        F.coalesce(F.max("l_dts"), F.lit(False)).alias("l_dts"), F.coalesce(F.max("r_dts"), F.lit(False)).alias("r_dts"),
        first(c("soft") & ~early_l & ~early_r).alias("refused"), first(early_l).alias("l_first"), first(early_r).alias("r_first"),
        count(early_l).alias("l_count"), count(early_r).alias("r_count"), heads(early_l).alias("l_heads"), heads(early_r).alias("r_heads"),
    )
    before = W.partitionBy(*keys).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    past = lambda x: F.coalesce(F.max(x).over(before), F.lit(False))
    parts = parts.withColumns({"l_past": past("l_dts"), "r_past": past("r_dts")})
    # A block behind a DTS has no leading packets of that side: what looked like some is refused.
    open_ = lambda x, value, otherwise: F.when(~c(f"{x}_past"), c(value)).otherwise(otherwise)
    zero, empty = F.lit(0).cast("long"), F.array().cast("array<bigint>")
    parts = parts.withColumn("leading", open_("l", "l_count", zero) + open_("r", "r_count", zero))
    parts = parts.withColumn("heads", F.array_sort(F.concat(open_("l", "l_heads", empty), open_("r", "r_heads", empty))))
    parts = parts.withColumn("refused", F.least("refused", F.when(c("l_past"), c("l_first")), F.when(c("r_past"), c("r_first"))))
    parts = parts.withColumn("over", F.get("heads", (F.lit(leading_limit) - F.coalesce(F.sum("leading").over(before), zero)).cast("int")))
    out = parts.groupBy(*keys).agg(
        F.sum("matched").alias("matched"), F.sum("missing").alias("missing"), F.sum("extra").alias("extra"),
        F.least(F.min("first_hard"), F.min("refused"), F.min("over")).alias("first_bad"), F.sum("leading").alias("leading_without_dts"),
    )
    out = out.withColumn("__changed", F.col("first_bad") < F.col("matched"))
    return with_verdict(
        out,
        (F.col("__changed"), "content or timing changed"),
        (F.col("extra") > 0, "extra packets"),
        (F.col("missing") > 0, "missing packets"),
    ).drop("__changed")


def locate_subsequence(
    source: DataFrame,
    target: DataFrame,
    *,
    keys: Sequence[str] = KEYS,
    order: str = "ordinal",
    shift_us: int = 0,
    subtitle: bool = False,
    leading_dts_optional: bool = False,
    filler_hash: str | None = None,
) -> DataFrame:
    """Where a copied run starts in its source, and whether it then matches without a gap.

    The source is filtered to rows equal to the first target row; the earliest of them fixes
    the start, and one equi-join on the shifted ordinal checks the rest: two passes over either side.  ``filler_hash`` names
    the payload of an empty leading filler packet that may precede the run.
    """
    keys = list(keys)
    cols = ["pts_us", "dts_us", "duration_us", "size", "hash"]
    move = lambda c: F.greatest(F.col(c) + shift_us, F.lit(0)) if subtitle else F.col(c) + shift_us
    s = source.select(
        *keys, F.col(order).alias("__so"),
        move("pts_us").alias("__s_pts"), move("dts_us").alias("__s_dts"),
        F.col("duration_us").alias("__s_dur"), F.col("size").alias("__s_size"), F.col("hash").alias("__s_hash"),
    )
    t = target.select(*keys, order, *cols)
    skip = F.lit(0).cast("long")
    if filler_hash is not None:
        filler = (
            (F.col(order) == 0) & (F.lit(shift_us) > COPY_TOLERANCE_US) & (F.col("size") == 2) & (F.col("hash") == filler_hash)
            & (F.abs("pts_us") <= COPY_TOLERANCE_US) & (F.abs(F.col("duration_us") - shift_us) <= 5_000)
        )
        heads = t.where(F.col(order) == 0).select(*keys, F.when(filler, 1).otherwise(0).cast("long").alias("filler"))
        t = attach(t, heads, keys, spread=order, dense=False).where(F.col(order) >= F.col("filler"))
        t = t.withColumn(order, F.col(order) - F.col("filler"))
    else:
        t = t.withColumn("filler", skip)
    # The first row and where the first DTS stands, in one pass over the target.
    heads = t.groupBy(*keys).agg(
        F.max(F.when(F.col(order) == 0, F.struct(*cols))).alias("__head"), F.min(F.when(F.col("dts_us").isNotNull(), F.col(order))).alias("__seen")
    )

    def same_row(dts_free: Column) -> Column:
        return (
            (F.col("__s_hash") == F.col("hash")) & (F.col("__s_size") == F.col("size"))
            & _close(F.col("__s_dur"), F.col("duration_us")) & _close(F.col("__s_pts"), F.col("pts_us"))
            & (_close(F.col("__s_dts"), F.col("dts_us")) | dts_free)
        )

    head = heads.where("__head is not null").select(*keys, "__head.*", "__seen")
    free = F.lit(leading_dts_optional) & F.col("dts_us").isNull()
    starts = attach(s, head, keys, spread="__so", how="inner", dense=False).where(same_row(free)).groupBy(*keys).agg(
        F.min("__so").alias("start"), F.max("__seen").alias("__seen")
    )
    placed = attach(t, starts, keys, spread=order, dense=False)
    placed = placed.withColumn("__so", F.col("start") + F.col(order))
    joined = placed.join(s, [*keys, "__so"], "left")
    early = F.lit(leading_dts_optional) & F.col("dts_us").isNull() & F.coalesce(F.col(order) <= F.col("__seen"), F.lit(True))
    good = F.coalesce(same_row(early), F.lit(False))
    out = joined.groupBy(*keys).agg(
        (F.count(F.lit(1)) + F.max("filler")).alias("packets"),
        F.max("filler").alias("filler"),
        F.min("start").alias("start"),
        F.min(F.when(~good, F.col(order))).alias("first_bad"),
        F.min(F.when(F.col(order) == 0, F.col("__s_pts"))).alias("first_us"),
        F.max(F.col("__s_pts") + F.col("__s_dur")).alias("end_us"),
    )
    return with_verdict(
        out, (F.col("start").isNull(), "first packet not in the source"), (F.col("first_bad").isNotNull(), "run is not contiguous")
    )


def _fold_digest(rows: DataFrame, keys: list[str], order: str, text: Column, fan: int, levels: int) -> DataFrame:
    """SHA-256 tree over blocks of ``fan`` ordinals; every group holds at most ``fan`` items."""
    level = rows.select(*keys, F.col(order).alias("__i"), text.alias("__d"))
    for k in range(levels):
        last = k == levels - 1
        up = level if last else level.withColumn("__up", F.expr(f"__i div {fan}"))
        group = keys if last else [*keys, "__up"]
        items = F.array_sort(F.collect_list(F.struct("__i", "__d")))
        folded = F.sha2(F.array_join(F.transform(items, lambda x: x["__d"]), "\n"), 256).alias("__d")
        level = up.groupBy(*group).agg(folded)
        if not last:
            level = level.withColumnRenamed("__up", "__i")
    return level.withColumnRenamed("__d", "digest")


def ordered_digest(
    packets: DataFrame,
    *,
    keys: Sequence[str] = KEYS,
    order: str = "ordinal",
    fields: Sequence[str] = ("pts_us", "dts_us", "size", "flags", "hash"),
    pts: str = "pts_us",
    duration: str = "duration_us",
    fan: int = DIGEST_FAN,
    levels: int = DIGEST_LEVELS,
) -> DataFrame:
    """Order-sensitive digest of content and timing with packet and duration counts and the last end.

    Only equality of digests is meaningful.  Blocks are cut by ordinal, never by time; with
    four levels of 4,096 a stream may hold 2.8e14 packets.
    """
    keys = list(keys)
    text = F.concat_ws(FIELD_SEPARATOR, *[F.coalesce(F.col(f).cast("string"), F.lit("N/A")) for f in fields])
    digest = _fold_digest(packets, keys, order, text, fan, levels)
    timed = F.col(duration).isNotNull() & F.col(pts).isNotNull()
    facts = packets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("packets"),
        F.count(duration).alias("durations"),
        F.max_by(F.when(timed, F.col(pts) + F.col(duration)), F.when(timed, F.col(order))).alias("last_end_us"),
    )
    return digest.join(facts, keys)


def digest_match(expected: DataFrame, actual: DataFrame, *, keys: Sequence[str] = KEYS, end_slack: int = 2) -> DataFrame:
    """Compares two digest tables; last ends may differ by two ticks."""
    cols = ["digest", "packets", "durations", "last_end_us"]
    side = lambda df, tag: df.select(*keys, *[F.col(c).alias(f"{tag}_{c}") for c in cols])
    d = side(expected, "e").join(side(actual, "a"), list(keys), "full")
    return with_verdict(
        d,
        (F.col("a_digest").isNull() | F.col("e_digest").isNull(), "stream missing"),
        (F.col("e_packets") != F.col("a_packets"), "packet count differs"),
        (F.col("e_durations") != F.col("a_durations"), "duration count differs"),
        (F.col("e_digest") != F.col("a_digest"), "content or timing differs"),
        (~_close(F.col("e_last_end_us"), F.col("a_last_end_us"), end_slack), "last end differs"),
    )


def clock_digest(
    rows: DataFrame,
    *,
    keys: Sequence[str] = KEYS,
    tick: str = "ticks",
    order: str = "ordinal",
    samples: str | None = None,
    fan: int = DIGEST_FAN,
    levels: int = DIGEST_LEVELS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Origin, count and digest of a strictly increasing tick clock, independent of its origin.

    Steps between ticks carry the same information as ticks relative to the first one, so
    the origin never has to be joined back to the rows.  ``samples`` adds a per-row count.
    """
    keys = list(keys)
    cols = [*keys, order, tick, *([samples] if samples else [])]
    d = neighbours(rows.select(*cols), keys=keys, order=order, prev=[tick], block_rows=block_rows)
    step = F.coalesce(F.col(tick) - F.col(f"prev_{tick}"), F.lit(0))
    text = step.cast("string")
    if samples:
        text = F.concat_ws(FIELD_SEPARATOR, text, F.col(samples).cast("string"))
    digest = _fold_digest(d, keys, order, text, fan, levels)
    bad = F.col(tick).isNull() | ((F.col(order) > 0) & ~F.coalesce(F.col(tick) > F.col(f"prev_{tick}"), F.lit(False)))
    facts = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"),
        F.min(F.when(F.col(order) == 0, F.col(tick))).alias("origin_ticks"),
        F.min(F.when(bad, F.col(order))).alias("first_bad"),
        *([F.sum(samples).alias("samples")] if samples else []),
    )
    return with_verdict(digest.join(facts, keys), (F.col("first_bad").isNotNull(), "clock not strictly increasing"))


def duplicate_run_profile(
    frames: DataFrame,
    *,
    keys: Sequence[str] = KEYS,
    order: str = "ordinal",
    t: str = "t_us",
    duration: str = "duration_us",
    hash: str = "hash",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Runs of equal consecutive hashes: counts, lengths and length changes.

    One pass over the rows: a block of ordinals becomes one row, with its first and last run, which may go on in other blocks, and
    sums over the runs between them.  These rows are put together along each stream.
    """
    keys = list(keys)
    home = [*keys, "__block"]
    inside = W.partitionBy(*home).orderBy(order)
    d = frames.select(*keys, order, t, duration, hash).withColumn("__block", blocks.ordinal_block(order, block_rows))
    d = d.withColumn("__at", F.row_number().over(inside))
    before = lambda c: F.lag(c).over(inside)
    fresh = (F.col("__at") == 1) | ~F.col(hash).eqNullSafe(before(hash))
    gap = (F.col("__at") > 1) & ~F.coalesce(F.col(t) == before(t) + before(duration), F.lit(False))
    d = d.withColumns({
        "__run": F.sum(fresh.cast("int")).over(inside),
        "__bad": gap | ~F.coalesce(F.col(duration) > 0, F.lit(False)),
        "__hex": F.coalesce(F.col(hash).rlike("^[0-9a-fA-F]{64}$"), F.lit(False)),
    })
    row = F.struct(F.col(order).alias("n"), F.col(t).alias("t"), F.col(duration).alias("d"), F.col(hash).alias("h"))
    runs = d.groupBy(*home, "__run").agg(
        F.count(F.lit(1)).alias("len"), F.min_by(row, order).alias("head"), F.max_by(row, order).alias("tail"),
        F.min(F.when(F.col("__bad"), F.col(order))).alias("first_gap"), F.count(F.when(~F.col("__hex"), 1)).alias("bad_hashes"),
    )
    along = W.partitionBy(*home).orderBy("__run")
    runs = runs.withColumns({"prev_len": F.lag("len").over(along), "__last": F.lead("len").over(along).isNull()})
    between = (F.col("__run") > 1) & ~F.col("__last")
    changed = between & (F.col("__run") > 2) & (F.col("prev_len") != F.col("len"))
    last = lambda c: F.max(F.when(F.col("__last"), F.col(c)))
    parts = runs.groupBy(*home).agg(
        F.max("__run").alias("runs"),
        F.min_by("head", "__run").alias("head"), F.max_by("tail", "__run").alias("tail"), F.min_by("len", "__run").alias("first_len"), last("len").alias("last_len"),
        last("prev_len").alias("before_last"), F.max(F.when(F.col("__run") == 2, F.col("len"))).alias("second"),
        F.sum("len").alias("frames"), F.min("first_gap").alias("first_gap"), F.sum("bad_hashes").alias("bad_hashes"),
        F.count(F.when(between & (F.col("len") > 1), 1)).alias("repeated"), F.count(F.when(changed, 1)).alias("changes"), F.count(F.when(between, 1)).alias("closed"),
        F.collect_set(F.when(between, F.col("len"))).alias("lens"),
    )
    return _stitched_runs(parts, keys)


def _stitched_runs(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The profile of each stream from its blocks' rows: runs at the edges of blocks are put together, then compared with their neighbours."""
    blocks_ = W.partitionBy(*keys).orderBy("__block")
    before = F.lag("tail").over(blocks_)
    torn = F.when(F.col("__block") > 0, F.coalesce(before["n"] != F.col("head.n") - 1, F.lit(True))).otherwise(F.col("head.n") != 0) | (F.col("tail.n") - F.col("head.n") + 1 != F.col("frames"))
    gap = (F.col("__block") > 0) & ~F.coalesce(F.col("head.t") == before["t"] + before["d"], F.lit(False))
    d = parts.withColumn("first_gap", F.when(torn, F.raise_error(F.lit("ordinals are not dense"))).otherwise(F.least("first_gap", F.when(gap, F.col("head.n")))))
    goes_on = before.isNotNull() & F.col("head.h").eqNullSafe(before["h"])
    d = d.withColumn("__fresh", ~goes_on)
    # One item for each run that touches an edge; sums over the block go with its first one.
    many = F.col("runs") > 1
    first = F.struct(F.lit(0).alias("pos"), F.col("first_len").alias("len"), F.col("__fresh").alias("fresh"), F.lit(None).cast("long").alias("before"))
    second = F.struct(F.lit(1).alias("pos"), F.col("last_len").alias("len"), F.lit(True).alias("fresh"), F.when(F.col("runs") > 2, F.col("before_last")).alias("before"))
    d = d.withColumn("__item", F.explode(F.when(many, F.array(first, second)).otherwise(F.array(first))))
    order = W.partitionBy(*keys).orderBy("__block", "__item.pos")
    d = d.withColumn("__block_edge", F.sum(F.col("__item.fresh").cast("int")).over(order))
    d = d.withColumn("len", F.sum("__item.len").over(W.partitionBy(*keys, "__block_edge")))
    d = d.withColumn("prev_len", F.coalesce("__item.before", F.lag("len").over(order)))
    own, start = F.col("__item.pos") == 0, F.col("__item.fresh")
    once = lambda c: F.sum(F.when(own, F.col(c)).otherwise(F.lit(0).cast("long")))
    count = lambda c: F.count(F.when(c, 1))
    after = own & (F.col("runs") > 2) & (F.col("second") != F.col("len"))
    lens = F.concat(F.when(own, F.col("lens")).otherwise(F.array().cast("array<bigint>")), F.array("len"))
    out = d.groupBy(*keys).agg(
        once("frames").alias("frames"),
        (once("closed") + count(start)).alias("unique"),
        (once("repeated") + count(start & (F.col("len") > 1))).alias("repeated_runs"),
        # Distinct lengths of runs that tile n rows number at most sqrt(2 n).
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(lens)))).alias("run_lengths"),
        (once("changes") + count(after) + count(start & (F.col("prev_len") != F.col("len")))).alias("length_changes"),
        F.min("first_gap").alias("first_gap"),
        once("bad_hashes").alias("bad_hashes"),
    )
    out = out.select(
        *keys, "frames", "unique", (F.col("frames") - F.col("unique")).alias("duplicates"), "repeated_runs", F.array_min("run_lengths").alias("min_run"),
        F.array_max("run_lengths").alias("max_run"), "run_lengths", "length_changes", "first_gap", "bad_hashes",
    )
    return with_verdict(out, (F.col("first_gap").isNotNull(), "timeline is not contiguous"), (F.col("bad_hashes") > 0, "invalid digest"))


def padded_capture_guard(profile: DataFrame, expected_frames: str = "expected_frames") -> DataFrame:
    """Adds ``guarded``: the profile is a believable padded capture of the expected length."""
    c = F.col
    good = (
        (c("frames") == c(expected_frames)) & (c("frames") >= 8) & (c("unique") >= 4) & (c("duplicates") >= 2)
        & (c("repeated_runs") >= 2) & (c("max_run") <= 8) & (c("duplicates") * 5 <= c("frames") * 4)
    )
    return profile.withColumn("guarded", F.coalesce(good, F.lit(False)))


def snap_to_keyframe(
    requests: DataFrame,
    keyframes: DataFrame,
    *,
    keys: Sequence[str] = KEYS,
    request_id: str = "request_id",
    t: str = "t_us",
    key_t: str = "t_us",
    minimum: str | None = None,
    tolerance_us: int = 1,
    block_us: int = BLOCK_US,
) -> DataFrame:
    """As-of join: latest keyframe at or before each request (plus the tolerance).

    Keyframes and requests are merged on one time axis and a stitched running maximum carries
    the last keyframe forward, so neither side is broadcast and no stream sits in one task.
    With ``minimum`` only keyframes at or after it count, and the minimum itself is used when the
    request sits on it.
    """
    keys = list(keys)
    none = F.lit(None).cast("long")
    asks = requests.select(
        *keys, (F.col(t) + tolerance_us).alias("__at"), F.lit(1).alias("__kind"), F.col(request_id).alias("__id"),
        none.alias("__key"), F.col(t).alias("__t"), (F.col(minimum) if minimum else none).alias("__min"),
    )
    marks = keyframes.where(F.col(key_t) >= 0).select(
        *keys, F.col(key_t).alias("__at"), F.lit(0).alias("__kind"), none.alias("__id"), F.col(key_t).alias("__key"),
        none.alias("__t"), none.alias("__min"),
    ).distinct()
    d = running(
        marks.unionByName(asks), keys=keys, order=["__at", "__kind"], maxes={"__last": "__key"}, block=blocks.time_block("__at", block_us)
    ).where(F.col("__kind") == 1)
    found = F.col("__last")
    if minimum:
        found = F.when(found >= F.col("__min") - tolerance_us, found)
        found = F.coalesce(found, F.when(F.col("__t") <= F.col("__min") + tolerance_us, F.col("__min")))
    return d.select(*keys, F.col("__id").alias(request_id), F.col("__t").alias(t), found.alias("keyframe_us"))
