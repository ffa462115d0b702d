"""Catalogue work: stream selection, tags, rates, layout comparison, inventories, set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reeltally.functions import exprs as X
from reeltally.plans.blocks import BLOCK_ROWS, attach, neighbours, numbered, running
from reeltally.plans.session import materialise
from reeltally.plans.verdicts import reasons, with_verdict

MEDIA_KINDS = ("video", "audio", "subtitle", "data")
START_TOLERANCE_US = 2_000
# Compared fields of a stream, and those a colour edit may change.
SIGNATURE_FIELDS = (
    "kind", "codec", "codec_tag", "profile", "time_base", "frame_rate", "pixel_format", "channel_layout", "field_order",
    "sample_aspect_ratio", "color_range", "color_space", "color_transfer", "color_primaries", "chroma_location",
    "width", "height", "sample_rate", "channels", "extradata_size",
)
COLOUR_BLIND = (
    "time_base", "codec_tag", "frame_rate", "color_range", "color_space", "color_transfer", "color_primaries", "chroma_location",
)
CONTAINER_DERIVED = ("ENCODER", "CREATION_TIME", "DATE", "WRITING_APP", "MUXING_APP")
STREAM_DERIVED = (
    "DURATION", "NUMBER_OF_FRAMES", "NUMBER_OF_BYTES", "BPS",
    "_STATISTICS_WRITING_APP", "_STATISTICS_WRITING_DATE_UTC", "_STATISTICS_TAGS",
)


def select_streams(streams: DataFrame, selection: DataFrame, *, key: str = "file_id") -> DataFrame:
    """Selected streams in the caller's order.

    ``selection``: ``indices ARRAY<INT>`` per file.  Missing streams stay as rows with null columns.
    """
    want = selection.select(key, F.posexplode("indices").alias("position", "stream_index"))
    want = want.withColumn("position", F.col("position").cast("long")).withColumn("stream_index", F.col("stream_index").cast("long"))
    return want.join(streams.withColumn("__found", F.lit(True)), [key, "stream_index"], "left").withColumn(
        "found", F.coalesce("__found", F.lit(False))
    ).drop("__found")


def selection_verdict(selected: DataFrame, *, key: str = "file_id") -> DataFrame:
    """Unknown indices, unsupported kinds, media after an attachment, or no media at all."""
    media = F.col("kind").isin(*MEDIA_KINDS)
    supported = media | (F.col("kind") == "attachment")
    out = selected.groupBy(key).agg(
        F.count(F.lit(1)).alias("selected"),
        F.count(F.when(~F.col("found"), 1)).alias("__unknown"),
        F.count(F.when(F.col("found") & ~F.coalesce(supported, F.lit(False)), 1)).alias("__odd"),
        F.count(F.when(media, 1)).alias("media"),
        F.max(F.when(media, F.col("position"))).alias("__last_media"),
        F.min(F.when(F.col("kind") == "attachment", F.col("position"))).alias("__first_attachment"),
    )
    return with_verdict(
        out,
        (F.col("__unknown") > 0, "stream not found"),
        (F.col("__odd") > 0, "unsupported stream kind"),
        (F.col("__last_media") > F.col("__first_attachment"), "attachments must come last"),
        (F.col("media") == 0, "no media stream selected"),
    ).drop("__unknown", "__odd", "__last_media", "__first_attachment")


def stable_tags(rows: DataFrame, *, tags: str = "tags") -> DataFrame:
    """Adds ``stable_tags``: the tags a rewrite must keep."""
    return rows.withColumn("stable_tags", X.stable_tags(tags))


def classify_rate_mode(streams: DataFrame, *, avg: str = "avg_rate", nominal: str = "nominal_rate") -> DataFrame:
    """Adds ``constant_candidate`` (rates equal by cross multiplication) and ``vfr_mismatch`` (over 0.5 % apart)."""
    a, n = F.col(avg), F.col(nominal)
    value = lambda r: r["num"] / r["den"]
    known = a.isNotNull() & n.isNotNull()
    mismatch = F.abs(value(n) - value(a)) > value(a) * 0.005
    return streams.withColumns({
        "constant_candidate": known & F.coalesce(X.same_rate(a, n), F.lit(False)),
        "vfr_mismatch": known & F.coalesce(mismatch, F.lit(False)),
    })


def estimate_frame_count(streams: DataFrame, *, rate: str = "avg_rate") -> DataFrame:
    """Adds ``frame_count``: declared, else a plausible tag, else duration times rate.

    Needs ``nb_frames`` text, ``tags``, ``duration_s`` (stream) and ``container_s``.
    """
    whole = lambda t: F.when(X.unsigned(t) > 0, X.unsigned(t))
    seconds = F.coalesce("duration_s", "container_s")
    guess = F.round(seconds * F.col(rate)["num"] / F.col(rate)["den"])
    guess = F.when(guess >= 1, guess.cast("long"))
    hit = F.map_values(F.map_filter("tags", lambda k, _: F.lower(k) == "number_of_frames"))
    tagged = whole(F.get(hit, F.lit(0)))
    margin = F.greatest(F.call_function("div", guess, F.lit(50)), F.lit(2).cast("long"))
    plausible = F.when(guess.isNull() | (F.abs(tagged - guess) <= margin), tagged)
    return streams.withColumn("frame_count", F.coalesce(whole(F.col("nb_frames")), plausible, guess))


def duplicate_target_check(
    profiles: DataFrame, *, frames: str = "frames", unique: str = "unique", source: str = "source_rate", target: str = "target_rate"
) -> DataFrame:
    """Unique frames must equal the frame count the lower output rate needs, in exact integers."""
    wide = lambda c: c.try_cast("decimal(12,0)")
    s, t = X.reduced(source), X.reduced(target)
    den = wide(s["num"]) * wide(t["den"])
    num = (F.col(frames).try_cast("decimal(14,0)") * wide(s["den"]) * wide(t["num"])).cast("decimal(38,0)")
    half = F.call_function("div", den, F.lit(2).cast("decimal(1,0)"))
    due = F.call_function("div", num + half, den).try_cast("bigint")
    lower = (wide(t["num"]) * wide(s["den"])) < (wide(s["num"]) * wide(t["den"]))
    d = profiles.withColumn("expected_unique", due)
    return with_verdict(d, (lower.isNull() | due.isNull(), "rate out of range"), (~lower, "output rate is not lower"), (F.col(unique) != F.col("expected_unique"), "unique frames do not match the rate"))


def padding_ratio(streams: DataFrame, *, frames: str = "frames", duration: str = "duration_s", rate: str = "avg_rate") -> DataFrame:
    """Adds coded frames over due frames; ``padded`` above 1.02."""
    due = F.round(F.col(duration) * F.col(rate)["num"] / F.col(rate)["den"])
    due = F.when(due >= 1, due.cast("long"))
    return streams.withColumn("due_frames", due).withColumn("padding_ratio", F.col(frames) / F.col("due_frames")).withColumn(
        "padded", F.col("padding_ratio") > 1.02
    )


def assemble_tracks(plan: DataFrame, streams: DataFrame, files: DataFrame, *, key: str = "plan_id") -> DataFrame:
    """Tracks of a multi-source plan in order with overrides applied.

    ``plan``: ``position, source_id, stream_index, title, language, is_default, is_forced, is_primary,
    is_metadata_owner``; a null override keeps the source value and an empty one clears it.  Duration
    stays with the primary source while container title and language come from the metadata owner.
    """
    s = streams.select(
        F.col("file_id").alias("source_id"), "stream_index", "kind", "codec",
        F.col("title").alias("__title"), F.col("language").alias("__language"),
        F.col("is_default").alias("__default"), F.col("is_forced").alias("__forced"),
    )
    pick = lambda c, old: F.when(F.col(c).isNull(), F.col(old)).otherwise(F.nullif(F.col(c), F.lit("")))
    d = plan.join(s, ["source_id", "stream_index"], "left")
    roles = plan.groupBy(key).agg(
        F.max(F.when(F.col("is_metadata_owner"), F.col("source_id"))).alias("owner"),
        F.max(F.when(F.col("is_primary"), F.col("source_id"))).alias("primary"),
    ).withColumn("owner", F.coalesce("owner", "primary"))
    f = files.select(F.col("file_id"), "duration_s", F.col("title").alias("container_title"))
    roles = roles.join(f.select(F.col("file_id").alias("primary"), "duration_s"), "primary", "left")
    roles = roles.join(f.select(F.col("file_id").alias("owner"), "container_title"), "owner", "left")
    out = d.select(
        key, "position", "source_id", "stream_index", "kind", "codec",
        pick("title", "__title").alias("title"), pick("language", "__language").alias("language"),
        F.coalesce("is_default", "__default").alias("is_default"), F.coalesce("is_forced", "__forced").alias("is_forced"),
        F.col("kind").isNotNull().alias("found"),
    )
    return attach(out, roles.select(key, "duration_s", "container_title"), [key], spread="position")


def _tag_field(field: str) -> bool:
    return field in ("codec_tag", "field_order", "sample_aspect_ratio", "chroma_location") or field.startswith("color_")


def _signature_texts(fields: Sequence[str]) -> Column:
    """Texts of the signature fields; unset ratios and the default field order are null."""
    unset = {"sample_aspect_ratio": "0/0", "frame_rate": "0/0", "field_order": "progressive"}
    text = lambda f: F.when(F.col(f).cast("string") != unset[f], F.col(f).cast("string")) if f in unset else F.col(f).cast("string")
    return F.array(*[text(f) for f in fields])


def _upper_tags(tags: str | Column, dropped: Sequence[str]) -> Column:
    """Tags with upper-cased keys, without those a container derives itself."""
    present = F.coalesce(F.col(tags) if isinstance(tags, str) else tags, F.expr("map()").cast("map<string,string>"))
    return X.fold_keys(F.map_filter(present, lambda k, _: ~F.upper(k).isin(*dropped)), F.upper)


def _tags_text(tags: Column) -> Column:
    """Tags as one text that is equal where they are equal as sets: sorted, each part behind its length, null values as ``-``."""
    part = lambda t: F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)
    entry = lambda e: F.concat(part(e["key"]), F.coalesce(part(e["value"]), F.lit("-")))
    return F.array_join(F.transform(F.array_sort(F.map_entries(tags)), entry), "")


def compare_stream_layout(
    expected: DataFrame, actual: DataFrame, *, pair: str = "pair_id", position: str = "position", colour: bool = True
) -> DataFrame:
    """Every differing field of two files' streams by position: signature, dispositions, stable tags.

    The right side may carry extra tags.  A stream missing on one side gives one ``stream`` row.
    """
    on = [pair, position]
    fields = [f for f in SIGNATURE_FIELDS if colour or f not in COLOUR_BLIND]
    absent = [f for f in fields if f not in expected.columns or f not in actual.columns]
    if absent:
        raise ValueError(f"fields missing from a side: {', '.join(absent)}")

    kinds = {"marks": [f for f in fields if _tag_field(f)], "plain": [f for f in fields if not _tag_field(f)]}

    def side(df: DataFrame, tag: str) -> DataFrame:
        forms = {**{n: _signature_texts(of) for n, of in kinds.items()}, "disposition": F.col("disposition").cast("map<string,string>"), "tags": F.col("tags")}
        return df.select(*on, F.lit("present").alias(f"{tag}_stream"), *[c.alias(f"{tag}_{n}") for n, c in forms.items()])

    # One row per stream is shuffled; fields are compared in place and only those that differ become rows.  Fields lie in arrays with one
    # rule for their elements, as an expression for each makes a method too long for the JVM to compile; what is equal as it
    # stands, most of it, is not brought to its comparable form.
    d = side(expected, "l").join(side(actual, "r"), on, "full")
    empty = F.expr("map()").cast("map<string,string>")
    nothing = F.array().cast("array<struct<part:string,field:string,expected:string,actual:string>>")
    row = lambda part, field, l, r: F.struct(F.lit(part).alias("part"), field.alias("field"), l.alias("expected"), r.alias("actual"))
    differing = lambda rows: F.filter(rows, lambda e: ~e["expected"].eqNullSafe(e["actual"]))

    def signature(kind: str, form=lambda c: c) -> Column:
        l, r = F.col(f"l_{kind}"), F.col(f"r_{kind}")
        names = F.array(*[F.lit(f) for f in kinds[kind]]).cast("array<string>")
        rows = F.transform(names, lambda f, i: row("signature", f, form(F.get(l, i)), form(F.get(r, i))))
        return F.when(l.eqNullSafe(r), nothing).otherwise(differing(rows))

    def entries(column: str, part: str, names, form=lambda c: F.coalesce(c, empty)) -> Column:
        l, r = F.col(f"l_{column}"), F.col(f"r_{column}")
        rows = lambda l, r: F.transform(names(F.map_keys(l), F.map_keys(r)), lambda k: row(part, k, F.try_element_at(l, k), F.try_element_at(r, k)))
        found = X.once(form(l), lambda l: X.once(form(r), lambda r: differing(rows(l, r))))
        return F.when(F.map_entries(l).eqNullSafe(F.map_entries(r)), nothing).otherwise(found)

    lone = differing(F.array(row("stream", F.lit("stream"), F.col("l_stream"), F.col("r_stream"))))
    maps = [entries("disposition", "disposition", F.array_union), entries("tags", "tag", lambda l, _: l, lambda c: _upper_tags(c, STREAM_DERIVED))]
    found = F.concat(lone, signature("plain"), signature("marks", X.known_colour), *maps)
    return d.select(*on, F.explode(found).alias("d")).select(*on, "d.*")


def layout_verdict(differences: DataFrame, pairs: DataFrame, *, pair: str = "pair_id") -> DataFrame:
    """Per pair: whether the streams are compatible and how many fields differ."""
    n = differences.groupBy(pair).agg(
        F.count(F.lit(1)).alias("differences"), F.count(F.when(F.col("part") == "stream", 1)).alias("__streams")
    )
    d = pairs.select(pair).distinct().join(n, pair, "left").withColumn("differences", F.coalesce("differences", F.lit(0).cast("long")))
    return with_verdict(d, (F.col("__streams") > 0, "different stream counts"), (F.col("differences") > 0, "stream differs")).drop("__streams")


def compare_containers(
    expected: DataFrame, actual: DataFrame, expected_chapters: DataFrame, actual_chapters: DataFrame, *, pair: str = "pair_id"
) -> DataFrame:
    """Verdict per pair: stable container tags equal as sets; chapters equal in count, times and tags."""
    text = _tags_text(_upper_tags("tags", CONTAINER_DERIVED))
    tags = lambda df, n: df.select(pair, text.alias(n))
    files = tags(expected, "l").join(tags(actual, "r"), pair, "full").select(pair, (~F.col("l").eqNullSafe(F.col("r"))).alias("tags_differ"))

    # A task sorts the chapters of both sides by the million, so their rows are flat: numbers and one text, which is never null.
    chapters = lambda df, n: df.select(pair, "position", F.col("start_us").alias(f"{n}_start_us"), F.col("end_us").alias(f"{n}_end_us"), text.alias(f"{n}_tags"))
    c = chapters(expected_chapters, "l").join(chapters(actual_chapters, "r"), [pair, "position"], "full")
    both = lambda f: (F.col(f"l_{f}"), F.col(f"r_{f}"))
    near = lambda l, r: F.coalesce(F.abs(l - r) <= START_TOLERANCE_US, l.isNull() & r.isNull())
    lone = F.col("l_tags").isNull() | F.col("r_tags").isNull()
    moved = ~near(*both("start_us")) | ~near(*both("end_us")) | (F.col("l_tags") != F.col("r_tags"))
    per = c.groupBy(pair).agg(
        F.count(F.when(lone, 1)).alias("unmatched_chapters"),
        F.min(F.when(~lone & moved, F.col("position"))).alias("first_changed_chapter"),
    )
    d = files.join(per, pair, "left").withColumn("unmatched_chapters", F.coalesce("unmatched_chapters", F.lit(0).cast("long")))
    return with_verdict(
        d,
        (F.col("tags_differ"), "container metadata differs"),
        (F.col("unmatched_chapters") > 0, "chapter missing"),
        (F.col("first_changed_chapter").isNotNull(), "chapter changed"),
    )


def lost_tags(expected: DataFrame, actual: DataFrame, *, on: Sequence[str], tags: str = "tags", container: bool = False) -> DataFrame:
    """Expected tags that the output lost or changed; a key with spaces may come back with underscores."""
    on = list(on)
    want = expected.select(*on, F.explode(X.stable_tags(tags)).alias("key", "value"))
    if container:
        want = want.where(~F.col("key").isin(*X.BRAND_TAGS))
    have = actual.select(*on, X.stable_tags(tags).alias("__have"))
    d = want.join(have, on, "left")
    plain = F.try_element_at("__have", F.col("key"))
    folded = F.when(F.contains("key", F.lit(" ")), F.try_element_at("__have", F.replace("key", F.lit(" "), F.lit("_"))))
    found = F.coalesce(plain, folded)
    return d.withColumn("found", found).where(~F.col("value").eqNullSafe(F.col("found"))).drop("__have")


def verify_output_streams(expected: DataFrame, actual: DataFrame, *, on: Sequence[str] = ("file_id", "position")) -> DataFrame:
    """Failed rules per output position, comma-joined; empty means the stream is as planned.

    ``expected`` may set ``encoded``, ``converted_audio`` and ``converted_subtitle``; its codec, size, rate and
    channels are then the planned ones.
    """
    on = list(on)
    cols = ["kind", "codec", "codec_tag", "width", "height", "sample_rate", "channels", "start_us", "packets", "extradata_hash"]
    flags = ["encoded", "converted_audio", "converted_subtitle"]
    e = expected.select(*on, *[F.col(c).alias(f"e_{c}") for c in cols], *flags, F.lit(True).alias("__e"))
    a = actual.select(*on, *[F.col(c).alias(f"a_{c}") for c in cols], F.lit(True).alias("__a"))
    d = e.join(a, on, "full")
    for f in flags:
        d = d.withColumn(f, F.coalesce(f, F.lit(False)))
    differ = lambda c: ~F.col(f"e_{c}").eqNullSafe(F.col(f"a_{c}"))
    both = F.col("__e") & F.col("__a")
    attachment = F.col("e_kind") == "attachment"
    timed = ~F.col("converted_audio") & ~F.col("converted_subtitle") & ~attachment & F.col("e_start_us").isNotNull()
    moved = ~F.coalesce(F.abs(F.col("a_start_us") - F.col("e_start_us")) <= START_TOLERANCE_US, F.lit(False))
    copied = ~F.col("encoded") & ~F.col("converted_audio") & ~F.col("converted_subtitle")
    empty = F.col("e_kind").isin("video", "audio") & ~F.coalesce(F.col("e_packets") > 0, F.lit(False))
    rules = [
        (F.col("__a").isNull() | F.col("__e").isNull(), "stream count"),
        (both & timed & moved, "start"),
        (both & differ("kind"), "kind"),
        (both & (F.col("e_kind") == "data") & differ("codec_tag"), "codec tag"),
        (both & differ("codec"), "codec"),
        (both & (differ("width") | differ("height")), "size"),
        (both & differ("sample_rate"), "sample rate"),
        (both & differ("channels"), "channels"),
        (both & copied & (empty | differ("packets")), "packets"),
        (both & attachment & (F.col("e_extradata_hash").isNull() | differ("extradata_hash")), "attachment"),
    ]
    return d.select(*on, reasons(*rules).alias("failed")).withColumn("ok", F.col("failed") == "")


def required_duration(selected: DataFrame, files: DataFrame, *, key: str = "file_id") -> DataFrame:
    """End every output must reach: longest audio, video or data track, else copied subtitles, else the container.

    ``selected``: ``kind, duration_s, converted_subtitle`` per chosen stream; ``files``: ``duration_s``.
    """
    k = F.col("kind")
    media = k.isin("video", "audio", "data")
    copied = (k == "subtitle") & ~F.coalesce(F.col("converted_subtitle"), F.lit(False))
    d = selected.groupBy(key).agg(
        F.count(F.when(media, 1)).alias("__media"), F.max(F.when(media, F.col("duration_s"))).alias("__m"),
        F.count(F.when(copied, 1)).alias("__copied"), F.max(F.when(copied, F.col("duration_s"))).alias("__s"),
    ).join(files.select(key, F.col("duration_s").alias("container_s")), key, "left")
    need = F.when(F.col("__media") > 0, F.coalesce("__m", "container_s")).when(F.col("__copied") > 0, F.coalesce("__s", "container_s"))
    return d.withColumn("required_s", need).drop("__media", "__m", "__copied", "__s")


def stream_end(streams: DataFrame, files: DataFrame, *, key: str = "file_id") -> DataFrame:
    """Latest end per file: start plus span, else the absolute DURATION tag; the container only as a fallback.

    A matroska or webm container duration already counts from zero, any other adds its start.
    """
    zero = F.lit(0.0)
    own = F.coalesce(F.col("duration_s") + F.coalesce("start_s", zero), X.tag_clock(X.tag("tags", "duration")))
    ends = streams.groupBy(key).agg(F.max(own).alias("__track"))
    relative = F.exists(F.split("format", ","), lambda x: x.isin("matroska", "webm"))
    box = F.col("duration_s") + F.when(F.coalesce(relative, F.lit(False)), zero).otherwise(F.coalesce("start_s", zero))
    d = files.select(key, box.alias("__box")).join(ends, key, "left")
    return d.select(key, F.coalesce("__track", "__box").alias("end_s"))


def sort_files(files: DataFrame, by: str = "name", descending: bool = False, *, collation: str = "UNICODE") -> DataFrame:
    """Total order by name (locale), size (exact) or modification time.

    Unknown times come first ascending and last descending; ``path`` breaks ties.
    """
    if by == "name":
        c = F.expr(f"collate(name, '{collation}')")
        first = [c.desc() if descending else c.asc()]
    elif by == "size":
        first = [F.col("size_bytes").desc() if descending else F.col("size_bytes").asc()]
    elif by == "mtime":
        first = [F.col("modified_at").desc_nulls_last() if descending else F.col("modified_at").asc_nulls_first()]
    else:
        raise ValueError(by)
    return files.orderBy(*first, "path")


def order_folder_frames(
    entries: DataFrame, *, folder: str = "folder", name: str = "name", collation: str = "UNICODE", extension: str | None = None
) -> DataFrame:
    """Images of one extension per folder with their ``position`` in locale order.

    The extension is that of the folder's first name unless given.  Names are range-partitioned
    over the whole table and numbered range by range, so one huge folder spreads over tasks.
    """
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    collated = F.expr(f"collate(`{name}`, '{collation}')")
    d = entries.withColumn("extension", ext).where(F.col("extension").isin(*X.IMAGE_EXTENSIONS))
    if extension is None:
        first = d.groupBy(folder).agg(F.min(collated).alias("__first"))
        plain = F.expr("collate(__first, 'UTF8_BINARY')")
        first = first.select(folder, F.lower(F.regexp_extract(plain, r"\.([^.]+)$", 1)).alias("__ext"))
        d = attach(d, first, [folder], spread=name, dense=False).where(F.col("extension") == F.col("__ext")).drop("__ext")
    else:
        d = d.where(F.col("extension") == extension.lower())
    ranges = d.withColumn("__key", collated).repartitionByRange(folder, "__key", name).drop("__key")
    # Range bounds come from sampling, so the assignment is written down before it is used twice.
    placed = materialise(ranges.withColumn("__range", F.spark_partition_id().cast("long"))).withColumn("__key", collated)
    return numbered(placed, keys=[folder], order=["__key", name], name="position", block=F.col("__range")).drop("__key", "__range")


def concat_timelines(rows: DataFrame, inputs: DataFrame, *, key: str = "job_id", t: str = "t_us") -> DataFrame:
    """Rows of ordered inputs on one clock: each input is shifted by the durations before it.

    ``inputs``: ``position, source_id, duration_us`` per job; see :func:`concat_verdict` for the admission rules.
    """
    shifts = running(inputs.select(key, "position", "source_id", "duration_us"), keys=[key], order=["position"], sums={"offset_us": "duration_us"})
    d = attach(rows, shifts.select(key, "position", "offset_us"), [key, "position"], spread="ordinal", how="inner")
    return d.withColumn(t, F.col(t) + F.col("offset_us")).drop("offset_us")


def concat_verdict(inputs: DataFrame, *, key: str = "job_id") -> DataFrame:
    """Two or more distinct inputs of one layout; ``layout`` is any comparable signature of the input's streams."""
    folded = F.lower("source_id")
    d = inputs.groupBy(key).agg(
        F.count(F.lit(1)).alias("inputs"), F.count_distinct(folded).alias("distinct_inputs"), F.count_distinct("layout").alias("layouts")
    )
    return with_verdict(
        d,
        (F.col("inputs") < 2, "needs two inputs"),
        (F.col("distinct_inputs") < F.col("inputs"), "repeated input"),
        (F.col("layouts") > 1, "incompatible layouts"),
    )


def distinct_inputs(inputs: DataFrame, *, key: str = "job_id", path: str = "path") -> DataFrame:
    """Inputs whose case-folded path repeats within a job, with the number of occurrences."""
    return inputs.groupBy(key, F.lower(path).alias("path_key")).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")


def slice_bounds(files: DataFrame, *, key: str = "file_id") -> DataFrame:
    """Bounds ``frames * i / slices`` of each slice in whole frames."""
    d = files.select(key, "frames", "slices", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    at = lambda i: F.call_function("div", F.col("frames") * i, F.col("slices"))
    return d.select(key, "slice", at(F.col("slice")).alias("from_frame"), at(F.col("slice") + 1).alias("to_frame"))


def merge_scene_slices(scenes: DataFrame, slices: DataFrame, files: DataFrame, *, key: str = "file_id") -> DataFrame:
    """Scenes of all slices shifted to file frames.  ``scenes``: ``slice, list, n, start_frame, end_frame``."""
    b = slice_bounds(files, key=key).select(key, "slice", "from_frame")
    d = scenes.join(b, [key, "slice"])
    return d.select(
        key, "list", "slice", "n", (F.col("start_frame") + F.col("from_frame")).alias("start_frame"), (F.col("end_frame") + F.col("from_frame")).alias("end_frame")
    )


def scene_slice_verdict(scenes: DataFrame, slices: DataFrame, files: DataFrame, *, key: str = "file_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per file: every slice reports its exact length, its lists tile it, and the split list is in all slices or none."""
    b = slice_bounds(files, key=key).withColumn("due", F.col("to_frame") - F.col("from_frame"))
    on = [key, "slice", "list"]
    d = neighbours(scenes.select(*on, "n", "start_frame", "end_frame"), keys=on, order="n", prev=["end_frame"], dense=False, block_rows=block_rows)
    bad = (F.col("start_frame") != F.coalesce("prev_end_frame", F.lit(0))) | (F.col("end_frame") <= F.col("start_frame"))
    lists = d.groupBy(*on).agg(F.count(F.when(bad, 1)).alias("__bad"), F.max("end_frame").alias("__end"))
    per = lists.groupBy(key, "slice").agg(
        F.max("__bad").alias("__bad"), F.min("__end").alias("__lo"), F.max("__end").alias("__hi"),
        F.count(F.when(F.col("list") == "scenes", 1)).alias("__main"), F.count(F.when(F.col("list") == "split_scenes", 1)).alias("__split"),
    )
    j = b.join(slices.select(key, "slice", F.col("frames").alias("reported")), [key, "slice"], "left").join(per, [key, "slice"], "left")
    wrong = ~F.col("reported").eqNullSafe(F.col("due"))
    open_ = (F.coalesce("__main", F.lit(0)) == 0) | (F.col("__bad") > 0) | (F.col("__lo") != F.col("due")) | (F.col("__hi") != F.col("due"))
    out = j.groupBy(key).agg(
        F.count(F.lit(1)).alias("slices"), F.count(F.when(wrong, 1)).alias("wrong_length"), F.count(F.when(open_, 1)).alias("not_tiled"),
        F.sum(F.coalesce("__split", F.lit(0))).alias("__with_split"),
    )
    return with_verdict(
        out,
        (F.col("wrong_length") > 0, "slice reports the wrong frame count"),
        ((F.col("__with_split") > 0) & (F.col("__with_split") < F.col("slices")), "slices disagree on split scenes"),
        (F.col("not_tiled") > 0, "scenes do not tile a slice"),
    ).drop("__with_split")


def folder_set_diff(stored: DataFrame, current: DataFrame, *, key: str = "folder", name: str = "name", stamp: str = "stamp") -> DataFrame:
    """Stored against current frame names: added, removed or changed entries."""
    s = stored.select(key, name, F.col(stamp).alias("__old"), F.lit(1).alias("__s"))
    c = current.select(key, name, F.col(stamp).alias("__new"), F.lit(1).alias("__c"))
    d = s.join(c, [key, name], "full")
    change = (
        F.when(F.col("__c").isNull(), "removed").when(F.col("__s").isNull(), "added").when(~F.col("__old").eqNullSafe(F.col("__new")), "changed")
    )
    return d.withColumn("change", change).where(F.col("change").isNotNull()).select(key, name, "change")


def detect_changed_sources(before: DataFrame, after: DataFrame, *, path: str = "path", fingerprint: str = "fingerprint") -> DataFrame:
    """Two inventory snapshots: paths that are new, missing or have another fingerprint."""
    b = before.select(path, F.col(fingerprint).alias("__b"))
    a = after.select(path, F.col(fingerprint).alias("__a"))
    status = F.when(F.col("__b").isNull(), "new").when(F.col("__a").isNull(), "missing").when(F.col("__a") != F.col("__b"), "changed").otherwise("same")
    return b.join(a, path, "full").select(path, status.alias("status"))


def file_fingerprint(path: Column, length: Column, modified_us: Column, samples: Mapping[str, Column]) -> Column:
    """Digest of path, length, time and the sampled byte ranges (start, middle, end)."""
    return F.sha2(F.concat_ws("\x1f", path, length.cast("string"), modified_us.cast("string"), *[F.sha2(c, 256) for c in samples.values()]), 256)
