"""Scalar column expressions: clocks, rationals, tags, units.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Fixed values -------------------------------------------------------------
MEDIA_EXTENSIONS = (
    "mkv", "mp4", "m4v", "mov", "avi", "webm", "m2ts", "mts", "ts", "mpeg", "mpg", "wmv", "flv", "ogv",
    "vob", "3gp", "mxf", "mp3", "flac", "wav", "m4a", "aac", "ogg", "opus", "aif", "aiff", "alac",
)
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "webp")
UNSET_COLOURS = ("unknown", "unspecified", "reserved")
GENERIC_HANDLERS = ("VideoHandler", "SoundHandler", "SubtitleHandler")
TERMINAL_STATES = ("succeeded", "failed", "canceled", "interrupted", "stopped")
RECOVERABLE_STATES = ("stopped", "failed", "interrupted", "canceled")
BRAND_TAGS = ("major_brand", "minor_version", "compatible_brands")
DERIVED_TAGS = (
    "encoder", "encoder_settings", "duration", "bps", "number_of_frames", "number_of_bytes", "creation_time",
)
# --------------------------------------------------------------------------


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(text: ColumnOrName) -> Column:
    """Text without surrounding white space of any kind; ``trim`` alone removes only blanks."""
    return F.btrim(_c(text), F.lit(" \t\r\n\x0b\x0c"))


# Fixed value: decimal number syntax.  Java also parses "1d" or "0x1p3", which must not pass.
DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def finite(text: ColumnOrName, limit: float | None = 9e12) -> Column:
    """Number from text, null unless finite (and within ``limit`` in magnitude)."""
    x = F.when(_c(text).rlike(DECIMAL), _c(text).try_cast("double"))
    ok = F.abs(x) < float("inf")
    if limit is not None:
        ok = ok & (F.abs(x) <= limit)
    return F.when(ok, x)


def seconds_us(text: ColumnOrName) -> Column:
    """Decimal seconds as whole microseconds; ``N/A``, NaN, infinities and huge values are null."""
    return F.round(finite(text) * 1e6).cast("long")


def unsigned(text: ColumnOrName) -> Column:
    """Non-negative whole number from text."""
    t = _c(text)
    return F.when(t.rlike(r"^\+?[0-9]+$"), t.try_cast("bigint"))


def signed(text: ColumnOrName) -> Column:
    t = _c(text)
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint"))


def rational(text: ColumnOrName, sep: str = "/") -> Column:
    """``num/den`` as a struct when both are positive whole numbers, else null."""
    t = _c(text)
    num = F.split(t, sep, 2).getItem(0).try_cast("bigint")
    den = F.split(t, sep, 2).getItem(1).try_cast("bigint")
    good = t.rlike(f"^[0-9]+{sep}[0-9]+$") & (num > 0) & (den > 0)
    return F.when(good, F.struct(num.alias("num"), den.alias("den")))


def reduced(rate: ColumnOrName) -> Column:
    """A rational struct in lowest terms, by Euclid's rule; 92 steps are enough for 64 bits."""
    r = _c(rate)
    start = F.struct(r["num"].alias("a"), r["den"].alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b")))
    common = F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step)["a"]
    return F.struct(F.call_function("div", r["num"], common).alias("num"), F.call_function("div", r["den"], common).alias("den"))


def same_rate(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Two rational structs are equal by cross multiplication."""
    a, b = _c(a), _c(b)
    wide = lambda x: x.cast("decimal(19,0)")
    return wide(a["num"]) * wide(b["den"]) == wide(b["num"]) * wide(a["den"])


def reduced(value: ColumnOrName) -> Column:
    """Rational struct divided by its greatest common divisor."""
    v = _c(value)
    start = F.struct(v["num"].alias("a"), v["den"].alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b")))
    # 64-bit Euclid needs at most 92 steps.
    gcd = F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step)["a"]
    div = lambda x: F.call_function("div", x, gcd)
    return F.when(v.isNotNull(), F.struct(div(v["num"]).alias("num"), div(v["den"]).alias("den")))


def tag_clock(text: ColumnOrName) -> Column:
    """``h:mm:ss.f`` as seconds; minutes and seconds below 60; anything else null."""

    def parts(p: Column) -> Column:
        read = F.struct(unsigned(p.getItem(0)).alias("h"), unsigned(p.getItem(1)).alias("m"), p.getItem(2).try_cast("double").alias("s"))
        return F.when(F.size(p) == 3, read)

    def seconds(c: Column) -> Column:
        good = c["h"].isNotNull() & (c["m"] < 60) & (c["s"] >= 0) & (c["s"] < 60)
        return F.when(good, c["h"] * F.lit(3600.0) + c["m"] * F.lit(60.0) + c["s"])

    # The text is often a search of tags, which each use would repeat.
    return once(F.split(_c(text), ":"), lambda p: once(parts(p), seconds))


def cue_clock(text: ColumnOrName) -> Column:
    """``[h:]m:s`` with comma or dot fraction, in seconds; null when any part is unusable."""
    parts = F.split(strip(_c(text)), ":")
    nums = F.transform(parts, lambda p: finite(F.replace(p, F.lit(","), F.lit(".")), None))
    usable = F.size(parts).between(2, 3) & F.forall(nums, lambda x: F.coalesce(x >= 0, F.lit(False)))
    total = F.aggregate(nums, F.lit(0.0), lambda acc, x: acc * 60.0 + x)
    return F.when(usable, total)


def srt_clock_ms(text: ColumnOrName) -> Column:
    """Strict ``h:m:s,ms`` in milliseconds."""
    g = lambda i: F.regexp_extract(strip(_c(text)), r"^([0-9]+):([0-9]+):([0-9]+),([0-9]+)$", i).try_cast("bigint")
    good = (g(2) < 60) & (g(3) < 60) & (g(4) < 1000)
    return F.when(good, ((g(1) * 60 + g(2)) * 60 + g(3)) * 1000 + g(4))


def format_clock(ms: ColumnOrName, dialect: ColumnOrName) -> Column:
    """Milliseconds as ``h:mm:ss.cc`` (ass), ``hh:mm:ss,mmm`` (srt) or ``hh:mm:ss.mmm``."""
    ms, dialect = F.greatest(_c(ms).cast("long"), F.lit(0).cast("long")), _c(dialect)

    def clock(ticks: Column, per_second: int, pattern: str) -> Column:
        s = F.call_function("div", ticks, F.lit(per_second))
        return F.format_string(
            pattern, F.call_function("div", s, F.lit(3600)), F.call_function("div", s, F.lit(60)) % 60, s % 60,
            ticks % per_second,
        )

    centis = F.round(ms / 10.0).cast("long")
    return (
        F.when(dialect == "ass", clock(centis, 100, "%d:%02d:%02d.%02d"))
        .when(dialect == "srt", clock(ms, 1000, "%02d:%02d:%02d,%03d"))
        .otherwise(clock(ms, 1000, "%02d:%02d:%02d.%03d"))
    )


def short_clock(seconds: ColumnOrName) -> Column:
    """``m:ss``, or ``h:mm:ss`` from one hour."""
    s = F.greatest(F.round(_c(seconds)).cast("long"), F.lit(0).cast("long"))
    h = F.call_function("div", s, F.lit(3600))
    m = F.call_function("div", s, F.lit(60)) % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%d:%02d", m, s % 60))


def format_bytes(value: ColumnOrName) -> Column:
    """Byte count with a binary unit."""
    v = _c(value).cast("double")
    out = F.lit("—")
    text = lambda scale, digits, unit: F.concat(F.format_number(v / scale, digits), F.lit(f" {unit}"))
    return (
        F.when(v.isNull() | (v < 0), out)
        .when(v == 0, "0 B")
        .when(v < 1024, text(1.0, 0, "B"))
        .when(v < 1024**2, text(1024.0, 0, "KB"))
        .when(v < 1024**3, text(1024.0**2, 2, "MB"))
        .when(v < 1024**4, text(1024.0**3, 2, "GB"))
        .otherwise(text(1024.0**4, 2, "TB"))
    )


def nonblank(text: ColumnOrName) -> Column:
    t = _c(text)
    return F.when(strip(t) != "", t)


def known_colour(text: ColumnOrName) -> Column:
    t = _c(text)
    return F.when((strip(t) != "") & ~t.isin(*UNSET_COLOURS), t)


def tag(tags: ColumnOrName, name: str) -> Column:
    """First non-blank value whose key matches ``name`` without regard to case."""
    # No character is lower-cased to several that are all ASCII, so keys of another length are not lower-cased at all.
    same = lambda k: F.lower(k) == name.lower()
    alike = (lambda k: (F.length(k) == len(name)) & same(k)) if name.isascii() else same
    hit = F.map_filter(_c(tags), lambda k, v: alike(k) & (strip(v) != ""))
    return F.get(F.map_values(hit), F.lit(0))


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold_keys(tags: ColumnOrName, fold) -> Column:
    """Map with folded keys; the last entry wins when two keys become equal.

    Keys rarely collide, and then a plain key transform is enough; the general form is only evaluated
    for maps in which they do.
    """

    def folded(t: Column) -> Column:
        entries = F.map_entries(t)
        pick = lambda k: F.element_at(F.filter(entries, lambda e: fold(e["key"]) == k), -1)["value"]
        merged = lambda keys: F.map_from_entries(F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("key"), pick(k).alias("value"))))
        plain = lambda keys: F.map_from_arrays(keys, F.map_values(t))
        return once(F.transform(F.map_keys(t), fold), lambda keys: F.when(F.size(F.array_distinct(keys)) == F.size(keys), plain(keys)).otherwise(merged(keys)))

    return once(_c(tags), folded)


def lower_keys(tags: ColumnOrName) -> Column:
    return fold_keys(tags, F.lower)


def is_derived_tag(key: Column) -> Column:
    """Lower-cased tag keys that a container or encoder writes itself."""
    return (
        key.isin(*DERIVED_TAGS)
        | key.startswith("_statistics_")
        | key.rlike("^(duration|encoder|encoder_settings)-[a-z]{3}$")
        | key.rlike("^(bps|number_of_frames|number_of_bytes)-")
    )


def stable_tags(tags: ColumnOrName) -> Column:
    """Tags that must survive a rewrite: lower-cased, derived ones and ``language=und`` dropped."""
    folded = lower_keys(F.coalesce(_c(tags), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    return F.map_filter(folded, lambda k, v: ~is_derived_tag(k) & ~((k == "language") & (v == "und")))


def csv_cell(text: ColumnOrName) -> Column:
    """Quoted cell; doubled quotes; a leading formula character is neutralised."""
    t = _c(text)
    guard = F.when(t.rlike(r"^[=+\-@\t\r]"), F.lit("'")).otherwise(F.lit(""))
    return F.concat(F.lit('"'), guard, F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))


def even_out(low: Column, high: Column) -> tuple[Column, Column]:
    """Edges moved outward to even numbers."""
    div2 = lambda x: F.call_function("div", x, F.lit(2))
    return div2(low) * 2, div2(high + 1) * 2


def display_width(width: ColumnOrName, sar: ColumnOrName) -> Column:
    """Square-pixel width rounded to an even number, null unless positive."""
    s = _c(sar)
    w = (F.round(_c(width) * s["num"] / s["den"] / 2.0) * 2).cast("long")
    return F.when(w > 0, w)


def tail(text: ColumnOrName, start: int) -> Column:
    """The text from character ``start`` (from 1) to its end."""
    return F.substring(_c(text), F.lit(start), F.length(_c(text)))


def path_id(path: ColumnOrName) -> Column:
    return F.concat(F.lit("media-"), F.lpad(F.lower(F.hex(F.xxhash64(_c(path)))), 16, "0"))
