"""Checks after a conversion: readable text of cues, codec configuration records, timecode tracks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reeltally.operators.compare import pair_by_ordinal
from reeltally.plans.verdicts import with_verdict

CUE_TOLERANCE_MS, ASS_TOLERANCE_MS = 1, 10
TIMECODE_SLACK_S = 0.002
ENTITY_CHARS = 16
# Markup that changes no readable text, line breaks, and named characters.
SILENT_TAGS = r"^<(?:/?[biu]|/font|font .*|/?ruby|/?rt|/c|c\..*|/v|v .*|/lang|lang .*)>?$"
BREAK_TAGS = r"^<br(?:| ?/)>?$"
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0"}
# One token after the other: a tag, a terminated entity, a lone ampersand, text.
TOKENS = r"(?s)<[^>]*>?|&[^;\s]{0,18};|&|[^<&]+"


def _entity(token: Column) -> Column:
    """The character of ``&name;``; null for an unknown or impossible one."""
    name = F.substring(token, 2, F.length(token) - 2)
    digits = F.when(name.rlike("^#x[0-9a-fA-F]+$"), F.conv(F.substring(name, 3, ENTITY_CHARS), 16, 10)).when(name.rlike("^#[0-9]+$"), F.substring(name, 2, ENTITY_CHARS))
    code = digits.try_cast("bigint")
    possible = code.between(0, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.when(possible, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    for text, value in NAMED.items():
        char = F.when(name == text, F.lit(value)).otherwise(char)
    return F.when(F.length(name) <= ENTITY_CHARS, char)


def readable_text(body: Column, dialect: Column) -> Column:
    """What a viewer reads of a cue: markup dropped, line breaks kept; null where markup cannot be told from text.

    ASS drops override tags and refuses drawings; other formats know a few tags and character entities and refuse others.
    Spaces before line breaks do not count.
    """
    drawing = body.rlike(r"(?is)\{[^}]*\\p")
    broken = F.regexp_replace(F.regexp_replace(body, r"\\[Nn]", "\n"), r"\\h", " ")
    ass = F.when(~drawing, F.regexp_replace(broken, r"\{[^}]*\}?", ""))

    def said(token: Column) -> Column:
        tag, entity = token.startswith("<"), token.rlike("(?s)^&.*;$")
        known = F.when(token.rlike(BREAK_TAGS), "\n").when(token.rlike("(?s)" + SILENT_TAGS), "")
        return F.when(tag, known).when(entity, _entity(token)).otherwise(token)

    parts = F.transform(F.regexp_extract_all(body, F.lit(TOKENS), F.lit(0)), said)
    marked = F.when(~F.exists(parts, lambda x: x.isNull()), F.array_join(parts, ""))
    text = F.when(dialect == "ass", ass).otherwise(marked)
    return F.regexp_replace(F.replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), F.lit("\r\n"), F.lit("\n")), r"[ \t]+(?=\n|\z)", "")


def cue_text_check(source: DataFrame, target: DataFrame, *, keys: Sequence[str] = ("file_id",), order: str = "n") -> DataFrame:
    """Verdict per file: the converted cues keep number, order, times and readable text.

    Both sides: ``n, format, start_ms, end_ms, body``.  Times may move by a millisecond, or ten where either side is ASS.
    """
    side = lambda d: d.select(*keys, order, "format", "start_ms", "end_ms", readable_text(F.col("body"), F.col("format")).alias("text"))
    pairs = pair_by_ordinal(side(source), side(target), keys=keys, order=order)
    both = F.col("side") == "both"
    slack = F.when((F.col("l_format") == "ass") | (F.col("r_format") == "ass"), ASS_TOLERANCE_MS).otherwise(CUE_TOLERANCE_MS)
    moved = F.coalesce((F.abs(F.col("l_start_ms") - F.col("r_start_ms")) > slack) | (F.abs(F.col("l_end_ms") - F.col("r_end_ms")) > slack), F.lit(True))
    unreadable = F.col("l_text").isNull() | F.col("r_text").isNull()
    bad = both & (moved | unreadable | (F.col("l_text") != F.col("r_text")))
    out = pairs.groupBy(*keys).agg(
        F.count(F.when(F.col("side") != "right", 1)).alias("source_cues"),
        F.count(F.when(F.col("side") != "left", 1)).alias("target_cues"),
        F.count(F.when(both & ~moved & unreadable, 1)).alias("unreadable"),
        F.count(F.when(bad & (moved | ~unreadable), 1)).alias("changed"),
        F.min(F.when(bad, F.col(order))).alias("first_bad"),
        F.min_by(moved | ~unreadable, F.when(bad, F.col(order))).alias("__changed"),
    )
    return with_verdict(
        out,
        (F.col("source_cues") != F.col("target_cues"), "cue count changed"),
        (F.col("__changed"), "readable text, order or timing changed"),
        (F.col("first_bad").isNotNull(), "markup has no certain readable text"),
    ).drop("__changed")


def hex_dump_bytes(text: Column) -> Column:
    """The bytes of a dump of lines ``offset: hex groups  ascii``; null unless every offset is the number of bytes before it."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"\r$", "")), lambda x: F.trim(F.regexp_replace(x, r"\s", " ")) != "")

    def add(state: Column, line: Column) -> Column:
        cut = F.instr(line, ": ")
        offset = F.trim(F.substring(line, F.lit(1), cut - 1))
        # Sixteen bytes are eight groups of four digits and a gutter.
        digits = F.replace(F.substring(line, cut + 2, F.lit(41)), F.lit(" "), F.lit(""))
        good = (cut > 0) & offset.rlike("^[0-9a-fA-F]{1,15}$") & digits.rlike("^(?:[0-9a-fA-F]{2}){1,16}$")
        good = good & (F.conv(offset, 16, 10).try_cast("bigint") * 2 == F.length(state))
        return F.when(F.coalesce(good, F.lit(False)), F.concat(state, digits))

    found = F.aggregate(lines, F.lit(""), add)
    return F.when(F.length(found) > 0, F.unhex(found))


def hevc_config_equal(a: Column, b: Column) -> Column:
    """Two HEVC decoder configuration records are equal but for each array's completeness bit.

    The record is a head of 23 bytes, the last of them the number of arrays; an array is a type, a count and so many units with their
    length in front.  The walk takes one array head or one unit at a time.
    """
    x, y = F.hex(a), F.hex(b)
    size = F.length(a)
    number = lambda at, n: F.conv(F.substring(x, at * 2 + 1, F.lit(n * 2)), 16, 10).cast("int")
    piece = lambda text, at, n: F.substring(text, at * 2 + 1, n * 2)
    kind = lambda text, at: F.conv(F.substring(text, at * 2 + 1, F.lit(2)), 16, 10).cast("int").bitwiseAND(0x7F)
    state = lambda pos, arrays, units: F.struct(pos.cast("int").alias("pos"), arrays.cast("int").alias("arrays"), units.cast("int").alias("units"))

    def step(s: Column, _: Column) -> Column:
        pos, arrays, units = s["pos"], s["arrays"], s["units"]
        head = (pos + 3 <= size) & (kind(x, pos) == kind(y, pos)) & (piece(x, pos + 1, F.lit(2)) == piece(y, pos + 1, F.lit(2)))
        length = number(pos, 2) + 2
        unit = (pos + 2 <= size) & (pos + length <= size) & (piece(x, pos, length) == piece(y, pos, length))
        return (
            F.when((arrays == 0) & (units == 0), s)
            .when((units > 0) & unit, state(pos + length, arrays, units - 1))
            .when((units == 0) & head, state(pos + 3, arrays - 1, number(pos + 1, 2)))
        )

    sound = (size == F.length(b)) & (size >= 23) & (F.substring(x, 1, 2) == "01") & (F.substring(x, 1, 46) == F.substring(y, 1, 46))
    # Every step moves by two bytes at least.
    walked = F.aggregate(F.sequence(F.lit(0), size), state(F.lit(23), number(F.lit(22), 1), F.lit(0)), step)
    done = (walked["pos"] == size) & (walked["arrays"] == 0) & (walked["units"] == 0)
    return F.coalesce(sound & done, F.lit(False))


def codec_config_match(pairs: DataFrame, *, codec: str = "codec", source: str = "source_dump", output: str = "output_dump") -> DataFrame:
    """Verdict per row: the output's codec configuration is the source's; of HEVC, completeness bits may differ."""
    d = pairs.withColumns({"__a": hex_dump_bytes(F.col(source)), "__b": hex_dump_bytes(F.col(output))})
    same = (F.col("__a") == F.col("__b")) | ((F.col(codec) == "hevc") & hevc_config_equal(F.col("__a"), F.col("__b")))
    return with_verdict(
        d,
        (F.col("__a").isNull() | F.col("__b").isNull(), "unreadable configuration"),
        (~F.coalesce(same, F.lit(False)), "configuration differs"),
    ).drop("__a", "__b")


def timecode_check(tracks: DataFrame) -> DataFrame:
    """Verdict per track: the timecode runs at the video's rate and as long as its frames.

    ``tracks``: ``rate`` (text ``num/den``) and ``duration`` (text, seconds) of the timecode, ``rate_num``, ``rate_den`` and ``frames`` of the video.  Rates
    are equal by cross product; the length may be off by a frame and two milliseconds.
    """
    wide = "decimal(20,0)"
    part = lambda i: F.when(F.col("rate").rlike("^[0-9]+/[0-9]+$"), F.element_at(F.split("rate", "/"), i)).try_cast(wide)
    num, den = part(1), part(2)
    valid = F.coalesce((num > 0) & (den > 0), F.lit(False))
    equal = F.col("rate_num").cast(wide) * den.cast("decimal(18,0)") == F.col("rate_den").cast("decimal(18,0)") * num
    frame = F.col("rate_den") / F.col("rate_num")
    actual = F.col("duration").try_cast("double")
    off = F.abs(actual - F.col("frames") * frame) > frame + TIMECODE_SLACK_S
    return with_verdict(
        tracks,
        (~valid, "no valid rate"),
        (~F.coalesce(equal, F.lit(False)), "rate differs"),
        (actual.isNull() | F.isnan(actual), "no duration"),
        (off, "duration differs"),
    )
