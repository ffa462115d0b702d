"""Readable text, configuration records and timecode tracks on small cases."""

import html

import pytest
from pyspark.sql import functions as F

from reeltally.operators import conversion as c


@pytest.mark.parametrize("dialect, body, text", [
    ("srt", "literal & value", "literal & value"),
    ("srt", " leading space  \nnext line ", " leading space\nnext line"),
    ("ass", "a {\\i1}bold{\\i0}\\Nline", "a bold\nline"),
    ("ass", "{\\p1}m 0 0 l 10 10", None),
    ("ass", "{\\P1}x", None),
    ("ass", "one\\htwo\\nthree \\x \\{x}N {open", "one two\nthree \\x \\N"),
    ("ass", "A &amp; B", "A &amp; B"),
    ("srt", "A &amp; B &#39;&#x41;&#66;&nbsp;&gt;", "A & B 'AB >"),
    ("webvtt", "<v Ann>Hi<br>there<br /><c.loud>you</c></v> <i>x</i>", "Hi\nthere\nyou x"),
    ("webvtt", "<font color=\"a\nb\">x</font>", "x"),
    ("srt", "<b", ""),
    ("srt", "<script>", None),
    ("srt", "<00:01.000>", None),
    ("srt", "&bogus;", None),
    ("srt", "&#xD800;", None),
    ("srt", "&#x110000;", None),
    ("srt", "&#128512; &#x4e2d;", "\U0001f600 中"),
    ("srt", "a&b c;d &;", None),
    ("srt", "a&b c;d", "a&b c;d"),
    ("srt", "&aaaaaaaaaaaaaaaaa;", None),
    ("srt", "&aaaaaaaaaaaaaaaaaaa;", "&aaaaaaaaaaaaaaaaaaa;"),
    ("srt", "&lt;b&gt; &amp;amp;", "<b> &amp;"),
    ("srt", "x \t\r\ny", "x\ny"),
    ("ass", "a\u00a0b\u00a0\\Nc", "a b\nc"),
    ("srt", "", ""),
])
def test_readable(spark, dialect, body, text):
    d = spark.createDataFrame([(body, dialect)], "body string, format string")
    assert d.select(c.readable_text(F.col("body"), F.col("format")).alias("t")).first().t == text


def test_every_escaped_text_reads_back(spark):
    texts = ["<a> & \"b\" 'c'", "x < y && z > w", "&amp; &lt;"]
    d = spark.createDataFrame([(html.escape(t), t) for t in texts], "body string, want string")
    assert all(r.t == r.want for r in d.select(c.readable_text(F.col("body"), F.lit("srt")).alias("t"), "want").collect())


def test_conversion_verdicts(spark):
    schema = "file_id long, n long, format string, start_ms long, end_ms long, body string"
    base = [(0, 1000, "A &amp; B"), (2000, 3000, "<i>two</i>"), (4000, 5000, "three")]
    rows = lambda f, fmt, cues: [(f, i, fmt, *x) for i, x in enumerate(cues)]
    source, target = [], []
    cases = {
        1: ("webvtt", base, None), 2: ("ass", [(0, 1000, "A &amp; B"), *base[1:]], "readable text, order or timing changed"),
        3: ("ass", [(4, 1008, "A & B"), (2000, 3000, "{\\i1}two"), (4000, 5000, "three")], None), 4: ("webvtt", [(5, 1000, "A &amp; B"), *base[1:]], "readable text, order or timing changed"),
        5: ("webvtt", base[:2], "cue count changed"), 6: ("webvtt", [], "cue count changed"), 7: ("webvtt", [base[0], (2000, 3000, "<x>two</x>"), base[2]], "markup has no certain readable text"),
        8: ("webvtt", [base[0], (2000, 3000, "<x>two</x>"), (4000, 5000, "four")], "markup has no certain readable text"), 9: ("webvtt", [base[0], base[2], base[1]], "readable text, order or timing changed"),
    }
    for f, (fmt, cues, _) in cases.items():
        source += rows(f, "srt", base)
        target += rows(f, fmt, cues)
    out = c.cue_text_check(spark.createDataFrame(source, schema), spark.createDataFrame(target, schema)).collect()
    assert {r.file_id: r.reason for r in out} == {f: reason for f, (_, _, reason) in cases.items()}
    assert {r.file_id: r.first_bad for r in out}[8] == 1


def dump(data):
    text = "\n"
    for at in range(0, len(data), 16):
        part = data[at : at + 16]
        digits = "".join(f"{b:02x}" + (" " if i % 2 else "") for i, b in enumerate(part))
        text += f"{at:08x}: {digits:<41}" + "".join(chr(b) if 32 <= b < 127 else "." for b in part) + "\n"
    return text


def record(complete, units=(b"\x40\x01\x0c", b"\x42\x01\x01\x01", b"\x44\x01\xc0")):
    data = bytes([1, 1, 0x60, 0, 0, 0, 0x90, 0, 0, 0, 0, 0, 0x1E, 0xF0, 0, 0xFC, 0xFD, 0xF8, 0xF8, 0, 0, 0x0F, len(units)])
    for kind, unit in zip((32, 33, 34), units):
        data += bytes([kind | (0x80 if complete else 0), 0, 1, 0, len(unit)]) + unit
    return data


def test_dumps_and_records(spark):
    data = bytes(i * 7 % 256 for i in range(41))
    texts = {dump(data): data, "\n00000010: 0101  ..\n": None, "\n00000000: 01zz  ..\n": None, "": None, "00000000: 0101 02\r\n": b"\x01\x01\x02", "nothing": None, dump(data)[:-30]: None}
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.b and bytes(r.b) for r in d.select("i", c.hex_dump_bytes(F.col("text")).alias("b")).collect()}
    want = {i: b for i, b in enumerate(texts.values())}
    assert {i: got[i] for i in range(6)} == {i: want[i] for i in range(6)}

    a, b = record(True), record(False)
    changed = bytearray(b)
    changed[-2] ^= 1
    kind = bytearray(b)
    kind[23] ^= 1
    many = record(True)[:22] + b"\x04" + record(True)[23:]
    pairs = [(a, b, None), (b, b, None), (b, bytes(changed), "configuration differs"), (b, bytes(kind), "configuration differs"), (a, b[:-1], "configuration differs"), (a, b + b"\0", "configuration differs"),
             (many, record(False)[:22] + b"\x04" + record(False)[23:], "configuration differs"), (a[:22], b[:21] + b"\1", "configuration differs"), (a + b"\0", b + b"\0", "configuration differs")]
    d = spark.createDataFrame([(i, "hevc", dump(x), dump(y)) for i, (x, y, _) in enumerate(pairs)] + [(90, "h264", dump(a), dump(b)), (91, "h264", dump(a), dump(a)), (92, "h264", "?", dump(a))],
                              "i int, codec string, source_dump string, output_dump string")
    got = {r.i: r.reason for r in c.codec_config_match(d).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(pairs)} | {90: "configuration differs", 91: None, 92: "unreadable configuration"}


def test_timecodes(spark):
    rows = [
        (1, "24000/1001", "41.708333", 24000, 1001, 1000, None), (2, "48000/2002", "41.75", 24000, 1001, 1000, None), (3, "24/1", "41.7", 24000, 1001, 1000, "rate differs"),
        (4, "0/0", "1", 25, 1, 25, "no valid rate"), (5, None, "1", 25, 1, 25, "no valid rate"), (6, "25/1", "N/A", 25, 1, 25, "no duration"), (7, "25/1", "1.0421", 25, 1, 25, "duration differs"),
        (8, "25/1", "1.0419", 25, 1, 25, None), (9, "4294967295/4294967294", "1", 4294967295, 4294967294, 1, None), (10, "25/1/1", "1", 25, 1, 25, "no valid rate"),
    ]
    d = spark.createDataFrame([r[:-1] for r in rows], "i int, rate string, duration string, rate_num long, rate_den long, frames long")
    assert {r.i: r.reason for r in c.timecode_check(d).collect()} == {r[0]: r[-1] for r in rows}
