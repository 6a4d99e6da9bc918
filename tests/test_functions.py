"""Literal cases of the scalar functions and binary forms."""

import random

import pytest
from pyspark.sql import functions as F

from siltbed.functions import binary, filetypes, media, text


def one(spark, *values, schema, column):
    return [r[0] for r in spark.createDataFrame(list(values), schema).select(column).collect()]


EDGES = [0, 1, 127, 128, 255, 1000, 16383, 16384, 100000, 1000000, 2097151, 2097152, 268435455, 2**28, 2**30, 2**35, 2**40, 2**42, 2**49, 2**50, 2**56, 2**60, 2**63, 2**64 - 1]


@pytest.mark.parametrize("value", EDGES)
def test_varint_round_trip_with_bytes_behind(value):
    raw = binary.encode_varint(value)
    assert binary.decode_varint(raw + b"\xff\x00\x7f") == (value, len(raw))


def test_varint_lengths(spark):
    want = {0: 1, 127: 1, 128: 2, 16383: 2, 16384: 3, 2097151: 3, 2097152: 4, 268435455: 4, 2**56: 9}
    assert {v: len(binary.encode_varint(v)) for v in want} == want
    assert one(spark, *[(v,) for v in want], schema="v long", column=text.varint_length(F.col("v"))) == list(want.values())
    assert len(binary.encode_varint(2**64 - 1)) == 9


def test_varints_in_a_row():
    values = [random.Random(1).getrandbits(k) for k in range(1, 64)]
    data, at = b"".join(map(binary.encode_varint, values)), 0
    for v in values:
        got, at = binary.decode_varint(data, at)
        assert got == v
    assert at == len(data)


def test_blocks_and_footer():
    block = binary.write_block(2, "lzma:64mb", 1000, 300, 0xDEADBEEF)
    assert binary.read_block(b"xx" + block, 2) == ({"kind": 2, "compressor": "lzma:64mb", "original": 1000, "compressed": 300, "crc": 0xDEADBEEF}, 2 + len(block))
    with pytest.raises(ValueError):
        binary.read_block(block[:-1] + bytes([block[-1] ^ 1]))
    footer = binary.write_footer([(block, 17), (block, 400)], True, "a comment", "1%")
    read = binary.read_footer(footer)
    assert [b["distance"] for b in read["blocks"]] == [17, 400] and read["locked"] and (read["comment"], read["recovery"]) == ("a comment", "1%")
    assert binary.read_footer(binary.write_footer([], False, "", ""))["blocks"] == []
    assert binary.find_signatures(b"\0" * 10 + block + block) == [10, 10 + len(block)]


def test_size_texts(spark):
    cases = [(0,), (512,), (1536,), (5 << 20,), (3 << 30,), (2 << 40,)]
    got = {s: one(spark, *cases, schema="n long", column=text.format_size(F.col("n"), s)) for s in ("archive", "queue", "thumbnail", "long", "mb")}
    assert got["archive"] == ["0 B", "512 B", "1.5 KB", "5 MB", "3 GB", "2 TB"]
    assert got["queue"] == ["0 B", "512 B", "1.5 KB", "5.0 MB", "3.0 GB", "2048.0 GB"]
    assert got["thumbnail"] == ["0 B", "512 B", "1.5 KB", "5.0 MB", "3072.0 MB", "2097152.0 MB"]
    assert got["long"] == ["0 bytes", "512.0 bytes", "1.5 KB", "5.0 MB", "3.0 GB", "2.0 TB"]
    assert got["mb"][3] == "5 MB"


def test_parse_size(spark):
    cases = {"1gb": 1 << 30, "64MB": 64 << 20, "8kb": 8 << 10, "10b": 10, "7": 7, "x": None}
    assert one(spark, *[(c,) for c in cases], schema="s string", column=text.parse_size(F.col("s"))) == list(cases.values())


def test_codec_chain(spark):
    chain = text.parse_chain(F.col("s"))
    got = one(spark, ("LZMA:d32m+AES-256:n1",), ("",), ("a++b",), schema="s string", column=chain)
    assert [[(c.name, c.params) for c in x] for x in got] == [[("lzma", ["d32m"]), ("aes-256", ["n1"])], [], [("a", []), ("b", [])]]
    value = text.param_value(F.transform(chain, lambda c: c["params"])[0], "d")
    assert one(spark, ("LZMA:x1:d32m",), schema="s string", column=value) == ["32m"]


def test_video_rules(spark):
    cases = [("h264", 20000.0, 1920, 1080, 200000000), ("h264", 3000.0, 1920, 1080, 30000000), ("hevc", 5000.0, 1920, 1080, 50000000), ("h264", 9000.0, 320, 240, 1000), ("h264", 0.0, 0, 0, 1), ("hevc", 9000.0, 3840, 2160, 1000), ("h264", 9000.0, 3840, 2160, 1000)]
    rule = media.assess(*(F.col(c) for c in ("c", "k", "w", "h", "s")))
    got = one(spark, *cases, schema="c string, k double, w int, h int, s long", column=rule)
    assert got == ["very_high_bitrate", "moderate", "moderate", "high_bpp", "large_file", "hevc", "reasonable"]


def test_thumbnails(spark):
    cases = [(200, 100), (100, 200), (200, 200), (50, 50), (10000, 1)]
    sides = F.array(*(media.thumb_side(F.col(s), F.col("w"), F.col("h"), 100, 100) for s in "wh"))
    assert one(spark, *cases, schema="w int, h int", column=sides) == [[100, 50], [50, 100], [100, 100], [50, 50], [100, 1]]


def test_types(spark):
    cases = [(bytes.fromhex("FFD8FFE000104A4649460001"), "x.png"), (bytes.fromhex("FFD8FFE00010"), "k/short.jpg"), (b"", "k/r.cr2"), (b"", "none"), (None, "a.webm")]
    assert one(spark, *cases, schema="b binary, p string", column=filetypes.file_type(F.col("b"), F.col("p"))) == ["jpg", "jpg", "raw", "other", "webm"]


def test_fnv_and_badge(spark):
    assert one(spark, ("",), ("a",), ("foobar",), schema="s string", column=text.fnv1a32(F.col("s"))) == [2166136261, 3826002220, _fnv("foobar")]
    assert one(spark, (" .jpeg ",), ("",), ("..verylong",), schema="s string", column=text.ext_badge(F.col("s"))) == ["JPEG", "FILE", "VERYLO"]


def _fnv(s):
    h = 2166136261
    for c in s:
        h = (h ^ ord(c)) * 16777619 % 2**32
    return h


def test_lowest_of_large_numbers(spark):
    cases = [(3 * 2**60, 2**61 + 2**60), (2**62 + 1, -1), (-(2**53) - 1, 1), (6, 4), (0, 0), (-5, 0), (0, 7), (None, 4)]
    want = [(1, 1), (-(2**62) - 1, 1), (-(2**53) - 1, 1), (3, 2), (0, 0), (-1, 0), (0, 1), (None, 4)]
    got = one(spark, *cases, schema="n long, d long", column=media.lowest(F.col("n"), F.col("d")))
    assert [tuple(r) for r in got] == want


def test_metadata_of_any_length(spark):
    many = 2000
    deep = "\\" * 300 + "\n=" + "x;" * many
    raw = text.write_metadata({"deep": F.col("s"), "plain": F.lit("y")})
    assert one(spark, (deep,), schema="s string", column=text.read_metadata(raw)) == [{"deep": deep, "plain": "y"}]
    again = "a=1\na=2\n;c=3\n[d]=4\na=1\nk\\=e=v\\|w\n"
    assert one(spark, (again,), (None,), schema="s string", column=text.read_metadata(F.col("s"))) == [{"a": "1", "k=e": "v|w"}, None]
    lines = "".join(f"k{i % 700}={i}\n" for i in range(many))
    assert one(spark, (lines,), schema="s string", column=text.read_metadata(F.col("s"))) == [{f"k{i % 700}": str(i) for i in range(many)}]


def test_varint_columns(spark):
    values = [v for v in EDGES if v < 1 << 63]
    values += [(1 << 7 * k) - 1 for k in range(1, 9)] + [random.Random(2).getrandbits(k) for k in range(1, 64)]
    rows = [(v, binary.encode_varint(v) + end) for v in values for end in (b"", b"\xff\x00\x7f", b"\xff" * 20)]
    got = spark.createDataFrame(rows, "v long, b binary").select(binary.varint_bytes(F.col("v")), binary.varint_value(F.col("b"))).collect()
    assert [(bytes(r[0]), r[1]) for r in got] == [(binary.encode_varint(v), v) for v, _ in rows]
    short = [(binary.encode_varint(v)[:-1],) for v in values] + [(None,)]
    assert set(one(spark, *short, schema="b binary", column=binary.varint_value(F.col("b")))) == {None}


def test_varints_are_read_in_few_conversions(spark):
    """Not one for each length."""
    read = spark.range(9).select(F.hex("id").cast("binary").alias("b")).select(binary.varint_value(F.col("b")))
    code = read._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    assert 1 <= code.count("NumberConverter.convert") <= 3
