"""Golden rows derived by reading the reference (FIXTURES §4) and property checks."""

import json

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cairn.functions import text as T


def one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"v {typ}").select(expr(F.col("v")).alias("r")).first()["r"]


def many(spark, expr, values, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r["r"] for r in df.select("i", expr(F.col("v")).alias("r")).orderBy("i").collect()]


def test_size_labels(spark):
    got = many(spark, T.size_label, [0, 1023, 1024, 1152, 1048575, 2 ** 50], "bigint")
    assert got == ["0.00 B", "1023.00 B", "1.00 KB", "1.12 KB", "1024.00 KB", "1024.00 TB"]


def test_size_labels_golden(spark):
    """Worked out by hand: bytes over the largest unit power not above them, to two decimals."""
    golden = {1: "1.00 B", 1000: "1000.00 B", 1025: "1.00 KB", 1535: "1.50 KB", 1536: "1.50 KB", 2560: "2.50 KB",
              10_240: "10.00 KB", 1_048_576: "1.00 MB", 1_572_864: "1.50 MB", 1_610_612_736: "1.50 GB",
              2 ** 40: "1.00 TB", 2 ** 41 + 2 ** 39: "2.50 TB", 3 * 2 ** 50: "3072.00 TB"}
    assert many(spark, T.size_label, list(golden), "bigint") == list(golden.values())


def test_elapsed_text(spark):
    got = many(spark, T.elapsed_text, [0.0, 5.25, 3661.5, 86400.0, 172800.04, 86399.9999999], "double")
    assert got == ["0:00:00", "0:00:05.250000", "1:01:01.500000", "1 day, 0:00:00",
                   "2 days, 0:00:00.040000", "1 day, 0:00:00"]


def test_video_ids_and_test(spark):
    urls = ["https://www.youtube.com/watch?v=dQw4w9WgXcQ&t=1", "https://youtu.be/dQw4w9WgXcQ",
            "https://www.youtube.com/channel/UC1234567890abcdefghijkl", "https://youtu.be/x"]
    assert many(spark, T.video_id, urls) == ["dQw4w9WgXcQ", "dQw4w9WgXcQ", "UC123456789", None]
    tests = ["notyoutube.com/", "https://a.b/?u=youtu.be/", "https://example.com/"]
    assert many(spark, T.is_video_url, tests) == [True, True, False]


def test_content_types(spark):
    got = many(spark, T.content_type_extension,
               ["text/html; charset=utf-8", "text/plain", "application/pdf", "image/png", "", "text/htmlx"])
    assert got == [".html", ".txt", ".pdf", None, None, ".html"]


def test_extension_rules(spark):
    paths = ["a.py", "a.PY", "a.tar.gz", ".py", "a.lua", "dir/x.tex", "a."]
    assert many(spark, T.path_suffix, paths) == [".py", ".PY", ".gz", "", ".lua", ".tex", ""]


def test_directory_rules(spark):
    paths = ["x/.git/a.py", "x/.gitx/a.py", "x\\node_modules\\a.py", "/a/site-packages", "b/.mypy_cache/"]
    assert many(spark, T.in_blacklisted_directory, paths) == [True, False, True, True, True]


def test_exit_words(spark):
    assert many(spark, T.is_exit_word, ["EXIT", "Quit", ":q", " exit", "exits"]) == [True, True, True, False, False]


def test_encoding(spark):
    rows = [(0, bytearray(b"plain ascii")), (1, bytearray("héllo".encode())), (2, bytearray(b"\xff\xfeab")),
            (3, bytearray(b"a" * 4095 + "é".encode())), (4, bytearray(b""))]
    df = spark.createDataFrame(rows, "i int, b binary")
    got = [r["e"] for r in df.select("i", T.detect_encoding(F.col("b")).alias("e")).orderBy("i").collect()]
    assert got == ["ASCII", "UTF-8", None, "UTF-8", None]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=8))
def test_payload_length_matches_json_dumps(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["n"] for r in df.select("i", T.payload_length(F.lit("/p/ä.py"), F.col("t")).alias("n"))
           .orderBy("i").collect()]
    assert got == [len(json.dumps({"path": "/p/ä.py", "content": t})) for t in texts]
