"""Staged lines in file order, drifted headers, short rows."""

import csv

from pyspark.sql import functions as F

from lotlight.sources import staging


def test_fields_equal_a_csv_reader(spark):
    lines = ["a;b;c", ";;", "", '"x;y";"say ""hi""";z', '"";b', "a;", ';"q"', "é;1,5;\t"]
    got = spark.createDataFrame([(t,) for t in lines], "t string").select("t", staging.fields(F.col("t")).alias("f")).collect()
    for r in got:
        assert r["f"] == (next(csv.reader([r["t"]], delimiter=";")) if r["t"] else [""])
    odd = spark.createDataFrame([(1, '"a"b;c'), (2, '"a;b'), (3, '"'), (4, None)], "i int, t string").select("i", staging.fields(F.col("t")).alias("f"))
    assert {r["i"]: r["f"] for r in odd.collect()} == {1: ["a", "c"], 2: ['"a', "b"], 3: ['"'], 4: None}


def test_lines_keep_their_order_over_many_parts(spark, tmp_path):
    for name, n in (("a", 30000), ("b", 10)):
        (tmp_path / f"{name}.csv").write_text("lot_id;product_name;okpd2_code\n" + "".join(f"{i};name {i};c\n" for i in range(2, n + 1)), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        lines = staging.staged(spark, str(tmp_path))
        got = staging.delivered(lines, "items", [])
        assert got.count() == 30000 + 10 - 2
        assert got.filter("cast(line_no as string) <> lot_id or warning is not null").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_drifted_headers_short_rows_and_empty_files(spark, tmp_path):
    (tmp_path / "good.csv").write_bytes("﻿okpd2_code;lot_id;product_name\r\n01;1;\"a;b\"\r\n\r\n02;2\r\n03;3; c \r\n".encode())
    (tmp_path / "bad.csv").write_text("lot_id;Unnamed;okpd2_code\n7;x;y\n8;x;y;z\n", encoding="utf-8")
    (tmp_path / "part.csv").write_text("lot_id\n9\n", encoding="utf-8")
    (tmp_path / "empty.csv").write_text("", encoding="utf-8")
    rows = staging.delivered(staging.staged(spark, str(tmp_path)), "items", ["Unnamed"]).withColumn("file", F.substring_index("file", "/", -1))
    got = sorted(((r["file"], r["line_no"], r["lot_id"], r["product_name"], r["okpd2_code"], r["warning"]) for r in rows.collect()), key=lambda r: r[:2])
    assert got == [
        ("bad.csv", 2, "7", "x", "y", None),
        ("bad.csv", 3, None, None, None, "4 fields, expected 3; row skipped"),
        ("good.csv", 2, "1", "a;b", "01", None),
        ("good.csv", 4, None, None, None, "2 fields, expected 3; row skipped"),
        ("good.csv", 5, "3", "c", "03", None),
        ("part.csv", 2, "9", None, None, None),
    ]
