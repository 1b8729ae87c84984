import random
import textwrap
import time

import duckdb
from corpusmill.llm.license_scan import LICENSES, digest, license_sql, scan_licenses
from pyspark.sql import functions as F


def test_variants_of_known_texts(spark):
    mit = next(t for k, t in LICENSES if k == "MIT")
    bsd = next(t for k, t in LICENSES if k == "BSD-3-Clause")
    rows = [
        (1, mit), (2, mit.upper().replace("\n", "  \r\n")), (3, mit.replace("2024 Someone", "1999-2003 A. Person <a@b.c>").replace('"', "”")), (4, "x " + mit),
        (5, bsd.replace(" ", "\t")), (6, None), (7, ""), (8, " .,; "), (9, "released under the MIT licence"), (10, "Released under the MIT License. More"), (None, mit), (1, mit), (11, "y " * 200_000),
        (12, "# Copyright 2020 X\n# (c) Y\n" + mit),
    ]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, license_id string").repartition(3)
    got = [(r["doc_id"], r["license_id"], r["digest"] is None) for r in scan_licenses(docs).collect()]
    known = {1: "MIT", 2: "MIT", 3: "MIT", 5: "BSD-3-Clause", 9: "MIT-notice", None: "MIT", 12: "MIT"}
    assert sorted(got, key=str) == sorted([(k, known.get(k), t is None) for k, t in rows], key=str)


def test_given_licenses_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "My Own licence!"), (2, "other")], "doc_id long, text string")
    own = spark.createDataFrame([("my own LICENSE",)], "t string").select(digest(F.col("t")).alias("license_digest"), F.lit("own").alias("license_id"))
    assert {r["doc_id"]: r["license_id"] for r in scan_licenses(docs, own).collect()} == {1: "own", 2: None}
    assert scan_licenses(docs.limit(0)).collect() == []
    assert [r["license_id"] for r in scan_licenses(docs, own.limit(0)).collect()] == [None, None]


def test_licenses_at_other_widths(spark):
    rows = []
    for name, text in LICENSES:
        for holder in ("2024 Someone", "2011-2024 The Regents of X, Inc. <a@b.c>\nCopyright 2009 A. Person. All rights reserved."):
            own = text.replace("2024, Someone", "2024 Someone").replace("2024 Someone", holder)
            for width in (25, 40, 60, 72, 79, 100, 10**6):
                rows.append((len(rows), name, "\n\n".join(textwrap.fill(x, width, break_long_words=False) for x in own.split("\n\n"))))
                rows.append((len(rows), name, textwrap.fill(own, width, break_long_words=False)))
                rows.append((len(rows), name, textwrap.indent(rows[-1][2], "# ", lambda _: True)))
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, name string, text string"))
    found = {r["doc_id"]: r["license_id"] for r in got.collect()}
    assert [(name, text) for key, name, text in rows if found[key] != name] == []


def test_only_notices_are_left_out(spark):
    mit = next(t for k, t in LICENSES if k == "MIT")
    body = mit[mit.index("Permission") :]
    rows = [
        ("Copyright The Authors\n\n" + body, "MIT"), ("Copyright (c) <year> <copyright holders>\n\n" + body, "MIT"), ("© 2020 X\n(c) 2021 Y\n" + body, "MIT"),
        (body.replace("OR COPYRIGHT HOLDERS", "OR").replace("OR\nCOPYRIGHT HOLDERS", "OR"), None),  # words of the licence are missing
        ("Copyright (c) 2024 X\nYou must not use this.\n" + body, None), ("Copyright (c) 2024 X\n\nNo rights.\n\n" + body, None), ("(c) You must pay.\n\n" + body, None),
        ("Copyright 2024 X, " + "other words " * 60 + body, None), ("Copyright 2024 X " + "y " * 200_000, None), ("copyright (c) " * 20_000, None),
    ]
    got = scan_licenses(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string"))
    assert {r["doc_id"]: r["license_id"] for r in got.collect()} == {i: k for i, (_, k) in enumerate(rows)}


def test_time_grows_with_the_length(spark):
    mit = next(t for k, t in LICENSES if k == "MIT")
    rows = [mit + "\n" * 1_000_000, "copyright" + "\n" * 1_000_000, "\n" * 500_000 + "(c) " * 50_000, "copyright " * 100_000, " # " * 300_000 + mit, "copyright " + "x" * 1_000_000]
    spark.createDataFrame([(0, "warm up")], "doc_id long, text string").transform(scan_licenses).collect()
    start = time.monotonic()
    got = scan_licenses(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert {r["doc_id"]: r["license_id"] for r in got.collect()} == {0: "MIT", 1: None, 2: None, 3: None, 4: "MIT", 5: None}
    assert time.monotonic() - start < 10


def test_equal_to_the_sql_twin(spark, tmp_path):
    rng = random.Random(6)
    parts = ["Copyright", "(c)", "©", "2024", "Someone", "\n", "\n\n", "# ", " ", "must", "is", "all rights reserved", "Licence", "sub-license", "https://x", "permission is hereby granted", "released under", "é", "Ö", "\x01", "-", "organism", "  \n  "]
    texts = [t for _, t in LICENSES] + ["x " + t for _, t in LICENSES[:5]] + ["".join(rng.choices([*parts, " "], k=rng.randrange(60))) for _ in range(600)] + [None, "", " . "]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {k: v for k, *v in db.execute(license_sql()).fetchall()}
    got = {k: v for k, *v in scan_licenses(table).collect()}
    assert {k: (texts[k], got[k], want[k]) for k in got if got[k] != want[k]} == {}
