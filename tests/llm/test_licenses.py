"""License scan: against its SQL, against a plain version, and defined edges."""

import re

import duckdb

from tallyspark.llm import licenses, queries


def run_sql(sql, data_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{data_dir}/documents.parquet')")
    return con.execute(sql).fetchall()


def test_query_equals_its_sql(spark):
    d = "/root/testdata/sf0.001"
    got = queries.op3_license_scan(spark, d).select("doc_id", "path", "license", "cosine", "origin", "licence_path").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, run_sql(licenses.oracle_sql(), d)))
    assert {r["origin"] for r in got} >= {"own", "none"}


def test_every_declared_license_is_named(spark, data_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    said = (("Licensed under CC BY-NC", "CC-BY-NC-4.0"), ("GNU General Public License, version 3", "GPL-3.0"), ("Licensed under the Apache License", "Apache-2.0"), ("Released under the MIT License", "MIT"))
    for r in queries.op3_license_scan(spark, data_dir).collect():
        named = {name for words, name in said if words in docs[r["doc_id"]]}
        assert (r["license"] in named) if named else r["origin"] != "own"


FILES = [
    ("LICENSE", "Released under the MIT License."),
    ("a/b/c.py", "print(1)"),
    ("a/COPYING", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation. More text."),
    ("a/b/d.py", "# Licensed under the Apache License, Version 2.0\nprint(2)"),
    ("ab/e.py", None),
    ("a/b/licenses.txt", "Licensed under CC BY-NC 4.0."),
    ("z/LICENSE.md", "nothing is declared here"),
    ("z/y/x", ""),
    (None, "under the license of the version"),
    ("a/b/c.py", "print(1)"),
]


def test_nearest_ancestor_and_edges(spark):
    df = spark.createDataFrame([(*f, "q", 1) for f in FILES], "path string, text string, license string, n int")
    got = licenses.scan_licenses(df).collect()
    assert len(got) == len(FILES)
    by = {r["path"]: (r["license"], r["origin"], r["licence_path"]) for r in got}
    assert by["LICENSE"] == ("MIT", "own", None)
    assert by["a/COPYING"][:2] == ("GPL-3.0", "own")
    assert by["a/b/c.py"] == ("GPL-3.0", "inherited", "a/COPYING")
    assert by["a/b/d.py"][:2] == ("Apache-2.0", "own")
    assert by["ab/e.py"] == ("MIT", "inherited", "LICENSE")  # ab is not below a
    assert by["a/b/licenses.txt"][:2] == ("CC-BY-NC-4.0", "own")
    assert by["z/y/x"] == ("MIT", "inherited", "LICENSE")
    assert by[None] == ("MIT", "inherited", "LICENSE")
    assert licenses.scan_licenses(df.limit(0)).count() == 0
    assert all(r["n"] == 1 for r in got)


def test_light_terms_cannot_reach_the_least_cosine():
    listed = [{"template": 0, "term": t, "tf": 1} for t in ("the", "of", "gnu", "license")]
    weights = {"the": 100, "of": 200, "gnu": 5000, "license": 3000}
    assert licenses.weighty_terms(listed, weights, 0.5) == ["license", "gnu"]


def test_no_python_in_the_plan(spark, data_dir):
    plan = queries.op3_license_scan(spark, data_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
