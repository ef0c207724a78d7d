from __future__ import annotations

import textwrap

import duckdb

from monthpick.llm import license_scan, queries

FILES = [
    ("r/LICENSE", "Released under the MIT License."), ("r/a.txt", "code"), ("r/x/b.txt", None), ("r/x/LICENSE", "Licensed under the Apache License, Version 2.0."),
    ("r/x/y/c.txt", "text"), ("q/d.txt", "some words here\nThis work is licensed under the GNU General Public License, version 3.\nmore words and more words and more words and more words and yet more words here"), ("q/e.txt", ""), ("q/e.txt", ""),
    ("top.txt", "a " * 50_000 + "\nlicense"),
]


def test_own_and_inherited_licences(spark):
    df = spark.createDataFrame([(p, t, 1.0, "n") for p, t in FILES], "path string, text string, score double, license string")
    got = {r.path: (r.license, r.how) for r in license_scan.scan(df).collect()}
    assert got == {
        "r/LICENSE": ("MIT", "own"), "r/a.txt": ("MIT", "inherited"), "r/x/b.txt": ("Apache-2.0", "inherited"), "r/x/LICENSE": ("Apache-2.0", "own"),
        "r/x/y/c.txt": ("Apache-2.0", "inherited"), "q/d.txt": ("GPL-3.0", "own"), "q/e.txt": (None, "none"), "top.txt": (None, "none"),
    }


def test_every_template_matches_itself(spark):
    df = spark.createDataFrame([(f"{k}/x", v) for k, v in license_scan.TEMPLATES.items()], "path string, text string")
    rows = license_scan.scan(df).collect()
    assert all(r.path == f"{r.license}/x" and r.score == 1.0 for r in rows) and len(rows) == len(license_scan.TEMPLATES)


def test_empty_table(spark):
    assert license_scan.scan(spark.createDataFrame([], "path string, text string")).collect() == []


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    res = con.execute(license_scan.oracle())
    names = [d[0] for d in res.description]
    want = sorted((dict(zip(names, r)) for r in res.fetchall()), key=str)
    assert sorted((r.asDict() for r in queries.op6_license_scan(spark, sf).select(*names).collect()), key=str) == want


def _wrapped(text, sign, width=50):
    out = []
    for p in text.strip().split("\n\n"):
        out += [*textwrap.wrap(" ".join(p.split()), width), ""]
    return "\n".join(f"{sign} {x}".rstrip() for x in out[:-1])


def test_real_licence_files_and_wrapped_headers(spark):
    t = license_scan.TEXTS
    owner = "Copyright (c) 2021 Jane Doe and contributors\n\n"
    code = "\nimport os\n\n\ndef main():\n    return os.getcwd()\n" * 20
    bsd = t["BSD-3-Clause"]
    rows = [
        ("mit/LICENSE", "The MIT License (MIT)\n\n" + owner + t["MIT"].split("\n", 1)[1], "MIT"), ("bsd/LICENSE", owner + bsd[: bsd.index("THIS SOFTWARE")], "BSD-3-Clause"),
        ("bsd2/LICENSE", owner + t["BSD-2-Clause"], "BSD-2-Clause"), ("gpl/COPYING", t["GPL-3.0"], "GPL-3.0"), ("gpl2/COPYING", t["GPL-2.0"], "GPL-2.0"), ("apache/LICENSE", t["Apache-2.0"], "Apache-2.0"),
        ("h/a.py", "# Copyright 2020 Jane Doe\n#\n" + _wrapped(t["Apache-2.0.notice"], "#") + code, "Apache-2.0"), ("h/b.c", "/*\n * Copyright (C) 2019 Jane Doe\n *\n" + _wrapped("\n\n".join(t["GPL-3.0.notice"].split("\n\n")[:2]), " *") + "\n */\n" + code, "GPL-3.0"),
        ("h/c.js", _wrapped(t["MPL-2.0.notice"], "//", 40) + code, "MPL-2.0"), ("h/d.py", code, None),
    ]
    files = [(p, x) for p, x, _ in rows] + [(f"{d}/src/x.py", code) for d in ("mit", "bsd", "gpl", "apache")]
    got = {r.path: (r.license, r.how) for r in license_scan.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert {p: got[p] for p, _, _ in rows} == {p: (k, "own" if k else "none") for p, _, k in rows}
    assert {d: got[f"{d}/src/x.py"] for d in ("mit", "bsd", "gpl", "apache")} == {"mit": ("MIT", "inherited"), "bsd": ("BSD-3-Clause", "inherited"), "gpl": ("GPL-3.0", "inherited"), "apache": ("Apache-2.0", "inherited")}


def test_query_with_null_ids_and_paths(spark, tmp_path):
    rows = [(None, "Released under the MIT License.", "en", "a"), (None, "plain", "en", "a"), (None, None, None, None), (-7, "Released under the MIT License.", "de", "a"), (8, "plain", "de", "a"), (9, "plain", "en", "")]
    spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id bigint, text string, lang string, source string, score double, path string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((r.doc_id, r.license, r.how) for r in queries.op6_license_scan(spark, str(tmp_path)).collect()), key=str)
    want = [(None, "MIT", "own"), (None, "MIT", "inherited"), (None, None, "none"), (-7, "MIT", "own"), (8, "MIT", "inherited"), (9, None, "none")]
    assert got == sorted(want, key=str)


def test_main_path_runs_without_python_workers(spark, sf):
    from monthpick.llm.common import table

    df = license_scan.scan(table(spark, sf, "documents").select("source", "text").withColumnRenamed("source", "path"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
