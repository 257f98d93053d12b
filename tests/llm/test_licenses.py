"""Licence digests against the same rule in DuckDB, and defined cases."""

import duckdb

from aspectra.llm import licenses

APACHE = "Licensed under the Apache License, Version 2.0."
VARIANTS = [
    (1, licenses._MIT, "MIT"), (2, "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + licenses._MIT.upper(), "MIT"),
    (3, licenses._MIT.replace("sublicense", "sub-license").replace("\n", " "), "MIT"),
    (4, licenses._MIT + " And more.", None), (5, licenses._ISC.replace("software", "SOFTWARE,"), "ISC"),
    (6, "Copyright 2019-2021 A\n(c) B\n" + dict(licenses.KNOWN)["BSD-3-Clause"], "BSD-3-Clause"),
    (7, APACHE.replace("License", "Licence"), "Apache-2.0"), (8, None, None), (9, "", None), (10, "... \n --", None),
    (11, "Copyright 2020 A", None), (12, "é " * 50_000, None), (13, f"Text.\n  {APACHE.upper()}\n# {APACHE}\nmore", None),
]


def test_cases(spark):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t, _ in VARIANTS], "doc_id long, text string, license_id string, digest int")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert {d: got[d].license for d, _, _ in VARIANTS} == {d: k for d, _, k in VARIANTS}
    assert (got[13].n_license_lines, got[13].line_licenses) == (2, "Apache-2.0") and got[7].n_license_lines == 1
    assert got[8].n_license_lines == 0 and got[8].line_licenses == ""


def test_repeated_rows_missing_ids_and_empty_tables(spark):
    rows = [(1, APACHE), (1, APACHE), (None, APACHE), (1, "other")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.license or "", r.n_license_lines) for r in got) == [
        (0, "Apache-2.0", 1), (1, "", 0), (1, "Apache-2.0", 1), (1, "Apache-2.0", 1)]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_list_of_known_texts_too_long_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(licenses, "BROADCAST_KNOWN", 0)
    df = spark.createDataFrame([(1, "My own, terms"), (2, "x")], "doc_id long, text string")
    got = licenses.scan(df, [("own", "my OWN terms"), ("an-own", "my own terms!"), ("none", "?!")]).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(1, "an-own"), (2, None)]


def test_oracle(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    key = lambda r: (r[0], r[1] or "", r[2], r[3])
    want = sorted(con.execute(licenses.ORACLE_SQL).fetchall(), key=key)
    got = sorted(map(tuple, licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()), key=key)
    assert got == want and sum(r[2] for r in got) > 0


def test_whole_licences_headers_and_identifiers(spark):
    from pathlib import Path

    texts = {p.stem: p.read_text() for p in (Path(licenses.__file__).parent / "licence_texts").glob("*.txt")}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= set(texts)
    rows, want = [], {}
    for k, (name, text) in enumerate(sorted(texts.items())):
        shapes = [text, text.upper(), "Copyright (c) 2024 Someone\nAll rights reserved.\n\n" + text,
                  "\n".join(f" * {ln}" for ln in text.splitlines()), text.replace("license", "licence").replace("License", "Licence")]
        terms = text.partition("END OF TERMS AND CONDITIONS")[0]
        for j, shape in enumerate([*shapes, terms]):
            rows.append((100 * k + j, shape))
            want[100 * k + j] = name
        rows += [(100 * k + 50, text + "\nOne more condition."), (100 * k + 51, text.replace("the", "teh", 1))]
        want |= {100 * k + 50: None, 100 * k + 51: None}
    rows += [(9000, licenses._UNLICENSE), (9001, licenses._BOOST.replace("license", "licence")),
             (9002, "# SPDX-License-Identifier: MPL-2.0"), (9003, "licence licence licence")]
    want |= {9000: "Unlicense", 9001: "BSL-1.0", 9002: "MPL-2.0", 9003: None}
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_neighbouring_spellings(spark):
    df = spark.createDataFrame([("licence licence, LICENCE sub-licence",)], "t string")
    assert df.select(licenses.canonical(df["t"])).first()[0] == "license license license sublicense"


def test_notices_of_the_oracle_and_the_library_agree(spark):
    texts = ["licence licence x", "All rights reserved. A\nb", "a\n(c) x\n© y\nall rights reserved\nz", "sub licence sub license", "*/ copyright 2020 q\nk", ""]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (x VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", [(x,) for x in texts])
    want = [r[0] for r in con.execute(f"SELECT {licenses._canonical_sql('x')} FROM t").fetchall()]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    assert [r[0] for r in df.select(licenses.canonical(df["x"])).collect()] == want
