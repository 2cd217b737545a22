from cartlens.llm import licenses


def test_own_and_inherited(spark):
    mit, apache, nc = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0."
    rows = [(1, "a/LICENSE", f"text\n{mit}\n"), (2, "a/x.py", "code"), (3, "a/b/c/y.py", f"{apache} extra"), (4, "a/b/c/z.py", None), (5, "a/b/COPYING.txt", nc),
            (6, "other/z.py", "All our licence are belong to nobody in particular here"), (7, "LICENSE", "no notice"), (8, None, mit), (9, None, None),
            (10, "/a/deep/er/f", ""), (10, "/a/deep/er/f", ""), (11, "top", "w " * 40000 + "\n" + apache.upper()), (12, "a/b/LICENSE", nc), (13, "a/b/licence.md", "x")]
    df = spark.createDataFrame([(*r, "old") for r in rows], "id long, path string, text string, Licence string")
    got = licenses.scan(df)
    assert got.columns == ["id", "path", "licence", "cosine", "licence_from"] and got.count() == len(rows)
    by = {r.id: (r.licence, r.licence_from) for r in got.collect()}
    assert by[1] == ("MIT", "own") and by[2] == ("MIT", "a") and by[3] == ("Apache-2.0", "own") and by[4] == ("CC-BY-NC-4.0", "a/b")
    assert by[5] == ("CC-BY-NC-4.0", "own") and by[6] == by[7] == by[9] == (None, None) and by[8] == ("MIT", "own")
    assert by[10] == ("MIT", "a") and by[11] == ("Apache-2.0", "own") and by[13] == ("CC-BY-NC-4.0", "a/b")


def test_root_licence_and_ties(spark):
    rows = [(1, "LICENSE", "Released under the MIT License."), (2, "d/e.txt", "t"), (3, "COPYING", "Licensed under CC BY-NC 4.0.")]
    by = {r.id: (r.licence, r.licence_from) for r in licenses.scan(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    assert by[2][1] == "" and by[2][0] in ("MIT", "CC-BY-NC-4.0")
    assert licenses.scan(spark.createDataFrame([], "id long, path string, text string")).count() == 0


def test_every_template_finds_itself(spark):
    rows = [(i, str(i), t) for i, (_, t) in enumerate(licenses.TEMPLATES)]
    got = {r.id: (r.licence, r.cosine) for r in licenses.scan(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    cued = [i for i, (_, t) in enumerate(licenses.TEMPLATES) if licenses.CUE.search(t)]
    assert all(got[i][0] == licenses.TEMPLATES[i][0] and got[i][1] > 0.999 for i in cued) and len(cued) == len(rows)


def test_query(spark):
    got = licenses.op7_licences(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 1000 and {"MIT", "GPL-3.0"} <= {r.licence for r in got}


def found(spark, texts, fill=0):
    rows = [(i, f"d{i}/x.py", t) for i, t in enumerate(texts)] + [(-1, "f/y.py", f"a line {k} with a licence word and no notice") for k in range(fill)]
    return [r.licence for r in licenses.scan(spark.createDataFrame(rows, "id long, path string, text string")).filter("id >= 0").orderBy("id").collect()]


def test_notices_in_small_and_large_tables(spark):
    """A notice among other words, within a long line or over two lines is found whatever else the table holds."""
    texts = ["The code is licensed under the Apache License, Version 2.0.", "This file is licensed under the GNU General Public License, version 3",
             "Released under the MIT License by Acme.", "w " * 5000 + "it is licensed under CC BY-SA 4.0 as " + "x " * 5000,
             "# This work is licensed under the\n# GNU Lesser General Public License, v2.1 only", "you need a driving license to drive", "copyright 2020, all rights reserved"]
    want = ["Apache-2.0", "GPL-3.0", "MIT", "CC-BY-SA-4.0", "LGPL-2.1", None, None]
    assert found(spark, texts) == found(spark, texts, 20000) == want


def test_identifiers_versions_and_whole_licences(spark):
    head, end = "Copyright (c) 2020 Acme\n\n" + licenses.BSD_HEAD, licenses.BSD_END
    texts = ["// SPDX-License-Identifier: MIT", "# SPDX-License-Identifier: Apache-2.0", "/* SPDX-License-Identifier: GPL-3.0-or-later */",
             "GNU GENERAL PUBLIC LICENSE", "   GNU GENERAL PUBLIC LICENSE\n      Version 2, June 1991\n\n Copyright (C) 1989", "   GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n",
             "Redistribution and use in source and binary forms, with or without", head + end, head + licenses.BSD_THIRD + end, "MIT License\n\n" + licenses.MIT_TEXT,
             "published under the GNU General Public License v2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE\n Version 2, June 1991"]
    assert found(spark, texts) == ["MIT", "Apache-2.0", "GPL-3.0", None, "GPL-2.0", "GPL-3.0", None, "BSD-2-Clause", "BSD-3-Clause", "MIT", "GPL-2.0", "LGPL-2.0"]
