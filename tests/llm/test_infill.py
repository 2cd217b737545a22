import hashlib
import re

import pytest
from pyspark.sql import functions as F

from cartlens.llm import infill

SCHEMA = "doc_id long, text string"


def brute(k, text, unit=infill.LINES, rate=100, share=50, seed=7):
    text = text or ""
    u = [m[0] for m in re.finditer(unit, text)]
    digest = hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in infill.SENTINELS) or h[2] % 100 >= rate:
        return len(u), "plain", None, None, text
    spm = h[3] % 100 < share
    return len(u), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["", None, "\n", "\n\n\n", "one", "one\n", "a\nb\nc", "a\r\nb\rc\n\nd", "<P>", "x <S> y\nz", "<M", "<P\n>\n<", "ends <\nS>\n<", "$1 \\2 $\n{3}\n\\E \\Q\n", "ä😀\n日本\n\U0001F600\U0001F600\n",
         "\t \n \n", "same\nsame\n", "same\nsame\n", "x" * 300_000, "y\n" * 200_000, ("long line " * 2000 + "\n") * 50, "\u2028\u0085\n\x0b\x0c"]


def test_equals_brute_force(spark):
    rows = [(i, t) for j in range(6) for i, t in enumerate(TEXTS, 100 * j)] + [(None, "no\nid\n"), (-5, "minus\nfive")]
    d = infill.fill_in_middle(spark.createDataFrame(rows, SCHEMA)).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    got = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in d.collect()), key=str)
    assert got == sorted(((k, t, *brute(k, t)) for k, t in rows), key=str)
    assert d.filter("back <> coalesce(text, '') OR back IS NULL").count() == 0
    forms = {r[3] for r in got}
    assert forms == {"plain", "psm", "spm"}


@pytest.mark.parametrize("rate, share", [(0, 50), (40, 0), (100, 100)])
def test_shares_and_other_units(spark, rate, share):
    rows = [(i, f"w{i} ä😀 {'x' * (i % 7)}") for i in range(300)]
    d = infill.fill_in_middle(spark.createDataFrame(rows, SCHEMA), seed=3, rate=rate, spm_share=share, unit=infill.CHARACTERS)
    want = [(k, *brute(k, t, r"[\s\S]", rate, share, 3)) for k, t in rows]
    assert sorted((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in d.collect()) == sorted(want)


def test_clashing_columns_and_empty_table(spark):
    d = spark.createDataFrame([(1, "a\nb", 5, "f", "o")], SCHEMA + ", N int, form string, __text string")
    out = infill.fill_in_middle(d)
    assert out.columns == ["doc_id", "text", "__text", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert [(r.n, r.output) for r in out.collect()] == [brute(1, "a\nb")[::4]]
    assert infill.fill_in_middle(d.limit(0)).count() == 0


@pytest.mark.parametrize("bad", [("<P>", "<P>", "<M>"), ("", "b", "c"), ("ab", "bc", "d"), ("aba", "x", "y"), ("abc", "b", "z")])
def test_sentinels_that_could_be_misread(bad):
    with pytest.raises(ValueError):
        infill.check_sentinels(bad)
