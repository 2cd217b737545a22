import random
import re
from itertools import permutations
from math import factorial

import pytest
from pyspark.sql import functions as F

from cartlens.llm import filter_audit as fa

DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    """The filters applied one after the other, for each order."""
    out = {}
    text = lambda d: d[1] or ""
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, x in labels if x == 1 and k is not None}
    words = lambda d: re.findall(r"[^\x20\x09-\x0D]+", text(d))
    tests = {"A": lambda d: len(words(d)) < 100,
             "B": lambda d: 100 * len(set(words(d))) < 80 * len(words(d)),
             "C": lambda d: 100 * len(re.findall("[A-Z]", text(d))) > 10 * len(text(d)),
             "D": lambda d: bool(re.search(r"[#$%&*|]", text(d))),
             "E": lambda d: d[0] is not None and any(text(o) == text(d) and o[0] is not None and o[0] < d[0] for o in docs)}
    for part in {d[2] or "" for d in docs}:
        mine = [(d, {f for f in tests if tests[f](d)}) for d in docs if (d[2] or "") == part]
        sums = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for i, f in enumerate(order):
                gone = [d for d, fails in left if f in fails]
                early = [d for d, fails in mine if f in fails and fails & set(order[:i])]
                left = [x for x in left if f not in x[1]]
                sums[f] += len(gone)
                out[part, "".join(order), i + 1] = [len(left), len(gone), len(early), sum(fails == {f} for _, fails in mine),
                                                    sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)]
        for (p, order, i), v in out.items():
            if p == part:
                v.append(sums[order[i - 1]])
    return {k: tuple(v) for k, v in out.items()}


def result(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def run(spark, docs, labels):
    d = spark.createDataFrame(docs, DOCS).withColumns({"n": F.lit("extra"), "mask": F.lit(1), "quality": F.lit(0), "part": F.lit("x")})
    return result(fa.audit(d, spark.createDataFrame(labels, LABELS), fa.document_filters(), F.col("lang"), repeated="E"))


def some_text(rng):
    words = rng.choice([0, 3, 99, 100, 130])
    kinds = [lambda: f"w{rng.randrange(10 ** 6)}", lambda: "the", lambda: f"CAPS{rng.randrange(50)}", lambda: "ÄÖ😀"]
    word = lambda: rng.choices(kinds, [4, 1, 1, 1])[0]()
    return rng.choice(["", " "]) + rng.choice([" ", "\n", "\t "]).join(word() for _ in range(words)) + rng.choice(["", "", " $", "|"])


def test_equals_filters_applied_in_turn(spark):
    rng = random.Random(4)
    texts = [some_text(rng) for _ in range(40)]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(150)]
    docs += [(7, texts[0], "en"), (7, texts[0], "en"), (None, texts[0], "en"), (None, None, "de"), (200, None, "de"), (201, "", None), (202, "x y\u2028z", "only")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_edges(spark):
    assert run(spark, [], []) == {}
    alone = run(spark, [(None, None, None)], [])
    assert len(alone) == 600 and alone == brute([(None, None, None)], [])


def test_path_counts():
    for n in range(1, 8):
        edges = fa.lattice(n)
        assert len(edges) == n << (n - 1)
        assert all(orders == factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) for s, _, orders in edges)


def test_other_filters_without_copies(spark):
    d = spark.createDataFrame([(i, "t", "p") for i in range(10)], DOCS)
    failing = {"x": F.col("doc_id") < 6, "y": F.col("doc_id") > 3}
    got = result(fa.audit(d, spark.createDataFrame([(4, 1, 0)], LABELS), failing, F.lit("all")))
    assert got == {("all", "xy", 1): (4, 6, 0, 4, 1, 0, 10), ("all", "xy", 2): (0, 4, 2, 4, 0, 0, 10),
                   ("all", "yx", 1): (4, 6, 0, 4, 1, 0, 10), ("all", "yx", 2): (0, 4, 2, 4, 0, 0, 10)}
    with pytest.raises(ValueError):
        fa.audit(d, d, {"xx": F.lit(True)}, F.lit("all"))
