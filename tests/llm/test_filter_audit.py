import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from lodestone.llm.filter_audit import filter_audit, mask_counts, order_steps, survivors

WORDS = " ".join(f"w{i}" for i in range(120))


def flags(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(own) < 100,
        "B": 100 * len(set(own)) < 80 * len(own),
        "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        "D": any(c in text for c in "#$%&*|"),
    }


def slow(rows, labels):
    """Every order applied to every row, as the words of the contract have it."""
    docs = []
    for i, text, lang in rows:
        f = flags(text or "")
        f["E"] = i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in rows)
        docs.append((lang or "", f, any(k is not None and k == i and q == 1 for k, q, _ in labels), any(k is not None and k == i and x == 1 for k, _, x in labels)))
    out = {}
    for part in {d[0] for d in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            every = left
            for step, c in enumerate(order, 1):
                gone, kept = [d for d in left if d[1][c]], [d for d in left if not d[1][c]]
                fails = [d for d in every if d[1][c]]
                out[part, order, step] = [len(kept), len(gone), len(fails) - len(gone), sum(sum(d[1].values()) == 1 for d in fails), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                left = kept
    total = {}
    for (part, order, step), v in out.items():
        total[part, order[step - 1]] = total.get((part, order[step - 1]), 0) + v[1]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


ROWS = [
    (1, WORDS, "en"), (2, WORDS, "de"), (2, WORDS, "de"), (1, WORDS, "en"), (None, WORDS, "en"), (9, WORDS.upper(), "en"),
    (3, None, None), (4, "", ""), (5, " \n\t", None), (6, "é É #", "fr"), (7, "same same same same", "fr"), (8, "same same same same", "en"),
    (None, None, "en"), (10, WORDS + " $ x", "en"), (11, "a\x0bb\x0cc d", "en"), (12, ("x " * 150).strip(), "en"), (13, "one 😀 TWO", "de"),
]
LABELS = [(1, 1, 0), (2, None, 1), (2, 1, None), (None, 1, 1), (9, 0, 1), (4, 1, 1), (8, 1, 0), (77, 1, 1), (12, 1, 1)]
KEPT = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_against_every_order(spark):
    docs = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "doc_id long, text string, lang string, quality int, PART string").withColumnRenamed("PART", "n")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in KEPT) for r in filter_audit(docs, labels).collect()}
    assert got == slow(ROWS, LABELS)


def test_own_filters_and_empty_tables(spark):
    docs = spark.createDataFrame([(k, f"t{k % 7}", "p") for k in range(40)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    mine = {"x": F.col("doc_id") % 2 == 0, "y": F.when(F.col("doc_id") > 3, F.col("doc_id") % 3 == 0)}
    rows = {(r["filter_order"], r["step"]): r for r in filter_audit(docs, labels, mine, None).collect()}
    even, third = {k for k in range(40) if k % 2 == 0}, {k for k in range(4, 40) if k % 3 == 0}
    assert rows["xy", 1]["removed"] == len(even) and rows["xy", 2]["removed"] == len(third - even) and rows["yx", 2]["redundant"] == len(even & third)
    assert rows["xy", 1]["shapley"] == len(even) + len(even - third) and rows["xy", 1]["good_lost"] == 0
    assert filter_audit(docs.limit(0), labels).count() == 0
    with pytest.raises(ValueError):
        filter_audit(docs, labels, {"long": F.lit(True)}, None)
    counts = mask_counts(docs, labels, mine, "E")
    assert sum(r["n"] for r in counts.collect()) == 40
    alive = survivors(counts, 3).first()
    assert alive["n"][0] == 40 and alive["n"][4] == 7 and len(alive["n"]) == 8
    assert order_steps(survivors(counts, 3), "xyE").count() == 18


def test_a_text_that_most_rows_share_and_long_texts(spark):
    rows = [(k, "the same words", "en") for k in range(3000)] + [(5000, "word " * 200_000, "en"), (5001, "A" * 1_000_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(3000)], "doc_id long, quality int, toxic int")
    got = {(r["filter_order"], r["step"]): r for r in filter_audit(docs, labels).collect()}
    assert got["EABCD", 1]["removed"] == 2999 and got["EABCD", 1]["good_lost"] == 2999
    assert got["BCADE", 1]["removed"] == 1 and got["BCADE", 2]["removed"] == 1 and got["BCADE", 3]["removed"] == 3000 and got["BCADE", 5]["kept"] == 0
