import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import html, judge, text
from lodestone.operators import chunking as ch

SUFFIXES = ["inc", "inc.", "corporation", "corp", "corp.", "ltd", "ltd.", "llc", "limited", "company", "co", "co.", "group", "holdings", "holding"]


def values(spark, column, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r["y"] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def plain_entity(x):
    x = x.lower().strip().replace("\n\n", " ")
    for s in SUFFIXES:
        if x.endswith(" " + s):
            x = x[: -len(s) - 1]
            break
    return re.sub(r"\s+", " ", x.rstrip(".,")).strip()


def test_entities_and_answers(spark):
    rng = random.Random(5)
    parts = ["Apple", ", ", " ", "  ", "Inc.", "Inc", "Co.", "Ltd", "Group", "\n\n", "\t", "Holdings", ".", "é", " ", "LLC"]
    rows = ["Apple, Inc.", "Foo Holdings Inc", "ACME Co., Ltd.", "x.,,", "inc", "a  b"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 7))) for _ in range(400)]
    assert values(spark, text.normalize_entity, rows) == [plain_entity(r) for r in rows]
    want = [re.sub(r"\s+", " ", re.sub(r"[^0-9a-z%.\s]", " ", r.lower())).strip() for r in rows]
    assert values(spark, text.normalize_answer, rows) == want


def test_refusals(spark):
    rows = ["No such INFO", "cannot find", "is not available.", "not found", "no information", "unable to answer", "don't have that information", "not provided", "it is not in the context", "yes"]
    assert values(spark, text.is_refusal, rows) == [True] * 6 + [False] + [True] * 2 + [False]
    assert values(spark, lambda x: text.is_refusal(x, True), rows)[6]


def test_headings_and_tables(spark):
    rows = ["ITEM 7A. Risk", "Risk Factors", "Name and Place", "A of B", "1. Overview", "Note:one", "not a title", "A b c d e f g h i j k", "Item 7", "", "X1"]
    assert values(spark, text.is_heading, rows) == [True] * 6 + [False] * 5
    assert [ch.heading(r) for r in rows] == [True] * 6 + [False] * 5
    assert values(spark, text.has_table, ["a|b", "a|b|c|d", "|--", "--", "a-|-b"]) == [False, True, True, False, True]


def test_sentences_answers_and_names(spark):
    def gone(x):
        return text.delete_sentences(x, F.array(F.lit("A.b*"), F.lit("C\\E(d"), F.lit("")))

    assert values(spark, gone, ["xa.B*y", "1c\\E(D2", "aXb*"]) == ["xy", "12", "aXb*"]
    replies = ['{"answer": "42"}', 'I say "answer": "4\\2"', "plain", '{"answer": null, "b": 1}']
    assert values(spark, text.parse_answer, replies)[:3] == ["42", "42", "plain"]
    assert values(spark, text.safe_name, [" a/b: c ", "__x__"]) == ["a_b_c", "x"]
    assert values(spark, text.padded_cik, ["123", "12345678901", "x1"]) == ["0000000123", "12345678901", "x1"]
    assert values(spark, text.collapse_lines, ["a\n \n\nb\nc  d"]) == ["a\nb c d"]
    assert values(spark, text.clean_page_marks, ["x\n12\ny\nTable of Contents\nz F-12 Item 7-a"]) == ["x\ny\nz Item 7 - a"]


def test_robust_cases(spark):
    kinds = [judge.EMPTY, judge.TRUTH, judge.SIMILAR, judge.DIFFERENT, judge.REAL]
    rows = [(k, c, n, w) for k in kinds for c, n in ((True, False), (False, True), (False, False)) for w in (True, False)]
    df = spark.createDataFrame(rows, "k string, c boolean, n boolean, w boolean")
    got = [r["r"] for r in df.select(judge.is_robust(F.col("c"), F.col("n"), F.col("w"), F.col("k")).alias("r")).collect()]

    def want(k, c, n, w):
        return c if w or k in (judge.TRUTH, judge.DIFFERENT) else n if k == judge.SIMILAR else (c or n) if k == judge.REAL else False

    assert got == [want(*r) for r in rows]


def test_contained(spark):
    rows = [("$94.8 Billion,", "94.8 billion"), ("", "x"), ("!!", "x"), ("a", "b"), (None, "b")]
    df = spark.createDataFrame(rows, "p string, t string")
    assert [r["c"] for r in df.select(judge.contained(F.col("p"), F.col("t")).alias("c")).collect()] == [True, True, True, False, False]
    assert [r["c"] for r in df.select(judge.contained(F.col("p"), F.col("t"), False).alias("c")).collect()] == [True, False, False, False, False]


def test_markdown_tables():
    table = "<table><tr><th>A|x</th><th> </th></tr><tr><td>1|2<td>b<tr><th>h</th><td></td></table>"
    assert html.first_table_markdown(table) == "| A|x |   |\n| --- | --- |\n| 1\\|2 | b |\n| h |   |"
    assert html.first_table_markdown("<p>x</p>") is None and html.first_table_markdown("<table></table>") == ""
    assert html.strip_html("<p>a &amp; b</p><br>c<td>d</td>") == "a & b\n\n\n\ncd  "


def test_spans_and_coloured_tables():
    root = html.unwrap_spans(html.tree('Item<span style="margin-left:3pt"></span>B<span>US</span>X<span style="margin-top:1pt"></span>'))
    assert root.text() == "Item BUSX\n"
    assert html.unwrap_plain_spans('a<span style="margin-left: 3pt">z</span>b') == "a b"
    page = '<table bgcolor="x"><tr bgcolor="#cceeff"><td>1</td></tr></table><table><tr><td>Item 1. x</td></tr></table><table><tr><td>p</td></tr></table>'
    gone = html.process_tables(html.tree(page), lambda t: "Item 1." in t, remove=True)
    assert [t.text() for t in gone.find("table")] == ["Item 1. x"] and gone.find("pre")[0].text() == "| p |\n| --- |"


def test_recursive_split_keeps_text():
    rng = random.Random(6)
    for _ in range(60):
        x = "".join(rng.choice(["word", " ", ". ", "\n", "\n\n", ", ", "longerword"]) for _ in range(rng.randint(0, 120)))
        pieces = ch.split_recursively(x, 20, 5)
        assert all(ch.count_tokens(p) <= 20 for p in pieces)
        assert re.sub(r"\s", "", "".join(ch.split_recursively(x, 20, 0))) == re.sub(r"\s", "", x)


def test_segments():
    body = " ".join(["word"] * 40)
    assert ch.segments(f"Risk Factors\n{body}\nOther Things\nshort") == [f"Risk Factors\n\n{body}\n\nOther Things\n\nshort"]
    assert ch.segments(f"One Title\nTwo Title\n{body}") == [f"One Title\n\nTwo Title\n\n{body}"]
    table = f"{body}\n| a | b |\n|---|---|\n| 1 | 2 |\nafter it"
    assert ch.segments(table) == [body, f"{body}\n| a | b |\n|---|---|\n| 1 | 2 |\nafter it"]
    open_table = "x y\n| a | b |\n|---|---|"
    assert ch.segments(open_table) == ["x y\n\nx y\n| a | b |\n|---|---|"] and ch.segments(open_table, legacy=True) == ["x y"]


def test_block_chunks_and_captions():
    blocks = [("text", "a b", 1), ("table", " t ", 1), ("text", "c d e", 2), ("text", "f", 3), ("other", "z", 3)]
    assert ch.block_chunks(blocks, 4) == [("table", "t", 1), ("text", "a b", 2), ("text", "c d e", 3), ("text", "f", 3)]
    assert ch.block_chunks([("text", "a b c d e", 0)], 4) == [("text", "a b c d e", 0)]
    assert ch.block_chunks([("text", "a b c d e", 0)], 4, legacy=True) == [("text", "", 0)]
    before = [("text", "x" * 101), ("text", "Table 1"), ("text", "units")]
    assert ch.captioned("T", [], ["n"], before, True) == "Table 1\nunits\nTn"
    assert ch.captioned("T", ["a", "b"], ["n"], [], False) == "a\nb\nTn" and ch.captioned("T", [], ["n"], [], False) == "T"


@pytest.mark.parametrize("size", [3, 600])
def test_greedy_blocks_match_plain(spark, size):
    rng = random.Random(7)
    rows = [(d, i, " ".join(["w"] * rng.randint(1, 5))) for d in range(5) for i in range(rng.randint(0, 9))]
    df = spark.createDataFrame(rows, "doc int, pos int, text string")
    got = [(r["doc"], r["chunk_pos"], r["chunk_text"]) for r in ch.greedy_blocks(df, "doc", "pos", "text", size).orderBy("doc", "chunk_pos").collect()]
    want = []
    for d in sorted({r[0] for r in rows}):
        for k, (_, t, _) in enumerate(ch.block_chunks([("text", t, 0) for e, _, t in rows if e == d], size)):
            want.append((d, k, t))
    assert got == want
