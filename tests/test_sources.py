import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.functions.html import strip_html, unwrap_plain_spans
from lodestone.operators.tables import company_table
from lodestone.sources import tables as s


def zipped(**files):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("_", "."), text.encode("latin-1"))
    return held.getvalue()


def test_master_index_of_archives(spark, tmp_path):
    head = "".join(f"line {k}\n" for k in range(10)) + "1|looks|like a row|but is|a header.txt\n"
    rows = "320193|Apple é|10-K|2020-01-01|edgar/1.txt\r\n\nx|bad|row|a|b\n7|B|8-K|2020-01-02|edgar/2.txt"
    (tmp_path / "a.zip").write_bytes(zipped(master_idx=head + rows))
    (tmp_path / "b.zip").write_bytes(zipped(other_idx=head + rows))
    (tmp_path / "c.zip").write_bytes(zipped(master_idx="short\n"))
    archives = spark.read.format("binaryFile").load(str(tmp_path / "*.zip"))
    got = sorted(map(tuple, s.parse_master_index(s.archive_lines(archives)).select("CIK", "Company", "complete_text_file_link", "html_index").collect()))
    assert got == [("320193", "Apple é", "edgar/1.txt", "edgar/1-index.html"), ("7", "B", "edgar/2.txt", "edgar/2-index.html")]
    assert s.archive_lines(archives.limit(0)).count() == 0


def test_company_tables(spark):
    plain = spark.createDataFrame([(" A ", "A Inc", "x", "y", "12"), ("B", None, "x", "y", "12345678901")], "Symbol string, Security string, `GICS Sector` string, `GICS Sub-Industry` string, CIK string")
    assert [tuple(r) for r in company_table(plain).orderBy("Symbol").collect()] == [("A", "A Inc", "x", "y", "0000000012"), ("B", None, "x", "y", "12345678901")]
    odd = spark.createDataFrame([("A", "first", "last", "s", "i", 5)], "ticker string, company string, `old name` string, SECTOR string, industry string, z int")
    assert tuple(company_table(odd).first()) == ("A", "last", "s", "i", "")
    with pytest.raises(ValueError, match="Security"):
        company_table(odd.drop("company", "old name"))


def test_links_are_joined(spark):
    rows = [("https://a.org/x/y?q=1", "z.pdf"), ("https://a.org/x/", "../z.pdf"), ("https://a.org", "/z.pdf"), ("https://a.org/x", "//b.org/z.pdf"), ("https://a.org/x", None), (None, "z.pdf"), ("http://a/b", "https://c/d.pdf")]
    got = [r["u"] for r in spark.createDataFrame(rows, "p string, l string").coalesce(1).select(t.joined_url("p", "l").alias("u")).collect()]
    assert got == ["https://a.org/x/z.pdf", "https://a.org/z.pdf", "https://a.org/z.pdf", "https://b.org/z.pdf", None, "z.pdf", "https://c/d.pdf"]


def test_filing_index_by_form_and_number(spark, tmp_path):
    line = lambda cik, form: "|".join([cik, "c", form, "d", "t.txt", "h.html", *[""] * 8])
    (tmp_path / "i.csv").write_text("\n".join([line("0000000007", "10-K"), line("7", "8-K"), line("8", "10-K"), line("x", "10-K")]))
    found = s.read_filing_index(spark, [str(tmp_path / "i.csv")], ["10-K"], ["7"], "https://x/")
    assert [(r["CIK"], r["html_index"], r["complete_text_file_link"]) for r in found.collect()] == [("0000000007", "https://x/h.html", "https://x/t.txt")]


def test_tags_and_marks(spark):
    html = "<p>a</p>b< br >c<br/>d<td>e</td ><th>f</th></>g<i>h</i>&amp;"
    df = spark.createDataFrame([(html, "\nPage 3 *\nx\n - 12 -\ny\nINDEX TO FINANCIAL STATEMENTS\nz F-3\nItem 1A-Risk")], "h string, m string")
    row = df.select(t.strip_tags(F.col("h")).alias("a"), t.clean_page_marks(F.col("m")).alias("b")).first()
    assert row["a"] == "a\n\nbc\n\nd" + "e  " + "f  " + "\n\ngh&amp;"
    assert strip_html(html).endswith("gh&")
    assert row["b"] == "\nPage 3 *\nx\n - 12 -\ny\nz\nItem 1A - Risk"
    assert unwrap_plain_spans('a<span style="x; margin-LEFT: 2.5pt">q</span>b<span style="margin-top:3pt;margin-left:1pt"></span>c<SPAN class="k" style="margin-bottom: 1pt">r</SPAN>d<span style="margin-top:auto">s</span>') == 'a b c\nd<span style="margin-top:auto">s</span>'
