"""Queries on text functions and document tables, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators import ranking
from lodestone.operators import tables as ops
from lodestone.operators.perturb import HOMOGLYPHS, NEAR, STOPWORDS
from lodestone.plans.views import chunks, qa, table

CHUNKS_SQL = """lines AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
chunks AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, 'doc_' || doc_id || '_chunk_' || pos AS chunk_id, text, lang, source FROM lines WHERE trim(text) <> '')"""
QA_SQL = """turns AS (SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
qa AS (SELECT 'conv_' || conv_id || '_' || turn AS record_id, conv_id, turn, text AS question, answer FROM turns WHERE role = 'user' AND after = 'assistant')"""
WS = r"[\s]"
TRIMMED = "regexp_replace({x}, '^[\\t-\\r ]+|[\\t-\\r ]+$', '', 'g')"
WORDS = "list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"
ANSWER = "regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^0-9a-z%.\\s]', ' ', 'g'), '\\s+', ' ', 'g'), '^ | $', '', 'g')"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query("""WITH old AS (SELECT source AS document_id, lang AS domain, min(doc_id) AS seq, count(*) AS chunk_count FROM documents WHERE doc_id % 3 <> 1 GROUP BY ALL),
new AS (SELECT source AS document_id, lang AS domain, 1000000 + min(doc_id) AS seq, count(*) AS chunk_count FROM documents WHERE doc_id % 3 <> 0 GROUP BY ALL)
SELECT coalesce(n.document_id, o.document_id) AS document_id, coalesce(n.domain, o.domain) AS domain, coalesce(o.seq, n.seq) AS seq, coalesce(n.chunk_count, o.chunk_count) AS chunk_count
FROM old o FULL JOIN new n USING (document_id, domain)""")
def doc_index_upsert(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    index = lambda df, add: df.groupBy(F.col("source").alias("document_id"), F.col("lang").alias("domain")).agg((F.min("doc_id") + add).alias("seq"), F.count("*").alias("chunk_count"))
    return ops.upsert(index(docs.where("doc_id % 3 <> 1"), 0), index(docs.where("doc_id % 3 <> 0"), 1_000_000), ["document_id", "domain"], "seq")


@query(SQL["doc_index_upsert"])
def doc_index_versions(spark: SparkSession, sf: str) -> DataFrame:
    """The same through a table of versions: two commits, the second one an upsert."""
    from lodestone.sources.folders import shared_path
    from lodestone.sources.versioned import VersionedTable, save_document_index

    docs, root = table(spark, sf, "documents"), shared_path(spark, "index")
    index = lambda df, add: df.groupBy(F.col("source").alias("document_id"), F.col("lang").alias("domain")).agg((F.min("doc_id") + add).alias("seq"), F.count("*").alias("chunk_count"))
    save_document_index(index(docs.where("doc_id % 3 <> 1"), 0), root)
    save_document_index(index(docs.where("doc_id % 3 <> 0"), 1_000_000), root)
    return VersionedTable(spark, root).read()


@query("SELECT source, arg_min(lang, doc_id) AS lang, min(doc_id) AS doc_id FROM documents GROUP BY source")
def first_seen_meta(spark: SparkSession, sf: str) -> DataFrame:
    return ops.first_wins(table(spark, sf, "documents").select("source", "lang", "doc_id").withColumn("seq", F.col("doc_id")), ["source"], "seq").drop("seq")


@query("""SELECT 'c' || (doc_id % 97) AS chunk_id, arg_max(doc_id, doc_id) AS doc_id, min(doc_id) AS pos FROM documents GROUP BY 1""")
def last_wins_chunk(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.sources.tables import unique_chunks

    rows = table(spark, sf, "documents").select(F.concat(F.lit("c"), F.col("doc_id") % 97).alias("chunk_id"), "doc_id", F.col("doc_id").alias("pos"))
    return unique_chunks(rows, ["chunk_id"])


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery')")
def filter_ci_in(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").where(ops.in_any_case(F.col("c_mktsegment"), ["Building", "MACHINERY"])).select("c_custkey", "c_mktsegment")


@query("SELECT n_nationkey, n_name FROM nation WHERE regexp_matches(n_name, '(?i)a.*1|7$')")
def filter_regex(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").where(F.rlike("n_name", F.lit("(?i)a.*1|7$"))).select("n_nationkey", "n_name")


@query("SELECT n_nationkey, n_name FROM nation")
def filter_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return ops.filter_or_all(table(spark, sf, "nation").select("n_nationkey", "n_name"), F.col("n_name") == "nowhere")


@query("""SELECT c_mktsegment AS sector, array_to_string(list_sort(list(DISTINCT c_nationkey))[1:3], ',') AS sample, CAST(count(DISTINCT c_nationkey) - 3 AS BIGINT) AS more FROM customer GROUP BY 1""")
def sector_listing(spark: SparkSession, sf: str) -> DataFrame:
    inner = F.sort_array(F.collect_set("c_nationkey"))  # a segment's nations: bounded by the dimension
    rows = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("sector")).agg(inner.alias("all"))
    return rows.select("sector", F.array_join(F.slice("all", 1, 3).cast("array<string>"), ",").alias("sample"), (F.size("all") - 3).cast("long").alias("more")).orderBy("sector")


@query("""WITH old AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 1), alive AS (SELECT o_orderkey, o_custkey FROM old WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))
SELECT * FROM alive UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey NOT IN (SELECT o_orderkey FROM alive)""")
def incremental_anti(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    kept = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return ops.incremental(orders.where("o_orderkey % 3 <> 1"), orders.where("o_orderkey % 3 <> 0"), kept, "o_custkey", "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_existing(spark: SparkSession, sf: str) -> DataFrame:
    return ops.anti_existing(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("""WITH dim AS (SELECT CAST(lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS BIGINT) AS k, min(c_mktsegment) AS segment FROM customer WHERE c_custkey % 4 <> 0 GROUP BY 1)
SELECT o_orderkey, coalesce(segment, '') AS segment FROM orders LEFT JOIN dim ON o_custkey = k""")
def dim_left_first(spark: SparkSession, sf: str) -> DataFrame:
    dim = table(spark, sf, "customer").where("c_custkey % 4 <> 0").select(t.padded_cik(F.col("c_custkey").cast("string")).alias("cik"), "c_mktsegment")
    dim = dim.groupBy(F.expr("try_cast(cik as bigint)").alias("k")).agg(F.min("c_mktsegment").alias("segment"))
    orders = table(spark, sf, "orders")
    return orders.join(dim, orders["o_custkey"] == dim["k"], "left").select("o_orderkey", F.coalesce("segment", F.lit("")).alias("segment"))


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, c_mktsegment) AS fact FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def fill_if_missing(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("fact"))
    known = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("fact"))
    return ops.fill_missing(rows, known, "k", ["fact"]).select("o_orderkey", "fact")


@query("""SELECT CAST(o_orderkey AS BIGINT) AS key, 'order' AS form, 'https://x/' || o_orderkey AS link FROM orders WHERE o_orderstatus IN ('F', 'P')
UNION ALL SELECT l_orderkey, 'line', 'https://x/' || l_orderkey FROM lineitem WHERE l_returnflag IN ('R')""")
def index_scan_union(spark: SparkSession, sf: str) -> DataFrame:
    """Index files of two sources, written with padded numbers and read by form."""
    from lodestone.sources.folders import shared_path
    from lodestone.sources.tables import FILING_INDEX, read_filing_index

    root, found = shared_path(spark, "index"), []
    for name, source, key, kind, forms in (("order", "orders", "o_orderkey", "o_orderstatus", ["F", "P"]), ("line", "lineitem", "l_orderkey", "l_returnflag", ["R"])):
        own = {"CIK": F.lpad(F.col(key).cast("string"), 10, "0"), "Type": F.col(kind), "html_index": F.col(key).cast("string")}
        table(spark, sf, source).select(*(own.get(c, F.lit(None).cast("string")).alias(c) for c in FILING_INDEX.names)).write.csv(f"{root}/{name}", sep="|")
        read = read_filing_index(spark, [f"{root}/{name}"], forms, prefix="https://x/")
        found.append(read.select(F.expr("try_cast(CIK as bigint)").alias("key"), F.lit(name).alias("form"), F.col("html_index").alias("link")))
    return ops.union_all(found)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 24 WHEN o_orderkey % 3 = 1 THEN 12 WHEN CAST(o_orderdate AS DATE) > DATE '2004-08-23' THEN 33 ELSE 13 END AS n_items,
CASE WHEN o_orderkey % 3 = 0 THEN '9A,7' WHEN o_orderkey % 3 = 1 THEN '' WHEN CAST(o_orderdate AS DATE) > DATE '2004-08-23' THEN '' ELSE '7' END AS chosen FROM orders""")
def item_list_by_date(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.operators.filings import item_list_column

    form = F.when(F.col("o_orderkey") % 3 == 0, "10-K").when(F.col("o_orderkey") % 3 == 1, "10-Q").otherwise("8-K")
    listed = item_list_column(form, F.col("o_orderdate").cast("date"))
    return table(spark, sf, "orders").select("o_orderkey", F.size(listed).alias("n_items"), F.array_join(F.array_intersect(F.array(F.lit("9A"), F.lit("7")), listed), ",").alias("chosen"))


@query(f"SELECT doc_id, replace({TRIMMED.format(x='lower(text)')}, chr(10) || chr(10), ' ') AS norm FROM documents")
def norm_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", t.normalize_text(F.col("text")).alias("norm"))


_ENTITY = "regexp_replace(replace(regexp_replace(lower(s_name || s), '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10), ' '), ' (inc\\.?|corporation|corp\\.?|ltd\\.?|llc|limited|company|co\\.?|group|holdings?)$', '')"


@query(f"""SELECT s_suppkey, regexp_replace(regexp_replace(rtrim({_ENTITY}, '.,'), '\\s+', ' ', 'g'), '^ | $', '', 'g') AS entity
FROM (SELECT s_suppkey, s_name, ['', ', Inc.', ' Holdings Inc', ' Co., Ltd.', ' .,,', '  Group'][1 + s_suppkey % 6] AS s FROM supplier)""")
def norm_entity(spark: SparkSession, sf: str) -> DataFrame:
    ends = F.array(*map(F.lit, ["", ", Inc.", " Holdings Inc", " Co., Ltd.", " .,,", "  Group"]))
    return table(spark, sf, "supplier").select("s_suppkey", t.normalize_entity(F.concat("s_name", ends[(F.col("s_suppkey") % 6).cast("int")])).alias("entity"))


@query(f"SELECT conv_id, turn, {ANSWER.format(x='text')} AS norm FROM conversations")
def norm_answer(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", t.normalize_answer(F.col("text")).alias("norm"))


@query(f"""SELECT doc_id, regexp_matches({ANSWER.format(x='x')}, 'no such info|cannot find|not available|not found|no information|unable to answer|not provided|not in the context') AS refusal
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Sorry: NO such, info.' WHEN 1 THEN 'It is NOT--found here' WHEN 2 THEN 'don''t have that information' ELSE text END AS x FROM documents)""")
def refusal_flag(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 4
    text = F.when(k == 0, "Sorry: NO such, info.").when(k == 1, "It is NOT--found here").when(k == 2, "don't have that information").otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", t.is_refusal(text).alias("refusal"))


# Paragraphs are what stands between blank lines; inside of them lines are joined by spaces.
_COLLAPSED = "array_to_string(list_transform(string_split_regex(array_to_string(list_transform(string_split(x, chr(10)), lambda l: trim(l)), chr(10)), '\\n{2,}'), lambda p: replace(p, chr(10), ' ')), chr(10))"


@query(f"""SELECT page_id, regexp_replace({_COLLAPSED}, ' +', ' ', 'g') AS collapsed FROM (SELECT page_id, regexp_replace(replace(html, '<br>', chr(10) || ' ' || chr(10)), '^\\s+|\\s+$', '', 'g') AS x FROM pages)""")
def collapse_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", t.collapse_lines(F.replace("html", F.lit("<br>"), F.lit("\n \n"))).alias("collapsed"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(url, '[\\/*?:"<>|\s]', '_', 'g'), '_+', '_', 'g'), '_') AS name FROM pages""")
def squeeze_id(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", t.safe_name(F.col("url")).alias("name"))


@query("""SELECT doc_id, translate(x, chr(8212) || chr(8217), '') AS bare FROM (SELECT doc_id, replace(replace(replace(text, ' ', ' '), 'a', 'a' || chr(8212)), 'e', chr(8217) || 'e') AS x FROM documents)""")
def clean_chars(spark: SparkSession, sf: str) -> DataFrame:
    odd = F.replace(F.replace("text", F.lit("a"), F.lit("a—")), F.lit("e"), F.lit("’e"))
    return table(spark, sf, "documents").select("doc_id", t.clean_punctuation(odd).alias("bare"))


_BROKEN = r"regexp_replace(regexp_replace(html, '</?\s*br\s*/?>', chr(10) || chr(10), 'g'), '<\s*/\s*(div|tr|p|li)?\s*>', chr(10) || chr(10), 'g')"


@query(rf"""SELECT page_id, regexp_replace(regexp_replace({_BROKEN}, '<\s*/\s*t[hd]\s*>', '  ', 'g'), '<[^>]*>', '', 'g') AS text FROM pages""")
def strip_tags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", t.strip_tags(F.col("html")).alias("text"))


@query()
def strip_html_parser(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.functions.html import strip_html_udf

    return table(spark, sf, "pages").select("page_id", strip_html_udf()("html").alias("text"))


@query(f"""WITH {CHUNKS_SQL} SELECT chunk_id, len({WORDS.format(x='text')}) <= 10 AND regexp_matches({TRIMMED.format(x='text')}, '^(ITEM\\s+\\d+[A-Z]?\\.|[A-Z][A-Za-z\\s]+$|\\d+\\.\\s+[A-Z][A-Za-z\\s]+$|[A-Z][A-Za-z\\s]+:[A-Za-z\\s]+$)') AS heading FROM chunks""")
def title_flag(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).select("chunk_id", t.is_heading(F.col("text")).alias("heading"))


@query(f"""WITH {CHUNKS_SQL} SELECT chunk_id, contains(text, '|') AND (contains(text, '--') OR length(text) - length(replace(text, '|', '')) >= 3) AS has_table FROM chunks""")
def table_flag(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).select("chunk_id", t.has_table(F.col("text")).alias("has_table"))


@query("""SELECT doc_id, round(CASE WHEN s > 0 THEN (length(text) - length(regexp_replace(text, '\\d', '', 'g'))) / s ELSE 0 END, 6) AS digits, round(CASE WHEN length(text) > 0 THEN (length(text) - s) / length(text) ELSE 0 END, 6) AS spaces
FROM (SELECT *, length(regexp_replace(text, '\\s', '', 'g')) AS s FROM documents)""")
def digit_share(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.round(t.digit_share(F.col("text")), 6).alias("digits"), F.round(t.space_share(F.col("text")), 6).alias("spaces"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(text, 'the\\. ', '', 'gi'), 'ing the', '', 'gi') AS rest FROM documents""")
def sentence_delete(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", t.delete_sentences(F.col("text"), F.array(F.lit("the. "), F.lit("ing the"))).alias("rest"))


@query(f"""WITH {QA_SQL} SELECT record_id, '[Doc 1] ' || question || chr(10) || chr(10) || '[Doc 2] ' || answer AS context FROM qa""")
def context_format(spark: SparkSession, sf: str) -> DataFrame:
    return qa(spark, sf).select("record_id", t.format_context(F.array("question", "answer")).alias("context"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS preview FROM documents")
def preview(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", t.preview(F.col("text")).alias("preview"))


@query("SELECT doc_id, sha1(source || ',' || lang) AS h FROM documents")
def path_sha1(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", t.path_hash(F.array("source", "lang")).alias("h"))


@query("SELECT doc_id, 'the_domain_' || source || '_chunk_' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(6, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') AS id FROM documents")
def id_build(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", t.build_id(F.lit("the domain"), F.col("source"), F.lit("chunk"), t.padded_number(F.col("doc_id"))).alias("id"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'v' || event_id WHEN 1 THEN 'loose ' || event_id ELSE 'plain ' || event_id END AS answer FROM events""")
def answer_parse_json(spark: SparkSession, sf: str) -> DataFrame:
    e, k = F.col("event_id").cast("string"), F.col("event_id") % 3
    reply = F.when(k == 0, F.concat(F.lit('{"answer": "v'), e, F.lit('"}'))).when(k == 1, F.concat(F.lit('so "answer": "loose '), e, F.lit('"'))).otherwise(F.concat(F.lit("plain "), e))
    return table(spark, sf, "events").select("event_id", t.parse_answer(reply).alias("answer"))


@query(f"""WITH {CHUNKS_SQL}, placed AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1) // 5 AS grp FROM chunks)
SELECT doc_id, CAST(grp AS BIGINT) AS grp, string_agg(chunk_id, ',' ORDER BY pos) AS items FROM placed GROUP BY ALL""")
def group_of_five(spark: SparkSession, sf: str) -> DataFrame:
    return ops.groups_of(chunks(spark, sf), ["doc_id"], "pos", 5, "chunk_id").select("doc_id", "grp", F.array_join("items", ",").alias("items"))


@query(f"""WITH {CHUNKS_SQL}, run AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM chunks)
SELECT doc_id, pos FROM run WHERE before < 300""")
def cumulative_stop(spark: SparkSession, sf: str) -> DataFrame:
    return ops.until_total(chunks(spark, sf).withColumn("n", F.length("text")), ["doc_id"], "pos", "n", 300).select("doc_id", "pos")


@query("""SELECT s_suppkey, CAST((row_number() OVER w - 1) // 4 AS BIGINT) AS batch, CASE WHEN count(*) OVER (PARTITION BY s_nationkey) > 4 THEN '_' || ((row_number() OVER w - 1) // 4 + 1) ELSE '' END AS suffix
FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)""")
def batch_of_four(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.operators.graph import batches_of

    return batches_of(table(spark, sf, "supplier"), ["s_nationkey"], "s_suppkey").select("s_suppkey", "batch", "suffix")


@query(f"""WITH {CHUNKS_SQL}, l AS (SELECT *, CASE WHEN length(text) > 20 THEN text END AS line FROM chunks)
SELECT chunk_id, concat_ws(chr(10), lag(line, 2) OVER w, lag(line, 1) OVER w) AS context FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""")
def lag_context(spark: SparkSession, sf: str) -> DataFrame:
    return ops.preceding_lines(chunks(spark, sf), ["doc_id"], "pos", "text", F.length("text") > 20).select("chunk_id", "context")


@query(f"""WITH {CHUNKS_SQL}, m AS (SELECT *, min(CASE WHEN contains(text, 'License') THEN pos END) OVER (PARTITION BY doc_id) AS first FROM chunks)
SELECT doc_id, pos FROM m WHERE first IS NULL OR pos < first""")
def truncate_at_marker(spark: SparkSession, sf: str) -> DataFrame:
    return ops.before_marker(chunks(spark, sf), ["doc_id"], "pos", F.contains("text", F.lit("License"))).select("doc_id", "pos")


@query(f"""WITH {CHUNKS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM chunks),
m AS (SELECT *, min(CASE WHEN contains(text, '|') THEN i END) OVER (PARTITION BY doc_id) AS first, max(i) OVER (PARTITION BY doc_id) AS last FROM p)
SELECT doc_id, pos FROM m WHERE i >= CASE WHEN first >= 1 THEN first - 1 WHEN first = 0 THEN last END""")
def slice_from_marker(spark: SparkSession, sf: str) -> DataFrame:
    return ops.from_marker(chunks(spark, sf), ["doc_id"], "pos", F.contains("text", F.lit("|"))).select("doc_id", "pos")


_SENTENCES = f"""{CHUNKS_SQL}, parts AS (SELECT doc_id, chunk_id, unnest(string_split(text, '. ')) AS sentence, unnest(range(1, len(string_split(text, '. ')) + 1)) AS n FROM chunks),
s AS (SELECT doc_id, chunk_id || '_' || n AS sentence_id, sentence FROM parts WHERE trim(sentence) <> '')"""


@query(f"""WITH {_SENTENCES}, low AS (SELECT doc_id, chunk_id, pos, {TRIMMED.format(x='lower(text)')} AS t FROM chunks), asked AS (SELECT *, {TRIMMED.format(x='lower(sentence)')} AS x FROM s)
SELECT a.doc_id, sentence_id, arg_min(chunk_id, pos) AS chunk_id FROM asked a JOIN low c ON a.doc_id = c.doc_id AND contains(t, x) GROUP BY ALL""")
def locate_sentence(spark: SparkSession, sf: str) -> DataFrame:
    """Every sentence of every chunk: many stand in an earlier chunk, too."""
    from lodestone.operators.relations import located

    own = chunks(spark, sf)
    parts = own.select("doc_id", "chunk_id", F.posexplode(F.split("text", "\\. ")).alias("n", "sentence"))
    every = parts.select(F.concat_ws("_", "chunk_id", (F.col("n") + 1).cast("string")).alias("sentence_id"), "doc_id", "sentence")
    return located(every, own).select("doc_id", "sentence_id", "chunk_id")


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha1('42|' || doc_id)) AS n FROM documents) SELECT doc_id, lang FROM r WHERE n <= 30""")
def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.hash_sample(table(spark, sf, "documents").select("doc_id", "lang"), ["lang"], F.col("doc_id"), 30)


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER w - 1 AS shuffled, n_chars > 1000 AS ok, sum(CAST(n_chars > 1000 AS INT)) OVER (PARTITION BY lang ORDER BY sha1('42|' || doc_id) ROWS UNBOUNDED PRECEDING) AS so_far FROM documents WINDOW w AS (PARTITION BY lang ORDER BY sha1('42|' || doc_id)))
SELECT doc_id, lang || '_' || lpad(CAST(shuffled AS VARCHAR), CAST(greatest(6, length(CAST(shuffled AS VARCHAR))) AS INTEGER), '0') AS id FROM r WHERE ok AND so_far <= 20""")
def hash_shuffle_topn(spark: SparkSession, sf: str) -> DataFrame:
    rows = ranking.accepted_first(table(spark, sf, "documents"), ["lang"], F.col("doc_id"), F.col("n_chars") > 1000, 20)
    return rows.select("doc_id", F.concat_ws("_", "lang", t.padded_number(F.col("shuffled"))).alias("id"))


@query("""SELECT doc_id FROM labels WHERE quality + 2 > 2 AND 3 - toxic > 2""")
def score_gate(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.operators.graph import gate

    scores = F.create_map(F.lit("clear"), F.col("quality") + 2, F.lit("clean"), 3 - F.col("toxic"))
    return table(spark, sf, "labels").where(gate(scores)).select("doc_id")


@query("SELECT CASE WHEN n_chars > 2000 THEN 'multi' ELSE 'single' END AS kind, count(*) AS n FROM documents GROUP BY 1")
def qa_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(F.when(F.col("n_chars") > 2000, "multi").otherwise("single").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang AS a, 'two' AS b, source AS c FROM documents")
def map_union_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    m = ops.map_union(F.create_map(F.lit("a"), F.col("lang"), F.lit("b"), F.lit("one")), F.create_map(F.lit("b"), F.lit("two"), F.lit("c"), F.col("source")))
    return table(spark, sf, "documents").select("doc_id", m["a"].alias("a"), m["b"].alias("b"), m["c"].alias("c"))


@query(f"""WITH {QA_SQL} SELECT DISTINCT record_id || ',x' AS ids, 'S ' || (turn % 3) AS sentences FROM qa""")
def perturb_dedupe_joinback(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.operators.perturb import needed

    pairs = qa(spark, sf).withColumn("answer_chunk_ids", F.array("record_id", F.lit("x"))).withColumn("source_sentences", F.array(F.concat(F.lit("S "), F.col("turn") % 3)))
    return needed(pairs)[1].select(F.array_join("answer_chunk_ids", ",").alias("ids"), F.array_join("source_sentences", ",").alias("sentences"))


_SIM = "round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6)"


def _candidates(sf_qa: DataFrame) -> DataFrame:
    from lodestone.operators.perturb import token_similarity

    tries = F.array(F.replace("question", F.lit(" the "), F.lit(" ")), F.upper("question"), F.lower(F.concat("question", F.lit(" x"))))
    rows = sf_qa.select("record_id", "question", F.posexplode(tries).alias("attempt", "candidate"))
    return rows.withColumn("similarity", token_similarity(F.col("question"), F.col("candidate")))


_TRIES = f"""tries AS (SELECT record_id, question, unnest([0, 1, 2]) AS attempt, unnest([replace(question, ' the ', ' '), upper(question), lower(question || ' x')]) AS candidate FROM qa),
scored AS (SELECT *, {_SIM} AS similarity FROM (SELECT *, list_distinct(string_split_regex(lower(question), '\\s+')) AS x, list_distinct(string_split_regex(lower(candidate), '\\s+')) AS y FROM tries))"""


@query(f"""WITH {QA_SQL}, {_TRIES}
SELECT record_id, candidate, similarity FROM scored QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY similarity DESC, attempt) = 1""")
def best_of_n(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.operators.perturb import best_candidates

    return best_candidates(_candidates(qa(spark, sf)), ["record_id"], None)


@query(f"""WITH {QA_SQL}, {_TRIES}
SELECT record_id, candidate, similarity FROM scored QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY CASE WHEN similarity >= 0.85 THEN attempt ELSE 9 END, similarity DESC, attempt) = 1""")
def early_accept(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.operators.perturb import best_candidates

    return best_candidates(_candidates(qa(spark, sf)), ["record_id"])


_NEAR = "MAP {" + ", ".join(f"'{c}': '{n}'" for c, n in NEAR.items()) + "}"
_ALIKE = "MAP {" + ", ".join(f"'{c}': '{n}'" for c, n in HOMOGLYPHS.items()) + "}"
_STAY = ", ".join(f"'{w}'" for w in sorted(STOPWORDS))
_CORE = "lower(regexp_replace(w, '^[.,;:?!]+|[.,;:?!]+$', '', 'g'))"
_DRAWN = """runs AS (SELECT record_id, question, regexp_extract_all(question, '\\s+|\\S+') AS r FROM qa WHERE question <> ''),
each AS (SELECT record_id, unnest(r) AS w, unnest(range(0, len(r))) AS i FROM runs),
words AS (SELECT *, regexp_matches(w, '^\\S') AS word FROM each),
able AS (SELECT record_id, i, w, CAST('0x' || substr(sha1('42|{way}|' || record_id || '|0|' || i), 1, 8) AS BIGINT) AS h FROM words WHERE word AND length(w) > 1 AND {core} NOT IN ({stay}) AND regexp_matches(w, '\\p{{L}}')),
drawn AS (SELECT a.* FROM able a JOIN (SELECT record_id, greatest(1, floor(count(*) FILTER (word) * 0.1 + 0.5)) AS k FROM words GROUP BY 1) USING (record_id) QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY h, i) <= k)"""


@query(f"""WITH {QA_SQL}, {_DRAWN.format(way='char', core=_CORE, stay=_STAY)},
hit AS (SELECT record_id, i, w, CAST('0x' || substr(sha1('42|char|' || record_id || '|0|' || i || '|slip'), 1, 8) AS BIGINT) AS h, list_filter(range(1, length(w) + 1), lambda p: regexp_matches(substr(w, p, 1), '\\p{{L}}')) AS places FROM drawn),
spot AS (SELECT *, CAST(places[1 + h % len(places)] AS INTEGER) AS p, lower(substr(w, CAST(places[1 + h % len(places)] AS BIGINT), 1)) AS l FROM hit),
way AS (SELECT *, list_concat(['delete', 'swap'], CASE WHEN map_contains({_NEAR}, l) THEN ['keyboard'] ELSE [] END, CASE WHEN map_contains({_ALIKE}, l) THEN ['homoglyph'] ELSE [] END) AS ways, {_NEAR}[l] AS near, {_ALIKE}[l] AS alike, CASE WHEN p < length(w) THEN p ELSE p - 1 END AS f FROM spot),
slips AS (SELECT record_id, i, CASE ways[1 + (h // 64) % len(ways)] WHEN 'delete' THEN left(w, p - 1) || substr(w, p + 1) WHEN 'swap' THEN left(w, f - 1) || substr(w, f + 1, 1) || substr(w, f, 1) || substr(w, f + 2)
WHEN 'keyboard' THEN left(w, p - 1) || substr(near, 1 + (h // 4096) % length(near), 1) || substr(w, p + 1) ELSE left(w, p - 1) || alike || substr(w, p + 1) END AS s FROM way),
made AS (SELECT record_id, string_agg(coalesce(s, w), '' ORDER BY i) AS perturbed FROM each LEFT JOIN slips USING (record_id, i) GROUP BY 1)
SELECT record_id, question, coalesce(perturbed, question) AS perturbed FROM qa LEFT JOIN made USING (record_id)""")
def char_perturb(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.operators.perturb import character_level

    return qa(spark, sf).select("record_id", "question", character_level(F.col("record_id"), F.col("question")).alias("perturbed"))


@query(f"""WITH {QA_SQL}, {_DRAWN.format(way='word', core=_CORE, stay=_STAY)},
vocabulary AS (SELECT DISTINCT {_CORE} AS word FROM (SELECT unnest(regexp_extract_all(question, '\\S+')) AS w FROM qa)),
near AS (SELECT word, list_filter([lag(word) OVER v, lead(word) OVER v], lambda o: o IS NOT NULL) AS options FROM vocabulary WHERE word <> '' WINDOW v AS (PARTITION BY left(word, 1), length(word) ORDER BY word)),
told AS (SELECT record_id, i, regexp_extract(w, '^[.,;:?!]*') || options[1 + CAST('0x' || substr(sha1('42|word|' || record_id || '|0|' || i || '|near'), 1, 8) AS BIGINT) % len(options)] || regexp_extract(w, '[.,;:?!]*$') AS s
FROM drawn JOIN near ON {_CORE} = word WHERE len(options) > 0),
made AS (SELECT record_id, string_agg(coalesce(s, w), '' ORDER BY i) AS perturbed FROM each LEFT JOIN told USING (record_id, i) GROUP BY 1)
SELECT record_id, question, coalesce(perturbed, question) AS perturbed FROM qa LEFT JOIN made USING (record_id)""")
def word_perturb(spark: SparkSession, sf: str) -> DataFrame:
    """Near words are those next to a word in the questions' vocabulary, of one length and first letter."""
    from pyspark.sql import Window

    from lodestone.operators.perturb import core, word_level

    rows = qa(spark, sf).select("record_id", "question")
    vocabulary = rows.select(F.explode(F.regexp_extract_all("question", F.lit(r"(\S+)"), 1)).alias("w")).select(core(F.col("w")).alias("word")).where("word <> ''").distinct()
    own = Window.partitionBy(F.left("word", F.lit(1)), F.length("word")).orderBy("word")
    near = vocabulary.withColumn("options", F.array(F.lag("word").over(own), F.lead("word").over(own))).withColumn("options", F.filter("options", lambda o: o.isNotNull()))
    return word_level(rows, "record_id", "question", near).select("record_id", "question", "perturbed")


@query()
def filing_chunker(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.operators.chunking import chunked, filing_chunks

    return chunked(table(spark, sf, "documents"), "doc_id", "text", filing_chunks)


@query()
def recursive_chunker(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.operators.chunking import chunked, split_recursively

    return chunked(table(spark, sf, "documents"), "doc_id", "text", lambda x: [(p, False) for p in split_recursively(x)])


@query()
def segmenter(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.operators.chunking import chunked, segments, table_marks

    return chunked(table(spark, sf, "documents"), "doc_id", "text", lambda x: [(p, table_marks(p)) for p in segments(x)])


@query(f"""WITH RECURSIVE {CHUNKS_SQL}, placed AS (SELECT doc_id, text, len({WORDS.format(x='text')}) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM chunks),
walk AS (SELECT doc_id, i, text, n AS held, 0 AS chunk FROM placed WHERE i = 1
UNION ALL SELECT p.doc_id, p.i, p.text, CASE WHEN held + n >= 600 THEN n ELSE held + n END, CASE WHEN held + n >= 600 THEN chunk + 1 ELSE chunk END FROM walk w JOIN placed p ON p.doc_id = w.doc_id AND p.i = w.i + 1)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk_pos, string_agg(text, chr(10) ORDER BY i) AS chunk_text FROM walk GROUP BY doc_id, chunk""")
def block_chunker(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.operators.chunking import greedy_blocks

    return greedy_blocks(chunks(spark, sf), "doc_id", "pos", "text")


@query(f"""WITH {CHUNKS_SQL}, ids AS (SELECT doc_id, 'doc_' || doc_id || '_chunk_1' AS a, 'none' AS b, 'doc_' || doc_id || '_chunk_0' AS c FROM documents)
SELECT i.doc_id, concat_ws(' / ', x.text, z.text) AS docs FROM ids i LEFT JOIN chunks x ON a = x.chunk_id LEFT JOIN chunks z ON c = z.chunk_id""")
def doc_texts_ordered(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.operators.evaluation import ordered_texts

    name = lambda k: F.concat(F.lit("doc_"), "doc_id", F.lit(f"_chunk_{k}"))
    ids = table(spark, sf, "documents").select("doc_id", F.array(name(1), F.lit("none"), name(0)).alias("chunk_ids"))
    return ordered_texts(ids, chunks(spark, sf), "doc_id").select("doc_id", F.array_join("docs", " / ").alias("docs"))


@query("""SELECT w, CASE WHEN regexp_matches(w, '^\\d+$') THEN w ELSE cik END AS cik FROM (SELECT CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE 'cust' || c_custkey END AS w FROM customer)
LEFT JOIN (SELECT 'CUST' || c_custkey AS symbol, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik FROM customer WHERE c_custkey % 3 = 0) ON upper(w) = symbol WHERE regexp_matches(w, '^\\d+$') OR cik IS NOT NULL""")
def ticker_to_cik(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.sources.tables import resolve_ciks

    custkey = F.col("c_custkey").cast("string")
    wanted = table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 5 == 0, custkey).otherwise(F.concat(F.lit("cust"), custkey)).alias("w"))
    known = table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("CUST"), custkey).alias("Symbol"), t.padded_cik(custkey).alias("CIK"))
    return resolve_ciks(wanted, known, "w")


@query("""SELECT o_orderkey || '' AS CIK, 'x' || o_custkey AS Company, 'd/' || o_orderkey || '-index.html' AS html_index FROM orders WHERE o_orderkey % 4 <> 0""")
def master_index(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.sources.tables import parse_master_index

    good = F.concat_ws("|", F.col("o_orderkey"), F.concat(F.lit("x"), F.col("o_custkey")), F.lit("10-K"), F.lit("2020-01-01"), F.concat(F.lit("d/"), F.col("o_orderkey"), F.lit(".txt")))
    lines = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 4 == 0, F.lit("CIK|Company|Type|Date|Filename")).otherwise(good).alias("value"))
    return parse_master_index(lines).select("CIK", "Company", "html_index")


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'files/p' || page_id || '.pdf' END AS link FROM pages""")
def pdf_links(spark: SparkSession, sf: str) -> DataFrame:
    html = F.when(F.col("page_id") % 2 == 0, F.concat("html", F.lit("<a HREF='files/p"), F.col("page_id"), F.lit(".pdf'>x</a><a href=\"b.pdf\">")))
    return table(spark, sf, "pages").select("page_id", t.pdf_link(F.coalesce(html, F.regexp_replace("html", r"\.pdf", ""))).alias("link"))


# Reports around each document's text: plain; with contents; without part I; part I in the contents only; two of each, the first longer.
_FILED = """CASE doc_id % 5 WHEN 0 THEN 'PART I. Figures' || chr(10) || text || ' end.' || chr(10) || 'PART II. Other' || chr(10) || 'none'
WHEN 1 THEN 'PART I. x' || chr(10) || 'PART II. y' || chr(10) || 'PART I. Figures ' || text || ' end.' || chr(10) || 'PART II. Other'
WHEN 2 THEN text || ' end.' || chr(10) || 'Part II. Other' || chr(10) || 'none'
WHEN 3 THEN 'PART I. Figures' || chr(10) || 'PART II. Other' || chr(10) || text || chr(10) || 'PART II. Other end.'
ELSE 'PART I. Figures are long here' || chr(10) || 'PART II. Other' || chr(10) || text || chr(10) || 'PART I. a' || chr(10) || 'PART II. end.' END"""


@query(f"""WITH filed AS (SELECT doc_id, doc_id % 5 AS v, coalesce(text, '') AS text FROM documents), whole AS (SELECT doc_id, v, text, {_FILED} AS x FROM filed),
cut AS (SELECT *, CASE v WHEN 0 THEN 'PART II. Other' || chr(10) || 'none' WHEN 1 THEN 'PART II. Other' WHEN 2 THEN 'Part II. Other' || chr(10) || 'none'
WHEN 3 THEN 'PART II. Other' || chr(10) || text || chr(10) || 'PART II. Other end.' ELSE 'PART II. Other' || chr(10) || text || chr(10) || 'PART I. a' || chr(10) || 'PART II. end.' END AS long FROM whole),
parts AS (SELECT *, CASE WHEN v = 4 AND length(long) - 30 > 5000 THEN 'PART II. end.' ELSE long END AS part_2,
CASE v WHEN 0 THEN 'PART I. Figures' || chr(10) || text || ' end.' WHEN 1 THEN 'PART I. Figures ' || text || ' end.' WHEN 2 THEN '' WHEN 3 THEN 'PART I. Figures' ELSE CASE WHEN length(long) - 30 > 5000 THEN regexp_replace(substr(x, 1, length(x) - 28), '\\s+$', '') ELSE 'PART I. Figures are long here' END END AS part_1 FROM cut)
SELECT doc_id, CAST(length(part_1) AS INTEGER) AS n_1, sha1(part_1) AS h_1, CAST(length(part_2) AS INTEGER) AS n_2, sha1(part_2) AS h_2 FROM parts""")
def quarterly_repairs(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.operators.filings import quarterly

    x, v, nl = F.coalesce("text", F.lit("")), F.col("doc_id") % 5, F.lit("\n")
    filed = (
        F.when(v == 0, F.concat(F.lit("PART I. Figures\n"), x, F.lit(" end.\nPART II. Other\nnone")))
        .when(v == 1, F.concat(F.lit("PART I. x\nPART II. y\nPART I. Figures "), x, F.lit(" end.\nPART II. Other")))
        .when(v == 2, F.concat(x, F.lit(" end.\nPart II. Other\nnone")))
        .when(v == 3, F.concat(F.lit("PART I. Figures\nPART II. Other\n"), x, nl, F.lit("PART II. Other end.")))
        .otherwise(F.concat(F.lit("PART I. Figures are long here\nPART II. Other\n"), x, nl, F.lit("PART I. a\nPART II. end.")))
    )
    parts = quarterly(table(spark, sf, "documents").select("doc_id", filed.alias("content")), "doc_id", "content")
    return parts.select("doc_id", F.length("part_1").alias("n_1"), F.sha1("part_1").alias("h_1"), F.length("part_2").alias("n_2"), F.sha1("part_2").alias("h_2"))


_SITE = "regexp_extract(url, '^[a-z]+://[^/?#]+', 0)"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)"


@query(f"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN {_SITE} || CASE WHEN contains({_PATH}, '/') THEN regexp_replace({_PATH}, '[^/]*$', '') ELSE '/' END || 'files/p' || page_id || '.pdf' WHEN 1 THEN {_SITE} || '/root/p.PDF' WHEN 2 THEN 'https://other.org/x.pdf' END AS link FROM pages""")
def pdf_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Links on pages, relative ones joined to the page's address."""
    k, plain = F.col("page_id") % 4, F.regexp_replace("html", r"(?i)\.pdf", "")
    tag = F.when(k == 0, F.concat(F.lit("<a href='files/p"), F.col("page_id"), F.lit(".pdf'>x</a>"))).when(k == 1, F.lit('<a HREF="/root/p.PDF">y</a>')).when(k == 2, F.lit("<a href='https://other.org/x.pdf'>z</a>")).otherwise(F.lit("<a href='p.html'>"))
    return table(spark, sf, "pages").select("page_id", t.joined_url(F.col("url"), t.pdf_link(F.concat(tag, plain))).alias("link"))


@query("""SELECT 'S' || c_custkey AS "Symbol", c_name AS "Security", c_mktsegment AS "GICS_Sector", 'sub ' || c_nationkey AS "GICS_SubIndustry", CASE WHEN c_custkey % 7 = 0 THEN 'n/a ' || c_custkey ELSE lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(10, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') END AS "CIK" FROM customer""")
def company_columns(spark: SparkSession, sf: str) -> DataFrame:
    """A company table under other column names, with blanks around its values."""
    from lodestone.operators.tables import company_table

    key = F.col("c_custkey").cast("string")
    odd = table(spark, sf, "customer").select(
        F.concat(F.lit(" S"), key).alias("Ticker symbol"), F.concat("c_name", F.lit("  ")).alias("The company's name"), F.col("c_mktsegment").alias("GICS sector (2020)"),
        F.concat(F.lit("sub "), "c_nationkey").alias("Industry"), F.col("c_acctbal").alias("Headquarters"), F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("n/a "), key)).otherwise(F.concat(F.lit(" "), key)).alias("CIK number"))
    return company_table(odd)


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS "CIK", 'Company é ' || o_custkey AS "Company", '10-K' AS "Type", 'edgar/' || o_orderkey || '.txt' AS complete_text_file_link, 'edgar/' || o_orderkey || '-index.html' AS html_index FROM orders""")
def master_archives(spark: SparkSession, sf: str) -> DataFrame:
    """Index archives, each of about a thousand lines behind eleven header lines, unpacked and parsed."""
    from lodestone.sources.tables import archive_lines, parse_master_index, zipped_lines

    line = F.concat_ws("|", F.col("o_orderkey"), F.concat(F.lit("Company é "), "o_custkey"), F.lit("10-K"), F.lit("2020-01-01"), F.concat(F.lit("edgar/"), "o_orderkey", F.lit(".txt")))
    part = F.expr("o_orderkey div 4000")
    archives = table(spark, sf, "orders").groupBy(part.alias("part")).agg(F.collect_list(line).alias("lines"))  # at most 4,000 lines
    packed = archives.select(zipped_lines("master.idx", 11)("lines").alias("content"))
    return parse_master_index(archive_lines(packed, "master.idx", 11)).select("CIK", "Company", "Type", "complete_text_file_link", "html_index")


@query()
def item_sections(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.operators.filings import extracted

    body = F.concat(F.lit("\nItem 1. Business\n"), "text", F.lit("\nItem 7. Management\n"), "text", F.lit("\nItem 8. Statements\nnone\nSIGNATURES\nend"))
    rows = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("filename"), F.lit("10-K").alias("type"), F.lit("2020-02-03").alias("filing_date"), body.alias("content"))
    return extracted(rows).select("filename", F.length(F.col("sections")["item_1"]).alias("n_1"), F.length(F.col("sections")["item_7"]).alias("n_7"), F.col("sections")["SIGNATURE"].alias("signature"))
