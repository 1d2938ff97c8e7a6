"""Queries on facts, chunks, headers and questions, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import prompts as p
from lodestone.functions import text as t
from lodestone.operators import graph as g
from lodestone.operators import records as rec
from lodestone.plans.catalog_graph import EDGES
from lodestone.plans.catalog_text import CHUNKS_SQL, QA_SQL, TRIMMED
from lodestone.plans.views import chunks, qa, table, triplets

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_LOWERED = TRIMMED.format(x="lower({x})")


@query(f"""WITH {CHUNKS_SQL},
raw AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS idx, source, lang, text,
CASE WHEN pos % 4 = 3 THEN '' WHEN pos % 5 = 4 THEN 'no chunk says this' ELSE split_part(text, '. ', 1) END AS sentence FROM chunks),
held AS (SELECT doc_id, chunk_id, pos, {_LOWERED.format(x='text')} AS t FROM chunks),
asked AS (SELECT *, {_LOWERED.format(x='sentence')} AS s FROM raw WHERE trim(sentence) <> ''),
found AS (SELECT r.doc_id, idx, arg_min(chunk_id, h.pos) AS answer_chunk_id FROM asked r JOIN held h ON r.doc_id = h.doc_id AND contains(h.t, r.s) GROUP BY 1, 2)
SELECT r.doc_id, 'policy_' || r.doc_id || '_triplet_' || idx AS triplet_id, lower(source) AS entity_1, CASE WHEN lang = 'en' THEN 'written in english' ELSE 'written in ' || lang END AS relation,
CAST(length(text) AS VARCHAR) || ' signs' AS entity_2, answer_chunk_id, sentence AS source_sentence, CAST(idx AS BIGINT) AS seq FROM raw r JOIN found USING (doc_id, idx)""")
def process_triplets(spark: SparkSession, sf: str) -> DataFrame:
    own = chunks(spark, sf)
    sentence = F.when(F.col("pos") % 4 == 3, "").when(F.col("pos") % 5 == 4, "no chunk says this").otherwise(F.substring_index("text", ". ", 1))
    meta = F.create_map(F.lit("domain"), F.lit("policy"), F.lit("file_name"), F.col("doc_id").cast("string"))
    raw = own.select("doc_id", F.col("pos").alias("seq"), rec.triplet_prefix("policy", meta).alias("prefix"), F.concat("source", F.lit(", Inc.")).alias("entity_1"), F.concat(F.lit("Written in "), F.upper("lang")).alias("relation"),
                     F.concat(F.length("text").cast("string"), F.lit("  Signs Co.")).alias("entity_2"), sentence.alias("source_sentence"), meta.alias("metadata"))
    names = table(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").alias("scope"), F.lit("written in en").alias("relation"), F.lit("written in english").alias("leader"))
    return rec.processed_triplets(raw, own, names).drop("metadata")


@query(f"""WITH {CHUNKS_SQL}, first AS (SELECT doc_id, arg_min(CASE WHEN text LIKE '%|%' THEN '' ELSE left(text, 1) END, pos) AS k FROM chunks GROUP BY 1)
SELECT CASE WHEN k = '' THEN 'unknown' ELSE k END AS "group", count(*) AS n, count(DISTINCT doc_id) AS files FROM chunks JOIN first USING (doc_id) GROUP BY 1""")
def group_by_first_key(spark: SparkSession, sf: str) -> DataFrame:
    key = F.when(~F.contains("text", F.lit("|")), F.left("text", F.lit(1)))
    return rec.keyed_by_first(chunks(spark, sf), "doc_id", "pos", key).groupBy("group").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("files"))


@query("SELECT c_mktsegment AS \"group\", count(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1")
def group_by_row_key(spark: SparkSession, sf: str) -> DataFrame:
    return rec.keyed_by_row(table(spark, sf, "customer"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))).groupBy("group").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment AS sector, string_agg(c_name, ',' ORDER BY c_custkey) AS companies FROM customer GROUP BY 1")
def companies_by_sector(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("sector"), F.col("c_name").alias("name"), F.col("c_custkey").alias("seq"))
    return rec.companies_by_sector(own, "sector", "name", "seq").select("sector", F.array_join("companies", ",").alias("companies"))


@query("""WITH first AS (SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS plan, min(o_orderkey) AS o FROM orders GROUP BY 1)
SELECT CAST(doc_id AS VARCHAR) AS id, source, plan FROM documents JOIN first ON o_custkey = doc_id""")
def policy_metadata(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    records = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("plan"))
    return rec.with_metadata(files, records, "id", "seq").select("id", "source", F.col("record.plan").alias("plan"))


@query("""SELECT n_name AS file, n_name || ' ' || (2000 + n_nationkey) AS header, CAST(2000 + n_nationkey AS VARCHAR) AS year, n_name AS country FROM nation WHERE n_nationkey % 4 <> 0 AND n_nationkey % 5 <> 0""")
def survey_header(spark: SparkSession, sf: str) -> DataFrame:
    name, key = F.col("n_name"), F.col("n_nationkey")
    year = F.when(key % 5 == 0, "last year").otherwise((key + 2000).cast("string"))
    head = F.when(key % 4 != 0, F.concat(F.lit("OECD Economic Surveys: "), name, F.lit(" "), year, F.lit(": overview 1999")))
    later = F.when(key % 4 != 0, F.concat(F.lit("see OECD Economic Surveys: Atlantis 1900")))
    lines = table(spark, sf, "nation").select(name.alias("file"), F.posexplode(F.array(F.lit("cover 1998"), head, later)).alias("pos", "text"))
    return rec.survey_headers(lines, "file", "pos", "text")


@query("""WITH ids AS (SELECT l_orderkey AS record_id, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) SELECT record_id, n FROM ids WHERE n > 1""")
def many_chunks(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("record_id")).agg(F.collect_set("l_partkey").alias("answer_chunk_ids"))  # an order has at most seven lines
    return rec.spread_over_chunks(ids).select("record_id", F.size("answer_chunk_ids").cast("long").alias("n"))


@query(f"""WITH {CHUNKS_SQL} SELECT chunk_id FROM chunks WHERE pos % 2 = 0 AND lang <> 'de'""")
def chunk_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    cik = F.when(F.col("pos") % 2 == 0, F.col("source")).otherwise("")
    meta = F.create_map(F.lit("cik"), cik, F.lit("filing_date"), F.when(F.col("lang") != "de", F.col("lang")))
    return rec.eligible(chunks(spark, sf).withColumn("metadata", meta)).select("chunk_id")


@query(f"""WITH {CHUNKS_SQL}, own AS (SELECT doc_id, 'doc_' || doc_id || '_chunk_1' AS a, 'doc_' || doc_id || '_chunk_0' AS b, doc_id % 3 AS k FROM documents),
ids AS (SELECT doc_id, 0 AS pos, a AS chunk_id FROM own WHERE k <> 2 UNION ALL SELECT doc_id, 1, b FROM own WHERE k <> 2),
texts AS (SELECT i.doc_id, string_agg('<' || c.text || '>', ' / ' ORDER BY i.pos) AS t FROM ids i JOIN chunks c USING (chunk_id) GROUP BY 1)
SELECT o.doc_id AS record_id, CASE WHEN k <> 2 THEN coalesce(t, '') END AS back_translation, CASE WHEN k = 0 THEN 'made of ' || a || ' for s' || (o.doc_id % 2) WHEN k = 1 THEN '' END AS regex_delete FROM own o LEFT JOIN texts USING (doc_id)""")
def perturbed_join_back(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.operators.perturb import needed

    own = chunks(spark, sf)
    key = F.col("doc_id") % 3
    pair = F.array(*(F.concat(F.lit("doc_"), "doc_id", F.lit(f"_chunk_{i}")) for i in (1, 0)))
    asks = table(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), key.alias("k"), F.when(key == 2, F.array().cast("array<string>")).otherwise(pair).alias("answer_chunk_ids"), F.array(F.concat(F.lit("s"), F.col("doc_id") % 2)).alias("source_sentences"))
    ids, pairs = needed(asks)
    by_chunk = ids.join(own, "chunk_id").select("chunk_id", F.concat(F.lit("<"), "text", F.lit(">")).alias("text"))
    made = F.array(F.concat(F.lit("made of "), F.col("answer_chunk_ids")[0], F.lit(" for "), F.col("source_sentences")[0]))
    known = asks.where("k = 0").select("answer_chunk_ids").distinct()
    by_pair = pairs.where(F.size("answer_chunk_ids") > 0).join(known, "answer_chunk_ids", "left_semi").select("answer_chunk_ids", "source_sentences", made.alias("docs"))
    out = rec.documents_joined_back(asks, by_chunk, by_pair)
    return out.select("record_id", F.array_join("back_translation", " / ").alias("back_translation"), F.array_join("regex_delete", " / ").alias("regex_delete"))


@query("SELECT c_custkey AS id, 'https://files.example.org/plans/' || c_custkey || '.pdf' AS url FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def url_template(spark: SparkSession, sf: str) -> DataFrame:
    ids, present = table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return rec.missing_files(ids, present, "https://files.example.org/plans/%s.pdf")


_BLOCK = "CASE pos % 4 WHEN 0 THEN 'Table of ' || left(text, 20) WHEN 1 THEN left(text, 40) ELSE text END"


@query(f"""WITH {CHUNKS_SQL}, blocks AS (SELECT doc_id, pos, CASE WHEN pos % 4 = 2 THEN 'table' ELSE 'text' END AS type, {_BLOCK} AS text FROM chunks),
usable AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n, type = 'text' AND length(text) <= 100 AS ok FROM blocks),
tables AS (SELECT doc_id, pos, n FROM usable WHERE type = 'table'),
walls AS (SELECT t.doc_id, t.pos, t.n, coalesce(max(u.n), 0) AS wall FROM tables t LEFT JOIN usable u ON u.doc_id = t.doc_id AND u.n < t.n AND NOT u.ok GROUP BY ALL),
heads AS (SELECT w.doc_id, w.pos, w.n, max(u.n) AS head FROM walls w JOIN usable u ON u.doc_id = w.doc_id AND u.n > w.wall AND u.n < w.n AND contains(u.text, 'Table') GROUP BY ALL),
captions AS (SELECT h.doc_id, h.pos, string_agg(u.text, ' ' ORDER BY u.n) AS caption FROM heads h JOIN usable u ON u.doc_id = h.doc_id AND u.n >= h.head AND u.n < h.n GROUP BY 1, 2)
SELECT t.doc_id, t.pos, caption FROM tables t LEFT JOIN captions c ON c.doc_id = t.doc_id AND c.pos = t.pos""")
def table_captions(spark: SparkSession, sf: str) -> DataFrame:
    place = F.col("pos") % 4
    text = F.when(place == 0, F.concat(F.lit("Table of "), F.left("text", F.lit(20)))).when(place == 1, F.left("text", F.lit(40))).otherwise(F.col("text"))
    blocks = chunks(spark, sf).select("doc_id", "pos", F.when(place == 2, "table").otherwise("text").alias("type"), text.alias("text"))
    return rec.caption_above(blocks, "doc_id", "pos").where("type = 'table'").select("doc_id", "pos", "caption")


@query("SELECT 'data/' || n_name || '.json' AS file, n_name AS domain FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)")
def dataset_domains(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation")
    had = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("domain"))
    return rec.evaluated_domains(nation.select(F.concat(F.lit("data/"), "n_name", F.lit(".json")).alias("file")), had)


_FACT = "'Triplet ' || {x}.tid || ', Answer Chunk ID: ' || {x}.chunk || chr(58) || chr(10) || ' Entity 1: ' || {x}.u || chr(10) || ' Relation: ' || {x}.label || chr(10) || ' Entity 2: ' || {x}.v"


@query(f"""WITH {EDGES} SELECT DISTINCT a.tid || ',' || b.tid AS ids, {_FACT.format(x='a')} || chr(10) || {_FACT.format(x='b')} AS facts, '{{"entity_1":"' || a.u || '","relation":"' || a.label || '","entity_2":"' || a.v || '"}}' AS fact FROM valid a JOIN valid b ON a.v = b.u""")
def prompt_strings(spark: SparkSession, sf: str) -> DataFrame:
    facts = triplets(spark, sf)
    paths = g.chains(g.valid_edges(facts), 2)
    return paths.select(F.array_join(F.transform("path", lambda h: h["triplet_id"]), ",").alias("ids"), p.facts_listed(F.col("path")).alias("facts"), p.fact_json(F.col("path")[0]).alias("fact"))


@query(f"""WITH {QA_SQL} SELECT record_id, 'Documents:' || chr(10) || 'one' || chr(10) || 'Question: none' || chr(10) || chr(10) || 'Question: ' || question AS prompt FROM qa""")
def prompt_filled(spark: SparkSession, sf: str) -> DataFrame:
    return qa(spark, sf).select("record_id", p.filled("answer", text=F.lit("one\nQuestion: none"), question=F.col("question")).alias("prompt"))


@query("""SELECT doc_id, chr(10) || 'PART  II ' || lang || chr(10) || '  Item 7A' || chr(10) || 'SIGNATURE(s) ' || source || chr(10) || 'A part I said' || chr(10) || 'ITEM x' || chr(10) || 'signatures  end' AS text FROM documents""")
def rejoined_headings(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("\nP A R T  II "), "lang", F.lit("\n  I t em 7A\nS I G N A T U R E ( s ) "), "source", F.lit("\nA part I said\nITEM x\ns i g natures  end"))
    return table(spark, sf, "documents").select("doc_id", t.rejoin_headings(text).alias("text"))


@query("""SELECT doc_id, chr(10) || 'ITEM 1 - a "' || lang || '" b' || chr(10) || 'ITEM 2. c' AS text FROM documents""")
def cleaned_filing(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("\nI T E M 1-a “"), "lang", F.lit("”™ b\n 12 \n F-3 \nI TEM 2. c"))
    return table(spark, sf, "documents").select("doc_id", F.regexp_replace(t.clean_text(text), r"[ ]*\n[ ]*(?:\n[ ]*)*", "\n").alias("text"))


@query(f"""WITH {CHUNKS_SQL}, first AS (SELECT doc_id, arg_min(lang, pos) AS s FROM chunks GROUP BY 1) SELECT chunk_id FROM chunks JOIN first USING (doc_id) WHERE s IN ('en', 'fr')""")
def sector_of_first_chunk(spark: SparkSession, sf: str) -> DataFrame:
    own = chunks(spark, sf).withColumn("metadata", F.create_map(F.lit("GICS_Sector"), F.col("lang")))
    return rec.sectors_of_first(own, ["en", "fr"]).select("chunk_id")
