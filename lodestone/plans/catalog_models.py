"""Queries whose columns come from models: stand-ins reply by rule, and SQL says what they would reply."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import prompts as p
from lodestone.functions import text as t
from lodestone.operators import backends
from lodestone.operators import graph as g
from lodestone.plans import standins
from lodestone.plans.catalog_graph import _ARMS, _CHAIN2, _CHAIN3, _STARS, EDGES, ITEMS, _edges
from lodestone.plans.catalog_text import CHUNKS_SQL, QA_SQL
from lodestone.plans.views import chunks, items, qa

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query(f"""WITH {QA_SQL}, graded AS (SELECT record_id, row_number() OVER (ORDER BY sha1('42|' || record_id)) - 1 AS place, length(question) AS q, length(answer) AS a FROM qa),
good AS (SELECT *, row_number() OVER (ORDER BY place) AS nth FROM graded WHERE q % 11 <> 0 AND 1 + q % 5 > 2 AND 1 + a % 5 > 2 AND 1 + (q + a) % 5 > 2)
SELECT record_id, 'conversations_' || lpad(CAST(place AS VARCHAR), CAST(greatest(6, length(CAST(place AS VARCHAR))) AS INTEGER), '0') AS id, CAST(1 + q % 5 AS INTEGER) AS clarity, CAST(1 + a % 5 AS INTEGER) AS answerability, CAST(1 + (q + a) % 5 AS INTEGER) AS reasoning FROM good WHERE nth <= 20""")
def quality_early_stop(spark: SparkSession, sf: str) -> DataFrame:
    """Grading in shuffled order until 20 questions are accepted: the others are never graded."""
    from lodestone.operators.early_stop import accepted_until

    grade = lambda rows: backends.graded(rows, standins.grader)
    kept = accepted_until(qa(spark, sf).select("record_id", "question", "answer"), F.col("record_id"), grade, g.gate(F.col("scores")), 20, least=50)
    return kept.select("record_id", t.build_id(F.lit("conversations"), t.padded_number(F.col("place"))).alias("id"), *(F.col("scores")[d].alias(d) for d in backends.MULTI_HOP))


_MIXED = "CAST('0x' || substr(sha1('42|{r}|' || {x}), 1, 8) AS BIGINT) & mask"
_DRAWN = f"""space AS (SELECT CAST(sum(pairs) AS BIGINT) AS total FROM tails), sized AS (SELECT total, CAST((SELECT min(h) FROM range(1, 32) t(h) WHERE 4 ** h >= total) AS BIGINT) AS half FROM space),
f0 AS (SELECT total, half, (1 << half) - 1 AS mask, i, i >> half AS l, i & ((1 << half) - 1) AS r FROM sized, range(0, 1 << (2 * half)) t(i)),
f1 AS (SELECT * REPLACE (r AS l, xor(l, {_MIXED.format(r=0, x='r')}) AS r) FROM f0), f2 AS (SELECT * REPLACE (r AS l, xor(l, {_MIXED.format(r=1, x='r')}) AS r) FROM f1),
f3 AS (SELECT * REPLACE (r AS l, xor(l, {_MIXED.format(r=2, x='r')}) AS r) FROM f2), f4 AS (SELECT * REPLACE (r AS l, xor(l, {_MIXED.format(r=3, x='r')}) AS r) FROM f3),
drawn AS (SELECT (l << half) + r AS number FROM f4 WHERE (l << half) + r < total ORDER BY i LIMIT 300)"""


@query(f"""WITH {EDGES}, tails AS (SELECT v, count(*) * (count(*) - 1) // 2 AS pairs FROM valid GROUP BY 1 HAVING count(*) > 1),
spans AS (SELECT v, sum(pairs) OVER (ORDER BY sha1('42|g|' || v)) - pairs AS low, pairs FROM tails),
hops AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY sha1('42|' || u)) - 1 AS n FROM valid), {_DRAWN},
hits AS (SELECT v, CAST(number - low AS BIGINT) AS q FROM drawn JOIN spans ON number >= low AND number < low + pairs),
pairs AS (SELECT h.v, a.tid AS x, b.tid AS y, (a.u_seq, a.edge_seq) < (b.u_seq, b.edge_seq) AS before FROM hits h JOIN hops a ON a.v = h.v JOIN hops b ON b.v = h.v AND a.n < b.n AND b.n * (b.n - 1) // 2 + a.n = q)
SELECT 'inverted_star_shaped' AS pattern, ids, sha1(ids) AS path_sha1 FROM (SELECT CASE WHEN before THEN x || ',' || y ELSE y || ',' || x END AS ids FROM pairs)""")
def inverted_star_sample(spark: SparkSession, sf: str) -> DataFrame:
    """300 of the pairs, drawn by number."""
    from lodestone.operators.sampling import sampled_pairs

    paths = sampled_pairs(_edges(spark, sf)[0], 300)
    return paths.select("pattern", F.array_join(F.transform("path", lambda h: h["triplet_id"]), ",").alias("ids"), "path_sha1")


@query(f"""WITH {EDGES}, {_ARMS}, paths AS (SELECT 'chained_multi_hop' AS pattern, ids FROM ({_CHAIN2} UNION ALL {_CHAIN3}) UNION ALL SELECT 'star_shaped', ids FROM ({_STARS}))
SELECT pattern, ids FROM paths QUALIFY row_number() OVER (PARTITION BY pattern ORDER BY sha1('42|' || sha1(ids))) <= 200""")
def pattern_samples(spark: SparkSession, sf: str) -> DataFrame:
    """At most 200 chains and stars in a seeded order."""
    from lodestone.operators.sampling import sampled_paths

    valid = _edges(spark, sf)[0]
    paths = sampled_paths(g.chains(valid).unionByName(g.stars(valid)), 200)
    return paths.select("pattern", F.array_join(F.transform("path", lambda h: h["triplet_id"]), ",").alias("ids"))


@query(f"""WITH {CHUNKS_SQL}, placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM chunks),
told AS (SELECT doc_id, i // 5 AS grp, sum(length(text)) % 13 = 0 AS broken FROM placed GROUP BY ALL), lost AS (SELECT doc_id FROM told WHERE broken)
SELECT doc_id, CAST(i AS BIGINT) AS seq, split_part(text, ' ', 1) AS entity_1, 'runs to' AS relation, split_part(text, ' ', -1) AS entity_2, split_part(text, '. ', 1) AS source_sentence, 'domain=economics,file_name=' || doc_id || ',file_type=,file_country=' || lang || ',file_year=' AS about
FROM placed WHERE i < 20 AND doc_id NOT IN (SELECT doc_id FROM lost)""")
def model_triplets(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of five chunks a prompt until a document has 20; of the metadata five keys stay."""
    about = F.create_map(F.lit("domain"), F.lit("economics"), F.lit("file_name"), F.col("doc_id").cast("string"), F.lit("file_country"), F.col("lang"), F.lit("source"), F.col("source"))
    own = chunks(spark, sf).withColumn("metadata", about)
    found = backends.raw_triplets(own, standins.extractor, target=20, keys=backends.ECONOMICS)
    listed = F.array_join(F.array(*(F.concat(F.lit(f"{k}="), F.col("metadata")[k]) for k in backends.ECONOMICS)), ",")
    return found.select("doc_id", "seq", "entity_1", "relation", "entity_2", "source_sentence", listed.alias("about"))


@query(f"""WITH {EDGES}, pairs AS (SELECT DISTINCT a.tid || ',' || b.tid AS ids, a.u AS head, a.v AS middle, b.v AS tail FROM valid a JOIN valid b ON a.v = b.u),
told AS (SELECT *, 'Where does ' || head || ' end' || CASE WHEN length(head) % 3 = 0 THEN ' after ' || middle || '?' ELSE '?' END AS question FROM pairs WHERE length(head) % 7 <> 0)
SELECT ids, question, tail AS answer FROM told WHERE NOT contains(question, tail) AND NOT contains(question, middle)""")
def model_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions on two hops, without those that name their answer or what lies between."""
    paths = g.chains(_edges(spark, sf)[0], 2)
    prompt = p.filled("multi_hop", pattern=F.col("pattern"), facts=p.facts_listed(F.col("path")), metadata=F.lit(""), text=F.lit(""))
    made = backends.questions(paths.withColumn("prompt", prompt).withColumn("pivots", g.pivots(F.col("path"), F.col("pattern"))), standins.asker)
    kept = made.where(g.question_holds(F.col("question"), F.col("answer"), F.col("pivots"), F.lit(True)))
    return kept.select(F.array_join(F.transform("path", lambda h: h["triplet_id"]), ",").alias("ids"), "question", "answer")


_E = "length({x}) - length(replace({x}, 'e', ''))"


@query(f"""WITH {QA_SQL}, tries AS (SELECT record_id, 'as query: ' || question AS q, question || repeat(' else', CAST(k AS INTEGER)) AS candidate, k FROM qa, range(1, 4) t(k)),
scored AS (SELECT *, CAST((length(q) % 17) * (length(candidate) % 17) + ({_E.format(x='q')}) * ({_E.format(x='candidate')}) AS DOUBLE) AS similarity FROM tries)
SELECT record_id, candidate, similarity FROM scored QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY similarity DESC, k) = 1""")
def model_rewrites(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest of three candidates, by the dot product of embeddings."""
    from lodestone.operators.perturb import best_candidates

    tries = backends.rewritten(qa(spark, sf).select("record_id", "question"), standins.rewriter, lambda n: F.concat(F.lit("try "), n.cast("string")))
    return best_candidates(backends.similarity(tries, "question", "candidate", standins.embedder, "as query: "), ["record_id"], None)


@query(f"WITH {QA_SQL} SELECT record_id, replace(replace(answer, 'e', 'é'), 'a', 'á') AS back_translation FROM qa")
def model_back_translation(spark: SparkSession, sf: str) -> DataFrame:
    texts = qa(spark, sf).select("record_id", F.col("answer").alias("text"))
    return backends.translated_back(texts, standins.translator, standins.translator).select("record_id", "back_translation")


@query(f"""WITH {ITEMS}, told AS (SELECT i.*, split_part(CASE WHEN doc_variant_type = 'lexical-similar-no-answer-docs' THEN left(answer, 5) ELSE answer END, chr(10) || chr(10), 1) AS doc FROM items i)
SELECT item_id, CASE WHEN doc_variant_type = 'empty' THEN 'no such info' ELSE ({_E.format(x='doc').replace("'e'", "' '")}) || ' blanks' END AS response FROM told""")
def model_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Every work item answered, two batches at a time in a task."""
    return backends.answered(items(spark, sf), standins.answerer).select("item_id", "response")
