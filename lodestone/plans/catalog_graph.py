"""Queries on graphs, path patterns, retrieval and evaluation, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import evaluation as ev
from lodestone.operators import graph as g
from lodestone.plans.catalog_text import ANSWER, QA_SQL
from lodestone.plans.views import details, items, qa, responses, table, triplets

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _fact(source: str, head: str, rel: str, tail: str, kind: int, key: str, shift: int) -> str:
    return f"SELECT 'g' AS graph_id, {head} AS entity_1, '{rel}' AS relation, {tail} AS entity_2, 't{kind}_' || {key} AS triplet_id, 'chunk_' || (({key} + {shift}) % 11) AS answer_chunk_id, CAST({kind} AS BIGINT) * 100000000 + {key} AS seq FROM {source}"


_HOME = "supplier JOIN nation ON s_nationkey = n_nationkey"
TRIPLETS = "triplets AS (" + " UNION ALL ".join([
    _fact(_HOME, "s_name", "based in", "n_name", 0, "s_suppkey", 0),
    _fact(_HOME + " WHERE s_suppkey % 5 = 0", "s_name", "ships from", "n_name", 1, "s_suppkey", 5),
    _fact(_HOME, "s_name", "registered as", "'reg ' || s_name", 2, "s_suppkey", 2),
    _fact("nation JOIN region ON n_regionkey = r_regionkey", "n_name", "part of", "r_name", 3, "n_nationkey", 0),
    _fact("nation JOIN (SELECT n_nationkey AS k2, n_name AS partner FROM nation) ON k2 = (n_nationkey * 7 + 3) % 25", "n_name", "trades with", "partner", 4, "n_nationkey", 3),
]) + ")"
EDGES = f"""{TRIPLETS}, edges AS (SELECT graph_id, entity_1 AS u, entity_2 AS v, arg_max(relation, seq) AS label, arg_max(triplet_id, seq) AS triplet_id, min(seq) AS edge_seq FROM triplets GROUP BY 1, 2, 3),
ends AS (SELECT graph_id, entity_1 AS node, seq * 2 AS s FROM triplets UNION ALL SELECT graph_id, entity_2, seq * 2 + 1 FROM triplets),
nodes AS (SELECT graph_id, node, min(s) AS node_seq FROM ends GROUP BY 1, 2),
known AS (SELECT entity_1, relation, entity_2, arg_max(triplet_id, seq) AS tid, arg_max(answer_chunk_id, seq) AS chunk FROM triplets GROUP BY ALL),
valid AS (SELECT e.graph_id, u, v, label, node_seq AS u_seq, edge_seq, tid, chunk FROM edges e JOIN known ON u = entity_1 AND label = relation AND v = entity_2 JOIN nodes n ON n.node = u),
deg AS (SELECT graph_id, node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT graph_id, u AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT graph_id, v, 0, 1 FROM edges) GROUP BY 1, 2)"""


def _edges(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    facts = triplets(spark, sf)
    edge = g.ordered_edges(facts).persist()  # patterns join it with itself
    return g.valid_edges(facts, edge).persist(), edge


def _flat(paths: DataFrame) -> DataFrame:
    return paths.select("pattern", F.array_join(F.col("path")["triplet_id"], ",").alias("ids"), "path_sha1")


@query(f"WITH {EDGES} SELECT u, v, label, triplet_id, edge_seq FROM edges")
def edges_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return g.edges(triplets(spark, sf)).select("u", "v", "label", "triplet_id", "edge_seq")


@query(f"WITH {EDGES} SELECT node, node_seq, CAST(node_seq // 2 // 100000000 AS VARCHAR) AS kind FROM nodes")
def nodes_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    return g.nodes(triplets(spark, sf)).select("node", "node_seq", F.col("metadata")["kind"].alias("kind"))


@query(f"WITH {EDGES} SELECT node, out_degree, in_degree FROM deg")
def degrees(spark: SparkSession, sf: str) -> DataFrame:
    return g.degrees(g.edges(triplets(spark, sf))).select("node", "out_degree", "in_degree")


@query(f"WITH {EDGES} SELECT d.node, out_degree, CAST(row_number() OVER (ORDER BY out_degree DESC, node_seq) AS INTEGER) AS rank FROM deg d JOIN nodes n ON d.node = n.node QUALIFY rank <= 3")
def root_node(spark: SparkSession, sf: str) -> DataFrame:
    facts = triplets(spark, sf)
    return g.roots(g.edges(facts), g.nodes(facts), 3).select("node", "out_degree", "rank")


@query(f"""WITH {EDGES}, top AS (SELECT d.node FROM deg d JOIN nodes n ON d.node = n.node ORDER BY out_degree DESC, node_seq LIMIT 1)
SELECT u, v, label, triplet_id FROM edges UNION ALL SELECT node, 'hub', 'held by', NULL FROM top""")
def merge_with_hub(spark: SparkSession, sf: str) -> DataFrame:
    facts = triplets(spark, sf)
    return g.with_hub(g.edges(facts), g.nodes(facts), "hub", "held by", "all").select("u", "v", "label", "triplet_id")


@query(f"WITH {EDGES} SELECT 'single_hop' AS pattern, tid AS ids, sha1(tid) AS path_sha1 FROM valid JOIN deg ON v = node WHERE out_degree = 0 AND in_degree = 1")
def single_hop(spark: SparkSession, sf: str) -> DataFrame:
    valid, edge = _edges(spark, sf)
    return _flat(g.single_hop(valid, edge))


_CHAIN2 = "SELECT DISTINCT a.tid || ',' || b.tid AS ids, a.chunk <> b.chunk AS apart FROM valid a JOIN valid b ON a.v = b.u"
_CHAIN3 = "SELECT DISTINCT a.tid || ',' || b.tid || ',' || c.tid AS ids, a.chunk <> b.chunk AND b.chunk <> c.chunk AND a.chunk <> c.chunk AS apart FROM valid a JOIN valid b ON a.v = b.u JOIN valid c ON b.v = c.u"


@query(f"WITH {EDGES} SELECT 'chained_multi_hop' AS pattern, ids, sha1(ids) AS path_sha1 FROM ({_CHAIN2})")
def chain_2(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(g.chains(_edges(spark, sf)[0], 2))


@query(f"WITH {EDGES} SELECT 'chained_multi_hop' AS pattern, ids, sha1(ids) AS path_sha1 FROM ({_CHAIN3})")
def chain_3(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(g.chains(_edges(spark, sf)[0], 3).where(F.size("path") == 3))


@query(f"WITH {EDGES} SELECT 'chained_multi_hop' AS pattern, ids, sha1(ids) AS path_sha1 FROM ({_CHAIN2} UNION ALL {_CHAIN3})")
def chain_all(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(g.chains(_edges(spark, sf)[0]))


_ARMS = "arms AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY edge_seq) AS n FROM valid QUALIFY n <= 4)"
_STARS = """SELECT a.tid || ',' || b.tid AS ids FROM arms a JOIN arms b ON a.u = b.u AND a.n < b.n
UNION SELECT a.tid || ',' || b.tid || ',' || c.tid FROM arms a JOIN arms b ON a.u = b.u AND a.n < b.n JOIN arms c ON a.u = c.u AND b.n < c.n
UNION SELECT a.tid || ',' || b.tid || ',' || c.tid || ',' || d.tid FROM arms a JOIN arms b ON a.u = b.u AND a.n < b.n JOIN arms c ON a.u = c.u AND b.n < c.n JOIN arms d ON a.u = d.u AND c.n < d.n"""


@query(f"WITH {EDGES}, {_ARMS} SELECT 'star_shaped' AS pattern, ids, sha1(ids) AS path_sha1 FROM ({_STARS})")
def star_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(g.stars(_edges(spark, sf)[0]))


@query(f"WITH {EDGES} SELECT 'inverted_star_shaped' AS pattern, ids, sha1(ids) AS path_sha1 FROM (SELECT DISTINCT a.tid || ',' || b.tid AS ids FROM valid a JOIN valid b ON a.v = b.v AND (a.u_seq, a.edge_seq) < (b.u_seq, b.edge_seq))")
def inverted_star(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(g.inverted_stars(g.valid_edges(triplets(spark, sf), fields=["triplet_id"]).persist()))


@query(f"""WITH RECURSIVE {EDGES}, walk AS (SELECT u AS start, v AS "end", [u, v] AS seen, tid AS ids, 1 AS n FROM valid WHERE v > u
UNION ALL SELECT start, v, list_append(seen, v), ids || ',' || tid, n + 1 FROM walk JOIN valid ON "end" = u WHERE "end" <> start AND n < 6 AND v >= start AND (v = start OR NOT list_contains(seen, v)))
SELECT 'cycle_path' AS pattern, ids, sha1(ids) AS path_sha1 FROM walk WHERE "end" = start AND n > 2""")
def cycles(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(g.cycles(_edges(spark, sf)[0]))


@query(f"WITH {EDGES} SELECT 'chained_multi_hop' AS pattern, ids, sha1(ids) AS path_sha1 FROM ({_CHAIN2}) WHERE apart")
def distinct_chunk_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(g.distinct_chunks(g.chains(_edges(spark, sf)[0], 2)))


@query(f"""WITH {EDGES}, {_ARMS} SELECT DISTINCT a.tid || ',' || b.tid AS ids, a.v AS pivot FROM valid a JOIN valid b ON a.v = b.u
UNION ALL SELECT a.tid || ',' || b.tid, a.v FROM valid a JOIN valid b ON a.v = b.v AND (a.u_seq, a.edge_seq) < (b.u_seq, b.edge_seq)
UNION ALL SELECT * FROM ({_STARS.replace(" FROM arms a", ", a.u FROM arms a")})""")
def pivots(spark: SparkSession, sf: str) -> DataFrame:
    valid = g.slim(_edges(spark, sf)[0], "entity_1", "entity_2", "triplet_id")
    paths = g.chains(valid, 2).unionByName(g.inverted_stars(valid)).unionByName(g.stars(valid))
    return paths.select(F.array_join(F.transform("path", lambda h: h["triplet_id"]), ",").alias("ids"), F.array_join(g.pivots(F.col("path"), F.col("pattern")), "|").alias("pivot"))


@query(f"""WITH {QA_SQL} SELECT record_id, question <> '' AND answer <> '' AND NOT (turn % 2 = 0 AND (contains(question, answer) OR contains(question, 'the ') OR contains(question, 'zzz'))) AS holds FROM qa""")
def qa_validity(spark: SparkSession, sf: str) -> DataFrame:
    return qa(spark, sf).select("record_id", g.question_holds(F.col("question"), F.col("answer"), F.array(F.lit("the "), F.lit("zzz")), F.col("turn") % 2 == 0).alias("holds"))


@query("""WITH RECURSIVE v AS (SELECT CASE WHEN vec_id % 2 = 0 THEN 'large' ELSE 'label' || label END AS scope, 'r' || vec_id AS relation, vec_id, embedding AS x FROM embeddings),
placed AS (SELECT scope, relation, list_transform(x, lambda e: CAST(e AS DOUBLE)) AS x, row_number() OVER (PARTITION BY scope ORDER BY vec_id) AS i FROM v),
fold AS (SELECT scope, relation, relation AS leader, i, [{'name': relation, 'x': x}] AS held FROM placed WHERE i = 1
UNION ALL SELECT scope, relation, CASE WHEN near > 0.3 THEN held[list_position(scores, near)].name ELSE relation END, i, CASE WHEN near > 0.3 THEN held ELSE list_append(held, {'name': relation, 'x': x}) END
FROM (SELECT *, list_max(scores) AS near FROM (SELECT f.scope, p.relation, p.x, p.i, f.held, list_transform(f.held, lambda h: round(list_inner_product(h.x, p.x), 9)) AS scores FROM fold f JOIN placed p ON p.scope = f.scope AND p.i = f.i + 1)))
SELECT scope, relation, leader FROM fold""")
def relation_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Names of eleven scopes, one of which has half of them."""
    from lodestone.operators.relations import canonical

    scope = F.when(F.col("vec_id") % 2 == 0, "large").otherwise(F.concat(F.lit("label"), "label"))
    rows = table(spark, sf, "embeddings").select(scope.alias("scope"), F.concat(F.lit("r"), "vec_id").alias("relation"), F.col("embedding").alias("vector"), F.col("vec_id").alias("seq"))
    return canonical(rows, 0.3, 1024)


def _score(kind: str) -> str:
    ways = {"dot": "sum(CAST(a AS DOUBLE) * CAST(b AS DOUBLE))", "l2": "-sum((CAST(a AS DOUBLE) - CAST(b AS DOUBLE)) * (CAST(a AS DOUBLE) - CAST(b AS DOUBLE)))"}
    return f"""pairs AS (SELECT q.vec_id AS query_id, e.vec_id, unnest(q.embedding) AS a, unnest(e.embedding) AS b FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id),
scored AS (SELECT query_id, vec_id, round({ways[kind]}, 6) AS score FROM pairs GROUP BY 1, 2),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored QUALIFY rank <= 5)"""


def _top(spark: SparkSession, sf: str, metric: str = "dot") -> DataFrame:
    from lodestone.operators.retrieval import top_k

    vectors = table(spark, sf, "embeddings")
    return top_k(vectors.where("vec_id % 100 = 0"), vectors, 5, metric)


@query(f"WITH {_score('dot')} SELECT query_id, vec_id, round(score, 4) AS score, rank FROM ranked")
def vec_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf).select("query_id", "vec_id", F.round("score", 4).alias("score"), "rank")


@query(f"WITH {_score('l2')} SELECT query_id, vec_id, rank FROM ranked")
def vec_l2_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf, "l2").select("query_id", "vec_id", "rank")


@query(f"""WITH {_score('dot')} SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY vec_id % 7 DESC, rank) AS INTEGER) AS final_rank FROM ranked QUALIFY final_rank <= 3""")
def rerank_top3(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.operators.retrieval import rerank

    return rerank(_top(spark, sf).withColumn("pair", F.col("vec_id") % 7), "pair").select("query_id", "vec_id", "final_rank")


@query(f"WITH {QA_SQL} SELECT DISTINCT question FROM qa")
def dedup_queries(spark: SparkSession, sf: str) -> DataFrame:
    return qa(spark, sf).select("question").distinct()


@query(f"""WITH {_score('dot')} SELECT query_id, bool_or(e.label = q.label) AS hit FROM ranked r JOIN embeddings e ON r.vec_id = e.vec_id JOIN embeddings q ON q.vec_id = query_id GROUP BY 1""")
def hit_any(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.operators.retrieval import hit_any as hits

    vectors = table(spark, sf, "embeddings").select("vec_id", "label")
    found = _top(spark, sf).join(vectors, "vec_id").groupBy("query_id").agg(F.collect_list("label").alias("found"))  # five labels each
    truth = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.array("label").alias("truth"))
    return hits(found, truth, "query_id")


ITEMS = f"""{QA_SQL},
vars AS (SELECT record_id, unnest(['original', 'character_level', 'word_level', 'irrelevant_info', 'grammar_perturbation']) AS query_variant FROM qa),
kinds AS (SELECT record_id, 'ground-truth-docs' AS kind, NULL AS retriever FROM qa UNION ALL SELECT record_id, 'lexical-similar-no-answer-docs', NULL FROM qa WHERE turn % 3 <> 0 UNION ALL SELECT record_id, 'lexical-diff-with-answer-docs', NULL FROM qa
UNION ALL SELECT record_id, 'real-world-docs', unnest(['r0', 'r1', 'r2']) FROM qa),
items AS (SELECT concat_ws('/', record_id, query_variant, kind, coalesce(retriever, '-')) AS item_id, record_id, answer, query_variant, kind AS doc_variant_type, retriever, TRUE AS for_metric FROM qa JOIN vars USING (record_id) JOIN kinds USING (record_id)
UNION ALL SELECT concat_ws('/', record_id, 'original', 'empty', '-'), record_id, answer, 'original', 'empty', NULL, FALSE FROM qa)"""
RESPONSES = f"""{ITEMS}, keyed AS (SELECT *, (length(item_id) * 3 + ascii(right(item_id, 1)) + ascii(substr(item_id, 7, 1)) * 5 + m * 2) % 7 AS k FROM items, (SELECT unnest([1, 2]) AS m)),
replies AS (SELECT *, 'model_' || m AS model, CASE WHEN k < 2 THEN answer WHEN k = 2 THEN 'It is: ' || answer WHEN k < 5 THEN 'There is no such info.' ELSE 'quite another thing' END AS response FROM keyed),
normal AS (SELECT *, {ANSWER.format(x='response')} AS p, {ANSWER.format(x='answer')} AS t FROM replies),
judged AS (SELECT *, contains(p, t) OR contains(t, p) AS is_correct, regexp_matches(p, 'no such info|cannot find|not available|not found|no information|unable to answer|not provided|not in the context') AS refusal FROM normal),
probes AS (SELECT model, record_id, bool_or(is_correct) AS knows FROM judged WHERE NOT for_metric GROUP BY 1, 2),
flagged AS (SELECT j.*, NOT is_correct AND refusal AS returns_no_info, coalesce(knows, FALSE) AS can_answer_without FROM judged j LEFT JOIN probes USING (model, record_id) WHERE for_metric),
details AS (SELECT *, CASE WHEN can_answer_without THEN is_correct WHEN doc_variant_type IN ('ground-truth-docs', 'lexical-diff-with-answer-docs') THEN is_correct WHEN doc_variant_type = 'lexical-similar-no-answer-docs' THEN returns_no_info WHEN doc_variant_type = 'real-world-docs' THEN is_correct OR returns_no_info ELSE FALSE END AS robust FROM flagged)"""
_MEAN = "round(coalesce(avg(CAST({x} AS INT)), 0), 6)"


@query(f"WITH {ITEMS} SELECT item_id, record_id, query_variant, doc_variant_type, retriever, for_metric FROM items")
def work_items(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).select("item_id", "record_id", "query_variant", "doc_variant_type", "retriever", "for_metric")


@query(f"WITH {RESPONSES} SELECT model, record_id, bool_or(can_answer_without) AS knows FROM details GROUP BY 1, 2")
def probe_flag(spark: SparkSession, sf: str) -> DataFrame:
    return details(spark, sf).groupBy("model", "record_id").agg(F.max("can_answer_without").alias("knows"))


@query(f"WITH {RESPONSES} SELECT model, record_id, query_variant, doc_variant_type, retriever, is_correct, returns_no_info FROM details")
def judge_correct(spark: SparkSession, sf: str) -> DataFrame:
    return details(spark, sf).select("model", "record_id", "query_variant", "doc_variant_type", "retriever", "is_correct", "returns_no_info")


@query(f"WITH {RESPONSES} SELECT model, record_id, query_variant, doc_variant_type, retriever, robust, CASE WHEN length(response) > 100 THEN left(response, 100) || '...' ELSE response END AS response_preview FROM details")
def judge_robust(spark: SparkSession, sf: str) -> DataFrame:
    return details(spark, sf).select("model", "record_id", "query_variant", "doc_variant_type", "retriever", "robust", "response_preview")


_OVERALL = f"SELECT model, 'overall_robustness' AS metric, {_MEAN.format(x='robust')} AS value FROM details GROUP BY 1"
_QUERY = f"SELECT model, 'query_robustness' AS metric, {_MEAN.format(x='robust')} AS value FROM details WHERE query_variant <> 'original' AND doc_variant_type = 'ground-truth-docs' GROUP BY 1"
_DOC = f"SELECT model, 'doc_robustness' AS metric, {_MEAN.format(x='robust')} AS value FROM details WHERE query_variant = 'original' AND doc_variant_type LIKE 'lexical%' GROUP BY 1"
_REAL = f"SELECT model, CASE WHEN grouping(retriever) = 1 THEN 'real_robustness' ELSE 'real_robustness_' || retriever END AS metric, {_MEAN.format(x='robust')} AS value FROM details WHERE query_variant = 'original' AND doc_variant_type = 'real-world-docs' GROUP BY GROUPING SETS ((model, retriever), (model))"
_VARIANTS = f"SELECT model, CASE WHEN grouping(doc_variant_type) = 1 THEN 'variant_' || query_variant ELSE 'variant_doc_' || query_variant || '_' || doc_variant_type END AS metric, {_MEAN.format(x='robust')} AS value FROM details GROUP BY GROUPING SETS ((model, query_variant), (model, query_variant, doc_variant_type))"


@query(f"WITH {RESPONSES} {_OVERALL}")
def metric_overall(spark: SparkSession, sf: str) -> DataFrame:
    return ev.robustness(details(spark, sf)).where("metric = 'overall_robustness'")


@query(f"WITH {RESPONSES} {_QUERY}")
def metric_query(spark: SparkSession, sf: str) -> DataFrame:
    return ev.robustness(details(spark, sf)).where("metric = 'query_robustness'")


@query(f"WITH {RESPONSES} {_DOC}")
def metric_doc(spark: SparkSession, sf: str) -> DataFrame:
    return ev.robustness(details(spark, sf)).where("metric = 'doc_robustness'")


@query(f"WITH {RESPONSES} {_REAL}")
def metric_real(spark: SparkSession, sf: str) -> DataFrame:
    return ev.real_robustness(details(spark, sf))


@query(f"WITH {RESPONSES} {_VARIANTS}")
def metric_variants(spark: SparkSession, sf: str) -> DataFrame:
    return ev.variant_robustness(details(spark, sf))


@query(f"""WITH {RESPONSES} SELECT model, doc_variant_type, count(*) AS total, CAST(count_if(robust) AS BIGINT) AS robust, CAST(count_if(is_correct) AS BIGINT) AS correct, CAST(count_if(returns_no_info) AS BIGINT) AS no_info, CAST(count_if(NOT is_correct AND NOT returns_no_info) AS BIGINT) AS incorrect, CAST(count_if(can_answer_without) AS BIGINT) AS can_answer_without,
{_MEAN.format(x='robust')} AS robust_rate, {_MEAN.format(x='is_correct')} AS correct_rate, {_MEAN.format(x='returns_no_info')} AS no_info_rate, {_MEAN.format(x='(NOT is_correct AND NOT returns_no_info)')} AS incorrect_rate FROM details GROUP BY 1, 2""")
def analysis_by_doc(spark: SparkSession, sf: str) -> DataFrame:
    return ev.analysis(details(spark, sf))


@query(f"WITH {RESPONSES} SELECT model, CAST(count_if(knows) AS BIGINT) AS parametric FROM (SELECT model, record_id, bool_or(can_answer_without) AS knows FROM details GROUP BY 1, 2) GROUP BY 1")
def parametric_count(spark: SparkSession, sf: str) -> DataFrame:
    return ev.parametric_count(details(spark, sf))


@query(f"WITH {RESPONSES}, m AS ({_OVERALL} UNION ALL {_QUERY} UNION ALL {_DOC} UNION ALL {_REAL} UNION ALL {_VARIANTS}) SELECT metric, max(value) FILTER (model = 'model_1') AS model_1, max(value) FILTER (model = 'model_2') AS model_2 FROM m GROUP BY 1")
def metric_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return ev.pivoted(ev.robustness(details(spark, sf)), ["model_1", "model_2"])


@query(f"WITH {RESPONSES} SELECT item_id, model FROM replies WHERE NOT (k < 3 AND model = 'model_1')")
def resume_anti(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.operators.tables import anti_existing

    work = items(spark, sf)
    every = responses(work).select("item_id", "model", "response")
    key = (F.length("item_id") * 3 + F.ascii(F.right("item_id", F.lit(1))) + F.ascii(F.substring("item_id", 7, 1)) * 5 + F.substring("model", 7, 1).cast("int") * 2) % 7
    done = every.where((key < 3) & (F.col("model") == "model_1"))
    return anti_existing(every, done, ["item_id", "model"]).select("item_id", "model")


@query(f"WITH {RESPONSES} SELECT item_id, model FROM replies WHERE NOT (k < 3 AND model = 'model_1')")
def resume_progress(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of the work after two saved batches; progress of other models or another domain doesn't count."""
    from lodestone.sources.folders import shared_path
    from lodestone.sources.versioned import Progress

    root = shared_path(spark, "progress")
    every = responses(items(spark, sf)).select("item_id", "model", "response")
    key = (F.length("item_id") * 3 + F.ascii(F.right("item_id", F.lit(1))) + F.ascii(F.substring("item_id", 7, 1)) * 5 + F.substring("model", 7, 1).cast("int") * 2) % 7
    Progress(spark, root, ["model_1"], "finance").save(every)
    now = Progress(spark, root, ["model_2", "model_1"], "finance")
    for k in (0, 1):
        now.save(now.left(every).where((F.col("model") == "model_1") & ((key == 0) if k == 0 else (key < 3))))
    return now.left(every).select("item_id", "model")


@query(f"""WITH {RESPONSES}, b AS (SELECT model, CAST(regexp_extract(record_id, '_(\\d+)_', 1) AS BIGINT) // 10 AS batch, count(*) AS n, CAST(count_if(robust) AS BIGINT) AS r FROM details GROUP BY 1, 2)
SELECT model, batch, CAST(sum(n) OVER w AS BIGINT) AS seen, round(sum(r) OVER w / sum(n) OVER w, 6) AS value FROM b WINDOW w AS (PARTITION BY model ORDER BY batch ROWS UNBOUNDED PRECEDING)""")
def interim_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = details(spark, sf).withColumn("seq", F.regexp_extract("record_id", r"_(\d+)_", 1).cast("long"))
    return ev.interim(rows, "seq", 10)


@query(f"""WITH {RESPONSES}, m AS ({_OVERALL} UNION ALL {_QUERY} UNION ALL {_DOC} UNION ALL {_REAL} UNION ALL {_VARIANTS}) SELECT model, metric, value FROM m""")
def stream_eval(spark: SparkSession, sf: str) -> DataFrame:
    """The metrics of responses that came as a stream are those of the whole."""
    import uuid

    from lodestone.sources.folders import shared_folder
    from lodestone.streaming.evaluate import evaluate_stream, metrics_so_far, read_responses

    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    work = items(spark, sf)
    responses(work).write.parquet(f"{root}/in")
    half = -(-len(spark.read.parquet(f"{root}/in").inputFiles()) // 2)  # two batches
    evaluate_stream(read_responses(spark, f"{root}/in", half), work, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return metrics_so_far(spark, work, f"{root}/out")


@query(f"""WITH {RESPONSES}, m AS ({_OVERALL} UNION ALL {_QUERY} UNION ALL {_DOC} UNION ALL {_REAL} UNION ALL {_VARIANTS}) SELECT model, metric, value FROM m""")
def stream_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The metrics kept as state while responses come, probes last."""
    import uuid

    from lodestone.sources.folders import shared_folder
    from lodestone.streaming.evaluate import metrics_tracked, read_responses, track_metrics

    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    work = items(spark, sf)
    late = F.contains("item_id", F.lit("/empty/"))
    for k, part in enumerate((~late, late)):
        responses(work).where(part).write.parquet(f"{root}/in{k}")
        files = len(spark.read.parquet(f"{root}/in{k}").inputFiles())  # one batch
        track_metrics(read_responses(spark, f"{root}/in*", files), work, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return metrics_tracked(spark, f"{root}/out")


@query(f"""WITH per AS (SELECT 'g' || n_regionkey AS graph_id, s_suppkey, 'reg ' || s_name AS leaf FROM {_HOME}) SELECT graph_id, count(*) AS n FROM per GROUP BY 1""")
def single_hop_by_graph(spark: SparkSession, sf: str) -> DataFrame:
    facts = triplets(spark, sf, one_graph=False)
    edge = g.ordered_edges(facts)
    leaves = g.single_hop(g.valid_edges(facts, edge), edge).where(F.startswith(F.col("path")[0]["relation"], F.lit("registered")))
    return leaves.groupBy("graph_id").agg(F.count("*").alias("n"))


_XML = "replace(replace({x}, '&', '&amp;'), '\"', '&quot;')"


@query(f"""WITH {EDGES}, n AS (SELECT graph_id, node, node_seq, '{{"kind":"' || (node_seq // 2 // 100000000) || '"}}' AS metadata FROM nodes)
SELECT graph_id, '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">' || chr(10) || '<key id="d0" for="node" attr.name="metadata" attr.type="string"/>' || chr(10)
|| '<key id="d1" for="edge" attr.name="label" attr.type="string"/>' || chr(10) || '<key id="d2" for="edge" attr.name="triplet_id" attr.type="string"/>' || chr(10) || '<graph edgedefault="directed">' AS line FROM n GROUP BY 1
UNION ALL SELECT graph_id, '</graph></graphml>' FROM n GROUP BY 1
UNION ALL SELECT graph_id, '<node id="' || {_XML.format(x='node')} || '"><data key="d0">' || {_XML.format(x='metadata')} || '</data></node>' FROM n
UNION ALL SELECT graph_id, '<edge source="' || {_XML.format(x='u')} || '" target="' || {_XML.format(x='v')} || '"><data key="d1">' || label || '</data><data key="d2">' || triplet_id || '</data></edge>' FROM edges""")
def graphml_lines(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.sources.graphml import graphml

    facts = triplets(spark, sf)
    return graphml(g.nodes(facts), g.edges(facts)).select("graph_id", "line")


@query(f"""WITH {EDGES} SELECT 'node' AS what, node AS a, NULL AS b, '{{"kind":"' || (node_seq // 2 // 100000000) || '"}}' AS held FROM nodes
UNION ALL SELECT 'edge', u, v, label || '/' || triplet_id FROM edges""")
def graphml_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Written to files and read back."""
    from lodestone.sources.folders import shared_path
    from lodestone.sources.graphml import read_graphml, write_graphml

    facts, path = triplets(spark, sf), shared_path(spark, "graphml")
    write_graphml(g.nodes(facts), g.edges(facts), path)
    node, edge = read_graphml(spark, path)
    return node.select(F.lit("node").alias("what"), F.col("node").alias("a"), F.lit(None).cast("string").alias("b"), F.col("metadata").alias("held")).unionByName(
        edge.select(F.lit("edge").alias("what"), F.col("u").alias("a"), F.col("v").alias("b"), F.concat_ws("/", "label", "triplet_id").alias("held"))
    )


# 23 companies share the suppliers; each has a graph of its own, and a sector by its number.
_COMPANY = "CAST(regexp_extract(triplet_id, '_([0-9]+)$', 1) AS BIGINT) % 23"
_SECTOR = "CASE WHEN k < 9 THEN 'Real Estate' WHEN k < 14 THEN 'Energy' WHEN k < 16 THEN '' WHEN k < 19 THEN 'Unknown' ELSE 'Tech' END"
_MERGED = f"""{TRIPLETS}, facts AS (SELECT *, {_COMPANY} AS k FROM triplets),
ends AS (SELECT k, entity_1 AS node, seq * 2 AS s, FALSE AS tail FROM facts UNION ALL SELECT k, entity_2, seq * 2 + 1, TRUE FROM facts),
nodes AS (SELECT k, node, min(s) AS node_seq, arg_min(tail, s) AS tail FROM ends GROUP BY 1, 2),
edges AS (SELECT k, entity_1 AS u, entity_2 AS v, arg_max(relation, seq) AS label, arg_max(triplet_id, seq) AS triplet_id, min(seq) AS edge_seq FROM facts GROUP BY 1, 2, 3)"""


def _company_facts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.regexp_extract("triplet_id", "_([0-9]+)$", 1).cast("long") % 23
    return triplets(spark, sf).withColumn("graph_id", F.concat(F.lit("c"), k.cast("string"))).withColumn("metadata", F.create_map(F.lit("cik"), k.cast("string")))


def _both(node: DataFrame, edge: DataFrame) -> DataFrame:
    """Nodes and edges as rows with their attributes in one text."""
    text = F.array_join(F.transform(F.map_entries("attributes"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";").alias("held")
    return node.select("graph_id", F.col("node").alias("a"), F.lit(None).cast("string").alias("b"), text).unionByName(edge.select("graph_id", F.col("u").alias("a"), F.col("v").alias("b"), text))


_HELD = """'metadata={"cik":"' || {k} || '"}'"""


@query(f"""WITH {_MERGED}, sectors AS (SELECT k, {_SECTOR} AS sector FROM (SELECT DISTINCT k FROM facts)),
dealt AS (SELECT k, sector, (row_number() OVER (PARTITION BY sector ORDER BY k) - 1) // 4 + 1 AS batch, count(*) OVER (PARTITION BY sector) AS n FROM sectors WHERE sector <> 'Unknown'),
named AS (SELECT k, 'finance_' || replace(sector, ' ', '_') || CASE WHEN n > 4 THEN '_batch_' || batch ELSE '' END AS graph_id FROM dealt)
SELECT graph_id, node AS a, NULL AS b, CASE WHEN bool_or(tail) THEN 'answer_chunk_ids=;' ELSE '' END || {_HELD.replace('{k}', 'max(k)')} || CASE WHEN bool_or(tail) THEN ';source_sentences=' ELSE '' END AS held FROM nodes JOIN named USING (k) GROUP BY 1, 2
UNION ALL SELECT graph_id, u, v, 'answer_chunk_ids=;label=' || arg_max(label, k) || ';' || {_HELD.replace('{k}', 'max(k)')} || ';source_sentences=;triplet_id=' || arg_max(triplet_id, k) FROM edges JOIN named USING (k) GROUP BY 1, 2, 3""")
def sector_graphs(spark: SparkSession, sf: str) -> DataFrame:
    """The companies' graphs merged by sector, four at a time."""
    from lodestone.operators import merging as m

    node, edge = m.attributed(_company_facts(spark, sf))
    k = F.expr("cast(substr(graph_id, 2) as bigint)")
    companies = node.select("graph_id").distinct().withColumn("k", k).select("graph_id", F.expr(_SECTOR).alias("sector"), F.col("k").alias("seq"))
    return _both(*m.merged(node, edge, m.sector_groups(node, companies)))


@query(f"""WITH {_MERGED}, deg AS (SELECT k, node, sum(o) AS n FROM (SELECT k, u AS node, 1 AS o FROM edges UNION ALL SELECT k, v, 0 FROM edges) GROUP BY 1, 2),
tops AS (SELECT k, node FROM deg JOIN nodes USING (k, node) QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, node_seq) = 1)
SELECT 'all' AS graph_id, node AS a, NULL AS b, CASE WHEN bool_or(tail) THEN 'answer_chunk_ids=;' ELSE '' END || {_HELD.replace('{k}', 'max(k)')} || CASE WHEN bool_or(tail) THEN ';source_sentences=' ELSE '' END AS held FROM nodes GROUP BY 2
UNION ALL SELECT 'all', 'OECD Countries', NULL, 'type=general'
UNION ALL SELECT DISTINCT 'all', node, 'OECD Countries', 'label=OECD member country;type=general_connection' FROM tops
UNION ALL SELECT 'all', u, v, 'answer_chunk_ids=;label=' || arg_max(label, k) || ';' || {_HELD.replace('{k}', 'max(k)')} || ';source_sentences=;triplet_id=' || arg_max(triplet_id, k) FROM edges GROUP BY 2, 3""")
def country_graph(spark: SparkSession, sf: str) -> DataFrame:
    """All graphs as one, their roots tied to a center."""
    from lodestone.operators import merging as m

    node, edge = m.attributed(_company_facts(spark, sf))
    groups = node.select("graph_id").distinct().select("graph_id", F.lit("all").alias("merged_id"), F.expr("cast(substr(graph_id, 2) as bigint)").alias("graph_seq"))
    return _both(*m.with_center(node, edge, groups, "OECD Countries", "OECD member country"))


@query("""SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.streaming.evaluate import windowed_counts

    return windowed_counts(table(spark, sf, "events")).withColumn("total", F.round("total", 2))
