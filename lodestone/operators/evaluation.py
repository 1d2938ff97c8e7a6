"""Work items, response details and robustness metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import judge
from lodestone.functions.text import normalize_answer, preview, refuses

DETAIL = ("model", "record_id", "query_variant", "doc_variant_type", "retriever", "robust", "is_correct", "returns_no_info", "can_answer_without", "response_preview")


def work_items(qa: DataFrame, variants: DataFrame, documents: DataFrame, retrieved: DataFrame) -> DataFrame:
    """What is to be answered: for each record an empty probe, and each query variant with each kind of documents.

    qa: record_id, question, answer. variants: record_id, query_variant, query. documents: record_id, kind, docs, with
    kinds truth (kept even if empty), regex and back (skipped if empty). retrieved: record_id, retriever,
    query_variant, docs. Joins are on the record only.
    """
    head = ["record_id", "query", "docs", "answer", "query_variant", "doc_variant_type", "retriever", "for_metric"]
    none = F.lit(None).cast("string")
    probe = qa.select("record_id", F.col("question").alias("query"), F.array().cast("array<string>").alias("docs"), "answer", F.lit("original").alias("query_variant"), F.lit(judge.EMPTY).alias("doc_variant_type"), none.alias("retriever"), F.lit(False).alias("for_metric"))
    kind = F.when(F.col("kind") == "truth", judge.TRUTH).when(F.col("kind") == "regex", judge.SIMILAR).when(F.col("kind") == "back", judge.DIFFERENT)
    given = documents.where((F.col("kind") == "truth") | (F.size("docs") > 0)).select("record_id", "docs", kind.alias("doc_variant_type"))
    asked = qa.select("record_id", "answer").join(variants, "record_id")
    fixed = asked.join(given, "record_id").withColumn("retriever", none).withColumn("for_metric", F.lit(True))
    wild = asked.join(retrieved, ["record_id", "query_variant"]).withColumn("doc_variant_type", F.lit(judge.REAL)).withColumn("for_metric", F.lit(True))
    items = probe.unionByName(fixed.select(*head)).unionByName(wild.select(*head))
    return items.select(F.concat_ws("/", "record_id", "query_variant", "doc_variant_type", F.coalesce("retriever", F.lit("-"))).alias("item_id"), *head)


def ordered_texts(ids: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """(key, docs): the texts of ids (key, chunk_ids) in their order; unknown ids are left out, their records stay."""
    rows = ids.select(key, F.posexplode_outer("chunk_ids").alias("pos", "chunk_id"))
    found = rows.join(chunks.select("chunk_id", "text"), "chunk_id", "left")
    kept = F.filter(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda r: r["text"].isNotNull())
    return found.groupBy(key).agg(F.transform(kept, lambda r: r["text"]).alias("docs"))


def response_details(items: DataFrame, responses: DataFrame, similarity: str | None = None) -> DataFrame:
    """Judged responses (item_id, model, response[, similarity]) of the items for metrics.

    can_answer_without: a probe of the model and record was right. Answers are normalised and judged once.
    """
    judged = verdicts(responses.join(items, "item_id"), similarity)
    return with_robust(judged).withColumn("response_preview", preview(F.col("response"))).select(*DETAIL)


def verdicts(answered: DataFrame, similarity: str | None = None) -> DataFrame:
    """answered (response, answer, ...) with is_correct and refused, of each response by itself."""
    told = answered.withColumns({"_said": normalize_answer(F.col("response")), "_truth": normalize_answer(F.col("answer"))})
    right = judge.within(F.col("_said"), F.col("_truth"))
    right = right if similarity is None else right | F.coalesce(F.col(similarity) >= judge.ALIKE, F.lit(False))
    return told.withColumns({"is_correct": right, "refused": refuses(F.col("_said"))}).drop("_said", "_truth")


def with_robust(judged: DataFrame) -> DataFrame:
    """The verdicts that count for metrics, with returns_no_info, can_answer_without and robust."""
    probe = F.max(F.when(F.col("doc_variant_type") == judge.EMPTY, F.col("is_correct"))).over(Window.partitionBy("model", "record_id"))
    known = judged.withColumns({"can_answer_without": F.coalesce(probe, F.lit(False)), "returns_no_info": ~F.col("is_correct") & F.col("refused")}).where("for_metric")
    robust = judge.is_robust(F.col("is_correct"), F.col("returns_no_info"), F.col("can_answer_without"), F.col("doc_variant_type"))
    return known.withColumn("robust", robust)


def share(flag) -> F.Column:
    """The share of true flags, 0 of none."""
    return F.round(F.coalesce(F.avg(flag.cast("int")), F.lit(0.0)), 6)


QUERY = "query_variant <> 'original' and doc_variant_type = 'ground-truth-docs'"
DOC = "query_variant = 'original' and doc_variant_type in ('lexical-similar-no-answer-docs', 'lexical-diff-with-answer-docs')"
WILD = "query_variant = 'original' and doc_variant_type = 'real-world-docs'"


def judged_items(answered: DataFrame) -> DataFrame:
    """(model, record_id, item_id, for_metric, query_variant, doc_variant_type, retriever, robust, robust_known, knows) of each answered response by itself, batch or stream.

    answered: responses that aren't null with their items' columns. robust and robust_known: without and with the model
    knowing the answer. knows: a right probe.
    """
    told = verdicts(answered).withColumn("_none", ~F.col("is_correct") & F.coalesce("refused", F.lit(False)))
    robust = lambda knows: F.coalesce(judge.is_robust(F.col("is_correct"), F.col("_none"), F.lit(knows), F.col("doc_variant_type")), F.lit(False))
    knows = F.col("is_correct") & (F.col("doc_variant_type") == judge.EMPTY)
    head = ("model", "record_id", "item_id", "for_metric", "query_variant", "doc_variant_type", "retriever")
    return told.select(*head, robust(False).alias("robust"), robust(True).alias("robust_known"), F.coalesce(knows, F.lit(False)).alias("knows"))


def metric_names() -> Column:
    """The names that a response counts for."""
    wild = F.expr(WILD)
    names = [
        F.lit("overall_robustness"), F.when(F.expr(QUERY), "query_robustness"), F.when(F.expr(DOC), "doc_robustness"),
        F.when(wild, "real_robustness"), F.when(wild, F.concat(F.lit("real_robustness_"), F.coalesce("retriever", F.lit("none")))),
        F.concat(F.lit("variant_"), "query_variant"), F.concat(F.lit("variant_doc_"), "query_variant", F.lit("_"), "doc_variant_type"),
    ]
    return F.filter(F.array(*names), lambda m: m.isNotNull())


def robustness(details: DataFrame) -> DataFrame:
    """(model, metric, value): overall, query, doc and real-world robustness, per variant, and per variant and documents.

    Real-world values are means over scores, for each retriever and for all scores together. Every response counts
    for each of its metrics in one pass; the first three metrics are there for every model.
    """
    score, wild = F.col("robust").cast("int"), F.expr(WILD)
    one = lambda name, value=score: F.struct(name.alias("metric"), value.alias("score"))
    every = [
        one(F.lit("overall_robustness")), one(F.lit("query_robustness"), F.when(F.expr(QUERY), score)), one(F.lit("doc_robustness"), F.when(F.expr(DOC), score)),
        one(F.when(wild, "real_robustness")), one(F.when(wild, F.concat(F.lit("real_robustness_"), F.coalesce("retriever", F.lit("none"))))),
        one(F.concat(F.lit("variant_"), "query_variant")), one(F.concat(F.lit("variant_doc_"), "query_variant", F.lit("_"), "doc_variant_type")),
    ]
    rows = details.select("model", F.inline(F.array(*every))).where("metric is not null")
    return rows.groupBy("model", "metric").agg(F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("value"))


def real_robustness(details: DataFrame) -> DataFrame:
    sets = details.where(WILD).groupingSets([["model", "retriever"], ["model"]], "model", "retriever").agg(share(F.col("robust")).alias("value"), F.grouping("retriever").alias("all"))
    return sets.select("model", F.when(F.col("all") == 1, "real_robustness").otherwise(F.concat(F.lit("real_robustness_"), F.coalesce("retriever", F.lit("none")))).alias("metric"), "value")


def variant_robustness(details: DataFrame) -> DataFrame:
    sets = details.groupingSets([["model", "query_variant"], ["model", "query_variant", "doc_variant_type"]], "model", "query_variant", "doc_variant_type").agg(share(F.col("robust")).alias("value"), F.grouping("doc_variant_type").alias("all"))
    name = F.when(F.col("all") == 1, F.concat(F.lit("variant_"), "query_variant")).otherwise(F.concat(F.lit("variant_doc_"), "query_variant", F.lit("_"), "doc_variant_type"))
    return sets.select("model", name.alias("metric"), "value")


def analysis(details: DataFrame) -> DataFrame:
    """Counts and rates for each model and kind of documents."""
    wrong = ~F.col("is_correct") & ~F.col("returns_no_info")
    flags = {"robust": F.col("robust"), "correct": F.col("is_correct"), "no_info": F.col("returns_no_info"), "incorrect": wrong}
    return details.groupBy("model", "doc_variant_type").agg(
        F.count("*").alias("total"),
        *(F.count_if(f).alias(n) for n, f in flags.items()),
        F.count_if("can_answer_without").alias("can_answer_without"),
        *(share(f).alias(f"{n}_rate") for n, f in flags.items()),
    )


def parametric_count(details: DataFrame) -> DataFrame:
    """(model, parametric): the records whose answer the model knows without documents."""
    return details.groupBy("model", "record_id").agg(F.max("can_answer_without").alias("knows")).groupBy("model").agg(F.count_if("knows").alias("parametric"))


def pivoted(metrics: DataFrame, models: list[str]) -> DataFrame:
    """Metrics by models, in their order."""
    return metrics.groupBy("metric").pivot("model", models).agg(F.first("value")).orderBy("metric")


def interim(details: DataFrame, order: str, size: int) -> DataFrame:
    """(model, batch, seen, value): robustness over all items up to each batch of size items."""
    batch = F.floor(F.col(order) / size)
    sums = details.groupBy("model", batch.alias("batch")).agg(F.count("*").alias("n"), F.count_if("robust").alias("r"))
    run = Window.partitionBy("model").orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sums.select("model", "batch", F.sum("n").over(run).alias("seen"), F.round(F.sum("r").over(run) / F.sum("n").over(run), 6).alias("value"))
