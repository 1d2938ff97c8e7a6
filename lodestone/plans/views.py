"""Views over the driver's tables that stand in for the benchmark's records. Each total order is an explicit seq."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK_GROUPS = 11


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, chunk_id, text, lang, source: the documents' lines."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.where(F.trim("text") != "").select("doc_id", "pos", F.concat(F.lit("doc_"), "doc_id", F.lit("_chunk_"), "pos").alias("chunk_id"), "text", "lang", "source")


def triplets(spark: SparkSession, sf_dir: str, one_graph: bool = True) -> DataFrame:
    """Facts on suppliers and nations; graph_id is g, or the head's region."""
    nation, supplier, region = (table(spark, sf_dir, n) for n in ("nation", "supplier", "region"))
    near = nation.select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("place"), F.col("n_regionkey").alias("rk"))
    home = supplier.join(near, F.col("s_nationkey") == F.col("nk"))
    fact = lambda df, head, rel, tail, kind, key, shift: df.select(
        F.concat(F.lit("g"), F.col("rk")).alias("graph_id"), F.col(head).alias("entity_1"), F.lit(rel).alias("relation"), F.col(tail).alias("entity_2"),
        F.concat(F.lit(f"t{kind}_"), F.col(key)).alias("triplet_id"), F.concat(F.lit("chunk_"), ((F.col(key) + shift) % CHUNK_GROUPS).cast("string")).alias("answer_chunk_id"),
        F.concat_ws(" ", head, F.lit(rel), tail).alias("source_sentence"), F.create_map(F.lit("kind"), F.lit(str(kind))).alias("metadata"), (F.lit(kind).cast("long") * 100_000_000 + F.col(key)).alias("seq"))
    parts = near.join(region, F.col("rk") == F.col("r_regionkey"))
    trade = near.join(nation.select(F.col("n_nationkey").alias("to"), F.col("n_name").alias("partner")), F.col("to") == (F.col("nk") * 7 + 3) % 25)
    every = [
        fact(home, "s_name", "based in", "place", 0, "s_suppkey", 0),
        fact(home.where("s_suppkey % 5 = 0"), "s_name", "ships from", "place", 1, "s_suppkey", 5),
        fact(home.withColumn("mark", F.concat(F.lit("reg "), "s_name")), "s_name", "registered as", "mark", 2, "s_suppkey", 2),
        fact(parts, "place", "part of", "r_name", 3, "nk", 0),
        fact(trade, "place", "trades with", "partner", 4, "nk", 3),
    ]
    out = every[0]
    for df in every[1:]:
        out = out.unionByName(df)
    return out.withColumn("graph_id", F.lit("g")) if one_graph else out


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, question, answer: user turns and the assistant's next."""
    turns = table(spark, sf_dir, "conversations")
    own = Window.partitionBy("conv_id").orderBy("turn")
    pairs = turns.withColumn("answer", F.lead("text").over(own)).withColumn("after", F.lead("role").over(own)).where("role = 'user' and after = 'assistant'")
    return pairs.select(F.concat(F.lit("conv_"), "conv_id", F.lit("_"), "turn").alias("record_id"), "conv_id", "turn", F.col("text").alias("question"), "answer")


VARIANTS = ("original", "character_level", "word_level", "irrelevant_info", "grammar_perturbation")
RETRIEVERS = ("r0", "r1", "r2")


def variants(pairs: DataFrame) -> DataFrame:
    """record_id, query_variant, query: the question and four rule-made rewrites."""
    q = F.col("question")
    ways = (q, F.translate(q, "aeiou", "eioua"), F.replace(q, F.lit(" the "), F.lit(" that ")), F.concat(q, F.lit(" By the way, it rains.")), F.lower(q))
    return pairs.select("record_id", F.explode(F.array(*(F.struct(F.lit(n).alias("query_variant"), w.alias("query")) for n, w in zip(VARIANTS, ways, strict=True)))).alias("v")).select("record_id", "v.*")


def documents(pairs: DataFrame) -> DataFrame:
    """record_id, kind, docs: the answer's text, the text without it (not for every third turn) and a rewritten one."""
    a = F.col("answer")
    regex = F.when(F.col("turn") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.left(a, F.lit(5))))
    kinds = (("truth", F.array(a)), ("regex", regex), ("back", F.array(F.upper(a))))
    return pairs.select("record_id", F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), d.alias("docs")) for n, d in kinds))).alias("d")).select("record_id", "d.*")


def retrieved(pairs: DataFrame) -> DataFrame:
    """record_id, retriever, query_variant, docs."""
    return pairs.select("record_id", F.explode(F.array(*map(F.lit, RETRIEVERS))).alias("retriever"), F.array("answer").alias("docs")).select("record_id", "retriever", F.explode(F.array(*map(F.lit, VARIANTS))).alias("query_variant"), "docs")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.operators.evaluation import work_items

    pairs = qa(spark, sf_dir)
    return work_items(pairs, variants(pairs), documents(pairs), retrieved(pairs))


def responses(work: DataFrame) -> DataFrame:
    """item_id, model, response of two pseudo-models: the truth, the truth in a sentence, a refusal or other words, by the ids' lengths and letters."""
    rows = work.select("item_id", "answer", F.explode(F.array(F.lit(1), F.lit(2))).alias("m"))
    key = (F.length("item_id") * 3 + F.ascii(F.right("item_id", F.lit(1))) + F.ascii(F.substring("item_id", 7, 1)) * 5 + F.col("m") * 2) % 7
    text = F.when(key < 2, F.col("answer")).when(key == 2, F.concat(F.lit("It is: "), "answer")).when(key < 5, F.lit("There is no such info.")).otherwise(F.lit("quite another thing"))
    return rows.select("item_id", F.concat(F.lit("model_"), "m").alias("model"), text.alias("response"))


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.operators.evaluation import response_details

    work = items(spark, sf_dir)
    return response_details(work, responses(work))
