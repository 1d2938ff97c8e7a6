"""Columns from models outside: batches of prompts to any backend, and the parsing of what it replies.

A backend is a function of a list of strings that gives as many replies (None for a failed one); it is made in each
Python worker by ``make``, so clients aren't shipped. Rows pass in batches of ``batch`` prompts, one batch of rows at
a time, and stay where they are: no shuffle, nothing on the driver. What a model replies isn't repeatable, so a
result that is read twice should be written first.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.judge import dot
from lodestone.functions.prompts import filled
from lodestone.operators.tables import groups_of

Backend = Callable[[Sequence[str]], Sequence]
TRIPLETS = "struct<triplets:array<struct<entity_1:string,relation:string,entity_2:string,source_sentence:string>>>"
#: The dimensions that questions are graded by.
SINGLE_HOP, MULTI_HOP = ("clarity", "answerability"), ("clarity", "answerability", "reasoning")


# The metadata that facts keep by domain.
ECONOMICS = ("domain", "file_name", "file_type", "file_country", "file_year")
POLICY = ("domain", "file_name", "file_type", "file_grantee", "file_state", "file_year")


def replies_to(backend: Backend, prompts: list[str], retries: int, wait: float) -> list:
    """The backend's replies; a call that fails is repeated, and so are the prompts without a reply, each at most retries times."""
    out: list = [None] * len(prompts)
    open_, left = list(range(len(prompts))), retries
    while open_:
        try:
            found = list(backend([prompts[i] for i in open_]))
        except Exception:
            if not left:
                raise
            found = [None] * len(open_)
        if len(found) != len(open_):
            raise ValueError(f"{len(found)} replies to {len(open_)} prompts")
        for i, reply in zip(open_, found, strict=True):
            out[i] = reply
        open_ = [i for i in open_ if out[i] is None]
        if not left:
            break
        left -= 1
        if open_ and wait:
            time.sleep(wait)
    return out


def asked(df: DataFrame, prompt: str, make: Callable[[], Backend], out: str = "reply", kind: T.DataType | None = None, batch: int = 100, retries: int = 3, wait: float = 0.0, at_once: int = 1) -> DataFrame:
    """df with the backend's reply to the column prompt; a null prompt isn't asked and has a null reply.

    A task has at most at_once batches with the backend at one time. What fails is asked again, wait seconds later, up to
    retries times: then a missing reply is null, and an error fails the task, which Spark repeats.
    """
    kind = kind or T.StringType()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make()
        with ThreadPoolExecutor(at_once) as pool:
            for pdf in batches:
                texts, replies = pdf[prompt].tolist(), [None] * len(pdf)
                open_ = [i for i, p in enumerate(texts) if isinstance(p, str)]
                parts = [open_[low : low + batch] for low in range(0, len(open_), batch)]
                for own, found in zip(parts, pool.map(lambda own: replies_to(backend, [texts[i] for i in own], retries, wait), parts), strict=True):
                    for i, reply in zip(own, found, strict=True):
                        replies[i] = reply
                yield pdf.assign(**{out: pd.Series(replies, index=pdf.index, dtype=object)})

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(out, kind)]))


def embedded(df: DataFrame, text: str, make: Callable[[], Backend], instruction: str = "", out: str = "vector") -> DataFrame:
    """df with the text's embedding; queries are embedded behind an instruction, what they are compared with is not."""
    prompt = F.concat(F.lit(instruction), text) if instruction else F.col(text)
    return asked(df.withColumn("_prompt", prompt), "_prompt", make, out, T.ArrayType(T.FloatType())).drop("_prompt")


def similarity(df: DataFrame, query: str, other: str, make: Callable[[], Backend], instruction: str, out: str = "similarity") -> DataFrame:
    """df with the dot product of the query's embedding behind the instruction and the other text's plain one."""
    both = embedded(embedded(df, query, make, instruction, "_a"), other, make, "", "_b")
    return both.withColumn(out, dot(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def raw_triplets(chunks: DataFrame, make: Callable[[], Backend], size: int = 5, target: int = 150, keys: Sequence[str] | None = None) -> DataFrame:
    """(doc_id, seq, entity_1, relation, entity_2, source_sentence, metadata) of chunks (doc_id, pos, chunk_id, text, metadata).

    A prompt holds size chunks and the first one's metadata, and asks for target / size facts. A document's groups
    count until it has target triplets, the group that crosses that stays whole. A document with a reply that can't
    be read has none. keys: the metadata that facts keep, empty where the chunk doesn't have it (ECONOMICS, POLICY); None keeps all.
    """
    listed = chunks.withColumn("part", F.struct(F.concat(F.lit("Chunk ID: "), "chunk_id", F.lit("\n"), "text").alias("text"), F.to_json("metadata").alias("about")))
    groups = groups_of(listed, ["doc_id"], "pos", size, "part")
    text = F.array_join(F.transform("items", lambda x: x["text"]), "\n\n")
    prompt = filled("triplets", count=F.lit(target // size), metadata=F.col("items")[0]["about"], text=text)
    replies = asked(groups.select("doc_id", "grp", F.col("items")[0]["about"].alias("about"), prompt.alias("prompt")), "prompt", make)
    # maps have no order, so they pass the ordered lists as JSON
    read = replies.withColumn("metadata", F.from_json("about", chunks.schema["metadata"].dataType)).withColumn("found", F.from_json("reply", TRIPLETS)["triplets"])
    own = Window.partitionBy("doc_id")
    read = read.withColumn("broken", F.max(F.col("found").isNull()).over(own)).withColumn("before", F.coalesce(F.sum(F.size("found")).over(own.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kept = read.where(~F.col("broken") & (F.col("before") < target))
    if keys is not None:
        kept = kept.withColumn("metadata", F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*(F.coalesce(F.col("metadata")[k], F.lit("")) for k in keys))))
    return kept.select("doc_id", (F.col("before")).alias("_b"), "metadata", F.posexplode("found").alias("_p", "t")).select("doc_id", (F.col("_b") + F.col("_p")).alias("seq"), "t.*", "metadata")


def questions(prompts: DataFrame, make: Callable[[], Backend], prompt: str = "prompt") -> DataFrame:
    """prompts with question and answer; null where the reply isn't such JSON."""
    read = F.from_json("reply", "struct<question:string,answer:string>")
    return asked(prompts, prompt, make).withColumns({"question": read["question"], "answer": read["answer"]}).drop("reply")


def graded(qa: DataFrame, make: Callable[[], Backend], dimensions: Sequence[str] = MULTI_HOP, text: Column | None = None) -> DataFrame:
    """qa (question, answer) with scores, a map of dimensions to grades; null where one is missing."""
    prompt = filled("quality", dimensions=F.lit(", ".join(dimensions)), question=F.col("question"), answer=F.col("answer"), text=F.lit("") if text is None else text)
    scores = F.from_json("_reply", "map<string,int>")
    whole = F.forall(F.array(*map(F.lit, dimensions)), lambda d: F.coalesce(F.element_at(scores, d).isNotNull(), F.lit(False)))
    out = asked(qa.withColumn("_prompt", prompt), "_prompt", make, "_reply").withColumn("scores", F.when(whole, F.map_filter(scores, lambda k, _: k.isin(list(dimensions)))))
    return out.drop("_prompt", "_reply")


def rewritten(qa: DataFrame, make: Callable[[], Backend], way: str | Callable[[Column], Column], attempts: int = 3) -> DataFrame:
    """qa (question) with attempts rows each: attempt and candidate, the question rewritten in that way, which may depend on the attempt."""
    told = F.lit(way) if isinstance(way, str) else way(F.col("attempt"))
    rows = qa.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(attempts)))).withColumn("_prompt", filled("rewrite", way=told, question=F.col("question")))
    return asked(rows, "_prompt", make, "candidate").drop("_prompt")


def translated_back(texts: DataFrame, there: Callable[[], Backend], back: Callable[[], Backend], language: str = "French") -> DataFrame:
    """texts (text) with back_translation: into the language and back into English."""
    away = asked(texts.withColumn("_prompt", filled("translate", language=F.lit(language), text=F.col("text"))), "_prompt", there, "_away")
    home = away.withColumn("_prompt", F.when(F.col("_away").isNotNull(), filled("translate", language=F.lit("English"), text=F.col("_away"))))
    return asked(home, "_prompt", back, "back_translation").drop("_prompt", "_away")


def answered(items: DataFrame, make: Callable[[], Backend], batch: int = 100) -> DataFrame:
    """items (query, docs) with response: from the documents, or without any from what the model knows."""
    prompt = F.when(F.size("docs") > 0, filled("answer", text=F.array_join("docs", "\n\n"), question=F.col("query"))).otherwise(filled("answer_alone", question=F.col("query")))
    return asked(items.withColumn("_prompt", prompt), "_prompt", make, "response", batch=batch).drop("_prompt")
