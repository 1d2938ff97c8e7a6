"""Prompts: short templates for each task, and the strings of facts and chunks that fill them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: System and user parts by task; what stands in braces is filled from columns of that name.
TEMPLATES: dict[str, tuple[str, str]] = {
    "triplets": ("You read reports and list the facts they state.", "List up to {count} facts of the text as JSON: {{\"triplets\": [{{\"entity_1\": ..., \"relation\": ..., \"entity_2\": ..., \"source_sentence\": ...}}]}}. Copy each source sentence word by word.\nAbout the file: {metadata}\n\n{text}"),
    "single_hop": ("You write exam questions with one short answer.", "Ask a question about the first entity whose answer is the second. Name what the reader needs to know: {metadata}. Reply as JSON with question and answer.\nFact: {fact}\n\n{text}"),
    "multi_hop": ("You write exam questions that need several facts.", "Ask one question that needs every fact below ({pattern}), without naming what lies between them. Reply as JSON with question and answer.\n{facts}\n\n{metadata}\n\n{text}"),
    "quality": ("You grade exam questions from 1 to 5.", "Grade each of {dimensions} and reply as JSON with these names.\nQuestion: {question}\nAnswer: {answer}\n\n{text}"),
    "rewrite": ("You rewrite questions without changing what they ask.", "Rewrite the question: {way}.\n{question}"),
    "translate": ("You translate.", "Translate into {language}, and reply with the translation only.\n{text}"),
    "answer": ("You answer from the given documents; if they don't hold the answer, reply: no such info.", "Documents:\n{text}\n\nQuestion: {question}"),
    "answer_alone": ("You answer from what you know; if you don't know, reply: no such info.", "Question: {question}"),
}


def filled(task: str, **columns: Column) -> Column:
    """The task's user prompt with columns in place of its names."""
    out, text = [], TEMPLATES[task][1]
    while text:
        low = text.find("{")
        pair = text.find("{{")
        close = text.find("}}")
        nearest = min((x for x in (low, close) if x >= 0), default=-1)
        if nearest < 0:
            out.append(F.lit(text))
            break
        if nearest in (pair, close):
            out.append(F.lit(text[: nearest + 1]))
            text = text[nearest + 2 :]
            continue
        end = text.index("}", low)
        out += [F.lit(text[:low]), F.coalesce(columns[text[low + 1 : end]].cast("string"), F.lit(""))]
        text = text[end + 1 :]
    return F.concat(*out)


def fact_json(hop: Column) -> Column:
    """A fact as JSON of its entities and relation."""
    return F.to_json(F.struct(*(hop[n].alias(n) for n in ("entity_1", "relation", "entity_2"))))


def facts_listed(path: Column) -> Column:
    """The facts of a path, each with its id and the chunk it comes from."""
    one = lambda h: F.concat(F.lit("Triplet "), h["triplet_id"], F.lit(", Answer Chunk ID: "), h["answer_chunk_id"], F.lit(":\n Entity 1: "), h["entity_1"], F.lit("\n Relation: "), h["relation"], F.lit("\n Entity 2: "), h["entity_2"])
    return F.array_join(F.transform(path, one), "\n")


def chunks_listed(chunks: Column) -> Column:
    """Chunks (chunk_id, text) one after the other, each under its id."""
    return F.array_join(F.transform(chunks, lambda c: F.concat(F.lit("Answer Chunk ID: "), c["chunk_id"], F.lit(":\n"), c["text"])), "\n\n")


def metadata_listed(path: Column, metadata: Column) -> Column:
    """The metadata (a map each) of a path's facts as JSON, each under its fact's id."""
    one = lambda h, i: F.concat(F.lit("Metadata for triplet "), h["triplet_id"], F.lit(":\n"), F.to_json(F.get(metadata, i)))
    return F.array_join(F.transform(path, one), "\n")
