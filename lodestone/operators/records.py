"""Records of facts, chunks and questions: making triplets of raw ones, file headers and groups, joins by id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import normalize_entity, normalize_text
from lodestone.operators.relations import located


def processed_triplets(raw: DataFrame, chunks: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Triplets of raw ones (doc_id, seq, prefix, entity_1, relation, entity_2, source_sentence, metadata).

    triplet_id counts a document's raw triplets in the order of seq before any goes, so gaps stay where one without a
    source sentence, or with one that no chunk of its document (doc_id, chunk_id, pos, text) holds, is dropped. A
    chunk id given by the model isn't read. names (scope, relation, leader) makes relations canonical by document;
    a relation that it doesn't have keeps its normalised form.
    """
    own = Window.partitionBy("doc_id").orderBy("seq")
    rows = raw.withColumn("idx", F.row_number().over(own) - 1).withColumn("relation", normalize_text(F.col("relation")))
    if names is not None:
        known = names.select(F.col("scope").alias("doc_id"), "relation", "leader")
        rows = rows.join(known, ["doc_id", "relation"], "left").withColumn("relation", F.coalesce("leader", "relation")).drop("leader")
    place = located(rows.select("doc_id", "idx", F.col("source_sentence").alias("sentence")), chunks).select("doc_id", "idx", F.col("chunk_id").alias("answer_chunk_id"))
    return rows.join(place, ["doc_id", "idx"]).select(
        "doc_id", F.concat("prefix", F.lit("_triplet_"), F.col("idx").cast("string")).alias("triplet_id"), normalize_entity(F.col("entity_1")).alias("entity_1"), "relation",
        normalize_entity(F.col("entity_2")).alias("entity_2"), "answer_chunk_id", "source_sentence", "metadata", F.col("idx").cast("long").alias("seq"),
    )


def triplet_prefix(domain: str, metadata: Column) -> Column:
    """What a triplet's id begins with: of finance domain, cik and filing date, else domain and file."""
    parts = ("domain", "cik", "filing_date") if domain == "finance" else ("domain", "file_name")
    return F.concat_ws("_", *(F.coalesce(metadata[p], F.lit("")) for p in parts))


def eligible(chunks: DataFrame) -> DataFrame:
    """Chunks whose metadata has a cik and a filing date."""
    meta = F.col("metadata")
    return chunks.where((F.coalesce(meta["cik"], F.lit("")) != "") & (F.coalesce(meta["filing_date"], F.lit("")) != ""))


def spread_over_chunks(qa: DataFrame) -> DataFrame:
    """Questions whose answer lies in more than one chunk."""
    return qa.where(F.size("answer_chunk_ids") > 1)


def keyed_by_first(df: DataFrame, file: str, order: str, key: Column, missing: str = "unknown") -> DataFrame:
    """df with group: the key of the first row of each file, for all its rows."""
    first = df.groupBy(file).agg(F.min_by(F.struct(key.alias("k")), order).alias("_first")).select(file, F.coalesce("_first.k", F.lit(missing)).alias("group"))
    return df.join(first, file)


def keyed_by_row(df: DataFrame, key: Column) -> DataFrame:
    """df with group: each row's own key; rows with an empty one, or none, go."""
    return df.withColumn("group", key).where(F.coalesce("group", F.lit("")) != "")


def companies_by_sector(companies: DataFrame, sector: str, name: str, seq: str) -> DataFrame:
    """(sector, companies): the names of each sector in the order of seq. A sector's list is the result."""
    listed = companies.groupBy(sector).agg(F.array_sort(F.collect_list(F.struct(seq, name))).alias("rows"))
    return listed.select(sector, F.transform("rows", lambda r: r[name]).alias("companies"))


def with_metadata(files: DataFrame, records: DataFrame, key: str, seq: str) -> DataFrame:
    """files with the first record (by seq) of their id, compared as text; files without one go."""
    first = records.groupBy(F.col(key).cast("string").alias(key)).agg(F.min_by(F.struct(*[c for c in records.columns if c not in (key, seq)]), seq).alias("record"))
    return files.withColumn(key, F.col(key).cast("string")).join(first, key)


def survey_headers(lines: DataFrame, file: str, order: str, text: str, marker: str = "OECD Economic Surveys:") -> DataFrame:
    """(file, header, year, country) of the first line of each file that holds the marker.

    header is what stands between its first two colons, year its first four digits, country the rest. Files without
    such a line, or without a year in it, are left out.
    """
    heads = lines.where(F.contains(F.col(text), F.lit(marker))).groupBy(file).agg(F.min_by(text, order).alias("line"))
    header = F.trim(F.get(F.split("line", ":"), F.lit(1)))
    year = F.regexp_extract("header", r"[0-9]{4}", 0)
    out = heads.select(file, header.alias("header")).withColumn("year", year).where("year <> ''")
    return out.withColumn("country", F.trim(F.replace("header", F.col("year"), F.lit(""))))


def documents_joined_back(qa: DataFrame, by_chunk: DataFrame, by_pair: DataFrame) -> DataFrame:
    """qa (record_id, answer_chunk_ids, source_sentences, ...) with what was made of its documents once.

    by_chunk: chunk_id, text. back_translation holds the texts of the record's chunks in their order, without those
    that were not made. by_pair: answer_chunk_ids, source_sentences, docs. regex_delete holds the docs of the same
    pair of lists, none of an unknown one. Records without chunk ids have neither (null).
    """
    ids = qa.select("record_id", F.posexplode("answer_chunk_ids").alias("pos", "chunk_id"))
    texts = ids.join(by_chunk, "chunk_id").groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("rows"))
    texts = texts.select("record_id", F.transform("rows", lambda r: r["text"]).alias("_texts"))
    pairs = by_pair.withColumnRenamed("docs", "_docs")
    none, some = F.array().cast("array<string>"), F.size("answer_chunk_ids") > 0
    out = qa.join(pairs, ["answer_chunk_ids", "source_sentences"], "left").join(texts, "record_id", "left")
    return out.select(*qa.columns, F.when(some, F.coalesce("_texts", none)).alias("back_translation"), F.when(some, F.coalesce("_docs", none)).alias("regex_delete"))


def missing_files(ids: DataFrame, present: DataFrame, template: str, key: str = "id") -> DataFrame:
    """(key, url) of ids that are not present yet; the template has one %s for the id."""
    return ids.join(present.select(key), key, "left_anti").select(key, F.format_string(template, F.col(key).cast("string")).alias("url"))


def caption_above(blocks: DataFrame, file: str, order: str, longest: int = 100) -> DataFrame:
    """Blocks (type, text) with caption: for a table the short text rows above it from the nearest with "Table" on, joined by blanks.

    The walk upward ends at the first row that isn't text or is longer; without a "Table" in it there is no caption.
    """
    own = Window.partitionBy(file).orderBy(order)
    usable = (F.col("type") == "text") & (F.length(F.coalesce("text", F.lit(""))) <= longest)
    # rows of one run of usable texts share the number of breakers before them, a table has its run's number before itself
    rows = blocks.withColumn("_run", F.sum((~F.coalesce(usable, F.lit(False))).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("_ok", F.coalesce(usable, F.lit(False)))
    runs = rows.where("_ok").groupBy(file, "_run").agg(F.array_sort(F.collect_list(F.struct(order, "text"))).alias("_rows"))
    named = F.array_max(F.transform("_rows", lambda r, i: F.when(F.contains(r["text"], F.lit("Table")), i).otherwise(F.lit(-1))))
    texts = F.transform(F.filter("_rows", lambda r, i: i >= F.col("_at")), lambda r: r["text"])
    captions = runs.withColumn("_at", named).where("_at >= 0").select(file, (F.col("_run") + 1).alias("_run"), F.array_join(texts, " ").alias("_caption"))
    out = rows.join(captions, [file, "_run"], "left")
    return out.select(*blocks.columns, F.when(F.col("type") == "table", F.col("_caption")).alias("caption"))


def evaluated_domains(datasets: DataFrame, retrieved: DataFrame) -> DataFrame:
    """datasets (file, ...) with domain, the file's stem, for those whose domain has retrieval results (domain)."""
    stem = F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1)
    return datasets.withColumn("domain", stem).join(retrieved.select("domain").distinct(), "domain", "left_semi")


def sectors_of_first(chunks: DataFrame, sectors: Sequence[str], file: str = "doc_id", order: str = "pos", key: str = "GICS_Sector") -> DataFrame:
    """Chunks of the documents whose first chunk is of one of the sectors."""
    keyed = keyed_by_first(chunks, file, order, F.col("metadata")[key], "")
    return keyed.where(F.col("group").isin(list(sectors))).drop("group")
