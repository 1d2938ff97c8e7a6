"""Sources and sinks: index files, JSON records, document indexes, graphs (``graphml`` writes and reads XML)."""

from __future__ import annotations

import io
import itertools
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


# The records' field names.
FILING_INDEX = _schema(**{n: _S for n in ("CIK", "Company", "Type", "Date", "complete_text_file_link", "html_index", "Filing Date", "Period of Report", "SIC", "htm_file_link", "State of Inc", "State location", "Fiscal Year End", "filename")})
COMPANY = _schema(Symbol=_S, Security=_S, GICS_Sector=_S, GICS_SubIndustry=_S, CIK=_S)
CHUNK = _schema(chunk_id=_S, text=_S, metadata=T.MapType(_S, _S))
DOCUMENT_INDEX = _schema(document_id=_S, domain=_S, chunk_file=_S, chunk_count=_I)
TRIPLET = _schema(triplet_id=_S, entity_1=_S, relation=_S, entity_2=_S, answer_chunk_id=_S, source_sentence=_S, metadata=T.MapType(_S, _S), seq=_L)
BLOCK = _schema(type=_S, text=_S, table_body=_S, table_caption=T.ArrayType(_S), table_footnote=T.ArrayType(_S), page_idx=_I)
POLICY = T.StructType([T.StructField("id", _S), T.StructField("fileName", _S), T.StructField("planType", _S), T.StructField("startYear", _I), T.StructField("grantee", T.StructType([T.StructField("granteeName", _S), T.StructField("state", _schema(name=_S))]))])


def read_filing_index(spark: SparkSession, paths: Sequence[str], forms: Sequence[str] | None = None, ciks: Sequence[str] | None = None, prefix: str = "") -> DataFrame:
    """Pipe-separated index files; CIKs compare as numbers, so leading zeros don't matter."""
    df = spark.read.csv(list(paths), sep="|", schema=FILING_INDEX)
    df = df.withColumns({c: F.concat(F.lit(prefix), c) for c in ("complete_text_file_link", "html_index")})
    if forms:
        df = df.where(F.col("Type").isin(list(forms)))
    return df.where(F.expr("try_cast(CIK as bigint)").isin([int(c) for c in ciks])) if ciks else df


def archive_lines(archives: DataFrame, name: str = "master.idx", header: int = 11) -> DataFrame:
    """(value): the lines of the file name in zip archives (content), as Latin-1, without each file's first header lines.

    archives: as Spark's binaryFile source reads them. A task holds one archive; one without the file has no lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for content in (x for b in batches for i in range(b.num_rows) for x in b.column(0).slice(i, 1).to_pylist() if x is not None):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                if name not in z.namelist():
                    continue
                with z.open(name) as f:
                    lines = itertools.islice(io.TextIOWrapper(f, "latin-1", newline="\n"), header, None)
                    while part := [x.strip() for x in itertools.islice(lines, 10_000)]:
                        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string())], ["value"])

    return archives.select("content").mapInArrow(run, "value string")


def zipped_lines(name: str, header: int):
    """A function of a column of lists of lines: a zip archive with them in one file, behind header lines."""

    @F.pandas_udf(T.BinaryType())
    def run(lists: pd.Series) -> pd.Series:
        out = []
        for lines in lists:
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(name, "".join(f"{x}\n" for x in [*(f"header {k}" for k in range(header)), *lines]).encode("latin-1", "replace"))
            out.append(held.getvalue())
        return pd.Series(out)

    return run


def parse_master_index(lines: DataFrame) -> DataFrame:
    """Rows of a master index given as lines (value): those with five fields and a numeric CIK, with the -index.html link."""
    part = F.split("value", r"\|")
    rows = lines.where((F.size(part) == 5) & F.rlike(part[0], F.lit(r"^\d+$")))
    return rows.select(part[0].alias("CIK"), part[1].alias("Company"), part[2].alias("Type"), part[3].alias("Date"), part[4].alias("complete_text_file_link"), F.regexp_replace(part[4], r"\.txt$", "-index.html").alias("html_index"))


def resolve_ciks(wanted: DataFrame, companies: DataFrame, column: str = "ticker") -> DataFrame:
    """(column, cik): digits stay, tickers are looked up, unknown ones go."""
    known = companies.groupBy(F.upper("Symbol").alias("_symbol")).agg(F.min("CIK").alias("_cik"))
    out = wanted.join(known, F.upper(column) == F.col("_symbol"), "left")
    return out.select(column, F.when(F.rlike(F.col(column), F.lit(r"^\d+$")), F.col(column)).otherwise(F.col("_cik")).alias("cik")).where("cik is not null")


def read_records(spark: SparkSession, path: str, schema: T.StructType, lines: bool = False) -> DataFrame:
    """JSON arrays, or JSON lines, of one schema, with file, the file each comes from. A missing path has no records."""
    reader = spark.read.schema(schema).option("multiLine", not lines).option("mode", "PERMISSIVE")
    try:
        return reader.json(path).withColumn("file", F.col("_metadata.file_path"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema).withColumn("file", F.lit(None).cast("string"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Layout blocks with pos, their place in their file."""
    lists = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", T.ArrayType(BLOCK)).alias("blocks"))
    return lists.select("file", F.posexplode("blocks").alias("pos", "block")).select("file", "pos", "block.*")


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (filename, content)."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("filename"), F.col("value").alias("content"))


def chunk_documents(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chunks as retriever documents: text, the given metadata as columns, and chunk_id."""
    return chunks.select("text", *(F.col("metadata")[k].alias(k) for k in keys), "chunk_id")


def unique_chunks(chunks: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """Of chunks with one id the last counts, in the place of the first."""
    rest = [c for c in chunks.columns if c not in (*keys, pos)]
    return chunks.groupBy(*keys).agg(F.max_by(F.struct(*rest), pos).alias("_row"), F.min(pos).alias(pos)).select(*keys, pos, "_row.*")


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges with nested attributes as JSON without the outer brackets."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        nested = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)]
        df.withColumns({c: F.regexp_replace(F.to_json(c), r"^\[|\]$", "") for c in nested}).write.mode("overwrite").partitionBy("graph_id").parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
