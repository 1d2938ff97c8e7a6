"""Chunkers: sequential folds over one document at a time, in Arrow-backed functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import HEADING

SEPARATORS = ("\n\n", "\n", ". ", ", ", " ", "")
_HEADING = re.compile(HEADING)
_TOKEN = re.compile(r"\w+|[^\w\s]")


def count_tokens(text: str) -> int:
    """The default token counter: words and punctuation marks."""
    return len(_TOKEN.findall(text))


def heading(line: str) -> bool:
    return len(line.split()) <= 10 and bool(_HEADING.match(line.strip()))


def table_marks(text: str) -> bool:
    return "|" in text and ("--" in text or "-|-" in text or text.count("|") >= 3)


def _table_ends(line: str, after: str | None) -> bool:
    return "|" not in line or (not table_marks(line) and after is not None and "|" not in after)


def segments(text: str, legacy: bool = False) -> list[str]:
    """Sections of a filing's text: titles open them, tables stay whole with up to two lines of context.

    A short titled section joins the next one, the last the one before. A table still open at the end is kept,
    unless legacy.
    """
    lines = text.split("\n")
    out: list[str] = []
    body: list[str] = []
    table: list[str] | None = None

    def close() -> None:
        if joined := "\n\n".join(body).strip():
            out.append(joined)
        body.clear()

    def close_table() -> None:
        if len("\n\n".join(body).split()) > 30:
            close()
        body.append("\n".join(table or []))

    for i, raw in enumerate(lines):
        line = raw.strip()
        if not line:
            continue
        if table is None and heading(line):
            close()
            body.append(line)
        elif table is None and table_marks(line):
            table = [x for x in lines[max(0, i - 2) : i] if x.strip() and not heading(x.strip())] + [line]
        elif table is not None:
            table.append(line)
            if _table_ends(line, lines[i + 1] if i + 1 < len(lines) else None):
                close_table()
                table = None
        else:
            body.append(line)
    if table is not None and not legacy:
        close_table()
    close()
    done: list[str] = []
    carried = ""
    for k, part in enumerate(out):
        part = f"{carried}\n\n{part}" if carried else part
        carried = ""
        if heading(part.split("\n")[0].strip()) and len(part.split()) < 30:
            if k < len(out) - 1:
                carried = part
            elif done:
                done[-1] += "\n\n" + part
            else:
                done.append(part)
        else:
            done.append(part)
    return done


def _cut(text: str, separator: str) -> list[str]:
    """Pieces that join to text; a separator stays at the start of the piece after it."""
    if not separator:
        return list(text)
    parts = text.split(separator)
    return [p for p in [parts[0], *(separator + p for p in parts[1:])] if p]


def split_recursively(text: str, size: int = 800, overlap: int = 100, length: Callable[[str], int] = count_tokens, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most size: cut at the first separator that occurs, oversize ones at the next; neighbours merge up to size and share up to overlap."""
    place = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    out: list[str] = []
    fitting: list[str] = []
    for piece in _cut(text, separators[place]):
        if length(piece) <= size:
            fitting.append(piece)
            continue
        out += _merged(fitting, size, overlap, length)
        fitting = []
        out += split_recursively(piece, size, overlap, length, separators[place + 1 :]) if place + 1 < len(separators) else [piece]
    return out + _merged(fitting, size, overlap, length)


def _merged(pieces: list[str], size: int, overlap: int, length: Callable[[str], int]) -> list[str]:
    out: list[str] = []
    held: list[tuple[str, int]] = []
    total = 0
    for piece in pieces:
        n = length(piece)
        if held and total + n > size:
            out.append("".join(p for p, _ in held).strip())
            while held and (total > overlap or total + n > size):
                total -= held.pop(0)[1]
        held.append((piece, n))
        total += n
    if held:
        out.append("".join(p for p, _ in held).strip())
    return [p for p in out if p]


def merge_short(pieces: list[str], title: str | None = None, least: int = 30) -> list[str]:
    """Pieces of fewer than least words gather until a longer one comes; a title that the first lacks is put before it."""
    out: list[str] = []
    waiting: list[str] = []
    for piece in (p for p in pieces if p.strip()):
        if len(piece.split()) < least:
            waiting.append(piece)
            continue
        if waiting:
            out.append("\n\n".join(waiting))
            waiting = []
        out.append(piece)
    if waiting:
        out.append("\n\n".join(waiting))
    if out and title and title not in out[0]:
        out[0] = f"{title}\n\n{out[0]}"
    return [p.strip() for p in out]


def filing_chunks(text: str, size: int = 800, overlap: int = 100, legacy: bool = False) -> list[tuple[str, bool]]:
    """(text, contains_table) of a filing section."""
    out = []
    for part in segments(text, legacy):
        if table_marks(part):
            out.append((part, True))
            continue
        first = part.split("\n")[0].strip()
        out += [(p, False) for p in merge_short(split_recursively(part, size, overlap), first if heading(first) else None)]
    return out


def block_chunks(blocks: list[tuple[str, str | None, int]], size: int = 600, legacy: bool = False) -> list[tuple[str, str, int]]:
    """(kind, text, page) of layout blocks (type, text, page): text gathers below size words, tables stand alone.

    The last text is kept and an empty first one isn't, unless legacy. A chunk's page is that of the block that
    closed it, the last one's its own.
    """
    out: list[tuple[str, str, int]] = []
    held, page = "", 0
    for kind, text, at in blocks:
        if text is None:
            continue
        if kind == "table":
            out.append(("table", text.strip(), at))
        elif kind == "text":
            page = at
            if len((held + text).split()) >= size:
                if held.strip() or legacy:
                    out.append(("text", held.strip(), at))
                held = ""
            held += text + "\n"
    if held.strip() and not legacy:
        out.append(("text", held.strip(), page))
    return out


def captioned(table: str, captions: list[str], footnotes: list[str], before: list[tuple[str, str]], economics: bool) -> str:
    """A table's text with its caption and footnotes.

    Policy reports join all captions. Economics takes the first if it says Table; else it walks back over the text
    blocks before (kind, text), short ones of at most 100 characters, to one that says Table, and takes them all.
    """
    notes = "\n".join(footnotes)
    if not economics:
        return "\n".join(captions) + "\n" + table + notes if captions else table
    if captions and "Table" in captions[0]:
        return captions[0] + "\n" + table + notes
    for i in range(len(before) - 1, -1, -1):
        kind, text = before[i]
        if kind != "text" or len(text) > 100:
            break
        if "Table" in text:
            return "\n".join(t for _, t in before[i:]) + "\n" + table + notes
    return table


def chunked(docs: DataFrame, key: str, text: str, chunker: Callable[[str], list[tuple[str, bool]]]) -> DataFrame:
    """(key, pos, text, contains_table) of each document's chunks; one document is read at a time, in any partition."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for low in range(0, len(pdf), 64):
                part = pdf.iloc[low : low + 64]
                rows = [(k, i, t, c) for k, x in zip(part[key], part[text], strict=True) if x is not None for i, (t, c) in enumerate(chunker(x))]
                yield pd.DataFrame(rows, columns=[key, "pos", "text", "contains_table"])

    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, pos int, text string, contains_table boolean")


def greedy_blocks(blocks: DataFrame, key: str, pos: str, text: str, size: int = 600) -> DataFrame:
    """(key, chunk_pos, chunk_text): text blocks gathered below size words, the fold in the engine itself."""
    from lodestone.functions.text import word_count

    rows = blocks.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, F.col(text).alias("t")))), lambda r: r["t"]).alias("rows"))
    start = F.struct(F.lit("").alias("held"), F.array().cast("array<string>").alias("done"))

    def step(s, t):
        full = (word_count(F.concat(s["held"], t)) >= size) & (F.trim(s["held"]) != "")
        return F.struct(F.when(full, F.concat(t, F.lit("\n"))).otherwise(F.concat(s["held"], t, F.lit("\n"))).alias("held"), F.when(full, F.concat(s["done"], F.array(F.rtrim(s["held"], F.lit("\n"))))).otherwise(s["done"]).alias("done"))

    def finish(s):
        return F.when(F.trim(s["held"]) != "", F.concat(s["done"], F.array(F.rtrim(s["held"], F.lit("\n"))))).otherwise(s["done"])

    return rows.select(key, F.posexplode(F.aggregate("rows", start, step, finish)).alias("chunk_pos", "chunk_text"))
