"""Text functions as Column expressions: normalisation, headings, tables, prompts, ids."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Company suffixes, refusal phrases, heading patterns and character replacements.
COMPANY_SUFFIX = r" (?:inc\.?|corporation|corp\.?|ltd\.?|llc|limited|company|co\.?|group|holdings?)\z"
REFUSALS = ("no such info", "cannot find", "not available", "not found", "no information", "unable to answer", "don't have that information", "not provided", "not in the context")
HEADING = r"^(?:ITEM\s+\d+[A-Z]?\.|[A-Z][A-Za-z\s]+$|\d+\.\s+[A-Z][A-Za-z\s]+$|[A-Z][A-Za-z\s]+:[A-Za-z\s]+$)"
PUNCTUATION_FROM = "​\x91\x92\x93\x94\x95\x96\x97\x98‐‑‒–―‘ “”"
PUNCTUATION_TO = " ''\"\"•--˜-----' \"\""
PUNCTUATION_GONE = "\x99™—’"

BLANK = r"[^\S\r\n]"
DASHES = "[-‒–—]*"
# Lines and marks that are no text, and what stands instead, in this order; results must be the same.
PAGE_MARKS = (
    (r"(?i)(ITEM|PART)(\s+\d{1,2}[AB]?)([\-•])", "$1$2 $3 "),
    (rf"(?im)\n{BLANK}*(TABLE\s+OF\s+CONTENTS|INDEX\s+TO\s+FINANCIAL\s+STATEMENTS|BACK\s+TO\s+CONTENTS|QUICKLINKS){BLANK}*\n", "\n"),
    (rf"\n{BLANK}*{DASHES}\d+{DASHES}{BLANK}*\n", "\n"),
    (rf"\n{BLANK}*\d+{BLANK}*\n", "\n"),
    (rf"(?i)[\n\s]F{DASHES}\d+", ""),
    (rf"(?i)\n{BLANK}*Page\s[\d*]+{BLANK}*\n", ""),
)
# Tags that end a block (a tag without a name does, too) and a cell.
BLOCK_TAGS, CELL_TAGS = ("div", "tr", "p", "li", ""), ("th", "td")


def strip(x: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")


def words(x: Column) -> Column:
    """The words between white space, empty ones left out."""
    return F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")


def word_count(x: Column) -> Column:
    return F.size(words(x))


def normalize_text(x: Column) -> Column:
    """Lower case, stripped, and then each double newline a space."""
    return F.replace(strip(F.lower(x)), F.lit("\n\n"), F.lit(" "))


def normalize_entity(x: Column) -> Column:
    """normalize_text without one company suffix, final dots and commas and repeated blanks."""
    bare = F.regexp_replace(normalize_text(x), COMPANY_SUFFIX, "")
    return F.regexp_replace(F.regexp_replace(F.rtrim(bare, F.lit(".,")), r"(?U)\s+", " "), r"^ | $", "")


def normalize_answer(x: Column) -> Column:
    """Lower case; all but letters a to z, digits, percent signs, dots and white space is a space; blanks squeezed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(x), r"(?U)[^0-9a-z%.\s]", " "), r"(?U)\s+", " "), r"^ | $", "")


def refuses(said: Column, normalise_phrases: bool = False) -> Column:
    """A refusal phrase occurs in a normalised answer. The phrase with an apostrophe only can if phrases are normalised too."""
    phrases = [p.replace("'", " ") for p in REFUSALS] if normalise_phrases else REFUSALS
    return F.rlike(said, F.lit("|".join(phrases)))


def is_refusal(x: Column, normalise_phrases: bool = False) -> Column:
    """refuses, of the answer as it is."""
    return refuses(normalize_answer(x), normalise_phrases)


def collapse_lines(x: Column) -> Column:
    """Runs of newlines with blanks between them become one, single newlines a space, repeated spaces one."""
    breaks = F.regexp_replace(strip(x), r" *\n *", "\n")
    kept = F.regexp_replace(breaks, r"(?<!\n)\n(?!\n)", " ")
    return F.regexp_replace(F.regexp_replace(kept, r"\n{2,}", "\n"), r" {2,}", " ")


def clean_punctuation(x: Column) -> Column:
    """Typographic characters as plain ones, trademark signs, em dashes and right single quotes removed."""
    return F.translate(x, PUNCTUATION_FROM + PUNCTUATION_GONE, PUNCTUATION_TO)


def rejoin_headings(x: Column) -> Column:
    """PART, ITEM and SIGNATURE at a line's start without the blanks between their letters, if a blank (and of the first two a number) follows."""
    spaced = lambda word: f"{BLANK}*".join(f"({c})" for c in word)
    for word, after, groups in (("PART", r"(?:\d{1,2}|[IV]{1,2})[AB]?", 7), ("ITEM", r"\d{1,2}[AB]?", 7)):
        x = F.regexp_replace(x, rf"(?i)(\n{BLANK}*){spaced(word)}({BLANK}+)({after})", "".join(f"${i}" for i in range(1, groups + 1)))
    plural = rf"(?:(S)|(\(){BLANK}*(s){BLANK}*(\)))?"
    return F.regexp_replace(x, rf"(?i)(\n{BLANK}*){spaced('SIGNATURE')}{BLANK}*{plural}({BLANK}+)", "".join(f"${i}" for i in range(1, 16)))


def clean_text(x: Column) -> Column:
    """A filing's text with plain punctuation, whole headings and no page marks, in this order."""
    return clean_page_marks(rejoin_headings(clean_punctuation(x)))


def clean_page_marks(x: Column) -> Column:
    """Without lines of contents headings and page numbers, and with blanks around what follows an item number."""
    for pattern, instead in PAGE_MARKS:
        x = F.regexp_replace(x, pattern, instead)
    return x


def safe_name(x: Column) -> Column:
    """A file name: forbidden characters and white space as single underscores, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, r'[\\/*?:"<>|\s]', "_"), "_+", "_"), F.lit("_"))


def closing(names: Sequence[str]) -> str:
    """A pattern of the closing tags of these names."""
    return rf"<\s*/\s*(?:{'|'.join(names)})\s*>"


def strip_tags(x: Column) -> Column:
    """Text of simple HTML without entities: blocks and breaks end in a blank line, cells are set apart."""
    apart = F.regexp_replace(x, rf"({closing(BLOCK_TAGS)}|<br\s*/?>)", "$1\n\n")
    return F.regexp_replace(F.regexp_replace(apart, f"({closing(CELL_TAGS)})", " $1 "), "<[^>]*>", "")


def pdf_link(html: Column) -> Column:
    """The first link to a .pdf, null without one."""
    return F.nullif(F.regexp_extract(html, r"(?i)href=[\"']([^\"']+\.pdf)", 1), F.lit(""))


@F.pandas_udf(T.StringType())
def joined_url(page: pd.Series, link: pd.Series) -> pd.Series:
    """The address that a link on a page leads to, null without a link."""
    from urllib.parse import urljoin

    return pd.Series([None if x is None or x != x else urljoin(p or "", x) for p, x in zip(page, link, strict=True)], dtype=object)


def is_heading(x: Column) -> Column:
    """At most ten words in one of the heading forms. Forms with 'and' and 'of' are title-cased lines, too."""
    return (word_count(x) <= 10) & F.rlike(strip(x), F.lit(HEADING))


def has_table(x: Column) -> Column:
    """Markdown table marks: a pipe with dashes, or three pipes."""
    pipes = F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit("")))
    return F.contains(x, F.lit("|")) & (F.contains(x, F.lit("--")) | F.contains(x, F.lit("-|-")) | (pipes >= 3))


def digit_share(x: Column) -> Column:
    """Digits as a share of what is not white space, 0 for nothing."""
    solid = F.length(F.regexp_replace(x, r"(?U)\s", ""))
    return F.when(solid > 0, (F.length(x) - F.length(F.regexp_replace(x, r"(?U)\d", ""))) / solid).otherwise(0.0)


def space_share(x: Column) -> Column:
    size = F.length(x)
    return F.when(size > 0, (size - F.length(F.regexp_replace(x, r"(?U)\s", ""))) / size).otherwise(0.0)


def delete_sentences(x: Column, sentences: Column) -> Column:
    """x without any occurrence, whatever its case, of each sentence in turn."""
    quoted = lambda s: F.concat(F.lit(r"(?i)\Q"), F.replace(s, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.aggregate(F.filter(sentences, lambda s: s != ""), x, lambda text, s: F.regexp_replace(text, quoted(s), F.lit("")))


def format_context(docs: Column) -> Column:
    """Numbered documents, joined by blank lines."""
    return F.array_join(F.transform(docs, lambda d, i: F.concat(F.lit("[Doc "), (i + 1).cast("string"), F.lit("] "), d)), "\n\n")


def parse_answer(x: Column) -> Column:
    """The answer of a JSON reply; else what follows an answer key, without quotes and backslashes; else the reply."""
    loose = F.nullif(F.regexp_replace(F.regexp_extract(x, r'"?answer"?\s*:\s*(.*)', 1), r'["\\\\]', ""), F.lit(""))
    return F.coalesce(F.from_json(x, "answer string")["answer"], loose, x)


def preview(x: Column, size: int = 100) -> Column:
    return F.when(F.length(x) > size, F.concat(F.left(x, F.lit(size)), F.lit("..."))).otherwise(x)


def path_hash(ids: Column) -> Column:
    return F.sha1(F.array_join(ids, ","))


def build_id(*parts: Column) -> Column:
    """The parts joined by underscores, with spaces as underscores."""
    return F.replace(F.concat_ws("_", *parts), F.lit(" "), F.lit("_"))


def padded_number(x: Column, size: int = 6) -> Column:
    """Zero-padded, and never cut."""
    text = x.cast("string")
    return F.lpad(text, F.greatest(F.lit(size), F.length(text)), F.lit("0"))


def padded_cik(x: Column) -> Column:
    """Ten digits with leading zeros; anything else stays."""
    return F.when(F.rlike(x, F.lit(r"^\d{1,9}$")), F.lpad(x, 10, "0")).otherwise(x)


def order_key(key: Column, seed: int = 42) -> Column:
    """A portable order that stands for a seeded shuffle."""
    return F.sha1(F.concat(F.lit(f"{seed}|"), key.cast("string")))
