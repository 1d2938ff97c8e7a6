"""Query and document perturbations: seeded and deterministic, the best candidate by similarity."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keyboard rows, look-alike letters and words that stay.
KEYBOARD = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
HOMOGLYPHS = {"a": "а", "c": "с", "e": "е", "i": "і", "o": "о", "p": "р", "s": "ѕ", "x": "х", "y": "у"}
STOPWORDS = frozenset("a an and are as at be by for from has he in is it its of on or that the to was were what when where which who will with".split())


def neighbours(letter: str) -> str:
    """The letters next to it on the keyboard."""
    for r, row in enumerate(KEYBOARD):
        if (i := row.find(letter)) >= 0:
            near = row[max(0, i - 1) : i] + row[i + 1 : i + 2]
            for other in KEYBOARD[max(0, r - 1) : r] + KEYBOARD[r + 1 : r + 2]:
                near += other[i : i + 1]
            return near
    return ""


#: Each letter's neighbours.
NEAR = {c: neighbours(c) for row in KEYBOARD for c in row}


def _hash(*parts: Column | str) -> Column:
    """32 bits that stand for a seeded draw, the same wherever they are drawn."""
    text = F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha1(text), 1, 8), 16, 10).cast("long")


def _letter(c: Column) -> Column:
    return F.rlike(c, F.lit(r"\p{L}"))


def core(word: Column) -> Column:
    """The word in lower case without marks at its ends."""
    return F.lower(F.regexp_replace(word, r"^[.,;:?!]+|[.,;:?!]+$", ""))


def _drawn(runs: Column, draw: Column | str, share: float) -> Column:
    """The places of the words that change, a share of all, at least one: stopwords, one-letter words and words without letters stay."""
    word = lambda w: F.rlike(w, F.lit(r"^\S"))
    able = F.filter(F.transform(runs, lambda w, i: F.struct(_hash(draw, i).alias("h"), i.alias("i"), (word(w) & (F.length(w) > 1) & ~core(w).isin(sorted(STOPWORDS)) & _letter(w)).alias("ok"))), lambda x: x["ok"])
    count = F.greatest(F.lit(1), F.floor(F.size(F.filter(runs, word)) * share + 0.5)).cast("int")
    return F.transform(F.slice(F.array_sort(able), F.lit(1), count), lambda x: x["i"])


def _within(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of a value that is worked out once."""
    return F.transform(F.array(value), then)[0]


def _edited(w: Column, h: Column) -> Column:
    """A word with one slip at one of its letters: the letter left out, changed with the next, hit beside it, or like it."""
    near = F.map_from_arrays(F.lit(list(NEAR)), F.lit(list(NEAR.values())))
    alike = F.map_from_arrays(F.lit(list(HOMOGLYPHS)), F.lit(list(HOMOGLYPHS.values())))
    places = F.filter(F.sequence(F.lit(1), F.length(w)), lambda i: _letter(F.substr(w, i, F.lit(1))))

    def slip(x: Column) -> Column:
        at, letter = x["at"], F.lower(F.substr(w, x["at"], F.lit(1)))
        before, after = F.substr(w, F.lit(1), at - 1), F.substr(w, at + 1)
        ways = F.concat(F.lit(["delete", "swap"]), F.when(F.map_contains_key(near, letter), F.lit(["keyboard"])).otherwise(F.lit([]).cast("array<string>")), F.when(F.map_contains_key(alike, letter), F.lit(["homoglyph"])).otherwise(F.lit([]).cast("array<string>")))
        way, keys = F.get(ways, (F.floor(h / 64) % F.size(ways)).cast("int")), F.element_at(near, letter)
        first = F.when(at < F.length(w), at).otherwise(at - 1)  # of the two letters that change places
        swapped = F.concat(F.substr(w, F.lit(1), first - 1), F.substr(w, first + 1, F.lit(1)), F.substr(w, first, F.lit(1)), F.substr(w, first + 2))
        hit = F.substr(keys, (F.floor(h / 4096) % F.length(keys)).cast("int") + 1, F.lit(1))
        return F.when(way == "delete", F.concat(before, after)).when(way == "swap", swapped).when(way == "keyboard", F.concat(before, hit, after)).otherwise(F.concat(before, F.element_at(alike, letter), after))

    return _within(F.struct(F.get(places, (h % F.size(places)).cast("int")).alias("at")), slip)


RUNS = r"(\s+|\S+)"


def character_level(key: Column, text: Column, attempt: Column | None = None, seed: int = 42, share: float = 0.1) -> Column:
    """The text with slips in a share of its words, drawn by hashes of seed, key and attempt. Blanks stay as they are; a null text is null."""
    draw = F.concat_ws("|", F.lit(f"{seed}|char"), key.cast("string"), (F.lit(0) if attempt is None else attempt).cast("string"))
    whole = lambda x: F.array_join(F.transform(x["runs"], lambda w, i: F.when(F.array_contains(x["drawn"], i), _edited(w, _hash(x["draw"], i, "slip"))).otherwise(w)), "")
    bound = lambda x: _within(F.struct(x["runs"].alias("runs"), x["draw"].alias("draw"), _drawn(x["runs"], x["draw"], share).alias("drawn")), whole)
    return F.when(text.isNotNull(), _within(F.struct(F.regexp_extract_all(text, F.lit(RUNS), 1).alias("runs"), draw.alias("draw")), bound))


def word_level(df: DataFrame, key: str, text: str, near: DataFrame, attempt: int = 0, seed: int = 42, share: float = 0.1, out: str = "perturbed") -> DataFrame:
    """df with a share of the text's words replaced by near ones. near: word, options (a list); words that it doesn't have stay.

    The drawn words are looked up by a join, so the table of near words may be of any size. key tells rows apart.
    """
    draw = F.concat_ws("|", F.lit(f"{seed}|word"), F.col(key).cast("string"), F.lit(attempt))
    rows = df.withColumns({"_runs": F.regexp_extract_all(F.col(text), F.lit(RUNS), 1), "_draw": draw})
    places = rows.select(key, "_draw", F.explode(_within(F.struct("_runs", "_draw"), lambda x: F.transform(_drawn(x["_runs"], x["_draw"], share), lambda i: F.struct(i.alias("i"), F.get(x["_runs"], i).alias("w"))))).alias("x"))
    found = places.select(key, "_draw", "x.*").withColumn("_core", core(F.col("w"))).join(near.select(F.col("word").alias("_core"), "options"), "_core").where("size(options) > 0")
    pick = F.get("options", (_hash(F.col("_draw"), F.col("i"), "near") % F.size("options")).cast("int"))
    marks = F.concat(F.regexp_extract("w", r"^[.,;:?!]*", 0), pick, F.regexp_extract("w", r"[.,;:?!]*$", 0))
    told = found.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", marks.alias("w")))).alias("_told"))  # a share of one text's words
    changed = F.transform("_runs", lambda w, i: F.coalesce(F.try_element_at("_told", i), w))
    return rows.join(told, key, "left").withColumn(out, F.when(F.col("_told").isNull(), F.col(text)).otherwise(F.array_join(changed, ""))).select(*df.columns, out)


def best_candidates(candidates: DataFrame, keys: Sequence[str], accept: float | None = 0.85) -> DataFrame:
    """One of each key's candidates (attempt, candidate, similarity): the first that is accepted, else the first of the best."""
    pick = F.struct("candidate", "similarity")
    best = F.max_by(pick, F.struct("similarity", -F.col("attempt")))
    chosen = best if accept is None else F.coalesce(F.min_by(F.when(F.col("similarity") >= accept, pick), F.when(F.col("similarity") >= accept, F.col("attempt"))), best)
    return candidates.where("candidate is not null").groupBy(*keys).agg(chosen.alias("c")).select(*keys, "c.candidate", "c.similarity")


def needed(qa: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct chunk ids, and (chunk ids, sentences) pairs, that document perturbations are made for."""
    ids = qa.select(F.explode("answer_chunk_ids").alias("chunk_id")).distinct()
    return ids, qa.select("answer_chunk_ids", "source_sentences").distinct()


def without_sentences(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(answer_chunk_ids, source_sentences, pos, chunk_id, text): each pair's chunks without its sentences; unknown chunks are empty."""
    from lodestone.functions.text import delete_sentences

    rows = pairs.select("*", F.posexplode("answer_chunk_ids").alias("pos", "chunk_id")).join(chunks.select("chunk_id", "text"), "chunk_id", "left")
    return rows.select("answer_chunk_ids", "source_sentences", "pos", "chunk_id", delete_sentences(F.coalesce("text", F.lit("")), F.col("source_sentences")).alias("text"))


def token_similarity(a: Column, b: Column) -> Column:
    """A stand-in for embeddings: Jaccard similarity of the lower-cased words."""
    x, y = F.array_distinct(F.split(F.lower(a), r"\s+")), F.array_distinct(F.split(F.lower(b), r"\s+"))
    return F.round(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)), 6)
