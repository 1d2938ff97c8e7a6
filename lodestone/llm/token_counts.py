"""Token counts: Arrow-batched encoding that returns lengths only.

Batches are cut by bytes of text, and texts longer than ``split_bytes`` are split where a space follows a
non-space character. A pre-token of the byte-level pattern never runs from a non-space character into white
space, so such a cut never changes the tokens.

A byte-level BPE .json whose merges are in the order of the ids is also given to the rank-based encoder, which
has the same merges and pattern. It counts the texts whose characters all lie in ``SAFE``, where both
libraries class letters, digits and white space alike; every other text goes to the tokenizers library itself.

Null or empty text: zero bytes, zero tokens. Repeated rows are counted each. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_blocks, text_column

#: Outside ASCII controls and the Latin blocks below U+0250, leave the classes to the tokenizers library.
SAFE = r"\t\n\r\x20-\x7e¡-¬®-ɏ"
UNSAFE = re.compile(f"[^{SAFE}]")
#: The byte-level pattern, as the tokenizer files state it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPLIT = re.compile(r"(?<=\S)(?= )")
_loaded: dict[str, "Counter"] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Token bytes to id, if the file is a byte-level BPE whose merges are in the order of their ids."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if model.get("type") != "BPE" or not plain or spec.get("normalizer") or spec.get("post_processor"):
        return None
    if model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback"):
        return None
    vocab, letters = model["vocab"], byte_alphabet()
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [vocab.get(t, -1) for t in made]
    if min(ids, default=-1) < 0 or any(a >= b for a, b in zip(ids, ids[1:], strict=False)):
        return None
    tokens = {*letters, *made}
    return {bytes(letters[c] for c in t): vocab[t] for t in tokens} if tokens <= vocab.keys() else None


class Counter:
    """Token counts of texts by one tokenizer file."""

    def __init__(self, path: str, split_bytes: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.split_bytes, self.ranked, self.special = split_bytes, None, None
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.library = lambda texts: [len(x) for x in self.pieces.encode(texts, num_threads=1)]
            self.byte_level = False
            return
        import tiktoken
        from tokenizers import Tokenizer

        self.tokens = Tokenizer.from_file(path)
        self.tokens.no_truncation()
        self.tokens.no_padding()
        self.library = lambda texts: [len(x.ids) for x in self.tokens.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        ranks = _ranks(spec)
        self.byte_level = ranks is not None
        if ranks and all(a["special"] and not (a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"]) for a in added):
            special = {a["content"]: a["id"] for a in added}
            ranks = {k: v for k, v in ranks.items() if v not in special.values()}
            self.special = re.compile("|".join(map(re.escape, special))) if special else None
            self.ranked = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def parts(self, text: str) -> list[str]:
        """The text, or for a long one its pieces between safe boundaries."""
        if len(text) <= self.split_bytes or not self.byte_level:
            return [text]
        out, low = [], 0
        while len(text) - low > self.split_bytes:
            cut = _SPLIT.search(text, low + self.split_bytes)
            if not cut:
                break
            out.append(text[low : cut.start()])
            low = cut.start()
        return [*out, text[low:]]

    def count(self, texts: list[str]) -> list[int]:
        out, slow = [0] * len(texts), []
        for i, text in enumerate(texts):
            for part in self.parts(text):
                if self.ranked is None or UNSAFE.search(part):
                    slow.append((i, part))
                elif self.special is not None and self.special.search(part):
                    out[i] += len(self.ranked.encode(part, allowed_special="all"))
                else:
                    out[i] += len(self.ranked.encode_ordinary(part))
        for (i, _), n in zip(slow, self.library([p for _, p in slow]) if slow else [], strict=True):
            out[i] += n
        return out


def counter(path: str) -> Counter:
    """One per Python worker."""
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, batch_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(tokenizer_path)
        for batch in arrow_blocks(batches, "text", batch_bytes):
            text = text_column(batch)
            n = np.array(tokens.count(text.to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.cast(pc.binary_length(text), pa.int64()), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
