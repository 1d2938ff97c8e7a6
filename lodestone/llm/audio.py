"""Telephony audio columns: mu-law, A-law and IMA ADPCM to resampled 16-bit PCM.

Mu-law and A-law are expanded by 256-entry lookup tables built from their rules. ADPCM blocks are decoded by
numpy across blocks: one step handles the same nibble of every block of a batch.

``store_bytes`` keeps any payload losslessly as the 8-bit samples (or ADPCM blocks) of a WAV file, ``decode_media``
turns such files into a column of PCM at one rate, and ``audio_digest`` stores each text in the codec that its
CRC names, reads the file back, decodes it as ``decode_media`` does and describes both. Null or empty text: one
frame of 192 spaces. Null, damaged or other media: null rate and PCM. Equal texts give equal values; repeated rows
are described each. Other columns are not read, or, by ``decode_media``, pass through; where they are named rate or
pcm, the new ones take underscores until their names are free.

A batch holds about a megabyte of payload, or one longer payload; its PCM takes up to eight times that, and
blocks and resampling pass in pieces of fixed size.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import arrow_blocks, free_name, map_arrow, row_blocks, text_column

FRAME, RATE, FILL = 192, 8000, 32
MULAW, ALAW, IMA = 7, 6, 17
CODECS = (MULAW, ALAW, IMA)
#: Blocks decoded at once, and samples resampled at once.
BLOCKS, PIECE = 2048, 1 << 16

# The step sizes and index moves of IMA ADPCM.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
     130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282,
     1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493,
     10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32
)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent, size = code >> 4 & 7, (code & 0x0F) << 4
    size = np.where(exponent == 0, size + 8, size + 0x108 << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW_PCM, ALAW_PCM = mulaw_table(), alaw_table()


def _step_tables() -> tuple[np.ndarray, np.ndarray]:
    """What a nibble adds to the sample, and the next index, by index * 16 + nibble."""
    step, nibble = STEPS[:, None], np.arange(16)[None, :]
    size = (step >> 3) + (step >> 2) * (nibble & 1) + (step >> 1) * (nibble >> 1 & 1) + step * (nibble >> 2 & 1)
    index = np.clip(np.arange(len(STEPS))[:, None] + MOVES[None, :], 0, len(STEPS) - 1)
    return np.where(nibble & 8, -size, size).astype(np.int32).ravel(), index.astype(np.int32).ravel()


ADDS, NEXT = _step_tables()


def adpcm_pcm(blocks: np.ndarray) -> np.ndarray:
    """(blocks, 1 + 2 * (size - 4)) samples of IMA ADPCM mono blocks given as a (blocks, size) byte array.

    The header holds the first sample (16 bits, little endian) and the step index, which is clipped to its range.
    """
    n, size = blocks.shape
    out = np.empty((1 + 2 * (size - 4), n), np.int16)
    sample = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    out[0] = sample
    body = np.ascontiguousarray(blocks[:, 4:].T)
    for i in range(size - 4):
        for k, nibble in ((1, body[i] & 0x0F), (2, body[i] >> 4)):
            at = (index << 4) + nibble
            sample = np.clip(sample + ADDS[at], -32768, 32767)
            index = NEXT[at]
            out[2 * i + k] = sample
    return out.T


def adpcm_encode(pcm: np.ndarray, size: int = FRAME) -> np.ndarray:
    """IMA ADPCM mono blocks of pcm, the last one filled with its last sample."""
    per = 1 + 2 * (size - 4)
    n = max(1, -(-len(pcm) // per))
    rows = np.pad(pcm.astype(np.int32), (0, n * per - len(pcm)), mode="edge" if len(pcm) else "constant").reshape(n, per)
    blocks = np.zeros((n, size), np.uint8)
    blocks[:, :2] = rows[:, 0].astype("<i2").view(np.uint8).reshape(n, 2)
    sample, index = rows[:, 0].copy(), np.zeros(n, np.int32)
    for i in range(1, per):
        move, step = rows[:, i] - sample, STEPS[index]
        nibble = np.minimum((np.abs(move) << 2) // step, 7) | np.where(move < 0, 8, 0)
        at = (index << 4) + nibble
        sample, index = np.clip(sample + ADDS[at], -32768, 32767), NEXT[at]
        blocks[:, 4 + (i - 1) // 2] |= (nibble << (4 * ((i - 1) % 2))).astype(np.uint8)
    return blocks


def resample(pcm: np.ndarray, up: int = 2, down: int = 1) -> np.ndarray:
    """pcm at up / down times its rate by linear interpolation in whole numbers."""
    if len(pcm) < 2 or up == down:
        return pcm.astype(np.int16)
    n = (len(pcm) - 1) * up // down + 1
    out = np.empty(n, np.int16)
    for first in range(0, n, PIECE):
        at = np.arange(first, min(n, first + PIECE), dtype=np.int64) * down
        low, part = at // up, at % up
        ahead = pcm[np.minimum(low + 1, len(pcm) - 1)].astype(np.int64)
        out[first : first + len(at)] = (pcm[low].astype(np.int64) * (up - part) + ahead * part) // up
    return out


def store_bytes(payload: bytes, codec: int = MULAW, rate: int = RATE, block: int = 1) -> bytes:
    """A mono WAV file with the payload as its 8-bit samples or blocks."""
    bits, extra = (4, struct.pack("<HH", 2, 1 + 2 * (block - 4))) if codec == IMA else (8, struct.pack("<H", 0))
    per_second = rate if codec != IMA else rate * block // (1 + 2 * (block - 4))
    head = struct.pack("<HHIIHH", codec, 1, rate, per_second, block, bits) + extra
    samples = len(payload) if codec != IMA else len(payload) // block * (1 + 2 * (block - 4))
    chunks = b"fmt " + struct.pack("<I", len(head)) + head + b"fact" + struct.pack("<II", 4, samples)
    chunks += b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """Codec, rate, block size and payload of a mono telephony WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, payload = 12, None, None
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            codec, channels, rate, _, block, _ = struct.unpack_from("<HHIIHH", media, at + 8)
            form = codec, channels, rate, block
        elif kind == b"data":
            payload = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None or payload is None or form[1] != 1:
        raise ValueError("not a mono WAV file with data")
    return form[0], form[2], form[3], payload


def decoded(media: list[bytes | None]) -> list[tuple[int, np.ndarray] | None]:
    """Rate and 16-bit samples of each telephony WAV file, None where it isn't one; ADPCM blocks of all files go together."""
    out: list[tuple[int, np.ndarray] | None] = [None] * len(media)
    waiting: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for i, data in enumerate(media):
        try:
            codec, rate, block, payload = read_wav(data or b"")
        except (ValueError, struct.error):
            continue
        body = np.frombuffer(payload, np.uint8)
        if codec == MULAW and rate:
            out[i] = rate, MULAW_PCM[body]
        elif codec == ALAW and rate:
            out[i] = rate, ALAW_PCM[body]
        elif codec == IMA and rate and block > 4:
            waiting.setdefault(block, []).append((i, rate, body[: len(body) // block * block].reshape(-1, block)))
    for block, files in waiting.items():
        ends = np.cumsum([len(x) for _, _, x in files])
        every = np.concatenate([x for _, _, x in files])
        pcm = np.empty((len(every), 1 + 2 * (block - 4)), np.int16)
        for low in range(0, len(every), BLOCKS):
            pcm[low : low + BLOCKS] = adpcm_pcm(every[low : low + BLOCKS])
        for (i, rate, x), end in zip(files, ends.tolist(), strict=True):
            out[i] = rate, pcm[end - len(x) : end].ravel()
    return out


def at_rate(found: tuple[int, np.ndarray] | None, to_rate: int) -> np.ndarray | None:
    if found is None:
        return None
    rate, pcm = found
    both = int(np.gcd(rate, to_rate))
    return resample(pcm, to_rate // both, rate // both).astype("<i2")


def decode_media(media: DataFrame, column: str = "media", to_rate: int = 16000) -> DataFrame:
    """media's rows with the columns rate and pcm (little-endian 16-bit samples at to_rate), null where it can't be read."""
    own = [free_name("rate", media.columns), free_name("pcm", media.columns)]
    schema = T.StructType([*media.schema.fields, T.StructField(own[0], T.IntegerType()), T.StructField(own[1], T.BinaryType())])
    at = media.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in row_blocks(batch.column(at)):
                part = batch.slice(low, high - low)
                pcm = [at_rate(x, to_rate) for x in decoded(part.column(at).to_pylist())]
                new = [pa.array([None if x is None else to_rate for x in pcm], pa.int32()), pa.array([None if x is None else x.tobytes() for x in pcm], pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], schema.names)

    return map_arrow(media, run, schema)


def payload_of(text: bytes) -> bytes:
    return text + bytes([FILL]) * (-len(text) % FRAME if text else FRAME)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string"


def audio_digest(docs: DataFrame, to_rate: int = 16000) -> DataFrame:
    """Stores each text as a telephony file, reads it back, decodes it to PCM at to_rate and describes both.

    feature: codec, samples, peak, sign changes and mean square of that PCM, all whole numbers.
    """
    names = [c.split()[0] for c in DIGEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_blocks(batches):
            texts = [x.encode() for x in text_column(batch).to_pylist()]
            media = []
            for text in texts:
                payload = payload_of(text)
                codec = CODECS[zlib.crc32(payload) % len(CODECS)]
                media.append(store_bytes(payload, codec, block=FRAME if codec == IMA else 1))
            rows = []
            for text, kept, found in zip(texts, media, decoded(media), strict=True):
                codec, _, _, payload = read_wav(kept)
                pcm = at_rate(found, to_rate)
                power = sum(int(x @ x) for i in range(0, len(pcm), PIECE) for x in [pcm[i : i + PIECE].astype(np.float64)])  # exact below 2^53
                turns = np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0))
                feature = ":".join(str(int(x)) for x in (codec, len(pcm), max(int(pcm.max()), -int(pcm.min())), turns, power // len(pcm)))
                rows.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(kept), hashlib.sha256(kept).hexdigest(), feature, pcm.nbytes, hashlib.sha256(pcm).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DIGEST)
