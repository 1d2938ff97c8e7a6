import hashlib
import struct
import wave
import zlib

import numpy as np

from lodestone.llm.audio import ALAW, ALAW_PCM, FRAME, IMA, MULAW, MULAW_PCM, STEPS, adpcm_encode, adpcm_pcm, audio_digest, decode_media, decoded, payload_of, read_wav, resample, store_bytes


def mulaw(code):
    """One mu-law byte by the rule of G.711."""
    code = ~code & 0xFF
    size = (((code & 15) * 2 + 33) << (code >> 4 & 7)) - 33
    return (-size if code & 128 else size) * 4


def alaw(code):
    """One A-law byte by the rule of G.711."""
    code ^= 0x55
    segment, mantissa = code >> 4 & 7, code & 15
    size = 2 * mantissa + 1 if segment == 0 else (2 * mantissa + 33) << (segment - 1)
    return (size if code & 128 else -size) * 8


def adpcm(block):
    """The samples of one IMA block, one nibble at a time."""
    sample, index = struct.unpack_from("<hB", block)
    index = min(index, 88)
    out = [sample]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(STEPS[index])
            move = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                if nibble & bit:
                    move += part
            sample = max(-32768, min(32767, sample - move if nibble & 8 else sample + move))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[nibble & 7]))
            out.append(sample)
    return out


def doubled(pcm):
    out = []
    for a, b in zip(pcm, pcm[1:]):
        out += [a, (a + b) // 2]
    return [*out, pcm[-1]]


def test_tables_follow_the_rules():
    assert MULAW_PCM.tolist() == [mulaw(i) for i in range(256)]
    assert ALAW_PCM.tolist() == [alaw(i) for i in range(256)]
    assert (MULAW_PCM[0], MULAW_PCM[255], MULAW_PCM[128], ALAW_PCM[0xD5], ALAW_PCM[0x2A]) == (-32124, 0, 32124, 8, -32256)


def test_adpcm_against_one_nibble_at_a_time():
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (50, 37)).astype(np.uint8)
    assert adpcm_pcm(blocks).tolist() == [adpcm(b.tobytes()) for b in blocks]
    tone = (np.sin(np.arange(2000) / 9) * 9000).astype(np.int16)
    back = adpcm_pcm(adpcm_encode(tone)).ravel()[: len(tone)]
    assert np.abs(back.astype(int) - tone).mean() < 300


def test_resample():
    rng = np.random.default_rng(2)
    pcm = rng.integers(-32768, 32768, 70_000).astype(np.int16)
    assert resample(pcm).tolist() == doubled(pcm.tolist())
    for up, down in ((1, 1), (2, 3), (3, 2), (1, 5)):
        got = resample(pcm[:100], up, down)
        for i, x in enumerate(got.tolist()):
            low, part = divmod(i * down, up)
            assert x == (int(pcm[low]) * (up - part) + int(pcm[min(low + 1, 99)]) * part) // up
    assert resample(pcm[:1]).tolist() == [pcm[0]] and len(resample(pcm[:0])) == 0


def test_files_round_trip(tmp_path):
    for codec, block in ((MULAW, 1), (ALAW, 1), (IMA, FRAME)):
        for n in (FRAME, 5 * FRAME):
            payload = bytes(np.random.default_rng(n).integers(0, 256, n).astype(np.uint8))
            media = store_bytes(payload, codec, block=block)
            assert read_wav(media) == (codec, 8000, block, payload)
    (found,) = decoded([store_bytes(b"\x00\xff\x80", MULAW)])
    assert found[0] == 8000 and found[1].tolist() == [-32124, 0, 32124]
    plain = tmp_path / "pcm.wav"
    with wave.open(str(plain), "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(8000), f.writeframes(b"abcd")
    assert decoded([plain.read_bytes(), None, b"", b"RIFF", media[:30], b"x" * 100]) == [None] * 6


def test_decode_media_stores_resampled_pcm(spark):
    rng = np.random.default_rng(3)
    payload = bytes(rng.integers(0, 256, 3 * FRAME).astype(np.uint8))
    files = [store_bytes(payload, MULAW), store_bytes(payload, ALAW), store_bytes(payload, IMA, block=FRAME), store_bytes(payload, MULAW, rate=16000), b"junk", None, store_bytes(b"", MULAW)]
    df = spark.createDataFrame([(i, f, "old", "x") for i, f in enumerate(files)] + [(0, files[0], None, None)], "doc_id long, media binary, rate string, `a.b` string")
    out = decode_media(df)
    assert out.columns == ["doc_id", "media", "rate", "a.b", "rate_", "pcm"]
    rows = sorted(out.collect(), key=lambda r: r["doc_id"])
    assert len(rows) == 8
    rows = {r["doc_id"]: r for r in rows}
    data = list(payload)
    ima = [x for i in range(3) for x in adpcm(payload[i * FRAME : (i + 1) * FRAME])]
    for i, want in ((0, doubled([mulaw(b) for b in data])), (1, doubled([alaw(b) for b in data])), (2, doubled(ima)), (3, [mulaw(b) for b in data]), (6, [])):
        assert rows[i]["rate_"] == 16000
        assert np.frombuffer(rows[i]["pcm"], "<i2").tolist() == want
    assert all(rows[i]["rate_"] is None and rows[i]["pcm"] is None for i in (4, 5))
    assert decode_media(df.limit(0)).count() == 0


def test_digest_against_scalar_decoders(spark):
    texts = [None, "", "a", "é" * 200, "x" * 192, "same", "same", " " * 191] + [f"text {i} " * i for i in range(1, 40)]
    docs = spark.createDataFrame([(i if i else None, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    rows = {r["doc_id"]: r for r in audio_digest(docs).collect()}
    assert len(rows) == len(texts)
    seen = set()
    for i, text in enumerate(texts):
        r = rows[i or None]
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        codec = int(r["feature"].split(":")[0])
        seen.add(codec)
        media = store_bytes(payload, codec, block=FRAME if codec == IMA else 1)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        pcm = [x for k in range(0, len(payload), FRAME) for x in adpcm(payload[k : k + FRAME])] if codec == IMA else [(mulaw if codec == MULAW else alaw)(b) for b in payload]
        pcm = doubled(pcm)
        turns = sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:]))
        assert r["feature"] == f"{codec}:{len(pcm)}:{max(map(abs, pcm))}:{turns}:{sum(x * x for x in pcm) // len(pcm)}"
        assert (r["pcm_bytes"], r["pcm_sha256"]) == (2 * len(pcm), hashlib.sha256(np.array(pcm, '<i2')).hexdigest())
    assert seen == {MULAW, ALAW, IMA}
    assert rows[5][1:] == rows[6][1:] and rows[None]["feature"] == rows[1]["feature"]
    assert audio_digest(docs.limit(0)).count() == 0


def test_payload():
    assert payload_of(b"") == b" " * 192 and payload_of(b"a" * 192) == b"a" * 192 and len(payload_of(b"a" * 193)) == 384
