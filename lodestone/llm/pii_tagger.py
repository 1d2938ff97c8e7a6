"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions trained in numpy.

Base spans are the leftmost non-overlapping matches of each kind's pattern that pass its check; they always stay.
The tagger is trained on the labelled spans of a bounded sample (of about ``candidates`` distinct texts by hash,
``per_kind`` with each kind, and as many without, the lowest by hash). Labels are the base spans, and as a fifth kind
secrets: long values given to a name such as token or password. Forms that the patterns can't see are written in:
spelled-out "at" and "dot" in addresses, numbers without a plus sign or with other separators, other alphabets of
secrets. So it adds spans of such forms.

A text is searched where it has a digit, an @, a bracketed "at", or an "at" with a "dot" within 60 characters: windows
of ``WINDOW`` characters that overlap by half cover the stretches around them. Each window is decoded by Viterbi over tags; a character takes the tag of
the window in whose middle it lies, so overlapping decodings are reconciled over the whole text. A span is added
if its characters' mean probability is at least ``SURE``, it fits its kind's shape, and it touches no base span.

Null or empty text: no spans. Repeated rows are searched each. Positions are code points. Other columns are not
read, or, by ``redact``, pass through. Without a single base span in the sample nothing is added.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_blocks, map_arrow, text_column

KINDS = ("email", "ip", "card", "phone")
TAGGED = (*KINDS, "secret")
WINDOW, AROUND, SURE = 64, 40, 0.9
TAGS = 1 + 2 * len(TAGGED)  # outside, then begin and inside of each kind

# The base patterns. A digit run is never entered in its middle, so a lookbehind saves rescans.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HINT = re.compile(r"[0-9@]|[\[({]\s*at\s*[\])}]", re.IGNORECASE)
BARE = re.compile(r"\bat\b.{1,60}?\bdot\b", re.IGNORECASE | re.DOTALL)
#: What labels a secret in the sample: its value is group 2.
SECRET = re.compile(r"\b(token|secret|passw(?:or)?d|api[_-]?key|auth)\b\s{0,3}(?:=|:|=>)\s{0,3}[\"']?([A-Za-z0-9/+_.-]{16,200})", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """The leftmost matches of local@domain, in one pass over the @ signs."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        low = at
        while low > free and text[low - 1] in _LOCAL_SET:
            low -= 1
        if low < at and (m := DOMAIN.match(text, at + 1)):
            out.append((low, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    if not re.search("[0-9]", text):
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def secrets(text: str) -> list[tuple[str, int, int]]:
    return [("secret", *m.span(2)) for m in SECRET.finditer(text)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (TAGGED.index(s[0]), s[1:])))


# The tagger


def classes(text: str) -> np.ndarray:
    """A symbol for each character: ASCII as it is with all digits alike, letters beyond it 1, anything else 2."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(code < 128, code, np.where(code < 0x2000, 1, 2)).astype(np.int64)
    out[(out >= 48) & (out <= 57)] = 48
    return out


@dataclass
class Tagger:
    """Embeddings, the two directions' LSTM weights, output weights and CRF scores."""

    w: dict[str, np.ndarray]
    hidden: int


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """(steps, batch, hidden) states of inputs (steps, batch, size), and what the way back needs."""
    n = u.shape[0]
    h = c = np.zeros((x.shape[1], n), np.float32)
    inputs = x @ w + b
    out, kept = np.empty((*x.shape[:2], n), np.float32), []
    for t in range(len(x)):
        z = inputs[t] + h @ u
        i, f, o = _sigmoid(z[:, :n]), _sigmoid(z[:, n : 2 * n]), _sigmoid(z[:, 2 * n : 3 * n])
        g = np.tanh(z[:, 3 * n :])
        before, held = h, c
        c = f * c + i * g
        s = np.tanh(c)
        h = o * s
        out[t] = h
        kept.append((i, f, o, g, s, before, held))
    return out, kept


def _lstm_back(x: np.ndarray, w: np.ndarray, u: np.ndarray, kept: list, error: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = u.shape[0]
    dw, du, db, dx = np.zeros_like(w), np.zeros_like(u), np.zeros(4 * n, np.float32), np.empty_like(x)
    dh = dc = np.zeros((x.shape[1], n), np.float32)
    for t in range(len(x) - 1, -1, -1):
        i, f, o, g, s, before, held = kept[t]
        dh = dh + error[t]
        dc = dc + dh * o * (1 - s * s)
        dz = np.concatenate([dc * g * i * (1 - i), dc * held * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dw += x[t].T @ dz
        du += before.T @ dz
        db += dz.sum(axis=0)
        dx[t] = dz @ w.T
        dh, dc = dz @ u.T, dc * f
    return dx, dw, du, db


def _emit(tagger: Tagger, symbols: np.ndarray) -> tuple[np.ndarray, tuple]:
    """(steps, batch, tags) scores of symbols (steps, batch)."""
    w = tagger.w
    x = w["embed"][symbols]
    ahead, kept = _lstm(x, w["w1"], w["u1"], w["b1"])
    behind, back = _lstm(x[::-1], w["w2"], w["u2"], w["b2"])
    both = np.concatenate([ahead, behind[::-1]], axis=2)
    return both @ w["out"] + w["bias"], (x, kept, back, both)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def marginals(emit: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(steps, batch, tags) probabilities, expected moves, log partition of each sequence."""
    a, b = np.empty_like(emit), np.zeros_like(emit)
    a[0] = emit[0]
    for t in range(1, len(emit)):
        a[t] = _log_sum(a[t - 1][:, :, None] + moves, 1) + emit[t]
    for t in range(len(emit) - 2, -1, -1):
        b[t] = _log_sum(moves + (emit[t + 1] + b[t + 1])[:, None, :], 2)
    z = _log_sum(a[-1], 1)
    pairs = np.zeros(moves.shape)
    for t in range(1, len(emit)):
        pairs += np.exp(a[t - 1][:, :, None] + moves + (emit[t] + b[t])[:, None, :] - z[:, None, None]).sum(axis=0)
    return np.exp(a + b - z[:, None]), pairs, z


def viterbi(emit: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """(steps, batch) best tags."""
    now, back = emit[0], np.zeros(emit.shape, np.int64)
    for t in range(1, len(emit)):
        ways = now[:, :, None] + moves
        back[t] = ways.argmax(axis=1)
        now = np.take_along_axis(ways, back[t][:, None, :], 1)[:, 0] + emit[t]
    out = np.empty(emit.shape[:2], np.int64)
    out[-1] = now.argmax(axis=1)
    for t in range(len(emit) - 1, 0, -1):
        out[t - 1] = np.take_along_axis(back[t], out[t][:, None], 1)[:, 0]
    return out


def legal_moves() -> np.ndarray:
    """0 where a tag may follow another, else a score that never wins: inside needs begin or inside of its kind."""
    out = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(TAGGED)):
        out[:, 2 + 2 * k] = -30
        out[1 + 2 * k, 2 + 2 * k] = out[2 + 2 * k, 2 + 2 * k] = 0
    return out


def train(windows: np.ndarray, tags: np.ndarray, hidden: int = 20, size: int = 12, epochs: int = 12, batch: int = 48, rate: float = 0.02, seed: int = 3) -> Tagger:
    """Adam on the sequences' log-likelihood; windows and tags are (n, WINDOW)."""
    rng = np.random.default_rng(seed)
    make = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    bias = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32)
    w = {"embed": make(128, size), "w1": make(size, 4 * hidden), "u1": make(hidden, 4 * hidden), "b1": bias, "w2": make(size, 4 * hidden), "u2": make(hidden, 4 * hidden), "b2": bias.copy(), "out": make(2 * hidden, TAGS), "bias": np.zeros(TAGS, np.float32), "moves": np.zeros((TAGS, TAGS), np.float32)}
    tagger, legal = Tagger(w, hidden), legal_moves()
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for low in range(0, len(order), batch):
            own = order[low : low + batch]
            x, y = windows[own].T, tags[own].T
            emit, (inputs, kept, back, both) = _emit(tagger, x)
            share, pairs, _ = marginals(emit, w["moves"] + legal)
            error = -share
            np.put_along_axis(error, y[:, :, None], np.take_along_axis(error, y[:, :, None], 2) + 1, 2)
            error = (error / len(own)).astype(np.float32)
            truth = np.zeros((TAGS, TAGS))
            np.add.at(truth, (y[:-1].ravel(), y[1:].ravel()), 1)
            into = error @ w["out"].T
            dx1, dw1, du1, db1 = _lstm_back(inputs, w["w1"], w["u1"], kept, into[:, :, :hidden])
            dx2, dw2, du2, db2 = _lstm_back(inputs[::-1], w["w2"], w["u2"], back, into[::-1, :, hidden:])
            embed = np.zeros_like(w["embed"])
            np.add.at(embed, x.ravel(), (dx1 + dx2[::-1]).reshape(-1, embed.shape[1]))
            gradient = {"embed": embed, "w1": dw1, "u1": du1, "b1": db1, "w2": dw2, "u2": du2, "b2": db2, "out": np.einsum("tbh,tbk->hk", both, error), "bias": error.sum(axis=(0, 1)), "moves": ((truth - pairs) / len(own)).astype(np.float32)}
            step += 1
            for k, g in gradient.items():
                g = np.clip(g, -5, 5)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] += rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    w["moves"] = w["moves"] + legal
    return tagger


def hints(text: str) -> list[tuple[int, int]]:
    """Where something may be personal, in order."""
    out = [m.span() for m in HINT.finditer(text)]
    if "dot" in text.lower():
        out = sorted([*out, *(m.span() for m in BARE.finditer(text))])
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """Where windows lie: around hints, merged."""
    out: list[list[int]] = []
    for start, end in hints(text):
        a, b = max(0, start - AROUND), min(len(text), end + AROUND)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def window_starts(low: int, high: int) -> list[int]:
    return [low] if high - low <= WINDOW else [*range(low, high - WINDOW, WINDOW // 2), high - WINDOW]


def shape_holds(kind: str, span: str) -> bool:
    """What every span of a kind has, however it is written."""
    digits = _digits(span)
    if kind == "email":
        return len(span) >= 6 and bool(re.search(r"@|\bat\b", span, re.IGNORECASE)) and bool(re.search(r"\.|\bdot\b", span, re.IGNORECASE))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= len(digits) <= 15 and not re.search("[A-Za-z]", span)
    if kind == "secret":
        return len(span) >= 16 and bool(digits) and not re.search(r"\s", span) and bool(re.search("[A-Za-z]", span))
    parts = re.findall("[0-9]+", span)
    return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)


def added_spans(tagger: Tagger | None, texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """The spans of each text that the tagger adds to its base spans."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if tagger is None:
        return out
    jobs = []
    for i, text in enumerate(texts):
        for low, high in stretches(text):
            jobs.append((i, low, high, classes(text[low:high])))
    rows = [(j, s - low) for j, (_, low, high, _) in enumerate(jobs) for s in window_starts(low, high)]
    tags = [np.zeros(high - low, np.int64) for _, low, high, _ in jobs]
    sure = [np.zeros(high - low) for _, low, high, _ in jobs]
    for first in range(0, len(rows), 1024):
        own = rows[first : first + 1024]
        x = np.zeros((WINDOW, len(own)), np.int64)
        for c, (j, s) in enumerate(own):
            part = jobs[j][3][s : s + WINDOW]
            x[: len(part), c] = part
        emit, _ = _emit(tagger, x)
        best, share = viterbi(emit, tagger.w["moves"]), marginals(emit, tagger.w["moves"])[0]
        for c, (j, s) in enumerate(own):
            n = min(WINDOW, len(tags[j]) - s)
            # the window's middle, or up to the stretch's own ends
            a = 0 if s == 0 else WINDOW // 4
            b = n if s + n == len(tags[j]) else WINDOW - WINDOW // 4
            tags[j][s + a : s + b] = best[a:b, c]
            sure[j][s + a : s + b] = np.take_along_axis(share[a:b, c], best[a:b, c][:, None], 1)[:, 0]
    for (i, low, _, _), tag, p in zip(jobs, tags, sure, strict=True):
        begins = np.flatnonzero(tag % 2 == 1)
        for a in begins.tolist():
            kind, b = int(tag[a]) // 2, a + 1
            while b < len(tag) and tag[b] == tag[a] + 1:
                b += 1
            start, end = low + a, low + b
            clear = all(end <= x or start >= y for _, x, y in base[i])
            whole = not (start and texts[i][start - 1].isalnum()) and not (end < len(texts[i]) and texts[i][end].isalnum())
            if clear and whole and p[a:b].mean() >= SURE and shape_holds(TAGGED[kind], texts[i][start:end]):
                out[i].append((TAGGED[kind], start, end))
    return out


def disguise(kind: str, span: str, rng: np.random.Generator) -> str:
    """Another way to write a span, one that the base pattern of its kind doesn't see."""
    if kind == "email":
        at, dot = [(" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" (at) ", "."), (" at ", " dot ")][rng.integers(5)]
        local, _, domain = (re.sub("[0-9]", "", span) if rng.integers(2) else span).partition("@")
        local = local.strip(".") or "me"
        return local + at + domain.replace(".", dot)
    if kind == "secret":
        letters = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFabcdefghijkQRSTUVWXYZuvwxyz0123456789/+_-"][rng.integers(3)]
        return "".join(letters[i] for i in rng.integers(0, len(letters), rng.integers(20, 49)))
    digits = _digits(span)
    if kind == "phone":
        return [f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}", f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}", f"00{digits[:-10]} {digits[-10:-7]} {digits[-7:-4]} {digits[-4:]}"][rng.integers(3)]
    if kind == "card":
        mark = "._/"[rng.integers(3)]
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return span.replace(".", ["[.]", "(.)"][rng.integers(2)])


def examples(texts: list[str], seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags of texts, each span once as it is and once disguised."""
    rng, xs, ys = np.random.default_rng(seed), [], []

    def take(text: str, spans: list[tuple[str, int, int]]) -> None:
        tags = np.zeros(len(text), np.int64)
        for kind, a, b in spans:
            tags[a], tags[a + 1 : b] = 1 + 2 * TAGGED.index(kind), 2 + 2 * TAGGED.index(kind)
        symbols = classes(text)
        for low, high in stretches(text):
            for s in window_starts(low, high):
                x, y = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
                n = min(WINDOW, high - s)
                x[:n], y[:n] = symbols[s : s + n], tags[s : s + n]
                xs.append(x)
                ys.append(y)

    for text in texts:
        flat: list[tuple[str, int, int]] = []
        for s in sorted(base_spans(text) + secrets(text), key=lambda s: (s[1], -s[2])):
            if not flat or s[1] >= flat[-1][2]:
                flat.append(s)
        take(text, flat)
        if flat:
            out, moved, low = [], [], 0
            for kind, a, b in flat:
                out.append(text[low:a])
                begin = sum(map(len, out))
                out.append(disguise(kind, text[a:b], rng))
                moved.append((kind, begin, begin + len(out[-1])))
                low = b
            take("".join([*out, text[low:]]), moved)
    return (np.array(xs), np.array(ys)) if xs else (np.zeros((0, WINDOW), np.int64), np.zeros((0, WINDOW), np.int64))


def learn(docs: DataFrame, per_kind: int = 80, longest: int = 20_000, candidates: int = 100_000) -> Tagger | None:
    """The tagger trained on at most per_kind texts (of at most longest characters) that look like each kind, and of others with hints."""
    text, key = F.col("text"), F.xxhash64("text")
    looks = (F.when(text.rlike(r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\."), 0).when(text.rlike(r"\+[0-9][ ().0-9-]+[0-9]"), 1)
             .when(text.rlike(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]"), 2).when(text.rlike(r"(?i)\b(token|secret|passw|api.?key|auth)"), 3)
             .when(text.rlike(r"[0-9]{12}"), 4).when(text.rlike(r"[0-9@]"), 5))
    share = min(1.0, candidates / max(docs.count(), 1))
    some = docs.select("text", key.alias("h")).where(text.isNotNull() & (F.length(text) <= longest) & (F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))))
    # a text once, however often it is copied
    near = some.groupBy("h").agg(F.first("text").alias("text")).withColumn("looks", looks).where("looks is not null")
    few = near.withColumn("nth", F.row_number().over(Window.partitionBy("looks").orderBy("h"))).where(F.col("nth") <= per_kind)
    texts = [r["text"] for r in few.orderBy("looks", "h").select("text").collect()]
    x, y = examples(texts)
    return train(x, y) if y.any() else None


def spans_of(tagger: Tagger | None, texts: list[str]) -> tuple[list[list[tuple[str, int, int]]], list[list[tuple[str, int, int]]]]:
    """Base spans and added spans of each text."""
    base = [base_spans(t) if HINT.search(t) else [] for t in texts]
    return base, added_spans(tagger, texts, base)


def find_personal(docs: DataFrame, per_kind: int = 80) -> DataFrame:
    """doc_id, counts of base spans, base_sha256, spans, and the numbers of all and of added ones of each row of docs (doc_id, text)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tagger = docs.sparkSession.sparkContext.broadcast(learn(own, per_kind))  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_blocks(batches):
            base, more = spans_of(tagger.value, text_column(batch).to_pylist())
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string())
            spans = pa.array([joined(b + m) for b, m in zip(base, more, strict=True)], pa.string())
            total, added = pa.array([len(b) + len(m) for b, m in zip(base, more, strict=True)], pa.int64()), pa.array([len(m) for m in more], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, spans, total, added], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans", "n_added"])

    return own.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_added long")


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span's kind in its place; of overlapping spans the first counts, and covers what they cover together."""
    out, low = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= low:
            out += [text[low:a], f"[{kind.upper()}]"]
        low = max(low, b)
    return "".join([*out, text[low:]])


def redact(docs: DataFrame, per_kind: int = 80) -> DataFrame:
    """docs with personal data in text replaced by its kind."""
    tagger = docs.sparkSession.sparkContext.broadcast(learn(docs, per_kind))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_blocks(batches, trim=True):
            texts = batch.column(at).to_pylist()
            base, more = spans_of(tagger.value, [t or "" for t in texts])
            columns = list(batch.columns)
            columns[at] = pa.array([t if t is None else redacted(t, b + m) for t, b, m in zip(texts, base, more, strict=True)], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return map_arrow(docs, run, docs.schema)
