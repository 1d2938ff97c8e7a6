import re

import numpy as np

from lodestone.llm.pii_tagger import HINT, KINDS, TAGS, added_spans, base_spans, examples, find_personal, luhn, marginals, redact, redacted, train, viterbi

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(PATTERNS[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in re.findall("[0-9]+", m[0])), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_base_spans_match_plain_patterns():
    rng = np.random.default_rng(12)
    pool = ["a", "b.c", "@", ".", "1", "25", "255", "+", " ", "-", "(", ")", "4222529544688668", "é", "%", "mail.example.com", "99.1.2.3"]
    for _ in range(4000):
        text = "".join(pool[i] for i in rng.integers(0, len(pool), rng.integers(0, 25)))
        assert base_spans(text) == plain(text), text
        assert HINT.search(text) or not plain(text)


def sample():
    rng = np.random.default_rng(13)
    words = ["thing", "of", "ther", "and", "version", "erst"]
    out = []
    for i in range(160):
        pre, post = (" ".join(words[j] for j in rng.integers(0, 6, 6)) for _ in range(2))
        d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
        email = "".join(chr(97 + c) for c in rng.integers(0, 26, 5)) + f".{d(2)}@mail{d(1)}.example.com"
        out.append(f"{pre} {[email, f'+1 ({d(3)}) 555-{d(4)}', f'7{d(1)}.2{d(1)}.1{d(1)}.{d(1)}', f'id {d(5)} 2.0'][i % 4]} {post}")
    return out


def test_tagger_learns_and_adds_only_new_forms(spark):
    texts = sample()
    x, y = examples(texts)
    tagger = train(x, y, epochs=25)
    base = [base_spans(t) for t in texts]
    for t, b, m in zip(texts, base, added_spans(tagger, texts, base), strict=True):
        assert all(e <= s2 or s >= e2 for _, s, e in m for _, s2, e2 in b)
        assert not ("id " in t and m)
    hidden = ["erst and abcde.12 [at] mail3 [dot] example [dot] com thing of"]
    (got,) = added_spans(tagger, hidden, [base_spans(hidden[0])])
    assert [hidden[0][a:b] for _, a, b in got] == ["abcde.12 [at] mail3 [dot] example [dot] com"]
    docs = spark.createDataFrame([(1, texts[0], 1), (1, texts[0], 1), (None, None, 2), (3, "", 3)], "doc_id long, text string, n_email int")
    rows = find_personal(docs).collect()
    assert len(rows) == 4 and sorted(r["n_email"] for r in rows) == [0, 0, 1, 1]
    assert find_personal(docs.limit(0)).count() == 0


def test_secrets_and_bare_forms():
    rng = np.random.default_rng(15)
    texts = sample()
    for i in range(60):
        texts.append(f"thing of erst token = \"{''.join('0123456789abcdef'[j] for j in rng.integers(0, 16, 40))}\" ther and")
    tagger = train(*examples(texts), epochs=25)
    held = ['and ther token = "9a0b1c6d43eb78aa99cbd7049c572391524f37a8" of thing', "version of abcde at mail dot example dot com erst and of", "nothing at all here, and the dot is on the wall", "version 2.0 of id 12345"]
    base = [base_spans(t) for t in held]
    got = added_spans(tagger, held, base)
    assert [(k, held[0][a:b]) for k, a, b in got[0]] == [("secret", "9a0b1c6d43eb78aa99cbd7049c572391524f37a8")]
    assert [(k, held[1][a:b]) for k, a, b in got[1]] == [("email", "abcde at mail dot example dot com")]
    assert got[2:] == [[], []]


def test_learn_takes_a_copied_text_once_and_redact_keeps_rows(spark):
    texts = sample()
    rows = [(i, t, None, "x") for i, t in enumerate(texts)] + [(1000 + i, texts[0], None, "y") for i in range(500)] + [(None, None, "s", None), (7, "", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, `a.h` string")
    out = redact(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == len(rows) and sum(r["text"] is None for r in got) == 1
    assert sum("[EMAIL]" in (r["text"] or "") for r in got) >= 540
    assert redact(docs.limit(0)).count() == 0
    found = find_personal(docs).where("doc_id < 160").collect()
    assert all(r["n_spans"] == r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] + r["n_added"] for r in found)


def test_crf_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(14)
    emit, moves = rng.standard_normal((4, 1, TAGS)), rng.standard_normal((TAGS, TAGS))
    paths = list(product(range(TAGS), repeat=4))
    score = np.array([sum(emit[t, 0, p[t]] for t in range(4)) + sum(moves[a, b] for a, b in zip(p, p[1:])) for p in paths])
    assert tuple(viterbi(emit, moves)[:, 0]) == paths[score.argmax()]
    weight = np.exp(score - score.max())
    weight /= weight.sum()
    want = np.zeros((4, TAGS))
    for p, q in zip(paths, weight):
        for t in range(4):
            want[t, p[t]] += q
    assert np.allclose(marginals(emit, moves)[0][:, 0], want)


def test_redacted():
    assert redacted("ab 1.2.3.4 x", [("ip", 3, 10)]) == "ab [IP] x"
    assert redacted("0123456789", [("card", 2, 6), ("phone", 4, 8)]) == "01[CARD]89"
