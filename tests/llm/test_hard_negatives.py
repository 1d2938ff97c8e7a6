import math

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm.hard_negatives import best_in_window, encode, hard_negatives, lookup_scores, matrix, train

KEPT = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def slow(rows, k=5, n=10, every=10):
    own = [(i, v, c) for i, v, c in rows if i is not None and v is not None and c is not None and all(x is not None and math.isfinite(x) for x in v)]
    own = [(i, [math.floor(256 * float(np.float32(x))) for x in v], c) for i, v, c in own]
    out = []
    for r, (i, a, c) in enumerate(own):
        if i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a, b)), j, d) for s, (j, b, d) in enumerate(own) if s != r]
        for score, j, _ in sorted(x for x in scored if x[2] == c)[:k]:
            fit = sorted(x for x in scored if x[2] != c and 30 * -score <= 100 * -x[0] <= 90 * -score)[:n]
            out += [(i, j, place, x[1], -score, -x[0]) for place, x in enumerate(fit, 1)]
    return sorted(out)


def vectors(n, dims, labels, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims))
    label = rng.integers(0, labels, n)
    x = (centres[label] + 1.5 * rng.normal(size=(n, dims))).astype(np.float32)
    return [(i, (v / np.linalg.norm(v)).tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label))]


def test_against_brute_force(spark):
    rows = vectors(400, 8, 3, 1)
    rows += [(20, rows[3][1], 1), (21, rows[3][1], 1), (20, rows[3][1], 1), (40, None, 1), (50, [0.1] * 8, None), (60, [0.1] * 7 + [None], 2), (70, [float("nan")] + [0.1] * 7, 2), (80, [float("-inf")] + [0.1] * 7, 2), (None, rows[4][1], 1)]
    rows += [(90, rows[5][1][:5], 0), (100, [], 0), (110, [0.0] * 8, 1), (1000, [0.5] * 8, 77)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, id int, `x y` int")
    want = slow(rows)
    assert len(want) > 400
    for size in ({}, {"row_pack": 60, "anchor_pack": 7, "sample": 50}):
        got = hard_negatives(df, "id % 10 = 0", **size)
        assert sorted(tuple(r[c] for c in KEPT) for r in got.collect()) == want
    assert hard_negatives(df.limit(0), "id % 10 = 0").count() == 0
    assert hard_negatives(df, "id = -1").count() == 0
    with pytest.raises(Exception, match="2\\^26"):
        hard_negatives(spark.createDataFrame([(1, [1e30], 1)], "vec_id long, embedding array<double>, label int"), "id = 1").collect()


def test_a_label_and_a_vector_that_most_rows_share(spark):
    rows = [(i, [0.5, 0.25, -0.5], 1) for i in range(300)] + vectors(60, 3, 2, 2)
    rows = [(i, v, c) for i, (_, v, c) in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(r[c] for c in KEPT) for r in hard_negatives(df, "id % 10 = 0", row_pack=50).collect()) == slow(rows)


def test_bounds_are_certain():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(size=(700, 16)) / 4).astype(np.int64)
    books = train(x[:300])
    codes, norms = encode(x, books)
    a = x[:9]
    scores, true = lookup_scores(a, books, codes), x @ a.T
    room = np.linalg.norm(a.astype(float), axis=1)[None, :] * norms[:, None]
    assert (np.abs(true - scores) <= room + 1e-6).all() and np.abs(true - scores).max() > 0
    close = np.stack([books[p][codes[:, p]] for p in range(8)], axis=1).reshape(700, 16)
    assert (close @ a.T == scores).all()
    for least, most, k in ((-(1 << 60), 1 << 60, 5), (0, 3000, 10), (900, 1000, 3), (10**9, 10**9, 2)):
        for i in range(9):
            reach = np.ceil(room[:, i]).astype(np.int64) + 1
            kept = best_in_window(scores[:, i] - reach, scores[:, i] + reach, least, most, k)
            fit = np.flatnonzero((true[:, i] >= least) & (true[:, i] <= most))
            best = fit[np.argsort(-true[fit, i], kind="stable")]
            worst = true[best[:k], i].min() if len(best) else 0
            assert set(best[:k]) | {j for j in fit if len(best) > k and true[j, i] == worst} <= set(kept.tolist())
            assert len(kept) < 700


def test_matrix():
    assert matrix(pa.chunked_array([[[1, 2], [], [3]]], pa.list_(pa.int32())), 4).tolist() == [[1, 2, 0, 0], [0] * 4, [3, 0, 0, 0]]
    assert matrix(pa.chunked_array([], pa.list_(pa.int32())), 0).shape == (0, 0)
