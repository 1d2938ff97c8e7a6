import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm.simhash import fingerprints_of, one_of_each, shingle_hashes, similar_groups


def similar(a, b):
    x, y = set(shingle_hashes(a, 5)), set(shingle_hashes(b, 5))
    return len(x & y) / len(x | y) if x or y else 1.0


def corpus():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 260))) for _ in range(40)]
    out = list(texts)
    for t in texts:
        words = t.split()
        for edits in (0, 1, 2, 6):
            copy = list(words)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = "zz" + str(rng.random())
            out.append(" ".join(copy))
    return out


def test_one_of_each_matches_brute_force(spark):
    texts = [*corpus(), "", None, " "]
    rows = [(1000 - i, t, "s", i) for i, t in enumerate(texts)]
    rows += [(None, texts[3], "s", 0), rows[7], rows[7], (5000, "of its own kind, once only", "s", 1), (5000, "of its own kind, once only", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    values = [t or "" for _, t, _, _ in rows]
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(values)):
        for b in range(a):
            if find(a) != find(b) and similar(values[a], values[b]) >= 0.8:
                parent[find(a)] = find(b)
    want = {}
    for i, r in enumerate(rows):
        want[find(i)] = min(want.get(find(i), (True, 0)), (r[0] is None, r[0] or 0))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in one_of_each(docs).collect())
    assert got == sorted(want.values())


def groups(texts):
    """Brute force: the sets of numbers of texts that chains of similar pairs link."""
    sets = [set(shingle_hashes(t, 5)) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if find(a) != find(b) and (len(x & y) / len(x | y) if x or y else 1.0) >= 0.8:
                parent[find(a)] = find(b)
    out = {}
    for i in range(len(texts)):
        out.setdefault(find(i), set()).add(i)
    return sorted(map(sorted, out.values()))


def found_groups(spark, texts):
    from lodestone.llm.repeats import KEY, with_key

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {}
    for r in with_key(docs).join(similar_groups(docs), KEY).select("doc_id", "root").collect():
        out.setdefault(r["root"], set()).add(r["doc_id"])
    return sorted(map(sorted, out.values()))


def edited(words, rng, edits):
    out = list(words)
    for i in rng.sample(range(len(out)), edits):
        out[i] = f"zz{rng.random()}"
    return out


def test_texts_of_one_name_stay_apart(spark, monkeypatch):
    """The first half of the texts' names is one of two values."""
    from lodestone.llm import repeats

    plain = repeats.with_key
    monkeypatch.setattr(repeats, "with_key", lambda docs: plain(docs).withColumn("t1", F.pmod("t1", F.lit(2))))
    rng = random.Random(3)
    base = [[f"{k}w{i}" for i in range(70)] for k in range(6)]
    texts = [" ".join(edited(b, rng, n)) for b in base for n in (0, 1, 1, 0)] + ["", " ", "alone"]
    assert found_groups(spark, texts) == groups(texts)


def test_large_families_match_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts, line = [], " ".join(word() for _ in range(12))
    for size, edits, copies in ((60, 1, 300), (200, 4, 200)):
        original = [word() for _ in range(size)]
        texts += [" ".join(original), *(" ".join(edited(original, rng, edits)) for _ in range(copies))]
    chain = [word() for _ in range(80)]
    for i in range(60):  # each similar to its neighbours only
        chain[i] = word()
        texts.append(" ".join(chain))
    # copies of copies that lack their original, and a line that unlike texts have in common
    lost = [word() for _ in range(60)]
    texts += [" ".join(edited(lost, rng, 1)) for _ in range(60)]
    texts += [f"{line} " + " ".join(word() for _ in range(rng.randrange(1, 30))) for _ in range(200)]
    want = groups(texts)
    assert len(want[0]) == 301 and len(want[1]) == 201 and len(want) > 100
    assert found_groups(spark, texts) == want


def test_repeats_do_not_part_similar_texts(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(30):
        words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(141)]
        passage, line, other = words[:100], words[100:112], words[112:121]
        texts += [" ".join(passage + line), " ".join(passage + line * 10)]
        texts += [" ".join(other[:8]), " ".join(other)]
        texts += [" ".join(words[20:140]), " ".join(words[20:140] * 8)]
    assert found_groups(spark, texts) == groups(texts) == [[i, i + 1] for i in range(0, 180, 2)]


def test_near_dedup_goes_by_simhash_components(spark, tmp_path):
    """Against brute force: components of fingerprints at two bits, then similar texts in each."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = ["", " ", *corpus()]
    for _ in range(12):
        words = [word() for _ in range(400)]
        texts += [" ".join(words), *(" ".join(edited(words, rng, n)) for n in (1, 1, 2, 12))]
    # texts of two shingles whose fingerprints are nearly zero, as that of a text without words
    tail = min((f"x{i} y z" for i in range(2000)), key=lambda t: shingle_hashes(t, 3)[0].bit_count())
    low = [t for t in (f"{k} {tail}" for k in range(20000)) if int(fingerprints_of([t])[0]).bit_count() <= 2]
    assert len(low) > 1
    texts += low
    fps = list(map(int, fingerprints_of(texts)))
    sets = [set(shingle_hashes(t, 5)) for t in texts]

    def linked(members, test):
        left, out = set(members), []
        while left:
            group, todo = set(), [left.pop()]
            while todo:
                a = todo.pop()
                group.add(a)
                near = {b for b in left if test(a, b)}
                left -= near
                todo += near
            out.append(group)
        return out

    alike = lambda a, b: (len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] or sets[b] else 1.0) >= 0.8
    by_bits = linked(range(len(texts)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    want = sorted(min(g) for part in by_bits for g in linked(part, alike))
    every = [min(g) for g in linked(range(len(texts)), alike)]
    assert len(by_bits) < len(want) and len(every) < len(want) < len(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == want


def test_near_dedup_shuffles_no_text_that_the_sieves_tell(spark, tmp_path, monkeypatch):
    """Texts were shuffled whole, twice; a sieve of one word tells none apart and gives the same rows."""
    from lodestone.llm import common

    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(1000)) for _ in range(150)]
    for i in range(4):
        words = texts[i].split()
        texts += [texts[i], " ".join(edited(words, rng, 1))]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, texts[30], "en", "s", 0), (400, None, None, None, None), (401, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")

    def shuffled():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(True).head().totalShuffleWrite()

    want = sorted([*(i for i, t in enumerate(texts[:150])), 400])
    fps = list(map(int, fingerprints_of(texts)))
    linked = {i for i in range(150, len(texts)) if any((fps[i] ^ fps[j]).bit_count() <= 2 for j in range(4))}
    want = sorted([*want, *(i for i in range(150, len(texts)) if i not in linked)])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large to be broadcast
    try:
        before = shuffled()
        got = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect())
        assert got == want and len(linked) > 4
        assert shuffled() - before < sum(map(len, texts)) / 2
        monkeypatch.setattr(common, "SIEVE", 1)
        assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(4)
    words = {"en": ["the", "of", "and", "thing", "other", "there"], "de": ["der", "und", "nicht", "auch", "eine", "schön"]}
    rows = []
    for i in range(60):
        lang = ["en", "de"][i % 2]
        rows.append((i, " ".join(rng.choice(words[lang]) + rng.choice(["", "er", "en"]) for _ in range(60)) + ".", lang, "s", 0))
    rows[4] = (4, rows[4][1] + " mail ab.12@mail3.example.com or +1 (555) 555-0100 now", "en", "s", 0)
    item = "a passage of twelve words that stands in the benchmark as it is"
    rows += [(60, rows[4][1], "en", "s", 0), (61, "12 34 !!", None, "s", 0), (62, None, None, None, None), (63, rows[6][1] + " " + item + " " + rows[8][1], "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("b1", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_take_effect(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, tables).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        if k < 4:
            assert docs.columns == columns
    assert set(seen["language_id"]) == {*range(61), 63}
    assert 60 not in seen["near_dedup"] and {4, 6, 8, 63} <= set(seen["near_dedup"])
    assert "passage" in seen["near_dedup"][63]["text"] and "passage" not in seen["benchmark_decontamination"][63]["text"]
    assert "[EMAIL]" in seen["personal_data"][4]["text"] and "[PHONE]" in seen["personal_data"][4]["text"]
    last = seen["sentencepiece_pieces"]
    assert set(last) == set(seen["personal_data"]) and all(r["pieces"] for r in last.values())
