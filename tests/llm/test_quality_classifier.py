import random
import zlib

import numpy as np

from vellum.llm import quality_classifier as Q

WORDS = "the of and stone river garden thought letter morning winter paper silver".split()


def made(i):
    r = random.Random(i)
    words = [r.choice(WORDS) + r.choice(["", "", "s", "ing"]) for _ in range(80)]
    if i % 4:
        return " ".join(words) + ".", 1
    return (" | ".join(words) if i % 8 else " ".join(w + "***" for w in words)), 0


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_accuracy_and_odd_rows(spark):
    rows = [(i, made(i)[0], "en", 0.5) for i in range(400)] + [(1000, None, None, None), (1001, "", "x", 1.0), (1002, "z" * 200_000, "x", 1.0), (5, made(5)[0], "en", 0.5), (None, made(7)[0], "en", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, quality string, score double")
    labels = spark.createDataFrame([(i, made(i)[1], 0) for i in range(400)] + [(1000, None, 1), (3, made(3)[1], 0), (None, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = Q.classify(docs, labels, fit_rows=200).collect()
    assert len(got) == len(rows) and all(0 <= r.vellum_score <= 1 for r in got)
    test = [r for r in got if r.doc_id is not None and r.doc_id < 400 and held_out(r.doc_id)]
    assert np.mean([(r.vellum_score >= 0.5) == made(r.doc_id)[1] for r in test]) > 0.97
    flipped = labels.withColumn("quality", Q.F.when(Q.learns(), labels["quality"]).otherwise(1 - labels["quality"]))
    again = {(r.doc_id, r.vellum_score) for r in Q.classify(docs, flipped, fit_rows=200).collect()}
    assert again == {(r.doc_id, r.vellum_score) for r in got}


def test_votes_are_those_of_all_cosines():
    rng = np.random.default_rng(0)
    x, y = rng.random((60, Q.DIM), np.float32), rng.integers(0, 2, 60)
    model = Q.Neighbours(x, y, neighbours=7)
    probe = rng.random((9, Q.DIM), np.float32)
    for p, s in zip(probe, model.score(probe), strict=True):
        z = (p * model.idf) @ model.basis
        c = [float(z @ v / np.linalg.norm(z)) for v in model.vectors]
        best = sorted(range(60), key=lambda i: -c[i])[:7]
        w = [max(c[i], 0) ** Q.POWER for i in best]
        assert abs(s - sum(a * y[i] for a, i in zip(w, best, strict=True)) / sum(w)) < 1e-3


def test_ties_share_the_last_places_and_blocks_do_not_matter():
    rng = np.random.default_rng(1)
    x = np.repeat(rng.random((1, Q.DIM)), 100, axis=0)
    y = np.array([0, 1] * 50)
    assert Q.Neighbours(x, y).score(x[:3]).tolist() == [0.5] * 3
    x, y = rng.random((300, Q.DIM)).astype(np.float32), rng.integers(0, 2, 300)
    model, probe = Q.Neighbours(x, y), rng.random((600, Q.DIM)).astype(np.float32)
    assert model.score(probe).tolist() == [model.score(p[None])[0] for p in probe]


def test_whole_words_count():
    a = Q._slots(b"a" * 70 + b"|" + b"b" * 9)
    assert a[1] == Q._slots(b"a|b")[1] and a[1] != Q._slots(b"a" * 80)[1]


def test_stage_keeps_clashing_columns(spark, tmp_path):
    docs = spark.createDataFrame([(i, made(i)[0], 0.5) for i in range(40)], "doc_id bigint, text string, vellum_score double")
    spark.createDataFrame([(i, made(i)[1]) for i in range(40)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = Q.stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and 20 <= out.count() < 40


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [r.vellum_score for r in Q.classify(docs, labels).collect()] == [0.5]
    assert Q.classify(docs.limit(0), labels).count() == 0


def test_words_kept_by_a_worker_are_bounded():
    from vellum.llm import quality_classifier

    quality_classifier._SLOTS.clear()
    quality_classifier.features(" ".join(f"w{i}" for i in range(150_000)).encode())
    assert 0 < len(quality_classifier._SLOTS) <= quality_classifier.KEPT == 100_000
    quality_classifier._SLOTS.clear()
