import random

import corpus_pipeline
from vellum.llm import bpe, decontaminate, line_dedup, quality_classifier, simhash

R = random.Random(11)
WORDS = "the of and stone river garden thought letter morning winter paper silver window bridge cloud".split()
LINE = "This very line stands in a good many of the documents"


def text(n=90):
    return " ".join(R.choice(WORDS) + R.choice(["", "s", "ed", "ing", "ly"]) for _ in range(n)) + "."


def tables(tmp_path, spark):
    leak = " ".join(f"{R.choice(WORDS)}{i}" for i in range(40))
    rows = [[i, text(), "en", "s", 0] for i in range(200)]
    for i in range(0, 200, 4):
        rows[i][1] = " | ".join(text().split())
    for i in range(1, 40, 4):
        rows[i][1] += "\n" + LINE
    rows[101][1] = rows[103][1] = rows[105][1]
    rows[110][1] += " " + leak
    rows += [[300, None, "en", "s", 0], [301, "", None, None, None], [None, text(), "en", "s", 0]]
    spark.createDataFrame([tuple(r) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(200)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows


def test_each_stage_against_its_operator(spark, tmp_path):
    rows = tables(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        if stage is not bpe.stage:
            assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(sorted(str(r.doc_id) for r in docs.collect()))
        if stage is simhash.stage:
            want = [r for r in simhash.near_duplicates(before).collect() if r.doc_id is None or r.doc_id == r.vellum_class]
            assert kept[-1] == sorted(str(r.doc_id) for r in want)
    good = {str(r[0]) for r in rows if r[0] is None or r[0] >= 200 or r[0] % 4}
    assert set(kept[0]) == good
    assert kept[1] == kept[0]
    gone = {"103", "105"} | ({"301"} if "300" in kept[1] else set())
    assert set(kept[2]) == good - gone
    assert set(kept[3]) == set(kept[2]) - {"110"}
    assert kept[4] == kept[3]
    lines = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/line_dedup").collect()}
    assert [d for d, t in lines.items() if LINE in (t or "")] == [37]
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, again)) == sorted(map(str, docs.collect()))


def test_order_of_stages():
    assert [f.__module__.rpartition(".")[2] for _, f in corpus_pipeline.STAGES] == [m.__name__.rpartition(".")[2] for m in (quality_classifier, line_dedup, simhash, decontaminate, bpe)]
