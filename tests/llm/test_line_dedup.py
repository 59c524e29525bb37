import hashlib
import re
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from vellum.llm import common, line_dedup

LONG = "A line that is long enough to count as one, yes"


def plain(rows, least=40, docs=5):
    key = lambda line: re.sub("[A-Z]+", lambda m: m.group().lower(), line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= least:
                held.setdefault(k, []).append(d)
    keep = {k: max((x for x in v if x is not None), default=None) for k, v in held.items() if len(v) >= docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if key(x) not in keep or keep[key(x)] == d]
        out.append((str(d), len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("bits", [27, 10])
def test_against_plain(spark, bits):
    """With ten bits in all, the filters let nearly every line through and the result is the same."""
    rows = [(i, f"{LONG}\nown line {i} which is also long enough to be looked at\n  {LONG.upper()}\t\n") for i in range(7)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (23, "é" * 40), (24, "É" * 40), (25, "é" * 39), (26, "x" * 200_000), (6, f"{LONG}\nown"), (None, LONG), (None, LONG)]
    rows += [(30 + i, "ö" * 40 + "\nshort") for i in range(5)] + [(40 + i, "ü" * 39 + "\nshort") for i in range(5)] + [(50 + i, "four documents hold this line of some length, not five") for i in range(4)]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "doc_id bigint, text string, key string, drop_id int")
    out = line_dedup.dedup_lines(df.select("doc_id", "text"), bits_log2=bits, seg_log2=4)
    got = sorted((str(r.doc_id), r.vellum_lines, r.vellum_dropped, hashlib.sha256(r.vellum_text.encode()).hexdigest()) for r in out.collect())
    assert got == plain(rows)
    staged = line_dedup.stage(spark, df.withColumn("n_chars", df["drop_id"].cast("bigint")), "")
    assert staged.columns == ["doc_id", "text", "key", "drop_id", "n_chars"] and staged.count() == len(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert line_dedup.dedup_lines(df).count() == 0


@pytest.mark.parametrize("ids", [[1] * 5, [1, 1, 1, 1, 2], [None, None, 1, 1, 1], [None] * 5, [1, 2, 3, 4]])
def test_repeated_rows_as_in_sql(spark, ids):
    rows = [(i, f"{LONG}\nrow {n}") for n, i in enumerate(ids)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = sorted((str(r.doc_id), r.vellum_lines, r.vellum_dropped, hashlib.sha256(r.vellum_text.encode()).hexdigest()) for r in out.collect())
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = con.sql(line_dedup.SQL)
    at = {c: i for i, c in enumerate(want.columns)}
    assert got == sorted((str(r[at["doc_id"]]), r[at["n_lines"]], r[at["n_dropped"]], r[at["kept_sha256"]]) for r in want.fetchall())
    assert got == plain(rows)


@pytest.fixture
def steps(spark, monkeypatch):
    """The functions of the Arrow steps that are built, in order."""
    built, kind = [], type(spark.range(0))
    real = kind.mapInArrow

    def kept(self, func, schema, *args, **more):
        built.append(func)
        return real(self, func, schema, *args, **more)

    monkeypatch.setattr(kind, "mapInArrow", kept)
    return built


def test_last_step_cuts_a_batch_in_parts(spark, steps):
    """Of a batch of 20 MB no part that leaves the step has more than some 4 MB, and each text leaves it once."""
    df = spark.createDataFrame([(1, "x", "t", 1)], "doc_id bigint, text string, lang string, n_chars bigint")
    line_dedup.stage(spark, df, "")
    gone = pa.array([None, [line_dedup.xxhash.xxh3_128_digest(LONG.lower().encode())]] * 5_000, pa.list_(pa.binary()))
    text = pa.array([f"{LONG}\n{'y' * 2000}"] * 10_000)
    ids = pa.array(range(10_000), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, text, pa.array(["t"] * 10_000), ids, gone], names=["doc_id", "text", "lang", "n_chars", "vellum_drop_keys"])
    out = list(steps[-1](iter([batch])))
    assert max(x.column("text").nbytes for x in out) <= common.PART + 1_000_000 and len(out) > 4
    t = pa.Table.from_batches(out)
    assert t.column_names == df.columns
    assert t["doc_id"].to_pylist() == list(range(10_000))
    assert t["text"].to_pylist() == [f"{LONG}\n{'y' * 2000}", "y" * 2000] * 5_000


def test_first_steps_get_parts_of_a_batch(spark, steps):
    """The hashes of a batch of 20 MB leave their step part by part."""
    line_dedup.twice_seen_filter(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"), 40, 20, 4)
    batch = pa.RecordBatch.from_arrays([pa.array([f"{i:0100}\n{'z' * 2000}" for i in range(10_000)])], names=["text"])
    out = list(steps[-2](iter([batch])))
    assert len(out) > 4
    assert len({h for x in out for h in x.column(1).to_pylist()}) == 10_001


def test_segments_are_bits(spark, steps):
    """A task that owns all segments holds 2 x 2**27 bits, which are 32 MB, and marks what is seen twice, in one batch or two."""
    line_dedup.twice_seen_filter(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"), 40, 27, 8)
    h = np.random.default_rng(1).integers(0, 1 << 63, 4_000, dtype=np.uint64) * np.uint64(2)
    rows = lambda x, n: pa.RecordBatch.from_arrays([pa.array((x >> np.uint64(56)).astype(np.int32)), pa.array(x.view(np.int64)), pa.array(np.full(len(x), n, np.int32))], names=["seg", "h", "n"])
    tracemalloc.start()
    out = list(steps[-1](iter([rows(h[:3_000], 1), rows(h[2_000:3_000], 1), rows(h[3_000:], 2)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    bits = {s: np.unpackbits(np.frombuffer(b, np.uint8)) for s, b in zip(out[-1].column(0).to_pylist(), out[-1].column(1).to_pylist(), strict=True)}
    held = [all(bits[int(x >> np.uint64(56))][p[0]] for p in line_dedup._bits(np.array([x]), 8, 27)) for x in h]
    assert held[2_000:] == [True] * 2_000 and sum(held[:2_000]) == 0
