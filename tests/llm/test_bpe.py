import hashlib

import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", " ", "Hello world's  best\n\n text ", "ééé ñandú 你好世界 🤦🏼‍♂️     x\x1c\x1d y", "x" * 150_000, "th" * 250 + "er", "qz" * 256,  "ab" * 500 + " " * 300, "12345 6 <|endoftext|> !!!***", "The quick brown fox"]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_round_trip(spark, reference):
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None), (None, "x", None)], "doc_id bigint, text string, ids string")
    got = {r.doc_id: (r.vellum_tokens, r.vellum_ids_sha256, r.vellum_decoded_sha256) for r in bpe.round_trip(docs, PATH, P.PATTERN).collect() if r.doc_id is not None}
    for i, t in enumerate(TEXTS):
        ids = reference.encode_ordinary(t or "")
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_ids_and_bytes(spark, reference):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    for r in bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH).collect():
        assert r.vellum_ids == reference.encode_ordinary(r.text or "") and bytes(r.vellum_bytes).decode() == (r.text or "")
    assert bpe.encode(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_any_text(spark, reference):
    alphabet = st.one_of(st.characters(codec="utf-8"), st.sampled_from(list("abtheron 019.\n\t'\u00e9\u4f60\u3000")))
    texts = []

    @settings(max_examples=400, deadline=None, database=None)
    @given(st.text(alphabet=alphabet, max_size=200))
    def gather(text):
        texts.append(text)

    gather()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    for r in bpe.encode(docs, PATH, P.PATTERN, block_chars=500).collect():
        assert r.vellum_ids == reference.encode_ordinary(r.text), r.text


def test_plan_folds_in_spark(spark):
    docs = spark.createDataFrame([(1, "a word", "x")], "doc_id bigint, text string, rows string")
    out = bpe.round_trip(docs, PATH, P.PATTERN)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" in plan and "Exchange" not in plan
    assert out.first().rows == "x"


def test_rank_map():
    ranks = bpe.read_ranks(PATH)
    held = bpe.rank_map(PATH)
    for a, b in ((b"t", b"he"), (b" ", b"the"), (b"th", b"e"), (b"\x00", b"\x00"), (b"zq", b"xj")):
        if a in ranks and b in ranks:
            key = ranks[a] * held.factor + ranks[b]
            found = int(held.slots[(key + held.shifts[key % held.groups]) % held.size]) ^ (key << 20)
            assert found == ranks[a + b] if a + b in ranks else found >= 1 << 20


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abtheron ", min_size=65, max_size=300))
def test_long_words_fold_alike(text):
    ranks, word = bpe.read_ranks(PATH), text.replace(" ", "").encode() or b"a"
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    assert bpe.fold_long(word, ranks) == [ranks[p] for p in parts]


def test_a_task_folds_a_word_once(spark, monkeypatch, reference):
    """Blocks of one task send each word to the fold once; forgetting what was sent changes nothing but the work."""
    monkeypatch.setattr(bpe, "frequent", lambda *a, **k: pa.table({"word": pa.array([], pa.binary()), "ids": pa.array([], pa.list_(pa.int32())), "piece": pa.array([], pa.binary())}))
    texts = [f"zqxvk wkjqz zqxvk qqjx{i % 3}zz own{i}kqzx" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    blocks = bpe._blocks(docs, ["doc_id"], PATH, P.PATTERN, 200)[0].select("texts", F.size("ids").alias("n")).collect()
    distinct = {w for t in texts for w in bpe.words_of(P.PATTERN)(t) if w.encode() not in bpe.read_ranks(PATH)}
    assert len(blocks) > 5 and sum(b.n for b in blocks) == len(distinct)
    want = [(i, reference.encode_ordinary(t)) for i, t in enumerate(texts)]
    for memo in (bpe.MEMO, 10):
        monkeypatch.setattr(bpe, "MEMO", memo)
        numbering = bpe.Numbering(bpe.Held(pa.array([b"a"])), {})
        assert [numbering.of([t], str.split)[1] for t in ("b c d e f g h i j k l m", "b n", "b n")] == [False, memo == 10, False]
        assert sorted((r.doc_id, r.vellum_ids) for r in bpe.encode(docs, PATH, P.PATTERN, block_chars=200).collect()) == want


def test_pretokenizers_agree():
    exact = regex.compile(P.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
    find, low = bpe.words_of(P.PATTERN), "".join(map(chr, range(0x10000)))
    assert bpe._for_re(P.PATTERN) is not None
    for text in (low, low[::-1], "".join(f"{c} {c}{c}  a" for c in low), "it's \U0001f926 \U00020000x \U0001d7d8\n\n x", *(t or "" for t in TEXTS)):
        assert find(text) == exact(text)
    for other in (r"(?i:'s)|\p{L}+", r"[^\S]+", r"\P{L}+", r"(a)\p{L}", r"\X"):
        assert bpe._for_re(other) is None


def test_frequent_words_fold_in_a_plan_without_exchange(spark, monkeypatch):
    """Adaptive execution would describe the plan, whose literals are megabytes, anew to the driver at each stage."""
    plans, kind = [], type(spark.range(1))
    run = kind.toArrow
    monkeypatch.setattr(kind, "toArrow", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or run(df))
    docs = spark.createDataFrame([(i, f"zqxvk wkjqz zqxvk {i}") for i in range(40)], "doc_id bigint, text string")
    often = bpe.frequent(docs, PATH, P.PATTERN)
    assert b"zqxvk" in {w.strip() for w in often["word"].to_pylist()}
    assert len(plans) == 1 and "aggregate(" in plans[0] and "Exchange" not in plans[0]


def test_literals_are_short():
    """The driver holds them in the plan's text, its descriptions and its events: 3.0 MB before, 2.7 MB now."""
    held = bpe.rank_map(PATH)
    assert len(held.ids("words")) < 2_750_000
    keys = {int(s) >> 20 for s in held.slots if s != bpe._EMPTY}
    assert bpe._EMPTY >> 20 not in keys and len(keys) == sum(x[:i] in held.ranks and x[i:] in held.ranks for x in held.ranks for i in range(1, len(x)))
