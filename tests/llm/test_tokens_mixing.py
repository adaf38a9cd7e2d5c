import os
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from opweave.llm.mixing import mix_shares, mix_sources, sainte_lague
from opweave.llm.tokens import ForcedBoundaryEncoder, token_counts, token_ids, vocabulary_file

pytestmark = pytest.mark.skipif(not os.path.exists(vocabulary_file()), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def enc():
    return ForcedBoundaryEncoder(vocabulary_file())


@pytest.fixture(scope="module")
def ref():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_file("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def ids(enc, texts):
    out, ends = enc.encode_batch(pa.array(texts, pa.string()))
    return [out[a:b].tolist() for a, b in zip(ends, ends[1:])]


ALPHABET = "ab'sdmtlrveLL  \n\t\r 　 \u0085\x1c!?.,。、日本ไทยनम9٣Ⅷ​😀é́<|endoftext|>"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=40) | st.text(max_size=20, alphabet=st.characters(codec="utf-8")), min_size=1, max_size=6))
def test_equal_to_the_whole_text(texts):
    e, t = ForcedHolder.get()
    assert ids(e, texts) == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


class ForcedHolder:
    held = None

    @classmethod
    def get(cls):
        if cls.held is None:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(vocabulary_file("byte_bpe_50k.json"))
            t.encode_special_tokens = True
            cls.held = ForcedBoundaryEncoder(vocabulary_file()), t
        return cls.held


def test_long_text_and_slices(enc, ref):
    long = "The  quick's 日本語 " * 20_000
    assert ids(enc, [long, "", None])[0] == ref.encode(long, add_special_tokens=False).ids
    arr = pa.array(["skip", "a b", None, "c"]).slice(1)
    out, ends = enc.encode_batch(arr)
    assert ends.tolist() == [0, 2, 2, 3]


def test_spark_ids(spark, ref):
    df = spark.createDataFrame([(1, "Hello  world's end"), (2, ""), (3, None), (4, "Hello  world's end")], "doc_id long, text string").withColumnRenamed("text", "ids")
    got = {r.doc_id: list(r.ids) for r in token_ids(df, "doc_id", "ids").collect()}
    want = ref.encode("Hello  world's end", add_special_tokens=False).ids
    assert got == {1: want, 2: [], 3: [], 4: want}
    assert token_ids(df.limit(0), "doc_id", "ids").count() == 0
    assert {r.doc_id: r.n_tokens for r in token_counts(df, ["doc_id"], "ids").collect()} == {1: len(want), 2: 0, 3: 0, 4: len(want)}


def greedy(w, c, n):
    h = [0] * len(w)
    for _ in range(n):
        q = [(-x / (2 * h[i] + 1), i) for i, x in enumerate(w) if x > 0 and h[i] < c[i]]
        if not q:
            break
        h[min(q)[1]] += 1
    return h


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 1, 2, 3, 0.5, 0.1, 0.37]), st.integers(0, 30)), min_size=1, max_size=6), st.integers(0, 80))
def test_apportionment(rows, n):
    w, c = [x for x, _ in rows], [x for _, x in rows]
    assert sainte_lague(w, c, n) == greedy(w, c, n)


def test_mix(spark):
    r = random.Random(0)
    rows = [(i, r.choice(["big"] * 8 + ["small", "extra", None]), r.choice([0, 5, 20, 60])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 2), ("none", 0.2, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mix = mix_sources(docs, targets, total_tokens=20_000, block_tokens=50)
    got = mix.collect()
    assert len({x.doc_id for x in got}) == len(got) and {x.source for x in got} == {"big", "small"}
    assert all(1 <= x.repeats <= {"big": 1, "small": 2}[x.source] for x in got) and all(x.n_tokens > 0 for x in got)
    s = {x.source: x for x in mix_shares(docs, mix, targets).collect()}
    assert s["none"].actual_share == 0 and not s["none"].met
    assert abs(sum(x.chosen_tokens for x in s.values()) - 20_000) < 300
    assert sorted(got) == sorted(mix_sources(docs.repartition(7), targets, total_tokens=20_000, block_tokens=50).collect())
    assert mix_sources(docs.limit(0), targets).count() == 0 and mix_sources(docs, targets.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_uneven_documents_meet_their_shares(spark, seed):
    r = random.Random(seed)
    docs = [(i, "ab"[i % 2], min(40_000, int(5 + r.paretovariate(0.6) * 20))) for i in range(3_000)] + [(9_000, None, 5), (9_001, "c", 7), (9_002, "a", 0)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    got = mix_sources(df, targets, total_tokens=200_000).collect()
    size = {s: sum(x.n_tokens * x.repeats for x in got if x.source == s) for s in "ab"}
    assert all(99_000 <= n <= 100_000 for n in size.values()), size
    assert all(x.repeats == 1 and x.n_tokens > 0 for x in got) and len({x.doc_id for x in got}) == len(got)
