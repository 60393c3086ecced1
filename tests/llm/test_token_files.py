import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from planloom.llm import token_files as tf
from planloom.sources.shared import shared_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = ["", None, " ", "  two  spaces ", "a\n\n b", "tab\t x", "x   y", " wide", "don't I'll '' 's", "É ü 中文 字 🎉 x", "\x1c \x1d a", "<|endoftext|> as text", "end\n", " \n lead", "a" * 5000, "12 345!? ...", "x\u0085 y", "é á"]


@pytest.mark.parametrize("block", [4, 64, 1024])
def test_coding_round_trip(block):
    rng = np.random.default_rng(block)
    for ids in ([], [0], [5] * 61, [2**60, 1, 2**64 - 1], rng.integers(0, 50_257, 5000), rng.integers(0, 2, 700), 2 ** rng.integers(0, 64, 900, dtype=np.uint64)):
        ids = np.array(ids, np.uint64)
        words, raw, offsets = tf.encode(ids, block)
        assert (tf.decode(words, raw, offsets, len(ids), block) == ids).all()
        for b, at in enumerate(offsets):  # each block decodes on its own
            end = offsets[b + 1] if b + 1 < len(offsets) else len(words)
            part = ids[b * block : (b + 1) * block]
            assert (tf.decode(words[at:end], raw, np.array([0]), len(part), block) == part).all()


def test_words_follow_the_format():
    words, raw, _ = tf.encode(np.array([1, 2, 3, 4], np.uint64))
    assert [int(w >> np.uint64(60)) for w in words] == [4] and not len(raw)
    assert len(tf.encode(np.full(40, 40_000, np.uint64))[0]) == 14  # three ids of up to 20 bits a word


def library(texts, special_as_text=False):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = special_as_text
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


@settings(max_examples=250, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'sS 1.,\n\t  é中\x1c<|²\x01")), max_size=30), max_size=6))
def test_pieces_encode_like_the_whole(texts):
    ids, lengths = tf.encoder(PATH)(pa.array(texts, pa.string()), 7)
    want = library(texts)
    assert ids.tolist() == [i for own in want for i in [*own, 7]] and lengths.tolist() == [len(own) + 1 for own in want]


@pytest.mark.parametrize("as_text", [False, True])
def test_special_tokens(as_text):
    ids, lengths = tf.Encoder(PATH, as_text)(pa.array(TEXTS))
    assert ids.tolist() == sum(library(TEXTS, as_text), []) and lengths.tolist() == list(map(len, library(TEXTS, as_text)))
    assert (50256 in ids.tolist()) != as_text
    if not as_text:
        assert tf.Encoder(PATH)(pa.array(["a <|endoftext|> b"]))[0].tolist() == [64, 220, 50256, 275]


def test_a_file_is_read_by_group_and_stretch(tmp_path):
    rng = np.random.default_rng(2)
    ids = 2 ** rng.integers(0, 32, 5000, dtype=np.uint64) - 1
    out = tf.TokenFile(f"file://{tmp_path}/x.s8b", block=4)
    for a, b in ((0, 700), (700, 701), (701, 3000), (3000, 5000)):
        out.add([a, None], np.array([b - a - 1, 1]), ids[a:b].astype(np.uint32))
    assert out.close()["ids"] == 5000
    held = tf.TokenReader(out.uri)
    assert len(held.groups) == 10 and (held.stretch(0, 9999) == ids).all()
    for a, b in ((0, 0), (511, 513), (4999, 5000), (100, 2222)):
        assert (held.stretch(a, b) == ids[a:b]).all()
    found = [c for _, crc in held.checksums() for c in crc.tolist()]
    assert held.doc_ids(0, 4) == [0, None, 700, None]
    ends = np.cumsum(held.lengths).tolist()
    assert found == [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip([0, *ends], ends)]
    (tmp_path / "y.s8b").write_bytes((tmp_path / "x.s8b").read_bytes()[:-9])
    with pytest.raises(ValueError):
        tf.TokenReader(f"file://{tmp_path}/y.s8b")


def test_files(spark):
    rng = random.Random(1)
    texts = [*TEXTS, *(" ".join(rng.choices(["the", "tion", "Onre", "ça", "7", "\n"], k=rng.randint(1, 300))) for _ in range(60))]
    rows = [(i * 3 % 101, t, "x") for i, t in enumerate(texts)]
    rows += [rows[3], (None, "no id", "y"), (7_000_000_000, "far", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = sorted(tf.round_trip(docs, PATH).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k))
    want, at = {}, 0
    for i, t, _ in rows:
        ids = np.array([*LIBRARY.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.setdefault(i, set()).add((len(ids), zlib.crc32(ids.tobytes())))
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        at += r.n_tokens


def test_files_roll_and_hot_ids_are_dealt(spark, monkeypatch):
    texts = [f"the {i % 7} tion " * (i % 40) for i in range(400)]
    docs = spark.createDataFrame([(5 if i % 3 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    monkeypatch.setattr(tf, "HOT_ROWS", 100)
    folder = f"{shared_dir(spark)}/rolled"
    manifest = tf.write_ids(docs, PATH, folder, roll_ids=2000, block=8)
    assert len(manifest) > 6 and sum(m["docs"] for m in manifest) == 400 and max(m["ids"] for m in manifest) < 4000
    got = sorted(tf.read_ids(spark, manifest).collect(), key=lambda r: r.start)
    plain = sorted(tf.round_trip(docs.coalesce(1), PATH).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in docs.collect())
    assert sorted(got) == sorted(plain)


def test_empty_table(spark):
    assert tf.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
