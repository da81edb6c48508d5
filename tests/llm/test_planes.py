import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidekeep.llm import planes

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300))
@settings(max_examples=60, deadline=None)
def test_block_round_trip(ids):
    block = np.array(ids, np.uint32)
    packed = planes.pack_block(block)
    assert len(packed) == (max(ids).bit_length() if ids else 0)
    assert planes.unpack_block(packed, len(ids)).tolist() == ids


@given(st.lists(st.lists(st.integers(0, 60_000), max_size=40), max_size=20))
@settings(max_examples=40, deadline=None)
def test_file_round_trip(documents):
    sink = io.BytesIO()
    writer = planes.PlaneWriter(sink, block_ids=16)
    for k, ids in enumerate(documents):
        writer.add(k if k else None, np.array(ids, np.uint32))
    writer.close()
    read = [(d, ids.tolist()) for d, ids in planes.read_file(sink.getvalue())]
    assert read == [(k if k else None, ids) for k, ids in enumerate(documents)]


def test_word_encoder_equals_the_library():
    from tidekeep.llm.wordbpe import WordEncoder
    import pyarrow as pa
    rng = random.Random(1)
    coder = WordEncoder(PATH)
    parts = ["a", "B", " ", "\n", "'", "'s", "'LL", "'re", "x1", "23", "!", "!'s", "''t", "É", "İ",
             "é", "中", "ß", "<|endoftext|>", "the", "_", "\x00", "\x85", "ſ", "Σ", "😀"]
    texts = ["".join(rng.choices(parts[:12] if k % 2 else parts, k=rng.randrange(15)))
             for k in range(1500)] + ["", None]
    for text, ids in zip(texts, coder.batch(pa.array(texts))):
        assert coder.coder.encode(text or "", add_special_tokens=False).ids == ids.tolist()


@pytest.mark.parametrize("file_ids", [1 << 23, 64])
def test_starts_and_checksums(spark, file_ids):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(["Hello", "world's", "1234", "ok", "ÜBER"], k=rng.randrange(30))))
            for k in rng.sample(range(1000), 60)] + [(2000, None), (2001, ""), (2002, "y " * 9000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n long")
    got = [tuple(r) for r in planes.plane_round_trip(df.repartition(5), PATH, file_ids=file_ids)
           .orderBy("doc_id").collect()]
    coder, at, want = Tokenizer.from_file(PATH), 0, []
    for i, text in sorted(rows):
        ids = coder.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_empty_table_null_and_repeated_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert planes.plane_round_trip(none, PATH).count() == 0
    df = spark.createDataFrame([(5, "b"), (5, "b"), (None, "a a"), (5, "c d")],
                               "doc_id long, text string")
    got = sorted(planes.plane_round_trip(df, PATH).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 5, 5, 5]
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1]]
