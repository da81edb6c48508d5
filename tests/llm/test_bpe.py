import hashlib
import itertools
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidekeep.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def random_merges(rng, n=14):
    """A small merge list over the letters a, b, c, each rule made of earlier parts."""
    parts, rules = [b"a", b"b", b"c"], []
    while len(rules) < n:
        pair = (rng.choice(parts), rng.choice(parts))
        if sum(map(len, pair)) <= 5 and pair[0] + pair[1] not in parts:
            rules.append(pair)
            parts.append(pair[0] + pair[1])
    ids = {bytes([b]): b for b in range(256)}
    ids.update({x + y: 256 + k for k, (x, y) in enumerate(rules)})
    return bpe.Merges(rules, ids)


def ends(merges, data):
    return list(itertools.accumulate(merges.length_of[t] for t in merges.whole(data)))


def test_no_later_byte_moves_a_border_beyond_the_lookahead():
    rng = random.Random(1)
    for _ in range(60):
        merges = random_merges(rng)
        for _ in range(60):
            data = bytes(rng.choices(b"abc", k=rng.randrange(1, 24)))
            more = bytes(rng.choices(b"abc", k=rng.randrange(1, 12)))
            fixed = len(data) - merges.lookahead
            assert [e for e in ends(merges, data) if e <= fixed] == [
                e for e in ends(merges, data + more) if e <= fixed]


def test_transducer_and_bulk_equal_the_whole():
    rng = random.Random(2)
    for _ in range(20):
        merges = random_merges(rng)
        merges.block = 8
        pieces = [bytes(rng.choices(b"abc", k=rng.randrange(0, 60))) for _ in range(50)]
        assert [list(x) for x in merges.bulk(pieces)] == [merges.whole(p) for p in pieces]
        data = b"".join(pieces)
        machine, out, held = bpe.Transducer(merges), [], 0
        for piece in pieces:
            out += machine.push(piece)
            held = max(held, len(machine.held))
        assert out + machine.flush() == merges.whole(data)
        assert held <= merges.block + merges.lookahead


def test_a_rule_of_unknown_parts_is_refused():
    ids = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257}
    with pytest.raises(ValueError):
        bpe.Merges([(b"ab", b"c"), (b"a", b"b")], ids)


def texts():
    rng = random.Random(3)
    parts = ["a", "the", "ing", " ", "  ", "\n", "\t", "'s", "'ll", "<|endoftext|>", "é", "中", "23", "!!",
             "\x1c", "\x85", "😀", "×", "²", "x" * 700, " " * 300, "ab" * 400]
    return ["".join(rng.choices(parts, k=rng.randrange(20))) for _ in range(800)] + [
        "", None, "word " * 30_000, "y" * 100_000]


def test_ids_equal_the_library_and_decode_back(spark):
    coder = Tokenizer.from_file(PATH)
    rows = list(enumerate(texts())) + [(None, "no id"), (5, "again"), (5, "again")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_tokens int")
    want = []
    for i, t in rows:
        ids = coder.encode(t or "", add_special_tokens=False).ids
        back = coder.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(back.encode()).hexdigest()))
    got = [tuple(r) for r in bpe.round_trip(df, PATH).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    some = df.filter("doc_id < 40")
    back = bpe.decode_ids(bpe.encode_texts(some, PATH), PATH).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {
        r["doc_id"]: r["text"] for r in some.collect()}


def test_empty_table(spark):
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_decoder_keeps_unfinished_characters():
    raw = "a€😀".encode()
    machine = bpe.Decoder({k: raw[k:k + 1] for k in range(len(raw))})
    assert "".join(machine.push([k]) for k in range(len(raw))) + machine.flush() == "a€😀"
    machine = bpe.Decoder({0: b"\xe2\x82"})
    assert machine.push([0]) == "" and machine.flush() == "�"
