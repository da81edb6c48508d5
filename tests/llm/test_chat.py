import hashlib
import random

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st

from tidekeep.llm import chat
from tidekeep.llm.bpe import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string, ids string"
parts = st.sampled_from([*chat.CONTROL, "\\", "<", "[", "s>", "a", "é", "\n", "<\\s>"])


@given(st.lists(parts, max_size=12).map("".join))
def test_escape_can_be_undone_and_hides_control_strings(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(c in hidden for c in chat.CONTROL)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def want(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1], r[2] or ""))
        said = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)),
                     len(said), sha(said))
    return out


def test_digests_of_what_is_read_back(spark, monkeypatch):
    monkeypatch.setattr(chat, "PIECE_IDS", 50)
    rng = random.Random(4)
    words = ["hello", " ", "</s>", "[INST]", "\\", "é", "<|endoftext|>", "\n", "中", "[ROLE]x[TEXT]"]
    rows = []
    for conv in range(30):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", "", None]),
                         rng.choice([None, "", "".join(rng.choices(words, k=rng.randrange(60)))])))
    rows += [(99, t, "assistant", "x" * 30) for t in range(400)]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(4)
    got = {r[0]: tuple(r[1:5]) for r in chat.read_back(chat.format_conversations(df, PATH), PATH)
           .collect()}
    assert got == want(rows)


def test_mask_covers_assistant_texts_only(spark):
    df = spark.createDataFrame([(1, 0, "user", "a question", ""), (1, 1, "assistant", "an answer", "")],
                               SCHEMA)
    row = chat.format_conversations(df, PATH).collect()[0]
    ids, mask = np.frombuffer(row["ids"], "<i4"), np.frombuffer(row["mask"], np.uint8)
    coder = encoder(PATH, specials=False)
    assert ids.tolist() == [chat.BEGIN, chat.USER, *coder.encode("a question"), chat.USER_END,
                            *coder.encode("an answer"), chat.END]
    assert ids[mask == 1].tolist() == coder.encode("an answer")


def test_empty_table_repeats_and_null_ids(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chat.read_back(chat.format_conversations(none, PATH), PATH).count() == 0
    df = spark.createDataFrame([(None, None, None, None, "")] * 2, SCHEMA)
    row = chat.read_back(chat.format_conversations(df, PATH), PATH).collect()[0]
    assert (row["conv_id"], row["n_turns"], row["turns_sha256"]) == (None, 2, sha("\n\n\n\n"))
