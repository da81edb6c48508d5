import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidekeep.llm import decontaminate as dc


def plain(text):
    return re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", (text or "").lower()).strip(" ").encode()


def edits_in(item, text):
    """Fewest edits of the item against any region of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def brute(rows, items):
    out = {}
    for i, t in rows:
        for k, s in items:
            item = plain(s)
            if len(item) >= dc.Q:
                found = edits_in(item, plain(t))
                if found <= dc.budget_of(len(item), dc.BUDGET_PERCENT):
                    out[i, k] = min(found, out.get((i, k), found))
    return sorted((i, k, e) for (i, k), e in out.items())


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1 \n!é", max_size=12)), max_size=6))
@settings(deadline=None)
def test_normalised_bytes(texts):
    data, offsets = dc.normalise(pa.array(texts, pa.string()))
    assert [data[a:z].tobytes() for a, z in zip(offsets, offsets[1:])] == list(map(plain, texts))


def test_grams_are_the_characters():
    data = np.frombuffer(b"abcdefghij", np.uint8)
    assert [g.tobytes() for g in dc.grams(data)] == [b"abcdefgh", b"bcdefghi", b"cdefghij"]


def corrupt(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("xyz")
        elif kind == 1:
            out.insert(at, rng.choice("xyz"))
        elif len(out) > 1:
            del out[at]
    return "".join(out)


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dc, "WINDOW_BYTES", 300)
    monkeypatch.setattr(dc, "BLOCK_BYTES", 200)
    rng = random.Random(7)
    syllables = ["the", "re", "on", "er", "an ", "ti ", "ou", "ha"]

    def prose(n):
        return "".join(rng.choices(syllables, k=n))

    items = [(k, prose(rng.randrange(8, 40))) for k in range(12)] + [(50, None), (51, ""),
                                                                    (52, "short"), (3, "same id " * 4)]
    rows = []
    for k in range(60):
        text = prose(rng.randrange(0, 60))
        if k % 2:
            item = rng.choice(items[:12])[1]
            text += corrupt(rng, item, rng.randrange(0, 14)).upper() + prose(rng.randrange(0, 250))
        rows.append((k, text))
    rows += [(100, None), (101, ""), (102, items[0][1].replace(" ", " -- ")), (5, rows[5][1])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, dc.find_leaks(docs, bench).collect()))
    assert got == brute(rows, items) and len(got) > 10


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, item_id long, text string")
    some = spark.createDataFrame([(1, 1, "a passage of some length")], none.schema)
    assert dc.find_leaks(none, some).count() == 0
    assert dc.find_leaks(some, none).count() == 0
    assert dc.find_leaks(some, some).count() == 1


def test_hits_by_chance_are_dropped_before_they_are_sorted(monkeypatch):
    monkeypatch.setattr(dc, "_CELLS", 50)  # items share counters
    rng = random.Random(11)
    pool = ["of the river ", "and the water ", "in the old house ", "on a day ", "was seen ", "xq "]
    items = [(k, "".join(rng.choices(pool, k=12)) + f"item number {k}") for k in range(30)]
    index = dc.Items(items)
    noise = "".join(rng.choices(pool, k=60)) + " ".join(str(rng.random()) for _ in range(3000))
    text = noise + corrupt(rng, items[4][1], 3) + " ".join(str(rng.random()) for _ in range(3000))
    data, offsets = dc.normalise(pa.array([text, None, ""]))
    at, entry = index.hits(data)
    kept = index.likely(at, index.item[entry])
    start = text.index(items[4][1][:5], len(noise) - 5) - 20
    planted = (index.item[entry] == 4) & (at > start) & (at < start + 300)
    assert kept[planted].all() and planted.sum() >= index.need[4]
    assert not kept[at > start + 3000].any()
    assert (0, 4) in {(d, i) for d, i, _ in index.search(data, offsets)}
