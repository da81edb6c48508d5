import random
import re

import pytest

from tidekeep.llm.jaccard import jaccard_join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))}


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    low = {}
    for k, (i, _) in enumerate(sets):
        low[top(k)] = min(low.get(top(k), i), i)
    return sorted((i, len(s), low[top(k)]) for k, (i, s) in enumerate(sets))


def answer(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows],
                               "doc_id long, text string, n string")
    return sorted(map(tuple, jaccard_join(df, **options).select(
        "doc_id", "n_shingles", "component_id").collect()))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    boiler = [" ".join(rng.choices(vocabulary, k=30)) for _ in range(3)]
    rows = [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE"), (905, "a b c"),
            (906, "a B\tc"), (907, "a b c"), (908, "x" * 5000), (909, "x" * 5000)]
    base = rng.choices(vocabulary, k=120)
    for k in range(150):  # one large group of near copies, also chains of them
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    drift = rng.choices(vocabulary, k=100)
    for k in range(40):  # neighbours link, ends do not
        drift = list(drift)
        drift[(k * 7) % 100] = f"d{k}"
        rows.append((200 + k, " ".join(drift)))
    for k in range(80):  # a common passage in texts that differ
        rows.append((300 + k, rng.choice(boiler) + " " + " ".join(
            f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 40)))))
    rows += [(500 + k, rows[20][1]) for k in range(30)]
    rng.shuffle(rows)
    return rows


def test_matches_brute_force(spark, corpus):
    assert answer(spark, corpus) == brute(corpus)


def test_blocked_product_alone_gives_the_same(spark, corpus, monkeypatch):
    import tidekeep.llm.jaccard as jaccard
    monkeypatch.setattr(jaccard, "LEADER_ROUNDS", 1)
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 8)
    monkeypatch.setattr(jaccard, "CHUNK_COLUMNS", 16)
    assert answer(spark, corpus) == brute(corpus)


def test_large_groups_are_dealt_again_in_proportion(spark, monkeypatch):
    """A passage of many different texts and a group of near copies, both above a cell's size."""
    import tidekeep.llm.jaccard as jaccard
    rng = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, passage + "".join(f" u{k}_{j}" for j in range(rng.randrange(4, 26))))
            for k in range(400)]
    shared = [" ".join(f"q{g}_{j}" for j in range(12)) for g in range(40)]
    rows += [(1000 + k, passage + " " + shared[k % 40] + f" v{k}") for k in range(200)]
    base = [f"b{k}" for k in range(90)]
    for k in range(300):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(90)] = f"z{k}"
        rows.append((2000 + k, " ".join(words)))
    cut = []
    blocks = jaccard._blocks
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 100)
    monkeypatch.setattr(jaccard, "_blocks", lambda df: cut.append(blocks(df)) or cut[-1])
    assert answer(spark, rows) == brute(rows)
    assert sum(c.filter("class is not null").count() for c in cut) <= 10 * len(rows)


def test_every_column_in_the_first_block(spark, corpus, monkeypatch):
    import tidekeep.llm.jaccard as jaccard
    monkeypatch.setattr(jaccard, "FIRST_BLOCK", 0.999)
    assert answer(spark, corpus) == brute(corpus)


def test_empty_table_null_ids_and_repeated_rows(spark):
    assert answer(spark, []) == []
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"),
                                (2, "a b c d e f")], "doc_id long, text string")
    rows = [tuple(r) for r in jaccard_join(df).collect()]
    assert sorted(rows, key=str) == sorted([(None, 2, None), (4, 2, 2), (4, 2, 2), (2, 2, 2)],
                                           key=str)


def test_one_id_with_several_texts(spark):
    texts = [" ".join(f"t{k}_{j}" for j in range(100)) for k in range(6)]
    rows = [(1, t) for t in texts] + [(10 + k, t + " end") for k, t in enumerate(texts)]
    rows += [(20 + k, t + " end stop") for k, t in enumerate(texts)]
    assert answer(spark, rows) == brute(rows)
    assert {c for _, _, c in answer(spark, rows)} == {1}
