"""Jaccard join on word shingles as a blocked product of the document by shingle incidence.

A pair with 100 * overlap >= threshold * union shares all but a bounded number of shingles, which
gives every bound used here. The columns of the incidence are ordered by shingle hash.

1. *First column block.* The leading ``FIRST_BLOCK`` share of the columns, dealt to one task per
   slice of hashes, counts for each class of equal documents how many of its shingles any other
   class has. A class with more lonely shingles than the bound allows links with nothing and goes.
   Batches settle what they can see themselves: a shingle that two classes of a batch share is
   sent once, so neither copies nor a phrase of every document pile up in a task.
2. *All columns* of the classes left, the same way, now with the exact bound.
3. *Leaders.* The classes left list, rarest first, the leading shingles of which a linked pair
   must share one; each is a cell. Cells with equal members count once. Every member is compared
   with the smallest set of its cell, exactly; this gives the links inside large groups without
   their pairs.
4. *Large cells are dealt again.* Let L be the smallest set of a cell, A and B linked members, A
   not linked to L. L and A share less than A and B must, so A and B share a shingle outside L, and
   the rarest such shingle is among the leading ones of A without L and of B without L. Members
   of cells with more than ``BLOCK_DOCS`` outside their largest component so go to the cells of
   these shingles, unless the blocks of their own cell are fewer rows (texts of one template that
   differ in many places, say).
5. *Blocked product.* Cells that still hold several components are multiplied out in blocks,
   column chunk by column chunk, with pairs dropped as soon as their overlap plus what remains
   cannot reach the bound. The members outside the largest component meet each block of it; other
   large cells meet in all pairs of blocks. A block with more than four open pairs a member
   returns a spanning forest.

Fingerprints in steps 1 and 2 are 32 bits of the hash beside its slice: a clash can only keep a class.
Everything after that uses whole 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .frames import batch, binary_column, bounded, map_batches, text_bytes, written
from .hashing import distinct, shingles, words

FIRST_BLOCK = 0.3
BLOCK_DOCS = 256
CHUNK_COLUMNS = 2048
LEADER_ROUNDS = 2

_PASS = ("doc_id long, print long, class long, n long, block long, near long, slice int, "
         "prints binary, owners binary")
_SETS = "class long, n long, tokens array<long>"


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, hashes, class) of a batch: sorted distinct shingle hashes per text, and a 64-bit
    name of each set (0 for an empty one)."""
    docs, hashes = distinct(*shingles(*words(*text_bytes(texts)), n))
    bounds = np.searchsorted(docs, np.arange(len(texts) + 1))
    names = np.zeros(len(texts), np.int64)
    raw = hashes.view(np.uint8)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if b > a:
            digest = hashlib.blake2b(raw[8 * a:8 * b], digest_size=8).digest()
            names[i] = int.from_bytes(digest, "little", signed=True) or 1
    return bounds, hashes, names


def _settle(token: np.ndarray, owner: np.ndarray, doc: np.ndarray, rows: int, slices: int):
    """Deal (shingle, class) entries of a batch to slices.

    Returns how many shingles of each row another class of the batch has, and per slice its
    number, fingerprints and classes. A shingle of several classes is sent once, as class 0.
    """
    order = np.argsort(token, kind="stable")
    token, owner, doc = token[order], owner[order], doc[order]
    new = np.concatenate((np.ones(min(1, len(token)), bool), token[1:] != token[:-1]))
    run_of = np.cumsum(new) - 1
    shared = np.bincount(run_of)[run_of] > 1 if len(token) else new
    near = np.bincount(doc[shared], minlength=rows)
    keep = ~shared | new
    token, owner = token[keep], np.where(shared, 0, owner)[keep]
    part = ((token & np.uint64(0xFFFFF)) % np.uint64(slices)).astype(np.int64)
    prints = (token >> np.uint64(20)).astype(np.uint32)
    order = np.lexsort((owner, part))
    part, prints, owner = part[order], prints[order], owner[order]
    marks, opens = np.unique(part, return_index=True)
    spans = list(zip(opens.tolist(), np.append(opens[1:], len(part)).tolist()))
    return (near, pa.array(marks, pa.int32()),
            binary_column([prints[a:z].tobytes() for a, z in spans]),
            binary_column([owner[a:z].tobytes() for a, z in spans]))


def _stacked(names: list[str], upper: list[pa.Array | None], lower: list[pa.Array | None],
             kinds: list[pa.DataType]) -> pa.RecordBatch:
    """Rows of one kind above rows of another; None stands for a column of nulls."""
    sizes = [max(len(x) for x in part if x is not None) for part in (upper, lower)]
    filled = [[pa.nulls(n, k) if x is None else x.cast(k) for x, k in zip(part, kinds)]
              for part, n in zip((upper, lower), sizes)]
    return batch(names, [pa.concat_arrays(pair) for pair in zip(*filled)])


_KINDS = [pa.int64()] * 6 + [pa.int32(), pa.binary(), pa.binary()]
_NAMES = ["doc_id", "print", "class", "n", "block", "near", "slice", "prints", "owners"]


def _first_pass(words_per: int, slices: int):
    limit = np.uint64(int(FIRST_BLOCK * 2**64))

    def run(batches):
        for b in bounded(batches, 1):
            ids = b.column(0)
            bounds, hashes, names = shingle_sets(b.column(1), words_per)
            sizes = np.diff(bounds)
            known = np.asarray(ids.is_valid()) & (names != 0)
            # The first document of each class speaks for it.
            _, heads = np.unique(np.where(known, names, 0), return_index=True)
            speaks = np.zeros(len(names), bool)
            speaks[heads] = True
            speaks &= known
            inside = hashes < limit
            upto = np.concatenate(([0], np.cumsum(inside)))
            take = inside & np.repeat(speaks, sizes)
            doc = np.repeat(np.arange(len(names)), sizes)[take]
            near, *dealt = _settle(hashes[take], names[doc], doc, len(names), slices)
            yield _stacked(
                _NAMES, [ids, b.column(2), pa.array(names), pa.array(sizes),
                         pa.array(np.diff(upto[bounds])),
                         pa.array(near, pa.int64(), mask=~speaks), None, None, None],
                [None, None, None, None, None, None, *dealt], _KINDS)
    return run


def _all_columns(slices: int):
    def run(batches):
        for b in batches:
            tokens = b.column(2)
            sizes = np.diff(np.asarray(tokens.offsets))
            doc = np.repeat(np.arange(len(b)), sizes)
            names = b.column(0).to_numpy()
            flat = tokens.flatten().to_numpy().view(np.uint64)
            near, *dealt = _settle(flat, names[doc], doc, len(b), slices)
            yield _stacked(_NAMES, [None, None, b.column(0), b.column(1), None, pa.array(near),
                                    None, None, None],
                           [None, None, None, None, None, None, *dealt], _KINDS)
    return run


def _count_shared(parts_out: int):
    def run(batches):
        """Of one slice of the columns: how many shingles of each class another class has."""
        parts: dict[int, list[tuple[bytes, bytes]]] = {}
        for b in batches:
            for slice_, prints, owners in zip(*(c.to_pylist() for c in b.columns)):
                parts.setdefault(slice_, []).append((prints, owners))
        for rows in parts.values():
            prints = np.frombuffer(b"".join(x[0] for x in rows), np.uint32)
            owners = np.frombuffer(b"".join(x[1] for x in rows), np.int64)
            order = np.lexsort((owners, prints))
            prints, owners = prints[order], owners[order]
            new = np.concatenate(([True], prints[1:] != prints[:-1]))
            first = new | np.concatenate(([True], owners[1:] != owners[:-1]))
            prints, owners, new = prints[first], owners[first], new[first]
            run_of = np.cumsum(new) - 1
            flagged = np.zeros(int(run_of[-1]) + 1, bool)
            flagged[run_of[owners == 0]] = True
            shared = (flagged | (np.bincount(run_of) > 1))[run_of] & (owners != 0)
            names, counts = np.unique(owners[shared], return_counts=True)
            part = (names.view(np.uint64) % np.uint64(parts_out)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            names, counts = names[order], counts[order].astype(np.uint32)
            marks, opens = np.unique(part[order], return_index=True)
            spans = list(zip(opens.tolist(), np.append(opens[1:], len(part)).tolist()))
            yield batch(["part", "names", "counts"], [
                pa.array(marks, pa.int32()),
                binary_column([names[a:z].tobytes() for a, z in spans]),
                binary_column([counts[a:z].tobytes() for a, z in spans])])
    return run


def _sum_shared(batches):
    rows = [r for b in batches for r in zip(b.column("names").to_pylist(),
                                            b.column("counts").to_pylist())]
    names, at = np.unique(np.frombuffer(b"".join(r[0] for r in rows), np.int64),
                          return_inverse=True)
    counts = np.frombuffer(b"".join(r[1] for r in rows), np.uint32)
    yield batch(["class", "shared"], [
        pa.array(names), pa.array(np.bincount(at, counts, len(names)).astype(np.int64))])


def _sets_of(words_per: int):
    def run(batches):
        for b in bounded(batches, 0):
            bounds, hashes, names = shingle_sets(b.column(0), words_per)
            wanted = np.asarray(b.column(1))
            fits = np.flatnonzero(wanted == names)
            right = fits[np.unique(names[fits], return_index=True)[1]]
            signed = hashes.view(np.int64)
            rows = [signed[bounds[i]:bounds[i + 1]] for i in right]
            offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            yield batch(["class", "n", "tokens"], [
                pa.array(names[right]), pa.array(np.diff(bounds)[right], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))])
    return run


def _overlaps(sets: list[np.ndarray]):
    """(overlap counts, entries of each set still to come) after each chunk of columns of the
    product of an incidence with its transpose."""
    m = len(sets)
    doc = np.repeat(np.arange(m), [len(x) for x in sets])
    _, column, df = np.unique(np.concatenate([*sets, np.zeros(0, np.int64)]),
                              return_inverse=True, return_counts=True)
    used = df[column] > 1  # a column with one entry adds to no overlap
    place = np.cumsum(df > 1) - 1
    doc, column = doc[used], place[column[used]]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    rest = np.bincount(doc, minlength=m)
    overlap = np.zeros((m, m), np.int64)
    yield overlap, rest
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, CHUNK_COLUMNS):
        a, z = np.searchsorted(column, (start, start + CHUNK_COLUMNS))
        dense = np.zeros((m, CHUNK_COLUMNS), np.float32)
        dense[doc[a:z], column[a:z] - start] = 1
        overlap = overlap + (dense @ dense.T).astype(np.int64)
        rest = rest - np.bincount(doc[a:z], minlength=m)
        yield overlap, rest


def _open_pairs(threshold: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Pairs of a cell whose leading shingles leave room for a link, from those alone.

        Of two sets, let the one whose leading part ends first have n shingles, p of them leading.
        All that is shared up to that end is in both leading parts, and n - p can follow. A cell
        with many open pairs is returned as one row without a pair, to be multiplied out.
        """
        cell = int(frame["cell"].iloc[0])
        names, group, n = (frame[c].to_numpy() for c in ("class", "component", "n"))
        for overlap, _ in _overlaps(frame["heads"].tolist()):
            pass
        after = -(-n * threshold // 100) - 1
        most = np.minimum(overlap + np.maximum(after[:, None], after[None, :]),
                          np.minimum(n[:, None], n[None, :]))
        open_ = ((100 + threshold) * most >= threshold * (n[:, None] + n[None, :])) & (
            group[:, None] != group[None, :])
        i, j = np.nonzero(np.triu(open_, 1))
        if len(i) > 4 * len(names):
            return pd.DataFrame([{"a": None, "b": None, "cell": cell}]).astype(
                {"a": "Int64", "b": "Int64"})
        return pd.DataFrame({"a": names[i], "b": names[j], "cell": cell})
    return run


def _product(threshold: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Links of one cell as a spanning forest over components."""
        names, group = frame["class"].to_numpy(), frame["component"].to_numpy()
        sets = frame["tokens"].tolist()
        sizes = frame["n"].to_numpy()
        union = sizes[:, None] + sizes[None, :]
        open_ = np.triu(group[:, None] != group[None, :], 1)
        for overlap, rest in _overlaps(sets):
            most = overlap + np.minimum(rest[:, None], rest[None, :])
            open_ &= (100 + threshold) * most >= threshold * union
            if not open_.any():
                break
        at = np.argwhere(open_)
        parent = {c: c for c in group.tolist()}

        def top(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        kept = []
        for i, j in at.tolist():
            x, y = top(int(group[i])), top(int(group[j]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                kept.append((int(names[i]), int(names[j])))
        return pd.DataFrame(kept, columns=["a", "b"], dtype="int64")
    return run


def classes(documents: DataFrame, words_per: int, threshold: int, key: str,
            text: str) -> tuple[DataFrame, DataFrame]:
    """((doc_id, class, n) per row, survivors (class, n, doc_id, print) of the first column block).

    A class is spoken for by the text with hash ``print`` of its smallest doc_id.
    """
    slices = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text),
                            F.xxhash64(text).alias("print"))
    first = written(map_batches(slim, _first_pass(words_per, slices), _PASS), "incidence")
    rows = first.filter("slice is null").select(
        "doc_id", "print", "class", "n", "block", "near")
    counted = _shared(first, slices)
    seen = rows.filter("n > 0 and doc_id is not null").groupBy("class").agg(
        F.min(F.struct("doc_id", "print")).alias("head"), F.max("n").alias("n"),
        F.max("block").alias("block"), F.min("near").alias("near"))
    # near comes from the row that speaks for the class, once per batch that holds the class. A
    # shingle that was settled in one of these batches but not in all was also sent, so the
    # smallest of them keeps the sum from counting less than what is shared.
    slack = F.floor(F.col("n") * (100 - threshold) / 100)
    lonely = F.col("block") - F.col("near") - F.coalesce("shared", F.lit(0))
    left = seen.join(counted, "class", "left").filter(lonely <= slack)
    return rows.select("doc_id", "class", "n"), written(
        left.select("class", "n", "head.doc_id", "head.print"), "survivors")


def _shared(dealt: DataFrame, slices: int) -> DataFrame:
    """(class, shared): shingles of each class that another has, not counting the near ones."""
    counted = map_batches(
        dealt.filter("slice is not null").select("slice", "prints", "owners")
        .repartition(slices, "slice"), _count_shared(slices),
        "part int, names binary, counts binary")
    return map_batches(counted.repartition(slices, "part"), _sum_shared,
                       "class long, shared long")


def narrowed(sets: DataFrame, threshold: int) -> DataFrame:
    """The sets whose lonely shingles, over all columns, leave room for a link."""
    slices = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(map_batches(sets, _all_columns(slices), _PASS), "incidence")
    near = dealt.filter("slice is null").select("class", "near")
    lonely = F.col("n") - F.col("near") - F.coalesce("shared", F.lit(0))
    kept = near.join(_shared(dealt, slices), "class", "left").join(
        sets.select("class", "n"), "class").filter(
        lonely <= F.floor(F.col("n") * (100 - threshold) / 100)).select("class")
    return written(sets.join(kept, "class"), "sets")


def ranked(sets: DataFrame, threshold: int) -> DataFrame:
    """(class, n, tokens, room): the shingles that another set has too, rarest first, and how many
    of them lead. Two linked sets share one of the leading ones; shingles that no other set has
    take their places but are not listed."""
    entries = sets.select("class", "n", F.explode("tokens").alias("token"))
    common = entries.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    listed = entries.join(common, "token").groupBy("class", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    places = F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1
    room = F.greatest(places - (F.col("n") - F.size("shared")), F.lit(0)).cast("int")
    return written(listed.select("class", "n", F.transform(
        "shared", lambda x: x["token"]).alias("tokens"), room.alias("room")), "ranked")


def _spread(sets: DataFrame, threshold: int) -> DataFrame:
    """(cell, class, n) per leading shingle.

    Linked sets differ in size by a bounded factor. Sizes fall into classes a little wider than
    that, and each row stands in the span of its own and of the next class, so that two linked
    sets meet in one.
    """
    span = F.floor(F.log("n") / math.log(100 / threshold * 1.0001)).cast("int")
    heads = sets.select("class", "n", span.alias("own"), F.explode(_heads("tokens")).alias("token"))
    return heads.select("class", "n", "token", F.explode(
        F.array(F.col("own"), F.col("own") + 1)).alias("span")).select(
        F.xxhash64("token", "span").alias("cell"), "class", "n")


def _heads(tokens: str | Column) -> Column:
    return F.slice(tokens, F.lit(1), F.col("room"))


def _cells(rows: DataFrame, *within: str) -> DataFrame:
    """The rows (cell, class, n) of cells with several members; of cells with the same members
    (and equal columns ``within``) one stays."""
    several = rows.groupBy("cell", *within).agg(
        F.count("*").alias("g"), F.min("class").alias("least"),
        F.bit_xor(F.xxhash64("class")).alias("x"),
        F.bit_xor(F.xxhash64("class", F.lit(1))).alias("y")).filter("g > 1")
    chosen = several.groupBy("g", "least", "x", "y", *within).agg(F.min("cell").alias("cell"))
    return written(rows.join(chosen.select("cell"), "cell").select(
        "cell", "class", "n", *within), "cells")


def _mixed(member: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of cells that hold several components, each with the smallest set of its cell
    as leader and the number of members."""
    labelled = written(member.join(labels, "class"), "labelled")
    mixed = labelled.groupBy("cell").agg(
        F.min(F.struct("n", "class", "component")).alias("first"),
        F.min("component").alias("low"), F.max("component").alias("high"),
        F.count("*").alias("g")).filter("low != high").select(
        "cell", "g", F.col("first.class").alias("leader"), F.col("first.n").alias("leader_n"),
        F.col("first.component").alias("leader_component"))
    return written(labelled.join(mixed, "cell"), "mixed")


def link_components(sets: DataFrame, threshold: int) -> DataFrame:
    """(class, component) of the written sets (class, n, tokens)."""
    order = ranked(sets, threshold)
    member = _cells(_spread(order, threshold))
    nodes = sets.select(F.col("class").alias("node"))
    labels = nodes.select(F.col("node").alias("class"), F.col("node").alias("component"))
    edges = None

    def linked(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        found = written(found, "links")
        together = found if edges is None else edges.union(found)
        return together, components(nodes, together).select(
            F.col("node").alias("class"), "component")

    for _ in range(LEADER_ROUNDS):
        mixed = _mixed(member, labels)
        if mixed.isEmpty():
            return labels
        edges, labels = linked(_verified(mixed.filter(
            (F.col("component") != F.col("leader_component"))
            & (100 * F.least("n", "leader_n") >= threshold * F.greatest("n", "leader_n"))
        ).select("class", "leader").distinct(), order, threshold))
        # The leader has met every member of its cell.
        member = mixed.filter(F.col("class") != F.col("leader")).select("cell", "class", "n")
    mixed = _mixed(member, labels)
    if mixed.isEmpty():
        return labels
    sized = _majority(mixed)
    # Large cells under one leader are one cell, in which each member stands once.
    wide = F.col("others") > BLOCK_DOCS
    large = written(sized.filter(wide & (F.col("class") != F.col("leader"))).select(
        F.col("leader").alias("cell"), "leader", "class", "n").distinct(), "large")
    rest = sized.filter(~wide).select("cell", "class", "n").union(
        large.select("cell", "class", "n"))
    met = written(_compared(large.select("class", "leader"), order).select(
        "class", "leader", "overlap", (F.col("n1") + F.col("n2")).alias("sizes"),
        _heads(F.array_except("t1", "t2")).alias("heads")), "met")
    if not met.isEmpty():
        edges, labels = linked(met.filter(
            (100 + threshold) * F.col("overlap") >= threshold * F.col("sizes")).select(
            F.col("leader").alias("a"), F.col("class").alias("b")))
        dealt = _cells(large.join(met.filter(F.size("heads") > 0), ["class", "leader"]).select(
            F.col("cell").alias("parent"), "class", "n", F.explode("heads").alias("token"))
            .withColumn("cell", F.xxhash64("parent", "token")), "parent")
        sized = _cheaper(_majority(_mixed(rest, labels)),
                         large.select("cell").distinct(), _majority(_mixed(dealt, labels)))
    return linked(_inside(_blocks(sized), order, threshold))[1]


def _cheaper(cells: DataFrame, large: DataFrame, dealt: DataFrame) -> DataFrame:
    """Rows (cell, class, component, main, s, others, g): of each large cell its own or those of
    the cells it was dealt to (column ``parent``), whichever takes fewer rows in blocks."""
    rows = F.sum(F.when(F.col("others") <= BLOCK_DOCS, F.lit(1)).otherwise(
        F.ceil(F.col("g") / BLOCK_DOCS)))
    after = dealt.groupBy(F.col("parent").alias("cell")).agg(rows.alias("after"))
    better = written(cells.groupBy("cell").agg(rows.alias("before")).join(large, "cell").join(
        after, "cell", "left").filter(F.coalesce("after", F.lit(0)) < F.col("before")).select(
        "cell"), "better")
    names = ["cell", "class", "component", "main", "s", "others", "g"]
    return cells.join(better, "cell", "left_anti").select(names).union(
        dealt.join(better.select(F.col("cell").alias("parent")), "parent").select(names))


def _majority(mixed: DataFrame) -> DataFrame:
    """Adds to the rows of each cell its largest component and how many members are of others."""
    sizes = mixed.groupBy("cell", "component").agg(F.count("*").alias("s"))
    main = sizes.groupBy("cell").agg(
        F.max(F.struct("s", "component")).alias("m"), F.sum("s").alias("all")).select(
        "cell", F.col("m.component").alias("main"), F.col("m.s").alias("s"),
        (F.col("all") - F.col("m.s")).alias("others"))
    return written(mixed.join(main, "cell"), "sized")


def _blocks(sized: DataFrame) -> DataFrame:
    """(cell, class, component) with cells cut to at most about twice ``BLOCK_DOCS`` members.

    Members of one component need not meet. Where few are of other components, these few go to
    every block of the largest one, which at most doubles the rows. Other large cells meet in
    pairs of blocks.
    """
    lean = F.col("others") <= BLOCK_DOCS
    blocks = F.ceil(F.when(lean, F.col("s")).otherwise(F.col("g")) / BLOCK_DOCS).cast("int")
    dealt = sized.withColumn("blocks", blocks).withColumn(
        "own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = dealt.withColumn("at", F.explode(F.when(
        lean & (F.col("component") == F.col("main")), F.array("own")).otherwise(every)))
    low = F.when(lean, F.col("at")).otherwise(F.least("own", "at"))
    high = F.when(lean, F.col("at")).otherwise(F.greatest("own", "at"))
    return dealt.select(F.xxhash64("cell", low, high).alias("cell"), "class", "component")


def _inside(blocks: DataFrame, order: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) inside blocks."""
    rows = written(blocks, "blocks")
    leads = order.select("class", "n", _heads("tokens").alias("heads"))
    pairs = written(rows.join(leads, "class").groupBy("cell").applyInPandas(
        _open_pairs(threshold), "a long, b long, cell long"), "open")
    found = _verified(pairs.filter("a is not null").select(
        F.col("a").alias("class"), F.col("b").alias("leader")).distinct(), order, threshold)
    dense = pairs.filter("a is null").select("cell")
    carried = rows.join(dense, "cell").join(order.select("class", "n", "tokens"), "class")
    return found.union(carried.groupBy("cell").applyInPandas(
        _product(threshold), "a long, b long").distinct())


def _compared(pairs: DataFrame, order: DataFrame) -> DataFrame:
    """Pairs (class, leader) with sizes, shared shingles of both and the overlap."""
    left = order.select("class", "room", F.col("n").alias("n1"), F.col("tokens").alias("t1"))
    right = order.select(F.col("class").alias("leader"), F.col("n").alias("n2"),
                         F.col("tokens").alias("t2"))
    return pairs.join(left, "class").join(right, "leader").withColumn(
        "overlap", F.size(F.array_intersect("t1", "t2")))


def _verified(pairs: DataFrame, order: DataFrame, threshold: int) -> DataFrame:
    return _compared(pairs, order).filter(
        (100 + threshold) * F.col("overlap") >= threshold * (F.col("n1") + F.col("n2"))).select(
        F.col("leader").alias("a"), F.col("class").alias("b"))


def jaccard_join(documents: DataFrame, words_per: int = 5, threshold: int = 80,
                 key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``documents``.

    Two documents link when 100 * overlap >= threshold * union of their shingle sets;
    ``component_id`` is the smallest doc_id reachable over links. Documents without words (null
    and empty texts too) have no shingles and are components of their own. Rows that repeat a
    doc_id are linked through equal texts or not at all. A row without doc_id takes no part and
    has a null component. Other columns are not read; an empty table gives no rows.
    """
    rows, left = classes(documents, words_per, threshold, key, text)
    # An id may have several texts: by id and text each class gets its own text and no other.
    wanted = left.select(F.col("doc_id").alias("_id"), F.col("print").alias("_print"),
                         F.col("class").alias("_class"))
    texts = documents.select(F.col(key).cast("long").alias("_id"), F.xxhash64(text).alias("_print"),
                             F.col(text).alias("_text")) \
        .join(wanted.hint("merge"), ["_id", "_print"]).select("_text", "_class")
    sets = written(map_batches(texts, _sets_of(words_per), _SETS).dropDuplicates(["class"]),
                   "sets")
    named = link_components(narrowed(sets, threshold), threshold)
    labelled = left.drop("print").join(named, "class")
    lowest = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    smallest = labelled.join(lowest, "component").select("class", "component_id")
    alone = rows.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("own"))
    final = alone.join(smallest, "class", "left").select(
        "class", F.coalesce("component_id", "own").alias("component_id"))
    return rows.join(final, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
        .alias("component_id"))
