"""Near-duplicates by SuperMinHash signatures, banding, exact verification and union-find (operator 4).

SuperMinHash gives each element of a set a random permutation of the m registers and the
value j + u at the permutation's j-th place, u uniform; a register keeps its least value. All elements
of a batch take step j together, and a document stops as soon as its largest register is
below the next step. Places and values come from one permutation, hence the lower variance.

Links are found in two passes. First come ROUNDS rounds of leaders (one; a second and a third found hardly a link more for as much work): every document is compared on full sets with
one leader, of those that the documents of a band key agree on the one that it shares most bands with, and what is linked becomes a tree. Then all documents that share a band key with another tree meet, through
filters that lose no pair at the threshold: sizes and the parity bitmaps of two sets bound what they can share. Pairs that pass are compared on full sets.

A key's documents meet in blocks of a bounded number; documents of the key's largest tree don't meet one another, so a row is
repeated only as often as there are blocks of other trees. Documents of keys with more than DIRECT such blocks are joined on their sets' rarest
shingles instead (prefix filter): two sets at the threshold share one, and families just below it mostly don't.

Where many pairs of two blocks pass, only a spanning forest of their trees is compared at first, likeliest pairs before others. If all of
its links hold, every other pair's trees are joined already; keys with a link that failed, and whose ends nothing else joined, give all their pairs in a second pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: 40 bands of 4 registers: a pair at a similarity of 0.8 shares none about 7 times in 10^10.
BANDS, ROWS = 40, 4
ROUNDS = 1
#: Documents in a block, the blocks beside a key's largest tree up to which its documents meet by the key, and bits of a parity bitmap in the first and the second way of meeting.
BLOCK, DIRECT, PARITY, WIDE_PARITY = 512, 4, 512, 2048
#: Pairs for each row of two blocks up to which all are compared at once, and pairs held before they are thinned to a forest.
FEW, HELD = 2, 1 << 19
_GOLD = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


def runs(row: np.ndarray, n: int, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """The shingles of n rows, whose words' rows are row: (words in a shingle, first word of each). A row of fewer than k words has one of all its words."""
    at = common.per_row(row, n)
    count = np.diff(at)
    if len(row) >= k:
        yield k, np.flatnonzero(row[k - 1 :] == row[: len(row) - k + 1])
    for size in range(1, k):
        yield size, at[np.flatnonzero(count == size)]


def shingles(data: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, second hash) of each row's distinct k-word shingles, sorted; a row of fewer words has all of them as one."""
    data = common.LOWER[data]
    start, end, row = common.words(data, bounds)
    lanes = [common.Ranges(data, k)(start, end) for k in (0, 1)]
    rows, hashes = [np.zeros(0, dtype=np.int64)], [np.zeros((2, 0), dtype=np.uint64)]
    for size, first in runs(row, len(bounds) - 1, k):
        both = []
        for word in lanes:
            found = word[first]
            for j in range(1, size):
                found = common.mix(found * np.uint64(_GOLD) + word[first + j])
            both.append(common.mix(found ^ np.uint64(size * _GOLD & _M64)))
        rows.append(row[first])
        hashes.append(np.stack(both))
    r, h = np.concatenate(rows), np.concatenate(hashes, axis=1)
    order = np.lexsort((h[0], r))
    r, h = r[order], h[:, order]
    new = np.ones(len(r), dtype=bool)
    new[1:] = (r[1:] != r[:-1]) | (h[0, 1:] != h[0, :-1])
    return r[new], h[0, new], h[1, new]


def exact_shingles(data: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of each row's distinct shingles, sorted; numbers are equal for equal words, byte by byte, only."""
    data = common.LOWER[data]
    start, end, row = common.words(data, bounds)
    word = common.identify(data, start, end, common.Ranges(data))
    rows, numbers, used = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], 0
    for size, first in runs(row, len(bounds) - 1, k):
        found = word[first]
        for j in range(1, size):
            found = common.pair_up(found, word[first + j])
        rows.append(row[first])
        numbers.append(found + used)
        used += len(word)
    r, x = np.concatenate(rows), np.concatenate(numbers)
    order = np.lexsort((x, r))
    r, x = r[order], x[order]
    new = np.ones(len(r), dtype=bool)
    new[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1])
    return r[new], x[new]


def super_minhash(row: np.ndarray, element: np.ndarray, n: int, m: int, most: int = 16_000) -> np.ndarray:
    """n x m registers, each j * 2**32 + a random 32 bits; rows without elements keep the largest value.

    Rows are taken up by size, about most elements at a time, since small sets take more steps.
    """
    registers = np.full((n, m), _M64, dtype=np.uint64)
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    by_size = np.argsort(count, kind="stable")
    by_size = by_size[count[by_size] > 0]
    batch = (np.cumsum(count[by_size]) - 1) // most
    for b in range(int(batch[-1]) + 1 if len(batch) else 0):
        rows = by_size[batch == b]
        if not len(rows):
            continue
        if len(rows) == 1 and count[rows[0]] > most:  # the registers of a large set are the least of its parts'
            for at in range(first[rows[0]], first[rows[0]] + count[rows[0]], most):
                part = element[at : min(at + most, first[rows[0]] + count[rows[0]])]
                registers[rows] = np.minimum(registers[rows], _super_minhash(np.zeros(len(part), dtype=np.int64), part, 1, m))
            continue
        own = np.repeat(np.arange(len(rows)), count[rows])
        at = np.arange(len(own)) - np.repeat(np.cumsum(count[rows]) - count[rows], count[rows]) + np.repeat(first[rows], count[rows])
        registers[rows] = _super_minhash(own, element[at], len(rows), m)
    return registers


def _super_minhash(row: np.ndarray, element: np.ndarray, n: int, m: int) -> np.ndarray:
    registers = np.full((n, m), _M64, dtype=np.uint64)
    flat = registers.reshape(-1)
    base = row * m
    places = np.tile(np.arange(m, dtype=np.uint16), (len(row), 1))
    idx = np.arange(len(row))
    look = 0
    for j in range(m):
        x = common.mix(element + np.uint64((j + 1) * _GOLD & _M64))
        k = (((x & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64) + j
        place = places[idx, k]
        places[idx, k] = places[idx, j]
        np.minimum.at(flat, base + place, (x >> np.uint64(32)) + np.uint64(j << 32))
        if j < look:  # a row may take a few steps that change nothing
            continue
        look = j + 1 + j // 8
        going = registers.max(axis=1)[row] >= np.uint64((j + 1) << 32)
        if not going.all():
            row, element, base, places = row[going], element[going], base[going], places[going]
            idx = np.arange(len(row))
            if not len(row):
                break
    return registers


def parities(row: np.ndarray, element: np.ndarray, n: int, bits: int) -> np.ndarray:
    """n x bits / 8 bytes: a bit is set if an odd number of the row's elements fall on it, so at most as many bits differ between rows as elements do."""
    odd = np.bincount(row * bits + (element >> np.uint64(17) & np.uint64(bits - 1)).astype(np.int64), minlength=n * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, bits), axis=1)


def band_keys(registers: np.ndarray, rows: int) -> np.ndarray:
    """One key per band of that many registers; a key tells its band too."""
    n, m = registers.shape
    bands = registers.reshape(n, m // rows, rows)
    key = np.broadcast_to(common.mix(np.arange(1, m // rows + 1, dtype=np.uint64) * np.uint64(_GOLD)), (n, m // rows))
    for j in range(rows):
        key = common.mix(key * np.uint64(_GOLD) + bands[:, :, j])
    return key


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, two sums that identify the set, the band keys and the set's parity bitmap."""
    common.ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text"):
            n = part.num_rows
            row, h, twin = shingles(*common.buffers(part.column("text")), k)
            count = np.bincount(row, minlength=n)
            some = np.flatnonzero(count)
            sums = np.zeros((2, n), dtype=np.uint64)
            if len(some):
                at = common.per_row(row, n)[some]
                sums[0, some], sums[1, some] = np.add.reduceat(common.mix(h), at), np.add.reduceat(common.mix(twin ^ np.uint64(_GOLD)), at)
            keys = common.signed(np.ascontiguousarray(band_keys(super_minhash(row, h, n, BANDS * ROWS), ROWS)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(count.astype(np.int64)), pa.array(common.signed(sums[0])), pa.array(common.signed(sums[1])), lists, pa.array([x.tobytes() for x in parities(row, h, n, PARITY)], pa.binary())], ["doc_id", "n_shingles", "set_a", "set_b", "bands", "bits"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, bits binary")


def texts_of(docs: DataFrame, ids: DataFrame, repeated: bool) -> DataFrame:
    """(id, text) of docs whose id may be among ids; repeated: rows may repeat and then come once."""
    found = common.may_hold(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), ids, "id", "hit").where("hit").select("id", "text")
    return found.join(ids.select("id").distinct(), "id", "left_semi").distinct() if repeated else found


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int, repeated: bool = True) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    texts = texts_of(docs, pairs.select(F.col("a").alias("id")).union(pairs.select("b")), repeated)
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text_a"):
            n = part.num_rows
            (data, bounds), (other, more) = (common.buffers(part.column(c)) for c in ("text_a", "text_b"))
            r, x = exact_shingles(np.concatenate([data, other]), np.concatenate([bounds, bounds[-1] + more[1:]]), k)
            order = np.lexsort((x, r % n))
            r, x = r[order] % n, x[order]
            shared = np.bincount(r[1:][(r[1:] == r[:-1]) & (x[1:] == x[:-1])], minlength=n)
            union = np.bincount(r, minlength=n) - shared
            yield part.select(["a", "b"]).filter(pa.array((100 * shared >= percent * union) & (union > 0)))

    return both.mapInArrow(run, "a long, b long")


def rare_shingles(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(key, rep, tree, n, pos, bits) for texts (rep, tree, text): the shingles of each set's prefix that another tree's sets have too.

    Shingles are ordered from rare to frequent among these sets. Two sets with 100 * intersection >= percent * union share a
    shingle that is within the first n - ceil(percent * n / 100) + 1 of either. pos counts from 1; bits is the set's parity bitmap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text"):
            row, h, _ = shingles(*common.buffers(part.column("text")), k)
            at = common.per_row(row, part.num_rows)
            bits = [x.tobytes() for x in parities(row, h, part.num_rows, WIDE_PARITY)]
            yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("tree"), pa.array(np.diff(at)), pa.array(bits, pa.binary()), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(common.signed(h)))], ["rep", "tree", "n", "bits", "elements"])

    sets = common.cut(texts.select("rep", "tree", "text").mapInArrow(run, "rep long, tree long, n long, bits binary, elements array<long>").withColumn("item", F.monotonically_increasing_id()))
    often = common.cut(sets.select("tree", F.explode("elements").alias("key")).groupBy("key").agg(F.count("*").alias("c"), F.min("tree").alias("x"), F.max("tree").alias("y")).where("c > 1").select("key", "c", (F.col("x") != F.col("y")).alias("across")))
    mine = sets.select("item", "n", F.explode("elements").alias("key")).join(often, "key").groupBy("item", "n").agg(F.collect_list(F.struct("c", "key", "across")).alias("xs"))
    # a set's shingles that no other has come first and are only counted
    alone = F.col("n") - F.size("xs")
    last = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1
    prefix = mine.select("item", alone.alias("alone"), F.posexplode(F.slice(F.array_sort("xs"), F.lit(1), F.greatest(last - alone, F.lit(0)).cast("int"))).alias("i", "x"))
    places = common.cut(prefix.where("x.across").select("item", "x.key", (F.col("alone") + F.col("i") + 1).alias("pos")))
    found = common.cut(places.join(sets.select("item", "rep", "tree", "n", "bits"), "item").drop("item"))
    common.drop(sets, often, places)
    return found


def key_sizes(members: DataFrame) -> DataFrame:
    """key, first (its largest tree) and the numbers of blocks of first (of_first) and of all others (of_rest), for keys of several trees; written and read again."""
    trees = members.groupBy("key", "tree").agg(F.count("*").alias("c"))
    sizes = trees.groupBy("key").agg(F.max(F.struct("c", "tree")).alias("most"), F.sum("c").alias("all"))
    most = F.ceil(F.col("most.c") / BLOCK).cast("int")
    return common.cut(sizes.select("key", F.col("most.tree").alias("first"), most.alias("of_first"), F.ceil((F.col("all") - F.col("most.c")) / BLOCK).cast("int").alias("of_rest")).where("of_rest > 0"))


def _blocks(members: DataFrame, sizes: DataFrame, keep: list[str]) -> DataFrame:
    """members (key, rep, tree, ...) of the keys of key_sizes() in blocks: a row for each pair of blocks of its key that it is part of, sorted by key, lo, hi.

    A key's members are dealt into blocks of about BLOCK rows, and each two blocks meet in one place, but for two blocks
    of the key's largest tree. No task holds more than two blocks of a key however many members it has.
    """
    dealt = members.join(sizes, "key").withColumn("is_first", F.col("tree") == F.col("first"))
    deal = F.xxhash64("rep")
    dealt = dealt.withColumn("own", F.when(F.col("is_first"), F.col("of_rest") + F.pmod(deal, F.col("of_first"))).otherwise(F.pmod(deal, F.col("of_rest"))).cast("int"))
    # the first blocks are those of the rest: they meet all
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("is_first"), F.col("of_rest")).otherwise(F.col("of_rest") + F.col("of_first")) - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", *keep)
    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")


def _whole_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches put together so that no (key, lo, hi) is cut, at about so many rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            held.append(batch.slice(at, 256))
            if sum(b.num_rows for b in held) < rows:
                continue
            part = pa.Table.from_batches(held)
            group = np.stack([part.column(c).to_numpy() for c in ("key", "lo", "hi")])
            same = (group == group[:, -1:]).all(axis=0)
            whole = 0 if same.all() else len(same) - int(np.argmin(same[::-1]))  # where the last group begins
            if whole:
                yield part.slice(0, whole)
            held = part.slice(whole).to_batches()
    if held:
        yield pa.Table.from_batches(held)
    common.give_back()


def forest(p: np.ndarray, q: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """The places of the edges (p, q) between n nodes that make up a spanning forest of least weight (Boruvka)."""
    order = np.argsort(weight, kind="stable")
    p, q = p[order], q[order]
    label, chosen, open_ = np.arange(n), np.zeros(len(p), dtype=bool), np.arange(len(p))
    while len(open_):
        x, y = label[p[open_]], label[q[open_]]
        apart = x != y
        open_, x, y = open_[apart], x[apart], y[apart]
        if not len(open_):
            break
        best = np.full(n, len(p))
        np.minimum.at(best, x, open_)
        np.minimum.at(best, y, open_)
        tops = np.flatnonzero(best < len(p))
        chosen[best[tops]] = True
        x, y = label[p[best[tops]]], label[q[best[tops]]]
        up = np.arange(n)
        up[tops] = np.where(x == tops, y, x)
        twice = up[up]
        both = (twice == np.arange(n)) & (np.arange(n) < up)  # two that chose the same edge: the lesser is the root
        up[both] = np.flatnonzero(both)
        while (up[up] != up).any():
            up = up[up]
        label = up[label]
    return order[chosen]


def candidates(members: DataFrame, sizes: DataFrame, percent: int, thin: bool = False) -> DataFrame:
    """Pairs (a, b), a > b, of members (key, rep, tree, n, pos, bits) of the same key and different trees that sizes, places and bitmaps allow; some come repeatedly.

    pos: up to which place, from 1, of its n ordered shingles a set shares none with the others of its key; 1 where that isn't known.
    thin: two blocks with more than FEW pairs for each of their rows give only a spanning forest of their trees. Pairs then have their key too, null for those of blocks that give all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_groups(batches, 8192):
            key, lo, hi, own, rep, tree, n, pos = (part.column(c).to_numpy() for c in ("key", "lo", "hi", "own", "rep", "tree", "n", "pos"))
            bits = np.frombuffer(b"".join(part.column("bits").to_pylist()), dtype=np.uint64).reshape(len(key), -1)
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
            group = np.cumsum(new) - 1
            rows = np.bincount(group)
            node = np.unique(np.stack([group, tree]), axis=1, return_inverse=True)[1].reshape(-1)
            # pairs by their places, and how far apart the bitmaps are for their sets' sizes
            kept, more, held = (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0),), [], 0
            many = np.zeros(len(rows), dtype=bool)

            def put_together() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                p, q, far = (np.concatenate(x) for x in zip(kept, *more))
                if thin:
                    many[:] |= np.bincount(group[p], minlength=len(rows)) > FEW * rows
                    dense = many[group[p]]
                    at = np.flatnonzero(dense)
                    at = np.concatenate([np.flatnonzero(~dense), at[forest(node[p[at]], node[q[at]], far[at], len(key))]])
                    p, q, far = p[at], q[at], far[at]
                return p, q, far

            i = np.arange(len(key))
            for d in range(1, len(key)):
                i = i[i + d < len(key)]
                i = i[group[i] == group[i + d]]
                if not len(i):
                    break
                j = i + d
                both = n[i] + n[j]
                room = 1 + np.minimum(n[i] - pos[i], n[j] - pos[j])
                ok = (tree[i] != tree[j]) & ((own[i] != own[j]) | (lo[i] == hi[i])) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & ((100 + percent) * room >= percent * both)
                p, q, both = i[ok], j[ok], both[ok]
                apart = np.bitwise_count(bits[p] ^ bits[q]).sum(axis=1, dtype=np.int64)
                near = apart * (100 + percent) <= (100 - percent) * both
                if near.any():
                    more.append((p[near], q[near], apart[near] / both[near]))
                    held += len(more[-1][0])
                if thin and held > HELD:
                    kept, more, held = put_together(), [], 0
            p, q, _ = put_together()
            of = np.where(many[group[p]], key[p], 0) if thin else np.zeros(len(p), dtype=np.int64)
            pairs = np.unique(np.stack([np.maximum(rep[p], rep[q]), np.minimum(rep[p], rep[q]), of, many[group[p]]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(pairs[:, 2], mask=pairs[:, 3] == 0)], ["a", "b", "key"])

    pairs = _blocks(members, sizes, ["rep", "tree", "n", "pos", "bits"]).mapInArrow(run, "a long, b long, key long").where("a <> b")
    return pairs if thin else pairs.select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least id that each end of an edge (a, b) is joined with.

    Union-find on tables: labels sink along edges, then jump to their label's label, until none changes.
    """
    both = common.cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = common.cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("root")))
    while True:
        sunk = both.join(labels.toDF("b", "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        sunk = labels.join(sunk, F.col("id") == F.col("a")).select("id", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        up = labels.toDF("up", "above")
        nxt = common.cut(sunk.join(up, F.col("root") == F.col("up"), "left").select("id", F.least("root", "above").alias("root"), (F.least("root", "above") < F.col("old")).alias("moved")))
        common.drop(labels)
        labels = nxt.select("id", "root")
        labels._cut_path = nxt._cut_path
        if nxt.where("moved").isEmpty():
            common.drop(both)
            return labels


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) of every row.

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; a set holds a text's distinct k-word
    shingles, or all its words as one where it has fewer. Documents are linked if the sets'
    similarity is percent / 100 or more, and a component is what links reach. Texts that are null or
    have no word have an empty set and are linked with nothing. Rows of equal sets are one class,
    of which only the least id is compared. Rows that share an id are one document to the others, and
    each gets its own row. A null id gives component null and kept false. Texts of any length are taken whole, each
    within one task. Further columns are ignored; an empty table gives no row.
    """
    docs = docs.select("doc_id", "text")
    rows = common.cut(sketches(docs, k))
    repeated = not rows.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 AND doc_id IS NOT NULL").isEmpty()
    key = ["set_a", "set_b", "n_shingles"]
    classes = rows.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("rep")).where("rep IS NOT NULL")
    banded = rows.join(classes.withColumnRenamed("rep", "doc_id"), [*key, "doc_id"], "left_semi").select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key"))
    several = banded.groupBy("key").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y").select("key")
    shared = common.cut(banded.join(several, "key", "left_semi"))
    trees = common.cut(shared.select("rep", F.col("rep").alias("tree")).distinct())
    for number in range(ROUNDS):
        placed = shared.join(trees, "rep")
        order = F.xxhash64("rep", F.lit(number)) if number else F.col("rep")
        leaders = placed.groupBy("key").agg(F.min(F.struct(order.alias("order"), "rep", "tree")).alias("l"), F.min("tree").alias("x"), F.max("tree").alias("y")).where("x <> y").select("key", F.col("l.rep").alias("leader"), F.col("l.tree").alias("other"))
        votes = placed.join(leaders, "key").where("tree <> other").groupBy("rep", "leader").agg(F.count("*").alias("n"))
        pairs = common.cut(votes.groupBy("rep").agg(F.max(F.struct("n", (-F.col("leader")).alias("to"))).alias("x")).select(F.col("rep").alias("a"), (-F.col("x.to")).alias("b")))
        if left := not pairs.isEmpty():
            trees = _joined(trees, verified(pairs, docs, k, percent, repeated))
        common.drop(pairs)
        if not left:
            break
    # what is left across trees: keys with few blocks of documents beside their largest tree's, then the others
    placed = common.cut(shared.join(trees, "rep"))
    sizes = key_sizes(placed)
    traits = rows.join(classes.withColumnRenamed("rep", "doc_id"), [*key, "doc_id"], "left_semi").select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), F.lit(1).cast("long").alias("pos"), "bits")
    members = placed.join(sizes.where(f"of_rest <= {DIRECT}").select("key"), "key", "left_semi").join(traits.distinct() if repeated else traits, "rep")
    trees = _met(trees, members, sizes.where(f"of_rest <= {DIRECT}"), docs, k, percent, repeated)
    spread = common.cut(placed.select("key", "rep").join(sizes.where(f"of_rest > {DIRECT}").select("key"), "key", "left_semi").select("rep").distinct().join(trees, "rep"))
    common.drop(placed, sizes)
    if not spread.isEmpty():
        texts = texts_of(docs, spread.withColumnRenamed("rep", "id"), repeated).withColumnRenamed("id", "rep")
        members = rare_shingles(spread.join(texts, "rep"), k, percent)
        sizes = key_sizes(members)
        trees = _met(trees, members, sizes, docs, k, percent, repeated)
        common.drop(members, sizes)
    common.drop(shared, spread)
    # written first: a join of two shuffled sides, of which Spark can split a hot set's
    final = common.cut(classes.join(trees, "rep", "left").select(*key, F.coalesce("tree", "rep").alias("component")))
    common.drop(trees)
    out = rows.select("doc_id", *key).join(final, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def _met(trees: DataFrame, members: DataFrame, sizes: DataFrame, docs: DataFrame, k: int, percent: int, repeated: bool) -> DataFrame:
    """trees after all links between members of a key: forests of blocks with many pairs first, then all pairs of the keys whose forest has a link that failed; the given trees are deleted."""
    pairs = common.cut(candidates(members, sizes, percent, thin=True).distinct())
    if not pairs.isEmpty():
        trees = _joined(trees, verified(pairs.select("a", "b").distinct(), docs, k, percent, repeated))
        failed = pairs.where("key IS NOT NULL").join(trees.toDF("a", "tree_a"), "a").join(trees.toDF("b", "tree_b"), "b").where("tree_a <> tree_b")
        again = common.cut(failed.select("key").distinct())
        if not again.isEmpty():
            left = common.cut(members.drop("tree").join(again, "key", "left_semi").join(trees, "rep"))
            fewer = key_sizes(left)
            rest = common.cut(candidates(left, fewer, percent).distinct())
            if not rest.isEmpty():
                trees = _joined(trees, verified(rest, docs, k, percent, repeated))
            common.drop(left, fewer, rest)
        common.drop(again)
    common.drop(pairs)
    return trees


def _joined(trees: DataFrame, links: DataFrame) -> DataFrame:
    """trees (rep, tree) after links (a, b) between reps; trees itself is deleted."""
    found = common.cut(links)
    if found.isEmpty():
        common.drop(found)
        return trees
    edges = found.join(trees.toDF("a", "tree_a"), "a").join(trees.toDF("b", "tree_b"), "b").select(F.col("tree_a").alias("a"), F.col("tree_b").alias("b"))
    joined = components(edges)
    merged = common.cut(trees.join(joined.toDF("tree", "least"), "tree", "left").select("rep", F.coalesce("least", "tree").alias("tree")))
    common.drop(found, trees, joined)
    return merged


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose document stays: one document of each component, all columns whatever their names.

    A row with a null id stays, and so does a text without words; rows that share an id are one document and stay or go together.
    """
    gone = common.cut(near_duplicates(docs, k, percent).where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct())
    hit = common.unused("_hit", docs)
    split = common.may_hold(docs, gone, "doc_id", hit)
    kept = split.where(hit).drop(hit).join(gone, "doc_id", "left_anti")
    return split.where(f"NOT {hit}").drop(hit).unionByName(kept.select(*docs.columns))


#: near_duplicates() as DuckDB SQL, all pairs compared; for small tables.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {k} THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - {k} + 2), lambda i: array_to_string(ws[i:i + {k} - 1], ' '))) END AS sh
  FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
  GROUP BY 1, 2 HAVING 100 * count(*) >= {percent} * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM reach r JOIN p ON r.b = p.a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, CAST(c.m AS BIGINT) AS component_id, s.doc_id = c.m AS kept
FROM s JOIN (SELECT a, min(b) AS m FROM reach GROUP BY 1) c ON c.a = s.doc_id
"""


def oracle(k: int, percent: int) -> str:
    return ORACLE.replace("{k}", str(k)).replace("{percent}", str(percent))
