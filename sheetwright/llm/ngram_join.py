"""N-gram Jaccard join: a blocked sparse product of documents by n-grams.

1. Every text becomes its set of n-word shingles (64-bit hashes). Texts with
   the same set share a 64-bit key, so copies are one node from here on.
2. N-grams are ordered by hash, and a document is entered in the columns of its
   first ones only: as many as leave out less than the overlap that its size
   demands, and ``extra`` of its size more. Two documents of enough similarity
   have their first common n-grams there, as many as the smaller surplus. A
   column with one document goes. No document statistics are needed for that.
3. Within a column the document with most shared columns is multiplied with the
   others; counts over the columns and the two sizes bound the overlap, and the
   pairs that remain are decided by their exact overlap. This links most of a
   group of near copies without its pairs.
4. Columns within one component of the links so far are complete. A document
   whose columns beyond its component are fewer than the surplus has no further
   link and goes, which is repeated as others go. The rest are multiplied with
   each other over their rarest n-grams, as far as the sizes of a pair demand,
   across components only, and what remains is decided as in 3.

Every step drops only what a bound rules out, so no link between components is
lost. Nothing is collected to the driver. A group of m near copies costs O(m)
pairs as far as it hangs together. Columns are read in sorted order, not held,
and joins split keys with a large share of the rows.

Edge cases: null, empty or blank texts have no shingle, count 0 and are alone;
with fewer words than ``n`` the whole sequence is the one shingle; texts of any
length have all their shingles; repeated rows are returned as often, and rows
with null or repeated ids are judged by their own text; an empty table gives no
rows; other columns, also ones named like those here, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwright.llm.components import connected_components
from sheetwright.llm.skew import attach
from sheetwright.llm.textcore import grams, mix64, slices, words
from sheetwright.llm.workspace import Workspace

#: Of a document's shingles, one in so many is the surplus of its columns.
EXTRA = 16

#: Bits of a set's parities.
BITS = 512

SIGNED = "doc_id long, text_id long, n_shingles long, set_key long, cols array<long>"
ENTRY = "col long, set_key long, size long"


def shingle_sets(column, n: int):
    """(row, sorted distinct shingle hashes) for each row of a text column."""
    for w in words(column, lower=True):
        every = grams(w.hashes, n)
        for k in range(w.last - w.first):
            first, last = w.offsets[k], w.offsets[k + 1]
            if last - first >= n:
                yield w.first + k, np.unique(every[first : last - n + 1])
            elif last > first:
                yield w.first + k, grams(w.hashes[first:last], int(last - first))
            else:
                yield w.first + k, np.zeros(0, dtype=np.uint64)


def set_key(shingles: np.ndarray) -> int:
    """64 bits that depend on the set only."""
    total = np.sum(mix64(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)
    return int(mix64(np.array([total ^ np.uint64(len(shingles))], dtype=np.uint64)).view(np.int64)[0])


def surplus(size):
    """How many columns two documents share at least, by the size of the smaller one; numbers, arrays and Columns alike."""
    return (size + EXTRA - 1) // EXTRA


def prefix_length(size: int, percent: int) -> int:
    return min(size, size - -(-percent * size // 100) + surplus(size))


def sign(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The sets' keys and columns; a key's columns are given once in a task."""

    def run(batches):
        seen: set[int] = set()
        for batch in slices(batches):
            size, key, rows = np.zeros(batch.num_rows, dtype=np.int64), [None] * batch.num_rows, [None] * batch.num_rows
            for row, shingles in shingle_sets(batch.column("text"), n):
                size[row] = len(shingles)
                if len(shingles):
                    key[row] = set_key(shingles)
                    if key[row] not in seen:
                        if len(seen) > 1 << 20:
                            seen.clear()
                        seen.add(key[row])
                        rows[row] = shingles[: prefix_length(len(shingles), percent)].view(np.int64).copy()  # the rest of the set goes
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_id"), pa.array(size), pa.array(key, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "text_id", "n_shingles", "set_key", "cols"])

    return docs.mapInArrow(run, SIGNED)


def _runs(batches, names: tuple[str, ...]):
    """Arrays of the given columns of sorted batches, and where a value of the first one begins, which may be a batch before."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        arrays = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        first = np.ones(batch.num_rows, dtype=bool)
        first[1:] = arrays[0][1:] != arrays[0][:-1]
        first[0] = last is None or arrays[0][0] != last
        last = arrays[0][-1]
        yield arrays, first


def shared_columns(entries: DataFrame) -> DataFrame:
    """The entries of columns with two documents and more, once each. A column is read through, its first entry waits for the second."""

    def run(batches):
        held = None
        for (col, key, size), first in _runs(batches, ("col", "set_key", "size")):
            new = first.copy()
            new[1:] |= key[1:] != key[:-1]
            if not first[0]:
                new[0] = key[0] != tail
            tail = key[-1]
            col, key, size, first = (x[new] for x in (col, key, size, first))
            if not len(col):
                continue
            follows = ~first
            out = follows.copy()
            out[:-1] |= follows[1:]  # the first entry of a column that goes on
            if held is not None and follows[0] and held[3]:
                yield _entry_batch(*(np.array([x]) for x in held[:3]))
            yield _entry_batch(col[out], key[out], size[out])
            held = (col[-1], key[-1], size[-1], bool(first[-1]))

    return entries.repartition("col").sortWithinPartitions("col", "set_key").mapInArrow(run, ENTRY)


def _entry_batch(col, key, size) -> pa.RecordBatch:
    return pa.record_batch([pa.array(col), pa.array(key), pa.array(size)], names=["col", "set_key", "size"])


def stars(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b): a column's document with most shared columns, and another that the sizes allow, if they meet in half the columns that they must share."""
    listed = members.groupBy("set_key").agg(F.first("size").alias("size"), F.collect_list("col").alias("cols"))
    ranked = listed.select(F.explode("cols").alias("col"), F.size("cols").alias("known"), "set_key", "size")

    def run(batches):
        centre = None
        for (_, key, size), first in _runs(batches, ("col", "set_key", "size")):
            at = np.flatnonzero(first)
            which = np.cumsum(first) - 1
            c, s = np.append(key[at], 0)[which], np.append(size[at], 0)[which]
            if not first[0]:
                c[which < 0], s[which < 0] = centre
            centre = (c[-1], s[-1])
            ok = (key != c) & (100 * np.minimum(size, s) >= percent * np.maximum(size, s))
            yield pa.record_batch([pa.array(c[ok]), pa.array(key[ok]), pa.array(np.minimum(size, s)[ok])], names=["a", "b", "size"])

    dealt = ranked.repartition("col").sortWithinPartitions("col", F.desc("known"), "set_key")
    met = dealt.mapInArrow(run, "a long, b long, size long").groupBy("a", "b").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    return met.where(f"2 * n >= (size + {EXTRA - 1}) div {EXTRA}").select("a", "b")


def open_members(members: DataFrame, percent: int, space: Workspace, rounds: int = 2) -> DataFrame:
    """Of ``members`` (with root): those of documents with enough columns beyond their component for another link."""
    least = f"(ceil({percent} * size / 100) + {EXTRA - 1}) div {EXTRA}"  # of the smallest partner
    for _ in range(rounds):
        mixed = members.groupBy("col").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("col")
        mixed = space.save(mixed, "mixed")
        across = attach(members, mixed, "col", "set_key")
        some = across.groupBy("set_key").agg(F.count("*").alias("n"), F.first("size").alias("size")).where(f"n >= {least}").select("set_key")
        kept = space.save(across.join(some, "set_key").select("col", "set_key", "size", "root"), "open")
        space.drop(members, mixed)
        members = kept
    return members


def own_texts(candidates: DataFrame, n: int) -> DataFrame:
    """The rows of ``candidates`` (set_key, text) whose text has that key: ids may be null or stand for several texts."""

    def run(batches):
        for batch in slices(batches):
            keys = batch.column("set_key").to_pylist()
            mask = pa.array([len(x) > 0 and set_key(x) == keys[row] for row, x in shingle_sets(batch.column("text"), n)], pa.bool_())
            yield batch.filter(mask)

    return candidates.mapInArrow(run, "set_key long, text string")


def overlaps(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """``pairs`` (a, b) of set keys that reach the similarity, from ``texts`` (set_key, text).

    Both texts meet by two joins; each row's product of incidence rows is a merge of sorted ids.
    """

    def run(batches):
        for batch in slices(batches, 200):
            one, two = dict(shingle_sets(batch.column("text_a"), n)), dict(shingle_sets(batch.column("text_b"), n))
            keep = []
            for k in range(batch.num_rows):
                x, y = one[k], two[k]
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    one = texts.select(F.col("set_key").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("set_key").alias("b"), F.col("text").alias("text_b"))
    return attach(attach(pairs, one, "a", "b"), two, "b", "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def difference_bits(shingles: np.ndarray) -> np.ndarray:
    """The parity of a set's shingles in each of ``BITS`` classes; two sets differ in as many shingles at least as here in bits."""
    odd = np.bincount((shingles >> np.uint64(20)).astype(np.int64) % BITS, minlength=BITS).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def product_candidates(open_: DataFrame, texts: DataFrame, n: int, percent: int, space: Workspace) -> DataFrame:
    """Pairs (a, b) of two components that the sparse product over ``open_`` (set_key, size, root) can't rule out.

    N-grams are ordered by how many open documents hold them, rarest first. Two
    sets that overlap in ``need`` n-grams have their first common one at a rank
    that leaves at least ``need`` in each; ``need`` follows from the two sizes.
    So only the columns within that rank are multiplied: for documents with
    their own edits these are their edits, which nobody shares. Bits of the
    sets' parities bound the overlap from above before a text is looked at. In
    each column the members of its largest component are on one side only.
    """
    words_of = BITS // 64

    def listed(batches):
        for batch in slices(batches):
            rows, bits = [None] * batch.num_rows, [None] * batch.num_rows
            for row, shingles in shingle_sets(batch.column("text"), n):
                rows[row], bits[row] = shingles.view(np.int64), difference_bits(shingles)
            yield pa.record_batch([batch.column("set_key"), batch.column("size"), batch.column("root"), pa.array(rows, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], names=["set_key", "size", "root", "shingles", "bits"])

    schema = "set_key long, size long, root long, shingles array<long>, bits array<long>"
    sets = space.save(open_.join(texts, "set_key").select("set_key", "size", "root", "text").mapInArrow(listed, schema), "sets")
    cells = sets.select("set_key", "size", "root", F.explode("shingles").alias("shingle"))
    common = space.save(cells.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "common")
    rows = attach(cells, common, "shingle", "set_key").groupBy("set_key", "size", "root").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("cols"))
    # n-grams of one document stand before all others, so the ranks here begin behind them
    ranked = rows.select("set_key", "size", "root", F.posexplode("cols").alias("pos", "col"), (F.col("size") - F.size("cols")).alias("alone"))
    ranked = ranked.select("set_key", "size", "root", F.col("col")["shingle"].alias("shingle"), (F.col("alone") + F.col("pos")).alias("rank")).where(f"100 * (size - rank) >= {percent} * size")
    ranked = ranked.join(sets.select("set_key", *[F.col("bits")[k].alias(f"bits{k}") for k in range(words_of)]), "set_key")
    ranked = space.save(ranked, "ranked")
    largest = ranked.groupBy("shingle", "root").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("shingle", "largest")
    largest = space.save(largest, "largest")
    entries = attach(ranked, largest, "shingle", "set_key").withColumn("first", F.col("root") != F.col("largest"))
    entries = space.save(entries.select(*ranked.columns, "first"), "entries")
    names = ["set_key", "size", "root", "rank", *(f"bits{k}" for k in range(words_of))]
    left = entries.where("first").select("shingle", *[F.col(c).alias(f"{c}_a") for c in names])
    right = entries.select("shingle", *[F.col(c).alias(f"{c}_b") for c in names])
    need = f"ceil({percent} * (size_a + size_b) / {100 + percent})"
    differ = " + ".join(f"bit_count(bits{k}_a ^ bits{k}_b)" for k in range(words_of))
    bound = f"root_a <> root_b and 100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b) and size_a - rank_a >= {need} and size_b - rank_b >= {need} and size_a + size_b - ({differ}) >= 2 * {need}"
    pairs = left.join(right, "shingle").where(bound).select(F.least("set_key_a", "set_key_b").alias("a"), F.greatest("set_key_a", "set_key_b").alias("b")).distinct()
    pairs = space.save(pairs, "pairs")
    space.drop(sets, common, ranked, largest, entries)
    return pairs


def classes(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and n_copies (rows with the same set) of every row of ``docs``."""
    spark = docs.sparkSession
    space = Workspace(spark, "ngram-join")

    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    given = given.withColumn("text_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.col("doc_id")))
    signed = space.save(sign(given, n, percent), "signed")
    keys = space.save(signed.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.min("text_id").alias("text_id"), F.max("n_shingles").alias("size"), F.count("*").alias("n_copies")), "keys")

    entries = signed.where("cols is not null").select(F.explode("cols").alias("col"), "set_key", F.col("n_shingles").alias("size"))
    members = space.save(shared_columns(entries), "members")
    rows = space.save(signed.select("doc_id", "n_shingles", "set_key"), "rows")
    space.drop(signed)
    enough = members.groupBy("set_key").agg(F.count("*").alias("n"), F.first("size").alias("size")).where(f"n >= (ceil({percent} * size / 100) + {EXTRA - 1}) div {EXTRA}").select("set_key")
    involved = space.save(enough, "involved")
    members = space.save(members.join(involved, "set_key").select("col", "set_key", "size"), "members")
    found = space.save(stars(members, percent), "stars")
    looked = involved.join(keys, "set_key").select("set_key", "text_id")
    texts = space.save(own_texts(attach(given.where("text is not null").select("text_id", "text"), looked, "text_id", "text").select("set_key", "text"), n).dropDuplicates(["set_key"]), "texts")
    links = space.save(overlaps(found, texts, n, percent), "links")
    roots = space.save(connected_components(links, space), "roots")

    rooted = members.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").select("col", "set_key", "size", F.coalesce("root", "set_key").alias("root"))
    open_ = open_members(space.save(rooted, "rooted"), percent, space).select("set_key", "size", "root").distinct()
    open_ = space.save(open_, "open")
    across = product_candidates(open_, texts, n, percent, space).join(found, ["a", "b"], "left_anti")
    across = space.save(across.join(found.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti"), "across")
    more = space.save(overlaps(across, texts, n, percent), "links")
    if not more.isEmpty():
        rooted_links = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = space.save(connected_components(rooted_links.union(more), space), "roots")

    named = keys.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    named = space.save(named.select("set_key", "doc_id", "n_copies", "root"), "named")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    member = space.save(attach(named.drop("doc_id"), least, "root", "set_key").select("set_key", "component_id", "n_copies"), "member")
    alone = rows.where("set_key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_copies"))
    result = attach(rows, member, "set_key", "doc_id").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "n_copies")
    result = space.save(result.union(alone), "classes")
    space.drop(rows, keys, members, involved, found, texts, links, roots, open_, across, more, named, member)
    return result
