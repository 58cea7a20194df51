"""Removal of passages that an earlier document has too.

A word goes if it is covered by ``window`` consecutive words whose sequence
also starts in a document with a smaller doc_id. All documents are judged
against all others as given, not against what is left of them.

Suffix automata of the reference, sent to every task, serve ``match_reference``
below, where the reference is a table of proven size. For a corpus against
itself the reference is the corpus: automata of all its shards would have to
visit all documents, which costs documents times shards and has no size bound.
The corpus form therefore looks windows up by hash, in three steps:

1. Anchors: of each window, the least hash of its ``anchor``-word grams. Equal
   windows have equal anchors, and about a fifth of all positions are anchors,
   so anchors found in a single document rule out all windows around them.
2. Windows at shared anchors meet by hash. A task forwards one entry for each
   hash, the smallest doc_id it saw, and settles the others itself: a window in
   a third of all rows sends one entry from each task.
3. Documents with the windows found covered; words there go.

Entries travel packed, all of one place in a row. The texts are dealt to slots
by doc_id once; both steps that look at them again reuse that exchange, and
meet what was found for the same slot. The number of slots and of buckets
follows from the bytes of the texts (``SLOT_BYTES``), so that what a task holds
stays level while the input grows.

Edge cases: a null text has no words; texts of fewer than ``window`` words are
kept; texts of any length are judged whole; rows that share a doc_id don't
cover each other and are returned one by one; a row with a null doc_id is kept
whole, covers nothing and goes to a slot by its text; ties can't arise, as the
smallest doc_id decides; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwright.llm.textcore import grams, words
from sheetwright.llm.workspace import Workspace, shuffle_partitions

#: Entries that a task holds before it forwards them.
HELD = 1 << 21

#: Bytes of text that a slot holds, about.
SLOT_BYTES = 1 << 23

ENTRIES = "dest int, docs binary, keys binary"
KNOWN = "slot int, docs binary, keys binary"
KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


#: How a doc_id is dealt to a slot, here and in Spark.
PRIME, FACTOR = 2_147_483_647, 48_271


def _slots_of(docs: np.ndarray, slots: int) -> np.ndarray:
    return (docs % PRIME * FACTOR % PRIME % slots).astype(np.int32)


def _slot_column(slots: int):
    return F.coalesce(F.pmod(F.pmod(F.col("doc_id"), F.lit(PRIME)) * FACTOR, F.lit(PRIME)) % slots, F.pmod(F.xxhash64("text"), F.lit(slots))).cast("int")


def _parts(texts: DataFrame) -> int:
    """Partitions of texts and entries: two slots in each."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(shuffle_partitions(texts.sparkSession), -(-size // (2 * SLOT_BYTES)))


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """The least of every n consecutive values, by doubling."""
    out, have = values, 1
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def _windows(w, window: int, anchor: int):
    """(row, window hashes, window anchors) of each row long enough."""
    short = grams(w.hashes, anchor)
    low = sliding_min(short, window - anchor + 1)
    every = grams(w.hashes, window)
    for k in range(w.last - w.first):
        first, last = int(w.offsets[k]), int(w.offsets[k + 1])
        if last - first >= window:
            yield w.first + k, every[first : last - window + 1], low[first : last - window + 1]


class _Entries:
    """(key, doc) entries of a task; ``settle`` deals them out.

    later_only: the smallest doc of a key is of no interest to it.
    """

    def __init__(self, dests: int, slots: int, later_only: bool):
        self.dests, self.slots, self.later_only = dests, slots, later_only
        self.keys: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.n = 0

    def add(self, keys: np.ndarray, doc: int) -> None:
        self.keys.append(keys)
        self.docs.append(np.full(len(keys), doc, dtype=np.int64))
        self.n += len(keys)

    def settle(self):
        """Rows with the smallest doc of each key for its bucket (dest), and what is known already (dest below 0: the slot)."""
        if not self.n:
            return
        keys, docs = np.concatenate(self.keys), np.concatenate(self.docs)
        self.keys, self.docs, self.n = [], [], 0
        keys, docs, first, known = _shared(keys, docs, self.later_only)
        slot = _slots_of(docs[known], self.slots)
        yield _packed(-1 - slot, docs[known], keys[known] if self.later_only else keys[known].astype(np.uint32), "dest")
        keys, docs = keys[first], docs[first]
        dest = ((keys >> np.uint64(33)).astype(np.int64) % self.dests).astype(np.int32)
        yield _packed(dest, docs, keys if self.later_only else keys.astype(np.uint32), "dest")


def _shared(keys: np.ndarray, docs: np.ndarray, later_only: bool):
    """The entries in order, which are the first of their key, and which share it with a smaller doc (or any other)."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    first = np.ones(len(keys), dtype=bool)
    first[1:] = keys[1:] != keys[:-1]
    run = np.cumsum(first) - 1
    known = docs > docs[np.flatnonzero(first)][run]
    if not later_only:
        known = np.bincount(run, weights=known)[run] > 0
    return keys, docs, first, known


def _packed(to: np.ndarray, docs: np.ndarray, keys: np.ndarray, name: str) -> pa.RecordBatch:
    """One row for each place with all its docs and keys."""
    order = np.argsort(to, kind="stable")
    to, docs, keys = to[order], docs[order], keys[order]
    at = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, dtype=np.int64)
    ends = np.append(at[1:], len(to)).tolist() if len(at) else []
    pairs = list(zip(at.tolist(), ends, strict=True))
    columns = [pa.array(to[at], pa.int32()), pa.array([docs[a:b].tobytes() for a, b in pairs], pa.binary()), pa.array([keys[a:b].tobytes() for a, b in pairs], pa.binary())]
    return pa.record_batch(columns, names=[name, "docs", "keys"])


def _unpacked(docs, keys, kind) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(docs.to_pylist()), dtype=np.int64), np.frombuffer(b"".join(keys.to_pylist()), dtype=kind)


def _meet(slots: int, later_only: bool):
    """Of forwarded entries: keys with several docs, for each of these docs (or for all but the smallest)."""
    kind = np.uint64 if later_only else np.uint32

    def run(batches):
        sent: dict[int, list] = {}
        for batch in batches:
            for to, docs, keys in zip(batch.column("dest").to_pylist(), batch.column("docs").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                sent.setdefault(max(to, -1), []).append((docs, keys))
        found = []
        for to, parts in sent.items():  # keys of 32 bits mean the same in one bucket only
            docs, keys = np.frombuffer(b"".join(d for d, _ in parts), dtype=np.int64), np.frombuffer(b"".join(k for _, k in parts), dtype=kind)
            if to >= 0:
                keys, docs, _, known = _shared(keys, docs, later_only)
                docs, keys = docs[known], keys[known]
            found.append((docs, keys))
        if found:
            docs, keys = (np.concatenate(x) for x in zip(*found, strict=True))
            yield _packed(_slots_of(docs, slots), docs, keys, "slot")

    return run


def _by_doc(table: pa.Table, kind) -> dict[int, np.ndarray]:
    """The keys of each doc of a slot."""
    docs, keys = _unpacked(table.column("docs"), table.column("keys"), kind)
    order = np.argsort(docs, kind="stable")
    docs, keys = docs[order], keys[order]
    at = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else np.zeros(0, dtype=np.int64)
    return dict(zip(docs[at].tolist(), np.split(keys, at[1:]), strict=True)) if len(at) else {}


def remove_repeats(docs: DataFrame, window: int = 13, anchor: int = 5) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the words kept, joined by one space."""
    return _kept(docs, window, anchor, digest=True)


def without_repeats(docs: DataFrame, window: int = 13, anchor: int = 5) -> DataFrame:
    """doc_id and the text kept."""
    return _kept(docs, window, anchor, digest=False)


def _kept(docs: DataFrame, window: int, anchor: int, digest: bool) -> DataFrame:
    spark = docs.sparkSession
    Workspace(spark, "substring-dedup")
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = _parts(given)
    dests = slots = 2 * parts

    def anchors(batches):
        held = _Entries(dests, slots, later_only=False)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for w in words(batch.column("text")):
                for row, _, low in _windows(w, window, anchor):
                    if ids[row] is not None:
                        held.add(np.unique(low), ids[row])
                if held.n > HELD:
                    yield from held.settle()
        yield from held.settle()

    def shared_windows(texts: pa.Table, found: pa.Table) -> pa.Table:
        wanted, held = _by_doc(found, np.uint32), _Entries(dests, slots, later_only=True)
        ids = texts.column("doc_id").to_pylist()
        texts = texts.filter(pa.array([doc in wanted for doc in ids], pa.bool_()))
        ids = texts.column("doc_id").to_pylist()
        for w in words(texts.column("text")) if ids else ():
            for row, every, low in _windows(w, window, anchor):
                held.add(np.unique(every[np.isin(low.astype(np.uint32), wanted[ids[row]])]), ids[row])
        return pa.Table.from_batches(list(held.settle()), schema=pa.schema([("dest", pa.int32()), ("docs", pa.binary()), ("keys", pa.binary())]))

    def cover(texts: pa.Table, found: pa.Table) -> pa.Table:
        wanted = _by_doc(found, np.uint64)
        ids = texts.column("doc_id").to_pylist()
        gone: dict[int, np.ndarray] = {}
        for w in words(texts.column("text")) if ids else ():
            for row, every, _ in _windows(w, window, anchor):
                if ids[row] in wanted:
                    at = np.flatnonzero(np.isin(every, wanted[ids[row]]))
                    change = np.zeros(len(every) + window, dtype=np.int32)
                    change[at] += 1
                    change[at + window] -= 1
                    gone[row] = np.cumsum(change)[:-1] > 0
        out = []
        for row, text in enumerate(texts.column("text").to_pylist()):
            own = (text or "").encode().split()  # bytes.split() knows just the six separators
            n = len(own)
            if row in gone:
                own = [own[k] for k in np.flatnonzero(~gone[row]).tolist()]
            kept = b" ".join(own)
            out.append((n, n - len(own), hashlib.sha256(kept).hexdigest() if digest else kept.decode()))
        columns = list(zip(*out, strict=True)) or [[]] * 3
        made = [pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True))]
        return pa.table(made, names=["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "text"])

    dealt = given.withColumn("slot", _slot_column(slots)).repartition(parts, "slot")
    by_slot = lambda df: df.repartition(parts, "slot").groupBy("slot")

    shared = given.mapInArrow(anchors, ENTRIES).repartition(parts, "dest").mapInArrow(_meet(slots, later_only=False), KNOWN)
    looked = dealt.groupBy("slot").cogroup(by_slot(shared)).applyInArrow(shared_windows, ENTRIES)
    covered = looked.repartition(parts, "dest").mapInArrow(_meet(slots, later_only=True), KNOWN)
    return dealt.groupBy("slot").cogroup(by_slot(covered)).applyInArrow(cover, KEPT if digest else "doc_id long, n_words long, n_removed long, text string")


class Automaton:
    """Suffix automaton of word sequences, with a mark between them."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def add(self, word) -> None:
        state = len(self.next)
        self.next.append({})
        self.length.append(self.length[self.last] + 1)
        self.link.append(0)
        at = self.last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at >= 0:
            to = self.next[at][word]
            if self.length[to] == self.length[at] + 1:
                self.link[state] = to
            else:
                copy = len(self.next)
                self.next.append(dict(self.next[to]))
                self.length.append(self.length[at] + 1)
                self.link.append(self.link[to])
                while at >= 0 and self.next[at].get(word) == to:
                    self.next[at][word] = copy
                    at = self.link[at]
                self.link[to] = self.link[state] = copy
        self.last = state

    def matching(self, sequence: list) -> list[int]:
        """For each word the length of the longest match that ends there."""
        out, at, have = [], 0, 0
        for word in sequence:
            while at and word not in self.next[at]:
                at = self.link[at]
                have = self.length[at]
            if word in self.next[at]:
                at, have = self.next[at][word], have + 1
            else:
                have = 0
            out.append(have)
        return out


def match_reference(docs: DataFrame, reference: DataFrame, window: int = 13, shard_words: int = 200_000, most_words: int = 2_000_000) -> DataFrame:
    """doc_id and the maximal word spans [start, end) of ``docs`` that ``reference`` (text) has too.

    The reference is counted first; above ``most_words`` this refuses, and ``remove_repeats``
    on the union is the way. Within it, the driver reads text by text and holds one shard's
    automaton, of a few hundred bytes a word, before it is sent out.
    """
    spark = docs.sparkSession
    Workspace(spark, "match-reference")
    size = reference.select(F.sum(F.size(F.split("text", "[ \\t-\\r]+"))).alias("n")).first()["n"] or 0
    if size > most_words:
        raise ValueError(f"the reference has {size} words, more than {most_words}")
    sent, shard, room = [], Automaton(), shard_words
    for k, row in enumerate(reference.where("text is not null").select("text").toLocalIterator()):
        text = row["text"].encode().split()
        if room < len(text) and room < shard_words:
            sent.append(spark.sparkContext.broadcast(shard))
            shard, room = Automaton(), shard_words
        room -= len(text)
        for word in text:
            shard.add(word)
        shard.add(k)  # numbers are in no text
    sent.append(spark.sparkContext.broadcast(shard))

    def spans(batches):
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = (text or "").encode().split()
                best = np.zeros(len(own), dtype=np.int64)
                for one in sent:
                    best = np.maximum(best, one.value.matching(own))
                end = np.flatnonzero(best >= window)
                reach: list[list[int]] = []
                for k in end.tolist():
                    start = k + 1 - int(best[k])
                    if reach and start <= reach[-1][1]:
                        reach[-1] = [min(reach[-1][0], start), k + 1]
                    else:
                        reach.append([start, k + 1])
                out += [(doc, a, b) for a, b in reach]
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "end"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(spans, "doc_id long, start long, end long")
