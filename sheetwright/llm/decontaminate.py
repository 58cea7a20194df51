"""Benchmark decontamination by edit distance over words.

A document is contaminated by an item if some window of as many consecutive
words as the item has (or the whole text, where that is shorter) can be turned
into the item by at most ``1 - similarity`` edits a word: words put in, left out
or exchanged. Words are lower-cased (A-Z).

Windows of each item size are embedded by the CGK random walk: a pointer moves
along the words by one or stays, as a random bit for the step and the word
says, and the words it stands on form a string. Half of the walks begin at the
window's end, and each takes as many steps as the item has words: positions are
sampled there, where few edits have parted two walks yet. Words edited apart bring two
walks apart only for a while, so that edit distance becomes Hamming distance.
Sampling a few positions of that string gives a bucket. Walks and samples are
repeated until the target recall is reached at the largest distance allowed;
how often is computed from items that are edited at random. Windows that share
a bucket with an item are verified by their exact edit distance.

Each word of a window that no item of that size has costs an edit, which a
running count settles for all windows at once; only windows with few such words
are embedded. Of the pairs that share a bucket, those go whose word counts
differ by too many edits, before edit distances are taken.

Items are read by the driver in blocks of ``block_words`` words. One block at a
time is sent to the executors; where there are several, what it finds is
written before the next. If ``most_samples`` samples of a walk don't reach the
target recall, ``RecallError`` says so.

Edge cases: items without words match nothing; texts of any length are searched
whole; of windows with as few edits the first is given; a null or empty text matches
nothing; several items with one text are all reported; repeated rows are judged
one by one; an empty table of documents or items gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwright.llm.textcore import slices, words
from sheetwright.llm.workspace import Workspace

FOUND = "doc_id long, item_id long, edits int, n_windows int, word_start int"


def edit_distances(one: np.ndarray, lengths: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Edits between the rows of ``one`` (of the given lengths) and ``two``, all pairs at once."""
    n = two.shape[1]
    place = np.arange(n + 1)
    row = np.broadcast_to(place, (len(one), n + 1)).astype(np.int32)
    out = np.where(lengths == 0, n, 0).astype(np.int32)
    for i in range(1, int(lengths.max(initial=0)) + 1):
        change = row[:, :-1] + (one[:, i - 1, None] != two)
        new = np.empty_like(row)
        new[:, 0] = i
        new[:, 1:] = np.minimum(row[:, 1:] + 1, change)
        row = np.minimum.accumulate(new - place, axis=1) + place  # words put in, from the left
        done = lengths == i
        out[done] = row[done, n]
    return out


def common_words(one: np.ndarray, two: np.ndarray, pad: int) -> np.ndarray:
    """How many words two rows have in common, each as often as both have it; 0 and ``pad`` are no words."""
    n = one.shape[1]
    both = np.sort(np.concatenate([one * 2, two * 2 + 1], axis=1), axis=1)
    word, side = both >> 1, both & 1
    place = np.arange(2 * n)
    begin = np.ones(both.shape, dtype=bool)
    begin[:, 1:] = word[:, 1:] != word[:, :-1]
    start = np.maximum.accumulate(np.where(begin, place, 0), axis=1)
    ends = np.ones(both.shape, dtype=bool)
    ends[:, :-1] = begin[:, 1:]
    sums = np.concatenate([np.zeros((len(both), 1), dtype=np.int64), np.cumsum(side, axis=1)], axis=1)
    of_two = sums[:, 1:] - np.take_along_axis(sums, start, axis=1)
    of_one = place - start + 1 - of_two
    return np.where(ends & (word > 0) & (word != pad), np.minimum(of_one, of_two), 0).sum(axis=1)


@dataclass
class SizeGroup:
    """The items of one size. Words are numbered from 1 within the group; 0 is any other, and ``pad`` the end."""

    n: int
    most: int
    local: np.ndarray  # by block-wide word number
    inside: np.ndarray  # whether a word is in the group
    items: np.ndarray
    ids: list[int]
    pad: int
    walks: list[np.ndarray]  # by step and word: whether the pointer moves
    samples: list[list[np.ndarray]]  # by walk
    keys: list[list[tuple[np.ndarray, np.ndarray]]]  # by walk and sample: sorted buckets, and the item of each
    recall: float  # reached on items edited at random, at the largest distance


class RecallError(ValueError):
    """The samples allowed don't reach the target recall."""


def walk(windows: np.ndarray, lengths: np.ndarray, moves: np.ndarray, pad: int, back: bool) -> np.ndarray:
    """The CGK strings of ``windows``, a step for each row of ``moves``; ``back``: from their ends."""
    rows = np.arange(len(windows))
    at = np.zeros(len(windows), dtype=np.int64)
    out = np.empty((len(windows), len(moves)), dtype=np.int64)
    last = windows.shape[1] - 1
    for step in range(len(moves)):
        place = lengths - 1 - at if back else np.minimum(at, last)
        here = np.where(at < lengths, windows[rows, place], pad)
        out[:, step] = here
        at = np.minimum(at + moves[step, here], lengths)
    return out


def bucket(strings: np.ndarray, sample: np.ndarray) -> np.ndarray:
    total = np.zeros(len(strings), dtype=np.uint64)
    for k in sample.tolist():
        total = total * np.uint64(0x9E3779B97F4A7C15) + strings[:, k].astype(np.uint64) + np.uint64(1)
    return total


def _edited(items: np.ndarray, most: int, words_known: int, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The items after ``most`` random edits, cut or padded to one width."""
    n = items.shape[1]
    out, sizes = np.zeros((len(items), n), dtype=np.int64), np.zeros(len(items), dtype=np.int64)
    for k, item in enumerate(items):
        own = item.tolist()
        for _ in range(most):
            kind, at = random.integers(0, 3), int(random.integers(0, max(1, len(own))))
            new = int(random.integers(0, words_known + 1))
            if kind == 0:
                own[at : at + 1] = [new]
            elif kind == 1:
                own[at:at] = [new]
            else:
                del own[at : at + 1]
        own = own[:n]
        out[k, : len(own)], sizes[k] = own, len(own)
    return out, sizes


def plan_groups(items: list[tuple[int, np.ndarray]], vocabulary: np.ndarray, similarity: float, recall: float, sampled: int = 2, walks: int = 4, most_samples: int = 24) -> list[SizeGroup]:
    groups = []
    for n in sorted({len(h) for _, h in items if len(h)}):
        own = [(i, np.searchsorted(vocabulary, h) + 1) for i, h in items if len(h) == n]
        most = math.floor((1 - similarity) * n + 1e-9)
        used = np.unique(np.concatenate([x for _, x in own]))
        local = np.zeros(len(vocabulary) + 1, dtype=np.int64)
        local[used] = np.arange(1, len(used) + 1)
        pad = len(used) + 1
        table = np.stack([local[x] for _, x in own])
        random = np.random.default_rng([3, n])
        steps = max(4, n)
        moves = [random.integers(0, 2, (steps, pad + 1)) for _ in range(walks)]
        picks = [[np.sort(random.choice(steps, min(sampled, steps), replace=False)) for _ in range(most_samples)] for _ in range(walks)]
        full = np.full(len(table), n)
        strings = [walk(table, full, m, pad, v % 2 == 1) for v, m in enumerate(moves)]
        # how many samples: until edited items are found as often as wanted
        trial = np.tile(table, (max(1, 64 // len(table)), 1))
        changed, sizes = _edited(trial, most, len(used), random)
        after = [walk(changed, sizes, m, pad, v % 2 == 1) for v, m in enumerate(moves)]
        found, count = np.zeros(len(trial), dtype=bool), most_samples
        whole = np.full(len(trial), n)
        before = [walk(trial, whole, m, pad, v % 2 == 1) for v, m in enumerate(moves)]
        for s in range(most_samples):
            for v in range(walks):
                found |= bucket(before[v], picks[v][s]) == bucket(after[v], picks[v][s])
            if found.mean() >= recall:
                count = min(most_samples, s + 2)
                break
        if found.mean() < recall:
            raise RecallError(f"items of {n} words: {found.mean():.3f} of edited items found, not {recall}")
        picks = [p[:count] for p in picks]
        keys: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for v in range(walks):
            keys.append([])
            for sample in picks[v]:
                place = bucket(strings[v], sample)
                order = np.argsort(place, kind="stable")
                keys[-1].append((place[order], order))
        groups.append(SizeGroup(n, most, local, (local > 0).astype(np.int32), table, [i for i, _ in own], pad, moves, picks, keys, float(found.mean())))
    return groups


def candidates(group: SizeGroup, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of windows and items that share a bucket, once each."""
    pairs = []
    for v, (moves, picks, keys) in enumerate(zip(group.walks, group.samples, group.keys, strict=True)):
        strings = walk(windows, lengths, moves, group.pad, v % 2 == 1)
        for sample, (buckets, items) in zip(picks, keys, strict=True):
            got = bucket(strings, sample)
            first, last = np.searchsorted(buckets, got), np.searchsorted(buckets, got, side="right")
            some = np.flatnonzero(last > first)
            n = last[some] - first[some]
            at = np.arange(int(n.sum())) + np.repeat(first[some] - (np.cumsum(n) - n), n)
            pairs.append(np.unique(np.repeat(some, n) * len(group.items) + items[at]))
    found = np.unique(np.concatenate(pairs))
    return found // len(group.items), found % len(group.items)


def _numbered(column, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of a text column by their place in the vocabulary (0: not there), and the rows' offsets."""
    numbers, sizes = [np.zeros(0, dtype=np.int64)], [np.zeros(1, dtype=np.int64)]
    for w in words(column, lower=True):
        place = np.minimum(np.searchsorted(vocabulary, w.hashes), len(vocabulary) - 1)
        numbers.append(np.where(vocabulary[place] == w.hashes, place + 1, 0))
        sizes.append(np.diff(w.offsets))
    return np.concatenate(numbers), np.cumsum(np.concatenate(sizes))


def _search(number: np.ndarray, offsets: np.ndarray, groups: list[SizeGroup]):
    """(row, item_id, edits, start) of rows of numbered words."""
    total = len(number)
    row_size = np.diff(offsets)
    row_end = np.repeat(offsets[1:], row_size)
    row_of = np.repeat(np.arange(len(row_size)), row_size)
    known = np.zeros(total + 1, dtype=np.int32)
    for g in groups:
        least = g.n - g.most
        np.cumsum(g.inside[number], out=known[1:])
        start = np.zeros(0, dtype=np.int64)
        if total >= g.n:
            at = np.flatnonzero(known[g.n :] - known[: total - g.n + 1] >= least)
            start = at[at + g.n <= row_end[at]]
        short = np.flatnonzero((row_size < g.n) & (row_size >= max(1, least)))
        short = short[known[offsets[short + 1]] - known[offsets[short]] >= least]
        begin = np.concatenate([start, offsets[short]])
        if not len(begin):
            continue
        length = np.concatenate([np.full(len(start), g.n), row_size[short]])
        column = begin[:, None] + np.arange(g.n)[None, :]
        windows = np.where(np.arange(g.n)[None, :] < length[:, None], g.local[number[np.minimum(column, total - 1)]], g.pad)
        key = bucket(windows, np.arange(g.n))
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        distinct, size = windows[first], length[first]
        which, items = candidates(g, distinct, size)
        enough = common_words(distinct[which], g.items[items], g.pad) >= least
        which, items = which[enough], items[enough]
        if not len(which):
            continue
        edits = edit_distances(distinct[which], size[which], g.items[items])
        hits: dict[int, list[tuple[int, int]]] = {}
        for k, item, e in zip(which.tolist(), items.tolist(), edits.tolist(), strict=True):
            if e <= g.most:
                hits.setdefault(k, []).append((item, e))
        for x in np.flatnonzero(np.isin(inverse, list(hits))).tolist() if hits else ():
            row = int(row_of[begin[x]])
            for item, edits in hits[int(inverse[x])]:
                yield row, g.ids[item], edits, int(begin[x] - offsets[row])


def _word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    out = []
    for w in words(pa.array(texts, pa.string()), lower=True):
        out += [w.hashes[a:b] for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True)]
    return out


def _blocks(items: DataFrame, block_words: int):
    held, size = [], 0
    for r in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null").toLocalIterator():
        (own,) = _word_hashes([r["text"]])
        held.append((r["item_id"], own))
        size += len(own)
        if size >= block_words:
            yield held
            held, size = [], 0
    yield held


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = 0.8, recall: float = 0.95, block_words: int = 200_000) -> DataFrame:
    """A row for each document and item: fewest edits, how many windows, and the first of the best."""
    spark = docs.sparkSession
    space = Workspace(spark, "decontaminate")
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out, before = None, None
    for block in _blocks(items, block_words):
        hashes = [h for _, h in block if len(h)]
        if not hashes:
            continue
        if before is not None:  # another block follows: what the last one finds is written, and its broadcast goes
            done = space.save(out_of_block, "found")
            before.destroy()
            out = done if out is None else out.union(done)
        vocabulary = np.unique(np.concatenate(hashes))
        before = sent = spark.sparkContext.broadcast((vocabulary, plan_groups(block, vocabulary, similarity, recall)))

        def run(batches, sent=sent):
            vocabulary, groups = sent.value
            for batch in slices(batches):
                best: dict[tuple[int, int], list[int]] = {}
                for row, item, edits, start in _search(*_numbered(batch.column("text"), vocabulary), groups):
                    mine = best.setdefault((row, item), [edits, 0, start])
                    mine[1] += 1
                    if (edits, start) < (mine[0], mine[2]):
                        mine[0], mine[2] = edits, start
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[row], item, *x) for (row, item), x in best.items()]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "edits", "n_windows", "word_start"])

        out_of_block = given.mapInArrow(run, FOUND)
    if before is None:
        return spark.createDataFrame([], FOUND)
    return out_of_block if out is None else out.union(out_of_block)
