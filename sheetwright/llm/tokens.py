"""Tokenisation with the tokenizers library, unit by unit with a bounded memo.

Byte-level and word-level BPE never merge across the border between a word and
the white space after it, nor across that between an ASCII letter or digit and
an ASCII mark other than an apostrophe, so the ids of a text are those of its
units in a row: words cut before such marks, with the white space before them
where that yields ids. Most units repeat, so each worker keeps their ids, by a
64-bit hash, in a memo of bounded size; once full, it drops the units that were
not met again. The memo holds the units' bytes too, and every unit is compared
with them; where two units share a hash, the rows are encoded whole. Rows that
hold an added token's string, white space beyond ASCII or a unit longer than
LONGEST, and all rows for a tokenizer of another build, are encoded whole.

New units go to the library many at a time, in one text. Where the ids tell the
units' borders (ids with a space in front, ids that end a word), nothing stands
between them, and units of ASCII letters alone, which are one pre-token each,
need no pattern to be found; special tokens part the others.

Edge cases: a null or empty text has the end id alone; a text of any length is
encoded whole, one longer than a chunk on its own; repeated rows give the same
ids; an empty column gives nothing.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

from sheetwright.llm.textcore import CHUNK, Words, bare_units, eights, folded, span_lanes, spaced_units, words

#: White space beyond ASCII that the pre-tokenizers know, in UTF-8.
_WIDE_SPACE = b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"

#: Units, and bytes of units, kept by a worker.
MEMO_UNITS, MEMO_BYTES = 600_000, 1 << 24

#: Bytes of the longest unit that is kept.
LONGEST = 2048

#: Units that the library gets in one text.
JOINED = 256

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True


def _keeps_space(spec: dict) -> bool | None:
    """Whether white space yields ids; None if texts can't be cut at it."""
    before, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    parts = before.get("pretokenizers", [before])
    kinds = [x.get("type") for x in parts]
    if kinds == ["ByteLevel"] and normal is None and parts[0].get("use_regex", True) and not parts[0].get("add_prefix_space"):
        return True
    if kinds == ["Split", "ByteLevel"] and r"[^\s\p{L}\p{N}]+" in parts[0]["pattern"].get("Regex", "") and parts[0].get("invert") and parts[0].get("behavior") == "Removed" and not parts[1].get("add_prefix_space"):
        return False
    return None


class _Memo:
    """Units, by hash, with their bytes and ids: a table with open addressing, in arrays."""

    def __init__(self, end_id: int):
        self.mask = np.uint64((1 << (2 * max(MEMO_UNITS, CHUNK) - 1).bit_length()) - 1)
        self.end = end_id
        self.clear()

    def clear(self) -> None:
        self.n, self.filled, self.text_filled = 0, 1, 0
        self.slots = np.full(int(self.mask) + 1, -1, dtype=np.int32)
        self.flat = np.full(1 << 16, self.end, dtype=np.uint32)  # its first entry stands for the end id
        self.text8 = eights(np.zeros(1 << 16, dtype=np.uint8))
        self.keys, self.met = np.zeros(1 << 14, dtype=np.uint64), np.zeros(1 << 14, dtype=bool)
        self.first, self.size, self.text_first, self.text_size = (np.zeros(1 << 14, dtype=np.int32) for _ in range(4))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of units; -1 for those that are not there."""
        slot = (keys & self.mask).astype(np.int64)
        at = self.slots[slot]
        other = np.flatnonzero((self.keys[at] != keys) & (at >= 0))
        while len(other):
            slot[other] = (slot[other] + 1) & int(self.mask)
            there = self.slots[slot[other]]
            at[other] = there
            other = other[(self.keys[there] != keys[other]) & (there >= 0)]
        return at

    def add(self, keys: np.ndarray, text: np.ndarray, text_size: np.ndarray, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Takes in distinct new units, whose bytes and ids come in a row; their places."""
        base, n = self.n, self.n + len(keys)
        self.keys, self.met, self.first, self.size, self.text_first, self.text_size = (_room(x, n) for x in (self.keys, self.met, self.first, self.size, self.text_first, self.text_size))
        self.flat = _room(self.flat, self.filled + len(ids))
        if self.text_filled + len(text) > len(self.text8) - 1:
            self.text8 = eights(_room(self._bytes(), self.text_filled + len(text)))
        span = slice(base, n)
        self.keys[span], self.met[span], self.size[span], self.text_size[span] = keys, False, size, text_size
        self.first[span], self.text_first[span] = self.filled + np.cumsum(size) - size, self.text_filled + np.cumsum(text_size) - text_size
        self.flat[self.filled : self.filled + len(ids)] = ids
        self._bytes()[self.text_filled : self.text_filled + len(text)] = text
        self.n, self.filled, self.text_filled = n, self.filled + len(ids), self.text_filled + len(text)
        places = np.arange(base, n, dtype=np.int32)
        slot, left = (keys & self.mask).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = left[self.slots[slot[left]] < 0]
            self.slots[slot[free]] = places[free]
            left = left[self.slots[slot[left]] != places[left]]
            slot[left] = (slot[left] + 1) & int(self.mask)
        return places

    def _bytes(self) -> np.ndarray:
        return self.text8.base

    def make_room(self, units: int) -> None:
        """Where ``units`` more may not fit, drops all that were not met again; all, if that leaves much."""
        if self.n + units <= MEMO_UNITS and self.text_filled <= MEMO_BYTES:
            return
        kept = np.flatnonzero(self.met[: self.n])
        keys, sizes, text_sizes = self.keys[kept], self.size[kept].astype(np.int64), self.text_size[kept].astype(np.int64)
        if len(kept) + units > MEMO_UNITS // 2 or text_sizes.sum() > MEMO_BYTES // 2:
            self.clear()
            return
        text, ids = _gathered(self._bytes(), self.text_first[kept], text_sizes), _gathered(self.flat, self.first[kept], sizes)
        self.clear()
        self.add(keys, text, text_sizes, ids, sizes)

    def holds(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> bool:
        """Whether the units at ``at`` are these spans of ``raw``, byte by byte."""
        if not np.array_equal(sizes, self.text_size[at]):
            return False
        first = self.text_first[at].astype(np.int64)
        mine = span_lanes(self.text8, first, sizes)
        return all(np.array_equal(lane, own) for (_, _, lane), (_, _, own) in zip(span_lanes(eights(raw), starts, sizes), mine, strict=True))


class Encoder:
    """ids of texts, end id included."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        self.spaced = _keeps_space(spec)
        normal = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.folds = self.spaced is False and normal == ["NFC", "Replace", "Lowercase"]
        added = [x["content"] for x in spec.get("added_tokens", []) if x.get("special")]
        self.border = added[0] if added else None
        every = [re.escape(x["content"].encode()) for x in spec.get("added_tokens", [])]
        self.odd = re.compile(b"|".join([_WIDE_SPACE, *every]), re.IGNORECASE)
        self.end = end_id
        self.memo = _Memo(end_id)
        vocab, alphabet = spec["model"].get("vocab", {}), pre_tokenizers.ByteLevel.alphabet()
        suffix = spec["model"].get("end_of_word_suffix") or ""
        #: ids that begin a unit (where units keep their space) or end a pre-token; None if ids don't tell
        self.telling = None
        if self.spaced is not None and isinstance(vocab, dict) and (self.spaced or suffix) and all(c in vocab and c + suffix in vocab for c in alphabet):
            self.telling = np.zeros(max([self.tokenizer.get_vocab_size(), *vocab.values()]) + 1, dtype=bool)
            self.telling[[i for t, i in vocab.items() if (t.startswith("\u0120") if self.spaced else t.endswith(suffix))]] = True
        #: the same model for pre-tokens parted by spaces
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()

    def whole(self, texts: list[str], tokenizer=None) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _parted(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of units in a row, and how many each has: special tokens go between them."""
        mark = self.tokenizer.token_to_id(self.border)
        (ids,) = self.whole([self.border.join(units)])
        marks = np.flatnonzero(ids == mark)
        if len(marks) == len(units) - 1:
            return np.delete(ids, marks), np.diff(marks, prepend=-1, append=len(ids)) - 1
        parts = self.whole(units)
        return np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)

    def _told(self, units: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """As ``_parted``, for units whose ids tell their borders; None where they don't.

        plain: units of ASCII letters, which are their own pre-tokens.
        """
        if self.spaced:
            text = "".join(units)
            (ids,) = self.whole([text.replace(" ", " \u0120")], self.plain) if plain else self.whole([text])
            edges = np.append(np.flatnonzero(self.telling[ids]), len(ids))
        else:
            (ids,) = self.whole([" ".join(units).lower() if plain and self.folds else " ".join(units)], self.plain if plain and self.folds else None)
            edges = np.append(0, np.flatnonzero(self.telling[ids]) + 1)
        return (ids, np.diff(edges)) if len(edges) == len(units) + 1 and edges[0] == 0 and edges[-1] == len(ids) else None

    def _kinds(self, text: np.ndarray, sizes: np.ndarray, units: list[str]) -> np.ndarray:
        """0 for units of ASCII letters, 1 for others whose ids tell their borders, 2 for the rest."""
        if self.telling is None:
            return np.full(len(units), 2)
        begin = np.cumsum(sizes) - sizes
        letters = np.add.reduceat(_LETTER[text], begin, dtype=np.int64)
        if self.spaced:
            space = (text == 0x20) | ((text >= 0x09) & (text <= 0x0D))
            one = (text[begin] == 0x20) & (np.add.reduceat(space, begin, dtype=np.int64) == 1) & (sizes > 1)
            return np.where(one, np.where(letters == sizes - 1, 0, 1), 2)
        out = np.where(letters == sizes, 0, 2)
        other = np.flatnonzero(out)
        out[other[[units[k].isalpha() for k in other.tolist()]]] = 1
        return out

    def _many(self, text: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of units, whose bytes come in a row, and how many each has."""
        data, ends = text.tobytes(), np.cumsum(sizes)
        units = [data[e - n : e].decode() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        kinds, parts, order, counts = self._kinds(text, sizes, units), [], [], []
        for kind in range(3):
            of = np.flatnonzero(kinds == kind)
            for k in range(0, len(of), JOINED):
                some = [units[i] for i in of[k : k + JOINED].tolist()]
                ids, count = (self._told(some, kind == 0) if kind < 2 else None) or self._parted(some)
                parts.append(ids)
                counts.append(count)
            order.append(of)
        ids, count, order = np.concatenate(parts), np.concatenate(counts), np.concatenate(order)
        back = np.argsort(order)
        return _gathered(ids, (np.cumsum(count) - count)[back], count[back]), count[back]

    def _known(self, keys: np.ndarray, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Places in the memo of units that are spans of ``raw``; unknown ones are encoded first."""
        self.memo.make_room(len(keys))
        at = self.memo.find(keys)
        new = np.flatnonzero(at < 0)
        self.memo.met[at] = True  # of the last place too, where units are new: no harm
        if len(new):
            distinct, place, inverse = np.unique(keys[new], return_index=True, return_inverse=True)
            place = new[place]
            own = _gathered(raw, starts[place], sizes[place])
            at[new] = self.memo.add(distinct, own, sizes[place], *self._many(own, sizes[place]))[inverse]
        return at

    def _group(self, w: Words) -> tuple[np.ndarray, np.ndarray] | None:
        """ids and row offsets; None where two units share a hash, or one is very long."""
        if self.folds:
            w.raw = folded(w.raw)
        # where white space yields ids, a unit is a word with the white space before it; what is left at a row's end is one too
        keys, starts, ends, offsets = spaced_units(w) if self.spaced else bare_units(w)
        sizes, rows = ends - starts, w.last - w.first
        if len(sizes) and sizes.max() > LONGEST:
            return None
        at = self._known(keys, w.raw, starts, sizes)
        if not self.memo.holds(w.raw, starts, sizes, at):
            return None
        first, size = np.insert(self.memo.first[at].astype(np.int64), offsets[1:], 0), np.insert(self.memo.size[at].astype(np.int64), offsets[1:], 1)
        ends_at = np.cumsum(size)
        bounds = np.append(0, ends_at[offsets[1:] + np.arange(rows)])
        return _gathered(self.memo.flat, first, size), bounds

    def _alone(self, column, row: int):
        ids = np.append(self.whole([column[row].as_py() or ""])[0], np.uint32(self.end)).astype(np.uint32)
        return row, ids, np.array([0, len(ids)])

    def _splits(self, w: Words) -> bool:
        return self.spaced is not None and self.border is not None and len(w.raw) <= CHUNK and not self.odd.search(w.raw)

    def encode(self, column):
        """(first row, ids, row offsets) for consecutive rows of an Arrow text column."""
        for w in words(column, hashed=False):
            made = self._group(w) if self._splits(w) else None
            if made:
                yield w.first, *made
                continue
            for k in range(w.first, w.last):
                (one,) = words(column.slice(k, 1), hashed=False)
                made = self._group(one) if self._splits(one) else None
                yield (k, *made) if made else self._alone(column, k)


def _gathered(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The entries of spans of ``raw``, in a row."""
    ends = np.cumsum(sizes)
    return raw[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


def _room(array: np.ndarray, n: int) -> np.ndarray:
    if n <= len(array):
        return array
    out = np.zeros(max(n, 2 * len(array)), dtype=array.dtype)
    out[: len(array)] = array
    return out


@functools.lru_cache(maxsize=4)
def encoder(path: str, end_id: int) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path, end_id)
