"""Language identification of mixed-language text.

Each word gets a score for every learned language, from the letter n-grams of
the word; the scripts of its letters narrow the languages that are considered.
Viterbi's algorithm over these scores, with a penalty for a change of language,
labels the words of the whole text, and neighbours with one label form a span.
The language of a document is the one with most letters; its score is that
language's share of the letters.

The model is fitted on a bounded sample of labelled rows (``sample_docs``,
chosen by a hash of doc_id) and has a fixed size for each language.

A letter is what Unicode calls one; the ranges below say of which script it is.

Edge cases: a null text and one without letters give ``und`` and score 0;
digits and marks, of whatever script, take the label around them and have no
weight; a text of any length is labelled whole; words in a
script that no language was learned in leave the decision to the others, and a
text of nothing else gets the most frequent language with score 0; ties go to
the language that sorts first; repeated rows are judged one by one; an empty
table gives no rows; with nothing to learn from, every row is ``und``.
"""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from sheetwright.llm.textcore import slices, words
from sheetwright.llm.workspace import prepare

#: First code points of script ranges, and the script there (0: other).
SCRIPTS = (
    (0x0000, "other"),
    (0x0041, "Latin"),
    (0x005B, "other"),
    (0x0061, "Latin"),
    (0x007B, "other"),
    (0x00AA, "Latin"),
    (0x00AB, "other"),
    (0x00BA, "Latin"),
    (0x00BB, "other"),
    (0x00C0, "Latin"),
    (0x00D7, "other"),
    (0x00D8, "Latin"),
    (0x00F7, "other"),
    (0x00F8, "Latin"),
    (0x02B0, "other"),
    (0x0370, "Greek"),
    (0x0400, "Cyrillic"),
    (0x0530, "Armenian"),
    (0x0590, "Hebrew"),
    (0x0600, "Arabic"),
    (0x0700, "other"),
    (0x0900, "Devanagari"),
    (0x0980, "Bengali"),
    (0x0A00, "other"),
    (0x0B80, "Tamil"),
    (0x0C00, "other"),
    (0x0E00, "Thai"),
    (0x0E80, "other"),
    (0x10A0, "Georgian"),
    (0x1100, "Hangul"),
    (0x1200, "other"),
    (0x1E00, "Latin"),
    (0x1F00, "Greek"),
    (0x2000, "other"),
    (0x3041, "Hiragana"),
    (0x30A0, "Katakana"),
    (0x3100, "other"),
    (0x3400, "Han"),
    (0x4DC0, "other"),
    (0x4E00, "Han"),
    (0xA000, "other"),
    (0xAC00, "Hangul"),
    (0xD7B0, "other"),
    (0xF900, "Han"),
    (0xFB00, "Latin"),
    (0xFB07, "other"),
    (0x20000, "Han"),
    (0x30000, "other"),
)
_NAMES = sorted({name for _, name in SCRIPTS} - {"other"})
_EDGES = np.array([at for at, _ in SCRIPTS])
_SCRIPT_OF = np.array([len(_NAMES) + 1 if name == "other" else 1 + _NAMES.index(name) for _, name in SCRIPTS])

#: Buckets of hashed letter n-grams for each language.
BUCKETS = 1 << 15

#: Distinct words, and scores of words, that a worker keeps.
MEMO_WORDS, MEMO_SCORES = 200_000, 1 << 23

UND = "und"
LABELLED = "doc_id long, lang_pred string, score double, n_spans int"
SPANNED = "doc_id long, spans array<struct<start:int,end:int,lang:string>>"


@dataclass
class Model:
    """langs: sorted. table: log-probabilities by language and bucket. allowed: by script and language."""

    langs: list[str]
    table: np.ndarray
    allowed: np.ndarray
    prior: np.ndarray
    penalty: float
    memo: dict[int, int] = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "memo": {}, "held": None}

    held: list | None = None


@functools.lru_cache(maxsize=1)
def letter_scripts() -> np.ndarray:
    """By code point: 0 for no letter, else the script; letters outside the ranges have a number of their own."""
    points = np.arange(0x110000)
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return np.where(letter, _SCRIPT_OF[np.searchsorted(_EDGES, points, side="right") - 1], 0).astype(np.uint8)


def word_features(listed: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words' letter 1-, 2- and 3-grams, the word of each, and the words' letters and scripts."""
    text = " " + " ".join(w.lower().replace(" ", "_") for w in listed) + " "
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    script = letter_scripts()[points].astype(np.int64)
    border = points == 0x20
    word = np.cumsum(border) - 1
    n = len(listed)
    letters = np.bincount(word[script > 0], minlength=n)[:n]
    counted = np.bincount(word[script > 0] * (len(_NAMES) + 2) + script[script > 0], minlength=n * (len(_NAMES) + 2))
    main = counted[: n * (len(_NAMES) + 2)].reshape(n, -1).argmax(axis=1)
    known = np.where(script > 0, points, 0x20)  # marks and digits count as borders of a word
    one, two, three = known, known[:-1] * 0x110000 + known[1:], (known[:-2] * 0x110000 + known[1:-1]) * 31 + known[2:]
    buckets, owner = [], []
    for k, (gram, centre) in enumerate(((one, word), (two, word[:-1]), (three, word[1:-1]))):
        at = [script > 0, (script[:-1] > 0) | (script[1:] > 0), script[1:-1] > 0][k]
        who = centre[at] if k != 1 else np.maximum(word[:-1][at], 0)
        h = gram[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        buckets.append((h >> np.uint64(49)).astype(np.int64))
        owner.append(np.minimum(who, n - 1))
    return np.concatenate(buckets), np.concatenate(owner), letters, main


def fit(rows: DataFrame, sample_docs: int = 4000, penalty: float = 8.0, smoothing: float = 0.5) -> Model:
    """A model from ``rows`` (doc_id, text, lang), of which about ``sample_docs`` are read."""
    spark = rows.sparkSession
    prepare(spark)
    rows = rows.where("lang is not null and text is not null").select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))
    n = max(1, rows.select("lang").count())
    if n > sample_docs:
        rows = rows.where(F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30)) < F.lit(int((1 << 30) * sample_docs / n)))

    def count(batches):
        width = BUCKETS + len(_NAMES) + 2  # the scripts' letters stand behind the buckets
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang, text in zip(langs, batch.column("text").to_pylist(), strict=True):
                listed = text.split()
                if listed:
                    buckets, _, letters, main = word_features(listed)
                    mine = totals.setdefault(lang, np.zeros(width))
                    mine[:BUCKETS] += np.bincount(buckets, minlength=BUCKETS)
                    mine[BUCKETS:] += np.bincount(main, weights=letters, minlength=width - BUCKETS)
        for lang, mine in totals.items():
            at = np.flatnonzero(mine)
            yield pa.record_batch([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(mine[at])], names=["lang", "bucket", "n"])

    counted = rows.mapInArrow(count, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # of fixed size for each language
    langs = sorted(set(counted["lang"]))
    width = BUCKETS + len(_NAMES) + 2
    table = np.zeros((max(1, len(langs)), width))
    if langs:
        table[counted["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(), counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    script, grams = table[:, BUCKETS:], table[:, :BUCKETS]
    allowed = (script >= 0.01 * np.maximum(1, script.sum(axis=1, keepdims=True))).T
    allowed[0] = False
    logs = np.log((grams + smoothing) / (grams.sum(axis=1, keepdims=True) + smoothing * BUCKETS)) / 2  # the n-grams overlap
    return Model(langs, logs.T.astype(np.float32).copy(), allowed, script.sum(axis=1), penalty)


def _scores(model: Model, w) -> tuple[np.ndarray, np.ndarray]:
    """Score by word and language, and letters by word."""
    if model.held is None:
        model.held = [np.zeros((0, len(model.langs)), dtype=np.float32), np.zeros(0, dtype=np.int64)]
    distinct, place, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
    if len(model.memo) + len(distinct) > min(MEMO_WORDS, MEMO_SCORES // len(model.langs)):
        model.memo.clear()
        model.held = [model.held[0][:0], model.held[1][:0]]
    keys = distinct.tolist()
    at = np.fromiter(map(model.memo.get, keys, itertools.repeat(-1)), dtype=np.int64, count=len(keys))
    new = np.flatnonzero(at < 0)
    if len(new):
        base = len(model.memo)
        raw, starts, ends = w.raw, w.starts, w.ends
        listed = [raw[starts[p] : ends[p]].tobytes().decode() for p in place[new].tolist()]
        buckets, owner, letters, main = word_features(listed)
        score = np.stack([np.bincount(owner, weights=model.table[buckets, k], minlength=len(listed)) for k in range(len(model.langs))], axis=1)
        can = model.allowed[main]
        none = ~can.any(axis=1) | (letters == 0)
        score = np.where(can, score - np.where(can, score, -np.inf).max(axis=1, keepdims=True, initial=-1e30), -1e4)
        score[none] = 0
        weight = letters + np.where(none & (letters > 0), 1 << 40, 0)  # letters of unlearned scripts, kept apart
        if base + len(new) > len(model.held[1]):
            room = max(2 * len(model.held[1]), base + len(new), 1 << 14)
            model.held = [np.resize(model.held[0], (room, len(model.langs))), np.resize(model.held[1], room)]
        model.held[0][base : base + len(new)], model.held[1][base : base + len(new)] = score, weight
        at[new] = np.arange(base, base + len(new))
        model.memo.update(zip(distinct[new].tolist(), at[new].tolist(), strict=True))
    at = at[inverse]
    return model.held[0][at], model.held[1][at]


def viterbi(scores: np.ndarray, offsets: np.ndarray, penalty: float, piece: int = 96) -> np.ndarray:
    """The best label of each row of ``scores`` when every change of label costs ``penalty``.

    offsets: where each sequence begins. The sequences are cut into pieces, whose
    values are found for every label before them, all pieces at once, and joined;
    with the label before it known, each piece is then solved. Pieces are longer
    where there are many labels, so memory grows with rows times labels.
    """
    n, k = scores.shape
    if not n:
        return np.zeros(0, dtype=np.int64)
    piece = max(piece, -(-n * k * k >> 22))
    size = np.diff(offsets)
    pieces = -(-size // piece)
    seq = np.repeat(np.arange(len(size)), pieces)
    number = np.arange(len(seq)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = offsets[:-1][seq] + number * piece
    length = np.minimum(piece, offsets[1:][seq] - begin)
    order = np.argsort(-length, kind="stable")  # so that the pieces still open stand in front
    begin_o, length_o = begin[order], length[order]
    live_at = np.searchsorted(-length_o, -np.arange(1, piece + 1), side="right")
    change = np.where(np.eye(k, dtype=bool), 0.0, -penalty)

    best = change[None] + scores[begin_o][:, None, :]  # by piece, label before it and last label
    for t in range(1, int(length_o[0])):
        live = live_at[t]
        now = best[:live]
        best[:live] = np.maximum(now, now.max(axis=2, keepdims=True) - penalty) + scores[begin_o[:live] + t][:, None, :]
    whole = np.empty_like(best)
    whole[order] = best
    # joins the pieces of each sequence; all sequences with an i-th piece at once
    first = np.cumsum(pieces) - pieces
    value = np.zeros((len(size), k))
    entry = np.zeros((len(seq), k), dtype=np.int64)
    for i in range(int(pieces.max())):
        on = np.flatnonzero(pieces > i)
        total = value[on][:, :, None] + whole[first[on] + i]
        entry[first[on] + i] = total.argmax(axis=1)
        value[on] = total.max(axis=1)
    state = value.argmax(axis=1)
    out_state, in_state = np.zeros(len(seq), dtype=np.int64), np.zeros(len(seq), dtype=np.int64)
    for i in range(int(pieces.max()) - 1, -1, -1):
        on = np.flatnonzero(pieces > i)
        at = first[on] + i
        out_state[at] = state[on]
        in_state[at] = entry[at, state[on]]
        state[on] = in_state[at]

    back = np.empty((n, k), dtype=np.min_scalar_type(k - 1))
    best = change[in_state[order]] + scores[begin_o]
    for t in range(1, int(length_o[0])):
        live = live_at[t]
        now, row = best[:live], begin_o[:live] + t
        top = now.argmax(axis=1)
        jump = np.take_along_axis(now, top[:, None], axis=1) - penalty
        stay = now >= jump
        back[row] = np.where(stay, np.arange(k), top[:, None])
        best[:live] = np.where(stay, now, jump) + scores[row]
    labels = np.zeros(n, dtype=np.int64)
    now = out_state[order]
    for t in range(int(length_o[0]) - 1, -1, -1):
        live = live_at[t]
        row = begin_o[:live] + t
        labels[row] = now[:live]
        if t:
            now[:live] = back[row, now[:live]]
    return labels


def _label(model: Model, w) -> tuple[np.ndarray, np.ndarray]:
    scores, weight = _scores(model, w)
    return viterbi(scores.astype(np.float64), w.offsets, model.penalty), weight


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and the number of spans for every row of ``docs``."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in slices(batches):
            names, share, spans, _ = _judge(model, batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), names, share, spans], names=["doc_id", "lang_pred", "score", "n_spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, LABELLED)


def judged(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_share beside its own columns, in one pass and without a join.

    lang_score is the language's share of the letters in learned scripts, lang_share its share of all letters.
    Columns of ``docs`` that have one of these names give way.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("lang_pred", "lang_score", "lang_share")

    def run(batches):
        for batch in slices(batches):
            names, share, _, of_all = _judge(model, batch.column("text"))
            yield pa.record_batch([*batch.columns, names, share, of_all], names=[*batch.schema.names, "lang_pred", "lang_score", "lang_share"])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType()), StructField("lang_share", DoubleType())]))


def _judge(model: Model, column) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """Language, share, number of spans and share of all letters of each row of a text column. A word is of its main script."""
    k, n = len(model.langs), len(column)
    fallback = model.langs[int(model.prior.argmax())] if k else UND
    names, share, spans, of_all = [UND] * n, np.zeros(n), np.zeros(n, dtype=np.int32), np.zeros(n)
    for w in words(column) if k else ():
        labels, weight = _label(model, w)
        rows = w.last - w.first
        row_of = np.repeat(np.arange(rows), np.diff(w.offsets))
        known = np.where(weight < 1 << 40, weight, 0)
        total = np.bincount(row_of * k + labels, weights=known, minlength=rows * k).reshape(rows, k)
        letters = np.bincount(row_of, weights=weight & (1 << 40) - 1, minlength=rows)
        strange = np.bincount(row_of, weights=weight >= 1 << 40, minlength=rows) > 0
        sums, top = total.sum(axis=1), total.argmax(axis=1)
        turn = np.ones(len(labels), dtype=bool)
        turn[1:] = (labels[1:] != labels[:-1]) | (row_of[1:] != row_of[:-1])
        spans[w.first : w.last] = np.bincount(row_of, weights=turn, minlength=rows)
        for r in np.flatnonzero(sums > 0).tolist():
            names[w.first + r], share[w.first + r] = model.langs[top[r]], total[r, top[r]] / sums[r]
            of_all[w.first + r] = total[r, top[r]] / letters[r]
        for r in np.flatnonzero((sums == 0) & strange).tolist():
            names[w.first + r] = fallback
    return pa.array(names, pa.string()), pa.array(share), pa.array(spans), pa.array(of_all)


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the spans of words [start, end) with one language, in order."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(batch.num_rows)]
            for w in words(batch.column("text")) if model.langs else ():
                labels, _ = _label(model, w)
                for r in range(w.last - w.first):
                    own = labels[w.offsets[r] : w.offsets[r + 1]]
                    at = np.flatnonzero(np.diff(own, prepend=-1)).tolist()
                    out[w.first + r] = [{"start": a, "end": b, "lang": model.langs[own[a]]} for a, b in zip(at, [*at[1:], len(own)], strict=True)]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SPANNED)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, sample_docs: int = 4000) -> DataFrame:
    """Learn from the rows that are not held out, judge all."""
    model = fit(docs.select("doc_id", "text", "lang").where(~held_out()), sample_docs)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_spans")
