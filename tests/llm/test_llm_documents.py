"""Operators over documents against brute-force versions, and their edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sheetwright.llm import decontaminate, language_id, ngram_join, packing, secret_scan, substring_dedup, token_files
from sheetwright.llm.queries import QUERIES
from sheetwright.llm.textcore import words
from sheetwright.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")

LONG = "long " + " ".join(f"w{k % 977}x{k % 89}" for k in range(250_000))  # more than one chunk
GIANT = "a" * 1_200_000  # a word longer than a chunk
BASE = " ".join(f"common{k}" for k in range(60))
ODD = [
    (1, None, "en"),
    (2, "", "en"),
    (3, " \t\n ", None),
    (4, "one two", "de"),
    (5, "one two", "de"),
    (5, "one two", "de"),
    (6, BASE, "en"),
    (7, BASE.upper(), "en"),
    (8, BASE + " tail", "en"),
    (9, "password=hunter2hunter2 é 😀 token: 'abcdefgh12'", None),
    (10, LONG, "fr"),
    (11, LONG + " more", "fr"),
    (12, GIANT, None),
    (None, BASE, "en"),
    (13, "x y  z <|endoftext|> \n\n<|endoftext|>", None),
    (14, "\x1c a\x1d 日本語　テスト", None),
]


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns named like those the operators add."""
    schema = "doc_id long, text string, lang string, slot int, bands string, set_key string, base string, spans int, size int, root string, n_shingles string"
    return spark.createDataFrame([(*r, 7, "b", "k", "x", 1, 2, "r", "s") for r in ODD], schema)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


# -- words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\t\n\x0b日", max_size=40)), max_size=12))
def test_words_are_those_of_the_pattern(texts):
    seen, known = [], {}
    for w in words(pa.array(texts, pa.string())):
        for k in range(w.last - w.first):
            own = [w.raw[a:b].tobytes().decode() for a, b in zip(w.starts[w.offsets[k] : w.offsets[k + 1]], w.ends[w.offsets[k] : w.offsets[k + 1]], strict=True)]
            seen.append(own)
            for word, h in zip(own, w.hashes[w.offsets[k] : w.offsets[k + 1]].tolist(), strict=True):
                assert known.setdefault(word, h) == h
    assert seen == [WORD.findall(t or "") for t in texts]
    assert len(set(known.values())) == len(known)


def test_words_of_long_texts_hash_alike():
    for text in (LONG, GIANT + " b", "b " + GIANT):
        (w,) = words(pa.array([text]))
        assert [w.raw[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends, strict=True)] == WORD.findall(text)
        (alone,) = words(pa.array([WORD.findall(text)[-1]]))
        assert alone.hashes[0] == w.hashes[-1]


# -- 1: token files


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_ids_are_those_of_whole_texts(path):
    encoder, plain = Encoder(path, 2), Tokenizer.from_file(path)
    texts = [t for _, t, _ in ODD if t is None or len(t) < 10_000] + ["it's  'll 12 3a  é́ q", "İstanbul ΣΑΣ ﬁ", "   a\t\tb  \r\n c ", "\n", " ", "a  <|ENDOFTEXT|>"]
    for _ in range(2):  # the second time from the memo
        got = {}
        for row, ids, bounds in encoder.encode(pa.array(texts, pa.string())):
            got |= {row + k: ids[a:b].tolist() for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))}
        assert [got[k] for k in range(len(texts))] == [plain.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def test_token_files_round_trip(spark, documents):
    plain, start, want = Tokenizer.from_file(BYTE), 0, {}
    for doc in sorted(documents):
        ids = np.array(plain.encode(documents[doc]["text"] or "", add_special_tokens=False).ids + [2], dtype="<u4")
        want[doc] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r["doc_id"]: tuple(r[c] for c in ("start", "n_tokens", "ids_crc32")) for r in QUERIES["op1_token_files"](spark, SF).collect()} == want


def test_token_files_give_sequences_and_masks(spark, tmp_path, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    files = token_files.write_token_files(docs, f"file://{tmp_path}", BYTE, length=16, rows=4, partitions=2).collect()
    total = 0
    for name in sorted({r["file"] for r in files}):
        one = token_files.TokenFile(name)
        n = sum(r["n_tokens"] for r in files if r["file"] == name)
        rows = sum(b.num_rows for b in one.batches)
        parts = [one.sequence(k) for k in range(rows)]
        assert all(len(ids) == len(mask) == 16 for ids, mask in parts)
        assert sum(int(mask.sum()) for _, mask in parts) == n
        assert np.array_equal(np.concatenate([ids[mask] for ids, mask in parts]), one.ids(0, n))
        total += n
    assert total == sum(r["n_tokens"] for r in files)


def test_token_files_edge_cases(spark, odd, none):
    rows = token_files.token_digests(odd, BYTE).orderBy("start").collect()
    assert len(rows) == len(ODD) and rows[0]["doc_id"] is None
    assert [r["start"] for r in rows[1:]] == list(np.cumsum([r["n_tokens"] for r in rows])[:-1])
    assert all(r["n_tokens"] == 1 for r in rows if r["doc_id"] in (1, 2))
    assert token_files.token_digests(none, BYTE).count() == 0


# -- 2: languages


def test_language_on_held_out_documents(spark, documents):
    rows = QUERIES["op2_language_id"](spark, "/root/testdata/sf0.01").collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_viterbi_is_the_best_path():
    random = np.random.default_rng(1)
    for n, k in ((1, 2), (7, 3), (5, 4)):
        scores = random.normal(size=(n, k)) * 3
        got = language_id.viterbi(scores, np.array([0, n]), 2.0, piece=3)
        value = lambda path: sum(scores[t, s] for t, s in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))  # noqa: B023, E731
        best = max(value([(c // k**t) % k for t in range(n)]) for c in range(k**n))
        assert value(got.tolist()) == pytest.approx(best)


def test_language_spans_and_edge_cases(spark, odd, none):
    train = spark.createDataFrame([(1, "the cat and the dog with that hat is here " * 20, "en"), (2, "der hund und die katze mit dem hut ist nicht hier " * 20, "de")], "doc_id long, text string, lang string")
    model = language_id.fit(train)
    mixed = spark.createDataFrame([(1, "the dog and the cat with the hat " * 3 + "die katze und der hund ist nicht mit dem hut " * 6, 5)], "doc_id long, text string, lang_pred int")
    (row,) = language_id.spans(mixed, model).collect()
    assert [s["lang"] for s in row["spans"]] == ["en", "de"] and row["spans"][0]["end"] in range(21, 28)
    got = {r["doc_id"]: r for r in language_id.predict(odd, model).collect()}
    assert {got[k]["lang_pred"] for k in (1, 2, 3)} == {"und"} and got[4]["lang_pred"] in ("en", "de")
    assert language_id.predict(odd, model).count() == len(ODD)
    assert language_id.identify(none).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd.drop("lang").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}


# -- 3: decontamination


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _brute_leaks(docs, items):
    out = {}
    for i, item in items:
        target = WORD.findall((item or "").translate(LOWER))
        n = len(target)
        for d, text in docs:
            own = WORD.findall((text or "").translate(LOWER))
            starts = range(len(own) - n + 1) if len(own) >= n else [0]
            found = [_edits(own[k : k + n], target) for k in starts] if n and own else []
            if found and min(found) <= int(0.2 * n + 1e-9):
                out[d, i] = min(found)
    return out


def test_leaks_of_edited_passages(spark):
    random = np.random.default_rng(5)
    vocabulary = [f"v{k}" for k in range(400)]
    some = lambda n: [vocabulary[k] for k in random.integers(0, 400, n)]
    items = [(k, some(int(random.integers(10, 30)))) for k in range(12)]
    docs, planted = [], []
    for d in range(60):
        i, item = items[d % 12]
        own = list(item)
        for _ in range(d // 12):
            at = int(random.integers(0, len(own)))
            own[at : at + 1] = [[], ["new"], [own[at], "new"]][int(random.integers(0, 3))]
        docs.append((d, " ".join([*some(40), *own, *some(40)])))
        planted.append((d, i))
    text = [(i, " ".join(x)) for i, x in items]
    want = _brute_leaks(docs, text)
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(text, "item_id long, text string")).collect()}
    assert all(want[k] == v for k, v in got.items())
    assert len(got) >= 0.9 * len(want) and all(k in got for k, v in want.items() if v == 0)


def test_leaks_of_the_benchmark(spark, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op3_decontaminate"](spark, SF).collect()}
    exact = {(d, i) for d, r in documents.items() for i, t in items if t.translate(LOWER) in (r["text"] or "").translate(LOWER)}
    assert exact <= got
    for d, i in got - exact:
        assert _brute_leaks([(d, documents[d]["text"])], [x for x in items if x[0] == i])


def test_leaks_edge_cases(spark, odd, none):
    items = spark.createDataFrame([(1, BASE, 3), (2, None, 3), (3, "", 3), (4, BASE, 3), (5, "one two three four five", 3)], "item_id long, text string, edits int")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(odd, items).collect()}
    assert got == {(d, i) for d in (6, 7, 8, None) for i in (1, 4)}
    assert decontaminate.contaminated(none, items).count() == 0 and decontaminate.contaminated(odd, items.limit(0)).count() == 0
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(odd, items, block_words=10).collect()} == got


# -- 4: n-gram join


def _brute_classes(docs):
    sets = {}
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for d in sorted(sets):
        for e, n in Counter(e for s in sets[d] for e in held[s]).items():
            if 100 * n >= 80 * (len(sets[d]) + len(sets[e]) - n):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
        for s in sets[d]:
            held[s].append(d)
    return {d: (len(sets[d]), root(d)) for d in sets}


def _classes(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_classes_of_documents(spark, documents):
    assert _classes(QUERIES["op4_ngram_jaccard"](spark, SF)) == _brute_classes([(d, r["text"]) for d, r in documents.items()])


def test_classes_of_a_family_of_edits(spark):
    random = np.random.default_rng(3)
    base = [f"b{k}" for k in range(120)]
    docs = []
    for d in range(150):
        own = list(base)
        for at in random.integers(0, 120, int(random.integers(0, 14))).tolist():
            own[at] = f"e{int(random.integers(0, 30))}" if d % 2 else f"u{d}"
        docs.append((d, " ".join(own)))
    assert _classes(ngram_join.classes(spark.createDataFrame(docs, "doc_id long, text string"))) == _brute_classes(docs)


def test_classes_edge_cases(spark, odd, none):
    rows = ngram_join.classes(odd).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert len(rows) == len(ODD)
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3)
    assert got[4] == (1, 4) and got[5] == (1, 4)
    assert got[6][1] == got[7][1] == got[8][1] == got[None][1] == 6 and got[11][1] == 10
    assert ngram_join.classes(none).count() == 0


# -- 5: packing


def test_packing_round_trip(spark, documents):
    rows = QUERIES["op5_packing"](spark, SF).collect()
    plain = Tokenizer.from_file(WORDS)
    ids = {d: np.array(plain.encode(r["text"] or "", add_special_tokens=False).ids + [2], dtype="<u4") for d, r in documents.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts, size in [*((pieces[d], len(x)) for d, x in ids.items()), *((s, None) for s in sequences.values())]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == size if size is not None else at <= 4096
    assert len(sequences) * 4096 <= 1.1 * sum(map(len, ids.values())) + 4096


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_first_fit_decreasing(sizes):
    where, offsets = packing.first_fit_decreasing(np.array(sizes, dtype=np.int64), 50)
    bins = []
    want = {}
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        at = next((b for b, used in enumerate(bins) if used + sizes[k] <= 50), len(bins))
        bins += [0] * (at == len(bins))
        want[k] = (at, bins[at])
        bins[at] += sizes[k]
    assert [(int(a), int(b)) for a, b in zip(where, offsets, strict=True)] == [want[k] for k in range(len(sizes))]


def test_packing_edge_cases(spark, odd, none):
    rows = packing.pack(odd, WORDS, group_size=4).collect()
    assert sum(r["start"] == 0 for r in rows) == len(ODD) and max(r["length"] for r in rows) == 4096
    assert packing.pack(none, WORDS).count() == 0


# -- 6: secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def _base(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def _digest(found):
    return hashlib.sha256(",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in found).encode()).hexdigest()


def test_base_secrets(spark, documents):
    for r in QUERIES["op6_secret_scan"](spark, SF).collect():
        want = _base(documents[r["doc_id"]]["text"])
        count = Counter(k for _, k, _ in want)
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == (count[0], count[1], count[2], _digest(want))


def test_entropy_by_brute_force(spark):
    import math

    random = np.random.default_rng(2)
    letters = secret_scan.CLASSES["base64"][1]
    strings = ["".join(letters[k] for k in random.integers(0, m, n)) for n, m in ((24, 67), (40, 10), (60, 30), (25, 67), (24, 2))]
    want = [max(-sum(c / 24 * math.log2(c / 24) for c in Counter(s[k : k + 24]).values()) for k in range(len(s) - 23)) for s in strings]
    df = spark.createDataFrame([(s,) for s in strings], "s string")
    got = [r[0] for r in df.select(secret_scan.most_entropy(df["s"], letters, 24)).collect()]
    assert got == pytest.approx(want)


def test_entropy_spans_and_allow_list(spark):
    secret = "kJ8xQ2vT9mZ4pL7wR1nB6yD3"
    texts = [f"é key {secret} end", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "123e4567-e89b-42d3-a456-426614174000", "abcdefghijklmnopqrstuvwxyz0123456789AB", f"token={secret}"]
    rows = {r["doc_id"]: r["spans"] for r in secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows == {0: f"entropy:6:{6 + len(secret)}", 1: "", 2: "", 3: "", 4: f"assign:0:{len(texts[4])}"}


def test_redaction_and_edge_cases(spark, odd, none):
    got = {r["doc_id"]: r for r in secret_scan.scan(odd).collect()}
    assert got[1]["spans"] == "" and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[9]["n_assign"] == 2
    assert secret_scan.scan(odd).count() == len(ODD) and secret_scan.scan(none).count() == 0
    clean = secret_scan.redacted(odd)
    assert clean.columns == odd.columns
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts[9] == "[SECRET] é 😀 [SECRET]'" and texts[1] is None and texts[6] == BASE


# -- 9: repeated passages


def _brute_kept(docs, n=13):
    first = {}
    cut = {d: WORD.findall(t or "") for d, t in docs}
    for d in sorted(cut):
        for k in range(len(cut[d]) - n + 1):
            first.setdefault(tuple(cut[d][k : k + n]), d)
    out = {}
    for d, w in cut.items():
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < d:
                gone.update(range(k, k + n))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def _kept(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()}


def test_repeated_passages(spark, documents):
    assert _kept(QUERIES["op9_substring_dedup"](spark, SF)) == _brute_kept([(d, r["text"]) for d, r in documents.items()])


def test_repeated_passages_in_few_words(spark):
    random = np.random.default_rng(9)
    docs = [(d, " ".join(map(str, random.integers(0, 2, int(random.integers(0, 40)))))) for d in range(60)]
    assert _kept(substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"))) == _brute_kept(docs)


def test_repeated_passages_edge_cases(spark, odd, none):
    rows = substring_dedup.remove_repeats(odd).collect()
    got = {r["doc_id"]: r["n_removed"] for r in rows}
    assert len(rows) == len(ODD)
    assert got[1] == got[2] == got[5] == got[6] == got[None] == 0 and got[8] == 60
    assert got[11] == 250_001
    assert substring_dedup.remove_repeats(none).count() == 0


def test_automata_of_a_reference(spark):
    random = np.random.default_rng(4)
    some = lambda n: [str(x) for x in random.integers(0, 3, n)]
    reference, docs = [some(30) for _ in range(4)], [(d, some(60)) for d in range(6)]
    got = defaultdict(set)
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    for r in substring_dedup.match_reference(frame, spark.createDataFrame([(" ".join(w),) for w in reference], "text string"), window=6, shard_words=50).collect():
        got[r["doc_id"]].update(range(r["start"], r["end"]))
    known = {tuple(w[k : k + 6]) for w in reference for k in range(25)}
    for d, w in docs:
        assert got[d] == {j for k in range(55) if tuple(w[k : k + 6]) in known for j in range(k, k + 6)}
