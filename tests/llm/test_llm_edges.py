"""Long texts, many matches, structured words, odd letters: cases that small tables don't hold."""

import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from test_llm_documents import SF, WORD, _base, _digest
from tokenizers import Tokenizer

import corpus_pipeline
from sheetwright.llm import language_id, secret_scan
from sheetwright.llm.textcore import words
from sheetwright.llm.tokens import Encoder

# -- 1 and 5: words that a power of one base can't tell apart


def _thue_morse(doublings):
    text = "a"
    for _ in range(doublings):
        text += text.translate(str.maketrans("ab", "ba"))
    return text


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_words_alike_in_structure(name):
    one = _thue_morse(11)
    two = one.translate(str.maketrans("ab", "ba"))
    path = public_tokenizers.path(name)
    encoder, plain = Encoder(path, 2), Tokenizer.from_file(path)
    texts = [one, two, f"x {one} {two}", f"{two}\n{one}"]
    got = {}
    for row, ids, bounds in encoder.encode(pa.array(texts)):
        got |= {row + k: ids[a:b].tolist() for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))}
    assert [got[k] for k in range(4)] == [plain.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    hashes = [next(words(pa.array([t]))).hashes[0] for t in (one, two)]
    assert hashes[0] != hashes[1]


def test_units_that_share_a_hash_are_encoded_whole(monkeypatch):
    from sheetwright.llm import tokens

    real = tokens.spaced_units
    monkeypatch.setattr(tokens, "spaced_units", lambda w: (np.zeros(len(real(w)[0]), dtype=np.uint64), *real(w)[1:]))
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, plain = Encoder(path, 2), Tokenizer.from_file(path)
    texts = ["one two", "three", None, "one"]
    got = {}
    for row, ids, bounds in encoder.encode(pa.array(texts)):
        got |= {row + k: ids[a:b].tolist() for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))}
    assert [got[k] for k in range(4)] == [plain.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_the_library_gets_a_word_few_times(monkeypatch, name):
    from sheetwright.llm import tokens

    monkeypatch.setattr(tokens, "MEMO_UNITS", 2000)
    path = public_tokenizers.path(name)
    encoder, plain, sent, real = Encoder(path, 2), Tokenizer.from_file(path), Counter(), Encoder.whole

    def whole(texts, *others):
        sent.update(WORD.findall(" ".join(texts).replace("<|endoftext|>", " ").replace("<|startoftext|>", " ").replace("\u0120", "")))
        return real(encoder, texts, *others)

    encoder.whole = whole
    common = ["".join("abcdefghij"[int(d)] for d in f"{k:03}") + "x" for k in range(100)]
    for round_ in range(40):
        fresh = ["".join("klmnopqrst"[int(d)] for d in f"{round_:02}{k:03}") for k in range(400)]
        texts = [" " + " ".join(common) + " " + " ".join(fresh), " " + ", ".join(common[:50]) + ". " + "! ".join(common[50:])]
        got = {}
        for row, ids, bounds in encoder.encode(pa.array(texts)):
            got |= {row + k: ids[a:b].tolist() for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))}
        assert [got[k] for k in range(2)] == [plain.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert max(sent[w] + sent[w + ","] + sent[w + "."] + sent[w + "!"] for w in common) <= 2


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_marks_accents_and_spaces(name):
    atoms = [*"aAhHiIjtTwy09'',.!=/_-|$", "'s", "'S", "'re", " ", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\u0301", "\u0331", "\u030c", "\u0307", "\u0338"]
    atoms += ["\xe9", "\xdf", "\u0130", "\u03a3", "\u65e5", "\u1100", "\u1161", "\u212a", "\u037e", "\U0001f600", "\u0661", "\xbd", "\u200d", "the", "hello", "<|"]
    draw, path = random.Random(7), public_tokenizers.path(name)
    texts = ["".join(draw.choices(atoms, k=draw.randint(0, 40))) for _ in range(5000)] + ["b" * 3000 + ", " + "c" * 3000]
    encoder, plain, got = Encoder(path, 2), Tokenizer.from_file(path), {}
    for row, ids, bounds in encoder.encode(pa.array(texts)):
        got |= {row + k: ids[a:b].tolist() for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))}
    assert [got[k] for k in range(len(texts))] == [plain.encode(t, add_special_tokens=False).ids + [2] for t in texts]


# -- 2: languages


def test_digits_and_marks_are_no_letters(spark):
    train = spark.createDataFrame([(1, "the cat and the dog " * 20, "en"), (2, "кот и собака " * 20, "ru")], "doc_id long, text string, lang string")
    model = language_id.fit(train)
    texts = ["٣٤٥", "१२३", "๑๒๓", "҂", "ְֱ", "12 34", "...", "ª", "кот"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert [got[k] for k in range(7)] == [("und", 0.0)] * 7
    assert got[7][0] != "und" and got[8] == ("ru", 1.0)


def test_viterbi_with_many_labels_and_a_long_sequence():
    random = np.random.default_rng(3)
    for k, n in ((200, 700), (3, 20_000), (130, 1)):
        scores = random.normal(size=(n, k)) * 2
        got = language_id.viterbi(scores, np.array([0, 0, n]), 3.0, piece=50)
        value, path = scores[0].copy(), scores[np.arange(n), got].sum() - 3.0 * (np.diff(got) != 0).sum()
        for t in range(1, n):
            value = np.maximum(value, value.max() - 3.0) + scores[t]
        assert path == pytest.approx(value.max()) and got.min() >= 0


def _plain_language(model, text):
    """Word by word: n-grams of letters, the languages of the main script, the best path, letters by language."""
    scripts, k = language_id.letter_scripts(), len(model.langs)
    scores, letters = [], []
    for word in WORD.findall(text or ""):
        points = [0x20, *map(ord, word.lower()), 0x20]
        script = [int(scripts[p]) for p in points]
        known = [p if s else 0x20 for p, s in zip(points, script, strict=True)]
        grams = [(0, a) for a, s in zip(known, script, strict=True) if s]
        grams += [(1, known[j] * 0x110000 + known[j + 1]) for j in range(len(known) - 1) if script[j] or script[j + 1]]
        grams += [(2, (known[j - 1] * 0x110000 + known[j]) * 31 + known[j + 1]) for j in range(1, len(known) - 1) if script[j]]
        total = np.zeros(k)
        for kind, gram in grams:
            h = (gram * 0x9E3779B97F4A7C15 + kind) & (1 << 64) - 1
            h = ((h ^ h >> 29) * 0xBF58476D1CE4E5B9) & (1 << 64) - 1
            total += model.table[h >> 49]
        n = sum(s > 0 for s in script)
        counts = Counter(s for s in script if s)
        main = min(counts, key=lambda s: (-counts[s], s)) if counts else 0
        can = model.allowed[main]
        if n and can.any():
            scores.append(np.where(can, total - total[can].max(), -1e4))
        else:
            scores.append(np.zeros(k))
        letters.append((n, bool(n) and not can.any()))
    if not any(n for n, _ in letters):
        return "und", 0.0
    value, back = scores[0], []
    for s in scores[1:]:
        top = int(value.argmax())
        stay = value >= value[top] - model.penalty
        back.append(np.where(stay, np.arange(k), top))
        value = np.where(stay, value, value[top] - model.penalty) + s
    path = [int(value.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    total = np.zeros(k)
    for label, (n, strange) in zip(reversed(path), letters, strict=True):
        total[label] += 0 if strange else n
    if not total.sum():
        return model.langs[int(model.prior.argmax())], 0.0
    return model.langs[int(total.argmax())], float(total.max() / total.sum())


def test_languages_equal_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs.where(~language_id.held_out()))
    text = {r["doc_id"]: r["text"] for r in docs.where("length(text) < 4000").collect()}
    text |= {-1: "the 中文 кот because", -2: "中文 日本", -3: "weil das und the of and because être une"}
    frame = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    for r in language_id.predict(frame, model).collect():
        name, score = _plain_language(model, text[r["doc_id"]])
        assert (r["lang_pred"], r["score"]) == (name, pytest.approx(score)), r["doc_id"]


def test_stages_drop_columns_with_clashing_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 as lang_pred", "2 as lang_share", "3 as row_key", "4 as spans", "'x' as component_id", "5 as reach")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == corpus_pipeline.COLUMNS, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name


# -- 6: secrets


def _plain_redacted(text, spans):
    out, at = "", 0
    for start, end in spans:
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def _spans(row):
    return [tuple(map(int, s.split(":")[1:])) for s in row["spans"].split(",") if s]


def test_secrets_of_long_texts(spark):
    random = np.random.default_rng(7)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
    keys = ["".join(letters[random.integers(0, 64, 40)]) for _ in range(2_000)]
    texts = [
        "a-" * 20_000 + "9+9",
        " ".join(f"é token=abc{k:08d}" for k in range(100_000)),
        "x-" * 30_000 + keys[0],
        " ".join(["😀", *keys]),
        "Aa9" * 700_000,
        "password" + " " * 200_000 + "x",
        " ".join("AKIAABCDEFGHIJTOKEN=12345678 " + "0123456789abcdef" * 3 for _ in range(500)),
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = {r["doc_id"]: r for r in secret_scan.scan(frame).collect()}
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redacted(frame).collect()}
    for k, text in enumerate(texts):
        want = _base(text)
        counts = Counter(kind for _, kind, _ in want)
        assert tuple(rows[k][c] for c in ("n_assign", "n_access", "n_hex", "base_sha256")) == (counts[0], counts[1], counts[2], _digest(want)), k
        assert clean[k] == _plain_redacted(text, _spans(rows[k])), k
    assert rows[1]["n_assign"] == 100_000 and len(_spans(rows[3])) >= 1_990 and rows[0]["spans"] == rows[4]["spans"] == ""
    assert _spans(rows[2]) == [(0, len(texts[2]))]


def test_placeholders_suppress_their_part_only(spark):
    key = "kJ8xQ2vT9mZ4pL7w"  # 16 characters
    texts = [f"/sample/data/{key}R1nB6yD3", f"sample{key}R1nB", f"bare {key} key", "EXAMPLE_example_0123456789_dummy", f"token={key} {key}"]
    rows = {r["doc_id"]: r["spans"] for r in secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows == {0: f"entropy:0:{len(texts[0])}", 1: "", 2: "entropy:5:21", 3: "", 4: "assign:0:22,entropy:23:39"}


def test_windows_across_pieces(spark):
    alphabet = secret_scan.CLASSES["hex"][1]
    dull = "ab" * 3_000
    for at in (0, secret_scan.PIECE - 30, secret_scan.PIECE - 12, secret_scan.PIECE, len(dull)):
        text = dull[:at] + "0123456789abcdefABCDEF" + "45" + dull[at:]
        best = max(-sum(c / 24 * math.log2(c / 24) for c in Counter(text[k : k + 24]).values()) for k in range(len(text) - 23))
        frame = spark.createDataFrame([(text,)], "s string")
        least = best - 1e-9
        assert frame.select(secret_scan._strong(frame["s"], alphabet, ((24, least),))).first()[0]
        assert not frame.select(secret_scan._strong(frame["s"], alphabet, ((24, best + 1e-6),))).first()[0]


# -- 7: vectors


@pytest.mark.parametrize("hot", [(0.5, 0.5, 0.5, 0.5), (0.9, 0.1, 0.3, 0.7), (1.0, 0.5, 0.25, 2.0)])
def test_a_query_finds_the_copies_of_its_vector(spark, hot):
    from sheetwright.llm import ann

    x = np.random.default_rng(11).random((120_000, 4))
    x[::250] = hot
    frame = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(120_000)), "embedding": pa.array(list(x), pa.list_(pa.float64()))}))
    rows = ann.search(frame, frame.where("vec_id = 95000"), sample=2048).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in rows] == [(250 * k, 0.0) for k in range(10)]


# -- shared parts


def test_a_hot_key_is_split(spark, monkeypatch):
    from sheetwright.llm import components, skew
    from sheetwright.llm.workspace import Workspace

    monkeypatch.setattr(skew, "SMALL_ROWS", 0)
    rows = spark.createDataFrame([(7 if k % 3 else k, k) for k in range(3000)] + [(None, 5)], "g long, v long")
    groups = spark.createDataFrame([(k, f"n{k}") for k in range(0, 3000, 2)] + [(7, "hot")], "g long, name string")
    got = sorted(tuple(r) for r in skew.attach(rows, groups, "g", "v").collect())
    names = {k: f"n{k}" for k in range(0, 3000, 2)} | {7: "hot"}
    assert got == sorted((g, v, names[g]) for v, g in ((k, 7 if k % 3 else k) for k in range(3000)) if g in names)
    links = [(500, k) for k in range(1, 1500) if k != 500] + [(k + 5000, k + 4000) for k in range(700)]
    roots = components.connected_components(spark.createDataFrame(links, "a long, b long"), Workspace(spark, "test")).collect()
    assert {r["node"]: r["root"] for r in roots} == {**dict.fromkeys(range(1, 1500), 1), **{k + d: k + 4000 for k in range(700) for d in (4000, 5000)}}
