"""The whole pipeline against a plain version on a small table."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from test_llm_documents import LOWER, SF, WORD, _base, _brute_classes, _brute_leaks
from tokenizers import Tokenizer

import corpus_pipeline
from sheetwright.llm import language_id


def _redacted(text):
    out, at = "", 0
    for start, _, end in _base(text):
        if start < at:
            at = max(at, end)
            continue
        out, at = out + text[at:start] + "[SECRET]", end
    return out + text[at:]


def test_pipeline_equals_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = language_id.fit(docs.where(~language_id.held_out()))  # the model is trained; what follows is not
    judged = language_id.predict(docs, model).collect()
    kept = {r["doc_id"]: text[r["doc_id"]] for r in judged if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_SHARE}
    kept = {d: kept[d] for d, (_, root) in _brute_classes(list(kept.items())).items() if d == root}

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = set()
    for d, t in kept.items():
        own = Counter(WORD.findall(t.translate(LOWER)))
        for i, item in items:
            wanted = Counter(WORD.findall(item.translate(LOWER)))
            n = sum(wanted.values())
            if sum((own & wanted).values()) >= n - int(0.2 * n + 1e-9) and _brute_leaks([(d, t)], [(i, item)]):
                leaks.add(d)
                break
    assert leaks
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for d in set(kept) - leaks:
        clean = _redacted(kept[d])
        ids = np.array(plain.encode(clean, add_special_tokens=False).ids + [2], dtype="<u4")
        want[d] = [(k, zlib.crc32(ids[k : k + 4096].tobytes()), len(ids)) for k in range(0, len(ids), 4096)]
        assert not re.search("AKIA[A-Z0-9]{12}", clean)
    got: dict = {}
    for r in corpus_pipeline.run(spark, SF).orderBy("doc_id", "start").collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["ids_crc32"], r["doc_tokens"]))
    assert got == want


def test_letters_of_unlearned_scripts_count(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = docs.where("lang = 'en' and length(text) > 300").first()["text"][:200]
    odd = [(900_001, "\u4e2d\u6587 " * 5000 + "because"), (900_002, text + " \u4e2d\u6587"), (900_003, "\u4e2d\u6587 " * 5000)]
    both = docs.unionByName(spark.createDataFrame([(k, t, None, "x", len(t)) for k, t in odd], docs.schema))
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, both, SF).where("doc_id > 900000").collect()}
    assert kept == {900_002}


def test_null_and_repeated_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    words = [" ".join(f"{letter}{k}" for k in range(200)) for letter in "abcde"]

    def stage(name, rows):
        given = spark.createDataFrame([(d, t, "en", "x", 1) for d, t in rows], docs.schema)
        return sorted(((r["doc_id"], r["text"]) for r in dict(corpus_pipeline.STAGES)[name](spark, given, SF).collect()), key=repr)

    near = words[0] + " more"
    rows = [(None, words[0]), (None, near), (None, words[1]), (9, words[1]), (8, words[1] + " more"), (5, words[2]), (5, words[2]), (5, words[3]), (6, words[4]), (6, words[4] + " more"), (7, " "), (7, " ")]
    got = stage("near_duplicates", rows)
    assert got in [sorted([(None, a), (8, words[1] + " more"), (5, words[2]), (5, words[3]), (6, b), (7, " "), (7, " ")], key=repr) for a in (words[0], near) for b in (words[4], words[4] + " more")]

    rows = [(None, f"so {passage} it"), (None, words[0]), (4, f"so {passage} it"), (4, words[1]), (4, words[1])]
    assert stage("benchmark_leaks", rows) == sorted([(None, words[0]), (4, words[1]), (4, words[1])], key=repr)
