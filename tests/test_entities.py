"""Model output, words and word pieces."""

import json
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from maskwright.functions.labels import ner_type
from maskwright.functions.numbers import share_steps, softmax
from maskwright.functions.wordtrie import PieceTrie
from maskwright.operators import wordpiece as wordpieces
from maskwright.operators.entities import decode_labels, hybrid_detect, merge_bio, ner_gate, words_with_offsets
from maskwright.operators.wordpiece import encode_corpus, wordpiece
from maskwright.plans.catalog import QUERIES
from maskwright.sources.model_files import load_labels, load_vocab

PIECES = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "hello", "un", "##happiness", "john", "smith", "works"]


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame([(p, i) for i, p in enumerate(PIECES)], "piece string, id int")


def docs(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")


def test_softmax(spark):
    cases = [[0.2, 0.4, 0.8], [0.0, 0.0, 10.0, 0.0], [1000.0, 1001.0, 1002.0]]
    df = spark.createDataFrame([(c,) for c in cases], "x array<float>").select(F.expr(softmax("x")).alias("p"))
    for row in df.collect():
        assert abs(sum(row.p) - 1) < 1e-9 and row.p.index(max(row.p)) == 2 and all(map(math.isfinite, row.p))


def test_share_steps(spark):
    df = spark.sql("select 1 v, 3 t union all select 5, 0 union all select 9, 3 union all select 3, 3")
    assert [r.s for r in df.select(F.expr(share_steps("v", "t")).alias("s")).collect()] == [6, 0, 20, 20]


def test_ner_type(spark):
    df = spark.createDataFrame([(t,) for t in ("per", "Person", "gpe", "misc", "date")], "t string")
    assert [r.n for r in df.select(ner_type(F.col("t")).alias("n")).collect()] == [
        "PERSON", "PERSON", "LOC", "MISC", "DATE",
    ]


def test_gate(spark):
    cases = {
        "John works at Acme": True,
        "short x": False,
        "1234 5678 9012 ab": False,
        "abcdefghijklmnop": False,
        "": False,
        "words " * 6000: False,
    }
    df = docs(spark, *cases).orderBy("doc_id")
    assert [r.p for r in df.select(F.expr(ner_gate("text", 32 * 1024)).alias("p")).collect()] == list(cases.values())
    assert df.filter("doc_id = 5").select(F.expr(ner_gate("text", 0)).alias("p")).first().p is True


def test_merge_bio(spark):
    rows = [
        (1, 0, 0, 4, "B-PER", 0.9), (1, 1, 5, 10, "I-PER", 0.7), (1, 2, 14, 18, "B-ORG", 0.8),
        (2, 0, 0, 1, "I-LOC", 0.5), (2, 1, 2, 3, "I-ORG", 0.6), (2, 2, 4, 5, "junk", 0.1), (2, 3, 6, 7, "I-ORG", 0.8),
        (2, 4, 8, 9, "O", 0.9), (2, 5, 10, 11, "I-ORG", 0.4), (2, 6, 12, 13, "B-ORG", 0.3), (2, 7, 14, 15, "X-ORG", 0.3),
    ]
    df = spark.createDataFrame(rows, "doc_id int, tok int, start int, end int, label string, score double")
    got = sorted((r.doc_id, r.type, r.start, r.end, round(r.score, 6)) for r in merge_bio(df).collect())
    assert got == [
        (1, "ORG", 14, 18, 0.8), (1, "PERSON", 0, 10, 0.8),
        (2, "LOC", 0, 1, 0.5), (2, "ORG", 2, 7, 0.7), (2, "ORG", 10, 11, 0.4), (2, "ORG", 12, 13, 0.3),
    ]


def plain_bio(rows):
    """The same by a loop over the tokens of each sequence."""
    found, kept = [], {}
    for doc, tok, start, end, label, score in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if label in ("O", "", None) or label[:2] in ("B-", "I-"):
            kept.setdefault(doc, []).append((start, end, label or "", score))
    for doc, tokens in kept.items():
        now = None
        for start, end, label, score in [*tokens, (0, 0, "O", 0)]:
            kind = label[2:] if label not in ("O", "") else None
            if now and (kind is None or label[0] == "B" or kind != now[0]):
                found.append((doc, now[0], now[1], now[2], round(sum(now[3]) / len(now[3]), 6)))
                now = None
            if kind is not None:
                now = (kind, now[1] if now else start, end, [*(now[3] if now else []), score])
    return sorted(found, key=repr)


def test_sequences_are_merged_across_blocks(spark):
    """Entities that go on over the edges of blocks, whole blocks inside one entity, missing numbers and malformed labels."""
    draw = random.Random(3)
    rows = []
    for doc in [*range(6), None]:
        for tok in range(-5, 120):
            label = draw.choice(["I-A"] * 6 + ["B-A", "I-B", "O", "junk", "", None]) if doc != 5 else "I-A"
            if draw.random() < 0.8:
                rows.append((doc, tok, 10 * tok, 10 * tok + 8, label, draw.randrange(10) / 10))
    df = spark.createDataFrame(rows, "doc_id int, tok long, start long, end long, label string, score double").repartition(4)
    expected = plain_bio(rows)
    for block in (1, 3, 40, 1 << 16):
        got = merge_bio(df, block=block).select("doc_id", "type", "start", "end", F.round("score", 6)).collect()
        assert sorted(map(tuple, got), key=repr) == expected


def test_a_long_sequence_is_spread_over_its_blocks(spark):
    label = F.when(F.col("id") % 1000 < 998, F.lit("I-PER")).otherwise(F.lit("O"))
    long = spark.range(300_000).select(
        F.lit(1).alias("doc_id"), F.col("id").alias("tok"), F.col("id").alias("start"), (F.col("id") + 1).alias("end"), label.alias("label"), F.lit(0.5).alias("score")
    )
    merged = merge_bio(long, block=700)
    plan = merged._jdf.queryExecution().analyzed().toString()
    # the only window over a whole sequence has one row for each block
    assert all("__block" in line for line in plan.splitlines() if line.strip(" +-:").startswith("Window"))
    rows = merged.collect()
    assert len(rows) == 300 and {r.end - r.start for r in rows} == {998}


def test_decode_drops_the_markers_and_takes_the_first_best(spark):
    logits = spark.createDataFrame(
        [(1, 0, [9.0, 0.0]), (1, 1, [1.0, 1.0]), (1, 2, [0.0, 5.0]), (1, 3, [0.0, 9.0])],
        "doc_id int, tok int, logits array<float>",
    )
    labels = spark.createDataFrame([(0, "B-PER")], "id int, label string")
    rows = decode_labels(logits, labels).orderBy("tok").collect()
    assert [(r.tok, r.label) for r in rows] == [(1, "B-PER"), (2, "O")] and rows[0].score == 0.5


def test_words(spark):
    rows = words_with_offsets(docs(spark, "Où est-il? 42", "", None), ["doc_id"]).collect()
    assert [(r.word, r.start, r.end) for r in rows] == [("Où", 0, 2), ("est", 3, 6), ("il", 7, 9), ("42", 11, 13)]


def test_words_of_a_text_are_not_sorted(spark, tmp_path):
    texts = ["Où est-il? 42", "", None, "one", "a b. c a", "-"]
    df = spark.createDataFrame([*enumerate(texts), (4, "z y")], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["words"](spark, str(tmp_path))
    rows = {r.doc_id: tuple(r)[1:] for r in found.collect()}
    assert rows == {0: (4, 0 + 6 + 21 + 44, 2 + 12 + 27 + 52, 3, "42"), 3: (1, 0, 3, 3, "one"), 4: (6, 51, 64, 1, "a")}
    # words are added up by hash; what is sorted has at most two rows for each text
    plan = found._jdf.queryExecution().executedPlan().toString()
    first = plan[: plan.index("Generate")].split("Exchange")[-1]
    assert "HashAggregate" in first and "Sort" not in first


def test_wordpiece(spark, vocab):
    words = ["hello", "Hello", "unhappiness", "unsmith", "zzz", "x" * 101]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r.word: r.pieces for r in wordpiece(df, vocab).collect()}
    assert got == {"hello": [4], "Hello": [4], "unhappiness": [5, 6], "unsmith": [1], "zzz": [1], "x" * 101: [1]}
    cased = {r.word: r.pieces for r in wordpiece(df, vocab, lowercase=False).collect()}
    assert cased["Hello"] == [1]


def test_encoding(spark, vocab):
    rows = encode_corpus(docs(spark, "John unhappiness", "", "hello " * 600), vocab).orderBy("doc_id").collect()
    assert rows[0].input_ids == [2, 7, 5, 6, 3] and rows[0].word_index == [-1, 0, 1, 1, -1]
    assert rows[0].attention_mask == [1] * 5 and rows[0].token_type_ids == [0] * 5
    assert rows[1].input_ids == [2, 3]
    assert len(rows[2].input_ids) == 602 and rows[2].input_ids[-1] == 3
    cut = encode_corpus(docs(spark, "hello " * 600), vocab, max_sequence=512).first()
    assert len(cut.input_ids) == 512 and cut.input_ids[-1] == 3


def test_model_files(spark, tmp_path):
    (tmp_path / "labels.json").write_text('{"0": "O",\n "1": "B-PER"}')
    assert sorted(map(tuple, load_labels(spark, str(tmp_path / "labels.json")).collect())) == [(0, "O"), (1, "B-PER")]
    (tmp_path / "bad.json").write_text('{"x": "O"}')
    with pytest.raises(Exception, match="invalid label key x"):
        load_labels(spark, str(tmp_path / "bad.json")).collect()
    pieces = {p: i for i, p in enumerate(PIECES)}
    (tmp_path / "tok.json").write_text(json.dumps({"model": {"vocab": pieces}, "other": 1}))
    table, lower = load_vocab(spark, str(tmp_path / "tok.json"))
    assert lower is True and {r.piece: r.id for r in table.collect()} == pieces
    del pieces["[SEP]"]
    (tmp_path / "cased.json").write_text(json.dumps({"model": {"vocab": pieces}, "normalizer": {"lowercase": False}}))
    with pytest.raises(ValueError, match=r"\[SEP\]"):
        load_vocab(spark, str(tmp_path / "cased.json"))


def test_hybrid_masks_entities_and_mail(spark):
    text = "My name is John Smith and I work at Microsoft in New York, john@x.com"
    df = docs(spark, text, "1234", "Just a few words here")
    found = spark.createDataFrame(
        [
            (0, "PERSON", 11, 21, 0.9), (0, "ORG", 36, 45, 0.9), (0, "LOC", 49, 57, 0.9),
            (0, "PERSON", 59, 63, 0.99), (0, "MISC", 0, 2, 0.3), (1, "PERSON", 0, 4, 0.9),
        ],
        "doc_id long, type string, start int, end int, score double",
    )
    rows = hybrid_detect(df, found, "doc_id").orderBy("doc_id").collect()
    assert [(s.type, s.value, s.source) for s in rows[0].spans] == [
        ("PERSON", "John Smith", "onnx-ner"), ("ORG", "Microsoft", "onnx-ner"), ("LOC", "New York", "onnx-ner"),
        ("email", "john@x.com", "regex"),
    ]
    assert rows[1].spans == [] and rows[2].spans == []


def plain_cut(word, pieces):
    """The longest known piece each time, by trying all lengths."""
    at, ids = 0, []
    while at < len(word):
        marked = ["##" * (at > 0) + word[at:end] for end in range(len(word), at, -1)]
        best = next((m for m in marked if m in pieces), None)
        if best is None:
            return None
        ids.append(pieces[best])
        at += len(best) - 2 * (at > 0)
    return ids or None


def test_trie_against_all_lengths():
    draw = random.Random(2)
    for _ in range(60):
        pieces = {}
        while len(pieces) < draw.randrange(2, 40):
            piece = "".join(draw.choice("abé#") for _ in range(draw.randrange(1, 6)))
            pieces[draw.choice(["", "##"]) + piece] = len(pieces) + 1
        trie = PieceTrie(pieces)
        for _ in range(150):
            word = "".join(draw.choice("abé#x" if draw.random() < 0.1 else "abé") for _ in range(draw.randrange(12)))
            assert trie.cut(word) == plain_cut(word, pieces), (word, pieces)


def test_a_word_of_a_megabyte_costs_in_proportion(spark):
    names = ["[UNK]", "[CLS]", "[SEP]", "a", "##a", "##" + "a" * 50 + "b"]
    vocab = spark.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "piece string, id int")
    for tail, size, last in (("", 1_000_000, 5), ("b", 999_951, 6), ("x", 1, 1)):
        start = time.perf_counter()
        (row,) = wordpiece(spark.createDataFrame([("a" * 1_000_000 + tail,)], "word string"), vocab).collect()
        assert time.perf_counter() - start < 30
        assert len(row.pieces) == size and row.pieces[-1] == last


def test_joined_vocabulary_gives_the_same(spark, vocab, monkeypatch):
    texts = ["John unhappiness", "", None, "hello works smithjohn é un" + "happiness" * 3, "hello " * 50, "John unhappiness"]
    df = docs(spark, *texts)
    words = spark.createDataFrame([(w,) for w in ("John", "john", "unhappiness", "x", "", None, "un" * 60)], "word string")
    columns = ["doc_id", "input_ids", "word_index", "attention_mask", "token_type_ids"]
    runs = []
    for bound in (500_000, 0):
        monkeypatch.setattr(wordpieces, "MAX_BROADCAST_PIECES", bound)
        encoded = encode_corpus(df, vocab)
        if bound:
            assert "Exchange" not in encoded._jdf.queryExecution().executedPlan().toString()
        rows = [sorted(map(tuple, encode_corpus(df, vocab, max_sequence=n).select(columns).collect()), key=repr) for n in (None, 5)]
        cut = [sorted(map(tuple, wordpiece(words, vocab, max_length=n).collect()), key=repr) for n in (None, 100)]
        runs.append((rows, cut, sorted(map(tuple, encoded.select(columns).collect()), key=repr)))
    assert runs[0] == runs[1]
    assert len(runs[0][2]) == len(texts)
