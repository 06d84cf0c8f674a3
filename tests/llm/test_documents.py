"""Operators on documents against plain versions, with NULLs, empty and long texts, ties and repeated rows."""

import random
import time

import public_tokenizers
import numpy as np
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from maskwright.llm import byte_bpe, decontamination, near_duplicates, personal_data, repeated_text, token_counts
from tests.llm import brute

BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def frame(spark, texts, **extra):
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)


@pytest.fixture(scope="module")
def odd_texts():
    draw = random.Random(4)
    words = ["".join(draw.choice("abcdefgh é1A") for _ in range(5)) for _ in range(200)]
    base = [" ".join(draw.choice(words) for _ in range(n)) for n in (3, 40, 90, 160)]
    texts = [None, "", " \n", "one two", "One  two", *base, base[1], base[2] + " end", base[3].replace(words[0], "zz")]
    for _ in range(30):
        changed = draw.choice(base).split(" ")
        for _ in range(draw.randrange(4)):
            changed[draw.randrange(len(changed))] = "q"
        texts.append(" ".join(changed))
    return texts + ["a" * 5000, "ab " * 3000, "x\x00y\x1c z"]


def test_near_duplicates(spark, odd_texts):
    expected = brute.near_duplicates(list(enumerate(odd_texts)))
    got = near_duplicates.near_duplicates(frame(spark, odd_texts)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == expected


def test_near_duplicates_of_rows_without_ids_and_of_nothing(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (3, "a b c"), (3, "a b c")], "doc_id long, text string")
    rows = near_duplicates.near_duplicates(df).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == [(0, 0, True)] * 2 + [(3, 3, True)] * 2
    assert near_duplicates.near_duplicates(df.limit(0)).count() == 0


def test_open_components_are_compared_in_blocks(spark, monkeypatch):
    """A group that shares buckets but not one component, dealt out over several shares."""
    draw = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(60):
        own = list(base)
        for _ in range(draw.randrange(6)):
            own[draw.randrange(120)] = f"n{draw.randrange(10_000)}"
        texts.append(" ".join(own))
    monkeypatch.setattr(near_duplicates, "TOGETHER", 16)
    got = near_duplicates.near_duplicates(frame(spark, texts)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute.near_duplicates(list(enumerate(texts)))


@pytest.mark.parametrize("together", [1000, 1])
@pytest.mark.parametrize("length", [400, 64])
def test_repeated_text(spark, together, length):
    draw = random.Random(length)
    base = ["".join(draw.choice("abcé \n") for _ in range(900)) for _ in range(4)]
    texts = [None, "", "short", "a" * 900, "ab" * 500]
    for _ in range(25):
        own = draw.choice(base)
        at = draw.randrange(400)
        texts.append(own[at : at + draw.randrange(100, 500)] + str(draw.random()) + draw.choice(base)[: draw.randrange(500)])
    texts += [texts[7], texts[7]]
    found = repeated_text.remove_repeats(frame(spark, texts), ["doc_id"], length=length, together=together).collect()
    got = {r.doc_id: (r.n_bytes, len(r.begins), bytes(r.kept)) for r in found}
    assert got == dict(enumerate(brute.repeats(texts, length)))


@pytest.mark.parametrize("together", [1000, 4])
def test_planted_passages(spark, together):
    """Passages just below, at and above the length, in many documents and in two; every planted byte that counts is found."""
    draw = random.Random(together)

    def noise(n):
        return "".join(draw.choice("abcdefghij klm\n") for _ in range(n))

    passages = {n: noise(n) for n in (399, 400, 401, 520, 1200)}
    texts, planted = [], []
    for n, passage in passages.items():
        for i in range(40 if n > 400 else 6):
            # the byte before a passage differs, so that it doesn't make the short one longer
            before = noise(draw.randrange(60)) + "ABCDEF"[i % 6]
            # half of them have the same few bytes around the passage, so that phrases agree to different depths
            edge = "" if n < 400 else draw.choice(["", "same edge ", "the same edge "])
            texts.append(before + edge + passage + edge[::-1] + "UVWXYZ"[i % 6] + noise(draw.randrange(60)))
            planted.append((n, before + edge, passage))
    found = repeated_text.remove_repeats(frame(spark, texts), ["doc_id"], together=together).collect()
    got = {r.doc_id: (r.n_bytes, len(r.begins), bytes(r.kept)) for r in found}
    assert got == dict(enumerate(brute.repeats(texts, 400)))
    for r in found:
        n, before, passage = planted[r.doc_id]
        assert (passage.encode() in bytes(r.kept)) == (n < 400)
        if n >= 400:
            assert any(a <= len(before) and b >= len(before) + n for a, b in zip(r.begins, r.ends, strict=True))


def test_benchmark_items(spark, odd_texts):
    items = [(1, odd_texts[6]), (2, "ONE two"), (3, ""), (4, None), (5, odd_texts[7]), (6, odd_texts[7])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = brute.items_found(list(enumerate(odd_texts)), items)
    for block_bytes in (10**6, 300):
        found = decontamination.find_items(frame(spark, odd_texts), bench, ["doc_id"], block_bytes=block_bytes).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in found} == expected
        assert all(set(r["items"]) <= set(r.near_items) for r in found)
    none = decontamination.find_items(frame(spark, odd_texts), bench.limit(0), ["doc_id"]).collect()
    assert all(r.n_hit == 0 for r in none)


def test_terms_that_are_only_near(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    df = frame(spark, ["alpha x beta y gamma", "alpha " + "x " * 60 + "beta gamma"])
    found = {r.doc_id: list(r.near_items) for r in decontamination.find_items(df, bench, ["doc_id"]).collect()}
    assert found == {0: ["1"], 1: []}


def test_personal_data_counts_by_kind(spark):
    texts = ["a@b.de, c@d.de and e@f.de", "+49 30 1234567 from 10.0.0.1", "4111 1111 1111 1111 x@y.de 1.2.3.4 5.6.7.8", "", None]
    rows = personal_data.summarise(personal_data.find_spans(frame(spark, texts), ["doc_id"]), ["doc_id"]).collect()
    counts = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in rows}
    assert counts == {0: (3, 0, 0, 0), 1: (0, 1, 0, 1), 2: (1, 2, 1, 0), 3: (0, 0, 0, 0), 4: (0, 0, 0, 0)}


def test_personal_data(spark):
    draw = random.Random(5)
    texts = [None, "", "4111 1111 1111 1111 x", "1" * 20_000, "1 " * 10_000, "a@b" + ".c" * 9000, "a" * 20_000 + "@"]
    texts += ["".join(draw.choice("a.@-+1203 ()b%_é😀\n") for _ in range(draw.randrange(5, 70))) for _ in range(800)]
    df = frame(spark, texts)
    rows = personal_data.summarise(personal_data.find_spans(df, ["doc_id"]), ["doc_id"]).collect()
    assert {r.doc_id: r.base_sha256 for r in rows} == {i: brute.sha(brute.personal_data(t)) for i, t in enumerate(texts)}


def test_contexts_of_seeds_find_more(spark):
    texts = [f"Here. my handle: q{i}@m{i}.org and so on" for i in range(20)]
    texts += [f"words handle: bob{i}@localhost end" for i in range(5)] + ["ask bob9@localhost first", "at 12345678 sharp"]
    df = frame(spark, texts)
    rows = personal_data.summarise(personal_data.find_spans(df, ["doc_id"]), ["doc_id"]).collect()
    spans = {r.doc_id: r.spans for r in rows}
    assert all(spans[i] == "email:14:28" for i in range(20, 25)) and spans[25] == spans[26] == ""


def test_neighbouring_identifiers_are_all_seen(spark):
    texts = [f"phone +4930 1234 {i:04} now" for i in range(20)] + ["phone 030-1111-2222 030-3333-4444 end"]
    texts += [f"so a{i}@x.org b{i}@y.org end" for i in range(20)] + ["ask c@z.org bob1@localhost end"]
    texts += [f"see tel2 +4930 4321 {i:04} now" for i in range(20)] + ["see tel2 030-5555-6666 now"]
    rows = personal_data.summarise(personal_data.find_spans(frame(spark, texts), ["doc_id"]), ["doc_id"]).collect()
    spans = {r.doc_id: r.spans for r in rows}
    assert spans[20] == "phone:6:19,phone:20:33" and spans[41] == "email:4:11,email:12:26" and spans[62] == "phone:9:22"


def test_words_before_tokens_whatever_stands_between(spark):
    texts = ["(see) [x] call(ed)\n\t 7x1", "AB(at)bcd x 12", "  \x0b9a", "12 (34 [56] İs\x85it 7", "a((b [ 5(at", "a[b(at", "a " * 3000 + "(b 1", None]
    sql = f"transform({personal_data._instances('text')}, t -> concat_ws('|', t.start, t.context, t.value))"
    seen = {r.doc_id: r.seen for r in frame(spark, texts).select("doc_id", F.expr(sql).alias("seen")).collect()}
    assert [seen[i] for i in range(8)] == [
        ["21|call(ed)|7x1"], ["0||AB(at)bcd", "12|x|12"], ["3||9a"], ["0||12", "4|12|34", "8|(34|56", "18|i̇s\x85it|7"],
        ["7|[|5(at"], [], ["6003|(b|1"], [],
    ]


def test_words_that_are_no_tokens_cost_little(spark):
    """Beside counting the words: a pattern that tries each place, and looks at each word several times, takes ten times as long."""
    df = frame(spark, ["plain words (some in brackets) that hold no digit and no sign, so that none of them is a token\n" * 3000] * 24).cache()

    def seconds(sql):
        taken = []
        for _ in range(4):
            start = time.perf_counter()
            assert df.agg(F.sum(F.expr(sql))).first()[0] is not None
            taken.append(time.perf_counter() - start)
        return min(taken)

    counted, searched = seconds(r"size(regexp_extract_all(text, '\\S+', 0))"), seconds(f"size({personal_data._instances('text')})")
    df.unpersist()
    print(f"counted {counted:.2f} s, searched {searched:.2f} s")
    assert searched < 6 * counted


def test_forms_of_unseen_identifiers(spark):
    texts = [f"phone +4930 1234 {i:04} now" for i in range(20)] + [f"write q{i}@m.org now" for i in range(20)]
    texts += [f"card {n} x" for n in range(5500000000000000, 5500000000000200) if brute.luhn(str(n))]
    forms = [
        ("phone 030-1234-9999, or", "phone:6:19"), ("phone 030-1234-9998.", "phone:6:19"), ("phone 030-1234-9999", "phone:6:19"),
        ("phone (030)1234-9997).", "phone:6:20"), ("phone (030-1234-9996)", "phone:7:20"), ("phone 030 1234 9995.", "phone:6:19"),
        ("phone (030) 1234-9994, x", "phone:6:21"), ("phone 123456789012.", "phone:6:18"), ("030-1234-9998", "phone:0:13"),
        ("write john(at)example.com.", "email:6:25"), ("write bob@localhost, x", "email:6:19"), ("write (al[at]host)", "email:7:17"),
        ("card 4111-1111-1111-1112.", "card:5:24"), ("card 4111 1111 1111 1113, x", "card:5:24"), ("card 4111111111111114", "card:5:21"),
        ("é😀 phone 030 1234 9993; x", "phone:9:22"), ("at 030 1234 9993, 12 34", "phone:3:16"), ("phone @home", ""),
    ]
    df = frame(spark, texts + [t for t, _ in forms])
    rows = personal_data.summarise(personal_data.find_spans(df, ["doc_id"]), ["doc_id"]).collect()
    spans = {r.doc_id: r.spans for r in rows}
    assert [(t, spans[len(texts) + i]) for i, (t, _) in enumerate(forms)] == forms


def test_contexts_that_support_each_other_in_a_chain(spark):
    texts = [f"alpha +4930 1234 {i:04} now" for i in range(324)]
    unseen = [[f"030-{k}000-{i:04}" for i in range(n)] for k, n in enumerate((108, 36, 12, 4), 1)]
    for word, values in zip(("alpha", "beta", "gamma", "delta"), unseen):
        texts += [f"{word} {v} now" for v in values]
    for word, values in zip(("beta", "gamma", "delta"), unseen):
        texts += [f"{word} {v} now" for v in values]
    rows = personal_data.find_spans(frame(spark, texts), ["doc_id"]).collect()
    assert all(len(r.spans) == 1 for r in rows)


def test_certainties_that_do_not_settle_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(personal_data, "MAX_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        personal_data.find_spans(frame(spark, [f"dial +4930 1234 {i:04} now" for i in range(5)]), ["doc_id"])


def test_copies_of_one_text_beyond_a_share_get_the_same_added_spans(spark):
    seeds = [f"dial +4930 1234 {i:04} now" for i in range(40)]
    texts = [*seeds, *["dial 030-1234-9999 now"] * 1500, *[None] * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = personal_data.summarise(personal_data.find_spans(df, ["doc_id"]), ["doc_id"])
    rows = {r.doc_id: r.spans for r in found.collect()}
    assert len(rows) == len(texts)
    assert {rows[i] for i in range(40, 1540)} == {"phone:5:18"}
    assert {rows[i] for i in range(1540, 1543)} == {""}


@pytest.mark.parametrize("bound", [None, 300])
def test_tokens_and_back(spark, odd_texts, monkeypatch, bound):
    if bound:
        monkeypatch.setattr(byte_bpe, "TOGETHER", bound)
        monkeypatch.setattr(byte_bpe, "SLICE_BYTES", bound)
    draw = random.Random(3)
    texts = odd_texts + ["".join(draw.choice("ab  \n\t\r1'sd²Ⅷ\x1c\x85 　.!😀'll") for _ in range(40)) for _ in range(500)]
    texts += ["a" * 30_000, "ab" * 20_000, " " * 500, "x " + " " * 30 + "\n", "abababab aaaaaaa ababa", "the " * 9]
    bpe = byte_bpe.loaded(BPE, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    got = {r.doc_id: r for r in byte_bpe.token_digests(frame(spark, texts), BPE, public_tokenizers.PATTERN).collect()}
    for i, text in enumerate(texts):
        ids = library.encode_ordinary(text or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), brute.sha(",".join(map(str, ids)))), text
        assert got[i].decoded_sha256 == brute.sha(text or "")
    back = byte_bpe.encode_texts(frame(spark, texts), BPE, public_tokenizers.PATTERN).collect()
    assert {r.doc_id: r.ids for r in back} == {i: library.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert all(r.decoded.decode() == (r.text or "") and r.text == texts[r.doc_id] for r in back)
    empty = frame(spark, ["a"]).limit(0)
    assert byte_bpe.encode_texts(empty, BPE, public_tokenizers.PATTERN).count() == 0
    assert byte_bpe.token_digests(empty, BPE, public_tokenizers.PATTERN).count() == 0


def test_pre_tokens_merged_together():
    """The joint queue against the library on random pre-tokens, and memory that forgets."""
    draw = random.Random(8)
    bpe = byte_bpe.ByteBPE.from_file(BPE, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    pieces = ["".join(draw.choice("abéthein") for _ in range(draw.randrange(1, 25))) for _ in range(3000)]
    pieces += ["".join(draw.choice("ab") for _ in range(draw.randrange(1, 40))) for _ in range(500)]
    made = bpe.encode_short([p.encode() for p in pieces])
    assert [np.frombuffer(m, "<i4").tolist() for m in made] == [library.encode_ordinary(p) for p in pieces]
    bpe.pieces = byte_bpe.Memo(2000)
    texts = [" ".join(draw.choices(pieces, k=30)) for _ in range(60)] * 2
    got = [r for i in range(0, 120, 7) for r in bpe.digests(texts[i : i + 7])]
    expected = [library.encode_ordinary(t) for t in texts]
    assert [(n, ids) for n, ids, _ in got] == [(len(e), brute.sha(",".join(map(str, e)))) for e in expected]
    assert all(d == brute.sha(t) for (_, _, d), t in zip(got, texts, strict=True))
    assert len(bpe.pieces.new) < 30 and len(bpe.pieces.old) < 30


def test_counts_of_spliced_chunks(spark, odd_texts):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = odd_texts + ["word" * 2000 + " x y " + "é" * 3000 + "  a" * 600, "▁ ▁x " * 500]
    found = token_counts.count_tokens(frame(spark, texts), PIECES, 100, chunk=150, overlap=8).collect()
    for r in found:
        text = texts[r.doc_id] or ""
        n = len(model.encode(text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 100)
    assert token_counts.count_tokens(frame(spark, ["a"]).limit(0), PIECES, 100).count() == 0


def test_documents_of_the_table_are_spliced(spark):
    """With the chunk as it is, and ten times as many of them with a small one; both as the library counts."""
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    long = [(r.doc_id, r.text) for r in rows if r.text and len(r.text) > 3000]
    df = spark.createDataFrame(long, "doc_id long, text string").repartition(4)
    expected = {i: len(model.encode(t)) for i, t in long}
    for chunk, least in ((token_counts.CHUNK, 5), (512, 500)):
        found = token_counts.count_tokens(df, PIECES, 4096, chunk=chunk).collect()
        assert {r.doc_id: r.n_tokens for r in found} == expected
        assert sum(r.n_splices for r in found) >= least
