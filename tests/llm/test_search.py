"""Spelling variants, ranked search and archives against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from maskwright.llm import ranked_search, spelling_variants, warc
from maskwright.llm.common import table
from maskwright.session import scratch_dir
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


def plain_variants(words, least, factor):
    words = {w: n for w, n in words.items() if n >= least}
    letters = sorted(set("".join(words)))
    known = {}
    for u, n in words.items():
        others = {u[:i] + c + u[i + k :] for i in range(len(u) + 1) for k in (0, 1) for c in ["", *letters]}
        near = [v for v in others if v != u and v in words]
        form = min(near, key=lambda v: (-words[v], v), default=None)
        known[u] = (len(near), form if form and words[form] >= factor * n else None)
    out = {}
    for u, (near, form) in known.items():
        root = u
        while known[root][1]:
            root = known[root][1]
        out[u] = (form, root, words[u], near, words[form] if form else None)
    return out


def variant_rows(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize(("shard", "group"), [(1 << 20, 100_000), (200, 6)])
def test_variants(spark, shard, group):
    draw, words = random.Random(5), {}
    for i in range(400):
        words["".join(draw.choice("abé") for _ in range(draw.randrange(1, 8)))] = 5**draw.randrange(1, 7) + i
        words["".join(draw.choice("ab") for _ in range(draw.randrange(1, 4))) * draw.randrange(2, 30)] = draw.randrange(1, 400)
        words["same" + "".join(draw.choice("abcdefgh") for _ in range(4))] = draw.randrange(1, 400)
    words.update({"q" * k: 2 * 5**k for k in range(2, 12)})
    df = spark.createDataFrame([(w, n, "x") for w, n in words.items()], "word string, n long, form string")
    got = variant_rows(spelling_variants.group_variants(df, shard=shard, group=group))
    expected = plain_variants(words, 5, 5)
    assert got == expected
    assert sum(1 for v in expected.values() if v[1] != v[0] and v[0]) > 5  # chains


def test_variants_of_texts(spark):
    docs = table(spark, SMALL, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows += [(None, "Straßen straßen STRASSEN"), (None, None), (7, ""), (rows[0][0], rows[0][1]), (8, "ABCDEÉ abcdeé×÷ Āabcdefg")]
    words = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", brute.lower(text)):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            words[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in words.items() if len(w) >= 6}
    df = spark.createDataFrame([(t, d, 1) for d, t in rows], "text string, doc_id long, n int").repartition(3)
    counted = spelling_variants.count_words(df)
    assert {r.word: r.n for r in counted.collect()} == words
    assert variant_rows(spelling_variants.group_variants(counted)) == plain_variants(words, 5, 5)
    none = spelling_variants.group_variants(spelling_variants.count_words(df.limit(0)))
    assert none.columns == ["word", "form", "root", "n", "n_near", "form_n"] and none.count() == 0


def plain_ranks(docs, items, k):
    find = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall
    held = [(d, Counter(find(brute.lower(t)))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            m = 25 + 75 * c.total() * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in find(brute.lower(text))
                if t in c
            )
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return Counter(out)


def test_ranked_search(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    docs += [docs[0], docs[1], (None, docs[2][1]), (None, docs[2][1]), (900, None), (901, ""), (902, "!?"), (903, "Élan élan ÉLAN x2")]
    items += [items[0], (None, "the the the and"), (777, None), (778, "zzzznever"), (779, "élan X2 Élan"), (780, "the the of the and de la")]
    d = spark.createDataFrame([(t, 5, i) for i, t in docs], "text string, score int, doc_id long").repartition(3)
    q = spark.createDataFrame([(t, i, "z") for i, t in items], "text string, item_id long, key string")
    expected = plain_ranks(docs, items, 10)
    for size in (ranked_search.BLOCK_BYTES, 1000):
        got = ranked_search.rank_documents(d, q, block_bytes=size)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert Counter(tuple(r) for r in got.collect()) == expected
    graph = ranked_search.QueryGraph([ranked_search.terms(t) for _, t in items])
    assert graph.sums and graph.n_base < len(graph.vocabulary)
    assert ranked_search.rank_documents(d.limit(0), q).count() == 0
    assert ranked_search.rank_documents(d, q.limit(0)).count() == 0
    assert ranked_search.rank_documents(d.filter("doc_id in (900, 901)"), q).count() == 0


INNER = (
    "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
)


def archived(spark, path, **options):
    found = warc.read_archive(spark, path, **options)
    return found.withColumn("page_id", warc.record_key("id")).withColumn("refers_to", warc.record_key("refers")).collect()


@pytest.mark.parametrize(("groups", "split"), [(200_000, "128m"), (0, "12000")])
def test_archives(spark, monkeypatch, groups, split):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", groups)
    draw, rows = random.Random(3), []
    for i in range(240):
        html = (
            INNER * draw.randrange(1, 6),
            "WARC/1." * draw.randrange(1, 9) + "WARC/",
            None,
            "copy " * 40 + str(draw.randrange(3)),
            "x" * draw.randrange(3000),
            INNER + "y" * 50 + INNER[: draw.randrange(len(INNER))],
            "short",
            "é\r\n\r\nü" * draw.randrange(300),
        )[draw.randrange(8)]
        rows.append((i if i % 50 else None, f"http://x/{i}\nq" if i % 7 else None, html, "extra"))
    rows += [rows[3], (1000, "u", "only one without a key" * 9, ""), (None, "u", "no key at all" * 9, ""), (None, "u", "no key at all" * 9, "")]
    first = {}
    for key, _, html, _ in rows:
        if key is not None and html and len(html.encode()) >= 100:
            first[html] = min(first.get(html, key), key)
    expected = Counter()
    for key, _, html, _ in rows:
        body, other = (html or "").encode(), first.get(html)
        again = other is not None and other != key
        expected[key, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", other if again else None] += 1
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(2)
    path = scratch_dir(spark, "test-warc")
    warc.write_archive(df, path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        for payload in (False, True):
            got = archived(spark, path, payload=payload)
            assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.kind, r.refers_to) for r in got) == expected
            assert all(r.whole for r in got)
        assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in got if r.kind == "response")
        assert all(r.payload == b"" for r in got if r.kind == "revisit")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_damaged_archives(spark):
    path = scratch_dir(spark, "test-warc")
    long = INNER.replace("Content-Length: 5", "Content-Length: 50")
    texts = [INNER * 3, INNER + "junk" + INNER, "junk" + INNER, INNER + long, INNER.replace("1.1", "1.0"), "", "WARC/1.1\r\n\r\n"]
    for i, text in enumerate(texts):
        one = spark.createDataFrame([(text[:-4] if text.endswith("\r\n\r\n") else text,)], "value string").coalesce(1)
        one.write.option("lineSep", "\r\n\r\n").text(f"{path}/{i}")
    found = Counter()
    for r in archived(spark, path):
        found[re.search(r"/(\d)/[^/]*$", r.path)[1], r.whole, r.payload_bytes, r.page_id] += 1
    whole = {("0", True, 5, 666): 3, ("1", True, 5, 666): 1, ("3", True, 5, 666): 1, ("4", True, 5, 666): 1}
    assert found == Counter({**whole, ("3", False, None, 666): 1})
    empty = scratch_dir(spark, "test-warc")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read_archive(spark, empty).count() == 0
