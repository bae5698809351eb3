import random
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import contamination, spans
from millrace.llm.fmindex import FMIndex, Minima, common_prefixes, suffix_array
from millrace.session import load

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def brute_spans(docs: dict[int, str | None], length: int) -> set[tuple[int, int, int]]:
    owners = defaultdict(set)
    for d, t in docs.items():
        for i in range(len(t or "") - length + 1):
            owners[t[i : i + length]].add(d)
    out = set()
    for d, t in docs.items():
        a = b = None
        for i in range(len(t or "") - length + 1):
            if len(owners[t[i : i + length]]) > 1:
                if a is not None and i <= b:
                    b = i + length
                else:
                    if a is not None:
                        out.add((d, a, b))
                    a, b = i, i + length
        if a is not None:
            out.add((d, a, b))
    return out


def brute_leaks(docs: dict[int, str | None], items: dict[int, str | None]) -> set[tuple[int, int]]:
    def words(t):
        t = unicodedata.normalize("NFKD", re.sub("<[^>]*>", " ", t))
        t = "".join(c for c in t if unicodedata.category(c) not in ("Mn", "Cf")).lower()
        return re.findall(r"[^\W_]+", t)

    grams = defaultdict(set)
    for k, t in items.items():
        w = words(t or "")
        for i in range(len(w) - 11):
            grams[tuple(w[i : i + 12])].add(k)
    return {(d, k) for d, t in docs.items() for w in [words(t or "")] for i in range(len(w) - 11) for k in grams.get(tuple(w[i : i + 12]), ())}


def rows(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("sigma,size,seed", [(1, 40, 0), (2, 300, 1), (4, 500, 2), (30, 200, 3)])
def test_suffix_array(sigma, size, seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(1, sigma + 1, size)
    plain = [tuple(text[i:]) for i in range(size)]
    for enough in (1, 9, 1000):
        order, levels = suffix_array(text, sigma + 1, enough)
        heads = [p[:enough] for p in plain]
        assert [heads[i] for i in order] == sorted(heads) and sorted(order) == list(range(size))
        for depth, rank in levels:
            assert all((rank[i] == rank[j]) == (plain[i][:depth] == plain[j][:depth]) for i in range(0, size, 7) for j in range(0, size, 5))
        common = common_prefixes(text, order, levels, enough)
        for r in range(1, size):
            a, b = heads[order[r - 1]], heads[order[r]]
            assert common[r] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("sigma,seed", [(1, 0), (2, 1), (3, 5), (4, 2), (30, 3)])
def test_matching_statistics(sigma, seed):
    rng = np.random.default_rng(seed)
    texts = [rng.integers(97, 97 + sigma, rng.integers(0, 60)).astype(np.uint32) for _ in range(40)]
    texts[7:9] = [texts[6][3:], texts[6]]
    low = rng.integers(0, 12, 40)
    high = np.where(rng.random(40) < 0.1, low + 1, low)
    for most in (1, 4, 9, 70):
        found = FMIndex(texts, low, high, most).matching_statistics(texts)
        for k, t in enumerate(texts):
            others = [texts[j].tolist() for j in range(40) if low[k] != high[k] or low[j] != low[k] or high[j] != high[k]]
            grams = {n: {tuple(o[i : i + n]) for o in others for i in range(len(o) - n + 1)} for n in range(1, min(most, len(t)) + 1)}
            for i in range(len(t)):
                want = max((n for n in range(1, min(most, len(t) - i) + 1) if tuple(t[i : i + n].tolist()) in grams[n]), default=0)
                assert found[k][i] == want, (k, i)


def test_minima():
    x = np.random.default_rng(0).integers(0, 9, 77)
    a, b = np.triu_indices(77)
    assert list(Minima(x).least(a, b)) == [x[i : j + 1].min() for i, j in zip(a, b)]


def hard_docs():
    rng = random.Random(5)
    common = "".join(rng.choice("abcdé ß") for _ in range(200))
    docs = {k: None for k in range(3)} | {3: "", 4: "a" * 500, 5: "b" * 500 + "a" * 90, 6: common, 7: common, 8: "x" + common[20:150] + "y" * 70}
    for k in range(9, 40):
        docs[k] = "".join(rng.choice("ab") for _ in range(rng.randrange(120))) + common[k : k + 3 * k] + "".join(rng.choice("c😀") for _ in range(60))
    docs[41] = "zq" * 200  # repeats itself only
    docs[42] = common[:25]
    return docs


@pytest.mark.parametrize("crowd", [1000, 3, 0])
def test_spans_against_brute_force(spark, crowd):
    docs = hard_docs()
    df = spark.createDataFrame(list(docs.items()), DOCS)
    for length in (30, 50):
        assert rows(spans.shared_spans(df, length, shard_chars=2_000, crowd=crowd)) == brute_spans(docs, length)


def test_spans_of_a_passage_that_many_quote(spark):
    """More quotations in surroundings of their own than a shard takes of one anchor."""
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(120))
    word = lambda n: "".join(rng.choice("klmnopqrst") for _ in range(n))
    docs = {k: word(rng.randrange(20, 60)) + passage + word(rng.randrange(20, 60)) for k in range(1300)}
    docs |= {k: word(50) + passage[:99] + word(50) for k in range(1300, 1400)} | {1400: word(300)}
    got = rows(spans.shared_spans(spark.createDataFrame(list(docs.items()), DOCS), 100))
    assert got == brute_spans(docs, 100) and len(got) >= 1300


def test_spans_of_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(spans, "BATCH_CHARS", 70)
    docs = hard_docs()
    pieces = [winnowed for winnowed in spans._pieces([t for t in docs.values()], 30)]
    grams = sum(int(spans.winnow(parts, 30, 10)[2].sum()) for _, _, parts in pieces)
    assert grams == sum(max(0, len(t or "") - 29) for t in docs.values())


def test_spans_on_table_and_shares(spark):
    df = load(spark, SMALL, "documents")
    docs = {r.doc_id: r.text for r in df.collect()}
    found = spans.shared_spans(df)
    want = brute_spans(docs, 300)
    assert rows(found) == want and want
    shares = {r.doc_id: r for r in spans.shared_shares(df, found).collect()}
    assert shares.keys() == docs.keys()
    assert sum(r.shared_chars for r in shares.values()) == sum(b - a for _, a, b in want)


def test_spans_empty(spark):
    assert spans.shared_spans(spark.createDataFrame([], DOCS)).count() == 0
    assert spans.shared_spans(spark.createDataFrame([(1, None), (2, "short")], DOCS)).count() == 0


def test_leaks_on_table(spark):
    df, items = load(spark, SMALL, "documents"), load(spark, SMALL, "eval_items")
    want = brute_leaks({r.doc_id: r.text for r in df.collect()}, {r.item_id: r.text for r in items.collect()})
    assert rows(contamination.leaks(df, items).select("doc_id", "item_id")) == want and want
    assert rows(contamination.leaks(df, items, chars=9_000).groupBy("doc_id", "item_id").agg(F.sum("windows")).select("doc_id", "item_id")) == want


def test_leaks_edges(spark, monkeypatch):
    monkeypatch.setattr(contamination, "STRETCH", 7)
    rng = random.Random(3)
    vocabulary = ["Ärger", "ﬁnd", "x", "Ⅳ", "naïve", "soft­ware", "a_b", "TAG", "7"]
    items = {k: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(30))) for k in range(20)} | {30: None, 31: "", 32: "one two"}
    docs = {1: None, 2: "", 3: "<b>" * 5, 4: " ".join(rng.choice(vocabulary) for _ in range(3000))}
    for k in range(20):
        words = items[k].split()
        docs[10 + k] = "pre " * rng.randrange(40) + "<i>".join(words).upper() + " post" + " ?!" * k
        docs[50 + k] = " ".join(words[3:14])
        docs[80 + k] = " ".join(words[2:16]).lower().replace("ä", "ä")
    df = spark.createDataFrame([(k, t, "en") for k, t in docs.items()], DOCS + ", item_id string")
    it = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = brute_leaks(docs, items)
    assert rows(contamination.leaks(df, it).select("doc_id", "item_id")) == want and len(want) > 10
    assert contamination.leaks(df, it.limit(0)).count() == 0
    assert contamination.leaks(df.limit(0), it).count() == 0
