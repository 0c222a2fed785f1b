import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import decontaminate as dec

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    own, hit, found = words(text), set(), set()
    for item, other in items:
        w = words(other)
        for k in range(max(len(w) - 12, min(1, len(w)))):
            window = w[k : k + 13]
            for p in range(len(own) - len(window) + 1):
                if own[p : p + len(window)] == window:
                    hit.update(range(p, p + len(window)))
                    found.add(str(item))
    return len(own), hit, sorted(found)


def make(seed, vocabulary):
    random.seed(seed)
    pick = lambda k: " ".join(random.choices(vocabulary, k=k))
    items = [(i, random.choice([None, "", pick(1), pick(4), pick(13), pick(20), pick(30)])) for i in range(12)]
    docs = []
    for i in range(60):
        text = pick(random.randint(0, 40))
        if random.random() < 0.6:
            passage = (random.choice(items)[1] or "").split()
            text = f"{text}, {' '.join(passage[random.randint(0, 3):]).upper()}; {pick(random.randint(0, 10))}"
        docs.append((i, random.choice([text, text, text, None, docs[-1][1] if docs else ""]), "clash"))
    return items, docs


@pytest.mark.parametrize(("seed", "block"), [(1, None), (2, None), (3, 300)])
def test_against_brute_force(spark, monkeypatch, seed, block):
    if block:
        monkeypatch.setattr(dec, "BLOCK_BYTES", block)
    items, docs = make(seed, ["a", "b", "é", "d1"] if seed == 1 else [f"w{i}" for i in range(40)])
    bench = spark.createDataFrame([*items, items[3]], "item_id long, text string")
    found = dec.judged(dec.with_spans(spark.createDataFrame(docs, "doc_id long, text string, items string"), bench)).collect()
    assert len(found) == len(docs)
    for r in found:
        n, hit, names = brute(r["text"], items)
        assert r[dec.N_WORDS] == n and r[dec.ITEMS] == names and r["n_hit"] == len(hit) and r["n_items"] == len(names)
        assert {x for s in r[dec.SPANS] for x in range(s["lo"], s["hi"])} == hit
        assert r["items_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= n)


def test_spans_are_cut_from_texts(spark):
    passage = " ".join(f"p{i}" for i in range(13))
    rows = [(1, f"Clean, start. {passage.title()}! The end."), (2, "nothing here"), (3, None)]
    bench = spark.createDataFrame([(9, passage)], "item_id long, text string")
    found = dec.remove_spans(dec.with_spans(spark.createDataFrame(rows, "doc_id long, text string"), bench)).collect()
    assert {r["doc_id"]: r["text"] for r in found} == {1: "Clean, start. ! The end.", 2: "nothing here", 3: None}


def test_empty_tables_and_null_items(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    odd = spark.createDataFrame([(None, "a"), (4, None), (5, "!?")], "item_id long, text string")
    for bench in (none, odd):
        assert [(r["n_hit"], r["contaminated"]) for r in dec.judged(dec.with_spans(docs, bench)).collect()] == [(0, False)] * 2
    assert dec.with_spans(docs.limit(0), odd).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=5), min_size=1, max_size=6))
def test_index_finds_all_positions(tokens, patterns):
    text = np.array([*tokens, 0], np.int64)
    index = dec.FmIndex(text, 3)
    width = max(map(len, patterns))
    lo, hi = index.search(np.array([[0] * (width - len(p)) + p for p in patterns], np.int64))
    for p, a, b in zip(patterns, lo, hi, strict=True):
        want = [i for i in range(len(text)) if text[i : i + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def test_long_repeated_text(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(i, " ".join([passage] * 2000)) for i in range(3)]
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    found = dec.judged(dec.with_spans(spark.createDataFrame(rows, "doc_id long, text string"), bench)).collect()
    assert all(r["n_hit"] == r[dec.N_WORDS] == 40_000 for r in found)


def test_shards_by_bytes_agree(spark, monkeypatch):
    items, docs = make(4, [f"w{i}" for i in range(30)])
    frames = [spark.createDataFrame(docs, "doc_id long, text string, items string"), spark.createDataFrame(items, "item_id long, text string")]
    whole = dec.judged(dec.with_spans(*frames)).orderBy("doc_id").collect()
    monkeypatch.setattr(dec, "SHARD_BYTES", 1)
    monkeypatch.setattr(dec, "SHARD_TOKENS", 3)
    assert dec.judged(dec.with_spans(*frames)).orderBy("doc_id").collect() == whole


def test_clashing_columns_are_replaced(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 7)], f"doc_id long, text string, {dec.SPANS} string, n_hit int")
    found = dec.judged(dec.with_spans(docs, spark.createDataFrame([(1, "b")], "item_id long, text string"))).collect()[0]
    assert found["n_hit"] == 1 and found[dec.SPANS][0]["lo"] == 1


def test_memory_of_windows_is_a_small_multiple_of_the_text():
    import sys

    random.seed(1)
    text = " ".join(f"w{random.randrange(10**6)}" for _ in range(100_000))
    windows = dec.Windows([("a", text)])
    held = windows.patterns.nbytes + windows.owners.nbytes + windows.starts.nbytes + sys.getsizeof(windows.vocabulary)
    assert len(windows.patterns) == 100_000 - 12 and held < 25 * len(text)
