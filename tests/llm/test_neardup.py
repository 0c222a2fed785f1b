import random

import numpy as np
import pytest

from factloom.llm import components as comp
from factloom.llm import neardup

DOCS = "doc_id long, text string, component_id string"


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(1, len(words))))}


def brute(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    for x in range(len(sets)):
        for y in range(x):
            (i, a), (j, b) = sets[x], sets[y]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = top(i), top(j)
                parent[max(p, q)] = min(p, q)
    return {i: top(i) for i in ids}


def corpus(n, seed):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    common = random.choices(vocabulary, k=12)
    bases = [random.choices(vocabulary, k=random.choice([1, 3, 5, 8, 40, 120])) for _ in range(n // 4)]
    rows = []
    for i in range(n):
        words = list(random.choice(bases))
        for _ in range(random.randint(0, max(1, len(words) // 25))):
            words[random.randrange(len(words))] = random.choice(vocabulary)
        if random.random() < 0.2:
            words += common
        rows.append((i * 3 % n if n % 3 else i, random.choice([" ", "\n", "\t "]).join(words).title()))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(160, seed)
    found = neardup.label_documents(spark.createDataFrame([(*r, "clash") for r in rows], DOCS)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    sizes = {i: len(shingles(t)) for i, t in rows}
    assert all(r["n_shingles"] == sizes[r["doc_id"]] for r in found)


def test_large_groups_take_the_blockwise_way(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 6)
    monkeypatch.setattr(neardup, "BLOCK_SETS", 5)
    random.seed(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(random.randint(0, 4)):
            words[random.randrange(len(words))] = f"x{random.random()}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join([*base[:30], *(f"y{i}-{k}" for k in range(30))])) for i in range(30)]
    found = neardup.label_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == brute(rows)


def test_nulls_empty_repeats(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A"), (5, "A"), (None, "a"), (6, "a b c d e"), (7, "a b c d e f")]
    found = [tuple(r)[0:1] + tuple(r)[2:] for r in neardup.label_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(found, key=str) == sorted(
        [
            (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False),
            (None, 1, None, True), (6, 1, 6, True), (7, 2, 7, True),
        ],
        key=str,
    )
    assert neardup.label_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    kept = neardup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "2", "3", "4", "6", "7", "None"]


def test_very_long_text(spark):
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    rows = [(1, long), (2, long + " end"), (3, "x " * 100_000)]
    found = neardup.label_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize("block", [200_000, 20])
def test_components(spark, monkeypatch, block):
    monkeypatch.setattr(comp, "BLOCK", block)
    random.seed(7)
    for edges in ([], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 300)], [(random.randrange(500), random.randrange(500)) for _ in range(300)]):
        found = comp.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()
        ids = sorted({x for e in edges for x in e})
        at = {x: i for i, x in enumerate(ids)}
        parent = comp.merge_labels(np.arange(len(ids)), np.array([at[a] for a, _ in edges], int), np.array([at[b] for _, b in edges], int)) if edges else []
        got = {r["id"]: r["component"] for r in found}
        assert len(got) == len(found)
        assert all(got.get(x, x) == ids[parent[at[x]]] for x in ids)


def test_who_is_alike_to_a_set_at_the_hub_is_linked_to_it(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 2)
    hub = np.arange(neardup.WIDTH, dtype=np.uint32)
    at, near = hub.copy(), hub.copy()
    at[-(neardup.WIDTH - neardup.AT_HUB) :] += 1000
    near[-(neardup.WIDTH - neardup.AT_HUB) :] = at[-(neardup.WIDTH - neardup.AT_HUB) :]
    near[neardup.TREES : neardup.TREES + neardup.WIDTH - neardup.AGREE] += 2000
    assert (at == hub).sum() == neardup.AT_HUB and (at == near).sum() == neardup.AGREE
    rows = [(i, bytearray(x.tobytes())) for i, x in enumerate((hub, at, near))]
    links = neardup.candidate_links(spark.createDataFrame(rows, "id long, tokens binary")).collect()
    assert {(2, 0), (1, 0)} <= {(r["a"], r["b"]) for r in links}


@pytest.mark.parametrize("piece", [1, 7, 64])
def test_pieces_of_a_text_give_the_same_set(monkeypatch, piece):
    random.seed(9)
    texts = ["", " ", "a", "a b", "a b c d", "a b c d e", "a b c d e f g " * 9, "long" * 50 + " x y z é\u00a0ü w\tv\nu", "  a  b  c  d  e  f  "]
    texts += [" ".join(random.choices(["ab", "c", "défg", "h" * 30], k=random.randint(0, 40))) for _ in range(60)]
    whole = [neardup.Shingler()(t).tolist() for t in texts]
    assert [len(w) for w in whole] == [len(shingles(t)) for t in texts]
    monkeypatch.setattr(neardup, "PIECE", piece)
    assert [neardup.Shingler()(t).tolist() for t in texts] == whole


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_texts_by_broadcast_and_by_join_agree(spark, monkeypatch, most):
    monkeypatch.setattr(neardup, "BROADCAST_IDS", most)
    rows = corpus(120, 3)
    found = neardup.label_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == brute(rows)


def test_columns_named_like_its_own_are_kept(spark):
    rows = [(1, "a b c d e", "k1", "x"), (2, "a b c d e", "k2", "y"), (3, None, "k3", "z")]
    kept = neardup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, neardup__key string, print string"))
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_sets_that_one_hub_joins_branch_once(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 4)
    branched, counted = [], neardup.written_counted

    def recorded(df, name, *rest):
        out = counted(df, name, *rest)
        branched.extend([out[1]] * (name == "branched"))
        return out

    monkeypatch.setattr(neardup, "written_counted", recorded)
    rng = np.random.default_rng(3)
    sets = np.tile(np.arange(neardup.WIDTH, dtype=np.uint32), (40, 1))
    # the roots agree; the others differ from the hub in 20 places, so all branch on
    for x in range(1, 40):
        sets[x, rng.choice(np.arange(neardup.TREES, neardup.WIDTH), 20, replace=False)] += np.uint32(1000 * x)
    rows = [(i, bytearray(x.tobytes())) for i, x in enumerate(sets)]
    links = neardup.candidate_links(spark.createDataFrame(rows, "id long, tokens binary")).collect()
    assert {(r["a"], r["b"]) for r in links} >= {(i, 0) for i in range(1, 40)}
    assert branched == [neardup.TREES * 39 * (neardup.BRANCHES + 1)]


def test_children_with_a_set_that_no_hub_joins_are_compared(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 4)
    rng = np.random.default_rng(4)
    hub = np.arange(neardup.WIDTH, dtype=np.uint32)
    rows, pairs = [hub], []
    for x in range(1, 31):
        # 24 places as the hub's: linked to it; its neighbour has 4 of them less and differs in 4 others: not linked, but alike
        near = hub + np.uint32(1000 * x)
        near[: neardup.TREES] = hub[: neardup.TREES]
        near[rng.choice(np.arange(neardup.TREES, neardup.WIDTH), 24 - neardup.TREES, replace=False)] %= 1000
        far = near.copy()
        same = np.flatnonzero(near == hub)
        far[same[neardup.TREES :][:5]] += np.uint32(500 + 1000 * x)
        assert (near == hub).sum() >= neardup.NEAR_HUB > (far == hub).sum() and (near == far).sum() >= 59
        pairs.append((len(rows), len(rows) + 1))
        rows += [near, far]
    frame = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(rows)], "id long, tokens binary")
    found = neardup.candidate_links(frame).collect()
    parent = comp.merge_labels(np.arange(len(rows)), np.array([r["a"] for r in found]), np.array([r["b"] for r in found]))
    assert all(parent[a] == parent[b] for a, b in pairs)
