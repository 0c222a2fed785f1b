import zlib

import numpy as np

from factloom.llm import langid

DOCS = "doc_id long, text string, lang string, score string"


def naive_grams(text):
    found = {}
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    row = "_" + "_".join(words) + "_"
    for n in (1, 2, 3):
        for i in range(len(row) - n + 1):
            g = row[i : i + n]
            if (n == 1 and g == "_") or (n == 3 and g[1] == "_"):
                continue
            found[g] = found.get(g, 0) + 1
    return found


def test_grams_match_a_plain_count():
    for text in ["Hello, wörld! hello", "a", "12 é3b", "日本 ab\tC"]:
        codes, counts = langid.counted(langid.grams_of(langid.letters_of(text)))
        assert sorted(counts.tolist()) == sorted(naive_grams(text).values())
        assert len(codes) == len(naive_grams(text))


def test_out_of_place_distance():
    order = langid.most_frequent(*langid.counted(langid.grams_of(langid.letters_of("abab abab"))), langid.TOP)
    profiles = langid.Profiles.of({"x": order, "y": order[::-1].copy()})
    assert profiles.predict("abab abab") == ("x", 1.0)
    assert profiles.predict(None) == profiles.predict("12 !?") == ("und", 0.0)
    assert langid.Profiles.of({}).predict("abc") == ("und", 0.0)
    tie = langid.Profiles.of({"b": order, "a": order.copy()})
    assert tie.predict("abab")[0] == "a"


def test_identify_learns_only_from_the_other_folds(spark):
    rows = []
    for i in range(60):
        held = zlib.crc32(str(i).encode()) % 4 == 2
        lang = "en" if i % 2 else "de"
        text = "the house and the tree with things" if i % 2 else "das haus und der baum mit dingen"
        rows.append((i, text * (1 + i % 3), "zz" if held else lang, "clash"))
    rows += [(None, "the house", "en", None), (1000, None, "en", None), (1001, "", None, None), (1001, "", None, None)]
    found = langid.identify(spark.createDataFrame(rows, DOCS)).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["text"]:
            assert r["lang_pred"] == ("en" if "the" in r["text"] else "de") and 0 < r["score"] <= 1
        else:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert not any(r["held_out"] for r in found if r["doc_id"] is None)


def test_empty_table_and_long_text(spark):
    assert langid.identify(spark.createDataFrame([], DOCS)).count() == 0
    profile = langid.Profiles.of({"x": np.sort(langid.grams_of(langid.letters_of("ab")))})
    assert profile.predict("ab " * 300_000)[0] == "x"


def test_held_out_accuracy(spark):
    found = langid.identify(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.95 * len(found)


def naive_profile(counts):
    """The most frequent n-grams: by falling count, shorter ones first, then by letters (word borders first)."""
    key = lambda g: (-counts[g], len(g), [0 if c == "_" else ord(c) for c in g])
    return sorted(counts, key=key)[: langid.TOP]


def test_predictions_of_the_query_equal_brute_force(spark):
    from factloom.llm.queries import op7_language_id

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").collect()
    totals = {}
    for r in docs:
        if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            for g, n in naive_grams(r["text"]).items():
                mine = totals.setdefault(r["lang"], {})
                mine[g] = mine.get(g, 0) + n
    profiles = {lang: {g: i for i, g in enumerate(naive_profile(c))} for lang, c in totals.items()}
    want = {}
    for r in docs:
        own = naive_profile(naive_grams(r["text"] or ""))
        if not own:
            want[r["doc_id"]] = ("und", 0.0)
            continue
        apart = {lang: sum(abs(i - p[g]) if g in p else langid.TOP for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(apart), key=apart.get)
        want[r["doc_id"]] = (best, 1 - apart[best] / (langid.TOP * len(own)))
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in op7_language_id(spark, folder).collect()}
    assert found.keys() == want.keys()
    for doc, (lang, score) in want.items():
        assert found[doc][0] == lang and abs(found[doc][1] - score) < 1e-12
