import zlib

import corpus_pipeline as pipe
from factloom.llm import decontaminate, langid, neardup, spm
from factloom.llm.queries import MODEL_PATH
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_neardup import brute as brute_groups

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [d for d in docs if d["text"] and any(c.isalpha() for c in d["text"])]
    groups = brute_groups([(d["doc_id"], d["text"]) for d in kept])
    kept = [d for d in kept if groups[d["doc_id"]] == d["doc_id"]]
    clean = []
    for d in kept:
        n, hit, _ = brute_hits(d["text"], items)
        if not (hit and decontaminate.PART * len(hit) >= n):
            clean.append(d)
    coder = spm.Transducer(spm.read_model(MODEL_PATH))
    want = {d["doc_id"]: coder.encode(d["text"]).tobytes() for d in clean}
    found = {r["doc_id"]: bytes(r["ids"]) for r in pipe.run(spark, SF).collect()}
    assert found == want and len(want) < len(docs)


def test_all_but_the_last_stage_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in pipe.STAGES] == ["language id", "near duplicates", "decontamination", "tokens"]
    for _, stage in pipe.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_odd_rows(spark, tmp_path):
    rows = [(None, "word " * 9, "en", "s", 1), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "ab cd", "en", "s", 5), (3, "ab cd", "en", "s", 5), (4, "123", "en", "s", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = sorted(str(r["doc_id"]) for r in pipe.run(spark, str(tmp_path)).collect())
    assert found == ["3", "None"]
    assert langid.UNKNOWN == "und" and neardup.WORDS == 5 and zlib.crc32(b"") == 0
