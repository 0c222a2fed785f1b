import random
import struct

import numpy as np
import pytest

from factloom.llm import spm
from factloom.llm.queries import MODEL_PATH

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def model():
    return spm.read_model(MODEL_PATH)


def varint(n):
    out = b""
    while True:
        n, low = n >> 7, n & 127
        out += bytes([low | (128 if n else 0)])
        if not n:
            return out


def as_unigram(model):
    """The same pieces as a unigram model: only the model type differs."""
    out = b""
    for number, value in spm.fields(model):
        if number == 2:
            kept = b""
            for k, v in spm.fields(value):
                if k == 3:
                    continue
                kept += varint(k << 3 | 0) + varint(v) if isinstance(v, int) else varint(k << 3 | (5 if len(v) == 4 and k in (10, 30) else 2)) + (v if len(v) == 4 and k in (10, 30) else varint(len(v)) + v)
            value = kept + varint(3 << 3) + varint(spm.UNIGRAM)
        out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def texts():
    random.seed(6)
    alphabet = "abcde  \n\t .,;:!?<s>é中文🙂▁théİ\u0000_²123'\"()-\r"
    fuzz = ["".join(random.choices(alphabet, k=random.randint(0, 30))) for _ in range(1500)]
    return ["", " ", "  a  b ", "Hello world", "²." * 5, *fuzz]


def test_encoding_and_decoding_equal_the_library(model):
    own, other = spm.Transducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for text in texts():
        ids = own.encode(text)
        assert ids.tolist() == other.encode(text), text
        assert own.decode(ids) == other.decode(ids.tolist()), text
        assert own.decode(ids) == own.plain(text), text


def test_documents_equal_the_library(spark, model):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    other = sentencepiece.SentencePieceProcessor(model_proto=model)
    for r in spm.with_tokens(rows, model).collect():
        assert np.frombuffer(r[spm.TOKENS]["ids"], "<u4").tolist() == other.encode(r["text"])
        assert r[spm.TOKENS]["decodes"] and r[spm.TOKENS]["n_tokens"] == len(r[spm.TOKENS]["ids"]) // 4


def test_unigram_path_is_the_least(model):
    own = spm.Transducer(model)
    own.kind = spm.UNIGRAM
    random.seed(8)
    pieces = ["▁", "a", "b", "ab", "ba", "▁a", "aba"]
    own.ids = {p: i for i, p in enumerate(pieces)}
    own.scores = [random.uniform(-9, -1) for _ in pieces]
    own.pieces = pieces
    own.index()

    def least(text):
        if not text:
            return 0.0
        options = [(-own.scores[own.ids[text[:k]]]) + least(text[k:]) for k in range(1, 4) if text[:k] in own.ids]
        return min(options) if options else float("inf")

    for _ in range(200):
        text = "".join(random.choices("▁ab", k=random.randint(1, 9)))
        path = own.shortest_path(text)
        assert "".join(map(own.symbol, path)) == text
        assert abs(sum(own.weight(None, s) for s in path) - least(text)) < 1e-9


def test_nulls_empty_clashing_columns_and_long(spark, model):
    rows = [(1, None, "a"), (2, "", "b"), (2, "", "b"), (3, "word " * 60_000, "c")]
    found = spm.with_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), model).collect()
    assert len(found) == 4 and found[0][spm.TOKENS] is None
    assert [r[spm.TOKENS]["n_tokens"] for r in found[1:3]] == [0, 0]
    assert found[3][spm.TOKENS]["decodes"]
    assert spm.with_tokens(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def changed(model, types=None, normaliser=None, without_bytes=False):
    """The model with other piece types, a library's normaliser, or no byte fallback. Ranks become
    scores of a size that single precision can add (one piece's rank is 10^9)."""
    out, at = b"", 0
    for number, value in spm.fields(model):
        if number == 1:
            piece = dict(spm.fields(value))
            kind = (types or {}).get(at, piece.get(3, spm.NORMAL))
            kind = spm.UNUSED if without_bytes and kind == spm.BYTE else kind
            score = struct.unpack("<f", piece.get(2, b"\0" * 4))[0]
            out += field(1, field(1, piece[1]) + varint(2 << 3 | 5) + struct.pack("<f", max(score, -40_000) / 1024) + field(3, kind))
            at += 1
            continue
        if number == 3 and normaliser:
            value = normaliser
        if number == 2 and without_bytes:
            value += field(35, 0)
        out += field(number, value)
    return out


def equal_to_the_library(model, cases):
    own, other = spm.Transducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for text in cases:
        ids = own.encode(text)
        assert ids.tolist() == other.encode(text), text
        assert own.decode(ids) == other.decode(ids.tolist()), text


def documents():
    import pyarrow.parquet as pq

    return [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist() if t][:60]


def lines(unigram):
    """Documents, for unigram models in short lines: over a long text the library's sums lose digits."""
    return [x for t in documents() for x in t.replace("\n", ".").split(".")] if unigram else documents()


def test_unigram_equals_the_library(model):
    equal_to_the_library(changed(as_unigram(model)), [*texts(), *lines(True)])


NORMALISED = ["ﬁne ① Ａｂｃ\u3000 ｶﾞ e\u0301 o\u0308x \u1100\u1161 \t\r\n a\u00a0 b", "½ ™ ﷺ \u200b x", "a\u0323\u0307", "\ufb03 \u0958"]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf"])
@pytest.mark.parametrize("unigram", [False, True])
def test_character_maps_equal_the_library(model, rule, unigram):
    spec = dict(spm.fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()))[3]
    random.seed(3)
    fuzz = ["".join(random.choices("ae\u0301\u0308 \u3000ﬁ①\u1100\u1161ÄßΣ\t\nﾞカｶ", k=20)) for _ in range(300)]
    equal_to_the_library(changed(as_unigram(model) if unigram else model, normaliser=spec), [*NORMALISED, *fuzz, *texts()[:400]])


@pytest.mark.parametrize("unigram", [False, True])
def test_user_defined_and_unused_pieces_equal_the_library(model, unigram):
    base, known = as_unigram(model) if unigram else model, spm.Transducer(model).ids
    random.seed(5)
    common = sorted((p for p in known if 2 <= len(p) <= 5), key=known.get)[:3000]
    types = {known[p]: spm.USER for p in random.sample(common, 12)} | {known[p]: spm.USER for p in ("ab", "▁a", "cd") if p in known}
    if unigram:
        with pytest.raises(ValueError, match="user-defined"):
            spm.Transducer(changed(base, types))
    else:
        equal_to_the_library(changed(base, types), [*texts(), *documents()])
    equal_to_the_library(changed(base, {known[p]: spm.UNUSED for p in random.sample(common, 300)}), [*texts(), *lines(unigram)])


@pytest.mark.parametrize("unigram", [False, True])
def test_models_without_bytes_have_one_unknown_for_a_run(model, unigram):
    equal_to_the_library(changed(as_unigram(model) if unigram else model, without_bytes=True), [*texts(), "a🙂🙂b 🙂"])


def test_a_column_named_like_the_added_one_is_replaced(spark, model):
    found = spm.with_tokens(spark.createDataFrame([(1, "a b", "x")], f"doc_id long, text string, {spm.TOKENS} string"), model).collect()
    assert found[0][spm.TOKENS]["n_tokens"] == 2


def test_remembered_parts_are_bounded_by_bytes(model, monkeypatch):
    monkeypatch.setattr(spm, "REMEMBERED_BYTES", 2000)
    monkeypatch.setattr(spm, "REMEMBERED_PAIRS", 10)
    own, other = spm.Transducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for text in documents()[:20]:
        assert own.encode(text).tolist() == other.encode(text)
    assert len(own.follows) <= 11
