"""Piece encoding, spans and decoding against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlake.llm import queries, subwords

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=subwords.default_path())
TEXTS = [
    "", " ", "  two  spaces ", "▁mark", "<s> </s> <unk>", "日本語 テスト 𝔘nicode é", "a" * 3000, "\n\n\t x\r", "12345 678", "ﬁn a\x00b",
    "The tea, the cup; THE END." * 30, "x" * 70 + " " + "日" * 70, "é", " ▁ ▁x",
]


@pytest.mark.parametrize("text", TEXTS)
def test_same_as_the_library(text):
    own = subwords.model(None)
    want = LIBRARY.encode(text, return_type="proto")
    ids, starts, ends = own.encode(text)
    assert ids.tolist() == [p.id for p in want.pieces]
    assert list(zip(starts.tolist(), ends.tolist())) == [(p.begin, p.end) for p in want.pieces]
    assert own.decode(ids) == LIBRARY.decode(ids.tolist())


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab eé▁\n日𝔘1.ing the"), max_size=60), st.lists(st.integers(0, 31_999), max_size=12))
def test_any_text_and_any_ids(text, ids):
    own = subwords.model(None)
    found, starts, ends = own.encode(text)
    assert found.tolist() == LIBRARY.encode(text)
    source = text.encode()
    assert b"".join(source[a:b] for a, b in zip(starts, ends)) == source  # spans cover the text, in order, once
    low = [k % 400 for k in ids]
    assert own.decode(np.array(ids)) == LIBRARY.decode(ids) and own.decode(np.array(low)) == LIBRARY.decode(low)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("trim", [True, False])
@pytest.mark.parametrize("fallback", [True, False])
def test_compiled_character_maps(rule, trim, fallback):
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model, rules = proto.ModelProto(), proto.ModelProto()
    with open(subwords.default_path(), "rb") as file:
        model.ParseFromString(file.read())
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    model.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces = trim
    model.normalizer_spec.add_dummy_prefix = not trim or fallback
    model.trainer_spec.byte_fallback = fallback
    for k, piece in enumerate(model.pieces):
        if piece.type == subwords.BYTE and not fallback:
            piece.type = subwords.NORMAL
        if 300 < k < 2000 and k % 7 == 0:
            piece.type = subwords.UNUSED
    data = model.SerializeToString()
    library, own, rnd = sentencepiece.SentencePieceProcessor(model_proto=data), subwords.Model(data), random.Random(5)
    pool = "ab e  \t　ﬁ①㍿é éカﾞ𝔘​.\n▁12日本¨ "
    for text in [*TEXTS, *("".join(rnd.choice(pool) for _ in range(rnd.randrange(30))) for _ in range(300))]:
        want = library.encode(text, return_type="proto")
        ids, starts, ends = own.encode(text)
        assert [(p.id, p.begin, p.end) for p in want.pieces] == list(zip(ids.tolist(), starts.tolist(), ends.tolist())), text
        assert own.decode(ids) == library.decode(ids.tolist())


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        subwords.Model(b"")


def test_frames(spark):
    rows = [(None if k % 5 == 4 else k, t, "kept", "mine") for k, t in enumerate([*TEXTS, None, TEXTS[5], TEXTS[5]])]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, `Ids` string, `a.b c` string")
    out = subwords.encoded(frame, back=True)
    assert out.columns == ["doc_id", "text", "a.b c", "ids", "starts", "ends", "decoded"]
    got = out.select("doc_id", "text", out["`a.b c`"].alias("o"), "ids", subwords.decoded(out["ids"]).alias("back"), "decoded").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.o == "mine" and r.ids == LIBRARY.encode(r.text or "") and r.back == r.decoded == LIBRARY.decode(r.ids)
    assert subwords.encoded(frame.limit(0)).count() == 0
    assert spark.sql("select cast(null as array<int>) ids").select(subwords.decoded("ids").alias("t")).first().t is None


def test_small_batches(spark, monkeypatch):
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS * 3)], "k int, text string").coalesce(1)
    monkeypatch.setattr(subwords, "TOKENS_PER_BATCH", 5)
    assert {r.k: r.ids for r in subwords.encoded(frame).collect()} == {k: LIBRARY.encode(t) for k, t in enumerate(TEXTS * 3)}


def test_query(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate([*TEXTS, None])]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op11_encode_pieces(spark, str(tmp_path)).collect()}
    for k, text in rows:
        ids = LIBRARY.encode(text or "")
        assert got[k].n_tokens == len(ids) and got[k].covered_bytes == len((text or "").encode())
        assert got[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
