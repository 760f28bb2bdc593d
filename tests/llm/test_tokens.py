import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.llm.pack import END, LENGTH, _encoder, pack, shortest_pack_first
from lumenframe.llm.token_counts import Transducer, count_tokens

MODEL = "piece_bpe_32k.model"
ODD = ["", " ", "  a  b ", "a\tb\r\nc", "　x ﬁ Ⅷ", "</s><s>hi<unk>", "<0x0A>", "▁a", "é é", "\0x", "a" * 900, "日本語テキスト", "🙂🙂", "   " * 60, "<|endoftext|> a"]


@pytest.fixture(scope="module")
def transducer():
    return Transducer(P.path(MODEL))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path(MODEL))


def test_counts_equal_the_library(transducer, library):
    assert transducer.count(ODD).tolist() == [len(x) for x in library.encode(ODD)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=80), st.text(alphabet="theransio  \n", max_size=700)), min_size=1, max_size=6))
def test_counts_on_random_texts(texts):
    import sentencepiece

    global _pair
    try:
        t, lib = _pair
    except NameError:
        t, lib = _pair = Transducer(P.path(MODEL)), sentencepiece.SentencePieceProcessor(model_file=P.path(MODEL))
    assert t.count(texts).tolist() == [len(x) for x in lib.encode(texts)]


def test_counts_survive_an_emptied_table(transducer, library, monkeypatch):
    monkeypatch.setattr("lumenframe.llm.token_counts.MOST_STATES", 3)
    monkeypatch.setattr("lumenframe.llm.token_counts.TOGETHER", 10)
    assert transducer.count(ODD).tolist() == [len(x) for x in library.encode(ODD)]


@pytest.mark.parametrize("together", [1, 7, 400])
def test_parts_of_a_long_text_follow_each_other(transducer, library, monkeypatch, together):
    monkeypatch.setattr("lumenframe.llm.token_counts.TOGETHER", together)
    texts = [*ODD, "internationalisation of tokenizers " * 9]
    assert transducer.count(texts).tolist() == [len(x) for x in library.encode(texts)]
    monkeypatch.setattr("lumenframe.llm.token_counts.MOST_STATES", 5)
    assert transducer.count(texts).tolist() == [len(x) for x in library.encode(texts)]


def test_counts_odd_and_empty_tables(odd, none, library):
    got = {r["doc_id"]: r["n_tokens"] for r in count_tokens(odd, MODEL).collect()}
    assert {r["doc_id"]: len(library.encode(r["text"] or "")) for r in odd.collect()} == got
    assert count_tokens(none, MODEL).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=120))
def test_encoder_equals_the_tokenizers_library(text):
    from tokenizers import Tokenizer

    global _hf
    try:
        hf = _hf
    except NameError:
        hf = _hf = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert _encoder("byte_bpe_50k").encode(text, allowed_special="all") == hf.encode(text, add_special_tokens=False).ids


def test_special_string_and_blanks_equal_the_library():
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert [_encoder("byte_bpe_50k").encode(t, allowed_special="all") for t in ODD] == [hf.encode(t, add_special_tokens=False).ids for t in ODD]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=40))
def test_packing_plan_places_every_piece_once(histogram):
    plan = shortest_pack_first(histogram, 64)
    cells, ranks = {}, {}
    for r in plan.itertuples():
        for k in range(r.n * r.layers):
            layer, place = divmod(k, r.n)
            cells.setdefault(r.sequence + place, []).append((r.offset + layer * r.length, r.length))
            ranks.setdefault(r.length, []).append(r.rank + k)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
    assert sorted(cells) == list(range(len(cells)))
    for held in cells.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64


def test_round_trip_of_packed_documents(odd, none):
    rows = pack(odd, with_ids=True).toPandas()
    docs = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    encode = lambda t: [*_encoder("byte_bpe_50k").encode(t, allowed_special="all"), END]
    for r in rows.itertuples():
        ids = np.array(encode(docs[None if np.isnan(r.doc_id) else int(r.doc_id)]), "<u4")
        part = ids[r.start : r.start + r.length]
        assert part.tolist() == list(r.ids) and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids)
    by = rows.sort_values(["sequence_id", "offset"])
    assert ((by.groupby("sequence_id")["length"].cumsum() - by["length"]) == by["offset"]).all()
    assert by.groupby("sequence_id")["length"].sum().max() <= LENGTH
    assert rows["length"].sum() == sum(len(encode(r["text"] or "")) for r in odd.collect())
    assert pack(none).count() == 0
