"""Texts of many megabytes: blank runs, single words, millions of short lines."""

import os
import re
import subprocess
import sys

import numpy as np
import pytest

import corpus_pipeline
from lumenframe.llm import chain, language, near_text, pack, quality, token_counts, words
from lumenframe.llm.base import saved

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
LONG = {"blanks": "' ' * 10_000_000", "word": "'x' * 10_000_000", "lines": "'a\\n' * 5_000_000"}
WORK = {
    "op1": "quality; m = quality.fit(['a b\\nc d', '!! !!'] * 20, np.array([1, 0] * 20)); out = quality.raw_scores(m, [text])",
    "op3": "language; m = language.fit(['a b c', 'x y z'] * 20, np.array([0, 1] * 20), 2); out = language.predict(m, [text])[:, :1]",
    "op4": "near_text; out = near_text.shingle_sets([text])",
    "op5": "pack; out = [pack.token_ids(pack._encoder('byte_bpe_50k'), text)]",
}


@pytest.mark.parametrize("kind", LONG)
@pytest.mark.parametrize("op", WORK)
def test_memory_of_one_process_stays_under_a_gigabyte(op, kind):
    code = f"import numpy as np, resource; text = {LONG[kind]}; from lumenframe.llm import {WORK[op]}; print(len(out), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ROOT}, timeout=300, check=True)
    rows, peak = map(int, done.stdout.split())
    assert rows == 1 and peak < 1000, done.stdout


def test_ids_equal_the_library_at_long_blank_runs(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), pack._encoder("byte_bpe_50k")
    for text in (" " * 1_200_000, "\n" * 1_200_000 + "a", "ab" + " \t" * 600_000 + "b c", "x　" + "　" * 1_100_000 + "<|endoftext|> y"):
        assert pack.token_ids(encoder, text).tolist() == [*library.encode(text, add_special_tokens=False).ids, pack.END]
    monkeypatch.setattr(pack, "LONG_BLANK", 4)
    monkeypatch.setattr(pack, "_LONG_BLANK", re.compile(pack._LONG_BLANK.pattern.replace("50000", "4")))
    rng = np.random.default_rng(0)
    marks = [" ", " ", " ", "\n", "\t", "\xa0", "　", "\x1c", "\x85", "a", "Z", "1", "#", "é", "<|endoftext|>", "'s"]
    for _ in range(1500):
        text = "".join(rng.choice(marks, size=int(rng.integers(0, 40))))
        assert pack.token_ids(encoder, text).tolist() == [*library.encode(text, add_special_tokens=False).ids, pack.END], repr(text)


def test_range_hashes_and_sums_by_any_stretch(monkeypatch):
    rng = np.random.default_rng(1)
    data, inside = rng.integers(0, 256, 400).astype(np.uint8), rng.random(400) < 0.8
    inside[0] = inside[-1] = False
    first, last = words.ranges(inside)
    want = [sum((int(c) + 1) * pow(31, i, 1 << 64) for i, c in enumerate(data[a:b])) % (1 << 64) for a, b in zip(first, last, strict=True)]
    values = rng.random((400, 2))
    whole = words.stretches
    for stretch in (3, 64, 1000):
        monkeypatch.setattr(words, "stretches", lambda n, _=0, k=stretch: whole(n, k))
        assert words.hashes(data, first, last, 31, add=1).tolist() == want
        out = np.zeros((len(first), 2))
        for a, b in whole(400, stretch):
            words.per_range(values[a:b], a, first, out)
        assert np.allclose(out, np.add.reduceat(values, first, axis=0))


@pytest.mark.parametrize("run", [1, 7, 40, 300])
def test_runs_of_a_chain_give_the_whole_chain(run, monkeypatch):
    monkeypatch.setattr(chain, "RUN", run)
    rng = np.random.default_rng(2)
    for n in (1, 33, 64, 400):
        e, t, s, w = rng.normal(size=(n, 3)) * 3, rng.normal(size=(3, 3)), rng.normal(size=3), rng.random(n) + 0.1
        whole = chain.forward_backward(e, np.array([n]), t, s)
        assert np.allclose(chain.mean_of_long(e, w, t, s), w @ whole / w.sum())


def test_scores_in_parts_equal_scores_at_once(monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["\n".join(" ".join(f"w{i}" for i in rng.integers(0, 50, 9)) for _ in range(30)), "", "\n\n", "x" * 3000, " lead\tand trail  ", "!! || ##\n" * 40, "é ñ 你好 " * 60]
    q = quality.fit(["good line here\nand more", "!!! $$$\n###"] * 30, np.array([1, 0] * 30))
    g = language.fit(["the a of", "der die das", "el la los"] * 20, np.array([0, 1, 2] * 20), 3)
    want = quality.raw_scores(q, texts), np.concatenate([language.predict(g, [t]) for t in texts])
    for together in (40, 500):
        monkeypatch.setattr(quality, "TOGETHER", together)
        monkeypatch.setattr(language, "TOGETHER", together)
        assert np.allclose(quality.raw_scores(q, texts), want[0]) and np.allclose(language.predict(g, texts), want[1], atol=1e-6)


def test_state_maps_compose_over_chunks_that_never_settle(monkeypatch):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, ours = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.Transducer(path)
    rng = np.random.default_rng(4)
    texts = ["a" * 3_000_000, "=" * 70_001, "ab" * 5000 + "a" * 5000, *("".join(rng.choice(list("aaab =e▁ \n.é你🙂"), size=900)) for _ in range(60))]
    want = [len(library.encode(t)) for t in texts]
    assert ours.count(texts).tolist() == want
    monkeypatch.setattr(token_counts, "CHUNK", 7)
    monkeypatch.setattr(token_counts, "TOGETHER", 40_000)
    assert ours.count(texts[1:]).tolist() == want[1:]
    monkeypatch.setattr(token_counts.Transducer, "follows", lambda *_: False)  # no item ends anything: the library counts
    assert token_counts.Transducer(path).count(texts[-3:]).tolist() == want[-3:]


def test_long_texts_pass_every_stage_and_query(spark, tmp_path):
    import __spark_entry__

    texts = [" " * 1_200_000 + "a b", "x" * 2_000_000, "a\n" * 600_000, "1 2" * 300_000, "mail a@b.co " * 3000, "plain words here", None]
    rows = [(i, t, "en", f"s{i % 2}", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(7)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = __spark_entry__.queries()
    for name, query in found.items():
        if re.match(r"op(1|[3-9]|10)_", name):
            ids = [r["doc_id"] for r in query(spark, str(tmp_path)).select("doc_id").distinct().collect()]
            assert sorted(ids) == list(range(7)), name
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, str(tmp_path)), f"long-{name}")
        assert docs.count() > 0, name


def test_shingles_of_a_word_beyond_any_stretch():
    assert [len(s) for s in near_text.shingle_sets(["x" * 3_000_000, "y " * 1_000_000])] == [1, 1]


def test_rows_go_to_an_operator_in_bounded_parts(monkeypatch):
    from lumenframe.llm import base

    monkeypatch.setattr(base, "STEP", 3)
    monkeypatch.setattr(base, "BYTES", 10)
    assert list(base._cuts([])) == [] and list(base._cuts([99])) == [(0, 1)]
    assert list(base._cuts([4, 4, 4, 1, 1, 1, 99, 2])) == [(0, 2), (2, 5), (5, 6), (6, 7), (7, 8)]
