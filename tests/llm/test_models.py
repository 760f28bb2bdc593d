import numpy as np

from lumenframe.llm import chain, language, quality


def test_forward_backward_equals_the_plain_recursion():
    rng = np.random.default_rng(1)
    sizes = np.array([1, 5, 31, 32, 33, 64, 65, 200])
    e, t, s = rng.normal(size=(sizes.sum(), 4)), rng.normal(size=(4, 4)), rng.normal(size=4)
    p, pairs, first = chain.forward_backward(e, sizes, t, s, pairs=True)
    at, total, begins = 0, 0, 0
    for n in sizes:
        x, a = np.exp(e[at : at + n]), np.exp(t)
        f = [np.exp(s) * x[0]]
        for k in range(1, n):
            f.append((f[-1] @ a) * x[k])
            f[-1] /= f[-1].sum()
        b = [np.ones(4)]
        for k in range(n - 1, 0, -1):
            b.insert(0, a @ (x[k] * b[0]))
            b[0] /= b[0].sum()
        q = np.array(f) * np.array(b)
        q /= q.sum(axis=1, keepdims=True)
        assert np.allclose(q, p[at : at + n])
        for k in range(1, n):
            m = f[k - 1][:, None] * a * (x[k] * b[k])[None]
            total = total + m / m.sum()
        begins = begins + q[0]
        at += n
    assert np.allclose(total, pairs) and np.allclose(begins, first)


def held_out_accuracy(spark, rows, truth, pred):
    joined = rows.where("held_out").join(truth, "doc_id")
    total = joined.count()
    return joined.where(f"{truth.columns[1]} = {pred}").count() / total, total


def test_language_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    accuracy, n = held_out_accuracy(spark, language.op3_language(spark, d), truth, "lang_pred")
    assert n > 250 and accuracy > 0.98


def test_quality_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    accuracy, n = held_out_accuracy(spark, quality.op1_quality(spark, d), truth, "predicted")
    assert n > 70 and accuracy > 0.96


def test_code_switched_text_keeps_its_passages_apart():
    texts = ["the cat and the dog were there"] * 8 + ["der hund und die katze waren da"] * 8
    model = language.fit(texts, np.repeat([0, 1], 8), 2, passes=12, batch=4)
    words = language.Words([b"the dog and the cat der hund und die katze"])
    p = chain.forward_backward(words.emissions(model["tables"]), words.counts, model["transitions"], model["start"])
    assert p[0, 0] > 0.5 and p[-1, 1] > 0.5


def test_a_long_text_in_parts_scores_alike(monkeypatch):
    texts = ["the cat and the dog were there"] * 4 + ["der hund und die katze waren da"] * 4
    model = language.fit(texts, np.repeat([0, 1], 4), 2, passes=4, batch=4)
    long = ["the dog and the cat " * 200 + "der hund und die katze " * 100]
    whole = language.predict(model, long)
    monkeypatch.setattr(language, "TOGETHER", 500)
    assert np.allclose(language.predict(model, long), whole, atol=0.02)


def test_language_odd_and_empty_tables(odd, none):
    model = language.train(odd)
    got = {r["doc_id"]: r for r in language.identify(odd, model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (0, 1, 2, 10, 13)) and got[3]["lang_pred"] == "en"
    assert language.identify(none, model).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd, language.train(none)).collect()} == {"und"}


def test_quality_odd_and_empty_tables(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(3, 12)] + [(None, 1), (5, None), (6, 7)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    scores = [r["score"] for r in quality.score_quality(odd, model).collect()]
    assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
    assert quality.score_quality(none, model).count() == 0 and quality.train(odd, labels.limit(0)) is None
    assert {r["score"] for r in quality.score_quality(odd, None).collect()} == {0.5}


def test_words_of_switched_text_bear_their_own_language(spark):
    rng = np.random.default_rng(7)
    english, german = "the cat and dog were there with them all day".split(), "der hund und die katze waren da mit ihnen heute".split()
    say = lambda words, n: " ".join(words[i] for i in rng.integers(0, len(words), n))
    texts = [say(english, 12) for _ in range(60)] + [say(german, 12) for _ in range(60)]
    model = language.fit(texts, np.repeat([0, 1], 60), 2, passes=6, batch=16) | {"classes": ["de" if i else "en" for i in (0, 1)]}
    one, two, three = say(english, 9), say(german, 7), say(english, 11)
    switched = f"{one} {two}\n{three}"
    df = spark.createDataFrame([(1, switched, "x"), (2, "", "y"), (3, None, "z"), (4, one, "é")], "i int, text string, passages string")
    got = {r["i"]: r["passages"] for r in language.label_words(df, model).collect()}
    assert [(switched[p["start"] : p["end"]], p["lang"]) for p in got[1]] == [(one, "en"), (two, "de"), (three, "en")]
    assert got[2] == got[3] == [] and [p["lang"] for p in got[4]] == ["en"] and all(0.5 < p["score"] <= 1 for p in got[1])
    assert (model["transitions"].diagonal() > [model["transitions"][0, 1], model["transitions"][1, 0]]).all()


def test_lines_are_labelled_among_their_neighbours(spark, monkeypatch):
    good, bad = "Here is a line of plain words.", "$$$ !!! ||| ###"
    texts = ["\n".join([good] * n) for n in (3, 5, 8)] * 10 + ["\n".join([bad] * n) for n in (3, 5, 8)] * 10
    model = quality.fit(texts, np.repeat([1, 0], 30))
    mixed = "\n".join([good] * 4 + [bad] * 5 + [good] * 3)
    df = spark.createDataFrame([(1, mixed), (2, None), (3, "\n\n")], "i int, text string")
    got = {r["i"]: r["lines"] for r in quality.label_lines(df, model).collect()}
    assert [p > 0.5 for p in got[1]] == [True] * 4 + [False] * 5 + [True] * 3 and len(got[2]) == 1 and len(got[3]) == 3
    monkeypatch.setattr(quality, "TOGETHER", 60)
    assert np.allclose(quality.line_probabilities(model, [mixed])[0], got[1])
