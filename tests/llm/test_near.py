import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.llm import near_text, near_vector
from lumenframe.operators.graph import connected_components as components
from lumenframe.llm.near_text import near_duplicates
from lumenframe.llm.near_vector import near_vectors


def brute_sets(t):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAb \n\t\x1fé\xa0", max_size=60), min_size=1, max_size=12))
def test_shingle_sets_equal_plain_sets(texts):
    made = near_text.shingle_sets(texts)
    plain = [brute_sets(t) for t in texts]
    assert [len(m) for m in made] == [len(p) for p in plain]
    for a, p in zip(made, plain, strict=True):
        for b, q in zip(made, plain, strict=True):
            assert len(np.intersect1d(a, b)) == len(p & q)


def test_a_long_text_in_parts_has_the_same_set(monkeypatch):
    texts = [" ".join(f"w{i % 83}" for i in range(700)), "a\tb\nc d e f g", "x" * 900, "tail " * 300]
    whole = near_text.shingle_sets(texts)
    for together in (10, 111, 1000):
        monkeypatch.setattr(near_text, "TOGETHER", together)
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(near_text.shingle_sets(texts), whole, strict=True))


def test_keys_meet_within_the_guaranteed_distance():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 32, (300, 36), dtype=np.uint32)
    b = a.copy()
    for row in b:  # CHUNKS * (ERRORS + 1) - 1 symbols at random places
        row[rng.choice(36, near_text.CHUNKS * (near_text.ERRORS + 1) - 1, replace=False)] += 1
    ka, kb = near_text.index_keys(a), near_text.index_keys(b)
    assert all(set(x) & set(y) for x, y in zip(ka.tolist(), kb.tolist(), strict=True))
    same = a == b
    chosen = [near_text._canonical(same[i : i + 1].repeat(90, 0), np.arange(90)) for i in range(50)]
    assert all(c.sum() == 1 for c in chosen)  # a pair counts under one key
    assert all(ka[i][c.argmax()] == kb[i][c.argmax()] for i, c in enumerate(chosen))


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [[f"t{rng.integers(400)}" for _ in range(80)] for _ in range(12)]
    texts = []
    for b in base:
        for edits in (0, 0, 1, 2, 3, 4, 6):
            w = list(b)
            for p in rng.choice(80, edits, replace=False):
                w[p] = f"n{rng.integers(10_000)}"
            texts.append(" ".join(w))
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: brute_sets(t) for i, t in rows}
    root = {i: i for i in sets}
    while True:
        moved = False
        for i in sets:
            for j in sets:
                n = len(sets[i] & sets[j])
                if root[j] < root[i] and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                    root[i], moved = root[j], True
        if not moved:
            break
    assert {i: got[i]["component_id"] for i in sets} == root
    assert {i: got[i]["n_shingles"] for i in sets} == {i: len(s) for i, s in sets.items()}
    assert all(got[i]["kept"] == (root[i] == i) for i in sets)


def test_large_groups_of_copies_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_text, "BLOCK", 8)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(60)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}


def test_odd_and_empty_tables(odd, none):
    got = near_duplicates(odd.drop("component_id", "kept")).collect()
    assert len(got) == odd.count() and near_duplicates(none).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert by[6]["component_id"] == 5 and by[7]["component_id"] == 5 and by[0]["n_shingles"] == 0 and by[2]["kept"]


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7)] + [(500, x) for x in range(501, 520)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {7: 7, **dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, **dict.fromkeys(range(500, 520), 500)}


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, 16))
    x = np.concatenate([centers[i % 12] + rng.normal(size=16) * 0.12 for i in range(240)]).reshape(240, 16)
    rows = [(i, [float(np.float32(v)) for v in x[i]], i % 2) for i in range(240)]
    rows += [(900, rows[5][1], rows[5][2]), (901, None, 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 0), (904, rows[5][1], None), (905, [], 1), (906, [1.0, None], 1)]
    got = {r["vec_id"]: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    ok = [r for r in rows if r[0] < 901]
    v = np.array([r[1] for r in ok], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([r[2] for r in ok])
    a = (v @ v.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(a, False)
    ids = np.array([r[0] for r in ok])
    c = ids.copy()
    while True:
        low = np.minimum(c, np.where(a, c[None], 10**6).min(axis=1))
        if (low == c).all():
            break
        c = low
    assert [got[i]["n_links"] for i in ids] == a.sum(axis=1).tolist()
    assert [got[i]["component_id"] for i in ids] == c.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(901, 907))


def test_very_small_and_large_vectors_keep_their_direction(spark):
    rows = [(1, [1e-200, 2e-200], 0), (2, [1e200, 2e200], 0), (3, [1.0, 2.0], 0), (4, [2.0, -1.0], 0)]
    got = {r["vec_id"]: r["n_links"] for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 0}


def test_vectors_of_an_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_a_pair_of_many_differing_symbols_is_found(spark):
    """Two texts at exactly 0.75 whose signatures differ in 20 of 36 symbols."""
    words = [f"s1253w{i}" for i in range(74)]
    texts = [" ".join(words), " ".join(words[:64] + [f"t1253w{i}" for i in range(10)])]
    sig = near_text.signatures(near_text.shingle_sets(texts))
    assert (sig[0] != sig[1]).sum() == 20
    got = near_text.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {0: 0, 1: 0}


@pytest.mark.parametrize("shift", [0, 2])
def test_vectors_that_share_a_direction_are_told_apart(spark, shift):
    """Links against brute force and candidate pairs under a twentieth of all, with and without a common direction."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(10_000, 64)) + shift
    noise = rng.normal(size=base.shape)
    noise *= (rng.uniform(0, 0.19, len(base)) * np.linalg.norm(base, axis=1) / np.linalg.norm(noise, axis=1))[:, None]
    x = np.concatenate([base, base + noise])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.zeros(len(x), int)
    for at in range(0, len(x), 2000):
        want[at : at + 2000] = (u[at : at + 2000] @ u.T >= 0.98).sum(axis=1) - 1
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "label": "one", "embedding": x.tolist()})).repartition(8)
    got = near_vectors(df).toPandas().sort_values("vec_id")["n_links"].to_numpy()
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum()
    nodes = df.selectExpr("vec_id AS node", "embedding AS vector")
    pivots, nearest = near_vector.choose_pivots(nodes, 64, 0.98)
    top = np.argsort(-(u @ pivots.T), axis=1)[:, :nearest]
    held = np.zeros((len(u), len(pivots)), np.float32)
    np.put_along_axis(held, top, 1, axis=1)
    met = sum(int((held[at : at + 2000] @ held.T >= near_vector.SHARED).sum()) for at in range(0, len(u), 2000)) - len(u)
    assert met / (len(u) * (len(u) - 1)) < 0.05


def test_heavy_keys_and_groups_go_in_pieces(spark, monkeypatch):
    from lumenframe.plans import spread

    monkeypatch.setattr(spread, "LEAST", 4)
    monkeypatch.setattr(spread, "PARTS", 10)
    monkeypatch.setattr(near_text, "LEAST", 4)
    monkeypatch.setattr(near_text, "SHARE", 2)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words)] * 90 + [" ".join([*words[:58], f"x{i}", "y"]) for i in range(70)] + [f"lone text {i} of its own" for i in range(20)]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == {i: 0 if i < 160 else i for i in range(180)}
    vectors = [(i, "a", [1.0, 2.0 + (i % 3) / 1000, 3.0]) for i in range(120)] + [(120, "a", [-1.0, 0.0, 0.0])]
    found = near_vectors(spark.createDataFrame(vectors, "vec_id long, label string, embedding array<double>").repartition(5)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found} == {i: (119, 0) if i < 120 else (0, 120) for i in range(121)}
