import hashlib
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from lumenframe.llm import fingerprint, mix
from lumenframe.llm.fingerprint import fingerprints, op10_fingerprint, with_next


def water_fill(sizes):
    """Plain reshare of what capped sources can't take, by rounds."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    return target


def rows_of(sizes):
    return [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate((s, n) for s, ns in sizes.items() for n in ns)]


def test_targets_and_taken_words(spark):
    sizes = {"a": [3] * 40, "b": [50, 60, 1, 1], "é": [7], "c": [0, 0], None: [5, 6, 200], "d": [1000]}
    df = spark.createDataFrame(rows_of(sizes), "doc_id long, text string, source string")
    got = mix.mix(df).toPandas()
    want = water_fill({s: sum(n) for s, n in sizes.items()})
    for s, group in got.groupby(got["source"].fillna("none")):
        key = None if s == "none" else s
        assert abs(group["target"].iloc[0] - want[key]) < 1e-6
        assert abs(group["taken"].sum() - want[key]) <= 1
    assert (got["taken"] <= 3 * got["size"]).all() and (got["taken"] >= 0).all()
    again = mix.mix(df.repartition(5)).toPandas()
    assert got.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()


def test_inclusion_is_even_over_documents(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w w w w").alias("text"), F.when(F.col("id") < 3000, "a").otherwise("b").alias("source"))
    got = mix.mix(df, weights=(1, 1)).groupBy("source").agg(F.avg(F.col("taken") / F.col("size")).alias("m"), F.max("copies").alias("c"), F.min("copies").alias("f")).collect()
    assert {r["source"]: (round(r["m"], 3), r["c"], r["f"]) for r in got} == {"a": (0.667, 1, 0), "b": (2.0, 2, 2)}


def test_inclusion_follows_the_odds(spark):
    """Documents of a source differ in their inclusion probability; over many, the share taken is that probability."""
    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', CAST(pow(2, id % 8) AS int))").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    got = mix.mix(rows, weights=(1, 4)).selectExpr("source", "size", "inclusion", "CAST(taken / size AS double) AS held", "target", "taken").cache()
    by = got.groupBy("source", "size").agg(F.first("inclusion").alias("p"), F.avg(F.col("held") - F.floor(F.col("held"))).alias("part"), F.avg(F.floor("held")).alias("whole"), F.count("size").alias("n")).collect()
    assert len({r["p"] for r in by if r["source"] == "a"}) == 8  # truly unequal
    for source in "ab":
        group = got.where(F.col("source") == source)
        assert abs(group.agg(F.sum("taken")).first()[0] - group.first()["target"]) <= 1
    expected = {(r["source"], r["size"]): r["p"] for r in by}
    shares = got.where("source = 'a'").groupBy("size").agg(F.avg("held").alias("held")).collect()
    for r in shares:
        p = expected["a", r["size"]]
        assert abs(r["held"] % 1 - p) < 5 * (p * (1 - p) / 2500) ** 0.5 + 0.01, (r["size"], r["held"], p)
    copies = sorted((r["size"], r["held"]) for r in shares)
    assert all(a[1] < b[1] for a, b in zip(copies, copies[1:], strict=False))


def test_emitted_rows_hold_the_taken_words(spark):
    sizes = {"a": [3, 9, 4, 5], "b": [4000, 2, 1], "c": [6]}
    df = spark.createDataFrame(rows_of(sizes), "doc_id long, text string, source string")
    mixed = mix.mix(df)
    out = mix.emit(mixed).toPandas()
    words = out.groupby("doc_id")["text"].apply(lambda ts: sum(len(re.findall(r"\S+", t)) for t in ts))
    taken = mixed.where("taken > 0").toPandas().set_index("doc_id")["taken"]
    assert words.to_dict() == taken.to_dict()
    assert out.columns.tolist() == ["doc_id", "text", "source"]


def test_mix_odd_and_empty_tables(odd, none):
    got = mix.mix(odd)
    assert got.count() == odd.count() and mix.mix(none).count() == 0
    assert got.where("source IS NULL").agg(F.max("source_size") > 0).first()[0]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(*values, seed=42):
    """The engine's 64-bit hash of whole numbers, each given with its struct format."""
    for value, kind in values:
        seed = xxhash.xxh64(struct.pack(kind, value), seed=seed).intdigest()
    return signed(seed)


def plain_sketch(text):
    """Order MinHash by its definition: sort all numbered k-mers under each permutation."""
    tokens = re.findall("[\x21-\u024f]{1,16}|[^\x20\x09-\x0d]", text)
    hashes = [signed(xxhash.xxh64(t.encode(), seed=42).intdigest()) for t in tokens]
    if not hashes:
        return []
    kmers = [chained(*[(h, "<q") for h in hashes[i : i + fingerprint.K]]) for i in range(len(hashes) - fingerprint.K + 1)] or [chained((hashes[0], "<q"))]
    seen, numbered = {}, []
    for at, x in enumerate(kmers):
        name = x >> fingerprint.POSITION
        often = seen[name] = seen.get(name, -1) + 1
        numbered.append(((chained((name, "<q"), (often, "<i")) & (1 << 64) - 1) >> 1 >> fingerprint.POSITION, at))
    out = []
    for c in fingerprint.CONSTANTS:
        least = sorted((h ^ (c >> fingerprint.POSITION), at) for h, at in numbered)[: fingerprint.TUPLE]
        tuple_hash = fingerprint.SIZE
        for at in sorted(at for _, at in least):
            tuple_hash = chained((tuple_hash, "<q"), (kmers[at], "<q"))
        out.append(tuple_hash >> 32)
    return out


def as_hex(sketch):
    return "".join(f"{x & 0xFFFFFFFF:08X}" for x in sketch)


def plain_likeness(a, b):
    return 1.0 if not a and not b else sum(x == y for x, y in zip(a, b, strict=False)) / fingerprint.SIZE


def test_occurrence_numbers_tell_repeats_apart(spark):
    texts = ["a b c d e f g h", "a b c d e f g h", "a b c a b c a b c a b c", "a b c a b c", "h g f e d c b a", "", None, "a"]
    got = fingerprints(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")).collect()
    f = {r["i"]: r["fingerprint"] for r in got}
    assert f[0] == f[1] and f[2] != f[3] and f[0] != f[4] and f[5] == f[6] == "" and len(f[7]) == 8 * fingerprint.SIZE


def test_sketch_against_plain_python(spark):
    texts = ["", "a", "a b", "a b c", "z " * 20, "z " * 21, "a b c " * 40, "ä 你好 x", "x" * 100, " ".join(str(i % 700) for i in range(3000))]
    rows = fingerprint.with_sketch(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), F.col("text"), "s").collect()
    assert {r["i"]: r["s"] for r in rows} == {i: plain_sketch(t) for i, t in enumerate(texts)}


def test_long_repeats_number_every_occurrence(spark):
    """Of n equal k-mers each is an element of its own; order and number alone tell these texts apart."""
    texts = ["b " + "z " * n for n in (20, 60, 2000)] + ["z " * 60 + "b"]
    rows = fingerprint.with_sketch(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), F.col("text"), "s").collect()
    assert len({tuple(r["s"]) for r in rows}) == 4


def test_likeness_falls_with_edits(spark):
    base = [f"w{i}" for i in range(400)]
    edits = {0: base, 5: [*base[:50], *(f"x{i}" for i in range(5)), *base[55:]], 100: [*base[:300], *(f"x{i}" for i in range(100))], 400: [f"x{i}" for i in range(400)]}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in edits.items()], "k int, text string")
    s = fingerprint.with_sketch(df, F.col("text"), "s")
    own = s.where("k = 0").select(F.col("s").alias("o"))
    near = {r["k"]: r["l"] for r in s.crossJoin(own).select("k", fingerprint.likeness(F.col("s"), F.col("o")).alias("l")).collect()}
    assert near[0] == 1 and near[0] > near[5] > near[100] > near[400] == 0


def test_next_row_over_range_bounds(spark):
    ids = [7, 3, 100, 50, 51, 52, 3_000_000_000, -5, 9, 10]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    order = sorted(ids)
    for buckets in (1, 3, 50):
        got = {r["doc_id"]: r["next"]["text"] for r in with_next(df, "doc_id", ["text"], buckets).collect()}
        assert got == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}
    assert with_next(df.limit(0), "doc_id", ["text"], 4).count() == 0
    assert [r["next"]["text"] for r in with_next(df.where("doc_id = 7"), "doc_id", ["text"], 4).collect()] == ["t7"]
    assert with_next(df.union(df).union(spark.createDataFrame([(None, "n")], df.schema)), "doc_id", ["text"], 4).count() == 21


@pytest.mark.parametrize("buckets", [1, 4])
def test_next_row_by_text_ids_and_clashing_names(spark, buckets):
    ids = [f"doc-{i}" for i in (3, 20, 100, 7)] + ["ä", "", None]
    df = spark.createDataFrame([(i, f"t{i}", 1, "k", "r") for i in ids], "doc_id string, text string, bucket int, key string, row string")
    got = with_next(df, "doc_id", ["text"], buckets)
    order = [None, *sorted((i for i in ids if i is not None), key=str.encode)]
    assert {r["doc_id"]: r["next"]["text"] for r in got.collect()} == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}
    assert got.columns == [*df.columns, "next"]


def test_query_against_plain_python(spark, sf):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in op10_fingerprint(spark, sf).collect()}
    sketches = {text: plain_sketch(text) for _, text in docs}
    for i, (doc, text) in enumerate(docs):
        nxt, half, r = docs[(i + 1) % len(docs)][1], len(text) // 2, got[doc]
        edited = text[: len(text) - half] + nxt[:half]
        own, changed = sketches[text], plain_sketch(edited)
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (as_hex(own), as_hex(changed))
        assert (r["near_edited"], r["near_next"]) == (plain_likeness(own, changed), plain_likeness(own, sketches[nxt]))


def test_fingerprint_odd_and_empty_tables(odd, none):
    assert fingerprints(odd).count() == odd.count() and fingerprints(none).count() == 0
