"""MinHash near-dedup by a multi-index Hamming join over signatures, confirmed on full shingle sets.

A signature has CHUNKS * SYMBOLS MinHash symbols. Two signatures that differ in at most
CHUNKS * (ERRORS + 1) - 1 symbols have, by the pigeonhole principle, a chunk that differs in at most ERRORS.
So each chunk is indexed under every choice of SYMBOLS - ERRORS of its symbols, and two such signatures are
sure to meet under one key. What meets, and differs in at most DISTANCE symbols, is compared by whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.graph import connected_components as components
from ..plans.scratch import step
from ..plans.spread import LEAST, PARTS, spread_join
from .base import documents, lean, saved, text_of
from .words import hashes, ranges

WORDS, PERCENT = 5, 75
CHUNKS, SYMBOLS, ERRORS = 6, 6, 2
#: At a similarity of exactly 0.75 a pair differs in 9 of 36 symbols on average, in more than 24 once in 38 million
#: times. It meets under no key once in 42,000 times: none of the chunks has then SYMBOLS - ERRORS equal symbols.
DISTANCE = 24
_MASKS = np.array([*combinations(range(SYMBOLS), SYMBOLS - ERRORS)])
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 63, CHUNKS * SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, CHUNKS * SYMBOLS, dtype=np.uint64)
#: One-bit symbols of the longer sketch, and the most that may differ: at a similarity of 0.75 an eighth does, with a
#: deviation of 15; four and a half deviations are allowed, so a pair is lost once in 210,000 times.
BITS, MOST_BITS = 2048, 2048 // 8 + 68
BLOCK = 1024
#: Chunks whose keys the first round looks at.
FIRST_CHUNKS = 2
#: Bytes hashed together.
TOGETHER = 700_000
#: One node in this many tells which keys are held by many.
SHARE = 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes.

    Short texts are hashed together; a long one alone, for some 40 bytes a word beside the text.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    out: list[np.ndarray] = []
    at = 0
    while at < len(raw):
        end, held = at, 0
        while end < len(raw) and (end == at or held + len(raw[end]) <= TOGETHER):
            held += len(raw[end]) + 1
            end += 1
        out += _sets(*_words(raw[at:end]))
        at = end
    return out


def _words(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, and each text's range among them."""
    data = _FOLD[np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)]
    first, last = ranges(~_BLANK[data])
    word = _mix(hashes(data, first, last, _BASE, add=1) + (last - first).astype(np.uint64) * _ODD)
    sizes = np.array([len(r) for r in raw], np.int64) + 1
    begin = np.cumsum(sizes) - sizes + 1
    lo = np.searchsorted(first, begin)
    hi = np.searchsorted(first, begin + sizes)
    return word, lo, hi


def _sets(word: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    """The distinct runs of words of each range."""
    run = word[: max(0, len(word) - WORDS + 1)].copy()
    for k in range(1, WORDS):
        run = _mix(run * _ODD + word[k : len(run) + k])
    out = []
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(run[a : b - WORDS + 1]))
        elif b > a:
            one = word[a : a + 1].copy()
            for k in range(a + 1, b):
                one = _mix(one * _ODD + word[k : k + 1])
            out.append(_mix(one + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash symbols, one row per non-empty set."""
    sizes = np.array([len(s) for s in sets])
    whole = np.concatenate(sets)
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), len(_A)), np.uint32)
    for k, (a, b) in enumerate(zip(_A, _B, strict=True)):
        out[:, k] = np.minimum.reduceat((whole * a + b) >> np.uint64(32), starts)
    return out


def _digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name a set."""
    sizes = np.array([len(s) for s in sets])
    whole, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
    return np.add.reduceat(_mix(whole), starts), np.add.reduceat(_mix(whole ^ _ODD), starts) + sizes.astype(np.uint64)


def index_keys(sig: np.ndarray) -> np.ndarray:
    """For each signature one key per chunk and choice of symbols."""
    parts = sig.reshape(len(sig), CHUNKS, SYMBOLS)[:, :, _MASKS].astype(np.uint64)
    key = np.broadcast_to((np.arange(CHUNKS)[:, None] * len(_MASKS) + np.arange(len(_MASKS))).astype(np.uint64), parts.shape[:3])
    for k in range(parts.shape[3]):
        key = _mix(key * _ODD + parts[..., k])
    return key.reshape(len(sig), -1).view(np.int64)


def _described(rows: DataFrame) -> DataFrame:
    """From (id, text): id, n_shingles, k1, k2 and the signature (null for an empty set)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            step = 512
            for at in range(0, len(texts), step):
                sets = shingle_sets(texts[at : at + step])
                n = np.array([len(s) for s in sets], np.int64)
                full = [s for s in sets if len(s)]
                k1, k2 = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
                sig = np.full(len(sets), None, object)
                if full:
                    a, b = _digests(full)
                    k1[n > 0], k2[n > 0] = a.view(np.int64), b.view(np.int64)
                    for i, one in zip(np.flatnonzero(n).tolist(), signatures(full).view(np.int32), strict=True):
                        sig[i] = one
                yield pd.DataFrame({"id": batch["id"].iloc[at : at + step].to_numpy(), "n_shingles": n, "k1": k1, "k2": k2, "sig": sig})

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, n_shingles long, k1 long, k2 long, sig array<int>")


def _keyed(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                yield pd.DataFrame({"node": part["node"].to_numpy(), "keys": list(index_keys(np.stack(part["sig"].to_numpy()).view(np.uint32)))})

    return nodes.select("node", "sig").mapInPandas(run, "node long, keys array<long>").select(F.posexplode("keys").alias("slot", "key"), "node")


def _sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One-bit MinHash symbols, packed, one row per non-empty set."""
    sizes = np.array([len(x) for x in sets])
    whole, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
    rng = np.random.default_rng(77)
    bits = np.empty((len(sets), BITS), bool)
    for k in range(BITS):
        a, b = rng.integers(0, 1 << 63, 2, dtype=np.uint64)
        least = np.minimum.reduceat((whole * (a | np.uint64(1)) + b) >> np.uint64(32), starts)
        bits[:, k] = (_mix(least) & np.uint64(1)).astype(bool)
    return np.packbits(bits, axis=1)


def _canonical(same: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Whether ``slot`` is the first under which a pair with these equal symbols meets; so each pair counts once."""
    parts = same.reshape(len(same), CHUNKS, SYMBOLS)
    enough = parts.sum(axis=2) >= SYMBOLS - ERRORS
    chunk = enough.argmax(axis=1)
    mine = parts[np.arange(len(same)), chunk]
    mine &= np.cumsum(mine, axis=1) <= SYMBOLS - ERRORS
    masks = np.zeros((len(_MASKS), SYMBOLS), bool)
    masks[np.arange(len(_MASKS))[:, None], _MASKS] = True
    return (chunk == slot // len(_MASKS)) & (mine == masks[slot % len(_MASKS)]).all(axis=1)


def _nearest_only(u: np.ndarray, v: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Pairs that are the nearest of one of their ends."""
    ends, other = np.concatenate([u, v]), np.concatenate([v, u])
    at = np.tile(np.arange(len(u)), 2)
    order = np.lexsort((other, np.tile(d, 2), ends))
    first = np.unique(ends[order], return_index=True)[1]
    return np.unique(at[order[first]])


def _compare(rows: pd.DataFrame, exhaustive: bool) -> pd.DataFrame | None:
    """Candidate pairs of the block pairs in ``rows``, which are sorted by task."""
    task, node, root, block, slot = (rows[c].to_numpy() for c in ("task", "node", "root", "block", "slot"))
    within = (rows["i"] == rows["j"]).to_numpy()
    sig = np.stack(rows["sig"].to_numpy())
    bits = np.frombuffer(b"".join(rows["bits"]), np.uint64).reshape(len(rows), -1) if exhaustive else None
    found = []
    for step in range(1, len(rows)):  # all pairs of a task are the rows step apart, for each step
        x = np.flatnonzero(task[:-step] == task[step:])
        if not len(x):
            break
        x = x[(root[x] != root[x + step]) & (within[x] | (block[x] != block[x + step]))]
        for at in range(0, len(x), 20_000):
            a = x[at : at + 20_000]
            same = sig[a] == sig[a + step]
            d = CHUNKS * SYMBOLS - same.sum(axis=1)
            near = d <= DISTANCE
            a, d = a[near], d[near]
            ours = _canonical(same[near], slot[a])
            a, d = a[ours], d[ours]
            if exhaustive and len(a):
                close = np.bitwise_count(bits[a] ^ bits[a + step]).sum(axis=1) <= MOST_BITS
                a, d = a[close], d[close]
            if len(a):
                found.append((np.minimum(node[a], node[a + step]), np.maximum(node[a], node[a + step]), d))
    if not found:
        return None
    u, v, d = (np.concatenate(c) for c in zip(*found, strict=True))
    if not exhaustive:
        keep = _nearest_only(u, v, d)
        u, v, d = u[keep], v[keep], d[keep]
    return pd.DataFrame({"u": u, "v": v, "d": d})


def _apart(held: DataFrame) -> DataFrame:
    """Keys under which different roots meet, with their number of nodes; merged before the exchange."""
    return held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("key", "n")


def _candidates(held: DataFrame, payload: DataFrame, exhaustive: bool) -> DataFrame:
    """Pairs (u, v, d) of different roots under one key of ``held(key, slot, node, root)``.

    A key's nodes are compared in blocks of BLOCK, each pair of blocks a task of its own, so no task grows with a
    key. With ``exhaustive`` every pair within DISTANCE whose sketches allow the wanted similarity returns, once;
    without, only some nearest pairs do.
    """
    keys = _apart(held).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    listed = spread_join(held, keys, ["key"], "n", held.count(), ["node"])
    listed = listed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    listed = listed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    listed = listed.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    listed = listed.select(F.xxhash64("key", "i", "j").alias("task"), "slot", "i", "j", "block", "node", "root").join(payload, "node")
    dealt = listed.repartition("task").sortWithinPartitions("task")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None  # the last task of a batch may go on in the next
        for batch in batches:
            batch = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            task = batch["task"].to_numpy()
            apart = np.flatnonzero(task != task[-1]) if len(task) else task
            done = int(apart[-1]) + 1 if len(apart) else 0
            if done and (made := _compare(batch.iloc[:done], exhaustive)) is not None:
                yield made
            kept = batch.iloc[done:]
        if kept is not None and len(kept) > 1 and (made := _compare(kept, exhaustive)) is not None:
            yield made

    return dealt.mapInPandas(run, "u long, v long, d long")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose whole sets are alike enough."""
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    # Neither 100 * both >= percent * (na + nb - both) nor its sides overflow.
    found = pairs.join(left, "u").join(right, "v").withColumn("both", both.cast("long"))
    return found.where((100 + percent) * F.col("both") >= percent * (F.size("a") + F.size("b")).cast("long")).select("u", "v")


def near_duplicates(df: DataFrame, text_col: str = "text", *, id_col: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable over links), kept.

    Texts are lower-cased in A-Z and cut into words at ASCII white space; a set holds the distinct runs of five
    words, the whole sequence for fewer. Null texts count as empty; an empty set links with nothing. Rows of equal
    sets are linked and stand as one node from then on. Rows repeating an id are treated each by its text, and
    all rows of the least id are kept. Rows without an id link like others; a component of such rows alone has a null
    id, and all its rows are kept. Only the id column is carried. An empty table gives no rows.

    Nodes under one key are compared in two rounds. The first confirms some nearest pairs, which joins most groups
    of copies; it only saves work. The second confirms every pair of different components that is within DISTANCE
    and that a longer sketch doesn't rule out.
    """
    lean(df.sparkSession)
    with step(df.sparkSession):
        described, told, count = _components(df.select(df[id_col].alias("id"), text_of(df, text_col).alias("text")), percent)
    out = spread_join(described, told, ["k1", "k2"], "copies", count, ["id"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def _components(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, int]:
    """From (id, text): the described rows, what the sets of linked or repeated ones are told, and the number of rows."""
    described = saved(_described(rows), "shingled", keep=True)
    count = described.count()
    groups = described.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    groups = saved(groups.withColumnRenamed("k1", "node"), "groups", count)
    first = described.join(groups.select(F.col("rep").alias("id"), F.col("node").alias("k1"), "k2"), ["id", "k1", "k2"]).select(F.col("k1").alias("node"), "sig", "id")
    # Sets held only by rows without an id have no such row to stand for them; any will do.
    nameless = described.where("id IS NULL").join(groups.where("rep IS NULL").select(F.col("node").alias("k1"), "k2"), ["k1", "k2"])
    first = first.unionByName(nameless.select(F.col("k1").alias("node"), "sig", "id").dropDuplicates(["node"]))
    # Keys of many nodes are known beforehand from the keys of one node in SHARE; such a key's nodes need not be sorted
    # in one place to see that there are others.
    sample = described.where((F.col("n_shingles") > 0) & (F.pmod(F.xxhash64("k1"), F.lit(SHARE)) == 0)).select(F.col("k1").alias("node"), "sig").dropDuplicates(["node"])
    most = max(LEAST, -(-count // PARTS))
    heavy = _keyed(sample).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("n") * SHARE > most))
    heavy = heavy.select("key", F.ceil(F.col("n") * SHARE / most).alias("pieces"))  # at most PARTS for each key of a node
    keyed = _keyed(first).join(F.broadcast(heavy), "key", "left").withColumn("piece", F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("node"), F.col("pieces"))).otherwise(0))
    by_key = W.partitionBy("key", "piece").orderBy("node")
    keyed = keyed.withColumn("beside", F.coalesce("pieces", F.lead("node").over(by_key), F.lag("node").over(by_key)))
    buckets = saved(keyed.where("beside IS NOT NULL").select("key", F.col("slot").cast("long").alias("slot"), "node"), "buckets")
    wanted = saved(first.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "sig", "id"), "wanted", count)
    texts = rows.join(wanted.select("id").distinct(), "id", "left_semi").unionByName(rows.where("id IS NULL"))
    sets = saved(_shingled(texts).join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")

    some = buckets.where(F.col("slot") < FIRST_CHUNKS * len(_MASKS)).withColumn("root", F.col("node"))
    pairs = _candidates(some, wanted.select("node", "sig"), False).groupBy("u", "v").agg(F.min("d").alias("d"))
    nth = F.row_number().over(W.partitionBy("v").orderBy("d", "u"))
    pairs = saved(pairs.withColumn("nth", nth).where("nth <= 3").select("u", "v"), "pairs", 3 * count)
    links = saved(_linked(pairs, sets, percent), "linked")
    roots = saved(components(links), "roots", count)
    held = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    held = saved(held, "rooted")
    held = saved(spread_join(held, _apart(held), ["key"], "n", held.count(), ["node"]), "apart")
    sketched = saved(_sketched(sets.join(held.select("node").distinct(), "node", "left_semi")), "sketches")
    payload = wanted.select("node", "sig").join(sketched, "node")
    pairs = saved(_candidates(held, payload, True).select("u", "v").join(pairs, ["u", "v"], "left_anti"), "pairs")
    links = links.unionByName(saved(_linked(pairs, sets, percent), "linked"))
    roots = saved(components(links), "roots", count)

    # Only groups that hold more than one row need to be told their component.
    joined = groups.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    label = joined.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = spread_join(joined, saved(label, "labels", count), ["root"], "n", count, ["node"], "left").where("copies > 1 OR component_id IS NOT NULL")
    told = joined.select(F.col("node").alias("k1"), "k2", F.coalesce("component_id", "rep").alias("component_id"), "copies")
    return described, saved(told, "told", count, keep=True), count


def _shingled(rows: DataFrame) -> DataFrame:
    """From (id, text): node and its whole set of shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for at in range(0, len(texts), 256):
                sets = [s for s in shingle_sets(texts[at : at + 256]) if len(s)]
                if sets:
                    yield pd.DataFrame({"node": _digests(sets)[0].view(np.int64), "shingles": [s.view(np.int64) for s in sets]})

    return rows.select("text").mapInPandas(run, "node long, shingles array<long>")


def _sketched(sets: DataFrame) -> DataFrame:
    """From (node, shingles): node and its longer sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                bits = _sketches([np.asarray(x).view(np.uint64) for x in part["shingles"]])
                yield pd.DataFrame({"node": part["node"].to_numpy(), "bits": [b.tobytes() for b in bits]})

    return sets.select("node", "shingles").mapInPandas(run, "node long, bits binary")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
