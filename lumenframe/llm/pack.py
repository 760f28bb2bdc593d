"""Packing by shortest-pack-first over the length histogram.

Documents become token pieces of at most one sequence; only the histogram of piece lengths (one number for each
length up to the sequence length) reaches the driver. There, lengths are placed longest first into the open
pattern with most room, a pattern standing for a range of sequences. The placements are ranges of ranks, so
each piece finds its sequence and offset from its rank among pieces of its length.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import documents, lean, saved, text_of

LENGTH = 2048
#: Parts into which the pieces of one length are dealt for ranking.
PARTS = 512
END = 1
_encoders: dict = {}
#: Blank runs from this length on go round the encoder's pattern, whose matcher has a bounded stack. The class is
#: the white space of that pattern.
LONG_BLANK = 50_000
_LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_BLANK)
SPECIAL = "<|endoftext|>"


def _encoder(name: str):
    """A byte-level encoder equal to the tokenizers library's for ``name``.json, from the same vocabulary as ranks.

    Its special string is found in texts, as that library does by default.
    """
    if name not in _encoders:
        import public_tokenizers as P
        import tiktoken

        with open(P.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[name] = tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
    return _encoders[name]


def token_ids(encoder, text: str) -> np.ndarray:
    """Ids of the whole text.

    A long blank run is cut out where the pattern would cut it: it ends before its last character if an ordinary
    word or mark follows, and is one item for the merges.
    """
    parts, at = [], 0
    for run in _LONG_BLANK.finditer(text) if len(text) >= LONG_BLANK else ():
        whole = run.end() == len(text) or text.startswith(SPECIAL, run.end())
        end = run.end() if whole else run.end() - 1
        parts.append(encoder.encode_to_numpy(text[at : run.start()], allowed_special="all"))
        parts.append(np.array(encoder._encode_single_piece(text[run.start() : end]), np.uint32))
        at = end
    parts.append(encoder.encode_to_numpy(text[at:] if at else text, allowed_special="all"))
    return np.append(np.concatenate(parts) if len(parts) > 1 else parts[0], END).astype("<u4")


def pieces(df: DataFrame, text_col: str = "text", *, id_col: str = "doc_id", length: int = LENGTH, vocabulary: str = "byte_bpe_50k", with_ids: bool = False) -> DataFrame:
    """Cut each row's tokens, with the end id, into pieces of ``length`` and one rest.

    Returns id, start, length, ids_crc32, doc_tokens, and the ids themselves where asked. Null texts count as
    empty and give one piece, the end id.
    """
    lean(df.sparkSession)
    rows = df.select(df[id_col].alias("id"), text_of(df, text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            at, out = [], []
            for i, text in enumerate(batch["text"]):
                ids = token_ids(encoder, text)
                for start in range(0, len(ids), length):
                    part = ids[start : start + length]
                    at.append(i)
                    out.append((start, len(part), zlib.crc32(part.tobytes()), len(ids), *([part.astype("int32")] * with_ids)))
            made = pd.DataFrame(out, columns=["start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])
            made.insert(0, "id", batch["id"].to_numpy()[at])
            yield made

    return rows.mapInPandas(run, schema)


def shortest_pack_first(histogram: dict[int, int], length: int = LENGTH) -> pd.DataFrame:
    """Placements of a histogram: (length, rank, n, sequence, offset, layers).

    Pieces of that length with ranks from ``rank`` on, n * layers of them, go to n sequences from ``sequence`` on,
    one layer after another from ``offset`` on. Lengths come longest first; each goes to the pattern with most
    room, or opens one. A pattern takes several layers while it stays the one with most room.
    """
    open_, plan, made, ties = [], [], 0, 0
    for size in sorted(histogram, reverse=True):
        left, rank = int(histogram[size]), 0
        while left:
            if not open_ or -open_[0][0] < size:
                plan.append((size, rank, left, made, 0, 1))
                if size < length:
                    heapq.heappush(open_, (size - length, ties := ties + 1, made, left))
                made, left = made + left, 0
                continue
            room, _, first, n = heapq.heappop(open_)
            room = -room
            next_room = -open_[0][0] if open_ else 0
            layers = max(1, min(left // n, (room - next_room) // size)) if left >= n else 1
            take = min(n, left)
            plan.append((size, rank, take, first, length - room, layers))
            rank, left = rank + take * layers, left - take * layers
            if room - size * layers > 0:
                heapq.heappush(open_, (size * layers - room, ties := ties + 1, first, take))
            if take < n:
                heapq.heappush(open_, (-room, ties := ties + 1, first + take, n - take))
    return pd.DataFrame(plan, columns=["length", "rank", "n", "sequence", "offset", "layers"])


def pack(df: DataFrame, text_col: str = "text", *, id_col: str = "doc_id", length: int = LENGTH, vocabulary: str = "byte_bpe_50k", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids where asked).

    Null and empty texts give one piece of one token. Repeated rows are packed each; pieces alike in id, start
    and content may stand for each other. Only the id column is carried. An empty table gives no rows.
    """
    cut = saved(pieces(df, text_col, id_col=id_col, length=length, vocabulary=vocabulary, with_ids=with_ids), "pieces")
    cut = cut.withColumn("part", F.pmod(F.xxhash64("id", "start"), F.lit(PARTS)).cast("int"))
    counts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``length`` rows
    plan = shortest_pack_first(histogram, length)
    before = counts.select("length", "part", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = cut.withColumn("nth", F.row_number().over(W.partitionBy("length", "part").orderBy("id", "start", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth")).drop("before", "nth", "part")
    by_size = {size: [g[c].to_numpy() for c in ("rank", "n", "sequence", "offset")] for size, g in plan.groupby("length")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, ranks = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.empty(len(batch), np.int64), np.empty(len(batch), np.int64)
            order = np.argsort(sizes, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(order) else []:
                size = int(sizes[group[0]])
                rank, n, first, at = by_size[size]
                k = np.searchsorted(rank, ranks[group], side="right") - 1
                layer, place = np.divmod(ranks[group] - rank[k], n[k])
                sequence[group], offset[group] = first[k] + place, at[k] + layer * size
            out = batch.drop(columns="rank")
            out["sequence_id"], out["offset"] = sequence, offset
            yield out

    columns = ["id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    ranked = ranked.select(*columns, "rank")
    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInPandas(run, schema).withColumnRenamed("id", id_col)


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
