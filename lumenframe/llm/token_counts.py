"""Token counts by a compiled finite-state transducer.

A merge tokenizer's encoding of a prefix is found from left to right: exactly one vocabulary item ends it and
stands validly after the encoding of what precedes it, and validity is a matter of neighbouring items alone.
So a state needs the longest suffix that may still grow into an item, and for each place inside it the item
that ends there with its count against now. That is a deterministic transducer over characters; each
transition carries by how much the count of emitted tokens changes. States are compiled as texts reach them
and kept in a hash table that NumPy reads for thousands of text chunks at once.

Each chunk gets a state map: for every state in which it can begin, its last state and its count. The states
in which it can begin are the start state and all last states of the chunk before; a run from a further one stops
where it meets the run from the start state (mostly within a word). The maps are tables of a few small numbers,
composed by a parallel prefix scan, which tells each chunk the state it really begins in. The sum of the
annotations is the text's count, equal to the library's.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import documents, text_of, with_columns

SPACE = "▁"
#: Characters of one chunk, characters run together, and the compiled states at which the table starts anew.
CHUNK, TOGETHER, MOST_STATES = 192, 3_000_000, 200_000
_FOREIGN = 0x110000
#: States tried at once on all chunks that don't settle.
SPREAD = 16


class Unmodelled(Exception):
    """The vocabulary has no item that ends a text read so far; the library then counts the texts."""


class Maps:
    """State maps of chunks: how each can begin, with its last state and count; column 0 is the start state."""

    def __init__(self, ends: np.ndarray, counts: np.ndarray):
        self.begins, self.ends, self.counts = np.zeros((len(ends), 1), np.int32), ends[:, None].copy(), counts[:, None].astype(np.int64)
        self.known = np.ones(len(ends), np.int64)

    def missing(self, lanes: np.ndarray, entry: np.ndarray) -> np.ndarray:
        return (self.begins[lanes] != entry[:, None]).all(axis=1)

    def add(self, lanes: np.ndarray, entry: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> None:
        if not len(lanes):
            return
        at = self.known[lanes]
        if at.max() == self.begins.shape[1]:
            wider = lambda x, fill: np.concatenate([x, np.full_like(x, fill)], axis=1)
            self.begins, self.ends, self.counts = wider(self.begins, -1), wider(self.ends, -1), wider(self.counts, 0)
        self.begins[lanes, at], self.ends[lanes, at], self.counts[lanes, at] = entry, ends, counts
        self.known[lanes] += 1


class Transducer:
    """Compiles lazily from a piece model; memory stays bounded because a full table is emptied and refilled."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.library = model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.rank: dict[str, float] = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                self.rank[model.id_to_piece(i)] = -model.get_score(i)
        self.prefixes = {p[:n] for p in self.rank for n in range(1, len(p))}
        self.bigrams = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        alphabet = np.array(sorted({ord(c) for p in self.rank for c in p}))
        # A character that no piece holds stands alone as its UTF-8 bytes; four symbols are enough for all of them.
        code = np.arange(0x110000, dtype=np.int32)
        width = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        self.symbol = (_FOREIGN + width).astype(np.int32)
        self.symbol[alphabet] = alphabet
        self.symbol[32] = ord(SPACE)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple] = []
        self.index: dict[tuple, int] = {}
        self.bits = 20
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.int64)
        self.filled = 0
        self.state("", ((0, None, 0),))

    def state(self, suffix: str, places: tuple) -> int:
        key = (suffix, places)
        at = self.index.get(key)
        if at is None:
            at = self.index[key] = len(self.states)
            self.states.append(key)
        return at

    def merge(self, text: str) -> list[str]:
        """The merge procedure itself, for strings of two items."""
        parts = list(text)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], np.inf))
            if parts[best] + parts[best + 1] not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def follows(self, left: str | None, right: str) -> bool:
        if left is None:
            left = ""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 400_000:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(left + right) == ([left, right] if left else [right])
        return known

    def step(self, at: int, symbol: int) -> tuple[int, int]:
        """Next state and change of the count."""
        if symbol > _FOREIGN:
            return 0, symbol - _FOREIGN
        suffix, places = self.states[at]
        grown = suffix + chr(symbol)
        for j, left, since in places:
            item = grown[j:]
            if (len(item) == 1 or item in self.rank) and self.follows(left, item):
                break
        else:
            raise Unmodelled(grown)
        change = since + (1 if item in self.rank else len(item.encode()))
        kept = []
        for j, left, since in places:
            rest = grown[j:]
            if rest in self.prefixes:
                apart = left is not None and left[-1] + rest[0] not in self.bigrams
                kept.append((j, None if apart else left, since - change))
        kept.append((len(grown), item, 0))
        first = kept[0][0]
        return self.state(grown[first:], tuple((j - first, a, n) for j, a, n in kept)), change

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        if (self.filled + len(keys)) * 2 > len(self.keys):
            old = self.keys >= 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            while len(keys) * 2 > 1 << self.bits:
                self.bits += 1
            self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
            self.filled = 0
        mask = len(self.keys) - 1
        for k, v, at in zip(keys.tolist(), values.tolist(), self._slots(keys).tolist(), strict=True):
            while self.keys[at] >= 0:
                at = (at + 1) & mask
            self.keys[at], self.values[at] = k, v
        self.filled += len(keys)

    def advance(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One transition for each pair; compiles those that are missing."""
        keys = (states.astype(np.int64) << 21) | symbols
        at = self._slots(keys)
        there = self.keys[at]
        odd = np.flatnonzero(there != keys)
        mask = len(self.keys) - 1
        missing = []
        while len(odd):
            gone = there[odd] < 0
            missing.append(odd[gone])
            odd = odd[~gone]
            at[odd] = (at[odd] + 1) & mask
            there[odd] = self.keys[at[odd]]
            odd = odd[there[odd] != keys[odd]]
        values = self.values[at]
        if missing and sum(map(len, missing)):
            lanes = np.concatenate(missing)
            fresh, back = np.unique(keys[lanes], return_inverse=True)
            made = np.array([(to << 10) | (change + 512) for to, change in (self.step(k >> 21, k & 0x1FFFFF) for k in fresh.tolist())], np.int64)
            self._insert(fresh, made)
            values[lanes] = made[back]
        return (values >> 10).astype(np.int32), ((values & 1023) - 512).astype(np.int16)

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        try:
            return self._counted(texts)
        except Unmodelled:
            return np.array([len(self.library.encode(t)) for t in texts], np.int64)

    def _counted(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        lengths = np.array([len(t) for t in texts], np.int64)
        start = 0
        while start < len(texts):
            stop, held = start, 0
            while stop < len(texts) and (stop == start or held + lengths[stop] <= TOGETHER):
                held += lengths[stop]
                stop += 1
            if len(self.states) > MOST_STATES:
                self.clear()
            if held > TOGETHER:  # one long text: its parts follow each other, each from where the last ended
                whole, state = SPACE + texts[start], 0
                for at in range(0, len(whole), TOGETHER):
                    if len(self.states) > MOST_STATES:
                        key = self.states[state]
                        self.clear()
                        state = self.state(*key)
                    counts, state = self._count([whole[at : at + TOGETHER]], state)
                    out[start] += counts[0]
            else:
                out[start:stop] = self._count([SPACE + t if t else "" for t in texts[start:stop]])[0]
            start = stop
        return out

    def _run(self, lanes: np.ndarray, entry: np.ndarray, begin: np.ndarray, length: np.ndarray, symbols: np.ndarray, path: np.ndarray, gone: np.ndarray):
        """Last states and counts of ``lanes`` begun in the states ``entry``, with the runs from the start state known.

        ``path`` and ``gone`` hold those runs' states and running counts; where a run meets one it is done.
        """
        last, total = np.zeros(len(lanes), np.int32), np.zeros(len(lanes), np.int64)
        live, state, t = np.arange(len(lanes)), entry, 0
        while len(live):
            lane = lanes[live]
            state, moved = self.advance(state, symbols[begin[lane] + t])
            total[live] += moved
            met = path[t, lane] == state
            end = length[lane] - 1
            done = met | (end == t)
            at, whole = live[done], lane[done]
            last[at] = np.where(met[done], path[end[done], whole], state[done])
            total[at] += np.where(met[done], gone[end[done], whole] - gone[t, whole], 0)
            live, state, t = live[~done], state[~done], t + 1
        return last, total

    def _count(self, texts: list[str], first: int = 0) -> tuple[np.ndarray, int]:
        """Changes of the count over each text, the first text begun in state ``first``; and the last text's last state."""
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.symbol[code]
        sizes = np.array([len(t) for t in texts], np.int64)
        chunks = -(-sizes // CHUNK)
        n = int(chunks.sum())
        if not n:
            return np.zeros(len(texts), np.int64), first
        text_of = np.repeat(np.arange(len(texts)), chunks)
        head = (np.cumsum(chunks) - chunks)[text_of] == np.arange(n)  # a text's first chunk
        nth = np.arange(n) - (np.cumsum(chunks) - chunks)[text_of]
        begin = (np.cumsum(sizes) - sizes)[text_of] + nth * CHUNK
        length = np.minimum(CHUNK, sizes[text_of] - nth * CHUNK)
        # All chunks from the start state; at each step the chunks still running are a prefix of the longest-first order.
        order = np.argsort(-length, kind="stable")
        running = np.searchsorted(-length[order], -np.arange(CHUNK), side="left")
        path, gone = np.zeros((CHUNK, n), np.int32), np.zeros((CHUNK, n), np.int32)
        now, sums = np.zeros(n, np.int32), np.zeros(n, np.int32)
        for t in range(int(length.max())):
            lane = order[: running[t]]
            state, moved = self.advance(now[lane], symbols[begin[lane] + t])
            now[lane] = state
            sums[lane] += moved
            path[t, lane], gone[t, lane] = state, sums[lane]
        # The state maps: column c of a chunk is its c-th way to begin. A chunk's new last state is the next one's new beginning.
        maps = Maps(path[length - 1, np.arange(n)], gone[length - 1, np.arange(n)])
        lanes = np.flatnonzero(~head)
        work = [(lanes, maps.ends[lanes - 1, 0])]
        if first:
            work.append((np.array([0]), np.array([first], np.int32)))
        rounds = 0
        while work:
            lanes, entry = work.pop()
            fresh = maps.missing(lanes, entry)
            lanes, entry = lanes[fresh], entry[fresh]
            if not len(lanes):
                continue
            rounds += 1
            states = np.unique(entry) if rounds > 2 else ()
            parts = [(lanes, entry)]
            if 0 < len(states) <= SPREAD:  # states that run on from chunk to chunk: all later chunks of these texts learn them at once
                since = np.full(len(texts), n)
                np.minimum.at(since, text_of[lanes], lanes)
                later = np.flatnonzero(np.arange(n) >= since[text_of])
                parts = [(later, np.full(len(later), x, np.int32)) for x in states]
                parts = [(p[m], e[m]) for p, e in parts for m in [maps.missing(p, e)]]
            for lanes, entry in parts:
                last, total = self._run(lanes, entry, begin, length, symbols, path, gone)
                maps.add(lanes, entry, last, total)
                follows = lanes + 1 < n
                follows[follows] = ~head[lanes[follows] + 1]
                work.append((lanes[follows] + 1, last[follows]))
        which = self._scan(maps.begins, maps.ends, head, first)
        out = np.zeros(len(texts), np.int64)
        np.add.at(out, text_of, maps.counts[np.arange(n), which])
        return out, int(maps.ends[-1, which[-1]])

    @staticmethod
    def _scan(begins: np.ndarray, ends: np.ndarray, head: np.ndarray, first: int) -> np.ndarray:
        """For each chunk the column it really begins in, by a prefix scan over the composed maps.

        ``step[i, c]`` is the column of chunk i + 1 that follows column c of chunk i. A chunk that ends a text maps all
        columns to the next text's start, so texts don't reach each other.
        """
        n, width = begins.shape
        start = int((begins[0] == first).argmax())
        if width == 1 or n == 1:
            return np.full(n, start if n == 1 else 0, np.int64)
        step = np.zeros((n - 1, width), np.int64)
        for c in range(width):
            same = begins[1:] == ends[:-1, c : c + 1]
            step[:, c] = np.where(head[1:], 0, same.argmax(axis=1))
        step[0] = step[0, start]  # the first chunk's beginning is known
        d = 1
        while d < n - 1:
            step[d:] = np.take_along_axis(step[d:], step[:-d], axis=1)
            d *= 2
        return np.append(start, step[:, 0])


_compiled: dict[str, Transducer] = {}


def _transducer(model_path: str) -> Transducer:
    """One for each worker process, kept between its tasks."""
    if model_path not in _compiled:
        _compiled[model_path] = Transducer(model_path)
    return _compiled[model_path]


def count_tokens(df: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """Append ``n_tokens`` to every row: the number of tokens of its whole text.

    ``model`` is the name of a piece model in the tokenizers' folder. Null texts count as empty, empty texts
    have 0 tokens. Other columns are carried, one named n_tokens replaced; repeated rows and an empty table need
    no rule.
    """

    def make(texts: list[str], extras: list) -> tuple[np.ndarray]:
        import public_tokenizers

        return (_transducer(public_tokenizers.path(model)).count(texts),)

    return with_columns(df, text_col, {"n_tokens": "long"}, make)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    docs = docs.withColumn("n_bytes", F.octet_length(text_of(docs, "text")).cast("long"))
    counted = count_tokens(docs.select("doc_id", "n_bytes", "text"), "piece_bpe_32k.model")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))
