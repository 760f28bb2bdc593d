"""Language identification by a linear-chain conditional random field over words.

A word's features are byte n-grams of its lower-cased form with the blanks around it (so its prefixes and
suffixes) and the word itself, a learned lexicon; all are hashed into fixed tables. Learned transitions join
neighbouring words, so passages in another language keep their own labels. Forward-backward gives each word's
probabilities; a text's are their mean weighted by word length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import documents, text_of, with_columns
from .chain import Adagrad, forward_backward, mean_of_long, runs_of_long
from .sampling import thinned
from .words import hashes, per_range, ranges, stretches

UNKNOWN = "und"
GRAMS = (2, 3, 4)
BITS = 16
#: Rows the model is fitted on at most, and the longest text among them.
MOST_ROWS, LONGEST = 2400, 20_000
#: Bytes looked at together.
TOGETHER = 400_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32
_TEXTUAL = np.zeros(256, bool)
_TEXTUAL[65:91] = _TEXTUAL[97:123] = _TEXTUAL[128:] = True


def _grams(data: np.ndarray) -> list[np.ndarray]:
    """The hashed n-grams that begin at each byte but the last three."""
    wide, out = data.astype(np.uint32), []
    whole = wide[: len(wide) - 3].copy()
    for n in range(1, max(GRAMS) + 1):
        if n > 1:
            whole = (whole << np.uint32(8)) | wide[n - 1 : len(wide) - 4 + n]
        if n in GRAMS:
            out.append(((whole * np.uint32(0x9E3779B1) + np.uint32(n)) >> np.uint32(32 - BITS)).astype(np.int32))
    return out


def _idle(data: np.ndarray) -> np.ndarray:
    """Positions of no word, the last byte not asked: a word's go from the blank before it to its last byte."""
    blank = data == 32
    return np.flatnonzero(blank[:-1] & blank[1:])


class Words:
    """Words of several texts as byte ranges, with the hashed features of every byte."""

    def __init__(self, raw: list[bytes]):
        data = _LOWER[np.frombuffer(b" " + b"    ".join(raw) + b"    ", np.uint8)]  # no n-gram reaches another text
        self.first, self.last = ranges(data != 32)
        sizes = np.array([len(r) for r in raw], np.int64) + 4
        begin = np.cumsum(sizes) - sizes + 1
        self.lo = np.searchsorted(self.first, begin)
        self.counts = np.searchsorted(self.first, begin + sizes) - self.lo
        letters = np.concatenate([[0], np.cumsum(_TEXTUAL[data])])
        self.weight = (letters[self.last] - letters[self.first]).astype(float)
        self.grams = _grams(data)
        word = hashes(data, self.first, self.last, 0x100000001B3)
        self.lexicon = ((word * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
        self.starts = self.first - 1
        self.idle = _idle(data[: len(self.grams[0]) + 1])

    def emissions(self, tables: np.ndarray) -> np.ndarray:
        """``tables``: (features, hash, label)."""
        out = tables[-1][self.lexicon].astype(np.float32)
        if len(self.starts):
            per_byte = tables[0][self.grams[0]]
            for table, gram in zip(tables[1:-1], self.grams[1:], strict=True):
                per_byte += table[gram]
            per_byte[self.idle] = 0
            out += np.add.reduceat(per_byte, self.starts, axis=0)
        return out

    def spread(self, slopes: np.ndarray) -> np.ndarray:
        """The gradient of tables from that of emissions."""
        k = slopes.shape[1]
        out = np.zeros((len(GRAMS) + 1, 1 << BITS, k), np.float32)
        size = np.diff(np.append(self.starts, len(self.grams[0])))
        of = np.repeat(np.arange(len(self.starts)), size)
        lead = int(self.starts[0])
        for y in range(k):
            per_byte = slopes[of, y]
            per_byte[self.idle[self.idle >= lead] - lead] = 0
            for g, gram in enumerate(self.grams):
                out[g, :, y] = np.bincount(gram[lead:], weights=per_byte, minlength=1 << BITS)
            out[-1, :, y] = np.bincount(self.lexicon, weights=slopes[:, y], minlength=1 << BITS)
        return out


def _encoded(texts: list[str]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def fit(texts: list[str], labels: np.ndarray, classes: int, *, passes: int = 3, batch: int = 48, rate: float = 0.15) -> dict:
    """Weights from texts whose words all bear the text's label.

    Every second pair of texts is read as one sequence, so the transitions see where one language gives way to another
    and learn how rare that is, not only that it never happens.
    """
    tables = np.zeros((len(GRAMS) + 1, 1 << BITS, classes), np.float32)
    transitions = np.eye(classes) * 2.0
    start = np.zeros(classes)
    climb = Adagrad(tables, transitions, start, rate=rate)
    rng = np.random.default_rng(3)
    for _ in range(passes):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            words = Words(_encoded([texts[i] for i in pick]))
            full = words.counts > 0
            sizes, truth = words.counts[full], labels[pick][full]
            if not len(sizes):
                continue
            marks = np.repeat(truth, sizes)
            head = np.arange(len(sizes)) % 4 != 1  # a text that follows another of its sequence begins none
            sizes, truth = np.add.reduceat(sizes, np.flatnonzero(head)), truth[head]
            p, pairs, firsts = forward_backward(words.emissions(tables), sizes, transitions, start, pairs=True)
            seen = np.zeros_like(p)
            seen[np.arange(len(p)), marks] = 1
            joins, begins = np.zeros((classes, classes)), np.bincount(truth, minlength=classes)
            inside = np.ones(len(p), bool)
            inside[np.cumsum(sizes) - sizes] = False
            at = np.flatnonzero(inside)
            np.add.at(joins, (marks[at - 1], marks[at]), 1)
            n = len(p)
            climb.climb(words.spread((seen - p).astype(np.float32)) / n, (joins - pairs) / n - 1e-3 * transitions, (begins - firsts) / len(sizes))
    return {"tables": tables, "transitions": transitions, "start": start}


def _long(model: dict, whole: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Emissions, weights, starts and ends of one long text's words, by stretches of its bytes.

    A word's features are sums over its bytes, so stretches may end anywhere. Beside the text some 40 bytes a
    word are held, and 4 for each label.
    """
    tables = model["tables"]
    data = _LOWER[np.frombuffer(b" " + whole + b"    ", np.uint8)]
    first, last = ranges(data != 32)
    lexicon = (hashes(data, first, last, 0x100000001B3) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
    out = tables[-1][lexicon.astype(np.int64)].astype(np.float32)
    weight, starts = np.zeros((len(first), 1)), first - 1
    for a, b in stretches(len(data) - max(GRAMS) + 1, TOGETHER):
        grams = _grams(data[a : b + max(GRAMS) - 1])
        per_byte = tables[0][grams[0]]
        for table, gram in zip(tables[1:-1], grams[1:], strict=True):
            per_byte += table[gram]
        per_byte[_idle(data[a : b + 1])] = 0
        per_range(per_byte, a, starts, out)
        per_range(_TEXTUAL[data[a:b]].astype(float)[:, None], a, starts, weight)
    return out, weight[:, 0] + 1e-6, first - 1, last - 1


def word_labels(model: dict, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes at which the words of a text begin and end, each one's likeliest label, and how likely that is."""
    raw = text.encode("utf-8", "surrogatepass")
    emissions, _, first, last = _long(model, raw)
    best, sure = np.zeros(len(first), np.int64), np.zeros(len(first))
    if len(first):
        for a, b, p in runs_of_long(emissions, model["transitions"], model["start"]):
            best[a:b], sure[a:b] = p.argmax(axis=1), p.max(axis=1)
    return first, last, best, sure


def predict(model: dict, texts: list[str]) -> np.ndarray:
    """Probabilities of each text, (texts, classes); a row of zeros for a text without words."""
    raw = _encoded(texts)
    out = np.zeros((len(raw), len(model["start"])))
    at = 0
    while at < len(raw):
        if len(raw[at]) > TOGETHER:
            emissions, weight, _, _ = _long(model, raw[at])
            if len(weight):
                out[at] = mean_of_long(emissions, weight, model["transitions"], model["start"])
            at += 1
            continue
        end, held = at, 0
        while end < len(raw) and held + len(raw[end]) <= TOGETHER:
            held += len(raw[end]) + 1
            end += 1
        words = Words(raw[at:end])
        full = np.flatnonzero(words.counts > 0)
        if len(full):
            p = forward_backward(words.emissions(model["tables"]), words.counts[full], model["transitions"], model["start"])
            starts = (np.cumsum(words.counts) - words.counts)[full]
            weight = words.weight + 1e-6
            out[at + full] = np.add.reduceat(p * weight[:, None], starts, axis=0) / np.add.reduceat(weight, starts)[:, None]
        at = end
    return out


def train(df: DataFrame, *, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", most_rows: int = MOST_ROWS, longest: int = LONGEST) -> dict:
    """Fit on about ``most_rows`` rows with a label and a text of at most ``longest`` characters, alike for each label.

    At most the 1000 most frequent labels are learned (``sampling.CLASSES``).
    """
    rows = df.select(df[id_col].alias("id"), df[label_col].cast("string").alias("label"), df[text_col].cast("string").alias("text"))
    rows = rows.where(F.col("label").isNotNull() & (F.length("text") <= longest) & F.regexp_like("text", F.lit(r"\p{L}")))
    taken = thinned(rows, "id", "label", most_rows).toPandas().sort_values(["id", "label", "text"], kind="stable")
    classes = sorted(taken["label"].unique())
    if not classes:
        return {"classes": []}
    labels = np.searchsorted(classes, taken["label"].to_numpy(str)).astype(np.int64)
    return fit(taken["text"].tolist(), labels, len(classes)) | {"classes": classes}


def identify(df: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """Append lang_pred and score to every row.

    A text that is null or has no letter is ``und`` with score 0, as is every text if the model has no label. Very
    long texts are scored in parts with the same result. Other columns are carried, those named like an output replaced. Rows are independent: repeated rows and empty tables
    need no rule.
    """
    if not model["classes"]:
        kept = [c for c in df.columns if c.lower() not in ("lang_pred", "score")]
        return df.select(*[df[c] for c in kept], F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BITS and the number of languages

    def make(texts: list[str], extras: list) -> tuple[list, np.ndarray]:
        held = shared.value
        names = [*held["classes"], UNKNOWN]
        p = predict(held, texts)
        best = np.where(np.array(extras[0], bool) & (p.sum(axis=1) > 0), p.argmax(axis=1), len(names) - 1)
        return [names[i] for i in best], np.where(best < len(names) - 1, np.clip(p.max(axis=1), 0, 1), 0.0)

    sound = F.regexp_like(text_of(df, text_col), F.lit(r"\p{L}"))
    return with_columns(df, text_col, {"lang_pred": "string", "score": "double"}, make, {"sound": sound})


def label_words(df: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """Append ``passages`` to every row: the runs of words of one language, as (start, end, lang, score).

    Offsets count code points, end exclusive; the score is the mean probability of the run's words. So a text that
    switches between languages shows where. Null texts count as empty, texts without a word have no passage, and
    so has every text if the model has no label. Columns are carried as by :func:`identify`.
    """
    kind = "array<struct<start:int,end:int,lang:string,score:double>>"
    if not model["classes"]:
        return df.select(*[df[c] for c in df.columns if c.lower() != "passages"], F.array().cast(kind).alias("passages"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def one(text: str) -> list[dict]:
        held = shared.value
        first, last, best, sure = word_labels(held, text)
        if not len(first):
            return []
        begin = np.concatenate([[0], np.flatnonzero(np.diff(best)) + 1])
        end = np.append(begin[1:], len(best))
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
        mean = np.add.reduceat(sure, begin) / (end - begin)
        return [
            {"start": int(points[first[a]]), "end": int(points[last[b - 1]]), "lang": held["classes"][best[a]], "score": float(m)}
            for a, b, m in zip(begin.tolist(), end.tolist(), mean, strict=True)
        ]

    return with_columns(df, text_col, {"passages": kind}, lambda texts, extras: ([one(t) for t in texts],))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit(""))) % 3 == 1
    model = train(docs.where(~held_out))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
