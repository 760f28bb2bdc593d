"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its features are shares of character classes, its shape, whether the text repeats it,
and the same of the lines before and after. Marginals from forward-backward, weighted by line length, make the
text's score, which a fitted bend maps so that the best cut on the training rows lies at CUT.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import documents, with_columns
from .chain import Adagrad, forward_backward, mean_of_long, runs_of_long
from .sampling import thinned
from .words import hashes, ranges, stretches

CUT = 0.7
#: Rows the model is fitted on at most, and the longest text among them, in characters and in lines.
MOST_ROWS, LONGEST, MOST_LINES = 4000, 20_000, 1000
#: Bytes looked at together, and what a line adds to a text's bytes in that sum.
TOGETHER, LINE = 1_000_000, 24
#: Character classes, by byte.
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "blank": b" \t\r\x0b\x0c",
    "stop": b".,;:?'\"-",
    "shout": b"!",
    "bar": b"|",
    "sign": b"*$%&#@~^=+_",
    "code": b"<>{}[]()/\\`",
}
_CODE = np.full(256, len(_CLASSES), np.uint8)
for _i, _members in enumerate(_CLASSES.values()):
    _CODE[list(_members)] = _i
_NAMES = [*_CLASSES, "other"]


def _cost(raw: bytes) -> int:
    """Working memory a text takes, in bytes of text: lines weigh, however short."""
    return len(raw) + LINE * (raw.count(b"\n") + 1)


def _data(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes with a line feed after each text, starts and ends of lines, and lines of each text."""
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = np.array([len(r) for r in raw], np.int64) + 1
    first = np.searchsorted(starts, np.cumsum(sizes) - sizes)
    return data, starts, ends, np.diff(np.append(first, len(starts)))


def _names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each line."""
    return hashes(data, starts, ends, 0x100000001B3) + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _repeated(name: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Lines of more than 8 bytes whose name occurs more than once."""
    order = np.sort(name)
    twice = order[1:][order[1:] == order[:-1]]
    at = np.minimum(np.searchsorted(twice, name), max(0, len(twice) - 1))
    return (twice[at] == name) & (length > 8) if len(twice) else np.zeros(len(name), bool)


def line_features(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of all lines, line lengths in bytes, and lines of each text. Every text has at least one line."""
    data, starts, ends, lines = _data(raw)
    length = (ends - starts).astype(np.int64)
    name = _names(data, starts, ends) + np.repeat(np.arange(len(raw), dtype=np.uint64), lines) * np.uint64(0xC2B2AE3D27D4EB4F)
    return _own(data, starts, ends, _repeated(name, length)), length, lines


def _own(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    length = (ends - starts).astype(np.int64)
    n = np.maximum(length, 1).astype(float)
    classes = len(_NAMES) + 1  # the line feed is a class of its own
    counts, line = np.zeros((len(starts), classes)), 0
    for a, b in stretches(len(data)):
        code, feed = _CODE[data[a:b]].astype(np.int64), data[a:b] == 10
        code[feed] = classes - 1
        of = np.cumsum(feed) - feed
        some = np.bincount(of * classes + code, minlength=classes).astype(float)
        some = np.append(some, np.zeros(-len(some) % classes)).reshape(-1, classes)
        counts[line : line + len(some)] += some
        line += int(of[-1]) + int(feed[-1])
    share = dict(zip(_NAMES, (counts[:, :-1] / n[:, None]).T, strict=True))
    letters = share["upper"] + share["lower"] + share["other"]
    # Words equal to the word before, or to the one before that.
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    w0, w1 = ranges(np.concatenate([[False], ~gap, [False]]))
    w0, w1 = w0 - 1, w1 - 1
    word = hashes(data, w0, w1, 0x100000001B3)
    of = np.searchsorted(starts, w0, side="right") - 1
    words = np.maximum(np.bincount(of, minlength=len(starts)), 1)

    def echo(k: int) -> np.ndarray:
        same = (word[k:] == word[:-k]) & (of[k:] == of[:-k])
        return np.bincount(of[k:][same], minlength=len(starts)) / words

    one, two = echo(1), echo(2)
    head, tail = data[starts], data[np.maximum(ends - 1, 0)]
    loud = share["upper"] / np.maximum(letters, 1e-9)
    marks = share["sign"] + share["shout"] + share["bar"] + share["code"]
    columns = [
        np.minimum(np.log1p(length) / 8, 2),
        loud,
        loud > 0.3,
        share["digit"],
        share["digit"] > 0.2,
        share["shout"],
        share["shout"] > 0.03,
        share["bar"],
        share["bar"] > 0.03,
        share["sign"],
        share["sign"] > 0.03,
        share["code"],
        share["code"] > 0.05,
        marks > 0.08,
        share["blank"],
        share["blank"] > 0.4,
        (share["blank"] < 0.05) & (length > 30),
        share["stop"],
        share["stop"] > 0.12,
        (head >= 65) & (head <= 90),
        (head >= 97) & (head <= 122),
        np.isin(tail, np.frombuffer(b".!?", np.uint8)),
        length == 0,
        one,
        one > 0.1,
        two,
        (one + two) > 0.3,
        repeated,
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], axis=1)


def with_neighbours(own: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The full design: 1, own features, those of the line before and after, first line, last line."""
    first = np.cumsum(lines) - lines
    is_first, is_last = np.zeros(len(own), bool), np.zeros(len(own), bool)
    is_first[first] = True
    is_last[first + lines - 1] = True
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[is_first], after[is_last] = 0, 0
    return np.concatenate([np.ones((len(own), 1)), own, before, after, is_first[:, None], is_last[:, None]], axis=1)


def emissions_of(own: np.ndarray, lines: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``with_neighbours(own, lines) @ weights`` without building the design."""
    k = own.shape[1]
    first = np.cumsum(lines) - lines
    out = own @ weights[1 : k + 1] + weights[0]
    before, after = own @ weights[k + 1 : 2 * k + 1], own @ weights[2 * k + 1 : 3 * k + 1]
    inner = np.ones(len(own), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    out[at] += before[at - 1]
    out[at - 1] += after[at]
    out[first] += weights[-2]
    out[first + lines - 1] += weights[-1]
    return out


def _grouped(costs: list[int]) -> Iterator[slice]:
    at = 0
    while at < len(costs):
        end, held = at, 0
        while end < len(costs) and (end == at or held + costs[end] <= TOGETHER):
            held += costs[end]
            end += 1
        yield slice(at, end)
        at = end


def _long_emissions(model: dict, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Emissions and lengths of one text's lines, in parts cut at line ends; beside the text it holds some 40 bytes a line.

    A first pass names the lines, as repeats count over the whole text; a second makes the emissions, each
    part adding its end lines' features to the neighbouring parts. Messages of the chain pass between its runs.
    """
    data, starts, ends, lines = _data([raw])
    total = int(lines[0])
    cost = ends + LINE * np.arange(1, total + 1)
    cuts = [0, *np.unique(np.searchsorted(cost, np.arange(TOGETHER, int(cost[-1]), TOGETHER)) + 1).tolist()]
    cuts = [c for c in cuts if c < total] + [total]
    spans = [*zip(cuts, cuts[1:], strict=False)]
    length = ends - starts
    repeated = _repeated(_names(data, starts, ends), length)
    weights = model["weights"]
    k = (len(weights) - 3) // 3
    out, last = np.empty((total, 2)), None
    for a, b in spans:
        base = starts[a]
        own = _own(data[base : ends[b - 1] + 1], starts[a:b] - base, ends[a:b] - base, repeated[a:b])
        out[a:b] = own @ weights[1 : k + 1] + weights[0]
        before, after = own @ weights[k + 1 : 2 * k + 1], own @ weights[2 * k + 1 : 3 * k + 1]
        out[a + 1 : b] += before[:-1]
        out[a : b - 1] += after[1:]
        if a:
            out[a] += last
            out[a - 1] += after[0]
        last = before[-1]
    out[0] += weights[-2]
    out[-1] += weights[-1]
    return out, length


def line_probabilities(model: dict, texts: list[str]) -> list[np.ndarray]:
    """How likely each line of each text is good."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    costs, chain, out = [_cost(r) for r in raw], (model["transitions"], model["start"]), []
    for part in _grouped(costs):
        if costs[part.start] > TOGETHER:
            emissions, _ = _long_emissions(model, raw[part.start])
            out.append(np.concatenate([p[:, 1] for _, _, p in runs_of_long(emissions, *chain)]))
        else:
            own, _, lines = line_features(raw[part])
            good = forward_backward(emissions_of(own, lines, model["weights"]), lines, *chain)[:, 1]
            out += np.split(good, np.cumsum(lines)[:-1])
    return out


def raw_scores(model: dict, texts: list[str]) -> np.ndarray:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    out = np.empty(len(raw))
    costs = [_cost(r) for r in raw]
    for part in _grouped(costs):
        if costs[part.start] > TOGETHER:
            emissions, length = _long_emissions(model, raw[part.start])
            out[part] = mean_of_long(emissions, (length + 1).astype(float), model["transitions"], model["start"])[1]
            continue
        own, length, lines = line_features(raw[part])
        good = forward_backward(emissions_of(own, lines, model["weights"]), lines, model["transitions"], model["start"])[:, 1]
        first = np.cumsum(lines) - lines
        out[part] = np.add.reduceat(good * (length + 1), first) / np.add.reduceat(length + 1, first)
    return out


def _bend(scores: np.ndarray, labels: np.ndarray) -> float:
    """The cut with fewest errors, halfway between neighbouring scores."""
    order = np.argsort(scores, kind="stable")
    s, y = scores[order], labels[order]
    wrong = np.concatenate([[np.sum(y == 0)], np.sum(y == 0) + np.cumsum(np.where(y == 1, 1, -1))])
    edges = np.concatenate([[s[0] - 1e-3], (s[1:] + s[:-1]) / 2, [s[-1] + 1e-3]])
    best = np.flatnonzero(wrong == wrong.min())
    return float(np.clip(edges[best[len(best) // 2]], 0.02, 0.98))


def fit(texts: list[str], labels: np.ndarray, *, passes: int = 12, batch: int = 64, rate: float = 0.3) -> dict:
    parts = []
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    rng = np.random.default_rng(4)
    order = rng.permutation(len(raw))
    for at in range(0, len(order), batch):
        pick = order[at : at + batch]
        own, _, lines = line_features([raw[i] for i in pick])
        parts.append((own.astype(np.float32), lines, labels[pick]))
    weights, transitions, start = np.zeros((3 * parts[0][0].shape[1] + 3, 2)), np.zeros((2, 2)), np.zeros(2)
    climb = Adagrad(weights, transitions, start, rate=rate)
    share = np.bincount(labels, minlength=2) / len(labels)
    for _ in range(passes):
        for own, lines, truth in parts:
            x = with_neighbours(own.astype(np.float64), lines)
            p, pairs, firsts = forward_backward(x @ weights, lines, transitions, start, pairs=True)
            seen = np.zeros_like(p)
            seen[np.arange(len(p)), np.repeat(truth, lines)] = 1
            joins, begins = np.diag(np.bincount(truth, weights=lines - 1, minlength=2)), np.bincount(truth, minlength=2)
            n = len(p)
            climb.climb(x.T @ (seen - p) / n - 1e-4 * weights, (joins - pairs) / n - 1e-2 * transitions, (begins - firsts) / len(lines))
    model = {"weights": weights, "transitions": transitions, "start": start, "prior": float(share[1])}
    scores = np.concatenate([raw_scores(model, texts[i : i + 256]) for i in range(0, len(texts), 256)])
    return model | {"bend": _bend(scores, labels)}


def train(df: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", most_rows: int = MOST_ROWS, longest: int = LONGEST, most_lines: int = MOST_LINES) -> dict | None:
    """Fit on about ``most_rows`` labelled rows with texts of at most ``longest`` characters and ``most_lines`` lines.

    Rows are picked alike for both labels.

    Labels other than 0 and 1 are not used. None where no label is left.
    """
    marks = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label")).where("label IN (0, 1) AND id IS NOT NULL")
    taken = thinned(marks, "id", "label", most_rows)  # bounded, so it may be broadcast
    rows = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text")).where((F.length("text") <= longest) & (F.regexp_count("text", F.lit("\n")) < most_lines))
    taken = rows.join(F.broadcast(taken), "id").toPandas().sort_values(["id", "label", "text"], kind="stable")
    if not len(taken):
        return None
    return fit(taken["text"].tolist(), taken["label"].to_numpy(np.int64))


def score_quality(df: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """Append score (0 to 1, higher is better) to every row.

    Null texts count as empty; an empty text is one empty line. Very long texts, and texts of very many lines, are
    scored in parts with the same result. Without a model every score is 0.5. Other columns
    are carried, one named score replaced. Rows are independent: repeated rows and empty tables need no rule.
    """
    if model is None:
        return df.select(*[df[c] for c in df.columns if c.lower() != "score"], F.lit(0.5).alias("score"))

    def make(texts: list[str], extras: list) -> tuple[np.ndarray]:
        b, s = model["bend"], raw_scores(model, texts)
        return (np.clip(np.where(s < b, s / b * CUT, CUT + (s - b) / (1 - b) * (1 - CUT)), 0, 1),)

    return with_columns(df, text_col, {"score": "double"}, make)


def label_lines(df: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """Append ``lines``, for each line of the text the probability that it is good, to every row.

    A line ends at a line feed, so a text has one line more than it has line feeds; null texts count as empty. A line
    is good or bad as the field labels it among its neighbours. Columns are carried as by :func:`score_quality`.
    """
    return with_columns(df, text_col, {"lines": "array<double>"}, lambda texts, extras: ([p.tolist() for p in line_probabilities(model, texts)],))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    bucket = lambda df: F.crc32(F.coalesce(df["doc_id"].cast("string"), F.lit(""))) % 4
    model = train(docs, labels.where(bucket(labels) != 2))
    scored = score_quality(docs.select("doc_id", (bucket(docs) == 2).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
