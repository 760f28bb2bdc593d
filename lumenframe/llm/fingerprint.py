"""Document fingerprints by order MinHash. Native expressions only.

A text's tokens form k-mers; a k-mer is numbered by its occurrence. Under each of ``SIZE`` permutations the ``TUPLE``
numbered k-mers of least hash are put back into text order, and the tuple of their k-mers is hashed. The fingerprint
is the list of those hashes; two texts are alike in the share of equal places, which falls with the number of edits
and with moved passages, while MinHash alone would not see the order.

A permutation is the exclusive or of the hash with a constant of its own. The hashes that come first under it are
then those that share the longest prefix with the constant, so they lie side by side in the sorted hashes: one sort
and a short search for each permutation replace a pass over the text for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .base import documents, text_of

K, TUPLE = 2, 2
SIZE = 64
#: Runs of Latin letters, digits and marks count as one token of at most 16 characters, any other character as one.
TOKEN = r"[\x21-\x{24F}]{1,16}+|[^\x20\x09-\x0D]"
#: A packed number is a hash of 36 bits over a position of 27 bits; it is never negative.
POSITION, PACKED = 27, 63
_LOW = (1 << POSITION) - 1
#: Ids sampled for each bound, where ids are texts.
SAMPLED = 20
#: The permutations' constants: multiples of the golden ratio, so their prefixes are spread.
CONSTANTS = [((j * 0x9E3779B97F4A7C15) % (1 << 64) >> 1) & ~_LOW for j in range(1, SIZE + 1)]


def with_sketch(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Append ``name``, the array of SIZE 32-bit tuple hashes of ``text``, one for each permutation; empty for a text without tokens."""
    h, k, s, u, steps, shift = (f"{name}_{x}" for x in ("h", "k", "s", "u", "steps", "shift"))
    columns = df.columns
    powers = ", ".join(str(1 << b) for b in range(POSITION, -1, -1))
    df = df.withColumn(h, F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda w: F.xxhash64(w)))
    window = ", ".join(f"`{h}`[i + {j}]" for j in range(K))
    df = df.withColumn(
        k,
        F.expr(
            f"CASE WHEN size(`{h}`) >= {K} THEN transform(sequence(0, size(`{h}`) - {K}), i -> xxhash64({window})) "
            f"WHEN size(`{h}`) > 0 THEN array(xxhash64(`{h}`)) ELSE CAST(array() AS array<bigint>) END"
        ),
    )
    # Hash and position packed and sorted: occurrences of a k-mer stand side by side, in text order.
    df = df.withColumn(s, F.expr(f"sort_array(transform(`{k}`, (x, i) -> (x & {~_LOW}) | CAST(i AS bigint)))"))
    df = df.withColumn(steps, F.expr(f"slice(array({powers}), {POSITION + 2} - length(bin(size(`{s}`))), length(bin(size(`{s}`))))"))
    same = f"shiftright(`{s}`[i - a - d], {POSITION}) = shiftright(x, {POSITION})"
    number = (
        f"IF(i > 0 AND shiftright(`{s}`[greatest(i - 1, 0)], {POSITION}) = shiftright(x, {POSITION}), "
        f"aggregate(`{steps}`, 0, (a, d) -> IF(i - a - d >= 0, IF({same}, a + d, a), a)), 0)"
    )
    df = df.withColumn(u, F.expr(f"sort_array(transform(`{s}`, (x, i) -> (shiftrightunsigned(xxhash64(shiftright(x, {POSITION}), {number}), 1) & {~_LOW}) | (x & {_LOW})))"))
    # Prefixes of such a length that 8 to 16 hashes are expected to share one; below 16 hashes all are looked at.
    df = df.withColumn(shift, F.expr(f"{PACKED + 4} - size(`{steps}`)"))
    below = lambda sign: f"aggregate(`{steps}`, 0, (a, d) -> IF(a + d <= size(`{u}`), IF(shiftright(`{u}`[a + d - 1], `{shift}`) {sign} shiftright(c, `{shift}`), a + d, a), a))"
    near = f"element_at(transform(array(struct({below('<')} AS lo, {below('<=')} AS hi)), r -> IF(r.hi - r.lo >= {TUPLE}, slice(`{u}`, r.lo + 1, r.hi - r.lo), `{u}`)), 1)"
    least = f"sort_array(transform(slice(sort_array(transform(IF(`{shift}` < {PACKED}, {near}, `{u}`), x -> x ^ c)), 1, {TUPLE}), x -> x & {_LOW}))"
    # The tuple of k-mers in text order, hashed one after another.
    folded = f"aggregate({least}, CAST({SIZE} AS bigint), (a, p) -> xxhash64(a, `{k}`[CAST(p AS int)]), a -> CAST(shiftright(a, 32) AS int))"
    constants = ", ".join(f"{c}L" for c in CONSTANTS)
    df = df.withColumn(name, F.expr(f"IF(size(`{u}`) > 0, transform(array({constants}), c -> {folded}), CAST(array() AS array<int>))"))
    return df.select(*[F.col(f"`{c}`") for c in columns if c != name], name)


def as_string(sketch: Column) -> Column:
    """Eight hexadecimal digits for each tuple hash."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of permutations whose tuples agree, 0 to 1; two empty fingerprints are alike."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(same / F.lit(float(SIZE)))


def fingerprints(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Append ``fingerprint`` (string) to every row; all other columns are carried, one of that name replaced.

    Null and empty texts have the empty fingerprint; a text of one token counts as one k-mer. Equal
    texts have equal fingerprints; rows are independent of each other.
    """
    kept = [c for c in df.columns if c != "fingerprint"]
    rows = df.select(F.struct(*[df[c] for c in kept]).alias("row") if kept else F.lit(None).alias("row"), text_of(df, text_col).alias("text"))
    rows = with_sketch(rows, F.col("text"), "sketch")
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], as_string(F.col("sketch")).alias("fingerprint"))


def with_next(df: DataFrame, id_col: str, payload: list[str], buckets: int) -> DataFrame:
    """Append ``next``, the struct of ``payload`` of the following row by ascending id, after the last the first's.

    Ids are dealt into ranges of nearly equal count, whose bounds are ids of the table (``buckets`` of them, from a
    sketch or a sample of bounded size; they decide balance only). The first rows of a range also go to the range
    before as its lookahead, so each range is ordered alone and no task sees the whole table. Whole numbers are
    ordered as such, other ids by their text in code points. Null ids come first; rows alike in id are ordered by
    payload and share a range. A column named ``next`` is replaced, no other name clashes.
    """
    whole = isinstance(df.schema[id_col].dataType, IntegralType)
    if whole:
        key = F.coalesce(df[id_col].cast("bigint"), F.lit(-(1 << 63)).cast("bigint"))
    else:
        key = F.coalesce(F.concat(F.lit("1"), df[id_col].cast("string")), F.lit("0"))
    kept = [c for c in df.columns if c.lower() != "next"]
    keyed = df.select(F.struct(*[df[c] for c in kept]).alias("row"), F.struct(*[df[c] for c in payload]).alias("given"), key.alias("key"))
    least = keyed.agg(F.min("key")).first()[0]
    if whole:
        found = keyed.agg(F.percentile_approx("key", [i / buckets for i in range(buckets)], max(10_000, 20 * buckets))).first()[0] or []
    else:
        sample = sorted(r["key"] for r in keyed.select("key").orderBy(F.xxhash64("key")).limit(SAMPLED * buckets).collect())
        found = sample[::SAMPLED]
    bounds = sorted({*found, *([] if least is None else [least])}) or [0 if whole else "0"]
    n, steps = len(bounds), []
    while (1 << len(steps)) < n:
        steps.append(1 << len(steps))
    literal = F.lit(bounds).cast("array<bigint>" if whole else "array<string>")
    place = F.aggregate(
        F.lit([*reversed(steps)] or [0]).cast("array<int>"),
        F.lit(0),
        lambda at, d: F.when((at + d < n) & (F.get(literal, at + d) <= F.col("key")), at + d).otherwise(at),
    )
    keyed = keyed.withColumn("bucket", place)
    first = F.get(literal, F.col("bucket")) == F.col("key")
    own, ahead = F.struct(F.col("bucket").alias("b"), F.lit(False).alias("ahead")), F.struct(((F.col("bucket") + n - 1) % n).alias("b"), F.lit(True).alias("ahead"))
    spread = keyed.withColumn("at", F.explode(F.when(first, F.array(own, ahead)).otherwise(F.array(own))))
    order = W.partitionBy("at.b").orderBy("at.ahead", "key", "given")
    out = spread.withColumn("following", F.lead("given").over(order)).where(~F.col("at.ahead"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], F.col("following").alias("next"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    docs = docs.select("doc_id", text_of(docs, "text").alias("text"))
    docs = with_sketch(docs, F.col("text"), "own")
    buckets = min(8192, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = with_next(docs, "doc_id", ["text", "own"], buckets)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    pairs = pairs.select("doc_id", n.cast("long").alias("n_chars"), "own", F.col("next.own").alias("following"), edited.alias("edited"))
    pairs = with_sketch(pairs, F.col("edited"), "changed")
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        as_string(F.col("own")).alias("fingerprint"),
        as_string(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
