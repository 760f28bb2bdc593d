"""Mixing sources to target weights by Pareto order sampling. Native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import WORD, documents, saved, text_of

WEIGHTS = (5, 2, 1)
CEILING = 3
#: Expected copies are proportional to the size's binary digits plus this.
STEADY = 8
#: Bins of the rank per source; the sample's edge falls into one bin, and only its rows are ordered.
BINS = 4096


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _uniform(id_: Column, seed: int) -> Column:
    """A fixed uniform number in (0, 1) for each id, from 48 bits of a digest that any engine has."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), id_.cast("string")))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """Targets per source by water filling: from (source, source_size, any others), one row per source.

    Sources in code point order, null last, take ``weights`` in turn and share all words; none exceeds ``ceiling``
    times its size, and what it can't take the others share by weight. With sources ordered by limit over weight
    the full ones form a prefix, so the level follows from two running sums; the table has one row per source.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(ceiling))
    before = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    s = s.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    s = s.withColumn("level", F.max(F.when(F.col("limit") > F.col("level") * F.col("weight"), F.col("level"))).over(everything))
    return s.select(*sizes.columns, F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"))


def _share(bits: Column) -> Column:
    """How much of a longer document is wanted against a shorter one: it grows with the digits of the binary size."""
    return bits + float(STEADY)


def expected_copies(classes: DataFrame) -> DataFrame:
    """Append ``copies``, the expected copies of a document, to ``classes(source, bits, words, target, ...)``.

    Within a source they are proportional to the share of the size class, none exceeds ``ceiling``, and words times
    copies add up to the target. Classes of greater share are full first, so the level follows from running sums; the
    table has at most 64 rows a source.
    """
    share = _share(F.col("bits"))
    down = W.partitionBy("source").orderBy(F.desc("bits"))
    before, rest = down.rowsBetween(W.unboundedPreceding, -1), down.rowsBetween(W.currentRow, W.unboundedFollowing)
    limit = F.col("ceiling").cast("double")
    weight = F.sum(share * F.col("words")).over(rest)
    level = F.when(weight > 0, (F.col("target") - limit * F.coalesce(F.sum("words").over(before), F.lit(0))) / weight).otherwise(0.0)
    c = classes.withColumn("level", level)
    c = c.withColumn("level", F.max(F.when(F.col("level") * share < limit, F.struct("bits", "level"))).over(W.partitionBy("source"))["level"])
    return c.withColumn("copies", F.greatest(F.lit(0.0), F.least(limit, F.coalesce(F.col("level") * share, limit)))).drop("level")


def _rank(u: Column, part: Column) -> Column:
    """Pareto rank in (0, 1): the odds of the random number over the odds of inclusion, as odds / (1 + odds)."""
    odds = (u / (1 - u)) / (part / (1 - part))
    return odds / (1 + odds)


def mix(
    df: DataFrame, text_col: str = "text", *, id_col: str = "doc_id", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING, seed: int = 17
) -> DataFrame:
    """Append size, source_size, target, copies, inclusion and taken to every row of ``df``.

    A source's expected copies of a document grow with the document's size class (the digits of its size in binary):
    they are proportional to digits + STEADY, at most ``ceiling``, and their words add up to the target. Each document
    takes the whole copies it is certain of; the fraction left is its inclusion probability, which differs between
    documents. The sample is drawn in Pareto order: documents ranked by the odds of their fixed random number over
    their odds of inclusion, the least ranks up to the words that the source has left. The document at that edge
    is taken in part (its first words), so a source's taken words equal its target rounded. ``copies`` counts whole
    copies, ``taken`` words, ``inclusion`` is the probability of the copy that is drawn for.

    Null texts have size 0 and take nothing; null sources form one source, ranked last; null ids share one random
    number. Rows alike in id and size share the room at the edge evenly, what doesn't divide stays untaken. Input
    columns named like an output are replaced. An empty table returns no rows.
    """
    # Internal names can't clash: the input travels as one struct.
    rows = df.select(
        F.struct(*[df[c] for c in df.columns]).alias("row"),
        df[source_col].cast("string").alias("source"),
        F.coalesce(df[id_col].cast("string"), F.lit("")).alias("id"),
        words(text_of(df, text_col)).alias("size"),
        _uniform(df[id_col], seed).alias("u"),
    ).withColumn("bits", F.length(F.bin("size")))
    # Sums and the search of the edge run over a narrow table, so texts are read twice in all.
    narrow = saved(rows.drop("row"), "mix-sizes")
    sums = narrow.groupBy("source", "bits").agg(F.sum("size").alias("words"))
    plan = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, ceiling)
    of_source = F.col("source").eqNullSafe(F.col("of"))
    classes = sums.join(plan.withColumnRenamed("source", "of"), of_source).select("source", "bits", "words", "source_size", "target", F.lit(ceiling).alias("ceiling"))
    classes = expected_copies(classes).withColumn("whole", F.floor("copies").cast("long"))
    classes = classes.select("source", "bits", "words", "source_size", "target", "whole", (F.col("copies") - F.col("whole")).alias("part"))
    classes = saved(classes, "mix-classes")
    # Ranks fall into bins, at most BINS sums a source; the edge is found inside one row, and only its bin is ordered.
    ranked = narrow.join(classes.select(F.col("source").alias("of"), F.col("bits").alias("at"), "part"), of_source & (F.col("bits") == F.col("at")))
    ranked = ranked.where("part > 0").withColumn("rank", _rank(F.col("u"), F.col("part"))).withColumn("bin", F.floor(F.col("rank") * BINS).cast("int"))
    bins = ranked.groupBy("source", "bin").agg(F.sum("size").alias("words")).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("bin", "words"))).alias("bins"))
    room = classes.groupBy("source").agg(F.greatest(F.lit(0).cast("long"), F.round(F.first("target")).cast("long") - F.sum(F.col("whole") * F.col("words"))).alias("room"))
    start = F.struct(F.lit(-1).alias("edge"), F.lit(0).cast("long").alias("before"), F.lit(False).alias("over"))
    found = F.aggregate(
        "bins",
        start,
        lambda a, x: F.when(a["over"] | (F.col("room") == 0), a).otherwise(
            F.when(
                a["before"] + x["words"] >= F.col("room"), F.struct(x["bin"].alias("edge"), a["before"].alias("before"), F.lit(True).alias("over"))
            ).otherwise(F.struct(F.lit(BINS).alias("edge"), (a["before"] + x["words"]).alias("before"), F.lit(False).alias("over")))
        ),
    )
    edges = bins.join(room.withColumnRenamed("source", "of"), of_source).select("of", "room", found.alias("found"))
    edges = saved(edges.select("of", "room", "found.edge", "found.before"), "mix-edges")
    inside = ranked.drop("of", "at").join(edges, of_source & (F.col("bin") == F.col("edge")))
    key = F.struct("rank", "id", "size")
    groups = inside.groupBy("source", "before", "room", key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("source").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("room") - F.col("before") - F.coalesce(F.sum(F.col("n") * F.col("key.size")).over(order), F.lit(0))
    groups = groups.withColumn("left", left).where((F.col("left") > 0) & (F.col("left") <= F.col("n") * F.col("key.size")))
    last = groups.select(F.col("source").alias("last_of"), F.col("key").alias("last"), F.floor(F.col("left") / F.col("n")).cast("long").alias("each"))
    edged = edges.select("of", "edge").join(last, F.col("of").eqNullSafe(F.col("last_of")), "left").select("of", "edge", "last", "each")
    final = classes.join(edged, of_source, "left")
    final = saved(final.select(F.col("source").alias("of"), F.col("bits").alias("at"), "source_size", "target", "whole", "part", "edge", "last", "each"), "mix-plan")

    planned = rows.join(final, of_source & (F.col("bits") == F.col("at")))
    rank = F.when(F.col("part") > 0, _rank(F.col("u"), F.col("part")))
    mine = F.struct(rank.alias("rank"), "id", "size")
    full = F.when(F.floor(rank * BINS) < F.col("edge"), F.col("size")).when(F.col("last").isNotNull() & (mine < F.col("last")), F.col("size"))
    sampled = F.when(F.col("part") > 0, F.coalesce(full, F.when(mine == F.col("last"), F.col("each")), F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    out = planned.withColumn("sampled", sampled)
    added = {
        "size": F.col("size"),
        "source_size": F.col("source_size"),
        "target": F.col("target"),
        "copies": F.col("whole") + F.when((F.col("sampled") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0),
        "inclusion": F.col("part"),
        "taken": F.col("whole") * F.col("size") + F.col("sampled"),
    }
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns if c.lower() not in added], *[v.alias(k) for k, v in added.items()])


def emit(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """Turn the counts of :func:`mix` into rows: each whole copy once, then the first words of a document taken in part.

    The columns copies, size and taken are consumed; source_size, target and inclusion go with them.
    """
    rest = F.col("taken") - F.col("copies") * F.col("size")
    space = r"[\x20\x09-\x0D]"
    head = F.call_function("regexp_extract", F.col(text_col), F.concat(F.lit(f"^(?:{space}*+{WORD}+){{"), rest.cast("string"), F.lit("}+")), F.lit(0))
    copies = mixed.where(F.col("taken") > 0).withColumn(
        "part", F.explode(F.concat(F.array_repeat(F.lit(False), F.col("copies").cast("int")), F.when(rest > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>"))))
    )
    return copies.withColumn(text_col, F.when(F.col("part"), head).otherwise(F.col(text_col))).drop("part", "copies", "size", "taken", "source_size", "target", "inclusion")


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir).select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken", "copies", "inclusion")
