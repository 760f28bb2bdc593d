"""Secret scan: patterns propose credentials, corpus-wide ownership tells live-looking ones from copied examples. Native only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import documents, saved, text_of
from .spans import joined, match_spans, or_empty

#: Fixed values of the contract.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
KINDS = ("assign", "access", "hex")
#: Further shapes that providers give their keys, kept only where they look live.
PROVIDER = r"\b(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abpr]-[A-Za-z0-9-]{10,72}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,64})\b"
#: Most owners and repositories that a live-looking value is seen under.
LIVE_OWNERS, LIVE_REPOSITORIES = 1, 3


def candidate_spans(text: Column) -> Column:
    """Base spans and provider spans sorted by start, then kind; ``value`` is the credential itself."""
    lower = F.lower(text)
    word = F.lit(False)
    for w in ("password", "passwd", "secret", "token", "api_key", "apikey"):
        word = word | F.contains(lower, F.lit(w))
    assign = F.filter(or_empty(match_spans(text, ASSIGN, "assign", 0, word, group=2)), lambda s: F.length(s["value"]) >= 8)
    access = F.filter(or_empty(match_spans(text, ACCESS, "access", 1, F.contains(text, F.lit("AKIA")))), lambda s: F.length(s["value"]) >= 16)
    hexes = or_empty(match_spans(text, HEX, "hex", 2, F.lit(True)))
    shape = F.lit(False)
    for w in ("gh", "xox", "AIza", "sk_live_"):
        shape = shape | F.contains(text, F.lit(w))
    provider = or_empty(match_spans(text, PROVIDER, "provider", 3, shape))
    return F.array_sort(F.concat(assign, access, hexes, provider))


def find_secrets(
    df: DataFrame, text_col: str = "text", *, id_col: str = "doc_id", owner_col: str = "source", repository_col: str = "doc_id", live_owners: int = LIVE_OWNERS, live_repositories: int = LIVE_REPOSITORIES
) -> DataFrame:
    """One row per input row: id, ``secrets`` array of (start, rank, end, kind, hash, n_owners, n_repositories, live).

    A credential is live-looking when at most ``live_owners`` owners and at most ``live_repositories`` repositories hold
    its value; a value seen under more owners, or copied through more repositories of one owner, is a widely copied
    example. Null owners count together as one owner, null repositories as one repository. Null and
    empty texts give an empty array; repeated rows each return; an empty table returns no rows. Of the input's
    columns only the id returns, so clashing names cannot arise.
    """
    rows = df.select(
        df[id_col].alias("id"),
        df[owner_col].alias("owner"),
        df[repository_col].alias("repository"),
        candidate_spans(text_of(df, text_col)).alias("found"),
    )
    rows = saved(
        rows.select(
            F.monotonically_increasing_id().alias("row"),
            "id",
            "owner",
            "repository",
            F.transform(
                "found", lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "end", "kind")], F.xxhash64(s["value"], F.length(s["value"])).alias("hash"))
            ).alias("found"),
        ),
        "secret-candidates",
    )
    # A row's number begins with its partition's, and a partition's rows are bounded. So occurrences are counted per value
    # and partition first, and the verdict returns per value and partition: no task gathers a value, however common.
    each = rows.where(F.size("found") > 0).select("row", F.shiftright("row", 33).alias("part"), "owner", "repository", F.explode("found").alias("s"))
    each = each.select("row", "part", "owner", "repository", "s", F.col("s.hash").alias("hash"))
    by_repository = each.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count("one").alias("n_repositories"))
    held = by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n_repositories").alias("n_repositories"))
    told = each.select("hash", "part").distinct().join(held, "hash")
    judged = each.select("row", "part", "s", "hash").join(told, ["hash", "part"])
    per_row = judged.groupBy("row").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    *[F.col(f"s.{c}").alias(c) for c in ("start", "rank", "end", "kind", "hash")],
                    "n_owners",
                    "n_repositories",
                    ((F.col("n_owners") <= live_owners) & (F.col("n_repositories") <= live_repositories)).alias("live"),
                )
            )
        ).alias("secrets")
    )
    return rows.join(per_row, "row", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("secrets", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,hash:bigint,n_owners:bigint,n_repositories:bigint,live:boolean>>")).alias(
            "secrets"
        ),
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    base = F.filter("secrets", lambda s: s["rank"] < len(KINDS))
    spans = F.filter("secrets", lambda s: (s["rank"] < len(KINDS)) | s["live"])
    count = lambda test: F.size(F.filter("secrets", test)).cast("long")
    of = lambda kind: count(lambda s: s["kind"] == kind)
    return found.select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: ~s["live"]).alias("n_copied"),
    )
