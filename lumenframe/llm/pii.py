"""Personal data: patterns propose, checksums confirm, nearby words adjust the score. Native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import documents, text_of
from .spans import joined, match_spans, or_empty

#: Fixed values of the contract, written with possessive repeats where nothing after them could match less.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b"
KINDS = ("email", "ip", "card", "phone")

#: Confidence of a confirmed span before its context is read, and what a context word adds.
SCORES = {"email": 0.8, "ip": 0.5, "card": 0.6, "phone": 0.4, "iban": 0.8}
CONTEXT = {
    "email": r"mail|contact|write|reply|schreib|correo|courriel",
    "ip": r"(?:^|[^a-z0-9])ip(?:$|[^a-z0-9])|address|server|host|login|adresse",
    "card": r"card|visa|master|credit|payment|karte|tarjeta|carte",
    "phone": r"phone|call|tel|mobile|fax|dial|anruf|llam|appel",
    "iban": r"iban|bank|account|transfer|konto|cuenta|compte",
}
#: Words that speak against a span: numbers of versions, orders and goods.
AGAINST = {
    "email": r"example\.(?:com|org|net)",
    "ip": r"version|release|build|firmware",
    "card": r"isbn|tracking|serial|part no|order no",
    "phone": r"isbn|tracking|serial|part no|order no",
    "iban": r"serial|part no|order no",
}
CONTEXT_BONUS, CONTEXT_MALUS = 0.2, 0.3
#: Spans that score at least this are personal data: every confirmed one, unless words speak against it and none for it.
MINIMUM = 0.4
#: Times that a text is read for spans when it is redacted, the later ones only if the one before found any.
PASSES = 2
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the Luhn check."""
    backwards = F.split(F.reverse(_digits(value)), "")
    doubled = F.transform(
        F.filter(backwards, lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether ``value``, four first characters moved to the end and letters read as 10 to 35, leaves 1 modulo 97."""
    flat = F.replace(value, F.lit(" "), F.lit(""))
    chars = F.filter(F.split(F.concat(F.substring(flat, 5, 64), F.substring(flat, 1, 4)), ""), lambda c: c != "")
    return (
        F.aggregate(
            chars,
            F.lit(0),
            lambda a, c: (F.when(F.ascii(c) >= 65, a * 100 + F.ascii(c) - 55).otherwise(a * 10 + F.ascii(c) - 48)) % 97,
        )
        == 1
    )


def _octets(value: Column) -> Column:
    """All parts of a dotted number at most 255, leading zeros allowed."""
    bare = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return ~F.exists(bare, lambda p: (F.length(p) > 3) | (F.substring(p, 1, 3).cast("int") > 255))


def pii_spans(text: Column, window: int = 40) -> Column:
    """Confirmed spans sorted by start, then kind: structs of start, rank, end, kind, value, near."""
    count = lambda s: F.length(_digits(s["value"]))
    digit = F.regexp_like(text, F.lit("[0-9]{2}|[0-9][ -][0-9]"))
    email = or_empty(match_spans(text, EMAIL, "email", 0, F.contains(text, F.lit("@")), window=window))
    ip = F.filter(or_empty(match_spans(text, IP, "ip", 1, F.contains(text, F.lit(".")), window=window)), lambda s: _octets(s["value"]))
    card = F.filter(or_empty(match_spans(text, CARD, "card", 2, digit, window=window)), lambda s: count(s).between(12, 19) & luhn(s["value"]))
    phone = F.filter(or_empty(match_spans(text, PHONE, "phone", 3, F.contains(text, F.lit("+")), window=window)), lambda s: count(s).between(9, 15))
    iban = F.filter(or_empty(match_spans(text, IBAN, "iban", 4, F.regexp_like(text, F.lit("[A-Z]{2}[0-9]{2}")), window=window)), lambda s: mod97(s["value"]))
    return F.array_sort(F.concat(email, ip, card, phone, iban))


def _score(s: Column) -> Column:
    near = F.translate(s["near"], _UPPER, _UPPER.lower())
    score = F.lit(0.0)
    for kind, value in SCORES.items():
        bonus = F.when(F.regexp_like(near, F.lit(CONTEXT[kind])), CONTEXT_BONUS).otherwise(0.0)
        malus = F.when(F.regexp_like(near, F.lit(AGAINST[kind])), CONTEXT_MALUS).otherwise(0.0)
        score = F.when(s["kind"] == kind, F.lit(value) + bonus - malus).otherwise(score)
    return F.round(F.least(F.lit(1.0), score), 3)


def find_pii(df: DataFrame, text_col: str = "text", *, window: int = 40) -> DataFrame:
    """Append ``pii``, an array of (start, rank, end, kind, value, score), to every row.

    Offsets count code points, end exclusive. Words up to ``window`` characters away on either side move the score: up
    where they speak for the kind, down where they speak against it. Null and empty texts get an empty array. All other columns are
    carried; an input column named ``pii`` is replaced. Rows are independent, so ties, repeated rows and an
    empty table need no rule of their own.
    """
    text = text_of(df, text_col)
    with_spans = df.withColumn("pii", pii_spans(text, window))
    return with_spans.withColumn(
        "pii",
        F.transform(
            with_spans["pii"],
            lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "end", "kind", "value")], _score(s).alias("score")),
        ),
    )


def _without(text: Column, spans: Column) -> Column:
    """``text`` with each of the sorted ``spans`` replaced by its kind in angle brackets."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    return F.aggregate(
        spans,
        state,
        lambda a, s: F.when(
            s["start"] >= a["at"],
            F.struct(
                s["end"].alias("at"),
                F.concat(a["parts"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("<"), s["kind"], F.lit(">")))).alias("parts"),
            ),
        ).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["parts"].alias("parts"))),
        lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["at"] + 1, F.length(text))),
    )


def redact(df: DataFrame, text_col: str = "text", *, minimum_score: float = MINIMUM) -> DataFrame:
    """Replace each found span scoring at least ``minimum_score`` by its kind in angle brackets; texts without one stay as they are.

    Of overlapping spans the first by start (then kind) is named and the union is cut out. Removing a span may leave a
    new one beside it (what was too long for a phone number with a card behind it), so changed texts are read
    PASSES times. Null texts stay null. Adds nothing: the columns of ``df`` return.
    """
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[text_col].cast("string").alias("text"), df[text_col].cast("string").alias("changed"))
    for _ in range(PASSES):
        rows = find_pii(rows, "changed")
        rows = rows.withColumn("pii", F.filter("pii", lambda s: s["score"] >= minimum_score))
        # A text that a pass leaves as it was is null from then on, which costs the next pass nothing.
        rows = rows.withColumn("changed", F.when(F.size("pii") > 0, _without(F.col("changed"), F.col("pii"))))
        rows = rows.select("row", F.coalesce("changed", "text").alias("text"), "changed")
    return rows.select(*[(F.col("text") if c.lower() == text_col.lower() else F.col(f"row.`{c}`")).alias(c) for c in df.columns])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter(found["pii"], lambda s: s["rank"] < len(KINDS))
    count = lambda kind: F.size(F.filter(found["pii"], lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(found["pii"]).alias("spans"),
        F.concat_ws(",", F.transform(found["pii"], lambda s: F.round(s["score"] * 1000).cast("int").cast("string"))).alias("scores"),
        F.size(F.filter(found["pii"], lambda s: s["score"] >= MINIMUM)).cast("long").alias("n_personal"),
        count("iban").alias("n_iban"),
    )
