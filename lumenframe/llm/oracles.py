"""DuckDB SQL of the queries that SQL can express, by plain methods."""

from __future__ import annotations

from .pii import AGAINST, CONTEXT, CONTEXT_BONUS, CONTEXT_MALUS, MINIMUM, SCORES

WORD = r"[^\x20\x09-\x0D]+"


def _place(name: str, rank: int, kind: str, pattern: str, group: int = 0) -> str:
    """Spans of one kind: matches and the gaps between them alternate."""
    return f"""{name} AS (SELECT doc_id, {rank} AS rank, '{kind}' AS kind, start AS "start", start + length(m) AS "end", m, v FROM (
      SELECT doc_id, unnest(list_transform(range(1, len(ms) + 1), lambda i: coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)))::BIGINT AS start, unnest(ms) AS m, unnest(vs) AS v
      FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, regexp_extract_all(text, '{pattern}', {group}) AS vs, string_split_regex(text, '{pattern}') AS gs FROM d)))"""


_DOCS = "d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents)"
_JOINED = """coalesce(string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", rank){filter}, '')"""

_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(0, length({_DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN {_DIGITS}[length({_DIGITS}) - i]::INT ELSE {_DIGITS}[length({_DIGITS}) - i]::INT * 2 - CASE WHEN {_DIGITS}[length({_DIGITS}) - i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_FLAT = "(replace(m, ' ', '')[5:] || replace(m, ' ', '')[:4])"
_MOD97 = f"list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length({_FLAT}) + 1), lambda i: CASE WHEN ascii({_FLAT}[i]) >= 65 THEN 1000 + ascii({_FLAT}[i]) - 55 ELSE ascii({_FLAT}[i]) - 48 END::BIGINT)), lambda a, c: (CASE WHEN c >= 1000 THEN a * 100 + c - 1000 ELSE a * 10 + c END) % 97) = 1"

#: The text 40 characters around a span, and its score.
_NEAR = """translate(substr(text, greatest(1, "start" - 39), least(40, "start")) || m || substr(text, "end" + 1, 40), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""
_SCORE = " ".join(f"WHEN '{k}' THEN {v} + CASE WHEN regexp_matches(near, '{CONTEXT[k]}') THEN {CONTEXT_BONUS} ELSE 0 END - CASE WHEN regexp_matches(near, '{AGAINST[k]}') THEN {CONTEXT_MALUS} ELSE 0 END" for k, v in SCORES.items())

PII = f"""WITH {_DOCS},
{_place("email", 0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")},
{_place("ip", 1, "ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")},
{_place("card", 2, "card", r"[0-9](?:[\x20-]?[0-9])+")},
{_place("phone", 3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]")},
{_place("iban", 4, "iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b")},
s AS (SELECT * FROM email UNION ALL SELECT * FROM ip WHERE list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(try_cast(right(x, 3) AS INT), 999) <= 255))
  UNION ALL SELECT * FROM card WHERE length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN} UNION ALL SELECT * FROM phone WHERE length({_DIGITS}) BETWEEN 9 AND 15 UNION ALL SELECT * FROM iban WHERE {_MOD97}),
x AS (SELECT s.*, {_NEAR} AS near FROM s JOIN d USING (doc_id)),
p AS (SELECT *, round(1000 * least(1.0, CASE kind {_SCORE} END))::INT AS score FROM x)
SELECT d.doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  sha256({_JOINED.format(filter=" FILTER (rank < 4)")}) AS base_sha256, {_JOINED.format(filter=" FILTER (kind IS NOT NULL)")} AS spans, count(*) FILTER (kind = 'iban') AS n_iban,
  coalesce(string_agg(score::VARCHAR, ',' ORDER BY "start", rank) FILTER (kind IS NOT NULL), '') AS scores, count(*) FILTER (score >= {round(1000 * MINIMUM)}) AS n_personal
FROM d LEFT JOIN p USING (doc_id) GROUP BY d.doc_id"""

SECRETS = f"""WITH {_DOCS},
{_place("assign", 0, "assign", r'(?:(?i)password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'.replace("(?:(?i)", "((?i)") , 2)},
{_place("access", 1, "access", "AKIA[A-Z0-9]+")},
{_place("hexes", 2, "hex", "[0-9a-f]{32,}")},
{_place("provider", 3, "provider", r"\b(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abpr]-[A-Za-z0-9-]{10,72}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,64})\b")},
s AS (SELECT * FROM assign WHERE length(v) >= 8 UNION ALL SELECT * FROM access WHERE length(m) >= 16 UNION ALL SELECT * FROM hexes UNION ALL SELECT * FROM provider),
held AS (SELECT v, count(DISTINCT coalesce(source, chr(0))) AS owners, count(DISTINCT doc_id) AS repositories FROM s JOIN d USING (doc_id) GROUP BY v), j AS (SELECT s.*, owners <= 1 AND repositories <= 3 AS live FROM s JOIN held USING (v))
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256({_JOINED.format(filter=" FILTER (rank < 3)")}) AS base_sha256, {_JOINED.format(filter=" FILTER (rank < 3 OR live)")} AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied
FROM d LEFT JOIN j USING (doc_id) GROUP BY d.doc_id"""

MIX = f"""WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, (('0x' || substr(md5('17:' || doc_id), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656 AS u FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM s GROUP BY source),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM t WINDOW b AS (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, max(CASE WHEN 3.0::DOUBLE * source_size > level * w THEN level END) OVER () AS top FROM l),
p AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, coalesce(top * w, 3.0::DOUBLE * source_size)) AS target FROM m),
k AS (SELECT s.source, length(bin(size)) AS bits, any_value(source_size) AS source_size, any_value(target) AS target, sum(size)::BIGINT AS words FROM s JOIN p ON s.source IS NOT DISTINCT FROM p.source GROUP BY s.source, bits),
e AS (SELECT *, sum((bits + 8.0::DOUBLE) * words) OVER (PARTITION BY source ORDER BY bits DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight, coalesce(sum(words) OVER (PARTITION BY source ORDER BY bits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS fuller FROM k),
f AS (SELECT *, CASE WHEN weight > 0 THEN (target - 3.0::DOUBLE * fuller) / weight ELSE 0 END AS level FROM e),
h AS (SELECT *, arg_max(level, bits) FILTER (level * (bits + 8.0::DOUBLE) < 3) OVER (PARTITION BY source) AS top FROM f),
c AS (SELECT *, greatest(0, least(3.0::DOUBLE, coalesce(top * (bits + 8.0::DOUBLE), 3))) AS copies FROM h),
q AS (SELECT source, bits, source_size, target, floor(copies)::BIGINT AS whole, copies - floor(copies) AS part, sum(floor(copies)::BIGINT * words) OVER (PARTITION BY source) AS certain FROM c),
o AS (SELECT s.*, source_size, target, whole, part, greatest(0, round(target)::BIGINT - certain) AS room, CASE WHEN part > 0 THEN (u / (1 - u)) / (part / (1 - part)) END AS odds FROM s JOIN q ON s.source IS NOT DISTINCT FROM q.source AND length(bin(size)) = bits),
r AS (SELECT *, sum(size) OVER (PARTITION BY source, part > 0 ORDER BY odds / (1 + odds), doc_id::VARCHAR, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before FROM o),
z AS (SELECT *, CASE WHEN part > 0 THEN greatest(0, least(size, room - before))::BIGINT ELSE 0 END AS sampled FROM r)
SELECT doc_id, size::BIGINT AS size, source_size, target, (whole * size + sampled)::BIGINT AS taken, (whole + CASE WHEN sampled = size AND size > 0 THEN 1 ELSE 0 END)::BIGINT AS copies, part AS inclusion FROM z"""

_WALK = """sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
walk(node, root) AS (SELECT a, a FROM sym UNION SELECT sym.b, walk.root FROM walk JOIN sym ON sym.a = walk.node AND walk.root < sym.b),
comp AS (SELECT node, min(root) AS root FROM walk GROUP BY node)"""

NEAR_TEXT = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + 4], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i.n >= 75 * (p.n + q.n - i.n)),
{_WALK}
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(root, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(root, w.doc_id)) AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.node = w.doc_id"""

NEAR_VECTOR = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.98),
{_WALK},
n AS (SELECT a, count(*) AS n FROM sym GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(root, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(root, vec_id)) AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN comp ON comp.node = vec_id"""

ORACLES = {"op2_near_vectors": NEAR_VECTOR, "op4_near_dedup": NEAR_TEXT, "op7_mix": MIX, "op8_secrets": SECRETS, "op9_pii": PII}
