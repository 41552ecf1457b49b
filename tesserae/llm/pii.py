"""Personal data: patterns propose spans, validators confirm them, context words adjust their score.

Spark expressions only, one projection over the table, no shuffle. The patterns are written with possessive
quantifiers and look-behind so that their time is linear in the text, whatever it holds; they match what the plain
forms match.

Kinds email, ip, card and phone are base kinds: what their pattern and validator accept always stays. iban and ssn are
added by score: pattern 0.4, checksum 0.4 (iban: mod 97), a context word within CONTEXT characters 0.4; spans of at
least THRESHOLD stay. So an IBAN stays on its checksum, and an SSN only beside one of its context words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Characters on either side that are searched for context words.
CONTEXT = 40
THRESHOLD = 0.8
#: Fewest characters of a match by kind: so many neighbours may lie in a context.
SHORTEST = {"email": 5, "ip": 7, "card": 2, "phone": 3, "iban": 12, "ssn": 11}
#: Matches whose offsets are summed in one fold.
FOLD = 256

OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)"
IP_VALID = rf"^0*{OCTET}(\.0*{OCTET}){{3}}$"

#: kind: (pattern, test that a text must pass before the pattern runs, checksum validated, context words)
KINDS = {
    "email": (
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@",
        "mail|contact|kontakt|correo|courriel",
    ),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", "ip|host|server|address"),
    "card": (r"[0-9](?:[\x20-]?+[0-9])++", r"[0-9][\x20-]?[0-9]", "card|visa|credit|karte|carte|tarjeta"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", "phone|tel|call|mobil|fax"),
    "iban": (r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", r"[A-Z]{2}[0-9]{2}", "iban|bank|account|konto|cuenta|compte"),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]-[0-9]{2}-[0-9]", "ssn|social security"),
}
BASE = ("email", "ip", "card", "phone")
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    rev = F.reverse(digits)

    def step(acc: Column, i: Column) -> Column:
        d = F.substr(rev, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def mod97(iban: Column) -> Column:
    """ISO 7064 remainder of an IBAN without spaces: first four characters last, letters as 10 to 35."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def step(acc: Column, i: Column) -> Column:
        c = F.substr(moved, i, F.lit(1))
        v = F.instr(F.lit("0123456789" + _LETTERS), c) - 1
        return F.when(v < 10, acc * 10 + v).otherwise(acc * 100 + v) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step)


def _card(m: Column) -> Column:
    d = _digits(m)
    return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)


def _iban(m: Column) -> Column:
    d = F.replace(m, F.lit(" "), F.lit(""))
    return F.when(F.length(d).between(15, 34), mod97(d) == 1).otherwise(False)


#: The validators; a match that fails is dropped.
VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(IP_VALID),
    "card": _card,
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
    "iban": _iban,
    "ssn": lambda m: ~m.rlike("^(000|666|9)|-00-|0000$"),
}
_CHECKSUM = ("card", "iban")


def _starts(lens: Column) -> Column:
    """Exclusive prefix sums of an array of ints, folded FOLD at a time."""

    def block(b: Column) -> Column:
        before = F.aggregate(F.slice(lens, F.lit(1), b * FOLD), F.lit(0), lambda a, x: a + x)
        zero = F.struct(before.alias("at"), F.array().cast("array<int>").alias("out"))
        done = F.aggregate(
            F.slice(lens, b * FOLD + 1, F.lit(FOLD)), zero, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        )
        return done["out"]

    last = F.floor((F.size(lens) - 1) / FOLD).cast("int")
    return F.flatten(F.transform(F.sequence(F.lit(0), last), block))


def _sides(parts: Column, found: Column) -> tuple[Column, Column]:
    """For each match, the last CONTEXT characters of it and the text between it and the match before; the first ones of it and the text up to the next match."""
    n = F.size(found)
    before = F.zip_with(F.slice(parts, F.lit(1), n), found, lambda p, m: F.right(F.concat(p, m), F.lit(CONTEXT)))
    after = F.zip_with(found, F.slice(parts, F.lit(2), n), lambda m, p: F.left(F.concat(m, p), F.lit(CONTEXT)))
    return before, after


def _spans_of(kind: str, parts: Column, found: Column, before: Column, after: Column) -> Column:
    """array<struct<kind, start, end, score>> from the texts between matches, the matches and their _sides, with validation.

    The context is CONTEXT characters of the text on either side, whatever other matches lie in it.
    """
    most = -(-CONTEXT // SHORTEST[kind])
    lens = F.zip_with(F.slice(parts, F.lit(1), F.size(found)), found, lambda p, m: F.length(p) + F.length(m))
    # a match starts after all earlier texts and matches, and the text right before it
    starts = F.zip_with(_starts(lens), F.slice(parts, F.lit(1), F.size(found)), lambda s, p: s + F.length(p))

    def one(m: Column, i: Column) -> Column:
        start = F.get(starts, i)
        first = F.greatest(i - most, F.lit(0))
        left = F.concat(F.array_join(F.slice(before, first + 1, i - first), ""), F.get(parts, i))
        right = F.concat(F.get(parts, i + 1), F.array_join(F.slice(after, i + 2, F.lit(most)), ""))
        near = F.concat(F.right(left, F.lit(CONTEXT)), F.lit("\n"), F.left(right, F.lit(CONTEXT)))
        score = 0.4 + (0.4 if kind in _CHECKSUM else 0.0) + F.when(near.rlike(f"(?i)({KINDS[kind][2]})"), 0.4).otherwise(0.0)
        return F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), F.least(score, F.lit(1.0)).alias("score"), VALID[kind](m).alias("ok")
        )

    keep = (lambda s: s["ok"]) if kind in BASE else (lambda s: s["ok"] & (s["score"] >= THRESHOLD))
    return F.filter(F.transform(found, one), keep)


_SPAN = "array<struct<kind:string,start:int,end:int,score:double,ok:boolean>>"


def with_spans(docs: DataFrame, text: str = "text", prefix: str = "_pii") -> DataFrame:
    """Adds, for each kind, a column <prefix>_<kind>: array of (kind, start, end, score, ok) in code points, end exclusive.

    Null and empty texts have empty arrays. Other columns are kept, whatever their names; prefix (free_prefix) must begin none of them.
    """
    if any(c.lower().startswith(prefix.lower()) for c in docs.columns):
        raise ValueError(f"columns begin with {prefix}; free_prefix gives one that none does")
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    name = lambda x, k: f"{prefix}_{x}_{k}"
    df = docs.withColumns({name("has", k): t.contains(g) if k == "email" else t.rlike(g) for k, (_, g, _) in KINDS.items()})
    none = F.array().cast("array<string>")
    cols = {}
    for k, (pattern, _, _) in KINDS.items():
        has = F.col(name("has", k))
        cols[name("found", k)] = F.when(has, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(none)
        cols[name("parts", k)] = F.when(has, F.split(t, pattern, -1)).otherwise(none)
    df = df.withColumns(cols)
    sides = {k: _sides(F.col(name("parts", k)), F.col(name("found", k))) for k in KINDS}
    df = df.withColumns({name(x, k): c for k, both in sides.items() for x, c in zip(("before", "after"), both, strict=True)})
    df = df.withColumns(
        {
            f"{prefix}_{k}": F.when(F.size(name("found", k)) > 0, _spans_of(k, *(F.col(name(x, k)) for x in ("parts", "found", "before", "after")))).otherwise(F.array().cast(_SPAN))
            for k in KINDS
        }
    )
    return df.drop(*(name(x, k) for x in ("has", "found", "parts", "before", "after") for k in KINDS))


def free_prefix(docs: DataFrame, prefix: str = "_pii") -> str:
    """prefix, lengthened until no column of docs begins with it."""
    while any(c.lower().startswith(prefix.lower()) for c in docs.columns):
        prefix = f"_{prefix}"
    return prefix


def _written(spans: list[Column]) -> Column:
    return F.array_join(F.transform(F.concat(*spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of its text replaced by its kind in brackets; overlapping spans become one.

    Null texts stay null. All columns and rows are kept.
    """
    prefix = free_prefix(docs)
    df, merged = with_spans(docs, text, prefix), f"{prefix}_all"
    spans = F.array_sort(F.transform(F.concat(*(F.col(f"{prefix}_{k}") for k in KINDS)), lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("k"))))
    zero = F.array().cast("array<struct<a:int,b:int,k:string>>")

    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"), last["k"].alias("k"))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["b"] > s["a"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(
            F.concat(acc, F.array(s))
        )

    df = df.withColumn(merged, spans).withColumn(merged, F.when(F.size(merged) > 0, F.aggregate(F.col(merged), zero, merge)).otherwise(zero))
    t, all_ = F.col(f"`{text}`"), F.col(merged)

    def piece(s: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(all_, i - 1)["b"]).otherwise(0)
        return F.concat(F.substr(t, before + 1, s["a"] - before), F.lit("["), F.upper(s["k"]), F.lit("]"))

    tail = F.substr(t, F.get(all_, F.size(all_) - 1)["b"] + 1)
    clean = F.when(F.size(all_) > 0, F.concat(F.array_join(F.transform(all_, piece), ""), tail)).otherwise(t)
    return df.withColumn(text, clean).drop(merged, *(f"{prefix}_{k}" for k in KINDS))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row per row of docs.

    base_sha256 covers the base kinds only, spans all kinds. A null text counts as empty; repeated rows each come
    back; other columns are not read.
    """
    df = with_spans(docs.select("doc_id", "text"))
    base = [F.col(f"_pii_{k}") for k in BASE]
    return df.select(
        "doc_id",
        *(F.size(c).cast("long").alias(f"n_{k}") for k, c in zip(BASE, base, strict=True)),
        F.sha2(_written(base), 256).alias("base_sha256"),
        _written([F.col(f"_pii_{k}") for k in KINDS]).alias("spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents", "doc_id", "text"))


def _sql() -> str:
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": KINDS["iban"][0],
        "ssn": KINDS["ssn"][0],
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn_sql = (
        f"list_sum([CASE WHEN i % 2 = 0 THEN 2 * CAST(reverse({digits})[i] AS INT) - CASE WHEN CAST(reverse({digits})[i] AS INT) > 4 THEN 9 ELSE 0 END"
        f" ELSE CAST(reverse({digits})[i] AS INT) END for i in range(1, length({digits}) + 1)]) % 10 = 0"
    )
    b = "replace(m, ' ', '')"
    number = f"list_aggregate([CAST(strpos('0123456789{_LETTERS}', (substr({b}, 5) || left({b}, 4))[i]) - 1 AS VARCHAR) for i in range(1, length({b}) + 1)], 'string_agg', '')"
    mod = f"list_reduce(list_prepend(0, [CAST(d AS INT) for d in string_split({number}, '')]), lambda a, x: (a * 10 + x) % 97)"
    valid = {
        "email": "true",
        "ip": f"regexp_matches(m, '{IP_VALID}')",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND {luhn_sql}",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"length({b}) BETWEEN 15 AND 34 AND {mod} = 1",
        "ssn": "NOT regexp_matches(m, '^(000|666|9)|-00-|0000$')",
    }
    parts = []
    for n, (k, p) in enumerate(plain.items()):
        score = f"0.4 + {0.4 if k in _CHECKSUM else 0.0} + CASE WHEN regexp_matches(near, '(?i)({KINDS[k][2]})') THEN 0.4 ELSE 0.0 END"
        parts.append(
            f"SELECT doc_id, {n} AS kn, '{k}' AS kind, a, a + length(m) AS b FROM (SELECT doc_id, f[i] AS m,"
            f" CAST(coalesce(list_sum([length(p[j]) for j in range(1, i + 1)]), 0) + coalesce(list_sum([length(f[j]) for j in range(1, i)]), 0) AS BIGINT) AS a,"
            f" right(p[i], {CONTEXT}) || chr(10) || left(p[i + 1], {CONTEXT}) AS near"
            f" FROM (SELECT doc_id, f, p, unnest(range(1, len(f) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS f, string_split_regex(text, '{p}') AS p FROM documents)))"
            f" WHERE {valid[k]}" + ("" if k in BASE else f" AND {score} >= {THRESHOLD}")
        )
    one = "kind || ':' || a || ':' || b"
    return (
        "WITH s AS (" + " UNION ALL ".join(parts) + "), g AS (SELECT doc_id, "
        + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE)
        + f", string_agg({one}, ',' ORDER BY kn, a) FILTER (WHERE kn < {len(BASE)}) AS base, string_agg({one}, ',' ORDER BY kn, a) AS spans FROM s GROUP BY doc_id)"
        + " SELECT d.doc_id, " + ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)
        + ", sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN g USING (doc_id)"
    )


ORACLE = _sql()
