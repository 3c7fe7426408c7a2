"""Personal data, with DataFrame functions alone.

Regular expressions propose spans, checks confirm them (Luhn for cards, mod 97 for IBANs, number
ranges for IPs, digit counts for phones), and words in the 40 characters before a span move its
score. Kinds, in order: email, ip, card, phone, iban. A kind's spans are its pattern's leftmost
non-overlapping matches in the whole text; a match that fails its check is dropped, and the search
goes on behind it. Kinds may overlap each other.

Every pattern takes linear time: runs are possessive and may begin only where a run begins.

Null and empty texts give empty span lists. Rows are independent of each other, so repeated rows and
ties need no rule. An empty table gives an empty one. Other columns pass through or are ignored; a column
that has the name asked for (``out``) is refused with an error, never overwritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import let, spans_of, sql_spans

LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = f"(?:\\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = "[0-9](?:[\\x20-]?+[0-9])++"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
IBAN = "[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\\x20[A-Z0-9]{4}){2,7}(?:\\x20[A-Z0-9]{1,3})?)"

KINDS = ("email", "ip", "card", "phone", "iban")
BASE_KINDS = KINDS[:4]
SCORE = {"email": 90, "ip": 50, "card": 70, "phone": 60, "iban": 90}
STEP = 20
NEAR = {
    "email": "[Mm]ail|[Cc]ontact|[Ww]rite",
    "ip": "IP|[Ss]erver|[Hh]ost|[Aa]ddress",
    "card": "[Cc]ard|[Vv]isa|[Cc]redit|[Pp]ayment",
    "phone": "[Tt]el|[Pp]hone|[Cc]all|[Ff]ax",
    "iban": "IBAN|[Aa]ccount|[Bb]ank",
}
AGAINST = "[Vv]ersion|ISBN|[Oo]rder|[Ss]erial"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def is_ip(hit: Column) -> Column:
    """Each part is at most 255, whatever its leading zeros."""

    def small(part: Column) -> Column:
        return let(F.regexp_replace(part, "^0+", ""), lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))

    return F.forall(F.split(hit, "\\."), small)


def luhn(digits: Column) -> Column:
    def worth(i: Column) -> Column:
        digit = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, digit).otherwise(digit * 2 - F.when(digit > 4, 9).otherwise(0))

    places = F.sequence(F.lit(1), F.length(digits))
    return F.aggregate(F.transform(places, worth), F.lit(0), lambda acc, x: acc + x) % 10 == 0


def is_card(hit: Column) -> Column:
    return let(_digits(hit), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))


def is_phone(hit: Column) -> Column:
    return F.length(_digits(hit)).between(8, 15)


def is_iban(hit: Column) -> Column:
    """ISO 13616: the first four characters go to the end, letters count from 10; the rest by 97 is 1."""

    def rest(code: Column) -> Column:
        moved = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))
        return let(
            moved,
            lambda m: F.aggregate(
                F.sequence(F.lit(1), F.length(m)),
                F.lit(0),
                lambda acc, i: let(
                    F.ascii(F.substring(m, i, F.lit(1))),
                    lambda c: F.when(c < 58, (acc * 10 + c - 48) % 97).otherwise((acc * 100 + c - 55) % 97),
                ),
            ),
        )

    return let(F.replace(hit, F.lit(" "), F.lit("")), lambda code: F.when(F.length(code).between(15, 34), rest(code) == 1).otherwise(False))


def _kinds(text: Column) -> list[tuple[str, Column, object]]:
    return [
        ("email", spans_of(text, EMAIL, F.contains(text, F.lit("@"))), None),
        ("ip", spans_of(text, IP, text.rlike("[0-9]\\.[0-9]++\\.[0-9]")), is_ip),
        ("card", spans_of(text, CARD, text.rlike("[0-9](?:[\\x20-]?[0-9]){15}")), is_card),
        ("phone", spans_of(text, PHONE, F.contains(text, F.lit("+"))), is_phone),
        ("iban", spans_of(text, IBAN, text.rlike("[A-Z]{2}[0-9]{2}[\\x20A-Z0-9]{4}")), is_iban),
    ]


def _score(kind: str, before: Column) -> Column:
    moved = F.lit(SCORE[kind]) + F.when(before.rlike(NEAR[kind]), STEP).otherwise(0) - F.when(before.rlike(AGAINST), STEP).otherwise(0)
    return F.least(moved, F.lit(100)).cast("int")


def personal_data(text: Column) -> Column:
    """array<struct<kind string, start bigint, end bigint, hit string, score int>> by kind, then start."""

    def of_kind(kind: str, spans: Column, check) -> Column:
        kept = F.filter(spans, lambda s: check(s["hit"])) if check else spans
        return F.transform(
            kept,
            lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), _score(kind, s["before"]).alias("score")),
        )

    return F.concat(*[of_kind(*k) for k in _kinds(text)])


def find_personal_data(docs: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with the array column ``out``, a name that ``docs`` doesn't have."""
    if out.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"the column {out} is there already; name another one")
    return docs.withColumn(out, personal_data(F.coalesce(F.col(text_col), F.lit(""))))


def mask_personal_data(docs: DataFrame, text_col: str = "text", least_score: int = 50) -> DataFrame:
    """``docs`` with spans of at least ``least_score`` overwritten by their kinds; overlaps go to the span that starts first."""

    def masked(text: Column, spans: Column) -> Column:
        order = F.array_sort(F.filter(spans, lambda s: s["score"] >= least_score), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(b["end"].cast("int") - a["end"].cast("int")))
        start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))

        def step(acc: Column, s: Column) -> Column:
            gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
            return F.when(s["start"] < acc["at"], acc).otherwise(
                F.struct(F.concat(acc["text"], gap, F.lit("<"), s["kind"], F.lit(">")).alias("text"), s["end"].alias("at"))
            )

        return F.aggregate(order, start, step, lambda acc: F.concat(acc["text"], F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text))))

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), let(text, lambda t: let(personal_data(t), lambda s: masked(t, s)))))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, a hash of the base spans, all spans, and their scores."""
    found = find_personal_data(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text")
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def _sql() -> str:
    digits = "regexp_replace(x.h, '[^0-9]', '', 'g')"
    luhn_sql = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {digits}[-i]::INT ELSE {digits}[-i]::INT * 2 - CASE WHEN {digits}[-i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
    code = "replace(x.h, ' ', '')"
    moved = f"({code}[5:] || {code}[1:4])"
    as_digits = f"list_aggregate(list_transform(range(1, length({moved}) + 1), lambda i: CASE WHEN ascii({moved}[i]) < 58 THEN {moved}[i] ELSE CAST(ascii({moved}[i]) - 55 AS VARCHAR) END), 'string_agg', '')"
    mod = f"list_reduce(list_transform(string_split(regexp_replace({as_digits}, '(.)', '\\1,', 'g'), ','), lambda c: coalesce(try_cast(c AS INT), -1)), lambda a, c: CASE WHEN c < 0 THEN a ELSE (a * 10 + c) % 97 END)"
    kinds = {
        "email": ("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "true"),
        "ip": ("[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)", "len(list_filter(string_split(x.h, '.'), lambda p: try_cast(ltrim(p, '0') || '' AS HUGEINT) > 255 OR length(ltrim(p, '0')) > 3)) = 0"),
        "card": ("[0-9](?:[\\x20-]?[0-9])+", f"CASE WHEN length({digits}) BETWEEN 16 AND 19 THEN {luhn_sql} ELSE false END"),
        "phone": ("\\+[0-9][\\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 8 AND 15"),
        "iban": (IBAN, f"CASE WHEN length({code}) BETWEEN 15 AND 34 THEN {mod} = 1 ELSE false END"),
    }
    lists = ", ".join(f"{sql_spans(p)} AS all_{k}" for k, (p, _) in kinds.items())
    kept = ", ".join(f"list_filter(all_{k}, lambda x: {check}) AS k_{k}" for k, (_, check) in kinds.items())
    text = lambda ks: " || ".join(f"list_transform(k_{k}, lambda x: '{k}:' || x.s || ':' || x.e)" for k in ks)
    score = " || ".join(
        f"list_transform(k_{k}, lambda x: CAST(least(100, {SCORE[k]} + CASE WHEN regexp_matches(x.b, '{NEAR[k]}') THEN {STEP} ELSE 0 END - CASE WHEN regexp_matches(x.b, '{AGAINST}') THEN {STEP} ELSE 0 END) AS VARCHAR))"
        for k in KINDS
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, {lists} FROM d),
q AS (SELECT doc_id, {kept} FROM p)
SELECT doc_id, {", ".join(f"len(k_{k})::BIGINT AS n_{k}" for k in BASE_KINDS)},
  sha256(array_to_string({text(BASE_KINDS)}, ',')) AS base_sha256,
  array_to_string({text(KINDS)}, ',') AS spans,
  array_to_string({score}, ',') AS scores
FROM q"""


ORACLE = _sql()
