"""The difference string (cs) of an alignment: events, introns, reverse complement, motif-blind form.

A string is split into its operations once, by one regular expression; bytes that begin no operation
fall between the matches and are skipped. ``:n`` and ``=seq`` match, ``*xy`` substitutes, ``+seq`` inserts,
``-seq`` deletes, ``~ppNss`` is an intron of N bases between motif halves pp and ss.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.memo import remembered

OPERATION = "(?s):[0-9]*|[=+-][A-Za-z]*|\\*.{0,2}|~.{0,2}[0-9]*.{0,2}"
BASES, PAIRED = "ACGTacgt", "TGCAtgca"
COUNTED = {":": "match", "=": "match", "*": "substitution", "+": "insertion", "-": "deletion", "~": "intron"}
INTRONS = "array<struct<q:bigint,start:bigint,end:bigint,motif:string>>"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda's argument isn't inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def apart(value: Column) -> Column:
    """``value`` by a lambda, whose projection is then compiled by itself, in methods of small size.

    A stage compiled as a whole is one method; the JVM only interprets a method of more than 8,000 bytes.
    """
    return let(value, lambda v: v)


def operations(cs: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(cs, F.lit("")), F.lit(OPERATION), F.lit(0))


def complement(bases: Column) -> Column:
    return F.translate(bases, BASES, PAIRED)


def revcomp_bases(bases: Column) -> Column:
    return F.reverse(complement(bases))


def _tail(op: Column, start: int = 2) -> Column:
    return F.substring(op, F.lit(start), F.length(op))


def _intron_parts(op: Column) -> tuple[Column, Column, Column]:
    part = lambda i: F.regexp_extract(op, "(?s)^~(.{0,2})([0-9]*)(.{0,2})$", i)
    return part(1), part(2), part(3)


def _number(digits: Column) -> Column:
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def _width(op: Column) -> Column:
    """Bases of an operation."""
    kind = F.left(op, F.lit(1))
    return (
        F.when(kind == ":", _number(_tail(op)))
        .when(kind == "~", _number(_intron_parts(op)[1]))
        .when(kind == "*", F.lit(1).cast("bigint"))
        .otherwise((F.length(op) - 1).cast("bigint"))
    )


def _motif(op: Column) -> Column:
    left, _, right = _intron_parts(op)
    return F.lower(F.concat(F.rpad(left, 2, "n"), F.rpad(right, 2, "n")))


def sized(cs: Column) -> Column:
    """array<struct<kind, n, op>>: the operations with their bases."""
    return F.transform(operations(cs), lambda op: F.struct(F.left(op, F.lit(1)).alias("kind"), _width(op).alias("n"), op.alias("op")))


@remembered
def introns(cs: Column) -> Column:
    """array<struct<q, start, end, motif>>: query place and reference span of each intron, from the alignment's start."""
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("q"), zero.alias("r"), F.array().cast(INTRONS).alias("found"))

    def step(acc: Column, op: Column) -> Column:
        q = acc["q"] + F.when(op["kind"].isin(":", "=", "*", "+"), op["n"]).otherwise(zero)
        r = acc["r"] + F.when(op["kind"] == "+", zero).otherwise(op["n"])
        one = F.struct(acc["q"].alias("q"), acc["r"].alias("start"), (acc["r"] + op["n"]).alias("end"), _motif(op["op"]).alias("motif"))
        return F.struct(q.alias("q"), r.alias("r"), F.when(op["kind"] == "~", F.array_append(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    has = F.contains(cs, F.lit("~"))
    return F.when(has, F.aggregate(sized(cs), start, step, lambda acc: acc["found"])).otherwise(F.array().cast(INTRONS))


@remembered
def event_counts(cs: Column) -> Column:
    """struct with n_<event>_events and n_<event>_bases."""

    def counts(ops: Column) -> Column:
        def of(event: str) -> list[Column]:
            kinds = [k for k, e in COUNTED.items() if e == event]
            own = F.filter(ops, lambda op: op["kind"].isin(*kinds))
            return [
                F.size(own).cast("bigint").alias(f"n_{event}_events"),
                F.aggregate(own, F.lit(0).cast("bigint"), lambda acc, op: acc + op["n"]).alias(f"n_{event}_bases"),
            ]

        return F.struct(*[c for event in ("match", "substitution", "insertion", "deletion", "intron") for c in of(event)])

    return let(sized(cs), counts)


@remembered
def revcomp(cs: Column) -> Column:
    """The string of the same alignment seen from the other strand."""

    def turned(op: Column) -> Column:
        kind = F.left(op, F.lit(1))
        left, digits, right = _intron_parts(op)
        return (
            F.when(kind == ":", op)
            .when(kind == "*", F.concat(F.lit("*"), complement(F.rpad(_tail(op), 2, "n"))))
            .when(kind == "~", F.concat(F.lit("~"), revcomp_bases(right), digits, revcomp_bases(left)))
            .otherwise(F.concat(kind, revcomp_bases(_tail(op))))
        )

    return F.array_join(F.transform(F.reverse(operations(cs)), turned), "")


@remembered
def strip_motifs(cs: Column) -> Column:
    """The string with every intron motif blanked; aligners differ in whether they report motifs."""

    def blank(op: Column) -> Column:
        return F.when(F.startswith(op, F.lit("~")), F.concat(F.lit("~nn"), _intron_parts(op)[1], F.lit("nn"))).otherwise(op)

    return F.array_join(F.transform(operations(cs), blank), "")


def oriented_motif(motif: Column, strand: Column) -> Column:
    """``gt-ag``: four letters, turned if the intron lies on the minus strand."""
    turned = F.when(strand == "-", revcomp_bases(motif)).otherwise(motif)
    return F.concat(F.left(turned, F.lit(2)), F.lit("-"), F.right(turned, F.lit(2)))
