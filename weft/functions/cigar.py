"""CIGAR strings: operations, statistics, introns; and cs strings rebuilt from MD, CIGAR and SEQ."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.cs import let
from weft.functions.memo import remembered

OPERATION = "[0-9]+[^0-9]"
SPANS = "array<struct<start:bigint,end:bigint>>"


def operations(cigar: Column) -> Column:
    """array<struct<n, op>>; digits without an operation behind them are left out."""
    return F.transform(
        F.regexp_extract_all(cigar, F.lit(OPERATION), F.lit(0)),
        lambda t: F.struct(F.coalesce(F.left(t, F.length(t) - 1).try_cast("bigint"), F.lit(0).cast("bigint")).alias("n"), F.right(t, F.lit(1)).alias("op")),
    )


@remembered
def stats(cigar: Column) -> Column:
    """struct of an alignment's lengths.

    m counts M, = and X; lead is the clip that is the very first operation, trail any other; query_len counts
    clipped bases, query_consumed only those that SEQ holds.
    """

    def made(ops: Column) -> Column:
        def total(*kinds: str) -> Column:
            return F.aggregate(F.filter(ops, lambda o: o["op"].isin(*kinds)), F.lit(0).cast("bigint"), lambda acc, o: acc + o["n"])

        def number(*kinds: str) -> Column:
            return F.size(F.filter(ops, lambda o: o["op"].isin(*kinds))).cast("bigint")

        zero = F.lit(0).cast("bigint")
        clip = lambda o: o["op"].isin("S", "H")
        first = F.get(ops, F.lit(0))
        lead = F.coalesce(F.when(clip(first), first["n"]), zero)
        rest = F.filter(F.slice(ops, 2, F.greatest(F.size(ops) - 1, F.lit(0))), clip)
        # of several later clips, the last counts
        trail = F.coalesce(F.get(rest, F.size(rest) - 1)["n"], zero)
        m, ins, dele, skip = total("M", "=", "X"), total("I"), total("D"), total("N")
        return F.struct(
            m.alias("m"), ins.alias("i_bases"), dele.alias("d_bases"), skip.alias("n_bases"), number("I").alias("i_count"), number("D").alias("d_count"), total("S").alias("soft"),
            lead.alias("lead"), trail.alias("trail"), total("X").alias("mismatches"), F.exists(ops, lambda o: o["op"].isin("=", "X")).alias("extended"), F.exists(ops, lambda o: o["op"] == "M").alias("plain"),
            (m + dele + skip).alias("ref_len"), (m + ins + total("S")).alias("query_consumed"), (m + ins + lead + trail).alias("query_len"), (m + ins + dele).alias("block_len"), F.size(ops).alias("n_ops"),
        )

    return let(operations(cigar), made)


@remembered
def introns(cigar: Column) -> Column:
    """array<struct<start, end>>: skipped reference spans from the alignment's start; a malformed tail is left out."""
    sound = F.regexp_extract(cigar, "^(?:[0-9]+[^0-9])*", 0)
    # only what moves along the reference, and in one lambda: lambdas are interpreted
    moving = F.regexp_extract_all(sound, F.lit("[0-9]+[M=XDN]"), F.lit(0))
    zero = F.lit(0).cast("bigint")
    start = F.struct(F.lit(0).cast("bigint").alias("r"), F.array().cast(SPANS).alias("found"))

    def step(acc: Column, t: Column) -> Column:
        end = acc["r"] + F.coalesce(F.left(t, F.length(t) - 1).try_cast("bigint"), zero)
        return F.struct(end.alias("r"), F.when(F.endswith(t, F.lit("N")), F.array_append(acc["found"], F.struct(acc["r"].alias("start"), end.alias("end")))).otherwise(acc["found"]).alias("found"))

    return F.when(F.contains(cigar, F.lit("N")), F.aggregate(moving, start, step, lambda acc: acc["found"])).when(cigar.isNotNull(), F.array().cast(SPANS))


def without_clips(cigar: Column) -> Column:
    return F.regexp_replace(cigar, "[0-9]+[SH]", "")


def calibrated(s: Column, nm: Column) -> tuple[Column, Column]:
    """(NM or null, mismatches) from the statistics and the NM tag."""
    gaps = s["i_bases"] + s["d_bases"]
    exact = s["extended"] & ~s["plain"]
    total = F.when(exact, gaps + s["mismatches"]).when(nm.isNotNull(), F.greatest(nm, gaps))
    return total, F.when(exact, s["mismatches"]).when(nm.isNotNull(), F.greatest(nm, gaps) - gaps).otherwise(F.lit(0).cast("bigint"))


class Inconsistent(ValueError):
    """MD, CIGAR and SEQ don't fit together."""


_MD = re.compile(r"([0-9]+)|\^([A-Za-z]*)|([A-Za-z])")
_CIGAR = re.compile(r"([0-9]+)([^0-9])")


def rebuilt_cs(cigar: str, md: str, seq: str, long_form: bool = False) -> str:
    """The cs string of an alignment. Matches and mismatches of MD are laid along the CIGAR's aligned runs."""
    runs: list[list] = []  # [op, length], aligned kinds merged, hard clips left out
    for n, op in _CIGAR.findall(cigar):
        op = "M" if op in "=X" else op
        if op == "H":
            continue
        if runs and runs[-1][0] == op:
            runs[-1][1] += int(n)
        else:
            runs.append([op, int(n)])
    out: list[str] = []
    at = place = 0  # place in runs, in seq
    left = runs[0][1] if runs else 0  # of the run at hand

    def forward() -> None:
        nonlocal at, left
        at += 1
        left = runs[at][1] if at < len(runs) else 0

    for equal, deleted, other in _MD.findall(md):
        if not equal and not other:
            out.append("-" + deleted.lower())
            forward()
            continue
        need = int(equal) if equal else 1
        while at < len(runs) and runs[at][0] != "D":
            op, length = runs[at]
            if op == "I":
                out.append("+" + seq[place : place + length].lower())
                place += length
                forward()
            elif op == "S":
                place += length
                forward()
            elif op == "N":
                out.append(f"~nn{length}nn")
                forward()
            elif op == "M":
                whole = need >= left
                used = min(need, left)
                if used:
                    if other:
                        out.append("*" + other.lower() + seq[place].lower())
                    else:
                        out.append("=" + seq[place : place + used] if long_form else f":{used}")
                need, left, place = need - used, left - used, place + used
                if not whole:
                    break
                forward()
            else:
                raise Inconsistent(f"operation {op} in a walk along MD")
        if need:
            raise Inconsistent("MD is longer than CIGAR")
    return "".join(out)


def rebuild_cs(long_form: bool = False):
    """A column function of (cigar, md, seq): struct<cs, error>. No built-in can express the walk; batches come by Arrow."""

    @F.pandas_udf("cs string, error string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for cigars, mds, seqs in batches:
            rows = []
            for cigar, md, seq in zip(cigars, mds, seqs):
                try:
                    rows.append((None, None) if cigar is None or md is None or seq is None else (rebuilt_cs(cigar, md, seq, long_form), None))
                except (ValueError, IndexError) as error:
                    rows.append((None, str(error) or type(error).__name__))
            yield pd.DataFrame(rows, columns=["cs", "error"], dtype=object)

    return run
