"""Scalar functions on small values."""

import pytest
from pyspark.sql import functions as F

from weft.functions import cigar as G
from weft.functions import cs as C
from weft.functions import text as X
from weft.operators import features
from weft.operators.junctions import clean_strand


def one(spark, make, *values):
    """``make`` of columns a, b, … with these values."""
    names = "abcdefgh"[: len(values)]
    row = spark.createDataFrame([values], ", ".join(f"{n} {'bigint' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for n, v in zip(names, values)))
    return row.select(make(*[F.col(n) for n in names]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("cs", "found"),
    [
        (":100~ct50ag:30", [(100, 100, 150, "ctag")]), (":50-acg~ct100ag:20", [(50, 53, 153, "ctag")]), (":50+ac~ct100ag:20", [(52, 50, 150, "ctag")]),
        (":50*ag~ct100ag:20", [(51, 51, 151, "ctag")]), (":50~ct100ag:30~gt75ac:20", [(50, 50, 150, "ctag"), (80, 180, 255, "gtac")]), ("=ACGT~ct50ag:20", [(4, 4, 54, "ctag")]),
        (":50+aaaaa~ct100ag:20", [(55, 50, 150, "ctag")]), ("", []), (":10", []), (":5~gt50a", [(5, 5, 55, "gtan")]), ("~gt", [(0, 0, 0, "gtnn")]), (":10~GT100AG:5", [(10, 10, 110, "gtag")]),
        ("::3~ct9ag??:2", [(3, 3, 12, "ctag")]),
    ],
)
def test_introns(spark, cs, found):
    assert [tuple(r) for r in one(spark, C.introns, cs)] == found


def test_event_counts(spark):
    counts = one(spark, C.event_counts, ":10*ag:5+acg-tt=ACG~gt100ag:2:")
    assert tuple(counts) == (5, 20, 1, 1, 1, 3, 1, 2, 1, 100)
    assert tuple(one(spark, C.event_counts, "+*a")) == (0, 0, 1, 1, 1, 0, 0, 0, 0, 0)
    assert sum(tuple(one(spark, C.event_counts, ""))) == 0


@pytest.mark.parametrize(("cs", "turned"), [(":277~gt421ag:114", ":114~ct421ac:277"), (":10*cg:20", ":20*gc:10"), (":5-ccc:7", ":7-ggg:5"), (":5+at:7", ":7+at:5"), ("=AACC", "=GGTT"), ("*a", "*tn"), ("", "")])
def test_revcomp(spark, cs, turned):
    assert one(spark, C.revcomp, cs) == turned
    if cs != "*a":
        assert one(spark, lambda x: C.revcomp(C.revcomp(x)), cs) == cs


@pytest.mark.parametrize(("cs", "blank"), [(":28~ct792ac:122", ":28~nn792nn:122"), (":5*ag+c-t=AC", ":5*ag+c-t=AC"), ("?:3", ":3"), ("~g", "~nnnn")])
def test_strip(spark, cs, blank):
    assert one(spark, C.strip_motifs, cs) == blank
    assert one(spark, lambda x: C.strip_motifs(C.strip_motifs(x)), cs) == blank


@pytest.mark.parametrize(("motif", "strand", "shown"), [("gtag", "+", "gt-ag"), ("ctac", "-", "gt-ag"), ("ctgc", "-", "gc-ag"), ("ctac", "*", "ct-ac"), ("nnnn", "-", "nn-nn")])
def test_oriented_motif(spark, motif, strand, shown):
    assert one(spark, C.oriented_motif, motif, strand) == shown


@pytest.mark.parametrize(
    ("strand", "ts", "xs", "found"),
    [("+", "+", "*", "+"), ("-", "-", "*", "-"), ("+", "*", "+", "+"), ("-", "*", "-", "+"), ("+", "*", "-", "-"), ("-", "*", "+", "-"), ("+", "-", "+", "-"), ("+", "?", "-", "-"), ("*", "*", "+", "*"), ("+", "*", "*", "*")],
)
def test_transcript_strand(spark, strand, ts, xs, found):
    assert one(spark, features.transcript_strand, strand, ts, xs) == found


@pytest.mark.parametrize(("strand", "transcript", "found"), [("+", "+", "+"), ("-", "+", "-"), ("+", "-", "-"), ("-", "-", "+"), ("*", "+", "*"), ("-", "*", "*")])
def test_intron_strand(spark, strand, transcript, found):
    assert one(spark, features.intron_strand, strand, transcript) == found


def test_clean_strand(spark):
    assert [one(spark, clean_strand, s) for s in ("+", "-x", "", "?")] == ["+", "-", "*", "*"]


@pytest.mark.parametrize(
    ("number", "shown"),
    [(1.0, "1.0"), (0.00001, "0.00001"), (1e22, "10000000000000000000000.0"), (1e-7, "0.0000001"), (0.1, "0.1"), (2 / 3, "0.6666666666666666"), (float("nan"), "NaN"), (float("inf"), "inf"), (-0.5, "-0.5"), (0.0, "0.0")],
)
def test_plain_number(spark, number, shown):
    assert one(spark, X.plain_number, number) == shown


def test_tuples(spark):
    show = lambda values: spark.sql("select 1").select(X.int_tuple(F.array(*map(F.lit, values)) if values else F.array().cast("array<int>")).alias("x")).first()["x"]
    assert [show([]), show([7]), show([108, 359])] == ["()", "(7,)", "(108, 359)"]
    spans = F.array(F.struct(F.lit(100).alias("start"), F.lit(250).alias("end")))
    assert spark.sql("select 1").select(X.span_tuple(spans).alias("x")).first()["x"] == "((100, 250),)"
    full = F.array(F.struct(F.lit("c'1").alias("contig"), F.lit(1).alias("start"), F.lit(2).alias("end"), F.lit("+").alias("strand")))
    assert spark.sql("select 1").select(X.full_tuple(full).alias("x")).first()["x"] == "(('c\\'1', 1, 2, '+'),)"
    assert one(spark, X.parse_int_tuple, "(10, 20, x, )") == [10, 20]
    assert one(spark, X.parse_int_tuple, "()") == []


def test_escape(spark):
    assert one(spark, X.escape, "a\tb\\n\nc\r") == "a\\tb\\\\n\\nc\\r"
    assert one(spark, X.escape, "plain") == "plain"


@pytest.mark.parametrize(("cigar", "found"), [("100M50N100M200N50M", [(100, 150), (250, 450)]), ("100M5D45N50M", [(105, 150)]), ("50M10I50N50M", [(50, 100)]), ("10M5", []), ("*", []), ("5M10N5", [(5, 15)]), ("xx5M10N", [])])
def test_cigar_introns(spark, cigar, found):
    assert [tuple(r) for r in one(spark, G.introns, cigar)] == found


def test_cigar_stats(spark):
    s = one(spark, G.stats, "5S10M2I3D20N4=1X6S")
    assert (s.m, s.i_bases, s.d_bases, s.n_bases, s.i_count, s.d_count, s.soft, s.lead, s.trail, s.mismatches) == (15, 2, 3, 20, 1, 1, 11, 5, 6, 1)
    assert (s.ref_len, s.query_consumed, s.query_len, s.block_len) == (38, 28, 28, 20)
    hard = one(spark, G.stats, "5H10S20M")
    assert (hard.lead, hard.trail, hard.query_len, hard.query_consumed) == (5, 10, 35, 30)


@pytest.mark.parametrize(("cigar", "nm", "found"), [("10M", 2, (2, 2)), ("8=2X", 5, (2, 2)), ("8=2X1I", None, (3, 2)), ("5M2I5M", 1, (2, 0)), ("10M", None, (None, 0))])
def test_calibrated(spark, cigar, nm, found):
    row = spark.createDataFrame([(cigar, nm)], "a string, b bigint").withColumn("s", G.stats(F.col("a")))
    assert tuple(row.select(*G.calibrated(F.col("s"), F.col("b"))).first()) == found


@pytest.mark.parametrize(
    ("cigar", "md", "seq", "long_form", "cs"),
    [
        ("5M3N5M", "10", "AAAAAGGGGG", False, ":5~nn3nn:5"), ("5M3N5M", "10", "AAAAAGGGGG", True, "=AAAAA~nn3nn=GGGGG"), ("3M50N3M", "4A1", "AAACGG", False, ":3~nn50nn:1*ag:1"),
        ("1M2I1M", "2", "AGGC", False, ":1+gg:1"), ("1M2D1M", "1^AG1", "AC", False, ":1-ag:1"), ("2S3M2H", "1T1", "GGACC", False, ":1*tc:1"), ("2=1X", "2G0", "ACT", False, ":2*gt"),
    ],
)
def test_rebuilt_cs(cigar, md, seq, long_form, cs):
    assert G.rebuilt_cs(cigar, md, seq, long_form) == cs


@pytest.mark.parametrize(("cigar", "md", "seq"), [("5M", "9", "AAAAA"), ("5M2P5M", "10", "A" * 10), ("3D5M", "5", "AAAAA")])
def test_inconsistent_md(cigar, md, seq):
    with pytest.raises(ValueError):
        G.rebuilt_cs(cigar, md, seq)
