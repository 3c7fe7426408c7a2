"""Splice junctions of the two sides of a comparison table, by reference position and by read position.

A junction's key is (contig, start, end, intron strand). One explode of both sides feeds each table of
counts, and counting combines before the shuffle, so a junction that very many reads share is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft import schema
from weft.functions import cs as C
from weft.functions import text as X
from weft.functions.memo import remembered
from weft.operators.classify import mapped, stacked
from weft.operators.compare import set_counts
from weft.operators.features import less

c = F.col
KEY = ["target_name", "intron_start", "intron_end", "intron_strand"]


def clean_strand(text: Column) -> Column:
    first = F.left(F.coalesce(text, F.lit("")), F.lit(1))
    return F.when(first.isin("+", "-"), first).otherwise("*")


def _long(name: str) -> Column:
    return F.coalesce(c(name).try_cast("bigint"), F.lit(0).cast("bigint"))


@remembered
def genomic(side: str) -> tuple[Column, Column]:
    """(array<struct<contig, start, end, strand, motif>>, intron strand) of a side; unmapped sides have none and ``*``."""
    strand = F.when(mapped(side), clean_strand(c(f"genomic_intron_strand_{side}"))).otherwise("*")
    found = F.when(mapped(side), C.introns(F.coalesce(f"cs_{side}", F.lit("")))).otherwise(F.array().cast(C.INTRONS))
    start = _long(f"target_start_{side}")
    full = F.transform(found, lambda i: F.struct(c(f"target_name_{side}").alias("contig"), (start + i["start"]).alias("start"), (start + i["end"]).alias("end"), strand.alias("strand"), i["motif"].alias("motif")))
    return full, strand


def keys_of(junctions: Column) -> Column:
    return F.transform(junctions, lambda j: F.struct(j["contig"].alias("contig"), j["start"].alias("start"), j["end"].alias("end"), j["strand"].alias("strand")))


def motifs_of(junctions: Column) -> Column:
    return X.word_tuple(F.transform(junctions, lambda j: C.oriented_motif(j["motif"], j["strand"])))


def with_genomic(table: DataFrame) -> DataFrame:
    """GJC's input columns, with j_A and j_B (junctions), k_A and k_B (their keys) and s_A and s_B (intron strands)."""
    rows = table.select("query_name", *[f"{n}_{s}" for n in schema.GJC_SIDE for s in "AB"])
    (j_a, s_a), (j_b, s_b) = genomic("A"), genomic("B")
    rows = rows.withColumns({"j_A": j_a, "j_B": j_b, "s_A": s_a, "s_B": s_b})
    return rows.withColumns({"k_A": keys_of(c("j_A")), "k_B": keys_of(c("j_B"))})


def per_read(rows: DataFrame) -> DataFrame:
    """The 21 columns of each read with a junction on either side."""
    rows = rows.filter((F.size("j_A") > 0) | (F.size("j_B") > 0))
    shared, only_a, only_b = set_counts(c("k_A"), c("k_B"))
    text = lambda n: F.coalesce(c(n), F.lit("")).alias(n)
    size = lambda n: F.size(n).cast("bigint")
    head = [x for s in "AB" for x in (text(f"target_name_{s}"), text(f"strand_{s}"), c(f"s_{s}").alias(f"genomic_intron_strand_{s}"))]
    return rows.select(
        "query_name", *head, size("j_A").alias("n_junctions_A"), size("j_B").alias("n_junctions_B"), shared.alias("n_junctions_shared"),
        (only_a + only_b).alias("n_junctions_not_shared"), only_a.alias("n_junctions_only_A"), only_b.alias("n_junctions_only_B"),
        *[X.span_tuple(c(f"k_{s}")).alias(f"genomic_junctions_{s}") for s in "AB"], *[motifs_of(c(f"j_{s}")).alias(f"junction_motifs_{s}") for s in "AB"],
        X.span_tuple(F.array_sort(F.array_except("k_A", "k_B"))).alias("genomic_junctions_only_A"),
        X.span_tuple(F.array_sort(F.array_except("k_B", "k_A"))).alias("genomic_junctions_only_B"), text("cs_A"), text("cs_B"),
    )


def _first_motif(when: Column, place: Column | None = None) -> Column:
    """The first motif of known letters among rows where ``when``, by read name and place; unknown letters only if there is no other."""
    return F.min_by(F.when(when, c("motif")), F.when(when, F.struct(c("motif") == "nnnn", c("query_name"), c("place") if place is None else place)))


def _keyed(junction: str = "j") -> list[Column]:
    return [c(f"{junction}.contig").alias("target_name"), c(f"{junction}.start").alias("intron_start"), c(f"{junction}.end").alias("intron_end"), c(f"{junction}.strand").alias("intron_strand"), c(f"{junction}.motif").alias("motif")]


def occurrences(rows: DataFrame) -> DataFrame:
    """(query_name, side, place, key, motif, agreed): each junction of each side; agreed if the other side has its key."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), c(f"j_{s}").alias("own"), c(f"k_{o}").alias("other")) for s, o in ("AB", "BA")])
    each = rows.select("query_name", F.explode(sides).alias("x")).select("query_name", "x.side", "x.other", F.posexplode("x.own").alias("place", "j"))
    agreed = F.array_contains("other", F.struct(c("j.contig").alias("contig"), c("j.start").alias("start"), c("j.end").alias("end"), c("j.strand").alias("strand")))
    return each.select("query_name", "side", "place", *_keyed(), agreed.alias("agreed"))


def per_junction(rows: DataFrame) -> DataFrame:
    """Reads by junction: of each side, of both, of one only, and the motif that each side reports."""
    a, b = c("side") == "A", c("side") == "B"
    counted = occurrences(rows).groupBy(*KEY).agg(
        F.count_if(a).alias("n_reads_A"), F.count_if(b).alias("n_reads_B"), F.count_if(a & c("agreed")).alias("n_reads_both"),
        _first_motif(a).alias("motif_A"), _first_motif(b).alias("motif_B"),
    )
    shown = lambda m: F.coalesce(C.oriented_motif(c(m), c("intron_strand")), F.lit(".")).alias(m)
    return counted.select(
        *KEY, "n_reads_A", "n_reads_B", "n_reads_both", (c("n_reads_A") - c("n_reads_both")).alias("n_reads_only_A"),
        (c("n_reads_B") - c("n_reads_both")).alias("n_reads_only_B"), shown("motif_A"), shown("motif_B"),
    )


GJC_ROWS = [
    "reads_compared", "reads_with_junctions_both", "reads_with_junctions_only_A", "reads_with_junctions_only_B", "reads_with_junctions_neither",
    "reads_genomic_junctions_identical", "reads_genomic_junctions_differ", "reads_genomic_intron_strand_differ", "n_distinct_junctions_A", "n_distinct_junctions_B",
    "n_distinct_junctions_shared", "n_distinct_junctions_only_A", "n_distinct_junctions_only_B", "n_distinct_junctions_unknown_strand_A", "n_distinct_junctions_unknown_strand_B",
]


def gjc_summary(rows: DataFrame, junctions: DataFrame) -> DataFrame:
    n = F.count_if
    a, b = F.size("j_A") > 0, F.size("j_B") > 0
    same = (F.size(F.array_except("k_A", "k_B")) == 0) & (F.size(F.array_except("k_B", "k_A")) == 0)
    reads = rows.agg(
        F.count("*").alias(GJC_ROWS[0]), n(a & b).alias(GJC_ROWS[1]), n(a & ~b).alias(GJC_ROWS[2]), n(~a & b).alias(GJC_ROWS[3]), n(~a & ~b).alias(GJC_ROWS[4]),
        n(a & b & same).alias(GJC_ROWS[5]), n(a & b & ~same).alias(GJC_ROWS[6]), n(a & b & (c("s_A") != "*") & (c("s_B") != "*") & (c("s_A") != c("s_B"))).alias(GJC_ROWS[7]),
    )
    in_a, in_b, unknown = c("n_reads_A") > 0, c("n_reads_B") > 0, c("intron_strand") == "*"
    distinct = junctions.agg(
        n(in_a).alias(GJC_ROWS[8]), n(in_b).alias(GJC_ROWS[9]), n(in_a & in_b).alias(GJC_ROWS[10]), n(in_a & ~in_b).alias(GJC_ROWS[11]), n(~in_a & in_b).alias(GJC_ROWS[12]),
        n(in_a & unknown).alias(GJC_ROWS[13]), n(in_b & unknown).alias(GJC_ROWS[14]),
    )
    one = lambda d: d.withColumn("__one", F.lit(1))
    return stacked(one(reads).join(one(distinct), "__one"), GJC_ROWS)


# Query junctions


@remembered
def funnel() -> Column:
    """Why a read is looked at or not, by the stored counts."""
    a, b = mapped("A"), mapped("B")
    none = (_long("n_query_junctions_only_A") == 0) & (_long("n_query_junctions_only_B") == 0)
    return (
        F.when(~a & ~b, "n_neither_aligned")
        .when(a & b, F.when(none, "n_both_aligned_query_junctions_identical").otherwise("n_query_junctions_different_aligned_both"))
        .when(a, F.when(_long("n_intron_events_A") > 0, "n_query_junctions_different_aligned_only_A").otherwise("n_aligned_only_no_junctions"))
        .otherwise(F.when(_long("n_intron_events_B") > 0, "n_query_junctions_different_aligned_only_B").otherwise("n_aligned_only_no_junctions"))
    )


def differing() -> Column:
    return F.startswith(c("bucket"), F.lit("n_query_junctions_different"))


@remembered
def side_junctions(side: str) -> Column:
    """array<struct<q, at, contig, start, end, strand, motif>> of a side in order along the read."""
    strand, length = F.coalesce(f"strand_{side}", F.lit(".")), _long("query_len")
    offset = F.when(strand == "+", _long(f"query_start_{side}")).otherwise(less(length, _long(f"query_end_{side}")))
    start, intron = _long(f"target_start_{side}"), clean_strand(c(f"genomic_intron_strand_{side}"))
    found = F.when(mapped(side), C.introns(F.coalesce(f"cs_{side}", F.lit("")))).otherwise(F.array().cast(C.INTRONS))
    place = lambda i: F.when(strand == "-", length - (offset + i["q"])).otherwise(offset + i["q"])
    return F.array_sort(
        F.transform(
            found,
            lambda i, at: F.struct(
                place(i).alias("q"), at.alias("at"), c(f"target_name_{side}").alias("contig"), (start + i["start"]).alias("start"),
                (start + i["end"]).alias("end"), intron.alias("strand"), i["motif"].alias("motif"),
            ),
        )
    )


def with_query(table: DataFrame) -> DataFrame:
    """QJC's input columns, with bucket and both sides' junctions j_A and j_B."""
    rows = table.select("query_name", "query_len", "n_query_junctions_only_A", "n_query_junctions_only_B", *[f"{n}_{s}" for n in schema.QJC_SIDE for s in "AB"])
    return rows.withColumns({"bucket": funnel(), "j_A": side_junctions("A"), "j_B": side_junctions("B")})


def read_junctions(rows: DataFrame) -> DataFrame:
    """The 13 columns of each junction of each read in which the sides differ."""
    found = rows.filter(differing())
    sides = F.array(*[F.struct(F.lit(s).alias("side"), c(f"j_{s}").alias("own"), c(f"j_{o}").alias("other"), F.coalesce(f"strand_{s}", F.lit(".")).alias("strand"), mapped(o).alias("there")) for s, o in ("AB", "BA")])
    each = found.select("query_name", F.explode(sides).alias("x")).select(
        "query_name", "x.side", "x.strand", "x.there", F.transform("x.other", lambda j: j["q"]).alias("q"), keys_of(c("x.other")).alias("k"), F.posexplode("x.own").alias("place", "j")
    )
    key = F.struct(c("j.contig").alias("contig"), c("j.start").alias("start"), c("j.end").alias("end"), c("j.strand").alias("strand"))
    contig, start, end, strand, motif = _keyed()
    return each.select(
        "query_name", "side", (c("place") + 1).cast("bigint").alias("junction_index"), c("j.q").alias("query_pos"), contig, start, end, strand,
        C.oriented_motif(c("j.motif"), c("j.strand")).alias("motif"), "strand", (c("there") & F.array_contains("q", c("j.q"))).alias("matched_in_query"),
        (c("there") & F.array_contains("k", key)).alias("matched_in_genomic"), c("there").alias("other_side_aligned"), c("j.motif").alias("__raw"),
    )


QJC_READ_COLUMNS = [
    "query_name", "side", "junction_index", "query_pos", "target_name", "intron_start", "intron_end", "intron_strand", "motif", "strand",
    "matched_in_query", "matched_in_genomic", "other_side_aligned",
]


def catalogs(rows: DataFrame, one_row_a_read: bool = False) -> DataFrame:
    """Both sides' junctions with counts: reads that differ in it, all occurrences, and its motif. One explode for both counts.

    ``one_row_a_read``: no name repeats in ``rows``, so that reads are counted without a grouping by name.
    """
    sides = F.array(*[F.struct(F.lit(s).alias("side"), c(f"j_{s}").alias("own"), keys_of(c(f"j_{s}")).alias("keys"), keys_of(c(f"j_{o}")).alias("k"), (differing() & mapped(s)).alias("looked"), mapped(o).alias("there")) for s, o in ("AB", "BA")])
    each = rows.select("query_name", F.explode(sides).alias("x")).select("query_name", "x.side", "x.keys", "x.k", "x.looked", "x.there", F.posexplode("x.own").alias("place", "j"))
    key = F.struct(c("j.contig").alias("contig"), c("j.start").alias("start"), c("j.end").alias("end"), c("j.strand").alias("strand"))
    first = F.array_position("keys", key) == c("place") + 1
    each = each.select("query_name", "side", "place", c("j.at").alias("at"), *_keyed(), (c("looked") & ~(c("there") & F.array_contains("k", key))).alias("alone"), first.alias("first"))
    # a read counts once for a junction that it holds twice
    if one_row_a_read:
        counted = each.groupBy("side", *KEY).agg(
            F.count_if(c("alone") & c("first")).alias("n_reads_query_junctions_different"), F.count("*").alias("n_reads_with_junction_total"),
            _first_motif(c("alone")).alias("m_alone"), _first_motif(F.lit(True), c("at")).alias("m_any"),
        )
        return _catalog_columns(counted)
    by_read = each.groupBy("side", *KEY, "query_name").agg(
        F.count("*").alias("n"), F.max("alone").alias("alone"), _first_motif(c("alone")).alias("m_alone"), _first_motif(F.lit(True), c("at")).alias("m_any")
    )
    pick = lambda m, when: F.min_by(F.when(when, c(m)), F.when(when, F.struct(c(m) == "nnnn", c("query_name"))))
    counted = by_read.groupBy("side", *KEY).agg(
        F.count_if("alone").alias("n_reads_query_junctions_different"), F.sum("n").alias("n_reads_with_junction_total"), pick("m_alone", c("alone")).alias("m_alone"), pick("m_any", F.lit(True)).alias("m_any")
    )
    return _catalog_columns(counted)


def _catalog_columns(counted: DataFrame) -> DataFrame:
    motif = F.coalesce(C.oriented_motif(F.coalesce("m_alone", "m_any"), c("intron_strand")), F.lit("."))
    return counted.select("side", *KEY, motif.alias("motif"), "n_reads_query_junctions_different", "n_reads_with_junction_total")


def catalog(both: DataFrame, side: str, unmatched_only: bool) -> DataFrame:
    own = both.filter(c("side") == side).drop("side")
    return own.filter("n_reads_query_junctions_different > 0") if unmatched_only else own


QJC_BUCKETS = [
    "n_neither_aligned", "n_both_aligned_query_junctions_identical", "n_aligned_only_no_junctions", "n_query_junctions_different_aligned_both",
    "n_query_junctions_different_aligned_only_A", "n_query_junctions_different_aligned_only_B",
]
QJC_ROWS = [
    "n_total", *QJC_BUCKETS[:3], "n_query_junctions_different", *QJC_BUCKETS[3:], *[f"n_unique_junctions_{k}" for k in ("A", "B", "shared", "only_A", "only_B")],
    "n_unmatched_junctions_A", "n_unmatched_junctions_B",
]


def qjc_summary(rows: DataFrame, both: DataFrame) -> DataFrame:
    n = F.count_if
    reads = rows.agg(F.count("*").alias("n_total"), n(differing()).alias("n_query_junctions_different"), *[n(c("bucket") == b).alias(b) for b in QJC_BUCKETS])
    a, b = c("side") == "A", c("side") == "B"
    alone = c("n_reads_query_junctions_different") > 0
    by_key = both.groupBy(*KEY).agg(F.max(a).alias("a"), F.max(b).alias("b"), F.max(a & alone).alias("u_a"), F.max(b & alone).alias("u_b"))
    counts = by_key.agg(
        n("a").alias("n_unique_junctions_A"), n("b").alias("n_unique_junctions_B"), n(c("a") & c("b")).alias("n_unique_junctions_shared"),
        n(c("a") & ~c("b")).alias("n_unique_junctions_only_A"), n(~c("a") & c("b")).alias("n_unique_junctions_only_B"),
        n("u_a").alias("n_unmatched_junctions_A"), n("u_b").alias("n_unmatched_junctions_B"),
    )
    one = lambda d: d.withColumn("__one", F.lit(1))
    return stacked(one(reads).join(one(counts), "__one"), QJC_ROWS)
