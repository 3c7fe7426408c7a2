"""The queries over derived alignments: rows with ties and far places against their SQL, and what their plans carry."""

import random

import pytest
from pyspark.sql import functions as F

from weft.functions import cigar as G
from weft.operators import collapse
from weft.operators import junctions as J
from weft.plans import fixture, queries
from weft.plans.oracle import ORACLE
from weft.sources import paf

NARROW = ["compare_table", "classify_reads", "find_aln_diff_summary", "gjc_per_junction", "qjc_all_a", "compare_summary", "readinfo_collapse"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A lineitem of few suppliers and quantities, so that alignments of a read tie, with parts that lie behind 5,000,000."""
    folder, draw = tmp_path_factory.mktemp("tables"), random.Random(5)
    rows = [(draw.randrange(60), draw.randrange(1, 5), draw.choice([1, 2, 60_000]), draw.randrange(3), draw.choice("OF"), float(draw.randrange(1, 3))) for _ in range(600)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_linestatus string, l_quantity double").coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def by_sql(tables, name):
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as base:
        base.execute(f"create view lineitem as select * from '{tables}/lineitem.parquet/*.parquet'")
        return sorted(base.execute(ORACLE[name]).fetchall(), key=str)


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["sam_to_paf", "readinfo_collapse", "alignment_counts", "tied_top_score", "read_id_set_check", "compare_summary", "qjc_all_a", "qjc_unmatched_b", "paf_text_roundtrip", "cigar_introns"])
def test_same_as_sql(spark, tables, name):
    frame = queries.QUERIES[name](spark, tables)
    assert sorted(map(tuple, frame.collect()), key=str) == by_sql(tables, name)


@pytest.mark.parametrize("side", ["A", "B"])
def test_representatives_of_parts(spark, tables, side):
    wide = collapse.representatives(fixture.alignments(spark, tables, side))
    narrow = queries._best(spark, tables, side).select(*wide.columns)
    assert narrow.count() == wide.count() > 40
    assert narrow.exceptAll(wide).isEmpty()


@pytest.mark.parametrize("name", NARROW)
def test_narrow_exchange(spark, tables, name):
    """Rows go by read once, as parts, and none are sorted ahead of that."""
    text = plan(queries.QUERIES[name](spark, tables))
    assert "hashpartitioning(l_orderkey" in text and "hashpartitioning(query_name" not in text
    for scan in text.split("FileScan")[:-1]:
        assert "Sort [" not in scan[scan.rindex("Exchange ") :]


def test_catalogs_without_names(spark, tables):
    rows = J.with_query(queries.comparison(spark, tables))
    junction = J.catalogs(rows, True)
    assert junction.exceptAll(J.catalogs(rows)).isEmpty() and junction.count() == J.catalogs(rows).count()
    assert ", query_name#" not in plan(J.catalogs(rows, True)).split("hashpartitioning(side#")[1].split("\n")[0]


def test_read_holds_a_junction_twice(spark):
    """Reads are counted, not occurrences."""
    side = "array(named_struct('q', 5L, 'at', 0, 'contig', 'c', 'start', 1L, 'end', 9L, 'strand', '+', 'motif', 'gtag'), named_struct('q', 6L, 'at', 1, 'contig', 'c', 'start', 1L, 'end', 9L, 'strand', '+', 'motif', 'nnnn'))"
    rows = spark.sql(f"select 'r' as query_name, 'c' as target_name_A, '*' as target_name_B, 'n_query_junctions_different_aligned_only_A' as bucket, {side} as j_A, slice({side}, 1, 0) as j_B")
    for one in (False, True):
        (row,) = J.catalogs(rows, one).collect()
        assert (row.n_reads_query_junctions_different, row.n_reads_with_junction_total, row.motif) == (1, 2, "gt-ag")


def test_tags_of_paf(spark):
    """The last value that isn't empty counts, also of a tag that looks like a part of another."""
    tags = ["ms:i:1\tms:i:2", "ms:i:7\tms:i:", "xms:i:3", "", "ms:i:", "cs:Z::5\tms:i:4\tde:f:0", "ms:i:1\tms:i:\tms:i:3\tms:i:"]
    frame = spark.createDataFrame(list(enumerate(tags)), "k int, t string").select("k", paf.tag_values(F.col("t"), "ms:i"))
    assert [r[1] for r in sorted(frame.collect())] == ["2", "7", None, None, None, "4", "3"]


def test_naturals(spark):
    texts = ["12", "+3", "0" * 45 + "7", "9223372036854775807", "9223372036854775808", "1e3", " 4", "-1", "", "4294967296"]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", paf.natural(F.col("t")), paf.natural(F.col("t"), 2**32 - 1))
    got = sorted(map(tuple, frame.collect()))
    assert [r[1] for r in got] == [12, 3, 7, 2**63 - 1, None, None, None, None, None, 2**32] and [r[2] for r in got] == [12, 3, 7, *[None] * 7]


def test_lines_are_split_once(spark, tables):
    """A filter on the reason doesn't split the line again for each of its terms."""
    text = plan(queries.QUERIES["paf_text_roundtrip"](spark, tables))
    assert text.count("split(value") == 1


def test_cigar_introns_in_one_lambda(spark):
    frame = spark.createDataFrame([("5S10M2I3D20N4=1X7N2M6S",), ("3M",), (None,), ("2M5N1",)], "a string").select(G.introns(F.col("a")).alias("x"))
    assert "transform(" not in plan(frame)
    assert [r.x and [tuple(i) for i in r.x] for r in frame.collect()] == [[(13, 33), (38, 45)], [], None, [(2, 7)]]
