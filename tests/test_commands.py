"""Files in, files out: each command on small inputs, the steps against the whole, and refusals."""

import gzip
import struct

import pytest
from pyspark.sql import functions as F

from weft import cli, schema, sinks
from weft.operators import collapse, pair, regions
from weft.plans import commands
from weft.sources import bam, load, paf, sam, tables

Q = 100


def line(name, start, end, strand, target, tstart, tend, *tags, mapq=60, length=Q):
    return "\t".join(map(str, (name, length, start, end, strand, target, 5000, tstart, tend, end - start, end - start, mapq, *tags)))


CS = "cs:Z::40~gt100ag:60"
A = [
    "# comment", "", line("same", 0, 100, "+", "chr1", 100, 300, "ms:i:90", "AS:i:80", "tp:A:P", "ts:A:+", CS),
    line("same", 0, 100, "+", "chr1", 900, 1100, "ms:i:80", "AS:i:80", "tp:A:S", CS), line("motif", 0, 100, "+", "chr1", 100, 300, "ms:i:90", CS), line("turned", 0, 100, "+", "chr1", 100, 300, "ms:i:90", "ts:A:+", CS),
    line("moved", 0, 100, "+", "chr1", 100, 300, "ms:i:90", CS), line("shifted", 0, 100, "+", "chr2", 1000, 1200, "ms:i:90", CS), line("onlya", 0, 100, "-", "chr2", 1150, 1350, "ms:i:90", CS),
    line("onlyb", 0, 0, "*", "*", 0, 0), line("neither", 0, 0, "*", "*", 0, 0), line("plain", 10, 90, "-", "chr3", 5, 85, "AS:i:70", "cs:Z::80"),
]
B = [
    line("same", 0, 100, "+", "chr1", 100, 300, "ms:i:90", "AS:i:88", "tp:A:P", "ts:A:+", CS), line("motif", 0, 100, "+", "chr1", 100, 300, "ms:i:90", "cs:Z::40~nn100nn:60"),
    line("turned", 0, 100, "-", "chr1", 100, 300, "ms:i:90", "ts:A:-", "cs:Z::60~ct100ac:40"), line("moved", 0, 100, "+", "chr1", 600, 800, "ms:i:90", CS),
    line("shifted", 0, 100, "+", "chr2", 1000, 1200, "ms:i:90", "cs:Z::41~gt99ag:59"), line("onlya", 0, 0, "*", "*", 0, 0), line("onlyb", 0, 100, "+", "chr2", 1200, 1400, "ms:i:90", CS),
    line("neither", 0, 0, "*", "*", 0, 0), line("plain", 10, 90, "-", "chr3", 5, 85, "AS:i:70", "cs:Z::80"),
]


def write(path, lines):
    text = "\n".join(lines) + "\n"
    path.write_bytes(gzip.compress(text[:50].encode()) + gzip.compress(text[50:].encode())) if path.suffix == ".gz" else path.write_text(text)
    return str(path)


def read(path):
    with gzip.open(path, "rt") if str(path).endswith(".gz") else open(path) as file:
        rows = [row.rstrip("\n").split("\t") for row in file]
    return [dict(zip(rows[0], r)) for r in rows[1:]]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("compare")
    a, b = write(folder / "a.paf.gz", A), write(folder / "b.paf", B)
    result = commands.compare(spark, a, b, str(folder / "out"), "run", form="both", emit_alninfo=True, emit_readinfo=True, keep_sorted_paf=True)
    return folder, a, b, result


def test_summary(made):
    counts = dict(made[3].summary)
    assert counts == {
        "label_A": "SetA", "label_B": "SetB", "reads_compared": 9, "aligned_both": 6, "aligned_only_A": 1, "aligned_only_B": 1, "aligned_neither": 1, "query_identical": 6,
        "query_identical_same_strand": 4, "query_identical_revcomp": 1, "query_not_identical": 1, "query_junctions_identical": 5, "query_junctions_not_identical": 1,
        "ref_same_position_same_aln": 3, "ref_same_position_diff_aln": 1, "ref_diff_position_same_aln": 1, "ref_diff_position_diff_aln": 1, "present_only_in_A_by_id": 0, "present_only_in_B_by_id": 0,
    }
    assert [tuple(r.values()) for r in read(made[3].paths["summary"])] == [(k, str(v)) for k, v in made[3].summary]


def test_text_and_parquet_agree(spark, made):
    text = read(made[3].paths["tsv"])
    assert list(text[0]) == schema.names(schema.COMPARISON) and len(text) == 9
    assert [r["query_name"] for r in text] == sorted(r["query_name"] for r in text)
    rest = {r["query_name"]: r.asDict() for r in spark.read.parquet(made[3].paths["parquet"]).collect()}
    for row in text:
        own = rest[row["query_name"]]
        for name, kind in schema.COMPARISON:
            cell, value = row[name], own[name]
            if kind == "f":
                assert (cell == "NaN") == (value is None) and (value is None or float(cell) == value)
            elif kind == "b":
                assert cell == str(value).lower()
            else:
                assert cell == ("" if value is None else str(value))


def test_rest_has_nulls_where_nothing_is_defined(spark, made):
    table = spark.read.parquet(made[3].paths["parquet"])
    row = table.filter("query_name = 'onlyb'").first()
    assert row["cs_A"] is None and row["aln_identity_A"] is None and row["ms_score_ratio"] is None and row["aln_identity_diff"] is None
    assert row["target_name_A"] == "*" and row["query_junctions_A"] == "()" and row["query_aln_cov_A"] == 0.0 and row["n_match_bases_A"] == 0
    assert sinks.comparison_version(table) == schema.VERSION
    solid = ["query_name", "query_len", "label_A", "label_B", "strand_match", *[n for n, k in schema.DIFF if k in ("i", "n", "s")]]
    assert table.filter(" or ".join(f"{n} is null" for n in solid)).count() == 0


def test_differences(spark, made):
    rows = {r["query_name"]: r for r in spark.read.parquet(made[3].paths["parquet"]).collect()}
    assert rows["same"]["as_score_diff"] == 8 and rows["same"]["as_score_ratio"] == 1.1 and rows["same"]["n_alns_A"] == 2 and rows["same"]["n_alns_tied_top_score_A"] == 1
    assert (rows["shifted"]["query_junctions_only_A"], rows["shifted"]["query_junctions_only_B"], rows["shifted"]["n_query_junctions_not_shared"]) == ("(40,)", "(41,)", 2)
    assert rows["turned"]["strand_match"] is False and rows["turned"]["genomic_intron_strand_B"] == "+" and rows["neither"]["strand_match"] is True
    assert (rows["plain"]["n_softclip_bases_start_A"], rows["plain"]["n_softclip_bases_end_A"]) == (10, 10)


def test_side_tables(made):
    paths = made[3].paths
    alninfo, readinfo = read(paths["SetA.alninfo"]), read(paths["SetA.readinfo"])
    assert list(alninfo[0]) == schema.names(schema.ALNINFO) and len(alninfo) == 10
    assert list(readinfo[0]) == schema.names(schema.READINFO) and len(readinfo) == 9
    assert next(r for r in readinfo if r["query_name"] == "neither")["aln_identity"] == "NaN"
    with gzip.open(paths["SetA.sorted"], "rt") as file:
        kept = file.read().splitlines()
    assert kept == sorted(x for x in A if x and x[0] != "#")


def test_steps_give_the_same_table(spark, made, tmp_path):
    folder, a, b, whole = made
    for path, name in ((a, "a"), (b, "b")):
        commands.paf2tables(spark, path, str(tmp_path / f"{name}.alninfo.tsv"), str(tmp_path / f"{name}.readinfo.tsv.gz"))
        commands.readinfo_of_alninfo(spark, str(tmp_path / f"{name}.alninfo.tsv"), str(tmp_path / f"{name}.again.tsv.gz"))
        assert read(tmp_path / f"{name}.again.tsv.gz") == read(tmp_path / f"{name}.readinfo.tsv.gz")
    commands.compare_readinfo(spark, str(tmp_path / "a.readinfo.tsv.gz"), str(tmp_path / "b.readinfo.tsv.gz"), str(tmp_path / "table.tsv"))
    assert read(tmp_path / "table.tsv") == read(whole.paths["tsv"])
    stepwise = commands.compare_readinfo(spark, str(tmp_path / "a.readinfo.tsv.gz"), str(tmp_path / "b.readinfo.tsv.gz"), str(tmp_path / "table.parquet"))
    assert stepwise.summary == whole.summary
    for path in (whole.paths["tsv"], whole.paths["parquet"]):
        assert commands.compare_summary(spark, path, out=str(tmp_path / "summary.tsv")).summary == whole.summary


def test_names_that_repeat_pair_in_order(spark, made, tmp_path):
    lines = gzip.open(made[3].paths["SetA.readinfo"], "rt").read().splitlines()
    row = next(x for x in lines if x.startswith("same\t"))
    for name in "ab":
        write(tmp_path / f"{name}.tsv", [lines[0], "", row, row.replace("\tchr1\t", f"\tchr{name}\t")])
    commands.compare_readinfo(spark, str(tmp_path / "a.tsv"), str(tmp_path / "b.tsv"), str(tmp_path / "t.tsv"))
    assert [(r["target_name_A"], r["target_name_B"]) for r in read(tmp_path / "t.tsv")] in ([("chr1", "chr1"), ("chra", "chrb")], [("chra", "chrb"), ("chr1", "chr1")])


def test_presorted(spark, made, tmp_path):
    a, b = write(tmp_path / "a.paf", [x for x in A if x and x[0] != "#"]), write(tmp_path / "b.paf", B)
    assert commands.compare(spark, a, b, str(tmp_path / "o"), "p", presorted=True).summary == made[3].summary
    wrong = write(tmp_path / "c.paf", B[::-1])
    with pytest.raises(pair.ReadSetMismatch):
        commands.compare(spark, a, wrong, str(tmp_path / "o2"), "p", presorted=True)
    with pytest.raises(ValueError, match="greater name"):
        commands.paf2tables(spark, b, readinfo=str(tmp_path / "r.tsv"), presorted=True)
    assert not (tmp_path / "r.tsv").exists()


def test_other_reads_are_refused_or_counted(spark, made, tmp_path):
    a, b = write(tmp_path / "a.paf", [*A, line("more", 0, 10, "+", "chr1", 0, 10)]), write(tmp_path / "b.paf", B[1:])
    with pytest.raises(pair.ReadSetMismatch, match="8 shared, 2 only in SetA .* 0 only in SetB"):
        commands.compare(spark, a, b, str(tmp_path / "o"), "p")
    assert not list((tmp_path / "o").iterdir())
    counts = dict(commands.compare(spark, a, b, str(tmp_path / "o"), "p", allow_id_mismatch=True).summary)
    assert (counts["reads_compared"], counts["present_only_in_A_by_id"], counts["present_only_in_B_by_id"]) == (8, 2, 0)


def test_find_aln_diff(spark, made, tmp_path):
    out = commands.find_aln_diff(spark, made[3].paths["parquet"], str(tmp_path), "p", emit_identical=True)
    assert {r["query_name"]: r["outcome"] for r in read(out.paths["reads"])} == {"shifted": "diff_aln_both", "onlya": "diff_aln_only_A", "onlyb": "diff_aln_only_B"}
    assert {r["query_name"]: r["outcome"] for r in read(out.paths["identical"])} == {"same": "identical_same_strand", "motif": "identical_same_strand", "moved": "identical_same_strand", "plain": "identical_same_strand", "turned": "identical_revcomp", "neither": "neither_mapped"}
    assert [list(r.values()) for r in read(out.paths["regions_A"])] == [["chr2", "1000", "1350", "2", "1", "1", "1", "1"]]
    assert [list(r.values()) for r in read(out.paths["regions_B"])] == [["chr2", "1000", "1400", "2", "1", "1", "2", "0"]]
    counts = dict(out.summary)
    assert counts["reads_differ"] == "3" and counts["n_regions_A"] == "1" and counts["aligned_both_only"] == "false"
    strict = dict(commands.find_aln_diff(spark, made[3].paths["parquet"], str(tmp_path), "p", "any-diff-reference", both_only=True, gzip=False).summary)
    assert (strict["reads_differ"], strict["reads_not_aligned_both_excluded"], strict["reads_identical"], strict["aligned_both_only"]) == ("3", "3", "3", "true")
    assert (tmp_path / "p.reference_aln_diff_reads.tsv").exists()
    with pytest.raises(tables.NotATable):
        commands.find_aln_diff(spark, made[3].paths["tsv"], str(tmp_path), "p")


def test_islands(spark):
    rows = [("chr1", 10, 20), ("chr1", 20, 30), ("chr2", 10, 20), ("chr2", 21, 30), ("chr3", 0, 5_000_000), ("chr3", 10, 20), ("chr3", 2_000_000, 6_000_000), ("chr3", 6_000_001, 6_000_002), ("chr4", 1_048_570, 1_048_576), ("chr4", 1_048_576, 1_048_580)]
    found = regions.merged(spark.createDataFrame(rows, "chrom string, start bigint, end bigint").withColumn("n", F.lit(1).cast("bigint")), ["n"])
    assert sorted(map(tuple, found.select("chrom", "start", "end", "n").collect())) == [("chr1", 10, 30, 2), ("chr2", 10, 20, 1), ("chr2", 21, 30, 1), ("chr3", 0, 6_000_000, 3), ("chr3", 6_000_001, 6_000_002, 1), ("chr4", 1_048_570, 1_048_580, 2)]


def test_junction_commands(spark, made, tmp_path):
    out = commands.genomic_junction_compare(spark, made[3].paths["tsv"], str(tmp_path), "p")
    reads = {r["query_name"]: r for r in read(out.paths["per_read"])}
    assert set(reads) == {"same", "motif", "turned", "moved", "shifted", "onlya", "onlyb"}
    assert reads["motif"]["junction_motifs_B"] == "('nn-nn',)" and reads["shifted"]["genomic_junctions_only_B"] == "((1041, 1140),)"
    junctions = {(r["target_name"], r["intron_start"], r["intron_strand"]): r for r in read(out.paths["per_junction"])}
    plus, unknown = junctions["chr1", "140", "+"], junctions["chr1", "140", "*"]
    assert [plus[k] for k in ("n_reads_A", "n_reads_B", "n_reads_both")] == ["2", "1", "1"] and (unknown["motif_A"], unknown["motif_B"]) == ("gt-ag", "nn-nn")
    counts = dict(out.summary)
    assert counts["reads_compared"] == 9 and counts["n_distinct_junctions_A"] == len([r for r in junctions.values() if r["n_reads_A"] != "0"])
    query = commands.query_junction_compare(spark, made[3].paths["parquet"], str(tmp_path), "p", emit_all=True)
    each = read(query.paths["per_read"])
    assert [(r["query_name"], r["side"], r["query_pos"], r["matched_in_query"], r["other_side_aligned"]) for r in each] == [("onlya", "A", "60", "0", "0"), ("onlyb", "B", "40", "0", "0"), ("shifted", "A", "40", "0", "1"), ("shifted", "B", "41", "0", "1")]
    every = read(query.paths["all_A"])
    assert [r for r in every if r["n_reads_query_junctions_different"] != "0"] == read(query.paths["unmatched_A"])
    assert dict(query.summary)["n_query_junctions_different"] == 3
    with pytest.raises(tables.NotATable):
        commands.query_junction_compare(spark, made[3].paths["tsv"], str(tmp_path), "p")


def test_paf_lines(spark):
    good = line("r", 0, 10, "+", "chr1", 0, 10, "ms:i:1", "ms:i:x", "AS:i:-5", "tp:A:S", "cs:Z:", "cs:Z::10", "zz:i:1")
    bad = ["r\t1", line("r", 0, 10, "?", "chr1", 0, 10), good.replace("\t100\t", "\t-1\t", 1), good.replace("\t60\t", "\t5000000000\t", 1)]
    star = line("u", 0, 10, "*", "chr1", 0, 10, "ms:i:9", "cs:Z::10", "tp:A:P")
    rows, away = paf.parse(spark.createDataFrame([(x,) for x in [good, star, *bad, "#x", " "]], "value string"))
    first, second = rows.orderBy("query_name").collect()
    assert (first["ms_score"], first["as_score"], first["tp_tag"], first["cs"]) == (0, -5, "S", ":10")
    assert (second["ms_score"], second["cs"], second["tp_tag"]) == (0, "", "*")
    assert away.count() == 4


def test_unmapped_can_win(spark):
    rows, _ = paf.parse(spark.createDataFrame([(line("r", 0, 10, "+", "chr1", 0, 10, "AS:i:-1", "cs:Z::10"),), (line("r", 0, 0, "*", "*", 0, 0),)], "value string"))
    best = collapse.readinfo(rows).first()
    assert best["target_name"] == "*" and best["n_alns"] == 1


@pytest.mark.parametrize(
    ("kinds", "counts"), [(["P", "S", "S"], (3, 1, 2)), (["P", "I", "i"], (3, 2, 1)), (["?", "?"], (2, 0, 0))]
)
def test_alignment_counts(spark, kinds, counts):
    rows, _ = paf.parse(spark.createDataFrame([(line("r", 0, 10 + i, "+", "chr1", 0, 10, f"tp:A:{k}"),) for i, k in enumerate(kinds)], "value string"))
    best = collapse.readinfo(rows).first()
    assert (best["n_alns"], best["n_alns_primsupp"], best["n_alns_secondary"]) == counts and best["n_alns_tied_top_score"] == len(kinds)


SAM = [
    "@HD\tVN:1.6\tSO:unsorted", "@SQ\tSN:chr1\tLN:1000", "@SQ\tLN:500\tSN:chr2", "@SQ\tSN:bad\tLN:x",
    "m\t0\tchr1\t11\t60\t3M50N3M\t*\t0\t0\tAAACGG\t*\tNM:i:1\tMD:Z:4A1\tAS:i:5\tXS:A:+",
    "r\t16\tchr2\t1\t9\t2S4M1I3M\t*\t0\t0\tACGTACGTAC\tIIIIIIIIII\tcs:Z::4+c:3\tms:i:7\tts:A:-", "u\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\t*",
    "p\t77\t*\t0\t0\t*\t*\t0\t0\t*\t*", "s\t256\tchr1\t1\t0\t4M\t*\t0\t0\t*\t*\tcs:Z::4", "x\t2048\tchr1\t1\t0\t2H4=\t*\t0\t0\tACGT\t*\tcs:Z::4",
]
REJECTED = ["q\t0\tchr9\t1\t0\t4M\t*\t0\t0\tACGT\t*\tcs:Z::4", "q\t0\tchr2\t499\t0\t4M\t*\t0\t0\tACGT\t*\tcs:Z::4", "q\t0\tchr1\t1\t0\t4M\t*\t0\t0\tACG\t*\tcs:Z::4", "q\t0\tchr1\t1\t0\t4M\t*\t0\t0\tACGT\tII\tcs:Z::4", "q\t0\tchr1\t0\t0\t4M\t*\t0\t0\tACGT\t*\tcs:Z::4"]


def converted(spark, lines, **more):
    return sam.convert(spark.createDataFrame([(x,) for x in lines], "value string"), **more)


def test_sam_to_paf(spark):
    rows, away = converted(spark, [*SAM, *REJECTED], which="all")
    lines = {r["line"] for r in rows.collect()}
    assert lines == {
        "m\t6\t0\t6\t+\tchr1\t1000\t10\t66\t5\t6\t60\ttp:A:P\tNM:i:1\tmm:i:1\tAS:i:5\tXS:A:+\tgn:i:0\tgo:i:0\tcg:Z:3M50N3M\tcs:Z::3~nn50nn:1*ag:1",
        "r\t10\t0\t8\t-\tchr2\t500\t0\t7\t7\t8\t9\ttp:A:P\tms:i:7\tts:A:-\tgn:i:1\tgo:i:1\tcg:Z:4M1I3M\tcs:Z::4+c:3", "u\t4\t0\t0\t*\t*\t0\t0\t0\t0\t0\t0", "p/1\t1\t0\t0\t*\t*\t0\t0\t0\t0\t0\t0",
        "s\t4\t0\t4\t+\tchr1\t1000\t0\t4\t4\t4\t0\ttp:A:S\tgn:i:0\tgo:i:0\tcg:Z:4M\tcs:Z::4", "x\t6\t2\t6\t+\tchr1\t1000\t0\t4\t4\t4\t0\ttp:A:P\tNM:i:0\tmm:i:0\tgn:i:0\tgo:i:0\tcg:Z:4=\tcs:Z::4",
    }
    assert away.count() == len(REJECTED)
    assert {r["query_name"] for r in converted(spark, SAM)[0].collect()} == {"m", "r", "u", "p/1", "x"}
    assert {r["query_name"] for r in converted(spark, SAM, which="primary", keep_unmapped=False)[0].collect()} == {"m", "r"}


@pytest.mark.parametrize("record", ["f\t0\tchr1\t1\t0\t4M\t*\t0\t0\tACGT\t*", "f\t0\tchr1\t1\t0\t4M\t*\t0\t0\t*\t*\tMD:Z:4", "f\t0\tchr1\t1\t0\t4M\t*\t0\t0\tACGT\t*\tMD:Z:9"])
def test_no_cs_is_fatal(spark, record):
    with pytest.raises(sam.NoDifferenceString, match="f"):
        sam.stop_if_fatal(converted(spark, [*SAM, record])[1])
    sam.stop_if_fatal(converted(spark, [*SAM, record.replace("\t0\tchr1", "\t256\tchr1")])[1])


def bam_bytes(lines):
    """A BAM stream of SAM lines, with the tags that they use."""
    head = "".join(x + "\n" for x in lines if x[0] == "@").encode()
    contigs = [("chr1", 1000), ("chr2", 500)]
    out = b"BAM\1" + struct.pack("<i", len(head)) + head + struct.pack("<i", len(contigs))
    for name, length in contigs:
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    index = {"*": -1, "chr1": 0, "chr2": 1}
    import re

    for x in lines:
        if x[0] == "@":
            continue
        name, flag, ref, pos, mapq, cigar, mate, mpos, tlen, seq, qual, *tags = x.split("\t")
        ops = [int(n) << 4 | bam.OPS.index(o) for n, o in re.findall(r"(\d+)(\D)", cigar)] if cigar != "*" else []
        bases = "" if seq == "*" else seq
        codes = [bam.SEQ.index(s) for s in bases] + [0] * (len(bases) % 2)
        data = struct.pack("<iiBBHHHiiii", index[ref], int(pos) - 1, len(name) + 1, int(mapq), 0, len(ops), int(flag), len(bases), index.get(mate, -1), int(mpos) - 1, int(tlen))
        data += name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
        data += bytes(ord(q) - 33 for q in qual) if qual != "*" else b"\xff" * len(bases)
        for tag in tags:
            key, kind, value = tag.split(":", 2)
            data += key.encode() + {"i": lambda v: b"c" + struct.pack("<b", int(v)), "A": lambda v: b"A" + v.encode(), "Z": lambda v: b"Z" + v.encode() + b"\0"}[kind](value)
        out += struct.pack("<i", len(data)) + data
    return out


def test_bam_is_sam(spark, tmp_path):
    whole = bam_bytes(SAM[:3] + SAM[4:])
    path = tmp_path / "x.bam"
    path.write_bytes(b"".join(gzip.compress(whole[i : i + 100]) for i in range(0, len(whole), 100)))
    assert load.detect(str(path)) == "bam" and load.sort_order(str(path)) == "unsorted"
    lines = [r["value"] for r in bam.read_bam_lines(spark, str(path)).orderBy("place").collect()]
    assert lines == SAM[:3] + SAM[4:]
    text = write(tmp_path / "x.sam", SAM)
    same = [sorted(r["line"] for r in load.load_alignments(spark, p, "all").collect()) for p in (str(path), text)]
    assert same[0] == same[1] and len(same[0]) == 6
    commands.sam2paf(spark, str(path), str(tmp_path / "x.paf"), "all", keep_unmapped=True)
    assert sorted((tmp_path / "x.paf").read_text().splitlines()) == same[0]
    assert (tmp_path / "x.paf").read_text().splitlines()[0].startswith("m\t")


def test_numbers_and_arrays_in_tags():
    data = b"XBBS" + struct.pack("<i2H", 2, 1, 500) + b"XFf" + struct.pack("<f", 0.5) + b"XIi" + struct.pack("<i", -7)
    assert list(bam.tag_text(data)) == ["XB:B:S,1,500", "XF:f:0.5", "XI:i:-7"]


def test_detection(tmp_path):
    assert load.detect(write(tmp_path / "a", A[2:])) == "paf"
    assert load.detect(write(tmp_path / "b.gz", SAM)) == "sam"
    assert load.detect(write(tmp_path / "c", SAM[4:])) == "sam"
    (tmp_path / "d").write_bytes(b"CRAM....")
    with pytest.raises(ValueError, match="CRAM"):
        load.detect(str(tmp_path / "d"))


def test_mixed_formats(spark, tmp_path):
    a = write(tmp_path / "a.sam", SAM)
    rows = [r["line"] for r in load.load_alignments(spark, a).collect()]
    b = write(tmp_path / "b.paf", rows)
    counts = dict(commands.compare(spark, a, b, str(tmp_path / "o"), "p", form="tsv").summary)
    assert counts["reads_compared"] == counts["query_identical"] == 5


def test_refusals(spark, tmp_path, made):
    for label in ("", "a/b", "a\tb", "a\\b"):
        with pytest.raises(ValueError):
            commands.check_label(label)
    with pytest.raises(ValueError, match="differ"):
        commands.compare(spark, made[1], made[2], str(tmp_path), "p", "x", "x")
    with pytest.raises(ValueError, match="standard input"):
        commands.compare(spark, "-", made[2], str(tmp_path), "p")
    (tmp_path / "empty.tsv").write_text("")
    with pytest.raises(tables.NotATable):
        commands.compare_summary(spark, str(tmp_path / "empty.tsv"))
    (tmp_path / "other.tsv").write_text("a\tb\n1\t2\n")
    with pytest.raises(tables.NotATable, match="no comparison table"):
        commands.compare_summary(spark, str(tmp_path / "other.tsv"))
    with pytest.raises(tables.NotATable, match="side A .*query_len"):
        tables.read_readinfo(spark, str(tmp_path / "other.tsv"), "A")
    assert commands.parse_memory("2g") == 2 << 30 and commands.parse_memory("64K") == 65536
    with pytest.raises(ValueError):
        commands.parse_memory("much")


def test_nothing_half_written_stays(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commands.K, "summary", lambda *a: 1 / 0)
    a, b = write(tmp_path / "a.paf", A), write(tmp_path / "b.paf", B)
    with pytest.raises(ZeroDivisionError):
        commands.compare(spark, a, b, str(tmp_path / "o"), "p", form="both")
    assert not list((tmp_path / "o").iterdir())


def test_command_line(spark, made, tmp_path):
    args = cli.parser().parse_args(["toolkit", "find-aln-diff", "-i", made[3].paths["parquet"], "-o", str(tmp_path), "-p", "z", "--no-gzip"])
    assert cli.run(spark, args).paths["reads"].endswith("z.query_aln_diff_reads.tsv")
    args = cli.parser().parse_args(["compare", "-a", made[1], "-b", made[2], "-o", str(tmp_path), "-p", "y", "--label-a", "one", "--label-b", "two", "--format", "tsv"])
    assert dict(cli.run(spark, args).summary)["label_B"] == "two"
    args = cli.parser().parse_args(["toolkit", "read-overlap", "-a", made[1], "-b", made[2]])
    assert dict(cli.run(spark, args).summary) == {"n_a": 9, "n_b": 9, "n_shared": 9}


def test_stream(spark, tmp_path):
    from weft.streaming import stream_alninfo

    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a.paf", A)
    run = stream_alninfo(spark, str(folder)).writeStream.format("memory").queryName("streamed").outputMode("append").start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    assert spark.table("streamed").count() == 10 and spark.table("streamed").columns == schema.names(schema.ALNINFO)


def test_large_table_stays_columnar(made, spark):
    """Follow-ups read only the columns that they need."""
    path = made[3].paths["parquet"]
    wanted = ["query_name", *schema.sided(schema.GJC_SIDE, "A"), *schema.sided(schema.GJC_SIDE, "B")]
    plan = tables.read_comparison(spark, path, columns=wanted)._jdf.queryExecution().executedPlan().toString()
    assert "n_alns_A" not in plan and "cs_A" in plan


def test_other_file_systems(spark, made, tmp_path):
    """Sinks and sources go through Hadoop's paths: here a file system that mounts a local folder."""
    from weft import sinks
    from weft.sources import files, load, tables

    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.test.link./data", f"file://{tmp_path}")
    root = files.make_folder("viewfs://test/data/deep/er")
    rows = spark.createDataFrame([("b", 2), ("a", 1)], "query_name string, n int")
    for name in ("x.tsv", "x.tsv.gz"):
        for _ in range(2):  # a second run replaces the first
            sinks.write_text(rows, f"{root}/{name}", ["query_name"])
        assert [r.asDict() for r in tables.read_tsv(spark, f"{root}/{name}").collect()] == [{"query_name": "a", "n": "1"}, {"query_name": "b", "n": "2"}]
    sinks.write_comparison_parquet(rows, f"{root}/x.parquet")
    assert spark.read.parquet(f"{root}/x.parquet").count() == 2
    sinks.write_summary([("a", 1)], f"{root}/s.tsv")
    assert (tmp_path / "deep/er/s.tsv").read_text() == "category\tcount\na\t1\n"
    assert sorted(p.name for p in (tmp_path / "deep/er").iterdir() if not p.name.startswith(".")) == ["s.tsv", "x.parquet", "x.tsv", "x.tsv.gz"]
    assert not list((tmp_path / "deep/er").glob(".weft-*"))
    (tmp_path / "y.sam").write_text("@HD\tVN:1.6\tSO:queryname\n@SQ\tSN:c\tLN:9\n")
    assert load.detect("viewfs://test/data/y.sam") == "sam" and load.sort_order("viewfs://test/data/y.sam") == "queryname"
    sinks.remove(f"{root}/x.parquet")
    assert not (tmp_path / "deep/er/x.parquet").exists()


def test_row_groups_are_bounded(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    from weft import sinks

    monkeypatch.setattr(sinks, "ROW_GROUP", 1000)
    sinks.write_comparison_parquet(spark.range(2500).selectExpr("cast(id as string) as query_name").coalesce(1), str(tmp_path / "t.parquet"))
    (part,) = (tmp_path / "t.parquet").glob("part-*")
    assert [pq.ParquetFile(part).metadata.row_group(i).num_rows for i in range(3)] == [1000, 1000, 500]


def test_rejected_records_are_counted_and_warned_of(spark, tmp_path, caplog):
    from weft.sources import load

    good = "r1\t0\tc\t1\t60\t4M\t*\t0\t0\tACGT\t*\tcs:Z::4"
    write(tmp_path / "x.sam", ["@SQ\tSN:c\tLN:900", "@SQ\tLN:100\tSN:c", good, good.replace("r1\t0", "r2\tx"), good.replace("\tc\t1", "\td\t1"), good.replace("\t1\t60", "\t99\t60")])
    with caplog.at_level("WARNING", logger="weft"):
        assert load.n_rejected(spark, str(tmp_path / "x.sam")) == 3
    assert "3 records are left out" in caplog.text and "ends behind its contig" in caplog.text
    with load.staged(spark, str(tmp_path / "x.sam"), "primary", str(tmp_path)) as (rows, names):
        assert [r["target_len"] for r in rows.collect()] == [100] and names.count() == 1
    assert not list(tmp_path.glob(".weft-*"))
    write(tmp_path / "x.paf", ["bad line", "# comment"])
    caplog.clear()
    with caplog.at_level("WARNING", logger="weft"):
        assert load.n_rejected(spark, str(tmp_path / "x.paf")) == 1
    assert "malformed" in caplog.text
