"""Column names and types of all tables, in output order."""

from __future__ import annotations

#: kinds: s string, n non-negative long, i long, f double, b boolean
EVENT_COLUMNS = [
    *[(f"n_{event}_{what}", "n") for event in ("match", "substitution", "insertion", "deletion") for what in ("events", "bases")],
    ("n_softclip_events", "n"), ("n_softclip_bases_start", "n"), ("n_softclip_bases_end", "n"),
    ("n_intron_events", "n"), ("n_intron_bases", "n"), ("query_junctions", "s"), ("genomic_junctions", "s"),
]
DERIVED_COLUMNS = [("aln_identity", "f"), ("query_aln_cov", "f"), ("query_aln_len", "n"), ("cs", "s"), ("query_transcript_strand", "s"), ("genomic_intron_strand", "s"), *EVENT_COLUMNS]
PAF_COLUMNS = [
    ("query_name", "s"), ("query_len", "n"), ("query_start", "n"), ("query_end", "n"), ("strand", "s"), ("target_name", "s"),
    ("target_len", "n"), ("target_start", "n"), ("target_end", "n"), ("n_residue_matches", "n"), ("aln_block_len", "n"), ("mapq", "n"),
]
TAG_COLUMNS = [("tp_tag", "s"), ("as_score", "i"), ("ms_score", "i")]
ALNINFO = [*PAF_COLUMNS, *TAG_COLUMNS, *DERIVED_COLUMNS]
SIDE = [
    ("target_name", "s"), ("strand", "s"), ("target_start", "n"), ("target_end", "n"), ("query_start", "n"), ("query_end", "n"), ("mapq", "n"), ("tp_tag", "s"),
    ("n_alns", "n"), ("n_alns_primsupp", "n"), ("n_alns_secondary", "n"), ("n_alns_tied_top_score", "n"), ("as_score", "i"), ("ms_score", "i"),
    *DERIVED_COLUMNS,
]
READINFO = [("query_name", "s"), ("query_len", "n"), *SIDE]
DIFF = [
    ("strand_match", "b"), ("aln_identity_diff", "f"), ("query_aln_cov_diff", "f"), ("query_aln_len_diff", "i"), ("as_score_diff", "i"), ("ms_score_diff", "i"),
    ("as_score_ratio", "f"), ("ms_score_ratio", "f"), ("n_substitution_bases_diff", "i"), ("n_insertion_bases_diff", "i"), ("n_deletion_bases_diff", "i"),
    ("n_softclip_bases_start_diff", "i"), ("n_softclip_bases_end_diff", "i"), ("n_query_junctions_shared", "n"), ("n_query_junctions_not_shared", "n"),
    ("n_query_junctions_only_A", "n"), ("n_query_junctions_only_B", "n"), ("query_junctions_only_A", "s"), ("query_junctions_only_B", "s"),
]
KEYS = [("query_name", "s"), ("query_len", "n"), ("label_A", "s"), ("label_B", "s")]
COMPARISON = [*KEYS, *[(f"{c}_A", k) for c, k in SIDE], *[(f"{c}_B", k) for c, k in SIDE], *DIFF]
CLASSES = [
    "query_identical_same_strand", "query_identical_revcomp", "query_junctions_identical", "ref_same_position_same_aln",
    "ref_same_position_diff_aln", "ref_diff_position_same_aln", "ref_diff_position_diff_aln",
]
CLASSIFY_SIDE = ["target_name", "strand", "cs", "query_start", "query_end", "target_start", "target_end", "query_junctions"]
GJC_SIDE = ["target_name", "target_start", "strand", "genomic_intron_strand", "cs"]
QJC_SIDE = ["target_name", "strand", "cs", "query_start", "query_end", "target_start", "genomic_intron_strand", "n_intron_events"]

SQL_TYPES = {"s": "string", "n": "bigint", "i": "bigint", "f": "double", "b": "boolean"}
#: in the footer of comparison tables
VERSION_KEY, VERSION = "weft_comparison_version", "7"


def names(columns) -> list[str]:
    return [c for c, _ in columns]


def sided(columns, side: str) -> list[str]:
    return [f"{c}_{side}" for c in columns]
