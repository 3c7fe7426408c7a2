"""The same queries as SQL for DuckDB, written from the tables' definitions and not from the operators."""

from __future__ import annotations

from weft import schema
from weft.plans.fixture import LINE, LINE_SQL, alignments_sql, md_sql, reads_sql

OP = r"(?s):[0-9]*|[=+-][A-Za-z]*|\*.{0,2}|~.{0,2}[0-9]*.{0,2}"
INTRON = r"(?s)^~(.{0,2})([0-9]*)(.{0,2})$"


def _paf(side: str) -> str:
    return f"paf_{side} AS (SELECT *, {LINE_SQL} AS line FROM ({alignments_sql(side)}) x)"


def _comp(x: str) -> str:
    return f"translate({x}, 'ACGTacgt', 'TGCAtgca')"


def _ops(cs: str) -> str:
    return (
        f"list_transform(regexp_extract_all({cs}, '{OP}'), lambda t: {{'k': t[1], 't': t, 'n': (CASE WHEN t[1] = ':' THEN coalesce(try_cast(t[2:] AS BIGINT), 0) "
        f"WHEN t[1] = '~' THEN coalesce(try_cast(regexp_extract(t, '{INTRON}', 2) AS BIGINT), 0) WHEN t[1] = '*' THEN 1 ELSE length(t) - 1 END)::BIGINT}})"
    )


def _introns(ops: str) -> str:
    moved = lambda kinds, i: f"coalesce(list_sum(list_transform({ops}[1:{i}-1], lambda o: CASE WHEN o.k IN ({kinds}) THEN o.n ELSE 0 END)), 0)::BIGINT"
    q, r = moved("':', '=', '*', '+'", "i"), moved("':', '=', '*', '-', '~'", "i")
    half = lambda g: f"rpad(regexp_extract({ops}[i].t, '{INTRON}', {g}), 2, 'n')"
    return f"list_transform(list_filter(range(1, len({ops}) + 1), lambda i: {ops}[i].k = '~'), lambda i: {{'q': {q}, 's': {r}, 'e': {r} + {ops}[i].n, 'm': lower({half(1)} || {half(3)})}})"


def _tuple(texts: str) -> str:
    return f"CASE WHEN len({texts}) = 1 THEN '(' || ({texts})[1] || ',)' ELSE '(' || array_to_string({texts}, ', ') || ')' END"


def _spans(x: str) -> str:
    return _tuple(f"list_transform({x}, lambda v: '(' || v.s || ', ' || v.e || ')')")


def _ints(x: str) -> str:
    return _tuple(f"list_transform({x}, lambda v: v::VARCHAR)")


def _count(kinds: str, events: bool) -> str:
    own = f"list_filter(ops, lambda o: o.k IN ({kinds}))"
    return f"len({own})::BIGINT" if events else f"coalesce(list_sum(list_transform({own}, lambda o: o.n)), 0)::BIGINT"


EVENTS = {"match": "':', '='", "substitution": "'*'", "insertion": "'+'", "deletion": "'-'", "intron": "'~'"}
COUNTS = ", ".join(f"{_count(k, w == 'events')} AS n_{e}_{w}" for e, k in EVENTS.items() for w in ("events", "bases"))
TRANSCRIPT = "CASE WHEN strand NOT IN ('+', '-') THEN '*' WHEN ts_tag IN ('+', '-') THEN ts_tag WHEN xs_tag IN ('+', '-') THEN CASE WHEN xs_tag = strand THEN '+' ELSE '-' END ELSE '*' END"
TURN = "CASE WHEN strand IN ('+', '-') AND query_transcript_strand IN ('+', '-') THEN CASE WHEN strand = query_transcript_strand THEN '+' ELSE '-' END ELSE '*' END"
CLIP_START = "(CASE WHEN target_name = '*' OR strand = '*' THEN 0 WHEN strand = '-' THEN greatest(query_len - query_end, 0) ELSE query_start END)::BIGINT"
CLIP_END = "(CASE WHEN target_name = '*' OR strand = '*' THEN 0 WHEN strand = '-' THEN query_start ELSE greatest(query_len - query_end, 0) END)::BIGINT"


def _features(name: str, source: str) -> str:
    place = "CASE WHEN strand = '-' THEN query_len - (greatest(query_len - query_end, 0) + i.q) ELSE query_start + i.q END"
    return f"""{name}_o AS (SELECT *, {_ops('cs')} AS ops, {TRANSCRIPT} AS query_transcript_strand FROM {source}),
{name}_i AS (SELECT *, {_introns('ops')} AS introns, {COUNTS}, {TURN} AS genomic_intron_strand FROM {name}_o),
{name}_j AS (SELECT *, list_sort(list_transform(introns, lambda i: {place})) AS qj, list_transform(introns, lambda i: {{'s': target_start + i.s, 'e': target_start + i.e}}) AS gj FROM {name}_i),
{name} AS (SELECT *, n_residue_matches::DOUBLE / nullif(aln_block_len, 0) AS aln_identity, greatest(query_end - query_start, 0)::BIGINT AS query_aln_len,
  greatest(query_end - query_start, 0)::DOUBLE / nullif(query_len, 0) AS query_aln_cov, {CLIP_START} AS n_softclip_bases_start, {CLIP_END} AS n_softclip_bases_end,
  (({CLIP_START} > 0)::BIGINT + ({CLIP_END} > 0)::BIGINT) AS n_softclip_events, {_ints('qj')} AS query_junctions, {_spans('gj')} AS genomic_junctions FROM {name}_j)"""


def _best(side: str) -> str:
    rank = "CASE WHEN target_name = '*' THEN 0 WHEN tp_tag IN ('P', 'I') THEN 3 WHEN tp_tag IN ('S', 'i') THEN 1 ELSE 2 END"
    return f"""top_{side} AS (SELECT query_name, ms_score AS t1, as_score AS t2, mapq AS t3 FROM paf_{side} WHERE target_name <> '*' QUALIFY row_number() OVER (PARTITION BY query_name ORDER BY ms_score DESC, as_score DESC, mapq DESC) = 1),
num_{side} AS (SELECT p.query_name, count(*) FILTER (target_name <> '*') AS n_alns, count(*) FILTER (target_name <> '*' AND tp_tag IN ('P', 'I')) AS n_alns_primsupp,
  count(*) FILTER (target_name <> '*' AND tp_tag IN ('S', 'i')) AS n_alns_secondary, count(*) FILTER (target_name <> '*' AND ms_score = t1 AND as_score = t2 AND mapq = t3) AS n_alns_tied_top_score
  FROM paf_{side} p LEFT JOIN top_{side} t ON p.query_name = t.query_name GROUP BY p.query_name),
best_{side} AS (SELECT p.*, n.* EXCLUDE (query_name) FROM (SELECT * FROM paf_{side} QUALIFY row_number() OVER (PARTITION BY query_name ORDER BY ms_score DESC, as_score DESC, mapq DESC, {rank} DESC, line) = 1) p JOIN num_{side} n ON p.query_name = n.query_name)"""


def _blank(kinds, prefix: str = "") -> str:
    return ", ".join(f"nullif({prefix}{n}, '') AS {n}" if kind == "s" else f"{prefix}{n} AS {n}" for n, kind in kinds)


SIDES = {s: ",\n".join([_paf(s), _best(s), _features(f"read_{s}", f"best_{s}")]) for s in "AB"}


def _set_diff(a: str, b: str) -> str:
    return f"list_sort(list_filter(list_distinct({a}), lambda v: NOT list_contains({b}, v)))"


def _table() -> str:
    sides = ", ".join(f"nullif({s.lower()}.{n}, '') AS {n}_{s}" if kind == "s" else f"{s.lower()}.{n} AS {n}_{s}" for s in "AB" for n, kind in schema.SIDE)
    only_a, only_b = _set_diff("a.qj", "b.qj"), _set_diff("b.qj", "a.qj")
    gaps = ", ".join(f"b.{n} - a.{n} AS {n}_diff" for n in ("aln_identity", "query_aln_cov", "query_aln_len", "as_score", "ms_score", "n_substitution_bases", "n_insertion_bases", "n_deletion_bases", "n_softclip_bases_start", "n_softclip_bases_end"))
    return f"""cmp AS (SELECT a.query_name AS query_name, a.query_len AS query_len, 'SetA' AS label_A, 'SetB' AS label_B, {sides}, a.strand = b.strand AS strand_match, {gaps},
  b.as_score::DOUBLE / nullif(a.as_score, 0) AS as_score_ratio, b.ms_score::DOUBLE / nullif(a.ms_score, 0) AS ms_score_ratio,
  len(list_filter(list_distinct(a.qj), lambda v: list_contains(b.qj, v)))::BIGINT AS n_query_junctions_shared, (len({only_a}) + len({only_b}))::BIGINT AS n_query_junctions_not_shared,
  len({only_a})::BIGINT AS n_query_junctions_only_A, len({only_b})::BIGINT AS n_query_junctions_only_B, {_ints(only_a)} AS query_junctions_only_A, {_ints(only_b)} AS query_junctions_only_B,
  a.introns AS in_A, b.introns AS in_B
  FROM read_A a JOIN read_B b ON a.query_name = b.query_name)"""


def _strip(cs: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({cs}, '{OP}'), lambda t: CASE WHEN t[1] = '~' THEN '~nn' || regexp_extract(t, '{INTRON}', 2) || 'nn' ELSE t END), '')"


def _turn(cs: str) -> str:
    part = lambda g: f"regexp_extract(t, '{INTRON}', {g})"
    return (
        f"array_to_string(list_transform(list_reverse(regexp_extract_all({cs}, '{OP}')), lambda t: CASE WHEN t[1] = ':' THEN t WHEN t[1] = '*' THEN '*' || {_comp('rpad(t[2:], 2, chr(110))')} "
        f"WHEN t[1] = '~' THEN '~' || reverse({_comp(part(3))}) || {part(2)} || reverse({_comp(part(1))}) ELSE t[1] || reverse({_comp('t[2:]')}) END), '')"
    )


def _mapped(s: str) -> str:
    return f"(coalesce(target_name_{s}, '*') <> '*')"


BASE = ",\n".join(["WITH " + SIDES["A"], SIDES["B"], _table()])
CLASSED = f"""{BASE},
k1 AS (SELECT *, {_mapped('A')} AND {_mapped('B')} AS m, {_strip("coalesce(cs_A, '')")} AS ca, {_strip("coalesce(cs_B, '')")} AS cb, {_strip(_turn("coalesce(cs_B, '')"))} AS cr FROM cmp),
k2 AS (SELECT *, CASE WHEN m THEN 'both' WHEN {_mapped('A')} THEN 'only_A' WHEN {_mapped('B')} THEN 'only_B' ELSE 'neither' END AS map_status,
  m AND query_start_A = query_start_B AND query_end_A = query_end_B AND strand_A = strand_B AND ca = cb AS same,
  m AND query_start_A = query_start_B AND query_end_A = query_end_B AND strand_A <> strand_B AND ca = cr AS query_identical_rc,
  CASE WHEN m THEN CASE WHEN target_name_A = target_name_B AND strand_A = strand_B AND target_start_A = target_start_B THEN 'same_position_' ELSE 'diff_position_' END || CASE WHEN ca = cb THEN 'same_aln' ELSE 'diff_aln' END END AS ref_class,
  CASE WHEN m THEN n_query_junctions_only_A = 0 AND n_query_junctions_only_B = 0 END AS junctions_identical FROM k1),
cls AS (SELECT *, same OR query_identical_rc OR map_status = 'neither' AS query_identical,
  (m AND same)::INT AS query_identical_same_strand, (m AND query_identical_rc)::INT AS query_identical_revcomp, coalesce(junctions_identical, false)::INT AS query_junctions_identical,
  {", ".join(f"coalesce(ref_class = '{k}', false)::INT AS ref_{k}" for k in ("same_position_same_aln", "same_position_diff_aln", "diff_position_same_aln", "diff_position_diff_aln"))} FROM k2)"""


def _decided(mode: str = "any-diff-query", both_only: bool = False) -> str:
    identical = "query_identical" if mode == "any-diff-query" else "query_identical AND NOT query_identical_rc AND starts_with(ref_class, 'same_position')"
    excluded = "WHEN map_status <> 'both' THEN 'excluded'" if both_only else ""
    return f"""{CLASSED},
dec AS (SELECT *, CASE {excluded} WHEN map_status = 'only_A' THEN 'diff_aln_only_A' WHEN map_status = 'only_B' THEN 'diff_aln_only_B' WHEN map_status = 'neither' THEN 'neither_mapped'
  WHEN NOT ({identical}) THEN 'diff_aln_both' WHEN query_identical_rc THEN 'identical_revcomp' ELSE 'identical_same_strand' END AS outcome FROM cls)"""


def _regions(side: str) -> str:
    return f"""iv_{side} AS (SELECT target_name_{side} AS chrom, target_start_{side} AS s, target_end_{side} AS e, strand_{side} AS strand, outcome = 'diff_aln_both' AS b FROM dec
  WHERE outcome IN ('diff_aln_both', 'diff_aln_only_{side}') AND {_mapped(side)} AND target_end_{side} > target_start_{side}),
is_{side} AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM iv_{side}),
il_{side} AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM is_{side}),
reg_{side} AS (SELECT chrom, min(s) AS "start", max(e) AS "end", count(*) AS n_diff_aln_total, count(*) FILTER (b) AS n_diff_aln_both, count(*) FILTER (NOT b) AS n_diff_aln_only_{side},
  count(*) FILTER (strand = '+') AS n_diff_aln_plus_strand, count(*) FILTER (strand = '-') AS n_diff_aln_minus_strand FROM il_{side} GROUP BY chrom, island)"""


FLAGS = ", ".join(schema.CLASSES)


def _rows(pairs: list[tuple[str, str]], source: str, text: bool = False) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS category, ({x})::{'VARCHAR' if text else 'BIGINT'} AS \"count\" FROM {source}" for n, x in pairs)


def _summary_diff(mode: str, both_only: bool) -> str:
    n = lambda *names: f"count(*) FILTER (outcome IN ({', '.join(repr(x) for x in names)}))"
    same, differ = ("identical_same_strand", "identical_revcomp", "neither_mapped"), ("diff_aln_both", "diff_aln_only_A", "diff_aln_only_B")
    pairs = [("mode", f"any_value('{mode}')"), ("aligned_both_only", f"any_value('{str(both_only).lower()}')"), ("reads_in_table", "count(*)"), ("reads_not_aligned_both_excluded", n("excluded")), ("reads_compared", n(*same, *differ)), ("reads_identical", n(*same)), *[(k, n(k)) for k in same], ("reads_differ", n(*differ)), *[(k, n(k)) for k in differ]]
    ends = " UNION ALL ".join(f"SELECT 'n_regions_{s}', count(*)::VARCHAR FROM reg_{s}" for s in "AB")
    return f"{_decided(mode, both_only)},\n{_regions('A')},\n{_regions('B')}\n{_rows(pairs, 'dec', True)} UNION ALL {ends}"


def _junction_lists() -> str:
    """gx: a row a read, with junction lists by genomic key and intron strands."""
    strand = lambda s: f"CASE WHEN {_mapped(s)} AND genomic_intron_strand_{s} IN ('+', '-') THEN genomic_intron_strand_{s} ELSE '*' END"
    keys = ", ".join(f"CASE WHEN {_mapped(s)} THEN list_transform(in_{s}, lambda i: {{'c': target_name_{s}, 's': target_start_{s} + i.s, 'e': target_start_{s} + i.e, 'z': {strand(s)}}}) ELSE [] END AS k_{s}, {strand(s)} AS s_{s}" for s in "AB")
    return f"{BASE},\ngx AS (SELECT *, {keys} FROM cmp)"


def _motif(m: str, z: str) -> str:
    turned = f"CASE WHEN {z} = '-' THEN reverse({_comp(m)}) ELSE {m} END"
    return f"(({turned})[1:2] || '-' || ({turned})[3:4])"


def _gjc_junctions() -> str:
    side = lambda s, o: f"SELECT query_name, '{s}' AS side, i, k_{s}[i] AS k, in_{s}[i].m AS m, list_contains(k_{o}, k_{s}[i]) AS agreed FROM gx, LATERAL (SELECT unnest(range(1, len(k_{s}) + 1)) AS i) u"
    motif = lambda s: f"coalesce({_motif(f'm_{s}', 'z')}, '.') AS motif_{s}"
    first = lambda s: f"arg_min(m, (m = 'nnnn', query_name, i)) FILTER (side = '{s}') AS m_{s}"
    return f"""{_junction_lists()},
ge AS ({side('A', 'B')} UNION ALL {side('B', 'A')}),
gc AS (SELECT k.c AS target_name, k.s AS intron_start, k.e AS intron_end, k.z AS z, count(*) FILTER (side = 'A') AS n_reads_A, count(*) FILTER (side = 'B') AS n_reads_B,
  count(*) FILTER (side = 'A' AND agreed) AS n_reads_both, {first('A')}, {first('B')} FROM ge GROUP BY ALL),
gp AS (SELECT target_name, intron_start, intron_end, z AS intron_strand, n_reads_A, n_reads_B, n_reads_both, n_reads_A - n_reads_both AS n_reads_only_A, n_reads_B - n_reads_both AS n_reads_only_B, {motif('A')}, {motif('B')} FROM gc)"""


def _gjc_read() -> str:
    motifs = lambda s: _tuple(f"list_transform(in_{s}, lambda i: chr(39) || {_motif('i.m', f's_{s}')} || chr(39))")
    a, b = _set_diff("k_A", "k_B"), _set_diff("k_B", "k_A")
    head = ", ".join(f"coalesce(target_name_{s}, '') AS target_name_{s}, coalesce(strand_{s}, '') AS strand_{s}, s_{s} AS genomic_intron_strand_{s}" for s in "AB")
    return f"""{_junction_lists()} SELECT query_name, {head}, len(k_A)::BIGINT AS n_junctions_A, len(k_B)::BIGINT AS n_junctions_B, len(list_filter(list_distinct(k_A), lambda v: list_contains(k_B, v)))::BIGINT AS n_junctions_shared,
  (len({a}) + len({b}))::BIGINT AS n_junctions_not_shared, len({a})::BIGINT AS n_junctions_only_A, len({b})::BIGINT AS n_junctions_only_B, {_spans('k_A')} AS genomic_junctions_A, {_spans('k_B')} AS genomic_junctions_B,
  {motifs('A')} AS junction_motifs_A, {motifs('B')} AS junction_motifs_B, {_spans(a)} AS genomic_junctions_only_A, {_spans(b)} AS genomic_junctions_only_B, coalesce(cs_A, '') AS cs_A, coalesce(cs_B, '') AS cs_B
  FROM gx WHERE len(k_A) + len(k_B) > 0"""


def _gjc_summary() -> str:
    both = "len(k_A) > 0 AND len(k_B) > 0"
    same = f"len({_set_diff('k_A', 'k_B')}) = 0 AND len({_set_diff('k_B', 'k_A')}) = 0"
    n = lambda x: f"count(*) FILTER ({x})"
    reads = [("reads_compared", "count(*)"), ("reads_with_junctions_both", n(both)), ("reads_with_junctions_only_A", n("len(k_A) > 0 AND len(k_B) = 0")), ("reads_with_junctions_only_B", n("len(k_A) = 0 AND len(k_B) > 0")), ("reads_with_junctions_neither", n("len(k_A) + len(k_B) = 0")),
             ("reads_genomic_junctions_identical", n(f"{both} AND {same}")), ("reads_genomic_junctions_differ", n(f"{both} AND NOT ({same})")), ("reads_genomic_intron_strand_differ", n(f"{both} AND s_A <> '*' AND s_B <> '*' AND s_A <> s_B"))]
    a, b, u = "n_reads_A > 0", "n_reads_B > 0", "intron_strand = '*'"
    keys = [("A", a), ("B", b), ("shared", f"{a} AND {b}"), ("only_A", f"{a} AND NOT {b}"), ("only_B", f"{b} AND NOT {a}"), ("unknown_strand_A", f"{a} AND {u}"), ("unknown_strand_B", f"{b} AND {u}")]
    return f"{_gjc_junctions()} {_rows(reads, 'gx')} UNION ALL {_rows([(f'n_distinct_junctions_{k}', n(x)) for k, x in keys], 'gp')}"


def _qjc() -> str:
    a, b = _mapped("A"), _mapped("B")
    bucket = f"""CASE WHEN NOT {a} AND NOT {b} THEN 'n_neither_aligned' WHEN {a} AND {b} THEN CASE WHEN n_query_junctions_only_A = 0 AND n_query_junctions_only_B = 0 THEN 'n_both_aligned_query_junctions_identical' ELSE 'n_query_junctions_different_aligned_both' END
  WHEN {a} THEN CASE WHEN n_intron_events_A > 0 THEN 'n_query_junctions_different_aligned_only_A' ELSE 'n_aligned_only_no_junctions' END WHEN n_intron_events_B > 0 THEN 'n_query_junctions_different_aligned_only_B' ELSE 'n_aligned_only_no_junctions' END"""
    place = lambda s: f"CASE WHEN strand_{s} = '-' THEN query_len - (greatest(query_len - query_end_{s}, 0) + i.q) ELSE query_start_{s} + i.q END"
    lists = ", ".join(f"list_sort(list_transform(list_transform(range(1, len(in_{s}) + 1), lambda n: {{'q': in_{s}[n].q, 's': in_{s}[n].s, 'e': in_{s}[n].e, 'm': in_{s}[n].m, 'n': n}}), lambda i: {{'q': {place(s)}, 'n': i.n, 'k': {{'c': target_name_{s}, 's': target_start_{s} + i.s, 'e': target_start_{s} + i.e, 'z': s_{s}}}, 'm': i.m}})) AS q_{s}" for s in "AB")
    side = lambda s, o: (
        f"SELECT query_name, bucket, '{s}' AS side, p AS junction_index, q_{s}[p].q AS query_pos, q_{s}[p].k AS k, q_{s}[p].m AS m, strand_{s} AS strand, {_mapped(o)} AND list_contains(list_transform(q_{o}, lambda j: j.q), q_{s}[p].q) AS matched_in_query, "
        f"{_mapped(o)} AND list_contains(k_{o}, q_{s}[p].k) AS matched_in_genomic, {_mapped(o)} AS other_side_aligned FROM qx, LATERAL (SELECT unnest(range(1, len(q_{s}) + 1)) AS p) u WHERE {_mapped(s)}"
    )
    return f"""{_junction_lists()},
qx AS (SELECT *, {bucket} AS bucket, {lists} FROM gx),
qe AS ({side('A', 'B')} UNION ALL {side('B', 'A')}),
qd AS (SELECT *, starts_with(bucket, 'n_query_junctions_different') AS looked, starts_with(bucket, 'n_query_junctions_different') AND NOT matched_in_genomic AS alone FROM qe),
qc AS (SELECT side, k, count(DISTINCT query_name) FILTER (alone) AS n_reads_query_junctions_different, count(*) AS n_reads_with_junction_total,
  coalesce(arg_min(m, (m = 'nnnn', query_name, junction_index)) FILTER (alone), arg_min(m, (m = 'nnnn', query_name, junction_index))) AS m FROM qd GROUP BY side, k)"""


def _qjc_catalog(side: str, unmatched: bool) -> str:
    more = "AND n_reads_query_junctions_different > 0" if unmatched else ""
    return f"{_qjc()} SELECT k.c AS target_name, k.s AS intron_start, k.e AS intron_end, k.z AS intron_strand, {_motif('m', 'k.z')} AS motif, n_reads_query_junctions_different, n_reads_with_junction_total FROM qc WHERE side = '{side}' {more}"


def _qjc_summary() -> str:
    n = lambda x: f"count(*) FILTER ({x})"
    names = ["n_neither_aligned", "n_both_aligned_query_junctions_identical", "n_aligned_only_no_junctions", "n_query_junctions_different_aligned_both", "n_query_junctions_different_aligned_only_A", "n_query_junctions_different_aligned_only_B"]
    reads = [("n_total", "count(*)"), ("n_query_junctions_different", n("starts_with(bucket, 'n_query_junctions_different')")), *[(x, n(f"bucket = '{x}'")) for x in names]]
    keys = [("unique_junctions_A", "a"), ("unique_junctions_B", "b"), ("unique_junctions_shared", "a AND b"), ("unique_junctions_only_A", "a AND NOT b"), ("unique_junctions_only_B", "b AND NOT a"), ("unmatched_junctions_A", "ua"), ("unmatched_junctions_B", "ub")]
    return f"""{_qjc()},
qk AS (SELECT k, bool_or(side = 'A') AS a, bool_or(side = 'B') AS b, bool_or(side = 'A' AND n_reads_query_junctions_different > 0) AS ua, bool_or(side = 'B' AND n_reads_query_junctions_different > 0) AS ub FROM qc GROUP BY k)
{_rows(reads, 'qx')} UNION ALL {_rows([(f'n_{k}', n(x)) for k, x in keys], 'qk')}"""


def _compare_summary() -> str:
    n = lambda x: f"count(*) FILTER ({x})"
    pairs = [("reads_compared", "count(*)"), *[(f"aligned_{s}", n(f"map_status = '{s}'")) for s in ("both", "only_A", "only_B", "neither")], ("query_identical", n("query_identical")),
             *[(f, f"coalesce(sum({f}), 0)") for f in schema.CLASSES], ("query_not_identical", n("m AND NOT query_identical")), ("query_junctions_not_identical", n("NOT junctions_identical"))]
    ids = lambda x, y: f"(SELECT count(*) FROM (SELECT query_name FROM paf_{x} EXCEPT SELECT query_name FROM paf_{y}))"
    return f"{CLASSED} {_rows(pairs, 'cls')} UNION ALL SELECT 'present_only_in_A_by_id', {ids('A', 'B')} UNION ALL SELECT 'present_only_in_B_by_id', {ids('B', 'A')}"


READS = f"SELECT query_name, outcome, {FLAGS} FROM dec WHERE starts_with(outcome, 'diff_')"

ORACLE = {
    "cs_event_counts": f"WITH {_paf('B')}, o AS (SELECT line, {_ops('cs')} AS ops FROM paf_B) SELECT line, {COUNTS} FROM o",
    "cs_introns": f"WITH {_paf('B')}, o AS (SELECT line, {_ops('cs')} AS ops FROM paf_B), i AS (SELECT line, {_introns('ops')} AS x FROM o) SELECT line, p::INT - 1 AS place, x[p].q AS query_pos, x[p].s AS intron_start, x[p].e AS intron_end, x[p].m AS motif FROM i, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS p) u",
    "cs_revcomp": f"WITH {_paf('B')} SELECT line, {_turn('cs')} AS turned, cs AS twice FROM paf_B",
    "cs_strip_motifs": f"WITH {_paf('A')} SELECT line, {_strip('cs')} AS stripped FROM paf_A",
    "transcript_and_intron_strand": f"WITH {_paf('A')}, t AS (SELECT *, {TRANSCRIPT} AS query_transcript_strand FROM paf_A) SELECT line, query_transcript_strand, {TURN} AS genomic_intron_strand FROM t",
    "softclip": f"WITH {_paf('A')} SELECT line, {CLIP_START} AS n_softclip_bases_start, {CLIP_END} AS n_softclip_bases_end, (({CLIP_START} > 0)::BIGINT + ({CLIP_END} > 0)::BIGINT) AS n_softclip_events FROM paf_A",
    "identity_coverage": f"WITH {_paf('A')}, {_features('f', 'paf_A')} SELECT line, aln_identity, query_aln_len, query_aln_cov FROM f",
    "alninfo": f"WITH {_paf('A')}, {_features('f', 'paf_A')} SELECT {_blank(schema.ALNINFO)} FROM f",
    "readinfo_collapse": f"WITH {SIDES['A']} SELECT {_blank(schema.READINFO)} FROM read_A",
    "alignment_counts": f"WITH {_paf('B')}, {_best('B')} SELECT query_name, n_alns, n_alns_primsupp, n_alns_secondary FROM num_B",
    "tied_top_score": f"WITH {_paf('B')}, {_best('B')} SELECT query_name, n_alns_tied_top_score FROM num_B",
    "read_id_set_check": f"WITH {_paf('A')}, {_paf('B')}, a AS (SELECT DISTINCT query_name FROM paf_A), b AS (SELECT DISTINCT query_name FROM paf_B), j AS (SELECT a.query_name AS x, b.query_name AS y FROM a FULL JOIN b ON a.query_name = b.query_name) SELECT count(x) AS n_a, count(y) AS n_b, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n_shared, count(*) FILTER (y IS NULL) AS n_only_a, count(*) FILTER (x IS NULL) AS n_only_b FROM j",
    "compare_table": f"{BASE} SELECT {', '.join(schema.names(schema.COMPARISON))} FROM cmp",
    "classify_reads": f"{CLASSED} SELECT query_name, map_status, query_identical, query_identical_rc, ref_class, junctions_identical, {', '.join(x for x in schema.CLASSES if x != 'query_junctions_identical')} FROM cls",
    "compare_summary": _compare_summary(),
    "find_aln_diff_reads_query": f"{_decided()} {READS}",
    "find_aln_diff_reads_reference": f"{_decided('any-diff-reference')} {READS}",
    "find_aln_diff_both_only": f"{_decided(both_only=True)} {READS}",
    "aln_identical_reads": f"{_decided()} SELECT query_name, outcome, {FLAGS} FROM dec WHERE NOT starts_with(outcome, 'diff_') AND outcome <> 'excluded'",
    "find_aln_diff_summary": _summary_diff("any-diff-query", False),
    "find_aln_diff_summary_reference": _summary_diff("any-diff-reference", True),
    "aln_diff_regions_a": f"{_decided()},\n{_regions('A')} SELECT * FROM reg_A",
    "aln_diff_regions_b": f"{_decided()},\n{_regions('B')} SELECT * FROM reg_B",
    "gjc_per_read": _gjc_read(),
    "gjc_per_junction": f"{_gjc_junctions()} SELECT * FROM gp",
    "gjc_summary": _gjc_summary(),
    "qjc_per_read_junctions": f"{_qjc()} SELECT query_name, side, junction_index, query_pos, k.c AS target_name, k.s AS intron_start, k.e AS intron_end, k.z AS intron_strand, {_motif('m', 'k.z')} AS motif, strand, matched_in_query, matched_in_genomic, other_side_aligned FROM qd WHERE looked",
    **{f"qjc_{'unmatched' if u else 'all'}_{s.lower()}": _qjc_catalog(s, u) for s in "AB" for u in (True, False)},
    "qjc_summary": _qjc_summary(),
}


def _cigar() -> str:
    return f"""WITH {_paf('B')}, c AS ({reads_sql('paf_B')}),
o AS (SELECT *, list_transform(regexp_extract_all(cigar, '[0-9]+[^0-9]'), lambda t: {{'n': t[:-2]::BIGINT, 'k': t[-1]}}) AS ops FROM c)"""


def _sum(kinds: str, ops: str = "ops") -> str:
    return f"coalesce(list_sum(list_transform(list_filter({ops}, lambda x: x.k IN ({kinds})), lambda x: x.n)), 0)::BIGINT"


def _cigar_stats() -> str:
    m, i, d, n, s = _sum("'M', '=', 'X'"), _sum("'I'"), _sum("'D'"), _sum("'N'"), _sum("'S'")
    lead, trail = "CASE WHEN ops[1].k IN ('S', 'H') THEN ops[1].n ELSE 0 END", "CASE WHEN len(ops) > 1 AND ops[-1].k IN ('S', 'H') THEN ops[-1].n ELSE 0 END"
    count = lambda k: f"len(list_filter(ops, lambda x: x.k = '{k}'))::BIGINT"
    return f"""{_cigar()} SELECT line, cigar, {m} AS m, {i} AS i_bases, {d} AS d_bases, {n} AS n_bases, {count('I')} AS i_count, {count('D')} AS d_count, {s} AS soft, {lead} AS lead, {trail} AS trail,
  {m} + {d} + {n} AS ref_len, {m} + {i} + {s} AS query_consumed, {m} + {i} + {lead} + {trail} AS query_len, {m} + {i} + {d} AS block_len FROM o"""


def _cigar_introns() -> str:
    before = _sum("'M', '=', 'X', 'D', 'N'", "ops[1:p-1]")
    return f"""{_cigar()}, e AS (SELECT line, ops, unnest(list_filter(range(1, len(ops) + 1), lambda i: ops[i].k = 'N')) AS p FROM o)
SELECT line, len(list_filter(ops[1:p], lambda x: x.k = 'N'))::INT - 1 AS place, {before} AS intron_start, {before} + ops[p].n AS intron_end FROM e"""


_GAPS = f"{_sum(chr(39) + 'I' + chr(39))} + {_sum(chr(39) + 'D' + chr(39))}"
_SAM_START = "CASE WHEN un THEN 0 WHEN strand = '-' THEN query_len - query_end ELSE query_start END::BIGINT"
_SAM_END = "CASE WHEN un THEN 0 WHEN strand = '-' THEN query_len - query_start ELSE query_end END::BIGINT"

ORACLE |= {
    "cigar_stats": _cigar_stats(),
    "cigar_introns": _cigar_introns(),
    "nm_calibration": f"{_cigar()} SELECT line, CASE WHEN flag % 32 = 0 THEN greatest(sb + ins, {_GAPS}) END::BIGINT AS nm, CASE WHEN flag % 32 = 0 THEN greatest(sb + ins, {_GAPS}) - ({_GAPS}) ELSE 0 END::BIGINT AS mm FROM o",
    "sam_flag_filter": f'{_cigar()} SELECT line, flag, true AS "all", flag & 256 = 0 AS primary_supp, flag & 2304 = 0 AS "primary" FROM o',
    "md_to_cs": f"WITH {_paf('A')}, m AS ({md_sql('paf_A')}) SELECT line, {_strip('cs')} AS cs, NULL::VARCHAR AS error FROM m",
    "format_float": f"WITH {_paf('A')}, d AS (SELECT DISTINCT n_residue_matches::DOUBLE / nullif(aln_block_len, 0) AS aln_identity FROM paf_A) SELECT aln_identity, aln_identity::VARCHAR AS shown FROM d WHERE aln_identity IS NOT NULL",
    "paf_text_roundtrip": f"WITH {_paf('B')} SELECT {', '.join(LINE)}, ms_score, as_score, cs, tp_tag, ts_tag, line FROM paf_B",
    "sam_to_paf": f"""WITH {_paf('A')} SELECT query_name, CASE WHEN un THEN 1 ELSE query_len END::BIGINT AS query_len, {_SAM_START} AS query_start, {_SAM_END} AS query_end, strand, target_name, target_len, target_start, target_end, n_residue_matches, aln_block_len, mapq,
  CASE WHEN un THEN '*' WHEN tp_tag = 'S' THEN 'S' ELSE 'P' END AS tp_tag, CASE WHEN un THEN NULL ELSE sb + ins + del END::BIGINT AS nm, CASE WHEN un THEN 0 ELSE sb END::BIGINT AS mm, cs FROM paf_A""",
    "sam_header": """WITH d AS (SELECT c_custkey AS k, 'c' || (c_custkey % 97) AS contig, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey * 7 + 1 END AS n FROM customer)
SELECT contig, arg_max(n, k)::BIGINT AS contig_len FROM d WHERE n IS NOT NULL GROUP BY contig""",
    "sam_rejects": """SELECT CASE WHEN c_custkey % 100 = 0 THEN 'fewer than 11 fields' ELSE ['FLAG is no number', 'contig is not in the header', 'POS is no place', 'alignment ends behind its contig',
  'MAPQ is no number', 'SEQ and CIGAR differ in length', 'SEQ and QUAL differ in length'][c_custkey % 8] END AS reason, count(*) AS n FROM customer WHERE c_custkey % 8 > 0 OR c_custkey % 100 = 0 GROUP BY ALL""",
}

ORACLE["table_text_roundtrip"] = f"SELECT query_name, query_len, target_name, target_start, target_end, mapq FROM ({ORACLE['readinfo_collapse']})"
