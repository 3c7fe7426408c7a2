"""Two sets of alignments derived from the ``lineitem`` table, by SQL that Spark and DuckDB both run.

Each row is an alignment of the read named after its order. The sets differ by rule: reads that one set
lacks or leaves unmapped, motif-free introns, shifted introns, other strands, other places, missing insertions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.cs import apart

READ_LENGTH = 1000
#: what an alignment is made of, and what tells reads apart
PARTS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_quantity"]
READ = "l_orderkey"


def alignments_sql(side: str, source: str = "lineitem") -> str:
    b = side == "B"
    on_b = lambda digit, then, other="0": f"case when l_orderkey % 10 = {digit} then {then} else {other} end" if b else other
    return f"""
select concat('r', cast(o as string)) as query_name, cast({READ_LENGTH} as bigint) as query_len,
  cast(case when un then 0 else 5 end as bigint) as query_start,
  cast(case when un then 0 else 5 + e1 + sb + e2 + ins + e3 end as bigint) as query_end,
  case when un then '*' when rc <> (st = 'O') then '+' else '-' end as strand,
  case when un then '*' else concat('chr', cast(p % 5 + 1 as string)) end as target_name,
  cast(case when un then 0 else 5000000 end as bigint) as target_len,
  cast(case when un then 0 else p * 97 + moved end as bigint) as target_start,
  cast(case when un then 0 else p * 97 + moved + e1 + sb + i1 + e2 + del + i2 + e3 end as bigint) as target_end,
  cast(case when un then 0 else e1 + e2 + e3 end as bigint) as n_residue_matches,
  cast(case when un then 0 else e1 + sb + e2 + ins + del + e3 end as bigint) as aln_block_len,
  cast(case when un then 0 else q % 61 end as bigint) as mapq,
  cast(case when un then 0 else 100 + q % 7 end as bigint) as ms_score,
  cast(case when un then 0 else 90 + s % 3 + {int(b)} end as bigint) as as_score,
  case when un then '*' when n = 1 then 'P' when n % 3 = 0 then 'S' when n = 7 then '*' else 'P' end as tp_tag,
  case when un or s % 6 = 0 then '*' when s % 2 = 0 then '+' else '-' end as ts_tag,
  '*' as xs_tag,
  case when un then '' when rc then concat(
     case when e3 > 0 then concat(':', cast(e3 as string), '~', m2r, cast(i2 as string), m1r) else '' end,
     case when del > 0 then '-ggg' else '' end, case when ins > 0 then '+gt' else '' end,
     ':', cast(e2 as string), '~', m2r, cast(i1 as string), m1r, case when sb > 0 then '*tc' else '' end, ':', cast(e1 as string))
  else concat(':', cast(e1 as string), case when sb > 0 then '*ag' else '' end, '~', m1, cast(i1 as string), m2, ':', cast(e2 as string),
     case when ins > 0 then '+ac' else '' end, case when del > 0 then '-ccc' else '' end,
     case when e3 > 0 then concat('~', m1, cast(i2 as string), m2, ':', cast(e3 as string)) else '' end) end as cs,
  e1, sb, i1, e2, ins, del, i2, e3, rc, un
from (select l_orderkey as o, l_linenumber as n, l_partkey as p, l_suppkey as s, l_linestatus as st, cast(l_quantity as int) as q,
   l_orderkey % {29 if b else 23} = 3 as un, {"l_orderkey % 10 = 7" if b else "1 = 0"} as rc, {on_b(8, "500")} as moved,
   50 + cast(l_quantity as int) + {on_b(6, "1")} as e1, 100 + l_partkey % 50 - {on_b(6, "1")} as i1, 60 + l_suppkey % 20 as e2,
   case when l_linenumber % 2 = 0 then 80 + l_linenumber else 0 end as i2, case when l_linenumber % 2 = 0 then 40 else 0 end as e3,
   case when l_partkey % 3 = 0 then 1 else 0 end as sb, case when l_suppkey % 4 = 0 {"and l_orderkey % 10 <> 9" if b else ""} then 2 else 0 end as ins,
   case when l_suppkey % 5 = 0 then 3 else 0 end as del, {on_b(5, "'nn'", "'gt'")} as m1, {on_b(5, "'nn'", "'ag'")} as m2, 'ct' as m2r, 'ac' as m1r
  from {source} where l_orderkey % 97 <> {2 if b else 1}) t"""


LINE = [
    "query_name", "query_len", "query_start", "query_end", "strand", "target_name", "target_len", "target_start", "target_end",
    "n_residue_matches", "aln_block_len", "mapq",
]
LINE_SQL = "concat_ws('\t', " + ", ".join(f"cast({c} as string)" for c in LINE) + ", concat('ms:i:', cast(ms_score as string)), concat('AS:i:', cast(as_score as string)), concat('cs:Z:', cs), concat('tp:A:', tp_tag), concat('ts:A:', ts_tag))"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrow rows that alignments of both sets are made of."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*PARTS)


def made(rows: DataFrame, side: str) -> DataFrame:
    """``rows`` (parts, and more columns) that a set holds, with the columns of their alignments and ``line``."""
    kept = ", ".join(rows.columns)
    sql = alignments_sql(side, "{rows}").replace("rc, un\nfrom (select ", f"rc, un, {kept}\nfrom (select {kept}, ", 1)
    return _with_line(rows.sparkSession.sql(sql, rows=rows))


def _with_line(rows: DataFrame) -> DataFrame:
    """``rows`` with ``line``, whose projection is compiled apart."""
    line = LINE_SQL.replace("\t", "\\t").replace("cast(query_name as string)", "__name", 1)
    return rows.withColumn("__name", apart(F.col("query_name"))).withColumn("line", F.expr(line)).drop("__name")


def alignments(spark: SparkSession, sf_dir: str, side: str, parts: bool = False) -> DataFrame:
    """A set as a PAF source gives it: its columns, tags, and ``line``. ``parts``: with the lengths that it is made of."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = _with_line(spark.sql(alignments_sql(side, "{lineitem}"), lineitem=lineitem))
    return rows if parts else rows.drop("e1", "sb", "i1", "e2", "ins", "del", "i2", "e3", "rc", "un")


def reads_sql(source: str) -> str:
    """SAM-like columns of a set made with ``parts``: CIGAR and flags."""
    cigar = (
        "case when un then '*' when rc then concat(cast(query_len - query_end as string), 'S', case when e3 > 0 then concat(cast(e3 as string), 'M', cast(i2 as string), 'N') else '' end, "
        "case when del > 0 then concat(cast(del as string), 'D') else '' end, case when ins > 0 then concat(cast(ins as string), 'I') else '' end, cast(e2 as string), 'M', cast(i1 as string), 'N', cast(e1 + sb as string), 'M5S') "
        "else concat('5S', cast(e1 + sb as string), 'M', cast(i1 as string), 'N', cast(e2 as string), 'M', case when ins > 0 then concat(cast(ins as string), 'I') else '' end, "
        "case when del > 0 then concat(cast(del as string), 'D') else '' end, case when e3 > 0 then concat(cast(i2 as string), 'N', cast(e3 as string), 'M') else '' end, cast(query_len - query_end as string), 'S') end"
    )
    flag = "case when un then 4 else case when strand = '-' then 16 else 0 end + case when tp_tag = 'S' then 256 when tp_tag = '*' then 2048 else 0 end end"
    return f"select query_name, {flag} as flag, {cigar} as cigar, sb, ins, del, line from {source}"


def md_sql(source: str) -> str:
    """CIGAR, MD and SEQ of the mapped reads of set A, whose cs strings run forward."""
    return f"""select line, cs, concat('5S', cast(e1 + sb as string), 'M', cast(i1 as string), 'N', cast(e2 as string), 'M', case when ins > 0 then concat(cast(ins as string), 'I') else '' end,
    case when del > 0 then concat(cast(del as string), 'D') else '' end, case when e3 > 0 then concat(cast(i2 as string), 'N', cast(e3 as string), 'M') else '' end, cast(query_len - query_end as string), 'S') as cigar,
  concat(case when sb > 0 then concat(cast(e1 as string), 'A') else '' end,
    case when del > 0 then concat(cast(case when sb > 0 then e2 else e1 + e2 end as string), '^CCC', cast(e3 as string)) else cast(case when sb > 0 then e2 + e3 else e1 + e2 + e3 end as string) end) as md,
  concat('NNNNN', repeat('A', e1), repeat('G', sb), repeat('C', e2), case when ins > 0 then 'AC' else '' end, repeat('T', e3), repeat('N', cast(query_len - query_end as int))) as seq
from {source} where not un"""


def sam_sql(source: str) -> str:
    """Set A as SAM lines, with their header."""
    contigs = " union all ".join(f"select concat('@SQ\\tSN:chr{i}\\tLN:', '5000000') as value" for i in range(1, 6))
    record = (
        "concat_ws('\\t', query_name, cast(flag as string), target_name, cast(target_start + 1 as string), cast(mapq as string), cigar, '*', '0', '0', '*', '*', "
        "concat('NM:i:', cast(sb + ins + del as string)), concat('cs:Z:', cs))"
    )
    inner = reads_sql(source).replace("select query_name, ", "select query_name, target_name, target_start, mapq, cs, ", 1)
    return f"{contigs} union all select {record} as value from ({inner}) x"
