"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions alone.

* Size: the number of words ``[^\\x20\\x09-\\x0D]+`` of a text (null: 0).
* Targets: the mix holds ``share`` times all words. Each source gets them by weight, at most
  ``most`` times its own words; what is over goes to the others by weight, until none is above.
  That level is found in closed form from running sums over the sources in order of cap / weight.
* Queue: a source's documents are shuffled by ``mark``, a seeded hash of id and text. Each may be sent
  ``most`` times, in that many rounds. A copy's virtual finish time is the words that its source
  has sent by then, divided by the source's target. The mix is the copies in order of finish time,
  up to the first whose words would pass the budget.
* Cut-offs: within a source, copies finish in order of (round, mark). So what the mix takes of a source is all
  before one (round, mark), and a table of one row a source says for each row of the corpus how often it is
  taken. Texts are never shuffled: each row is judged where it is read.
* Scale: rows with the same source, mark and size are one unit, counted before the shuffle. The words
  that a source has sent are running sums in two levels: each (source, hash range) is summed first, and
  only those sums are scanned; so a source of any size is spread over many tasks. The cut is found in
  the same way: finish times are put into ranges, the range in which the budget ends is found from
  their sums, and only its copies are put in order. The cut-offs are sent to all tasks if they are few
  by count, else joined with salted copies.

Rows that share id and text (repeated rows, copies without ids) are one unit: the mix takes all of them or none
in a round. Ties of finish times go by source, round and mark, so reruns agree. Null and empty texts have no
words, and are taken 0 times. A null source is a source, the last one. A null id is an id like others. Very long
texts are only counted and hashed. An empty table gives an empty mix. Extra columns are ignored by ``mix`` and
kept by ``mixed``, but for one named ``copies``, which gives way to the count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import BROADCAST_ROWS, cut, skew_join

WEIGHTS = (3, 1, 2)
ROWS_A_RANGE = 20_000


def size_of(text_col: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def mark_of(id_col: str, text_col: str, seed: str) -> Column:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary"))))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target), one row a source. Sums over sources only, so one task holds them."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    caps = by_source.select("source", "source_size", weight.cast("double").alias("weight"), (F.col("source_size") * most).cast("double").alias("cap"))
    every = Window.partitionBy()
    run = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(every) * F.lit(share)
    level = (budget - F.coalesce(F.sum("cap").over(run), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(run), F.lit(0.0)))
    levels = caps.withColumn("level", level).withColumn("fits", F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level")))
    first = levels.withColumn("at", F.min(F.when(F.col("fits").isNotNull(), F.col("cap") / F.col("weight"))).over(every))
    whole = first.withColumn("found", F.min(F.when(F.col("cap") / F.col("weight") == F.col("at"), F.col("fits"))).over(every))
    target = F.when(F.col("found").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("found") * F.col("weight")))
    return whole.select("source", "source_size", target.alias("target"))


def _ranges(n_rows: int) -> int:
    """Hex digits of the hash that split the rows into ranges of some ten thousand."""
    digits = 1
    while 16**digits * ROWS_A_RANGE < n_rows:
        digits += 1
    return digits


def cutoffs(units: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target, round, mark), one row a source: the last copy that the mix takes of it, null if none.

    ``units`` has source, mark, size and n, the number of rows of that kind.
    """
    n_units = units.count()
    known = cut(targets(units.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, most)).withColumnRenamed("source", "__source")
    digits = _ranges(n_units)
    ranged = units.filter("size > 0").select("source", "mark", (F.col("size") * F.col("n")).alias("words"), F.substring("mark", 1, digits).alias("part"))
    # the words before a unit of its source: sums of the ranges before, then within the range
    parts = ranged.groupBy("source", "part").agg(F.sum("words").alias("sum"))
    before = parts.select(
        F.col("source").alias("__source"), F.col("part").alias("__part"),
        F.coalesce(F.sum("sum").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("before"),
    )
    within = Window.partitionBy("source", "part").orderBy("mark").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("within", F.sum("words").over(within))
    placed = placed.join(before, F.col("source").eqNullSafe(F.col("__source")) & (F.col("part") == F.col("__part"))).drop("__source", "__part")
    key = lambda source: F.concat(F.col(source).isNull().cast("string"), F.coalesce(source, F.lit("")))
    queued = skew_join(placed.withColumn("key", key("source")), known.withColumn("key", key("__source")).drop("__source"), ["key"], "mark")
    queued = queued.select("source", "mark", "words", (F.col("before") + F.col("within")).alias("sent"), "source_size", "target")
    timed = queued.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    timed = timed.withColumn("finish", (F.col("sent") + F.col("round") * F.col("source_size")) / F.col("target"))
    n_slots = max(16, n_units // ROWS_A_RANGE)
    slotted = cut(timed.select("finish", "source", "round", "mark", "words", F.floor(F.col("finish") * n_slots).alias("slot")))
    budget = known.agg((F.sum("source_size") * F.lit(share)).alias("budget")).first()["budget"]
    slots = slotted.groupBy("slot").agg(F.sum("words").alias("sum"))
    upto = slots.select("slot", (F.sum("sum").over(Window.orderBy("slot")) - F.col("sum")).alias("before"), F.sum("sum").over(Window.orderBy("slot")).alias("after"))
    crossing = upto.filter(F.col("after") > F.lit(budget)).orderBy("slot").limit(1).collect() if budget else []
    taken = slotted
    if crossing:
        slot, before_slot = crossing[0]["slot"], crossing[0]["before"]
        run = Window.orderBy(F.col("finish"), F.col("source").asc_nulls_last(), "round", "mark").rowsBetween(Window.unboundedPreceding, 0)
        inside = slotted.filter(F.col("slot") == slot).withColumn("total", F.sum("words").over(run) + F.lit(before_slot))
        end = inside.filter(F.col("total") > F.lit(budget)).orderBy("total").first()
        place = lambda finish, source, round, mark: F.struct(finish, source.isNull(), source, round, mark)  # noqa: E731, A002
        last = place(F.lit(end["finish"]), F.lit(end["source"]).cast("string"), F.lit(end["round"]), F.lit(end["mark"]))
        taken = slotted.filter(place(F.col("finish"), F.col("source"), F.col("round"), F.col("mark")) < last)
    lasts = taken.groupBy(key("source").alias("key")).agg(F.max(F.struct("round", "mark")).alias("last"))
    met = known.withColumn("key", key("__source")).join(lasts, "key", "left")
    return cut(met.select(F.col("__source").alias("source"), "source_size", "target", "last.round", "last.mark"))


def _judged(rows: DataFrame, source_col: str, id_col: str, text_col: str, weights, share: float, most: int, seed: str) -> DataFrame:
    """``rows`` with __size, __source_size, __target and __copies."""
    narrow = "__mark" in rows.columns  # sizes and marks are there already
    size, mark = (F.col("__size"), F.col("__mark")) if narrow else (size_of(text_col), mark_of(id_col, text_col, seed))
    units = cut(rows.groupBy(F.col(source_col).cast("string").alias("source"), mark.alias("mark"), size.alias("size")).agg(F.count("*").alias("n")))
    ends = cutoffs(units, weights, share, most).toDF("__source", "__source_size", "__target", "__round", "__last")
    key = lambda source: F.concat(source.isNull().cast("string"), F.coalesce(source, F.lit("")))
    ends = ends.withColumn("__key", key(F.col("__source"))).drop("__source")
    own = rows.withColumns({} if narrow else {"__size": size, "__mark": mark}).withColumns({"__key": key(F.col(source_col).cast("string"))})
    few = ends.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = own.join(F.broadcast(ends), "__key", "left") if few else skew_join(own, ends, ["__key"], "__mark", how="left")
    copies = F.when(F.col("__size") > 0, F.coalesce(F.col("__round") + (F.col("__mark") <= F.col("__last")).cast("int"), F.lit(0)).cast("long")).otherwise(F.lit(0).cast("long"))
    return met.withColumn("__copies", copies)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: str = "mix") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, copies."""
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size_of(text_col).alias("__size"), mark_of(id_col, text_col, seed).alias("__mark")))
    found = _judged(rows, "source", "doc_id", "text", weights, share, most, seed)
    return found.select(
        "doc_id", "source", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__size") * F.col("__copies")).alias("taken"), F.col("__copies").alias("copies"),
    )


def digest(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` that the mix takes, each with ``copies``, how often it takes them."""
    found = _judged(docs, source_col, id_col, text_col, weights, share, most, seed).filter("__copies > 0")
    return found.select(*[c for c in docs.columns if c != "copies"], F.col("__copies").alias("copies"))


ORACLE = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS mark FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, [3, 1, 2][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, (source_size * 2)::DOUBLE AS cap FROM s),
l AS (SELECT *, cap / weight AS ratio, ((sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE - coalesce(sum(cap) OVER r, 0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER r, 0::DOUBLE)) AS level
  FROM w WINDOW r AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, level LIMIT 1),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM f) * weight, cap)) AS target FROM l),
u AS (SELECT source, mark, size, count(*) * size AS words FROM d WHERE size > 0 GROUP BY source, mark, size),
q AS (SELECT u.*, t.source_size, t.target, (sum(words) OVER (PARTITION BY u.source ORDER BY mark ROWS UNBOUNDED PRECEDING))::BIGINT AS sent FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (sent + r * source_size) / target AS finish FROM q, (VALUES (0), (1)) AS v(r)),
o AS (SELECT source, mark, sum(words) OVER (ORDER BY finish, source ASC NULLS LAST, r, mark ROWS UNBOUNDED PRECEDING) AS total FROM c),
k AS (SELECT source, mark, count(*) AS copies FROM o WHERE total <= (SELECT sum(source_size) * 1.5 FROM s) GROUP BY ALL)
SELECT d.doc_id, d.size, t.source_size, t.target, (d.size * coalesce(k.copies, 0))::BIGINT AS taken, coalesce(k.copies, 0)::BIGINT AS copies
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN k ON d.size > 0 AND d.mark = k.mark AND d.source IS NOT DISTINCT FROM k.source
"""
