"""Chat formatting by cumulative-snapshot collapse.

A conversation that was logged turn by turn appears as several, each a beginning of the next. Each turn's hash holds
its position, role and text, so the exclusive or of the hashes up to a turn is a rolling hash of that prefix (128 bits, of two
differently seeded hashes). A conversation whose whole hash is a shorter prefix of another is a snapshot, and an
anti-join drops it; of equal conversations the smallest conv_id stays. What stays is rendered.

Texts move once, for rendering: up to the anti-join turns are their order and two hashes. Two kinds of conversations need
more. Long ones, of over ``PART`` turns and over a ``LONG_SHARE``-th of all turns (so there are fewer than that many, and
their ids can be broadcast), are dealt by range of (conv_id, turn, role, text): positions come from partition offsets,
and prefix hashes are computed within a partition and carried over by the hashes of the partitions before, so no
conversation has to fit a task. Tied ones, where turns that differ share number and role, go the same way, as
their order is that of the texts. Prefixes and whole hashes are made distinct with partial aggregates before they are
joined, so a first turn that many share is one row there.

Rendered text comes in parts of ``PART`` turns, so a usual conversation is one row. A mark in a text cannot be taken
for one that was rendered: in texts and roles ``<|`` gets a backslash between its signs, where backslashes stand there
already one more, and in roles ``|>`` too; so it can be undone.

Defined results: turns are ordered by turn (null first), then role and text; repeated rows are turns of their own; null
roles and texts differ from empty ones when compared, and render as empty; a null conv_id is a conversation of its own;
texts of any length are hashed and rendered whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitloom.storage import materialize

PART, LONG_SHARE = 256, 100_000
_KEY = ("n", "a", "b")
_HASHES = ("conv_id", "pos", "turns", "a", "b")


def _hashed(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.isnull("role"), F.coalesce("role", F.lit("")), F.isnull("text"), F.coalesce("text", F.lit("")))


def _placed(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("pos").cast("long"), f"h{seed}")


def _ranked(turns: DataFrame) -> DataFrame:
    """(conv_id, role, text, rank, part): rank runs along (conv_id, turn, role, text) over the whole table."""
    order = ("conv_id", "turn", "role", "text")
    dealt = turns.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text", F.monotonically_increasing_id().alias("at"))
    dealt = materialize(dealt, "turns").withColumn("part", F.shiftright("at", 33).cast("int"))
    sizes = {r[0]: r[1] for r in dealt.groupBy("part").count().collect()}  # one number a partition
    before, n = [], 0
    for k in sorted(sizes):
        before.append((k, n))
        n += sizes[k]
    offsets = turns.sparkSession.createDataFrame(before, "part int, before long")
    return dealt.join(F.broadcast(offsets), "part").select("conv_id", "role", "text", "part", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("rank"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, turns, role, text, a, b), written: a and b hash the conversation up to this turn. For conversations of any size."""
    ranked = _ranked(turns)
    sizes = materialize(ranked.groupBy("conv_id").agg(F.min("rank").alias("start"), F.count("*").alias("turns")), "sizes").withColumnRenamed("conv_id", "c")
    placed = ranked.join(sizes, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c").withColumn("pos", F.col("rank") - F.col("start"))
    placed = placed.withColumns({"h1": _hashed(1), "h2": _hashed(2)}).withColumns({"p1": _placed(1), "p2": _placed(2)})
    within = Window.partitionBy("conv_id", "part").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    local = materialize(placed.withColumns({"la": F.bit_xor("p1").over(within), "lb": F.bit_xor("p2").over(within)}).drop("h1", "h2", "p1", "p2", "start"), "prefixes")
    ends = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    last = local.groupBy("conv_id", "part").agg(F.max_by("la", "rank").alias("ta"), F.max_by("lb", "rank").alias("tb"))
    carried = last.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.bit_xor("ta").over(ends).alias("ca"), F.bit_xor("tb").over(ends).alias("cb")).where("ca is not null")
    none = F.lit(0).cast("long")
    known = local.join(materialize(carried, "carried"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left").select(
        "conv_id", "pos", "turns", "role", "text", F.col("la").bitwiseXOR(F.coalesce("ca", none)).alias("a"), F.col("lb").bitwiseXOR(F.coalesce("cb", none)).alias("b")
    )
    return materialize(known, "hashed")


def _usual(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, turns, a, b, tied) of conversations that fit a task, without their texts: one exchange of hashes."""
    rows = turns.select("conv_id", "turn", "role", _hashed(1).alias("h1"), _hashed(2).alias("h2"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "h1", "h2")
    alike = F.lag(F.struct("turn", "role")).over(w) == F.struct("turn", "role")
    tied = alike & (F.lag(F.struct("h1", "h2")).over(w) != F.struct("h1", "h2"))
    placed = rows.withColumns({"pos": F.row_number().over(w).cast("long") - 1, "turns": F.count("*").over(Window.partitionBy("conv_id")), "tied": F.coalesce(tied, F.lit(False))})
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumns({"p1": _placed(1), "p2": _placed(2)}).select("conv_id", "pos", "turns", F.bit_xor("p1").over(upto).alias("a"), F.bit_xor("p2").over(upto).alias("b"), "tied")


def collapse(turns: DataFrame, part: int = PART) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(c, hard, turns): the maximal conversations and whether each is long or tied; the turns of those that are not long; the prefixes of the long and tied ones."""
    turns = turns.select("conv_id", "turn", "role", "text")
    n = turns.count()
    least = max(part, -(-n // LONG_SHARE))
    long_ = materialize(turns.groupBy("conv_id").count().where(F.col("count") > least).select(F.col("conv_id").alias("c")), "long")  # fewer than LONG_SHARE rows
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    short = turns.join(F.broadcast(long_), same, "left_anti")
    known = materialize(_usual(short), "hashes")
    hard = materialize(long_.unionByName(known.where("tied").select(F.col("conv_id").alias("c")).distinct()), "hard")
    others = prefixes(turns.join(hard, same, "left_semi"))
    usual = known.join(hard, same, "left_anti")
    every = usual.select(*_HASHES, F.lit(False).alias("hard")).unionByName(others.select(*_HASHES, F.lit(True).alias("hard")))
    whole = every.where(F.col("pos") == F.col("turns") - 1).select("conv_id", "hard", F.col("turns").alias("n"), "a", "b")
    classes = whole.groupBy(*_KEY).agg(F.min(F.struct("conv_id", "hard")).alias("own"))
    shorter = every.where(F.col("pos") < F.col("turns") - 1).select((F.col("pos") + 1).alias("n"), "a", "b").distinct()
    stay = classes.join(shorter, list(_KEY), "left_anti").select(F.col("own.conv_id").alias("c"), F.col("own.hard").alias("hard"), F.col("n").alias("turns"))
    return materialize(stay, "maximal"), short, others


def _piece() -> Column:
    """A rendered turn; marks within its role and text are escaped."""
    safe = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"<(\\*)\|", r"<\\$1|")
    role = F.regexp_replace(safe("role"), r"\|(\\*)>", r"|\\$1>")
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), safe("text"), F.lit("\n"))


def formatted(turns: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, part, n_turns, text): the maximal conversations, rendered in parts of ``part`` turns."""
    stay, short, others = collapse(turns, part)
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    item = F.struct("turn", "role", _piece().alias("piece"))
    # turns of one number and role are equal here, or the conversation would be among the others
    key = lambda c: (F.isnull(c), F.coalesce(F.col(c), F.lit(0)))  # noqa: E731  the join and the groups share one exchange
    left, right = (df.withColumns({f"{side}0": key(c)[0], f"{side}1": key(c)[1]}) for df, c, side in ((short, "conv_id", "x"), (stay.where("not hard"), "c", "y")))
    both = left.join(right, (F.col("x0") == F.col("y0")) & (F.col("x1") == F.col("y1")))
    whole = both.groupBy("x0", "x1").agg(F.first("conv_id").alias("conv_id"), F.max("turns").alias("n_turns"), F.sort_array(F.collect_list(item)).alias("items"))
    slices = F.transform(F.sequence(F.lit(0), F.floor((F.col("n_turns") - 1) / part).cast("int")), lambda k: F.struct(k.alias("part"), F.array_join(F.slice(F.col("items.piece"), k * part + 1, part), "").alias("text")))
    usual = whole.select("conv_id", "n_turns", F.explode(slices).alias("s")).select("conv_id", "s.part", "n_turns", "s.text")
    kept = others.join(stay.where("hard").select("c"), same, "left_semi")
    parts = kept.groupBy("conv_id", F.floor(F.col("pos") / part).cast("int").alias("part")).agg(F.max("turns").alias("n_turns"), F.sort_array(F.collect_list(F.struct("pos", _piece().alias("piece")))).alias("pieces"))
    return usual.unionByName(parts.select("conv_id", "part", "n_turns", F.array_join(F.col("pieces.piece"), "").alias("text")))


SQL = r"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS pos,
         count(*) OVER (PARTITION BY conv_id) AS turns FROM conversations
), k AS (SELECT *, md5(coalesce('r' || role, '') || chr(1) || coalesce('t' || text, '')) AS h FROM t),
p AS (SELECT *, string_agg(h, '' ) OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM k),
whole AS (SELECT prefix, min(conv_id) AS conv_id FROM p WHERE pos = turns - 1 GROUP BY prefix),
stay AS (SELECT conv_id FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE pos < turns - 1))
SELECT conv_id, CAST(pos // 256 AS INTEGER) AS part, max(turns) AS n_turns,
       string_agg('<|' || regexp_replace(regexp_replace(coalesce(role, ''), '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g') || '|>' || chr(10) || regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') || chr(10), '' ORDER BY pos) AS text
FROM t WHERE conv_id IN (SELECT conv_id FROM stay) GROUP BY conv_id, pos // 256
"""
