"""The events table as a time line: reference intervals, discovered segments and their sequences (see FIXTURES.md B2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from unitloom.functions.encoding import encoded
from unitloom.functions.scalars import cleaned, overlaps
from unitloom.operators.intervals import overlap_join
from unitloom.storage import materialize, read_table

BIN = 64  # ticks
_TEXT = {"error": "sil", "view": "AH1", "click": "K", "purchase": "IY0"}


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tick = (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) * 24 + F.hour("ts")).cast("long")
    return read_table(spark, sf_dir, "events").select(F.col("user_id").alias("utt"), "event_id", "ts", "event_type", tick.alias("tick"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(utt, idx, start, end, text)"""
    w = Window.partitionBy("utt").orderBy("ts", "event_id")
    text = F.lit("T")
    for kind, t in _TEXT.items():
        text = F.when(F.col("event_type") == kind, t).otherwise(text)
    rows = _ticks(spark, sf_dir).withColumn("end", F.lead("tick").over(w)).where("end is not null")
    return rows.select("utt", F.col("event_id").alias("idx"), F.col("tick").alias("start"), "end", text.alias("text"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(utt, seg_idx, start, end, cluster)"""
    last = _ticks(spark, sf_dir).groupBy("utt").agg(F.floor(F.max("tick") / 10).alias("n")).where("n > 0")
    k = F.col("seg_idx")
    rows = last.select("utt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("seg_idx"))
    return rows.select("utt", "seg_idx", (10 * k).alias("start"), (10 * k + 10).alias("end"), ((7 * F.col("utt") + 3 * k) % 40).alias("cluster"))


def overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(utt, seg_idx, cluster, start, end, idx, r_start, r_end, text): pairs that overlap; a reference interval without length may."""
    reference = gold(spark, sf_dir).withColumnsRenamed({"start": "r_start", "end": "r_end"})
    return overlap_join(segments(spark, sf_dir), reference, "utt", BIN)


def matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlapping(spark, sf_dir).where(overlaps(F.col("r_start"), F.col("r_end"), F.col("start"), F.col("end")))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(utt, seg_idx, cluster, phones): segments with a non-empty sequence."""
    texts = F.transform(F.sort_array(F.collect_list(F.struct("r_start", "idx", "text"))), lambda x: x["text"])
    rows = matching(spark, sf_dir).groupBy("utt", "seg_idx", "cluster").agg(texts.alias("texts"))
    return rows.select("utt", "seg_idx", "cluster", cleaned(F.col("texts")).alias("phones")).where(F.size("phones") > 0)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sequences with code, the sequence as a string of one character a token."""
    return encoded(materialize(sequences(spark, sf_dir), "sequences"), "phones", "code")


SQL = """
ev AS (SELECT user_id, event_id, ts, event_type, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts) AS tick FROM events),
g0 AS (
  SELECT user_id AS utt, event_id AS idx, tick AS r_start, lead(tick) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r_end,
         CASE event_type WHEN 'error' THEN 'sil' WHEN 'view' THEN 'AH1' WHEN 'click' THEN 'K' WHEN 'purchase' THEN 'IY0' ELSE 'T' END AS text FROM ev
), gold AS (SELECT * FROM g0 WHERE r_end IS NOT NULL),
seg AS (
  SELECT user_id AS utt, k AS seg_idx, 10 * k AS s, 10 * k + 10 AS e, (7 * user_id + 3 * k) % 40 AS cluster
  FROM (SELECT user_id, unnest(range(0, max(tick) // 10)) AS k FROM ev GROUP BY user_id)
), ov AS (
  SELECT seg.*, idx, r_start, r_end, text FROM seg JOIN gold ON seg.utt = gold.utt AND s < r_end AND e > r_start
), hit AS (
  SELECT *, least(e, r_end) - greatest(s, r_start) AS o, r_end - r_start AS g FROM ov
  WHERE (r_start <= s AND r_end >= e) OR (r_end - r_start >= 6 AND least(e, r_end) - greatest(s, r_start) >= 3) OR (r_end - r_start BETWEEN 1 AND 5 AND 2 * (least(e, r_end) - greatest(s, r_start)) >= r_end - r_start)
), tok AS (
  SELECT utt, seg_idx, cluster, r_start, idx, regexp_replace(text, '[0-9]', '', 'g') AS t FROM hit WHERE lower(text) NOT IN ('sil', 'spn', 'sp', '<unk>', '')
), lab AS (
  SELECT utt, seg_idx, cluster, string_agg(CASE t WHEN 'AH' THEN 'a' WHEN 'K' THEN 'k' WHEN 'IY' THEN 'i' ELSE 't' END, '' ORDER BY r_start, idx) AS code,
         string_agg(t, ' ' ORDER BY r_start, idx) AS phones FROM tok GROUP BY utt, seg_idx, cluster
), cnt AS (SELECT cluster, code, count(*) AS n FROM lab GROUP BY cluster, code)
"""
