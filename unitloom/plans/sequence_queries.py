"""Queries over time lines and sequences, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from unitloom.functions import scalars
from unitloom.operators import agreement, boundaries, intervals
from unitloom.operators.ranking import rank_frequency
from unitloom.plans import timeline
from unitloom.storage import read_table


def clustering_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = agreement.clustering_metrics(timeline.labels(spark, sf_dir), timeline.segments(spark, sf_dir))
    scores = [F.round(c, 9).alias(c) for c in ("pacc", "ipacc", "f1_pacc", "wnes", "iwnes", "f1_wnes")]
    return row.select(*scores, "num_segments", "num_utterances", "num_clusters", "num_clusters_all", "num_gold_types")


_PACC = """
r AS (SELECT *, rank() OVER (PARTITION BY cluster ORDER BY n DESC) AS r FROM cnt),
m AS (SELECT cluster, code, rank() OVER (PARTITION BY cluster ORDER BY length(code) DESC) AS r FROM r WHERE r = 1),
d AS (
  SELECT c.cluster, m.code, sum(levenshtein(c.code, m.code) * c.n) / CAST(length(m.code) AS DOUBLE) AS d, sum(c.n) AS n
  FROM cnt c JOIN m ON m.cluster = c.cluster AND m.r = 1 GROUP BY c.cluster, m.code
), b AS (SELECT cluster, min(d) AS d, max(n) AS n FROM d GROUP BY cluster),
pacc AS (SELECT 1 - coalesce(sum(d) / sum(n), 0) AS pacc FROM b)
"""
_IPACC = "ipacc AS (SELECT coalesce(sum(top) / sum(n), 1.0) AS ipacc FROM (SELECT sum(n) AS n, max(n) AS top FROM cnt GROUP BY code HAVING sum(n) > 1))"
_WNES = """
pr AS (
  SELECT a.cluster, sum(levenshtein(a.code, b.code) / CAST(greatest(length(a.code), length(b.code)) AS DOUBLE) * a.n * b.n) AS s
  FROM cnt a JOIN cnt b ON a.cluster = b.cluster AND a.code < b.code GROUP BY a.cluster
), sz AS (SELECT cluster, sum(n) AS n FROM cnt GROUP BY cluster),
wnes AS (SELECT 1 - sum(CASE WHEN n > 1 THEN coalesce(s, 0) * 2 / (n - 1) ELSE 0 END) / sum(n) AS wnes FROM sz LEFT JOIN pr USING (cluster))
"""
_IWNES = "iwnes AS (SELECT coalesce(sum(same / CAST(n - 1 AS DOUBLE)) / sum(n), 1.0) AS iwnes FROM (SELECT sum(n) AS n, sum(n * (n - 1)) AS same FROM cnt GROUP BY code HAVING sum(n) > 1))"
_CARD = """
card AS (
  SELECT (SELECT count(*) FROM lab) AS num_segments, (SELECT count(DISTINCT cluster) FROM lab) AS num_clusters, (SELECT count(DISTINCT code) FROM lab) AS num_gold_types,
         (SELECT count(DISTINCT utt) FROM seg) AS num_utterances, (SELECT count(DISTINCT cluster) FROM seg) AS num_clusters_all
)
"""


def pacc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.pacc(agreement.counted(timeline.labels(spark, sf_dir))).select(F.round("pacc", 9).alias("pacc"))


def ipacc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.ipacc(agreement.counted(timeline.labels(spark, sf_dir))).select(F.round("ipacc", 9).alias("ipacc"))


def wnes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.wnes(agreement.counted(timeline.labels(spark, sf_dir))).select(F.round("wnes", 9).alias("wnes"))


def iwnes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.iwnes(agreement.counted(timeline.labels(spark, sf_dir))).select(F.round("iwnes", 9).alias("iwnes"))


def eval_cardinalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.cardinalities(timeline.labels(spark, sf_dir), timeline.segments(spark, sf_dir))


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.gold(spark, sf_dir).select("utt", "idx", "text", (F.col("end") - F.col("start")).alias("duration"))


def durations_to_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals.bounds_from_durations(_gaps(spark, sf_dir), "utt", "idx", "duration")
    return rows.select("utt", "idx", "start", "end", F.lit(0).cast("long").alias("unit_id"))


def unit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _gaps(spark, sf_dir).withColumn("unit", F.length("text").cast("long"))
    return intervals.unit_table(rows, "utt", "idx", "duration", "unit", F.col("text") == "sil")


def frames_to_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeline.segments(spark, sf_dir).select("utt", "seg_idx", (F.col("end") / 2).cast("long").alias("frame"))
    f = F.col("frame")
    return rows.select("utt", "seg_idx", scalars.frame_to_seconds(f).alias("seconds"), scalars.frame_to_sample(f).alias("sample"), F.bround(scalars.frame_to_seconds(f) + 0.5, 2).alias("shifted"))


def clean_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeline.gold(spark, sf_dir).groupBy("utt").agg(F.transform(F.sort_array(F.collect_list(F.struct("start", "idx", "text"))), lambda x: x["text"]).alias("texts"))
    return rows.select("utt", F.array_join(scalars.cleaned(F.col("texts")), " ").alias("phones"))


def overlap_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeline.overlapping(spark, sf_dir)
    counts = scalars.overlaps(F.col("r_start"), F.col("r_end"), F.col("start"), F.col("end"))
    return rows.select("utt", "seg_idx", "idx", counts.alias("counts"))


def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.sequences(spark, sf_dir).select("utt", "seg_idx", "cluster", F.array_join("phones", " ").alias("phones"))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("utt").orderBy("seg_idx")
    return timeline.labels(spark, sf_dir).withColumn("before", F.lag("code").over(w)).where("before is not null")


def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir).select("utt", "seg_idx", F.levenshtein("code", "before").cast("long").alias("distance"))


def norm_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir).select("utt", "seg_idx", F.round(scalars.normalized_distance(F.col("code"), F.col("before")), 9).alias("distance"))


def phone_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_counts(timeline.sequences(spark, sf_dir))


def ngram_counts(rows: DataFrame) -> DataFrame:
    """(order, gram, n) of all runs of one, two and three tokens within each sequence."""

    def grams(k: int) -> Column:
        starts = F.when(F.size("phones") >= k, F.sequence(F.lit(1), F.size("phones") - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(F.lit(k).alias("order"), F.array_join(F.slice("phones", i, k), " ").alias("gram")))

    return rows.select(F.explode(F.concat(*map(grams, (1, 2, 3)))).alias("g")).groupBy("g.order", "g.gram").agg(F.count("*").alias("n"))


_GRAMS = """
ph AS (SELECT string_split(phones, ' ') AS p FROM lab),
gr AS (
  SELECT k AS "order", array_to_string(list_slice(p, i, i + k - 1), ' ') AS gram FROM (SELECT p, k, unnest(range(1, len(p) - k + 2)) AS i FROM ph, (SELECT unnest([1, 2, 3]) AS k))
), ng AS (SELECT "order", gram, count(*) AS n FROM gr GROUP BY "order", gram)
"""


def zipf_phone_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_frequency(phone_ngrams(spark, sf_dir).withColumnRenamed("gram", "name"), "order")


def zipf_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = timeline.segments(spark, sf_dir).groupBy(F.col("cluster").cast("string").alias("name")).agg(F.count("*").alias("n"))
    return rank_frequency(counts)


def zipf_phone_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = timeline.sequences(spark, sf_dir).groupBy(F.array_join("phones", " ").alias("name")).agg(F.count("*").alias("n"))
    return rank_frequency(counts)


def zipf_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = zipf_clusters(spark, sf_dir).withColumn("method", scalars.method_label(F.lit("kmeans++_clusters_40")))
    return a.unionByName(zipf_phone_sequences(spark, sf_dir).withColumn("method", F.lit("Phone sequences")))


def top_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min(F.struct("utt", "seg_idx"))
    sizes = timeline.segments(spark, sf_dir).groupBy("cluster").agg(F.count("*").alias("n"), first.alias("first"))
    return sizes.orderBy(F.desc("n"), "first").limit(5).select("cluster", "n")


def examples_per_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = intervals.first_of_each(timeline.segments(spark, sf_dir), "cluster", ["utt", "seg_idx"], 3)
    sample = lambda c: scalars.frame_to_sample((F.col(c) / 2).cast("long"))
    return best.select("cluster", F.col("rn").cast("long").alias("rn"), "utt", "seg_idx", sample("start").alias("first_sample"), sample("end").alias("end_sample"))


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.gold(spark, sf_dir).withColumn("text", F.when(F.col("text") == "sil", "").otherwise(F.col("text")))


def speech_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = intervals.islands(_spoken(spark, sf_dir), "utt", ["start", "idx"], F.col("text") != "")
    return inside.groupBy("utt", "island").agg(F.min("start").alias("onset"), F.max("end").alias("offset"), F.count("*").alias("n"))


def token_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = intervals.islands(_spoken(spark, sf_dir), "utt", ["start", "idx"], F.col("text") != "")
    w = Window.partitionBy("utt", "island").orderBy("start", "idx")
    return inside.select("utt", "island", "idx", F.lag("end", 1, 0).over(w).cast("long").alias("token_start"), F.col("end").alias("token_end"))


def _cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = timeline.segments(spark, sf_dir)
    return s.select("utt", F.col("start").alias("at")).unionByName(s.groupBy("utt").agg(F.max("end").alias("at")))


def boundary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundaries.boundary_metrics(_spoken(spark, sf_dir), _cuts(spark, sf_dir))


def token_boundary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundaries.token_counts(boundaries.matched_islands(_spoken(spark, sf_dir), _cuts(spark, sf_dir)))


def boundary_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, F1, over-segmentation and R-value of each user's purchases among clicks, as counts."""
    e = read_table(spark, sf_dir, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(c) for k, c in (("click", "n_seg"), ("view", "n_ref"), ("purchase", "n"))])
    rows = e.withColumn("n_hit", F.least("n_seg", "n_ref", "n")).withColumn("s", scalars.precision_recall_f1(F.col("n_seg"), F.col("n_ref"), F.col("n_hit")))
    p, r = F.col("s.precision"), F.col("s.recall")
    inf = lambda c: F.when(c == float("-inf"), None).otherwise(F.round(c, 9))  # noqa: E731  engines print infinity differently
    return rows.select("user_id", F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), inf(F.col("s.f1")).alias("f1"), inf(scalars.over_segmentation(p, r)).alias("os"), inf(F.when(p > 0, scalars.r_value(p, r))).alias("r_value"))


def pair_by_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return intervals.paired(docs, read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", ["quality", "toxic"])


def missing_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.missing(read_table(spark, sf_dir, "documents").select("doc_id", "source"), read_table(spark, sf_dir, "labels"), "doc_id")


def pair_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = timeline.segments(spark, sf_dir).groupBy("utt").agg(F.count("*").alias("n_segments"))
    return intervals.paired_strictly(users, timeline.gold(spark, sf_dir).groupBy("utt").agg(F.count("*").alias("n_gold")), "utt")


def features_segments_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two tables of one utterance, by utterance and position: turns and their lengths."""
    c = read_table(spark, sf_dir, "conversations")
    features = c.select(F.col("conv_id").alias("utt"), F.col("turn").alias("seg_idx"), F.length("text").cast("long").alias("size"))
    segments = intervals.bounds_from_durations(features, "utt", "seg_idx", "size").select("utt", "seg_idx", "start", "end")
    return features.join(segments, ["utt", "seg_idx"])


def global_row_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations").select(F.concat(F.lit("c/"), F.col("conv_id").cast("string")).alias("file"), "turn")
    w = Window.partitionBy("file").orderBy("turn")
    return intervals.with_row_ids(c.withColumn("at", F.row_number().over(w) - 1), "file", "at").select("file", "turn", "row_id")


def union_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of two runs with different columns in one table, and their distinct clusters."""
    a = timeline.segments(spark, sf_dir).select("cluster", F.lit("grid").alias("run"), F.col("utt"))
    b = read_table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("cluster"), F.lit("vectors").alias("run"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("run", "cluster").agg(F.count("*").alias("n"), F.count("utt").alias("n_utt"))


QUERIES = [
    clustering_metrics, pacc, ipacc, wnes, iwnes, eval_cardinalities, durations_to_intervals, unit_table, frames_to_time, clean_tokens, overlap_predicate, interval_overlap_join, edit_distance,
    norm_edit_distance, phone_ngrams, zipf_phone_ngrams, zipf_clusters, zipf_phone_sequences, zipf_comparison, top_clusters, examples_per_cluster, speech_islands, token_intervals, boundary_metrics,
    token_boundary_metrics, boundary_prf, pair_by_stem, missing_refs, pair_strict, features_segments_join, global_row_id, union_runs,
]


def _tl(select: str, *more: str) -> str:
    return "WITH " + ",".join([timeline.SQL, *more]) + select


_RANKS = "row_number() OVER (ORDER BY n DESC, name) AS rank, round(n / sum(n) OVER (), 9) AS probability"
_ZC = f"SELECT name, n, {_RANKS} FROM (SELECT CAST(cluster AS VARCHAR) AS name, count(*) AS n FROM seg GROUP BY cluster)"
_ZS = f"SELECT name, n, {_RANKS} FROM (SELECT phones AS name, count(*) AS n FROM lab GROUP BY phones)"
_SPOKEN = """
sp AS (SELECT utt, idx, r_start, r_end, text <> 'sil' AS inside FROM gold),
bg AS (SELECT *, CASE WHEN inside AND NOT coalesce(lag(inside) OVER (PARTITION BY utt ORDER BY r_start, idx), false) THEN 1 ELSE 0 END AS b FROM sp),
isl AS (SELECT * FROM (SELECT *, CAST(sum(b) OVER (PARTITION BY utt ORDER BY r_start, idx) AS BIGINT) AS island FROM bg) WHERE inside)
"""
_BOUND = """
kn AS (SELECT utt, island, min(r_start) AS onset, list(r_end ORDER BY r_start, idx) AS ends FROM isl GROUP BY utt, island),
ct AS (SELECT utt, s AS a FROM seg UNION ALL SELECT utt, max(e) FROM seg GROUP BY utt),
fo AS (
  SELECT kn.utt, kn.island, any_value(ends) AS ends, list(a ORDER BY a) FILTER (WHERE a IS NOT NULL) AS inside
  FROM kn LEFT JOIN ct ON ct.utt = kn.utt AND a > onset + 5 AND a < ends[-1] - 5 GROUP BY kn.utt, kn.island
), ma AS (SELECT utt, island, ends, list_concat(coalesce(inside, []), [ends[-1]]) AS found FROM fo),
tk AS (SELECT utt, island, found AS oe, list_concat([0], found[1:-2]) AS os, ends AS ie, list_concat([0], ends[1:-2]) AS iss FROM ma)
"""


def _folded(name: str, start: str, outer: str, inner: str, near: str) -> str:
    """One row (n_seg, n_ref, hits): each of outer, in order, takes the first of inner after the last one taken that is near."""
    return f"""
{name}_f AS (
  SELECT *, 0 AS k, 0 AS last, 0 AS hits FROM {start}
  UNION ALL
  SELECT * EXCLUDE (j) REPLACE (k + 1 AS k, coalesce(j, last) AS last, hits + CASE WHEN j IS NULL THEN 0 ELSE 1 END AS hits)
  FROM (SELECT *, CAST(list_min(list_filter(range(last + 1, len({inner}) + 1), lambda x: {near})) AS INTEGER) AS j FROM {name}_f WHERE k < len({outer}))
)"""


_B_FOLD = _folded("b", "(SELECT utt, island, found[1:-2] AS seg_, ends[1:-2] AS ref_ FROM ma)", "ref_", "seg_", "abs(seg_[x] - ref_[k + 1]) <= 5")
_T_FOLD = _folded("t", "tk", "oe", "ie", "abs(iss[x] - os[k + 1]) <= 5 AND abs(ie[x] - oe[k + 1]) <= 5")
_B_SUM = "b AS (SELECT CAST(sum(len(seg_)) AS BIGINT) AS n_seg, CAST(sum(len(ref_)) AS BIGINT) AS n_ref, CAST(sum(hits) AS BIGINT) AS hits FROM b_f WHERE k = len(ref_))"
_T_SUM = "t AS (SELECT CAST(sum(len(oe)) AS BIGINT) AS n_seg, CAST(sum(len(ie)) AS BIGINT) AS n_ref, CAST(sum(hits) AS BIGINT) AS hits FROM t_f WHERE k = len(oe))"
_PRF = "{0}s AS (SELECT *, CASE WHEN hits = 0 THEN 0.0::DOUBLE ELSE hits / n_seg END AS p, CASE WHEN hits = 0 THEN 0.0::DOUBLE ELSE hits / n_ref END AS r FROM {0})"
_F1 = "CASE WHEN {0}.hits = 0 THEN 0 ELSE 2 * {0}.p * {0}.r / ({0}.p + {0}.r) END"


def _recursive(select: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",".join([timeline.SQL, _SPOKEN, _BOUND, *more]) + select


SQL = {
    "boundary_metrics": _recursive(f"""
SELECT round(bs.p, 4) AS precision, round(bs.r, 4) AS recall, round({_F1.format('bs')}, 4) AS f1, round(bs.r / bs.p - 1, 4) AS os,
       round(1 - (sqrt((1 - bs.r) ** 2 + (bs.r / bs.p - 1) ** 2) + abs((1 - bs.r / bs.p + bs.r - 1) / sqrt(2.0))) / 2, 4) AS r_value,
       round(ts.p, 4) AS token_precision, round(ts.r, 4) AS token_recall, round({_F1.format('ts')}, 4) AS token_f1
FROM bs, ts""", _B_FOLD, _B_SUM, _PRF.format("b"), _T_FOLD, _T_SUM, _PRF.format("t")),
    "token_boundary_metrics": _recursive(" SELECT n_seg, n_ref, hits AS n_hit FROM t", _T_FOLD, _T_SUM),
    "clustering_metrics": _tl(
        """
SELECT round(pacc, 9) AS pacc, round(ipacc, 9) AS ipacc, round(CASE WHEN pacc + ipacc = 0 THEN 0 ELSE 2 * pacc * ipacc / (pacc + ipacc) END, 9) AS f1_pacc,
       round(wnes, 9) AS wnes, round(iwnes, 9) AS iwnes, round(CASE WHEN wnes + iwnes = 0 THEN 0 ELSE 2 * wnes * iwnes / (wnes + iwnes) END, 9) AS f1_wnes, card.*
FROM pacc, ipacc, wnes, iwnes, card""", _PACC, _IPACC, _WNES, _IWNES, _CARD),
    "pacc": _tl("SELECT round(pacc, 9) AS pacc FROM pacc", _PACC),
    "ipacc": _tl("SELECT round(ipacc, 9) AS ipacc FROM ipacc", _IPACC),
    "wnes": _tl("SELECT round(wnes, 9) AS wnes FROM wnes", _WNES),
    "iwnes": _tl("SELECT round(iwnes, 9) AS iwnes FROM iwnes", _IWNES),
    "eval_cardinalities": _tl("SELECT * FROM card", _CARD),
    "durations_to_intervals": _tl("SELECT utt, idx, CAST(fin - d AS BIGINT) AS start, CAST(fin AS BIGINT) AS \"end\", CAST(0 AS BIGINT) AS unit_id FROM (SELECT utt, idx, r_end - r_start AS d, sum(r_end - r_start) OVER (PARTITION BY utt ORDER BY idx) AS fin FROM gold)"),
    "unit_table": _tl("""
SELECT utt, row_number() OVER (PARTITION BY utt ORDER BY idx) - 1 AS seg_idx, CAST(fin - d AS BIGINT) AS start, CAST(fin AS BIGINT) AS "end", CAST(length(text) AS BIGINT) AS unit_id
FROM (SELECT utt, idx, text, r_end - r_start AS d, sum(r_end - r_start) OVER (PARTITION BY utt ORDER BY idx) AS fin FROM gold WHERE text <> 'sil')"""),
    "frames_to_time": _tl("SELECT utt, seg_idx, (e // 2) / 50.0::DOUBLE AS seconds, CAST(floor((e // 2) * 16000 / 50) AS BIGINT) AS sample, round((e // 2) / 50.0::DOUBLE + 0.5, 2) AS shifted FROM seg"),
    "clean_tokens": _tl("SELECT utt, coalesce(string_agg(regexp_replace(text, '[0-9]', '', 'g'), ' ' ORDER BY r_start, idx) FILTER (WHERE lower(text) NOT IN ('sil', 'spn', 'sp', '<unk>', '')), '') AS phones FROM gold GROUP BY utt"),
    "overlap_predicate": _tl("SELECT ov.utt, ov.seg_idx, ov.idx, hit.idx IS NOT NULL AS counts FROM ov LEFT JOIN hit ON ov.utt = hit.utt AND ov.seg_idx = hit.seg_idx AND ov.idx = hit.idx"),
    "interval_overlap_join": _tl("SELECT utt, seg_idx, cluster, phones FROM lab"),
    "edit_distance": _tl("SELECT utt, seg_idx, levenshtein(code, b) AS distance FROM (SELECT *, lag(code) OVER (PARTITION BY utt ORDER BY seg_idx) AS b FROM lab) WHERE b IS NOT NULL"),
    "norm_edit_distance": _tl("SELECT utt, seg_idx, round(levenshtein(code, b) / greatest(length(code), length(b))::DOUBLE, 9) AS distance FROM (SELECT *, lag(code) OVER (PARTITION BY utt ORDER BY seg_idx) AS b FROM lab) WHERE b IS NOT NULL"),
    "phone_ngrams": _tl('SELECT CAST("order" AS INTEGER) AS "order", gram, n FROM ng', _GRAMS),
    "zipf_phone_ngrams": _tl('SELECT CAST("order" AS INTEGER) AS "order", gram AS name, n, row_number() OVER (PARTITION BY "order" ORDER BY n DESC, gram) AS rank, round(n / sum(n) OVER (PARTITION BY "order"), 9) AS probability FROM ng', _GRAMS),
    "zipf_clusters": _tl(_ZC),
    "zipf_phone_sequences": _tl(_ZS),
    "zipf_comparison": _tl(f"SELECT *, 'K-means' AS method FROM ({_ZC}) UNION ALL SELECT *, 'Phone sequences' FROM ({_ZS})"),
    "top_clusters": _tl("SELECT cluster, n FROM (SELECT cluster, count(*) AS n, min(struct_pack(utt, seg_idx)) AS f FROM seg GROUP BY cluster) ORDER BY n DESC, f LIMIT 5"),
    "examples_per_cluster": _tl("SELECT cluster, rn, utt, seg_idx, (s // 2) * 320 AS first_sample, (e // 2) * 320 AS end_sample FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY utt, seg_idx) AS rn FROM seg) WHERE rn <= 3"),
    "speech_islands": _tl("SELECT utt, island, min(r_start) AS onset, max(r_end) AS \"offset\", count(*) AS n FROM isl GROUP BY utt, island", _SPOKEN),
    "token_intervals": _tl("SELECT utt, island, idx, CAST(lag(r_end, 1, 0) OVER (PARTITION BY utt, island ORDER BY r_start, idx) AS BIGINT) AS token_start, r_end AS token_end FROM isl", _SPOKEN),
    "boundary_prf": """
WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS s, count(*) FILTER (WHERE event_type = 'view') AS r, count(*) FILTER (WHERE event_type = 'purchase') AS k FROM events GROUP BY user_id),
h AS (SELECT *, least(s, r, k) AS h FROM c),
p AS (SELECT user_id, s + r = 0 AS none, h, CASE WHEN h = 0 THEN 0.0::DOUBLE ELSE h / s END AS p, CASE WHEN h = 0 THEN 0.0::DOUBLE ELSE h / r END AS r FROM h),
o AS (SELECT *, CASE WHEN p = 0 THEN NULL ELSE r / p - 1 END AS os FROM p)
SELECT user_id, round(p, 9) AS precision, round(r, 9) AS recall, CASE WHEN none THEN NULL WHEN h = 0 THEN 0 ELSE round(2 * p * r / (p + r), 9) END AS f1, round(os, 9) AS os,
       round(1 - (abs(sqrt((1 - r) * (1 - r) + os * os)) + abs((-os + r - 1) / sqrt(2.0))) / 2, 9) AS r_value FROM o""",
    "pair_by_stem": "SELECT d.doc_id, lang, n_chars, quality, toxic FROM documents d JOIN (SELECT doc_id, x.quality AS quality, x.toxic AS toxic FROM (SELECT doc_id, max(struct_pack(quality, toxic)) AS x FROM labels GROUP BY doc_id)) l ON d.doc_id = l.doc_id",
    "missing_refs": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "pair_strict": _tl("SELECT a.utt, n_segments, n_gold FROM (SELECT utt, count(*) AS n_segments FROM seg GROUP BY utt) a JOIN (SELECT utt, count(*) AS n_gold FROM gold GROUP BY utt) b ON a.utt = b.utt"),
    "features_segments_join": "SELECT conv_id AS utt, turn AS seg_idx, length(text) AS size, CAST(sum(length(text)) OVER w - length(text) AS BIGINT) AS start, CAST(sum(length(text)) OVER w AS BIGINT) AS \"end\" FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "global_row_id": "SELECT 'c/' || conv_id AS file, turn, row_number() OVER (ORDER BY CAST(conv_id AS VARCHAR), turn) - 1 AS row_id FROM conversations",
    "union_runs": _tl("SELECT 'grid' AS run, cluster, count(*) AS n, count(utt) AS n_utt FROM seg GROUP BY cluster UNION ALL SELECT 'vectors', CAST(label AS BIGINT), count(*), CAST(0 AS BIGINT) FROM embeddings GROUP BY label"),
}
