"""Line dedup by winnowing over line hashes, with DataFrame functions only.

A document's non-blank lines (trimmed of spaces) are hashed. A window is the shortest run of lines from a line on, or back from
a line, that has ``LEAST_WORDS`` words. Of each window the line of smallest hash (the first of equal ones) is selected: a
fingerprint, which it keeps with the windows that selected it. Any two runs of equal lines with that many words share a
window, and so a selected line at the same place in it: the fingerprints are a guaranteed sample, with fewer than one a line.

Fingerprints that stand at one place only can be in no repeat and go no further, with all their windows. Positions of the
others are joined: each window of a fingerprint, told by the hash of all its lines, with the first place in (doc_id,
text, place) order where the fingerprint has that window. All later ones are matches. A match is extended both ways by those
that overlap it: each line of a repeated run is in a window inside the run, from a line on or back from one, so the
windows that match make up the run as far as it is equal. Runs that come later are deleted; shorter repeats, such as a common one-line
footer, stay.

Each occurrence meets the first one only, never every other. Firsts are found with partial aggregates and written as a table,
so a passage that a third of all documents hold is a plain join that can be split. Windows are computed within one document.

Defined results: null texts stay null with no lines; empty texts stay empty; blank lines are never deleted; rows that are equal
in doc_id and text are one document for the search, and each gets the same result (so a repeated row is no repeat of itself,
but equal texts under different ids are); null doc_ids come first in the order; of texts that tie in doc_id the one of
smaller hash is the first; texts of any length are searched whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unitloom.storage import materialize

LEAST_WORDS = 50
_ROW = ("__id", "__text")
_KEY = ("line", "whole", "n")


def _lines(docs: DataFrame) -> DataFrame:
    """(__id, __text, no, line, words) of the non-blank lines, dealt by document; __text is the hash of the whole text."""
    every = docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__text"), F.col("text").alias("__whole")).where("__whole is not null")
    lines = every.select(*_ROW, F.posexplode(F.split("__whole", "\n")).alias("no", "raw")).withColumn("raw", F.trim("raw")).where("raw <> ''")
    lines = lines.select(*_ROW, "no", F.struct(F.xxhash64("raw").alias("a"), F.crc32(F.col("raw").cast("binary")).alias("b")).alias("line"), (F.length("raw") - F.length(F.replace("raw", F.lit(" "), F.lit(""))) + 1).cast("long").alias("words"))
    return lines.repartition(*_ROW).dropDuplicates([*_ROW, "no"])


def fingerprints(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(__id, __text, at, line, windows): the selected lines and the windows (first, last, n, whole) that selected each."""
    order = Window.partitionBy(*_ROW).orderBy("no")
    placed = _lines(docs).withColumn("end", F.sum("words").over(order)).withColumn("start", F.col("end") - F.col("words"))
    ahead = Window.partitionBy(*_ROW).orderBy("start").rangeBetween(0, least - 1)
    back = Window.partitionBy(*_ROW).orderBy("end").rangeBetween(1 - least, 0)
    item = F.struct("no", "line", "words")
    runs = placed.select(*_ROW, "words", F.collect_list(item).over(ahead).alias("x"), F.collect_list(item).over(back).alias("y"))
    size = lambda run: F.aggregate(run, F.lit(0).cast("long"), lambda n, x: n + x["words"])
    # a run back that has too few words without its last line is the run on from its first line
    both = F.filter(F.array(F.when(size("x") >= least, F.col("x")), F.when(size("y") - F.col("words") >= least, F.col("y"))), lambda run: run.isNotNull())
    full = runs.select(*_ROW, F.explode(both).alias("run"))
    chosen = F.array_min(F.transform("run", lambda x: F.struct(x["line"].alias("line"), x["no"].alias("no"))))
    window = F.struct(F.element_at("run.no", 1).alias("first"), F.element_at("run.no", -1).alias("last"), F.size("run").alias("n"), F.xxhash64("run.line").alias("whole"))
    picked = full.select(*_ROW, chosen.alias("chosen"), window.alias("window"))
    return picked.groupBy(*_ROW, F.col("chosen.no").alias("at"), F.col("chosen.line").alias("line")).agg(F.collect_list("window").alias("windows"))


def repeats(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(__id, __text, spans): the first and last lines of the windows to delete, one row for each document that has any."""
    prints = materialize(fingerprints(docs, least), "fingerprints")
    place = F.struct(*_ROW, "at")
    common = materialize(prints.groupBy("line").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("line"), "common")
    joined = prints.join(common, "line").select(*_ROW, "line", F.explode("windows").alias("w"))
    windows = materialize(joined.select(*_ROW, "line", "w.whole", "w.n", "w.first", "w.last"), "windows")
    place = F.struct(*_ROW, "first")
    shared = windows.groupBy(*_KEY).agg(F.min(place).alias("origin"), F.max(place).alias("latest")).where("origin <> latest").select(*_KEY, "origin")
    later = windows.join(materialize(shared, "shared"), list(_KEY)).where(~place.eqNullSafe(F.col("origin")))
    return later.groupBy(*_ROW).agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def dedup_lines(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_removed, text), one row for each row of docs; text without the deleted lines."""
    found = repeats(docs, least).select(F.col("__id").alias("__i"), F.col("__text").alias("__t"), "spans")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("__text"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("__text") == F.col("__t")), "left")
    lines = F.split("text", "\n")
    inside = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["last"]))))
    gone = F.filter(inside, lambda k: F.trim(F.get(lines, k)) != "")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    return joined.withColumn("gone", F.when(F.col("spans").isNotNull(), gone)).select(
        "doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda k: F.get(lines, k)), "\n")).alias("text"),
    )


SQL = """
WITH raw AS (
  SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL
), parts AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM raw
), numbered AS (
  SELECT doc_id, text, unnest(lines) AS line, unnest(range(len(lines))) AS no FROM parts
), l AS (
  SELECT doc_id, text, no, trim(line, ' ') AS line, length(trim(line, ' ')) - length(replace(trim(line, ' '), ' ', '')) + 1 AS words FROM numbered WHERE trim(line, ' ') <> ''
), p AS (
  SELECT *, CAST(sum(words) OVER (PARTITION BY doc_id, text ORDER BY no) AS BIGINT) AS fin FROM l
), q AS (SELECT *, fin - words AS st FROM p),
w AS (
  SELECT doc_id, text, list(line) OVER f AS run, list(no) OVER f AS nos, sum(words) OVER f AS n FROM q WINDOW f AS (PARTITION BY doc_id, text ORDER BY st RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION ALL
  SELECT doc_id, text, list(line) OVER g, list(no) OVER g, sum(words) OVER g FROM q WINDOW g AS (PARTITION BY doc_id, text ORDER BY fin RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)
), full_ AS (SELECT doc_id, text, array_to_string(run, chr(10)) AS k, nos FROM w WHERE n >= 50),
firsts AS (SELECT k, min(doc_id) AS d FROM full_ GROUP BY k),
later AS (
  SELECT DISTINCT x.doc_id, x.text, unnest(x.nos) AS no
  FROM full_ x JOIN firsts f ON x.k = f.k
  WHERE x.doc_id <> f.d OR x.nos[1] <> (SELECT min(y.nos[1]) FROM full_ y WHERE y.k = x.k AND y.doc_id = f.d)
), cut AS (
  SELECT n.doc_id, n.text, count(l2.no) AS n_removed, coalesce(string_agg(n.line, chr(10) ORDER BY n.no) FILTER (WHERE l2.no IS NULL), '') AS left_
  FROM numbered n LEFT JOIN later l2 ON n.doc_id = l2.doc_id AND n.text = l2.text AND n.no = l2.no GROUP BY n.doc_id, n.text
)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, left_ AS text
FROM documents d LEFT JOIN cut ON d.doc_id = cut.doc_id AND d.text = cut.text
"""
