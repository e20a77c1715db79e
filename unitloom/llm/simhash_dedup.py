"""SimHash near-dedup by Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into segments of 22, 21 and 21 bits. If two fingerprints differ in two bits or
fewer, some segment has no error, and the segment after it has two errors at most; two such words share a nearby
Golay codeword (see `golay.nearby_indices`). So each fingerprint gets, for each segment, keys of that exact
segment with each nearby codeword index of the next: about 16 keys, and every linked pair meets under one of them.

Only distinct fingerprints are keyed, and a fingerprint is its own node in the graph of links, so rows without a doc_id
take part like all others. In a bucket of at most ``SMALL_BUCKET`` fingerprints all are compared. A larger bucket
(variants of one text) goes an exact way whose cost is linear: two fingerprints differ in two bits or fewer exactly if they
share a word within one bit of both, so each fingerprint is filed under its 65 words and linked to the smallest
fingerprint filed there. Both ways find the same groups; nothing is capped or dropped.

Defined results: null, empty and blank texts have fingerprint zero, and texts of any length are hashed whole; rows that
share a doc_id are one document, so their fingerprints link; a row without a doc_id gets the component_id of its group, null
if no row there has one. Repeated rows give repeated result rows, an empty table none. Other columns are ignored, except
that `keep_one` returns them and tells rows apart by them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitloom.llm.golay import nearby_indices
from unitloom.operators.graph import connected_components
from unitloom.storage import materialize

SHINGLE, MAX_BITS, SMALL_BUCKET, SEED = 3, 2, 48, 42
#: Lowest bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
_CHUNK = 20_000


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a UTF-8 text: bit set if it is set in over half of the shingles' XXH64 values."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = ends - np.fromiter(map(len, words), dtype=np.int64, count=len(words)) - 1
    stops = ends[min(size, len(words)) - 1 :] - 1
    h = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    spans = list(zip(starts[:n].tolist(), stops[:n].tolist(), strict=True))
    for i in range(0, n, _CHUNK):
        part = np.array([h(joined[a:b], seed) for a, b in spans[i : i + _CHUNK]], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((ones * 2 > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, size: int = SHINGLE, row: tuple[Column, Column] | None = None) -> DataFrame:
    """(doc_id, fp) and, if ``row`` is given, (r1, r2), two hashes of the row: fp is the signed 64-bit fingerprint."""
    own = ["doc_id", *(["r1", "r2"] if row else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", size) for t in b.column("text")), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(fps.view(np.int64))], [*own, "fp"])

    hashes = [c.alias(name) for c, name in zip(row or (), own[1:], strict=True)]
    schema = ", ".join(f"{c} long" for c in [*own, "fp"])
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), *hashes).mapInArrow(run, schema)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp) for each key of each fingerprint."""
    for whole in batches:
        for at in range(0, whole.num_rows, _CHUNK):
            fp = whole.column(0).slice(at, _CHUNK).to_numpy(zero_copy_only=False)
            words = [(fp.view(np.uint64) >> np.uint64(low)).astype(np.int64) & ((1 << width) - 1) for low, width in SEGMENTS]
            for k in range(3):
                index, fresh = nearby_indices(words[(k + 1) % 3])
                row, col = np.nonzero(fresh)
                key = (np.int64(k) << 40) | (words[k][row] << 12) | index[row, col]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["key", "fp"])


def links(fps: DataFrame) -> DataFrame:
    """(src, dst) edges whose components are those of all links; fps: (fp), one row a fingerprint."""
    keys = materialize(fps.select("fp").mapInArrow(_keys, "key long, fp long"), "golay-keys")
    sizes = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "golay-sizes")
    small = keys.join(sizes.where(F.col("n") <= SMALL_BUCKET).select("key"), "key")
    a, b = small.select("key", F.col("fp").alias("src")), small.select("key", F.col("fp").alias("dst"))
    close = F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= MAX_BITS
    pairs = a.join(b, (a["key"] == b["key"]) & (F.col("src") < F.col("dst")) & close).select("src", "dst")
    large = keys.join(sizes.where(F.col("n") > SMALL_BUCKET).select("key"), "key", "left_semi").select("fp").distinct()
    around = F.explode(F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))))
    filed = large.select("fp", around.alias("word"))
    hubs = filed.groupBy("word").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = filed.join(hubs, "word").where("fp <> hub").select(F.col("hub").alias("src"), F.col("fp").alias("dst"))
    return pairs.unionByName(stars).distinct()


def _grouped(fps: DataFrame) -> DataFrame:
    """(fp, root): the group of each fingerprint of the written table fps, named by its smallest fingerprint."""
    classes = materialize(fps.select("fp").distinct(), "classes")
    # the fingerprints of a document given in several texts are linked by its id
    several = fps.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("src"), F.max("fp").alias("b")).where("src <> b").drop("b")
    own = fps.join(several, "doc_id").select("src", F.col("fp").alias("dst")).distinct()
    parts = connected_components(links(classes).unionByName(own))
    return materialize(classes.join(parts, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("root")), "groups")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of docs."""
    fps = materialize(fingerprints(docs), "fingerprints")
    groups = _grouped(fps).join(fps.groupBy(F.col("fp").alias("f")).agg(F.min("doc_id").alias("least")), F.col("fp") == F.col("f"))
    first = groups.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    named = materialize(groups.join(first, F.col("root") == F.col("r")).select("fp", "component_id"), "named")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: the smallest doc_id (null last), and of rows that share it the one of smallest hash
    over all columns, so that runs agree. A group without any doc_id keeps a row too."""
    columns = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    hashes = (F.xxhash64(F.lit(1), *columns), F.xxhash64(F.lit(2), *columns))
    fps = materialize(fingerprints(docs, row=hashes), "fingerprints")
    first = fps.groupBy(F.col("fp").alias("f")).agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "r1", "r2")).alias("row"))
    best = _grouped(fps).join(first, F.col("fp") == F.col("f")).groupBy("root").agg(F.min("row").alias("row"))
    stay = best.select(F.col("row.r1").alias("__k1"), F.col("row.r2").alias("__k2"))
    marked = docs.withColumns({"__r1": hashes[0], "__r2": hashes[1]})
    # the join and the removal of repeated rows share one exchange
    return marked.join(stay, (F.col("__r1") == F.col("__k1")) & (F.col("__r2") == F.col("__k2")), "left_semi").dropDuplicates(["__r1", "__r2"]).drop("__r1", "__r2")
