"""Quality by importance resampling.

Two generative models of hashed word 1- and 2-grams, one of target text
(documents labelled as good) and one of raw text (all documents), give each
document the log weight

    sum over its n-grams of log p_target(bucket) - log p_raw(bucket).

Adding Gumbel noise and taking the top k draws k documents without replacement
in proportion to their weights. Noise comes from the document's id, so a rerun
draws the same sample.

Raw counts cover all documents; target counts cover :data:`MAX_TARGET` labelled
documents at most (those whose hashed id is smallest). A task adds up its own
counts, so :data:`BUCKETS` rows a task are shuffled. The k-th key is found exactly by
counting keys in ever narrower ranges, not by a global sort.

Defined results: null or empty text has no n-grams and log weight 0; rows that
tie with the k-th key are all drawn, so repeated rows are drawn together;
without target documents all log weights are 0; an empty table gives an empty
table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lectern.llm import vector
from lectern.llm.common import durable, rows

BUCKETS, MAX_TARGET = 10_000, 4000
#: The share of documents drawn.
FRACTION = 0.85
#: Keys left in a range are collected and sorted once they are this few.
FEW = 4096
_SEED = np.uint64(0x5DEECE66D1234567)


def buckets(column) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every 1- and 2-gram and the text it stands in."""
    w = vector.words(column)
    text = np.repeat(np.arange(len(w.bounds) - 1), w.counts)
    pair = np.flatnonzero(text[1:] == text[:-1]) if len(text) else text
    two = vector.mix(w.hashes[pair] ^ vector.mix(w.hashes[pair + 1] + np.uint64(1)))
    h = np.concatenate((w.hashes, two)) % np.uint64(BUCKETS)
    return h.astype(np.int64), np.concatenate((text, text[pair]))


def id_number(df: DataFrame) -> Column:
    """A whole number for an id of any type: itself, or the 64-bit hash of what is none."""
    return F.col("doc_id").cast("long") if isinstance(df.schema["doc_id"].dataType, IntegralType) else F.xxhash64("doc_id")


def target_ids(labels: DataFrame) -> np.ndarray:
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    few = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TARGET).select(id_number(labels).alias("n")).collect()
    return np.sort(np.array([r["n"] for r in few], np.int64))


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Per bucket, log p_target - log p_raw."""
    shared = docs.sparkSession.sparkContext.broadcast(target_ids(labels))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in vector.slices(batches, 1):
            h, text = buckets(batch.column(1))
            total[0] += np.bincount(h, minlength=BUCKETS)
            good = np.isin(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), shared.value) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            total[1] += np.bincount(h[good[text]], minlength=BUCKETS) if len(h) else 0
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], ["bucket", "raw", "target"])

    src = rows(docs)
    known = F.when(F.col("doc_id").isNotNull(), id_number(src))
    summed = src.select(known.alias("n"), "text").mapInArrow(count, "bucket long, raw long, target long")
    out = np.zeros((2, BUCKETS))
    for r in summed.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        out[:, r["bucket"]] = r["raw"], r["target"]
    raw, target = out + 1  # every bucket was seen once more
    return np.log(target / target.sum()) - np.log(raw / raw.sum()) if out[1].any() else np.zeros(BUCKETS)


def weigh(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, n_grams, log_weight, key)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vector.slices(batches, 1):
            h, text = buckets(batch.column(1))
            n = np.bincount(text, minlength=batch.num_rows)
            weight = np.bincount(text, weights=shared.value[h], minlength=batch.num_rows)
            ids = batch.column(2).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            u = ((vector.mix(ids.view(np.uint64) ^ _SEED) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(weight, pa.float64()), pa.array(weight - np.log(-np.log(u)), pa.float64())], ["doc_id", "n_grams", "log_weight", "key"])

    src = rows(docs)
    src = src.select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), id_number(src)).alias("n"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_grams long, log_weight double, key double")


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The exact k-th largest value of a double column; 1024 counts at a time reach the driver."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    while True:
        part = df.where(F.col(column).between(low, high))
        width = (high - low) / 1024
        n = part.count()
        if n <= FEW or width <= 0 or low + width == low:
            # few keys, or all equal but for the last digits
            values = part.groupBy(column).count().orderBy(F.desc(column)).limit(FEW).collect()
            for r in values:
                k -= r["count"]
                if k <= 0:
                    return r[column]
            return low
        place = F.least(F.floor((F.col(column) - low) / width), F.lit(1023)).cast("int")
        found = part.groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.desc("b")).collect()
        for r in found:
            if k <= r["n"]:
                low, high = r["lo"], r["hi"]
                break
            k -= r["n"]


def resample(docs: DataFrame, labels: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """Every document with its log weight, key and whether it is drawn (``kept``)."""
    scored = durable(weigh(docs, fit(docs, labels)), "quality-keys")
    n = scored.count()
    if not n:
        return scored.withColumn("kept", F.lit(True))
    cut = kth_largest(scored, "key", max(1, math.ceil(fraction * n)))
    return scored.withColumn("kept", F.col("key") >= cut)
