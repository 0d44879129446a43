"""Quality rules: documents are kept or rejected by base counts and by a log-likelihood ratio of hashed n-grams.

Two multinomials over hash slots of byte n-grams are counted, one over trusted documents and one over the whole corpus.
A document's score is the mean over its n-grams of the logarithm of their ratio, so its length plays no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .arrays import joined, lean, mix, pieces, powers, ranges, span_hashes, starts_of, total, word_spans
from .exchange import summed

SLOTS = 1 << 16
ORDER = 4
SYMBOLS = b"#*$%&|<>"
#: Rejected below this score: on average each n-gram is less likely in trusted text by a factor of exp(0.5).
THRESHOLD = -0.5


def slots_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash slot of the n-gram at each byte, and the first and end of each document's n-grams."""
    if len(data) < ORDER:
        return np.zeros(0, np.int64), start * 0, start * 0
    g = data[: len(data) - ORDER + 1].astype(np.uint32)
    for i in range(1, ORDER):
        g |= data[i : len(data) - ORDER + 1 + i].astype(np.uint32) << np.uint32(8 * i)
    return ((g * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64), start, np.maximum(start, end - ORDER + 1)


def fit(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The logarithm of the ratio of both multinomials for each slot. trusted: ids in its first column, all of which count."""
    rows = docs.select(F.col(id_col).alias("trusted_id"), F.col(text_col).cast("string").alias("text"))
    ids = trusted.toDF("trusted_id").where("trusted_id is not null").distinct()
    # both sides are dealt by id; only ids are held in memory, and texts aren't sorted
    known = rows.where("trusted_id is not null").join(ids.hint("shuffle_hash"), "trusted_id", "left_semi")
    marked = rows.select("text", F.lit(False).alias("mark")).unionByName(known.select("text", F.lit(True).alias("mark")))

    def count(batch) -> np.ndarray:
        data, start, end = joined(batch.column(0))
        slot, a, b = slots_of(data, start, end)
        mark = np.asarray(batch.column(1)).astype(bool)
        of = lambda on: np.bincount(slot[ranges(a[on], b[on] - a[on])], minlength=SLOTS)
        return np.concatenate([of(~mark), of(mark)])

    n = summed(marked, count, 2 * SLOTS).astype(float)
    raw, target = n[:SLOTS], n[SLOTS:]
    if not target.sum():
        return np.zeros(SLOTS, np.float32)
    return (np.log((target + 0.5) / (target.sum() + 0.5 * SLOTS)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * SLOTS))).astype(np.float32)


def measure(col, ratio: np.ndarray) -> dict:
    """Base counts and score of each text."""
    lean()
    data, start, end = joined(col)
    rows = np.arange(len(start))
    first, last = word_spans(data)
    lo, hi = np.searchsorted(first, start), np.searchsorted(first, end)
    table = np.ones(256, bool)
    table[0x80:0xC0] = False
    table[[32, 9, 10, 11, 12, 13]] = False
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out = {"n_words": hi - lo, "word_chars": total(table[data], start, end), "n_symbols": total(symbol[data], start, end)}
    # lines: every text ends with a line feed here, which parts no two of its lines
    feed = np.flatnonzero(data == 10)
    begin = np.concatenate([[0], feed[:-1] + 1]) if len(feed) else feed
    wordy = np.searchsorted(first, feed) > np.searchsorted(first, begin)
    begin, close = begin[wordy], feed[wordy]
    owner, h = np.searchsorted(end, begin, "left"), span_hashes(data, begin, close)
    by = np.lexsort((h, owner))
    new = starts_of(owner[by], h[by])
    out["n_dup_lines"] = np.bincount(owner[by][~new], minlength=len(rows))
    # 8-word windows
    words = span_hashes(data, first, last)
    n = np.maximum(hi - lo - 7, 0)
    at, owner = ranges(lo, n), np.repeat(rows, n)
    pw = powers(9)[0]
    h = words[at] * pw[1]
    for j in range(1, 8):
        h += words[at + j] * pw[j + 1]
    h = mix(h)
    by = np.argsort(h, kind="stable")
    by = by[np.argsort(owner[by].astype(np.uint16) if len(rows) < 1 << 16 else owner[by], kind="stable")]
    new = starts_of(owner[by], h[by])
    twice = ~new
    twice[:-1] |= ~new[1:]
    hit = np.sort(by[twice])
    place, owner = at[hit], owner[hit]
    reach = np.full(len(hit), 8)
    near = owner[1:] == owner[:-1]
    reach[:-1] = np.where(near, np.minimum(8, place[1:] - place[:-1]), 8)
    out["n_repeat_words"] = np.bincount(owner, weights=reach, minlength=len(rows)).astype(np.int64)
    slot, a, b = slots_of(data, start, end)
    value = np.zeros(len(slot) + 1)
    np.cumsum(ratio[slot], out=value[1:], dtype=np.float64)
    out["score"] = np.where(b > a, (value[b] - value[a]) / np.maximum(b - a, 1), 0.0)
    return out


FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality_rules(docs: DataFrame, ratio: np.ndarray, text_col: str = "text", threshold: float = THRESHOLD, min_words: int = 20, repeat_percent: int = 30) -> DataFrame:
    """All columns of docs (but those named like a result's), the base counts, base_failed, score and kept.

    ratio: as fit() gives it. A document fails the base if it has fewer words than min_words or more than repeat_percent
    of its words lie in 8-word windows that it holds twice; it's kept if it doesn't and its score is at least threshold.
    A null or empty text has no words and so fails; a text shorter than an n-gram scores 0. Each row is judged alone, so
    repeated rows and null ids change nothing.
    """
    names = [*FIELDS, "score"]
    rest = [c for c in docs.columns if c not in (*names, "base_failed", "kept")]
    at = rest.index(text_col)
    frame = docs.select(*rest).withColumn(text_col, F.col(text_col).cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def each(batches):
        for batch in batches:
            for part in pieces(batch, at):
                m = measure(part.column(at), shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(m[k]) for k in names)], names=[*rest, *names])

    schema = StructType([*frame.schema, *(StructField(k, LongType()) for k in FIELDS), StructField("score", DoubleType())])
    out = frame.mapInArrow(each, schema)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
