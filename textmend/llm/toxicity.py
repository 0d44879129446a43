"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy.

A word's input is a hashed word vector and the mean vector of its hashed character n-grams. The network reads windows of
words that overlap and cover the whole text; the window with the highest score gives the document's. Training knows
labels of documents only: of a toxic document the window that scores highest counts as toxic, of a clean one all do as
clean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .arrays import U, joined, lean, lower_ascii, mix, pieces, ranges, span_hashes, word_spans

WINDOW, STRIDE = 32, 24  # words
HIDDEN, INPUT = 8, 8
SLOTS = 1 << 15
GRAMS = (3, 4, 5)
#: Training sees at most so many labelled documents of class 0 and of class 1, those with the smallest hashes of their ids,
#: and of each at most so many windows, evenly spread.
MOST_DOCS, MOST_WINDOWS = (1000, 600), 64
EPOCHS, RATE, SEED = 24, 0.03, 7


def word_inputs(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple:
    """For each word its slot, and the slots of its character n-grams with the word each belongs to."""
    word = (span_hashes(data, first, end) & U(SLOTS - 1)).astype(np.int64)
    size = end - first
    # words with a mark at each end, one after the other
    n = size + 2
    off = np.cumsum(n) - n
    text = np.zeros(int(n.sum()), np.uint8)
    text[off] = 2
    text[off + n - 1] = 3
    text[ranges(off + 1, size)] = data[ranges(first, size)]
    slots, owner = [], []
    for g in GRAMS:
        m = np.maximum(n - g + 1, 0)
        at = ranges(off, m)
        h = np.full(len(at), g, U)
        for j in range(g):
            h = h * U(0x100000001B3) + text[at + j]
        slots.append((mix(h) >> U(40)).astype(np.int64) & (SLOTS - 1))
        owner.append(np.repeat(np.arange(len(n)), m))
    slots, owner = np.concatenate(slots), np.concatenate(owner)
    by = np.argsort(owner, kind="stable")
    return word, slots[by], owner[by]


def word_vectors(p: dict, word: np.ndarray, slots: np.ndarray, owner: np.ndarray) -> np.ndarray:
    count = np.bincount(owner, minlength=len(word)).astype(np.float32)
    chars = np.zeros((len(word), INPUT), np.float32)
    if len(slots):
        have = np.flatnonzero(count)
        at = (np.cumsum(count) - count).astype(np.int64)[have]
        chars[have] = np.add.reduceat(p["chars"][slots], at, axis=0) / np.sqrt(count[have])[:, None]
    return np.concatenate([p["words"][word], chars], axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def run_gru(x: np.ndarray, index: np.ndarray, mask: np.ndarray, u: np.ndarray, backward: bool, keep: bool) -> tuple[np.ndarray, list]:
    """x: gate inputs of each different word (update, reset, candidate); index: windows of words; u: recurrent weights."""
    n, t = index.shape
    h = np.zeros((n, HIDDEN), np.float32)
    out = np.zeros((t, n, HIDDEN), np.float32)
    saved = [None] * t
    for i in range(t - 1, -1, -1) if backward else range(t):
        a = x[index[:, i]]
        b = h @ u
        zr = sigmoid(a[:, : 2 * HIDDEN] + b[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(a[:, 2 * HIDDEN :] + r * b[:, 2 * HIDDEN :])
        new = c + z * (h - c)
        if keep:
            saved[i] = (h, z, r, c, b[:, 2 * HIDDEN :])
        h = new if mask is None else np.where(mask[:, i, None], new, h)
        out[i] = h
    return out, saved


def gate_inputs(p: dict, vectors: np.ndarray) -> list:
    return [vectors @ p["w" + d] + p["b" + d] for d in "fb"]


def forward(p: dict, xs: list, index: np.ndarray, mask: np.ndarray | None, keep: bool = False) -> tuple:
    """Logit of each window. xs: gate_inputs of the different words."""
    (hf, sf), (hb, sb) = (run_gru(x, index, mask, p["u" + d], d == "b", keep) for x, d in zip(xs, "fb"))
    h = np.concatenate([hf, hb], axis=2)
    e = np.tanh(h @ p["wa"])
    s = e @ p["va"]
    if mask is not None:
        s = np.where(mask.T, s, np.float32(-1e9))
    s = np.exp(s - s.max(axis=0))
    a = s / s.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", a, h)
    if mask is not None:
        pooled = np.where(mask.any(axis=1)[:, None], pooled, 0)
    logit = pooled @ p["wo"] + p["bo"]
    return logit, (h, e, a, pooled, sf, sb)


def backward(p: dict, vectors: np.ndarray, index: np.ndarray, mask: np.ndarray, saved: tuple, error: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the parameters and of the word vectors."""
    h, e, a, pooled, sf, sb = saved
    g = {"wo": pooled.T @ error, "bo": np.array([error.sum()], np.float32)}
    dp = error[:, None] * p["wo"]
    dh = a[:, :, None] * dp
    da = np.einsum("tnh,nh->tn", h, dp)
    ds = a * (da - (a * da).sum(axis=0))
    g["va"] = np.einsum("tnk,tn->k", e, ds)
    de = ds[:, :, None] * p["va"] * (1 - e * e)
    g["wa"] = np.einsum("tnh,tnk->hk", h, de)
    dh += de @ p["wa"].T
    dv = np.zeros_like(vectors)
    t = index.shape[1]
    for d, states, part in (("f", sf, dh[:, :, :HIDDEN]), ("b", sb, dh[:, :, HIDDEN:])):
        u = p["u" + d]
        gu, dx = np.zeros_like(u), np.zeros((len(vectors), 3 * HIDDEN), np.float32)
        back = np.zeros((index.shape[0], HIDDEN), np.float32)
        for i in range(t) if d == "b" else range(t - 1, -1, -1):
            prev, z, r, c, bc = states[i]
            m = mask[:, i, None]
            total = back + part[i]
            live = np.where(m, total, 0)
            dc = live * (1 - z) * (1 - c * c)
            dz = live * (prev - c) * z * (1 - z)
            dr = dc * bc * r * (1 - r)
            da_ = np.concatenate([dz, dr, dc], axis=1)
            db = np.concatenate([dz, dr, dc * r], axis=1)
            gu += prev.T @ db
            np.add.at(dx, index[:, i], da_)
            back = np.where(m, live * z + db @ u.T, total)
        g["u" + d], g["w" + d], g["b" + d] = gu, vectors.T @ dx, dx.sum(axis=0)
        dv += dx @ p["w" + d].T
    return g, dv


def start(rng: np.random.Generator) -> dict:
    def normal(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    p = {"words": np.zeros((SLOTS, INPUT), np.float32), "chars": np.zeros((SLOTS, INPUT), np.float32)}
    for d in "fb":
        p |= {"w" + d: normal(2 * INPUT, 3 * HIDDEN, scale=0.5), "u" + d: normal(HIDDEN, 3 * HIDDEN, scale=0.3), "b" + d: np.zeros(3 * HIDDEN, np.float32)}
    return p | {"wa": normal(2 * HIDDEN, HIDDEN, scale=0.4), "va": normal(HIDDEN, scale=0.4), "wo": normal(2 * HIDDEN, scale=0.4), "bo": np.zeros(1, np.float32)}


def windows_of(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and document of each window; a text without words has one empty window."""
    n = hi - lo
    count = np.maximum(1, -(-(n - (WINDOW - STRIDE)) // STRIDE))
    owner = np.repeat(np.arange(len(n)), count)
    first = ranges(np.zeros(len(n), np.int64), count) * STRIDE + lo[owner]
    return first, np.minimum(WINDOW, hi[owner] - first), owner


def train(texts: list[list[str]], toxic: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """Fits the network. texts: the windows of each document, words joined by a space."""
    rng = np.random.default_rng(seed)
    p = start(rng)
    texts, toxic = [*texts, [""]], np.append(toxic, 0)  # a text without words is clean
    data, first, end = joined(pa.array([w for t in texts for w in t], pa.large_string()))
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    data = lower_ascii(data)
    a, b = word_spans(data)
    lo, hi = np.searchsorted(a, first), np.searchsorted(a, end)
    hashes, rep, which = np.unique(span_hashes(data, a, b), return_index=True, return_inverse=True)
    order = np.argsort(a[rep])
    rank = np.empty(len(rep), np.int64)
    rank[order] = np.arange(len(rep))
    which = rank[which]
    word, slots, owner = word_inputs(data, a[rep[order]], b[rep[order]])
    size = np.minimum(hi - lo, WINDOW)
    cols = np.arange(WINDOW)
    mask = cols < size[:, None]
    index = np.where(mask, which[np.minimum(lo[:, None] + cols, max(len(which) - 1, 0))] if len(which) else 0, 0)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    positive, negative = np.flatnonzero(toxic[doc] == 1), np.flatnonzero(toxic[doc] == 0)
    if not len(positive) or not len(negative) or not len(word):
        p["bo"][:] = -4.0 if not len(positive) else 0.0
        return p | {"platt": np.array([1.0, 0.0])}

    def logits(rows: np.ndarray) -> np.ndarray:
        xs = gate_inputs(p, word_vectors(p, word, slots, owner))
        return np.concatenate([forward(p, xs, index[r], mask[r])[0] for r in np.array_split(rows, max(1, len(rows) // 4096))])

    def best(rows: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The highest window of each document."""
        by = np.lexsort((-score, doc[rows]))
        return rows[by[np.concatenate([[True], doc[rows][by][1:] != doc[rows][by][:-1]])]]

    step, top = 0, positive
    for epoch in range(epochs):
        if not epoch % 2:
            top = best(positive, logits(positive) if epoch else rng.random(len(positive)))
        rest = np.append(rng.choice(negative, min(len(negative), 2 * len(top)), replace=False), [len(doc) - 1] * 4)
        if epoch % 3 == 2 and epoch > 3:
            rest = np.concatenate([rest, best(negative, logits(negative))])
        rows = rng.permutation(np.concatenate([top, rest]))
        for r in np.array_split(rows, max(1, len(rows) // 256)):
            used, inverse = np.unique(index[r], return_inverse=True)
            inverse = inverse.reshape(index[r].shape)
            pick = np.isin(owner, used)
            own = np.searchsorted(used, owner[pick])
            vectors = word_vectors(p, word[used], slots[pick], own)
            z, saved = forward(p, gate_inputs(p, vectors), inverse, mask[r], True)
            y = toxic[doc[r]].astype(np.float32)
            error = (sigmoid(z) - y) / len(r)
            g, dv = backward(p, vectors, inverse, mask[r], saved, error.astype(np.float32))
            gw, gc = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
            np.add.at(gw, word[used], dv[:, :INPUT])
            count = np.bincount(own, minlength=len(used)).astype(np.float32)
            np.add.at(gc, slots[pick], (dv[:, INPUT:] / np.sqrt(np.maximum(count, 1))[:, None])[own])
            g |= {"words": gw, "chars": gc}
            step += 1
            rate = RATE * (1 - epoch / epochs) + 0.002
            for k, v in p.items():
                m, s = moment[k]
                m += 0.1 * (g[k] - m)
                s += 0.01 * (g[k] * g[k] - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6) + rate * 1e-4 * v
    score = np.full(len(texts), -np.inf)
    np.maximum.at(score, doc, logits(np.arange(len(doc))))
    have = np.isfinite(score)
    return p | {"platt": scale(score[have], toxic[have])}


def scale(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Documents' highest windows on a logistic scale, both classes with the same weight."""
    y = toxic.astype(float)
    w = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    ab = np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(ab[0] * x + ab[1], -30, 30)))
        d = w * (q - y)
        grad = np.array([(d * x).sum() + 0.01 * ab[0], d.sum()])
        k = w * q * (1 - q) + 1e-6
        hess = np.array([[(k * x * x).sum() + 0.01, (k * x).sum()], [(k * x).sum(), k.sum()]])
        ab -= np.clip(np.linalg.solve(hess, grad), -1, 1)
    return ab


MOST_WORDS = 1 << 18  # words whose vectors a task remembers; a new start beyond it changes no result


class Vectors:
    """Vectors of words seen before, by a 64-bit hash."""

    def __init__(self):
        self.hash, self.at, self.pool = np.zeros(0, U), np.zeros(0, np.int64), np.zeros((0, 2 * INPUT), np.float32)

    def of(self, p: dict, data: np.ndarray, first: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Place in pool of each word."""
        if len(self.hash) > MOST_WORDS:
            self.__init__()
        different, rep, which = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hash, different)
        new = np.ones(len(different), bool)
        inside = place < len(self.hash)
        new[inside] = self.hash[place[inside]] != different[inside]
        if new.any():
            r = np.sort(rep[new])
            made = word_vectors(p, *word_inputs(data, first[r], end[r]))
            at = len(self.pool) + np.searchsorted(r, rep[new])
            self.pool = np.concatenate([self.pool, made])
            self.at = np.insert(self.at, place[new], at)
            self.hash = np.insert(self.hash, place[new], different[new])
            place = np.searchsorted(self.hash, different)
        return self.at[place][which]


def highest(p: dict, col, known: Vectors | None = None) -> np.ndarray:
    """The network's highest output over all windows of each text."""
    lean()
    known = known or Vectors()
    data, first, end = joined(col)
    data = lower_ascii(data)
    a, b = word_spans(data)
    lo, hi = np.searchsorted(a, first), np.searchsorted(a, end)
    which = known.of(p, data, a, b, span_hashes(data, a, b))
    vectors = known.pool if len(known.pool) else np.zeros((1, 2 * INPUT), np.float32)
    xs = gate_inputs(p, vectors)
    at, size, of = windows_of(lo, hi)
    logit = np.empty(len(at), np.float32)
    whole = size == WINDOW
    cols = np.arange(WINDOW)
    full, part = np.flatnonzero(whole), np.flatnonzero(~whole)
    for i in range(0, len(full), 2048):  # small enough to stay in the processor's cache
        r = full[i : i + 2048]
        logit[r] = forward(p, xs, which[at[r, None] + cols], None)[0]
    for i in range(0, len(part), 2048):
        r = part[i : i + 2048]
        mask = cols < size[r, None]
        index = np.where(mask, which[np.minimum(at[r, None] + cols, len(which) - 1)] if len(which) else 0, 0)
        logit[r] = forward(p, xs, index, mask)[0]
    best = np.full(len(first), -np.inf)
    np.maximum.at(best, of, logit)
    return best


def score_texts(p: dict, col, known: Vectors | None = None) -> np.ndarray:
    """Score of each text, from all its windows."""
    best, ab = highest(p, col, known), p["platt"]
    return 1 / (1 + np.exp(-np.clip(ab[0] * best + ab[1], -30, 30)))


def is_held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_docs: tuple[int, int] = MOST_DOCS, most_windows: int = MOST_WINDOWS) -> dict:
    """Trains on a bounded sample of labelled rows, none of them held out. Rows without an id or a label aren't used.

    The driver trains the network on windows of these rows, most_windows of a row at most, evenly spread (so of a long toxic
    row the one window that makes it toxic may be left out). The scale of the scores is then fitted on all windows of all
    these rows, where the texts are."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and id is not null")
    known = known.where(~is_held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    sample = None
    for v in (0, 1):
        part = known.where(F.col("label") == v).orderBy(F.xxhash64("id"), "id").limit(most_docs[v])
        sample = part if sample is None else sample.unionAll(part)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id")

    def cut(batches):
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                words = (t or "").split()
                n = max(1, -(-(len(words) - (WINDOW - STRIDE)) // STRIDE))
                take = range(n) if n <= most_windows else [i * n // most_windows for i in range(most_windows)]
                out.append([" ".join(words[i * STRIDE : i * STRIDE + WINDOW]) for i in take])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.list_(pa.string()))], names=["id", "label", "windows"])

    rows = texts.select(F.col("id").cast("string").alias("id"), "text", "label").mapInArrow(cut, "id string, label int, windows array<string>").collect()
    rows.sort(key=lambda r: (r.id, r.windows))
    model = train([r.windows for r in rows], np.array([r.label for r in rows], np.int64))

    def judge(batches):
        lean()
        for batch in batches:
            for part in pieces(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(highest(model, part.column(1)).astype(np.float64))], names=["label", "best"])

    told = texts.select("label", "text").mapInArrow(judge, "label int, best double").collect()
    told = sorted((r.best, r.label) for r in told if np.isfinite(r.best))
    if told:
        model["platt"] = scale(np.array([b for b, _ in told]), np.array([y for _, y in told]))
    return model


def score_toxicity(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """All columns of docs (but one named score) and score, from 0 to 1.

    Only the text counts, all of it however long it is. A null or empty text gets the score of an empty window; each row is
    scored alone, so repeated rows get the same score, and so do texts that differ only in the case of A-Z."""
    rest = [c for c in docs.columns if c != "score"]
    at = rest.index(text_col)
    frame = docs.select(*rest).withColumn(text_col, F.col(text_col).cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        known = Vectors()
        for batch in batches:
            for part in pieces(batch, at):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score_texts(shared.value, part.column(at), known).astype(np.float64))], names=[*rest, "score"])

    return frame.mapInArrow(each, StructType([*frame.schema, StructField("score", DoubleType())]))
