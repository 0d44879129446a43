"""Mixture-controlled packing: token windows filled from one queue for each source by deficit round-robin.

Documents are tokenized once and dealt to lanes. In a lane each source has a queue. A round gives every source its share
of a window as quantum; a source spends its deficit on packets of its queue's first document. What a source did not get,
or got too much, stays in its deficit, across windows and across lanes: a lane's totals are known before it's packed, so
the deficits that the lanes before it leave are sums, and no lane waits for another.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import U, joined, lean, lower_ascii, pieces, ranges, span_hashes, total, word_spans
from .exchange import checkpointed

END = 1  # the id after each document
MOST_PARTS = 1 << 20  # parts remembered by a task; a new start beyond it changes no result


#: A tokenizer with these rules parts a text first by classes of characters, then applies its model to each part.
KNOWN_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
LETTER, DIGIT, MARK, OTHER = 1, 2, 3, 9


def classes() -> np.ndarray:
    """Class of each byte: white space 0; OTHER is what only the tokenizer itself judges."""
    out = np.full(256, OTHER, np.uint8)
    out[33:127] = MARK
    out[ord("'")] = OTHER
    out[48:58] = DIGIT
    out[65:91] = out[97:123] = LETTER
    out[[32, 9, 10, 11, 12, 13]] = 0
    return out


def byte_signs() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
    return [chr(rest.get(b, b)) for b in range(256)]


class Words:
    """Token ids of the parts of texts, remembered by a 64-bit hash. A part is a white-space separated word or, under known
    rules, a run of letters, a digit or a run of marks in a word of ASCII and Latin-1 letters."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        self.known = all(told[k] == v for k, v in KNOWN_RULES.items()) and told["model"]["type"] == "BPE"
        self.model, self.signs = self.tokenizer.model, byte_signs()
        self.special = [t["content"].encode() for t in told["added_tokens"]]
        self.kind = id_type(self.tokenizer.get_vocab_size())
        self.clear()

    def clear(self) -> None:
        self.hash = np.zeros(0, U)
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.kind)

    def ids(self, whole: list[bytes], parts: list[bytes]) -> list[list[int]]:
        out = [e.ids for e in self.tokenizer.encode_batch([w.decode() for w in whole], add_special_tokens=False)]
        signs, tokenize = self.signs, self.model.tokenize
        return out + [[t.id for t in tokenize("".join([signs[b] for b in x]))] for x in parts]

    def look_up(self, hashes: np.ndarray, whole: np.ndarray, part) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of ids of each different hash, in order; part(i): the bytes of the i-th, whole if it's a word."""
        place = np.searchsorted(self.hash, hashes)
        new = np.ones(len(hashes), bool)
        inside = place < len(self.hash)
        new[inside] = self.hash[place[inside]] != hashes[inside]
        if new.any():
            a, b = np.flatnonzero(new & whole), np.flatnonzero(new & ~whole)
            ids = self.ids([part(i) for i in a.tolist()], [part(i) for i in b.tolist()])
            n = np.array([len(x) for x in ids], np.int64)
            at = len(self.pool) + np.cumsum(n) - n
            self.pool = np.concatenate([self.pool, np.array([t for x in ids for t in x], self.kind)])
            where = np.concatenate([a, b])
            by = np.argsort(where)
            where = where[by]
            self.at, self.n = np.insert(self.at, place[where], at[by]), np.insert(self.n, place[where], n[by])
            self.hash = np.insert(self.hash, place[where], hashes[where])
            place = np.searchsorted(self.hash, hashes)
        return self.at[place], self.n[place]

    def encode(self, col) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with END after it, and where each text's ids end. The tokenizer's rules never join
        anything across white space, so a text's ids are those of its parts."""
        if len(self.hash) > MOST_PARTS:
            self.clear()
        data, start, end = joined(col)
        first, last = word_spans(data)
        low = data
        if self.known and len(first):
            kind = classes()[data]
            # U+00C0 to U+00FF are letters but for two signs
            lead = np.flatnonzero(data[:-1] == 0xC3)
            lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
            kind[lead] = kind[lead + 1] = LETTER
            low = lower_ascii(data)
            upper = lead[data[lead + 1] < 0x9F] + 1
            low[upper] += 0x20
            odd = total(kind == OTHER, first, last) > 0
            for s in self.special:  # an added token may stand in a word
                mark = np.flatnonzero(data[: len(data) - len(s) + 1] == s[0])
                for j in range(1, len(s)):
                    mark = mark[data[mark + j] == s[j]]
                odd[np.searchsorted(first, mark, "right") - 1] = True
            at = ranges(first[odd], last[odd] - first[odd])
            kind[at] = OTHER
            low[at] = data[at]
            change = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)) + 1
            first = np.concatenate([[0], change])
            last = np.append(change, len(data))
            on = kind[first] != 0
            first, last = first[on], last[on]
            whole = kind[first] == OTHER
        else:
            whole = np.ones(len(first), bool)
        hashes = span_hashes(low, first, last) ^ whole.astype(U)
        hashes, index, which = np.unique(hashes, return_index=True, return_inverse=True)
        at, n = self.look_up(hashes, whole[index], lambda i: low[first[index[i]] : last[index[i]]].tobytes())
        at, n = at[which], n[which]
        ids = self.pool[ranges(at, n)]
        upto = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(first, end)]
        return np.insert(ids, upto, self.kind(END)), upto + np.arange(1, len(upto) + 1)


def id_type(vocabulary: int):
    return np.uint16 if vocabulary <= 1 << 16 else np.uint32


def sizes(tokens: int, length: int) -> list[int]:
    """Sequences for so many tokens: full ones, then one for each binary digit of the rest, which need no padding."""
    rest = tokens % length
    return [length] * (tokens // length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def round_robin(queues: list, share: list, deficit: list, tokens: int, length: int, packet: int) -> list:
    """Pieces (document, start, length, sequence, offset). queues: for each source the (document, tokens) in order."""
    room, sequence, left, out = sizes(tokens, length), 0, 0, []
    heads = [0] * len(queues)  # the first document of each queue, and how much of it is gone
    gone = [0] * len(queues)
    deficit = list(deficit)
    active = [s for s, q in enumerate(queues) if q]
    left = room[0] if room else 0
    while active:
        whole = sum(share[s] for s in active)
        for s in list(active):
            # sources without a share come last; where little of the shares is left, the rest is parted by them
            deficit[s] += length * (share[s] if whole >= 0.5 else share[s] / whole if whole > 0 else 1 / len(active))
            q = queues[s]
            while heads[s] < len(q):
                doc, size = q[heads[s]]
                send = min(packet, size - gone[s])
                if send > deficit[s] and len(active) > 1:
                    break
                deficit[s] -= send
                while send:
                    part = min(send, left)
                    at = room[sequence] - left
                    if out and out[-1][0] == doc and out[-1][3] == sequence and out[-1][1] + out[-1][2] == gone[s]:
                        out[-1][2] += part
                    else:
                        out.append([doc, gone[s], part, sequence, at])
                    gone[s] += part
                    send -= part
                    left -= part
                    if not left:
                        sequence += 1
                        left = room[sequence] if sequence < len(room) else 0
                if gone[s] == size:
                    heads[s] += 1
                    gone[s] = 0
            if heads[s] == len(q):
                active.remove(s)
    return out


PIECES = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("source", pa.string()), ("ids", pa.binary())]


def pack_lane(kind, length: int, packet: int, keep_ids: bool, table: pa.Table, carry: pa.Table) -> pa.Table:
    schema = pa.schema(PIECES if keep_ids else PIECES[:-1])
    lean()
    if not len(table):
        return schema.empty_table()
    rows = table.take(pc.sort_indices(table, sort_keys=[("source", "ascending"), ("doc_id", "ascending"), ("ids", "ascending")]))
    names = rows["source"].to_pylist()
    n = rows["n_tokens"].to_pylist()
    known = {s: (p, d) for s, p, d in zip(carry["of_source"].to_pylist(), carry["share"].to_pylist(), carry["deficit"].to_pylist())}
    order = sorted(dict.fromkeys(names), key=lambda s: (s is None, s))
    number = {s: i for i, s in enumerate(order)}
    queues: list = [[] for _ in order]
    for i, s in enumerate(names):
        queues[number[s]].append((i, n[i]))
    base = carry["first_sequence"][0].as_py()
    found = round_robin(queues, [known[s][0] for s in order], [known[s][1] for s in order], sum(n), length, packet)
    ids = [np.frombuffer(x.as_buffer(), kind) for x in rows["ids"]]
    docs = rows["doc_id"].to_pylist()
    raw = [ids[d][a : a + m].astype("<u4").tobytes() for d, a, m, _, _ in found]
    cols = [[docs[d] for d, *_ in found], [x[1] for x in found], [x[2] for x in found], [zlib.crc32(x) for x in raw], [n[x[0]] for x in found], [base + x[3] for x in found], [x[4] for x in found], [names[x[0]] for x in found]]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip([*cols, *([raw] if keep_ids else [])], schema)], schema=schema)


def summed_before(df: DataFrame, place: str, columns: dict, block: int = 4096) -> DataFrame:
    """df (one row a place) with sums of columns over all smaller places, under new names. Blocks of places are summed first, so
    the only ordered task has a row for each block."""
    rows = df.withColumn("_block", F.floor(F.col(place) / block))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy("_block").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_block").agg(*(F.sum(c).alias(f"_{c}") for c in columns))
    sums = sums.select("_block", *(F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in columns))
    return rows.join(sums, "_block").select(place, *((F.col(f"_{c}") + F.coalesce(F.sum(c).over(inner), F.lit(0))).alias(n) for c, n in columns.items()))


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length: int = 2048, packet: int = 512, lane_tokens: int = 4 << 20, keep_ids: bool = False, shares: dict | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source and, if asked
    for, the ids as little-endian unsigned 32-bit numbers.

    tokenizer: path of a tokenizers file whose rules part texts at white space. shares: target proportions by source (those
    not named come after the others); by default the sources' shares of all tokens, so that all queues end together. With
    other proportions windows follow them as long as a source lasts, and every document is still packed. Texts of any
    length are read whole; documents of a source are taken in the order of ids and then of texts, equal ones next to each
    other. A null or empty text is just the id END. A null source is a
    source of its own, a null id stays null, and repeated rows are packed as often as they occur. Other columns are
    ignored. packet: tokens served at once at most. lane_tokens: about what one task packs.
    """

    def tokenize(batches):
        lean()
        words = Words(tokenizer)
        for batch in batches:
            for part in pieces(batch, 2):
                ids, end = words.encode(part.column(2))
                size = np.diff(np.concatenate([[0], end]))
                off = pa.py_buffer((np.concatenate([[0], end]) * ids.itemsize).astype(np.int32).tobytes())
                raw = pa.Array.from_buffers(pa.binary(), len(end), [None, off, pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size), raw], names=["doc_id", "source", "n_tokens", "ids"])

    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    coded = checkpointed(frame.mapInArrow(tokenize, "doc_id long, source string, n_tokens long, ids binary"))
    tokens = coded.agg(F.sum("n_tokens")).first()[0] or 0
    lanes = max(1, -(-tokens // lane_tokens))
    coded = coded.withColumn("lane", F.pmod(F.xxhash64("doc_id", "ids"), F.lit(lanes)))
    # a row for each lane and source: few, next to the documents
    have = checkpointed(coded.groupBy("lane", "source").agg(F.sum("n_tokens").alias("n")))
    before = Window.partitionBy("source").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lane = have.groupBy("lane").agg(F.sum("n").alias("total"))
    rest = F.col("total") % length
    lane = lane.withColumn("sequences", F.expr(f"total div {length}") + F.bit_count(rest))
    lane = summed_before(lane, "lane", {"total": "all_before", "sequences": "first_sequence"})
    share = F.sum("n").over(Window.partitionBy("source")) / F.lit(max(1, tokens))
    deficit = F.col("share") * F.col("all_before") - F.col("own_before")
    if shares:
        given = F.create_map(*(F.lit(x) for s, p in shares.items() for x in (s, float(p) / sum(shares.values()))))
        share = F.coalesce(F.try_element_at(given, F.col("source")), F.lit(0.0))
        # a source that runs out can't make up for it later
        deficit = F.greatest(F.least(deficit, F.lit(float(length))), F.lit(-float(length)))
    carry = have.select("lane", "source", share.alias("share"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("own_before")).join(lane, "lane")
    carry = carry.select(F.col("lane").alias("to_lane"), F.col("source").alias("of_source"), "share", deficit.alias("deficit"), "first_sequence")

    kind = Words(tokenizer).kind

    def one(table: pa.Table, known: pa.Table) -> pa.Table:
        return pack_lane(kind, length, packet, keep_ids, table, known)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string" + ", ids binary" * keep_ids
    # some lanes a task, however many there are
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-lanes // 4))
    coded = coded.repartition(parts, "lane")
    return coded.groupBy("lane").cogroup(carry.groupBy("to_lane")).applyInArrow(one, schema)
