"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with documents.

A window is a run of an item's words. Its shingles (short runs of words) are ordered by how often they occur in the
corpus; as a document must hold all of them, the rarest alone is a sufficient prefix to join by. The shingle's place in
the window gives the place where the window must lie, which the document's length must allow, and there all words are
compared.

Documents are split into words once. Of what is exploded only a row for each document, and for each place with one of the
benchmark's shingles the words around it (fewer than two windows), is kept and written; all later steps read that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII that is neither a digit nor a letter.
OTHER = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHINGLE = 3
#: Windows that are looked for at once; as their shingles are broadcast, a larger benchmark is gone through in blocks.
BLOCK = 1 << 18


def words_of(text: Column) -> Column:
    """Words in their own case; an empty array if there are none."""
    inner = F.trim(text.cast("string"), F.lit(OTHER))
    return F.when(inner.isNull() | (inner == ""), F.array().cast("array<string>")).otherwise(F.split(inner, SPLIT, -1))


def plain(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def key_at(words: Column, at: Column, size: int) -> Column:
    """Hash of the shingle of size words there. lower() maps more than A-Z alike, so it joins too much, never too little."""
    return F.xxhash64(F.lit(size), *(F.lower(F.get(words, at + i)) for i in range(size)))


def windows_of(benchmark: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """window_id, window (its words, joined by spaces), n (words), shingle (size), items."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.split(plain(F.array_join(words_of(F.col(text_col)), " ")), " ").alias("w")).where("item is not null and w[0] <> ''")
    items = items.withColumn("n", F.least(F.lit(words), F.size("w")))
    one = items.select("item", "n", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("n"))).alias("at"), "w")
    one = one.select("item", "n", F.array_join(F.slice("w", F.col("at") + 1, F.col("n")), " ").alias("window"))
    return one.groupBy("window", "n").agg(F.collect_set("item").alias("items"))


def shingles_of(windows: DataFrame, shingle: int, sizes: list[int]) -> DataFrame:
    """windows with a row for each of their shingles: offset and key."""
    parts = windows.withColumn("ww", F.split("window", " ")).withColumn("s", F.least(F.lit(shingle), F.col("n")))
    parts = parts.withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("s"))))
    return parts.withColumn("key", F.coalesce(*(F.when(F.col("s") == s, key_at(F.col("ww"), F.col("offset"), s)) for s in sizes))).drop("ww")


def places_of(rows: DataFrame, wanted: DataFrame, sizes: list[int], words: int) -> DataFrame:
    """A row for each of rows (doc_id, h, w), marked head, and one for each place (pos) where a wanted shingle begins (they may be
    the same), with the words around it (near, from the place first on): all that a window there can hold."""
    place = rows.select("doc_id", "h", "w", F.posexplode_outer("w").alias("pos", "word"))
    keys = [key_at(F.col("w"), F.col("pos"), s) for s in sizes]
    place = place.select("*", F.posexplode(F.array(*keys)).alias("which", "key")) if len(keys) > 1 else place.select("*", F.lit(0).alias("which"), keys[0].alias("key"))
    # one row for a document's first word (or none), whatever its shingles are
    place = place.join(F.broadcast(wanted.withColumn("found", F.lit(True))), "key", "left")
    head = (F.coalesce("pos", F.lit(0)) == 0) & (F.col("which") == 0)
    first = F.greatest(F.col("pos") - (words - 1), F.lit(0))
    near = F.when(F.col("found"), F.slice("w", first + 1, 2 * words))
    place = place.where(head | F.col("found"))
    return place.select("doc_id", "h", head.alias("head"), F.size("w").alias("n_words"), "pos", F.when(F.col("found"), F.col("key")).alias("key"), first.alias("first"), near.alias("near"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", words: int = 10, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """For each row: doc_id, text_hash, n_words, n_hit, n_items, items (sorted strings), contaminated.

    A word is a run of characters other than ASCII that is no letter or digit; A-Z count as a-z. A window is a run of so
    many words of an item, or the whole item if it has fewer; a word inside an occurrence of a window is hit. Null and
    empty texts have no words, and neither do such items; an item without an id is left out. Repeated rows get the same
    result each; of rows with the same id each is judged by its own text. Items that share a window are all named. Texts of
    any length are read whole. Other columns, whatever their names, are left out. block: changes the work, not the result."""
    windows = checkpointed(windows_of(benchmark, item_col, item_text_col, words))
    count, least = windows.agg(F.count("*"), F.min("n")).first()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("h"), words_of(F.col("text")).alias("w"))
    if not count:
        empty = rows.select("doc_id", F.col("h").alias("text_hash"), F.size("w").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.array().cast("array<string>").alias("items"))
        return empty.withColumn("contaminated", F.lit(False))
    sizes = sorted({min(shingle, n) for n in range(least, shingle + 1)} | {min(shingle, words)})
    blocks = -(-count // block)
    per_doc = hits = None
    for i in range(blocks):
        mine = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == i)
        parts = shingles_of(mine, shingle, sizes)
        place = checkpointed(places_of(rows, parts.select("key").distinct(), sizes, words))
        if per_doc is None:
            per_doc = place.where("head").select("doc_id", "h", F.col("n_words").cast("long").alias("n_words"))
        found = place.where("key is not null")
        seen = found.groupBy("key").agg(F.count("*").alias("times"))
        # a window of which a shingle never occurs doesn't either
        rarest = parts.join(seen, "key").groupBy("window", "n", "s", "items").agg(F.min(F.struct("times", "offset", "key")).alias("r"), F.count("*").alias("have")).where("have = n - s + 1")
        prefix = rarest.select("window", F.col("n").alias("size"), "items", F.col("r.offset").alias("offset"), F.col("r.key").alias("key"))
        begin = F.col("pos") - F.col("offset")
        near = found.join(F.broadcast(prefix), "key").where((begin >= 0) & (begin + F.col("size") <= F.col("n_words")))
        same = plain(F.array_join(F.slice("near", begin - F.col("first") + 1, F.col("size")), " ")) == F.col("window")
        one = near.where(same).select("doc_id", "h", F.struct(begin.alias("a"), (begin + F.col("size")).alias("z")).alias("span"), "items")
        hits = one if hits is None else hits.unionByName(one)
    found = hits.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("sum")),
        lambda acc, s: F.struct(F.greatest(acc["upto"], s["z"]).alias("upto"), (acc["sum"] + F.greatest(F.lit(0), s["z"] - F.greatest(acc["upto"], s["a"]))).alias("sum")),
        lambda acc: acc["sum"],
    )
    found = found.select(F.col("doc_id").alias("hit_id"), F.col("h").alias("hit_h"), covered.alias("n_hit"), "items")
    out = per_doc.join(found, per_doc.doc_id.eqNullSafe(found.hit_id) & (per_doc.h == found.hit_h), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", F.col("h").alias("text_hash"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items")).withColumn("contaminated", F.col("n_hit") > 0)


SQL = """WITH d AS (SELECT doc_id, md5(coalesce(text, '')) h, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w FROM documents),
b AS (SELECT item_id::VARCHAR item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT item, least(10, len(w)) n, unnest([array_to_string(w[i + 1 : i + least(10, len(w))], ' ') FOR i IN range(0, len(w) - least(10, len(w)) + 1)]) v FROM b WHERE len(w) > 0),
size AS (SELECT DISTINCT n FROM win),
place AS (SELECT DISTINCT doc_id, h, n, unnest(range(0, greatest(0, len(w) - n + 1))) p, unnest([array_to_string(w[i + 1 : i + n], ' ') FOR i IN range(0, greatest(0, len(w) - n + 1))]) v FROM (SELECT DISTINCT * FROM d), size),
hit AS (SELECT doc_id, h, p, place.n n, item FROM place JOIN win ON place.v = win.v AND place.n = win.n),
word AS (SELECT doc_id, h, count(DISTINCT q) n_hit FROM (SELECT doc_id, h, unnest(range(p, p + n)) q FROM hit) GROUP BY ALL),
item AS (SELECT doc_id, h, count(*) n_items, string_agg(item, ',' ORDER BY item) items FROM (SELECT DISTINCT doc_id, h, item FROM hit) GROUP BY ALL)
SELECT d.doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN word USING (doc_id, h) LEFT JOIN item USING (doc_id, h)"""
