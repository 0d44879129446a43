"""Sentence table, pool, sampling and splits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmend.functions import text as T
from textmend.functions.draws import hash_key, hash_places
from textmend.schemas import CONFIG
from textmend.sources.store import checkpointed

# The length bins of the reference data.
LENGTH_BINS = [(0, 19, "under 20"), (20, 29, "20-29"), (30, 44, "30-44"), (45, 60, "45-60"), (61, 80, "61-80"), (81, 10**9, "81 and more")]


def excerpt_stats(docs: DataFrame) -> DataFrame:
    """doc_id, paragraphs, words; docs: doc_id, paragraphs."""
    count = F.aggregate("paragraphs", F.lit(0), lambda n, p: n + F.size(T.words(p)))
    return docs.select("doc_id", F.size("paragraphs").alias("paragraphs"), count.alias("words"))


def sentence_table(docs: DataFrame, bands=CONFIG["bands"], segment=T.segments) -> DataFrame:
    """One row a sentence; docs: doc_id, paragraphs. No shuffle: all is decided within a document."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(T.sentences(F.col("paragraphs"), segment)).alias("pos", "text"))
    rows = rows.withColumn("tokens", T.words(F.col("text"))).withColumn("fact_idx", T.fact_positions(F.col("tokens")))
    n = F.size("tokens")
    return rows.select(
        F.format_string("%s-%03d", "doc_id", "pos").alias("id"), "doc_id", "text", n.alias("n_words"), T.band(n, bands).alias("band"), "fact_idx", F.size("fact_idx").alias("n_facts")
    )


def make_pool(sentences: DataFrame, min_facts: int | None = None, fallback: int | None = None, threshold: int | None = None) -> DataFrame:
    """Sentences in a band with enough fact tokens; with the lower number if the pool would be smaller than threshold."""
    strict = CONFIG["min_fact_tokens"] if min_facts is None else min_facts
    loose = CONFIG["min_fact_tokens_fallback"] if fallback is None else fallback
    least = CONFIG["fallback_pool_threshold"] if threshold is None else threshold
    inside = sentences.where("band is not null")
    enough = inside.where(F.col("n_facts") >= strict).limit(least).count() >= least
    return inside.where(F.col("n_facts") >= (strict if enough else loose))


def pool_funnel(sentences: DataFrame) -> DataFrame:
    """Sentences and documents that are left after each filter, in one pass."""
    inside = F.col("band").isNotNull()
    steps = [("all sentences", F.lit(True)), (f"{CONFIG['min_words']} to {CONFIG['max_words']} words", inside), ("at least 1 fact token", inside & (F.col("n_facts") >= 1)), ("at least 2 fact tokens", inside & (F.col("n_facts") >= 2))]
    aggs = [a for i, (_, c) in enumerate(steps) for a in (F.count_if(c).alias(f"s{i}"), F.countDistinct(F.when(c, F.col("doc_id"))).alias(f"d{i}"))]
    stack = ", ".join(f"{i}, '{name}', s{i}, d{i}" for i, (name, _) in enumerate(steps))
    return sentences.agg(*aggs).selectExpr(f"stack({len(steps)}, {stack}) as (step, name, sentences, excerpts)")


def pool_table(pool: DataFrame) -> DataFrame:
    """Sentences by band and number of facts (2, 3, 4+; 1 if the pool is loose), with totals and shares."""
    group = F.least(F.col("n_facts"), F.lit(4))
    rows = pool.groupBy("band").agg(*(F.count_if(group == k).alias(f"facts_{k}") for k in (1, 2, 3, 4)), F.count("*").alias("total"))
    return rows.withColumn("share", F.round(F.col("total") / F.sum("total").over(Window.partitionBy()), 6))


def length_coverage(sentences: DataFrame) -> DataFrame:
    """Sentences and words of each length bin, empty bins too."""
    spark = sentences.sparkSession
    bins = spark.createDataFrame([(i, lo, hi, name) for i, (lo, hi, name) in enumerate(LENGTH_BINS)], "rank int, lo long, hi long, bin string")
    label = F.coalesce(*(F.when(F.col("n_words").between(lo, hi), F.lit(name)) for lo, hi, name in LENGTH_BINS))
    have = sentences.groupBy(label.alias("bin")).agg(F.count("*").alias("sentences"), F.sum("n_words").alias("words"))
    rows = bins.join(F.broadcast(have), "bin", "left")  # at most one row a bin
    whole = Window.partitionBy()
    n, w = F.coalesce("sentences", F.lit(0)), F.coalesce("words", F.lit(0))
    return rows.select("rank", "bin", n.alias("sentences"), w.alias("words"), F.round(n / F.sum(n).over(whole), 6).alias("share_sentences"), F.round(w / F.sum(w).over(whole), 6).alias("share_words"))


def top_fact_tokens(pool: DataFrame, n: int = 20) -> DataFrame:
    """The most frequent fact tokens with their share of all."""
    tokens = T.words(F.col("text"))
    rows = pool.select(F.explode(F.transform("fact_idx", lambda i: F.get(tokens, i))).alias("t")).select(F.trim(F.col("t"), F.lit(T.STRIPPED)).alias("token"))
    counts = rows.groupBy("token").agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("all"))
    return counts.orderBy(F.desc("count"), "token").limit(n).crossJoin(F.broadcast(total)).select("token", "count", F.round(F.col("count") / F.col("all"), 6).alias("share"))


def seeded_examples(df: DataFrame, n: int, seed: int, purpose: str, key: str = "id") -> DataFrame:
    """n rows in the order of a hash of their key."""
    return df.orderBy(hash_key(seed, purpose, F.col(key)), key).limit(n)


def long_examples(sentences: DataFrame, lo: int, hi: int, n: int = 3, seed: int = 42, chars: int = 200) -> DataFrame:
    rows = seeded_examples(sentences.where(F.col("n_words").between(lo, hi)), n, seed, "long")
    return rows.select("id", "n_words", F.substring("text", 1, chars).alias("start"))


def quotas(counts: DataFrame, n: int, key: str = "band") -> DataFrame:
    """n split in proportion to counts (key, n_rows) by largest remainder, ties by key; a few rows."""
    whole, by = Window.partitionBy(), Window.orderBy(F.desc("rest"), key)
    raw = F.col("n_rows") * n / F.sum("n_rows").over(whole)
    rows = counts.withColumn("raw", raw).withColumn("base", F.floor("raw").cast("int")).withColumn("rest", F.round(F.col("raw") - F.col("base"), 9))
    rows = rows.withColumn("left", n - F.sum("base").over(whole)).withColumn("place", F.row_number().over(by))
    return rows.select(key, (F.col("base") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0)).cast("int").alias("quota"))


def band_quotas(pool: DataFrame, n: int) -> DataFrame:
    return quotas(pool.groupBy("band").agg(F.count("*").alias("n_rows")), n)


def _greedy(quota: dict, cap: int):
    def take(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, used = dict(quota), {}
        for frame in frames:
            picks = []
            for i, doc, band in zip(frame["id"], frame["doc_id"], frame["band"]):
                if left.get(band, 0) > 0 and used.get(doc, 0) < cap:
                    left[band] -= 1
                    used[doc] = used.get(doc, 0) + 1
                    picks.append(i)
            yield pd.DataFrame({"id": picks})
            if not any(left.values()):
                return

    return take


def draw_sample(pool: DataFrame, n_test: int, n_dev: int, cap: int, seed: int) -> DataFrame:
    """pool with split: test rows, then dev rows from documents that test doesn't use, with quotas by band and at most cap
    rows a document, in the order of a hash. Raises ValueError if the quotas can't be filled.

    Within a document and band the picks are a prefix of the order, of at most cap rows. Of those, the picks also lie among
    the first quota * cap... rows that a band could ever need: each row passed over belongs to a document that is full, so
    what one task reads in order is bounded by the quotas, not by the pool."""
    spark = pool.sparkSession
    keyed = pool.select("id", "doc_id", "band", hash_key(seed, F.col("id")).alias("key")).persist()  # read for each split
    plan = keyed.groupBy("band").agg(F.count("*").alias("n_rows"))
    prefix = keyed.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "band").orderBy("key", "id"))).where(F.col("place") <= cap)
    chosen: list[tuple[str, str]] = []
    for name, n in (("test", n_test), ("dev", n_dev)):
        want = {r["band"]: r["quota"] for r in quotas(plan, n).collect()}
        rest = prefix
        if chosen:  # a sample's ids are few
            used = spark.createDataFrame(chosen, "id string, split string").join(keyed, "id").select("doc_id").distinct()
            rest = prefix.join(F.broadcast(used), "doc_id", "left_anti")
        ranked = rest.withColumn("rank", F.row_number().over(Window.partitionBy("band").orderBy("key", "id")))
        # a row passed over lies in a document with cap picks; a document gives at most cap * bands rows here
        front = ranked.where(F.col("rank") <= n * len(want) * cap + n).orderBy("key", "id").select("id", "doc_id", "band")
        ids = [r["id"] for r in front.coalesce(1).mapInPandas(_greedy(want, cap), "id string").collect()]
        if len(ids) != n:
            keyed.unpersist()
            raise ValueError(f"could not fill the {name} quotas: {len(ids)} of {n}")
        chosen += [(i, name) for i in ids]
    keyed.unpersist()
    # few rows, of which each reader would make the pool again
    return checkpointed(pool.join(F.broadcast(spark.createDataFrame(chosen, "id string, split string")), "id").withColumnRenamed("text", "gold_text"))


def sample_counts(sample: DataFrame) -> DataFrame:
    """Counts by split and band with margins; 'total' stands for all."""
    return sample.cube("split", "band").agg(F.count("*").alias("n")).select(F.coalesce("split", F.lit("total")).alias("split"), F.coalesce("band", F.lit("total")).alias("band"), "n")


def sample_spread(sample: DataFrame) -> DataFrame:
    docs = sample.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("split").alias("splits"))
    return docs.agg(F.sum("n").alias("sentences"), F.count("*").alias("excerpts"), F.max("n").alias("most_from_one"), F.count_if(F.col("splits") > 1).alias("in_both"))


def capped_capacity(pool: DataFrame, cap: int) -> DataFrame:
    return pool.groupBy("doc_id").agg(F.least(F.count("*"), F.lit(cap)).alias("n")).agg(F.sum("n").alias("capacity"))


def doc_split(docs: DataFrame, seed: int, share: float = 0.10) -> DataFrame:
    """doc_id and usage: round(n * share) documents, one at least, are val, the first in the order of a hash."""
    rows = checkpointed(docs.select("doc_id").distinct())
    n = rows.count()
    held = max(1, round(n * share))
    placed = hash_places(rows, hash_key(seed, "val_split", F.col("doc_id")), "doc_id")
    return placed.select("doc_id", F.when(F.col("place") <= held, "val").otherwise("train").alias("usage"))


def leakage(pool: DataFrame, sample: DataFrame) -> DataFrame:
    """Documents and texts that pool and sample share; both must be 0."""
    docs = pool.select("doc_id").distinct().join(sample.select("doc_id").distinct(), "doc_id", "left_semi").agg(F.count("*").alias("shared_docs"))
    texts = pool.select("text").distinct().join(sample.select(F.col("gold_text").alias("text")).distinct(), "text", "left_semi").agg(F.count("*").alias("shared_texts"))
    return docs.crossJoin(texts)


def training_pool(sentences: DataFrame, sample: DataFrame, seed: int, min_facts: int = 1, share: float = 0.10) -> DataFrame:
    """Sentences in a band with facts, of documents that the sample doesn't use, with usage. They are cut and judged once, and
    written: the split reads their documents, then the rows are read."""
    rows = sentences.where(F.col("band").isNotNull() & (F.col("n_facts") >= min_facts)).join(sample.select("doc_id").distinct(), "doc_id", "left_anti")
    rows = checkpointed(rows)
    return rows.join(doc_split(rows, seed, share), "doc_id")


def pool_summary(pool: DataFrame) -> DataFrame:
    """Counts by usage with a total row."""
    rows = pool.groupBy("usage", "doc_id").agg(F.count("*").alias("n"), F.sum("n_words").alias("w"))
    rows = rows.groupBy("usage").agg(F.sum("n").alias("sentences"), F.count("*").alias("excerpts"), F.sum("w").alias("words"))
    return rows.unionByName(rows.agg(F.lit("total").alias("usage"), *(F.sum(c).alias(c) for c in ("sentences", "excerpts", "words"))))


def ordered_docs(docs: DataFrame, exclude: DataFrame, seed: int) -> DataFrame:
    """doc_id and place of documents not in exclude, in the order of a hash."""
    rest = docs.select("doc_id").distinct().join(exclude.select("doc_id").distinct(), "doc_id", "left_anti")
    return hash_places(rest, hash_key(seed, "calibration", F.col("doc_id")), "doc_id")


def review_picks(sample: DataFrame, levels: list[str], per_level: int, seed: int) -> DataFrame:
    """per_level sentences for each level, bands in rotation, each sentence once; (id, level)."""
    bands = sorted(r["band"] for r in sample.select("band").distinct().collect())
    turns, uses = [], dict.fromkeys(bands, 0)
    for i, level in enumerate(levels):
        for j in range(per_level):
            b = bands[(i + j) % len(bands)]
            uses[b] += 1
            turns.append((level, i * per_level + j, b, uses[b]))
    order = Window.partitionBy("band").orderBy(hash_key(seed, "review", F.col("id")), "id")
    ranked = sample.select("id", "band", F.row_number().over(order).alias("place"))
    plan = sample.sparkSession.createDataFrame(turns, "level string, turn int, band string, place int")
    return F.broadcast(plan).join(ranked, ["band", "place"]).select("turn", "level", "band", "id")


def first_per_group(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_place") <= n).drop("_place")


def batches(df: DataFrame, size: int, seed: int, epoch: int, key: str) -> DataFrame:
    """Adds batch: rows in the order of a hash of key and epoch, size at a time."""
    placed = hash_places(df, hash_key(seed, "shuffle", F.lit(epoch), F.col(key)), key, name="_place")
    return placed.withColumn("batch", F.floor((F.col("_place") - 1) / size).cast("int")).drop("_place")


def fact_sample(sentences: DataFrame, n: int, seed: int) -> DataFrame:
    """n places (id, idx) of fact tokens in the order of a hash, for a check by hand."""
    rows = sentences.select("id", F.explode("fact_idx").alias("idx"))
    return rows.orderBy(hash_key(seed, "facts", F.col("id"), F.col("idx")), "id", "idx").limit(n)


def probe_sample(pool: DataFrame, seed: int) -> DataFrame:
    """As many train rows as there are val rows, the first in the order of a hash: a probe of what training has seen. Their
    number grows with the pool, so they are taken by their places, not sorted in one task."""
    n = pool.where("usage = 'val'").count()
    placed = hash_places(pool.where("usage = 'train'"), hash_key(seed, "probe", F.col("id")), "id", name="_place")
    return placed.where(F.col("_place") <= n).drop("_place")


def quota_first(df: DataFrame, group: str, quota: dict, order: list) -> DataFrame:
    """The first rows of each group in an order, as many as a short table of quotas says."""
    most = F.coalesce(*(F.when(F.col(group) == k, F.lit(n)) for k, n in quota.items()), F.lit(0))
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_place") <= most).drop("_place")
