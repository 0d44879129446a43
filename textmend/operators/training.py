"""Training examples: masked words and bracketed sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmend.functions import text as T
from textmend.functions.draws import below
from textmend.operators import damage as D
from textmend.operators import slots as L
from textmend.schemas import CONFIG, LEVELS

TRAINED = LEVELS[1:]


def training_spans(pool: DataFrame, seed: int, epoch: str) -> DataFrame:
    """pool with level, anchor, k, start and end of one drawn span each; val rows have the same draw in every epoch."""
    draw = F.when(F.col("usage") == "val", "val").otherwise(epoch)
    rows = pool.withColumn("level", F.get(F.array(*map(F.lit, TRAINED)), below(F.lit(len(TRAINED)), seed, "level", F.col("id"), draw)))
    rows = rows.withColumn("anchor", F.get("fact_idx", below(F.size("fact_idx"), seed, "anchor", F.col("id"), draw)))
    rows = rows.withColumn("k", D.level_size(F.col("n_words"), F.col("level")))
    return rows.withColumn("start", D.span_start(F.col("n_words"), F.col("anchor"), F.col("k"))).withColumn("end", F.col("start") + F.col("k"))


def masked_input(tokens: Column, start: Column, end: Column, target: Column, pieces, mask: str = "[MASK]") -> Column:
    """The sentence with a mask for each piece of the target word and one for each later word of the span. Marks at a word's
    edges are never masked; a word of marks only is masked whole. pieces: column to number of pieces."""

    def word(t: Column, i: Column) -> Column:
        lead, core, trail = T.edge_parts(t)
        aim = F.when(core == "", t).otherwise(core)
        bare = core == ""
        n = F.when(i == target, F.greatest(F.lit(1), pieces(aim))).otherwise(1)
        body = F.array_join(F.array_repeat(F.lit(mask), n), " ")
        return F.when((i < start) | (i >= end) | (i < target), t).otherwise(F.concat(F.when(bare & (i == target), "").otherwise(lead), body, trail))

    return F.array_join(F.transform(tokens, word), " ")


def masked_examples(pool: DataFrame, seed: int, epoch: str, pieces, mask: str = "[MASK]") -> DataFrame:
    """One example for each word of each drawn span."""
    rows = training_spans(pool, seed, epoch).withColumn("tokens", T.words(F.col("text")))
    rows = rows.withColumn("target_pos", F.explode(F.sequence("start", F.col("end") - 1)))
    word = F.get("tokens", F.col("target_pos"))
    core = T.edge_parts(word)[1]
    return rows.select("id", "usage", "level", "target_pos", F.when(core == "", word).otherwise(core).alias("target_word"), masked_input(F.col("tokens"), F.col("start"), F.col("end"), F.col("target_pos"), pieces, mask).alias("masked_input"))


def example_stats(examples: DataFrame, pieces, longest: int = 192, mask: str = "[MASK]") -> DataFrame:
    """Examples, masks and target pieces by usage and level."""
    n = pieces(F.col("target_word"))
    rows = examples.withColumn("n", n).withColumn("masks", T.occurrences(F.col("masked_input"), F.lit(mask))).withColumn("size", F.size(T.words(F.col("masked_input"))))
    return rows.groupBy("usage", "level").agg(F.count("*").alias("examples"), F.max("size").alias("longest"), F.count_if(F.col("size") > longest).alias("over"), F.sum("masks").alias("masks"), F.sum(F.least("n", F.lit(4))).alias("pieces"))


def bracket_examples(pool: DataFrame, table: dict, draw: str, cfg: dict = CONFIG) -> DataFrame:
    """id, usage, level, k, source and target in braces: every sentence at every level, damaged by its own draw."""
    name = F.when(F.col("usage") == "val", "val").otherwise(draw)
    out = None
    for level in TRAINED:  # five levels; each has its own key, anchor and damage
        key = F.concat_ws("|", "id", name, F.lit(level))
        rows = pool.select(key.alias("id"), F.col("doc_id"), F.col("text").alias("gold_text"), "band", "fact_idx", F.concat_ws("|", "usage", "id").alias("split"))
        rec = D.build_damage(rows, table, cfg, [level])
        out = rec if out is None else out.unionByName(rec)
    view = L.slot_structs(F.col("ops_per_word"), F.col("anchor_idx"), F.col("fact_idx_in_span"))
    places = F.transform("ops_per_word", lambda p: p["idx"])
    hidden = F.transform("gold_tokens", lambda t, i: F.when(~F.array_contains(places, i), t))
    return out.select(F.substring_index("split", "|", -1).alias("id"), F.substring_index("split", "|", 1).alias("usage"), F.col("severity").alias("level"), "k", L.brace_view(hidden, view).alias("source"), L.brace_target(F.col("gold_tokens"), F.col("ops_per_word")).alias("target"))


def early_stop(log: DataFrame, patience: int) -> DataFrame:
    """epoch, loss, best (so far), since (epochs without a new best), stop (from where training would have ended); a log has
    few rows."""
    order = Window.orderBy("epoch")
    rows = log.withColumn("best", F.min("loss").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("at", F.max(F.when(F.col("loss") == F.col("best"), F.col("epoch"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select("epoch", "loss", "best", (F.col("epoch") - F.col("at")).alias("since"), (F.max(F.col("epoch") - F.col("at")).over(order.rowsBetween(Window.unboundedPreceding, 0)) >= patience).alias("stop"))


def log_pivot(log: DataFrame, kinds: list[str], value: str = "loss") -> DataFrame:
    return log.groupBy("epoch").pivot("kind", kinds).agg(F.avg(value))
