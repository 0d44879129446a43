"""Calibrated damage: nested spans around an anchor, and altered or dropped words in them.

A word's plan depends on the sentence, the place and the seed, not on the level, so it's made once for the widest span;
each level is a filter. Draws are hashes (native mode); replay mode repeats a stream of Python's random module.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmend.functions import text as T
from textmend.functions.draws import below, uniform
from textmend.schemas import CONFIG, LEVELS, WORD_PLAN

# Look-alike characters for those without an entry in the calibrated table.
LOOK_ALIKE = {"O": "0", "0": "O", "l": "1", "1": "l", "I": "l", "S": "5", "5": "S", "B": "8", "8": "B", "G": "6", "Z": "2", "m": "rn", "d": "cl", "e": "c", "c": "e", "o": "e", "a": "o", "u": "n", "n": "u", "h": "b", "r": "t", "t": "f"}
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def settings(op_mix: dict, config: dict = CONFIG) -> dict:
    """The configuration with the share of deletions from a calibration."""
    return config | {"p_deletion": round(op_mix["deletion"] / (op_mix["substitution"] + op_mix["deletion"]), 2)}


def confusion_table(confusions: list[tuple[str, str, int]]) -> dict[str, list[tuple[str, int]]]:
    """(gold, other, count) as lists by gold character; deletions are left out."""
    out: dict = {}
    for gold, other, count in confusions:
        if other:
            if len(gold) != 1:
                raise ValueError(f"more than one character: {gold!r}")
            out.setdefault(gold, []).append((other, count))
    return out


def level_size(n: Column, level: Column) -> Column:
    """Damaged words of a sentence of n words, rounded half up."""
    percent = F.when(level.isin("10", "25", "50", "75"), level.cast("int"))
    return F.when(level == "0", 0).when(level == "1w", 1).otherwise(F.floor((percent * n + 50) / 100)).cast("int")


def span_start(n: Column, anchor: Column, k: Column) -> Column:
    return F.least(F.greatest(anchor - F.floor(k / 2), F.lit(0)), n - k).cast("int")


def anchor_of(facts: Column, seed: int, ident: Column) -> Column:
    return F.get(facts, below(F.size(facts), seed, "anchor", ident))


def choices_of(table: dict, c: str) -> tuple[list[tuple[str, int]], str | None]:
    """What may stand for a character, with counts, and where that comes from: its own entry in the table, the one of its
    small letter in capitals, or a look-alike."""
    if table.get(c):
        return table[c], "table"
    capitals = [(big, n) for o, n in table.get(c.lower(), ()) if (big := o.upper()) != c] if c.isupper() else []
    if capitals:
        return capitals, "table_casefold"
    return ([(LOOK_ALIKE[c], 1)], "fallback_map") if c in LOOK_ALIKE else ([], None)


def substitutes(table: dict) -> Column:
    """For each character that has them, its choices with cumulative counts."""
    entries = []
    for c in sorted({*table, *(x for x in map(str.upper, table) if len(x) == 1), *LOOK_ALIKE}):
        found, source = choices_of(table, c)
        if not found:
            continue
        upto, choices = 0, []
        for o, n in found:
            upto += n
            choices.append(F.struct(F.lit(o).alias("dst"), F.lit(upto).cast("long").alias("upto")))
        entries += [F.lit(c), F.struct(F.lit(source).alias("source"), F.lit(upto).cast("long").alias("total"), F.array(*choices).alias("choices"))]
    return F.create_map(*entries)


def plan_words(rows: DataFrame, table: dict, cfg: dict = CONFIG) -> DataFrame:
    """Adds plan; rows: id, idx, token, is_anchor. Marks only: dropped; else dropped with drop_prob (never the anchor); else
    round(p * n) of its n letters and digits are deleted (at most max_deletions) or replaced."""
    seed, key = cfg["seed"], (F.col("id"), F.col("idx"))
    chars = F.split("token", "")
    rows = rows.withColumn("_c", chars).withColumn("_alnum", F.filter(F.sequence(F.lit(0), F.size("_c") - 1), lambda i: F.get("_c", i).rlike(r"^[\p{L}\p{N}]$")))
    n = F.size("_alnum")
    low, high = cfg["intensity_low"], cfg["intensity_high"]
    p = F.lit(low) + uniform(seed, "intensity", *key) * (high - low)
    m = F.least(n, F.greatest(F.lit(1), F.floor(p * n + 0.5).cast("int")))
    dropped = (n == 0) | (~F.col("is_anchor") & (uniform(seed, "drop", *key) < cfg["drop_prob"]))
    rows = rows.withColumn("_dropped", dropped).withColumn("_m", m)
    ranked = F.array_sort(F.transform("_alnum", lambda i: F.struct(uniform(seed, "position", *key, i).alias("u"), i.alias("i"))))
    rows = rows.withColumn("_at", F.array_sort(F.transform(F.slice(ranked, 1, F.col("_m")), lambda s: s["i"])))
    cap = F.least(F.lit(cfg["max_deletions"]), F.size("_alnum") - 1, F.col("_m"))
    wish = F.transform("_at", lambda i: F.struct(i.alias("i"), (uniform(seed, "kind", *key, i) < cfg["p_deletion"]).alias("del")))
    rows = rows.withColumn("_wish", wish)
    earlier = lambda j: F.size(F.filter(F.slice("_wish", 1, j), lambda w: w["del"]))
    subs = substitutes(table)

    def op(w: Column, j: Column) -> Column:
        i = w["i"]
        c = F.get("_c", i)
        entry = F.try_element_at(subs, c)
        pick = below(entry["total"], seed, "choice", *key, i)
        choice = F.element_at(F.filter(entry["choices"], lambda o: o["upto"] > pick), 1)["dst"]
        pool = F.when(c.rlike(r"^\p{Ll}"), F.lit(LOWER)).when(c.rlike(r"^\p{Lu}"), F.lit(UPPER)).otherwise(F.lit(DIGITS))
        other = F.replace(pool, c, F.lit(""))
        any_other = F.substring(other, below(F.char_length(other), seed, "random", *key, i) + 1, F.lit(1))
        delete = w["del"] & (earlier(j) < cap)
        new = F.when(entry.isNotNull(), choice).otherwise(any_other)
        source = F.when(entry.isNotNull(), entry["source"]).otherwise(F.lit("fallback_random"))
        return F.struct(i.alias("i"), F.when(delete, "del").otherwise("sub").alias("kind"), c.alias("src"), F.when(~delete, new).alias("dst"), F.when(~delete, source).alias("source"))

    rows = rows.withColumn("_ops", F.transform("_wish", op))
    made = F.map_from_entries(F.transform("_ops", lambda o: F.struct(o["i"].alias("k"), F.coalesce(o["dst"], F.lit("")).alias("v"))))
    out = T.let(made, lambda m: F.array_join(F.transform("_c", lambda c, i: F.coalesce(F.try_element_at(m, i), c)), ""))
    ops = F.transform("_ops", lambda o: F.struct(o["kind"].alias("kind"), o["src"].alias("src"), o["dst"].alias("dst"), o["source"].alias("source")))
    gone = F.col("_dropped")
    plan = F.struct(
        F.col("idx").cast("int").alias("idx"), F.col("token").alias("gold"), F.when(gone, "").otherwise(out).alias("out"),
        F.when(gone, F.array().cast("array<struct<kind:string,src:string,dst:string,source:string>>")).otherwise(ops).alias("ops"),
        F.when(~gone, F.col("_m") / F.size("_alnum")).alias("intensity"), gone.alias("dropped"),
    )
    return rows.withColumn("plan", plan).drop("_c", "_alnum", "_dropped", "_m", "_at", "_wish", "_ops")


def replay_plan(ident: str, idx: int, token: str, table: dict, cfg: dict, allow_drop: bool, seed_of) -> dict:
    """A word's plan from a stream of Python's generator: drop, intensity, positions, kinds, then a choice for each
    replaced character. seed_of(ident, idx) seeds the stream."""
    stream = random.Random(seed_of(ident, idx))
    able = [i for i, c in enumerate(token) if c.isalnum()]
    roll = stream.random()
    gone = not able or (allow_drop and roll < cfg["drop_prob"])
    if gone:
        return {"idx": idx, "gold": token, "out": "", "ops": [], "intensity": None, "dropped": True}
    share = stream.uniform(cfg["intensity_low"], cfg["intensity_high"])
    count = max(1, min(len(able), int(share * len(able) + 0.5)))
    where = sorted(stream.sample(able, count))
    wants = [stream.random() < cfg["p_deletion"] for _ in where]
    spare = min(cfg["max_deletions"], len(able) - 1, count)
    letters, ops = list(token), []
    for place, delete in zip(where, wants):
        c = token[place]
        if delete and spare > 0:
            spare -= 1
            letters[place] = ""
            ops.append({"kind": "del", "src": c, "dst": None, "source": None})
            continue
        options, source = choices_of(table, c)
        if source == "fallback_map":  # draws nothing
            new = options[0][0]
        elif options:
            new = stream.choices([o for o, _ in options], weights=[n for _, n in options])[0]
        else:
            alphabet = LOWER if c.islower() else UPPER if c.isupper() else DIGITS
            new, source = stream.choice(alphabet.replace(c, "")), "fallback_random"
        letters[place] = new
        ops.append({"kind": "sub", "src": c, "dst": new, "source": source})
    return {"idx": idx, "gold": token, "out": "".join(letters), "ops": ops, "intensity": count / len(able), "dropped": False}


def replay_words(rows: DataFrame, table: dict, cfg: dict = CONFIG) -> DataFrame:
    """plan_words in replay mode."""
    import hashlib

    def seed_of(ident: str, idx: int) -> int:
        return int.from_bytes(hashlib.sha256(f"{cfg['seed']}:word:{ident}:{idx}".encode()).digest()[:8], "big")

    names = rows.columns

    def plans(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(plan=[replay_plan(i, int(x), t, table, cfg, not a, seed_of) for i, x, t, a in zip(f["id"], f["idx"], f["token"], f["is_anchor"])])[[*names, "plan"]]

    from pyspark.sql.types import StructField, StructType

    return rows.mapInPandas(plans, StructType([*rows.schema, StructField("plan", WORD_PLAN)]))


def spans(sample: DataFrame, levels: list[str] = LEVELS, seed: int = CONFIG["seed"]) -> DataFrame:
    """A row for each sentence and level: tokens, anchor_idx, k, span_start, span_end (null at level 0). The levels are an
    array that's exploded: no join."""
    tokens = T.words(F.col("gold_text"))
    rows = sample.withColumn("gold_tokens", tokens).withColumn("anchor_idx", anchor_of(F.col("fact_idx"), seed, F.col("id")))
    rows = rows.withColumn("severity", F.explode(F.array(*map(F.lit, levels))))
    n = F.size("gold_tokens")
    rows = rows.withColumn("k", level_size(n, F.col("severity")))
    start = F.when(F.col("k") > 0, span_start(n, F.col("anchor_idx"), F.col("k")))
    return rows.withColumn("span_start", start).withColumn("span_end", start + F.col("k"))


def build_damage(sample: DataFrame, table: dict, cfg: dict = CONFIG, levels: list[str] = LEVELS, planner=plan_words) -> DataFrame:
    """Damage records of all sentences and levels. sample: id, doc_id, gold_text, band, fact_idx, split.

    Words of the widest span are planned once, gathered by sentence (bounded by its length), joined to it and cut for each
    level; what is sent doesn't grow with the levels. sample is read twice: one that is dear to make should be written."""
    widest = spans(sample, [levels[-1]], cfg["seed"])
    words = widest.select("id", "anchor_idx", F.explode(F.sequence("span_start", F.col("span_end") - 1)).alias("idx"), "gold_tokens")
    words = words.select("id", "idx", F.get("gold_tokens", F.col("idx")).alias("token"), (F.col("idx") == F.col("anchor_idx")).alias("is_anchor"))
    plans = planner(words, table, cfg).groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("idx"), F.col("plan")))).alias("plans"))
    parts = int(sample.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: few bytes are much work here
    # all that depends on a sentence and a level is made before the join: behind it, Spark would make it anew for each plan
    base = sample.withColumn("gold_tokens", T.words(F.col("gold_text"))).withColumn("anchor_idx", anchor_of(F.col("fact_idx"), cfg["seed"], F.col("id")))
    n, cuts = F.size("gold_tokens"), []
    for level in levels:
        k = level_size(n, F.lit(level))
        start = F.when(k > 0, span_start(n, F.col("anchor_idx"), k))
        cuts.append(F.struct(F.lit(level).alias("severity"), k.alias("k"), start.alias("span_start"), (start + k).alias("span_end")))
    rows = base.withColumn("_cuts", F.array(*cuts)).repartition(parts, "id").join(plans, "id").select("*", F.inline("_cuts"))
    inside = F.transform(F.filter("plans", lambda p: (F.col("k") > 0) & (p["idx"] >= F.col("span_start")) & (p["idx"] < F.col("span_end"))), lambda p: p["plan"])
    rows = rows.withColumn("ops_per_word", inside)
    dropped = F.map_from_entries(F.transform("ops_per_word", lambda p: F.struct(p["idx"].alias("k"), p["out"].alias("v"))))
    text = T.let(dropped, lambda m: F.array_join(F.filter(F.transform("gold_tokens", lambda t, i: F.coalesce(F.try_element_at(m, i), t)), lambda t: t != ""), " "))
    places = F.transform("ops_per_word", lambda p: p["idx"])
    facts = F.filter("fact_idx", lambda i: F.array_contains(places, i))
    return rows.select(
        "id", "doc_id", "gold_text", "gold_tokens", "band", "severity", "k", (F.col("k") / F.size("gold_tokens")).alias("frac"), "anchor_idx", "span_start", "span_end",
        places.alias("damaged_idx"), "ops_per_word", text.alias("corrupted_text"), places.alias("mask_positions"), facts.alias("fact_idx_in_span"), F.lit(cfg["seed"]).alias("seed"), "split",
    )


def mark_damage(tokens: Column, plans: Column) -> Column:
    """The damaged sentence, damaged words in [[ ]]."""
    out = F.map_from_entries(F.transform(plans, lambda p: F.struct(p["idx"].alias("k"), F.concat(F.lit("[["), p["out"], F.lit("]]")).alias("v"))))
    return T.let(out, lambda m: F.array_join(F.transform(tokens, lambda t, i: F.coalesce(F.try_element_at(m, i), t)), " "))


def damage_stats(damage: DataFrame) -> DataFrame:
    """What the damage of the given records looks like; one row."""
    p = damage.select("anchor_idx", F.explode("ops_per_word").alias("p")).select("anchor_idx", "p.*")
    alnum = F.char_length(F.regexp_replace("gold", r"[^\p{L}\p{N}]", ""))
    p = p.withColumn("n", alnum).withColumn("dels", F.size(F.filter("ops", lambda o: o["kind"] == "del")))
    share = lambda c, of: F.try_divide(F.sum(F.when(of, c.cast("int"))), F.count_if(of))
    from_source = lambda s: F.size(F.filter("ops", lambda o: o["source"] == s))
    sources = {s: from_source(s) for s in ("table", "table_casefold", "fallback_map", "fallback_random")}
    subs = F.sum(F.size("ops") - F.col("dels"))
    kept = ~F.col("dropped")
    bins = {"1_3": (1, 3), "4_6": (4, 6), "7": (7, 10**6)}
    return p.agg(
        F.count("*").alias("damaged_words"),
        F.avg(F.col("dropped").cast("int")).alias("share_dropped"),
        F.try_divide(F.sum("dels"), F.sum(F.size("ops"))).alias("deletion_share"),
        *(F.try_divide(F.sum(c), subs).alias(f"source_{s}") for s, c in sources.items()),
        *(F.avg(F.when(kept & F.col("n").between(lo, hi), F.col("intensity"))).alias(f"intensity_{b}") for b, (lo, hi) in bins.items()),
        share(F.col("dropped"), F.col("idx") == F.col("anchor_idx")).alias("anchor_dropped"),
        share(F.col("dropped"), F.col("idx") != F.col("anchor_idx")).alias("other_dropped"),
        F.count_if(F.col("gold").rlike(T.DIGIT)).alias("digit_words"),
        F.count_if(F.col("n") == 0).alias("no_alnum"),
    )


def cer_by_level(damage: DataFrame) -> DataFrame:
    """Character error rate of whole sentences by level."""
    rate = F.levenshtein("gold_text", "corrupted_text") / F.char_length("gold_text")
    q = F.percentile("r", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    rows = damage.select("severity", rate.alias("r")).groupBy("severity").agg(F.avg("r").alias("mean"), q.alias("q"))
    return rows.select("severity", "mean", F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(2)).alias("q3"))


def review_table(damage: DataFrame) -> DataFrame:
    facts = F.array_join(F.transform("fact_idx_in_span", lambda i: F.get("gold_tokens", i)), ", ")
    return damage.select("id", F.col("severity").alias("level"), "band", "k", facts.alias("facts"), "gold_text", mark_damage(F.col("gold_tokens"), F.col("ops_per_word")).alias("damaged"))
