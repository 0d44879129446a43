"""Scores of repairs, intervals and paired tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmend.functions import text as T
from textmend.functions.draws import below
from textmend.operators import slots as L

#: (numerator, denominator); without one every sentence counts the same.
METRICS = {
    "fact recovery": ("fact_recovery", None), "anchor recovery": ("anchor_ok", None), "visible fact slots": ("visible_facts_ok", "visible_facts"),
    "dropped fact slots": ("dropped_facts_ok", "dropped_facts"), "exact words": ("exact", None), "CER before": ("edits_before", "gold_chars"),
    "CER after": ("edits_after", "gold_chars"), "repair gain": ("edits_saved", "gold_chars"),
}


def format_ok(answers: Column, k: Column) -> Column:
    return F.coalesce((F.size(answers) == k) & ~F.exists(answers, lambda a: a.isNull()), F.lit(False))


def right(plans: Column, answers: Column) -> Column:
    """Whether each answer has its word's core."""
    return F.zip_with(L.by_place(plans), answers, lambda p, a: T.slot_core(a) == T.slot_core(p["gold"]))


def slot_exact(plans: Column, answers: Column) -> Column:
    """Share of right answers; 0 if their number or a null is wrong."""
    good = format_ok(answers, F.size(plans)) & (F.size(plans) > 0)
    return F.when(good, F.size(F.filter(right(plans, answers), lambda r: r)) / F.size(plans)).otherwise(F.lit(0.0))


def row_scores(rows: DataFrame) -> DataFrame:
    """rows: damage records with method and pred_words (null: a failure, scored as no repair) and all scores of the span."""
    plans = L.by_place(F.col("ops_per_word"))
    rows = rows.withColumn("_plans", plans).withColumn("_ok", F.col("pred_words").isNotNull())
    damaged = F.transform("_plans", lambda p: p["out"])
    rows = rows.withColumn("_words", F.coalesce("pred_words", damaged))
    hits = F.zip_with("_plans", "_words", lambda p, a: F.col("_ok") & (T.slot_core(a) == T.slot_core(p["gold"])))
    rows = rows.withColumn("_right", F.zip_with("_plans", hits, lambda p, r: F.struct(r.alias("r"), p["dropped"].alias("d"), F.array_contains("fact_idx_in_span", p["idx"]).alias("f"), (p["idx"] == F.col("anchor_idx")).alias("a"))))
    tokens, moved = L.span_parts(F.col("gold_tokens"), F.col("_plans"), F.col("span_start"), F.col("span_end"))
    rows = rows.withColumn("gold_span", F.array_join(tokens, " ")).withColumn("damaged_span", L.splice(tokens, moved, damaged)).withColumn("repaired_span", L.splice(tokens, moved, F.col("_words")))
    count = lambda test: F.size(F.filter("_right", test))
    rows = rows.withColumn("edits_before", F.levenshtein("damaged_span", "gold_span")).withColumn("edits_after", F.levenshtein("repaired_span", "gold_span")).withColumn("gold_chars", F.char_length("gold_span"))
    return rows.select(
        "method", F.col("severity").alias("level"), "id", "band", F.col("_ok").alias("format_ok"), "gold_span", "damaged_span", "repaired_span",
        L.splice(F.col("gold_tokens"), F.col("_plans"), F.col("_words")).alias("repaired_sentence"), slot_exact(F.col("_plans"), F.col("pred_words")).alias("exact"),
        F.try_divide(count(lambda s: s["f"] & s["r"]), count(lambda s: s["f"])).alias("fact_recovery"), F.exists("_right", lambda s: s["a"] & s["r"]).alias("anchor_ok"),
        count(lambda s: s["f"] & ~s["d"]).alias("visible_facts"), count(lambda s: s["f"] & ~s["d"] & s["r"]).alias("visible_facts_ok"),
        count(lambda s: s["f"] & s["d"]).alias("dropped_facts"), count(lambda s: s["f"] & s["d"] & s["r"]).alias("dropped_facts_ok"),
        "gold_chars", "edits_before", "edits_after", (F.col("edits_before") - F.col("edits_after")).alias("edits_saved"),
        F.try_divide("edits_before", "gold_chars").alias("cer_before"), F.try_divide("edits_after", "gold_chars").alias("cer_after"),
    )


def with_no_repair(damage: DataFrame, predictions: DataFrame) -> DataFrame:
    """Damage records with each method's answers, and once as they are (method 'no repair')."""
    kept = predictions.select("id", "severity", "method", "pred_words")
    base = damage.where("k > 0")
    return base.join(kept, ["id", "severity"]).unionByName(base.withColumn("method", F.lit("no repair")).withColumn("pred_words", F.lit(None).cast("array<string>")))


def complete_methods(expected: DataFrame, predictions: DataFrame) -> DataFrame:
    """method, missing: how many expected keys (id, severity) it lacks; only methods with 0 are scored."""
    total = expected.select("id", "severity").distinct()
    have = predictions.select("method", "id", "severity").distinct().join(total, ["id", "severity"], "left_semi").groupBy("method").agg(F.count("*").alias("have"))
    methods = predictions.select("method").distinct().join(have, "method", "left")
    return methods.crossJoin(total.agg(F.count("*").alias("want"))).select("method", (F.col("want") - F.coalesce("have", F.lit(0))).alias("missing"))


def long_metrics(scores: DataFrame, metrics: dict = METRICS) -> DataFrame:
    """method, level, id, metric, num, den."""
    stack = ", ".join(f"'{m}', cast({n} as double), {f'cast({d} as double)' if d else '1.0D'}" for m, (n, d) in metrics.items())
    return scores.selectExpr("method", "level", "id", f"stack({len(metrics)}, {stack}) as (metric, num, den)")


def value_vectors(long: DataFrame, expected: DataFrame) -> DataFrame:
    """method, level, metric, num, den: values in the order of ids, the same for all groups. A group that lacks one of the
    expected ids, or has one twice, ends the query with an error. A group's sentences are held in one row."""
    rows = long.groupBy("method", "level", "metric").agg(F.array_sort(F.collect_list(F.struct("id", "num", "den"))).alias("v"))
    want = expected.select("id").distinct().agg(F.array_sort(F.collect_list("id")).alias("want"))
    ids = F.transform("v", lambda x: x["id"])
    ok = F.when(ids == F.col("want"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("incomplete: "), "method", F.lit(" "), "level")).cast("boolean"))
    return rows.crossJoin(F.broadcast(want)).where(ok).select("method", "level", "metric", F.transform("v", lambda x: x["num"]).alias("num"), F.transform("v", lambda x: x["den"]).alias("den"))


def bootstrap(long: DataFrame, draws: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """method, level, metric, value, low, high: sum(num) / sum(den) and a percentile interval over resampled sentences.

    The draws are the same for every group, so methods are compared on the same resampled sets: sentences of a group are
    taken in the order of their ids. One task a group holds its sentences as two vectors; resamples are made in blocks."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id")
        num, den = f["num"].to_numpy(float), f["den"].to_numpy(float)
        n, stats, rng = len(f), [], np.random.default_rng(seed)
        block = max(1, (1 << 22) // n)
        for at in range(0, draws, block):
            pick = rng.integers(0, n, size=(min(block, draws - at), n))
            top, bottom = num[pick].sum(axis=1), den[pick].sum(axis=1)
            stats.append(top[bottom > 0] / bottom[bottom > 0])
        s = np.concatenate(stats)
        low, high = np.quantile(s, [alpha / 2, 1 - alpha / 2]) if len(s) else (None, None)
        value = num.sum() / den.sum() if den.sum() > 0 else None
        return pd.DataFrame([{"method": f["method"].iloc[0], "level": f["level"].iloc[0], "metric": f["metric"].iloc[0], "value": value, "low": low, "high": high}])

    return long.groupBy("method", "level", "metric").applyInPandas(one, "method string, level string, metric string, value double, low double, high double")


def hash_bootstrap(values: DataFrame, draws: int, seed: int, by: list[str]) -> DataFrame:
    """The same with draws that SQL can repeat: value pos in 0..n-1, num, den by group; for few draws. Each drawn place meets
    its row by an equi-join on group and place."""
    sizes = values.groupBy(*by).agg(F.count("*").alias("n"))
    grid = sizes.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    grid = grid.withColumn("pos", below(F.col("n"), seed, "boot", F.col("b"), F.col("i")))
    stats = grid.join(values, [*by, "pos"]).groupBy(*by, "b").agg(F.sum("num").alias("s"), F.sum("den").alias("d")).where("d > 0").withColumn("x", F.col("s") / F.col("d"))
    q = stats.groupBy(*by).agg(F.percentile("x", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    point = values.groupBy(*by).agg(F.try_divide(F.sum("num"), F.sum("den")).alias("value"))
    return point.join(q, by, "left").select(*by, "value", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))


def mcnemar_p(a: Column, b: Column) -> Column:
    """Two-sided exact p of a and b discordant rows: 2 * sum of C(n, i) / 2**n for i up to the smaller, in logarithms."""

    @F.pandas_udf("double")
    def p(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(u: int, v: int) -> float:
            n = u + v
            if not n:
                return 1.0
            logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(min(u, v) + 1)]
            return min(1.0, 2 * math.fsum(map(math.exp, logs)))

        return pd.Series([one(int(u), int(v)) for u, v in zip(x, y)])

    return p(a, b)


def discordant(rows: DataFrame, by: list[str], a: str = "a_ok", b: str = "b_ok") -> DataFrame:
    return rows.groupBy(*by).agg(F.count_if(F.col(a) & ~F.col(b)).alias("only_a"), F.count_if(~F.col(a) & F.col(b)).alias("only_b"))


def signed_ranks(diffs: DataFrame, by: list[str]) -> DataFrame:
    """by, n, higher, lower, w_plus, w_minus, ties (sum of t**3 - t): average ranks of non-zero differences d."""
    rows = diffs.where("d <> 0").withColumn("m", F.abs("d"))
    # ranks by counting each different size once: groups stay small, however many rows share a size
    sizes = rows.groupBy(*by, "m").agg(F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"))
    t = F.col("up") + F.col("down")
    before = F.coalesce(F.sum(t).over(Window.partitionBy(*by).orderBy("m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("rank", before + (t + 1) / 2)
    return sizes.groupBy(*by).agg(F.sum(t).alias("n"), F.sum("up").alias("higher"), F.sum("down").alias("lower"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * F.col("down")).alias("w_minus"), F.sum(t * t * t - t).alias("ties"))


def wilcoxon_p(ranks: DataFrame) -> DataFrame:
    """Adds p: exact for up to 50 differences without ties, else the normal approximation with tie correction."""

    @F.pandas_udf("double")
    def p(n: pd.Series, w: pd.Series, ties: pd.Series) -> pd.Series:
        def one(m: int, least: float, tie: float) -> float:
            if not m:
                return 1.0
            if m <= 50 and not tie:
                ways = [1] + [0] * (m * (m + 1) // 2)
                for k in range(1, m + 1):
                    for s in range(len(ways) - 1, k - 1, -1):
                        ways[s] += ways[s - k]
                return min(1.0, 2 * sum(ways[: int(least) + 1]) / 2**m)
            mean, var = m * (m + 1) / 4, m * (m + 1) * (2 * m + 1) / 24 - tie / 48
            return min(1.0, math.erfc(abs(least - mean) / math.sqrt(2 * var))) if var > 0 else 1.0

        return pd.Series([one(int(a), float(b), float(c)) for a, b, c in zip(n, w, ties)])

    return ranks.withColumn("p", p("n", F.least("w_plus", "w_minus"), "ties"))


def holm(tests: DataFrame, family: list[str], p: str = "p", key: list[str] | None = None) -> DataFrame:
    """Adds p_holm within each family; key breaks ties."""
    order = Window.partitionBy(*family).orderBy(p, *(key or []))
    step = (F.count("*").over(Window.partitionBy(*family)) - F.row_number().over(order) + 1) * F.col(p)
    rows = tests.withColumn("_step", step)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("p_holm", F.least(F.lit(1.0), F.max("_step").over(upto))).drop("_step")


def wrong_rate(rows: DataFrame, by: list[str], score: str = "score", ok: str = "ok") -> DataFrame:
    """Chance that a wrong row scores at least as high as a right one, ties half: ranks by distinct score, no pairs. Null if
    either group is empty."""
    sizes = rows.groupBy(*by, score).agg(F.count_if(F.col(ok)).alias("right"), F.count_if(~F.col(ok)).alias("wrong"))
    below_ = F.coalesce(F.sum("right").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("wins", F.col("wrong") * (below_ + F.col("right") / 2))
    return sizes.groupBy(*by).agg(F.try_divide(F.sum("wins"), F.sum("right") * F.sum("wrong")).alias("wrong_rate"))


def paired(scores: DataFrame, pairs: list[tuple[str, str]], metric: str) -> DataFrame:
    """first, second, level, id, a, b, d for each pair of methods; the pairs are a short list."""
    out = None
    for x, y in pairs:
        a = scores.where(F.col("method") == x).select("level", "id", F.col(metric).cast("double").alias("a"))
        b = scores.where(F.col("method") == y).select("level", "id", F.col(metric).cast("double").alias("b"))
        one = a.join(b, ["level", "id"]).select(F.lit(x).alias("first"), F.lit(y).alias("second"), "level", "id", "a", "b", (F.col("a") - F.col("b")).alias("d"))
        out = one if out is None else out.unionAll(one)
    return out


def paired_tests(scores: DataFrame, pairs: list[tuple[str, str]], binary: str = "anchor_ok", graded: str = "fact_recovery") -> DataFrame:
    """McNemar on binary and Wilcoxon on graded for each pair and level, each family adjusted over all of them."""
    by = ["first", "second", "level"]
    m = discordant(paired(scores, pairs, binary).withColumn("a_ok", F.col("a") > 0).withColumn("b_ok", F.col("b") > 0), by)
    m = holm(m.withColumn("p", mcnemar_p(F.col("only_a"), F.col("only_b"))), [], "p", by).withColumnsRenamed({"p": "mcnemar_p", "p_holm": "mcnemar_holm"})
    w = m.select(*by).join(signed_ranks(paired(scores, pairs, graded), by), by, "left").fillna(0)
    w = holm(wilcoxon_p(w), [], "p", by).select(*by, "higher", "lower", F.col("p").alias("wilcoxon_p"), F.col("p_holm").alias("wilcoxon_holm"))
    return m.join(w, by)


def paired_summary(diffs: DataFrame, by: list[str], eps: float = 1e-9) -> DataFrame:
    return diffs.groupBy(*by).agg(F.avg("d").alias("mean"), F.count_if(F.col("d") > eps).alias("better"), F.count_if(F.abs("d") <= eps).alias("same"), F.count_if(F.col("d") < -eps).alias("worse"))


def interval_table(ci: DataFrame, metric: str, methods: list[str]) -> DataFrame:
    """Cells 'value [low, high]' by level and method."""
    cell = F.format_string("%.2f [%.2f, %.2f]", "value", "low", "high")
    return ci.where(F.col("metric") == metric).groupBy("level").pivot("method", methods).agg(F.first(cell))


def failures(predictions: DataFrame) -> DataFrame:
    """Answers with a wrong format by method and level, with an 'all' row."""
    return predictions.rollup("method", "severity").agg(F.count_if(~F.col("format_ok")).alias("failures"), F.count("*").alias("rows")).where("method is not null").select("method", F.coalesce("severity", F.lit("all")).alias("level"), "failures", "rows")


def fact_slots(damage: DataFrame) -> DataFrame:
    """Fact slots by level: all, visible and dropped ones, and the mean of a sentence."""
    facts = F.filter("ops_per_word", lambda p: F.array_contains(F.col("fact_idx_in_span"), p["idx"]))
    rows = damage.where("k > 0").select("severity", F.size(facts).alias("n"), F.size(F.filter(facts, lambda p: p["dropped"])).alias("gone"))
    return rows.groupBy("severity").agg(F.sum("n").alias("fact_slots"), F.sum(F.col("n") - F.col("gone")).alias("visible"), F.sum("gone").alias("dropped"), F.avg("n").alias("per_sentence"))


def parse_cell(cell: Column) -> Column:
    """value, low and high of a cell 'value [low, high]'; nulls if it isn't one."""
    part = lambda i: F.regexp_extract(cell, r"^\s*(-?[0-9.]+)\s*\[\s*(-?[0-9.]+)\s*,\s*(-?[0-9.]+)\s*\]\s*$", i).try_cast("double")
    return F.struct(part(1).alias("value"), part(2).alias("low"), part(3).alias("high"))


def level_grid(rows: DataFrame, column: str, kinds: list, value: str) -> DataFrame:
    """Means of value by level, a column for each kind."""
    return rows.groupBy("level").pivot(column, kinds).agg(F.avg(value))


def letter_scores(scores: DataFrame) -> DataFrame:
    """method, level, pair_id, gold, text: the texts that an injected scorer compares, damaged and repaired."""
    both = lambda name: scores.select("method", "level", F.col("id").alias("pair_id"), F.lit(name).alias("of"), F.col("gold_span").alias("gold"), F.col(f"{name}_span").alias("text"))
    return both("damaged").unionAll(both("repaired"))


def valid_means(scores: DataFrame, metric: str) -> DataFrame:
    return scores.where("format_ok").groupBy("method", "level").agg(F.count("*").alias("n"), F.avg(F.col(metric).cast("double")).alias("mean"))


def band_pivot(scores: DataFrame, metric: str, columns: list[str]) -> DataFrame:
    """Means by level; a column for each 'band method'."""
    return scores.withColumn("c", F.concat_ws(" ", "band", "method")).groupBy("level").pivot("c", columns).agg(F.avg(F.col(metric).cast("double")))


def describe(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """min, quartiles, max, exactly."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    rows = df.groupBy(*(by or [])).agg(F.min(column).alias("min"), q.alias("q"), F.max(column).alias("max"))
    return rows.select(*(by or []), "min", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q3"), "max")


def greedy_match(pairs: DataFrame) -> DataFrame:
    """pair_id, precision, recall, f1 of two sets of token vectors (a, b: arrays of unit vectors), each vector with its best
    partner: the scoring step of an injected embedding model."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0).cast("double"), lambda s, z: s + z)
    best = lambda xs, ys: F.aggregate(F.transform(xs, lambda x: F.array_max(F.transform(ys, lambda y: dot(x, y)))), F.lit(0.0).cast("double"), lambda s, z: s + z) / F.size(xs)
    rows = pairs.select("pair_id", best(F.col("a"), F.col("b")).alias("precision"), best(F.col("b"), F.col("a")).alias("recall"))
    return rows.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def side_by_side(rows: DataFrame, key: list[str], methods: list[str], text: str = "repaired_sentence") -> DataFrame:
    """A column of texts for each method."""
    return rows.groupBy(*key).pivot("method", methods).agg(F.first(text))


def recap(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """(place, quantity, value) of several one-row tables, for a list of the numbers a report uses."""
    out = None
    for place, df in parts:
        pairs = ", ".join(f"'{c}', cast(`{c}` as string)" for c in df.columns)
        one = df.selectExpr(f"'{place}' as place", f"stack({len(df.columns)}, {pairs}) as (quantity, value)")
        out = one if out is None else out.unionAll(one)
    return out
