"""How often rows that are dear to make are made, and that no task takes more than its part."""

import random

from pyspark.sql import functions as F

from textmend.functions import text as T
from textmend.operators import damage as D
from textmend.operators import lexicon as X
from textmend.operators import pool as P
from textmend.schemas import SENTENCE
from textmend.sources import store as Z


def counted(df, made):
    """df, whose rows are counted whenever they are made."""

    def each(frames):
        for f in frames:
            made.add(len(f))
            yield f

    return df.mapInPandas(each, df.schema)


def sentences(spark, n=40):
    rows = [(f"{i}-000", str(i), "In 1850 Miss Smith of York " + "went on to the old house " * 2 + "went on to the house", 21, "20-29", [1, 3, 5], 3) for i in range(n)]
    return spark.createDataFrame(rows, SENTENCE)


def plain_positions(tokens):
    """The rule on each token, one by one."""
    flags = F.zip_with(tokens, F.concat(F.array(F.lit(None).cast("string")), tokens), lambda t, b: F.coalesce(T.is_fact(t, b), F.lit(False)))
    return F.filter(F.transform(flags, lambda f, i: F.when(f, i)), lambda i: i.isNotNull())


def test_fact_positions(spark):
    texts = ["The Cat sat: On I I. (I) it İ ÉTÉ élan £ 5d x² ٣ \u0001 a\u0001B _A __ 'Tis MR Mr. Sir Q ǅ ⁷ ½ Ⅷ", "", None, "a", "A", "a A", "£5 5", "x: Y Z", "I A I"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("w", T.words(F.col("t")))
    for r in df.select("t", T.fact_positions(F.col("w")).alias("a"), plain_positions(F.col("w")).alias("b")).collect():
        assert r.a == r.b, r.t
    assert df.select(T.fact_positions(F.lit(None).cast("array<string>")).alias("x")).first().x is None
    # few tokens are judged: the rule isn't in a step over all of them
    plan = df.select(T.fact_positions(F.col("w")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan


def test_training_pool_makes_sentences_once(spark):
    made = spark.sparkContext.accumulator(0)
    used = spark.createDataFrame([("3",)], "doc_id string")
    got = {r.usage: r.sentences for r in P.pool_summary(P.training_pool(counted(sentences(spark), made), used, 42)).collect()}
    assert got == {"val": 4, "train": 35, "total": 39} and made.value == 40


def test_probe_sample_takes_places(spark):
    pool = sentences(spark).withColumn("usage", F.when(F.col("doc_id").cast("int") < 15, "val").otherwise("train"))
    got = P.probe_sample(pool, 42)
    assert "Limit" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id for r in got.collect()} == {r.id for r in P.seeded_examples(pool.where("usage = 'train'"), 15, 42, "probe").collect()} and got.columns == pool.columns


def test_draw_sample_is_written(spark):
    made = spark.sparkContext.accumulator(0)
    sample = P.draw_sample(counted(sentences(spark), made), 6, 2, 3, 42)
    before = made.value
    assert sample.count() == 8 and len(P.review_picks(sample, ["1w", "10"], 2, 42).collect()) == 4 and made.value == before


def test_damage_is_checked_in_one_pass(spark):
    d = D.build_damage(sentences(spark).withColumnRenamed("text", "gold_text").withColumn("split", F.lit("pool")), {}).select("id", "severity", "k", "corrupted_text", "gold_text", "ops_per_word")
    made = spark.sparkContext.accumulator(0)
    assert tuple(Z.check_damage(counted(d, made), 40, 6).first()) == (0, 0, 0, 0) and made.value == 240
    bad = d.unionByName(d.where("id = '0-000' and severity = '1w'")).withColumn("corrupted_text", F.lit("x"))
    assert tuple(Z.check_damage(bad, 40, 6).first()) == (1, 40, 0, 1)
    assert tuple(Z.check_damage(d.limit(0), 0, 6).first()) == (0, 0, 0, 0)


def test_levels_are_cut_after_the_join(spark):
    """What is sent for the join doesn't grow with the levels."""
    plan = D.build_damage(sentences(spark).withColumnRenamed("text", "gold_text").withColumn("split", F.lit("pool")), {})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline(") < plan.index("Join") and plan.count("Generate inline(") == 1


def test_run_method_makes_damage_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)
    d = D.build_damage(sentences(spark).withColumnRenamed("text", "gold_text").withColumn("split", F.lit("pool")), {}, levels=["1w"])
    run = lambda: Z.run_method(counted(d, made), lambda v: {"pred_words": ["x"] * v["k"]}, "m", "1", "none", str(tmp_path / "s"))
    assert run() == 40 and made.value <= 80  # the look for test rows, and the rows themselves
    assert run() == 0


def test_far_words_meet_few_entries(spark):
    """Of the pairs of cores and entries few are compared, each core's nearest among them."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(10))
    words = [word() for _ in range(3000)]
    cores = sorted({"#" + w[1:4] + w[5:8] + "##" + w[9] for w in words[:50]})  # four edits away
    lex = spark.createDataFrame([(w, 1) for w in words], "word string, n long").repartition(3)
    for short in (16, 9):  # by what is left, and by lengths and letters
        (plan,) = X._alike(spark.createDataFrame([(c,) for c in cores], "core string"), lex, 4, short)
        assert "CartesianProduct" not in (told := plan._jdf.queryExecution().toString()) and "NestedLoop" not in told
        assert {(r.core, r.word) for r in plan.collect()} >= {(c, w) for c, w in zip(("#" + w[1:4] + w[5:8] + "##" + w[9] for w in words[:50]), words)}
    index = X._Cores(cores, 4, 16)
    assert sum(len(c) for c, _ in index.pairs(words)) < 0.02 * len(cores) * len(words)


def test_search_in_blocks(spark):
    """Blocks of cores and parts of the list change nothing; letters beyond those of the list, one word far longer, an empty core."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdé") for _ in range(n))
    words = sorted({word(rng.randrange(1, 20)) for _ in range(400)} | {"q" * 300})
    cores = sorted({word(rng.randrange(1, 24)) for _ in range(40)} | {"", "q" * 290 + "x", "xyzxyzxyzxyzx"})
    lex = spark.createDataFrame([(w, 1) for w in words], "word string, n long").repartition(3)
    df = spark.createDataFrame([(c,) for c in cores], "core string")

    def least(parts):
        rows = [r for p in parts for r in p.collect()]
        best = {c: min((r.dist for r in rows if r.core == c), default=None) for c in cores}
        return {(r.core, r.word, r.dist) for r in rows if r.dist == best[r.core]}

    pairs = df.crossJoin(lex).withColumn("dist", F.levenshtein("core", "word"))
    want = least([pairs])
    assert least(X._far(df, lex)) == want
    parts = list(X._far(df, lex, 200))
    assert len(parts) > 1
    for reach in (1, 2, 3, 5):
        near = {(r.core, r.word, r.dist) for r in pairs.where(F.col("dist") <= reach).collect()}
        for short, block in ((16, 1 << 20), (6, 1 << 20), (16, 5000)):
            assert {(r.core, r.word, r.dist) for p in X._alike(df, lex, reach, short, block) for r in p.collect()} == near
