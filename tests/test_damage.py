"""Damage, slots, repair and scores."""

import random

import pytest
from pyspark.sql import functions as F

from textmend.operators import damage as D
from textmend.operators import evaluate as E
from textmend.operators import lexicon as X
from textmend.operators import pool as P
from textmend.operators import repair as R
from textmend.operators import slots as L
from textmend.operators import training as G
from textmend.schemas import CONFIG, LEVELS
from textmend.sources import store as Z

TABLE = D.confusion_table([("e", "c", 9), ("h", "b", 6), ("m", "rn", 3), ("r", "", 4)])


@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(3)
    names = ["Smith,", "Bailey", "£5", "March", "O'Neil"]
    rows = []
    for i in range(12):
        words = ["word" + "aehmrt"[rng.randrange(6)] * rng.randrange(1, 4) for _ in range(20 + i * 3)]
        for j in (3, 9, 15):
            words[j] = names[(i + j) % 5]
        words[5] = "—"
        rows.append((f"d{i}-000", f"d{i}", " ".join(words), "20-29", [3, 9, 15], "dev"))
    return spark.createDataFrame(rows, "id string, doc_id string, gold_text string, band string, fact_idx array<int>, split string").cache()


@pytest.fixture(scope="module", params=[D.plan_words, D.replay_words])
def damage(sample, request):
    return D.build_damage(sample, TABLE, planner=request.param).cache()


def test_level_sizes(spark):
    for n in range(20, 61):
        sizes = [spark.range(1).select(D.level_size(F.lit(n), F.lit(x))).first()[0] for x in LEVELS] if n in (20, 25, 60) else None
        if sizes:
            assert sizes == sorted(set(sizes))
        if n == 25:
            assert sizes == [0, 1, 3, 6, 13, 19]


@pytest.mark.parametrize("n,anchor,k,start", [(20, 0, 15, 0), (20, 19, 15, 5), (20, 10, 5, 8)])
def test_span(spark, n, anchor, k, start):
    assert spark.range(1).select(D.span_start(F.lit(n), F.lit(anchor), F.lit(k))).first()[0] == start


def test_records(damage):
    by = {}
    for r in damage.collect():
        by.setdefault(r.id, {})[r.severity] = r
        tokens = r.gold_text.split()
        assert r.gold_tokens == tokens and len(r.ops_per_word) == r.k
        if r.k:
            assert r.span_start <= r.anchor_idx < r.span_end and r.damaged_idx == list(range(r.span_start, r.span_end))
            assert not next(p for p in r.ops_per_word if p.idx == r.anchor_idx).dropped and r.anchor_idx in r.fact_idx_in_span
        else:
            assert r.corrupted_text == r.gold_text and r.span_start is None
        out = {p.idx: p.out for p in r.ops_per_word}
        assert r.corrupted_text == " ".join(w for i, t in enumerate(tokens) if (w := out.get(i, t)))
        for p in r.ops_per_word:
            marks = lambda w: [c for c in w if not c.isalnum()]
            if p.dropped:
                assert p.out == "" and p.intensity is None
                continue
            assert p.out != p.gold and sum(o.kind == "del" for o in p.ops) <= CONFIG["max_deletions"]
            assert marks(p.out) == marks(p.gold) or any(o.source and not o.dst.isalnum() for o in p.ops)
            n = sum(c.isalnum() for c in p.gold)
            assert p.intensity == pytest.approx(len(p.ops) / n) and len(p.ops) >= 1
    for levels in by.values():
        for a, b in zip(LEVELS[1:], LEVELS[2:]):
            mine = {p.idx: p for p in levels[b].ops_per_word}
            assert all(mine[p.idx] == p for p in levels[a].ops_per_word)


def test_queries_damage_the_whole_pool(spark, tmp_path):
    from textmend.plans import queries as N

    line = "The " + "word " * 10 + "of Mr. Smith in March was sold for £{} and " + "more " * 10 + "here."
    texts = [(i, "en", " ".join(line.format(10 * i + j) for j in range(3))) for i in range(100)]
    spark.createDataFrame(texts, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sf, ids = str(tmp_path), lambda df: {r.id for r in df.select("id").distinct().collect()}
    pool = ids(N._pool(spark, sf))
    assert len(pool) > CONFIG["n_test"] + CONFIG["n_dev"]
    assert ids(N.damage_records(spark, sf)) == pool and ids(N.slot_views(spark, sf)) == pool
    assert not any(N.damage_checks(spark, sf).first()) and not any(N.splice_round_trip(spark, sf).first())


def test_round_trips(damage):
    plans = L.by_place(F.col("ops_per_word"))
    gold = L.splice(F.col("gold_tokens"), plans, F.transform(plans, lambda p: p["gold"]))
    out = L.splice(F.col("gold_tokens"), plans, F.transform(plans, lambda p: p["out"]))
    assert damage.where(gold != F.col("gold_text")).count() == 0
    assert damage.where("severity <> '0'").where(L.splice(F.col("gold_tokens"), plans, F.array(F.lit("x"))).isNotNull() & (F.col("k") != 1)).count() == 0
    assert damage.where(out.isNull()).count() == 0


def test_views(damage):
    v = L.build_slots(damage.where("severity = '10'"))
    for r in v.select("words", "slots", "k", L.slot_view(F.col("words"), F.col("slots")).alias("p"), L.numbered_view(F.col("words"), F.col("slots")).alias("n")).collect():
        assert sum(w is None for w in r.words) == len(r.slots) == r.k
        assert r.p.count("⟨") == r.k and f"⟨{r.k}: " in r.n
        assert not {"gold"} & set(r.slots[0].asDict())


@pytest.mark.parametrize("answer", ["Ltd", "Ltd.;", "Ltd.", " Ltd; "])
def test_frame(spark, answer):
    row = spark.createDataFrame([(["Wood", "and", "Ltd.;", "cart"], [(2, "Ltd.;", "Lld.;", [], 0.5, False)], [answer])], "t array<string>, p array<struct<idx:int,gold:string,out:string,ops:array<string>,intensity:double,dropped:boolean>>, a array<string>")
    assert row.select(L.splice(F.col("t"), F.col("p"), F.col("a"))).first()[0] == "Wood and Ltd.; cart"
    inner = spark.createDataFrame([(["now", "he'd", "run"], [(1, "he'd", "'d", [], 0.3, False)], ["he'd"])], row.schema)
    assert inner.select(L.splice(F.col("t"), F.col("p"), F.col("a"))).first()[0] == "now he'd run"


def test_nearest(spark):
    lex = spark.createDataFrame([("Wood", 2), ("Wold", 5), ("Woolen", 9), ("candlelight", 1)], "word string, n long")
    cores = spark.createDataFrame([("Wcod",), ("Wcod",), ("zzzzzzzzzzzzzzzzzz",)], "core string")
    rows = {r.core: r for r in X.nearest(cores, lex).collect()}
    assert (rows["Wcod"].word, rows["Wcod"].dist, rows["Wcod"].ties, rows["Wcod"].n) == ("Wood", 1, 1, 2)
    assert rows["zzzzzzzzzzzzzzzzzz"].word == "candlelight" or rows["zzzzzzzzzzzzzzzzzz"].dist == 18
    assert [r.word for r in X.closest(cores, lex, 2).where("core = 'Wcod'").orderBy("place").collect()] == ["Wood", "Wold"]
    docs = spark.createDataFrame([("a", ["Mrs. Wood, of Corn-market, owes £7."])], "doc_id string, paragraphs array<string>")
    assert {r.word for r in X.build_lexicon(docs).collect()} == {"Mrs", "Wood", "of", "Corn-market", "owes", "7"}
    assert {r.word: r.n for r in X.part_counts(X.build_lexicon(docs)).collect()}["Corn"] == 1


def test_near_words_are_all_found(spark):
    """Against brute force, with very short and very long words."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(0, 9))) for _ in range(150)] + ["q" * 5000, "a", "ab", "x" * 300]
    words = sorted(set(words) - {""})
    cores = ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))) for _ in range(60)] + ["q" * 4999 + "r", "x" * 298, "ab"]
    lex = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    got = {(r.core, r.word): r.dist for r in X._near(spark.createDataFrame([(c,) for c in cores], "core string"), lex, 2).collect()}

    def distance(a, b):
        if abs(len(a) - len(b)) > 2:
            return 9
        if len(a) > 200:
            return round((1 - R.word_similarity(a[-10:], b[-10:])) * 10) if len(a) == len(b) else len(a) - len(b)
        return round((1 - R.word_similarity(a, b)) * max(len(a), len(b)))

    want = {(c, w): d for c in cores for w in words if (d := abs(distance(c, w))) <= 2}
    assert got == want


def test_nearest_in_all_steps(spark):
    """Against brute force: nearest entries within reach, within twice that and beyond, letters outside of ASCII among them."""

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(8)
    letters = "abcdefghißéñ\U0001d11eŁ"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    words = sorted({word(rng.randrange(1, 13)) for _ in range(300)})
    cores = sorted({word(rng.randrange(1, 15)) for _ in range(80)} | {words[5], words[9] + "zz", "w" * 20})
    count = {w: i % 7 + 1 for i, w in enumerate(words)}
    lex = spark.createDataFrame(list(count.items()), "word string, n long")
    got = {r.core: (r.word, r.dist, r.ties, r.n) for r in X.nearest(spark.createDataFrame([(c,) for c in cores], "core string"), lex).collect()}
    steps = set()
    for c in cores:
        dist = {w: distance(c, w) for w in words}
        least = min(dist.values())
        ties = [w for w in words if dist[w] == least]
        best = min(ties, key=lambda w: (-count[w], w.encode()))
        assert got[c] == (best, least, len(ties), count[best])
        steps.add(0 if least <= 2 else 1 if least <= 4 else 2)
    assert steps == {0, 1, 2} and len(got) == len(cores)


def test_queries_search_the_whole_list(spark, tmp_path):
    from textmend.plans import queries as N

    tables = {"nation": ("n_name string", [("PERÜ",)]), "region": ("r_name string", [("EUROPE",)]), "benchmark": ("item_id long, text string", [(1, "Strasse, größer enorme perfectamente")])}
    tables["documents"] = ("doc_id long, lang string, text string", [(1, "de", "Straße größe Europe europé perü péru peru europe europe"), (2, "es", "enormé perfectaménté señor año a")])
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    lex = [(r.word, r.n) for r in N.lexicon_counts(spark, str(tmp_path)).collect()]
    assert sum(not w.isascii() for w, _ in lex) == 9

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    order = lambda core: sorted((distance(core, w), -n, w) for w, n in lex)
    got = N.nearest_word_all(spark, str(tmp_path)).collect()
    assert {r.core for r in got} == {"perü", "europe", "Strasse", "größer", "enorme", "perfectamente"}
    for r in got:
        best = order(r.core)
        assert (r.dist, -r.n, r.word) == best[0] and r.ties == sum(d == r.dist for d, _, _ in best)
    got = N.closest_words_all(spark, str(tmp_path)).collect()
    assert sorted((r.core, r.place, r.word, r.dist) for r in got) == [(c, k, w, d) for c in ("europe", "perü") for k, (d, _, w) in enumerate(order(c)[:5], 1)]


def test_scores(spark, damage):
    d = damage.where("k > 0")
    best = d.select("id", "severity", F.lit("best").alias("method"), F.transform(L.by_place(F.col("ops_per_word")), lambda p: p["gold"]).alias("pred_words"))
    rows = E.row_scores(E.with_no_repair(d, best)).collect()
    for r in rows:
        if r.method == "best":
            assert r.exact == 1 and r.fact_recovery == 1 and r.anchor_ok and r.edits_after == 0 and r.cer_after == 0
        else:
            assert not r.format_ok and r.exact == 0 and not r.anchor_ok and r.edits_saved == 0
    scores = E.row_scores(E.with_no_repair(d, best))
    tests = E.paired_tests(scores, [("best", "no repair")]).collect()
    assert len(tests) == 5 and all(t.only_a == 12 and t.mcnemar_p == pytest.approx(2 / 2**12) and t.mcnemar_holm >= t.mcnemar_p for t in tests)
    ci = E.bootstrap(E.long_metrics(scores), 200, 1)
    assert ci.where("method = 'best' and metric = 'exact words' and low = 1 and high = 1").count() == 5


def test_statistics(spark):
    p = lambda a, b: spark.range(1).select(E.mcnemar_p(F.lit(a), F.lit(b))).first()[0]
    assert p(6, 0) == pytest.approx(2 / 2**6) and p(0, 0) == 1 and p(3, 3) == 1
    rows = spark.createDataFrame([("a", i, x) for i, x in enumerate([0.01, 0.04, 0.03])] + [("b", 0, 0.9), ("b", 1, 0.8)], "f string, i int, p double")
    got = {(r.f, r.i): r.p_holm for r in E.holm(rows, ["f"], "p", ["i"]).collect()}
    assert [round(got["a", i], 9) for i in range(3)] == [0.03, 0.06, 0.06] and got["b", 0] == got["b", 1] == 1
    for right, wrong, want in [([3, 4], [1, 2], 0), ([1, 1], [1], 0.5), ([1], [2, 3], 1), ([], [1], None)]:
        df = spark.createDataFrame([("g", float(x), True) for x in right] + [("g", float(x), False) for x in wrong], "g string, score double, ok boolean")
        assert E.wrong_rate(df, ["g"]).first().wrong_rate == want
    d = spark.createDataFrame([("g", float(x)) for x in (1, 2, 3, 4, 5, 0)], "g string, d double")
    w = E.wilcoxon_p(E.signed_ranks(d, ["g"])).first()
    assert (w.n, w.w_plus, w.w_minus) == (5, 15, 0) and w.p == pytest.approx(2 / 32)


def test_bootstrap_constant(spark):
    rows = spark.createDataFrame([("m", "l", "x", str(i), 2.0, 4.0) for i in range(4)], "method string, level string, metric string, id string, num double, den double")
    r = E.bootstrap(rows, 100, 5).first()
    assert (r.value, r.low, r.high) == (0.5, 0.5, 0.5)
    empty = rows.withColumn("den", F.lit(0.0))
    assert E.bootstrap(empty, 10, 5).first().value is None


def test_quotas_and_sample(spark):
    counts = spark.createDataFrame([("a", 60), ("b", 40), ("c", 20)], "band string, n_rows int")
    assert {r.band: r.quota for r in P.quotas(counts, 30).collect()} == {"a": 15, "b": 10, "c": 5}
    rows = [(f"d{i % 40}-{i:03d}", f"d{i % 40}", f"text {i}", "abc"[i % 3]) for i in range(240)]
    pool = spark.createDataFrame(rows, "id string, doc_id string, text string, band string")
    s = P.draw_sample(pool, 30, 9, 2, 42).collect()
    again = P.draw_sample(pool.orderBy(F.desc("id")), 30, 9, 2, 42).collect()
    assert sorted(s) == sorted(again) and len(s) == 39
    docs = {x: [r.doc_id for r in s if r.split == x] for x in ("test", "dev")}
    assert not set(docs["test"]) & set(docs["dev"]) and max(map(docs["test"].count, docs["test"])) <= 2
    import hashlib
    from collections import Counter

    order = sorted(rows, key=lambda r: hashlib.sha256(f"42:{r[0]}".encode()).hexdigest())
    used, want = set(), {}
    for split, n in (("test", 30), ("dev", 9)):
        left, per = Counter({b: n // 3 for b in "abc"}), Counter()
        for r in order:
            if r[1] not in used and left[r[3]] and per[r[1]] < 2:
                left[r[3]] -= 1
                per[r[1]] += 1
                want[r[0]] = split
        used |= set(per)
    assert {r.id: r.split for r in s} == want
    with pytest.raises(ValueError):
        P.draw_sample(pool, 100, 9, 2, 42)


def test_masked_input(spark):
    words = "he was seen near A, bb ccc d the night".split()
    df = spark.createDataFrame([(words,)], "w array<string>")
    pieces = lambda c: F.lit(4)
    got = df.select(G.masked_input(F.col("w"), F.lit(4), F.lit(7), F.lit(5), pieces)).first()[0]
    assert got == "he was seen near A, [MASK] [MASK] [MASK] [MASK] [MASK] d the night"


def test_store(spark, damage, tmp_path):
    path = str(tmp_path / "preds")
    d = damage.where("severity in ('0', '1w', '10')")

    def predict(view):
        return {"pred_words": [s["out"] for s in view["slots"]] if view["k"] == 1 else ["only one"] * 99, "raw_output": "x"}

    assert Z.run_method(d, predict, "echo", "v1", "none", path) == 24
    assert Z.run_method(d, predict, "echo", "v1", "none", path) == 0
    got = Z.load_predictions(spark, path)
    assert got.where("format_ok").count() == 12 and got.where("not format_ok and pred_words is null and spliced_text is null").count() == 12
    with pytest.raises(ValueError):
        Z.append_predictions(got.limit(1), path)
    with pytest.raises(PermissionError):
        Z.run_method(d.withColumn("split", F.lit("test")), predict, "echo", "v2", "none", path)
    assert Z.load_predictions(spark, str(tmp_path / "none")).count() == 0
    asked, stop = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    bad = sorted(r.id for r in d.where("severity = '1w'").select("id").collect())[5]

    def careful(view):
        asked.add(1)
        if view["id"] == bad and view["severity"] == "1w":
            stop.add(1)
            raise OSError("no answer")
        return {"pred_words": [s["out"] for s in view["slots"]]}

    few, other = d.where("severity = '1w'").coalesce(1), str(tmp_path / "other")
    with pytest.raises(RuntimeError, match="no answer"):
        Z.run_method(few, careful, "careful", "v1", "none", other)
    kept = Z.load_predictions(spark, other).count()
    assert asked.value == kept + 1 and stop.value == 1  # one call a row, and what was answered is kept
    assert Z.run_method(few, lambda view: {"pred_words": ["x"]}, "careful", "v1", "none", other) == 12 - kept
    assert Z.load_predictions(spark, other).select("id", "severity").distinct().count() == 12
    assert E.complete_methods(d.where("k > 0"), got).first().missing == 0


def test_freeze(spark, damage, tmp_path):
    path = str(tmp_path / "frozen")
    small = damage.select("id", "severity", "k")
    assert Z.freeze(small, path, "1") == "written" and Z.freeze(small.orderBy("k"), path, "1") == "unchanged"
    with pytest.raises(ValueError):
        Z.freeze(small.where("k > 1"), path, "1")
    assert Z.load_frozen(spark, path, "1", Z.digest(small)).count() == small.count()
    with pytest.raises(ValueError):
        Z.load_frozen(spark, path, "1", Z.digest(small.limit(1)))
    checks = Z.check_damage(damage, 12, len(LEVELS)).first()
    assert (checks.rows_off, checks.not_clean, checks.plans_off, checks.double_keys) == (0, 0, 0, 0)


def test_stream(spark, damage, tmp_path):
    from textmend.streaming.resume import stream_predictions

    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    damage.where("severity = '1w'").write.parquet(source)

    def repair(batch):
        return batch.select("id", "severity", "split", F.lit("m").alias("method"), F.lit("v").alias("method_version"), F.lit("n").alias("model_name"), F.lit("").alias("slots_in"), F.lit("").alias("raw_output"), F.array(F.lit("a")).alias("pred_words"), F.lit("").alias("spliced_text"), F.lit(True).alias("format_ok"), F.lit(None).cast("string").alias("error"), F.lit(0.0).alias("seconds"), F.current_timestamp().alias("timestamp"))

    for _ in range(2):
        stream_predictions(spark.readStream.schema(damage.schema).parquet(source), repair, path, str(tmp_path / "cp")).awaitTermination()
    assert Z.load_predictions(spark, path).count() == 12


def test_answers():
    assert R.parse_answer('```json\n["a", "b"]\n``` thanks', "stop", 2) == (["a", "b"], None)
    assert R.parse_answer("see [x] then [1]", "stop", 1) == ([1], "holds more than text")
    assert R.parse_answer('["a"]', "stop", 2) == (["a"], "1 words for 2 slots")
    assert R.parse_answer("none", "stop", 1) == (None, "holds no list") and R.parse_answer('["a"]', "length", 1)[0] is None
    assert R.parse_answer(None, None, 1)[0] is None and R.parse_answer('[["a"], ["b"]', "stop", 1) == (["a"], None)
    assert R.rerank_version("ftv1", 4, 5, 10, 20, "dev") == "ftv1-l4-b5-n10-x20-dev"
    assert R.seq2seq_version("ftv1", 1, "dev") == "ftv1-greedy-dev"


def test_client():
    class Fault(Exception):
        def __init__(self, status, reset=None):
            self.status, self.reset = status, reset

    script, waits = [Fault(429, 100), Fault(None), {"content": "ok"}], []

    def send(payload):
        x = script.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    c = R.Client(send, ["m"], sleep=waits.append)
    assert c.chat("m", []) == {"content": "ok"} and waits == [101, 4]
    script[:] = [Fault(400)]
    with pytest.raises(Fault):
        c.chat("m", [])
    with pytest.raises(ValueError):
        c.chat("other", [])


def test_fill_slots():
    view = {"words": ["the", None, "of", None], "slots": [{"dropped": False, "core": "c0rn-rnarket", "lead": "", "trail": ","}, {"dropped": True, "core": "", "lead": "", "trail": ""}]}
    assert R.split_slot(view["slots"][0]) == (["c0rn", "rnarket"], ["-"]) and R.split_slot(view["slots"][1]) == ([""], [])
    assert R.render_partly(view, [["corn"], []], (0, 2)) == "the corn-[MASK] [MASK], of [MASK]"
    assert R.render_partly(view, [[], []], (0, 1)) == "the [MASK]-[MASK], of [MASK]" and R.render_partly(view, [["corn"], ["a"]]) == "the [MASK], of a"
    options = lambda texts, dropped: [[[("corn", -1.0), ("market", -1.1), ("tin", -0.9)]]]
    assert R.fill_slots(view, options, lam=1.0, masks=1) == ["corn-market", "tin"]
    assert R.fill_slots(view, options, lambda part: {part: 0.0}, lam=1.0, masks=1)[0] == "c0rn-rnarket"
    assert R.combine([[[("a", -1.0), ("b", -2.0)]], [[("a", -1.0)], [("", -4.0), ("b", -1.0)]]], 1) == {"a": -1.0, "ab": -1.0}


def test_lookup_answers(spark, damage):
    d = damage.where("severity = '10'")
    words = sorted({w for r in d.collect() for w in r.gold_tokens})
    docs = spark.createDataFrame([("x", [" ".join(words)])], "doc_id string, paragraphs array<string>")
    lex = X.build_lexicon(docs).cache()
    entries = [(r.word, r.n) for r in lex.collect()]
    for r in X.lookup(L.build_slots(d), lex).collect():
        assert len(r.pred_words) == r.k
        for s, w in zip(sorted(r.slots, key=lambda s: s.idx), r.pred_words):
            core = s.core
            like = lambda x: round((1 - R.word_similarity(core, x)) * max(len(core), len(x)))
            assert w == (min(entries, key=lambda e: (like(e[0]), -e[1], e[0]))[0] if core else "")


def test_review_picks(spark):
    rows = spark.createDataFrame([(f"s{i}", "abc"[i % 3]) for i in range(60)], "id string, band string")
    picks = P.review_picks(rows, LEVELS[1:], 4, 1).orderBy("turn").collect()
    assert len(picks) == 20 and len({p.id for p in picks}) == 20
    assert all({p.band for p in picks if p.level == x} == set("abc") for x in LEVELS[1:])


def test_training_examples(spark, sample):
    pool = sample.select("id", "doc_id", F.col("gold_text").alias("text"), "band", "fact_idx", F.size(F.split("gold_text", " ")).alias("n_words"), F.when(F.col("id") == "d0-000", "val").otherwise("train").alias("usage"))
    pieces = lambda c: F.lit(2)
    first, second = (G.masked_examples(pool, 1, e, pieces).collect() for e in ("1", "2"))
    val = lambda rows: sorted(r for r in rows if r.usage == "val")
    assert val(first) == val(second) and sorted(first) != sorted(second)
    spans = {r.id: r for r in G.training_spans(pool, 1, "1").collect()}
    for r in first:
        s = spans[r.id]
        assert s.start <= r.target_pos < s.end and r.masked_input.count("[MASK]") == 2 + s.end - r.target_pos - 1
    for r in G.bracket_examples(pool, TABLE, "1").collect():
        assert r.source.count("{ ") == r.target.count("{ ") == r.k
    log = spark.createDataFrame([(1, 5.0), (2, 4.0), (3, 4.5), (4, 4.2), (5, 3.0)], "epoch int, loss double")
    assert [(r.best, r.since, r.stop) for r in G.early_stop(log, 2).orderBy("epoch").collect()] == [(5.0, 0, False), (4.0, 0, False), (4.0, 1, False), (4.0, 2, True), (3.0, 0, True)]


def test_calibration_is_one_row(spark):
    from textmend.operators import calibrate as C

    text = "some corn fell from our old cart with hay and a few men came here again"
    worse = "some c0rn fell frorn our old cart witb hay and a few men carne here again"
    pairs = spark.createDataFrame([("a", text, worse), ("b", text, worse), ("c", text, "nothing at all is alike here")], "doc_id string, gold string, other string")
    looked = C.choose_aligned(C.align_pairs(pairs).withColumn("place", F.ascii("doc_id") - 96), 3, 1).cache()
    assert {r.doc_id: r.used for r in looked.collect()} == {"a": True, "b": True, "c": False}
    found = C.all_pairs(looked.where("used"))
    row = C.calibration(42, looked, found, 40).first()
    assert sorted(row.docs_used) == ["a", "b"] and row.docs_dropped[0].doc_id == "c" and row.paired == 8
    assert {(c.gold, c.ocr): c["count"] for c in row.confusions} == {("m", "rn"): 4}
    assert C.before_after(found, looked.where("used"), 40).count() == 2
    assert C.coverage_totals(looked).first().word_error_rate == pytest.approx(8 / 32)
