"""Samples, calibration totals and statistics of scores as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmend.operators import calibrate as C
from textmend.operators import evaluate as E
from textmend.operators import lexicon as X
from textmend.operators import pool as P
from textmend.operators import repair as R
from textmend.operators import training as G
from textmend.plans import sql as Q
from textmend.plans.queries import NAMES, PLACES, SEED, _ascii_lexicon, _name_pairs, _places, _pool, _sentences, _t, _turns, query
from textmend.sources import corpus as S

# samples


@query(f"WITH {Q.SENT}, f AS (SELECT id, w, unnest(fact_idx) i FROM sent ORDER BY sha256(concat_ws(':', '{SEED}', 'facts', id, i::VARCHAR)), id, i LIMIT 50) SELECT id, i::INT AS idx, w[i + 1] AS token FROM f")
def fact_sample(spark, sf):
    s = _sentences(spark, sf)
    return S.context_rows(s, P.fact_sample(s, 50, SEED)).select("id", "idx", "token")


@query(f"WITH {Q.POOL} SELECT id FROM pool ORDER BY sha256(concat_ws(':', '{SEED}', 'manual', id)), id LIMIT 6")
def manual_picks(spark, sf):
    return P.seeded_examples(_pool(spark, sf), 6, SEED, "manual").select("id")


_TRAIN = f"""{Q.SENT}, s AS (SELECT * FROM sent WHERE band IS NOT NULL AND len(fact_idx) >= 1 AND doc_id NOT IN (SELECT doc_id::VARCHAR FROM labels)), d AS (SELECT DISTINCT doc_id FROM s),
r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256(concat_ws(':', '{SEED}', 'val_split', doc_id)), doc_id) k, count(*) OVER () n FROM d), u AS (SELECT doc_id, CASE WHEN k <= greatest(1, round_even(n * 0.1, 0)) THEN 'val' ELSE 'train' END AS usage FROM r),
pool AS (SELECT s.*, usage FROM s JOIN u USING (doc_id))"""


def _training(spark, sf):
    used = _t(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("doc_id"))
    return P.training_pool(_sentences(spark, sf), used, SEED)


@query(f"WITH {_TRAIN}, t AS (SELECT id, row_number() OVER (ORDER BY sha256(concat_ws(':', '{SEED}', 'probe', id)), id) k FROM pool WHERE usage = 'train') SELECT id FROM t WHERE k <= (SELECT count(*) FROM pool WHERE usage = 'val')")
def probe_sample(spark, sf):
    return P.probe_sample(_training(spark, sf), SEED).select("id")


@query(f"""WITH {_TRAIN}, x AS (SELECT *, CASE WHEN usage = 'val' THEN 'val' ELSE '1' END draw_ FROM pool), l AS (SELECT *, ['1w', '10', '25', '50', '75'][{Q.draw("'level'", 'id', 'draw_')} % 5 + 1] AS level, fact_idx[{Q.draw("'anchor'", 'id', 'draw_')} % len(fact_idx) + 1] AS anchor FROM x),
k AS (SELECT *, CASE WHEN level = '1w' THEN 1 ELSE (level::INT * len(w) + 50) // 100 END k FROM l) SELECT id, usage, level, anchor::INT anchor, k::INT k, least(greatest(anchor - k // 2, 0), len(w) - k)::INT AS start FROM k""".replace("level::INT", "try_cast(level AS INT)"))
def training_spans(spark, sf):
    return G.training_spans(_training(spark, sf), SEED, "1").select("id", "usage", "level", "anchor", "k", "start")


@query(f"SELECT date_diff('day', DATE '1970-01-01', ts::DATE)::INT AS epoch, {', '.join(f'''round(avg(value) FILTER (WHERE event_type = '{x}'), 6) AS {x}''' for x in ('click', 'view'))} FROM events GROUP BY 1")
def log_pivot(spark, sf):
    log = _t(spark, sf, "events").select(F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).alias("epoch"), F.col("event_type").alias("kind"), F.col("value").alias("loss"))
    return G.log_pivot(log, ["click", "view"]).select("epoch", F.round("click", 6).alias("click"), F.round("view", 6).alias("view"))


# calibration


@query("WITH c AS (SELECT s_suppkey place, (s_acctbal + 1000) / 11000 AS coverage FROM supplier), u AS (SELECT *, coverage >= 0.6 AS used, coalesce(sum((coverage >= 0.6)::INT) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) before FROM c) SELECT place, used FROM u WHERE place <= 5 OR before < 20")
def chosen_docs(spark, sf):
    c = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("place"), ((F.col("s_acctbal") + 1000) / 11000).alias("coverage"))
    return C.choose_aligned(c, 5, 20).select("place", "used")


@query("SELECT sum(c_custkey % 50) FILTER (WHERE u) AS gold_words, sum(c_custkey % 30) FILTER (WHERE u) AS equal, sum(c_custkey % 7) FILTER (WHERE u) AS paired, sum(c_custkey % 3) FILTER (WHERE u) AS unpaired, round(sum(c_custkey % 7) FILTER (WHERE u) / (sum(c_custkey % 30) FILTER (WHERE u) + sum(c_custkey % 7) FILTER (WHERE u)), 9) AS word_error_rate FROM (SELECT c_custkey, c_acctbal > 0 u FROM customer)")
def coverage_totals(spark, sf):
    k = F.col("c_custkey")
    rows = _t(spark, sf, "customer").select((k % 50).alias("gold_words"), (k % 30).alias("equal"), (k % 7).alias("paired"), (k % 3).alias("unpaired"), (F.col("c_acctbal") > 0).alias("used"))
    return C.coverage_totals(rows).withColumn("word_error_rate", F.round("word_error_rate", 9))


@query("SELECT round(sum(c_custkey % 2) / sum(c_custkey % 50), 9) AS isolated_drop_rate FROM customer")
def drop_rate(spark, sf):
    rows = _t(spark, sf, "customer").select((F.col("c_custkey") % 2).alias("isolated_drops"), (F.col("c_custkey") % 50).alias("gold_words"))
    return C.isolated_drop_rate(rows).select(F.round("isolated_drop_rate", 9).alias("isolated_drop_rate"))


@query("SELECT CASE WHEN length(other) >= length(gold) + 3 THEN 'merged' ELSE 'split' END AS flag, count(*) AS pairs FROM (SELECT a.text gold, b.text other FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn) WHERE abs(length(other) - length(gold)) >= 3 GROUP BY 1")
def flag_counts(spark, sf):
    """Flags of all turns next to each other; the floor for likeness lets all pass."""
    return C.flag_counts(_turns(spark, sf).select("gold", F.col("other").alias("ocr")), 0)


@query("SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS doc_id, p.gold AS gold, p.ocr AS ocr FROM (SELECT conv_id, turn, unnest([{'gold': role, 'ocr': left(text, 20)}, {'gold': right(text, 5), 'ocr': role}]) p FROM conversations)")
def all_pairs(spark, sf):
    pair = lambda a, b: F.struct(a.alias("gold"), b.alias("ocr"))
    c = _t(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), F.array(pair(F.col("role"), F.left("text", F.lit(20))), pair(F.right("text", F.lit(5)), F.col("role"))).alias("pairs"))
    return C.all_pairs(c)


@query(f"WITH {NAMES}, t AS (SELECT 'tier_b' AS tier, gold, ocr FROM pairs UNION ALL SELECT 'tier_a', gold, ocr FROM pairs WHERE key % 2 = 0), w AS (SELECT *, 'all' AS words FROM t UNION ALL SELECT *, 'min4' FROM t WHERE length(gold) >= 4), r AS (SELECT tier, words, least(1.0, levenshtein(gold, ocr) / length(gold)) r FROM w) SELECT tier, words, count(*) n, round(avg(r), 6) mean, round(quantile_cont(r, 0.5), 6) median FROM r GROUP BY ALL")
def per_word_error(spark, sf):
    pairs = _name_pairs(spark, sf)
    out = C.per_word_error(pairs.where("key % 2 = 0"), pairs)
    return out.select("tier", "words", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


@query(f"WITH {Q.LEXICON}, {PLACES}, r AS (SELECT core, word, levenshtein(core, word)::INT dist, row_number() OVER (PARTITION BY core ORDER BY levenshtein(core, word), n DESC, word) place FROM core, ascii) SELECT core, word, -dist::DOUBLE AS score FROM r WHERE place <= 8 AND ceil(length(word) / 4) <= 2")
def dictionary_candidates(spark, sf):
    return R.dictionary_candidates(_places(spark, sf), _ascii_lexicon(spark, sf), F.ceil(F.char_length("word") / 4), -F.col("dist").cast("double"), 8, 2)


# scores


def _scores(spark, sf):
    """Orders as scores: methods by status, levels by priority."""
    o = _t(spark, sf, "orders")
    return o.select(F.col("o_orderstatus").alias("method"), F.col("o_orderpriority").alias("level"), F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_custkey") % 2 == 0, "even").otherwise("odd").alias("band"), (F.col("o_totalprice") > 50000).alias("format_ok"), F.col("o_totalprice").alias("price"))


@query("SELECT o_orderstatus AS method, o_orderpriority AS level, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders WHERE o_totalprice > 50000 GROUP BY 1, 2")
def valid_means(spark, sf):
    return E.valid_means(_scores(spark, sf), "price").withColumn("mean", F.round("mean", 4))


@query("""SELECT o_orderpriority AS level, round(avg(o_totalprice) FILTER (WHERE o_custkey % 2 = 0 AND o_orderstatus = 'F'), 4) AS "even F", round(avg(o_totalprice) FILTER (WHERE o_custkey % 2 <> 0 AND o_orderstatus = 'O'), 4) AS "odd O" FROM orders GROUP BY 1""")
def band_pivot(spark, sf):
    out = E.band_pivot(_scores(spark, sf), "price", ["even F", "odd O"])
    return out.select("level", *(F.round(f"`{c}`", 4).alias(c) for c in ("even F", "odd O")))


_CELL = "printf('%.2f [%.2f, %.2f]', max(o_totalprice) FILTER (WHERE o_orderstatus = '{0}') / 2, min(o_totalprice) FILTER (WHERE o_orderstatus = '{0}'), max(o_totalprice) FILTER (WHERE o_orderstatus = '{0}'))"


@query(f"SELECT o_orderpriority AS level, {_CELL.format('F')} AS F, {_CELL.format('O')} AS O FROM (SELECT o_orderpriority, o_orderstatus, floor(o_totalprice) AS o_totalprice FROM orders) GROUP BY 1")
def interval_cells(spark, sf):
    ci = _scores(spark, sf).withColumn("price", F.floor("price").cast("double")).groupBy("method", "level").agg((F.max("price") / 2).alias("value"), F.min("price").alias("low"), F.max("price").alias("high")).withColumn("metric", F.lit("price"))
    return E.interval_table(ci, "price", ["F", "O"])


@query("SELECT o_orderkey, round(o_totalprice / 2, 2) AS value, floor(o_totalprice / 4)::DOUBLE AS low, floor(o_totalprice)::DOUBLE AS high, true AS none FROM (SELECT o_orderkey, floor(o_totalprice) o_totalprice FROM orders)")
def parsed_cells(spark, sf):
    p = F.floor("o_totalprice")
    cell = F.format_string("%.2f [%.2f, %.2f]", p / 2, F.floor(p / 4).cast("double"), p.cast("double"))
    o = _t(spark, sf, "orders").select("o_orderkey", E.parse_cell(cell).alias("c"), E.parse_cell(F.lit("n/a")).alias("d"))
    return o.select("o_orderkey", "c.value", "c.low", "c.high", (F.col("d.value").isNull() & F.col("d.high").isNull()).alias("none"))


@query(
    """WITH s AS (SELECT l_orderkey id, l_returnflag AS level, max(l_quantity > 25) FILTER (WHERE l_linenumber % 2 = 1) a, max(l_quantity > 25) FILTER (WHERE l_linenumber % 2 = 0) b, max(l_discount) FILTER (WHERE l_linenumber % 2 = 1) ga, max(l_discount) FILTER (WHERE l_linenumber % 2 = 0) gb FROM lineitem GROUP BY 1, 2 HAVING a IS NOT NULL AND b IS NOT NULL),
d AS (SELECT level, count(*) FILTER (WHERE a AND NOT b) only_a, count(*) FILTER (WHERE b AND NOT a) only_b, count(*) FILTER (WHERE ga > gb) higher, count(*) FILTER (WHERE ga < gb) lower FROM s GROUP BY level),
p AS (SELECT *, CASE WHEN only_a + only_b = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1), lambda i: exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))))) END p FROM d),
h AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, level) + 1) * p step FROM p)
SELECT 'odd' AS first, 'even' AS second, level, only_a, only_b, round(p, 7) AS mcnemar_p, round(least(1, max(step) OVER (ORDER BY p, level ROWS UNBOUNDED PRECEDING)), 7) AS mcnemar_holm, higher, lower FROM h"""
)
def paired_tests(spark, sf):
    """Lines of an order with odd and even numbers as two methods."""
    x = _t(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") % 2 == 1, "odd").otherwise("even").alias("method"), F.col("l_returnflag").alias("level"), F.col("l_orderkey").cast("string").alias("id"), (F.col("l_quantity") > 25).alias("ok"), "l_discount")
    x = x.groupBy("method", "level", "id").agg(F.max("ok").alias("anchor_ok"), F.max("l_discount").alias("fact_recovery"))
    out = E.paired_tests(x, [("odd", "even")])
    return out.select("first", "second", "level", "only_a", "only_b", F.round("mcnemar_p", 7).alias("mcnemar_p"), F.round("mcnemar_holm", 7).alias("mcnemar_holm"), "higher", "lower")


def _labels(spark, sf):
    """Quality of labelled documents by language, as a metric."""
    d = _t(spark, sf, "documents").select("doc_id", "lang").dropDuplicates(["doc_id"])
    rows = _t(spark, sf, "labels").join(d, "doc_id")
    return rows.select(F.col("lang").alias("method"), F.lit("all").alias("level"), F.format_string("%012d", "doc_id").alias("id"), F.lit("quality").alias("metric"), F.col("quality").cast("double").alias("num"), F.lit(1.0).alias("den"))


@query()
def bootstrap_scores(spark, sf):
    """Intervals from 10,000 resamples."""
    return E.bootstrap(_labels(spark, sf), 10_000, SEED)


@query("SELECT n_name AS method, 'all' AS level, 'key' AS metric, list(r_regionkey::DOUBLE * n_nationkey ORDER BY r_name) AS num FROM nation, region GROUP BY n_name")
def value_vectors(spark, sf):
    """A value of each nation for each region, in the order of the regions' names."""
    r = _t(spark, sf, "region")
    rows = _t(spark, sf, "nation").join(F.broadcast(r)).select(F.col("n_name").alias("method"), F.lit("all").alias("level"), F.col("r_name").alias("id"), F.lit("key").alias("metric"), (F.col("r_regionkey") * F.col("n_nationkey")).cast("double").alias("num"), F.lit(1.0).alias("den"))
    return E.value_vectors(rows, r.select(F.col("r_name").alias("id"))).select("method", "level", "metric", "num")


@query("WITH e AS (SELECT vec_id, embedding FROM embeddings), p AS (SELECT a.vec_id pair_id, a.embedding x, b.embedding y, c.embedding z FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 JOIN e c ON c.vec_id = a.vec_id + 2), d AS (SELECT pair_id, list_inner_product(x::DOUBLE[], y::DOUBLE[]) xy, list_inner_product(x::DOUBLE[], z::DOUBLE[]) xz FROM p) SELECT pair_id, round(greatest(xy, xz), 4) AS precision, round((xy + xz) / 2, 4) AS recall FROM d")
def greedy_match(spark, sf):
    """One vector against the two after it: the best partner counts for precision, the mean for recall."""
    e = _t(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    later = lambda n: e.select((F.col("vec_id") - n).alias("vec_id"), F.col("v").alias(f"v{n}"))
    rows = e.join(later(1), "vec_id").join(later(2), "vec_id").select(F.col("vec_id").alias("pair_id"), F.array("v").alias("a"), F.array("v1", "v2").alias("b"))
    return E.greedy_match(rows).select("pair_id", F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"))


@query(f"WITH {Q.LEXICON}, {PLACES}, r AS (SELECT core, word, levenshtein(core, word)::INT dist FROM core, ascii) SELECT core, word, dist FROM r WHERE dist <= 2")
def near_words(spark, sf):
    """All entries within two edits of a core."""
    return X._near(_places(spark, sf), _ascii_lexicon(spark, sf), 2).select("core", "word", "dist")
