"""The engine's operators as queries over the driver tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmend.functions import text as T
from textmend.operators import calibrate as C
from textmend.operators import damage as D
from textmend.operators import evaluate as E
from textmend.operators import lexicon as X
from textmend.operators import pool as P
from textmend.operators import repair as R
from textmend.operators import slots as L
from textmend.operators import training as G
from textmend.plans import sql as Q
from textmend.schemas import CONFIG, LEVELS
from textmend.sources import corpus as S
from textmend.sources import store as Z

SEED = CONFIG["seed"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TABLE = Q.TABLE


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _sentences(spark, sf) -> DataFrame:
    return P.sentence_table(S.documents(spark, sf))


def _pool(spark, sf) -> DataFrame:
    return P.make_pool(_sentences(spark, sf))


def _sample(spark, sf) -> DataFrame:
    return P.draw_sample(_pool(spark, sf), CONFIG["n_test"], CONFIG["n_dev"], CONFIG["max_per_doc"], SEED)


def _damage(spark, sf, pool: DataFrame | None = None) -> DataFrame:
    """Damage of every sentence of the pool, which is written once, as its sentences are cut and judged anew by each reader."""
    pool = Z.checkpointed(_pool(spark, sf)) if pool is None else pool
    return D.build_damage(pool.withColumnRenamed("text", "gold_text").withColumn("split", F.lit("pool")), TABLE)


def _name_pairs(spark, sf) -> DataFrame:
    """Customers' and suppliers' names with the same key."""
    c, s = _t(spark, sf, "customer"), _t(spark, sf, "supplier")
    return c.join(s, F.col("c_custkey") == F.col("s_suppkey")).select(F.col("c_custkey").alias("key"), F.col("c_name").alias("gold"), F.col("s_name").alias("ocr"))


NAMES = "pairs AS (SELECT c_custkey AS key, c_name gold, s_name ocr FROM customer JOIN supplier ON c_custkey = s_suppkey)"


# text


@query(f"WITH {Q.PARAS}, t AS (SELECT doc_id, lang, unnest({Q.words('p')}) x FROM (SELECT doc_id, lang, unnest(ps) p FROM paras)) SELECT lang, count(DISTINCT doc_id) docs, count(*) words, count(DISTINCT x) different FROM t GROUP BY lang")
def word_counts(spark, sf):
    t = S.documents(spark, sf).select("doc_id", "lang", F.explode(F.flatten(F.transform("paragraphs", T.words))).alias("x"))
    return t.groupBy("lang").agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("words"), F.countDistinct("x").alias("different"))


@query(f"WITH {Q.PARAS} SELECT doc_id, len(ps)::INT paragraphs, coalesce(list_sum(list_transform(ps, lambda p: len({Q.words('p')}))), 0)::INT AS words FROM paras")
def excerpt_stats(spark, sf):
    return P.excerpt_stats(S.documents(spark, sf))


@query(f"WITH {Q.SENT} SELECT id, doc_id, text, len(w)::INT n_words, band, fact_idx::INT[] fact_idx, len(fact_idx)::INT n_facts FROM sent")
def sentence_table(spark, sf):
    return _sentences(spark, sf)


@query(f"WITH {Q.POOL}, t AS (SELECT trim(w[unnest(fact_idx) + 1], {Q.TRIM}) token FROM pool), c AS (SELECT token, count(*) n FROM t GROUP BY token) SELECT token, n AS count, round(n / (SELECT sum(n) FROM c), 6) AS share FROM c ORDER BY n DESC, token LIMIT 20")
def fact_top_tokens(spark, sf):
    return P.top_fact_tokens(_pool(spark, sf))


@query(f"WITH {Q.SENT} SELECT lang, count(*) sentences, sum(len(w)) words, sum(len(fact_idx)) facts, round(sum(len(fact_idx)) / sum(len(w)), 6) density FROM sent GROUP BY lang")
def fact_density_by_lang(spark, sf):
    docs = S.documents(spark, sf).select("doc_id", "lang")
    rows = _sentences(spark, sf).join(docs, "doc_id").groupBy("lang").agg(F.count("*").alias("sentences"), F.sum("n_words").alias("words"), F.sum("n_facts").alias("facts"))
    return rows.withColumn("density", F.round(F.col("facts") / F.col("words"), 6))


@query(f"SELECT item_id, list_aggregate(list_transform(w, lambda t, i: CASE WHEN {Q.fact('t', 'i - 1', 'w[i - 1]')} THEN '[' || t || ']' ELSE t END), 'string_agg', ' ') marked FROM (SELECT item_id, {Q.words('text')} w FROM benchmark)")
def mark_facts(spark, sf):
    b = _t(spark, sf, "benchmark").withColumn("w", T.words(F.col("text"))).withColumn("f", T.fact_positions(F.col("w")))
    return b.select("item_id", T.mark_words(F.col("w"), F.col("f")).alias("marked"))


@query(f"SELECT token, {Q.edge('token', 1)} AS lead, {Q.edge('token', 2)} AS core, {Q.edge('token', 3)} AS trail, CASE WHEN {Q.edge('token', 2)} <> '' THEN {Q.edge('token', 2)} ELSE token END AS compared FROM (SELECT DISTINCT unnest({Q.words('text')}) token FROM benchmark)")
def split_punct(spark, sf):
    t = _t(spark, sf, "benchmark").select(F.explode(T.words(F.col("text"))).alias("token")).distinct()
    a, b, c = T.edge_parts(F.col("token"))
    return t.select("token", a.alias("lead"), b.alias("core"), c.alias("trail"), T.slot_core(F.col("token")).alias("compared"))


@query("SELECT DISTINCT p_type, list_filter(string_split_regex(p_type, '[^0-9A-Za-zÀ-ɏ]+'), lambda x: x <> '') AS parts FROM part")
def inner_parts(spark, sf):
    return _t(spark, sf, "part").select("p_type").distinct().select("p_type", T.parts_of(F.col("p_type")).alias("parts"))


@query(f"WITH {Q.SENT}, f AS (SELECT id, w, unnest(fact_idx) i FROM sent WHERE band IS NOT NULL) SELECT id, i::INT AS idx, w[i + 1] token, coalesce(list_aggregate(w[greatest(i - 5, 0) + 1 : i], 'string_agg', ' '), '') AS \"left\", coalesce(list_aggregate(w[i + 2 : i + 6], 'string_agg', ' '), '') AS \"right\" FROM f")
def fact_contexts(spark, sf):
    s = _sentences(spark, sf).where("band is not null")
    return S.context_rows(s, s.select("id", F.explode("fact_idx").alias("idx")))


@query("SELECT page_id, replace(replace(replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;?', chr(1), 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"').replace(chr(1), '&') AS title FROM pages")
def html_unescape(spark, sf):
    """Titles may end in the middle of a reference."""
    return _t(spark, sf, "pages").select("page_id", S.unescape_closed(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query("SELECT (year(o_orderdate) // 10 * 10)::INT AS decade, count(*) AS orders, min(year(o_orderdate))::INT AS first_year FROM orders GROUP BY 1")
def decades(spark, sf):
    year = F.substring(F.col("o_orderdate").cast("string"), 1, 4).cast("int")
    return _t(spark, sf, "orders").groupBy(T.decade(year).alias("decade")).agg(F.count("*").alias("orders"), F.min(year).alias("first_year"))


@query("SELECT lang, sum(len(regexp_extract_all(text, '[A-Za-z]- [a-z]'))) AS hits FROM documents GROUP BY lang")
def broken_words(spark, sf):
    return _t(spark, sf, "documents").groupBy("lang").agg(F.sum(T.hits(F.col("text"), "[A-Za-z]- [a-z]")).alias("hits"))


# pool and samples


@query(f"WITH {Q.SENT} SELECT rank, bin, count(id) sentences, coalesce(sum(len(w)), 0) words, round(count(id) / sum(count(id)) OVER (), 6) share_sentences, round(coalesce(sum(len(w)), 0) / sum(sum(len(w))) OVER (), 6) share_words FROM {Q.BINS} LEFT JOIN sent ON len(w) BETWEEN lo AND hi GROUP BY rank, bin")
def length_coverage(spark, sf):
    return P.length_coverage(_sentences(spark, sf))


@query(
    f"""WITH {Q.SENT}, s AS (SELECT doc_id, band IS NOT NULL a, band IS NOT NULL AND len(fact_idx) >= 1 b, band IS NOT NULL AND len(fact_idx) >= 2 c FROM sent)
SELECT 0 step, 'all sentences' AS name, count(*) sentences, count(DISTINCT doc_id) excerpts FROM s UNION ALL SELECT 1, '20 to 60 words', count(*), count(DISTINCT doc_id) FROM s WHERE a
UNION ALL SELECT 2, 'at least 1 fact token', count(*), count(DISTINCT doc_id) FROM s WHERE b UNION ALL SELECT 3, 'at least 2 fact tokens', count(*), count(DISTINCT doc_id) FROM s WHERE c"""
)
def pool_funnel(spark, sf):
    return P.pool_funnel(_sentences(spark, sf))


@query(f"WITH {Q.POOL} SELECT band, {', '.join(f'count(*) FILTER (WHERE least(len(fact_idx), 4) = {k}) facts_{k}' for k in (1, 2, 3, 4))}, count(*) total, round(count(*) / sum(count(*)) OVER (), 6) share FROM pool GROUP BY band")
def pool_table(spark, sf):
    return P.pool_table(_pool(spark, sf))


_QUOTA = """raw AS (SELECT band, n_rows * {n} / sum(n_rows) OVER () raw FROM cnt), base AS (SELECT band, floor(raw)::INT base, round(raw - floor(raw), 9) rest FROM raw), placed AS (SELECT *, row_number() OVER (ORDER BY rest DESC, band) place, {n} - sum(base) OVER () AS spare FROM base)
SELECT band, (base + CASE WHEN place <= spare THEN 1 ELSE 0 END)::INT quota FROM placed"""


@query(f"WITH {Q.POOL}, cnt AS (SELECT band, count(*) n_rows FROM pool GROUP BY band), " + _QUOTA.format(n=150))
def band_quotas(spark, sf):
    return P.band_quotas(_pool(spark, sf), 150)


@query("WITH cnt AS (SELECT c_mktsegment band, count(*) n_rows FROM customer GROUP BY ALL), " + _QUOTA.format(n=97))
def segment_quotas(spark, sf):
    return P.quotas(_t(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("band")).agg(F.count("*").alias("n_rows")), 97)


@query(f"SELECT doc_id::VARCHAR doc_id, row_number() OVER (ORDER BY sha256(concat_ws(':', '{SEED}', 'calibration', doc_id::VARCHAR)), doc_id::VARCHAR)::INT AS place FROM (SELECT DISTINCT doc_id FROM documents) WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def doc_order(spark, sf):
    return P.ordered_docs(S.documents(spark, sf), _t(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("doc_id")), SEED)


@query(f"WITH {Q.SENT}, r AS (SELECT id, len(w)::INT n_words, text, row_number() OVER (ORDER BY sha256(concat_ws(':', '{SEED}', 'long', id)), id) k FROM sent WHERE len(w) BETWEEN 61 AND 200) SELECT id, n_words, text[1:200] AS \"start\" FROM r WHERE k <= 3")
def long_examples(spark, sf):
    return P.long_examples(_sentences(spark, sf), 61, 200)


@query()
def draw_sample(spark, sf):
    return _sample(spark, sf)


@query("WITH x AS (SELECT c_mktsegment, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT coalesce(c_mktsegment, 'total') AS split, coalesce(r_name, 'total') AS band, count(*) AS n FROM x GROUP BY CUBE (c_mktsegment, r_name)")
def sample_crosstab(spark, sf):
    x = _t(spark, sf, "customer").join(F.broadcast(_t(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(_t(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return P.sample_counts(x.select(F.col("c_mktsegment").alias("split"), F.col("r_name").alias("band")))


@query(f"WITH {Q.POOL}, c AS (SELECT least(count(*), 3) n FROM pool GROUP BY doc_id) SELECT sum(n) AS capacity FROM c")
def capped_capacity(spark, sf):
    return P.capped_capacity(_pool(spark, sf), CONFIG["max_per_doc"])


@query(f"WITH d AS (SELECT DISTINCT doc_id::VARCHAR doc_id FROM documents), r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256(concat_ws(':', '{SEED}', 'val_split', doc_id)), doc_id) k, count(*) OVER () n FROM d) SELECT doc_id, CASE WHEN k <= greatest(1, round_even(n * 0.1, 0)) THEN 'val' ELSE 'train' END AS usage FROM r")
def train_val_split(spark, sf):
    return P.doc_split(S.documents(spark, sf), SEED)


@query(f"WITH {Q.SENT}, b AS (SELECT DISTINCT trim(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g')) AS text FROM benchmark) SELECT (SELECT count(*) FROM (SELECT DISTINCT doc_id FROM sent) WHERE doc_id IN (SELECT DISTINCT doc_id::VARCHAR FROM labels)) shared_docs, (SELECT count(*) FROM (SELECT DISTINCT text FROM sent) WHERE text IN (SELECT text FROM b)) shared_texts")
def leakage(spark, sf):
    lines = _t(spark, sf, "benchmark").select(F.explode(T.lines(F.col("text"))).alias("gold_text"), F.lit(None).cast("string").alias("doc_id"))
    docs = _t(spark, sf, "labels").select(F.lit(None).cast("string").alias("gold_text"), F.col("doc_id").cast("string").alias("doc_id"))
    return P.leakage(_sentences(spark, sf), lines.unionByName(docs))


@query(
    f"""WITH {Q.SENT}, s AS (SELECT * FROM sent WHERE band IS NOT NULL AND len(fact_idx) >= 1 AND doc_id NOT IN (SELECT doc_id::VARCHAR FROM labels)), d AS (SELECT DISTINCT doc_id FROM s), r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256(concat_ws(':', '{SEED}', 'val_split', doc_id)), doc_id) k, count(*) OVER () n FROM d),
u AS (SELECT doc_id, CASE WHEN k <= greatest(1, round_even(n * 0.1, 0)) THEN 'val' ELSE 'train' END AS usage FROM r) SELECT coalesce(usage, 'total') AS usage, count(*) sentences, count(DISTINCT doc_id) excerpts, sum(len(w)) words FROM s JOIN u USING (doc_id) GROUP BY ROLLUP (usage)"""
)
def training_pool_summary(spark, sf):
    used = _t(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("doc_id"))
    return P.pool_summary(P.training_pool(_sentences(spark, sf), used, SEED))


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT o_custkey AS c_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) k FROM orders) WHERE k <= 3")
def first_per_group(spark, sf):
    o = _t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return P.first_per_group(o, "c_custkey", [F.desc("o_totalprice"), "o_orderkey"], 3)


@query(f"SELECT c_custkey, ((row_number() OVER (ORDER BY sha256(concat_ws(':', '{SEED}', 'shuffle', '1', c_custkey::VARCHAR)), c_custkey) - 1) // 16)::INT AS batch FROM customer")
def batch_assign(spark, sf):
    return P.batches(_t(spark, sf, "customer").select("c_custkey"), 16, SEED, 1, "c_custkey")


@query(f"WITH {NAMES} SELECT gold, ocr FROM pairs ORDER BY sha256(concat_ws(':', '{SEED}', gold, ocr)), gold LIMIT 20")
def random_pairs(spark, sf):
    return C.random_pairs(_name_pairs(spark, sf), 20, SEED)


@query()
def review_examples(spark, sf):
    return P.review_picks(_sample(spark, sf), LEVELS[1:], 4, SEED)


# calibration


@query(f"WITH {NAMES} SELECT key, round(levenshtein(gold, ocr) / length(gold), 6) AS cer, CASE WHEN length(ocr) >= length(gold) + 3 THEN 'merged' WHEN length(gold) >= length(ocr) + 3 THEN 'split' END AS flag FROM pairs")
def name_error_rate(spark, sf):
    return _name_pairs(spark, sf).select("key", F.round(C.error_rate(F.col("gold"), F.col("ocr")), 6).alias("cer"), T.length_flag(F.col("gold"), F.col("ocr")).alias("flag"))


@query(f"WITH {NAMES}, r AS (SELECT least(1.0, levenshtein(gold, ocr) / length(gold)) r FROM pairs) SELECT count(*) n, round(avg(r), 6) mean, round(quantile_cont(r, 0.5), 6) median, round(quantile_cont(r, 0.25), 6) q1, round(quantile_cont(r, 0.75), 6) q3, round(avg((r >= 0.4)::INT), 6) share_040 FROM r")
def error_quantiles(spark, sf):
    out = C.error_stats(_name_pairs(spark, sf))
    return out.select("n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "q1", "q3", "share_040")))


def _turns(spark, sf) -> DataFrame:
    """Each turn of a conversation with the one after it."""
    c = _t(spark, sf, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other"))
    return c.join(nxt, ["conv_id", "turn"]).select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), F.col("text").alias("gold"), "other")


@query()
def align_turns(spark, sf):
    return C.align_pairs(_turns(spark, sf)).drop("equal_words", "pairs")


@query()
def edit_mix(spark, sf):
    return C.op_mix(C.edit_table(_name_pairs(spark, sf)))


@query()
def confusion_table(spark, sf):
    pairs = _name_pairs(spark, sf)
    kept = pairs.select(F.array("gold").alias("equal_words"))
    return C.confusions(C.edit_table(pairs), kept, pairs)


# damage


@query(f"WITH {Q.SPANS} SELECT id, severity, k::INT k, anchor::INT anchor_idx, span_start::INT span_start, (span_start + k)::INT span_end FROM span")
def nested_spans(spark, sf):
    rows = D.spans(_pool(spark, sf).withColumnRenamed("text", "gold_text"))
    return rows.select("id", "severity", "k", "anchor_idx", "span_start", "span_end")


@query(
    f"""WITH {Q.SPANS}, word AS (SELECT id, anchor, w, unnest(range(span_start, span_start + k)) i FROM span WHERE severity = '75'), u AS (SELECT id, i, i = anchor is_anchor, w[i + 1] token, len(regexp_replace(w[i + 1], '[^\\p{{L}}\\p{{N}}]', '', 'g')) n, {Q.uniform("'drop'", 'id', 'i::VARCHAR')} d, 0.2::DOUBLE + {Q.uniform("'intensity'", 'id', 'i::VARCHAR')} * (0.3::DOUBLE - 0.2::DOUBLE) p FROM word),
x AS (SELECT *, n = 0 OR (NOT is_anchor AND d < 0.1::DOUBLE) AS dropped FROM u) SELECT id, i::INT idx, token, dropped, CASE WHEN NOT dropped THEN least(n, greatest(1, floor(p * n + 0.5)))::INT END altered FROM x"""
)
def damage_plan(spark, sf):
    rows = D.spans(_pool(spark, sf).withColumnRenamed("text", "gold_text"), ["75"])
    words = rows.select("id", "anchor_idx", "gold_tokens", F.explode(F.sequence("span_start", F.col("span_end") - 1)).alias("idx"))
    words = words.select("id", "idx", F.get("gold_tokens", F.col("idx")).alias("token"), (F.col("idx") == F.col("anchor_idx")).alias("is_anchor"))
    plan = D.plan_words(words, TABLE)
    return plan.select("id", "idx", "token", F.col("plan.dropped").alias("dropped"), F.when(~F.col("plan.dropped"), F.size("plan.ops")).alias("altered"))


@query(Q.RECORDS)
def damage_records(spark, sf):
    return _damage(spark, sf).select("id", "severity", "k", "anchor_idx", "span_start", "span_end", "corrupted_text", D.mark_damage(F.col("gold_tokens"), F.col("ops_per_word")).alias("marked"))


@query(Q.DAMAGE_STATS)
def damage_stats(spark, sf):
    out = D.damage_stats(_damage(spark, sf).where("severity = '75'"))
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes))


@query()
def cer_by_level(spark, sf):
    return D.cer_by_level(_damage(spark, sf))


@query("SELECT 0::BIGINT rows_off, 0::BIGINT not_clean, 0::BIGINT plans_off, 0::BIGINT double_keys")
def damage_checks(spark, sf):
    pool = Z.checkpointed(_pool(spark, sf))
    return Z.check_damage(_damage(spark, sf, pool), pool.count(), len(LEVELS))


# slots and word lists


@query(Q.VIEWS)
def slot_views(spark, sf):
    v = L.build_slots(_damage(spark, sf).where("k > 0"))
    w, s = F.col("words"), F.col("slots")
    return v.select("id", "severity", L.slot_view(w, s).alias("plain"), L.numbered_view(w, s).alias("numbered"), L.brace_view(w, s).alias("braces"))


@query("SELECT 0::BIGINT gold_off, 0::BIGINT damaged_off")
def splice_round_trip(spark, sf):
    """Both counts are 0: golds give the sentence as it was, damaged forms the damaged one."""
    d = _damage(spark, sf)
    gold = L.splice(F.col("gold_tokens"), F.col("ops_per_word"), F.transform(L.by_place(F.col("ops_per_word")), lambda p: p["gold"]))
    out = L.splice(F.col("gold_tokens"), F.col("ops_per_word"), F.transform(L.by_place(F.col("ops_per_word")), lambda p: p["out"]))
    return d.agg(F.count_if(gold != F.array_join("gold_tokens", " ")).alias("gold_off"), F.count_if(F.regexp_replace(out, " +", " ") != F.col("corrupted_text")).alias("damaged_off"))


@query(f"WITH {Q.LEXICON} SELECT word, n FROM lex")
def lexicon_counts(spark, sf):
    return X.build_lexicon(S.documents(spark, sf))


@query(f"WITH {Q.LEXICON}, p AS (SELECT unnest(list_filter(string_split_regex(word, '[^0-9A-Za-zÀ-ɏ]+'), lambda x: x <> '')) word, n FROM lex) SELECT word, sum(n) n FROM p GROUP BY word")
def lexicon_part_counts(spark, sf):
    return X.part_counts(X.build_lexicon(S.documents(spark, sf)))


PLACES = "core AS (SELECT DISTINCT unnest(string_split(lower(x), ' ')) core FROM (SELECT n_name x FROM nation UNION ALL SELECT r_name FROM region)), ascii AS (SELECT * FROM lex WHERE NOT regexp_matches(word, '[^\\x01-\\x7F]'))"


def _places(spark, sf) -> DataFrame:
    names = _t(spark, sf, "nation").select(F.col("n_name").alias("x")).unionAll(_t(spark, sf, "region").select(F.col("r_name").alias("x")))
    return names.select(F.explode(F.split(F.lower("x"), " ")).alias("core")).distinct()


def _ascii_lexicon(spark, sf) -> DataFrame:
    return X.build_lexicon(S.documents(spark, sf)).where(~F.col("word").rlike(r"[^\x00-\x7F]"))


@query(f"WITH {Q.LEXICON}, {PLACES}, d AS (SELECT core, word, n, levenshtein(core, word) dist FROM core, ascii), r AS (SELECT *, row_number() OVER (PARTITION BY core ORDER BY dist, n DESC, word) k, count(*) OVER (PARTITION BY core, dist) ties FROM d) SELECT core, word, dist::INT dist, ties, n FROM r WHERE k = 1")
def nearest_word(spark, sf):
    return X.nearest(_places(spark, sf), _ascii_lexicon(spark, sf))


@query(f"WITH {Q.LEXICON}, {PLACES}, r AS (SELECT core, word, levenshtein(core, word)::INT dist, row_number() OVER (PARTITION BY core ORDER BY levenshtein(core, word), n DESC, word)::INT place FROM core, ascii) SELECT core, place, word, dist FROM r WHERE place <= 5")
def closest_words(spark, sf):
    return X.closest(_places(spark, sf), _ascii_lexicon(spark, sf), 5)


@query()
def nearest_word_all(spark, sf):
    """nearest_word over the whole list, in which DuckDB can't count characters, for the places and the benchmark's words."""
    words = _t(spark, sf, "benchmark").select(F.explode(T.words(F.col("text"))).alias("t")).select(T.slot_core(F.col("t")).alias("core")).where("core <> ''")
    return X.nearest(_places(spark, sf).unionByName(words), X.build_lexicon(S.documents(spark, sf)))


@query()
def closest_words_all(spark, sf):
    """closest_words over the whole list."""
    return X.closest(_places(spark, sf), X.build_lexicon(S.documents(spark, sf)), 5)


@query("SELECT a.n_name AS a, b.n_name AS b, round(1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name)), 6) AS likeness FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def char_similarity(spark, sf):
    n = _t(spark, sf, "nation")
    pairs = n.select(F.col("n_name").alias("a"), "n_regionkey").join(n.select(F.col("n_name").alias("b"), "n_regionkey"), "n_regionkey")
    return pairs.select("a", "b", F.round(T.similarity(F.col("a"), F.col("b")), 6).alias("likeness"))


@query(
    """WITH c AS (SELECT c_nationkey::VARCHAR id, c_mktsegment AS pos, n_name damaged, c_name word, c_acctbal / 10000 AS score FROM customer JOIN nation ON c_nationkey = n_nationkey), t AS (SELECT lam, id, pos, word, score + lam * (1 - levenshtein(damaged, word) / greatest(length(damaged), length(word))) total FROM c, (VALUES (0.5::DOUBLE), (1.0), (4.0)) g(lam)),
r AS (SELECT *, row_number() OVER (PARTITION BY lam, id, pos ORDER BY total DESC, word) k FROM t) SELECT lam, id, pos, word, round(total, 6) total FROM r WHERE k = 1"""
)
def rerank_grid(spark, sf):
    n = F.broadcast(_t(spark, sf, "nation"))
    c = _t(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select(F.col("c_nationkey").cast("string").alias("id"), F.col("c_mktsegment").alias("pos"), F.col("n_name").alias("damaged"), F.col("c_name").alias("word"), (F.col("c_acctbal") / 10000).alias("score"))
    grid = spark.createDataFrame([(0.5,), (1.0,), (4.0,)], "lam double")
    return R.rerank(c, grid).withColumn("total", F.round("total", 6))


def _lookup(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Damage of every sentence of the pool and its repair: each half of the documents by the word list of the other half."""
    damage, docs, found = Z.checkpointed(_damage(spark, sf)), S.documents(spark, sf), None
    for i in (0, 1):
        mine = F.crc32("doc_id") % 2 == i
        part = X.lookup(L.build_slots(damage.where("k > 0").where(mine)), X.build_lexicon(docs.where(~mine)))
        found = part if found is None else found.unionByName(part)
    return damage, found.withColumn("method", F.lit("lookup"))


@query()
def lookup_scores(spark, sf):
    """Scores of the dictionary lookup and of no repair, by level."""
    damage, found = _lookup(spark, sf)
    scores = E.row_scores(E.with_no_repair(damage, found))
    return scores.groupBy("method", "level").agg(F.count("*").alias("n"), F.avg("exact").alias("exact"), F.avg(F.col("anchor_ok").cast("int")).alias("anchor"), F.avg("fact_recovery").alias("facts"), F.sum("edits_before").alias("edits_before"), F.sum("edits_after").alias("edits_after"))


# training


@query()
def masked_examples(spark, sf):
    used = _t(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("doc_id"))
    pool = P.training_pool(_sentences(spark, sf), used, SEED)
    pieces = lambda c: F.ceil(F.char_length(c) / 4).cast("int")
    return G.example_stats(G.masked_examples(pool, SEED, "1", pieces), pieces)


@query(
    "WITH d AS (SELECT date_diff('day', DATE '1970-01-01', ts::DATE) epoch, avg(value) loss FROM events GROUP BY 1), b AS (SELECT epoch, loss, min(loss) OVER (ORDER BY epoch) best FROM d), a AS (SELECT *, max(CASE WHEN loss = best THEN epoch END) OVER (ORDER BY epoch) seen FROM b) SELECT epoch::INT epoch, round(loss, 6) loss, round(best, 6) best, (epoch - seen)::INT since, max(epoch - seen) OVER (ORDER BY epoch) >= 2 AS stop FROM a"
)
def early_stopping(spark, sf):
    log = _t(spark, sf, "events").groupBy(F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).alias("epoch")).agg(F.avg("value").alias("loss"))
    return G.early_stop(log, 2).withColumn("loss", F.round("loss", 6)).withColumn("best", F.round("best", 6))


@query(f"WITH w AS (SELECT conv_id, turn, {Q.words('text')} w FROM conversations) SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS id, coalesce(list_aggregate(w[1 : len(w) // 2], 'string_agg', ' '), '') AS first, coalesce(list_aggregate(w[len(w) // 2 + 1 :], 'string_agg', ' '), '') AS second FROM w")
def probe_split(spark, sf):
    return R.probe_halves(_t(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text"))


@query("SELECT event_id, [event_type] AS pred_words, NULL::VARCHAR AS error FROM events")
def answer_parse(spark, sf):
    rows = _t(spark, sf, "events").select("event_id", F.concat(F.lit('```json\n["'), "event_type", F.lit('"]\n```')).alias("content"), F.lit("stop").alias("finish_reason"), F.lit(1).alias("k"))
    return R.parse_answers(rows).select("event_id", "pred_words", "error")


# store


@query("SELECT o_orderpriority AS method, coalesce(o_orderstatus, 'all') AS level, count(*) FILTER (WHERE o_totalprice > 100000) AS failures, count(*) AS rows FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderpriority))")
def format_failures(spark, sf):
    o = _t(spark, sf, "orders").select(F.col("o_orderpriority").alias("method"), F.col("o_orderstatus").alias("severity"), (F.col("o_totalprice") <= 100000).alias("format_ok"))
    return E.failures(o)


@query("WITH want AS (SELECT DISTINCT user_id FROM events), have AS (SELECT event_type AS method, count(DISTINCT user_id) h FROM events GROUP BY 1) SELECT method, (SELECT count(*) FROM want) - h AS missing FROM have")
def completeness_gate(spark, sf):
    e = _t(spark, sf, "events").select(F.col("user_id").alias("id"), F.lit("all").alias("severity"), F.col("event_type").alias("method"))
    return E.complete_methods(e, e)


# evaluation


@query(
    f"""WITH v AS (SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) AS pos, quality::DOUBLE num, 1.0::DOUBLE den FROM labels JOIN documents USING (doc_id)), s AS (SELECT lang, count(*) n FROM v GROUP BY lang), g AS (SELECT lang, n, b, unnest(range(0, n)) i FROM (SELECT lang, n, unnest(range(1, 41)) b FROM s)),
p AS (SELECT lang, b, {Q.draw("'boot'", 'b::VARCHAR', 'i::VARCHAR')} % n AS pos FROM g), x AS (SELECT lang, b, sum(num) / sum(den) x FROM p JOIN v USING (lang, pos) GROUP BY ALL) SELECT lang, round((SELECT sum(num) / sum(den) FROM v WHERE v.lang = x.lang), 6) AS \"value\", round(quantile_cont(x, 0.025), 6) low, round(quantile_cont(x, 0.975), 6) high FROM x GROUP BY lang"""
)
def bootstrap_ci(spark, sf):
    rows = _t(spark, sf, "labels").join(_t(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    pos = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")) - 1
    out = E.hash_bootstrap(rows.select("lang", pos.alias("pos"), F.col("quality").cast("double").alias("num"), F.lit(1.0).alias("den")), 40, SEED, ["lang"])
    return out.select("lang", *(F.round(c, 6).alias(c) for c in ("value", "low", "high")))


@query(
    """WITH d AS (SELECT lang, count(*) FILTER (WHERE quality = 1 AND toxic = 0) only_a, count(*) FILTER (WHERE quality = 0 AND toxic = 1) only_b FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT lang, only_a, only_b, round(CASE WHEN only_a + only_b = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1), lambda i: exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))))) END, 9) p FROM d"""
)
def mcnemar(spark, sf):
    rows = _t(spark, sf, "labels").join(_t(spark, sf, "documents").select("doc_id", "lang"), "doc_id").select("lang", (F.col("quality") == 1).alias("a_ok"), (F.col("toxic") == 1).alias("b_ok"))
    return E.discordant(rows, ["lang"]).withColumn("p", F.round(E.mcnemar_p(F.col("only_a"), F.col("only_b")), 9))


@query(
    """WITH d AS (SELECT l_returnflag, l_shipdate::DATE - DATE '1995-06-17' AS d FROM lineitem), x AS (SELECT l_returnflag, d, abs(d) m FROM d WHERE d <> 0), r AS (SELECT l_returnflag, d, rank() OVER (PARTITION BY l_returnflag ORDER BY m) + (count(*) OVER (PARTITION BY l_returnflag, m) - 1) / 2 AS rk, count(*) OVER (PARTITION BY l_returnflag, m) t FROM x)
SELECT l_returnflag, count(*) n, count(*) FILTER (WHERE d > 0) higher, count(*) FILTER (WHERE d < 0) lower, coalesce(sum(rk) FILTER (WHERE d > 0), 0)::DOUBLE w_plus, coalesce(sum(rk) FILTER (WHERE d < 0), 0)::DOUBLE w_minus, sum(t * t - 1)::BIGINT ties FROM r GROUP BY l_returnflag"""
)
def wilcoxon_ranks(spark, sf):
    d = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-06-17").cast("date"))
    out = E.signed_ranks(_t(spark, sf, "lineitem").select("l_returnflag", d.alias("d")), ["l_returnflag"])
    return out.select("l_returnflag", "n", "higher", "lower", F.col("w_plus").cast("double").alias("w_plus"), F.col("w_minus").cast("double").alias("w_minus"), "ties")


@query(
    """WITH t AS (SELECT p_brand, p_type, min(p_retailprice) / 100000 AS p FROM part GROUP BY ALL), s AS (SELECT *, (count(*) OVER (PARTITION BY p_brand) - row_number() OVER (PARTITION BY p_brand ORDER BY p, p_type) + 1) * p AS step FROM t)
SELECT p_brand, p_type, round(least(1, max(step) OVER (PARTITION BY p_brand ORDER BY p, p_type ROWS UNBOUNDED PRECEDING)), 9) p_holm FROM s"""
)
def holm_adjust(spark, sf):
    t = _t(spark, sf, "part").groupBy("p_brand", "p_type").agg((F.min("p_retailprice") / 100000).alias("p"))
    return E.holm(t, ["p_brand"], "p", ["p_type"]).select("p_brand", "p_type", F.round("p_holm", 9).alias("p_holm"))


@query(
    """WITH s AS (SELECT o_orderpriority, o_totalprice score, count(*) FILTER (WHERE o_orderstatus = 'F') r, count(*) FILTER (WHERE o_orderstatus <> 'F') w FROM orders GROUP BY ALL), x AS (SELECT *, coalesce(sum(r) OVER (PARTITION BY o_orderpriority ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b FROM s)
SELECT o_orderpriority, round(sum(w * (b + r / 2)) / nullif(sum(r) * sum(w), 0), 9) wrong_rate FROM x GROUP BY 1"""
)
def wrong_fact_rate(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderpriority", F.col("o_totalprice").alias("score"), (F.col("o_orderstatus") == "F").alias("ok"))
    return E.wrong_rate(o, ["o_orderpriority"]).withColumn("wrong_rate", F.round("wrong_rate", 9))


@query("WITH d AS (SELECT n_name AS level, c_acctbal - s_acctbal AS d FROM customer JOIN supplier ON c_custkey = s_suppkey JOIN nation ON c_nationkey = n_nationkey) SELECT level, round(avg(d), 6) mean, count(*) FILTER (WHERE d > 1e-9) better, count(*) FILTER (WHERE abs(d) <= 1e-9) same, count(*) FILTER (WHERE d < -1e-9) worse FROM d GROUP BY level")
def paired_diff(spark, sf):
    c = _t(spark, sf, "customer").join(_t(spark, sf, "supplier"), F.col("c_custkey") == F.col("s_suppkey")).join(F.broadcast(_t(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return E.paired_summary(c.select(F.col("n_name").alias("level"), (F.col("c_acctbal") - F.col("s_acctbal")).alias("d")), ["level"]).withColumn("mean", F.round("mean", 6))


@query("SELECT o_orderpriority AS level, max(x) FILTER (WHERE o_orderstatus = 'F') AS F, max(x) FILTER (WHERE o_orderstatus = 'O') AS O, max(x) FILTER (WHERE o_orderstatus = 'P') AS P FROM (SELECT o_orderpriority, o_orderstatus, count(*) || ' [' || min(o_orderkey) || ', ' || max(o_orderkey) || ']' x FROM orders GROUP BY 1, 2) GROUP BY 1")
def interval_pivot(spark, sf):
    x = _t(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("level"), "o_orderstatus").agg(F.format_string("%d [%d, %d]", F.count("*"), F.min("o_orderkey"), F.max("o_orderkey")).alias("x"))
    return x.groupBy("level").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.first("x"))


@query("SELECT l_returnflag AS level, round(avg(l_quantity) FILTER (WHERE l_linestatus = 'F'), 6) AS F, round(avg(l_quantity) FILTER (WHERE l_linestatus = 'O'), 6) AS O FROM lineitem GROUP BY 1")
def grid_means(spark, sf):
    x = E.level_grid(_t(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "level"), "l_linestatus", ["F", "O"], "l_quantity")
    return x.select("level", F.round("F", 6).alias("F"), F.round("O", 6).alias("O"))


@query("SELECT c_mktsegment, min(c_acctbal) AS min, round(quantile_cont(c_acctbal, 0.25), 6) q1, round(quantile_cont(c_acctbal, 0.5), 6) median, round(quantile_cont(c_acctbal, 0.75), 6) q3, max(c_acctbal) AS max FROM customer GROUP BY 1")
def quartiles(spark, sf):
    out = E.describe(_t(spark, sf, "customer"), "c_acctbal", ["c_mktsegment"])
    return out.select("c_mktsegment", "min", *(F.round(c, 6).alias(c) for c in ("q1", "median", "q3")), "max")


@query("SELECT event_type, count(*) AS n, sum((props::JSON ->> 'k')::INT) AS total FROM events GROUP BY 1")
def props_total(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return _t(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


@query("SELECT count(*) AS sentences, count(DISTINCT o_custkey) AS excerpts, (SELECT max(c) FROM (SELECT count(*) c FROM orders GROUP BY o_custkey)) AS most_from_one, (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1)) AS in_both FROM orders")
def sample_spread(spark, sf):
    return P.sample_spread(_t(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("split")))


@query("SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) k FROM orders) WHERE k <= CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 2 WHEN '5-LOW' THEN 1 ELSE 0 END")
def quota_first(spark, sf):
    return P.quota_first(_t(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate"), "o_orderpriority", {"1-URGENT": 2, "2-HIGH": 2, "5-LOW": 1}, ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


TEMPLATE = "[system]\nYou repair text.\n[user]\nTurn {turn} of {k}: {sentence}"


@query("WITH n AS (SELECT conv_id, count(*) k FROM conversations GROUP BY conv_id) SELECT conv_id, turn, 'You repair text.' AS system, 'Turn ' || turn || ' of ' || k || ': ' || text AS \"user\" FROM conversations JOIN n USING (conv_id)")
def prompt_messages(spark, sf):
    c = _t(spark, sf, "conversations")
    c = c.join(c.groupBy("conv_id").agg(F.count("*").alias("k")), "conv_id")
    m = R.messages(TEMPLATE, {"turn": F.col("turn"), "k": F.col("k"), "sentence": F.col("text")})
    return c.select("conv_id", "turn", m[0]["content"].alias("system"), m[1]["content"].alias("user"))


@query(f"WITH {Q.SENT}, t AS (SELECT doc_id, min(id) id FROM sent WHERE len(fact_idx) > 0 GROUP BY doc_id) SELECT t.id, string_agg(CASE WHEN sent.id = t.id THEN '<<< ' || upper(sent.id) || ' >>>' ELSE text END, ' ' ORDER BY sent.id) context FROM t JOIN sent USING (doc_id) GROUP BY t.id")
def article_context(spark, sf):
    """Every document around its first sentence with a fact."""
    s = Z.checkpointed(_sentences(spark, sf).select("id", "doc_id", "text", "n_facts")).withColumn("pos", F.col("id"))
    targets = s.where("n_facts > 0").groupBy("doc_id").agg(F.min("id").alias("id")).withColumn("pos", F.col("id")).withColumn("view", F.upper("id"))
    return R.article_context(s.select("doc_id", "pos", "text"), targets)


@query("SELECT 'orders' AS place, 'rows' AS quantity, count(*)::VARCHAR AS \"value\" FROM orders UNION ALL SELECT 'orders', 'customers', count(DISTINCT o_custkey)::VARCHAR FROM orders UNION ALL SELECT 'lineitem', 'rows', count(*)::VARCHAR FROM lineitem")
def recap_numbers(spark, sf):
    o, l = _t(spark, sf, "orders"), _t(spark, sf, "lineitem")
    return E.recap([("orders", o.agg(F.count("*").alias("rows"), F.countDistinct("o_custkey").alias("customers"))), ("lineitem", l.agg(F.count("*").alias("rows")))])


@query("SELECT c_nationkey AS key, max(c_name) FILTER (WHERE c_mktsegment = 'BUILDING') AS \"BUILDING\", max(c_name) FILTER (WHERE c_mktsegment = 'MACHINERY') AS \"MACHINERY\" FROM (SELECT c_nationkey, c_mktsegment, min(c_name) c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY ALL) GROUP BY 1")
def side_by_side(spark, sf):
    c = _t(spark, sf, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).groupBy(F.col("c_nationkey").alias("key"), F.col("c_mktsegment").alias("method")).agg(F.min("c_name").alias("text"))
    return E.side_by_side(c, ["key"], ["BUILDING", "MACHINERY"], "text")
