"""Sources, sinks and the store as queries: what is written is read back, and SQL gives what must come out."""

from __future__ import annotations

import json
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmend.functions import text as T
from textmend.operators import evaluate as E
from textmend.operators import repair as R
from textmend.operators import slots as L
from textmend.plans import sql as Q
from textmend.plans.queries import _damage, _pool, _sentences, _t, query
from textmend.schemas import PREDICTION, PREDICTION_KEY
from textmend.sources import corpus as S
from textmend.sources import store as Z


def _folder(spark: SparkSession) -> str:
    """A folder of its own in the shared one; it goes when the session ends."""
    folder = f"{Z.shared_folder(spark)}/files-{uuid.uuid4()}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def _texts(spark, sf, lower: bool = False) -> str:
    """The benchmark's items, a file each."""
    rows = _t(spark, sf, "benchmark").groupBy(F.col("item_id").cast("string").alias("name")).agg(F.first("text").alias("text"))
    folder = _folder(spark)
    S.write_texts(rows.select("name", F.lower("text").alias("text") if lower else "text"), folder)
    return folder


_ITEMS = "items AS (SELECT item_id::VARCHAR doc_id, text FROM benchmark)"
_NORMAL = "list_filter(list_transform(string_split_regex(regexp_replace(replace({0}, chr(160), ' '), '([A-Za-z])-\\n([a-z])', '\\1-\\2', 'g'), '\\n\\s*\\n'), lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'))), lambda p: p <> '')"


@query(f"WITH {_ITEMS} SELECT doc_id, {_NORMAL.format('text')} AS paragraphs FROM items")
def text_folder(spark, sf):
    return S.read_texts(spark, _texts(spark, sf))


@query(f"WITH {_ITEMS} SELECT doc_id, array_to_string({_NORMAL.format('text')}, ' ') AS gold, array_to_string({_NORMAL.format('lower(text)')}, ' ') AS other FROM items")
def pair_scan(spark, sf):
    return S.read_pairs(spark, _texts(spark, sf), _texts(spark, sf, lower=True))


@query(f"WITH {_ITEMS} SELECT doc_id, octet_length(encode(text)) AS length, sha256(replace(text, chr(13) || chr(10), chr(10))) AS sha256 FROM items")
def file_digests(spark, sf):
    out = Z.file_digests(spark, f"{_texts(spark, sf)}/*.txt")
    return out.select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("doc_id"), "length", "sha256")


@query("SELECT n_nationkey AS doc_id, n_name AS source_id, n_name || ' & Co' AS publication, (1800 + n_nationkey)::INT AS year FROM nation")
def metadata_scan(spark, sf):
    n = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("short_id"), F.col("n_name").alias("doc_id"), F.concat((1800 + F.col("n_nationkey")).cast("string"), F.lit("-05-01")).alias("date"), F.concat("n_name", F.lit(" &amp; Co")).alias("publication"))
    folder = _folder(spark)
    n.agg(F.to_json(F.collect_list(F.struct(*n.columns))).alias("value")).coalesce(1).write.text(folder)
    return S.read_metadata(spark, folder).select(F.col("doc_id").cast("int").alias("doc_id"), "source_id", "publication", "year")


@query("SELECT * FROM customer")
def jsonl_round_trip(spark, sf):
    c, folder = _t(spark, sf, "customer"), _folder(spark)
    S.write_jsonl(c, folder)
    return S.read_jsonl(spark, folder, c.schema)


@query("""SELECT '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS line FROM nation""")
def canonical_lines(spark, sf):
    folder = _folder(spark)
    S.write_jsonl(_t(spark, sf, "nation"), folder, sort_keys=True)
    return spark.read.text(folder).select(F.col("value").alias("line"))


@query("SELECT * FROM part")
def csv_round_trip(spark, sf):
    p, folder = _t(spark, sf, "part"), _folder(spark)
    S.write_csv(p, folder)
    return S.read_csv(spark, folder, p.schema)


@query(f"WITH {Q.SENT} SELECT DISTINCT doc_id FROM sent")
def jsonl_docs(spark, sf):
    s, folder = _sentences(spark, sf), _folder(spark)
    S.write_jsonl(s, folder)
    return S.distinct_docs(S.read_jsonl(spark, folder, s.schema))


@query(f"WITH {Q.POOL} SELECT id, doc_id, text, len(w)::INT n_words, len(fact_idx)::INT n_facts FROM pool")
def frozen_pool(spark, sf):
    folder = _folder(spark)
    told = Z.freeze_pool(_pool(spark, sf), folder, "1")
    return Z.load_frozen(spark, folder, "1", told).select("id", "doc_id", "text", "n_words", "n_facts")


@query("SELECT 'written' AS first, 'unchanged' AS again, true AS refused, true AS rebuilt_alike, false AS other_alike, count(*) AS frozen_rows, '1' AS version FROM customer")
def freeze_checks(spark, sf):
    c, folder = _t(spark, sf, "customer"), _folder(spark)
    first, again = Z.freeze(c, folder, "1"), Z.freeze(c.orderBy(F.desc("c_custkey")), folder, "1")
    try:
        Z.freeze(c.withColumn("c_name", F.upper("c_name")), folder, "1")
        refused = False
    except ValueError:
        refused = True
    told = json.loads(Z.snapshot("1", {"seed": 42}, "customer", Z.digest(c), {}))
    alike = Z.rebuilt_alike(spark, folder, "1", c), Z.rebuilt_alike(spark, folder, "1", c.withColumn("c_acctbal", F.col("c_acctbal") + 1))
    return spark.createDataFrame([(first, again, refused, *alike, told["digest"]["rows"], told["version"])], "first string, again string, refused boolean, rebuilt_alike boolean, other_alike boolean, frozen_rows long, version string")


@query("SELECT * FROM (VALUES ('lookup', 'version', 'v2'), ('rerank', 'beam', '5'), ('rerank', 'lam', '1.5'), ('rerank', 'top_n', '10'), ('seq2seq', 'refused', 'max_length')) t(method, name, value)")
def method_configs(spark, sf):
    rows = []
    with tempfile.TemporaryDirectory() as folder:  # read by the driver only
        for method, text in (("lookup", "version: v2\n"), ("rerank", "lam: 1.5\nbeam: 5\ntop_n: 10\n"), ("seq2seq", "num_beams: 1\n")):
            Path(folder, method).write_text(text)
            try:
                found = S.merged_config(S.read_method_config(f"{folder}/{method}", method), {})
                rows += [(method, k, str(v)) for k, v in found.items()]
            except ValueError as e:
                rows.append((method, "refused", "max_length" if "['max_length']" in str(e) else str(e)))
    return spark.createDataFrame(rows, "method string, name string, value string")


@query("SELECT o_orderkey, 2 AS n_rows, ['kind', 'state'] AS head, [o_orderpriority, o_orderstatus || ' & more'] AS cells FROM orders")
def html_tables(spark, sf):
    page = F.concat(F.lit("<p>before</p><table><tr><th>kind</th><th> state</th></tr><tr><td>\n"), "o_orderpriority", F.lit("</td><td><b>"), "o_orderstatus", F.lit("</b> &amp;\n more</td></tr></table>"))
    o = _t(spark, sf, "orders").select("o_orderkey", S.html_tables(page).alias("t"))
    return o.select("o_orderkey", F.size(F.get("t", F.lit(0))).alias("n_rows"), F.get(F.get("t", F.lit(0)), F.lit(0)).alias("head"), F.get(F.get("t", F.lit(0)), F.lit(1)).alias("cells"))


@query(r"""SELECT '\begin{tabular}{ll}' || chr(10) || '\toprule' || chr(10) || 'r\_regionkey & r\_name \\' || chr(10) || '\midrule' || chr(10) || string_agg(r_regionkey || ' & ' || r_name || ' \\', chr(10) ORDER BY r_regionkey) || chr(10) || '\bottomrule' || chr(10) || '\end{tabular}' AS latex FROM region""")
def latex_table(spark, sf):
    return spark.createDataFrame([(S.latex_table(_t(spark, sf, "region").select("r_regionkey", "r_name").orderBy("r_regionkey")),)], "latex string")


# store


@query(f"WITH {Q.POOL}, p AS (SELECT doc_id::BIGINT % 2 = 0 AS even FROM pool) SELECT count(*) FILTER (WHERE even) AS first, count(*) FILTER (WHERE NOT even) AS second, 0 AS third, count(*) AS calls, count(*) AS stored, count(*) AS keys, count(*) AS good, true AS closed, true AS refused FROM p")
def store_resume(spark, sf):
    """The runner over all sentences at the lowest level: half of the documents, then all, then all again. Each row is asked
    for once, the test split is closed, and keys that are stored are refused."""
    damage, path = Z.checkpointed(_damage(spark, sf).where("severity in ('0', '1w')")), f"{_folder(spark)}/store"
    calls = spark.sparkContext.accumulator(0)

    def predict(view: dict) -> dict:
        calls.add(1)
        return {"pred_words": [s["out"] for s in view["slots"]], "raw_output": view["id"]}

    run = lambda d: Z.run_method(d, predict, "echo", "v1", "none", path)
    first, second, third = run(damage.where(F.col("doc_id").cast("long") % 2 == 0)), run(damage), run(damage)
    try:
        run(damage.withColumn("split", F.lit("test")))
        closed = False
    except PermissionError:
        closed = True
    got = Z.load_predictions(spark, path)
    try:
        Z.append_predictions(got.where("method = 'echo'"), path)
        refused = False
    except ValueError:
        refused = True
    by_path = spark.read.schema(PREDICTION).parquet(path).where("method = 'echo' and method_version = 'v1'")
    stored, keys, good = by_path.count(), got.select(*PREDICTION_KEY).distinct().count(), got.where("format_ok and spliced_text is not null").count()
    return spark.createDataFrame([(first, second, third, calls.value, stored, keys, good, closed, refused)], "first long, second long, third int, calls long, stored long, keys long, good long, closed boolean, refused boolean")


@query("SELECT event_type AS method, 'all' AS severity, count(*) AS rows, round(avg(value), 6) AS mean_seconds, round(sum(value), 3) AS seconds FROM events GROUP BY 1")
def timing_summary(spark, sf):
    e = _t(spark, sf, "events").select(F.col("event_type").alias("method"), F.lit("all").alias("severity"), F.col("value").alias("seconds"))
    return Z.timing(e).withColumn("mean_seconds", F.round("mean_seconds", 6)).withColumn("seconds", F.round("seconds", 3))


@query("SELECT 0 AS n")
def no_predictions(spark, sf):
    """A store that isn't there yet has no rows."""
    return Z.load_predictions(spark, _folder(spark)).agg(F.count("*").cast("int").alias("n"))


@query("SELECT * FROM (VALUES ('lookup', 'v2-dev'), ('rerank', 'ft-l1.5-b5-n10-x20-dev'), ('rerank plain', 'ft-l1-b5-n10-test'), ('seq2seq', 'ft-greedy-dev'), ('seq2seq beams', 'ft-beam4-dev'), ('settings', left(sha256('{\"beam\": 5, \"lam\": 1}'), 6))) t(kind, version)")
def method_versions(spark, sf):
    rows = [("lookup", R.lexicon_version("v2", "dev")), ("rerank", R.rerank_version("ft", 1.5, 5, 10, 20, "dev")), ("rerank plain", R.rerank_version("ft", 1, 5, 10, 0, "test")), ("seq2seq", R.seq2seq_version("ft", 1, "dev")), ("seq2seq beams", R.seq2seq_version("ft", 4, "dev")), ("settings", R.settings_tag({"lam": 1, "beam": 5}))]
    return spark.createDataFrame(rows, "kind string, version string")


@query("SELECT status, again, first_wait::DOUBLE AS first_wait, fourth_wait::DOUBLE AS fourth_wait FROM (VALUES (200, false, 2.0, 16.0), (400, false, 2.0, 16.0), (429, true, 31.0, 31.0), (500, true, 2.0, 16.0), (503, true, 2.0, 16.0), (0, true, 2.0, 16.0)) t(status, again, first_wait, fourth_wait)")
def retry_rules(spark, sf):
    """Which answers are asked for again, and how long that waits; 0 stands for no answer at all, and the server's reset is in 30
    seconds."""
    rows = []
    for status in (200, 400, 429, 500, 503, 0):
        s = status or None
        rows.append((status, R.retryable(s), R.wait_before(0, s, 30.0), R.wait_before(3, s, 30.0)))
    return spark.createDataFrame([(a, b, float(c), float(d)) for a, b, c, d in rows], "status int, again boolean, first_wait double, fourth_wait double")


@query("SELECT 'a' AS offered, 'ok' AS content, 3 AS sent, '2.0 4.0' AS waits, true AS refused")
def chat_client(spark, sf):
    """An injected client that fails twice: one chat, its waits, and the models that are both offered and allowed."""
    waits, sent = [], []

    class Fault(Exception):
        status = 500

    def send(payload: dict) -> dict:
        sent.append(payload["model"])
        if len(sent) < 3:
            raise Fault
        return {"content": "ok"}

    client = R.Client(send, ["a", "c"], sleep=waits.append)
    try:
        client.chat("b", [])
        refused = False
    except ValueError:
        refused = True
    content = client.chat("a", [{"role": "user", "content": "x"}])["content"]
    return spark.createDataFrame([(" ".join(client.list_models(lambda: ["b", "a"])), content, len(sent), " ".join(map(str, waits)), refused)], "offered string, content string, sent int, waits string, refused boolean")


# slots and answers over all damage


@query(f"WITH {Q.SPANS} SELECT 'pool' AS split, severity, count(*) AS rows, count(*) FILTER (WHERE k > 0) AS with_slots FROM span GROUP BY severity")
def row_counts(spark, sf):
    return L.row_counts(_damage(spark, sf))


@query(f"WITH {Q.SPANS} SELECT id, severity, array_to_string(w[span_start + 1 : span_start + k], ' ') AS gold, list_transform(range(0, k), lambda i: i::INT) AS places FROM span WHERE k > 0")
def span_rows(spark, sf):
    d = _damage(spark, sf).where("k > 0")
    tokens, moved = L.span_parts(F.col("gold_tokens"), L.by_place(F.col("ops_per_word")), F.col("span_start"), F.col("span_end"))
    return d.select("id", "severity", F.array_join(tokens, " ").alias("gold"), F.transform(moved, lambda p: p["idx"]).alias("places"))


@query(f"WITH {Q.SPANS} SELECT id, severity, array_to_string(list_transform(w, lambda t, i: CASE WHEN i > span_start AND i <= span_start + k THEN '{{ ' || t || ' }}' ELSE t END), ' ') AS target FROM span WHERE k > 0")
def brace_targets(spark, sf):
    d = _damage(spark, sf).where("k > 0")
    return d.select("id", "severity", L.brace_target(F.col("gold_tokens"), F.col("ops_per_word")).alias("target"))


@query(f"SELECT token, {Q.edge('token', 1)} || CASE WHEN {Q.edge('token', 2)} = '' THEN 'x' ELSE 'x' || {Q.edge('token', 2)} END || {Q.edge('token', 3)} AS framed FROM (SELECT DISTINCT unnest({Q.words('text')}) token FROM benchmark)")
def reframed_words(spark, sf):
    t = _t(spark, sf, "benchmark").select(F.explode(T.words(F.col("text"))).alias("token")).distinct()
    return t.select("token", L.reframe(F.concat(F.lit("x"), T.edge_parts(F.col("token"))[1]), F.col("token")).alias("framed"))


@query(f"""WITH {Q.DAMAGE}, c AS (SELECT *, CASE WHEN {Q.edge('token', 2)} <> '' THEN {Q.edge('token', 2)} ELSE token END core FROM dmg),
p AS (SELECT *, idx IN (SELECT unnest(fact_idx)) AS fact, ceil(length(core) / 4)::INT whole, CASE WHEN dropped THEN [core] ELSE list_filter(string_split_regex(core, '[^0-9A-Za-zÀ-ɏ]+'), lambda x: x <> '') END ps FROM c JOIN (SELECT id, fact_idx FROM pool) USING (id)),
r AS (SELECT *, list_max(list_transform(CASE WHEN len(ps) = 0 THEN [core] ELSE ps END, lambda x: ceil(length(x) / 4)::INT)) split_max FROM p)
SELECT slots, count(*) AS n, round(avg((whole > 3)::INT), 6) AS whole_word, round(avg((split_max > 3)::INT), 6) AS split_word FROM (SELECT 'all' AS slots, whole, split_max FROM r UNION ALL SELECT 'fact', whole, split_max FROM r WHERE fact UNION ALL SELECT 'anchor', whole, split_max FROM r WHERE is_anchor) GROUP BY slots""".replace("idx IN (SELECT unnest(fact_idx)) AS fact", "list_contains(fact_idx, idx) AS fact"))
def piece_ceiling(spark, sf):
    rows = L.ceiling_rows(_damage(spark, sf), lambda c: F.ceil(F.char_length(c) / 4).cast("int"))
    return L.ceiling_table(rows).withColumn("whole_word", F.round("whole_word", 6)).withColumn("split_word", F.round("split_word", 6))


@query(f"""WITH {Q.DAMAGE}, s AS (SELECT id, severity, idx, CASE WHEN dropped THEN '' ELSE {Q.edge('out', 2)} END core FROM spot WHERE severity = '25' AND idx IS NOT NULL)
SELECT id, severity, list(CASE WHEN core = '' THEN 'aa' ELSE regexp_replace(core, '[0-9A-Za-zÀ-ɏ]+', 'aa', 'g') END ORDER BY idx) AS pred_words FROM s GROUP BY id, severity""")
def fill_rows(spark, sf):
    """Left-to-right filling of all slots of a level with a model that likes one word best, whatever it's like."""
    views = L.build_slots(_damage(spark, sf).where("severity = '25'"))
    return R.fill_rows(views, lambda texts, dropped: [[[("aa", -1.0), ("bbb", -2.0)]] for _ in texts], lam=0.0, masks=1)


@query(f"WITH {Q.DAMAGE} SELECT id, severity, list(CASE WHEN dropped THEN '?' ELSE out END ORDER BY idx) AS pred_words FROM spot WHERE idx IS NOT NULL GROUP BY id, severity")
def seq2seq_answers(spark, sf):
    """A sequence model that gives back what it was given: the answers are the damaged words."""
    v = L.build_slots(_damage(spark, sf).where("k > 0"))
    rows = v.select("id", "severity", F.col("k").cast("int").alias("k"), L.brace_view(F.col("words"), F.col("slots")).alias("source"))
    return R.seq2seq_answers(rows, lambda texts: list(texts)).select("id", "severity", "pred_words")


@query("SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS id, [length(text), length(text) + 1] AS scores FROM conversations")
def mask_scores(spark, sf):
    """An injected model (a text's length) on the variants of each row, in batches."""
    c = _t(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.array("text", F.concat("text", F.lit("x"))).alias("texts"))
    return R.mask_scores(c, lambda texts: [len(t) for t in texts], "long")


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN NULL ELSE [event_type, '?'] END AS answers FROM events")
def bracketed_answers(spark, sf):
    """Two answers in braces are read; one is none."""
    told = F.concat(F.lit("the { "), "event_type", F.when(F.col("event_type") == "click", F.lit(" }")).otherwise(F.lit(" } and {?}.")))
    return _t(spark, sf, "events").select("event_id", T.bracketed(told, F.lit(2)).alias("answers"))


@query("SELECT p_partkey, list_filter([0, 1, 2], lambda i: contains(trim([p_brand, p_type, ' ' || p_name || ' '][i + 1]), ' ')) AS spaced FROM part")
def multiword_answers(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", T.multiword(F.array("p_brand", "p_type", F.concat(F.lit(" "), "p_name", F.lit(" ")))).alias("spaced"))


@query(f"WITH c AS (SELECT DISTINCT {Q.edge('token', 2)} core FROM (SELECT unnest({Q.words('text')}) token FROM benchmark)) SELECT core, list_filter(string_split_regex(core, '[^0-9A-Za-zÀ-ɏ]+'), lambda x: x <> '') AS parts, regexp_extract_all(regexp_replace(core, '^[^0-9A-Za-zÀ-ɏ]+|[^0-9A-Za-zÀ-ɏ]+$', '', 'g'), '[^0-9A-Za-zÀ-ɏ]+') AS marks FROM c WHERE core <> ''")
def parts_and_marks(spark, sf):
    t = _t(spark, sf, "benchmark").select(F.explode(T.words(F.col("text"))).alias("token")).select(T.edge_parts(F.col("token"))[1].alias("core")).where("core <> ''").distinct()
    return t.select("core", F.filter(F.split("core", T.INNER), lambda p: p != "").alias("parts"), T.separators(F.col("core")).alias("marks"))


@query("""SELECT event_id, CASE kind WHEN 0 THEN [event_type] WHEN 6 THEN [event_type] END AS pred_words,
CASE kind WHEN 1 THEN 'cut off at the longest answer' WHEN 2 THEN 'holds no list' WHEN 3 THEN '2 words for 1 slots' WHEN 4 THEN 'holds more than text' WHEN 5 THEN 'holds no list' END AS error FROM (SELECT event_id, event_type, event_id % 7 kind FROM events)""")
def answer_faults(spark, sf):
    """Good answers, some in prose or fences, and each kind of fault."""
    word = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    t, kind = F.col("event_type"), F.col("event_id") % 7
    forms = [word('["', t, '"]'), word('["', t, '"]'), word("no ", t), word('["', t, '", "b"]'), F.lit("[1]"), word('["', t), word('so [x\n```json\n["', t, '"]\n``` or ["c"]')]
    content = F.coalesce(*(F.when(kind == i, f) for i, f in enumerate(forms)))
    rows = _t(spark, sf, "events").select("event_id", content.alias("content"), F.when(kind == 1, "length").otherwise("stop").alias("finish_reason"), F.lit(1).alias("k"))
    return R.parse_answers(rows).select("event_id", "pred_words", "error")


def _predictions(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Damage, written once for its four readers, and two methods' answers: the words as they were, and as they are."""
    d = Z.checkpointed(_damage(spark, sf).where("k > 0"))
    plans = L.by_place(F.col("ops_per_word"))
    one = lambda name, field: d.select("id", "severity", F.lit(name).alias("method"), F.transform(plans, lambda p: p[field]).alias("pred_words"))
    return d, one("gold", "gold").unionAll(one("damaged", "out"))


@query(f"""WITH {Q.SPANS}, n AS (SELECT severity AS level, count(*) n FROM span WHERE k > 0 GROUP BY 1) SELECT method, level, n, (method = 'gold')::INT::DOUBLE AS exact, (method = 'gold')::INT::DOUBLE AS anchor, (method = 'gold')::INT::DOUBLE AS facts, CASE WHEN method <> 'no repair' THEN n ELSE 0 END AS well_formed, CASE WHEN method = 'gold' THEN 0 ELSE n END AS unlike
FROM n, (VALUES ('gold'), ('damaged'), ('no repair')) m(method)""")
def repair_scores(spark, sf):
    """Scores of perfect answers, of the damaged words, and of no repair at all."""
    s = E.row_scores(E.with_no_repair(*_predictions(spark, sf)))
    return s.groupBy("method", "level").agg(F.count("*").alias("n"), F.avg("exact").alias("exact"), F.avg(F.col("anchor_ok").cast("int")).alias("anchor"), F.avg("fact_recovery").alias("facts"), F.count_if("format_ok").alias("well_formed"), F.count_if(F.col("edits_after") > 0).alias("unlike"))


@query(f"WITH {Q.DAMAGE}, f AS (SELECT id, severity, count(idx) FILTER (WHERE list_contains(fact_idx, pos)) n, count(idx) FILTER (WHERE list_contains(fact_idx, pos) AND dropped) gone FROM spot WHERE k > 0 GROUP BY id, severity) SELECT severity, sum(n) AS fact_slots, sum(n - gone) AS visible, sum(gone) AS dropped, round(avg(n), 6) AS per_sentence FROM f GROUP BY severity")
def fact_slots(spark, sf):
    return E.fact_slots(_damage(spark, sf)).withColumn("per_sentence", F.round("per_sentence", 6))


@query(f"""WITH {Q.DAMAGE} SELECT id, severity AS level, any_value(k)::INT k, coalesce(string_agg(t, ', ' ORDER BY pos) FILTER (WHERE idx IS NOT NULL AND list_contains(fact_idx, pos)), '') AS facts, string_agg(CASE WHEN idx IS NULL THEN t ELSE '[[' || out || ']]' END, ' ' ORDER BY pos) damaged FROM spot GROUP BY id, severity""")
def review_table(spark, sf):
    from textmend.operators import damage as D

    return D.review_table(_damage(spark, sf)).select("id", "level", "k", "facts", "damaged")
