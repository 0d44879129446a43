"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmend.sources.corpus import spread

from . import decontaminate, html_extract, toxicity, url_filters, warc
from . import quality_rules as quality_rules_module
from .ngram_jaccard import ngram_jaccard_join
from .packing import pack
from .quality_rules import fit, quality_rules
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # a table of fewer splits than cores is dealt out
    return spread(rows, *rows.columns) if name in ("documents", "pages") else rows


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    ratio = fit(docs, labels.where("quality = 1").select("doc_id"))
    out = quality_rules(docs.select("doc_id", "text"), ratio)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents"))
    words = F.trim(F.regexp_replace("kept", r"[\x20\x09-\x0D]+", " "))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    out = url_filters.url_filter(_table(spark, sf_dir, "pages"), url_filters.RULES, labels)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = html_extract.train(html_extract.labelled_pages())
    return html_extract.html_extract(_table(spark, sf_dir, "pages"), model).select("page_id", "url", "text", "n_chars")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    out = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return out.select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_quality_rules, op3_ngram_jaccard_join, op4_substring_dedup, op5_url_filters, op6_html_extract, op7_packing, op8_warc, op9_decontaminate, op10_toxicity)}
_WORDS = "list_filter(string_split_regex({0}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": """WITH d AS (SELECT doc_id, md5(coalesce(text, '')) h, any_value(hex(encode(coalesce(text, '')))) x FROM documents GROUP BY ALL),
win AS (SELECT doc_id, h, p, substr(x, 2 * p + 1, 100) v FROM (SELECT doc_id, h, x, unnest(range(0, greatest(0, len(x) // 2 - 49))) p FROM d)),
low AS (SELECT v, min(doc_id) least FROM win GROUP BY v),
hit AS (SELECT DISTINCT doc_id, h, p FROM win JOIN low USING (v) WHERE least < doc_id),
mark AS (SELECT *, max(p + 50) OVER (PARTITION BY doc_id, h ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) upto FROM hit),
run AS (SELECT *, sum(CASE WHEN upto IS NULL OR p > upto THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, h ORDER BY p) k FROM mark),
span AS (SELECT doc_id, h, k, min(p) a, max(p) + 50 z FROM run GROUP BY ALL),
gap AS (SELECT doc_id, h, coalesce(lag(z) OVER w, 0) a, a z, a = max(a) OVER (PARTITION BY doc_id, h) AS final, z after FROM span WINDOW w AS (PARTITION BY doc_id, h ORDER BY a)),
kept AS (SELECT doc_id, h, string_agg(substr(x, 2 * gap.a + 1, 2 * (gap.z - gap.a)) || CASE WHEN final THEN substr(x, 2 * after + 1) ELSE '' END, '' ORDER BY gap.a) x, count(*) n_spans FROM gap JOIN d USING (doc_id, h) GROUP BY ALL)
SELECT o.doc_id, len(d.x) // 2 AS n_bytes, (len(d.x) - len(coalesce(kept.x, d.x))) // 2 AS n_removed, coalesce(n_spans, 0)::BIGINT n_spans, sha256(unhex(coalesce(kept.x, d.x))) kept_sha256
FROM documents o JOIN d ON o.doc_id = d.doc_id AND md5(coalesce(text, '')) = d.h LEFT JOIN kept ON d.doc_id = kept.doc_id AND d.h = kept.h""",
    "op2_quality_rules": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') t, {_WORDS.format("coalesce(text, '')")} w, hex(encode(coalesce(text, ''))) x FROM documents),
line AS (SELECT r, unnest(string_split(t, chr(10))) x FROM d), dup AS (SELECT r, count(*) - count(DISTINCT x) n FROM line WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY r),
win AS (SELECT r, p, array_to_string(w[p : p + 7], ' ') v FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 6))) p FROM d)), again AS (SELECT r, v FROM win GROUP BY r, v HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT q) n FROM (SELECT r, unnest(range(p, p + 8)) q FROM win JOIN again USING (r, v)) GROUP BY r),
gram AS (SELECT r, v, count(*) c FROM (SELECT r, substr(x, 2 * p + 1, 8) v FROM (SELECT r, x, unnest(range(0, greatest(0, len(x) // 2 - {quality_rules_module.ORDER - 1}))) p FROM d)) GROUP BY r, v),
slot AS (SELECT v, (('0x' || v[7:8] || v[5:6] || v[3:4] || v[1:2])::BIGINT::HUGEINT * 2654435761 % 4294967296 // 65536)::INT s FROM (SELECT DISTINCT v FROM gram)),
trusted AS (SELECT r FROM d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
n AS (SELECT s, sum(c) raw, coalesce(sum(c) FILTER (WHERE r IN (SELECT r FROM trusted)), 0) target FROM gram JOIN slot USING (v) GROUP BY s), whole AS (SELECT sum(raw) raws, sum(target) targets FROM n),
ratio AS (SELECT s, CASE WHEN targets = 0 THEN 0 ELSE ln((target + 0.5) / (targets + {quality_rules_module.SLOTS // 2})) - ln((raw + 0.5) / (raws + {quality_rules_module.SLOTS // 2})) END::FLOAT::DOUBLE v FROM n, whole),
score AS (SELECT r, sum(c * ratio.v) / sum(c) score FROM gram JOIN slot USING (v) JOIN ratio USING (s) GROUP BY r),
base AS (SELECT d.r, doc_id, len(w)::BIGINT n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0)::BIGINT word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT n_symbols, coalesce(dup.n, 0) n_dup_lines, coalesce(rep.n, 0) n_repeat_words, coalesce(score, 0) score FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN score USING (r)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND score >= {quality_rules_module.THRESHOLD} AS kept, round(score, 6) AS score FROM judged""",
    "op3_ngram_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) s FROM w),
n AS (SELECT doc_id, count(*) n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id a, b.doc_id b, count(*) k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT doc_id a, doc_id b FROM n UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT n_shingles, coalesce(m, w.doc_id) component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) m FROM reach GROUP BY a) c ON c.a = w.doc_id""",
    "op4_substring_dedup": f"""WITH w AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS.format("coalesce(text, '')")} w FROM documents),
win AS (SELECT r, p, array_to_string(w[p : p + 34], ' ') v FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 33))) p FROM w)),
twice AS (SELECT v FROM win GROUP BY v HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 35)) q FROM win JOIN twice USING (v)),
word AS (SELECT r, unnest(w) x, generate_subscripts(w, 1) q FROM w),
kept AS (SELECT r, count(*) n, string_agg(x, ' ' ORDER BY q) t FROM word ANTI JOIN gone USING (r, q) GROUP BY r)
SELECT doc_id, len(w)::BIGINT n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) kept_sha256 FROM w LEFT JOIN kept USING (r)""",
    "op5_url_filters": url_filters.SQL,
    "op8_warc": """WITH p AS (SELECT page_id, sha256(coalesce(html, '')) d, octet_length(encode(coalesce(html, ''))) n FROM pages),
f AS (SELECT d, min(page_id) f FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN f IS NOT NULL AND f < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN f < page_id THEN f END AS refers_to
FROM p LEFT JOIN f USING (d)""",
    "op9_decontaminate": decontaminate.SQL,
}
