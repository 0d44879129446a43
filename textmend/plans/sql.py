"""Parts of DuckDB SQL that several queries share."""

from textmend.functions.text import NOT_FACTS, STRIPPED, TITLES
from textmend.operators import damage as D
from textmend.operators.pool import LENGTH_BINS
from textmend.schemas import CONFIG

LIST = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
EDGE = r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$"
TRIM = "'" + STRIPPED.replace("'", "''") + "'"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


def fact(t: str, i: str, before: str) -> str:
    core = f"regexp_replace({t}, '{EDGE}', '', 'g')"
    return f"""(regexp_matches({t}, '[\\p{{Nd}}²³¹⁰-⁹]') OR contains({t}, '£') OR ({i} > 0 AND regexp_matches({core}, '^\\p{{Lu}}') AND {core} <> 'I' AND lower({core}) NOT IN ({LIST(NOT_FACTS)}) AND NOT ends_with(coalesce({before}, ''), ':')))"""


def draw(*key: str, seed: int = CONFIG["seed"]) -> str:
    return f"('0x' || sha256(concat_ws(':', '{seed}', {', '.join(key)}))[1:8])::BIGINT"


def uniform(*key: str) -> str:
    return f"({draw(*key)} / 4294967296.0::DOUBLE)"


BANDS = "CASE " + " ".join(f"WHEN len(w) BETWEEN {a} AND {b} THEN '{a}-{b}'" for a, b in CONFIG["bands"]) + " END"
_LAST = "string_split(f[i - 1], ' ')[-1]"
_BARE = f"regexp_replace({_LAST}, '^[^\\p{{L}}\\p{{N}}_]+', '')"

#: paras (doc_id, lang, ps), and sent (doc_id, lang, id, text, w, band, fact_idx).
PARAS = """paras AS (SELECT doc_id::VARCHAR doc_id, lang, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'))), lambda p: p <> '') ps FROM documents)"""
SENT = f"""{PARAS},
para AS (SELECT doc_id, lang, unnest(ps) p, generate_subscripts(ps, 1) pi FROM paras),
seg AS (SELECT doc_id, lang, pi, list_filter(list_transform(string_split(regexp_replace(p, '([.!?][)\\]”’"'']*) +', '\\1' || chr(10), 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> '') f FROM para),
joined AS (SELECT doc_id, lang, pi, string_split(list_aggregate(list_transform(f, lambda s, i: CASE WHEN i = 1 THEN s WHEN regexp_matches(regexp_replace(s, '^[^\\p{{L}}\\p{{N}}_]+', ''), '^\\p{{Ll}}') OR (regexp_matches(s, '^[\\d½¼¾]') AND regexp_matches({_LAST}, '[\\d½¼¾][sdl]\\.[)”’"]*$')) OR {_BARE} IN ({LIST(TITLES)}) OR regexp_matches({_BARE}, '^[A-Z]\\.$') THEN ' ' || s ELSE chr(10) || s END), 'string_agg', ''), chr(10)) ss FROM seg),
piece AS (SELECT doc_id, lang, pi, unnest(list_transform(ss, lambda s: regexp_replace(s, '^(?:[–—]|-{{2,}})+\\s*', ''))) AS text, generate_subscripts(ss, 1) si FROM joined),
numbered AS (SELECT doc_id, lang, printf('%s-%03d', doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pi, si) - 1) id, text, {words('text')} w FROM piece WHERE text <> ''),
sent AS (SELECT doc_id, lang, id, text, w, {BANDS} band, list_filter(range(0, len(w)), lambda i: {fact('w[i + 1]', 'i', 'w[i]')}) fact_idx FROM numbered)"""
POOL = f"{SENT},\ninside AS (SELECT * FROM sent WHERE band IS NOT NULL),\npool AS (SELECT * FROM inside WHERE len(fact_idx) >= CASE WHEN (SELECT count(*) FROM inside WHERE len(fact_idx) >= {CONFIG['min_fact_tokens']}) >= {CONFIG['fallback_pool_threshold']} THEN {CONFIG['min_fact_tokens']} ELSE {CONFIG['min_fact_tokens_fallback']} END)"
BINS = "(VALUES " + ", ".join(f"({i}, {lo}, {hi}, '{n}')" for i, (lo, hi, n) in enumerate(LENGTH_BINS)) + ") b(rank, lo, hi, bin)"
LEVELS = "(VALUES ('0', 0), ('1w', 1), ('10', 10), ('25', 25), ('50', 50), ('75', 75)) l(severity, pct)"
SPANS = f"""{POOL},
sized AS (SELECT p.*, severity, fact_idx[{draw("'anchor'", 'id')} % len(fact_idx) + 1] anchor, CASE severity WHEN '0' THEN 0 WHEN '1w' THEN 1 ELSE (pct * len(w) + 50) // 100 END k FROM pool p, {LEVELS}),
span AS (SELECT *, CASE WHEN k > 0 THEN least(greatest(anchor - k // 2, 0), len(w) - k) END span_start FROM sized)"""
LEAD = "regexp_extract({0}, '^([^\\p{{L}}\\p{{N}}]*)(.*?)([^\\p{{L}}\\p{{N}}]*)$', {1})"


def edge(x: str, part: int) -> str:
    return LEAD.format(x, part)


LEXICON = f"{PARAS}, lex AS (SELECT word, count(*) n FROM (SELECT {edge('t', 2)} word FROM (SELECT unnest({words('p')}) t FROM (SELECT unnest(ps) p FROM paras))) WHERE word <> '' GROUP BY word)"


#: A small table of confusions, for damage without a calibration.
TABLE = D.confusion_table([("e", "c", 9), ("e", "o", 3), ("h", "b", 6), ("n", "u", 5), ("u", "n", 4), ("t", "l", 4), ("m", "rn", 3), ("i", "l", 3), ("a", "o", 2), ("r", "", 4)])


def _substitutes() -> str:
    rows = []
    for c in sorted({*TABLE, *(x for x in map(str.upper, TABLE) if len(x) == 1), *D.LOOK_ALIKE}):
        found, source = D.choices_of(TABLE, c)
        upto = 0
        for other, n in found:
            rows.append(f"('{c}', '{source}', '{other}', {upto}, {upto + n}, {sum(m for _, m in found)})")
            upto += n
    return "(VALUES " + ", ".join(rows) + ") s(c, source, dst, lo, hi, total)"


_KEY = ("id", "i::VARCHAR", "j::VARCHAR")
#: dmg (id, idx, token, is_anchor, dropped, n, m, dels, subs by source, out): the plan of each word of the widest span.
DAMAGE = f"""{SPANS},
tok AS (SELECT id, i, i = anchor is_anchor, w[i + 1] token, string_split(w[i + 1], '') cs FROM (SELECT id, anchor, w, unnest(range(span_start, span_start + k)) i FROM span WHERE severity = '75')),
able AS (SELECT *, list_filter(range(0, len(cs)), lambda j: regexp_matches(cs[j + 1], '^[\\p{{L}}\\p{{N}}]$')) js FROM tok),
rolled AS (SELECT *, len(js) n, {uniform("'drop'", 'id', 'i::VARCHAR')} d, 0.2::DOUBLE + {uniform("'intensity'", 'id', 'i::VARCHAR')} * (0.3::DOUBLE - 0.2::DOUBLE) p FROM able),
plan AS (SELECT *, n = 0 OR (NOT is_anchor AND d < 0.1::DOUBLE) dropped, least(n, greatest(1, floor(p * n + 0.5)))::INT m FROM rolled),
placed AS (SELECT *, row_number() OVER (PARTITION BY id, i ORDER BY {uniform("'position'", *_KEY)}, j) place FROM (SELECT id, i, n, m, cs, unnest(js) j FROM plan WHERE NOT dropped)),
wish AS (SELECT id, i, n, m, j, cs[j + 1] c, {uniform("'kind'", *_KEY)} < 0.25::DOUBLE del FROM placed WHERE place <= m),
cut AS (SELECT *, del AND coalesce(sum(del::INT) OVER (PARTITION BY id, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < least(2, n - 1, m) gone, {draw("'choice'", *_KEY)} pick, {draw("'random'", *_KEY)} roll,
 replace(CASE WHEN regexp_matches(c, '^\\p{{Ll}}') THEN '{D.LOWER}' WHEN regexp_matches(c, '^\\p{{Lu}}') THEN '{D.UPPER}' ELSE '{D.DIGITS}' END, c, '') pool FROM wish),
op AS (SELECT id, i, j, gone, CASE WHEN gone THEN NULL WHEN s.c IS NULL THEN 'fallback_random' ELSE s.source END AS source, CASE WHEN gone THEN '' WHEN s.c IS NULL THEN substr(pool, roll % length(pool) + 1, 1) ELSE s.dst END AS new
 FROM cut LEFT JOIN {_substitutes()} ON s.c = cut.c AND pick % s.total >= s.lo AND pick % s.total < s.hi),
made AS (SELECT id, i, string_agg(coalesce(op.new, c), '' ORDER BY j) AS out, count(*) FILTER (WHERE gone) dels, {', '.join(f"count(*) FILTER (WHERE source = '{x}') {x}" for x in ('table', 'table_casefold', 'fallback_map', 'fallback_random')).replace(') table,', ') from_table,')}
 FROM (SELECT id, i, unnest(cs) c, generate_subscripts(cs, 1) - 1 j FROM plan WHERE NOT dropped) LEFT JOIN op USING (id, i, j) GROUP BY id, i),
dmg AS (SELECT id, i idx, token, is_anchor, dropped, n, m, coalesce(made.out, '') AS out, dels, from_table, table_casefold, fallback_map, fallback_random FROM plan LEFT JOIN made USING (id, i)),
spot AS (SELECT e.*, d.idx, d.out, d.dropped FROM (SELECT id, severity, k, anchor, span_start, fact_idx, unnest(w) t, generate_subscripts(w, 1) - 1 pos FROM span) e LEFT JOIN dmg d ON d.id = e.id AND d.idx = e.pos AND e.pos >= span_start AND e.pos < span_start + k)"""
RECORDS = f"""WITH {DAMAGE} SELECT id, severity, any_value(k)::INT k, any_value(anchor)::INT anchor_idx, any_value(span_start)::INT span_start, any_value(span_start + k)::INT span_end,
coalesce(string_agg(CASE WHEN idx IS NULL THEN t ELSE out END, ' ' ORDER BY pos) FILTER (WHERE idx IS NULL OR out <> ''), '') corrupted_text, string_agg(CASE WHEN idx IS NULL THEN t ELSE '[[' || out || ']]' END, ' ' ORDER BY pos) marked FROM spot GROUP BY id, severity"""
DAMAGE_STATS = f"""WITH {DAMAGE}, x AS (SELECT *, CASE WHEN dropped THEN 0 ELSE m END AS ops, coalesce(dels, 0) del FROM dmg)
SELECT count(*) damaged_words, round(avg(dropped::INT), 6) share_dropped, round(sum(del) / sum(ops), 6) deletion_share, {', '.join(f"round(sum({c}) / sum(ops - del), 6) source_{x}" for x, c in (('table', 'from_table'), ('table_casefold', 'table_casefold'), ('fallback_map', 'fallback_map'), ('fallback_random', 'fallback_random')))},
{', '.join(f"round(avg(m / n) FILTER (WHERE NOT dropped AND n BETWEEN {lo} AND {hi}), 6) intensity_{b}" for b, lo, hi in (('1_3', 1, 3), ('4_6', 4, 6), ('7', 7, 10**6)))},
round(avg(dropped::INT) FILTER (WHERE is_anchor), 6) anchor_dropped, round(avg(dropped::INT) FILTER (WHERE NOT is_anchor), 6) other_dropped, count(*) FILTER (WHERE regexp_matches(token, '[\\p{{Nd}}²³¹⁰-⁹]')) digit_words, count(*) FILTER (WHERE n = 0) no_alnum FROM x"""
_SEEN = "CASE WHEN dropped THEN '{0}' ELSE {1} END"
VIEWS = f"""WITH {DAMAGE}, s AS (SELECT *, count(idx) OVER (PARTITION BY id, severity ORDER BY pos) nr FROM spot WHERE k > 0)
SELECT id, severity, string_agg(CASE WHEN idx IS NULL THEN t ELSE '⟨' || {_SEEN.format('?', 'out')} || '⟩' END, ' ' ORDER BY pos) AS plain, string_agg(CASE WHEN idx IS NULL THEN t ELSE '⟨' || nr || ': ' || {_SEEN.format('?', 'out')} || '⟩' END, ' ' ORDER BY pos) numbered,
string_agg(CASE WHEN idx IS NULL THEN t ELSE '{{ ' || {_SEEN.format('?', 'out')} || ' }}' END, ' ' ORDER BY pos) braces FROM s GROUP BY id, severity"""
