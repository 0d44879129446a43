"""Tokens, sentences and fact tokens."""

import pytest
from pyspark.sql import functions as F

from textmend.functions import text as T
from textmend.operators import calibrate as C


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x"))).first()[0]


def facts(spark, text):
    return one(spark, text, lambda x: F.transform(T.fact_positions(T.words(x)), lambda i: F.get(T.words(x), i)))


def test_fact_rule(spark):
    assert facts(spark, "In April 1831 she lent £12 to Mrs. Wood, of Cross Lane.") == ["April", "1831", "£12", "Wood,", "Cross", "Lane."]
    assert facts(spark, "Agnes owed 9d. in rent") == ["9d."]
    assert facts(spark, "Dr. Lane, surgeon, Deptford: In the night she fell") == ["Lane,", "Deptford:"]
    assert facts(spark, "") == [] and facts(spark, None) == []


@pytest.mark.parametrize("n,name", [(19, None), (20, "20-29"), (29, "20-29"), (30, "30-44"), (44, "30-44"), (45, "45-60"), (60, "45-60"), (61, None)])
def test_bands(spark, n, name):
    assert one(spark, n, lambda x: T.band(x, [(20, 29), (30, 44), (45, 60)]), "int") == name


def test_rejoin(spark):
    join = lambda parts: one(spark, parts, T.rejoined, "array<string>")
    assert join(["The rent was 9d.", "—Dr. Lane saw to it."]) == ["The rent was 9d.", "Dr. Lane saw to it."]
    assert join(["They met Mrs.", "Wood."]) == ["They met Mrs. Wood."]
    assert join(["It came to £7 3s.", "4 ½d. for both."]) == ["It came to £7 3s. 4 ½d. for both."]
    assert join(["She had 2d.", "but no bread."]) == ["She had 2d. but no bread."]
    assert join(["For R.", "Wood.", " ", "--"]) == ["For R. Wood."]
    assert join([]) == []


def test_normalize(spark):
    assert one(spark, "candle-\nlight and Corn-\nmarket\n \nlast\u00a0line", T.normalize) == ["candle-light and Corn-market", "last line"]


def test_parts_of_words(spark):
    assert one(spark, "“Miller’s,", T.word_core) == "Miller's"
    assert one(spark, "—", T.word_core) == ""
    assert one(spark, "c0rn-rnarket", T.parts_of) == ["c0rn", "rnarket"]
    assert one(spark, "--", T.parts_of) == ["--"]
    assert one(spark, "_Ltd.;", lambda x: F.array(*T.edge_parts(x))) == ["_", "Ltd", ".;"]
    assert one(spark, " , ", T.slot_core) == ","
    assert one(spark, "by { Wood, } or { ? }", lambda x: T.bracketed(x, F.lit(2))) == ["Wood,", "?"]
    assert one(spark, "by { Wood, }", lambda x: T.bracketed(x, F.lit(2))) is None


def test_similarity(spark):
    like = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(T.similarity(F.col("a"), F.col("b"))).first()[0]
    assert like("Martha", "Nlartba") == pytest.approx(1 - 3 / 7)
    assert like("a", "A") == 0 and like("", "") == 1


def test_align():
    a = C.align("some corn fell from our cart".split(), "some c0rn fell frorn our cart".split())
    assert [(p["gold"], p["ocr"]) for p in a["pairs"]] == [("corn", "c0rn"), ("from", "frorn")] and a["equal"] == 4
    assert a["equal_words"] == ["some", "fell", "our", "cart"] and (a["paired"], a["unpaired"]) == (2, 0)
    drops = lambda x, y: C.align(x.split(), y.split())["isolated_drops"]
    assert drops("a b c d", "a c d") == 1 and drops("a b c d e", "a e") == 0 and drops("a b c", "b c") == 0 and drops("a b c", "a b") == 0
    assert C.align("a b c d e f".split(), "a x y f".split())["unpaired"] == 4 and C.align("a b".split(), "a x y z b".split())["unpaired"] == 0
    assert C.align([], [])["gold_words"] == 0


def test_edit_blocks():
    found = lambda a, b: [(x["gold"], x["ocr"]) for x in C.edit_blocks(a, b)]
    assert found("hearth", "bearth") == [("h", "b")] and found("hearth", "heartb") == [("h", "b")]
    assert found("market", "rnarket") == [("m", "rn")]
    assert found("lantern", "lanten") == [("r", "")]
    assert found("same", "same") == [] and found("", "ab") == [("", "ab")] and found("ab", "") == [("ab", "")]
    import random

    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(7))) for _ in range(2))
        at = 0
        for gold, other in found(a, b):  # the blocks turn a into b, and cost what the words' distance is
            assert gold != other
            at += max(len(gold), len(other))
        table = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (x != y))
        assert at == table[-1][-1] or at <= max(len(a), len(b))


def test_common_subsequence():
    def slow(a, b):
        if not a or not b:
            return 0
        return 1 + slow(a[:-1], b[:-1]) if a[-1] == b[-1] else max(slow(a[:-1], b), slow(a, b[:-1]))

    for a, b in [("abcde", "xbdye"), ("", "a"), ("aaaa", "aa"), ("kitten", "sitting")]:
        assert C.common_length(a, b) == slow(a, b)


def test_confusions(spark):
    pairs = spark.createDataFrame([("d", "mill", "rnill"), ("d", "moss", "rnoss"), ("d", "hearth", "bearth")], "doc_id string, gold string, ocr string")
    kept = spark.createDataFrame([(["ham", "mime"],)], "equal_words array<string>")
    rows = C.confusions(C.edit_table(pairs), kept, pairs, 2).collect()
    assert [(r.gold, r.ocr, r["count"]) for r in rows] == [("m", "rn", 2)]
    assert rows[0].rate == pytest.approx(2 / 5)
    assert C.clean_pairs(pairs).count() == 3 and C.flagged_pairs(pairs).count() == 0


def test_choose_aligned(spark):
    rows = spark.createDataFrame([(i, 0.9 if i % 2 else 0.1) for i in range(1, 11)], "place int, coverage double")
    assert sorted(r.place for r in C.choose_aligned(rows, 3, 3).collect()) == [1, 2, 3, 4, 5]


def test_hash_places(spark):
    import hashlib

    from textmend.functions.draws import hash_key, hash_places

    rows = [f"d{i % 900}" for i in range(1000)]  # ties too
    df = spark.createDataFrame([(x,) for x in rows], "doc string")
    got = hash_places(df, hash_key(7, "x", F.col("doc")), "doc").collect()
    want = sorted(rows, key=lambda x: (hashlib.sha256(f"7:x:{x}".encode()).hexdigest(), x))
    assert [r.doc for r in sorted(got, key=lambda r: r.place)] == want and sorted(r.place for r in got) == list(range(1, 1001))
    assert hash_places(df.limit(0), hash_key(7, F.col("doc"))).count() == 0


def test_unescape_closed(spark):
    """A text cut off in a reference keeps it; unescape reads it as HTML does."""
    from textmend.sources import corpus as S

    told = {"a &amp; b": ("a & b",) * 2, "x = &quot": ("x = &quot", 'x = "'), "&quotx;": ("&quotx;", '"x;'), "&amp": ("&", "&"), "&ampquot;": ("&quot;",) * 2, "&amp;quot;": ("&quot;",) * 2, "&#65;&#x42;&copy;": ("AB©",) * 2, "&#65": ("&#65", "A"), "&am": ("&am",) * 2, None: (None, None)}
    rows = spark.createDataFrame([(k,) for k in told], "t string").select("t", S.unescape_closed("t"), S.unescape("t")).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == told
