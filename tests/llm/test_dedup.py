"""op1, op3 and op4 against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from textmend.llm import repeats as R
from textmend.llm.ngram_jaccard import ngram_jaccard_join
from textmend.llm.substring_dedup import equal_windows as tree_windows
from textmend.llm.substring_dedup import substring_dedup, suffix_trees
from textmend.llm.suffix_dedup import Prefixes, equal_windows, suffix_dedup, suffix_sort

WORD = r"[^\x20\x09-\x0D]+"
JOINED = "sha2(trim(regexp_replace(kept, '[\\\\x20\\\\x09-\\\\x0D]+', ' ')), 256)"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed=1, n=70):
    """Texts with shared passages, near and exact copies, empties, nulls, repeated rows and a long text."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdéüß") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passages = [text(45) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [text(rng.randrange(0, 60))]
        if rng.random() < 0.5:
            parts.insert(rng.randrange(2), rng.choice(passages))
        if rng.random() < 0.2:
            parts += [rng.choice(passages)] * 2
        rows.append([i * 7 % n + 100, rng.choice([" ", "\n", "\t "]).join(parts)])
    for i in range(8):
        rows.append([300 + i, rows[i][1]])
        w = rows[i + 8][1].split(" ")
        if len(w) > 10:
            w[rng.randrange(len(w))] = "CHANGED"
        rows.append([400 + i, " ".join(w)])
    hot = [[500 + i, f"{passages[0]} {text(12)}"] for i in range(60)]
    return rows + hot + [[900, None], [901, ""], [902, " \n "], [903, "a"], [904, "one two three"], [905, "ONE two\tthree"], [906, "aaaa " * 3000], list(rows[3])]


@pytest.fixture(scope="module")
def rows():
    return corpus()


def frame(spark, rows):
    df = spark.createDataFrame([(a, b) for a, b in rows], "doc_id long, text string")
    # columns whose names clash with those used inside
    return df.withColumn("chunk", F.lit("x")).withColumn("bucket", F.lit(None).cast("int")).withColumn("kept", F.lit(1)).withColumn("text_hash", F.lit("h")).repartition(5)


def brute_bytes(rows, size=50):
    low = {}
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - size + 1):
            low[b[j : j + size]] = min(i, low.get(b[j : j + size], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - size + 1):
            if low[b[j : j + size]] < i:
                gone[j : j + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def brute_words(rows, size=35):
    words = [re.findall(WORD, t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[j : j + size]) for w in words for j in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for j in range(len(w) - size + 1):
            if seen[tuple(w[j : j + size])] > 1:
                gone[j : j + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def brute_jaccard(rows):
    sets = []
    for _, t in rows:
        w = re.findall(WORD, (t or "").translate(LOW))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * len(a | sets[j]):
                group[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 3000, "bucket_bytes": 5000}])
def test_suffix_dedup(spark, rows, sizes):
    rows = [r for i, r in enumerate(rows) if r not in rows[:i]]  # ids are documents here
    got = suffix_dedup(frame(spark, rows), **sizes).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == brute_bytes(rows)


def test_spans_give_what_stays(spark, rows):
    rows = [[i, t] for i, (_, t) in enumerate(rows)]
    texts = {i: (t or "").encode() for i, t in rows}
    for r in suffix_dedup(frame(spark, rows)).collect():
        cut = bytearray(texts[r.doc_id])
        for a, n in reversed(list(zip(r.span_starts, r.span_lengths))):
            del cut[a : a + n]
        assert bytes(cut) == bytes(r.kept)


def test_what_stays_keeps_its_lines(spark):
    passage = "\n".join(f"p{i}" for i in range(35))
    rows = [[1, f"one two\nthree\n{passage}\nfour\tfive  six\n"], [2, f"{passage} \n end\n\n"], [3, f" x {passage}"], [4, "a\nb"]]
    got = {r.doc_id: r.kept for r in substring_dedup(frame(spark, rows)).collect()}
    assert got == {1: "one two\nthree\nfour\tfive  six\n", 2: "end\n\n", 3: " x ", 4: "a\nb"}


def test_word_spans_end_with_their_text(spark):
    """Copies side by side: each one's passage is a span of its own."""
    text = " ".join(f"w{i}" for i in range(40))
    for r in substring_dedup(frame(spark, [[i, text] for i in range(3)])).collect():
        assert (list(r.span_starts), list(r.span_lengths), r.kept) == ([0], [40], "")


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 3000, "bucket_bytes": 5000}])
def test_substring_dedup(spark, rows, sizes):
    got = substring_dedup(frame(spark, rows), **sizes).select("doc_id", "n_words", "n_removed", F.expr(JOINED)).collect()
    assert sorted(map(tuple, got)) == brute_words(rows)


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 3000, "bucket_bytes": 5000, "block": 4}])
def test_jaccard(spark, rows, sizes):
    got = ngram_jaccard_join(frame(spark, rows), **sizes).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute_jaccard(rows)


def test_near_copies_of_one_text(spark):
    """A chain of copies, each with one more change, is one component though its ends aren't similar."""
    rng = random.Random(5)
    w = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(40):
        rows.append([i, " ".join(w)])
        w[(i * 3) % 120] = f"x{i}"
    got = ngram_jaccard_join(frame(spark, rows), chunk_bytes=4000, bucket_bytes=9000, block=8).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_jaccard(rows)
    assert {r.component_id for r in got} == {0}


@pytest.mark.parametrize("sizes", [{}, {"bucket_bytes": 300_000}])
def test_near_copies_of_long_texts(spark, sizes):
    """Two long texts share more rare shingles in a bucket than a byte can count."""
    rng = random.Random(6)
    rows = []
    for i, k in enumerate([6000, 20000, 20000]):
        w = [f"w{rng.randrange(10**6)}" for _ in range(k)]
        rows.append([2 * i, " ".join(w)])
        for j in range(0, k, 100 if i < 2 else 15):  # the last pair isn't similar
            w[j] = f"x{j}"
        rows.append([2 * i + 1, " ".join(w)])
    got = ngram_jaccard_join(frame(spark, rows), **sizes).select("doc_id", "n_shingles", "component_id").collect()
    want = brute_jaccard(rows)
    assert sorted(map(tuple, got)) == want and [c for _, _, c in want] == [0, 0, 2, 2, 4, 5]


def bytes_sent(rows, chunks=4, buckets=3, num=80, den=100):
    """The rounds of the join in this process: bytes sent in each, and the links."""
    from textmend.llm import ngram_jaccard as J

    tables = [pa.table({"text": pa.array([t for _, t in rows[c::chunks]], pa.string()), "chunk": pa.array([c] * len(rows[c::chunks]), pa.int32())}) for c in range(chunks)]
    rarity = sum(np.bincount((J.shingle_sets(t["text"], 5)[1] & np.uint64(J.SLOTS - 1)).astype(np.int64), minlength=J.SLOTS) for t in tables)
    make = lambda t: J.Sets(t, 5, rarity, num, den)

    def deal(found, by):
        whole = pa.concat_tables(found)
        return {k: whole.filter(pa.compute.equal(whole[by], k)) for k in sorted(set(whole[by].to_pylist()))}

    size = lambda found: sum(len(x) for t in found for x in t["payload"].to_pylist())
    tokens = [J.send_tokens(make, buckets, t) for t in tables]
    told = deal([J.answer_tokens(t) for t in deal(tokens, "bucket").values()], "chunk")
    prefixes = [J.send_prefixes(make, num, den, buckets, t, told.get(c, R.blobs([]))) for c, t in enumerate(tables)]
    visits = deal([J.find_visits(num, den, 4096, t) for t in deal(prefixes, "bucket").values()] or [R.blobs([])], "chunk")
    sets = [J.send_sets(make, num, den, buckets, t, visits.get(c, R.blobs([]))) for c, t in enumerate(tables)]
    links = sum(len(J.find_links(num, den, t)) for t in deal(sets, "bucket").values())
    return [size(tokens), size(prefixes), size(list(visits.values())), size(sets)], links


@pytest.mark.parametrize("own", [20, 34, 46])
@pytest.mark.parametrize("copies", [1, 2])
def test_boilerplate_stays_linear(own, copies):
    """Documents that share most of their words, but aren't similar: what is sent grows with their number, not its square."""
    rng = random.Random(own)
    common = [f"c{i}" for i in range(150)]
    for count in (500, 2000):
        texts = [" ".join(common + [f"o{rng.randrange(10**9)}" for _ in range(own)]) for _ in range(count // copies)]
        rows = list(enumerate(texts * copies))
        sent, links = bytes_sent(rows)
        assert links == 0 and sum(sent) < 4 * sum(len(t) for _, t in rows), (count, sent)


def test_hot_anchors_take_the_other_way(spark):
    """More contexts of one anchor than are compared together: windows are dealt out one by one."""
    rng = random.Random(8)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(40))
    rows = [[i, f"{''.join(rng.choice('abcdefgh ') for _ in range(60))} {passage} {''.join(rng.choice('abcdefgh ') for _ in range(60))}"] for i in range(400)]
    got = suffix_dedup(frame(spark, rows), chunk_bytes=20000).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == brute_bytes(rows)
    got = substring_dedup(frame(spark, rows), chunk_bytes=20000).select("doc_id", "n_words", "n_removed", F.expr(JOINED)).collect()
    assert sorted(map(tuple, got)) == brute_words(rows)


@pytest.mark.parametrize("f", [suffix_dedup, substring_dedup, ngram_jaccard_join])
def test_empty_tables(spark, f):
    assert f(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    nulls = f(spark.createDataFrame([(None, None), (None, "x y"), (None, None)], "doc_id long, text string")).collect()
    assert len(nulls) == 3 and all(r.doc_id is None for r in nulls)


def test_suffix_sort():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 99, 600).astype(np.uint8)
    first = rng.permutation(500)
    segment = np.sort(rng.integers(0, 9, 500))
    order, owner = suffix_sort(Prefixes(text), first, segment, np.full(500, 12))
    raw = text.tobytes()
    string = [raw[x : x + 12] for x in first]
    while (owner[owner] != owner).any():
        owner = owner[owner]
    for s in range(9):
        mine = [string[i] for i in order if segment[i] == s]
        assert mine == sorted({x for x, g in zip(string, segment) if g == s}) and len(mine) > 1
    assert all(string[i] == string[o] and segment[i] == segment[o] for i, o in enumerate(owner))
    number = equal_windows(text, first, segment, np.full(500, 6))
    named = collections.defaultdict(set)
    for i in range(500):
        named[number[i]].add((int(segment[i]), raw[first[i] : first[i] + 6]))
    assert all(len(v) == 1 for v in named.values()) and len(named) == len({x for v in named.values() for x in v})


def test_depths_may_differ_between_segments():
    rng = np.random.default_rng(4)
    text = rng.integers(97, 99, 400).astype(np.uint8)
    first, segment = rng.integers(0, 350, 300), np.sort(rng.integers(0, 20, 300))
    depth = rng.integers(1, 40, 20)[segment]
    raw = text.tobytes()
    truth = np.unique([f"{s} {raw[a : a + d]}" for a, s, d in zip(first, segment, depth)], return_inverse=True)[1]
    for f in (equal_windows, tree_windows, lambda *x: tree_windows(*x, most=8)):
        number = f(text, first, segment, depth)
        assert len(set(zip(number.tolist(), truth.tolist()))) == len(set(truth.tolist())) == len(set(number.tolist()))


def test_collisions_are_found():
    """With hashes that all agree the bytes decide."""
    text = np.frombuffer(b"abcabcabdabc", np.uint8)
    first, segment = np.array([0, 3, 6, 9]), np.zeros(4, np.int64)
    import textmend.llm.suffix_dedup as S

    class Same(S.Prefixes):
        def common(self, a, b, depth):
            return depth

    real, S.Prefixes = S.Prefixes, Same
    try:
        n = S.equal_windows(text, first, segment, np.full(4, 3))
    finally:
        S.Prefixes = real
    assert n[0] == n[1] == n[3] != n[2]


def rounds(rows, spec, classes, chunks=3):
    """All rounds of the repeat finder in this process: for each chunk, its texts and the stretches found."""
    tables = [pa.table({"doc_id": pa.array([i for i, _ in part], pa.int64()), "text": pa.array([t for _, t in part], pa.string()), "chunk": pa.array([c] * len(part), pa.int32())}) for c in range(chunks) for part in [rows[c::chunks]]]

    def deal(found, by):
        whole = pa.concat_tables(found)
        return {k: whole.filter(pa.compute.equal(whole[by], k)) for k in sorted(set(whole[by].to_pylist()))}

    told = [R.answer_anchors(spec, t) for t in deal([R.send_anchors(spec, t) for t in tables], "bucket").values()]
    sent = [R.send_contexts(spec, classes, t, deal(told, "chunk").get(c, R.blobs([]))) for c, t in enumerate(tables)]
    more = [R.answer_contexts(spec, classes, t) for t in deal(sent, "bucket").values()]
    out = []
    for c, t in enumerate(tables):
        chunk = R.Chunk(t, spec)
        first, end = R.covered(chunk, deal([*told, *more], "chunk").get(c, R.blobs([])), classes)
        for i, (lo, hi) in enumerate(zip(chunk.lo.tolist(), chunk.hi.tolist())):
            mine = (first >= lo) & (first < hi)
            out.append((chunk.table["doc_id"][i].as_py(), hi - lo, int((end - first)[mine].sum())))
    return sorted(out, key=str)


@pytest.mark.parametrize("words", [False, True])
def test_the_method_decides_every_window(rows, words, monkeypatch):
    """Hashes only rule out: if all of them agree the result is the same, and without the method nothing is found."""
    rows = [r for i, r in enumerate(rows) if r[0] != 906 and r not in rows[:i]]
    spec = R.Spec(12, 24, True, False, 3) if words else R.Spec(27, 24, False, True, 3)
    method = tree_windows if words else equal_windows
    want = sorted([x[:3] for x in (brute_words if words else brute_bytes)(rows)], key=str)
    compared = []

    def counted(symbols, first, segment, depth):
        compared.append(len(first))
        return method(symbols, first, segment, depth)

    assert rounds(rows, spec, counted) == want and sum(compared) > 0
    assert {x[2] for x in rounds(rows, spec, lambda symbols, first, segment, depth: np.arange(len(first)))} == {0}
    real = R.find_runs
    monkeypatch.setattr(R, "find_runs", lambda *a: real(*a) | {"ctx": np.zeros(len(real(*a)["js"]), np.uint64)})
    monkeypatch.setattr(R.Chunk, "window_hashes", lambda self, at: np.zeros(len(at), np.uint64))
    assert rounds(rows, spec, method) == want
    monkeypatch.setattr(R.Hashes, "of", lambda self, first, size: np.zeros(len(first), np.uint64))
    assert rounds(rows, spec, method) == want
    few = R.Spec(spec.k, spec.w, spec.words, spec.first, 2, 0, 0)  # all windows are dealt out, to one place
    assert rounds(rows, few, method) == want
    monkeypatch.setattr(R, "find_runs", lambda *a: real(*a) | {"ctx": np.zeros(len(real(*a)["js"]), np.uint64), "key": real(*a)["key"] & np.uint64(7 << 45)})
    assert rounds(rows, spec, method) == want


def test_null_and_repeated_ids(spark):
    """Rows without an id, or with one id, are dealt out by their texts too."""
    rng = random.Random(9)
    same = " ".join(f"s{rng.randrange(10**6)}" for _ in range(50))
    for ident in (None, 7):
        rows = [[ident, f"{same} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(20))] for _ in range(40)]
        got = suffix_dedup(frame(spark, rows), chunk_bytes=2000).collect()
        assert len(got) == 40 and all(r.n_removed == 0 for r in got)  # one document's copies, or none smaller
        got = substring_dedup(frame(spark, rows), chunk_bytes=2000).collect()
        assert all((r.n_words, r.n_removed) == (70, 50) for r in got)


def test_suffix_trees():
    symbols = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3, 9])
    tree = suffix_trees(symbols, np.array([0, 3, 6, 2]), np.zeros(4, np.int64), np.full(4, 3))
    assert sorted(tree["deep"].tolist()) == [0, 2] and tree["node"][0] == tree["node"][2] != tree["node"][1]
    assert tree["depth"][tree["node"][0]] == 3 and tree["parent"][tree["node"][0]] >= 0
