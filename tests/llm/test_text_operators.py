import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docveil.llm.decontaminate import decontaminate, with_items
from docveil.llm.near_dedup import NearDedup, _crossing, _least, near_duplicates, signatures
from docveil.llm.pii import find_pii, masked, pii_spans
from docveil.llm.quality import Model, fit, forward_backward, held_out, line_features, lines_of, scored
from docveil.llm.shingles import shingle_set
from tests.llm import brute

DOCS = "doc_id long, text string, node string, comp long, bucket string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOCS)


def noisy(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, small):
    import docveil.llm.near_dedup as N

    if small:  # buckets of many blocks, and joins instead of broadcasts
        for name, value in (("BLOCK", 3), ("BROADCAST_ROWS", 0)):
            monkeypatch.setattr(N, name, value)
    rng = random.Random(5)
    rows, base = [], [f"w{rng.randrange(4000)}" for _ in range(60)]
    for i in range(60):
        rows.append((i, noisy(rng, base, rng.randint(0, 3))))
    other = [f"v{rng.randrange(4000)}" for _ in range(40)]
    rows += [(100 + i, noisy(rng, other, i % 3)) for i in range(20)]
    rows += [(200, "a b"), (201, "A  B"), (202, "a b c"), (203, "alone words here now then again"), (204, "x " * 5000), (205, "X " * 4000), (206, "é É ß " * 9)]
    rng.shuffle(rows)
    want = brute.components(rows)
    got = {r.doc_id: r for r in near_duplicates(docs(spark, rows)).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(brute.shingles(dict(rows)[i])) and r.kept == (want[i] == i) for i, r in got.items())


def test_near_duplicates_at_the_threshold(spark):
    """Pairs of a similarity from 0.70 to 0.80: all at 0.75 or more are linked, and no other."""
    rng, rows, want = random.Random(21), [], {}
    while len(want) < 400:
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(40, 150))]
        i, two = 2 * len(want), [" ".join(base), noisy(rng, base, rng.randint(1, 4))]
        s, t = map(brute.shingles, two)
        if 0.70 <= len(s & t) / len(s | t) <= 0.80:
            want[i + 1] = i if 100 * len(s & t) >= 75 * len(s | t) else i + 1
            rows += [(i, two[0]), (i + 1, two[1])]
    assert sum(i != c for i, c in want.items()) > 100 and sum(i == c for i, c in want.items()) > 50
    got = {r.doc_id: r.component_id for r in near_duplicates(docs(spark, rows)).collect()}
    assert {i: got[i] for i in want} == want


def test_near_duplicates_odd_rows(spark):
    rows = [(7, "one two three four five six seven eight nine ten eleven twelve"), (7, "one two three four five six seven eight nine ten eleven twelve"), (8, "one two three four five six seven eight nine ten eleven twelve x")]
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(docs(spark, rows)).collect()) == [(7, 7), (7, 7), (8, 7)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "same text of six words here"), (4, "same text of six words here"), (None, "same text of six words here"), (9, "same text of six words here")]
    got = sorted(near_duplicates(docs(spark, rows)).collect(), key=str)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by == {1: [(0, 1, True)], 2: [(0, 2, True)], 3: [(0, 3, True)], 4: [(2, 4, True)] * 2, 9: [(2, 4, False)], None: [(2, None, True)]}
    assert near_duplicates(docs(spark, [])).count() == 0


def test_near_duplicates_cross_despite_equal_low_bytes(spark):
    """Pairs whose signature bytes agree in a band that they do not share are formed in a later one."""
    p, rng, rows, n = NearDedup(), random.Random(11), [], 0
    (mul, add), bands_of = p.functions(p.hashes), p.folding()
    for k in range(20_000):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        two = [noisy(rng, base, 0), noisy(rng, base, 1)]
        u, v = (_least(shingle_set(np.frombuffer(t.encode(), np.uint8), p.words), mul, add) for t in two)
        shared = np.flatnonzero(bands_of(u) == bands_of(v))
        byte = ((u >> np.uint64(56)) == (v >> np.uint64(56))).reshape(p.bands, p.rows).all(axis=1)
        if len(shared) and byte[: shared[0]].any():
            rows += [(2 * k, two[0]), (2 * k + 1, two[1])]
            n += 1
            if n == 3:
                break
    assert n == 3
    sigs = signatures(docs(spark, rows), p).select(F.col("doc_id").alias("node"), "n", F.posexplode("bands").alias("band", "bucket"))
    text = spark.createDataFrame(rows, "node long, text string")
    rest = sigs.select("bucket", "band", "node", F.col("node").alias("comp"), F.col("n").cast("long"), F.lit(10**6).cast("long").alias("hi"))
    got = {(r.a, r.b) for r in _crossing(rest, text, p).collect()}
    assert got == {(a, a + 1) for a, _ in rows[::2]}


def test_near_duplicates_one_id_smallest_of_two_classes(spark):
    """Two texts under the smallest id: each has near-duplicates, which follow their own text."""
    rng = random.Random(8)
    rows, want = [], {}
    for k in range(0, 60, 3):
        for i in (1, 2):
            base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
            rows += [(k, " ".join(base)), (k + i, noisy(rng, base, 1))]
            want[k + i] = k
        want[k] = k
    rng.shuffle(rows)
    got = near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(r.component_id == want[r.doc_id] and r.kept == (r.doc_id % 3 == 0) for r in got)


def test_bayes_bounds_grow():
    steps = NearDedup().least_matches(128)
    assert [m for m, _ in steps] == [32, 64, 96, 128] and all(0 < n < m for m, n in steps)


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, row string")


def decontaminated(documents, benchmark):
    return with_items(decontaminate(documents, benchmark), {"items": F.col("items")})


def test_decontaminate_equals_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(25)] + ["é", "漢字"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    bench = [(i, say(rng.choice([1, 2, 4, 7, 9, 10, 15, 30]))) for i in range(25)] + [(90, None), (91, "!!"), (92, ""), (None, say(12))]
    bench.append((93, bench[0][1]))
    rows = []
    for i in range(60):
        parts = [say(rng.randint(0, 30))]
        if i % 2:
            parts.insert(rng.randint(0, 1), rng.choice(bench[:25])[1].upper().replace(" ", ", "))
        rows.append((i, " ".join(parts)))
    rows += [(100, None), (101, ""), (102, "..."), (103, bench[7][1] + " z " + bench[7][1])]
    # Item texts of one or two common words would hit all; they stay, as they are part of the rule.
    want = brute.contamination([t for _, t in rows], [(i, t) for i, t in bench if i is not None])
    got = {r.doc_id: r for r in decontaminated(docs(spark, rows), items(spark, bench)).collect()}
    for (i, _), (n, hits, found) in zip(rows, want, strict=True):
        assert (got[i].n_words, got[i].n_hit, got[i]["items"], got[i].hits) == (n, len(hits), found, hits), i


def test_decontaminate_joins_a_large_benchmark(spark, monkeypatch):
    import docveil.llm.decontaminate as D

    rows = [(1, "a b c d e f g h i j k"), (2, "nothing here"), (3, None)]
    bench = items(spark, [(5, "b c d e f g h i j k l"), (6, "nothing")])
    plain = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminated(docs(spark, rows), bench).collect()}
    monkeypatch.setattr(D, "IN_PLAN", 0)
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    assert {r.doc_id: (r.n_hit, r["items"]) for r in decontaminated(docs(spark, rows), bench).collect()} == plain == {1: (10, ["5"]), 2: (1, ["6"]), 3: (0, [])}


def test_decontaminate_shared_passage_and_long_texts(spark):
    """Many items and documents share a passage: its list of items is there once. One text is very long."""
    passage = " ".join(f"p{i}" for i in range(12))
    bench = [(i, passage + f" own{i}") for i in range(300)] + [(1000, "a " * 9 + "z")]
    rows = [(i, f"x{i} " + passage) for i in range(200)] + [(500, "a " * 200_000 + "z " + passage), (501, "clean")]
    found = decontaminate(docs(spark, rows), items(spark, bench))
    assert sorted(len(r["items"]) for r in found.item_sets.collect()) == [300, 301]
    got = {r.doc_id: r for r in with_items(found, {"n": F.size("items")}).collect()}
    assert all(got[i].n == 300 and got[i].n_hit == 12 for i in range(200)) and got[500].n == 301 and got[500].n_hit == 22
    assert got[501].n == 0 and got[501].item_set is None and len(got) == len(rows)


def test_decontaminate_without_items_or_documents(spark):
    rows = docs(spark, [(1, "a b"), (1, "a b")])
    assert [(r.n_words, r.n_hit, r["items"]) for r in decontaminated(rows, items(spark, [])).collect()] == [(2, 0, [])] * 2
    assert [r.n_hit for r in decontaminated(rows, items(spark, [(1, "b")])).collect()] == [1, 1]
    assert decontaminated(docs(spark, []), items(spark, [(1, "b")])).count() == 0


PII = [
    "mail a.b@c.example, ip 10.0.0.1 and 999.1.1.1, card 4111 1111 1111 1111, call +1 (212) 555-0182",
    "a@b@c.d.e_x@y.z 1.2.3.4.5.6.7.8 \U0001f600 é4111111111111111é x@y +12 3",
    None,
    "",
    "9" * 5000 + " " + "a" * 30000 + "@" + "b" * 9 + ".com " + "1 " * 9000,
    "000255.1.2.3 4111-1111-1111-1111 +49.30.1234567890 +1-(((((((2",
]


def test_pii_equals_brute_force(spark):
    rng = random.Random(11)
    pool = ["a", "@", ".", "1", "4111111111111111", "+", " ", "-", "(", ")", "x.y@z.com", "10.2.3.4", "é", "%", "_", "255", "\n"]
    texts = PII + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    got = find_pii(docs(spark, list(enumerate(texts)))).collect()
    for r in got:
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind not in ("iban", "ssn")] == brute.pii(texts[r.doc_id]), texts[r.doc_id]


def test_pii_of_many_matches_and_repeats(spark):
    """Texts of more matches than a fold's, in time and in place; repeated rows."""
    rng = random.Random(3)
    piece = lambda: rng.choice(["a.b@c.example ", "10.0.0.1, ", "é \U0001f600", "ssn 536-90-4788 ", "4111 1111 1111 1111;", "+1 (212) 555-0182 ", "536-90-4788 ", "x"])
    texts = ["".join(piece() for _ in range(n)) for n in (500, 1100, 30_000)]
    texts += [texts[0]]
    got = {}
    for r in find_pii(docs(spark, [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])])).collect():
        got.setdefault(r.doc_id, []).append([(s.kind, s.start, s.end) for s in r.spans])
    assert len(got[0]) == 2 and got[0] == got[3] * 2
    for i, t in enumerate(texts):
        base = [s for s in got[i][0] if s[0] not in ("iban", "ssn")]
        assert base == brute.pii(t) and len(base) > 128
        ssn = [m.start() for m in re.finditer(r"(?<![0-9-])536-90-4788(?![0-9-])", t) if "ssn" in t[max(0, m.start() - 40) : m.start()]]
        assert [s[1] for s in got[i][0] if s[0] == "ssn"] == ssn


def test_pii_adds_validated_spans_and_masks(spark):
    rows = docs(spark, [(1, "IBAN GB33BUKB20201555555555, SSN 536-90-4788, x@y.example"), (2, "GB33BUKB20201555555556 536-90-4788"), (3, None)])
    out = {r.doc_id: r for r in rows.withColumn("spans", pii_spans(F.col("text"))).withColumn("m", masked(F.col("text"), F.col("spans"))).collect()}
    assert out[1].m == "IBAN [IBAN], SSN [SSN], [EMAIL]" and out[2].m == out[2].text and out[3].m is None
    assert all(0.6 <= s.score <= 1 for s in out[1].spans)
    assert find_pii(docs(spark, [])).count() == 0


def test_quality_on_held_out_documents(spark):
    rng = random.Random(2)
    good = lambda: "\n".join(" ".join(rng.choice(["the", "of", "thand", "ereo", "ingly"]) for _ in range(12)).capitalize() + "." for _ in range(rng.randint(1, 6)))
    bad = lambda: good().upper().replace(" ", "!! ")
    kinds = [(i, int(i % 3 != 0)) for i in range(300)]
    rows = docs(spark, [(i, good() if q else bad()) for i, q in kinds] + [(900, None), (901, ""), (902, " \n"), (903, good() * 400), (None, good())])
    labels = spark.createDataFrame([(i, q, "z") for i, q in kinds] + [(None, 1, "z"), (5, None, "z")], "doc_id long, quality int, text string")
    r = scored(rows, fit(rows, labels)).withColumn("out", held_out(F.col("doc_id"))).collect()
    got = {x.doc_id: x for x in r}
    assert len(r) == 305 and all(0 <= x.quality_score <= 1 for x in r) and [got[i].quality_score for i in (900, 901, 902)] == [0, 0, 0]
    out = [(q, got[i].quality_score >= 0.7) for i, q in kinds if got[i].out]
    assert len(out) > 40 and sum(bool(q) == p for q, p in out) >= 0.97 * len(out)


def test_chain_equals_enumeration():
    """Marginals, pairs of labels and the partition sum, against all labellings of chains of up to 8 lines."""
    rng = np.random.default_rng(5)
    sizes = [1, 2, 3, 5, 8, 8, 1, 4]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    node, trans = rng.normal(size=(ends[-1], 2)), rng.normal(size=(2, 2))
    marginal, pair, z = forward_backward(node, trans, starts, ends)
    total, pairs = 0.0, np.zeros((2, 2))
    for a, b in zip(starts, ends, strict=True):
        weight, good = 0.0, np.zeros(b - a)
        own = np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(node[a + i, v] for i, v in enumerate(y)) + sum(trans[u, v] for u, v in itertools.pairwise(y)))
            weight += w
            good += w * np.array(y)
            for u, v in itertools.pairwise(y):
                own[u, v] += w
        assert np.allclose(marginal[a:b, 1], good / weight) and np.allclose(marginal[a:b].sum(axis=1), 1)
        total += np.log(weight)
        pairs += own / weight
    assert np.allclose(z, total) and np.allclose(pair, pairs)


def test_scores_weigh_lines_by_length():
    """A score is that of the mean marginal by line lengths, with features of both neighbours."""
    rng = np.random.default_rng(6)
    n = 18
    m = Model(rng.normal(size=n), rng.random(n) + 0.5, rng.normal(size=3 * n + 1), rng.normal(size=(2, 2)), 1.3, -0.2)
    lines = lines_of("One line here.\n\nTWO!! of them\nThe third is a little longer, 3 4 5.")
    f, size = line_features(lines)
    x = np.clip((f - m.mean) / m.scale, -6, 6)
    beside = lambda i: x[i] if 0 <= i < 3 else np.zeros(n)
    node = [m.weight @ np.concatenate([beside(i), beside(i - 1), beside(i + 1), [1.0]]) for i in range(3)]
    weights = {y: np.exp(sum(node[i] * v for i, v in enumerate(y)) + sum(m.trans[u, v] for u, v in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=3)}
    good = [sum(w for y, w in weights.items() if y[i]) / sum(weights.values()) for i in range(3)]
    share = float(np.dot(good, size) / size.sum())
    want = 1 / (1 + np.exp(-(1.3 * np.log(share / (1 - share)) - 0.2)))
    assert size.tolist() == [len(x) for x in lines] and np.isclose(m.score(f, size, np.array([0]), np.array([3]))[0], want)


def test_quality_fit_of_repeated_rows_and_bounds(spark):
    """Repeated rows fit as one; partitions, and lines beyond the bound, don't matter; an input column of the score's name goes."""
    kinds = [(i, int(i % 2)) for i in range(40)]
    text = lambda i, q: f"This is line {i} of a text.\nAnd one more." if q else f"BUY!!! {i}\n$$$ $$$ {i}"
    rows = docs(spark, [(i, text(i, q)) for i, q in kinds])
    labels = spark.createDataFrame(kinds, "doc_id long, quality int")
    a = fit(rows, labels)
    long = docs(spark, [(1000, "x y\n" * 3000)])
    b = fit(rows.unionByName(rows.where("doc_id < 9")).repartition(7).unionByName(long), labels.unionByName(spark.createDataFrame([(1000, 0)], labels.schema)), max_lines=100)
    assert (a.weight == b.weight).all() and (a.slope, a.offset) == (b.slope, b.offset)
    odd = rows.withColumn("quality_score", F.lit("x"))
    assert scored(odd, a).schema["quality_score"].dataType.simpleString() == "double" and scored(odd.limit(0), a).count() == 0
    twice = scored(rows.unionByName(rows), a).groupBy("doc_id").agg(F.countDistinct("quality_score").alias("n"), F.count("*").alias("m")).collect()
    assert all((r.n, r.m) == (1, 2) for r in twice)


@pytest.mark.parametrize("quality", [None, 1, 0])
def test_quality_without_two_kinds(spark, quality):
    rows = docs(spark, [(i, "Some text here.") for i in range(8)])
    labels = spark.createDataFrame([(i, quality) for i in range(8)] if quality is not None else [], "doc_id long, quality int")
    want = 0.0 if quality == 0 else 1.0
    assert all(abs(x.quality_score - want) < 1e-6 for x in scored(rows, fit(rows, labels)).collect())
