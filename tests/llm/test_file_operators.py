import hashlib
import io
import random
import tracemalloc
import zlib
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docveil.llm.common import sized
from docveil.llm.encoder import Encoder
from docveil.llm.planes import PlaneReader, PlaneWriter, read_planes, write_planes
from docveil.llm.pieces import UNIT, Dropout, Pieces, decode_pieces, encode_pieces
from docveil.llm.queries import RULES, piece_model, word_bpe
from docveil.llm.token_files import count_tokens, write_token_files
from docveil.llm.topk import top_k
from docveil.llm.url_filter import url_verdicts
from docveil.llm.warc import read_records, read_warc, record, write_warc

ALPHABET = "ab Zé ́ß'sdt\x1c 9٣½\t\n.,!İΣς▁\u200d漢\x00\x85ÀŸ\U0001f600"
TEXTS = [None, "", " ", "Hello, World's <|endoftext|> end", "x" * 20000, "ab " * 9000, "\n\n▁▁ a"]


def texts(seed, n=60):
    rng = random.Random(seed)
    return TEXTS + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "p", 0) for i, t in rows], "doc_id long, text string, path string, ids int")


def library(specials=False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_bpe())
    t.encode_special_tokens = specials
    return t


@pytest.mark.parametrize("specials", [False, True])
def test_encoder_equals_library(specials):
    t, e = library(specials), Encoder(word_bpe(), specials, cache=50)
    for x in texts(1, 1500)[1:]:
        assert np.frombuffer(e.encode(x), "<u2").tolist() == t.encode(x, add_special_tokens=False).ids, x


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_many_texts_equal_library(kind):
    t, e = library(), Encoder(word_bpe(), cache=50)
    xs = pa.array([*texts(11, 800), "a<|ENDOFTEXT|> <|endoftext|>b", "W\u030a A\u0301 \v\f\r\x1d\xa0\u2003", "\u0178\u0130\u0131 '\u017f"], kind)
    for part in (xs, xs.slice(5, 300), xs.slice(0, 3), xs.slice(2, 1), xs.slice(9, 0)):
        want = [t.encode(x or "", add_special_tokens=False).ids for x in part.to_pylist()]
        assert [np.frombuffer(b, "<u2").tolist() for b in e.encode_many(part)] == want


def test_words_of_many_texts_are_looked_up_once(monkeypatch):
    asked, e = [], Encoder(word_bpe())
    monkeypatch.setattr(e, "word", lambda w, of=e.word: asked.append(w) or of(w))
    got = e.encode_many(pa.array(["one two\tTwo " * 1000] * 50))
    assert sorted(w for w in asked if w) == ["Two", "one", "two"] and len(asked) <= 4
    assert got == [e.encode("one two two " * 1000)] * 50


def test_batches_cut_by_size():
    sizes = [0, 3, 9, 25, None, 0, 4, 4, 4, 1]
    b = pa.RecordBatch.from_pydict({"i": range(10), "text": [None if n is None else "x" * n for n in sizes]})
    got = list(sized([b, b.slice(4, 0), b.slice(3, 1)], 1, 10))
    assert [r["i"] for x in got for r in x.to_pylist()] == [*range(10), 3]
    assert all(sum(sizes[i] or 0 for i in x.column(0).to_pylist()[1:]) < 10 for x in got) and len(got) == 7


@pytest.mark.parametrize("change", ["replace", "added", "none"])
def test_encoder_of_another_file(tmp_path, change):
    """A file of almost the same shape goes to the library as it is."""
    import json

    from tokenizers import Tokenizer

    with open(word_bpe(), encoding="utf-8") as f:
        spec = json.load(f)
    if change == "replace":
        spec["normalizer"]["normalizers"][1]["pattern"]["Regex"] = "[aeiou]"
    elif change == "added":
        spec["added_tokens"].append({"id": 49408, "content": "orld", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False})
    (tmp_path / "t.json").write_text(json.dumps(spec), encoding="utf-8")
    e, t = Encoder(str(tmp_path / "t.json")), Tokenizer.from_file(str(tmp_path / "t.json"))
    assert e.fast == (change == "none")
    for x in ["Hello, World's   end", *texts(8, 40)[1:]]:
        assert np.frombuffer(e.encode(x), "<u2").tolist() == t.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_plane_files(kind):
    rng, out = np.random.default_rng(1), io.BytesIO()
    w = PlaneWriter(out, kind)
    want = [(i - 3, rng.integers(0, 2 ** int(rng.integers(1, 20)), int(n)).astype("<u4")) for i, n in enumerate([0, 1, 70000, 5, 0, 200000, 3])]
    for doc, ids in want:
        w.add(doc, ids)
    w.close()
    r = PlaneReader(io.BytesIO(out.getvalue()))
    got = list(r.documents())
    assert [d for d, _ in got] == [d for d, _ in want] and all((a == b).all() for (_, a), (_, b) in zip(got, want, strict=True))
    flat = np.concatenate([x for _, x in want])
    assert (r.ids(69990, 140000) == flat[69990:140000]).all()
    broken = bytearray(out.getvalue())
    broken[20] ^= 1
    with pytest.raises(Exception):  # noqa: B017
        list(PlaneReader(io.BytesIO(bytes(broken))).documents())
    with pytest.raises(Exception):  # noqa: B017
        PlaneReader(io.BytesIO(out.getvalue()[:-5]))


def word_encoder(specials=False):
    path = word_bpe()

    def encode():
        from docveil.llm.encoder import encoder

        return encoder(path, specials).encode

    return encode


@pytest.mark.parametrize("parts", [1, 9])
def test_token_planes_equal_library(spark, tmp_path, parts):
    rows = list(enumerate(texts(3)))
    rows += [(7, f"again {i}") for i in range(40)] + [(7, "again 3"), (None, "none"), (None, "none"), (None, "other")]
    random.Random(parts).shuffle(rows)
    frame = docs(spark, rows).repartition(parts)
    hashed = {(r.doc_id, r.text): r.h for r in frame.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    t, at, want = library(), 0, []
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r])):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    got = read_planes(write_planes(frame, word_encoder(), 2, f"file://{tmp_path}/p")).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert read_planes(write_planes(docs(spark, []), word_encoder(), 2, f"file://{tmp_path}/e")).count() == 0


@pytest.mark.parametrize("size", [40, 16 << 20])
def test_token_planes_of_many_texts(spark, tmp_path, monkeypatch, size):
    from docveil.llm import planes

    def encode(path=word_bpe()):
        from docveil.llm.encoder import encoder

        return encoder(path).encode_many

    monkeypatch.setattr(planes, "TEXT_BYTES", size)
    frame = docs(spark, enumerate(texts(12))).repartition(2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    manifest = write_planes(frame, encode, 2, f"file://{tmp_path}/m", many=True)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(manifest.inputFiles()) == 1 < manifest.count()
    got = read_planes(manifest).collect()
    want = read_planes(write_planes(frame, word_encoder(), 2, f"file://{tmp_path}/o")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == len(texts(12))


def test_token_counts_equal_library(spark, tmp_path):
    rows = list(enumerate(texts(4)))
    files, documents = write_token_files(docs(spark, rows).repartition(3), word_encoder(True), 49407, f"file://{tmp_path}/t")
    got = documents.join(count_tokens(files, 49407, block=64), ["path", "ordinal"], "full").collect()
    t = library(True)
    assert {r.doc_id: (r.n_tokens, r.ended) for r in got} == {i: (len(t.encode(x or "", add_special_tokens=False).ids), True) for i, x in rows} and len(got) == len(rows)


def test_token_counts_of_odd_files(spark, tmp_path):
    put = lambda name, ids: (tmp_path / name).write_bytes(np.array(ids, "<u4").tobytes())
    put("a", [5, 9, 9, 1, 2, 3, 4, 5, 6, 7, 8, 9, 1])
    put("b", [])
    put("c", [1] * 30)
    put("d", [9])
    paths = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in "aabcd"], "path string")
    got = sorted((r.path[-1], r.ordinal, r.start, r.n_tokens, r.ended) for r in count_tokens(paths, 9, "<u4", block=4).collect())
    assert got == [("a", 0, 0, 1, True), ("a", 1, 2, 0, True), ("a", 2, 3, 8, True), ("a", 3, 12, 1, False), ("c", 0, 0, 30, False), ("d", 0, 0, 0, True)]
    (tmp_path / "x").write_bytes(b"123")
    with pytest.raises(Exception, match="no whole ids"):
        count_tokens(spark.createDataFrame([(f"file://{tmp_path}/x",)], "path string"), 9).collect()


def cut_ids(p, keys, xs):
    """The ids of each text."""
    ids, n = p.encode(keys, xs)
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def said(p, ids):
    return p.decode(pa.array(np.concatenate([np.array(x, np.int32) for x in ids])), np.cumsum([0, *map(len, ids)])).to_pylist()


def test_pieces_equal_library_without_dropout():
    import sentencepiece

    sp, p, xs = sentencepiece.SentencePieceProcessor(model_file=piece_model()), Pieces(piece_model(), 0.0, 1), texts(5, 800)[1:]
    got = cut_ids(p, [1] * len(xs), xs)
    assert said(p, got) == xs
    for x, ids in zip(xs, got, strict=True):
        assert "▁" in x or ids == sp.encode(x), x


def agenda(p, unit, key):
    """The pieces of a unit: the best candidate that is not skipped, the leftmost of equals, until none is left."""
    sym = [(i, i + 1) for i in range(len(unit))]
    score = {}
    while True:
        best = None
        for (a, m), (_, b) in zip(sym, sym[1:], strict=False):
            t = unit[a:b].replace("▁", "\0").replace(" ", "▁")
            if t not in score:
                i = p.piece_to_id(t)
                score[t] = p.get_score(i) if not p.is_unknown(i) else None
            if score[t] is not None and not key.skipped(a, m, b) and (best is None or score[t] > best[0]):
                best = (score[t], a, m, b)
        if best is None:
            return [unit[a:b] for a, b in sym]
        _, a, m, b = best
        sym = [(a, b) if s == (a, m) else s for s in sym if s != (m, b)]


class Draws:
    def __init__(self, p, key):
        self.p, self.key = p, key

    def skipped(self, a, m, b):
        return self.p.skipped(self.key, a, m, b)


@pytest.mark.parametrize("chance", [0.05, 0.3, 1.0])
def test_dropout_equals_a_plain_agenda(chance):
    import sentencepiece

    sp, p = sentencepiece.SentencePieceProcessor(model_file=piece_model()), Pieces(piece_model(), chance, 3, cache=40)
    words = "the international organisations of thereafter Zürich naïve 漢字 antidisestablishmentarianism " * 4
    xs = [x for x in texts(6, 60)[1:] if len(x) < 100] + [words, words + "x" * 60 + " " + "ab" * 40]
    for k, ids in enumerate(cut_ids(p, list(range(len(xs))), xs)):
        want = [t for place, u in enumerate(UNIT.findall(" " + xs[k]) if xs[k] else []) for t in agenda(sp, u, Draws(p, p.key(k, place)))]
        got = p.raw.take(pa.array(ids, pa.int32())).to_pylist()
        flat = lambda ts: [c for t in ts for c in ([t] if len(t.decode(errors="replace")) > 1 else [bytes([x]) for x in t])]
        assert flat(t.encode() for t in want) == flat(got), xs[k]


def test_dropout_seeds_and_parts(monkeypatch):
    import docveil.llm.pieces as P

    x = ["the international organisations of thereafter \n  " * 50, "", "again " * 300]
    p = Pieces(piece_model(), 0.3, 1)
    a = cut_ids(p, [1, 2, 3], x)
    assert a == cut_ids(Pieces(piece_model(), 0.3, 1), [1, 2, 3], x) and said(p, a) == x
    assert a[0] != cut_ids(Pieces(piece_model(), 0.3, 2), [1, 2, 3], x)[0] != cut_ids(p, [5, 2, 3], x)[0]
    monkeypatch.setattr(P, "SLICE", 7)
    monkeypatch.setattr(P, "ROOM", 5)
    assert cut_ids(p, [1, 2, 3], x) == a


def test_dropout_of_each_occurrence():
    """Every occurrence has draws of its own: one word is cut in many ways, in as many shares as an agenda's."""
    p, word, n = Pieces(piece_model(), 0.1, 1), "internationalisations", 3000
    within = cut_ids(p, [7], [" ".join([word] * n)])[0]
    over = cut_ids(p, list(range(n)), [word] * n)
    assert len({tuple(x) for x in over}) > 60 and len(within) > 1.05 * n * len(cut_ids(Pieces(piece_model(), 0.0, 1), [0], [word])[0])
    rng = random.Random(2)
    free = [p.one(" " + word, rng.getrandbits(64)) for _ in range(n)]
    plain = cut_ids(Pieces(piece_model(), 0.0, 1), [0], [word])[0]
    assert abs(sum(x == plain for x in over) - sum(x == plain for x in free)) < 0.05 * n


def test_models_too_large_for_ids(monkeypatch):
    import docveil.llm.pieces as P

    monkeypatch.setattr(P, "OTHER", 20_000)
    with pytest.raises(ValueError, match="too many"):
        Pieces(piece_model(), 0.1, 1)


def test_pieces_round_trip(spark):
    rows = [*enumerate(texts(7)), (None, "no id"), (None, "no id"), (3, "again")]
    p = Dropout(piece_model())
    got = decode_pieces(encode_pieces(docs(spark, rows), p), p).collect()
    assert len(got) == len(rows) and all(r.decoded == r.text for r in got) and {len(r.ids or []) for r in got if not r.text} == {0}
    assert decode_pieces(encode_pieces(docs(spark, []), p), p).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], "id long, vector array<double>, rank int")


@pytest.mark.parametrize("sparse", [False, True])
def test_top_k_equals_brute_force(spark, sparse):
    rng = np.random.default_rng(4)
    m = rng.integers(-30, 30, (300, 12)) * ((rng.random((300, 12)) < 0.2) if sparse else 1)
    m[10] = m[11] = m[12]
    m[20] = 0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    got = {}
    for r in top_k(vectors(spark, rows).repartition(3), vectors(spark, rows).where("id % 50 in (0, 10, 20)"), 5, shard_rows=70, block_queries=6).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in range(300):
        if q % 50 in (0, 10, 20):
            best = sorted(((int(m[q] @ m[i]), -i) for i in range(300) if i != q), reverse=True)[:5]
            assert sorted(got[q]) == [(k + 1, -i, s) for k, (s, i) in enumerate(best)]


def test_top_k_odd_rows(spark):
    rows = vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (None, [1.0, 1.0]), (4, [None, 1.0]), (5, [1.0]), (6, [-1.0, -1.0])])
    got = [tuple(r) for r in top_k(rows, rows.where("id in (1, 3)"), 5).orderBy("rank").collect()]
    assert got == [(1, 1, 2, 3), (1, 2, 2, 3), (1, 3, 6, -3)]
    copies = vectors(spark, [(1, [1.0])] + [(2, [3.0])] * 9 + [(3, [4.0]), (2, [5.0])])
    assert [tuple(r)[1:] for r in top_k(copies, copies.where("id = 1"), 5).orderBy("rank").collect()] == [(1, 2, 5), (2, 3, 4), (3, 2, 3), (4, 2, 3), (5, 2, 3)]
    big = vectors(spark, [(1, [2.0**40, 1.0]), (2, [2.0**20, 1.0]), (3, [2.0**20, 2.0]), (4, [1e300, 0.0])])
    assert [tuple(r)[1:] for r in top_k(big, big.where("id = 1"), 5).orderBy("rank").collect()] == [(1, 4, 2**63 - 1), (2, 3, 2**60 + 2), (3, 2, 2**60 + 1)]
    assert top_k(rows.limit(0), rows, 5).count() == 0 and top_k(rows, rows.limit(0), 5).count() == 0


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    kept = rest.split("?")[0].split("#")[0]
    host, slash, path = kept.partition("/")
    host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path
    fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


URLS = [None, "", "no scheme", "http://", "https://Example.COM/en/x", "https://www.example.com/en/?q", "http://a.b.net/es/", "http://net/fr/#x", "http://com", "http://com/", "http://xcom/", "http://a.com:80/", "x://y.com/a://b.net/es/", "http://É.com/É", "http://a..com//", "http://example.com/en", "http://a.net?/es/", "http://" + "a." * 3000 + "com/" + "p" * 9000]


@pytest.mark.parametrize("limit", [20_000_000, -1])
def test_url_verdicts(spark, monkeypatch, limit):
    import docveil.llm.url_filter as U

    monkeypatch.setattr(U, "BROADCAST_BYTES", limit)
    rows = list(enumerate(URLS)) + [(4, URLS[4]), (None, URLS[5])]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame([*RULES, RULES[0], (None, "/", "block"), ("net", None, "block")], "host string, path string, verdict string")
    got = url_verdicts(pages, rules).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((i, *judged(u)) for i, u in rows), key=str)
    assert {r.verdict for r in url_verdicts(pages, rules.limit(0)).collect()} == {"allow"} and url_verdicts(pages.limit(0), rules).count() == 0


def test_url_rules_keep_host_and_path_apart(spark):
    pages = spark.createDataFrame([(1, "http://ab"), (2, "http://a/b"), (3, "http://x.ab/" + "p" * 50_000)], "page_id long, url string")
    rules = spark.createDataFrame([("a", "b", "block"), ("ab", "", "allow"), ("b", "/", "block"), ("ab", "/" + "p" * 3000, "block")], "host string, path string, verdict string")
    assert {r.page_id: (r.rule, r.verdict) for r in url_verdicts(pages, rules).collect()} == {1: ("ab", "allow"), 2: (None, "allow"), 3: ("ab/" + "p" * 3000, "block")}


def test_url_ties_prefer_block(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    rules = spark.createDataFrame([("a.b", "/c", "allow"), ("a.b", "/c", "block"), ("b", "/", "allow")], "host string, path string, verdict string")
    assert [tuple(r) for r in url_verdicts(pages, rules).collect()] == [(1, "a.b", "/c", "a.b/c", "block")]


@pytest.mark.parametrize("limit", [100_000, 0])
def test_warc(spark, tmp_path, monkeypatch, limit):
    import docveil.llm.warc as W

    monkeypatch.setattr(W, "BROADCAST_DIGESTS", limit)
    big, odd = "é" * 600, "<p>\r\n\r\nWARC/1.1\x00" * 90
    rows = [(1, "u", big), (5, None, big), (3, "http://x\r\ny", big), (4, "u", None), (6, "u", ""), (7, "u", "a" * 999), (8, "u", "a" * 999), (-9, "u", odd), (10, "u", odd), (11, "u", "z" * 300_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    files = write_warc(pages, f"file://{tmp_path}/w")
    # A gzip member of its own for each record, with no other layer around.
    for f in (tmp_path / "w").iterdir():
        raw, n = f.read_bytes() if f.suffix == ".gz" else b"", 0
        while raw:
            z = zlib.decompressobj(31)
            assert z.decompress(raw).startswith(b"WARC/1.1\r\n") and z.eof
            raw, n = z.unused_data, n + 1
    got = {r.page_id: r for r in read_warc(files, payloads=True).collect()}
    first = {1: 5, 3: 5, -9: 10}
    assert len(got) == len(rows)
    for i, _, html in rows:
        p, r = (html or "").encode(), got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(p), hashlib.sha1(p).hexdigest(), "revisit" if i in first else "response", first.get(i))
        assert bytes(r.payload) == (b"" if i in first else p)
    assert read_warc(write_warc(pages.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_warc_of_odd_pages(spark, tmp_path):
    """Null ids, repeated ids, and a header beyond any buffer."""
    big, url = "b" * 5000, "http://x/" + "u" * 3_000_000
    rows = [(None, url, big), (None, "n", "small"), (7, "u", big), (7, "v", "c" * 2000), (7, "v", "c" * 2000), (2, None, "c" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = read_warc(write_warc(pages, f"file://{tmp_path}/o")).collect()
    want = [(None, url, 5000, "revisit", 7), (None, "n", 5, "response", None), (7, "u", 5000, "response", None), (7, "v", 2000, "response", None), (7, "v", 2000, "response", None), (2, "", 2000, "revisit", 7)]
    assert sorted(((r.page_id, r.url, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    alone = spark.createDataFrame([(None, "a", big), (None, "b", big)], "page_id long, url string, html string")
    assert [r.record_type for r in read_warc(write_warc(alone, f"file://{tmp_path}/q")).collect()] == ["response"] * 2


def test_warc_holds_few_wide_pages(monkeypatch, tmp_path):
    """A batch of wide pages is written a page at a time, and read in batches of bounded size."""
    import docveil.llm.warc as W

    class Taken(Exception):
        def mapInArrow(self, f, schema):
            raise Taken(f)

    monkeypatch.setattr(W, "plan_records", lambda *_: Taken())
    monkeypatch.setattr(W, "dealt", lambda _: Taken())
    with pytest.raises(Taken) as write:
        write_warc(None, f"file://{tmp_path}/w")
    with pytest.raises(Taken) as read:
        read_warc(MagicMock(), payloads=True)
    n, html = 24, "\U0001f600" + "x" * 2_000_000
    pages = pa.RecordBatch.from_pydict({"page_id": list(range(n)), "url": ["u"] * n, "html": [html] * n, "refers_to": pa.nulls(n, pa.int64())})
    tracemalloc.start()
    try:
        files = list(write.value.args[0](iter([pages])))
        assert tracemalloc.get_traced_memory()[1] < 20_000_000
    finally:
        tracemalloc.stop()
    got = list(read.value.args[0](iter([files[0].select(["path"])])))
    assert [x for b in got for x in b.column("page_id").to_pylist()] == list(range(n))
    assert all(b.nbytes < 12_000_000 and set(b.column("payload").to_pylist()) == {html.encode()} for b in got)


def test_files_are_read_by_a_task_each(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"<p>{i}") for i in range(60)], "page_id long, url string, html string").repartition(12)
    read = read_warc(write_warc(pages, f"file://{tmp_path}/t"))
    assert read.rdd.getNumPartitions() == 12 and len({r.p for r in read.withColumn("p", F.spark_partition_id()).collect()}) > 6


def test_warc_of_another_writer(spark, tmp_path):
    body = b"<html>" * 400
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    hexed = "sha1:" + hashlib.sha1(body).hexdigest()
    kind = ("Content-Type", "application/http; msgtype=response")
    records = [
        record("warcinfo", [], b"x: y\r\n"),
        record("request", [("WARC-Record-ID", "<urn:uuid:a>")], b"GET /"),
        record("response", [("WARC-Record-ID", "<urn:uuid:e11b7e32-9f51-4e52-b6c8-1a2f6a1d3c11>"), ("WARC-Target-URI", "http://a/"), kind, ("WARC-Payload-Digest", hexed)], http),
        record("response", [("WARC-Target-URI", "http://b/"), kind, ("WARC-Payload-Digest", "md5:0")], http),
        record("revisit", [("WARC-Target-URI", "http://c/"), ("WARC-Payload-Digest", hexed)], b""),
    ]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(records))
    paths = spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz",)] * 2, "path string")
    got = sorted((r.url, r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read_warc(paths).collect())
    digest = hashlib.sha1(body).hexdigest()
    assert got == [("http://a/", None, 2400, digest, "response", None), ("http://b/", None, 2400, digest, "response", None), ("http://c/", None, None, digest, "revisit", None)]
    (tmp_path / "y.warc.gz").write_bytes(record("response", [("WARC-Payload-Digest", hexed)], b"other"))
    with pytest.raises(Exception, match="differs from its header"):
        read_warc(spark.createDataFrame([(f"file://{tmp_path}/y.warc.gz",)], "path string")).collect()


def test_warc_reader_faults():
    good = record("response", [("WARC-Record-ID", "<urn:x>")], b"abc" * 50_000)
    assert [b for _, b in read_records(io.BytesIO(good * 3))] == [b"abc" * 50_000] * 3 and list(read_records(io.BytesIO(b""))) == []
    with pytest.raises(ValueError, match="ends within"):
        list(read_records(io.BytesIO(good + good[:-20])))
    pack = lambda raw: (lambda z: z.compress(raw) + z.flush())(zlib.compressobj(6, zlib.DEFLATED, 31))
    head = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\nWARC-Block-Digest: %s\r\n\r\nabc\r\n\r\n"
    for n, digest, why in ((2, b"x", "longer"), (9, b"x", "shorter"), (3, b"sha1:AA", "digest")):
        with pytest.raises(ValueError, match=why):
            list(read_records(io.BytesIO(pack(head % (n, digest)))))
    with pytest.raises(ValueError, match="header|not a WARC"):
        list(read_records(io.BytesIO(pack(b"junk" * 99))))
