"""The registered queries on the smallest tables: against their DuckDB SQL, or against brute force."""

import os
import zlib

import duckdb
import numpy as np
import pytest

from docveil.llm.pieces import UNIT, Dropout, Pieces
from docveil.llm.queries import oracle_sql, piece_model, queries, word_bpe

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("select doc_id, coalesce(text, '') from documents").fetchall())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    q = duck.execute(oracle_sql()[name])
    at = [[d[0] for d in q.description].index(c) for c in cols]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in q.fetchall())


def library(specials):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_bpe())
    t.encode_special_tokens = specials
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_token_planes(spark, texts):
    ids_of, at, want = library(False), 0, {}
    for i, x in sorted(texts.items()):
        ids = np.array([*ids_of(x), 2], "<u4")
        want[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries()["op9_token_planes"](spark, SF).collect()}
    assert got == want


def test_token_counts(spark, texts):
    ids_of = library(True)
    got = {r.doc_id: (r.n_tokens, r.ended) for r in queries()["op10_token_counts"](spark, SF).collect()}
    assert got == {i: (len(ids_of(x)), True) for i, x in texts.items()}


def test_pieces(spark, texts):
    p = Dropout(piece_model())
    one = Pieces(p.path, p.chance, p.seed)
    got = {r.doc_id: r for r in queries()["op5_pieces"](spark, SF).collect()}
    assert set(got) == set(texts) and all(r.lossless for r in got.values())
    for i, x in texts.items():
        assert got[i].n_pieces == sum(len(one.one(u, one.key(i, k))) for k, u in enumerate(UNIT.findall(" " + x) if x else []))


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    label = dict(duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet' where quality is not null").fetchall())
    rows = queries()["op2_quality"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    out = [(label[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in label]
    assert len(out) > 50 and sum(a == b for a, b in out) >= 0.95 * len(out)
