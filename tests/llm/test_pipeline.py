import random

import corpus_pipeline
from docveil.llm.pieces import Dropout, decode_pieces
from docveil.llm.queries import piece_model, queries
from tests.llm import brute


def corpus(rng):
    """Documents by what becomes of them."""
    vocabulary = ["".join(rng.choice(["an", "er", "on", "the", "ti", "re", "ha"]) for _ in range(rng.randint(1, 4))) for _ in range(900)]
    say = lambda n: (" ".join(rng.choice(vocabulary) for _ in range(n)) + ".").capitalize()
    text = lambda: "\n".join(say(rng.randint(15, 40)) for _ in range(rng.randint(2, 5)))
    passage = say(30)
    docs = {"clean": [text() for _ in range(120)], "junk": [text().upper().replace(" ", "!! ") for _ in range(60)], "leak": [text() + "\n" + passage + " " + say(9) for _ in range(4)], "private": [text() + f"\nWrite to x{i}@mail.example or +1 (212) 555-018{i}." for i in range(4)]}
    docs["copy"] = [t + "\nMore words." for t in docs["clean"][:5]] + docs["clean"][:5]
    rows = [(kind, t) for kind, ts in docs.items() for t in ts]
    return rows, passage


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(3)
    rows, passage = corpus(rng)
    kind = {i: k for i, (k, _) in enumerate(rows)}
    text = {i: t for i, (_, t) in enumerate(rows)}
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in text.items()] + [(900, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(k != "junk"), 0) for i, k in kind.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    out = corpus_pipeline.run(spark, str(tmp_path))
    back = {r.doc_id: r.decoded for r in decode_pieces(out, Dropout(piece_model())).collect()}
    good = [i for i in text if kind[i] != "junk"]
    comp = brute.components([(i, text[i]) for i in good])
    want = {i: text[i] for i in good if comp[i] == i and not brute.contamination([text[i]], [(1, passage)])[0][1]}
    for i in want:
        if kind[i] == "private":
            n = i - min(k for k in text if kind[k] == "private")
            want[i] = text[i].replace(f"x{n}@mail.example", "[EMAIL]").replace(f"+1 (212) 555-018{n}", "[PHONE]")
    assert back == want
    assert {kind[i] for i in want} == {"clean", "private"} and sum(k == "clean" for k in map(kind.get, want)) == 120


def test_stages_decide_by_row(spark, tmp_path):
    """Null ids, repeated rows and ids with several texts."""
    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
    as_docs = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    said = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    a, b, c, d = text(), text(), text(), text()

    rows = [(1, a), (5, a + " more"), (5, b), (7, c), (7, c), (7, c), (9, d), (8, d + " x"), (None, text())]
    want = [(1, a), (5, b), (7, c), (8, d + " x"), rows[-1]]
    assert said(corpus_pipeline.near_dedup(spark, as_docs(rows), str(tmp_path))) == sorted(want, key=str)

    one, two = text()[:150], text()[:150]
    spark.createDataFrame([(1, one), (None, two)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, a), (1, b + " " + one), (2, c + " " + two), (None, d + " " + one), (None, d)]
    got = said(corpus_pipeline.decontamination(spark, as_docs(rows), str(tmp_path)))
    assert got == sorted([(1, a), (None, d)], key=str)


def test_stages_take_empty_and_odd_tables(spark, tmp_path):
    """Empty tables, columns of clashing names, and rows of nulls go through every stage."""
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], kind)
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    names = ["row", "ids", "spans", "component_id", "quality_score", "node", "class"]
    odd = spark.createDataFrame([(None, None, None, None, None, *"abcdefg"), (1, "", None, None, 0, *"abcdefg"), (2, "Plain words here. " * 20_000, "en", "s", 9, *"abcdefg")], kind + "".join(f", {n} string" for n in names))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, str(tmp_path))
        want = corpus_pipeline.COLUMNS if name != "token_ids" else ["doc_id", "lang", "source", "n_pieces", "ids"]
        assert got.columns == want and {r.doc_id for r in got.collect()} == ({2} if name == "quality" else {None, 1, 2}), name


def test_every_operator_has_a_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries())
    assert numbers == list(range(1, 11))


def test_stage_columns():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "personal_data", "token_ids"]
