"""The queries ``opN_<name>`` and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docveil.llm.common import table


#: The rules of op1: host, path, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docveil.llm.url_filter import url_verdicts

    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return url_verdicts(table(spark, sf_dir, "pages"), rules)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docveil.llm.quality import ACCEPT, fit, held_out, scored

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    score = F.col("quality_score")
    r = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return r.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= ACCEPT).cast("int").alias("predicted"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docveil.llm.common import shared_dir
    from docveil.llm.warc import read_warc, write_warc

    archives = write_warc(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc")
    return read_warc(archives).drop("url")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docveil.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docveil.llm.pieces import Dropout, decode_pieces, encode_pieces

    p = Dropout(piece_model())
    r = decode_pieces(encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), p), p)
    return r.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docveil.llm.topk import top_k

    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = table(spark, sf_dir, "embeddings").where(x.isNotNull() & ~bad)
    rows = rows.select(F.col("vec_id").alias("id"), F.transform(x, lambda v: F.floor(v * 256)).alias("vector"))
    return top_k(rows, rows.where("id % 50 = 0"), 5)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docveil.llm.pii import KINDS, find_pii

    r = find_pii(table(spark, sf_dir, "documents"))
    base = [k.name for k in KINDS if k.base]
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return r.select(
        "doc_id",
        *(count(k) for k in base),
        F.sha2(said(F.filter("spans", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docveil.llm.decontaminate import decontaminate, with_items

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    r = with_items(found, {"n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ",").cast("binary"), 256)})
    return r.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docveil.llm.planes import planes_folder, read_planes, write_planes

    docs, path = table(spark, sf_dir, "documents"), word_bpe()

    def encode():
        from docveil.llm.encoder import encoder

        return encoder(path).encode_many

    return read_planes(write_planes(docs, encode, 2, planes_folder(docs), many=True))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docveil.llm.common import shared_dir
    from docveil.llm.token_files import count_tokens, write_token_files

    path, end = word_bpe(), 49407

    def encode():
        from docveil.llm.encoder import encoder

        return encoder(path, plain_specials=True).encode

    files, documents = write_token_files(table(spark, sf_dir, "documents"), encode, end, f"{shared_dir(spark)}/tokens")
    counts = count_tokens(files, end)
    return documents.join(counts, ["path", "ordinal"], "full").select("doc_id", "n_tokens", "ended")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from docveil.llm.oracles import SQL

    return dict(SQL)
