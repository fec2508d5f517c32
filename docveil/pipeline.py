"""Files or text tables to rewritten text, key and files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from docveil.functions.masks import Policy
from docveil.operators import anonymize as A
from docveil.operators.detect import THRESHOLD, entities as rows_of, with_entities, with_offsets
from docveil.operators.external import Recognizer, recognized, with_listed
from docveil.operators.registry import select
from docveil.sources import office


@dataclass(frozen=True)
class Processed:
    """Lazy frames that share doc_id; all but ``lines`` come from ``tokens``, so that after
    ``keep()`` a line's entities are detected once, whatever of them is asked for."""

    lines: DataFrame
    tokens: DataFrame
    entities: DataFrame
    key: DataFrame
    rewritten: DataFrame

    def keep(self) -> Processed:
        """Keeps the lines with their tokens, in memory or else on disk, until ``drop()``."""
        self.tokens.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def drop(self) -> None:
        self.tokens.unpersist()


def process_lines(
    lines: DataFrame, policy: Policy | None = None, threshold: float = THRESHOLD, entities: list[str] | None = None, overrides: dict[str, str] | None = None,
    load: Callable[[], Recognizer] | None = None, listed: DataFrame | None = None,
) -> Processed:
    """Detects, resolves, tokenises and rewrites lines (doc_id, line_no, text, source).

    ``entities`` names the types to look for, ``overrides`` other prefixes. ``load`` makes a
    recogniser of names, or ``listed`` has rows of ``detect.dictionary``; their spans join the
    choice.
    """
    placed = with_offsets(lines)
    if load:
        placed = recognized(placed, load, threshold)
    elif listed is not None:
        placed = with_listed(placed, listed)
    tokens = A.with_tokens(with_entities(placed, select(entities), threshold), policy, overrides)
    return Processed(lines, tokens, rows_of(tokens), A.key_of(tokens), A.anonymized_lines(tokens))


def process_files(
    spark: SparkSession, *paths: str, policy: Policy | None = None, threshold: float = THRESHOLD, entities: list[str] | None = None, overrides: dict[str, str] | None = None,
    load: Callable[[], Recognizer] | None = None,
) -> tuple[Processed, DataFrame]:
    """A result and the rewritten files (path, content, n_found, unlocated, error).

    ``n_found`` counts the places where a file was changed, and ``unlocated`` has the values that
    were found nowhere in a PDF file and so may still be readable. A file that can't be read or
    rewritten has no content, and the reason in ``error``; the others are done.
    """
    read = office.read_files(spark, *paths, errors=True)
    done = process_lines(read.where("error is null").drop("error"), policy, threshold, entities, overrides, load)
    bad = read.where("error is not null").select("doc_id", "error")
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    return done, office.rewritten_files(files, done.rewritten.select("doc_id", "source", "text"), A.redaction_pairs(done.key), bad)
