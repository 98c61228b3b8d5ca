"""The corpus pipeline: five stages over documents, each on all that the one before it kept."""

from __future__ import annotations

import threading
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline.llm import mixing, packing, quality_rules, simhash, toxicity
from rosterline.llm.common import read, recording, staged_at
from rosterline.llm.queries import word_bpe
from rosterline.session import remove_path


_left: dict[int, list[str]] = {}  # by thread: folders that the stage before has staged


def _stage(function):
    """A stage that first removes what the stage before has staged, unless its documents still read it.

    So the shared folder holds one stage's intermediate tables at a time: a stage's documents are its
    predecessor's result, written and read again.
    """

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = threading.get_ident()
        former, reads = _left.pop(own, []), None
        if former:
            reads = " ".join(docs.inputFiles())
        kept = [path for path in former if path.rsplit("/", 1)[-1] in reads]
        for path in set(former).difference(kept):
            remove_path(spark, path)
        with recording() as paths:
            out = function(spark, docs, sf_dir)
        _left[own] = kept + paths
        return out

    return run_stage


def _rows(judged: DataFrame, docs: DataFrame) -> DataFrame:
    return judged.select(*[F.col("row").getField(name).alias(name) for name in docs.columns])


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity classifier does not reject, with all their columns.

    The classifier learns from ``labels`` and scores every text; null and empty texts are scored like others and
    rows that repeat an id each for itself. An empty table gives none.
    """
    scored = toxicity.toxicity_scores(docs, read(spark, sf_dir, "labels"), keep_row=True)
    return _rows(scored.filter("predicted = 0"), docs)


@_stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep, with all their columns.

    The limits are those of what is left here, by language and source, nulls being a group. A null or empty text has too
    few words and goes; copies are judged alike. An empty table gives none.
    """
    return _rows(quality_rules.quality_rules(docs, keep_row=True).filter("kept"), docs)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id, with all its columns.

    Of rows that repeat that id one stays; a null id stays only where no other is in the group. Texts without words are a
    group. An empty table gives none.
    """
    return _rows(simhash.near_duplicates(docs, keep_row=True).filter("first"), docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them; the one at a source's budget with its first words only.

    A null source is a source of its own; texts without words have no share in a budget. An empty table gives none.
    """
    return mixing.mixed_documents(docs)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences; see ``packing.pack``, also for nulls and empty tables."""
    return packing.pack(docs, word_bpe())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_quality),
    ("simhash near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

# Fingerprints, trained scores and token ids have no SQL form; tests/llm runs the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written to the shared folder, and removed when the next one is."""
    docs, former = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = staged_at(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if former:
            remove_path(spark, former)
        former = path
    for path in _left.pop(threading.get_ident(), []):
        remove_path(spark, path)
    return docs
