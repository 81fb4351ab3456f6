"""The training-data pipeline over documents: quality, near copies, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, with the columns of docs up to the last stage.

Edge cases: null and empty texts are one group of near copies, whose quality is scored like any other's, and have no pieces; rows without
doc_id, or that repeat one, are rows; columns of any name are carried along, those of the stages' own results too; an empty table gives an
empty result; without labels nothing is rejected, without benchmark nothing leaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm import decontaminate, nearcopies, pieces, quality, suffixes


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below the threshold go."""
    ranking, score = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), _unused(docs, "score")
    return quality.scored(docs, ranking, score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard of at least 0.8) stays; SimHash groups, and bands beside them, are checked."""
    return nearcopies.representatives(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by strings of 400 bytes that occur twice go from the texts; n_chars follows."""
    rest = [c for c in docs.columns if c != "text"]
    own = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)), "text")
    cut = suffixes.removed(own, length=400, carry=own.columns[:-1], as_text=True)
    put = {c: F.char_length("kept").cast("long") if c == "n_chars" else F.col(f"c{i}") for i, c in enumerate(rest)} | {"text": F.col("kept")}
    return cut.select(*(put[c].alias(c) for c in docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    overlaps = _unused(docs, "overlaps")
    found = decontaminate.overlapping(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), column=overlaps)
    return found.where(F.size(overlaps) == 0).drop(overlaps)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each remaining text as ids, n_pieces and round_trip; columns of these names are replaced."""
    return pieces.encoded(docs, carry=[c for c in docs.columns if c.lower() not in ("text", "ids", "n_pieces", "round_trip")])


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("sentencepiece", tokenize),
]
#: Fingerprints, rankings and pieces have no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
