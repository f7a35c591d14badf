"""The corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes what its predecessor kept, reread from Parquet, and its decisions take effect. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestep.llm import decontam, fuzzy_lines, near_dup, packing, toxicity
from lodestep.llm._shared import Scratch
from lodestep.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. Null and empty texts are scored as texts without words; an empty table gives no rows."""
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.5)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of any length that repeat another line, equal or nearly, go, and documents of which nothing is left; blank lines stay.

    Null texts and texts that were empty before stay, as do rows without an id.
    """
    return fuzzy_lines.remove_lines(docs, drop_emptied=True)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id. Texts without words and rows without an id stay."""
    return near_dup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a verbatim benchmark window go. Null and empty texts hold none and stay; an empty benchmark leaves everything."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences of at most 2048 tokens. A null or empty text is the end id alone; an empty table gives no rows."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), spaces="leading", end_id=1, size=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The trained classifier, the union-find and the tokenizer are beyond SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; every stage's rows are written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for _, stage in STAGES[:-1]:
            docs = scratch.write(stage(spark, docs, sf_dir))
        return STAGES[-1][1](spark, docs, sf_dir).checkpoint()
