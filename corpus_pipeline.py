"""A training-data pipeline: five operators in a row, each on all that the one before kept.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``. Null texts and ids, empty tables, repeated rows and extra
columns are treated as each operator's docstring says; extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import bpe, decontaminate, line_dedup, quality_classifier, simhash
from vellum.llm.common import materialize, table

STAGES = [
    ("quality_classifier", quality_classifier.stage),
    ("line_dedup", line_dedup.stage),
    ("simhash_near_dedup", simhash.stage),
    ("decontamination", decontaminate.stage),
    ("byte_bpe", bpe.stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; what each kept is written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier's votes, SimHash's XXH64 and the byte-pair merges have no SQL form.
ORACLE_SQL = None
