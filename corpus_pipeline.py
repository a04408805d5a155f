"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

1. toxicity: documents that the toxicity model rejects go.
2. near_duplicates: of the documents that similar shingle sets connect, the one with the smallest doc_id stays.
3. repeated_passages: words covered by passages that a smaller doc_id has too are removed from the texts.
4. decontamination: documents of which at least one word in twenty lies in a benchmark passage go.
5. segmentations: every document that is left is encoded in sampled segmentations.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs. All but the last return the columns of documents.
Nulls, empty texts, repeated rows and extra columns follow the operators' docstrings. Stage 1 fits on labels of the
documents that reach it. A stage's table is deleted when the next one's is written; the last one's stays for the result.
"""

from __future__ import annotations

import uuid

from ruleloom.llm import decontaminate, jaccard_join, segment_sampling, substring_dedup, toxicity
from ruleloom.llm.common import shared_dir, table


def toxic(spark, docs, sf_dir):
    return toxicity.remove_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark, docs, sf_dir):
    return jaccard_join.keep_one(docs)


def repeated_passages(spark, docs, sf_dir):
    return substring_dedup.remove_repeats(docs)


def decontamination(spark, docs, sf_dir):
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def segmentations(spark, docs, sf_dir):
    """doc_id, sample (from 1), ids, log_prob, gumbel, inclusion."""
    return segment_sampling.sample_segmentations(docs.select("doc_id", "text")).drop("text")


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("segmentations", segmentations),
]

#: SQL can't express the trained classifier of stage 1 or the draws of stage 5; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of sf_dir; the stages' tables go to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
        if number:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{number - 1}-{STAGES[number - 1][0]}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
