"""From raw documents to packed training sequences: five stages, each on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.llm import decontam, jaccard, packing, pii, toxicity
from partloom.llm.store import discard, fresh, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counterfactually regularised classifier doesn't call toxic.

    All columns stay as they are, whatever their names.  Null and empty texts have
    the score of no feature and stay; long texts are scored whole; repeated rows
    stay or go together; a score equal to the threshold goes; no rows give none.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    names = fresh(docs.columns, "score", "predicted")
    return toxicity.scored(docs, model, names=tuple(names)).where(F.col(names[1]) == 0).drop(*names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at similarity 0.8 or more: that of the least doc_id.

    All columns stay.  Null, empty and wordless texts link with nothing and stay,
    rows with a null doc_id too; of repeated rows (same id and text) one stays;
    long texts are compared whole; no rows give none.
    """
    return jaccard.one_of_each(docs, n=5, num=80, den=100)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window of ten words occurs.

    All columns stay.  Null and empty texts stay; long texts are searched whole;
    repeated rows stay or go together, and so do ties; no rows give none.
    """
    return decontam.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data as its kind's name; a column n_chars follows the text, all others stay.

    Every row stays.  A null text stays null, an empty one empty; long texts are
    read whole; repeated rows get equal texts; of spans that start together the
    longest is replaced; no rows give none.
    """
    names = fresh(docs.columns, "base", "added")
    found = pii.personal_data(docs, pii.train(docs), redact=True, names=tuple(names)).drop(*names)
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens placed in sequences (doc_id and places; other columns are not read).

    A null or empty text is its end token alone; long texts are cut into several
    pieces; a null doc_id stays and repeated rows are packed each; equal lengths
    are placed in the order of their rank; no rows give none.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("personal_data", redact_personal),
    ("packing", pack_sequences),
]

#: No SQL expresses the classifier, the tagger or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written as Parquet and read again, and deleted once the next is there."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return docs
