"""A corpus made ready for training, in stages over the whole of documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it
to the shared folder as Parquet, and the next stage reads that. All stages but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelath.llm import decontam, linededup, neardup, pieces, quality
from wavelath.llm.common import scratch, stage_table, table


def apart(docs: DataFrame) -> DataFrame:
    """doc_id and text, and the other columns as one, so that no name clashes with a stage's own."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]).alias("others"))


def in_order(rows: DataFrame, columns: list[str], **new) -> DataFrame:
    """The columns of documents again, some of them new."""
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) if c in ("doc_id", "text") else F.col(f"others.`{c}`") for c in columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier, fitted on labels: documents that it rejects go."""
    vectors, net = quality.fit(docs, table(spark, sf_dir, "labels"))
    return in_order(quality.score(apart(docs), vectors, net).filter("predicted = 1"), docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: a line that an earlier document or place has, word for word or but for one word, goes.

    A document of which each line goes, or is a short one that an earlier document has, is a copy as a whole, and goes too; one without words stays.
    """
    cleaned = linededup.marked(apart(docs)).filter("NOT is_copy")
    return in_order(cleaned, docs.columns, n_chars=F.length("text").cast("long"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates: one document of each group stays."""
    return neardup.representatives(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination: documents that hold a benchmark item go."""
    return decontam.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece: ids and the source bytes of each, beside the columns of documents."""
    import public_tokenizers

    return pieces.with_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", keep_one_of_each),
    ("decontamination", drop_benchmark),
    ("sentencepiece", tokenize),
]

#: SQL can express neither the classifier nor the encoder; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):  # a stage's own intermediate tables go when its result stands
            docs = stage_table(stage(spark, docs, sf_dir), name.replace(" ", "_"), lasting=True)
    return docs
