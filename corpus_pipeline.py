"""From raw documents to token files: the corpus operators in a row, each stage written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.shared import new_folder


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled ones among them, does not reject.

    Null and empty texts stay, unless there is nothing but toxic labels; repeated rows stay or go together; columns may
    have any names beside doc_id and text. An empty table or one without labels gives what it holds.
    """
    from quire.llm.shared import free_name
    from quire.llm.toxicity import score_toxicity, train

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score, rejected = free_name(docs, "toxicity"), free_name(docs, "toxic_predicted")
    return score_toxicity(docs, train(docs, labels), into=(score, rejected)).where(f"{rejected} = 0").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: the row with the least id, a null id before all others.

    Null and empty texts are copies of each other; different texts stay, whatever their ids. Columns may have any names
    beside doc_id and text; an empty table gives an empty table.
    """
    from quire.llm.neardup import distinct_documents

    return distinct_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items; null and empty texts stay, repeated rows stay or go together.

    Columns may have any names beside text; without documents or items everything stays.
    """
    from quire.llm.templates import without_leaks

    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight, a row for each time that a document is taken, and the columns of `docs`.

    A null source is a source of its own; null and empty texts have no words and aren't taken. Rows are told apart by
    their ids, sizes and texts, so that repeated rows are taken as rows of their own. An empty table gives an empty one.
    """
    from quire.llm.mixing import mixed_documents

    return mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and what they hold of each row of it, in ascending doc_id order.

    Null texts are empty; rows that share an id follow each other, null ids come first. An empty table gives no rows.
    """
    import public_tokenizers

    from quire.llm.tokens import read_tokens, write_tokens

    # workers keep what earlier stages took of their memory, so that fewer pieces are remembered than could be
    return read_tokens(write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), remember=250_000))


STAGES = [
    ("toxicity", toxicity),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", token_files),
]

#: SQL expresses neither the models nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = new_folder(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
