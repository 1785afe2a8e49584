"""From raw documents to packed training sequences, each stage one operator of ``tablekeep.llm``.

Stages take (spark, docs, folder of tables) and give a frame, which is written as Parquet and read
again as the next one's documents. All but the last return the columns of the documents they got,
extra ones included, with ``text`` and ``n_chars`` as the stage leaves them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablekeep.llm import packing, quality_model, quality_rules as rules, repeats, simhash
from tablekeep.llm.common import table
from tablekeep.llm.queries import tokenizer_file
from tablekeep.session import release_scratch, scratch_folder, scratch_mark

# no stage of this chain as a whole can be expressed in SQL
ORACLE_SQL = None


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents under neutral column names, which clash with nothing, and these names."""
    names = {name: f"d{i}" for i, name in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _named(found: DataFrame, names: dict[str, str], text: str | None = None) -> DataFrame:
    """The documents' own columns again, with the text of column ``text`` if one is given."""
    new = {names["text"]: F.col(text)} if text else {}
    if text and "n_chars" in names:
        new[names["n_chars"]] = F.length(text).cast(found.schema[names["n_chars"]].dataType)
    columns = [new.get(own, F.col(own)).alias(name) for name, own in names.items()]
    return found.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; frequent lines of a source are removed from the others."""
    plain, names = _plain(docs)
    judged = rules.quality_rules(plain, names["text"], names["source"]).filter("kept")
    return _named(judged, names, "clean_text")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold go. The model is that of the whole labelled table."""
    model = quality_model.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    plain, names = _plain(docs)
    return _named(quality_model.score(plain, model, names["text"]).filter("predicted = 1"), names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: shingles of 4 words, 4 bits."""
    return simhash.drop_near_duplicates(docs, "doc_id", "text", shingle=4, radius=4)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur more than once are removed from every text."""
    plain, names = _plain(docs)
    found = repeats.remove_repeats(plain, names["text"], length=200)
    return _named(found, names, "kept_text")


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids as pieces of sequences of 4096."""
    tokenizer = tokenizer_file("word_bpe_49k.json")
    return packing.pack(docs, tokenizer, capacity=4096, end_id=2, with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other over the documents of a folder of tables.

    What a stage wrote on its way is deleted once its result is, and so is the result that it read.
    """
    docs, mark = table(spark, sf_dir, "documents"), scratch_mark()
    for name, stage in STAGES:
        found = stage(spark, docs, sf_dir)
        path = scratch_folder(spark, f"pipeline-{name.replace(' ', '-')}")
        found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
        release_scratch(spark, mark, [path])
    return docs
