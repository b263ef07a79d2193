"""A corpus pipeline of four stages over documents: toxicity, n-gram Jaccard join, substring dedup, packing.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents; run() writes
each stage's rows as Parquet into the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import ngram_join, packing, scratch, substring, toxicity
from graphloom.llm.queries import table, tokenizer_path

#: No equivalent SQL: a fitted classifier and a tokenizer stand in the way.
ORACLE_SQL = None


def _packed(docs: DataFrame) -> DataFrame:
    """(text, row): the text, and all other columns as one, so that none can bear the name of a column that a stage makes."""
    return docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))


def _column(name: str):
    return F.col("text") if name == "text" else F.col(f"row.`{name}`").alias(name)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5, unchanged, repeated rows included. Null and empty texts score as texts without words; an empty table gives none."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(_packed(docs), model, keep=True).where("predicted = 0").select(*map(_column, docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one row with the smallest id; rows without words or id stay.

    Rows are told apart by id and set: of rows that share an id but not their words each is its own case, and of
    repeated rows one stays. An empty table gives none.
    """
    classes = scratch.keep(ngram_join.jaccard_components(docs, with_sets=True), "classes")
    stays = F.col("stands") | (F.col("n_shingles") == 0)
    ids = scratch.keep(classes.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("times"), F.max(stays).alias("stays")), "ids")
    kept = docs.join(ids.where("stays and times = 1").select("doc_id"), "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    several = ids.where("stays and times > 1").select("doc_id")
    if several.limit(1).count():
        # An id alone does not tell its rows apart; their sets do.
        rows = ngram_join.with_signatures(docs.join(several, "doc_id", "left_semi")).withColumn("id", F.col("row.doc_id"))
        standing = classes.where("stands").select(F.col("doc_id").alias("id"), "sig", "sig2").distinct()
        one = rows.where("n > 0").join(standing, ["id", "sig", "sig2"], "left_semi").dropDuplicates(["id", "sig", "sig2"])
        columns = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
        kept = kept.union(one.select(*columns)).union(rows.where("n = 0").select(*columns))
    return kept.union(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated 35-word windows; n_chars follows the text.

    Rows stay one for one, null and empty texts as they are; repeated rows of 35 words and more repeat each other
    and lose all. An empty table gives none.
    """
    cut = substring.drop_repeats(_packed(docs), id_col="row.doc_id", keep=True)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars")).alias("n_chars")
    return cut.select(*[n_chars if c == "n_chars" else _column(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of up to 1024 tokens. Null and empty texts are one token; repeated rows are packed each; an empty table gives none."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"))


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", one_of_each_group), ("substring_dedup", cut_repeats), ("retrieval_packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.keep(docs, f"stage-{name}")
    return docs
