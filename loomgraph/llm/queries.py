"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import bpe_dp, chat, collocations, embedding_dup, multi_index, near_dup, packing, quality, sharding, spelling, token_files, toxicity

#: Byte limit of a shard in op4.
SHARD_BYTES = 1 << 20
#: A conversation whose texts hold the template's control strings, added to op2's table.
CONTROL_ROWS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings with equal labels at cosine 0.98."""
    return embedding_dup.classes(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as ids and loss mask, read back into digests."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(CONTROL_ROWS, "conv_id long, turn long, role string, text string"))
    return chat.conversation_digests(chat.format_turns(rows))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document by the prefix table, as digests."""
    return bpe_dp.encode_decode_digests(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to shards of at most 1 MiB of text."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learnt outside the held-out fold."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids through the bit-plane files and back."""
    return token_files.token_file_digests(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the likelihood-ratio verdict for all documents."""
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token counts of every document from the per-prefix tables."""
    return bpe_dp.count_tokens(table(spark, sf_dir, "documents"), limit=2048)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked at 0.8 on two-word shingles."""
    return near_dup.classes(table(spark, sf_dir, "documents"), k=2, percent=80)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, forms and roots of all words of the documents."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth embedding among all embeddings."""
    return multi_index.search(table(spark, sf_dir, "embeddings"), k=20, modulus=20)


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language in all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embedding_near_dedup, op2_chat_formatting, op3_bpe, op4_sharding, op5_toxicity, op6_token_files, op7_quality_rules, op8_token_counts, op9_packing, op10_minhash_near_dedup, op11_spelling_variants, op12_nearest_neighbours, op13_phrase_collocations)}


def oracle_sql() -> dict[str, str]:
    return {"op4_sharding": sharding.SQL.format(limit=SHARD_BYTES), "op13_phrase_collocations": collocations.SQL.format(least=10, top=2000, share=50)}
