"""The registered queries of these operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import archive, audit, centroids, chat, minhash, packing, pieces, quality, spans, suffix, tiling, tokens, toxicity
from marginalia.llm.base import read
from marginalia.llm.oracles import ORACLES  # noqa: F401  (read by the entry module)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    measured = quality.judge(docs)
    return measured.select("doc_id", *quality.MEASURES, "base_failed", "kept")


def op2_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = spans.remove_repeats(read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.decode("kept", "UTF-8").alias("text"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive.write(read(spark, sf_dir, "pages"))
    return archive.fetch(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tiling.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "coverage", "item_ids")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), k=3, percent=85).drop("th")


def op6_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix.remove_repeated_bytes(read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    labels = read(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic")
    lexicon = toxicity.learn(docs, labels)
    return toxicity.scored(docs, lexicon).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    back = chat.read_back(chat.saved_format(rows.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("learnt").cast("bigint").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokens.read(tokens.write(read(spark, sf_dir, "documents"), path, size=50257, end=2))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(audit.masks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings"))[0]


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    ids = pieces.encoded(read(spark, sf_dir, "documents"), path, ["doc_id"])
    digests = ids.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    back = pieces.decoded(digests, path, ["doc_id", "n_tokens", "ids_sha256"])
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality,
        op2_sentence_spans,
        op3_warc,
        op4_decontamination,
        op5_near_duplicates,
        op6_repeated_bytes,
        op7_packing,
        op8_toxicity,
        op9_chat,
        op10_token_ids,
        op11_filter_audit,
        op12_centroids,
        op13_pieces,
        pipeline,
    )
}
