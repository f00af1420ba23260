"""The registered queries of the numbered operators, each over its whole table."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.llm import bpe, chats, decontaminate, hardneg, langid, maintext, manifest, minhash, secrets, simhash, syncmers, toxicity, twins, urls
from tessella.llm.common import fold, table
from tessella.session import scratch

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary_path() -> str:
    import public_tokenizers  # noqa: PLC0415

    return public_tokenizers.path("word_bpe_49k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    docs = table(spark, sf_dir, "documents")
    return bpe.encode(docs, bpe.read_vocabulary(vocabulary_path()), "text", ("doc_id",), digests=True)


def op1_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return chats.render(table(spark, sf_dir, "conversations"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return maintext.extract(table(spark, sf_dir, "pages"), "html", {"page_id": F.col("page_id"), "url": F.col("url")})


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its half-replaced text."""
    return syncmers.compare_with_next(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; rows with fold 2 of 4 are never learned from."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    sample = langid.fit(docs, ~held)
    return langid.predict(docs, sample, keep={"doc_id": F.col("doc_id"), "held_out": held})


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and test item that overlap."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), {"doc_id": F.col("doc_id")})


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; the ledger starts empty, so every blob is scanned once."""
    return secrets.report(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; rows with fold 0 of 5 are never learned from."""
    docs = table(spark, sf_dir, "documents")
    held = toxicity.held_out("doc_id")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), train=~held)
    scored = toxicity.score(docs, model, keep={"doc_id": F.col("doc_id"), "held_out": held})
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, folded again from its row as it is or, for one id in seven, with a changed n_chars."""
    docs = table(spark, sf_dir, "documents")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = [*columns[:3], F.col("n_chars") + 1, columns[4]]
    tampered = F.coalesce(fold("doc_id", 7) == 0, F.lit(False))
    leaves = docs.select(
        "doc_id", "lang", manifest.leaf(columns).alias("hash"), F.when(tampered, manifest.leaf(changed)).alias("changed"))
    leaves = leaves.select("lang", "doc_id", "hash", F.struct("doc_id", "changed").alias("row"))
    proved = manifest.prove(manifest.build(leaves, "lang", ["doc_id"], "row"))
    folded = manifest.folded(F.coalesce("row.changed", "hash"), F.col("path"))
    out = proved.select(
        "row.doc_id", F.col("hash").alias("leaf"), "subroot", "root",
        F.sha2(F.array_join(manifest.siblings(F.col("path")), ""), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; one label in seven is another one first."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=shifted)


def secrets_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored ledger in three scans: documents of even id, then all of them, then all again with a newer rule; pairs and spans that each scan added."""
    docs, ledger = table(spark, sf_dir, "documents"), scratch(spark)
    newer = tuple(dataclasses.replace(r, version=r.version + 1) if r.kind == "hex" else r for r in secrets.RULES)
    early = docs.where(F.col("doc_id") % 2 == 0)
    for k, (rows, rules) in enumerate(((early, secrets.RULES), (docs, secrets.RULES), (docs, newer)), 1):
        seen = spark.read.parquet(*[f"{ledger}/scan={j}" for j in range(1, k)]) if k > 1 else None
        secrets.scan(rows, seen, rules).write.parquet(f"{ledger}/scan={k}")
    return spark.read.parquet(ledger).groupBy("scan", "rule", "version").agg(F.count("*").alias("pairs"), F.sum(F.size("spans")).alias("n_spans")).select(
        F.col("scan").cast("int").alias("scan"), "rule", "version", "pairs", F.col("n_spans").cast("long").alias("n_spans"))


QUERIES: dict[str, Query] = {
    "op1_chats": op1_chats,
    "op2_simhash": op2_simhash,
    "op3_main_text": op3_main_text,
    "op4_syncmers": op4_syncmers,
    "op5_language": op5_language,
    "op6_bpe": op6_bpe,
    "op7_decontamination": op7_decontamination,
    "op8_secrets": op8_secrets,
    "op9_url_filter": op9_url_filter,
    "op10_toxicity": op10_toxicity,
    "op11_manifest": op11_manifest,
    "op12_minhash": op12_minhash,
    "op13_hard_negatives": op13_hard_negatives,
    "secrets_ledger": secrets_ledger,
}

ORACLE: dict[str, str] = {
    "op1_chats": twins.chats_sql(),
    "op8_secrets": twins.secrets_sql(),
    "op9_url_filter": twins.urls_sql(),
    "op11_manifest": twins.manifest_sql(),
    "op12_minhash": twins.minhash_sql(),
    "op13_hard_negatives": twins.hard_negatives_sql(),
    "secrets_ledger": twins.ledger_sql(),
}
