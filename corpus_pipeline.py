"""A training corpus in stages, each written and read again before the next.

Language ID drops texts in no known language, the n-gram join keeps one
document of each near-duplicate group, decontamination drops documents that
hold a benchmark item, personal data is replaced by its kind in brackets, and
BPE turns what is left into tokens.  Every stage but the last returns the
columns of ``documents``.

Null and empty texts are in no language and go with the first stage; a null id
takes part in every stage but the join, which keeps such rows; rows that repeat
an id and a text are one document to the join; a null language is filled by the
predicted one; an empty table passes through all stages as one; without labelled
rows no language is known and every document goes.  Columns beside those of
``documents`` are kept, whatever their names, until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.llm import bpe, decontam, langid, ngram_join, pii
from gleanwork.llm.common import materialize, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts whose best language is less likely than all others together."""
    model = langid.fit(docs)
    # Renamed, so that columns of ``docs`` called score or lang_pred survive.
    found = langid.identify(docs.select(F.struct(*docs.columns).alias("doc"), F.col("text")), model)
    kept = found.filter(f"lang_pred <> '{langid.UNKNOWN}' and score >= 0.5")
    lang = F.coalesce("doc.lang", "lang_pred")
    return kept.select(*[(lang if c == "lang" else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group; documents without id or shingles stay."""
    classes = ngram_join.near_classes(docs)
    kept = materialize(classes.filter("doc_id = component_id").select(F.col("doc_id").alias("__gw_kept")).distinct(), "kept")
    # Rows that repeat an id and a text are one document; the join already deals them to one place.
    own = docs.join(kept, docs["doc_id"] == kept["__gw_kept"]).withColumn("__gw_text", F.xxhash64("text")).dropDuplicates(["__gw_kept", "__gw_text"])
    return own.select(*docs.columns).union(docs.filter("doc_id is null"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    marked = decontam.contaminated(docs.select(F.struct(*docs.columns).alias("doc"), F.col("text")), table(spark, sf_dir, "benchmark"))
    return marked.filter("not contaminated").select("doc.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the text; n_chars follows."""
    out = pii.redact(docs, pii.fit(docs))
    return out.select(*[F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast("long")).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every text, and digests of them and of their decoding."""
    made = bpe.token_digests(docs.select("doc_id", "lang", "source", "text"), ids="ids")
    return made.select("doc_id", "lang", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", personal_data),
    ("BPE encoding and decoding", bpe_tokens),
]
#: Trained models and hashed tokens have no SQL; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name.lower().replace(" ", "-"))
    return docs
