"""Corpus clean-up in five stages, each one of the library's operators on all that the one before kept.

Toxicity drops texts, line dedup shortens them, near dedup keeps one text of each near
group, mixing repeats and drops texts to reach target weights, and byte-level BPE encodes
what is left. A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``docs``
is what the one before wrote. All but the last return the columns of ``documents``.

Repeated ids (the mix writes a text once for each copy) are rows of their own from then on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tissuegrid.llm import lines, mixing, shingles, tokens, toxicity
from tissuegrid.llm.queries import vocabulary
from tissuegrid.session import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
DOC = {"id_col": "doc_id", "text_col": "text"}
# a hot source lets a passage of 20 copies reach fewer sources than op2's ten
MIN_SITES = 5
# No stage but line dedup can be put in SQL: the first is a trained model, the last a tokenizer.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the classifier does not mark; all labels are there to be learnt from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels, **DOC)
    return toxicity.keep_clean(docs.select(*COLUMNS), model, text_col="text")


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text without the lines that ``MIN_SITES`` sources share; ``n_chars`` follows.

    Lines of any length count, also of scripts without spaces; only blank ones are left alone.
    """
    stripped = lines.strip_boilerplate(docs.select(*COLUMNS), site_col="source", min_sites=MIN_SITES, min_words=1, **DOC)
    return stripped.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near copies, that of the least id.

    By op1's fingerprints and pivot distance tables, and by the same tables in the metric of word shingles, as
    four bits of 64 reach almost identical texts only: near copies have near fingerprints or share four fifths of their runs of five words.
    """
    return shingles.keep_one(docs.select(*COLUMNS), fingerprints=True, **DOC)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text as often as the mix takes it: not at all, once or twice."""
    words = docs.select(*COLUMNS).withColumn("_words", mixing.word_count("text"))
    return mixing.take_mix(words, id_col="doc_id", cohort_col="source", size_col="_words").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of every text, and whether they decode to the text again."""
    return tokens.round_trip_events(docs.select("doc_id", "text"), vocabulary(), compare=True, **DOC)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
