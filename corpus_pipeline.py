"""A corpus from raw documents to packed sequences: five stages, each an operator over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from combtrack.llm._common import materialize
from combtrack.llm.op01_jaccard import jaccard_components, keep_one_of_each
from combtrack.llm.op05_toxicity import learn_toxicity, score_toxicity
from combtrack.llm.op07_packing import pack_tokens
from combtrack.llm.op08_language import identify_language, learn_languages
from combtrack.llm.op09_passages import drop_repeated_passages


def _fold(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


#: The corpus is of these languages; a text that takes more than so many bits a symbol, and SPARE_BITS in all, is in none of them.
#: On labelled rows 99.9 % take at most 4.9 bits, the highest of over 23 characters 5.4; random letters, Base64 and other scripts take 8 to 14.
LANGUAGES, MOST_BITS, SPARE_BITS = ("de", "en", "es", "fr"), 6.2, 32


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of LANGUAGES by what they say, with that language as `lang`, whatever their label was.

    Those without text or a letter go, and those that no learnt language explains: the allowance of SPARE_BITS a text
    lets few characters prove little, and counts for less the longer a text is.
    Languages without a labelled document can't be found. Null ids and repeated rows are judged like any other.
    """
    found = identify_language(docs, learn_languages(docs, _fold(3) != 1), keep=True)
    lang_pred, _, bits = (F.col(c) for c in found.columns[-3:])
    found = found.where(lang_pred.isin(*LANGUAGES) & (bits <= MOST_BITS + F.lit(float(SPARE_BITS)) / F.length("text")))
    return found.withColumn("lang", lang_pred).select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3, by a lexicon learnt from the labels of those that got here. Null and empty texts score 0; null ids and repeated rows stay."""
    lexicon = learn_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), _fold(4) != 2)
    scored = score_toxicity(docs, lexicon, keep=True)
    return scored.where(F.col(scored.columns[-1]) < 0.3).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 of five-word shingles the document with the smallest id.

    Repeated rows of that id all stay, and so do rows with a null id and texts without words.
    """
    return keep_one_of_each(docs, jaccard_components(docs, n=5, num=80, den=100))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words that one of smaller id holds. Null and short texts and rows with a null id stay as they are. `n_chars`, where it is a column, is counted anew."""
    out = drop_repeated_passages(docs, window=50)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens. A null or empty text is one piece of the end id; null ids and repeated rows are packed like any other."""
    return pack_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, public_tokenizers.PATTERN)


STAGES = [("language", language), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("passages", passages), ("packing", packing)]

#: Stages of learnt models or a tokenizer can't be told in SQL; tests/llm compares each stage's rows with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
