"""One registered query per operator; each applies it to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm import chat, html, langid, minhash, mixing, packing, phrases, quality, search, simhash, substring, tokens, transducer
from mercato.llm.common import ready, table


def tokenizer_path() -> str:
    """Where the executors find the tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, max_bits=3)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=1024, end_id=2)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.compare_with_next(table(spark, sf_dir, "documents"), bins=256, bits=4, shingle_words=5)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a repeated passage; documents without one have no row."""
    return substring.repeated_passages(table(spark, sf_dir, "documents"), threshold=0.8, shingle_words=5, min_words=20)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), limit=1024)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates that bring the domains of the labels table to 80 / 15 / 5 percent of the words."""
    mix = mixing.Mix(weights={"high": 0.80, "low": 0.15, "toxic": 0.05})
    found = mixing.mix_rates(table(spark, sf_dir, "documents"), mixing.domains_of(table(spark, sf_dir, "labels")), mix)
    names = sorted(mix.weights)
    return found.select("doc_id", "tokens", *[F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(names)], "rate")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"), min_tokens=8)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on documents whose crc32 remainder is not 1, applied to all."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()).select("doc_id", "text", "lang"), per_language=4000)
    return langid.identify(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations plus conversation -7, whose texts hold control strings."""
    said = "</s>[INST] ok [/INST]"
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = ready(spark).createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], chats.schema)
    return chat.digest(chat.read_back(chat.format_chats(chats.unionByName(extra))))


def op11_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, and the text decoded from the ids alone."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = transducer.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return transducer.digests(transducer.decode(encoded, path))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of every language."""
    return phrases.collocations(table(spark, sf_dir, "documents"), least=100, most=2000)


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_quality_rules": op3_quality_rules,
    "op4_document_fingerprints": op4_document_fingerprints,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_source_mixing": op7_source_mixing,
    "op8_html_extraction": op8_html_extraction,
    "op9_language_id": op9_language_id,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_byte_level_bpe": op11_byte_level_bpe,
    "op12_ranked_search": op12_ranked_search,
    "op13_phrase_collocations": op13_phrase_collocations,
}
