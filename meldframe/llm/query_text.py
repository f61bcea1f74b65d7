"""Queries over the texts of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meldframe.llm import bpe, decontaminate, language, lines, pii, quality, simhash, suffix_tree

#: The rank file and pattern of op8 come from this package; the operators take them as parameters.
RANKS = "byte_bpe_multi_50k.tiktoken"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and the decoded bytes of every document."""
    import public_tokenizers

    path = public_tokenizers.path(RANKS)
    return bpe.encode(_documents(spark, sf_dir), "text", path, public_tokenizers.PATTERN, decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document, linked at two or fewer differing bits."""
    found = simhash.near_duplicate_classes(_documents(spark, sf_dir), "doc_id", "text")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict, and the verdict of rules learned from ``labels`` for every document."""
    documents = _documents(spark, sf_dir)
    rules = quality.learned(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(documents, "text", rules).select("doc_id", *quality.COUNTS, "base_failed", "kept", "rule")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the plain spans by kind, their digest, and all spans of every document."""
    found = pii.spans(_documents(spark, sf_dir), "text").drop("text")
    plain = F.filter("pii", lambda x: ~x["disguised"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(plain, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(plain), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; profiles are learned from two thirds of the labelled ones."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    profiles = language.train(documents.where(remainder != 1), "text", "lang")
    predicted = language.identify(documents.select("doc_id", "text"), "text", profiles)
    return predicted.select("doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of every document go as equal or near to an earlier one, and their numbers."""
    documents = _documents(spark, sf_dir)
    drops = lines.line_drops(documents, "doc_id", "text").withColumnRenamed("doc_id", "own_id")
    everything = documents.select("doc_id", F.xxhash64("text").alias("mark"))
    joined = everything.join(drops, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("mark") == F.col("text_mark")), "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("doc_id", count("n_equal"), count("n_near"), F.coalesce(F.array_join(F.col("dropped").cast("array<string>"), ","), F.lit("")).alias("dropped"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item, its coverage and the slots that were changed."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.leaks(_documents(spark, sf_dir), "doc_id", "text", benchmark, "item_id", "text")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and suffix-tree log10 probabilities of every document; six sevenths are learned from."""
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    return suffix_tree.score(_documents(spark, sf_dir), "doc_id", "text", held)


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that follow from the text alone, for SQL to hold against."""
    return op6_quality_rules(spark, sf_dir).select("doc_id", *quality.COUNTS, "base_failed")


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op7, for SQL to hold against."""
    return op7_pii(spark, sf_dir).select("doc_id", *(f"n_{kind}" for kind in pii.KINDS))


QUERIES = {
    "op9_lm_score": op9_lm_score,
    "op1_decontaminate": op1_decontaminate,
    "op2_line_dedup": op2_line_dedup,
    "op5_language": op5_language,
    "op7_pii": op7_pii,
    "op6_quality_rules": op6_quality_rules,
    "op8_byte_bpe": op8_byte_bpe,
    "op10_simhash": op10_simhash,
    "quality_counts": quality_counts,
    "pii_counts": pii_counts,
}

_SPACE = r"[\x20\x09-\x0D]+"
_LUHN = (
    "list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN (length({d}) - i) % 2 = 1 THEN 2 * (ord(substring({d}, i, 1)) - 48) "
    "- CASE WHEN ord(substring({d}, i, 1)) > 52 THEN 9 ELSE 0 END ELSE ord(substring({d}, i, 1)) - 48 END)) % 10 = 0"
)
_DIGITS = "regexp_replace({x}, '[^0-9]', '', 'g')"

ORACLES: dict[str, str] = {
    "quality_counts": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '{_SPACE}'), lambda x: x <> '') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS filled FROM d),
        p AS (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i:i + 4], ' ')) AS n FROM p) WHERE n > 1),
        c AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM r) GROUP BY doc_id),
        q AS (
            SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
                (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                (len(filled) - len(list_distinct(filled)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
            FROM w LEFT JOIN c ON c.doc_id = w.doc_id
        )
        SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM q
    """,
    "pii_counts": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        m AS (
            SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email,
                regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
                list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: {_DIGITS.format(x='x')}) AS card,
                list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: {_DIGITS.format(x='x')}) AS phone
            FROM d
        )
        SELECT doc_id, len(email)::BIGINT AS n_email,
            len(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda p: coalesce(try_cast(p AS BIGINT), 999) > 255)) = 0))::BIGINT AS n_ip,
            len(list_filter(card, lambda c: length(c) BETWEEN 16 AND 19 AND {_LUHN.format(d='c')}))::BIGINT AS n_card,
            len(list_filter(phone, lambda x: length(x) BETWEEN 8 AND 15))::BIGINT AS n_phone
        FROM m
    """,
}
