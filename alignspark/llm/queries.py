"""The registered opN_ queries and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, hpyp, quality, sentencepiece_codec, simhash, token_counts, token_files, toxicity, url_filter
from .common import table


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; the folder can be set with ALIGNSPARK_TOKENIZERS."""
    folder = os.environ.get("ALIGNSPARK_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are the quality labels; labels share their ids with pages."""
    pages = table(spark, sf_dir, "pages")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    outcomes = pages.select("page_id", url_filter.host_of(F.col("url")).alias("host")).join(labels, "page_id")
    return url_filter.filter_urls(pages, outcomes, URL_RULES)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digest(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_digest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpyp.language_model_scores(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    histogram = token_counts.length_histogram(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return token_counts.suffix_sums(histogram)


_LEVEL_SQL = """
    {name}_up AS (SELECT g.*, u.a / (u.a + u.b) AS m FROM {groups} g JOIN {above} u ON {on}),
    {name}_s AS (SELECT 1 / least(greatest(coalesce(sum(pow(k - n * m, 2) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.001), 0.001), 0.5) - 1 AS s FROM {name}_up),
    {name}_p AS (SELECT {key} AS key, s * m + k AS a, s * (1 - m) + n - k AS b FROM {name}_up, {name}_s)"""

_BOUND_SQL = "{t}.a / ({t}.a + {t}.b) - 1.6448536269514722 * sqrt({t}.a * {t}.b / (({t}.a + {t}.b) * ({t}.a + {t}.b) * ({t}.a + {t}.b + 1)))"

_SUFFIX_SQL = ", ".join(f"'{s}'" for s in url_filter.SUFFIXES)

SQL = {
    "op1_url_filter": f"""
        WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        w AS (SELECT *, array_to_string(string_split(host, '.')[-2:], '.') AS two FROM u),
        v AS (SELECT *, CASE WHEN two IN ({_SUFFIX_SQL}) THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE two END AS domain,
                     CASE WHEN two IN ({_SUFFIX_SQL}) THEN two ELSE string_split(host, '.')[-1] END AS suffix FROM w),
        h AS (SELECT host, domain, suffix, CAST(count(*) AS DOUBLE) AS n, CAST(sum(quality) AS DOUBLE) AS k
              FROM v JOIN labels ON doc_id = page_id WHERE quality IS NOT NULL GROUP BY ALL),
        everything AS (SELECT coalesce(sum(k), 0) + 1 AS a, coalesce(sum(n), 0) - coalesce(sum(k), 0) + 1 AS b FROM h),
        sg AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY suffix),
        dg AS (SELECT domain, min(suffix) AS suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY domain),"""
    + ",".join(
        _LEVEL_SQL.format(name=n, groups=g, above=a, on=o, key=k)
        for n, g, a, o, k in (("s", "sg", "everything", "true", "suffix"), ("d", "dg", "s_p", "u.key = g.suffix", "domain"), ("h", "h", "d_p", "u.key = g.domain", "host"))
    )
    + f"""
        SELECT page_id, host, path, rule, coalesce(said, CASE WHEN b >= 0.6 THEN 'allow' ELSE 'block' END) AS verdict, level, round(b, 6) AS bound FROM (
            SELECT v.page_id, v.host, v.path,
                CASE WHEN (v.host = 'example.com' OR v.host LIKE '%.example.com') AND starts_with(v.path, '/de/') THEN 'example.com/de/'
                     WHEN (v.host = 'example.net' OR v.host LIKE '%.example.net') AND starts_with(v.path, '/en/') THEN 'example.net/en/'
                     WHEN (v.host = 'org' OR v.host LIKE '%.org') AND starts_with(v.path, '/fr/') THEN 'org/fr/'
                     WHEN (v.host = 'net' OR v.host LIKE '%.net') AND starts_with(v.path, '/') THEN 'net/' END AS rule,
                CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' END AS said,
                CASE WHEN hp.a IS NOT NULL THEN 'host' WHEN dp.a IS NOT NULL THEN 'domain' WHEN sp.a IS NOT NULL THEN 'suffix' ELSE 'all' END AS level,
                coalesce({_BOUND_SQL.format(t='hp')}, {_BOUND_SQL.format(t='dp')}, {_BOUND_SQL.format(t='sp')}, {_BOUND_SQL.format(t='e')}) AS b
            FROM v LEFT JOIN h_p hp ON hp.key = v.host LEFT JOIN d_p dp ON dp.key = v.domain LEFT JOIN s_p sp ON sp.key = v.suffix, everything e)""",
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
