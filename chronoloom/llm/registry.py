"""The thin queries over whole tables, their SQL, and the production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm import conversation_repair, decontamination, exact_dedup, license_scan, lm_scoring, near_dedup, neighbours, packing, phrases, quality, suffix_dedup, toxicity, url_filter
from chronoloom.llm.common import table


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    """Path of the tokenizer file; it is read in place and never copied."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


URL_RULES = [url_filter.parse_rule(*x) for x in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


SQL: dict[str, str] = {
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
    "op8_url_filter": """
        WITH cut AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (
            SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        judged AS (
            SELECT *, CASE WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                           WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
                           WHEN ends_with('.' || host, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
                           WHEN ends_with('.' || host, '.com') AND starts_with(path, '/de/') THEN 'com/de/'
                           WHEN ends_with('.' || host, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM parts)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
        FROM judged""",
    "op11_phrase_collocations": """
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        lists AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\\x20\\x09]+') IF x <> ''] AS w FROM pieces),
        starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
        grams AS (SELECT lang, list_slice(w, i, i + m - 1) AS p, m FROM starts, range(1, 6) t(m) WHERE i + m - 1 <= len(w)),
        f AS (SELECT lang, p, any_value(m) AS m, count(*) AS a FROM grams GROUP BY lang, p),
        totals AS (SELECT lang, sum(a) AS n FROM f WHERE m = 1 GROUP BY lang),
        c AS (SELECT * FROM f WHERE m >= 2 AND a >= 100),
        inside AS (SELECT DISTINCT s.lang, s.p FROM c b JOIN c s ON s.lang = b.lang AND s.a <= b.a AND s.m = b.m - 1 AND (s.p = list_slice(b.p, 1, b.m - 1) OR s.p = list_slice(b.p, 2, b.m))),
        cuts AS (SELECT c.lang, c.p, c.m, c.a, x.a AS l, y.a AS r, k, t.n, CAST(1000 AS HUGEINT) * c.a * t.n // (CAST(x.a AS HUGEINT) * y.a) AS score
                 FROM (SELECT c.*, unnest(range(1, m)) AS k FROM c) c JOIN totals t ON t.lang = c.lang
                 JOIN f x ON x.lang = c.lang AND x.p = list_slice(c.p, 1, k) JOIN f y ON y.lang = c.lang AND y.p = list_slice(c.p, k + 1, c.m)),
        best AS (SELECT lang, p, a, arg_min(l, (score, k)) AS l, arg_min(r, (score, k)) AS r, n, min(score) AS score FROM cuts GROUP BY lang, p, a, n),
        ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
                   FROM best WHERE (lang, p) NOT IN (SELECT lang, p FROM inside))
        SELECT * FROM ranked WHERE rank <= 2000""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_toxicity": op4_toxicity,
    "op5_license_scan": op5_license_scan,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_conversation_repair": op13_conversation_repair,
}
