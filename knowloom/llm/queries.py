"""Named queries of the operators over the sample tables and the whole pipeline, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from knowloom.llm import (
    ann, circulant, exact_dedup, license_scan, mixing, packing, prefix_trie, quality, repeats, simhash, spelling, token_files, tokens, url_filters,
)

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; it is installed with the workers, not copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), vocabulary(WORD_BPE), end_id=1, spaces=tokens.DROPPED)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_read(spark, sf_dir, "documents"), license_scan.known_licenses(spark))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_read(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([*URL_RULES], "host string, path string, action string")
    return url_filters.url_verdicts(_read(spark, sf_dir, "pages"), rules)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_classes(_read(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_read(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_round_trip(_read(spark, sf_dir, "documents"), vocabulary(BYTE_BPE), end_id=2, spaces=tokens.LEADING)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.poisson_mixture(docs).select("row.doc_id", "row.source", "copy", "mix_rate", "mix_key")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_read(spark, sf_dir, "conversations"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulant.minhash_classes(_read(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_packing, op2_license_scan, op3_suffix_dedup, op4_url_filters, op5_simhash, op6_exact_dedup, op7_token_files, op8_mixing,
    op9_nearest_neighbours, op10_quality, op11_prefix_trie, op12_minhash, op13_spelling_variants, pipeline)}

_SPACE = r"'[\x20\x09-\x0D]+'"


def _canonical(text: str) -> str:
    """The canonical form of a text by SQL string functions alone."""
    out = rf"regexp_replace(lower(coalesce({text}, '')), '(?m)^[ \t*/#;-]*(copyright|\(c\)|©)[^\n]*$|^[ \t*/#;-]*all rights reserved\.?[ \t]*$', '', 'g')"
    out = rf"' ' || regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g') || ' '"
    for old, new in license_scan.SPELLINGS:
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLES: dict[str, str] = {
    "op2_license_scan": f"""
        WITH notices(license_id, notice) AS (VALUES {", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in license_scan.NOTICES)}),
        known AS (SELECT sha256({_canonical("notice")}) AS d, min(license_id) AS license_id FROM notices GROUP BY 1),
        lines AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\r?\\n')) AS line FROM documents),
        hits AS (SELECT doc_id, license_id FROM lines JOIN known ON sha256({_canonical("line")}) = d),
        found AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS line_licenses, count(*) AS n FROM hits GROUP BY 1),
        docs AS (SELECT doc_id, sha256({_canonical("text")}) AS text_digest FROM documents)
        SELECT docs.doc_id, text_digest, known.license_id AS text_license, line_licenses, coalesce(n, 0)::BIGINT AS n_license_lines
        FROM docs LEFT JOIN known ON d = text_digest LEFT JOIN found ON found.doc_id = docs.doc_id""",
    "op4_url_filters": f"""
        WITH rules(h, p, action) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
        parts AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        sites AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
        best AS (SELECT page_id, first(h || p ORDER BY length(h || p) DESC, length(h) DESC) AS rule, first(action ORDER BY length(h || p) DESC, length(h) DESC) AS action
                 FROM sites JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1)
        SELECT s.page_id, s.host, s.path, b.rule, coalesce(b.action, 'allow') AS verdict FROM sites s LEFT JOIN best b ON s.page_id = b.page_id""",
    "op6_exact_dedup": f"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), {_SPACE}, ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
    "op8_mixing": """
        WITH RECURSIVE a AS (SELECT source, greatest(sum(length(coalesce(text, ''))), 1)::DOUBLE AS amount FROM documents GROUP BY 1),
        t AS (SELECT sum(pow(amount, 0.7)) AS w, sum(amount) AS a FROM a),
        w AS (SELECT source, round((t.a / t.w) * pow(amount, 0.7) / amount, 9) AS whole FROM a, t),
        r AS (SELECT source, whole, greatest(ceil(whole / 16.0), 1)::BIGINT AS parts, whole / greatest(ceil(whole / 16.0), 1) AS rate FROM w),
        terms(source, rate, k, p, c) AS (
            SELECT source, rate, 0, exp(-rate), exp(-rate) FROM r
            UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM terms WHERE k < 80),
        cdf AS (SELECT source, list(c ORDER BY k) AS cs FROM terms GROUP BY 1),
        drawn AS (SELECT d.doc_id, d.source, whole AS rate, list_sum(list_transform(range(1, parts + 1), lambda i: least(80, len(list_filter(cs, lambda c:
                         c <= ('0x' || substr(md5(CASE WHEN parts = 1 THEN '1' ELSE '1.' || i END || '|' || d.doc_id || '|' || d.source), 1, 13))::BIGINT / 4503599627370496.0))))) AS n
                  FROM documents d JOIN cdf ON d.source = cdf.source JOIN r ON r.source = d.source)
        SELECT doc_id, source, copy::INTEGER AS copy, rate AS mix_rate, md5('1|' || doc_id || '|' || copy) AS mix_key
        FROM (SELECT doc_id, source, rate, unnest(range(1, n::BIGINT + 1)) AS copy FROM drawn)""",
}
