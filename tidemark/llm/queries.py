"""The operators of this subpackage as queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, exact_dedup, language_id, lexical_search, merkle, near_dedup, packing, quality_rules, secret_scan, token_counts, token_output, toxicity, url_filter
from ._shared import table


# Verdict, host and path of the rules on URLs.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.rollup(table(spark, sf_dir, "documents"), {"byte_bpe_50k": public_tokenizers.path("byte_bpe_50k.json")})


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip_digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.label(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, max_len=4096)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_file_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.junk_pages(pages), URL_RULES)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_toxicity": op2_toxicity,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_secret_scan": op4_secret_scan,
    "op5_near_dedup": op5_near_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_packing": op7_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_token_output": op9_token_output,
    "op10_language_id": op10_language_id,
    "op11_url_filter": op11_url_filter,
    "op12_lexical_search": op12_lexical_search,
    "op13_merkle_manifest": op13_merkle_manifest,
}

def _merkle_sql(depth: int = 5, upper: int = 4) -> str:
    """DuckDB SQL of op13 for trees of up to 16^depth rows a source and 16^upper sources: a level is a common table."""
    nibbles = []
    for i in range(16):
        c = i
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        nibbles.append(c)
    # crc32 of the decimal doc_id: each byte is two steps of four bits
    step = f"xor(xor(s, x) >> 4, ({nibbles}::BIGINT[])[(xor(s, x) & 15)::INT + 1])"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: [ord(ch)::BIGINT, 0]))), lambda s, x: {step}), 4294967295)"
    field = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
    row = lambda text: "sha256(" + " || ".join([*map(field, ("doc_id", "source", "lang", "n_chars")), field(text)]) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        f"rows AS (SELECT doc_id, coalesce('s' || source, '') AS tree, {row('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {row(low)} ELSE {row('text')} END AS changed FROM documents)",
        "d AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS idx FROM rows)",
        "a0 AS (SELECT tree, idx, leaf AS digest FROM d)",
    ]

    def climb(name: str, levels: int) -> None:
        for k in range(levels):
            ctes.append(f"{name}{k}n AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n, idx // 16 AS up FROM {name}{k})")
            ctes.append(f"{name}{k}r AS (SELECT tree, up, list(digest ORDER BY idx) AS run FROM {name}{k}n WHERE n > 1 GROUP BY tree, up)")
            ctes.append(f"{name}{k + 1} AS (SELECT tree, up AS idx, sha256(array_to_string(run, '')) AS digest FROM {name}{k}r UNION ALL SELECT tree, idx, digest FROM {name}{k}n WHERE n = 1)")

    climb("a", depth)
    ctes.append(f"b0 AS (SELECT 'top' AS tree, row_number() OVER (ORDER BY tree) - 1 AS idx, digest, tree AS source FROM a{depth})")
    ctes.append("b0x AS (SELECT source AS tree, idx, digest FROM b0)")
    climb("b", upper)
    at = "SELECT doc_id, d.tree, d.idx, x.idx AS top_idx, x.digest AS subroot, leaf, changed AS cur, '' AS proof FROM d JOIN b0x x USING (tree)"
    ctes.append(f"w0 AS ({at})")
    k = 0
    for name, levels in (("a", depth), ("b", upper)):
        for lv in range(levels):
            tree, idx = ("w.tree", "w.idx") if name == "a" else ("'top'", "w.top_idx")
            slot = f"({idx} % 16)"
            before, after = f"array_to_string(run[:{slot}], '')", f"array_to_string(run[{slot} + 2:], '')"
            moved = f"{idx} // 16"
            i, t = (f"CASE WHEN run IS NULL THEN w.idx ELSE {moved} END", "w.top_idx") if name == "a" else ("w.idx", f"CASE WHEN run IS NULL THEN w.top_idx ELSE {moved} END")
            ctes.append(
                f"w{k + 1} AS (SELECT doc_id, w.tree, {i} AS idx, {t} AS top_idx, subroot, leaf, CASE WHEN run IS NULL THEN cur ELSE sha256({before} || cur || {after}) END AS cur, "
                f"CASE WHEN run IS NULL THEN proof ELSE proof || {before} || {after} END AS proof FROM w{k} w LEFT JOIN {name}{lv}r r ON r.tree = {tree} AND r.up = {moved})"
            )
            k += 1
    return f"WITH {', '.join(c.replace(' AS (', ' AS MATERIALIZED (', 1) for c in ctes)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified FROM w{k}, (SELECT digest AS root FROM b{upper})"


ORACLE = {
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_url_filter": r"""
        WITH parts AS (
            SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
                   list_sort(list_filter(string_split(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), '&'),
                                         lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS params,
                   regexp_extract(html, '<title>([^<]*)</title>', 1) AS title
            FROM pages),
        keyed AS (
            SELECT page_id, host, path,
                   regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
                   || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical,
                   length(title) - length(translate(title, '#*$%|', '')) > 0.05 * length(title) AS junk
            FROM parts),
        rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        fit AS (
            SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
            FROM keyed, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
        SELECT k.page_id, host, path, rule, canonical,
               coalesce(verdict, CASE WHEN canonical <> '' AND canonical IN (SELECT canonical FROM keyed WHERE junk) THEN 'block' ELSE 'allow' END) AS verdict
        FROM keyed k LEFT JOIN fit USING (page_id)
    """,
    "op12_lexical_search": r"""
        WITH words AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM documents),
        asked AS (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark),
        lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
        totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM lengths),
        tfs AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
        weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, totals GROUP BY term, docs),
        impacts AS (
            SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // l))) AS impact
            FROM tfs JOIN lengths USING (doc_id) JOIN weights USING (term), totals),
        scores AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY item_id, doc_id)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
        FROM scores WHERE score > 0 QUALIFY rank <= 10
    """,
    "op13_merkle_manifest": _merkle_sql(),
}
