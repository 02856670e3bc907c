"""The queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import media, mixing, ngram_join, packing, quality, secrets, token_counts, topk, toxicity, url_rules
from tessella.llm.labelled import held_out


def vocabulary(name: str) -> str:
    """Where a public vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_secret_scan(spark: SparkSession, sf_dir: str, words: str | None = None) -> DataFrame:
    words = words or vocabulary("byte_bpe_50k.json")
    return secrets.scan(table(spark, sf_dir, "documents"), secrets.fit(vocabulary=words), words)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer or vocabulary("byte_bpe_50k.json")))


def op8_token_counts(spark: SparkSession, sf_dir: str, pieces: str | None = None) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), pieces or vocabulary("word_bpe_49k.json"))


def _scored(rows: DataFrame, least: float) -> DataFrame:
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return _scored(toxicity.score(docs, toxicity.fit(docs, labels)), 0.7)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return _scored(quality.score(docs, quality.fit(docs, labels)), 0.5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_source_mix": op2_source_mix,
    "op3_exact_topk": op3_exact_topk,
    "op4_secret_scan": op4_secret_scan,
    "op5_url_filter": op5_url_filter,
    "op6_media": op6_media,
    "op7_packing": op7_packing,
    "op8_token_counts": op8_token_counts,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
}

#: A text's words, as the contracts define them.
SQL_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLE: dict[str, str] = {
    "op1_ngram_jaccard": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {SQL_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
            s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
            n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
                HAVING 100 * count(*) >= 85 * ((SELECT n FROM n WHERE doc_id = a.doc_id) + (SELECT n FROM n WHERE doc_id = b.doc_id) - count(*))),
            c(id, label) USING KEY (id) AS (SELECT doc_id, doc_id FROM documents UNION
                SELECT l.b, min(c.label) FROM c JOIN l ON l.a = c.id JOIN recurring.c r ON r.id = l.b WHERE c.label < r.label GROUP BY l.b)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.label AS component_id FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
    """,
    "op2_source_mix": f"""
        WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, len({SQL_WORDS})::BIGINT AS size, ('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT AS u FROM documents),
            s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
            o AS (SELECT *, 3.0::DOUBLE * source_size AS most, row_number() OVER f AS k, coalesce(sum(3.0::DOUBLE * source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
                sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w FROM s WINDOW f AS (ORDER BY source_size / weight, source)),
            r AS (SELECT arg_min(((SELECT sum(source_size) FROM s) - held) / w, k) AS rate FROM o WHERE ((SELECT sum(source_size) FROM s) - held) / w * weight <= most),
            t AS MATERIALIZED (SELECT source, source_size, target, whole, (target - whole * source_size) / source_size AS f
                FROM (SELECT *, floor(target / source_size)::BIGINT AS whole FROM (SELECT source, source_size, least(rate * weight, most) AS target FROM o, r))),
            b AS (SELECT *, length(bin(size)) * 8 + ((size >> greatest(length(bin(size)) - 4, 0)) & 7) AS class FROM d WHERE size > 0),
            n AS MATERIALIZED (SELECT source, class, count(*) AS n, sum(size)::BIGINT AS words FROM b GROUP BY source, class),
            i AS MATERIALIZED (SELECT b.*, n.n, n.words, f, f / (1 - f) * (size * n.n)::DOUBLE / n.words::DOUBLE AS odds
                FROM b JOIN n ON n.source IS NOT DISTINCT FROM b.source AND n.class = b.class JOIN t ON t.source IS NOT DISTINCT FROM b.source),
            c AS MATERIALIZED (SELECT source, class, n, words, f, CASE WHEN sum(odds / (1 + odds)) > 0 THEN round(sum(odds / (1 + odds) * size) / sum(odds / (1 + odds)), 6) ELSE words::DOUBLE / n END AS mean,
                row_number() OVER (PARTITION BY source ORDER BY class DESC) AS step FROM i GROUP BY source, class, n, words, f),
            walk AS (SELECT source, 0::BIGINT AS step, 0::DOUBLE AS rest, NULL::BIGINT AS class, 0::BIGINT AS room FROM t
                UNION ALL SELECT source, step, want - room * mean, class, room FROM (SELECT c.*, rest + f * words AS want, least(greatest(round((rest + f * words) / mean), 0), c.n)::BIGINT AS room
                    FROM walk w JOIN c ON c.source IS NOT DISTINCT FROM w.source AND c.step = w.step + 1)),
            k AS (SELECT i.doc_id, i.source, i.size, row_number() OVER (PARTITION BY i.source, i.class ORDER BY (u + 0.5::DOUBLE) / (pow(2::DOUBLE, 52) - u - 0.5::DOUBLE) / odds, doc_id::VARCHAR, size) <= room AS sampled
                FROM i JOIN walk w ON w.source IS NOT DISTINCT FROM i.source AND w.class = i.class),
            e AS (SELECT doc_id, source, size, sampled FROM k UNION ALL SELECT doc_id, source, size, false FROM d WHERE size = 0)
        SELECT doc_id, size, coalesce(t.source_size, 0)::BIGINT AS source_size, coalesce(target, 0) AS target, ((coalesce(whole, 0) + CASE WHEN sampled THEN 1 ELSE 0 END) * size)::BIGINT AS taken
            FROM e LEFT JOIN t ON t.source IS NOT DISTINCT FROM e.source
    """,
    "op5_url_filter": rf"""
        WITH u AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
            h AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
            w AS (SELECT *, CASE {" ".join(f"WHEN (host = '{r.partition('/')[0]}' OR host LIKE '%.{r.partition('/')[0]}') AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'" for _, r in sorted(url_rules.RULES, key=lambda x: -len(x[1])))} END AS rule,
                list_sort(list_distinct(list_filter(list_concat(
                    list_transform(list_reverse(string_split(host, '.')), lambda x, i: CASE WHEN x <> '' THEN 'h' || (i - 1)::VARCHAR || '=' || regexp_replace(x, '[0-9]+', '0', 'g') END),
                    list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x, i: 'p' || (i - 1)::VARCHAR || '=' || regexp_replace(x, '[0-9]+', '0', 'g')),
                    [CASE WHEN regexp_extract(path, '\.([A-Za-z0-9]+)$', 1) <> '' THEN 'x=' || regexp_extract(path, '\.([A-Za-z0-9]+)$', 1) END],
                    list_transform(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: CASE WHEN string_split(x, '=')[1] <> '' THEN 'q=' || regexp_replace(string_split(x, '=')[1], '[0-9]+', '0', 'g') END)), lambda x: x IS NOT NULL))) AS items FROM h),
            j AS MATERIALIZED (SELECT *, CASE rule {" ".join(f"WHEN '{r}' THEN '{v}'" for v, r in url_rules.RULES)} END AS judged, row_number() OVER () AS k FROM w),
            b AS (SELECT k, judged, items, unnest(range(1, (2 ** len(items))::BIGINT)) AS mask FROM j),
            s AS MATERIALIZED (SELECT k, judged, list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS part FROM b),
            n AS (SELECT part, count(*) AS n FROM s WHERE judged IS NOT NULL GROUP BY part),
            r AS (SELECT part, judged AS verdict, count(*)::DOUBLE / any_value(n.n)::DOUBLE AS confidence, count(*)::DOUBLE / (SELECT count(judged) FROM j)::DOUBLE AS support
                FROM s JOIN n USING (part) WHERE judged IS NOT NULL GROUP BY part, judged
                HAVING count(*) >= ceil({url_rules.MIN_SUPPORT} * (SELECT count(judged) FROM j)) AND count(*)::DOUBLE / any_value(n.n)::DOUBLE >= {url_rules.MIN_CONFIDENCE}),
            m AS (SELECT k, max((confidence, support, verdict = 'block', verdict)) AS best FROM s JOIN r USING (part) WHERE s.judged IS NULL GROUP BY k)
        SELECT page_id, host, path, rule, coalesce(judged, best[4], 'allow') AS verdict, best[1] AS confidence FROM j LEFT JOIN m USING (k)
    """,
    "op3_exact_topk": """
        WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
                   FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, d.vec_id,
                          list_inner_product(list_transform(q.v, lambda x: x::DOUBLE), list_transform(d.v, lambda x: x::DOUBLE))::BIGINT AS score
                   FROM v q JOIN v d ON q.vec_id % 100 = 0 AND d.vec_id <> q.vec_id AND len(d.v) = len(q.v)),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
}
