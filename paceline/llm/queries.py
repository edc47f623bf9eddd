"""One query opN_<name> per corpus operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm import bpe, centroids, codebooks, jaccard, kneser_ney, langid, licenses, line_dedup, rule_ensemble, suffix_dedup
from paceline.llm.mixing import mix
from paceline.llm.sharding import shard
from paceline.llm.shared import table
from paceline.llm.topk import top_k


def remainder(n: int, which: int):
    """Whether crc32(doc_id as text) mod n is `which`; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == which, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder(3, 1))
    profiles = langid.learn(docs.filter(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return langid.identify(docs.select("doc_id", "text", "held_out"), profiles).drop("text")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", remainder(4, 2))
    scored = rule_ensemble.classify(docs, table(spark, sf_dir, "labels"), ~F.col("held_out"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.rules(table(spark, sf_dir, "documents"), columns=("doc_id",))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = bpe.round_trip(docs, path)
    ids, text = F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    return decoded.select("doc_id", "n_tokens", ids, text)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.linked(docs, 3, 90, 100).select("doc_id", "n_shingles", "component_id")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"))
    crc = F.crc32(F.encode("text", "UTF-8")).alias("text_crc32")
    return placed.select("doc_id", "size", crc, "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codebooks.compress(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_mix_sources, op3_quality_classifier, op4_quality_rules, op5_byte_bpe, op6_line_dedup, op7_jaccard_join, op8_topk_search, op9_suffix_dedup, op10_sharding,
        op11_delta_lloyd, op12_license_scan, op13_vector_codes,
    )
}

#: Whole sets of word 3-grams joined on common n-grams, then the least id that links reach.
JACCARD_SQL = r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
        FROM documents
    ), s AS (
        SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
            ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g
        FROM w
    ), sized AS (SELECT doc_id, len(g) AS n FROM s), e AS (SELECT doc_id, unnest(g) AS t FROM s),
    p AS (
        SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL
    ), l AS (
        SELECT x, y FROM p JOIN sized a ON a.doc_id = x JOIN sized b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)
    ), r(x, y) AS (
        SELECT doc_id, doc_id FROM sized UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
    )
    SELECT r.x AS doc_id, any_value(n) AS n_shingles, min(r.y) AS component_id FROM r JOIN sized ON sized.doc_id = r.x GROUP BY r.x
"""

#: Maximal runs of lines that two places have in common, from all pairs of equal lines; the later place of each with
#: 10 words or more goes.
LINES_SQL = r"""
    WITH l AS (
        SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
    ), e AS (
        SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM l
    ), w AS (
        SELECT *, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words FROM e
    ), pairs AS (
        SELECT a.doc_id AS x, b.doc_id AS y, b.pos - a.pos AS off, b.pos, b.words
        FROM w a JOIN w b ON a.line = b.line AND (a.doc_id, a.pos) < (b.doc_id, b.pos)
    ), runs AS (
        SELECT *, pos - row_number() OVER (PARTITION BY x, y, off ORDER BY pos) AS run FROM pairs
    ), gone AS (
        SELECT DISTINCT y AS doc_id, pos FROM (SELECT y, pos, sum(words) OVER (PARTITION BY x, y, off, run) AS total FROM runs) WHERE total >= 10
    ), per AS (SELECT doc_id, list(pos) AS ps FROM gone GROUP BY doc_id)
    SELECT d.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
        sha256(array_to_string(list_filter(ls, lambda x, i: NOT coalesce(list_contains(ps, i), false)), chr(10))) AS kept_sha256
    FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN per ON per.doc_id = d.doc_id
"""

#: Vectors that take part, as whole numbers in doubles, which hold them exactly.
VECTORS_SQL = """
    v0 AS MATERIALIZED (
        SELECT vec_id, label, row_number() OVER () AS rid, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) = 64 AND list_count(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
    )"""


def lloyd_sql(k: int = 40, rounds: int = 5) -> str:
    """Plain Lloyd rounds: every vector meets every centroid in each."""
    steps = [VECTORS_SQL.format(scale=256), f"""c0 AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT v, sha256('2:' || vec_id) AS h FROM v0 WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k})
    )"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
        SELECT rid, min(struct_pack(d := list_inner_product(v0.v, v0.v) - 2 * list_inner_product(v0.v, c{r}.v) + list_inner_product(c{r}.v, c{r}.v), c := c)) AS b FROM v0, c{r} GROUP BY rid
    )""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
        SELECT c{r}.c, coalesce(m, v) AS v FROM c{r} LEFT JOIN (
            SELECT c, list(floor(s / n) ORDER BY i) AS m FROM (SELECT b.c AS c, i, sum(v[i]) AS s, count(*) AS n FROM a{r} JOIN v0 USING (rid), range(1, 65) AS t(i) GROUP BY ALL) GROUP BY c
        ) AS new ON new.c = c{r}.c
    )""")
    return f"""WITH {", ".join(steps)}
    SELECT vec_id, CAST(b.c AS INTEGER) AS cluster, CAST(b.d AS BIGINT) AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(list_transform(c{rounds}.v, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
    FROM a{rounds} JOIN v0 USING (rid) JOIN c{rounds} ON c{rounds}.c = b.c"""


def codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    width = 64 // parts
    distance = "list_inner_product(p0.v, p0.v) - 2 * list_inner_product(p0.v, {b}.v) + list_inner_product({b}.v, {b}.v)"
    steps = [VECTORS_SQL.format(scale=4096), f"""p0 AS MATERIALIZED (
        SELECT rid, vec_id, part, v[part * {width} + 1 : part * {width} + {width}] AS v FROM v0, range(0, {parts}) AS t(part)
    )""", f"""b0 AS MATERIALIZED (
        SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, v FROM p0 WHERE vec_id IN (SELECT DISTINCT vec_id FROM v0 ORDER BY vec_id LIMIT {entries})
    )"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
        SELECT rid, p0.part, any_value(p0.v) AS v, min(struct_pack(d := {distance.format(b=f"b{r}")}, e := e)) AS b FROM p0 JOIN b{r} ON p0.part = b{r}.part GROUP BY rid, p0.part
    )""")
        if r < rounds:
            steps.append(f"""b{r + 1} AS MATERIALIZED (
        SELECT b{r}.part, b{r}.e, coalesce(m, v) AS v FROM b{r} LEFT JOIN (
            SELECT part, e, list(floor(s / n) ORDER BY i) AS m FROM (SELECT part, b.e AS e, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, {width + 1}) AS t(i) GROUP BY ALL) GROUP BY part, e
        ) AS new ON new.part = b{r}.part AND new.e = b{r}.e
    )""")
    return f"""WITH {", ".join(steps)},
    done AS (SELECT rid, string_agg(format('{{:02x}}', b.e), '' ORDER BY part) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid),
    shown AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: CAST(x AS BIGINT)), ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{rounds})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM done JOIN v0 USING (rid), shown"""


def licenses_sql() -> str:
    """Every template slid along every text."""
    rows = []
    for t, p in enumerate(licenses.prepared(x, 0.8) for x in licenses.BASE + licenses.LICENCES):
        rows += [f"({t}, '{p.template.label}', {p.template.base}, {len(p.words)}, {p.least}, {len(p.key)}, {i}, '{w}', {int(i in p.key)})" for i, w in enumerate(p.words)]
    return rf"""
    WITH tpl(t, label, base, n, least, n_key, p, word, is_key) AS (VALUES {", ".join(rows)}),
    w AS (
        SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.BETWEEN}'), lambda x: x <> '') AS ws FROM documents
    ), e AS (SELECT doc_id, unnest(range(0, len(ws))) AS pos, unnest(ws) AS word FROM w),
    found AS (
        SELECT doc_id, label, base, n, pos - p AS start, count(*) AS matched FROM e JOIN tpl USING (word)
        GROUP BY doc_id, t, label, base, n, least, n_key, pos - p HAVING count(*) >= least AND sum(is_key) = n_key
    ), per AS (
        SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
            string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(matched / n) AS score
        FROM found GROUP BY doc_id
    )
    SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
    FROM w LEFT JOIN per USING (doc_id)"""


ORACLE_SQL = {
    "op11_delta_lloyd": lloyd_sql(),
    "op12_license_scan": licenses_sql(),
    "op13_vector_codes": codes_sql(),
    "op6_line_dedup": LINES_SQL,
    "op7_jaccard_join": JACCARD_SQL,
    "op8_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
    """,
}
