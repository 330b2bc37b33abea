"""The numbered queries: thin calls of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import conv_quality, embed_dedup, jaccard, lexical, mixing, packing, periodic, sharding, substring, token_ids, topk, toxicity, url_filter
from paperloom.llm.store import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.kd_shards(table(spark, sf_dir, "documents"), 8)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.token_digests(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def _planted(docs: DataFrame) -> DataFrame:
    """The contract's periodic tails: where crc32(doc_id) is divisible by 10 words from a place on repeat those of a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    split = docs.select("doc_id", "text", (h / 10).cast("long").alias("g"), F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("w"))
    placed = split.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    placed = placed.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    whole = F.expr("array_join(concat(slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), cast((n - a + p - 1) div p as int))), 1, n - a)), ' ')")
    return placed.select("doc_id", F.when(F.col("n") > 0, whole).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(_planted(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    found = found.withColumn("n_runs", F.size("runs").cast("long")).withColumn("longest", longest)
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    start, period = -F.col("longest.before"), -F.col("longest.shorter")
    return found.select("doc_id", "n_runs", start.alias("start"), F.col("longest.length").alias("length"), period.alias("period"), F.expr("1000 * longest.length div -longest.shorter").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.col("digest").alias("collapsed_sha256"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conv_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_url_filter, op2_substring_dedup, op3_toxicity, op4_exact_topk, op5_packing, op6_embedding_dedup, op7_sharding, op8_token_ids, op9_mixing, op10_ngram_jaccard, op11_periodic_runs, op12_quality, op13_lexical_search)
}

_WORD = r"[^\x20\x09-\x0D]+"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_REACH = """reach AS (SELECT id AS node, id AS other FROM ids UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
component AS (SELECT node, min(other) AS component_id FROM reach GROUP BY 1)"""

ORACLES: dict[str, str] = {
    "op1_url_filter": r"""WITH r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        u AS (SELECT page_id, row_number() OVER () AS n, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
        f AS (SELECT n, h || p AS rule, v FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) QUALIFY row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, h || p DESC) = 1)
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN f USING (n)""",
    "op2_substring_dedup": f"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_WORD}'), []) AS w FROM documents),
        k AS (SELECT doc_id, w[i] AS word, i, CASE WHEN i + 12 <= len(w) THEN array_to_string(w[i:i + 12], ' ') END AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
        m AS (SELECT *, g IS NOT NULL AND min(doc_id) OVER (PARTITION BY g) < doc_id AS again FROM k),
        c AS (SELECT *, max(again::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM m),
        s AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)""",
    "op4_exact_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score FROM v q JOIN v ON q.vec_id <> v.vec_id AND q.vec_id % 20 = 0)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 20""",
    "op6_embedding_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), ids AS (SELECT vec_id AS id FROM v),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= 0.98), {_REACH},
        n AS (SELECT a, count(*) AS n_links FROM links GROUP BY 1)
        SELECT id AS vec_id, coalesce(n_links, 0) AS n_links, component_id, component_id = id AS kept FROM ids JOIN component ON node = id LEFT JOIN n ON a = id""",
    "op10_ngram_jaccard": f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}'), []) AS w FROM documents),
        g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)), ids AS (SELECT doc_id AS id FROM documents), {_REACH}
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d JOIN component ON node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op11_periodic_runs": f"""WITH o AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_WORD}'), []) AS o,
            xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), 4294967295::BIGINT), 4294967295) AS h FROM documents),
        a AS (SELECT *, len(o) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(o) > 0 THEN (h // 10) % len(o) END AS a FROM o),
        d AS (SELECT doc_id, n, list_transform(range(n), lambda i: o[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END]) AS w FROM a),
        k AS (SELECT doc_id, n, w[i + 1] AS word, i, CASE WHEN i + 5 <= n THEN array_to_string(w[i + 1:i + 5], ' ') END AS g FROM (SELECT doc_id, n, w, unnest(range(n)) AS i FROM d)),
        e AS (SELECT x.doc_id, y.i - x.i AS period, x.i FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.g = y.g AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
        s AS (SELECT doc_id, period, min(i) AS start, count(*) + 4 + period AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, period ORDER BY i) AS part FROM e) GROUP BY doc_id, period, part HAVING count(*) + 4 + period >= greatest(6, 4 * period)),
        r AS (SELECT * FROM s QUALIFY period = min(period) OVER (PARTITION BY doc_id, start, length)),
        m AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY 1),
        b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
        z AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
        c AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM k ANTI JOIN z USING (doc_id, i) GROUP BY 1)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM d LEFT JOIN m USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op13_lexical_search": f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term FROM documents),
        i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term FROM benchmark),
        d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1), a AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM d),
        f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY 1, 2),
        w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, a GROUP BY term, docs),
        p AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // total))) AS part FROM f JOIN d USING (doc_id) JOIN w USING (term), a),
        s AS (SELECT item_id, doc_id, sum(c * part)::BIGINT AS score FROM (SELECT item_id, term, count(*) AS c FROM i GROUP BY 1, 2) JOIN p USING (term) GROUP BY 1, 2)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10""",
}
