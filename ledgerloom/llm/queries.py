"""The registered queries of the corpus operators, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import iso_media, language_id, lm_score, main_text, minmax_dedup, mixing, packing, periodic_runs, pq_dedup, quality, rtree_negatives, sharding, warc
from .common import SPACE, crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 5) == 0
    net = language_id.train(docs.where(~held_out))
    return language_id.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), net).drop("text")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 5) == 1
    return lm_score.learn_and_score(docs.select("doc_id", held_out.alias("held_out"), "text"), ~F.col("held_out"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_duplicates(table(spark, sf_dir, "documents"), minmax_dedup.DedupParams(shingle=4))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    params = quality.QualityParams()
    model = quality.train(docs, labels.where(crc_mod("doc_id", 4) != 2), params)
    held_out = crc_mod("doc_id", 4) == 2
    return quality.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model, threshold=params.threshold).drop("text")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    probed = iso_media.probe(iso_media.store(docs).drop("text"))
    ranges = F.crc32(F.to_json("keyframes").cast("binary"))
    feature = F.format_string("codec=%s;duration=%.2f;frames=%d;keyframes=%d;ranges=%08x", F.trim("codec"), "duration_s", "n_frames", F.size("keyframes"), ranges)
    return probed.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "media_error")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mixing.decide(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    rows = chosen.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), main_text.standard_model())
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def looped_text(key: str = "doc_id", text: str = "text") -> Column:
    """The text; of every tenth document by crc32 of its id, the words from some place on repeat their first few."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.col(text), SPACE, -1), lambda w: w != "")
    n = F.size(words).cast("long")
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    looped = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")
    return F.when((h % 10 == 0) & (n > 0), looped).otherwise(F.col(text))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", looped_text().alias("text"))
    found = periodic_runs.find_runs(docs, periodic_runs.RunParams(least_exponent=4, least_length=6))
    best = periodic_runs.strongest(F.col("runs"))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "_best.start", "_best.length", "_best.period", F.floor(F.lit(1000) * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


def whole_components(vector: str) -> Column:
    """floor(256 * x) of each component, as doubles, in which every floor is exact."""

    def whole(x: Column) -> Column:
        wide = F.lit(256.0) * x.cast("double")
        return F.when(F.abs(wide) < float(1 << 53), F.floor(wide).cast("double")).otherwise(wide)

    return F.transform(F.col(vector), whole)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), whole_components("embedding").alias("embedding"))
    return rtree_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_lm_score, op3_minhash_dedup, op4_sharding, op5_embedding_dedup, op6_quality_classifier, op7_media_columns, op8_mixing, op9_packing, op10_warc, op11_main_text, op12_periodic_runs, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {
        "op10_warc": """
            WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
                 d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
                 m AS (SELECT payload_digest, min(page_id) AS first_page FROM d GROUP BY 1)
            SELECT page_id, payload_bytes, payload_digest,
                   CASE WHEN payload_bytes >= 100 AND first_page <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN payload_bytes >= 100 AND first_page <> page_id THEN first_page END AS refers_to
            FROM d JOIN m USING (payload_digest)""",
        "op12_periodic_runs": """
            WITH RECURSIVE
            ids AS (SELECT DISTINCT doc_id, encode(doc_id::VARCHAR) AS b FROM documents WHERE doc_id IS NOT NULL),
            crc AS (  -- crc32 bit by bit: k counts bits, at the first of a byte the byte goes in
                SELECT doc_id, b, 0 AS k, 4294967295::BIGINT AS c FROM ids
                UNION ALL
                SELECT doc_id, b, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END
                FROM (SELECT doc_id, b, k, CASE WHEN k % 8 = 0 THEN xor(c, ascii(decode(array_slice(b, k // 8 + 1, k // 8 + 1)))::BIGINT) ELSE c END AS v FROM crc WHERE k < 8 * octet_length(b))
            ),
            h AS (SELECT doc_id, xor(c, 4294967295) AS h FROM crc WHERE k = 8 * octet_length(b)),
            d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
            e AS (SELECT r, d.doc_id, w, len(w) AS n, coalesce(h, 1) AS h, coalesce(h, 1) // 10 AS g FROM d LEFT JOIN h USING (doc_id)),
            f AS (SELECT *, CASE WHEN n > 0 AND h % 10 = 0 THEN g % n END AS a FROM e),
            x AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM f),
            t AS (SELECT r, n, i, CASE WHEN i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word FROM (SELECT *, unnest(range(n)) AS i FROM x)),
            m AS (SELECT l.r, l.i, k.i - l.i AS q FROM t l JOIN t k ON l.r = k.r AND l.word = k.word AND k.i > l.i AND 4 * (k.i - l.i) <= l.n),
            s AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM m),
            p AS (SELECT r, q, min(i) AS a, count(*) + q AS len FROM s GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
            runs AS (SELECT r, a, len, min(q) AS q FROM p GROUP BY r, a, len),
            best AS (SELECT r, count(*) AS n_runs, sha256(string_agg(a || ',' || len || ',' || q || chr(10), '' ORDER BY a, q)) AS runs_sha256,
                            arg_min({'start': a, 'length': len, 'period': q}, {'x': -(len::DECIMAL(38, 18) / q), 'a': a, 'q': q}) AS b FROM runs GROUP BY r),
            kept AS (SELECT t.r, t.i, t.word FROM t WHERE NOT EXISTS (SELECT 1 FROM runs WHERE runs.r = t.r AND t.i >= runs.a + runs.q AND t.i < runs.a + runs.len)),
            text AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS c FROM kept GROUP BY r)
            SELECT x.doc_id, coalesce(n_runs, 0) AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period,
                   (1000 * b.length // b.period)::BIGINT AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
            FROM x LEFT JOIN best USING (r) LEFT JOIN text USING (r)""",
        "op13_hard_negatives": """
            WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
                       FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
                 v AS (SELECT vec_id, (min({'label': label, 'v': v})).label AS label, (min({'label': label, 'v': v})).v AS v FROM r GROUP BY vec_id),
                 s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
                       FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
                 p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
                 n AS (SELECT p.anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS rank
                       FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
            SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
    }
