"""The registered queries of the text operators: opN_<name>(spark, sf_dir) over the whole given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language_id as L

    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", (fold() == 0).alias("held_out"))
    model = L.train(docs.where(~F.col("held_out")))
    return L.predict(docs, model, keep=["doc_id", "held_out"], with_spans=False)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir), words=2, percent=80)


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .order_minhash import edited_likeness

    return edited_likeness(documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentence_spans import remove_repeats

    return remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), count="chars_removed")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ball_tree import quantised, top_k

    return top_k(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), every=20, k=20)


def op6_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_fm as Q

    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold() != 0)
    model = Q.train(docs, labels, metadata=["n_chars"])
    scored = Q.score(docs, model, metadata=["n_chars"], keep=["doc_id", (fold() == 0).alias("held_out")])
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .context_mixing import score

    out = score(documents(spark, sf_dir), fold() != 1)
    return out.select("doc_id", (~F.col("training")).alias("held_out"), *out.columns[2:])


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secret_scan as S

    found = S.scan(documents(spark, sf_dir).select("doc_id", "text"))
    counts = [S.count_kind(F.col("base_spans"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(S.written(F.col("base_spans")), 256).alias("base_sha256"), S.written(F.col("spans")).alias("spans"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), length=2048)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import byte_bpe as B

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ids = B.encode(documents(spark, sf_dir).select("doc_id", "text"), path, pattern).drop("text")
    both = B.decode(ids, path, pattern)
    digits = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import merkle as M

    docs = documents(spark, sf_dir)
    values, text = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], F.col("text")
    tampered = F.when((fold(n=2) == 0) & F.contains(text, F.lit("\n")), M.leaf(*values, F.replace(text, F.lit("\n"), F.lit(""))))
    leaves = docs.select(F.col("source").alias("g"), "doc_id", M.leaf(*values, text).alias("h"), tampered.alias("tampered"))
    p = M.proofs(leaves, ["doc_id"], ["doc_id", "tampered"])
    p = p.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", M.siblings("path").alias("proof_sha256"), M.fold(F.coalesce("tampered", "h"), "path").alias("folded_root"))
    return p.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import prefix_bpe as B

    path = public_tokenizers.path("word_bpe_49k.json")
    both = B.decode(B.encode(documents(spark, sf_dir).select("doc_id", "text"), path).drop("text"), path)
    digits = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import token_alignment as A

    paths = [public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    out = A.measures(documents(spark, sf_dir).select("doc_id", "text"), *paths, digest=F.sha2("groups", 256))
    return out.withColumnRenamed("groups_digest", "groups_sha256")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_minhash_near_dedup, op3_order_minhash, op4_substring_dedup, op5_exact_top_k, op6_quality_fm, op7_context_mixing, op8_secret_scan, op9_best_fit_packing, op10_byte_bpe, op11_merkle_manifest, op12_prefix_bpe, op13_token_alignment)}
ORACLE_SQL: dict[str, str] = {
    "op2_minhash_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
t AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(a, b) AS (SELECT a, b FROM t UNION SELECT r.a, t.b FROM r JOIN t ON t.a = r.b),
c AS (SELECT a, min(b) AS m FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id""",
    "op5_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_merkle_manifest": """
WITH RECURSIVE d AS (SELECT *, [doc_id::VARCHAR, source, lang, n_chars::VARCHAR] AS v, list_reduce(
  list_concat([4294967295::BIGINT], list_transform(list_filter(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: c <> ''), lambda c: ascii(c)::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))) AS crc FROM documents),
e AS (SELECT *, list_aggregate(list_transform(v, lambda x: coalesce(strlen(x) || ':' || x, '-')), 'string_agg', '') AS head, replace(text, chr(10), '') AS cut FROM d),
f AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) AS other, xor(crc, 4294967295) % 2 = 0 AS tampered FROM e),
g AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM f),
t(source, l, i, n, h) AS (SELECT source, 0, i, n, leaf FROM g UNION ALL
  SELECT source, l + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY source, l, i // 3, (n + 2) // 3),
s AS (SELECT source, l AS height, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u(l, i, n, h) AS (SELECT 0, i, n, subroot FROM s UNION ALL SELECT l + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY l, i // 3, (n + 2) // 3),
k AS (SELECT g.*, s.subroot, s.i AS si, s.height, (SELECT h FROM u WHERE n = 1) AS root, (SELECT max(l) FROM u) AS tops, row_number() OVER () AS id FROM g JOIN s ON g.source IS NOT DISTINCT FROM s.source),
a AS (SELECT id, i AS p, unnest(range(height)) AS l, FALSE AS up, source FROM k UNION ALL SELECT id, si, unnest(range(tops)), TRUE, NULL FROM k),
b AS (SELECT id, l, up, source, (p // (3 ** l)::BIGINT) AS q FROM a),
m AS (SELECT source, FALSE AS up, l, i, h FROM t UNION ALL SELECT NULL, TRUE, l, i, h FROM u),
w AS (SELECT b.id, b.up, b.l, coalesce(string_agg(h, '' ORDER BY m.i) FILTER (m.i < q), '') AS x, coalesce(string_agg(h, '' ORDER BY m.i) FILTER (m.i > q), '') AS y
      FROM b JOIN m ON b.up = m.up AND b.l = m.l AND b.source IS NOT DISTINCT FROM m.source AND m.i // 3 = q // 3 GROUP BY ALL),
z AS (SELECT id, list({'x': x, 'y': y} ORDER BY up, l) AS path FROM w GROUP BY id),
r AS (SELECT k.*, list_aggregate(list_transform(coalesce(path, []), lambda o: o.x || o.y), 'string_agg', '') AS sib,
      list_reduce(list_concat([{'x': CASE WHEN tampered THEN other ELSE leaf END, 'y': ''}], coalesce(path, [])), lambda c, o: {'x': sha256(o.x || c.x || o.y), 'y': ''}).x AS folded_root FROM k LEFT JOIN z USING (id))
SELECT doc_id, leaf, subroot, root, sha256(coalesce(sib, '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM r""",
}
