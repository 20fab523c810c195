"""The registered queries of this subpackage, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_trees, common, decontaminate, embed_dedup, extendible_sharding, hyperminhash, importance_resampling, language_mixture, license_scan, packing, pii_crf, rule_quality, token_counts, yinyang


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embed_dedup.near_vectors(_table(spark, sf_dir, "embeddings"), least=0.98)
    return found.withColumnRenamed("vec_key", "vec_id")


def op2_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    done = chat_trees.format_trees(chat_trees.threads(turns.unionByName(extra)))
    back, loss = chat_trees.read_back(F.col("formatted")), chat_trees.loss_text(F.col("segments"))
    done = done.select(F.col("conv").alias("conv_id"), back.alias("turns"), loss.alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"doc_key": "doc_id", "item_key": "item_id"})


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select(F.col("key").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(F.col("doc_key").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", F.base64("ids").alias("ids_base64"))


def op6_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_crf.find(_table(spark, sf_dir, "documents"))
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    counts = [count(kind).alias(f"n_{kind}") for kind in pii_crf.KINDS]
    n_found = F.size("spans").cast("long").alias("n_found")
    return found.select(F.col("doc_key").alias("doc_id"), *counts, F.sha2(shown("base"), 256).alias("base_sha256"), shown("spans").alias("spans"), n_found)


#: Bytes of text in a shard.
SHARD_BYTES = 64 << 10


def op7_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = extendible_sharding.shard(_table(spark, sf_dir, "documents"), SHARD_BYTES)
    return placed.select(F.col("doc_key").alias("doc_id"), "n_bytes", "shard_id", F.col("depth").cast("long").alias("depth"), "shard_bytes", "shard_docs")


def _fold(folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_mixture.learn(docs.where(_fold(3) != 1))
    found = language_mixture.detect(docs.select("doc_id", "text"), model).withColumnRenamed("doc_key", "doc_id")
    return found.select("doc_id", F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_hyperminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hyperminhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)
    return found.withColumnRenamed("doc_key", "doc_id")


def op10_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").where(_fold(5) != 0).select(F.col("doc_id").alias("doc_key"), F.col("quality").alias("label"))
    scored = rule_quality.score_quality(_table(spark, sf_dir, "documents").select("doc_id", "text"), labels).withColumnRenamed("doc_key", "doc_id")
    return scored.select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance_resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc_key").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_yinyang_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, centroids = yinyang.cluster(_table(spark, sf_dir, "embeddings"))
    sums = placed.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # a row a cluster
    of = {r.cluster: r.cluster_inertia for r in sums}
    rows = [(k, of[k], sum(of.values()), ",".join(map(str, c))) for k, c in enumerate(centroids.tolist()) if k in of]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, listed string")
    about = about.select("cluster", "cluster_inertia", "inertia", F.sha2(F.col("listed").cast("binary"), 256).alias("centroid_sha256"))
    return placed.join(F.broadcast(about), "cluster").select(F.col("vec_key").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_table(spark, sf_dir, "documents"))
    joined = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return found.select(F.col("doc_key").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", *joined, "score")


_OPERATORS = (
    op1_embedding_dedup, op2_chat_trees, op3_decontaminate, op4_token_counts, op5_packing, op6_pii_crf, op7_extendible_sharding,
    op8_language_mixture, op9_hyperminhash_dedup, op10_rule_quality, op11_importance_resampling, op12_yinyang_clusters, op13_license_scan,
)


def queries() -> dict:
    return {q.__name__: q for q in _OPERATORS}


_OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.vec_id)::BIGINT AS n_links, c.m AS component_id, v.vec_id = c.m AS kept
FROM v JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) c ON c.a = v.vec_id"""

_OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>' || role || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""

#: Repeated ids are parted by 20 further bits of a row's position, which SQL doesn't know: ids are unique here.
_OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
    ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:10])::BIGINT AS code FROM documents),
tree AS (
  SELECT k AS depth, code >> (40 - k)::BIGINT AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_docs
  FROM d, range(0, 41) r(k) GROUP BY 1, 2),
leaf AS (
  SELECT d.doc_id, d.n_bytes, min(depth) AS depth FROM d JOIN tree ON tree.prefix = d.code >> (40 - depth)::BIGINT
  WHERE shard_bytes <= {SHARD_BYTES} OR shard_docs = 1 GROUP BY d.doc_id, d.n_bytes)
SELECT d.doc_id, d.n_bytes, 'shard-' || right(lpad(bin(tree.prefix), 60, '0'), leaf.depth::INT) AS shard_id,
  leaf.depth::BIGINT AS depth, shard_bytes, shard_docs
FROM d JOIN leaf ON leaf.doc_id = d.doc_id JOIN tree ON tree.depth = leaf.depth AND tree.prefix = d.code >> (40 - leaf.depth)::BIGINT"""

_OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM s),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.m AS component_id, s.doc_id = c.m AS kept
FROM s JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) c ON c.a = s.doc_id"""


#: crc32 is linear, so the checksum of a run is the xor of what each byte gives by its value and distance from the end.
_OP11_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, text FROM documents UNION ALL SELECT NULL, text FROM benchmark)),
f AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
u AS (SELECT f, encode(f) AS b, octet_length(encode(f)) AS n FROM (SELECT DISTINCT f FROM f)),
one AS (
  SELECT i AS byte, i AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM one WHERE k < 8),
t AS MATERIALIZED (SELECT byte, c FROM one WHERE k = 8),
far AS (
  SELECT byte, c, 0 AS d FROM t UNION ALL SELECT 256, 4294967295, 0
  UNION ALL SELECT far.byte, xor(far.c >> 8, t.c), d + 1 FROM far JOIN t ON t.byte = far.c & 255 WHERE d < (SELECT max(n) FROM u)),
crc AS (
  SELECT p.f, xor(xor(bit_xor(far.c), any_value(z.c)), 4294967295) % 10000 AS bucket
  FROM (SELECT f, n, n - i AS d, ('0x' || substr(hex(b), 2 * i - 1, 2))::BIGINT AS byte FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM u)) p
  JOIN far ON far.byte = p.byte AND far.d = p.d JOIN far z ON z.byte = 256 AND z.d = p.n GROUP BY p.f),
m AS MATERIALIZED (SELECT doc_id, bucket, count(*) AS n FROM f JOIN crc USING (f) GROUP BY 1, 2),
g AS (
  SELECT r.bucket, coalesce(sum(n) FILTER (WHERE doc_id IS NOT NULL), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE doc_id IS NULL), 0)::DOUBLE AS t
  FROM range(10000) r(bucket) LEFT JOIN m USING (bucket) GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM g) + 10000)) / ((s + 1) * ((SELECT sum(t) FROM g) + 10000)))) AS g FROM g),
p AS (SELECT doc_id, sum(n) AS n, sum(n * g) AS x FROM m JOIN gain USING (bucket) WHERE doc_id IS NOT NULL GROUP BY 1),
q AS (
  SELECT w.doc_id, len(w.w) AS words, coalesce(p.n, 0)::BIGINT AS n_features, coalesce(floor(x / p.n), 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || sha256('7:' || w.doc_id)[1:8])::BIGINT + 0.5) / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM w LEFT JOIN p USING (doc_id) WHERE w.doc_id IS NOT NULL),
r AS (SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY words >= 20 ORDER BY weight + noise DESC, doc_id) AS i, count(*) FILTER (WHERE words >= 20) OVER () AS n FROM q)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND i <= 25 * n // 100 THEN i END AS rank FROM r"""


def _op12_sql(rounds: int = yinyang.ROUNDS) -> str:
    """One step of plain k-means a round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, v, min(struct_pack(d := list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, k := k)) AS best
  FROM kept, c{r} GROUP BY vec_id, v)""")
        if r < rounds:
            steps.append(f"""m{r} AS (
  SELECT k, list(x ORDER BY i) AS c FROM (
    SELECT best.k AS k, i, floor(sum(v[i]) / count(*))::BIGINT AS x FROM a{r}, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (k))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, v AS c FROM kept ORDER BY sha256('3:' || vec_id) LIMIT 8),
{", ".join(steps)}
SELECT vec_id, best.k::INTEGER AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.k)::BIGINT AS cluster_inertia,
  sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON k = best.k"""


def _op13_sql() -> str:
    """Every block against every template of its width, without filters."""
    listed = lambda text: "[" + ", ".join(f"'{w}'" for w in text.split()) + "]"
    templates = ", ".join(
        f"('{t.label}', list_distinct({listed(t.text)}), {listed(t.named)}, {license_scan.need_of(t, license_scan.PERCENT)}, {license_scan.width_of(t)})" for t in license_scan.TEMPLATES
    )
    phrases = ", ".join(f"('{label}', {listed(phrase)})" for phrase, label in license_scan.PHRASES.items())
    return rf"""
WITH w AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
phrase(label, p) AS (VALUES {phrases}),
places AS (
  SELECT doc_id, label, i - 1 AS place FROM (SELECT doc_id, w, label, p, unnest(range(1, len(w) - len(p) + 2)) AS i FROM w, phrase WHERE list_has_all(w, p))
  WHERE w[i:i + len(p) - 1] = p),
base AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM places GROUP BY 1),
template(label, words, named, need, width) AS (VALUES {templates}),
found AS (
  SELECT doc_id, label, len(list_intersect(words, w[s + 1:s + width])) AS held, need, len(words) AS size
  FROM (SELECT doc_id, w, t.*, unnest(range(0, len(w), width // 2)) AS s FROM w, template t WHERE list_has_all(w, named))
  WHERE list_has_all(w[s + 1:s + width], named)),
more AS (SELECT doc_id, list_distinct(list(label)) AS labels, max(held / size) AS best FROM found WHERE held >= need GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base.labels, more.labels))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_dedup": _OP1_SQL, "op2_chat_trees": _OP2_SQL, "op7_extendible_sharding": _OP7_SQL, "op9_hyperminhash_dedup": _OP9_SQL, "op11_importance_resampling": _OP11_SQL, "op12_yinyang_clusters": _op12_sql(), "op13_license_scan": _op13_sql()}
