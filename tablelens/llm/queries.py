"""The registered queries of this subpackage: thin digests of the operators' outputs, with DuckDB SQL
where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.llm.common import table
from tablelens.session import scratch_path

QUERIES: dict = {}


def register(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return put


def tokenizer(name: str) -> str:
    """The vocabulary file of a public tokenizer."""
    import public_tokenizers
    return public_tokenizers.path(name)


#: The contract's list: (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@register("op2_url_filter", """
WITH r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                 ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(rh, rp, rv)),
u AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^?#]*') AS stem FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             substr(stem, length(raw) + 1) AS path FROM h),
m AS (SELECT p.*, rh || rp AS rule, rv, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS k
      FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM m WHERE k = 1
""")
def op2(spark, sf_dir):
    from tablelens.llm.url_filter import filter_urls
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


@register("op3_mix_sources")
def op3(spark, sf_dir):
    from tablelens.llm.mix_sources import mix
    return mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@register("op4_simhash_dedup")
def op4(spark, sf_dir):
    from tablelens.llm.simhash import near_duplicates
    out = near_duplicates(table(spark, sf_dir, "documents"), words=3, bits=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op6_token_counts")
def op6(spark, sf_dir):
    from tablelens.llm.token_count import count_tokens
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@register("op7_token_files")
def op7(spark, sf_dir):
    from tablelens.llm.token_files import token_files
    out = token_files(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), 2, scratch_path(spark, "token-files"))
    return out.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


@register("op8_bpe")
def op8(spark, sf_dir):
    from tablelens.llm.bpe import round_trip
    return round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@register("op9_suffix_dedup")
def op9(spark, sf_dir):
    from tablelens.llm.suffix_dedup import remove_repeats
    out = remove_repeats(table(spark, sf_dir, "documents"), window=400)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed").cast("long"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
                      F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


#: The chain's order: the tables label two kinds, and junk is told first.
TOXIC_CHAIN = ["low_quality", "toxic"]


def labelled(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


@register("op10_toxicity")
def op10(spark, sf_dir):
    from tablelens.llm.toxicity import toxicity
    out = toxicity(table(spark, sf_dir, "documents"), labelled(spark, sf_dir), TOXIC_CHAIN)
    return out.withColumn("toxic", F.col("p_toxic") >= 0.5)


@register("op5_embedding_dedup", """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
n AS (SELECT row_number() OVER () AS k, vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS size FROM v),
l AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM n a JOIN n b ON a.k <> b.k AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.9),
r(k, root) AS (SELECT k, k FROM n UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.k),
c AS (SELECT r.k, min(o.vec_id) AS component_id FROM r JOIN n AS o ON o.k = r.root GROUP BY r.k),
f AS (SELECT n.vec_id, (SELECT count(*) FROM l WHERE l.a = n.k) AS n_links, c.component_id FROM n JOIN c ON c.k = n.k)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM f
UNION ALL SELECT vec_id, 0, vec_id, true FROM embeddings
WHERE NOT coalesce(vec_id IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
                   AND list_bool_or(list_transform(embedding, lambda x: x <> 0)), false)
""")
def op5(spark, sf_dir):
    from tablelens.llm.embed_dedup import embedding_duplicates
    return embedding_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


@register("op1_nearest_neighbours")
def op1(spark, sf_dir):
    from tablelens.llm.ann_projections import nearest
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


@register("op11_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""")
def op11(spark, sf_dir):
    from tablelens.llm.exact_dedup import exact_duplicates
    return exact_duplicates(table(spark, sf_dir, "documents"), stays="largest").withColumnRenamed("sha", "text_sha256")


@register("op12_embedding_whitening")
def op12(spark, sf_dir):
    from tablelens.llm.whitening import whiten
    return whiten(table(spark, sf_dir, "embeddings"), components=4).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


#: CRC-32 of a text's bytes in SQL: a fold over its characters, eight shifts each.
_CRC = ("""xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({}, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)""")


@register("op13_conversation_trie", f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
                  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, max(pos) AS n, c - c % 5 AS base, {_CRC.format('c::VARCHAR')} % 9 AS h FROM t GROUP BY c),
r AS (SELECT k.c, t.pos AS d, t.role, t.text FROM k JOIN t ON t.c = k.base AND t.pos <= k.h
      UNION ALL
      SELECT k.c, coalesce(least(k.h, b.n), 0) + t.pos - k.h, t.role, t.text
      FROM k JOIN t ON t.c = k.c AND t.pos > k.h LEFT JOIN k AS b ON b.c = k.base),
s AS (SELECT c, d, text, sha256(string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d)) AS p FROM r
      UNION ALL SELECT c, 0, '', '' FROM k),
m AS (SELECT s.*, d = max(d) OVER (PARTITION BY c) AS fin, lag(p) OVER (PARTITION BY c ORDER BY d) AS up FROM s),
n AS (SELECT d, p, min(up) AS up, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(octet_length(encode(text))) AS own,
             sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (fin), '')) AS ends FROM m GROUP BY d, p),
f AS (SELECT n.*, (SELECT count(*) FROM n AS x WHERE x.up = n.p AND x.d = n.d + 1) AS n_children FROM n),
w AS (SELECT m.c, m.d, m.p, sum(coalesce(f.own, 0)) OVER tail AS saved, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) OVER tail AS leaves
      FROM m LEFT JOIN f ON f.conv_id = m.c AND f.d = m.d
      WINDOW tail AS (PARTITION BY m.c ORDER BY m.d DESC)),
g AS (SELECT d, p, sum(saved)::BIGINT AS saved_tokens, sum(leaves)::BIGINT AS n_leaves FROM w GROUP BY d, p)
SELECT f.conv_id, f.d::BIGINT AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, g.n_leaves, g.saved_tokens, f.ends AS ends_sha256
FROM f JOIN g ON g.d = f.d AND g.p = f.p LEFT JOIN n AS u ON u.d = f.d - 1 AND u.p = f.up
""")
def op13(spark, sf_dir):
    from tablelens.llm.conversation_trie import prefix_trie
    return prefix_trie(table(spark, sf_dir, "conversations")).drop("turn_conv", "turn_pos")
