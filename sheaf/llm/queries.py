"""The queries opN_<name> of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, clusters, divergence, langid, neardup, packing, quality, secrets, suffix, topk, warc
from .common import scratch_path, table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scanned = secrets.scan_secrets(docs, secrets.train_scanner(docs), ["doc_id"])
    spans = F.col("secret_spans")
    of = lambda *kinds: F.filter(spans, lambda s: s["kind"].isin(*kinds))
    written = lambda found: F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return scanned.select("doc_id", *counts, F.sha2(written(of("assign", "access", "hex")), 256).alias("base_sha256"), written(spans).alias("spans"), F.size(of("network")).cast("long").alias("n_network"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_conversations(turns))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep_ids=False)


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model, ["doc_id"])
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), neardup.NearDupConfig(words=2, percent=80))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path, keep_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "digest_ok")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.described(*clusters.cluster_vectors(table(spark, sf_dir, "embeddings")))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = langid.identify_languages(docs, langid.train_languages(docs), ["doc_id"])
    return told.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secrets, op2_chat_format, op3_bpe, op4_exact_top_k, op5_packing, op6_quality, op7_near_duplicates, op8_neighbours, op9_suffix_dedup, op10_warc, op11_centroids, op12_language_id, op13_source_divergence)}

#: base32's letters.
SQL_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1, 1)), '')"



def _rounds_of_means(rounds: int) -> str:
    """Assignments a0, a1, ... to centroids c0, c1, ... as the steps of one WITH."""
    out = []
    for i in range(rounds + 1):
        out.append(f"""a{i} AS (SELECT row, vec_id, v, arg_min(c, (d, c))::INT AS cluster, min(d) AS distance FROM (SELECT row, vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{i}) GROUP BY ALL)""")
        if i < rounds:
            out.append(f"""s{i} AS (SELECT cluster, list(t ORDER BY i) AS m FROM (SELECT cluster, i, floor(sum(v[i]) / count(*)) AS t FROM a{i}, range(1, 65) AS r(i) GROUP BY cluster, i) GROUP BY cluster)""")
            out.append(f"""c{i + 1} AS (SELECT c, coalesce(s.m, o.m) AS m FROM c{i} AS o LEFT JOIN s{i} AS s ON s.cluster = o.c)""")
    return ",\n".join(out).replace("GROUP BY ALL", "GROUP BY row, vec_id, v")


ORACLE_SQL: dict[str, str] = {
    "op2_chat_format": r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', chr(92) || '### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok'),
o AS (SELECT *, lag(role) OVER w AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
f AS (SELECT *, CASE role WHEN 'system' THEN before IS NULL WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant') WHEN 'assistant' THEN before IS NOT DISTINCT FROM 'user' ELSE false END AS fine,
 4 + CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 ELSE 1 + length(role) END + 2 + length(text) + len(regexp_extract_all(text, '\\|### |</turn>')) + 7 AS chars FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars, bool_and(fine) AND max(role) FILTER (back = 1) = 'assistant' AS valid FROM f GROUP BY conv_id""",
    "op4_exact_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM p QUALIFY rank <= 20""",
    "op7_near_duplicates": r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s), f AS (SELECT x, count(*) AS times FROM e GROUP BY x),
r AS (SELECT doc_id, n, x, row_number() OVER (PARTITION BY doc_id ORDER BY times, x) AS place FROM e JOIN f USING (x)),
p AS (SELECT doc_id, n, x FROM r WHERE place <= n - (80 * n + 99) // 100 + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p AS a JOIN p AS b ON a.x = b.x AND a.doc_id < b.doc_id WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
l AS (SELECT a, b FROM c JOIN s AS sa ON sa.doc_id = a JOIN s AS sb ON sb.doc_id = b WHERE 100 * len(list_intersect(sa.sh, sb.sh)) >= 80 * (len(sa.sh) + len(sb.sh) - len(list_intersect(sa.sh, sb.sh)))),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t AS (WITH RECURSIVE reach(a, b) AS (SELECT a, b FROM g UNION SELECT reach.a, g.b FROM reach JOIN g ON reach.b = g.a) SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(low, doc_id)) AS kept FROM s LEFT JOIN t ON a = doc_id""",
    "op9_suffix_dedup": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
c AS (SELECT doc_id, 1024 * p AS base, substr(h, 2048 * p + 1, 2146) AS piece FROM d, unnest(range((n + 1023) // 1024)) AS u(p)),
w AS (SELECT doc_id, base + i AS place, substr(piece, 2 * i + 1, 100) AS s FROM c, unnest(range(greatest(0, least(1024, length(piece) // 2 - 49)))) AS u(i)),
m AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, place, CASE WHEN place <= lag(place) OVER (PARTITION BY doc_id ORDER BY place) + 50 THEN 0 ELSE 1 END AS new FROM w JOIN m USING (s) WHERE doc_id > low),
i AS (SELECT doc_id, sum(new) OVER (PARTITION BY doc_id ORDER BY place) AS run, place FROM r),
k AS (SELECT doc_id, min(place) AS low, max(place) + 50 AS high FROM i GROUP BY doc_id, run),
o AS (SELECT *, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS before FROM k),
q AS (SELECT doc_id, sum(high - low)::BIGINT AS gone, count(*) AS spans, max(high) AS last, string_agg(substr(h, 2 * before + 1, 2 * (low - before)), '' ORDER BY low) AS kept FROM o JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN q USING (doc_id)""",
    "op10_warc": f"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages), m AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, url, strlen(body)::BIGINT AS payload_bytes, {SQL_BASE32} AS payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to, CASE WHEN page_id < top THEN NULL ELSE true END AS digest_ok FROM m""",
    "op11_centroids": f"""WITH e AS (SELECT vec_id, embedding AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(x, lambda y: floor(256 * y::DOUBLE)) AS v FROM e),
c0 AS (SELECT (row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v) - 1)::INT AS c, v AS m FROM v QUALIFY c < 40),
{_rounds_of_means(5)},
h AS (SELECT c, sha256(array_to_string(list_transform(m, lambda x: x::BIGINT), ',')) AS digest FROM c5)
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, digest AS centroid_sha256 FROM a5 JOIN h ON c = cluster""",
    "op13_source_divergence": r"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
k AS (SELECT lang, t FROM (SELECT lang, unnest(list_distinct(terms)) AS t FROM d) GROUP BY lang, t HAVING count(*) >= 30), v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang), g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT lang, source, t, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS t FROM d) JOIN k USING (lang, t) GROUP BY lang, source, t),
c AS (SELECT lang, source, t, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN o USING (lang, source, t)),
p AS (SELECT lang, source, t, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM c JOIN v USING (lang)),
l AS (SELECT lang, t, sum(n) AS n FROM c GROUP BY lang, t), q AS (SELECT lang, t, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM l JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
 UNION ALL SELECT lang, source, 'term', t, (p - q)::BIGINT FROM p JOIN q USING (lang, t) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM f QUALIFY part = 'pair' OR rank <= 50""",
}
