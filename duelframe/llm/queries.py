"""One registered query per operator, over whole tables, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .chat_format import format_windows, read_turns
from .conversation_repair import inject_faults, repair_conversations, whole_digests
from .exact_dedup import group_copies
from .line_dedup import drop_site_lines
from .mixing import mix_plan
from .ngram_join import similar_documents
from .quality import DECISION, classify, held_out
from .secret_scan import BASE_KINDS, secret_spans
from .tables import table
from .token_alignment import align_tokens
from .topk import top_k
from .toxicity import DECISION as TOXIC
from .toxicity import detect_toxicity
from .warc import crawl_records, header_lines, resolve_revisits

#: Vocabulary file of op7 and of the pipeline's last stage.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Second tokenizer of op11.
PIECES = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def token_digests(spark: SparkSession, docs: DataFrame, path: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of whole texts, and the ids themselves if wanted."""
    found = docs.select("doc_id", bpe.digests(spark, F.col("text"), path, with_ids).alias("t"))
    return found.select("doc_id", "t.n_tokens", "t.ids_sha256", "t.decoded_sha256", *(["t.ids"] if with_ids else []))


@register("op7_bpe")
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(spark, table(spark, sf_dir, "documents"))


@register("op1_ngram_join", r"""
WITH RECURSIVE listed AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w FROM documents),
tokens AS MATERIALIZED (
  SELECT DISTINCT rid, token FROM (
    SELECT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS token FROM listed)),
sized AS (SELECT rid, count(*) AS n FROM tokens GROUP BY rid),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.rid AS a, y.rid AS b, count(*) AS i FROM tokens x JOIN tokens y USING (token)
                    WHERE x.rid <> y.rid GROUP BY ALL) p
  JOIN sized m ON m.rid = a JOIN sized n ON n.rid = b WHERE 100 * i >= 80 * (m.n + n.n - i)),
reach AS (SELECT rid AS a, rid AS b FROM listed UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, min(e.doc_id) AS component_id
FROM listed d LEFT JOIN sized s USING (rid) JOIN reach ON reach.a = d.rid JOIN listed e ON e.rid = reach.b
GROUP BY d.rid, d.doc_id, s.n""")
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.col("n_tokens").alias("n_shingles"), F.col("component").alias("component_id"))


#: A conversation that quotes the template's control strings, beside those of the table.
QUOTING = r"\### Assistant: </turn> ok"


@register("op2_chat_format", r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
sized AS (
  SELECT *, row_number() OVER w - 1 AS k, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 1 AS tokens,
    14 + length(replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\e'), '### ', '\h'), ': ', '\c'))
       + length(replace(replace(replace(text, '\', '\b'), '</turn>', '\e'), '### ', '\h')) AS chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY k) - tokens AS before FROM sized),
spans AS (
  SELECT *, k = 0 OR (before // 512, tokens > 512) <> lag((before // 512, tokens > 512)) OVER (PARTITION BY conv_id ORDER BY k) AS opens
  FROM summed),
used AS (
  SELECT *, CASE WHEN k = 0 AND role = 'system' THEN 0 ELSE
    CASE WHEN lead(opens) OVER c AND lead(before) OVER c - before <= 256 THEN 1 ELSE 0 END
    + CASE WHEN lead(opens, 2) OVER c AND lead(before, 2) OVER c - before <= 256 THEN 1 ELSE 0 END END AS again
  FROM spans WINDOW c AS (PARTITION BY conv_id ORDER BY k))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(chars * (1 + again)) + coalesce(max(chars) FILTER (k = 0 AND role = 'system'), 0)
    * (count(*) FILTER (opens) - 1))::BIGINT AS formatted_chars
FROM used GROUP BY conv_id""")
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(QUOTING).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionAll(added)
    read = read_turns(format_windows(rows))
    # a digest of a whole conversation needs it in one place; the windows themselves don't
    whole = read.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("first", "turns", "masked"))).alias("windows"),
                                     F.sum("chars").alias("formatted_chars"))
    turns = F.flatten(F.transform("windows", lambda w: w["turns"]))
    masked = F.array_join(F.flatten(F.transform("windows", lambda w: w["masked"])), "")
    lines = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select(F.col("conv").alias("conv_id"), F.size(turns).cast("bigint").alias("n_turns"),
                        F.sha2(lines, 256).alias("turns_sha256"), F.length(masked).cast("bigint").alias("loss_chars"),
                        F.sha2(masked, 256).alias("loss_sha256"), "formatted_chars")


@register("op3_warc_revisit", r"""
WITH seen AS (SELECT page_id AS n, url, length(coalesce(html, '')) AS size, md5(coalesce(html, '')) AS h, sha256(coalesce(html, '')) AS p FROM pages),
fulls AS (
  SELECT 16 * n + v AS id, 100 * n + CASE WHEN n % 8 = 7 AND v = 1 THEN 74 ELSE 37 * v END AS ts, url, n, v::VARCHAR AS v, size, h, p
  FROM seen, (VALUES (0), (1), (2), (3)) x(v) WHERE v <= n % 4
  UNION ALL SELECT 16 * s.n + 4, 100 * (s.n - s.n % 3) + 60 + 5 * (s.n % 3), g.url, s.n, 'm', s.size, s.h, s.p FROM seen s JOIN seen g ON g.n = s.n - s.n % 3 WHERE s.n % 3 <> 0),
old_rows AS (
  SELECT id, ts, url, size, '"' || md5(h || '#' || v) || '"' AS etag, CASE WHEN n % 3 = 1 THEN 'W/' ELSE '' END AS weak, 'day ' || v AS modified, sha256(p || '#' || v) AS payload FROM fulls),
asked AS (
  SELECT 16 * n + 8 + j AS id, 100 * n + ([-5, 74, 90, 1000])[j + 1] AS ts, n, j, n + j AS turn, h, contains(url, '?') AS asks, regexp_replace(url, '#.*$', '') AS plain
  FROM seen, (VALUES (0), (1), (2), (3)) x(j)),
again AS (
  SELECT id, ts, CASE j WHEN 1 THEN regexp_replace(regexp_replace(plain, '^(https://)([^/?#:]+)', '\1\2:443'), '^(http://)([^/?#:]+)', '\1\2:80')
      WHEN 2 THEN upper(regexp_extract(plain, '^([A-Za-z]+://)?([^/?#]*)', 0)) || regexp_replace(plain, '^([A-Za-z]+://)?([^/?#]*)', '') ELSE plain END
      || CASE WHEN asks THEN '&' ELSE '?' END || 'utm_medium=again#part' AS url,
    CASE WHEN turn % 11 <> 0 AND turn % 7 <> 0 THEN '"' || md5(h || '#' || turn % 4) || '"' END AS etag,
    CASE WHEN turn % 11 <> 0 THEN 'day ' || turn % 4 END AS modified FROM asked),
cut AS (
  SELECT id, ts, regexp_replace(CASE WHEN regexp_matches(url, '^(?i)http://') THEN regexp_replace(host, ':80$', '')
      WHEN regexp_matches(url, '^(?i)https://') THEN regexp_replace(host, ':443$', '') ELSE host END, '^www\.', '') AS host,
    regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^?#]*\?([^#]*)', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|gclid|fbclid)(=|$)'))) AS query
  FROM (SELECT *, lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)) AS host
        FROM (SELECT id, ts, url FROM old_rows UNION ALL SELECT id, ts, url FROM again) u)),
named AS (SELECT id, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END
    || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END END AS key FROM cut),
old AS (SELECT f.*, n.key FROM old_rows f JOIN named n USING (id)),
last_old AS (SELECT * FROM old QUALIFY row_number() OVER (PARTITION BY key, ts ORDER BY id DESC) = 1),
found AS (
  SELECT a.id, a.ts, n.key AS url, a.etag, o.id AS response_id, o.ts AS response_ts, o.size, o.payload, o.weak || o.etag AS old_etag, o.modified AS old_modified,
    CASE WHEN o.id IS NULL THEN 'unresolved' WHEN a.etag IS NOT NULL THEN CASE WHEN a.etag = o.etag THEN 'resolved' ELSE 'mismatch' END
      WHEN a.modified IS NOT NULL THEN CASE WHEN a.modified = o.modified THEN 'resolved' ELSE 'mismatch' END ELSE 'unverified' END AS state
  FROM again a JOIN named n USING (id) ASOF LEFT JOIN last_old o ON n.key = o.key AND a.ts > o.ts)
SELECT id, ts, url, state, response_id, response_ts,
  CASE WHEN state IN ('resolved', 'unverified') THEN payload END AS payload,
  CASE WHEN state IN ('resolved', 'unverified') THEN 'cache-control: max-age=600' || chr(10) || 'content-length: ' || size || chr(10)
    || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'etag: ' || coalesce(etag, old_etag) || chr(10)
    || 'last-modified: ' || old_modified END AS headers
FROM found""")
def op3_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(crawl_records(table(spark, sf_dir, "pages")))
    return found.withColumn("headers", header_lines(F.col("headers")))


@register("op8_line_dedup", r"""
WITH cut AS (
  SELECT page_id, lower(coalesce(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), '')) AS host,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(html, ''),
      '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', chr(10), 'g'), '<[^>]*>', chr(10), 'g'), chr(10)),
      lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))), lambda x: x <> '') AS lines FROM pages),
each AS (SELECT host, unnest(list_distinct(lines)) AS line FROM cut),
counts AS (SELECT host, line, count(*) AS n FROM each GROUP BY ALL),
totals AS (SELECT host, count(*) AS pages FROM cut GROUP BY ALL),
often AS (SELECT host, list(line) AS gone FROM counts JOIN totals USING (host) WHERE n >= 3 AND n > 0.1 * pages GROUP BY host),
done AS (SELECT page_id, host, lines, list_filter(lines, lambda x: NOT coalesce(list_contains(gone, x), false)) AS kept
         FROM cut LEFT JOIN often USING (host))
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped,
  sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM done""")
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_site_lines(table(spark, sf_dir, "pages"))
    return done.select("row.page_id", "host", F.size("lines").cast("bigint").alias("n_lines"),
                       (F.size("lines") - F.size("kept")).cast("bigint").alias("n_dropped"),
                       F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"))


@register("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score",
                         (F.col("score") >= DECISION).cast("int").alias("predicted"))


@register("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", secret_spans(F.col("text")).alias("found"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def n(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[n(k) for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("found")).alias("spans"))


@register("op6_topk", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: coalesce(p[1] * p[2], 0))), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored) r
WHERE rank <= 5""")
def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0).withColumnRenamed("found_id", "vec_id")


@register("op9_mixing")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@register("op10_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""")
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_copies(table(spark, sf_dir, "documents"), keep="max").withColumnRenamed("id", "doc_id")


@register("op13_structure_repair", r"""
WITH RECURSIVE coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) % 20 AS code
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM coded, unnest(CASE code WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM damaged),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS copy, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM ordered),
named AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, left(role, 1) AS l,
    CASE WHEN bare = '' THEN 'blank' WHEN copy > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
rows_ AS MATERIALIZED (
  SELECT *, lag(l) OVER (PARTITION BY c ORDER BY k) || l AS pair FROM named),
inserts(p, q, cost, edits) AS (VALUES (0, 0, 0, ''), (0, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 1, 0, ''), (1, 2, 2, 'I'), (1, 3, 4, 'II'),
  (2, 2, 0, ''), (2, 3, 2, 'I'), (3, 3, 0, ''), (3, 2, 2, 'I')),
moves(p, q, cost, edit, needs) AS (VALUES (0, 0, 3, 'D', ''), (1, 1, 3, 'D', ''), (2, 2, 3, 'D', ''), (3, 3, 3, 'D', ''),
  (0, 1, 0, 'K', 's'), (0, 2, 0, 'K', 'u'), (1, 2, 0, 'K', 'u'), (3, 2, 0, 'K', 'u'), (2, 3, 0, 'K', 'a'),
  (0, 2, 2, 'R', ''), (1, 2, 2, 'R', ''), (3, 2, 2, 'R', ''), (2, 3, 2, 'R', '')),
steps AS (SELECT i.p, m.q, i.cost + m.cost AS cost, i.edits || m.edit AS edits, m.edit, m.needs FROM inserts i JOIN moves m ON i.q = m.p),
dp AS (
  SELECT DISTINCT c, 0::BIGINT AS k, 0 AS q, {'cost': 0::BIGINT, 'edits': ''} AS best FROM rows_
  UNION ALL
  SELECT d.c, r.k, s.q, min({'cost': d.best.cost + s.cost + CASE WHEN s.edit <> 'D' AND r.fault = 'truncated' THEN 1 ELSE 0 END,
                             'edits': d.best.edits || s.edits})
  FROM dp d JOIN rows_ r ON r.c = d.c AND r.k = d.k + 1 JOIN steps s ON s.p = d.q
  WHERE s.edit = 'D' OR (r.fault NOT IN ('blank', 'duplicate') AND (s.needs = '' OR s.needs = r.l))
  GROUP BY d.c, r.k, s.q),
ends AS (
  SELECT d.c, min({'cost': d.best.cost + i.cost, 'edits': d.best.edits || i.edits}) AS best
  FROM dp d JOIN (SELECT c, max(k) AS n FROM rows_ GROUP BY c) z ON z.c = d.c AND z.n = d.k JOIN inserts i ON i.p = d.q
  WHERE i.q IN (0, 3) GROUP BY d.c),
edits AS (
  SELECT c, unnest(string_split(best.edits, '')) AS e, generate_subscripts(string_split(best.edits, ''), 1) AS pos FROM ends WHERE best.edits <> ''),
counted AS (
  SELECT *, count(*) FILTER (e <> 'I') OVER w AS k, count(*) FILTER (e <> 'D') OVER w AS n FROM edits WINDOW w AS (PARTITION BY c ORDER BY pos)),
turned AS (
  SELECT x.c, x.pos, x.e, x.n - max(CASE WHEN x.e = 'K' AND r.l = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY x.c) AS n, r.role, r.text
  FROM counted x LEFT JOIN rows_ r ON r.c = x.c AND r.k = x.k AND x.e <> 'I' WHERE x.e <> 'D'),
lines AS (
  SELECT c, string_agg(CASE WHEN e = 'K' THEN role WHEN n % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY pos) AS repaired
  FROM turned GROUP BY c),
stats AS (
  SELECT c, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY c)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.edits, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN stats ON o.conv_id IS NOT DISTINCT FROM stats.conv_id
LEFT JOIN ends ON ends.c = stats.c LEFT JOIN lines ON lines.c = stats.c""")
def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = inject_faults(table(spark, sf_dir, "conversations"))
    return whole_digests(repair_conversations(damaged, absent=F.col("absent"))).withColumnRenamed("conv", "conv_id")


@register("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = align_tokens(table(spark, sf_dir, "documents"), VOCABULARY, PIECES)
    return documents.withColumnRenamed("id", "doc_id")


@register("op12_toxicity")
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = detect_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score",
                         (F.col("score") >= TOXIC).cast("int").alias("predicted"), F.size("hits").alias("n_hits"))
