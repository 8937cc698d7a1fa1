"""The registered queries of this subpackage: thin digests over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memjobs.llm import conversations, decontaminate, language, lexical, media, minhash, mixing, neighbours, secrets, substring, tokens, toxicity, urls

# Fixed values: the URL rules that the query is asked to judge by.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(_table(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), VOCABULARY)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.store_texts(_table(spark, sf_dir, "documents")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_damaged(_table(spark, sf_dir, "conversations"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_minhash_dedup, op3_substring_dedup, op4_url_filters, op5_token_counts,
        op6_decontamination, op7_secret_scans, op8_media_columns, op9_language_id, op10_toxicity,
        op11_lexical_search, op12_conversation_repair, op13_nearest_neighbours,
    )
}  # fmt: skip

_WORD = r"[^\x20\x09-\x0D]+"
ORACLES = {
    "op1_mixing": rf"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS digest FROM documents),
a AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s GROUP BY source),
b AS (SELECT *, [5, 2, 1][((rank - 1) % 3 + 1)::INT] AS weight FROM a),
c AS (SELECT *, (sum(source_size) OVER () - (sum(3 * source_size) OVER o - 3 * source_size))::DOUBLE / (sum(weight) OVER () - (sum(weight) OVER o - weight))::DOUBLE AS level
      FROM b WINDOW o AS (ORDER BY source_size * 3 / weight, rank ROWS UNBOUNDED PRECEDING)),
t AS (SELECT source, source_size, rank, least((3 * source_size)::DOUBLE, max(level) OVER () * weight) AS target FROM c),
p AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY digest, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS position FROM s WHERE size > 0),
k AS (SELECT rank, position, target, floor(target)::BIGINT AS cut, n * source_size + position AS a, n * source_size + position + size AS b
      FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source CROSS JOIN range(3) AS r(n) WHERE n * source_size + position < target),
q AS (SELECT rank, position, target, a, CASE WHEN a < cut AND cut < b THEN cut ELSE b END AS b FROM k
      UNION ALL SELECT rank, position, target, cut, b FROM k WHERE a < cut AND cut < b),
r AS (SELECT rank, position, b - a AS words, sum(b - a) OVER (ORDER BY b / target, rank, b ROWS UNBOUNDED PRECEDING) AS running FROM q),
u AS (SELECT rank, position, sum(least(words, greatest(0, (SELECT sum(size) FROM s) - (running - words))))::BIGINT AS taken FROM r GROUP BY ALL)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source LEFT JOIN u USING (rank, position)
UNION ALL SELECT doc_id, size, source_size, target, 0 FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source WHERE size = 0""",
    "op3_substring_dedup": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
first AS (SELECT t, min(doc_id) AS f FROM win GROUP BY t),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (t) WHERE f < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS k FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN n ON d.doc_id = n.doc_id""",
    "op4_url_filters": r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT page_id, max_by(rh || rp, length(rh || rp)) AS rule, max_by(v, length(rh || rp)) AS v
      FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN m ON u.page_id = m.page_id""",
    "op11_lexical_search": r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS big_n, sum(len(w))::BIGINT AS big_l FROM t),
m AS (SELECT doc_id, r, w, (25 + (75 * len(w) * big_n) // big_l)::BIGINT AS m FROM t, s WHERE len(w) > 0),
p AS (SELECT doc_id, r, m, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, r, m, unnest(w) AS term FROM m) GROUP BY ALL),
d AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, s GROUP BY term, big_n),
q AS (SELECT item_id, term, count(*)::BIGINT AS q FROM (SELECT DISTINCT item_id, text FROM benchmark) b,
      unnest(regexp_extract_all(translate(coalesce(b.text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS u(term) GROUP BY ALL),
c AS (SELECT item_id, doc_id, r, sum(q * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN d USING (term) JOIN p USING (term) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10""",
    "op12_conversation_repair": r"""
WITH RECURSIVE byte_sums AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(b))),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM conversations, byte_sums),
damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM keyed, range(2) n(i) WHERE kind <> 0 AND (i = 0 OR kind = 3)),
placed AS (SELECT *, row_number() OVER o AS i, regexp_extract(text, '([^ 	-])[ 	-]*\z', 1) AS tail, left(role, 1) AS initial, lag(left(role, 1)) OVER o AS before FROM damaged WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
judged AS (SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM judged GROUP BY conv_id),
rows_in AS (SELECT conv_id, i, role, text, fault IN ('blank', 'duplicate') AS broken, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS extra,
  CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 99 END AS from_start, CASE initial WHEN 'u' THEN 2 ELSE 99 END AS from_system, CASE initial WHEN 'a' THEN 3 ELSE 99 END AS from_user, CASE initial WHEN 'u' THEN 2 ELSE 99 END AS from_assistant FROM judged),
-- Costs after each row, from the states nothing, system, user, assistant, backwards.
costs(conv_id, i, c) AS (
  SELECT conv_id, n, [0, 6, 3, 0] FROM sums
  UNION ALL
  SELECT conv_id, i - 1, [least(x[1], x[3] + 3, x[4] + 6), least(x[2], x[3] + 3, x[4] + 6), least(x[3], x[4] + 3), least(x[4], x[3] + 3)] FROM (
    SELECT c.conv_id, c.i, [
      least(c.c[1] + 4, CASE WHEN broken THEN 999999999 ELSE extra + least(c.c[3] + 3, CASE WHEN from_start < 99 THEN c.c[from_start + 1] ELSE 999999999 END) END),
      least(c.c[2] + 4, CASE WHEN broken THEN 999999999 ELSE extra + least(c.c[3] + 3, CASE WHEN from_system < 99 THEN c.c[from_system + 1] ELSE 999999999 END) END),
      least(c.c[3] + 4, CASE WHEN broken THEN 999999999 ELSE extra + least(c.c[4] + 3, CASE WHEN from_user < 99 THEN c.c[from_user + 1] ELSE 999999999 END) END),
      least(c.c[4] + 4, CASE WHEN broken THEN 999999999 ELSE extra + least(c.c[3] + 3, CASE WHEN from_assistant < 99 THEN c.c[from_assistant + 1] ELSE 999999999 END) END)] AS x
    FROM costs c JOIN rows_in r ON c.conv_id IS NOT DISTINCT FROM r.conv_id AND c.i = r.i)),
walk(conv_id, i, s, audit, said) AS (
  SELECT conv_id, 0::BIGINT, 0, '', ''::VARCHAR FROM sums
  UNION ALL
  SELECT conv_id, CASE edit WHEN 'I' THEN i ELSE i + 1 END, CASE edit WHEN 'D' THEN s WHEN 'K' THEN kept ELSE onward END, audit || edit,
    CASE edit WHEN 'D' THEN said ELSE said || chr(10) || CASE edit WHEN 'K' THEN role WHEN 'I' THEN CASE onward WHEN 2 THEN 'user' ELSE 'assistant' END ELSE CASE onward WHEN 2 THEN 'user' ELSE 'assistant' END END || ':' || CASE edit WHEN 'I' THEN '' ELSE text END END
  FROM (SELECT w.*, r.role, r.text, o.onward, k.kept,
      CASE WHEN r.i IS NOT NULL AND after.c[w.s + 1] + 4 = now.c[w.s + 1] THEN 'D' WHEN now.c[o.onward + 1] + 3 = now.c[w.s + 1] THEN 'I'
           WHEN r.i IS NOT NULL AND NOT r.broken AND k.kept < 99 AND after.c[k.kept + 1] + r.extra = now.c[w.s + 1] THEN 'K' WHEN r.i IS NOT NULL THEN 'R' END AS edit
    FROM walk w JOIN costs now ON w.conv_id IS NOT DISTINCT FROM now.conv_id AND w.i = now.i
    LEFT JOIN rows_in r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND w.i + 1 = r.i
    LEFT JOIN costs after ON w.conv_id IS NOT DISTINCT FROM after.conv_id AND w.i + 1 = after.i,
    LATERAL (SELECT CASE w.s WHEN 2 THEN 3 ELSE 2 END AS onward) o, LATERAL (SELECT CASE w.s WHEN 0 THEN r.from_start WHEN 1 THEN r.from_system WHEN 2 THEN r.from_user ELSE r.from_assistant END AS kept) k)
  WHERE edit IS NOT NULL),
ended AS (SELECT conv_id, max_by(audit, length(audit)) AS audit, max_by(said, length(audit)) AS said FROM walk GROUP BY conv_id),
done AS (SELECT sums.*, c.c[1]::BIGINT AS cost, audit, sha256(said[2:]) AS repaired_sha256 FROM sums JOIN costs c ON sums.conv_id IS NOT DISTINCT FROM c.conv_id AND c.i = 0 JOIN ended e ON sums.conv_id IS NOT DISTINCT FROM e.conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN done ON a.conv_id IS NOT DISTINCT FROM done.conv_id""",
}
