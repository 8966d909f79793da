"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, decontam, filteraudit, neardup, packing, pii, quality, secrets, sharding, spandedup, turnrepair
from .common import table

SHARD_BYTES = 1 << 20


def _spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _span_digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(_of_kind(F.col("spans"), k)).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(_spans_text(base), 256).alias("base_sha256"), _spans_text(F.col("spans")).alias("spans"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.score_quality(docs, model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _span_digest(pii.find_pii(docs, pii.learn(docs)), pii.BASE)


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("n_tokens")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(own).alias("text"),
    )
    made = chat.format_conversations(turns.unionByName(extra))
    back = made.withColumns({"turns": chat.read_back(F.col("formatted")), "loss": chat.loss_text(F.col("segments"))})
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op6_spandedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of four sentences with fewer than ten words together are no passages (least_words): short repeated exclamations stay.
    remove_repeated_spans(docs, least_words=1) takes every repeated run."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spandedup.remove_repeated_spans(docs).select("doc_id", "n_sentences", "n_removed", "text", "n_run_words")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(secrets.scan_secrets(table(spark, sf_dir, "documents")), secrets.KINDS[:3])


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(ann.build_index(vectors), vectors.where(F.col("vec_id") % 50 == 0))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign_shards(docs, SHARD_BYTES).select("doc_id", "shard", "shard_depth", "row_bytes", "shard_bytes")


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    file = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    made = bpe.decode_ids(bpe.encode_texts(table(spark, sf_dir, "documents"), *file), *file)
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_turnrepair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return turnrepair.repair_conversations(turnrepair.damage(turns), turns.select("conv_id"))


def op13_filteraudit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("filter")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_pii": op2_pii,
    "op3_neardup": op3_neardup,
    "op4_packing": op4_packing,
    "op5_chat": op5_chat,
    "op6_spandedup": op6_spandedup,
    "op7_secrets": op7_secrets,
    "op8_ann": op8_ann,
    "op9_sharding": op9_sharding,
    "op10_decontam": op10_decontam,
    "op11_bpe": op11_bpe,
    "op12_turnrepair": op12_turnrepair,
    "op13_filteraudit": op13_filteraudit,
}

ORACLES: dict[str, str] = {
    "op5_chat": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), o AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own FROM t
), e AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '|>', '|\>')) AS el,
    lag(role, 1, 'start') OVER (PARTITION BY conv_id, own ORDER BY turn NULLS LAST, role, text) AS prev
  FROM o
), g AS (
  SELECT conv_id,
    count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length(role) + 5 + el + 10)::BIGINT AS formatted_chars,
    bool_and((prev, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'),
      ('assistant', 'user'), ('assistant', 'tool'), ('tool', 'assistant')))
      AND arg_max(role, (turn IS NULL, turn)) = 'assistant' AS valid
  FROM e GROUP BY conv_id, own
)
SELECT * FROM g
""",
    "op9_sharding": f"""
WITH d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS row_bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents
), lv AS (
  SELECT doc_id, row_bytes, l, h >> (60 - l) AS p FROM d, range(0, 40) t(l)
), s AS (
  SELECT *, sum(row_bytes) OVER (PARTITION BY l, p) AS b, count(*) OVER (PARTITION BY l, p) AS n FROM lv
), leaf AS (
  SELECT doc_id, row_bytes, l, p, b, row_number() OVER (PARTITION BY doc_id ORDER BY l) AS k
  FROM s WHERE b <= {SHARD_BYTES} OR n = 1
)
SELECT doc_id, l::VARCHAR || '-' || p::VARCHAR AS shard, l::INTEGER AS shard_depth, row_bytes::BIGINT AS row_bytes,
  b::BIGINT AS shard_bytes
FROM leaf WHERE k = 1
""",
    "op10_decontam": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS m, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS win
  FROM b, range(1, greatest(1, len(ws) - 9) + 1) t(i) WHERE len(ws) > 0
), dw AS (
  SELECT doc_id, m, i, array_to_string(ws[i : i + m - 1], ' ') AS win
  FROM w, (SELECT DISTINCT m FROM bw), range(1, len(ws) - m + 2) t(i)
), h AS (
  SELECT doc_id, i, m, item_id FROM dw JOIN bw USING (m, win)
), p AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM h, range(0, m) t(k) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id
)
SELECT w.doc_id, coalesce(len(ws), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN p USING (doc_id) LEFT JOIN it USING (doc_id)
""",
    "op12_turnrepair": r"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations
), f AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)),
    4294967295) % 20 AS fate
  FROM o
), d AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM f, range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) AS copies
), n AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS rows, lag(role) OVER w AS prev,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text))
), m AS (
  SELECT *, substr(role, 1, 1) AS r, CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
  FROM n
), best AS (
  -- behind row i, for what is written so far (nothing, system, user, assistant): cost and audit of the rest
  SELECT conv_id, max(i) AS i, {'c': 0, 'a': ''} AS e, {'c': 6, 'a': 'II'} AS s, {'c': 3, 'a': 'I'} AS u, {'c': 0, 'a': ''} AS z
  FROM m GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, least(e, {'c': u.c + 3, 'a': 'I' || u.a}, {'c': z.c + 6, 'a': 'II' || z.a}), least(s, {'c': u.c + 3, 'a': 'I' || u.a}, {'c': z.c + 6, 'a': 'II' || z.a}),
    least(u, {'c': z.c + 3, 'a': 'I' || z.a}), least(z, {'c': u.c + 3, 'a': 'I' || u.a})
  FROM (
    SELECT conv_id, i - 1 AS i, least({'c': e.c + 4, 'a': 'D' || e.a}, {'c': u.c + rr, 'a': 'R' || u.a}, {'c': s.c + CASE WHEN r = 's' THEN kk ELSE 9999 END, 'a': 'K' || s.a},
        {'c': u.c + CASE WHEN r = 'u' THEN kk ELSE 9999 END, 'a': 'K' || u.a}) AS e,
      least({'c': s.c + 4, 'a': 'D' || s.a}, {'c': u.c + rr, 'a': 'R' || u.a}, {'c': u.c + CASE WHEN r = 'u' THEN kk ELSE 9999 END, 'a': 'K' || u.a}) AS s,
      least({'c': u.c + 4, 'a': 'D' || u.a}, {'c': z.c + rr, 'a': 'R' || z.a}, {'c': z.c + CASE WHEN r = 'a' THEN kk ELSE 9999 END, 'a': 'K' || z.a}) AS u,
      least({'c': z.c + 4, 'a': 'D' || z.a}, {'c': u.c + rr, 'a': 'R' || u.a}, {'c': u.c + CASE WHEN r = 'u' THEN kk ELSE 9999 END, 'a': 'K' || u.a}) AS z
    FROM (
      SELECT best.*, m.r, CASE m.fault WHEN 'b' THEN 9999 WHEN 'd' THEN 9999 WHEN 't' THEN 3 ELSE 0 END AS kk,
        CASE m.fault WHEN 'b' THEN 9999 WHEN 'd' THEN 9999 WHEN 't' THEN 6 ELSE 3 END AS rr
      FROM best JOIN m ON m.conv_id IS NOT DISTINCT FROM best.conv_id AND m.i = best.i
    )
  )
), done AS (
  SELECT conv_id, e.c AS cost, e.a AS audit FROM best WHERE i = 0
), step AS (
  -- the audit letter by letter: next row, what is written so far, the repaired line
  SELECT conv_id, audit, 0 AS pos, 1::BIGINT AS i, 'e' AS state, NULL::VARCHAR AS line FROM done
  UNION ALL
  SELECT step.conv_id, audit, pos + 1, step.i + CASE WHEN l = 'I' THEN 0 ELSE 1 END,
    CASE WHEN l = 'D' THEN state WHEN l = 'K' AND m.r = 's' THEN 's' WHEN state = 'u' THEN 'a' ELSE 'u' END,
    CASE WHEN l = 'D' THEN NULL WHEN l = 'K' THEN m.role || ':' || m.text
      ELSE CASE WHEN state = 'u' THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN l = 'R' THEN m.text ELSE '' END END
  FROM (SELECT *, substr(audit, pos + 1, 1) AS l FROM step WHERE pos < length(audit)) step
  LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM step.conv_id AND m.i = step.i
), hashed AS (
  SELECT conv_id, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos), '')) AS repaired_sha256 FROM step GROUP BY conv_id
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (i > 1 AND substr(prev, 1, 1) || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM m GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN hashed ON hashed.conv_id IS NOT DISTINCT FROM c.conv_id
""",
    "op13_filteraudit": r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM t
), l AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), d AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    list_filter([
      CASE WHEN len(ws) < 200 THEN 'A' END,
      CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' END,
      CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 'C' END,
      CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
      CASE WHEN w.doc_id > least THEN 'E' END], lambda x: x IS NOT NULL) AS fails
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id
), f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), p AS (
  SELECT a.f || b.f || c.f || e.f || g.f AS filter_order FROM f a, f b, f c, f e, f g
  WHERE len(list_distinct([a.f, b.f, c.f, e.f, g.f])) = 5
), s AS (
  SELECT filter_order, k::INTEGER AS step, substr(filter_order, k::INTEGER, 1) AS f, substr(filter_order, 1, k::INTEGER - 1) AS earlier
  FROM p, range(1, 6) x(k)
), r AS (
  SELECT part, filter_order, step, f,
    count(*) FILTER (NOT list_has_any(fails, string_split(earlier || f, ''))) AS kept,
    count(*) FILTER (list_contains(fails, f) AND NOT list_has_any(fails, string_split(earlier, ''))) AS removed,
    count(*) FILTER (list_contains(fails, f) AND list_has_any(fails, string_split(earlier, ''))) AS redundant,
    count(*) FILTER (fails = [f]) AS unique_fails,
    count(*) FILTER (good AND list_contains(fails, f) AND NOT list_has_any(fails, string_split(earlier, ''))) AS good_lost,
    count(*) FILTER (toxic AND list_contains(fails, f) AND NOT list_has_any(fails, string_split(earlier, ''))) AS toxic_lost
  FROM d, s GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM r
""",
}
