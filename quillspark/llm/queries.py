"""The operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm import chat, conversation_repair, decontam, exact_dedup, jaccard_join, mixing, quality, substring, token_files, toxicity, vector_dedup, warc, whitening
from quillspark.llm.common import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(_table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.shared_passages(_table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = stored(token_files.write_token_files(_table(spark, sf_dir, "documents"), tokenizer_path()))
    return token_files.read_token_files(index)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_warc(_table(spark, sf_dir, "pages"))
    return warc.read_warc(index).select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    return marked.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"), keep="max")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows become records of up to two turns in nine layouts, so that mappings are chosen by fingerprint here too.

    Which layout follows from the roles of a record's turns and a hash. Records are made of neighbouring turns, never of a whole
    conversation.
    """
    said = "</s>[INST] ok [/INST]"
    fixed = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).unionByName(fixed)
    place = F.row_number().over(W.partitionBy("conv_id", "pair").orderBy("turn", "role", "text")) - 1
    placed = rows.withColumn("pair", F.floor(F.col("turn") / 2)).withColumn("sub", F.floor(place / 2))
    held = placed.groupBy("conv_id", "pair", "sub").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))  # two at most
    roles, kind = F.array_join("t.role", " "), F.pmod(F.xxhash64("conv_id", "pair", "sub"), F.lit(6))
    text = lambda i: F.col("t")[i]["text"]
    two = lambda a, b: F.to_json(F.struct(text(0).alias(a), text(1).alias(b)))
    one = lambda name: F.to_json(F.struct(text(0).alias(name)))
    message = lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))
    named = lambda role: F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    said = lambda x: F.struct(named(x["role"]).alias("from"), x["text"].alias("value"))
    pairs = [("prompt", "response"), ("prompt", "completion"), ("question", "answer"), ("instruction", "output")]
    record = F.when(kind == 4, F.to_json(F.struct(F.transform("t", said).alias("conversations")))).otherwise(F.to_json(F.struct(F.transform("t", message).alias("messages"))))
    for i, (a, b) in enumerate(pairs):
        record = F.when((roles == "user assistant") & (kind == i), two(a, b)).otherwise(record)
    for role, name in (("user", "prompt"), ("assistant", "response"), ("system", "system")):
        record = F.when((roles == role) & (kind < 4), one(name)).otherwise(record)
    opened = F.to_json(F.struct(text(0).alias("system"), F.transform(F.slice("t", 2, 1), message).alias("messages")))
    record = F.when(roles.startswith("system ") & (kind < 4), opened).otherwise(record)
    turns = chat.canonical_turns(held.select("conv_id", (F.col("pair") * 10**9 + F.col("sub")).alias("turn"), record.alias("record")))
    return chat.read_chats(stored(chat.format_chats(turns)))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _table(spark, sf_dir, "conversations")
    return conversation_repair.repair_conversations(conversation_repair.damage(said), every=said)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_mix_sources": op3_mix_sources,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_token_files": op5_token_files,
    "op6_warc": op6_warc,
    "op7_decontamination": op7_decontamination,
    "op8_quality": op8_quality,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_chat": op10_chat,
    "op11_whitening": op11_whitening,
    "op12_near_vectors": op12_near_vectors,
    "op13_repair": op13_repair,
}

#: What can be done from a state with rows that are inserted and one that is kept, changed or deleted: (state, role's initial or * for any,
#: audit, cost without that of a truncated row that stays, next state, lines put in, the row's role then: none, its own (=) or another).
def _repair_steps() -> str:
    rows = []
    after, kept = {0: 2, 1: 2, 2: 3, 3: 2}, {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    for q in range(4):
        at, lines = q, ""
        for n in range(4):
            rows.append((q, "*", "I" * n + "D", 5 * n + 2, at, lines, ""))
            rows += [(q, r, "I" * n + "K", 5 * n, to, lines, "=") for (own, r), to in kept.items() if own == at]
            rows.append((q, "*", "I" * n + "R", 5 * n + 1, after[at], lines, {2: "user", 3: "assistant"}[after[at]]))
            at = after[at]
            lines += {2: "user", 3: "assistant"}[at] + ":" + chr(10)
    quoted = lambda v: str(v) if isinstance(v, int) else "'" + v + "'"
    return ", ".join(f"({', '.join(map(quoted, r))})" for r in rows)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op3_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         len(regexp_extract_all(coalesce(text, ''), '[#$%&*|!]')) AS marks FROM documents),
k AS (
  SELECT *, -ln((CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0)
            / greatest(0.05, 1.0 - marks / CAST(greatest(size, 1) AS DOUBLE)) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS lim FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / CAST(sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w),
f AS (SELECT *, lim / weight <= level AS capped, max(CASE WHEN lim / weight > level THEN level END) OVER () AS final FROM l),
t AS (SELECT source, source_size, CASE WHEN capped OR final IS NULL THEN CAST(lim AS DOUBLE) ELSE weight * final END AS target FROM f),
b AS (SELECT *, floor(target / greatest(source_size, 1)) AS epochs FROM t),
p AS (SELECT k.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, round(target - epochs * source_size) - before)) AS BIGINT) AS taken
FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source""",
    "op6_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS kept FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> kept THEN kept END AS refers_to FROM g""",
    "op7_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, array_to_string(list_slice(w, s, s + 12), ' ') AS win, least(13, len(w)) AS n
       FROM i, LATERAL unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(s) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win
       FROM d, lens, LATERAL unnest(range(1, len(w) - n + 2)) AS u(s)),
m AS (SELECT doc_id, s, dw.n, item FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, LATERAL unnest(range(s, s + n)) AS u(p) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS names FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(names, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id)""",
    "op9_exact_dedup": f"""
WITH n AS (SELECT doc_id, {_LOWER} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256 FROM n""",
    "op10_chat": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(role, '([\\<\[])', '\\\1', 'g') AS r, regexp_replace(text, '([\\<\[])', '\\\1', 'g') AS t FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<s>[ROLE]' || r || '[INST]' || t || '[/INST]</s>')) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op13_repair": rf"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda h, b: list_reduce(list_prepend(xor(h, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384 + 0 * y))), 4294967295::BIGINT) % 20 AS kind FROM conversations),
dam AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS again FROM said),
pl AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS fin FROM dam),
fl AS (SELECT *, CASE WHEN fin = '' THEN 'b' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'd' WHEN fin NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault, left(role, 1) AS r, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS r2 FROM pl),
step(q, need, piece, price, q2, front, own) AS (VALUES {_repair_steps()}),
run AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, 0::BIGINT AS cost, '' AS audit, '' AS lines FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, q2, cost, audit, lines FROM (
    SELECT run.conv_id, fl.i, q2, run.cost + price + CASE WHEN fault = 't' AND own <> '' THEN 5 ELSE 0 END AS cost, audit || piece AS audit,
           lines || front || CASE own WHEN '' THEN '' WHEN '=' THEN role || ':' || text || chr(10) ELSE own || ':' || text || chr(10) END AS lines
    FROM run JOIN fl ON fl.conv_id IS NOT DISTINCT FROM run.conv_id AND fl.i = run.i + 1 JOIN step ON step.q = run.q AND (need = '*' OR need = r) AND (own = '' OR fault NOT IN ('b', 'd')))
  QUALIFY row_number() OVER (PARTITION BY conv_id, q2 ORDER BY cost, audit) = 1),
fin(q, piece, price, rest) AS (VALUES (0, '', 0, ''), (1, 'II', 10, 'user:' || chr(10) || 'assistant:' || chr(10)), (2, 'I', 5, 'assistant:' || chr(10)), (3, '', 0, '')),
n AS (SELECT conv_id, count(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
        count(*) FILTER (r2 IS NOT NULL AND r || r2 NOT IN ('su', 'ua', 'au')) AS illegal FROM fl GROUP BY conv_id),
best AS (SELECT run.conv_id, cost + price AS cost, audit || piece AS audit, lines || rest AS lines FROM run JOIN fin USING (q) LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM run.conv_id WHERE i = coalesce(n, 0)
  QUALIFY row_number() OVER (PARTITION BY run.conv_id ORDER BY cost + price, audit || piece) = 1)
SELECT best.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit,
       sha256(CASE WHEN lines = '' THEN '' ELSE left(lines, length(lines) - 1) END) AS repaired_sha256
FROM best LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM best.conv_id""",
}
