"""Registered queries of the subpackage, with SQL where SQL can express them over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.llm import chat, collocate, decontam, langid, license, packing, shard, simhash, substring, tokens, topk, warc
from voxelloom.llm import repair as repairs
from voxelloom.llm.setup import ready, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of `documents` that stand in phrases of `benchmark`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.scan(docs, table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), decontam.contaminated().alias("contaminated"),
    )


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` without the words of windows that start in an earlier document too."""
    done = substring.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256")
    return done.select("doc_id", "n_words", "n_removed", kept)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copies among `documents` by SimHash fingerprints within 3 bits."""
    groups = simhash.group(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of 2048 words for all `documents`, each source and each text at most once in a bin."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License templates in all `documents`, one row a match."""
    return license.found(table(spark, sf_dir, "documents").select("doc_id", "text"))


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all `documents`, learned from the labelled ones that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out()))
    told = langid.predict(docs.select("doc_id", "text"), model)
    return told.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `conversations` and one made of control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    hostile = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(hostile).alias("text"))
    chats = chat.format_chats(rows.unionByName(more).withColumn("parts", chat.text_parts(F.col("text"))))
    turns = chat.read_turns(F.col("formatted"))
    loss = chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP1_SQL = r"""
WITH m AS (
  SELECT conv_id::BIGINT conv_id, turn::BIGINT turn, coalesce(role, '') role, coalesce(text, '') text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), p AS (
  SELECT *, 20 + length(role) + length(text)
    + len(regexp_extract_all(role || ' ' || text, '[<\[]~*/?(?:s|ROLE|INST|SYS|IMG|AUDIO|DOC|PAD)[>\]]')) AS chars
  FROM m
), g AS (
  SELECT conv_id, count(*) n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') loss, sum(chars)::BIGINT chars
  FROM p GROUP BY conv_id
)
SELECT conv_id, n::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  chars AS formatted_chars FROM g
"""


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` in 40 shards by rendezvous hashing of their ids."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
                       F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    assigned = stored(shard.assign(rows, "doc_id", shards=40), "assigned")  # ranging samples its input: the hashes are made once
    numbered = shard.number(assigned, ["doc_id", "text_crc32"])
    return numbered.select("doc_id", "size", "text_crc32", "law", F.col("shard").cast("int").alias("shard"), "slot", F.col("grown_shard").cast("int").alias("grown_shard"))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all `documents`, written in the file format and read back."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return tokens.read(tokens.write(docs, tokens.folder(docs), public_tokenizers.path("byte_bpe_50k.json"), 2))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest scores among all `embeddings` of every row whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top(rows, query=F.col("vec_id") % 50 == 0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT k, min(doc_id) AS low FROM v GROUP BY k),
g AS (SELECT DISTINCT v.doc_id, v.i + o AS i FROM v JOIN f USING (k), range(13) r(o) WHERE low < v.doc_id),
h AS (SELECT e.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY e.i) AS kept FROM e ANTI JOIN g USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN h USING (doc_id)
"""

OP8_SQL = r"""
WITH t AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), w AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t
), b AS (SELECT id, w, least(13, len(w)) AS n FROM w WHERE side = 'b' AND len(w) > 0),
v AS (SELECT DISTINCT id AS item, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
d AS (SELECT id, w FROM w WHERE side = 'd'),
x AS (
  SELECT id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM v))
), o AS (SELECT x.id, x.i, x.n, v.item FROM x JOIN v USING (n, k)),
h AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS p FROM o) GROUP BY id),
m AS (SELECT id, count(*) AS n_items, string_agg(item::VARCHAR, ',' ORDER BY item::VARCHAR) AS items FROM (SELECT DISTINCT id, item FROM o) GROUP BY id)
SELECT d.id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN h USING (id) LEFT JOIN m USING (id)
"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of every language of all `documents`."""
    found = collocate.top(collocate.mine(table(spark, sf_dir, "documents")), 2000)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^.,;:!?\x0A-\x0D]+')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, x, count(*) AS a FROM (SELECT lang, w[i:i + k - 1] AS x FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 5) v(k)))
  GROUP BY lang, x HAVING count(*) >= 30
), c AS (SELECT * FROM f WHERE len(x) > 1),
s AS (
  SELECT c.lang, c.x, c.a, min({'score': (2000000 * c.a::HUGEINT) // (l.a::HUGEINT + r.a), 'k': k, 'l': l.a, 'r': r.a}) AS m
  FROM (SELECT *, unnest(range(1, len(x))) AS k FROM c) c JOIN f l ON l.lang = c.lang AND l.x = c.x[1:k] JOIN f r ON r.lang = c.lang AND r.x = c.x[k + 1:]
  GROUP BY c.lang, c.x, c.a
), b AS (
  SELECT lang, y, max(a) AS b FROM (
    SELECT lang, a, x[i:i + k - 1] AS y FROM (SELECT lang, a, x, k, unnest(range(1, len(x) - k + 2)) AS i FROM c, range(2, 4) v(k) WHERE k < len(x)))
  GROUP BY lang, y
), o AS (
  SELECT s.lang, array_to_string(s.x, ' ') AS phrase, s.a, m.l AS l, m.r AS r, n, m.score::BIGINT AS score
  FROM s JOIN t ON t.lang = s.lang LEFT JOIN b ON b.lang = s.lang AND b.y = s.x WHERE b IS NULL OR 100 * b::HUGEINT < 80 * s.a::HUGEINT
)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o) WHERE rank <= 2000
"""


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of all `conversations`, damaged by a hash of conversation and turn."""
    done = repairs.repair(repairs.damage(table(spark, sf_dir, "conversations")), gone="gone", texts=False)
    return done.drop("repaired")


OP12_SQL = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT) AS name
  FROM conversations
), drawn AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, name), lambda h, c: list_reduce(list_prepend(xor(h, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS hit
  FROM raw
), hurt AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN hit = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM drawn WHERE hit <> 0
), placed AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said
  FROM hurt
), rows AS (
  SELECT *, CASE WHEN said = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS two
  FROM placed
), moves(s, c, t) AS (VALUES ('e', 's', 's'), ('e', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
inserts(s, t, letters, said) AS (
  VALUES ('e', 'e', '', []::VARCHAR[]), ('s', 's', '', []), ('u', 'u', '', []), ('a', 'a', '', []),
    ('e', 'u', 'I', ['user:']), ('s', 'u', 'I', ['user:']), ('a', 'u', 'I', ['user:']), ('u', 'a', 'I', ['assistant:']),
    ('e', 'a', 'II', ['user:', 'assistant:']), ('s', 'a', 'II', ['user:', 'assistant:']), ('a', 'a', 'II', ['user:', 'assistant:']),
    ('u', 'u', 'II', ['assistant:', 'user:'])
), edits AS (
  SELECT r.conv_id, r.i, m.s, m.t, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS cost, 'K' AS letter, [role || ':' || text] AS said
  FROM rows r JOIN moves m ON r.role[1] = m.c WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT r.conv_id, r.i, m.s, m.t, CASE WHEN fault = 'truncated' THEN 6 ELSE 3 END, 'R', [CASE m.c WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text]
  FROM rows r JOIN moves m ON m.c IN ('u', 'a') WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT r.conv_id, r.i, x.s, x.s, 4, 'D', [] FROM rows r, (VALUES ('e'), ('s'), ('u'), ('a')) x(s)
), walks(conv_id, i, s, best) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 'e', {'cost': 0, 'audit': '', 'said': []::VARCHAR[]} FROM conversations
  UNION ALL
  SELECT w.conv_id, w.i + 1, e.t, min({'cost': best.cost + 3 * length(n.letters) + e.cost, 'audit': best.audit || n.letters || e.letter,
    'said': best.said || n.said || e.said})
  FROM walks w JOIN inserts n ON n.s = w.s JOIN edits e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 AND e.s = n.t
  GROUP BY w.conv_id, w.i + 1, e.t
), counts AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id
), ends AS (
  SELECT w.conv_id, min({'cost': best.cost + 3 * length(n.letters), 'audit': best.audit || n.letters, 'said': best.said || n.said}) AS best
  FROM walks w LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id JOIN inserts n ON n.s = w.s AND n.t IN ('e', 'a')
  WHERE w.i = coalesce(c.n, 0) GROUP BY w.conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.cost::BIGINT AS cost, best.audit AS audit,
  sha256(array_to_string(best.said, chr(10))) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `pages` as WARC records in whole-file gzip streams, normalised to one member a record and read back by offsets."""
    files = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS n, first_value(page_id) OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS first
  FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN n > 1 AND octet_length(encode(html)) >= 1000 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND octet_length(encode(html)) >= 1000 THEN first END AS refers_to
FROM r
"""


QUERIES = {"op5_license": op5_license, "op10_topk": op10_topk, "op9_tokens": op9_tokens, "op1_chat": op1_chat, "op6_sharding": op6_sharding, "op3_packing": op3_packing, "op7_language": op7_language, "op2_substring": op2_substring, "op4_simhash": op4_simhash, "op8_decontaminate": op8_decontaminate,
           "op11_collocations": op11_collocations, "op12_repair": op12_repair, "op13_warc": op13_warc}
ORACLES: dict[str, str] = {"op1_chat": OP1_SQL, "op2_substring": OP2_SQL, "op8_decontaminate": OP8_SQL, "op10_topk": OP10_SQL, "op11_collocations": OP11_SQL, "op12_repair": OP12_SQL, "op13_warc": OP13_SQL}
