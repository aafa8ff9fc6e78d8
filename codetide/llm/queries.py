"""The thin whole-table queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import divergence, licenses, media, mixing, packing, quality, repair, sharding, simhash, tokencount, toxicity, vecdedup, warc
from .common import read_table, stage

CAPACITY = 2048
SHARDS = 24


def byte_bpe() -> dict:
    """Where the byte-level BPE file and its ranks lie."""
    return {
        "path": public_tokenizers.path("byte_bpe_50k.json"), "fast_path": public_tokenizers.path("byte_bpe_50k.tiktoken"),
        "special": {"<|endoftext|>": 50256}, "pattern": public_tokenizers.PATTERN,
    }


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, CAPACITY, byte_bpe())


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string")) % 3 == 1


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score; labels of held-out documents are never read."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    settings = toxicity.ToxicitySettings()
    model = toxicity.train_toxicity(docs.filter(~held_out()), labels.filter(~held_out()), settings)
    scored = toxicity.score_texts(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= settings.cut).cast("int").alias("predicted"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash and near-duplicate component."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    groups = simhash.group_near(docs)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    sized = stage(docs, "sizes")
    rated = mixing.quality_weights(sized, read_table(spark, sf_dir, "labels"))
    mixed = mixing.mix(rated, F.col("mix_weight"), F.col("size"), rows=sized.count())
    return mixed.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("size")).alias("taken"))


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), marks AS (
  SELECT doc_id, avg(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), keyed AS (
  SELECT s.*, -ln((CAST('0x' || substr(md5('17|' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
           / CASE WHEN m.quality >= 0.5 THEN 2.0::DOUBLE WHEN m.quality < 0.5 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS key
  FROM sized s LEFT JOIN marks m ON s.doc_id = m.doc_id
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         2 * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM sources
), filling AS (
  SELECT *, (budget - coalesce(sum(cap) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
  FROM weighed WINDOW f AS (ORDER BY cap / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce(max(CASE WHEN level <= cap / weight::DOUBLE THEN level END) OVER (), 'inf'::DOUBLE) * weight) AS target FROM filling
), summed AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source
), fair AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size::DOUBLE) AS BIGINT) ELSE 0 END AS epochs FROM summed
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size > 0 THEN size * (epochs + CASE WHEN upto - size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END) ELSE 0 END AS BIGINT) AS taken
FROM fair
"""


def op5_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens under the 32k piece model.

    Set ``spark.codetide.tokenCache`` to a shared folder to keep the cache between runs.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokencount.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), spark.conf.get("spark.codetide.tokenCache", None))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op6_vecdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's links and component at a cosine of 0.95."""
    return vecdedup.near_vectors(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


#: All pairs, which is quick on the small tables that SQL is run on.
OP6_SQL = """
WITH RECURSIVE vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (SELECT * FROM vectors WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS x, vec_id AS y FROM vectors UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
component AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.x = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM vectors v JOIN component c ON v.vec_id = c.x
"""


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license phrases and notices."""
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("blocks")


def _license_sql() -> str:
    quoted = lambda words: "[" + ", ".join(f"'{w.decode()}'" for w in words) + "]"
    scanner = licenses.Scanner(licenses.NOTICES, licenses.BASE_PHRASES, licenses.THRESHOLD, {})
    templates = ", ".join(f"({k}, '{t.label}', {t.length}, {quoted(t.order)}, {t.need})" for k, t in enumerate(scanner.templates))
    phrases = ", ".join(f"('{label}', {quoted(licenses.license_words(phrase))})" for phrase, label in licenses.BASE_PHRASES.items())
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), templates AS (SELECT * FROM (VALUES {templates}) AS t(k, label, length, words, need)),
phrases AS (SELECT * FROM (VALUES {phrases}) AS t(label, words)),
starts AS (SELECT r, label, w, words, unnest(range(len(w) - len(words) + 1)) AS s FROM texts, phrases WHERE len(w) >= len(words)),
places AS (SELECT r, label, s FROM starts WHERE list_slice(w, s + 1, s + len(words)) = words),
shared AS (SELECT r, k, label, length, need, words, w FROM texts, templates WHERE len(w) >= need AND len(list_intersect(words, w)) >= need),
windows AS (SELECT *, unnest(range(len(w))) AS s FROM shared),
counted AS (SELECT r, label, need, len(words) AS m, len(list_intersect(words, list_slice(w, s + 1, s + 2 * length))) AS common FROM windows WHERE list_contains(words, w[s + 1])),
blocks AS (SELECT r, label, common / m::DOUBLE AS share FROM counted WHERE common >= need),
base AS (SELECT r, count(*) AS n, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY r),
named AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM places UNION SELECT r, label FROM blocks) GROUP BY r),
best AS (SELECT r, max(share) AS score FROM blocks GROUP BY r)
SELECT t.doc_id, len(t.w) AS n_words, coalesce(b.n, 0) AS n_base, b.first_word, b.last_word, coalesce(b.labels, '') AS base_labels, coalesce(n.labels, '') AS labels, coalesce(s.score, 0.0::DOUBLE) AS score
FROM texts t LEFT JOIN base b ON t.r = b.r LEFT JOIN named n ON t.r = n.r LEFT JOIN best s ON t.r = s.r
"""


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as an image and read back."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = media.media_columns(docs)
    feature = F.concat(F.lit("png;"), F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"), F.lit("x"), F.col("bits").cast("string"), F.lit(";"), F.col("samples"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256", feature.alias("feature"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata and conversion records of every page, with digests of their bytes.

    The pages are first written to gzip WARC files as responses, which are read back member by member.
    """
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    index = warc.write_warc(warc.responses_of(pages), key_col="key")
    records = warc.derivatives(warc.read_warc(index, key_col="key")).withColumnRenamed("key", "page_id")
    return records.withColumn("record_sha256", F.sha2("record", 256)).withColumn("record_bytes", F.octet_length("record").cast("long")).drop("record")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot, with row counts at most one apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    docs = stage(docs, "sizes")  # ids, sizes and digests: the texts are read once
    placed = sharding.interleave(docs, SHARDS, ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP10_SQL = f"""
WITH table_rows AS (
  SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)
), crc_table AS (SELECT list(c ORDER BY i) AS t FROM table_rows),
texts AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (SELECT doc_id, source, len(h) // 2 AS n, list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS b FROM texts),
rows AS (
  SELECT doc_id, source, n + 8 AS size, xor(4294967295, list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS text_crc32 FROM bytes, crc_table
), keyed AS (
  SELECT *, (CAST('0x' || substr(md5('29|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(text_crc32 AS VARCHAR) || '|' || CAST(size AS VARCHAR)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS key FROM rows
), ranked AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY key, doc_id, text_crc32, size) - 1) / (2 * count(*) OVER (PARTITION BY source))::DOUBLE AS share FROM keyed
), placed AS (
  SELECT *, row_number() OVER (ORDER BY share, source NULLS FIRST, key, doc_id, text_crc32, size) - 1 AS pos, count(*) OVER () AS total FROM ranked
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(pos * {SHARDS} // total AS INTEGER) AS shard,
       CAST(pos - ((pos * {SHARDS} // total) * total + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after the damage, its cheapest edits and the digest of what they leave."""
    turns = repair.damaged(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    edits = repair.cheapest_edits(repair.diagnose(turns))
    digests = repair.transcripts(repair.repaired(turns, edits)).withColumnRenamed("conv", "own")
    joined = edits.join(digests, F.col("conv").eqNullSafe(F.col("own")), "left")
    return joined.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _repair_sql() -> str:
    """The same by a recursive query over the rows, which carries the cheapest edits and the text of each state."""
    inserts = {0: (("", 0, ""), ("I", 2, "\nuser:"), ("II", 3, "\nuser:\nassistant:")), 1: (("", 1, ""), ("I", 2, "\nuser:")), 2: (("", 2, ""), ("I", 3, "\nassistant:")), 3: (("", 3, ""), ("I", 2, "\nuser:"))}
    edits = [("D", q, q, None) for q in range(4)] + [("K", 0, 1, "s")] + [(e, q, 3 if q == 2 else 2, {"K": "a" if q == 2 else "u"}.get(e)) for e in "KR" for q in range(4)]
    rows = ", ".join(f"('{e}', {q}, '{more}', {to}, {'NULL' if role is None else repr(role)}, '{said}')" for e, q, at, role in edits for more, to, said in inserts[at])
    starts = ", ".join(f"({to}, '{more}', '{said}')" for more, to, said in inserts[0])
    return rf"""
WITH RECURSIVE crc_rows AS (
  SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)
), crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_rows),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations),
kinds AS (
  SELECT * EXCLUDE (k), xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(octet_length(k)), lambda i: CAST('0x' || substr(hex(k), 2 * i + 1, 2) AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) % 20 AS kind
  FROM named, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER w AS i,
         lag(CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END) OVER w || CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS pair
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text))
), counted AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM placed
), marked AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE 'none' END AS fault FROM counted
), edits AS (SELECT * FROM (VALUES {rows}) AS t(edit, q0, more, goes, role, said)),
way(conv_id, i, q, b) AS (
  SELECT conv_id, 0, s.q, {{'c': CAST(5 * length(more) AS BIGINT), 'a': more, 't': said}} FROM (SELECT DISTINCT conv_id FROM marked), (VALUES {starts}) AS s(q, more, said)
  UNION ALL
  SELECT w.conv_id, CAST(any_value(m.i) AS INTEGER), e.goes, min({{
    'c': w.b.c + CASE e.edit WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN e.edit <> 'D' AND m.fault = 'truncated' THEN 5 ELSE 0 END + 5 * length(e.more), 'a': w.b.a || e.edit || e.more,
    't': w.b.t || CASE e.edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || m.role || ':' || m.text ELSE chr(10) || CASE WHEN w.q = 2 THEN 'assistant' ELSE 'user' END || ':' || m.text END || e.said}})
  FROM way w JOIN marked m ON w.conv_id IS NOT DISTINCT FROM m.conv_id AND m.i = w.i + 1 JOIN edits e ON e.q0 = w.q AND (e.edit = 'D' OR m.fault NOT IN ('blank', 'duplicate')) AND (e.role IS NULL OR left(m.role, 1) = e.role)
  GROUP BY w.conv_id, e.goes
), counts AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id
), best AS (SELECT w.conv_id, min(b) AS b FROM way w JOIN counts c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n WHERE w.q IN (0, 3) GROUP BY w.conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(substr(b.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON a.conv_id IS NOT DISTINCT FROM b.conv_id
"""


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; labels of held-out documents are never read."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    settings = quality.QualitySettings()
    model = quality.train_quality(docs.filter(~held_out()), labels.filter(~held_out()), settings)
    scored = quality.score_texts(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= settings.cut).cast("int").alias("predicted"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source of a language is from the others, and the terms that set it apart."""
    return divergence.divergence(read_table(spark, sf_dir, "documents").select("text", "lang", "source"))


#: Every pair over the whole vocabulary.
OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), occurs AS (SELECT r, lang, source, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM occurs GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT o.lang, o.source, o.term, count(*) AS c FROM occurs o JOIN kept k ON o.lang = k.lang AND o.term = k.term GROUP BY o.lang, o.source, o.term),
sizes AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY lang, source),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (coalesce(s.n, 0) + l.v) AS p, 1 + (1000000000::HUGEINT * (k.total + 1)) // (l.n + l.v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang LEFT JOIN sizes s ON g.lang = s.lang AND g.source = s.source LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM dense WHERE c > 0 AND p > q
), ranked AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_toxicity, op3_simhash, op4_mixing, op5_tokencount, op6_vecdedup, op7_licenses, op8_media, op9_warc, op10_sharding, op11_repair, op12_quality, op13_divergence)}


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": OP4_SQL, "op6_vecdedup": OP6_SQL, "op7_licenses": _license_sql(), "op10_sharding": OP10_SQL, "op11_repair": _repair_sql(), "op13_divergence": OP13_SQL}
