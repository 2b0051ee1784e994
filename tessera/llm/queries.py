"""The queries op1 to op13: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, contamination, licenses, lm, media, merkle, nearjoin, packing, quality, ranked, toxicity, warc
from tessera.llm.supervised import fold

PACKED = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Least scores of documents that count as toxic and as good.
TOXIC_FROM, GOOD_FROM = 0.3, 0.5


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


#: The schema of the calls that user turns make.
CHAT_SCHEMAS = [("reply", "prompt", "string", True), ("reply", "turn", "integer", True)]


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as linked calls and messages in canonical JSON."""
    schemas = spark.createDataFrame(CHAT_SCHEMAS, "name string, param string, type string, required boolean")
    return chat.formatted(_read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"), schemas)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, its own or that of the nearest directory where a document has one.

    A document's path is source/language/block of 100 ids/id; each tenth id stands in the language's folder and each
    hundredth in the source's, so that there are declarations at every depth.
    """
    docs = _read(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")
    inner = F.when(F.col("doc_id") % 10 != 0, F.concat_ws("/", "lang", F.floor(F.col("doc_id") / 100).cast("string"))).when(F.col("doc_id") % 100 != 0, F.col("lang"))
    files = docs.select("doc_id", F.concat_ws("/", "source", inner, F.concat(F.col("doc_id"), F.lit(".txt"))).alias("path"), "text")
    return licenses.scan(files, "doc_id", declared=F.lit(True))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every document by a model of the labelled rows outside one fold of four."""
    docs, labels = _read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "labels", "doc_id", "toxic")
    machine = toxicity.train(docs, labels, fold("doc_id", 4) != 2)
    out = toxicity.score(docs, machine).drop("text")
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op4_nearjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document and its number of links to other texts."""
    rows = nearjoin.join(_read(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.select("doc_id", "class_id", "n_links")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives, indexed and read back."""
    found = warc.read(warc.write(_read(spark, sf_dir, "pages", "page_id", "url", "html"), "page_id", "url", "html"))
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op6_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a PNG, read back and hashed."""
    stored = media.encode(_read(spark, sf_dir, "documents", "doc_id", "text"))
    return media.decode(stored).select(
        "doc_id",
        "n_bytes",
        F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -32, 32)).alias("tail_crc32"),
        F.octet_length("png").cast("long").alias("media_bytes"),
        F.sha2("png", 256).alias("media_sha256"),
        F.lower(F.hex("image_hash")).alias("feature"),
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and the decoded bytes of every document."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    ids = bpe.encode(docs, BPE_RANKS, public_tokenizers.PATTERN).drop("text")
    out = bpe.decode(ids, BPE_RANKS, public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document holds."""
    return contamination.search(_read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "benchmark", "item_id", "text"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document by a trie of the documents outside one fold of seven."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    model = lm.train(lm.learned(docs, fold("doc_id", 7) != 2))
    return lm.score(docs, model).withColumn("held_out", F.coalesce(fold("doc_id", 7) == 2, F.lit(False)))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document by a model of the labelled rows outside one fold of three."""
    docs, labels = _read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "labels", "doc_id", "quality")
    model = quality.train(docs, labels, fold("doc_id", 3) != 1)
    out = quality.score(docs, model).drop("text")
    return out.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item by their terms."""
    return ranked.rank(_read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "benchmark", "item_id", "text"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests and proofs of every document, and whether it holds where every seventh one by a checksum was tampered with."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    rows = merkle.verified(merkle.manifest(_read(spark, sf_dir, "documents", *fields), "doc_id", "lang", fields, {"n_chars": tampered}))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 1024 tokens."""
    found = packing.pack(packing.pieces(_read(spark, sf_dir, "documents", "doc_id", "text"), *PACKED))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {f.__name__: f for f in (op1_chat, op2_licenses, op3_toxicity, op4_nearjoin, op5_warc, op6_png, op7_bpe, op8_contamination, op9_lm, op10_quality, op11_ranked, op12_merkle, op13_packing)}
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(regexp_split_to_array(" + _LOWER + ", '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"

_LICENSES = f"""
    WITH k(license, said) AS (VALUES ('Apache-2.0', 'Licensed under the Apache License, Version 2.0.'), ('BSD-2-Clause', 'Licensed under the BSD 2-Clause License.'), ('BSD-3-Clause', 'Licensed under the BSD 3-Clause License.'),
        ('CC-BY-4.0', 'Licensed under CC BY 4.0.'), ('CC-BY-NC-4.0', 'Licensed under CC BY-NC 4.0.'), ('CC0-1.0', 'Dedicated to the public domain under CC0 1.0 Universal.'),
        ('GPL-2.0', 'This work is licensed under the GNU General Public License, version 2.'), ('GPL-3.0', 'This work is licensed under the GNU General Public License, version 3.'),
        ('LGPL-3.0', 'This work is licensed under the GNU Lesser General Public License, version 3.'), ('MIT', 'Released under the MIT License.'), ('MPL-2.0', 'Licensed under the Mozilla Public License, Version 2.0.'), ('Proprietary', 'All rights reserved.')),
    v AS (SELECT license, term, count(*) AS tf FROM (SELECT license, unnest(regexp_extract_all(lower(said), '[a-z0-9]+(?:\\.[0-9]+)*')) AS term FROM k) GROUP BY ALL),
    f AS (SELECT term, ln(13.0::DOUBLE / (1 + count(*))) + 1 AS idf FROM v GROUP BY 1),
    u AS (SELECT license, v.term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY license)) AS unit FROM v JOIN f ON f.term = v.term),
    d AS (SELECT doc_id, concat(source, '/', CASE WHEN doc_id % 10 <> 0 THEN concat(lang, '/', doc_id // 100, '/') WHEN doc_id % 100 <> 0 THEN concat(lang, '/') ELSE '' END) AS folder, text FROM documents),
    l AS (SELECT doc_id, unnest(range(len(x))) AS line, unnest(x) AS said FROM (SELECT doc_id, string_split(lower(text), chr(10)) AS x FROM documents WHERE text ILIKE '%licen%' OR text ILIKE '%rights%' OR text ILIKE '%public%' OR text ILIKE '%cc%' OR text ILIKE '%mit%')),
    t AS (SELECT doc_id, line, term, count(*) AS tf FROM (SELECT doc_id, line, unnest(regexp_extract_all(said, '[a-z0-9]+(?:\\.[0-9]+)*')) AS term FROM l) GROUP BY ALL),
    w AS (SELECT doc_id, line, t.term, tf * coalesce(idf, ln(13.0::DOUBLE) + 1) AS w FROM t LEFT JOIN f ON f.term = t.term),
    n AS (SELECT doc_id, line, sqrt(sum(w * w)) AS length FROM w GROUP BY ALL),
    s AS (SELECT w.doc_id, license, round(sum(w.w * unit) / any_value(length), 6) AS score FROM w JOIN u ON u.term = w.term JOIN n ON n.doc_id = w.doc_id AND n.line = w.line GROUP BY w.doc_id, w.line, license),
    b AS (SELECT doc_id, license, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) AS k FROM s WHERE score >= 0.6) WHERE k = 1),
    o AS (SELECT d.doc_id, concat(folder, d.doc_id, '.txt') AS path, left(folder, length(folder) - 1) AS folder, b.license AS own_license, b.score AS own_score FROM d LEFT JOIN b ON b.doc_id = d.doc_id),
    g AS (SELECT folder, min_by(own_license, path) AS license FROM o WHERE own_license IS NOT NULL GROUP BY 1),
    p AS (SELECT o.*, split_part(o.folder, '/', 1) AS f1, concat(split_part(o.folder, '/', 1), '/', split_part(o.folder, '/', 2)) AS f2 FROM o)
    SELECT doc_id, path, own_license, own_score, coalesce(own_license, a.license, c.license, e.license) AS license,
        CASE WHEN own_license IS NOT NULL THEN NULL WHEN a.license IS NOT NULL THEN p.folder WHEN c.license IS NOT NULL THEN f2 WHEN e.license IS NOT NULL THEN f1 END AS inherited_from
    FROM p LEFT JOIN g a ON a.folder = p.folder LEFT JOIN g c ON c.folder = f2 LEFT JOIN g e ON e.folder = f1"""
_CHAT = """
    WITH m AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
    c AS (SELECT u.*, r.text AS reply, r.turn IS NOT NULL AS answered, EXISTS (SELECT 1 FROM m x WHERE x.conv_id = u.conv_id AND x.turn = u.turn - 1 AND x.role = 'assistant')
        AND EXISTS (SELECT 1 FROM m x WHERE x.conv_id = u.conv_id AND x.turn = u.turn - 2 AND x.role = 'user') AS waits
        FROM m u LEFT JOIN m r ON r.conv_id = u.conv_id AND r.turn = u.turn + 1 AND r.role = 'assistant' WHERE u.role = 'user'),
    i AS (SELECT *, sum(CASE WHEN waits THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM c),
    k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS level, CASE WHEN answered THEN 'linked' ELSE 'pending' END AS status FROM i)
    SELECT conv_id, turn, 'call' AS kind, concat('reply-', turn) AS call_id, level, status, TRUE AS valid,
        concat('{"arguments":{"prompt":', to_json(text), ',"turn":', turn, '},"call_id":"reply-', turn, '","errors":[],"level":', level, ',"name":"reply",', CASE WHEN reply IS NOT NULL THEN concat('"result":', to_json(reply), ',') ELSE '' END, '"status":"', status, '"}') AS canonical FROM k
    UNION ALL SELECT conv_id, turn, 'message', NULL, NULL, 'plain', TRUE, concat('{"content":', to_json(text), ',"role":', to_json(role), '}') FROM m
    WHERE role <> 'user' AND NOT (role = 'assistant' AND EXISTS (SELECT 1 FROM m x WHERE x.conv_id = m.conv_id AND x.turn = m.turn - 1 AND x.role = 'user'))"""
_WARC = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
    SELECT page_id, octet_length(encode(html)) AS payload_bytes,
        array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha1(html), 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
        CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, TRUE AS intact FROM p"""

_TERMS = f"list_distinct(regexp_extract_all({_LOWER.format('text')}, '{ranked.TERM}'))"
_RANKED = f"""
    WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '{ranked.TERM}') AS t FROM documents),
    z AS (SELECT count(*) AS n_docs, sum(len(t)) AS total FROM d WHERE len(t) > 0),
    q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
    p AS (SELECT doc_id, term, any_value(n)::BIGINT AS n, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, z GROUP BY term),
    s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // total::BIGINT))))::BIGINT AS score
        FROM q JOIN p USING (term) JOIN w USING (term), z GROUP BY ALL)
    SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""
_PART = "CASE WHEN {0} IS NULL THEN '-' ELSE concat(octet_length(encode({0}::VARCHAR)), ':', {0}::VARCHAR) END"
_LEAF = "sha256(concat(" + ", ".join(_PART.format(c) for c in ("doc_id", "source", "lang")) + ", {}, " + _PART.format("text") + "))"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
_STEP = "lambda a, s: sha256(CASE left(s, 1) WHEN 'L' THEN substr(s, 2) || a WHEN 'R' THEN a || substr(s, 2) ELSE a END)"
_MERKLE = f"""
    WITH RECURSIVE d AS (SELECT doc_id, lang, {_LEAF.format(_PART.format("n_chars"))} AS leaf, {_LEAF.format(_PART.format(f"(CASE WHEN {_CRC} % 7 = 0 THEN n_chars + 1 ELSE n_chars END)"))} AS told FROM documents),
    g AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT lang FROM documents)),
    r AS (SELECT doc_id, g, leaf, told, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM d JOIN g ON g.lang IS NOT DISTINCT FROM d.lang),
    t AS (SELECT g, 0 AS k, p, leaf AS h, n FROM r UNION ALL SELECT g, k + 1, p // 2, sha256(string_agg(h, '' ORDER BY p)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY g, k, p // 2, n),
    s AS (SELECT g, h AS subroot FROM t WHERE n = 1),
    u AS (SELECT 0 AS k, g AS p, subroot AS h, (SELECT count(*) FROM s) AS n FROM s UNION ALL SELECT k + 1, p // 2, sha256(string_agg(h, '' ORDER BY p)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY k, p // 2, n),
    i AS (SELECT r.g, r.p, list(CASE WHEN x.h IS NULL THEN '' WHEN (r.p >> t.k) % 2 = 1 THEN 'L' || x.h ELSE 'R' || x.h END ORDER BY t.k) AS path
        FROM r JOIN t ON t.g = r.g AND t.p = r.p >> t.k AND t.n > 1 LEFT JOIN t x ON x.g = t.g AND x.k = t.k AND x.p = xor(t.p, 1) GROUP BY r.g, r.p),
    o AS (SELECT s.g, list(CASE WHEN x.h IS NULL THEN '' WHEN (s.g >> u.k) % 2 = 1 THEN 'L' || x.h ELSE 'R' || x.h END ORDER BY u.k) AS path
        FROM s JOIN u ON u.p = s.g >> u.k AND u.n > 1 LEFT JOIN u x ON x.k = u.k AND x.p = xor(u.p, 1) GROUP BY s.g),
    f AS (SELECT doc_id, leaf, told, subroot, (SELECT h FROM u WHERE n = 1) AS root, list_concat(coalesce(i.path, []), coalesce(o.path, [])) AS path
        FROM r JOIN s ON s.g = r.g LEFT JOIN i ON i.g = r.g AND i.p = r.p LEFT JOIN o ON o.g = r.g),
    v AS (SELECT *, list_reduce(list_prepend(told, path), {_STEP}) AS folded_root FROM f)
    SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: substr(s, 2)), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM v"""

ORACLES: dict[str, str] = {
    "op1_chat": _CHAT,
    "op2_licenses": _LICENSES,
    "op5_warc": _WARC,
    "op11_ranked": _RANKED,
    "op12_merkle": _MERKLE,
    "op8_contamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
        bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
               FROM b WHERE len(w) > 0),
        n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
        ds AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM d)
        SELECT doc_id, item_id, count(*) AS shared, any_value(n_shingles) AS n_shingles, count(*) / any_value(n_shingles) AS containment
        FROM ds JOIN bs USING (s) JOIN n USING (item_id)
        GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_shingles) - 1e-9""",
}
