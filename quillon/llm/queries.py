"""The registered queries of the training-data operators, opN_<name>, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, dialogue, divergence, fingerprint, hosts, langid, minhash, packing, sharding, suffix, toxicity, vectors, warc
from quillon.llm.common import table, tune


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 4096)


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), 0.98)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removal_report(table(spark, sf_dir, "documents"), 400, suffix.PASSAGE)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_documents(table(spark, sf_dir, "documents"), 3, 85)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), 40)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.host_verdicts(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.reports(dialogue.damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_vectors": op2_vectors,
    "op3_bpe": op3_bpe,
    "op4_suffix": op4_suffix,
    "op5_warc": op5_warc,
    "op6_minhash": op6_minhash,
    "op7_langid": op7_langid,
    "op8_fingerprint": op8_fingerprint,
    "op9_sharding": op9_sharding,
    "op10_toxicity": op10_toxicity,
    "op11_hosts": op11_hosts,
    "op12_divergence": op12_divergence,
    "op13_dialogue": op13_dialogue,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Links of two ids (a, b), and from them the smallest id that each reaches.
_REACH = """ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS id, b AS r FROM ends UNION SELECT reach.id, ends.b FROM reach JOIN ends ON ends.a = reach.r),
least AS (SELECT id, min(r) AS r FROM reach GROUP BY id)"""

_HOST_RULES = {
    "base": "n_words < 20 OR 100 * n_repeat_words > 30 * n_words", "symbols": "10 * n_symbols > n_words",
    "lines": "100 * n_dup_lines > 30 * n_lines", "word_length": "n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 10 * n_words)",
}
#: A rule's weight of the prior, from the hosts' counts: the intraclass correlation, turned round.
_WEIGHT = """SELECT '{r}' AS rule, p, CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 1.0), 1e6) ELSE 1e6 END AS w FROM (SELECT p, CASE WHEN p * (1 - p) > 0 AND size > 0
THEN (s - f * f / n - (k - 1) * (p * (1 - p))) / (p * (1 - p) * size) ELSE 0.0 END AS rho FROM (SELECT *, f / n AS p, n - n2 / n - (k - 1) AS size
FROM (SELECT count(*)::DOUBLE AS k, sum(n::DOUBLE) AS n, sum(n::DOUBLE * n) AS n2, sum(f_{r}::DOUBLE) AS f, sum(f_{r}::DOUBLE * f_{r} / n) AS s FROM h)))"""
_HOSTS = f"""WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM t),
u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT doc_id, i, concat_ws(chr(1), x, {", ".join(f"lead(x, {k}) OVER o" for k in range(1, 8))}) AS g, lead(x, 7) OVER o AS last FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g WHERE last IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS i FROM twice WHERE n > 1) GROUP BY doc_id),
m AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
v AS (SELECT *, {", ".join(f"({c}) AS {r}" for r, c in _HOST_RULES.items())} FROM m),
h AS (SELECT source, count(*) AS n, {", ".join(f"count(*) FILTER ({r}) AS f_{r}" for r in _HOST_RULES)} FROM v WHERE source IS NOT NULL GROUP BY source),
prior AS ({" UNION ALL ".join(_WEIGHT.format(r=r) for r in _HOST_RULES)}),
rate AS (SELECT source, n, {", ".join(f"(SELECT (f_{r} + p * w) / (n + (p * w + (1 - p) * w)) FROM prior WHERE rule = '{r}') AS rate_{r}" for r in _HOST_RULES)} FROM h)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base AS base_failed,
NOT (base OR coalesce(rate_base >= 0.5, false) OR {" OR ".join(f"({r} AND coalesce(rate_{r} >= 0.2, false))" for r in list(_HOST_RULES)[1:])}) AS kept, n AS host_docs, round(rate_base, 6) AS host_rate
FROM v LEFT JOIN rate USING (source)"""

_SHARE = "1 + 1000000000::HUGEINT * ({n} + 5) // ({total} + 5 * {v})"
_DIVERGENCE = f"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
c AS (SELECT lang, source, t, count(*) AS n, count(DISTINCT k) AS docs FROM (SELECT lang, source, k, unnest(w) AS t FROM d) GROUP BY ALL),
kept AS (SELECT lang, t, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 30), langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
used AS (SELECT c.* FROM c JOIN kept USING (lang, t)), groups AS (SELECT DISTINCT lang, source FROM d), sums AS (SELECT lang, source, sum(n) AS total FROM used GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.t, coalesce(u.n, 0) AS n, {_SHARE.format(n="coalesce(u.n, 0)", total="coalesce(s.total, 0)", v="l.v")} AS p, {_SHARE.format(n="k.n", total="l.total", v="l.v")} AS q
FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.t = k.t),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
UNION ALL SELECT lang, source, 'term', t, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
ranks AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r) SELECT * FROM ranks WHERE part = 'pair' OR rank <= 50"""

#: The others have no SQL: trained models, tokenizers, a space-filling curve and byte windows are held against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op2_vectors": f"""WITH RECURSIVE links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id
WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.98), {_REACH},
n AS (SELECT a AS id, count(*) AS n FROM ends GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(least.r, vec_id)) AS component_id, vec_id <= coalesce(least.r, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.id = vec_id LEFT JOIN least ON least.id = vec_id""",
    "op5_warc": """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages), h AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM h GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31)), 1)), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM h JOIN f USING (h)""",
    "op6_minhash": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, chr(1))] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)), {_REACH}
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(least.r, doc_id)) AS component_id, doc_id <= coalesce(least.r, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.id = doc_id""",
    "op11_hosts": _HOSTS,
    "op12_divergence": _DIVERGENCE,
}
