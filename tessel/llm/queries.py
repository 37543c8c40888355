"""The registered queries of this subpackage: each applies one operator, with its production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, filter_audit, fingerprints, jaccard, licenses, mixing, packing, quality, substrings, token_count, topk, training_order, vector_dedup
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return got.select("doc_id", "source", *(F.col(f"__{c}").alias(c) for c in ("block", "release", "deadline", "slot", "position")))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.link_vectors(table(spark, sf_dir, "embeddings"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.in_training_order(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(table(spark, sf_dir, "documents"), 3, 90)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = packing.pack(table(spark, sf_dir, "documents"), "word_bpe_49k.json")
    return got.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of rows whose crc32(doc_id as text) mod 5 is 0 are held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = quality.score(docs, quality.fit(docs, labels.where(~out)))
    return got.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.cut_repeats(table(spark, sf_dir, "documents"), 50, digest=True)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_source_mixing": op2_source_mixing,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_training_order": op5_training_order,
    "op6_exact_topk": op6_exact_topk,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_packing": op8_packing,
    "op9_quality": op9_quality,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_fingerprints": op13_fingerprints,
}

_COMPONENTS = """, ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), reach(i, j) AS (SELECT a, b FROM ways UNION SELECT r.i, e.b FROM reach r JOIN ways e ON r.j = e.a),
  low AS (SELECT i, min(j) AS lo FROM reach GROUP BY i)"""



def _edit(path: str, letter: str, cost: str, adds: str = "''") -> str:
    """SQL of a path and one edit more: k is the cost (six digits) and the audit, t the repaired rows; null paths stay null."""
    return f"if({path} IS NULL, NULL, {{'k': lpad((left({path}.k, 6)::INT + {cost})::VARCHAR, 6, '0') || {path}.k[7:] || '{letter}', 't': {path}.t || {adds}}})"


def _templates() -> str:
    """The license templates as rows (template, phrase, label, base) of SQL."""
    return ", ".join(f"({i}, '{' '.join(t.words)}', '{t.label}', {str(t.base).lower()})" for i, t in enumerate(licenses.known_templates()))


#: Counting tokens, hashing ids and learned models can't be written in SQL; those queries are tested against the tokenizers library, exact round trips, brute force and held-out rows.
ORACLES: dict[str, str] = {
    "op3_embedding_dedup": """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings WHERE label IS NOT NULL),
  links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.98)"""
    + _COMPONENTS
    + """, n AS (SELECT a, count(*) AS n FROM ways GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(lo, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(lo, e.vec_id)) AS kept FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN low ON low.i = e.vec_id""",
    "op4_license_scan": r"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  t AS (SELECT template, string_split(phrase, ' ') AS w, label, base FROM (VALUES """
    + _templates()
    + r""") t(template, phrase, label, base)),
  tg AS (SELECT template, label, base, len(w) AS length, p, w[p + 1] AS a, w[p + 2] AS b FROM (SELECT *, unnest(range(len(w) - 1)) AS p FROM t)),
  g AS (SELECT row, x[1] AS a, x[2] AS b, x[3] AS pos FROM (SELECT row, unnest(list_zip(w[1:len(w) - 1], w[2:len(w)], range(len(w) - 1))) AS x FROM d WHERE len(w) > 1)),
  v AS (SELECT row, template, label, base, length, pos - p AS diagonal, bit_or(1::BIGINT << p) AS mask, min(pos) AS lo, max(pos) AS hi FROM g JOIN tg USING (a, b) GROUP BY ALL),
  i AS (SELECT *, sum(new) OVER (PARTITION BY row, template ORDER BY diagonal) AS island FROM (SELECT *, if(NOT base AND diagonal - lag(diagonal) OVER (PARTITION BY row, template ORDER BY diagonal) <= 3, 0, 1) AS new FROM v)),
  s AS (SELECT row, template, label, base, length, island, bit_count(bit_or(mask)) / (length - 1) AS covered, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY row, template, label, base, length, island),
  k AS (SELECT * FROM s WHERE covered >= if(base OR length < 12, 1.0, 0.8) AND (base OR hi - lo + 2 <= length * 1.25 + 3)),
  n AS (SELECT row, count(*) FILTER (base) AS n_base, min(lo) FILTER (base) AS first_word, max(lo) FILTER (base) AS last_word, array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(covered) AS score FROM k GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN n USING (row)""",
    "op6_exact_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS t FROM embeddings),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.t, c.t) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s) WHERE rank <= 20""",
    "op7_jaccard_join": """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM w WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id), shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
  links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common))"""
    + _COMPONENTS
    + """ SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(lo, d.doc_id)) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.i = d.doc_id""",
    "op11_filter_audit": r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents), low AS (SELECT text, min(doc_id) AS lo FROM d GROUP BY text),
  l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id), w AS (SELECT d.*, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
  m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > lo, false)::INT AS m FROM w JOIN low USING (text) LEFT JOIN l USING (doc_id)),
  f(f, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
  o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
  s AS (SELECT filter_order, k::INT AS step, bits[k] AS bit, list_sum([0] || bits[1:k - 1])::INT AS before FROM o, range(1, 6) r(k)),
  c AS (SELECT part, m, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM m GROUP BY part, m)
SELECT part, filter_order, step, sum(if(m & (bit | before) = 0, n, 0))::BIGINT AS kept, sum(if(m & bit <> 0 AND m & before = 0, n, 0))::BIGINT AS removed, sum(if(m & bit <> 0 AND m & before <> 0, n, 0))::BIGINT AS redundant,
  sum(if(m = bit, n, 0))::BIGINT AS unique_fails, sum(if(m & bit <> 0 AND m & before = 0, good, 0))::BIGINT AS good_lost, sum(if(m & bit <> 0 AND m & before = 0, toxic, 0))::BIGINT AS toxic_lost,
  sum(if(m & bit <> 0, n * 120 // greatest(bit_count(m), 1), 0))::BIGINT AS shapley FROM c, s GROUP BY part, filter_order, step""",
    # the cheapest path to each state, a row of the conversation at a time
    "op12_conversation_repair": r"""WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
  z AS (SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(k, ''), lambda x: ord(x)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, y: xor(a >> 1, (a & 1) * 3988292384))), 4294967295) % 20 AS kind FROM o),
  r AS (SELECT conv_id, turn, if(kind = 4, 'user', role) AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy FROM z, range(2) c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
  n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, rtrim(text, E' \t\n\x0b\x0c\r') AS shown FROM r),
  g AS (SELECT *, left(role, 1) AS c, shown = '' AS blank, shown <> '' AND again AS dup, shown <> '' AND NOT again AND right(shown, 1) NOT IN ('.', '!', '?') AS cut, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM n),
  p AS (SELECT conv_id, 0 AS i, {'k': '000000', 't': ''} AS s0, NULL::STRUCT(k VARCHAR, t VARCHAR) AS s1, {'k': '000005I', 't': E'user:\n'} AS s2, {'k': '000010II', 't': E'user:\nassistant:\n'} AS s3 FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL SELECT conv_id, i, a0, a1, s2, least(a3, """
    + _edit("s2", "I", "5", r"E'assistant:\n'")
    + """) FROM (SELECT *, least(a2, """
    + _edit("best", "I", "5", r"E'user:\n'")
    + """) AS s2 FROM (SELECT *, least(a0, a1, a3) AS best FROM (SELECT conv_id, i, """
    + _edit("s0", "D", "2")
    + """ AS a0, least("""
    + _edit("s1", "D", "2")
    + """, if(stay AND c = 's', """
    + _edit("s0", "K", "more", "own")
    + """, NULL)) AS a1, least("""
    + _edit("s2", "D", "2")
    + """, if(stay AND c = 'u', """
    + _edit("b", "K", "more", "own")
    + """, NULL), if(stay, """
    + _edit("b", "R", "1 + more", r"'user:' || text || E'\n'")
    + """, NULL)) AS a2, least("""
    + _edit("s3", "D", "2")
    + """, if(stay AND c = 'a', """
    + _edit("s2", "K", "more", "own")
    + """, NULL), if(stay, """
    + _edit("s2", "R", "1 + more", r"'assistant:' || text || E'\n'")
    + r""", NULL)) AS a3 FROM (SELECT p.conv_id, g.i::INT AS i, s0, s1, s2, s3, least(s0, s1, s3) AS b, c, text, role || ':' || text || E'\n' AS own, NOT (blank OR dup) AS stay, if(cut, 5, 0) AS more FROM p JOIN g ON g.i = p.i + 1 AND g.conv_id IS NOT DISTINCT FROM p.conv_id))))),
  e AS (SELECT conv_id, least(arg_max(s0, i), arg_max(s3, i)) AS best FROM p GROUP BY conv_id),
  f AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count_if(blank) AS blank, count_if(dup) AS duplicate, count_if(cut) AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  left(best.k, 6)::BIGINT AS cost, best.k[7:] AS audit, sha256(best.t[:-2]) AS repaired_sha256 FROM e LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM e.conv_id""",
    "op13_fingerprints": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), n AS (SELECT *, length(text) AS n, coalesce(lead(text) OVER w, first_value(text) OVER w) AS nxt, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS nid FROM d WINDOW w AS (ORDER BY doc_id DESC)),
  e AS (SELECT *, left(text, n - n // 3) || left(nxt, n // 3) AS edited FROM n),
  t AS (SELECT doc_id, kind, list_transform(string_split(x, E'\n\n'), lambda s: list_transform(string_split(s, E'\n'), lambda p: list_transform(string_split(regexp_replace(p, '([.,;:!?] )', '\1' || chr(1), 'g'), chr(1)), lambda l: md5(l)))) AS t
    FROM (SELECT doc_id, 'own' AS kind, text AS x FROM e UNION ALL SELECT doc_id, 'edited', edited FROM e)),
  h AS (SELECT doc_id, kind, list_transform(t, lambda s: list_transform(s, lambda p: {'h': md5(array_to_string(p, '')), 'l': p})) AS t FROM t),
  f AS (SELECT doc_id, kind, list_transform(t, lambda s: {'h': md5(array_to_string(list_transform(s, lambda p: p.h), '')), 'p': s}) AS t, list_distinct(list_transform(flatten(list_transform(flatten(t), lambda p: p.l)), lambda l: left(l, 8))) AS leaves FROM h),
  g AS (SELECT doc_id, kind, t, leaves, sha256(array_to_string(list_transform(t, lambda s: s.h), '')) || array_to_string(list_transform(t, lambda s: '/' || left(s.h, 16) || array_to_string(list_transform(s.p, lambda p: '.' || left(p.h, 12) || array_to_string(list_transform(p.l, lambda l: '-' || left(l, 8)), '')), '')), '') AS fp FROM f),
  k AS (SELECT e.doc_id, e.n, e.edited, a.fp, b.fp AS efp, c.fp AS nfp, a.leaves AS al, b.leaves AS bl, c.leaves AS cl, list_transform(a.t, lambda s: left(s.h, 16)) AS sections, list_transform(flatten(list_transform(a.t, lambda s: s.p)), lambda p: left(p.h, 12)) AS lines, b.t AS bt
    FROM e JOIN g a ON a.doc_id = e.doc_id AND a.kind = 'own' JOIN g b ON b.doc_id = e.doc_id AND b.kind = 'edited' JOIN g c ON c.doc_id = e.nid AND c.kind = 'own')
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, fp AS fingerprint, efp AS edited_fingerprint,
  if(left(fp, 64) = left(efp, 64), 1.0::DOUBLE, least(2.0::DOUBLE * len(list_intersect(al, bl)) / (len(al) + len(bl)), 1 - 1.0::DOUBLE / (len(al) + len(bl)))) AS near_edited,
  if(left(fp, 64) = left(nfp, 64), 1.0::DOUBLE, least(2.0::DOUBLE * len(list_intersect(al, cl)) / (len(al) + len(cl)), 1 - 1.0::DOUBLE / (len(al) + len(cl)))) AS near_next,
  coalesce(if(left(fp, 64) = left(efp, 64), '', flatten(list_transform(bt, lambda s, i: if(list_contains(sections, left(s.h, 16)), [], list_filter(list_transform(s.p, lambda p, j: if(list_contains(lines, left(p.h, 12)), '', (i - 1) || '.' || (j - 1))), lambda x: x <> ''))))[1]), '') AS edited_at FROM k""",
}
