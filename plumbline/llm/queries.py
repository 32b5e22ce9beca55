"""One query for each operator: ``opN_<name>`` over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import byte_bpe, decontamination, exact_dedup, jaccard_join, language_id, lexical_search, lm_scoring, packing, pii, repair, sharding, substring_dedup, toxicity
from plumbline.llm.frames import fold

#: Which public vocabulary op6 and the pipeline encode with.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Which public vocabulary op11 packs with.
WORDS = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(folds: int, which: int) -> Column:
    return (fold("doc_id", folds) == which).alias("held_out")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(fold("doc_id", 3) != 1), F.col("doc_id"))
    return language_id.predict(docs, model).select("doc_id", _held_out(3, 1), "lang_pred", "score")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.clusters(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(_table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = lm_scoring.scored(docs, fold("doc_id", 7) != 2)
    return found.select("doc_id", _held_out(7, 2), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.report(docs, pii.fit(docs, F.col("doc_id")))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(_table(spark, sf_dir, "documents"), shards=16)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return toxicity.scored(docs, model).select("doc_id", _held_out(3, 1), "score", predicted)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.membership(_table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(_table(spark, sf_dir, "conversations"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_decontamination,
        op3_jaccard_join,
        op4_substring_dedup,
        op5_lm_scoring,
        op6_byte_bpe,
        op7_pii,
        op8_sharding,
        op9_toxicity,
        op10_exact_dedup,
        op11_packing,
        op12_conversation_repair,
        op13_lexical_search,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_BENCH_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SHINGLE_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x20\x09-\x0D]+')"
_TERMS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_SPACE_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": f"""
        WITH d AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents),
             b AS (SELECT item_id, {_BENCH_WORDS} AS w FROM benchmark),
             win AS (SELECT DISTINCT item_id, w[i : i + least(13, len(w)) - 1] AS words
                     FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
             lens AS (SELECT DISTINCT len(words) AS n FROM win),
             dw AS (SELECT doc_id, i, n, w[i : i + n - 1] AS words
                    FROM d, lens, unnest(range(1, len(w) - n + 2)) AS t(i)),
             hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN win USING (words)),
             cover AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit
                       FROM (SELECT DISTINCT doc_id, i, n FROM hit), unnest(range(0, n)) AS t(k) GROUP BY doc_id),
             item AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
                      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN item USING (doc_id)""",
    "op3_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_SHINGLE_WORDS} AS w FROM documents),
             s AS (SELECT DISTINCT doc_id, w[i : i + least(3, len(w)) - 1] AS x
                   FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(i) WHERE len(w) > 0),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
                   FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
             link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
                      WHERE 100 * common >= 90 * (x.n + y.n - common)),
             reach AS (SELECT doc_id AS a, doc_id AS b FROM d
                       UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
        FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)""",
    "op4_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_SPACE_WORDS} AS w FROM documents),
             win AS (SELECT doc_id, i, w[i : i + 19] AS words FROM d, unnest(range(1, len(w) - 18)) AS t(i)),
             early AS (SELECT words, min((doc_id, i)) AS first FROM win GROUP BY words HAVING count(*) > 1),
             gone AS (SELECT DISTINCT doc_id, i + k AS i
                      FROM (SELECT doc_id, i FROM win JOIN early USING (words) WHERE (doc_id, i) > first),
                           unnest(range(0, 20)) AS t(k)),
             each AS (SELECT doc_id, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
             kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS body
                      FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op10_exact_dedup": f"""
        WITH t AS (SELECT doc_id, coalesce({_LOWER.format("text")}, '') AS body FROM documents),
             w AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
        SELECT t.doc_id, w.keep_id, w.group_size,
               t.doc_id IS NOT DISTINCT FROM w.keep_id
                 AND row_number() OVER (PARTITION BY t.body, t.doc_id) = 1 AS kept,
               sha256(t.body) AS text_sha256
        FROM t JOIN w ON t.body = w.body""",
    "op12_conversation_repair": r"""
        WITH RECURSIVE
             tab AS (SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
             crc AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
             drawn AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                              xor(list_reduce([4294967295] || list_transform(range(strlen(k)), lambda i: CAST(ascii(k[i + 1]) AS BIGINT)),
                                              lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS draw FROM crc, tab),
             turned AS (SELECT conv_id, turn, CASE draw WHEN 4 THEN 'user' ELSE role END AS role,
                            CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
                     FROM drawn, unnest(range(CASE draw WHEN 3 THEN 2 ELSE 1 END)) WHERE draw <> 0),
             placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, left(role, 1) AS r, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS z FROM turned),
             fault AS (SELECT *, CASE WHEN z = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN z NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS f,
                              lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r NOT IN ('su', 'ua', 'au') AS odd FROM placed),
             dp(conv_id, i, p0, p1, p2, p3) AS (
                 SELECT conv_id, CAST(0 AS BIGINT), {'c': 0, 'a': '', 'b': CAST([] AS VARCHAR[])}, NULL::STRUCT(c INT, a VARCHAR, b VARCHAR[]),
                        {'c': 5, 'a': 'I', 'b': ['user:']}, {'c': 10, 'a': 'II', 'b': ['user:', 'assistant:']} FROM (SELECT DISTINCT conv_id FROM fault)
                 UNION ALL
                 SELECT conv_id, i, c0, c1, c2,
                        list_min(list_filter([c3, {'c': c2.c + 5, 'a': c2.a || 'I', 'b': c2.b || ['assistant:']}], lambda x: x IS NOT NULL))
                 FROM (SELECT conv_id, i, c0, c1, c3,
                              list_min(list_filter([k2] || list_transform(list_filter([c0, c1, c3], lambda x: x IS NOT NULL), lambda x: {'c': x.c + 5, 'a': x.a || 'I', 'b': x.b || ['user:']}), lambda x: x IS NOT NULL)) AS c2
                       FROM (SELECT conv_id, i, d[1] AS c0,
                                    list_min(list_filter([d[2], CASE WHEN NOT gone AND r = 's' THEN {'c': p0.c + e, 'a': p0.a || 'K', 'b': p0.b || [role || ':' || text]} END], lambda x: x IS NOT NULL)) AS c1,
                                    list_min(list_filter([d[3]] || list_transform(list_filter([p0, p1, p3], lambda x: NOT gone AND x IS NOT NULL),
                                        lambda x: CASE WHEN r = 'u' THEN {'c': x.c + e, 'a': x.a || 'K', 'b': x.b || [role || ':' || text]} ELSE {'c': x.c + e + 1, 'a': x.a || 'R', 'b': x.b || ['user:' || text]} END), lambda x: x IS NOT NULL)) AS k2,
                                    list_min(list_filter([d[4], CASE WHEN gone THEN NULL WHEN r = 'a' THEN {'c': p2.c + e, 'a': p2.a || 'K', 'b': p2.b || [role || ':' || text]}
                                        ELSE {'c': p2.c + e + 1, 'a': p2.a || 'R', 'b': p2.b || ['assistant:' || text]} END], lambda x: x IS NOT NULL)) AS c3
                             FROM (SELECT dp.*, fault.role, fault.text, fault.r, fault.i AS here, f IN ('blank', 'duplicate') AS gone, CASE f WHEN 'truncated' THEN 5 ELSE 0 END AS e,
                                          list_transform([p0, p1, p2, p3], lambda x: CASE WHEN x IS NOT NULL THEN {'c': x.c + 2, 'a': x.a || 'D', 'b': x.b} END) AS d
                                   FROM dp JOIN fault ON fault.conv_id IS NOT DISTINCT FROM dp.conv_id AND fault.i = dp.i + 1) AS step(conv_id, before, p0, p1, p2, p3, role, text, r, i, gone, e, d)))),
             ended AS (SELECT conv_id, least(p0, p3) AS best FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS back FROM dp) WHERE back = 1),
             counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'blank') AS blank,
                                count(*) FILTER (f = 'duplicate') AS duplicate, count(*) FILTER (f = 'truncated') AS truncated, count(*) FILTER (odd) AS illegal FROM fault GROUP BY conv_id)
        SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, coalesce(CAST(best.c AS BIGINT), 0) AS cost, coalesce(best.a, '') AS audit,
               sha256(coalesce(array_to_string(best.b, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM i.conv_id
             LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM i.conv_id""",
    "op13_lexical_search": f"""
        WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
             b AS (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
             q AS (SELECT item_id, term, count(*) AS q FROM b GROUP BY ALL),
             size AS (SELECT count(*) AS docs, sum(len(w)) AS terms FROM d WHERE len(w) > 0),
             p AS (SELECT doc_id, place, n, term, count(*) AS tf
                   FROM (SELECT doc_id, place, len(w) AS n, unnest(w) AS term FROM (SELECT *, row_number() OVER () AS place FROM d)) GROUP BY ALL),
             df AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS weight FROM p, size GROUP BY term, docs),
             s AS (SELECT item_id, doc_id, place, CAST(sum(q * weight * (1000000000 * tf // (1000 * tf + 8 * (25 + 75 * n * docs // terms)))) AS BIGINT) AS score
                   FROM q JOIN p USING (term) JOIN df USING (term), size GROUP BY item_id, doc_id, place)
        SELECT item_id, rank, doc_id, score
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0) WHERE rank <= 10""",
}
