"""The queries of this package: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, conversation_trie, html_extract, langid_ppm, lbl_lm, license_scan, line_dedup, lpf_dedup, media_ts, ngram_join, packing
from .common import table
from .exact_dedup import exact_dedup
from .mixing import mix_sources


def op1_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid_ppm.held_out("doc_id", 4, 2)
    trees = langid_ppm.fit(docs.where(~out))
    return langid_ppm.predict(docs, trees, pass_cols=[F.col("doc_id"), out.alias("held_out")])


def op3_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid_ppm.held_out("doc_id", 10, 0)
    return lbl_lm.lm_scores(docs, ~out, pass_cols=[F.col("doc_id"), out.alias("held_out")])


def op4_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    read = media_ts.with_media(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), media_ts.media_info(F.col("media")).alias("info"))
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    return read.select("doc_id", "n_bytes", *[F.col(f"info.{x}").alias(x) for x in names], media_ts.feature_string().alias("feature"))


def op5_previous_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpf_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op6_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(packing.token_pieces(docs))


def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.near_lines(table(spark, sf_dir, "documents"))


def op8_content_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact_dedup(docs, keep="max").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_lsh_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_classes(table(spark, sf_dir, "documents"))


def op10_water_filling_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.turns_in_order(table(spark, sf_dir, "conversations"))
    first = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    return conversation_trie.prefix_trie(*conversation_trie.spliced(turns, first))


def op12_bucket_queue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    mode = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    return conversation_repair.repair(conversation_repair.damaged(rows, mode), rows)


def op13_template_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    base, own = F.col("phrase_places"), F.col("template_places")
    starts = F.transform(base, lambda x: x["start"])
    labels = lambda places: F.array_sort(F.array_distinct(F.transform(places, lambda x: x["label"])))
    both = F.concat(base, own)
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), F.array_join(labels(base), ",").alias("base_labels"),
        F.array_join(labels(both), ",").alias("labels"), F.coalesce(F.array_max(F.transform(both, lambda x: x["share"])), F.lit(0.0)).alias("score"), own.alias("places"),
    )


QUERIES = {
    "op1_block_rules": op1_block_rules,
    "op2_ppm_language": op2_ppm_language,
    "op3_log_bilinear": op3_log_bilinear,
    "op4_transport_stream": op4_transport_stream,
    "op5_previous_factors": op5_previous_factors,
    "op6_vector_best_fit": op6_vector_best_fit,
    "op7_fuzzy_lines": op7_fuzzy_lines,
    "op8_content_sort_dedup": op8_content_sort_dedup,
    "op9_lsh_forest_join": op9_lsh_forest_join,
    "op10_water_filling_mix": op10_water_filling_mix,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_bucket_queue_repair": op12_bucket_queue_repair,
    "op13_template_licenses": op13_template_licenses,
}


def crc32_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of an expression of ASCII characters, bit by bit."""
    step = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    codes = f"list_transform(string_split({text}, ''), lambda z: CAST(ord(z) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {step}), 4294967295)"


ORACLE_SQL = {
    "op12_bucket_queue_repair": rf"""
        WITH RECURSIVE damage AS (
            SELECT conv_id, turn, {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS mode, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text
            FROM conversations WHERE conv_id IS NOT NULL
        ), hurt AS (
            SELECT conv_id, turn, CASE mode WHEN 4 THEN 'user' ELSE role END AS role, CASE mode WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM damage, range(2) r(k) WHERE mode <> 0 AND (k = 0 OR mode = 3)
        ), rowed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
                   rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS body
            FROM hurt
        ), marked AS (
            SELECT *, left(role, 1) AS r, CASE WHEN body = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
                   lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before
            FROM rowed
        ), best AS (
            SELECT DISTINCT conv_id, n AS i, [{{'c': 0, 'a': ''}}, {{'c': 6, 'a': 'II'}}, {{'c': 3, 'a': 'I'}}, {{'c': 0, 'a': ''}}] AS v FROM marked
            UNION ALL
            SELECT conv_id, i - 1, [list_min([b[1], {{'c': b[3].c + 3, 'a': 'I' || b[3].a}}, {{'c': b[4].c + 6, 'a': 'II' || b[4].a}}]), list_min([b[2], {{'c': b[3].c + 3, 'a': 'I' || b[3].a}}, {{'c': b[4].c + 6, 'a': 'II' || b[4].a}}]),
                                    list_min([b[3], {{'c': b[4].c + 3, 'a': 'I' || b[4].a}}]), list_min([b[4], {{'c': b[3].c + 3, 'a': 'I' || b[3].a}}])]
            FROM (
                SELECT x.conv_id, x.i, list_transform([1, 2, 3, 4], lambda q: list_min([
                    {{'c': v[q].c + 4, 'a': 'D' || v[q].a}},
                    {{'c': CASE WHEN fault IN (1, 2) THEN 1000000000 ELSE v[[3, 3, 4, 3][q]].c + 3 + CASE fault WHEN 3 THEN 3 ELSE 0 END END, 'a': 'R' || v[[3, 3, 4, 3][q]].a}},
                    {{'c': CASE WHEN fault IN (1, 2) OR NOT (r = 's' AND q = 1 OR r = 'u' AND q <> 3 OR r = 'a' AND q = 3) THEN 1000000000
                                ELSE v[CASE r WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].c + CASE fault WHEN 3 THEN 3 ELSE 0 END END, 'a': 'K' || v[CASE r WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].a}}
                ])) AS b
                FROM best x JOIN marked m ON m.conv_id = x.conv_id AND m.pos = x.i
            )
        ), priced AS (
            SELECT conv_id, v[1].c AS cost, v[1].a AS audit FROM best WHERE i = 0
        ), steps AS (
            SELECT conv_id, audit, 0 AS k, CAST(0 AS BIGINT) AS i, 1 AS q, CAST([] AS VARCHAR[]) AS made FROM priced
            UNION ALL
            SELECT s.conv_id, audit, k + 1, CASE WHEN audit[k + 1] = 'I' THEN i ELSE i + 1 END,
                   CASE audit[k + 1] WHEN 'D' THEN q WHEN 'K' THEN CASE m.r WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END ELSE [3, 3, 4, 3][q] END,
                   CASE audit[k + 1] WHEN 'D' THEN made WHEN 'K' THEN made || [m.role || ':' || m.text] WHEN 'I' THEN made || [['user', 'user', 'assistant', 'user'][q] || ':'] ELSE made || [['user', 'user', 'assistant', 'user'][q] || ':' || m.text] END
            FROM steps s LEFT JOIN marked m ON m.conv_id = s.conv_id AND m.pos = s.i + 1 WHERE k < length(audit)
        ), sums AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
                   count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal
            FROM marked GROUP BY conv_id
        )
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(p.audit, '') AS audit, sha256(coalesce(array_to_string(made, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL) c LEFT JOIN sums USING (conv_id) LEFT JOIN priced p USING (conv_id)
        LEFT JOIN (SELECT conv_id, made FROM steps WHERE k = length(audit)) USING (conv_id)
    """,
    "op11_prefix_trie": rf"""
        WITH convs AS (
            SELECT conv_id, CAST({crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS BIGINT) AS h FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
        ), turns AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
            FROM conversations WHERE conv_id IS NOT NULL
        ), rebuilt AS (
            SELECT c.conv_id, 0 AS own, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.pos <= c.h
            UNION ALL
            SELECT c.conv_id, 1, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h
        ), prefixes AS (
            SELECT conv_id, row_number() OVER w AS depth, list({{'role': role, 'text': text}}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path, text,
                   count(*) OVER (PARTITION BY conv_id) AS turns
            FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos)
            UNION ALL
            SELECT conv_id, 0, [], '', (SELECT count(*) FROM rebuilt r WHERE r.conv_id = c.conv_id) FROM convs c
        ), member AS (
            SELECT conv_id AS c, depth, turns, min(conv_id) OVER (PARTITION BY depth, path) AS node, CAST(len(regexp_extract_all(text, '[^ 	-
]+')) AS BIGINT) AS words FROM prefixes
        ), nodes AS (
            SELECT node, depth, CAST(count(*) AS BIGINT) AS n_convs, any_value(words) AS words,
                   string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (turns = depth) AS ends
            FROM member GROUP BY node, depth
        ), edges AS (
            SELECT n.*, m.node AS parent FROM nodes n LEFT JOIN member m ON m.c = n.node AND m.depth = n.depth - 1
        ), children AS (
            SELECT parent, depth - 1 AS depth, count(*) AS n FROM edges WHERE depth > 0 GROUP BY ALL
        ), valued AS (
            SELECT e.*, coalesce(c.n, 0) AS n_children FROM edges e LEFT JOIN children c ON c.parent = e.node AND c.depth = e.depth
        ), sums AS (
            SELECT a.node, a.depth, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((v.n_convs - 1) * v.words) AS saved
            FROM valued v JOIN member a ON a.c = v.node AND a.depth <= v.depth GROUP BY ALL
        )
        SELECT v.node AS conv_id, v.depth, v.parent AS parent_conv_id, v.n_convs, CAST(v.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
               CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
        FROM valued v JOIN sums s USING (node, depth)
    """,
    "op8_content_sort_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
    "op10_water_filling_mix": r"""
        WITH sizes AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                   md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
            FROM documents
        ), src AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source
        ), weighted AS (
            SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w,
                   CAST(sum(source_size) OVER () AS DOUBLE) AS total, CAST(source_size AS DOUBLE) * 3.0::DOUBLE AS cap
            FROM src
        ), ordered AS (
            SELECT *, row_number() OVER o AS pos,
                   (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                   / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM weighted WINDOW o AS (ORDER BY cap / w, source NULLS LAST)
        ), water AS (
            SELECT min(pos) AS first_free, arg_min(level, pos) AS water FROM ordered WHERE level * w < cap
        ), targets AS (
            SELECT source, source_size, CASE WHEN pos >= first_free THEN water * w ELSE cap END AS target FROM ordered, water
        ), epochs AS (
            SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets
        ), running AS (
            SELECT s.doc_id, s.size, e.source_size, e.target, e.whole, e.target - e.whole * e.source_size AS want,
                   sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
            FROM sizes s JOIN epochs e ON s.source IS NOT DISTINCT FROM e.source
        )
        SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN upto - size / 2.0 <= want THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM running
    """,
}
