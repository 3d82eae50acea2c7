"""The opN_ queries: each operator over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(spark, table(spark, sf_dir, "documents"), shingle=3, threshold=85)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import leaks

    return leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import score_documents

    return score_documents(spark, table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(spark, table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(spark, table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_report

    return substring_report(spark, table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_report

    return secret_report(spark, table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import severity

    return severity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_report

    return suffix_report(spark, table(spark, sf_dir, "documents"))


def op11_schema_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .drift import drifted_clients

    return drifted_clients(spark, table(spark, sf_dir, "clients"))


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearest import nearest

    return nearest(spark, table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_in_middle import fill_in_middle_report

    return fill_in_middle_report(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_minhash, op2_decontamination, op3_lm_scoring, op4_language_id, op5_exact_dedup, op6_substring_dedup, op7_packing, op8_secret_scans, op9_toxicity, op10_suffix_dedup, op11_schema_rewrite, op12_nearest, op13_fill_in_middle)
}

_SPLIT = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op5_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               coalesce(doc_id = min(doc_id) OVER w OR count(*) OVER w = 1, false) AS kept, sha256(n) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY n)
    """,
    "op1_minhash": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, {_SPLIT.format(_LOWER)} AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
        u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT a AS x, b AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y),
        m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m.y, s.doc_id)) AS component_id, coalesce(m.y, s.doc_id) >= s.doc_id AS kept FROM s LEFT JOIN m ON m.x = s.doc_id
    """,
    "op6_substring_dedup": rf"""
        WITH w AS (SELECT doc_id, {_SPLIT.format("coalesce(text, '')")} AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
        f AS (SELECT doc_id, i, word, CASE WHEN i + 19 <= len(w) THEN row_number() OVER (PARTITION BY array_to_string(w[i : i + 19], ' '), i + 19 <= len(w) ORDER BY doc_id, i) > 1 ELSE false END AS again FROM p),
        c AS (SELECT doc_id, i, word, coalesce(max(CASE WHEN again THEN i END) OVER (PARTITION BY doc_id ORDER BY i) > i - 20, false) AS gone FROM f),
        g AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id)
        SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256 FROM w LEFT JOIN g USING (doc_id)
    """,
    "op10_suffix_dedup": r"""
        WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        p AS (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS i FROM h),
        k AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS b, CASE WHEN 2 * i + 800 <= length(h) THEN hash(substr(h, 2 * i + 1, 800)) END AS k FROM p),
        o AS (SELECT k FROM k WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1), f AS (SELECT doc_id, i, b, o.k IS NOT NULL AS again FROM k LEFT JOIN o USING (k)),
        c AS (SELECT doc_id, i, b, coalesce(max(CASE WHEN again THEN i END) OVER (PARTITION BY doc_id ORDER BY i) > i - 400, false) AS gone FROM f),
        s AS (SELECT doc_id, i, b, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM c),
        g AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n, count(*) FILTER (WHERE begins) AS spans, string_agg(b, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM s GROUP BY doc_id)
        SELECT h.doc_id, (length(h.h) // 2)::BIGINT AS n_bytes, coalesce(g.n, 0)::BIGINT AS n_removed, coalesce(g.spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(g.kept, ''))) AS kept_sha256 FROM h LEFT JOIN g USING (doc_id)
    """,
    "op13_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS h FROM d),
        c AS (SELECT doc_id, t, u, len(u)::BIGINT AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
              CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
        p AS (SELECT *, coalesce(array_to_string(u[1 : a], ''), '') AS p, coalesce(array_to_string(u[a + 1 : b], ''), '') AS m, coalesce(array_to_string(u[b + 1 :], ''), '') AS s FROM c),
        o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o FROM p)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars, sha256(o) AS output_sha256, sha256(t) AS restored_sha256 FROM o
    """,
}
