"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontamination, hilbert_pack, html_text, language_id, orc_tokens, parity_join, pii, sharding, topk, toxicity

_TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

#: Shingles as text, pairs that share one, and components by reachability.
_JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM w),
sized AS (SELECT doc_id, len(s) AS n FROM sets),
each AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reach AS (SELECT a AS doc_id, a AS r FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT sized.doc_id, n AS n_shingles, coalesce(m, sized.doc_id) AS component_id FROM sized LEFT JOIN (SELECT doc_id, min(r) AS m FROM reach GROUP BY 1) x ON x.doc_id = sized.doc_id
"""


def queries() -> dict:
    return {
        "op1_hilbert_packing": hilbert_pack.op1,
        "op2_orc_token_ids": orc_tokens.op2,
        "op3_noisy_channel_toxicity": toxicity.op3,
        "op4_parity_sketch_join": parity_join.op4,
        "op5_external_shuffle": sharding.op5,
        "op6_cross_parsing_language": language_id.op6,
        "op7_benchmark_leaks": decontamination.op7,
        "op8_exact_top_k": topk.op8,
        "op9_line_block_text": html_text.op9,
        "op10_weakly_supervised_pii": pii.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_parity_sketch_join": _JACCARD, "op8_exact_top_k": _TOP_K}
