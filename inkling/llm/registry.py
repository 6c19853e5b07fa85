"""Queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

from .ann import op13_ann
from .decontamination import op5_decontamination
from .html_extract import op2_html_extract
from .language_id import op10_language_id
from .line_dedup import op3_line_dedup
from .merkle import op12_merkle
from .packing import op6_packing
from .periodic_runs import op11_periodic_runs
from .quality import op1_quality
from .sharding import op8_sharding
from .simhash import op7_simhash
from .token_counts import op9_token_counts
from .warc import op4_warc

SQL_LINE_DEDUP = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT *, min(doc_id) OVER (PARTITION BY key) AS first_doc, length(key) >= 10 AS long_enough FROM k),
f AS (SELECT *, long_enough AND doc_id <> first_doc AS gone FROM m)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY r, doc_id
"""


SQL_WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS head FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> head THEN head END AS refers_to
FROM m
"""


SQL_MERKLE = """
WITH RECURSIVE d AS (SELECT *, row_number() OVER () AS r FROM documents),
v AS (SELECT r, doc_id, source,
             concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
                    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head, text,
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
             xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
                 lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) AS crc FROM d),
l AS (SELECT r, doc_id, source, sha256(concat(head, coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
             sha256(concat(head, CASE WHEN crc % 5 = 0 THEN coalesce(strlen(low) || ':' || low, '-') ELSE coalesce(strlen(text) || ':' || text, '-') END)) AS told FROM v),
o AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, told) - 1 AS i FROM l),
nodes AS (SELECT g, 0 AS lvl, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM o
    UNION ALL SELECT g, lvl + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 15) // 16) FROM nodes WHERE n > 1 GROUP BY g, lvl, i // 16),
subs AS (SELECT g, h AS subroot FROM nodes WHERE n = 1),
tops AS (SELECT -1::BIGINT AS g, 0 AS lvl, g AS i, subroot AS h, count(*) OVER () AS n FROM subs
    UNION ALL SELECT g, lvl + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 15) // 16) FROM tops WHERE n > 1 GROUP BY g, lvl, i // 16),
root AS (SELECT h AS root FROM tops WHERE n = 1),
runs AS (SELECT g, lvl, i // 16 AS run, string_agg(h, '' ORDER BY i) AS t FROM (SELECT * FROM nodes UNION ALL SELECT * FROM tops) WHERE n > 1 GROUP BY ALL),
walk AS (SELECT r, g, g AS own, 0 AS lvl, i, '' AS proof, told AS fold FROM o
    UNION ALL SELECT r, walk.g, own, lvl + 1, i // 16, concat(proof, substr(t, 1, 64 * (i % 16)), substr(t, 64 * (i % 16) + 65)), sha256(concat(substr(t, 1, 64 * (i % 16)), fold, substr(t, 64 * (i % 16) + 65)))
    FROM walk JOIN runs USING (g, lvl) WHERE run = i // 16),
ends AS (SELECT r, any_value(own) AS own, arg_max(proof, lvl) AS proof, arg_max(fold, lvl) AS fold FROM walk GROUP BY r),
climb AS (SELECT r, -1::BIGINT AS g, own, 0 AS lvl, own AS i, proof, fold FROM ends
    UNION ALL SELECT r, climb.g, own, lvl + 1, i // 16, concat(proof, substr(t, 1, 64 * (i % 16)), substr(t, 64 * (i % 16) + 65)), sha256(concat(substr(t, 1, 64 * (i % 16)), fold, substr(t, 64 * (i % 16) + 65)))
    FROM climb JOIN runs USING (g, lvl) WHERE run = i // 16),
told AS (SELECT r, arg_max(proof, lvl) AS proof, arg_max(fold, lvl) AS fold FROM climb GROUP BY r)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified
FROM o JOIN subs USING (g) JOIN told USING (r), root
"""


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_quality": op1_quality,
        "op2_html_extract": op2_html_extract,
        "op3_line_dedup": op3_line_dedup,
        "op4_warc": op4_warc,
        "op5_decontamination": op5_decontamination,
        "op6_packing": op6_packing,
        "op7_simhash": op7_simhash,
        "op8_sharding": op8_sharding,
        "op9_token_counts": op9_token_counts,
        "op10_language_id": op10_language_id,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_merkle": op12_merkle,
        "op13_ann": op13_ann,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": SQL_LINE_DEDUP, "op4_warc": SQL_WARC, "op12_merkle": SQL_MERKLE}
