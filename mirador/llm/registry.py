"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from mirador.llm.backoff_lm import op9_lm_scoring
from mirador.llm.common import tidy
from mirador.llm.decontaminate import OP2_SQL, op2_benchmark_decontamination
from mirador.llm.hnsw import op7_nearest_neighbours
from mirador.llm.html_text import op1_html_extraction
from mirador.llm.jaccard_join import op4_ngram_jaccard_join
from mirador.llm.language_id import op5_language_id
from mirador.llm.line_dedup import OP6_SQL, op6_line_dedup
from mirador.llm.packing import op10_packing
from mirador.llm.private import op12_pii
from mirador.llm.quality import op8_quality_classifier
from mirador.llm.repair import op13_conversation_repair
from mirador.llm.warc import op3_warc
from mirador.llm.whitening import op11_embedding_whitening

OP3_SQL = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, url, octet_length(b) AS n, sha1(b) AS s FROM p),
f AS (SELECT s, n, min(page_id) AS first FROM h GROUP BY s, n)
SELECT page_id, url, CAST(h.n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h.s, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM h JOIN f ON h.s = f.s AND h.n = f.n
"""

OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') || ' ' ELSE array_to_string(w[i : i + 4], ' ') END AS t
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.t = b.t AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 180 * count(*) >= 80 * (x.n + y.n)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_warc": op3_warc,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_language_id": op5_language_id,
    "op6_line_dedup": op6_line_dedup,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_packing": op10_packing,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_pii": op12_pii,
    "op13_conversation_repair": op13_conversation_repair,
}
QUERIES = {name: tidy(query) for name, query in QUERIES.items()}
ORACLE_SQL = {"op2_benchmark_decontamination": OP2_SQL, "op3_warc": OP3_SQL, "op4_ngram_jaccard_join": OP4_SQL, "op6_line_dedup": OP6_SQL}
