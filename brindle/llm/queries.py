"""The queries of this subpackage, and the SQL that DuckDB can hold against them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ef_lm import op10_ef_lm
from .media_ogg import op5_media_ogg
from .near_dedup import op1_near_dedup
from .order_minhash import op3_order_minhash
from .packing import op6_packing
from .pii import op9_pii
from .repair_shards import op7_repair_shards
from .token_counts import op8_token_counts
from .toxicity import op2_toxicity
from .trie_bpe import op4_trie_bpe

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_near_dedup": op1_near_dedup,
        "op2_toxicity": op2_toxicity,
        "op3_order_minhash": op3_order_minhash,
        "op4_trie_bpe": op4_trie_bpe,
        "op5_media_ogg": op5_media_ogg,
        "op6_packing": op6_packing,
        "op7_repair_shards": op7_repair_shards,
        "op8_token_counts": op8_token_counts,
        "op9_pii": op9_pii,
        "op10_ef_lm": op10_ef_lm,
    }


#: All pairs that share a shingle, then reachability: exact, and quick enough on small tables.
NEAR_DEDUP = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM w),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.other) AS component_id, s.doc_id = min(r.other) AS kept FROM sets s JOIN reach r ON s.doc_id = r.doc_id GROUP BY s.doc_id, s.s"""


def oracle_sql() -> dict[str, str]:
    """The other nine learn, tokenize, hash or store in ways that SQL can't express; tests/llm holds them against brute force."""
    return {"op1_near_dedup": NEAR_DEDUP}
