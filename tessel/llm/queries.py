"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from tessel.llm import conversations, middle
from tessel.llm.conversations import op11_cost_layers
from tessel.llm.decontamination import op7_simhash_windows
from tessel.llm.middle import op13_distinct_text_index
from tessel.llm.neardup import op6_minhash_odd_sketch
from tessel.llm.packing import op10_best_two_fit
from tessel.llm.pii import op3_weak_supervision
from tessel.llm.quality_classifier import op4_weak_labels
from tessel.llm.quality_rules import op1_mcd_outliers
from tessel.llm.secrets import op8_random_forest
from tessel.llm.sharding import op5_virtual_slots
from tessel.llm.templates import op2_template_classes
from tessel.llm.token_codes import op12_addressable_codes
from tessel.llm.toxicity import op9_boosted_trees

QUERIES = {
    "op1_mcd_outliers": op1_mcd_outliers,
    "op2_template_classes": op2_template_classes,
    "op3_weak_supervision": op3_weak_supervision,
    "op4_weak_labels": op4_weak_labels,
    "op5_virtual_slots": op5_virtual_slots,
    "op6_minhash_odd_sketch": op6_minhash_odd_sketch,
    "op7_simhash_windows": op7_simhash_windows,
    "op8_random_forest": op8_random_forest,
    "op9_boosted_trees": op9_boosted_trees,
    "op10_best_two_fit": op10_best_two_fit,
    "op11_cost_layers": op11_cost_layers,
    "op12_addressable_codes": op12_addressable_codes,
    "op13_distinct_text_index": op13_distinct_text_index,
}

#: Links of full shingle sets and what they reach, over the whole table.
NEAR_DUPLICATES_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
 e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
 l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
 c AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT l.b, c.r FROM c JOIN l ON c.doc_id = l.a),
 k AS (SELECT doc_id, min(r) AS component_id FROM c GROUP BY doc_id)
 SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN k USING (doc_id)"""

ORACLE_SQL: dict[str, str] = {"op6_minhash_odd_sketch": NEAR_DUPLICATES_SQL, "op11_cost_layers": conversations.SQL, "op13_distinct_text_index": middle.SQL}
