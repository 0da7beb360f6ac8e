"""The registered queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skylattice.llm.bpe import bpe_digest
from skylattice.llm.conversation_repair import repair_conversations
from skylattice.llm.decontaminate import contaminated
from skylattice.llm.exact_dedup import exact_dedup
from skylattice.llm.language_id import identify_language
from skylattice.llm.merkle_manifest import merkle_manifest
from skylattice.llm.near_dedup import near_duplicates
from skylattice.llm.pii import find_pii
from skylattice.llm.secret_scan import find_secrets
from skylattice.llm.substring_dedup import remove_shared
from skylattice.llm.suffix_dedup import remove_repeats
from skylattice.llm.toxicity import fit_toxicity, score_toxicity
from skylattice.llm.url_filter import filter_urls
from skylattice.llm.url_filter import oracle_sql as url_sql

#: Folder of the public tokenizers' vocabulary files.
TOKENIZERS = os.environ.get("SKYLATTICE_TOKENIZERS") or os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), span=160, seed=97)  # n_seeds sees every repeat of 256 bytes


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_shared(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


_QUERIES = (
    op1_suffix_dedup, op2_near_dedup, op3_pii, op4_bpe, op5_url_filter, op6_exact_dedup, op7_substring_dedup, op8_decontaminate, op9_language_id, op10_toxicity,
    op11_merkle_manifest, op12_conversation_repair, op13_secret_scan,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": url_sql(), "op6_exact_dedup": OP6_SQL, "op11_merkle_manifest": OP11_SQL}


OP6_SQL = """
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS size FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY size DESC, doc_id)
"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _leaf_sql(text: str = "text") -> str:
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    return f"sha256(concat({', '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))}))"


def _tree_sql(name: str, leaves: str) -> str:
    """Levels of trees (grp, level, nodes) over lists of leaves."""
    return f"""{name} AS (SELECT grp, 0 AS level, nodes FROM {leaves} UNION ALL
SELECT grp, level + 1, list_transform(range(0, (len(nodes) + 7) // 8), lambda i: sha256(array_to_string(nodes[i * 8 + 1 : i * 8 + 8], ''))) FROM {name} WHERE len(nodes) > 1)"""


def _path_sql(tree: str, idx: str) -> str:
    """What stands before and after a leaf's node in its run, by level."""
    node = f"({idx} >> (3 * {tree}.level))"
    low = f"({node} - {node} % 8)"
    return f"array_to_string({tree}.nodes[{low} + 1 : {node}], '') AS b, array_to_string({tree}.nodes[{node} + 2 : {low} + 8], '') AS a"


#: CRC-32 from its polynomial; trees and paths level by level, the path folded from the leaf to the root.
OP11_SQL = f"""
WITH RECURSIVE tab AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY n) AS t FROM range(256) r(n)),
d AS (SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 3 = 0 AS tampered FROM documents, tab),
f AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS grp, {_leaf_sql()} AS leaf, CASE WHEN tampered THEN {_leaf_sql(f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")} ELSE {_leaf_sql()} END AS forged FROM d),
i AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id, leaf) - 1 AS idx FROM f), g AS (SELECT grp, list(leaf ORDER BY idx) AS nodes FROM i GROUP BY grp), {_tree_sql('tr', 'g')},
su AS (SELECT grp, nodes[1] AS subroot, row_number() OVER (ORDER BY grp) - 1 AS place FROM tr WHERE len(nodes) = 1), tg AS (SELECT '' AS grp, list(subroot ORDER BY place) AS nodes FROM su), {_tree_sql('tt', 'tg')}, ro AS (SELECT nodes[1] AS root FROM tt WHERE len(nodes) = 1),
st AS (SELECT doc_id, leaf, idx, i.grp, tr.level, {_path_sql('tr', 'idx')} FROM i JOIN tr ON tr.grp = i.grp WHERE len(tr.nodes) > 1
  UNION ALL SELECT doc_id, leaf, idx, i.grp, 100 + tt.level, {_path_sql('tt', 'place')} FROM i JOIN su ON su.grp = i.grp, tt WHERE len(tt.nodes) > 1),
pa AS (SELECT grp, idx, list(b || '|' || a ORDER BY level) AS steps, string_agg(b || a, '' ORDER BY level) AS proof FROM st GROUP BY grp, idx),
fo AS (SELECT i.doc_id, i.leaf, su.subroot, ro.root, sha256(coalesce(proof, '')) AS proof_sha256, CASE WHEN steps IS NULL THEN forged ELSE list_reduce(list_concat([forged], steps), lambda h, e: sha256(concat(split_part(e, '|', 1), h, split_part(e, '|', 2)))) END AS folded_root
  FROM i JOIN su ON su.grp = i.grp LEFT JOIN pa ON pa.grp = i.grp AND pa.idx = i.idx, ro)
SELECT *, folded_root = root AS verified FROM fo
"""
