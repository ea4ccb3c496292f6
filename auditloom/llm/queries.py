"""The numbered operators on the driver tables, with SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auditloom.llm import (
    bin_packing, bit_slices, fm_decontam, kernel_classifier, language_id, licence_digest, minhash_dedup, pii_bootstrap, pivotal_mix,
    prefix_trie, quality_rules, secret_automaton, suffix_levels,
)
from auditloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op2_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.personal_data(table(spark, sf_dir, "documents"))


def op3_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_levels.repeated_passages(table(spark, sf_dir, "documents"), words=True).drop("spans")


def op4_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_packing.shard(table(spark, sf_dir, "documents"))


def op5_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_automaton.find_secrets(table(spark, sf_dir, "documents"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op7_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivotal_mix.mix(table(spark, sf_dir, "documents")).drop("copies")


def op8_fm_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_licence_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_digest.scan(table(spark, sf_dir, "documents"))


def op10_kernel_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op12_bit_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_slices.search(bit_slices.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuild(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_pii_bootstrap": op2_pii_bootstrap,
    "op3_suffix_levels": op3_suffix_levels,
    "op4_bin_packing": op4_bin_packing,
    "op5_secret_automaton": op5_secret_automaton,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_pivotal_mix": op7_pivotal_mix,
    "op8_fm_decontam": op8_fm_decontam,
    "op9_licence_digest": op9_licence_digest,
    "op10_kernel_classifier": op10_kernel_classifier,
    "op11_language_id": op11_language_id,
    "op12_bit_slices": op12_bit_slices,
    "op13_prefix_trie": op13_prefix_trie,
}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES_SQL = rf"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    shingle AS (
        SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM words WHERE len(w) > 0)),
    size AS (
        SELECT w.doc_id, count(s) AS n FROM words w LEFT JOIN shingle s ON w.doc_id = s.doc_id GROUP BY w.doc_id),
    edge AS (
        SELECT a.doc_id AS u, b.doc_id AS v FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id
        JOIN size m ON m.doc_id = a.doc_id JOIN size n ON n.doc_id = b.doc_id
        WHERE 5 * m.n >= 4 * n.n AND 5 * n.n >= 4 * m.n
        GROUP BY a.doc_id, b.doc_id, m.n, n.n HAVING 100 * count(*) >= 80 * (m.n + n.n - count(*))),
    reach(doc_id, other) AS (
        SELECT doc_id, doc_id FROM size UNION SELECT r.doc_id, e.v FROM reach r JOIN edge e ON r.other = e.u)
    SELECT s.doc_id, s.n AS n_shingles, min(r.other) AS component_id, min(r.other) = s.doc_id AS kept
    FROM size s JOIN reach r ON s.doc_id = r.doc_id GROUP BY s.doc_id, s.n
"""

CONTAMINATION_SQL = rf"""
    WITH doc AS (
        SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    item AS (
        SELECT item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    win AS (
        SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
    hit AS (
        SELECT d.doc_id, d.i, d.n, w.item_id FROM (
            SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (
                SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)) d
        JOIN win w ON d.n = w.n AND d.s = w.s),
    covered AS (
        SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
    found AS (
        SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
    SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM doc d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN found f ON d.doc_id = f.doc_id
"""


def licence_sql() -> str:
    """Whole texts and notices by digest, with the canonical form spelt in SQL."""
    def canonical(text: str) -> str:
        out = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        out = rf"regexp_replace({out}, '(^|\n)[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*', '\1', 'g')"
        # No look-ahead in SQL: a line of rights reserved goes with the break that ends it kept by hand.
        out = rf"regexp_replace({out}, '(^|\n)[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*(\n|$)', '\1\2', 'g')"
        out = rf"' ' || regexp_replace({out}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g') || ' '"
        for old, new in licence_digest.SPELLINGS:
            out = f"replace({out}, ' {old} ', ' {new} ')"
        return rf"trim(regexp_replace({out}, ' +', ' ', 'g'))"

    def rows(texts: list[tuple[str, str]]) -> str:
        return ", ".join("('" + k + "', '" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "')" for k, t in texts)

    return f"""
        WITH known AS (
            SELECT min(licence) AS licence, sha256({canonical('t')}) AS digest
            FROM (VALUES {rows(licence_digest.TEXTS + licence_digest.NOTICES)}) v(licence, t) GROUP BY 2),
        notice AS (
            SELECT min(licence) AS licence, sha256({canonical('t')}) AS digest
            FROM (VALUES {rows(licence_digest.NOTICES)}) v(licence, t) GROUP BY 2),
        line AS (
            SELECT doc_id, sha256({canonical('row')}) AS digest
            FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS row FROM documents)
            WHERE regexp_matches(row, '(?i)licen|released')),
        noticed AS (
            SELECT doc_id, count(*) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS names
            FROM line JOIN notice USING (digest) GROUP BY doc_id)
        SELECT d.doc_id, d.digest AS canon_sha256, k.licence, coalesce(n.n, 0) AS n_notices, coalesce(n.names, '') AS notices
        FROM (SELECT doc_id, sha256({canonical('text')}) AS digest FROM documents) d
        LEFT JOIN known k ON d.digest = k.digest LEFT JOIN noticed n ON d.doc_id = n.doc_id
    """

SEARCH_SQL = r"""
    WITH doc AS (
        SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(LOWERED, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    size AS (SELECT k, doc_id, len(w) AS n FROM doc WHERE len(w) > 0),
    corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size),
    tf AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(w) AS term FROM doc) GROUP BY k, term),
    asked AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(LOWERED, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    weight AS (
        SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight
        FROM tf, corpus WHERE term IN (SELECT term FROM asked) GROUP BY term, docs),
    score AS (
        SELECT item_id, s.doc_id, s.k, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * docs) // terms))))) AS BIGINT) AS score
        FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN size s USING (k), corpus GROUP BY item_id, s.doc_id, s.k),
    ranked AS (
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
        FROM score WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
""".replace("LOWERED", LOWERED)

#: CRC-32 of the decimal conv_id, bit by bit: a step below 0 shifts once.
CRC32_SQL = """
    xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
        string_split(CAST(c AS VARCHAR), ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))
"""

TRIE_SQL = f"""
    WITH turn AS (
        SELECT conv_id AS c, md5(length(r) || ':' || r || t) AS m, length(t) AS n,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(r) || ':' || r || t)) AS k
        FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)),
    conv AS (SELECT c, c - c % 100 AS base, {CRC32_SQL} % 6 AS h FROM (SELECT DISTINCT c FROM turn)),
    rebuilt AS (
        SELECT conv.c, 0 AS part, k, m, n FROM conv JOIN turn ON turn.c = base AND k <= h
        UNION ALL SELECT conv.c, 1, k, m, n FROM conv JOIN turn ON turn.c = conv.c AND k > h),
    prefix AS (
        SELECT c, row_number() OVER w AS d, string_agg(m, '') OVER w AS p, n FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY part, k)
        UNION ALL SELECT c, 0, '', 0 FROM conv),
    node AS (SELECT p, d, min(c) AS c, count(*) AS members, max(n) AS n FROM prefix GROUP BY p, d),
    ended AS (
        SELECT p, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids
        FROM (SELECT c, arg_max(p, d) AS p FROM prefix GROUP BY c) GROUP BY p),
    children AS (SELECT substr(p, 1, 32 * (d - 1)) AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
    below AS (
        SELECT substr(node.p, 1, 32 * e) AS p, sum((members - 1) * node.n) AS saved, count(*) FILTER (children.p IS NULL) AS leaves
        FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM node) node LEFT JOIN children USING (p) GROUP BY 1)
    SELECT node.c AS conv_id, node.d AS depth, up.c AS parent_conv_id, node.members AS n_convs, coalesce(children.n, 0) AS n_children,
           leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
    FROM node JOIN below USING (p) LEFT JOIN ended USING (p) LEFT JOIN children USING (p)
    LEFT JOIN node up ON node.d > 0 AND up.p = substr(node.p, 1, 32 * (node.d - 1))
"""


ORACLES: dict[str, str] = {
    "op6_minhash_dedup": NEAR_DUPLICATES_SQL,
    "op8_fm_decontam": CONTAMINATION_SQL,
    "op9_licence_digest": licence_sql(),
    "op12_bit_slices": SEARCH_SQL,
    "op13_prefix_trie": TRIE_SQL,
}
