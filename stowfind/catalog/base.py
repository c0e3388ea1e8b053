"""Registry of runnable queries and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from stowfind.functions.descriptor import FIELD_WEIGHTS, SPARSE_WEIGHTS
from stowfind.functions.text import ALIASES
from stowfind.sources.tables import Tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is its counterpart for another engine."""

    def add(function):
        assert name not in QUERIES, name
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return add


def tokens_sql(text: str) -> str:
    clean = f"trim(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g'))"
    return f"list_filter(string_split({clean}, ' '), lambda tk: tk <> '')"


def text_of(values: str) -> str:
    """Comparable text of a list: sorted and joined."""
    return f"array_to_string(list_sort({values}), ' ')"


def alias_rows() -> str:
    return ", ".join(f"('{t}', '{a}')" for t, many in ALIASES.items() for a in many)


EPOCH_MS = "CAST(floor(epoch_us(ts) / 1000) AS BIGINT)"

# Named parts of the SQL side: (parts it needs, text).
PARTS: dict[str, tuple[str, str]] = {
    "aliases": ("", f"SELECT * FROM (VALUES {alias_rows()}) t(token, alias)"),
    "containers": ("", """
        SELECT o_orderkey AS container_id, o_orderstatus AS world_id,
               CAST(o_orderkey % 256 - 128 AS INT) AS x, CAST(64 + o_orderkey // 65536 AS INT) AS y,
               CAST((o_orderkey // 256) % 256 - 128 AS INT) AS z, o_orderpriority AS block_type,
               o_custkey AS owner_id FROM orders"""),
    "placed": ("containers", """
        SELECT *, CAST(floor(x / 16.0) AS INT) AS cell_x, CAST(floor(z / 16.0) AS INT) AS cell_z
        FROM containers"""),
    "cells": ("placed", """
        SELECT *, ((cell_x + cell_z) % 5 + 5) % 5 <> 0 AS available
        FROM (SELECT DISTINCT world_id, cell_x, cell_z FROM placed)"""),
    "decisions": ("containers", """
        SELECT player_id, container_id,
               CASE WHEN (owner_id + player_id) % 7 = 0 THEN 'DENY'
                    WHEN (owner_id + player_id) % 11 = 0 THEN NULL
                    WHEN owner_id % 2 = 0 THEN 'ALLOW' ELSE 'NOT_APPLICABLE' END AS decision
        FROM containers, (SELECT unnest(range(10)) AS player_id)"""),
    "denied": ("decisions", """
        SELECT DISTINCT player_id, container_id FROM decisions WHERE decision IS NULL OR decision = 'DENY'"""),
    "parts": ("", """
        SELECT p_partkey, 'part:' || replace(p_name, ' ', '_') AS material, p_name, p_type, p_brand, p_size,
               p_partkey % 5 = 0 AS has_lore, p_partkey % 3 = 0 AS has_ench,
               concat_ws('|', p_name, p_type, p_brand, p_size, p_partkey % 5 = 0, p_partkey % 3 = 0) AS d
        FROM part"""),
    "lines": ("", """
        SELECT l_orderkey, l_partkey, CAST(l_quantity AS INT) AS amount,
               CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                                       l_extendedprice, l_quantity) AS INT) AS slot
        FROM lineitem"""),
    "items": ("lines parts", """
        SELECT l_orderkey * 1048576 + slot AS item_id, l_orderkey AS container_id, o_orderpriority AS label, slot,
               amount, d, material AS material_key
        FROM lines JOIN orders ON l_orderkey = o_orderkey JOIN parts ON l_partkey = p_partkey"""),
    "ditems": ("items placed", """
        SELECT items.*, world_id, x, y, z, cell_x, cell_z, block_type
        FROM items JOIN placed USING (container_id)"""),
    "descs": ("items parts", """
        SELECT d, copies, p.* EXCLUDE (d) FROM (SELECT d, count(*) AS copies FROM items GROUP BY d)
        JOIN (SELECT d, any_value(material) AS material, any_value(p_name) AS p_name, any_value(p_type) AS p_type,
                     any_value(p_brand) AS p_brand, any_value(p_size) AS p_size,
                     any_value(has_lore) AS has_lore, any_value(has_ench) AS has_ench
              FROM parts GROUP BY d) p USING (d)"""),
    # texts of a descriptor by category
    "texts": ("descs", """
        SELECT d, 'material' AS cat, material AS text FROM descs
        UNION ALL SELECT d, 'display', p_name FROM descs
        UNION ALL SELECT d, 'lore', 'made of ' || p_brand FROM descs WHERE has_lore
        UNION ALL SELECT d, 'enchantment', 'mending' FROM descs WHERE has_ench
        UNION ALL SELECT d, 'attribute', 'weight' FROM descs
        UNION ALL SELECT d, 'trait', p_type FROM descs
        UNION ALL SELECT d, 'metadata_key', 'size' FROM descs
        UNION ALL SELECT d, 'metadata_value', CAST(p_size AS VARCHAR) FROM descs
        UNION ALL SELECT d, 'custom_tag', p_brand FROM descs"""),
    "text_tokens": ("texts", f"""
        SELECT DISTINCT d, cat, text, unnest({tokens_sql('text')}) AS token FROM texts"""),
    "fields": ("text_tokens aliases", """
        WITH own AS (
            SELECT DISTINCT d, CASE WHEN cat IN ('enchantment', 'attribute') THEN 'enchantments'
                                    WHEN cat IN ('trait', 'custom_tag') THEN 'tags' ELSE cat END AS field, token
            FROM text_tokens WHERE cat NOT LIKE 'metadata%')
        SELECT d, field, token FROM own
        UNION SELECT d, 'tags', alias FROM own JOIN aliases USING (token)"""),
    "post": ("fields", "SELECT d, token, sum(CASE field "
             + " ".join(f"WHEN '{n}' THEN {w}" for n, w in FIELD_WEIGHTS.items())
             + " END)::DOUBLE AS w FROM fields GROUP BY d, token"),
    "lens": ("fields descs", """
        SELECT d, copies, count(*) AS doc_len FROM fields JOIN descs USING (d) GROUP BY d, copies"""),
    "stats": ("lens", """
        SELECT CAST(sum(copies) AS DOUBLE) AS n_docs,
               CAST(sum(doc_len * copies) AS DOUBLE) / sum(copies) AS avg_len FROM lens"""),
    "vecs": ("text_tokens aliases", "WITH full_set AS (SELECT DISTINCT d, cat, text, token FROM text_tokens "
             "UNION SELECT d, cat, text, alias FROM text_tokens JOIN aliases USING (token)) "
             "SELECT d, token, sum(CASE cat "
             + " ".join(f"WHEN '{n}' THEN {w}" for n, w in SPARSE_WEIGHTS.items())
             + " END)::DOUBLE AS weight FROM full_set GROUP BY d, token"),
    "norms": ("vecs", "SELECT d, sqrt(sum(weight * weight)) AS norm FROM vecs GROUP BY d"),
    "queries": ("", """
        SELECT * FROM (VALUES (1, 1, 'small widget', 'O', 0, 64, -70), (2, 2, 'red bolt', 'F', -60, 64, -100),
                              (3, 3, 'gea', 'P', 10, 64, -90), (4, 4, '!!!', 'O', 0, 64, -70),
                              (5, 5, 'mending promo brand', 'F', 20, 64, -110),
                              (6, 6, 'unobtainium', 'O', 0, 64, -70))
        t(query_id, player_id, query, world_id, ox, oy, oz)"""),
    "squeries": ("containers", """
        SELECT s_suppkey AS query_id, s_suppkey % 10 AS player_id,
               CASE s_suppkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type || ' ' || substr(p_name, 1, 3)
                    ELSE 'mending ' || p_name END AS query,
               world_id, x AS ox, y AS oy, z AS oz
        FROM supplier JOIN part ON p_partkey = s_suppkey JOIN containers ON container_id = s_suppkey"""),
    "history": ("", f"""
        SELECT CAST(event_id AS VARCHAR) AS id, user_id AS player_id, event_type AS query, {EPOCH_MS} AS ts_ms,
               CAST(floor(value) AS INT) AS result_count, event_id FROM events"""),
    "changes": ("", f"""
        SELECT user_id AS key, {EPOCH_MS} // 1800000 AS tick, event_id AS seq,
               CASE WHEN event_type IN ('click', 'view') THEN 'transfer' WHEN event_type = 'error' THEN 'delete'
                    ELSE 'dirty' END AS kind FROM events"""),
}


def terms_parts(source: str) -> dict[str, tuple[str, str]]:
    """Query terms, query vectors and scores for a table of queries."""
    return {
        "qtok": (source, f"""
            SELECT query_id, list AS toks, len(list) AS n_groups
            FROM (SELECT query_id, {tokens_sql('query')} AS list FROM {source}) WHERE len(list) > 0"""),
        "qgroups": ("qtok", """
            SELECT query_id, n_groups, unnest(toks) AS token, unnest(range(len(toks))) AS group_no FROM qtok"""),
        "terms": ("qgroups aliases", """
            SELECT query_id, n_groups, group_no, 0 AS phrase_no, token AS term, group_no = n_groups - 1 AS is_prefix
            FROM qgroups
            UNION ALL
            SELECT query_id, n_groups, group_no,
                   row_number() OVER (PARTITION BY query_id, group_no ORDER BY alias), alias, false
            FROM qgroups JOIN aliases USING (token)"""),
        "qvec": ("qgroups aliases", """
            SELECT query_id, token, sqrt(count(*) OVER (PARTITION BY query_id)) AS q_norm
            FROM (SELECT query_id, token FROM qgroups
                  UNION SELECT query_id, alias FROM qgroups JOIN aliases USING (token))"""),
        "ft_match": ("terms post lens", """
            SELECT query_id, n_groups, group_no, phrase_no, d, copies, doc_len, sum(w) AS f
            FROM terms JOIN post ON post.token = term OR (is_prefix AND starts_with(post.token, term))
            JOIN lens USING (d) GROUP BY ALL"""),
        "ft_df": ("ft_match", """
            SELECT query_id, group_no, phrase_no, CAST(sum(copies) AS DOUBLE) AS df FROM ft_match GROUP BY ALL"""),
        "ft_scores": ("ft_match ft_df stats", """
            SELECT query_id, d, round(-sum(
                       CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) > 0
                            THEN ln((n_docs - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
                       * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * doc_len / avg_len))), 12) AS score
            FROM ft_match JOIN ft_df USING (query_id, group_no, phrase_no), stats
            GROUP BY query_id, d, n_groups HAVING count(DISTINCT group_no) = n_groups"""),
        "sem_scores": ("qvec vecs norms", """
            SELECT query_id, d, round(least(1.0, greatest(0.0, sum(weight) / (any_value(norm) * any_value(q_norm)))), 12)
                   AS cosine
            FROM qvec JOIN vecs USING (token) JOIN norms USING (d) GROUP BY query_id, d"""),
    }


def search_parts(source: str, radius: int = 32, min_score: float = 0.3, results: int = 32, paths: int = 16,
                 k: int = 60, limit: int = 64) -> dict[str, tuple[str, str]]:
    """All steps of a hybrid search over a table of queries."""
    parts = dict(terms_parts(source))
    key = "query_id, container_id, slot"
    parts |= {
        "windows": (f"{source} cells", f"""
            SELECT q.query_id, q.player_id, q.ox, q.oy, q.oz, c.world_id, c.cell_x, c.cell_z
            FROM {source} q JOIN cells c ON q.world_id = c.world_id AND c.available
             AND c.cell_x BETWEEN floor((ox - {radius}) / 16.0) AND floor((ox + {radius}) / 16.0)
             AND c.cell_z BETWEEN floor((oz - {radius}) / 16.0) AND floor((oz + {radius}) / 16.0)"""),
        "cand": ("windows ditems", """
            SELECT w.query_id, w.player_id, i.*,
                   sqrt((x - ox) * (x - ox) + (y - oy) * (y - oy) + (z - oz) * (z - oz)) AS distance
            FROM windows w JOIN ditems i USING (world_id, cell_x, cell_z)"""),
        "ft_cut": ("cand ft_scores", f"""
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, x, y, z, length(label), label, slot,
                                         item_id) AS cut
            FROM cand JOIN ft_scores USING (query_id, d) QUALIFY cut <= {limit}"""),
        "ft": ("ft_cut denied", f"""
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cut) AS ft_rank
            FROM ft_cut ANTI JOIN denied USING (player_id, container_id) WHERE distance <= {radius} + 1e-9"""),
        "sem": ("cand sem_scores denied", f"""
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, label, slot, amount, material_key,
                                         world_id, x, y, z, item_id) AS sem_rank
            FROM cand JOIN sem_scores USING (query_id, d) ANTI JOIN denied USING (player_id, container_id)
            WHERE cosine >= {min_score} AND distance <= {radius} + 1e-9 QUALIFY sem_rank <= {limit}"""),
        "fused": ("ft sem", f"""
            SELECT {key}, max(ft_rank) AS ft_rank, max(sem_rank) AS sem_rank, any_value(label) AS label,
                   any_value(item_id) AS item_id, any_value(amount) AS amount,
                   any_value(material_key) AS material_key, any_value(distance) AS distance,
                   any_value(world_id) AS world_id, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z,
                   round(least(1.0, (coalesce(1.0 / ({k}.0 + max(ft_rank)), 0.0)
                                     + coalesce(1.0 / ({k}.0 + max(sem_rank)), 0.0)) * {(k + 1) / 2.0}), 12) AS score
            FROM (SELECT {key}, label, item_id, amount, material_key, distance, world_id, x, y, z, ft_rank,
                         NULL AS sem_rank FROM ft
                  UNION ALL
                  SELECT {key}, label, item_id, amount, material_key, distance, world_id, x, y, z, NULL, sem_rank
                  FROM sem) GROUP BY {key}"""),
        "ranked": ("fused", f"""
            SELECT *, row_number() OVER (PARTITION BY query_id, container_id ORDER BY score DESC, label, slot, amount,
                                         material_key) AS path_rank FROM fused"""),
        "roots": ("fused", """
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best_score DESC, distance, world_id, x, y, z)
                   AS root_rank
            FROM (SELECT query_id, container_id, world_id, x, y, z, max(score) AS best_score,
                         min(distance) AS distance, count(*) AS total_stacks FROM fused GROUP BY ALL)"""),
        "shown_items": ("ranked roots", f"""
            SELECT k.*, root_rank FROM ranked k JOIN roots r USING (query_id, container_id)
            WHERE path_rank <= {paths} AND root_rank <= {results}"""),
        "totals": ("roots", f"""
            SELECT query_id, count(*) AS total_roots, CAST(sum(total_stacks) AS BIGINT) AS total_stacks,
                   count(*) FILTER (root_rank <= {results}) AS shown_roots FROM roots GROUP BY query_id"""),
        "summary": (f"totals qtok {source}", f"""
            SELECT query_id, CASE WHEN n_groups IS NULL THEN 'UNSUPPORTED_QUERY' WHEN total_roots IS NULL
                                  THEN 'NO_MATCHES' ELSE 'SUCCESS' END AS status,
                   coalesce(total_roots, 0) AS total_roots, coalesce(total_stacks, 0) AS total_stacks,
                   coalesce(shown_roots, 0) AS shown_roots
            FROM {source} LEFT JOIN qtok USING (query_id) LEFT JOIN totals USING (query_id)"""),
    }
    return parts


def sql(needs: str, body: str, extra: dict[str, tuple[str, str]] | None = None) -> str:
    """``body`` after the named parts it needs, in order of dependence."""
    known = PARTS | (extra or {})
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for dependency in known[name][0].split():
            visit(dependency)
        done.append(name)

    for name in needs.split():
        visit(name)
    if not done:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({known[n][1]})" for n in done) + "\n" + body
