"""DuckDB formulations of trees: levels unrolled as nested aggregates, where the engine explodes ancestors and loops."""

from __future__ import annotations


def dig(x: str) -> str:
    return f"substr(base64(encode(sha256({x}))), 1, 20)"


def par(path: str = "path") -> str:
    return f"regexp_replace({path}, '/[^/]*$', '')"


def name(path: str = "path") -> str:
    return f"regexp_extract({path}, '[^/]*$')"


POST = "string_split('a' || replace(path, '/', '/a'), '/') || ['b']"
FIELDS = "path, type, hash, mtime, nbytes, nnodes"


def tree(alias: str, leaves: str, depth: int, dirs: str = "") -> str:
    """CTEs that end with `alias`: path, parent, name, depth, type, hash, mtime, nbytes, nnodes.

    leaves: SELECT of path, type, hash, mtime, nbytes for nodes without children; depth: the deepest leaf's.
    """
    parts = [f"{alias}_leaf AS (SELECT *, (length(path) - length(replace(path, '/', '')))::INT AS depth FROM ({leaves}))"]
    for k in range(depth, -1, -1):
        own = f"SELECT path, type, hash, mtime::BIGINT AS mtime, nbytes::BIGINT AS nbytes, 1::BIGINT AS nnodes FROM {alias}_leaf WHERE depth = {k}"
        if k < depth:
            own += f" UNION ALL SELECT {par()} AS path, 'D' AS type, {dig('string_agg(hash, chr(10) ORDER BY hash) || chr(10)')} AS hash, max(mtime)::BIGINT, (4096 + sum(nbytes))::BIGINT, (1 + sum(nnodes))::BIGINT FROM {alias}_{k + 1} GROUP BY 1"
        parts.append(f"{alias}_{k} AS ({own})")
    every = " UNION ALL ".join(f"SELECT {k}::INT AS depth, {FIELDS} FROM {alias}_{k}" for k in range(depth + 1))
    parts.append(f"{alias} AS (SELECT depth, CASE WHEN depth > 0 THEN {par()} END AS parent, {name()} AS name, {FIELDS} FROM ({every}))")
    return ", ".join(parts)


def doc_leaves(root: str = "root", where: str = "true", lang: str = "lang", text: str = "text", source: str = "source", table: str = "documents", leaf: str = "'doc' || doc_id") -> str:
    return f"SELECT '{root}/' || {source} || '/' || {lang} || '/' || {leaf} AS path, 'F' AS type, {dig(text)} AS hash, 1704067200 + doc_id AS mtime, strlen({text}) AS nbytes FROM {table} WHERE {where}"


SNAP = (
    "SELECT 'root/' || source || '/' || lang || '/doc' || doc_id AS path, 'F' AS type, " + dig("text") + " AS hash, 1704067200 + doc_id AS mtime, strlen(text) AS nbytes FROM ("
    "SELECT doc_id, source, CASE WHEN doc_id % 23 = 0 AND doc_id % 19 <> 0 THEN 'moved' ELSE lang END AS lang, CASE WHEN doc_id % 19 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 17 <> 0 "
    "UNION ALL SELECT doc_id + 1000000, source, lang, text FROM documents WHERE doc_id % 29 = 0)"
)
LEAVES = {
    "docs": (doc_leaves(), 3),
    "mirror": (doc_leaves("root/orig") + " UNION ALL " + doc_leaves("root/copy", "source IN ('src0', 'src1', 'src2', 'src3', 'src4')"), 4),
    "snapshot": (SNAP, 3),
    "errors": (f"SELECT path, CASE WHEN e THEN 'E' ELSE type END AS type, CASE WHEN e THEN 'ERROR' ELSE hash END AS hash, CASE WHEN e THEN 0 ELSE mtime END AS mtime, CASE WHEN e THEN 0 ELSE nbytes END AS nbytes FROM (SELECT *, regexp_extract(path, '[0-9]+$')::BIGINT % 97 = 0 AS e FROM ({doc_leaves()}))", 3),
    "links": (
        f"SELECT 'root/links/l' || l.doc_id AS path, CASE WHEN quality = 1 THEN 'L' ELSE 'B' END AS type, CASE WHEN quality = 1 THEN {dig('text')} ELSE {dig("'../docs/doc' || l.doc_id")} END AS hash, 1704067200 + l.doc_id AS mtime, CASE WHEN quality = 1 THEN strlen(text) ELSE strlen('../docs/doc' || l.doc_id) END AS nbytes FROM labels l JOIN documents d ON l.doc_id = d.doc_id "
        f"UNION ALL SELECT 'root/docs/doc' || doc_id, 'F', {dig('text')}, 1704067200 + doc_id, strlen(text) FROM documents",
        2,
    ),
    "events": (f"SELECT 'root/u' || user_id || '/' || event_type || '/e' || event_id AS path, 'F' AS type, {dig("coalesce(props, '')")} AS hash, floor(epoch_us(ts) / 1000000)::BIGINT AS mtime, strlen(coalesce(props, '')) AS nbytes FROM events", 3),
    "commerce": (
        f"SELECT 'world/' || r_name || '/' || n_name || '/' || c_name || '/o' || o_orderkey AS path, 'F' AS type, {dig("o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority")} AS hash, floor(epoch_us(o_orderdate) / 1000000)::BIGINT AS mtime, strlen(o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority) AS nbytes "
        "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
        4,
    ),
    "pages": (
        f"SELECT 'web/' || array_to_string(list_reverse(string_split(split_part(bare, '/', 1), '.')), '/') || '/' || split_part(bare, '/', 2) || '/p' || page_id AS path, 'F' AS type, {dig('html')} AS hash, 1704067200 + page_id AS mtime, strlen(html) AS nbytes "
        "FROM (SELECT *, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS bare FROM pages)",
        7,
    ),
}


def of(*names: str) -> str:
    """WITH clause for named trees."""
    return "WITH " + ", ".join(tree(n, *LEAVES[n]) for n in names)


def found(cte: str, condition: str, label: str = "NULL") -> str:
    """Top-most rows of a tree that match."""
    return f"cand AS (SELECT *, {label} AS label FROM {cte} WHERE {condition}), hits AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM cand a WHERE starts_with(c.path, a.path || '/')))"


def groups(cte: str, condition: str = "true") -> str:
    """CTE grp of duplicate groups and their scores."""
    return (
        f"grp AS (SELECT *, (CASE WHEN type = 'D' THEN n - n // k ELSE n - 1 END)::BIGINT AS score FROM (SELECT hash, first(type ORDER BY string_split(path, '/')) AS type, sum(CASE WHEN type = 'D' THEN nnodes ELSE 1 END)::BIGINT AS n, count(*)::BIGINT AS k, first(path ORDER BY string_split(path, '/')) AS first_path "
        f"FROM {cte} WHERE type <> 'E' AND {condition} GROUP BY hash HAVING count(*) > 1))"
    )


RANK = "row_number() OVER (ORDER BY score DESC, strpos('DFLBE', type), string_split(first_path, '/'))"


def simplified(cte: str, condition: str = "true") -> str:
    """CTE simp: groups left when the first one prunes."""
    return (
        groups(cte, condition)
        + f", ranked AS (SELECT *, {RANK} AS r FROM grp), tops AS (SELECT path FROM {cte} n JOIN ranked ON n.hash = ranked.hash WHERE r = 1 AND n.type <> 'E' AND {condition}), "
        + f"simp AS (SELECT * FROM ranked g WHERE r = 1 OR EXISTS (SELECT 1 FROM {cte} n WHERE n.hash = g.hash AND n.type <> 'E' AND {condition} AND NOT EXISTS (SELECT 1 FROM tops t WHERE starts_with(n.path || '/', t.path || '/'))))"
    )


def diff(old: str, new: str) -> str:
    """CTE d: op, rel of all changes without move detection; keys of both sides."""
    rel = "CASE WHEN strpos(path, '/') > 0 THEN regexp_replace(path, '^[^/]*/', '') ELSE '' END"
    return (
        f"o AS (SELECT *, {rel} AS rel FROM {old}), n AS (SELECT *, {rel} AS rel FROM {new}), "
        "j AS (SELECT coalesce(o.rel, n.rel) AS rel, o.type AS ot, n.type AS nt, o.hash AS oh, n.hash AS nh, o.name AS oname, n.name AS nname, o.mtime AS om, n.mtime AS nm, o.nbytes AS ob, n.nbytes AS nb FROM o FULL JOIN n ON o.rel = n.rel), "
        "eq AS (SELECT rel FROM j WHERE ot = 'D' AND nt = 'D' AND oh = nh), ne AS (SELECT rel FROM j WHERE ot = 'D' AND nt = 'D' AND oh <> nh), "
        "c AS (SELECT * FROM j WHERE rel <> '' AND CASE WHEN strpos(rel, '/') > 0 THEN regexp_replace(rel, '/[^/]*$', '') ELSE '' END IN (SELECT rel FROM ne) AND NOT EXISTS (SELECT 1 FROM eq WHERE eq.rel = '' OR starts_with(j.rel, eq.rel || '/'))), "
        "d AS (SELECT 'add' AS op, * FROM c WHERE ot IS NULL OR (nt IS NOT NULL AND ot <> nt) UNION ALL SELECT 'rm', * FROM c WHERE nt IS NULL OR (ot IS NOT NULL AND ot <> nt) UNION ALL SELECT 'edit', * FROM c WHERE ot = nt AND ot <> 'D' AND oh <> nh), "
        "rms AS (SELECT rel, ot, oname, oh, ob, om, row_number() OVER (PARTITION BY ot, oname, oh, ob, om ORDER BY string_split(rel, '/')) AS t FROM d WHERE op = 'rm'), "
        "adds AS (SELECT rel, nt, nname, nh, nb, nm, row_number() OVER (PARTITION BY nt, nname, nh, nb, nm ORDER BY string_split(rel, '/')) AS t FROM d WHERE op = 'add'), "
        "mv AS (SELECT rms.rel AS a, adds.rel AS b FROM rms JOIN adds ON ot = nt AND oname = nname AND oh = nh AND ob = nb AND om = nm AND rms.t = adds.t), "
        "deltas AS (SELECT op, rel AS path, NULL::VARCHAR AS path2 FROM d WHERE NOT (op = 'rm' AND rel IN (SELECT a FROM mv)) AND NOT (op = 'add' AND rel IN (SELECT b FROM mv)) UNION ALL SELECT 'mv', a, b FROM mv)"
    )
