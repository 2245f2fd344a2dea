"""Queries of ignore rules and sizes by role over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence
from ..sources import repository
from .tables import projected, sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


# Documents lie in folders two deep; parts are lines of the ignore files of these folders, of five kinds.
_PATHS = {"path": "'d' || doc_id % 7 || '/e' || doc_id % 13 || '/f' || doc_id || '.' || coalesce(lang, 'xx')", "a": "'d' || doc_id % 7", "b": "'e' || doc_id % 13", "name": "'f' || doc_id || '.' || coalesce(lang, 'xx')"}
_RULES = {
    "folder": "CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'd' || p_size % 7 ELSE 'd' || p_size % 7 || '/e' || p_partkey % 13 END", "nth": "p_partkey", "kind": "p_partkey % 5",
    "pattern": "CASE p_partkey % 5 WHEN 0 THEN 'f*' || p_size || '.?e' WHEN 1 THEN '!*' || p_size % 10 || '.' || 'en' WHEN 2 THEN '/e' || p_size || '/' WHEN 3 THEN 'f[1-' || (2 + p_size % 7) || ']' || p_size % 10 || '*' ELSE '# ' || p_name END",
    "size": "p_size",
}
_RULE_SQL = "CASE kind WHEN 0 THEN '^(?:.*/)?f[^/]*' || size || '\\.[^/]e$' WHEN 1 THEN '^(?:.*/)?[^/]*' || size % 10 || '\\.en$' WHEN 2 THEN '^e' || size || '$' WHEN 3 THEN '^(?:.*/)?f[1-' || (2 + size % 7) || ']' || size % 10 || '[^/]*$' END"


@query(
    "ignored_by_folder",
    f"""WITH f AS {sql('documents', _PATHS)}, r AS (SELECT folder, nth, kind = 1 AS back, kind = 2 AS dirs, {_RULE_SQL} AS regex FROM {sql('part', _RULES)} WHERE kind < 4),
    e AS (SELECT DISTINCT a AS entry, true AS dir, '' AS folder, a AS rest FROM f UNION SELECT DISTINCT a || '/' || b, true, unnest(['', a]), unnest([a || '/' || b, b]) FROM f UNION SELECT DISTINCT path, false, unnest(['', a, a || '/' || b]), unnest([path, b || '/' || name, name]) FROM f),
    m AS (SELECT entry, NOT arg_max(back, (len(e.folder), nth)) AS gone FROM e JOIN r ON e.folder = r.folder AND (dir OR NOT dirs) AND regexp_matches(rest, regex) GROUP BY entry),
    g AS (SELECT entry FROM m WHERE gone)
    SELECT path, a IN (FROM g) OR a || '/' || b IN (FROM g) OR path IN (FROM g) AS ignored FROM f""",
)
def ignored_by_folder(spark, d):
    rules = projected(spark, d, "part", _RULES).withColumn("rank", F.lit(repository.GITIGNORE))
    return repository.ignored_by(projected(spark, d, "documents", _PATHS), rules)


_FILES = {"path": "'f' || doc_id", "role": "CASE WHEN doc_id % 4 = 3 THEN 'config' ELSE 'source' END", "text": "text"}
_RANGES = {"file": "'f' || l_partkey % 400", "start": "CAST(floor(l_extendedprice) AS BIGINT) % 4000", "stop": "CAST(floor(l_extendedprice) AS BIGINT) % 4000 + CAST(floor(l_quantity) AS BIGINT) * 3 - 9", "keep": "l_suppkey % 9 = 2"}


@query(
    "role_split_sizes",
    f"""WITH f AS (SELECT path, role, coalesce(text, '') AS text FROM {sql('documents', _FILES)}), r AS (SELECT file, start, stop FROM {sql('lineitem', _RANGES)} WHERE keep AND start < stop),
    s AS (SELECT * FROM f WHERE role = 'source' AND path IN (SELECT file FROM r)),
    b AS (SELECT path, unnest(h) AS c, unnest(range(len(h))) AS pos FROM (SELECT path, regexp_extract_all(hex(encode(text)), '..') AS h FROM s)),
    t AS (SELECT DISTINCT file AS path, unnest(range(start, stop)) AS pos FROM r),
    l AS (SELECT path, c, t.pos IS NOT NULL AS test, c NOT IN ('20', '09', '0A', '0C', '0D') AS filled, coalesce(sum(CAST(c = '0A' AS INT)) OVER (PARTITION BY path ORDER BY b.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM b LEFT JOIN t USING (path, pos)),
    g AS (SELECT path, n, test, count(*) AS bytes, bool_or(filled) AS filled FROM l GROUP BY ALL), w AS (SELECT *, bool_or(filled) OVER (PARTITION BY path, n) AS held FROM g)
    SELECT path, CASE WHEN test THEN 'test' ELSE 'source' END AS role, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (WHERE filled OR NOT held) AS lines FROM w GROUP BY ALL
    UNION ALL SELECT path, role, CAST(octet_length(encode(text)) AS BIGINT), CAST(len(CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(text, '\\n\\z', ''), chr(10)) END) AS BIGINT) FROM f WHERE role <> 'source' OR path NOT IN (SELECT file FROM r)""",
)
def role_split_sizes(spark, d):
    return evidence.role_sizes(projected(spark, d, "documents", _FILES), projected(spark, d, "lineitem", _RANGES).where("keep"))
