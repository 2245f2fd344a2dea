"""Queries of clone classes and merged alignments over the words of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clone_classes, clones
from .tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


K = 50
MIN_LINES = 2
_TOKENS = r"t AS (SELECT doc_id AS stream, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)"
_PASSAGES = f"""{_TOKENS}, win AS (SELECT stream, i - 1 AS i, list_slice(w, i, i + {K - 1}) AS g FROM t, LATERAL (SELECT unnest(range(1, len(w) - {K - 2})) AS i) WHERE len(w) >= {K}),
near AS (SELECT *, lag(g) OVER (PARTITION BY stream ORDER BY i) AS before FROM win),
stat AS (SELECT g, count(*) AS n, count(before) = count(*) AND min(before) = max(before) AS chained FROM near GROUP BY g HAVING count(*) > 1),
occ AS (SELECT stream, i, n, chained FROM near JOIN stat USING (g)),
beg AS (SELECT *, CASE WHEN chained AND lag(i) OVER o = i - 1 AND lag(n) OVER o = n THEN 0 ELSE 1 END AS begins FROM occ WINDOW o AS (PARTITION BY stream ORDER BY i)),
chain AS (SELECT stream, min(i) AS start, count(*) + {K - 1} AS tokens FROM (SELECT *, sum(begins) OVER (PARTITION BY stream ORDER BY i) AS c FROM beg) GROUP BY stream, c),
places AS (SELECT list_slice(w, start + 1, start + tokens) AS p, tokens, stream, start FROM chain JOIN t USING (stream))"""


def _streams(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("stream"), clones.word_tokens(F.col("text")).alias("tokens"))


@query("clone_places", f"WITH {_PASSAGES}, c AS (SELECT p, count(*) AS places FROM places GROUP BY p) SELECT stream, start, tokens, places FROM places JOIN c USING (p)")
def clone_places(spark, d):
    found = clone_classes.occurrences(_streams(spark, d), K)
    return found.join(clone_classes.classes(found).select("passage", "tokens", "places"), ["passage", "tokens"]).select("stream", "start", "tokens", "places")


@query("clone_classes", f"WITH {_PASSAGES} SELECT tokens, count(*) AS places, count(DISTINCT stream) AS streams, count(*) * (count(*) - 1) // 2 AS links, min(stream) AS least FROM places GROUP BY p, tokens")
def clone_class_rows(spark, d):
    found = clone_classes.occurrences(_streams(spark, d), K)
    least = found.groupBy("passage", "tokens").agg(F.min("stream").alias("least"))
    return clone_classes.classes(found).join(least, ["passage", "tokens"]).select("tokens", "places", "streams", "links", "least")


@query("clone_heavy_windows", f"WITH {_TOKENS}, win AS (SELECT list_slice(w, i, i + 7) AS g FROM t, LATERAL (SELECT unnest(range(1, len(w) - 6)) AS i) WHERE len(w) >= 8) SELECT count(*) AS n, g AS tokens FROM win GROUP BY g HAVING count(*) > 200")
def clone_heavy_windows(spark, d):
    """Passages of eight words that occur over 200 times, from the sketch of frequent hashes."""
    streams = _streams(spark, d)
    found = clones.windows(streams, 8)
    many = clone_classes.over_capacity(found, 200)
    shown = found.join(F.broadcast(many), "h").groupBy("h", "n").agg(F.min_by(F.struct("stream", "i"), F.struct("stream", "i")).alias("at"))
    rows = shown.select("n", "at.stream", "at.i").join(streams, "stream")
    return rows.select("n", F.slice("tokens", (F.col("i") + 1).cast("int"), 8).alias("tokens"))


_STEP = """{'done': CASE WHEN near AND whole OR hit THEN acc.done ELSE list_append(acc.done, acc.o) END,
 'o': CASE WHEN near AND whole THEN {'a': least(acc.o.a, x.a), 'ae': greatest(acc.o.ae, x.ae), 'b': least(acc.o.b, x.b), 'be': greatest(acc.o.be, x.be), 'fa': acc.o.fa, 'la': greatest(acc.o.la, x.la), 'fb': acc.o.fb, 'lb': greatest(acc.o.lb, x.lb)} WHEN hit THEN acc.o ELSE x END}"""
_STEP = (
    _STEP.replace("hit", "(x.a <= acc.o.ae AND x.ae >= acc.o.a OR x.b <= acc.o.be AND x.be >= acc.o.b)")
    .replace("near", "(x.fa <= acc.o.la + 2 AND x.fb <= acc.o.lb + 2 AND x.a <= acc.o.ae + 1 AND x.b <= acc.o.be + 1)")
    .replace("whole", "(acc.o.a - acc.o.b = x.a - x.b AND acc.o.a <= x.ae + 1 AND acc.o.b <= x.be + 1 OR list_slice(wa, least(acc.o.a, x.a) + 1, greatest(acc.o.ae, x.ae) + 1) = list_slice(wb, least(acc.o.b, x.b) + 1, greatest(acc.o.be, x.be) + 1))")
)


@query(
    "clone_coalesced",
    rf"""WITH l AS (SELECT doc_id AS stream, list_transform(string_split(coalesce(text, ''), chr(10)), lambda t: regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS ls FROM documents),
    t AS (SELECT stream, flatten(ls) AS w, flatten(list_transform(ls, lambda x, i: list_transform(x, lambda y: i))) AS l FROM l),
    win AS (SELECT stream, i - 1 AS i, l[i] AS f, l[i + {K - 1}] AS e, list_slice(w, i, i + {K - 1}) AS g FROM t, LATERAL (SELECT unnest(range(1, len(w) - {K - 2})) AS i) WHERE len(w) >= {K}),
    good AS (SELECT * FROM win WHERE e - f + 1 >= {MIN_LINES}),
    raw AS (SELECT a.stream AS sa, b.stream AS sb, {{'a': a.i, 'ae': a.i + {K - 1}, 'b': b.i, 'be': b.i + {K - 1}, 'fa': a.f, 'la': a.e, 'fb': b.f, 'lb': b.e}} AS x FROM good a JOIN good b USING (g) WHERE a.stream < b.stream OR (a.stream = b.stream AND b.f > a.e + {MIN_LINES} AND b.i > a.i)),
    pair AS (SELECT sa, sb, list(x ORDER BY x.fa, x.fb, x.b, x.a) AS xs FROM raw GROUP BY sa, sb),
    folded AS (SELECT sa, sb, list_reduce(xs[2:], lambda acc, x: {_STEP}, {{'done': xs[1:0], 'o': xs[1]}}) AS r FROM (SELECT pair.*, ta.w AS wa, tb.w AS wb FROM pair JOIN t ta ON sa = ta.stream JOIN t tb ON sb = tb.stream)),
    o AS (SELECT sa, sb, unnest(list_append(r.done, r.o)) AS m FROM folded)
    SELECT sa AS a, sb AS b, m.a AS a_start, m.b AS b_start, m.ae - m.a + 1 AS tokens, m.fa AS a_first, m.la AS a_last, m.fb AS b_first, m.lb AS b_last FROM o WHERE least(m.la - m.fa, m.lb - m.fb) + 1 >= {MIN_LINES}""",
)
def clone_coalesced(spark, d):
    return clone_classes.coalesced_texts(table(spark, d, "documents"), "doc_id", "text", K, MIN_LINES)
