"""Mixing sources to target weights.

Documents hang on a tree of domain, language and source. A token budget flows
down from the root: each node shares it among its children by weight, no child
gets more than its subtree can give (its tokens times `max_epochs`), and what
one child can't take goes to its siblings in proportion to their weights. Only
what all children of a node together can't take reaches the node's own
siblings, because the node's capacity is the sum of theirs. The share of a leaf
is filled by whole epochs of its documents and a prefix of one more, in an
order that a hash of seed, epoch and doc_id gives.

Water levels and prefixes are window sums over small tables: one row per node,
and one per leaf and range of hashes. Only the range in which a leaf's budget
ends is looked at row by row, so a hot leaf meets in no single task. Texts
aren't moved: a document is taken if its hash isn't above its leaf's cut.

Null domains, languages and sources count as "unknown", null texts as empty, and
a null doc_id as one more id. Rows that repeat a doc_id in a leaf follow each
other in order of their texts' digests and count one by one, so the budget is
kept to the token; of rows that are equal in both, any ones are taken. Shares
round down to whole tokens. All of it is DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import store

WORD = r"[^\x20\x09-\x0D]+"
LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mix:
    """Weights are positive integers up to 10,000; nodes that aren't named have weight 1."""

    domains: dict[str, int] = field(default_factory=dict)
    langs: dict[str, int] = field(default_factory=dict)
    sources: dict[str, int] = field(default_factory=dict)
    #: Percent of all tokens of one epoch that the mixture holds.
    percent: int = 60
    max_epochs: int = 4
    seed: int = 17
    #: Leading hex digits of the hash that name a range.
    digits: int = 3


PRODUCTION = Mix(domains={"web": 5, "books": 3, "forum": 1, "reference": 1}, langs={"en": 4, "de": 3, "fr": 2, "es": 1}, sources={"src0": 3})


def domain_of(source: Column) -> Column:
    """The domain of a source by its number: a quarter of the sources each."""
    n = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d+)$", 1)
    kind = F.pmod(F.expr("try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) as int)"), F.lit(4))
    return F.when(n == "", F.lit(None)).otherwise(F.element_at(F.array(*map(F.lit, ("web", "books", "forum", "reference"))), kind + 1))


def _weight(name: Column, weights: dict[str, int]) -> Column:
    if not weights:
        return F.lit(1).cast("long")
    known = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    return F.coalesce(F.try_element_at(known, name), F.lit(1)).cast("long")


def share(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Divide `budget`, the same on all rows of a parent, by `weight` and at most `capacity`: adds `share`.

    In order of capacity per weight, a child is full if its capacity isn't above
    its part of what the children before it leave.
    """
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("capacity").cast("double") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    out = nodes.withColumn("used", F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("weights", F.sum("weight").over(after))
    out = out.withColumn("full", F.col("capacity") * F.col("weights") <= F.col("weight") * (F.col("budget") - F.col("used")))
    out = out.withColumn("left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(by), F.lit(0)))
    out = out.withColumn("open", F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(by), F.lit(0)))
    part = F.when(F.col("full"), F.col("capacity")).otherwise(F.expr("weight * left div nullif(open, 0)"))
    return out.withColumn("share", part).drop("used", "weights", "full", "left", "open")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """(domain, lang, source, tokens) to the same with the share of each leaf."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * mix.max_epochs)
    total = leaves.agg(F.expr(f"coalesce(sum(tokens), 0) * {mix.percent} div 100").alias("budget"))
    domains = leaves.groupBy("domain").agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(F.col("domain"), mix.domains))
    domains = share(domains.crossJoin(F.broadcast(total)), [], "domain").select("domain", F.col("share").alias("budget"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(F.col("lang"), mix.langs))
    langs = share(langs.join(domains, "domain"), ["domain"], "lang").select("domain", "lang", F.col("share").alias("budget"))
    leaves = leaves.withColumn("weight", _weight(F.col("source"), mix.sources))
    return share(leaves.join(langs, ["domain", "lang"]), ["domain", "lang"], "source").select(*LEVELS, "tokens", "share")


def _leaf_columns(docs: DataFrame, domain: Column | None) -> dict[str, Column]:
    domain = domain_of(F.col("source")) if domain is None else domain
    return {"__mix_domain": F.coalesce(domain, F.lit("unknown")), "__mix_lang": F.coalesce("lang", F.lit("unknown")), "__mix_source": F.coalesce("source", F.lit("unknown"))}


def _order(mix: Mix, epoch: Column) -> Column:
    """The place of a row in an epoch: a hash of the seed, the epoch and its id, then the digest of its text."""
    return F.concat(F.md5(F.concat_ws(":", F.lit(str(mix.seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), F.col("__mix_tie"))


def plan(tokens: DataFrame, mix: Mix) -> DataFrame:
    """One row per leaf: whole epochs, the cut of the epoch after them, and the tokens taken of the rows at the cut."""
    leaves = tokens.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    leaf = store(budgets(leaves, mix).where("tokens > 0").select(*LEVELS, F.expr("share div tokens").alias("epochs"), F.expr("share % tokens").alias("rest")), "leaves")
    placed = tokens.join(leaf, list(LEVELS)).where("rest > 0").select(*LEVELS, "n_tokens", "rest", _order(mix, F.col("epochs")).alias("place"))
    placed = placed.withColumn("range", F.substring("place", 1, mix.digits))
    ranges = placed.groupBy(*LEVELS, "range").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    before = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    last = ranges.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where("before < rest").groupBy(*LEVELS).agg(F.max(F.struct("range", "before")).alias("x")).select(*LEVELS, "x.range", "x.before")
    close = placed.join(last, [*LEVELS, "range"]).groupBy(*LEVELS, "place").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("start"))
    inside = Window.partitionBy(*LEVELS).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    close = close.withColumn("before", F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0))).where("before < rest")
    cuts = close.groupBy(*LEVELS).agg(F.max(F.struct("place", (F.col("rest") - F.col("before")).alias("taken"))).alias("x")).select(*LEVELS, F.col("x.place").alias("cut"), F.col("x.taken").alias("at_cut"))
    return store(leaf.join(cuts, list(LEVELS), "left").select(*LEVELS, "epochs", "cut", "at_cut"), "plan")


def _tie(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def count_tokens(docs: DataFrame, domain: Column | None = None) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, __mix_tie), stored: one pass over the texts."""
    leaf = [c.alias(n) for n, c in zip(LEVELS, _leaf_columns(docs, domain).values())]
    return store(docs.select("doc_id", *leaf, _words(F.col("text")).alias("n_tokens"), _tie(F.col("text")).alias("__mix_tie")), "tokens")


def _words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _at_cut(rows: DataFrame, leaf: list[str], epochs: str, n: Column, cut: str, at_cut: str, mix: Mix) -> tuple[DataFrame, DataFrame]:
    """Rows apart from their leaf's cut with `__mix_in`, whether the begun epoch has them, and the rows at the cut, equal ones in a row, with `__mix_took`, the tokens taken of each."""
    place = _order(mix, F.col(epochs))
    at = F.coalesce(place == F.col(cut), F.lit(False))
    nth = Window.partitionBy(*leaf).orderBy("__mix_tie")
    tied = rows.where(at).withColumn("__mix_took", F.greatest(F.col(at_cut) - (F.row_number().over(nth) - 1) * n, F.lit(0)))
    return rows.where(~at).withColumn("__mix_in", F.coalesce(place < F.col(cut), F.lit(False))), tied


def mixture(docs: DataFrame, mix: Mix = PRODUCTION, domain: Column | None = None) -> DataFrame:
    """Rows (doc_id, domain, lang, source, epoch, n_tokens, n_taken): each document in each epoch that takes it."""
    tokens = count_tokens(docs, domain)
    apart, tied = _at_cut(tokens.join(plan(tokens, mix), list(LEVELS)), list(LEVELS), "epochs", F.col("n_tokens"), "cut", "at_cut", mix)
    out = ["doc_id", *LEVELS, "epoch", "n_tokens"]
    each = lambda rows, last: rows.withColumn("last", last).where("last >= 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    whole = each(apart, F.col("epochs") - F.when(F.col("__mix_in"), 0).otherwise(1)).select(*out, F.col("n_tokens").alias("n_taken"))
    ends = F.col("epoch") == F.col("epochs")
    part = each(tied, F.col("epochs") - F.when(F.col("__mix_took") > 0, 0).otherwise(1)).select(*out, F.when(ends, F.least("n_tokens", "__mix_took")).otherwise(F.col("n_tokens")).alias("n_taken"))
    return whole.union(part)


def take_documents(docs: DataFrame, mix: Mix, domain: Column | None = None) -> DataFrame:
    """The documents that the mixture takes at least once, whole and with all their columns."""
    leaf = _leaf_columns(docs, domain)
    leaves = plan(count_tokens(docs, domain), mix).select(*(F.col(n).alias(k) for n, k in zip(LEVELS, leaf)), F.col("epochs").alias("__mix_epochs"), F.col("cut").alias("__mix_cut"), F.col("at_cut").alias("__mix_at"))
    rows = docs.withColumns(leaf).withColumn("__mix_tie", _tie(F.col("text"))).join(leaves, list(leaf))
    apart, tied = _at_cut(rows, list(leaf), "__mix_epochs", _words(F.col("text")), "__mix_cut", "__mix_at", mix)
    took = lambda rows, begun: rows.where((F.col("__mix_epochs") > 0) | begun).select(*docs.columns)
    return took(apart, F.col("__mix_in")).union(took(tied, F.col("__mix_took") > 0))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _case(column: str, weights: dict[str, int]) -> str:
    return "CASE " + column + "".join(f" WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END" if weights else "1"


def _share_sql(name: str, source: str, parents: str, key: str, out: str) -> str:
    by = f"PARTITION BY {parents}" if parents else ""
    order = f"{by} ORDER BY CAST(capacity AS DOUBLE) / weight, {key}"
    keys = ", ".join(x for x in (parents, key) if x)
    return f"""
{name}_a AS (SELECT *, coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM {source}),
{name}_b AS (SELECT *, capacity * weights <= weight * (budget - used) AS is_full FROM {name}_a),
{name}_c AS (SELECT *, budget - coalesce(sum(CASE WHEN is_full THEN capacity END) OVER ({by}), 0) AS rest_budget,
    coalesce(sum(CASE WHEN NOT is_full THEN weight END) OVER ({by}), 0) AS open_weight FROM {name}_b),
{name} AS (SELECT {keys}, {out} CASE WHEN is_full THEN capacity ELSE weight * rest_budget // nullif(open_weight, 0) END AS budget FROM {name}_c)"""


def oracle(mix: Mix = PRODUCTION) -> str:
    kind = "TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % 4"
    return rf"""
WITH t AS (SELECT doc_id, coalesce(CASE {kind} WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'forum' WHEN 3 THEN 'reference' END, 'unknown') AS domain,
    coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS n_tokens, md5(coalesce(text, '')) AS tie FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * {mix.max_epochs} AS capacity FROM t GROUP BY ALL),
d_in AS (SELECT domain, sum(capacity) AS capacity, {_case('domain', mix.domains)} AS weight, (SELECT sum(tokens) * {mix.percent} // 100 FROM leaves) AS budget FROM leaves GROUP BY domain),
{_share_sql('d', 'd_in', '', 'domain', '')},
l_in AS (SELECT domain, lang, sum(capacity) AS capacity, {_case('lang', mix.langs)} AS weight, any_value(budget) AS budget FROM leaves JOIN d USING (domain) GROUP BY domain, lang),
{_share_sql('l', 'l_in', 'domain', 'lang', '')},
s_in AS (SELECT domain, lang, source, tokens, capacity, {_case('source', mix.sources)} AS weight, budget FROM leaves JOIN l USING (domain, lang)),
{_share_sql('s', 's_in', 'domain, lang', 'source', 'tokens,')},
p AS (SELECT domain, lang, source, budget // tokens AS epochs, budget % tokens AS rest FROM s WHERE tokens > 0),
h AS (SELECT t.*, epochs, rest, md5('{mix.seed}:' || CAST(epochs AS BIGINT) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) || tie AS hash FROM t JOIN p USING (domain, lang, source)),
c AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h),
e AS (SELECT *, unnest(range(0, CAST(epochs AS BIGINT) + CASE WHEN before < rest THEN 1 ELSE 0 END)) AS epoch FROM c)
SELECT doc_id, domain, lang, source, epoch, n_tokens, CAST(CASE WHEN epoch = epochs THEN least(n_tokens, rest - before) ELSE n_tokens END AS BIGINT) AS n_taken FROM e
"""
