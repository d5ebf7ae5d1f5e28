"""Mixing sources to target weights over a tree of domains, languages and sources.

Weights are propagated from the root: a node's budget is shared among its children by weight, each
child taking at most what its leaves hold in ``max_epochs`` passes.  What a child cannot use goes
to its siblings first; only what all siblings cannot use goes back up.  Every leaf then reads its
documents in a seeded order, epoch after epoch, and takes the longest prefix within its budget.

All budgets are whole tokens and all shares are whole-number divisions, so results do not depend
on the order of sums.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import docs, prepare, stored

LEVELS = ("domain", "lang", "source")
#: A leaf's order is dealt into 16^3 parts by the first digits of the order key.
DIGITS = 3


@dataclass(frozen=True)
class Mix:
    """Weights are whole numbers; a child that is not named has weight ``other``."""

    domain: dict[str, int] = field(default_factory=lambda: {"d0": 4, "d1": 3, "d2": 2, "d3": 1})
    lang: dict[str, int] = field(default_factory=lambda: {"en": 5, "de": 2, "fr": 2, "es": 1})
    source: dict[str, int] = field(default_factory=dict)
    other: int = 1
    #: Share of the tokens of the input to select, in thousandths.
    budget_permille: int = 600
    max_epochs: int = 2
    seed: int = 10


def default_domain(source: Column) -> Column:
    """The domain of a source: its number modulo 4, d0 where it has none."""
    return F.concat(
        F.lit("d"), (F.concat(F.lit("0"), F.regexp_extract(source, "([0-9]{1,9})$", 1)).cast("long") % 4).cast("string")
    )


def n_tokens(text: Column) -> Column:
    """Words between white space; the unit of all budgets."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\x0B\\f\\r]+")), F.lit(0)).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(
        F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")
    )


#: Leaves up to which the budget table is broadcast (about 100 bytes each).
BROADCAST_LEAVES = 20_000


def _weight(table: dict[str, int], name: Column, other: int) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(name == k, F.lit(v)).otherwise(out)
    return out.cast("long")


def share_out(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Add ``alloc`` to nodes with ``budget`` (of their parent), ``weight`` and ``cap``.

    Siblings are met in order of cap / weight.  One that cannot use its share of what is left takes
    its cap and the others share the rest; from the first that can use its share on, all take it in
    proportion.  Fractions of a token stay unused.  A child of weight 0 takes nothing.

    Siblings of one cap / weight fare alike, so only sums by that number are ordered: a parent's
    children are never brought together.
    """
    df = nodes.withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(0)).withColumn(
        "ratio", F.col("cap").cast("double") / F.greatest(F.col("weight"), F.lit(1)).cast("double")
    )
    before = Window.partitionBy(*parent).orderBy("ratio").rowsBetween(Window.unboundedPreceding, -1)
    steps = df.groupBy(*parent, "ratio").agg(
        F.first("budget").alias("budget"), F.sum("cap").alias("c"), F.sum("weight").alias("w")
    )
    steps = steps.withColumn("left", F.greatest(F.col("budget") - F.coalesce(F.sum("c").over(before), F.lit(0)), F.lit(0)))
    steps = steps.withColumn(
        "w_left", F.sum("w").over(Window.partitionBy(*parent)) - F.coalesce(F.sum("w").over(before), F.lit(0))
    )
    first = steps.filter("c * w_left > left * w").groupBy(*parent).agg(F.min(F.struct("ratio", "left", "w_left")).alias("first"))
    df = df.join(first, parent, "left")
    full = F.col("first").isNull() | (F.col("ratio") < F.col("first.ratio"))
    return df.withColumn(
        "alloc", F.when(full, F.col("cap")).otherwise(F.expr("first.left * weight div first.w_left"))
    ).drop("ratio", "first")


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """``alloc`` tokens for each row of ``leaves`` (domain, lang, source, supply)."""
    tables = (mix.domain, mix.lang, mix.source)
    # A leaf below a node of weight 0 can use nothing, so no node above counts it.
    usable = F.lit(True)
    for table, level in zip(tables, LEVELS):
        usable = usable & (_weight(table, F.col(level), mix.other) > 0)
    caps = leaves.withColumn("cap", F.when(usable, F.col("supply") * mix.max_epochs).otherwise(0))
    budget = leaves.agg(F.expr(f"coalesce(sum(supply), 0) * {mix.budget_permille} div 1000")).first()[0]
    up = None
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        nodes = caps.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn(
            "weight", _weight(tables[depth], F.col(level), mix.other)
        )
        if depth:
            out = share_out(nodes.join(up, path[:-1]), path[:-1])
        else:
            out = share_out(nodes.withColumn("budget", F.lit(budget).cast("long")).withColumn("root", F.lit("")), ["root"])
        up = out.select(*path, F.col("alloc").alias("budget"))
    return leaves.join(up.withColumnRenamed("budget", "alloc"), list(LEVELS))


def mix_sources(
    df: DataFrame, mix: Mix = Mix(), domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """The selected rows of ``df`` with all their columns, and ``domain``, ``epoch``, ``n_tokens``.

    A row stands once for each epoch that takes it.  Null languages and sources are leaves named
    by the empty text.  A null or empty text has 0 tokens and is taken while its place in the order
    is within the budget.  Rows that repeat an id and a text are one document, taken or left
    together; rows of a null id are told apart by their text.  Columns of ``df`` named domain,
    epoch or n_tokens are replaced; names that start with ``__fs_`` are reserved.

    A leaf of any size is never sorted in one task: sums over the first digits of the order key
    find the part that holds the cut, and only that part's ids are ordered.
    """
    prepare(df.sparkSession)
    leaf = [f"__fs_{x}" for x in LEVELS]
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    rows = df.withColumns({
        "__fs_domain": F.coalesce(domain, F.lit("")) if domain is not None else default_domain(source),
        "__fs_lang": F.coalesce(F.col(lang_col).cast("string"), F.lit("")), "__fs_source": source,
        "__fs_n": n_tokens(F.col(text_col)), "__fs_id": F.coalesce(F.col(id_col).cast("string"), F.lit("")),
        "__fs_h": F.xxhash64(F.col(text_col)),
    })
    narrow = stored(rows.groupBy("__fs_id", "__fs_h", *leaf).agg(F.sum("__fs_n").cast("long").alias("n")), "tokens")
    leaves = narrow.groupBy(*[F.col(a).alias(b) for a, b in zip(leaf, LEVELS)]).agg(F.sum("n").alias("supply"))
    budgets = leaf_budgets(leaves, mix).withColumn(
        "passes", F.expr(f"case when supply > 0 then least(alloc div supply, {mix.max_epochs}) else 0 end")
    )
    budgets = budgets.withColumn(
        "rest",
        F.when(F.col("passes") == mix.max_epochs, F.lit(-1)).otherwise(F.col("alloc") - F.col("passes") * F.col("supply"))
    )
    budgets = stored(
        budgets.select(
            *[F.col(b).alias(a) for a, b in zip(leaf, LEVELS)], F.col("passes").alias("__fs_passes"),
            F.col("rest").alias("__fs_rest")
        ),
        "budgets"
    )
    if budgets.count() <= BROADCAST_LEAVES:
        budgets = F.broadcast(budgets)
    key = order_key(
        mix.seed, F.col("__fs_passes"),
        F.when(F.col("__fs_id") != "", F.col("__fs_id")).otherwise(F.col("__fs_h").cast("string"))
    )
    dealt = narrow.join(budgets, leaf).filter("__fs_rest >= 0").withColumn("k", key).withColumn(
        "part", F.substring("k", 1, DIGITS)
    )
    run = Window.partitionBy(*leaf).orderBy("part")
    sums = dealt.groupBy(*leaf, "part", "__fs_rest").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(run))
    cut = sums.filter("upto > __fs_rest").groupBy(*leaf).agg(
        F.min(F.struct("part", (F.col("upto") - F.col("n")).alias("before"))).alias("c")
    ).select(*leaf, F.col("c.part").alias("__fs_cut"), F.col("c.before").alias("__fs_before"))
    cut = stored(cut, "cuts")
    cuts = F.broadcast(cut) if cut.count() <= BROADCAST_LEAVES else cut
    inside = Window.partitionBy(*leaf).orderBy("k", "__fs_id", "__fs_h").rowsBetween(Window.unboundedPreceding, 0)
    edge = dealt.join(cuts, leaf).filter("part = __fs_cut").withColumn(
        "upto", F.col("__fs_before") + F.sum("n").over(inside)
    ).filter("upto <= __fs_rest")
    edge = stored(edge.select("__fs_id", "__fs_h", *leaf, F.lit(True).alias("__fs_edge")), "edge")
    taken = rows.join(budgets, leaf).join(cuts, leaf, "left").join(edge, ["__fs_id", "__fs_h", *leaf], "left")
    part = F.substring(key, 1, DIGITS)
    more = (F.col("__fs_rest") >= 0) & (
        F.col("__fs_cut").isNull() | (part < F.col("__fs_cut")) | F.coalesce(F.col("__fs_edge"), F.lit(False))
    )
    n = F.col("__fs_passes").cast("int") + F.when(more, 1).otherwise(0)
    epochs = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    kept = [c for c in df.columns if c not in ("domain", "epoch", "n_tokens")]
    return taken.select(
        *kept, F.col("__fs_domain").alias("domain"), F.col("__fs_n").alias("n_tokens"), F.explode(epochs).alias("epoch")
    )


def op10_mixing(spark, sf_dir):
    """Query: the selected documents, epoch by epoch."""
    return mix_sources(docs(spark, sf_dir)).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def _weight_sql(level: str, table: dict[str, int], other: int) -> str:
    return f"CAST(CASE {' '.join(f"WHEN {level} = '{k}' THEN {v}" for k, v in table.items())} ELSE {other} END AS BIGINT)" if table else f"CAST({other} AS BIGINT)"


def _level_sql(level: str, parent: list[str], table: dict[str, int], other: int, up: str) -> str:
    path = ", ".join([*parent, level])
    over = f"PARTITION BY {', '.join(parent)}" if parent else ""
    weight = _weight_sql(level, table, other)
    on = " AND ".join(f"n.{p} = u.{p}" for p in parent) or "true"
    return f"""
{level}_n AS (SELECT {path}, CAST(sum(cap) AS BIGINT) AS cap, {weight} AS weight FROM caps GROUP BY {path}),
{level}_c AS (SELECT {path}, weight, CASE WHEN weight > 0 THEN cap ELSE 0 END AS cap FROM {level}_n),
{level}_r AS (SELECT n.*, u.budget, CAST(n.cap AS DOUBLE) / CAST(greatest(n.weight, 1) AS DOUBLE) AS ratio FROM {level}_c n JOIN {up} u ON {on}),
{level}_s AS (SELECT *, greatest(budget - coalesce(sum(cap) OVER b, 0), 0) AS rest, sum(weight) OVER f - coalesce(sum(weight) OVER b, 0) AS w_left
  FROM {level}_r WINDOW b AS ({over} ORDER BY ratio, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS ({over} ORDER BY ratio, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
{level}_f AS (SELECT *, cap * w_left <= rest * weight AS is_full FROM {level}_s),
{level}_p AS (SELECT *, max(CASE WHEN NOT is_full THEN rest END) OVER f AS s_left, max(CASE WHEN NOT is_full THEN w_left END) OVER f AS s_w
  FROM {level}_f WINDOW f AS ({over} ORDER BY ratio, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
{level}_b AS (SELECT {path}, CAST(CASE WHEN is_full THEN cap ELSE (s_left * weight) // s_w END AS BIGINT) AS budget FROM {level}_p),"""


def mixing_sql(mix: Mix = Mix()) -> str:
    """The query in DuckDB SQL."""
    usable = " AND ".join(
        f"{_weight_sql(level, table, mix.other)} > 0" for level,
        table in zip(LEVELS, (mix.domain, mix.lang, mix.source))
    )
    return f"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(lang, '') AS l, coalesce(source, '') AS s, 'd' || (CAST('0' || regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS BIGINT) % 4) AS domain,
         coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0) AS n_tokens FROM documents),
leaves AS (SELECT domain, l AS lang, s AS source, CAST(sum(n_tokens) AS BIGINT) AS supply FROM d GROUP BY domain, l, s),
caps AS (SELECT *, CASE WHEN {usable} THEN supply * {mix.max_epochs} ELSE 0 END AS cap FROM leaves),
root AS (SELECT CAST(sum(supply) AS BIGINT) * {mix.budget_permille} // 1000 AS budget FROM leaves),
{_level_sql("domain", [], mix.domain, mix.other, "root")}
{_level_sql("lang", ["domain"], mix.lang, mix.other, "domain_b")}
{_level_sql("source", ["domain", "lang"], mix.source, mix.other, "lang_b")}
plan AS (SELECT b.domain, b.lang, b.source, l.supply, b.budget, CASE WHEN l.supply > 0 THEN least(b.budget // l.supply, {mix.max_epochs}) ELSE 0 END AS passes
  FROM source_b b JOIN leaves l ON b.domain = l.domain AND b.lang = l.lang AND b.source = l.source),
keyed AS (SELECT d.*, p.passes, p.budget - p.passes * p.supply AS rest, md5('{mix.seed}:' || p.passes || ':' || d.doc_id) AS k
  FROM d JOIN plan p ON d.domain = p.domain AND d.l = p.lang AND d.s = p.source),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, l, s ORDER BY k, CAST(doc_id AS VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM keyed),
n AS (SELECT *, passes + CASE WHEN passes < {mix.max_epochs} AND upto <= rest THEN 1 ELSE 0 END AS copies FROM run)
SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(epoch AS INTEGER) AS epoch
FROM (SELECT *, unnest(range(0, copies)) AS epoch FROM n WHERE copies > 0) AS x
"""
