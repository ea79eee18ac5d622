"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

A tree of domains, languages and sources carries weights. A token budget flows from the root down: siblings share
their parent's budget by weight, none gets more than its subtree can supply, and what one cannot supply goes to its
siblings in proportion to their weights. Only what all siblings together cannot supply reaches the level above, where
the same rule holds. Each leaf then takes whole passes over its documents and a token-prefix of one more pass; every
pass has its own seeded order.

The prefix is found by counting, not by sorting a leaf: tokens are summed by slices of the seeded order (4,096 slices,
and 4,096 sub-slices of the slice in which the budget ends), so a leaf with a third of all rows is summed by all
tasks, and rows are put in order only inside the one sub-slice where the cut lies.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from grainmill.session import cut_lineage

LEVELS = ("domain", "lang", "source")
WORD = r"[^ \t\n\x0B\f\r]+"


def default_levels() -> dict[str, Column]:
    """Tree of the documents table: the number in a source's name modulo 4 is its domain; nulls are levels of their own."""
    number = F.coalesce(F.regexp_extract(F.coalesce("source", F.lit("")), r"([0-9]{1,9})$", 1).try_cast("int"), F.lit(0))
    return {
        "domain": F.concat(F.lit("d"), (number % 4).cast("string")),
        "lang": F.coalesce("lang", F.lit("?")),
        "source": F.coalesce("source", F.lit("?")),
    }


def weight_of(level: str, weights: Mapping[str, Mapping[str, float]]) -> Column:
    """A node's weight by its name; names without one weigh 1."""
    named = weights.get(level, {})
    return reduce(
        lambda rest, item: F.when(F.col(level) == item[0], F.lit(float(item[1]))).otherwise(rest),
        named.items(),
        F.lit(1.0),
    )


def share_out(nodes: DataFrame, parent: Sequence[str], budget: str, capacity: str, weight: str, name: str) -> DataFrame:
    """Add `<budget of the node>`: the parent's budget by weight, capped by capacity, shortages given to siblings.

    Siblings in the order of capacity / weight: the first of them are capped, and the rest share what is left by
    weight. A sibling is capped when its capacity is at most its share of what the ones before it left.
    """
    by = Window.partitionBy(*parent)
    order = by.orderBy("_ratio", name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    ranked = nodes.withColumn("_ratio", F.col(capacity) / F.col(weight))
    ranked = ranked.withColumn("_left", F.col(budget) - F.coalesce(F.sum(capacity).over(before), F.lit(0.0))).withColumn(
        "_weights", F.sum(weight).over(after)
    )
    ranked = ranked.withColumn("_capped", F.col("_ratio") * F.col("_weights") <= F.col("_left"))
    first = F.min(F.when(~F.col("_capped"), F.struct("_ratio", name, (F.col("_left") / F.col("_weights")).alias("level")))).over(by)
    given = F.when(F.col("_capped"), F.col(capacity)).otherwise(F.least(F.col(capacity), F.col(weight) * first["level"]))
    return ranked.withColumn("given", given).drop("_ratio", "_left", "_weights", "_capped")


def budgets(
    leaves: DataFrame,
    levels: Sequence[str],
    weights: Mapping[str, Mapping[str, float]],
    budget: float | None,
    max_epochs: int,
    share: float,
) -> DataFrame:
    """Leaf rows (levels, tokens) with `given`: the whole number of tokens a leaf is to contribute."""
    nodes = leaves.withColumn("capacity", F.col("tokens").cast("double") * max_epochs).where("capacity > 0")
    for level in levels:
        nodes = nodes.where(weight_of(level, weights) > 0)
    everything = Window.partitionBy(F.lit(0))
    total = F.sum(F.col("tokens").cast("double")).over(everything) * share if budget is None else F.lit(float(budget))
    nodes = nodes.withColumn("budget", F.least(total, F.sum("capacity").over(everything)))
    for depth, level in enumerate(levels):
        keys = list(levels[: depth + 1])
        tree = nodes.groupBy(*keys).agg(F.sum("capacity").alias("room"), F.max("budget").alias("budget"))
        tree = tree.withColumn("weight", weight_of(level, weights))
        parent = keys[:-1] or [F.lit(0)]
        shared = share_out(tree, parent, "budget", "room", "weight", level).select(*keys, F.col("given").alias("budget"))
        nodes = nodes.drop("budget").join(shared, keys)
    return nodes.select(*levels, "tokens", F.floor(F.col("budget") + 0.5).cast("long").alias("given"))


def seeded(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Place of a document in an epoch's order: 32 hexadecimal digits."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def cuts(narrow: DataFrame, leaves: DataFrame, levels: Sequence[str], seed: int) -> DataFrame:
    """Leaf rows with `full` (whole epochs) and the last place taken of the next epoch, `cut_key` and `cut_id`."""
    keys = list(levels)
    leaves = leaves.withColumn("full", F.floor(F.col("given") / F.col("tokens")).cast("long")).withColumn(
        "rest", F.col("given") - F.col("full") * F.col("tokens")
    )
    open_leaves = leaves.where("rest > 0").select(*keys, "full", "rest")
    rows = narrow.join(open_leaves, keys).select(
        *keys, "rest", seeded(seed, F.col("full"), F.col("id")).alias("key"), "id", F.col("words").alias("n")
    )
    found = open_leaves.select(*keys, F.lit("").alias("prefix"), F.lit(0).cast("long").alias("base"))
    for digits in (3, 6):
        sums = (
            rows.withColumn("slice", F.substring("key", 1, digits))
            .groupBy(*keys, "rest", "slice")
            .agg(F.sum("n").alias("n"))
            .join(found, keys)
            .where(F.col("slice").startswith(F.col("prefix")))
        )
        before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        found = (
            sums.withColumn("base", F.col("base") + F.coalesce(F.sum("n").over(before), F.lit(0)))
            .where((F.col("base") < F.col("rest")) & (F.col("rest") <= F.col("base") + F.col("n")))
            .select(*keys, F.col("slice").alias("prefix"), "base")
        )
    order = Window.partitionBy(*keys).orderBy("key", "id").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        rows.join(found, keys)
        .where(F.col("key").startswith(F.col("prefix")))
        .groupBy(*keys, "rest", "base", "key", "id")
        .agg(F.sum("n").alias("n"))
        .withColumn("start", F.col("base") + F.coalesce(F.sum("n").over(order), F.lit(0)))
        .where("start < rest")
        .groupBy(*keys)
        .agg(F.max(F.struct("key", "id")).alias("cut"))
        .select(*keys, F.col("cut.key").alias("cut_key"), F.col("cut.id").alias("cut_id"))
    )
    return leaves.join(last, keys, "left")


def mix(
    df: DataFrame,
    weights: Mapping[str, Mapping[str, float]],
    budget: float | None = None,
    share: float = 1.0,
    max_epochs: int = 2,
    seed: int = 7,
    levels: Mapping[str, Column] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    details: bool = False,
) -> DataFrame:
    """The rows of `df` chosen for the budget, a row once per epoch in which it is taken.

    `budget` is in tokens (words between ASCII white space); without one it is `share` of all tokens. No document is
    taken more than `max_epochs` times. A leaf's prefix ends with the document that reaches its budget, so each leaf
    exceeds it by less than one document. With `details` the result is id, epoch (from 0), the levels and tokens;
    otherwise it has the columns of `df`.

    Null texts have no tokens; a null source or language is a level of its own, named "?". A document without tokens
    is taken with the place it has in the order, and a leaf without any token contributes nothing. Repeated rows are
    taken together. Names absent from `weights` weigh 1; a weight of 0 shuts a branch out. Columns of any name may
    stand in `df`. An empty table gives no rows. Two narrow checkpoints are written: id, levels and tokens
    of every row, and the budgets of the leaves.
    """
    levels = dict(levels or default_levels())
    own = {f"_mix_{name}": expression for name, expression in levels.items()}
    place = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    narrow = cut_lineage(
        df.select(
            place.alias("id"),
            *[e.alias(name) for name, e in levels.items()],
            F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("words"),
        )
    )
    leaves = narrow.groupBy(*levels).agg(F.sum("words").alias("tokens"))
    leaves = cut_lineage(budgets(leaves, list(levels), weights, budget, max_epochs, share))
    ends = cuts(narrow, leaves, list(levels), seed)
    ends = ends.select(*[F.col(x).alias(f"_mix_{x}") for x in levels], *[F.col(x).alias(f"_mix_{x}") for x in ("full", "cut_key", "cut_id")])
    if details:
        rows = narrow.select(F.col("id").alias("_mix_id"), F.col("words").alias("_mix_n"), *[F.col(x).alias(f"_mix_{x}") for x in levels])
    else:
        rows = df.select("*", place.alias("_mix_id"), *[e.alias(x) for x, e in own.items()])
    rows = rows.join(ends, list(own))
    key = seeded(seed, F.col("_mix_full"), F.col("_mix_id"))
    partly = F.coalesce(
        (key < F.col("_mix_cut_key")) | ((key == F.col("_mix_cut_key")) & (F.col("_mix_id") <= F.col("_mix_cut_id"))),
        F.lit(False),
    )
    times = F.col("_mix_full") + partly.cast("long")
    rows = rows.withColumn("_mix_times", times).where("_mix_times > 0")
    rows = rows.withColumn("_mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_mix_times") - 1)))
    if details:
        unseen = F.when(F.col("_mix_id") != -(2**63), F.col("_mix_id"))
        return rows.select(
            unseen.alias(id_col), F.col("_mix_epoch").alias("epoch"), *[F.col(f"_mix_{x}").alias(x) for x in levels],
            F.col("_mix_n").alias("tokens"),
        )
    return rows.select(*df.columns)


def oracle(
    weights: Mapping[str, Mapping[str, float]], share: float, max_epochs: int, seed: int, table: str = "documents"
) -> str:
    """DuckDB SQL for `mix(..., details=True)` with the default levels of the documents table."""

    def weight(level: str) -> str:
        cases = "".join(f" WHEN {level} = '{k}' THEN {float(v)}" for k, v in weights.get(level, {}).items())
        return f"CASE{cases} ELSE 1.0 END" if cases else "1.0"

    steps, up = [], "root"
    for depth, level in enumerate(LEVELS):
        keys = ", ".join(LEVELS[: depth + 1])
        parent = ", ".join(LEVELS[:depth]) or "1"
        link = " AND ".join(f"t.{k} = p.{k}" for k in LEVELS[:depth]) or "TRUE"
        steps.append(f"""
        t{depth} AS (SELECT t.*, p.budget FROM (SELECT {keys}, SUM(tokens) * {max_epochs}::DOUBLE AS room,
                {weight(level)} AS w FROM leaf GROUP BY {keys}) t JOIN {up} p ON {link}),
        r{depth} AS (SELECT *, room / w AS ratio, budget - COALESCE(SUM(room) OVER (PARTITION BY {parent}
                ORDER BY room / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
                SUM(w) OVER (PARTITION BY {parent} ORDER BY room / w, {level}
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM t{depth}),
        l{depth} AS (SELECT *, first_value(left_over / ws) OVER (PARTITION BY {parent}
                ORDER BY (ratio * ws <= left_over)::INT, ratio, {level}
                ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS water FROM r{depth}),
        s{depth} AS (SELECT {keys}, CASE WHEN ratio * ws <= left_over THEN room
                ELSE LEAST(room, w * water) END AS budget FROM l{depth})""")
        up = f"s{depth}"
    join = " AND ".join(f"leaf.{k} = s.{k}" for k in LEVELS)
    return f"""WITH doc AS (SELECT doc_id, 'd' || (COALESCE(TRY_CAST(regexp_extract(COALESCE(source, ''),
            '([0-9]{{1,9}})$', 1) AS INT), 0) % 4) AS domain, COALESCE(lang, '?') AS lang, COALESCE(source, '?') AS source,
            len(regexp_extract_all(COALESCE(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))::BIGINT AS tokens FROM {table}),
        leaf AS (SELECT domain, lang, source, SUM(tokens)::BIGINT AS tokens FROM doc
            WHERE {" AND ".join(weight(level) + " > 0" for level in LEVELS)} GROUP BY ALL HAVING SUM(tokens) > 0),
        root AS (SELECT LEAST(SUM(tokens)::DOUBLE * {share}, SUM(tokens)::DOUBLE * {max_epochs}) AS budget FROM leaf),
        {",".join(steps).strip()},
        part AS (SELECT leaf.*, floor(s.budget + 0.5)::BIGINT AS given, floor(s.budget + 0.5)::BIGINT // tokens AS full_n
            FROM leaf JOIN {up} s ON {join}),
        placed AS (SELECT doc.*, p.full_n, p.given - p.full_n * p.tokens AS rest,
            COALESCE(SUM(doc.tokens) OVER (PARTITION BY doc.domain, doc.lang, doc.source
            ORDER BY md5('{seed}|' || p.full_n || '|' || doc.doc_id), doc.doc_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM doc JOIN part p ON doc.domain = p.domain AND doc.lang = p.lang AND doc.source = p.source),
        times AS (SELECT *, full_n + (before < rest)::INT AS n FROM placed)
        SELECT doc_id, unnest(range(0, n))::BIGINT AS epoch, domain, lang, source, tokens FROM times WHERE n > 0"""
