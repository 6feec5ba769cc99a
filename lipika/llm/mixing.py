"""Mixing of sources to target weights by hierarchical budgeting.

The token budget runs down a tree (domain, language, source): a node's budget is shared among its children by their weights.  A child
that cannot use its share (its leaves' tokens times the most epochs) gets what it can, and the shortage goes to its siblings by their
weights; only what all of them cannot use is an ancestor's to redistribute.  A leaf's budget buys whole epochs of its documents and of
the next epoch, in that epoch's seeded order, the longest prefix that fits.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql import Window

from lipika.llm.common import BROADCAST_BYTES, counted_bytes, free_name, materialize

#: Parts that a leaf's rows are dealt to where the leaves' table is too large to broadcast.
SALTS = 64
#: A leaf's order is cut into so many parts, of which only the one that the budget ends in is summed row by row.
PARTS = 1024
PATH = ("domain", "lang", "source")
MILLION = 1_000_000


@dataclass
class Node:
    """A node's weight among its siblings and its children by name; ``default`` is the weight of children not named."""

    weight: float = 1.0
    children: dict[str, Node] = field(default_factory=dict)
    default: float = 1.0

    def child(self, name: str) -> Node:
        return self.children.get(name) or Node(self.default)


def weighted(leaves: DataFrame, root: Node) -> DataFrame:
    """``leaves`` with the weights, in millionths, of their nodes at each depth: w1, w2, w3.  The tree's named nodes are a parameter, so broadcast."""
    spark, named = leaves.sparkSession, {(): root}
    for _ in PATH:
        named |= {(*path, name): child for path, node in named.items() for name, child in node.children.items()}
    for n in range(1, len(PATH) + 1):
        names = [f"{x} string" for x in PATH[:n]]
        given = spark.createDataFrame([(*path, round(node.weight * MILLION)) for path, node in named.items() if len(path) == n], ", ".join([*names, "given long"]))
        others = spark.createDataFrame([(*path, round(node.default * MILLION)) for path, node in named.items() if len(path) == n - 1], ", ".join([*names[:-1], "others long"]))
        leaves = leaves.join(F.broadcast(given), list(PATH[:n]), "left")
        leaves = leaves.join(F.broadcast(others), list(PATH[: n - 1]), "left") if n > 1 else leaves.withColumn("others", F.lit(round(root.default * MILLION)))
        leaves = leaves.withColumn(f"w{n}", F.coalesce("given", "others", F.lit(MILLION))).drop("given", "others")
    return leaves


def budgets(leaves: DataFrame, root: Node, total: int, epochs: int) -> DataFrame:
    """``leaves`` (path and tokens) with each leaf's ``budget``.

    Level by level, a node's budget is filled into its children in order of (what they can use / weight): those that their share by weight suffices get all they
    can use, the others share the rest by weight, rounded down.  Weights count in millionths, so every engine gets the same.
    """
    leaves = weighted(leaves, root)
    above = None
    for n in range(1, len(PATH) + 1):
        keys, parents = list(PATH[:n]), list(PATH[: n - 1])
        usable = F.lit(True)
        for m in range(n + 1, len(PATH) + 1):
            usable = usable & (F.col(f"w{m}") > 0)
        nodes = leaves.groupBy(*keys).agg(F.first(f"w{n}").alias("given"), F.sum(F.when(usable, F.col("tokens")).otherwise(0)).alias("supply"))
        nodes = nodes.withColumn("above", F.lit(total).cast("long")) if above is None else nodes.join(above, parents)
        live = F.col("given") > 0
        nodes = nodes.select(
            *keys,
            F.when(live, F.col("given")).otherwise(0).cast("decimal(18,0)").alias("weight"),
            F.when(live, F.col("supply") * epochs).otherwise(0).cast("decimal(19,0)").alias("cap"),
            F.col("above").cast("decimal(19,0)").alias("above"),
        )
        siblings = Window.partitionBy(*parents)
        order = F.when(F.col("weight") > 0, F.col("cap").cast("double") / F.col("weight").cast("double")).otherwise(-1.0)
        earlier = siblings.orderBy(order, keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
        nodes = nodes.select(
            "*",
            (F.col("above") - F.coalesce(F.sum("cap").over(earlier), F.lit(0))).cast("decimal(19,0)").alias("room"),
            (F.sum("weight").over(siblings) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))).cast("decimal(18,0)").alias("rest"),
        ).withColumn("short", F.col("cap") * F.col("rest") > F.col("room") * F.col("weight"))
        nodes = nodes.select(
            "*", F.max(F.when(F.col("short"), F.col("room"))).over(siblings).alias("to_share"), F.max(F.when(F.col("short"), F.col("rest"))).over(siblings).alias("by_weight")
        )
        share = F.when(F.col("short"), F.least(F.col("cap").cast("long"), F.expr("(to_share * weight) div by_weight"))).otherwise(F.col("cap").cast("long"))
        above = nodes.select(*keys, share.alias("above"))
    return leaves.select(*PATH, "tokens").join(above.withColumnRenamed("above", "budget"), list(PATH))


def join_leaves(rows: DataFrame, leaves: DataFrame, names: list[str], path: list[Column], salt: Column) -> DataFrame:
    """``rows`` with the columns of their leaf, whose path is in ``names``: by broadcast if the leaves' counted bytes are few, else shuffled by path and ``salt``,
    so that a hot leaf's rows are spread."""
    dealt = free_name(rows, "dealt")
    if counted_bytes(leaves) <= BROADCAST_BYTES:
        leaves, same = F.broadcast(leaves), F.lit(True)
    else:
        leaves = leaves.withColumn(dealt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        same = F.pmod(F.xxhash64(salt), F.lit(SALTS)) == F.col(dealt)
    for name, of in zip(names, path):
        same = same & (of == F.col(name))
    return rows.join(leaves, same).select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col(c) for c in leaves.columns if c not in (*names, dealt)])


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")).cast("long")


def epoch_rank(key: Column, epoch: Column, seed: int) -> Column:
    """A document's place in an epoch's order: 60 bits of an MD5 of seed, epoch and key (any SQL engine can compute it)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 15), 16, 10).cast("long")


def plan(docs: DataFrame, root: Node, domain: Column, share: float, epochs: int, seed: int, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, path and tokens; cuts: for each leaf its whole epochs, the last epoch's number and its last rank).

    ``share`` of the corpus' tokens is the total budget.
    """
    spark = docs.sparkSession
    path = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(PATH, (domain, F.col(lang), F.col(source)))]
    slim = materialize(docs.select(F.col(key).cast("long").alias("doc_id"), *path, token_count(F.col(text)).alias("tokens")), "tokens")
    leaves = materialize(slim.groupBy(*PATH).agg(F.sum("tokens").alias("tokens")), "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0)
    rest = F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0)
    table = materialize(budgets(leaves, root, int(share * total), epochs).select(*PATH, "budget", whole.alias("epochs"), rest.alias("rest")), "budgets")
    ranked = _with_leaf(slim, table.where("rest > 0")).withColumn("rank", epoch_rank(F.col("doc_id"), F.col("epochs"), seed))
    part = F.shiftright("rank", 50)
    before = Window.partitionBy(*PATH).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        ranked.groupBy(*PATH, "rest", part.alias("part"))
        .agg(F.sum("tokens").alias("n"))
        .withColumn("to", F.sum("n").over(before))
        .where("to > rest")
        .groupBy(*PATH)
        .agg(F.min(F.struct("part", (F.col("rest") - (F.col("to") - F.col("n"))).alias("room"))).alias("end"))
        .select(*PATH, F.col("end.part").alias("part"), F.col("end.room").alias("room"))
    )
    ends = materialize(ends, "ends")
    peers = Window.partitionBy(*PATH).orderBy("rank").rangeBetween(Window.unboundedPreceding, 0)
    cuts = (
        _with_leaf(ranked, ends)
        .where(part == F.col("part"))
        .withColumn("to", F.sum("tokens").over(peers))
        .where("to <= room")
        .groupBy(*PATH)
        .agg(F.max("rank").alias("last"))
    )
    cuts = materialize(table.join(ends, list(PATH), "left").join(cuts, list(PATH), "left"), "cuts")
    # without a row of the last part, the prefix ends before that part; without such a part it is everything
    last = F.when(F.col("rest") <= 0, F.lit(-1)).otherwise(
        F.coalesce("last", F.shiftleft(F.col("part"), 50) - 1, F.lit((1 << 63) - 1))
    )
    return slim, cuts.select(*PATH, "budget", "epochs", last.cast("long").alias("last"))


def _with_leaf(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    names = [f"leaf_{n}" for n in PATH]
    return join_leaves(rows, leaves.withColumnsRenamed(dict(zip(PATH, names))), names, [F.col(n) for n in PATH], F.col("doc_id"))


def mix(docs: DataFrame, root: Node, domain: Column, share: float, epochs: int, seed: int) -> DataFrame:
    """(doc_id, domain, lang, source, tokens, budget, copies) of every document that is taken, ``copies`` times.

    A document is taken whole; equal keys stand at the same place and are taken together or not at all; a null key, text, language or
    source counts as empty; a document without words is taken with its place in the order; leaves of weight zero are left out; an
    empty table gives an empty result; other columns are ignored.
    """
    slim, cuts = plan(docs, root, domain, share, epochs, seed)
    taken = F.col("epochs") + (epoch_rank(F.col("doc_id"), F.col("epochs"), seed) <= F.col("last")).cast("long")
    return (
        _with_leaf(slim, cuts)
        .withColumn("copies", taken)
        .where("copies > 0")
        .select("doc_id", *PATH, "tokens", "budget", "copies")
    )


def keep_mixed(docs: DataFrame, root: Node, domain: Column, share: float, seed: int) -> DataFrame:
    """``docs`` in the target mix, each at most once; all columns come back as they were, and no column name is taken.  The texts are not shuffled.

    Nulls, ties, repeated rows and empty tables are taken as ``mix`` takes them.
    """
    _, cuts = plan(docs, root, domain, share, 1, seed)
    name = {n: free_name(docs, f"cut_{n}") for n in (*PATH, "epochs", "last")}
    cuts = cuts.select(*[F.col(n).alias(x) for n, x in name.items()])
    path = [F.coalesce(c.cast("string"), F.lit("")) for c in (domain, F.col("lang"), F.col("source"))]
    rank = epoch_rank(F.col("doc_id").cast("long"), F.col(name["epochs"]), seed)
    return join_leaves(docs, cuts, [name[n] for n in PATH], path, F.col("doc_id")).where((F.col(name["epochs"]) > 0) | (rank <= F.col(name["last"]))).select(*docs.columns)


def mix_sql(root: Node, domain: str, share: float, epochs: int, seed: int) -> str:
    """DuckDB's form of ``mix`` over ``documents``; ``domain`` is SQL for a document's domain."""
    named = {(): root}
    for _ in PATH:
        named |= {(*path, name): child for path, node in named.items() for name, child in node.children.items()}
    weights = [(*(x.replace("'", "''") for x in (*path, "", "", "")[:3]), len(path), round(node.weight * MILLION)) for path, node in named.items() if path]
    defaults = [(*(x.replace("'", "''") for x in (*path, "", "")[:2]), len(path), round(node.default * MILLION)) for path, node in named.items() if len(path) < 3]
    rows = lambda found: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in found)
    levels = []
    for n in range(1, 4):
        keys, above = PATH[:n], PATH[: n - 1]
        default = f"coalesce((SELECT weight FROM defaults d WHERE d.depth = {n - 1}" + "".join(f" AND d.{k} = l.{k}" for k in above) + f"), {MILLION})"
        named_weight = f"(SELECT weight FROM weights w WHERE w.depth = {n} AND " + " AND ".join(f"w.{k} = l.{k}" for k in keys) + ")"
        levels.append(
            f"""w{n} AS (SELECT DISTINCT {', '.join(keys)}, coalesce({named_weight}, {default}) AS weight FROM leaves l),
"""
        )
    joins = " ".join(f"JOIN w{n} USING ({', '.join(PATH[:n])})" for n in (1, 2, 3))
    levels.append("b0 AS (SELECT total AS budget FROM total),\n")
    for n in range(1, 4):
        keys, above = PATH[:n], PATH[: n - 1]
        over = f"PARTITION BY {', '.join(above)} " if above else ""
        link = f"JOIN b{n - 1} USING ({', '.join(above)})" if above else "CROSS JOIN b0"
        # a node's own weight of zero is no limit on what it can use: its siblings' sharing leaves it out
        below = " AND ".join(f"w{m}.weight > 0" for m in range(n + 1, 4)) or "true"
        supply = f"sum(CASE WHEN {below} THEN tokens * {epochs} ELSE 0 END)"
        levels.append(
            f"""c{n} AS (SELECT {', '.join(keys)}, any_value(w{n}.weight) AS weight, CAST({supply} AS HUGEINT) AS cap FROM leaves {joins} GROUP BY {', '.join(keys)}),
f{n} AS (SELECT c{n}.*, CAST(budget AS HUGEINT) - coalesce(sum(cap) OVER o, 0) AS room, sum(weight) OVER ({over}) - coalesce(sum(weight) OVER o, 0) AS rest
  FROM c{n} {link} WHERE weight > 0 WINDOW o AS ({over}ORDER BY CAST(cap AS DOUBLE) / weight, {keys[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g{n} AS (SELECT *, min(CASE WHEN cap * rest > room * weight THEN CAST(cap AS DOUBLE) / weight END) OVER ({over}) AS stop,
  max(CASE WHEN cap * rest > room * weight THEN rest END) OVER ({over}) AS stop_rest, max(CASE WHEN cap * rest > room * weight THEN room END) OVER ({over}) AS stop_room FROM f{n}),
b{n} AS (SELECT {', '.join(keys)}, CAST(CASE WHEN cap * rest <= room * weight THEN cap ELSE least(cap, stop_room * weight // stop_rest) END AS BIGINT) AS budget FROM g{n}
  UNION ALL SELECT {', '.join(keys)}, 0 FROM c{n} WHERE weight <= 0),
"""
        )
    rank = f"CAST(concat('0x', substr(md5(concat('{seed}|', b // nullif(n, 0), '|', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 15)) AS BIGINT)"
    return f"""
WITH docs AS (SELECT doc_id, coalesce({domain}, '') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens) AS tokens FROM docs GROUP BY ALL),
total AS (SELECT CAST(floor({share!r} * sum(tokens)) AS BIGINT) AS total FROM leaves),
weights(domain, lang, source, depth, weight) AS (VALUES {rows(weights)}),
defaults(domain, lang, depth, weight) AS (VALUES {rows(defaults)}),
{''.join(levels)}ranked AS (SELECT docs.*, b3.budget AS b, leaves.tokens AS n FROM docs JOIN leaves USING (domain, lang, source) JOIN b3 USING (domain, lang, source)),
placed AS (SELECT *, {rank} AS place FROM ranked),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place RANGE UNBOUNDED PRECEDING) AS upto FROM placed),
taken AS (SELECT *, CASE WHEN n > 0 THEN CAST(b // n AS BIGINT) + CASE WHEN b % n > 0 AND upto <= b % n THEN 1 ELSE 0 END ELSE 0 END AS copies FROM summed)
SELECT doc_id, domain, lang, source, tokens, b AS budget, CAST(copies AS BIGINT) AS copies FROM taken WHERE copies > 0
"""
