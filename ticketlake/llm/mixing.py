"""Mixing sources to target weights over a tree of domains, languages and sources.

The token budget goes down the tree: a node's share is split among its children by their weights. A
child can take no more than its subtree holds in ``max_epochs`` passes; what it can't take goes to
its siblings, again by weight, and only what all siblings together can't take is missing at their
parent, whose own siblings then take it. In whole numbers: children are ordered by capacity for
each unit of weight; one is full if its capacity isn't above its share of what the full ones before
it leave; the others share the rest, rounded down.

A leaf reads its documents in epochs, each in a seeded order of its own, and takes the prefix of so
many tokens. Whole epochs take every document; in the last one a document is taken if it starts
inside the prefix.

Defined results: a null or empty text has no tokens and is taken if the prefix isn't over where it
stands; a null level value is a node of its own (the empty string); a leaf without tokens has no
capacity and takes nothing; values without a given weight weigh 1, and weight 0 takes nothing;
repeated rows of a doc_id share their place in an epoch's order; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ticketlake.llm.common import running_position, settle, small_join, whole_text

#: The sources' domains go by the number in their names.
DOMAINS = ("web", "news", "forum", "books")
LEVELS = ("domain", "language", "source")


@dataclass(frozen=True)
class Mixture:
    """Whole-number weights by level and value; a value that isn't listed weighs 1."""

    weights: Mapping[str, Mapping[str, int]] = field(
        default_factory=lambda: {
            "domain": {"web": 4, "news": 3, "forum": 2, "books": 3},
            "language": {"en": 4, "de": 2, "fr": 2, "es": 2},
        }
    )
    max_epochs: int = 4
    seed: int = 7
    #: Tokens to take; None takes as many as there are.
    budget: int | None = None

    def weight(self, level: str) -> Column:
        listed = self.weights.get(level, {})
        chosen = F.lit(1)
        for value, weight in listed.items():
            chosen = F.when(F.col(level) == value, weight).otherwise(chosen)
        return chosen.cast("decimal(38,0)")


def domain_of(source: Column) -> Column:
    """The domain of a source by the last number in its name; without a number, the first domain."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})[^0-9]*$", 1)
    place = F.pmod(F.coalesce(F.nullif(number, F.lit("")).cast("int"), F.lit(0)), F.lit(len(DOMAINS)))
    return F.element_at(F.array(*map(F.lit, DOMAINS)), place + 1)


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def leveled(docs: DataFrame) -> DataFrame:
    """``(doc_id, domain, language, source, tokens)`` of every row."""
    return docs.select(
        F.col("doc_id").cast("long"),
        domain_of(F.col("source")).alias("domain"),
        F.coalesce(F.col("lang"), F.lit("")).alias("language"),
        F.coalesce(F.col("source"), F.lit("")).alias("source"),
        token_count(whole_text()).alias("tokens"),
    )


def order_key(epoch: Column, seed: int, doc_id: str = "doc_id") -> Column:
    """A document's place in an epoch's order: 60 bits of a digest of seed, epoch and id."""
    name = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def _share(nodes: DataFrame, parents: list[str], level: str, mixture: Mixture) -> DataFrame:
    """Splits each parent's ``budget`` over its children ``(parents.., level, capacity, budget)``."""
    kind = "decimal(38,0)"
    weighted = nodes.withColumn("_w", mixture.weight(level)).filter("_w > 0")
    group = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    before = group.orderBy((F.col("capacity").cast("double") / F.col("_w").cast("double")), level).rowsBetween(
        Window.unboundedPreceding, -1
    )
    ordered = (
        weighted.withColumn("_weights", F.sum("_w").over(group))
        .withColumn("_w_before", F.coalesce(F.sum("_w").over(before), F.lit(0)).cast(kind))
        .withColumn("_c_before", F.coalesce(F.sum("capacity").over(before), F.lit(0)).cast(kind))
        .withColumn(
            "_full",
            F.expr(
                "cast(capacity as decimal(18,0)) * cast(_weights - _w_before as decimal(18,0))"
                " <= cast(_w as decimal(18,0)) * cast(budget - _c_before as decimal(18,0))"
            ),
        )
    )
    rest = ordered.withColumn(
        "_rest", F.col("budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("capacity"))).over(group), F.lit(0))
    ).withColumn(
        "_rest_w", F.col("_weights") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_w"))).over(group), F.lit(0))
    )
    share = F.expr(
        "case when _full then cast(capacity as bigint)"
        " else (cast(_w as decimal(18,0)) * cast(_rest as decimal(18,0))) div cast(_rest_w as decimal(18,0)) end"
    )
    return rest.withColumn("budget", share.cast(kind)).select(*parents, level, "capacity", "budget")


def allocate(documents: DataFrame, mixture: Mixture) -> DataFrame:
    """``(domain, language, source, leaf_tokens, take)``: one row for each leaf, top down.

    The leaves are the distinct level values of the corpus, not its documents; a window sees the
    children of one parent.
    """
    kind = "decimal(38,0)"
    leaves = documents.groupBy(*LEVELS).agg(F.sum("tokens").alias("leaf_tokens"))
    able = leaves
    for level in LEVELS:
        able = able.filter(mixture.weight(level) > 0)
    able = able.withColumn("capacity", (F.col("leaf_tokens") * mixture.max_epochs).cast(kind))
    whole = F.lit(mixture.budget) if mixture.budget is not None else F.sum("leaf_tokens")
    total = leaves.agg(F.coalesce(whole, F.lit(0)).cast(kind)).scalar()
    parents: list[str] = []
    for level in LEVELS:
        nodes = able.groupBy(*parents, level).agg(F.sum("capacity").cast(kind).alias("capacity"))
        if parents:
            nodes = nodes.join(budgets.select(*parents, "budget"), parents)
        else:
            nodes = nodes.withColumn("budget", total)
        budgets = _share(nodes, parents, level, mixture)
        parents = [*parents, level]
    return leaves.join(budgets, list(LEVELS), "left").select(
        *LEVELS, "leaf_tokens", F.coalesce(F.col("budget"), F.lit(0)).cast("long").alias("take")
    )


def _epochs(leaves: DataFrame) -> DataFrame:
    """Whole epochs of each leaf, and the tokens that the last, partial one takes."""
    tokens = F.col("leaf_tokens")
    return leaves.withColumn(
        "_whole", F.when(tokens > 0, F.expr("take div leaf_tokens")).otherwise(0).cast("int")
    ).withColumn("_part", F.when(tokens > 0, F.col("take") % tokens).otherwise(0))


def select_documents(documents: DataFrame, mixture: Mixture | None = None) -> DataFrame:
    """``(doc_id, domain, language, source, epoch, tokens, taken)``: one row each time a document is
    read. ``taken`` is below ``tokens`` where the prefix ends inside the document.

    ``documents`` comes from :func:`leveled` and is read several times; give it a checkpoint.
    """
    mixture = mixture or Mixture()
    leaves = _epochs(allocate(documents, mixture))
    planned = small_join(documents, leaves, LEVELS, F.col("doc_id")).withColumn(
        "_key", order_key(F.col("_whole") + 1, mixture.seed)
    )
    placed = running_position(planned, LEVELS, ["_key", "doc_id", "tokens"], F.col("tokens"), "_start")
    last = F.col("_whole") + (F.col("_start") < F.col("_part")).cast("int")
    return (
        placed.withColumn("_last", last)
        .filter("_last > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("_last"))))
        .withColumn(
            "taken",
            F.when(F.col("epoch") <= F.col("_whole"), F.col("tokens")).otherwise(
                F.least(F.col("tokens"), F.col("_part") - F.col("_start"))
            ),
        )
        .select("doc_id", *LEVELS, "epoch", "tokens", "taken")
    )


def mix_documents(docs: DataFrame, mixture: Mixture | None = None) -> DataFrame:
    """The rows of ``docs`` as often as they are read, whole, with their columns as they are.

    The last epoch of a leaf ends at a place in its order, so every row is judged by its own key
    against one row per leaf, and no text is shuffled as long as the leaves can be broadcast.
    """
    mixture = mixture or Mixture()
    documents = settle(leveled(docs))
    leaves = settle(_epochs(allocate(documents, mixture)), small=True)
    ends = (
        running_position(
            small_join(documents, leaves, LEVELS, F.col("doc_id")).withColumn(
                "_key", order_key(F.col("_whole") + 1, mixture.seed)
            ),
            LEVELS, ["_key", "doc_id", "tokens"], F.col("tokens"), "_start",
        )
        .filter(F.col("_start") < F.col("_part"))
        .groupBy(*LEVELS)
        .agg(F.max(F.struct("_key", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))).alias("_end"))
    )
    names = [f"_{c}" for c in LEVELS]
    cuts = leaves.join(ends, list(LEVELS), "left").select(
        *[F.col(c).alias(f"_{c}") for c in LEVELS], "_whole", "_end"
    )
    named = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        domain_of(F.col("source")).alias("_domain"),
        F.coalesce(F.col("lang"), F.lit("")).alias("_language"),
        F.coalesce(F.col("source"), F.lit("")).alias("_source"),
    )
    own = F.struct(
        order_key(F.col("_whole") + 1, mixture.seed, "row.doc_id").alias("_key"),
        F.coalesce(F.col("row.doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"),
    )
    times = F.col("_whole") + F.coalesce(own <= F.col("_end"), F.lit(False)).cast("int")
    return (
        small_join(named, cuts, names, F.col("row.doc_id"))
        .withColumn("_times", times)
        .filter("_times > 0")
        .withColumn("_epoch", F.explode(F.sequence(F.lit(1), F.col("_times"))))
        .select("row.*")
    )
