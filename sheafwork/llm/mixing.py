"""Mixing sources to target weights by temperature (DataFrame functions only).

A source with the share s of all tokens gets a weight in proportion to s ** exponent; exponent 1 leaves the mix
as it is, 0 gives every source the same.  The exponent is found by bisection, and the weights are realised as a budget of
tokens for each source: whole passes over the source, then a prefix of one more pass in a random order.  That order is a
permutation of blocks: a row's block is the leading bits of a hash of its id and text, and only the one block in which a source's budget ends is ordered row by row.
So nothing is sorted as a whole, and a source that holds a third of all rows is never in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Exponents tried in each round of the search, and rounds: the exponent is exact to (HIGH - LOW) / WAYS ** ROUNDS.
WAYS, ROUNDS, LOW, HIGH = 32, 5, 0.0, 4.0
#: Sources whose plan is broadcast, at most: a hundred bytes each.
FEW = 50_000


def tokens_of(text: Column) -> Column:
    """Words of a text, as separated by ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def find_exponent(sources: DataFrame, budget: float, target_entropy: float, max_epochs: float) -> float:
    """The largest exponent whose mix has at least ``target_entropy`` of the highest possible entropy, as near to it as ``max_epochs`` allows.

    ``sources`` has one row per source with its tokens; every round is one aggregation of it for all tried exponents of all goals at once. The entropy
    falls as the exponent rises. How often a source is repeated is a monotone function of its share, so the smallest source (exponents below 1) and the largest one (above) tell
    whether a limit of repetitions holds: exponents that keep it are a range around 1.
    """
    positive = sources.where("tokens > 0").select(F.col("tokens").cast("double").alias("n"))
    total, count, smallest, largest = positive.agg(F.sum("n"), F.count("*"), F.min("n"), F.max("n")).first()
    if not count or count == 1:
        return 1.0
    want = target_entropy * math.log(count)
    repeats = lambda n, x, z: (n / total) ** x / z * budget / n
    # For each goal the range that holds its boundary: the test is true below it and false above.
    goals = {"entropy": (LOW, HIGH, lambda x, z, pl: math.log(z) - x * pl / z >= want - 1e-12)}
    if max_epochs:
        goals["least"] = (LOW, 1.0, lambda x, z, pl: repeats(smallest, x, z) > max_epochs * (1 + 1e-9))
        goals["most"] = (1.0, HIGH, lambda x, z, pl: repeats(largest, x, z) <= max_epochs * (1 + 1e-9))
    span = {g: (low, high) for g, (low, high, _) in goals.items()}
    grid = lambda low, high: [low + i * (high - low) / WAYS for i in range(WAYS + 1)]
    for _ in range(ROUNDS):
        tried = F.explode(F.array(*[F.lit(x) for x in sorted({x for s in span.values() for x in grid(*s)})])).alias("x")
        z = positive.select((F.col("n") / total).alias("s"), tried).select("x", F.pow("s", "x").alias("p"), F.log("s").alias("l"))
        stats = {r.x: r for r in z.groupBy("x").agg(F.sum("p").alias("z"), F.sum(F.col("p") * F.col("l")).alias("pl")).collect()}
        for g, (_, _, ok) in goals.items():
            low, high = span[g]
            good = [x for x in grid(low, high) if ok(x, stats[x].z, stats[x].pl)]
            span[g] = (low, low) if not good else (max(good), min(high, max(good) + (high - low) / WAYS))
    x = span["entropy"][0]
    return min(max(x, span["least"][1]), span["most"][0]) if max_epochs else x


def _order(id_col: str, text_col: str, seed: int) -> Column:
    """The random place of a row in its source, as 64 bits: of its id and text, so rows without an id, or with one that repeats, have places of their own."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")), F.lit(seed))


#: Ordered as unsigned numbers, as the blocks are.
def _unsigned(u: Column) -> Column:
    return u.bitwiseXOR(F.lit(-(2**63)))


def _block() -> Column:
    return F.expr("shiftrightunsigned(u, 1) div shiftleft(1L, 63 - bits)")


def _with(rows: DataFrame, plan: DataFrame, few: bool, wanted: list[str]) -> DataFrame:
    """``rows`` (source, u, …) with columns of their source's plan."""
    if few:
        return rows.join(F.broadcast(plan.select(F.col("source").alias("of"), *wanted)), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    return common.spread_join(rows, plan, "source", "rows", "u", wanted)


def _plan(rows: DataFrame, budget_tokens: int | None, target_entropy: float, max_epochs: float, block_tokens: int) -> tuple[DataFrame, bool]:
    """What becomes of each source: source, tokens, rows, weight, passes, rest, bits, last and cut (where its part of a pass ends); and whether sources are few.

    ``rows``: source, tokens, u. With its source's plan a row's copies follow from its own u alone.
    """
    sources = common.stage(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")), "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget_tokens is None else budget_tokens
    if max_epochs and budget > max_epochs * total:
        raise ValueError(f"a budget of {budget} tokens needs more than {max_epochs} passes over {total}")
    x = find_exponent(sources, budget, target_entropy, max_epochs)

    z = sources.where("tokens > 0").agg(F.sum(F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(x)))).first()[0] or 1.0
    plan = sources.withColumn("weight", F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(x)) / F.lit(z)).otherwise(F.lit(0.0)))
    quota = F.floor(F.col("weight") * F.lit(float(budget)))
    plan = plan.withColumn("passes", F.when(F.col("tokens") > 0, F.floor(quota / F.col("tokens"))).otherwise(F.lit(1)).cast("long"))
    plan = plan.withColumn("rest", F.when(F.col("tokens") > 0, quota - F.col("passes") * F.col("tokens")).otherwise(F.lit(0)).cast("long"))
    # Blocks are a power of two, so that each is a range of u; 2 ** 24 at most.
    plan = plan.withColumn("bits", F.least(F.lit(24), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("tokens") / F.lit(float(block_tokens))))))).cast("int"))
    plan = common.stage(plan, "plan")

    few = sources.count() <= FEW
    dealt = _with(rows, plan, few, ["rest", "bits"]).withColumn("block", _block())
    blocks = dealt.where("rest > 0").groupBy("source", "block").agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"))
    upto = F.sum("t").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    blocks = blocks.withColumn("after", upto).withColumn("before", F.col("after") - F.col("t"))
    last = blocks.where("before <= rest and after > rest").groupBy("source").agg(F.min("block").alias("last"), F.min(F.struct("block", (F.col("rest") - F.col("before")).alias("left")))["left"].alias("left"))
    last = common.stage(last, "last")

    inside = dealt.select("source", "block", "u", "tokens").alias("d").join(last.alias("l"), F.expr("d.source <=> l.source and d.block = l.last")).select("d.source", "u", "tokens", "left")
    # Equal u fall together.
    running = F.sum("tokens").over(Window.partitionBy("source").orderBy("key").rangeBetween(Window.unboundedPreceding, 0))
    cut = inside.withColumn("key", _unsigned(F.col("u"))).withColumn("running", running).where(F.col("running") <= F.col("left")).groupBy("source").agg(F.max("key").alias("cut"))
    whole = plan.alias("p").join(last.alias("l"), F.expr("p.source <=> l.source"), "left").select("p.*", "l.last")
    whole = whole.alias("p").join(cut.alias("c"), F.expr("p.source <=> c.source"), "left").select("p.*", "c.cut")
    return common.stage(whole, "plan"), few


_PLANNED = ["weight", "passes", "rest", "bits", "last", "cut"]


def _copies() -> Column:
    more = F.when(F.col("rest") <= 0, F.lit(0)).when(F.col("last").isNull(), F.lit(1)).when(_block() < F.col("last"), F.lit(1))
    more = more.when((_block() == F.col("last")) & (_unsigned(F.col("u")) <= F.col("cut")), F.lit(1)).otherwise(F.lit(0))
    return (F.col("passes") + more).cast("long")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    budget_tokens: int | None = None,
    target_entropy: float = 0.95,
    max_epochs: float = 4.0,
    seed: int = 17,
    block_tokens: int = 200_000,
) -> DataFrame:
    """One row per input row: id, source, tokens, weight (of the source), copies (how often the row is in the mix).

    ``budget_tokens``: size of the mix, by default that of the input.  ``target_entropy``: a share of the highest entropy
    that so many sources can have.  ``max_epochs`` (0: none) limits how often a source may be repeated and goes before the entropy; a budget beyond so many passes over all tokens is an error.
    A source never gets more than its budget, and less by less than one document at most (rows of one source that repeat id and text
    are taken together or not at all).  Null sources are one source; null and empty texts have 0 tokens and go with
    the rows before them in the order.  A source of 0 tokens is kept once.  An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), tokens_of(F.col(text_col)).alias("tokens"), _order(id_col, text_col, seed).alias("u"))
    rows = common.stage(rows, "mix")
    plan, few = _plan(rows.drop("id"), budget_tokens, target_entropy, max_epochs, block_tokens)
    return _with(rows, plan, few, _PLANNED).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "tokens", "weight", _copies().alias("copies"))


def realise(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    budget_tokens: int | None = None,
    target_entropy: float = 0.95,
    max_epochs: float = 4.0,
    seed: int = 17,
    block_tokens: int = 200_000,
) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as mix() says of it; the columns are those of ``docs``.

    A row's copies follow from its source's plan and its own place in the random order, so rows aren't joined with each other: ids may be null, or stand in several sources.
    """
    of = [F.col(source_col).alias("source"), _order(id_col, text_col, seed).alias("u")]
    plan, few = _plan(common.stage(docs.select(*of, tokens_of(F.col(text_col)).alias("tokens")), "mix"), budget_tokens, target_entropy, max_epochs, block_tokens)
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"), *of)
    times = F.explode(F.array_repeat(F.lit(0), _copies().cast("int"))).alias("time")
    return _with(rows, plan, few, _PLANNED).select("row", times).select("row.*")
