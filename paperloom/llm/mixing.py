"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed by cell (source, language, topic). Raking scales the
cells to the target share of each source, language and topic in turn until
all three hold; a document is then sampled with the probability that its
cell's weight asks for. The cells are a table of category combinations, so
raking runs on one partition while documents are only read to count and to sample.

Probabilities are min(1, c * weight), with one c for all cells such that the
tokens expected are the budget. No text is taken twice, so a cell that reaches
1 stays there and the others share what it leaves; the scale hangs on the
whole mix and not on the rarest category.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.llm.store import save

MARGINS = ("source", "lang", "topic")
ROUNDS, PLANS, CLOSE = 4, 10, 1e-6


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def layout_topic(text: Column, tokens: Column) -> Column:
    """What stands in for a topic where a table has no such column: the text's layout."""
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return F.when(tokens < 50, "brief").when(lines * 8 > tokens, "list").when(tokens > 2000, "long").otherwise("prose")


def _placed(docs: DataFrame, topic: Column | None, text: str, doc_id: str, seed: int) -> DataFrame:
    """The rows of docs as structs named row, with the columns _source, _lang, _topic, _tokens and _chance."""
    body = F.coalesce(F.col(text), F.lit(""))
    named = {f"_{c}": F.coalesce(F.col(c).cast("string"), F.lit("(none)")) if c in docs.columns else F.lit("(none)") for c in ("source", "lang")}
    own = F.when(F.col(doc_id).isNull(), F.xxhash64(body)).otherwise(F.xxhash64(doc_id, F.lit(seed)))
    named |= {"_tokens": n_words(body), "_chance": F.shiftrightunsigned(own, 11) / F.lit(float(1 << 53))}
    given = {} if topic is None else {"_topic": F.coalesce(topic.cast("string"), F.lit("(none)"))}
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in (named | given).items()])
    return rows if given else rows.withColumn("_topic", layout_topic(F.coalesce(F.col("row").getField(text), F.lit("")), F.col("_tokens")))


def _rates(counts: DataFrame, targets: dict[str, dict[str, float]] | None, temper: dict[str, float] | None, rate: float, budget: float | None, tolerance: float | None = None) -> DataFrame:
    """(_source, _lang, _topic, weight, probability) for each cell of counts with words."""
    temper = {"source": 0.7} if temper is None else temper
    keys = [f"_{m}" for m in MARGINS]
    cells = counts.groupBy(*keys).agg(F.sum("_tokens").alias("tokens")).where("tokens > 0").coalesce(1)
    cells = save(cells, "tokens")
    start = cells.coalesce(1)
    for m, k in zip(MARGINS, keys):
        seen = cells.groupBy(k).agg(F.sum("tokens").alias("observed"))
        given = (targets or {}).get(m)
        if given:
            fixed = F.coalesce(*[F.when(F.col(k) == c, F.lit(float(v))) for c, v in given.items()])
            spare = max(0.0, 1.0 - sum(given.values()))
            free = F.when(fixed.isNull(), F.col("observed"))
            want = F.coalesce(fixed, F.lit(spare) * free / F.sum(free).over(W.partitionBy()))
        else:
            want = F.pow("observed", F.lit(float(temper.get(m, 1.0))))
        seen = seen.coalesce(1).withColumn("want", want)
        share = save(seen.select(k, (F.col("want") / F.sum("want").over(W.partitionBy())).alias(f"want_{m}")), "shares")
        start = start.join(share, k)
    now = save(start.coalesce(1).withColumn("w", F.col("tokens") / F.sum("tokens").over(W.partitionBy())), "cells")
    for _ in range(PLANS):
        next_ = now.coalesce(1)
        for _ in range(ROUNDS):
            for m, k in zip(MARGINS, keys):
                next_ = next_.withColumn("w", F.col("w") * F.col(f"want_{m}") / F.sum("w").over(W.partitionBy(k)))
        now = save(next_, "cells")
        sums = now.coalesce(1)
        for m, k in zip(MARGINS, keys):
            sums = sums.withColumn(f"s_{m}", F.sum("w").over(W.partitionBy(k)))
        off = F.greatest(*[F.abs(F.col(f"s_{m}") / F.col(f"want_{m}") - 1) for m in MARGINS])
        left = sums.agg(F.max(off)).first()[0] or 0.0
        if left < CLOSE:
            break
    if left >= CLOSE:
        said = f"after {PLANS * ROUNDS} rounds a share is still {left:.2g} of itself off its target: the cells can't meet all targets together"
        if tolerance is not None and left > tolerance:
            raise ValueError(said)
        logging.getLogger(__name__).warning(said)
    every = W.partitionBy()
    rated = now.coalesce(1).withColumn("weight", F.col("w") / (F.col("tokens") / F.sum("tokens").over(every)))
    common = F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("weight"))).over(every) if budget is None else F.lit(float(budget))
    heavier = W.orderBy(F.desc("weight"), *keys)
    full = F.coalesce(F.sum("tokens").over(heavier.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("tokens") * F.col("weight")).over(heavier.rowsBetween(W.currentRow, W.unboundedFollowing))
    # the scale if just the heavier cells are full; of those under which this cell isn't, the largest spends the budget
    rated = rated.withColumn("scale", F.try_divide(F.lit(float(rate)) * common - full, rest))
    scale = F.max(F.when(F.col("scale") * F.col("weight") <= 1, F.col("scale"))).over(every)
    rated = rated.withColumn("probability", F.when(F.col("weight") > 0, F.coalesce(F.least(F.lit(1.0), scale * F.col("weight")), F.lit(1.0))).otherwise(0.0))
    return save(rated.select(*keys, F.col("weight").alias("_weight"), F.col("probability").alias("_probability")), "rates")


def mix(docs: DataFrame, topic: Column | None = None, targets: dict[str, dict[str, float]] | None = None, temper: dict[str, float] | None = None, rate: float = 1.0, seed: int = 17, text: str = "text", doc_id: str = "doc_id", budget: float | None = None, tolerance: float | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, weight, probability, sampled) for every row of docs.

    targets gives shares by margin and category; categories it doesn't name
    share what it leaves by their tokens. A margin without targets gets its
    observed shares to the power temper (1 leaves them; source is tempered to 0.7 otherwise).
    weight is the wanted over the observed share of the cell; probability is
    min(1, c * weight), c such that rate times budget tokens are expected. The
    budget is a number of tokens; without one it is what the observed and the
    wanted mix have in common, the sum of tokens * min(1, weight). Cells at 1
    fall short of their wanted share; reached() tells by how much. sampled compares
    probability with a hash of doc_id, or of the text where doc_id is null, so a row
    always falls the same way. Null categories are '(none)'; documents without
    words weigh nothing in the fit and get their cell's probability, or the
    rate and no weight in a cell without any. Rows that share a doc_id fall
    together; an empty table gives an empty one. Where raking doesn't reach
    its targets it warns, or with a tolerance raises ValueError if a share stays
    off by more (in parts of its target).
    """
    placed = _placed(docs, topic, text, doc_id, seed)
    rows = save(placed.select(F.col("row").getField(doc_id).alias("doc_id"), "_source", "_lang", "_topic", "_tokens", "_chance"), "counted")
    out = rows.join(_rates(rows, targets, temper, rate, budget, tolerance), ["_source", "_lang", "_topic"], "left")
    probability = F.coalesce("_probability", F.lit(min(1.0, float(rate))))
    return out.select("doc_id", *[F.col(f"_{m}").alias(m) for m in MARGINS], F.col("_tokens").alias("tokens"), F.col("_weight").alias("weight"), probability.alias("probability"), (F.col("_chance") < probability).alias("sampled"))


def reached(mixed: DataFrame) -> DataFrame:
    """(margin, category, observed, wanted, reached) of what mix() gives: shares of tokens in its input, its targets and, as expected, its sample."""
    shares = {"observed": F.col("tokens"), "wanted": F.col("tokens") * F.col("weight"), "reached": F.col("tokens") * F.col("probability")}
    cells = mixed.where("tokens > 0").groupBy(*MARGINS).agg(*[F.sum(v).alias(k) for k, v in shares.items()])
    of = F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(m).alias("category")) for m in MARGINS]))
    sums = cells.select(of.alias("of"), *shares).groupBy("of.margin", "of.category").agg(*[F.sum(k).alias(k) for k in shares])
    return sums.select("margin", "category", *[F.try_divide(F.col(k), F.sum(k).over(W.partitionBy("margin"))).alias(k) for k in shares])


def sample(docs: DataFrame, topic: Column | None = None, targets: dict[str, dict[str, float]] | None = None, temper: dict[str, float] | None = None, rate: float = 1.0, seed: int = 17, text: str = "text", doc_id: str = "doc_id", budget: float | None = None, tolerance: float | None = None) -> DataFrame:
    """The rows of docs that mix() samples with the same arguments, with all their columns, whatever their names."""
    placed = _placed(docs, topic, text, doc_id, seed)
    rates = _rates(placed.select("_source", "_lang", "_topic", "_tokens"), targets, temper, rate, budget, tolerance)
    kept = placed.join(rates, ["_source", "_lang", "_topic"], "left").where(F.col("_chance") < F.coalesce("_probability", F.lit(min(1.0, float(rate)))))
    return kept.select("row.*")
