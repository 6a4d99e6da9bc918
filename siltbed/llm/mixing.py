"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length for each source. A source's budget is first dealt to its lengths in proportion,
whole documents only; what remains is fitted by a bounded-knapsack dynamic programme over the counts that are left. The
result is a quota for each (source, length), and a seeded hash chooses which documents fill it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltbed.llm.shared import free_name, word_count

#: Documents of one (source, length) that are ranked in one task, about.
RANKED = 20_000
#: States of the dynamic programme, unless documents are so long that they need more.
STATES = 1 << 17


def water_fill(sizes: Sequence[int], weights: Sequence[float], budget: float, most: float) -> list[float]:
    """Shares of ``budget`` by weight, none above ``most`` times its size; the excess is shared again by weight."""
    share = [0.0] * len(sizes)
    free = {i for i, s in enumerate(sizes) if s > 0}
    left = min(budget, most * sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        above = {i for i in free if left * weights[i] / total >= most * sizes[i]}
        if not above:
            for i in free:
                share[i] = left * weights[i] / total
            break
        for i in above:
            share[i] = float(most * sizes[i])
            left -= share[i]
        free -= above
    return share


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of ``counts`` documents of each length to take, for a sum as near below ``budget`` as can be found.

    Each length gets its proportional part; then whole documents from the longest on until less than half of the states
    remains; the rest is a bounded knapsack whose state is the sum reached, by binary splitting of the counts. Where
    documents are long, the states follow the longest one, and eight times its length is held back from the
    proportional parts, so that a few of them are searched exactly and what remains always fits the states.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    longest = int(lengths.max())
    long = longest > STATES // 4
    states = 32 * longest if long else STATES
    shared_out = max(0, budget - 8 * longest if long else budget)
    take = np.floor(counts * (shared_out / total)).astype(np.int64)
    left = budget - int((lengths * take).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if left < states // 2 or left < lengths[i]:
            continue
        more = min(int(counts[i] - take[i]), (left - states // 4) // max(1, int(lengths[i])))
        if more > 0:
            take[i] += more
            left -= more * int(lengths[i])
    if left <= 0:
        return take
    made_by = np.full(left + 1, -1, np.int32)  # the item at which a sum was first reached
    reached = np.zeros(left + 1, bool)
    reached[0] = True
    items: list[tuple[int, int]] = []
    for i in range(len(lengths)):
        have, part = int(counts[i] - take[i]), 1
        while have > 0 and not reached[left]:
            n = min(part, have)
            weight = n * int(lengths[i])
            if weight > left or weight <= 0:
                break
            new = np.zeros_like(reached)
            new[weight:] = reached[:-weight]
            new &= ~reached
            made_by[new] = len(items)
            reached |= new
            items.append((i, n))
            have, part = have - n, part * 2
    at = int(np.flatnonzero(reached)[-1])
    while at > 0:
        i, n = items[made_by[at]]
        take[i] += n
        at -= n * int(lengths[i])
    return take


def nearest(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """The nearer of a sum from below and one from above, which leaves out what fits the rest."""
    below = fit(lengths, counts, budget)
    above = counts - fit(lengths, counts, int((lengths * counts).sum()) - budget)
    return below if budget - int((lengths * below).sum()) <= int((lengths * above).sum()) - budget else above


def _quotas(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one source, sorted by length: copies that every document gets, and how many documents get one more."""
    pdf = pdf.sort_values("size").reset_index(drop=True)
    total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    base = int(target // total) if total else 0
    pdf["base"] = base
    sizes, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    extra = np.zeros(len(pdf), np.int64)
    some = sizes > 0
    if total and some.any():
        extra[some] = nearest(sizes[some], counts[some], round(target - base * total))
    pdf["extra"] = extra
    return pdf[["source", "size", "n", "source_size", "target", "base", "extra"]]


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    size_col: str | None = None,
    weights: Sequence[float] = (3, 1, 2),
    budget_ratio: float = 1.5,
    most_copies: int = 2,
    seed: int = 20_240_501,
) -> DataFrame:
    """Adds mix_size, mix_source_size, mix_target and mix_copies (0 to ``most_copies``) to every row of ``docs``.

    Sources in order of code point, null last, get ``weights`` in turn; together they get ``budget_ratio`` of all
    words, none more than ``most_copies`` times its own. A source with its target above its size has every document,
    and again as many as the rest needs. ``size_col`` names a column that holds the sizes already.

    Null and empty texts have size 0 and get no words (their copies equal those of their source's whole rounds). Null
    sources are a source of their own. Rows that are repeated are documents of their own; equal rows are
    interchangeable. An empty table stays empty. Columns of the input stay as they are; columns of the names above are
    replaced. The table of sources, one row for each, goes through the driver, as shares of one depend on all others.
    """
    spark = docs.sparkSession
    size = F.col(size_col).cast("long") if size_col else word_count(text_col)
    source, hash_, base, extra, n, groups, group, before = (free_name(docs, f"_mix_{x}") for x in ("source", "hash", "base", "extra", "n", "groups", "group", "before"))
    made = ("mix_size", "mix_source_size", "mix_target", "mix_copies")
    own = [c for c in docs.columns if c not in made]
    sized = docs.withColumns({source: F.col(source_col).cast("string"), hash_: F.xxhash64(F.col(id_col), F.lit(seed)), "mix_size": F.coalesce(size, F.lit(0))})
    hist = sized.groupBy(F.col(source).alias("source"), F.col("mix_size").alias("size")).agg(F.count("*").alias("n"))
    totals = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total")).toArrow().to_pylist()
    totals = sorted(totals, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    sizes = [int(r["total"]) for r in totals]
    shares = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], budget_ratio * sum(sizes), most_copies)
    targets = spark.createDataFrame(
        [(r["source"], s, float(t)) for r, s, t in zip(totals, sizes, shares, strict=True)], "_s string, source_size long, target double"
    )
    quotas = (
        hist.join(targets, F.col("source").eqNullSafe(F.col("_s")))
        .groupBy("source")
        .applyInPandas(_quotas, "source string, size long, n long, source_size long, target double, base long, extra long")
    )
    joined = sized.alias("d").join(quotas.alias("q"), F.col(f"d.{source}").eqNullSafe(F.col("q.source")) & (F.col("d.mix_size") == F.col("q.size")))
    fields = {"mix_source_size": F.col("q.source_size"), "mix_target": F.col("q.target"), base: F.col("q.base"), extra: F.col("q.extra"), groups: F.greatest(F.lit(1), F.ceil(F.col("q.n") / RANKED))}
    ranked = joined.select(*(F.col(f"d.`{c}`") for c in (*own, source, hash_, "mix_size")), *(v.alias(k) for k, v in fields.items()))
    # a part of the hash's range for each RANKED documents, so that no length of a source is ranked in one task
    unit = (F.shiftrightunsigned(F.col(hash_), 33) / F.lit(float(1 << 31))).cast("double")
    ranked = ranked.withColumn(group, F.floor(unit * F.col(groups)))
    parts = ranked.groupBy(source, "mix_size", group).agg(F.count("*").alias(n))
    ahead = Window.partitionBy(source, "mix_size").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn(before, F.coalesce(F.sum(n).over(ahead), F.lit(0))).alias("p")
    on = F.col(f"r.{source}").eqNullSafe(F.col(f"p.{source}")) & (F.col("r.mix_size") == F.col("p.mix_size")) & (F.col(f"r.{group}") == F.col(f"p.{group}"))
    ranked = ranked.alias("r").join(parts, on).select("r.*", f"p.{before}")
    rank = F.row_number().over(Window.partitionBy(source, "mix_size", group).orderBy(hash_, F.col(id_col)))
    copies = F.col(base) + F.when(rank + F.col(before) <= F.col(extra), 1).otherwise(0)
    return ranked.withColumn("mix_copies", copies.cast("long")).select(*own, *made)
