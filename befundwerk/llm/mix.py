"""A mix of sources at target shares of tokens, no record used more often than allowed."""

from __future__ import annotations

import math
import random
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from befundwerk.llm.tokens import TOKENIZERS, count_tokens, read_limits
from befundwerk.operators.skew import rank_within
from befundwerk.session import cut_lineage

#: What the proportional step leaves to the exact fitting, in lengths of the source's longest record.
HELD_BACK = 8
#: Largest budget that is fitted as one set of sums, in bits (16 MB); of a larger one records are taken in seeded order first.
FIT_BITS = 1 << 27


def fit(budget: int, left: dict[int, int], seed: int) -> dict[int, int]:
    """How many more records of each length to take so that their sum is as near below ``budget`` as possible.

    Bounded knapsack over all lengths: sums are the bits of one integer in units of the lengths' greatest
    common divisor, counts are split in powers of two, lengths go in seeded order, and the first
    exact sum ends it.
    """
    rng = random.Random(seed)
    lengths = sorted(n for n in left if n > 0 and left[n] > 0)
    unit = math.gcd(*lengths) if lengths else 1
    rng.shuffle(lengths)
    taken: dict[int, int] = {}
    for n in lengths:
        if budget <= FIT_BITS * unit:
            break
        k = min(left[n], (budget - FIT_BITS * unit // 2) // n)
        if k > 0:
            taken[n] = k
            budget -= k * n
    goal = budget // unit
    full = (1 << (goal + 1)) - 1
    reach, steps = 1, []
    for n in lengths:
        if reach >> goal & 1:
            break
        k, size = min(left[n] - taken.get(n, 0), budget // n), 1
        while k > 0:
            size = min(size, k)
            more = reach | (reach << (n // unit * size)) & full
            if more != reach:
                steps.append((n, size, reach))
                reach = more
            k -= size
            size *= 2
    at = reach.bit_length() - 1
    for n, size, before in reversed(steps):
        if not before >> at & 1:
            at -= n // unit * size
            taken[n] = taken.get(n, 0) + size
    return taken


def feasible_total(have: Mapping[str, int], goal: Mapping[str, tuple[float, int]]) -> int:
    """The largest total at which every source that has records can fill its share with at most its uses of each."""
    return min((int(have[s] * cap / share) for s, (share, cap) in goal.items() if share > 0 and have.get(s)), default=0)


def mix_sources(docs: DataFrame, targets: DataFrame, total: int | str | None = None, seed: int = 20, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """(records with their number of uses, shares reached per target).

    ``docs`` has doc_id, source and text, ``targets`` source, ziel_anteil and max_wiederholung. Each
    source may fill its share of ``total`` tokens (all tokens of the corpus unless given; with
    ``"feasible"`` the largest total at which every source that has records fills its share). If its
    records don't reach that at most uses, all are used that often and the share stays unmet; what
    it lacks isn't given to others. Else all are used as often as fits, and of the rest of the
    budget each exact length gets its part, the lengths' remainders running on from the longest to
    the shortest; the last tokens, HELD_BACK times the longest record, are fitted by ``fit`` over all lengths.
    The driver gets the number of records per source and length, which follows the lengths, not the records. Which records of a length are taken follows
    a seeded hash, so it doesn't depend on order or partitions.

    Records without tokens or source, and of sources without target, are never used. A target with a
    null share counts as 0, with a null cap as one use. Ties in the hash fall to the lower doc_id.
    """
    spark = docs.sparkSession
    sized = cut_lineage(count_tokens(docs.select("doc_id", "source", "text"), "text", tokenizer=tokenizer, folder=folder))
    used = sized.filter((F.col("n_tokens") > 0) & F.col("source").isNotNull())
    hist = cut_lineage(used.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")))
    goal = {r["source"]: (r["ziel_anteil"] or 0.0, r["max_wiederholung"] if r["max_wiederholung"] is not None else 1) for r in read_limits(spark, targets) if r["source"] is not None}
    sums = hist.filter(F.col("source").isin(*goal)).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n")).alias("t"), F.max("n_tokens").alias("m")).collect() if goal else []
    have, longest = ({r["source"]: r[c] for r in sums} for c in ("t", "m"))
    if total == "feasible":
        total = feasible_total(have, goal)
    elif total is None:
        total = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    plan = []
    for source, (share, cap) in goal.items():
        budget, tokens = round(share * total), have.get(source, 0)
        if not tokens:
            continue
        rounds = min(budget // tokens, cap)
        plan.append((source, rounds, budget - rounds * tokens if rounds < cap else 0, tokens, HELD_BACK * longest[source]))
    plan_df = F.broadcast(spark.createDataFrame(plan, "source string, runden long, rest long, vorrat long, offen long"))
    wide = "decimal(38,0)"
    below = Window.partitionBy("source").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = hist.join(plan_df, "source").withColumn("bis", F.sum("n").over(below))
    bulk = F.greatest(F.col("rest") - F.col("offen"), F.lit(0))  # what is left is for fit, so that it has records to choose from
    part = lambda c: F.floor(c.cast(wide) * bulk / F.col("vorrat"))
    h = h.withColumn("mehr", (part(F.col("bis")) - part(F.col("bis") - F.col("n"))).cast("long"))
    h = h.withColumn("mehr", F.least("mehr", "n"))
    base = {r["source"]: r["t"] for r in h.groupBy("source").agg(F.sum(F.col("mehr") * F.col("n_tokens")).alias("t")).collect()}
    short: dict[str, dict[int, int]] = {}
    for r in h.filter((F.col("n") > F.col("mehr")) & (F.col("rest") > 0)).select("source", "n_tokens", (F.col("n") - F.col("mehr")).alias("n")).collect():
        short.setdefault(r["source"], {})[r["n_tokens"]] = r["n"]
    extra = [(s, n, k) for s, _, rest, *_ in plan if rest > 0 for n, k in fit(max(0, rest - base.get(s, 0)), short.get(s, {}), seed).items()]
    extra_df = F.broadcast(spark.createDataFrame(extra, "source string, n_tokens long, dazu long"))
    takes = h.join(extra_df, ["source", "n_tokens"], "left").select("source", "n_tokens", "runden", (F.col("mehr") + F.coalesce("dazu", F.lit(0))).alias("mehr"))
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    keyed = used.withColumn("_h", order)
    ranked = rank_within(keyed, ["source", "n_tokens"], F.shiftright("_h", 54), [F.col("_h"), F.col("doc_id")], "_rang")
    uses = (F.col("runden") + F.when(F.col("_rang") <= F.col("mehr"), 1).otherwise(0)).cast("int")
    mix = ranked.join(takes, ["source", "n_tokens"]).select("doc_id", "source", "n_tokens", uses.alias("verwendet")).filter("verwendet > 0")
    reached = mix.groupBy("source").agg(F.count(F.lit(1)).alias("dokumente"), F.sum(F.col("n_tokens") * F.col("verwendet")).alias("tokens"), F.max("verwendet").alias("meist"))
    goals = spark.createDataFrame([(s, a, m, round(a * total)) for s, (a, m) in goal.items()], "source string, ziel_anteil double, max_wiederholung int, ziel_tokens long")
    j = goals.join(reached, "source", "left")
    of_all = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy(F.lit(0)))  # one row per target
    zero = lambda c, t: F.coalesce(F.col(c), F.lit(0)).cast(t).alias(c)
    shares = j.select("source", "ziel_anteil", "max_wiederholung", "ziel_tokens", zero("dokumente", "long"), zero("tokens", "long"), zero("meist", "int"), F.when(of_all > 0, F.coalesce("tokens", F.lit(0)) / of_all).alias("anteil"), (F.coalesce("tokens", F.lit(0)) / F.lit(total or None)).alias("anteil_gesamt"), F.lit(total).cast("long").alias("gesamt"))
    return mix, shares
