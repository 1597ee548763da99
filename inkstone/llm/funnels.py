"""Ordered funnel counting (operator 11).

Every first-step row of a client starts an attempt. Its next step is the client's earliest row of the next kind later than the
step before, unless that comes too late or an excluded row lies between. Attempts that wait for the same step move together, so a
forward sweep over a client's rows needs one waiting bucket for each step: a deque of (time of the step before, number of
attempts). A row of the awaited kind moves the whole bucket on, an excluded row clears all buckets, and what has waited too
long leaves at the deque's old end.

No client is swept in one piece. Time is cut into blocks of about `ROWS` rows (a client's period of 19 hours, or its half, quarter
and so on where the client has more), each swept by itself, many clients' blocks spread over all tasks. What still waits at the
end of a block is carried: it lands on the first awaited row of the blocks behind it, which one row for each block (`firsts`) tells,
and the block it lands in is swept once more for the carried attempts alone. An attempt that is carried has made one step more,
so there are at most as many rounds as a funnel has steps. Percentiles come from counts of equal durations, narrowed down
eleven bits at a time; no client's durations are sorted in one place. Nothing that grows with the input is broadcast or collected.

Rows without client, kind or time and of kinds that no funnel names are left out; repeated rows count once; rows of equal time are
taken in the order excluded, next steps, first steps, as a step must be later than the one before. An empty table gives none;
extra columns are not looked at. Text of any length is not read here.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

#: Rows that a block holds, if a period has them spread evenly.
ROWS = 1024
#: A period is 2 ** PERIOD microseconds; blocks are halves of halves of it, down to 2 ** LEAST.
PERIOD, LEAST = 36, 16
#: Bits of a duration that one round of the percentile search fixes.
BITS = 11
#: Rows that a worker gathers before it hands them on.
OUT = 20_000


@dataclass(frozen=True)
class Funnel:
    name: str
    steps: tuple[str, ...]
    excluding: tuple[str, ...] = ()


def micros(df: DataFrame, ts: str) -> Column:
    """A timestamp as microseconds; one without a zone is read as it stands, whatever the session's zone."""
    if df.schema[ts].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(F.col(ts).cast("timestamp"))
    gap = f"(`{ts}` - TIMESTAMP_NTZ '1970-01-01 00:00:00')"
    return F.expr(f"extract(DAY FROM {gap}) * 86400000000L + extract(HOUR FROM {gap}) * 3600000000L + extract(MINUTE FROM {gap}) * 60000000L + CAST(extract(SECOND FROM {gap}) * 1000000 AS LONG)").cast("long")


def blocks(clicks: DataFrame, bits: dict[str, int], rows: int) -> DataFrame:
    """client_id, stop (end of the block), at, kinds: a row for each client and time, its kinds as a sum of bits."""
    bit = F.coalesce(*(F.when(F.col("kind") == k, F.lit(b).cast("long")) for k, b in bits.items()))
    own = clicks.select("client_id", micros(clicks, "ts").alias("at"), bit.alias("bit")).where("client_id IS NOT NULL AND at IS NOT NULL AND bit IS NOT NULL")
    own = stored(own.groupBy("client_id", "at").agg(F.bit_or("bit").alias("kinds")).withColumn("period", F.shiftright("at", PERIOD)))
    busy = own.groupBy("client_id", "period").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows)
    halvings = F.least(F.ceil(F.log2(F.col("n") / rows)), F.lit(PERIOD - LEAST))
    busy = busy.select("client_id", "period", F.expr(f"CAST(power(2, {PERIOD}) AS LONG)").alias("whole"), halvings.cast("int").alias("halvings"))
    width = F.coalesce(F.expr("shiftright(whole, halvings)"), F.lit(1 << PERIOD))
    cut = own.join(busy.hint("merge"), ["client_id", "period"], "left").select("client_id", ((F.floor(F.col("at") / width) + 1) * width).cast("long").alias("stop"), "at", "kinds")
    out = stored(cut)
    discard(own)
    return out


SWEPT = "funnel int, step int, value long, n long, stop long"


def sweep(events: DataFrame, funnels: Sequence[Funnel], bits: dict[str, int], within: int, fresh: bool) -> DataFrame:
    """client_id, funnel, step, value, n, stop out of events (client_id, stop, at, kinds, funnel, step, n): a block's rows, and the
    attempts that were carried into it, which have a funnel.

    A row without stop says that n attempts reached a step, after `value` microseconds; one with stop, that n of them wait at that
    block's end, value being the time of their last step. fresh: first-step rows start attempts."""
    rules = [(bits[f.steps[0]] if fresh else 0, sum(bits[k] for k in set(f.excluding)), [bits[k] for k in f.steps[1:]]) for f in funnels]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, out, tally = None, [], {}
        waiting: list[list[deque]] = [[] for _ in rules]

        def end() -> None:
            client, stop = block
            out.extend((client, f, step, value, n, None) for (f, step, value), n in tally.items())
            for f, buckets in enumerate(waiting):
                for step, bucket in enumerate(buckets, 1):
                    out.extend((client, f, step, prev, n, stop) for prev, n in bucket if prev >= stop - within)

        def hand_on() -> pd.DataFrame:
            df = pd.DataFrame(out, columns=["client_id", "funnel", "step", "value", "n", "stop"])
            out.clear()
            return df.astype({"value": "Int64", "stop": "Int64"})

        for pdf in batches:
            for client, stop, at, kinds, funnel, step, n in zip(*(pdf[c].tolist() for c in ("client_id", "stop", "at", "kinds", "funnel", "step", "n")), strict=True):
                if block != (client, stop):
                    if block is not None:
                        end()
                    block, tally = (client, stop), {}
                    waiting = [[deque() for _ in nexts] for _, _, nexts in rules]
                    if len(out) >= OUT:
                        yield hand_on()
                if funnel >= 0:
                    waiting[funnel][step - 1].append((at, n))
                    continue
                for f, (first, excluded, nexts) in enumerate(rules):
                    buckets = waiting[f]
                    if kinds & excluded:
                        for bucket in buckets:
                            bucket.clear()
                    # from the last step down, so that nothing moves twice at one time
                    for k in range(len(nexts) - 1, -1, -1):
                        bucket = buckets[k]
                        if not bucket:
                            continue
                        while bucket and at - bucket[0][0] > within:
                            bucket.popleft()
                        if bucket and kinds & nexts[k]:
                            moved = 0
                            for prev, m in bucket:
                                key = (f, k + 2, at - prev)
                                tally[key] = tally.get(key, 0) + m
                                moved += m
                            bucket.clear()
                            if k + 1 < len(nexts):
                                buckets[k + 1].append((at, moved))
                    if kinds & first:
                        tally[f, 1, None] = tally.get((f, 1, None), 0) + 1
                        if nexts:
                            buckets[0].append((at, 1))
        if block is not None:
            end()
        yield hand_on()

    dealt = events.repartition("client_id", "stop").sortWithinPartitions("client_id", "stop", "at", "funnel", "step")
    return dealt.mapInPandas(run, f"client_id {events.schema['client_id'].dataType.simpleString()}, {SWEPT}")


def firsts(rows: DataFrame, bits: dict[str, int]) -> DataFrame:
    """client_id, since (its first row), and for each kind bit_N: the time of a block's first such row and the block's stop; one row a block."""
    first = lambda b: F.min(F.when(F.col("kinds").bitwiseAND(b) != 0, F.struct("at", "stop"))).alias(f"bit_{b}")
    return rows.groupBy("client_id", "stop").agg(F.min("at").alias("since"), *(first(b) for b in bits.values())).drop("stop")


def land(waiting: DataFrame, heads: DataFrame, funnels: Sequence[Funnel], bits: dict[str, int], within: int) -> DataFrame:
    """client_id, funnel, step, at, value, n, stop: where attempts that wait at the end of a block reach their next step, and the block's stop.

    The first row of a kind behind a block is the least of the firsts of the blocks behind it. Only those less than `within` behind
    matter, so they are sought in the stretch of `within` that holds the block's end and in the next one, over one row a block."""
    slot = lambda c: F.floor(F.col(c) / within)
    ends = waiting.select("client_id", F.col("stop").alias("since")).distinct().withColumn("slot", slot("since"))
    near = heads.withColumn("slot", F.explode(F.array(slot("since") - 1, slot("since")))).join(ends.select("client_id", "slot").distinct().hint("merge"), ["client_id", "slot"], "left_semi")
    both = near.withColumn("end", F.lit(0)).unionByName(ends.withColumn("end", F.lit(1)), allowMissingColumns=True)
    behind = Window.partitionBy("client_id", "slot").orderBy(F.desc("since"), "end").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.select("client_id", F.col("since").alias("stop"), "end", *(F.min(f"bit_{b}").over(behind).alias(f"bit_{b}") for b in bits.values())).where("end = 1").drop("end")
    awaited = [F.when((F.col("funnel") == f) & (F.col("step") == k), F.col(f"bit_{bits[kind]}")) for f, x in enumerate(funnels) for k, kind in enumerate(x.steps[1:], 1)]
    barred = [F.when(F.col("funnel") == f, reduce(F.least, [F.col(f"bit_{bits[k]}.at") for k in x.excluding]) if len(x.excluding) > 1 else F.col(f"bit_{bits[x.excluding[0]]}.at")) for f, x in enumerate(funnels) if x.excluding]
    met = waiting.join(seen.hint("merge"), ["client_id", "stop"]).select("client_id", "funnel", "step", "value", "n", F.coalesce(*awaited).alias("next"), F.coalesce(*barred, F.lit(None).cast("long")).alias("bar"))
    met = met.where(F.col("next").isNotNull() & (F.col("next.at") - F.col("value") <= within) & (F.col("bar").isNull() | (F.col("bar") > F.col("next.at"))))
    return met.select("client_id", "funnel", (F.col("step") + 1).alias("step"), F.col("next.at").alias("at"), (F.col("next.at") - F.col("value")).alias("value"), "n", F.col("next.stop").alias("stop"))


def reached(clicks: DataFrame, funnels: Sequence[Funnel], within: int, rows: int = ROWS) -> DataFrame:
    """client_id, funnel (its place in the list), step, value, n: how many attempts reached a step, by the microseconds it took them."""
    bits = {k: 1 << i for i, k in enumerate(sorted({k for f in funnels for k in (*f.steps, *f.excluding)}))}
    deepest = max(len(f.steps) for f in funnels)
    cut = blocks(clicks, bits, rows)
    plain = lambda df: df.select("*", F.lit(-1).alias("funnel"), F.lit(0).alias("step"), F.lit(0).cast("long").alias("n"))
    swept = [stored(sweep(plain(cut), funnels, bits, within, True))]
    heads = stored(firsts(cut, bits)) if deepest > 1 else None
    tallies = [swept[0].where("stop IS NULL").drop("stop")]
    landed: list[DataFrame] = []
    for made in range(2, deepest + 1):
        waiting = swept[-1].where("stop IS NOT NULL")
        if waiting.isEmpty():
            break
        landed.append(stored(land(waiting, heads, funnels, bits, within)))
        tallies.append(landed[-1].select("client_id", "funnel", "step", "value", "n"))
        onward = landed[-1].where(F.coalesce(*(F.when(F.col("funnel") == f, F.col("step") < len(x.steps)) for f, x in enumerate(funnels))))
        if made == deepest:
            break
        onward = onward.groupBy("client_id", "stop", "at", "funnel", "step").agg(F.sum("n").alias("n")).withColumn("kinds", F.lit(0).cast("long"))
        # of a block's rows those that the attempts carried into it can meet
        left = F.coalesce(*(F.when(F.col("funnel") == f, len(x.steps) - F.col("step")) for f, x in enumerate(funnels)))
        reach = onward.groupBy("client_id", "stop").agg(F.min("at").alias("since"), F.max(F.col("at") + left.cast("long") * within).alias("until"))
        again = cut.join(reach.hint("merge"), ["client_id", "stop"]).where("at > since AND at <= until").select(*cut.columns)
        swept.append(stored(sweep(plain(again).unionByName(onward), funnels, bits, within, False)))
        tallies.append(swept[-1].where("stop IS NULL").drop("stop"))
    out = stored(reduce(DataFrame.unionByName, tallies).groupBy("client_id", "funnel", "step", "value").agg(F.sum("n").alias("n")))
    discard(cut, heads, *swept, *landed)
    return out


def percentile(tallies: DataFrame, keys: list[str], percent: int, most: int) -> DataFrame:
    """keys and value: the ceil(percent * n / 100)-th smallest of the n values (value, n: so many of them), at most `most` each.

    Each round counts the values of a key by their next BITS bits, at most 2 ** BITS rows a key, and keeps those in the
    part where the sought one lies."""
    live, part, sought = tallies.where("value IS NOT NULL"), None, None
    for shift in range((most.bit_length() - 1) // BITS * BITS, -1, -BITS):
        if part is not None:
            live = live.withColumn("part", F.shiftright("value", shift + BITS)).join(part.hint("merge"), [*keys, "part"]).drop("part")
        rank = [] if part is None else ["rank"]
        counts = live.groupBy(*keys, *rank, F.shiftright("value", shift).alias("part")).agg(F.sum("n").alias("n"))
        key = Window.partitionBy(*keys)
        upto = F.sum("n").over(key.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
        sought = F.col("rank") if rank else F.floor((percent * F.sum("n").over(key) + 99) / 100)
        counts = counts.select(*keys, "part", "n", upto.alias("upto"), sought.cast("long").alias("sought"))
        part = counts.where("upto >= sought AND upto - n < sought").select(*keys, "part", (F.col("sought") - F.col("upto") + F.col("n")).alias("rank"))
        live = live.drop("rank")
    return part.select(*keys, F.col("part").alias("value"))


def count(clicks: DataFrame, funnels: Sequence[Funnel], minutes: int = 60, percent: int = 90, rows: int = ROWS) -> DataFrame:
    """funnel, client_id, n1 to nK (attempts that reached each step), deepest, t2 to tK (the percentile of the microseconds from the
    step before), same_depth (clients of equal funnel and deepest step), for clients with attempts; K is the longest funnel's length.

    clicks: client_id, kind, ts. Steps beyond a shorter funnel's end have no attempts and no time."""
    within, longest = minutes * 60_000_000, max(len(f.steps) for f in funnels)
    tallies = reached(clicks, funnels, within, rows)
    keys = ["client_id", "funnel", "step"]
    numbers = tallies.groupBy(*keys).agg(F.sum("n").alias("n"))
    both = numbers.withColumn("value", F.lit(None).cast("long")).unionByName(percentile(tallies, keys, percent, within).withColumn("n", F.lit(0).cast("long")))
    of = lambda k, c: F.when(F.col("step") == k, F.col(c))
    wide = both.groupBy("client_id", "funnel").agg(
        *(F.coalesce(F.sum(of(k, "n")), F.lit(0)).cast("long").alias(f"n{k}") for k in range(1, longest + 1)),
        F.max("step").cast("int").alias("deepest"),
        *(F.max(of(k, "value")).alias(f"t{k}") for k in range(2, longest + 1)),
    )
    wide = stored(wide)
    discard(tallies)
    # a row for each funnel and step at most
    depths = wide.groupBy("funnel", "deepest").agg(F.count(F.lit(1)).alias("same_depth"))
    name = F.coalesce(*(F.when(F.col("funnel") == f, F.lit(x.name)) for f, x in enumerate(funnels)))
    out = wide.join(F.broadcast(depths), ["funnel", "deepest"])
    return out.select(name.alias("funnel"), "client_id", *(f"n{k}" for k in range(1, longest + 1)), "deepest", *(f"t{k}" for k in range(2, longest + 1)), "same_depth")


def oracle(funnels: Sequence[Funnel], minutes: int = 60, percent: int = 90) -> str:
    """DuckDB SQL for count() over the view clicks; all funnels have four steps."""
    parts, within = [], minutes * 60_000_000
    lit: Callable[[str], str] = lambda x: "'" + x.replace("'", "''") + "'"
    for f in funnels:
        bar = ", ".join(map(lit, f.excluding))
        for k in range(1, len(f.steps) + 1):
            if k == 1:
                parts.append(f"{f.name}1 AS (SELECT client_id, ts, NULL::BIGINT AS took FROM x WHERE kind = {lit(f.steps[0])})")
                continue
            nexts = f"SELECT p.client_id, p.ts AS prev, s.ts FROM {f.name}{k - 1} p ASOF JOIN (SELECT * FROM x WHERE kind = {lit(f.steps[k - 1])}) s ON p.client_id = s.client_id AND p.ts < s.ts"
            barred = f"SELECT n.*, b.ts AS bar FROM ({nexts}) n ASOF LEFT JOIN (SELECT DISTINCT client_id, ts FROM x WHERE kind IN ({bar})) b ON n.client_id = b.client_id AND n.prev < b.ts"
            parts.append(f"{f.name}{k} AS (SELECT client_id, ts, ts - prev AS took FROM ({barred}) WHERE ts - prev <= {within} AND (bar IS NULL OR bar > ts))")
    steps = " UNION ALL ".join(f"SELECT {lit(f.name)} AS funnel, {k} AS step, client_id, took FROM {f.name}{k}" for f in funnels for k in range(1, len(f.steps) + 1))
    ranked = "SELECT *, row_number() OVER (PARTITION BY funnel, client_id, step ORDER BY took) AS r, count(*) OVER (PARTITION BY funnel, client_id, step) AS n FROM e"
    wide = "SELECT funnel, client_id, " + ", ".join(f"count(*) FILTER (step = {k}) AS n{k}" for k in (1, 2, 3, 4)) + ", max(step)::INT AS deepest, " + ", ".join(f"max(took) FILTER (step = {k} AND r = ({percent} * n + 99) // 100) AS t{k}" for k in (2, 3, 4)) + " FROM q GROUP BY 1, 2"
    return f"WITH x AS (SELECT DISTINCT client_id, kind, epoch_us(ts) AS ts FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND ts IS NOT NULL), {', '.join(parts)}, e AS ({steps}), q AS ({ranked}), w AS ({wide}) SELECT *, count(*) OVER (PARTITION BY funnel, deepest) AS same_depth FROM w"
