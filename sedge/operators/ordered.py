"""Operators that depend on the order of rows: windows where frames suffice, folds where state does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_n(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def numbered(df: DataFrame, by: list[str], order: list, name: str) -> DataFrame:
    """df with the place of each row in its group, from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def clamped(df: DataFrame, by: list[str], order: list, change: str, name: str) -> DataFrame:
    """df with a running total that stays at 0 where it would fall below: the plain total above its own least value so far."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = df.withColumn("_total", F.sum(change).over(w))
    return total.withColumn(name, F.col("_total") - F.least(F.lit(0), F.min("_total").over(w))).drop("_total")


def inherited(df: DataFrame, by: list[str], order: list, value: str, boundary: Column) -> DataFrame:
    """df whose value is the last one that isn't null since the last boundary, that row included."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = df.withColumn("_part", F.count(F.when(boundary, 1)).over(w))
    own = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn(value, F.last(value, ignorenulls=True).over(own)).drop("_part")


def dropped_until(df: DataFrame, by: list[str], order: list, starts: Column, resets: Column) -> DataFrame:
    """df without the rows from one that starts a gap up to the next that resets it."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    off = F.last(F.when(starts, True).when(resets, False), ignorenulls=True).over(w)
    return df.withColumn("_off", off).where(~F.coalesce("_off", F.lit(False))).drop("_off")


def before_first(df: DataFrame, by: list[str], order: list[str], holds: Column) -> DataFrame:
    """The rows before the first of their group for which holds; all of a group without one. A grouped minimum, no window over whole groups."""
    first = df.where(holds).groupBy(*by).agg(F.min(F.struct(*order)).alias("_first"))
    met = df.join(first, by, "left")
    return met.where(F.col("_first").isNull() | (F.struct(*order) < F.col("_first"))).drop("_first")


def first_wins(df: DataFrame, key: list[str], order: list) -> DataFrame:
    return top_n(df, key, order, 1)


def streaks(df: DataFrame, key: str, day: str) -> DataFrame:
    """(key, start, end, days): runs of consecutive days."""
    days = df.select(key, F.col(day).cast("date").alias("d")).distinct()
    island = F.date_sub("d", F.row_number().over(Window.partitionBy(key).orderBy("d")))
    return days.withColumn("i", island).groupBy(key, "i").agg(F.min("d").alias("start"), F.max("d").alias("end"), F.count("*").alias("days")).drop("i")


def filled_forward(value: Column, key: str, order: str) -> Column:
    """The last value that isn't null, up to this row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def gap_clusters(df: DataFrame, key: str, start: str, end: str, gap: int) -> DataFrame:
    """df with cluster: a new one where a row starts more than gap after all earlier ones end."""
    w = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col(start) - before > gap, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w)).drop("_new")


def runs(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """df with run: the number of the stretch of equal values."""
    w = Window.partitionBy(key).orderBy(order)
    change = F.when(~F.col(value).eqNullSafe(F.lag(value).over(w)) & F.lag(order).over(w).isNotNull(), 1).otherwise(0)
    return df.withColumn("_c", change).withColumn("run", F.sum("_c").over(w)).drop("_c")


def sliding(df: DataFrame, key: str, tokens: str, size: int, stride: int, least: int) -> DataFrame:
    """(key, chunk, start, tokens): windows of a token array, the last one ending with it; short ones but the first are left out."""
    n = F.size(tokens)
    last = F.greatest(F.lit(0), F.ceil((n - size) / stride)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(F.col(tokens), i * stride + 1, size))
    made = df.select(key, F.posexplode(cut).alias("chunk", "tokens")).withColumn("start", F.col("chunk") * stride)
    return made.where((F.col("chunk") == 0) | (F.size("tokens") >= least)).select(key, "chunk", "start", "tokens")


def _starts(values: Column, begins, state: Column, moved) -> Column:
    """The values of a sorted array that begin a new stretch: begins(state, value) tells so, moved(state, value, new) is the next state.

    A fold inside the JVM that keeps only the beginnings; value and state may be structs.
    """

    def step(acc, v):
        new = begins(acc["state"], v)
        return F.struct(moved(acc["state"], v, new).alias("state"), F.when(new, F.array_append(acc["starts"], v)).otherwise(acc["starts"]).alias("starts"))

    zero = F.struct(state.alias("state"), F.slice(values, 1, 0).alias("starts"))
    return F.aggregate(values, zero, step, lambda acc: acc["starts"])


def _opened_after(seconds: int):
    """begins and moved for stretches that last so many seconds from their first event."""
    return lambda last, at: last.isNull() | (F.unix_micros(at) - F.unix_micros(last) >= seconds * 1_000_000), lambda last, at, new: F.when(new, at).otherwise(last)


def accepted(df: DataFrame, key: str, at: str, gap: int) -> DataFrame:
    """(key, at): events at least gap seconds after the last accepted one of their day; at is a timestamp.

    The threshold follows the last accepted event, not the last one, so this is a fold, over each key's events of one day.
    """
    e = df.select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("at"))
    days = e.groupBy("key", F.to_date("at").alias("day")).agg(F.array_sort(F.collect_list("at")).alias("all"))
    begins, moved = _opened_after(gap)
    kept = days.select("key", F.explode(_starts(F.col("all"), begins, F.lit(None).cast("timestamp"), moved)).alias("at"))
    return kept.select("key", F.col("at").cast("timestamp_ntz").alias("at"))


def packed(df: DataFrame, key: str, order: str, size: str, most: int, flush: Column | None = None, most_rows: int = 2**31 - 1) -> DataFrame:
    """df's (key, order, size) with bin: rows fill a bin in order until the next would exceed `most` or most_rows; a row with flush begins one. order is unique in a key."""
    rows = df.select(key, order, size, (F.lit(False) if flush is None else F.coalesce(flush, F.lit(False))).alias("_flush"))
    state = lambda total, n: F.struct(total.cast("long").alias("total"), n.cast("int").alias("n"))
    begins = lambda held, v: (held["n"] == 0) | v["_flush"] | ((held["total"] > 0) & (held["total"] + v[size] > most)) | (held["n"] >= most_rows)
    moved = lambda held, v, new: state(F.when(new, F.lit(0)).otherwise(held["total"]) + v[size], F.when(new, F.lit(0)).otherwise(held["n"]) + 1)
    firsts = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, size, "_flush"))).alias("_all"))
    firsts = firsts.select(key, F.explode(_starts(F.col("_all"), begins, state(F.lit(0), F.lit(0)), moved)).alias("_v"))
    met = rows.join(firsts.select(key, F.col(f"_v.{order}").alias(order), F.lit(1).alias("_first")), [key, order], "left")
    bin_ = F.count("_first").over(Window.partitionBy(key).orderBy(order)) - 1
    return met.select(key, order, size, bin_.alias("bin"))


def page_counts(df: DataFrame, key: str, order: str, words: str, heading: str, soft: int, hard: int) -> DataFrame:
    """(key, pages): a page ends before a heading once it has `soft` words and after any other row once it has `hard`; a fold over each key's rows."""
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, F.col(words).cast("long").alias("n"), F.col(heading).alias("h")))).alias("all"))
    state = lambda held, pages: F.struct(held.cast("long").alias("held"), pages.cast("long").alias("pages"))

    def step(acc, v):
        before = v["h"] & (acc["held"] >= soft)
        total = F.when(before, F.lit(0)).otherwise(acc["held"]) + v["n"]
        after = ~v["h"] & (total >= hard)
        return state(F.when(after, F.lit(0)).otherwise(total), acc["pages"] + (before | after).cast("int"))

    pages = F.aggregate("all", state(F.lit(0), F.lit(0)), step, lambda acc: acc["pages"] + (acc["held"] > 0).cast("int"))
    return rows.select(key, pages.alias("pages"))


def first_event_windows(df: DataFrame, key: str, at: str, seconds: int, limit: int) -> DataFrame:
    """(key, at, opened, count, allowed): counters whose window opens at the first event after the last one closed.

    Where a key pauses for `seconds` every window is closed: the fold runs over the times between two pauses, not over a key's whole history.
    """
    e = df.select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("at"))
    w = Window.partitionBy("key").orderBy("at")
    pause = F.unix_micros("at") - F.unix_micros(F.lag("at").over(w)) >= seconds * 1_000_000
    times = e.select("key", "at").distinct().withColumn("_p", F.when(pause, 1).otherwise(0)).withColumn("_busy", F.sum("_p").over(w))
    begins, moved = _opened_after(seconds)
    busy = times.groupBy("key", "_busy").agg(F.array_sort(F.collect_list("at")).alias("all"))
    opened = busy.select("key", F.explode(_starts(F.col("all"), begins, F.lit(None).cast("timestamp"), moved)).alias("at")).withColumn("o", F.col("at"))
    met = e.join(opened, ["key", "at"], "left").withColumn("opened", F.last("o", ignorenulls=True).over(w))
    count = F.row_number().over(Window.partitionBy("key", "opened").orderBy("at")).cast("long")
    back = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return met.withColumn("count", count).select("key", back("at"), back("opened"), "count", (F.col("count") <= limit).alias("allowed"))


def budget_tail(df: DataFrame, key: str, order: str, size: Column, budget: int) -> DataFrame:
    """The last rows of each key whose sizes fit the budget together; the last one always."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    used = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_used", used).withColumn("_rn", F.row_number().over(w)).where((F.col("_used") <= budget) | (F.col("_rn") == 1)).drop("_used", "_rn")
