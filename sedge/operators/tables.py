"""Operators on keyed tables: upsert, insert if absent, prune, replace, compare, digest, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sedge.operators.ordered import first_wins
from sedge.session import stored


#: Rows of a large table that one task takes at a time, at most, where keys allow.
ROWS = 500_000


def parts_for(rows: DataFrame, each: int | None = None) -> int:
    """Partitions for as many rows, of `each` (ROWS) or fewer: a task's memory stays what it is when the table grows, whatever the session's settings are."""
    return 1 + rows.count() // (each or ROWS)


def upserted(old: DataFrame, new: DataFrame, key: list[str], order: list) -> DataFrame:
    """old with new's rows in place of those with their key; the last of new's rows in `order` wins."""
    last = first_wins(new, key, order)
    return old.join(last.select(*key), key, "left_anti").unionByName(last.select(*old.columns))


def inserted_if_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti").select(*old.columns))


def pruned(old: DataFrame, live: DataFrame, scope: list[str], key: list[str]) -> DataFrame:
    """old without rows whose scope was produced again but whose key wasn't."""
    stale = old.join(live.select(*scope).distinct(), scope, "left_semi").join(live.select(*key).distinct(), key, "left_anti")
    return old.join(stale.select(*key).distinct(), key, "left_anti")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeats counted."""
    b = b.select(*a.columns)
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows of a are lost in b, and how many are added there, repeats counted."""
    b = b.select(*a.columns)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(a.exceptAll(b), "lost").crossJoin(count(b.exceptAll(a), "added"))  # one row each


def below(tree: DataFrame, root: Column, most: int = 1000) -> DataFrame:
    """The ids of a tree's rows (id, parent) for which root holds, and of all below them; one round for each level."""
    edges = stored(tree.select("id", "parent", F.coalesce(root, F.lit(False)).alias("root")), "tree")
    found = level = stored(edges.where("root").select("id").distinct(), "level")
    for _ in range(most):
        level = edges.join(level.withColumnRenamed("id", "parent"), "parent").select("id").distinct().join(found, "id", "left_anti")
        level = stored(level, "level")
        if level.isEmpty():
            return found
        found = found.union(level)
    raise RuntimeError(f"the tree has more than {most} levels")


def digest(df: DataFrame, by: list[str], order: Column, value: Column) -> DataFrame:
    """sha256 of each group's values in order, with a line feed between them."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda s: s["v"])
    return df.groupBy(*by).agg(F.sha2(F.array_join(rows, "\n"), 256).alias("digest"))


def keyset_page(df: DataFrame, at: str, cursor: tuple | None, limit: int, tie: str) -> DataFrame:
    """The page after the cursor, the (at, tie) of the last row seen, newest first; one row more than the limit tells that there is a next page."""
    if cursor is not None:
        last, last_tie = map(F.lit, cursor)
        df = df.where((F.col(at) <= last) & ((F.col(at) < last) | (F.col(tie) < last_tie)))
    return df.orderBy(F.desc(at), F.desc(tie)).limit(limit + 1)


def offset_page(df: DataFrame, order: list, page: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def resolved(keys: DataFrame, key: str, aliases: DataFrame) -> DataFrame:
    """keys with the id of the alias of lowest priority; aliases: (alias, id, priority). An equality join, never an OR."""
    best = first_wins(aliases, ["alias"], ["priority", "id"])
    return keys.join(best.select(F.col("alias").alias(key), "id"), key, "left")


def atomic_replace(df: DataFrame, path: str, partition: str) -> None:
    """Replace just the partitions that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
