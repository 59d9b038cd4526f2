"""Queries over sealed messages and their search tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedge.functions import envelopes
from sedge.sources import table as t

QUERIES, SQL = {}, {}

#: Keys of these two queries alone; an application passes its own.
KEYS = {"v1": bytes(range(32)), "v2": bytes(range(32, 64))}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query("SELECT conv_id, turn, 'v2' AS version, text, false AS elsewhere FROM conversations")
def sealed_messages(s, d):
    """Each message sealed and opened again in its own context, and (in vain) in another."""
    context = [F.lit("message"), F.col("conv_id"), F.col("turn")]
    c = t(s, d, "conversations").select("conv_id", "turn", envelopes.sealed(F.col("text"), context, KEYS, "v2").alias("e"))
    other = [F.lit("preview"), F.col("conv_id"), F.col("turn")]
    return c.select(
        "conv_id", "turn", F.col("e.keyVersion").alias("version"), envelopes.opened(F.col("e"), context, KEYS).alias("text"),
        envelopes.opened(F.col("e"), other, KEYS).isNotNull().alias("elsewhere"),
    )


@query("""SELECT conv_id, turn FROM (SELECT conv_id, turn, trim(regexp_replace(strip_accents(lower(text)), '\\s+', ' ', 'g')) AS x FROM conversations)
WHERE contains(x, 'the a')""")
def blind_index_search(s, d):
    """Rows whose tokens hold the query's; these few are opened and compared with its text."""
    tokens = lambda x: envelopes.search_tokens(x, KEYS["v1"], "v1")
    query, context = "The  á", [F.lit("message"), F.col("conv_id"), F.col("turn")]
    held = t(s, d, "conversations").select("conv_id", "turn", tokens(F.col("text")).alias("tokens"), envelopes.sealed(F.col("text"), context, KEYS, "v1").alias("e"))
    found = held.where(envelopes.may_hold(F.col("tokens"), tokens(F.lit(query))))
    text = envelopes.flat(envelopes.opened(F.col("e"), context, KEYS))
    return found.where(F.contains(text, envelopes.flat(F.lit(query)))).select("conv_id", "turn")
