"""Two stores of one thing: an archive for what closed before a cutoff, and a live one; which of them counts is decided by ticker."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brassloom.sources.parsers import parse_quote_candles


def first_listed(sources: list[DataFrame], key: str) -> DataFrame:
    """One row for each key, from the first of the sources that lists it (of several rows there, the smallest); a partial minimum, so no key's rows meet unreduced."""
    columns = sources[0].columns
    rest = [c for c in columns if c != key]
    ranked = [s.select(key, F.lit(i).alias("_rank"), *rest) for i, s in enumerate(sources)]
    best = reduce(DataFrame.unionByName, ranked).groupBy(key).agg(F.min(F.struct("_rank", *rest)).alias("_s"))
    return best.select(*[F.col(key) if c == key else F.col(f"_s.{c}").alias(c) for c in columns])


def routed_candles(markets: DataFrame, archive: DataFrame, live: DataFrame, cutoff: Column) -> DataFrame:
    """Candles of markets (ticker, opened, closed; epoch seconds) from payload pages (ticker, text) of the store that a market belongs to.

    A market that closed before the cutoff is read from the archive, another one from the live store; what the other store
    holds of it is dropped before its pages are parsed. Candles outside the market's time are dropped, and of pages that overlap
    a candle comes once.
    """
    known = markets.select("ticker", "opened", "closed", F.when(F.col("closed") < cutoff, "archive").otherwise("live").alias("_store"))
    pages = archive.select("ticker", "text", F.lit("archive").alias("_store")).unionByName(live.select("ticker", "text", F.lit("live").alias("_store")))
    candles = parse_quote_candles(pages.join(known, ["ticker", "_store"]), ["ticker", "opened", "closed"], "text")
    inside = candles.where("end_ts BETWEEN opened AND closed")
    once = inside.groupBy("ticker", "end_ts").agg(F.min(F.struct("bid_close", "ask_close", "volume")).alias("s"))
    return once.select("ticker", "end_ts", "s.*")
