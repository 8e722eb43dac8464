"""Addresses against many networks: the longest prefix that holds each address.

Networks nest or are apart, so the places where one begins or ends cut the addresses into elementary intervals, each of
which has one longest prefix. An address belongs to the last interval that begins at or before it: an as-of join on the
address, cut into blocks of 65,536 addresses. Only distinct addresses take part, so a block is never more rows than that
and its intervals, however often one address comes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotline.functions.text import address
from slotline.operators.asof import asof_join
from slotline.sources.files import settled

BITS = 32
#: A dotted quad, each part at most 255.
PART = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
DOTTED = rf"^{PART}(\.{PART}){{3}}$"
CIDR = rf"^{PART}(\.{PART}){{3}}/(3[0-2]|[12]?[0-9])$"


def checked_address(dotted: Column) -> Column:
    """An address as a number; null for anything that is no dotted quad."""
    return F.when(dotted.rlike(DOTTED), address(dotted))


def prefix(at: Column, bits: Column) -> Column:
    """An address without all but its first ``bits`` bits."""
    return at - F.pmod(at, size(bits))


def size(bits: Column) -> Column:
    """How many addresses have a prefix of so many bits."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(BITS) - bits)


def intervals(networks: DataFrame) -> DataFrame:
    """(lo, hi, net) of the elementary intervals of ``networks`` (net: an address and the length of its prefix), apart from
    each other and each with the longest prefix that holds it; addresses that none holds are in no interval.

    What is no network is left out, and so are bits after the prefix: of networks that are the same then, the first by
    name stands for all. An interval's prefix is found by equalities: one for each prefix length in use.
    """
    ok = networks.filter(F.col("net").rlike(CIDR)).select("net", F.split("net", "/").alias("p"))
    bits = F.col("p")[1].cast("int")
    named = ok.select("net", bits.alias("bits"), prefix(address(F.col("p")[0]), bits).alias("lo"))
    named = settled(named.groupBy("lo", "bits").agg(F.min("net").alias("net")), "networks")
    cuts = named.select(F.explode(F.array("lo", F.col("lo") + size(F.col("bits")))).alias("lo")).distinct().filter(F.col("lo") < 1 << BITS)
    used = named.agg(F.collect_set("bits").alias("all"))  # at most 33 lengths
    tried = cuts.join(F.broadcast(used)).select(F.col("lo").alias("at"), F.explode("all").alias("bits"))
    tried = tried.withColumn("lo", prefix(F.col("at"), F.col("bits")))
    held = tried.join(named, ["lo", "bits"]).groupBy("at").agg(F.max_by("net", "bits").alias("net"))
    # an interval ends before the next cut, which lies in the same block or begins a later one
    every = cuts.join(held.withColumnRenamed("at", "lo"), "lo", "left")
    back = lambda c: (F.lit(1 << BITS) - c).alias("back")  # noqa: E731  the next cut is the last one in reversed order
    ahead = asof_join(every.select("lo", "net", back(F.col("lo"))), cuts.select(back(F.col("lo"))), [], "back", "back", strict=True, block=wide)
    hi = F.coalesce(F.lit(1 << BITS) - F.col("match.back"), F.lit(1 << BITS)) - 1
    return ahead.filter(F.col("net").isNotNull()).select("lo", hi.alias("hi"), "net")


def wide(at: Column) -> Column:
    """Blocks of 65,536 addresses."""
    return F.floor(at / (1 << 16))


def longest_prefix(rows: DataFrame, networks: DataFrame, ip: str = "ip") -> DataFrame:
    """Every row with ``net``: the longest network that holds its address, null if none does or it is no address."""
    own = settled(intervals(networks), "intervals")
    distinct = rows.select(F.col(ip).alias("_ip")).filter(F.col("_ip").isNotNull()).distinct().withColumn("_at", checked_address(F.col("_ip")))
    found = asof_join(distinct.filter(F.col("_at").isNotNull()), own, [], "_at", "lo", block=wide)
    found = found.filter(F.col("_at") <= F.col("match.hi")).select("_ip", F.col("match.net").alias("net"))
    found = settled(found, "addresses")  # a plain table, so that Spark can split an address that very many rows have
    return rows.drop("net").join(found, rows[ip] == found["_ip"], "left").drop("_ip")
