"""Masking of addresses: stable pseudonyms in order of first appearance, in columns and inside texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.durable import settle
from netquarry.operators.ordering import global_index

#: Fixed value: four numbers up to 255 with dots between.
ADDRESS = r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"


def masked_ports(text: Column, by: str = ":[PORT]") -> Column:
    """Ports of two to five digits behind a colon."""
    return F.regexp_replace(text, r":\d{2,5}\b", by)


def _inside(text: str, part: int) -> Column:
    """(part, at, address) of each address in a text."""
    addresses = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ADDRESS), F.lit(0))
    return F.transform(addresses, lambda a, i: F.struct(F.lit(part).alias("part"), i.alias("at"), a.alias("address")))


def mask_addresses(rows: DataFrame, order: list[str], columns: list[str], texts: list[str], prefix: str = "Masked_IP_") -> tuple[DataFrame, DataFrame]:
    """(rows with the addresses of `columns` and inside `texts` replaced, the table (address, pseudonym, number)).

    An address is numbered by its first appearance: rows by `order`, then columns as they are listed, then texts from left to
    right. Texts are cut at the addresses; what was found is exploded with its place, joined to the pseudonyms in a
    shuffle, and each text is put together again from its pieces, so no table of addresses travels to every task. Ports
    in texts are masked too. An address inside a longer number isn't one: whole matches are replaced, never prefixes.

    Null and empty columns stay null and empty; null texts stay null. The table (rows, settled) is read three times."""
    rows = settle(rows.withColumn("_id", F.monotonically_increasing_id()))
    cells = [F.when(F.col(c) != "", F.struct(F.lit(k).alias("part"), F.lit(0).alias("at"), F.col(c).alias("address"))) for k, c in enumerate(columns)]
    found = F.array_compact(F.array(*cells)) if cells else F.array().cast("array<struct<part:int,at:int,address:string>>")
    for k, c in enumerate(texts, len(columns)):
        found = F.concat(found, _inside(c, k))
    met = rows.select("_id", *order, F.explode(found).alias("f")).select("_id", *order, "f.*")
    place = F.struct(*order, "_id", "part", "at")
    first = met.groupBy("address").agg(F.min(place).alias("first")).select("address", "first.*")
    names = global_index(first, F.lit(0), [*order, "_id", "part", "at"], "number")
    names = settle(names.select("address", F.concat(F.lit(prefix), F.col("number").cast("string")).alias("pseudonym"), "number"))
    known = met.select("_id", "part", "at", "address").join(names.select("address", "pseudonym"), "address")
    per_row = known.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("part", "at", "pseudonym"))).alias("_met"))
    out = rows.join(per_row, "_id", "left")
    of = lambda k: F.transform(F.filter("_met", lambda m: m["part"] == k), lambda m: m["pseudonym"])
    changed = {c: F.when(F.col(c) != "", of(k)[0]).otherwise(F.col(c)) for k, c in enumerate(columns)}
    for k, c in enumerate(texts, len(columns)):
        pieces = F.transform(F.split(c, ADDRESS, -1), lambda p: masked_ports(p))
        joined = F.array_join(F.transform(F.arrays_zip(pieces.alias("p"), F.coalesce(of(k), F.array().cast("array<string>")).alias("n")), lambda z: F.concat(z["p"], F.coalesce(z["n"], F.lit("")))), "")
        changed[c] = joined
    return out.withColumns(changed).select(*[c for c in rows.columns if c != "_id"]), names
