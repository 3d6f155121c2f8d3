"""Content expressions: digests, prefix-stripped digests and byte-order variants.

All of them run where the content is read. Only the short digest rows go on into joins, so no
shuffle ever carries file content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import tables as T


def digest(content: Column, algo: str = "crc32") -> Column:
    if algo == "crc32":
        return F.lpad(F.lower(F.hex(F.crc32(content))), 8, "0")
    if algo == "md5":
        return F.md5(content)
    if algo == "sha1":
        return F.sha1(content)
    raise ValueError(f"unknown digest {algo}")


def without_prefix(content: Column, n: int) -> Column:
    return F.substring(content, n + 1, 2147483647)


def zero_share(content: Column, n: int) -> Column:
    """Share of zero bytes among the first ``n`` bytes, in whole percent rounded down."""
    head = F.hex(F.substring(content, 1, n))
    zeros = F.length(F.regexp_replace(head, "(00)|..", "$1")) / 2
    return F.floor(zeros * 100 / n).cast("int")


def byte_order(content: Column) -> Column:
    magic = F.create_map(*[F.lit(x) for pair in T.BYTE_ORDER_MAGIC.items() for x in pair])
    found = F.try_element_at(magic, F.hex(F.substring(content, 1, 2)))
    return F.when(F.octet_length(content) >= 4, found)


def swap_bytes(content: Column, order: str) -> Column:
    """Big-endian layout of content held in ``order``; its own inverse, a partial last group stays."""
    if order == "byteswapped":
        return F.unhex(F.regexp_replace(F.hex(content), "(..)(..)", "$2$1"))
    if order == "littleendian":
        return F.unhex(F.regexp_replace(F.hex(content), "(..)(..)(..)(..)", "$4$3$2$1"))
    return content


def reencode(content: Column, from_order: Column, to_order: Column) -> Column:
    """From one byte order to another by way of big-endian."""

    def apply(c: Column, order: Column) -> Column:
        return (
            F.when(order == "byteswapped", swap_bytes(c, "byteswapped"))
            .when(order == "littleendian", swap_bytes(c, "littleendian"))
            .otherwise(c)
        )

    return apply(apply(content, from_order), to_order)


def byte_order_label(order: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in T.BYTE_ORDER_LABELS.items() for x in pair])
    return F.try_element_at(labels, order)


def content_variants(files: DataFrame, keys: list[str], algo: str = "crc32", swap: Column | None = None,
                     prefix_allowed: Column | None = None, zeros: bool = True) -> DataFrame:
    """One row per (file, way of reading its content): raw, each stripped prefix, each byte swap.

    Columns: ``keys`` + kind, prefix, label, order_found, hash, size, variant_ord, zero_pct.
    ``swap`` says which rows are also read in the other byte orders (None: no row). ``zeros`` off
    leaves zero_pct NULL, for uses that do not show reasons.
    """
    c = F.col("content")
    size = F.octet_length(c).cast("bigint")
    null_int, null_str = F.lit(None).cast("int"), F.lit(None).cast("string")

    def variant(ord_: int, kind: str, prefix, label, hash_, n, zero):
        return F.struct(
            F.lit(ord_).alias("variant_ord"), F.lit(kind).alias("kind"), prefix.alias("prefix"),
            label.alias("label"), hash_.alias("hash"), n.alias("size"), zero.alias("zero_pct"),
        )

    variants = [variant(0, "raw", null_int, null_str, digest(c, algo), size, null_int)]
    allowed = F.lit(True) if prefix_allowed is None else prefix_allowed
    for i, (n, label) in enumerate(T.PREFIXES, 1):
        one = variant(i, "prefix", F.lit(n), F.lit(label), digest(without_prefix(c, n), algo), size - n,
                      zero_share(c, n) if zeros else null_int)
        variants.append(F.when((size > n) & allowed, one))
    if swap is not None:
        for i, order in enumerate(("byteswapped", "littleendian"), 11):
            one = variant(i, "swap", null_int, F.lit(T.BYTE_ORDER_LABELS[order]), digest(swap_bytes(c, order), algo), size, null_int)
            variants.append(F.when(swap & byte_order(c).isNotNull(), one))
    read = files.select(*keys, byte_order(c).alias("order_found"), F.array_compact(F.array(*variants)).alias("variants"))
    # a swap that reads like the raw content, or like the other swap, adds nothing
    kept = F.filter(
        "variants",
        lambda v: ~((v.kind == "swap") & F.exists(
            "variants",
            lambda w: (w.kind != "prefix") & (w.variant_ord < v.variant_ord) & (w.hash == v.hash),
        )),
    )
    return read.select(*keys, "order_found", F.explode(kept).alias("v")).select(*keys, "order_found", "v.*")
