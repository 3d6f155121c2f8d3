"""Hash candidates. Each one is listed once per (content, set), never once per (file, set).

Popular contents are popular on both sides: many files hold the empty file and many sets list it.
Counting the files of a content first keeps every result linear in the catalogue plus the
inventory, and the list stays whole.

``variants``  collection, file_name, kind, prefix, label, hash, size, zero_pct, order_found, variant_ord
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.binary import byte_order_label
from shelfmark.operators.reconcile import SCOPE, _usable, wanted_hashes


def _set_hashes(entries: DataFrame) -> DataFrame:
    """(catalog, hash, set) without repeats, with the hash of the set's first entry."""
    return (
        entries.filter(_usable())
        .groupBy(*SCOPE, F.lower("hash").alias("hash"), "set_name")
        .agg(F.min("set_pos").alias("set_pos"))
    )


def first_hashes(entries: DataFrame) -> DataFrame:
    """Hash of the first entry of each set, which is what a candidate by name or size expects."""
    return entries.groupBy(*SCOPE, "set_pos").agg(
        F.min("set_name").alias("set_name"),
        F.min_by(F.lower("hash"), "entry_pos").alias("first_hash"),
    )


def contents(variants: DataFrame, kind: str) -> DataFrame:
    """Files grouped by the hash one way of reading gives."""
    return (
        variants.filter((F.col("kind") == kind) & _usable())
        .groupBy("collection", "hash", "prefix", "label")
        .agg(F.count(F.lit(1)).alias("n_files"), F.min("file_name").alias("first_file"))
    )


def direct_candidates(variants: DataFrame, entries: DataFrame) -> DataFrame:
    return contents(variants, "raw").join(_set_hashes(entries), ["collection", "hash"]).select(
        *SCOPE, "hash", "set_name", "set_pos", "n_files", "first_file",
        F.lit(1.0).alias("confidence"), F.lit(True).alias("hash_match"),
        F.lit("rename").alias("action"), F.lit("Direct CRC match").alias("reason"),
    )


def stripped_candidates(variants: DataFrame, entries: DataFrame) -> DataFrame:
    """Content after dropping a known prefix equals an entry."""
    return contents(variants, "prefix").join(_set_hashes(entries), ["collection", "hash"]).select(
        *SCOPE, "hash", "prefix", "label", "set_name", "set_pos", "n_files", "first_file",
        F.lit(0.95).alias("confidence"), F.lit(True).alias("hash_match"), F.lit("rename").alias("action"),
    )


def swapped_candidates(variants: DataFrame, entries: DataFrame) -> DataFrame:
    """Content read in another byte order equals an entry."""
    return contents(variants, "swap").join(_set_hashes(entries), ["collection", "hash"]).select(
        *SCOPE, "hash", "label", "set_name", "set_pos", "n_files", "first_file",
        F.lit(1.0).alias("confidence"), F.lit(True).alias("hash_match"), F.lit("rename").alias("action"),
    )


def prefix_misses(variants: DataFrame, entries: DataFrame) -> DataFrame:
    """Stripped variants as long as some entry of a catalogue whose content no entry of it has: a row each and catalogue.

    Variants meet catalogues on a size first, so no variant is repeated for catalogues it cannot concern.
    """
    sizes = entries.filter(F.col("size") > 0).select(*SCOPE, "size").distinct()
    return (
        variants.filter(F.col("kind") == "prefix").join(sizes, ["collection", "size"])
        .join(wanted_hashes(entries), [*SCOPE, "hash"], "left_anti")
    )


def content_sets(entries: DataFrame) -> DataFrame:
    """Every set of every content a candidate can name: (SCOPE, content_key, set_name, set_pos, expected_hash).

    ``content_key`` is ``hash:`` or ``size:`` and the value, as candidates carry it. Candidates hold the key and its
    first set, once a file; this table holds all sets of the key, once a catalogue: joined they are the full lists.
    """
    firsts = first_hashes(entries).select(*SCOPE, "set_pos", "first_hash")
    by_hash = _set_hashes(entries).select(
        *SCOPE, F.concat(F.lit("hash:"), "hash").alias("content_key"), "set_name", "set_pos", F.col("hash").alias("expected_hash"))
    sizes = entries.filter(F.col("size") > 0).groupBy(*SCOPE, "size", "set_name").agg(F.min("set_pos").alias("set_pos"))
    by_size = sizes.join(firsts, [*SCOPE, "set_pos"]).select(
        *SCOPE, F.concat(F.lit("size:"), F.col("size").cast("string")).alias("content_key"), "set_name", "set_pos",
        F.col("first_hash").alias("expected_hash"))
    return by_hash.unionByName(by_size)


def size_candidates(variants: DataFrame, entries: DataFrame) -> DataFrame:
    """Weak candidates: the length after stripping equals an entry's size, the content differs."""
    groups = prefix_misses(variants, entries).groupBy(*SCOPE, "size", "prefix", "label").agg(
        F.count(F.lit(1)).alias("n_files"), F.min("file_name").alias("first_file")
    )
    sizes = (
        entries.filter(F.col("size") > 0).groupBy(*SCOPE, "size", "set_name")
        .agg(F.min("set_pos").alias("set_pos"))
    )
    return (
        groups.join(sizes, [*SCOPE, "size"])
        .join(first_hashes(entries).drop("set_name"), [*SCOPE, "set_pos"])
        .select(
            *SCOPE, "size", "prefix", "set_name", "set_pos", "n_files", "first_file",
            F.col("first_hash").alias("expected_hash"),
            F.lit(0.3).alias("confidence"), F.lit(False).alias("hash_match"),
            F.lit("crc_mismatch").alias("action"),
        )
    )


def embedded_digest_candidates(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Disc images without a content hash, matched by the digest in their header.

    ``files``: collection, file_name, hash, embedded_sha1.
    """
    images = files.filter(F.col("hash").isNull() & F.col("embedded_sha1").isNotNull())
    listed = (
        entries.filter(_usable("sha1")).groupBy(*SCOPE, F.lower("sha1").alias("embedded_sha1"), "set_name")
        .agg(F.min("set_pos").alias("set_pos"))
    )
    counted = images.groupBy("collection", "embedded_sha1").agg(
        F.count(F.lit(1)).alias("n_files"), F.min("file_name").alias("first_file")
    )
    return counted.join(listed, ["collection", "embedded_sha1"]).select(
        *SCOPE, F.col("embedded_sha1").alias("hash"), "set_name", "set_pos", "n_files", "first_file",
        F.lit(1.0).alias("confidence"), F.lit(True).alias("hash_match"), F.lit("rename").alias("action"),
        F.format_string("SHA-1 match from CHD header (%s…)", F.substring("embedded_sha1", 1, 12)).alias("reason"),
    )


def swap_diagnostics(variants: DataFrame, entries: DataFrame, unconfirmed: DataFrame) -> DataFrame:
    """Per unconfirmed file and catalogue: what byte order was found and which readings were tried.

    One row per message, numbered by ``msg_ord``. ``unconfirmed``: collection, catalog, file_name.
    """
    tried = (
        variants.filter(F.col("kind").isin("raw", "swap") & F.col("order_found").isNotNull())
        .join(unconfirmed, ["collection", "file_name"])
        .join(wanted_hashes(entries).withColumn("listed", F.lit(True)), [*SCOPE, "hash"], "left")
    )
    yes = F.coalesce("listed", F.lit(False))
    is_raw = F.col("kind") == "raw"
    raw_text = F.concat(F.lit("Raw CRC: "), "hash", F.when(yes, " (in DAT)").otherwise(" (not in DAT)"))
    swap_text = F.concat(
        F.lit("Tried as "), "label", F.lit(": "), "hash", F.when(yes, " → MATCH").otherwise(" → no match")
    )
    found_text = F.concat(F.lit("N64 format detected: "), byte_order_label(F.col("order_found")))
    messages = F.when(
        is_raw,
        F.array(
            F.struct(F.lit(-1).alias("msg_ord"), found_text.alias("message")),
            F.struct(F.col("variant_ord").alias("msg_ord"), raw_text.alias("message")),
        ),
    ).otherwise(F.array(F.struct(F.col("variant_ord").alias("msg_ord"), swap_text.alias("message"))))
    return tried.select(*SCOPE, "file_name", F.explode(messages).alias("m")).select(*SCOPE, "file_name", "m.*")
