"""Plan rules: what has to change before a matched file equals its catalogue entry.

A rule is a function of the job's columns that returns a struct(name, description, params), NULL
when nothing has to be done. Add one to ``RULES`` and name it in a rule list to extend the plans.

``jobs``     collection, catalog, file_name, set_name, entry_name, source_type (with dot), size,
             order_found, zero_pct (map prefix length -> percent), readable
``members``  collection, file_name, member_pos, member_name
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import dispatch
from shelfmark.functions import names as N
from shelfmark.functions import tables as T
from shelfmark.functions.binary import byte_order_label

JOB = ["collection", "catalog", "file_name"]
# All rule lists keep this order.
ORDER = ["strip_header", "rename_ext", "remove_embedded", "compress_package", "convert_byteorder", "loose_file"]


def step(name: str, description: Column, **params: Column) -> Column:
    pairs = [x for key, value in params.items() for x in (F.lit(key), value.cast("string"))]
    return F.struct(F.lit(name).alias("name"), description.alias("description"), F.create_map(*pairs).alias("params"))


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def _order_of(ext: Column) -> Column:
    return F.try_element_at(_map(T.BYTE_ORDER_BY_TYPE), ext)


def strip_header() -> Column:
    source = F.col("source_type")
    n = F.try_element_at(_map(T.PREFIX_BY_TYPE), source)
    zeros = F.try_element_at(F.col("zero_pct"), n)
    text = F.concat(
        F.lit("Strip "), n.cast("string"), F.lit("-byte copier header ("), source, F.lit(" format, "),
        zeros.cast("string"), F.lit("% zeros)"))
    fits = (F.col("size") > n) & ((F.col("size") - n) % 1024 == 0) & (zeros >= 80)
    return F.when(fits, step("strip_header", text, header_size=n, source_ext=source))


def rename_ext() -> Column:
    source, wanted = F.col("source_type"), N.extension(F.col("entry_name"))
    differ = (wanted != "") & (source != "") & (source != wanted)
    family = _order_of(source).isNotNull() & _order_of(wanted).isNotNull()
    text = F.concat(F.lit("Rename extension: "), source, F.lit(" → "), wanted)
    return F.when(differ & ~family, step("rename_ext", text, from_ext=source, to_ext=wanted))


def compress_package() -> Column:
    source, wanted = F.col("source_type"), N.extension(F.col("entry_name"))
    family = _order_of(source).isNotNull() & _order_of(wanted).isNotNull()
    package = N.package_name(F.col("set_name"))
    inner = F.when(family, F.concat("set_name", source)).otherwise(F.col("entry_name"))
    text = F.concat(F.lit("Package as: "), package, F.lit(" containing "), inner)
    return step("compress_package", text, zip_name=package, inner_name=inner)


def loose_file() -> Column:
    source = F.col("source_type")
    ext = F.when(source != "", source).otherwise(N.extension(F.col("entry_name")))
    target = F.concat("set_name", ext)
    return step("loose_file", F.concat(F.lit("Export as: "), target), target_name=target)


def convert_byteorder() -> Column:
    source, wanted = F.col("source_type"), N.extension(F.col("entry_name"))
    current = F.when(_order_of(source).isNotNull(), F.coalesce("order_found", _order_of(source)))
    target = _order_of(wanted)
    text = F.concat(
        F.lit("Convert byte order: "), byte_order_label(current), F.lit(" → "), byte_order_label(target))
    return F.when(
        current != target, step("convert_byteorder", text, from_fmt=current, to_fmt=target, new_ext=wanted))


RULES = {
    "strip_header": strip_header,
    "rename_ext": rename_ext,
    "compress_package": compress_package,
    "convert_byteorder": convert_byteorder,
    "loose_file": loose_file,
}


def target_entries(entries: DataFrame) -> DataFrame:
    """First entry of the first set of each name."""
    return entries.groupBy("collection", "catalog", "set_name").agg(
        F.min_by(F.coalesce("entry_name", F.lit("")), F.struct("set_pos", F.coalesce("entry_pos", F.lit(0)))).alias("entry_name"))


def _prepared(jobs: DataFrame) -> DataFrame:
    return jobs.withColumns({
        "rules": dispatch.plan_rules(F.col("collection")),
        "accepted": dispatch.accepted_types(F.col("catalog")),
    }).filter("readable")


def embedded_members(jobs: DataFrame, members: DataFrame) -> DataFrame:
    """Members a plan takes out of an archive: those of a type the catalogue's list does not hold."""
    archives = _prepared(jobs).filter(
        F.array_contains("rules", "remove_embedded") & F.col("accepted").isNotNull()
        & (N.extension(F.col("file_name")) == ".zip"))
    return archives.select(*JOB, "rules", "accepted").join(members, ["collection", "file_name"]).filter(
        ~F.array_contains("accepted", N.extension(F.col("member_name"))))


def plan_steps(jobs: DataFrame, members: DataFrame, rules: dict | None = None) -> DataFrame:
    """One row per step, ordered by ``step_pos``. An archive may need any number of removals."""
    rules = rules or RULES
    ready = _prepared(jobs)
    numbered = [
        F.when(F.array_contains("rules", name) & rule().isNotNull(),
               F.struct(F.array_position("rules", F.lit(name)).alias("rule_pos"), rule().alias("step")))
        for name, rule in rules.items()
    ]
    fixed = ready.select(*JOB, F.explode(F.array_compact(F.array(*numbered))).alias("r")).select(
        *JOB, F.col("r.rule_pos").alias("rule_pos"), F.lit(0).cast("bigint").alias("sub_pos"), "r.step.*")
    removed = embedded_members(jobs, members).select(
        *JOB, F.array_position("rules", F.lit("remove_embedded")).alias("rule_pos"),
        F.col("member_pos").cast("bigint").alias("sub_pos"),
        step("remove_embedded", F.concat(F.lit("Remove non-essential embedded file: "), "member_name"),
             filename=F.col("member_name")).alias("s"),
    ).select(*JOB, "rule_pos", "sub_pos", "s.*")
    return fixed.unionByName(removed).withColumn(
        "step_pos", F.shiftleft(F.col("rule_pos").cast("bigint"), 32) + F.col("sub_pos"))


def plan_headers(jobs: DataFrame, members: DataFrame) -> DataFrame:
    """Target name, number of steps, summary text and label of every job."""
    removed = embedded_members(jobs, members).groupBy(*JOB).agg(F.count(F.lit(1)).alias("n_removed"))
    ready = jobs.withColumn("rules", dispatch.plan_rules(F.col("collection"))).join(removed, JOB, "left")
    n = F.coalesce("n_removed", F.lit(0).cast("bigint"))

    def active(name: str) -> Column:
        return F.col("readable") & F.array_contains("rules", name) & RULES[name]().isNotNull()

    on = {name: active(name) for name in RULES}
    pieces = [
        F.when(n > 0, F.expr("rtrim(' → ', repeat('remove_embedded → ', cast(coalesce(n_removed, 0) as int)))"))
        if name == "remove_embedded" else F.when(on[name], name)
        for name in ORDER
    ]
    n_steps = n + sum((F.when(on[name], 1).otherwise(0) for name in RULES), F.lit(0))
    summary = F.concat_ws(" → ", *pieces)
    plain = F.when(F.coalesce("entry_name", F.lit("")) != "", F.col("entry_name")).otherwise(
        F.concat("set_name", F.regexp_extract("file_name", r"[^/](\.[^./]+)$", 1)))
    target = (
        F.when(on["compress_package"], compress_package()["params"]["zip_name"])
        .when(on["loose_file"], loose_file()["params"]["target_name"])
        .otherwise(plain)
    )
    return ready.select(
        *JOB, "set_name", target.alias("target_name"), n_steps.cast("bigint").alias("n_steps"),
        F.when(n_steps == 0, "No changes needed").otherwise(summary).alias("summary"),
        F.when(n_steps > 0, "modify").otherwise("ok").alias("plan_label"),
    )
