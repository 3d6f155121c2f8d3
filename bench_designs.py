"""Compare the chosen plans with the obvious ones at one scale; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS as in bench.py.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from shelfmark import session
from shelfmark.functions import binary as B
from shelfmark.functions import names as N
from shelfmark.operators import closest, hash_match, name_match, reconcile
from workload import frames as fr

SCOPE = ["collection", "catalog"]


def timed(df) -> float:
    best = None
    for _ in range(3):
        t0 = time.perf_counter()
        df().write.format("noop").mode("overwrite").save()
        best = min(best or 1e9, time.perf_counter() - t0)
    return round(best, 3)


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build("designs", f"local[{cpus}]", int(cpus), memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    out = {}

    sets = session.cut(name_match.distinct_sets(hash_match.first_hashes(fr.part_sets(spark, d))))
    bases = session.cut(name_match.stems(fr.part_files(spark, d)).select("collection", "base_key").distinct())
    out["word_containment_windows"] = timed(lambda: name_match.base_candidates(bases, sets))

    def pairwise():
        named = sets.withColumn("set_base", F.lower(N.extract_base(F.col("set_name"))))
        pair = bases.join(named, "collection")
        pad = lambda c: F.concat(F.lit(" "), F.regexp_replace(c, r"[\s\-,:]", " "), F.lit(" "))
        return pair.filter(pad(F.col("set_base")).contains(pad(F.col("base_key"))) | pad(F.col("base_key")).contains(pad(F.col("set_base"))))

    out["word_containment_pairwise"] = timed(pairwise)

    def masks(df, column):
        return df.withColumn("norm", N.normalize_name(F.col(column))).withColumn("mask", N.char_mask(F.col("norm"))).filter("mask <> 0")

    listed = session.cut(masks(fr.part_sets(spark, d), "set_name").groupBy(*SCOPE, "mask").agg(
        F.min(F.struct("set_pos", "set_name")).alias("s")).select(*SCOPE, "mask", "s.*"))
    asked = session.cut(masks(fr.part_files(spark, d).withColumn("stem", N.stem(F.col("file_name"))), "stem").join(
        listed.select(*SCOPE).distinct(), "collection").select(*SCOPE, "mask").distinct())
    out["closest_remainders"] = timed(lambda: closest.nearest_masks(asked, listed))

    def every_mask():
        a, b = F.col("mask"), F.col("other")
        score = F.bit_count(a.bitwiseAND(b)) / F.greatest(F.bit_count(a), F.bit_count(b))
        return asked.join(listed.withColumnRenamed("mask", "other"), SCOPE).withColumn("score", score).filter("score > 0.7").groupBy(
            *SCOPE, "mask").agg(F.max_by("set_name", F.struct("score", -F.col("set_pos"))))

    out["closest_pairwise"] = timed(every_mask)

    entries, hashes = session.cut(fr.doc_entries(spark, d)), session.cut(fr.doc_hashes(spark, d))
    out["reconcile_default"] = timed(lambda: reconcile.entry_results(entries, hashes))
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    out["reconcile_shuffle"] = timed(lambda: reconcile.entry_results(entries, hashes))
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    content = fr.doc_files(spark, d).select("content").repartition(int(cpus)).persist()
    size = content.agg(F.sum(F.octet_length("content"))).first()[0] / 1e6
    for algo in ("crc32", "md5", "sha1"):
        out[f"{algo}_mb_per_s"] = round(size / timed(lambda: content.select(F.max(B.digest(F.col("content"), algo)))))  # noqa: B023
    print(json.dumps({"sf": os.path.basename(d.rstrip("/")), "cpus": int(cpus), **out}))


if __name__ == "__main__":
    main()
