"""Name candidates, closest names, candidate ranking and precheck over part."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import candidates as C
from shelfmark.operators import closest as CL
from shelfmark.operators import hash_match as H
from shelfmark.operators import name_match as M
from shelfmark.operators import precheck as P
from shelfmark.session import cut
from workload import frames as fr
from workload.frames import PARTS
from workload.naming import _EXPAND
from workload.registry import query

SCOPE = ["collection", "catalog"]
_X = _EXPAND.replace("{x}", "stem")
_BASE = r"trim(regexp_replace({c}, '\s*[\[\(].*', ''))"
_WORDS = r"'(?:^|[\s\-,:])' || regexp_escape({n}) || '(?:$|[\s\-,:])'"

NAMES = PARTS + rf""",
uniq AS (SELECT collection, catalog, set_name, min(set_pos) AS set_pos, arg_min(hash, set_pos) AS first_hash, arg_max(hash, set_pos) AS last_hash,
  lower({_BASE.format(c='set_name')}) AS set_base FROM part_set GROUP BY collection, catalog, set_name),
lowered AS (SELECT collection, catalog, lower(set_name) AS k, arg_max(set_name, set_pos) AS set_name, max(set_pos) AS set_pos,
  arg_max(last_hash, set_pos) AS expected_hash FROM uniq GROUP BY collection, catalog, lower(set_name)),
st AS (SELECT * FROM (SELECT collection, stem, {_BASE.format(c='stem')} AS base, lower({_BASE.format(c='stem')}) AS bk, {_X} AS expanded,
  trim(regexp_replace({_X}, '\s*\[.*?\]', '', 'g')) AS cleaned FROM part_stem) WHERE length(base) >= 3),
rules AS (
  SELECT collection, stem, 1 AS rule_ord, lower(stem) AS k, 'l' AS form, 0.95 AS conf FROM st
  UNION ALL SELECT collection, stem, 2, lower(cleaned), 'l', 0.95 FROM st
  UNION ALL SELECT collection, stem, 3, expanded, 'x', 0.9 FROM st WHERE expanded <> stem
  UNION ALL SELECT collection, stem, 4, cleaned, 'x', 0.9 FROM st WHERE expanded <> stem
  UNION ALL SELECT collection, stem, 5, lower(expanded), 'l', 0.85 FROM st WHERE expanded <> stem
  UNION ALL SELECT collection, stem, 6, lower(cleaned), 'l', 0.85 FROM st WHERE expanded <> stem),
full_name AS (
  SELECT t.collection, t.catalog, r.stem, t.set_name, t.set_pos, t.expected_hash, CAST(r.conf AS DOUBLE) AS confidence, r.rule_ord
  FROM rules r JOIN lowered t ON r.form = 'l' AND t.collection = r.collection AND t.k = r.k
  UNION ALL
  SELECT t.collection, t.catalog, r.stem, t.set_name, t.set_pos, t.last_hash, CAST(r.conf AS DOUBLE), r.rule_ord
  FROM rules r JOIN uniq t ON r.form = 'x' AND t.collection = r.collection AND t.set_name = r.k),
by_base AS (
  SELECT u.collection, u.catalog, s.stem, s.base, u.set_name, u.set_pos, u.first_hash AS expected_hash,
    CASE WHEN s.bk = u.set_base THEN 'equal'
         WHEN contains(u.set_base, s.bk) AND regexp_matches(u.set_base, {_WORDS.format(n='s.bk')}) THEN 'inside'
         WHEN contains(s.bk, u.set_base) AND regexp_matches(s.bk, {_WORDS.format(n='u.set_base')}) THEN 'around' END AS how,
    length(s.bk) AS a, length(u.set_base) AS b
  FROM st s JOIN uniq u ON u.collection = s.collection AND u.set_base <> '' AND (contains(u.set_base, s.bk) OR contains(s.bk, u.set_base))),
found AS (
  SELECT collection, catalog, stem, set_name, set_pos, expected_hash, confidence, rule_ord, CASE
    WHEN rule_ord <= 2 THEN 'Exact name match: "' || set_name || '"'
    WHEN rule_ord <= 4 THEN 'Region expanded: ' || stem || ' → ' || set_name
    ELSE 'Region expanded (case-insensitive): ' || stem || ' → ' || set_name END AS reason FROM full_name
  UNION ALL
  SELECT collection, catalog, stem, set_name, set_pos, expected_hash,
    CASE how WHEN 'equal' THEN 0.85 WHEN 'inside' THEN least(0.7, a::DOUBLE / b) ELSE least(0.5, b::DOUBLE / a) END, 7,
    CASE how WHEN 'equal' THEN 'Exact base name match: "' || base || '"'
      WHEN 'inside' THEN 'ROM name "' || base || '" found in "' || set_name || '"'
      ELSE 'DAT name "' || set_name || '" found in ROM name "' || base || '"' END
  FROM by_base WHERE how IS NOT NULL),
once AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY collection, catalog, stem, set_name ORDER BY rule_ord) AS rn FROM found) WHERE rn = 1),
named AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY collection, catalog, stem ORDER BY confidence DESC, rule_ord, set_pos) AS name_rank FROM once)
  WHERE name_rank <= 5)
"""


def _sets(spark, d):
    return H.first_hashes(fr.part_sets(spark, d))


@query("full_name_candidates", NAMES + """SELECT collection, catalog, stem, set_name, set_pos, expected_hash, confidence, rule_ord FROM full_name""")
def full_name_candidates(spark, d):
    return M.full_name_candidates(cut(M.stems(fr.part_files(spark, d))), cut(M.distinct_sets(_sets(spark, d)))).drop("reason")


@query("base_name_candidates", NAMES + """
SELECT DISTINCT collection, catalog, lower(base) AS base_key, set_name, set_pos, how,
  round(CASE how WHEN 'equal' THEN 0.85 WHEN 'inside' THEN least(0.7, a::DOUBLE / b) ELSE least(0.5, b::DOUBLE / a) END, 6) AS confidence
FROM by_base WHERE how IS NOT NULL""")
def base_name_candidates(spark, d):
    bases = cut(M.stems(fr.part_files(spark, d)).select("collection", "base_key").distinct())
    return M.base_candidates(bases, cut(M.distinct_sets(_sets(spark, d)))).select(
        *SCOPE, "base_key", "set_name", "set_pos", "how", F.round("confidence", 6).alias("confidence"))


@query("name_candidates", NAMES + """
SELECT collection, catalog, stem, set_name, set_pos, expected_hash, round(confidence, 6) AS confidence, rule_ord, reason, name_rank FROM named""")
def name_candidates(spark, d):
    return M.name_candidates(fr.part_files(spark, d), _sets(spark, d)).select(
        *SCOPE, "stem", "set_name", "set_pos", "expected_hash", F.round("confidence", 6).alias("confidence"), "rule_ord", "reason",
        F.col("name_rank").cast("bigint").alias("name_rank"))


@query("short_names", PARTS + rf"SELECT collection, stem, length({_BASE.format(c='stem')}) >= 3 AS asked FROM part_stem")
def short_names(spark, d):
    from shelfmark.functions import names as N

    stem = N.stem(F.col("file_name"))
    return fr.part_files(spark, d).select("collection", stem.alias("stem")).distinct().select(
        "collection", "stem", (F.length(N.extract_base(F.col("stem"))) >= 3).alias("asked"))


# ---- verification against the readings of a file ----
VERIFY = NAMES + """,
spread AS (SELECT f.collection, n.catalog, f.file_name, n.set_name, n.set_pos, n.expected_hash, n.confidence, n.reason, n.rule_ord
  FROM part_file f JOIN named n ON n.collection = f.collection AND n.stem = regexp_replace(f.file_name, '\\.[^.]+$', '')),
verified AS (SELECT s.collection, s.catalog, s.file_name, s.set_name, s.set_pos,
  CASE WHEN f.raw_hash = s.expected_hash THEN 1.0 WHEN f.cut_hash = s.expected_hash THEN 0.95 ELSE s.confidence END AS confidence,
  CASE WHEN f.raw_hash <> s.expected_hash AND f.cut_hash = s.expected_hash THEN s.reason || ' (after stripping SMC/SWC copier header (SNES) header)' ELSE s.reason END AS reason,
  s.expected_hash, CASE WHEN f.raw_hash <> s.expected_hash AND f.cut_hash = s.expected_hash THEN s.expected_hash ELSE f.raw_hash END AS actual_hash,
  f.raw_hash = s.expected_hash OR f.cut_hash = s.expected_hash AS hash_match,
  CASE WHEN f.raw_hash = s.expected_hash OR f.cut_hash = s.expected_hash THEN 'rename' ELSE 'crc_mismatch' END AS action, s.rule_ord
  FROM spread s JOIN part_file f ON f.collection = s.collection AND f.file_name = s.file_name)
"""


@query("verified_names", VERIFY + "SELECT * REPLACE (round(confidence, 6) AS confidence) FROM verified")
def verified_names(spark, d):
    from shelfmark.functions import names as N

    named = M.name_candidates(fr.part_files(spark, d), _sets(spark, d))
    spread = fr.part_files(spark, d).select("collection", "file_name", N.stem(F.col("file_name")).alias("stem")).join(
        named, ["collection", "stem"])
    return C.verify_names(spread, fr.part_variants(spark, d)).withColumn("confidence", F.round("confidence", 6))


# ---- all stages ----
GATHER = VERIFY + """,
by_hash AS (SELECT collection, catalog, hash, arg_min(set_name, set_pos) AS set_name, min(set_pos) AS set_pos, count(DISTINCT set_pos) AS n_sets
  FROM part_set GROUP BY collection, catalog, hash),
by_size AS (SELECT collection, catalog, size, arg_min(set_name, set_pos) AS set_name, arg_min(hash, set_pos) AS first_hash, min(set_pos) AS set_pos, count(DISTINCT set_pos) AS n_sets
  FROM part_set WHERE size > 0 GROUP BY collection, catalog, size),
catalogs AS (SELECT DISTINCT collection, catalog FROM part_set),
content AS (
  SELECT h.collection, h.catalog, v.file_name, h.set_name, h.set_pos, h.n_sets, CASE v.kind WHEN 'raw' THEN 1.0 ELSE 0.95 END::DOUBLE AS confidence,
    CASE v.kind WHEN 'raw' THEN 'Direct CRC match' ELSE 'Header detected: ' || v.label || ' (512 bytes, 100% zeros). CRC after stripping header matches DAT entry.' END AS reason,
    v.hash AS expected_hash, f.raw_hash AS actual_hash, true AS hash_match, 'rename' AS action, CASE v.kind WHEN 'raw' THEN 1 ELSE 2 END AS stage, v.variant_ord AS rule_ord, 'hash:' || v.hash AS content_key
  FROM part_variant v JOIN by_hash h ON h.collection = v.collection AND h.hash = v.hash
  JOIN part_file f ON f.collection = v.collection AND f.file_name = v.file_name
  UNION ALL
  SELECT z.collection, z.catalog, v.file_name, z.set_name, z.set_pos, z.n_sets, 0.3::DOUBLE,
    'Possible ' || v.label || ' (512 bytes). Size after stripping (' || CAST(v.size AS VARCHAR) || ') matches DAT, but CRC still differs.',
    z.first_hash, v.hash, false, 'crc_mismatch', 2, v.variant_ord, 'size:' || CAST(v.size AS VARCHAR)
  FROM part_variant v JOIN by_size z ON v.kind = 'prefix' AND z.collection = v.collection AND z.size = v.size
  WHERE NOT EXISTS (SELECT 1 FROM by_hash h WHERE h.collection = z.collection AND h.catalog = z.catalog AND h.hash = v.hash)),
sure AS (SELECT DISTINCT collection, catalog, file_name FROM content WHERE hash_match),
sized AS (SELECT DISTINCT v.collection, c.catalog, v.file_name, v.size FROM part_variant v JOIN catalogs c ON c.collection = v.collection
  WHERE v.kind = 'prefix' AND NOT EXISTS (SELECT 1 FROM by_hash h WHERE h.collection = c.collection AND h.catalog = c.catalog AND h.hash = v.hash)),
fresh AS (SELECT v.* FROM verified v
  WHERE NOT EXISTS (SELECT 1 FROM sure s WHERE s.collection = v.collection AND s.catalog = v.catalog AND s.file_name = v.file_name)
    AND NOT EXISTS (SELECT 1 FROM sized z JOIN part_set p ON p.collection = z.collection AND p.catalog = z.catalog AND p.size = z.size
      WHERE z.collection = v.collection AND z.catalog = v.catalog AND z.file_name = v.file_name AND p.set_name = v.set_name)),
every AS (SELECT * FROM content UNION ALL
  SELECT collection, catalog, file_name, set_name, set_pos, 1, confidence, reason, expected_hash, actual_hash, hash_match, action, 4, rule_ord, NULL FROM fresh),
gathered AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY collection, catalog, file_name, set_name ORDER BY stage, rule_ord) AS rn FROM every) WHERE rn = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY collection, catalog, file_name
  ORDER BY coalesce(hash_match, false) DESC, confidence DESC, stage, rule_ord, set_pos) AS candidate_rank FROM gathered)
"""


def _gathered(spark, d):
    # hashes and entries are tables of their own in use: computed once, joined many times
    return C.gather(cut(fr.part_files(spark, d)), cut(fr.part_variants(spark, d)), cut(fr.part_sets(spark, d)))


query("candidates", GATHER + "SELECT * REPLACE (round(confidence, 6) AS confidence) FROM gathered")(
    lambda spark, d: _gathered(spark, d).withColumn("confidence", F.round("confidence", 6)))
query("candidate_sets", PARTS + """
SELECT collection, catalog, 'hash:' || hash AS content_key, set_name, min(set_pos) AS set_pos, hash AS expected_hash FROM part_set GROUP BY ALL
UNION ALL
SELECT collection, catalog, 'size:' || CAST(size AS VARCHAR), set_name, min(set_pos), arg_min(hash, set_pos) FROM part_set WHERE size > 0 GROUP BY collection, catalog, size, set_name""")(
    lambda spark, d: H.content_sets(fr.part_sets(spark, d)))
query("ranked_candidates", GATHER + "SELECT collection, catalog, file_name, set_name, hash_match, candidate_rank FROM ranked")(
    lambda spark, d: C.rank(_gathered(spark, d)).select(
        *SCOPE, "file_name", "set_name", "hash_match", F.col("candidate_rank").cast("bigint").alias("candidate_rank")))
_BEST = """SELECT collection, file_name, catalog, set_name, round(confidence, 6) AS confidence, hash_match, CASE WHEN hash_match THEN 'matched' END AS status FROM (
  SELECT *, row_number() OVER (PARTITION BY collection, file_name ORDER BY {lead} confidence DESC, catalog, coalesce(hash_match, false) DESC, stage, rule_ord, set_pos) AS rn
  FROM gathered) WHERE rn = 1"""


# ---- further rules, one of which fails on some of its rows ----
def _first_set_rule(files, variants, entries):
    """Names the first set of each catalogue for files whose name has a length divisible by seven."""
    some = files.where(F.length("file_name") % 7 == 0).select("collection", "file_name")
    firsts = entries.groupBy(*SCOPE).agg(F.min(F.struct("set_pos", "set_name")).alias("s")).select(*SCOPE, "s.*")
    return some.join(firsts, "collection").withColumns({"confidence": F.lit(0.2), "reason": F.lit("first of its catalogue"), "stage": F.lit(9), "rule_ord": F.lit(0), "n_sets": F.lit(1).cast("bigint")})


def _failing_rule(files, variants, entries):
    bad = F.when(F.length("file_name") % 7 == 0, F.raise_error(F.lit("disk on fire"))).otherwise(0.5)
    return files.join(entries.select(*SCOPE, "set_name", "set_pos").distinct(), "collection").withColumn("confidence", bad.cast("double"))


def _ruled(spark, d):
    tables = cut(fr.part_files(spark, d)), cut(fr.part_variants(spark, d)), cut(fr.part_sets(spark, d))
    found, failed = C.run_rules({"first": _first_set_rule, "burning": _failing_rule}, *tables)
    return C.gather(*tables, *found), failed


@query("further_rules", GATHER + """, ruled AS (SELECT f.collection, p.catalog, f.file_name, p.set_name, p.set_pos FROM part_file f
  JOIN (SELECT collection, catalog, arg_min(set_name, set_pos) AS set_name, min(set_pos) AS set_pos FROM part_set GROUP BY ALL) p ON p.collection = f.collection WHERE length(f.file_name) % 7 = 0)
SELECT collection, catalog, file_name, set_name, stage::INT AS stage FROM gathered UNION ALL
SELECT collection, catalog, file_name, set_name, 9 FROM ruled ANTI JOIN gathered USING (collection, catalog, file_name, set_name)""")
def further_rules(spark, d):
    return _ruled(spark, d)[0].select(*SCOPE, "file_name", "set_name", F.col("stage").cast("int").alias("stage"))


# how many files the failing rule would have stumbled on decides whether it fails at all
@query("failed_rules", PARTS + """SELECT 'burning' AS rule, true AS named, true AS told FROM part_file WHERE length(file_name) % 7 = 0 LIMIT 1""")
def failed_rules(spark, d):
    return _ruled(spark, d)[1].select("rule", F.contains("error", F.lit("Analyzer 'burning' failed")).alias("named"), F.contains("error", F.lit("disk on fire")).alias("told"))


def _best(legacy):
    return lambda spark, d: C.best_per_file(_gathered(spark, d), legacy_order=legacy).select(
        "collection", "file_name", "catalog", "set_name", F.round("confidence", 6).alias("confidence"), "hash_match", "status")


query("best_matches", GATHER + _BEST.format(lead="coalesce(hash_match, false) DESC,"))(_best(False))
query("best_matches_by_confidence", GATHER + _BEST.format(lead=""))(_best(True))


# ---- closest name ----
_NORM = r"regexp_replace(regexp_replace(lower({c}), '\s*[\[\(][^\]\)]*[\]\)]', '', 'g'), '[^a-z0-9]', '', 'g')"
_CLEAN = r"trim(regexp_replace(lower(trim(regexp_replace({c}, '\s*[\[\(].*', ''))), '[^a-z0-9 ]', '', 'g'))"
_TAGS = r"list_distinct(regexp_extract_all({c}, '[\[\(]([^\]\)]+)[\]\)]', 1))"
_CHARS = "list_sort(list_distinct(string_split({c}, '')))"
_ONLY = "array_to_string(list_sort(list_filter({a}, lambda t: NOT list_contains({b}, t))), ', ')"


def closest_sql(asked: str) -> str:
    """SQL over CTEs part_set and {asked}(collection, catalog, file_name): every name against every set."""
    return rf""",
q AS (SELECT collection, catalog, file_name, regexp_replace(file_name, '\.[^.]+$', '') AS stem FROM {asked}),
q2 AS (SELECT *, {_CLEAN.format(c='stem')} AS clean, {_NORM.format(c='stem')} AS norm, {_TAGS.format(c='stem')} AS tags FROM q),
s2 AS (SELECT collection, catalog, set_pos, set_name, {_CLEAN.format(c='set_name')} AS clean, {_NORM.format(c='set_name')} AS norm, {_TAGS.format(c='set_name')} AS tags FROM part_set),
same AS (SELECT q2.collection, q2.catalog, q2.file_name, arg_min(s2.set_name, s2.set_pos) AS set_name, arg_min(s2.tags, s2.set_pos) AS set_tags
  FROM q2 JOIN s2 ON s2.collection = q2.collection AND s2.catalog = q2.catalog AND s2.clean = q2.clean WHERE q2.clean <> '' GROUP BY ALL),
qn AS (SELECT DISTINCT collection, catalog, norm, {_CHARS.format(c='norm')} AS chars FROM q2 WHERE norm <> ''),
sn AS (SELECT collection, catalog, {_CHARS.format(c='norm')} AS chars, arg_min(set_name, set_pos) AS set_name, min(set_pos) AS set_pos FROM s2 WHERE norm <> '' GROUP BY ALL),
near AS (SELECT collection, catalog, norm, set_name FROM (
  SELECT *, row_number() OVER (PARTITION BY collection, catalog, norm ORDER BY score DESC, set_pos) AS rn FROM (
    SELECT qn.collection, qn.catalog, qn.norm, sn.set_name, sn.set_pos, len(list_intersect(qn.chars, sn.chars))::DOUBLE / greatest(len(qn.chars), len(sn.chars)) AS score
    FROM qn JOIN sn ON sn.collection = qn.collection AND sn.catalog = qn.catalog) WHERE score > 0.7) WHERE rn = 1),
parts AS (SELECT q2.*, same.set_name AS same_name, near.set_name AS near_name,
  {_ONLY.format(a='q2.tags', b='same.set_tags')} AS only_file, {_ONLY.format(a='same.set_tags', b='q2.tags')} AS only_set
  FROM q2 LEFT JOIN same ON same.collection = q2.collection AND same.catalog = q2.catalog AND same.file_name = q2.file_name
  LEFT JOIN near ON near.collection = q2.collection AND near.catalog = q2.catalog AND near.norm = q2.norm),
closest AS (SELECT collection, catalog, file_name, coalesce(same_name, near_name) AS closest_set,
  CASE WHEN same_name IS NOT NULL THEN 'Similar: ' || same_name || ' — ' || CASE
    WHEN only_file = '' AND only_set = '' THEN 'Different naming convention'
    WHEN only_set = '' THEN 'ROM has: ' || only_file WHEN only_file = '' THEN 'DAT has: ' || only_set
    ELSE 'ROM has: ' || only_file || '; DAT has: ' || only_set END
  WHEN near_name IS NOT NULL THEN 'Similar: ' || near_name ELSE 'No similar DAT entry found' END AS note FROM parts)
"""


_ASKED = "asked AS (SELECT f.collection, c.catalog, f.file_name FROM part_file f JOIN (SELECT DISTINCT collection, catalog FROM part_set) c ON c.collection = f.collection)"


@query("closest_sets", PARTS + ", " + _ASKED + closest_sql("asked") + "SELECT * FROM closest")
def closest_sets(spark, d):
    sets = fr.part_sets(spark, d)
    files = fr.part_files(spark, d).select("collection", "file_name").join(sets.select(*SCOPE).distinct(), "collection")
    return CL.closest_sets(files, sets)


# ---- precheck ----
PRE = PARTS + rf""",
ks AS (SELECT *, row_number() OVER (PARTITION BY collection, catalog, name_key ORDER BY set_pos) AS k FROM (
  SELECT collection, catalog, set_pos, set_name, {_NORM.format(c='set_name')} AS name_key FROM part_set)),
kf AS (SELECT *, row_number() OVER (PARTITION BY collection, name_key ORDER BY file_name) AS k FROM (
  SELECT collection, file_name, {_NORM.format(c="regexp_replace(file_name, '[.][^.]+$', '')")} AS name_key FROM part_file)),
pair AS (SELECT ks.collection, ks.catalog, ks.set_pos, ks.set_name, coalesce(kf.file_name, f1.file_name) AS file_name
  FROM ks LEFT JOIN kf ON kf.collection = ks.collection AND kf.name_key = ks.name_key AND kf.k = ks.k
  LEFT JOIN kf f1 ON f1.collection = ks.collection AND f1.name_key = ks.name_key AND f1.k = 1),
loose AS (SELECT f.collection, c.catalog, f.file_name FROM part_file f JOIN (SELECT DISTINCT collection, catalog FROM part_set) c ON c.collection = f.collection
  WHERE NOT EXISTS (SELECT 1 FROM pair p WHERE p.collection = f.collection AND p.catalog = c.catalog AND p.file_name = f.file_name))
"""


def _pairs(spark, d):
    return P.pair_by_name(fr.part_files(spark, d), P.sets_of(fr.part_sets(spark, d)))


query("name_pairs", PRE + "SELECT * FROM pair")(_pairs)
query("files_without_set", PRE + "SELECT * FROM loose")(
    lambda spark, d: P.files_without_set(fr.part_files(spark, d), _pairs(spark, d)))


@query("precheck_rows", PRE + closest_sql("loose") + r"""
SELECT collection, catalog, set_name, file_name, set_name || '.zip' AS expected_file_name,
  CASE WHEN file_name IS NULL THEN 'missing' ELSE 'unverified' END AS status, '' AS note FROM pair
UNION ALL
SELECT collection, catalog, regexp_replace(file_name, '\.[^.]+$', ''), file_name, '', 'unmatched', note FROM closest""")
def precheck_rows(spark, d):
    # files, sets and pairs are read by several joins: one table each instead of their whole plan again
    files, sets = cut(fr.part_files(spark, d)), cut(P.sets_of(fr.part_sets(spark, d)))
    return P.result_rows(files, sets, cut(P.pair_by_name(files, sets)))


PROFILE = PRE + r""",
prof AS (SELECT e.collection, e.catalog, e.set_count, e.entry_types, f.file_count, f.file_types, p.name_matches FROM
  (SELECT collection, catalog, count(DISTINCT set_pos) AS set_count, list_sort(list_distinct(list(lower(regexp_extract(entry_name, '[^/](\.[^./]+)$', 1))))) AS entry_types FROM part_set GROUP BY ALL) e
  JOIN (SELECT collection, count(*) AS file_count, list_sort(list_distinct(list(lower(regexp_extract(file_name, '[^/](\.[^./]+)$', 1))))) AS file_types FROM part_file GROUP BY ALL) f ON f.collection = e.collection
  JOIN (SELECT collection, catalog, count(file_name) AS name_matches FROM pair GROUP BY ALL) p ON p.collection = e.collection AND p.catalog = e.catalog)
"""


@query("precheck_profile", PROFILE + "SELECT collection, catalog, set_count, array_to_string(entry_types, ', ') AS entry_types, file_count, array_to_string(file_types, ', ') AS file_types, name_matches FROM prof")
def precheck_profile(spark, d):
    p = P.profile(fr.part_files(spark, d), fr.part_sets(spark, d), _pairs(spark, d))
    return p.withColumns({"entry_types": F.array_join("entry_types", ", "), "file_types": F.array_join("file_types", ", ")})


query("shared_types", PROFILE + "SELECT collection, catalog, array_to_string(list_sort(list_intersect(entry_types, file_types)), ', ') AS shared FROM prof")(
    lambda spark, d: P.shared_types(P.profile(fr.part_files(spark, d), fr.part_sets(spark, d), _pairs(spark, d))).withColumn(
        "shared", F.array_join("shared", ", ")))


@query("tag_differences", rf"""WITH n AS (SELECT p_partkey, {_TAGS.format(c='a')} AS x, {_TAGS.format(c='b')} AS y FROM (SELECT p_partkey, {fr.STEM} AS a, {fr.SET_NAME} AS b FROM part))
SELECT p_partkey, {_ONLY.format(a='x', b='y')} AS only_file, {_ONLY.format(a='y', b='x')} AS only_set FROM n""")
def tag_differences(spark, d):
    from shelfmark.functions import names as N

    x, y = N.extract_tags(F.expr(fr.STEM)), N.extract_tags(F.expr(fr.SET_NAME))
    return fr.table(spark, d, "part").select("p_partkey", CL.extra_tags(x, y).alias("only_file"), CL.extra_tags(y, x).alias("only_set"))


# one catalogue per brand and size, so that every rule of the rating is met by some profile
_RATING_ROWS = """rated AS (SELECT p_brand || '-' || CAST(p_size AS STRING) AS catalog,
  CASE WHEN p_size % 7 = 0 THEN 0 ELSE count(*) * 10 END AS set_count,
  CASE WHEN p_size % 9 = 0 THEN 0 ELSE count(*) END AS file_count,
  CASE WHEN p_size % 7 = 0 THEN 0 ELSE CAST(count(*) * (p_size % 5) AS BIGINT) END AS name_matches,
  CASE p_size % 4 WHEN 0 THEN '.sfc' WHEN 1 THEN '.iso' WHEN 2 THEN '.pkg' ELSE '.nes' END AS entry_type,
  CASE p_size % 3 WHEN 0 THEN '.zip' WHEN 1 THEN '.sfc' ELSE '.bin' END AS file_type
  FROM part GROUP BY p_brand, p_size)"""


@query("compatibility_rating", f"""WITH {_RATING_ROWS},
x AS (SELECT *, name_matches * 100.0::DOUBLE / nullif(set_count, 0) AS pct,
  'DAT expects ' || entry_type || ', ROMs have ' || file_type AS expects, file_type IN ('.bin', '.iso') AS disc, entry_type = '.iso' AS sdisc, entry_type = '.pkg' AS store FROM rated)
SELECT catalog, CASE WHEN file_count = 0 THEN 'red' WHEN set_count = 0 THEN 'red' WHEN store AND disc THEN 'red' WHEN disc AND NOT sdisc AND NOT store THEN 'yellow'
    WHEN entry_type <> file_type AND file_type <> '.zip' THEN 'red' WHEN pct > 20 THEN 'green' WHEN name_matches > 0 OR file_type = '.zip' THEN 'yellow' ELSE 'red' END AS rating,
  CASE WHEN file_count = 0 THEN 'ROM directory is empty' WHEN set_count = 0 THEN 'DAT file has no games'
    WHEN store AND disc THEN 'DAT is for digital store packages but ROMs are disc dumps. Try Redump DATs.'
    WHEN disc AND NOT sdisc AND NOT store THEN 'ROMs are disc images but DAT expects cartridge dumps'
    WHEN entry_type <> file_type AND file_type <> '.zip' THEN 'No extension match. ' || expects
    WHEN pct > 20 THEN CAST(name_matches AS VARCHAR) || ' filename matches (' || CAST(CAST(round_even(pct, 0) AS INT) AS VARCHAR) || '% of DAT)'
    WHEN name_matches > 0 THEN 'Only ' || CAST(name_matches AS VARCHAR) || ' filename matches (' || CAST(CAST(round_even(pct, 0) AS INT) AS VARCHAR) || '% of DAT). CRC scan may find more.'
    WHEN file_type = '.zip' THEN 'No filename matches but extensions are compatible. CRC scan may find matches.'
    ELSE 'No filename matches. ' || expects END AS reason
FROM x""")
def compatibility_rating(spark, d):
    rows = fr.table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n")).selectExpr(
        "p_brand || '-' || CAST(p_size AS STRING) AS catalog",
        "CASE WHEN p_size % 7 = 0 THEN 0 ELSE n * 10 END AS set_count",
        "CASE WHEN p_size % 9 = 0 THEN 0 ELSE n END AS file_count",
        "CASE WHEN p_size % 7 = 0 THEN 0 ELSE CAST(n * (p_size % 5) AS BIGINT) END AS name_matches",
        "array(CASE p_size % 4 WHEN 0 THEN '.sfc' WHEN 1 THEN '.iso' WHEN 2 THEN '.pkg' ELSE '.nes' END) AS entry_types",
        "array(CASE p_size % 3 WHEN 0 THEN '.zip' WHEN 1 THEN '.sfc' ELSE '.bin' END) AS file_types")
    return P.rate(rows).select("catalog", "rating", "reason")
