"""Name expressions over set names, file stems, paths and whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import names as N
from shelfmark.functions import tables as T
from shelfmark.sources.inventory import collection_of
from workload import frames as fr
from workload.registry import query

_STEM_ROW = f"SELECT p_partkey AS id, {fr.STEM} AS stem FROM part"
_SET_ROW = f"SELECT p_partkey AS id, {fr.SET_NAME} AS set_name FROM part"
_BOTH = f"both_names AS ({_STEM_ROW} UNION ALL {_SET_ROW})"


def _names(spark, d):
    """Every stem and every set name."""
    part = fr.table(spark, d, "part")
    return part.selectExpr("p_partkey AS id", f"{fr.STEM} AS name").unionByName(
        part.selectExpr("p_partkey AS id", f"{fr.SET_NAME} AS name"))


def _over_names(fn):
    return lambda spark, d: _names(spark, d).select("id", "name", fn(F.col("name")).alias("value"))


def _sql(expr: str) -> str:
    return f"WITH {_BOTH} SELECT id, stem AS name, {expr.replace('{x}', 'stem')} AS value FROM both_names"


_EXPAND = "{x}"
for _code, _region in T.REGION_CODES.items():
    _EXPAND = f"replace({_EXPAND}, '({_code})', '({_region})')"

query("normalize_name", _sql(r"regexp_replace(regexp_replace(lower({x}), '\s*[\[\(][^\]\)]*[\]\)]', '', 'g'), '[^a-z0-9]', '', 'g')"))(
    _over_names(N.normalize_name))
query("extract_base", _sql(r"trim(regexp_replace({x}, '\s*[\[\(].*', ''))"))(_over_names(N.extract_base))
query("extract_base_name", _sql(r"trim(CASE WHEN starts_with({x}, '(') THEN {x} ELSE regexp_extract({x}, '^([^(]+)', 1) END)"))(
    _over_names(N.extract_base_name))
query("variant_base", _sql(r"lower(trim(regexp_replace({x}, '\s*\([^)]*\)\s*', ' ', 'g')))"))(_over_names(N.variant_base))
query("extract_tags", _sql(
    r"array_to_string(list_sort(list_distinct(regexp_extract_all({x}, '[\[\(]([^\]\)]+)[\]\)]', 1))), '|')"))(
    _over_names(lambda c: F.array_join(F.array_sort(N.extract_tags(c)), "|")))
query("extract_region", _sql(r"regexp_extract({x}, '\(([^)]+)\)', 1)"))(_over_names(N.extract_region))
query("expand_regions", _sql(_EXPAND))(_over_names(N.expand_regions))
query("clean_tags", _sql(rf"trim(regexp_replace({_EXPAND}, '\s*\[.*?\]', '', 'g'))"))(_over_names(N.clean_tags))
query("word_windows", _sql(r"""md5(array_to_string(list_sort(list_distinct(flatten(list_transform(
    list_filter(range(1, length({x}) + 1), lambda i: i = 1 OR regexp_matches(substr({x}, i - 1, 1), '[\s\-,:]')),
    lambda i: list_transform(
      list_filter(range(i + 1, length({x}) + 2), lambda j: j = length({x}) + 1 OR regexp_matches(substr({x}, j, 1), '[\s\-,:]')),
      lambda j: substr({x}, i, j - i)))))), '|'))"""))(
    _over_names(lambda c: F.md5(F.array_join(F.array_sort(F.array_distinct(N.word_windows(c))), "|"))))
query("package_name", _sql("{x} || '.zip'"))(_over_names(N.package_name))


@query("normalize_texts", r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(lower(text), '\s*[\[\(][^\]\)]*[\]\)]', '', 'g'), '[^a-z0-9]', '', 'g')) AS value
FROM documents""")
def normalize_texts(spark, d):
    return fr.table(spark, d, "documents").select("doc_id", F.md5(N.normalize_name(F.col("text"))).alias("value"))


@query("word_match", f"""
SELECT p_partkey, regexp_matches(lower({fr.SET_NAME}), '(?:^|[\\s\\-,:])' || regexp_escape(p_name) || '(?:$|[\\s\\-,:])') AS inside,
       regexp_matches(lower({fr.STEM}), '(?:^|[\\s\\-,:])' || regexp_escape(lower(p_brand)) || '(?:$|[\\s\\-,:])') AS brand_inside
FROM part""")
def word_match(spark, d):
    part = fr.table(spark, d, "part")
    return part.select(
        "p_partkey", N.word_match(F.col("p_name"), F.lower(F.expr(fr.SET_NAME))).alias("inside"),
        N.word_match(F.lower("p_brand"), F.lower(F.expr(fr.STEM))).alias("brand_inside"))


@query("clean_collection_name", fr.COLLECTIONS + r"""
SELECT pos, trim(regexp_replace(catalog_name, '\s*\((?:Parent-Clone|Headerless|Decrypted|Encrypted|BigEndian|LittleEndian|Multiboot|Download Play|PSN|A2R|\d{8}-\d{6})\)', '', 'g')) AS value
FROM catalog_row""")
def clean_collection_name(spark, d):
    return fr.catalogs(spark, d).select("pos", N.clean_collection_name(F.col("catalog_name")).alias("value"))


@query("split_vendor", fr.COLLECTIONS + """
SELECT pos, trim(split_part(collection, ' - ', 1)) AS vendor, trim(substr(collection, strpos(collection, ' - ') + 3)) AS rest
FROM directory_row""")
def split_vendor(spark, d):
    s = N.split_vendor(F.col("collection"))
    return fr.directories(spark, d).select("pos", s["vendor"].alias("vendor"), s["rest"].alias("rest"))


ALIAS_ROWS = ", ".join(
    f"('{spelling}', '{canon}', {i})"
    for i, (canon, spellings) in enumerate(T.COLLECTION_ALIASES.items())
    for spelling in dict.fromkeys([*spellings, canon])
)
SQL_ALIAS = f"alias AS (SELECT spelling, arg_min(canon, ord) AS canon FROM (VALUES {ALIAS_ROWS}) a(spelling, canon, ord) GROUP BY spelling)"


@query("canonicalize", fr.COLLECTIONS + f""", {SQL_ALIAS}
SELECT pos, canon AS value FROM directory_row LEFT JOIN alias ON lower(trim(substr(collection, strpos(collection, ' - ') + 3))) = spelling""")
def canonicalize(spark, d):
    return fr.directories(spark, d).select("pos", N.canonicalize(N.split_vendor(F.col("collection"))["rest"]).alias("value"))


@query("tokenize", r"""
SELECT doc_id, md5(array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(
         regexp_replace(lower(source || ' of ' || lang || '/the ' || text), '\b(?:the|of|and|for)\b', '', 'g'), '[\s\-/]+'),
         lambda t: length(t) > 1))), '|')) AS tokens
FROM documents""")
def tokenize(spark, d):
    text = F.lower(F.concat("source", F.lit(" of "), "lang", F.lit("/the "), "text"))
    return fr.table(spark, d, "documents").select("doc_id", F.md5(F.array_join(F.array_sort(N.tokenize(text)), "|")).alias("tokens"))


@query("path_parts", r"""
SELECT page_id, lower(regexp_extract(url, '[^/](\.[^./]+)$', 1)) AS extension,
       regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\.[^.]+$', '\1') AS stem,
       regexp_extract(url, '([^/]+)/[^/]+$', 1) AS collection
FROM pages""")
def path_parts(spark, d):
    url = F.col("url")
    return fr.table(spark, d, "pages").select(
        "page_id", N.extension(url).alias("extension"), N.stem(url).alias("stem"), collection_of(url).alias("collection"))
