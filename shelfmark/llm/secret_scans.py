"""Secrets in texts, told apart by who holds them: values that many owners copy are examples, values of one owner may be live.

Every text is scanned once for patterns of secrets and for wider candidates (long mixed tokens). Only digests of the
values go on. Over the whole corpus each digest is counted by distinct repositories and distinct owners, reduced before
every shuffle, so an example that a third of all documents copy is a row a task. The counts go back to the documents
that hold the value, and settle two things: a wider candidate becomes a span of its own (kind ``owned``) if it looks live
and a single owner holds it; every span is marked as live (one owner, looks live) or copied (``COPIED`` owners or more).
Spans found by pattern stay whatever the counts say.

Cases: a null or empty text has no span; a missing owner or repository counts as one of that kind; rows that repeat an
id are scanned and returned each; a row without an id keeps none; texts are scanned whole, however long; an empty table
gives an empty result. Positions are code points, ends exclusive. Further columns stay out of the way.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, ship
from .registry import query

NAMES = ("password", "passwd", "secret", "token", "api_?key")
#: owners from which on a value is a copied example
COPIED = 3
#: spans in the order of their listing; the last one is the method's own
KINDS = ("assign", "access", "hex", "owned")


def either_case(pattern: str) -> str:
    """ASCII letters in either case, and only those (a flag would also match letters that fold to ASCII)."""
    return re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", pattern)


ASSIGN = f"({'|'.join(map(either_case, NAMES))})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
MIXED = "[A-Za-z0-9_-]{20,}"
_ASSIGN, _ACCESS = re.compile(ASSIGN), re.compile(ACCESS)
_HEX, _MIXED = re.compile(f"(?<![0-9a-f]){HEX}"), re.compile(f"(?<![A-Za-z0-9_-]){MIXED}")
#: what a text with an assignment has in lower case
_HINTS = (b"passw", b"secret", b"token", b"apikey", b"api_key")


def looks_live(value: str) -> bool:
    """A digit, a letter and eight different characters: not a word, a number or a filler."""
    return len(set(value)) >= 8 and re.search("[0-9]", value) is not None and re.search("[A-Za-z]", value) is not None


def looks_mixed(value: str) -> bool:
    """Small letters, capitals, two digits and ten different characters."""
    return len(set(value)) >= 10 and all(re.search(p, value) for p in ("[a-z]", "[A-Z]", "[0-9].*[0-9]"))


def scan(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of all spans and candidates, in order; candidates lie clear of the spans."""
    found = []
    small = text.encode("utf-8", "surrogatepass").lower()
    if any(hint in small for hint in _HINTS):
        found += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    more = [m for m in _MIXED.finditer(text) if looks_mixed(m[0])]
    if more:
        edges = sorted((s, e) for s, _, e, _ in found)
        k, reach = 0, -1
        for m in more:
            while k < len(edges) and edges[k][0] < m.end():
                reach = max(reach, edges[k][1])
                k += 1
            if reach <= m.start():
                found.append((m.start(), 3, m.end(), m[0]))
    return sorted(found, key=lambda x: x[:3])


def shown(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, *_ in spans)


FOUND = "array<struct<start:long,kind:int,end:long,live:boolean,digest:binary>>"
_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("live", pa.bool_()), ("digest", pa.binary())]))


def scanned(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """A table with a row per document: what was found, and who holds it."""
    ship(docs.sparkSession)

    def searched(batches):
        for batch in batches:
            founds, shas, counts = [], [], []
            for text in batch.column(3).to_pylist():
                found = scan(text)
                base = [x for x in found if x[1] < 3]
                counts.append([sum(x[1] == kind for x in base) for kind in range(3)])
                shas.append(hashlib.sha256(shown(base).encode()).hexdigest())
                founds.append([{"start": s, "kind": k, "end": e, "live": looks_live(v), "digest": hashlib.blake2b(v.encode(), digest_size=16).digest()} for s, k, e, v in found])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *[pa.array([c[k] for c in counts], pa.int64()) for k in range(3)], pa.array(shas, pa.string()), pa.array(founds, _TYPE)],
                ["doc_id", "owner", "repo", "n_assign", "n_access", "n_hex", "base_sha256", "found"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"doc_id long, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, found {FOUND}"
    return cut(rows.mapInArrow(searched, schema).withColumn("row", F.monotonically_increasing_id()))


def ownership(held: DataFrame) -> DataFrame:
    """(digest, n_owners, n_repos): a repository is one within its owner. Each step reduces before it shuffles."""
    repos = held.groupBy("digest", "owner", "repo").agg(F.lit(1).alias("one"))
    owners = repos.groupBy("digest", "owner").agg(F.count("one").alias("repos"))
    return owners.groupBy("digest").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "lang", copied: int = COPIED) -> DataFrame:
    """A row per document: the counts and the digest of spans by pattern, all spans, and those live and copied."""
    table = scanned(docs, id_col, text_col, owner_col, repo_col)
    held = table.where(F.size("found") > 0).select("row", "owner", "repo", F.explode("found").alias("x")).select("row", "owner", "repo", "x.*")
    # a value widely held is a hot key of this join, whose other side has one row a value
    judged = held.join(ownership(held), "digest")
    own = (F.col("n_owners") == 1) & F.col("live")
    # the list holds what one document holds
    marked = judged.where((F.col("kind") < 3) | own).groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
        "start", "kind", "end", own.alias("live"), (F.col("n_owners") >= copied).alias("copied"), "n_owners", "n_repos"))).alias("all"))
    rows = table.drop("found").join(marked, "row", "left")

    def listed(spans):
        each = F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"], x["end"]))
        return F.coalesce(F.concat_ws(",", each), F.lit(""))

    def number(condition):
        return F.coalesce(F.size(F.filter("all", condition)).cast("long"), F.lit(0).cast("long"))

    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,live:boolean,copied:boolean,n_owners:bigint,n_repos:bigint>>")
    rows = rows.withColumn("all", F.coalesce("all", none))
    return rows.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", listed("all").alias("spans"), number(lambda x: x["kind"] == 3).alias("n_owned"),
        number(lambda x: x["live"]).alias("n_live"), number(lambda x: x["copied"]).alias("n_copied"), listed(F.filter("all", lambda x: x["live"])).alias("live_spans"))


def _spans_sql(kind: int, pattern: str, value: str, keep: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, source, lang, {kind} AS kind, list_sum(list_transform(s[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS a,
  length(m[i]) AS n, {value.format(p=quoted)} AS v FROM (SELECT doc_id, source, lang, m, s, unnest(range(1, len(m) + 1)) AS i FROM (
  SELECT doc_id, source, lang, regexp_extract_all(coalesce(text, ''), '{quoted}') AS m, regexp_split_to_array(coalesce(text, ''), '{quoted}') AS s FROM documents)) WHERE {keep}"""


ORACLE = f"""
WITH base AS ({_spans_sql(0, ASSIGN, "regexp_extract(m[i], '{p}', 2)", "length(v) >= 6")} UNION ALL {_spans_sql(1, ACCESS, "m[i]", "true")} UNION ALL {_spans_sql(2, HEX, "m[i]", "true")}),
mixed AS (SELECT * FROM ({_spans_sql(3, MIXED, "m[i]", "true")}) c WHERE len(list_distinct(string_split(v, ''))) >= 10 AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9].*[0-9]')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.a < c.a + c.n AND c.a < b.a + b.n)),
held AS (SELECT *, len(list_distinct(string_split(v, ''))) >= 8 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AS live FROM (FROM base UNION ALL FROM mixed)),
own AS (SELECT v, count(DISTINCT coalesce(source, '(none)')) AS owners FROM held GROUP BY v),
spans AS (SELECT doc_id, kind, a, a + n AS e, live AND owners = 1 AS live, owners >= {COPIED} AS copied, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || a || ':' || (a + n) AS x
  FROM held JOIN own USING (v) WHERE kind < 3 OR (live AND owners = 1))
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(x, ',' ORDER BY a, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(x, ',' ORDER BY a, kind), '') AS spans, count(*) FILTER (kind = 3) AS n_owned,
  count(*) FILTER (live) AS n_live, count(*) FILTER (copied) AS n_copied, coalesce(string_agg(x, ',' ORDER BY a, kind) FILTER (live), '') AS live_spans
FROM documents d LEFT JOIN spans s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""


@query("op12_secret_scans", ORACLE)
def op12(spark, sf_dir):
    return find(documents(spark, sf_dir))
