"""Name expressions. Every function takes and returns a Column and stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions import tables as T

# (?U): names may hold non-ASCII spaces
_SPACE = r"(?U)\s"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_name(c: Column) -> Column:
    """Lower case, tags dropped, letters and digits only."""
    untagged = F.regexp_replace(F.lower(c), _SPACE + r"*[\[\(][^\]\)]*[\]\)]", "")
    return F.regexp_replace(untagged, "[^a-z0-9]", "")


def extract_base(c: Column) -> Column:
    """Text before the first opening bracket of either kind."""
    return strip(F.regexp_replace(c, _SPACE + r"*[\[\(].*", ""))


def extract_base_name(c: Column) -> Column:
    """Text before the first ``(``; the whole name when it starts with one."""
    return strip(F.when(c.startswith("("), c).otherwise(F.regexp_extract(c, r"^([^(]+)", 1)))


def variant_base(c: Column) -> Column:
    """Every ``(...)`` dropped, lower case: equal for regional variants of one set."""
    return F.lower(strip(F.regexp_replace(c, r"(?U)\s*\([^)]*\)\s*", " ")))


def clean_base(c: Column) -> Column:
    """Lower-case base reduced to letters, digits and spaces."""
    return strip(F.regexp_replace(F.lower(extract_base(c)), "[^a-z0-9 ]", ""))


def extract_tags(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"[\[\(]([^\]\)]+)[\]\)]"), F.lit(1)))


def extract_region(c: Column) -> Column:
    return F.regexp_extract(c, r"\(([^)]+)\)", 1)


def expand_regions(c: Column) -> Column:
    """``(U)`` -> ``(USA)`` and so on; an expanded tag is never a code again, so order is free."""
    for code, region in T.REGION_CODES.items():
        if code != region:
            c = F.replace(c, F.lit(f"({code})"), F.lit(f"({region})"))
    return c


def drop_square_tags(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s*\[.*?\]", ""))


def clean_tags(c: Column) -> Column:
    """Regions expanded and square-bracket tags dropped."""
    return drop_square_tags(expand_regions(c))


def clean_collection_name(c: Column) -> Column:
    remarks = "|".join([*T.CATALOG_REMARKS, T.CATALOG_STAMP])
    return strip(F.regexp_replace(c, rf"(?U)\s*\((?:{remarks})\)", ""))


def split_vendor(c: Column) -> Column:
    """struct(vendor, rest), cut at the first `` - ``; vendor is '' when there is none."""
    parts = F.split(c, " - ", 2)
    two = F.size(parts) == 2
    return F.struct(
        F.when(two, strip(parts[0])).otherwise("").alias("vendor"),
        F.when(two, strip(F.try_element_at(parts, F.lit(2)))).otherwise(strip(c)).alias("rest"),
    )


def _alias_map() -> Column:
    known: dict[str, str] = {}
    for canon, spellings in T.COLLECTION_ALIASES.items():
        for spelling in [*spellings, canon]:
            known.setdefault(spelling, canon)
    return F.create_map(*[F.lit(x) for pair in known.items() for x in pair])


def canonicalize(c: Column) -> Column:
    """Key of the alias row holding this spelling, NULL when unknown."""
    return F.try_element_at(_alias_map(), strip(F.lower(c)))


def tokenize(c: Column) -> Column:
    kept = F.regexp_replace(c, r"\b(?:" + "|".join(T.NOISE_WORDS) + r")\b", "")
    return F.array_distinct(F.filter(F.split(kept, r"(?U)[\s\-/]+"), lambda t: F.length(t) > 1))


def word_windows(c: Column) -> Column:
    """All substrings bounded on both sides by an end of the text or one of space - , :

    A word-bounded containment test then is plain equality with one of the windows, so it can
    run as an equi-join instead of a pattern match over pairs. A text with k such characters has at
    most (k + 1)(k + 2) / 2 windows; this is meant for names.
    """
    edge = r"[\s\-,:]"

    def windows(parts):
        # what begins at one part and ends with each later one; every part but the first begins with its separator
        def begun(i):
            return F.transform(F.sequence(i, F.size(parts)), lambda j: F.array_join(F.slice(parts, i, j - i + 1), ""))

        def inner(i):
            return F.transform(begun(i), lambda x: F.substring(x, F.lit(2), F.length(x)))

        first = F.when(c.rlike(f"(?U)^{edge}"), F.concat(begun(F.lit(1)), inner(F.lit(1)))).otherwise(begun(F.lit(1)))
        later = F.when(F.size(parts) > 1, F.flatten(F.transform(F.sequence(F.lit(2), F.size(parts)), inner))).otherwise(none)
        return F.array_remove(F.array_distinct(F.concat(first, later)), "")

    none = F.array().cast("array<string>")
    # the text is cut once, and its parts are handed in as a variable: an outer expression would be evaluated again for each part
    parts = F.split(c, f"(?U)(?={edge})")
    return F.when(F.length(c) > 0, F.element_at(F.transform(F.array(parts), windows), 1)).otherwise(none)


def word_match(needle: Column, hay: Column) -> Column:
    """Whether ``needle`` stands in ``hay`` between word bounds: one pattern a row, no list of windows."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.rlike(hay, F.concat(F.lit(r"(?:^|[\s\-,:])"), quoted, F.lit(r"(?:\z|[\s\-,:])")))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(c: Column) -> Column:
    """Lower-case suffix with its dot; '' for names without one and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(c, r"[^/](\.[^./]+)$", 1))


def stem(c: Column) -> Column:
    name = base_name(c)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def member_type(c: Column) -> Column:
    """Suffix without its dot."""
    return F.substring(extension(c), 2, 1 << 20)


def package_name(set_name: Column, unmatched: Column | None = None) -> Column:
    named = F.concat(set_name, F.lit(".zip"))
    return named if unmatched is None else F.when(unmatched, "").otherwise(named)


# Letters and digits, roughly rarest first. Any order is correct; a rare-first one makes the
# lowest bits of a mask the most selective ones.
MASK_LETTERS = "qzxj0987654321vkwyfbghmpucdlnstroiae"


def char_mask(c: Column) -> Column:
    """36-bit set of the letters and digits of a normalised name; bit 0 is the rarest letter."""
    return F.aggregate(
        F.split(c, ""), F.lit(0).cast("bigint"),
        lambda mask, letter: mask.bitwiseOR(F.coalesce(
            F.call_function("shiftleft", F.lit(1).cast("bigint"), F.nullif(F.instr(F.lit(MASK_LETTERS), letter), F.lit(0)) - 1),
            F.lit(0).cast("bigint"))),
    )
