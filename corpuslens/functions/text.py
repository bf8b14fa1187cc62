"""Text functions as Column expressions; none needs Python at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"^\s+|\s+$"


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends (`trim` removes blanks only)."""
    return F.regexp_replace(x, SPACE, "")


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def lines(x: Column) -> Column:
    return F.split(x, "\n")


def filled_lines(x: Column) -> Column:
    return F.filter(lines(x), lambda l: strip(l) != "")


def line_count(x: Column) -> Column:
    """Pieces between line feeds; a trailing line feed counts one more."""
    return F.size(lines(x))


def code_tokens(x: Column) -> Column:
    """Lower-case parts of identifiers: split at underscores and before capitals; one-letter parts and numbers are left out.

    Order and repeats are kept; null gives an empty array.
    """
    raw = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit("[A-Za-z_][A-Za-z0-9_]*|[0-9]+"), F.lit(0))
    split = F.regexp_replace(F.array_join(raw, " "), "([a-z0-9])([A-Z])", "$1 $2")
    parts = F.split(F.lower(F.translate(split, "_", " ")), " +")
    return F.filter(parts, lambda t: (F.length(t) >= 2) & ~t.rlike("^[0-9]+$"))


def numbered_lines(x: Column) -> Column:
    """`L1: ...` and so on."""
    return F.array_join(F.transform(lines(x), lambda l, i: F.concat(F.lit("L"), (i + 1).cast("string"), F.lit(": "), l)), "\n")


def normalised_code(x: Column) -> Column:
    """Without comments and white space, in lower case; what follows a number sign counts as comment too."""
    for pattern in ("//[^\n]*", r"(?s)/\*.*?\*/", "#[^\n]*", r"\s+"):
        x = F.regexp_replace(x, pattern, "")
    return F.lower(x)


def meaningful_lines(x: Column) -> Column:
    """Lines that are not blank and don't begin like a comment."""
    return F.filter(F.transform(lines(x), strip), lambda l: (l != "") & ~l.startswith("//") & ~l.startswith("#") & ~l.startswith("*"))


def line_overlap(a: Column, b: Column) -> Column:
    """Shared distinct filled lines by the larger number of them; 1 if both are empty, 0 if one is."""
    x, y = (F.array_distinct(F.transform(filled_lines(F.coalesce(c, F.lit(""))), strip)) for c in (a, b))
    most = F.greatest(F.size(x), F.size(y))
    return F.when(most == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.when(most == 0, 1).otherwise(most))


def unfenced(x: Column) -> Column:
    """Text inside a Markdown code fence if it begins with one, else the stripped text."""
    t = strip(x)
    inner = F.regexp_replace(F.regexp_replace(t, "^```[^\n]*\n?", ""), r"\n?```\s*$", "")
    return F.when(t.startswith("```"), inner).otherwise(t)


def json_object(x: Column) -> Column:
    """The JSON object in a model's answer as text: the whole of it, else from the first to the last brace; null if neither parses."""
    whole = unfenced(x)
    inner = F.regexp_extract(whole, r"(?s)\{.*\}", 0)
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull() & c.rlike(r"(?s)^\s*\{"), c)
    return F.coalesce(valid(whole), valid(F.nullif(inner, F.lit(""))))


#: The facets of a knowledge answer.
FACETS = ("functional_semantics", "root_cause", "trigger_condition", "fix_pattern")


def knowledge_facets(answer: Column) -> Column:
    """Struct of the four facets of a model's answer, stripped; null unless all four are texts that aren't blank."""

    def facets(v: Column) -> Column:
        text = lambda f: F.when(F.schema_of_variant(v[f]) == "STRING", F.nullif(strip(F.try_variant_get(v[f], "$", "string")), F.lit("")))
        return F.struct(*(text(f).alias(f) for f in FACETS))

    # a lambda's argument is worked out once, however often it is used
    parsed = F.transform(F.array(json_object(answer)), lambda j: F.from_json(j, ", ".join(f"{f} variant" for f in FACETS)))
    whole = F.filter(F.transform(parsed, facets), lambda s: s[FACETS[0]].isNotNull() & s[FACETS[1]].isNotNull() & s[FACETS[2]].isNotNull() & s[FACETS[3]].isNotNull())
    return F.get(whole, F.lit(0))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x within the bounds, null if it is null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def case_line(i: Column, cwe: Column, repo: Column, text: Column, width: int = 200) -> Column:
    """One line on a retrieved case."""
    return F.concat(F.lit("Case "), i.cast("string"), F.lit(" ["), F.coalesce(cwe, F.lit("?")), F.lit(", "), F.coalesce(repo, F.lit("?")), F.lit("]: "), F.left(F.coalesce(text, F.lit("")), F.lit(width)))


def bucket(x: Column, seed: str = "", size: int = 100) -> Column:
    """Reproducible bucket of a string: first 32 bits of its md5 modulo `size`."""
    return (F.conv(F.left(F.md5(F.concat(F.lit(seed), x)), F.lit(8)), 16, 10).cast("bigint") % size).cast("int")
