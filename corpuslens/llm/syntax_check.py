"""Source files that are not valid syntax of their language.

The text is cut into tokens (C and C++ after preprocessing with no macro
defined) and parsed with derivatives, see ``derivatives``.  The verdict is
`ok`; `invalid`, with the token and the line at which no continuation exists;
or `truncated` if the text is valid as far as it goes but stops too early.

``by_grammar`` writes all tokens out and gives up beyond the bounds in
``c_syntax`` and ``derivatives``, as corpus text must not be able to hold up a
worker.  ``settle`` decides what it leaves: macros are built once and shared,
and a shared run of tokens is parsed once for each state it is met in, so it
doesn't matter how many tokens they give.  What exceeds the bounds there too
stays `unchecked`.  That is a failure and no verdict: ``damaged`` raises at such
a record, and ``syntax_rates`` counts it apart.

The grammar decides.  Python's own parser is asked afterwards as an exact check
of Python texts; what it refuses of what the grammar takes is `invalid`, what
it takes of what the grammar refuses is `ok`.  On the tests (the standard
library, mutations of it, the snippets) neither happens; ``by_grammar`` gives
the verdict without that check.  Where Python's parser fails for want of stack
or over the digits of a number it has no opinion, and the grammar's verdict
stands.

Cost and skew.  Texts are checked where they are read, one at a time; nothing
is shuffled but the rows of the verdict.  Each worker process keeps one
automaton per language, whose size is bounded.

Edge cases.  Null and blank texts, and languages that have no grammar here,
get the verdict null.  Rows that repeat an id and its text give one row.
Nesting of any depth is parsed; Python's own limits (200 brackets, 100 levels
of indentation) are part of that language.  A failing token beyond the range of
an int, which macros can give, is null; its line is given.
Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import c_syntax, python_syntax
from corpuslens.llm.derivatives import Grammar, TooMuchWork
from corpuslens.storage import spread

#: Spellings of the languages that have a grammar.
FAMILIES = {"c": "c", "c++": "c", "cpp": "c", "cxx": "c", "py": "python", "python": "python", "python3": "python"}

_grammars: dict[str, Grammar] = {}


def _grammar(family: str) -> Grammar:
    if family not in _grammars:
        _grammars[family] = c_syntax.CGrammar() if family == "c" else python_syntax.PythonGrammar()
    return _grammars[family]


def by_grammar(code: str, family: str) -> tuple[str, int | None, int | None]:
    """(verdict, token, line) of one text by its derivatives; token and line only if it is flagged."""
    try:
        kinds, lines, whole = (c_syntax if family == "c" else python_syntax).tokens(code)
        v = _grammar(family).parse(kinds)
    except TooMuchWork:
        return "unchecked", None, None
    if v.ok and whole:
        return "ok", None, None
    at = v.token if not v.ok else len(kinds) - 1
    # a text that can't be cut to its end stops too early if all but the broken last token fits and brackets or quotes are open
    early = not whole and at >= len(kinds) - 1 and family == "python" and python_syntax.is_open(code, kinds[:-1])
    return "truncated" if v.truncated or early else "invalid", at, lines[min(at, len(lines) - 1)] if lines else 1


def check(code: str | None, language: str | None) -> tuple[str | None, int | None, int | None]:
    """(verdict, token, line) of one text; token and line only if it is flagged."""
    family = _family(code, language)
    if family is None:
        return None, None, None
    verdict, token, line = by_grammar(code, family)
    if family == "python":
        refused = _python_error(code)
        if isinstance(refused, NoOpinion):
            return verdict, token, line
        if refused is None:
            return "ok", None, None
        if verdict in ("ok", "unchecked"):
            lines, line = python_syntax.tokens(code)[1], getattr(refused, "lineno", None) or 1
            return "invalid", next((i for i, n in enumerate(lines) if n >= line), max(0, len(lines) - 1)), line
    return verdict, token, line


def settle(code: str | None, language: str | None) -> tuple[str | None, int | None, int | None]:
    """(verdict, token, line) as ``check`` gives them, of texts that it leaves unchecked too."""
    family, found = _family(code, language), check(code, language)
    if found[0] != "unchecked":
        return found
    grammar = _grammar(family)
    # an attempt to parse that was given up must not help the next one, or copies of a text get different verdicts
    if family == "python" or _written_out(code):  # derivatives take the same steps over shared runs
        grammar.rebuild()
        return found
    try:
        parts, lines, _ = c_syntax.tokens(code, shared=True)
        v, part = grammar.parse_shared(parts)
    except TooMuchWork:
        grammar.rebuild()
        return found
    if v.ok:
        return "ok", None, None
    return "truncated" if v.truncated else "invalid", v.token if v.token < 1 << 31 else None, lines[min(part, len(lines) - 1)]


def _written_out(code: str) -> bool:
    """Whether the macros of a text are within the bound of their tokens."""
    try:
        c_syntax.tokens(code)
    except TooMuchWork:
        return False
    return True


def _family(code: str | None, language: str | None) -> str | None:
    """The grammar of a text, None if there is nothing to check."""
    return None if code is None or not code.strip() else FAMILIES.get((language or "").strip().lower())


class NoOpinion(Exception):
    """Python's parser failed without a word on the syntax."""


def _python_error(code: str) -> Exception | None:
    """What Python's parser has against the text."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(code)
    except (RecursionError, MemoryError) as e:
        return NoOpinion(e)
    except (SyntaxError, ValueError) as e:
        return NoOpinion(e) if "integer string conversion" in str(e) else e
    return None


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [settle(code, language) for language, code in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        cols = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], names=["id", "repo", "language", "verdict", "token", "line"])


def check_syntax(df: DataFrame, id_col: str, code_col: str, language_col: str, repo: Column | None = None) -> DataFrame:
    """(id, repo, language, verdict, token, line) of every record, distinct."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), (F.lit(None) if repo is None else repo).cast("string").alias("repo"), F.col(language_col).alias("language"), F.col(code_col).alias("code"))
    return spread(rows).mapInArrow(_run, "id string, repo string, language string, verdict string, token int, line int").distinct()


def damaged(checked: DataFrame) -> DataFrame:
    """The records that are not valid; raises at one that could not be checked, which is neither in nor out."""
    failed = F.concat(F.lit("syntax of record "), F.coalesce("id", F.lit("null")), F.lit(" could not be checked within the bounds; p6_files lists such records as unchecked"))
    return checked.where(F.when(F.col("verdict") == "unchecked", F.raise_error(failed).cast("boolean")).otherwise(F.col("verdict") != "ok"))


def syntax_rates(checked: DataFrame) -> DataFrame:
    """(repo, language, files, invalid, truncated, damaged_rate, unchecked); language is trimmed and in lower case.

    files and the rate are of the files with a verdict, the rate null if there are none; unchecked counts those that could not be checked.
    """
    n = lambda v: F.count_if(F.col("verdict") == v)
    files = F.count_if(F.col("verdict") != "unchecked").alias("files")
    x = checked.where("verdict is not null").groupBy("repo", F.lower(F.trim("language")).alias("language")).agg(files, n("invalid").alias("invalid"), n("truncated").alias("truncated"), n("unchecked").alias("unchecked"))
    rate = F.when(F.col("files") > 0, (F.col("invalid") + F.col("truncated")) / F.col("files")).alias("damaged_rate")
    return x.select("repo", "language", "files", "invalid", "truncated", rate, "unchecked")
