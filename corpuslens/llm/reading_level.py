"""Reading level of a text: the median of five classic grade estimates.

Method.  Fenced code, identifiers, file names and numbers are taken out, as
they are not read as words; headings and list items end a sentence.  Syllables
are vowel groups after hyphenation-style rules on word ends and hiatus (mute
final e, -ed, -es; -ti-, -si-, -ci- before a vowel are one sound, other i and
vowel are two).  Flesch-Kincaid, Gunning fog, SMOG, Coleman-Liau and ARI each
give a school grade, the median is the text's grade, and `BANDS` turn it into
levels 1 (easiest) to 5.

Cost.  Arrow cuts the texts of a batch at white space and numbers the distinct
tokens.  The rules but for two (fences, line ends) never look beyond a token,
so a token's counts are worked out once and kept in a memo of bounded size,
and a text's are the sum of its tokens'.  As Column expressions the
same rules took 1 600 CPU seconds a GB.  Patterns are anchored at the start of
a run of letters, so the time is linear in the text's length even for a
megabyte without a space, and no run or word is too long for a rule.  Nothing
is shuffled (but for a table in fewer files than cores).

Edge cases.  Null, empty and blank texts, and texts without a word, get grade
0 and level 1 with n_words 0, by which they can be filtered.  Accented Latin
letters count as their base letters; two Han characters count as one word of
two syllables and four letters, full-width stops end sentences.  The formulas
are fitted to English, so grades of other languages are comparable within the
language only.  Repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.storage import spread

#: Grades up to which a text has level 1, 2, 3 and 4: early primary, primary, secondary, academic; above: specialist.
BANDS = (3.0, 7.0, 13.0, 21.0)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÀÂÁÃÅäàâáãåÉÈÊËéèêëÍÎÏÌíîïìÖÔÓÒÕöôóòõÜÛÙÚüûùúÇçÑñÿß"
LOWER = "abcdefghijklmnopqrstuvwxyzaaaaaaaaaaaaeeeeeeeeiiiiiiiioooooooooouuuuuuuuccnnys"

FENCE = r"```[\s\S]*?(```|\z)"
#: A line is a heading or an item, and ends a sentence, if it ends in none of these and the next line is blank or begins with one of those.
GOES_ON, ITEM = ".!?:", "-*#"
#: White space that cuts tokens, as the Unicode standard has it.
BLANKS = r"[\t\n\x{B}\f\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: On every token followed by a blank: where a match may start (which keeps Python linear and which RE2 doesn't need), pattern, replacement.
CLEAN = (
    ("A-Za-z0-9_", r"[A-Za-z0-9_]+[.](cpp|hpp|cxx|cc|py|yaml|yml|xml|h|c)([^A-Za-z0-9_])", r" \2"),
    ("A-Za-z0-9_", r"[A-Za-z0-9]*_[A-Za-z0-9_]*([(][)])?", " "),
    ("A-Za-z0-9", r"[A-Za-z0-9]*[a-z0-9][A-Z][A-Za-z0-9]*([(][)])?", " "),
    ("", r"(CWE-)?[0-9][0-9.]*([^0-9.])", r" \2"),
)
SENTENCE = r"[.!?]+[\")\]]* |[。！？]"
HAN = r"[\x{4E00}-\x{9FFF}]"
#: On words in lower case, each between two blanks.
SYLLABLE = (
    (r" ([^aeiouy ]*[aeiouy][a-z]*[^aeiouyl ]|[^aeiouy ]*[aeiouy][a-z]*[aeiouy]l)e ", r" \1 "),
    (r" ([^aeiouy ]*[aeiouy][a-z]*[^aeiouytd ])ed ", r" \1 "),
    (r" ([^aeiouy ]*[aeiouy][a-z]*[^aeiouyszxcgh ])es ", r" \1s "),
    (r"([tsc])i([oaeu])", r"\1\2"),
    (r"i([aou])", r"i-\1"),
)
VOWELS = r"[aeiouy]+"
POLYSYLLABLE = r" [^ aeiouy]*[aeiouy]+[^ aeiouy]+[aeiouy]+[^ aeiouy]+[aeiouy]"

_python = lambda p: re.compile(p.replace(r"\z", r"\Z").replace(r"\x{4E00}-\x{9FFF}", "\u4e00-\u9fff"))
#: Patterns with what a token must hold for them to match.
_CLEAN = [(_python((f"(?<![{at}])" if at else "") + p), r) for at, p, r in CLEAN]
_FILES, _NAMES, _HUMPS, _NUMBERS = _CLEAN
_SYLLABLE = [(_python(p), r, sign) for (p, r), sign in zip(SYLLABLE, ("e ", "ed ", "es ", "i", "i"))]
_FENCE, _SENTENCE, _HAN, _VOWELS, _POLY = map(_python, (FENCE, SENTENCE, HAN, VOWELS, POLYSYLLABLE))
_LATIN, _OTHERS, _DIGIT = re.compile("[a-z]+"), re.compile("[^a-z]+"), re.compile("[0-9]")
_LOWER = str.maketrans(UPPER, LOWER)
COUNTS = ("stops", "han", "latin", "letters", "vowels", "n_polysyllables")


def token_counts(token: str) -> tuple[int, ...]:
    """COUNTS of one token."""
    x = token + " "
    plain = x.isascii()
    rules = ((_FILES, "." in x), (_NAMES, "_" in x), (_HUMPS, not x.islower()), (_NUMBERS, _DIGIT.search(x)))
    for (pattern, replacement), may in rules:
        if may:
            x = pattern.sub(replacement, x)
    stops, han = len(_SENTENCE.findall(x)), 0 if plain else len(_HAN.findall(x))
    x = " " + _OTHERS.sub("  ", x.lower() if plain else x.translate(_LOWER)) + " "
    latin, letters = len(_LATIN.findall(x)), len(x) - x.count(" ")
    for pattern, replacement, sign in _SYLLABLE:
        if sign in x:
            x = pattern.sub(replacement, x)
    return stops, han, latin, letters, len(_VOWELS.findall(x)), len(_POLY.findall(x))


def line_ends(text: str) -> int:
    """Lines that end a sentence without a full stop."""
    if "\n" not in text:
        return 0
    lines = [line.strip(" \t\r") for line in text.split("\n")]
    return sum(1 for a, b in zip(lines, lines[1:]) if a and a[-1] not in GOES_ON and (not b or b[0] in ITEM))


class Tokens:
    """Counts of the tokens seen; forgets all when it holds `bound`, and doesn't keep tokens of more than `longest` characters."""

    def __init__(self, bound: int = 500_000, longest: int = 64) -> None:
        self.bound, self.longest = bound, longest
        self.known: dict[str, tuple[int, ...]] = {}

    def of(self, token: str) -> tuple[int, ...]:
        n = self.known.get(token)
        if n is None:
            n = token_counts(token)
            if len(token) <= self.longest:
                self.known[token] = n
        return n

    def count(self, texts: pa.Array) -> np.ndarray:
        """Texts x COUNTS; the batch is cut and its tokens numbered by Arrow, so each distinct token is looked up once."""
        if len(self.known) > self.bound:
            self.known = {}
        plain = [_FENCE.sub(" ", t) if "```" in t else t for t in pc.fill_null(texts, "").to_pylist()]
        ends = np.fromiter(map(line_ends, plain), np.int64, count=len(plain))
        cut = pc.utf8_split_whitespace(pa.array(plain, pa.large_string()))
        numbered = cut.values.dictionary_encode()
        table = np.array([self.of(t) for t in numbered.dictionary.to_pylist()], np.int64).reshape(-1, len(COUNTS))
        at = numbered.indices.to_numpy()
        n = np.zeros((len(plain), len(COUNTS)), np.int64)
        if len(plain):  # every text has a token, if only the empty one
            for i in range(len(COUNTS)):
                n[:, i] = np.add.reduceat(table[at, i], cut.offsets.to_numpy()[:-1])
        n[:, 0] += ends
        return n


_tokens = Tokens()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a in range(0, whole.num_rows, 2000):
            b = whole.slice(a, 2000)
            n = _tokens.count(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(n[:, i]) for i in range(len(COUNTS)))], names=["id", *COUNTS])


def reading_levels(df: DataFrame, id_col: str, text_col: str, bands: tuple[float, ...] = BANDS) -> DataFrame:
    """(id_col, n_words, n_sentences, n_syllables, n_polysyllables, grade, level) of every row."""
    x = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    x = x.mapInArrow(_count, f"id {x.schema['id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS)).withColumnRenamed("id", id_col)
    half = F.expr("(han + 1) div 2")
    x = x.select(
        id_col,
        (F.col("latin") + half).cast("long").alias("n_words"),
        F.greatest(F.col("stops"), F.lit(1)).cast("long").alias("n_sentences"),
        (F.greatest("latin", "vowels") + F.col("han")).cast("long").alias("n_syllables"),
        F.col("n_polysyllables").cast("long").alias("n_polysyllables"),
        (F.col("letters") + 2 * F.col("han")).cast("double").alias("l"),
    )
    w, s = F.greatest("n_words", F.lit(1)).cast("double"), F.col("n_sentences").cast("double")
    poly = F.col("n_polysyllables").cast("double")
    grades = F.array(
        0.39 * (w / s) + 11.8 * (F.col("n_syllables").cast("double") / w) - 15.59,
        0.4 * (w / s + 100.0 * (poly / w)),
        1.043 * F.sqrt(poly * 30.0 / s) + 3.1291,
        5.88 * (F.col("l") / w) - 29.6 * (s / w) - 15.8,
        4.71 * (F.col("l") / w) + 0.5 * (w / s) - 21.43,
    )
    grade = F.when(F.col("n_words") > 0, F.round(F.element_at(F.sort_array(grades), 3), 6)).otherwise(0.0)
    level = F.lit(1)
    for edge in bands:
        level = level + (F.col("grade") > edge).cast("int")
    return x.select(id_col, "n_words", "n_sentences", "n_syllables", "n_polysyllables", grade.alias("grade")).withColumn("level", level)


def sql(table: str, id_col: str, text_col: str) -> str:
    """The same in SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def chain(x: str, rules) -> str:
        for *_, pattern, replacement in rules:
            x = f"regexp_replace({x}, {q(pattern)}, {q(replacement)}, 'g')"
        return x

    n = lambda x, pattern: f"len(regexp_extract_all({x}, {q(pattern)}))"
    level = " + ".join(["1", *(f"CAST(grade > {e} AS INTEGER)" for e in BANDS)])
    goes_on, item = q(f"[{GOES_ON}]$"), q(f"^[{ITEM.replace('-', '')}-]")
    ends = f"len(list_filter(range(1, len(ls)), lambda i: ls[i] <> '' AND NOT regexp_matches(ls[i], {goes_on}) AND (ls[i + 1] = '' OR regexp_matches(ls[i + 1], {item}))))"
    return f"""
WITH f AS (SELECT {id_col}, regexp_replace(coalesce({text_col}, ''), {q(FENCE)}, ' ', 'g') AS t FROM {table}),
l AS (SELECT {id_col}, t, list_transform(string_split(t, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13))) AS ls FROM f),
a AS (SELECT {id_col}, {ends} AS ends, {chain(f"regexp_replace(t, {q(BLANKS)}, ' ', 'g') || ' '", CLEAN)} AS t FROM l),
b AS (SELECT {id_col}, ends + {n('t', SENTENCE)} AS stops, {n('t', HAN)} AS han, ' ' || regexp_replace(translate(t, '{UPPER}', '{LOWER}'), '[^a-z]+', '  ', 'g') || ' ' AS t FROM a),
c AS (SELECT {id_col}, stops, han, {n('t', '[a-z]+')} AS latin, length(replace(t, ' ', '')) AS letters, {chain('t', SYLLABLE)} AS t FROM b),
d AS (SELECT {id_col}, latin + (han + 1) // 2 AS n_words, greatest(stops, 1) AS n_sentences, greatest(latin, {n('t', VOWELS)}) + han AS n_syllables, {n('t', POLYSYLLABLE)} AS n_polysyllables, CAST(letters + 2 * han AS DOUBLE) AS l, CAST(greatest(latin + (han + 1) // 2, 1) AS DOUBLE) AS w, CAST(greatest(stops, 1) AS DOUBLE) AS s FROM c),
e AS (SELECT {id_col}, n_words, n_sentences, n_syllables, n_polysyllables, CASE WHEN n_words > 0 THEN round(list_sort([
  0.39::DOUBLE * (w / s) + 11.8::DOUBLE * (n_syllables::DOUBLE / w) - 15.59::DOUBLE, 0.4::DOUBLE * (w / s + 100.0::DOUBLE * (n_polysyllables::DOUBLE / w)),
  1.043::DOUBLE * sqrt(n_polysyllables::DOUBLE * 30.0::DOUBLE / s) + 3.1291::DOUBLE, 5.88::DOUBLE * (l / w) - 29.6::DOUBLE * (s / w) - 15.8::DOUBLE,
  4.71::DOUBLE * (l / w) + 0.5::DOUBLE * (w / s) - 21.43::DOUBLE])[3], 6) ELSE 0.0::DOUBLE END AS grade FROM d)
SELECT {id_col}, n_words, n_sentences, n_syllables, n_polysyllables, grade, {level} AS level FROM e"""
