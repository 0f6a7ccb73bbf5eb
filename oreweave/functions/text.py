"""Text expressions. Every function takes and returns a ``Column`` and stays in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from oreweave import constants as K

# Unicode white space plus the four separators Python's str.split() also treats as blanks.
SPACE = r"[\s\x1c-\x1f]"
BLANK_CHARS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# str.splitlines() boundaries, the two-character one first.
LINE_BREAKS = ("\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")
FORM_FEED = "\f"


def collapse_ws(text: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(text, f"(?U){SPACE}+", " "))


def py_strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANK_CHARS))


def split_lines(text: Column) -> Column:
    """Array of lines without a trailing empty element."""
    for mark in LINE_BREAKS:
        text = F.replace(text, F.lit(mark), F.lit("\n"))
    lines = F.split(text, "\n", -1)
    # a final break leaves one empty element at the end
    return F.get(
        F.transform(
            F.array(lines),
            lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, F.lit(1), F.size(x) - 1)).otherwise(x),
        ),
        F.lit(0),
    )


def split_pages(text: Column) -> Column:
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, FORM_FEED, -1))


def clean_name(name: Column) -> Column:
    return collapse_ws(F.translate(name, "–—", "--"))


def normalize_name(name: Column) -> Column:
    return F.lower(clean_name(name))


def query_terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(K.QUERY_TOKEN_PATTERN), F.lit(0))


def word_tokens(text: Column) -> Column:
    """Lower-case runs of two or more word characters (the TF-IDF tokenizer)."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def with_bigrams(tokens: Column) -> Column:
    """Unigrams followed by bigrams joined by a blank."""
    size = F.size(tokens)
    pairs = F.zip_with(
        F.slice(tokens, F.lit(1), F.greatest(size - 1, F.lit(0))),
        F.slice(tokens, F.lit(2), F.greatest(size - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.when(size < 2, tokens).otherwise(F.concat(tokens, pairs))


def snippet(text: Column, needle: Column, window: int = K.SNIPPET_WINDOW, at: Column | None = None) -> Column:
    """Window of text around the first case-insensitive hit, or the head of the text.

    ``at`` is the place of the hit, from 1, where it is known."""
    half = window // 2
    pos = (F.instr(F.lower(text), F.lower(needle)) if at is None else at) - 1
    start = F.greatest(F.lit(0), pos - half)
    end = F.least(F.length(text), pos + F.length(needle) + half)
    around = py_strip(F.substring(text, start + 1, end - start))
    return F.when(pos < 0, F.substring(text, 1, window)).otherwise(around)


def strip_tags(markup: Column) -> Column:
    return collapse_ws(F.regexp_replace(markup, "<[^>]+>", " "))


def camel_label(entity_type: Column) -> Column:
    label = F.replace(F.initcap(F.regexp_replace(entity_type, "[^A-Za-z0-9]+", " ")), F.lit(" "), F.lit(""))
    return F.when(label == "", "Term").otherwise(label)


def sanitize_filename(name: Column) -> Column:
    joined = F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}_.\-]+", "_"), "_+", "_")
    out = F.substring(F.regexp_replace(joined, r"\A[._]+|[._]+\z", ""), 1, 180)
    return F.when(out == "", "document").otherwise(out)


def search_key(text: Column) -> Column:
    """Letters and digits only, lower case, single blanks: the form query terms are matched in."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-zа-я0-9]+", " "))


def parse_list(value: Column) -> Column:
    """``"Fe,Cr Ni"`` -> array of names."""
    return F.filter(F.split(F.coalesce(value, F.lit("")), r"[,\s]+"), lambda x: x != "")


def one_decimal(value: Column) -> Column:
    """One decimal place, ties to even."""
    return F.format_string("%.1f", F.bround(value, 1))


def human_size(num_bytes: Column) -> Column:
    size = num_bytes.cast("double")
    steps = [("KB", 1024.0), ("MB", 1024.0**2), ("GB", 1024.0**3)]
    out = F.when(size < 1024, F.concat(num_bytes.cast("bigint").cast("string"), F.lit(" B")))
    for unit, scale in steps[:-1]:
        out = out.when(size < scale * 1024, F.concat(one_decimal(size / scale), F.lit(f" {unit}")))
    unit, scale = steps[-1]
    return out.otherwise(F.concat(one_decimal(size / scale), F.lit(f" {unit}")))


def explode_if(value: Column, test) -> Column:
    """Generator that yields ``value`` when it passes ``test``.

    A filter on a computed column is pushed below the projection and computes it again; a
    generator is evaluated once.
    """
    return F.explode(F.filter(F.array(value), test))


def any_contains(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


def count_contains(text: Column, words: Sequence[str]) -> Column:
    """How many of the words occur at least once."""
    out = F.lit(0)
    for word in words:
        out = out + F.contains(text, F.lit(word)).cast("int")
    return out


def count_occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a non-empty word."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / F.lit(len(word))).cast("int")


def literal_map(values: Mapping[str, str]) -> Column:
    flat = [F.lit(x) for pair in values.items() for x in pair]
    return F.create_map(*flat)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def source_type(path: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(K.SOURCE_TYPE_BY_EXTENSION), extension(path)), F.lit("unknown"))


def plant_from_path(path: Column) -> Column:
    """Plant name from a workbook path: the first matching rule on the stem, else the folder."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    parent = F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))
    return (
        F.when(F.contains(stem, F.lit("КГМК")), "КГМК")
        .when(F.contains(stem, F.lit("Вкр")) | F.contains(stem, F.lit("вкр")), "НОФ Вкр")
        .when(F.contains(F.lower(stem), F.lit("мед")), "НОФ мед")
        .when(F.contains(stem, F.lit("ТОФ")), "ТОФ")
        .otherwise(parent)
    )


def cell_label(value: Column) -> Column:
    """Workbook cell label: the unit is dropped and blanks are collapsed."""
    return collapse_ws(F.replace(F.coalesce(value, F.lit("")), F.lit("мкм"), F.lit("")))


def cell_number(value: Column) -> Column:
    """Numeric cell or null; NaN counts as missing."""
    number = F.expr("try_cast(NULL as double)") if value is None else value.try_cast("double")
    return F.when(F.isnan(number), F.lit(None)).otherwise(number)


# Formula lines -----------------------------------------------------------------------------


def _has_any(text: Column, parts: Sequence[str]) -> Column:
    return any_contains(text, parts)


def is_chemical(line: Column) -> Column:
    words = F.size(F.filter(F.split(line, " "), lambda w: w != ""))
    return F.rlike(line, F.lit(f"(?U){K.FORMULA_PATTERN}")) & (
        _has_any(line, ["+", "-", "·", "(", ")", "[", "]"]) | (words <= 8)
    )


def is_equation(line: Column) -> Column:
    compact = F.replace(line, F.lit(" "), F.lit(""))
    return (
        F.rlike(line, F.lit(f"(?U){K.MATH_OPERATOR_PATTERN}"))
        & F.rlike(line, F.lit(K.MATH_LETTER_PATTERN))
        & (F.length(compact) >= 5)
        & F.rlike(compact, F.lit(r"[=+\-*/^_()\[\]{}<>≈≤≥→←]"))
        & (F.regexp_count(compact, F.lit(r"[\p{L}\p{N}]")) >= 3)
    )


def formula_kind(line: Column) -> Column:
    return (
        F.when(~F.length(line).between(3, 280), F.lit(None))
        .when(is_chemical(line), "chemical_formula")
        .when(is_equation(line), "equation")
    )


def formula_confidence(line: Column, kind: Column) -> Column:
    score = (
        F.lit(0.55)
        + F.when(F.contains(line, F.lit("=")), 0.2).otherwise(0.0)
        + F.when(_has_any(line, ["≈", "≤", "≥", "→", "<-", "->"]), 0.1).otherwise(0.0)
        + F.when(kind == "chemical_formula", 0.15).otherwise(0.0)
    )
    return F.least(score, F.lit(0.95))


def normalize_formula(line: Column) -> Column:
    return collapse_ws(F.translate(line, "−–—×·", "---*."))


def table_cells(line: Column) -> Column:
    """Cells of an aligned text line; an empty array when the line is not a table row."""
    body = py_strip(line)
    cells = F.filter(
        F.transform(F.split(body, rf"(?U){SPACE}{{2,}}"), lambda c: py_strip(c)), lambda c: c != ""
    )
    numeric = F.exists(cells, lambda c: F.rlike(c, F.lit(r"\p{Nd}")))
    keep = (F.size(cells) >= 2) & (numeric | (F.size(cells) >= 3))
    return F.when(keep, cells).otherwise(F.array().cast("array<string>"))


# Text quality ------------------------------------------------------------------------------


def ocr_quality(text: Column, pages: Column) -> Column:
    """Coarse 0..1 reading-quality score: density, share of informative characters, line length."""
    compact = F.regexp_replace(text, f"(?U){SPACE}+", "")
    chars = F.length(compact)
    density = F.least(chars / F.greatest(F.lit(900), pages * 900), F.lit(1.0))
    informative = F.length(F.regexp_replace(compact, r"[^\p{L}\p{N}=+\-*/%.,;:()\[\]{}<>]", ""))
    lines = F.greatest(F.lit(1), F.size(F.filter(split_lines(text), lambda x: py_strip(x) != "")))
    line_length = F.least(chars / lines / 45, F.lit(1.0))
    score = 0.50 * density + 0.35 * (informative / F.greatest(F.lit(1), chars)) + 0.15 * line_length
    return F.when(chars == 0, F.lit(0.0)).otherwise(F.bround(F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))), 3))


def needs_ocr_assist(
    status: Column,
    text: Column,
    quality: Column,
    min_chars: int = K.OCR_MIN_CHARS,
    threshold: float = K.OCR_QUALITY_THRESHOLD,
) -> Column:
    return (
        (status != "completed")
        | (F.length(py_strip(F.coalesce(text, F.lit("")))) < min_chars)
        | (F.coalesce(quality, F.lit(0.0)) < threshold)
    )


def merge_ocr_text(existing: Column, ocr: Column) -> Column:
    base = py_strip(F.coalesce(existing, F.lit("")))
    ocr_body = py_strip(ocr)
    return F.when(F.length(base) < K.OCR_REQUIRED_BELOW_CHARS, ocr_body).otherwise(
        F.concat(base, F.lit("\n\nExtracted OCR fallback text:\n"), ocr_body)
    )


def ocr_languages(codes: Column) -> Column:
    """``rus+eng`` -> ``[ru, en]``, unknown codes dropped, ``[en]`` when nothing is left."""
    names = literal_map(K.OCR_LANGUAGE_CODES)
    mapped = F.array_distinct(
        F.array_compact(F.transform(F.split(F.lower(codes), r"[+,\s]+"), lambda c: F.try_element_at(names, c)))
    )
    return F.when(F.size(mapped) == 0, F.array(F.lit("en"))).otherwise(mapped)


def extract_json_object(text: Column) -> Column:
    """JSON text of a noisy provider answer: the whole answer, else its outermost braces."""
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(text).isNotNull(), text).when(
        (braces != "") & F.try_parse_json(braces).isNotNull(), braces
    )


def first_number_above(text: Column, floor: float = 10.0) -> Column:
    """First blank-separated token that is a finite number above ``floor``."""
    tokens = F.split(F.replace(text, F.lit(","), F.lit(".")), f"(?U){SPACE}+")
    numeric = F.filter(tokens, lambda t: F.rlike(t, F.lit(r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z")))
    return F.get(F.filter(F.transform(numeric, lambda t: t.try_cast("double")), lambda v: v > floor), F.lit(0))
