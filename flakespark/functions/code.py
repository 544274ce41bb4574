"""Diffs, code normalisation, tokens and text similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, filled, strip

TOKEN = r"(?U)[{}()\[\];,.<>=!&|+\-*/^%@#]|[^\s{}()\[\];,.<>=!&|+\-*/^%@#]+"
#: Java words that the keyword match looks at.
JAVA_WORDS = [
    "public", "private", "protected", "static", "final", "abstract",
    "class", "interface", "extends", "implements", "import", "package",
    "void", "int", "long", "double", "float", "boolean", "char", "byte",
    "if", "else", "for", "while", "do", "switch", "case", "break",
    "continue", "return", "try", "catch", "finally", "throw", "throws",
    "new", "this", "super", "null", "true", "false",
    "@Test", "@Before", "@After", "@BeforeEach", "@AfterEach",
    "assert", "assertEquals", "assertTrue", "assertFalse", "assertNotNull",
]


def _lines(x: Column | str) -> Column:
    return F.split(F.coalesce(col(x), F.lit("")), "\n", -1)


def _begins(x: Column, *starts: str) -> Column:
    out = F.startswith(x, F.lit(starts[0]))
    for s in starts[1:]:
        out = out | F.startswith(x, F.lit(s))
    return out


def _header(x: Column) -> Column:
    return _begins(x, "@@", "---", "+++", "diff --git", "index ")


def added_lines(diff: Column | str, context: bool = False) -> Column:
    """Added lines of a unified diff without their sign; with context, unchanged lines too."""
    wanted = F.filter(_lines(diff), lambda x: ~_header(x) & (_begins(x, "+", " ") if context else _begins(x, "+")))
    return F.array_join(F.transform(wanted, lambda x: F.substring(x, 2, 1 << 30)), "\n")


def removed_lines(diff: Column | str) -> Column:
    return F.array_join(F.transform(F.filter(_lines(diff), lambda x: ~_header(x) & _begins(x, "-")), lambda x: F.substring(x, 2, 1 << 30)), "\n")


def split_diff(diff: Column | str) -> Column:
    return F.struct(removed_lines(diff).alias("removed"), added_lines(diff).alias("added"))


def changed_region(code: Column | str, diff: Column | str, around: int = 3) -> Column:
    """The code's lines from the first to the last one added by the diff, with lines around them.

    A fold over the diff's lines keeps the new file's line number; whole code if
    nothing is added or either side is empty.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high"))

    def step(acc: Column, x: Column) -> Column:
        state = lambda at, low, high: F.struct(at.cast("int").alias("at"), low.alias("low"), high.alias("high"))
        at, low, high = acc["at"], acc["low"], acc["high"]
        there = F.regexp_extract(x, r"\+(\d+)", 1).try_cast("int") - 1
        plus = _begins(x, "+") & ~_begins(x, "+++")
        still = (_begins(x, "-") & ~_begins(x, "---")) | (_begins(x, "diff", "index") & ~_begins(x, " "))
        return F.when(_begins(x, "@@"), state(F.coalesce(there, at), low, high)).when(plus, state(at + 1, F.least(F.coalesce(low, at), at), F.greatest(F.coalesce(high, at), at))).when(still, acc).otherwise(state(at + 1, low, high))

    found = F.aggregate(_lines(diff), start, step)
    low = F.greatest(found["low"] - around, F.lit(0))
    cut = F.array_join(F.slice(_lines(code), low + 1, F.greatest(found["high"] + around + 1 - low, F.lit(0))), "\n")
    return F.when(filled(diff) & filled(code) & found["low"].isNotNull(), cut).otherwise(col(code))


def normalise_code(code: Column | str) -> Column:
    """Lines stripped, blank ones dropped, all line ends as \\n."""
    x = F.regexp_replace(F.coalesce(col(code), F.lit("")), "\r\n?", "\n")
    return F.array_join(F.filter(F.transform(F.split(x, "\n"), strip), lambda s: s != ""), "\n")


def normalise_diff(diff: Column | str) -> Column:
    """Only the added and removed lines, with their signs, right-stripped."""
    kept = F.filter(_lines(diff), lambda x: ~_begins(strip(x), "```") & ~_header(x) & _begins(x, "+", "-"))
    return F.array_join(F.transform(kept, lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), "\n")


def exact_match(a: Column | str, b: Column | str) -> Column:
    return normalise_code(a) == normalise_code(b)


def tokenize(code: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(col(code), F.lit("")), F.lit(TOKEN), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """All n-token windows; empty if there are fewer tokens."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.slice(tokens, i, n))).otherwise(F.array().cast("array<array<string>>"))


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance over the longer length, 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / F.nullif(longest, F.lit(0)))


def edit_similarity(a: Column | str, b: Column | str) -> Column:
    return edit_ratio(normalise_code(a), normalise_code(b))


def keyword_match(generated: Column | str, truth: Column | str) -> Column:
    """Jaccard similarity of the Java words; without any in the truth 1 if the other has none, else 0.5."""
    words = F.array(*[F.lit(w) for w in JAVA_WORDS])
    a, b = (F.array_intersect(F.array_distinct(tokenize(x)), words) for x in (generated, truth))
    both = F.size(F.array_union(a, b))
    return F.when(F.size(b) == 0, F.when(F.size(a) == 0, 1.0).otherwise(0.5)).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(both, F.lit(0)))


def structure_similarity(generated: Column | str, truth: Column | str) -> Column:
    """Edit similarity of the brackets alone."""
    a, b = (F.regexp_replace(F.coalesce(col(x), F.lit("")), r"[^{}()\[\]]", "") for x in (generated, truth))
    return F.when(b == "", F.when(a == "", 1.0).otherwise(0.5)).otherwise(edit_ratio(a, b))


def balanced(code: Column | str) -> Column:
    """Brackets closed in order, by a fold that keeps the open ones as a string."""
    x = F.split(F.regexp_replace(F.coalesce(col(code), F.lit("")), r"[^{}()\[\]]", ""), "")
    opener = lambda c: F.translate(c, ")]}", "([{")
    step = lambda s, c: F.when(c == "", s).when(c.isin("(", "[", "{"), F.concat(s, c)).when((s != "") & (F.right(s, F.lit(1)) == opener(c)), F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(F.concat(F.lit("!"), s, c))
    return F.aggregate(x, F.lit(""), step) == ""


def valid_syntax(code: Column | str) -> Column:
    """Some text, balanced brackets, and something like a method head."""
    return filled(strip(F.coalesce(col(code), F.lit("")))) & balanced(code) & col(code).rlike(r"(?U)\w+\s*\([^)]*\)\s*\{")


def truth_is_diff(x: Column | str) -> Column:
    return _begins(F.coalesce(col(x), F.lit("")), "@@", "---", "diff --git")


def generated_is_diff(x: Column | str) -> Column:
    """A generated text may also be added lines alone."""
    return _begins(F.coalesce(col(x), F.lit("")), "@@", "+", "diff --git")
