"""Text expressions. Java needs (?U) for a Unicode \\w; family A and family B patterns differ on purpose."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _any(words: str) -> str:
    """A regular expression for any of the words in a string; ~ stands for white space."""
    return "(?:" + "|".join(w.replace("~", r"\s+") for w in sorted(words.split(), key=lambda w: (-len(w), w))) + ")"


_DECLARES = "fn func impl enum class trait struct function interface def async~def use package import from #include"
A_TOKEN = r"(?U)[A-Za-z_][A-Za-z0-9_]*|\d+|[^\w\s]"
A_IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_.:-]*"
A_STRUCTURE = r"^\s*" + _any(_DECLARES + " export~class export~function export~default~class export~default~function") + r"\b"
A_ERROR = "(?i)" + _any("fatal panic error failed assert failure warning assertion exception traceback caused[~]by segmentation[~]fault").replace(r"[\s+]", " ") + r"\b"
B_TOKEN = r"(?U)[A-Za-z_][A-Za-z0-9_./:-]*|\d+|[^\w\s]"
B_WORD = r"[A-Za-z_][A-Za-z0-9_.:/-]*|\d+"
B_IDENTIFIER = r"\b[A-Za-z_][A-Za-z0-9_]{2,}\b"
B_ERROR = r"(?i)\b" + _any("fatal panic error failed failure warning segfault assertion exception traceback") + r"\b"
B_FRAME = r'^\s*(?:at\s+\S+.*:\d+|File\s+"[^"]+",\s+line\s+\d+)'
B_DIFF = r"^(?:@@ |--- |\+\+\+ |-[^-]|\+[^+]|index [0-9a-f]+|diff --git)"
B_STRUCTURE = r"^\s*" + _any(_DECLARES + " namespace module") + r"\b"
B_TEST = r"(?i)(?:AssertionError|\d+\s+failed\b|\b(?:ERROR|FAILED)\b|=+\s+(?:short test summary|ERRORS|FAILURES))"
B_TREE = r"^(?:[.A-Za-z0-9_-]+/|[│├└─ ]{2,})\S*"
SUFFIXES = "c h cc go js py rb rs sh ts cpp hpp jsx php tsx java"
_SUFFIX = _any(SUFFIXES)
B_LOCATION = r"[A-Za-z0-9_./-]+\." + _SUFFIX
B_PATH = r"(?:^|[\s\"'`(])((?:\.{0,2}/)?[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+|[A-Za-z0-9_.-]+\." + _any(SUFFIXES + " json toml yaml yml") + ")"
COUNTED = r"(?U)\w+|[^\w\s]"
A_WORD = r"(?U)[A-Za-z_][A-Za-z0-9_]*|\d+"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
STOPWORDS = sorted("cd the and are for not sed cat bash code file from have into that this with your output".split())
REASONS = {"error": B_ERROR, "trace-frame": B_FRAME, "diff": B_DIFF, "structure": B_STRUCTURE, "source-location": B_LOCATION, "test-failure": B_TEST}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once a row, also where body names it often or within a lambda (there a plain column is worked out anew for each element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_lines(text: Column) -> Column:
    """The lines as an array: ten terminators and CRLF end a line, and a last empty one doesn't count. Null for a null."""
    return let(F.split(text, LINE_END, -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def extract(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def tokenize(text: Column) -> Column:
    """Lower-case identifiers, numbers and punctuation marks."""
    return F.transform(extract(text, A_TOKEN), F.lower)


def identifiers(text: Column) -> Column:
    """Distinct lower-case identifiers of more than one character, with dots, colons and dashes in them."""
    return F.array_distinct(F.transform(F.filter(extract(text, A_IDENTIFIER), lambda x: F.length(x) > 1), F.lower))


def word_tokens(text: Column) -> Column:
    """tokenize() without the punctuation marks."""
    return F.transform(extract(text, A_WORD), F.lower)


def is_term(word: Column) -> Column:
    return (F.length(word) > 1) & ~word.isin(STOPWORDS) & ~word.rlike(r"^\d+$")


def terms(text: Column) -> Column:
    """Lower-case words of more than one character that are neither numbers nor stop words; repeats stay."""
    return F.filter(F.transform(extract(text, B_WORD), F.lower), is_term)


def term_set(text: Column) -> Column:
    return F.array_distinct(terms(text))


def strict_identifiers(text: Column) -> Column:
    """Distinct lower-case identifiers of three characters or more, without stop words."""
    return F.array_distinct(F.filter(F.transform(extract(text, B_IDENTIFIER), F.lower), lambda x: ~x.isin(STOPWORDS)))


def extract_paths(text: Column) -> Column:
    """Distinct paths, in their order."""
    return F.array_distinct(F.filter(F.transform(extract(text, B_PATH, 1), lambda x: F.btrim(x, F.lit(".,:;"))), lambda x: x != ""))


def path_terms(path: Column) -> Column:
    """Distinct lower-case parts of a path's segments, split at punctuation and camel humps."""
    humps = F.regexp_replace(F.coalesce(path, F.lit("")), r"(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.array_distinct(F.filter(F.split(F.lower(humps), r"[^a-z0-9]+"), lambda x: F.length(x) > 1))


def token_estimate_lexical(text: Column) -> Column:
    return F.regexp_count(text, F.lit(B_TOKEN))


def token_estimate_counted(text: Column) -> Column:
    return F.regexp_count(text, F.lit(COUNTED))


def token_estimate_max(text: Column) -> Column:
    """The larger of the lexical count and a quarter of the ASCII characters plus all others."""
    ascii_ = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return F.greatest(token_estimate_lexical(text).cast("bigint"), (F.ceil(ascii_ / 4.0) + F.length(text) - ascii_).cast("bigint"))


def overlap_fraction(left: Column, right: Column) -> Column:
    """|A and B| / sqrt(|A| |B|), 0 if either is empty."""
    size = F.sqrt(F.size(left).cast("double") * F.size(right))
    return F.when(size > 0, F.size(F.array_intersect(left, right)) / size).otherwise(0.0)


def line_reasons(line: Column) -> Column:
    """Why a line is evidence: the names of the patterns that it matches, in a fixed order."""
    return F.array_compact(F.array(*(F.when(line.rlike(p), F.lit(n)) for n, p in REASONS.items())))


def build_query(query: Column, path: Column, recent: Column) -> Column:
    """Query, recent context, file name and stem."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.concat_ws(" ", query, recent, F.nullif(name, F.lit("")), F.nullif(stem, F.lit("")))


def slug(value: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(value.cast("string")), "[^a-z0-9]+", "-"), F.lit("-"))


def fingerprint(*fields: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x00", *fields), 256), 1, 16)


def tree_depth(line: Column) -> Column:
    """Depth by branch glyphs or indentation of four; tabs count as four."""
    lead = F.replace(F.regexp_extract(line, r"^([\s│|├└─`+\\-]*)", 1), F.lit("\t"), F.lit("    "))
    return F.floor(F.length(lead) / 4).cast("bigint")
