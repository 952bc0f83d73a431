"""Scalar functions of the engine as Column expressions; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Our own tag of the content-address layout.
HASH_TAG = "loom1"
_WORD = r"[\p{L}\p{N}_]+"
_SIGN = r"[^\p{L}\p{N}_]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize(text: Column | str) -> Column:
    """No byte-order mark, LF line ends, no blanks before them, exactly one line end at the end. Null for null."""
    s = F.regexp_replace(_c(text), "^\ufeff", "")
    s = F.regexp_replace(s, "\r\n?", "\n")
    s = F.regexp_replace(s, "[ \t]+(?=\n|\\z)", "")
    return F.concat(F.regexp_replace(s, "\n+\\z", ""), F.lit("\n"))


def content_hash(kind: Column | int, lang: Column | str | None, text: Column | str) -> Column:
    """SHA-256 over tag, kind and language, each ended by a zero byte, and the normalised text, as hex."""
    zero = F.unhex(F.lit("00"))
    k = F.lit(kind) if isinstance(kind, int) else kind
    code = F.unhex(F.lpad(F.hex(k), 2, "0"))
    language = F.coalesce(_c(lang) if lang is not None else F.lit(None).cast("string"), F.lit(""))
    return F.sha2(F.concat(F.lit(HASH_TAG).cast("binary"), zero, code, zero, language.cast("binary"), zero, _c(text).cast("binary")), 256)


def node_id(hash_: Column | str) -> Column:
    """First 128 bits of a content hash."""
    return F.substring(_c(hash_), 1, 32)


def text_sha(text: Column | str) -> Column:
    return F.sha2(_c(text), 256)


def token_estimate(text: Column | str) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.floor((F.octet_length(_c(text)) + 3) / 4).cast("long")


def basename(path: Column | str) -> Column:
    return F.substring_index(_c(path), "/", -1)


def dirname(path: Column | str) -> Column:
    return F.regexp_replace(_c(path), "/?[^/]*$", "")


def short_name(symbol: Column | str, separator: str = ".") -> Column:
    """What follows the last separator."""
    return F.substring_index(_c(symbol), separator, -1)


def extension(path: Column | str) -> Column:
    return F.regexp_extract(basename(path), r"[^.]\.([^.]+)$", 1)


def language(path: Column | str) -> Column:
    ext, low = extension(path), F.lower(extension(path))
    return (
        F.when(low == "py", "python").when(low.isin("ts", "mts", "cts"), "typescript").when(low.isin("tsx", "jsx", "js", "mjs", "cjs"), "tsx").when(low == "java", "java").when(ext.isin("md", "markdown"), "markdown").otherwise("text")
    )


def is_test_path(path: Column | str, lang: Column) -> Column:
    """Whether a path is a test's by its language's habits; directory names count as substrings, wherever they are."""
    p, name = _c(path), basename(path)
    python = name.startswith("test_") | name.endswith("_test.py") | p.contains("tests/") | p.contains("test/")
    script = name.contains(".test.") | name.contains(".spec.") | p.contains("__tests__/")
    java = p.contains("src/test/") | name.rlike(r"(Test|Tests|IT)\.java$")
    return F.when(lang == "python", python).when(lang.isin("typescript", "tsx"), script).when(lang == "java", java).otherwise(F.lit(False))


def collapse(text: Column | str) -> Column:
    """Runs of white space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def first_lines(text: Column | str, n: int) -> Column:
    return F.array_join(F.slice(F.split(_c(text), "\n"), 1, n), "\n")


def relative(root: str, path: Column | str) -> Column:
    """Path below a root, with forward slashes."""
    return F.regexp_replace(F.replace(_c(path), F.lit("\\"), F.lit("/")), "^" + _quoted(root.rstrip("/") + "/"), "")


def _quoted(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in s)


def words(text: Column | str) -> Column:
    """Maximal runs of letters, digits and underscores."""
    return F.regexp_extract_all(_c(text), F.lit(f"({_WORD})"), F.lit(1))


def words_after_sign(text: Column | str) -> Column:
    """Words that do not begin the text, each with the character before it."""
    return F.regexp_extract_all(_c(text), F.lit(f"({_SIGN}{_WORD})"), F.lit(1))


def words_before_sign(text: Column | str) -> Column:
    """Words that do not end the text, each with the character after it."""
    return F.regexp_extract_all(_c(text), F.lit(f"({_WORD}{_SIGN})"), F.lit(1))


def signs(text: Column | str) -> Column:
    """Characters that are no letter, digit or underscore."""
    return F.regexp_extract_all(_c(text), F.lit(f"({_SIGN})"), F.lit(1))


def search_terms(query: Column | str) -> Column:
    return F.filter(words(query), lambda w: F.octet_length(w) >= 2)


def contains_word(text: Column | str, word: Column) -> Column:
    """The word occurs next to no letter, digit or underscore."""
    quoted = F.concat(F.lit("\\Q"), F.replace(word, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.regexp_like(_c(text), F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), quoted, F.lit(r"(?![\p{L}\p{N}_])")))


def query_tokens(query: Column | str) -> tuple[Column, Column]:
    """Tokens of a query that may name paths, and those that may name symbols."""
    raw = F.split(_c(query), "[ \t\n,;()`\"']")
    trimmed = F.transform(raw, lambda t: F.regexp_replace(t, r"^[^\p{L}\p{N}/._]+|[^\p{L}\p{N}/._]+$", ""))
    long_ = F.filter(trimmed, lambda t: F.octet_length(t) >= 3)
    paths = F.filter(long_, lambda t: t.contains("/") | (t.contains(".") & (F.octet_length(F.substring_index(t, ".", -1)) <= 4)))
    return paths, F.filter(long_, lambda t: t.rlike(r"^[\p{L}\p{N}_]+$") & t.rlike(r"\p{L}"))


def join_relative(directory: Column, spec: Column) -> Column:
    """A relative specifier resolved against a directory; ``..`` beyond the top stays at the top."""
    start = F.filter(F.split(directory, "/"), lambda p: p != "")

    def step(path: Column, part: Column) -> Column:
        up = F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))
        return F.when((part == ".") | (part == ""), path).when(part == "..", up).otherwise(F.concat(path, F.array(part)))

    return F.array_join(F.aggregate(F.split(spec, "/"), start, step), "/")


def hop_decay(hops: Column) -> Column:
    return F.when(hops == 0, 1.0).when(hops == 1, 0.6).otherwise(0.35)


def round2(x: Column) -> Column:
    return F.round(x, 2)


def percent(part: Column, whole: Column) -> Column:
    """Share in per cent with two decimals; 0 of nothing."""
    return F.when(whole > 0, F.round(part * F.lit(10000.0) / whole) / 100).otherwise(0.0)


def preservation(preserved: Column, staled: Column) -> Column:
    """Per cent preserved; 100 where there was nothing to preserve."""
    return F.when(preserved + staled == 0, 100.0).otherwise(F.round(preserved * F.lit(10000.0) / (preserved + staled)) / 100)


def envelope(id_: Column, path: Column, kind: Column, first: Column, last: Column, symbol: Column, content: Column) -> Column:
    """The stable text form of one item."""
    named = F.when(symbol.isNull(), "").otherwise(F.concat(F.lit(' symbol="'), symbol, F.lit('"')))
    return F.concat(F.lit('<loom:item id="'), F.substring(id_, 1, 12), F.lit('" path="'), path, F.lit('" kind="'), kind, F.lit('" lines="'), first.cast("string"), F.lit("-"), last.cast("string"), F.lit('"'), named, F.lit(">\n"), F.coalesce(content, F.lit("")), F.lit("</loom:item>\n"))


def is_subsequence(part: Column, whole: Column) -> Column:
    """The unique members of ``part`` all occur in ``whole``, in the same order."""
    places = F.transform(part, lambda p: F.array_position(whole, p))
    return F.forall(places, lambda p: p > 0) & F.forall(F.sequence(F.lit(1), F.greatest(F.size(part), F.lit(1))), lambda i: (i == 1) | (F.get(places, i - 1) > F.get(places, i - 2)))


def upper_median(values: Column) -> Column:
    """The middle of a sorted array, the higher one of two; null of none."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def utc_minute(epoch: Column) -> Column:
    return F.concat(F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH:mm"), F.lit(" UTC"))


def ewma(hits: Column, decay: float = 0.9) -> Column:
    """State after n hits of x' = decay x + 1, from 1 at the first."""
    return (F.lit(1.0) - F.pow(F.lit(decay), hits)) / (1 - decay)
