"""Text expressions. Everything here is a Column in, Column out, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.schemas import MAX_CONTENT_CHARS, TOKENS_PER_WORD

# The characters a browser-side "whitespace" class covers (wider than Java's).
SPACE_CHARS = r"\s\x0b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = f"[{SPACE_CHARS}]"
NOT_SPACE = f"[^{SPACE_CHARS}]"

# The same characters as plain text, for the builtins that take a character list.
_BLANKS = "".join(
    map(chr, [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])
)
_ODD_BLANKS = _BLANKS.replace(" ", "")

# Zero-width characters dropped before hashing.
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff"

# Entity names that are decoded.
NAMED_ENTITIES = {
    "amp": "&",
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "apos": "'",
    "nbsp": " ",
    "mdash": "—",
    "ndash": "–",
    "hellip": "…",
    "rsquo": "’",
    "lsquo": "‘",
    "ldquo": "“",
    "rdquo": "”",
}

# Words too common to count as significant title terms.
TITLE_STOPWORDS = (
    "the and for with from this that into over your new now how why what when will has have are "
    "was its about"
).split()

# Characters that compatibility normalisation provably leaves alone: ASCII, the Latin letters
# without compatibility forms, dashes, quotes and the euro sign. A class of many ranges is slow to
# tell about each character, so ASCII is passed over by a class of one range first.
_MAY_CHANGE = (
    r"(?![\x00-\x7f])[^\x00-\x9f\u00a1-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u0131"
    r"\u0134-\u013e\u0141-\u0148\u014a-\u017e\u2013\u2014\u2018-\u201e\u20ac]"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name a value used several times, so the expression tree stays linear in its length."""
    return F.get(F.transform(F.array(value), body), 0)


def trim_all(c: Column) -> Column:
    """Strip every kind of whitespace from both ends."""
    return F.trim(c, F.lit(_BLANKS))


def _plain_blanks(c: Column) -> Column:
    return F.translate(c, _ODD_BLANKS, " " * len(_ODD_BLANKS))


def collapse(c: Column) -> Column:
    """Whitespace runs become one blank, ends trimmed. Mapping the odd blanks first leaves a
    one-character pattern, several times faster than matching the whole class."""
    return F.trim(F.regexp_replace(_plain_blanks(c), " {2,}", " "))


def fold(c: Column) -> Column:
    """Case- and whitespace-insensitive comparison form."""
    return F.lower(collapse(c))


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKC")


def nfkc(c: Column) -> Column:
    """Unicode compatibility composition. Spark has no builtin, so only rows holding a
    character that could change are handed to Python; all others cross as null."""
    changed = _nfkc(F.when(c.rlike(_MAY_CHANGE), c))
    return F.coalesce(changed, c)


def hash_form(c: Column, unicode_forms: bool = True) -> Column:
    base = nfkc(c) if unicode_forms else c
    blanks = "".join(ch for ch in _ODD_BLANKS if ch not in INVISIBLE)
    # Characters of the second list without a partner are deleted.
    mapped = F.translate(base, blanks + INVISIBLE, " " * len(blanks))
    return F.lower(F.trim(F.regexp_replace(mapped, " {2,}", " ")))


def content_hash(title: Column, body: Column, unicode_forms: bool = True) -> Column:
    joined = F.concat(
        hash_form(title, unicode_forms), F.lit("\n"), hash_form(body, unicode_forms)
    )
    return F.sha2(joined, 256)


def decode_entities(c: Column) -> Column:
    """Decode numeric and named entities in one pass; unknown ones stay as they are."""
    entity = r"(?i)^&(#x?[0-9a-f]+|[a-z][a-z0-9]*);"
    names = F.create_map(*[F.lit(x) for pair in NAMED_ENTITIES.items() for x in pair])

    def decoded_parts(t: Column) -> Column:
        parts = F.split(t, r"(?i)(?=&(?:#x?[0-9a-f]+|[a-z][a-z0-9]*);)")
        return F.array_join(F.transform(parts, one), "")

    def one(part: Column) -> Column:
        ref = F.lower(F.regexp_extract(part, entity, 1))
        hexadecimal = ref.startswith("#x")
        digits = F.regexp_replace(ref, "^#x?0*", "")
        # More than seven digits lie beyond the last code point whatever the base.
        code = F.when(F.length(digits) > 7, F.lit(None)).when(hexadecimal, F.conv(digits, 16, 10)).otherwise(
            F.regexp_extract(digits, "^[0-9]+", 0)
        )
        number = code.try_cast("bigint")
        decoded = F.when(
            ref.startswith("#"),
            F.when(
                number.between(1, 1114111) & ~number.between(55296, 57343),
                F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"),
            ),
        ).otherwise(F.try_element_at(names, ref))
        rest = F.regexp_replace(part, entity, "")
        return F.when((ref != "") & decoded.isNotNull(), F.concat(decoded, rest)).otherwise(part)

    return let(c, lambda t: F.when(t.contains("&"), decoded_parts(t)).otherwise(t))


# Markup and what it becomes, in the order of replacement.
MARKUP = [
    (r"(?i)<(script|style)\b[^>]*>[\s\S]*?</\1>", " "),
    (r"<!--[\s\S]*?-->", " "),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)<li\b[^>]*>", "- "),
    (r"(?i)</li>", "\n"),
    (r"(?i)</(p|div|h[1-6]|tr|section|article)>", "\n\n"),
    (r"<[^>]+>", " "),
]


def html_to_text(c: Column) -> Column:
    """Flatten markup: blocks become line breaks, other tags blanks."""
    out = c
    for pattern, put in MARKUP:
        out = F.regexp_replace(out, pattern, put)
    out = decode_entities(out)
    out = F.regexp_replace(out, f"(?:(?!\\n){SPACE})+", " ")
    out = F.regexp_replace(out, r" ?\n ?", "\n")
    return trim_all(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def truncate(c: Column, limit: int = MAX_CONTENT_CHARS) -> Column:
    def cut(t: Column) -> Column:
        kept = F.rtrim(F.substring(t, 1, limit), F.lit(_BLANKS))
        return F.when(F.length(t) > limit, F.concat(kept, F.lit("…"))).otherwise(t)

    return let(c, cut)


def parse_date(c: Column) -> Column:
    """Accept the feed date spellings seen in practice; anything else is null."""
    text = trim_all(c)
    bare = F.regexp_replace(text, r"^[A-Za-z]{3,9},?\s+", "")
    zoned = F.regexp_replace(bare, r"\s(?:GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(
        text.try_cast("timestamp"),
        F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm Z")),
        F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss")),
        F.try_to_timestamp(zoned, F.lit("d MMM yyyy")),
        F.try_to_timestamp(text, F.lit("MMMM d, yyyy")),
        F.try_to_timestamp(text, F.lit("MMM d, yyyy")),
    )


def instant(value: Column, dtype: str) -> Column:
    """A date field of either kind: numbers are milliseconds since the epoch, texts are parsed."""
    if dtype in ("tinyint", "smallint", "int", "bigint", "float", "double") or dtype.startswith("decimal"):
        ms = value.cast("double")
        return F.when(F.abs(ms) <= 8.64e15, F.timestamp_millis(ms.cast("bigint")))
    return parse_date(value)


def sentences(c: Column) -> Column:
    """Trimmed sentences: a break follows ``.!?`` plus whitespace, or any line break."""
    pieces = F.split(c, f"(?<=[.!?]){SPACE}+|\\n+")
    return F.filter(F.transform(pieces, trim_all), lambda s: s != "")


def flat_sentences(c: Column) -> Column:
    """Sentences of a text whose whitespace is collapsed first."""
    return F.filter(F.split(collapse(c), "(?<=[.!?]) "), lambda s: s != "")


def word_count(c: Column) -> Column:
    return F.regexp_count(_plain_blanks(c), F.lit("[^ ]+"))


def estimate_tokens(c: Column) -> Column:
    return tokens_of_words(word_count(c))


def tokens_of_words(words: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(words * F.lit(TOKENS_PER_WORD))).cast("int")


def document(title: Column, body: Column) -> Column:
    """Title, blank line, body; whitespace collapsed, either side may be missing."""
    sides = F.array(collapse(F.coalesce(title, F.lit(""))), collapse(F.coalesce(body, F.lit(""))))
    return F.array_join(F.filter(sides, lambda t: t != ""), "\n\n")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def citations(c: Column) -> Column:
    """Distinct ids cited as ``[#n]``, in order of first use."""
    found = F.regexp_extract_all(c, F.lit(r"\[#(\d+)\]"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: x.try_cast("bigint")))


def strip_citations(c: Column) -> Column:
    return trim_all(F.regexp_replace(c, f"{SPACE}*\\[#\\d+\\]", ""))


def leading_quote(title: Column, body: Column, limit: int = 220, floor: int = 8) -> Column:
    """First sentence of a body as a verbatim quote, else a bounded prefix."""

    def pick(t: Column) -> Column:
        head = F.length(F.regexp_extract(t, r"^(.*?[.!?])\s", 1))
        end = F.when(head > floor, head + 1).otherwise(F.length(t))
        quote = F.trim(F.substring(t, F.lit(1), F.least(end, F.lit(limit))))
        prefix = F.trim(F.substring(t, 1, limit))
        return let(quote, lambda q: F.when(F.length(q) >= floor, q).otherwise(prefix))

    flat = let(collapse(F.coalesce(body, F.lit(""))), lambda b: F.when(b != "", b).otherwise(trim_all(title)))
    return let(flat, pick)


def answer_quote(body: Column, limit: int = 180, floor: int = 40) -> Column:
    """First sentence when it is long enough, else a prefix."""

    def pick(t: Column) -> Column:
        head = F.length(F.regexp_extract(t, r"^(.*?[.!?])\s", 1))
        end = F.when(head > floor, head).otherwise(F.least(F.length(t), F.lit(limit)))
        return F.trim(F.substring(t, F.lit(1), end))

    return let(collapse(body), pick)


def first_sentence(c: Column) -> Column:
    def pick(t: Column) -> Column:
        head = F.regexp_extract(t, f"^(.*?[.!?])(?={SPACE}|$)", 1)
        return let(head, lambda h: F.when(h != "", trim_all(h)).otherwise(t))

    return let(trim_all(c), pick)


def significant_terms(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9][a-z0-9.+-]{3,}"), F.lit(0))
    return F.array_except(found, F.array(*[F.lit(w) for w in TITLE_STOPWORDS]))


def snippet(c: Column, limit: int = 120, floor: int = 40) -> Column:
    """Cut at the last blank inside the limit, provided enough text is left."""

    def pick(t: Column) -> Column:
        cut = F.substring(t, 1, limit)
        back = F.locate(" ", F.reverse(cut))
        at = F.when(back > 0, F.lit(limit) - back).otherwise(F.lit(-1))
        kept = F.when(at > floor, F.substring(cut, F.lit(1), at)).otherwise(cut)
        return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(kept), F.lit("…")))

    return let(collapse(c), pick)


def strip_code_fence(c: Column) -> Column:
    def pick(t: Column) -> Column:
        inner = F.regexp_replace(t, r"(?i)^```(?:json)?\s*", "")
        inner = trim_all(F.regexp_replace(inner, r"\s*```$", ""))
        return F.when(t.startswith("```"), inner).otherwise(t)

    return let(trim_all(c), pick)


def quote_is_grounded(quote: Column, source: Column, floor: int = 8) -> Column:
    """A quote counts when it is long enough and appears in the source, folded."""

    def found(needle: Column) -> Column:
        return (F.length(needle) >= floor) & fold(source).contains(needle)

    return F.coalesce(let(fold(quote), found), F.lit(False))
