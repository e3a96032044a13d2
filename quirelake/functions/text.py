"""Text functions as column expressions.

Three normal forms are kept apart because they differ in order and result:
``lexical_tokens`` (search), ``citation_form`` (quote matching) and
``canonical_form`` (security prefilter).
"""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import bound

#: Blocks that hold all characters with a decomposition but Hangul syllables, whose parts are no letters of ours.
BLOCKS = [(0xA0, 0x33FF), (0xA69C, 0xABFF), (0xF900, 0xFFEF), (0x10780, 0x107BA), (0x1D400, 0x1D7FF), (0x1E030, 0x1E06D), (0x1EE00, 0x1EEFF), (0x1F100, 0x1F2FF), (0x1FBF0, 0x1FBF9), (0x2F800, 0x2FA1F)]


def _decompositions() -> tuple[dict[str, str], dict[str, str]]:
    """Compatibility decompositions without marks: to one character, and to none or several."""
    single, several = {}, {}
    for low, high in BLOCKS:
        for code in range(low, high + 1):
            c = chr(code)
            plain = "".join(d for d in unicodedata.normalize("NFKD", c) if not unicodedata.combining(d))
            if plain != c and not unicodedata.combining(c):
                (single if len(plain) == 1 else several)[c] = plain
    return single, several


def _class(codes: list[int]) -> str:
    """A character class of code points, as ranges."""
    ranges: list[list[int]] = []
    for code in sorted(codes):
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"


SINGLE, SEVERAL = _decompositions()
ACCENTED, PLAIN = "".join(SINGLE), "".join(SINGLE.values())
SEVERAL_CLASS = _class([ord(c) for c in SEVERAL])
#: Ranges that hold all of them, for a first look.
SEVERAL_NEAR = r"[\xA8-\xBE\u0132-\u0149\u01C4-\u01F3\u02D8-\x{10FFFF}]"
#: Invisible characters that a scan drops, and look-alike letters with what they stand for (fixed values).
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
LOOK_ALIKE = "аеіοорсхуΑΒΕΙΟΡΧ"
LOOKS_LIKE = "aeioopcxyabeiopx"
SPACES = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1C-\x1F]+"


def unaccent(text: Column) -> Column:
    """Compatibility decomposition without combining marks, of whatever script but Hangul."""
    return _taken_apart(F.translate(text, ACCENTED, PLAIN))


def _taken_apart(text: Column) -> Column:
    """What single characters do not give: parts of ligatures, and no marks."""

    def parted(one: Column) -> Column:
        # Ligatures, fractions and the like stand for several characters.  Few texts have any, so these alone are taken apart.
        some = one.rlike(SEVERAL_NEAR) & (F.length(F.translate(one, "".join(SEVERAL), "")) < F.length(one))
        table = F.str_to_map(F.lit("\u0001".join(f"{c}\u0002{d}" for c, d in SEVERAL.items())), F.lit("\u0001"), F.lit("\u0002"))
        parts = F.split(one, f"(?<={SEVERAL_CLASS})|(?={SEVERAL_CLASS})", -1)
        full = F.array_join(F.transform(parts, lambda p: F.coalesce(F.when(F.length(p) == 1, F.try_element_at(table, p)), p)), "")
        return F.regexp_replace(F.when(some, full).otherwise(one), r"\p{Mn}", "")

    return bound(text, parted)


def lexical_tokens(text: Column) -> Column:
    """Lower-case, unaccented runs of a-z and 0-9."""
    return F.regexp_extract_all(unaccent(F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))), F.lit("[a-z0-9]+"), F.lit(0))


def collapse(text: Column) -> Column:
    """All Unicode white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def citation_form(text: Column) -> Column:
    folded = F.replace(F.lower(unaccent(text)), F.lit("ß"), F.lit("ss"))
    return collapse(F.regexp_replace(folded, r"(?U)[^\w\s]", " "))


def quote_in(quote: Column, source: Column) -> Column:
    """Whether a non-empty quote, normalised, occurs in a source, normalised."""
    q = citation_form(quote)
    return (F.length(q) > 0) & F.contains(citation_form(source), q)


def canonical_form(text: Column) -> Column:
    """Without invisible characters, look-alikes and accents, in lower case."""
    # One pass: of a character that comes twice the first counts, and those without a counterpart go.
    return F.lower(_taken_apart(F.translate(text, LOOK_ALIKE + ACCENTED + INVISIBLE, LOOKS_LIKE + PLAIN)))


def truncated(text: Column, most: int) -> Column:
    """At most ``most`` characters, cut back to the last blank if one is there."""

    def shortened(clean: Column) -> Column:
        cut = F.substring(clean, 1, most)
        # The last blank of the cut begins where the greedy prefix ends.
        return F.when(F.length(clean) <= most, clean).otherwise(F.coalesce(F.nullif(F.regexp_extract(cut, r"(?s)^(.*) [^ ]*$", 1), F.lit("")), cut))

    return bound(collapse(F.coalesce(text, F.lit(""))), shortened)


def preview(text: Column, most: int = 240) -> Column:
    clean = collapse(text)
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(F.rtrim(F.substring(clean, 1, most - 1)), F.lit("…")))


def is_heading(line: Column) -> Column:
    """1 to 80 characters, three letters or more, nine in ten of them capitals."""
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
    capitals = F.length(F.regexp_replace(line, r"[^\p{Lu}]", ""))
    return (F.length(line) >= 1) & (F.length(line) <= 80) & (letters >= 3) & (capitals >= 0.9 * letters)


def hash_bucket(token: Column, size: int) -> Column:
    """First four bytes of the md5, big-endian, modulo ``size``."""
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long"), F.lit(size)).cast("int")


def usable_ocr_text(text: Column) -> Column:
    """Quality floor: 16 letters or digits, 10 letters, 3 tokens of two or more, 2 of them distinct."""
    tokens = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0)), lambda t: F.length(t) >= 2)
    alnum = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    alpha = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return (alnum >= 16) & (alpha >= 10) & (F.size(tokens) >= 3) & (F.size(F.array_distinct(tokens)) >= 2)


def any_term(text: Column, terms: list[str] | tuple[str, ...]) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(text, F.lit(term))
    return found


def bounded_excerpt(text: Column, most: int = 600) -> Column:
    """At most ``most`` characters; a longer text is cut after a whole word and gets an ellipsis."""
    clean = collapse(F.coalesce(text, F.lit("")))
    head = F.substring(clean, 1, most - 1)
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(F.regexp_replace(head, " [^ ]*$", ""), F.lit("…")))


def chunk_quote(text: Column, most: int = 700) -> Column:
    """A chunk without its line of the section name, on one line."""
    return F.substring(collapse(F.regexp_replace(text, r"^\[[^\r\n]*\](?:\r?\n|$)", "")), 1, most)


def article_of_unit(unit: Column) -> Column:
    """The article of a unit identifier: what stands before the first unit marker (fixed values)."""
    return F.regexp_replace(unit, r"(?s)-(?:caput|paragrafo-|inciso-|alinea-).*$", "")


def escaped(text: Column) -> Column:
    """Safe inside markup and attribute values."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def instructed(text: Column, instruction: str | None) -> Column:
    """A text behind the instruction that an embedding model wants; no blank after a colon."""
    prefix = (instruction or "").strip()
    return F.concat(F.lit(prefix if prefix.endswith(":") else prefix + " "), text) if prefix else text


def fingerprint(*parts: Column) -> Column:
    """Identity of an index: its parts joined by colons, and the hash of that."""
    joined = F.concat_ws(":", *parts)
    return F.struct(joined.alias("parts"), F.sha2(joined, 256).alias("sha256"))


def canonical_json_hash(document: Column) -> Column:
    """sha-256 of a JSON text with sorted keys, no blanks and letters as they are; null if it is no JSON.

    Key order inside nested objects is beyond the JSON functions, hence the Arrow function.
    """

    @F.pandas_udf("string")
    def canonical(texts: pd.Series) -> pd.Series:
        return texts.map(_sorted_json)

    return F.sha2(canonical(document), 256)


def _sorted_json(text: str | None) -> str | None:
    try:
        return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except ValueError:
        return None
