"""Text functions as Column -> Column expressions, all inside Catalyst."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[str, str]:
    """Latin letters and digits with marks, and what is left of them without; then the marks themselves, which have no counterpart and go."""
    found = {}
    for point in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00)):
        letter = chr(point).lower()
        bare = "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c)).lower()
        if len(letter) == 1 and len(bare) == 1 and bare.isascii() and bare.isalnum():
            found[letter] = bare
    return "".join(found) + "".join(map(chr, range(0x300, 0x370))), "".join(found.values())


ACCENTED, PLAIN = _folds()
# Stop-words of the formulary search.
STOP_WORDS = (
    "de", "da", "do", "a", "o", "e", "em", "para", "com", "qual", "como", "que", "no", "na", "um", "uma", "por", "se", "the", "of",
)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits longer than one character."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0))


def fold_header(text: Column) -> Column:
    """Lower-case, accents dropped, all else kept."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def fold(text: Column) -> Column:
    """Lower-case, accents dropped, everything but a-z and 0-9 one space."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), "[^a-z0-9]+", " "))


def content_tokens(text: Column) -> Column:
    words = F.filter(F.split(fold(text), " "), lambda t: F.length(t) > 2)
    return F.array_distinct(F.array_except(words, F.array(*map(F.lit, STOP_WORDS))))


def keep_case(model: Column, text: Column) -> Column:
    """``text`` in the case of ``model``: capitals, first capital or lower."""
    return (
        F.when((F.upper(model) == model) & (F.lower(model) != model), F.upper(text))
        .when(F.substring(model, 1, 1) == F.upper(F.substring(model, 1, 1)), F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text))))
        .otherwise(F.lower(text))
    )


def fix_ligature(text: Column) -> Column:
    """Misread fl and fi ligatures, and l for I before n, s or m at a word's start; one rule for each case form."""
    rules = [("tlu|f[tf]u", "flu"), ("Tlu|F[tf]u", "Flu"), ("TLU|F[TF]U", "FLU"), ("ftc", "fic"), ("Ftc", "Fic"), ("FTC", "FIC"), (r"(?<![\p{L}\p{N}_])l(?=[nsm][a-zà-ÿ])", "I")]
    for pattern, new in rules:
        text = F.regexp_replace(text, pattern, new)
    return text


def join_hyphen(text: Column) -> Column:
    """Words broken by a hyphen at a line's end, or by one with a space after it only."""
    word = r"([\p{L}\p{N}_])"
    return F.regexp_replace(F.regexp_replace(text, rf"{word}[-\u00ad]\s*\n\s*{word}", "$1$2"), f"{word}- {word}", "$1$2")


def drop_lines(text: Column, pattern: str) -> Column:
    """Without lines that match."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(pattern)), "\n")


def clean_page(text: Column) -> Column:
    """Page-number lines dropped, spaces collapsed, at most one blank line."""
    return F.trim(F.regexp_replace(F.regexp_replace(drop_lines(text, r"^\s*\d+\s*$"), "[ \t]+", " "), "\n{3,}", "\n\n"))


def roman(text: Column, lenient: bool = False) -> Column:
    """Roman numeral to int; strict: null on another letter; lenient: a numeral of nothing but 1 counts them as I, other letters are 0."""
    raw = F.upper(F.trim(text))
    raw = F.when(raw.rlike("^1+$"), F.translate(raw, "1", "I")).otherwise(raw) if lenient else raw
    value = F.create_map(*[F.lit(x) for p in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for x in p])
    digits = F.reverse(F.filter(F.split(raw, ""), lambda c: c != ""))
    step = lambda acc, c: F.struct(
        (acc["total"] + F.when(F.coalesce(value[c], F.lit(0)) < acc["last"], -F.coalesce(value[c], F.lit(0))).otherwise(F.coalesce(value[c], F.lit(0)))).alias("total"),
        F.coalesce(value[c], F.lit(0)).alias("last"),
    )
    total = F.aggregate(digits, F.struct(F.lit(0).alias("total"), F.lit(0).alias("last")), step)["total"]
    return total if lenient else F.when(raw.rlike("^[IVXLCDM]+$"), total)


def heading_level(text: Column) -> Column:
    """1 if all letters are capitals, else 2, as without any letter."""
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    return F.when((F.upper(letters) == letters) & (letters != ""), 1).otherwise(2)


def split_glued(text: Column) -> Column:
    return F.regexp_replace(text, "(?<=[a-z])(?=[A-Z])", " ")


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "").try_cast("int")


def chunk_id(path: Column, text: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("\n", F.array_join(path, "|"), text)), 1, 12)


def content_key(text: Column) -> Column:
    return F.sha1(F.lower(F.trim(F.regexp_replace(text, "[ \t\n\r]+", " "))))


def hash_share(salt: str, key: Column) -> Column:
    """The first 32 bits of sha1(salt:key) as a number."""
    return F.conv(F.substring(F.sha1(F.concat(F.lit(salt + ":"), key.cast("string"))), 1, 8), 16, 10).cast("long")


def first_letter(text: Column) -> Column:
    return F.substring(F.upper(F.trim(text)), 1, 1)


def numeric_anchors(text: Column) -> Column:
    """Numbers that stand right before a unit."""
    # The units.
    units = "%|mg|mcg|µg|mL|L|cmH2O|mmHg|°C|graus|horas?|minutos?|dias?|semanas?"
    return F.regexp_extract_all(text, F.lit(rf"(?i)(?<![\p{{L}}\p{{N}}.,])([0-9]{{1,4}}(?:[.,][0-9]{{1,2}})?)\s*({units})"), 1)


def html_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def focus_query(text: Column, mark: str = "\n\nAssertiva:") -> Column:
    return F.when(F.contains(text, F.lit(mark)), F.trim(F.substring_index(text, mark, -1))).otherwise(text)
