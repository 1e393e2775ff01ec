"""Text expressions: the native lexer, name rules, pronoun masking and rewriting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = "[ \t\n\r\f]+"

#: Pronoun forms in the order they are rewritten, and the classes they belong to.
NOMINATIVE = {"male": "he", "female": "she", "neutral": "they"}
POSSESSIVE = {"male": "his", "female": "her", "neutral": "their"}
ACCUSATIVE = {"male": "him", "female": "her", "neutral": "them"}
CLASSES = {g: (NOMINATIVE[g], POSSESSIVE[g], ACCUSATIVE[g]) for g in NOMINATIVE}
GENDERS = list(CLASSES)
#: Verb forms after a neutral subject.
AGREEMENT = (("they was", "they were"), ("They was", "They were"), ("they is", "they are"), ("They is", "They are"), ("they has", "they have"), ("They has", "They have"))


def tokens(text: Column) -> Column:
    """Words between white space; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), F.lit(""))


def split_name(url: Column) -> Column:
    """Last path segment without the archive suffix, dashes as underscores."""
    return F.replace(F.replace(F.element_at(F.split(url, "/"), -1), F.lit(".json.gz"), F.lit("")), F.lit("-"), F.lit("_"))


def length_bucket(n: Column) -> Column:
    """'0k', '1k', ... without an upper end."""
    return F.concat(F.floor(n / 1000).cast("bigint").cast("string"), F.lit("k"))


def strip_punctuation(word: Column) -> Column:
    """Lower case, letters, marks, digits and underscore only (F2)."""
    return F.regexp_replace(F.lower(word), r"[^\p{L}\p{M}\p{N}_]", "")


def gender_class(word: Column) -> Column:
    """male, female, neutral, or null."""
    out = F.lit(None).cast("string")
    for g, forms in CLASSES.items():
        out = F.when(word.isin(*forms), F.lit(g)).otherwise(out)
    return out


def all_pronouns() -> list[str]:
    return sorted({w for forms in CLASSES.values() for w in forms})


def rewrite(text: Column, source: str, target: str) -> Column:
    """Pronouns of one class changed to another's, nominative before possessive before accusative.

    As possessives are replaced before accusatives, a female `her` always turns into the possessive.
    """
    for table in (NOMINATIVE, POSSESSIVE, ACCUSATIVE):
        a, b = table[source], table[target]
        for x, y in ((a, b), (a.capitalize(), b.capitalize())):
            text = F.regexp_replace(text, rf"\b{x}\b", y)
    return agree(text) if target == "neutral" else text


def agree(text: Column) -> Column:
    """Verb forms after a neutral subject."""
    for a, b in AGREEMENT:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def masked(words: Column, at: Column, mask: str = "[MASK]") -> Column:
    """The words joined, that at place `at` (from 0) replaced by the mask and its last .,!?;:."""
    return F.array_join(F.transform(words, lambda w, i: F.when(i == at, F.concat(F.lit(mask), F.regexp_extract(w, "([.,!?;:])$", 1))).otherwise(w)), " ")


def draw(*parts: Column) -> Column:
    """A number from 0 to 2**32 - 1 from the md5 of the parts joined by '-': the library's random choice."""
    return F.conv(F.substring(order_key(*parts), 1, 8), 16, 10).cast("bigint")


def order_key(*parts: Column) -> Column:
    """The md5 of the parts joined by '-': the library's random order."""
    return F.md5(F.concat_ws("-", *[p.cast("string") for p in parts]).cast("binary"))


def model_family(name: Column) -> Column:
    """Family from a model's name: four branches, others null."""
    return (
        F.when(name.contains("dec-from-enc"), "Decoder from Encoder").when(name.contains("enc-from-dec"), "Encoder from Decoder")
        .when(name.contains("encoder"), "Encoder").when(name.contains("decoder"), "Decoder")
    )


def model_size(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"(\d+[mb])", 1), F.lit(""))


def other_direction(name: Column) -> Column:
    """A model's name with what it was made from turned round: enc-from-dec to dec-from-enc, encoder to decoder, and back."""
    swaps = [("enc-from-dec", "dec-from-enc"), ("dec-from-enc", "enc-from-dec"), ("encoder", "decoder"), ("decoder", "encoder")]
    out = name
    for a, b in reversed(swaps):
        out = F.when(F.contains(name, F.lit(a)), F.replace(name, F.lit(a), F.lit(b))).otherwise(out)
    return out


def clock(at: Column | None = None) -> Column:
    """A time as text, now by default."""
    return F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd HH:mm:ss")
