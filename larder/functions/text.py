"""Text by language, folding that keeps positions, name normalisation and clean-up."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F


def _folding_table() -> tuple[str, str]:
    """Every BMP character whose decomposition is one base character plus marks."""
    source, target = [], []
    for code in range(0x80, 0x10000):
        ch = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if not 0x300 <= ord(c) <= 0x36F)
        if base != ch and len(base) == 1:
            source.append(ch)
            target.append(base)
    return "".join(source), "".join(target)


FOLD_FROM, FOLD_TO = _folding_table()


def fold(c: Column) -> Column:
    """Drop diacritics one character for one character, so positions stay valid."""
    return F.translate(c, FOLD_FROM, FOLD_TO)


def not_blank(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def text_by_lang(doc: Column, base: str, own_lang: Column, lang: str | None = None) -> Column:
    """Requested language, then the plain field, then the product's own language, then the
    alphabetically first variant whose suffix is a language code. Blank texts are skipped.

    ``doc`` is a map of the document's top-level keys to their text.
    """
    options = [not_blank(F.try_element_at(doc, F.lit(f"{base}_{lang}")))] if lang else []
    options.append(not_blank(F.try_element_at(doc, F.lit(base))))
    options.append(F.when(own_lang != "", not_blank(F.try_element_at(doc, F.concat(F.lit(base + "_"), own_lang)))))
    variants = F.map_filter(
        doc, lambda k, v: k.rlike(f"^{base}_(?i:[a-z]{{2,3}}(?:_[a-z]{{2,4}})?)$") & (F.trim(v) != ""))
    first = F.try_element_at(variants, F.array_min(F.map_keys(variants)))
    return F.coalesce(*options, not_blank(first))


def product_name(doc: Column, own_lang: Column, lang: str | None = None) -> Column:
    return F.coalesce(text_by_lang(doc, "product_name", own_lang, lang),
                      text_by_lang(doc, "generic_name", own_lang, lang))


def ingredients_text(doc: Column, own_lang: Column, lang: str | None = None) -> Column:
    return text_by_lang(doc, "ingredients_text", own_lang, lang)


def inci_list(text: Column) -> Column:
    """Ingredients of a cosmetic label, normalised; one-letter leftovers are dropped."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), "^(?i:ingredients?)\\s*:", "")
    clean = lambda s: F.trim(F.regexp_replace(F.regexp_replace(fold(F.lower(s)), r"[*+()\[\]{}.]", " "), r"\s+", " "))
    return F.filter(F.transform(F.split(body, "[,;]"), clean), lambda s: F.length(s) > 1)


def words_of(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def norm_name(c: Column) -> Column:
    """Words of a substance name for comparing sources; a plural s is dropped."""
    ascii_only = F.regexp_replace(fold(F.lower(F.coalesce(c, F.lit("")))), r"[^\x00-\x7f]", "")
    plain = F.regexp_replace(F.regexp_replace(ascii_only, r"\(e\s*\d+[a-z]*\)", ""), "[^a-z0-9]+", " ")
    singular = lambda w: F.when((F.length(w) > 3) & w.endswith("s"), F.left(w, F.length(w) - 1)).otherwise(w)
    return F.array_join(F.transform(words_of(F.trim(plain)), singular), " ")


# Words that carry no identity when names are matched.
NAME_STOP_WORDS = ["of", "and", "or", "the"]


def norm_name_key(c: Column) -> Column:
    """Name key for exact matching: E numbers and stop words go, the cation stays."""
    ascii_only = F.regexp_replace(fold(F.lower(F.coalesce(c, F.lit("")))), r"[^\x00-\x7f]", "")
    no_numbers = F.regexp_replace(ascii_only, r"\be\s?\d{3,4}[a-z]*\b", " ")
    words = words_of(F.trim(F.regexp_replace(no_numbers, "[^a-z0-9]+", " ")))
    return F.nullif(F.array_join(F.filter(words, lambda w: ~w.isin(NAME_STOP_WORDS)), " "), F.lit(""))


def names_alike(a: Column, b: Column) -> Column:
    """Share a word; a side without words cannot be suspicious."""
    wa, wb = words_of(norm_name(a)), words_of(norm_name(b))
    return (F.size(wa) == 0) | (F.size(wb) == 0) | F.arrays_overlap(wa, wb)


def doi(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"10\.\d{4,9}/\S+", 0), F.lit(""))


def fix_utf8(c: Column) -> Column:
    """Undo text that was decoded as Latin-1 by mistake; anything else is left alone."""
    raw = F.encode(c, "ISO-8859-1")
    doubtful = c.contains("Â") & ~c.rlike("[^\\x00-\\xff]")
    return F.when(doubtful & F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(c)


# Named character entities.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def decode_entities(c: Column) -> Column:
    out = c
    for name, ch in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(ch))
    return out


def strip_html(c: Column) -> Column:
    """Text of a fragment: tags become spaces, entities are decoded, blanks collapse."""
    text = F.regexp_replace(c, "(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(decode_entities(text), r"\s+", " "))


def label_badges(tags: Column, n: int = 10) -> Column:
    plain = F.transform(tags, lambda t: F.replace(F.regexp_replace(t, "^[a-z]{2}:", ""), F.lit("-"), F.lit(" ")))
    return F.slice(F.array_distinct(F.filter(plain, lambda t: F.length(t) > 1)), 1, n)


def split_tags(c: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda t: F.trim(t))
    return F.filter(parts, lambda t: t != "")


def pick_language(m: Column) -> Column:
    """Spanish, then English, then the language-free entry."""
    return F.coalesce(*[F.nullif(F.try_element_at(m, F.lit(k)), F.lit("")) for k in ("es", "en", "xx")])


def risk_word(c: Column) -> Column:
    word = F.lower(F.regexp_replace(c, "^en:", ""))
    return F.when(word.isin("high", "moderate", "no"), word)
