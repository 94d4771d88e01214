"""Barcodes, image references, tags, E numbers and CAS numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: where product photos are served from.
IMAGE_BASE = "https://images.openfoodfacts.org/images/products"

# GS1 prefixes in published order (first, last, region, country, kind). A range that
# ends at 99 or below is compared with the first two digits, any other with the first three.
GS1_RULES = [
    (20, 29, "store", None, "store-internal"),
    (200, 299, "store", None, "store-internal"),
    (40, 49, "company", None, "store-internal"),
    (0, 19, "United States or Canada", "united-states", None),
    (30, 39, "United States", "united-states", None),
    (60, 139, "United States", "united-states", None),
    (754, 755, "Canada", None, None),
    (750, 750, "Mexico", "mexico", None),
    (759, 759, "Venezuela", "venezuela", None),
    (770, 771, "Colombia", "colombia", None),
    (773, 773, "Uruguay", None, None),
    (775, 775, "Peru", "peru", None),
    (777, 777, "Bolivia", None, None),
    (778, 779, "Argentina", "argentina", None),
    (780, 780, "Chile", "chile", None),
    (784, 784, "Paraguay", None, None),
    (786, 786, "Ecuador", None, None),
    (789, 790, "Brazil", None, None),
    (740, 745, "Central America", None, None),
    (840, 849, "Spain", "spain", None),
    (300, 379, "France", None, None),
    (400, 440, "Germany", None, None),
    (500, 509, "United Kingdom", None, None),
    (560, 560, "Portugal", None, None),
    (800, 839, "Italy", None, None),
    (870, 879, "Netherlands", None, None),
    (900, 919, "Austria", None, None),
    (450, 459, "Japan", None, None),
    (490, 499, "Japan", None, None),
    (690, 699, "China", None, None),
    (880, 880, "South Korea", None, None),
    (890, 890, "India", None, None),
    (977, 977, "periodical", None, "magazine"),
    (978, 979, "book", None, "book"),
    (980, 980, "refund receipt", None, "refund"),
    (981, 984, "coupon", None, "coupon"),
    (990, 999, "coupon", None, "coupon"),
]
UNRESOLVABLE = ["store-internal", "coupon", "refund"]
# Short codes of what a user is told about a code that isn't a product's.
GS1_NOTES = {"store-internal": "not-unique-worldwide", "book": "isbn-of-a-book", "magazine": "issn-of-a-periodical",
             "coupon": "coupon-not-a-product", "refund": "refund-not-a-product"}


def normalize_barcode(c: Column) -> Column:
    t = F.trim(c)
    return F.when(F.length(t) == 12, F.concat(F.lit("0"), t)).otherwise(t)


def is_valid_ean(c: Column) -> Column:
    """Check digit of 8, 12, 13 and 14 digit codes: weights 3, 1, 3, ... from the right."""
    shaped = c.rlike(r"^(\d{8}|\d{12,14})$")
    padded = F.lpad(c, 14, "0")
    total = sum((F.substring(padded, i, 1).try_cast("int") * (3 if i % 2 else 1) for i in range(1, 14)), F.lit(0))
    check = F.pmod(F.lit(10) - total % 10, F.lit(10))
    return F.coalesce(shaped & (check == F.substring(padded, 14, 1).try_cast("int")), F.lit(False))


def only_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def code_path(c: Column) -> Column:
    """Codes over eight characters are cut 3/3/3/rest; a nine-digit code has no rest."""
    t = F.trim(c)
    cut = F.rtrim(F.regexp_replace(t, r"^(\d{3})(\d{3})(\d{3})(.*)$", "$1/$2/$3/$4"), F.lit("/"))
    return F.when(F.length(t) <= 8, t).when(t.rlike(r"^\d{9}"), cut).otherwise(t)


def image_url(code: Column, ref: Column, size: int | str = 200) -> Column:
    shape = r"^([A-Za-z]{2,3})\.(\d+)$"
    r = F.trim(ref)
    return F.when(
        r.rlike(shape) & (F.trim(code) != ""),
        F.concat(F.lit(IMAGE_BASE + "/"), code_path(code), F.lit("/front_"),
                 F.lower(F.regexp_extract(r, shape, 1)), F.lit("."), F.regexp_extract(r, shape, 2),
                 F.lit(f".{size}.jpg")))


def image_ref(revisions: Column, lang: Column, lc: Column) -> Column:
    """``<lang>.<rev>`` of the front photo: own language, then ``lc``, then the first one.

    ``revisions`` maps a language to the revision as text, in document order.
    """
    def present(c: Column) -> Column:
        return F.when((c != "") & F.map_contains_key(revisions, c), c)

    chosen = F.coalesce(present(F.coalesce(lang, F.lit(""))), present(F.coalesce(lc, F.lit(""))),
                        F.try_element_at(F.map_keys(revisions), F.lit(1)))
    rev = F.trim(F.try_element_at(revisions, chosen))
    return F.when(rev.rlike(r"^\d+$") & chosen.rlike(r"^[A-Za-z]{2,3}$"), F.concat_ws(".", chosen, rev))


def catalog_priority(suggested: Column, held: Column) -> Column:
    """Suggested catalogue first if it is held, then the rest, then the suggested one anyway."""
    lead = F.when(F.array_contains(held, suggested), F.array(suggested)).otherwise(F.array().cast("array<string>"))
    tail = F.when(suggested.isNotNull(), F.array(suggested)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.coalesce(lead, F.array().cast("array<string>")), held, tail))


def strip_prefix(tag: Column) -> Column:
    return F.regexp_replace(tag, "^en:", "")


def e_number(c: Column) -> Column:
    """``E452(iv)``, ``E 452 IV`` and ``452iv`` are one number; ``14XX`` is a wildcard, not one."""
    s = F.regexp_replace(F.replace(F.upper(F.trim(c)), F.lit(" "), F.lit("")), "^E", "")
    s = F.regexp_replace(s, r"\((\w+)\)$", "$1")
    return F.when(s.rlike(r"^\d{3,4}[A-Z]*$"), F.lower(s))


def e_from_tag(tag: Column) -> Column:
    return F.nullif(F.regexp_extract(tag, r"^en:e(\d{3,4}[a-z]*)$", 1), F.lit(""))


TAG_SHAPE = r"^en:e(\d{3,4})([ivx]*)([a-z]*)$"


def tag_parts(tag: Column) -> Column:
    part = lambda i: F.when(tag.rlike(TAG_SHAPE), F.regexp_extract(tag, TAG_SHAPE, i))
    return F.struct(part(1).alias("number"), part(2).alias("roman"), part(3).alias("letters"))


E_RANGE = r"\bE\s?(\d{3,4})\s*[-–—]\s*(\d{3,4})\b"
E_SINGLE = r"\bE\s?(\d{3,4})(?!\d|\s*[-–—]\s*\d)"


def e_mentions(name: Column) -> Column:
    """E numbers a substance name covers: single ones and ranges written out."""
    pairs = F.arrays_zip(F.regexp_extract_all(name, F.lit(E_RANGE), F.lit(1)).alias("a"),
                         F.regexp_extract_all(name, F.lit(E_RANGE), F.lit(2)).alias("b"))
    typed = F.transform(pairs, lambda p: F.struct(p["a"].cast("int").alias("a"), p["b"].cast("int").alias("b")))
    sane = F.filter(typed, lambda p: (p["b"] > p["a"]) & (p["b"] - p["a"] < 200))
    ranges = F.flatten(F.transform(sane, lambda p: F.sequence(p["a"], p["b"])))
    single = F.regexp_extract_all(name, F.lit(E_SINGLE), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(F.transform(ranges, lambda e: e.cast("string")), single)))


CAS_SHAPE = r"(\d{2,7})\s*[-–—]\s*(\d{2})\s*[-–—]\s*(\d)"


def cas(c: Column) -> Column:
    """Spaces, dashes and leading zeros do not tell CAS numbers apart."""
    part = lambda i: F.regexp_extract(c, CAS_SHAPE, i)
    return F.when(c.rlike(CAS_SHAPE), F.concat_ws("-", part(1).cast("long").cast("string"), part(2), part(3)))


def year_parts(c: Column) -> Column:
    """``2025 online`` is the year 2025 and the note ``online``."""
    return F.struct(
        F.regexp_extract(c, r"(\d{4})", 1).try_cast("int").alias("year"),
        F.nullif(F.trim(F.regexp_replace(c, r"\d{4}", "")), F.lit("")).alias("note"))


def version_id(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")
