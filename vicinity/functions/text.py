"""Cleaning and normalising text, numbers, lots, money and dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col

def clean(c) -> Column:
    """Trimmed text; blank and null tokens become NULL."""
    text = F.regexp_replace(F.trim(col(c).cast("string")), "(?i)^(nan|none|null)$", "")
    return F.nullif(text, F.lit(""))


def first_of(*columns) -> Column:
    """The first non-empty of several columns."""
    return F.coalesce(*[clean(c) for c in columns])


def alias_of(available: list[str], *names: str) -> str | None:
    """Header lookup: exact (blanks and case ignored), then the first header that contains a name."""
    folded = {h.strip().lower().replace(" ", ""): h for h in available}
    wanted = [n.strip().lower().replace(" ", "") for n in names]
    for name in wanted:
        if name in folded:
            return folded[name]
    for name in wanted:
        for header, original in folded.items():
            if name and name in header:
                return original
    return None


def number(c) -> Column:
    """Finite double from text with thousands commas; anything else NULL."""
    text = F.regexp_replace(F.trim(col(c).cast("string")), ",", "")
    digits = F.regexp_extract(text, r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$", 0)
    return digits.try_cast("double")


def whole(c) -> Column:
    """Half-even integer of ``number``."""
    return F.rint(number(c)).cast("long")


def money(c) -> Column:
    """Whole units of 10,000 from text such as ``12,500만원``."""
    return whole(F.regexp_replace(col(c).cast("string"), r"[, ]|만원", ""))


def compatible(c) -> Column:
    """Compatibility-composed lower case: full-width forms, roman numerals and the like folded.

    ``normalize`` does not exist as a built-in, so the ranges that occur in names are mapped by
    rule: full-width ASCII to ASCII, ideographic blank to blank, roman numerals to letters,
    circled digits and letters and the unit signs to their plain forms.
    """
    full = "".join(chr(k) for k in range(0xFF01, 0xFF5F))
    plain = "".join(chr(k - 0xFEE0) for k in range(0xFF01, 0xFF5F))
    circled = "".join(chr(k) for k in range(0x2460, 0x2469))
    letters = "".join(chr(k) for k in range(0x24D0, 0x24EA)) + "".join(chr(k) for k in range(0x24B6, 0x24D0))
    digits = "123456789"
    alphabet = "".join(chr(k) for k in range(97, 123)) * 2
    plain_text = F.regexp_replace(F.trim(col(c).cast("string")), "(?i)^(nan|none|null)$", "")
    text = F.lower(F.translate(plain_text, full + circled + letters + "　ⅠⅤⅩⅰⅴⅹ", plain + digits + alphabet + " ivxivx"))
    # Compatibility forms (in lower case) of roman numerals and unit signs.
    many = {
        "ⅷ": "viii", "ⅶ": "vii", "ⅲ": "iii", "ⅻ": "xii", "ⅱ": "ii", "ⅳ": "iv", "ⅵ": "vi", "ⅸ": "ix", "ⅺ": "xi",
        "㎡": "m2", "㎏": "kg", "㎞": "km",
    }
    for sign, replacement in many.items():
        text = F.replace(text, F.lit(sign), F.lit(replacement))
    return text


def _no_brackets(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\([^)]*\)", ""), r"\[[^\]]*\]", "")


def normalize_name(c) -> Column:
    """Comparable name: brackets and the trailing word for "apartment" go, symbols go."""
    text = F.regexp_replace(_no_brackets(compatible(c)), "(아파트|apt)$", "")
    return F.coalesce(F.regexp_replace(text, "[^0-9a-z가-힣]", ""), F.lit(""))


def normalize_address(c) -> Column:
    text = F.regexp_replace(compatible(c), r"\([^)]*\)", "")
    text = F.regexp_replace(text, "^(서울특별시|서울시)", "")
    return F.coalesce(F.regexp_replace(text, "[^0-9a-z가-힣]", ""), F.lit(""))


def normalize_dong(c) -> Column:
    return F.coalesce(F.regexp_replace(clean(c), "[^0-9a-zA-Z가-힣]", ""), F.lit(""))


def normalize_match(c) -> Column:
    return F.lower(normalize_dong(c))


def normalize_search(c) -> Column:
    return F.lower(F.replace(F.coalesce(clean(c), F.lit("")), F.lit(" "), F.lit("")))


def squeeze(c) -> Column:
    return F.regexp_replace(clean(c), r"\s+", " ")


def lot_part(c) -> Column:
    """One half of a lot number without leading zeros; ``-`` is missing."""
    digits = F.regexp_replace(F.regexp_replace(col(c).cast("string"), "[^0-9]", ""), "^0+(?=[0-9])", "")
    return F.when(digits != "", digits).otherwise(F.nullif(clean(c), F.lit("-")))


def split_lot(c) -> tuple[Column, Column]:
    """``(bonbun, bubun)`` of ``123-4``; a bubun of 0 is missing, other shapes give NULLs."""
    text = clean(c)
    shape = text.rlike(r"^[0-9]+(-[0-9]+)?$")
    main = F.when(shape, lot_part(F.regexp_extract(text, r"^([0-9]+)", 1)))
    sub = F.when(shape, lot_part(F.regexp_extract(text, r"-([0-9]+)$", 1)))
    return main, F.when(sub != "0", sub)


def compose_lot(bonbun, bubun) -> Column:
    main, sub = lot_part(bonbun), lot_part(bubun)
    return F.when(main.isNotNull(), F.concat_ws("-", main, F.when(sub != "0", sub)))


def split_region(c) -> tuple[Column, Column, Column]:
    """``(sido, gu, dong)`` of a blank-separated region text; dong keeps its blanks."""
    parts = F.split(squeeze(c), " ")
    dong = F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), " "))
    return F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2)), dong


def address_tokens(c) -> tuple[Column, Column]:
    """``(gu, dong)``: the first word that ends in 구, the first that ends in 동 or 가."""
    words = F.split(squeeze(c), " ")
    gu = F.filter(words, lambda w: w.endswith("구"))
    dong = F.filter(words, lambda w: w.endswith("동") | w.endswith("가"))
    return F.try_element_at(gu, F.lit(1)), F.try_element_at(dong, F.lit(1))


def road_address(sido, gu, road) -> Column:
    """Full road address from its parts; ``-`` is missing, a full address stays."""
    road = clean(road)
    complete = road.contains(" ") & road.rlike("^(서울특별시|서울시)")
    composed = F.concat_ws(" ", F.coalesce(col(sido), F.lit("서울특별시")), col(gu), road)
    return F.when(road.isNull() | (road == "-"), F.lit(None)).when(complete, road).otherwise(composed)


def _date_of(year: Column, month: Column, day: Column) -> Column:
    return F.concat(year, F.lit("-"), month, F.lit("-"), day).try_cast("date")


def deal_date(full, year=None, month=None, day=None) -> Column:
    """Date from 8 digits, 6 digits (day 1), or separate year, month and day texts."""
    digits = F.regexp_replace(clean(full), "[^0-9]", "")
    eight = _date_of(F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))
    six = _date_of(F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.lit("01"))
    out = F.when(F.length(digits) >= 8, eight).when(F.length(digits) == 6, six)
    if year is None:
        return out
    y, m = whole(year).cast("string"), whole(month).cast("string")
    parts = _date_of(y, m, F.coalesce(whole(day).cast("string"), F.lit("1")))
    return out.otherwise(parts)


def contract_date(year_month, day) -> Column:
    ym = F.regexp_replace(F.coalesce(clean(year_month), F.lit("")), "[^0-9]", "")
    d = F.nullif(F.regexp_replace(F.coalesce(clean(day), F.lit("")), "[^0-9]", ""), F.lit(""))
    made = _date_of(F.substring(ym, 1, 4), F.substring(ym, 5, 2), F.coalesce(d, F.lit("1")))
    return F.when(F.length(ym) >= 6, made)


def is_rental(tenure, name) -> Column:
    return F.coalesce(col(tenure).contains("임대"), F.lit(False)) | F.coalesce(
        col(name).contains("임대"), F.lit(False)
    )


# Operator words dropped from line names.
LINE_OPERATORS = ["서울교통공사", "서울시메트로", "한국철도공사", "코레일", "도시철도", "수도권", "서울"]


def line_name(c) -> Column:
    text = clean(c)
    for word in LINE_OPERATORS:
        text = F.replace(text, F.lit(word), F.lit(""))
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def first_integer(c) -> Column:
    """The first run of digits as a number (thousands commas ignored); 0 when there is none."""
    digits = F.regexp_extract(F.regexp_replace(F.coalesce(col(c), F.lit("")), ",", ""), "([0-9]+)", 1)
    return F.coalesce(digits.try_cast("long"), F.lit(0))


def park_size(area) -> Column:
    area = col(area)
    return F.when(area >= 100000, "대형공원").when(area >= 10000, "중형공원").otherwise("소형공원")


def year_month(c) -> Column:
    """``YYYY.MM`` from dashed dates, eight-digit dates or their float text; else the text."""
    text = clean(c)
    head = F.split(text, " ")[0]
    dashed = F.split(head, "-")
    plain = F.regexp_replace(text, r"\.0$", "")
    return (
        F.when(text.contains("-") & (F.size(dashed) >= 2), F.concat_ws(".", dashed[0], dashed[1]))
        .when(plain.rlike("^[0-9]{6,}$"), F.concat_ws(".", F.substring(plain, 1, 4), F.substring(plain, 5, 2)))
        .otherwise(plain)
    )


def tag_text(c) -> Column:
    """Tags split on ``·``, ``/`` and ``,``, deduplicated in order, joined by `` · ``."""
    parts = F.transform(F.split(clean(c), "[·/,]"), lambda p: F.trim(p))
    return F.array_join(F.array_distinct(F.filter(parts, lambda p: p != "")), " · ")


def name_list(names, limit: int) -> Column:
    """The first ``limit`` distinct non-empty names."""
    kept = F.filter(F.transform(col(names), clean), lambda n: n.isNotNull())
    return F.slice(F.array_distinct(kept), 1, limit)


def compact_list(names, limit: int = 2, max_chars: int = 34) -> Column:
    """Names joined by commas; names are dropped from the end while the text is too long."""
    kept = name_list(names, limit)
    out = F.array_join(F.slice(kept, 1, 1), ", ")
    for n in range(2, limit + 1):
        text = F.array_join(F.slice(kept, 1, n), ", ")
        out = F.when(F.length(text) <= max_chars, text).otherwise(out)
    return out


# --- Name evidence for matching -----------------------------------------------------------
# Names too common to prove anything.
GENERIC_NAMES = [
    "아파트", "apt", "래미안", "자이", "푸르지오", "힐스테이트", "현대", "롯데캐슬", "아이파크",
    "주공", "한신", "삼성", "대우", "벽산", "동아", "신동아", "두산",
]


def number_tokens(normalized) -> Column:
    """Distinct numbers in a normalised name, without leading zeros, sorted."""
    found = F.regexp_extract_all(col(normalized), F.lit("([0-9]+)"), F.lit(1))
    trimmed = F.transform(found, lambda n: F.regexp_replace(n, "^0+(?=[0-9])", ""))
    return F.array_sort(F.array_distinct(trimmed))


def tokens_conflict(left, right) -> Column:
    """Both names have numbers, and not the same ones; ``number_tokens`` of each name, taken once."""
    left, right = col(left), col(right)
    return (F.size(left) > 0) & (F.size(right) > 0) & (left != right)


def tokens_asymmetry(left, right) -> Column:
    return (F.size(col(left)) > 0) != (F.size(col(right)) > 0)


def number_conflict(a, b) -> Column:
    return tokens_conflict(number_tokens(a), number_tokens(b))


def number_asymmetry(a, b) -> Column:
    return tokens_asymmetry(number_tokens(a), number_tokens(b))


def strip_dong(normalized_name, normalized_dong) -> Column:
    """The name without the dong it starts with (with or without its suffix)."""
    name, dong = col(normalized_name), col(normalized_dong)
    short = F.regexp_replace(dong, "(동|가|리)$", "")

    def starts(prefix: Column) -> Column:
        return (prefix != "") & name.startswith(prefix) & (F.length(name) > F.length(prefix) + 1)

    def rest(prefix: Column) -> Column:
        return F.substring(name, F.length(prefix) + 1, F.length(name))

    return F.when(starts(dong), rest(dong)).when(starts(short), rest(short)).otherwise(name)


def only_generic(*normalized) -> Column:
    """True when less than three letters are left of any name after common words go."""
    out = F.lit(False)
    for c in normalized:
        text = col(c)
        for word in GENERIC_NAMES:
            text = F.replace(text, F.lit(word), F.lit(""))
        out = out | (F.length(text) < 3)
    return out
