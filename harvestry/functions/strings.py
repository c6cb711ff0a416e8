"""Names, phrases and number formats."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from harvestry.functions.maths import half_up

# Headline patterns with event type, direction and magnitude, the first match counts.
SHOCK_PATTERNS = (
    (r"export.*(prohibit|ban|restrict)", "export_ban", -1, 3),
    (r"minimum export price|MEP", "export_ban", -1, 2),
    (r"export.*(allow|permit|lift)", "export_allowed", 1, 3),
    (r"stock limit|stockholding limit", "stock_limit", -1, 2),
    (r"import duty.*(increase|hike|raise)", "import_duty", 1, 2),
    (r"import duty.*(cut|reduce|remove)", "import_duty", -1, 2),
    (r"buffer.*(release|offload|disposal)", "buffer_release", -1, 2),
    (r"minimum support price.*(increase|hike)", "msp_hike", 1, 1),
)
QUANTITY = r"(\d+(?:\.\d+)?)\s*(क्विंटल|quintal|qtl|kg|किलो)"
YES = r"(?i)(^|\s)(हो|होय|हा|yes|y|ok|ठीक)($|\s)"
NO = r"(?i)(^|\s)(नाही|नको|no|n)($|\s)"
ADVICE = r"(?i)विकू|भाव|सल्ला|sell|price|advice|rate"


#: Hangul syllables stand in the order of their first, middle and last parts (19, 21, and 27 or none).
HANGUL, LEADS, VOWELS, TAILS = 0xAC00, 0x1100, 0x1161, 0x11A7
SYLLABLES = 19 * 21 * 28


@cache
def decompositions() -> tuple[str, str, str, str]:
    """Code points that compatibility decomposition without combining marks changes: those that become one sign or none,
    as texts for translate; those that become several, as one text of pairs for str_to_map, and as a pattern. Hangul is left out of the pairs."""
    one, plain, none, several, ranges = [], [], [], [], []
    for code in range(sys.maxunicode + 1):
        sign = chr(code)
        left = "".join(c for c in unicodedata.normalize("NFKD", sign) if not unicodedata.combining(c))
        if left == sign:
            continue
        if len(left) == 1:
            one.append(sign)
            plain.append(left)
        elif left:
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
            if not 0 <= code - HANGUL < SYLLABLES:
                several.append(f"{sign}\x02{left}")
        else:
            none.append(sign)
    pattern = "[" + "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in ranges) + "]"
    # translate drops the signs that have no partner.
    return "".join(one + none), "".join(plain), "\x01".join(several), pattern


def without_marks(text: Column) -> Column:
    """Compatibility decomposition (NFKD) without combining marks; of the marks' order nothing is left, so each code point goes by itself.

    Only texts with a sign that becomes several are taken apart.
    """
    signs, plain, several, pattern = decompositions()
    parts = F.str_to_map(F.lit(several), F.lit("\x01"), F.lit("\x02"))
    row = lambda first, n: F.array(*(F.lit(chr(first + k)) for k in range(n)))

    def taken_apart(c: Column) -> Column:
        k = F.ascii(c) - HANGUL
        tail = F.when(k % 28 == 0, "").otherwise(F.get(row(TAILS, 28), k % 28))
        syllable = F.concat(F.get(row(LEADS, 19), F.floor(k / 588).cast("int")), F.get(row(VOWELS, 21), F.floor(k % 588 / 28).cast("int")), tail)
        return F.when(k.between(0, SYLLABLES - 1), syllable).when(c.rlike(pattern), F.try_element_at(parts, c)).otherwise(c)

    apart = F.array_join(F.transform(F.split(text, ""), taken_apart), "")
    return F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(F.translate(F.when(text.rlike(pattern), apart).otherwise(text), signs, plain))


def normalise(name: Column) -> Column:
    """Without marks, lower-cased, other signs than letters, digits and _ blanks, blanks squeezed."""
    plain = F.lower(without_marks(name))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def sorted_tokens(name: Column) -> Column:
    return F.array_join(F.array_sort(F.split(name, " ")), " ")


#: Longest text whose places fit the bits of a long, with room for a carry.
BITS = 61


def letter_places(text: Column) -> Column:
    """map<letter, bits>: at which places of a text of BITS letters at most each of its letters stands."""
    letters = F.split(text, "")

    def places(c: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.length(text) - 1), F.lit(0).cast("long"), lambda bits, j: bits + F.when(F.get(letters, j) == c, F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(0))

    found = F.map_from_entries(F.transform(F.array_distinct(letters), lambda c: F.struct(c, places(c))))
    return F.when(F.length(text).between(1, BITS), found)


def common_by_bits(a: Column, places: Column, length: Column) -> Column:
    """Length of the longest common subsequence of a and a text of so many letters, given its letter_places: a row of the usual table in one long."""
    full = F.call_function("shiftleft", F.lit(1).cast("long"), length) - 1

    def row(above: Column, c: Column) -> Column:
        met = above.bitwiseAND(F.coalesce(F.try_element_at(places, c), F.lit(0).cast("long")))
        return (above + met).bitwiseOR(above - met).bitwiseAND(full)

    return length - F.bit_count(F.aggregate(F.split(a, ""), full, row))


def longest_common(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: by bits, and by rows of the usual table for texts too long for them."""
    letters = F.split(b, "")
    start = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))

    def row(above: Column, c: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            best = F.when(F.element_at(letters, j) == c, F.element_at(above, j) + 1).otherwise(F.greatest(F.element_at(done, -1), F.element_at(above, j + 1)))
            return F.array_append(done, best)

        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)), cell)

    # The places are bound once, not found again for each letter.
    by_bits = F.element_at(F.transform(F.array(letter_places(b)), lambda p: common_by_bits(a, p, F.length(b))), 1)
    by_rows = F.element_at(F.aggregate(F.split(a, ""), start, row), -1)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).when(F.length(b) <= BITS, by_bits).otherwise(by_rows)


def numbered_grams(text: Column, q: int = 2) -> Column:
    """Runs of q letters, each with how often it stood before, so that equal ones count as often as they occur."""
    runs = F.when(F.length(text) >= q, F.transform(F.sequence(F.lit(1), F.length(text) - (q - 1)), lambda i: F.substring(text, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))
    # In order, equal runs stand beside each other: the distance from the first is the number. The runs are bound once, not made again for each.
    numbered = lambda s: F.transform(s, lambda g, i: F.concat(g, (i + 1 - F.array_position(s, g)).cast("string")))
    return F.element_at(F.transform(F.array(F.sort_array(runs)), numbered), 1)


def token_sort_ratio(a: Column, b: Column) -> Column:
    """100 * 2 * LCS / (lengths), of the names with sorted tokens."""
    x, y = sorted_tokens(a), sorted_tokens(b)
    total = F.length(x) + F.length(y)
    return F.when(total == 0, 100.0).otherwise(200.0 * longest_common(x, y) / total)


def intent(text: Column) -> Column:
    """quantity (in quintals), yes, no, advice or other."""
    return (
        F.when(text.rlike("(?i)" + QUANTITY), "quantity").when(text.rlike(ADVICE), "advice").when(text.rlike(YES), "yes").when(text.rlike(NO), "no").otherwise("other")
    )


def quantity_qtl(text: Column) -> Column:
    value = F.regexp_extract(text, "(?i)" + QUANTITY, 1).try_cast("double")
    return F.when(F.lower(F.regexp_extract(text, "(?i)" + QUANTITY, 2)).isin("kg", "किलो"), value / 100).otherwise(value)


def shock_class(headline: Column) -> Column:
    """struct(event_type, direction, magnitude) of the first pattern that fits; null if none."""
    out = F.lit(None).cast("struct<event_type:string,direction:int,magnitude:int>")
    for pattern, kind, direction, magnitude in reversed(SHOCK_PATTERNS):
        out = F.when(headline.rlike("(?i)" + pattern), F.struct(F.lit(kind).alias("event_type"), F.lit(direction).alias("direction"), F.lit(magnitude).alias("magnitude"))).otherwise(out)
    return out


def indian_digits(whole: Column) -> Column:
    """A whole number's digits in groups of three, then two."""
    digits = F.abs(whole).cast("string")
    head = F.substring(digits, F.lit(1), F.greatest(F.length(digits) - 3, F.lit(0)))
    grouped = F.reverse(F.regexp_replace(F.reverse(head), r"(\d\d)(?=\d)", "$1,"))
    sign = F.when(whole < 0, "-").otherwise("")
    return F.concat(sign, F.when(F.length(digits) > 3, F.concat(grouped, F.lit(","), F.right(digits, F.lit(3)))).otherwise(digits))


def compact_rupees(value: Column) -> Column:
    size = F.abs(value)
    return (
        F.when(size >= 1e7, F.concat(F.lit("₹"), F.format_string("%.2f", half_up(value / 1e7, 2)), F.lit(" Cr")))
        .when(size >= 1e5, F.concat(F.lit("₹"), F.format_string("%.2f", half_up(value / 1e5, 2)), F.lit(" L")))
        .when(size >= 1e3, F.concat(F.lit("₹"), F.format_string("%.1f", half_up(value / 1e3, 1)), F.lit("K")))
        .otherwise(F.concat(F.lit("₹"), F.floor(value + 0.5).cast("string")))
    )


def padded_id(prefix: str, n: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"))
