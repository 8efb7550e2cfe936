"""PII: format-preserving Feistel pseudonyms, in DataFrame expressions only.

Card numbers (Luhn), IBANs (mod 97), phone numbers with a North American or any other country code, social security
numbers, IPv4 addresses, calendar dates and the local parts of mail addresses, of any length and script, are found by one pattern, validated, and replaced by the value that a keyed permutation
of their format gives. A value is a list of symbols with a radix each (digits, octets, two factors of the days of a
400-year cycle); every round adds a keyed hash of one half to the other half, symbol by symbol and modulo its radix.
That is a permutation, so equal values get equal pseudonyms in every document and in every way of writing them,
different values never collide, and whoever holds the key can go back. Check digits and valid dates are kept valid.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "intl", "card")

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}\p{M}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "intl": r"(?<![0-9A-Za-z+])\+[1-9](?:[ .()-]{0,2}[0-9]){7,14}(?![0-9])",
    "card": r"(?<![0-9A-Za-z-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z-])",
}
ANY = "|".join(PATTERNS[k] for k in KINDS)

#: Country codes of one and of two digits; all others have three.
SHORT_CODES = "1|7"
LONG_CODES = "20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|91|92|93|94|95|98"

#: The Gregorian calendar repeats after 146097 = 189 * 773 days; cycles begin on 1600-01-01.
CYCLE, CYCLE_RADICES, CYCLE_START = 146097, (189, 773), "1600-01-01"

Expr = Callable[[Column], Column]


def _let(value: Column, body: Expr) -> Column:
    """body with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _ints(*values: int) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _chars(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, F.lit(1)))


def _digits(s: Column) -> Column:
    return F.transform(F.filter(_chars(s), lambda c: c.between("0", "9")), lambda c: c.cast("int"))


def permute(values: Column, radices: Column, tweak: Column, key: str, inverse: bool = False) -> Column:
    """Alternating Feistel rounds over a non-empty array of symbols, each below its radix; inverse undoes them."""
    half = F.floor(F.size(values) / 2).cast("int")

    def step(now: Column, turn: Column) -> Column:
        front = turn % 2 == 0
        fixed = F.when(front, F.slice(now, half + 1, F.size(now) - half)).otherwise(F.slice(now, F.lit(1), half))
        seed = F.concat_ws("|", F.lit(key), tweak, turn.cast("string"), F.array_join(fixed.cast("array<string>"), ","))
        shift = lambda i: F.conv(F.substring(F.sha2(F.concat_ws("|", seed, i.cast("string")), 256), 1, 7), 16, 10).cast("int")
        sign = -1 if inverse else 1
        return F.transform(now, lambda v, i: F.when((i < half) == front, F.pmod(v + sign * shift(i), F.element_at(radices, i + 1))).otherwise(v))

    turns = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    return F.aggregate(_ints(*turns), values.cast("array<int>"), step)


def _put_digits(shape: Column, digits: Column, skip: Column) -> Column:
    """shape with its digits, but for the first skip ones, replaced in order."""
    before = lambda i: F.length(F.regexp_replace(F.substring(shape, F.lit(1), i), "[^0-9]", ""))
    return F.concat_ws("", F.transform(F.sequence(F.lit(1), F.length(shape)), lambda i: _let(F.substring(shape, i, F.lit(1)), lambda c: F.when(c.between("0", "9") & (before(i) > skip), F.element_at(digits, (before(i) - skip).cast("int")).cast("string")).otherwise(c))))


def luhn_sum(digits: Column, from_right: int = 0) -> Column:
    """Luhn sum of digits; from_right is the place of the last digit given, counted from the check digit."""
    n = F.size(digits)
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.transform(digits, lambda d, i: F.when((n - 1 - i + from_right) % 2 == 1, twice(d)).otherwise(d)), F.lit(0), lambda s, d: s + d)


def _card(s: Column, key: str) -> Column:
    """The first digit (kind of issuer) stays, the middle is permuted, the check digit is computed anew."""

    def valid(d: Column) -> Column:
        n = F.size(d)
        inner = permute(F.slice(d, F.lit(2), n - 2), F.array_repeat(F.lit(10), n - 2), F.concat_ws("|", F.lit("card"), F.element_at(d, 1).cast("string")), key)
        body = F.concat(F.slice(d, 1, 1), inner)
        return _let(body, lambda b: F.concat(b, F.array(F.pmod(-luhn_sum(b, 1), F.lit(10)))))

    return _let(_digits(s), lambda d: F.when(luhn_sum(d) % 10 == 0, _put_digits(s, valid(d), F.lit(0))))


def _phone(s: Column, key: str) -> Column:
    """Ten digits whose area and exchange begin with 2 to 9; a country code stays."""
    low = _ints(2, 0, 0, 2, 0, 0, 0, 0, 0, 0)
    radices = _ints(8, 10, 10, 8, 10, 10, 10, 10, 10, 10)

    def moved(d: Column) -> Column:
        own = F.slice(d, F.size(d) - 9, F.lit(10))
        fresh = F.zip_with(permute(F.zip_with(own, low, lambda a, b: a - b), radices, F.lit("phone"), key), low, lambda a, b: a + b)
        return _put_digits(s, fresh, F.size(d) - 10)

    return _let(_digits(s), moved)


def _ssn(s: Column, key: str) -> Column:
    """Groups are permuted as numbers of their valid ranges: 001-899 without 666, 01-99, 0001-9999."""

    def moved(g: Column) -> Column:
        area = F.element_at(g, 1)
        values = F.array(area - F.when(area > 666, 2).otherwise(1), F.element_at(g, 2) - 1, F.element_at(g, 3) - 1)

        def put(p: Column) -> Column:
            first = F.element_at(p, 1)
            return F.format_string("%03d-%02d-%04d", first + F.when(first >= 665, 2).otherwise(1), F.element_at(p, 2) + 1, F.element_at(p, 3) + 1)

        return _let(permute(values, _ints(898, 99, 9999), F.lit("ssn"), key), put)

    return _let(F.split(s, "-").cast("array<int>"), moved)


def _ip(s: Column, key: str) -> Column:
    return F.array_join(permute(F.split(s, r"\.").cast("array<int>"), _ints(256, 256, 256, 256), F.lit("ip"), key).cast("array<string>"), ".")


def _date(s: Column, key: str) -> Column:
    """Valid dates of 1600 to 9999 move within their 400-year cycle and keep their way of writing."""
    origin = F.lit(CYCLE_START).cast("date")

    def written(shape: str) -> Column:
        def moved(days: Column) -> Column:
            cycle = F.floor(days / CYCLE).cast("int")
            inside = (days - cycle * CYCLE).cast("int")
            split = F.array(F.floor(inside / CYCLE_RADICES[1]).cast("int"), (inside % CYCLE_RADICES[1]).cast("int"))
            new = permute(split, _ints(*CYCLE_RADICES), F.concat(F.lit("date|"), cycle.cast("string")), key)
            return _let(new, lambda p: F.date_format(F.date_add(origin, (cycle * CYCLE + F.element_at(p, 1) * CYCLE_RADICES[1] + F.element_at(p, 2)).cast("int")), shape))

        day = F.try_to_timestamp(s, F.lit(shape)).cast("date")
        valid = F.coalesce(F.date_format(day, shape) == s, F.lit(False)) & (day >= origin)
        return F.when(valid, _let(F.datediff(day, origin), moved))

    return F.when(s.contains("-"), written("yyyy-MM-dd")).when(s.contains("/"), written("MM/dd/yyyy")).otherwise(written("dd.MM.yyyy"))


def _intl(s: Column, key: str) -> Column:
    """Digits after the country code; whether the first of them is a zero stays as it is."""
    bare = F.regexp_replace(s, "[^0-9]", "")
    code = F.when(bare.rlike(f"^(?:{SHORT_CODES})"), 1).when(bare.rlike(f"^(?:{LONG_CODES})"), 2).otherwise(3)

    def moved(d: Column) -> Column:
        own = F.slice(d, code + 1, F.size(d) - code)
        low = F.transform(own, lambda v, i: F.when((i == 0) & (v > 0), 1).otherwise(0))
        radix = F.transform(own, lambda v, i: F.when(i > 0, 10).when(v > 0, 9).otherwise(1))
        tweak = F.concat(F.lit("intl|"), F.substring(bare, F.lit(1), code))
        return _put_digits(s, F.zip_with(permute(F.zip_with(own, low, lambda a, b: a - b), radix, tweak, key), low, lambda a, b: a + b), code)

    return _let(_digits(s), moved)


def _mod97(chars: Column) -> Column:
    """Remainder of an account number's characters, letters counted as 10 to 35."""

    def step(rest: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (rest * 10 + c.cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(chars, F.lit(0), step)


def _iban(s: Column, key: str) -> Column:
    """Country and grouping stay, the account is permuted letter to letter and digit to digit, check digits are computed anew."""
    bare = F.replace(s, F.lit(" "), F.lit(""))
    country = F.substring(bare, 1, 2)

    def moved(account: Column) -> Column:
        low = F.transform(account, lambda c: F.when(c.between("0", "9"), 48).otherwise(65))
        radix = F.transform(account, lambda c: F.when(c.between("0", "9"), 10).otherwise(26))
        values = F.zip_with(account, low, lambda c, b: F.ascii(c) - b)
        new = F.zip_with(permute(values, radix, F.concat(F.lit("iban|"), country), key), low, lambda v, b: F.char(v + b))
        check = lambda n: F.lpad((98 - _mod97(F.concat(n, _chars(F.concat(country, F.lit("00")))))).cast("string"), 2, "0")
        return _let(new, lambda n: _let(F.concat(_chars(F.concat(country, check(n))), n), lambda flat: _grouped(s, flat)))

    account = _chars(F.substring(bare, F.lit(5), F.length(bare) - 4))
    valid = _mod97(F.concat(account, _chars(F.substring(bare, 1, 4)))) == 1
    return F.when(valid, _let(account, moved))


def _grouped(shape: Column, flat: Column) -> Column:
    """flat's characters in place of those of shape that are no spaces."""
    before = lambda i: F.length(F.replace(F.substring(shape, F.lit(1), i), F.lit(" "), F.lit("")))
    return F.concat_ws("", F.transform(F.sequence(F.lit(1), F.length(shape)), lambda i: F.when(F.substring(shape, i, F.lit(1)) == " ", " ").otherwise(F.element_at(flat, before(i)))))


def _letter(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")


def _email(s: Column, key: str) -> Column:
    """The local part is permuted character by character, the domain stays.

    Letters move to letters and digits to digits; characters beyond ASCII move among the 64 of their block.
    """
    local, domain = F.substring_index(s, "@", 1), F.substring_index(s, "@", -1)

    def moved(chars: Column) -> Column:
        wide = lambda c: F.ascii(c) >= 128
        low = F.transform(chars, lambda c: F.when(c.between("0", "9"), 48).when(c.between("a", "z"), 97).when(c.between("A", "Z"), 65).when(wide(c), F.ascii(c) - F.ascii(c) % 64).otherwise(F.ascii(c)))
        radix = F.transform(chars, lambda c: F.when(c.between("0", "9"), 10).when(c.rlike("[A-Za-z]"), 26).when(wide(c), 64).otherwise(1))
        values = F.zip_with(chars, low, lambda c, b: F.ascii(c) - b)
        new = F.zip_with(permute(values, radix, F.concat(F.lit("email|"), F.lower(domain)), key), low, lambda v, b: F.when(v + b < 128, F.char(v + b)).otherwise(_letter(v + b)))
        return F.concat(F.concat_ws("", new), F.lit("@"), domain)

    return _let(_chars(local), moved)


def kind_of(s: Column) -> Column:
    """The kind of a found string by its form; validation comes after."""
    whole = {k: s.rlike(f"^(?:{PATTERNS[k]})$") for k in KINDS}
    out = F.lit(None).cast("string")
    for k in reversed(KINDS):
        out = F.when(whole[k], F.lit(k)).otherwise(out)
    return out


def pseudonym(s: Column, kind: Column, key: str) -> Column:
    """Pseudonym of a found string, null when validation fails."""
    forms = {"email": _email, "iban": _iban, "intl": _intl, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}
    out = F.lit(None).cast("string")
    for k in reversed(KINDS):
        out = F.when(kind == k, forms[k](s, key)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text with pseudonyms, n_replaced, kinds (sorted, distinct).

    Strings that look like a kind but fail its validation stay as they are. Null texts stay null with nothing replaced,
    empty ones stay empty. Null or repeated ids pass through row by row, equal values get equal pseudonyms in all rows;
    other columns of docs are not read; an empty table gives an empty result. A text of any length is handled whole: what
    is found is bounded by it alone. No shuffle, no Python.
    """
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = src.withColumn("_found", F.regexp_extract_all("_text", F.lit(ANY), F.lit(0)))
    swapped = F.transform("_found", lambda s: _let(kind_of(s), lambda k: _let(pseudonym(s, k, key), lambda p: F.struct(F.coalesce(p, s).alias("to"), F.when(p.isNotNull(), k).alias("kind")))))
    some = F.coalesce(F.size("_found"), F.lit(0)) > 0
    named = found.withColumn("_swap", F.when(some, swapped))
    gaps = F.split("_text", ANY, -1)
    pieces = F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.try_element_at(F.col("_swap.to"), i + 1), F.lit(""))))
    kinds = F.coalesce(F.filter("_swap.kind", lambda k: k.isNotNull()), F.array().cast("array<string>"))
    return named.select(
        F.col("_id").alias(id_col),
        F.when(some, F.concat_ws("", pieces)).otherwise(F.col("_text")).alias(text_col),
        F.size(kinds).alias("n_replaced"),
        F.array_sort(F.array_distinct(kinds)).alias("kinds"),
    )
