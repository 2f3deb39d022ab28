"""Personal data replaced by format-preserving Feistel pseudonyms.

Numbers and dates are found by pattern, validated, and permuted under a key inside their own format: a card
number stays a card number of the same length and layout with a right check digit, an address stays a valid
address, a date stays a date, and a social security number one that may be issued. Equal values have equal
pseudonyms in all documents, different values different ones.

Values of characters run through a Feistel network on their two halves: a round shifts every digit and letter
of one half inside its own alphabet by a keyed hash of the other half. IPv4 addresses are permuted on two
16-bit halves, dates on two mixed-radix halves of their day number. Where a result is not valid (a date out of
range, a social security number that is never issued), the permutation is applied again until it is.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spans import spliced

ROUNDS = 6
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: first and last code point of runs of letters; a letter outside ASCII moves inside its run, any other inside its 32 code points
LETTERS = ((0xC0, 0xD6), (0xE0, 0xF6), (0x391, 0x3A1), (0x3B1, 0x3C9), (0x410, 0x42F), (0x430, 0x44F), (0x531, 0x556), (0x561, 0x586), (0x5D0, 0x5EA), (0x621, 0x63A), (0x904, 0x939), (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))

# a local part is looked for only where a run of its characters begins, or where the match before ended, and is taken
# whole: so the time is linear in the text. A host name has at most 127 labels
EMAIL = "(?:\\G|(?<![\\p{L}0-9._%+-]))[\\p{L}0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++){0,125}\\.[A-Za-z]{2,}"
IPV4 = "(?<![0-9.])(?:[0-9]{1,3}\\.){3}[0-9]{1,3}(?![0-9]|\\.[0-9])"
DATE = "(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9])"
SSN = "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
NEVER_ISSUED = "^(000|666|9)|-00-|0000$"
PHONE = "(?<![0-9(])(?:\\+[0-9]{1,3}[ .-]?)?(?:\\([0-9]{3}\\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
LONG = "(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
ANY = "|".join([EMAIL, IPV4, DATE, SSN, PHONE, LONG])

_FIRST_DAY, _DAYS = -25567, 73049  # 1900-01-01 to 2099-12-31
_A, _B = 271, 270  # _A * _B is the least such product that holds all days


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.lit(key), *[p.cast("string") for p in parts]), 256)


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")


def _shift(half: Column, digest: Column) -> Column:
    """Every digit and letter of ``half`` moved on in its alphabet by the bytes of ``digest``, over and over."""

    def one(c: Column, k: Column) -> Column:
        by = F.conv(F.substr(digest, F.pmod(k, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        point = F.ascii(c)
        within = lambda first, size: F.decode(F.unhex(F.lpad(F.hex(first + F.pmod(point - first + by, F.lit(size))), 8, "0")), "UTF-32")
        move = lambda alphabet: F.substr(F.lit(alphabet), F.pmod(F.call_function("locate", c, F.lit(alphabet)) - 1 + by, F.lit(len(alphabet))) + 1, F.lit(1))
        out = F.when(c.between("0", "9"), move(DIGITS)).when(c.between("a", "z"), move(LOWER)).when(c.between("A", "Z"), move(UPPER))
        for a, b in LETTERS:
            out = out.when(point.between(a, b), within(F.lit(a), b - a + 1))
        return out.when(c.rlike("\\p{L}"), within(point.bitwiseAND(F.lit(~31)), 32)).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(half, ""), lambda c: c != ""), one), "")


def feistel_text(value: Column, key: str) -> Column:
    """``value`` permuted among the strings of its own shape; its length, case and signs stay."""
    cut = F.floor(F.length(value) / 2).cast("int")
    begin = F.struct(F.substr(value, F.lit(1), cut).alias("l"), F.substr(value, cut + 1, F.length(value)).alias("r"))

    def turn(s: Column, k: Column) -> Column:
        even = k % 2 == 0
        return F.struct(F.when(even, _shift(s["l"], _digest(key, k, s["r"]))).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(_shift(s["r"], _digest(key, k, s["l"]))).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, turn, lambda s: F.concat(s["l"], s["r"]))


def feistel_number(value: Column, a: int, b: int, key: str) -> Column:
    """A bigint below a * b permuted among those numbers."""
    begin = F.struct(F.floor(value / b).cast("bigint").alias("l"), F.pmod(value, F.lit(b)).cast("bigint").alias("r"))

    def turn(s: Column, k: Column) -> Column:
        even = k % 2 == 0
        return F.struct(F.when(even, F.pmod(s["l"] + _number(_digest(key, k, s["r"])), F.lit(a))).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(F.pmod(s["r"] + _number(_digest(key, k, s["l"])), F.lit(b))).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, turn, lambda s: s["l"] * b + s["r"])


def _walked(value: Column, permute, valid) -> Column:
    """``permute`` applied until ``valid``: a permutation of the valid values if ``value`` is one. Where one in eight
    results is not valid, 64 steps miss the end with a chance of 1e-57."""
    return F.aggregate(F.sequence(F.lit(2), F.lit(64)), permute(value), lambda x, _: F.when(valid(x), x).otherwise(permute(x)))


def luhn_sum(digits: Column) -> Column:
    """Sum of the Luhn algorithm over a string of digits whose last one counts once."""
    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    value = lambda c, k: F.when(k % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(each, value), F.lit(0), lambda s, x: s + x)


def _layout(pattern: Column, digits: Column) -> Column:
    """``digits`` poured into the digit places of ``pattern``."""
    begin = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(s: Column, c: Column) -> Column:
        own = c.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(own, F.substr(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + own.cast("int")).alias("at"))

    return F.aggregate(F.filter(F.split(pattern, ""), lambda c: c != ""), begin, put, lambda s: s["out"])


def _day(value: Column) -> Column:
    iso = F.try_to_date(value, "yyyy-MM-dd")
    return F.unix_date(F.coalesce(iso, F.try_to_date(value, "dd/MM/yyyy"), F.try_to_date(value, "MM/dd/yyyy")))


def kind_of(value: Column) -> Column:
    """The validated kind of a match of ``ANY``, or null: then it stays as it is."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    octets = F.transform(F.split(value, "\\."), lambda x: x.cast("int"))
    return (
        F.when(F.contains(value, F.lit("@")), "email")
        .when(value.rlike(f"^{IPV4}$"), F.when(F.array_max(octets) <= 255, "ipv4"))
        .when(value.rlike(f"^{DATE}$"), F.when((_day(value) >= _FIRST_DAY) & (_day(value) < _FIRST_DAY + _DAYS), "date"))
        .when(value.rlike(f"^{SSN}$"), F.when(~value.rlike(NEVER_ISSUED), "ssn"))
        .when(F.length(digits) >= 13, F.when(luhn_sum(digits) % 10 == 0, "card"))
        .when(value.rlike(f"^{PHONE}$"), "phone")
    )


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    body = feistel_text(F.substr(digits, F.lit(1), F.length(digits) - 1), f"{key}/card")
    check = F.pmod(F.lit(10) - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    octet = lambda k: F.element_at(F.split(value, "\\."), k).cast("bigint")
    packed = feistel_number(octet(1) * 16777216 + octet(2) * 65536 + octet(3) * 256 + octet(4), 65536, 65536, f"{key}/ipv4")
    address = F.concat_ws(".", *[F.pmod(F.shiftrightunsigned(packed, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])
    walk = _walked((_day(value) - _FIRST_DAY).cast("bigint"), lambda x: feistel_number(x, _A, _B, f"{key}/date"), lambda x: x < _DAYS)
    moved = F.date_from_unix_date((walk + _FIRST_DAY).cast("int"))
    date = F.when(F.contains(value, F.lit("-")), F.date_format(moved, "yyyy-MM-dd")).when(F.try_to_date(value, "dd/MM/yyyy").isNotNull(), F.date_format(moved, "dd/MM/yyyy")).otherwise(F.date_format(moved, "MM/dd/yyyy"))
    local = feistel_text(F.substring_index(value, "@", 1), f"{key}/email")
    return (
        F.when(kind == "card", _layout(value, F.concat(body, check)))
        .when(kind == "ipv4", address)
        .when(kind == "date", date)
        .when(kind == "ssn", _walked(value, lambda x: feistel_text(x, f"{key}/ssn"), lambda x: ~x.rlike(NEVER_ISSUED)))
        .when(kind == "phone", F.concat(F.regexp_extract(value, "^(\\+[0-9]{1,3}[ .-]?)?", 0), feistel_text(F.regexp_replace(value, "^\\+[0-9]{1,3}[ .-]?", ""), f"{key}/number")))
        .when(kind == "email", F.concat(local, F.lit("@"), F.substring_index(value, "@", -1)))
    )


def pseudonymise(docs: DataFrame, key: str | None = None, text_column: str = "text") -> DataFrame:
    """Per row of ``docs(doc_id, text, ...)``: ``doc_id, text, n_values, kinds, values``.

    ``text`` with every validated value replaced; ``kinds`` names the replaced ones in order, ``values`` holds their
    pseudonyms. Matches that fail validation stay. ``key`` is the secret of the permutations; without one a random key
    is drawn for this call, so values are linked across its documents and with nothing else. Null texts stay null with
    no values; empty texts, repeated rows, null ids and an empty table pass through. Very long texts are searched whole,
    in time linear in their length. Other columns are not looked at.
    """
    key = secrets.token_hex(16) if key is None else key
    text = F.col(text_column)
    found = F.when(text.rlike(ANY), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    seen = docs.select("doc_id", text.alias("text"), F.coalesce(found, F.array().cast("array<string>")).alias("found"))

    def replaced(v: Column) -> Column:
        kind = kind_of(v)
        return F.struct(v.alias("was"), kind.alias("kind"), F.when(kind.isNotNull(), pseudonym(v, kind, key)).alias("new"))

    done = seen.select("doc_id", "text", F.when(F.size("found") > 0, F.transform("found", replaced)).alias("done"))
    swapped = spliced(F.col("text"), ANY, F.transform("done", lambda x: F.coalesce(x["new"], x["was"])))
    hit = F.coalesce(F.filter("done", lambda x: x["kind"].isNotNull()), F.array().cast("array<struct<was:string,kind:string,new:string>>"))
    return done.select("doc_id", F.when(F.col("done").isNotNull(), swapped).otherwise(F.col("text")).alias("text"), F.size(hit).cast("bigint").alias("n_values"), F.transform(hit, lambda x: x["kind"]).alias("kinds"), F.transform(hit, lambda x: x["new"]).alias("values"))
