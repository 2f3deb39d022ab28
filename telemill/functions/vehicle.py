"""Vehicle identification numbers and trouble codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VIN_PATTERN = "^[A-HJ-NPR-Z0-9]{17}$"
DTC_PATTERN = "^[PCBU][0-3][0-9A-F]{3}$"
DTC_SCAN = "(?<![A-Z0-9])([PCBU][0-3][0-9A-F]{3})(?![A-Z0-9])"

# fixed values: position weights, and letter values written as two aligned strings
WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)
LETTERS = "ABCDEFGHJKLMNPRSTUVWXYZ"
VALUES = "12345678123457923456789"
MARK = "TMLL7"
SYSTEMS = {"P": "powertrain", "C": "chassis", "B": "body", "U": "network"}


def vin_digits(vin: Column) -> Column:
    """Letters of a number as their digits."""
    return F.translate(vin, LETTERS, VALUES)


def check_digit(vin: Column, digits: Column | None = None) -> Column:
    """Expected ninth character. The sum is unrolled, so it stays inside whole-stage codegen; ``digits`` is a column that holds
    ``vin_digits`` already, as they are used for every place."""
    digits = vin_digits(vin) if digits is None else digits
    total = None
    for k, weight in enumerate(WEIGHTS):
        if weight:
            term = F.substring(digits, k + 1, 1).try_cast("int") * weight
            total = term if total is None else total + term
    rest = total % 11
    return F.when(rest == 10, "X").otherwise(rest.cast("string"))


def is_valid_vin(vin: Column, digits: Column | None = None) -> Column:
    shaped = F.when(vin.rlike(VIN_PATTERN) & (F.length(vin) == 17), vin)
    return F.coalesce(F.substring(shaped, 9, 1) == check_digit(shaped, digits), F.lit(False))


def with_check_digit(vin: Column) -> Column:
    return F.concat(F.substring(vin, 1, 8), check_digit(vin), F.substring(vin, 10, 8))


def make_vin(maker: str, serial: Column) -> Column:
    """A generated number: three characters of the maker, this library's mark, and eight digits of the serial number."""
    return with_check_digit(F.concat(F.lit(maker + MARK + "0"), F.lpad(F.pmod(serial, F.lit(100_000_000)).cast("string"), 8, "0")))


def is_valid_dtc(code: Column) -> Column:
    return F.coalesce(code.rlike(DTC_PATTERN), F.lit(False))


def extract_dtcs(text: Column) -> Column:
    """Unique codes in first-seen order."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(DTC_SCAN), F.lit(1))))


def describe_dtc(code: Column) -> Column:
    system = F.element_at(F.create_map(*[F.lit(x) for kv in SYSTEMS.items() for x in kv]), F.substring(code, 1, 1))
    scope = F.when(F.substring(code, 2, 1).isin("0", "2"), "generic").otherwise("manufacturer")
    return F.when(is_valid_dtc(code), F.struct(code.alias("code"), system.alias("system"), scope.alias("scope")))
