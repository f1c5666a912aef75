"""Text rules: labels of hours, items, menu lines and amounts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# The four bands of the trading day, the length that fits a drawn
# menu line, and the number of lines in a column of a menu.
BAND_NAMES = {1: "breakfast", 2: "early_lunch", 3: "late_lunch", 4: "afternoon"}
CROPPED_LENGTH = 28
LINES_PER_COLUMN = 6


def band_name(number: Column) -> Column:
    pairs = [F.lit(part) for band in BAND_NAMES.items() for part in band]
    return F.try_element_at(F.create_map(*pairs), number)


def hour_label(hour: Column) -> Column:
    """``9am``, ``12pm``, ``13pm``: the 24-hour number with am up to 11."""
    return F.concat(
        hour.cast("string"), F.when(hour > 11, F.lit("pm")).otherwise(F.lit("am"))
    )


def hour_cups_label(hour: Column, cups: Column) -> Column:
    return F.concat(
        hour_label(hour), F.lit(" ["), cups.cast("string"), F.lit(" cups sold]")
    )


def hours_text(hours: Column) -> Column:
    """Comma list of an array of hours, earliest first."""
    return F.array_join(F.transform(F.sort_array(hours), hour_label), ", ")


def item_label(name: Column, size: Column, flavour: Column) -> Column:
    """Name, size and flavour without separator; a NULL flavour adds nothing."""
    return F.concat(name, size, F.coalesce(flavour, F.lit("")))


def title_case(text: Column) -> Column:
    """Upper-case every letter that does not follow one, lower-case the rest.

    Only letters that have two cases count as such.
    """
    pieces = F.split(F.lower(text), r"(?<=[^\p{Lu}\p{Ll}\p{Lt}])")
    return F.array_join(
        F.transform(
            pieces, lambda piece: F.concat(F.upper(piece.substr(1, 1)), F.substr(piece, F.lit(2)))
        ),
        "",
    )


def menu_label(name: Column, flavour: Column) -> Column:
    """Menu line of an item: its known parts joined by a space, in title case."""
    return F.trim(title_case(F.concat_ws(" ", name, flavour)))


def flagged(label: Column, unavailable: Column) -> Column:
    return F.when(unavailable, F.concat(F.lit("!"), label)).otherwise(label)


def cropped(label: Column, length: int | None) -> Column:
    """The whole label, or its first letters for whoever draws it."""
    return label if length is None else label.substr(1, length)


def fixed_point(value: Column, digits: int = 2) -> Column:
    """Decimals of a double, rounded from its exact binary value as the original does."""
    return F.call_function("format_number", value.cast("double"), F.lit("0." + "0" * digits))


def money(amount: Column) -> Column:
    return F.concat(F.lit("$"), fixed_point(amount))


def percent(value: Column, digits: int = 2) -> Column:
    return F.concat(fixed_point(value, digits), F.lit("%"))


def stores_text(stores: Sequence[str] | None) -> Column:
    """``A or B``; ``All`` when there is no restriction."""
    return F.lit("All" if stores is None else " or ".join(stores))
