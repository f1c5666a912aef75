"""Report rules on the hand-made shop."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shop import DAILY, ITEMS, TRANSACTIONS, items_frame, shop
from tillbook.functions import dates, measures, text
from tillbook.operators.selection import resolve_stores
from tillbook.plans import hourly, kpi, lookup, menu, popularity, store, week
from tillbook.plans.hourly import ItemChoice

JULY = {n: dt.date(2022, 7, n) for n in range(1, 14)}


@pytest.fixture(scope="module")
def model(spark):
    made = shop(spark)
    for name in ("store_days", "item_hours"):
        getattr(made, name).cache()
    return made


def only(frame):
    (row,) = frame.collect()
    return row.asDict(recursive=True)


def values(frame, *columns):
    return sorted(
        (tuple(row) for row in frame.select(*columns).collect()),
        key=lambda row: tuple((value is not None, str(value)) for value in row),
    )


# ---- snapshot


def test_first_day_and_bounds(model):
    assert only(kpi.first_data_date(model)) == {"first_day": JULY[4]}
    assert only(kpi.date_bounds(model, "2022-07-13")) == {
        "as_of": JULY[13],
        "yesterday": JULY[12],
        "first_day": JULY[4],
    }


def test_today_is_the_default(model):
    row = only(kpi.date_bounds(model))
    assert row["as_of"] - row["yesterday"] == dt.timedelta(days=1)


def test_snapshot_groups_stores_but_literal_binds_day_to_first(model):
    pair = ["Chesterfield", "Uppingham"]
    assert list(only(kpi.kpi_snapshot(model, JULY[5], pair)).values()) == [120.0, 6.0, 20, 36]
    literal = only(kpi.kpi_snapshot_literal(model, JULY[5], pair))
    assert literal["total_revenue"] == 290.0
    assert literal["avg_spend"] == pytest.approx(4.83333333)
    assert (literal["total_customers"], literal["total_coffees"]) == (60, 89)


def test_literal_and_grouped_agree_on_one_store(model):
    for day in (JULY[4], JULY[5]):
        assert only(kpi.kpi_snapshot(model, day, ["Chesterfield"])) == only(
            kpi.kpi_snapshot_literal(model, day, ["Chesterfield"])
        )


def test_literal_for_all_days_equals_each_single_day(model):
    for row in kpi.kpi_snapshot_literal(model).collect():
        single = only(kpi.kpi_snapshot_literal(model, row["day"]))
        assert {**single, "day": row["day"]} == row.asDict()


def test_no_rows_are_shown_as_zero(model):
    assert list(only(kpi.kpi_snapshot(model, JULY[1])).values()) == [0, 0, 0, 0]


@pytest.mark.parametrize(
    ("day", "stores", "status", "delta"),
    [
        (5, ["Chesterfield"], "none", (20, 1, 0, 6)),
        (5, ["Uppingham"], "selected-missing", (-80, -4, -20, -25)),
        (4, ["Chesterfield"], "previous-missing", (100, 5, 20, 30)),
        (5, ["London Camden"], "both-missing", (0, 0, 0, 0)),
    ],
)
def test_day_over_day(model, day, stores, status, delta):
    row = only(kpi.kpi_day_over_day(model, JULY[day], stores))
    assert row["status"] == status
    assert tuple(v for k, v in row.items() if k.startswith("delta_")) == delta


def test_day_over_day_for_all_days_equals_each_single_day(model):
    rows = kpi.kpi_day_over_day(model, stores=["Uppingham"]).collect()
    assert sorted(row["day"] for row in rows) == [JULY[4], JULY[5], JULY[6], JULY[7]]
    for row in rows:
        single = only(kpi.kpi_day_over_day(model, row["day"], ["Uppingham"]))
        assert {**single, "day": row["day"]} == row.asDict()


def test_true_zero_is_not_missing(spark):
    rows = [
        ("Chesterfield", "2022-07-04", "0.00", "0.00", 0, 0),
        ("Chesterfield", "2022-07-05", "0.00", "0.00", 0, 0),
    ]
    assert only(kpi.kpi_day_over_day(shop(spark, daily=rows), JULY[5]))["status"] == "none"


def test_cards(model):
    cards = {row["figure"]: row for row in kpi.kpi_cards(model, JULY[5], ["Uppingham"]).collect()}
    assert cards["total_revenue"]["value"] == "$0.00"
    assert cards["total_revenue"]["delta"] == "$-80.00"
    assert cards["total_coffees"]["delta"] == "-25"
    assert cards["avg_spend"]["stores"] == "Uppingham"
    assert cards["avg_spend"]["status"] == "selected-missing"
    neither = kpi.kpi_cards(model, "2022-09-01", ["Uppingham"]).collect()
    assert {(row["status"], row["value"], row["delta"]) for row in neither} == {("both-missing", None, None)}
    both = kpi.kpi_cards(model, JULY[5], ["Uppingham", "Longridge"]).first()
    assert both["stores"] == "Uppingham or Longridge"
    assert kpi.kpi_cards(model, JULY[5]).first()["stores"] == "All"


# ---- single stores


def test_days(model):
    assert only(store.total_days(model)) == {"n_days": 3}
    found = store.store_days_in_range(model, "Chesterfield", JULY[4], JULY[7])
    assert only(found) == {"store": "Chesterfield", "n_days": 2}


def test_summary(model):
    assert only(store.store_summary(model, "Chesterfield")) == {
        "store": "Chesterfield",
        "total_revenue": 220.0,
        "avg_daily_revenue": 110.0,
        "n_days": 2,
        "first_day": JULY[4],
        "last_day": JULY[5],
        "completeness_pct": 66.7,
    }


def test_summary_cards(model):
    rows = store.store_cards(model, "Chesterfield")
    assert dict(values(rows, "figure", "value")) == {
        "total_revenue": "$220.00",
        "avg_daily_revenue": "$110.00",
        "n_days": "2",
        "completeness_pct": "66.7%",
    }


def test_summary_of_unknown_store(model):
    row = only(store.store_summary(model, "Nowhere"))
    assert (row["n_days"], row["total_revenue"], row["avg_daily_revenue"]) == (0, None, None)


def test_availability(model):
    row = only(store.range_availability(model, JULY[4], JULY[7], "Chesterfield"))
    assert list(row.values()) == ["Chesterfield", 4, 2, 50.0, "-Poor"]


def test_availability_keeps_stores_without_days(model):
    rows = store.range_availability(model, JULY[6], JULY[7])
    assert dict(values(rows, "store", "days_available")) == {
        "Chesterfield": 0,
        "London Soho": 0,
        "Uppingham": 1,
    }


def test_range_order_is_checked_by_date(model):
    with pytest.raises(ValueError):
        store.range_availability(model, JULY[7], JULY[4])
    row = only(store.range_availability(model, "2021-12-31", "2022-01-02", "Chesterfield"))
    assert row["days_inclusive"] == 3


def test_range_vs_alltime(model):
    rows = store.range_vs_alltime(model, JULY[4], JULY[7], "Chesterfield")
    found = {row["measure"]: tuple(row)[2:] for row in rows.collect()}
    assert found == {
        "revenue": (55.0, 110.0, -55.0, "inverse"),
        "avg_spend": (5.5, 5.5, 0.0, "normal"),
        "customers": (10.0, 20.0, -10.0, "inverse"),
        "coffees": (16.0, 33.0, -17.0, "inverse"),
    }


def test_range_kpis_of_an_empty_range(model):
    row = only(store.range_kpis(model, JULY[1], JULY[2], "Chesterfield"))
    assert list(row.values()) == ["Chesterfield", 0, 0, 0, 0, 220.0, 40, 66]


def test_store_vs_store(model):
    rows = store.store_vs_store(model, "Chesterfield", "Uppingham")
    assert dict(values(rows, "store", "total_revenue")) == {
        "Chesterfield": 220.0,
        "Uppingham": 170.0,
    }
    rows = store.store_vs_store(model, "Uppingham", "Longridge")
    assert values(rows, "store", "total_coffees") == [("Longridge", 0), ("Uppingham", 53)]
    assert store.store_vs_store(model).count() == 3


def test_breakdown_keys(model):
    def asked(key):
        return lookup.store_breakdown(model, "Chesterfield", key, (JULY[4], JULY[7]))

    one_value = {
        "alltime": 220.0,
        "justdays": 3,
        "thesedays": 2,
        "weekofyear": 27,
        "datesavgrevenue": 220.0,
        "avgcsfordates": 5.5,
        "avgcs": 5.5,
        "avgcusts": 20.0,
        "avgcups": 33.0,
    }
    for key, value in one_value.items():
        assert list(only(asked(key)).values()) == [value], key
    assert values(asked("alltimedates"), "revenue", "day") == [(100.0, JULY[4]), (120.0, JULY[5])]
    assert asked("anything else") == 0


def test_basic_dates(model):
    assert only(lookup.basic_date(model, "first")) == {"first_day": JULY[4]}
    assert only(lookup.basic_date(model, "yesterday", JULY[13])) == {"yesterday": JULY[12]}
    assert lookup.basic_date(model, "tomorrow") is None
    assert only(lookup.previous_day(model, "2022-07-01"))["day"] == dt.date(2022, 6, 30)


# ---- weeks


def test_grid_has_seven_days(model):
    rows = week.week_grid(model, "Chesterfield", 27).orderBy("iso_weekday").collect()
    assert [row["has_data"] for row in rows] == [True, True] + [False] * 5
    assert [row["weekday_name"] for row in rows] == list(dates.WEEKDAY_NAMES)
    assert rows[6]["day"] == JULY[10] and rows[6]["revenue"] is None


def test_week_starts_on_monday_without_monday_data(model):
    row = only(week.week_commencing(model, "London Soho", 27))
    assert row["week_commencing"] == JULY[4]


def test_week_availability(model):
    row = only(week.week_availability(model, "Chesterfield", 27))
    assert row["week_array"] == [True, True] + [False] * 5
    assert row["days_available"] == 2
    assert row["availability_pct"] == pytest.approx(28.5714285)


def test_week_lines(model):
    lines = week.week_day_lines(model, "Chesterfield", 27).orderBy("iso_weekday").collect()
    assert lines[1]["line"] == "Tuesday - Available [2022-07-05]"
    assert lines[2]["line"] == "Wednesday - No Data"


def test_weekday_against_week(model):
    rows = week.weekday_vs_week_average(model, "Chesterfield", 27).orderBy("iso_weekday").collect()
    assert (rows[0]["delta"], rows[0]["impact_level"]) == (-10.0, -4.0)
    assert rows[0]["diff_pct"] == pytest.approx(-9.0909, abs=1e-4)
    assert (rows[1]["delta"], rows[1]["impact_level"]) == (10.0, 4.5)
    assert all(row["delta"] is None and row["impact_level"] is None for row in rows[2:])


def test_weeks_of_two_years_stay_apart(spark):
    rows = [
        ("Uppingham", "2021-07-06", "10.00", "1.00", 1, 1),
        ("Uppingham", "2022-07-05", "30.00", "1.00", 1, 1),
        ("Uppingham", "2022-01-01", "30.00", "1.00", 1, 1),
    ]
    weeks = store.store_weeks(shop(spark, daily=rows))
    assert values(weeks, "iso_year", "iso_week") == [(2021, 27), (2021, 52), (2022, 27)]


# ---- cups


def test_cups_by_timestamp(model):
    rows = hourly.cups_by_timestamp_item(model, "Chesterfield", JULY[5])
    stamp = F.date_format("ts", "HH:mm").alias("at")
    assert values(rows, stamp, "item_name", "cups_sold") == [
        ("09:15", "Flavoured Latte", 1),
        ("09:15", "Latte", 2),
        ("09:40", None, 0),
        ("09:40", "Latte", 1),
        ("12:05", "Flavoured Latte", 1),
    ]


def test_cups_by_hour(model):
    rows = hourly.cups_by_hour_item(model, "Chesterfield", JULY[5])
    assert sorted(values(rows, "the_hour", "item_name", "cups_sold"), key=str) == sorted(
        [(9, None, 0), (9, "Flavoured Latte", 1), (9, "Latte", 3), (12, "Flavoured Latte", 1)],
        key=str,
    )


def test_insights(model):
    row = only(hourly.hourly_insights(model, "Chesterfield", JULY[5]))
    assert (row["worst_hour"], row["worst_label"]) == (12, "12pm [1 cups sold]")
    assert (row["best_hour"], row["best_label"]) == (9, "9am [4 cups sold]")
    assert (row["avg_hour_cups"], row["hours_above_avg"]) == (2.5, "9am")


def test_insights_of_a_single_hour_and_of_none(model):
    row = only(hourly.hourly_insights(model, "London Soho", JULY[5]))
    assert row["best_hour"] == row["worst_hour"] == 15
    row = only(hourly.hourly_insights(model, "London Soho", JULY[4]))
    assert row["best_hour"] is None and row["worst_label"] is None
    assert row["avg_hour_cups"] == 0
    assert (row["store"], row["day"]) == ("London Soho", JULY[4])


def test_insights_ties(spark):
    at = [(i, f"2022-07-05 {hour}:00", "Uppingham", 1) for i, hour in enumerate(("09", "11", "13"))]
    sold = [(i, "Latte", None, "Regular") for i in range(3)]
    row = only(hourly.hourly_insights(shop(spark, at, sold), "Uppingham", JULY[5]))
    assert (row["worst_hour"], row["best_hour"]) == (9, 13)
    assert row["hours_above_avg"] == "9am, 11am, 13pm"


def test_items_and_flavours(model):
    names = {row["item_name"] for row in hourly.store_items(model, "Chesterfield").collect()}
    assert names == {"Latte", "Flavoured Latte", None}

    def flavours(item):
        rows = hourly.item_flavours(model, "Chesterfield", item).collect()
        return {row["item_flavour"] for row in rows}

    assert flavours("Flavoured Latte") == {"Vanilla", "Hazelnut"}
    assert flavours("Latte") == {None}


def test_same_item_twice_counts_twice(model):
    rows = hourly.compare_two_items(model, "Latte", "Latte", "Chesterfield", JULY[5])
    assert values(rows, "the_hour", "item_name", "cups_sold") == [(9, "Latte", 6)]


NONE_SOLD = ItemChoice("Nothing", ["x"])


def advanced(model, choice):
    rows = hourly.compare_two_items_advanced(model, choice, NONE_SOLD, "Chesterfield", JULY[5])
    return values(rows, "the_hour", "item", "cups_sold")


def test_advanced_plain_item(model):
    assert advanced(model, ItemChoice("Latte", [None], ["Regular", "Large"])) == [
        (9, "LatteLarge", 1),
        (9, "LatteRegular", 2),
    ]


def test_advanced_null_among_several_flavours(model):
    assert advanced(model, ItemChoice("Latte", [None, "Vanilla"], ["Regular", "Large"])) == [
        (9, "LatteLarge", 1),
        (9, "LatteRegular", 2),
    ]


def test_advanced_defaults_to_first_flavour_and_regular(model):
    assert advanced(model, ItemChoice("Flavoured Latte", [], [])) == [
        (12, "Flavoured LatteRegularHazelnut", 1)
    ]
    assert advanced(model, ItemChoice("Latte", [], [])) == [(9, "LatteRegular", 2)]


# ---- popularity and menus


def test_lists_are_in_order(spark):
    days = [("Uppingham", f"2022-{day}", "1.00", "1.00", 1, 1) for day in ("07-20", "07-03", "06-30", "07-12")]
    made = shop(spark, daily=days)
    found = [row["day"].strftime("%m-%d") for row in store.store_daily_revenue(made).collect()]
    assert found == ["06-30", "07-03", "07-12", "07-20"]
    assert [row["iso_week"] for row in store.store_weeks(made).collect()] == [26, 28, 29]
    names = [row["item_name"] for row in popularity.sales_by_time_of_day(made).collect()]
    assert names == ["Flavoured Latte"] * 3 + ["Latte"] * 2 + ["Mocha"] * 2 + [None]


def test_sales_by_band(model):
    rows = popularity.sales_by_time_of_day(model)
    assert values(rows, "item_name", "time_of_day", "cups_sold") == [
        (None, 1, 0),
        ("Flavoured Latte", 1, 1),
        ("Flavoured Latte", 2, 1),
        ("Flavoured Latte", 4, 1),
        ("Latte", 1, 4),
        ("Latte", 2, 1),
        ("Mocha", 3, 1),
        ("Mocha", 4, 1),
    ]
    assert popularity.sales_by_time_of_day(model, 3).count() == 1


def test_popularity_fills_absent_bands(model):
    rows = popularity.item_popularity(model, exclude=["Mocha"], without_top=1)
    assert [tuple(row) for row in rows.collect()] == [("Flavoured Latte", 1, 1, 0, 1, 3)]


def test_best_and_worst(model):
    found = {row["band"]: tuple(row)[1:] for row in popularity.best_worst_by_time_of_day(model).collect()}
    assert found == {
        "breakfast": ("Latte", 4, "Flavoured Latte", 1),
        "early_lunch": ("Latte", 1, "Flavoured Latte", 1),
        "late_lunch": ("Mocha", 1, "Mocha", 1),
        "afternoon": ("Mocha", 1, "Flavoured Latte", 1),
        "all": ("Latte", 4, "Flavoured Latte", 1),
    }


def test_menu(model):
    assert values(menu.store_menu(model, "Chesterfield"), "menu_item") == [
        ("Flavoured Latte Hazelnut",),
        ("Flavoured Latte Vanilla",),
        ("Latte",),
    ]
    rows = menu.store_menu_availability(model, [("Chesterfield", "Latte")], "Chesterfield")
    last = rows.orderBy("position").collect()[-1]
    assert (last["position"], last["column_no"], last["display_text"]) == (3, 1, "!Latte")
    assert last["available"] is False


def test_long_menu_wraps_and_is_cropped_on_request(spark):
    names = ["x" * 30, *"abcdef"]
    sold = [(1, name, None, "Regular") for name in names]
    missing = [("Chesterfield", "X" + "x" * 29)]
    made = shop(spark, TRANSACTIONS, sold)
    rows = menu.store_menu_availability(made, missing).orderBy("position").collect()
    assert [row["column_no"] for row in rows] == [1] * 6 + [2]
    assert rows[-1]["display_text"] == "!X" + "x" * 29
    cut = menu.store_menu_availability(made, missing, crop_to=text.CROPPED_LENGTH).orderBy("position").collect()
    assert cut[-1]["display_text"] == "!X" + "x" * 27
    assert rows[-1]["menu_item"] == "X" + "x" * 29


def test_menu_whose_lines_start_alike(spark):
    sold = [(1, f"Flavoured {n:05d}", None, "Regular") for n in range(3000)]
    rows = menu.store_menu_availability(shop(spark, TRANSACTIONS, sold)).collect()
    assert sorted((row["position"], row["menu_item"]) for row in rows) == [
        (n + 1, f"Flavoured {n:05d}") for n in range(3000)
    ]


def test_menu_numbers_equal_a_plain_sort(spark):
    make = random.Random(3)
    names = sorted({"".join(make.choices("abé 1", k=make.randint(1, 6))).strip() for _ in range(400)} - {""})
    visits = [(1, "2022-07-04 09:15", "Uppingham", 1), (2, "2022-07-04 09:15", "Longridge", 1)]
    sold = [(1, name, None, "Large") for name in names] + [(2, name, None, "Large") for name in names[::7]]
    rows = menu.store_menu_availability(shop(spark, visits, sold)).collect()
    for store_name, expected in (("Uppingham", names), ("Longridge", names[::7])):
        lines = [row for row in rows if row["store"] == store_name]
        labels = sorted((name.title() for name in expected), key=lambda label: label.encode())
        found = sorted(lines, key=lambda row: row["position"])
        assert [row["position"] for row in found] == list(range(1, len(labels) + 1))
        assert [row["menu_item"] for row in found] == labels


def test_menu_of_an_unnamed_store_is_kept(spark):
    made = shop(spark, [(1, "2022-07-04 09:15", None, 1)], [(1, "Latte", None, "Large")])
    (row,) = menu.store_menu_availability(made).collect()
    assert (row["store"], row["position"], row["display_text"]) == (None, 1, "Latte")


# ---- derived daily table


def test_daily_store_from_items(spark):
    rows = shop(spark, daily=None).daily_store.where("store = 'Chesterfield'").orderBy("day").collect()
    # the nameless item is paid for but is not a cup; the visit without items is no customer
    assert [(r["day"], float(r["revenue"]), r["customers"], r["coffees"]) for r in rows] == [
        (JULY[4], 2.5, 1, 1),
        (JULY[5], 15.0, 3, 5),
    ]
    assert float(rows[1]["avg_spend"]) == 5.0


def test_daily_store_counts_a_repeated_transaction_once(spark):
    twice = shop(spark, TRANSACTIONS + TRANSACTIONS[:1], ITEMS, None)
    row = twice.daily_store.where("store = 'Chesterfield' and day = '2022-07-04'").first()
    assert (float(row["revenue"]), row["customers"], row["coffees"]) == (5.0, 1, 2)


# ---- scalar rules


def evaluate(spark, column, *rows, schema):
    frame = spark.createDataFrame(list(rows), schema)
    return [row[0] for row in frame.select(column).collect()]


def test_levels(spark):
    found = evaluate(
        spark,
        measures.availability_rating(F.col("v")),
        *[(v,) for v in (0.0, 40.0, 57.5, 57.6, 66.7, 81.0, 97.5, 97.6, 300.0, None)],
        schema="v double",
    )
    assert found == [
        "-Bad", "-Bad", "-Poor", "Acceptable", "Acceptable", "Good", "Excellent",
        "Exceptional", "Exceptional", None,
    ]
    found = evaluate(
        spark,
        measures.impact_level(F.col("v")),
        *[(v,) for v in (-9.0, -3.0, -1.0, 0.75, 0.8, 2.25, 99.0)],
        schema="v double",
    )
    assert found == [-4.0, -4.0, -2.0, 0.0, 1.5, 1.5, 4.5]


def test_direction(spark):
    found = evaluate(
        spark,
        measures.direction(F.col("a"), F.col("b")),
        (1.0, 1.0), (2.0, 1.0), (1.0, 2.0), (None, 1.0),
        schema="a double, b double",
    )
    assert found == ["normal", "normal", "inverse", "off"]


def test_whole_number_cuts_towards_zero(spark):
    found = evaluate(spark, measures.whole_number(F.col("v")), (-3.5,), (3.9,), schema="v double")
    assert found == [-3, 3]


@pytest.mark.parametrize(
    "label",
    ["jack o'neil half-fat", "LATTE", "7up and 2ND cup", "  déjà vu ", "a", "x-y z's"],
)
def test_menu_label_is_title_case(spark, label):
    found = evaluate(spark, text.menu_label(F.col("n"), F.col("f")), (label, None), schema="n string, f string")
    assert found == [label.title().strip()]


def test_menu_label_of_any_text(spark):
    letters = "abzABZéÖñ019 -'.&!日"
    make = random.Random(7)
    labels = ["".join(make.choices(letters, k=make.randint(1, 25))) for _ in range(500)]
    found = evaluate(
        spark, text.title_case(F.col("n")), *[(label,) for label in labels], schema="n string"
    )
    assert found == [label.title() for label in labels]


@pytest.mark.parametrize(
    "levels", [measures.AVAILABILITY_RATINGS, [(n, n) for n in measures.IMPACT_LEVELS]]
)
def test_nearest_is_the_smallest_distance(spark, levels):
    make = random.Random(11)
    values = [round(make.uniform(-20, 120), make.randint(0, 3)) for _ in range(2000)]
    found = evaluate(
        spark, measures.nearest(F.col("v"), levels), *[(v,) for v in values], schema="v double"
    )
    assert found == [min(levels, key=lambda level: abs(level[0] - v))[1] for v in values]


def test_hour_labels(spark):
    found = evaluate(
        spark, text.hour_label(F.col("h")), (0,), (9,), (11,), (12,), (13,), schema="h int"
    )
    assert found == ["0am", "9am", "11am", "12pm", "13pm"]


def test_dates(spark):
    day = F.to_date("d")
    found = evaluate(
        spark,
        F.struct(
            dates.iso_year(day), dates.iso_week(day), dates.iso_weekday(day),
            dates.week_commencing(day), dates.weekday_name(dates.iso_weekday(day)),
        ),
        ("2022-07-05",), ("2022-01-01",),
        schema="d string",
    )
    assert [tuple(row) for row in found] == [
        (2022, 27, 2, JULY[4], "Tuesday"),
        (2021, 52, 6, dt.date(2021, 12, 27), "Saturday"),
    ]
    found = evaluate(
        spark, dates.inclusive_days(dates.date_lit(JULY[1]), dates.date_lit(JULY[13])), (1,), schema="x int"
    )
    assert found == [13]


def test_store_selection(model):
    groups = model.store_groups

    def chosen(*picked):
        return resolve_stores(picked, groups)

    assert chosen() is None
    assert chosen("All") is None
    assert chosen("Uppingham") == ["Uppingham"]
    assert chosen("Uppingham", "All") is None
    assert chosen("Only Outside London", "Only London") == ["London Camden", "London Soho"]
    assert chosen("Only Outside London", "London Soho") == ["Uppingham", "Longridge", "Chesterfield"]
    assert chosen("Uppingham", "London Soho") == ["Uppingham", "London Soho"]


def test_items_without_price(spark):
    from tillbook.sources import warehouse

    bare = items_frame(spark, ITEMS).drop("price")
    assert warehouse.items(bare).where("price is null").count() == len(ITEMS)


# ---- all stores against one store, and rows that must not get lost

PER_STORE = [
    lambda m, s: store.store_revenue_alltime(m, s),
    lambda m, s: store.store_daily_revenue(m, s),
    lambda m, s: store.store_days_in_range(m, s, JULY[4], JULY[4]),
    lambda m, s: store.store_weeks(m, s),
    lambda m, s: store.store_summary(m, s),
    lambda m, s: store.store_cards(m, s),
    lambda m, s: store.range_revenue(m, s, JULY[4], JULY[4]),
    lambda m, s: store.store_alltime_averages(m, s),
    lambda m, s: store.range_availability(m, JULY[4], JULY[4], s),
    lambda m, s: store.range_kpis(m, JULY[4], JULY[4], s),
    lambda m, s: store.range_vs_alltime(m, JULY[4], JULY[4], s),
    lambda m, s: week.week_grid(m, s),
    lambda m, s: week.week_commencing(m, s),
    lambda m, s: week.week_availability(m, s),
    lambda m, s: week.week_day_lines(m, s),
    lambda m, s: week.week_average(m, s),
    lambda m, s: week.weekday_vs_week_average(m, s),
    lambda m, s: hourly.cups_by_timestamp_item(m, s),
    lambda m, s: hourly.cups_by_hour_item(m, s),
    lambda m, s: hourly.hourly_insights(m, s),
    lambda m, s: hourly.store_items(m, s),
    lambda m, s: hourly.item_flavours(m, s),
    lambda m, s: menu.store_menu(m, s),
    lambda m, s: menu.store_menu_availability(m, [("Uppingham", "Latte")], s),
]


@pytest.mark.parametrize("report", PER_STORE)
@pytest.mark.parametrize("name", ["Chesterfield", "Uppingham", "London Soho"])
def test_all_stores_filtered_equal_one_store(model, report, name):
    whole = report(model, None).where(F.col("store") == name)
    assert sorted(map(str, whole.collect())) == sorted(map(str, report(model, name).collect()))


@pytest.mark.parametrize("day", [None, JULY[5]])
@pytest.mark.parametrize("name", ["Chesterfield", "Uppingham", "London Soho"])
def test_compared_items_of_all_stores_filtered_equal_one_store(model, name, day):
    choices = hourly.ItemChoice("Flavoured Latte"), hourly.ItemChoice("Mocha", sizes=["Large", "Regular"])
    for compare, picked in (
        (hourly.compare_two_items, ("Flavoured Latte", "Mocha")),
        (hourly.compare_two_items_advanced, choices),
    ):
        whole = compare(model, *picked, day=day).where(F.col("store") == name).drop("store")
        one = compare(model, *picked, store=name, day=day)
        assert sorted(map(str, whole.select(one.columns).collect())) == sorted(map(str, one.collect()))


def test_first_flavour_is_that_of_the_store(model):
    choice = hourly.ItemChoice("Flavoured Latte")
    rows = hourly.compare_two_items_advanced(model, choice, hourly.ItemChoice("Mocha", sizes=["Large"]))
    assert [row["item"] for row in rows.where("store = 'London Soho' AND the_hour = 15").collect()].count(
        "Flavoured LatteRegularVanilla"
    ) == 1


def test_stores_without_a_day_in_the_range_stay(model):
    days = {row["store"]: row["n_days"] for row in store.store_days_in_range(model, None, JULY[4], JULY[4]).collect()}
    assert days == {"Chesterfield": 1, "Uppingham": 1, "London Soho": 0}
    revenue = {row["store"]: tuple(row)[1:] for row in store.range_revenue(model, None, JULY[4], JULY[4]).collect()}
    assert revenue["London Soho"] == (0.0, 0.0)


def test_two_rows_for_a_day_are_added_up(spark):
    made = shop(spark, daily=[*DAILY, ("Chesterfield", "2022-07-05", "30.00", "4.00", 10, 4)])
    grid = week.week_grid(made, "Chesterfield").where("iso_weekday = 2").first()
    assert (grid["revenue"], grid["avg_spend"], grid["customers"], grid["coffees"]) == (150.0, 5.0, 30, 40)
    assert week.week_grid(made).count() == 21


def test_popularity_leaves_nothing_out_unless_told(spark):
    sold = [(1, name, None, "Large") for name in (*popularity.LEFT_OUT, "Mocha")]
    made = shop(spark, TRANSACTIONS, sold)
    assert popularity.item_popularity(made).count() == popularity.item_popularity_long(made).count() == 3
    assert popularity.item_popularity(made, exclude=popularity.LEFT_OUT).count() == 1
