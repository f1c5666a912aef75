"""DuckDB SQL with the results the registered queries must give.

Each statement starts from the raw tables. It is written independently of the
Spark plans: no summary table, self joins where Spark aggregates once, and so on.
"""

from __future__ import annotations

# Parameters shared with the registered queries.
AS_OF = "2024-01-31"
DAY = "2024-01-15"
LATE_DAY = "2024-01-31"  # the day after the last one with data
RANGE = ("2023-12-28", "2024-01-12")  # starts before the first day with data
EMPTY_RANGE = ("2023-12-01", "2023-12-20")  # before the first day with data
STORE = "ASIA"
WEEK = (3, 2024)
CROP_TO = 7
ITEM_1, ITEM_2 = "gear", "bolt"
UNAVAILABLE = (
    ("ASIA", "Gear Hot"),
    ("ASIA", "Bolt"),
    ("EUROPE", "Widget Red"),
    ("EUROPE", "Not On The Menu"),
)

_BASE = """
WITH transactions AS (
  SELECT e.event_id AS transaction_id, e.ts, r.r_name AS store,
         CAST(e.ts AS DATE) AS day, CAST(hour(e.ts) AS INTEGER) AS the_hour,
         CASE WHEN hour(e.ts) < 11 THEN 1 WHEN hour(e.ts) < 13 THEN 2
              WHEN hour(e.ts) < 15 THEN 3 ELSE 4 END AS time_of_day
  FROM events e
  JOIN customer c ON e.user_id = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey),
items AS (
  SELECT l.l_orderkey AS transaction_id,
         split_part(p.p_name, ' ', 2) AS item_name,
         CASE WHEN split_part(p.p_name, ' ', 2) IN ('bolt', 'rod') THEN NULL
              ELSE split_part(p.p_name, ' ', 1) END AS item_flavour,
         CASE WHEN p.p_size > 25 THEN 'Large' ELSE 'Regular' END AS item_size,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) AS price
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
sold AS (
  SELECT t.*, i.item_name, i.item_flavour, i.item_size, i.price
  FROM items i JOIN transactions t ON i.transaction_id = t.transaction_id),
day_totals AS (
  SELECT store, day, sum(price) AS revenue,
         count(DISTINCT transaction_id) AS customers, count(item_name) AS coffees
  FROM sold GROUP BY store, day),
daily AS (
  SELECT store, day, revenue, customers, coffees,
         CAST(CAST((CAST(revenue * 100 AS BIGINT) * 20000 + customers) // (2 * customers)
              AS DECIMAL(18,0)) * CAST(0.000001 AS DECIMAL(7,6)) AS DECIMAL(22,6)) AS avg_spend
  FROM day_totals),
weeks AS (
  SELECT *, CAST(isoyear(day) AS INTEGER) AS iso_year, CAST(week(day) AS INTEGER) AS iso_week,
         CAST(isodow(day) AS INTEGER) AS iso_weekday FROM daily)
"""


def _sum(column: str, condition: str | None = None) -> str:
    kept = column if condition is None else f"CASE WHEN {condition} THEN {column} END"
    kind = "DOUBLE" if column == "revenue" else "BIGINT"
    return f"coalesce(CAST(sum({kept}) AS {kind}), 0)"


def _mean(column: str, condition: str | None = None) -> str:
    kept = column if condition is None else f"CASE WHEN {condition} THEN {column} END"
    return f"CAST(sum({kept}) AS DOUBLE) / nullif(count({kept}), 0)"


def _kpis(condition: str | None = None, prefix: str = "") -> str:
    return (
        f"{_sum('revenue', condition)} AS {prefix}total_revenue, "
        f"coalesce({_mean('avg_spend', condition)}, 0) AS {prefix}avg_spend, "
        f"{_sum('customers', condition)} AS {prefix}total_customers, "
        f"{_sum('coffees', condition)} AS {prefix}total_coffees"
    )


_KPI_NAMES = ("total_revenue", "avg_spend", "total_customers", "total_coffees")
_IN_RANGE = f"day BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}'"
_IN_EMPTY_RANGE = f"day BETWEEN DATE '{EMPTY_RANGE[0]}' AND DATE '{EMPTY_RANGE[1]}'"
_RANGE_DAYS = f"(DATE '{RANGE[1]}' - DATE '{RANGE[0]}' + 1)"


def _day_over_day(days: str, stores: str = "TRUE", keys: str = "d.day, ") -> str:
    """For each day of the ``days`` query: that day joined with the one before."""
    columns = ", ".join(
        f"coalesce(a.{name}, 0) AS {name}, coalesce(b.{name}, 0) AS prev_{name}, "
        f"coalesce(a.{name}, 0) - coalesce(b.{name}, 0) AS delta_{name}"
        for name in _KPI_NAMES
    )
    return f"""{_BASE},
by_day AS (SELECT day, {_kpis()} FROM daily WHERE {stores} GROUP BY day),
wanted AS ({days})
SELECT {keys}{columns},
       CASE WHEN a.day IS NULL AND b.day IS NULL THEN 'both-missing'
            WHEN b.day IS NULL THEN 'previous-missing'
            WHEN a.day IS NULL THEN 'selected-missing' ELSE 'none' END AS status
FROM wanted d LEFT JOIN by_day a ON a.day = d.day LEFT JOIN by_day b ON b.day = d.day - 1"""


_HOUR_LABEL = "CAST({h} AS VARCHAR) || CASE WHEN {h} > 11 THEN 'pm' ELSE 'am' END"


def _hour_label(hour: str) -> str:
    return _HOUR_LABEL.format(h=hour)


_GRID = f"""{_BASE},
monday AS (SELECT DISTINCT store, CAST(date_trunc('week', day) AS DATE) AS monday FROM daily),
grid AS (
  SELECT m.store, CAST(m.monday + CAST(k.k AS INTEGER) AS DATE) AS day,
         CAST(k.k + 1 AS INTEGER) AS iso_weekday,
         CAST(isoyear(m.monday) AS INTEGER) AS iso_year,
         CAST(week(m.monday) AS INTEGER) AS iso_week
  FROM monday m, range(7) k(k)),
filled AS (
  SELECT g.*, CAST(d.revenue AS DOUBLE) AS revenue, CAST(d.avg_spend AS DOUBLE) AS avg_spend,
         d.customers, d.coffees, d.day IS NOT NULL AS has_data,
         ['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday']
           [g.iso_weekday] AS weekday_name
  FROM grid g LEFT JOIN daily d ON d.store = g.store AND d.day = g.day)
"""

_WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
_FLAGS = ", ".join(f"bool_or(has_data AND iso_weekday = {i + 1}) AS has_{name}" for i, name in enumerate(_WEEKDAYS))

_WEEK_MEANS = ", ".join(
    f"{_mean(column)} AS {name}"
    for column, name in (
        ("revenue", "avg_revenue"),
        ("avg_spend", "avg_spend"),
        ("customers", "avg_customers"),
        ("coffees", "avg_coffees"),
    )
)

_BANDS = f"""{_BASE},
bands AS (
  SELECT item_name, time_of_day, count(item_name) AS cups_sold FROM sold
  WHERE item_name IS NOT NULL GROUP BY item_name, time_of_day)
"""
_BAND_NAME = (
    "['breakfast', 'early_lunch', 'late_lunch', 'afternoon'][time_of_day]"
)


def _popularity(condition: str = "TRUE", extra: str = "") -> str:
    cups = ", ".join(
        f"CAST(coalesce(sum(cups_sold) FILTER (time_of_day = {n}), 0) AS BIGINT) AS {name}"
        for n, name in enumerate(
            ("breakfast", "early_lunch", "late_lunch", "afternoon"), start=1
        )
    )
    return f"""{_BANDS}{extra}
SELECT item_name, {cups}, CAST(sum(cups_sold) AS BIGINT) AS total
FROM bands WHERE {condition} GROUP BY item_name"""


def _compare(branches: list[tuple[str, str]], label: str) -> str:
    """Append the rows of each branch, then add up per hour."""
    parts = " UNION ALL ".join(
        f"SELECT store, day, the_hour, {text} AS {label}, count(item_name) AS cups "
        f"FROM sold WHERE {condition} GROUP BY ALL"
        for condition, text in branches
    )
    return f"""{_BASE}{_LISTED}, both_items AS ({parts})
SELECT store, day, the_hour, {label}, CAST(sum(cups) AS BIGINT) AS cups_sold
FROM both_items GROUP BY store, day, the_hour, {label}"""


_ITEM_TEXT = "item_name || item_size || coalesce(item_flavour, '')"
_LABEL = (
    "array_to_string(list_transform(string_split(lower(concat_ws(' ', item_name, item_flavour)), ' '),"
    " lambda x: upper(x[1]) || x[2:]), ' ')"
)
_MENU = f"""{_BASE},
menu AS (
  SELECT store, {_LABEL} AS menu_item
  FROM (SELECT DISTINCT store, item_name, item_flavour FROM sold))
"""
_UNAVAILABLE_ROWS = ", ".join(f"('{store}', '{item}')" for store, item in UNAVAILABLE)


def _default_flavour(item: str) -> str:
    """The first flavour in name order that the row's own store lists for the item, where
    none comes before all names."""
    return (
        "item_flavour IS NOT DISTINCT FROM (SELECT l.item_flavour FROM listed l "
        f"WHERE l.item_name = '{item}' AND l.store = sold.store)"
    )


_LISTED = """, listed AS (
  SELECT DISTINCT ON (store, item_name) store, item_name, item_flavour FROM sold
  ORDER BY store, item_name, item_flavour ASC NULLS FIRST)"""


def _days_in(condition: str) -> str:
    """Per store that has any transaction, the days that meet a condition."""
    return f"""{_BASE}
SELECT store, count(DISTINCT CASE WHEN {condition} THEN day END) AS n_days
FROM transactions GROUP BY store"""


def _revenue_in(condition: str) -> str:
    return f"""{_BASE}
SELECT store, {_sum('revenue', condition)} AS range_revenue,
       coalesce({_mean('avg_spend', condition)}, 0) AS range_avg_spend
FROM daily GROUP BY store"""


def _cards(day: str) -> str:
    there = f"(SELECT count(*) FROM chosen WHERE day = DATE '{day}') > 0"
    before = f"(SELECT count(*) FROM chosen WHERE day = DATE '{day}' - 1) > 0"
    any_day = f"({there} OR {before})"
    figures = {
        "total_revenue": "printf('$%.2f', {})",
        "avg_spend": "printf('$%.2f', {})",
        "total_customers": "CAST({} AS VARCHAR)",
        "total_coffees": "CAST({} AS VARCHAR)",
    }
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS figure, CASE WHEN {any_day} THEN {shown.format(name)} END AS value, "
        f"CASE WHEN {any_day} THEN {shown.format(f'{name} - prev_{name}')} END AS delta FROM sides"
        for name, shown in figures.items()
    )
    return f"""{_BASE},
chosen AS (SELECT * FROM daily WHERE store IN ('ASIA', 'EUROPE')),
sides AS (SELECT {_kpis(f"day = DATE '{day}'")}, {_kpis(f"day = DATE '{day}' - 1", 'prev_')} FROM chosen),
cards AS ({rows})
SELECT DATE '{day}' AS day, 'ASIA or EUROPE' AS stores, figure, value, delta,
       CASE WHEN {there} AND {before} THEN 'none' WHEN {there} THEN 'previous-missing'
            WHEN {before} THEN 'selected-missing' ELSE 'both-missing' END AS status
FROM cards"""


def _availability(shown: str) -> str:
    return f"""{_MENU},
flags(store, menu_item) AS (VALUES {_UNAVAILABLE_ROWS}),
lines AS (
  SELECT m.store, m.menu_item, f.store IS NULL AS available,
         row_number() OVER (PARTITION BY m.store ORDER BY m.menu_item) AS position,
         count(*) OVER (PARTITION BY m.store) AS n_lines
  FROM menu m LEFT JOIN flags f ON f.store = m.store AND f.menu_item = m.menu_item
  WHERE m.menu_item <> '')
SELECT store, CAST(position AS INTEGER) AS position, CAST(n_lines AS INTEGER) AS n_lines,
       CASE WHEN position > 6 THEN 2 ELSE 1 END AS column_no, menu_item, available,
       CASE WHEN available THEN '' ELSE '!' END || {shown} AS display_text
FROM lines"""


_RATING_ROWS = (
    "(30, 1, '-Bad'), (50, 2, '-Poor'), (65, 3, 'Acceptable'), "
    "(80, 4, 'Good'), (95, 5, 'Excellent'), (100, 6, 'Exceptional')"
)

SQL: dict[str, str] = {
    "transactions_per_store": f"""{_BASE}
SELECT store, time_of_day, count(*) AS n_transactions, min(ts) AS first_ts, max(ts) AS last_ts
FROM transactions GROUP BY store, time_of_day""",
    "items_per_kind": f"""{_BASE}
SELECT item_name, item_flavour, item_size, count(*) AS n_items,
       CAST(sum(price) AS DOUBLE) AS revenue
FROM items GROUP BY item_name, item_flavour, item_size""",
    "sold_items_per_store": f"""{_BASE}
SELECT store, count(*) AS n_items, count(item_flavour) AS n_flavoured FROM sold GROUP BY store""",
    "daily_store": f"""{_BASE}
SELECT store, day, CAST(revenue AS DOUBLE) AS revenue, CAST(avg_spend AS DOUBLE) AS avg_spend,
       customers, coffees FROM daily""",
    "store_days": f"""{_BASE}
SELECT store, day, count(*) AS n_transactions FROM transactions GROUP BY store, day""",
    "item_hours": f"""{_BASE}
SELECT store, day, the_hour, time_of_day, item_name, item_flavour, item_size,
       count(item_name) AS cups
FROM sold GROUP BY ALL""",
    "first_data_date": f"{_BASE} SELECT day AS first_day FROM daily ORDER BY day LIMIT 1",
    "basic_date_current": f"SELECT DATE '{AS_OF}' AS as_of",
    "basic_date_yesterday": f"SELECT CAST(DATE '{AS_OF}' - 1 AS DATE) AS yesterday",
    "basic_date_first": f"{_BASE} SELECT min(day) AS first_day FROM daily",
    "previous_day": f"{_BASE} SELECT DISTINCT day, CAST(day - 1 AS DATE) AS previous_day FROM daily",
    "date_bounds": f"""{_BASE}
SELECT DATE '{AS_OF}' AS as_of, DATE '{AS_OF}' - 1 AS yesterday,
       (SELECT min(day) FROM daily) AS first_day""",
    "kpi_snapshot": f"{_BASE} SELECT day, {_kpis()} FROM daily GROUP BY day",
    "kpi_snapshot_one_day": f"{_BASE} SELECT {_kpis()} FROM daily WHERE day = DATE '{DAY}'",
    "kpi_snapshot_store_group": f"""{_BASE}
SELECT day, {_kpis()} FROM daily WHERE store IN ('AMERICA', 'EUROPE') GROUP BY day""",
    "kpi_snapshot_listed_stores": f"""{_BASE}
SELECT day, {_kpis()} FROM daily WHERE store IN ('ASIA', 'EUROPE') GROUP BY day""",
    "kpi_snapshot_literal": f"""{_BASE}
SELECT d.day, {_kpis()}
FROM (SELECT DISTINCT day FROM daily) d
JOIN daily f ON f.day = d.day AND f.store = 'AFRICA' OR f.store = 'AMERICA'
  OR f.store = 'ASIA' OR f.store = 'EUROPE' OR f.store = 'MIDDLE EAST'
GROUP BY d.day""",
    "kpi_snapshot_literal_one_day": f"""{_BASE}
SELECT {_kpis()} FROM daily
WHERE day = DATE '{DAY}' AND store = 'AFRICA' OR store = 'AMERICA' OR store = 'ASIA'
   OR store = 'EUROPE' OR store = 'MIDDLE EAST'""",
    "kpi_day_over_day": _day_over_day(
        "SELECT day FROM by_day UNION SELECT CAST(day + 1 AS DATE) FROM by_day"
    ),
    "kpi_day_over_day_one_day": _day_over_day(f"SELECT DATE '{DAY}' AS day", keys=""),
    "kpi_day_over_day_missing": _day_over_day(
        f"SELECT DATE '{LATE_DAY}' AS day", "store IN ('AMERICA', 'EUROPE')", keys=""
    ),
    "kpi_cards": _cards(DAY),
    "kpi_cards_selected_missing": _cards(LATE_DAY),
    "kpi_cards_both_missing": _cards(EMPTY_RANGE[0]),
    "store_revenue_alltime": f"""{_BASE}
SELECT store, CAST(sum(revenue) AS DOUBLE) AS total_revenue FROM daily GROUP BY store""",
    "store_daily_revenue": f"""{_BASE}
SELECT store, day, CAST(revenue AS DOUBLE) AS revenue FROM daily""",
    "total_days": f"{_BASE} SELECT count(DISTINCT day) AS n_days FROM transactions",
    "store_days_in_range": _days_in(_IN_RANGE),
    "store_days_in_empty_range": _days_in(_IN_EMPTY_RANGE),
    "store_weeks": f"{_BASE} SELECT DISTINCT store, iso_year, iso_week FROM weeks",
    "store_summary": f"""{_BASE}
SELECT store, CAST(sum(revenue) AS DOUBLE) AS total_revenue,
       CAST(sum(revenue) AS DOUBLE) / count(day) AS avg_daily_revenue,
       count(day) AS n_days, min(day) AS first_day, max(day) AS last_day,
       round(CAST(count(day) AS DOUBLE) / (SELECT count(DISTINCT day) FROM transactions) * 100, 1)
         AS completeness_pct
FROM daily GROUP BY store""",
    "store_cards": f"""{_BASE},
summary AS (
  SELECT store, CAST(sum(revenue) AS DOUBLE) AS total, count(day) AS n_days FROM daily GROUP BY store)
SELECT store, 'total_revenue' AS figure, printf('$%.2f', total) AS value FROM summary
UNION ALL SELECT store, 'avg_daily_revenue', printf('$%.2f', total / n_days) FROM summary
UNION ALL SELECT store, 'n_days', CAST(n_days AS VARCHAR) FROM summary
UNION ALL SELECT store, 'completeness_pct',
  printf('%.1f%%', CAST(n_days AS DOUBLE) / (SELECT count(DISTINCT day) FROM transactions) * 100)
  FROM summary""",
    "range_revenue": _revenue_in(_IN_RANGE),
    "range_revenue_empty_range": _revenue_in(_IN_EMPTY_RANGE),
    "range_avg_spend": f"SELECT store, range_avg_spend FROM ({_revenue_in(_IN_RANGE)})",
    "store_alltime_averages": f"""{_BASE}
SELECT store, {_mean('avg_spend')} AS avg_spend, {_mean('customers')} AS avg_customers,
       {_mean('coffees')} AS avg_coffees FROM daily GROUP BY store""",
    "range_availability": f"""{_BASE},
levels(level, place, label) AS (VALUES {_RATING_ROWS}),
counted AS (
  SELECT s.store, CAST({_RANGE_DAYS} AS INTEGER) AS days_inclusive,
         count(DISTINCT t.day) AS days_available
  FROM (SELECT DISTINCT store FROM transactions) s
  LEFT JOIN transactions t ON t.store = s.store AND t.{_IN_RANGE}
  GROUP BY s.store),
shares AS (
  SELECT *, CAST(days_available AS DOUBLE) / days_inclusive * 100 AS availability_pct FROM counted)
SELECT store, days_inclusive, days_available, availability_pct, label AS rating
FROM shares, levels
QUALIFY row_number() OVER (PARTITION BY store ORDER BY abs(level - availability_pct), place) = 1""",
    "range_kpis": f"""{_BASE}
SELECT store, {_kpis(_IN_RANGE)}, {_sum('revenue')} AS alltime_revenue,
       {_sum('customers')} AS alltime_customers, {_sum('coffees')} AS alltime_coffees
FROM daily GROUP BY store""",
    "range_vs_alltime": f"""{_BASE},
sums AS (
  SELECT store, {_kpis(_IN_RANGE, 'r_')}, {_mean('revenue')} AS a_revenue,
         {_mean('avg_spend')} AS a_spend, {_mean('customers')} AS a_customers,
         {_mean('coffees')} AS a_coffees
  FROM daily GROUP BY store),
long AS (
  SELECT store, 'revenue' AS measure, r_total_revenue / {_RANGE_DAYS} AS range_value,
         a_revenue AS alltime_value FROM sums
  UNION ALL SELECT store, 'avg_spend', r_avg_spend, a_spend FROM sums
  UNION ALL SELECT store, 'customers', trunc(CAST(r_total_customers AS DOUBLE) / {_RANGE_DAYS}),
                   trunc(a_customers) FROM sums
  UNION ALL SELECT store, 'coffees', trunc(CAST(r_total_coffees AS DOUBLE) / {_RANGE_DAYS}),
                   trunc(a_coffees) FROM sums)
SELECT store, measure, range_value, alltime_value, range_value - alltime_value AS difference,
       CASE WHEN range_value >= alltime_value THEN 'normal' ELSE 'inverse' END AS direction
FROM long""",
    "store_vs_store": f"{_BASE} SELECT store, {_kpis()} FROM daily GROUP BY store",
    "store_vs_store_two": f"""{_BASE}
SELECT store, {_kpis()} FROM daily WHERE store IN ('ASIA', 'EUROPE') GROUP BY store""",
    "week_grid": f"""{_GRID}
SELECT store, iso_year, iso_week, iso_weekday, weekday_name, day, revenue, avg_spend,
       customers, coffees, has_data FROM filled""",
    "week_commencing": f"""{_BASE}
SELECT DISTINCT store, iso_year, iso_week, CAST(date_trunc('week', day) AS DATE) AS week_commencing
FROM weeks""",
    "week_availability": f"""{_GRID}
SELECT store, iso_year, iso_week, CAST(count(*) FILTER (has_data) AS INTEGER) AS days_available,
       CAST(count(*) FILTER (has_data) AS DOUBLE) / 7 * 100 AS availability_pct,
       {_FLAGS}
FROM filled GROUP BY store, iso_year, iso_week""",
    "week_day_lines": f"""{_GRID}
SELECT store, iso_year, iso_week, iso_weekday,
       weekday_name || ' - ' || CASE WHEN has_data THEN 'Available [' || CAST(day AS VARCHAR) || ']'
                                     ELSE 'No Data' END AS line
FROM filled""",
    "week_cards": f"""{_GRID},
week_means AS (
  SELECT store, iso_year, iso_week, {_mean('revenue')} AS mean_revenue
  FROM weeks GROUP BY store, iso_year, iso_week),
diffs AS (
  SELECT *, revenue - mean_revenue AS diff FROM filled JOIN week_means USING (store, iso_year, iso_week)),
texts AS (
  SELECT *, unnest([
    {{'figure': 'revenue', 'value': printf('$%.2f', revenue), 'delta': printf('%.2f', diff)}},
    {{'figure': 'difference', 'value': printf('%.2f%%', diff / mean_revenue * 100), 'delta': NULL}},
    {{'figure': 'avg_spend', 'value': printf('$%.2f', avg_spend), 'delta': NULL}},
    {{'figure': 'customers', 'value': CAST(customers AS VARCHAR), 'delta': NULL}},
    {{'figure': 'coffees', 'value': CAST(coffees AS VARCHAR), 'delta': NULL}}]) AS t
  FROM diffs)
SELECT store, iso_year, iso_week, iso_weekday, weekday_name,
       CASE WHEN has_data THEN CAST(day AS VARCHAR) ELSE '-' END AS day, t.figure AS figure,
       CASE WHEN has_data THEN t.value ELSE 'N/A' END AS value,
       CASE WHEN t.figure = 'revenue' THEN CASE WHEN has_data THEN t.delta ELSE '-' END END AS delta
FROM texts""",
    "week_grid_absent_weeks": f"""{_BASE},
bounds AS (
  SELECT store, CAST(date_trunc('week', min(day)) AS DATE) AS first, CAST(date_trunc('week', max(day)) AS DATE) AS last
  FROM daily GROUP BY store),
grid AS (
  SELECT store, CAST(unnest(generate_series(first, last + 6, INTERVAL 1 DAY)) AS DATE) AS day FROM bounds)
SELECT g.store, CAST(isoyear(g.day) AS INTEGER) AS iso_year, CAST(week(g.day) AS INTEGER) AS iso_week,
       CAST(isodow(g.day) AS INTEGER) AS iso_weekday, dayname(g.day) AS weekday_name, g.day,
       CAST(d.revenue AS DOUBLE) AS revenue, CAST(d.avg_spend AS DOUBLE) AS avg_spend, d.customers, d.coffees,
       d.day IS NOT NULL AS has_data
FROM grid g LEFT JOIN daily d ON d.store = g.store AND d.day = g.day""",
    "week_grid_absent_weeks_of_item": f"""{_BASE},
rare AS (
  SELECT store, day, count(*) AS coffees FROM sold
  WHERE item_name = '{ITEM_1}' AND day(day) IN (4, 30) GROUP BY store, day),
bounds AS (
  SELECT store, CAST(date_trunc('week', min(day)) AS DATE) AS first, CAST(date_trunc('week', max(day)) AS DATE) AS last
  FROM rare GROUP BY store),
grid AS (
  SELECT store, CAST(unnest(generate_series(first, last + 6, INTERVAL 1 DAY)) AS DATE) AS day FROM bounds)
SELECT g.store, g.day, r.coffees, r.day IS NOT NULL AS has_data
FROM grid g LEFT JOIN rare r ON r.store = g.store AND r.day = g.day""",
    "week_average": f"""{_BASE}
SELECT store, iso_year, iso_week, {_WEEK_MEANS} FROM weeks GROUP BY store, iso_year, iso_week""",
    "weekday_vs_week_average": f"""{_GRID},
week_means AS (
  SELECT store, iso_year, iso_week, {_mean('revenue')} AS mean_revenue
  FROM weeks GROUP BY store, iso_year, iso_week),
diffs AS (
  SELECT store, iso_year, iso_week, iso_weekday, revenue, revenue - mean_revenue AS delta,
         (revenue - mean_revenue) / mean_revenue * 100 AS diff_pct
  FROM filled JOIN week_means USING (store, iso_year, iso_week))
SELECT store, iso_year, iso_week, iso_weekday, revenue, delta, diff_pct,
       CASE WHEN diff_pct IS NOT NULL THEN
         (SELECT arg_min(level, abs(level - diff_pct))
          FROM (VALUES (-4.0::DOUBLE), (-2.0), (0.0), (1.5), (3.0), (4.5)) v(level)) END
         AS impact_level
FROM diffs""",
    "cups_by_timestamp_item": f"""{_BASE}
SELECT store, ts, the_hour, item_name, count(item_name) AS cups_sold
FROM sold GROUP BY store, ts, the_hour, item_name""",
    "cups_by_timestamp_item_one_day": f"""{_BASE}
SELECT store, ts, the_hour, item_name, count(item_name) AS cups_sold
FROM sold WHERE store = 'ASIA' AND day = DATE '{DAY}' GROUP BY store, ts, the_hour, item_name""",
    "cups_by_hour_item": f"""{_BASE}
SELECT store, day, the_hour, item_name, count(item_name) AS cups_sold
FROM sold GROUP BY store, day, the_hour, item_name""",
    "hourly_insights": f"""{_BASE},
hours AS (
  SELECT store, day, the_hour, count(item_name) AS cups FROM sold GROUP BY store, day, the_hour),
means AS (
  SELECT store, day, {_mean('cups')} AS avg_hour_cups FROM hours GROUP BY store, day),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY store, day ORDER BY cups, the_hour) AS from_worst,
            row_number() OVER (PARTITION BY store, day ORDER BY cups DESC, the_hour DESC) AS from_best
  FROM hours),
above AS (
  SELECT h.store, h.day,
         string_agg({_hour_label('h.the_hour')}, ', ' ORDER BY h.the_hour) AS hours_above_avg
  FROM hours h JOIN means m ON m.store = h.store AND m.day = h.day AND h.cups >= m.avg_hour_cups
  GROUP BY h.store, h.day)
SELECT m.store, m.day, w.the_hour AS worst_hour, w.cups AS worst_cups,
       b.the_hour AS best_hour, b.cups AS best_cups, m.avg_hour_cups, a.hours_above_avg,
       {_hour_label('w.the_hour')} || ' [' || CAST(w.cups AS VARCHAR) || ' cups sold]' AS worst_label,
       {_hour_label('b.the_hour')} || ' [' || CAST(b.cups AS VARCHAR) || ' cups sold]' AS best_label
FROM means m
JOIN ranked w ON w.store = m.store AND w.day = m.day AND w.from_worst = 1
JOIN ranked b ON b.store = m.store AND b.day = m.day AND b.from_best = 1
JOIN above a ON a.store = m.store AND a.day = m.day""",
    "store_items": f"{_BASE} SELECT DISTINCT store, item_name FROM sold",
    "item_flavours": f"{_BASE} SELECT DISTINCT store, item_name, item_flavour FROM sold",
    "compare_two_items": _compare(
        [(f"item_name = '{ITEM_1}'", "item_name"), (f"item_name = '{ITEM_2}'", "item_name")],
        "item_name",
    ),
    "compare_same_item_twice": _compare(
        [(f"item_name = '{ITEM_1}'", "item_name")] * 2, "item_name"
    ),
    "compare_two_items_advanced": _compare(
        [
            (
                f"item_name = '{ITEM_1}' AND (item_flavour IN ('red', 'hot') OR item_flavour IS NULL)"
                " AND item_size IN ('Regular', 'Large')",
                _ITEM_TEXT,
            ),
            (
                f"item_name = '{ITEM_2}' AND item_flavour IS NULL AND item_size = 'Regular'",
                _ITEM_TEXT,
            ),
        ],
        "item",
    ),
    "compare_two_items_defaults": _compare(
        [
            (
                f"item_name = '{item}' AND {_default_flavour(item)} AND item_size = 'Regular'",
                _ITEM_TEXT,
            )
            for item in (ITEM_1, ITEM_2)
        ],
        "item",
    ),
    "sales_by_time_of_day": f"""{_BASE}
SELECT item_name, time_of_day, count(item_name) AS cups_sold
FROM sold GROUP BY item_name, time_of_day""",
    "item_popularity": _popularity(),
    "item_popularity_left_out": _popularity(
        "item_name NOT IN ('Flavoured Iced Latte', 'Speciality Tea')"
    ),
    "item_popularity_long": f"""{_BANDS}
SELECT item_name, time_of_day, {_BAND_NAME} AS band, cups_sold FROM bands""",
    "item_popularity_without_two": _popularity(
        f"item_name NOT IN ('{ITEM_1}', '{ITEM_2}')"
    ),
    "item_popularity_without_top": _popularity(
        "item_name NOT IN (SELECT item_name FROM top_items)",
        """, top_items AS (
  SELECT item_name FROM bands GROUP BY item_name ORDER BY sum(cups_sold) DESC, item_name LIMIT 3)""",
    ),
    "best_worst_by_time_of_day": f"""{_BANDS},
tagged AS (
  SELECT {_BAND_NAME} AS band, item_name, cups_sold FROM bands
  UNION ALL SELECT 'all', item_name, cups_sold FROM bands),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY band ORDER BY cups_sold DESC, item_name DESC) AS from_best,
            row_number() OVER (PARTITION BY band ORDER BY cups_sold, item_name) AS from_worst
  FROM tagged)
SELECT b.band, b.item_name AS best_item, b.cups_sold AS best_cups,
       w.item_name AS worst_item, w.cups_sold AS worst_cups
FROM ranked b JOIN ranked w ON w.band = b.band AND w.from_worst = 1 WHERE b.from_best = 1""",
    "store_menu": f"{_MENU} SELECT store, menu_item FROM menu WHERE menu_item <> ''",
    "store_menu_availability": _availability("menu_item"),
    "store_menu_availability_cropped": _availability(f"substr(menu_item, 1, {CROP_TO})"),
    "item_kinds": f"""{_BASE}
SELECT store, time_of_day, item_name, item_flavour, item_size, count(item_name) AS cups
FROM sold GROUP BY ALL""",
}

_AMOUNT = "measure IN ('revenue', 'avg_spend')"
SQL["range_cards"] = f"""
WITH a AS ({SQL["range_availability"]}), v AS ({SQL["range_vs_alltime"]})
SELECT store, 'days_inclusive' AS figure, CAST(days_inclusive AS VARCHAR) AS value, 'Inclusive' AS delta,
       CAST(NULL AS VARCHAR) AS difference, 'off' AS direction FROM a
UNION ALL SELECT store, 'days_available', CAST(days_available AS VARCHAR), rating, NULL, 'normal' FROM a
UNION ALL SELECT store, 'availability', printf('%.2f%%', availability_pct), rating, NULL, 'normal' FROM a
UNION ALL
SELECT store, 'daily_' || measure,
       CASE WHEN {_AMOUNT} THEN printf('$%.2f', range_value) ELSE CAST(CAST(range_value AS BIGINT) AS VARCHAR) END,
       CASE WHEN {_AMOUNT} THEN printf('%.2f', alltime_value) ELSE CAST(CAST(alltime_value AS BIGINT) AS VARCHAR) END,
       CASE WHEN {_AMOUNT} THEN printf('$%.2f', difference) ELSE CAST(CAST(difference AS BIGINT) AS VARCHAR) END,
       direction
FROM v"""

# ---- the same reports for one store, day, week, band or item

_ONE_STORE = f"store = '{STORE}'"
_ONE_DAY = f"{_ONE_STORE} AND day = DATE '{DAY}'"
_ONE_WEEK = f"{_ONE_STORE} AND iso_week = {WEEK[0]} AND iso_year = {WEEK[1]}"


def _part(name: str, condition: str, columns: str = "*") -> str:
    return f"SELECT {columns} FROM ({SQL[name]}) WHERE {condition}"


_PER_HOUR = "the_hour, {item}, cups_sold"
SQL |= {
    f"{name}_one_store": _part(name, _ONE_STORE)
    for name in (
        "store_days_in_range",
        "range_revenue",
        "range_availability",
        "range_kpis",
        "range_vs_alltime",
        "range_cards",
        "store_summary",
        "store_items",
        "store_menu",
        "store_menu_availability",
    )
}
SQL |= {
    f"{name}_one_week": _part(name, _ONE_WEEK)
    for name in (
        "week_grid",
        "week_commencing",
        "week_availability",
        "week_cards",
        "week_average",
        "weekday_vs_week_average",
    )
}
SQL |= {
    "week_grid_week_of_any_year": _part("week_grid", f"{_ONE_STORE} AND iso_week = {WEEK[0]}"),
    "cups_by_hour_item_one_day": _part("cups_by_hour_item", _ONE_DAY),
    "hourly_insights_one_day": _part("hourly_insights", _ONE_DAY),
    "item_flavours_one_item": _part("item_flavours", f"{_ONE_STORE} AND item_name = '{ITEM_1}'"),
    "sales_by_time_of_day_one_band": _part("sales_by_time_of_day", "time_of_day = 2"),
    "compare_two_items_one_day": _part(
        "compare_two_items", _ONE_DAY, _PER_HOUR.format(item="item_name")
    ),
    "compare_two_items_advanced_one_day": _part(
        "compare_two_items_advanced", _ONE_DAY, _PER_HOUR.format(item="item")
    ),
    "compare_two_items_defaults_one_day": _part(
        "compare_two_items_defaults", _ONE_DAY, _PER_HOUR.format(item="item")
    ),
}
# Key of the dashboard's own function -> query, columns.
BREAKDOWN = {
    "alltime": ("store_revenue_alltime", "total_revenue"),
    "alltimedates": ("store_daily_revenue", "revenue, day"),
    "justdays": ("total_days", "n_days"),
    "thesedays": ("store_days_in_range", "n_days"),
    "weekofyear": ("store_weeks", "DISTINCT iso_week"),
    "datesavgrevenue": ("range_revenue", "range_revenue"),
    "avgcsfordates": ("range_revenue", "range_avg_spend"),
    "avgcs": ("store_alltime_averages", "avg_spend"),
    "avgcusts": ("store_alltime_averages", "avg_customers"),
    "avgcups": ("store_alltime_averages", "avg_coffees"),
}
SQL |= {
    f"store_breakdown_{key}": _part(
        name, "TRUE" if key == "justdays" else _ONE_STORE, columns
    )
    for key, (name, columns) in BREAKDOWN.items()
}
SQL["daily_store_streamed"] = SQL["daily_store"]
