"""DuckDB SQL that gives the result of each query independently of Spark."""

from __future__ import annotations

_REQUIRED = """fare_amount IS NOT NULL AND trip_distance IS NOT NULL
    AND tpep_pickup_datetime IS NOT NULL AND tpep_dropoff_datetime IS NOT NULL"""

_COLUMNS = """tpep_pickup_datetime, tpep_dropoff_datetime, passenger_count, trip_distance,
    fare_amount, extra, mta_tax, tip_amount, tolls_amount, total_amount, payment_type"""

_SECONDS = "(floor(epoch(tpep_dropoff_datetime)) - floor(epoch(tpep_pickup_datetime)))"

_MINUTES = f"round({_SECONDS} / 60.0, 2)"


def _trips(name: str, nan: bool) -> str:
    fare_is_nan = "WHEN l_orderkey % 71 = 0 THEN 'NaN'::DOUBLE" if nan else ""
    return f"""
    {name} AS (
        SELECT * EXCLUDE (copy) FROM (
            SELECT
                CASE WHEN l_orderkey % 83 <> 0 THEN o_orderdate END AS tpep_pickup_datetime,
                CASE WHEN l_orderkey % 79 = 0 THEN NULL
                     WHEN l_orderkey % 61 = 0 THEN o_orderdate + INTERVAL 400 MILLISECONDS
                     ELSE l_shipdate END AS tpep_dropoff_datetime,
                CASE WHEN l_orderkey % 73 <> 0 THEN l_linenumber END AS passenger_count,
                CASE WHEN l_orderkey % 89 <> 0 THEN l_quantity END AS trip_distance,
                CASE WHEN l_orderkey % 97 = 0 THEN NULL
                     {fare_is_nan}
                     WHEN l_orderkey % 67 = 0 THEN -l_extendedprice
                     ELSE l_extendedprice END AS fare_amount,
                l_discount AS extra,
                l_tax AS mta_tax,
                CASE WHEN l_returnflag = 'R' THEN l_quantity END AS tip_amount,
                0.0::DOUBLE AS tolls_amount,
                o_totalprice AS total_amount,
                CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 END AS payment_type,
                l_linestatus AS vendor_name,
                unnest(CASE WHEN l_orderkey % 10 = 0 THEN [1, 2] ELSE [1] END) AS copy
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        )
    )"""


def _silver(name: str, source: str, columns: str = "*") -> str:
    """Clean trips as the DataFrame path defines them."""
    return f"""
    {name} AS (
        SELECT DISTINCT {columns}, {_MINUTES} AS trip_duration_minutes
        FROM {source}
        WHERE {_REQUIRED} AND NOT isnan(fare_amount) AND NOT isnan(trip_distance)
            AND passenger_count BETWEEN 1 AND 6 AND {_MINUTES} > 0
    )"""


def _sql_silver(name: str, source: str) -> str:
    """Clean trips as the SQL path defines them."""
    return f"""
    {name} AS (
        SELECT DISTINCT {_COLUMNS}, {_MINUTES} AS trip_duration_minutes
        FROM {source}
        WHERE {_REQUIRED} AND passenger_count BETWEEN 1 AND 6
            AND tpep_dropoff_datetime > tpep_pickup_datetime
    )"""


def _average(column: str) -> str:
    total = f"sum(CAST(round({column} * 100) AS BIGINT))"
    count = f"count({column})"
    return f"CAST(sign({total}) * ((2 * abs({total}) + {count}) // (2 * {count})) / 100.0 AS DOUBLE)"


def _gold(name: str, source: str) -> str:
    return f"""
    {name} AS (
        SELECT
            CAST(tpep_pickup_datetime AS DATE) AS pickup_date,
            count(*) AS total_trips,
            {_average("fare_amount")} AS avg_fare_usd,
            {_average("trip_distance")} AS avg_trip_distance_miles,
            {_average("trip_duration_minutes")} AS avg_duration_minutes,
            CAST(sum(passenger_count) AS BIGINT) AS total_passengers
        FROM {source}
        GROUP BY 1
    )"""


def _with(*tables: str) -> str:
    return "WITH" + ",".join(tables)


_TRIPS = _trips("trips", nan=False)
_NAN_TRIPS = _trips("nan_trips", nan=True)
_SQL_LAYERS = (_TRIPS, _sql_silver("silver", "trips"), _gold("gold", "silver"))
_LAYERS = (_TRIPS, _silver("silver", "trips"), _gold("gold", "silver"))
_BOTH_SILVERS = (_TRIPS, _silver("silver", "trips"), _sql_silver("sql_silver", "trips"))


def _line(
    table: str,
    rule: str,
    failing: str,
    source: str,
    column: str | None = None,
    severity: str = "critical",
) -> str:
    """One report row; ``failing`` is an aggregate over ``source``."""
    named = f"'{column}'" if column else "CAST(NULL AS VARCHAR)"
    return f"""
    SELECT '{table}' AS table_name, '{rule}' AS rule, {named} AS column_name,
        '{severity}' AS severity, count(*) AS total_rows,
        CAST({failing} AS BIGINT) AS failing_rows, ({failing}) = 0 AS passed
    FROM {source}"""


def _rows(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def _surplus(column: str) -> str:
    return f"count({column}) - count(DISTINCT {column})"


def _key(column: str) -> str:
    return f"count(*) - count(DISTINCT {column})"


def _table(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def _copies(table: str) -> str:
    return f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {table}))"


def _stale(column: str, as_of: str, hours: int) -> str:
    newest = f"max({column})"
    limit = f"TIMESTAMP '{as_of}' - INTERVAL {hours} HOURS"
    return _table(f"{newest} IS NULL OR {newest} < {limit}")


def _unavailable(succeeded: str) -> str:
    return _table(f"count(*) = 0 OR 100.0 * {_rows(succeeded)} < 99 * count(*)")


def _report(tables: tuple[str, ...], *lines: str) -> str:
    return (_with(*tables) if tables else "") + " UNION ALL ".join(lines)


_GOLD_COLUMNS = (
    "pickup_date",
    "total_trips",
    "avg_fare_usd",
    "avg_trip_distance_miles",
    "avg_duration_minutes",
    "total_passengers",
)
_SILVER_DECLARED = (
    "tpep_pickup_datetime",
    "tpep_dropoff_datetime",
    "passenger_count",
    "trip_distance",
    "fare_amount",
    "trip_duration_minutes",
)
_SILVER_COLUMNS = (
    "tpep_pickup_datetime",
    "tpep_dropoff_datetime",
    "passenger_count",
    "trip_distance",
    "fare_amount",
    "extra",
    "mta_tax",
    "tip_amount",
    "tolls_amount",
    "total_amount",
    "payment_type",
    "trip_duration_minutes",
)
_LATE = "(SELECT * FROM events WHERE ts > TIMESTAMP '2024-02-05') late"


def _not_null_lines(table: str, columns: tuple[str, ...], rule: str = "not_null") -> list[str]:
    return [_line(table, rule, _rows(f"{c} IS NULL"), table, c) for c in columns]


def _column_tests() -> list[str]:
    """The tests of the gated run."""
    silver = (
        "tpep_pickup_datetime",
        "tpep_dropoff_datetime",
        "passenger_count",
        "fare_amount",
        "trip_duration_minutes",
    )
    outside = _rows("passenger_count NOT IN (1, 2, 3, 4, 5, 6)")
    lines = _not_null_lines("silver", silver)
    lines.append(_line("silver", "accepted_values", outside, "silver", "passenger_count"))
    lines.append(_line("gold", "unique", _surplus("pickup_date"), "gold", "pickup_date"))
    lines += _not_null_lines("gold", _GOLD_COLUMNS)
    return [
        line.replace("'silver' AS table_name", "'trips_clean' AS table_name").replace(
            "'gold' AS table_name", "'daily_trip_summary' AS table_name"
        )
        for line in lines
    ]


def _silver_rules(table: str, source: str) -> list[str]:
    """The silver contract's lines for the rows of ``source``, named ``table``."""
    columns = (
        "tpep_pickup_datetime",
        "tpep_dropoff_datetime",
        "fare_amount",
        "trip_distance",
        "trip_duration_minutes",
    )
    passengers = "passenger_count < 1 OR passenger_count > 6"
    not_positive = "trip_duration_minutes <= 0 OR isnan(trip_duration_minutes)"
    negative = "fare_amount < 0 OR isnan(fare_amount)"
    pickup = "tpep_pickup_datetime"

    def nulls(names: tuple[str, ...], rule: str) -> list[str]:
        return [_line(table, rule, _rows(f"{c} IS NULL"), source, c) for c in names]

    return [
        *nulls(columns, "not_null"),
        _line(table, "value_between", _rows(passengers), source, "passenger_count"),
        _line(table, "value_above", _rows(not_positive), source, "trip_duration_minutes"),
        _line(table, "value_above_or_equal", _rows(negative), source, "fare_amount", "warning"),
        _line(table, "no_duplicates", _copies(source), source),
        *nulls(_SILVER_DECLARED, "declared_not_null"),
        _line(table, "freshness", _stale(pickup, "2002-01-01", 26), source, pickup),
    ]


def _gold_rules(table: str) -> list[str]:
    """The gold contract's lines for the rows of ``gold``, named ``table``."""
    long_trips = "avg_duration_minutes < 0 OR avg_duration_minutes > 300"

    def line(*arguments: str) -> str:
        return _line(table, arguments[0], arguments[1], "gold", *arguments[2:])

    return [
        *(line("not_null", _rows(f"{c} IS NULL"), c) for c in _GOLD_COLUMNS),
        line("unique", _surplus("pickup_date"), "pickup_date"),
        line("value_above", _rows("total_trips <= 0"), "total_trips"),
        line("value_above", _rows("avg_fare_usd <= 0"), "avg_fare_usd", "warning"),
        line("value_between", _rows(long_trips), "avg_duration_minutes", "warning"),
        line("row_count_above", _table("count(*) < 1")),
        *(line("declared_not_null", _rows(f"{c} IS NULL"), c) for c in _GOLD_COLUMNS),
        line("primary_key", _key("pickup_date"), "pickup_date"),
        line("freshness", _stale("pickup_date", "2002-01-01", 27), "pickup_date"),
    ]


def _plain_daily() -> str:
    """Averages rounded half up from their shortest decimal text, as Spark rounds."""

    def mean(column: str) -> str:
        return f"CAST(round(CAST(CAST(avg({column}) AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DOUBLE)"

    return f""" SELECT CAST(tpep_pickup_datetime AS DATE) AS pickup_date, count(*) AS total_trips,
            {mean("trip_distance")} AS avg_distance, {mean("passenger_count")} AS avg_passengers,
            CAST(sum(passenger_count) AS BIGINT) AS total_passengers
        FROM silver GROUP BY 1"""


def _schema_lines(table: str, columns: tuple[str, ...], present: bool) -> list[str]:
    return [
        f"""
    SELECT '{table}' AS table_name, 'schema' AS rule, '{c}' AS column_name, 'critical' AS severity,
        CAST(NULL AS BIGINT) AS total_rows, CAST({int(not present)} AS BIGINT) AS failing_rows, {present} AS passed"""
        for c in columns
    ]


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    passengers = "passenger_count < 1 OR passenger_count > 6"
    not_positive = "trip_duration_minutes <= 0 OR isnan(trip_duration_minutes)"
    negative = "fare_amount < 0 OR isnan(fare_amount)"
    silver = _with(_TRIPS, _silver("silver", "trips"))
    nan_silver = (_NAN_TRIPS, _silver("silver", "nan_trips"))
    sql_silver = _with(_TRIPS, _sql_silver("silver", "trips"))
    daily = _with(*nan_silver, _gold("gold", "silver")) + " SELECT * FROM gold"
    sql_daily = _with(*_SQL_LAYERS) + " SELECT * FROM gold"
    trips = _with(_TRIPS)
    trip_declared = tuple(c for c in _SILVER_DECLARED if c != "trip_duration_minutes")
    return {
        "bronze_passthrough": "SELECT * FROM events",
        "bronze_append_evolved": """
            SELECT event_id, ts, user_id, event_type, value, CAST(NULL AS VARCHAR) AS props FROM events
            UNION ALL SELECT event_id, ts, user_id, event_type, value, props FROM events""",
        "bronze_table_evolved": """
            SELECT event_id, ts, user_id, event_type, value,
                CAST(NULL AS VARCHAR) AS props, CAST(NULL AS DATE) AS received FROM events
            UNION ALL SELECT event_id, ts, user_id, event_type, NULL, props, CAST(ts AS DATE) FROM events
            UNION ALL SELECT event_id, ts, user_id, event_type, value, props, NULL FROM events""",
        "bronze_partitioned_evolved": """
            SELECT event_id, user_id, event_type, value, CAST(NULL AS BIGINT) AS twice FROM events
            UNION ALL SELECT event_id, user_id, event_type, value, user_id * 2 FROM events""",
        "bronze_nested_evolved": """
            SELECT event_id, user_id AS second_id, user_id AS who_user,
                CASE WHEN batch > 2 THEN value END AS who_worth, CASE WHEN batch > 2 THEN event_type END AS note
            FROM events, range(1, 5) AS t(batch)""",
        "bronze_lines": """
            WITH spoiled AS (
                SELECT *, CASE WHEN event_id % 7 = 0 THEN 'many' ELSE CAST(user_id AS VARCHAR) END AS word,
                    event_id % 7 = 0 OR event_id % 11 = 0 AS bad
                FROM events
            ), lines AS (
                SELECT 'csv' AS format, *, event_id || ',' || word || ',' || event_type AS text FROM spoiled
                UNION ALL
                SELECT 'json', *, '{"event_id":' || event_id || ',"user_id":' || CASE WHEN word = 'many' THEN '"many"' ELSE word END
                    || ',"event_type":"' || event_type || '"}' FROM spoiled
            )
            SELECT format, CASE WHEN NOT bad THEN event_id END AS event_id, CASE WHEN NOT bad THEN user_id END AS user_id,
                CASE WHEN NOT bad THEN event_type END AS event_type,
                CASE WHEN bad THEN CASE WHEN event_id % 11 = 0 THEN substr(text, 1, 5) ELSE text END END AS line
            FROM lines""",
        "bronze_widen_retried": """
            SELECT event_id, user_id AS who_user, CASE WHEN batch = 2 THEN value END AS who_worth,
                CASE WHEN batch = 2 THEN event_type END AS event_type
            FROM events, range(1, 3) AS t(batch)""",
        "bronze_batch_retried": """
            SELECT event_id, user_id, event_type, CASE WHEN batch = 'second' THEN value END AS value, batch AS ingest_batch
            FROM events, (VALUES ('first'), ('second')) AS t(batch)""",
        "silver_refresh": silver + " SELECT * FROM silver",
        "drop_incomplete": _with(_NAN_TRIPS)
        + f""" SELECT * FROM nan_trips
            WHERE {_REQUIRED} AND NOT isnan(fare_amount) AND NOT isnan(trip_distance)""",
        "drop_null_sql": _with(_NAN_TRIPS)
        + f""" SELECT isnan(fare_amount) AS fare_is_nan, count(*) AS trips
            FROM nan_trips WHERE {_REQUIRED} GROUP BY 1""",
        "keep_between": trips + " SELECT * FROM trips WHERE passenger_count BETWEEN 1 AND 6",
        "elapsed_minutes": trips + f" SELECT *, {_MINUTES} AS trip_duration_minutes FROM trips",
        "keep_positive_elapsed": trips
        + f" SELECT *, {_MINUTES} AS trip_duration_minutes FROM trips WHERE {_MINUTES} > 0",
        "keep_end_after_start": trips
        + " SELECT * FROM trips WHERE tpep_dropoff_datetime > tpep_pickup_datetime",
        "project_columns": trips
        + f" SELECT {_COLUMNS}, {_MINUTES} AS trip_duration_minutes FROM trips",
        "dedupe_rows": trips + " SELECT DISTINCT * FROM trips",
        "scalar_functions": trips
        + f""" SELECT
                CAST(floor(epoch(tpep_pickup_datetime)) AS BIGINT) AS start_seconds,
                CAST(floor(epoch(tpep_dropoff_datetime)) AS BIGINT) AS end_seconds,
                CAST({_SECONDS} AS BIGINT) AS seconds,
                CAST(tpep_pickup_datetime AS DATE) AS pickup_date,
                CAST(passenger_count AS BIGINT) AS passengers,
                tpep_dropoff_datetime > tpep_pickup_datetime AS ends_after_start,
                passenger_count BETWEEN 1 AND 6 AS passengers_in_range,
                fare_amount IS NOT NULL AS has_fare
            FROM trips""",
        "silver_clean": _with(*nan_silver) + " SELECT * FROM silver",
        "silver_clean_closed": _with(_TRIPS, _silver("silver", "trips", _COLUMNS))
        + " SELECT * FROM silver",
        "silver_clean_sql": sql_silver + " SELECT * FROM silver",
        "silver_clean_recomputed": _with(*nan_silver) + " SELECT * FROM silver",
        "silver_clean_sql_nan": _with(_NAN_TRIPS, _sql_silver("silver", "nan_trips"))
        + """ SELECT CAST(tpep_pickup_datetime AS DATE) AS day, isnan(fare_amount) AS is_nan, count(*) AS trips
            FROM silver GROUP BY 1, 2""",
        "daily_summary_sql_nan": _with(_NAN_TRIPS, _sql_silver("silver", "nan_trips"))
        + f""" SELECT CAST(tpep_pickup_datetime AS DATE) AS pickup_date, count(*) AS total_trips,
                CAST(sum(passenger_count) AS BIGINT) AS total_passengers,
                {_average("trip_distance")} AS avg_trip_distance_miles,
                bool_or(isnan(fare_amount)) AS exact_is_nan, bool_or(isnan(fare_amount)) AS plain_is_nan,
                CASE WHEN NOT bool_or(isnan(fare_amount))
                    THEN {_average("(CASE WHEN NOT isnan(fare_amount) THEN fare_amount END)")} END AS avg_fare_usd
            FROM silver GROUP BY 1""",
        "daily_summary_plain": silver + _plain_daily(),
        "daily_summary_plain_sql": sql_silver + _plain_daily(),
        "daily_summary": daily,
        "daily_summary_sql": sql_daily,
        "rerun_idempotent": silver + " SELECT * FROM silver",
        "silver_incremental": silver + " SELECT * FROM silver",
        "gold_incremental": daily,
        "layered_gold": daily,
        "gold_stored_order": _with(*nan_silver, _gold("gold", "silver"))
        + " SELECT pickup_date, total_trips, row_number() OVER (ORDER BY pickup_date) AS position FROM gold",
        "layered_gold_sql": sql_daily,
        "gated_gold": sql_daily,
        "gated_report": _report(_SQL_LAYERS, *_column_tests()),
        "check_not_null": _report(
            _SQL_LAYERS,
            *_not_null_lines("trips", ("fare_amount",)),
            *_not_null_lines("silver", ("fare_amount",)),
        ),
        "check_declared_nulls": _report(
            _SQL_LAYERS,
            *_not_null_lines("trips", trip_declared, "declared_not_null"),
            *_not_null_lines("silver", _SILVER_DECLARED, "declared_not_null"),
        ),
        "check_unique": _report(
            _LAYERS,
            _line("gold", "unique", _surplus("pickup_date"), "gold", "pickup_date"),
            _line("lineitem", "unique", _surplus("l_orderkey"), "lineitem", "l_orderkey"),
        ),
        "check_primary_key": _report(
            _LAYERS,
            _line("gold", "primary_key", _key("pickup_date"), "gold", "pickup_date"),
            _line(
                "trips", "primary_key", _key("tpep_pickup_datetime"), "trips", "tpep_pickup_datetime"
            ),
        ),
        "check_accepted_values": _report(
            _SQL_LAYERS,
            *(
                _line(
                    t,
                    "accepted_values",
                    _rows("passenger_count NOT IN (1, 2, 3, 4, 5, 6)"),
                    t,
                    "passenger_count",
                )
                for t in ("silver", "trips")
            ),
        ),
        "check_value_between": _report(
            (*_SQL_LAYERS, _NAN_TRIPS),
            _line("silver", "value_between", _rows(passengers), "silver", "passenger_count"),
            _line("trips", "value_between", _rows(passengers), "trips", "passenger_count"),
            _line(
                "trips with NaN",
                "value_between",
                _rows("isnan(fare_amount) OR fare_amount < 0 OR fare_amount > 50000"),
                "nan_trips",
                "fare_amount",
                "warning",
            ),
        ),
        "check_value_above": _report(
            _BOTH_SILVERS,
            _line("silver", "value_above", _rows(not_positive), "silver", "trip_duration_minutes"),
            _line(
                "sql silver",
                "value_above",
                _rows(not_positive),
                "sql_silver",
                "trip_duration_minutes",
            ),
        ),
        "check_value_above_or_equal": _report(
            _BOTH_SILVERS,
            _line("silver", "value_above_or_equal", _rows(negative), "silver", "fare_amount", "warning"),
            _line(
                "sql silver",
                "value_above_or_equal",
                _rows(negative),
                "sql_silver",
                "fare_amount",
                "warning",
            ),
            _line(
                "orders", "value_above_or_equal", _rows("o_totalprice < 0"), "orders", "o_totalprice"
            ),
        ),
        "check_not_empty": _report(
            (_TRIPS,),
            _line("trips", "table_not_empty", _table("count(*) = 0"), "trips"),
            _line("late events", "table_not_empty", _table("count(*) = 0"), _LATE),
        ),
        "check_row_count": _report(
            (_TRIPS,),
            _line("trips", "row_count_above", _table("count(*) < 1"), "trips"),
            _line("late events", "row_count_above", _table("count(*) < 1"), _LATE),
        ),
        "check_no_future": _report(
            (),
            _line(
                "events at mid month",
                "no_future",
                _rows("ts > TIMESTAMP '2024-01-15'"),
                "events",
                "ts",
                "warning",
            ),
            _line(
                "events at month end",
                "no_future",
                _rows("ts > TIMESTAMP '2024-01-31'"),
                "events",
                "ts",
                "warning",
            ),
        ),
        "check_no_duplicates": _report(
            _SQL_LAYERS,
            _line("silver", "no_duplicates", _copies("silver"), "silver"),
            _line("trips", "no_duplicates", _copies("trips"), "trips"),
        ),
        "footer_report": _report(
            (),
            _line("event days", "table_not_empty", _table("count(*) = 0"), "events"),
            _line("event days", "row_count_above", _table("count(*) < 1"), "events"),
            _line("event days", "no_future", _rows("ts > TIMESTAMP '2024-01-15'"), "events", "ts", "warning"),
            _line("event days", "freshness", _stale("ts", "2024-02-05", 25), "events", "ts"),
            _line(
                "event days",
                "freshness",
                _table("max(day) < TIMESTAMP '2024-01-31 02:00:00' - INTERVAL 1530 MINUTES"),
                "(SELECT CAST(ts AS DATE) AS day FROM events) days",
                "day",
            ),
        ),
        "check_freshness": _report(
            (),
            _line("events at month end", "freshness", _stale("ts", "2024-01-31", 25), "events", "ts"),
            _line("events later", "freshness", _stale("ts", "2024-02-05", 25), "events", "ts"),
            *(
                _line(
                    name,
                    "freshness",
                    _table(f"max(day) < TIMESTAMP '2024-01-31 02:00:00' - INTERVAL {minutes} MINUTES"),
                    "(SELECT CAST(ts AS DATE) AS day FROM events) days",
                    "day",
                )
                for name, minutes in (("event days", 1530), ("event days, longer", 1590))
            ),
        ),
        "check_availability": _report(
            (),
            _line(
                "orders",
                "availability",
                _unavailable("o_orderstatus <> 'P'"),
                "orders",
                "ok",
            ),
            _line(
                "lineitem",
                "availability",
                _unavailable("l_linestatus IN ('F', 'O')"),
                "lineitem",
                "ok",
            ),
        ),
        "bronze_report": _report(
            (_TRIPS,),
            _line("bronze", "table_not_empty", _table("count(*) = 0"), "trips"),
            _line(
                "bronze",
                "no_future_pickup_dates",
                _rows("tpep_pickup_datetime > TIMESTAMP '2000-01-01'"),
                "trips",
                "tpep_pickup_datetime",
                "warning",
            ),
            _line(
                "bronze",
                "freshness",
                _stale("tpep_pickup_datetime", "2000-01-01", 25),
                "trips",
                "tpep_pickup_datetime",
            ),
        ),
        "contract_report": _report(_SQL_LAYERS, *_silver_rules("silver", "silver")),
        "gold_report": _report(_SQL_LAYERS, *_gold_rules("gold")),
        "contract_conformance": _report(
            _LAYERS,
            *_schema_lines("trips", _SILVER_COLUMNS, True),
            *_silver_rules("trips", "silver"),
            *_schema_lines("daily_trip_summary", _GOLD_COLUMNS, True),
            *_gold_rules("daily_trip_summary"),
            *_schema_lines("raw", _GOLD_COLUMNS, False),
        ),
    }
