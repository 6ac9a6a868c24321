"""DuckDB SQL that computes the registered queries independently, over the same tables."""

from __future__ import annotations

from dockpulse.plans.canonical import CURRENT, PARAMS, PREVIOUS, Snapshot
from dockpulse.plans.catalog import (
    ACTIVITY_AS_OF,
    ACTIVITY_KEEP,
    FRESHNESS_AS_OF,
    FRESHNESS_MAX_AGE,
    LOOKUP_USER,
)
from dockpulse.schemas import SECTION_KEYS, SECTIONS

WINDOW = PARAMS.window_minutes

_SECONDS = "((l_partkey * 43 + l_linenumber * 7) % 86400)"
_CLOCK = f"strftime(TIMESTAMP '1970-01-01' + to_seconds({_SECONDS}), '%H:%M:%S')"
_SCAN_COLUMNS = (
    "serial_number, created_by, created_on, time, scan_timestamp, delivery, status, "
    "warehouse_number, pallet, qty, name"
)
_COMBINED_COLUMNS = f"{_SCAN_COLUMNS}, number_of_packages, shipping_point, extra"
_BATCH = """'{"batch":' || coalesce('"' || batch || '"', 'null')"""
_SCAN_EXTRA = f"""{_BATCH} || ',"note":"' || note || '"}}'"""


def _tag(snapshot: Snapshot) -> str:
    return "cur" if snapshot is CURRENT else "prev"


def _snapshot_ctes(snapshot: Snapshot) -> str:
    t = _tag(snapshot)
    return f"""
raw_{t} AS (
  SELECT l_orderkey || '-' || l_linenumber AS serial_number,
         'U' || l_suppkey AS created_by,
         o_orderdate AS created_on,
         {_CLOCK} AS time,
         o_orderdate + to_seconds({_SECONDS}) AS scan_timestamp,
         CAST(l_orderkey AS VARCHAR) AS delivery,
         CASE WHEN l_shipdate <= TIMESTAMP '{snapshot.day}' THEN 'SHP' ELSE 'ASH' END AS status,
         l_returnflag AS warehouse_number,
         CAST(l_linenumber % 2 AS BIGINT) AS pallet,
         l_quantity AS qty,
         CASE WHEN l_suppkey % 3 <> 0
              THEN 'Worker ' || l_suppkey || '.' || (l_partkey % 3) END AS name,
         CASE WHEN l_partkey % 5 <> 0 THEN 'B' || (l_partkey % 97) END AS batch,
         'N' || l_linenumber AS note
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE o_orderdate <= TIMESTAMP '{snapshot.day}'),
scans_{t} AS (
  SELECT * FROM raw_{t} WHERE warehouse_number = '{PARAMS.warehouse}' AND pallet = {PARAMS.pallet}),
combined_{t} AS (
  SELECT {_SCAN_COLUMNS}, number_of_packages, shipping_point,
         {_BATCH} || ',"note_delivery":"' || priority || '","note_serial":"' || note
           || '","ship-to_party":"' || party || '"}}' AS extra
  FROM scans_{t} JOIN packages USING (delivery)),
dedup_{t} AS (
  SELECT * FROM combined_{t}
  QUALIFY row_number() OVER (
    PARTITION BY serial_number
    ORDER BY (status = 'SHP') DESC, scan_timestamp DESC NULLS LAST, created_by NULLS LAST) = 1),
current_{t} AS (
  SELECT *, CASE status WHEN 'ASH' THEN 'picked' WHEN 'SHP' THEN 'shipped / closed' END
            AS status_description
  FROM dedup_{t})"""


_PACKAGES = """
packages AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS delivery,
         CAST(CASE WHEN o_custkey % 50 = 0 THEN 0 ELSE 1 + o_custkey % 10 END AS DOUBLE)
           AS number_of_packages,
         'SP' || (o_custkey % 7) AS shipping_point,
         o_orderpriority AS priority, 'C' || o_custkey AS party
  FROM orders)"""

_ACTIVITY = """
activity AS (
  SELECT 'U' || user_id AS user_id, event_type AS activity_type, ts AS timestamp FROM events)"""

_UNTIDY = f"""
untidy AS (
  SELECT CASE WHEN l_linenumber = 7 THEN 'S' ELSE '' END || (l_orderkey * 10 + l_linenumber)
           AS serialno,
         'U' || l_suppkey AS user_id,
         CASE WHEN l_linenumber = 6 THEN 'garbage'
              WHEN l_linenumber = 4 THEN strftime(o_orderdate, '%m/%d/%Y')
              WHEN l_linenumber = 3 THEN strftime(o_orderdate, '%Y%m%d')
              WHEN l_linenumber <> 5 THEN strftime(o_orderdate, '%Y-%m-%d') END AS created_date,
         CASE l_suppkey % 10 WHEN 0 THEN NULL WHEN 1 THEN 'ab' WHEN 2 THEN l_orderkey || '.9'
              WHEN 3 THEN l_orderkey || 'D' WHEN 4 THEN l_orderkey || 'f'
              WHEN 5 THEN CASE WHEN l_linenumber % 2 = 0 THEN '  ' ELSE 'NaN' END
              WHEN 6 THEN ' ' || l_orderkey || 'e0 '
              ELSE CAST(l_orderkey AS VARCHAR) END AS delivery_number,
         CASE WHEN l_quantity >= 45 THEN 'n/a'
              WHEN l_quantity >= 40
              THEN CAST(CAST(floor(l_quantity) AS INTEGER) AS VARCHAR) || 'd'
              ELSE CAST(CAST(floor(l_quantity) AS INTEGER) AS VARCHAR) END AS qty,
         CAST(l_linenumber % 2 AS VARCHAR) AS pallet,
         l_returnflag AS warehouse_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE o_orderdate <= TIMESTAMP '{CURRENT.day}'),
tidy AS (
  SELECT serialno AS serial_number, user_id AS created_by, created_date AS created_on,
         delivery_number AS delivery, qty, pallet, warehouse_id AS warehouse_number FROM untidy)"""

_FILES = """
files AS (
  SELECT CASE o_orderkey % 4 WHEN 0 THEN '/inbox/ZMDESNR_' || o_orderkey || '.xlsx'
              WHEN 1 THEN '/inbox/vl06o_' || o_orderkey || '.XLSX'
              WHEN 2 THEN '/inbox/notes_' || o_orderkey || '.xlsx'
              ELSE '/inbox/ZMDESNR_' || o_orderkey || '.csv' END AS path,
         o_orderdate AS modified_at FROM orders),
classified AS (
  SELECT *, CASE WHEN path ILIKE '%.xlsx' AND path ILIKE '%zmdesnr%' THEN 'scans'
                 WHEN path ILIKE '%.xlsx' AND path ILIKE '%vl06o%' THEN 'deliveries' END
            AS report_type FROM files)"""


def _with(select: str, *ctes: str) -> str:
    return f"WITH {','.join(ctes)}\n{select}"


def _on_current(select: str) -> str:
    return _with(select, _PACKAGES, _snapshot_ctes(CURRENT))


def _on_both(select: str) -> str:
    return _with(select, _PACKAGES, _snapshot_ctes(CURRENT), _snapshot_ctes(PREVIOUS))


def _minutes(later: str, earlier: str) -> str:
    return f"(epoch_us({later}) - epoch_us({earlier})) / 6e7"


def _first_names(t: str) -> str:
    return f"""
SELECT created_by AS user_id, coalesce(name, 'User ' || created_by) AS name FROM current_{t}
WHERE created_by IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY created_by
                           ORDER BY serial_number NULLS LAST, scan_timestamp, name) = 1"""


def _users(t: str, as_of: str, window: int = WINDOW) -> str:
    as_of = f"TIMESTAMP '{as_of}'"
    return f"""
SELECT user_id, scan_count, first_scan, last_scan, unique_deliveries,
       CASE WHEN first_scan = last_scan THEN NULL
            ELSE round(scan_count / ((epoch_us(last_scan) - epoch_us(first_scan)) / 3.6e9), 2) END
         AS scans_per_hour,
       round({_minutes(as_of, 'last_scan')}, 2) AS minutes_since_last_scan, name
FROM (SELECT created_by AS user_id, count(scan_timestamp) AS scan_count,
             min(scan_timestamp) AS first_scan, max(scan_timestamp) AS last_scan,
             count(DISTINCT delivery) AS unique_deliveries
      FROM current_{t}
      WHERE created_by IS NOT NULL
        AND scan_timestamp >= {as_of} - to_minutes({window})
      GROUP BY created_by)
JOIN ({_first_names(t)}) USING (user_id)"""


def _scan_times(t: str, as_of: str) -> str:
    return f"""
SELECT user_id, current_scan_time, previous_scan_time,
       {_minutes('current_scan_time', 'previous_scan_time')} AS time_between_scans_minutes,
       serial, status,
       round({_minutes(f"TIMESTAMP '{as_of}'", 'current_scan_time')}, 2) AS minutes_since_last_scan
FROM (SELECT created_by AS user_id, scan_timestamp AS current_scan_time,
             (SELECT max(p.scan_timestamp) FROM current_{t} p
              WHERE p.created_by = c.created_by AND p.scan_timestamp < c.scan_timestamp)
               AS previous_scan_time,
             coalesce(serial_number, '') AS serial, coalesce(status, '') AS status
      FROM current_{t} c
      WHERE created_by IS NOT NULL AND scan_timestamp IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY created_by
                                 ORDER BY scan_timestamp DESC, serial_number, status) = 1)"""


def _progress(t: str) -> str:
    return f"""
SELECT delivery, created_by, scanned_count, number_of_packages,
       CASE WHEN number_of_packages = 0 THEN NULL
            ELSE round(scanned_count / number_of_packages * 100, 2) END AS progress_percentage
FROM (SELECT delivery, created_by, count(*) AS scanned_count FROM current_{t}
      WHERE delivery IS NOT NULL AND created_by IS NOT NULL GROUP BY ALL)
LEFT JOIN (SELECT DISTINCT delivery, number_of_packages FROM current_{t}) USING (delivery)"""


def _delivery_status(t: str) -> str:
    return f"""
SELECT delivery, count(serial_number) AS total_serials,
       count(*) FILTER (status = 'SHP') AS shipped_serials
FROM current_{t} GROUP BY delivery"""


def _section(name: str, snapshot: Snapshot, previous: Snapshot | None) -> str:
    t = _tag(snapshot)
    p = _tag(previous) if previous else None
    columns = f"{_COMBINED_COLUMNS}, status_description"
    if name == "users":
        return _users(t, snapshot.as_of)
    if name == "deliveries":
        return f"SELECT DISTINCT delivery, number_of_packages FROM current_{t}"
    if name == "progress":
        return _progress(t)
    if name == "scan_times":
        return _scan_times(t, snapshot.as_of)
    if name == "serials":
        return (
            "SELECT serial_number, delivery, status, created_by, scan_timestamp, time, created_on, "
            f"status_description FROM current_{t}"
        )
    if name == "status_changes":
        source = (
            f"current_{t} c JOIN (SELECT serial_number AS s, status AS previous_status "
            f"FROM current_{p}) ON serial_number IS NOT DISTINCT FROM s "
            "WHERE status = 'SHP' AND previous_status = 'ASH'"
            if p
            else f"(SELECT *, CAST(NULL AS VARCHAR) AS previous_status FROM current_{t}) WHERE false"
        )
        return f"SELECT {columns}, previous_status, 'shipped' AS event FROM {source}"
    if name == "new_serials":
        unseen = f"AND serial_number NOT IN (SELECT serial_number FROM current_{p})" if p else ""
        return (
            f"SELECT {columns}, 'newly_picked' AS event FROM current_{t} "
            f"WHERE status = 'ASH' {unseen}"
        )
    first = f"AND EXISTS (SELECT 1 FROM current_{p})" if p else "AND false"
    return (
        f"SELECT *, 'completed' AS event FROM ({_delivery_status(t)}) "
        f"WHERE total_serials = shipped_serials {first}"
    )


_NOW = {name: _section(name, CURRENT, PREVIOUS) for name in SECTIONS}
_BEFORE = {name: _section(name, PREVIOUS, None) for name in SECTIONS}
_TIMES = {
    "created_on",
    "scan_timestamp",
    "first_scan",
    "last_scan",
    "current_scan_time",
    "previous_scan_time",
}


def _iso(column: str) -> str:
    return (
        f"strftime({column}, '%Y-%m-%dT%H:%M:%S') || "
        f"CASE WHEN epoch_us({column}) % 1000000 <> 0 THEN strftime({column}, '.%f') ELSE '' END"
    )


def _json(columns: list[str] | tuple[str, ...], prefix: str = "") -> str:
    fields = ", ".join(
        f"'{c}': {_iso(prefix + c) if c in _TIMES else _cell(c, prefix)}" for c in columns
    )
    return f"CAST(to_json({{{fields}}}) AS VARCHAR)"


def _cell(column: str, prefix: str) -> str:
    return f"CAST({prefix}{column} AS JSON)" if column == "extra" else prefix + column


def _records(sections: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS section, {_json(SECTIONS[name].fieldNames())} AS record, "
        f"TIMESTAMP '{CURRENT.as_of}' AS generated_at FROM ({sql})"
        for name, sql in sections.items()
    )


def _same(columns, left: str, right: str) -> str:
    return " AND ".join(f"{left}.{c} IS NOT DISTINCT FROM {right}.{c}" for c in columns)


def _text_of(column: str) -> str:
    if column in _TIMES:
        return f"strftime(b.{column}, '%Y-%m-%d %H:%M:%S')"
    return f"CAST(b.{column} AS VARCHAR)"


def _changed(name: str, now: str, before: str) -> str:
    """Common keys: current row, first differing column, its previous value as text."""
    keys = SECTION_KEYS[name]
    values = [c for c in SECTIONS[name].fieldNames() if c not in keys]
    whens = [f"a.{c} IS DISTINCT FROM b.{c}" for c in values]
    column = " ".join(f"WHEN {w} THEN '{c}'" for w, c in zip(whens, values))
    value = " ".join(f"WHEN {w} THEN {_text_of(c)}" for w, c in zip(whens, values))
    return (
        f"SELECT a.*, CASE {column} END AS changed_column, CASE {value} END AS previous_value "
        f"FROM ({now}) a JOIN ({before}) b ON {_same(keys, 'a', 'b')} WHERE {' OR '.join(whens)}"
    )


def _absent(rows: str, other: str, keys) -> str:
    return (
        f"SELECT a.* FROM ({rows}) a "
        f"WHERE NOT EXISTS (SELECT 1 FROM ({other}) b WHERE {_same(keys, 'a', 'b')})"
    )


def _feed_part(name: str, op: str, rows: str) -> str:
    keys = SECTION_KEYS.get(name)
    changed = op == "changed"
    return f"""
SELECT '{name}' AS section, '{op}' AS op,
       {_json(keys) if keys else 'CAST(NULL AS VARCHAR)'} AS key,
       {'changed_column' if changed else 'CAST(NULL AS VARCHAR)'} AS changed_column,
       {'previous_value' if changed else 'CAST(NULL AS VARCHAR)'} AS previous_value,
       {_json(SECTIONS[name].fieldNames())} AS record
FROM ({rows})"""


def _diff(name: str, now: str, before: str) -> str:
    keys = SECTION_KEYS.get(name)
    columns = keys or SECTIONS[name].fieldNames()
    parts = [
        _feed_part(name, "added", _absent(now, before, columns)),
        _feed_part(name, "removed", _absent(before, now, columns)),
    ]
    if keys:
        parts.append(_feed_part(name, "changed", _changed(name, now, before)))
    return " UNION ALL ".join(parts)


def _change_feed() -> str:
    parts = " UNION ALL ".join(_diff(name, _NOW[name], _BEFORE[name]) for name in SECTIONS)
    return f"SELECT *, TIMESTAMP '{CURRENT.as_of}' AS generated_at FROM ({parts})"


def _counts(sections: dict[str, str], snapshot: Snapshot, snapshot_id: bool) -> str:
    extra = f"'{snapshot.id}' AS snapshot_id, " if snapshot_id else ""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS section, {extra}TIMESTAMP '{snapshot.as_of}' AS updated_at, "
        f"count(*) AS row_count FROM ({sql})"
        for name, sql in sections.items()
    )


def _both_counts(snapshot_id: bool) -> str:
    return (
        f"{_counts(_BEFORE, PREVIOUS, snapshot_id)} UNION ALL {_counts(_NOW, CURRENT, snapshot_id)}"
    )


def _double(column: str) -> str:
    """A decimal number; casts alone would take texts such as 'NaN' too."""
    number = r"\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*"
    return f"CASE WHEN regexp_full_match({column}, '{number}') THEN CAST(trim({column}) AS DOUBLE) END"


def _number(column: str) -> str:
    return f"{_double(column)} AS {column}"


_DAY = (
    "coalesce(TRY_CAST(CASE WHEN NOT regexp_full_match(created_on, '[0-9]+') THEN created_on END "
    "AS TIMESTAMP), try_strptime(created_on, '%m/%d/%Y'), try_strptime(created_on, '%Y%m%d'))"
)


def _kept(n: int) -> str:
    return (
        "SELECT user_id, activity_type, timestamp FROM activity QUALIFY row_number() OVER "
        f"(PARTITION BY user_id ORDER BY timestamp DESC, activity_type) <= {n}"
    )


def _last_activity() -> str:
    return """
SELECT user_id, timestamp AS last_activity, activity_type AS last_activity_type
FROM activity WHERE timestamp IS NOT NULL QUALIFY row_number() OVER
  (PARTITION BY user_id ORDER BY timestamp DESC, activity_type NULLS LAST) = 1"""


def _freshness() -> str:
    known = ", ".join(f"('{name}')" for name in SECTIONS)
    age = f"(epoch_us(TIMESTAMP '{FRESHNESS_AS_OF}') - epoch_us(last_updated)) / 1e6"
    return f"""
WITH log AS (
  SELECT CASE o_orderkey % 3 WHEN 0 THEN 'users' WHEN 1 THEN 'progress' ELSE 'serials' END
           AS section,
         strftime(o_orderdate, '%Y%m%d') || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')
           AS snapshot_id,
         o_orderdate AS updated_at, o_custkey AS row_count FROM orders),
newest AS (
  SELECT section, max(updated_at) AS last_updated, arg_max(row_count, snapshot_id) AS row_count
  FROM log GROUP BY section)
SELECT section, last_updated, {age} AS age_seconds,
       coalesce({age} > {FRESHNESS_MAX_AGE}, true) AS is_stale,
       coalesce(row_count > 0, false) AS has_data
FROM (VALUES {known}) known(section) LEFT JOIN newest USING (section)"""


def _gap_label() -> str:
    seconds = "(epoch_us(current_scan_time) - epoch_us(previous_scan_time)) // 1000000"
    return f"""
SELECT user_id, current_scan_time, previous_scan_time,
       CASE WHEN s < 60 THEN s || ' seconds'
            WHEN s < 3600 THEN (s // 60) || ' min ' || (s % 60) || ' sec'
            ELSE (s // 3600) || ' hr ' || (s % 3600 // 60) || ' min' END AS gap_label
FROM (SELECT *, {seconds} AS s FROM ({_NOW['scan_times']}))"""


def _cards() -> str:
    return f"""
SELECT *, CASE WHEN percent < 25 THEN 'danger' WHEN percent < 50 THEN 'warning'
               WHEN percent < 75 THEN 'info' ELSE 'success' END AS band
FROM (SELECT delivery, current, total,
             CASE WHEN total > 0 THEN CAST(floor(current / total * 100 + 0.5) AS BIGINT) ELSE 0 END
               AS percent
      FROM (SELECT delivery, CAST(sum(scanned_count) AS BIGINT) AS current,
                   coalesce(number_of_packages, 0) AS total
            FROM ({_NOW['progress']}) GROUP BY ALL))"""


def _two_scans() -> str:
    def pick(rank: int, column: str) -> str:
        return f"max({column}) FILTER (r = {rank})"

    return f"""
SELECT created_by AS user_id,
       {pick(1, 'scan_timestamp')} AS current_time, {pick(1, 'serial_number')} AS current_serial,
       {pick(1, 'status')} AS current_status,
       {pick(2, 'scan_timestamp')} AS previous_time, {pick(2, 'serial_number')} AS previous_serial,
       {pick(2, 'status')} AS previous_status
FROM (SELECT *, row_number() OVER (PARTITION BY created_by
                                   ORDER BY scan_timestamp DESC, serial_number) AS r
      FROM current_cur WHERE scan_timestamp IS NOT NULL AND created_by IS NOT NULL)
GROUP BY created_by"""


def _idle_users() -> str:
    return """
SELECT DISTINCT created_by AS user_id, CAST(0 AS BIGINT) AS scan_count,
       CAST(NULL AS TIMESTAMP) AS first_scan, CAST(NULL AS TIMESTAMP) AS last_scan,
       CAST(0 AS BIGINT) AS unique_deliveries, CAST(0 AS DOUBLE) AS scans_per_hour,
       CAST(NULL AS DOUBLE) AS minutes_since_last_scan, CAST(NULL AS VARCHAR) AS name
FROM current_cur WHERE created_by IS NOT NULL AND scan_timestamp IS NOT NULL"""


def _as_of_counts() -> str:
    parts = {
        "scans": "scans_cur",
        "report_deliveries": "packages",
        "combined": "combined_cur",
        "serials": "current_cur",
        "deliveries": f"({_NOW['deliveries']})",
        "progress": f"({_NOW['progress']})",
    }
    return " UNION ALL ".join(
        f"SELECT '{name}' AS section, count(*) AS row_count FROM {source}"
        for name, source in parts.items()
    )


def _activity_metrics() -> str:
    as_of = f"TIMESTAMP '{ACTIVITY_AS_OF}'"
    pairs = "string_agg('\"' || activity_type || '\":' || n, ',' ORDER BY activity_type)"
    return f"""
SELECT user_id, '{{' || {pairs} || '}}' AS activity_counts,
       CAST(sum(n) AS BIGINT) AS total_activities, max(newest) AS last_activity_time,
       round({_minutes(as_of, 'max(newest)')}, 2) AS minutes_since_last_activity
FROM (SELECT user_id, activity_type, count(*) AS n, max(timestamp) AS newest
      FROM ({_kept(ACTIVITY_KEEP)}) GROUP BY ALL)
GROUP BY user_id"""


def _timed() -> str:
    return f"""
WITH timed AS (
  SELECT l_orderkey || '-' || l_linenumber AS serial_number, o_orderdate AS created_on,
         CASE WHEN l_quantity < 5 THEN 'xx' WHEN l_quantity >= 10 THEN {_CLOCK} END AS time
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE o_orderdate <= TIMESTAMP '{CURRENT.day}')
SELECT *, TRY_CAST(strftime(created_on, '%Y-%m-%d') || ' ' || time AS TIMESTAMP) AS scan_timestamp
FROM timed"""


def _blanks() -> str:
    return """
SELECT l_orderkey AS delivery, CASE WHEN l_quantity < 40 THEN l_quantity END AS qty,
       l_returnflag AS warehouse_number
FROM lineitem WHERE l_linenumber <> 3"""


def sql_by_query() -> dict[str, str]:
    plain = "serial_number, created_by, created_on, time, delivery, status, warehouse_number, pallet, qty, name, batch, note"
    plain = plain.replace("delivery,", "CAST(delivery AS DOUBLE) AS delivery,")
    serial_scans = f"SELECT {_SCAN_COLUMNS}, {_SCAN_EXTRA} AS extra FROM scans_cur"
    queries = {
        "read_scans": _on_current(serial_scans),
        "read_deliveries": _with(
            "SELECT delivery, number_of_packages, shipping_point, "
            """'{"note":"' || priority || '","ship-to_party":"' || party || '"}' AS extra FROM packages""",
            _PACKAGES,
        ),
        "combined": _on_current("SELECT * FROM combined_cur"),
        "xlsx_ingest": _on_current(serial_scans),
        "classify_files": _with("SELECT * FROM classified", _FILES),
        "latest_file": _with(
            "SELECT report_type, path, modified_at FROM classified WHERE report_type IS NOT NULL "
            "QUALIFY row_number() OVER (PARTITION BY report_type "
            "ORDER BY modified_at DESC, path DESC) = 1",
            _FILES,
        ),
        "sanitize_headers": _with("SELECT * FROM untidy", _UNTIDY),
        "standardize_columns": _with("SELECT * FROM tidy", _UNTIDY),
        "prepare": _on_current(
            "SELECT serial_number, created_by, CAST(delivery AS DOUBLE) AS delivery, status FROM raw_cur"
        ),
        "clean_numeric": _with(
            f"SELECT * REPLACE ({_number('qty')}, {_number('pallet')}) FROM tidy", _UNTIDY
        ),
        "clean_dates": _with(
            f"SELECT * REPLACE ({_DAY} AS created_on) FROM tidy", _UNTIDY
        ),
        "sanitize_scans": _with(
            f"SELECT * REPLACE ({_number('serial_number')}, {_number('pallet')}, "
            f"{_number('delivery')}, {_number('qty')}, "
            f"{_DAY} AS created_on) FROM tidy",
            _UNTIDY,
        ),
        "sanitize_deliveries": """
SELECT CAST(o_orderkey AS DOUBLE) AS delivery,
       CASE WHEN o_custkey % 20 <> 0 THEN CAST(o_custkey % 10 + 1 AS DOUBLE) END
         AS number_of_packages,
       'SP' || (o_custkey % 7) AS shipping_point
FROM orders""",
        "normalize_delivery": _with(
            f"SELECT * REPLACE (CAST(CAST(trunc({_double('delivery')}) AS BIGINT) AS VARCHAR) "
            f"AS delivery) FROM tidy WHERE {_double('delivery')} IS NOT NULL",
            _UNTIDY,
        ),
        "scan_timestamp": _timed(),
        "drop_blank_rows": _blanks(),
        "filter_warehouse": _on_current(
            f"SELECT {plain} FROM raw_cur WHERE warehouse_number = '{PARAMS.warehouse}'"
        ),
        "filter_pallet": _on_current(f"SELECT {plain} FROM raw_cur WHERE pallet = 1"),
        "dedup_serials": _on_current("SELECT * FROM dedup_cur"),
        "status_description": _on_current(
            "SELECT serial_number, scan_timestamp, status, CASE status WHEN 'ASH' THEN 'picked' "
            "WHEN 'SHP' THEN 'shipped / closed' END AS status_description FROM scans_cur"
        ),
        "status_distribution": _on_current(
            "SELECT status, count(*) AS row_count FROM current_cur GROUP BY status"
        ),
        "progress_lookup": _on_current(
            f"SELECT * FROM ({_NOW['progress']}) WHERE created_by = '{LOOKUP_USER}'"
        ),
        "progress_band": _on_current(_cards()),
        "delivery_status": _on_current(_delivery_status("cur")),
        "scan_times_lookup": _on_current(
            f"SELECT * FROM ({_NOW['scan_times']}) WHERE user_id = '{LOOKUP_USER}'"
        ),
        "scan_gap_label": _on_current(_gap_label()),
        "latest_two_scans": _on_current(_two_scans()),
        "users_from_slices": _on_current(_NOW["users"]),
        "users_idle_fallback": _on_current(_idle_users()),
        "recent_scans": _on_current(
            f"SELECT * FROM current_cur WHERE created_by IS NOT NULL AND scan_timestamp >= "
            f"TIMESTAMP '{CURRENT.as_of}' - to_minutes({WINDOW})"
        ),
        "active_users": _on_current(
            f"SELECT * FROM ({_NOW['users']}) WHERE last_scan >= "
            f"TIMESTAMP '{CURRENT.as_of}' - to_minutes({WINDOW // 3})"
        ),
        "user_names": _on_current(_first_names("cur")),
        "new_serials_first_run": _on_current(_section("new_serials", CURRENT, None)),
        "common_serials": _on_both(
            "SELECT * FROM current_cur WHERE serial_number IN "
            "(SELECT serial_number FROM current_prev)"
        ),
        "diff_added": _on_both(
            _absent(_NOW["progress"], _BEFORE["progress"], SECTION_KEYS["progress"])
        ),
        "diff_removed": _on_both(_absent(_BEFORE["users"], _NOW["users"], SECTION_KEYS["users"])),
        "diff_changed": _on_both(
            _changed("scan_times", _NOW["scan_times"], _BEFORE["scan_times"])
        ),
        "diff_serials": _on_both(_diff("serials", _NOW["serials"], _BEFORE["serials"])),
        "diff_first_run": _on_current(_feed_part("users", "added", _NOW["users"])),
        "activity_last_n": _with(_kept(ACTIVITY_KEEP), _ACTIVITY),
        "activity_history": _with(_kept(20), _ACTIVITY),
        "activity_counts": _with(
            "SELECT user_id, activity_type, count(*) AS activity_count FROM activity GROUP BY ALL",
            _ACTIVITY,
        ),
        "activity_metrics": _with(_activity_metrics(), _ACTIVITY),
        "users_last_activity": _with(
            f"SELECT * FROM ({_NOW['users']}) LEFT JOIN ({_last_activity()}) USING (user_id)",
            _PACKAGES,
            _snapshot_ctes(CURRENT),
            _ACTIVITY,
        ),
        "save_sections": _on_both(_both_counts(snapshot_id=True)),
        "load_section": _on_current(_NOW["serials"]),
        "latest_section": _on_current(_NOW["progress"]),
        "change_feed": _on_both(_change_feed()),
        "dashboard": _on_both(_records(_NOW)),
        "sections_to_json": _on_current(
            _records({n: _NOW[n] for n in ("progress", "deliveries", "serials")})
        ),
        "section_from_json": _on_current(
            f"SELECT *, CAST(NULL AS VARCHAR) AS rescued FROM ({_NOW['serials']})"
        ),
        "section_counts": _on_current(_as_of_counts()),
        "snapshot_freshness": _freshness(),
        "stream_scans": _on_current(serial_scans),
        "stream_refresh": _on_both(_both_counts(snapshot_id=False)),
        "stream_change_feed": _on_both(_change_feed()),
        "stream_activity": _with(_kept(ACTIVITY_KEEP), _ACTIVITY),
    }
    queries.update({name: _on_both(sql) for name, sql in _NOW.items()})
    return queries
