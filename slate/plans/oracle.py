"""DuckDB oracle SQL, one statement per registered query.

The oracle is written independently of the Spark code: the adapter tables are
plain SQL views (CTEs) over the driver tables, reports are written as the
original formulated them where floating-point order does not matter, and with
the same arithmetic where it does (so both sides produce identical doubles
without rounding).  The Spark side is also tested against brute-force forms
with a tolerance in ``tests/``.
"""

from __future__ import annotations

import datetime as dt

from slate.constants import DEFAULT_AS_OF, FREE_AGENT_PULL_SIZE


def _d(d: dt.date) -> str:
    return f"DATE '{d.isoformat()}'"


def _ts(d: dt.date) -> str:
    return f"TIMESTAMP '{d.isoformat()} 00:00:00'"


AS_OF = DEFAULT_AS_OF
DOY = AS_OF.timetuple().tm_yday

GAMES = """
games AS (
  SELECT DISTINCT CAST(l.l_shipdate AS DATE) AS game_date, vn.n_name AS visitor, hn.n_name AS home
  FROM lineitem l
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation vn ON s.s_nationkey = vn.n_nationkey
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation hn ON c.c_nationkey = hn.n_nationkey
  WHERE vn.n_nationkey <> hn.n_nationkey
    AND l.l_shipdate >= TIMESTAMP '1997-10-01 00:00:00' AND l.l_shipdate < TIMESTAMP '1998-05-01 00:00:00'
)"""

SCHEDULE = """
schedule AS (
  SELECT game_date AS date,
         CAST(dayofyear(game_date) AS INTEGER) AS day_of_year,
         CAST(week(game_date) AS INTEGER) AS week,
         CAST(isodow(game_date) - 1 AS INTEGER) AS day_of_week,
         CASE WHEN isodow(game_date) >= 6 THEN '15:30' ELSE '19:30' END AS time,
         opponent_abbrev, team_abbrev, matchup, is_visitor
  FROM (
    SELECT game_date, home AS team_abbrev, visitor AS opponent_abbrev, visitor || '@' || home AS matchup,
           0 AS is_visitor FROM games
    UNION ALL
    SELECT game_date, visitor, home, visitor || '@' || home, 1 FROM games
  ) u
)"""

def _player_base_sql(as_of: dt.date) -> str:
    """Per-supplier statistics as of ``as_of`` (the player view before scoring)."""
    return f"""
  SELECT s.s_suppkey AS player_id, s.s_name AS name, n.n_name AS team_abbrev,
    CASE WHEN s.s_suppkey % 5 = 0 THEN 'Free Agent' ELSE 'Roster ' || CAST(s.s_suppkey % 5 AS VARCHAR) END
      AS fantasy_roster_name,
    CASE WHEN s.s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS is_free_agent,
    CASE s.s_suppkey % 3 WHEN 0 THEN 'G' WHEN 1 THEN 'F' ELSE 'C' END AS position,
    CASE s.s_suppkey % 4 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'DAY_TO_DAY' WHEN 2 THEN 'OUT' END AS injury_status,
    SUM(l.l_quantity) AS total_points,
    AVG(l.l_quantity) AS avg_points,
    AVG(CASE WHEN l.l_shipdate > {_ts(as_of - dt.timedelta(days=7))} THEN l.l_quantity END) AS avg_last_7,
    AVG(CASE WHEN l.l_shipdate > {_ts(as_of - dt.timedelta(days=15))} THEN l.l_quantity END) AS avg_last_15,
    AVG(CASE WHEN l.l_shipdate > {_ts(as_of - dt.timedelta(days=30))} THEN l.l_quantity END) AS avg_last_30,
    SUM(CASE WHEN l.l_returnflag <> 'R' THEN l.l_quantity END) AS projected_total_points,
    AVG(CASE WHEN l.l_returnflag <> 'R' THEN l.l_quantity END) AS projected_avg_points
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
  LEFT JOIN lineitem l ON l.l_suppkey = s.s_suppkey AND l.l_shipdate <= {_ts(as_of)}
  GROUP BY s.s_suppkey, s.s_name, n.n_name"""


def _player_sql(base: str) -> str:
    """The scored player view over a ``_player_base_sql`` relation named ``base``."""
    return f"""
  SELECT player_id, name, team_abbrev, fantasy_roster_name, is_free_agent, position, injury_status,
    CAST(injury_status = 'OUT' AS INTEGER) AS injured,
    CASE WHEN is_free_agent = 1 THEN 'FA' ELSE position END AS lineup_slot,
    total_points,
    CAST(0.0 AS DOUBLE) + COALESCE(avg_points * CAST(0.4 AS DOUBLE), CAST(0.0 AS DOUBLE))
      + COALESCE(avg_last_7 * CAST(0.3 AS DOUBLE), CAST(0.0 AS DOUBLE))
      + COALESCE(avg_last_15 * CAST(0.2 AS DOUBLE), CAST(0.0 AS DOUBLE))
      + COALESCE(avg_last_30 * CAST(0.1 AS DOUBLE), CAST(0.0 AS DOUBLE)) AS fantasy_points,
    avg_points, avg_last_7, avg_last_15, avg_last_30, projected_total_points, projected_avg_points
  FROM {base}"""


PLAYER_BASE = f"""
player_base AS ({_player_base_sql(AS_OF)}
)"""

PLAYER = f"""
player AS ({_player_sql("player_base")}
)"""

#: Partial team dictionary over nations (regions 0-2 only): full name -> code.
TEAM_DICT = """
dict AS (SELECT n_name AS name, 'T' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS abbrev
         FROM nation WHERE n_regionkey IN (0, 1, 2))"""

PLAYER_COLS = """player_id, name, team_abbrev, fantasy_roster_name, is_free_agent, position, injury_status, injured,
  lineup_slot, total_points, fantasy_points, avg_points, avg_last_7, avg_last_15, avg_last_30,
  projected_total_points, projected_avg_points"""

PLAYER_KEY = ["name", "team_abbrev", "fantasy_roster_name", "total_points", "avg_points",
              "projected_total_points", "projected_avg_points"]


MART = """
mart AS (
  SELECT p.player_id, p.name, s.date, s.time, s.week, s.day_of_year, s.day_of_week, p.total_points,
         p.avg_points, p.projected_total_points, p.projected_avg_points, p.injury_status, p.injured,
         p.team_abbrev, p.fantasy_roster_name, p.position, s.opponent_abbrev, s.is_visitor, p.is_free_agent
  FROM player p JOIN schedule s ON p.team_abbrev = s.team_abbrev
)"""


def with_views(*names: str) -> str:
    """``WITH`` clause holding the named adapter views and their dependencies."""
    order = ["games", "schedule", "player_base", "player", "mart"]
    deps = {"schedule": {"games"}, "player": {"player_base"}, "mart": {"player", "schedule"}}
    need: set[str] = set()

    def add(n: str) -> None:
        if n in need:
            return
        need.add(n)
        for d in deps.get(n, ()):
            add(d)

    for n in names:
        add(n)
    text = {"games": GAMES, "schedule": SCHEDULE, "player_base": PLAYER_BASE, "player": PLAYER, "mart": MART}
    return "WITH " + ",".join(text[n] for n in order if n in need)


REPORT_COLS = """name, sum_fantasy_points, games, avg_points, avg_last_7, avg_last_15, avg_last_30,
  injury_status, projected_avg_points, sum_avg_points, sum_proj_avg_points, team_abbrev, position"""


def _window_agg(lo: int = 0, hi: int = 6) -> str:
    """Window totals per name, with the same arithmetic as the Spark side."""
    return f"""
agg AS (
  SELECT p.name, CAST(SUM(t.team_games) AS BIGINT) AS games,
         SUM(p.avg_points * t.team_games) AS sum_avg_points,
         SUM(p.projected_avg_points * t.team_games) AS sum_proj_avg_points
  FROM player p JOIN (
    SELECT team_abbrev, COUNT(*) AS team_games FROM schedule
    WHERE day_of_year BETWEEN {DOY + lo} AND {DOY + hi} GROUP BY team_abbrev
  ) t ON p.team_abbrev = t.team_abbrev
  GROUP BY p.name
)"""


def free_agent_report_sql(extra_where: str = "") -> str:
    return f"""{with_views('player', 'schedule')},{_window_agg()}
SELECT {REPORT_COLS} FROM (
  SELECT p.*, a.games, a.sum_avg_points, a.sum_proj_avg_points, p.fantasy_points * a.games AS sum_fantasy_points
  FROM player p LEFT JOIN agg a ON p.name = a.name
  WHERE p.is_free_agent = 1
) x WHERE sum_fantasy_points IS NOT NULL {extra_where}"""


def _weekday_pivot(cell: str) -> str:
    """Seven columns; ``cell`` is an aggregate with ``{day}`` for the weekday's condition."""
    days = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
    return ", ".join(f"{cell.format(day=f'day_of_week = {i}')} AS {n}" for i, n in enumerate(days))


def _team_horizons(days: int) -> str:
    start = _d(AS_OF)
    return f"""
th AS (
  SELECT s.team_abbrev, h.i AS days, COUNT(*) AS games
  FROM schedule s JOIN range(1, {days + 1}) h(i)
    ON s.date >= {start} AND s.date <= {start} + CAST(h.i AS INTEGER)
  GROUP BY s.team_abbrev, h.i
)"""


def _player_report(where: str, side_expr: str | None = None) -> str:
    side = f"{side_expr} AS side, " if side_expr else ""
    return f"""
  SELECT {side}p.*, a.games, a.sum_avg_points, a.sum_proj_avg_points,
         p.fantasy_points * a.games AS sum_fantasy_points
  FROM player p LEFT JOIN agg a ON p.name = a.name
  WHERE {where}"""


def _uuid5(text: str) -> str:
    ns = "6ba7b8109dad11d180b400c04fd430c8"
    h = f"sha1(unhex('{ns}') || encode({text}))"
    return f"""(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
      || substr('89ab', ((position(substr(h, 17, 1) IN '0123456789abcdef') - 1) % 4) + 1, 1)
      || substr(h, 18, 3) || '-' || substr(h, 21, 12) FROM (SELECT {h} AS h))"""


def oracle_sql() -> dict[str, str]:
    """Every oracle statement by query key."""
    q: dict[str, str] = {}
    start = _d(AS_OF)

    q["calendar_attributes"] = """
SELECT date, CAST(week(date) AS INTEGER) AS week, CAST(dayofyear(date) AS INTEGER) AS day_of_year,
       CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, dayname(date) AS day_name
FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem) d"""

    q["clock_24h"] = """
WITH c AS (
  SELECT event_id,
    CASE WHEN event_type = 'error' THEN strftime(ts, '%H:%M')
         ELSE CAST((hour(ts) + 11) % 12 + 1 AS VARCHAR) || ':' || lpad(CAST(minute(ts) AS VARCHAR), 2, '0')
              || CASE WHEN hour(ts) >= 12 THEN 'p' ELSE 'a' END END AS clock_text
  FROM events)
SELECT event_id, clock_text,
  CASE WHEN clock_text LIKE '%p' THEN
         lpad(CAST(CAST(split_part(clock_text, ':', 1) AS INTEGER) % 12 + 12 AS VARCHAR), 2, '0') || ':'
         || substr(split_part(clock_text, ':', 2), 1, 2)
       WHEN clock_text LIKE '%a' THEN
         lpad(CAST(CAST(split_part(clock_text, ':', 1) AS INTEGER) % 12 AS VARCHAR), 2, '0') || ':'
         || substr(split_part(clock_text, ':', 2), 1, 2)
       ELSE clock_text END AS time
FROM c"""

    q["date_parse_coerce"] = """
WITH t AS (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'Date' ELSE strftime(o_orderdate, '%a, %b %-d, %Y') END
    AS date_text FROM orders)
SELECT o_orderkey, date_text, CAST(try_strptime(date_text, '%a, %b %d, %Y') AS DATE) AS parsed_date,
       CAST(try_strptime(date_text, '%a, %b %d, %Y') AS TIMESTAMP) + INTERVAL 19 HOUR + INTERVAL 30 MINUTE
         AS start_ts
FROM t"""

    q["eastern_as_of"] = """
WITH e AS (SELECT event_id, CAST(timezone('America/New_York', timezone('UTC', ts)) AS TIMESTAMP) AS local_ts
           FROM events)
SELECT event_id, local_ts, CAST(local_ts AS DATE) AS local_date, CAST(week(local_ts) AS INTEGER) AS local_week,
       CAST(dayofyear(local_ts) AS INTEGER) AS local_day_of_year,
       strftime(local_ts, '%A, %B %d, %I:%M') AS pretty
FROM e"""

    q["team_lookup_passthrough"] = f"""
WITH {TEAM_DICT}
SELECT c.c_custkey, n.n_name AS team_name, COALESCE(d.abbrev, n.n_name) AS team_abbrev
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN dict d ON n.n_name = d.name"""

    q["schedule_unpivot"] = f"""{with_views('games')}
SELECT game_date AS date, home AS team_abbrev, visitor AS opponent_abbrev, visitor || '@' || home AS matchup,
       0 AS is_visitor FROM games
UNION ALL
SELECT game_date, visitor, home, visitor || '@' || home, 1 FROM games"""

    q["schedule_table"] = f"{with_views('schedule')} SELECT * FROM schedule"
    q["player_table"] = f"{with_views('player')} SELECT * FROM player"
    q["player_schedule_mart"] = f"{with_views('mart')} SELECT * FROM mart"

    q["window_aggregate"] = f"""{with_views('player', 'schedule')},{_window_agg()}
SELECT * FROM agg"""

    q["date_range_scan"] = f"""{with_views('mart')}
SELECT * FROM mart WHERE date BETWEEN {start} AND {start} + 7"""

    q["free_agent_report"] = free_agent_report_sql()
    q["free_agent_filtered"] = free_agent_report_sql("""
  AND CAST(team_abbrev[8:] AS INTEGER) < 15
  AND position IN ('G', 'C') AND injury_status IN ('ACTIVE', 'OUT')
  AND regexp_full_match(name, 'Supplier#[0-9]{9}') AND CAST(name[10:] AS INTEGER) % 10 = 0 AND CAST(name[10:] AS INTEGER) < 2000""")
    q["free_agent_top"] = f"""
SELECT row_number() OVER (ORDER BY sum_avg_points DESC NULLS LAST, name) AS place, name, sum_avg_points
FROM ({free_agent_report_sql()}) QUALIFY place <= 25"""
    q["rising_stars"] = free_agent_report_sql(
        "AND avg_last_7 > 25 AND avg_last_7 > avg_last_30 * CAST(1.3 AS DOUBLE)")

    q["roster_report"] = f"""{with_views('player', 'schedule')},{_window_agg()}
SELECT {REPORT_COLS} FROM ({_player_report(
        "p.is_free_agent = 0 AND p.fantasy_roster_name = 'Roster 2' "
        "AND p.injury_status IN ('ACTIVE', 'DAY_TO_DAY')")}) x"""

    side = """
  SELECT 1 AS side, * FROM player WHERE fantasy_roster_name = 'Roster 1' AND injury_status IN ('ACTIVE')
  UNION ALL
  SELECT 2 AS side, * FROM player WHERE fantasy_roster_name = 'Roster 3' AND injury_status IN ('ACTIVE')"""
    matchup = f"""
  SELECT s.side, s.*, a.games, a.sum_avg_points, a.sum_proj_avg_points,
         s.fantasy_points * a.games AS sum_fantasy_points
  FROM ({side}) s LEFT JOIN agg a ON s.name = a.name"""
    q["matchup_report"] = f"""{with_views('player', 'schedule')},{_window_agg()}
SELECT side, {REPORT_COLS} FROM ({matchup}) x"""
    q["matchup_totals"] = f"""{with_views('player', 'schedule')},{_window_agg()},
m AS ({matchup})
SELECT k.side, k.fantasy_roster_name,
       CAST(trunc(COALESCE((SELECT SUM(sum_fantasy_points) FROM m WHERE m.side = k.side), 0.0)) AS BIGINT)
         AS total_fantasy_points
FROM (VALUES (1, 'Roster 1'), (2, 'Roster 3')) k(side, fantasy_roster_name)"""

    q["week_grid"] = f"""{with_views('schedule')}
SELECT *, CAST((Monday IS NOT NULL)::INTEGER + (Tuesday IS NOT NULL)::INTEGER + (Wednesday IS NOT NULL)::INTEGER
  + (Thursday IS NOT NULL)::INTEGER + (Friday IS NOT NULL)::INTEGER + (Saturday IS NOT NULL)::INTEGER
  + (Sunday IS NOT NULL)::INTEGER AS INTEGER) AS Games
FROM (SELECT team_abbrev, week, {_weekday_pivot("string_agg(DISTINCT opponent_abbrev, ',' ORDER BY opponent_abbrev) FILTER ({day})")}
      FROM schedule GROUP BY team_abbrev, week) g"""

    rest = """
rest AS (
  SELECT *, CAST(CASE WHEN datediff('day', date, LEAD(date) OVER (PARTITION BY team_abbrev ORDER BY date)) > 1
                 THEN datediff('day', date, LEAD(date) OVER (PARTITION BY team_abbrev ORDER BY date)) - 1
                 ELSE 0 END AS INTEGER) AS no_game_days_following
  FROM (SELECT DISTINCT team_abbrev, date, week, day_of_week FROM schedule) s)"""
    q["rest_days"] = f"""{with_views('schedule')},{rest}
SELECT team_abbrev, date, week, day_of_week, no_game_days_following FROM rest"""
    q["rest_grid"] = f"""{with_views('schedule')},{rest}
SELECT team_abbrev, week, {_weekday_pivot("MIN(no_game_days_following) FILTER ({day})")}
FROM rest GROUP BY team_abbrev, week"""

    q["horizon_detailed"] = f"""{with_views('player', 'schedule')},{_team_horizons(7)}
SELECT p.player_id, p.name, p.team_abbrev, p.fantasy_roster_name, p.position,
       SUM(p.avg_points * th.games) AS avg_points, SUM(p.projected_avg_points * th.games) AS projected_avg_points,
       {start} AS start_date, CAST(dayofyear({start}) AS INTEGER) AS start_day_of_year,
       CAST({start} + CAST(th.days AS INTEGER) AS DATE) AS end_date,
       CAST(dayofyear({start} + CAST(th.days AS INTEGER)) AS INTEGER) AS end_day_of_year,
       CAST(th.days AS INTEGER) AS days
FROM player p JOIN th ON p.team_abbrev = th.team_abbrev
GROUP BY p.player_id, p.name, p.team_abbrev, p.fantasy_roster_name, p.position, th.days"""
    q["horizon_slim"] = f"""{with_views('player', 'schedule')},{_team_horizons(7)}
SELECT p.player_id, p.name,
       SUM(p.avg_points * th.games) AS avg_points, SUM(p.projected_avg_points * th.games) AS projected_avg_points,
       {start} AS start_date, CAST({start} + CAST(th.days AS INTEGER) AS DATE) AS end_date,
       CAST(th.days AS INTEGER) AS days
FROM player p JOIN th ON p.team_abbrev = th.team_abbrev
GROUP BY p.player_id, p.name, th.days"""

    q["blended_score"] = f"""{with_views('player')}
SELECT player_id, name, avg_points, avg_last_7, avg_last_15, avg_last_30, fantasy_points FROM player"""
    q["nested_stat_lookup"] = f"""{with_views('player')}
SELECT player_id, avg_last_7, avg_last_15, avg_last_30, injury_status FROM player"""
    q["topn_pull"] = f"""{with_views('player')}
SELECT player_id, name, fantasy_points FROM player WHERE is_free_agent = 1
ORDER BY fantasy_points DESC, player_id LIMIT {FREE_AGENT_PULL_SIZE}"""
    q["topn_per_team"] = f"""{with_views('player')}
SELECT team_abbrev, player_id, name, fantasy_points FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY team_abbrev ORDER BY fantasy_points DESC, player_id) AS rn
  FROM player) r WHERE rn <= 3"""

    orders = """SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate, o_totalprice,
         CASE WHEN o_orderdate < TIMESTAMP '1998-01-01 00:00:00' THEN 0 ELSE 1 END AS batch FROM orders"""
    q["insert_or_ignore"] = f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate, o_totalprice FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority
                               ORDER BY batch, o_orderkey) AS rn
  FROM ({orders}) b) r WHERE rn = 1"""
    q["upsert_latest"] = f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate, o_totalprice FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY batch DESC, o_orderdate DESC, o_orderkey DESC) AS rn
  FROM ({orders}) b) r WHERE rn = 1"""

    o_cols = "o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate, o_totalprice"
    q["insert_or_ignore_loads"] = f"""
SELECT {o_cols} FROM orders WHERE o_orderdate IS NOT NULL
QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority
                           ORDER BY greatest(year(o_orderdate), 1995), o_orderkey) = 1"""
    q["upsert_merge_on_read"] = f"""
SELECT {o_cols} FROM orders WHERE o_orderdate IS NOT NULL
QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""
    q["feed_rejects"] = """
SELECT event_id, event_type AS kind, CAST(NULL AS VARCHAR) AS record FROM events WHERE event_type NOT IN ('click', 'error')
UNION ALL
SELECT NULL, NULL, '{"event_id":' || CASE event_type WHEN 'click' THEN '"no ' || event_id || '"' ELSE CAST(event_id AS VARCHAR) END
       || ',"kind":"' || event_type || '"' || CASE event_type WHEN 'error' THEN '' ELSE '}' END
FROM events WHERE event_type IN ('click', 'error')"""
    q["schema_rejections"] = """
WITH o AS (SELECT o_orderkey IS NULL AS k, o_orderstatus IS NULL OR o_orderstatus = 'P' AS s,
                  o_orderpriority IS NULL OR starts_with(o_orderpriority, '1') AS p FROM orders)
SELECT counted, n FROM (SELECT count(*) AS rows, count(*) FILTER (k OR s OR p) AS rejected, count(*) FILTER (k) AS null_o_orderkey,
                               count(*) FILTER (s) AS null_status, count(*) FILTER (p) AS null_priority,
                               count(*) FILTER (NOT (k OR s OR p)) AS written FROM o)
UNPIVOT (n FOR counted IN (rows, rejected, null_o_orderkey, null_status, null_priority, written))"""

    buyer = "CAST(o_custkey AS VARCHAR) || o_orderstatus || o_orderpriority"
    loads = f"""WITH k AS (SELECT o_orderkey, {_uuid5(buyer)} AS content_uuid, o_orderdate < TIMESTAMP '1998-01-01 00:00:00' AS first
  FROM orders)
SELECT o_orderkey, content_uuid FROM k WHERE NOT first AND content_uuid"""
    q["existing_keys"] = f"{loads} IN (SELECT content_uuid FROM k WHERE first)"
    q["new_keys"] = f"{loads} NOT IN (SELECT content_uuid FROM k WHERE first)"
    q["orphan_rosters"] = f"""{with_views('player')}
SELECT player_id, name, fantasy_roster_name FROM player WHERE fantasy_roster_name NOT IN ('Roster 1', 'Roster 3')"""
    q["player_roster_team"] = f"""{with_views('player')},{TEAM_DICT},
r AS (SELECT fantasy_roster_name AS name, CAST(regexp_extract(fantasy_roster_name, '(\\d+)$', 1) AS INTEGER) AS id,
             CAST(COUNT(CASE WHEN injury_status = 'ACTIVE' THEN 1 END) AS INTEGER) AS standing
      FROM player WHERE fantasy_roster_name IN ('Roster 1', 'Roster 3') GROUP BY fantasy_roster_name)
SELECT p.player_id, p.name, r.id AS roster_id, r.standing AS roster_standing, dict.abbrev AS team_code
FROM player p LEFT JOIN r ON r.name = p.fantasy_roster_name LEFT JOIN dict ON dict.name = p.team_abbrev"""
    q["orphan_keys"] = f"""{with_views('player')}
SELECT player_id, name, team_abbrev FROM player p
WHERE team_abbrev IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM nation n WHERE n.n_regionkey IN (0, 1, 2) AND n.n_name = p.team_abbrev)"""

    q["filter_options"] = f"""{with_views('player')}
SELECT DISTINCT 'name' AS option, CAST(name AS VARCHAR) AS value FROM player
UNION SELECT DISTINCT 'team_abbrev', CAST(team_abbrev AS VARCHAR) FROM player
UNION SELECT DISTINCT 'position', CAST(position AS VARCHAR) FROM player"""
    q["roster_names"] = f"""{with_views('player')}
SELECT DISTINCT fantasy_roster_name AS name FROM player WHERE fantasy_roster_name <> 'Free Agent'"""

    text = ("COALESCE(CAST(o_custkey AS VARCHAR), 'None') || COALESCE(o_orderstatus, 'None') || "
            "COALESCE(strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d'), 'None') || COALESCE(o_orderpriority, 'None') || "
            "COALESCE(CAST(o_totalprice AS VARCHAR), 'None') || "
            "COALESCE(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), 'None')")
    q["content_key"] = f"SELECT o_orderkey, {_uuid5(text)} AS content_uuid FROM orders"

    q["union_pages"] = "SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders"
    q["csv_round_trip"] = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders"""
    q["table_round_trip"] = f"""{with_views('schedule')}
SELECT CAST(date AS TIMESTAMP) AS date, day_of_year, week, day_of_week, time, opponent_abbrev, team_abbrev,
       matchup, is_visitor FROM schedule"""
    q["enforced_schema"] = f"""{with_views('player')}
SELECT * FROM player WHERE player_id IS NOT NULL AND name IS NOT NULL AND is_free_agent IS NOT NULL"""
    q.update(_ingest_sql())
    return q


def _ingest_sql() -> dict[str, str]:
    """Oracles of the ingest jobs over raw inputs rebuilt from the driver tables."""
    q: dict[str, str] = {}
    q["schedule_etl"] = q["schedule_from_pages"] = f"""{with_views('games')},{TEAM_DICT},
g AS (
  SELECT game_date, COALESCE(dv.abbrev, games.visitor) AS v, COALESCE(dh.abbrev, games.home) AS h,
         lpad(CAST((dayofmonth(game_date) * 7) % 24 AS VARCHAR), 2, '0') || ':'
           || lpad(CAST((dayofmonth(game_date) * 5) % 60 AS VARCHAR), 2, '0') AS time
  FROM games LEFT JOIN dict dv ON games.visitor = dv.name LEFT JOIN dict dh ON games.home = dh.name),
u AS (
  SELECT game_date, time, v AS opponent_abbrev, h AS team_abbrev, v || '@' || h AS matchup, 0 AS is_visitor FROM g
  UNION ALL
  SELECT game_date, time, h, v, v || '@' || h, 1 FROM g)
SELECT game_date AS date, CAST(dayofyear(game_date) AS INTEGER) AS day_of_year,
       CAST(week(game_date) AS INTEGER) AS week, CAST(isodow(game_date) - 1 AS INTEGER) AS day_of_week,
       time, opponent_abbrev, team_abbrev, matchup, is_visitor
FROM u"""

    texts = """strftime(game_date, '%a, %b %-d, %Y') AS date_text,
         CAST(((dayofmonth(game_date) * 7) % 24 + 11) % 12 + 1 AS VARCHAR) || ':'
           || lpad(CAST((dayofmonth(game_date) * 5) % 60 AS VARCHAR), 2, '0')
           || CASE WHEN (dayofmonth(game_date) * 7) % 24 >= 12 THEN 'p' ELSE 'a' END AS start_text,
         CAST(strftime(game_date, '%Y%m%d') AS BIGINT) AS page_id"""
    q["html_table_rows"] = f"""{with_views('games')},
g AS (SELECT *, {texts}, CAST(ROW_NUMBER() OVER (PARTITION BY game_date ORDER BY visitor, home) - 1 AS INTEGER) AS row_index FROM games)
SELECT page_id, row_index, '{{"Date":"' || date_text || '","Start (ET)":"' || start_text || '","Visitor/Neutral":"' || visitor
  || '","Home/Neutral":"' || home || '"}}' AS cells_json FROM g
UNION ALL
SELECT page_id, CAST(COUNT(*) AS INTEGER), '{{"Date":"Date","Start (ET)":"Start (ET)","Visitor/Neutral":"Visitor/Neutral","Home/Neutral":"Home/Neutral"}}'
FROM g GROUP BY page_id"""
    q["schedule_raw_csv"] = f"""{with_views('games')},{TEAM_DICT},
g AS (
  SELECT game_date, {texts}, games.visitor AS visitor_name, games.home AS home_name,
         CAST(ROW_NUMBER() OVER (PARTITION BY game_date ORDER BY games.visitor, games.home) - 1 AS INTEGER) AS row_index,
         COALESCE(dv.abbrev, games.visitor) AS v, COALESCE(dh.abbrev, games.home) AS h,
         lpad(CAST((dayofmonth(game_date) * 7) % 24 AS VARCHAR), 2, '0') || ':'
           || lpad(CAST((dayofmonth(game_date) * 5) % 60 AS VARCHAR), 2, '0') AS time
  FROM games LEFT JOIN dict dv ON games.visitor = dv.name LEFT JOIN dict dh ON games.home = dh.name),
u AS (SELECT *, v AS opponent_abbrev, h AS team_abbrev, 0 AS is_visitor FROM g
      UNION ALL SELECT *, h, v, 1 FROM g)
SELECT game_date AS date, page_id, row_index, date_text, start_text,
       CAST(game_date AS TIMESTAMP) + to_hours(CAST(split_part(time, ':', 1) AS INTEGER)) + to_minutes(CAST(split_part(time, ':', 2) AS INTEGER))
         AS datetime,
       time, CAST(week(game_date) AS INTEGER) AS week, CAST(dayofyear(game_date) AS INTEGER) AS day_of_year,
       CAST(isodow(game_date) - 1 AS INTEGER) AS day_of_week, visitor_name, home_name, v || '@' || h AS matchup,
       team_abbrev, opponent_abbrev, is_visitor
FROM u"""

    full_key = " AND ".join(f"{c} IS NOT NULL" for c in PLAYER_KEY)
    required = "player_id IS NOT NULL AND name IS NOT NULL AND is_free_agent IS NOT NULL"
    second = AS_OF + dt.timedelta(days=7)
    q["player_etl"] = f"""
WITH b0 AS ({_player_base_sql(AS_OF)}),
b1 AS ({_player_base_sql(second)}),
u AS (SELECT 0 AS snap, * FROM ({_player_sql('b0')}) p0
      UNION ALL SELECT 1 AS snap, * FROM ({_player_sql('b1')}) p1),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {', '.join(PLAYER_KEY)} ORDER BY snap, player_id) AS rn
      FROM u WHERE {required} AND {full_key})
SELECT {PLAYER_COLS} FROM k WHERE rn = 1
UNION ALL
SELECT {PLAYER_COLS} FROM u WHERE {required} AND NOT ({full_key})"""

    q["warehouse_build"] = f"{with_views('mart')} SELECT * FROM mart"

    q["roster_etl"] = f"""{with_views('player')},
r AS (SELECT fantasy_roster_name AS name,
             TRY_CAST(regexp_extract(fantasy_roster_name, '(\\d+)$', 1) AS INTEGER) AS id,
             COUNT(*) AS n, COUNT(CASE WHEN injury_status = 'ACTIVE' THEN 1 END) AS n_active
      FROM player WHERE is_free_agent = 0 GROUP BY fantasy_roster_name)
SELECT id, 'R' || CAST(id AS VARCHAR) AS abbrev, name, CAST(id % 2 AS VARCHAR) AS division_id,
       'Division ' || CAST(id % 2 AS VARCHAR) AS division_name, CAST(NULL AS VARCHAR) AS owner,
       CAST(n_active AS INTEGER) AS standing, CAST(n AS INTEGER) AS final_standing
FROM r
UNION ALL
SELECT -1, NULL, 'Free Agent', NULL, NULL, NULL, NULL, NULL"""
    return q

