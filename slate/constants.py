"""Fixed values shared by every module.

Everything below the "fixed values" marker must keep these exact contents for
results to agree with the original application (names shown in reports,
dictionary contents, weights, thresholds).  Everything above it is a default
of this library and may be changed by callers through parameters.
"""

from __future__ import annotations

import datetime as _dt

# ---------------------------------------------------------------------------
# Library defaults (parameters, not fixed values)
# ---------------------------------------------------------------------------

#: Fixed "today" used by all driver queries instead of the wall clock.
DEFAULT_AS_OF = _dt.date(1998, 1, 1)

#: The season the driver adapters cut from ``lineitem`` (half-open range).
SEASON_START = _dt.date(1997, 10, 1)
SEASON_END = _dt.date(1998, 5, 1)

#: Season year used in nested stat keys ("{year}_last_7").
DEFAULT_STATS_YEAR = 2024

#: Largest side (bytes, by the planner's estimate of the stored table) that is broadcast.
BROADCAST_MAX_BYTES = 32 * 1024 * 1024

# ---------------------------------------------------------------------------
# Fixed values (must match the original application exactly)
# ---------------------------------------------------------------------------

#: Weekday names, Monday = 0.
WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

#: Roster name and roster id of unowned players.
FREE_AGENT = "Free Agent"
FREE_AGENT_ROSTER_ID = -1

#: Injury statuses offered as report filters.
INJURY_STATUSES = ["ACTIVE", "DAY_TO_DAY", "OUT"]

#: Default report window, offsets in days from "today", both ends inclusive.
DEFAULT_DAY_OFFSET = (0, 6)

#: Size of the bounded free-agent pull.
FREE_AGENT_PULL_SIZE = 200

#: Blended-score weights: season average, last 7, last 15, last 30 days.
BLEND_WEIGHTS = {"avg_points": 0.4, "avg_last_7": 0.3, "avg_last_15": 0.2, "avg_last_30": 0.1}

#: Rising-star rule: recent average strictly above MIN and above RATIO x last-30 average.
RISING_MIN_RECENT = 25
RISING_RATIO = 1.3

#: Columns of the player reports, in display order.
PLAYER_POINTS_COLS = [
    "name",
    "sum_fantasy_points",
    "games",
    "avg_points",
    "avg_last_7",
    "avg_last_15",
    "avg_last_30",
    "injury_status",
    "projected_avg_points",
    "sum_avg_points",
    "sum_proj_avg_points",
    "team_abbrev",
    "position",
]

#: Columns of the player x game projection mart, in order.
MART_COLS = [
    "player_id",
    "name",
    "date",
    "time",
    "week",
    "day_of_year",
    "day_of_week",
    "total_points",
    "avg_points",
    "projected_total_points",
    "projected_avg_points",
    "injury_status",
    "injured",
    "team_abbrev",
    "fantasy_roster_name",
    "position",
    "opponent_abbrev",
    "is_visitor",
    "is_free_agent",
]

#: Seven-column unique key of the player table (insert-or-ignore).
PLAYER_UNIQUE_KEY = [
    "name",
    "team_abbrev",
    "fantasy_roster_name",
    "total_points",
    "avg_points",
    "projected_total_points",
    "projected_avg_points",
]

#: Professional teams: abbreviation, full name (30 rows).
TEAMS = [
    ("ATL", "Atlanta Hawks"),
    ("BOS", "Boston Celtics"),
    ("BKN", "Brooklyn Nets"),
    ("CHA", "Charlotte Hornets"),
    ("CHI", "Chicago Bulls"),
    ("CLE", "Cleveland Cavaliers"),
    ("DAL", "Dallas Mavericks"),
    ("DEN", "Denver Nuggets"),
    ("DET", "Detroit Pistons"),
    ("GSW", "Golden State Warriors"),
    ("HOU", "Houston Rockets"),
    ("IND", "Indiana Pacers"),
    ("LAL", "Los Angeles Lakers"),
    ("LAC", "Los Angeles Clippers"),
    ("MEM", "Memphis Grizzlies"),
    ("MIA", "Miami Heat"),
    ("MIL", "Milwaukee Bucks"),
    ("MIN", "Minnesota Timberwolves"),
    ("NOP", "New Orleans Pelicans"),
    ("NYK", "New York Knicks"),
    ("OKC", "Oklahoma City Thunder"),
    ("ORL", "Orlando Magic"),
    ("PHL", "Philadelphia 76ers"),
    ("PHO", "Phoenix Suns"),
    ("POR", "Portland Trail Blazers"),
    ("SAC", "Sacramento Kings"),
    ("SAS", "San Antonio Spurs"),
    ("TOR", "Toronto Raptors"),
    ("UTA", "Utah Jazz"),
    ("WAS", "Washington Wizards"),
]

#: Stat periods, by enum name.
STAT_PERIODS = ["FULL_SEASON", "FULL_SEASON_PROJECTED", "LAST_7", "LAST_15", "LAST_30"]

#: Stat aggregations, by enum name.
STAT_AGGREGATIONS = ["AVG", "TOTAL"]

#: Stat types, by enum name (22 rows).
STAT_TYPES = [
    "THREE_PT_PERCENTAGE",
    "THREE_PT_ATTEMPT",
    "THREE_PT_MADE",
    "ASSIST",
    "BLOCK",
    "DEFENSIVE_REBOUND",
    "FIELD_GOAL_PERCENTAGE",
    "FIELD_GOAL_ATTEMPT",
    "FIELD_GOAL_MADE",
    "FREE_THROW_PERCENTAGE",
    "FREE_THROW_ATTEMPT",
    "FREE_THROW_MADE",
    "GAMES_PLAYED",
    "GAMES_STARTED",
    "MINUTES",
    "MINUTES_PER_GAME",
    "OFFENSIVE_REBOUND",
    "PERSONAL_FOULS",
    "POINTS",
    "REBOUNDS",
    "STEALS",
    "TURNOVERS",
]

#: Time zone of schedule times and of "today".
EASTERN_TZ = "America/New_York"

#: RFC 4122 name-space id for DNS names (used by content keys).
UUID_NAMESPACE_DNS = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
