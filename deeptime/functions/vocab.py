"""Closed vocabularies and constants of the data model."""

from __future__ import annotations

# The vocabularies of the data model.
ENTITY_TYPES = (
    "event person species object place organization state civilization idea theory discovery invention patent paper book artwork film game product "
    "technology standard law religion language disease chemical material structure astronomical_object natural_event future_event record time_series"
).split()
STATUSES = "observed documented estimated projected model_dependent speculative legendary disputed".split()
RELATIONS = (
    "part_of caused_by resulted_in invented_by based_on built_upon replaced influenced influenced_by occurred_at participant contemporary_with spread_to "
    "disproved_by confirmed_by discovered_by used_by created_by preceded succeeded supports parent_taxon depicts about"
).split()
CATEGORIES = "universe earth life war politics science technology culture exploration economy religion disaster future".split()
VALUE_TYPES = "measured estimated reconstructed projected".split()
REPRESENTATIONS = "exact administrative estimated fuzzy point_distribution".split()
# Labels from coarse to fine, with the finest bucket each may reach.
FINEST = {"billion_year": 2, "million_year": 4, "millennium": 7, "century": 8, "decade": 9, "year": 10, "month": 11, "day": 12, "hour": 13, "minute": 13, "second": 13}
# The label under which a relation shows on its target's document.
INVERSE = {
    "contemporary_with": "contemporary_with", "caused_by": "resulted_in", "resulted_in": "caused_by", "preceded": "succeeded",
    "succeeded": "preceded", "built_upon": "influenced", "based_on": "influenced", "supports": "confirmed_by",
}
# Properties that start and end an item, in order of preference.
START_PROPERTIES = ["P580", "P585", "P571", "P569", "P575", "P577", "P574"]
END_PROPERTIES = ["P582", "P576", "P570"]

# The mean year, window lengths, importance floors and caps.
YEAR_S = 31_556_952.0
MAX_WINDOWED = 1e18
#: Window length of each bucket in seconds; 0 is one window for all time.
WINDOW_S = [0.0, 0.0, 0.0] + [YEAR_S * y for y in (1e7, 1e6, 1e5, 1e4, 1e3, 100.0, 10.0, 1.0)] + [2_629_746.0, 86_400.0, 3_600.0]
FLOOR = [0.92, 0.90, 0.88, 0.86, 0.84, 0.80, 0.75, 0.65, 0.55, 0.40, 0.25, 0.15, 0.05, 0.0]
MAX_WINDOWS, CHUNK_CAP, CATEGORY_CAP = 1024, 200, 80

#: The bucket table in portable SQL.
BUCKET_SQL = "bucket(b, window_s, least_importance) AS (VALUES " + ", ".join(f"({b}, {w!r}e0, {f!r}e0)" for b, (w, f) in enumerate(zip(WINDOW_S, FLOOR))) + ")"
FINEST_SQL = "CASE precision " + " ".join(f"WHEN '{p}' THEN {b}" for p, b in FINEST.items()) + " END"
