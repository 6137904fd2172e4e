"""Fixed values that results depend on: vocabularies, limits, lookups and texts."""

from __future__ import annotations

# --- event categories (fixed values) ---------------------------------------------------
CATEGORY_TYPES = {
    "wind": [
        "Thunderstorm Wind", "High Wind", "Hurricane", "Hurricane (Typhoon)", "Tornado",
        "Strong Wind", "Tropical Storm",
    ],
    "ice": [
        "Ice Storm", "Winter Storm", "Heavy Snow", "Winter Weather", "Blizzard",
        "Freezing Rain", "Sleet",
    ],
    "heat": ["Heat", "Excessive Heat"],
    "flood": ["Flash Flood", "Flood", "Coastal Flood"],
    "drought": ["Drought"],
    "fire": ["Wildfire"],
}
CATEGORIES = ["drought", "fire", "flood", "heat", "ice", "wind"]
CATEGORY_PAIRS = [(a, b) for i, a in enumerate(CATEGORIES) for b in CATEGORIES[i + 1:]]

# --- feature windows (fixed values) ----------------------------------------------------
WEATHER_WINDOWS_H = [1, 3, 6, 12, 24, 48, 72]
OUTAGE_LAGS_H = [1, 3, 6, 12, 24, 48, 168]
OUTAGE_TRENDS_H = [3, 6, 12]

# --- severe types of the early labelled set (fixed values) -----------------------------
SEVERE_TYPES = [
    "Thunderstorm Wind", "High Wind", "Heavy Snow", "Ice Storm", "Winter Storm", "Hurricane",
    "Tornado",
]

# --- base outage probability per event type (fixed values) -----------------------------
BASE_OUTAGE_RISK = {
    "Tornado": 0.85, "Hurricane": 0.90, "Hurricane (Typhoon)": 0.90, "Ice Storm": 0.80,
    "Blizzard": 0.70, "Thunderstorm Wind": 0.45, "High Wind": 0.40, "Heavy Snow": 0.35,
    "Winter Storm": 0.50, "Winter Weather": 0.20, "Tropical Storm": 0.60, "Flash Flood": 0.30,
    "Flood": 0.25, "Coastal Flood": 0.35, "Excessive Heat": 0.45, "Heat": 0.30, "Drought": 0.15,
    "Wildfire": 0.70, "Strong Wind": 0.30, "Hail": 0.25, "Lightning": 0.20,
}
DEFAULT_OUTAGE_RISK = 0.15

# --- alert feed (fixed values) ---------------------------------------------------------
ALERT_MAGNITUDE = {"Extreme": 100.0, "Severe": 75.0, "Moderate": 50.0, "Minor": 25.0, "Unknown": 10.0}
ALERT_TYPES = [
    "Tornado Warning", "Tornado Watch", "Severe Thunderstorm Warning", "Severe Thunderstorm Watch",
    "Flash Flood Warning", "Flash Flood Watch", "Flood Warning", "Flood Watch", "Flood Advisory",
    "Winter Storm Warning", "Winter Storm Watch", "Winter Weather Advisory", "Blizzard Warning",
    "Ice Storm Warning", "Wind Advisory", "High Wind Warning", "Extreme Wind Warning",
    "Hurricane Warning", "Hurricane Watch", "Tropical Storm Warning", "Tropical Storm Watch",
    "Storm Surge Warning", "Storm Surge Watch", "Excessive Heat Warning", "Excessive Heat Watch",
    "Heat Advisory", "Wind Chill Warning", "Wind Chill Watch", "Wind Chill Advisory",
    "Fire Weather Watch", "Red Flag Warning", "Dense Fog Advisory", "Freeze Warning",
    "Frost Advisory", "Coastal Flood Warning", "Coastal Flood Watch", "Coastal Flood Advisory",
    "Rip Current Statement", "Tsunami Warning", "Tsunami Watch", "Special Weather Statement",
    "Severe Weather Statement",
]

# --- station measurements: accepted ranges (fixed values) ------------------------------
STATION_RANGES = {
    "tmpf": (-80.0, 140.0), "dwpf": (-80.0, 100.0), "sknt": (0.0, 200.0), "gust": (0.0, 250.0),
    "p01i": (0.0, 30.0), "vsby": (0.0, 100.0), "alti": (25.0, 35.0), "relh": (0.0, 100.0),
}
STATIONS = {
    "KIAH": (29.9844, -95.3414), "KHOU": (29.6454, -95.2789), "KDFW": (32.8968, -97.0380),
    "KDAL": (32.8471, -96.8518), "KSAT": (29.5337, -98.4698), "KAUS": (30.1945, -97.6699),
    "KELP": (31.8072, -106.3776), "KMAF": (31.9425, -102.2019), "KLBB": (33.6636, -101.8228),
    "KAMA": (35.2194, -101.7060), "KCRP": (27.7704, -97.5012), "KMCJ": (26.1759, -97.9614),
    "KBPT": (29.9508, -94.0207), "KGGG": (32.3840, -94.7115), "KACT": (31.6113, -97.2305),
    "KLAX": (33.9425, -118.4081), "KSFO": (37.6197, -122.3647), "KSAN": (32.7336, -117.1897),
    "KSJC": (37.3626, -121.9291), "KSAC": (38.5125, -121.4935), "KOAK": (37.7213, -122.2208),
    "KONT": (34.0560, -117.6012), "KBUR": (34.2007, -118.3585),
    "KMIA": (25.7959, -80.2870), "KFLL": (26.0726, -80.1527), "KTPA": (27.9755, -82.5332),
    "KMCO": (28.4294, -81.3090), "KJAX": (30.4941, -81.6879), "KRSW": (26.5362, -81.7552),
    "KPBI": (26.6832, -80.0956), "KTLH": (30.3965, -84.3503),
}

# --- geography (fixed values) ----------------------------------------------------------
STATE_FIPS = {
    "TX": "48", "CA": "06", "FL": "12", "NY": "36", "PA": "42", "OH": "39", "IL": "17", "GA": "13",
    "NC": "37", "MI": "26", "NJ": "34", "VA": "51", "LA": "22", "WA": "53", "OR": "41", "CO": "08",
    "AZ": "04", "MA": "25", "TN": "47", "IN": "18", "MO": "29", "MD": "24", "WI": "55", "MN": "27",
    "SC": "45", "AL": "01", "KY": "21", "OK": "40", "CT": "09", "IA": "19", "MS": "28", "AR": "05",
    "KS": "20", "NV": "32", "NE": "31", "NM": "35",
}
COUNTY_CENTROID = {
    "48201": (29.7604, -95.3698), "48113": (32.7767, -96.7970), "48029": (29.4241, -98.4936),
    "48439": (30.2672, -97.7431), "48141": (32.7555, -97.3308), "48085": (33.0198, -96.6989),
    "48157": (26.2034, -98.2300), "48215": (31.7619, -106.4850), "48339": (30.0802, -94.1266),
    "48167": (29.3013, -94.7977), "48121": (33.1972, -96.6150), "48453": (30.2672, -97.7431),
    "48245": (32.3513, -95.3010), "48491": (33.9137, -98.5264), "48303": (32.4487, -99.7331),
    "06037": (34.0522, -118.2437), "06073": (32.7157, -117.1611), "06059": (33.7175, -117.8311),
    "06065": (33.9533, -117.3962), "06071": (34.9592, -116.4194), "06085": (37.3382, -121.8863),
    "06013": (37.9161, -122.3108), "06001": (37.6017, -122.0574), "06075": (37.7749, -122.4194),
    "06067": (38.5816, -121.4944), "06081": (37.4323, -122.3232), "06029": (35.3733, -119.0187),
    "12086": (25.7617, -80.1918), "12011": (26.1224, -80.1373), "12099": (26.7153, -80.0534),
    "12057": (28.5383, -81.3792), "12095": (28.5383, -81.3792), "12031": (30.3322, -81.6557),
    "12103": (27.3364, -82.5307), "12071": (26.1420, -81.7948), "12009": (28.0222, -80.6250),
    "12117": (27.4467, -82.3453), "12105": (28.2920, -81.4076), "12115": (27.3364, -82.5307),
}
COUNTY_AREA_SQ_MI = {
    "48201": 1777.0, "48113": 880.0, "48029": 1247.0, "48439": 1023.0, "48141": 863.0,
    "06037": 4751.0, "06073": 4526.0, "06059": 948.0, "06065": 7303.0, "06071": 20105.0,
    "12086": 2431.0, "12011": 1320.0, "12099": 2383.0, "12057": 1266.0, "12095": 1003.0,
}
CENSUS_CENTROID = {
    "48201": (29.76, -95.37), "48113": (32.78, -96.80), "48029": (29.42, -98.49),
    "48439": (30.27, -97.74), "48141": (32.76, -97.33), "06037": (34.05, -118.24),
    "06073": (32.72, -117.16), "06059": (33.72, -117.83), "06065": (33.95, -117.40),
    "06071": (34.96, -116.42), "12086": (25.76, -80.19), "12011": (26.12, -80.14),
    "12099": (26.72, -80.05), "12057": (28.54, -81.38), "12095": (28.54, -81.38),
}
CELL_AREA_KM2 = {
    0: 4357449.416, 1: 609788.441, 2: 86801.780, 3: 12393.434, 4: 1770.347, 5: 252.903,
    6: 36.129, 7: 5.161, 8: 0.737, 9: 0.105, 10: 0.015, 11: 0.002,
}
DEFAULT_CELL_AREA_KM2 = 5.161
KM_PER_MILE = 1.60934
MPH_PER_KNOT = 1.15078

# --- demographic survey codes (fixed values) -------------------------------------------
SURVEY_CODES = {
    "B01003_001E": "total_population", "B19013_001E": "median_household_income",
    "B25035_001E": "median_year_structure_built", "B25001_001E": "total_housing_units",
    "B25002_003E": "vacant_housing_units", "B25064_001E": "median_gross_rent",
    "B01002_001E": "median_age", "B17001_002E": "population_below_poverty",
    "B09021_001E": "population_in_households",
}

# --- scoring defaults (fixed values) ---------------------------------------------------
FEATURE_DEFAULTS = {
    "weather_count_24h": 0.0, "weather_max_mag_24h": 0.0, "weather_mean_mag_24h": 0.0,
    "weather_distinct_types_24h": 0.0, "lag_outage_24h": 0.0, "lag_outage_48h": 0.0,
    "current_load_mw": 0.0, "reserve_margin_pct": 0.15, "load_capacity_ratio": 0.7,
    "neighbor_weather_count": 0.0, "neighbor_outage_mean": 0.0, "transmission_line_km": 0.0,
    "distribution_line_km": 0.0, "substations_count": 0.0, "avg_line_age_years": 20.0,
    "vegetation_density": 0.3, "population_density": 100.0, "median_income_normalized": 0.5,
    "critical_facility_density": 0.0, "housing_age_median": 30.0, "hour_sin": 0.0,
    "hour_cos": 1.0, "dow_sin": 0.0, "dow_cos": 1.0, "month_sin": 0.0, "month_cos": 1.0,
    "is_weekend": 0.0,
}

# --- risk levels: lower bounds per rule set (fixed values) -----------------------------
LEVELS = ["GREEN", "YELLOW", "ORANGE", "RED"]
REGION_THRESHOLDS = {
    "TX": (0.25, 0.55, 0.80), "CA": (0.20, 0.50, 0.75), "FL": (0.20, 0.50, 0.75),
}
DEFAULT_THRESHOLDS = (0.25, 0.55, 0.80)
REGIONS = {
    "TX": {
        "name": "Texas", "states": ["48"],
        "dominant": ["Hurricane", "Thunderstorm Wind", "Ice Storm", "Heat", "Tornado", "High Wind",
                     "Winter Storm", "Hail"],
        "seasons": {"summer": {"heat_weight": 1.5, "wind_weight": 0.8},
                    "winter": {"ice_weight": 2.0, "heat_weight": 0.3}},
    },
    "CA": {
        "name": "California", "states": ["06"],
        "dominant": ["Wildfire", "Heat", "High Wind", "Drought", "Debris Flow", "Excessive Heat",
                     "Flash Flood", "Strong Wind"],
        "seasons": {"summer": {"heat_weight": 1.8, "wildfire_weight": 2.0, "wind_weight": 1.2},
                    "autumn": {"wildfire_weight": 2.5, "wind_weight": 1.5},
                    "winter": {"flood_weight": 1.5, "heat_weight": 0.2}},
    },
    "FL": {
        "name": "Florida", "states": ["12"],
        "dominant": ["Hurricane", "Thunderstorm Wind", "Flood", "Tornado", "Tropical Storm",
                     "Lightning", "Storm Surge", "Heavy Rain"],
        "seasons": {"summer": {"hurricane_weight": 2.0, "thunderstorm_weight": 1.5, "flood_weight": 1.3},
                    "autumn": {"hurricane_weight": 2.5, "flood_weight": 1.5},
                    "winter": {"hurricane_weight": 0.3, "thunderstorm_weight": 0.5}},
    },
}
LEGACY_THRESHOLDS = (0.40, 0.60, 0.85)
DEMO_THRESHOLDS = (0.25, 0.50, 0.75)

# --- alert texts and lifetimes (fixed values) ------------------------------------------
ALERT_TTL_HOURS = {"RED": 12, "ORANGE": 24, "YELLOW": 48}
DEFAULT_ALERT_TTL_HOURS = 24
ALERT_TEXT = {
    "RED": "Critical outage risk detected. Severe weather and grid stress indicate "
           "high probability of widespread power disruption.",
    "ORANGE": "Elevated outage risk. Significant weather activity combined with "
              "infrastructure vulnerability warrants proactive measures.",
    "YELLOW": "Moderate outage risk. Weather conditions may cause localized disruptions. "
              "Monitor situation closely.",
}
DEFAULT_ALERT_TEXT = "Outage risk detected."
ALERT_ACTIONS = {
    "RED": [
        "Activate emergency operations center",
        "Pre-position line crews in affected area",
        "Issue public safety advisory for the region",
        "Coordinate with hospitals and critical facilities for backup power",
        "Stage mobile generators at priority substations",
        "Notify mutual aid partners for potential resource requests",
    ],
    "ORANGE": [
        "Alert field crews and pre-stage repair equipment",
        "Verify backup generator readiness at critical facilities",
        "Increase monitoring frequency for affected substations",
        "Review vegetation management status along at-risk corridors",
        "Prepare customer communication templates",
    ],
    "YELLOW": [
        "Increase monitoring of weather forecast updates",
        "Review crew availability for next 24-48 hours",
        "Confirm outage management system readiness",
        "Verify communication channels with field personnel",
    ],
}

# --- uncertainty (fixed values) --------------------------------------------------------
Z_SCORE = {0.90: 1.645, 0.95: 1.960, 0.99: 2.576}
