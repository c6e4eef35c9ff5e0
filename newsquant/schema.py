"""Fixed layouts and constants of the event and price data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The 58 columns of a raw event line, in file order.
EVENT_COLUMNS = """
GlobalEventID SQLDATE MonthYear Year FractionDate
Actor1Code Actor1Name Actor1CountryCode Actor1KnownGroupCode Actor1EthnicCode
Actor1Religion1Code Actor1Religion2Code Actor1Type1Code Actor1Type2Code Actor1Type3Code
Actor2Code Actor2Name Actor2CountryCode Actor2KnownGroupCode Actor2EthnicCode
Actor2Religion1Code Actor2Religion2Code Actor2Type1Code Actor2Type2Code Actor2Type3Code
IsRootEvent EventCode EventBaseCode EventRootCode QuadClass
GoldsteinScale NumMentions NumSources NumArticles AvgTone
Actor1Geo_Type Actor1Geo_FullName Actor1Geo_CountryCode Actor1Geo_ADM1Code
Actor1Geo_Lat Actor1Geo_Long Actor1Geo_FeatureID
Actor2Geo_Type Actor2Geo_FullName Actor2Geo_CountryCode Actor2Geo_ADM1Code
Actor2Geo_Lat Actor2Geo_Long Actor2Geo_FeatureID
ActionGeo_Type ActionGeo_FullName ActionGeo_CountryCode ActionGeo_ADM1Code
ActionGeo_Lat ActionGeo_Long ActionGeo_FeatureID
DATEADDED URL
""".split()

EVENT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in EVENT_COLUMNS])

# The seven importance measures, in day-vector order.
IMPORTANCE = [
    "days_since_published", "is_verbal", "goldstein", "num_mentions",
    "num_sources", "num_articles", "avg_tone",
]
NUMERIC_TOPICS = ["is_cooperative", "action_lat", "action_long"]
NAMES = ["actor1_name", "actor2_name"]


@dataclass(frozen=True)
class Role:
    """What a cleaned column is used for; `size` is set for categories only."""

    name: str
    kind: str  # importance | categorical | numeric | string
    size: int = 0


# Topic columns in vector order, with one-hot widths (938 slots in all).
EVENT_ROLES = (
    [Role(c, "importance") for c in IMPORTANCE]
    + [
        Role("code1", "categorical", 20),
        Role("code_full", "categorical", 350),
        Role("is_cooperative", "numeric"),
        Role("country1", "categorical", 275),
        Role("country2", "categorical", 275),
        Role("actor1_geo_type", "categorical", 5),
        Role("actor2_geo_type", "categorical", 5),
        Role("action_geo_type", "categorical", 5),
        Role("action_lat", "numeric"),
        Role("action_long", "numeric"),
    ]
    + [Role(c, "string") for c in NAMES]
)

# Cluster counts of the training sweeps.
K_SWEEP = [10, 20, 30, 40, 50, 100, 200, 300, 400, 500, 1000, 2000, 3000, 4000, 5000]

# Top exporters (ISO alpha-3) per traded commodity.
TOP_EXPORTERS = {
    "XAU": ["HKG", "MEX", "GBR", "KOR", "DEU"],
    "XAG": ["CHE", "HKG", "GBR", "USA", "CAN"],
    "CL": ["SAU", "RUS", "ARE", "CAN", "IRQ"],
}

# English stop words (the 127-word list in common use).
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
she her hers herself it its itself they them their theirs themselves what which who whom
this that these those am is are was were be been being have has had having do does did doing
a an the and but if or because as until while of at by for with about against between into
through during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more most other some
such no nor not only own same so than too very s t can will just don should now
""".split()
