"""Table schemas: the raw export and the tables derived from it."""

# Column order of the headerless daily export.
RAW_COLUMNS = (
    "GLOBALEVENTID SQLDATE MonthYear Year FractionDate "
    "Actor1Code Actor1Name Actor1CountryCode Actor1KnownGroupCode Actor1EthnicCode "
    "Actor1Religion1Code Actor1Religion2Code Actor1Type1Code Actor1Type2Code Actor1Type3Code "
    "Actor2Code Actor2Name Actor2CountryCode Actor2KnownGroupCode Actor2EthnicCode "
    "Actor2Religion1Code Actor2Religion2Code Actor2Type1Code Actor2Type2Code Actor2Type3Code "
    "IsRootEvent EventCode EventBaseCode EventRootCode QuadClass GoldsteinScale "
    "NumMentions NumSources NumArticles AvgTone "
    "Actor1Geo_Type Actor1Geo_FullName Actor1Geo_CountryCode Actor1Geo_ADM1Code "
    "Actor1Geo_Lat Actor1Geo_Long Actor1Geo_FeatureID "
    "Actor2Geo_Type Actor2Geo_FullName Actor2Geo_CountryCode Actor2Geo_ADM1Code "
    "Actor2Geo_Lat Actor2Geo_Long Actor2Geo_FeatureID "
    "ActionGeo_Type ActionGeo_FullName ActionGeo_CountryCode ActionGeo_ADM1Code "
    "ActionGeo_Lat ActionGeo_Long ActionGeo_FeatureID DATEADDED SOURCEURL"
).split()

KEPT_COLUMNS = (
    "GLOBALEVENTID SQLDATE Actor1Code Actor1Name Actor1CountryCode "
    "Actor2Code Actor2Name Actor2CountryCode Actor1Type1Code EventCode EventBaseCode "
    "EventRootCode QuadClass GoldsteinScale NumMentions NumSources NumArticles AvgTone "
    "ActionGeo_Type ActionGeo_FullName ActionGeo_CountryCode ActionGeo_Lat "
    "ActionGeo_Long SOURCEURL"
).split()

NUMERIC_COLUMNS = (
    "GLOBALEVENTID QuadClass GoldsteinScale NumMentions NumSources NumArticles AvgTone "
    "ActionGeo_Lat ActionGeo_Long"
).split()

# Texts read as missing in an all-string export.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Raw name -> name in the cleaned table, for the kept columns that are carried over.
CLEAN_NAMES = {
    "GLOBALEVENTID": "event_id",
    "Actor1CountryCode": "actor1_cc",
    "Actor2CountryCode": "actor2_cc",
    "EventRootCode": "root_code",
    "QuadClass": "quad_class",
    "GoldsteinScale": "goldstein",
    "NumMentions": "num_mentions",
    "NumSources": "num_sources",
    "NumArticles": "num_articles",
    "AvgTone": "avg_tone",
    "ActionGeo_FullName": "location",
    "ActionGeo_Lat": "lat",
    "ActionGeo_Long": "long",
    "SOURCEURL": "source_url",
}

LABELS = (
    "burst_ground_truth array<struct<day string, country string, event_count bigint, "
    "z_score double, is_real_burst boolean, description string>>, "
    "chain_ground_truth array<struct<anchor_event_id bigint, date string, country string, "
    "actors string, event_type string, relevant_event_ids array<bigint>, "
    "expected_pattern string, description string>>"
)
