"""Parameters and fixed values that define results.

Everything in this module is a fixed value (tables, lists, thresholds, formats):
results only agree with the documented behaviour when these are equal.
"""

# --- ingest and calendar -------------------------------------------------
INGEST_START = "2025-12-01"
INGEST_END = "2026-03-31"
CUTOFF_DATE = "2026-03-26"
SEASON_MONTHS = (12, 1, 2, 3)

# --- countries -----------------------------------------------------------
COUNTRY_NAMES = {"US": "USA", "IN": "India", "IR": "Iran"}

# --- spikes --------------------------------------------------------------
ROLLING_WINDOW = 7
Z_THRESHOLD = 2.0
MIN_EVENTS = 5

# --- chains --------------------------------------------------------------
CHAIN_MAX_SCORE = 18.0
TEMPORAL_TAU = 3.0
FEATURES = (
    "same_country",
    "same_event_root",
    "same_quad_class",
    "same_location",
    "actor_exact_match",
    "actor_country_match",
    "actor_country_interact",
    "tone_distance",
    "goldstein_distance",
    "temporal_decay",
    "is_precursor",
    "is_followup",
    "candidate_strength",
    "anchor_strength",
    "mention_ratio",
    "cross_country",
)
CHAIN_WEIGHTS = dict(zip(FEATURES, (
    2.5, 1.5, 1.5, 1.0, 3.0, 1.5, 2.0, -1.0, -1.0, 3.0, 0.3, 0.3, 1.0, 0.0, 0.5, 1.5,
)))
# Weights used when looking for links into other countries.
CROSS_COUNTRY_WEIGHTS = {
    **CHAIN_WEIGHTS,
    "same_country": 0.0,
    "same_location": 0.0,
    "actor_exact_match": 5.0,
    "actor_country_match": 3.0,
    "same_event_root": 2.5,
    "temporal_decay": 4.0,
    "cross_country": 3.0,
}
# (feature, reason code) in display order; a code is shown when the feature is positive.
REASON_CODES = (
    ("same_country", "country"),
    ("same_event_root", "event_family"),
    ("same_quad_class", "quad_class"),
    ("same_location", "location"),
    ("actor_exact_match", "actor"),
    ("actor_country_match", "actor_fuzzy"),
    ("cross_country", "cross_country"),
)
REASON_LABELS = {
    "country": "Same country",
    "actor": "Shared actor",
    "actor_fuzzy": "Related actor",
    "event_family": "Similar event type",
    "quad_class": "Same conflict/cooperation class",
    "location": "Same location",
    "tone": "Similar tone",
    "goldstein": "Similar intensity",
    "importance": "High-profile event",
    "cross_country": "Cross-country link",
}
# Feature groups switched off one at a time in the ablation study.
ABLATION_GROUPS = {
    "full_model": (),
    "no_actor": ("actor_exact_match", "actor_country_match", "actor_country_interact"),
    "no_temporal": ("temporal_decay", "is_precursor", "is_followup"),
    "no_goldstein": ("goldstein_distance",),
    "no_location": ("same_location",),
    "no_importance": ("candidate_strength", "anchor_strength", "mention_ratio"),
    "no_cross_country": ("cross_country",),
}

# --- silver labels -------------------------------------------------------
ANCHORS_PER_COUNTRY = 8
RELEVANCE_THRESHOLD = 0.55
SILVER_TOP_N = 10
SILVER_MIN_COUNT = 10

# --- normal tail (Abramowitz & Stegun 26.2.17) ---------------------------
NORM_T = 0.2316419
NORM_D = 0.3989422804014327
NORM_COEF = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)

# --- event codes ---------------------------------------------------------
QUAD_LABELS = {
    1: "Verbal Cooperation",
    2: "Material Cooperation",
    3: "Verbal Conflict",
    4: "Material Conflict",
}
ROOT_LABELS = {
    "01": "Make Public Statement",
    "02": "Appeal",
    "03": "Express Intent to Cooperate",
    "04": "Consult",
    "05": "Diplomatic Cooperation",
    "06": "Material Cooperation",
    "07": "Provide Aid",
    "08": "Yield",
    "09": "Investigate",
    "10": "Demand",
    "11": "Disapprove",
    "12": "Reject",
    "13": "Threaten",
    "14": "Protest",
    "15": "Exhibit Force Posture",
    "16": "Reduce Relations",
    "17": "Coerce",
    "18": "Assault",
    "19": "Fight",
    "20": "Use Unconventional Mass Violence",
}

# --- keywords ------------------------------------------------------------
TFIDF_MAX_FEATURES = 800
TFIDF_MIN_DF = 2
STOPWORDS = tuple(sorted(set(
    # English function words
    "a an the is was were be been being have has had do does did will would "
    "shall should may might can could of in to for on with at by from as into "
    "through during before after above below between out off over under and "
    "but or nor not so yet both either neither each every all any few more "
    "most other some such no only own same than too very that this these those "
    "i me my we our you your he him his she her it its they them their what "
    "which who whom how when where why there here are am about also just if "
    "then because while although since until up down said say says make made "
    "known said like would could "
    # geographic and coding filler
    "united states county district city province region state new north south "
    "east west central republic islamic democratic people general national "
    "international country world india iran usa america american indian iranian "
    "columbia washington tehran delhi mumbai verbal material cooperation conflict "
    "unknown make public statement express intent".split()
)))
# Removed only when scoring that country's own documents. Entries of two words
# never equal a single token and are kept for completeness.
COUNTRY_STOPWORDS = {
    "USA": ("usa", "us", "america", "american", "americans", "united states",
            "washington", "new york", "california", "texas", "florida"),
    "India": ("india", "indian", "indians", "delhi", "new delhi", "mumbai",
              "bangalore", "chennai", "kolkata", "hyderabad"),
    "Iran": ("iran", "iranian", "iranians", "tehran", "isfahan", "shiraz",
             "islamic republic"),
}

# --- display -------------------------------------------------------------
MAX_MAP_POINTS = 15_000
DISPLAY_NAMES = {
    "event_date": "Date",
    "country": "Country",
    "actor1": "Actor 1",
    "actor2": "Actor 2",
    "event_type": "Type",
    "quad_label": "Event Class",
    "root_label": "Event Family",
    "avg_tone": "Tone",
    "num_mentions": "Mentions",
    "location": "Location",
    "source_url": "Source",
    "event_count": "Events",
    "rolling_mean": "Typical Level",
    "rolling_std": "Variability",
    "z_score": "Burst Strength",
    "is_burst": "Spike?",
    "burst_days": "Spike Days",
    "avg_z": "Avg Burst Strength",
    "max_events": "Peak Events",
    "chain_score": "Relevance",
    "total_events": "Events",
    "conflict_events": "Conflict",
    "cooperation_events": "Cooperation",
    "avg_goldstein": "Avg Goldstein",
    "conflict_ratio": "Conflict Share",
    "cooperation_ratio": "Cooperation Share",
    "total_mentions": "Total Mentions",
    "source_domain": "Source",
}

# --- text evidence -------------------------------------------------------
BLOCKED_DOMAINS = (
    "twitter.com", "x.com", "facebook.com", "instagram.com",
    "youtube.com", "tiktok.com", "reddit.com",
    "wsj.com", "ft.com", "bloomberg.com",
    "nytimes.com", "washingtonpost.com",
    "t.co", "bit.ly", "tinyurl.com",
)
DROPPED_TAGS = ("script", "style", "nav", "header", "footer", "aside", "form", "button", "noscript")
# Fixed values of HTML: tags that end an open paragraph, and common named character references.
BLOCK_TAGS = (
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html",
    "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "td", "th", "ul")
CHARACTER_REFERENCES = (
    ("apos", "'"), ("copy", "©"), ("euro", "€"), ("gt", ">"), ("hellip", "…"), ("laquo", "«"), ("ldquo", "“"),
    ("lsquo", "‘"), ("lt", "<"), ("mdash", "—"), ("middot", "·"), ("nbsp", " "), ("ndash", "–"),
    ("pound", "£"), ("quot", '"'), ("raquo", "»"), ("rdquo", "”"), ("reg", "®"), ("rsquo", "’"))
MIN_PARAGRAPH_CHARS = 40
MIN_ARTICLE_CHARS = 150
MAX_ARTICLE_CHARS = 8000
MAX_ARTICLES = 10
CHUNK_CHARS = 500
CHUNK_OVERLAP = 80
CHUNK_LOOKBACK = 120
MIN_CHUNK_CHARS = 80
CONTEXT_CHARS = 1200
EVIDENCE_TOP_K = 4
LINK_TOP_K = 6

# --- question intents, first match wins ----------------------------------
INTENT_WORDS = (
    ("spike_cause", "why|cause|reason|trigger|drove|driving|what happened|explain"),
    ("evidence", "evidence|source|article|news|report|support|proof|link|url"),
    ("comparison", "compar|previous|past|before|last time|worse|stronger|bigger|differ"),
    ("keywords", "keyword|topic|theme|term|tfidf|subject|about|discuss"),
    ("event_types", "event type|type of event|quad|cameo|conflict|cooperation|what kind"),
    ("tone", "tone|sentiment|positive|negative|mood|attitude|hostile"),
    ("actors", "actor|who|entity|government|person|player|involved|participant"),
    ("prediction", "predict|forecast|next|future|will|expect|upcoming|continue"),
)
