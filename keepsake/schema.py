"""Table shapes and fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

ENTRY = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("data", T.MapType(T.StringType(), T.StringType())),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("status", T.StringType()),
        T.StructField("rating", T.IntegerType()),
        T.StructField("occurred_at", T.TimestampType()),
        T.StructField("remind_at", T.TimestampType()),
        T.StructField("source", T.StringType(), False),
        T.StructField("archived_at", T.TimestampType()),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("updated_at", T.TimestampType(), False),
        T.StructField("last_checked_at", T.TimestampType()),
        T.StructField("capture_id", T.StringType()),
    ]
)
ENTRY_COLUMNS = ENTRY.fieldNames()

NOTE = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("entry_id", T.StringType(), False),
        T.StructField("body", T.StringType(), False),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("source", T.StringType(), False),
    ]
)

LINK = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("from_id", T.StringType(), False),
        T.StructField("to_id", T.StringType(), False),
        T.StructField("rel", T.StringType(), False),
        T.StructField("created_at", T.TimestampType(), False),
    ]
)

PROMPT = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("at", T.TimestampType(), False),
        T.StructField("surface", T.StringType(), False),
        T.StructField("action", T.StringType(), False),
        T.StructField("input", T.StringType()),
        T.StructField("entry_ids", T.ArrayType(T.StringType())),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("kinds", T.ArrayType(T.StringType())),
        T.StructField("ms", T.IntegerType()),
        T.StructField("ok", T.BooleanType(), False),
        T.StructField("error", T.StringType()),
    ]
)

VECTOR = T.StructType(
    [
        T.StructField("entry_id", T.StringType(), False),
        T.StructField("provider", T.StringType(), False),
        T.StructField("vec", T.ArrayType(T.FloatType()), False),
        T.StructField("source_updated_at", T.TimestampType(), False),
    ]
)

STARRED = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("full_name", T.StringType()),
        T.StructField("html_url", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("stargazers_count", T.IntegerType()),
        T.StructField("topics", T.ArrayType(T.StringType())),
        T.StructField("homepage", T.StringType()),
        T.StructField("pushed_at", T.StringType()),
        T.StructField("archived", T.BooleanType()),
        T.StructField("owner", T.StructType([T.StructField("login", T.StringType())])),
    ]
)
# A listing row is either {starred_at, repo:{…}} or the bare repo object.
STARRED_ITEM = T.StructType(
    [T.StructField("starred_at", T.StringType()), T.StructField("repo", STARRED)] + STARRED.fields
)

EXTRACTION = T.StructType(
    [
        T.StructField(
            "entries",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("kind", T.StringType()),
                        T.StructField("title", T.StringType()),
                        T.StructField("body", T.StringType()),
                        T.StructField("tags", T.ArrayType(T.StringType())),
                        T.StructField(
                            "data",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("key", T.StringType()),
                                        T.StructField("value", T.StringType()),
                                    ]
                                )
                            ),
                        ),
                        T.StructField("status", T.StringType()),
                        T.StructField("rating", T.IntegerType()),
                        T.StructField("occurred_at", T.StringType()),
                        T.StructField("remind_at", T.StringType()),
                    ]
                )
            ),
        )
    ]
)

# ---------------------------------------------------------------------------
# Results depend on these exact words and numbers.
# ---------------------------------------------------------------------------
KINDS = ["thought", "movie", "person", "reading", "task", "fact", "place", "idea", "repo"]

# Other words for a kind, and the kind.
KIND_ALIASES = {
    "note": "thought", "thoughts": "thought", "memo": "thought",
    "film": "movie", "show": "movie", "tv": "movie", "series": "movie", "watchlist": "movie",
    "contact": "person", "connection": "person", "linkedin": "person", "people": "person",
    "repository": "repo", "github": "repo", "project_repo": "repo",
    "article": "reading", "essay": "reading", "book": "reading", "writing": "reading", "post": "reading", "paper": "reading",
    "todo": "task", "reminder": "task",
    "project": "idea",
    "restaurant": "place",
}

DEFAULT_STATUS = {"movie": "want", "task": "open", "reading": "queued"}
DONE_STATUSES = ["watched", "done", "read", "dropped", "abandoned", "cancelled"]
UNTOUCHED_STATUSES = ["starred", "imported", "saved"]
DEDUPE_KINDS = ["movie", "person", "place", "reading"]
CAPTURE_ACTIONS = ["jot", "capture", "flow_capture", "flow_capture_many", "telegram_capture"]

GENERIC_TITLES = [
    "overview", "home", "homepage", "docs", "documentation", "introduction", "intro",
    "getting started", "welcome", "index", "readme", "about", "blog", "api", "guide",
    "reference", "dashboard", "login", "sign in", "untitled", "faq", "pricing",
]
SECTION_SUBDOMAINS = ["docs", "blog", "app", "www", "developer", "developers", "help", "support", "en"]

NAMED_ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "mdash": "—", "ndash": "–",
}

QUESTION_STOPWORDS = [
    "what", "when", "where", "which", "that", "this", "those", "these", "about", "with", "from",
    "have", "been", "were", "they", "them", "their", "there", "then", "than", "some", "said",
    "tell", "know", "think", "thought", "remember", "again", "into", "over", "much", "like",
    "would", "could", "should", "does", "did", "was", "the", "and", "for", "you", "your",
]

# which data keys are worth filling in for a kind
KIND_FIELDS = {
    "movie": ["year", "director", "service", "recommended_by", "runtime"],
    "person": ["company", "role", "linkedin", "met_at", "met_on", "location", "mutual", "follow_up"],
    "reading": ["url", "author", "source", "published"],
    "place": ["city", "address", "cuisine", "recommended_by"],
    "task": ["context", "blocked_by"],
    "repo": ["owner", "language", "stars", "topics", "url", "homepage"],
}

LIST_DEFAULT, LIST_MAX = 25, 200
PROMPTS_MAX, QUEUE_MAX = 500, 50
RRF_K = 60
VECTOR_FETCH = 30
CEILING, CEILING_BY_PREFIX = 0.6, {"gemini:": 0.42}
MARGIN, SEPARATION = 0.08, 0.012
FUZZY_MATCH, FUZZY_DUPLICATE = 0.3, 0.55
TITLE_BONUS, RANK_SCALE = 0.5, 4
FIELD_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}

# -- fixed values of English search -------------------------------------------------------------

STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

# words whose first region starts after a fixed beginning; words with stems of their own; words left alone after the plural
STEM_ALONE = ["gener", "commun", "arsen"]
STEM_AS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STEM_KEPT = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
STEM_STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEM_STEP_3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": "",
}
STEM_STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
