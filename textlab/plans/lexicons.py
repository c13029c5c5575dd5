"""Lexicons that drive the registered queries on the driver's synthetic tables.

The library defaults (``functions.patterns``) are the support-desk lexicons;
the driver's text is invented prose in which support words never occur, so the
registered queries pass these lexicons instead.  They are query parameters,
used identically by the Spark query and by its DuckDB oracle.
"""

# intent by first matching word (dictionary order), default 'other'
INTENT_LEXICON = [
    ("order_status", "was|were"),
    ("refund_return", "that"),
    ("product_issue", "for|with"),
    ("account_access", "der|die"),
    ("billing_payment", "und|von"),
    ("cancellation", "que"),
    ("complaint", "la|le"),
    ("info_request", "this|from"),
]
INTENT_DEFAULT = "other"

# escalation policy words
CRITICAL_WORDS = "des|ein|by"
REPEAT_WORDS = "as|at|an"

# reason rules in code order
REASON_RULES = [
    ("security_sensitive", "der"),
    ("legal_threat", "by"),
    ("safety_issue", "des"),
    ("repeat_failure", "at|an"),
    ("financial_risk", "es|en"),
]

# junk lexicon (hits a few percent of documents)
JUNK_LEXICON = [
    ("worthless", "worthless"),
    ("stupid", "stupid"),
    ("idiot", "idiot"),
]

# weak-label dictionary: several labels per document are possible
WEAK_LABELS = [
    ("junk", "worthless|stupid|idiot"),
    ("english_function", "which|would|there"),
    ("german_function", "nicht|auch|sich"),
    ("french_function", "avec|pour|dans"),
    ("spanish_function", "para|como|pero"),
]

# top-up mining: words of the fixed target intents
TOPUP_LABELS = [
    ("order_status", "which|would|there"),
    ("billing_payment", "nicht|auch|sich"),
    ("cancellation", "avec|pour|dans"),
    ("account_access", "para|como|pero"),
]

# per-language quota table for the quota sample
LANG_QUOTAS = {"en": 30, "fr": 22, "de": 22, "es": 25}

# targets that exceed availability for some languages (quota gap report)
LANG_TARGETS = {"en": 700, "fr": 150, "de": 100, "es": 120, "it": 5}

# hint column for the audit: the "model guess" per language
LANG_HINTS = {"en": "info_request", "fr": "complaint", "de": "account_access", "es": "other"}

# event type -> intent field of the synthetic model responses ('clickthrough'
# is not an intent and must be coerced to the default)
EVENT_INTENTS = {"error": "product_issue", "purchase": "billing_payment",
                 "signup": "account_access", "view": "info_request", "click": "clickthrough"}
