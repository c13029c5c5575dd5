"""Fixed values and the portable regex building blocks.

Every pattern in this package must give the same answer in Spark (Java
regex) and DuckDB (RE2), and the same answer as Python's Unicode ``re``.
Therefore no bare ``\\w``, ``\\s``, ``\\d`` or ``\\b`` is used: those classes
differ between the three dialects.  Word characters are ``[\\p{L}\\p{N}_]``,
whitespace is the explicit class below, and a word boundary is written as
"start of text or a non-word character" on either side.
"""

from __future__ import annotations

# --- portable character classes -------------------------------------------

WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
# Characters Python's str.isspace() accepts (== Unicode ``\s`` in ``re``).
WS_CHARS = (r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}"
            r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WS = "[" + WS_CHARS + "]"
NOT_WS = "[^" + WS_CHARS + "]"
NON_ASCII = r"[^\x{00}-\x{7F}]"
LATIN_OR_CJK_LETTER = r"[A-Za-z\x{C0}-\x{24F}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]"


def words(alternation: str) -> str:
    """``\\b(alternation)\\b`` written portably (used with ``rlike``)."""
    return rf"(?:^|{NOT_WORD})(?:{alternation})(?:$|{NOT_WORD})"


def any_words(*alternations: str) -> str:
    """``\\ba\\b|\\bb\\b|...``: each alternative wrapped separately."""
    return "|".join(words(a) for a in alternations)


# --- fixed values: label vocabularies (must equal the reference's) -------

INTENTS = ["order_status", "refund_return", "product_issue", "account_access",
           "billing_payment", "cancellation", "complaint", "info_request", "other"]
ESCALATIONS = ["auto_handle", "escalate"]
REASONS = ["low_risk", "deterministic_action", "security_sensitive", "financial_risk",
           "high_emotion", "high_value", "repeat_failure", "legal_threat",
           "safety_issue", "kb_unavailable"]
AUTO_REASONS = ["low_risk", "deterministic_action"]
ESC_REASONS = ["security_sensitive", "financial_risk", "high_emotion", "high_value",
               "repeat_failure", "legal_threat", "safety_issue", "kb_unavailable"]

# --- fixed values: escalation policy as coded -----------------------------

ALWAYS_ESCALATE = ["account_access", "billing_payment", "complaint"]
CRITICAL_WORDS = "delivered but|not received|hacked|fraud|unauthori|legal|lawsuit|safety|burn|fire"
REPEAT_WORDS = "again|still|third time|repeat"
REPEAT_INTENTS = ["order_status", "refund_return"]
# reason rules in code order: (tag, words)
REASON_RULES = [
    ("security_sensitive", "hacked|unauthori|locked|password|security"),
    ("legal_threat", "legal|lawsuit|court|chargeback"),
    ("safety_issue", "safety|burn|fire|injur"),
    ("repeat_failure", "again|still|third time|repeat"),
    ("financial_risk", "charged|charge|billing|payment|refund|money"),
]
# reason by intent after the keyword rules
REASON_BY_INTENT = [
    ("complaint", "high_emotion"),
    ("account_access", "security_sensitive"),
    ("billing_payment", "financial_risk"),
]
HYBRID_LOW_RISK_INTENTS = ["info_request", "other", "cancellation"]

# documented decision priority (policy v1.1), first matching tag wins
POLICY_PRIORITY = ["legal_threat", "safety_issue", "security_sensitive", "financial_risk",
                   "high_value", "repeat_failure", "high_emotion", "kb_unavailable",
                   "deterministic_action", "low_risk"]

# documented amount thresholds (policy text; not applied by the coded rules):
# intent -> amount above which the case escalates as high_value
AMOUNT_THRESHOLDS = {"refund_return": 1000, "order_status": 5000, "product_issue": 5000}
# a currency sign or a currency word of its own, then digits with any grouping
AMOUNT_RE = r"(?:₹ ?|\$ ?|(?<![\p{L}\p{N}_])(?:rs\.? ?|inr ?))([0-9]+(?:,[0-9]+)*)"

# post-processor fallbacks
AUTO_FALLBACK = {
    "order_status": "deterministic_action",
    "refund_return": "deterministic_action",
    "product_issue": "deterministic_action",
    "cancellation": "deterministic_action",
    "info_request": "low_risk",
    "other": "low_risk",
}
ESC_FALLBACK = {
    "account_access": "security_sensitive",
    "billing_payment": "financial_risk",
    "complaint": "high_emotion",
    "order_status": "kb_unavailable",
    "refund_return": "financial_risk",
    "product_issue": "repeat_failure",
    "cancellation": "high_emotion",
}
AUTO_FALLBACK_DEFAULT = "low_risk"
ESC_FALLBACK_DEFAULT = "high_emotion"

# trivial baseline constants
TRIVIAL_ESCALATION = "escalate"
TRIVIAL_REASON = "high_emotion"
TRIVIAL_REPLY = ("We're sorry to hear about your issue. "
                 "Please DM us your order number and we'll look into it.")

# --- fixed values: keyword mining dictionaries ----------------------------

# rare-intent mining, applied case-insensitively inside \b...\b
RARE_INTENT_PATTERNS = [
    ("refund_return", r"refund|return|reimburse|money back|exchange|replacement"),
    ("account_access", r"login|log in|locked|password|sign in|unauthori[sz]ed|hack|access my account"),
    ("cancellation", r"cancel|close.{0,10}account|unsubscribe|terminate|stop.{0,10}subscription|delete.{0,10}account"),
    ("billing_payment", r"charge[d]?|billing|payment|invoice|deduct|overcharg|double.{0,5}charg"),
]
RARE_INTENT_CAP = 50
TOPUP_PATTERNS = [
    ("order_status", r"where is my|tracking|when will|delivery date|hasn'?t arrived|not delivered|still waiting for (?:my )?package|expected delivery"),
    ("billing_payment", r"charge[ds]?|billing|overcharg|double.{0,5}charg|unauthori[sz]ed|deduct|payment.{0,10}(?:fail|declin)|extra.{0,10}(?:amount|charg)|wrong.{0,10}charg"),
    ("cancellation", r"cancel|close.{0,10}account|unsubscribe|stop.{0,10}subscription|delete.{0,10}account"),
    ("account_access", r"locked out|cannot (?:log|sign) ?in|password reset|hacked|forgot password"),
]
TOPUP_TARGETS = {"order_status": 25, "billing_payment": 10, "cancellation": 8, "account_access": 5}
MIN_MINED_LENGTH = 15

# length-stratified candidate sample: shares of n and band edges
LENGTH_SHARES = (0.60, 0.25)
LENGTH_EDGES = (80, 160)

# edge-case miner: tag, per-tag count, seed (tag order is the priority)
EDGE_MULTI_JOINERS = "and|but"
EDGE_MULTI_TOPICS = "refund|return|cancel|deliver|order|account|charge|help"
EDGE_ANGER_WORDS = "unacceptable|disgusting|furious|ridiculous|never again|worst|terrible|appalling"
EDGE_ANGER_PUNCT = "!!+"
EDGE_IMAGE_WORDS = "screenshot|attached|photo|picture|see below|dm me"
EDGE_TAGS = [("multi_intent", 12, 1), ("anger_sarcasm", 10, 2), ("short_fragment", 8, 3),
             ("very_long", 6, 4), ("image_reference", 6, 5), ("non_english", 12, 6)]

# --- fixed values: label audit --------------------------------------------

AUDIT_TOPIC_WORDS = ("refund|return|cancel|charged?|billing|payment|order|tracking|deliver|"
                     "delivery|shipment|package|password|login|sign in|account")
AUDIT_PROBLEM_WORDS = "not working|broken|locked|hacked|charged|late|missing|stuck|failed|error"
AUDIT_MONEY_WORDS = "refund|money back|charge|billing|credit card"
AUDIT_DISPUTE_WORDS = "said delivered|claimed|but i didn.?t|isn.?t right|lying|false"
AUDIT_KB_WORDS = "unusual|strange|weird|specific|particular|complex|how does|why does"
# rule names and messages, in rule order; {placeholders} are filled per row
AUDIT_MESSAGES = [
    ("R1-escalation-mismatch", 'auto_handle with escalate reason "{reason}"'),
    ("R1-escalation-mismatch", 'escalate with auto reason "{reason}"'),
    ("R2-complaint-topic", "complaint but message mentions a topic word — could be a different intent"),
    ("R3-info-but-problem", "info_request but message describes an active problem"),
    ("R4-product-but-money", "product_issue but message mentions money — could be refund/billing"),
    ("R5-order-status-dispute", "order_status but seems to dispute tracking — check complaint"),
    ("R6-short-fragment", "{intent} but message is only {length} chars — fragment risk"),
    ("R7-account-access-auto", "account_access should always be escalate"),
    ("R8-complaint-auto", "complaint should always be escalate"),
    ("R9-billing-auto", "billing_payment should always be escalate"),
    ("R10-easy-but-override", 'marked easy but overrode LLM hint ("{hint}" -> "{intent}")'),
    ("R11-non-english-complaint", "non-English labelled complaint — verify not other/info_request"),
    ("R12-suspicious-kb", "kb_unavailable on a short/simple message — verify"),
]
AUDIT_SHORT_LEN = 20
AUDIT_KB_SHORT_LEN = 60
AUDIT_MESSAGE_CHARS = 150

# --- fixed values: reply rubric -------------------------------------------

RUBRIC_TOPICS = {
    "order_status": ["order", "deliver", "track", "ship", "package", "arriv"],
    "refund_return": ["refund", "return", "money", "reimburse"],
    "product_issue": ["issue", "problem", "device", "item", "broken", "work"],
    "account_access": ["account", "access", "log", "password", "unlock"],
    "billing_payment": ["charge", "billing", "payment", "amount"],
    "cancellation": ["cancel", "subscription"],
    "complaint": ["sorry", "apolog", "understand", "frustrat"],
    "info_request": ["help", "information", "question", "detail"],
    "other": ["thank", "appreciate", "glad"],
}
RUBRIC_GENERIC = ["order", "account", "deliver", "refund", "charge"]
RUBRIC_MIN_LEN = 15
TONE_EMPATHY = ["sorry", "apolog", "understand", "appreciate"]
TONE_POLITE = ["please", "thank", "help", "assist"]
TONE_ABUSE = ["stupid", "idiot", "fuck", "shut up"]
TONE_SHOUT_LEN = 30
ACT_ESC_CONTACT = ["dm", "direct message", "phone", "chat", "contact", "reach"]
ACT_ESC_FOLLOW = ["look into", "investigate", "follow up", "get back"]
ACT_AUTO_STEPS = ["here", "link", "click", "follow", "step", "visit"]
ACT_AUTO_HELP = ["will", "help", "assist", "check"]
SAFETY_CODE = r"[A-Z]{2,}\p{Nd}{5,}"
SAFETY_MONEY = r"\$\p{Nd}+|₹\p{Nd}+|£\p{Nd}+"
SAFETY_PROMISE_WORDS = "guarantee|will definitely"
SAFETY_PROMISE_PERCENT = "100% "
GROUNDED_MIN_WORD = 4
GROUNDED_STEPS = [(0.3, 5), (0.15, 4), (0.05, 3)]

# --- fixed values: retrieval prompt ---------------------------------------

PROMPT_LINE = "- Customer: {customer}\n  Brand reply: {reply}"
PROMPT_CUSTOMER_CHARS = 120
PROMPT_REPLY_CHARS = 180
PROMPT_EMPTY = "(no close examples found)"

# --- fixed values: model-response parsing defaults -------------------------

RESPONSE_DEFAULTS = {"intent": "other", "escalation": "auto_handle",
                     "reason": "low_risk", "confidence": 0.0}
LOW_CONFIDENCE = 0.6

# --- fixed values: agreement interpretation --------------------------------

RHO_BANDS = [(0.8, "almost perfect"), (0.6, "substantial"), (0.4, "moderate"), (0.2, "weak")]
RHO_BAND_ELSE = "negligible"
BIAS_MARGIN = 0.3


def template_parts(template: str) -> list[tuple[str, str]]:
    """Split a message template into ('text', literal) / ('field', name) parts."""
    import re as _re
    parts = []
    for i, piece in enumerate(_re.split(r"\{(\w+)\}", template)):
        if piece:
            parts.append(("field" if i % 2 else "text", piece))
    return parts
