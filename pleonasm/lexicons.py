"""Word lists, phrase tables, patterns, prices and thresholds.

Everything in this module is data that has to equal the behaviour being matched. Patterns are
written once in the dialect shared by Java regular expressions and RE2 wherever that is possible;
the few that need look-around are marked.
"""

from __future__ import annotations

# --- numbers ---------------------------------------------------------------------------------

NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7,
    "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14,
    "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20,
    "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80,
    "ninety": 90, "hundred": 100, "thousand": 1000, "million": 1000000,
}
_NUMBER_WORD = "|".join(NUMBER_WORDS)
NUMBER_PHRASE = rf"(?:{_NUMBER_WORD})(?:[-\s]+(?:{_NUMBER_WORD}))*"

MONTH_NAMES = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september",
    "october", "november", "december",
)

# --- placeholders and tokens -------------------------------------------------------------------

PLACEHOLDER = r"__PROTECTED_\d+__"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
WORD_TOKEN = r"__PROTECTED_\d+__|[A-Za-z0-9][A-Za-z0-9'-]*"
TOKEN_FACTOR = 1.15
MESSAGE_OVERHEAD = 4

# --- typed facts, applied in this order; an earlier kind hides its text from the later ones ------
# equation needs look-ahead; json_block uses possessive runs so that it cannot backtrack.

FACT_PATTERNS = (
    ("fenced_code", r"```[\s\S]*?```"),
    ("inline_code", r"`[^`\n]+`"),
    ("latex", r"\$(?:[^$\n0-9]|[^$\n0-9][^$\n]*[^$\n0-9])\$"),
    ("json_block", r"\{(?:[^{}]++|\{[^{}]*\})*+\}|\[(?:[^\[\]]++|\[[^\[\]]*\])*+\]"),
    ("xml_html", r"<[A-Za-z][^>]*>[\s\S]*?</[A-Za-z][^>]*>"),
    ("url", r"https?://[^\s)>\"]+"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("api_key_like", r"\b(?:sk-|AIza|AQ\.)[A-Za-z0-9_\-.]{16,}\b"),
    ("date", r"\b\d{4}-\d{2}-\d{2}\b|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]* \d{1,2}, \d{4}\b"),
    ("time", r"\b\d{1,2}:\d{2}\s*(?:AM|PM)\b"),
    ("time", rf"\b(?:{NUMBER_PHRASE})\s+(?:oh\s+)?(?:{NUMBER_PHRASE})\s*(?:AM|PM)\b"),
    ("money", r"\$\d[\d,]*(?:\.\d+)?\b"),
    ("money", rf"\b{NUMBER_PHRASE}\s+dollars\b"),
    ("percentage", r"\b\d+(?:\.\d+)?%"),
    ("percentage", rf"\b(?:\d+(?:\.\d+)?|{NUMBER_PHRASE})\s+percent\b"),
    ("legal_clause", r"\bClause \d+(?:\.\d+)*\b"),
    ("id", r"(?-i:\b[A-Z]{2,}(?:-[A-Z0-9]+)+\b)"),
    ("quoted_text", r"\"[^\"\n]{2,}\"|'[^'\n]{2,}'"),
    ("equation", r"\b[a-zA-Z]\s*(?:\([a-zA-Z]\))?\s*=\s*[-+*/^(). 0-9a-zA-Z]*?(?=\s+(?:appears|must)\b|[.,;:]|$)"),
)
# What is in every match of a pattern, for each of them: one of some strings, or an ending.
FACT_NEEDS = (
    ("```",), ("`",), ("$",), ("{", "["), ("<",), ("://",), ("@",), ("sk-", "aiza", "aq."), r"\d{4}", (":",), r"(?i)[ap]m\b", ("$",),
    ("dollars",), ("%",), ("percent",), ("clause",), ("-",), ('"', "'"), ("=",),
)
OPAQUE_KINDS = ("fenced_code", "inline_code", "json_block", "xml_html", "quoted_text")
NUMERIC_KINDS = ("percentage", "measurement", "number", "date", "time", "money")
CACHE_FACT_KINDS = ("id", "date", "money", "percentage", "url", "email", "number")
FREE_NUMBER = r"\b\d+(?:\.\d+)?\b"
NUMBERED_HEADER_LINE = r"(?im)^(?:Retrieved (?:context|contract) chunk|Source|Chunk|Document section)\s+[A-Z0-9]+(?:\s*[-–—?]\s*[^:]+)?:.*$"
NAMED_HEADER_LINE = r"(?im)^(?:User Question|Question|Task|System Prompt|Instructions|Metadata|Customer Ticket):.*$"

# --- light facts: every pattern is tried on the whole text -----------------------------------------

LIGHT_FACT_PATTERNS = (
    r"\bhttps?://[^\s\])}>]+",
    r"\b[\w.-]+@[\w.-]+\.\w+\b",
    r"\b[A-Z]{2,}-[A-Z0-9-]+\b",
    r"\b[A-Z]+-[0-9A-Z-]+\b",
    r"\b[a-z]{2}(?:-[a-z]+)+-\d+\b",
    r"\b[a-z][a-z0-9]+(?:_[a-z0-9]+)+\b",
    r"\$\d+(?:,\d{3})*(?:\.\d+)?",
    r"\b\d+(?:\.\d+)?%",
    r"\b\d+(?:\.\d+)?\s*percent\b",
    rf"\b{NUMBER_PHRASE}\s*percent\b",
    r"\b\d+(?:\.\d+)?\s*(?:ms|milliseconds|seconds|minutes|hours|days)\b",
    rf"\b{NUMBER_PHRASE}\s*(?:ms|milliseconds|seconds|minutes|hours|days)\b",
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"\b\d{1,2}/\d{1,2}/\d{2,4}\b",
    r"\b\d{1,2}:\d{2}\s*(?:AM|PM)\b",
    r"\b(?:CUSIP|ISIN)\s+[A-Z0-9]+\b",
    r"\b(?:10-K|10-Q|T\+2|BB\+|Baa2|A/R|A/P|P&L|X-chromosome|X-inactivation|T-cell|B-cell|p53|IL-6|TNF-alpha)\b",
    PLACEHOLDER,
)
_UNITS = r"(?i)(?:ms|seconds|minutes|hours|days)\b"
# What is in every match of a pattern, for each of them: one of some strings, or an ending.
LIGHT_FACT_NEEDS = (
    ("://",), ("@",), ("-",), ("-",), ("-",), ("_",), ("$",), ("%",), ("percent",), ("percent",), _UNITS, _UNITS, ("-",),
    ("/",), (":",), ("cusip", "isin"),
    ("10-", "t+2", "bb+", "baa2", "a/r", "a/p", "p&l", "x-", "-cell", "p53", "il-6", "tnf-"), ("__protected_",),
)

# --- states, events, risk markers --------------------------------------------------------------------

STATE_WORDS = (
    "degraded", "offline", "inactive", "read-only", "unavailable", "pending", "approved", "denied",
    "retained", "deleted", "disabled", "enabled", "paused", "quarantined", "watchlist", "flagged",
    "blocked", "locked",
)
NEGATABLE_WORDS = (
    "exposed", "modified", "approved", "migrated", "rotated", "patched", "disabled", "included",
    "ready", "mapped",
)
EVENT_PHRASES = {
    "is inactive": "inactive", "is active": "active", "is degraded": "degraded",
    "is read-only": "read_only", "status is unavailable": "unavailable",
    "is unavailable": "unavailable", "is not offline": "not_offline",
    "is not disabled": "not_disabled", "is not deleted": "not_deleted", "still exists": "exists",
    "is pending": "pending", "is not approved": "not_approved", "is stale": "stale",
    "is locked": "locked", "is not ready": "not_ready", "is blocked": "blocked",
    "was retained": "retained", "were retained": "retained", "was not deleted": "not_deleted",
    "were not deleted": "not_deleted", "was not migrated": "not_migrated",
    "were not migrated": "not_migrated", "was migrated": "migrated", "were migrated": "migrated",
    "was quarantined": "quarantined", "were quarantined": "quarantined",
    "was also quarantined": "quarantined", "were also quarantined": "quarantined",
    "was later paused": "paused", "were later paused": "paused",
    "was also placed on watchlist": "watchlist", "were also placed on watchlist": "watchlist",
    "was placed on watchlist": "watchlist", "were placed on watchlist": "watchlist",
    "was also flagged for legal review": "flagged_for_legal_review",
    "were also flagged for legal review": "flagged_for_legal_review",
    "was flagged for legal review": "flagged_for_legal_review",
    "were flagged for legal review": "flagged_for_legal_review",
}
EVENT_CONFLICTS = (
    ("active", "inactive"), ("approved", "denied"), ("migrated", "not_migrated"),
    ("deleted", "not_deleted"), ("offline", "not_offline"), ("disabled", "not_disabled"),
    ("ready", "not_ready"), ("patched", "not_patched"),
)
SUBJECT_KINDS = (
    "compliance control", "routing worker", "control", "policy", "region", "service", "scanner",
    "deployment", "node",
)
EVENT_VALUE = (
    rf"{PLACEHOLDER}|\b\d{{4}}-\d{{2}}-\d{{2}}\b"
    rf"|\b(?:\d+(?:\.\d+)?|{NUMBER_PHRASE})\s*%|\b(?:\d+(?:\.\d+)?|{NUMBER_PHRASE})\s*percent\b"
    rf"|\b(?:\d+(?:\.\d+)?|{NUMBER_PHRASE})\s*(?:ms|milliseconds|seconds|minutes|hours|days)\b"
)
LIST_EVENT_PREFIXES = {
    "Affected cohorts": ("affected", "cohort"), "Affected cells": ("affected", "cell"),
    "Affected airports": ("affected", "airport"), "Affected gates": ("affected", "gate"),
    "Operational flights": ("operational", "flight"),
    "Recovered passenger baggage": ("recovered", "passenger_baggage"),
    "Recovered baggage IDs": ("recovered", "baggage"),
    "Healthy biomarkers": ("healthy", "biomarker"), "Online services": ("online", "service"),
    "Active drugs": ("active", "drug"), "Approved findings": ("approved", "finding"),
    "Excluded note pools": ("excluded", "note_pool"),
}
ENTITY_EVENT_FORMS = (
    (r"^Cohort\s+(.+?)\s+was affected", "cohort", "affected"),
    (r"^Cell\s+(.+?)\s+was affected", "cell", "affected"),
    (r"^Airport\s+(.+?)\s+was affected", "airport", "affected"),
    (r"^Gate\s+(.+?)\s+was affected", "gate", "affected"),
    (r"^Flight\s+(.+?)\s+is operational", "flight", "operational"),
    (r"^Passenger\s+(.+?)\s+baggage was recovered", "passenger_baggage", "recovered"),
    (r"^Baggage\s+(.+?)\s+was recovered", "baggage", "recovered"),
    (r"^Biomarker\s+(.+?)\s+(?:status is healthy|is healthy)", "biomarker", "healthy"),
    (r"^Service\s+(.+?)\s+is online", "service", "online"),
    (r"^Drug\s+(.+?)\s+is active", "drug", "active"),
    (r"^Approved\s+(.+?)$", "finding", "approved"),
    (r"^(Zone-[A-Z0-9-]+)\s+routing tables were migrated", "routing_table", "migrated"),
    (r"^(Class-[A-Z0-9-]+)\s+seating records were migrated", "seating_record", "migrated"),
    (r"^(Class-[A-Z0-9-]+)\s+seating records were not migrated", "seating_record", "not_migrated"),
)
RISK_WORDS = (
    "not", "no", "never", "cannot", "can't", "however", "but", "except", "unless", "denied",
    "restricted", "prohibited", "failed", "failure", "pending", "blocked", "degraded", "offline",
    "inactive", "unavailable", "secret", "credential", "confidential",
)
RISK_PHRASES = ("must not", "should not", "do not", "read-only")

# --- sentence frames ---------------------------------------------------------------------------------

VERIFY_FRAME = r"^(?:Agents? must verify|Agents? should verify|Support agents must confirm)\s+(.+?)[.]?$"
DO_NOT_CLAIM_FRAME = (
    r"^Do not claim\s+(.+?)\s+(is healthy|is approved|is inactive|is active|completed|was deleted"
    r"|was migrated|was skipped|was patched|is writable)[.]?$"
)
ITEM_FRAMES = (
    (r"^Cohort\s+(.+?)\s+was affected[.]?$", "Affected cohorts", "colon"),
    (r"^Cell\s+(.+?)\s+was affected[.]?$", "Affected cells", "colon"),
    (r"^Airport\s+(.+?)\s+was affected[.]?$", "Affected airports", "colon"),
    (r"^Gate\s+(.+?)\s+was affected[.]?$", "Affected gates", "colon"),
    (r"^(Zone-[A-Z0-9-]+)\s+routing tables were migrated[.]?$", "routing tables were migrated", "suffix"),
    (r"^(Class-[A-Z0-9-]+)\s+seating records were migrated[.]?$", "Migrated seating classes", "colon"),
    (r"^(Class-[A-Z0-9-]+)\s+seating records were not migrated[.]?$", "Not-migrated seating classes", "colon"),
    (r"^Flight\s+(.+?)\s+is operational[.]?$", "Operational flights", "colon"),
    (r"^Passenger\s+(.+?)\s+baggage was recovered[.]?$", "Recovered passenger baggage", "colon"),
    (r"^Baggage\s+(.+?)\s+was recovered[.]?$", "Recovered baggage IDs", "colon"),
    (r"^The\s+(.+?)\s+note pool is excluded from migration[.]?$", "Excluded note pools", "colon"),
    (r"^Biomarker\s+(.+?)\s+status is healthy[.]?$", "Healthy biomarkers", "colon"),
    (r"^Biomarker\s+(.+?)\s+is healthy[.]?$", "Healthy biomarkers", "colon"),
    (r"^Service\s+(.+?)\s+is online[.]?$", "Online services", "colon"),
    (r"^Drug\s+(.+?)\s+is active[.]?$", "Active drugs", "colon"),
    (r"^Approved\s+(.+?)[.]?$", "Approved findings", "colon"),
)
SLOT_STATES = ("affected", "reviewed", "migrated", "tested", "retained", "restarted", "drained", "scanned")
SLOT_PREDICATE = r"(?:was|were) (?:affected|reviewed|migrated|tested|retained|restarted|drained|scanned)"
SLOT_BLOCKERS = r"\bdo not\b|\bnever\b|\bexcept\b|\bexcluded\b|\bunavailable\b|\bnot\b"
CONFLICT_RECORD = r"\b(?:conflict record|contradiction|conflict)\b"
STATUS_PREDICATES = (
    "is inactive", "is active", "is degraded", "is not offline", "is not disabled", "is not deleted",
    "is read-only", "status is unavailable", "still exists", "were migrated", "was migrated",
    "were retained", "was retained", "were not deleted", "was not deleted", "were not migrated",
    "was not migrated", "is pending", "is not approved", "is stale", "is locked", "is not ready",
    "is blocked",
)
STATUS_CONFLICTS = (
    ("is active", "is inactive"), ("is approved", "is denied"), ("was migrated", "was not migrated"),
    ("were migrated", "were not migrated"), ("was deleted", "was not deleted"),
    ("were deleted", "were not deleted"), ("is offline", "is not offline"),
    ("is disabled", "is not disabled"), ("is ready", "is not ready"),
)
FACT_PREDICATES = (
    "exposed", "deleted", "modified", "approved", "migrated", "rotated", "patched", "offline",
    "disabled", "included", "ready", "mapped",
)
FUSABLE_PREDICATES = (
    "exposed", "deleted", "modified", "migrated", "rotated", "patched", "offline", "disabled",
    "included", "mapped",
)
UNFUSIBLE_STATES = ("unavailable", "pending", "approved", "denied", "active", "inactive")
CONFLICT_WARNING = (
    r"^((?:Do not|Never)\s+(?:automatically\s+)?(?:resolve|merge|reconcile|collapse|dedupe|deduplicate"
    r"|combine|erase|remove|ignore|hide)\s+)(this|that|the|a|an)\s+"
    r"(conflict|contradiction|discrepancy|mismatch|inconsistency)([^.!?]*)([.!?])$"
)
CONFLICT_SCOPE = (
    r"\b(?:conflict|contradiction|contradicts?|discrepanc(?:y|ies)|mismatch(?:es)?"
    r"|inconsisten(?:t|cy|cies)|disagree(?:s|ment)?|differs?|versus|vs\.?|but|however|on the other hand)\b"
)
FORMULA_APPEARS = r"^Formula\s+(.+?)\s+appears in\s+.+?[.]?$"
FORMULA_PRESERVE = r"^Formula\s+(.+?)\s+must be preserved exactly[.]?$"
BLOCKING_ALIAS = r"\b(?:also called|alias|same as|two separate|separate routes|separate items|do not count|count .* as two)\b"
BLOCKING_MERGE = r"\bdo not\s+(?:compress|merge|combine)\b"
BLOCKING_ORDER_STATES = (
    r"\b(?:affected|reviewed|migrated|tested|retained|drained|restarted|excluded|unavailable|inactive"
    r"|active|pending|approved|denied|deleted|modified|exposed|degraded|paused|quarantined|watchlist|healthy)\b"
)
BLOCKING_STATEMENT = (
    r"\b(?:is|was|were|still|later)\b[^.!?;:]{0,80}\b(?:degraded|paused|quarantined|watchlist|excluded"
    r"|unavailable|inactive|pending|denied|blocked|failed|locked|not\s+\w+|alias|also called)\b"
)

# --- sections and retrieved chunks -----------------------------------------------------------------------

# Header names; a header is a line that holds one of them and a colon.
TYPED_HEADER = (
    r"(?:Retrieved\s+Context\s+Chunk|Chunk|Source|Document)\s+[A-Z0-9]+(?:\s*[-–—?]\s*[^:]{1,100})?"
    r"|System|Context|Background|Background Note|Long Background Note|Task|User Question"
    r"|Customer Question|Customer Ticket|Ticket|Agent Instructions|Agent Reminder"
    r"|Clinical Operations Instructions|User Request|Business Question|Internal Instructions"
    r"|System Instructions|Developer Instructions|Support Instructions|Policy excerpt"
    r"|Final instruction|Final instructions"
)
GENERIC_HEADER = r"[A-Z][A-Za-z0-9 /&-]{2,60}"
CHUNK_HEADER = (
    r"(?:Retrieved (?:context|contract) chunk|Source|Chunk|Document section)\s+[A-Z0-9]+"
    r"(?:\s*[-–—?]\s*[^:]+)?|Policy excerpt"
)
NON_EVIDENCE_HEADERS = (
    "task:", "user question:", "question:", "system prompt:", "instructions:", "metadata:",
    "customer ticket:", "ticket:", "agent instructions:", "agent reminder:",
)
VERIFICATION_ITEMS = ("order ID", "customer email", "purchase date", "refund reason", "product SKU")
EVIDENCE_FACT = (
    r"(?i)__PROTECTED_\d+__|\b[A-Z]{2,}(?:-[A-Z0-9]+)+\b|\$\d[\d,]*(?:\.\d+)?|\b\d{4}-\d{2}-\d{2}\b"
    r"|\b\d+(?:\.\d+)?%|\b\d+(?:\.\d+)?\s*(?:ms|milliseconds|seconds|s)\b"
)
EVIDENCE_OPPOSITES = (
    ("allowed", "prohibited"), ("approved", "denied"), ("must", "must not"),
    ("required", "optional"), ("above", "below"),
)
GUARDED_EVIDENCE_THEMES = ("refund_approval_rule", "latency_metric", "uptime_metric")
KEYWORD_STOP = ("the", "and", "or", "a", "an", "to", "of", "in", "for", "with", "is", "are", "was", "were")

# --- filler, discourse and stop words -----------------------------------------------------------------------

DISCOURSE_WORDS = (
    "hello", "hi", "hey", "please", "kindly", "thanks", "thank", "you", "really", "very", "just",
    "basically", "actually", "bro", "okay", "ok",
)
LOW_INFORMATION_WORDS = ("please", "kindly", "really", "very", "basically", "actually", "just", "simply")
LOW_INFORMATION_ENTITIES = LOW_INFORMATION_WORDS + (
    "the", "a", "an", "this", "that", "these", "those", "it", "if", "do", "use", "return", "system",
    "task", "context", "background", "long", "final",
)
DOMAIN_PHRASES = ("new york", "x-chromosome x-chromosome", "had had", "not not")
RELATION_PAIRS = ("better than", "worse than", "easier than", "harder than")
QUESTION_STARTERS = ("what", "why", "how", "when", "where", "who")

CLUSTER_STOP = (
    "a", "an", "the", "is", "are", "was", "were", "be", "being", "been", "it", "this", "that",
    "because", "since", "really", "very", "extremely", "quite", "maybe", "probably", "possibly",
    "for", "some", "reason", "thing", "stuff", "more", "much", "less", "than", "compared", "to",
    "with", "and", "or", "but", "our", "without", "can", "could", "would", "should", "may", "might",
)
CLUSTER_SYNONYMS = {
    "quick": "fast", "faster": "fast", "speedy": "fast", "stable": "reliable",
    "dependable": "reliable", "simple": "easy", "easier": "easy", "difficult": "hard",
    "difficulty": "easy", "harder": "hard", "costly": "expensive", "affordable": "cheap",
    "cheaper": "cheap", "supports": "can", "allows": "can", "requires": "must",
    "required": "must", "needs": "must", "should": "must",
}
FAMILY_STOP = (
    "a", "an", "the", "is", "are", "was", "were", "be", "being", "been", "by", "of", "in", "to",
    "for", "with", "and", "or", "but", "while", "because", "that", "this", "it", "its", "our",
    "their", "many", "main", "benefit", "platform", "system", "companies", "can", "without",
    "much", "still", "do", "students", "exam", "often", "generally", "considered", "viewed", "find",
)
FAMILY_SYNONYMS = {
    "easier": "easy", "easy": "easy", "simple": "easy", "difficulty": "easy", "harder": "hard",
    "difficult": "hard", "cost": "cost", "costs": "cost", "spending": "cost", "expenses": "cost",
    "spend": "cost", "expenditures": "cost", "usage": "use", "inference": "inference",
    "using": "use", "context": "context", "content": "context", "login": "access",
    "access": "access", "log": "access", "sign": "access", "unable": "cannot", "expose": "reveal",
    "shown": "reveal", "show": "reveal", "compressing": "compress", "compressed": "compress",
    "redundant": "redundant", "repeated": "redundant", "unnecessary": "redundant",
    "important": "important", "preserving": "preserve", "preserved": "preserve",
    "lowers": "lower", "lowering": "lower", "reduces": "reduce", "decreasing": "decrease",
    "decreases": "decrease", "eliminating": "remove", "removing": "remove",
    "maintaining": "preserve", "useful": "important",
}
CLUSTER_ENTITY_STOP = (
    "The", "A", "An", "Our", "Your", "Their", "This", "That", "New", "Knowledge", "Base",
    "Engineering", "Documentation", "Product", "Overview", "User", "Guide", "Training", "Material",
    "FAQ", "Question",
)
FAMILY_ENTITY_STOP = (
    "The", "A", "An", "Our", "Your", "Their", "This", "That", "Many", "Compared", "However", "By",
    "AI", "API", "LLM", "ID", "IDs", "URL", "URLs", "Finance", "Support", "Internal", "Task",
    "Additional", "It", "There", "We", "Requests", "Latency", "Removing", "Lower", "Customers",
    "Agents", "Before", "Do", "Never", "New", "Refund", "Company", "Policy", "Knowledge", "Base",
    "Engineering", "Documentation", "Question", "Product", "Overview", "User", "Guide", "Training",
    "Material", "FAQ", "One", "Furthermore", "Quarterly", "Report", "Operations", "Review",
    "Summary", "Executive", "Brief",
)

# --- grammar screen -----------------------------------------------------------------------------------------

ORPHAN_STARTERS = ("is", "are", "was", "were", "has", "have", "do", "does", "did")
ORPHAN_ENDERS = ("is", "are", "was", "were", "has", "have")
DANGLING_WORDS = ("and", "but", "or", "because", "while", "with", "for", "to", "by", "of", "in", "on")
MODAL_STARTERS = ("can", "could", "would", "should", "may", "might")
FRAGMENT_OK = ("hi", "hello", "thanks", "ok", "yes", "no")
CONTRADICTION_WORDS = (
    "must", "must not", "may", "required", "prohibited", "allowed", "denied", "approved", "shall",
    "shall not", "before", "after",
)
RELATION_PHRASE = (
    r"\b(?:better than|worse than|more than|less than|greater than|fewer than|is better|is worse"
    r"|is easier|is harder|are better|are worse|better|worse|easier|harder|superior|inferior"
    r"|equal to|same as|different from|not better|not worse|plays? for|represents?|responded in"
    r"|completed in|remained below|proven effective|evidence that|causes?|helps?|reduces?|lowers?"
    r"|increases?|requires?|required|must|should|shall|may|might|could|will|cannot|can't|not)\b"
)

# --- prices, routes, thresholds -----------------------------------------------------------------------------

# price key, input per 1000 tokens, output per 1000 tokens (USD)
PRICES = (
    ("dry-run", 0.0, 0.0),
    ("gemini-flash", 0.0003, 0.0025),
    ("openai-small", 0.00015, 0.0006),
    ("openai-strong", 0.005, 0.015),
)
DEFAULT_MODELS = {"openai": ("gpt-4o-mini", "gpt-4o"), "gemini": ("gemini-2.5-flash", "gemini-2.5-flash")}

MAX_REQUEST_BYTES = 5_000_000
TIME_SENSITIVE = (
    r"(?i)\b(?:today|now|current|latest|this week|this month|yesterday|tomorrow|price|weather|news)\b"
)

# Canonical sentences of evidence units.
EVIDENCE_TEXTS = {
    "verification": "Verification rule: agents must verify ",
    "approval": ("Refund rule: refunds over ", " require Finance approval."),
    "window": "Refund window: customers may request a refund within 30 days if usage remains within trial limits.",
    "latency": "Latency metric: latency dropped from ",
    "uptime": "Uptime metric: uptime was ",
    "unknown": "Evidence: ",
}
# Why a strategy is advised.
ADVICE_REASONS = {
    "tiny": "tiny prompt with low repetition; avoid processing overhead",
    "customer_support": "support prompt contains repeated policy requirements and protected ticket facts",
    "rag_context": "retrieved context can contain duplicate chunks and overlapping evidence",
    "high": "high-risk content; use conservative cleanup only",
    "other": "standard optimization strategy selected from prompt analysis",
}
# Fixed word list: words that carry a relation, so a span with one of them is not cut out.
# The line that stands for a theme. Least number of concepts; `{concepts}` and `{subject}` are filled in.
THEME_LINES = {
    "support_verification": (2, "Agents must verify {concepts}."),
    "access_constraint": (2, "Trial users cannot access the feature."),
    "identity_reset": (2, "Users must verify identity before reset."),
    "latency_optimization": (2, "Index optimization reduced search latency."),
    "approval_fact": (2, "Finance approved the budget increase."),
    "deadline_requirement": (2, "The team must submit the report before Friday."),
    "alias_responsibility": (2, "The release owner, also called the deployment coordinator, approves production launches."),
    "warning_repetition": (1, "The text repeats the same warning."),
    "product_benefit": (2, "{subject} {concepts}."),
    "security_constraint": (2, "Do not reveal {concepts}."),
}
# The line on reliability, by what its sentences speak of.
RELIABILITY_LINES = (
    (r"(?i)\b(?:cost|costs|saving|savings|reduction|reductions)\b", "Cost reductions must not compromise {concepts}."),
    (r"(?i)\b(?:migration|move|transition)\b", "The migration must preserve {concepts}."),
    (r"", "The system must preserve {concepts}."),
)
# Lines on cost and outcome, by the concepts they need.
OUTCOME_MECHANISMS = ("compute optimization", "efficiency improvements")
OUTCOME_LINES = (
    (
        ("cloud spending", "operating margins", "financial performance"),
        "The company lowered cloud spending{mechanism}, improving operating margins and financial performance.",
    ),
    (
        ("cloud infrastructure costs", "compute optimization"),
        "The company reduced cloud infrastructure costs through compute optimization and improved efficiency.",
    ),
)
OUTCOME_MECHANISM = " through compute optimization and efficiency improvements"
RECALL_FLOOR = 0.98

# Verbs whose object a span may be.
OBJECT_VERBS = (
    "built", "tested", "used", "made", "created", "needs", "need", "requires", "require", "visited", "met", "called",
    "preserve", "verify",
)
RELATION_VERBS = (
    "need", "needs", "required", "require", "requires", "verify", "confirm", "check", "preserve", "remove", "delete",
    "process", "include", "contain", "costs", "cost", "reduces", "reduce", "lowers", "lower", "increases", "increase",
)
RELATION_WORDS = (
    "is", "are", "was", "were", "has", "have", "had", "be", "been", "for", "to", "from", "with", "by", "of", "in", "on",
    "than", "plays", "play", "represents", "represent", "proven", "evidence", "need", "needs", "required", "require",
    "requires", "cause", "causes", "reduce", "reduces", "lower", "lowers", "increase", "increases",
)
