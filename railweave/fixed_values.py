"""Fixed values.

Word lists, patterns, thresholds and text formats that have to equal the
published behaviour for results to be right. They are data: every operator that
uses one takes it as a parameter, with these as the defaults.
"""

# ---------------------------------------------------------------- null tokens
NULL_TOKENS = ("", "nan", "NaN", "None", "NaT")

# ------------------------------------------------------------------ synonyms
# (pattern, expansion), applied in this order to already expanded text.
SYNONYMS = [
    (r"\bsl\b", "Sleeper class SL"),
    (r"\b2a\b", "AC 2 Tier 2A"),
    (r"\b3a\b", "AC 3 Tier 3A"),
    (r"\bcc\b", "AC Chair Car CC"),
    (r"\b1a\b", "AC First Class 1A"),
    (r"\bec\b", "Executive Chair Car EC"),
    (r"\b2s\b", "Second Sitting 2S"),
    (r"\brac\b", "RAC Reservation Against Cancellation"),
    (r"\bwl\b", "Waiting List WL"),
    (r"\btte\b", "Travelling Ticket Examiner TTE"),
    (r"\btatkal\b", "Tatkal quota premium booking"),
    (r"\bpnr\b", "PNR Passenger Name Record"),
    (r"\bntes\b", "National Train Enquiry System NTES"),
    (r"\birctc\b", "IRCTC Indian Railway Catering Tourism Corporation"),
    (r"\bsf\b", "Superfast SF"),
    (r"\bexp\b", "Express"),
    (r"\bpax\b", "passenger"),
    (r"\bluggage\b", "luggage baggage allowance"),
    (r"\bbaggage\b", "luggage baggage allowance"),
    (r"\bfine\b", "penalty fine charge"),
    (r"\bvizag\b", "Visakhapatnam VSKP Vizag"),
    (r"\bhyd\b", "Hyderabad HYD HYB SC Secunderabad"),
    (r"\bhyderabad\b", "Hyderabad HYD HYB SC Secunderabad Nampally"),
    (r"\bsecunderabad\b", "Secunderabad SC Hyderabad HYB"),
    (r"\bbzp\b", "Vijayawada BZA"),
    (r"\bmas\b", "Chennai Central MAS"),
    (r"\bndls?\b", "New Delhi NDLS"),
    (r"\bcst\b", "Chhatrapati Shivaji Terminus Mumbai CSTM"),
    (r"\bsbc\b", "Bengaluru KSR SBC"),
    (r"\bbpl\b", "Bhopal BPL"),
]

# ------------------------------------------------- category -> coarse intent
COARSE_INTENT = {
    "LIVE_STATUS": "LIVE",
    "PNR_STATUS": "LIVE",
    "CANCELLATION_TODAY": "LIVE",
    "PLATFORM_TODAY": "LIVE",
    "SCHEDULE_QUERY": "STATIC",
    "BETWEEN_STATIONS": "STATIC",
    "STATION_INFO": "STATIC",
    "CANCELLATION_RULES": "STATIC",
    "COACH_QUERY": "STATIC",
    "GENERAL_INFO": "STATIC",
    "HYBRID": "HYBRID",
    "OUT_OF_DOMAIN": "OUT_OF_DOMAIN",
}

# --------------------------- question patterns, first match wins, in this order
# (pattern, category, confidence)
QUESTION_PATTERNS = [
    (r"\b\d{10}\b", "PNR_STATUS", 1.00),
    (r"\bpnr\b", "PNR_STATUS", 0.99),
    (r"\b(is|has)\b.{0,40}\b(cancelled|canceled|suspended|diverted)\b.{0,25}\b(today|now|tonight|currently)\b", "CANCELLATION_TODAY", 0.95),
    (r"\b(cancelled|canceled|suspended|diverted)\b.{0,25}\b(today|now|tonight)\b", "CANCELLATION_TODAY", 0.92),
    (r"\b(is|has)\b.{0,20}\btrain\b.{0,25}\b(cancelled|diverted|not running)\b", "CANCELLATION_TODAY", 0.88),
    (r"\b(which|what)\b.{0,12}\bplatform\b.{0,35}\b(today|now|tonight|coming|arriving)\b", "PLATFORM_TODAY", 0.92),
    (r"\bplatform\b.{0,20}\b(today|now|tonight)\b", "PLATFORM_TODAY", 0.88),
    (r"\b(where\s+is|where's)\b.{0,35}\b\d{4,5}\b", "LIVE_STATUS", 0.98),
    (r"\b(running|live)\s+status\b.{0,30}\b\d{4,5}\b", "LIVE_STATUS", 0.97),
    (r"\b\d{4,5}\b.{0,20}\b(running|live)\s+status\b", "LIVE_STATUS", 0.97),
    (r"\bspot\b.{0,25}\b(train\b.{0,12})?\d{4,5}\b", "LIVE_STATUS", 0.96),
    (r"\b(is|has)\b.{0,25}\b\d{4,5}\b.{0,25}\b(running|on time|delayed|late|left|departed|started|reached)\b", "LIVE_STATUS", 0.93),
    (r"\b\d{4,5}\b.{0,25}\b(has|have)\b.{0,12}\b(arrived|reached|passed|left|departed|crossed)\b", "LIVE_STATUS", 0.93),
    (r"\b(current|real.?time)\b.{0,18}\b(position|location|station|status)\b.{0,25}\b\d{4,5}\b", "LIVE_STATUS", 0.93),
    (r"\b\d{4,5}\b.{0,25}\b(current|real.?time)\b.{0,18}\b(position|location)\b", "LIVE_STATUS", 0.92),
    (r"\b\d{4,5}\b.{0,25}\b(delayed|late|on time|running)\b.{0,15}\b(today|now|tonight|currently)?\b", "LIVE_STATUS", 0.88),
    (r"\b(eta|expected arrival|expected at)\b.{0,35}\b\d{4,5}\b", "LIVE_STATUS", 0.90),
    (r"\b\d{4,5}\b.{0,25}\b(eta|expected arrival)\b", "LIVE_STATUS", 0.88),
    (r"\b(what time|when|timing)\b.{0,35}\b\d{4,5}\b.{0,40}\b(arrive|reach|depart|leave|stop|pass|start)\b", "SCHEDULE_QUERY", 0.97),
    (r"\b(what time|timing)\b.{0,35}\b(arrive|reach|depart|leave|stop)\b.{0,35}\b\d{4,5}\b", "SCHEDULE_QUERY", 0.96),
    (r"\b(arrival|departure)\s+time\b.{0,35}\b\d{4,5}\b", "SCHEDULE_QUERY", 0.97),
    (r"\b\d{4,5}\b.{0,25}\b(arrival|departure)\s+time\b", "SCHEDULE_QUERY", 0.96),
    (r"\b(when does|when will|what time does|what time will)\b.{0,25}\b\d{4,5}\b", "SCHEDULE_QUERY", 0.96),
    (r"\b(stops|schedule|timetable|route|halts?|stations?)\b.{0,12}\b(of|for)\b.{0,25}\b\d{4,5}\b", "SCHEDULE_QUERY", 0.98),
    (r"\b\d{4,5}\b.{0,18}\b(stops|schedule|timetable|route|halts?)\b", "SCHEDULE_QUERY", 0.97),
    (r"\b(how long|halt|halting)\b.{0,15}\b(at|in|for)\b.{0,35}\b\d{4,5}\b", "SCHEDULE_QUERY", 0.92),
    (r"\b\d{4,5}\b.{0,25}\b(halt|halts|halting|stops for)\b", "SCHEDULE_QUERY", 0.91),
    (r"\b\d{4,5}\b.{0,25}\btiming\b", "SCHEDULE_QUERY", 0.90),
    (r"\btiming\b.{0,25}\b\d{4,5}\b", "SCHEDULE_QUERY", 0.90),
    (r"\b(what time|when)\b.{0,25}\b(start|depart|leave|arrive)\b.{0,25}\bfrom\b", "SCHEDULE_QUERY", 0.88),
    (r"\b\d{4,5}\b.{0,25}\b(arrives?|departs?|reaches?)\b.{0,10}\bat\b", "SCHEDULE_QUERY", 0.87),
    (r"\b(which day|day \d)\b.{0,25}\b\d{4,5}\b", "SCHEDULE_QUERY", 0.88),
    (r"\b\d{4,5}\b.{0,25}\b(which day|day \d)\b", "SCHEDULE_QUERY", 0.88),
    (r"\btrains?\b.{0,18}\b(from|between)\b.{1,50}\b(to|and)\b", "BETWEEN_STATIONS", 0.95),
    (r"\b(which|what|list)\s+trains?\b.{0,25}\b(go|run|pass|connect|available)\b.{0,30}\b(from|between|via)\b", "BETWEEN_STATIONS", 0.94),
    (r"\b(direct|connecting)\s+trains?\b.{0,25}\b(from|between)\b", "BETWEEN_STATIONS", 0.93),
    (r"\bhow\s+to\s+(go|travel|reach)\b.{0,35}\b(from|to)\b", "BETWEEN_STATIONS", 0.88),
    (r"\b(from|between)\b.{1,35}\bto\b.{1,35}\b(trains?|service|connection)\b", "BETWEEN_STATIONS", 0.87),
    (r"\b(about|details?|info(rmation)?)\b.{0,18}\bstation\b", "STATION_INFO", 0.91),
    (r"\bstation\s+(code|zone|division|region)\b.{0,25}\bof\b", "STATION_INFO", 0.93),
    (r"\b(zone|division)\b.{0,18}\bstation\b", "STATION_INFO", 0.89),
    (r"\bwhat\s+is\b.{0,25}\b(code|zone)\b.{0,25}\bstation\b", "STATION_INFO", 0.88),
    (r"\b(cancellation|refund)\s+(charges?|fee|fees|rules?|policy|amount|percentage)\b", "CANCELLATION_RULES", 0.97),
    (r"\bhow\s+much\b.{0,25}\b(refund|deducted|charged|penalty)\b.{0,25}\b(cancel|cancellation)\b", "CANCELLATION_RULES", 0.96),
    (r"\b(tdr|ticket\s+deposit\s+receipt)\b", "CANCELLATION_RULES", 0.93),
    (r"\b(cancel|cancellation)\b.{0,25}\b(policy|rule|how|procedure|process)\b", "CANCELLATION_RULES", 0.90),
    (r"\b(which|where)\b.{0,18}\b(coach|bogie|compartment)\b", "COACH_QUERY", 0.92),
    (r"\b(position|order|sequence|arrangement)\b.{0,18}\b(coach|bogie)\b", "COACH_QUERY", 0.91),
    (r"\bcoach\b.{0,12}\b[SsBbAaCcDdEeHhPpJjFf]\d+\b", "COACH_QUERY", 0.94),
    (r"\b(composition|makeup|formation)\b.{0,18}\b(of|for)?\b.{0,25}\btrain\b", "COACH_QUERY", 0.89),
    (r"\b(luggage|baggage)\b.{0,18}\b(limit|allowance|rules?|permitted|allowed|weight)\b", "GENERAL_INFO", 0.94),
    (r"\b(tte|ticket\s+collector|ticket\s+examiner)\b.{0,25}\b(duties?|responsibilities?|power|fine|role)\b", "GENERAL_INFO", 0.93),
    (r"\b(tatkal|premium\s+tatkal|pqwl|gnwl|rswl|rac|ckwl)\b.{0,25}\b(rules?|charges?|how|booking|quota)\b", "GENERAL_INFO", 0.92),
    (r"\b(senior\s+citizen|handicapped|disabled|ex.?serviceman)\b.{0,25}\b(concession|discount|quota|reservation)\b", "GENERAL_INFO", 0.92),
    (r"\b(fare|ticket\s+price|cost|charge)\b.{0,25}\b(from|to|between|for|in|class)\b", "GENERAL_INFO", 0.90),
    (r"\b(sleeper|ac\s+\d?|first\s+class|second\s+class)\b.{0,20}\b(rules?|limit|weight|allowance|fare|price)\b", "GENERAL_INFO", 0.89),
    (r"\b(rac|wl|waiting\s+list|confirm(ed)?|cnf)\b.{0,20}\b(meaning|what|rules?|policy|status)\b", "GENERAL_INFO", 0.89),
    (r"\bwhat\s+is\b.{0,10}\b(rac|gnwl|pqwl|rswl|ckwl|cnf|tdr|tatkal)\b", "GENERAL_INFO", 0.90),
]

# ------------------------------------------------------------ keyword fallback
LIVE_KEYWORDS = [
    "live", "running", "status", "spot", "late", "delay", "delayed",
    "track", "location", "current", "position", "cancelled", "canceled", "suspended",
    "is it on time", "where is", "expected arrival", "commenced", "commencing",
]
SCHEDULE_KEYWORDS = [
    "arrive", "arrives", "arrival", "arriving", "depart", "departs", "departure", "departing",
    "reach", "reaches", "reaching", "start", "starts", "starting",
    "run", "runs", "timing", "timings", "when", "what time", "how long",
    "halt", "halts", "timetable", "schedule", "stops", "route", "pass", "passes",
]
STATIC_KEYWORDS = [
    "cancel", "cancellation", "refund", "charge", "charges", "fee", "fees",
    "rule", "rules", "luggage", "limit", "allowance", "penalty", "fine",
    "tte", "duty", "duties", "policy", "policies", "weight",
    "fare", "ticket price", "class", "sleeper", "ac", "general", "quota",
    "stops of", "schedule of", "timetable of", "route of", "passing through",
    "how to book", "senior citizen", "concession", "tatkal", "premium tatkal",
    "tdr", "rac", "gnwl", "pqwl", "rswl", "ckwl", "cnf", "wl",
    "vande bharat", "shatabdi", "rajdhani", "duronto",
    "garib rath", "jan shatabdi", "humsafar", "amrit bharat", "tejas",
    "coach", "berth",
]
ROUTING_KEYWORDS = ["between", "from", "to", "via", "through"]
GENERAL_KEYWORDS = [
    "train", "trains", "railway", "railways", "station", "stations",
    "ticket", "tickets", "fare", "fares", "coach", "berth", "pnr",
    "irctc", "ntes", "tte", "rac", "wl", "gnwl", "pqwl", "rswl",
    "ckwl", "tq", "tqwl", "cnf", "tdr", "tatkal", "sleeper", "ac",
    "general", "quota", "luggage", "baggage", "cancellation", "refund",
    "schedule", "timetable", "delay", "delayed", "running", "status",
    "route", "routes", "passengers", "passenger", "catering", "pantry",
    "vande bharat", "tejas", "shatabdi", "rajdhani", "duronto",
    "garib rath", "jan shatabdi", "humsafar", "amrit bharat",
    "sampark kranti", "suburban", "express", "mail", "superfast", "sf",
    "loco", "engine", "rake", "wagon", "rpf", "cris", "bpc", "cantt",
    "junction", "jn", "platform", "pf", "halt", "stop",
]
TRAIN_CLASS_WORDS = ["express", "mail", " sf ", "superfast", "passenger"]

# ------------------------------------------------------------ station mentions
STATION_STOP_WORDS = [
    "is", "in", "to", "on", "or", "now", "at", "for", "the", "and",
    "train", "trains", "station", "stations", "route", "routes", "status",
    "spot", "where", "late", "delay", "arrive", "departure", "platform",
    "track", "reach", "when", "location", "current", "time", "what", "how",
    "running", "today", "tomorrow", "yesterday", "daily", "weekly",
    "will", "expected", "supposed", "which", "does", "did", "has", "have",
]
VOCABULARY_IGNORE = [
    "junction", "jn", "junctions", "cabin", "road", "halt",
    "crossing", "station", "town", "city", "north", "south",
    "east", "west", "central", "new", "old", "and", "the",
    "via", "pass", "under", "over", "bridge",
]
FIRST_WORD_NOISE = [
    "new", "old", "north", "south", "east", "west", "central",
    "junction", "road", "halt", "cabin", "town", "city",
]
MENTION_STOP_WORDS = [
    "the", "and", "for", "are", "get", "new", "old", "can", "our", "out",
    "all", "its", "any", "not", "but", "who", "you", "she", "his", "her",
    "him", "has", "had", "was", "web", "doc", "app", "now", "day", "runs",
]
FUZZY_IGNORE = [
    "train", "trains", "station", "stations", "route", "routes", "daily", "weekly",
    "what", "where", "from", "stop", "stops", "here", "arrive", "departure",
    "cancellation", "cancel", "charge", "charges", "rule", "rules", "luggage", "class",
    "between", "which", "running", "express", "superfast", "mail",
]
CODE_NOISE = [
    "AC", "DC", "ID", "OK", "OR", "IS", "AT", "IN", "OF",
    "TO", "BY", "UP", "ON", "AS", "AN", "MY", "WE", "THE",
    "AND", "FOR", "FROM", "VIA", "ARE", "GET", "NOW", "DAY",
    "TRAIN", "TRAINS", "ROUTE", "STOP", "STOPS",
]
STATION_CODE_EXCLUDE = [
    "AC", "CC", "TTE", "PNR", "PDF", "PNG", "JPG", "RAG",
    "LLM", "API", "IST", "ETA", "RPF", "EMU", "DMU", "MEX",
]
FUZZY_CUTOFF_ALL = 0.82
FUZZY_CUTOFF_SINGLE = 0.80

# ------------------------------------------------------- routing of collections
COLLECTIONS = ["railway_rules", "trains", "stations", "train_routes", "references"]
TRANSIT_COLLECTIONS = ["trains", "stations", "train_routes"]
RULE_COLLECTIONS = ["railway_rules", "references"]
TRANSIT_WORDS = [
    "stop", "stops", "route", "timings", "timetable", "departure", "arrive",
    "arrival", "halt", "pass through", "runs from",
]
RULE_WORDS = [
    "cancel", "cancellation", "refund", "luggage", "penalty", "fine", "tte", "rule",
    "duty", "duties", "allowance", "charge", "charges", "fee",
]

# -------------------------------------------------------- scores and thresholds
KEYWORD_BASE, KEYWORD_TF_WEIGHT, KEYWORD_BOTH_BONUS, KEYWORD_TF_CAP = 0.70, 0.20, 0.10, 5.0
ROUTE_WEIGHT, OTHER_WEIGHT = 1.0, 0.85
ROUTE_CUTOFF, OTHER_CUTOFF = 0.65, 0.75
PER_COLLECTION_K = 5
MIN_RELEVANCE = 0.30
RRF_K = 60
DEDUPE_PREFIX = 100
EXACT_PER_NUMBER = 5
RESULT_LIMIT_WITH_ENTITY = 25
TOP_K = 10
TRIM_ABOVE_STOPS = 4
CONTEXT_BUDGET = 12000
DOC_SEPARATOR = "\n\n---\n\n"
NO_DOCUMENTS = "No relevant documents found."

# ---------------------------------------------------------------- days and time
DAY_NAMES = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
WEEKDAY_BITS = [0, 1, 1, 1, 1, 1, 0]
WEEKEND_BITS = [1, 0, 0, 0, 0, 0, 1]

# ------------------------------------------------------------- state over time
RATE_LIMIT_MAX, RATE_LIMIT_SECONDS = 15, 60
ANSWER_TTL_SECONDS = 600
STATUS_TTL_SECONDS = 300
BOOKING_TTL_SECONDS = 600
HISTORY_TURNS = 5
PREVIEW_CHARS = 300
LOG_QUESTION_CHARS = 200
TOP_QUESTION_CHARS = 100
UPGRADE_WORDS = ["stops", "route", "schedule"]
UPGRADE_EXEMPT = ["SCHEDULE_QUERY", "BETWEEN_STATIONS", "STATION_INFO", "COACH_QUERY"]

# ------------------------------------------------------------------- text forms
STATIC_HEADER = "=== DATABASE RULES/TIMETABLES (STATIC) ===\n"
HISTORY_HEADER = "\n=== CONVERSATION HISTORY (for context) ===\n"
RULER = "=" * 50
WARNING_HEAD = "⚠️ Answer mentions train "
WARNING_TAIL = " which was not found in retrieved context — possible hallucination."
NO_ROUTE_TAIL = (
    " in the available route data.\n\n"
    "This could mean:\n"
    "- No train connects these stations directly\n"
    "- These stations are served by connecting routes\n"
    "- The data may not include all services\n\n"
    "Please verify on [NTES](https://enquiry.indianrail.gov.in) or the IRCTC app."
)
SCHEDULE_ONLY = "Schedule data only (no live position from erail.in)"
STATUS_PREFIXES = ["departed from", "arrived at", "expected arrival at", "expected departure at"]
INVALID_BOOKING_KEY = "Invalid PNR format. Must be a 10-digit number."
