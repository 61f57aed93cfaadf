"""Constants that results depend on.

Fixed values: thresholds, weights, patterns and short word lists that must not
change, because scores and classifications are defined by them.  They are kept
together and in plain text.  Everything a user may want to replace (stop words,
synonyms, credentials, verbs, headings, cues) is a parameter; see ``dims``.

Patterns are written so that the JVM and RE2 read them alike: no look-around and
no ``\\b`` (word edges are spelled ``(^|[^a-z0-9_])`` and ``([^a-z0-9_]|$)``).
"""

# ------------------------------------------------------------- white space
WS = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
WS_NOT_NEWLINE = r"[ \t\x0B\f\r\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
EDGE_L = r"(^|[^a-z0-9_])"
EDGE_R = r"([^a-z0-9_]|$)"

# ------------------------------------------------------------- limits
MIN_FILE_BYTES = 24
MAX_FILE_BYTES = 15 * 1024 * 1024
MIN_POSTING_CHARS = 120
MAX_POSTING_CHARS = 40000
MIN_TEXT_CHARS = 40
VERSIONS_KEPT = 12
FINDINGS_PER_QUADRANT = 8

# ------------------------------------------------------------- files
SUPPORTED_EXTENSIONS = ["pdf", "docx"]
PDF_MAGIC_HEX = "255044462D"
ZIP_MAGIC_HEX = "504B0304"
OLE_MAGIC_HEX = "D0CF11E0A1B11AE1"

# ------------------------------------------------------------- bullets
GLYPHS = r"[\x{2022}\x{2023}\x{25AA}\x{25AB}\x{25CF}\x{25E6}\x{2043}\x{2219}\x{00B7}\x{2767}\x{279C}*\x{2014}]"
GLYPH_BULLET = r"^\s*(" + GLYPHS + r")\s*(.*)$"
DASH_BULLET = r"^\s*([-\x{2013}])\s+(.*)$"
NUMBERED_BULLET = r"^\s*(\(?\d{1,2}[.)]|\(?[a-zA-Z][.)]|[ivxIVX]{1,4}[.)])\s+(.{2,})$"
BULLET_STYLES = [("disc", "●"), ("square", "▪"), ("dot", "•"), ("dash", "–")]
DASH_STYLE_MIN = 12

# ------------------------------------------------------------- dates
MONTH = (
    "january|february|march|april|may|june|july|august|september|october|november|december"
    "|jan|feb|mar|apr|jun|jul|aug|sept|sep|oct|nov|dec"
)
YEAR = r"(?:19|20)\d{2}"
DASH = r"[-\x{2013}\x{2014}]{1,2}"
DATE_RANGE_MONTHS = (
    rf"(?i)(?:^|[^a-z0-9_])((?:{MONTH})\.?\s*{YEAR}\s*{DASH}\s*"
    rf"(?:present|current|now|(?:{MONTH})\.?\s*{YEAR}|{YEAR}))(?:[^a-z0-9_]|$)"
)
DATE_RANGE_YEARS = rf"(?i)(?:^|[^a-z0-9_])({YEAR}\s*{DASH}\s*(?:present|current|now|{YEAR}))(?:[^a-z0-9_]|$)"
DATE_SINGLE = rf"(?i)(?:^|[^a-z0-9_])((?:{MONTH})\.?\s*{YEAR}|{YEAR})(?:[^a-z0-9_]|$)"
PRESENT_MARKER = rf"(?i){EDGE_L}(present|current|presently|now|today|to date|ongoing){EDGE_R}"
MONTH_SHORT = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# ------------------------------------------------------------- bullet quality
METRIC = (
    rf"(?i){EDGE_L}("
    rf"\d{{1,3}}([.,]\d+)?\s?(%|percent{EDGE_R})"
    r"|(usd|eur|gbp|inr|aud|cad|zar|sgd|ae[dv])\s?[\d.,]+"
    rf"|[\d.,]+\s?(k|m|bn){EDGE_R}"
    rf"|\d[\d,]{{2,}}\+?{EDGE_R}"
    rf"|\d+(\.\d+)?\s?(x|times){EDGE_R}"
    r"|from\s+[\d.,]+"
    r"|to\s+[\d.,]+\s?(%|k|m|million))"
)
PASSIVE = rf"(?i){EDGE_L}(responsible for|worked on|helped|assisted|was responsible|participated in){EDGE_R}"

# ------------------------------------------------------------- contacts
EMAIL = r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
PHONE = r"\+?\d[\d\s().-]{7,}\d"
LINKEDIN = r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/[^\s|,)]+"
PORTFOLIO = (
    r"(?i)(?:https?://)?(?:www\.)?(?:github\.com|dribbble\.com|behance\.net|medium\.com"
    r"|portfolio\.[\w-]+|[\w-]+\.(?:com|net|org|io|dev|co))/?[^\s|,)]{0,60}"
)

# ------------------------------------------------------------- sections
SECTION_ORDER = [
    "contact", "summary", "experience", "skills", "projects", "education", "certifications",
    "achievements", "languages", "interests", "other",
]
CORE_SECTIONS = ["summary", "experience", "skills", "education"]

# ------------------------------------------------------------- posting analysis
# hundredths, so sums are exact integers on every engine
BUCKET_WEIGHT_C = {
    "required": 400, "preferred": 240, "qualifications": 300, "tools": 340,
    "responsibilities": 220, "general": 140,
}
TITLE_WEIGHT_C, CERT_WEIGHT_C, SOFT_WEIGHT_C, USER_WEIGHT_C = 360, 320, 160, 500
COUNT_WEIGHT_C, SYNONYM_BONUS_C, CATEGORY_BONUS_C = 55, 150, 110
HIGH_SCORE_C, MEDIUM_SCORE_C = 520, 290
GAP_WORDS = [
    "we", "you", "our", "the", "will", "would", "should", "must", "can", "is", "are", "have",
    "has", "with", "for", "and", "or", "in", "on", "of", "to", "a", "an",
]
YEARS_PATTERNS = [
    r"(?i)(\d{1,2})\s*\+?\s*years?(?:\s+of)?\s+(?:relevant\s+|proven\s+|hands[- ]on\s+|professional\s+)?experience",
    r"(?i)(?:minimum|at least|over|more than)\s*(\d{1,2})\s+years?",
    r"(?i)(\d{1,2})\s*[-\x{2013}]\s*\d{1,2}\s*years?",
    r"(?i)(\d{1,2})\s*\+?\s*years?[^.]{0,40}(?:in|of|with)\s+[a-z ]{3,40}",
]
CREDENTIAL_SUFFIX = (
    r"\s+(certification|certified|qualification|certificate|accreditation|accredited|award|level|course|training)$"
)

# ------------------------------------------------------------- scores
PRIORITY_WEIGHT = {"HIGH": 3, "MEDIUM": 2}
# percent points
ATS_WEIGHTS = {
    "keywordCoverage": 20, "jdRelevance": 10, "skillAlignment": 14, "titleAlignment": 8,
    "actionVerbs": 11, "readability": 9, "sectionStructure": 11, "duplicateContent": 8,
    "missingKeywords": 5, "unsupportedKeywords": 4,
}
JOB_WEIGHTS = {
    "keywordCoverage": 34, "requiredSkills": 24, "roleAlignment": 16, "jdLanguage": 14,
    "evidenceStrength": 12,
}
ATS_BANDS = [(85, "strong"), (70, "good"), (55, "fair")]
JOB_BANDS = [(85, "excellent"), (70, "strong"), (55, "partial"), (40, "weak")]
SEVERITY_RANK = {"high": 0, "medium": 1, "low": 2}

# units that belong to a number (fixed values)
NUMBER_UNITS = ["%", "percent", "x", "times", "k", "m", "bn", "million", "billion", "thousand", "usd", "eur", "gbp", "inr", "aud", "cad", "zar", "sgd"]
# a named posting title, and a first line that may stand for one (fixed values, lengths included)
TITLE_NAMED = r"(?i)(?:job title|position|role|title)\s*[:-]\s*([^\n]{2,80})"
TITLE_LINE = r"^[A-Z].{4,70}$"
# words that mark a degree and a school (fixed values)
DEGREE = (
    r"(?i)(^|[^a-z0-9_])(bachelor|master|ph\.?d|doctorate|diploma|b\.?sc|m\.?sc|b\.?a|m\.?a|b\.?com|b\.?tech|m\.?tech"
    r"|mba|associate|postgraduate|undergraduate|honou?rs)([^a-z0-9_]|$)"
)
SCHOOL = r"(?i)university|college|school|institute|academy|polytechnic"
