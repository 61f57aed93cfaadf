"""Default dictionaries and the helpers that turn them into dimension tables.

Every operator takes its dictionary as an argument (a list or a DataFrame), so
these short English defaults can be replaced per language or per domain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termloom.fixed_values import SECTION_ORDER

# ------------------------------------------------------------ words a term never consists of
ARTICLES = ["a", "an", "the"]
PRONOUNS = [
    "i", "me", "my", "mine", "you", "your", "yours", "he", "him", "his", "she", "her", "hers", "it", "its",
    "we", "us", "our", "ours", "they", "them", "their", "this", "that", "these", "those", "who", "whom",
    "whose", "which", "what",
]
PREPOSITIONS = [
    "about", "above", "across", "after", "against", "along", "among", "around", "at", "before", "behind",
    "below", "between", "by", "down", "during", "for", "from", "in", "into", "near", "of", "off", "on",
    "onto", "out", "over", "per", "since", "through", "to", "toward", "towards", "under", "until", "up",
    "upon", "via", "with", "within", "without",
]
CONJUNCTIONS = ["and", "as", "because", "but", "if", "nor", "or", "so", "than", "though", "unless", "when", "where", "while", "yet"]
AUXILIARIES = [
    "am", "are", "be", "been", "being", "can", "could", "did", "do", "does", "had", "has", "have", "having",
    "is", "may", "might", "must", "shall", "should", "was", "were", "will", "would",
]
ADVERBS = ["again", "all", "also", "any", "each", "even", "every", "here", "how", "just", "more", "most", "no", "not", "now", "only", "same", "some", "such", "then", "there", "too", "very", "why"]
STOP_WORDS = ARTICLES + PRONOUNS + PREPOSITIONS + CONJUNCTIONS + AUXILIARIES + ADVERBS

# people, terms of hire and spans of time: an advertisement says them of any job
BANNED_TERMS = [
    "business", "career", "employee", "firm", "hire", "hour", "individual", "job", "minute", "person", "post",
    "quarter", "recruiter", "shift", "staff", "today", "tomorrow", "vacancy", "worker", "workplace",
]

# words around a skill that are no part of it
PHRASE_FILLER = [
    "advanced", "awareness", "background", "basic", "capability", "capable", "comfort", "comfortable",
    "command", "competence", "competent", "confident", "demonstrable", "demonstrated", "experience",
    "experienced", "exposure", "fluency", "fluent", "good", "grasp", "handle", "handling", "hands-on",
    "knowledge", "own", "practical", "proficiency", "proficient", "sound", "strong", "thorough",
    "understanding", "work", "working", "a", "an", "and", "for", "in", "of", "on", "the", "to", "with",
]

# words of the advertisement itself
AD_WORDS = [
    "allowance", "apply", "deadline", "dental", "flexible", "full-time", "holiday", "hybrid", "interview",
    "leave", "onsite", "part-time", "pay", "pension", "perk", "perks", "remote", "salary", "start", "vacation",
    "visa", "wage",
]

# openings of a line that say what kind of line it is
CUES = {
    "noise": ["how we hire", "hybrid", "pay range", "pension", "remote", "salary", "send your", "visa", "where you will sit", "working hours"],
    "required": ["must", "necessary", "needed", "require", "requirements", "you have", "you bring"],
    "preferred": ["advantage", "extra credit", "good to have", "nice to have", "optional", "welcome"],
    "responsibilities": ["day to day", "responsibilities", "tasks", "you do", "you own", "your work"],
    "qualifications": ["degree", "profile", "qualifications", "schooling", "training"],
    "tools": ["languages we use", "our stack", "programs", "tooling", "tools"],
}

# term -> phrases that mean the same
SYNONYMS = {
    "accounts payable": ["invoice processing", "supplier invoices"],
    "bookkeeping": ["ledger keeping", "general ledger"],
    "budgeting": ["budget planning", "cost planning"],
    "customer support": ["customer service", "help desk", "service desk"],
    "data cleaning": ["data cleansing", "data quality work"],
    "data pipelines": ["etl jobs", "data flows"],
    "excel": ["spreadsheets", "spreadsheet models"],
    "hiring": ["recruiting", "staffing", "talent acquisition"],
    "incident response": ["on-call work", "outage handling"],
    "javascript": ["ecmascript", "js"],
    "kubernetes": ["k8s", "container orchestration"],
    "machine learning": ["ml", "statistical learning"],
    "patient care": ["bedside care", "nursing care"],
    "payroll": ["wage runs", "pay runs"],
    "presentation": ["public speaking", "slide decks"],
    "quality assurance": ["qa", "quality checks"],
    "scheduling": ["rostering", "shift planning"],
    "software testing": ["test automation", "unit testing"],
    "sql": ["structured query language", "relational queries"],
    "technical writing": ["documentation", "user manuals"],
    "warehouse work": ["picking and packing", "order picking"],
}

# source phrase -> phrases it may be rewritten to (direction matters)
SUBSTITUTIONS = {
    "bedside care": ["patient care"],
    "container orchestration": ["kubernetes"],
    "etl jobs": ["data pipelines"],
    "general ledger": ["bookkeeping"],
    "help desk": ["customer support"],
    "k8s": ["kubernetes"],
    "order picking": ["warehouse work"],
    "recruiting": ["hiring"],
    "relational queries": ["sql"],
    "rostering": ["scheduling"],
    "spreadsheet models": ["excel"],
    "spreadsheets": ["excel"],
    "unit testing": ["software testing"],
    "user manuals": ["technical writing"],
}

# public abbreviations of credentials
CREDENTIALS = {
    "acca": "association of chartered certified accountants",
    "capm": "certified associate in project management",
    "ceh": "certified ethical hacker",
    "cisa": "certified information systems auditor",
    "cpim": "certified in planning and inventory management",
    "cscp": "certified supply chain professional",
    "phr": "professional in human resources",
    "pmp": "project management professional",
    "rn": "registered nurse",
}

SOFT_SKILLS = [
    "active listening", "calm under pressure", "coaching", "communication", "conflict resolution", "curiosity",
    "empathy", "facilitation", "flexibility", "initiative", "leadership", "patience", "persuasion",
    "planning ahead", "reliability", "resilience", "self-discipline", "teamwork", "tact", "writing clearly",
]

# marks of a category: a term that holds one belongs to it
TECH_WORDS = [
    "android", "ansible", "aws", "azure", "bash", "cloud", "css", "django", "docker", "elasticsearch", "excel",
    "figma", "git", "golang", "graphql", "html", "ios", "javascript", "jenkins", "kotlin", "kubernetes", "linux",
    "matlab", "mongodb", "mysql", "numpy", "pandas", "php", "postgres", "python", "pytorch", "redis", "ruby",
    "rust", "scala", "spark", "sql", "swift", "typescript", "unix", "windows",
]
QUALIFICATION_WORDS = [
    "accredited", "apprenticeship", "badge", "certification", "certified", "credential", "degree", "diploma",
    "doctorate", "licence", "license", "registered",
]
DOMAIN_WORDS = [
    "account", "audit", "care", "chemistry", "clinic", "demand", "factory", "farm", "finance", "forecast", "freight",
    "insurance", "law", "logistic", "nursing", "payroll", "pharmacy", "planning", "publishing", "safety", "sales",
    "supply", "tax", "teaching", "tourism", "trade", "transport", "warehouse", "welding",
]
SOFT_WORDS = ["calm", "communicat", "empath", "initiative", "leader", "listen", "patien", "persua", "resilien", "tact", "teamwork"]

INDUSTRIES = [
    "agriculture", "architecture", "banking", "biotechnology", "chemicals", "civil engineering", "defence",
    "education", "energy", "fashion", "film", "fisheries", "food processing", "forestry", "gaming", "health care",
    "hospitality", "insurance", "journalism", "law", "mining", "museums", "pharmacy", "property", "public health",
    "publishing", "rail", "retail", "shipping", "sports", "telecoms", "tourism", "utilities", "waste management",
]

# headings of a curriculum vitae
SECTION_ALIASES = {
    "contact": ["contact", "contact information", "how to reach me"],
    "summary": ["summary", "professional summary", "profile", "personal statement", "about"],
    "experience": ["experience", "professional experience", "work experience", "work history", "jobs held", "positions held", "relevant experience"],
    "education": ["education", "degrees", "schools", "studies"],
    "skills": ["skills", "abilities", "technical skills", "tools and methods", "what i know"],
    "certifications": ["certifications", "credentials", "licences", "licenses"],
    "projects": ["projects", "own projects", "project work", "side projects"],
    "achievements": ["achievements", "awards", "distinctions", "prizes"],
    "languages": ["languages", "spoken languages"],
    "interests": ["interests", "free time", "pastimes", "volunteer work"],
}
# headings that say little by themselves
WEAK_HEADINGS = ["additional", "background", "early career", "earlier", "further", "misc", "more", "other", "relevant experience", "various"]

ROLE_WORDS = [
    "accountant", "adviser", "agent", "analyst", "apprentice", "architect", "assistant", "baker", "bookkeeper",
    "buyer", "carpenter", "cashier", "chef", "chemist", "clerk", "coach", "consultant", "cook", "coordinator",
    "designer", "developer", "director", "driver", "editor", "electrician", "engineer", "farmer", "gardener",
    "inspector", "intern", "lawyer", "lecturer", "librarian", "manager", "mechanic", "nurse", "operator",
    "paramedic", "pharmacist", "photographer", "planner", "plumber", "producer", "programmer", "researcher",
    "secretary", "supervisor", "surveyor", "teacher", "technician", "translator", "tutor", "volunteer", "welder",
    "writer",
]
LEGAL_SUFFIXES = ["ag", "co", "corp", "gmbh", "inc", "llc", "llp", "ltd", "nv", "oy", "plc", "sa", "srl"]
COMPANY_WORDS = LEGAL_SUFFIXES + [
    "academy", "agency", "airlines", "associates", "bakery", "bank", "brothers", "clinic", "council", "factory",
    "farms", "garage", "hospital", "hotel", "labs", "library", "metrics", "mills", "museum", "pharmacy", "press",
    "railways", "restaurant", "school", "shop", "sons", "store", "stores", "studio", "trust", "university", "works",
]
PLACES = [
    "accra", "ankara", "athens", "auckland", "belgrade", "bengaluru", "berlin", "bogota", "boston", "bristol",
    "brussels", "budapest", "cairo", "cape town", "cologne", "delhi", "edinburgh", "geneva", "glasgow", "hanoi",
    "helsinki", "hyderabad", "jakarta", "kyoto", "lagos", "leeds", "lima", "lyon", "manila", "montreal", "nairobi",
    "oslo", "ottawa", "perth", "porto", "prague", "pune", "quito", "riga", "santiago", "seattle", "seoul", "sofia",
    "tallinn", "toronto", "tunis", "turin", "utrecht", "vilnius", "york",
]

# verb -> (past form, claim level): who leads, who owns, who does, who supports
VERBS = {
    "chair": ("Chaired", "lead"), "direct": ("Directed", "lead"), "head": ("Headed", "lead"), "lead": ("Led", "lead"),
    "manage": ("Managed", "lead"), "train": ("Trained", "lead"),
    "found": ("Founded", "own"), "own": ("Owned", "own"), "run": ("Ran", "own"), "ship": ("Shipped", "own"),
    "administer": ("Administered", "do"), "assemble": ("Assembled", "do"), "audit": ("Audited", "do"),
    "build": ("Built", "do"), "calculate": ("Calculated", "do"), "compile": ("Compiled", "do"),
    "configure": ("Configured", "do"), "cut": ("Cut", "do"), "design": ("Designed", "do"), "draft": ("Drafted", "do"),
    "edit": ("Edited", "do"), "execute": ("Executed", "do"), "inspect": ("Inspected", "do"), "install": ("Installed", "do"),
    "lift": ("Lifted", "do"), "load": ("Loaded", "do"), "measure": ("Measured", "do"), "migrate": ("Migrated", "do"),
    "negotiate": ("Negotiated", "do"), "operate": ("Operated", "do"), "plan": ("Planned", "do"), "program": ("Programmed", "do"),
    "raise": ("Raised", "do"), "repair": ("Repaired", "do"), "rewrite": ("Rewrote", "do"), "sell": ("Sold", "do"),
    "teach": ("Taught", "do"), "test": ("Tested", "do"), "translate": ("Translated", "do"), "write": ("Wrote", "do"),
    "aid": ("Aided", "support"), "contribute": ("Contributed", "support"), "support": ("Supported", "support"),
}
LEADING_VERBS = sorted({w for v, (p, _) in VERBS.items() for w in (v, p.lower())})

# weak opener -> replacement verb and the claim level of the opener
WEAK_OPENERS = [
    ("responsible for", "Managed", "lead"), ("at the head of", "Headed", "lead"), ("tasked with", "Executed", "do"),
    ("saw to", "Managed", "do"), ("handled", "Managed", "do"), ("looked after", "Managed", "do"),
    ("did some", "Executed", "do"), ("helped with", "Supported", "support"), ("helped", "Supported", "support"),
    ("gave a hand with", "Supported", "support"), ("took part in", "Contributed to", "support"),
    ("was part of", "Contributed to", "support"),
]
CLAIM_LEVEL = {p.lower(): lvl for _, (p, lvl) in VERBS.items()} | {"contributed to": "support"}

# pattern -> replacement, applied in this order; a run of pronouns goes as one
OWNERS = "(?:I|[Mm]e|[Mm]y|[Mm]ine|[Mm]yself|[Ww]e|us|[Oo]ur|[Oo]urs)"
CLEANUP_RULES = [
    (rf"(^|[^A-Za-z0-9_])(?:{OWNERS}\s+)*{OWNERS}([^A-Za-z0-9_]|$)", "$1$2"),
    (r"(?i)(^|[^a-z0-9_])with the aim of([^a-z0-9_]|$)", "$1for$2"),
    (r"(?i)(^|[^a-z0-9_])for the purpose of([^a-z0-9_]|$)", "$1for$2"),
    (r"(?i)(^|[^a-z0-9_])in the event that([^a-z0-9_]|$)", "$1if$2"),
    (r"(?i)(^|[^a-z0-9_])in spite of the fact that([^a-z0-9_]|$)", "$1although$2"),
    (r"(?i)(^|[^a-z0-9_])at this point in time([^a-z0-9_]|$)", "$1now$2"),
    (r"(?i)(^|[^a-z0-9_])on a daily basis([^a-z0-9_]|$)", "$1daily$2"),
    (r"(?i)(^|[^a-z0-9_])a large number of([^a-z0-9_]|$)", "$1many$2"),
    (r"(?i)(^|[^a-z0-9_])(?:basically|actually|really|very)\s+", "$1"),
    (r"(?i)\s*,?\s*(?:and the like|and more|and others)\.?$", ""),
    (r"(?i)(^|[^a-z0-9_])seperate(d|s|ly)?([^a-z0-9_]|$)", "$1separate$2$3"),
    (r"(?i)(^|[^a-z0-9_])occured([^a-z0-9_]|$)", "$1occurred$2"),
    (r"(?i)(^|[^a-z0-9_])definately([^a-z0-9_]|$)", "$1definitely$2"),
    (r"(^|[^A-Za-z0-9_])([Aa])\s+([aeiou][A-Za-z0-9_])", "$1$2n $3"),
    (r"(^|[^A-Za-z0-9_])([Aa])n\s+([b-df-hj-np-tv-z0-9])", "$1$2 $3"),
    (r"\s+([,.;:])", "$1"),
    (r"\(\s+", "("),
    (r"\s+\)", ")"),
    (r"\(\)", ""),
    (r"[,;]\s*$", ""),
]


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """An inline table: Spark knows its size, so joins with it can be planned as broadcasts."""
    def lit(v: object) -> str:
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"

    cols = [c.strip().split(" ") for c in schema.split(",")]
    if not rows:
        return spark.createDataFrame([], schema)
    values = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    names = ", ".join(c for c, _ in cols)
    casts = ", ".join(f"cast({c} as {t}) as {c}" for c, t in cols)
    return spark.sql(f"select {casts} from values {values} as t({names})")


def alias_dim(spark: SparkSession, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """(alias, section_id, alias_order): order follows the dictionary."""
    rows, seen = [], set()
    for section, names in (aliases or SECTION_ALIASES).items():
        for name in [section, *names]:
            if name not in seen:
                seen.add(name)
                rows.append((name, section, len(rows)))
    return small_table(spark, rows, "alias string, section_id string, alias_order int")


def synonym_dim(spark: SparkSession, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    rows = [(t, s, i) for t, vs in (synonyms or SYNONYMS).items() for i, s in enumerate(vs)]
    return small_table(spark, rows, "term string, synonym string, ord int")


def substitution_dim(spark: SparkSession, pairs: dict[str, list[str]] | None = None) -> DataFrame:
    rows = [(s, t) for s, ts in (pairs or SUBSTITUTIONS).items() for t in ts]
    return small_table(spark, rows, "source string, target string")


def credential_dim(spark: SparkSession, creds: dict[str, str] | None = None) -> DataFrame:
    return small_table(spark, list((creds or CREDENTIALS).items()), "acronym string, full_name string")


def canonical_dim(spark: SparkSession) -> DataFrame:
    return small_table(
        spark, [(s, i) for i, s in enumerate(SECTION_ORDER)], "section_id string, canonical_pos int"
    )
