"""Values that have to be the same everywhere for results to be right."""

# --- fixed values -----------------------------------------------------------

SOURCES = ("LinkedIn", "Indeed", "RemoteOK", "Wuzzuf", "Glassdoor")
ALL_SOURCES = "all"

WORK_MODES = (
    ("remote", "Remote"),
    ("on-site", "On-site"),
    ("hybrid", "Hybrid"),
)

JOB_TYPES = (
    ("full-time", "Full-time"),
    ("part-time", "Part-time"),
    ("freelance", "Freelance"),
    ("contract", "Contract"),
)

# band number, code, label, printed years, lowest year, first year of the next band
SENIORITY_BANDS = (
    (0, "entry", "Entry Level", "0–2 years", 0, 2),
    (1, "mid", "Mid Level", "2–5 years", 2, 5),
    (2, "senior", "Senior Level", "5–10 years", 5, 10),
    (3, "lead", "Lead / Staff", "10+ years", 10, None),
)

CURRENCIES = (
    ("USD", "USD — US Dollar ($)"),
    ("EUR", "EUR — Euro (€)"),
    ("GBP", "GBP — British Pound (£)"),
    ("EGP", "EGP — Egyptian Pound (E£)"),
)

CURRENCY_SIGNS = (("E£", "EGP"), ("$", "USD"), ("€", "EUR"), ("£", "GBP"))

DEFAULT_SENIORITY = "mid"
DEFAULT_CURRENCY = "USD"

SCORE_HIGH = 90
SCORE_MEDIUM = 75

MISSING_FIELDS_ERROR = "Missing required fields"
FAILED_ERROR = "Failed to process onboarding data"
SUCCESS_MESSAGE = "Onboarding completed. Job search initiated."

TOP_MATCHES = 20

# plan, results shown, searches per calendar month (None: no limit), sources
PLANS = (
    ("Free", 10, 3, ("LinkedIn", "Indeed")),
    ("Pro", 50, None, SOURCES),
    ("Teams", 50, None, SOURCES),
)

# entity, character, in the order in which they are replaced ("&amp;" last)
HTML_ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", " "),
    ("&amp;", "&"),
)
