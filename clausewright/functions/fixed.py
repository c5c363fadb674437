"""Fixed values of the core operators.

Word lists, patterns and tables that results must follow to the letter, so
that requirements are found, repaired and sorted as users expect.  They are
plain values in their natural order; all logic is elsewhere.
"""

from __future__ import annotations

# Words of obligations, in single requirements.
MODAL = r"shall|shal[lij]|sba[lu]|must|required|requires?|is\s+to|are\s+to"
ACTORS = r"supplier|vendor|contractor|bidder|system integrator|si"
ACTIONS = r"provide|furnish|install|design|submit|include|comply|supply"
TECHNICAL_TERMS = r"relay|panel|protection|control|breaker|substation|transformer|bus|feeder|trip|interlock|scada|iec\s*61850|dnp3|modbus|ethernet|fiber|ct|vt|current transformer|voltage transformer|dc|battery|wiring|terminal|meter|alarm|synchroni[sz]|testing|fat|drawing|documentation|manual|training|commissioning|enclosure|nameplate|contact|input|output|frequency|temperature|voltage|current|accuracy|burden"
VALUES = r"\b\d+(?:\.\d+)?\s*(?:v|kv|a|ma|ka|hz|ms|mm|°c|ohm|k[oΩ]|%|bit/s)\b|\b(?:iec|ieee|ansi|en|iso)\s*[-:]?\s*\d+"
DANGLING = r"and|or|including|include|with|without|for|of|to|the|as|per|consisting of"
ACCEPTED = r"shall|must|required|requires?|provide|provided|supply|supplied|include|included|capable|rated"
MANDATORY = r"shall|must|required"

# Words that a page's signals count.
OBLIGATION = r"shall|must|required|requires?|supplier|vendor|contractor|provide|furnish|install|design|submit|include|comply|capable|rated"
TECHNICAL = r"relay|panel|protection|control|breaker|substation|transformer|bus|feeder|trip|interlock|scada|iec\s*61850|dnp3|modbus|ethernet|fiber|ct|vt|current transformer|voltage transformer|dc|battery|wiring|terminal|meter|alarm|synchroni[sz]|testing|fat"
TABLE_UNITS = r"v|kv|a|ka|hz|ms|mm|°c"

# Headings.
HEADING_WORDS = r"requirements?|scope|specifications?|qualification|eligibility|instructions?|price|payment|proposal|bid(?:der|ding)?|testing|drawings?|documentation|protection|control|communications?|panel|equipment"
ADMIN_HEADINGS = r"eligibility|qualification of bidders?|instructions? to bidders?|preparation and delivery of bids?|bid submission|joint venture|consortium|price schedule|payment terms?|bid security|proposal forms?|evaluation of bids?"
NO_HEADING = r"shall|must|required|provide|furnish|install|design|submit|comply"
TOP_LEVEL = r"^\s*(?:[A-Z]-\d+|section\s+[A-Z0-9]+)\b"
NUMBERED_HEADING = r"^\s*(?:(?:section|article|part)\s+)?(?:\d+(?:[.\-]\d+){0,6}[.]?|[A-Z][-\.]\d+(?:\.\d+)*[.]?)\s+\S.{2,150}$"
NUMBERED_LINE = r"^\s*(?:\d+(?:[.-]\d+){1,6}|[A-Z]\.[0-9.]+)\s+(.{3,100})$"
BARE_NUMBER = r"^(?:[A-Z][-\.]?)?\d+(?:[.\-]\d+)*[.]?$"

# Words and units that evidence is compared by.
STOPWORDS = "a an and are as at be by each for from in is it of on or shall should that the this to with".split()
UNITS = r"kv|v|ka|ma|a|hz|ms|mm|°c|ohm|%|mbps"
STANDARDS = r"iec\s*\d+|ieee\s*[a-z0-9.\-]+|ansi\s*[a-z0-9.\-]+|dnp3|modbus|irig-b|ptp|ntp"
PROTECTED = r"\d+(?:\.\d+)?|iec|ieee|ansi|iso|dnp3|modbus"

# Categories with their words, first match wins.
CATEGORIES = [
    ("Testing", r"test|testing|fat|commissioning"),
    ("Documentation", r"document|drawing|manual|report|submit"),
    ("Communications", r"scada|iec\s*61850|dnp3|modbus|ethernet|fiber|communication"),
    ("Panel Construction", r"panel|enclosure|wiring|terminal|nameplate"),
    ("Protection and Control", r"relay|protection|trip|breaker|interlock|bus|feeder"),
    ("Electrical Interface", r"ct|vt|current|voltage|dc|battery|burden|contact|input|output"),
]

# Readings of scanned words and their repairs, in order; the flag tells whether case matters.
REPAIRS = [
    (r"\bsba[lu]\b", "shall", False),
    (r"\bshal[ilj]\b", "shall", False),
    (r"\b[lJ]EDs?\b", "IED", True),
    (r"\bJEC(?=\s*61850)", "IEC", True),
    (r"[!l]EC(?=\s*61850)", "IEC", False),
    (r"\bmeg(?:ing|lng)\b", "merging", False),
    (r"\bmcging\b", "merging", False),
    (r"\bench\b", "each", False),
    (r"\bMd\b", "and", True),
    (r"\bHM!", "HMI", True),
    (r"\bdalll\b", "data", False),
    (r"\bnil\b", "all", False),
    (r"\bran\b", "run", False),
    (r"\bsubslntion\b", "substation", False),
    (r"\be!?eclrooic\w*\b", "electronic file", False),
    (r"\bsy\W*i?tcm\b", "system", False),
    (r"\bconfonn\b", "conform", False),
    (r"\bsl(?:t|1)all\b", "shall", False),
    (r"\bsystc~", "system", False),
    (r"\bhyEGAT\b", "by EGAT", False),
    (r"\bstandard lo coordinate\b", "standard to coordinate", False),
    (r"\blcle protection\b", "teleprotection", False),
    (r"\bniong\b", "along", False),
    (r"\bcxisliog\b", "existing", False),
    (r"\bhardcopyand\b", "hardcopy and", False),
    (r"\bdigiL['’]ll\b", "digital", False),
    (r"\bIIMI\b", "HMI", True),
    (r"\b(SSD|SCD|ICD|CID)\s+mes\b", "$1 files", False),
    (r"\bprogrammable:\s+", "programmable ", False),
]
GARBLED = r"(?:[A-Za-z][!;][A-Za-z]|\b(?:ench|JED|Md|dalll|nil|JEC|subslntion|eclrooic|sy\W*tcm|meging|mcging|swithcing|confonn)\b)"
IDENTITY_REPAIRS = [
    (r"\bsba[lu]\b", "shall"),
    (r"\bshal[ilj]\b", "shall"),
    (r"\bjeds?\b", "ied"),
    (r"[!l]ec(?=\s*61850)", "iec"),
    (r"\bmeg(?:ing|lng)\b", "merging"),
]
