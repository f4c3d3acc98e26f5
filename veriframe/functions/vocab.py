"""Word lists, phrases and patterns that decide results. Each list is in its natural order."""

#: Parts of a line that mark it as noise (marketing, registry codes, form text).
NOISE = (
    "batch no", "lot no", "qr code", "scan here", "www.", "http", "bottled by", "bottled at", "bottled in bond", "product of",
    "enjoy responsibly", "distilled in", "est.", "est ", "cocktail recipes", "warehouse", "dsp-", "bw-", "tpwbh-", "registry",
    "plant no", "ttb f 5100", "serial number", "rep. id", "department of the treasury", "alcohol and tobacco tax", "form bleed",
    "not for resale", "net wt",
)
CLASS_NOUNS = ("whiskey", "bourbon", "whisky", "spirit", "vodka", "gin", "rum", "tequila", "wine")
CLASS_PREFIXES = ("kentucky", "straight", "blended", "single", "small batch", "indiana", "tennessee", "sour mash", "bottled in bond")
GEO_WORDS = ("kentucky", "indiana", "tennessee")
DISTILLERY = ("distilling", "distillery", "distillers", " co.", " co ", " company", " llc", " inc")
WARNING_FRAGMENTS = (
    "surgeon general", "birth defects", "health problem", "impairs your ability", "not drink alcoholic", "during pregnancy",
    "risk of birth", "women should not", "according to the", "ability to drive", "operate machinery",
)
WARNING_END = ("health problems", "health problem", "may cause health")
WARNING_MARKERS = ("(1)", "(2)")
WARNING_PHRASES = ("surgeon general", "pregnancy", "birth defects", "impairs your ability", "drive a car", "may cause health problems")
WARNING_ALIASES = {
    "drive a car": ("drive car", "drive a car or"),
    "may cause health problems": ("cause health problems", "may cause health problem"),
}
READABILITY = (
    ("government warning", 0.30), ("surgeon general", 0.12), ("bourbon", 0.08), ("whiskey", 0.08), ("distillery", 0.08),
    ("straight", 0.05), ("kentucky", 0.05), ("proof", 0.05), ("alc", 0.04), ("health problems", 0.08),
)
FIELDS = ("brand_name", "class_type", "alcohol_content", "net_contents", "government_warning")
BIN_ALIASES = {
    "brand": "brand_name", "brandname": "brand_name", "class": "class_type", "classtype": "class_type", "class_type": "class_type",
    "alcohol": "alcohol_content", "alcoholcontent": "alcohol_content", "abv": "alcohol_content", "net": "net_contents",
    "netcontents": "net_contents", "volume": "net_contents", "warning": "government_warning",
    "governmentwarning": "government_warning", "gov_warning": "government_warning",
}

#: Patterns that Java and RE2 read alike.
ABV_PERCENT_ALC = r"(?i)(\d+(?:\.\d+)?)\s*%\s*alc"
ABV_PROOF = r"(?i)(\d+(?:\.\d+)?)\s*proof"
ABV_PERCENT = r"(\d+(?:\.\d+)?)\s*%"
MILLILITRES = r"(?i)(\d+(?:\.\d+)?)\s*ml\b"
BATCH_LOT = r"\bbatch\b.*(?:\blot\b|\d{4}-\d|\d{3,})"
BATCH, LOT = r"\bbatch\b", r"\blot\s+\d"
HEADER = r"GOVERNMENT\s+WARNING"
HEADER_COLON = r"GOVERNMENT\s+WARNING\s*:"
WARNING_BLOCK = r"(?is)(GOVERNMENT\s+WARNING\s*:.*?health problems\.?)"
ANNOTATION = r"(?i)\s*\[script OCR read:\s*.+\]\s*$"

#: White space of any kind, with Java's flag U; line ends of a text.
SPACE = r"[\s\x1C-\x1F]"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"

#: Known misreadings and what they are read as, in the order in which they are applied.
REPAIRED_WORDS = (("Alc.NVol:", "Alc./Vol."), ("Alc.NVol.", "Alc./Vol."))
REPAIRED_PATTERNS = (
    (r"(?i)Alc\.?\s*[/\\]?\s*Vol\.?", "Alc./Vol."), (r"(?i)Alc\s+NVol\.?", "Alc./Vol."),
    (r"(?i)AlcNVol:?", "Alc./Vol."), (r"(?i)problems_+", "problems."),
)
#: The same for the first so many places only.
REPAIRED_AT_MOST = ((r"\(27\s+Consumption", "(2) Consumption", 2),)
REPAIRED_WARNING = (
    (r"(?i)\bdrive\s+car\b", "drive a car"), (r"(?i),\s*and\s+cause\s+health", ", and may cause health"),
    (r"(?i)\bhealth\s+may\s+problems\b", "may cause health problems"), (r"(?i)\bmay\s+problems\b", "may cause health problems"),
)
#: What a whole warning holds, and what one must hold to count.
WARNING_COMPLETE = ("government warning:", "surgeon general", "pregnancy", "birth defects", "impairs your ability", "health", "problem")
WARNING_OK = ("government warning", "surgeon general", "health problem")
#: The remark beside a brand that is shown as the claim, before and after what was read.
REMARK = ("  [script OCR read: ", "]")

#: Tolerances and thresholds.
ABV_TOLERANCE, ML_TOLERANCE = 0.25, 0.01
BRAND_PASS, BRAND_REVIEW = 0.82, 0.68
CLASS_REVIEW, WARNING_REVIEW = 0.88, 0.85
PREVIEW = 500
GAP_FULL, GAP_REGION = 28.0, 40.0

#: Fixed patterns: what stands behind a warning's end in its last line, and the words that a class may go on from the line before.
BEHIND_WARNING = r"(?i)health problems\.?\s*(.+)$"
SMALL_BATCH = r"(?i)\bsmall\s+batch\b"

#: Small turns in degrees that are tried, in this order, on a text that wasn't turned, and on one that was.
SKEWS = (-15, -12, -9, -6, -3, 3, 6, 9, 12, 15)
SKEWS_TURNED = (-6, -3, 3, 6)


def any_of(words) -> str:
    """A pattern that finds any of the words as a part of the text."""
    special = set(".^$*+?()[]{}|\\")
    return "|".join("".join(f"\\{c}" if c in special else c for c in w) for w in words)
