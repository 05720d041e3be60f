"""How Indian authorities are written: reporters, statutes and patterns."""

# Reporter spelling (lower case, no dots) -> canonical form.
REPORTERS = {
    "scc": "SCC",
    "air": "AIR",
    "scr": "SCR",
    "sccrimr": "SCC (Cri)",
    "scc online": "SCC OnLine",
    "scconline": "SCC OnLine",
    "bomcr": "Bom CR",
    "bom cr": "Bom CR",
    "allmr": "ALL MR",
    "all mr": "ALL MR",
    "mhlj": "Mh LJ",
    "mh lj": "Mh LJ",
    "bomlr": "Bom LR",
    "delhi law times": "DLT",
    "dlt": "DLT",
    "klj": "KLJ",
    "crilj": "Cri LJ",
    "cri lj": "Cri LJ",
    "itr": "ITR",
    "comp cas": "Comp Cas",
    "cpj": "CPJ",
    "insc": "INSC",
    "supreme": "SCC",
}

# Statute abbreviation (lower case, no dots) -> full title.
STATUTE_ABBREVIATIONS = {
    "ipc": "Indian Penal Code, 1860",
    "bns": "Bharatiya Nyaya Sanhita, 2023",
    "crpc": "Code of Criminal Procedure, 1973",
    "bnss": "Bharatiya Nagarik Suraksha Sanhita, 2023",
    "evidence act": "Indian Evidence Act, 1872",
    "bsa": "Bharatiya Sakshya Adhiniyam, 2023",
    "cpc": "Code of Civil Procedure, 1908",
    "ni act": "Negotiable Instruments Act, 1881",
    "niact": "Negotiable Instruments Act, 1881",
    "ica": "Indian Contract Act, 1872",
    "contract act": "Indian Contract Act, 1872",
    "tpa": "Transfer of Property Act, 1882",
    "tp act": "Transfer of Property Act, 1882",
    "sra": "Specific Relief Act, 1963",
    "it act": "Information Technology Act, 2000",
    "arbitration act": "Arbitration and Conciliation Act, 1996",
    "a&c act": "Arbitration and Conciliation Act, 1996",
    "cpa": "Consumer Protection Act, 2019",
    "limitation act": "Limitation Act, 1963",
    "companies act": "Companies Act, 2013",
    "ibc": "Insolvency and Bankruptcy Code, 2016",
    "rera": "Real Estate (Regulation and Development) Act, 2016",
    "hma": "Hindu Marriage Act, 1955",
    "dv act": "Protection of Women from Domestic Violence Act, 2005",
    "mv act": "Motor Vehicles Act, 1988",
    "posh act": "Sexual Harassment of Women at Workplace (Prevention, Prohibition and Redressal) Act, 2013",
}

# The nine citation patterns, in the order they are applied.
# Groups are positional; each comment names them. A look at the first letter comes
# before a word boundary, which is dearer to test and is tested at few places so.
BRACKETED_YEAR = (  # year, volume, reporter, page
    r"[\(\[](1[89]\d{2}|20\d{2})[\)\]]\s*(\d{1,3})?\s*"
    r"([A-Z][A-Za-z.\s()]{1,20}?)\s+(\d{1,5})\b"
)
YEAR_THEN_VOLUME = (  # year, volume, reporter, page
    r"(?=[12])\b(1[89]\d{2}|20\d{2})\s*\((\d{1,3})\)\s*([A-Z][A-Za-z.\s]{1,15}?)\s+(\d{1,5})\b"
)
YEAR_THEN_REPORTER = (  # year, reporter, court, page
    r"(?=[12])\b(1[89]\d{2}|20\d{2})\s+"
    r"(SCC\s+OnLine|SCC|AIR|INSC|SCR|Cri\s?LJ|Mh\s?LJ|ALL\s?MR|DLT|ITR)\s+"
    r"([A-Z][A-Za-z]{0,8})?\s*(\d{1,5})\b"
)
REPORTER_THEN_YEAR = (  # reporter, year, court, page
    r"(?=[ASICMD])\b(AIR|SCC OnLine|SCC|SCR|INSC|Cri\s?LJ|Mh\s?LJ|ALL\s?MR|DLT|ITR)\s+"
    r"(1[89]\d{2}|20\d{2})\s+([A-Z][A-Za-z]{0,8})?\s*(\d{1,5})\b"
)
NEUTRAL_COLON = (  # year, court, number, suffix
    r"(?=2)\b(20\d{2}):([A-Z]{2,8}(?:-[A-Z]{2,4})?):(\d{1,7})(?::(\d{1,4}))?\b"
)
NEUTRAL_COMPACT = r"(?i)(?=2)\b(20\d{2})\s*(INSC)\s*(\d{1,6})\b"  # year, court, number
SECTION_OF_ACT = (  # section, statute
    r"(?=[Ss])\b(?:[Ss]ec(?:tion|\.)?|[Ss]\.)\s*(\d{1,4}[A-Za-z]{0,3}"
    r"(?:\s*\(\s*\w{1,3}\s*\))*)\s*"
    r"(?:of\s+the\s+|of\s+|,\s*|\s+)?"
    r"((?:the\s+)?[A-Z][A-Za-z&.,'()\- ]{2,80}?"
    r"(?:Act|Code|Sanhita|Adhiniyam|Constitution)"
    r"(?:\s*,?\s*(?:1[89]\d{2}|20\d{2}))?|[A-Z][A-Za-z.&]{1,8})\b"
)
ORDER_AND_RULE = (  # order, rule, statute
    r"(?=O)\bOrder\s+([IVXLC]{1,6}|\d{1,3})\s*,?\s*Rule\s+(\d{1,3}[A-Za-z]?)\s*"
    r"(?:of\s+the\s+)?(CPC|Code of Civil Procedure[^.,;]{0,12})?"
)
ARTICLE = (  # article
    r"(?=[Aa])\b(?:[Aa]rt(?:icle|\.)?)\s*(\d{1,3}[A-Za-z]{0,2}(?:\s*\(\s*\w{1,3}\s*\))*)"
)
# A name never starts within a word, as its start would have been tried before; words and blanks share no
# character, so neither is given back.
CASE_NAME = (  # appellant, respondent
    r"(?i)(?<![A-Z])((?:[A-Z][\w&.'\-]*+\s++){0,6}[A-Z][\w&.'\-]*+)\s++"
    r"(?:v\.?|vs\.?|versus)\s+"
    r"((?:[A-Z][\w&.'\-]*+\s++){0,6}[A-Z][\w&.'\-]*+)"
)

# How far back a case name is looked for, and the widest gap.
CASE_NAME_WINDOW = 160
CASE_NAME_GAP = 30

# Narrative words that may precede a case name.
CASE_NAME_LEAD_INS = [
    "in", "see", "cf", "but", "and", "the", "per", "also", "citing", "following",
    "followed", "applied", "held", "whereas", "compare", "relying", "on", "to", "of",
]

# Words too common to identify a party.
PARTY_STOP_WORDS = [
    "the", "of", "and", "ors", "anr", "state", "union", "india", "ltd", "limited",
    "pvt", "private", "company", "co", "through", "another", "others", "dec", "no", "nos",
]

# Confidence of each verdict.
VERDICT_CONFIDENCE = {
    "VERIFIED": 1.0,
    "NOT_FOUND": 0.2,
    "AMBIGUOUS": 0.5,
    "UNCHECKED": 0.0,
}
