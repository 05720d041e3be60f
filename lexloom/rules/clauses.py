"""Contract clause types and risk rules."""

# Fixed values: (key, label, normally expected, patterns).
CLAUSE_TYPES = [
    ("parties", "Parties and recitals", True,
     [r"\bbetween\b.*\band\b", r"\bwhereas\b", r"\brecitals?\b"]),
    ("definitions", "Definitions", False,
     [r"\bdefinitions?\b", r"shall mean", r"unless the context"]),
    ("term", "Term and duration", True,
     [r"\bterm of this agreement\b", r"\bcommencement date\b",
      r"\bshall remain in (force|effect)\b", r"\brenewal\b"]),
    ("payment", "Payment and consideration", True,
     [r"\bconsideration\b", r"\bpayment terms?\b", r"\binvoice\b",
      r"\bfees? payable\b", r"\binterest on delayed\b"]),
    ("obligations", "Obligations and scope", True,
     [r"\bscope of (work|services)\b", r"\bdeliverables?\b", r"\bobligations of\b"]),
    ("representations", "Representations and warranties", False,
     [r"\brepresents? and warrants?\b", r"\bwarrant(y|ies)\b"]),
    ("indemnity", "Indemnity", False,
     [r"\bindemnif(y|ies|ication)\b", r"\bhold harmless\b", r"\bdefend and hold\b"]),
    ("liability", "Limitation of liability", False,
     [r"\blimitation of liability\b", r"\baggregate liability\b",
      r"\bconsequential (loss|damages?)\b", r"\bin no event shall\b"]),
    ("termination", "Termination", True,
     [r"\btermination\b", r"\bterminate this agreement\b", r"\bnotice period\b",
      r"\bmaterial breach\b"]),
    ("confidentiality", "Confidentiality", False,
     [r"\bconfidential(ity)? information\b", r"\bnon.?disclosure\b", r"\bshall not disclose\b"]),
    ("non_compete", "Non-compete and restraint", False,
     [r"\bnon.?compet(e|ition)\b", r"\bshall not.{0,40}(compete|engage in any business)\b",
      r"\brestrictive covenant\b", r"\bnon.?solicit(ation)?\b"]),
    ("ip", "Intellectual property", False,
     [r"\bintellectual property\b", r"\bcopyright\b", r"\bwork for hire\b",
      r"\bassigns? all right(s)?, title\b"]),
    ("force_majeure", "Force majeure", False,
     [r"\bforce majeure\b", r"\bact of god\b", r"\bbeyond the reasonable control\b"]),
    ("dispute_resolution", "Dispute resolution", True,
     [r"\bdispute resolution\b", r"\bmediation\b", r"\bnegotiation in good faith\b"]),
    ("arbitration", "Arbitration", False,
     [r"\barbitrat(ion|or)\b", r"\barbitral tribunal\b", r"\bArbitration and Conciliation Act\b"]),
    ("governing_law", "Governing law", True,
     [r"\bgoverning law\b", r"\bgoverned by the laws? of\b", r"\bconstrued in accordance with\b"]),
    ("jurisdiction", "Jurisdiction", True,
     [r"\bexclusive jurisdiction\b", r"\bcourts? at [A-Z]\w+ shall\b",
      r"\bsubject to the jurisdiction\b"]),
    ("notices", "Notices", True,
     [r"\bnotices? under this agreement\b", r"\bshall be sent to\b", r"\bregistered post\b",
      r"\backnowledgement due\b"]),
    ("assignment", "Assignment", False,
     [r"\bassign(ment)? of this agreement\b", r"\bshall not assign\b"]),
    ("entire_agreement", "Entire agreement", False,
     [r"\bentire agreement\b", r"\bsupersedes all (prior|previous)\b"]),
    ("severability", "Severability", False,
     [r"\bseverab(le|ility)\b", r"\bremain in full force and effect\b"]),
    ("stamp_registration", "Stamp duty and registration", False,
     [r"\bstamp duty\b", r"\bregistration charges?\b", r"\bstamped\b"]),
]

# Hits kept per clause type, and the excerpt around a hit.
CLAUSE_MAX_HITS = 5
CLAUSE_BEFORE, CLAUSE_AFTER = 100, 200
RISK_BEFORE, RISK_AFTER = 80, 160

# Order of severities.
SEVERITY_ORDER = {"high": 0, "medium": 1, "low": 2, "info": 3}

# Fixed values: (key, severity, title, pattern, flag when absent, gate, authority).
RISK_RULES = [
    ("post_termination_non_compete", "high", "Post-termination non-compete",
     r"(?:after|following|upon|post)[^.]{0,60}(?:termination|expiry|"
     r"cessation)[^.]{0,200}?(?:not\s+(?:directly\s+or\s+indirectly\s+)?"
     r"(?:compete|engage|carry on|be employed)|non.?compet)",
     False, None, "section 27, Indian Contract Act, 1872"),
    ("non_compete_generic", "medium", "Restraint of trade clause",
     r"\bnon.?compet(?:e|ition)\b|\brestraint of trade\b",
     False, None, "section 27, Indian Contract Act, 1872"),
    ("uncapped_liability", "high", "No cap on liability",
     r"\b(?:aggregate|total|maximum)\s+liability\b|\bliability\s+(?:shall|"
     r"is)\s+(?:be\s+)?(?:limited|capped)\b",
     True, r"\bindemnif|liabilit", None),
    ("unlimited_indemnity", "high", "Indemnity without limit or carve-out",
     r"\bindemnif(?:y|ies|ication)\b[^.]{0,300}\ball\b[^.]{0,120}"
     r"\b(?:claims?|losses|damages?|liabilit)",
     False, None, None),
    ("one_sided_indemnity", "medium", "Indemnity may run one way only",
     r"\bmutual(?:ly)?\s+indemnif|\beach\s+party\s+shall\s+indemnif",
     True, r"\bindemnif", None),
    ("auto_renewal", "medium", "Automatic renewal",
     r"\bautomatic(?:ally)?\s+renew|\brenewed?\s+for\s+(?:successive|"
     r"further)\b|\bunless\s+(?:either\s+)?party\s+gives?\s+notice[^.]{0,80}"
     r"\brenew",
     False, None, None),
    ("arbitration_seat_unclear", "high", "Arbitration clause without a clear seat",
     r"\bseat\s+of\s+(?:the\s+)?arbitration\b",
     True, r"\barbitrat", "Arbitration and Conciliation Act, 1996"),
    ("arbitration_no_appointment", "medium", "Arbitration clause without an appointment mechanism",
     r"\bsole\s+arbitrator\b|\bappoint(?:ed|ment)\b[^.]{0,80}\barbitrat",
     True, r"\barbitrat", "section 11, Arbitration and Conciliation Act, 1996"),
    ("stamping_not_addressed", "medium", "Stamp duty not addressed",
     r"\bstamp(?:ed|\s+duty)\b",
     True, r"\bagreement\b", "Indian Stamp Act, 1899 and the Maharashtra Stamp Act, 1958"),
    ("exclusive_jurisdiction", "low", "Exclusive jurisdiction clause",
     r"\bexclusive\s+jurisdiction\b|\bcourts?\s+at\s+\w+\s+(?:alone\s+)?"
     r"shall\s+have\s+jurisdiction\b",
     False, None, "section 28, Indian Contract Act, 1872"),
    ("no_governing_law", "medium", "No governing law clause",
     r"\bgovern(?:ing|ed)\s+(?:by\s+)?(?:the\s+)?laws?\b",
     True, r"\bagreement\b", None),
    ("no_termination_clause", "medium", "No termination clause",
     r"\bterminat",
     True, r"\bagreement\b", None),
    ("no_notice_clause", "low", "No notices clause",
     r"\bnotices?\b[^.]{0,100}\b(?:address|sent|served|delivered)\b",
     True, r"\bagreement\b", None),
    ("penalty_language", "low", "Penalty framed as liquidated damages",
     r"\bliquidated damages?\b|\bpenalty\s+of\s+(?:Rs|INR|₹)",
     False, None, "section 74, Indian Contract Act, 1872"),
    ("unilateral_variation", "medium", "Unilateral variation right",
     r"\b(?:may|reserves? the right to)\s+(?:at any time\s+)?"
     r"(?:amend|modify|vary|change)\s+(?:these|the|this)\s+"
     r"(?:terms|agreement|conditions)\b[^.]{0,80}"
     r"(?:without (?:prior )?notice|at its (?:sole )?discretion)",
     False, None, None),
]
ABSENT_EXCERPT = "(not present in the document)"
