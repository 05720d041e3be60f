"""Court codes, spoken names and the directory of courts."""

# Court code -> High Court name.
HIGH_COURTS = {
    "9_13": "Allahabad High Court",
    "27_1": "Bombay High Court",
    "19_16": "Calcutta High Court",
    "18_6": "Gauhati High Court",
    "36_29": "High Court for State of Telangana",
    "28_2": "High Court of Andhra Pradesh",
    "22_18": "High Court of Chhattisgarh",
    "7_26": "High Court of Delhi",
    "24_17": "High Court of Gujarat",
    "2_5": "High Court of Himachal Pradesh",
    "1_12": "High Court of Jammu and Kashmir",
    "20_7": "High Court of Jharkhand",
    "29_3": "High Court of Karnataka",
    "32_4": "High Court of Kerala",
    "23_23": "High Court of Madhya Pradesh",
    "14_25": "High Court of Manipur",
    "17_21": "High Court of Meghalaya",
    "21_11": "High Court of Orissa",
    "3_22": "High Court of Punjab and Haryana",
    "8_9": "High Court of Rajasthan",
    "11_24": "High Court of Sikkim",
    "16_20": "High Court of Tripura",
    "5_15": "High Court of Uttarakhand",
    "33_10": "Madras High Court",
    "10_8": "Patna High Court",
}

SUPREME_COURT = "SC"
SUPREME_COURT_LABEL = "Supreme Court of India"

# Spoken name -> court code. Order matters for containment.
COURT_ALIASES = {
    "supreme court": "SC",
    "supreme court of india": "SC",
    "sc": "SC",
    "sci": "SC",
    "bombay": "27_1",
    "bombay high court": "27_1",
    "bombay hc": "27_1",
    "mumbai": "27_1",
    "delhi": "7_26",
    "delhi high court": "7_26",
    "madras": "33_10",
    "chennai": "33_10",
    "calcutta": "19_16",
    "kolkata": "19_16",
    "karnataka": "29_3",
    "bangalore": "29_3",
    "bengaluru": "29_3",
    "kerala": "32_4",
    "allahabad": "9_13",
    "gujarat": "24_17",
    "madhya pradesh": "23_23",
    "punjab and haryana": "3_22",
    "rajasthan": "8_9",
    "telangana": "36_29",
    "andhra pradesh": "28_2",
    "patna": "10_8",
    "orissa": "21_11",
    "odisha": "21_11",
    "jharkhand": "20_7",
    "chhattisgarh": "22_18",
    "uttarakhand": "5_15",
    "himachal pradesh": "2_5",
    "jammu and kashmir": "1_12",
    "gauhati": "18_6",
    "guwahati": "18_6",
    "manipur": "14_25",
    "meghalaya": "17_21",
    "sikkim": "11_24",
    "tripura": "16_20",
}

# Where the public dataset serves its PDFs.
SC_ENDPOINT = "https://indian-supreme-court-judgments.s3.ap-south-1.amazonaws.com"
HC_ENDPOINT = "https://indian-high-court-judgments.s3.ap-south-1.amazonaws.com"

# Fixed values: (type, name, seat) of the courts the directory lists.
COURT_DIRECTORY = [
    ("supreme_court", "Supreme Court of India", "New Delhi"),
    ("high_court", "Bombay High Court (Principal Seat)", "Mumbai"),
    ("high_court", "Bombay High Court, Nagpur Bench", "Nagpur"),
    ("high_court", "Bombay High Court, Aurangabad Bench", "Chhatrapati Sambhajinagar (Aurangabad)"),
    ("high_court", "Bombay High Court at Goa", "Panaji"),
    ("district_court", "City Civil and Sessions Court, Mumbai", "Dindoshi and Fort, Mumbai"),
    ("district_court", "District and Sessions Court, Pune", "Pune"),
    ("district_court", "District and Sessions Court, Thane", "Thane"),
    ("district_court", "District and Sessions Court, Nagpur", "Nagpur"),
    ("district_court", "Small Causes Court, Mumbai", "Mumbai"),
    ("tribunal", "National Company Law Tribunal, Mumbai Bench", "Mumbai"),
    ("tribunal", "State Consumer Disputes Redressal Commission, Maharashtra", "Mumbai"),
    ("tribunal", "Maharashtra Real Estate Regulatory Authority (MahaRERA)", "Mumbai"),
    ("tribunal", "Maharashtra Administrative Tribunal", "Mumbai, with benches at Nagpur and Aurangabad"),
    ("tribunal", "Debts Recovery Tribunal, Mumbai", "Mumbai"),
    ("tribunal", "Income Tax Appellate Tribunal, Mumbai Bench", "Mumbai"),
]

# Decision list for the forum, first branch with a keyword wins.
# (keywords, forum, legal basis)
FORUM_RULES = [
    (
        ["cheque", "138"],
        "Judicial Magistrate First Class / Metropolitan Magistrate",
        "section 142, Negotiable Instruments Act, 1881",
    ),
    (
        ["consumer", "deficien", "defective"],
        "District / State / National Consumer Disputes Redressal Commission",
        "sections 34, 47 and 58, Consumer Protection Act, 2019",
    ),
    (
        ["arbitrat"],
        "The arbitral tribunal, supervised by the court at the seat",
        "Arbitration and Conciliation Act, 1996",
    ),
    (
        ["fundamental right", "writ", "government"],
        "Bombay High Court under Article 226, or the Supreme Court under Article 32",
        "Articles 226 and 32, Constitution of India",
    ),
    (
        ["tenan", "rent", "licence"],
        "Small Causes Court, or the Competent Authority under the Maharashtra Rent Control Act, 1999",
        "Maharashtra Rent Control Act, 1999",
    ),
    (
        ["matrimon", "divorce", "maintenance"],
        "Family Court",
        "Family Courts Act, 1984",
    ),
    (
        ["insolven", "company", "winding up"],
        "National Company Law Tribunal",
        "Companies Act, 2013 and Insolvency and Bankruptcy Code, 2016",
    ),
]
FORUM_DEFAULT = (
    "Civil court of appropriate pecuniary jurisdiction",
    "sections 15 to 20, Code of Civil Procedure, 1908",
)
