"""Patterns and word lists of the card layouts, in Java form; RE2 forms where an engine lacks look-around.

Everything in this module is a fixed value: results depend on these strings exactly.
"""

# ---- numbers
AADHAAR = r"(?<!\d)(?<!\d[ \t])\d{4}\s?\d{4}\s?\d{4}(?![ \t]?\d)"
AADHAAR_RE2 = r"(?:^|[^\d \t]|(?:^|[^\d])[ \t])(\d{4}\s?\d{4}\s?\d{4})(?:$|[^\d \t]|[ \t](?:$|[^\d]))"
MASKED_AADHAAR = r"(?i)(?<![A-Z0-9])[X×*•#]{4}[ \t]?[X×*•#]{4}[ \t]?(\d{4})(?![ \t]?\d)"
MASK_PREFIX = r"(?i)^\W*[X×*•#]{4}\s?[X×*•#]{4}\W*$"
VID = r"(?<!\d)\d{4}\s?\d{4}\s?\d{4}\s?\d{4}(?!\d)"
VID_LABEL = r"\bVID\s*[:：]\s*\d{4}"
PAN = r"[A-Z]{5}[0-9]{4}[A-Z]"
EPIC = r"(?<![A-Z0-9])[A-Z]{3}\d{7}(?![A-Z0-9])"
PASSPORT = r"[A-Z]{1,2}\d{6,7}"
DL_STATES = "AN|AP|AR|AS|BR|CG|CH|DD|DL|DN|GA|GJ|HP|HR|JH|JK|KA|KL|LA|LD|MH|ML|MN|MP|MZ|NL|OD|OR|PB|PY|RJ|SK|TN|TR|TS|UA|UK|UP|WB"
DL_MODERN = r"[A-Z]{2}[\s-]?\d{2}[\s-]?\d{11}"
DL_LEGACY = rf"(?:DLF)?(?:{DL_STATES})[\s-]?\d{{12}}(?!\d)"
VEHICLE = r"[A-Z]{2}[\s-]?\d{1,2}[\s-]?[A-Z]{1,2}[\s-]?\d{3,5}"
ID_BY_TYPE = {
    "PAN": PAN,
    "AADHAAR": AADHAAR,
    "VOTER_ID": EPIC,
    "PASSPORT": PASSPORT,
    "DRIVING_LICENSE": f"{DL_MODERN}|{DL_LEGACY}|{VEHICLE}",
}

# ---- document types: order of ties, names, field of the number, request keys
DOC_TYPES = ("PAN", "AADHAAR", "VOTER_ID", "PASSPORT", "DRIVING_LICENSE")
DOC_TYPE_ROWS = (
    ("aadhaar", "AADHAAR", "Aadhaar Card", "aadhaar_number"),
    ("pan", "PAN", "PAN Card", "pan_number"),
    ("voter-id", "VOTER_ID", "Voter ID", "epic_number"),
    ("passport", "PASSPORT", "Passport", "passport_num"),
    ("driving-license", "DRIVING_LICENSE", "Driving License", "license_number"),
)
SIGNATURES = (
    ("AADHAAR", "UIDAI", 30), ("AADHAAR", "AADHAAR", 30),
    ("PAN", "INCOME TAX", 40), ("PAN", "PAN", 30),
    ("VOTER_ID", "ELECTION COMMISSION", 50), ("VOTER_ID", "ELECTOR", 30), ("VOTER_ID", "PHOTO IDENTITY", 30), ("VOTER_ID", "EPIC", 50),
    ("DRIVING_LICENSE", "DL NO", 50), ("DRIVING_LICENSE", "VALID TILL", 30), ("DRIVING_LICENSE", "MCWG", 25), ("DRIVING_LICENSE", "LMV", 25),
    ("DRIVING_LICENSE", "DRIVING LICENCE", 40), ("DRIVING_LICENSE", "DRIVING LICENSE", 40), ("DRIVING_LICENSE", "REGISTRATION CERTIFICATE", 60),
    ("DRIVING_LICENSE", "VEHICLE CLASS", 50), ("DRIVING_LICENSE", "CHASSIS", 40), ("DRIVING_LICENSE", "ENGINE/MOTOR", 40), ("DRIVING_LICENSE", "MAKER", 30),
    ("DRIVING_LICENSE", "FORM 23A", 60), ("DRIVING_LICENSE", "REGN NO", 50), ("DRIVING_LICENSE", "REGN. NUMBER", 50), ("DRIVING_LICENSE", "TRANSPORT DEPARTMENT", 50),
    ("PASSPORT", "PASSPORT", 60), ("PASSPORT", "REPUBLIC OF INDIA", 50), ("PASSPORT", "GIVEN NAME", 25), ("PASSPORT", "DATE OF EXPIRY", 25), ("PASSPORT", "PLACE OF ISSUE", 25),
    ("PASSPORT", "NAME OF FATHER", 60), ("PASSPORT", "NAME OF MOTHER", 60), ("PASSPORT", "NAME OF SPOUSE", 40), ("PASSPORT", "LEGAL GUARDIAN", 40), ("PASSPORT", "OLD PASSPORT", 60), ("PASSPORT", "FILE NO", 50),
)
#: error code, HTTP status, retryable
ERROR_CODES = (
    ("document_mismatch", 400, False), ("id_not_found", 400, False), ("invalid_upload", 400, False), ("unreadable_file", 422, False),
    ("password_protected", 422, False), ("timeout", 504, True), ("ocr_unavailable", 503, True), ("internal_error", 500, True),
)

# ---- labels
PAN_LABELS = r"(?i)INCOME|TAX|DEPART|GOVT|GOVERNMENT|PERMANENT|ACCOUNT|NUMBER|NAME|FATHER|PARENT|DATE|BIRTH|SIGNATURE|SAMPLE|IMMIHELP"
DOB_LABEL = r"(?i)[D0O][O0][B8]|DATE\s*OF\s*BIRTH"
DOB_ANCHOR = r"(?i)(?:[D0O][O0][B8]|DATE\s*OF\s*BIRTH|YEAR\s*OF\s*BIRTH|YOB)[\s:：/.\-]*\d{2}[\d/\-.．]"
DOB_LOOSE = r"(?i)(?:[D0O][O0][B8]|DATE\s*OF\s*BIRTH)\s*[:：\-]?\s*(\d[\d/\-.．\t ]{5,14})"
DOB_YEAR = r"(?i)(?:[D0O][O0][B8]|DATE\s*OF\s*BIRTH|YEAR\s*OF\s*BIRTH|YOB)[:\s]*((?:19|20)\d{2})\b"
ISSUE_LABEL = r"(?i)[I1]SSU|PR[I1L]N|D[O0]WNL|UPDAT|UPLOAD|GENERAT|VALID|EXPIR"
FULL_DATE = r"[0-3]?\d[/\-.][01]?\d[/\-.]\d{4}"
GENDER = r"(?i)(FEMALE|TRANSGENDER|MALE)(?![A-Z])"
GENDER_WORDS = ((r"पुरुष", "M"), (r"महिला|स्त्री", "F"), (r"ट्रांसजेंडर|किन्नर", "T"))
AADHAAR_LABELS = (
    r"(?i)DOB|YEAR|MALE|FEMALE|GOVE|GOVT|BHARAT|REPUBLIC|OFIND|INDIA|AADH|UIDAI|AUTHORI|UNIQUE|IDENTI|ADDR|MOBILE|HELP|INFORMAT|SCANN|VERIFIED|ENROL|"
    r"PROOF|CITIZEN|DATE|BIRTH|ISSUE|PRINT|DOWNLOAD|MERA|PEHCHAN|XML|\bCODE\b|GOV\."
)
ADDRESS_MARKERS = (
    r"(?i)C/O|S/O|D/O|W/O|HOUSE\s*NO|\bH\.?\s*NO\b|HNO|FLAT|FLOOR|SECTOR|\bVTC\b|\bP\.?\s*O\b|SUB\s*DIST|DISTRICT|\bDIST\b|STATE|PIN\s*CODE|"
    r"\bPIN\b|VILLAGE|ROAD|STREET|NAGAR|COLONY|BLOCK|LANE|MARG|TEHSIL|MANDAL|TALUK|GALI|CHOWK|AVENUE|\bAVE\b|APART?MENT|APPARTMENT|ENCLAVE|"
    r"PHASE|PLOT|MARKET|BAZ?AR|GANJ|PURA|BAGH|CROSS|\bEXTN?\b|TOWER|\bZONE\b"
)
CITY_PIN = r"[A-Za-z]{3,}\s*-\s*\d{6}\b"
PIN = r"\b(\d{6})\b"
ADDRESS_LABEL = r"(?i)A[D0O]{1,2}R[A-Z]*S{1,2}|पता"
ADDRESS_FOOTER = r"(?i)VID[:\s]|MOBILE|UIDAI|WWW\.|HELP@|@|ENROL|\b1947\b|GOV\.?\s*IN"
LABEL_ONLY = r"(?i)^[\s:.,\-]*(?:C/O|S/O|D/O|W/O|VTC|P\.?\s*O|SUB\s*DIST(?:RICT)?|DIST(?:RICT)?|PIN\s*CODE|PIN|STATE|HOUSE\s*NO|H\.?\s*NO)[\s:.,\-]*$"
CARE_OF = r"(?i)(?<![A-Z])(?:([CSDWH])\s*[/\\|.]\s*[O0]\.?(?![A-Z])|([CSDWH])[O0]\s*[:：](?=\s*[A-Z])|(SON|DAUGHTER|WIFE|HUSBAND|CARE)\s+OF\b)\s*[:：.\-]?\s*"
CARE_OF_END = r"(?i),|\bHOUSE\b|\bH\.?\s*NO\b|\d"
HOUSE_NUMBER = r"(?i)(?:HOUSE\s*NO|H\.?\s*NO|HNO|FLAT)[.:\s]*(\d{1,5}(?:/\d{1,4})?)"
LEADING_NUMBER = r"\b([A-Za-z]?-?\d{1,5}(?:/\d{1,4})?)\b"
DISTRICT = r"(?i)\bDIST(?:RICT)?\b"
SUB_DISTRICT = r"(?i)\bSUB[\s.-]*DIST(?:RICT)?\b"
TOWN = r"(?i)\bVTC\b"
CITY_SUFFIX = r"(?i)^(.+?)\s+CITY$"
PLACE = r"^[A-Za-z][A-Za-z\s.]{1,40}$"
PASSPORT_BACK_KEYS = ("NAMEOFFATHER", "NAMEOFMOTHER", "NAMEOFSPOUSE", "OLDPASSPORT", "FILENO", "LEGALGUARDIAN")
PASSPORT_LABELS = r"(?i)NAME\s*OF|ADDRESS|LEGAL\s*GUARDIAN|OLD\s*PASSPORT|FILE\s*NO|FATHER|MOTHER|SPOUSE|REPUBLIC|GIVEN\s*NAME|DATE\s*OF|PLACE\s*OF|PASSPORT"
PASSPORT_ADDRESS_STOP = r"(?i)OLD\s*PASSPORT|FILE\s*NO|PASSP|FATHER|MOTHER|SPOUSE|LEGAL\s*GUARDIAN"
PASSPORT_NOT_NAME = (
    r"(?i)NAME\s*OF|ADDRESS|GUARDIAN|FATHER|MOTHER|SPOUSE|FILE\s*NO|OLD\s*PASSPORT|PASSP|REPUBLIC|INDIA|"
    r"PUNJAB|HARYANA|DELHI|MAHARASHTRA|BLOCK|AEROCITY|NAGAR|MOHALI|PIN"
)
PIN_LABELLED = r"PIN[:\s]*([0-9]{6})|\b([0-9]{6})\b"
ADDRESS_WORD = r"(?i)ADDRESS"
OLD_PASSPORT = r"(?i)OLD\s*PASSPORT"
FILE_NUMBER = r"\b([A-Z]{2}\d{13,14})\b"
PASSPORT_WORD = r"\b([A-Z]{1,2}\d{6,7})\b"
SEX_WORD = r"(?i)\b(MALE|FEMALE)\b"
ANY_SEX_WORD = r"(?i)\b(MALE|FEMALE|TRANSGENDER)\b"
BIRTH_LABEL, ISSUE_DATE_LABEL, EXPIRY_LABEL = r"(?:DATE\s*OF\s*BIRTH|BIRTH)", r"DATE\s*OF\s*ISSUE", r"DATE\s*OF\s*EXPIRY"
#: After a label: a date, or a place; the label or what the place is of goes in.
DATE_AFTER, PLACE_AFTER = r"(?i){label}[:\s]*({date})", r"(?i)PLACE\s*OF\s*{what}[:\s]*([A-Z, ]+)"
DL_BIRTH_LABEL = r"(?:DOB|DATE\s*OF\s*BIRTH|BIRTH)"
CARE_OF_LEAD = r"(?i)^(?:C/O|S/O|D/O|W/O)"
PAN_DATE = r"\b(\d{1,2}/\d{1,2}/\d{4})\b"
VOTER_RELATIVE = r"(?i)FATH|HUSB|MOTH"
BARE_DIGITS = r"^[\d/\-]{2,}$"
DL_DATE = r"(?:[0-3]?\d[/\-. ]+[01]?\d[/\-. ]+\d{4}|[0-3]?\d[/\-. ]*[A-Za-z]{3,}[/\-. ]*\d{4})"
DL_ISSUE_NEAR = r"(?i)(?:ISSUE|VALID|EXPIR|DOI\b|TILL)"
DL_ADDRESS_STOP = (
    r"(?i)SIGNATURE|ISSUING|ISSUE|AADHAAR|AUTH|HOLDER|VALID|THUMB|IMPRESSION|DATE\s*OF|BADGE|\bBG\b|BLOOD|\bDOB\b|FORM|RULE|\bCOV\b|\bLMV\b|"
    r"\bMCWG\b|DRIVE|UNION|STATE\s*MOTOR"
)
DL_NOISE = (
    r"(?i)DLNUMBER|\bDL\s*NO|INV|CARR|VALIDITY|\bVALID\b|FORM|RULE|AUTHORIS|AADHAAR|ISSUING|AUTHORITY|HOLDER|SIGNATURE|\bAUTH\b|DRIVE|\bCOV\b|"
    r"\bLMV\b|\bMCWG\b|UNION|STATE\s*MOTOR|BLOOD|\bDOB\b|\bBG\b|\bNAME\b|DATE\s*OF|ISSUE|THUMB|IMPRESSION|BADGE|"
    r"DR[IV]*NG|LICEN|GETTY|SHUTTERSTOCK|ALAMY|CREDIT"
)
DL_NAME_LABEL = r"(?i)^(?!.*(?:MAKER|MODEL)).*\bNAME\b"
DL_NAME_GLUE = r"(?i)\bNAME\b"
DL_GUARDIAN = r"(?i)\bS[WD]?\s*/\s*[DWMO]|\b[WD]\s*/\s*O\b|\bSON\s*/\s*WIFE\s*/\s*DAUGHTER\s*OF(?:\s*\([^)]*\)?)?"
DL_BLOOD = r"(?i)BLOOD\s*GRP|BLOOD\s*GROUP|\bBG\b"
DL_ADDRESS = r"(?i)\bADDRESS\b|\bADD"
DL_ISSUE_LABELS = (r"ISSUE\s*DATE", r"DATE\s*OF\s*ISSUE", r"\bDOI\b", r"\bDO[I/]", r"\bID\b")
DL_DATE_TOKEN = r"([0-3]?\d[/\-. ]*[A-Za-z0-9]{2,}[/\-. ]*\d{4})"
VOTER_HEADER = r"(?i)ELECTOR|PHOTO|IDENTITY|CARD|COMMISSION|EPIC|FATHER|HUSBAND"
VOTER_FRONT = r"ELECTOR(?!AL)|EPIC|PHOTO\s*IDENTITY"
VOTER_DOB = r"(?i)(?:DOB|DATE\s*OF|BIRTH|AGE)[^\d]{0,20}([0-3]?\d[/\-.][01]?\d[/\-.]\d{4})"
VOTER_PARENT = r"(?i)(?:FATHER|HUSBAND|MOTHER)(?:['’]?S)?\s*NAME\s*[:/.\-]?\s*(\S.*)"
VOTER_PARENT_GARBLED = r"(?i)(?:FATH|HUSB|MOTH)[A-Z'’ ]{0,8}?ME\s*:\s*(\S.*)"
VOTER_NAME = r"(?i)(?:\b|ELECTOR['’]?S\s*)NAME\s*[:/.\-]?\s*(\S.*)"
VOTER_GENDER_LABEL = r"(?i)(?:GEND[EO]R|SEX)(.*)"
FUZZY_GENDER = ((r"TRANS", "T"), (r"F[E3]MA[LI1|]?E", "F"), (r"MA[LI1|]?E", "M"))

# ---- word lists
STATES = (
    "PUNJAB", "HARYANA", "DELHI", "MAHARASHTRA", "GUJARAT", "KARNATAKA", "TAMIL NADU", "KERALA", "RAJASTHAN", "UTTAR PRADESH", "WEST BENGAL",
    "ANDHRA PRADESH", "TELANGANA", "MADHYA PRADESH", "BIHAR", "ODISHA", "ASSAM", "JHARKHAND", "CHHATTISGARH", "UTTARAKHAND", "GOA", "TRIPURA",
    "MANIPUR", "MEGHALAYA", "MIZORAM", "NAGALAND", "SIKKIM", "HIMACHAL PRADESH", "JAMMU AND KASHMIR", "LADAKH", "CHANDIGARH", "PUDUCHERRY", "ANDAMAN AND NICOBAR",
)
#: The first twenty states, which the passport address knows.
PASSPORT_STATES = STATES[:20]
SURNAMES = (
    "SRIVASTAVA", "BHARDWAJ", "AGARWAL", "AGGARWAL", "MALHOTRA", "CHATURVEDI", "TRIPATHI", "SACHDEVA", "CHAUHAN", "RATHORE", "KULKARNI", "MUKHERJEE",
    "CHATTERJEE", "BANERJEE", "DESHMUKH", "GAIKWAD", "WADHWA", "KAPOOR", "KHANNA", "CHOPRA", "MEHROTRA", "PANDEY", "MISHRA", "TIWARI", "DUBEY",
    "SHUKLA", "DWIVEDI", "SAXENA", "THAKUR", "SHARMA", "VERMA", "GUPTA", "YADAV", "PATEL", "REDDY", "NAIDU", "PILLAI", "MEHTA", "BANSAL",
    "MITTAL", "ARORA", "SETHI", "DESAI", "JOSHI", "MALIK", "PRASAD", "CHANDRA", "NAHATA", "SINGHAL", "AGRAWAL", "GOENKA", "JAISWAL",
    "SINHA", "GHOSH", "NAIR", "IYER", "MENON", "SHAH", "JAIN", "GOEL", "GARG", "KHAN", "BOSE", "DASS", "NEGI", "RAWAT", "BISHT", "SIDHU",
    "DHILLON", "SANDHU", "BAJWA", "GREWAL", "BHATIA", "ANAND", "GROVER", "NANDA", "TANEJA", "NAGPAL", "RANA", "MEHRA", "KAUR", "GILL", "BRAR",
    "SOOD", "SETH", "DAS", "SEN", "ROY", "RAO", "BHAT", "BHATT", "KUMAR", "SINGH", "NATH",
    "DESHPANDE", "BHOSALE", "SALUNKE", "PALANDE", "KARANDE", "JADHAV", "SHINDE", "CHAVAN", "SAWANT", "BODAKE",
    "THORAT", "NIKAM", "SHELAR", "KSHIRSAGAR", "WAGHMARE", "PAWAR", "PATIL", "KADAM", "SHIRKE", "BHOSLE", "MANE", "MORE",
)
