"""Rule sets, as data.

Every rule is an argument with a default from this module, so a user changes a
pattern or adds a criterion without touching an operator.
"""

# ---------------------------------------------------------------------------
# These must equal the published curation rules for the results
# to be right.
# ---------------------------------------------------------------------------

# Criterion -> fields, patterns (matched ignoring case) and minimum length.
SCORING = {
    "SPECIES_ID": {
        "fields": ["species"],
        "negative": r"sp\.|spp\.|[0-9]|^sp$|aff\.|cf\.| nr ",
    },
    "TYPE_SPECIMEN": {
        "fields": ["taxonomy_notes", "short_note", "collection_notes", "voucher_type", "notes"],
        "positive": "holotype|lectotype|isotype|syntype|paratype|neotype|allotype|"
        "paralectotype|hapantotype|cotype",
    },
    "SEQ_QUALITY": {"fields": ["nuc_basecount", "bin_uri"], "min_length": 500},
    "PUBLIC_VOUCHER": {
        "fields": ["voucher_type"],
        "negative": "DNA|e-vouch|privat|no voucher|unvouchered|destr|lost|missing|no specimen|"
        "none|not vouchered|person|Photo Voucher Only|not registered",
        "positive": "herb|museum|registered|type|national|CBG|INHS|deposit|harbarium|"
        "hebarium|holot",
    },
    "HAS_IMAGE": {"fields": ["has_image"]},
    "IDENTIFIER": {
        "fields": ["identified_by"],
        "negative": r"\bKate Perez\b|\bAngela Telfer\b|\bBOLD\b|\bBLAST\b|\bBIN\b|\bNone\b",
    },
    "ID_METHOD": {
        "fields": ["identification_method"],
        "negative": "barco|BOLD|mBRAVE|SINTAX|CO1|COI|COX|DNA|mole|phylo|sequ|tree|image|bin|"
        "silva|ncbi|ncbl|engine|blast|genbank|genetic|unspecified|its|^None$|^NA$|^$",
    },
    "COLLECTORS": {"fields": ["collectors"]},
    "COLLECTION_DATE": {"fields": ["collection_date_start", "collection_date_end"]},
    "COUNTRY": {"fields": ["country_ocean"]},
    "SITE": {"fields": ["site"]},
    "SECTOR": {"fields": ["sector"]},
    "REGION": {"fields": ["region"]},
    "COORD": {"fields": ["coord"]},
    "INSTITUTION": {
        "fields": ["inst"],
        "negative": "genbank|no voucher|personal|private|research collection of|unknown|"
        "unvouchered",
    },
    "MUSEUM_ID": {"fields": ["museumid"]},
}

# Rank -> requirements. A tuple is an OR group, everything else must be met.
RANKS = {
    1: ["SPECIES_ID", "TYPE_SPECIMEN"],
    2: ["SPECIES_ID", "SEQ_QUALITY", "HAS_IMAGE", "COLLECTORS", "COLLECTION_DATE", "COUNTRY",
        ("SITE", "SECTOR", "REGION", "COORD"), "IDENTIFIER", "ID_METHOD",
        ("INSTITUTION", "PUBLIC_VOUCHER", "MUSEUM_ID")],
    3: ["SPECIES_ID", "SEQ_QUALITY", "COUNTRY", "IDENTIFIER", "ID_METHOD",
        ("INSTITUTION", "PUBLIC_VOUCHER", "MUSEUM_ID")],
    4: ["SPECIES_ID", "SEQ_QUALITY", "COUNTRY"],
    5: ["SPECIES_ID", "SEQ_QUALITY"],
    6: ["SPECIES_ID"],
}
DEFAULT_RANK = 7

# Species-name patterns. They differ on purpose; each step uses its own.
IMPORT_NAME_REJECT = r"^sp\.|spp\.|[0-9]|^sp$|aff\.|cf\."
VALID_NAME_REJECT = r"sp\.|spp\.|[0-9]|^sp$|aff\.|cf\."
CONCORDANCE_NAME_REJECT = r"sp\.|spp\.|cf\.|aff\."
SPECIES_LIST_REJECT = r"sp\.|spp\."
BINOMIAL = r"^\S+\s+\S+"
SPECIES_RANKS = ["species", "subspecies"]

# Grades.
GRADES = ["A", "B", "C", "D", "E"]
GRADE_A_MIN = 11
GRADE_D_BELOW = 3

# Size gate.
MAX_RECORDS = 10000
MAX_BINS = 1000

# Flag code -> label, note length limit.
FLAG_LABELS = {
    "": "None",
    "misidentification": "Misidentification",
    "synonym": "Synonym",
    "id_uncertain": "ID Uncertain",
    "data_issue": "Data Issue",
    "other_issue": "Other Issue",
}
MAX_NOTE_LENGTH = 1000

# Annotation kind -> fields of a structured entry, in priority order.
ANNOTATION_FIELDS = {
    "selected": ["selected", "value"],
    "flag": ["flag", "value"],
    "updated_id": ["text", "value"],
    "curator_notes": ["text", "note", "value"],
}

# Column orders.
CURATOR_COLUMNS = [
    "selected", "flag", "updated_id", "curator_notes", "rank", "quality_score", "processid",
    "bin_uri", "identification", "identified_by", "identification_method", "country_ocean",
    "collection_date_start", "collectors", "inst", "criteria_met",
]
EXPORT_ANNOTATION_COLUMNS = [
    "selected", "flag", "updated_id", "curator_notes", "flag_user", "flag_timestamp",
]
EXPORT_COLUMNS = [
    "processid", "species", "genus", "family", "order", "bin_uri", "identified_by",
    "identification_method", "collectors", "collection_date_start", "country_ocean", "coord",
    "institution", "voucher_type", "quality_score", "criteria_met", "nuc",
    "selected", "flag", "updated_id", "curator_notes",
]
REPORT_COLUMNS = [
    "sampleid", "processid", "identification", "flag", "updated_id", "flag_user",
    "curator_notes",
]

# Search-term checks.
TAXON_BAD_CHARS = r"[^A-Za-z0-9\s\-_., ]"
DATASET_CODE = r"^DS-[A-Z0-9]+$"
PROJECT_BAD_CHARS = r"[^A-Za-z0-9\-_]"
MAX_TAXON_LENGTH = 100

# Audit levels.
AUDIT_LEVELS = ["INFO", "WARNING", "ERROR", "SELECTION", "FLAG", "EXPORT", "ACTION"]

# Continent -> countries.
CONTINENTS = {
    "Africa": [
        "Algeria", "Angola", "Benin", "Botswana", "Burkina Faso", "Burundi", "Cameroon",
        "Cape Verde", "Central African Republic", "Chad", "Comoros", "Congo",
        "Democratic Republic of the Congo", "Djibouti", "Egypt", "Equatorial Guinea",
        "Eritrea", "Ethiopia", "Gabon", "Gambia", "Ghana", "Guinea", "Guinea-Bissau",
        "Ivory Coast", "Kenya", "Lesotho", "Liberia", "Libya", "Madagascar", "Malawi",
        "Mali", "Mauritania", "Mauritius", "Morocco", "Mozambique", "Namibia", "Niger",
        "Nigeria", "Rwanda", "Sao Tome and Principe", "Senegal", "Seychelles",
        "Sierra Leone", "Somalia", "South Africa", "South Sudan", "Sudan", "Swaziland",
        "Tanzania", "Togo", "Tunisia", "Uganda", "Zambia", "Zimbabwe",
    ],
    "Asia": [
        "Afghanistan", "Armenia", "Azerbaijan", "Bahrain", "Bangladesh", "Bhutan", "Brunei",
        "Cambodia", "China", "Cyprus", "Georgia", "India", "Indonesia", "Iran", "Iraq",
        "Israel", "Japan", "Jordan", "Kazakhstan", "Kuwait", "Kyrgyzstan", "Laos", "Lebanon",
        "Malaysia", "Maldives", "Mongolia", "Myanmar", "Nepal", "North Korea", "Oman",
        "Pakistan", "Palestine", "Philippines", "Qatar", "Saudi Arabia", "Singapore",
        "South Korea", "Sri Lanka", "Syria", "Taiwan", "Tajikistan", "Thailand",
        "Timor-Leste", "Turkey", "Turkmenistan", "United Arab Emirates", "Uzbekistan",
        "Vietnam", "Yemen",
    ],
    "Europe": [
        "Albania", "Andorra", "Austria", "Belarus", "Belgium", "Bosnia and Herzegovina",
        "Bulgaria", "Croatia", "Czech Republic", "Denmark", "Estonia", "Finland", "France",
        "Germany", "Greece", "Hungary", "Iceland", "Ireland", "Italy", "Kosovo", "Latvia",
        "Liechtenstein", "Lithuania", "Luxembourg", "Malta", "Moldova", "Monaco",
        "Montenegro", "Netherlands", "North Macedonia", "Norway", "Poland", "Portugal",
        "Romania", "Russia", "San Marino", "Serbia", "Slovakia", "Slovenia", "Spain",
        "Sweden", "Switzerland", "Ukraine", "United Kingdom", "Vatican City",
    ],
    "Oceania": [
        "Australia", "Fiji", "Kiribati", "Marshall Islands", "Micronesia", "Nauru",
        "New Zealand", "Palau", "Papua New Guinea", "Samoa", "Solomon Islands", "Tonga",
        "Tuvalu", "Vanuatu",
    ],
    "North America": [
        "Canada", "United States", "Mexico", "Greenland", "Bermuda",
        "Saint Pierre and Miquelon",
    ],
    "Central America": [
        "Belize", "Costa Rica", "El Salvador", "Guatemala", "Honduras", "Nicaragua", "Panama",
    ],
    "South America": [
        "Argentina", "Bolivia", "Brazil", "Chile", "Colombia", "Ecuador", "Guyana",
        "Paraguay", "Peru", "Suriname", "Uruguay", "Venezuela", "French Guiana",
    ],
}
