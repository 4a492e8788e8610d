"""Fixed values.

Every constant below is a fixed value: results only agree with the rules they
describe when these words, labels and numbers are exactly as written.  They
are plain data; callers may pass their own lists to the functions instead.
"""

# --- fixed values: titles ---------------------------------------------------

INTERN_WORDS = ["intern", "internship", "co-op", "coop", "summer analyst"]

TITLE_ACRONYMS = [
    "AI", "ML", "IT", "QA", "SWE", "RF", "PCB", "EHS", "HR", "FPGA", "ASIC",
    "VLSI", "CAD", "CAE", "UI", "UX", "API", "OS", "USA", "UK",
]

# --- fixed values: job functions, in order of precedence --------------------

JOB_FUNCTION_PHRASES = {
    "Software Engineering": [
        "software", "swe", "frontend", "front-end", "backend", "back-end",
        "fullstack", "full-stack", "web dev", "mobile dev", "ios", "android",
        "firmware", "embedded software", "cloud engineer", "devops", "sre",
        "site reliability", "systems engineer", "platform engineer",
        "infrastructure engineer", "qa engineer", "test engineer",
        "automation engineer", "security engineer", "cybersecurity",
        "application engineer", "developer", "it intern", "business it",
    ],
    "Data, AI & Machine Learning": [
        "data engineer", "data science", "data scientist", "machine learning",
        "deep learning", "computer vision", "nlp", "natural language",
        "ai engineer", "ai research", "artificial intelligence",
        "quantitative research", "data analyst", "business intelligence",
        "bi analyst", "analytics intern", "data analytics",
        "analytics engineering", "applied scientist", "ai intern",
    ],
    "Hardware & Electrical Engineering": [
        "hardware", "electrical", "electronics", "pcb", "fpga", "asic",
        "rf engineer", "semiconductor", "vlsi", "silicon", "circuits",
        "microelectronics", "optics", "photonics", "test hardware",
    ],
    "Mechanical & Aerospace Engineering": [
        "mechanical", "aerospace", "aeronautical", "avionics", "propulsion",
        "spacecraft", "thermal engineer", "structural engineer", "cad",
        "robotics engineer", "mechatronics", "manufacturing", "tooling",
        "machining", "automation engineering", "fluid dynamics",
        "materials science", "metallurgy",
    ],
    "Product Management & Design": [
        "product management", "product manager", "associate product manager",
        "apm", "product owner", "ui/ux", "ui ux", "ux design", "ui design",
        "product design", "user research", "interaction design",
        "graphic design", "creative design", "industrial design",
        "product development", "design intern",
    ],
    "Finance, Accounting & Trading": [
        "finance", "financial analyst", "accounting", "accountant", "audit",
        "tax", "treasury", "actuarial", "actuary", "investment banking",
        "private equity", "wealth management", "asset management", "trader",
        "trading", "quantitative trading", "portfolio management",
        "credit analyst", "risk management", "underwriting",
        "real estate ... equity",
    ],
    "Marketing & Communications": [
        "marketing", "digital marketing", "content marketing", "social media",
        "brand", "growth marketing", "public relations", "communications",
        "copywriting", "seo", "sem", "event marketing", "advertising",
        "market research", "pr intern", "creative strategy",
    ],
    "Sales & Business Development": [
        "sales", "business development", "bizdev", "account executive",
        "account manager", "sales operations", "sales ops",
        "customer success", "client solutions", "partnerships", "commercial",
        "technical sales",
    ],
    "Supply Chain, Logistics & Operations": [
        "supply chain", "logistics", "procurement", "sourcing", "operations",
        "ops intern", "inventory", "warehouse", "fulfillment",
        "transportation", "freight", "production planning", "distribution",
        "plant operations", "purchasing", "quality intern",
        "inspection intern",
    ],
    "Healthcare, Biotech & Life Sciences": [
        "clinical", "pharmacology", "pharmacy", "pharmaceutical", "biology",
        "biochem", "biomedical", "chemistry", "chemist", "lab tech",
        "laboratory", "medical", "nursing", "healthcare", "therapeutics",
        "drug discovery", "genomics", "biotech", "veterinary", "health",
    ],
    "Human Resources & Recruiting": [
        "human resources", "hr intern", "recruiting", "recruiter",
        "talent acquisition", "people operations", "people ops", "diversity",
        "compensation", "workforce", "employee relations", "global talent",
    ],
    "Legal, Policy & Compliance": [
        "legal", "counsel", "paralegal", "compliance", "regulatory", "policy",
        "government affairs", "contracts", "privacy", "ethics", "law intern",
    ],
    "Civil & Environmental Engineering": [
        "civil", "environmental engineer", "environmental engineering",
        "structural civil", "construction management", "geotechnical",
        "surveying", "hydrology", "water resources",
        "transportation engineer", "urban planning", "sustainability",
        "mining engineer", "ehs intern", "environmental intern",
    ],
    "General Business & Consulting": [
        "consulting", "consultant", "management consulting", "strategy",
        "business analyst", "general business", "corporate strategy",
        "operations consulting", "project coordinator", "project management",
        "pmo", "administrative",
    ],
}

JOB_FUNCTION_LABELS = {
    "software engineering": "Software Engineering",
    "information technology": "Software Engineering",
    "data and analytics": "Data, AI & Machine Learning",
    "data science": "Data, AI & Machine Learning",
    "engineering": "Mechanical & Aerospace Engineering",
    "manufacturing": "Mechanical & Aerospace Engineering",
    "science and engineering": "Healthcare, Biotech & Life Sciences",
    "healthcare": "Healthcare, Biotech & Life Sciences",
    "human resources": "Human Resources & Recruiting",
    "human resources and recruitment": "Human Resources & Recruiting",
    "advertising and marketing": "Marketing & Communications",
    "marketing": "Marketing & Communications",
    "accounting and finance": "Finance, Accounting & Trading",
    "sales": "Sales & Business Development",
    "supply chain": "Supply Chain, Logistics & Operations",
    "business operations": "Supply Chain, Logistics & Operations",
    "management": "General Business & Consulting",
    "consulting": "General Business & Consulting",
    "project management": "General Business & Consulting",
    "general business": "General Business & Consulting",
    "administrative": "General Business & Consulting",
    "product management": "Product Management & Design",
    "design": "Product Management & Design",
    "civil engineering": "Civil & Environmental Engineering",
}

# --- fixed values: work arrangement -----------------------------------------

ARRANGEMENT_SPELLINGS = {
    "remote": "remote", "fullyremote": "remote", "remotefirst": "remote",
    "hybrid": "hybrid",
    "onsite": "onsite", "inoffice": "onsite", "inperson": "onsite", "office": "onsite",
}

# --- fixed values: places ---------------------------------------------------

US_STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR",
    "california": "CA", "colorado": "CO", "connecticut": "CT",
    "delaware": "DE", "florida": "FL", "georgia": "GA", "hawaii": "HI",
    "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA",
    "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME",
    "maryland": "MD", "massachusetts": "MA", "michigan": "MI",
    "minnesota": "MN", "mississippi": "MS", "missouri": "MO",
    "montana": "MT", "nebraska": "NE", "nevada": "NV",
    "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM",
    "new york": "NY", "north carolina": "NC", "north dakota": "ND",
    "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA",
    "rhode island": "RI", "south carolina": "SC", "south dakota": "SD",
    "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT",
    "virginia": "VA", "washington": "WA", "west virginia": "WV",
    "wisconsin": "WI", "wyoming": "WY", "district of columbia": "DC",
}

US_METROS = {
    "san francisco": "San Francisco, CA",
    "new york": "New York, NY",
    "new york city": "New York, NY",
    "chicago": "Chicago, IL",
    "chicago il": "Chicago, IL",
    "seattle": "Seattle, WA",
    "austin": "Austin, TX",
    "boston": "Boston, MA",
    "los angeles": "Los Angeles, CA",
    "san jose": "San Jose, CA",
    "palo alto": "Palo Alto, CA",
    "mountain view": "Mountain View, CA",
    "sunnyvale": "Sunnyvale, CA",
    "santa clara": "Santa Clara, CA",
    "atlanta": "Atlanta, GA",
    "dallas": "Dallas, TX",
    "houston": "Houston, TX",
    "san diego": "San Diego, CA",
    "denver": "Denver, CO",
    "washington": "Washington, DC",
    "washington dc": "Washington, DC",
    "washington, d.c.": "Washington, DC",
    "munich": "Munich, Germany",
    "münchen": "Munich, Germany",
    "berlin hq": "Berlin, Germany",
    "hong kong": "Hong Kong",
    "shanghai": "Shanghai, China",
}

WORLD_CITIES = {
    "singapore": "Singapore", "singapore, sg": "Singapore",
    "london": "London, United Kingdom", "london, uk": "London, United Kingdom",
    "paris": "Paris, France", "berlin": "Berlin, Germany",
    "tokyo": "Tokyo, Japan", "madrid": "Madrid, Spain",
    "sydney": "Sydney, Australia", "toronto": "Toronto, Canada",
    "toronto, on": "Toronto, ON, Canada", "vancouver": "Vancouver, Canada",
    "vancouver, bc": "Vancouver, BC, Canada", "montreal": "Montreal, Canada",
    "montreal, qc": "Montreal, QC, Canada",
    "auckland": "Auckland, New Zealand",
    "auckland, nz": "Auckland, New Zealand", "dublin": "Dublin, Ireland",
    "amsterdam": "Amsterdam, Netherlands", "seoul": "Seoul, South Korea",
    "bangkok": "Bangkok, Thailand", "jakarta": "Jakarta, Indonesia",
    "kuala lumpur": "Kuala Lumpur, Malaysia",
    "são paulo": "São Paulo, Brazil", "sao paulo": "São Paulo, Brazil",
    "ho chi minh city": "Ho Chi Minh City, Vietnam",
    "mexico city": "Mexico City, Mexico", "bengaluru": "Bengaluru, India",
    "bangalore": "Bengaluru, India", "hyderabad": "Hyderabad, India",
    "mumbai": "Mumbai, India", "pune": "Pune, India",
}

COUNTRY_CODES = {
    "sgp": "Singapore", "sg": "Singapore",
    "chl": "Chile", "cl": "Chile",
    "mex": "Mexico", "mx": "Mexico",
    "mys": "Malaysia", "my": "Malaysia",
    "ita": "Italy", "it": "Italy",
    "pol": "Poland", "pl": "Poland",
    "pan": "Panama", "pa": "Panama",
    "per": "Peru", "pe": "Peru",
    "gbr": "United Kingdom", "gb": "United Kingdom", "uk": "United Kingdom",
    "deu": "Germany", "de": "Germany",
    "fra": "France", "fr": "France",
    "esp": "Spain", "es": "Spain",
    "aus": "Australia", "au": "Australia",
    "can": "Canada", "ca": "Canada",
    "bra": "Brazil", "br": "Brazil",
    "ind": "India", "in": "India",
}

NOT_A_PLACE = [
    "in-office", "headquarter", "headquarters", "nea headquarters", "office",
    "flexible - any spacex site", "united states",
]

STREET_WORDS = [
    "Street", "St", "Avenue", "Ave", "Drive", "Dr", "Road", "Rd",
    "Boulevard", "Blvd", "Way", "Lane", "Ln", "Place", "Pl", "Court", "Ct",
    "Parkway", "Pkwy", "Pike", "Highway", "Hwy", "Floor", "Fl", "Suite",
    "Ste",
]

# --- fixed values: hiring cycle ---------------------------------------------

SEASON_WORDS = {
    "summer": ["summer", "été", "ete", "verano", "sommer", "estate"],
    "fall": ["fall", "autumn", "automne", "otoño", "herbst", "autunno"],
    "winter": ["winter", "hiver", "invierno", "inverno"],
    "spring": ["spring", "printemps", "primavera", "frühling"],
}

# --- fixed values: employers ------------------------------------------------

LEGAL_WORDS = [
    "inc", "incorporated", "corp", "corporation", "llc", "ltd", "limited",
    "co", "company", "group", "holdings", "plc",
]

DIRECT_PLATFORMS = [
    "ashby", "greenhouse", "jsonld", "lever", "oracle_recruiting",
    "smartrecruiters", "workday",
]

COMPANY_NAMES = {
    "cvshealth": "CVS Health",
    "aecom2": "AECOM",
    "pimco": "PIMCO",
    "globalhr": "Pratt & Whitney",
    "pg": "Procter & Gamble (P&G)",
    "goventi": "Goventi",
    "etched": "Etched",
    "abbvie": "AbbVie",
    "conocophillips": "ConocoPhillips",
    "southstatebank": "SouthState Bank",
    "valeo": "Valeo",
    "sluhn": "St. Luke's University Health Network",
    "siloamcareers": "Siloam Hospitals",
    "generalmotors": "General Motors",
    "enpal": "Enpal",
    "simular": "Simular",
    "brunswick": "Brunswick Group",
    "nvidia": "NVIDIA",
    "clera": "Clera",
    "nea": "New Enterprise Associates (NEA)",
    "joko": "Joko",
    "philips": "Philips",
    "prosidianconsulting": "ProSidian Consulting",
    "ri": "Research Institute",
    "voodoo": "Voodoo",
    "samsara inc.": "Samsara",
    "aptiv plc": "Aptiv",
    "hp": "HP Inc.",
    "hp inc.": "HP Inc.",
    "itw": "ITW (Illinois Tool Works)",
    "csl": "CSL",
    "ecovadis": "EcoVadis",
    "cityofphiladelphia": "City of Philadelphia",
    "ge": "GE (General Electric)",
    "ups": "UPS",
    "cibc": "CIBC",
    "td": "TD Bank",
    "bmo": "BMO Financial Group",
    "rbc": "RBC (Royal Bank of Canada)",
    "ey": "EY (Ernst & Young)",
    "pwc": "PwC",
    "kpmg": "KPMG",
    "bain": "Bain & Company",
    "bcg": "Boston Consulting Group (BCG)",
    "mckinsey": "McKinsey & Company",
    "jpmorgan": "JPMorgan Chase",
    "goldmansachs": "Goldman Sachs",
    "ms": "Morgan Stanley",
    "citi": "Citigroup",
    "bofa": "Bank of America",
    "amzn": "Amazon",
    "goog": "Google",
    "meta": "Meta",
    "aapl": "Apple",
    "msft": "Microsoft",
    "tsla": "Tesla",
    "neuralink corp.": "Neuralink",
    "hntb corporation": "HNTB",
    "invesco ltd.": "Invesco",
    "polaris inc.": "Polaris",
    "ciena corporation": "Ciena",
    "equinix, inc": "Equinix",
    "block, inc.": "Block (Square)",
    "gartner, inc.": "Gartner",
    "comcast corporation": "Comcast",
    "chevron corporation": "Chevron",
    "hootsuite inc.": "Hootsuite",
    "epicor software corporation": "Epicor",
    "genscript biotech corporation": "GenScript Biotech",
    "point72": "Point72",
    "project44": "project44",
    "auto1": "AUTO1 Group",
    "autoscout24": "AutoScout24",
    "rise8": "Rise8",
    "10beauty": "10Beauty",
    "42dot": "42dot",
    "66degrees": "66degrees",
}

NUMBERED_SUBSIDIARIES = {"Expedia": "Expedia Group", "MyPath": "MyPath"}

JOINED_NAMES = {
    "CityAndCountyOfSanFrancisco": "City and County of San Francisco",
    "WorldWildlifeFundInc": "World Wildlife Fund",
    "BEUMERGroup": "BEUMER Group",
    "AmrefHealthAfrica": "Amref Health Africa",
    "SigmaSoftware": "Sigma Software",
    "RAKUNA": "Rakuna",
}

NAMES_KEEPING_SUFFIX = ["HP Inc.", "Moog Inc.", "Dow Inc.", "CSL Limited", "CVS Health"]

# A trailing dot after these is optional.
NAME_SUFFIXES = [
    "Inc", "LLC", "Corp", "Corporation", "Ltd", "Limited", "GmbH", "PLC",
    "Pty", "SA", "S.A", "NV", "N.V", "BV", "B.V",
]

# Suffixes of a registered name; dots after the letters are optional.
REGISTERED_SUFFIXES = [
    "LLC", "L.L.C", "Inc", "Incorporated", "Corp", "Corporation", "Ltd",
    "Limited", "PLC", "Co",
]

COMPANY_INDUSTRY = {
    "Pratt & Whitney": "Aerospace & Defense",
    "RTX": "Aerospace & Defense",
    "GE Aerospace": "Aerospace & Defense",
    "Rocket Lab": "Space Launch & Satellites",
    "Zipline": "Drone Delivery",
    "TikTok": "Digital Media & Entertainment",
    "Walmart": "Retail & E-Commerce",
    "BoschGroup": "Industrial & Automotive Technology",
    "Bosch": "Industrial & Automotive Technology",
    "Enterprise Mobility": "Transportation & Mobility",
    "Schneider Electric": "Power & Electrical Equipment",
    "CVS Health": "Healthcare & Pharmacy",
    "Aumovio": "Automotive Technology",
    "Continental": "Automotive",
    "AECOM": "Civil Engineering & Infrastructure",
    "DeliveryHero": "Food Delivery & Logistics",
    "GE Vernova": "Energy & Power",
    "Hitachi Energy": "Energy & Power",
    "JPMorgan Chase": "Banking & Financial Services",
    "PIMCO": "Asset Management & Finance",
    "PNC": "Banking & Financial Services",
    "Blackstone": "Private Equity & Asset Management",
    "AccorHotel": "Hospitality & Travel",
    "Selina": "Hospitality & Travel",
    "RedBull": "Beverages & Sports Marketing",
    "Eurofins": "Life Sciences & Testing",
    "WesternDigital": "Computer Hardware & Storage",
    "SGS": "Testing, Inspection & Certification",
    "Equinox": "Fitness & Hospitality",
    "Procter & Gamble (P&G)": "Consumer Packaged Goods",
    "Sia": "Management Consulting",
    "Palantir": "Enterprise Software",
    "NVIDIA": "Semiconductors & AI Hardware",
    "General Motors": "Automotive",
    "AbbVie": "Pharmaceuticals & Biotech",
    "ConocoPhillips": "Oil & Gas",
    "Tesla": "Electric Vehicles & Clean Energy",
    "Apple": "Consumer Electronics & Software",
    "Microsoft": "Cloud & Enterprise Software",
    "Amazon": "E-Commerce & Cloud Infrastructure",
    "Google": "Internet & AI Software",
    "Meta": "Social Media & AI Software",
}

# Words in an employer's name that tell its industry, in order of precedence.
INDUSTRY_WORDS = {
    "Healthcare & Life Sciences": [
        "hospital", "health", "clinic", "medical", "pharma", "therapeutics",
        "biosciences", "biotech",
    ],
    "Financial Services": [
        "bank", "capital", "financial", "investment", "wealth", "securities",
        "insurance", "fintech", "bancorp",
    ],
    "Aerospace & Defense": ["aerospace", "aero", "aviation", "defense", "space"],
    "Energy & Utilities": ["energy", "power", "solar", "renewable", "petroleum", "oil", "gas"],
    "Automotive": ["auto", "motors", "automotive", "vehicles"],
    "Hospitality & Travel": ["hotel", "hospitality", "resort", "travel", "airlines", "airways"],
    "Consumer Goods & Retail": ["retail", "brands", "foods", "beverage", "apparel", "stores"],
    "Civil Engineering & Construction": ["construction", "civil", "infrastructure"],
    "Media & Entertainment": ["media", "entertainment", "broadcasting", "publishing", "news"],
}

FUNCTION_INDUSTRY = {
    "Software Engineering": "Software & Technology",
    "Data, AI & Machine Learning": "Data & Artificial Intelligence",
    "Hardware & Electrical Engineering": "Hardware & Electronics",
    "Mechanical & Aerospace Engineering": "Mechanical Engineering",
    "Civil, Structural & Environmental Engineering": "Civil & Environmental Engineering",
    "Product & Program Management": "Product Management",
    "Finance, Accounting & Trading": "Finance & Accounting",
    "Marketing, Brand & Growth": "Marketing & Growth",
    "Sales, Account Management & BD": "Sales & Business Development",
    "Supply Chain, Logistics & Operations": "Supply Chain & Logistics",
    "Healthcare & Medicine": "Healthcare & Life Sciences",
    "Human Resources & Talent": "Human Resources & Talent",
    "Legal, Compliance & Policy": "Legal & Compliance",
    "Strategy, Consulting & Corporate Dev": "Management Consulting",
}

# --- fixed values: health of sources and listings ----------------------------

SCRAPE_INTERVAL_SECONDS = {
    "muse": 3600, "greenhouse": 7200, "lever": 7200, "workday": 21600,
    "oracle_recruiting": 21600, "jsonld": 43200,
}
DEFAULT_INTERVAL_SECONDS = 21600

RECHECK_DAYS = {
    "no_internship_titles": 14, "zero_postings": 30, "not_distinct": 90,
    "name_mismatch": 90, "fetch_error": 30,
}
DEFAULT_RECHECK_DAYS = 90

DESCRIPTION_BACKOFF_HOURS = [1, 6, 24, 72, 168]
LIVENESS_BACKOFF_HOURS = [6, 24, 72, 168]

GONE_STATUSES = [404, 410]
GONE_STATUSES_WORKDAY = [403, 404, 410]
NO_DESCRIPTION_STATUSES = [403, 404, 410]

GONE_PHRASES = [
    "page doesn't exist",
    "page does not exist",
    "job is no longer available",
    "position is no longer available",
    "job posting has expired",
    "this posting has expired",
    "no longer accepting applications",
    "this job has been closed",
]

DISABLE_AFTER_FAILURES = 5
EMPTY_RUNS_BEFORE_BACKOFF = 10
EMPTY_BOARD_INTERVAL_SECONDS = 86400
STALL_HOURS = 3
NAME_MATCH_THRESHOLD = 0.5

# --- fixed values: enumerations ---------------------------------------------

POSTING_STATUSES = ["open", "closed", "duplicate"]
SOURCE_STATUSES = ["probation", "active", "disabled"]
CANDIDATE_STATUSES = ["unchecked", "no_match", "rejected", "promoted"]
ACTIVITY_KINDS = [
    "promoted", "disabled", "reinstated", "backup_restore_test", "expired", "stalled",
]
