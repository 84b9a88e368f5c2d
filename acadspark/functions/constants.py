"""Word lists, patterns and weights that results depend on."""

from __future__ import annotations

# --- fixed values: HTML entities decoded by the column form of clean_text ("&amp;" goes last) ---
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"),
    ("&#x27;", "'"), ("&apos;", "'"), ("&ndash;", "–"), ("&mdash;", "—"), ("&rsquo;", "’"),
    ("&lsquo;", "‘"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&hellip;", "…"),
    ("&bull;", "•"), ("&copy;", "©"), ("&eacute;", "é"), ("&#38;", "&"), ("&amp;", "&"),
)

# --- fixed values: contact patterns ---
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE_FORMATS = (
    r"\((\d{3})\)\s*(\d{3})-(\d{4})",
    r"(\d{3})-(\d{3})-(\d{4})",
    r"(\d{3})\.(\d{3})\.(\d{4})",
    r"(\d{3})\s+(\d{3})\s+(\d{4})",
    r"(\d{3})(\d{3})(\d{4})",
)
DASHED_PHONE = r"\b\d{3}-\d{3}-\d{4}\b"
URL = r"https?://[a-zA-Z0-9$-_@.&+!*(),]+"

# --- fixed values: names and institutions ---
NAME_PREFIXES = ("Dr.", "Professor", "Prof.", "Mr.", "Ms.", "Mrs.")
NAME_SUFFIXES = ("Ph.D.", "PhD", "M.D.", "MD", "J.D.", "JD")
KEY_TITLES = ("dr.", "prof.", "professor", "dr", "phd", "ph.d.")
INSTITUTION_WORDS = ("university", "college", "institute")

# --- fixed values: research areas looked up in text ---
RESEARCH_AREAS = (
    "Clinical Psychology", "Cognitive Psychology", "Social Psychology", "Developmental Psychology", "Neuropsychology",
    "Behavioral Psychology", "Health Psychology", "Educational Psychology", "Personality Psychology",
    "Biological Psychology", "Experimental Psychology", "Applied Psychology", "Cognitive Neuroscience",
    "Behavioral Neuroscience", "Psychopathology", "Psychotherapy", "Assessment", "Statistics", "Research Methods",
    "Memory", "Attention", "Perception", "Learning", "Motivation", "Emotion", "Stress", "Anxiety", "Depression",
    "ADHD", "Autism", "Aging", "Child Development", "Family Psychology", "Group Therapy", "Trauma", "PTSD",
    "Addiction", "Substance Abuse", "Eating Disorders",
)
AREA_PATTERNS = (
    r"(machine learning|artificial intelligence|deep learning)",
    r"(neuroscience|cognitive science|brain imaging)",
    r"(computer vision|image processing|pattern recognition)",
    r"(natural language processing|nlp|computational linguistics)",
    r"(robotics|autonomous systems|human-robot interaction)",
    r"(bioinformatics|computational biology|genomics)",
    r"(quantum computing|quantum information|quantum mechanics)",
    r"(climate science|environmental science|sustainability)",
    r"(materials science|nanotechnology|polymer science)",
    r"(cancer research|oncology|tumor biology)",
)
PROFILE_KEYWORDS = (
    "cognitive", "neuroscience", "psychology", "behavioral", "social", "developmental", "clinical", "computational",
    "machine learning", "artificial intelligence", "statistics", "data science", "linguistics", "perception", "memory",
    "attention", "learning", "emotion", "personality", "psychotherapy", "assessment", "diagnosis",
)

# --- fixed values: predicates ---
ACADEMIC_HOST_PARTS = (".edu", ".ac.", ".org")
PERSONAL_PATH_MARKS = ("/~", "/people/", "/faculty/", "/staff/", "/profile/", "/user/", "personal", "homepage")
PERSON_STOP_PHRASES = (
    "read more", "learn more", "contact us", "home page", "click here", "more info", "view profile", "full bio",
    "lab website",
)
TITLE_WORDS = (
    "professor", "assistant", "associate", "chair", "director", "lecturer", "instructor", "emeritus", "clinical",
)
BIO_WORDS = (
    "research", "studies", "interests", "work", "focus", "received", "earned", "degree", "university", "published",
)
DEPARTMENT_SKIP = (
    "home", "contact", "about", "news", "events", "search", "login", "logout", "privacy", "terms", "copyright",
    "sitemap", "help", "support", "celebrates", "announces", "welcomes", "congratulates", "linkedin", "facebook",
    "twitter", "instagram", "click here", "read more", "learn more", "find out", "alumni", "admissions", "tuition",
    "financial aid", "parking", "dining", "housing", "campus map", "http://", "https://", "www.", "@",
)
DEPARTMENT_WORDS = (
    "department", "dept", "school", "college", "division", "program", "center", "institute", "faculty", "studies",
    "science", "arts", "psychology", "biology", "chemistry", "physics", "mathematics", "engineering", "business",
    "medicine", "law", "education",
)
PROGRAM_LINK_SKIP = (
    "mailto:", "tel:", "javascript:", "#", ".pdf", ".doc", ".jpg", ".png", "facebook", "twitter", "linkedin",
)
PROGRAM_LINK_WORDS = (
    "program", "degree", "graduate", "undergraduate", "major", "department", "school", "college", "master", "bachelor",
    "phd", "doctoral",
)
NOT_LAB_WORDS = (
    "email", "phone", "address", "contact", "copyright", "all rights reserved", "privacy policy", "terms of service",
    "home", "about", "news", "events", "calendar", "login", "register", "search", "menu", "navigation",
)
EXCLUDED_LINK = (
    r"mailto:|tel:|javascript:|#|facebook\.com|twitter\.com|linkedin\.com|instagram\.com|youtube\.com|contact|email|"
    r"phone|address|cv\.pdf|resume\.pdf"
)
LISTING_BLOCK_WORDS = (
    "faculty", "directory", "staff", "people", "list", "page", "university", "college", "department", "school",
    "program", "undergraduate", "graduate", "admissions", "academics", "research", "about", "contact", "home",
    "carnegie", "mellon", "stanford", "columbia", "harvard", "mit",
)
FACULTY_PAGE_WORDS = (
    "faculty", "professor", "dr.", "phd", "research", "teaching", "email", "office", "phone", "cv", "publications",
)

# --- fixed values: URL classes ---
ACADEMIC_SUFFIXES = (
    "edu", "ac.uk", "ac.in", "ac.jp", "ac.kr", "ac.au", "ac.nz", "edu.au", "edu.sg", "edu.my", "edu.hk", "edu.tw",
    "edu.cn",
)
SOCIAL_HOSTS = (
    "facebook.com", "fb.com", "twitter.com", "x.com", "linkedin.com", "instagram.com", "youtube.com", "tiktok.com",
    "snapchat.com", "pinterest.com", "reddit.com", "tumblr.com", "medium.com", "behance.net", "dribbble.com",
    "github.io", "speakerdeck.com", "slideshare.net", "prezi.com", "weibo.com", "vk.com", "ok.ru", "line.me",
)
SCHOLAR_HOST = "scholar.google.com"
PROFILE_HOSTS = (
    "researchgate.net", "academia.edu", "orcid.org", "publons.com", "scopus.com", "dblp.org", "semanticscholar.org",
)
PUBLICATION_HOSTS = (
    "pubmed.ncbi.nlm.nih.gov", "arxiv.org", "doi.org", "jstor.org", "springer.com", "elsevier.com", "wiley.com",
    "ieee.org", "acm.org", "nature.com", "science.org", "plos.org",
)
LAB_PATH_WORDS = (
    "lab", "laboratory", "labs", "group", "groups", "center", "centre", "institute", "research", "clinic", "facility",
    "unit", "program",
)
FIELD_PATH_WORDS = (
    "cognitive", "neuroscience", "psychology", "computational", "behavioral", "social", "developmental", "clinical",
    "experimental", "applied",
)
PEOPLE_PATH_WORDS = (
    "faculty", "people", "staff", "directory", "profile", "person", "member", "researcher", "academic",
)
PERSONAL_PATH_WORDS = ("~", "/personal/", "/home/", "/users/")
GOOD_LINK_TYPES = ("google_scholar", "personal_website", "lab_website", "academic_profile", "university_profile")

# --- fixed values: program and lab text ---
DEGREE_WORDS = (
    ("Bachelor", ("bachelor", "b.a.", "b.s.", "ba ", "bs ", "undergraduate")),
    ("Master", ("master", "m.a.", "m.s.", "ma ", "ms ", "graduate")),
    ("PhD", ("ph.d.", "phd", "doctoral", "doctorate")),
    ("Certificate", ("certificate", "certification")),
    ("Minor", ("minor",)),
)
PROGRAM_CONTACT_WORDS = ("department", "program", "admissions", "info", "grad")
LAB_CONTACT_WORDS = ("lab", "group", "center")
PROGRAM_WORDS = ("program", "degree", "master", "bachelor", "phd", "doctoral")
LAB_TYPE_WORDS = (
    ("teaching", ("teaching", "undergraduate", "course", "class")),
    ("clinical", ("clinical", "patient", "therapy", "treatment")),
    ("service", ("service", "testing", "analysis", "consultation")),
)
EQUIPMENT_WORDS = (
    "EEG", "fMRI", "MRI", "scanner", "microscope", "spectrometer", "chromatograph", "centrifuge", "eye tracker",
    "motion capture", "cameras",
)
SOFTWARE_WORDS = ("MATLAB", "Python", "R", "software", "toolbox", "package", "library", "framework", "API")
KEYWORD_STOPWORDS = (
    "research", "university", "department", "laboratory", "study", "studies", "analysis", "data", "work", "using",
    "used", "methods", "results", "found",
)
ROLE_PATTERNS = (
    r"(professor|prof\.?|dr\.?|phd|ph\.d\.?)",
    r"(postdoc|post-doc|postdoctoral fellow|postdoctoral researcher)",
    r"(graduate student|phd student|doctoral student|phd candidate)",
    r"(undergraduate|undergrad|research assistant|ra)",
    r"(principal investigator|pi|lab director|lab manager|group leader)",
    r"(research scientist|research associate|staff scientist|senior scientist)",
    r"(visiting scholar|visiting researcher|visiting professor)",
    r"(technician|lab technician|research technician|technical staff)",
    r"(emeritus|emerita|retired|former)",
    r"(assistant professor|associate professor|full professor)",
    r"(lecturer|instructor|teaching professor)",
)
MEMBER_PHONE = r"\b(?:\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})\b"
STATUS_WORDS = (
    ("current", ("current", "ongoing", "active", "in progress")),
    ("completed", ("completed", "finished", "concluded", "past")),
    ("planned", ("planned", "proposed", "upcoming", "future")),
)

# --- fixed values: lab link scores (hundredths) ---
LAB_WORD = r"(lab|laboratory|labs|center|centre|group|groups|clinic|institute|facility|unit|program)"
LAB_URL_SCORES = (
    (r"/lab(?:s|oratory)?(?:/|$)", 40), (r"/research(?:-|/|$)", 35), (r"/center|centre(?:/|$)", 30),
    (r"/institute(?:/|$)", 30), (r"/group(?:s)?(?:/|$)", 25), (r"/~\w+", 20), (r"/faculty/\w+", 15),
)
LAB_FIELD_WORDS = (
    "cognitive", "neuroscience", "psychology", "behavioral", "social", "developmental", "clinical", "experimental",
    "applied", "computational", "artificial", "intelligence", "machine", "learning", "data", "science",
)
LAB_PHRASE_SCORES = (
    (r"visit\s+(our\s+)?(lab|laboratory|research)", 30), (r"(lab|laboratory|research)\s+(website|homepage|page)", 30),
    (r"welcome\s+to\s+(our\s+)?(lab|laboratory|research)", 25), (r"(lab|laboratory|group)\s+of\s+", 20),
    (r"research\s+(lab|laboratory|group|center)", 20),
)
LAB_NEGATIVE_WORDS = (
    "contact", "email", "phone", "address", "cv", "resume", "social", "media", "facebook", "twitter", "linkedin",
)

# --- fixed values: directory link scores (hundredths) ---
DIRECTORY_TERMS = ("faculty", "people", "staff", "directory", "professors", "researchers", "team")
UNIT_TERMS = ("department", "dept", "school", "college", "division", "program", "center", "institute")
DIRECTORY_PATHS = r"/faculty|/people|/staff|/directory|/our-people|/team|/members"
NON_ACADEMIC_TERMS = (
    "news", "events", "admissions", "alumni", "contact", "about", "services", "resources", "library", "dining",
    "housing", "parking",
)
DISCIPLINES = (
    "psychology", "biology", "chemistry", "physics", "mathematics", "math", "engineering", "computer science",
    "medicine", "nursing", "business", "economics", "history", "english", "philosophy", "sociology", "anthropology",
    "political science", "education", "art", "music", "theater", "journalism",
)
