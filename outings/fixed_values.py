"""Fixed values.

Word lists, patterns, limits and formats that decide results. They are stated
here as they are, because the catalog they describe depends on them; everything
else in the package is derived from them.

Patterns are Java regular expressions. ``(?i)`` ignores case, ``(?u)`` does so
for accented letters too, ``(?U)`` makes ``\\s``, ``\\b`` and ``\\d`` Unicode aware.
"""

# --- domains -----------------------------------------------------------------
SECTIONS = ("theatre", "cinema")
DEFAULT_SECTION = "theatre"
STATUSES = ("LIKE", "DISLIKE", "SEEN")
CALENDAR_ZONE = "Europe/Paris"

# --- limits ------------------------------------------------------------------
MAX_LISTING_PAGE = 199
DEFAULT_LISTING_PAGES = 150
DEFAULT_REFRESH_HOURS = 72
PER_DEFAULT, PER_MAX = 100, 200
DURATION_MAX = 600
IMPORT_PRICE_MAX = 500
TITLE_MAX = 280
IMPORT_TEXT_MAX = {
    "category": 120,
    "venue": 160,
    "address": 240,
    "arrondissement": 80,
    "description": 20000,
}
URL_MAX = 500
DATE_TEXT_CANDIDATES = 30
DATE_TEXT_MIN_CHARS = 6
DURATION_TEXT_CANDIDATES = 8
DESCRIPTION_MIN_CHARS = 10

# --- months (full names, then abbreviations that may carry a point) -----------
MONTH_NAMES = {
    "janvier": 1, "février": 2, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5,
    "juin": 6, "juillet": 7, "août": 8, "aout": 8, "septembre": 9,
    "octobre": 10, "novembre": 11, "décembre": 12, "decembre": 12,
}
MONTH_ABBREVIATIONS = {
    "janv": 1, "févr": 2, "fevr": 2, "avr": 4, "juil": 7, "sept": 9,
    "oct": 10, "nov": 11, "déc": 12, "dec": 12,
}
# Short month names as French date labels print them.
MONTH_LABELS = (
    "janv.", "févr.", "mars", "avr.", "mai", "juin",
    "juil.", "août", "sept.", "oct.", "nov.", "déc.",
)

# --- text patterns -----------------------------------------------------------
NUMERIC_DATE = r"(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})"
ISO_PREFIX = r"^\s*(\d{4}-\d{2}-\d{2})"
PRICE = r"(?U)(\d+(?:[.,]\d+)?)\s*€"
PRICE_RANGE = r"(?U)(\d+)\s*[-–—]\s*(\d+)\s*€"
DURATION = r"(?U)(\d+)h(?:(\d+))?|(\d+)\s*(?:mn|min)"
DURATION_MINUTES_TOKEN = r"(?U)\b\d+\s*(?:mn|min)\b"
DURATION_HOUR_TOKEN = r"(?U)\b\d+h(?:\d+)?\b"
DURATION_CONTEXT = r"(?iuU)\b(?:durée|duree|dur\.)\b"
CINEMA_DURATION_LABEL = r"(?iuU)\bdur(?:ée|e)?\s*:\s*([^\s•|]+)"
ISO8601_DURATION = r"(?i)^PT(?:(\d+)H)?(?:(\d+)M)?$"
ADDRESS = (
    r"(?U)\b\d{1,4}\s+(?:bis\s+|ter\s+)?[A-Za-zÀ-ÖØ-öø-ÿ'’\-. ]+?"
    r"\b\d{5}\s+[A-Za-zÀ-ÖØ-öø-ÿ'’\-. ]+"
)
RUBRIC = r"(?iuU)rubrique\s+([^.]+)\."
TICKET_WORDS = r"(?iu)tarif|prix|billet"
GENRE_LABEL = (
    r"(?iuU)\bgenre(?:s)?\s*:\s*(.+?)(?=\b(?:durée|duree|date\s+de\s+sortie|sortie|"
    r"nationalité|réalisateur|réalisation|avec|casting|titre\s+original)\b|$)"
)
# Date wordings. ``MONTH`` stands for any month name or abbreviation from the tables above.
NUMERIC_SPAN = r"(?iu)du\s+(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})\s+au\s+(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})"
TWO_YEAR_SPAN = r"(?iu)du\s+(\d{1,2})\s+(MONTH)\s+(\d{4})\s+au\s+(\d{1,2})\s+(MONTH)\s+(\d{4})"
ONE_YEAR_SPAN = r"(?iu)du\s+(\d{1,2})\s+(MONTH)\s+au\s+(\d{1,2})\s+(MONTH)\s+(\d{4})"
ONE_MONTH_SPAN = r"(?iu)du\s+(\d{1,2})\s+au\s+(\d{1,2})\s+(MONTH)\s+(\d{4})"
FROM_DAY = r"(?iu)à\s+partir\s+du\s+(\d{1,2})\s+(MONTH)\s+(\d{4})"
UNTIL_DAY = r"(?iu)jusqu['’]?au\s+(\d{1,2})\s+(MONTH)\s+(\d{4})"
WORD_DAY = r"(?iu)(\d{1,2})\s+(MONTH)\s+(\d{4})"
RELEASE = (
    r"(?iuU)\b(?:date\s+de\s+sortie|sortie|date\s+de\s+ressortie|ressortie)[^:]*[:\-]?\s*"
    r"((\d{1,2})[/-](\d{1,2})[/-](\d{2,4})|\d{1,2}\s+MONTH\s+\d{4})"
)
JSONLD_GENRE = r'(?is)"genre"\s*:\s*(?:"([^"]+)"|\[(.*?)\])'
JSONLD_DURATION = r'(?i)"duration"\s*:\s*"([^"]+)"'
JSONLD_RELEASE = r'(?i)"(?:datePublished|dateCreated|startDate|releaseDate)"\s*:\s*"([^"]+)"'
JSONLD_RUN = r'(?i)"(?:startDate|endDate)"\s*:\s*"([^"]+)"'

# --- words -------------------------------------------------------------------
DESCRIPTION_HEADINGS = ("présentation", "résumé", "synopsis", "à propos")
NOT_A_VENUE = (
    "pièces de théâtre", "pieces de theatre", "spectacles musicaux",
    "humour & shows", "théâtre", "theatre",
)
NOT_A_VENUE_WORDS = ("réservation", "reservation", "billet", "billetterie")
NOT_A_VENUE_START = "le spectacle "

# --- element selectors, in the order candidates are read ----------------------
DATE_SELECTORS = (
    "time", ".date", ".dates", ".informations", ".meta",
    "[class*=date]", "[id*=date]", "section", "article",
)
ADDRESS_SELECTORS = (
    "[itemprop=streetAddress]", "[itemprop=address]",
    "[class*=address]", "[id*=address]", "address",
)
# The flag says whether an hour alone ("1h30") is enough without a duration word.
DURATION_SELECTORS = (
    (".informations", False), (".meta", False), ("section", False),
    ("article", False), ("p", False), ("[class*=durée]", True), ("[class*=duree]", True),
)

# --- URL shapes per section ----------------------------------------------------
DETAIL_PATHS = {
    "theatre": r"^/theatre/[^/]+-\d+/[^/]+-\d+\.html$",
    "cinema": r"^/cinema/evenement/[^/]+-\d+\.html$",
}
VENUE_PATHS = {"theatre": r"^/theatre/[^/]+-\d+(?:\.html)?$"}
LISTING_PATHS = {
    "theatre": "/theatre/programme.html",
    "cinema": (
        "/cinema/programme.html?rubrique=cinema&origine=homepage_rubrique"
        "&DateDebut=&DateFin=&NbDay=&arrondissment=&arrondissment=&GenreCinema="
    ),
}
PAGE_PARAMETER = "npage"
DEFAULT_CATEGORIES = {"theatre": "théâtre"}

# --- labels --------------------------------------------------------------------
SECTION_LABELS = {"cinema": "Cinéma", "theatre": "Théâtre"}
NO_DATE_LABEL = "Dates à venir"
NO_PRICE_LABEL = "Tarifs non communiqués"
# French currency text: narrow no-break space between thousands, no-break space before the sign.
THOUSANDS_SEPARATOR = "\u202f"
CURRENCY_SUFFIX = "\u00a0€"

# --- seed rows -------------------------------------------------------------------
SEED_WORKS = (
    ("Le Cid", "theatre", "théâtre", "seed://le-cid"),
    ("Dom Juan", "theatre", "théâtre", "seed://dom-juan"),
    ("Le Misanthrope", "theatre", "théâtre", "seed://misanthrope"),
)
