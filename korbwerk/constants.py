"""Fixed values of the domain: all that must be equal for equal results, and nothing else."""

from __future__ import annotations

# Geography, travel and search limits.
EARTH_RADIUS_KM = 6371.0088
ROUTE_FACTOR, EUR_PER_KM = 1.25, 0.15
DEFAULT_RADIUS_KM, NEXT_DAYS, SAME_STORE_KM = 15.0, 14, 0.15
MAX_STORES = 3
TOTAL_TOLERANCE, WORTH_SAVING = 0.005, 0.01
STALE_HOURS = 36

# Minimum offers and image rates a retailer's run is held to.
RETAILERS = ("REWE", "Lidl", "Netto Marken-Discount", "ALDI SÜD", "ALDI NORD", "EDEKA", "PENNY")
EXPECTED_OFFERS = {"REWE": 150, "Lidl": 120, "Netto Marken-Discount": 250, "ALDI SÜD": 130, "ALDI NORD": 130, "EDEKA": 60, "PENNY": 100}
EXPECTED_OFFERS_ELSE = 50
MIN_IMAGE_RATE = {"REWE": 50.0, "Lidl": 35.0, "Netto Marken-Discount": 20.0, "ALDI SÜD": 20.0, "ALDI NORD": 20.0, "EDEKA": 20.0, "PENNY": 20.0}
MIN_IMAGE_RATE_ELSE = 10.0
MIN_IMPORT_RATE, MIN_PROVENANCE_RATE, MIN_PACKAGE_RATE = 80.0, 95.0, 45.0
FAIL_COUNT_RATIO, PASS_COUNT_RATIO = 0.30, 0.80

# How a shop's name is recognised, in order of precedence.
RETAILER_NAMES = {
    "rewe": "REWE",
    "rewe xl": "REWE",
    "netto marken-discount": "Netto Marken-Discount",
    "netto": "Netto Marken-Discount",
    "aldi süd": "ALDI SÜD",
    "aldi sued": "ALDI SÜD",
    "lidl": "Lidl",
    "edeka": "EDEKA",
    "penny": "PENNY",
}

# Words that place a product in a category, in order of precedence.
CATEGORIES = {
    "backwaren": ("brot", "brötchen", "croissant", "baguette", "toast", "kuchen", "torte", "muffin", "donut", "backware", "brezel", "stuten"),
    "molkerei-kuehlung": (
        "milch", "joghurt", "jogurt", "almighurt", "froop", "ehrmann", "müller", "quark", "käse", "mozzarella", "feta", "butter", "margarine", "sahne", "schmand", "kefir", "pudding", "milchreis", "frischkäse", "skyr", "dessert",
        "eier", "ei ",
    ),
    "suesswaren-snacks": ("schokolade", "schoko", "keks", "kekse", "waffel", "bonbon", "gummi", "chips", "cracker", "nüsse", "nuss", "snack", "riegel", "praline", "lakritz", "popcorn"),
    "obst-gemuese": (
        "apfel", "äpfel", "banane", "birne", "erdbe", "himbeer", "heidelbeer", "traube", "orange", "mandarine", "zitrone", "limette", "mango", "ananas", "kiwi", "melone", "pfirsich", "nektarine", "kirsche", "pflaume", "tomate",
        "gurke", "paprika", "kartoffel", "zwiebel", "knoblauch", "salat", "möhre", "karotte", "brokkoli", "blumenkohl", "zucchini", "aubergine", "champignon", "gemüse", "obst", "avocado",
    ),
    "fleisch-fisch": (
        "fleisch", "rind", "schwein", "hähnchen", "huhn", "pute", "hack", "steak", "schnitzel", "braten", "wurst", "salami", "schinken", "speck", "würstchen", "bratwurst", "fisch", "lachs", "thunfisch", "garnelen", "forelle",
        "kabeljau", "seelachs",
    ),
    "getraenke": (
        "wasser", "cola", "limonade", "limo", "saft", "nektar", "smoothie", "bier", "pils", "radler", "wein", "sekt", "prosecco", "vodka", "wodka", "whisky", "gin ", "rum ", "likör", "kaffee", "espresso", "cappuccino", "tee ",
        "getränk", "energy", "eistee",
    ),
    "tiefkuehl": ("tiefkühl", "tk ", "pizza", "pommes", "eiscreme", "speiseeis", "eis ", "fischstäbchen"),
    "vorrat-grundnahrung": (
        "nudel", "pasta", "reis", "mehl", "zucker", "salz", "öl", "essig", "konserve", "dose", "müsli", "hafer", "cerealien", "cornflakes", "soße", "sauce", "ketchup", "senf", "mayonnaise", "mayo", "gewürz", "suppe", "brühe",
        "aufstrich", "marmelade", "honig",
    ),
    "haushalt-drogerie": (
        "waschmittel", "spülmittel", "reiniger", "toilettenpapier", "küchenrolle", "zahnpasta", "zahnbürste", "shampoo", "duschgel", "deo", "seife", "creme", "windel", "taschentücher", "müllbeutel", "haushalt",
    ),
    "tiernahrung": ("katzen", "hunde", "tierfutter", "tier-nahrung", "hundefutter", "katzenfutter", "leckerl", "napf"),
}
OTHER_CATEGORY = "sonstiges"

# Wording of offers that are not sold in the store.
ONLINE_ONLY = (
    r"nur\s+online",
    r"online\s*only",
    r"ausschlie(?:ß|ss)lich\s+online",
    r"nur\s+im\s+onlineshop",
    r"nur\s+im\s+online-shop",
    r"nur\s+per\s+versand",
    r"versandangebot",
    r"onlinebestellung\s+erforderlich",
    r"nur\s+online\s+bestellbar",
    r"webshop\s*only",
)

# Words that never stand for a brand.
GENERIC_BRANDS = "bio deutsche deutscher frische frischer frisches helle heller helles rote roter rotes feine frische-sieger aktion premium classic natur".split()

# Sources of product images by preference.
MEDIA_PRIORITY = {"prospect_crop": 100, "pdf_embedded": 150, "retailer_cdn": 200, "official_product": 300, "admin_curated": 400}

# Names that no product has.
SUSPICIOUS_NAMES = (
    r"\bkassenbon\b",
    r"\bqr[- ]?code\b",
    r"\bgewinnspiel\b",
    r"\bartikel\s+preis\b",
    r"\b(?:2er|3er|4er|5er)[- ]?set\b",
    r"^\d+(?:[.,]\d+)?\s*%\b",
    r"\bhochladen\b",
    r"\bscannen\b",
)

# Wording of promotions (searched without regard to case).
PROMOTION_PATTERNS = {
    "percent": (r"(?:-|−)\s*(\d{1,2}(?:[.,]\d+)?)\s*%", r"\b(\d{1,2}(?:[.,]\d+)?)\s*%\s*(?:rabatt|günstiger|guenstiger|sparen|ersparnis)\b"),
    "fewer": (r"\b(\d{1,2})\s*für\s*(\d{1,2})(?![.,]\d)\b", r"\b(\d{1,2})\s*(?:zum\s+preis\s+von|zahlen\s+nur)\s*(\d{1,2})(?![.,]\d)\b"),
    "plus": r"\b(\d{1,2})\s*\+\s*(\d{1,2})\s*(?:gratis|kostenlos)\b",
    "fixed": r"\b(\d{1,2})\s*(?:stück\s*)?(?:für|nur)\s*(?:€\s*)?(\d{1,3}[,.]\d{2})\s*€?\b",
    "tier": r"\b(?:ab|ar)\s*(\d{1,2})\s*(?:stück|stk\.?)\b[^\d€]{0,24}(\d{1,3}[,.]\d{2})\s*€?",
    "piece": r"(?:\bje(?:\s+(?:stück|stk\.?|packung|croissant|brötchen|artikel))?\s*|\beinzelpreis\s*)(?:€\s*)?(\d{1,3}[,.]\d{2})\s*€?",
    "special": r"SPECIAL_PRICE\s+kind=([a-z0-9_+-]+)\s+label=(.+?)\s+price=(\d{1,3}[.,]\d{2})(?:\s|$)",
}
MULTIBUY_SIGNAL = (
    r"(?:\b\d{1,2}\s*\+\s*\d{1,2}\s*(?:gratis|kostenlos)\b|\b\d{1,2}\s*(?:für|zum\s+preis\s+von|zahlen\s+nur)\s*\d{1,2}(?![.,]\d)\b|"
    r"\b\d{1,2}\s*(?:stück\s*)?(?:für|nur)\s*€?\s*\d{1,3}[,.]\d{2}\b|\b(?:ab|ar)\s*\d{1,2}\s*(?:stück|stk\.?)\b)"
)
PROMOTION_CONFIDENCE = {"member_price": 1.0, "lidl_plus": 1.0, "tier_price": 0.99, "free_item": 0.99, "fixed_bundle": 0.98}
MOST_PIECES, MOST_PIECE_PRICE, LEAST_PROMOTION_CONFIDENCE = 24, 500.0, 0.98

# Percentages read as reductions, tolerance of former prices that end in 9 cents, and of equal prices.
LEAST_PERCENT, MOST_PERCENT = 0.5, 90.0
NINTH_OFF, NINTH_SHARE = 0.06, 0.035
CLOSE_OFF, CLOSE_SHARE = 0.031, 0.0075
LEAST_PRICE, MOST_PACKAGE_PRICE, MOST_PRICE = 0.05, 500.0, 5000.0

# How product names are cleaned (searched without regard to case).
NAVIGATION_MARKERS = ("bereich überspringen", "zu den angeboten", "aktuelle prospekte", "filialen in der nähe", "stellenangebote für die filiale")
NAME_SUFFIXES = (
    (r"\s+Gültig\s+(?:ab|vom)\s+\d{1,2}\.\d{1,2}\.(?:20)?\d{2}(?:\s+bis\s+(?:zum\s+)?\d{1,2}\.\d{1,2}\.(?:20)?\d{2})?\s*", " "),
    (r"\s+\d+\s*Extra\s*[°º]?\s*P\b.*$", ""),
    (r"\s+Mit\s+PAYBACK\b.*$", ""),
    (r"(?:\s+|^)(?:\d{1,3}[.,]\d{2})\s*(?:€)?\s*(?:App)?\s*$", ""),
    (r"\s+App\s*$", ""),
)
ORIGIN_PREFIX = r"^(?:Japan|Frankreich(?:\s*/\s*Luxemburg)?|Italien|Spanien|Portugal|Griechenland|Österreich)\s*[-–:]\s*"
KNOWN_NAMES = ((r"^ramont(?=\s+weichkäse\b)", "Géramont"),)
LONGEST_NAME = 180
MASTER_KEY_STEPS = (
    (r"\b(?:versch\.?|verschiedene)\s+sorten\b", " "),
    (r"\b(?:ursprung|herkunft)\s*:\s*[^,;]+", " "),
    (r"\b(?:kl\.?|klasse|handelsklasse)\s*[ivx]+\b", " "),
    (r"^(?:deutschland|niederlande|spanien|italien|frankreich|portugal|griechenland|osterreich)\s*[-–:]\s*", ""),
    (r"[^a-z0-9äöüß+]+", " "),
)

# Names that are none, in order of precedence, with the reason given.
NO_NAMES = (
    "filiale", "filiale & shop", "aktion", "knaller", "angebote", "angebot", "zu den angeboten", "alle anzeigen", "image", "online-shop", "onlineshop", "tiefgefroren", "gekühlt", "original", "classic", "natur",
    "versch. sorten", "100% pflanzlich", "schoko", "peanut", "gegart", "trocken", "halbtrocken", "lieblich", "je st", "je st.", "je z.b.", "je z. b.", "je pckg.", "sb-verpackt",
)
NAME_ISSUES = (
    (r"^\d{1,3}(?:[.,]\d+)?\s*%\s*(?:vol\.?)?$", "Nur Alkohol-/Prozentangabe, kein Produkt"),
    (r"^(?:\d{1,2}(?:[.,]\d+)?\s*[-–]\s*)?\d{1,2}(?:[.,]\d+)?\s*%\s*vol\.?\b.*$", "Alkoholangabe statt Produktname"),
    (r"^\d{1,3}(?:[.,]\d+)?\s*%\s+(?:pflanzlich|fett|frucht|kakao|saft)\b.*$", "Prozent-/Eigenschaftsangabe statt Produktname"),
    (r"^aus\s+.+$", "Herkunfts-/Beschreibungsfragment statt Produktname"),
    (r"^(?:vom\s+|von\s+(?:der|dem)\s+|mit\s+|ohne\s+|im\s+|in\s+|auf\s+wunsch\s+|für\s+|nach\s+|reich\s+an\s+).+$", "Untertext/Beschreibungsfragment statt Produktname"),
    (
        r"^(?:cremiger\s+brotaufstrich|sorte:\s*siehe\s+etikett(?:,\s*kl\.?\s*[ivx]+)?|[„“\"']?aromatica[„“\"']?,?\s*kl\.?\s*[ivx]+|gebrüht(?:,.*)?|geräuchert|geschnitten(?:,.*)?|zart\s+und\s+mager|"
        r"natur\s+oder\s+mariniert|luftgetrocknet|heiß\s+und\s+kalt\s+zu\s+genießen|italienische\s+salamispezialität|gefüllt\s+mit\s+frischkäse|nordische\s+art|mittelscharf|vorgekocht|koffeinhaltig|"
        r"auch\s+alkoholfrei|extra\s+ananas|sb-verpackt(?:,.*)?|frz\.\s+weich-\s+oder\s+schnittkäse(?:,.*)?|(?:weich|schnitt|hart)käse,\s*(?:mind\.\s*)?\d+\s*%\s*fett\s+i\.?tr\.)$",
        "Eigenschaft/Variante statt vollständigem Produktnamen",
    ),
    (r"^(?:kl\.?|klasse)\s*[ivx]+$", "Qualitätsklasse statt Produktname"),
    (
        r"^(?:\d+\s*[-–]?\s*fach\s+sortiert,?\s*geschnitten|grillfertig\s+gewürzt|feine\s+würzung(?:,\s*vom\s+[\wäöüÄÖÜß-]+)?|ohne\s+[^,]+,\s*leckere\s+würzung(?:,\s*vom\s+[\wäöüÄÖÜß-]+)?|"
        r"gegart,\s*geschnitten(?:,\s*vom\s+[\wäöüÄÖÜß-]+)?|grob\s+oder\s+fein,\s*feine\s+würzung(?:,\s*vom\s+[\wäöüÄÖÜß-]+)?)$",
        "Zubereitungs-/Beschreibungsfragment statt Produktname",
    ),
    (r"^\d+er[-\s]*set$", "Set-Angabe statt Produktname"),
    (r"^[,;:\-–\s]*(?:je\s+)?\d+(?:[.,]\d+)?\s*[-]?\s*(?:kg|g|l|ml|stück|stk\.?|pckg\.?|btl\.?|fl\.?|becher|dose|flasche)(?:\s*[-,;:].*)?$", "Nur Packungsangabe, kein Produktname"),
    (r"^[,.;:\-–]", "Produktname beginnt mit Satz-/Packungsfragment"),
)
NAME_MISSING, NAME_IS_HEADING = "Produktname fehlt/zu kurz", "Navigation/Überschrift/Eigenschaft statt Produkt"
NAME_TOO_LONG, NAME_HAS_NAVIGATION, NAME_IS_URL = "Produktname ungewöhnlich lang", "Navigationsinhalt im Produktnamen", "URL statt Produktname"
LONGEST_PLAIN_NAME = 110

# Lines of a leaflet that are no names.
NOISE_LINES = ("filiale", "filiale & shop", "aktion", "knaller", "alle anzeigen", "zu den angeboten", "image")
NOISE_BEGINNINGS = ("spare ", "uvp ", "statt ", "einzelpreis", "grundpreis", "zzgl. pfand", "gültig ", "angebote ", "aktuelle prospekte")
BAD_PRICE_CONTEXT = ("gültig von", "gültig ab", "gültig am", "montag", "dienstag", "mittwoch", "donnerstag", "freitag", "samstag", "sonntag", "kw 3", "pfand")

# Endings of offer names, and the countries that stand before or after one.
TAIL_COUNTRIES = "Deutschland|Niederlande|Spanien|Italien|Frankreich|Portugal|Griechenland|Türkei|Polen|Belgien|Österreich|Costa Rica|Panama"
NAME_TAILS = (
    rf"\s+(?:{TAIL_COUNTRIES})(?:\s*[/,]\s*(?:{TAIL_COUNTRIES}))*\s*,?\s*Kl\.?\s*[IVX]+.*$",
    r"\s+Ursprung:\s*.*$",
    r"\s+Sorte und Kocheigenschaft:?.*$",
    r"\s+(?:100\s*%\s+Baumwolle|Maße\s+ca\.?|Medizinprodukt;|Hackfleischzubereitung\s+vom\s+Rind\s+mit).*$",
    r"\s+(?:mit|oder|aus|von|für|und)\s*$",
)
COUNTRY_PREFIXES = (
    "deutschland", "niederlande", "spanien", "italien", "frankreich", "portugal", "griechenland", "südafrika", "argentinien", "chile", "neuseeland", "belgien", "österreich", "usa", "türkei", "luxemburg", "simbabwe",
    "costa rica", "panama", "rheinland pfalz", "rheinland-pfalz",
)

# Titles out of text blocks.
GENERIC_HEADERS = (
    "aktion", "knaller", "xxl", "sparen", "bonus", "bedientheke", "kühlung", "tiefkühlung", "gutes für alle.", "gutes für alle", "meine metzgerei", "meine käsetheke", "bio", "fleisch & wurst", "fleisch", "wurst",
    "getränke", "vorrat", "snack", "frühstück",
)
DESCRIPTOR_PREFIXES = (
    "versch.", "gekühlt", "tiefgekühlt", "tiefgefroren", "ursprung", "klasse", "kl.", "je ", "kg-preis", "l-preis", "vom ", "aus ", "mit ", "herzhaft", "cremig", "gesalzen", "natur oder", "sorte:", "sorten:", "taurin",
    "koffeinhaltig", "mind.", "fett ", "in ", "am ", "über ", "fein ", "vollfleisch", "geschnitten", "mariniert", "frisch ", "grob ", "ohne ", "zart ", "ca. ", "zzgl.", "1,5 %", "0,0 ", "11 %", "24% ",
)
SKIPPED_TITLE_LINES = ("gültig ", "kw ", "mehr auf ", "artikel mit diesem", "preisinformationen")
TITLE_LINES, LONGEST_TITLE_LINE = 4, 90
LAYOUT_PATTERNS = {
    "price": r"(?<!\d)(\d{1,3})[.,](\d{2})(?!\d)",
    "star_price": r"(?<!\d)(\d{1,3}[.,]\d{2})\s*\*",
    "quantity": r"\b(?:je\s+)?(?:(\d{1,2})\s*[x×]\s*)?(\d+(?:[.,]\d+)?)\s*[-]?\s*(kg|g|l|liter|ml|stück|st\.?|packung|pckg\.?|becher|dose|flasche|fl\.?|btl\.?)(?:\b|[- ])",
    "unit_price": r"\(\s*(?:1\s*)?(kg|l|100\s*g|100\s*ml)\s*=\s*(\d+(?:[.,]\d+)?)\s*\)",
    "unit_price_slash": r"\(?\s*(\d+(?:[.,]\d+)?)\s*(?:[–-]\s*\d+(?:[.,]\d+)?)?\s*/\s*(kg|l)\s*\)?",
    "unit_price_label": r"\b(kg|l)[- ]?preis\s*(\d+(?:[.,]\d+)?)",
    "regular": r"\b(?:UVP|statt)\s*(\d{1,3}[.,]\d{2})",
    "deposit": r"(?:zzgl\.?\s*)?(?:\d{1,3}[.,]\d{2})\s*(?:€\s*)?Pfand\b|\bPfand\s*(?:von\s*)?(?:\d{1,3}[.,]\d{2})\s*(?:€)?",
}
NO_CURRENT_PRICE_AFTER = ("uvp", "statt", "einzelpreis", "kg-preis", "l-preis")

# Strict names read by character recognition.
NOISE_WORDS = (
    "aktion", "angebot", "angebote", "klasse", "klassell", "deutschland", "bund", "woche", "maerkten", "märkten", "teilnehmenden", "strasse", "straße", "haftung", "vorrat", "drokthler", "payback", "markt", "filiale",
    "internet", "qr", "deko", "tiefgefroren", "versch", "sorten", "stueck", "stück", "packung", "beutel", "statt",
)
BAD_FRAGMENTS = (
    "er ein genuss", "deutschland ohne deko", "teilnehmenden märkten", "teilnehmenden maerkten", "drokthler haftung", "straße 35", "strasse 35", "der woche", "thunfisch 99", "feaa früchte creen", "feaa fruchte creen",
)
SHORT_NAME_WORDS = ("bio", "xxl", "rot", "mix", "mini", "pak", "choi")
LEAST_LETTERS = 0.68

# Names that only describe, and single words that are enough.
DESCRIPTIVE_ONLY = (
    "tiefgefroren", "gekühlt", "gekuhlt", "frisch", "original", "classic", "klassik", "mild", "natur", "bio", "vegan", "vegetarisch", "extra", "aktion", "knaller", "versch. sorten", "verschiedene sorten", "sortiert",
    "gemischt", "trocken", "gekuehlt", "tiefgekühlt", "tiefgekuehlt", "neu", "angebot", "angebote", "peanut", "gegart", "je st", "je st.",
)
SAFE_SINGLE_WORDS = ("eis", "öl", "milch", "tee", "käse", "butter", "kaffee", "joghurt")
ATTRIBUTE_ONLY = (
    r"^\s*\d{1,3}(?:[.,]\d+)?\s*%\s*(?:vol\.?|fett\s*i\.?\s*tr\.?)?\s*$",
    r"^(?:ca\.?\s*)?(?:tiefgefroren|gekühlt|frisch|original|classic|mild|natur|bio|vegan|vegetarisch|sortiert|gemischt)(?:\s+(?:mild|natur|classic|original|sortiert|gemischt))?$",
)
SCORED_UNITS = ("kg", "g", "l", "ml", "stück", "stk.", "becher", "dose", "flasche", "pckg.", "btl.", "fl.")

# Sizes and unit prices in collected text.
SIZE = r"\b(\d+(?:[.,]\d+)?)\s*[-]?\s*(kg|g|l|ml|stück|stk\.?|becher|dose|flasche|pckg\.?|btl\.?|fl\.?)\b"
MULTI_SIZE = r"\b(\d{1,3})\s*[x×]\s*(\d+(?:[.,]\d+)?)\s*[-]?\s*(kg|g|l|ml)\b"
UNIT_PRICE = r"(?:1\s*)?(kg|l|100\s*g|100\s*ml)\s*=\s*(?:€\s*)?(\d{1,3}(?:[.,]\d{1,2})?)"
EURO_PRICE = r"(\d{1,3}[.,]\d{2})\s*€"
UNIT_PRICE_PARTS = (
    r"\([^)]*\d{1,3}(?:[.,]\d{1,2})?\s*€?\s*/\s*1?\s*(?:kg|l)[^)]*\)",
    r"\([^)]*(?:1\s*)?(?:kg|l|100\s*g|100\s*ml)\s*=\s*(?:€\s*)?\d{1,3}(?:[.,]\d{1,2})?[^)]*\)",
    r"\b\d{1,3}(?:[.,]\d{1,2})\s*€?\s*/\s*(?:1\s*)?(?:kg|l)\b",
    r"\b(?:1\s*)?(?:kg|l|100\s*g|100\s*ml)\s*=\s*(?:€\s*)?\d{1,3}(?:[.,]\d{1,2})\b",
)
ANY_PRICE = r"(?<!\d)(\d{1,3}[.,]\d{2})(?!\d)"

# Wording of validity, in order of precedence, with the name and confidence of what it gives.
DAY_FULL, DAY_SHORT = r"(\d{1,2}\.\d{1,2}\.(?:20)?\d{2})", r"(\d{1,2}\.\d{1,2}\.?)"
VALIDITY = (
    ("this_week_until", 0.99, rf"gültig\s+diese\s+woche\s+bis\s+samstag,?\s*{DAY_FULL}"),
    ("this_week_range", 0.97, rf"diese\s+woche\s+{DAY_SHORT}\s*(?:bis|[–-])\s*{DAY_SHORT}"),
    ("week_offers_range", 0.98, rf"wochenangebote\s+mo\.?,?\s*{DAY_SHORT}\s*[–-]\s*sa\.?,?\s*{DAY_SHORT}"),
    ("explicit_range", 1.0, rf"gültig\s+von\s+\w+,?\s*{DAY_FULL}\s*[-–]\s*\w+,?\s*{DAY_FULL}"),
    ("explicit_range", 1.0, rf"gültig\s+vom\s+{DAY_FULL}\s+bis(?:\s+zum)?\s+{DAY_FULL}"),
    ("explicit_range", 1.0, rf"{DAY_FULL}\s*[–-]\s*{DAY_FULL}"),
    ("ab_montag", 0.95, rf"ab\s+montag,?\s*{DAY_FULL}"),
    ("short_bis_range", 0.94, rf"{DAY_SHORT}\s+bis\s+{DAY_SHORT}"),
    ("short_range", 0.92, rf"{DAY_SHORT}\s*[–-]\s*{DAY_SHORT}"),
    ("calendar_week", 0.9, r"\bKW\s*(\d{1,2})\b"),
)

# The second taxonomy, of collected offers, in order of precedence.
COLLECTED_CATEGORIES = {
    "Kekse & Gebäck": ("butterkeks", "keks", "cookies", "soft cake", "cheez-it"),
    "Kochen & Würzen": ("maggi fix", "fix air fryer", "würzmix", "würz", "sauce", "soße"),
    "Kaffee": ("kaffee", "krönung", "espresso", "prodomo"),
    "Käse": ("weichkäse", "gouda", "patros", "grünländer", "geramont", "géramont"),
    "Joghurt": ("joghurt", "sahnejoghurt"),
    "Süßwaren": ("haribo", "milka", "snickers", "twix", "mr. tom", "fruchtgummi"),
    "Bier": ("pilsener", "bier", "veltins"),
    "Spirituosen": ("gin", "whisky", "whiskey", "rum", "havana club", "johnnie walker", "aperol", "sarti rosa"),
    "Wein & Sekt": ("sekt", "crémant", "cremant", "wein"),
    "Tiefkühl": ("tiefgefroren", "frosta", "iglo", "ofenfrische"),
    "Getränke": ("wasser", "tee", "energy", "valensina", "schweppes", "saft"),
}
COLLECTED_ELSE = "Sonstiges"

# Wording of offers that a shop sells online alone.
EXPLICIT_ONLINE_ONLY = (
    r'"(?:onlineOnly|online_only|isOnlineOnly|webOnly|shopOnly)"\s*:\s*true',
    r'"(?:channel|salesChannel|availability|offerType|badge|label)"\s*:\s*"[^"]*(?:online only|nur online|online-only|onlineshop)[^"]*"',
    r"\bnur\s+online\b",
    r"\bonline\s*only\b",
    r"\bnur\s+im\s+online-?shop\b",
    r"\bshoppe\s+auf\s+lidl\.de\b",
)

# Names of fields in JSON offers, in order of precedence, and the fields in which a value may be wrapped.
JSON_NAMES = ("productName", "product_name", "name", "title", "description", "productTitle", "articleName", "artikelName")
JSON_PRICES = ("price", "sellingPrice", "salesPrice", "offerPrice", "promoPrice", "currentPrice", "finalPrice", "amount")
JSON_REGULAR_PRICES = ("regularPrice", "oldPrice", "originalPrice", "strikePrice", "wasPrice", "uvp", "listPrice")
JSON_APP_PRICES = ("appPrice", "loyaltyPrice", "memberPrice", "clubPrice")
JSON_SIZES = ("packageSize", "packaging", "size", "quantityText", "content", "unitSize", "salesUnit")
JSON_VALID_FROM, JSON_VALID_TO = ("validFrom", "startDate", "start", "from"), ("validTo", "endDate", "end", "to")
JSON_IMAGES = ("image", "imageUrl", "imageURL", "picture", "pictureUrl", "mediaUrl")
JSON_WRAPPERS = ("value", "amount", "price", "formatted")
JSON_OFFER_SIGNALS = ("offer", "angebot", "promotion", "promo", "discount", "aktionspreis", "validfrom", "validto", "startdate", "enddate", "regularprice", "oldprice", "strikeprice", "appprice", "loyaltyprice")

# Pages, containers, catalogues and identifiers in leaflet manifests.
MANIFEST_PAGE_NUMBERS = ("pageNumber", "pageNo", "page_no", "page", "pageIndex", "page_index")
MANIFEST_PAGES = ("pages", "leafletpages", "publicationpages", "catalogpages", "brochurepages", "flyerpages", "documentpages", "pageitems", "pagecontents", "sheets", "spreads")
MANIFEST_CATALOGUES = ("products", "productlist", "productitems", "articles", "articlelist", "items", "catalogueproducts")
MANIFEST_CONTAINERS = ("hotspot", "hotspots", "annotation", "annotations", "promotion", "promotions", "offer", "offers", "angebot", "angebote")
MANIFEST_IDS = (
    "productId", "product_id", "articleId", "article_id", "sku", "skuId", "sku_id", "gtin", "ean", "productCode", "articleNumber", "itemId", "item_id", "productRef", "product_ref", "articleRef", "article_ref",
    "targetId", "target_id", "id",
)
MANIFEST_URLS = ("url", "href", "canonicalUrl", "canonicalURL", "productUrl", "productURL", "deeplink", "deepLink")
URL_IDS = (r"(?:^|[/_-])p(?:-|/)?(\d{6,})(?:\D|$)", r"flyx_content=p-(\d{6,})", r"product(?:id)?[=/:-](\d{6,})")
ONLINE_FLAGS, ONLINE_FIELDS = ("onlineOnly", "online_only", "isOnlineOnly", "webOnly", "shopOnly"), ("channel", "salesChannel", "availability", "offerType", "badge", "label")
ONLINE_VALUES, ONLINE_TEXTS = ("online only", "nur online", "online-only", "onlineshop"), ("nur online", "online only", "nur im onlineshop", "shoppe auf lidl.de")
MOST_CONTAINER_NODES, LONGEST_IDENTIFIER = 80, 160

# Golden results, the watchdog of runs, and rows without a unit price.
GOLDEN_TOLERANCE, GOLDEN_LEAST = 0.011, 0.99
WATCHDOG_SECONDS = 550
PLAUSIBLE_ELSE = 0.08

# Price labels and descriptions on a page.
SAME_LABEL_SHARE, SAME_LABEL_X, SAME_LABEL_Y = 0.22, 48, 38
NO_DESCRIPTIONS = ("gültig ab", "gültig von", "prospekt", "coupon", "punkte sammeln", "rabatt rabatt")

# Lines that can be a card's title, and what is cut off them.
TITLE_QUANTITY = r"\b(?:je\s*)?(?:(\d{1,2})\s*[x×]\s*)?(\d+(?:[,.]\d+)?)\s*[- ]?(kg|g|l|ml|stück|st\.?|packung|becher|dose|flasche|glas|beutel|schale|netz|bund)\b"
TITLE_UNIT_PRICE = r"(?:1\s*)?(kg|l|100\s*g|100\s*ml)\s*(?:=|:)\s*(?:€\s*)?(\d{1,3}(?:[,.]\d{1,2})?)"
TITLE_SINGLE_PACK = r"\bje\s+(?:Stück|Topf|Bund)\b"
TITLE_NOISE = (
    "versch. sorten", "verschiedene sorten", "klasse i", "klasse ii", "fett i. tr", "fett i.tr", "tiefgefroren", "gekühlt", "je ", "1 kg =", "1 l =", "statt ", "mit app", "extra punkte", "haltungsform", "angebot",
    "ready-to-eat", "ready to eat", "mit ", "oder ", "auch ", "festkochend", "klassisch", "schweizer", "naturell", "mild-würzig", "geschmack", "aroma", "getrocknete",
)
TITLE_HEADERS = ("obst & gemüse", "fleisch", "wurst", "käse & kühlregal", "kühlregal & tk", "schnelle küche", "frühstück", "knabbereien", "getränke", "drogerie", "frischfisch-theke")
TITLE_COUNTRIES = ("deutschland", "niederlande", "spanien", "italien", "frankreich", "portugal", "griechenland", "südafrika", "senegal", "peru", "rumänien", "neuseeland")
TITLE_PACKS = ("stück", "packung", "becher", "flasche")
TITLE_DESCRIBED = r"\b(?:klasse|fett|vol\.?|pfand|abtopfgew|packung|becher|flasche|schale)\b"
TITLE_ADVERTS = ("edeka.de", "lebensmittel", "wochenend", "knüller", "payback", "echt nrw", "extra°punkte", "extra punkte")
TITLE_ENDS = r"\b(?:Klasse|Handelsklasse|versch\.?|tiefgefroren|je\s+\d)\b"
TITLE_ORIGIN = r"^(?:Deutschland|Niederlande|Spanien|Italien|Frankreich|Portugal|Griechenland|Österreich)\s+"
TITLE_HOUSE_BRAND = r"^(?:EDEKA|GUT\s*&\s*GÜNSTIG)\s+(?=(?:Mango|Avocado|Zitron|Kartoff|Beeren|Möhren|Zwiebel))"
LONGEST_TITLE, TITLE_SHARE = 65, 0.55

# Validity in a leaflet's own text.
MONTHS = ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")
LEAFLET_WEEKDAY = r"(?:Mo|Di|Mi|Do|Fr|Sa|So)[.]?\s*"
LONGEST_LEAFLET = 14

# Flyers whose pages link to products.
FLYER_PRICES = ("offerPrice", "offer_price", "promotionalPrice", "promotionPrice", "salePrice", "price", "currentPrice", "finalPrice", "salesPrice", "discountPrice", "priceText", "salesPriceText")
FLYER_REGULAR_PRICES = ("regularPrice", "regular_price", "oldPrice", "listPrice", "originalPrice", "wasPrice", "recommendedRetailPrice", "recommended_retail_price", "rrp", "uvp", "referencePrice", "comparisonPrice")
FLYER_IMAGES = ("image", "imageurl", "zoom", "thumbnail", "thumbnailurl", "picture", "pictureurl")
FLYER_ONLINE = ("shoppe auf lidl.de", "nur online", "online only", "nur im onlineshop", "onlineshop")
LOCAL_FLAGS = ("storeOnly", "store_only", "inStore", "in_store", "filialOffer", "filial_offer", "localOffer", "local_offer")
LOCAL_FIELDS, LOCAL_VALUES = ("channel", "salesChannel", "availability", "offerType"), ("store", "in-store", "instore", "filiale", "stationary")
NOT_LOCAL = ("nur online", "online only", "onlineshop")
SHOP_ADDRESSES = ("url", "href", "canonicalUrl", "canonicalURL", "productUrl", "deeplink")
SHOP_PATH, SHOP_QUERY, SHOP_HOST = r"(?:^|/)p(?:/|-)[^/?#]+(?:/p)?\d{6,}(?:$|[/?#])", r"(?:^|[?&])flyx_content=p-\d{6,}(?:$|&)", "lidl.de"

# Families of favourites, the first that fits, and the units left out of their names.
FAVOURITE_UNITS = r"\b\d+(?:[.,]\d+)?\s*(?:g|kg|ml|l|liter|stk|stück|rollen|wl)\b"
FAVOURITE_FAMILIES = {
    "cola": (r"\bcola\b", r"\bkola\b", r"\bcoca cola\b", r"\bpepsi\b", r"\bfreeway\b.*\bcola\b", r"\briver\b.*\bcola\b"),
    "orange-lemonade": (r"\borangenlimonade\b", r"\borange limonade\b", r"\bfanta orange\b", r"\borangina\b"),
    "lemon-lime": (r"\bzitrone limette\b", r"\blemon lime\b", r"\bsprite\b", r"\b7up\b", r"\b7 up\b"),
    "mineral-water": (r"\bmineralwasser\b", r"\btafelwasser\b"),
    "butter": (r"\bbutter\b", r"\bkaergarden\b", r"\bkærgarden\b"),
    "coffee": (r"\bkaffee\b", r"\bcaffe crema\b", r"\bcaffè crema\b", r"\bfilterkaffee\b"),
    "yogurt": (r"\bjoghurt\b", r"\byoghurt\b"),
    "milk": (r"\bvollmilch\b", r"\bmilch\b"),
    "potato-chips": (r"\bchips\b", r"\briffels\b", r"\bpom bär\b", r"\bpombär\b"),
    "laundry-detergent": (r"\bwaschmittel\b", r"\bvollwaschmittel\b", r"\bcolorwaschmittel\b"),
    "toilet-paper": (r"\btoilettenpapier\b", r"\bklopapier\b"),
}
