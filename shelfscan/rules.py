"""Word lists, lookup tables and patterns.

Fixed values: every list, table and pattern in this file must stay as it is for
results to agree with the catalogues this engine reproduces.
"""

# URLs kept per site, and the other numeric limits of the crawl.
MAX_URLS = 5_000
MIN_PATTERN_MATCHES = 5
NAV_SEED_LIMIT = 20
API_PAGE_SIZE = 100
MAX_ATTEMPTS = 3

# Where sitemaps are looked for, in this order, after those named by robots.txt.
SITEMAP_PATHS = [
    "/sitemap.xml",
    "/sitemap_index.xml",
    "/sitemap.php",
    "/sitemap/sitemap.xml",
    "/sitemap/index.xml",
    "/xmlsitemap.php",
    "/xmlsitemap.php?type=products&page=1",
    "/sitemap/",
    "/wp-sitemap.xml",
    "/page-sitemap.xml",
    "/product-sitemap.xml",
    "/products-sitemap.xml",
    "/catalog/sitemaps/catalog.xml",
    "/media/sitemap/sitemap.xml",
]

# REST product lists, best first: (path up to the page number, name).
API_ENDPOINTS = [
    ("/wp-json/wc/v3/products?per_page=100&page=", "WooCommerce"),
    ("/wp-json/wc/v2/products?per_page=100&page=", "WooCommerce v2"),
    ("/api/products?limit=100&page=", "generic-api"),
    ("/api/v1/products?limit=100&page=", "generic-api-v1"),
    ("/api/v2/products?limit=100&page=", "generic-api-v2"),
]

PRODUCT_FEED_MARK = "type=products"
CATEGORY_PAGE_SUFFIX = ("?q=%3Arelevance&page=", "&pageSize=96")

# Path fragments that suggest a product page.
PRODUCT_URL_SIGNALS = [
    "/product", "/products", "/shop", "/item", "/items",
    "/catalog", "/catalogue", "/p/", "/goods", "/pd/",
    "/store", "/buy", "/listing", "/detail", "/offering",
    "/equipment", "/machine", "/device", "/solution", "/model",
    "/collection", "/collections", "/service", "/part",
    "/inventory", "/line", "/range", "/series", "/variant",
]

# Path fragments that rule a product page out.
SKIP_URL_FRAGMENTS = [
    "/blog", "/news", "/about", "/contact", "/faq",
    "/cart", "/checkout", "/account", "/login", "/register",
    "/search", "/wishlist", "/compare", "/sitemap", "/tag/",
    "/author", "/policy", "/privacy", "/shipping", "/returns",
    "/help", "/support", "/terms", "/legal", "/cookie",
    "/press", "/career", "/job", "/team", "/partner",
    "/event", "/webinar", "/newsletter", "/forum", "/community",
]

SKIP_EXTENSIONS = [
    ".pdf", ".jpg", ".jpeg", ".png", ".gif", ".svg",
    ".css", ".js", ".ico", ".zip", ".gz", ".mp4", ".mp3", ".webp",
]

UNFOLLOWED_SCHEMES = ["javascript", "mailto", "tel:", "data:"]

AVAILABILITY = {
    "http://schema.org/instock": "in_stock",
    "https://schema.org/instock": "in_stock",
    "instock": "in_stock",
    "in stock": "in_stock",
    "in_stock": "in_stock",
    "http://schema.org/outofstock": "out_of_stock",
    "https://schema.org/outofstock": "out_of_stock",
    "outofstock": "out_of_stock",
    "out of stock": "out_of_stock",
    "out_of_stock": "out_of_stock",
    "http://schema.org/limitedavailability": "in_stock",
    "https://schema.org/limitedavailability": "in_stock",
    "limitedavailability": "in_stock",
    "preorder": "out_of_stock",
    "http://schema.org/preorder": "out_of_stock",
    "https://schema.org/preorder": "out_of_stock",
    "discontinue": "out_of_stock",
    "soldout": "out_of_stock",
    "sold out": "out_of_stock",
}

CURRENCY_SYMBOLS = {"$": "USD", "£": "GBP", "€": "EUR", "¥": "JPY", "₹": "INR"}

# Substrings of a bot check served in place of the page.
CHALLENGE_MARKERS = [
    "cf-browser-verification",
    "challenge-platform",
    "window.isBotPage",
    "sgcaptcha",
    "Just a moment",
    "Enable JavaScript and cookies to continue",
    "Checking your browser",
    "DDoS protection by",
]
SHELL_TEXT_LIMIT = 200
BLOCKED_STATUSES = [403, 429, 503]

SOLD_OUT_PHRASES = ["out of stock", "sold out", "discontinued"]

# Patterns (Java syntax). (?iU) is case-insensitive with Unicode classes.
HREF = r'(?U)href="([^"#\s]{3,300})"'
CATEGORY_HREF = r'href="(/[^"]+/c/\d+[^"]*)"'
CATEGORY_PRODUCT_HREF = r'href="(/[^"]+/p/[^"]+)"'
EMBEDDED_URL = r'(?U)"url"\s*:\s*"(/[^"]{5,200})"'
FEED_PAGE = r"[&?]page=(\d+)"
PRICE_NUMBER = r"(\d+\.?\d*)"

PRICE_CLASS = (
    r"(?iU)(price|sale[\-_]?price|current[\-_]?price|"
    r"offer[\-_]?price|special[\-_]?price|now[\-_]?price)"
)

SKU_LABEL = (
    r"(?iU)(sku|item\s*#|part\s*#|model\s*#|product\s*id|"
    r"part\s*no\.?|item\s*no\.?|cat\s*no\.?|catalog\s*no\.?|"
    r"ref\s*no\.?|reference\s*no\.?|article\s*no\.?)\s*[:\-]?\s*"
)

OFFER_LANGUAGE = (
    r"(?iU)request\s+a?\s*quote|get\s+a?\s*quote|contact\s+for\s+pric|"
    r"request\s+pricing|enquire\s+now|ask\s+for\s+price|"
    r"download\s+datasheet|request\s+a?\s*demo|get\s+a?\s*sample|"
    r"add\s+to\s+cart|buy\s+now|add\s+to\s+bag|order\s+now|"
    r"purchase\s+now|inquire\s+now|get\s+a?\s*free\s+trial|"
    r"request\s+information|learn\s+more\s+about\s+this|"
    r"contact\s+us\s+for|get\s+a?\s*price|request\s+a?\s*callback"
)

BRAND_ATTRIBUTE = r"(?iU)brand"
BRAND_PHRASE = r"(?iU)(?:brand|manufacturer|made\s+by)\s*[:\-]?\s*([A-Za-z0-9 &\-]+)"

LISTING_PRICE_ELEMENTS = 5
LABEL_START_LIMIT = 30
SKU_LENGTH_LIMIT = 80
SPEC_KEY_LIMIT = 80
PRODUCT_ID_HASH_LENGTH = 16

# Reasons and states written to a catalogue.
REASON_NO_URLS = "no URLs discovered — site may be fully blocked or has no accessible sitemap"
REASON_NO_PRODUCTS = "URLs discovered but no product pages detected"
DISCOVERY_STATES = ["complete", "partial", "blocked", "bot_wall", "no_sitemap", "extractor_failure"]
AVAILABILITY_STATES = ["in_stock", "out_of_stock", "unknown"]
