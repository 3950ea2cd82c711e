"""Word lists, paths and defaults that decide results.

They are plain data, kept together in the order in which they are applied.
"""

# --- fixed values: links never followed by page discovery (lower-cased URL) ----
DISCOVERY_SKIP = (
    "#", "javascript:", "mailto:", "tel:", "ftp://",
    ".pdf", ".jpg", ".jpeg", ".png", ".gif", ".svg",
    ".css", ".js", ".xml", ".zip", ".tar", ".gz",
)

# --- fixed values: URLs never kept from a sitemap (lower-cased URL) ------------
SITEMAP_SKIP = (
    "#", "mailto:", "javascript:", "tel:", "ftp:",
    ".pdf", ".zip", ".exe", ".jpg", ".jpeg", ".png", ".gif",
    ".css", ".js", ".xml", ".json",
)

# --- fixed values: crawl modes: tag in the result, substrings that make a link
# worth following, links followed per page ----------------------------------
CRAWL_MODES = {
    "docs": (
        "documentation",
        ("/docs/", "/documentation/", "/guide/", "/tutorial/", "/api/", "/reference/"),
        10,
    ),
    "research": (
        "research",
        ("/wiki/", "/article/", "/study/", "/research/", "/paper/"),
        8,
    ),
    "map": (
        "structure",
        ("/about/", "/contact/", "/services/", "/products/", "/blog/", "/news/"),
        12,
    ),
}

# --- fixed values: markup removed before anything is extracted -----------------
SCRIPT_TAGS = ("script", "style", "noscript")
NAVIGATION_TAGS = ("nav", "header", "footer", "aside", "menu")
BOILERPLATE_CLASSES = (
    "sidebar", "navigation", "menu", "breadcrumb", "footer", "header",
    "advertisement", "ad", "social", "share", "comment", "related",
)
TEXT_REMOVED_TAGS = ("script", "style", "nav", "header", "footer")
CRAWL_REMOVED_TAGS = ("script", "style", "nav", "header", "footer", "aside")
MARKDOWN_REMOVED_TAGS = ("script", "style", "nav", "header", "footer", "aside")

# --- fixed values: main container selectors, best first ------------------------
CONTENT_SELECTORS = (
    "main", "article", ".content", ".main-content", ".post-content",
    ".entry-content", ".documentation",
)
CRAWL_CONTENT_SELECTORS = ("main", "article", "div.content", "body")

# --- fixed values: title separators, cut in this order --------------------------
TITLE_SEPARATORS = (" | ", " - ", " — ", " :: ")
CRAWL_TITLE_SEPARATORS = (" | ", " - ", " — ")

# --- fixed values: class tokens that name a code language ----------------------
CODE_LANGUAGES = ("python", "javascript", "js", "html", "css", "json", "xml")

# --- fixed values: sitemap locations -----------------------------------------
XML_SITEMAP_PATHS = (
    "/sitemap.xml", "/sitemap_index.xml", "/sitemap/sitemap.xml",
    "/sitemaps/sitemap.xml", "/sitemap1.xml", "/sitemap_news.xml",
    "/sitemap_products.xml",
)
HTML_SITEMAP_PROBES = ("/sitemap", "/sitemap.html", "/site-map", "/links", "/all-pages")
HTML_SITEMAP_PATHS = (
    "/sitemap", "/sitemap.html", "/sitemap.htm", "/site-map", "/site-map.html",
    "/links", "/all-pages", "/directory",
)
SITEMAP_NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"

# --- fixed values: URL types, the first that matches wins, else "other" --------
URL_TYPES = (
    ("documentation", ("/docs/", "/documentation/", "/guide/")),
    ("api", ("/api/", "/reference/")),
    ("guides", ("/guides/", "/how-to/")),
    ("tutorials", ("/tutorial/", "/tutorials/")),
    ("blog", ("/blog/", "/news/", "/articles/")),
)
URL_TYPE_OTHER = "other"

# --- fixed values: texts that appear in results --------------------------------
UNTITLED = "Untitled"
CRAWL_UNTITLED = "Unknown Title"
FAILED_TITLE = "Error Processing Content"
FAILED_DESCRIPTION = "Failed to process content"
OTHER_CATEGORY = "Other"
OTHER_LABEL = "Optional"
LINK_SOURCE = "link_discovery"
EMPTY_URL_ERROR = "URL is required and cannot be empty"

# --- fixed values: defaults of a site row ---------------------------------------
DEFAULT_NAME = "Website Documentation"
DEFAULT_DESCRIPTION = "Documentation generated from website"
DEFAULT_URLS = ("https://example.com",)
DEFAULT_MAX_PAGES = 100
DEFAULT_MAX_DEPTH = 3
DEFAULT_MODE = "docs"
DEFAULT_CRAWL_PAGES = 30

# --- fixed values: what counts as blank and as a line break in text -------------
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAKS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
