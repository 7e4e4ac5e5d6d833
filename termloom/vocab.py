"""Word lists, the seed taxonomy and the page selectors."""

from __future__ import annotations

# The English base stop words that Spark ships (StopWordsRemover).
BASE_STOP_WORDS: tuple[str, ...] = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
her hers herself it its itself they them their theirs themselves what which who whom this that
these those am is are was were be been being have has had having do does did doing a an the and
but if or because as until while of at by for with about against between into through during
before after above below to from up down in out on off over under again further then once here
there when where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll
i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't
shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's
what's when's where's who's why's would
""".split())

# Web boilerplate and weak words, added to the base list.
DOMAIN_STOP_WORDS: tuple[str, ...] = tuple("""
privacy policy rights reserved copyright cookies terms conditions contact about home
read more click login signup register subscribe newsletter share follow like tweet
menu search close back next previous page loading error skip content section article
updated published author posted date time year month day week hour minute
also including please note however therefore within without between through during
https http www com org net html
information details process services service platform system company business solution
available provide required need ensure different various general specific important
following example includes related
""".split())

STOP_WORDS: frozenset[str] = frozenset(BASE_STOP_WORDS) | frozenset(DOMAIN_STOP_WORDS)

# Topics in priority order, each with its seed terms.
TOPIC_SEEDS: dict[str, tuple[str, ...]] = {
    "Work Permits": (
        "work permit", "work visa", "employment visa", "labour market", "job offer",
        "employer", "sponsored", "sponsorship", "lmia", "work authorization",
        "temporary worker", "skilled worker", "professional visa", "h1b", "h-1b",
        "tier 2", "intracompany", "intra-company",
    ),
    "Permanent Residency": (
        "permanent resident", "permanent residency", "green card", "pr application",
        "express entry", "skilled immigrant", "points based", "pr status",
        "indefinite leave", "settlement", "permanent stay", "pr visa",
    ),
    "Visas & Entry": (
        "tourist visa", "visitor visa", "entry visa", "travel visa", "e-visa",
        "evisa", "visa application", "visa requirements", "visa fee", "visa approval",
        "schengen", "multiple entry", "single entry", "visa on arrival",
        "transit visa", "airport transit",
    ),
    "EU Blue Card": (
        "blue card", "eu blue card", "european blue card", "bluecard",
        "highly qualified", "high salary", "minimum salary", "salary threshold",
    ),
    "Family Immigration": (
        "family reunification", "family visa", "spouse visa", "dependent visa",
        "partner visa", "child visa", "family member", "join family",
        "family immigration", "family sponsorship",
    ),
    "Study & Student Visas": (
        "student visa", "study visa", "study permit", "student permit",
        "university", "college", "educational institution", "academic",
        "enrollment", "tuition", "international student",
    ),
    "Citizenship & Naturalization": (
        "citizenship", "naturalization", "naturalisation", "passport",
        "dual citizenship", "nationality", "citizen", "national",
    ),
    "Application Process": (
        "application form", "apply online", "submit application", "processing time",
        "application fee", "biometrics", "medical exam", "background check",
        "interview", "appointment", "documentation", "supporting documents",
        "required documents", "checklist",
    ),
    "Costs & Fees": (
        "cost", "fee", "price", "charge", "payment", "salary", "minimum wage",
        "income requirement", "financial requirement", "bank statement",
    ),
    "Country-Specific": (
        "canada", "australia", "germany", "france", "united kingdom", "spain",
        "netherlands", "sweden", "norway", "denmark", "new zealand", "portugal",
        "ireland", "austria", "belgium", "switzerland", "usa", "united states",
        "india", "china", "brazil", "mexico",
    ),
    "Relocation & Settlement": (
        "relocat", "settlement", "moving abroad", "expat", "expatriate",
        "housing", "accommodation", "rent", "cost of living", "banking",
        "healthcare", "insurance", "language requirement",
    ),
}
FALLBACK_TOPIC = "General"

# Elements that are never page content.
BOILERPLATE_TAGS = (
    "script", "style", "noscript", "iframe", "nav", "footer", "header", "aside", "menu",
    "form", "input", "textarea", "select", "button", "label", "svg", "canvas", "dialog",
)
BOILERPLATE_ATTRIBUTES = (("role", "dialog"), ("aria-hidden", "true"))
BOILERPLATE_CLASSES = (
    "ads", "ad", "advertisement", "modal", "popup", "cookie", "cookie-banner", "banner",
    "newsletter", "sidebar", "widget", "breadcrumb", "pagination", "social-share",
)
BOILERPLATE_IDS = ("ads",)
BOILERPLATE_CLASS_PARTS = ("cookie", "banner", "popup", "modal")
BOILERPLATE_ID_PARTS = ("cookie", "banner")

# Where the main content may sit, best place first, as (kind, name).
MAIN_PLACES = (
    ("tag", "main"), ("tag", "article"), ("role", "main"),
    ("class", "content"), ("id", "content"), ("id", "main"),
    ("class", "post-content"), ("class", "entry-content"), ("class", "article-body"),
    ("tag", "body"),
)

# The sections of a gap report, in output order.
GAP_SECTIONS = (
    "commonly_used_keywords",
    "underutilized_opportunities",
    "long_tail_opportunities",
    "semantic_keywords",
    "ranking_recommendations",
)

# The section of the gap rows that concern one page each.
PAGE_SECTION = "page_recommendations"

# Error texts that other steps and reports rely on.
INSUFFICIENT_CONTENT = "Insufficient content extracted"
