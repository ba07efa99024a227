"""Rule tables, as data. Operators take them as parameters; these are the defaults."""

from __future__ import annotations

# Niche rules as (niche, keywords, topics, audiences), in order; the first of equal scores wins.
NICHES = (
    ("fitness coaching", ("fitness", "gym", "workout", "training", "coach", "weight loss", "fat loss", "body transformation"), ("gym routines", "fitness transformations", "nutrition", "weight loss"), ("gym beginners", "wellness seekers")),
    ("personal finance", ("finance", "investing", "budget", "credit", "debt", "cash flow", "wealth", "money habits"), ("budgeting", "saving", "investing", "debt payoff"), ("young professionals", "students")),
    ("beauty & skincare", ("skincare", "beauty", "makeup", "routine", "haircare", "self care", "cosmetics"), ("skincare routines", "product reviews", "beauty tutorials"), ("beauty shoppers", "women 18-34")),
    ("ecommerce & marketing", ("ecommerce", "shopify", "marketing", "ads", "creative strategy", "conversion", "funnel", "ugc"), ("paid ads", "creative testing", "conversion optimization", "ugc performance"), ("brand owners", "marketers")),
    ("ai productivity", ("ai", "automation", "agent", "prompt", "workflow", "notion", "productivity", "systems"), ("ai tools", "automation workflows", "productivity systems"), ("founders", "operators")),
    ("real estate investing", ("real estate", "property", "mortgage", "airbnb", "rental", "wholesale", "investor"), ("real estate leads", "cash flow", "property investing"), ("first-time investors", "real estate buyers")),
    ("business coaching", ("coaching", "consulting", "mentor", "strategy call", "service provider", "agency", "clients"), ("offer positioning", "client acquisition", "service delivery"), ("coaches", "solopreneurs")),
    ("wellness & nutrition", ("wellness", "nutrition", "meal plan", "hormone", "healthy lifestyle", "supplements"), ("nutrition plans", "healthy habits", "wellness routines"), ("health-conscious adults", "wellness seekers")),
    ("creator monetization", ("creator", "content creator", "influencer", "ugc creator", "creator store", "stan store", "brand deals"), ("creator economy", "brand partnerships", "digital products"), ("content creators", "solopreneurs")),
)
DEFAULT_NICHE = "creator monetization"

# Signals by keyword, in order.
TOPICS = (
    ("ugc content", ("ugc", "user generated content", "creator content")), ("affiliate marketing", ("affiliate", "commission", "rev share")), ("digital products", ("template", "ebook", "guide", "digital product")),
    ("coaching offers", ("coaching", "strategy call", "book a call")), ("membership growth", ("membership", "community", "join")), ("newsletter growth", ("newsletter", "substack", "subscribe")),
    ("personal branding", ("personal brand", "thought leadership")), ("paid ads", ("meta ads", "facebook ads", "tiktok ads", "paid ads")), ("sales funnels", ("funnel", "landing page", "checkout")),
    ("fitness routines", ("workout", "gym", "routine")), ("nutrition", ("nutrition", "meal plan", "macros")), ("skincare", ("skincare", "skin", "beauty")), ("investing", ("invest", "portfolio", "stocks")),
    ("budgeting", ("budget", "debt", "credit")), ("real estate", ("real estate", "property", "mortgage")), ("ai automation", ("automation", "ai", "agent", "prompt")),
)
AUDIENCES = (
    ("content creators", ("creator", "influencer", "ugc creator")), ("founders", ("founder", "startup", "operator")), ("coaches", ("coach", "coaching", "mentor")), ("brand owners", ("brand owner", "ecommerce", "shopify")),
    ("young professionals", ("young professionals", "career", "9-5")), ("students", ("student", "college", "study")), ("fitness beginners", ("fitness beginners", "gym beginner", "weight loss")),
    ("beauty shoppers", ("beauty", "skincare", "makeup")), ("real estate buyers", ("home buyer", "mortgage", "real estate")),
)
PRODUCTS = (
    ("coaching", ("coaching", "strategy call", "book a call")), ("course", ("course", "program", "masterclass")), ("template", ("template", "notion", "swipe file")), ("membership", ("membership", "community", "mastermind")),
    ("newsletter", ("newsletter", "substack")), ("digital guide", ("ebook", "guide", "pdf")), ("service", ("service", "done for you", "agency")), ("ugc package", ("ugc package", "ugc bundle", "content package")),
)
INTENTS = (
    ("direct_purchase", ("buy", "checkout", "purchase", "shop now")), ("lead_generation", ("book", "apply", "consult", "strategy call")), ("affiliate", ("affiliate", "commission", "rev share")),
    ("community", ("join community", "membership", "newsletter", "subscribe")), ("ugc", ("ugc", "user generated content")), ("digital_product", ("template", "course", "guide", "ebook")),
)

# Keywords of a brand's intents, and the weights of the modules for each intent.
MODULES = ("niche", "topic", "platform", "audience", "engagement")
INTENT_KEYWORDS = {
    "product_sale": ("sales", "conversion", "purchase", "revenue", "cpm", "affiliate", "checkout", "direct response"),
    "creator_enablement": ("ugc", "creator content", "content production", "awareness", "brand awareness", "creative testing"),
    "b2b_leadgen": ("lead", "demo", "trial", "book call", "pipeline", "appointment", "saas", "b2b"),
    "community": ("community", "newsletter", "membership", "retention", "subscriber", "discord"),
}
POLICIES = {
    "product_sale": (0.35, 0.30, 0.10, 0.15, 0.10),
    "creator_enablement": (0.10, 0.20, 0.10, 0.35, 0.25),
    "b2b_leadgen": (0.10, 0.25, 0.10, 0.35, 0.20),
    "community": (0.10, 0.20, 0.10, 0.40, 0.20),
}

# Priors by platform.
PLATFORMS = ("x", "instagram", "linkedin", "tiktok", "youtube", "unknown")
VIEW_RATE = {"instagram": 0.11, "tiktok": 0.23, "youtube": 0.18, "x": 0.07, "linkedin": 0.09, "unknown": 0.1}
ENGAGEMENT = {"instagram": 0.032, "tiktok": 0.053, "youtube": 0.041, "x": 0.017, "linkedin": 0.024, "unknown": 0.03}

# Groups of niches, and prices for a thousand views, first match first.
NICHE_GROUPS = (
    ("Business", ("business coaching", "creator monetization", "ecommerce & marketing", "ecommerce growth", "b2b saas", "startups & entrepreneurship", "careers & job search", "personal finance", "real estate investing")),
    ("Technology", ("ai productivity", "ai tools", "consumer tech & gadgets")), ("Education", ("education & upskilling", "study productivity")), ("Fitness", ("fitness coaching", "fitness", "sports & outdoors")),
    ("Wellness", ("wellness & nutrition", "mental wellness")), ("Cooking", ("healthy cooking", "food & recipes")), ("Fashion", ("fashion & apparel",)), ("Lifestyle", ("life coaching", "home & decor", "parenting & family")),
    ("Skincare", ("beauty & skincare", "skincare")), ("Pet", ("pets",)), ("Travel", ("travel",)), ("Gaming", ("gaming",)),
)
CPM = (("fitness|wellness|nutrition|gym", 25), ("finance|invest", 55), ("saas|b2b|software", 75), ("beauty|skincare|fashion", 28), ("ecom|ecommerce|marketing", 35))
CPM_OTHERWISE = 22

# Page filters.
CHALLENGE_MARKS = ("captcha", "verify you are human", "are you human", "cloudflare", "attention required", "cf-chl", "/cdn-cgi/challenge-platform", "perimeterx", "bot protection", "bot detection", "request blocked", "access denied")
PAGE_HINTS = ("pricing", "features", "product", "solutions", "customers", "case", "stories", "about", "company", "blog", "partners", "enterprise", "careers", "contact")
PAGE_JUNK = "privacy|terms|legal|cookie|sitemap|rss|login|signup|auth"

# Hosts that are no personal domains; search plans as (id, platform, hosts, path prefix, terms).
SOCIAL_HOSTS = ("x.com", "twitter.com", "instagram.com", "linkedin.com", "tiktok.com", "youtube.com", "youtu.be", "stan.store")
SEARCH_HOSTS = ("google.com", "serpapi.com", "gstatic.com", "ytimg.com")
PLANS = (
    ("x_stan_creators", "x", ("x.com", "twitter.com"), "", ("stan.store",)), ("instagram_stan_creators", "instagram", ("instagram.com",), "", ("stan.store",)), ("linkedin_stan_creators", "linkedin", ("linkedin.com",), "/in", ("stan.store",)),
    ("tiktok_stan_creators", "tiktok", ("tiktok.com",), "", ("stan.store",)), ("youtube_stan_creators", "youtube", ("youtube.com", "youtu.be"), "", ("stan.store",)),
)

# What a brand's intake form says, as (label, goal, topic).
PARTNERSHIPS = {
    "affiliate": ("affiliate program", "drive affiliate sales", "affiliate creators"), "sponsored_video": ("sponsored videos", "run sponsored video placements", "brand integration videos"),
    "ugc": ("UGC assets", "source UGC creative", "ugc creators"), "ambassador": ("ambassador partnership", "secure long-term ambassadors", "creator ambassadors"),
}
COMPENSATIONS = {
    "flat_fee": ("flat fee", "predictable flat-fee creator deals", "flat fee collaborations"), "cpm": ("CPM (per 1k views)", "performance-priced creator deals", "cpm creator pricing"),
    "rev_share": ("revenue share", "commission-based creator deals", "affiliate commission campaigns"), "hybrid": ("hybrid compensation", "hybrid creator compensation", "hybrid creator partnerships"),
}

# Patterns of free-text intent, in order.
PARTNERSHIP_WORDS = (("ugc", "ugc"), ("affiliate|commission", "affiliate"), ("ambassador", "ambassador"), ("sponsored|sponsor", "sponsored_video"))
GOAL_WORDS = (
    ("brand awareness|awareness|reach|top of funnel", "brand awareness"), ("sales|revenue|conversion|conversions|purchase|checkout|roi", "direct sales"), ("ugc|content library|creative asset|ad creative", "ugc content library"),
    ("app installs?|installs?|downloads?|sign[- ]?ups?|activations?", "app installs and signups"), ("traffic|site visits?|landing page clicks?", "qualified traffic"), ("leads?|pipeline|demo requests?|booked demos?", "lead generation"),
)
PLATFORM_WORDS = (("instagram", "instagram|insta|ig"), ("tiktok", "tiktok|tt"), ("youtube", "youtube|yt|youtu\\.be"), ("x", "x\\.com|twitter|x"), ("linkedin", "linkedin|li"))

# Profile links in texts, as platform: (pattern, host of the normal form); first path parts that are no profiles.
PROFILE_LINKS = {
    "instagram": (r"(?i)https?://(?:www\.)?instagram\.com/[a-zA-Z0-9._]+/?", "instagram.com"), "x": (r"(?i)https?://(?:www\.)?(?:x\.com|twitter\.com)/[a-zA-Z0-9_]+/?", "x.com"),
    "linkedin": (r"(?i)https?://(?:[A-Za-z0-9_-]+\.)?linkedin\.com/(?:in|company)/[a-zA-Z0-9_%-]+/?", "linkedin.com"), "tiktok": (r"(?i)https?://(?:www\.)?tiktok\.com/@[a-zA-Z0-9._]+/?", "tiktok.com"),
    "youtube": (r"(?i)https?://(?:www\.)?youtube\.com/(?:@[A-Za-z0-9_.-]+|channel/[A-Za-z0-9_-]+|c/[A-Za-z0-9_.-]+|user/[A-Za-z0-9_.-]+)/?", "youtube.com"),
}
RESERVED_IN_TEXTS = {"instagram": ("p", "reel", "reels", "explore", "stories", "accounts", "about"), "x": ("home", "search", "explore", "i", "intent", "settings")}

# How texts give a platform's handles, the surest way first.
TEXT_HANDLES = {
    "x": (r"\(\s*@([A-Za-z0-9_]{1,15})\s*\)", r"(?i)(?<![A-Za-z0-9_])(?:x|twitter)\s*·\s*([A-Za-z0-9_]{1,15})(?![A-Za-z0-9_])", "@([A-Za-z0-9_]{1,15})"),
    "instagram": (r"\(\s*@([A-Za-z0-9._]{2,30})\s*\)", r"(?i)(?<![A-Za-z0-9_])instagram\s*·\s*([A-Za-z0-9._]{2,30})(?![A-Za-z0-9_])", "@([A-Za-z0-9._]{2,30})"),
    "linkedin": ("(?i)linkedin\\.com/in/([A-Za-z0-9_%-]{2,120})", "(?i)linkedin\\.com/company/([A-Za-z0-9_%-]{2,120})"),
    "tiktok": ("(?i)tiktok\\.com/@([A-Za-z0-9._]{2,24})", r"\(\s*@([A-Za-z0-9._]{2,24})\s*\)", "@([A-Za-z0-9._]{2,24})"), "youtube": ("(?i)youtube\\.com/@([A-Za-z0-9._-]{2,60})", "@([A-Za-z0-9._-]{2,60})"),
}

# Hosts that a store page links to for its own ends, and social hosts.
OWN_HOSTS = ("google.", "gstatic.com", "clarity.ms", "googletagmanager.com", "googleapis.com", "stanwith.me")
SOCIAL_LINKS = r"(?i)(x\.com|twitter\.com|instagram\.com|linkedin\.com|tiktok\.com|youtube\.com|youtu\.be|facebook\.com)"
#: Marks of a challenge page that the site reader looks for.
SITE_CHALLENGE_MARKS = ("captcha", "verify you are human", "attention required", "cloudflare", "cf-chl", "/cdn-cgi/challenge-platform", "perimeterx", "bot protection", "access denied", "request blocked")

# Words that are no priorities, and words that show that a phrase is none.
PRIORITY_STOP = ("any", "best", "better", "content", "creator", "creators", "influencer", "influencers", "more", "someone", "strong", "stronger", "top")
PRIORITY_NOISE = ("around", "explain", "find", "fit", "fits", "give", "match", "matches", "recommend", "send", "show", "top", "why", "who")

# Searches over a brand's site, as (label, words); the brand's name goes first where it is known.
SITE_SEARCHES = (("about", '"about"'), ("products", '"products" OR "shop"'), ("company", '"company" OR "mission"'), ("press", '"press" OR "news"'), ("careers", '"careers" OR "team"'))
#: Searches on the open web for a brand.
WEB_SEARCHES = ("brand overview", "company mission values", "products and target audience", "wikipedia", "press release")

# Selling style by call to action, else by intent; content style by selling style, else by topic.
STYLE_OF_CTA = {"consultative": "consultative", "transactional": "direct_response", "community": "community_led", "inbound_dm": "dm_conversion"}
STYLE_OF_INTENT = (("direct_purchase", "direct_response"), ("lead_generation", "consultative"), ("community", "community_led"))
STYLE_OTHERWISE = "educational"
CONTENT_OF_STYLE = {
    "consultative": "consultative coaching-style content", "direct_response": "direct response offer-led content", "community_led": "community and newsletter-led content",
    "dm_conversion": "personal brand and DM-led conversion content",
}
CONTENT_OF_TOPIC = ("ugc content", "ugc demonstration content")
CONTENT_OTHERWISE = "educational creator content"

# Patterns of pay in free text, in order; any match holds one of the marks behind its pattern.
COMPENSATION_WORDS = (
    ("hybrid", r"(^|[^A-Za-z0-9_])hybrid([^A-Za-z0-9_]|$)", ("hybrid",)), ("rev_share", r"(^|[^A-Za-z0-9_])(rev(enue)?\s*share|commission)([^A-Za-z0-9_]|$)", ("share", "commission")),
    ("cpm", r"(^|[^a-z0-9_])cpm|per\s*(1k|1000|thousand)|/\s*(1k|1000)(\s*views?)?", ("cpm", "1k", "1000", "thousand")), ("flat_fee", r"(^|[^A-Za-z0-9_])(flat\s*fee|fixed\s*fee)([^A-Za-z0-9_]|$)", ("fee",)),
)
UNIT_WORDS = (("per_1k_views", r"(per|/)\s*(1k|1000)(\s*views?)?", ("1k", "1000")), ("per_post", r"per\s*post", ("post",)), ("per_video", r"per\s*video", ("video",)))
SPEND_WORDS = ("budget", "pay", "price", "cost", "spend", "fee", "cpm")
#: What money is spoken of by besides: pattern and marks.
SPEND_PER = (r"per\s*(video|post|1k|1000)", ("video", "post", "1k", "1000"))
NO_BUDGET = ("no fixed budget", "no budget", "open budget", "flexible budget", "budget tbd")
