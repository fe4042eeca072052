"""Fixed values that results depend on."""

# Paths, extensions and parameters of URLs.
PRIORITY_KEYWORDS = ["about", "team", "contact", "leadership", "management", "people", "executives", "staff", "company"]
BLOCKED_PATHS = ["cdn-cgi", "wp-json", "wp-admin", "wp-includes", "feed", "xmlrpc.php", "privacy", "terms", "advertise", "get-listed", "press-releases", "blog", "cookies", "legal", "sitemap", "careers", "faq"]
BLOCKED_EXTENSIONS = [".pdf", ".png", ".jpg", ".jpeg", ".svg", ".gif", ".webp", ".zip", ".tar", ".gz", ".css", ".js", ".ico", ".mp4", ".mp3", ".xml", ".json"]
IGNORED_PARAMS = ["utm_", "fbclid", "gclid", "sort_by", "location", "project_cost", "filter_by_service", "verified", "rating", "review_sort", "search"]
REDIRECT_PARAMS = ["url", "u", "target", "destination", "redirect", "redirect_url"]
SOCIAL_DOMAINS = ["linkedin.com", "facebook.com", "instagram.com", "twitter.com", "x.com", "youtube.com", "tiktok.com", "pinterest.com", "wa.me", "whatsapp.com", "google.com", "maps.google.com", "apple.com", "play.google.com"]
TWITTER_RESERVED = ["share", "intent", "home", "hashtag", "search", "i", "explore", "settings"]

# E-mail.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
FREE_PROVIDERS = ["gmail.com", "googlemail.com", "yahoo.com", "yahoo.co.uk", "hotmail.com", "outlook.com", "live.com", "msn.com", "icloud.com", "me.com", "aol.com", "proton.me", "protonmail.com", "gmx.com", "gmx.net", "mail.com", "seznam.cz", "web.de", "yandex.com", "zoho.com"]
PLACEHOLDER_EMAILS = ["you@work.com", "name@domain.com", "email@example.com", "user@example.com", "test@example.com", "john.doe@example.com", "your@email.com"]
PLACEHOLDER_LOCALS = ["you", "name", "email", "user", "example", "test"]
DISPOSABLE_DOMAINS = ["mailinator.com", "tempmail.com", "guerrillamail.com", "10minutemail.com", "trashmail.com", "yopmail.com", "getnada.com", "throwawaymail.com", "sharklasers.com", "dispostable.com", "temp-mail.org", "fakeinbox.com"]
ROLE_LOCALS = ["info", "contact", "sales", "support", "hello", "admin", "team", "office", "mail", "enquiries", "enquiry", "careers", "jobs", "hr", "marketing", "press", "media", "billing", "accounts", "legal", "privacy", "help", "service", "services", "inquiry", "inquiries", "connect", "hi", "hey", "welcome", "noreply", "no-reply"]
FIRST_NAMES = [
    "james", "john", "robert", "michael", "david", "william", "richard", "joseph", "thomas", "charles", "daniel", "matthew", "anthony", "mark", "paul", "steven",
    "andrew", "joshua", "kevin", "brian", "george", "edward", "ryan", "jacob", "nicholas", "eric", "jonathan", "justin", "brandon", "adam", "nathan", "peter",
    "luke", "alex", "alexander", "ben", "benjamin", "sam", "samuel", "tom", "joe", "chris", "christopher", "max", "leo", "henry", "jack", "oliver",
    "harry", "charlie", "jake", "callum", "mary", "patricia", "jennifer", "linda", "elizabeth", "barbara", "susan", "jessica", "sarah", "karen", "nancy", "lisa",
    "margaret", "betty", "sandra", "ashley", "dorothy", "kimberly", "emily", "michelle", "amanda", "stephanie", "carol", "laura", "rebecca", "sharon", "anna", "emma",
    "olivia", "ava", "mia", "sophia", "isabella", "charlotte", "amelia", "grace", "chloe", "zoe", "lily", "hannah", "ella", "scarlett", "maria", "fatima",
    "aisha", "amina", "zainab", "priya", "anita", "pooja", "rahul", "arjun", "raj", "vikram", "sanjay", "deepak", "amit", "rohit", "ali", "ahmed",
    "omar", "hassan", "hussain", "muhammad", "usman", "bilal", "hamza", "farhan", "imran", "sara", "carlos", "juan", "luis", "diego", "sofia", "lucas",
    "mateo", "leon", "felix", "oscar", "hugo", "liam", "noah", "ethan", "mason", "logan", "evelyn", "harper",
]

# People.
TITLE = r"\b(?:chief\s+(?:executive|technology|operating|financial|marketing|revenue)\s+officer|ceo|cto|coo|cfo|cmo|founder|co-?founder|president|vice\s+president|vp|director|manager|partner|owner|head\s+of\s+[a-z ]+)\b"
SENIORITY = [("c_level", r"chief|c[eoifoatm]o\b|founder|president|owner|partner|managing\s+director"), ("vp", r"\bvp\b|vice\s+president"), ("director", r"director|head\s+of"), ("manager", r"manager|lead\b|supervisor")]
DEPARTMENTS = [("engineer", "Engineering"), ("developer", "Engineering"), ("tech", "Engineering"), ("product", "Product"), ("design", "Design"), ("data", "Data"), ("sales", "Sales"), ("revenue", "Sales"), ("marketing", "Marketing"), ("growth", "Marketing"), ("finance", "Finance"), ("accounting", "Finance"), ("hr", "HR"), ("human resources", "HR"), ("people", "HR"), ("operations", "Operations"), ("support", "Support"), ("legal", "Legal")]
NAME_STOPWORDS = [
    "our", "team", "about", "contact", "leadership", "management", "company", "the", "and", "meet", "join", "work", "careers", "services", "service", "home",
    "blog", "get", "started", "learn", "more", "privacy", "terms", "why", "how", "what", "who", "we", "are", "us", "your", "their",
    "his", "her", "all", "view", "read", "story", "stories", "values", "mission", "vision", "news", "press", "faq",
]

# Pages.
SOFT_404_STRONG = r"(?i)\b404\b|page not found"
SOFT_404_WEAK = r"(?i)not found|doesn'?t exist|no longer (?:available|exists)"
SOFT_404_PHRASES = ["page not found", "page could not be found", "page you are looking for", "page you're looking for", "does not exist", "doesn't exist", "no longer available", "company not found", "profile not found"]
THIN_PAGE = 2500
BLOCK_SIGNATURES = ["Just a moment...", "Attention Required! | Cloudflare", "cf-browser-verification", "Ray ID:", "Please enable Cookies", "Access Denied"]
BLOCK_TITLES = ["block", "verify", "captcha", "security check", "robot"]
SCOPE_TAGS = ["article", "li", "tr", "section", "address", "figure", "div", "p"]

# Limits of stored columns.
COMPANY_CAPS = {"name": 250, "industry": 250, "company_size": 100, "website_url": 2000, "hq_phone": 50, "linkedin_url": 500, "twitter_url": 500}
LEAD_CAPS = {"first_name": 150, "last_name": 150, "title": 250, "seniority": 50, "department": 100, "work_email": 250, "source_platform": 100, "linkedin_url": 2000}

# Directories, by domain.
DIRECTORIES = {
    "clutch.co": {"profile_paths": ["/profile/"], "company_name_selector": "h1.header-company_name", "industry_selector": "div.field-service"},
    "goodfirms.co": {"profile_paths": ["/company/"], "company_name_selector": "h1.main-title", "industry_selector": "div.category-name"},
    "designrush.com": {"profile_paths": ["/agency/"], "company_name_selector": "h1", "industry_selector": "span.specialization"},
    "upcity.com": {"profile_paths": ["/firm/", "/local-marketing-agencies/"], "company_name_selector": "h1", "industry_selector": "div.industry"},
    "g2.com": {"profile_paths": ["/products/"], "company_name_selector": "h1", "industry_selector": "div.category-name"},
}
# Names that structured data uses for our fields, in order of preference.
FIELD_NAMES = {
    "company_name": ["name", "legalName", "alternateName"],
    "company_size": ["numberOfEmployees", "employees", "employeeCount", "staff", "size", "headcount", "member"],
    "industry": ["knowsAbout", "genre", "industry", "sector", "category", "specialization"],
    "website": ["url", "mainEntityOfPage"],
    "description": ["description", "about", "summary"],
    "founded_year": ["foundingDate", "dateCreated"],
    "headquarters": ["address", "location", "areaServed"],
}
# Technology signatures (category, patterns).
TECHNOLOGIES = {
    "Next.js": ("Framework", ["_next/static", "__NEXT_DATA__"]), "React": ("Framework", ["react.production.min.js", "react-dom"]), "Vue.js": ("Framework", ["vue.global.js", "v-attr"]), "Angular": ("Framework", ["ng-version", "angular.min.js"]),
    "Svelte": ("Framework", ["__svelte", "svelte-"]), "Astro": ("Framework", ["astro-island", "astro-slot"]), "Nuxt.js": ("Framework", ["__nuxt", "_nuxt/"]), "Gatsby": ("Framework", ["gatsby-", "page-data"]),
    "WordPress": ("CMS", ["wp-content", "wp-includes"]), "Webflow": ("CMS", ["webflow.com", "wf-page"]), "Wix": ("CMS", ["static.wixstatic.com", "wix-code"]), "Squarespace": ("CMS", ["squarespace.com", "sqs-block"]),
    "Shopify": ("Ecommerce", ["cdn.shopify.com", "Shopify.theme"]), "Laravel": ("Backend", ["laravel", "csrf-token"]), "Django": ("Backend", ["csrfmiddlewaretoken", "django"]), "Ruby on Rails": ("Backend", ["csrf-token", "turbolinks"]),
    "Cloudflare": ("CDN & Security", ["cloudflare.com", "__cf_chl_opt"]), "Google Analytics": ("Analytics", ["googletagmanager.com", "gtag"]), "Tailwind CSS": ("CSS", ["tailwind", "tw-"]), "Bootstrap": ("CSS", ["bootstrap.min.css"]),
    "HubSpot": ("Marketing", ["js.hs-scripts.com", "hubspot"]), "Salesforce": ("CRM", ["force.com", "salesforce"]), "Marketo": ("Marketing", ["marketo.com", "munchkin"]), "Intercom": ("Support", ["intercom", "intercomSettings"]),
    "Drift": ("Support", ["drift.com", "driftt"]), "Stripe": ("Payments", ["js.stripe.com"]),
}
