"""Word lists, limits, patterns and messages that results depend on.

Everything here is data, stated once and in plain text.  Patterns are written for
``java.util.regex``: ``SP`` is the Unicode-aware white-space class and ``W0`` / ``W1`` are
ASCII word boundaries (Java's own ``\\s`` is ASCII-only and its ``\\b`` is not).
"""

from __future__ import annotations

# ---------------------------------------------------------------- regex building blocks
SP_CHARS = r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SP = "[" + SP_CHARS + "]"
W0 = r"(?<![A-Za-z0-9_])"
W1 = r"(?![A-Za-z0-9_])"
SPACE_CODES = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B),
               0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
TRIM_CHARS = "".join(map(chr, SPACE_CODES))

# ---------------------------------------------------------------- limits
WALK_MAX_DEPTH = 2
WALK_MAX_PAGES = 25
WALK_MAX_CHILDREN = 12
FETCH_TRIES = 3
FINDER_DEFAULT_PAGES = 8
ADDRESS_MIN, ADDRESS_MAX = 12, 200
MAX_URLS_EXTRACTOR = 100
MAX_URLS_FINDER = 10
MAX_RECIPIENTS = 5000
ACTIVITY_LOG_ROWS = 200
RETAINED_CAMPAIGNS = 50
RETENTION_SECONDS = 3600
MAX_SLICES = 6

# ---------------------------------------------------------------- links
PRIORITY_PATHS = """
/contact /contact-us /contactus /about /about-us /aboutus /team /people /reach-us /info
/support /help /our-team
""".split()

FINDER_SEED_PATHS = """
/contact /contact-us /contactus /about /about-us /team /us /help /support /imprint /impressum
""".split()

CONTACT_HINTS = """
contact about team people staff us help support reach connect info imprint impressum legal
privacy careers jobs press media enquir inquir who-we-are our-team leadership management
founders directory
""".split()

PROFILE_HINTS = """
contact about imprint impressum us reach connect info legal privacy terms team who-we-are
company
""".split()

SKIP_HREF = r"(?i)^(?:#|mailto:|tel:|javascript:)"
SKIP_HREF_FINDER = r"(?i)^(?:#|mailto:|tel:|javascript:|data:)"
FILE_LINK = r"(?i)\.(?:pdf|zip|jpe?g|png|gif|svg|webp|mp4|mp3|docx?|xlsx?)\z"
FINDER_ANCHOR_TAG = r"(?is)\A(?>.*?<a" + W1 + r").*href=[\"']([^\"']+)[\"']"

VALID_URL = (
    r"(?i)\A(?:https?://)?(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?"
    r"|localhost|\d{1,3}(?:\.\d{1,3}){3})(?::\d+)?(?:/?|[/?][^" + SP_CHARS + r"]+)\z"
)

# ---------------------------------------------------------------- social profiles
SOCIAL_PATTERNS = {
    "linkedin": r"(?:https?://)?(?:www\.)?linkedin\.com/(?:in|company|school|pub)/[^\"'<>?#&" + SP_CHARS + "]+",
    "facebook": r"(?:https?://)?(?:www\.)?facebook\.com/(?!sharer|share|plugins|login|photo|video|events|groups|pg)[^\"'<>?#&" + SP_CHARS + "]+",
    "instagram": r"(?:https?://)?(?:www\.)?instagram\.com/(?!p/|reel/|explore/|stories/)[^\"'<>?#/&" + SP_CHARS + "]+",
    "twitter": r"(?:https?://)?(?:www\.)?(?:twitter|x)\.com/(?!share|intent|home|search|hashtag|i/)[^\"'<>?#&" + SP_CHARS + "]+",
    "tiktok": r"(?:https?://)?(?:www\.)?tiktok\.com/@[^\"'<>?#&" + SP_CHARS + "]+",
    "youtube": r"(?:https?://)?(?:www\.)?youtube\.com/(?:channel|c|user|@)[^\"'<>?#&" + SP_CHARS + "]+",
    "pinterest": r"(?:https?://)?(?:www\.)?pinterest\.com/[^\"'<>?#&" + SP_CHARS + "]+",
    "whatsapp": r"(?:https?://)?(?:api\.)?whatsapp\.com/(?:send|message)[^\"'<>?#" + SP_CHARS + "]*",
}
# A literal every match of the platform's pattern contains: a cheap gate before the pattern.
SOCIAL_GATES = {
    "linkedin": "linkedin.com/", "facebook": "facebook.com/", "instagram": "instagram.com/",
    "twitter": ".com/", "tiktok": "tiktok.com/", "youtube": "youtube.com/",
    "pinterest": "pinterest.com/", "whatsapp": "whatsapp.com/",
}
SOCIAL_PLATFORMS = list(SOCIAL_PATTERNS)

# ---------------------------------------------------------------- e-mail, extractor side
EMAIL_BODY = r"[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
EMAIL = r"[a-zA-Z0-9._%+\-]+@" + EMAIL_BODY
# A scan may only start where a run of local-part characters starts (or where the last match
# ended): any start inside the run would have matched from its beginning as well.
EMAIL_SCAN = r"(?:\G|(?<![a-zA-Z0-9._%+\-]))[a-zA-Z0-9._%+\-]++@" + EMAIL_BODY
OBFUSCATED_SCAN = (
    r"(?i)(?:\G|(?<![a-zA-Z0-9._%+\-]))[a-zA-Z0-9._%+\-]+" + SP + r"*[\[\(]?" + SP + r"*(?:at|@)"
    + SP + r"*[\]\)]?" + SP + r"*[a-zA-Z0-9.\-]+" + SP + r"*[\[\(]?" + SP + r"*(?:dot|\.)"
    + SP + r"*[\]\)]?" + SP + r"*[a-zA-Z]{2,}"
)
JUNK_EMAIL_DOMAINS = "example.com domain.com email.com youremail.com sentry.io test.com sample.com".split()
JUNK_EMAIL_USERS = "noreply no-reply mailer-daemon postmaster bounce notifications donotreply".split()
ASSET_EXTENSIONS = ".png .jpg .gif .svg .webp .css .js".split()

# ---------------------------------------------------------------- e-mail, finder side
USABLE_EMAIL = (
    r"\A[a-z0-9](?:[a-z0-9._%+-]{0,62}[a-z0-9])?@(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24}\z"
)
FINDER_ASSET_SUFFIXES = """
.png .jpg .jpeg .gif .svg .webp .avif .ico .bmp .css .js .mjs .json .xml .map .woff .woff2
.ttf .otf .eot .mp4 .webm .mp3 .pdf .zip .gz
""".split()
PLACEHOLDER_DOMAINS = """
example.com example.org example.net example.co domain.com yourdomain.com your-domain.com
mydomain.com email.com youremail.com your-email.com mail.com test.com sample.com mysite.com
yoursite.com site.com website.com company.com yourcompany.com acme.com acme.org lorem.com
ipsum.com localhost localhost.com sentry.io sentry-next.wixpress.com wixpress.com wix.com
schema.org w3.org godaddy.com calendar.google.com group.calendar.google.com
groups.calendar.google.com bounce.bounces.google.com sentry.wixpress.com email.godaddy.com
""".split()
PLACEHOLDER_LOCALS = """
user username youremail your-email your_email email e-mail mail name yourname your-name
firstname lastname first last someone somebody anyone test testing demo sample example foo bar
baz johndoe john.doe jane.doe janedoe abc xyz xxx aaa string null undefined
""".split()
UNREACHABLE_LOCALS = """
noreply no-reply no_reply donotreply do-not-reply mailer-daemon postmaster bounce bounces
notifications notification automated auto-reply autoreply
""".split()
FINDER_ROLES = """
info contact contacts hello hi hey support help helpdesk sales admin administrator office team
enquiry enquiries inquiry inquiries marketing press media pr careers career jobs job
recruitment hr billing accounts accounting finance invoices legal privacy security abuse
webmaster hostmaster service services customerservice customercare booking bookings
reservations orders order shop store partners partnership business general ask reach connect
welcome studio agency newsletter subscribe feedback reception front-desk mailbox announce
announcements list lists listserv discuss discussion users group groups unsubscribe request
owner moderator noc ops root dev devel developers
""".split()
FREE_PROVIDERS = """
gmail.com googlemail.com yahoo.com yahoo.co.uk ymail.com hotmail.com outlook.com live.com
msn.com aol.com gmx.com gmx.de protonmail.com proton.me icloud.com me.com mac.com mail.ru
yandex.com yandex.ru zoho.com qq.com 163.com
""".split()
NAME_LIKE = r"\A[a-z]{2,}(?:[._-][a-z]{2,}){1,2}\z"
INITIAL_NAME = r"\A[a-z][._-][a-z]{3,}\z"

# ---------------------------------------------------------------- top-level domains
GENERIC_TLDS = """
com org net edu gov mil int info biz name pro io co ai app dev me tv cc xyz online site shop
store tech cloud agency studio design media digital group team world life live news blog page
link email systems solutions services company ventures capital consulting marketing software
finance health law
""".split()
COUNTRY_TLDS = """
ac ad ae af ag al am ao ar at au az ba bd be bg bh bo br bw by ca ch cl cn cr cy cz de dk do
dz ec ee eg es eu fi fr ge gh gr gt hk hr hu id ie il in iq ir is it jo jp ke kr kw kz lb lk
lt lu lv ly ma md mk mt mu mx my ng nl no np nz om pa pe ph pk pl pt py qa ro rs ru sa se sg
si sk sn th tn tr tw tz ua ug uk us uy uz ve vn za zm zw
""".split()
VERIFIER_EXTRA_TLDS = """
academy care center church city click club education energy events expert fund gallery global
guru host institute network partners press school science social space support today tools
training university work works zone
""".split()

# ---------------------------------------------------------------- e-mail, verifier side
MAILBOX = (
    r"\A[a-zA-Z0-9!#$%&'*+/=?^_`{|}~-]+(?:\.[a-zA-Z0-9!#$%&'*+/=?^_`{|}~-]+)*"
    r"@(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,24}\z"
)
POPULAR_DOMAINS = """
gmail.com googlemail.com yahoo.com yahoo.co.uk hotmail.com hotmail.co.uk outlook.com live.com
msn.com aol.com icloud.com me.com protonmail.com proton.me zoho.com yandex.com mail.com gmx.com
gmx.de comcast.net verizon.net
""".split()
REPAIR_TLDS = "com net org co io".split()
WEBMAIL_DOMAINS = """
gmail.com googlemail.com yahoo.com yahoo.co.uk yahoo.co.in yahoo.fr yahoo.de ymail.com
rocketmail.com hotmail.com hotmail.co.uk hotmail.fr hotmail.de outlook.com outlook.fr live.com
live.co.uk msn.com aol.com aim.com icloud.com me.com mac.com protonmail.com protonmail.ch
proton.me pm.me zoho.com zohomail.com gmx.com gmx.de gmx.net web.de mail.com mail.ru inbox.ru
bk.ru list.ru yandex.com yandex.ru ya.ru qq.com 163.com 126.com sina.com naver.com daum.net
hanmail.net rediffmail.com comcast.net verizon.net att.net sbcglobal.net bellsouth.net cox.net
charter.net btinternet.com sky.com orange.fr free.fr laposte.net libero.it virgilio.it
t-online.de seznam.cz wp.pl o2.pl interia.pl abv.bg bol.com.br uol.com.br terra.com.br
hotmail.com.br live.com.au optusnet.com.au bigpond.com shaw.ca rogers.com telus.net
""".split()
DISPOSABLE_DOMAINS = """
mailinator.com tempmail.com temp-mail.org temp-mail.io guerrillamail.com guerrillamail.net
guerrillamail.org sharklasers.com grr.la spam4.me 10minutemail.com 10minutemail.net
20minutemail.com throwawaymail.com yopmail.com yopmail.fr yopmail.net trashmail.com
trashmail.net trash-mail.com getnada.com nada.email dispostable.com fakeinbox.com
mailnesia.com mytemp.email maildrop.cc mohmal.com tempinbox.com emailondeck.com burnermail.io
anonaddy.me mailsac.com inboxkitten.com moakt.com tmail.ws luxusmail.org spambog.com
spamgourmet.com jetable.org mailcatch.com tempr.email discard.email mail-temporaire.fr
einrot.com gustr.com rhyta.com superrito.com teleworm.us cuvox.de dayrep.com armyspy.com
fleckens.hu jourrapide.com 0-mail.com 33mail.com
""".split()
DISPOSABLE_SUFFIXES = """
.mailinator.com .temp-mail.org .guerrillamail.com .yopmail.com .33mail.com .anonaddy.com
.duck.com
""".split()
VERIFIER_ROLES = """
admin administrator support info information sales contact contacts hello hi help helpdesk
service services team office mail email enquiry enquiries inquiry inquiries marketing press
media pr careers career jobs recruitment hr billing accounts accounting finance invoice
invoices legal privacy security abuse webmaster hostmaster postmaster noreply no-reply
donotreply newsletter subscribe unsubscribe feedback orders order shop store booking bookings
reservations partners partnership business general root sysadmin noc ops dev developers devops
it tech customerservice customercare reception welcome ask mailbox
""".split()

SYNTAX_REASONS = {
    "empty": "No email address was provided.",
    "spaces": "An email address cannot contain spaces.",
    "no_at": "An email address needs a local part and a domain separated by “@”.",
    "many_at": "An email address cannot contain more than one “@”.",
    "long": "This address is longer than the 254-character limit.",
    "long_local": "The part before “@” is longer than the 64-character limit.",
    "edge_dot": "The part before “@” cannot start or end with a dot.",
    "double_dot": "The part before “@” cannot contain two dots in a row.",
    "no_tld": "The domain is missing a top-level domain, such as “.com”.",
    "edge_hyphen": "The domain cannot start or end with a hyphen.",
    "bad_chars": "This address contains characters that are not allowed.",
    "tld_prefix": "“.",
    "tld_suffix": "” does not look like a real top-level domain.",
    "fallback": "This email address is not correctly formatted.",
}
SUMMARIES = {
    "valid": "This email address is valid",
    "risky": "This email address is risky",
    "invalid": "This email address is not valid",
    "unknown": "This email address could not be confirmed",
}
CHECK_TEXT = {
    "format_typo_prefix": "The format is correct, but this domain is one character away from a common one — did you mean ",
    "format_typo_suffix": "?",
    "format_ok": "This email address has the correct format and uses allowed characters.",
    "type_disposable": "This domain belongs to a throwaway inbox service — mail sent here will not be read.",
    "type_role": "This is a shared department inbox rather than one person's address.",
    "type_webmail": "This is a free consumer mailbox, not a company-owned address.",
    "type_professional": "This address is on a company-owned domain, not a free webmail provider.",
    "mx_prefix": "MX records are present for ",
    "mx_suffix": ", so the domain can receive mail.",
    "no_mx_prefix": "No mail server is configured for ",
    "no_mx_suffix": ", so it cannot receive email at all.",
    "skip_malformed": "Not checked — the address is malformed.",
    "skip_no_mx": "Not checked — the domain has no mail server.",
    "smtp_skipped": "SMTP check was skipped.",
}
# outcome -> (status, state, detail); None as detail means the probe's own message is shown.
SMTP_STATUS = {
    "accepted": ("Valid", "valid", "This email address exists and can receive emails."),
    "rejected": ("Invalid", "invalid", "The mail server says this mailbox does not exist."),
    "catch_all": ("Catch-all", "warning", "The domain accepts mail for every address, so the mailbox could not be confirmed individually."),
    "greylisted": ("Greylisted", "unknown", "The mail server asked us to retry later, so the mailbox could not be confirmed."),
    "blocked": ("Unknown", "unknown", None),
    "skipped": ("Not checked", "unknown", None),
}
SMTP_FALLBACK = {
    "blocked": "The mailbox could not be probed from this server.",
    "skipped": "The SMTP check did not run.",
}
PROBE_MESSAGES = {
    "handshake": "Server refused the handshake.",
    "sender": "Server rejected the probe sender address.",
    "catch_all": "The server accepts mail for any address at this domain.",
    "refused": "The mail server refused the connection on port 25.",
    "timeout": "Port 25 is unreachable from this server, so the mailbox could not be probed.",
    "unreachable": "The mail server was unreachable.",
}

# ---------------------------------------------------------------- campaigns
MERGE_TAG = r"\{\{\s*([a-zA-Z0-9_. -]+?)\s*(?:\|\s*([^}]*?)\s*)?\}\}"
DELIVERY_REASONS = {
    "EAUTH": "Authentication failed — check the username and password. ",
    "ECONNREFUSED": "The SMTP server refused the connection — check the host and port.",
    "ETIMEDOUT": "Could not reach the SMTP server — check the host, port, and whether outbound SMTP is allowed from this server.",
    "ESOCKET": "Could not reach the SMTP server — check the host, port, and whether outbound SMTP is allowed from this server.",
    "ECONNECTION": "Could not reach the SMTP server — check the host, port, and whether outbound SMTP is allowed from this server.",
    "EDNS": "The SMTP host could not be resolved — check the hostname.",
    "ENOTFOUND": "The SMTP host could not be resolved — check the hostname.",
    "EENVELOPE": "The server rejected the sender or recipient. ",
    "EMESSAGE": "The server rejected the message. ",
}
UNKNOWN_DELIVERY_ERROR = "Unknown SMTP error."
DRY_RUN_NOTE = "Dry run — message rendered but not sent."
CANCELLED_NOTE = "Campaign cancelled before this message was sent."
BLOCKERS = {
    "recipients": "Add recipients in step 1.",
    "subject": "Write a subject line in step 2.",
    "body": "Write an email body in step 2.",
    "from": "Set the “From” email in step 3.",
    "host": "Set the SMTP host in step 3.",
}
ROUTE_CHECKS = {
    "from": "A valid “From” email address is required.",
    "reply_to": "The reply-to address is not a valid email.",
    "port": "The SMTP port must be a number between 1 and 65535.",
}

# ---------------------------------------------------------------- technology signatures
# name | category | html patterns | header rules (key, value pattern or None)
TECH_SIGNATURES = [
    ("WordPress", "CMS", [r"(?i)wp-content|wp-includes", r"(?i)<meta[^>]+name=[\"']generator[\"'][^>]+wordpress"], []),
    ("Drupal", "CMS", [r"(?i)drupal\.settings|sites/(?:default|all)/(?:themes|modules)"], [("x-generator", "(?i)drupal")]),
    ("Joomla", "CMS", [r"(?i)/media/(?:jui|system)/|<meta[^>]+generator[^>]+joomla"], []),
    ("Wix", "CMS", [r"(?i)static\.wixstatic\.com|wix\.com"], [("x-wix-request-id", None)]),
    ("Squarespace", "CMS", [r"(?i)squarespace\.com|static1\.squarespace"], [("server", "(?i)squarespace")]),
    ("Webflow", "CMS", [r"(?i)<meta[^>]+generator[^>]+webflow|\.webflow\.io|assets\.website-files\.com"], []),
    ("Ghost", "CMS", [r"(?i)<meta[^>]+generator[^>]+ghost"], []),
    ("HubSpot CMS", "CMS", [r"(?i)hs-scripts\.com|hubspot"], []),
    ("Shopify", "E-commerce", [r"(?i)cdn\.shopify\.com|shopify\.com/s/|window\.shopify"], [("x-shopify-stage", None), ("x-shopid", None)]),
    ("WooCommerce", "E-commerce", [r"(?i)woocommerce|wp-content/plugins/woocommerce"], []),
    ("Magento", "E-commerce", [r"(?i)" + W0 + "magento" + W1 + r"|mage\.cookies|mage/requirejs|/static/version\d"], []),
    ("BigCommerce", "E-commerce", [r"(?i)bigcommerce\.com|cdn\d*\.bigcommerce"], []),
    ("PrestaShop", "E-commerce", [r"(?i)prestashop"], []),
    ("Next.js", "JS Framework", [r"/_next/|__NEXT_DATA__"], []),
    ("Nuxt.js", "JS Framework", [r"/_nuxt/|__NUXT__"], []),
    ("React", "JS Framework", [r"(?i)data-reactroot|react(?:\.production)?(?:\.min)?\.js"], []),
    ("Vue.js", "JS Framework", [r"(?i)vue(?:\.min)?\.js|data-v-[0-9a-f]{8}"], []),
    ("Angular", "JS Framework", [r"(?i)ng-version=|angular(?:\.min)?\.js"], []),
    ("Svelte", "JS Framework", [r"(?i)svelte-[0-9a-z]{6}"], []),
    ("Gatsby", "JS Framework", [r"(?i)/page-data/|___gatsby"], []),
    ("jQuery", "Library", [r"(?i)jquery(?:-\d[\d.]*)?(?:\.min)?\.js"], []),
    ("Bootstrap", "Library", [r"(?i)bootstrap(?:\.min)?\.(?:css|js)"], []),
    ("Font Awesome", "Library", [r"(?i)font-?awesome"], []),
    ("Google Analytics", "Analytics", [r"(?i)google-analytics\.com/(?:analytics|ga)\.js|gtag\('config'|www\.googletagmanager\.com/gtag"], []),
    ("Google Tag Manager", "Analytics", [r"googletagmanager\.com/gtm\.js|GTM-[A-Z0-9]+"], []),
    ("Meta Pixel", "Marketing", [r"(?i)connect\.facebook\.net/[^\"']+/fbevents\.js|fbq\("], []),
    ("Hotjar", "Analytics", [r"(?i)static\.hotjar\.com|hjsitesettings"], []),
    ("HubSpot", "Marketing", [r"(?i)js\.hs-scripts\.com|js\.hsforms\.net"], []),
    ("Mailchimp", "Marketing", [r"(?i)chimpstatic\.com|list-manage\.com"], []),
    ("Intercom", "Marketing", [r"(?i)widget\.intercom\.io|intercomsettings"], []),
    ("Stripe", "Payments", [r"(?i)js\.stripe\.com"], []),
    ("PayPal", "Payments", [r"(?i)paypal\.com/sdk/js|paypalobjects\.com"], []),
    ("Cloudflare", "CDN / Hosting", [r"(?i)cdn-cgi/"], [("server", "(?i)cloudflare"), ("cf-ray", None)]),
    ("Vercel", "CDN / Hosting", [], [("server", "(?i)vercel"), ("x-vercel-id", None)]),
    ("Netlify", "CDN / Hosting", [], [("server", "(?i)netlify"), ("x-nf-request-id", None)]),
    ("Nginx", "Web Server", [], [("server", "(?i)nginx")]),
    ("Apache", "Web Server", [], [("server", "(?i)apache")]),
    ("PHP", "Programming Language", [], [("x-powered-by", "(?i)php")]),
    ("ASP.NET", "Programming Language", [], [("x-powered-by", r"(?i)asp\.net"), ("x-aspnet-version", None)]),
    ("Express", "Web Framework", [], [("x-powered-by", "(?i)express")]),
]

# ---------------------------------------------------------------- business profile
BUSINESS_TYPE_NAME = (
    r'"@type"' + SP + "*:" + SP + r'*"(?:Organization|LocalBusiness|Corporation|Store|ProfessionalService|[A-Za-z]*Business)"'
    r'[\s\S]{0,400}?"name"' + SP + "*:" + SP + r'*"([^"]{2,80})"'
)
NO_CATEGORY = "—"
CATEGORY_RULES = [
    ("Services / Digital Marketing", [
        "digital marketing", "seo", "search engine optimization", "ppc", "social media marketing", "content marketing", "link building",
        "backlink", "marketing agency", "google ads", "adwords", "branding agency",
    ]),
    ("Technology / SaaS", [
        "saas", "platform", "api", "dashboard", "integrations", "free trial", "pricing plan", "cloud software", "automation tool",
        "subscription",
    ]),
    ("Services / Software Development", [
        "software development", "web development", "app development", "custom software", "mobile app", "developers", "it services",
        "outsourcing", "web design",
    ]),
    ("E-commerce / Retail", [
        "add to cart", "shop now", "free shipping", "checkout", "our products", "buy now", "online store", "shopping cart", "add to bag",
    ]),
    ("Education", [
        "students", "curriculum", "courses", "enroll", "university", "academy", "tuition", "admissions", "school", "training program",
        "certification",
    ]),
    ("Healthcare", [
        "patients", "clinic", "doctors", "medical", "health care", "treatment", "appointment", "dental", "hospital", "therapy",
    ]),
    ("Real Estate", [
        "properties", "real estate", "for sale", "listings", "rent", "realtor", "apartments", "square feet", "mortgage",
    ]),
    ("Finance", [
        "investment", "banking", "insurance", "loans", "financial services", "accounting", "tax", "wealth", "portfolio", "trading",
    ]),
    ("Legal", [
        "attorney", "law firm", "lawyer", "legal services", "litigation", "counsel", "solicitor", "paralegal",
    ]),
    ("Travel & Hospitality", [
        "hotel", "booking", "reservation", "tours", "flights", "travel", "resort", "accommodation", "itinerary",
    ]),
    ("Food & Beverage", [
        "menu", "restaurant", "reservations", "catering", "cafe", "recipes", "dining", "takeaway", "bakery",
    ]),
    ("Media / Publishing", [
        "articles", "newsroom", "latest news", "editorial", "magazine", "podcast", "subscribe to our newsletter", "journalism",
    ]),
    ("Non-profit", [
        "donate", "nonprofit", "non-profit", "charity", "volunteers", "our mission", "fundraising", "foundation",
    ]),
    ("Manufacturing / Industrial", [
        "manufacturing", "factory", "industrial", "machinery", "suppliers", "wholesale", "production line", "oem",
    ]),
    ("Construction", [
        "construction", "contractor", "renovation", "builders", "roofing", "plumbing", "remodeling", "architecture",
    ]),
    ("Services / Consulting", [
        "consulting", "consultancy", "advisory", "strategy", "business solutions", "our expertise",
    ]),
]
SCHEMA_CATEGORY = {
    "store": "E-commerce / Retail", "onlinestore": "E-commerce / Retail",
    "restaurant": "Food & Beverage", "hotel": "Travel & Hospitality",
    "lodgingbusiness": "Travel & Hospitality", "medicalorganization": "Healthcare",
    "medicalclinic": "Healthcare", "dentist": "Healthcare", "hospital": "Healthcare",
    "educationalorganization": "Education", "school": "Education",
    "collegeoruniversity": "Education", "realestateagent": "Real Estate",
    "financialservice": "Finance", "bank": "Finance", "insuranceagency": "Finance",
    "attorney": "Legal", "legalservice": "Legal", "ngo": "Non-profit",
    "homeandconstructionbusiness": "Construction", "generalcontractor": "Construction",
}
NOT_A_CONTACT_FORM = r"search|newsletter|subscribe|login|signin|sign-in|register|signup|sign-up|cart|checkout|filter"
BUSINESS_STREET = (
    r"(?i)" + W0 + r"(?:street|st|road|rd|avenue|ave|boulevard|blvd|lane|ln|drive|dr|court|ct|way|suite|ste|unit|apt|floor|fl|room|block|sector|phase|plot|house|building|bldg|tower|plaza|highway|hwy|parkway|pkwy|square|sq|place|pl|terrace|close|markaz|gali|po box)" + W1
)
BUSINESS_POSTAL = W0 + r"\d{5}(?:-\d{4})?" + W1 + "|" + W0 + r"[A-Z]{1,2}\d{1,2}[A-Z]?" + SP + r"?\d[A-Z]{2}" + W1

# ---------------------------------------------------------------- phones
PHONE_CANDIDATE = (
    r"(?i)(?<![A-Za-z0-9_.+,/-])((?:\(\d{2,5}\)|\+?\d)[\d().\u2010-\u2015" + SP_CHARS + r"-]{5,22}\d)"
    r"(?:" + SP + r"*[,;]?" + SP + r"*(?:ext|extn|ext\.|x|#)" + SP + r"*[:.]?" + SP + r"*(\d{1,6}))?(?![A-Za-z0-9_-])"
)
CURRENCY_BEFORE = r"[$€£¥₹₨฿₦₽]" + SP + r"?\z"
UNIT_AFTER = (
    r"(?i)\A" + SP + r"*(?:%|px|pt|em|rem|vh|vw|ms|kg|lbs?|oz|km|cm|mm|mi|ft|in|mb|gb|tb|kb|hz|khz|mhz|ghz|bps|kbps|mbps|usd|eur|gbp|pkr|inr|aed|st|nd|rd|th|am|pm|°|/5|/10|/100)"
    r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
)
COUNT_AFTER = (
    r"(?i)\A" + SP + r"*(?:\+|(?:articles|users|customers|clients|downloads|installs|reviews|ratings|members|followers|subscribers|views|visitors|products|items|sales|orders|projects|companies|businesses|websites|people|students|employees)" + W1 + ")"
)
LABEL_BEFORE = (
    r"(?i)" + W0 + r"(?:version|ver|build|rev|revision|sku|isbn|issn|id|ref|order|invoice|item|qty|quantity|width|height|size|lat|latitude|lng|longitude|utc|gmt|ein|tin|vat|nif|cif|duns|tax|registration|licen[cs]e|account|routing)" + W1
    + r"[:#.()" + SP_CHARS + r"]*\z"
)
PHONE_EXTENSION = r"(?i)[,;]?" + SP + r"*(?:ext|extn|ext\.|x|#)" + SP + r"*[:.]?" + SP + r"*(\d{1,6})" + SP + r"*\z"
DECLARED_HREF = r"(?i)\A(?:tel|callto|sms|fax):(.+)\z"
DECLARED_JSON = r'(?i)"(?:telephone|phone|phoneNumber|contactPhone|faxNumber)"' + SP + "*:" + SP + r'*"([^"]{5,40})"'
ISO_DATE = r"(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])" + W1

# ---------------------------------------------------------------- addresses
COUNTRY_ALIASES = {
    "USA": "United States", "US": "United States", "U.S.": "United States",
    "U.S.A.": "United States", "UK": "United Kingdom", "U.K.": "United Kingdom",
    "UAE": "United Arab Emirates", "KSA": "Saudi Arabia", "ENGLAND": "England",
    "SCOTLAND": "Scotland", "WALES": "Wales", "HOLLAND": "Netherlands",
}
STREET_TYPES = [
    "street", "st", "avenue", "ave", "boulevard", "blvd", "road", "rd", "lane", "ln", "drive", "dr", "court", "ct", "way", "highway",
    "hwy", "square", "sq", "parkway", "pkwy", "place", "pl", "terrace", "trail", "crescent", "close", "circle", "cir", "alley", "bypass",
    "expressway", "freeway", "route", "rte", "walk", "quay", "esplanade", "strasse", "straße", "calle", "avenida", "rua", "via", "viale",
    "chaussee", "gatan", "vej", "plein", "laan", "straat",
]
UNIT_TYPES = [
    "suite", "ste", "unit", "apt", "apartment", "floor", "fl", "room", "rm", "office", "building", "bldg", "block", "tower", "plaza",
    "level", "flat", "shop", "house", "plot", "sector", "phase", "villa", "wing", "complex", "centre", "center", "mall", "industrial area",
    "po box", "p.o. box", "gpo box", "postbox",
]
UNIT_LED_EXTRA = "street road gali mohalla near".split()
LABEL_WITH_SEPARATOR = (
    r"(?i)\A(?:our" + SP + r"+)?(?:address(?:es)?|location|head" + SP + "+office|registered" + SP + "+office|main" + SP
    + "+office|office|branch|mailing" + SP + "+address|postal" + SP + "+address|visit" + SP + "+us|find" + SP + "+us|come"
    + SP + "+see" + SP + r"+us|headquarters|hq|showroom|warehouse|store)" + SP + r"*[:\-–—,]" + SP + "*"
)
LABEL_BARE = (
    r"(?i)\A(?:our" + SP + r"+)?(?:address(?:es)?|head" + SP + "+office|registered" + SP + "+office|main" + SP
    + "+office|mailing" + SP + "+address|postal" + SP + r"+address|headquarters)" + SP + r"+(?=\d)"
)
NOT_AN_ADDRESS = (
    r"(?i)(?:https?:|www\.|@[a-z0-9-]+\.|©|\{|\}|=>|" + W0 + "function" + W1 + "|" + W0 + "var" + W1
    + r"|cookie|privacy policy|terms (?:of|and)|all rights reserved|copyright|subscribe|newsletter|read more|learn more|sign up|log in)"
)
PROSE = (
    r"(?i)" + W0 + r"(?:was|were|is|are|has|have|had|will|would|should|could|says?|said|according|more than|less than|percent|includes?|including|because|however|meanwhile|during|after|before|between|through|about)" + W1
)
CONTACT_ONLY = (
    r"(?i)\A(?:tel|telephone|phone|ph|mob|mobile|cell|fax|whatsapp|email|e-mail|call|hours?|open(?:ing)?" + SP + "+hours?|mon|monday)" + W1
)
STRONG_POSTAL = (
    W0 + r"\d{5}(?:-\d{4})?" + W1 + "|" + W0 + r"[A-Z]{1,2}\d{1,2}[A-Z]?" + SP + r"?\d[A-Z]{2}" + W1
    + "|" + W0 + r"[A-Z]\d[A-Z]" + SP + r"?\d[A-Z]\d" + W1 + "|" + W0 + r"\d{4}" + SP + r"?[A-Z]{2}" + W1
)
ADDRESS_HINT_WORDS = "address addr location contact-info contact-detail branch office footer".split()
ADDRESS_PARTS = "streetAddress addressLocality addressRegion postalCode addressCountry".split()

# ---------------------------------------------------------------- page text
BLOCK_TAGS = """
p div li ul ol td th tr table h1 h2 h3 h4 h5 h6 section article header footer nav address span a
label strong b em i small dd dt dl figcaption blockquote main aside form
""".split()
NOISE_TAGS = "script style noscript template svg iframe canvas code pre option".split()
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "©",
    "reg": "®", "trade": "™", "hellip": "…", "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "bull": "•", "middot": "·", "laquo": "«", "raquo": "»", "euro": "€",
    "pound": "£", "yen": "¥", "cent": "¢", "sect": "§", "deg": "°", "times": "×", "para": "¶",
    "plusmn": "±", "frac12": "½", "commat": "@", "period": ".", "comma": ",", "colon": ":",
    "num": "#", "lpar": "(", "rpar": ")", "lbrack": "[", "rbrack": "]", "sol": "/", "plus": "+",
    "iexcl": "¡", "iquest": "¿", "auml": "ä", "ouml": "ö", "uuml": "ü", "Auml": "Ä", "Ouml": "Ö",
    "Uuml": "Ü", "szlig": "ß", "eacute": "é", "egrave": "è", "ecirc": "ê", "agrave": "à",
    "aacute": "á", "acirc": "â", "ccedil": "ç", "ntilde": "ñ", "oacute": "ó", "iacute": "í",
    "uacute": "ú", "ocirc": "ô", "thinsp": "\u2009", "ensp": "\u2002", "emsp": "\u2003",
    "shy": "\u00ad", "rarr": "→", "larr": "←", "check": "✓", "lcub": "{", "rcub": "}",
    "vert": "|", "hyphen": "\u2010", "dash": "\u2010", "excl": "!", "quest": "?", "equals": "=", "semi": ";",
}
