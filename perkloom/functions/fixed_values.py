"""Fixed values.

Everything here must equal the published behaviour for results to match:
thresholds, code names, user-facing wording, vocabularies and patterns. They are
data, kept in one place and in their natural order; the logic that uses them is
in the other modules.
"""

# --- policy constants -------------------------------------------------------
LOCAL_ZONE = "Asia/Jerusalem"
AGING_DAYS = 14
STALE_DAYS = 45
ENDS_SOON_DAYS = 7
MIN_CONFIDENCE = 0.85
REFERENCE_BASKET = 250.0
UNIVERSAL_MERCHANT = "any_merchant"
UNMAPPED_PREFIX = "unmapped_"

EARTH_RADIUS_M = 6_371_000.0
WALK_RADIUS_M = 500.0
SHOP_RADIUS_M = 150
SHOP_PREFIX = "shop:"
MAX_FENCES = 20
FENCE_REFRESH_M = 5_000.0
DUPLICATE_BRANCH_M = 50.0

MIN_DWELL_MS = 3 * 60_000
COOLDOWN_MS = 12 * 60 * 60_000
QUIET_FROM_MINUTES = 22 * 60
QUIET_TO_MINUTES = 8 * 60
NOTIFY_TOP = 5

EVENT_RETENTION = 500
KPI_TARGET = 0.30
LINK_MAX_AGE_DAYS = 7
LINK_CHECKS_PER_PASS = 500
CRAWL_BATCH = 25
EXTRACT_LIMIT = 25
CANDIDATE_LIMIT = 25
HOME_COMBOS = 2

# --- enumerations -----------------------------------------------------------
BENEFIT_TYPES = ["percent", "fixed", "bogo", "cashback", "gift_card"]
CHANNELS = ["in_store", "online", "both"]
PROGRAM_CATEGORIES = ["credit_card", "employer_club", "retail_club"]
MERCHANT_CATEGORIES = [
    "fuel", "grocery", "pharmacy", "fashion", "electronics",
    "dining", "home", "leisure", "beauty", "books",
]
INTERACTION_KINDS = [
    "notification_sent", "notification_opened", "benefit_viewed",
    "benefit_redeemed", "share_resolved", "share_unmatched",
]

# Bounds a catalog is held to.
LAT_MIN, LAT_MAX = 29.4, 33.4
LNG_MIN, LNG_MAX = 34.2, 35.9
RADIUS_MIN_M, RADIUS_MAX_M = 50, 1000
TIME_OF_DAY = r"^([01][0-9]|2[0-3]):[0-5][0-9]$"

# --- condition wording ------------------------------------------------------
DAY_NAMES = ["א׳", "ב׳", "ג׳", "ד׳", "ה׳", "ו׳", "שבת"]
MSG_NOT_OWNED = "המועדון לא מסומן בפרופיל שלך"
MSG_MUTED = "השתקת את ההטבה הזו"
MSG_LOW_CONFIDENCE = "ההטבה ממתינה לאימות ידני"
MSG_STALE = "ההטבה לא אומתה מעל %d ימים"
MSG_AGING = "אומת לאחרונה לפני %d ימים — כדאי לוודא בקופה"
MSG_FRESH = "אומת בימים האחרונים מול המקור"
LABEL_STALE, LABEL_AGING, LABEL_FRESH = "לא אומת", "אימות ישן", "מאומת"
MSG_NOT_YET = "ההטבה עדיין לא נכנסה לתוקף"
LABEL_NOT_YET = "טרם החל"
MSG_EXPIRED = "תוקף ההטבה פג"
MSG_EXPIRED_ON = "התוקף פג ב-%s"
LABEL_EXPIRED = "פג תוקף"
MSG_VALID_UNTIL = "בתוקף עד %s"
MSG_ENDS_SOON = "נגמר בקרוב — בתוקף עד %s"
LABEL_UNTIL = "עד %s"
LABEL_VALID = "בתוקף"
MSG_DAYS_ONLY = "תקף בימים %s בלבד"
MSG_DAYS_MET = "תקף בימים %s — היום נכלל"
MSG_DAYS_BLOCKED = "תקף בימים %s בלבד — לא היום"
MSG_HOURS_ONLY = "תקף בין %s ל-%s בלבד"
MSG_HOURS_MET = "תקף בין %s ל-%s — עכשיו בתוך החלון"
MSG_HOURS_BLOCKED = "תקף בין %s ל-%s בלבד — לא עכשיו"
LABEL_ONLINE, LABEL_IN_STORE = "באונליין", "בסניפים"
MSG_CHANNEL_ONLY = "תקף %s בלבד"
MSG_CHANNEL_MET = "תקף %s — זה הערוץ הנוכחי"
MSG_SPEND_OVER = "בקנייה מעל %s"
MSG_SPEND_BLOCKED = "דרוש מינימום %s (חסרים %s)"
MSG_SPEND_MISSING = "חסרים %s כדי להגיע למינימום"
MSG_SPEND_MET = "הסל עובר את המינימום של %s"
MSG_CAP = "תקרת הנחה %s"
LABEL_CAP = "עד %s"
MSG_CAP_DETAIL = "ההנחה מוגבלת ל-%s"
MSG_VOUCHER = "יש להנפיק שובר באתר המועדון מראש"
LABEL_VOUCHER = "שובר מראש"
MSG_VOUCHER_DETAIL = "יש להנפיק שובר באתר המועדון לפני הרכישה"
MSG_EXCLUDES = "לא כולל: %s"
LABEL_EXCLUDES = "החרגות"
MSG_NO_STACKING = "אין כפל מבצעים עם מועדון החנות"
LABEL_NO_STACKING = "ללא כפל"
MSG_STACKING_UNKNOWN = "כפל מבצעים לא מצוין בתקנון"
LABEL_STACKING_UNKNOWN = "כפל?"
MSG_STACKING_UNKNOWN_DETAIL = "התקנון לא אומר אם יש כפל מבצעים — כדאי לשאול בקופה"
MSG_STACKING_MET = "ניתן לשלב עם מבצעי מועדון החנות"
LABEL_STACKING_MET = "כפל מותר"
LABEL_USAGE = "הגבלת שימוש"
CAVEAT_SILENT = "התקנון של %s לא אומר אם מותר כפל"

# --- short labels -----------------------------------------------------------
UNIT_DISCOUNT, UNIT_CREDIT, UNIT_GIFT = "הנחה", "זיכוי", "מתנה"
BOGO_FIGURE, BOGO_UNIT = "1+1", "על הזול"
UNKNOWN_FIGURE, UNKNOWN_UNIT = "—", "הטבה"
SAVING_WORD, SAVING_ESTIMATE_WORD = "חיסכון", "חיסכון משוער"
NOTIFY_TITLE = "אתה ב%s?"
NOTIFY_LINE = "%s ב%s (%s)"
NOTIFY_MORE = "%s ועוד %d"
VERIFIED_TODAY, VERIFIED_YESTERDAY, VERIFIED_DAYS = "אומת היום", "אומת אתמול", "אומת לפני %d ימים"
GATES_NONE, GATES_TOTAL, GATES_BLOCKED, GATES_ACTIONS, GATES_MET = (
    "ללא תנאים בתקנון", "%d תנאים", "%d חוסמים", "%d עליך", "%d מתקיימים",
)

# --- names and ids ----------------------------------------------------------
# Characters removed before two merchant names are compared.
NAME_NOISE = "[\\s\\u00a0\\ufeff'\"׳״־-]+"

# --- collected offers -------------------------------------------------------
BINDING_HEADING = "חשוב לדעת"
PAGE_MERCHANT = "בית העסק: "
PAGE_HEADLINE = "כותרת ההטבה: "
PAGE_BODY = "טקסט מלא של העמוד:\n"
RECORD_MERCHANT = "בית העסק: "
RECORD_CATEGORY = "קטגוריה: "
RECORD_HEADLINE = "ההטבה כפי שמופיעה באיזי: "
RECORD_ADDRESS = "כתובת: "
RECORD_SITE = "easy.co.il"
RECORD_URL = "https://easy.co.il/page/"
DEAL_WORDS = r"הנחה|%|מבצע|1\s*\+\s*1|הטבה|מתנה|קופון"

# List file name -> program id, for the lists whose program is known.
LIST_PROGRAMS = {
    "MAX": "max",
    "Cal-Discount": "cal",
    "Isracard-Discounts": "isracard",
    "Isracard-Chever": "hever",
    "Behatsdaa": "behatsdaa",
    "MAX-Behatsdaa": "behatsdaa",
    "Hitech-Zone-members": "hitechzone",
    "Kranot-Police": "shotrim",
    "Shufersal4u": "shufersal_life",
    "max-Kranot": "max_kranot",
    "Fly-Card": "fly_card",
    "Leumi-Goodies": "leumi_goodies",
    "CampusCard-Members": "campus_card_members",
    "Diners-Club": "diners_club",
    "Mizrahi-Tefahot-Members": "mizrahi_tefahot_members",
    "Discounts-American-Express": "discounts_american_express",
    "Mafteach-Discounts": "mafteach_discounts",
    "iCard": "i_card",
    "TAU": "tau",
    "Isracard-TOP-Members": "isracard_top_members",
    "Calextra-Discounts": "calextra_discounts",
    "max-Tmura": "max_tmura",
    "mastercard-day": "mastercard_day",
    "Reut-Buy-It-For-Me": "reut_buy_it_for_me",
    "youngstyle": "youngstyle",
    "Topcash": "topcash",
    "My-MAX": "my_max",
    "Tefahot-Card": "tefahot_card",
    "Amit-Kranot-Benefits-Card": "amit_kranot_benefits_card",
    "Rami-Levy-Club": "rami_levy_club",
    "Clalit-Fun": "clalit_fun",
    "Tov-Plus-Club": "tov_plus_club",
    "Digitel-Discounts": "digitel_discounts",
    "Pais-Members": "pais_members",
    "Cuponofesh": "cuponofesh",
    "Carrefour-Club": "carrefour_club",
    "Irgoon-Hamorim-Benefits": "irgoon_hamorim_benefits",
    "Histadrut-For-You": "histadrut_for_you",
    "Club-Hot-Discounts": "club_hot_discounts",
    "Vegan-Active-Discounts": "vegan_active_discounts",
    "Egged-Driver-Memebers": "egged_driver_memebers",
    "Yours-Club": "yours_club",
    "megalean": "megalean",
    "Uniq-Club": "uniq_club",
    "Your-Club-For-Pensioner": "your_club_for_pensioner",
    "Ashmoret-Membership": "ashmoret_membership",
    "FRIENDS-Clube": "friends_clube",
    "Living-Members": "living_members",
    "Bezeq-Employees-Association": "bezeq_employees_association",
    "Mystyle-Discounts": "mystyle_discounts",
    "magiayoter": "magiayoter",
    "Dream-Card-Club": "dream_card_club",
    "LifeStyle-Members": "life_style_members",
    "yahad": "yahad",
    "Adif-Members": "adif_members",
    "P100-Members": "p100_members",
    "Shachar-Club": "shachar_club",
    "Student-Group": "student_group",
    "Living-Plus-Members": "living_plus_members",
    "Meshekard": "meshekard",
    "Corporate-Members": "corporate_members",
    "Mevalim-Club": "mevalim_club",
    "Poalim-Wonder": "poalim_wonder",
    "Public-Accountants-Institute-Members": "public_accountants_institute_members",
    "PowerCard": "power_card",
    "Yoter": "yoter",
    "Mercantile-Smile": "mercantile_smile",
    "Vegan-Bonus": "vegan_bonus",
    "Insurance-Association-Members": "insurance_association_members",
    "Security-Forces-Benefit": "security_forces_benefit",
    "Student-Discounts": "student_discounts",
    "Discount-For-Senior-Citizens": "discount_for_senior_citizens",
}

# --- one-line deals ---------------------------------------------------------
SEGMENT_MARK = "•"
UNTIL_DATE = r"עד\s*[-:]?\s*(\d{1,2})[./](\d{1,2})[./](\d{2,4})"
UNTIL_TIME = "20:59:00"
CASHBACK_WORDS = r"(?i)החזר|קאשבק|צובר|cashback"
VOUCHER_WORDS = r"(?i)שובר|תו קנייה|תו קניה|גיפט|gift"
BOGO_WORDS = r"1\s*\+\s*1|אחד\s*\+\s*אחד"
DISCOUNT_WORDS = (
    r"(?i)הנחה|החזר|קאשבק|צובר|cashback|מבצע|הטבה|זיכוי|שובר|תו קנייה|תו קניה|גיפט|קופון"
)
LABEL_WORDS = r"טבעוני|צמחוני|כשר|חלאל|אורגני"
UP_TO_WORDS = r"""עד\s*-?\s*(?:\d+(?:\.\d+)?\s*(?:[%₪]|ש["״']?ח|שקל)|₪\s*\d)"""
PERCENT_FIGURE = r"(\d+(?:\.\d+)?)\s*%"
SHEKEL_WORD = r"""ש["״']?ח|שקלים|שקל"""
SHEKEL_FIGURE = r"(\d+(?:\.\d+)?)\s*(?:₪|" + SHEKEL_WORD + r")|₪\s*(\d+(?:\.\d+)?)"
SHEKEL_EACH = r"\d+(?:\.\d+)?\s*(?:₪|" + SHEKEL_WORD + r")"
FROM_WORDS = "החל מ"
ONLINE_WORDS = r"(?i)אונליין|באתר|online"
CONF_BOGO, CONF_IMPLAUSIBLE, CONF_UP_TO, CONF_PERCENT = 0.72, 0.3, 0.5, 0.8
CONF_AMBIGUOUS, CONF_SHEKEL = 0.45, 0.75
REASON_BOGO = "הטבת 1+1 ברורה מהכותרת, אך התנאים אינם מופיעים באיזי."
REASON_IMPLAUSIBLE = "אחוז לא סביר (%s%%) — צריך בדיקה ידנית."
REASON_UP_TO = 'הכותרת אומרת "עד %s%%" — זו תקרה ולא שיעור מובטח.'
REASON_CASHBACK = "שיעור ההחזר ברור מהכותרת באיזי; התנאים המלאים אינם מפורסמים שם."
REASON_PERCENT = "שיעור ההנחה ברור מהכותרת באיזי; התנאים המלאים אינם מפורסמים שם."
REASON_AMBIGUOUS = "הכותרת מציינת יותר מסכום אחד — לא ברור מה שווי ההטבה בפועל."
REASON_SHEKEL = "סכום ההטבה ברור מהכותרת באיזי; התנאים המלאים אינם מפורסמים שם."
REASON_NO_VALUE = "no numeric benefit value stated"

# --- enrichment -------------------------------------------------------------
# Source category text -> merchant category; the first matching rule wins.
CATEGORY_RULES = [
    (r"דלק|תדלוק|תחנת דלק", "fuel"),
    (r"סופרמרקט|מכולת|רשת מזון|ירקות|פירות|מאפי|קצבי", "grocery"),
    (r"בית מרקחת|פארם", "pharmacy"),
    (r"אופנה|בגדים|נעליים|תיקים|הלבשה", "fashion"),
    (r"חשמל|מחשבים|סלולר|אלקטרוניקה|ציוד היקפי", "electronics"),
    (r"מסעד|קפה|פיצרי|המבורגר|סושי|בר |פאב|קייטרינג|מקום לאכול|גריל|שווארמה|פלאפל", "dining"),
    (r"רהיט|עיצוב הבית|כלי בית|עשה זאת בעצמך|מטבח", "home"),
    (r"קולנוע|תיאטרון|מופע|בילוי|ספורט|כושר|מלון|נופש|פארק", "leisure"),
    (r"ספרים|ספרי", "books"),
    (r"קוסמטיק|איפור|יופי|ספר |מספר|טיפוח|ציפורניים", "beauty"),
]

PARENT_BY_LIST = {
    "max-Kranot": "max",
    "max-Tmura": "max",
    "My-MAX": "max",
    "Isracard-TOP-Members": "isracard",
    "youngstyle": "isracard",
    "Tefahot-Card": "isracard",
    "Calextra-Discounts": "cal",
}
LISTS_NOT_CLUBS = [
    "Special-Offers", "SMB-Vouchers", "End-Of-Day-Deals", "Happy-Hour", "Tuesday-Market",
    "Business-Menu", "Late-Night-Deal", "Brunch", "All-you-can-eat", "Shawarma-Deal",
    "Happy-Gift", "Wishing-Well", "Discounts", "Ramat-Gan-buy-Local",
    "Menashe-Regional-Council-For-Businesses", "Metzer", "Businesses-Week-in-Rishon-LeZion",
    "Supporting-businesses-in-Ashkelon", "Emek-Yizrael-businesses",
]
LISTS_ALREADY_MAPPED = [
    "MAX", "Cal-Discount", "Isracard-Discounts", "Isracard-Chever", "Behatsdaa",
    "MAX-Behatsdaa", "Hitech-Zone-members", "Kranot-Police", "Shufersal4u",
]
CARD_WORDS = (
    r"(?i)כרטיס|card|אשראי|mastercard|visa|amex|diners|אמקס|דיינרס|כאל|ישראכרט|max"
    r"|לאומי|מזרחי|דיסקונט|מרכנתיל|פועלים"
)
EMPLOYER_WORDS = (
    r"(?i)ארגון|עובדי|קרנות|גמלאי|מורים|שוטרים|אגד|הסתדרות|סטודנט|אוניברסיט|הייטק|ביטוח|רואי חשבון"
)
CATEGORY_BY_PROGRAM = {
    "rami_levy_club": "retail_club",
    "tau": "employer_club",
    "tov_plus_club": "retail_club",
    "yours_club": "retail_club",
    "your_club_for_pensioner": "retail_club",
}
LIST_URL = "https://easy.co.il/list/"
PROGRAM_HINT = "הטבות %s — כפי שמופיעות באיזי"

# --- page text --------------------------------------------------------------
NAMED_ENTITIES = {
    "nbsp": " ", "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "shy": "",
    "ndash": "–", "mdash": "—", "hellip": "…", "laquo": "«", "raquo": "»", "bull": "•",
    "middot": "·", "deg": "°", "times": "×", "trade": "™", "reg": "®", "copy": "©",
    "euro": "€", "pound": "£", "agorot": "₪", "ils": "₪",
}
OFFER_TERMS = r"הנחה|הנחות|מבצע|מבצעים|הטבה|הטבות|קופון|שובר|זיכוי|קאשבק|החזר|מועדון|%|₪"
CHARSET_IN_HEADER = r"""(?i)charset=["']?\s*([\w-]+)"""
CHARSET_IN_META = r"""(?i)<meta[^>]+charset=["']?\s*([\w-]+)"""
HEAD_BYTES = 4096
JSON_LD_BLOCK = r"""(?is)<script\b[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
JSON_LD_MIN, JSON_LD_MAX, JSON_LD_TOTAL = 3, 399, 4_000
JSON_LD_SKIP = r"^(https?:|/|#|\{)"
TEXT_FLOOR = 800
SHELL_HTML, SHELL_RATIO, SHELL_TEXT = 200_000, 0.01, 5_000
TERMS_FLOOR = 3
PAGE_TEXT_CAP = 60_000
PAGE_TEXT_MARK = "\n[...truncated]"
DROPPED_ELEMENTS = ["script", "style", "noscript"]
DROPPED_ELEMENT = r"(?is)<{tag}\b[^>]*>.*?</{tag}>"
COMMENT = r"(?s)<!--.*?-->"
BLOCK_END = r"(?i)</(p|div|li|tr|h[1-6]|section|article|br)\s*>"
ANY_TAG = r"<[^>]+>"
SPACE_RUN = r"[ \t\u00a0]+"
BLANK_LINES = r"\n\s*\n\s*\n+"
SAY_TOO_SHORT = "only %d chars of text — likely JS-rendered or an error page"
SAY_SHELL = "%d chars of HTML but only %d of text — a client-rendered shell"
SAY_NO_TERMS = "no offer vocabulary in %d chars — wrong page for this program"

# --- links, names and quoted spans ------------------------------------------
FIRST_LINK = r"""(?i)(https?://[^\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"'<>]+)"""
QUOTED_SPANS = ['"[^"]*"', "״[^״]*״"]
NOT_IN_SLUG = r"[^\p{L}\p{N}]+"
CAMEL_BREAK = "([a-z0-9])([A-Z])"
NOT_IN_PROGRAM_ID = "[^A-Za-z0-9]+"
