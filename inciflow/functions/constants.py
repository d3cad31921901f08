"""Fixed values of the domain: word lists, code maps, thresholds and patterns.

Every value here has to be exactly what it is for results to be right, so each
is written out plainly and in its natural order.  Patterns use ECMAScript
semantics; ``functions.text`` and ``plans.duck`` adapt them to Java and RE2.
"""

# ---------------------------------------------------------------- profile codes
# Enum members accepted for a profile.
SKIN_TYPES = ["DRY", "OILY", "COMBINATION", "NORMAL", "SENSITIVE"]
HAIR_TYPES = ["STRAIGHT", "WAVY", "CURLY", "COILY"]
HAIR_DENSITIES = ["THIN", "MEDIUM", "THICK"]
SCALP_TYPES = ["DRY", "OILY", "NORMAL", "COMBINATION", "SENSITIVE"]
SENSITIVITIES = ["NOT_SENSITIVE", "SLIGHTLY_SENSITIVE", "MODERATELY_SENSITIVE", "VERY_SENSITIVE"]
SKIN_CONCERNS = [
    "ACNE", "PIGMENTATION", "DARK_SPOTS", "REDNESS", "DRYNESS", "EXCESS_OIL",
    "LARGE_PORES", "FINE_LINES", "WRINKLES", "UNEVEN_SKIN_TONE", "DULLNESS", "DEHYDRATION",
]
HAIR_CONCERNS = [
    "DANDRUFF", "HAIR_FALL", "DRY_HAIR", "FRIZZ", "SPLIT_ENDS", "OILY_SCALP",
    "ITCHY_SCALP", "HAIR_BREAKAGE", "THIN_HAIR", "COLOR_DAMAGED_HAIR",
]
ALLERGIES = [
    "FRAGRANCE", "ALCOHOL", "ESSENTIAL_OILS", "PARABENS", "SULFATES", "LANOLIN",
    "FORMALDEHYDE_RELEASERS", "NONE", "OTHER",
]
SKIN_GOALS = [
    "HYDRATION", "BRIGHTENING", "ACNE_CONTROL", "OIL_CONTROL", "BARRIER_REPAIR",
    "ANTI_AGING", "EVEN_SKIN_TONE", "REDUCE_REDNESS", "SMOOTH_TEXTURE",
]
HAIR_GOALS = [
    "DANDRUFF_CONTROL", "HAIR_GROWTH", "FRIZZ_CONTROL", "REPAIR_DAMAGE", "DEEP_HYDRATION",
    "STRENGTHEN_HAIR", "SHINE", "SMOOTH_HAIR", "VOLUME", "SCALP_HEALTH",
]
AVOID_CODES = [
    "SULFATES", "SILICONES", "DRYING_ALCOHOLS", "FRAGRANCE", "ESSENTIAL_OILS",
    "MINERAL_OIL", "PARABENS", "NONE", "OTHER",
]
MAKEUP_USAGE = ["NEVER", "OCCASIONALLY", "WEEKLY", "DAILY"]
AGE_GROUPS = ["BELOW_18", "AGE_18_25", "AGE_26_35", "AGE_36_45", "ABOVE_45"]
GENDERS = ["FEMALE", "MALE", "PREFER_NOT_TO_SAY", "OTHER"]
MAX_FREE_TEXT = 120

# Marker in front of the JSON kept inside a profile's free-text allergy column.
PROFILE_EXTENSION_PREFIX = "__PROFILE_EXT__"

# ---------------------------------------------------------------- dimension maps
# Code -> benefit dimensions.
CONCERN_DIMENSIONS = {
    "ACNE": ["ACNE", "EXCESS_OIL", "LARGE_PORES"],
    "PIGMENTATION": ["PIGMENTATION", "DARK_SPOTS", "UNEVEN_SKIN_TONE"],
    "DARK_SPOTS": ["DARK_SPOTS", "PIGMENTATION", "UNEVEN_SKIN_TONE"],
    "REDNESS": ["REDNESS", "BARRIER_REPAIR"],
    "DRYNESS": ["DRYNESS", "HYDRATION", "DEHYDRATION", "BARRIER_REPAIR"],
    "EXCESS_OIL": ["EXCESS_OIL", "ACNE", "LARGE_PORES"],
    "LARGE_PORES": ["LARGE_PORES", "ACNE", "EXCESS_OIL", "SMOOTH_TEXTURE"],
    "FINE_LINES": ["FINE_LINES", "ANTI_AGING", "SMOOTH_TEXTURE"],
    "WRINKLES": ["WRINKLES", "ANTI_AGING", "SMOOTH_TEXTURE"],
    "UNEVEN_SKIN_TONE": ["UNEVEN_SKIN_TONE", "PIGMENTATION", "DARK_SPOTS"],
    "DULLNESS": ["BRIGHTENING", "UNEVEN_SKIN_TONE", "SMOOTH_TEXTURE"],
    "DEHYDRATION": ["DEHYDRATION", "HYDRATION", "DRYNESS", "BARRIER_REPAIR"],
}
GOAL_DIMENSIONS = {
    "HYDRATION": ["HYDRATION", "DEHYDRATION", "DRYNESS", "BARRIER_REPAIR"],
    "BRIGHTENING": ["PIGMENTATION", "DARK_SPOTS", "UNEVEN_SKIN_TONE"],
    "ACNE_CONTROL": ["ACNE", "EXCESS_OIL", "LARGE_PORES", "SMOOTH_TEXTURE"],
    "OIL_CONTROL": ["EXCESS_OIL", "ACNE", "LARGE_PORES"],
    "BARRIER_REPAIR": ["BARRIER_REPAIR", "HYDRATION", "DRYNESS", "DEHYDRATION", "REDNESS"],
    "ANTI_AGING": ["ANTI_AGING", "FINE_LINES", "WRINKLES", "SMOOTH_TEXTURE"],
    "EVEN_SKIN_TONE": ["UNEVEN_SKIN_TONE", "PIGMENTATION", "DARK_SPOTS"],
    "REDUCE_REDNESS": ["REDNESS", "BARRIER_REPAIR"],
    "SMOOTH_TEXTURE": ["SMOOTH_TEXTURE", "LARGE_PORES", "FINE_LINES"],
}
FUNCTION_DIMENSIONS = {
    "HUMECTANT": ["HYDRATION", "DEHYDRATION", "DRYNESS"],
    "BARRIER_SUPPORT": ["BARRIER_REPAIR", "HYDRATION", "DEHYDRATION", "DRYNESS"],
    "BARRIER_REPAIR": ["BARRIER_REPAIR", "HYDRATION", "DEHYDRATION", "DRYNESS"],
    "WATER_RETENTION_SUPPORT": ["BARRIER_REPAIR", "HYDRATION", "DEHYDRATION", "DRYNESS"],
    "SKIN_REPLENISHING": ["HYDRATION", "SMOOTH_TEXTURE", "ANTI_AGING"],
    "SKIN_CONDITIONING": ["DRYNESS", "HYDRATION", "BARRIER_REPAIR", "SMOOTH_TEXTURE"],
    "SOOTHING": ["REDNESS", "BARRIER_REPAIR"],
    "ANTI_INFLAMMATORY": ["REDNESS", "BARRIER_REPAIR", "ACNE"],
    "BRIGHTENING": ["PIGMENTATION", "DARK_SPOTS", "UNEVEN_SKIN_TONE"],
    "SEBUM_CONTROL": ["EXCESS_OIL", "ACNE", "LARGE_PORES"],
    "KERATOLYTIC": ["ACNE", "SMOOTH_TEXTURE", "LARGE_PORES"],
    "EXFOLIANT": ["ACNE", "SMOOTH_TEXTURE", "LARGE_PORES", "UNEVEN_SKIN_TONE"],
    "COMEDOLYTIC": ["ACNE", "LARGE_PORES", "EXCESS_OIL"],
    "ANTIOXIDANT": ["ANTI_AGING", "FINE_LINES", "WRINKLES", "SMOOTH_TEXTURE"],
    "ANTIOXIDANT_SUPPORT": ["ANTI_AGING", "FINE_LINES", "WRINKLES", "SMOOTH_TEXTURE"],
    "ANTIMICROBIAL_SUPPORT": ["ACNE"],
    "EMOLLIENT": ["DRYNESS", "HYDRATION", "BARRIER_REPAIR"],
    "OCCLUSIVE": ["DRYNESS", "HYDRATION", "BARRIER_REPAIR"],
    "FILM_FORMING": ["HYDRATION", "SMOOTH_TEXTURE"],
    "ASTRINGENT": ["EXCESS_OIL", "LARGE_PORES"],
}
TAG_DIMENSIONS = {
    "HYDRATING": ["HYDRATION", "DEHYDRATION", "DRYNESS"],
    "BARRIER_SUPPORT": ["BARRIER_REPAIR", "HYDRATION", "DEHYDRATION", "DRYNESS"],
    "TONE_EVENING": ["PIGMENTATION", "DARK_SPOTS", "UNEVEN_SKIN_TONE"],
    "ANTI_ACNE": ["ACNE", "EXCESS_OIL", "LARGE_PORES"],
    "OIL_CONTROL": ["EXCESS_OIL", "ACNE"],
    "SOOTHING": ["REDNESS", "BARRIER_REPAIR"],
    "ANTIOXIDANT": ["ANTI_AGING", "FINE_LINES", "WRINKLES", "SMOOTH_TEXTURE"],
}
# Dimensions every dry / oily / sensitive profile wants.
DRY_DIMENSIONS = ["DRYNESS", "HYDRATION", "BARRIER_REPAIR"]
OILY_DIMENSIONS = ["EXCESS_OIL", "ACNE", "LARGE_PORES"]
SENSITIVE_DIMENSIONS = ["REDNESS", "BARRIER_REPAIR"]
DRY_FOCUS = ["HYDRATION", "DEHYDRATION", "DRYNESS", "BARRIER_REPAIR"]
OILY_FOCUS = ["ACNE", "EXCESS_OIL", "LARGE_PORES"]
DIMENSION_LABELS = {
    "ACNE": "acne support",
    "PIGMENTATION": "pigmentation support",
    "DARK_SPOTS": "dark spot support",
    "UNEVEN_SKIN_TONE": "even tone support",
    "REDNESS": "redness support",
    "DRYNESS": "dryness support",
    "HYDRATION": "hydration support",
    "DEHYDRATION": "dehydration support",
    "EXCESS_OIL": "oil control support",
    "LARGE_PORES": "pore-refining support",
    "SMOOTH_TEXTURE": "texture-smoothing support",
    "BARRIER_REPAIR": "barrier support",
    "ANTI_AGING": "anti-aging support",
    "FINE_LINES": "fine line support",
    "WRINKLES": "wrinkle support",
}
# Trigger words behind an allergy or avoid code.
_FRAGRANCE = ["FRAGRANCE", "FRAGRANCE_ALLERGY", "PARFUM", "PERFUME"]
_ESSENTIAL = ["ESSENTIAL_OILS", "ESSENTIAL_OIL", "ESSENTIAL-OIL"]
_PARABENS = ["PARABENS", "PARABEN"]
_SULFATES = ["SULFATES", "SULFATE", "ALPHA_OLEFIN_SULFONATE", "SODIUM_C14_16_ALPHA_OLEFIN_SULFONATE"]
_ALCOHOLS = ["ALCOHOL", "ALCOHOL_DENAT", "DENATURED_ALCOHOL", "ETHANOL", "DRYING_ALCOHOLS"]
ALLERGY_TRIGGERS = {
    "FRAGRANCE": _FRAGRANCE,
    "ALCOHOL": _ALCOHOLS,
    "ESSENTIAL_OILS": _ESSENTIAL,
    "PARABENS": _PARABENS,
    "SULFATES": _SULFATES,
    "LANOLIN": ["LANOLIN"],
    "FORMALDEHYDE_RELEASERS": ["FORMALDEHYDE_RELEASERS", "FORMALDEHYDE_RELEASER"],
}
AVOID_TRIGGERS = {
    "FRAGRANCE": _FRAGRANCE,
    "ESSENTIAL_OILS": _ESSENTIAL,
    "PARABENS": _PARABENS,
    "DRYING_ALCOHOLS": _ALCOHOLS,
    "SULFATES": _SULFATES,
    "SILICONES": ["SILICONE", "SILICONES", "DIMETHICONE", "CYCLOPENTASILOXANE"],
    "MINERAL_OIL": ["MINERAL_OIL", "MINERAL OIL"],
    "OTHER": [],
}
EVIDENCE_MULTIPLIERS = {"HIGH": 1.15, "MODERATE": 1.0, "MIXED": 0.82, "LOW": 0.75, "REFERENCE": 0.65}
EVIDENCE_DEFAULT = 0.7
SENSITIVITY_MULTIPLIERS = {"VERY_SENSITIVE": 1.6, "MODERATELY_SENSITIVE": 1.35, "SLIGHTLY_SENSITIVE": 1.15}

# ---------------------------------------------------------------- position tiers
# Last zero-based rank of a tier, range label, influence weight.
POSITION_TIERS = [
    (2, "10-50%", 1.0),
    (5, "5-15%", 0.8),
    (9, "2-8%", 0.6),
    (19, "0.5-3%", 0.35),
    (None, "0.1-1%", 0.18),
]
LOW_DOSE_NAMES = ["fragrance", "phenoxyethanol", "sodium benzoate", "citric acid"]
LOW_DOSE_FROM = 10
LOW_DOSE = ("<0.5%", 0.12)

# ---------------------------------------------------------------- name synonyms
# Compact key -> the name it stands for.
SYNONYMS = {
    "ha": "sodium hyaluronate",
    "hyaluronic": "hyaluronic acid",
    "hyaluronicacid": "hyaluronic acid",
    "vitamine": "tocopherol",
    "vitaminb5": "panthenol",
    "vitb5": "panthenol",
    "ricewater": "oryza sativa extract",
    "cica": "centella asiatica extract",
    "centella": "centella asiatica extract",
    "salicylic": "salicylic acid",
    "bha": "salicylic acid",
    "aloe": "aloe barbadensis leaf juice",
}

# ---------------------------------------------------------------- verification
MIN_LIST_SIZE = 8
# Words that give marketing text away.
MARKETING_WORDS = [
    "benefits", "why you'll love it", "why we love it", "hero ingredients", "good to know",
    "key ingredients", "how to use", "about this item", "product details", "description",
]
EMOJI_PATTERN = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
SENTENCE_PATTERN = r"[.!?:][^\n\r\x{2028}\x{2029}]{10,}"
PERCENT_ONLY_PATTERN = r"^\s*\d+(?:\.\d+)?%\s*$"
INCI_CHARS_PATTERN = r"^[a-z0-9\x{C0}-\x{FF}()\[\]{}+'./%&\-\s]+$"
INCI_SUFFIX_PATTERN = (
    r"(?:acid|ate|ide|one|ol|ene|in|um|extract|oil|water|juice|gum|wax|butter|fragrance|parfum|powder"
    r"|ferment|filtrate|peptide|collagen|ceramide|colorant|ci\s*\d+)$"
)
INCI_WORDS_PATTERN = r"^[a-z][a-z0-9()+'.\-/]*(?:\s+[a-z0-9][a-z0-9()+'.\-/]*){0,4}$"

# ---------------------------------------------------------------- product titles
# Title noise, removed everywhere and in this order.
TITLE_NOISE = [
    r"\bpack of \d+\b", r"\bcombo\b", r"\bfree gift\b", r"\bfreebie\b", r"\btrial pack\b",
    r"\bbest seller\b", r"\bbestseller\b", r"\blimited edition\b", r"\bnew\b", r"\btrending\b",
    r"\bviral\b", r"\bmust have\b", r"\bworth the hype\b", r"\|\s*[^|]+$", r"\(([^)]*pack[^)]*)\)",
]
# Marketing phrases, only the first hit of each is removed.
TITLE_MARKETING = [
    r"\bbrightens skin\b", r"\bfor bright skin\b", r"\bhelps fade blemishes\b",
    r"\bsoftens(?:\s*&|\s+and)?\s*smoothens skin\b", r"\bsmoothens skin\b",
    r"\bdeep(?:ly)? cleans(?:es|ing)?\b", r"\bcontrols? oil\b", r"\bprevents? acne\b",
    r"\bfades? acne marks\b", r"\bhelps reduce blemishes\b", r"\bhelps reduce dark spots\b",
    r"\bboosts? glow\b", r"\bgives? glowing skin\b", r"\bfor glowing skin\b", r"\bfor radiant skin\b",
    r"\bfor oily skin\b", r"\bsuitable for all skin types\b", r"\bdermatologically tested\b",
    r"\bwith\s+[a-z0-9 +&%-]{3,40}$",
]
SIZE_PATTERN = r"\b\d+(?:\.\d+)?\s?(?:ml|g|gm|kg|oz|fl oz|l)\b"
SKU_PATTERNS = [
    r"\bsku\s*[:#-]?\s*([a-z0-9-]{4,})\b",
    r"\bitem\s*code\s*[:#-]?\s*([a-z0-9-]{4,})\b",
    r"\bmodel\s*[:#-]?\s*([a-z0-9-]{4,})\b",
    r"\bhsn\s*[:#-]?\s*([a-z0-9-]{4,})\b",
]
BARE_SKU_PATTERN = r"^[A-Z0-9-]{4,}$"
# Ordered category rules.
CATEGORY_RULES = [
    ("Face Wash", ["face wash", "facewash", "cleanser", "facial cleanser"]),
    ("Face Cream", ["face cream", "night cream", "day cream"]),
    ("Moisturizer", ["moisturizer", "moisturiser", "lotion"]),
    ("Sunscreen", ["sunscreen", "sun screen", "spf"]),
    ("Serum", ["serum"]),
    ("Body Wash", ["body wash", "shower gel", "beauty bar", "soap bar", "soap"]),
    ("Body Lotion", ["body lotion", "body cream"]),
    ("Shampoo", ["shampoo"]),
    ("Conditioner", ["conditioner"]),
    ("Hair Serum", ["hair serum", "hair oil"]),
]
DEFAULT_CATEGORY = "Product"
CATEGORY_SYNONYMS = [
    ("face wash", "Face Wash"), ("face cleanser", "Face Wash"), ("facial cleanser", "Face Wash"),
    ("cleanser", "Face Wash"), ("gentle skin cleanser", "Face Wash"), ("face cream", "Face Cream"),
    ("day cream", "Face Cream"), ("night cream", "Face Cream"), ("moisturizer", "Moisturizer"),
    ("moisturiser", "Moisturizer"), ("lotion", "Moisturizer"), ("body lotion", "Body Lotion"),
    ("body cream", "Body Lotion"), ("body wash", "Body Wash"), ("soap bar", "Body Wash"),
    ("beauty bar", "Body Wash"), ("soap", "Body Wash"), ("sunscreen", "Sunscreen"),
    ("sun screen", "Sunscreen"), ("spf", "Sunscreen"), ("serum", "Serum"), ("shampoo", "Shampoo"),
    ("conditioner", "Conditioner"), ("hair serum", "Hair Serum"), ("hair oil", "Hair Serum"),
]
VARIANT_PATTERNS = [
    r"((?:\d+(?:\.\d+)?%\s*[a-z0-9 +&-]+)(?:\s*\+\s*[a-z0-9 +&-]+)+)",
    r"((?:with|infused with)\s+[a-z0-9 +&%,-]+)",
    r"((?:fragrance free|soap free|sulfate free|paraben free)[a-z0-9 +&%,-]*)",
    r"(\([^)]*(?:%|acid|niacinamide|ceramide|vitamin|cica|hyaluronic)[^)]*\))",
]
CORE_VERB_TAIL = r"\b(?:brightens|softens|smoothens|controls|prevents|fades|boosts)\b[^\n\r]*$"
CORE_FOR_PHRASE = r"\b(?:for|with)\s+(?:all\s+skin\s+types|daily\s+use|men|women)\b"
# Words that end a leading brand.
BRAND_BOUNDARY_WORDS = [
    "acne", "acid", "aha", "aloe", "anti", "barrier", "bha", "body", "bright", "brightening",
    "cleanser", "cleansing", "coconut", "conditioner", "control", "cream", "daily", "dry", "ceramide",
    "face", "facial", "gel", "gentle", "glow", "glycolic", "hair", "hyaluronic", "hydrating",
    "hydration", "lactic", "lotion", "moisturizer", "moisturiser", "niacinamide", "night", "oil",
    "oily", "oat", "peptide", "pha", "retinol", "rice", "salicylic", "serum", "shampoo", "skin",
    "spf", "sunscreen", "tea", "toner", "vitamin", "wash", "water", "zinc",
]
HOST_NOISE_WORDS = [
    "www", "com", "co", "in", "net", "org", "shop", "store", "beauty", "cosmetic", "cosmetics",
    "official", "india", "global",
]
STOP_WORDS = [
    "the", "and", "for", "with", "face", "skin", "care", "cream", "serum", "wash", "cleanser",
    "moisturizer", "moisturiser", "lotion", "spf", "shampoo", "conditioner", "product", "ml", "g",
]
BRAND_CUT = r"\b(?:face|skin|serum|cream|wash|cleanser|moisturizer|sunscreen|shampoo|conditioner)\b"
EXPLICIT_BRAND_PATTERNS = [
    r"\bbrand\s*[:\-]\s*([a-z0-9 &.'-]{2,80})",
    r"\bmanufacturer\s*[:\-]\s*([a-z0-9 &.'-]{2,80})",
    r"\bby\s+([a-z0-9 &.'-]{2,60})(?:" + BRAND_CUT + r"|$)",
]
NON_PRODUCT_SEGMENTS = [
    "p", "dp", "gp", "ip", "product", "products", "shop", "buy", "item", "catalog", "collection",
    "collections", "search",
]
SEGMENT_KEYWORDS = (
    r"ingredient|face|wash|cleanser|serum|cream|moisturi[sz]er|sunscreen|shampoo|conditioner|lotion|body"
)
SEGMENT_CAMPAIGN = r"\b(?:utm|campaign|google|ads|banner|invite)\b"
QUERY_SUFFIXES = ["ingredients", "INCI", "composition", "full ingredients", "product details"]

# ---------------------------------------------------------------- product matching
MATCH_ACCEPT = 85
MATCH_REVIEW = 70
MATCH_WEIGHTS = {"brand": 40, "type": 25, "actives": 20, "concerns": 10, "variant": 5}
SIMILARITY_FLOOR = 0.65
PACK_PATTERN = r"\b\d+(?:\.\d+)?\s?(?:ml|g|gm|kg|oz|fl oz|l|pcs|pc|count)\b"
MATCH_NOISE = [
    r"\bbest seller\b", r"\bbestseller\b", r"\bnew\b", r"\bsale\b", r"\boffer\b", r"\bdiscount\b",
    r"\blimited edition\b", r"\bcontrols oil\b", r"\bdermatologically tested\b",
    r"\bclinically proven\b", r"\bbrightens skin\b", r"\bhydrating formula\b", r"\bprevents acne\b",
    r"\bfades acne marks\b", r"\bfor all skin types\b", r"\bwith pump\b",
]
ACTIVE_RULES = [
    ("salicylic acid", [r"\bsalicylic acid\b", r"\b(?:2%|1%|0\.5%)\s*salicylic\b", r"\bbha\b"]),
    ("niacinamide", [r"\bniacinamide\b", r"\bvitamin b3\b"]),
    ("panthenol", [r"\bpanthenol\b", r"\bvitamin b5\b"]),
    ("hyaluronic acid", [r"\bhyaluronic acid\b", r"\bha\b", r"\bsodium hyaluronate\b"]),
    ("tocopherol", [r"\btocopherol\b", r"\bvitamin e\b"]),
    ("centella asiatica extract", [r"\bcentella asiatica\b", r"\bcica\b"]),
    ("zinc pca", [r"\bzinc pca\b", r"\bzinc\b"]),
    ("ceramides", [r"\bceramide(?:s)?\b"]),
    ("vitamin c", [r"\bvitamin c\b", r"\bascorbic acid\b", r"\bethyl ascorbic acid\b"]),
    ("retinol", [r"\bretinol\b", r"\bgranactive retinoid\b"]),
    ("glycolic acid", [r"\bglycolic acid\b"]),
    ("lactic acid", [r"\blactic acid\b"]),
    ("tea tree", [r"\btea tree\b"]),
]
CONCERN_RULES = [
    ("acne", [r"\bacne\b", r"\bacne prone\b", r"\bbreakout(?:s)?\b"]),
    ("oily skin", [r"\boily skin\b", r"\boil control\b", r"\bcontrols oil\b", r"\bexcess oil\b", r"\boil balancing\b"]),
    ("post acne marks", [r"\bacne marks\b", r"\bpost acne marks\b", r"\bpost-acne marks\b"]),
    ("pigmentation", [r"\bpigmentation\b", r"\bdark spots?\b", r"\buneven skin tone\b"]),
    ("dry skin", [r"\bdry skin\b", r"\bdry to normal\b", r"\bdryness\b", r"\bhydration\b", r"\bhydrating\b"]),
    ("normal skin", [r"\bnormal skin\b", r"\bdry to normal\b"]),
    ("sensitive skin", [r"\bsensitive skin\b", r"\bsensitivity\b", r"\bredness\b", r"\bgentle\b"]),
    ("barrier repair", [r"\bbarrier repair\b", r"\bskin barrier\b"]),
    ("anti-aging", [r"\banti[- ]aging\b", r"\bwrinkles?\b", r"\bfine lines?\b"]),
]

# ---------------------------------------------------------------- hosts and links
SEARCH_ENGINE_HOSTS = ["google.", "bing.", "search.yahoo.", "duckduckgo.", "yandex."]
NON_OFFICIAL_HOSTS = [
    "google.", "bing.", "duckduckgo.", "yahoo.", "yandex.", "reddit.", "youtube.", "instagram.",
    "facebook.", "pinterest.", "tiktok.", "linkedin.", "medium.", "wordpress.", "blogspot.",
]
NON_RETAIL_HOSTS = [
    "reddit.", "youtube.", "instagram.", "facebook.", "pinterest.", "tiktok.", "medium.",
    "wordpress.", "blogspot.",
]
BLOCKED_RESULT_HOSTS = [
    "blog", "wordpress", "medium.com", "reddit.com", "youtube.com", "instagram.com", "facebook.com",
]
MARKETPLACE_HOST = r"(^|\.)amazon\.(?:in|com|co\.uk|de|fr|it|es|ca|com\.au|co\.jp)$"
MARKETPLACE_IMAGE_HOST = (
    r"(^|\.)m\.media-amazon\.com$|(^|\.)images-(?:na|eu|fe)\.ssl-images-amazon\.com$"
    r"|(^|\.)images\.amazon\.com$"
)
MARKETPLACE_BRANDS = ["amazon", "amazon in", "myntra", "nykaa", "flipkart", "meesho", "ajio"]
TRUSTED_DATABASES = [
    ("INCI Decoder", "incidecoder.com"), ("CosDNA", "cosdna.com"), ("SkinSort", "skinsort.com"),
    ("Beautypedia", "beautypedia.com"), ("EWG", "ewg.org"), ("INC Beauty", "incibeauty.com"),
    ("SkinSAFE", "skinsafeproducts.com"), ("Paula's Choice", "paulaschoice.com"),
    ("Sephora", "sephora.com"), ("Ulta", "ulta.com"), ("Lookfantastic", "lookfantastic.com"),
]
LISTING_URL_MARKERS = ["/search", "?q=", "&q=", "search=", "/collections", "/collection", "/catalog"]
LISTING_TITLE_MARKERS = ["search results", "results found", "all products", "shop all", "collection"]
ANTI_BOT_PATTERN = (
    r"captcha|robot|verify\s+(?:you|yourself)|unusual traffic|access denied|request blocked|are you human"
    r"|security check|cloudflare|temporarily unavailable|automated access"
)

# ---------------------------------------------------------------- page extraction
HEADING_PATTERN = r"\b(?:full\s+)?ingredients?(?:\s+list)?\b|\binci\b|\bcomposition\b|\bwhat(?:'s| is)\s+inside\b"
PARTIAL_PATTERN = r"\b(?:key|hero|featured|active)\s+ingredients?\b|\bhighlights?\b|\bbenefits?\b"
STOP_PATTERN = (
    r"\b(?:directions?|how to use|usage|warnings?|caution|benefits?|description|reviews?|shipping|returns?"
    r"|faq|about)\b"
)
DOM_TRIM_STOP = (
    r"\b(?:please be aware|for refilled products|actual product packaging"
    r"|ingredient lists? (?:for|may|can|are)|directions?|how to use|usage|warnings?|caution|reviews?"
    r"|shipping|returns?)\b"
)
DOM_TRIM_LABEL = r"^(?:full\s+)?ingredients?(?:\s+list)?\s*:?\s*"
SIGNAL_WORDS = (
    r"\b(?:aqua|water|glycerin|glycol|acid|extract|oil|alcohol|sodium|potassium|fragrance|parfum)\b"
)
PAGE_SECTION_STOP = (
    r"directions|how to use|benefits|about this item|usage|warnings|manufacturer|customer care"
    r"|country of origin"
)
OCR_SECTION_STOP = (
    r"directions|how to use|usage|warnings|warning|caution|manufacturer|marketed by|country of origin"
    r"|customer care"
)
OCR_BULLETS = "[â€¢Â·]"
TEXT_MARKETING = [
    "key ingredients", "benefits", "why you'll love it", "why we love it", "good to know", "hero ingredients",
]
TEXT_SECTION_HEADS = [
    "ingredients[^a-z0-9]{0,12}",
    "full ingredients[^a-z0-9]{0,12}",
    "inci[^a-z0-9]{0,12}",
    "manufacturer[^a-z0-9]{0,12}ingredients[^a-z0-9]{0,12}",
    "product description[^a-z0-9]{0,24}ingredients[^a-z0-9]{0,12}",
]
TEXT_SECTION_BODY = r"[a-z0-9()/%+,.\-\s]"
TEXT_SECTION_MIN, TEXT_SECTION_MAX = 40, 2400
ITEM_SHAPE = r"^[a-z0-9()/%+\-\s]{3,}$"
FULL_LABEL = r"full ingredients?|inci|complete ingredients?|composition"
ANY_LABEL = r"ingredients?"
PARTIAL_LABEL = r"key ingredients?|hero ingredients?|benefits|why"
TRUNCATED = r"\.{3}|\x{2026}|\betc\.?\s*$"
CONSENSUS_FULL = r"\bfull ingredients?\b|\binci\b|\bcomplete ingredients?\b|\bcomposition\b"
CONSENSUS_PARTIAL = r"\b(?:key|hero|featured|active) ingredients?\b|\bhighlights?\b"
TITLE_SOURCE_WEIGHTS = [
    ("json_ld", 45), ("structured", 42), ("heading", 35), ("title", 28), ("breadcrumb", 22), ("fallback", 8),
]
JSON_INGREDIENT_KEY = r"(?:^|[_\-.])(?:full[_\-.]?)?(?:ingredients?|inci|composition|materials?)(?:$|[_\-.])"
JSON_PARTIAL_KEY = r"(?:key|hero|featured|active|highlight)[_\-.]?(?:ingredients?)?"
JSON_NAME_KEY = r"^(?:name|label|title|key)$"
JSON_NAME_VALUE = r"^(?:full\s+)?ingredients?(?:\s+list)?$|^inci$|^composition$"
JSON_VALUE_KEY = r"^(?:value|text|content|description|body|html)$"
JSON_TEXT_KEY = r"^(?:description|descriptionHtml|body_html|content|details)$"
JSON_TEXT_HEAD = r"(?:full\s+)?ingredients?(?:\s+list)?\s*:?\s*"
JSON_TEXT_STOP = r"\b(?:directions?|how to use|warnings?|benefits?|reviews?)\b"

# ---------------------------------------------------------------- images and labels
IMAGE_MAX = 12
IMAGE_EXTENSION = r"\.(?:jpe?g|png|webp|avif)(?:[?#]|$)"
IMAGE_HINT = (
    r"image|images|img|media|photo|picture|gallery|carousel|product|cdn|assets|upload|resize|width=|height="
    r"|w=|h=|format=|fm="
)
IMAGE_REJECT = (
    r"logo|sprite|placeholder|payment|badge|avatar|loader|tracking|pixel|favicon|swatch|icon-only"
    r"|social.share|advertising|sponsored"
)
IMAGE_REJECT_URL = r"/dp/(?:%7b|\{)|social_share=|cm_sw_r_|/x-locale/|fls-[a-z0-9.-]*amazon"
IMAGE_REJECT_EXT = r"\.(svg|gif)(?:\?|$)"
IMAGE_ACCEPT = r"main|product|gallery|media|carousel|thumbnail|thumb|zoom|pdp|variant|pack|label|ingredient|back|front"
IMAGE_SIZE_PATTERNS = [
    (r"[?&](?:width|height|w|h)=([0-9]{2,5})", 1),
    (r"(?:SX|SY|UX|UY|UL|SL)([0-9]{2,5})", 1),
    (r"([0-9]{2,5})x([0-9]{2,5})", 1),
    (r"([0-9]{2,5})x([0-9]{2,5})", 2),
    (r"[_-]([0-9]{2,5})(?:\.|_|-|$)", 1),
]
IMAGE_RANK_RULES = [
    (r"ingredient|ingredients|inci|composition", 60),
    (r"back|label|pack|package|packaging|side|details|panel", 34),
    (r"main|product|gallery|media|carousel|thumbnail|thumb|zoom|pdp|variant", 20),
    (r"network-response|json-ld|embedded|next|nuxt", 10),
    (r"front|hero|lifestyle|model|routine|banner|offer|ad|promo", -8),
]
IMAGE_DIMENSION_MARKER = r"\._[A-Z0-9_,.-]*(?:SX|SY|UX|UY|UL|SL|AC|SR|QL)[A-Z0-9_,.-]*_\."
IMAGE_LONG_MARKER = r"\._[A-Z0-9_,.-]{8,}_\."
IMAGE_ANY_MARKER = r"\._[A-Z0-9_,.-]*_\."
IMAGE_DROP_PARAMS = ["width", "height", "w", "h", "quality", "q", "format", "fm", "fit", "crop", "resize"]
IMAGE_URL_TAIL = (
    r"(?:\.(?:png|jpe?g|webp|avif)|/image/|/images/|/media/|/upload/|/products?/)[^\"'\s)<>]*"
)
LABEL_KEYWORDS = [
    "ingredients", "ingredient", "inci", "aqua", "water", "glycerin", "sodium", "fragrance",
    "tocopherol", "phenoxyethanol", "composition",
]
LABEL_COLOUR_INDEX = r"\bci\s*\d{3,5}\b|\bci\b"
LABEL_HEADING = r"\bingredients?\b|\binci\b|\bcomposition\b"
LABEL_USAGE = r"directions|how to use|manufactured by|marketed by|customer care"
DIRECT_URL_DROP = r"\b(?:daily|mild|cleanser|for all skin types?|soap free|balances? ph)\b"

# ---------------------------------------------------------------- benefits
# Concern and function statements.
CONCERN_BENEFITS = {
    "ACNE": "Helps reduce acne congestion.",
    "PIGMENTATION": "Supports a more even-looking tone.",
    "DARK_SPOTS": "Targets the look of dark spots.",
    "DRYNESS": "Helps relieve dryness.",
    "DEHYDRATION": "Helps reduce dehydration.",
    "HYDRATION": "Helps keep skin hydrated.",
    "FINE_LINES": "Supports smoother-looking skin.",
    "WRINKLES": "Supports softer-looking wrinkle lines.",
    "REDNESS": "Helps calm visible redness.",
    "EXCESS_OIL": "Helps manage excess oil.",
    "LARGE_PORES": "Supports a more refined-looking pore appearance.",
    "UNEVEN_SKIN_TONE": "Supports more even-looking skin tone.",
    "SENSITIVE_SKIN": "Can suit sensitive-feeling skin when tolerated.",
    "SENSITIVE": "Can suit sensitive-feeling skin when tolerated.",
    "BARRIER_DAMAGE": "Supports a weakened skin barrier.",
    "BARRIER_REPAIR": "Supports the skin barrier.",
    "ANTI_AGING": "Supports anti-aging goals.",
    "SMOOTH_TEXTURE": "Helps improve surface texture.",
}
FUNCTION_BENEFITS = {
    "HUMECTANT": "Draws water into the outer skin layers.",
    "EMOLLIENT": "Softens and smooths the skin surface.",
    "OCCLUSIVE": "Helps reduce transepidermal water loss.",
    "SURFACTANT": "Helps lift oil and debris during cleansing.",
    "PRESERVATIVE": "Helps keep the formula microbiologically stable.",
    "PRESERVATIVE_BOOSTER": "Supports preservative performance.",
    "ANTIOXIDANT": "Helps defend against oxidative stress.",
    "ANTIOXIDANT_SUPPORT": "Helps defend against oxidative stress.",
    "CHELATING_AGENT": "Helps improve formula stability.",
    "SOLVENT": "Helps dissolve or carry other ingredients.",
    "CONDITIONING_AGENT": "Helps improve skin feel.",
    "SKIN_CONDITIONING": "Helps improve skin feel.",
    "FILM_FORMING": "Forms a light film that helps reduce moisture loss.",
    "THICKENER": "Improves product texture and viscosity.",
    "VISCOSITY_CONTROLLING": "Improves product texture and viscosity.",
    "STABILIZER": "Helps keep the formula uniform and stable.",
    "PH_ADJUSTER": "Helps keep the formula in an effective pH range.",
    "BOTANICAL_EXTRACT": "Adds plant-derived support to the formula.",
    "ACTIVE_INGREDIENT": "Provides a direct treatment role in the formula.",
    "BARRIER_SUPPORT": "Supports the skin barrier.",
    "BARRIER_REPAIR": "Supports the skin barrier.",
    "BRIGHTENING": "Supports a brighter, more even-looking complexion.",
    "SEBUM_CONTROL": "Helps regulate excess oil.",
    "KERATOLYTIC": "Helps loosen buildup on the skin surface.",
    "EXFOLIANT": "Helps remove surface buildup for smoother skin.",
    "COMEDOLYTIC": "Helps reduce clogged pores.",
    "ANTI_INFLAMMATORY": "Helps calm inflammatory-looking skin changes.",
    "SOOTHING": "Helps calm discomfort and visible irritation.",
    "WATER_RETENTION_SUPPORT": "Supports water retention in the skin.",
    "SKIN_REPLENISHING": "Helps replenish the feel of dehydrated skin.",
    "TEXTURE_MODIFIER": "Improves product spreadability and feel.",
    "EMULSION_STABILIZER": "Helps oil and water phases stay mixed.",
    "ASTRINGENT": "Helps reduce the feeling of oiliness.",
    "FOAMING": "Supports foam generation during cleansing.",
    "CLEANSING": "Helps cleanse the skin or scalp.",
    "COOLING_AGENT": "Creates a cooling sensory effect.",
    "COUNTER_IRRITANT": "Creates a counter-irritant sensory effect.",
    "PENETRATION_ENHANCER": "Can help other ingredients spread or penetrate more easily.",
    "ANTIMICROBIAL_SUPPORT": "Provides antimicrobial support.",
    "PH_ADJUSTING": "Helps keep the formula in an effective pH range.",
}

# ---------------------------------------------------------------- cache lifetimes
RESULT_TTL_HOURS = 24
BRAND_TTL_HOURS = 24 * 30

# ---------------------------------------------------------------- quick score
QUICK_RISK_PENALTY = {"LOW": 2, "MEDIUM": 9, "HIGH": 18}
