"""Parameter tables: what the operators take as dimensions rather than as literals."""

from __future__ import annotations

# Local currency per US dollar.
RATES = {"SGD": 1.35, "MYR": 4.70, "IDR": 15750.0, "THB": 36.0, "INR": 83.5, "USD": 1.0, "GBP": 0.79, "AUD": 1.55, "VND": 25400.0, "AED": 3.67, "EUR": 0.93}

# Share of informal food spending.
INFORMAL_WEIGHTS = {
    "Singapore": 0.35, "Malaysia": 0.45, "Indonesia": 0.55, "Thailand": 0.50, "India": 0.60, "United States": 0.20, "United Kingdom": 0.15,
    "Australia": 0.20, "Vietnam": 0.60, "United Arab Emirates": 0.20,
}
DEFAULT_INFORMAL_WEIGHT = 0.40

ROW_CAP, CAP_SEED = 300, "42"
#: Draws of a permutation null.
DRAWS = 1000
MIN_STABLE_ITEMS, MIN_ITEM_MONTHS = 3, 2
PREMIUM, PORTION, HEDONIC_CAP = -0.05, 0.08, 0.15

# Markers of grocery and retail names.
GROCERY_MARKERS = [
    "sainsbury", "morrison", "tesco", "asda", "co-op", "co op", "waitrose", "wilko", "iceland", "aldi", "lidl", "spar", "marks and spencer", "m&s",
    "boots", "superdrug", "gopuff", "poundland", "wh smith", "costcutter", "nisa", "budgens", "londis",
]

# The ordered dish rules; the first keyword found in the lower-cased name decides.
CATEGORY_RULES = [
    ("NOODLE_DISH", ["noodle", "laksa", "ramen", "pho", "pad thai", "mee", "pasta", "udon", "soba", "spaghetti", "linguine"]),
    ("RICE_DISH", ["rice", "nasi", "biryani", "congee", "porridge", "fried rice", "risotto"]),
    ("SOUP_STEW", ["soup", "stew", "curry", "tom yum", "rendang", "broth", "dhal", "dal", "bak kut"]),
    ("DIM_SUM_DUMPLING", ["dumpling", "dim sum", "har gao", "siu mai", "gyoza", "bao", "xiao long", "wonton"]),
    ("BREAD_PASTRY", ["bread", "toast", "roti", "naan", "prata", "croissant", "muffin", "pastry"]),
    ("BEVERAGE", ["coffee", "tea", "juice", "beer", "wine", "drink", "latte", "cappuccino", "bubble tea", "smoothie", "milkshake", "water", "soda", "kopi", "teh"]),
    ("DESSERT", ["ice cream", "cake", "dessert", "pudding", "waffle", "tart", "mochi", "cendol", "brownie"]),
    ("FAST_FOOD", ["burger", "pizza", "fries", "nugget", "hot dog", "wrap", "fried chicken"]),
    ("SEAFOOD_DISH", ["fish", "prawn", "crab", "lobster", "oyster", "squid", "calamari", "salmon", "tuna", "seafood", "shrimp"]),
    ("SALAD_VEGETABLE", ["salad", "vegetable", "kimchi", "coleslaw"]),
    ("SNACK_SIDE", ["spring roll", "samosa"]),
    ("GRILLED_PROTEIN", ["satay", "bbq", "grilled", "steak", "chicken", "beef", "lamb", "pork", "roast"]),
    ("SET_MEAL", ["set meal", "combo", "value meal", "family set", "package"]),
]

# Quality signals and their keywords.
SIGNAL_RULES = {
    "PORTION_REDUCTION": ["mini", "small", "snack size", "lite", "half", "reduced", "less"],
    "PREMIUM_UPGRADE": ["premium", "special", "deluxe", "signature", "wagyu", "truffle", "aged", "fresh"],
    "INGREDIENT_CHANGE": ["new recipe", "improved", "real", "classic", "original", "traditional", "now with"],
    "SIZE_INCREASE": ["jumbo", "large", "big", "super", "xxl", "double", "extra"],
}

# Words that mark Malay names.
MALAY_WORDS = ["nasi", "mee", "ayam", "ikan", "teh", "kopi", "roti", "goreng"]

#: Rolling guardrails: posts with a product mention in so many days; removals among the last posts.
PROMO_CAP, PROMO_DAYS, REMOVAL_WINDOW, REMOVAL_RATE = 3, 7, 10, 0.2
#: Account health: anomaly gap, trend drops, slow burn window, rate, span in days.
GAP_ANOMALY, DROP_POINTS, DROP_SHARE, BURN_WINDOW, BURN_RATE, BURN_DAYS = 0.3, 50, 0.30, 30, 0.1, 7
#: Gap tasks: days looked back, citations looked at, share that makes a competitor dominant.
GAP_DAYS, GAP_TOP, DOMINANT = 14, 3, 0.8

# Phrases of which a post that mentions the product needs one; [brand] stands for a brand's name.
DISCLOSURE_PHRASES = [
    "disclosure:", "disclaimer:", "full disclosure", "i work on", "i work at", "i work for", "i'm one of the makers", "i'm one of the founders", "i'm a founder",
    "i'm a co-founder", "i'm the founder", "i help build", "i help make", "i built", "i made", "i co-founded", "[brand] employee", "[brand] team",
]

# Bounds of the latency histogram in seconds; days before an erasure; first id of opportunities that stand for tasks.
LATENCY_BUCKETS, ERASE_GRACE_DAYS, TASK_ID_OFFSET = (60, 300, 900, 3600, 14400, 86400), 30, 1_000_000_000
#: Legal steps of a draft: from (None: its first event) to.
DRAFT_STEPS = {None: ["draft"], "draft": ["edited", "published", "discarded"], "edited": ["published", "discarded"]}

# How a country's official CPI is published.
CPI_CLASS = {
    "United States": "real-monthly", "United Kingdom": "real-monthly", "India": "real-monthly", "Malaysia": "real-monthly", "Australia": "quarterly-interp",
    "Singapore": "annual-interp", "Thailand": "annual-interp", "Indonesia": "annual-interp", "Vietnam": "annual-step", "United Arab Emirates": "annual-step",
}

#: Categories that a structured reply may name.
CATEGORIES = [*dict.fromkeys(c for c, _ in CATEGORY_RULES), "OTHER"]

# The merge-time category guess.
GUESS_RULES = [
    ("RICE_DISH", ["rice", "nasi", "khao", "biryani", "fried rice", "nasi goreng"]),
    ("NOODLE_DISH", ["noodle", "mee", "mie", "pasta", "pad thai", "laksa", "pho", "ramen", "kuay teow", "kway teow"]),
    ("SOUP_STEW", ["soup", "stew", "curry", "laksa", "tom yum", "soto", "bak kut", "congee", "porridge"]),
    ("BREAD_PASTRY", ["bread", "roti", "prata", "toast", "bun", "cake", "pastry"]),
    ("MEAT_DISH", ["chicken", "beef", "pork", "mutton", "lamb", "duck", "satay", "ayam", "daging"]),
    ("SEAFOOD", ["fish", "prawn", "shrimp", "crab", "squid", "seafood", "ikan", "udang"]),
    ("VEGETABLE", ["vegetable", "veg", "tofu", "tempeh", "kangkung"]),
    ("BEVERAGE", ["coffee", "tea", "juice", "drink", "kopi", "teh", "water", "milk", "sugar cane"]),
    ("SNACK", ["snack", "fritter", "popiah", "dumpling", "dim sum", "goreng"]),
]

# Keywords of the reference labels, in order.
LABEL_RULES = [
    ("OTHER", ["new!", "tripadvisor:", "happy baking", "fast vegetarian"]),
    ("BEVERAGE", [
        "shake", "lemonade", "iced tea", "iced-t", "soda", "sprite", "fanta", "7 up", "7-up", "pepsi", "coca cola", "limoncello", "barley", "milk", "espresso",
        "cappuccino", "americano", "mocha", "latte", "smoothie", "juice", "tea", "coffee", "beer", "wine", "sake", "cocktail", "water",
    ]),
    ("NOODLE_DISH", ["noodle", "la mian", "lamian", "ramen", "udon", "soba", "chasoba", "kuey teow", "kway teow", "kuay teow", "mee ", "mee sup", "pho", "hor fun", "bee hoon", "mihun", "hokkien mee"]),
    ("DIM_SUM_DUMPLING", ["dumpling", "shao-mai", "shao mai", "shumai", "siu mai", "har gow", "har gao", "wonton", "wanton", "wantan", "xiao long bao", "xlb", "potsticker", "gyoza", "baozi", "char siu bao"]),
    ("SEAFOOD_DISH", ["sushi", "sashimi", "hamachi", "tako", "hotate", "kanikama", "negitoro", "maguro", "uni ", "salmon", "scallop", "shrimp", "prawn", "ebi", "fish & chips", "fish and chips", "fish ball", "seafood platter", "halibut", "tuna"]),
    ("BREAD_PASTRY", ["dosa", "thosai", "naan", "roti", "shio pan", "croissant", "muffin", "doughnut", "donut", "bagel", "scone", "toast", "baguette", "bun bakar", "bao "]),
    ("DESSERT", ["cake", "ice cream", "gelato", "pudding", "mochi", "cheesecake", "tiramisu", "mango sticky", "creme brulee", "layered cake"]),
    ("RICE_DISH", ["fried rice", "rice", "donburi", "don ", "khao pad", "khao kha", "khao man", "biryani", "nasi lemak", "nasi goreng"]),
    ("SOUP_STEW", ["soup", "tom yum", "tom yam", "tom kha", "miso soup", "broth", "stew", "braised"]),
    ("GRILLED_PROTEIN", ["yakiniku", "yakitori", "satay", "kebab", "bbq", "grilled", "roast ", "roasted ", "char siu", "tandoori", "teriyaki", "karaage", "katsu"]),
    ("FAST_FOOD", ["burger", "cheeseburger", "fries", "hot dog", "pizza", "margherita", "sandwich"]),
    ("SALAD_VEGETABLE", ["salad", "vegetable", "veggie", "kailan", "long beans", "kale", "spinach"]),
    ("SNACK_SIDE", ["spring roll", "egg roll", "fried bait", "intestines", "chuka ", "edamame", "potato wedges"]),
    ("SET_MEAL", ["set ", "platter", "gozen"]),
]
