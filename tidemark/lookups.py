"""Word lists, patterns and constants that results depend on.

Everything here is data, kept in its natural (priority) order. Where a list is ordered, the first hit wins.
"""

HOLDINGS = ["NVDA", "MSFT", "GOOGL", "ASML"]
MACRO = ["RATES", "OIL", "GOLD", "USD", "MARKET"]
MODELS = ["lex", "finbert", "ens", "old"]
LABEL_SCORE = {"bullish": 1.0, "bearish": -1.0, "neutral": 0.0, "mixed": 0.0}
EXTRA_ALERT_SYMBOLS = ["AMZN", "META", "AAPL", "TSLA", "AVGO", "AMD", "MU", "TSM", "ORCL", "NFLX", "INTC"]
ALERT_SYMBOLS = HOLDINGS + MACRO + EXTRA_ALERT_SYMBOLS

# Symbol aliases: case-insensitive unless inside (?-i:...).
SYMBOL_PATTERNS = {
    "NVDA": r"nvidia|\bnvda\b",
    "MSFT": r"microsoft|\bmsft\b",
    "GOOGL": r"alphabet|google|\bgoogl?\b",
    "ASML": r"\basml\b",
    "AMZN": r"amazon|\bamzn\b",
    "META": r"meta platforms|(?-i:\bMeta\b)|facebook",
    "AAPL": r"(?-i:\bApple\b)|\baapl\b",
    "TSLA": r"tesla|\btsla\b",
    "AVGO": r"broadcom|\bavgo\b",
    "AMD": r"\bamd\b|advanced micro",
    "MU": r"micron",
    "TSM": r"tsmc|taiwan semiconductor",
    "INTC": r"(?-i:\bIntel\b)",
    "ORCL": r"oracle",
    "NFLX": r"netflix",
    "ARM": r"(?-i:\bArm Holdings\b)",
    "RATES": r"\bfed\b|federal reserve|fomc|powell|treasury yield|10-year yield|rate (hike|cut)|interest rate|barr\b",
    "OIL": r"\boil\b|crude|\bbrent\b|\bwti\b|opec|strait of hormuz",
    "GOLD": r"\bgold\b|bullion",
    "USD": r"dollar index|\bdxy\b|the dollar|us dollar",
    "MARKET": r"wall street|s&p 500|\bdow\b|nasdaq|stocks (rise|fall|slip|rally)|stock market",
}
AMBIGUOUS_NAMES = ["Target", "Ford", "Gap", "Match", "Ball", "Hess", "Amgen", "Dow", "Visa", "Southern", "General",
                   "United", "American", "First", "National", "Lowe"]
CORPORATE_SUFFIX = (r"[,\.]?\s+(Inc\.?|Corp\.?|Corporation|Company|Co\.?|Ltd\.?|plc|Holdings?|Group|Incorporated|"
                    r"Class [ABC]|& Co\.?|\(The\)|The)\s*$")

# Finance lexicon.
POSITIVE = """beat beats surge surges surged soar soars soared rally rallies rallied jump jumps jumped record
upgrade upgraded upgrades raises raised outperform outperforms strong stronger strength growth profit profits profitable
gain gains gained rebound rebounds boost boosts boosted optimism optimistic bullish approval approved approves wins win
won breakthrough expands expansion buyback tops topped exceeds exceeded accelerates accelerating robust resilient upside
momentum recovery recovers partnership awarded lifts lifted climbs climbed advances advanced rises rose highest""".split()
NEGATIVE = """miss misses missed plunge plunges plunged tumble tumbles tumbled slump slumps slumped drop drops dropped
fall falls fell slide slides slid downgrade downgraded downgrades cuts warning warns warned weak weaker weakness loss
losses lawsuit sues sued probe investigation fine fined ban bans banned recall layoffs bankruptcy default fraud decline
declines declined slowdown recession risk risks fears fear concern concerns selloff crash crisis tariff tariffs sanctions
shortage delay delays delayed halts halted resigns hawkish worst lowest sinks sank slips slipped stall stalls""".split()
NEGATORS = ["not", "no", "never", "without", "fails", "failed", "unable", "lack", "lacks"]

# Finance overlay on a general valence lexicon.
FINANCE_VALENCE = {
    "beat": 2.0, "missed": -2.0, "upgrade": 2.0, "downgrade": -2.0, "outperform": 1.5, "underperform": -1.5,
    "bullish": 2.0, "bearish": -2.0, "slashed": -2.0, "cut": -1.5, "raised": 1.5, "surge": 2.0, "plunge": -2.0,
    "rally": 1.5, "crash": -2.5, "default": -3.0, "bankruptcy": -3.0, "growth": 1.0, "decline": -1.0, "record": 1.0,
    "dividend": 1.0, "buyback": 1.5,
}
# A short general list with the common words of published valence lexicons; a caller may pass any other.
GENERAL_VALENCE = {
    "good": 1.9, "great": 3.1, "excellent": 2.7, "best": 3.2, "happy": 2.7, "strong": 2.3, "win": 2.8, "success": 2.7,
    "improve": 1.9, "benefit": 2.0, "safe": 1.9, "hope": 1.9, "gain": 2.4, "profit": 1.9, "confident": 2.2,
    "bad": -2.5, "worst": -3.1, "terrible": -2.1, "fear": -2.2, "risk": -1.1, "loss": -1.3, "fraud": -2.8,
    "crisis": -3.1, "weak": -1.9, "fail": -2.5, "worry": -1.9, "threat": -2.4, "lawsuit": -0.9, "war": -2.9,
}

# (event, weight, pattern, relevance points); first match wins, otherwise OTHER_EVENT.
EVENTS = [
    ("guidance", 1.6, r"guidance|outlook|forecast|expects? (revenue|sales|profit)"),
    ("earnings", 1.5, r"earnings|quarterly results|revenue (rose|fell|beat|miss)|\beps\b|profit (rose|fell)"),
    ("analyst", 1.3, r"upgrade|downgrade|price target|initiates coverage|reiterat"),
    ("m&a", 1.4, r"acquire|acquisition|takeover|merger|buyout|to buy .* for \$"),
    ("filing", 1.3, r"\bfiled 8-K|\bfiled 6-K|\bfiled 10-[KQ]"),
    ("legal_reg", 1.2, r"lawsuit|sues|antitrust|regulator|\bftc\b|\bsec\b charges|fine[ds]?\b|probe|ban\b|sanction"),
    ("macro", 1.2, r"\bfed\b|inflation|\bcpi\b|jobs report|payrolls|gdp|rate (hike|cut)|treasury yield|tariff"),
    ("supply", 1.1, r"shortage|supply chain|export controls?|chip ban|strait of hormuz"),
    ("product", 1.0, r"launch|unveil|announces? (new|its)|release[sd]?|partnership"),
]
OTHER_EVENT = ("other", 0.8)
EVENT_POINTS = {"guidance": 18, "earnings": 18, "m&a": 15, "filing": 12, "analyst": 10, "legal_reg": 8, "macro": 8,
                "supply": 8, "product": 4}

SOURCE_WEIGHTS = [
    ("reuters", 1.2), ("bloomberg", 1.2), ("financial times", 1.2), ("wsj", 1.2), ("wall street journal", 1.2),
    ("federal reserve", 1.3), ("fed ", 1.3), ("ecb", 1.3), ("bls", 1.3), ("sec edgar", 1.3), ("cnbc", 1.0),
    ("marketwatch", 1.0), ("guardian", 0.9), ("oilprice", 0.9), ("nasdaq", 0.9), ("yahoo", 0.8),
    ("investing.com", 0.8), ("business insider", 0.8), ("seeking alpha", 0.7),
]
DEFAULT_SOURCE_WEIGHT = 0.8

# Ticker extraction.
TICKER_STOPWORDS = [
    "THE", "AND", "FOR", "ARE", "NEW", "CEO", "CFO", "USA", "USD", "EUR", "GDP", "CPI", "FED", "ECB", "IPO", "ETF", "SEC", "AI", "US", "UK", "Q1", "Q2", "Q3", "Q4", "YOY", "NYSE",
    "NASDAQ", "GO", "HOURS", "LAST", "ONLY", "TO", "YOUR", "CNBC", "WSJ", "PM", "TV", "UN", "EU", "IV", "RED", "RBC",
]
COMPANY_ALIASES = {
    "nvidia": "NVDA", "microsoft": "MSFT", "google": "GOOGL", "alphabet": "GOOGL", "asml": "ASML", "apple": "AAPL",
    "amazon": "AMZN", "meta": "META", "tesla": "TSLA", "openai": "OPENAI", "taiwan semiconductor": "TSM",
    "tsmc": "TSM", "amd": "AMD", "intel": "INTC", "palantir": "PLTR",
}
LINK_STOPWORDS = [
    "US", "UK", "EU", "AI", "CEO", "CFO", "GDP", "CPI", "FED", "ECB", "IPO", "ETF", "SEC", "UN", "NYSE", "NASDAQ", "FOMC", "PM", "TV", "CNBC", "WSJ", "MPC", "QE", "QT", "AG", "DB", "CA",
    "SF", "FS", "IV", "RED", "MACRO", "RATES", "ENERGY", "TECH", "TRADE", "GEOPOLITICS", "REGULATORY", "CAPEX", "CHINA", "SEMICONDUCTORS", "AI INFRA", "POWER", "POWER/AI INFRA",
]

# Call themes to price symbols, most specific first.
THEME_SYMBOLS = [
    ("10y treasury", "^TNX"), ("10-year", "^TNX"), ("treasury yield", "^TNX"), ("us 10y", "^TNX"), ("yield", "^TNX"),
    ("vwce", "VWCE.DE"), ("broad market", "VWCE.DE"), ("global equit", "VWCE.DE"), ("world equit", "VWCE.DE"),
    ("s&p", "^GSPC"), ("sp500", "^GSPC"), ("equities", "^GSPC"),
    ("brent", "BZ=F"), ("wti", "CL=F"), ("crude", "CL=F"), ("oil", "CL=F"),
    ("nvda", "NVDA"), ("nvidia", "NVDA"), ("msft", "MSFT"), ("microsoft", "MSFT"),
    ("googl", "GOOGL"), ("google", "GOOGL"), ("alphabet", "GOOGL"), ("asml", "ASML"),
    ("gold", "GC=F"), ("dollar", "DX-Y.NYB"), ("usd", "DX-Y.NYB"),
]
MACRO_PRICE_SYMBOL = {"OIL": "CL=F", "GOLD": "GC=F", "USD": "DX-Y.NYB", "MARKET": "^GSPC", "RATES": "^TNX"}
BENCHMARK = "VT"

# Regulatory filing items.
FILING_ITEMS = {
    "1.01": "Material Agreement",
    "1.02": "Termination of Material Agreement",
    "1.03": "Bankruptcy",
    "2.01": "Completion of Acquisition/Disposition",
    "2.02": "Results of Operations (Earnings)",
    "2.03": "Creation of Direct Financial Obligation",
    "2.05": "Costs Associated with Exit/Disposal",
    "2.06": "Material Impairments",
    "3.01": "Delisting/Failure to Satisfy Listing Rule",
    "3.02": "Unregistered Sales of Securities",
    "4.01": "Change in Auditor",
    "5.01": "Change in Control",
    "5.02": "Officer/Director Departure or Appointment",
    "5.03": "Amendment to Articles/Bylaws",
    "5.07": "Shareholder Vote Results",
    "7.01": "Regulation FD Disclosure",
    "8.01": "Other Material Events",
    "9.01": "Financial Statements/Exhibits",
}
FEED_LABELS = {"yahoo_ticker": "Yahoo Finance", "nasdaq_ticker": "Nasdaq.com", "sa_ticker": "Seeking Alpha",
               "sec": "SEC EDGAR"}
BLOCKED_DOMAINS = ["investing.com"]

# Patterns.
SPAM = r"\b(last chance|% off|subscribe now|sign up now|limited time|exclusive offer|hurry|don't miss out)\b"
NUMERIC = r"([+-]?\$\d+(?:\.\d+)?[MBB]?|[+-]?\d+(?:\.\d+)?%)"
WORD = r"([a-z']+)"
UPPER_TICKER = r"\b([A-Z]{2,5})\b"
CASHTAG_LOOSE = r"\$([A-Z]{1,5})"
CASHTAG = r"\$([A-Z]{1,5})\b"
EXCHANGE_TAG = r"\((?:NASDAQ|NYSE|NYSEARCA|NYSEAMERICAN|AMEX)[:\s]+([A-Z][A-Z.\-]{0,5})\)"
FILING_TITLE = r"^([\w\-/]+) - (.+?) \((\d{10})\) \((?:Filer|Subject|Reporting)\)"
GREEK = "[Α-Ωα-ωά-ώ]"
HOLDING_TITLE = r"(nvidia|nvda|microsoft|msft|alphabet|google|asml)"
HOLDING_ALIASES = {"NVDA": r"nvidia|nvda", "MSFT": r"microsoft|msft", "GOOGL": r"alphabet|google|googl?",
                   "ASML": r"asml"}
TICKER_PAGE_ALIASES = {"NVDA": "nvidia|nvda", "MSFT": "microsoft|msft", "GOOGL": "alphabet|google|googl",
                       "ASML": "asml", "AMZN": "amazon|amzn", "META": "meta platforms|facebook",
                       "AAPL": "apple|aapl", "TSLA": "tesla|tsla"}

# Optional clips a caller may pass where storage or payload size matters; operators default to whole texts.
CLIP_FEED_TITLE, CLIP_FEED_SUMMARY, CLIP_SCORE_SUMMARY, CLIP_MODEL_SUMMARY = 500, 2000, 600, 400
