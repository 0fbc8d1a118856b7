"""They define results, so they are stated as they are."""

# fixed values: trading days a year, default universe start and liquidity floors,
# cash yield, and the round-trip costs of the three kinds of strategy
DAYS_PER_YEAR = 248
DEFAULT_START = "2019-08-01"
CASH_ANNUAL = 0.12
FLOOR_INDEX = 5e6
FLOOR_FUTURES = 20e6
FLOOR_HISTORY = 3e6
COST_SWITCH = 0.003
COST_ROTATION = 0.004
COST_PICKS = 0.005
FALLBACK_RATE = 11.0

# fixed values: columns of a raw feed line
FEED_COLUMNS = ["date", "symbol", "sector", "name", "open", "high", "low", "close", "volume", "ldcp"]

# fixed values: monthly macro columns, in file order
MACRO_FILE_COLUMNS = [
    "date", "policy_rate", "cpi_yoy", "fx_reserves_sbp_bn", "remittances_bn",
    "current_account_mn", "pkr_usd", "brent_usd",
]
MACRO_COLUMNS = [
    "policy_rate", "cpi_yoy", "fx_reserves_sbp_bn", "remittances_bn", "current_account_mn",
    "trade_balance_mn", "pkr_usd", "brent_usd", "kse100", "us_10y", "m2_growth_yoy",
]

# fixed values: contract months and index bases that are no single stock
CONTRACT_MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
INDEX_BASES = ["KSE30", "KMI30", "BKTI", "KSE100", "ALLSHR", "KMIALLSHR"]

# fixed values: sector codes and names
SECTORS = [
    ("0801", "Automobile Assembler"),
    ("0802", "Automobile Parts & Accessories"),
    ("0803", "Cable & Electrical Goods"),
    ("0804", "Cement"),
    ("0805", "Chemical"),
    ("0806", "Close-End Mutual Fund"),
    ("0807", "Commercial Banks"),
    ("0808", "Engineering"),
    ("0809", "Fertilizer"),
    ("0810", "Food & Personal Care Products"),
    ("0811", "Glass & Ceramics"),
    ("0812", "Insurance"),
    ("0813", "Inv. Banks / Inv. Cos. / Securities"),
    ("0814", "Jute"),
    ("0815", "Leasing Companies"),
    ("0816", "Leather & Tanneries"),
    ("0818", "Miscellaneous"),
    ("0819", "Modarabas"),
    ("0820", "Oil & Gas Exploration"),
    ("0821", "Oil & Gas Marketing"),
    ("0822", "Paper, Board & Packaging"),
    ("0823", "Pharmaceuticals"),
    ("0824", "Power Generation & Distribution"),
    ("0825", "Refinery"),
    ("0826", "Sugar & Allied"),
    ("0827", "Synthetic & Rayon"),
    ("0828", "Technology & Communication"),
    ("0829", "Textile Composite"),
    ("0830", "Textile Spinning"),
    ("0831", "Textile Weaving"),
    ("0832", "Tobacco"),
    ("0833", "Transport"),
    ("0834", "Vanaspati & Allied"),
    ("0835", "Woollen"),
    ("0836", "Real Estate Investment Trust"),
    ("0837", "Exchange Traded Funds"),
    ("0838", "Real Estate & Development"),
    ("0839", "Textile (Apparel/Knitwear)"),
]
FUND_SECTORS = ["0806", "0815", "0819", "0837"]
SEGMENTS = ["36", "3610", "40", "0040", "41", ""]

# fixed values: spelling variants of sector names
SECTOR_ALIASES = [
    ("Oil & Gas Exploration Companies", "Oil & Gas Exploration"),
    ("Oil & Gas Marketing Companies", "Oil & Gas Marketing"),
    ("Commercial Bank", "Commercial Banks"),
    ("Banks", "Commercial Banks"),
    ("Power Generation", "Power Generation & Distribution"),
    ("Power", "Power Generation & Distribution"),
    ("Power Generation and Distribution", "Power Generation & Distribution"),
    ("Technology and Communication", "Technology & Communication"),
    ("Technology", "Technology & Communication"),
    ("Autos", "Automobile Assembler"),
    ("Automobile", "Automobile Assembler"),
    ("Automobiles", "Automobile Assembler"),
    ("Auto Assembler", "Automobile Assembler"),
    ("Automobile Parts", "Automobile Parts & Accessories"),
    ("Textile", "Textile Composite"),
    ("Textiles", "Textile Composite"),
    ("Fertiliser", "Fertilizer"),
    ("Fertilizers", "Fertilizer"),
    ("Pharma", "Pharmaceuticals"),
    ("Sugar", "Sugar & Allied"),
    ("Sugar & Allied Industries", "Sugar & Allied"),
    ("Refineries", "Refinery"),
    ("Steel", "Engineering"),
    ("Engineering (Steel)", "Engineering"),
    ("Cement Sector", "Cement"),
    ("Paper & Board", "Paper, Board & Packaging"),
    ("Vanaspati", "Vanaspati & Allied"),
    ("Real Estate", "Real Estate & Development"),
    ("REIT", "Real Estate Investment Trust"),
    ("Auto Parts", "Automobile Parts & Accessories"),
    ("Cable & Electrical", "Cable & Electrical Goods"),
    ("Engineering(steel)", "Engineering"),
    ("Food & Personal Care", "Food & Personal Care Products"),
    ("Inv.Banks/Securities", "Inv. Banks / Inv. Cos. / Securities"),
    ("Paper/Board/Packaging", "Paper, Board & Packaging"),
]

# fixed values: keyword prefixes that link a headline to a sector
SECTOR_KEYWORDS = {
    "Cement": ["cement", "clinker", "construction", "housing", "psdp", "coal"],
    "Commercial Banks": ["bank", "deposit", "advance", "nim", "monetary policy", "policy rate", "spread", "sbp rate"],
    "Fertilizer": ["fertiliz", "urea", "dap", "gas feedstock", "gidc", "sona", "ffc"],
    "Oil & Gas Exploration": ["exploration", "e&p", "gas discovery", "oil field", "ogdc", "ppl", "circular debt"],
    "Oil & Gas Marketing": ["ogra", "fuel price", "petrol price", "opl", "pso", "lng", "furnace oil"],
    "Refinery": ["refiner", "deemed duty", "brownfield", "crude", "hsd"],
    "Power Generation & Distribution": [
        "ipp", "power", "electricity", "tariff", "circular debt", "capacity payment", "nepra",
    ],
    "Automobile Assembler": [
        "auto", "car sales", "ckd", "vehicle", "ev policy", "indus motor", "honda", "suzuki", "tractor",
    ],
    "Textile Composite": ["textile", "cotton", "yarn", "exports", "gsp", "apparel"],
    "Technology & Communication": [
        "it exports", "software", "tech", "telecom", "systems limited", "fintech", "data centre",
    ],
    "Pharmaceuticals": ["pharma", "drug price", "drap", "api import"],
    "Sugar & Allied": ["sugar", "cane", "crushing", "support price"],
    "Chemical": ["pvc", "petrochemical", "pta", "chemical"],
    "Engineering": ["steel", "rebar", "long steel", "scrap", "engineering"],
}

# fixed values: weight of a news item by source tier, for a missing and an unknown tier
TIER_WEIGHTS = {1: 1.0, 2: 0.8, 3: 0.55, 4: 0.4, 5: 0.15}
MISSING_TIER = 3
UNKNOWN_TIER_WEIGHT = 0.5

# fixed values: mood bands and their edges
MOOD_EDGES = [0, 20, 40, 60, 80, 100]
MOOD_BANDS = ["Extreme Fear", "Fear", "Neutral", "Greed", "Extreme Greed"]

# fixed values: moving averages of the trend ensemble
ENSEMBLE_ROWS = (20, 50, 100, 200)

# fixed values: event windows in trading days around the anchor day
EVENT_WINDOWS = [("pre", -5, -1), ("event", 0, 1), ("post", 1, 5), ("drift", 1, 20)]
SHOCK_TYPES = ["external_shock", "political", "commodity"]

# fixed values: factor of the sector graph -> monthly macro change
PRIOR_FACTORS = [
    ("policy_rate", "d_policy_rate"),
    ("pkr_depreciation", "pkr_depr"),
    ("oil", "oil_ret"),
    ("remittances", "remit_chg"),
]

# fixed values: months of results season and of the budget
RESULTS_MONTHS = [2, 3, 4, 8, 9, 10]
BUDGET_MONTHS = [5, 6, 7]

# fixed values: features of the month-end panel, the surge panel and the sector panel
PANEL_FEATURES = [
    "mom_1m", "mom_3m", "mom_6m", "mom_12m", "rev_1w", "vol_1m", "vol_3m", "dist_252h", "dist_20h",
    "dist_6mlow", "log_adv", "adv_growth", "turnover", "rel_str_3m", "rel_sec_3m", "maxup_1m",
    "upday_frac", "log_price", "month", "mom_accel", "vol_ratio", "amihud", "beta_60", "dd_6m",
    "sector_code", "rate_level", "rate_chg_3m", "cpi_yoy", "pkr_chg_3m", "oil_chg_3m", "mood_level",
]
SURGE_FEATURES = [
    "ret_20", "ret_60", "ret_120", "vol_20", "dist_252h", "dist_20h", "adv_growth", "log_adv",
    "log_price", "mkt_ret_20", "rel_ret_60",
]
SECTOR_FEATURES = [
    "mom_1", "mom_3", "mom_6", "mom_12", "rev_1", "vol_3", "rel_str_3", "rate_level", "rate_chg_3",
    "cpi_yoy", "pkr_chg_3", "oil_chg_3", "sector_code",
]
TILT_FACTORS = {"mom_6m": 1, "dist_252h": 1, "vol_3m": -1, "beta_60": -1, "maxup_1m": -1}
