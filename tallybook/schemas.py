"""Canonical tables, enumerations and the fixed reference lists."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _B, _I, _F, _TS = (
    T.StringType(), T.LongType(), T.DateType(), T.BooleanType(), T.IntegerType(),
    T.DoubleType(), T.TimestampType(),
)


def _table(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


ACCOUNTS = _table(id=_L, user_id=_S, name=_S, card_number_masked=_S, institution=_S)
CATEGORIES = _table(id=_L, user_id=_S, name=_S, color=_S, keywords=_S)
LEDGER = _table(
    id=_L, user_id=_S, transaction_date=_D, posted_date=_D, reference_number=_S,
    merchant_name=_S, merchant_city=_S, merchant_state=_S, merchant_country=_S,
    mcc_description=_S, amount=_F, amount_cents=_L, currency=_S, transaction_type=_S,
    account_id=_L, category_id=_L, notes=_S, import_batch_id=_S, is_excluded=_B,
    recurring_rule_id=_L, created_at=_TS,
)
BUDGET_RULES = _table(id=_L, user_id=_S, category_id=_L, limit_cents=_L, is_total=_B)
HIDDEN_KEYS = _table(user_id=_S, category_key=_S)
RECURRING_RULES = _table(
    id=_L, user_id=_S, merchant_name=_S, amount=_F, amount_cents=_L, transaction_type=_S,
    currency=_S, category_id=_L, account_id=_L, notes=_S, frequency=_S, start_date=_D,
    end_date=_D, last_created_date=_D,
)
IMPORT_BATCHES = _table(
    id=_S, user_id=_S, filename=_S, month=_I, year=_I, total_rows=_L, imported_rows=_L,
    skipped_rows=_L,
)
# what an import could not take, and the stored keys under which ledger rows are found again
REJECTS = _table(token=_S, user_id=_S, source_file=_S, row_idx=_L, message=_S)
LEDGER_KEYS = _table(id=_L, user_id=_S, kind=_S, account=_L, day=_D, text=_S, amount_key=_L)
APP_SETTINGS = _table(user_id=_S, default_currency=_S)
STATEMENT_LINES = _table(file=_S, line_no=_I, text=_S)
STATEMENT_CELLS = _table(
    file=_S, page=_I, table_no=_I, row_no=_I, cells=T.ArrayType(_S),
)
STATEMENT_WORDS = _table(file=_S, page=_I, text=_S, x0=_F, top=_F)
OFX_FILES = _table(file=_S, content=_S)
UPLOAD_ROWS = _table(
    row_idx=_L, user_id=_S, source_file=_S, transaction_date=_D, posted_date=_D,
    reference_number=_S, merchant_name=_S, merchant_city=_S, merchant_state=_S,
    merchant_country=_S, mcc_description=_S, amount=_F, currency=_S, transaction_type=_S,
    suggested_category=_S, category_name=_S, card_number_masked=_S, cardholder=_S,
    exclude=_B, notes=_S, import_month=_I, import_year=_I,
)

TRANSACTION_TYPES = ("expense", "income", "refund", "transfer")
FREQUENCIES = ("monthly", "weekly", "biweekly", "yearly")

# Merchant-category descriptions and the category each one stands for.
MCC_CATEGORY = {
    "eating places and restaurants": "dining",
    "quick payment service-fast food restaurants": "fast food",
    "miscellaneous food stores-convenience stores and specialty markets": "convenience store",
    "grocery stores and supermarkets": "groceries",
    "wholesale club with or without membership fee": "wholesale / costco",
    "taxicabs and limousines": "transportation",
    "cable satellite and other pay television and radio services": "cable / internet",
    "telecommunication services including local and long distance calls credit card calls"
    " call through use of magnetic-strip-reading telephones and fax services": "phone",
    "utilities-electric gas water and sanitary": "utilities",
    "business services": "business services",
    "computer network/information services and other online services such as electronic"
    " bulletin board e-mail web site hosting services or internet access": "online shopping",
    "computer software stores": "software",
    "digital goods – games": "gaming",
    "digital goods – media books movies music": "media / streaming",
    "large digital goods merchant": "digital goods",
    "continuity/subscription merchants": "subscriptions",
    "colleges universities professional schools and junior colleges": "education",
    "continuity/subscription": "subscriptions",
}

# Phrases that mark a transfer, and phrases that mark cash back.
PAYMENT_PHRASES = (
    "payment thank you", "payment - thank you", "remboursement",
    "e-transfer", "e transfer", "etransfer",
    "interac e-transfer", "interac transfer",
    "wire transfer", "wire xfer",
    "internal transfer", "account transfer",
    "ach transfer", "eft transfer",
    "internet transfer", "online transfer",
    "hh005tfr", "tfr-to", "tfr-from",
)
CASHBACK_PHRASES = ("cash back", "cash back / remises", "rebate")

# Phrases that mark an interest posting.
INTEREST_PHRASES = (
    "cash interest", "interest payment", "interest earned", "interest charge", "interest paid",
)

# Slice colours in display order, and the colour of the merged small slices.
SLICE_COLORS = (
    "#6366f1", "#f59e0b", "#10b981", "#ef4444", "#3b82f6",
    "#8b5cf6", "#ec4899", "#14b8a6", "#f97316", "#84cc16",
    "#06b6d4", "#a855f7", "#e11d48", "#0ea5e9", "#22c55e",
)
OTHER_COLOR = "#64748b"

# Column titles of bank CSV exports, per logical field, in order of preference.
CSV_TITLES = {
    "date": [
        "Date", "Transaction Date", "Trans. Date", "Trans Date", "TransDate",
        "Activity Date", "Effective Date", "Value Date", "Trade Date",
        "Post Date", "Posted Date", "Posting Date", "Settlement Date",
        "Cleared Date", "Process Date", "Processed Date",
    ],
    "posted_date": [
        "Posted Date", "Post Date", "Posting Date", "Settlement Date",
        "Cleared Date", "Process Date", "Processed Date",
    ],
    "amount": [
        "Amount", "Transaction Amount", "CAD Amount", "CAD$ Amount", "CAD $Amount",
        "Debit/Credit Amount", "Net Amount", "Charge Amount", "Payment Amount",
    ],
    "merchant_name": [
        "Merchant Name", "Description", "Description 1", "Description 2",
        "Transaction Description", "Payee", "Payee Name", "Name", "Details",
        "Memo", "Narrative", "Particulars", "Reference", "Beneficiary", "Store Name",
    ],
    "mcc_description": [
        "Merchant Category Description", "Category", "MCC Description",
        "Merchant Category", "Transaction Category", "Transaction Type", "Type",
    ],
    "card_number": [
        "Card Number", "Card No.", "Card No", "Card #",
        "Account Number", "Account No.", "Account No", "Acct No", "Card Last 4",
    ],
    "cardholder": [
        "Name on Card", "Cardholder Name", "Card Holder", "Cardholder",
        "Account Holder", "Account Name", "Customer Name",
    ],
    "reference_number": [
        "Reference Number", "Reference #", "Reference No", "Ref No", "Ref #",
        "Transaction ID", "Transaction #", "Confirmation #", "Confirmation Number",
        "Auth Code", "Authorization Code", "Cheque Number", "Check Number",
    ],
    "merchant_city": ["Merchant City", "City", "Location"],
    "merchant_state": [
        "Merchant State or Province", "Merchant Province", "Province",
        "State", "State/Province", "Region",
    ],
    "merchant_country": ["Merchant Country Code", "Merchant Country", "Country", "Country Code"],
}
DEBIT_TITLES = ["Debit", "Withdrawals", "Withdrawal", "Debit Amount"]
CREDIT_TITLES = ["Credit", "Deposits", "Deposit", "Credit Amount"]

# Column titles of tables inside statements.
TABLE_TITLES = {
    "date": ["date", "transaction date", "trans. date", "trans date", "activity date",
             "value date", "post date", "posted date"],
    "merchant": ["description", "merchant", "merchant name", "payee", "details",
                 "memo", "narrative", "particulars", "transaction description"],
    "amount": ["amount", "transaction amount", "cad amount", "net amount"],
    "debit": ["debit", "withdrawals", "withdrawal", "debit amount"],
    "credit": ["credit", "deposits", "deposit", "credit amount"],
}

# What each OFX transaction type hints at.
OFX_TYPE_HINT = {
    "DEBIT": "expense", "CHECK": "expense", "ATM": "expense", "POS": "expense",
    "PAYMENT": "transfer", "XFER": "transfer",
    "CREDIT": "income", "DEP": "income", "DIRECTDEP": "income", "INT": "income", "DIV": "income",
    "FEE": "expense", "SRVCHG": "expense", "OTHER": "expense",
}

# Statement layouts in detection order, with the x-range of every column.
LAYOUT_FIELDS = ("date", "desc", "amount", "debit", "credit", "balance")
LAYOUTS = (
    ("TD Visa", ("TD Visa", "TD® Visa", "TD Credit Card", "TD CASH BACK", "TD Cash Back"),
     {"date": (30, 92), "desc": (136, 316), "amount": (316, 360)}),
    ("TD Chequing", ("TD Canada Trust", "TD Bank", "TORONTO-DOMINION", "td.com"),
     {"date": (408, 470), "desc": (60, 225), "debit": (225, 335), "credit": (335, 410),
      "balance": (470, 565)}),
    ("CIBC Visa", ("CIBC Visa", "CIBC Credit Card", "CIBC Dividend"),
     {"date": (30, 72), "desc": (115, 495), "amount": (495, 560)}),
    ("CIBC Chequing",
     ("CIBC", "Canadian Imperial Bank", "Personal Banking", "Chequing Account"),
     {"date": (28, 88), "desc": (88, 380), "debit": (380, 455), "credit": (455, 530),
      "balance": (530, 610)}),
    ("EQ Bank", ("EQ Bank", "Equitable Bank", "EQ Personal", "eqbank"),
     {"date": (35, 105), "desc": (105, 350), "debit": (350, 440), "credit": (440, 515),
      "balance": (515, 570)}),
    ("RBC Visa", ("RBC Visa", "RBC Rewards", "RBC Avion", "Visa Platinum", "RBC Credit Card"),
     {"date": (55, 105), "desc": (105, 295), "amount": (295, 390)}),
    ("RBC Chequing",
     ("Royal Bank of Canada", "RBC Royal Bank", "Royal Bank", "RBC Direct",
      "Day-to-Day Banking", "RBC Chequing", "RBCPDA", "Signature Plus"),
     {"date": (28, 72), "desc": (72, 310), "debit": (310, 405), "credit": (405, 520),
      "balance": (520, 600)}),
    ("BMO", ("Bank of Montreal", "BMO Bank", "BMO Financial"),
     {"date": (28, 90), "desc": (90, 390), "debit": (390, 460), "credit": (460, 535),
      "balance": (535, 615)}),
    ("Scotiabank", ("Scotiabank", "Bank of Nova Scotia", "Scotia"),
     {"date": (28, 90), "desc": (90, 380), "debit": (380, 455), "credit": (455, 530),
      "balance": (530, 610)}),
)

# Statement readers in order of preference, with the cap on their confidence.
READER_ORDER = (
    "pdfplumber_coords", "camelot_lattice", "pdfplumber_table", "camelot_stream", "tabula",
    "pdfplumber_text", "ocr", "tesseract", "ofx_parser", "csv_wrapper",
)
READER_CONFIDENCE_CAP = {
    "pdfplumber_text": 0.75, "camelot_stream": 0.82, "tabula": 0.82, "ocr": 0.65,
    "tesseract": 0.65,
}

# Starter categories (name, colour, keywords).
STARTER_CATEGORIES = (
    ("dining", "#E07B54", "restaurant, bistro, diner, eatery, steakhouse, sushi, pizza, burger"),
    ("fast food", "#F4A623", "mcdonald, wendy, burger king, subway, tim hortons, a&w, kfc, "
     "popeyes, chick-fil-a, taco bell"),
    ("convenience store", "#A8D8A8", "7-eleven, circle k, couche-tard, mac's, corner store, "
     "depanneur"),
    ("groceries", "#5BA55B", "grocery, supermarket, loblaws, sobeys, metro, iga, food basics, "
     "freshco, whole foods, trader joe, kroger, safeway, publix"),
    ("wholesale / costco", "#2E86AB", "costco, sam's club, bj's wholesale"),
    ("transportation", "#7B68EE", "uber, lyft, taxi, transit, bus, train, subway pass, "
     "go transit, via rail, parking, toll"),
    ("cable / internet", "#4A90D9", "rogers, bell, telus, shaw, videotron, cogeco, comcast, "
     "xfinity, spectrum, cox, cable, internet"),
    ("phone", "#6BAED6", "rogers wireless, bell wireless, telus mobility, fido, koodo, "
     "freedom mobile, virgin mobile, at&t, verizon, t-mobile"),
    ("utilities", "#74C476", "hydro, enbridge, gas, water, electric, utility, ontario hydro, "
     "bc hydro, epcor, atco"),
    ("business services", "#9E9AC8", ""),
    ("online shopping", "#FD8D3C", "amazon, ebay, etsy, wish, aliexpress, shopify, wayfair, "
     "overstock"),
    ("software", "#6B6ECF", "microsoft, adobe, autodesk, jetbrains, github"),
    ("gaming", "#D65F5F", "steam, playstation, xbox, nintendo, epic games, riot games, "
     "blizzard, ea games, ubisoft"),
    ("media / streaming", "#E377C2", "netflix, spotify, apple music, youtube premium, disney+, "
     "hulu, crave, paramount, hbo"),
    ("digital goods", "#8C6D31", ""),
    ("subscriptions", "#BD9E39", ""),
    ("education", "#17BECF", "tuition, university, college, coursera, udemy, duolingo, chegg"),
    ("shopping", "#FF9DA7", "walmart, target, costco, dollar store, dollarama, ikea, "
     "home depot, lowe's, best buy, the bay, winners, marshalls, old navy, gap, h&m, zara"),
    ("health", "#59A14F", "pharmacy, drugstore, shoppers drug mart, rexall, cvs, walgreens, "
     "doctor, clinic, dentist, optometrist, hospital, medical"),
    ("insurance", "#76B7B2", "insurance, aviva, intact, desjardins, td insurance, belair"),
    ("travel", "#4E79A7", "airbnb, hotel, expedia, booking.com, air canada, westjet, delta, "
     "american airlines, united airlines, southwest, marriott, hilton"),
    ("income", "#59A14F", "payroll, direct deposit, salary, wages"),
    ("transfer", "#BAB0AC", "e-transfer, etransfer, interac, wire transfer, transfer"),
    ("fees & interest", "#B07AA1", "service fee, monthly fee, annual fee, interest charge, "
     "nfs fee, overdraft"),
    ("uncategorized", "#AAAAAA", ""),
)
