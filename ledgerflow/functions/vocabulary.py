"""Word lists, scores and tables that results depend on.  Order is meaning wherever the first match wins."""

# fixed values: transaction direction, first credit then debit terms, by containment
CREDIT_TERMS = [
    "CREDIT", " CR ", "REFUND", "REVERSAL", "SALARY", "PAYMENT RECEIVED", "RCV PYMT", "PYMT RCV", "PAYMENT RECVD", "RECEIVED", "DEPOSIT", "INTEREST CREDIT",
    "CASHBACK", "REWARD",
]
DEBIT_TERMS = ["DEBIT", "DR", "PURCHASE", "WITHDRAWAL", "ATM", "FEE", "CHARGE", "TRANSFER TO", "PAYMENT TO"]

# fixed values: transaction types in order of precedence, by containment
TYPE_TERMS = {
    "salary": ["SALARY", "PAYROLL", "WAGES"],
    "refund": ["REFUND", "REVERSAL", "REVERSED", "REVERTED", "CHARGEBACK", "RETURNED PAYMENT", "PAYMENT RETURN"],
    "interest": ["INTEREST", "INT CREDIT", "INT CR", "INT PAID"],
    "fee": ["FEE", "SERVICE CHARGE", "BANK CHARGE", "PROCESSING CHARGE"],
    "cash_withdrawal": ["ATM WITHDRAWAL", "ATM CASH", "ATM WDL", "ATM WD", "CASH WITHDRAWAL", "CASH WITHDRAW", "CASH WDL", "CASH WD", "CASH DISPENSE"],
    "loan_payment": ["LOAN", "EMI", "INSTALLMENT", "INSTALMENT", "FINANCE PAYMENT", "MORTGAGE PAYMENT"],
    "tax": [
        "INCOME TAX", "PROPERTY TAX", "SALES TAX", "GST", "VAT", "TAX PAYMENT", "TAX PAID", "GOVERNMENT FEE", "GOVERNMENT PAYMENT", "MUNICIPAL TAX", "CUSTOMS DUTY",
        "DUTY PAYMENT",
    ],
    "bill_payment": [
        "BILL PAYMENT", "BILL PAY", "UTILITY PAYMENT", "ELECTRICITY", "ELECTRIC BILL", "WATER BILL", "GAS BILL", "GAS PAYMENT", "INTERNET BILL", "INTERNET PAYMENT",
        "BROADBAND", "TELECOM BILL", "TELECOM PAYMENT", "MOBILE BILL", "MOBILE PAYMENT", "PHONE BILL", "PHONE PAYMENT", "UTILITY",
    ],
    "investment": [
        "STOCK PURCHASE", "BUY STOCK", "SHARE PURCHASE", "BUY SHARES", "MUTUAL FUND", "SYSTEMATIC INVESTMENT", "SIP", "BOND PURCHASE", "BROKERAGE", "BROKER",
        "SECURITIES", "INVESTMENT", "DEMAT",
    ],
    "payment": ["CREDIT CARD PAYMENT", "CARD PAYMENT", "CARD BILL PAYMENT", "CREDIT CARD BILL", "CARD BILL", "CARD SETTLEMENT", "PAYMENT RECEIVED"],
    "transfer": [
        "TRANSFER", "OWN ACCOUNT", "OWN A/C", "BETWEEN ACCOUNTS", "BENEFICIARY", "PERSON TO PERSON", "TRF TO", "TRF FROM", "WIRE PAYMENT", "DIRECT DEBIT",
    ],
}
TRANSFER_TOKENS = ["TRF", "XFER", "TRANSFER"]
LATE_PAYMENT_TERMS = ["RCV PYMT", "PYMT RCV", "PAYMENT RECVD"]
RAILS = ["UPI", "IMPS", "NEFT", "RTGS", "ACH", "SEPA", "SWIFT"]

# fixed values: payment channels in order of precedence
CHANNELS = ["UPI", "IMPS", "NEFT", "RTGS", "SWIFT", "SEPA", "ACH", "WIRE", "ATM", "POS", "CONTACTLESS", "ONLINE"]

# fixed values: merchant names
KNOWN_BRANDS = {"ADNOC": "ADNOC", "E&": "E&", "KEETA": "Keeta"}
SYSTEM_PHRASES = ["TRANSFER PAYMENT", "PAYMENT RECEIVED", "PAYMENT THANK YOU", "THANK YOU", "MINIMUM PAYMENT", "TOTAL PAYMENT", "CASH ADVANCE", "BALANCE TRANSFER"]
TERMINAL_PREFIXES = [r"TAP\s*\*\s*", r"POS\s+", r"ECOM\s+", r"PURCHASE\s+", r"CARD\s+PURCHASE\s+"]
COMPANY_WORDS = ["LLC", "LTD", "LIMITED", "INC", "CORP", "CORPORATION", "COMPANY", "CO", "EST", "ESTABLISHMENT"]
PLACE_WORDS = ["ABU", "DHABI", "DUBAI", "SHARJAH", "AJMAN", "RAK", "RAS", "AIN", "FUJAIRAH", "UMM", "QUWAIN", "ARE", "UAE"]
AREA_WORDS = ["IND", "AREA", "STREET", "ROAD", "RD", "BRANCH", "SHOP", "STORE", "MALL"]
DESCRIPTOR_PHRASES = ["FOR CAR WASH", "CAR WASH", "DIGITAL APP"]
KEY_SUFFIXES = [" abu dhabi are", " abudhabi are", " dubai are", " sharjah are", " are"]
KEY_COMPANY_WORDS = ["llc", "l l c", "ltd", "limited", "inc", "opc", "spc"]

# fixed values: merchant families for bulk corrections
FAMILIES = {
    "mcdonalds": ["mcdonald", "mcdonalds", "mcdonalds-"],
    "adnoc": ["adnoc"],
    "kfc": ["kfc"],
    "star cinemas": ["star cinemas", "starcinemas"],
    "carrefour": ["carrefour", "carrefoure"],
    "lulu": ["lulu", "luluhypermarket"],
    "nesto": ["nesto"],
    "safeer": ["safeer"],
    "paris cafe": ["paris cafe", "pariscafe"],
    "grandiose": ["grandiose"],
    "new parco": ["new parco", "newparco"],
    "golden family baqala": ["golden family baqala"],
    "millennium hospital": ["millennium hospital"],
    "e&": ["e and", "e digital", "e and digital"],
}
FAMILY_NOISE = ["llc", "ltd", "limited", "inc", "opc", "spc", "l l c", "br", "ph", "auh", "are", "dubai", "sharjah", "abudhabi", "abu dhabi"]

# fixed values: categories
TAXONOMY = {
    "Food & Dining": ["Restaurant", "Cafe", "Fast Food", "Food Delivery", "Bakery", "Snacks", "Cafeteria"],
    "Groceries": ["Supermarket", "Grocery Store", "Online Grocery", "Convenience Store"],
    "Transportation": ["Fuel", "Taxi", "Ride Sharing", "Public Transport", "Parking", "Tolls", "Vehicle Maintenance"],
    "Housing": ["Rent", "Mortgage", "Home Maintenance", "Furniture"],
    "Bills & Utilities": ["Electricity", "Water", "Internet", "Mobile", "Telecom", "Subscription"],
    "Healthcare": ["Pharmacy", "Hospital", "Doctor", "Diagnostics", "Health Insurance"],
    "Shopping": ["Clothing", "Electronics", "Home", "Personal Care", "General Shopping", "Flowers & Gifts"],
    "Entertainment": ["Movies", "Streaming", "Gaming", "Music", "Events", "Other Entertainment"],
    "Travel": ["Flights", "Hotels", "Travel Booking", "Visa", "Travel Expenses"],
    "Education": ["Courses", "Books", "Tuition", "Training"],
    "Financial": ["Bank Fees", "Card Fees", "ATM Fees", "Interest", "Financial Services"],
    "Taxes & Government": ["Income Tax", "Sales Tax", "Government Fees", "Documentation"],
    "Income": ["Salary", "Freelance", "Business Income", "Interest Income", "Other Income"],
    "Transfers": ["Bank Transfer", "Card Payment", "Internal Transfer", "UPI Transfer"],
    "Investments": ["Stocks", "Mutual Funds", "Bonds", "Brokerage", "Crypto"],
    "Cash": ["ATM Withdrawal", "Cash Deposit"],
    "Other": ["General", "Uncategorized", "Unknown"],
}
UNCATEGORISED = ["", "unknown", "uncategorized", "other", "none", "null"]

# fixed values: (category, subcategory, score, aliases) of named merchants, then of descriptive words
MERCHANT_RULES = [
    ("Healthcare", "Pharmacy", 0.99, ["life pharmacy", "life pharm", "life phy"]),
    ("Food & Dining", "Fast Food", 0.99, ["mcdonald"]),
    ("Food & Dining", "Cafeteria", 0.98, ["aghadeer"]),
    ("Income", "Other Income", 0.96, ["cashback", "cash back", "select spend", "cbk"]),
    ("Transfers", "Card Payment", 0.99, ["payment received", "rcv pymt"]),
    ("Food & Dining", "Food Delivery", 0.99, ["swiggy"]),
    ("Food & Dining", "Food Delivery", 0.99, ["zomato"]),
    ("Food & Dining", "Fast Food", 0.99, ["kfc"]),
    ("Food & Dining", "Cafe", 0.99, ["starbucks"]),
    ("Entertainment", "Movies", 0.99, ["bookmyshow"]),
    ("Entertainment", "Movies", 0.98, ["star cinemas", "starcinemas"]),
    ("Entertainment", "Streaming", 0.99, ["netflix"]),
    ("Entertainment", "Streaming", 0.98, ["amazon prime"]),
    ("Transportation", "Fuel", 0.88, ["adnoc"]),
    ("Healthcare", "Pharmacy", 0.99, ["aster pharmacy"]),
    ("Healthcare", "Hospital", 0.96, ["medeor"]),
    ("Healthcare", "Hospital", 0.99, ["millennium hospital"]),
    ("Groceries", "Supermarket", 0.95, ["lulu"]),
    ("Groceries", "Supermarket", 0.98, ["carrefour"]),
    ("Groceries", "Supermarket", 0.97, ["nesto"]),
    ("Shopping", "Clothing", 0.94, ["max"]),
    ("Shopping", "General Shopping", 0.98, ["miniso"]),
    ("Investments", "Brokerage", 0.99, ["zerodha"]),
    ("Investments", "Brokerage", 0.99, ["groww"]),
    ("Investments", "Brokerage", 0.99, ["upstox"]),
    ("Bills & Utilities", "Mobile", 0.96, ["e digital app", "e dubai", "e digital"]),
    ("Transportation", "Parking", 0.95, ["q mobility"]),
    ("Transportation", "Parking", 0.96, ["hala car park"]),
]
WORD_RULES = [
    ("Food & Dining", "Restaurant", 0.97, [
        "restaurant", "restauran", "resto", "ristorante", "restaurante", "restauracja", "diner", "eatery", "bistro", "brasserie", "food court", "canteen",
        "cafeteria", "grill", "kitchen", "steakhouse", "seafood restaurant", "family restaurant",
    ]),
    ("Food & Dining", "Cafe", 0.95, ["cafe", "coffee shop", "coffeehouse", "coffee house", "espresso bar"]),
    ("Food & Dining", "Fast Food", 0.96, ["fast food", "burger", "pizza", "fried chicken", "shawarma", "sandwich", "taco", "kfc", "mcdonald", "subway"]),
    ("Food & Dining", "Food Delivery", 0.97, ["food delivery", "food order", "meal delivery", "food delivery app"]),
    ("Food & Dining", "Bakery", 0.96, ["bakery", "bakeshop", "patisserie", "confectionery"]),
    ("Food & Dining", "Snacks", 0.93, ["snack bar", "snacks", "juice bar", "dessert shop"]),
    ("Groceries", "Supermarket", 0.97, ["supermarket", "hypermarket", "super market"]),
    ("Groceries", "Grocery Store", 0.95, ["grocery store", "grocery", "groceries", "grocer"]),
    ("Groceries", "Convenience Store", 0.95, ["convenience store", "mini mart", "minimart", "convenience mart"]),
    ("Groceries", "Fresh Market", 0.94, ["fresh market", "farmers market", "farm market"]),
    ("Transportation", "Fuel", 0.97, ["fuel station", "petrol station", "gas station", "service station", "filling station", "gasoline station", "diesel station"]),
    ("Transportation", "Taxi", 0.96, ["taxi", "cab fare", "taxicab"]),
    ("Transportation", "Ride Sharing", 0.96, ["ride sharing", "rideshare", "ride share"]),
    ("Transportation", "Public Transport", 0.95, ["public transport", "bus fare", "train fare", "metro", "subway", "transit"]),
    ("Transportation", "Parking", 0.96, ["parking", "car park", "parking fee"]),
    ("Transportation", "Tolls", 0.97, ["toll gate", "road toll", "tollway"]),
    ("Healthcare", "Pharmacy", 0.97, ["pharmacy", "chemist", "drug store", "medical pharmacy"]),
    ("Healthcare", "Hospital", 0.98, ["hospital", "medical center", "medical centre"]),
    ("Healthcare", "Doctor", 0.95, ["doctor", "clinic", "medical clinic", "dental clinic", "dentist"]),
    ("Healthcare", "Diagnostics", 0.96, ["diagnostic center", "diagnostic centre", "diagnostics", "laboratory", "pathology"]),
    ("Bills & Utilities", "Electricity", 0.98, ["electricity bill", "electricity payment", "power bill"]),
    ("Bills & Utilities", "Water", 0.98, ["water bill", "water payment"]),
    ("Bills & Utilities", "Internet", 0.97, ["internet bill", "broadband", "wifi bill"]),
    ("Bills & Utilities", "Mobile", 0.97, ["mobile bill", "mobile recharge", "phone bill", "telecom bill"]),
    ("Shopping", "Clothing", 0.94, ["clothing", "apparel", "fashion store", "garments"]),
    ("Shopping", "Electronics", 0.94, ["electronics", "electronic store", "computer store", "mobile store"]),
    ("Shopping", "Home", 0.94, ["home store", "home decor", "household store"]),
    ("Travel", "Hotels", 0.97, ["hotel", "resort", "inn", "motel", "guest house"]),
    ("Travel", "Flights", 0.96, ["airline", "airways", "airport", "flight"]),
    ("Education", "Courses", 0.95, ["training institute", "training center", "training centre", "coaching center", "coaching centre"]),
    ("Financial", "Bank Fees", 0.96, ["bank fee", "bank charge", "account fee", "service charge"]),
    ("Financial", "ATM Fees", 0.97, ["atm fee", "cash withdrawal fee"]),
]

# fixed values: words that hint at a category in questions and evidence
KEYWORDS = {
    "Food & Dining": ["restaurant", "cafe", "cafeteria", "bakery", "biryani", "pizza", "burger", "food", "dining", "grill", "kitchen", "coffee", "meal"],
    "Groceries": ["supermarket", "grocery", "groceries", "hypermarket", "market", "carrefour", "lulu", "waitrose", "spinneys"],
    "Transportation": ["adnoc", "shell", "fuel", "petrol", "gas station", "taxi", "uber", "careem", "transport", "parking", "toll", "metro", "bus"],
    "Healthcare": ["hospital", "clinic", "pharmacy", "medical", "doctor", "dental", "health", "medicine", "diagnostic", "laboratory", "lab", "healthcare"],
    "Travel": ["airline", "airport", "flight", "hotel", "booking", "travel", "visa", "airways"],
    "Education": ["school", "college", "university", "course", "tuition", "training", "education"],
    "Entertainment": ["cinema", "movie", "netflix", "spotify", "gaming", "game", "event", "music"],
    "Shopping": ["amazon", "mall", "store", "fashion", "clothing", "electronics", "retail", "shop"],
    "Bills & Utilities": ["electricity", "water bill", "internet", "telecom", "mobile", "utility", "subscription"],
    "Housing": ["rent", "mortgage", "property", "housing"],
    "Financial": ["bank fee", "service fee", "card fee", "atm fee", "interest charge", "commission"],
    "Taxes": ["tax", "vat", "government fee", "income tax"],
}
STOPWORDS = (
    "a an and are as at be by for from how i in is it me my of on or show tell that the this to was what where which who with you did do much many spent spend "
    "transaction transactions money please can could give about all any there were have had has does mine statement account financial finance want would "
    "like should need total amount cost"
).split()
CATEGORY_WORDS = {
    "Food & Dining": ["food", "dining", "restaurant", "restaurants", "cafe", "cafes"],
    "Groceries": ["grocery", "groceries", "supermarket"],
    "Shopping": ["shopping", "retail", "store"],
    "Transportation": ["transport", "transportation", "fuel", "petrol", "gas", "taxi"],
    "Travel": ["travel", "flight", "flights", "hotel"],
    "Healthcare": ["health", "healthcare", "medical", "hospital", "doctor", "pharmacy"],
    "Education": ["education", "school", "college", "course"],
    "Bills & Utilities": ["subscription", "subscriptions", "utilities", "electricity", "internet", "mobile"],
    "Housing": ["rent", "housing", "mortgage"],
    "Entertainment": ["entertainment", "movies", "gaming"],
    "Income": ["salary", "income"],
    "Investment": ["investment", "investments"],
    "Financial": ["fee", "fees"],
    "Taxes": ["tax", "taxes"],
}
INTENTS = [
    ("summary", r"\b(summary|summarize|overview|overall|statement summary)\b"),
    ("largest_transaction", r"\b(largest|biggest|highest).*(transaction|purchase|payment|expense|spend)|\b(largest|biggest) transaction"),
    ("smallest_transaction", r"\b(smallest|lowest).*(transaction|purchase|payment|expense|spend)"),
    ("review", r"\b(review|flag|attention|concern|unusual|duplicate|duplicates|suspicious|anomal)"),
    ("net", r"\b(net|cash flow|remaining|left over|leftover)"),
    ("income", r"\b(how much|total).*(income|received|credit|salary|deposit)"),
    ("expenses", r"\b(how much|total).*(spent|expense|expenses|outgoing|debit)"),
    ("top_merchant", r"\b(where|who|merchant).*(spent|spend|most|highest)|\b(top|highest).*(merchant|spend)"),
    ("category_spend", r"\b(category|categories|area|areas|healthcare|health|dining|food|grocer)"),
    ("identity", r"\b(whose|who.*statement|account holder|name on|owner)"),
    ("merchant_spend", r"\b(merchant|store|shop|company|vendor|at)\b"),
]

# fixed values: weights of phrases that tell card statements from bank statements
CARD_SIGNALS = {
    "credit card statement": 10, "credit card": 5, "card account": 3, "card limit": 5, "credit limit": 4, "available credit": 5, "available limit": 5,
    "minimum payment due": 5, "minimum amount due": 4, "total payment due": 5, "total amount due": 2, "payment due date": 4, "cashback card": 3,
    "cash back card": 3, "cardholder": 2, "statement balance": 2, "retail purchases": 2, "finance charges": 2, "profit charges": 2, "previous balance": 1,
    "current balance": 1,
}
BANK_SIGNALS = {
    "bank account statement": 10, "savings account": 5, "current account": 5, "type of account": 4, "account type": 3, "account status": 3, "withdrawals": 2,
    "deposits": 2, "opening balance": 2, "closing balance": 2, "effective available balance": 4, "available account balance": 4, "value date": 2, "tran id": 2,
    "transaction id": 2, "account activity": 2, "debit account": 2, "credit account": 2,
}
CURRENCY_WORDS = {
    "AED": [r"\bAED\b", r"\bDHS?\.?", r"\bDIRHAMS?\b"],
    "INR": [r"\bINR\b", r"\bRUPEES?\b", "₹"],
    "USD": [r"\bUSD\b", r"\bUS DOLLARS?\b", r"\$"],
    "EUR": [r"\bEUR\b", r"\bEUROS?\b", "€"],
    "GBP": [r"\bGBP\b", r"\bPOUNDS?\b", "£"],
    "SAR": [r"\bSAR\b", r"\bSAUDI RIYALS?\b"],
    "QAR": [r"\bQAR\b", r"\bQATARI RIYALS?\b"],
    "KWD": [r"\bKWD\b", r"\bKUWAITI DINARS?\b"],
    "BHD": [r"\bBHD\b", r"\bBAHRAINI DINARS?\b"],
    "OMR": [r"\bOMR\b", r"\bOMANI RIALS?\b"],
}
UNKNOWN_CURRENCIES = ["UNKNOWN", "N/A", "NA", "NULL", "NONE"]
METADATA_TERMS = [
    "opening balance", "closing balance", "balance forward", "brought forward", "carried forward", "card limit", "available limit", "credit limit",
    "minimum payment", "current balance", "statement balance", "total balance", "account balance", "available balance", "reward points", "reward plus",
    "scheme opening", "points accrued", "points redeemed", "adjustment bonus", "warning statements", "bank deposits are covered", "insurance scheme",
    "nomination details", "report irregularities", "contacting our branch", "abbreviations used", "disclaimer", "end of statement",
    "computer generated statement", "licensed by", "corporate office", "page of", "address last updated", "regd. mobile number", "customer id", "email id",
    "account open date", "type of account", "account status", "effective available balance", "date of issue", "ifsc", "micr code", "swift code", "nomination",
]
# Issue codes with severity and message, in the order of the checks.
ISSUES = {
    "MISSING_TRANSACTION_DATE": ("error", "Transaction date is missing."),
    "POSTING_DATE_BEFORE_TRANSACTION_DATE": ("warning", "Posting date occurs before transaction date."),
    "MISSING_AMOUNT": ("error", "Transaction amount is missing."),
    "NEGATIVE_NORMALIZED_AMOUNT": ("warning", "Canonical transaction amount is negative."),
    "ZERO_AMOUNT": ("warning", "Transaction amount is zero."),
    "MISSING_CURRENCY": ("warning", "Transaction currency is missing."),
    "UNKNOWN_CURRENCY": ("warning", "Transaction currency could not be identified."),
    "MISSING_DESCRIPTION": ("error", "Transaction description is missing."),
    "SHORT_DESCRIPTION": ("warning", "Transaction description is unusually short."),
    "MISSING_DIRECTION": ("error", "Transaction debit/credit direction is missing."),
    "AMOUNT_MISMATCH": ("warning", "Original amount and statement amount differ without an exchange rate."),
    "BALANCE_MISMATCH": ("warning", "Running balance does not match the transaction amount and direction."),
    "POSSIBLE_DUPLICATE": ("warning", "A transaction with the same date, amount, direction and description already exists."),
}
# Month names.
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
