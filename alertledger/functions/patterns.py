"""Fixed values of the alert parser.

FIXED VALUES — these patterns and labels define what a bank alert means and
must stay exactly as written for results to match: Java regex syntax, applied
to the whitespace-normalised text, first match wins, "no match" is NULL.
"""

# --- fixed values: the text that is parsed -----------------------------------
TEXT_COLUMNS = ("body", "snippet", "subject")
WHITE_SPACE = r"[\s]+"
OTHER_SPACE = r"  |[\t-\r]"  # white space that WHITE_SPACE would change: two spaces, or any that is no space

# --- fixed values: extraction patterns (group 1 is the value) ---------------
AMOUNT_ANCHORED = r"(?i)(?:debited|withdrawal for|spent|purchase of)\s+Rs\.?\s*([0-9,]+\.?[0-9]*)"
AMOUNT_POSTFIX = r"(?i)Rs\.?\s*([0-9,]+\.?[0-9]*)\s+(?:has been debited|debited|credited)"
AMOUNT_GENERIC = r"(?i)Rs\.?\s*([0-9,]+\.?[0-9]*)"
REF = r"(?i)(?:reference number is|ref(?:erence)?\s*(?:no|#)?[:\s]+)\s*([A-Z0-9]+)"
VPA = r"(?i)VPA\s+([^\s]+)"
COUNTERPARTY = r"(?i)VPA\s+[^\s]+\s+([A-Z][A-Z0-9\s&]+?)(?:\s+on\s+\d)"
CARD_ENDING = r"(?i)Card ending\s+(\d{4})"
CARD_STARS = r"\*\*\s*(\d{4})"
ACCOUNT = r"(?i)from account\s+(\d{3,})"
CITY = r"(?i)\bin\s+([A-Z]{3,})\s+at\b"
PLACE = r"(?i)\bat\s+([A-Z0-9][A-Z0-9\s&\.\-]+?)\s+on\s+\d"
BALANCE = r"(?i)available balance[^0-9]*Rs\.?\s*([0-9,]+\.?[0-9]*)"
LOCAL_DT = r"(?i)on\s+(\d{2}-\d{2}-\d{4}\s+\d{2}:\d{2}:\d{2})"
LOCAL_DT_FORMAT = "dd-MM-yyyy HH:mm:ss"

# --- fixed values: currency tests, in order ---------------------------------
CURRENCY_TESTS = [
    (r"(?i)Rs\.?|INR|₹", "INR"),
    (r"\$|USD", "USD"),
]
CURRENCY_DEFAULT = "UNKNOWN"

# --- fixed values: direction tests, in order (credit words first) -----------
DIRECTION_TESTS = [
    (r"(?i)\bcredited\b|\brefund\b|\breversal\b|\breceived\b", "CREDIT"),
    (r"(?i)\bdebited\b|withdrawal|\bspent\b|\bpurchase\b|debit card", "DEBIT"),
]
DIRECTION_DEFAULT = "UNKNOWN"
VALID_DIRECTIONS = ["DEBIT", "CREDIT"]

# --- fixed values: transaction type tests, in order -------------------------
TXN_TYPE_TESTS = [
    (r"(?i)ATM\s+withdrawal", "ATM_WITHDRAWAL"),
    (r"(?i)\bUPI\b", "UPI"),
    (r"(?i)Credit Card", "CREDIT_CARD"),
    (r"(?i)Debit Card", "DEBIT_CARD"),
    (r"(?i)\bNEFT\b", "NEFT"),
    (r"(?i)\bIMPS\b", "IMPS"),
    (r"(?i)\bRTGS\b", "RTGS"),
]
TXN_TYPE_DEFAULT = "OTHER"

# --- fixed values: bank by sender, in order ---------------------------------
BANK_TESTS = [
    ("(?i)hdfc", "HDFC"),
    ("(?i)icici", "ICICI"),
    ("(?i)axis", "AXIS"),
    ("(?i)sbi", "SBI"),
]
BANK_DEFAULT = "OTHER"

# --- fixed values: data-quality reasons, in array order ---------------------
REASON_ID = "mandatory_field_missing:id"
REASON_SENDER = "mandatory_field_missing:sender"
REASON_EVENT_TIME = "mandatory_field_missing:event_time"
REASON_BODY = "mandatory_field_missing:body_and_snippet"
REASON_AMOUNT = "invalid_amount"
REASON_DIRECTION = "invalid_direction"

# --- fixed values: ingest ---------------------------------------------------
SNIPPET_CHARS = 200
