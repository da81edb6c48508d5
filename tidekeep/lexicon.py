"""Word lists, phrase lists and gazetteers the text functions are parameterised with."""

from __future__ import annotations

from dataclasses import dataclass, replace

# ---------------------------------------------------------------- fixed values
# The lists below must equal the published ones for results to agree, so they are
# given as plain text in their natural (deciding) order.
HINDI_WORDS = """mera mujhe apna apne hai hain nahi kya karna karo band zyada bahut gaya raha rahe
bhejne paise wapas kaise hoga doon lage pooch mahine chhod hamesha pareshan dhanyavaad baar aa ho
ke liye se ja""".split()
TAGALOG_WORDS = """ko kong ang ng sa po ako hindi paano gusto kailangan salamat bakit aalis kami
lilipat isara ipadala pera nabigo laging dumarating masyadong mataas singil oras lang nang may mga
na""".split()

LEAVING_PHRASES = [
    "leaving the uae", "relocating for good", "moving back home", "final month here",
    "already resigned", "we are relocating", "سأغادر الإمارات", "ننتقل نهائيا", "uae chhod",
    "hamesha ke liye ja", "aalis na ako ng uae", "lilipat na kami"]

COUNTRIES = [
    ("india", "India"), ("pakistan", "Pakistan"), ("philippines", "Philippines"),
    ("pilipinas", "Philippines"), ("egypt", "Egypt"), ("uk", "UK"),
    ("home country", "home country"), ("abroad", "abroad"), ("الخارج", "abroad"),
    ("الإمارات", "UAE"), ("uae", "UAE")]

PRODUCTS = [
    ("account", "account"), ("salary account", "salary account"), ("card", "card"),
    ("loan", "loan"), ("mortgage", "mortgage"), ("emi", "loan EMI"), ("app", "mobile app"),
    ("otp", "OTP"), ("statement", "statements"), ("remittance", "remittance"),
    ("transfer", "transfer"), ("fee", "fees"), ("charge", "charges"), ("حساب", "account"),
    ("بطاقتي", "card"), ("قرضي", "loan"), ("الرهن", "mortgage"), ("الرسوم", "fees"),
    ("التطبيق", "mobile app"), ("hulog", "loan EMI")]

DATE_PHRASES = ["next month", "next week", "this month", "tomorrow", "الشهر القادم",
                "agle mahine", "susunod na buwan"]

ISSUE_KEYWORDS = [
    ("Account_Closure", ["close my account", "close accounts", "band karna", "band hoga", "isara",
                         "إغلاق", "أغلق"]),
    ("Remittance_Transfer", ["transfer", "remittance", "bhejne", "ipadala", "pera", "تحويل",
                             "حوالتي"]),
    ("Loan_Mortgage", ["loan", "mortgage", "emi", "hulog", "قرضي", "الرهن"]),
    ("Fees_Charges", ["fee", "charge", "singil", "bayad", "الرسوم", "خصمتم"]),
    ("Card_Services", ["card", "declined", "block", "بطاقتي"]),
    ("App_Technical", ["app", "otp", "crash", "log in", "statements", "التطبيق", "رمز التحقق"])]

WAVERING_PHRASES = ["not sure", "uncertain", "frustrated", "big decisions", "pareshan",
                    "pata nahi", "dismayado", "sigurado", "محبط", "لست متأكدا"]

URGENCY_PHRASES = ["act now", "last chance", "limited time", "urgent", "hurry", "immediately",
                   "don't miss", "expires", "only today", "final offer"]

PRESSURE_PHRASES = ["stay with us", "special offer", "discount", "reconsider", "don't leave",
                    "do not leave"]
# ---------------------------------------------------------- end of fixed values


@dataclass(frozen=True)
class Lexicon:
    """Everything the text stage needs to know about the languages it reads."""

    # Scripts that settle the language alone: (character class, language, confidence).
    script: tuple[str, str, float] = ("[؀-ۿ]", "ar", 0.99)
    # Word-share languages; an earlier entry wins a tie.
    languages: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("hi", tuple(HINDI_WORDS)), ("tl", tuple(TAGALOG_WORDS)))
    share_floor: float = 0.12
    share_base: float = 0.6
    share_cap: float = 0.99
    fallback_language: str = "en"
    fallback_confidence: float = 0.9
    no_words_confidence: float = 0.5

    leaving: tuple[str, ...] = tuple(LEAVING_PHRASES)
    dates: tuple[str, ...] = tuple(DATE_PHRASES)
    countries: tuple[tuple[str, str], ...] = tuple(COUNTRIES)
    products: tuple[tuple[str, str], ...] = tuple(PRODUCTS)

    issues: tuple[tuple[str, tuple[str, ...]], ...] = tuple(
        (c, tuple(w)) for c, w in ISSUE_KEYWORDS)
    issue_confidence: float = 0.7
    fallback_issue: str = "General_Query"
    fallback_issue_confidence: float = 0.4

    wavering: tuple[str, ...] = tuple(WAVERING_PHRASES)
    signal_confidence: float = 0.75
    fallback_signal_confidence: float = 0.6

    urgency: tuple[str, ...] = tuple(URGENCY_PHRASES)
    pressure: tuple[str, ...] = tuple(PRESSURE_PHRASES)


DEFAULT = Lexicon()

# Function words of three more languages, for message sources written in them.
EUROPEAN = replace(DEFAULT, languages=(
    ("de", ("der", "die", "und", "den", "von", "zu", "das", "mit", "ist")),
    ("fr", ("le", "et", "les", "du", "une", "pour", "est", "qui")),
    ("es", ("el", "los", "del", "las", "por", "con", "su", "que")),
) + DEFAULT.languages)
