"""Patterns and word lists that define results.

Regular expressions are Java's. ``W0`` and ``W1`` stand for ASCII word boundaries and ``WS``
for white space in the wide sense, which Java's short forms are not.
"""

W0, W1 = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
WS = r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"

# headings
ANNEX = rf"(?i)^{WS}*(annex|appendix){WS}+([A-Z]{{1,2}}|[0-9]+){W1}{WS}*[.:)]?{WS}*(.*)$"
TABLE = rf"(?i)^{WS}*(table){WS}+(\d+[A-Z]?){W1}{WS}*[.:)]?{WS}*(.*)$"
CLAUSE = rf"^{WS}*(\d+(?:\.\d+)*){WS}*[.)]?{WS}+(?={WS.replace('[', '[^', 1)})"
BLOCK_END = r"[.!?:;][\"')\]]?$"
BARE_HEADING_CHARS = 40
HEADING_TITLE_CHARS = 120

# Table rows
CURRENCY = r"[₹$€£¥]"
CURRENCY_WORD = rf"(?i){W0}(?:rs\.?|inr|usd|eur|gbp){W1}"
NUMERIC = r"\d+(?:[.,]\d+)*"
NON_LETTER = r"[\d\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff.,:;()\[\]{}/\\%+\-\u2013\u2014₹$€£¥*#&@!?=]"

# pages
SPARSE_PAGE_CHARS = 80
STANDARD_CODE = rf"{W0}IS{WS}*\d{{2,5}}{WS}*(?:\([^)]*\))?{WS}*(?::|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])){WS}*\d{{4}}{W1}"
COLLECTION_CODE = rf"(?i){W0}SP{WS}*-?{WS}*(\d{{1,3}}){W1}"
PAGE_NUMBER = rf"(?i)^(page{WS}+)?\d+({WS}+of{WS}+\d+)?$"
TITLE_NOISE = (
    "disclosure", "whereas", "©", "copyright", "bureau of indian standards", "manak bhavan", "new delhi", "price",
    "first published", "first revision", "published by", "printed by", "foreword", "contents", "preface", "introduction",
    "committee", "composition", "composition of", "representing members", "udc", "isbn", "all rights", "reproduction",
    "edition", "year of", "print",
)
TITLE_SMALL_WORDS = ("for", "of", "and", "the", "in", "on", "to", "a", "an", "or", "by", "at", "from", "with")

# Identifiers and topics
IDENTIFIER = rf"(?i){W0}IS{WS}*:?{WS}*(\d{{2,6}}){WS}*(?::{WS}*(\d{{4}}))?"
TITLE_DESIGNATION = rf"(?i)IS{WS}+[0-9]{{2,6}}{WS}*:{WS}*[0-9]{{4}}{WS}+"
TRAILING_PUNCTUATION = rf"{WS}*[-–—:;,]{WS}*$"
REVISION_NOTE = rf"(?i){WS}*\({WS}*(?:first|second|third|fourth|fifth)?{WS}*revision{WS}*\)"
DANGLING_WORD = rf"(?i){WS}+(for|of|and|or|the|to|in|with|on|at|by|from)$"
CLAUSE_YEAR = r"^(19|20)\d{2}$"
CLAUSE_NUMBER = r"^[1-9]\d{0,2}(?:\.\d{1,3}){0,2}$"
CLAUSE_CHARS, LABEL_CHARS, TITLE_LEAST_CHARS = 24, 34, 12

# language
SCRIPTS = {"hi": (0x0900, 0x097F), "pa": (0x0A00, 0x0A7F), "te": (0x0C00, 0x0C7F)}
LANGUAGE_NAMES = {"en": "English", "hi": "Hindi (Devanagari)", "pa": "Punjabi (Gurmukhi)", "te": "Telugu"}
ANCHORS = (
    rf"(?i){W0}IS{WS}*:?{WS}*\d{{1,6}}",
    rf"(?i){W0}SP{WS}*:?{WS}*\d{{1,6}}",
    rf"(?i){W0}\d+(?:\.\d+)?{WS}*(?:MPa|N/mm2|mg/l|mg/kg|%|g/l|µm|mm|cm|kg)(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))",
)
ROMANISED = (
    "hai", "hain", "hoon", "kya", "kyun", "kaise", "kaun", "kitna", "kitni", "kitne", "batao", "bataiye", "mujhe",
    "humko", "aapko", "aap", "mera", "meri", "apna", "apni", "mukhya", "vaare", "vah", "yah", "kahan", "kithe", "liye",
    "waala", "hota", "hoti", "karna", "kare", "dena", "raha", "rahi", "rahe",
)
LATIN_RUN = rf"[A-Za-z][A-Za-z0-9.\-]*(?:{WS}+[A-Za-z][A-Za-z0-9.\-]*)*"
TRANSLATION_PROMPT = "Translate the following segment into English, without additional explanation.\n\n"
TRANSLATION_LABEL = rf"(?i)^(?:english{WS}+)?(?:translat(?:ion|ed|e)|output|answer|result|english){WS}*[:\-–—]{WS}*"
CHITCHAT_CHARS = 24
CHITCHAT = (
    "hi", "hii", "hiii", "hey", "heya", "hello", "helo", "hellowe", "helloo", "yo", "sup", "ok", "okay", "k", "cool", "nice",
    "great", "awesome", "thanks", "thank you", "thx", "ty", "cheers", "bye", "goodbye", "see you", "good night",
    "good morning", "good afternoon", "good evening", "help", "test", "testing", "asdf", "asdfgh", "asdfghjkl",
    "who are you", "what are you", "what can you do", "what do you do", "how are you", "are you there", "anyone there",
    "any body there", "tell me about yourself", "introduce yourself",
)
REQUEST_VERBS = (
    "what", "which", "who", "whom", "whose", "when", "where", "why", "how", "is", "are", "was", "were", "do", "does", "did",
    "can", "could", "should", "would", "will", "shall", "tell", "explain", "describe", "define", "list", "give", "show",
    "find", "search", "summar", "summari", "write", "provide", "need", "want",
)

# answers
SENTENCE_SPLIT = rf"(?<=[.!?]){WS}+|\n+"
DEGENERATE_LEAST_CHARS, SENTENCE_LEAST_CHARS = 120, 20
SUBSTANCE_STOPWORDS = (
    "this", "that", "these", "those", "there", "here", "what", "which", "when", "where", "does", "will", "shall", "must",
    "should", "could", "would", "from", "with", "have", "been", "were", "they", "them", "then", "than", "into", "about",
    "your", "their", "answer", "question", "sorry", "cannot", "unable", "specified", "given", "following", "above",
    "below", "otherwise", "however", "therefore", "because",
)
