"""They must be these for right results."""

from __future__ import annotations

# Symbols that stand for a letter inside a word.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "*": ""}

# Cyrillic and Greek letters that look Latin, and what they look like.
LOOKALIKE_FROM = "авекмнорстухіѕјαεορτυνκι"
LOOKALIKE_TO = "abekmhopctyxisjaeoptuvki"

# Patterns of links, of the characters of names and tags, of characters that nobody sees, of white space.
LINKS = r"(?U)(?:https?://|www\.)\S+"
WORD_CHARS = r"[\p{L}\p{N}_]"
INVISIBLES = r"[\u00AD\u200B-\u200F\u202A-\u202E\u2060-\u206F\uFEFF]"
SPACES = r"(?U)[\s\x1c-\x1f]+"

# Languages in Cyrillic letters that a detector's guess may name.
CYRILLIC_LANGUAGES = ("ru", "uk", "be", "bg", "mk", "sr", "kk", "ky", "mn", "tt")

# Script blocks in order of precedence; the first that holds a letter counts it.
SCRIPTS = (
    ("am", 0x1200, 0x137F), ("hy", 0x0530, 0x058F), ("he", 0x0590, 0x05FF), ("ar", 0x0600, 0x06FF), ("ar", 0x0750, 0x077F),
    ("th", 0x0E00, 0x0E7F), ("lo", 0x0E80, 0x0EFF), ("bo", 0x0F00, 0x0FFF), ("my", 0x1000, 0x109F), ("ka", 0x10A0, 0x10FF),
    ("km", 0x1780, 0x17FF), ("hi", 0x0900, 0x097F), ("bn", 0x0980, 0x09FF), ("pa", 0x0A00, 0x0A7F), ("gu", 0x0A80, 0x0AFF),
    ("or", 0x0B00, 0x0B7F), ("ta", 0x0B80, 0x0BFF), ("te", 0x0C00, 0x0C7F), ("kn", 0x0C80, 0x0CFF), ("ml", 0x0D00, 0x0D7F),
    ("si", 0x0D80, 0x0DFF), ("el", 0x0370, 0x03FF), ("ru", 0x0400, 0x04FF), ("ko", 0xAC00, 0xD7AF), ("ja", 0x3040, 0x30FF),
    ("zh", 0x4E00, 0x9FFF),
)

# Latin blocks; their letters decide nothing by themselves.
LATIN = ((0x0000, 0x024F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F))

# Letters that tell Cyrillic languages, in order of precedence.
CYRILLIC_MARKS = (("be", "ў"), ("mk", "ѓќѕ"), ("sr", "ђћ"), ("uk", "їєґі"))

# Letters that tell Latin-script languages, in order of precedence.
LATIN_MARKS = (
    ("tr", "ğışĞİŞ"),
    ("pl", "łżźęąćńŁŻŹĘĄĆŃ"),
    ("ro", "țșȚȘ"),
    ("cs", "řůěŘŮĚ"),
    ("hu", "őűŐŰ"),
    ("vi", "ơưạảấầẩẫậắằẳẵặẹẻẽếềểễệọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ"),
)

# Function words of the languages that vote, in order of precedence.
FUNCTION_WORDS = {
    "en": "the and you that for with this your have not are what just like was they about from would",
    "es": "que los las por con para una como esto pero más eres muy todo está porque del eso",
    "fr": "les des une que pour pas vous avec dans est sur mais tout plus comme être cette sont",
    "de": "und der die das ist nicht ich mit für auf ein eine sie sich auch dass aber noch",
    "it": "che non per una sono come questo anche più sei della solo tutto perché quando essere",
    "pt": "que não uma com para você por mais está como isso mas seu são quando porque muito",
    "nl": "het een van niet dat zijn voor met maar ook aan wat heeft worden deze",
    "pl": "nie jest się tego jak czy tylko przez które jego ale być tym gdy",
    "tr": "bir için değil daha çok gibi ile ama kadar sen ben olan bu",
    "id": "yang dan tidak untuk dengan dari ini itu sudah kamu adalah juga saya",
    "vi": "không của được những người một này cho với thì còn như",
    "ro": "este care pentru mai sunt nu din sau dar când foarte",
    "sv": "och att det som inte för med har den till man",
    "fi": "että olen sinä mutta kuin niin hän ovat vain voi",
    "cs": "jsem není aby jako ale když tak také jsou této",
    "hu": "hogy nem egy meg van csak mint már vagy ezt",
}
