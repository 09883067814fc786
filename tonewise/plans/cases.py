"""Authored texts for what the tables don't hold: links, tags, hidden characters, other scripts, telling letters.

All are stable under the compatibility fold, so that SQL without one can tell the same results.
"""

TEXTS = [
    None, "", "   \t\n", "12345", "😀😀😀😀", "a", "ab", "好", "see https://x.org/a?b=1 now www.y.com ok", "HTTP://CAPS.org/x gone, http:/kept",
    "hi @some_one and @Ünï_9, mail me@home", "#Topic and #another_tag, # alone", "so­ft zero​wid‍th ‮mark‬ ﻿end",
    "sooooo \n\n\n\n wow!!!! aabbb", "s t u p i d you", "a b c", "a b", "y o u   a r e", "x a b c", "idіоt идиот", "mіхеd сase", "γειά σου ανa",
    "sh1t 1diot f*ck a**b covid19 b4d l33t", "h@te $he e!x a|b", "Привет как дела", "Слава Україні", "ў так", "ѓ да", "ђ да", "你好世界",
    "日本語のテスト", "漢字漢字か", "안녕하세요", "שלום", "مرحبا", "ݐ", "नमस्ते", "নমস্কার", "ਸਤ", "નમસ્તે", "ନମସ୍କାର", "வணக்கம்", "నమస్తే", "ನಮಸ್ಕಾರ", "നമസ്കാരം",
    "ආයුබෝවන්", "สวัสดี", "ສະບາຍດີ", "བཀྲ", "မင်္ဂလာ", "ሰላም", "գործ", "გამარჯობა", "សួស្តី", "bugün çok güzel değil ğ", "zażółć gęślą", "față țară",
    "příliš žluťoučký kůň", "őrült", "được", "the cat and the dog are not like that", "und der die das ist nicht", "les des une pour pas vous",
    "que los las por con para", "che non per una sono", "que não uma com para você", "het een van niet dat", "bir için daha çok", "yang dan tidak untuk",
    "och att det som inte", "että olen sinä mutta", "lorem ipsum dolor", "ab яв", "яв ab", "ꙁꙁ abc", "abc 你", "你好 abc de", "que que",
]

#: Texts and labels: the same text after normalising with both labels, with one, and alone.
CONFLICTS = [
    ("Contradictory  www.x.org", 0), ("contradictory", 1), ("CONTRADICTORY", 1), ("always the same", 0), ("Always the  same", 0), ("alone", 1),
    ("both\tways", 1), ("both ways", 0),
]
