import re


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


#: Null, empty, white space, short, repeated and awkward texts.
EDGE = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one"),
    (5, "a b c d e f g"),
    (6, "a b c d e f g"),
    (6, "a b c d e f g"),
    (7, "Ä ö 😀 mail x@y.zz, 1.2.3.4 and +1 (222) 333-4444\n" * 3),
    (8, "word " * 3000),
    (9, "x" * 5000),
    (10, "0 " * 2000 + "password = 'abc123456'"),
]
