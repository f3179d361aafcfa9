"""Which charset a text that is not UTF-8 was written in, and how sure that is.

A text decoded by the wrong table has control characters and symbols inside words, changes case in
mid-word, and mixes letters that no one language has. So a reading is as good as its pairs of neighbours are
plausible, and as its letters beyond ASCII fit one language.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Sequence

# Letters beyond a-z of some languages, small forms.
LETTERS = {
    "pl": "ąćęłńóśźż",
    "cs": "áčďéěíňóřšťúůýž",
    "sk": "áäčďéíĺľňóôŕšťúýž",
    "hu": "áéíóöőúüű",
    "ro": "ăâîşţșț",
    "hr": "čćđšž",
    "de": "äöüß",
    "fr": "àâæçèéêëîïôœùûüÿ",
    "es": "áéíñóúü",
    "pt": "ãáâàçéêíõóôúü",
    "it": "àèéìòù",
    "nordic": "åäöæøéð",
}
MIN_CONFIDENCE = 0.7
SAMPLE_BYTES = 1 << 16  # of each end and the middle of a long text that its charset is told by
_QUOTES = set("„”“’‘‚«»–—…§°·•€£©®™¡¿ ªº¹²³½¼¾×÷±´¨")


def _kind(char: str) -> str:
    """l and u: small and capital letters; space, digit or mark; x: what no text holds."""
    if char.isalpha():
        return "u" if char.isupper() else "l"
    if char in "\t\n\r\x0c" or char in _QUOTES or not unicodedata.category(char).startswith(("C", "S", "M")):
        return "."
    return "." if char.isascii() and char.isprintable() else "x"


def plausibility(text: str) -> float:
    """From 0 to 1: how much the neighbourhood of characters beyond ASCII looks like words."""
    kinds = "".join(map(_kind, text))
    bad = good = 0
    for i, char in enumerate(text):
        if char.isascii() and kinds[i] != "x":
            continue
        before, here, after = kinds[i - 1] if i else ".", kinds[i], kinds[i + 1] if i + 1 < len(kinds) else "."
        if here == "x":
            bad += 4
        elif here == "." and before in "lu" and after in "lu" and char not in "’´-":
            bad += 1
        elif here == "u" and before == "l":
            bad += 1
        else:
            good += 1
    if not good + bad:
        return 1.0
    letters = Counter(c for c in text.lower() if not c.isascii() and c.isalpha())
    total = sum(letters.values())
    fit = max((sum(letters[c] for c in set(own)) for own in LETTERS.values()), default=0) / total if total else 1.0
    return good / (good + bad) * fit


def _sample(data: bytes) -> bytes:
    if len(data) <= 3 * SAMPLE_BYTES:
        return data
    middle = len(data) // 2
    return data[:SAMPLE_BYTES] + data[middle : middle + SAMPLE_BYTES] + data[-SAMPLE_BYTES:]


def detect(data: bytes, charsets: Sequence[str]) -> tuple[str | None, float]:
    """The most plausible of some one-byte charsets (ties: the earlier) and its plausibility; none where none decodes.

    Bytes that hold a zero are no text.
    """
    best, sure = None, -1.0
    if b"\0" in data:
        return None, 0.0
    for charset in charsets:
        try:
            data.decode(charset)
            found = plausibility(_sample(data).decode(charset))
        except UnicodeDecodeError:
            continue
        if found > sure:
            best, sure = charset, found
    return best, max(sure, 0.0)
