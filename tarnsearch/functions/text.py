"""String expressions: normalisation, tokens, white space, markup removal."""

from __future__ import annotations

import re
import unicodedata
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \w is ASCII; letters, numbers and the underscore are what "word
# character" means for Unicode text.
WORD = r"[\p{L}\p{N}_]+"
# All white space there is; the blocks above U+3000 hold none.
SPACES = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())

# Blocks searched for characters that NFKC never touches. None of them holds
# combining marks that could join a preceding character.
_PLAIN_BLOCKS = (
    (0x0080, 0x02FF),  # Latin and phonetic letters
    (0x0370, 0x0482),  # Greek, Cyrillic
    (0x2010, 0x2027),  # dashes, quotes, bullets
    (0x3041, 0x3096),  # Hiragana
    (0x4E00, 0x9FFF),  # CJK ideographs
    (0xAC00, 0xD7A3),  # Hangul syllables
)


def _plain_class() -> str:
    """Regex class of the characters of those blocks that NFKC leaves as they are."""
    parts = []
    for first, last in _PLAIN_BLOCKS:
        run_start = None
        for code in range(first, last + 2):
            char = chr(code)
            plain = (
                code <= last
                and unicodedata.combining(char) == 0
                and unicodedata.normalize("NFKC", char) == char
            )
            if plain and run_start is None:
                run_start = code
            elif not plain and run_start is not None:
                parts.append(f"\\x{{{run_start:X}}}-\\x{{{code - 1:X}}}")
                run_start = None
    return "".join(parts)


ASCII_RUN = r"[\x00-\x7F]+"
MAY_CHANGE_UNDER_NFKC = f"[^{_plain_class()}]"


def _nfkc_series(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """NFKC form. Only texts holding a character that might change visit Python."""
    to_python = F.pandas_udf(_nfkc_series, "string")
    # Most characters are ASCII, and a run of those is skipped cheaply.
    rest = F.regexp_replace(text, ASCII_RUN, "")
    return F.coalesce(to_python(F.when(rest.rlike(MAY_CHANGE_UNDER_NFKC), text)), text)


def words(text: Column) -> Column:
    """Words in the order of the text, case kept."""
    return F.regexp_extract_all(nfkc(text), F.lit(WORD), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-case words in the order of the text, repeats kept."""
    return F.transform(words(text), F.lower)


_PYTHON_WORD = re.compile(r"\w+")


def tokenize(text: str) -> list[str]:
    """The tokens of one text, for jobs that already run in Python."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        return [word.lower() for word in _PYTHON_WORD.findall(text)]
    # Lower-casing ASCII cannot change where words end.
    return _PYTHON_WORD.findall(text.lower())


def strip(text: Column) -> Column:
    """Remove white space of every kind from both ends (``trim`` knows only the blank)."""
    return F.trim(text, F.lit(SPACES))


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


_ENTITY = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
# A space that does not break becomes a plain one.
_HARD_SPACE = re.compile(r"&(?:nbsp|#0*160|#[xX]0*[aA]0);")


def _unescape_all(texts: pd.Series) -> pd.Series:
    def one(text: str) -> str:
        return _ENTITY.sub(lambda found: unescape(found[0]), _HARD_SPACE.sub(" ", text))

    return texts.map(one, na_action="ignore")


def unescape_entities(text: Column) -> Column:
    """Named (all of HTML 5) and numeric entities as characters, each once: ``&amp;lt;`` is ``&lt;``. Unknown ones
    and those without a semicolon stay. Texts without an ampersand never reach Python."""
    found = text.rlike(_ENTITY.pattern)
    return F.when(found, F.pandas_udf(_unescape_all, "string")(F.when(found, text))).otherwise(text)


# (pattern, replacement), applied in order; both Java and RE2 read them alike.
HTML_STEPS = (
    (r"(?is)<!--.*?-->", ""),
    (r"(?is)<script\b[^>]*>.*?</script\s*>", ""),
    (r"(?is)<style\b[^>]*>.*?</style\s*>", ""),
    (r"(?is)<[^>]+>", "\n"),
)
SPACE_STEPS = (
    (r"[ \t\r\f]+", " "),
    (r" ?\n[ \n]*", "\n"),
)
MARKDOWN_STEPS = (
    (r"(?m)^[ \t]*(?:```|~~~).*$", ""),
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"(?m)^[ \t]{0,3}#{1,6}[ \t]+", ""),
    (r"(?m)^[ \t]{0,3}>[ \t]?", ""),
    (r"(?m)^[ \t]*[-*+][ \t]+", ""),
    (r"(\*\*|__)([^*_\n]+)(\*\*|__)", "$2"),
    (r"(^|[\s(])[*_]([^*_\n]+)[*_]", "$1$2"),
    (r"`([^`\n]+)`", "$1"),
)


def _replace_all(text: Column, steps) -> Column:
    for pattern, replacement in steps:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def html_to_text(html: Column) -> Column:
    """Visible text: scripts, styles and comments dropped, every tag a line break."""
    return strip(_replace_all(unescape_entities(_replace_all(html, HTML_STEPS)), SPACE_STEPS))


def markdown_to_text(markdown: Column) -> Column:
    """Plain text of a Markdown document; tables stay as they are."""
    return strip(_replace_all(markdown, MARKDOWN_STEPS))
