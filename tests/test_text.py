import unicodedata

import pytest
from pyspark.sql import functions as F

from tarnsearch.functions import text as tx

SAMPLES = [
    "Ala_ma 2 KOTY, żółć!",
    "ﬁn ½ x² Ａ",
    "e\u0301te\u0301 İstanbul",
    "Größe СТРАНА 東京 ｶﾀｶﾅ",
    "a\u00a0b\u2003c\u3000",
    "",
    "   ",
    "___ -- 12.5",
    "ΑΣ ͺ ΄",
    "각 각",
]


def expected(text):
    import re

    return [w.lower() for w in re.findall(r"\w+", unicodedata.normalize("NFKC", text))]


def column(frame, value):
    rows = [(i, t) for i, t in enumerate(SAMPLES)]
    got = frame(rows, "i int, t string").select("i", value.alias("v")).collect()
    return [r.v for r in sorted(got)]


def test_known_tokens():
    assert tx.tokenize("Ala_ma 2 KOTY, żółć!") == ["ala_ma", "2", "koty", "żółć"]
    assert tx.tokenize("ﬁn") == ["fin"]


def test_column_and_python_forms_agree(frame):
    assert column(frame, tx.tokens(F.col("t"))) == [expected(t) for t in SAMPLES]
    assert [tx.tokenize(t) for t in SAMPLES] == [expected(t) for t in SAMPLES]


def test_nfkc(frame):
    assert column(frame, tx.nfkc(F.col("t"))) == [unicodedata.normalize("NFKC", t) for t in SAMPLES]


def test_nfkc_check_misses_nothing(spark):
    """Every character NFKC changes, or that may join another, is sent to Python."""
    import re

    java = tx.MAY_CHANGE_UNDER_NFKC
    python = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", java))
    for code in range(0x80, 0x110000):
        char = chr(code)
        if 0xD800 <= code < 0xE000:
            continue
        if unicodedata.normalize("NFKC", char) != char or unicodedata.combining(char):
            assert python.search(char), hex(code)


def test_strip_is_python_strip(frame):
    got = column(frame, tx.strip(F.col("t")))
    assert got == [t.strip() for t in SAMPLES]


def test_null_text(frame):
    row = frame([(None,)], "t string").select(tx.tokens(F.col("t")).alias("a"), tx.strip(F.col("t")).alias("b")).first()
    assert row.a is None and row.b is None


@pytest.mark.parametrize(
    "html, plain",
    [
        ("<p>a &lt; b</p><script>var x='</p>';</script>c", "a < b\nc"),
        ("<style>p{}</style><!-- no -->x&amp;lt;y", "x&lt;y"),
        ("<ul><li>1</li>\n\n<li>2</li></ul>", "1\n2"),
        ("plain", "plain"),
    ],
)
def test_html(frame, html, plain):
    assert frame([(html,)], "h string").select(tx.html_to_text(F.col("h"))).first()[0] == plain


def test_markdown(frame):
    source = "# Title\n\n> quote **bold** and *it*\n\n- item [link](http://x)\n\n```py\ncode\n```\n`v` | a | b |"
    got = frame([(source,)], "m string").select(tx.markdown_to_text(F.col("m"))).first()[0]
    assert got == "Title\n\nquote bold and it\n\nitem link\n\n\ncode\n\nv | a | b |"
