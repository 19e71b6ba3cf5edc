"""Character replacements, palettes, allow-lists and name maps.

All of these are data that results depend on, kept as plain text.
"""

from __future__ import annotations

# fmt: off
# Character -> replacement, by code point.
CHARACTERS = {
    "\u00a0": " ",
    "¢": "c",
    "£": "GBP",
    "¥": "CNY",
    "©": "(C)",
    "®": "(R)",
    "°": "deg",
    "²": "2",
    "³": "3",
    "¹": "1",
    "×": "*",
    "÷": "/",
    "ʹ": "'",
    "ʺ": '"',
    "ʼ": "'",
    "ˈ": "'",
    "\u2000": " ",
    "\u2001": " ",
    "\u2002": " ",
    "\u2003": " ",
    "\u2004": " ",
    "\u2005": " ",
    "\u2006": " ",
    "\u2007": " ",
    "\u2008": " ",
    "\u2009": " ",
    "\u200a": " ",
    "‐": "-",
    "‑": "-",
    "‒": "-",
    "–": "-",
    "—": "--",
    "―": "--",
    "‘": "'",
    "’": "'",
    "‚": "'",
    "‛": "'",
    "“": '"',
    "”": '"',
    "„": '"',
    "‟": '"',
    "•": "*",
    "‣": ">",
    "․": ".",
    "‥": "..",
    "…": "...",
    "\u202f": " ",
    "′": "'",
    "″": '"',
    "‵": "'",
    "‶": '"',
    "⁃": "-",
    "\u205f": " ",
    "⁰": "0",
    "⁴": "4",
    "⁵": "5",
    "⁶": "6",
    "⁷": "7",
    "⁸": "8",
    "⁹": "9",
    "₀": "0",
    "₁": "1",
    "₂": "2",
    "₃": "3",
    "₄": "4",
    "₅": "5",
    "₆": "6",
    "₇": "7",
    "₈": "8",
    "₉": "9",
    "€": "EUR",
    "℃": "degC",
    "℉": "degF",
    "™": "(TM)",
    "Ⅰ": "I",
    "Ⅱ": "II",
    "Ⅲ": "III",
    "Ⅳ": "IV",
    "Ⅴ": "V",
    "Ⅵ": "VI",
    "Ⅶ": "VII",
    "Ⅷ": "VIII",
    "Ⅸ": "IX",
    "Ⅹ": "X",
    "ⅰ": "i",
    "ⅱ": "ii",
    "ⅲ": "iii",
    "ⅳ": "iv",
    "ⅴ": "v",
    "ⅵ": "vi",
    "ⅶ": "vii",
    "ⅷ": "viii",
    "ⅸ": "ix",
    "ⅹ": "x",
    "−": "-",
    "∕": "/",
    "∗": "*",
    "∣": "|",
    "∶": ":",
    "∼": "~",
    "≈": "~",
    "≠": "!=",
    "≤": "<=",
    "≥": ">=",
    "⋯": "...",
    "①": "(1)",
    "②": "(2)",
    "③": "(3)",
    "④": "(4)",
    "⑤": "(5)",
    "⑥": "(6)",
    "⑦": "(7)",
    "⑧": "(8)",
    "⑨": "(9)",
    "⑩": "(10)",
    "⑪": "(11)",
    "⑫": "(12)",
    "⑬": "(13)",
    "⑭": "(14)",
    "⑮": "(15)",
    "⑯": "(16)",
    "⑰": "(17)",
    "⑱": "(18)",
    "⑲": "(19)",
    "⑳": "(20)",
    "⑴": "(1)",
    "⑵": "(2)",
    "⑶": "(3)",
    "⑷": "(4)",
    "⑸": "(5)",
    "⑹": "(6)",
    "⑺": "(7)",
    "⑻": "(8)",
    "⑼": "(9)",
    "⑽": "(10)",
    "Ⓐ": "(A)",
    "Ⓑ": "(B)",
    "Ⓒ": "(C)",
    "Ⓓ": "(D)",
    "Ⓔ": "(E)",
    "Ⓕ": "(F)",
    "Ⓖ": "(G)",
    "Ⓗ": "(H)",
    "Ⓘ": "(I)",
    "Ⓙ": "(J)",
    "Ⓚ": "(K)",
    "Ⓛ": "(L)",
    "Ⓜ": "(M)",
    "Ⓝ": "(N)",
    "Ⓞ": "(O)",
    "Ⓟ": "(P)",
    "Ⓠ": "(Q)",
    "Ⓡ": "(R)",
    "Ⓢ": "(S)",
    "Ⓣ": "(T)",
    "Ⓤ": "(U)",
    "Ⓥ": "(V)",
    "Ⓦ": "(W)",
    "Ⓧ": "(X)",
    "Ⓨ": "(Y)",
    "Ⓩ": "(Z)",
    "ⓐ": "(a)",
    "ⓑ": "(b)",
    "ⓒ": "(c)",
    "ⓓ": "(d)",
    "ⓔ": "(e)",
    "ⓕ": "(f)",
    "ⓖ": "(g)",
    "ⓗ": "(h)",
    "ⓘ": "(i)",
    "ⓙ": "(j)",
    "ⓚ": "(k)",
    "ⓛ": "(l)",
    "ⓜ": "(m)",
    "ⓝ": "(n)",
    "ⓞ": "(o)",
    "ⓟ": "(p)",
    "ⓠ": "(q)",
    "ⓡ": "(r)",
    "ⓢ": "(s)",
    "ⓣ": "(t)",
    "ⓤ": "(u)",
    "ⓥ": "(v)",
    "ⓦ": "(w)",
    "ⓧ": "(x)",
    "ⓨ": "(y)",
    "ⓩ": "(z)",
    "▶": ">",
    "▸": ">",
    "○": "o",
    "●": "*",
    "\u3000": " ",
    "〈": "<",
    "〉": ">",
    "《": "<<",
    "》": ">>",
    "「": '"',
    "」": '"',
    "『": '"',
    "』": '"',
    "【": "[",
    "】": "]",
    "〔": "[",
    "〕": "]",
    "〖": "[[",
    "〗": "]]",
    "〜": "~",
    "〰": "~",
    "～": "~",
    "\U00010236": ".",
}
# fmt: on

# Highlight index -> colour.
HIGHLIGHTS = {
    1: "#000000",
    2: "#0000FF",
    3: "#00FFFF",
    4: "#00FF00",
    5: "#FF00FF",
    6: "#FF0000",
    7: "#FFFF00",
    8: "#FFFFFF",
    9: "#000080",
    10: "#008080",
    11: "#008000",
    12: "#800080",
    13: "#800000",
    14: "#808000",
    15: "#808080",
    16: "#C0C0C0",
}

# Paragraph alignment -> CSS value.
ALIGNMENTS = {"left": "left", "center": "center", "right": "right", "justify": "justify", "distribute": "justify"}

# Style properties and classes that each format may keep.
_STYLES = ["font-size", "color", "font-weight", "font-style", "text-decoration", "text-align", "font-family"]
_CLASSES = ["center", "right", "left", "justify", "bold", "italic", "underline"]
STYLE_CONFIG = {
    "doc": {"allowed_styles": _STYLES, "allowed_classes": _CLASSES},
    "epub": {"allowed_styles": [*_STYLES, "line-height", "margin", "padding"], "allowed_classes": [*_CLASSES, "chapter", "title", "subtitle", "paragraph", "quote"]},
    "pdf": {"allowed_styles": _STYLES, "allowed_classes": _CLASSES},
}

# File extension -> format.
FORMATS = {
    ".docx": "docx",
    ".doc": "doc",
    ".pdf": "pdf",
    ".epub": "epub",
    ".txt": "plain",
    ".rtf": "rtf",
    ".md": "markdown",
    ".html": "html",
    ".htm": "html",
    ".odt": "odt",
}

# Image type -> extension.
IMAGE_EXTENSIONS = {"image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp", "image/bmp": ".bmp"}
