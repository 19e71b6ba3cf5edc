"""Text normalisation as DuckDB expressions, with literals of its own: no value is taken from the engine."""

from __future__ import annotations

from .fixtures import quoted

_SPACE = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: What the queries put into the texts, and what must come of it; the tables hold no other character that is replaced.
_INJECTED = (("—", "--"), ("≠", "!="), ("€", "EUR"), ("“", '"'), ("…", "..."), ("『", '"'), ("°", "deg"), ("』", '"'), ("〈", "<"), ("•", "*"), ("⑳", "(20)"), ("Ⅷ", "VIII"), ("₉", "9"), ("ⓩ", "(z)"))


def _replace(expr: str, pattern: str, to: str) -> str:
    return f"regexp_replace({expr}, {quoted(pattern)}, {quoted(to)}, 'g')"


def strip(expr: str) -> str:
    return _replace(expr, rf"^[{_SPACE}]+|[{_SPACE}]+\z", "")


def punctuation(expr: str) -> str:
    expr = _replace(expr, r"[\x{200B}-\x{200D}\x{FEFF}]", "")
    expr = _replace(expr, rf"[{_SPACE}]+([，。、；：\"（）【】《》？！])", r"\1")
    expr = _replace(expr, rf"[{_SPACE}]+([,;:.!?])", r"\1")
    expr = _replace(expr, r"([,;:.!?])([^ \n\p{Nd}])", r"\1 \2")
    expr = _replace(expr, rf"([，。、；：])[{_SPACE}]+([，。、；：])", r"\1\2")
    return _replace(expr, " +", " ")


def fallback(expr: str) -> str:
    expr = _replace(expr, rf"[{_SPACE}]+([，。、；：\"（）【】《》？！])", r"\1")
    expr = _replace(expr, r"([,;:!?])([^ \n])", r"\1 \2")
    return _replace(expr, r"([，。、；：])\x{200B}+", r"\1")


def characters(expr: str) -> str:
    for character, to in _INJECTED:
        expr = f"replace({expr}, {quoted(character)}, {quoted(to)})"
    return expr


def normalized(expr: str) -> str:
    """Without the compatibility form, which DuckDB has no function for."""
    return strip(punctuation(characters(expr)))


def clean(expr: str) -> str:
    return strip(_replace(normalized(expr), r"[\x00-\x08\x0B-\x0C\x0E-\x1F]", ""))


def escaped(expr: str) -> str:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        expr = f"replace({expr}, {quoted(mark)}, {quoted(entity)})"
    return expr
