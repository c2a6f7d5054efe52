"""Visible form of text: width, blanks, hyphens, composition, invisible characters, look-alike letters.

Pure Python on strings; the operators call it in Arrow batches. Pure ASCII text takes a short cut.
"""

from __future__ import annotations

import re
import unicodedata

INVISIBLE = re.compile("[\u0000-\u0008\u000e-\u001b\u007f-\u0084\u0086-\u009f\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufff8\U000e0000-\U000e0fff]")
BLANKS = re.compile(r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
# Hyphens of several kinds that look alike; dashes are longer and stay.
HYPHENS = dict.fromkeys(map(ord, "\u2010\u2011\ufe63\uff0d\u2212"), "-")

# Letters of other scripts that look like a Latin letter.
CYRILLIC = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H",
    "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W",
    "Ԍ": "G", "Ү": "Y", "ү": "y", "к": "k", "ї": "ï", "ё": "ë", "Ё": "Ë", "Ї": "Ï",
}
GREEK = {
    "ο": "o", "ν": "v", "ρ": "p", "α": "a", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "γ": "y", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "ό": "ó", "ί": "í", "ά": "á", "Ϊ": "Ï", "ϊ": "ï",
}
ARMENIAN = {"օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "յ": "j", "ք": "p", "Օ": "O", "Ս": "U", "Տ": "S", "Լ": "L", "Ց": "8"}
CHEROKEE = {
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "i", "Ꭵ": "i", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮢ": "R", "Ꮤ": "W",
    "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ꮷ": "d", "Ꮟ": "b", "Ꮒ": "h", "Ᏻ": "G", "Ᏼ": "B",
}
IPA = {"ɑ": "a", "ɡ": "g", "ɩ": "i", "ɪ": "i", "ʋ": "u", "ʏ": "y", "ɯ": "w", "ɾ": "r", "ʌ": "v"}
LOOKALIKE = CYRILLIC | GREEK | ARMENIAN | CHEROKEE | IPA
TO_LATIN = str.maketrans(LOOKALIKE)
FROM_LATIN = {"CYRILLIC": {v: k for k, v in reversed(CYRILLIC.items())}, "GREEK": {v: k for k, v in reversed(GREEK.items())}}
TOKEN = re.compile(r"[^\W\d_]+(?:[\u0300-\u036f][^\W\d_]*)*")
#: Blocks that hold look-alikes: IPA, Greek, Cyrillic, Armenian, Cherokee. Also a pattern in Java.
BLOCKS = "[\u0250-\u02af\u0370-\u03ff\u0400-\u052f\u0531-\u0588\u13a0-\u13f5]"
FOREIGN = re.compile(BLOCKS)


_WIDE = re.compile("[\uff01-\uffee\ufb00-\ufb06]+")


def _width(t: str) -> str:
    """Full- and half-width forms and the Latin ligatures in their plain letters; other compatibility forms look different and stay."""
    return _WIDE.sub(lambda m: unicodedata.normalize("NFKC", m[0]), t)


def visible(t: str) -> str:
    """Everything but look-alike letters: one form of width, blanks, hyphens, composition, without invisible characters."""
    if t.isascii():
        return BLANKS.sub(" ", INVISIBLE.sub("", t)).strip() if not t.isprintable() or "  " in t or t[:1] == " " or t[-1:] == " " else t
    t = INVISIBLE.sub("", t)
    t = unicodedata.normalize("NFC", _width(t)).translate(HYPHENS)
    return BLANKS.sub(" ", t).strip()


_MOJIBAKE = re.compile("[\u00c2-\u00f4][\u0080-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013\u2014\u2018-\u201e\u2020-\u2022\u2026\u2030\u2039\u203a\u20ac\u2122]+")


def _bytes(run: str) -> bytes | None:
    out = bytearray()
    for c in run:
        try:
            out += c.encode("cp1252")
        except UnicodeEncodeError:
            if ord(c) > 255:
                return None
            out.append(ord(c))
    return bytes(out)


def undo_mojibake(t: str) -> str:
    """UTF-8 that was read as a one-byte encoding becomes text again, run by run; runs that are no UTF-8 stay."""

    def fix(m: re.Match) -> str:
        raw = _bytes(m[0])
        if raw is None:
            return m[0]
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    if t.isascii() or not _MOJIBAKE.search(t):
        return t
    for _ in range(2):
        u = re.sub("[\u0080-\u00ff\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013\u2014\u2018-\u201e\u2020-\u2022\u2026\u2030\u2039\u203a\u20ac\u2122]{2,}", fix, t)
        if u == t:
            break
        t = u
    return t


def visible_lines(t: str) -> str:
    """``visible`` line by line, with look-alikes as Latin where the text is Latin."""
    t = "\n".join(visible(x) for x in re.split(r"\r\n|[\r\n\u0085\u2028\u2029]", t))
    return t.translate(TO_LATIN) if FOREIGN.search(t) and dominant(t) == "LATIN" else t


def script(c: str) -> str:
    """Script of a letter, by its name; phonetic letters are a script of their own, since no spelling mixes them with others. Empty for other characters."""
    if c.isascii():
        return "LATIN" if c.isalpha() else ""
    if not c.isalpha():
        return ""
    return "IPA" if "\u0250" <= c <= "\u02af" else unicodedata.name(c, "OTHER").split(" ")[0]


_AMBIGUOUS = set(LOOKALIKE) | set(LOOKALIKE.values())


def dominant(s: str) -> str:
    """Script of most letters that look like no letter of another script, of most letters if there are none such; Latin in a tie that it shares, empty without letters."""
    n: dict[str, int] = {}
    for only in (True, False):
        for c in s:
            if not (only and c in _AMBIGUOUS) and (k := script(c)):
                n[k] = n.get(k, 0) + 1
        if n:
            return max(n, key=lambda k: (n[k], k == "LATIN"))
    return ""


def convert(token: str, to: str) -> str | None:
    """The token in one script, every letter of another replaced by its look-alike; None if one has none."""
    if to == "LATIN":
        out = token.translate(TO_LATIN)
    elif to in FROM_LATIN:
        table = FROM_LATIN[to]
        out = "".join(table.get(c, c) for c in token)
    else:
        return None
    return out if all(script(c) in (to, "") for c in out) else None


def mixed_tokens(t: str) -> list[tuple[str, list[str]]]:
    """Tokens that mix scripts, with the forms they may stand for: in the token's dominant script first, then in the others it has.

    A token wholly in another script than the title, all of whose letters are look-alikes of the title's (a lone ``А`` in a Latin
    title, or a short word whose every letter was exchanged), mixes scripts with the text around it and is treated alike.
    """
    if t.isascii() or not FOREIGN.search(t):
        return []
    whole, out = dominant(t), []
    for tok in dict.fromkeys(TOKEN.findall(t)):
        if not FOREIGN.search(tok):
            continue
        own, scripts = dominant(tok), {script(c) for c in tok} - {""}
        if len(scripts) > 1:
            targets = [own, *sorted(scripts - {own}, key=lambda s: (s != whole, s != "LATIN", s))]
        elif own != whole and all(c in _AMBIGUOUS or not script(c) for c in tok):
            targets = [whole]
        else:
            continue
        forms = [f for s in targets if (f := convert(tok, s)) and f != tok]
        if forms:
            out.append((tok, list(dict.fromkeys(forms))))
    return out


def replace_tokens(t: str, table: dict[str, str]) -> str:
    return TOKEN.sub(lambda m: table.get(m[0], m[0]), t) if table else t


def fold(t: str) -> str:
    """For comparisons that ignore case and accents: visible form, look-alikes as Latin, marks dropped, lower case."""
    if t.isascii():
        return t.lower()
    t = unicodedata.normalize("NFKD", visible(t).translate(TO_LATIN))
    t = "".join(c for c in t if not unicodedata.combining(c)).lower()
    return t.translate(_STROKES)


# Letters without a decomposition.
_STROKES = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "ð": "d", "þ": "th"})
