"""Where personal information may stand in a text: candidates with their shapes and surroundings.

All positions are code points. Texts are read through a normalised view (width variants, odd spaces,
combining marks and double-encoded letters as plain characters, invisible characters left out) that
remembers where each character came from.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left
from dataclasses import dataclass, field

LEX_SLOTS = 1 << 22

_SPECIAL = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤﻿︀-️   -     　！-～‘’ʼ‐-‒̀-ͯ\u0085]|[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–—‘-„†-•…‰‹›€™]{1,3}")


def view(text: str) -> tuple[str, list[int] | None]:
    """The normalised text, and for each of its characters the position in ``text`` (None: the same)."""
    if text.isascii() or not _SPECIAL.search(text):
        return text, None
    out: list[str] = []
    at: list[int] = []
    end = 0
    for m in _SPECIAL.finditer(text):
        out += text[end : m.start()]
        at += range(end, m.start())
        s, c = m[0], m[0][0]
        end = m.end()
        if len(s) > 1:
            try:
                fixed = s.encode("cp1252").decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                try:
                    fixed = s.encode("latin-1").decode("utf-8")
                except (UnicodeEncodeError, UnicodeDecodeError):
                    fixed = ""
            if len(fixed) == 1:
                out.append(" " if fixed.isspace() else fixed)
                at.append(m.start())
            else:
                out.append(c)
                at.append(m.start())
                end = m.start() + 1
                # The rest is read again by the next search; single characters pass as they are.
                for k in range(end, m.end()):
                    out.append(text[k])
                    at.append(k)
                end = m.end()
        elif unicodedata.combining(c):
            if out and len(x := unicodedata.normalize("NFC", out[-1] + c)) == 1:
                out[-1] = x
        elif "！" <= c <= "～":
            out.append(chr(ord(c) - 0xFEE0))
            at.append(m.start())
        elif c in "‘’ʼ":
            out.append("'")
            at.append(m.start())
        elif c in "‐‑‒":
            out.append("-")
            at.append(m.start())
        elif c.isspace():
            out.append(" ")
            at.append(m.start())
    out += text[end:]
    at += range(end, len(text))
    return "".join(out), at


@dataclass
class Node:
    """A candidate: kind e(mail), d(igits), a(ddress) or n(ame); shape says what it looks like."""

    kind: str
    start: int
    end: int
    shape: str
    keys: tuple[str, ...] = ()
    feats: list[str] = field(default_factory=list)


# Words that announce or rule out an item, by language. -------------------------------

_BEFORE = {
    "phone": r"phone|tel|telephone|telefon|teléfono|téléphone|call|calling|called|anrufen|appeler|llamar|tried|mobile|cell|fax|电话|手机|reads|on|statt|number",
    "id": r"ssn|social|social security|passport|id|identity|national id|licence|license|nir|sécu|sécurité sociale|ausweis|ausweisnummer|ausweis-nr|steuer-id|personalausweis|dni|nie|nif|pasaporte|passeport|身份证号|身份证|护照号",
    "part": r"serial|s/n|seriennummer|série|serie|tray|shelf|checksum|build|version|versión|frames?|row|bin|lot|lote|pieza|pièce|référence|referencia|note|nota|asset|count|block|run|zeile|regal|step|order|序列号|版本|fx|fy|cx|key|bild|image|images|fotograma|fotogramas",
    "name": r"contact|contacto|kontakt|recorded by|enregistré par|grabado por|aufgenommen von|signed by|signé par|einwilligung von|firmado por|rückfragen an|thanks to|waiting for|reviewed with|on duty|annotator|name|belongs to|parcel for|returned to|owner|left rig|right rig|linker arm|rechter arm|sin respuesta de|sans réponse de|lost the key|operator|author|consentimiento de|accord de|采集员|签字人|联系人|姓名",
    "address": r"lives at|address|adresse|anschrift|dirección|label reads|takes at|wohnt in der|zurück an|colis|caméra au|habite|paquete se lee|cámara a|vive en|地址|住址|returned to|at|reads",
    "mail": r"mail|e-mail|email|courriel|correo|write to|écrire à|escribir a|cc|邮箱|copy to|to|at",
}
_TITLE = re.compile(r"(?:^|[^\w])(?:(?i:dr|prof|ms|mr|mrs|mx|frau|herr|mme|mlle|monsieur|madame|sra|srta|sr|don|doña|dra)|M)\.? $")
_BEFORE_RE = {k: re.compile(rf"(?i)(?:^|[^\w])(?:{v})(?:\.|nos?\b\.?|\s+(?:no|nr|n°|numéro|number)\b\.?|\s*n\.º)?(?:\s+\W{{1,4}}\.?)?\s*[:：=;,<(]{{0,2}}\s*(?:de |du |à |a |den |der |the |le |la |al |el |on |at |by )?$") for k, v in _BEFORE.items()}
_CJK_BEFORE = {k: re.compile(rf"(?:{'|'.join(w for w in v.split('|') if re.match('[一-鿿]', w)) or '(?!)'})[:：]?\s*$") for k, v in _BEFORE.items()}
_AFTER = {
    "says": re.compile(r"(?i)^,?\s+(?:says|asked|asks|thinks|said|wrote|meint|sagt|fragt|trouve|dit|demande|cree|dice|pide)\b"),
    "request": re.compile(r"(?i)^'s (?:request|note|mail|copy)"),
    "paren": re.compile(r"^,? ?\((?:phone|tel)?\s?[+(\d]"),
    "poss": re.compile(r"^'s\b"),
    "thing": re.compile(r"^ [a-zß-ÿ]+"),
    "end": re.compile(r"^\s*(?:[.,;:!?\"')\]。，；]|$)"),
}

_EMAIL = re.compile(
    r"(?i)(?<![\w.+\-@])[a-z0-9à-ÿ](?:[\w.+\-]*[a-z0-9à-ÿ_])?(?: ?@ ?|\(at\)| \(at\) | ?\[at\] ?)(?:[a-z0-9](?:[\w\-]*[a-z0-9])?(?:\.| ?\[dot\] ?| ?\(dot\) ?| dot ))+[a-z]{2,12}(?![\w@])"
    r"|(?<![\w.+\-@])[a-z0-9](?:[\w.+\-]*[a-z0-9_])? at (?:[a-z0-9](?:[\w\-]*[a-z0-9])?(?: dot ))+[a-z]{2,12}(?![\w@])"
)
_DIGITS = re.compile(
    r"(?<![\w@])(?:\(?\+\d{1,3}\)?|\(\d{2,5}\)|\d)(?:[ .\-/]?\(?\d+\)?)*(?:[ \-]?[A-Za-z](?![\w]))?(?![\w@])"
    r"|(?<![\w@])(?!(?:ON|AL|LE|AT|BY|NO|TO|IN|ID|DE|DU|LA|EL|IS|OF|OR|AN|AM|UM|EN) )[A-Z]{1,2} ?\d{2,3} ?\d{3}(?: ?\d{1,3})?[A-Z]?(?![\w@])"
    r"|(?<![\w@])[A-Za-z]\d[A-Za-z]\d[A-Za-z]\d{1,2}[A-Za-z]\d(?![\w@])"
    r"|(?<![\w@])[A-Za-z]\d{8}(?![\w@])"
)
_CJK = r"一-鿿"
_DIGITS_CJK = re.compile(rf"(?<=[{_CJK}:：])(?:\+?\(?\d[\d ()\-.]{{5,}}\d|\d{{17}}[\dXx])")

_STOP = r"(?!(?:mm|cm|m|km|s|ms|hz|along|from|of|and|the|a|an|in|on|to|with|for|at|by|points?|frames?|images?|steps?|chunks?|keypoints?|while|then|until|per|is|was|were|are|left|right|takes?|clips?|or|into|near|beside|one|two|bis|ter)\b)"
_CITY = r"(?:,? (?:apt|unit|suite|flat|ste)\.? ?#?\d{1,4}[a-z]?)?(?:, " + _STOP + r"[a-zà-ÿ]+(?: " + _STOP + r"[a-zà-ÿ]+){0,2}(?: \d{5}| [a-z]{1,2}\d{1,2} \d[a-z]{2})?(?=[.,;!?\"'\])\s]|$))?"
_ADDRESS = {
    "en": re.compile(r"(?i)(?<![\w.,/\-:])(?<!\d )\d{1,5}(?:-?[a-z])?,? (?:" + _STOP + r"[a-z'][\w'\-]* ){1,3}(?:street|st|road|rd|avenue|ave|lane|ln|drive|dr|court|ct|close|cl|row|hill|way|place|pl|boulevard|blvd|square|sq|terrace|crescent|parkway|pkwy|mews|walk)\b\.?" + _CITY),
    "fr": re.compile(r"(?i)(?<![\w.,/\-:])\d{1,4}(?: ?(?:bis|ter|quater|[a-d]))?,? (?:rue|avenue|av\.?|bd\.?|boulevard|chemin|impasse|allée|place|quai|route|cours|passage|square) (?:de la |de l'|des |du |de |d')?[\w'\-]+(?: [A-ZÀ-Ý][\w'\-]+)*(?:, \d{5} [\w'\-]+(?: [A-ZÀ-Ý][\w'\-]+)*)?"),
    "de": re.compile(r"(?i)(?<![\w\-])(?:[a-zäöüß\-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|steig|rain|ring|damm|ufer|pfad|hof|markt|graben|stieg)|(?-i:Am|An der|Im|Zum|Zur|Auf dem|Auf der|Unter den|Hinter dem|AM|IM|ZUM|ZUR|am|zum|zur) [a-zäöüß]+(?: [a-zäöüß]+)?) \d{1,4}(?: ?[a-f])?\b(?:, \d{5} [a-zäöüß]+(?: (?-i:[A-ZÄÖÜ])[a-zäöüß]+| [a-zäöüß]+(?=[.\"\n]))?)?"),
    "es": re.compile(r"(?i)(?<![\w/])(?:c/|calle|avenida|avda\.?|av\.|plaza|pza\.?|paseo|camino|ronda|carrera|travesía) ?(?:de los |de las |de la |del |de )?[\wáéíóúñ]+(?: (?!n\.)[^\W\d]+)?,? (?:n\.º |nº |n\.° |núm\. )?\d{1,4}\b(?:, \d{1,2}\.?º ?[a-z]\b)?(?:, \d{5} [\wáéíóúñ]+)?"),
    "zh": re.compile(rf"[{_CJK}]{{2,5}}(?:路|街|巷|道|弄|胡同)\d+号(?:\d+单元)?(?:\d+室)?"),
}

_WORD = re.compile(r"[^\W\d_]+(?:['\-](?!s\b|S\b)[^\W\d_]+)*")
# Announcing phrases that end in a word which is also a name particle.
_OWNS_PARTICLE = re.compile(r"(?i)(?:aufgenommen|einwilligung|unterschrieben|réponse|respuesta|consentimiento|accord|part|parte|gracias|note|mail) $")
_PARTICLES = frozenset("von van de der den del della di du la le da dos ter ten zu".split())
# Capitalised words of captions and logs that never start a name.
_NO_NAME = frozenset("monsieur madame miss the a an on in at and or of by to from for with not no it is this that contact kontakt recorded reviewed thanks operator lost left right left-rig call write questions badge two between most see why can't don't can mean instruction chunks frame frames frau herr arm hand kamera camera der die das ein eine bitte auf ab le la les un une à entre el los las una desde se don doña mr mrs ms dr prof mme mlle m sr sra clip skill verdict task todo run build version serial shelf station tray asset point north south west east i i'd i'll we we're she she'll he they if".split())
_HAN_NAME = re.compile(rf"(?:采集员|签字人|联系人|姓名|操作员|标注员)\s*[:：]\s*([{_CJK}·]{{2,5}})(?![{_CJK}])")


def slot(word: str) -> int:
    return zlib.crc32(word.lower().encode("utf-8", "replace")) & (LEX_SLOTS - 1)


def digit_shape(s: str) -> str:
    """The format of a digit item, as far as formats of numbers go; ``other`` fits none."""
    d = re.sub(r"\D", "", s)
    letters = re.sub(r"[^A-Za-z]", "", s)
    groups = tuple(len(g) for g in re.findall(r"\d+", s))
    if letters:
        if re.fullmatch(r"(?:\d{8}|\d{2}\.\d{3}\.\d{3})[ \-]?[A-Za-z]", s):
            return "i_dni"
        if re.fullmatch(r"[A-Za-z]\d[A-Za-z]\d[A-Za-z]\d{1,2}[A-Za-z]\d", s):
            return "i_card"
        if re.fullmatch(r"[A-Za-z]{1,2} ?\d{3} ?\d{3}[A-Za-z]?|[A-Za-z]\d{8}|[A-Za-z]{2}\d{6}[A-Za-z]?", s):
            return "i_passport"
        if re.fullmatch(r"\d{17}[Xx]", s):
            return "i_cn"
        return "other"
    if s.lstrip("(").startswith("+") and 7 <= len(d) <= 15:
        return "p_plus"
    if re.match(r"00[1-9]", s) and 10 <= len(d) <= 15 and not s.startswith("00 "):
        return "p_00"
    if groups == (3, 3, 4) and not re.search(r"[/]", s):
        return "p_us"
    if groups == (3, 2, 4):
        return "i_ssn"
    if groups in ((5, 6), (3, 4, 4), (4, 3, 4), (4, 6), (5, 3, 3)) and s.startswith("0"):
        return "p_uk"
    if groups == (2, 2, 2, 2, 2) and s.startswith("0"):
        return "p_fr"
    if groups in ((3, 3, 3), (3, 2, 2, 2)) and s[0] in "56789":
        return "p_es"
    if s.startswith("0") and groups[0] in (3, 4, 5) and 8 <= sum(groups) <= 13 and (len(groups) == 3 and "-" not in s or "/" in s and len(groups) in (2, 3)):
        return "p_de"
    if groups == (2, 3, 3, 3):
        return "i_tax"
    if re.match(r"[12]", s) and (groups in ((1, 2, 2, 2, 3, 3, 2), (1, 2, 2, 2, 3, 3)) or len(groups) == 1 and len(d) in (13, 15)):
        return "i_nir"
    if len(groups) == 1:
        return {18: "i_cn", 9: "n_9", 10: "n_10", 11: "n_11"}.get(len(d), "other")
    return "other"


def _context(t: str, a: int, b: int) -> list[str]:
    before = t[max(0, a - 34) : a]
    after = t[b : b + 24]
    out = [f"b:{k}" for k, p in _BEFORE_RE.items() if p.search(before)]
    out += [f"b:{k}" for k, p in _CJK_BEFORE.items() if p.search(before) and f"b:{k}" not in out]
    if _TITLE.search(before):
        out.append("b:title")
    if not before.strip() or re.search(r"[.!?。\n\r\"\]]\s*$|\d\. $", before):
        out.append("b:start")
    out += [f"a:{k}" for k, p in _AFTER.items() if p.search(after)]
    return out


_CLASSES: dict[str, tuple[int, str]] = {}  # classes of words seen with the lexicon in use
_CLASSES_OF: list[bytes] = [b""]


def _word_class(w: str, lex: bytes) -> tuple[int, str]:
    """Lexicon code and case of a word: low, cap, upper, or upper1 for a single capital."""
    if _CLASSES_OF[0] is not lex or len(_CLASSES) > 300_000:
        _CLASSES.clear()
        _CLASSES_OF[0] = lex
    got = _CLASSES.get(w)
    if got is None:
        low = w.lower()
        code = lex[slot(low)] if low not in _NO_NAME else 0
        if not code and "-" in low:
            code = 2 if all(lex[slot(x)] for x in low.split("-")) else 0
        case = ("upper1" if len(w) == 1 else "upper") if w.isupper() else "cap" if w[0].isupper() else "low"
        got = _CLASSES[w] = (code, case)
    return got


def _names(t: str, lex: bytes) -> list[Node]:
    words = [(m.start(), m.end()) for m in _WORD.finditer(t)]
    n = len(words)
    info: list[tuple[int, str]] = []  # lexicon code, case class
    for a, b in words:
        w = t[a:b]
        code, case = _word_class(w, lex)
        if case == "upper1":
            case = "init" if t[b : b + 1] == "." and (w != "I" or t[b : b + 2] == ". ") else "cap"
        info.append((code, case))

    def namey(i: int) -> bool:
        code, case = info[i]
        w = t[words[i][0] : words[i][1]].lower()
        return bool(code) or case == "init" or case == "cap" and w not in _NO_NAME and len(w) > 1

    def joined(i: int) -> bool:
        """Whether word i + 1 follows word i as in a name."""
        gap = t[words[i][1] : words[i + 1][0]]
        return gap == " " or gap in (". ", ".") and info[i][1] == "init"

    out: list[Node] = []
    i = 0
    while i < n:
        w = t[words[i][0] : words[i][1]].lower()
        particle = w in _PARTICLES and i + 1 < n and joined(i) and info[i + 1][0] & 2 and not _OWNS_PARTICLE.search(t[max(0, words[i][0] - 16) : words[i][0]])
        if not namey(i) and not particle:
            i += 1
            continue
        j = i
        while j + 1 < n and joined(j) and (namey(j + 1) or t[words[j + 1][0] : words[j + 1][1]].lower() in _PARTICLES and j + 2 < n and joined(j + 1) and info[j + 2][0]) and j - i < 5:
            j += 1
        lo, hi = i, j
        i = j + 1
        coded = [k for k in range(lo, hi + 1) if info[k][0]]
        if coded:
            while lo < coded[0] and info[lo][1] != "init" and (
                _OWNS_PARTICLE.search(t[max(0, words[lo][0] - 16) : words[lo][0]])
                if t[words[lo][0] : words[lo][1]].lower() in _PARTICLES
                else lo == 0 or t[max(0, words[lo][0] - 2) : words[lo][0]] in ("", ". ", "\n", "\r\n") or hi - lo >= 2
            ):
                lo += 1
            while hi > coded[-1]:
                hi -= 1
        while hi > lo and info[hi][1] == "init":
            hi -= 1
        cased = {info[k][1] for k in range(lo, hi + 1)}
        # Family, Given
        if coded and info[hi][0] & 2 and hi - lo <= 1 and hi + 1 < n and t[words[hi][1] : words[hi + 1][0]] == ", " and info[hi + 1][0] & 1 and (hi == lo or t[words[lo][0] : words[lo][1]].lower() in _PARTICLES):
            nxt = hi + 2 < n and joined(hi + 1) and info[hi + 2][0] & 2
            if not nxt:
                hi += 1
                i = hi + 1
                shape = "fg"
            else:
                shape = "one"
        elif all(info[k][1] == "init" for k in range(lo, hi + 1)):
            continue
        elif info[lo][1] == "init":
            shape = "if"
        elif hi == lo:
            shape = "one"
        else:
            shape = "many"
        a, b = words[lo][0], words[hi][1]
        toks = [t[words[k][0] : words[k][1]].lower() for k in range(lo, hi + 1)]
        code = [info[k][0] for k in range(lo, hi + 1)]
        ctx = _context(t, a, b)
        lexed = sum(1 for c in code if c)
        if not lexed and "b:name" not in ctx and "b:title" not in ctx and "a:request" not in ctx and "a:says" not in ctx:
            continue
        if shape == "one" and code[0] == 1 and not any(c in ctx for c in ("b:name", "b:title", "a:request", "a:says", "a:paren")) and "low" in cased:
            continue
        first, last = code[0], code[-1] if shape != "fg" else code[0]
        f = [f"s:{shape}", f"s:{shape}/{min(lexed, 2)}", f"c:{first}{last}", f"k:{'+'.join(sorted(cased))}", f"s:{shape}/c:{first}{last}"]
        f += [f"{x}" for x in ctx] + [f"{x}|{shape}" for x in ctx]
        out.append(Node("n", a, b, shape, tuple(x for x, c in zip(toks, code) if c & 2 or not c), f))
    for m in _HAN_NAME.finditer(t):
        out.append(Node("n", m.start(1), m.end(1), "han", (m[1],), ["s:han", "b:name", "b:name|han"]))
        for k in re.finditer(re.escape(m[1]), t):
            if k.start() != m.start(1):
                out.append(Node("n", k.start(), k.end(), "han2", (m[1],), ["s:han2"]))
    return out


def candidates(t: str, lex: bytes) -> list[Node]:
    """All candidates of a normalised text, in order and without overlaps; emails win over addresses, those over digits and names."""
    out: list[Node] = []
    taken: list[tuple[int, int]] = []  # in order

    def put(node: Node) -> None:
        k = bisect_left(taken, (node.start, node.end))
        if node.end > node.start and (k == 0 or taken[k - 1][1] <= node.start) and (k == len(taken) or node.end <= taken[k][0]):
            taken.insert(k, (node.start, node.end))
            out.append(node)

    low = t.lower()
    if "@" in t or "(at)" in low or "[at]" in low or " dot " in low:
        for m in _EMAIL.finditer(t):
            s = "at" if "@" not in m[0] else "spaced" if " " in m[0] else "plain"
            ctx = _context(t, m.start(), m.end())
            put(Node("e", m.start(), m.end(), s, (m[0].lower(),), [f"s:{s}", *ctx]))
    for lang, p in _ADDRESS.items():
        for m in p.finditer(t):
            a, b = m.start(), m.end()
            while b > a and t[b - 1] in " ,":
                b -= 1
            ctx = _context(t, a, b)
            zipped = "zip" if re.search(r"\d{5}", m[0][6:]) else "nozip"
            put(Node("a", a, b, lang, (re.sub(r"\W+", " ", m[0].lower())[:24],), [f"s:{lang}", f"z:{zipped}", f"s:{lang}/{zipped}", *ctx, *[f"{c}|{lang}" for c in ctx]]))
    if re.search(r"\d", t):
        for p in (_DIGITS_CJK, _DIGITS):
            for m in p.finditer(t):
                s = m[0]
                a, b = m.start(), m.end()
                if len(re.sub(r"\D", "", s)) < 6:
                    continue
                k = digit_shape(s)
                if k == "other" and re.search(r"[ \-][A-Za-z]$", s):
                    s, b = s[:-2], b - 2
                    k = digit_shape(s)
                if s.startswith("(") and s.find(")") == len(s) - 1:
                    s, a, b = s[1:-1], a + 1, b - 1
                    k = digit_shape(s)
                elif s.startswith("(") and s.count("(") > s.count(")"):
                    s, a = s[1:], a + 1
                    k = digit_shape(s)
                while s.count(")") > s.count("("):
                    s, b = s[:-1], b - 1
                    k = digit_shape(s)
                if k == "other":
                    continue
                ctx = _context(t, a, b)
                put(Node("d", a, b, k, (re.sub(r"\W", "", s),), [f"s:{k}", *ctx, *[f"{c}|{k[0]}" for c in ctx], *[f"{c}|{k}" for c in ctx if c.startswith("b:")]]))
    for node in _names(t, lex):
        put(node)
    out.sort(key=lambda x: x.start)
    return out
