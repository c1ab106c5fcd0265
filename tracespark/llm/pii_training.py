"""Labelled texts for the personal-information model: invented items in invented sentences of five languages.

The generator is the labelled sample the model is fitted on; its size is the parameter ``texts``.
"""

from __future__ import annotations

import random

_SYLLABLES = "bra vel dor min tas ker lo ny shan ur fel gri mor hal ste win ros qua bel tor lin ash cre dun mar".split()


def _word(r: random.Random, n: tuple[int, int] = (2, 3)) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(*n))).capitalize()


class People:
    """Invented names; the ones that double as things are given names only."""

    def __init__(self, r: random.Random, things: list[str]):
        self.given = [_word(r, (2, 2)) for _ in range(40)] + things
        self.family = [_word(r, (3, 3)) for _ in range(40)]
        self.things = things

    def name(self, r: random.Random) -> tuple[str, str]:
        """(what stands before the name, the name)."""
        g, f = r.choice(self.given), r.choice(self.family)
        if r.random() < 0.12:
            f = r.choice(["von ", "de ", "O'"]) + f
        elif r.random() < 0.06:
            f = f + "-" + r.choice(self.family)
        k = r.random()
        title = ""
        if k < 0.5:
            s = f"{g} {f}"
        elif k < 0.6:
            s = f"{f}, {g}"
        elif k < 0.68:
            s = f"{g[0]}. {f}"
        elif k < 0.74:
            s = f"{g} {r.choice('ABCDEHKLMR')}. {f}"
        elif k < 0.8:
            title, s = r.choice(["Dr. ", "Prof. ", "Mr ", "Ms. ", "Frau ", "Mme ", "Sra. "]), f
        elif k < 0.84:
            title, s = r.choice(["Dr. ", "Ms. ", "Herr ", "M. "]), f"{g} {f}"
        elif k < 0.92:
            s = f"{g} {f}".upper()
        else:
            s = f"{g} {f}".lower()
        return title, s


def _digits(r: random.Random, pattern: str) -> str:
    return "".join(str(r.randint(0, 9)) if c == "#" else c for c in pattern)


PHONES = ["+1 ### ### ####", "(###) ###-####", "###-###-####", "###.###.####", "### ### ####", "+44 #### ######", "0#### ######", "0## #### ####", "+49 30 ##### ###", "004930 ########", "0## ##### ###", "01 ## ## ## ##", "06.##.##.##.##", "+33 1 ## ## ## ##", "+34 ### ### ###", "0034#########", "6## ### ###", "(+34) ###-###-###", "+1 (###) ###-#### ext. ##", "0##/#####-###", "0## #### ###"]
IDS = ["###-##-####", "### ## ####", "###.##.####", "#########", "QX######C", "ZQ ### ###", "X########", "1 ## ## ## ### ### ##", "2############", "##.###.###-T", "########K", "L#K#M##Z#", "## ### ### ###", "##################"]
DECOYS = ["Serial S/N ###-####-####", "Version #.##.#-###", "Seriennummer 0##-####-###", "Tray ###-##", "Point count #######", "El lote #####-####", "La pieza ######-A", "Voir la note ## ##", "Checksum 9f##-####-##c1", "Asset no. ####-##-####", "Frames ######-######", "Build #.##.#-###", "stored block ######", "Run 2031-0#-1# 08:3#:1#", "part ### ### ###", "order 0## #### ####", "serial ### ### ####", "lot ###-##-####", "count #########"]
STREETS = {
    "en": ["{n} {w} Street", "{n}A {w} {w} Lane", "{n}-B {w} Road, Apt {m}", "{n} {w} Court, {w} 7####", "{n} {w} Hill"],
    "fr": ["{m} rue du {w}", "{m} bis, avenue des {w}, 75### {w}", "{m}, impasse de l'{w}"],
    "de": ["{w}straße {m}", "{w}weg {m} c, 10### Bad {w}", "Am Alten {w} {m}"],
    "es": ["C/ {w}, {m}", "calle del {w} n.º {m}, 28### {w}", "plaza del {w} {m}"],
    "zh": ["东风路{m}号", "南河巷{m}号{m}单元"],
}
# Sentences with slots: N name, E email, P phone, I id number, A address, D a number that is none of these, X a thing that is also a name.
SENTENCES = [
    ("en", "Please contact {N} at {E} about the rig."), ("en", "Filmed and recorded by {N}."), ("en", "{N} says the focus is wrong."), ("en", "{N} asked for the raw files by phone, {P}."),
    ("en", "The key is with {N} (phone {P})."), ("en", "operator: {N} ({P}); mail: {E}"), ("en", "author={N}; mail={E}; tel={P}"), ("en", "Many thanks to {N} for the labels."), ("en", "On {N}'s request we left this out."),
    ("en", "The owner, {N}, was told."), ("en", "Reviewed with {N} and {N}."), ("en", "Left rig {N}, right rig {N}."), ("en", "Still waiting for {N}."), ("en", "Form signed by {N}, SSN {I}."), ("en", "Form signed by {N}, passport no. {I}."), ("en", "The sheet shows ID no. {I}."),
    ("en", "The sheet shows national id {I}."), ("en", "social security no. {I} belongs to {N}."), ("en", "id=social {I} name={N}"), ("en", "Call {P} first."), ("en", "We tried {P} twice."), ("en", "The screen reads {P}."), ("en", "{P} is written on the wall."), ("en", "{E} or {P}"), ("en", "cc {E}; {E}"),
    ("en", "A parcel for {N}, the label reads {A}."), ("en", "She lives at {A} and does not want to be filmed."), ("en", "The address is {A}."), ("en", "Two clips at {A}, one in the lab."), ("en", "It was returned to {N}, {A}."),
    ("en", "{D} needs a new belt."), ("en", "{D} does not match."), ("en", "The item with {D} is gone."), ("en", "{X} jar moved 12 mm along Kiln Row."), ("en", "The gripper lifts the {x} bowl."), ("en", "{X} oil is hidden by {X} leaves."), ("en", "{X} switch on door 7 is stuck."), ("en", "{X} aperture stays at 2.8."), ("en", "Kestrel Arm and Camera Left were swapped."), ("en", "Shelf 14, Row 3, Bin 2 holds the sticks."),
    ("de", "Aufgenommen von {N}."), ("de", "{N} meint, das Bild sei unscharf."), ("de", "Rückfragen an {N}, {E}."), ("de", "Telefon {P}, E-Mail {E}."), ("de", "Bitte vorher anrufen: {P}."), ("de", "Im Formular steht Ausweisnummer {I}."), ("de", "Einwilligung von {N}, Steuer-ID {I}."), ("de", "Die Person wohnt in der {A}."), ("de", "Auf dem Paket klebt die Anschrift {A}."), ("de", "Die {X} und das {X}-Glas bleiben verdeckt."), ("de", "Die Person zieht die Schüssel auf das Tablett."), ("de", "{D} steht am linken Greifer."), ("de", "Linker Arm {N}, rechter Arm {N}."),
    ("fr", "Enregistré par {N}."), ("fr", "{N} trouve l'image floue."), ("fr", "Sans réponse de {N}, écrire à {E}."), ("fr", "Appeler le {P} avant."), ("fr", "{P}, courriel {E}."), ("fr", "Accord signé par {N}, n° de sécu {I}."), ("fr", "Le formulaire porte le NIR {I}."), ("fr", "On lit sur le colis : {A}."), ("fr", "Renvoyer la caméra au {A}."), ("fr", "L'étagère 14 bis reste vide."), ("fr", "{D} est celle du bac."), ("fr", "Contact : {N}, {E}."), ("fr", "L'{x} et le pot d'{X} sortent."),
    ("es", "Grabado por {N}."), ("es", "{N} cree que falta un paso."), ("es", "Sin respuesta de {N}; escribir a {E}."), ("es", "Llamar al {P} antes."), ("es", "En la hoja figura DNI {I}."), ("es", "En el paquete se lee: {A}."), ("es", "Devolver la cámara a {A}."), ("es", "{D} es la tapa gris."), ("es", "El bote {X} y la caja {X} no se ven."), ("es", "Tel. {P}, correo {E}."), ("es", "Consentimiento de {N}, NIF {I}."), ("de", "Auf dem Blatt steht Ausweis-Nr.: {I}."), ("en", "She sent a copy to {E} or by phone on {P}."),
    ("zh", "邮箱：{E}。"), ("zh", "联系电话：{P}。"), ("zh", "地址：{A}。"), ("zh", "签字人：{H}，身份证号{C}。"), ("zh", "采集员：{H}。"), ("zh", "左手把木勺放到托盘上。"),
]


def labelled_texts(things: list[str], texts: int = 3000, seed: int = 11) -> tuple[list[tuple[str, list[tuple[str, int]]]], People]:
    """(text, [(kind, start)]) with kinds email, phone, id_number, address, name; and the people named."""
    r = random.Random(seed)
    people = People(r, things)
    things = things or ["Olive"]
    out = []
    for _ in range(texts):
        lang = r.choice(["en", "en", "de", "fr", "es", "zh"])
        pool = [s for la, s in SENTENCES if la == lang]
        text, gold = "", []
        last_family = None
        for s in r.sample(pool, min(len(pool), r.randint(1, 5))):
            if text:
                text += r.choice([" ", " ", "\n", '", "'])
            i = 0
            while i < len(s):
                if s[i] != "{":
                    text += s[i]
                    i += 1
                    continue
                kind = s[i + 1]
                i += 3
                if kind == "N":
                    title, v = people.name(r)
                    if last_family and r.random() < 0.1:
                        title, v = "", last_family
                    elif " " in v and v[0].isupper() and not v.isupper() and "," not in v:
                        last_family = v.split()[-1]
                    text += title
                    gold.append(("name", len(text)))
                elif kind == "E":
                    v = f"{r.choice(people.given).lower()}{r.choice(['.', '_', '-', '+'])}{r.choice(people.family).lower()}{r.choice(['', str(r.randint(1, 99))])}{r.choice(['@', '@', '@', '(at)', ' [at] '])}{_word(r).lower()}.example"
                    v = v.replace(".example", " [dot] example") if "[at]" in v else v
                    gold.append(("email", len(text)))
                elif kind == "P":
                    v = _digits(r, r.choice(PHONES))
                    gold.append(("phone", len(text)))
                elif kind == "I":
                    v = _digits(r, r.choice(IDS))
                    gold.append(("id_number", len(text)))
                elif kind == "C":
                    v = _digits(r, "##################")
                    gold.append(("id_number", len(text)))
                elif kind == "A":
                    t = r.choice(STREETS[lang])
                    while "{w}" in t:
                        t = t.replace("{w}", _word(r, (2, 2)), 1)
                    v = _digits(r, t.replace("{n}", str(r.randint(1, 2500))).replace("{m}", str(r.randint(1, 120))))
                    v = v.lower() if lang == "en" and r.random() < 0.1 else v
                    gold.append(("address", len(text)))
                elif kind == "H":
                    v = r.choice(["欧阳", "司马", "诸葛"]) + r.choice(["静川", "望舒", "清和"])
                    gold.append(("name", len(text)))
                elif kind == "D":
                    v = _digits(r, r.choice(DECOYS))
                else:
                    v = r.choice(things) if kind == "X" else r.choice(things).lower()
                text += v
        if r.random() < 0.04:
            text = text.upper() if text.upper().__len__() == len(text) else text
        out.append((text, gold))
    return out, people
