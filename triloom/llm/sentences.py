"""Sentence units of texts in many languages and scripts.

Segmentation rules are ordered pairs of regular expressions: what must stand before a
position and what after it, and whether that makes a break. Tables of such rules are
cascaded: for a position, those of the script before it come first, with the tables of
its language (abbreviations, ordinals) where the script has several, the common table
last, and the first rule that fits decides. Positions are those after a sentence mark
with the closing marks that belong to it, and blanks in scripts without sentence marks.
Empty lines are broken at first; quotations and brackets are protected, so that only
their end is a position. They are paired by one pass with a stack for each kind, however
long they are.

A pattern for what stands before is matched backwards from the position, one for what
follows forwards, both on the whole text: no context is bounded, and each looks at no
more than it matches. Which language a document says it has does not matter: scripts are
told by the letters before a position, languages by the function words and letters of
the sentence; where these say nothing, the tables of all languages of the script apply.

Defined results: null and blank texts have no units; positions count code points from 0;
units do not overlap and leave out only white space; a text without any mark is one unit;
a quotation or bracket that the end of the text cuts off is protected to that end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame

# Marks. Fixed values of Unicode's sentence terminals and paired punctuation.
STOPS = r"[.!?。！？｡．۔։।॥؟።፧]|::|፡፡|‽"
MARK = regex.compile(rf"(?:\.{{2,}}|…|(?<=\p{{Greek}}\d*|[A-Z]\d+);|(?<=\p{{Armenian}}[»\"”]?):(?!:)|(?<=[\p{{Devanagari}}])\||{STOPS})+[!?…՜]*")
PAIRS = {"“": "”“", "„": "“”", "«": "»", "「": "」", "『": "』", '"': '"', "(": ")", "（": "）", "[": "]", "‹": "›", "〈": "〉", "《": "》"}
CLOSING = "”»」』）)]›〉》"
BLANK_LINE = regex.compile(r"\r?\n[^\S\n]*(?:\r?\n[^\S\n]*)+|[\u2029\f]+")
THAI_GAP = regex.compile(r"[^\S\n]+|[^\S\n]*\r?\n\s*")

# Abbreviations by language; each stands before a full stop. Fixed values.
TITLES = {
    "en": "Mr Mrs Ms Dr Prof Rev Gen Col Capt Lt Sgt Hon St Messrs Sen Gov Pres",
    "de": "Hr Hrn Fr Frl Dr Prof Dipl Ing Mag Hl Sr",
    "fr": "M Mm Mme Mmes Mlle Mlles MM Dr Pr Me Mgr Prof",
    "es": "Sr Sra Srta Sres Dr Dra D Dña Prof Profa Ing Lic Ud Uds Vd",
    "pl": "dr prof mgr inż ks św gen płk hab P p pp pan doc",
    "tr": "Dr Prof Doç Av Sn Yrd Öğr Uzm Alb Gen",
    "ru": "г-н г-жа гн проф др акад доц инж им тов",
    "el": "κ κα κκ καθ δρ Δρ Κα Καθ Κ αγ",
    "hy": "Պրն Տիկ տիկ պրն Դր դր պրոֆ Պրոֆ դոկ ակադ",
    "ar": "د أ م ا السيد ق",
    "hi": "डॉ प्रो श्री सुश्री पं कु मि",
    "am": "ዶ ፕ ፕሮፌ አቶ ወ ዶር",
    "th": "ดร ศ ผศ รศ นพ พญ",
}
REFERENCES = {
    "en": "No Nos Fig Figs Sec Secs Ch Chap Eq Vol p pp Tab Art App Ex approx ca vs cf v",
    "de": "Nr Nrn Abb Abschn Kap Tab S Bd Art Abs Anh ca Ziff vgl Vgl Anm ggf bzw inkl etwa zzgl",
    "fr": "no n° fig chap p pp t vol art env cf sect tabl éq éd",
    "es": "núm nº fig figs cap caps pág págs p pp vol art aprox sec tab ej ec",
    "pl": "nr rys rozdz s str t tab ok art ust np por Por pkt zob Zob poz",
    "tr": "no No şek böl s sf bkz Bkz çiz tab örn krş c yakl",
    "ru": "рис гл стр с табл ок см См напр ст п пп т кн разд ср Ср прим",
    "el": "σχ κεφ σελ σ αρ πίν τ παρ βλ Βλ εικ περ πρβλ",
    "hy": "նկ գլ էջ Օր օր հ աղ մոտ տես բաժ թ",
    "ar": "ص ج ع رقم شكل فصل ق ت",
    "hi": "चि पृ सं अ क्र खं भा अध्या लग",
    "am": "ሥዕ ገ ቁ ምዕ ክ ቅ",
}
#: Abbreviations of several letters, or inside a phrase, that go on even before a capital.
RUNNING = {
    "en": "e.g i.e viz cf",
    "de": "z.B d.h u.U z.T i.d.R s.o s.u bzw vgl Vgl v.a o.g sog ggf evtl inkl",
    "fr": "p.ex c.-à-d cf",
    "es": "p.ej",
    "pl": "tj tzn np m.in tzw wg zob por Por",
    "tr": "örn yani bkz Bkz",
    "ru": "т.е напр см См т.н ок ср Ср",
    "el": "π.χ δηλ βλ Βλ πρβλ",
}
SCRIPTS = {
    "Latn": r"\p{Latin}", "Cyrl": r"\p{Cyrillic}", "Grek": r"\p{Greek}", "Armn": r"\p{Armenian}", "Arab": r"\p{Arabic}",
    "Deva": r"\p{Devanagari}", "Ethi": r"\p{Ethiopic}", "Thai": r"\p{Thai}", "Hani": r"[\p{Han}\p{Hiragana}\p{Katakana}ー]",
}
LANGUAGES = {"Latn": "en de fr es pl tr", "Cyrl": "ru", "Grek": "el", "Armn": "hy", "Arab": "ar", "Deva": "hi", "Ethi": "am", "Thai": "th", "Hani": ""}


#: Function words by language, and letters that are usual in one language only. Fixed values.
FUNCTION_WORDS = {
    "en": "the of and is in to that this it not with by for are was from at as",
    "de": "der die das und ist nicht ein eine im dem den zu auf von wird mit am ohne",
    "fr": "le la les des et est une dans du pas que pour sur au par sans ce dit en de",
    "es": "el la los las del y es una en que por se con sin lo al no un de",
    "pl": "i w na nie z się jest do że po przez pod bez od za jak",
    "tr": "ve bir bu için ile değil çok ama gibi olarak daha sonra her",
}
OWN_LETTERS = {"de": "ßÄÖ", "fr": "èêàœâîù’", "es": "ñ¿¡áíú", "pl": "łżśćęąńźŁŻŚ", "tr": "ışğİŞ"}


def _any(table: dict[str, str], languages: str) -> str:
    found = {w for lang in languages.split() for w in table.get(lang, "").split()}
    return "|".join(regex.escape(w).replace(r"\.", r"\.[\s\xa0 ]?") for w in sorted(found, key=lambda w: (-len(w), w)))


class Rule:
    """``before`` is matched backwards from a position, ``after`` forwards. ``ends`` are the characters that may stand right
    before the position (all if None); ``first`` are those with which the unit so far must begin."""

    __slots__ = ("after", "before", "breaks", "ends", "first", "name")

    def __init__(self, name: str, breaks: bool, before: str, after: str, ends: str | None = None, first: str | None = None):
        self.name, self.breaks, self.ends, self.first = name, breaks, ends, first
        self.before = regex.compile(f"(?r)(?:{before})") if before else None
        self.after = regex.compile(after) if after else None

    def fits(self, text: str, begin: str, at: int, end: int) -> bool:
        """``begin`` is the first character of the unit so far that is no blank."""
        if self.first is not None and begin not in self.first:
            return False
        if self.before is not None and self.before.match(text, 0, at) is None:
            return False
        return self.after is None or self.after.match(text, at, end) is not None


_GAP = r"[\s\xa0  ]*"
_OPEN = r"[“„«「『\"'‘(（¿¡\[]"
_WORD = r"(?<![\p{L}\p{M}\p{N}])"
_QUOTE_END = r"[”“\"»」』]"
_ENDS = r"(?:[.!?…。！？｡．۔։।॥؟።;]|\.{3})[\s\xa0 ]*" + _QUOTE_END
_OPENING_QUOTE, _OPENING_BRACKET = "“„«「『\"", "(（["
_AFTER_BRACKET, _AFTER_QUOTE = ")）]", "”“\"»」』]"


def _abbreviations(languages: str) -> list[Rule]:
    rules = []
    if t := _any(TITLES, languages):
        rules.append(Rule("title before a name", False, rf"{_WORD}(?:{t})\.", rf"{_GAP}(?:{_OPEN}?\p{{Lu}}|\p{{Lu}}|ad\b)", "."))
    if t := _any(REFERENCES, languages):
        rules.append(Rule("reference before a number", False, rf"{_WORD}(?:{t})\.", rf"{_GAP}[№#]?{_GAP}[\p{{Nd}}IVX]", "."))
    if t := _any(RUNNING, languages):
        rules.append(Rule("running abbreviation", False, rf"{_WORD}(?:{t})\.", rf"{_GAP}[\p{{L}}\p{{Nd}}№]", "."))
    return rules


@lru_cache(maxsize=1)
def language_tables() -> dict[str, list[Rule]]:
    """The rule tables of the languages of a script that has several; "" is for sentences of any of them."""
    months = "Jan|Feb|März|Mär|Apr|Mai|Jun|Jul|Aug|Sep|Okt|Nov|Dez"
    german = [
        Rule("day before a month", False, r"(?<!\p{Nd})\p{Nd}{1,2}\.", rf"{_GAP}(?:{months})", "."),
        Rule("ordinal number", False, r"(?i:(?<!\p{L})(?:am|vom|zum|zur|der|den|dem|des|ab|bis|beim|seit dem|jeder|jede))\s\p{Nd}{1,2}\.", rf"{_GAP}\p{{Lu}}", "."),
    ]
    out = {lang: _abbreviations(lang) + (german if lang == "de" else []) for lang in LANGUAGES["Latn"].split()}
    return out | {"": _abbreviations(LANGUAGES["Latn"]) + german}


_LAST_WORD = regex.compile(r"(?r)[\p{L}\p{M}°-]*\.")
#: The last words of all abbreviations of the script with several languages.
_LAST_WORDS = {w.rsplit(".", 1)[-1] for t in (TITLES, REFERENCES, RUNNING) for lang in LANGUAGES["Latn"].split() for w in t.get(lang, "").split()}


def _maybe_abbreviated(text: str, at: int) -> bool:
    """Whether a table of any language may have a say on the full stop before ``at``."""
    m = _LAST_WORD.match(text, 0, at)
    return m is not None and (m[0][:-1] in _LAST_WORDS or (text[at - 2 : at - 1].isdigit() and text[at : at + 1].isspace()))


#: Words that end no abbreviation.
_VOTERS = regex.compile(r"\p{L}++(?!\.)")
_SPEAKS_FOR: dict[str, list[str]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _word in _words.split():
        _SPEAKS_FOR.setdefault(_word, []).append(_lang)
_OWN = {lang: frozenset(letters) for lang, letters in OWN_LETTERS.items()}


class _Votes:
    """Which Latin-script language the signs of a stretch of text, taken in piece by piece, speak for."""

    def __init__(self, text: str, start: int):
        self.text, self.start, self.upto, self.count = text, start, start, {}

    def extend(self, end: int) -> None:
        count = self.count
        for word in _VOTERS.findall(self.text, self.upto, end):
            for lang in _SPEAKS_FOR.get(word, ()) or _SPEAKS_FOR.get(word.lower(), ()):
                count[lang] = count.get(lang, 0) + 1
        letters = set(self.text[self.upto : end])
        for lang, own in _OWN.items():
            if found := len(own & letters):
                count[lang] = count.get(lang, 0) + found
        self.upto = max(self.upto, end)

    def winner(self) -> str:
        """The language most signs speak for, "" if none does or several do alike."""
        ranked = sorted(self.count.items(), key=lambda v: -v[1])
        return ranked[0][0] if ranked and (len(ranked) == 1 or ranked[0][1] > ranked[1][1]) else ""


#: Stands in the table of a script where those of its languages belong.
BY_LANGUAGE = Rule("tables of the language", False, "", "")


@lru_cache(maxsize=1)
def tables() -> dict[str, list[Rule]]:
    """The rule tables, one for each script; the common rules end every one."""
    cased = [
        Rule("list end before a new sentence", True, r"(?i:\bu\.[\s\xa0]?ä|\betc|\busw|\bitd|\bitp|\bvb|т\.[\s\xa0]?[дп]|κ\.?[\s\xa0]?λπ|κ\.?[\s\xa0]?ά)\.", rf"{_GAP}{_OPEN}*{_GAP}[\p{{Lu}}\p{{Lo}}]", "."),
    ]
    initial = [
        Rule("abbreviation of single letters", False, rf"{_WORD}\p{{L}}\.", rf"{_GAP}\p{{L}}\.", "."),
        Rule("initial", False, r"(?<![^\s\xa0.(«“„\"])\p{Lu}\.", rf"{_GAP}(?:\p{{Lu}}\.|\p{{Lu}}\p{{L}}|\p{{L}})", "."),
    ]
    decimal = [Rule("inside a number or a name", False, r"[\p{Ll}\p{Lu}\p{Nd}_)]\.", r"[\p{Ll}\p{Nd}_]", "."), Rule("fullwidth decimal", False, r"\p{Nd}．", r"\p{Nd}", "．")]
    quotes_cased = [
        Rule("quotation goes on", False, "", rf"{_GAP}(?:[,;:،—–\-]|\p{{Ll}})", _AFTER_QUOTE),
        Rule("quotation is over", True, _ENDS, rf"{_GAP}(?:{_OPEN}|\p{{L}}|\p{{Nd}})", _AFTER_QUOTE),
        Rule("quotation without an end of its own", False, "", "", _AFTER_QUOTE),
    ]
    quotes_caseless = [
        Rule("quotation at the start is carried on", False, "", rf"{_GAP}[^\s]", _AFTER_QUOTE, _OPENING_QUOTE),
        Rule("quotation goes on", False, "", rf"{_GAP}(?:[,;:،、，؛；—–\-]|\p{{Ll}})", _AFTER_QUOTE),
        Rule("quotation is taken up", False, "", rf"{_GAP}(?:と|って|という|を|が|は|も|の|に|で|अ?से\s|ने\s|ያ?ሲ|አል|አለ|ብሎ|ብላ|በማለት|(?:في|خلال|بعد|قبل|دون|للمرة|عند|منذ|من|على|إلى|حتى|ثم|مرة|أثناء|بدون|مع)(?!\p{{L}}))", _AFTER_QUOTE),
        Rule("quotation is over", True, _ENDS, "", _AFTER_QUOTE),
        Rule("quotation without an end of its own", False, "", "", _AFTER_QUOTE),
    ]
    brackets = [
        Rule("bracket goes on", False, "", rf"{_GAP}(?:[,;:،、，；—–]|\p{{Ll}})", _AFTER_BRACKET),
        Rule("sentence in brackets", True, r"[.!?…。！？｡．۔։।॥|؟።:;፡]\s*[)）\]]", "", _AFTER_BRACKET, _OPENING_BRACKET),
        Rule("end before a bracket", True, r"(?:[.!?。！？｡।|؟።։]|\p{Armenian}:)\s*[)）\]]", rf"{_GAP}{_OPEN}*{_GAP}[\p{{Lu}}\p{{Lo}}]", _AFTER_BRACKET),
        Rule("bracket inside", False, "", "", _AFTER_BRACKET),
    ]
    common = [
        Rule("ellipsis before letters without case", False, r"(?:…|\.{2,})", rf"{_GAP}\p{{Lo}}", "….") ,
        Rule("glued sentence", True, r"[\p{Ll}\p{Nd}][.!?]+", r"\p{Lu}\p{Ll}*(?:[\s\xa0'’.:,_\-]|\Z)", ".!?"),
        Rule("mark inside a word", False, "", r"[\p{Ll}\p{Lu}\p{Nd}_]", ".!?:;…"),
        Rule("goes on in small letters", False, "", rf"{_GAP}{_OPEN}?{_GAP}\p{{Ll}}", ".!?…;:"),
        Rule("goes on after a mark", False, "", rf"{_GAP}[,;،、，؛；·]"),
        Rule("dash after an end", False, "", rf"{_GAP}[—–]{_GAP}\p{{Ll}}"),
        Rule("end", True, "", ""),
    ]
    ellipsis = [Rule("ellipsis inside", False, r"(?:…|\.{2,})", rf"{_GAP}\S", "….")]
    strong = lambda marks: [Rule("full stop of the script", True, rf"(?:{marks})[!?！？՜]*", "")]
    single = lambda script: [Rule("single letter", False, rf"{_WORD}{script}\p{{M}}*\.", rf"{_GAP}[\p{{L}}\p{{Nd}}]", ".")]
    out = {
        "Latn": brackets + quotes_cased + cased + [BY_LANGUAGE] + initial + decimal,
        "Cyrl": brackets + quotes_cased + cased + _abbreviations("ru")
        + [Rule("number sign", False, "", rf"{_GAP}№", "."), Rule("year or thousand", False, rf"{_WORD}(?:тыс|млн|млрд|руб|г|в|гг|вв)\.", rf"{_GAP}[\p{{Ll}})]", ".")]
        + initial + decimal,
        "Grek": brackets + quotes_cased + cased + _abbreviations("el") + initial + decimal
        + [Rule("Greek question mark", True, r"\p{L}[\p{L}\p{M}]*\d*;", rf"{_GAP}(?:{_OPEN}|\p{{Lu}}|\p{{Nd}}|$)", ";")],
        "Armn": brackets + quotes_cased + _abbreviations("hy") + decimal + strong("։")
        + [Rule("colon as full stop", True, r"\p{Armenian}[՜՞]?[»\"”]?:", rf"{_GAP}(?:{_OPEN}?{_GAP}[\p{{Lu}}\p{{Lo}}]|$)", ":"),
           Rule("point is no full stop", False, "", rf"{_GAP}\S", ".")],
        "Arab": brackets + quotes_caseless + ellipsis + _abbreviations("ar") + single(r"\p{Arabic}") + decimal
        + [Rule("goes on after an ellipsis", False, "", "", "…")] + strong("[؟۔!?]") + [Rule("full stop", True, r"\p{Arabic}\p{M}*\.", "", ".")],
        "Deva": brackets + quotes_caseless + ellipsis
        + [Rule("abbreviation", False, rf"{_WORD}(?:{_any(TITLES, 'hi')}|{_any(REFERENCES, 'hi')}|जे|के|एम|एस|आर|टी|पी|बी|सी|डी|वी|ए|एन|एल|जी)\.", rf"{_GAP}[\p{{L}}\p{{Nd}}]", ".")]
        + decimal + strong(r"[।॥!?|]") + [Rule("point as full stop", True, r"\p{Devanagari}\p{M}*\.", rf"{_GAP}(?:\S|$)", ".")],
        "Ethi": brackets + quotes_caseless + ellipsis + _abbreviations("am")
        + decimal + strong("[።፧!?]|::|፡፡"),
        "Thai": brackets + ellipsis + [Rule("title", False, rf"{_WORD}(?:{_any(TITLES, 'th')})\.", rf"{_GAP}\S", ".")] + decimal,
        "Hani": brackets + quotes_caseless + [Rule("ellipsis inside", False, r"(?:…|\.{2,})", r"[^\s]", "….")] + initial + decimal
        + strong("[。！？｡．]") + [Rule("point as full stop", True, r"[\p{Han}\p{Hiragana}\p{Katakana}ー\p{Nd}]\.", rf"{_GAP}[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Lu}}“「（(]", "."), Rule("point between", False, "", rf"{_GAP}[\p{{L}}\p{{Nd}}]", ".")],
        "common": [],
    }
    return {script: rules + common for script, rules in out.items()}


_THAI = r"\p{Thai}"
_THAI_LETTER = regex.compile(_THAI)
#: Blanks in Thai: the first rule that fits decides.
THAI_RULES = [
    Rule("repetition mark", False, "", r"\s+ๆ"),
    Rule("after a quotation or an opening mark", False, r"[”\"»“„«(]", r""),
    Rule("before a closing mark", False, "", r"\s+[”»),.;:?!…]"),
    Rule("speaker begins", True, rf"(?:{_THAI}|ๆ)", r"\s+\p{Lu}\p{Ll}+(?:[ \xa0]\p{Lu}\p{Ll}+)?\s+(?:กล่าว|เชื่อ|ถาม|บอก|เขียน|คิด|พูด|ระบุ|เห็น)"),
    Rule("title before a name", False, r"(?:ดร|ศ|ผศ|รศ|นพ|พญ|นาย|นาง|นางสาว|คุณ)\.?", r"\s+\S"),
    Rule("foreign sentence", True, rf"{_THAI}", r"\s+(?:\p{Lu}[\p{Ll}’']*[ \xa0]\p{Ll}+|[\p{Cyrillic}\p{Greek}\p{Armenian}\p{Arabic}\p{Devanagari}\p{Ethiopic}\p{Han}\p{Hiragana}\p{Katakana}]|[¿¡])"),
    Rule("bracket of its own", True, rf"{_THAI}", r"\s+[(（]\p{Thai}[^)）]{20,}[)）](?:\s|$)"),
    Rule("after a bracket of its own", True, "", r"\s+\S", ")）", "(（"),
    Rule("code, number or name beside", False, rf"[\p{{Latin}}\p{{Nd}}_.%)]", rf"\s+{_THAI}"),
    Rule("before a code, number or name", False, rf"{_THAI}", r"\s+[\p{Latin}\p{Nd}]"),
    Rule("before a quotation", False, r"(?:ว่า|คือ|:)", r"\s+[“\"«„]"),
    Rule("goes on", False, "", r"\s+(?:แต่|และ|หรือ|เช่น|แล้ว(?!\p{Thai})|ตั้งแต่|เพราะ|ซึ่ง|ที่|โดย|ในรอบ|ในตอน|ตอน|หลัง|เป็นครั้ง|เรื่อง(?!นี้)|ข้อ(?=\s*\p{Nd})|เปอร์เซ็นต์|กล่าวว่า|เชื่อว่า|คือ|อีก|ทั้ง|กับ|จน|เมื่อ|ถ้า|ว่า|จึง|ก็|เท่านั้น|เป็นต้น|ฯลฯ|นัก)"),
    Rule("left open", False, r"(?:เช่น|ได้แก่|และ|หรือ|แต่|คือ|ว่า|บางขั้น|มีเพียง|ดูรูปที่|รุ่น|ข้อ)", r"\s+\S"),
    Rule("statement ends", True, rf"(?:{_THAI}|[”\"»)ๆ])", r"\s+(?:\S)"),
]

_SCRIPT_OF = regex.compile("|".join(f"(?P<{k}>{v})" for k, v in SCRIPTS.items()))
#: A code or file name is a run of letters, digits, low lines and points with a digit or low line in it, or a name with an extension.
_SIGN_OF_CODE = regex.compile(r"(?r)[\p{Nd}_]")
_EXTENSION = regex.compile(r"(?r)[\p{Latin}_]+\.[a-z]{2,4}")
_SOLID = regex.compile(r"\S")


class _Scripts:
    """The script of the last letter before a position that is no part of a code or file name.

    Positions are asked for in order; each looks back to the one before it only.
    """

    def __init__(self, text: str):
        self.text = text
        self.known: list[tuple[int, int, str, int]] = [(0, -1, "common", -1)]  # position, where the letter is, script, a Latin code letter
        self.run = (0, 0, -1)  # the run of letters, digits, low lines and points looked at last, and its last sign of a code

    def at(self, at: int, low: int) -> str:
        """For a unit that begins at ``low``."""
        text = self.text
        i, found, script, code = at - 1, -1, "common", -1
        back = len(self.known) - 1
        while i >= 0:
            while self.known[back][0] > i + 1:
                back -= 1
            if self.known[back][0] == i + 1 and i + 1 < at:
                _, found, script, more = self.known[back]
                code = max(code, more)
                break
            m = _SCRIPT_OF.match(text, i)
            if m is None:
                i -= 1
                continue
            if m.lastgroup != "Latn":
                found, script = i, m.lastgroup
                break
            code = max(code, i)
            s = i
            while s > self.run[1] and (text[s - 1].isalnum() or text[s - 1] in "_."):
                s -= 1
            sign, seen = -1, s
            if s == self.run[1]:
                s, _, sign = self.run
            e = i + 1
            while e < at and (text[e].isalnum() or text[e] == "_"):
                e += 1
            if (last := _SIGN_OF_CODE.search(text, min(seen, e), e)) is not None:
                sign = last.start()
            self.run = (s, e, sign)
            name = _EXTENSION.match(text, max(s, low), e)
            if sign < max(s, low) and (name is None or name.start() > max(s, low)):
                found, script = i, "Latn"
                break
            i = s - 1
        self.known.append((at, found, script, code))
        return script if found >= low else "Latn" if code >= low else "common"


def _pairs(text: str, a: int, b: int) -> dict[int, int]:
    """Where each opening mark in text[a:b] is closed, by one pass with a stack for each kind of mark."""
    closed: dict[int, int] = {}
    stacks: dict[str, list[int]] = {c: [] for c in PAIRS}
    for m in _PAIRED.finditer(text, a, b):
        k = m.start()
        ch = text[k]
        for c in _CLOSES.get(ch, ""):
            stack = stacks[c]
            if not stack:
                continue
            if c in _FLAT:
                # such marks do not nest: the next one closes all that are open; a mark between a blank and a letter opens
                if c == '"' or not (ch == "“" and k + 1 < b and text[k - 1].isspace() and not text[k + 1].isspace()):
                    for s in stack:
                        closed[s] = k
                    stack.clear()
            else:
                closed[stack.pop()] = k
        if ch in PAIRS:
            stacks[ch].append(k)
    return closed


_FLAT = '"“„'
_CLOSES: dict[str, str] = {}
for _c, _ends in PAIRS.items():
    for _e in set(_ends):
        _CLOSES[_e] = _CLOSES.get(_e, "") + _c
_PAIRED = regex.compile("[" + regex.escape("".join(sorted({*PAIRS, *_CLOSES}))) + "]")


def _spans(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Outermost quotations and brackets in text[a:b], as (start, end), in order."""
    out: list[tuple[int, int]] = []
    closed = _pairs(text, a, b)
    i = a
    for m in _OPENS.finditer(text, a, b):
        s = m.start()
        if s < i:
            continue
        if s in closed:
            out.append((s, closed[s] + 1))
            i = closed[s] + 1
            continue
        # a text that is cut off inside a quotation: the rest belongs to it
        c = text[s]
        opens = (s == 0 or not text[s - 1].isalnum() or text[s - 1] > "\u2e80") and s + 1 < len(text) and (c == "«" or not text[s + 1].isspace())
        if b == len(text) and opens:
            out.append((s, b + 1))
            break
    return out


_OPENS = regex.compile("[" + regex.escape("".join(PAIRS)) + "]")


def _cascade(rules: list[Rule], last: str, known: dict[str, list[Rule]]) -> list[Rule]:
    """The rules of a table that can fit after the character ``last``."""
    found = known.get(last)
    if found is None:
        found = known[last] = [r for r in rules if r.ends is None or last in r.ends]
    return found


_BY_LAST: dict[str, dict[str, list[Rule]]] = {}


class _Paragraph:
    """text[a:b], which has no empty line, and what is known about it."""

    def __init__(self, text: str, a: int, b: int, scripts: _Scripts):
        self.text, self.a, self.b, self.scripts = text, a, b, scripts
        self.votes: _Votes | None = None
        self.all_votes: _Votes | None = None

    def marks(self) -> list[tuple[int, bool]]:
        """Positions, and whether each is a blank in Thai."""
        text, a, b = self.text, self.a, self.b
        spans = _spans(text, a, b)
        marks: list[tuple[int, bool]] = []
        k = 0
        m = MARK.search(text, a, b)
        while m is not None:
            end = m.end()
            while k < len(spans) and spans[k][1] <= m.start():
                k += 1
            if k < len(spans) and spans[k][0] < m.start():
                inner_end = spans[k][1] - 1
                if _SOLID.search(text, end, inner_end) is None:
                    marks.append((spans[k][1], False))
                    end = spans[k][1]
                # else: inside a quotation or bracket, which is protected
            else:
                while end < b and text[end] in CLOSING:
                    end += 1
                marks.append((end, False))
            m = MARK.search(text, end, b)
        if (thai := _THAI_LETTER.search(text, a, b)) is not None:
            gaps = [(g.start(), g.end()) for g in THAI_GAP.finditer(text, a, b)]
            edges = [(a, a), *gaps, (b, b)]
            beside = [thai.start() < y and _THAI_LETTER.search(text, x, y) is not None for (_, x), (y, _) in zip(edges, edges[1:])]
            j = 0
            for n, (x, _) in enumerate(gaps):
                while j < len(spans) and spans[j][1] <= x:
                    j += 1
                if not (j < len(spans) and spans[j][0] < x) and (beside[n] or beside[n + 1]):
                    marks.append((x, True))
            marks.sort()
        return marks

    def units(self) -> Iterator[tuple[int, int]]:
        text, b = self.text, self.b
        start, begin = self.a, self._first(self.a)
        marks = self.marks()
        for k, (at, thai) in enumerate(marks):
            if at <= start or at >= b or _SOLID.search(text, at, b) is None:
                continue
            if thai:
                breaks = next((r.breaks for r in THAI_RULES if (r.ends is None or text[at - 1] in r.ends) and r.fits(text, begin, at, b)), False)
            else:
                breaks = self._breaks(start, begin, at, marks, k)
            if breaks:
                yield start, at
                start, begin = at, self._first(at)
        yield start, b

    def _first(self, at: int) -> str:
        m = _SOLID.search(self.text, at, self.b)
        return m[0] if m else ""

    def _language(self, start: int, marks: list[tuple[int, bool]], k: int) -> str:
        """The language of the sentence around a mark, as far as the next mark that ends no abbreviation, else of the paragraph."""
        text, b = self.text, self.b
        if self.votes is None or self.votes.start != start:
            self.votes = _Votes(text, start)
        if self.votes.upto <= marks[k][0]:
            ahead = (marks[j][0] for j in range(k + 1, len(marks)) if not _maybe_abbreviated(text, marks[j][0]))
            self.votes.extend(next(ahead, b))
        if lang := self.votes.winner():
            return lang
        if self.all_votes is None:
            self.all_votes = _Votes(text, self.a)
            self.all_votes.extend(b)
        return self.all_votes.winner()

    def _breaks(self, start: int, begin: str, at: int, marks: list[tuple[int, bool]], k: int) -> bool:
        text, b = self.text, self.b
        script = self.scripts.at(at, start)
        last = text[at - 1]
        for r in _cascade(tables()[script], last, _BY_LAST.setdefault(script, {})):
            if r is not BY_LANGUAGE:
                if r.fits(text, begin, at, b):
                    return r.breaks
            elif last == "." and _maybe_abbreviated(text, at):
                here = language_tables()[self._language(start, marks, k)]
                if (found := next((x for x in here if x.fits(text, begin, at, b)), None)) is not None:
                    return found.breaks
        return True


def split(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every sentence unit, from its first to after its last non-blank character."""
    if not text:
        return []
    out = []
    at = 0
    scripts = _Scripts(text)
    edges = [(m.start(), m.end()) for m in BLANK_LINE.finditer(text)] + [(len(text), len(text))]
    for s, e in edges:
        for x, y in _Paragraph(text, at, s, scripts).units():
            while x < y and text[x].isspace():
                x += 1
            while y > x and text[y - 1].isspace():
                y -= 1
            if x < y:
                out.append((x, y))
        at = e
    return out


def sentence_units(documents: DataFrame) -> DataFrame:
    """doc_id, start_pos, end_pos of every unit of ``text``; rows that repeat give their units again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, starts, ends = [], [], []
            for i, text in zip(b["doc_id"], b["text"]):
                for s, e in split(text):
                    ids.append(i)
                    starts.append(s)
                    ends.append(e)
            yield pd.DataFrame({"doc_id": ids, "start_pos": starts, "end_pos": ends})

    rows = documents.select("doc_id", "text").where("text IS NOT NULL AND text <> ''")
    return rows.mapInPandas(run, "doc_id bigint, start_pos int, end_pos int")
