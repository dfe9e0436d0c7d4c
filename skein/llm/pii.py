"""Personal information in free text: found behind disguises, mapped back to the source, and replaced.

The text first runs through transducers that keep an offset for every character: width and style forms, letters of
other scripts inside Latin words, invisible characters and unusual blanks become plain, digits that are spelled out
become digits, and words or brackets that stand for the signs of a mailbox become those signs. Mailboxes, phone
numbers, identity numbers, street addresses and full names are then detected in the normalised text, and each span is
mapped back.

Full names are found without a list of names. Two capital words (with initials and particles, or surname, given name)
are scored: a word that a public vocabulary does not hold in lower case, an initial, a title or words that introduce a
person, a personal verb, and a mailbox, phone, identity number or address beside it speak for a person. Over a table,
words that stand often in such pairs and almost never beside sure signs of a person (names of products, say) are
counted over all texts, and pairs without a sure sign that hold such a word are dropped.

Defined cases: null and empty texts hold nothing; positions count the characters of the source from 1; line breaks
(with quote marks of the next line) may stand for any blank in a mention; mentions that overlap count once: an
identity number with its introducing word before all others, else the longer or, at the same length, the earlier type;
rows that repeat give repeated rows; without the vocabulary files every word counts as unusual.
"""

from __future__ import annotations

import base64
import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.lookalike import is_invisible, ordinary, shape_table
from skein.llm.tokens import TOKENIZERS
from skein.session import stage

def plain_letters(s: str) -> str:
    return "".join(c for c in ordinary_text(s).lower() if c.isalpha())


@lru_cache(100_000)
def ordinary_text(s: str) -> str:
    return "".join(ordinary(c)[:1] for c in s)


# ---------------------------------------------------------------- transducers

_WORD = re.compile(r"[^\W\d_]+")
_LATIN = re.compile("[A-Za-z]")
_SHAPES = shape_table()
_SHAPE_SET = frozenset(_SHAPES)
_DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9", "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9", "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9"}
_DW = "|".join(_DIGIT_WORDS)
_GAP = r"(?:[ \n,.\-/]*[()\[\]][ \n,.\-/]*|[ \n,.\-/]+)"
#: Digits of which at least one is a word; how many they are is counted afterwards.
_SPELLED = re.compile(rf"(?i)\b(?:(?:{_DW})|(?<!\w)\d{{1,5}}(?={_GAP}(?:{_DW})\b))(?:{_GAP}(?:(?:{_DW})\b|\d{{1,5}}\b(?!\.\d)))+")
_DIGIT_SET = frozenset(_DIGIT_WORDS)
_SPELLED_GATE = re.compile(rf"\b(?:{_DW})[ \n,.\-/()\[\]]+(?:(?:{_DW})\b|\d)|\d[ \n,.\-/()\[\]]+(?:{_DW})\b")
#: Fewest digits in a run that is rewritten; with fewer, words for numbers are ordinary words.
SPELLED_LEAST = 6
_DIGIT_TOKEN = re.compile(r"(?i)(?P<w>" + "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True)) + r")|\d+")


@lru_cache(65_536)
def _plain(c: str) -> str | None:
    """The plain form of a character if it differs in width, style or visibility only; None to keep it."""
    if is_invisible(c):
        return ""
    f = ordinary(c)
    if f and f != c and all(x.isascii() for x in f):
        return f
    return None


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def normalise(text: str, tokens: set[str]) -> tuple[str, list[int] | None, dict[int, int]]:
    """(text, source offset of each character; None if they are the same, source ends of digits that were words).

    `tokens` are the words of the text in lower case.
    """
    out, at = text, None
    ends: dict[int, int] = {}
    if not text.isascii():
        change = {c: p for c in set(text) if not c.isascii() and (p := _plain(c)) is not None}
        mixed = [] if _SHAPE_SET.isdisjoint(text) else [m for m in _WORD.finditer(text) if not m[0].isascii() and not _SHAPE_SET.isdisjoint(m[0]) and _LATIN.search(m[0])]
        if change or mixed:
            swap = {i: _SHAPES[text[i]] for m in mixed for i in range(m.start(), m.end()) if text[i] in _SHAPES}
            parts, at = [], []
            for i, c in enumerate(text):
                p = swap.get(i, change.get(c, c))
                parts.append(p)
                at += [i] * len(p)
            out = "".join(parts)
    if not _DIGIT_SET.isdisjoint(tokens if out is text else words_of(out)) and _SPELLED_GATE.search(out.lower()):
        parts, new, i = [], [], 0
        for m in _SPELLED.finditer(out):
            found = [w for w in _DIGIT_TOKEN.finditer(out, m.start(), m.end())]
            if sum(1 if w["w"] else len(w[0]) for w in found) < SPELLED_LEAST or (sum(bool(w["w"]) for w in found) < 6 and not any(not w["w"] for w in found)):
                continue
            at = at or list(range(len(out)))
            parts.append(out[i : m.start()])
            new += at[i : m.start()]
            last, word = m.start(), True
            for w in found:
                if w.start() > last and not (word and w["w"]):  # groups of digits keep what parts them
                    parts.append(out[last : w.start()])
                    new += at[last : w.start()]
                for j in range(1 if w["w"] else len(w[0])):
                    parts.append(_DIGIT_WORDS[w[0].lower()] if w["w"] else w[0][j])
                    ends[len(new)] = at[w.end() - 1 if w["w"] else w.start() + j] + 1
                    new.append(at[w.start() + (0 if w["w"] else j)])
                last, word = w.end(), bool(w["w"])
            i = m.end()
        if i:
            parts.append(out[i:])
            new += at[i:]
            out, at = "".join(parts), new
    return out, at, ends


# ---------------------------------------------------------------- detectors

#: A blank inside a mention: spaces, or one line break with the quote marks that open the next line.
_S = r"(?:[ \t\xa0]+|[ \t]*\r?\n[ \t]*(?:[>#*|+-]+[ \t]+)*)"
_LOCAL = r"[A-Za-z0-9_](?:[A-Za-z0-9_.+%\-]*[A-Za-z0-9_])?"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
_EMAIL = re.compile(rf"(?<![A-Za-z0-9_.+%@/\-]){_LOCAL}@{_LABEL}(?:\.{_LABEL})*\.[A-Za-z]{{2,}}(?![A-Za-z0-9@])(?!:[^\s])")
#: Writings of the signs of a mailbox: in brackets they always stand for the sign, as words only inside what becomes a mailbox.
_AT_SIGN = re.compile(rf"(?i)(?:{_S})?(?:[(\[{{<](?:at|a|@|arroba|chez)[)\]}}>]|[_-]at[_-])(?:{_S})?")
_DOT_SIGN = re.compile(rf"(?i)(?:{_S})?(?:[(\[{{<](?:dot|\.|punto|point|punkt)[)\]}}>]|[_-]dot[_-])(?:{_S})?")
_DOT_WORD = re.compile(rf"(?i)(?<=[A-Za-z0-9]){_S}(?:dot|punto|point|punkt|точка|ドット){_S}(?=[A-Za-z0-9])")
_AT_WORD = re.compile(rf"(?i)(?<=[A-Za-z0-9_]){_S}(?:at sign|at|arroba|chez|bei|kukac|собака|アット){_S}(?=(?P<host>{_LABEL}(?:\.{_LABEL})+))")
_LOCAL_WORD = re.compile(rf"(?i)(?<=[A-Za-z0-9]){_S}(?P<w>plus|underscore|dash|hyphen|minus){_S}(?=[A-Za-z0-9_.+%\-]+@)")
_LOCAL_SIGNS = {"plus": "+", "underscore": "_", "dash": "-", "hyphen": "-", "minus": "-"}


def mailbox_signs(text: str) -> tuple[str, list[int], set[int]]:
    """(text with @ and . for their writings, source offset of each character, places of the signs that were written)."""
    out, at, made = text, list(range(len(text))), set()

    def rewrite(rx: re.Pattern, sign, ok=lambda m: True) -> None:  # noqa: ANN001
        nonlocal out, at, made
        found = [m for m in rx.finditer(out) if ok(m)]
        if not found:
            return
        parts, new, i, moved, old = [], [], 0, set(), sorted(made)
        k = 0
        for m in found:
            while k < len(old) and old[k] < m.start():
                moved.add(len(new) + old[k] - i)
                k += 1
            parts += (out[i : m.start()], sign(m))
            new += at[i : m.start()]
            moved.add(len(new))
            new.append(at[m.start()])
            i = m.end()
        moved |= {len(new) + x - i for x in old[k:]}
        parts.append(out[i:])
        new += at[i:]
        out, at, made = "".join(parts), new, moved

    rewrite(_DOT_SIGN, lambda m: ".")
    rewrite(_DOT_WORD, lambda m: ".")
    rewrite(_AT_SIGN, lambda m: "@")
    # "at" is an ordinary word unless a dot of the host that follows was written out.
    dots = sorted(made)
    rewrite(_AT_WORD, lambda m: "@", lambda m: (j := bisect_left(dots, m.start("host"))) < len(dots) and dots[j] < m.end("host"))
    for _ in range(4):
        rewrite(_LOCAL_WORD, lambda m: _LOCAL_SIGNS[m["w"].lower()])
    return out, at, made


_D = r"[ .\-/\xa0\n]"
_PHONES = [
    re.compile(r"(?<![\w+])\+\d{1,3}(?:(?:[ .\-/\xa0]|[ \t]?\n[ \t]*(?:[>#*|]+[ \t]+)*)?\(?\d{1,8}+\)?){2,6}(?!\d)"),
    re.compile(r"(?<![\w.\-+/(])(?:1[ .\-])?(?:\([2-9]\d{2}\)[ \t]?\n?|[2-9]\d{2}[ .\-\n])[2-9]\d{2}[ .\-\n]\d{4}(?![\w]|[.\-]\d)"),
    re.compile(r"(?<![\w.\-+/(:])(?:\(0\d{1,4}\)|0\d{1,4})(?:[ .\-/\xa0\n]\d{2,8}){1,4}(?!\d|[.\-]\d)"),
    re.compile(r"(?<![\w.\-+/(:])00[1-9]\d{0,2}(?:[ .\-/]?\d{2,8}+){2,5}(?!\d)"),
]
_BARE_DIGITS = re.compile(r"(?<![\w.\-+/])\d{9,12}(?![\w]|[.\-]\d)")
_BARE_LEFT = re.compile(r"(?i)(?:phone|tel\.?|t[ée]l[ée]phone[zr]?|call(?:ed)?|text me|reach\w*|fax|mobile|cell|ring|llame|telefon\w*|tel[ée]fono)(?:[ \t\n]+(?:me|us|him|her|them|at|on|au|al|unter|is|number|no\.?|:))*[ \t\n:(]*$")
_EXT = re.compile(r"(?i)[ \t,]*(?:ext\.?|extension|x|#|durchwahl|poste)[ \t]*\d{1,5}(?!\d)")
_NOT_PHONE = re.compile(r"(?i)(?:batch|order|build|digest|version|commit|issue|port|line|step|lot|part|serial|isbn|pid|no\.|number of|steuer-id|ssn|#)[ \t\n]*(?:no\.?|nr\.?|number|#)?[ \t\n:]*$")

_IDS = [
    re.compile(r"(?<![\w.\-])(?P<v>\d{3}(?P<sep>[- \n])\d{2}(?P=sep)\d{4})(?![\w]|[.\-]\d)"),
    re.compile(r"(?i)(?:\bssn|social[ \t\n]+security(?:[ \t\n]+(?:number|no\.?))?|tax[ \t\n]+id(?:entification)?(?:[ \t\n]+(?:number|no\.?))?|\btin\b|\bitin\b)(?:[ \t\n]+is)?[ \t\n:#]*(?P<v>\d{3}[ \-.\n]?\d{2}[ \-.\n]?\d{4})(?!\d)"),
    re.compile(r"(?<![A-Za-z0-9])(?P<v>[A-Z]{2}[ \-\n]?\d{2}[ \-\n]?\d{2}[ \-\n]?\d{2}[ \-\n]?[A-D])(?![A-Za-z0-9])"),
    re.compile(r"(?i)\b(?:dni|nif|nie|documento(?:[ \t\n]+nacional)?)(?:[ \t\n]+(?:n[.º°o]*|n[úu]mero))?[ \t\n:]*(?P<v>(?:[XYZ][ \-\n]?\d{7}|\d{2}[. \n]?\d{3}[. \n]?\d{3})[ \-\n]?[A-Z])(?![A-Za-z0-9])"),
    re.compile(r"(?:(?i:passport|passeport|pasaporte|reisepass|passaporto|паспорт\w*|パスポート(?:番号)?|旅券番号))(?:[ \t\n]+(?:(?i:no\.?|nr\.?|number|num[ée]ro|n[º°]|is|of|nummer)))*[ \t\n:は]*(?P<v>[A-Z]{0,2}[ \-\n]?\d{3,4}[ \-\n]?\d{3,5})(?![A-Za-z0-9])"),
    re.compile(r"(?i)(?:steuer(?:identifikationsnummer|nummer|-?id(?:[ \-\n]?nr\.?|nummer)?)|\bidnr\.?)[ \t\n:]*(?P<v>\d{2}[ \-\n]?\d{3}[ \-\n]?\d{3}[ \-\n]?\d{3})(?!\d)"),
    re.compile(r"(?i)(?:s[ée]curit[ée][ \t\n]+sociale|num[ée]ro[ \t\n]+fiscal|\bnir|\binsee|\bspi)[ \t\n:]*(?:est[ \t\n]+)?(?:le[ \t\n]+)?(?P<v>\d(?:[ .\n]?\d){11,14})(?!\d)"),
    re.compile(r"(?i:снилс|инн|national[ \t\n]+(?:id(?:entity)?|insurance)(?:[ \t\n]+(?:number|no\.?|card))?|identity[ \t\n]+(?:number|card)|id[ \t\n]+card)(?:[ \t\n]+(?i:is))?[ \t\n:#]*(?P<v>(?=[A-Z0-9 \-]*\d{4})[A-Z0-9](?:[ \-\n]?[A-Z0-9]){6,14})(?![A-Za-z0-9])"),
]
#: What a text must hold in lower case before a pattern with an introducing word is tried on it.
_ID_MARKS = [(), ("ssn", "social", "tax", "tin"), (), ("dni", "nif", "nie", "documento"), ("pass", "pasa", "паспорт", "パスポート", "旅券"), ("steuer", "idnr"), ("curit", "fiscal", "nir", "insee", "spi"), ("снилс", "инн", "national", "identity", "id card")]
#: What a text must hold before mailboxes in words are sought in it.
_SPOKEN_DOTS = frozenset(("dot", "punto", "punkt", "point", "точка", "ドット"))
_SPOKEN_MARKS = ("[at", "(at", "{at", "<at", "[@", "(@", "{@", "<@", "[a]", "(a)", "{a}", "_dot_", "-dot-", "_at_", "-at-", "(.)", "[.]", "{.}", "(arroba", "[arroba")
_NOT_ID = re.compile(r"(?i)(?:batch|order|build|lot|version|commit|issue|part|serial|digest|ticket|release)[ \t\n]*(?:no\.?|nr\.?|number|#)?[ \t\n:]*$")

_CAP = r"[A-ZÀ-ÖØ-ÞŁŚŻ][\w'’\-]*"
_ADDRESSES = [
    re.compile(rf"(?<![\w.#/\-])(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|FLAT|APT|flat|apt){_S}\d{{1,4}}[A-Za-z]?,{_S})?\d{{1,5}}[A-Za-z]?{_S}(?:{_CAP}{_S}){{1,3}}(?:(?i:Street|St|Road|Rd|Avenue|Ave|Boulevard|Blvd|Lane|Ln|Close|Drive|Way|Court|Ct|Place|Square|Terrace|Crescent|Row|Gardens)\b\.?|Dr\.?(?=,))(?:,{_S}(?:Apt|Flat|Unit|Suite|#)\.?{_S}?\d+[A-Za-z]?)?(?:,{_S}[A-ZÀ-Þ][\w\-]+(?:(?:{_S}[A-ZÀ-Þ][\w\-]+)?(?:,{_S}[A-Z]{{2}})?{_S}\d{{5}}(?!\d))?)?"),
    re.compile(rf"(?<![\w.#/\-])(?<!\d[ \n])(?:{_CAP}{_S}){{1,2}}(?:Street|St|Road|Rd|Avenue|Ave|Boulevard|Blvd|Lane|Ln|Close|Drive|Terrace|Crescent|Gardens),?{_S}\d{{1,4}}[A-Za-z]?(?![\w.])(?:,{_S}[A-ZÀ-Þ][\w\-]+)?"),
    re.compile(rf"(?<![\w.#/\-])\d{{1,4}}(?:{_S}?(?:bis|ter|[a-d](?=[ ,])))?,?{_S}(?:rue|avenue|av\.|boulevard|bd|allée|place|chemin|impasse|quai|cours|route|square|passage){_S}(?:(?:de{_S}la|des|du|de|aux|au){_S}|de{_S}l['’]|d['’]|l['’])?{_CAP}(?:,{_S}\d{{5}}{_S}[A-ZÀ-Þ][\w\-]+)?"),
    re.compile(rf"(?<!\w)(?:Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Carrera|Camino|Ronda|Travesía|calle|avenida|plaza|paseo){_S}?(?:(?:de{_S}las|de{_S}los|de{_S}la|del|de){_S})?{_CAP}(?:{_S}{_CAP})?,?{_S}(?:n[.º°]+{_S}?)?\d{{1,4}}[A-Za-z]?(?!\d)(?:,{_S}\d{{5}}{_S}[A-ZÀ-Þ][\w\-]+)?"),
    re.compile(rf"(?<!\w)(?:[A-ZÄÖÜ][\wäöüß\-]*(?:straße|strasse|str\.|weg|platz|gasse|allee|ring|damm|ufer|hof|steig)|(?:Am|An{_S}der|Im|Zum|Zur|Auf{_S}dem){_S}{_CAP}|{_CAP}(?:{_S}|-)(?:Straße|Strasse|Weg|Platz|Allee)){_S}\d{{1,4}}{_S}?[a-z]?(?!\w)(?:,{_S}\d{{5}}{_S}[A-ZÄÖÜ][\w\-]+)?"),
    re.compile(rf"(?<!\w)(?:ул\.|улица|проспект|пр\.|пер\.|площадь){_S}[А-ЯA-Z][\w\-]+,?{_S}(?:д\.{_S}?)?\d{{1,4}}\w?"),
    re.compile(rf"(?<!\w)(?:via|viale|piazza|corso|Via|Viale|Piazza|Corso){_S}{_CAP}(?:{_S}{_CAP})?,?{_S}\d{{1,4}}(?!\d)"),
]

_UP = "A-ZÀ-ÖØ-ÞĀ-ŽŁŚŻ"
_LOW = "a-zß-öø-ÿā-žłśż"
#: Words (or endings of words) of which a text must hold one before an address pattern is tried on it.
_ADDRESS_WORDS = [
    (frozenset("street st road rd avenue ave boulevard blvd lane ln close drive dr way court ct place square terrace crescent row gardens".split()), ()),
    (frozenset("street st road rd avenue ave boulevard blvd lane ln close drive terrace crescent gardens".split()), ()),
    (frozenset("rue avenue av boulevard bd allée place chemin impasse quai cours route square passage".split()), ()),
    (frozenset("calle c avenida avda plaza paseo carrera camino ronda travesía".split()), ()),
    (frozenset("am an im zum zur auf straße strasse weg platz allee".split()), ("straße", "strasse", "str", "weg", "platz", "gasse", "allee", "ring", "damm", "ufer", "hof", "steig")),
    (frozenset("ул улица проспект пр пер площадь".split()), ()),
    (frozenset("via viale piazza corso".split()), ()),
]
_NAMEWORD = rf"[{_UP}][{_LOW}]+(?:['’][{_UP}]?[{_LOW}]+)?|[{_UP}]['’][{_UP}][{_LOW}]+|[{_UP}][{_UP}]+|(?:Mc|Mac|De|Di|Van|Le|La|O['’])[{_UP}][{_LOW}]+|[А-ЯЁ][а-яё]+|[Α-ΩΆ-Ώ][α-ωά-ώ]+"
_SURNAME = rf"(?:(?:van|von|de|der|den|del|della|di|da|dos|la|le|bin|al|el|zu|VAN|VON|DE){_S}){{0,2}}(?:{_NAMEWORD})(?:[\-‐‑](?:{_NAMEWORD}))*"
_GIVENNAME = rf"(?:{_NAMEWORD})(?:[\-‐‑](?:{_NAMEWORD}))?"
_INITIAL = rf"(?P<i>(?:{_S}[{_UP}]\.?(?=[ \t\n])){{0,2}})"
_NAME = re.compile(rf"(?<![\w@.\-/])(?P<g>{_GIVENNAME}){_INITIAL}{_S}(?P<s>{_SURNAME})(?![\w@/]|[\-.]\w)")
_REVERSE = re.compile(rf"(?<![\w@.\-/])(?P<s>{_SURNAME}),{_S}(?P<g>{_GIVENNAME})(?P<i>(?:{_S}[{_UP}]\.)?)(?![\w@/]|[\-]\w)")
#: What stands right before a person. Titles and introductions are sure signs of a person, requests and thanks good ones.
_SURE_BEFORE = re.compile(rf"(?i)(?:(?-i:(?<!\w)(?:Dr|DR|Mr|MR|Mrs|MRS|Ms|MS|Mx|Prof|PROF|Herr|HERR|Frau|FRAU|Monsieur|Madame|Mme|Mlle|Señora?|Sra?|Sir|Dame|Dipl)\.?)|\b(?:my{_S}name{_S}is|name{_S}is|ich{_S}heiße|je{_S}m['’]appelle|me{_S}llamo|меня{_S}зовут|this{_S}is|i{_S}am|i['’]m|(?:signed|written|reported|maintained|reviewed|approved|authored|filed|created){_S}by|(?:signed-off|co-authored|reviewed|reported)-by{_S}?:|(?:maintainers?|authors?|contact|owner|reviewer|ansprechpartner(?:in)?|kontakt|responsable|contacto|auteur|autor|name|full{_S}name|employee|patient|customer|автор|имя){_S}?:|author=|attn\.?:?|[\"']name[\"']{_S}?:|(?:kind{_S})?regards,|sincerely,|dear))[ \t]*[\"'\[]?{_S}?$")
_GOOD_BEFORE = re.compile(rf"(?i)\b(?:thanks{_S}to|thank{_S}you,?|cc:?|ask|called?|email(?:ed)?|met|with|assigned{_S}to|bundle{_S}to|(?:forward|send|return|write|report){_S}(?:(?:it|this|them){_S})?to|hi|hello|gehört|gehören|von{_S}frau|oder|fragen{_S}sie|adresse{_S}de|domicile{_S}de|por|para|de{_S}la{_S}parte{_S}de)[ \t]*{_S}?$")
#: The last words of all that may stand before a person; without one of them the patterns above are not tried.
_LEADING = frozenset(
    "dr mr mrs ms mx prof herr frau monsieur madame mme mlle señor señora sr sra sir dame dipl is heiße appelle llamo зовут am m by maintainer maintainers author authors contact owner reviewer ansprechpartner ansprechpartnerin kontakt responsable contacto auteur autor name employee patient customer автор имя attn regards sincerely dear "
    "to thank you cc ask call called email emailed met with hi hello gehört gehören oder sie de por para".split()
)
_LAST_WORD = re.compile(r"([^\W\d_]+)[^\w]*$")
_GOOD_AFTER = re.compile(rf"(?i){_S}?(?:,?{_S}?who\b|(?:has{_S}|have{_S}|had{_S})?(?:approved|asked|wrote|writes|said|says|signed|replied|confirmed|agreed|called|emailed|mailed|reported|reviewed|noted|thinks|told|met|joined|lives|lived|works|worked|resigned|visited|suggested|complained|apologi[sz]ed|paid|born|fragen|schrieb|sagte|wohnt|hat{_S}geschrieben|a{_S}(?:écrit|dit|signé|approuvé)|habite|dijo|escribió|firmó|vive|aprobó|сказал[аи]?|написал[аи]?)\b)")
#: What parts a name from another mention that belongs to it.
_BESIDE = re.compile(rf"(?i)(?:[ \t\n;,|:<(\[\]\"'>=#*+-]|mailto|tel\.?|phone|e-?mail|mail|reachable|at|on|is|of|de|del|von|gehört|attn\.?|gives|has|holds|and|my|number|no\.?|n°|passport|social|security|tax|id|le|el|est)*$")
BESIDE = 45
_LINKED = re.compile(r"[;,|:<(=]|[^\W\d_]")
_LISTED = re.compile(rf"(?:{_S})?(?:;|,|&|/|\||and|und|et|y)(?:{_S})?")
#: Words that stand with a capital but are no part of a name, whatever stands before them.
_NO_NAME = frozenset("the a an this that these those it its our my your his her their we i you he she they no not nothing do does did if when while before after once every each any some many most other and or but so as at by for from in into of on to with without since between under over above then first next please is are was were will has have had can may must should who which what where there here der die das ein eine le la les un une el los las und oder et ou y".split())
_NOUN_END = re.compile(r"(?:ung|heit|keit|schaft|tion|tät|ismus|ness|ción|sión|dad|ité|ware)$")
_JAPANESE = re.compile(r"(?:(?:氏名|名前|担当者?|連絡先|私は|署名)[はがも]?[:：\s]*(?P<a>[一-鿿々]{1,4}[ 　]?[一-鿿々ァ-ヶー]{1,4})(?![一-鿿々ァ-ヶー]))|(?<![一-鿿々])(?P<b>[一-鿿々]{1,3}[ 　][一-鿿々ぁ-んァ-ヶー]{1,4}|[一-鿿々]{3,5})(?=さん|様|氏(?!名))")
#: Score from which a pair is a name, by the number of its words that the vocabulary does not hold in lower case.
LEAST = {2: 2, 1: 3, 0: 5}
#: Score from which a name is surer than one that may share a word with it.
STRONG = 4
#: Public vocabularies of which the words in lower case are taken as ordinary words.
VOCABULARIES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")


@lru_cache(4)
def ordinary_words(folder: str = TOKENIZERS, names: tuple[str, ...] = VOCABULARIES) -> frozenset[str]:
    """Words that the public vocabularies hold whole and in lower case."""
    out = set()
    for name in names:
        path = os.path.join(folder, name)
        if os.path.isfile(path):
            with open(path, "rb") as f:
                out |= {t[1:] for line in f if (t := base64.b64decode(line.split()[0]).decode("utf-8", "ignore")).startswith(" ") and t[1:].isalpha() and t[1:].islower()}
    return frozenset(out)


@lru_cache(200_000)
def is_usual(word: str) -> bool:
    """Is a word an ordinary word that a capital does not turn into a name?"""
    low = word.lower()
    return low in ordinary_words() or bool(_NOUN_END.search(low))


@lru_cache(200_000)
def name_words(part: str) -> tuple[str, ...]:
    """The capital words of a given name or surname, plain and in lower case."""
    return tuple(x.lower() for x in re.split(r"[\s\-‐‑>#*|+]+", part) if x and not x[0].islower())


def _names(text: str, others: list[tuple[int, int, str]]) -> list[tuple[int, int, int, bool, tuple[str, str]]]:
    """(start, end, score, sure, (given name, surname)) of the full names, not overlapping; `others` are the sorted other mentions."""
    cand, close = [], []
    begins, finishes = [o[0] for o in others], sorted((o[1], o[0]) for o in others)
    for start in _START.finditer(text):
        tries = [(False, _NAME.match(text, start.start()))]
        if start["comma"]:
            lead = _PARTICLES.search(text, max(0, start.start() - 24), start.start())
            tries.append((True, _REVERSE.match(text, start.start())))
            if lead:  # the particle may belong to the surname or to what stands before the name
                tries.append((True, _REVERSE.match(text, lead.start())))
        for reverse, m in tries:
            if not m:
                continue
            g, s = m["g"], m["s"]
            gw, sw = name_words(g), name_words(s)
            if not gw or not sw or len(sw[-1]) < 2 or len(gw[0]) < 2 or not _NO_NAME.isdisjoint(gw + sw) or any(w in _ADDRESS_WORDS[0][0] for w in sw):
                continue
            if g.isupper() != s.isupper():
                continue
            begin, end = m.start("s" if reverse else "g"), m.end()
            left = text[max(0, begin - 40) : begin]
            unusual = (not all(map(is_usual, gw))) + (not all(map(is_usual, sw)))
            led = (w := _LAST_WORD.search(left)) is not None and w[1].lower() in _LEADING
            sure = led and _SURE_BEFORE.search(left) is not None
            if not unusual and not sure:
                continue
            score = unusual + 3 * sure
            if led and not sure and _GOOD_BEFORE.search(left):
                score += 2
            if m["i"]:
                score += 1
            if _GOOD_AFTER.match(text, end):
                score += 2
            i = bisect_left(begins, end)
            j = bisect_left(finishes, (begin + 1,)) - 1
            if (i < len(begins) and begins[i] - end <= BESIDE and _BESIDE.match(text[end : begins[i]])) or (j >= 0 and begin - finishes[j][0] <= BESIDE and _BESIDE.match(gap := text[finishes[j][0] : begin]) and _LINKED.search(gap)):
                score += 3
                sure = True
            if g.isupper() and not sure and (re.search(r"[A-Z]{2,}[ \n]$", left) or re.match(r"[ \n][A-Z]{2,}", text[end : end + 4])):
                continue  # two of many words in capitals
            if score >= LEAST[unusual] + reverse:
                cand.append((begin, end, score, sure, (gw[0], sw[-1])))
            elif score == LEAST[unusual] + reverse - 1:
                close.append((begin, end, score, sure, (gw[0], sw[-1])))
    for m in _JAPANESE.finditer(text):
        k = "a" if m["a"] else "b"
        cand.append((m.start(k), m.end(k), 4, True, ("", "")))
    cand.sort(key=lambda c: (not c[3], -c[2], c[0]))
    strong = [c for c in cand if c[3] or c[2] >= STRONG]
    weak = [c for c in cand if not (c[3] or c[2] >= STRONG)]
    out: list = []
    spans: list[tuple[int, int]] = []
    # One that falls just short is a name in a list with another; beside a strong one it comes before weak ones.
    for group, listed in ((strong, False), (sorted(close), True), (weak, False), (sorted(close), True)):
        for c in group:
            i = bisect_left(spans, (c[0], c[1]))
            if (i < len(spans) and spans[i][0] < c[1]) or (i and spans[i - 1][1] > c[0]):
                continue
            if not listed or (i and _LISTED.fullmatch(text[spans[i - 1][1] : c[0]])) or (i < len(spans) and _LISTED.fullmatch(text[c[1] : spans[i][0]])):
                spans.insert(i, (c[0], c[1]))
                out.append(c)
    return sorted(out)


_CAPITAL = rf"[{_UP}А-ЯЁΑ-Ω]"
#: A capital word before another, perhaps behind a comma, initials or particles.
_START = re.compile(rf"(?<![\w@.\-/]){_CAPITAL}(?=[\w'’‐‑\-]*+(?P<comma>,?)[\s>#*|+\-]{{1,12}}+(?:{_CAPITAL}|(?:van|von|de|der|den|del|della|di|da|dos|la|le|bin|al|el|zu)\b))")
_PARTICLES = re.compile(rf"(?<![\w@.\-/])(?:(?:van|von|de|der|den|del|della|di|da|dos|la|le|bin|al|el|zu){_S}){{1,2}}$")
_IDEOGRAPH = re.compile("[一-鿿々]")


def detect(text: str, tokens: set[str]) -> list[tuple[int, int, str, bool, tuple[str, str] | None]]:
    """(start, end, type, sure, words of a name) of the mentions in normalised text with these words, in order, not overlapping."""
    hits: list[tuple[int, int, str]] = []
    if "@" in text:
        for m in _EMAIL.finditer(text):
            if text[max(0, m.start() - 3) : m.start()] != "://" and not text.startswith("git@", m.start()):
                hits.append((m.start(), m.end(), "email"))
    low = text.lower()
    if not _SPOKEN_DOTS.isdisjoint(tokens) or any(k in low for k in _SPOKEN_MARKS):
        signs, at, made = mailbox_signs(text)
        places = sorted(made)
        for m in _EMAIL.finditer(signs) if made else ():
            i = bisect_left(places, m.start())
            if i < len(places) and places[i] < m.end():
                hits.append((at[m.start()], at[m.end() - 1] + 1, "email"))
    first: list[tuple[int, int, str]] = []
    if _DIGITS.search(text):
        for rx, mark in zip(_PHONES, ("+", "", "", "00"), strict=True):
            for m in rx.finditer(text) if mark in text else ():
                n = sum(c.isdigit() for c in m[0])
                if 9 <= n <= 15 and not _NOT_PHONE.search(text[max(0, m.start() - 40) : m.start()]):
                    end = _cut(m[0], m.start())
                    x = _EXT.match(text, end)
                    hits.append((m.start(), x.end() if x else end, "phone"))
        for run in _BARE_DIGITS.finditer(text):
            if _BARE_LEFT.search(text[max(0, run.start() - 60) : run.start()]):
                hits.append((run.start(), run.end(), "phone"))
        for rx, marks in zip(_IDS, _ID_MARKS, strict=True):
            for m in rx.finditer(text) if not marks or any(k in low for k in marks) else ():
                if not _NOT_ID.search(text[max(0, m.start("v") - 40) : m.start("v")]):
                    (first if marks else hits).append((m.start("v"), m.end("v"), "id_number"))
    for rx, (whole, ends) in zip(_ADDRESSES, _ADDRESS_WORDS, strict=True):
        near = not whole.isdisjoint(tokens) or (ends and any(t.endswith(ends) for t in tokens))
        for m in rx.finditer(text) if near else ():
            hits.append((m.start(), m.end(), "address"))
    named: dict[tuple[int, int], tuple[bool, tuple[str, str]]] = {}
    if _START.search(text) or _IDEOGRAPH.search(text):
        for s, e, _, sure, words in _names(text, sorted({*hits, *first})):
            hits.append((s, e, "name"))
            named[s, e] = (sure, words)
        # A bare number in a record, next to the field with a full name, is a number of that person.
        for (s, _), (_, _) in list(named.items()):
            if m := _RECORD.search(text, max(0, s - 20), s):
                first.append((m.start("v"), m.end("v"), "id_number"))
                named[s, next(e for b, e in named if b == s)] = (True, named[s, next(e for b, e in named if b == s)][1])
    # An identity number behind its introducing word comes before all else, then the longer mention.
    hits.sort(key=lambda h: (-(h[1] - h[0]), h[0]))
    taken: list[tuple[int, int]] = []
    out = []
    for s, e, kind in first + hits:
        i = bisect_left(taken, (s, e))
        if (i < len(taken) and taken[i][0] < e) or (i and taken[i - 1][1] > s):
            continue
        taken.insert(i, (s, e))
        sure, words = named.get((s, e), (True, None)) if kind == "name" else (True, None)
        out.append((s, e, kind, sure, words))
    return sorted(out)


_RECORD = re.compile(r"(?<![\w.\-+/])(?P<v>\d{3}[ \-.\n]?\d{2}[ \-.\n]?\d{4}|\d{9,11})[ \t]*[;|\t][ \t]*$")
_DIGITS = re.compile(r"\d(?:[ .\-/()\n]{0,3}\d){5}")


def _cut(number: str, start: int) -> int:
    """The end of a phone number: countries of fixed length do not take up digits that follow."""
    need = {"+1": 11, "+33": 11, "+34": 11, "+44": 12}
    for lead, n in need.items():
        if number.startswith(lead) and not (lead == "+1" and number[2:3].isdigit() and False):
            extra = number.count("(0)")
            seen = 0
            for i, c in enumerate(number):
                seen += c.isdigit()
                if seen == n + extra:
                    return start + i + 1
    return start + len(number.rstrip(" .-/\n("))


def mentions_of(text: str | None) -> list[tuple[int, int, str, bool, tuple[str, str] | None]]:
    """(start, end, type, sure, words of a name) of the mentions in the source text."""
    if not text:
        return []
    tokens = words_of(text)
    plain, at, ends = normalise(text, tokens)
    spans = detect(plain, tokens if plain is text else words_of(plain))
    if at is None:
        return spans
    return [(at[s], ends.get(e - 1, at[e - 1] + 1), *rest) for s, e, *rest in spans]


def find(text: str | None, things: frozenset[str] = frozenset()) -> list[tuple[int, int, str]]:
    """(start, end, type) of the mentions; names without a sure sign that hold one of `things` are left out."""
    return [(s, e, kind) for s, e, kind, sure, words in mentions_of(text) if sure or things.isdisjoint(words)]


def replace(text: str | None, things: frozenset[str] = frozenset()) -> str | None:
    """The text with a placeholder of its type for each mention."""
    if not text:
        return text
    out, at = [], 0
    for s, e, kind in find(text, things):
        out += (text[at:s], f"<{kind.upper()}>")
        at = e
    return "".join([*out, text[at:]])


# ---------------------------------------------------------------- over tables

#: A word is a thing, not a person, if pairs with it are at least THING_ROWS, and a THING_PART of all pairs, and at most
#: THING_SHARE of them have a sure sign of a person. As pairs have two words, there are at most 2 / THING_PART such words.
THING_ROWS, THING_PART, THING_SHARE = 30, 1e-5, 0.05


def candidates(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, pii_type, start_pos, length, sure, given, surname): the mentions before names of things are left out, staged."""
    kind = docs.schema[doc].dataType.simpleString()
    names = ["doc", "pii_type", "start_pos", "length", "sure", "given", "surname"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, s + 1, e - s, sure, *(words or (None, None))) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for s, e, k, sure, words in mentions_of(t)]
            kinds = [b.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).mapInArrow(run, f"doc {kind}, pii_type string, start_pos bigint, length bigint, sure boolean, given string, surname string")
    return stage(rows, "pii-candidates")


def thing_words(found: DataFrame) -> DataFrame:
    """(word): the words of candidates that name things, at most 2 / THING_PART."""
    per = found.filter("given <> ''").select("sure", F.explode(F.array("given", "surname")).alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.count_if("sure").alias("k"))
    total = found.agg(F.count_if(F.col("given") != "").alias("total"))
    return per.crossJoin(F.broadcast(total)).filter((F.col("n") >= THING_ROWS) & (F.col("n") >= F.col("total") * THING_PART) & (F.col("k") + 1 <= (F.col("n") + 2) * THING_SHARE)).select("word")


def mentions(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, pii_type, start_pos, length): every mention."""
    found = candidates(docs, doc, text)
    things = F.broadcast(thing_words(found))  # bounded by THING_PART
    unsure = found.filter("not sure").join(things.withColumnRenamed("word", "given"), "given", "left_anti").join(things.withColumnRenamed("word", "surname"), "surname", "left_anti")
    columns = ["doc", "pii_type", "start_pos", "length"]
    return found.filter("sure").select(columns).unionByName(unsure.select(columns))


def redact(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, text): every text with its mentions replaced. The texts are read twice and never shuffled."""
    kind = docs.schema[doc].dataType.simpleString()
    things = frozenset(r["word"] for r in thing_words(candidates(docs, doc, text)).collect())  # bounded by THING_PART
    shared = docs.sparkSession.sparkContext.broadcast(things)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([replace(t, shared.value) for t in b.column(1).to_pylist()], pa.string())], names=["doc", "text"])

    return docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).mapInArrow(run, f"doc {kind}, text string")
