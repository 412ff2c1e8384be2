"""Personal information in free text, replaced by typed placeholders.

Regular expressions propose spans on a folded text (invisible characters dropped, full-width forms, separate marks and
look-alike letters brought to plain ones, each place knowing where it came from). Every proposal has a score by its
shape; checksum validators (Luhn, mod 97, mod 23, mod 11) raise it, words nearby raise or lower it. Spans of at least
`THRESHOLD` stay; where two overlap the better one does. Names need a first name and a surname: first names, surname
endings and full Chinese names are learned from all senders, in which people write their own.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgrain.llm.lookalikes import CYRILLIC, CYRILLIC_AS, GREEK, GREEK_AS, LATIN, LATIN_AS
from talkgrain.session import durable

THRESHOLD = 0.6
KINDS = ("email", "phone", "idnum", "address", "name")

# ---- folding

_PLAIN = re.compile(r"[\x20-\x7eÀ-ÖØ-öø-ÿŒœº°№Ѐ-ӿ一-鿿，。？！：；、（）“”‘’–—…\U0001f300-\U0001faff]*\Z")
_WORD = re.compile(r"[^\W\d_]+")
_TO_LATIN = str.maketrans(CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS)
_TO_CYRILLIC = str.maketrans(LATIN + GREEK, LATIN_AS + "".join(dict(zip(LATIN, LATIN_AS)).get(c, c) for c in GREEK_AS))
_CYR, _LAT, _GRK = re.compile(r"[Ѐ-ӿ]"), re.compile(r"[A-Za-zÀ-ɏ]"), re.compile(r"[Ͱ-Ͽ]")


def _unmix(m: re.Match) -> str:
    w = m[0]
    c, a, g = _CYR.search(w), _LAT.search(w), _GRK.search(w)
    if (c is not None) + (a is not None) + (g is not None) < 2:
        return w
    return w.translate(_TO_CYRILLIC if any("Ѐ" <= x <= "ӿ" and x not in CYRILLIC for x in w) else _TO_LATIN)


def fold(text: str) -> tuple[str, list[int] | None]:
    """Plain form of a text and, unless it equals the text, the place each character came from."""
    places = None
    if not _PLAIN.match(text):
        out: list[str] = []
        places = []
        for i, ch in enumerate(text):
            if ch < "\x7f":
                out.append(ch)
                places.append(i)
                continue
            cat = unicodedata.category(ch)
            if cat == "Cf" or ch == "️":
                continue
            if cat == "Mn" and out and len(both := unicodedata.normalize("NFC", out[-1] + ch)) == 1:
                out[-1] = both
                continue
            for x in ch if ch in "º°ª№…" else unicodedata.normalize("NFKC", ch):
                out.append(" " if x.isspace() else x)
                places.append(i)
        text = "".join(out)
    if _CYR.search(text) or _GRK.search(text):
        text = _WORD.sub(_unmix, text)
    return text, places


# ---- validators


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def mod97_nir(digits: str) -> bool:
    """French social security number with its two check digits."""
    return len(digits) == 15 and 97 - int(digits[:13]) % 97 == int(digits[13:])


def mod97_iban(text: str) -> bool:
    s = re.sub(r"\W", "", text).upper()
    return len(s) > 14 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def mod11_china(text: str) -> bool:
    """Chinese identity number: ISO 7064 MOD 11-2."""
    total = sum(int(d) * (2 ** (17 - k) % 11) for k, d in enumerate(text[:17]))
    return "10X98765432"[total % 11] == text[17].upper()


def mod23_spain(text: str) -> bool:
    s = re.sub(r"\W", "", text).upper()
    digits = {"X": "0", "Y": "1", "Z": "2"}.get(s[0], s[0]) + s[1:-1]
    return digits.isdigit() and "TRWAGMYFPDXBNJZSQVHLCKE"[int(digits) % 23] == s[-1]


def mod11_brazil(digits: str) -> bool:
    for n in (9, 10):
        r = sum(int(d) * (n + 1 - k) for k, d in enumerate(digits[:n])) * 10 % 11 % 10
        if r != int(digits[n]):
            return False
    return True


# ---- proposals

_EMAIL = re.compile(r"(?i)[a-z0-9][a-z0-9._%+-]*(?: ?@ ?| ?[(\[{]at[)\]}] ?)[a-z0-9-]+(?:(?:\.| ?[(\[{]dot[)\]}] ?)[a-z0-9-]+)*(?:\.| ?[(\[{]dot[)\]}] ?)[a-z]{2,}"
                    r"|(?:[a-z0-9][a-z0-9._%+-]* dot )*[a-z0-9][a-z0-9._%+-]* at [a-z0-9-]+(?: dot [a-z0-9-]+)+")
_AT = re.compile(r"[@＠]|[(\[{][aA][tT][)\]}]")
_SIX = re.compile(r"\d[^\d]{0,4}\d[^\d]{0,4}\d[^\d]{0,4}\d[^\d]{0,4}\d[^\d]{0,4}\d")
_NUMBER = re.compile(r"(?<![A-Za-zÀ-ÿА-яё0-9_#/@.])(?:\+ ?|v)?(?:\(\d{1,4}\)|[A-Z]{0,2}[ -]?\d)(?:[ .\-/]{0,3}(?:\(\d{1,4}\) ?)?(?:\d|№ ?(?=\d)|X(?=\d)))*(?: ?-?[A-Z](?![A-Za-z0-9_]))?(?![A-Za-z0-9_])")

# Shapes of numbers (9 a digit, A a letter), their kind, base score and validator.
_SHAPES: list[tuple[re.Pattern, str, float, object]] = [(re.compile(p + r"\Z"), kind, score, check) for p, kind, score, check in (
    (r"[A-Z]{2}\d{2} ?(?:\d{4} ?){3,7}\d{0,4}", "idnum", 0.3, mod97_iban),
    (r"[12] ?\d\d ?\d\d ?\d\d ?\d{3} ?\d{3} ?\d\d", "idnum", 0.5, lambda s: mod97_nir(re.sub(r"\D", "", s))),
    (r"\d{17}[\dXx]", "idnum", 0.6, mod11_china),
    (r"[XYZ]-?\d{7}-?[A-Z]", "idnum", 0.6, mod23_spain),
    (r"\d{8}-?[A-Z]", "idnum", 0.5, mod23_spain),
    (r"\d{3}\.\d{3}\.\d{3}-\d\d", "idnum", 0.6, lambda s: mod11_brazil(re.sub(r"\D", "", s))),
    (r"[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]", "idnum", 0.7, None),
    (r"[A-Z]\d{8}", "idnum", 0.4, None),
    (r"[A-Z]\d{3}[A-Z0-9]\d{4}[A-Z0-9]", "idnum", 0.5, None),
    (r"[A-Z]\d{2}[A-Z0-9]{6,7}", "idnum", 0.3, None),
    (r"\d{3}[- ]\d\d[- ]\d{4}", "idnum", 0.6, None),
    (r"\d{2} ?\d{2} ?№ ?\d{6}", "idnum", 0.7, None),
    (r"\d\d \d\d \d{6}", "idnum", 0.5, None),
    (r"\d{3}-\d{3}-\d{3} \d\d", "idnum", 0.6, None),
    (r"\+ ?\d[\d ().\-/]{7,20}", "phone", 0.8, None),
    (r"00\d[\d ().\-/]{8,16}", "phone", 0.5, None),
    (r"\(\d{2,4}\) ?\d{3,4}[- ]?\d{3,4}", "phone", 0.7, None),
    (r"1-\d{3}-\d{3}-\d{4}", "phone", 0.7, None),
    (r"0\d[\d \-/]{7,12}", "phone", 0.5, None),
    (r"0\d(?:[ .]\d\d){4}", "phone", 0.7, None),
    (r"8 ?\(?\d{3}\)? ?\d{3}[ -]?\d\d[ -]?\d\d", "phone", 0.4, None),
    (r"1\d{10}", "phone", 0.4, None),
    (r"\d{10}", "phone", 0.35, None),
    (r"\d{3} \d\d \d\d \d\d|\d{3} \d{3} \d{3}|[6-9]\d{8}", "phone", 0.35, None),
    (r"\d{3}[.\-]\d{3}[.\-]\d{4}", "phone", 0.6, None),
    (r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", "idnum", 0.1, lambda s: luhn(re.sub(r"\D", "", s))),
)]
# Words beside a number that speak for or against its being personal, by language.
_NEAR_WORDS = {
    "phone": {
        "en": r"call|text|phone|number|tel\b|mobile|reach|whatsapp|☎|📞", "de": "ruft|nummer|anruf|erreich|handy", "fr": "appelez|numéro|joindre",
        "es": "llám|número|teléf", "ru": "звон|номер|телефон", "zh": "电话|号码|手机|致电",
    },
    "idnum": {
        "en": r"passport|national id|identity|social|tax|ssn|\bid\b|\bno\.", "de": "ausweis|steuer", "fr": "pièce|identité|sécu",
        "es": r"pasaporte|identidad|\bdni\b|\bnie\b", "ru": "паспорт|удостовер|инн|снилс", "zh": "身份证|证件|护照",
    },
}
_NEAR = {kind: re.compile("(?i)" + "|".join(words.values())) for kind, words in _NEAR_WORDS.items()}
#: Tickets, orders, parcels, bills, versions, logs and references have numbers too.
_AGAINST_WORDS = {
    "en": r"ticket|order|parcel code|tracking|invoice|version|\blog\b|reference|see\s*$", "de": "auftrag|bestell|sendung|rechnung|protokoll|vorgang|siehe",
    "fr": "commande|colis (?:n|code)|le code|facture|journal|dossier|voir", "es": r"aviso|pedido|código|factura|registro|expediente|\bver\b",
    "ru": "заявк|заказ|посылк[аи] (?:n|код)|код|накладн|журнал", "zh": "工单|订单|单号|发票|日志|版本",
}
_AGAINST = re.compile("(?i)" + "|".join(_AGAINST_WORDS.values()))
_DATE = re.compile(r"(?:19|20)\d\d[-./]\d\d?[-./]\d\d?\Z|\d\d?[-./]\d\d?[-./](?:19|20)?\d\d\Z|\d+[/]\d+\Z|v[\d.]+\Z")

_STREET = re.compile(
    r"(?<![\w#-])\d{1,4}[a-z]?,? (?:[A-Z][\w’']+ ){1,3}(?i:street|st|road|rd|lane|ln|avenue|ave|drive|close|court|terrace|boulevard|blvd|square|gardens|crescent)\b\.?(?:,? (?i:apt|flat|unit) \d+\w?)?"
    r"|(?<![\w#])\d{1,4}(?: ?(?i:bis|ter))?,? (?i:rue|av\.|avenue|chemin|boulevard|bd|place|impasse|allée|quai|route|cours) (?:(?i:des?|du|la|les|de la) |(?i:d|l)[’'])*[A-ZÀ-Ý][\w’'-]+"
)
_STREET_LEFT = re.compile(
    r"[A-ZÄÖÜ][\wäöüß-]*(?i:straße|strasse|str\.|weg|gasse|platz|allee|damm|ufer|ring|graben|hof|kamp|bruch) ?\d{1,4}[a-z]?\b(?! (?i:minuten|stunden|mal|tage|uhr|weitere))"
    r"|\b(?i:(?:calle|avda\.|avenida|av\.|plaza|paseo|camino|ronda) |c/ ?)(?:[\wÀ-ÿ]+,? ){1,5}?(?i:n[º°o]\.? ?|núm\.? ?)?\d{1,4}\b"
)
#: A text with none of these holds no street of the two patterns above.
_STREET_HINTS = (" st", " road", " rd", " lane", " ln", " ave", " drive", " close", " court", " terrace", " boulevard", " blvd", " square", " gardens", " crescent", "rue ", "av. ", "chemin ", "bd ", "place ", "impasse ", "allée ", "quai ", "route ", "cours ")
_LEFT_HINTS = ("straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "damm", "ufer", "ring", "graben", "hof", "kamp", "bruch", "calle ", "avda.", "avenida", "av.", "plaza ", "paseo ", "camino ", "ronda ", "c/")
_STREET_DE = re.compile(r"\b(?i:am|an der|an den|im|in der|auf dem|auf der|zum|zur|unter den) [A-ZÄÖÜ][\wäöüß]+ \d{1,4}[a-z]?\b(?! (?i:minuten|stunden|mal|tage|uhr|weitere|andere))")
#: Words beside a German place that make it somebody's address.
_HOME_DE = ("wohn", "gezogen", "ziehe", "paket", "adresse", "anschrift", "liefer", "zuhause", "zu hause")
_STREET_RU = re.compile(r"(?i:\bул\.|\bулица|\bпр-т|\bпроспект|\bпр\.|\bпер\.|\bпереулок|\bпл\.|\bплощадь|\bшоссе|\bнаб\.) ?(?:[А-ЯЁа-яё-]+,? ){0,4}?[А-ЯЁа-яё-]+,? (?i:д\. ?|дом )?\d{1,4}(?:,? (?i:кв\.|корп\.) ?\d+)?"
                        r"|[А-ЯЁ][а-яёА-ЯЁ-]+(?: [А-ЯЁ][а-яёА-ЯЁ-]+)? (?i:ул\.|улица|пер\.|пр\.|проспект),? (?i:д\. ?|дом )?\d{1,4}(?:,? (?i:кв\.|корп\.) ?\d+)?")
_RU_HINTS = ("ул", "пр", "пер", "пл", "шоссе", "наб")
_STREET_ZH = re.compile(r"(?:(?![到寄在住搬址是])[一-鿿]){2,8}?(?:大街|街道|大道|胡同|路|街|巷|弄)\d{1,5}(?:号|弄)(?:\d{1,4}(?:单元|号楼|室|栋|楼))*")
_ZH_HINT = re.compile(r"[路街道巷弄同]\d")
_DIGIT = re.compile(r"\d")
_SURNAME = r"([^\W\d_]{2,}(?:[-’'][^\W\d_]{2,})?)"
_AFTER, _BEFORE = re.compile(rf"(?: [^\W\d_]\.)?(?: |, ){_SURNAME}"), re.compile(rf"{_SURNAME}, \Z")
#: A word that doesn't begin with a small letter: first names are written with a large one.
_FIRST = re.compile(r"(?<![\w@.+-])[^\W\d_a-zß-öø-ÿа-яё][^\W\d_]+(-[^\W\d_]{2,})?(?![\w@+])")
#: A hyphen inside a name, not one that begins a note.
_HYPHEN = re.compile(r"(?<=[^\W\d_][^\W\d_])-(?=[^\W\d_]{2})")
_HAN, _CYRILLIC_TEXT = re.compile(r"[一-鿿]"), re.compile(r"[А-я]")


@dataclass
class Names:
    """first names, surname endings and Chinese names, all folded and lower-cased.

    Chinese names: surnames, given names of two characters, and whole names whose given name has one.
    """

    first: set[str] = field(default_factory=set)
    endings: set[str] = field(default_factory=set)
    han_sur: set[str] = field(default_factory=set)
    han_given: set[str] = field(default_factory=set)
    han_whole: set[str] = field(default_factory=set)

    def forms(self) -> set[str]:
        """First names as they are written."""
        return {f for x in self.first for f in ("-".join(p.capitalize() for p in x.split("-")), x.upper())} if self.endings else set()

    def surname(self, s: str | None) -> bool:
        return bool(s) and s[0].isupper() and all(p[-3:].lower() in self.endings and p[0].isupper() for p in re.split(r"[-’']", s))


def parts(sender: str | None) -> list[tuple[str, str, str]]:
    """What a sender may tell of names: (west, first name, surname), (han, surname, given name of two) or (one, surname, given name of one)."""
    s = re.sub(r"\s*(?:[-|(<☎+].*|tel\b.*|no\..*|\d.*)$", "", _HYPHEN.sub("\0", fold(sender or "")[0])).strip().replace("\0", "-")
    if re.fullmatch(r"[一-鿿]{2,4}", s):
        return [("han", s[:-2], s[-2:])] * (len(s) > 2) + [("one", s[:-1], s[-1:])] * (len(s) < 4)
    m = re.fullmatch(r"([^\W\d_]{2,}(?:-[^\W\d_]{2,})?) (?:[^\W\d_]\. )?([^\W\d_]{2,}(?:-[^\W\d_]{2,})?)", s)
    return [("west", m[1].lower(), m[2])] if m and m[1][0].isupper() and m[2][0].isupper() else []


def learn(senders: list[str]) -> Names:
    """Names from senders: a first name is one seen with several surnames that few other first words have. `train` does the same by joins."""
    seconds, firsts = defaultdict(set), defaultdict(set)
    sur, given, one = defaultdict(set), defaultdict(set), set()
    for kind, a, b in {p for s in senders for p in parts(s)}:
        if kind == "west":
            seconds[a].add(b)
            firsts[b].add(a)
        elif kind == "han":
            sur[a].add(b)
            given[b].add(a)
        else:
            one.add((a, b))
    # a word that follows many first words of which most are followed by few others is a role, not a surname
    roles = {x for x, fs in firsts.items() if len(fs) >= 4 and 2 * sum(len(seconds[f]) >= 4 for f in fs) < len(fs)}
    out = Names()
    out.first = {f for f, xs in seconds.items() if len(xs - roles) >= 3}
    ends = defaultdict(set)
    for f in out.first:
        for x in seconds[f] - roles:
            for p in x.split("-"):
                ends[p[-3:].lower()].add((p, len(firsts[x])))
    out.endings = {e for e, xs in ends.items() if len({p for p, _ in xs}) >= 2 or any(n >= 3 for _, n in xs)}
    out.han_given = {g for g, x in given.items() if len(x) >= 2}
    out.han_sur = {s for s, x in sur.items() if len(x) >= 2}
    out.han_whole = {a + b for a, b in one if a in out.han_sur}
    return out


def train(df: DataFrame, sender: str = "sender") -> Names:
    """Learn names from all senders, as `learn` does; only the names that are kept come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [p for s in b.column(0).to_pylist() for p in parts(s)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["kind", "a", "b"])

    senders = df.select(F.col(sender).cast("string").alias("s")).where(F.length("s") > 1).distinct()
    told = durable(senders.mapInArrow(run, "kind string, a string, b string").distinct(), "sender-names")
    west, han, one = (told.where(F.col("kind") == k).drop("kind") for k in ("west", "han", "one"))
    seconds = west.groupBy("a").agg(F.count("*").alias("n"))
    firsts = west.join(seconds, "a").groupBy("b").agg(F.count("*").alias("n"), F.count(F.when(F.col("n") >= 4, 1)).alias("wide"))
    surnames = west.join(firsts.where((F.col("n") < 4) | (2 * F.col("wide") >= F.col("n"))).select("b", "n"), "b")
    first = surnames.groupBy("a").agg(F.count("*").alias("k")).where("k >= 3").select("a")
    ends = surnames.join(first, "a", "left_semi").select(F.explode(F.split("b", "-")).alias("p"), "n").groupBy(F.lower(F.right("p", F.lit(3))).alias("a")).agg(F.countDistinct("p").alias("k"), F.max("n").alias("n"))
    sur = han.groupBy("a").agg(F.count("*").alias("k")).where("k >= 2").select("a")
    kept = {
        "first": first, "endings": ends.where("k >= 2 OR n >= 3").select("a"), "han_sur": sur,
        "han_given": han.groupBy("b").agg(F.count("*").alias("k")).where("k >= 2").select(F.col("b").alias("a")),
        "han_whole": one.join(sur, "a", "left_semi").select(F.concat("a", "b").alias("a")),
    }
    out = Names()
    for r in reduce(DataFrame.unionByName, [d.select(F.lit(k).alias("kind"), "a") for k, d in kept.items()]).collect():
        getattr(out, r["kind"]).add(r["a"])
    return out


class Finder:
    def __init__(self, names: Names) -> None:
        self.names = names
        self.forms = names.forms()
        self.han = re.compile(f"[{''.join(sorted({x[0] for x in names.han_sur}))}]") if names.han_sur else None

    def spans(self, text: str, own_name: bool = False) -> list[tuple[str, int, int, float]]:
        """(kind, start, end, score) in the text as given; own_name: the text is a name by design, and numbers need no words nearby."""
        t, places = fold(text)
        got: list[tuple[float, int, int, str]] = []
        if _AT.search(t) or (" dot " in (d := t.lower()) and " at " in d):
            got += [(0.95, m.start(), m.end(), "email") for m in _EMAIL.finditer(t)]
        digits = _DIGIT.search(t) is not None
        if digits:
            low = t.lower()
            if _SIX.search(t):
                for m in _NUMBER.finditer(t):
                    s, lo = m[0].strip(" .-/"), m.start() + len(m[0]) - len(m[0].lstrip(" .-/"))
                    if sum(c.isdigit() for c in s) >= 6 and (hit := self._number(t, s, lo, own_name)):
                        got.append(hit)
            if any(h in low for h in _STREET_HINTS):
                got += [(0.85, m.start(), m.end(), "address") for m in _STREET.finditer(t)]
            if any(h in low for h in _LEFT_HINTS):
                got += [(0.85, m.start(), m.end(), "address") for m in _STREET_LEFT.finditer(t)]
            if any(h in low for h in _HOME_DE):
                got += [(0.8, m.start(), m.end(), "address") for m in _STREET_DE.finditer(t) if any(h in low[max(0, m.start() - 30) : m.end() + 25] for h in _HOME_DE)]
        if not t.isascii():
            if digits and _CYRILLIC_TEXT.search(t) and any(h in low for h in _RU_HINTS):
                got += [(0.85, m.start(), m.end(), "address") for m in _STREET_RU.finditer(t)]
            if _HAN.search(t):
                if digits and _ZH_HINT.search(t):
                    got += [(0.85, m.start(), m.end(), "address") for m in _STREET_ZH.finditer(t)]
                if self.han and not own_name:
                    got += self._han(t)
        if self.forms and not own_name:
            got += self._names(t)
        return _best(got, places) if got else []

    def _number(self, t: str, s: str, lo: int, own: bool) -> tuple[float, int, int, str] | None:
        if _DATE.match(s):
            return None
        before, after = t[max(0, lo - 32) : lo], t[lo + len(s) : lo + len(s) + 28]
        before = re.split(r"[.!?。！？] ?(?=\S)", before)[-1] if not re.search(r"(?:no|№|tel|n[º°])\. ?\Z", before) else before
        best = None
        forms = [s] + [s[:-2]] * (s[-2:-1] == " ") + [s.partition(" ")[2]] * s.partition(" ")[0].isalpha()
        for shape, kind, score, check in _SHAPES:
            for x in forms:
                if shape.match(x):
                    near = _NEAR[kind]
                    score += 0.3 * bool(check and check(x)) + 0.35 * bool(near.search(before) or near.search(after)) + 0.3 * (own and kind == "phone") + 0.2 * own
                    score -= 0.6 * bool(_AGAINST.search(before[-18:]))
                    if score >= THRESHOLD and (best is None or score > best[0]):
                        at = lo + s.index(x)
                        best = (score, at, at + len(x), kind)
                    break
        return best

    def _names(self, t: str) -> Iterator[tuple[float, int, int, str]]:
        for m in _FIRST.finditer(t):
            end = m.end()
            if m[0] not in self.forms:
                if not m[1] or m[0][: -len(m[1])] not in self.forms:
                    continue
                end -= len(m[1])
            after = _AFTER.match(t, end)
            if after and self.names.surname(after[1]):
                yield 0.8, m.start(), after.end(), "name"
            elif (before := _BEFORE.search(t, max(0, m.start() - 40), m.start())) and self.names.surname(before[1]):
                yield 0.75, before.start(), end, "name"

    def _han(self, t: str) -> Iterator[tuple[float, int, int, str]]:
        n, at = self.names, 0
        while m := self.han.search(t, at):
            i = m.start()
            size = next((k + 2 for k in (2, 1) if t[i : i + k] in n.han_sur and t[i + k : i + k + 2] in n.han_given), 0)
            size = size or next((k for k in (3, 2) if t[i : i + k] in n.han_whole), 0)
            if size:
                yield 0.8, i, i + size, "name"
            at = i + (size or 1)


def _best(got: list[tuple[float, int, int, str]], places: list[int] | None) -> list[tuple[str, int, int, float]]:
    out: list[tuple[str, int, int, float]] = []
    taken: list[tuple[int, int]] = []
    for score, lo, hi, kind in sorted(got, key=lambda g: (-g[0], g[1] - g[2], g[1])):
        if score < THRESHOLD or any(lo < b and a < hi for a, b in taken):
            continue
        taken.append((lo, hi))
        out.append((kind, places[lo] if places else lo, (places[hi - 1] + 1) if places else hi, min(score, 1.0)))
    return sorted(out, key=lambda s: s[1])


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    parts, at = [], 0
    for kind, lo, hi, _ in spans:
        parts += [text[at:lo], f"[{kind.upper()}]"]
        at = hi
    return "".join([*parts, text[at:]])


def mask(df: DataFrame, id_col: str, fields: list[str], names: Names, own: tuple[str, ...] = ("sender",)) -> DataFrame:
    """id, each field with placeholders, and <field>_spans: kind, start, end, score by place in the field as given.

    Fields in `own` hold the name of whoever wrote: names there are left. Null stays null, empty stays empty, texts of
    any length are read whole; rows are neither dropped nor merged, whatever their id.
    """
    sent = df.sparkSession.sparkContext.broadcast(Finder(names))
    src = df.select(F.col(id_col).alias("id"), *[F.col(c).cast("string").alias(f"t{k}") for k, c in enumerate(fields)])
    span = "array<struct<kind:string,start:int,end:int,score:double>>"
    schema = f"id {src.schema['id'].dataType.simpleString()}, " + ", ".join(f"o{k} string, s{k} {span}" for k in range(len(fields)))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder: Finder = sent.value
        for b in batches:
            cols: list[pa.Array] = [b.column(0)]
            for k, c in enumerate(fields):
                known: dict[str, tuple] = {}
                text, spans = [], []
                for t in b.column(1 + k).to_pylist():
                    if not t:
                        text.append(t)
                        spans.append([] if t == "" else None)
                        continue
                    if t not in known:
                        found = finder.spans(t, c in own)
                        known[t] = (redact(t, found) if found else t, [dict(zip(("kind", "start", "end", "score"), s)) for s in found])
                    text.append(known[t][0])
                    spans.append(known[t][1])
                cols += [pa.array(text, pa.string()), pa.array(spans, arrow)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", *[x for k in range(len(fields)) for x in (f"o{k}", f"s{k}")]])

    out = src.mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), *[x for k, c in enumerate(fields) for x in (F.col(f"o{k}").alias(c), F.col(f"s{k}").alias(f"{c}_spans"))])


def masked_messages(messages: DataFrame) -> DataFrame:
    return mask(messages, "row_id", ["content", "sender"], train(messages))


def found(messages: DataFrame) -> DataFrame:
    """(row_id, field, kind): kinds present in content and sender."""
    return kinds_found(masked_messages(messages), "row_id", ["content", "sender"])


def kinds_found(masked: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field, kind): each kind once of each field of `mask`'s rows; null and empty fields have none."""

    def each(name: str) -> Column:
        kinds = F.array_distinct(F.transform(F.coalesce(f"{name}_spans", F.array()), lambda s: s["kind"]))
        return F.transform(kinds, lambda k: F.struct(F.lit(name).alias("field"), k.alias("kind")))

    return masked.select(id_col, F.explode(F.flatten(F.array(*[each(c) for c in fields]))).alias("x")).select(id_col, "x.field", "x.kind")
