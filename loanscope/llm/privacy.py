"""Operator 9: personal data replaced by keyed surrogates.

Detected entities (mail addresses, secrets of a known form or after a word such as
``password:``, network addresses, bank and card numbers, phone numbers, names after a
title) receive surrogates of the same type:

* Numbers, secrets and mail addresses go through a keyed permutation of all strings
  of the same format: every character is mapped within its own class (digits, hex
  digits, letters of one script and case), everything else keeps its place.  Being a
  permutation it maps different entities to different surrogates.  Numbers are
  mapped in their canonical form, so one number in two layouts keeps one surrogate,
  and a number with a valid Luhn digit, a private address or a country code gives
  another such.
* Names become names of the same gender (told by the title), script and form: given
  names from lists, surnames built from syllables, both drawn by key; initials stay
  initials, hyphens and particles (``van der``) their place.  These are not a permutation.
  A name is up to four words after its titles, with inner capitals, apostrophes and
  hyphens, each after any initials and particles, or as many words in capitals.

Mentions are linked inside each text before anything is drawn: a surname after a title
to the latest person of that surname and gender (the next one if none came before), a
title without gender to the same name with one, a number without country code to the
same number with it.  Full names, surnames and given names of a detected person are
also found without a title; a single such word that the text has in lower case too is
left, as it may be a common word.  Across texts names are one entity if they agree as
linked, title's gender included.

The same entity always has the same surrogate: it depends on the key and on the
canonical entity alone.  Collision checks then run over the distinct entities of the
whole table: of entities with the same surrogate all but the smallest, and every
entity whose surrogate is itself an entity of the table, are drawn again with the
next attempt until all surrogates are distinct and none is real.  A format may be too
small for that (192.168.x.x has 65,536 addresses): after ``ROUNDS`` attempts in its own
format an entity gets one of a wider format, one character longer with every further
attempt (private addresses: 10.x.x.x, then IPv6; other addresses: IPv6), so an
exhausted format widens and the rounds always end.  Only the entities
with an attempt above 0 have to be known when texts are rewritten.  They go to the
tasks by broadcast up to ``BROADCAST`` of them; beyond that they are joined to the
texts that hold them.

Null texts stay null, texts without entities stay as they are; repeated rows are
rewritten alike; an empty table gives no rows; other columns are kept or ignored.
"""

from __future__ import annotations

import contextlib
import hashlib
import hmac
import ipaddress
import re
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import REMEMBERED, fresh, map_arrow, slices, staged, table

KEY = b"surrogate-key"
#: Entities drawn again that are broadcast at most; more are joined.
BROADCAST = 50_000
#: Attempts in an entity's own format; later ones are in wider formats.
ROUNDS = 10

TITLES = {"m": ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Signor"),
          "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Señorita", "Signora"),
          "n": ("Dr", "Prof")}
GIVEN = {("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Nils Oscar Paul Rafael Simon Thomas Victor".split(),
         ("latin", "f"): "Anna Berta Clara Diana Emma Flora Gloria Helena Irene Julia Karin Laura Maria Nora Olga Paula Rosa Sofia Teresa Vera".split(),
         ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Максим Олег".split(),
         ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Ксения Мария Нина Ольга Софья".split()}
#: Surnames are a start, one or two middles and an end.
SYLLABLES = {
    "latin": ("Al An Ar Bal Ban Bar Bel Ben Ber Bor Bran Bren Cal Can Car Col Cor Dal Dan Dor Fal Far Fer Fol Gal Gar Ger Gil Gor Hal Han Har Hel Hol "
              "Jan Jar Kal Kan Kar Kel Kor Lam Lan Lar Lin Lor Mal Man Mel Mor Nal Nar Nor Ol Or Pal Par Pel Por Ral Ran Ros Sal San Sel Sol Tal Tan Tar "
              "Tor Val Var Ver Vol Wal Wan Wel Wol Zan Zel".split(),
              "ba be bi da de di do ga ge ka ke ki la le li lo ma me mi na ne ni no ra re ri ro sa se si ta te ti to va ve vi".split(),
              "berg born dal der din feld gard han ker lan lin ling man mer mont nard nell ner nik rell ren rick rin sen ser son stad ston tell ter tin ton vell wick".split()),
    "cyrillic": ("Ан Бар Бел Бон Вер Вол Гал Гор Дар Дор Жар Зор Кал Кар Ков Кол Лан Лес Мал Мар Мель Мор Нар Нов Ор Пал Пет Рад Ром Сав Сал Сол Тал Тар Тим Хар Чер Шев".split(),
                 "ба бо ва ве го да де ди жи за ка ко ла ле ли ма ми на ни но ра ре ри ро са си та ти то".split(),
                 "бенко вец венко вич ганов дин ёнок кин ков ленко лин лов мин нец ник нов ренко рин ров сенко син тов чук шин".split())}
PARTICLES = "van von vom der den de del della degli di da do dos das du des la le los las ten ter zu zum zur af av bin ibn al el".split()

# Upper and lower letters of the scripts that have both, combining marks with the lower.
_CASED = [chr(c) for c in (*range(0x41, 0x530), *range(0x1E00, 0x2000))]
_UP, _LOW = "".join(filter(str.isupper, _CASED)), "".join(filter(str.islower, _CASED)) + "\u0300-\u036f"
_LOW_END = rf"[{_UP}{_LOW}'’\-]*[{_LOW}]"
_WORD_NAME = rf"(?:[dDlL]['’]|(?:al|el|ben)-)?[{_UP}]{_LOW_END}"
_CAPS = rf"[{_UP}][{_UP}'’\-]*[{_UP}](?![{_LOW}])"
_INITIALS = rf"(?:[{_UP}]\. ?)*"
_PARTICLE = rf"(?:(?:{'|'.join(PARTICLES)}) )*"
#: Particles that may stand first after a title; the others are articles there.
_LEADING = r"(?:(?:van|von|vom|de|del|della|degli|di|da|do|dos|das|du|ten|ter|zu|zum|zur|af|av|bin|ibn)(?: de[rnl]?| las?| los| le)? )?"
_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_TITLES = rf"(?:(?:{_TITLE})\.? )+"
_NAME = (rf"(?:{_INITIALS}{_LEADING}{_WORD_NAME}(?: {_INITIALS}{_PARTICLE}(?!(?:{_TITLE})\b){_WORD_NAME}){{0,3}}"
         rf"|{_INITIALS}{_CAPS}(?: {_INITIALS}{_CAPS}){{0,3}})")
#: Words that announce a secret of any form.
_KEYED = r"(?i:password|passwd|passphrase|pwd|api[_\- ]?key|access[_\- ]?key|secret(?:[_\- ]?access)?(?:[_\- ]?key)?|(?:auth|access)?[_\-]?token)[\"']?(?: ?[:=]+ ?| is )[\"']?|Bearer "
_VALUE = r"(?![\w.+\-]+@[\w\-]+\.\w)(?=[^\s\"',;<>]*\d)(?=[^\s\"',;<>]*[A-Za-z])[0-9A-Za-z_\-+/=.~!@#$%^&*]{7,}[0-9A-Za-z_\-+/=~!@#$%^&*]"
#: What a token keeps: the prefix that tells its issuer.
_ISSUER = re.compile(r"(?P<sure>gh[pousr]_|github_pat_|glpat-|A[KS]IA|AIza|xox[abeoprs]-|hf_|npm_|pypi-|SG\.|ya29\.|eyJ)"
                     r"|(?:[spr]k|ghp)(?:[_\-](?:live|test|proj|ant|or|svcacct|admin|v\d|api\d\d)(?=[_\-]))*[_\-]?")
_TOKENS = (r"[spr]k[_\-][0-9A-Za-z_\-]{15,}[0-9A-Za-z]|(?:sk|pk|ghp|AKIA)[_\-]?[0-9A-Za-z]{16,64}|gh[pousr]_[0-9A-Za-z]{16,}"
           r"|github_pat_[0-9A-Za-z_]{20,}|glpat-[0-9A-Za-z_\-]{20,}|A[KS]IA[0-9A-Z]{16}|AIza[0-9A-Za-z_\-]{35}|xox[abeoprs]-[0-9A-Za-z\-]{10,}"
           r"|hf_[0-9A-Za-z]{30,}|npm_[0-9A-Za-z]{30,}|pypi-[0-9A-Za-z_\-]{50,}|SG\.[0-9A-Za-z_\-]{16,}\.[0-9A-Za-z_\-]{16,}|ya29\.[0-9A-Za-z_\-]{20,}"
           r"|eyJ[0-9A-Za-z_\-]{8,}\.[0-9A-Za-z_\-]{8,}(?:\.[0-9A-Za-z_\-]{8,})?")
_H = "[0-9A-Fa-f]{1,4}"
_V4 = r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_V6 = (rf"(?:(?:{_H}:){{6}}|(?:{_H}(?::{_H}){{0,5}})?::(?:{_H}:){{0,5}}){_V4}|(?:{_H}:){{7}}{_H}"
       rf"|(?:{_H}(?::{_H}){{0,6}})?::(?:{_H}(?::{_H}){{0,6}})?")
#: Numbers in pairs: after a country code, after a trunk zero, nine digits, Russian trunk 8.
_PAIRS = (r"(?:\+|00)\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{1,4}(?:[ .\-]\d{2,4}){2,5}"
          r"|0\d{1,3}(?P<gap>[ .\-])\d{2,3}(?:(?P=gap)\d{2}){2,3}|0\d{1,3}/\d{2,3}(?:[ .]\d{2}){2,3}"
          r"|(?:[6-9]\d{2}(?P<of>[ .\-])\d{2}|[2-9]\d(?P<to>[ .\-])\d{3})(?:(?(of)(?P=of)|(?P=to))\d{2}){2}"
          r"|8[ \-]?\(?\d{3}\)?[ \-]\d{3}[ \-]\d{2}[ \-]\d{2}")
#: One pattern, alternatives in order of precedence.
PATTERN = re.compile(
    r"(?P<mail>[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)+)"
    r"|(?P<secret>(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|" + _TOKENS + r")(?![0-9A-Za-z]))"
    r"|(?P<keyed>(?<![0-9A-Za-z])(?:" + _KEYED + ")" + _VALUE + r")"
    r"|(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z]))"
    r"|(?P<ipv6>(?<![\w:.])(?:" + _V6 + r")(?![\w:]|\.\d))"
    r"|(?P<ip>(?<![\d.])" + _V4 + r"(?![\d]|\.\d))"
    r"|(?P<card>(?<![\d])(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3}(?:[ \-]\d{1,3})?|\d{4}[ \-]\d{6}[ \-]\d{5})(?![\d]))"
    r"|(?P<ssn>(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .\-]\d{3,4}[ .\-]?\d{3,4}(?![\w])|(?<![\w+])\+\d{8,15}(?![\w])"
    r"|(?<![\w+.,:/\-])(?:" + _PAIRS + r")(?![\w]|[.,:/\-]\d))"
    r"|(?P<name>(?<![\w])" + _TITLES + _NAME + r")")
_PLAIN = re.compile(r"\d{2,4}[ .\-]\d{3,4}[ .\-]?\d{3,4}")
_QUICK = re.compile(r"[\d@]|[spr]k[_\-]|gh[pousr]_|github_pat_|glpat-|A[KS]IA|AIza|xox|hf_|npm_|pypi-|SG\.|ya29|eyJ|(?:" + _TITLE + r")\.? \w")

_TITLED = re.compile(_TITLES)
_ANNOUNCED = re.compile(_KEYED)
_BARE = re.compile(r"(?<![\w'’\-])[^\W\d_]+")
_AFTER = re.compile(r"(?![\w]|[\-'’](?!s\b)\w)")
_OWNED = re.compile(r"['’]s?(?= |$)")
#: A number's part that its surrogate keeps: country code and trunk zero.
_COUNTRY = re.compile(r"(?P<code>\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}))?0?")

_CLASSES = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àâäáãåæçèéêëìíîïñòóôõöøœùúûüýÿß",
            "ÀÂÄÁÃÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØŒÙÚÛÜÝŸ", "абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
            "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
_HEX = ["0123456789abcdef", "0123456789ABCDEF"]


def _alphabets(text: str, classes: list[str]) -> list[str | None]:
    return [next((a for a in classes if c in a), None) for c in text]


def _number(key: bytes, *parts) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), hashlib.sha256).digest(), "big")


def permute(text: str, key: bytes, tweak: str, classes: list[str] | None = None) -> str:
    """Keyed permutation of the strings with the format of ``text``: a Feistel
    network over its characters' numbers, halves added modulo their ranges."""
    alphabets = _alphabets(text, classes or _CLASSES)
    places = [i for i, a in enumerate(alphabets) if a]
    form = "".join(a[0] if a else c for a, c in zip(alphabets, text))
    halves = places[:len(places) // 2], places[len(places) // 2:]
    value, size = [0, 0], [1, 1]
    for k in (0, 1):
        for i in halves[k]:
            value[k] = value[k] * len(alphabets[i]) + alphabets[i].index(text[i])
            size[k] *= len(alphabets[i])
    for r in range(8):
        k = r % 2
        value[k] = (value[k] + _number(key, tweak, form, r, value[1 - k])) % size[k]
    out = list(text)
    for k in (0, 1):
        v = value[k]
        for i in reversed(halves[k]):
            v, d = divmod(v, len(alphabets[i]))
            out[i] = alphabets[i][d]
    return "".join(out)


def _walk(text: str, key: bytes, tweak: str, fits) -> str:
    """The permutation repeated until the result is of the same kind: again a
    permutation, of the strings of that kind."""
    while True:
        text = permute(text, key, tweak)
        if fits(text):
            return text


def luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (c > "4")) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit() and c.isascii())


def _lay(digits: str, like: str) -> str:
    """``digits`` in the layout of ``like``; those of a wider format at its end."""
    it = iter(digits)
    return "".join([next(it) if c.isascii() and c.isdigit() else c for c in like] + list(it))


def canonical(kind: str, text: str) -> str:
    """What the entity is, whatever its layout."""
    if kind in ("card", "ssn"):
        return _digits(text)
    if kind == "phone":
        digits = _digits(text)
        if digits.startswith("00") and len(digits) >= 10:
            return "+" + digits[2:]
        return ("+" if text.startswith("+") else "") + digits
    if kind == "iban":
        return text.replace(" ", "")
    if kind == "mail":
        return text.lower()
    if kind == "ip" and ":" in text:
        return ipaddress.IPv6Address(text).compressed
    if kind == "name":
        titles = _TITLED.match(text)[0]
        rest = text[len(titles):]
        if rest.isupper():
            rest = " ".join(w.lower() if w.lower() in PARTICLES else w.title() for w in rest.split(" "))
        return f"{_gender(titles)}|{rest}"
    return text


def _gender(titles: str) -> str:
    """The gender the titles tell, ``n`` if none does."""
    told = [next(g for g, ts in TITLES.items() if t.rstrip(".") in ts) for t in titles.split()]
    return next((g for g in told if g != "n"), "n")


def _parted(name: str) -> tuple[str, str]:
    """(given names and initials, surname with its particles)."""
    words = name.split(" ")
    at = next((i for i, w in enumerate(words[:-1]) if w.lower() in PARTICLES), len(words) - 1)
    return " ".join(words[:at]), " ".join(words[at:])


def surname(script: str, number: int, middles: int = 1) -> str:
    """Surname of a number; the first ``starts * middles ** n * ends`` differ in form."""
    starts, mids, ends = SYLLABLES[script]
    out = []
    for part in (starts, *[mids] * middles, ends):
        number, i = divmod(number, len(part))
        out.append(part[i])
    return "".join(out)


def _mapped_ip6(text: str, key: bytes, tweak: str) -> str:
    """Another address of the same scope: link-local, unique local, mapped IPv4, else the first three bits."""
    n = int(ipaddress.IPv6Address(text))
    fixed = next((b for b, net in ((10, 0x3FA), (7, 0x7E), (96, 0xFFFF)) if n >> (128 - b) == net), 3)
    bits = 128 - fixed
    low = bits // 2
    a, b = (n & ((1 << bits) - 1)) >> low, n & ((1 << low) - 1)
    for r in range(8):
        if r % 2:
            a = (a + _number(key, tweak, "ipv6", fixed, r, b)) % (1 << (bits - low))
        else:
            b = (b + _number(key, tweak, "ipv6", fixed, r, a)) % (1 << low)
    return ipaddress.IPv6Address(n >> bits << bits | a << low | b).compressed


def _mapped_ip(text: str, key: bytes, tweak: str) -> str:
    if ":" in text:
        return _mapped_ip6(text, key, tweak)
    n = int.from_bytes(bytes(map(int, text.split("."))), "big")
    fixed = next((b for b, net in ((8, 10), (8, 127), (12, 0xAC1), (16, 0xC0A8)) if n >> (32 - b) == net), 0)
    bits = 32 - fixed
    low, high = bits // 2, bits - bits // 2
    private = lambda x: any(x >> (32 - b) == net for b, net in ((8, 10), (8, 127), (12, 0xAC1), (16, 0xC0A8)))
    x = n & ((1 << bits) - 1)
    while True:
        a, b = x >> low, x & ((1 << low) - 1)
        for r in range(8):
            if r % 2:
                a = (a + _number(key, tweak, "ip", fixed, r, b)) % (1 << high)
            else:
                b = (b + _number(key, tweak, "ip", fixed, r, a)) % (1 << low)
        x = a << low | b
        if fixed or not private(x):
            return ".".join(map(str, ((n >> bits << bits) | x).to_bytes(4, "big")))


def _wider_ip(text: str, key: bytes, tweak: str, wide: int) -> str:
    """An address outside the format of ``text``: a private one in 10.0.0.0/8 at
    first, then in fd00::/8; a public one in the documentation's 2001:db8::/32."""
    draw, old = _number(key, tweak, "wide", text), ipaddress.ip_address(text)
    if not (old.is_private or old.is_link_local):
        return ipaddress.IPv6Address(0x20010DB8 << 96 | draw % (1 << 96)).compressed
    if old.version == 4 and wide <= 3:
        return str(ipaddress.IPv4Address(10 << 24 | draw % (1 << 24)))
    return ipaddress.IPv6Address(0xFD << 120 | draw % (1 << 120)).compressed


def surrogate(kind: str, entity: str, attempt: int = 0, key: bytes = KEY) -> str:
    """Surrogate of a canonical entity, itself canonical."""
    tweak, wide = f"{kind}|{attempt}", max(0, attempt - ROUNDS + 1)
    pad = "0" * wide  # a longer format, of which the entity is one string
    if kind == "ip":
        return _wider_ip(entity, key, tweak, wide) if wide else _mapped_ip(entity, key, tweak)
    if kind == "card":
        valid = luhn(entity)
        return _walk(entity + pad, key, tweak, lambda s: luhn(s) == valid)
    if kind == "phone":
        # The country code is not in the tweak: with and without it the number stays one.
        cut = _COUNTRY.match(entity).end()
        return entity[:cut] + _walk(entity[cut:] + pad, key, tweak, lambda s: (s[:1] == "0") == (entity[cut:cut + 1] == "0"))
    if kind == "ssn":
        return permute(entity + pad, key, tweak)
    if kind == "iban":
        return entity[:2] + permute(entity[2:] + pad, key, tweak + entity[:2])
    if kind == "secret":
        hexa = next((a for a in _HEX if set(entity) <= set(a)), None)
        if hexa:
            return permute(entity + pad, key, tweak, [hexa])
        issuer = _ISSUER.match(entity)
        head = issuer[0] if issuer and any(any(c in a for a in _CLASSES) for c in entity[issuer.end():]) else ""
        return head + permute(entity[len(head):] + pad, key, tweak + head)
    if kind == "mail":
        local, domain = entity.rsplit("@", 1)
        name, end = domain.rsplit(".", 1)
        # The local part is permuted on its own: no other local part of the domain gets its surrogate.
        return f"{permute(local + pad, key, tweak + '@' + domain)}@{permute(name, key, 'domain' + end)}.{end}"
    gender, name = entity.split("|", 1)
    script = "cyrillic" if re.match("[Ѐ-ӿ]", name) else "latin"
    draw = _number(key, tweak, name if gender == "n" else entity)
    given = GIVEN[script, gender] if gender != "n" else GIVEN[script, "m"] + GIVEN[script, "f"]

    def drawn(size: int) -> int:
        nonlocal draw
        draw, i = divmod(draw, size)
        return i

    def family() -> str:  # later attempts: longer ones
        return surname(script, drawn(1 << 40), 1 + (attempt > 0))

    givens, own = _parted(name)
    parts = ["".join(given[drawn(len(given))][0] + "." for _ in range(w.count("."))) if "." in w
             else "-".join(given[drawn(len(given))] for _ in w.split("-")) for w in givens.split(" ") if w]
    parts += [w if w.lower() in PARTICLES and k + 1 < len(own.split(" ")) else
              "-".join(family() for _ in range(1 + w.count("-") + (wide if k + 1 == len(own.split(" ")) else 0)))
              for k, w in enumerate(own.split(" "))]
    return f"{gender}|" + " ".join(parts)


def _national(number: str) -> str:
    """Digits of a number with country code, without it."""
    return number[_COUNTRY.match(number).end("code"):]


def _shown(kind: str, found: str, entity: str, made: str) -> str:
    """The canonical surrogate in the layout of the text found."""
    if kind == "phone" and entity.startswith("+"):
        digits, old, new = _digits(found), _national(entity), _national(made)
        for lead in ("", "0"):
            if digits == lead + old and not found.startswith("+"):
                return _lay(lead + new, found)
        return _lay(("00" if digits.startswith("00") else "") + _digits(made), found)
    if kind in ("card", "ssn", "phone"):
        return _lay(_digits(made), found)
    if kind == "iban":
        it = iter(made)
        return "".join([c if c == " " else next(it) for c in found] + list(it))
    if kind == "mail":
        return "".join(m.upper() if f.isupper() else m for f, m in zip(found, made)) if len(found) == len(made) else made
    if kind == "name":
        title = _TITLED.match(found)
        title, old, new = title[0] if title else "", entity.split("|", 1)[1], made.split("|", 1)[1]
        name, same = found[len(title):], lambda a, b: a.casefold() == b.casefold()
        if not same(name, old):  # a part of the name: the same part
            (givens, family), (new_givens, new_family) = _parted(old), _parted(new)
            new = new_family if same(name, family) else new_givens if same(name, givens) else new_givens.split(" ")[0]
        return title + (new.upper() if name.isupper() and len(name) > 1 else new[0].upper() + new[1:] if name[0].isupper() else new)
    return made


def _real(kind: str, found: str) -> bool:
    """Whether what the pattern found is an entity."""
    if kind == "iban":
        return sum(c.isdigit() for c in found) >= 10
    if kind == "ip" and ":" in found:  # not '::', '::1', nor steps of slices such as 1::2
        groups = [g for g in found.split(":") if g]
        with contextlib.suppress(ValueError):
            ipaddress.IPv6Address(found)
            return any(c.isdigit() for c in found) and (len(groups) >= 3 or len(found.split(":")[0]) == 4 or "." in found)
        return False
    if kind == "phone":  # short ones without a sign are pairs such as 01 02 03 04
        n = len(_digits(found))
        return n <= 15 + 2 * found.startswith("00") and (n >= 9 or found[0] in "+(" or bool(_PLAIN.fullmatch(found)))
    if kind == "secret":
        if re.match(r"[spr]k[_\-]", found):
            return bool(re.search(r"[0-9A-Za-z]{16}", found[3:])) or all(re.search(c, found[3:]) for c in ("[0-9]", "[a-z]", "[A-Z]"))
        return bool(re.search(r"\d", found) or (m := _ISSUER.match(found)) and m["sure"])
    return True


def entities(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, canonical entity, from, to) of each entity, in order."""
    if not text or not _QUICK.search(text):
        return []
    out = []
    for m in PATTERN.finditer(text):
        kind, found = m.lastgroup, m.group()
        kind, start, end = "ip" if kind == "ipv6" else kind, m.start(), m.end()
        if kind == "keyed":
            kind, start = "secret", start + _ANNOUNCED.match(found).end()
            found = text[start:end]
        elif not _real(kind, found):
            continue
        if kind == "name":
            head = _TITLED.match(found).end()
            if owned := _OWNED.search(found, head + 1):
                end, found = m.start() + owned.start(), found[:owned.start()]
        out.append((kind, canonical(kind, found), start, end))
    return _linked_names(text, _linked_phones(out))


def _linked_phones(found: list[tuple]) -> list[tuple]:
    """Numbers without country code as the same number with it, if the text has that."""
    whole: dict[str, str] = {}
    for kind, e, *_ in found:
        if kind == "phone" and e.startswith("+"):
            for as_written in (_national(e), "0" + _national(e), e[1:]):
                whole.setdefault(as_written, e)
    if not whole:
        return found
    return [(k, whole.get(e, e) if k == "phone" else e, a, b) for k, e, a, b in found]


def _linked_names(text: str, found: list[tuple]) -> list[tuple]:
    """Name mentions as the persons they mean, mentions without a title added."""
    titled = [(*e.split("|", 1), a, b) for k, e, a, b in found if k == "name"]
    if not titled:
        return found
    part = lambda name: _parted(name)[1]
    genders: dict[str, set] = {}  # of each name as written
    for g, name, _, _ in titled:
        genders.setdefault(name, set()).update({g} - {"n"})
    families: dict[str, list] = {}
    for name in genders:
        if _parted(name)[0]:
            families.setdefault(part(name), []).append(name)
    for family, names in families.items():  # a gender known from 'title surname' alone
        open_ = [n for n in names if not genders[n]]
        told = genders.get(family, set()).difference(*(genders[n] for n in names))
        if len(open_) == 1 and len(told) == 1:
            genders[open_[0]] |= told
    persons = {name: [(g, name) for g in sorted(genders[name]) or ["n"]] for name in genders}

    # Words and full names that stand for a person without a title.
    forms: dict[str, str] = {}  # as it may be written -> the name or part it is
    for name in genders:
        givens, family = _parted(name)
        for form in (name, family, givens, givens.split(" ")[0]):
            if len(form) > 1 and not form.endswith("."):
                for written in (form, form[0].upper() + form[1:], form.upper()):
                    forms.setdefault(written, form)
    begins: dict[str, list] = {}
    for written in sorted(forms, key=len, reverse=True):
        begins.setdefault(re.match(r"[^\W\d_]+", written)[0], []).append(written)
    spots = [(a, b) for _, _, a, b in found]
    bare, i, last, common = [], 0, 0, None
    for m in _BARE.finditer(text):
        a = m.start()
        if m[0] not in begins or a < last:
            continue
        written = next((w for w in begins[m[0]] if text.startswith(w, a) and _AFTER.match(text, a + len(w))), None)
        if not written:
            continue
        while i < len(spots) and spots[i][1] <= a:
            i += 1
        end = a + len(written)
        if i < len(spots) and spots[i][0] < end:
            continue
        if " " not in written:
            if common is None:
                common = set(re.findall(r"[^\W\d_]+", text))
            if written.lower() in common:
                continue
        bare.append(("", forms[written], a, end))
        last = end

    # In the text's order: the latest person a mention fits, else the first to come.
    first: dict[tuple, tuple] = {}
    latest: dict[tuple, tuple] = {}

    def ways(person):
        g, name = person
        givens, family = _parted(name)
        yield from {("name", name), ("name", name, g), ("part", family), ("part", family, g), ("given", givens or name), ("given", (givens or name).split(" ")[0])}

    for name in genders:
        if _parted(name)[0] or not families.get(name):
            for person in persons[name]:
                for way in ways(person):
                    first.setdefault(way, person)
    linked = []
    for at, (g, name, a, b) in enumerate(sorted(titled + bare, key=lambda x: x[2])):
        by = "name" if _parted(name)[0] and (g or name in genders) else "part"
        fits = [(by, name, x) for x in ((g, "n") if g in ("m", "f") else ())] or [(by, name)]
        if not g and by == "part":
            fits.append(("given", name))
        seen = max((latest[w] for w in fits if w in latest), default=None)
        person = seen[1] if seen else next((first[w] for w in fits if w in first), (g or "n", name))
        for way in ways(person):
            latest[way] = (at, person)
        linked.append(("name", "|".join(person), a, b))
    return sorted([x for x in found if x[0] != "name"] + linked, key=lambda x: x[2])


@lru_cache(maxsize=100_000)
def _cached(kind: str, entity: str, attempt: int, key: bytes) -> str:
    return surrogate(kind, entity, attempt, key)


REMEMBERED.append(_cached.cache_clear)


def rewrite(text: str | None, attempts: dict, key: bytes = KEY) -> tuple[str | None, int]:
    """(text with surrogates, entities found); ``attempts``: by (kind, entity)."""
    found = entities(text) if text else []
    if not found:
        return text, 0
    out, at = [], 0
    for kind, entity, a, b in found:
        made = _cached(kind, entity, attempts.get((kind, entity), 0), key)
        out += [text[at:a], _shown(kind, text[a:b], entity, made)]
        at = b
    return "".join([*out, text[at:]]), len(found)


def distinct_entities(df: DataFrame, text_col: str) -> DataFrame:
    """(kind, entity) of the whole table, each once."""
    def build():
        def step(b):
            for _, texts in slices(b, 0):
                got = {(k, e) for t in texts for k, e, _, _ in entities(t)}
                if got:
                    kinds, names = zip(*sorted(got))
                    yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(names, pa.string())], names=["kind", "entity"])
        return step

    return map_arrow(df.select(F.col(f"`{text_col}`").alias("text")), build, "kind string, entity string").distinct()


def redrawn(names: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, entity, attempt) of the entities whose first surrogate collides.  Ends,
    as formats widen without bound from attempt ``ROUNDS`` on."""
    def build():
        def step(b):
            made = [surrogate(k, e, a, key) for k, e, a in zip(*(b.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=["kind", "entity", "attempt", "made"])
        return step

    names = staged(names, "entities")
    now = names.withColumn("attempt", F.lit(0))
    while True:
        now = staged(map_arrow(now, build, "kind string, entity string, attempt int, made string"), "surrogates")
        # Who keeps a surrogate several entities have: the one settled earliest, then the smallest.
        holder = now.groupBy("kind", "made").agg(F.min(F.struct("attempt", "entity")).alias("_keep"), F.count("*").alias("_n"))
        shared = (now.join(holder.where("_n > 1"), ["kind", "made"])
                     .where(F.struct("attempt", "entity") != F.col("_keep")).select("kind", "entity"))
        real = now.join(names.select("kind", F.col("entity").alias("made")), ["kind", "made"], "left_semi").select("kind", "entity")
        again = staged(shared.unionByName(real).distinct(), "collisions")
        if not again.limit(1).count():
            break
        now = now.join(again.withColumn("_again", F.lit(1)), ["kind", "entity"], "left").select(
            "kind", "entity", (F.col("attempt") + F.coalesce("_again", F.lit(0))).alias("attempt"))
    return now.where("attempt > 0").select("kind", "entity", "attempt")


def pseudonymised(df: DataFrame, text_col: str, key: bytes = KEY, broadcast_rows: int = BROADCAST,
                  count_col: str | None = None) -> DataFrame:
    """``df`` with surrogates in its texts and, if named, the count of entities."""
    again = staged(redrawn(distinct_entities(df, text_col), key), "redrawn")
    text, counted = F.col(f"`{text_col}`"), count_col or fresh(df, "_entities_")
    few = again.limit(broadcast_rows + 1).count() <= broadcast_rows  # a checked size; the join takes the rest
    pair, rows = fresh(df, "_rewritten_"), df
    if few:
        attempts = {(k, e): a for k, e, a in again.collect()}

        @F.pandas_udf("text string, n long")
        def replaced(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([rewrite(t, attempts, key) for t in texts], columns=["text", "n"])

        rows = df.withColumn(pair, replaced(text))
    else:
        mine, spare = fresh(df, "_attempts_"), fresh(df, "_key_")

        @F.pandas_udf("array<struct<kind: string, entity: string>>")
        def listed(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: [{"kind": k, "entity": e} for k, e in sorted({x[:2] for x in entities(t)})])

        @F.pandas_udf("text string, n long")
        def replaced_with(texts: pd.Series, known: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([rewrite(t, {(x["kind"], x["entity"]): x["attempt"] for x in (() if k is None else k)}, key)
                                 for t, k in zip(texts, known)], columns=["text", "n"])

        code = F.struct(F.xxhash64(F.lit(1), text), F.xxhash64(F.lit(2), text))
        held = (df.select(code.alias(spare), text.alias("t")).dropDuplicates([spare])
                  .select(spare, F.explode(listed("t")).alias("x")).select(spare, "x.kind", "x.entity")
                  .join(again, ["kind", "entity"]).groupBy(spare)
                  .agg(F.collect_list(F.struct("kind", "entity", "attempt")).alias(mine)))  # of one text
        rows = df.withColumn(spare, code).join(held, spare, "left").withColumn(pair, replaced_with(text, F.col(mine)))
    out = rows.withColumn(text_col, F.col(f"{pair}.text")).withColumn(counted, F.col(f"{pair}.n"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *([F.col(counted)] if count_col else []))


def op9_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymised(docs, "text", count_col="n_entities")
