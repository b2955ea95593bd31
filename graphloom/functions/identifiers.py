"""Identifier detection: typed, canonicalised spans of a text, overlaps resolved by priority.

A detector is a pattern and a function from its match to a canonical form (None rejects the match). All run in
one Arrow pass over a batch, because which span wins depends on all of them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Priorities of overlap resolution, by type.
PRIORITY = {
    "PhoneNumber": 100, "Email": 100, "INN": 100, "OGRN": 100, "BIC": 100, "SNILS": 100, "BankAccount": 100, "KPP": 100, "IBAN": 100,
    "IMEI": 95, "MACAddress": 95, "LicensePlate": 95, "VIN": 95, "UUID": 95, "CreditCard": 92,
    "ContractNumber": 90, "PostalAddress": 90, "DocumentDate": 90, "Amount": 90,
    "TelegramHandle": 80, "VKProfile": 80, "TwitterHandle": 80, "InstagramHandle": 80, "LinkedInProfile": 80, "YouTubeChannel": 80, "GitHubProfile": 80,
    "URL": 50, "Domain": 10,
}
# Control weights of tax numbers, accounts and vehicle numbers.
INN10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN11 = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12 = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
VIN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)
VIN_VALUES = dict(zip("ABCDEFGHJKLMNPRSTUVWXYZ", (1, 2, 3, 4, 5, 6, 7, 8, 1, 2, 3, 4, 5, 7, 9, 2, 3, 4, 5, 6, 7, 8, 9), strict=True))
# Stems of Russian month names, in order.
MONTH_STEMS = ("янв", "фев", "мар", "апр", "ма[йя]", "июн", "июл", "авг", "сен", "окт", "ноя", "дек")
SCALES = {"тыс": 10**3, "млн": 10**6, "млрд": 10**9}
# Top-level domains that make a bare host name a domain.
TLDS = frozenset(
    "com net org io ai dev co uk de fr ru su by ua kz uz am az ge kg tj tm md rs pl cz sk lt lv ee fi se no dk nl be at ch es pt it gr ie "
    "edu gov mil info biz name pro tv me app tech cloud online site store shop blog team ws tg us ca cn jp kr in br tr id th vn mx ar cl ng za il ae sa eu xyz".split()
)
# First parts of addresses at GitHub that are nobody's profile.
GITHUB_RESERVED = frozenset(
    "marketplace topics trending collections events settings notifications issues pulls search explore login join about pricing features enterprise team customer-stories security".split()
)
#: First parts of addresses at Twitter that are nobody's profile.
TWITTER_RESERVED = frozenset("i search home".split())


def _dot(weights, digits: str) -> int:
    return sum(w * int(d) for w, d in zip(weights, digits, strict=False))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def inn(d: str) -> bool:
    if len(d) == 10:
        return _dot(INN10, d) % 11 % 10 == int(d[9])
    return len(d) == 12 and _dot(INN11, d) % 11 % 10 == int(d[10]) and _dot(INN12, d) % 11 % 10 == int(d[11])


def ogrn(d: str) -> bool:
    return len(d) in (13, 15) and int(d[:-1]) % (11 if len(d) == 13 else 13) % 10 == int(d[-1])


def snils(d: str) -> bool:
    s = _dot(range(9, 0, -1), d) % 101
    return (0 if s == 100 else s) == int(d[9:11])


def iban(x: str) -> bool:
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def vin(x: str) -> bool:
    value = lambda c: int(c) if c.isdigit() else VIN_VALUES.get(c, 0)
    check = sum(w * value(c) for w, c in zip(VIN_WEIGHTS, x, strict=True)) % 11
    return x[8] == ("X" if check == 10 else str(check))


def account_fits(account: str, bic: str) -> bool:
    """Control of a 20-digit account under a bank's code: its own digits 7-1-3 weighted, after the bank's or the centre's tail."""
    tails = (bic[-3:], "0" + bic[4:6])
    return any(sum(int(c) * (7, 1, 3)[i % 3] for i, c in enumerate(t + account)) % 10 == 0 for t in tails)


def _digits(m: re.Match) -> str:
    return re.sub(r"\D", "", m[0])


def _valid_date(y: int, m: int, d: int) -> str | None:
    import datetime

    try:
        return datetime.date(y, m, d).isoformat()
    except ValueError:
        return None


def _phone(m: re.Match) -> str | None:
    d = _digits(m)
    if m[0].lstrip().startswith("+"):
        return f"+{d}" if 10 <= len(d) <= 15 else None
    if len(d) == 11 and d[0] in "78":
        return f"+7{d[1:]}"
    return f"+7{d}" if len(d) == 10 and d[0] in "3489" else None


def _amount(m: re.Match) -> str:
    whole, part, scale = re.sub(r"\s", "", m["whole"]), m["part"] or "0", (m["scale"] or "").lower()
    return f"{float(f'{whole}.{part}') * SCALES.get(scale, 1):.2f} RUB"


def _verbal_date(m: re.Match) -> str | None:
    month = next((i for i, s in enumerate(MONTH_STEMS, 1) if re.match(s, m[2].lower())), 0)
    return _valid_date(int(m[3]), month, int(m[1])) if month else None


def _card(m: re.Match) -> str | None:
    d = _digits(m)
    return d if 13 <= len(d) <= 19 and len(set(d)) > 1 and luhn(d) else None


def _url(m: re.Match) -> str | None:
    x = re.sub(r"[.,;:!?)\]}>]+$", "", m[0])
    head = re.match(r"(?i)(https?://)([^/?#]*)(.*)", x, re.S)
    return head[1].lower() + head[2].lower() + head[3] if head and head[2] else None


def _domain(m: re.Match) -> str | None:
    return m[0].lower() if m[0].rsplit(".", 1)[1].lower() in TLDS else None


def _named(prefix: str) -> Callable[[re.Match], str | None]:
    return lambda m: prefix + next(g for g in m.groups() if g).lower().rstrip(".,")


def _address(m: re.Match) -> str | None:
    tail = m[2]
    if not re.search(r"(?i)\b(?:г\.|город|Москв|Санкт-Петербург|ул\.|улица|пр-кт|пер\.|проспект|переулок|обл\.|область|край|респ\.|республика|д\.|дом\s)", tail):
        return None
    flat = re.sub(r"[.,;\s]+", " ", tail).strip().lower()
    for long, short in (("улица", "ул"), ("проспект", "пр"), ("пр-кт", "пр"), ("переулок", "пер"), ("область", "обл"), ("строение", "стр"), ("корпус", "к"), ("квартира", "кв"), ("район", "р-н"), ("город ", ""), ("дом ", "")):
        flat = flat.replace(long, short)
    flat = re.sub(r"\b[гд] ", "", flat)
    return f"{m[1]} {flat}".strip()


def _github(m: re.Match) -> str | None:
    user, _, rest = m[1].lower().partition("/")
    repo = rest.partition("/")[0].removesuffix(".git").strip(".")
    if user in GITHUB_RESERVED or not re.fullmatch(r"[a-z0-9](?:-?[a-z0-9]){0,38}", user):
        return None
    return f"github.com/{user}/{repo}" if repo else f"github.com/{user}"


def _youtube(m: re.Match) -> str | None:
    kind, _, name = m[1].rstrip(".").partition("/")
    if kind.startswith("@"):
        return f"youtube.com/{kind}" if len(kind) > 1 else None
    if kind == "channel" and not re.fullmatch(r"UC.{20,}", name):
        return None
    return f"youtube.com/{kind}/{name}" if name else None


def _tweeter(m: re.Match) -> str | None:
    return None if m[1].lower() in TWITTER_RESERVED else f"twitter.com/{m[1].lower()}"


def _contract(m: re.Match) -> str | None:
    number = m["number"].rstrip("./-")
    return number.upper() if any(c.isdigit() for c in number) else None


def _profile(hosts: str, name: str) -> str:
    """A name behind a site's address, with or without scheme and subdomain."""
    return rf"(?<![\w.-])(?:https?://)?(?:(?:www|m|mobile|new|[a-z]{{2}})\.)?(?:{hosts})/{name}"


def _mention(words: str, reach: int) -> str:
    """An @name within some characters behind a site's name."""
    return rf"\b(?:{words})\w*[^@\n]{{0,{reach}}}@"


@dataclass(frozen=True)
class Detector:
    kind: str
    pattern: re.Pattern
    canonical: Callable[[re.Match], str | None]


def _d(kind: str, pattern: str, canonical, flags=0) -> Detector:
    return Detector(kind, re.compile(pattern, flags), canonical)


#: One part of a host name.
_LABEL = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
DETECTORS = (
    _d("PhoneNumber", r"(?<![\w+])(?:\+\d{1,3}|8|7)?[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}(?![\d])", _phone),
    _d("Email", rf"(?<![\w.%+-])[\w.%+-]+@(?:{_LABEL}\.)+[a-z]{{2,}}(?![\w-])", lambda m: m[0].lower(), re.A | re.I),
    _d("INN", r"(?<!\d)(?:\d{12}|\d{10})(?!\d)", lambda m: m[0] if inn(m[0]) else None),
    _d("OGRN", r"(?<!\d)(?:\d{15}|\d{13})(?!\d)", lambda m: m[0] if ogrn(m[0]) else None),
    _d("BIC", r"\b04\d{7}\b", lambda m: m[0]),
    _d("KPP", r"(?<![0-9A-Za-z])\d{4}[0-9A-Z]{2}\d{3}(?![0-9A-Za-z])", lambda m: m[0] if not m[0].startswith("04") else None),
    _d("IBAN", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", lambda m: m[0] if iban(m[0]) else None),
    _d("CreditCard", r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)", _card),
    _d("ContractNumber", r"(?:№|\bNo?\.)\s*(?P<number>[^\W_](?:[./-]|[^\W_]){1,29})", _contract),
    _d("DocumentDate", r"(?<!\d)(\d{4})-(\d{2})-(\d{2})(?!\d)", lambda m: _valid_date(int(m[1]), int(m[2]), int(m[3]))),
    _d("DocumentDate", r"(?<!\d)(\d{1,2})[./-](\d{1,2})[./-](\d{4})(?!\d)", lambda m: _valid_date(int(m[3]), int(m[2]), int(m[1]))),
    _d("DocumentDate", r"\b(\d{1,2})\s+([а-яА-Я]{3,9})\.?\s+(\d{4})", _verbal_date),
    _d("Amount", r"(?<!\d)(?P<whole>\d{1,3}(?:\s\d{3})+|\d+)(?:[.,](?P<part>\d\d?))?\s*(?:(?P<scale>тыс|млн|млрд)\b\.?\s*)?(?:руб(?:\w+|\.)?|rub\b|₽)", _amount, re.I),
    _d("PostalAddress", r"(?<!\d)(\d{6})(?!\d)[,\s]*([^\n;]{1,200})", _address),
    _d("SNILS", r"(?<!\d)\d{3}-\d{3}-\d{3}[ \-]\d{2}(?!\d)", lambda m: _digits(m) if snils(_digits(m)) else None),
    _d("URL", r"https?://[^\s<>\"']+", _url, re.I),
    _d("Domain", r"(?<![@\w.-])(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-zрф]{2,24}\b", _domain, re.I),
    _d("TelegramHandle", r"(?<![\w.\-])(?:https?://)?(?:t|telegram)\.me/([A-Za-z]\w{4,31})|(?<![\w.])@([A-Za-z]\w{4,31})\b(?!\.)", _named("@")),
    _d("VKProfile", _profile(r"vk\.com|vk\.ru|vkontakte\.ru", r"([\w-]+)"), _named("vk.com/"), re.I),
    _d("TwitterHandle", _profile(r"twitter\.com|x\.com", r"(\w{1,15})\b"), _tweeter, re.I),
    _d("TwitterHandle", _mention("twitter|tweet|твиттер", 12) + r"(\w{1,15})\b", _tweeter, re.I),
    _d("InstagramHandle", _profile(r"instagram\.com|instagr\.am", r"([\w.]{1,30})"), _named("instagram.com/"), re.I),
    _d("InstagramHandle", r"(?:insta|инст)\w*\s*[:-]?\s*@([\w.]{1,30})", _named("instagram.com/"), re.I),
    _d("LinkedInProfile", _profile(r"linkedin\.com", r"((?:in|pub|company|school)/[\w.%-]+)"), _named("linkedin.com/"), re.I),
    _d("YouTubeChannel", _profile(r"youtube\.com", r"(@[\w.-]+|(?:channel|user|c)/[\w-]+)"), _youtube, re.I),
    _d("GitHubProfile", _profile(r"github\.com", r"([A-Za-z0-9-]+(?:/[\w.-]+)?)"), _github),
    _d("UUID", r"\b[a-f0-9]{8}-(?:[a-f0-9]{4}-){3}[a-f0-9]{12}\b", lambda m: m[0].lower(), re.I),
    _d("IMEI", r"\b\d{15}\b", lambda m: m[0] if luhn(m[0]) else None),
    _d("MACAddress", r"\b(?:[0-9A-Fa-f]{2}[:\-]){5}[0-9A-Fa-f]{2}\b", lambda m: m[0].lower().replace("-", ":")),
    _d("LicensePlate", r"(?<!\w)[АВЕКМНОРСТУХ]\s?\d{3}\s?[АВЕКМНОРСТУХ]{2}\s?\d{2,3}(?!\w)", lambda m: re.sub(r"\s", "", m[0]).upper(), re.I),
    _d("LicensePlate", r"(?:license plate|plate number|госномер|номерной знак)\s*[:№#]?\s*([A-Z0-9][A-Z0-9 \-]{3,9}[A-Z0-9])", lambda m: re.sub(r"[\s\-]", "", m[1]).upper() if re.search(r"\d", m[1]) else None, re.I),
    _d("VIN", r"\b[A-HJ-NPR-Z0-9]{17}\b", lambda m: m[0] if vin(m[0]) else None),
)


#: What a text must hold before a type is looked for: a digit, a dot inside a word, or one of these (without case).
NEEDS_DIGIT = frozenset("PhoneNumber INN OGRN BIC KPP IBAN CreditCard ContractNumber DocumentDate Amount PostalAddress SNILS IMEI LicensePlate VIN".split())
NEEDS_ANY = {
    "Email": ("@",), "URL": ("://",), "TelegramHandle": ("@", ".me/"), "VKProfile": ("vk",), "TwitterHandle": ("x.com/", "twit", "tweet", "твит"), "InstagramHandle": ("inst", "инст"),
    "LinkedInProfile": ("linkedin.com/",), "YouTubeChannel": ("youtube.com/",), "GitHubProfile": ("github.com/",), "Amount": ("руб", "rub", "₽"), "UUID": ("-",), "MACAddress": (":", "-"),
}
_DIGIT, _INNER_DOT, _HEX_RUN = re.compile(r"\d"), re.compile(r"\w\.\w"), re.compile(r"[0-9A-Fa-f]{2}[:\-][0-9A-Fa-f]{2}")


def _kinds_possible(text: str) -> set[str]:
    """Types that the text can hold at all; cheap, and never wrong in leaving one out."""
    low = text.lower()
    digit = _DIGIT.search(text) is not None
    out = {k for k in PRIORITY if (digit or k not in NEEDS_DIGIT) and (k not in NEEDS_ANY or any(x in low for x in NEEDS_ANY[k]))}
    if not _INNER_DOT.search(text):
        out.discard("Domain")
    if not _HEX_RUN.search(text):
        out -= {"UUID", "MACAddress"}
    return out


def extract_identifiers(text: str | None) -> list[dict]:
    """Spans of a text: {type, canonical, original, start, end}, in text order.

    Taken by priority, then start, then length; a span that overlaps a taken one is dropped. An account counts only if
    a bank's code in the same text confirms its control digit.
    """
    if not text:
        return []
    found = []
    possible = _kinds_possible(text)
    for d in DETECTORS:
        if d.kind not in possible:
            continue
        for m in d.pattern.finditer(text):
            if canonical := d.canonical(m):
                found.append((d.kind, canonical, m.start(), m.end()))
    bics = [c for k, c, *_ in found if k == "BIC"]
    for m in re.finditer(r"(?<!\d)\d{20}(?!\d)", text) if bics else ():
        if any(account_fits(m[0], b) for b in bics):
            found.append(("BankAccount", m[0], m.start(), m.end()))
    # what is kept is disjoint, so its neighbours by start tell whether a span overlaps any of it
    kept: list[tuple] = []
    for f in sorted(found, key=lambda f: (-PRIORITY[f[0]], f[2], f[2] - f[3])):
        i = bisect_left(kept, f[2], key=lambda k: k[2])
        if (i == 0 or kept[i - 1][3] <= f[2]) and (i == len(kept) or f[3] <= kept[i][2]):
            kept.insert(i, f)
    return [{"type": k, "canonical": c, "original": text[s:e], "start": s, "end": e} for k, c, s, e in kept]


_SPAN = pa.list_(pa.struct([("type", pa.string()), ("canonical", pa.string()), ("original", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def with_identifiers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, identifiers): every document's spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([extract_identifiers(t) for t in b.column(1).to_pylist()], _SPAN)], names=["id", "identifiers"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, identifiers array<struct<type:string,canonical:string,original:string,start:int,end:int>>").withColumnRenamed("id", id_col)


def dedupe_by_canonical(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document, type and canonical form: the first span."""
    e = spans.select(id_col, F.explode("identifiers").alias("x")).select(id_col, "x.*")
    return e.groupBy(id_col, "type", "canonical").agg(F.min(F.struct("start", "end", "original")).alias("m")).select(id_col, "type", "canonical", "m.start", "m.end", "m.original")


def canonical_entities(spans: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", around: int = 80) -> DataFrame:
    """Unique (type, canonical) over all documents with a snippet of the first mention as description."""
    first = dedupe_by_canonical(spans, id_col).groupBy("type", "canonical").agg(F.min(F.struct(id_col, "start", "end")).alias("m")).select("type", "canonical", f"m.{id_col}", "m.start", "m.end")
    s = F.greatest(F.col("start") - around, F.lit(0))
    return first.join(docs.select(id_col, text_col), id_col).select("type", "canonical", id_col, F.substring(F.col(text_col), s + 1, F.col("end") + around - s).alias("description"))
