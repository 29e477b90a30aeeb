"""Personal data by a semi-Markov CRF over whole candidate spans.

Text around digits and @ is cut into regions; every bounded run of a region's tokens that could be an
entity is a candidate with features of the whole span. The dynamic programme chooses boundaries and
types together. Spans of the four base patterns always stay; of what the CRF finds, the spans that
overlap none of them are added.
"""

from __future__ import annotations

import hashlib
import random
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrel.llm.common import prepare, thin
from rastrel.llm.semicrf import SemiCrf

KINDS = ("email", "ip", "card", "phone")
#: Tokens of an entity at most; regions of the table that the CRF learns from at most, and written ones.
LONGEST, SAMPLE_REGIONS, PRACTICE = 24, 200, 500
_AT = re.compile("@")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TWICE = str.maketrans("0123456789", "0246813579")
_OTHER = re.compile(r"[^0-9]+")
_MARK = re.compile(r"[0-9@]")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.S)
_SHAPE = str.maketrans("123456789", "000000000")
_TAIL = re.compile(r"[A-Za-z]{2,10}\Z")
Span = tuple[int, int, str]  # start, end, kind


def luhn(digits: str) -> bool:
    return (sum(map(int, digits[::-2])) + sum(map(int, digits[-2::-2].translate(_TWICE)))) % 10 == 0


def _digits(s: str) -> str:
    return _OTHER.sub("", s)


def base_spans(text: str) -> list[Span]:
    """Matches of the four patterns, leftmost and not overlapping within a kind; those that fail a check are dropped."""
    out: list[Span] = []
    end = 0
    for m in _AT.finditer(text):  # a match begins where the run of characters before its @ does, or where the last one ended
        at = m.start()
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (d := _DOMAIN.match(text, at + 1)):
            out.append((start, d.end(), "email"))
            end = d.end()
    for m in _IP.finditer(text):
        if all(int(p) <= 255 if len(p) < 10 else int(p.lstrip("0")[:9] or 0) <= 255 and len(p.lstrip("0")) <= 3 for p in m.group().split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Maximal runs of words that hold a digit or @ or are bare signs, one white space apart at most."""
    end, start = 0, -1
    for m in _MARK.finditer(text):
        if m.start() < end:
            continue
        a, b = m.start(), m.end()
        while a > end and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if start >= 0 and a - end <= 1:
            end = b
            continue
        if start >= 0:
            yield start, end
        start, end = a, b
    if start >= 0:
        yield start, end


def _features(text: str, a: int, b: int, kind: str) -> list[str]:
    """Features of the whole span text[a:b] as an entity of that kind."""
    s = text[a:b]
    d = _digits(s)
    before, after = text[a - 1 : a], text[b : b + 1]
    own = ["bias", "left" + ("^" if not before else "space" if before.isspace() else "word" if before.isalnum() else before),
           "right" + ("$" if not after else "space" if after.isspace() else "word" if after.isalnum() else "mark")]
    if after and not after.isspace() and not after.isalnum():
        own.append("right then " + ("word" if text[b + 1 : b + 2].isalnum() else "end"))
    if kind == "email":
        local, _, domain = s.partition("@")
        own += [f"labels{min(4, domain.count('.') + 1)}", "tail" if _TAIL.search(domain) else "no tail", "local" if _LOCAL.match(local) else "odd local",
                "domain" if _DOMAIN.fullmatch(domain) else "odd domain", "local end " + ("mark" if local[:1] in ".-+%_" else "word")]
    elif kind == "ip":
        parts = s.split(".")
        fit = len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
        own += [f"parts{min(6, len(parts))}", "fit" if fit else "unfit", f"digits{min(13, len(d))}"]
    else:
        groups = [len(g) for g in re.findall(r"[0-9]+", s)]
        own += [f"digits{min(20, len(d))}", f"groups{min(7, len(groups))}", "shape" + "-".join(map(str, groups[:6])), "first" + ("+" if s[0] == "+" else "(" if s[0] == "(" else "digit"),
                "closed" if s.count("(") == s.count(")") else "open"]
        if kind == "card":
            own += ["luhn" if luhn(d) else "no luhn", "lead" + d[:1]]
        else:
            own += ["plus" if s[0] == "+" else "no plus", "signs" + "".join(sorted(set(re.sub(r"[0-9]", "", s))))]
    return [f"{kind}:{f}" for f in own]


def tokens_of(text: str, a: int, b: int) -> tuple[array, str]:
    """Bounds of a region's tokens, one more than there are tokens, and one sign for each: d digits, w letters, else the character itself."""
    bounds, kinds = array("q", [a]), []
    for m in _TOKEN.finditer(text, a, b):
        c = text[m.start()]
        bounds.append(m.end())
        kinds.append("d" if "0" <= c <= "9" else "w" if c.isascii() and c.isalpha() else c)
    return bounds, "".join(kinds)


def candidates(bounds: array, kinds: str, i: int) -> Iterator[tuple[int, str]]:
    """(end, type) of every candidate segment that starts at token i."""
    first = kinds[i]
    if first not in "dw+(":
        return
    # what the run up to here can still be
    email, number, ip = first in "dw", first in "d+(", first == "d"
    at = digits = dots = 0
    for j in range(i, min(len(kinds), i + LONGEST)):
        k = kinds[j]
        if k == "d":
            digits += bounds[j + 1] - bounds[j]
        elif k == "@":
            at += 1
            number = ip = False
            email = email and at == 1
        elif k in "w_%":
            number = ip = False
        elif k == ".":
            dots += 1
        elif k in "+-":
            ip = False
            number = number and (k == "-" or j == i)
        elif k in " ()":
            email = ip = False
        else:
            return
        if not (email or number or ip):
            return
        if k not in "dw":
            continue
        if email and at and kinds[j - 1] != "@" and dots:
            yield j + 1, "email"
        if ip and k == "d" and dots == 3:
            yield j + 1, "ip"
        if number and k == "d":
            if 7 <= digits <= 15:
                yield j + 1, "phone"
            if 12 <= digits <= 19 and first == "d":
                yield j + 1, "card"


def _lesson(text: str, gold: list[Span], a: int, b: int):
    """A short region to learn from: how many tokens, its candidates with features, and those of them that are right."""
    bounds, kinds = tokens_of(text, a, b)
    index = {at: i for i, at in enumerate(bounds)}
    options = [((i, j, kind), _features(text, bounds[i], bounds[j], kind)) for i in range(len(kinds)) for j, kind in candidates(bounds, kinds, i)]
    own = {(index[s], index[e], k) for s, e, k in gold if s in index and e in index}
    return len(kinds), options, own & {o[0] for o in options}


def practice(n: int, seed: int = 23) -> list[tuple[str, list[Span]]]:
    """Short invented texts with entities in common written forms, and with look-alikes that are none."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9)))

    def card() -> str:
        body = r.choice("3456") + digits(r.choice([13, 14, 14, 14]))
        return body + next(c for c in "0123456789" if luhn(body + c))

    def entity() -> tuple[str, str | None]:
        k = r.randrange(12)
        if k == 0:
            return f"{word()}{r.choice(['.', '_', '', '-'])}{digits(r.randint(0, 3))}@{word()}{r.choice(['', digits(1)])}.{r.choice(['com', 'org', 'net', 'co.uk', 'example.com', 'de'])}", "email"
        if k == 1:
            return ".".join(str(r.randint(0, 255)) for _ in range(4)), "ip"
        if k == 2:
            c = card()
            return r.choice([c, "-".join(c[i : i + 4] for i in range(0, len(c), 4)), " ".join(c[i : i + 4] for i in range(0, len(c), 4))]), "card"
        if k in (3, 4):
            return r.choice([f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(7)}", f"+{digits(1)}-{digits(3)}-{digits(3)}-{digits(4)}", f"+{digits(12)}"]), "phone"
        if k == 5:
            return r.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"]), "phone"
        return r.choice([
            f"{r.randint(1900, 2099)}-{digits(2)}-{digits(2)}", f"{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 20)}", f"{digits(r.randint(1, 6))}", f"{digits(r.randint(7, 13))}", f"{digits(20)}",
            f"978-{digits(1)}-{digits(3)}-{digits(5)}-{digits(1)}", f"{word()}{digits(3)}", f"@{word()}{digits(2)}", f"{digits(3)},{digits(3)},{digits(3)}", f"{digits(4)}/{digits(5)}", f"{word()}@{digits(2)}",
            f"{r.randint(256, 999)}.{digits(3)}.{digits(3)}.{digits(3)}", "AKIA" + word().upper() + digits(2), f"{digits(8)} {digits(8)}", f"{digits(2)}:{digits(2)}:{digits(2)}", "".join(r.choice("0123456789abcdef") for _ in range(32)),
        ]), None

    out = []
    for _ in range(n):
        text, gold = word() + " ", []
        for _ in range(r.randint(1, 3)):
            s, kind = entity()
            if kind:
                gold.append((len(text), len(text) + len(s), kind))
            text += s + r.choice([" ", " ", ". ", ", ", " " + word() + " "]) + word() + " "
        out.append((text, gold))
    return out


def learn(docs: DataFrame, text_col: str = "text") -> SemiCrf:
    """Fit on practice texts and on the surroundings of a mark in SAMPLE_REGIONS documents at most, the first in the order of a hash.

    Documents where every mark is deeper than 80 characters inside a word have no such surroundings and are not learned from.
    """
    around = F.regexp_extract(text_col, r"((?:^|\s)(?:\S{0,80}[0-9@]\S{0,80}\s?){1,8})", 1)
    own = (
        thin(docs.select(F.col(text_col).alias("text")), F.xxhash64("text"), SAMPLE_REGIONS).where(F.col("text").rlike("[0-9@]"))
        .select(around.alias("text"), F.xxhash64("text").alias("code")).where("text <> ''").orderBy("code", "text").limit(SAMPLE_REGIONS).collect()
    )
    lessons = [_lesson(t, g, a, b) for t, g in practice(PRACTICE) for a, b in regions(t)]
    for r in own:
        t = " " + r["text"] + " "
        lessons += [_lesson(t, base_spans(t), a, b) for a, b in regions(t)]
    return SemiCrf().fit([x for x in lessons if x[1]])


def find_spans(text: str, model: SemiCrf) -> list[Span]:
    """All spans of a text, by start and then kind: the base ones, and those that the CRF adds. Offsets are in code points.

    Candidates live only while the dynamic programme looks at their first token, so a region costs a few numbers for each token.
    """
    if _MARK.search(text) is None:
        return []
    base = base_spans(text)
    out, near, following = list(base), [], 0
    known: dict[tuple, float] = {}
    for a, b in regions(text):
        near = [s for s in near if s[1] > a]
        while following < len(base) and base[following][0] < b:
            if base[following][1] > a:
                near.append(base[following])
            following += 1
        bounds, kinds = tokens_of(text, a, b)

        def options(i: int, bounds=bounds, kinds=kinds) -> Iterator[tuple[int, str, float]]:
            for j, kind in candidates(bounds, kinds, i):
                yield j, kind, _score(text, bounds[i], bounds[j], kind, model, known)

        at = 0  # no base span before this one reaches what is still to come
        for i, j, kind in model.decode(len(kinds), options):
            s, e = bounds[i], bounds[j]
            while at < len(near) and near[at][1] <= s:
                at += 1
            if not _meets(near, at, s, e):
                out.append((s, e, kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _score(text: str, a: int, b: int, kind: str, model: SemiCrf, known: dict[tuple, float]) -> float:
    """What the features of a span weigh. Those of numbers depend on their shape, the signs around, and for cards the check digit and the first."""
    if kind not in ("card", "phone"):
        return model.score(_features(text, a, b, kind))
    s = text[a:b]
    key = (s.translate(_SHAPE), text[a - 1 : a], text[b : b + 2], kind == "card" and (luhn(_digits(s)), s[0]))
    got = known.get(key)
    if got is None:
        if len(known) > 20_000:
            known.clear()
        got = known[key] = model.score(_features(text, a, b, kind))
    return got


def _meets(spans: list[Span], at: int, start: int, end: int) -> bool:
    """Whether any of the spans from at on, sorted by start, overlaps start..end."""
    for s, e, _ in islice(spans, at, None):
        if s >= end:
            return False
        if e > start:
            return True
    return False


def find_personal_data(docs: DataFrame, model: SemiCrf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans for every row of docs.

    The counts and base_sha256 are of the base spans, spans of all, as kind:start:end joined by commas
    in order of start and then kind. Null text counts as empty. Repeated rows stay repeated, null ids
    stay null, an empty table gives no rows, and other columns are not read. Texts may have any length: a
    region of them, long tables of figures too, takes a few numbers for each token.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            rows = []
            for t in batch.column(1):
                text = t.as_py() or ""
                if _MARK.search(text) is None:
                    rows.append((0, 0, 0, 0, none, "", 0))
                    continue
                base, spans = base_spans(text), find_spans(text, model)
                show = lambda x: ",".join(f"{k}:{s}:{e}" for s, e, k in x)
                rows.append((*[sum(s[2] == k for s in base) for k in KINDS], hashlib.sha256(show(base).encode()).hexdigest(), show(spans), len(spans)))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.record_batch([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
