r"""Operator 13: personal data by weak supervision.

1. One pass over the texts finds the base spans (fixed patterns for e-mail addresses, IP addresses, card and phone numbers) and further
   candidates: parts of matches that the base rules drop, and other ways to write the same kinds (``(at)`` and ``(dot)``, letters beyond ASCII, IPv6,
   dotted cards, phone numbers without a country code). Regex, gazetteer and context labelers vote on every candidate: +1, -1 or 0 (no opinion).
2. Spark counts the candidates of the whole table by kind, form, length class and votes, a number of groups that these finite features bound, not the table.
3. Expectation-maximisation over the counted votes estimates how reliable each labeler is for each kind, and how likely each group is personal data.
4. A logistic classifier over votes, form and length is trained on those likelihoods, weighted by the counts.
5. Candidates that it gives ``threshold`` or more are added to the base spans, likeliest first, where nothing stands yet. Base spans always stay.

Scale. One map-only pass over texts, whose small result (spans and votes) is written to the shared folder; one aggregate by group with
map-side combining; at most ``GROUPS`` distinct groups reach the driver. No text, id or span does.

Defined results: a null or empty text has no spans; a text of any length is read whole in linear time; rows with equal ids are treated one by one;
a null id is an id like any other; columns beside id and text are not read; an empty table gives an empty table. The order of rows never matters.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import type_of, written

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: How a candidate came about: a base span, a match that the base rules drop, a part of one, another way of writing.
BASE, DROPPED, PART, VARIANT = range(4)
LABELERS = ("base", "form", "checksum", "gazetteer", "cue", "edges", "company")
LENGTHS = 8
#: Bound of the groups that reach the driver: kind, form, length class, votes.
GROUPS = len(KINDS) * 4 * LENGTHS * 3 ** len(LABELERS)

# The base patterns, top-level domains, calling codes, cue words.
DIGITS = re.compile(r"[0-9]++")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
ADDRESS = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TLDS = frozenset("com org net edu gov info biz io de fr es it nl uk us eu ch at be ca au br mx in jp cn ru pl se no dk fi pt cz ie nz ar cl co".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61",
           "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "351", "352", "353", "358", "359", "380", "420", "421", "852", "886", "966", "971", "972")
CUES = (
    frozenset("mail email courriel correo contact contacto kontakt write schreiben écrire".split()),
    frozenset("ip address adresse dirección server host client serveur servidor".split()),
    frozenset("card visa mastercard amex credit debit karte kreditkarte carte tarjeta crédito kartennummer".split()),
    frozenset("tel phone call fax mobile cell telefon teléfono téléphone telephone handy móvil portable anruf llamar appeler".split()),
)
COUNTER_CUES = frozenset("order invoice isbn issn doi version release token id ref reference article sku serial bestellung rechnung commande facture pedido factura".split())


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


# -- base spans --------------------------------------------------------------------------------------------------------------


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, in linear time: from each @ to both sides."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        done = m.end() if m else at + 1
        if m:
            yield start, done
        at = text.find("@", done)


def matched(pattern: re.Pattern, text: str, starts: list[int]) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of a pattern that begins with all digits of a run."""
    done = 0
    for k in starts:
        if k >= done and (m := pattern.match(text, k)):
            done = m.end()
            yield k, done


def base_matches(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """(kind, start, end, whether the base rules keep it) of every match of the base patterns."""
    if "@" in text:
        yield from ((EMAIL, a, b, True) for a, b in emails(text))
    starts = [m.start() for m in DIGITS.finditer(text)]
    if not starts:
        return
    for a, b in matched(ADDRESS, text, starts):
        yield IP, a, b, all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in text[a:b].split(".")))
    for a, b in matched(NUMBER, text, starts):
        d = digits_of(text[a:b])
        yield CARD, a, b, 14 <= len(d) <= 19 and luhn(d)
    for m in DIALLED.finditer(text):
        yield PHONE, *m.span(), 10 <= len(digits_of(m[0])) <= 15


# -- more candidates ---------------------------------------------------------------------------------------------------------

SPELT = re.compile(r"\s?[\[({]\s?(?:at|AT|@)\s?[\])}]\s?([A-Za-z0-9-]{1,63}(?:\s?[\[({]\s?(?:dot|DOT|\.)\s?[\])}]\s?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63})+)|\s(?:at|AT)\s([A-Za-z0-9-]{1,63}(?:\s(?:dot|DOT)\s[A-Za-z0-9-]{1,63})+)")
WIDE = re.compile(r"[\w-]++(?:\.[\w-]++)++")
COLONS = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
DOTTED_CARD = re.compile(r"(?<![0-9.])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])")
NATIONAL = re.compile(r"(?<![0-9+(])(?:\([0-9]{2,5}\)[\x20-]?|0[0-9]{1,4}[\x20/.-]|[0-9]{3}[.-])[0-9]{3,4}[\x20.-][0-9]{3,5}(?![0-9])|(?<![0-9])00[1-9][0-9]{8,12}(?![0-9])")
LISTED = re.compile(r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{4}(?![0-9])")


def grouped_cards(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Card-like parts of a longer sequence of digits: one group of 13 to 19, or four groups of four."""
    groups = [(a + m.start(), a + m.end()) for m in DIGITS.finditer(text[a:b])]
    k = 0
    while k < len(groups):
        s, e = groups[k]
        four = groups[k : k + 4]
        if 13 <= e - s <= 19:
            yield s, e
        elif len(four) == 4 and all(y - x == 4 for x, y in four):
            yield s, four[-1][1]
            k += 3
        k += 1


def further(text: str, dropped: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(kind, form, start, end) of candidates that are no base span."""
    for kind, a, b in dropped:
        if kind != CARD or 13 <= len(digits_of(text[a:b])) <= 19:
            yield kind, DROPPED, a, b
        if kind == CARD:
            yield from ((CARD, PART, s, e) for s, e in grouped_cards(text, a, b) if (s, e) != (a, b))
        elif kind == PHONE and (m := LISTED.match(text, a)) and m.end() < b:
            yield PHONE, PART, a, m.end()
    lowered = "dot" in text or "DOT" in text or "(at)" in text or "[at]" in text
    if lowered or "@" in text:
        for m in SPELT.finditer(text) if lowered or "[@]" in text or "(@)" in text else ():
            start = m.start()
            while start and m.start() - start < 64 and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                yield EMAIL, VARIANT, start, m.end()
        at = text.find("@")
        while at >= 0:
            start = at
            while start and at - start < 64 and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
                start -= 1
            m = WIDE.match(text, at + 1)
            if m and start < at:
                yield EMAIL, VARIANT, start, m.end()
            at = text.find("@", at + 1)
    if text.count(":") > 1:
        for m in COLONS.finditer(text):
            if m[0].strip(":"):
                yield IP, VARIANT, *m.span()
    yield from ((CARD, VARIANT, *m.span()) for m in DOTTED_CARD.finditer(text))
    yield from ((PHONE, VARIANT, *m.span()) for m in NATIONAL.finditer(text))


# -- labelers ----------------------------------------------------------------------------------------------------------------

WORDS = re.compile(r"[^\W\d_]+")
ISSUERS = re.compile(r"4[0-9]{12,18}|5[1-5][0-9]{14}|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)[0-9]+|3[47][0-9]{13}|3(?:0[0-5]|[68])[0-9]{11,}|6(?:011|5)[0-9]{12,15}|35[0-9]{14,17}")
PLAIN_EMAIL = re.compile(r"[\w%+-]+(?:\.[\w%+-]+)*@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,24}")
PLAIN_CARD = re.compile(r"[0-9]{13,19}|[0-9]{4}([\x20./_-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{4,5}")
PLAIN_PHONE = re.compile(r"\+[0-9]{1,3}(?:[\x20.-]?\([0-9]{2,4}\))?(?:[\x20.-]?[0-9]{2,12}){1,5}")
SPELLING = ((re.compile(r"\s?[\[({]\s?(?:at|@)\s?[\])}]\s?|\sat\s", re.IGNORECASE), "@"), (re.compile(r"\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?|\sdot\s", re.IGNORECASE), "."))


def plain_email(span: str) -> str:
    """An address with (at) and (dot) written out."""
    if "@" in span and not any(c in span for c in "[({"):
        return span
    for pattern, sign in SPELLING:
        span = pattern.sub(sign, span)
    return span


def votes_on(text: str, kind: int, form: int, a: int, b: int, company: bool) -> tuple[int, ...]:
    span = text[a:b]
    digits = digits_of(span)
    sign = lambda yes: 1 if yes else -1
    if kind == EMAIL:
        span = plain_email(span)
        ending = span.rpartition(".")[2].lower()
        shape, check, known = sign(PLAIN_EMAIL.fullmatch(span)), sign(ending.isalpha() and 2 <= len(ending) <= 24), 1 if ending in TLDS else -1 if not ending.isalpha() else 0
    elif kind == IP:
        try:
            found = ipaddress.ip_address(span)
            shape, check, known = 1, 1, sign(not (found.is_multicast or found.is_unspecified or found.is_reserved))
        except ValueError:
            shape, check, known = sign(span.count(".") == 3 and len(span) <= 15), -1, 0
    elif kind == CARD:
        shape, check, known = sign(PLAIN_CARD.fullmatch(span)), sign(luhn(digits)), 1 if ISSUERS.fullmatch(digits) else 0
    else:
        code = digits[2:] if span.startswith("00") else digits if span.startswith("+") else ""
        shape, check, known = sign(PLAIN_PHONE.fullmatch(span)), sign(10 <= len(digits) <= 15), 0 if not code else sign(code.startswith(CALLING))
    before = [w.lower() for w in WORDS.findall(text, max(0, a - 32), a)][-3:]
    cue = 1 if any(w in CUES[kind] for w in before) else -1 if any(w in COUNTER_CUES for w in before) else 0
    left, right = text[a - 1 : a], text[b : b + 1]
    free = not (left.isalnum() or left in ("_", "=", '"', "/", "+") and left or right.isalnum() or right in ("_", "=", '"') and right)
    return (1 if form == BASE else -1 if form == DROPPED else 0, shape, check, known, cue, sign(free), 1 if company else 0)


def length_class(kind: int, a: int, b: int, text: str) -> int:
    """Characters by 8 in e-mail and IP addresses; digits in numbers: below 10, 10, 11, 12, 13, 14 to 15, 16, more."""
    if kind in (EMAIL, IP):
        return min((b - a) // 8, LENGTHS - 1)
    n = len(digits_of(text[a:b]))
    return 0 if n < 10 else n - 9 if n < 14 else 5 if n < 16 else 6 if n == 16 else 7


def code_of(kind: int, form: int, length: int, votes: tuple[int, ...]) -> int:
    """The group of a candidate as one number below GROUPS."""
    code = (kind * 4 + form) * LENGTHS + length
    for v in votes:
        code = code * 3 + v + 1
    return code


def decoded(code: int) -> tuple[int, int, int, tuple[int, ...]]:
    votes = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        votes.append(v - 1)
    code, length = divmod(code, LENGTHS)
    return code // 4, code % 4, length, tuple(reversed(votes))


def candidates(text: str) -> list[tuple[int, int, int, int, int]]:
    """(kind, form, start, end, group) of the base spans and of every candidate that meets none of them."""
    found = list(base_matches(text))
    base = [(k, a, b) for k, a, b, keeps in found if keeps]
    dropped = [(k, a, b) for k, a, b, keeps in found if not keeps]
    more = further(text, dropped) if found or "dot" in text or "DOT" in text or "@" in text or ":" in text else ()
    spans = {(k, BASE, a, b) for k, a, b in base}
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0, int)
    for k, form, a, b in more:
        last = np.searchsorted(starts, b) - 1  # of the base spans that begin before b
        if last < 0 or reach[last] <= a:
            spans.add((k, form, a, b))
    out = []
    for k, form, a, b in sorted(spans):
        company = len(base) > (form == BASE)
        out.append((k, form, a, b, code_of(k, form, length_class(k, a, b, text), votes_on(text, k, form, a, b, company))))
    return out


# -- reliabilities and classifier --------------------------------------------------------------------------------------------

#: Counted beforehand for each labeler: it agrees with the truth in 7 of 10 cases, has no opinion in 2 and errs in 1.
PRIOR = np.array([[7.0, 2.0, 1.0], [1.0, 2.0, 7.0]])
AGREED, RIDGE = 5.0, 0.05


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(likelihood that each voted group is personal data, share of it, probability of each labeler's vote [labeler, truth, vote]) by
    expectation-maximisation over counted votes, begun at the mean vote."""
    seen = votes + 1
    p = 1 / (1 + np.exp(-2.0 * votes.sum(1)))
    table = np.zeros((votes.shape[1], 2, 3))
    share = 0.5
    for _ in range(rounds):
        both = np.stack([(1 - p) * n, p * n])
        share = (both[1].sum() + 1) / (n.sum() + 2)
        for j in range(votes.shape[1]):
            for truth in (0, 1):
                table[j, truth] = PRIOR[truth] + np.bincount(seen[:, j], both[truth], 3)
            table[j] /= table[j].sum(1, keepdims=True)
        odds = np.log(share / (1 - share)) + sum(np.log(table[j, 1, seen[:, j]] / table[j, 0, seen[:, j]]) for j in range(votes.shape[1]))
        before, p = p, 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        if np.abs(p - before).max() < 1e-9:
            break
    return p, share, table


def features(form: np.ndarray, length: np.ndarray, votes: np.ndarray) -> np.ndarray:
    one = lambda x, n: np.eye(n)[x]
    return np.concatenate([np.ones((len(form), 1)), one(form, 4), one(length, LENGTHS), *(one(votes[:, j] + 1, 3) for j in range(votes.shape[1]))], 1)


def fitted(x: np.ndarray, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Ridge logistic weights by Newton's method, for shares ``p`` of ``n`` cases each."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * q * (1 - q))[:, None]).T @ x + RIDGE * np.eye(len(w)), x.T @ (n * (p - q)) - RIDGE * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def classifier(counted: dict[int, int]) -> dict[int, float]:
    """The classifier's probability for each group, trained from the counts of all groups. ``AGREED`` cases on which all labelers agree, of either truth, are
    counted with each kind, so few candidates give a sane one too."""
    out = {}
    for kind in range(len(KINDS)):
        mine = sorted(c for c in counted if decoded(c)[0] == kind)
        if not mine:
            continue
        parts = [decoded(c) for c in mine]
        votes, n = np.array([x[3] for x in parts]), np.array([counted[c] for c in mine], float)
        agreed = np.array([[1] * len(LABELERS), [-1] * len(LABELERS)])
        p, _, _ = reliabilities(np.concatenate([votes, agreed]), np.append(n, [AGREED] * 2))
        x = features(np.array([x[1] for x in parts]), np.array([x[2] for x in parts]), votes)
        sure = features(np.array([BASE, DROPPED]), np.array([parts[0][2]] * 2), agreed)
        # counts beyond a million weigh no more than that share of all cases would: only their ratio matters to the fit
        scale = min(1.0, 1e6 / n.sum())
        w = fitted(np.concatenate([x, sure]), p, np.append(n * scale, [AGREED] * 2))
        out |= dict(zip(mine, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist(), strict=True))
    return out


# -- whole tables ------------------------------------------------------------------------------------------------------------

CANDIDATE = pa.struct([("kind", pa.int8()), ("form", pa.int8()), ("start", pa.int64()), ("stop", pa.int64()), ("grp", pa.int32())])
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_()), ("probability", pa.float64())])


def found_candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, found: array of kind, form, start, stop, group) per document."""

    def run(batches):
        for batch in batches:
            rows = [[dict(zip(("kind", "form", "start", "stop", "grp"), c, strict=True)) for c in candidates(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(CANDIDATE))], ["id", "found"])

    keyed = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return keyed.mapInArrow(run, f"id {type_of(docs, id_col)}, found array<struct<kind:byte,form:byte,start:long,stop:long,grp:int>>")


def chosen(found: list[dict], likely: dict[int, float], threshold: float) -> list[dict]:
    """The base spans, and the likeliest other candidates that meet neither a base span nor one another; by start, then kind."""
    out, taken = [], []
    for c in sorted(found, key=lambda c: (c["form"] != BASE, -likely[c["grp"]], c["start"], -c["stop"], c["kind"])):
        p, base = likely[c["grp"]], c["form"] == BASE
        if not base:
            if p < threshold or any(a < c["stop"] and c["start"] < b for a, b in taken):
                continue
            taken.append((c["start"], c["stop"]))
        out.append((c["start"], c["kind"], {"kind": KINDS[c["kind"]], "start": c["start"], "stop": c["stop"], "base": base, "probability": p}))
    return [x[2] for x in sorted(out, key=lambda x: x[:2])]


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: its id and ``spans`` (kind, start, stop in code points, whether the base rules find it, the classifier's probability), by start, then kind in the order of KINDS."""
    found = written(found_candidates(docs, id_col, text_col), "candidates")
    groups = found.select(F.explode("found.grp").alias("grp")).groupBy("grp").agg(F.count("*").alias("n"))
    likely = classifier({r.grp: r.n for r in groups.collect()})  # at most GROUPS rows

    def run(batches):
        for batch in batches:
            rows = [chosen(f, likely, threshold) for f in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(SPAN))], ["id", "spans"])

    out = found.mapInArrow(run, f"id {type_of(docs, id_col)}, spans array<struct<kind:string,start:long,stop:long,base:boolean,probability:double>>")
    return out.withColumnRenamed("id", id_col)
