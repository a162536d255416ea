r"""Operator 1: quality rules with a line-labelling conditional random field.

Every line with a word is one step of a linear-chain CRF with two labels,
content and boilerplate. Emission features are read from the line's bytes
(symbols, capitals, separators, repeats, length) and from a list of words that menus, notices,
share and login lines of web pages are made of; transitions tie neighbouring
lines together, so a one-word line inside prose stays content. Viterbi decoding
gives the best label sequence of each document, and the share of its
word characters in content lines decides whether it stays.

Defined results: a null or empty text has no words, every count is 0,
``base_failed`` is true and ``kept`` false; a text of any length is read whole;
rows with equal ids or texts are judged one by one; an empty table gives an empty
table; columns beside id and text are not read, and ``keep_quality`` hands
them on whatever their names.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textops as T

CONTENT, BOILERPLATE = 0, 1
SYMBOLS = T.class_table(b"#*$%&|<>")
UPPER, LOWER, DIGIT = (T.class_table(bytes(range(a, b))) for a, b in ((65, 91), (97, 123), (48, 58)))
TERMINAL = T.class_table(b".!?:;\"')")
FEATURES = (
    "bias", "some symbols", "symbols over 1/20", "symbols over 1/8", "exclamation marks over 1/20", "capitals over half of the ASCII letters",
    "one word", "two to four words", "twelve words or more", "equal to an earlier line", "a third of the words equal their predecessor",
    "digits over 3/10", "ends like a sentence", "a separator bar for every third word", "bytes a word over 14",
    "a word of site furniture", "two such words or more", "a third of the words are", "two thirds are",
)

# Words of navigation, cookie, share, login and copyright lines, lower-cased.
FURNITURE = (
    "home menu navigation sitemap search login log logout sign register account password forgot username remember profile settings dashboard cart basket checkout wishlist "
    "about contact help faq support careers press blog news archive categories tags category previous next back top skip main more read comments reply "
    "cookie cookies consent accept decline preferences privacy policy policies terms conditions disclaimer legal imprint accessibility advertisement advertise sponsored "
    "share tweet facebook twitter instagram linkedin pinterest youtube whatsapp reddit telegram email print rss follow subscribe newsletter unsubscribe inbox "
    "© copyright rights reserved powered wordpress trademarks "
    "startseite impressum datenschutz datenschutzerklärung kontakt anmelden abmelden registrieren suche warenkorb agb teilen folgen weiter zurück einstellungen akzeptieren ablehnen rechte vorbehalten passwort benutzername vergessen "
    "accueil connexion déconnexion inscription mentions légales contactez rechercher recherche panier partager suivez confidentialité accepter refuser réservés droits suivant précédent abonnez "
    "inicio contacto iniciar sesión cerrar buscar carrito compartir síguenos privacidad aceptar rechazar derechos reservados siguiente anterior suscríbete contraseña aviso"
).split()


@dataclass(frozen=True)
class LineCrf:
    """Weights of the chain: emissions [feature, label], transitions [label, next label]."""

    emission: np.ndarray
    transition: np.ndarray


def furniture_words(data, offsets, table, powers) -> np.ndarray:
    """Where the words of FURNITURE start: runs of letters, digits and other scripts, A-Z lower-cased."""
    _, _, listed, ends = next(iter(T.slices(pa.array([" ".join(FURNITURE)]))))
    start, end, _ = T.runs(~T.SPACE[listed], ends)
    wanted = T.Hasher(listed, table, powers).of(start, end)
    start, end, _ = T.runs((data >= 128) | (LOWER | UPPER | DIGIT)[data], offsets)
    return start[np.isin(T.Hasher(T.lower_az(data), table, powers).of(start, end), wanted)]


def line_features(h: T.Hasher, data, offsets, words, table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features [line, feature], first line of each text, word characters of each line, equal to an earlier line), for lines with a word."""
    ws, we, wf = words
    ls, le, _ = T.line_ranges(data, offsets)
    a, b = np.searchsorted(ws, ls), np.searchsorted(ws, le)
    some = b > a
    ls, le, a, b = ls[some], le[some], a[some], b[some]
    first = np.searchsorted(ls, offsets)
    n = b - a
    inside = T.counts(~T.SPACE[data] & ((data & 0xC0) != 0x80))
    chars = inside[le] - inside[ls]

    def of(mask):
        c = T.counts(mask)
        return c[le] - c[ls]

    sym, bang, up, low, dig, bars = of(SYMBOLS[data]), of(data == 33), of(UPPER[data]), of(LOWER[data]), of(DIGIT[data]), of(data == 124)
    wh = h.of(ws, we)
    same = np.zeros(len(ws) + 1, np.int64)
    if len(ws) > 1:
        same[2:] = np.cumsum(wh[1:] == wh[:-1])
    again = same[b] - same[np.minimum(a + 1, b)]
    furniture = furniture_words(data, offsets, table, h.powers)
    furniture = np.searchsorted(furniture, le) - np.searchsorted(furniture, ls)
    doc = T.owners(first)
    key = T.mix(h.of(ls, le) + doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    _, at = np.unique(key, return_index=True)
    repeated = np.ones(len(key), bool)
    repeated[at] = False
    x = np.stack([
        np.ones(len(ls), bool), sym > 0, sym * 20 > chars, sym * 8 > chars, bang * 20 > chars, up * 2 > np.maximum(up + low, 1),
        n == 1, (n > 1) & (n < 5), n >= 12, repeated, again * 3 > n,
        dig * 10 > chars * 3, TERMINAL[data[we[b - 1] - 1]] if len(ls) else np.zeros(0, bool), bars * 3 >= n, (le - ls) > 15 * n,
        furniture > 0, furniture > 1, furniture * 3 >= n, furniture * 3 >= 2 * n,
    ], axis=1)
    return x, first, chars, repeated


def viterbi(emission: np.ndarray, transition: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best label of each line; ``first`` has the first line of each sequence, and one more. All sequences take a step together."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    start, length = first[:-1][order], length[order]
    back = np.zeros((len(emission), 2), np.int8)
    score = emission[start[: np.searchsorted(-length, 0)]] if len(emission) else np.zeros((0, 2))
    last = score.copy()
    for t in range(1, int(length[0]) if len(length) else 0):
        live = int(np.searchsorted(-length, -t))  # sequences longer than t
        both = last[:live, :, None] + transition[None]
        at = start[:live] + t
        back[at] = both.argmax(axis=1)
        last[:live] = both.max(axis=1) + emission[at]
    labels = np.zeros(len(emission), np.int8)
    live = len(last)
    now = last.argmax(axis=1).astype(np.int8)
    end = start[:live] + length[:live] - 1
    labels[end] = now
    for t in range((int(length[0]) if len(length) else 0) - 1, 0, -1):
        live = int(np.searchsorted(-length, -t))
        at = start[:live] + t
        now[:live] = back[at, now[:live]]
        labels[at - 1] = now[:live]
    return labels


#: Kinds of junk lines that ``generated_lines`` makes; the last five are furniture of web pages.
KINDS = ("shouting", "symbols", "bars", "repeats", "marks", "navigation", "cookies", "share", "login", "copyright")


def furniture_line(kind: str, r: random.Random, word) -> str:
    """A line of a kind of web-page furniture, in one of four languages; ``word`` makes a name."""
    name = " ".join(word().capitalize() for _ in range(r.randint(1, 3)))
    if kind == "navigation":
        items = r.choice((("Home", "About us", "Contact", "News", "Blog", "Help", "FAQ", "Search", "Sitemap", "Careers", "Back to top", "Previous", "Next", "Read more", "Skip to main content"),
                          ("Startseite", "Kontakt", "Suche", "Impressum", "Datenschutz", "AGB", "Zurück", "Weiter"), ("Accueil", "Contactez-nous", "Recherche", "Mentions légales", "Panier"),
                          ("Inicio", "Contacto", "Buscar", "Carrito", "Aviso legal", "Siguiente", "Anterior")))
        return r.choice((" ", " | ", " » ", " · ")).join(r.choice(items) for _ in range(r.choice((1, 1, 1, 2, 4, 8))))
    if kind == "cookies":
        return r.choice(("We use cookies to improve your experience", "Accept all cookies", "Cookie preferences", "Read our privacy policy", "By using this site you accept our cookie policy and terms",
                         "Alle Cookies akzeptieren", "Cookie Einstellungen", "Accepter les cookies", "Politique de confidentialité", "Aceptar cookies", "Privacidad y cookies")) + r.choice(("", "."))
    if kind == "share":
        nets = ("Facebook", "Twitter", "LinkedIn", "Pinterest", "WhatsApp", "Reddit", "Email", "Instagram", "YouTube")
        return r.choice(("Share on ", "Share this: ", "Follow us on ", "Tweet ", "Teilen: ", "Partager sur ", "Compartir en ", "Subscribe to our newsletter ", "")) + r.choice((" ", ", ")).join(r.sample(nets, r.choice((1, 1, 2, 4))))
    if kind == "login":
        return r.choice(("Login", "Log in / Register", "Sign in to your account", "Forgot password?", "Remember me", "Username", "Password", "Anmelden", "Passwort vergessen?", "Connexion", "Iniciar sesión", "My account", "Cart (0)", "Logout"))
    return r.choice((f"© 2024 {name}. All rights reserved.", f"Copyright 2019 {name}", f"© {name}. Alle Rechte vorbehalten.", f"© 2021 {name} - Tous droits réservés", f"© {name}. Todos los derechos reservados.", "Powered by WordPress", "Terms and conditions", "Privacy policy | Terms"))


def generated_lines(seed: int = 5, texts: int = 800, kinds: tuple[str, ...] = KINDS) -> list[tuple[list[str], list[int]]]:
    """Labelled line sequences for training: prose of made-up words in several alphabets with short lines, data, notices and words that
    furniture has too, and runs of junk lines of the kinds."""
    r = random.Random(seed)
    alphabets = ("abcdefghijklmnoprstuvw", "aeiouéèêçlmnrst", "äöüßacehnrstui", "ñíóaeiolrscdt")
    word = lambda a: "".join(r.choice(a) for _ in range(min(12, 1 + int(r.expovariate(0.22)))))
    out = []
    for _ in range(texts):
        a = r.choice(alphabets)

        def prose(most=60, a=a):
            ws = [(r.choice(FURNITURE) if r.random() < 0.03 else word(a)) + ("," if r.random() < 0.06 else ". " if r.random() < 0.1 else "") for _ in range(r.choice((1, 2, 3, 6, 12, 30, most)))]
            if r.random() < 0.12:
                ws.insert(r.randrange(len(ws) + 1), r.choice(("a.b7@mail.example.org", "+1 (555) 555-0142", "token = \"9f3a77c01b\"", "https://example.org/a?b=1", "10.0.0.7", "4111 1111 1111 1111")))
            return " ".join(ws).capitalize() + r.choice((".", ".", ".", "!", "?", ""))

        def junk(kind, a=a):
            ws = [word(a) for _ in range(r.choice((3, 8, 20, 50)))]
            if kind == "shouting":
                return " ".join(w.upper() + "!!" for w in ws) + r.choice(("", "."))
            if kind == "symbols":
                return " ".join(w + r.choice(("***", "$$$", "%%%", "&&&", "###", "")) for w in ws)
            if kind == "bars":
                return " | ".join(ws) + r.choice(("", "."))
            if kind == "repeats":
                return " ".join(w for w in ws[:8] for _ in range(r.randint(4, 30))).capitalize() + r.choice(("", "."))
            if kind == "marks":
                return r.choice((" > ".join(ws[:6]), "<" + "> <".join(ws[:8]) + ">", "# # # # #", "||||||||", "*" * 40, "$ 1 | % 2 | # 3"))
            return furniture_line(kind, r, lambda: word(a))

        lines, labels = [], []
        for _ in range(r.randint(1, 5)):
            bad, kind = r.random() < 0.35, r.choice(kinds)
            web = [k for k in kinds if k in KINDS[5:]]
            for _ in range(r.randint(1, 6)):
                lines.append(junk(r.choice(web) if kind in web and r.random() < 0.5 else kind) if bad else prose())
                labels.append(BOILERPLATE if bad else CONTENT)
        out.append((lines, labels))
    return out


def fit_crf(sequences: list[tuple[list[str], list[int]]], steps: int = 250, ridge: float = 0.02) -> LineCrf:
    """Weights that maximise the conditional likelihood of the labels (forward-backward gradients, Adam steps)."""
    texts = ["\n".join(lines) for lines, _ in sequences]
    xs, ys = [], []
    table, powers = T.byte_table(), T.Powers()
    row = 0
    for lo, hi, data, offsets in T.slices(pa.array(texts)):
        x, first, _, _ = line_features(T.Hasher(data, table, powers), data, offsets, T.runs(~T.SPACE[data], offsets), table)
        xs += [x[first[k] : first[k + 1]].astype(float) for k in range(hi - lo)]
        ys += [np.array(sequences[lo + k][1]) for k in range(hi - lo)]
        row = hi
    assert row == len(texts)
    n, m, f = len(xs), max(map(len, xs)), len(FEATURES)
    x, y, live = np.zeros((n, m, f)), np.zeros((n, m), int), np.zeros((n, m), bool)
    for k, (a, b) in enumerate(zip(xs, ys, strict=True)):
        x[k, : len(a)], y[k, : len(b)], live[k, : len(a)] = a, b, True
    pair = live[:, 1:]
    seen_e = np.einsum("ntf,ntl->fl", x * live[..., None], np.eye(2)[y])
    seen_t = np.einsum("nta,ntb->ab", np.eye(2)[y[:, :-1]] * pair[..., None], np.eye(2)[y[:, 1:]])
    w, a = np.zeros((f, 2)), np.zeros((2, 2))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, a)]
    logsum = lambda v, axis: np.logaddexp.reduce(v, axis=axis)
    for step in range(1, steps + 1):
        e = x @ w
        fwd, bwd = np.zeros((n, m, 2)), np.zeros((n, m, 2))
        fwd[:, 0] = e[:, 0]
        for t in range(1, m):
            fwd[:, t] = np.where(live[:, t, None], logsum(fwd[:, t - 1, :, None] + a, 1) + e[:, t], fwd[:, t - 1])
        for t in range(m - 2, -1, -1):
            bwd[:, t] = np.where(live[:, t + 1, None], logsum(a[None] + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2), 0)
        z = logsum(fwd[:, -1], 1)
        p = np.exp(fwd + bwd - z[:, None, None]) * live[..., None]
        q = np.exp(fwd[:, :-1, :, None] + a + (e + bwd)[:, 1:, None, :] - z[:, None, None, None]) * pair[..., None, None]
        grads = (np.einsum("ntf,ntl->fl", x, p) - seen_e) / n + ridge * w, (q.sum((0, 1)) - seen_t) / n + ridge * a
        for param, g, s in zip((w, a), grads, state, strict=True):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.99 * s[1] + 0.01 * g * g
            param -= 0.1 * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-8)
    return LineCrf(w, a)


_MODEL: list[LineCrf] = []


def default_crf() -> LineCrf:
    """The chain fitted on the generated lines; fitted once in a driver process (about a second)."""
    if not _MODEL:
        _MODEL.append(fit_crf(generated_lines()))
    return _MODEL[0]


def judge(model: LineCrf, content_share: float, data, offsets, table, powers) -> dict[str, np.ndarray]:
    """Counts and verdict of each text of a slice."""
    words = ws, we, wf = T.runs(~T.SPACE[data], offsets)
    h = T.Hasher(data, table, powers)
    n_words = np.diff(wf)
    symbols = T.counts(SYMBOLS[data])
    x, first, chars, repeated = line_features(h, data, offsets, words, table)
    labels = viterbi(x @ model.emission, model.transition, first)

    def total(v, at):
        c = np.concatenate([[0], np.cumsum(v)])
        return c[at[1:]] - c[at[:-1]]

    word_chars = total(chars, first)
    content = total(chars * (labels == CONTENT), first)
    # words of 8-word windows found twice or more in their text
    doc = T.owners(wf)
    window = np.flatnonzero(np.arange(len(ws)) + 8 <= wf[1:][doc]) if len(ws) else np.zeros(0, np.int64)
    wh = h.of(ws, we)
    key = doc[window].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for k in range(8):
        key += wh[window + k] * np.uint64(2 * k * k + 0x9E3779B97F4A7C15 * (2 * k + 1) & (2**64 - 1) | 1)
    key = T.mix(key)
    order = np.argsort(key)
    equal = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(window), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    cover = np.zeros(len(ws) + 1, np.int64)
    cover[window[twice]] += 1
    cover[window[twice] + 8] -= 1
    n_repeat = total(np.cumsum(cover[:-1]) > 0, wf)
    base_failed = (n_words < 20) | (100 * n_repeat > 30 * n_words)
    share = content / np.maximum(word_chars, 1)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]], "n_dup_lines": total(repeated, first),
        "n_repeat_words": n_repeat, "base_failed": base_failed, "kept": ~base_failed & (share >= content_share), "content_share": share,
        "n_lines": np.diff(first), "n_boilerplate_lines": total(labels == BOILERPLATE, first),
    }


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, n_lines long, n_boilerplate_lines long"
#: At least this share of the word characters must stand in content lines.
CONTENT_SHARE = 0.8


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: LineCrf | None = None, content_share: float = CONTENT_SHARE) -> DataFrame:
    """One row per row of ``docs``: its id, the base counts, the share of content and the verdict. Map-only: no row moves."""
    model = model or default_crf()
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        table, powers = T.byte_table(), T.Powers()
        for batch in batches:
            for lo, hi, data, offsets in T.slices(batch.column(1)):
                found = judge(model, content_share, data, offsets, table, powers)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, found.values())], ["id", *found])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, {COUNTS}").withColumnRenamed("id", id_col)


def keep_quality(docs: DataFrame, text_col: str = "text", model: LineCrf | None = None, content_share: float = CONTENT_SHARE) -> DataFrame:
    """The rows of ``docs`` whose verdict is to stay, with all their columns."""
    model = model or default_crf()
    at = docs.columns.index(text_col)

    def run(batches):
        table, powers = T.byte_table(), T.Powers()
        for batch in batches:
            for lo, hi, data, offsets in T.slices(batch.column(at)):
                kept = judge(model, content_share, data, offsets, table, powers)["kept"]
                yield batch.slice(lo, hi - lo).filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def line_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: LineCrf | None = None) -> DataFrame:
    """One row per line with a word: id, place among these lines, whether it is content, its word characters."""
    model = model or default_crf()
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        table, powers = T.byte_table(), T.Powers()
        for batch in batches:
            for lo, hi, data, offsets in T.slices(batch.column(1)):
                x, first, chars, _ = line_features(T.Hasher(data, table, powers), data, offsets, T.runs(~T.SPACE[data], offsets), table)
                labels = viterbi(x @ model.emission, model.transition, first)
                doc = T.owners(first)
                ids = batch.column(0).slice(lo, hi - lo).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.arange(len(doc)) - first[doc]), pa.array(labels == CONTENT), pa.array(chars)], ["id", "line", "content", "n_chars"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, line long, content boolean, n_chars long").withColumnRenamed("id", id_col)
