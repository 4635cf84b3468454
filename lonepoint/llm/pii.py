"""Personal data by anchor expansion.

An Aho-Corasick automaton passes over a text once and finds anchors: at-signs, plus signs, digits, schemes
and identifier cues.  At each anchor a local parser, linear in what it reads, expands the span and
validates it.  Secrets, URLs and numbers run to the end of their characters, however long; where such a run
can hold further anchors of its kind, its end is looked for once.

``email``, ``ip``, ``card`` and ``phone`` are the base kinds.  ``address`` is a URL or mail address after a
scheme, ``account`` an identifier or secret after a cue.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lonepoint.llm.words import map_texts, text_bytes

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "account")

#: Schemes, and cues with the pattern of what has to follow them.
SCHEMES = ("http://", "https://", "ftp://", "mailto:", "tel:")
CUES = {
    "password": r"\s{0,2}[=:]\s{0,2}(\S{4})",
    "passwd": r"\s{0,2}[=:]\s{0,2}(\S{4})",
    "api_key": r"\s{0,2}[=:]\s{0,2}[\"']?([A-Za-z0-9_\-]{16,}+)",
    "secret": r"\s{0,2}[=:]\s{0,2}[\"']?([A-Za-z0-9_/+\-]{16,}+)",
    "token": r"\s{0,2}[=:]\s{0,2}[\"']?([A-Za-z0-9_.\-]{16,}+)",
    "iban": r"[\s:#=]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})",
    "ssn": r"[\s:#=]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])",
    "account": r"[\s:#=.]{0,3}(?:no|number)?[\s:#=.]{0,3}([0-9]{6,}+)",
    "akia": r"([A-Z0-9]{16})(?![A-Za-z0-9])",
}
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    country: int(length)
    for length, countries in (
        item.split(":")
        for item in (
            "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV "
            "22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG "
            "25:AO,CV,GW,LY,MZ,PT,ST 26:DZ,IR,IS,TR 27:BI,CF,CG,CM,DJ,FR,GA,GQ,GR,IT,KM,MC,MG,MR,SM,TD "
            "28:AL,AZ,BF,BJ,BY,CI,CY,DO,GT,HN,HU,LB,MA,ML,NE,NI,PL,SN,SV,TG 29:BR,EG,PS,QA,UA "
            "30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
        ).split()
    )
    for country in countries.split(",")
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AFTER_SCHEME = {
    "mailto:": re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "tel:": re.compile(r"\+?[0-9][0-9().\-]{5,}[0-9]"),
}
_URL = re.compile(r"[^\s\"'<>]*+")
_LAST_DOT = re.compile(r"(?s:.*)[A-Za-z0-9-]\.[A-Za-z0-9-]")
_SOLID = re.compile(r"\S*+")
_AFTER_CUE = {cue: re.compile(pattern) for cue, pattern in CUES.items()}
_ANCHOR = np.zeros(256, bool)
_ANCHOR[[ord(c) for c in "@+0123456789:=#"]] = True


def automaton() -> ahocorasick.Automaton:
    """Anchors of all parsers; letters of cues and schemes in lower, upper and title case."""
    found = ahocorasick.Automaton()
    for c in "@+":
        found.add_word(c, (c, c))
    for c in "0123456789":
        found.add_word(c, ("digit", c))
    for kind, words in (("scheme", SCHEMES), ("cue", CUES)):
        for word in words:
            for form in {word, word.upper(), word.capitalize()}:
                found.add_word(form, (kind, word))
    found.make_automaton()
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban(text: str) -> int:
    """How many characters of ``text``, which starts like an IBAN, are one; 0 for none.

    Its country says the length.  Without a known one the number ends with ``text`` or before a space.
    """
    ends = [i + 1 for i, c in enumerate(text) if c != " "]
    length = IBAN_LENGTHS.get(text[:2])
    if length:
        ends = ends[length - 1 : length]
    else:
        ends = [end for end in reversed(ends[14:]) if end == len(text) or text[end] == " "]
    for end in ends:
        plain = text[:end].replace(" ", "")
        if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
            return end
    return 0


def find_spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of all spans, by start, then kind as in ``KINDS``; ends are exclusive."""
    spans = []
    mail_end = dotted_end = card_end = solid_end = url_end = url_stop = url_dot = 0
    for at, (kind, word) in anchors.iter(text):
        if kind == "digit":
            if at >= dotted_end:
                match = _DOTTED.match(text, at)
                dotted_end = match.end()
                parts = list(_PART.finditer(text, at, dotted_end))
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i : i + 4]
                    if all(int(p[0].lstrip("0")[:4] or 0) <= 255 for p in four):
                        spans.append((four[0].start(), four[3].end(), "ip"))
            if at >= card_end:
                match = _CARD.match(text, at)
                card_end = match.end() if match else at + 1
                if match:
                    digits = match[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and _luhn(digits):
                        spans.append((at, card_end, "card"))
        elif kind == "@":
            start = at
            while start > mail_end and text[start - 1] in _LOCAL:
                start -= 1
            match = _DOMAIN.match(text, at + 1)
            if match and start < at:
                mail_end = match.end()
                spans.append((start, mail_end, "email"))
        elif kind == "+":
            match = _PHONE.match(text, at)
            if match and 10 <= sum(map(str.isdigit, match[0])) <= 15:
                spans.append((at, match.end(), "phone"))
        elif kind == "scheme":
            if word in _AFTER_SCHEME:
                match = _AFTER_SCHEME[word].match(text, at + 1)
                if match:
                    stop = at + 1 + len(match[0].rstrip(".,;:!?)]}"))
                    spans.append((at + 1 - len(word), stop, "address"))
            else:
                if at + 1 >= url_end:
                    run = _URL.match(text, at + 1)
                    url_end = run.end()
                    url_stop = at + 1 + len(run[0].rstrip(".,;:!?)]}"))
                    dot = _LAST_DOT.match(text, at + 1, url_stop)
                    url_dot = dot.end() - 3 if dot else -1
                if url_dot > at:
                    spans.append((at + 1 - len(word), url_stop, "address"))
        else:
            match = _AFTER_CUE[word].match(text, at + 1)
            if match:
                # A key prefix is a part of the identifier itself.
                start = at + 1 - len(word) if word == "akia" else match.start(1)
                end = match.end(1)
                if word == "iban":
                    end = start + _iban(match[1])
                elif word in ("password", "passwd"):
                    if end > solid_end:
                        solid_end = _SOLID.match(text, end).end()
                    end = solid_end
                if end > start:
                    spans.append((start, end, "account"))
    spans.sort(key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return spans


def _text_spans(column: pa.Array, anchors: ahocorasick.Automaton) -> list[list[tuple[int, int, str]]]:
    """Spans of every text; texts without any byte that could anchor one are not decoded."""
    data, offsets = text_bytes(column)
    total = np.concatenate([[0], np.cumsum(_ANCHOR[data])])
    worth = total[offsets[1:]] > total[offsets[:-1]]
    akin = [b"AKIA", b"akia", b"Akia"]
    raw = data.tobytes()
    found = []
    for i, w in enumerate(worth.tolist()):
        begin, end = int(offsets[i]), int(offsets[i + 1])
        if w or any(raw.find(k, begin, end) >= 0 for k in akin):
            found.append(find_spans(raw[begin:end].decode(), anchors))
        else:
            found.append([])
    return found


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row of ``docs``.

    Positions are code points.  A null or empty text has no spans.  Base spans are the leftmost
    non-overlapping ones of each kind; kinds may overlap each other.  Repeated rows are judged alike, an empty
    table gives no rows.  Only ``doc_id`` and ``text`` are read.
    """

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        anchors = automaton()
        counts, digests, texts = {k: [] for k in BASE}, [], []
        for spans in _text_spans(piece.column(1), anchors):
            base = [s for s in spans if s[2] in BASE]
            for k in BASE:
                counts[k].append(sum(s[2] == k for s in base))
            digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            texts.append(_joined(spans))
        return pa.RecordBatch.from_arrays(
            [
                piece.column(0),
                *[pa.array(counts[k], pa.int64()) for k in BASE],
                pa.array(digests, pa.string()),
                pa.array(texts, pa.string()),
            ],
            ["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"],
        )

    return map_texts(
        docs.select("doc_id", "text"),
        "text",
        run,
        "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    )


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind."""
    out, at, open_end = [], 0, 0
    for start, end, kind in spans:
        if start >= open_end:
            out += [text[at:start], f"[{kind.upper()}]"]
            at = open_end = end
        elif end > open_end:
            at = open_end = end
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with personal data in ``text`` replaced; a null text stays null."""
    at = docs.columns.index("text")

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        texts = piece.column(at)
        anchors = automaton()
        made = [
            masked(texts[i].as_py(), spans) if spans else texts[i].as_py()
            for i, spans in enumerate(_text_spans(texts, anchors))
        ]
        return piece.set_column(at, piece.schema.field(at), pa.array(made, texts.type))

    return map_texts(docs, "text", run, docs.schema)
