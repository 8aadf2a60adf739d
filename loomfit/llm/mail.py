"""The sender's own words of a raw e-mail: headers, quotes and attachments taken away.

What ends a message, signatures and disclaimers, has no format but a separating line. The rest of it is known by what the
whole collection repeats (:mod:`topics`), for which every paragraph tells its first line and its sentences.
"""

from __future__ import annotations

import base64
import binascii
import html
import quopri
import re
from dataclasses import dataclass

#: Depth to which parts of parts are followed.
DEPTH = 8

HEADER = re.compile(r"(?:received|from|to|cc|bcc|subject|date|message-id|in-reply-to|references|reply-to|sender|return-path|mime-version|content-[a-z-]+|x-[a-z-]+)[ \t]*:", re.I)
MBOX = re.compile(r"\A>?From [^\n]*\n(?=[a-z][a-z-]*[ \t]*:)", re.I)
TYPE = re.compile(r"^content-type[ \t]*:[ \t]*([a-z]+/[a-z0-9.+-]+)((?:[^\n]|\n[ \t])*)", re.I | re.M)
BOUNDARY = re.compile(r"boundary[ \t]*=[ \t]*(?:\"([^\"\n]+)\"?|([^\s;]+))", re.I)
CHARSET = re.compile(r"charset[ \t]*=[ \t]*\"?([\w.:-]+)", re.I)
ENCODING = re.compile(r"^content-transfer-encoding[ \t]*:[ \t]*([\w-]+)", re.I | re.M)
ATTACHED = re.compile(r"^content-disposition[ \t]*:[ \t]*attachment", re.I | re.M)
PART = re.compile(r"^--[^\s-][^\n]*\n(?=content-)|^--[^\s-]\S*--[ \t]*$", re.I | re.M)

CUT_TAGS = re.compile(r"<(head|style|script|blockquote)\b.*?(?:</\1\s*>|\Z)", re.I | re.S)
BREAK, PARAGRAPH, TAG = re.compile(r"<br\s*/?>\n?|</(?:li|tr|h\d)>", re.I), re.compile(r"</?(?:p|div|ul|ol|table)\b[^>]*>", re.I), re.compile(r"<[^>]*(?:>|\Z)|<!--.*?-->", re.S)

#: From such a line on nothing is the sender's own.
FORWARD = re.compile(
    r"^[ \t]*(?:-{2,}[ \t]*(?:original message|forwarded message|urspr\S{1,6}ngliche nachricht|weitergeleitete nachricht|message d['’]origine|message transf\S*|message original|mensaje (?:original|reenviado))[ \t]*-*"
    r"|begin forwarded message:|_{8,}[ \t]*\n(?=[ \t]*(?:from|von|de|sent|date)[ \t]*:)"
    r"|(?:from|von|de):[^\n]*\n[ \t]*(?:sent|gesendet|date|datum|envoy\S*|enviado)[ \t]*:)",
    re.I | re.M,
)
#: The line, or two, that introduces a quote.
SAID = re.compile(r"^[ \t]*(?:on|am|le|el)\b[^\n]{0,160}(?:\n[^\n]{0,80})?(?:wrote|schrieb[^\n]{0,60}|a écrit|escribió)[ \t]*:[ \t]*$", re.I | re.M)
QUOTED = re.compile(r"^[ \t]*[A-Za-z]{0,4}[>|][^\n]*$", re.M)
#: A line of signs only, from which on there is a signature, a disclaimer, or what follows them.
SIGNED = re.compile(r"^[ \t]*(?:--|-{3,}|_{3,}|\*{5,}|={5,})[ \t]*$", re.M)
#: Words of a line that may open a signature.
SHORT_LINE = 4
#: Two and three bytes of UTF-8 as Western European characters.
HIGH = "".join(bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xC0))
GARBLED = re.compile(f"[ÂÃÄÅ][{re.escape(HIGH)}]|[âä][{re.escape(HIGH)}]{{2}}")
#: Abbreviations whose dot ends no sentence.
SHORT = "".join(rf"(?<!\b{a}\.)" for a in ("Op", "op", "Art", "art", "No", "no", "Nr", "vs", "lit", "Dr", "dep"))
PARAGRAPHS, LETTERS = re.compile(r"\n\s*\n"), re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(rf"(?<=;)\s+(?=[^\sa-zß-ÿ])|(?<=[.!?…]){SHORT}[\"')\]]*\s+|\s*:-\)\s*|\s+[-–]\s+(?=[\W\d]*[A-ZÀ-Þ¿¡])|\n\s*\n|\n(?=[ \t]*(?:[*•]|\d{{1,2}}\))[ \t])")


def decoded(body: str, encoding: str, charset: str) -> str:
    """Transfer encoding and character set undone as far as they can be."""
    encoding = encoding.lower()
    if encoding == "base64":
        raw = re.sub(r"[^A-Za-z0-9+/]", "", body)
        try:
            data = base64.b64decode(raw[: len(raw) - (len(raw) % 4 == 1)] + "=" * (-len(raw) % 4))
        except (binascii.Error, ValueError):
            return ""
    elif encoding == "quoted-printable":
        data = quopri.decodestring(body.encode("utf-8", "replace"))
    else:
        return body
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    # a cut text may end inside a character; only much that is no UTF-8 speaks for another character set
    loose = data.decode("utf-8", "ignore")
    if len(loose.encode()) > len(data) - 4:
        return loose
    try:
        return data.decode(charset if charset and "utf" not in charset.lower() else "cp1252", "replace")
    except LookupError:
        return data.decode("cp1252", "replace")


def mended(text: str) -> str:
    """Text whose UTF-8 bytes were read as Western European characters, read aright; other text as it is."""
    if not GARBLED.search(text):
        return text
    try:
        return GARBLED.sub(lambda m: m.group().encode("cp1252").decode("utf-8"), text)
    except UnicodeError:
        return GARBLED.sub(lambda m: m.group().encode("cp1252", "ignore").decode("utf-8", "ignore"), text)


def leaves(text: str, depth: int = 0) -> list[tuple[str, str]]:
    """``(type, text)`` of the parts of a message that are neither containers nor attachments."""
    head, body = "", text
    if depth == 0:
        text = body = MBOX.sub("", text)
    if HEADER.match(text):
        head, _, body = text.partition("\n\n")
        if not _ and depth == 0:  # no blank line: the headers end at the first line that is none
            lines = text.split("\n")
            n = next((k for k, x in enumerate(lines) if x and x[0] not in " \t" and not HEADER.match(x)), len(lines))
            head, body = "\n".join(lines[:n]), "\n".join(lines[n:])
    kind = TYPE.search(head)
    name, rest = (kind.group(1).lower(), kind.group(2)) if kind else ("text/plain", "")
    if ATTACHED.search(head) or not name.startswith(("text/", "multipart/", "message/")):
        return []
    if name.startswith("message/") and depth:
        return []  # a forwarded message
    if name.startswith("multipart/") or PART.search(body):
        mark = BOUNDARY.search(rest)
        mark = mark and (mark.group(1) or mark.group(2))
        if mark and f"--{mark}" in body:
            parts = re.split(r"^--" + re.escape(mark) + r"(?:--)?[^\n]*\n?", body, flags=re.M)
        else:
            parts = PART.split(body)
        if len(parts) > 1 and depth < DEPTH:
            own = [x for p in parts[1:] if p.strip() for x in leaves(p.lstrip("\n"), depth + 1)]
            return own or ([("text/plain", parts[0])] if parts[0].strip() else [])
    code, charset = ENCODING.search(head), CHARSET.search(rest)
    return [(name, decoded(body, code.group(1) if code else "", charset.group(1) if charset else ""))]


def plain(markup: str) -> str:
    """Text of HTML without quoted blocks."""
    text = CUT_TAGS.sub("\n", markup)
    text = PARAGRAPH.sub("\n\n", BREAK.sub("\n", text))
    return html.unescape(TAG.sub("", text)).replace("\xa0", " ")


def own_text(text: str | None) -> str:
    """What the sender wrote in this message; empty for null, and where nothing is left."""
    if not text:
        return ""
    found = leaves(text.replace("\r\n", "\n").replace("\r", "\n"))
    words = [t for k, t in found if k != "text/html" and t.strip()]
    body = "\n\n".join(words) if words else "\n\n".join(plain(t) for k, t in found if k == "text/html")
    body = mended(body.replace("\r\n", "\n").replace("\r", "\n"))
    if words and re.search(r"<(?:html|body|p|br|div)\b", body, re.I):
        body = plain(body)
    cut = FORWARD.search(body)
    body = body[: cut.start()] if cut else body
    body = QUOTED.sub("", SAID.sub("", body))
    cut = SIGNED.search(body, len(body) - len(body.lstrip()))
    return body[: cut.start()] if cut else body


@dataclass
class Paragraph:
    """Its first line if that is short, else empty; the lines of the message that follow this one; its sentences."""

    head: str
    after: int
    sentences: list[str]


def paragraphs(own: str) -> list[Paragraph]:
    """The paragraphs with at least one letter. Lines within a paragraph belong together. A single word before a dash opens
    the sentence after it."""
    found = [p for p in PARAGRAPHS.split(own) if any(c.isalpha() for c in p)]
    lines = [[x for x in p.split("\n") if x.strip()] for p in found]
    left = sum(len(x) for x in lines)
    out = []
    for text, mine in zip(found, lines):
        head = " ".join(LETTERS.findall(mine[0].lower()))
        parts: list[str] = []
        open_ = ""
        for s in SENTENCE.split(text):
            if not s or not any(c.isalpha() for c in s):
                continue
            if len(s) < 16 and " " not in s.strip() and s.strip()[-1] not in ".!?;:":
                open_ += s + " "
            else:
                parts.append(open_ + s)
                open_ = ""
        out.append(Paragraph(head if 0 < head.count(" ") + 1 <= SHORT_LINE else "", left - 1, parts + [open_] * bool(open_)))
        left -= len(mine)
    return out


def sentences(own: str) -> list[str]:
    """Sentences with at least one letter."""
    return [s for p in paragraphs(own) for s in p.sentences]
