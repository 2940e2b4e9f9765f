"""Raw mail messages to their decoded text parts, without a full MIME parser in the hot path."""

from __future__ import annotations

import binascii
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

_TYPE = re.compile(r"(?im)^content-type:[ \t]*([^;\s]+)([^\n]*)")
_ENCODING = re.compile(r"(?im)^content-transfer-encoding:[ \t]*([\w-]+)")
_ATTACHED = re.compile(r"(?im)^content-disposition:[ \t]*attachment")
_BOUNDARY = re.compile(r"(?i)boundary[ \t]*=[ \t]*(?:\"([^\"]+)\"|([^;\s]+))")
_CHARSET = re.compile(r"(?i)charset[ \t]*=[ \t]*\"?([\w.:-]+)")
_FILE = re.compile(r"(?i)name\*?=[ \t]*\"?[^\"\n;]*\.(?:txt|text|md|csv|log)\b")
_FROM = re.compile(r"(?im)^from:[ \t]*(.*)")
_ADDRESS = re.compile(r"[\w.+'-]+@[\w.-]+")
_NOT64 = re.compile(r"[^A-Za-z0-9+/]+")
_GONE = re.compile(r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->")
_QUOTE = re.compile(r"(?is)<blockquote\b.*?(?:</blockquote\s*>|\Z)")
_BREAK = re.compile(r"(?i)</?(?:br|p|div|li|ul|ol|tr|td|th|table|h\d|body|html|hr|blockquote|pre)\b[^>]*>")
_TAG = re.compile(r"<[^<>]*>")


@dataclass(slots=True)
class Part:
    """A text part: kind is plain or html, `attached` tells a text file; `other` tells an alternative to a part before it."""

    kind: str
    text: str
    attached: bool
    other: bool = False


def decoded(body: str, encoding: str, charset: str) -> str:
    """The body after undoing its transfer encoding; damaged input gives what can be read of it."""
    if encoding == "base64":
        raw = _NOT64.sub("", body)
        try:
            data = binascii.a2b_base64(raw[: len(raw) // 4 * 4 + (len(raw) % 4 if len(raw) % 4 > 1 else 0)] + "=" * (-len(raw) % 4 if len(raw) % 4 > 1 else 0))
        except binascii.Error:
            return body
    elif encoding == "quoted-printable":
        data = binascii.a2b_qp(body.encode("utf-8", "replace"))
    else:
        return body
    try:
        return data.decode(charset or "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def split_head(text: str) -> tuple[str, str]:
    """Headers, unfolded, and body."""
    if text.startswith("\n"):
        return "", text[1:]
    head, _, body = text.partition("\n\n")
    return re.sub(r"\n[ \t]+", " ", head), body


def _walk(whole: str, out: list[Part]) -> None:
    """Adds the parts of a message in order; multiparts may be nested to any depth."""
    todo: list[tuple[str, bool]] = [(whole, False)]
    while todo:
        text, other = todo.pop()
        todo += reversed(list(_pieces(text, other, out)))


def _pieces(text: str, other: bool, out: list[Part]) -> Iterator[tuple[str, bool]]:
    """The pieces of a multipart, with whether they are alternatives to one before; any other part is added to `out`."""
    head, body = split_head(text)
    kind = _TYPE.search(head)
    name, rest = (kind[1].lower(), kind[2]) if kind else ("text/plain", "")
    if name.startswith("multipart/") and (m := _BOUNDARY.search(rest)):
        mark = re.escape(m[1] or m[2])
        pieces = re.split(rf"(?m)^--{mark}(?:--)?[ \t]*(?:\n|\Z)", body)
        if len(pieces) > 1:
            first = True
            for piece in pieces[1:]:
                if piece.strip():
                    yield piece, name == "multipart/alternative" and not first
                    first = False
            return
    elif name == "message/rfc822":
        yield body, other
        return
    attached = bool(_ATTACHED.search(head))
    if name == "text/html" or name.startswith("text/") or name.startswith("multipart/") or (attached and _FILE.search(head)):
        enc, cs = _ENCODING.search(head), _CHARSET.search(rest)
        text = decoded(body, enc[1].lower() if enc else "", cs[1] if cs else "").replace("\r\n", "\n")
        out.append(Part("html" if name == "text/html" else "plain", text, attached, other))


def parts(message: str | None) -> list[Part]:
    """The text parts of a raw message in order: plain, HTML and attached text files. None and '' have none."""
    if not message:
        return []
    text = message.replace("\r\n", "\n").replace("\r", "\n")
    while text.startswith(("From ", ">From ")):
        text = text.partition("\n")[2]
    out: list[Part] = []
    _walk(text, out)
    return out


def plain(markup: str, without_quotes: bool = False) -> str:
    """HTML without its tags; breaks of blocks become line breaks. without_quotes: quoted blocks are left out."""
    text = _GONE.sub(" ", markup)
    if without_quotes:
        text = _QUOTE.sub("\n", text)
    return html.unescape(_TAG.sub("", _BREAK.sub("\n", text)))


def sender(message: str | None) -> str:
    """The address of the From header, lower-cased; '' without one."""
    if not message:
        return ""
    head = message[: message.find("\n\n") if "\n\n" in message else len(message)]
    if "\r\n\r\n" in message[: len(head) + 4]:
        head = message.partition("\r\n\r\n")[0]
    m = _FROM.search(head)
    a = _ADDRESS.search(m[1]) if m else None
    return a[0].lower() if a else ""
