"""Personal data by anchor expansion.

One Aho-Corasick pass per text finds anchors: at-signs, digits, plus signs, schemes and cue words. A local parser
for each kind reads outwards from its anchor to the boundaries of the value and validates it. Nothing
but the neighbourhood of an anchor is looked at again, so the cost is linear in the text.

Kinds: email, ip, card, phone (the base kinds), then url (a scheme with user data before an at-sign), account (an
identifier behind a cue such as IBAN or SSN) and secret (a value given to password, token and the like).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "secret")

LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
DIGITS = frozenset("0123456789")
LOCAL = LETTERS | DIGITS | frozenset("._%+-")
LABEL = LETTERS | DIGITS | frozenset("-")

SCHEMES = ("://",)
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "cuenta", "compte", "ssn", "passport", "routing")
SECRET_CUES = ("password", "passwd", "secret", "token", "api_key", "apikey", "access_key")

NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])*")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
RUN = re.compile(r"[0-9]+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# between a cue and its value: a number word or a sign
STATES = re.compile(r"(?:[ ]?(?i:no|nr|num|number)\b\.?[ ]?[:=#]?|[ ]?[:=#])[ ]?(?!(?i:is)[ ])")
GROUP = re.compile(r"[A-Za-z0-9]+")
# behind blanks or "is": an IBAN, groups of digits or one word with digits
STATED = re.compile(
    r"(?:[ \t]*+(?i:no|nr|num|number)\b\.?)?(?:[ \t]*+[:=#])?(?:[ \t]++(?i:is)\b)?(?:[ \t]*+[:=#])?[ \t]++(?:"
    r"([A-Za-z]{2}[0-9]{2}(?:[ -]?[A-Za-z0-9]){11,30})|([0-9](?:[ -]?[0-9]){5,}+)(?![A-Za-z0-9])|([A-Za-z0-9]{6,}+))")
WORD_END = re.compile(r"(?<=[A-Za-z0-9])(?![A-Za-z0-9])")
STATED_PLAIN = re.compile(r"[A-Za-z0-9]{6,}+")
# a quoted value of any characters but the quote and line ends, else all up to a blank, quote or angle bracket
SECRET = re.compile(r"[ ]?[:=][ ]?(?:\"([^\"\n]{8,}+)\"|'([^'\n]{8,}+)'|[\"']?([^\s\"'<>]{8,}+))")
CLOSING = ".,;:!?)]}"
# user data of a scheme, then its host
USER = re.compile(r"[^\s/?#@]++@" + DOMAIN.pattern)


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    anchors = {"@": "at", "+": "plus"} | {d: "digit" for d in DIGITS} | {s: "scheme" for s in SCHEMES}
    for cues, kind in ((ACCOUNT_CUES, "account"), (SECRET_CUES, "secret")):
        for cue in cues:
            anchors[cue] = kind
    for anchor, kind in anchors.items():
        found.add_word(anchor, (kind, len(anchor)))
    found.make_automaton()
    return found


ANCHORS = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban(value: str) -> bool:
    value = value.upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", value):
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _ascii_lower(text: str) -> str:
    """A to Z in lower case and nothing else changed, so positions stay."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _account(text: str, at: int) -> tuple[int, int] | None:
    """(start, end) of the account number at a place: the longest IBAN, else the groups with digits that follow each other,
    parted by a blank or hyphen, if they hold six digits or more. Capitals in front of the first belong to it."""
    end, size, whole = at, 0, 0
    while size <= 34 and (group := GROUP.match(text, end)):
        end, size = group.end(), size + len(group[0])
        if 15 <= size <= 34 and iban(re.sub(r"[ -]", "", text[at:end])):
            whole = end
        if text[end:end + 1] not in (" ", "-"):
            break
        end += 1
    if whole:
        return at, whole
    start, end, stop, digits = at, at, at, 0
    while group := GROUP.match(text, end):
        held = sum(c in DIGITS for c in group[0])
        if not held and (digits or end > at):
            break
        if held:
            if not digits and not text[at:end].isupper():
                start = end
            digits, stop = digits + held, group.end()
        end = group.end()
        if text[end:end + 1] not in (" ", "-"):
            break
        end += 1
    return (start, stop) if digits >= 6 else None


def _stated(text: str, at: int) -> tuple[int, int] | None:
    """(start, end) of an account number that follows its cue without a colon and passes its validation."""
    value = STATED.match(text, at)
    if not value:
        return None
    if value[1]:
        start = value.start(1)
        for end in sorted((m.start() for m in WORD_END.finditer(text, start, value.end(1) + 1)), reverse=True):
            if end <= value.end(1) and iban(re.sub(r"[ -]", "", text[start:end])):
                return start, end
        value = STATED_PLAIN.match(text, start)
        return value.span() if value and sum(c in DIGITS for c in value[0]) >= 6 else None
    group = 2 if value[2] else 3
    return value.span(group) if sum(c in DIGITS for c in value[group]) >= 6 else None


def spans(text: str) -> list[tuple[int, int, str]]:
    """All (start, end, kind), ends exclusive, in code points, ordered by start, then kind.

    Per kind, spans do not overlap: leftmost first, as a scan with the kind's pattern gives them; a match
    that fails its check is passed over as a whole.
    """
    out: list[tuple[int, int, str]] = []
    mail_end = dotted_end = number_end = phone_end = url_end = secret_end = account_end = 0
    for last, (kind, size) in ANCHORS.iter(_ascii_lower(text)):
        at = last + 1 - size
        if kind == "digit":
            if at >= number_end:
                number_end = NUMBER.match(text, at).end()
                digits = text[at:number_end].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((at, number_end, "card"))
            if at >= dotted_end:
                dotted_end = DOTTED.match(text, at).end()
                parts = [m.span() for m in RUN.finditer(text, at, dotted_end)]
                for i in range(0, len(parts) - 3, 4):
                    if all(_octet(text[a:b]) for a, b in parts[i:i + 4]):
                        out.append((parts[i][0], parts[i + 3][1], "ip"))
        elif kind == "at":
            start = at
            while start > mail_end and text[start - 1] in LOCAL:
                start -= 1
            domain = DOMAIN.match(text, at + 1) if start < at else None
            if domain:
                mail_end = domain.end()
                out.append((start, mail_end, "email"))
        elif kind == "plus":
            number = PHONE.match(text, at) if at >= phone_end else None
            if number:
                phone_end = number.end()
                if 9 <= sum(c in DIGITS for c in number[0]) <= 15:
                    out.append((at, phone_end, "phone"))
        elif kind == "scheme":
            start = at
            while start > url_end and text[start - 1] in LABEL:
                start -= 1
            user = USER.match(text, at + 3)
            if start < at and user:
                url_end = user.end()
                out.append((start, url_end, "url"))
        elif kind == "secret":
            value = SECRET.match(text, at + size) if at >= secret_end else None
            if value:
                group = next(i for i in (1, 2, 3) if value[i] is not None)
                start, end = value.span(group)
                if group == 3:  # marks that close a sentence or bracket are not part of it
                    end -= len(value[3]) - len(value[3].rstrip(CLOSING))
                if end - start >= 8 and any(c in DIGITS for c in text[start:end]):
                    secret_end = end
                    out.append((start, end, "secret"))
        else:
            if at < account_end:
                continue
            states = STATES.match(text, at + size)
            stated = _account(text, states.end()) if states else None
            stated = stated or _stated(text, at + size)
            if stated:
                account_end = stated[1]
                out.append((*stated, "account"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def redact(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, end = [], 0
    for a, b, kind in spans(text):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join(out) + text[end:] if out else text


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, spans array<struct<start, end, kind>>.

    Null and empty texts have no spans; very long texts are read whole; repeated rows are treated
    alike; an empty table gives no rows; other columns are ignored. Row by row, no shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [[{"start": a, "end": b, "kind": k} for a, b, k in spans(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(item))], names=["id", "spans"])

    return docs.select(F.col(id_col).alias("id"), text.alias("text")).mapInArrow(
        run, f"id {kind}, spans array<struct<start: long, end: long, kind: string>>"
    ).withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data masked in the text. Null and empty texts stay as they are; repeated
    rows are masked alike; very long texts are read whole; an empty table stays empty; other columns are untouched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for piece in slices([batch], at):
                texts = [None if t is None else redact(t) for t in piece.column(at).to_pylist()]
                columns = list(piece.columns)
                columns[at] = pa.array(texts, piece.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=piece.schema)

    return docs.mapInArrow(run, docs.schema)


def digest(found: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in found).encode()).hexdigest()
