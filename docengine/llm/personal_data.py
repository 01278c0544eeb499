"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text: at-signs, plus signs, digits, schemes and words that announce
an identifier. From each anchor a small parser expands to both sides and checks what it has found, so that texts
are scanned once, whatever the number of kinds. Matches of one kind never overlap, the leftmost comes first.

Kinds found from their form alone:
  email    `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, from its at-sign
  ip       four groups of digits with dots between, each at most 255, from its first digit
  card     digits with at most one space or hyphen between two, 16 to 19 of them, with Luhn's check digit
  phone    `\\+[0-9][\\x20().0-9-]+[0-9]` with 8 to 15 digits, from its plus sign
Kinds that need their surroundings:
  url      an address whose scheme is followed by a user's name, with or without password (`https://me:secret@host/...`)
  account  the identifier (six characters at least, one of them a digit) that a cue word announces, and access key ids
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, release, ship

#: Kinds in the order of their spans; the first four are found from their form alone.
KINDS = ("email", "ip", "card", "phone", "url", "account")
#: Words before an identifier; those of SECRETS need a colon or an equals sign after them.
CUES = ("account", "acct", "iban", "passport", "ssn")
SECRETS = ("api key", "api_key", "apikey", "passwd", "password", "pwd", "secret", "token")
#: What an access key's id begins with.
KEY_ID = "akia"
#: Characters of a text that the automaton reads at a time, and those of the longest anchor.
WINDOW, LONGEST = 1 << 20, 16

_LOWERED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[a-z0-9-]++(?:\.[a-z0-9-]++)++")
_IP = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_DIGITS = re.compile(r"[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SCHEMES = frozenset(("ftp", "ftps", "git", "http", "https", "imap", "ldap", "mysql", "postgres", "postgresql", "redis", "sftp", "smtp", "ssh", "ws", "wss"))
_USER = re.compile(r"[^\s/?#@\"'<>]++@[a-z0-9.-]++[^\s\"'<>]*+")
_SIGN = r"[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?"
_GROUP = r"(?=[a-z]*+[0-9])[a-z0-9]++"
_AFTER_SECRET = re.compile(_SIGN + r"([a-z0-9][^\s\"'<>,;]*+)")
_AFTER_CUE = re.compile(r"(?: (?:id|no\.?|nr\.?|number))?(?:" + _SIGN + r"| ?# ?| (?:is )?)(" + _GROUP + "(?:[ -]" + _GROUP + ")*+)")
_KEY_ID = re.compile(r"[a-z0-9]{16}(?![a-z0-9])")


def anchors() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, words in (("@", "@"), ("+", "+"), ("0", "0123456789"), ("://", ("://",)), ("cue", CUES), ("secret", SECRETS), ("key", (KEY_ID,))):
        for word in words:
            out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * d - 9 * (d > 4) for d in map(int, even))) % 10 == 0


def byte(group: str) -> bool:
    """Whether a group of digits, however long, is at most 255."""
    group = group.lstrip("0")
    return len(group) < 3 or (len(group) == 3 and group <= "255")


class Finder:
    """Finds the spans of a whole text. `low` is the text with A-Z in lower case; positions are code points."""

    def __init__(self) -> None:
        self.automaton = anchors()

    def hits(self, low: str) -> Iterator[tuple[int, str, int]]:
        """Anchors as (start, kind, end), by end; no window of the text is longer than WINDOW and an anchor."""
        for base in range(0, len(low), WINDOW):
            part = low if len(low) <= WINDOW else low[base : base + WINDOW + LONGEST]
            for last, (kind, n) in self.automaton.iter(part):
                if last - n + 1 < WINDOW:
                    yield base + last - n + 1, kind, base + last + 1

    def find(self, text: str) -> list[tuple[str, int, int]]:
        """Spans (kind, start, end) of a text, by kind as in KINDS, then start."""
        low = text.lower() if text.isascii() else text.encode().translate(_LOWERED).decode()
        found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        done = dict.fromkeys(KINDS, 0)

        def put(kind: str, start: int, end: int) -> None:
            found[kind].append((start, end))
            done[kind] = end

        def before(at: int) -> bool:
            """Whether a word can begin at this place."""
            return at == 0 or not (low[at - 1].isalnum() or low[at - 1] == "_")

        for at, kind, end in self.hits(low):
            if kind == "0":
                if at >= done["card"]:
                    run = _CARD.match(low, at)
                    if run:
                        digits = run[0].replace(" ", "").replace("-", "") if run.end() - at < 40 else ""
                        if 16 <= len(digits) <= 19 and luhn(digits):
                            found["card"].append((at, run.end()))
                    done["card"] = run.end() if run else end
                if at >= done["ip"]:
                    quad = _IP.match(low, at)
                    if quad and all(map(byte, quad.groups())):
                        found["ip"].append((at, quad.end()))
                    done["ip"] = quad.end() if quad else _DIGITS.match(low, at).end()
            elif kind == "@":
                start = at
                while start > done["email"] and low[start - 1] in _LOCAL:
                    start -= 1
                domain = _DOMAIN.match(low, end) if start < at else None
                if domain:
                    put("email", start, domain.end())
            elif kind == "+":
                number = _PHONE.match(low, at)
                if number and 8 <= sum(map(str.isdigit, number[0])) <= 15:
                    put("phone", at, number.end())
            elif kind == "://":
                start = at
                while start > done["url"] and at - start < LONGEST and low[start - 1] in _LOCAL:
                    start -= 1
                while start < at and low[start:at] not in _SCHEMES:
                    start += 1
                rest = _USER.match(low, end) if start < at and before(start) else None
                if rest:
                    put("url", start, end + len(rest[0].rstrip(".,:;!?)]}")))
            elif at >= done["account"] and before(at):
                if kind == "key":
                    rest = _KEY_ID.match(low, end)
                    if rest and text[at : rest.end()] == text[at : rest.end()].upper():
                        put("account", at, rest.end())
                else:
                    rest = (_AFTER_SECRET if kind == "secret" else _AFTER_CUE).match(low, end)
                    value = rest[1].rstrip(".:!?)]}") if rest else ""
                    if len(value) >= 6 and any(map(str.isdigit, value)):
                        put("account", rest.start(1), rest.start(1) + len(value))
                    elif rest:
                        done["account"] = rest.end()  # nothing begins within what has failed
        return [(kind, a, b) for kind in KINDS for a, b in found[kind]]


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the column spans: array of (kind, start, end), by kind as in KINDS, then start; code points, end exclusive.

    Null and empty texts have no spans. Texts are read whole, in windows, however long. Rows are judged one by one:
    repeated rows get the same spans, ties and other columns don't matter. The column gets underscores in front
    where docs has such a name. Empty input: empty result. One scan, no shuffle.
    """
    ship(docs.sparkSession)
    (name,) = fresh(docs.columns, "spans")
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField(name, kind)])
    at = docs.columns.index(text_col)
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in finder.find(t or "")] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, arrow)], names=schema.names)
        release()

    return docs.mapInArrow(run, schema)


def masked(text: Column, spans: Column) -> Column:
    """The text with each span's place taken by its kind in angle brackets (overlapping spans become one, of the first kind)."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    text = F.coalesce(text, F.lit(""))

    def step(done: Column, s: Column) -> Column:
        new = F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int")), F.lit("<"), s["kind"], F.lit(">"))
        return F.struct(F.when(s["start"] >= done["at"], new).otherwise(done["out"]).alias("out"), F.greatest(done["at"], s["end"]).alias("at"))

    return F.aggregate(ordered, begin, step, lambda d: F.concat(d["out"], F.substring(text, (d["at"] + 1).cast("int"), F.lit(2147483647))))
