"""Personal data by anchor expansion.

One Aho-Corasick pass finds at-signs, plus signs, digits, schemes and cue words.
At each anchor a deterministic parser expands to both sides, stays clear of what
its kind has already taken, and validates. So the base kinds come out as the
leftmost non-overlapping matches of their patterns, each kind on its own; cues
add IBANs, social security numbers, account numbers, logins in addresses, and
secrets: what a cue such as token or api key assigns, 16 characters or more with a
digit.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partmill.llm.common import mapped, ship, table, text_bytes

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "account", "login", "secret")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
RUN = re.compile(r"[0-9](?:[ -]?[0-9])+")
CALL = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"[\s:#.]{0,4}((?:[A-Z]{2}[0-9]{2})(?: ?[A-Z0-9]){11,30})")
SSN = re.compile(r"[^0-9\n]{0,12}(?<![0-9])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
ACCOUNT = re.compile(r"(?: *(?:number|no\.?|#))? *[:#=]? *([0-9]{8,17})(?![0-9])")
USERINFO = re.compile(r"([^\s/@:?#]+):([^\s/@?#]+)@([A-Za-z0-9.-]+)(?::[0-9]+)?")
SECRET = re.compile(r"""["']? ?(?:[:=]|is|=>)? ?["']?([A-Za-z0-9_./+=-]{16,})""")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
CUES = {"token": "secret", "secret": "secret", "password": "secret", "api key": "secret", "api_key": "secret", "apikey": "secret", "bearer": "secret", "iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account"}


def _automaton():
    found = ahocorasick.Automaton()
    for word, what in [("@", "at"), ("+", "plus"), ("://", "scheme"), *((d, "digit") for d in "0123456789")]:
        found.add_word(word, (what, len(word)))
    for cue, what in CUES.items():
        for word in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            found.add_word(word, (what, len(word)))
    found.make_automaton()
    return found


ANCHORS = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def sound_iban(text: str) -> bool:
    code = text.replace(" ", "")
    code = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in code)) % 97 == 1


def spans_of(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in order of their start; code points, end exclusive."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email = ip = card = login = 0
    for last, (what, length) in ANCHORS.iter(text):
        at = last + 1 - length
        if what == "digit":
            if at >= card and (m := RUN.match(text, at)):
                card = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
            if at >= ip and (at == ip or at == 0 or text[at - 1] not in DIGITS) and (m := QUAD.match(text, at)):
                ip = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    out["ip"].append(m.span())
        elif what == "at":
            start = at
            while start > email and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                email = m.end()
                out["email"].append((start, email))
        elif what == "plus":
            if (m := CALL.match(text, at)) and 9 <= sum(c in DIGITS for c in m[0]) <= 15:
                out["phone"].append(m.span())
        elif what == "scheme":
            start = at
            while start > login and text[start - 1] in SCHEME:
                start -= 1
            if start < at and (m := USERINFO.match(text, at + 3)):
                login = m.end()
                out["login"].append((start, login))
        elif what == "iban":
            if m := IBAN.match(text, last + 1):
                ends = [m.start(1) + k for k in range(len(m[1]), 14, -1) if m[1][k - 1] != " "]
                if end := next((e for e in ends if sound_iban(text[m.start(1) : e])), 0):
                    out["iban"].append((m.start(1), end))
        elif what == "ssn":
            if (m := SSN.match(text, last + 1)) and m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
                out["ssn"].append((m.start(1), m.end(3)))
        elif what == "secret":
            if (m := SECRET.match(text, last + 1)) and any(c in DIGITS for c in m[1]) and (not out["secret"] or out["secret"][-1][1] <= m.start(1)):
                out["secret"].append(m.span(1))
        elif (m := ACCOUNT.match(text, last + 1)) and (not out["account"] or out["account"][-1] != m.span(1)):
            out["account"].append(m.span(1))
    for kind in ("iban", "ssn"):
        out[kind] = sorted(set(out[kind]))
    return out


def listed(spans: dict[str, list[tuple[int, int]]], kinds=KINDS) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, spans (array of kind, start, end) and the digest columns for each row.

    A null text is empty. Spans of different kinds may overlap. Other columns
    are not read; repeated rows give repeated results.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_iban long, n_ssn long, n_account long, n_login long, n_secret long, n_spans long, base_sha256 string, spans string, found array<struct<kind:string,start:int,end:int>>"

    def run(b: pa.RecordBatch) -> dict:
        got = [spans_of(t.decode()) for t in b.column(1).to_pylist()]
        out = {"doc_id": b.column(0)} | {f"n_{k}": [len(s[k]) for s in got] for k in KINDS}
        out["n_spans"] = [sum(map(len, s.values())) for s in got]
        out["base_sha256"] = [hashlib.sha256(listed(s, BASE).encode()).hexdigest() for s in got]
        out["spans"] = [listed(s) for s in got]
        out["found"] = [[{"kind": k, "start": a, "end": e} for k in KINDS for a, e in s[k]] for s in got]
        return out

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()), run, schema)


def op9_private(spark, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents")).drop("found")
