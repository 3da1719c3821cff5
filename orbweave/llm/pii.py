"""Personal data by anchor expansion.

One Aho-Corasick automaton walks each text and finds anchors: at-signs, plus signs, digits, `://` and cue words such as
`token` or `iban`. From an anchor a parser of its kind expands to both sides over the characters its kind allows, and
validates what it has found (number ranges, lengths, the Luhn sum). No parser looks further than its own run of characters,
so a text costs time in proportion to its length, whatever it holds.

Base kinds: email, ip, card, phone. The method adds url (one that carries a login) and account (a cue word's value).
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, bounded_batches, table

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "url", "account"]
#: The words after which a value follows that identifies a person or an account.
CUES = ["token", "secret", "password", "passwd", "api key", "api_key", "apikey", "account", "acct", "iban", "ssn", "passport"]

LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
SCHEME = frozenset(string.ascii_letters + string.digits + "+.-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOGIN = re.compile(r"://[^\s/?#@:]+(?::[^\s/?#@]*)?@[^\s/?#@]+")
VALUE = re.compile(r"(?:[\x20\t]*(?:no\.?|number|id|key))?[\x20\t]*[:=#][\x20\t]*[\"']?([A-Za-z0-9][A-Za-z0-9_+/=-]{5,})", re.I)


def anchors() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for mark in ["@", "+", *string.digits]:
        machine.add_word(mark, (mark if mark in "@+" else "0", 1))
    machine.add_word("://", (":", 3))
    for cue in CUES:
        for form in {cue, cue.capitalize(), cue.title(), cue.upper()}:
            machine.add_word(form, ("c", len(form)))
    machine.make_automaton()
    return machine


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def find(text: str, machine: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """The spans (start, end, kind) of one text in code points, by start and then kind; of a kind none overlap."""
    out: list[tuple[int, int, str]] = []
    email = ip = card = phone = url = account = 0  # where each kind's last match ended, kept or dropped
    for last, (mark, size) in machine.iter(text):
        at = last - size + 1
        if mark == "0":
            if at >= ip and (at == 0 or not "0" <= text[at - 1] <= "9"):
                if m := IP.match(text, at):
                    ip = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                        out.append((at, ip, "ip"))
            if at >= card and (m := CARD.match(text, at)):
                card = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((at, card, "card"))
        elif mark == "@":
            start = at
            while start > email and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                email = m.end()
                out.append((start, email, "email"))
        elif mark == "+":
            if at >= phone and (m := PHONE.match(text, at)):
                phone = m.end()
                if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    out.append((at, phone, "phone"))
        elif mark == ":":
            start = at
            while start > url and text[start - 1] in SCHEME:
                start -= 1
            if start < at and (m := LOGIN.match(text, at)):
                url = m.end()
                out.append((start, url, "url"))
        elif at >= account and not (at and text[at - 1].isalnum()) and (m := VALUE.match(text, last + 1)) and any(c.isdigit() for c in m.group(1)):
            account = m.end(1)
            out.append((m.start(1), account, "account"))
    out.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return out


SPANS = "array<struct<kind:string,start:int,end:int>>"


def find_pii(df: DataFrame, text: str = "text", to: str = "spans") -> DataFrame:
    """df with one more column: the spans (kind, start, end) found in text, in code points, end exclusive.

    A null or empty text has none. Whole texts are read, of any length; rows that repeat get equal results, and
    an empty table gives an empty one. Other columns stay as they are; a column called `to` is replaced.
    """
    bounded_batches(df.sparkSession)
    own = "_ow_text"
    rows = df.drop(to).withColumn(own, F.col(text))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = anchors()
        for block in blocks(batches, own):
            found = [[{"kind": k, "start": a, "end": b} for a, b, k in find(t, machine)] if t else [] for t in block.column(own).to_pylist()]
            rest = block.drop_columns([own])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(found, kind)], [*rest.schema.names, to])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes if c != own), f"`{to}` {SPANS}"])
    return rows.mapInArrow(look, schema)


def masked(df: DataFrame, text: str = "text") -> DataFrame:
    """df with every span of text replaced by its kind in angle brackets; of overlapping spans the first one's kind shows."""
    own = "_ow_spans"
    found = find_pii(df, text, own)
    clear = F.aggregate(
        own,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, x: F.when(x["start"] < s["at"], F.struct(s["out"].alias("out"), F.greatest(s["at"], x["end"]).alias("at"))).otherwise(
            F.struct(F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, x["start"] - s["at"]), F.lit("<"), x["kind"], F.lit(">")).alias("out"), x["end"].alias("at"))
        ),
        lambda s: F.concat(s["out"], F.substr(F.col(text), s["at"] + 1)),
    )
    return found.withColumn(text, clear).drop(own)


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["kind"].isin(BASE))
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
