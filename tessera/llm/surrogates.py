"""Operator 10: surrogates for personal data.

Detected in every whole text: e-mail addresses, phone numbers, IPv4 addresses,
payment card numbers, access keys, secrets in assignments (token, password,
...) and person names after a title.  Each entity gets a replacement that is a
keyed function of its type and canonical form, so the same entity has the same
surrogate in all texts and in all its spellings (coreference), and that fits
the mention: digits for digits, letters for letters in the mention's case,
separators where they were, names of the same gender and script.  A surname
that a text introduces with a title is also replaced where it stands alone.

Distinctness is checked over the whole corpus: a surrogate that equals another
entity's, or that is itself a real entity, is drawn again (the entity with the
smallest form keeps it) until none is left.  Entities on their first draw need
no lookup; only drawn-again ones are joined to the documents that hold them.

Null texts stay null, empty ones empty.  Repeated rows are replaced alike.
Rows that share an id share the lookup, which is by entity and so harmless.
Overlapping matches: the one that starts first, then the type listed first.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_IDS, stored

KEY = b"tessera surrogates"  # a caller's secret in production

#: Titles before a name, by gender.
TITLES = {"m": ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "господин", "κύριος"],
          "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "κυρία"],
          "n": ["Dr", "Prof"]}
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_GENDER = {t.lower(): g for g, ts in TITLES.items() for t in ts}

#: Syllables and endings (by gender) of made-up names, per script.
_NAMES = {
    "latin": ("b d f g h j k l m n p r s t v br dr kl st tr".split(), "a e i o u ai ei".split(),
              {"m": ["n", "rt", "ld", "s"], "f": ["la", "na", "ra", "sia"], "n": ["l", "m", "r", "k"]}),
    "cyrillic": ("б в г д ж з к л м н п р с т др ст тр".split(), "а е и о у я ё".split(),
                 {"m": ["н", "р", "й", "слав"], "f": ["на", "ла", "ра", "ся"], "n": ["ль", "м", "к", "т"]}),
    "greek": ("β γ δ ζ κ λ μ ν π ρ σ τ φ στ τρ".split(), "α ε η ι ο υ ω".split(),
              {"m": ["ος", "ης", "ας", "ων"], "f": ["να", "λα", "ρα", "νη"], "n": ["λ", "ν", "ρ", "κ"]}),
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_PATTERN = re.compile("|".join([
    r"(?P<email>[^\W_](?:[\w.+-]*[^\W_])?@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,})",
    r"(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d))",
    rf"(?P<ip>(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.\d))",
    r"(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]))",
    r"(?P<key>(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w))",
    r"(?P<secret>(?<=[=:])[ ]?[\"']?(?P<hidden>[A-Za-z0-9+/_-]{12,})(?![\w]))",
    rf"(?P<name>(?<!\w)(?P<title>{_TITLE})\.? (?P<whole>[^\W\d_]['’\w-]+(?: [A-ZÀ-ÞΑ-ΩА-Я]['’\w-]+)?))",
]))
_ASSIGNED = re.compile(r"(?i)(?:token|password|passwd|secret|api[_-]?key|pwd|access[_-]?key)[\"']?\s*[=:]$")
_MAY_HOLD = re.compile(rf"[@\d]|[=:]|(?<!\w)(?:{_TITLE})\.? ")


def script_of(word: str) -> str:
    c = word[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def canonical(kind: str, raw: str) -> str:
    if kind in ("phone", "card"):
        return re.sub(r"\D", "", raw)
    if kind == "ip":
        return ".".join(str(int(x)) for x in raw.split("."))
    return raw.lower()


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical form) in order, not overlapping."""
    if not text or not _MAY_HOLD.search(text):
        return []
    out, surnames = [], {}
    for m in _PATTERN.finditer(text):
        kind = m.lastgroup if m.lastgroup in ("email", "phone", "ip", "card", "key") else "secret" if m["secret"] else "name"
        if kind == "secret":
            if _ASSIGNED.search(text[max(0, m.start() - 24):m.start()]):
                out.append((m.start("hidden"), m.end("hidden"), kind, canonical(kind, m["hidden"])))
        elif kind == "name":
            if not m["whole"][0].isupper():
                continue
            parts, at, gender = m["whole"].split(" "), m.start("whole"), _GENDER[m["title"].lower()]
            for i, p in enumerate(parts):
                what = f"surname:{script_of(p)}" if i == len(parts) - 1 else f"given:{gender}:{script_of(p)}"
                out.append((at, at + len(p), what, p.lower()))
                at += len(p) + 1
            surnames[parts[-1]] = what
        else:
            out.append((m.start(), m.end(), kind, canonical(kind, m[kind])))
    if surnames:  # where a surname stands alone
        taken = np.zeros(len(text) + 1, dtype=bool)
        for s, e, _, _ in out:
            taken[s:e] = True
        alone = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(surnames))) + r")(?!\w)")
        out += [(m.start(), m.end(), surnames[m[0]], m[0].lower()) for m in alone.finditer(text) if not taken[m.start():m.end()].any()]
        out.sort()
    return out


def _stream(key: bytes, kind: str, value: str, draw: int):
    """Endless keyed numbers below 2^32."""
    block = 0
    while True:
        d = hmac.new(key, f"{kind}\0{value}\0{draw}\0{block}".encode("utf-8", "surrogatepass"), hashlib.sha256).digest()
        yield from np.frombuffer(d, "<u4").tolist()
        block += 1


def _like(s: str, r, keep: str = "") -> str:
    """Random characters of the same kinds; others stay."""
    out = []
    for c in s:
        if c in keep:
            out.append(c)
        elif c.isdigit():
            out.append("0123456789"[next(r) % 10])
        elif c.isalpha():
            out.append("abcdefghijklmnopqrstuvwxyz"[next(r) % 26])
        else:
            out.append(c)
    return "".join(out)


def surrogate(key: bytes, kind: str, value: str, draw: int) -> str:
    """The canonical form of the replacement."""
    r = _stream(key, kind, value, draw)
    if kind == "ip":
        return ".".join(str(1 + next(r) % 254) for _ in range(4))
    if kind == "email":
        local, _, domain = value.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{_like(local, r)}@{_like(host, r)}.{top}"
    if kind == "phone":  # the country code stays
        return value[0] + _like(value[1:], r)
    if kind == "key":
        return value[:4] + "".join("abcdefghijklmnopqrstuvwxyz234567"[next(r) % 32] for _ in value[4:])
    if kind == "secret" and re.fullmatch("[0-9a-f]+", value):
        return "".join("0123456789abcdef"[next(r) % 16] for _ in value)
    if kind.startswith(("given", "surname")):
        gender, script = (kind.split(":") + ["n"])[1:3] if kind.startswith("given") else ("n", kind.split(":")[1])
        first, vowel, ends = _NAMES[script]
        body = "".join(first[next(r) % len(first)] + vowel[next(r) % len(vowel)] for _ in range(2 + next(r) % 2))
        return body + ends[gender][next(r) % 4]
    return _like(value, r)


def fitted(kind: str, mention: str, form: str) -> str:
    """The canonical replacement in the mention's format."""
    if kind in ("phone", "card"):
        digits = iter(form)
        return "".join(next(digits) if c.isdigit() else c for c in mention)
    if mention.isupper() and mention.lower() != mention:
        return form.upper()
    return form[0].upper() + form[1:] if kind.startswith(("given", "surname")) else form


def distinct_surrogates(entities: DataFrame, key: bytes = KEY) -> DataFrame:
    """(type, value, draw, form) of distinct entities (type, value): no form
    twice within a type, and none that is a value."""
    @F.pandas_udf("string")
    def form_of(kind: pd.Series, value: pd.Series, draw: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, k, v, d) for k, v, d in zip(kind, value, draw)], dtype=object)

    drawn = stored(entities.withColumn("draw", F.lit(0)).withColumn("form", form_of("type", "value", F.lit(0))))
    while True:
        real = drawn.select("type", F.col("value").alias("form")).withColumn("real", F.lit(True))
        keeper = drawn.groupBy("type", "form").agg(F.min("value").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        bad = drawn.join(real, ["type", "form"], "left").join(keeper, ["type", "form"], "left").where(
            "real OR value <> keeper").select("type", "value")
        bad = stored(bad)
        if bad.isEmpty():
            return drawn
        again = drawn.join(bad.withColumn("again", F.lit(1)), ["type", "value"], "left").withColumn(
            "draw", F.col("draw") + F.coalesce("again", F.lit(0)))
        drawn = stored(again.withColumn("form", F.when(F.col("again").isNotNull(), form_of("type", "value", "draw")).otherwise(F.col("form"))).drop("again"))


_FOUND = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("surrogate", pa.string())]))


def replace_entities(docs: DataFrame, key: bytes = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: the id, `text` with surrogates, and `entities`:
    (type, start, end, surrogate) with code point places in the given text."""
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def detect(it):
        for b in it:
            ids, kinds, values = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for kind, value in {(k, v) for _, _, k, v in mentions(t)} if t else ():
                    ids.append(i)
                    kinds.append(kind)
                    values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(kinds, pa.string()), pa.array(values, pa.string())],
                                             names=["id", "type", "value"])

    held = stored(source.mapInArrow(detect, f"id {id_type}, type string, value string"))
    drawn = distinct_surrogates(held.select("type", "value").distinct(), key)
    again = held.join(drawn.where("draw > 0"), ["type", "value"]).groupBy("id").agg(  # a text's own entities
        F.collect_set(F.struct("type", "value", "draw")).alias("again"))
    again = stored(again.withColumnRenamed("id", "of"))
    small = again.limit(BROADCAST_IDS // 10 + 1).count() <= BROADCAST_IDS // 10
    joined = source.join(F.broadcast(again) if small else again, source.id.eqNullSafe(again.of), "left").select("id", "text", "again")

    def replace(it):
        @functools.lru_cache(maxsize=100_000)
        def form(kind, value, draw):
            return surrogate(key, kind, value, draw)

        for b in it:
            texts, found = [], []
            for t, more in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                draws = {(x["type"], x["value"]): x["draw"] for x in more or ()}
                out, at, info = [], 0, []
                for s, e, kind, value in mentions(t) if t else ():
                    if s < at:
                        continue
                    new = fitted(kind, t[s:e], form(kind, value, draws.get((kind, value), 0)))
                    out += [t[at:s], new]
                    info.append({"type": kind.split(":")[0], "start": s, "end": e, "surrogate": new})
                    at = e
                texts.append(t if not out else "".join([*out, t[at:]]))
                found.append(info)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(found, _FOUND)], names=["id", "text", "entities"])

    out = joined.mapInArrow(replace, f"id {id_type}, text string, entities array<struct<type: string, start: long, end: long, surrogate: string>>")
    return out.withColumnRenamed("id", id_col)
