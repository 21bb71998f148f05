"""Operator 1, personal data: weak supervision over candidate spans.

Base patterns give e-mail, IP, card and phone spans that always stay. Wider patterns give further candidates:
phones without `+`, spelled-out e-mail addresses, IPv6 addresses, card-like groups. Six labelers vote for, against or not at all
on each candidate (base spans too): strict shape, checksum or ranges, gazetteer of domains and area codes,
cue words before it, words before it that speak against, and its neighbours. Expectation-maximisation over the
counts of vote patterns, gathered from all documents, estimates each labeler's reliability without labels; its
posteriors train a logistic span classifier on the votes. A further candidate stays if the classifier gives it
at least ACCEPT and it touches no base span. There are at most 4 * 3^6 vote patterns, so what the driver
holds does not grow with the data.

Nulls: a null or empty text has no spans. Repeated rows are each scanned. Offsets are code points, ends
exclusive. Spans of different kinds may overlap, as each kind is searched for itself. Empty tables give no
rows and a classifier that accepts no further candidate.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, materialize, table

KINDS = ("email", "ip", "card", "phone")
LABELERS, ACCEPT, EM_ROUNDS = 6, 0.9, 50

# Base patterns, written so that no long run is scanned twice: a match can start only where a run starts.
_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Wider candidates.
_SPELLED = re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64} ?[\[({] ?(?:at|AT|@) ?[\])}] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[({] ?(?:dot|DOT|\.) ?[\])}]) ?[A-Za-z0-9-]{2,63}){1,4}")
_LOCAL_PHONE = re.compile(r"(?<![\w+.-])(?:\+[0-9]{1,3}[-. ]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![\w.-])")
_CARD_GROUPS = re.compile(r"(?<![0-9])(?:[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{13,16})(?![0-9])")
_IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")

# Gazetteers and cue words (fixed values).
TOP_DOMAINS = frozenset("com org net edu gov io co info biz eu de fr es uk us ca au jp cn ru br in it nl se no dk fi pl ch at be test example".split())
CUES = {
    "email": re.compile(r"(?i)(?:e-?mail|mail|contact|write to|reach|correo|courriel|kontakt)\W{0,3}(?:\w+\W+){0,2}$"),
    "ip": re.compile(r"(?i)(?:\bip|ipv6|address|host|server|adresse|direcci\w+)\W{0,3}(?:\w+\W+){0,2}$"),
    "card": re.compile(r"(?i)(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)\W{0,3}(?:\w+\W+){0,2}$"),
    "phone": re.compile(r"(?i)(?:phone|tel|call|mobile|cell|fax|telefon\w*|t[ée]l[ée]\w*|llam\w+)\W{0,3}(?:\w+\W+){0,2}$"),
}
AGAINST = re.compile(r"(?i)(?:version|isbn|issn|doi|order|invoice|sku|serial|rev|build|part no|§|#|\$)\W{0,3}$")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, by start, then kind."""
    out = []
    if "@" in text:
        free = 0
        for m in _AT.finditer(text):
            at = start = m.start()
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, 0, m.end()))
                free = m.end()
    out += ((m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")))
    for m in _CARD.finditer(text):
        if 12 <= len(m[0]) and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += ((m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15)
    return sorted(out)


def wide_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further candidates that touch no base span and no candidate before them."""
    found = []
    if any(b in text for b in "[({"):
        found += ((m.start(), 0, m.end()) for m in _SPELLED.finditer(text))
    found += ((m.start(), 3, m.end()) for m in _LOCAL_PHONE.finditer(text))
    if ":" in text:
        found += ((m.start(), 1, m.end()) for m in _IPV6.finditer(text))
    found += ((m.start(), 2, m.end()) for m in _CARD_GROUPS.finditer(text) if luhn(_digits(m[0])))
    if not found:
        return []
    out, at, reach, free = [], 0, 0, 0  # reach: the furthest end of the base spans that start before `at`
    for s, k, e in sorted(found):
        while at < len(base) and base[at][0] < e:
            reach = max(reach, base[at][2])
            at += 1
        if s >= reach and s >= free:
            out.append((s, k, e))
            free = e
    return out


def votes(text: str, span: tuple[int, int, int], is_base: bool) -> int:
    """The six votes (0 against, 1 none, 2 for) as one base-3 number."""
    start, kind, end = span
    s, before = text[start:end], text[max(0, start - 40) : start]
    d = _digits(s)
    if kind == 0:
        parts = re.split(r"[^A-Za-z0-9]+", s.lower())
        strict, checked, known = is_base, 2 if len(parts) >= 3 else 0, 2 if parts[-1] in TOP_DOMAINS else 0
    elif kind == 1:
        strict, checked, known = is_base, 2 if is_base or "::" not in s else 1, 0 if s.startswith(("0.", "255.")) else 1
    elif kind == 2:
        strict, checked, known = is_base, 2 if luhn(d) else 0, 2 if d[0] in "3456" else 0
    else:
        tail = d[-10:]
        strict, checked, known = is_base or s[0] == "(", 2 if 9 <= len(d) <= 15 else 0, 2 if len(tail) == 10 and tail[0] not in "01" else 1
    cue = 2 if CUES[KINDS[kind]].search(before) else 1
    against = 0 if AGAINST.search(before) else 1
    left, right = text[start - 1 : start], text[end : end + 1]
    near = 0 if left.isdigit() or right.isdigit() else 2 if not (left.isalnum() or right.isalnum()) else 1
    code = 0
    for v in (2 if strict else 1, checked, known, cue, against, near):
        code = code * 3 + v
    return code


def unpack_votes(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes // 3 ** (LABELERS - 1 - j) % 3 for j in range(LABELERS)], axis=1)


def fit_votes(kinds: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Classifier table [kind, code] -> probability, from pattern counts: EM, then logistic regression."""
    out = np.zeros((len(KINDS), 3**LABELERS))
    every = unpack_votes(np.arange(3**LABELERS))
    for kind in range(len(KINDS)):
        at = kinds == kind
        if not at.any():
            continue
        v, n = unpack_votes(codes[at]), counts[at].astype(float)
        prior = 0.5
        rates = np.array([[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]])[:, None, :].repeat(LABELERS, 1)  # [class, labeler, vote]
        for _ in range(EM_ROUNDS):
            logs = np.stack([np.log(rates[c, np.arange(LABELERS), v]).sum(1) for c in (0, 1)])
            logs += np.log([[1 - prior], [prior]])
            post = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))
            weight = np.stack([n * (1 - post), n * post])
            prior = float(np.clip((weight[1].sum() + 1) / (n.sum() + 2), 0.01, 0.99))
            for c in (0, 1):
                for vote in range(3):
                    rates[c, :, vote] = ((weight[c][:, None] * (v == vote)).sum(0) + [0.6, 0.3, 0.1][vote if c == 0 else 2 - vote] * 5) / (weight[c].sum() + 5)
        x, xs = np.column_stack([v - 1.0, np.ones(len(v))]), np.column_stack([every - 1.0, np.ones(len(every))])
        w = np.zeros(LABELERS + 1)
        w[:-1] = 0.1
        for _ in range(300):
            p = 1 / (1 + np.exp(-x @ w))
            w += 2.0 * (x.T @ (n * (post - p)) / n.sum() - 0.001 * w)
        out[kind] = 1 / (1 + np.exp(-xs @ w))
    return out


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): every base and further candidate as (start, kind, end, code, base)."""
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("code", pa.int32()), ("base", pa.bool_())])
    keys = [f.name for f in span]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                every = [(s, True) for s in base] + [(s, False) for s in wide_spans(text or "", base)]
                rows.append([dict(zip(keys, (*s, votes(text, s, b), b))) for s, b in every])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(span))], names=["doc_id", "spans"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), search, "doc_id long, spans array<struct<start:int,kind:int,end:int,code:int,base:boolean>>")


def train_classifier(found: DataFrame) -> np.ndarray:
    """Vote patterns of all `candidates`, counted by Spark, then fitted."""
    got = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.code").agg(F.count(F.lit(1)).alias("n")).toPandas()  # a row a pattern
    return fit_votes(got["kind"].to_numpy(np.int64), got["code"].to_numpy(np.int64), got["n"].to_numpy(np.int64))


def find_spans(text: str, classifier: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base, all) spans of a text."""
    base = base_spans(text)
    more = [s for s in wide_spans(text, base) if classifier[s[1], votes(text, s, False)] >= ACCEPT]
    return base, sorted(base + more)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Text with each span (overlaps merged, named by the first) replaced by its kind in brackets."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += (text[at:s], f"[{KINDS[k].upper()}]")
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and hash of base spans, then all spans."""
    found = materialize(candidates(docs), "pii")
    classifier = train_classifier(found)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base = [(s["start"], s["kind"], s["end"]) for s in spans if s["base"]]
                more = [(s["start"], s["kind"], s["end"]) for s in spans if not s["base"] and classifier[s["kind"], s["code"]] >= ACCEPT]
                n = Counter(k for _, k, _ in base)
                rows.append((doc_id, n[0], n[1], n[2], n[3], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + more))))
            types = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return map_arrow(found, decide, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask_documents(docs: DataFrame, classifier: np.ndarray | None = None) -> DataFrame:
    """`docs`, with the personal data in `text` replaced; a null text stays null."""
    table_ = train_classifier(candidates(docs)) if classifier is None else classifier

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else masked(t, find_spans(t, table_)[1]) for t in texts], dtype=object)

    return docs.withColumn("text", mask(F.col("text").cast("string")))


def op1_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op1_weak_pii": op1_weak_pii}
