"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Base spans (e-mail, IP address, card number, phone number) follow fixed patterns and checks and
always count.  Further candidates are spans of the same kinds that the patterns miss: phones in
national form, phones and cards run together with other digits, card-like numbers that fail the
check digit, IPv6 addresses, spelled-out e-mails.
On every candidate, base or not, five labelers vote yes, no or nothing: the pattern's check, a
gazetteer (top-level domains, issuers, dial codes, reserved networks), the words before it, its
shape, and other personal data nearby.  Candidates are counted by (kind, votes, features); on these
counts expectation-maximisation estimates every labeler's reliability, and a logistic classifier
per kind is fitted to the posteriors.  Candidates above ``threshold`` are added to the base.

One pass over the texts finds candidates (a few per document); what is counted and sent to the
driver is one row per pattern: at most 4 kinds x 3**5 votes x 12 features = 11,664 rows.

Defined cases: a null or empty text has no spans; offsets are code points, ends exclusive; every
text is searched whole, in time linear in its length; added spans never overlap base spans or each
other; repeated rows give repeated rows; an empty table, or one without candidates, trains nothing
and adds nothing; other columns pass through masking unchanged and are ignored elsewhere.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusbank.llm.common import table
from corpusbank.session import stage

KINDS = ("email", "ip", "card", "phone")
THRESHOLD = 0.9
LABELERS = 5
# Starting reliabilities: check, gazetteer, context, shape, neighbours.
RELIABILITY = (0.99, 0.75, 0.85, 0.65, 0.6)
ANCHOR = 0  # the check keeps its reliability, which fixes what the classes mean
ROUNDS = 60

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Quads start at the start of a run of digits: a start inside it fails or matches likewise.
QUAD = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NATIONAL = re.compile(r"(?<![\w.+-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![\w-])")
ABROAD = re.compile(r"(?<![\w+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![\w-])")
CARD = re.compile(r"(?<![0-9A-Za-z])(?:[0-9]{12,19}|[0-9]{4}(?:[ -][0-9]{4}){2,3})(?![0-9A-Za-z])")
IPV6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
SPELLED_AT = re.compile(r" ?(?:\(at\)|\[at\]) ?")
SPELLED_LEFT = re.compile(r"[A-Za-z0-9._%+-]{1,64}$")
SPELLED_RIGHT = re.compile(r"[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z]{2,24}){1,3}")

# Gazetteers and context words.
TOP_DOMAINS = frozenset("com org net edu gov info io de es fr it uk eu us ca co".split())
DIAL_CODES = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 "
                   "58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
SPEAKS_FOR = {
    "email": "mail email e-mail contact write correo courriel kontakt".split(),
    "ip": "ip server host address router login client".split(),
    "card": "card visa mastercard amex credit debit payment tarjeta karte carte".split(),
    "phone": "phone tel telephone call fax mobile cell whatsapp telefon teléfono téléphone".split(),
}
SPEAKS_AGAINST = frozenset("version isbn doi order invoice price figure page section table sku "
                           "serial build release id".split())
WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(map(int, "".join(str(2 * int(d)) for d in digits[-2::-2])))) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern: around every @, as far as either side goes."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def _count(text: str) -> int:
    return sum(c.isdigit() for c in text)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans in order of start, then kind."""
    spans = [(a, 0, b) for a, b in emails(text)]
    for m in QUAD.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in DIGITS.finditer(text):
        if m.end() - m.start() < 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
    for m in PLUS.finditer(text):
        if 9 <= _count(m[0]) <= 15:
            spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def more_candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of further candidates, clear of base spans and of each other."""
    found = []
    if "at)" in text or "at]" in text:
        for m in SPELLED_AT.finditer(text):
            left = SPELLED_LEFT.search(text[max(0, m.start() - 64):m.start()])
            right = SPELLED_RIGHT.match(text, m.end(), m.end() + 256)
            if left and right:
                found.append((m.start() - len(left[0]), 0, right.end()))
    if text.count(":") >= 7:
        found += [(m.start(), 1, m.end()) for m in IPV6.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text)]
    found += [(m.start(), 3, m.end()) for m in NATIONAL.finditer(text) if 7 <= _count(m[0]) <= 12]
    found += [(m.start(), 3, m.end()) for m in ABROAD.finditer(text)]
    out, end = [], -1
    starts = [s for s, _, _ in base]
    reach = np.maximum.accumulate([e for _, _, e in base]).tolist() if base else []
    for s, kind, e in sorted(found):
        before = bisect_left(starts, e)  # base spans that start before e
        if s >= end and not (before and reach[before - 1] > s):
            out.append((s, kind, e))
            end = e
    return out


def votes(text: str, start: int, kind: int, end: int, base: bool,
          others: list[int]) -> tuple[int, ...]:
    """The five votes (-1, 0, 1), then the features length class and separated."""
    name, span = KINDS[kind], text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    parts = re.split(r"[^0-9A-Za-z]+", span.strip("()"))
    good = base or (name == "card" and luhn(digits)) or (
        name == "phone" and span[0] == "+" and 9 <= len(digits) <= 15)
    check = 1 if good else -1
    gazetteer = shape = 0
    if name == "email":
        gazetteer = 1 if parts[-1].lower() in TOP_DOMAINS else -1
        shape = 1 if end - start <= 64 and span[:1].isalnum() else -1
    elif name == "ip":
        reserved = not base or parts[0] in ("0", "127", "255")
        gazetteer = -1 if base and reserved else 0
        follows = text[end:end + 2]
        shape = -1 if follows[:1] == "." and follows[1:2].isdigit() else 1
    elif name == "card":
        gazetteer = 1 if digits[0] in "3456" and 13 <= len(digits) <= 19 else -1
        shape = 1 if len(parts) == 1 or {*map(len, parts[:-1])} <= {4, 6, 5} else -1
    else:
        gazetteer = int(span[0] == "+" and digits.startswith(DIAL_CODES))
        shape = 1 if 3 <= len(parts) <= 6 else -1
    before = {w.lower() for w in WORDS.findall(text[max(0, start - 40):start])}
    context = 1 if before & set(SPEAKS_FOR[name]) else -1 if before & SPEAKS_AGAINST else 0
    near = bisect_left(others, start - 200)
    close = sum(1 for s in others[near:near + 3] if s != start and abs(s - start) <= 200)
    return (check, gazetteer, context, shape, int(close > 0),
            min(len(digits) // 4, 5), int(len(parts) > 1))


def find(text: str) -> list[tuple[int, int, int, bool, str]]:
    """(start, kind, end, base, pattern) of every candidate by start, then kind."""
    if not any(c in text for c in "0123456789@:[("):
        return []
    base = base_spans(text)
    spans = sorted([(*s, True) for s in base]
                   + [(*s, False) for s in more_candidates(text, base)])
    others = [s[0] for s in spans if s[3]]
    return [(s, k, e, b, ",".join(map(str, (k, *votes(text, s, k, e, b, others)))))
            for s, k, e, b in spans]


SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()),
                  ("base", pa.bool_()), ("pattern", pa.string())])
NAMES = [f.name for f in SPAN]


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): every candidate of every document."""
    def run(batches):
        for batch in batches:
            spans = [[dict(zip(NAMES, s)) for s in find(t or "")]
                     for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, pa.list_(SPAN))], names=["doc_id", "spans"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, spans array<struct<start:int,kind:int,`end`:int,base:boolean,"
             "pattern:string>>")


def reliabilities(vote: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM over rows of votes with counts: (posterior of each row, (labelers, class, vote) rates).

    The anchor's rates stay as they start; another labeler's accuracy, when it votes, is kept at
    1/2 or more.
    """
    start = np.array(RELIABILITY)
    rate = np.empty((LABELERS, 2, 3))
    for j in range(LABELERS):
        quiet = 0.3
        rate[j, 1] = (1 - quiet) * (1 - start[j]), quiet, (1 - quiet) * start[j]
        rate[j, 0] = rate[j, 1][::-1]
    prior = 0.5
    index = vote + 1
    for _ in range(ROUNDS):
        log = [np.log(p) + sum(np.log(rate[j, c][index[:, j]]) for j in range(LABELERS))
               for c, p in ((0, 1 - prior), (1, prior))]
        posterior = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        prior = (count @ posterior + 1) / (count.sum() + 2)
        for c, share in ((0, 1 - posterior), (1, posterior)):
            weight = count * share
            for j in set(range(LABELERS)) - {ANCHOR}:
                seen = np.bincount(index[:, j], weights=weight, minlength=3) + 4 * rate[j, c].mean()
                rate[j, c] = seen / seen.sum()
                right, wrong = (2, 0) if c else (0, 2)
                if rate[j, c][right] < rate[j, c][wrong]:
                    rate[j, c][[0, 2]] = rate[j, c][[0, 2]].mean()
    return posterior, rate


def _design(rows: np.ndarray) -> np.ndarray:
    """Votes for, votes against, one-hot length class, separated, intercept."""
    vote, extra = rows[:, :LABELERS], rows[:, LABELERS:]
    return np.hstack([vote > 0, vote < 0, extra[:, :1] == np.arange(6), extra[:, 1:2],
                      np.ones((len(rows), 1))]).astype(float)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of a logistic model for soft targets ``y`` by Newton steps."""
    w = np.zeros(x.shape[1])
    weight = weight * min(1.0, 1e5 / weight.sum())
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)),
                               x.T @ (weight * (y - p)) - ridge * w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def accepted_patterns(spans: DataFrame, threshold: float = THRESHOLD) -> list[str]:
    """Patterns that the trained classifiers take for personal data, from ``candidates`` rows."""
    counts = spans.select(F.explode("spans").alias("s")).groupBy("s.pattern").count().collect()
    rows = sorted((r["pattern"], r["count"]) for r in counts)
    accepted = []
    for kind in range(len(KINDS)):
        own = [(p, n) for p, n in rows if p.startswith(f"{kind},")]
        if own:
            values = np.array([[int(v) for v in p.split(",")[1:]] for p, _ in own])
            count = np.array([n for _, n in own], dtype=float)
            posterior, _ = reliabilities(values[:, :LABELERS], count)
            x = _design(values)
            p = 1 / (1 + np.exp(-np.clip(x @ fit_logistic(x, posterior, count), -30, 30)))
            accepted += [pattern for (pattern, _), q in zip(own, p) if q >= threshold]
    return accepted


def chosen(accepted: list[str]) -> Column:
    """Base spans and spans of accepted patterns, from the column ``spans``."""
    return F.filter("spans", lambda s: s["base"] | s["pattern"].isin(accepted))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                       threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, base and all: arrays of spans (start, kind, end, base, pattern) per document."""
    found = stage(candidates(docs, doc_id, text), "pii")
    accepted = accepted_patterns(found, threshold)
    return found.select("doc_id", F.filter("spans", lambda s: s["base"]).alias("base"),
                        chosen(accepted).alias("all"))


def mask_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   n_chars: str = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with personal data replaced by ``<EMAIL>``, ``<IP>`` .. and ``n_chars`` updated.

    Overlapping spans are replaced together by the first one's mark; a null text stays null.
    """
    accepted = frozenset(accepted_patterns(stage(candidates(docs, doc_id, text), "pii"), threshold))
    at, schema = docs.columns.index(text), docs.schema
    count_at = docs.columns.index(n_chars) if n_chars in docs.columns else None

    def masked(value):
        if not value:
            return value
        out, end = [], 0
        for s, k, e, base, pattern in find(value):
            if base or pattern in accepted:
                if s >= end:
                    out += [value[end:s], f"<{KINDS[k].upper()}>"]
                end = max(end, e)
        return "".join([*out, value[end:]])

    def run(batches):
        for batch in batches:
            texts = [masked(t) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            if count_at is not None:
                columns[count_at] = pa.array([None if t is None else len(t) for t in texts],
                                             columns[count_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema)


def op10_pii_weak_supervision(spark, sf_dir: str) -> DataFrame:
    """All documents: counts and digest of the base spans, and all spans."""
    found = find_personal_data(table(spark, sf_dir, "documents"))
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[number(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"))
