"""Personal data by weak supervision.

Fixed patterns give the base spans (email, ip, card, phone). Around them, wider
candidates (long mixed tokens, values after a secret cue, digit groups) are judged: regex, gazetteer and
context labelers vote for, against or abstain. Expectation-maximisation over the
counts of vote patterns, from all documents, estimates how reliable each labeler
is; its soft labels train a logistic span classifier, which decides about every
candidate that no base span touches (a long token may enclose one, as a digit run
in a key can look like a card). Base spans always stay.

Vote patterns are few (three votes of each labeler, kind, length class), so what
the driver sees is a table bounded by their number, whatever the corpus size.

All scans are linear in the text: an address is looked for around its ``@``, and
digit runs are never entered twice.

Nulls and edge cases: a null text is an empty one, without spans. Repeated rows
and null ids are treated one by one. Only id and text are read by the digest;
``redact`` keeps all columns. An empty table gives no rows. No shuffle beyond
the vote counts, and no key to become hot.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pizarra.llm.common import table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "number")

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])(?=[0-9_/+-]*+[A-Za-z])[A-Za-z0-9_/+-]{16,}+")
# digit runs in a row, with one or two separators between neighbours
_ROW = re.compile(r"(?<![A-Za-z0-9])[0-9]++(?![A-Za-z])(?:[ .()/-]{1,2}[0-9]++(?![A-Za-z]))*+")
_RUN = re.compile(r"[0-9]++")
#: Lengths of the digit runs of usual numbers: phones, identity numbers, cards,
#: dates. Those under MIN_DIGITS are short dates, which keep their digits to themselves.
MIN_DIGITS, MAX_JOINED = 7, 34
SHAPES = frozenset(
    tuple(map(int, shape.split("-")))
    for shape in (
        "3-4 3-3-4 1-3-3-4 2-3-3-4 1-10 2-10 3-7 4-7 3-8 2-8 4-6 5-6 3-4-4 2-4-4 4-3-4 4-3-3 5-3-3 3-3-3 3-2-2-2 3-3-2-2 1-3-3-2-2 "
        "2-2-2-2 2-2-2-2-2 1-2-2-2-2 3-2-4 2-7 4-4-4-4 4-4-4-4-1 4-4-4-4-2 4-4-4-4-3 4-6-5 "
        "4-2-2 4-1-2 4-2-1 2-2-4 1-2-4 2-1-4 1-1-4 2-2-2 1-2-2 2-1-2 1-1-2"
    ).split()
)
_LONGEST = max(map(len, SHAPES))

# Gazetteers: fixed values.
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "glpat-", "sk-", "xoxb-")
DOMAINS = ("com", "org", "net", "edu", "gov", "de", "es", "fr", "info", "io")
SECRET_CUES = (
    "password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "auth", "key",
    "contraseña", "clave", "secreto", "passwort", "kennwort", "geheimnis", "passe", "jeton",
)
CONTACT_CUES = (
    "call", "tel", "phone", "mobile", "fax", "mail", "email", "contact", "card", "iban", "account", "ssn", "id",
    "teléfono", "telefono", "móvil", "llamar", "correo", "tarjeta", "cuenta", "telefon", "handy", "anrufen", "karte", "konto",
    "téléphone", "portable", "appeler", "courriel", "carte", "compte",
)
_PREFIXED = re.compile(rf"(?<![A-Za-z0-9_/+-])(?:{'|'.join(KEY_PREFIXES)})[A-Za-z0-9_/+-]++")
_ASSIGN = re.compile(r"[=:]++>?[ \t]{0,4}+")
_CUED = re.compile(rf"(?<![A-Za-z_])(?:{'|'.join(SECRET_CUES)})[\"']?[ \t]{{0,4}}\Z", re.IGNORECASE)
_VALUE = re.compile(r"[^\s\"']++")
_WORTH = re.compile(r"[0-9@=:]")
_CUE = re.compile(r"([A-Za-z_\u00c0-\u00ff]+)[\s\"':=#.(-]*\Z")
_HEX = re.compile(r"(?:[0-9a-f]{16,}|[0-9A-F]{16,})\Z")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[./-][01]?[0-9][./-][0-3]?[0-9]\Z|[0-3]?[0-9][./-][01]?[0-9][./-](?:19|20)?[0-9]{2}\Z")

LABELERS = ("pattern", "shape", "gazetteer", "context", "spread")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else (2 * v if v < 5 else 2 * v - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the fixed patterns, by kind, then start."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        done = domain.end() if domain else at + 1
        if domain:
            out.append((0, start, done))
        at = text.find("@", done)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((3, *m.span()))
    return out


def number_parts(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The numbers in a row of digit runs, however long: the cheapest division
    into usual shapes and long runs (cheap), runs joined without such a shape
    (dearer with each run), and single short runs, which are no number. Mixed
    separators within a number cost extra."""
    n = len(runs)
    sizes = [e - s for s, e in runs]
    if n == 1:
        return runs if sizes[0] >= MIN_DIGITS else []
    gaps = [text[runs[k - 1][1] : runs[k][0]].strip("()") for k in range(1, n)]
    cost, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    for i in range(n):
        digits, mixed = 0, 0.0
        for j in range(i + 1, n + 1):
            digits += sizes[j - 1]
            if j > i + 2 and gaps[j - 2] != gaps[i]:
                mixed = 0.5
            if j == i + 1:
                price = 1.0 if digits >= MIN_DIGITS else 1.5
            elif digits > MAX_JOINED:
                break
            elif j - i <= _LONGEST and tuple(sizes[i:j]) in SHAPES and (digits >= MIN_DIGITS or not mixed and gaps[i] in "/.-"):
                price = 1.0 + mixed
            elif digits >= MIN_DIGITS:
                price = 1.0 + 0.9 * (j - i) + mixed
            else:
                continue
            if cost[i] + price < cost[j]:
                cost[j], back[j] = cost[i] + price, i
    out, j = [], n
    while j:
        if sum(sizes[back[j] : j]) >= MIN_DIGITS:
            out.append((runs[back[j]][0], runs[j - 1][1]))
        j = back[j]
    return out[::-1]


def numbers(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Numbers of the text between the (sorted) taken stretches."""
    out, i, reach = [], 0, 0
    for m in _ROW.finditer(text):
        if m.end() - m.start() < MIN_DIGITS:
            continue
        runs: list[tuple[int, int]] = []
        for r in _RUN.finditer(text, m.start(), m.end()):
            while i < len(taken) and taken[i][0] < r.end():
                reach = max(reach, taken[i][1])
                i += 1
            if reach <= r.start():
                runs.append(r.span())
            elif runs:
                out += number_parts(text, runs)
                runs = []
        if runs:
            out += number_parts(text, runs)
    return out


def has_prefix(text: str) -> bool:
    return any(prefix in text for prefix in KEY_PREFIXES)


def worth(text: str) -> bool:
    """Whether there can be any span."""
    return bool(_WORTH.search(text)) or has_prefix(text)


def assigned(text: str) -> list[tuple[int, int]]:
    """Values after a secret cue and an = or a colon: a quoted one up to its
    closing quote on the line, another up to a blank or quote, without the
    punctuation that ends it."""
    out = []
    for m in _ASSIGN.finditer(text):
        s = m.end()
        if s == len(text) or not _CUED.search(text, max(0, m.start() - 24), m.start()):
            continue
        if text[s] in "\"'":
            e = text.find(text[s], s + 1)
            if e > s + 1 and text.find("\n", s + 1, e) < 0:
                out.append((s + 1, e))
                continue
            s += 1
        value = _VALUE.match(text, s)
        size = len(value.group().rstrip(".,;")) if value else 0
        if size:
            out.append((s, s + size))
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Wider spans: no base span touches them, or lies only partly in them.
    Numbers are those of the text between the base spans."""
    taken = sorted((s, e) for _, s, e in base)
    found = [(4, *m.span()) for m in (*_TOKEN.finditer(text), *(_PREFIXED.finditer(text) if has_prefix(text) else ()))]
    found += [(4, s, e) for s, e in assigned(text)]
    found += [(5, s, e) for s, e in numbers(text, taken)]
    out, last, i = [], 0, 0
    for kind, s, e in sorted(found, key=lambda x: (x[1], x[0], -x[2])):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        touched, k = [], i
        while k < len(taken) and taken[k][0] < e:
            touched.append(taken[k])
            k += 1
        if s >= last and all(kind == 4 and s <= a and b <= e and (a, b) != (s, e) for a, b in touched):
            out.append((kind, s, e))
            last = e
    return out


def with_cue_place(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Each span with the place a cue would stand before: its start, or for a
    number next to another one that of the first in the row."""
    out: list[tuple[int, int, int, int]] = []
    for kind, s, e in found:
        near = kind == 5 and out and out[-1][0] == 5 and 0 <= s - out[-1][2] <= 2
        out.append((kind, s, e, out[-1][3] if near else s))
    return out


def votes(text: str, kind: int, start: int, end: int, at: int | None = None) -> tuple[int, ...]:
    """What each labeler says: 1 for, -1 against, 0 nothing. A cue is looked for
    before ``at`` (default: before the span)."""
    span = text[start:end]
    at = start if at is None else at
    before = text[max(0, at - 24) : at]
    cue = _CUE.search(before)
    word = cue.group(1).lower() if cue else ""
    cues = SECRET_CUES if kind == 4 else CONTACT_CUES
    letters = sum(c.isalpha() for c in span)
    digits = sum(c.isdigit() for c in span)
    pattern = 1 if kind < 4 else 0
    if kind == 4:
        shape = 1 if _HEX.match(span) or (digits >= 3 and letters >= 3 and "-" not in span[1:-1]) else -1 if digits < 2 else 0
        gazetteer = 1 if span.startswith(KEY_PREFIXES) else 0
    elif kind == 5:
        plain = "".join(c for c in span if c.isdigit())
        card = 16 <= digits <= 19 and luhn(plain)
        pattern = int(card)
        shape = 1 if card else -1 if _DATE.match(span) or digits >= 16 else 0
        gazetteer = -1 if digits < 9 else 0
    else:
        shape = 1 if kind == 2 or digits >= 2 else 0
        gazetteer = (1 if span.rsplit(".", 1)[-1].lower() in DOMAINS else -1) if kind == 0 else 1 if kind == 3 and span[1] == "1" else 0
    context = 1 if word in cues else -1 if kind == 5 and cue and before.endswith(" ") and word.isalpha() and len(word) < 3 else 0
    counts = np.unique(np.frombuffer(span.encode("utf-32-le"), "<u4"), return_counts=True)[1] / len(span)
    entropy = float(-(counts * np.log2(counts)).sum())
    spread = -1 if entropy < 1.5 else 1 if entropy >= 2.5 and letters else 0
    return pattern, shape, gazetteer, context, spread


def _key(kind: int, said: tuple[int, ...], size: int) -> str:
    return ",".join(map(str, (kind, *said, min(size // 8, 8))))


def reliabilities(rows: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """EM over (votes, count): each labeler's accuracy when it votes, and the
    belief that a vote pattern is personal data. Abstaining tells nothing, and
    a labeler is taken to be better than chance; else the classes could settle
    on any other division of the candidates."""
    said = np.array([v for v, _ in rows])
    weight = np.array([n for _, n in rows], float)
    accuracy, odds = np.full(said.shape[1], 0.8), 0.0
    belief = np.full(len(rows), 0.5)
    for _ in range(rounds):
        score = odds + said @ np.log(accuracy / (1 - accuracy))
        belief = 1 / (1 + np.exp(-score))
        # pseudo-counts of a tenth of all candidates keep rare votes near 0.8
        prior = 0.1 * weight.sum() + 1
        right = ((said == 1) * belief[:, None] + (said == -1) * (1 - belief[:, None])) * weight[:, None]
        accuracy = np.clip((right.sum(0) + 0.8 * prior) / (((said != 0) * weight[:, None]).sum(0) + prior), 0.55, 0.98)
        share = np.clip((weight * belief).sum() / weight.sum(), 0.1, 0.9)
        odds = math.log(share / (1 - share))
    return accuracy, belief


def _features(kind: int, said: tuple[int, ...], size: int) -> np.ndarray:
    x = np.zeros(2 + 2 * len(LABELERS) + len(KINDS))
    x[0], x[1] = 1.0, min(size, 64) / 64
    for k, v in enumerate(said):
        if v:
            x[2 + 2 * k + (v < 0)] = 1
    x[2 + 2 * len(LABELERS) + kind] = 1
    return x


def train(counts: list[tuple[str, int]]) -> np.ndarray | None:
    """Logistic span classifier from the soft labels of EM; None if nothing
    was there to learn from."""
    if not counts:
        return None
    parsed = [(tuple(map(int, key.split(","))), n) for key, n in sorted(counts)]
    _, belief = reliabilities([(k[1:-1], n) for k, n in parsed])
    x = np.array([_features(k[0], k[1:-1], 8 * k[-1] + 4) for k, _ in parsed])
    weight = np.array([n for _, n in parsed], float)
    weight /= weight.sum()
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (belief - p)) - 1e-3 * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w += np.linalg.solve(hessian, gradient)
    return w


def vote_counts(df: DataFrame, text_col: str = "text") -> list[tuple[str, int]]:
    """Counts of (kind, votes, length class) over all documents; bounded by the
    number of such combinations."""

    def run(batches):
        counts: dict[str, int] = {}
        for batch in batches:
            for value in batch.column(0):
                text = value.as_py()
                if text and worth(text):
                    base = base_spans(text)
                    for kind, s, e, at in with_cue_place([*base, *candidates(text, base)]):
                        key = _key(kind, votes(text, kind, s, e, at), e - s)
                        counts[key] = counts.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["k", "n"])

    rows = df.select(text_col).mapInArrow(run, "k string, n long").groupBy("k").agg(F.sum("n").alias("n"))
    return [(r["k"], r["n"]) for r in rows.collect()]


def spans_of(text: str | None, model: np.ndarray | None) -> tuple[list, list]:
    """(base spans, added spans)."""
    if not text or not worth(text):
        return [], []
    base, known = base_spans(text), {}
    added = []
    for kind, s, e, at in with_cue_place(candidates(text, base)) if model is not None else ():
        said = votes(text, kind, s, e, at)
        key = _key(kind, said, e - s)
        if key not in known:
            known[key] = float(_features(kind, said, 8 * min((e - s) // 8, 8) + 4) @ model) >= 0.0
        if known[key]:
            added.append((kind, s, e))
    return base, sorted(added)


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_email, n_ip, n_card, n_phone, base and spans (both as
    ``kind:start:end`` joined by commas; code points, end exclusive)."""
    model = train(vote_counts(df, text_col))
    source = df.select(id_col, text_col)

    def joined(spans):
        return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)

    def run(batches):
        for batch in batches:
            rows = [spans_of(t.as_py(), model) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in range(4)),
                    pa.array([joined(base) for base, _ in rows], pa.string()),
                    pa.array([joined(base + added) for base, added in rows], pa.string()),
                ],
                names=[batch.schema.names[0], "n_email", "n_ip", "n_card", "n_phone", "base", "spans"],
            )

    first = source.schema[0]
    return source.mapInArrow(
        run, f"`{first.name}` {first.dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string"
    )


def redacted(text: str | None, model: np.ndarray | None) -> str | None:
    """``text`` with each stretch of spans replaced by its first kind's tag."""
    base, added = spans_of(text, model)
    if not base and not added:
        return text
    out, at = [], 0
    for kind, s, e in sorted(base + added, key=lambda x: (x[1], x[0])):
        if s >= at:
            out += [text[at:s], f"<{KINDS[kind].upper()}>"]
        at = max(at, e)
    out.append(text[at:])
    return "".join(out)


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns, with personal data in the text replaced by tags."""
    names = df.columns
    model = train(vote_counts(df, text_col))
    at = names.index(text_col)
    inner = df.toDF(*(f"c{i}" for i in range(len(names))))

    def run(batches):
        for batch in batches:
            texts = pa.array([redacted(t.as_py(), model) for t in batch.column(at)], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    return inner.mapInArrow(run, inner.schema).toDF(*names)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans",
        F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).cast("long").alias("n_spans"),
    )
