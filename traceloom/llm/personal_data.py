"""Personal data by weak supervision.

Patterns wider than the base rules propose spans; six labelers (pattern, checksum,
gazetteer, cue words, surroundings, variety of characters) vote on each. Votes of
the whole corpus are counted by pattern of votes, expectation-maximisation over
these few patterns estimates how reliable each labeler is, and the probabilities it
gives the spans train a final classifier, which sees only the shape of a span and
the words around it. Base spans always stay; the classifier adds others.

Defined results: null and empty texts have no spans; repeated rows and null ids are
rows like others; other columns are ignored. Places are code points, ends are
exclusive. Added spans never overlap base spans or each other: the first one stays.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.session import materialize

#: Kinds in the order they are listed; the first four have base rules.
KINDS = ["email", "ip", "card", "phone", "secret"]
EMAIL, IP, CARD, PHONE, SECRET = range(5)
#: Most spans the classifier is trained on, in expectation; drawn from all by a hash.
SAMPLE = 20_000
#: Buckets of the classifier's features.
BUCKETS = 1 << 12
#: Code points before a span in which cue words are looked for.
CONTEXT = 40

# The base rules, as the contract states them.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Wider patterns, and words the labelers know.
_AT = re.compile(r"[\[({]at[\])}]\x20?([A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[({]dot[\])}])\x20?[A-Za-z0-9-]{1,63})++)", re.I)
_LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9])")
_SECRET = re.compile(r"(passw(?:or)?d|pwd|token|secret|api[_-]?key)[\"']?\x20{0,2}[=:]\x20{0,2}[\"']?([^\s\"',;]{6,128})", re.I)
#: Texts without any of these have no candidates (RE2).
_ANY = r"(?i)[0-9@]|[\[({]at[\])}]|(?:passw|pwd|token|secret|api[_-]?key)"
_WORD = re.compile(r"[^\W\d_]+")
TLDS = frozenset("com org net edu gov int info io de fr es uk it nl eu us ch at be pl ru cn jp br in au ca example".split())
CUES = [
    frozenset("mail email e-mail contact write address courriel correo an to from".split()),
    frozenset("ip host server address client login adresse from".split()),
    frozenset("card visa mastercard amex credit debit payment karte carte tarjeta pay".split()),
    frozenset("phone tel telephone call mobile cell fax telefon téléphone teléfono ring whatsapp sms".split()),
    frozenset("login user username credentials auth key".split()),
]
NO_CUES = frozenset("version v release isbn issn order invoice page figure table section chapter item art nr no ticket build".split())

CANDIDATES = (
    "doc_id BIGINT, spans ARRAY<STRUCT<kind: INT, start: BIGINT, end: BIGINT, base: BOOLEAN, votes: INT, places: ARRAY<INT>>>"
)
FOUND = (
    "doc_id BIGINT, n_email BIGINT, n_ip BIGINT, n_card BIGINT, n_phone BIGINT, base_sha256 STRING, spans STRING"
)
#: Labelers: each votes -1, 0 or 1.
LABELERS = 6


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _proposed(text: str) -> Iterator[tuple[int, int, int, int]]:
    """kind, start, end and pattern vote: 1 for base spans, 0 for wider ones, -1 for failed checks.

    Base spans are leftmost and do not overlap within a kind. Every pattern runs
    in time linear in the text.
    """
    done = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            done = m.end()
            yield EMAIL, start, done, 1
    for m in _AT.finditer(text):
        end = start = m.start()
        if end and text[end - 1] == " ":
            end = start = end - 1
        while start > max(0, end - 64) and text[start - 1] in _LOCAL:
            start -= 1
        if start < end:
            yield EMAIL, start, m.end(), 0
    for m in _DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = ".".join(parts[i : i + 4])
            yield IP, at, at + len(four), 1 if _octets(four) else -1
            at += len(four) + 1
    for m in _DIGITS.finditer(text):
        digits = _digits(m.group()) if m.end() - m.start() < 64 else ""
        if 12 <= len(digits) <= 19:
            yield CARD, *m.span(), 1 if luhn(digits) else -1
    for m in _PLUS.finditer(text):
        yield PHONE, *m.span(), 1 if 9 <= len(_digits(m.group())) <= 15 else -1
    for m in _LOCAL_PHONE.finditer(text):
        yield PHONE, *m.span(), 0
    for m in _SECRET.finditer(text):
        yield SECRET, *m.span(2), 0


def _sign(yes: bool, no: bool = False) -> int:
    return 1 if yes else -1 if no else 0


def _votes(text: str, kind: int, start: int, end: int, pattern: int, before: list[str]) -> list[int]:
    """One vote of every labeler: pattern, checksum, gazetteer, cues, surroundings, variety."""
    span = text[start:end]
    digits = _digits(span[:256])
    if kind == EMAIL:
        checksum, known = _sign("." in span and not span.startswith(".")), _sign(span.rsplit(".", 1)[-1].lower() in TLDS)
    elif kind == IP:
        first = int(span.split(".", 1)[0][-4:])
        checksum, known = _sign(pattern > 0, True), _sign(0 < first < 224, True)
    elif kind == CARD:
        checksum, known = _sign(luhn(digits), True), _sign(digits[0] in "3456", True)
    elif kind == PHONE:
        checksum, known = _sign(10 <= len(digits) <= 13, len(digits) < 9 or len(digits) > 15), _sign(digits[:1] not in ("", "0"))
    else:
        letters = sum(c.isalpha() for c in span)
        checksum = _sign(0 < len(digits) and 0 < letters, letters == len(span))
        known = _sign(len(span) >= 12)
    near = before[-4:]
    cue = _sign(any(w in CUES[kind] for w in near), any(w in NO_CUES for w in near[-2:]))
    inside = start and text[start - 1].isalnum() or end < len(text) and text[end].isalnum()
    variety = len(set(digits if kind in (IP, CARD, PHONE) else span[:256]))
    return [pattern, checksum, known, cue, -1 if inside else 1, _sign(variety > 3, variety < 3)]


def _places(text: str, kind: int, start: int, end: int, before: list[str]) -> list[int]:
    """Feature buckets of a span: its shape, its length, and the words and characters around it."""
    span = text[start:end][:128]
    shape = "".join("d" if "0" <= c <= "9" else "a" if c.isalpha() else c for c in span)
    shape = "^" + re.sub(r"(.)\1\1+", r"\1\1", shape) + "$"
    names = [f"s{shape[i : i + 3]}" for i in range(len(shape) - 2)]
    names += [f"l{min(end - start, 40) // 3}", f"w{before[-1] if before else ''}"]
    names += [f"b{_kind_of(text[start - 1 : start])}", f"e{_kind_of(text[end : end + 1])}", "k"]
    return sorted({zlib.crc32(f"{kind}{n}".encode()) % BUCKETS for n in names})


def _kind_of(c: str) -> str:
    return "d" if c.isdigit() else "a" if c.isalpha() else "s" if c.isspace() else c


def _candidates(text: str) -> list[dict]:
    out = []
    for kind, start, end, pattern in sorted(_proposed(text)):
        before = [w.lower() for w in _WORD.findall(text[max(0, start - CONTEXT) : start])]
        code = 0
        for vote in _votes(text, kind, start, end, pattern, before):
            code = code * 3 + vote + 1
        places = _places(text, kind, start, end, before)
        out.append({"kind": kind, "start": start, "end": end, "base": pattern == 1, "votes": code, "places": places})
    return out


def candidates(docs: DataFrame) -> DataFrame:
    """`doc_id, spans`: the proposed spans of every row, with votes and features."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], CANDIDATES).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            some = pc.fill_null(pc.match_substring_regex(texts, _ANY), False).to_numpy(zero_copy_only=False)
            spans = [_candidates(texts[i].as_py()) if some[i] else [] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(spans, schema.field(1).type)], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, CANDIDATES)


@dataclass
class Labelers:
    """Reliability of each labeler: chances[y, labeler, vote + 1], and the share of true spans of each kind."""

    chances: np.ndarray
    prior: np.ndarray

    def posterior(self, kind: np.ndarray, votes: np.ndarray) -> np.ndarray:
        """Probability that spans with these votes are true."""
        odds = np.log(self.prior[kind]) - np.log1p(-self.prior[kind])
        for labeler in range(LABELERS):
            vote = votes // 3 ** (LABELERS - 1 - labeler) % 3
            odds = odds + np.log(self.chances[1, labeler, vote]) - np.log(self.chances[0, labeler, vote])
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


#: Votes a labeler is assumed to have cast before any is seen: on false spans, on true ones.
_BEFORE = np.array([[4.0, 3.0, 1.0], [1.0, 3.0, 4.0]])


def reliabilities(kind: np.ndarray, votes: np.ndarray, n: np.ndarray, rounds: int = 60) -> Labelers:
    """Expectation-maximisation over patterns of votes (base-3 digits) seen `n` times each."""
    each = votes[:, None] // 3 ** np.arange(LABELERS - 1, -1, -1) % 3
    true = 1 / (1 + np.exp(-(each - 1).sum(1).astype(float)))
    for _ in range(rounds):
        chances = np.repeat(_BEFORE[:, None, :], LABELERS, 1)
        for y, share in enumerate((1 - true, true)):
            for vote in range(3):
                chances[y, :, vote] += ((each == vote) * (n * share)[:, None]).sum(0)
        chances /= chances.sum(2, keepdims=True)
        weight = np.bincount(kind, n, len(KINDS))
        prior = (np.bincount(kind, n * true, len(KINDS)) + 1) / (weight + 2)
        found = Labelers(chances, prior)
        true = found.posterior(kind, votes)
    return found


def train(places: list[np.ndarray], target: np.ndarray, rounds: int = 300, rate: float = 1.0, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression on feature buckets, fitted to probabilities by scaled gradients."""
    weights = np.zeros(BUCKETS)
    if not len(target):
        return weights
    row = np.repeat(np.arange(len(places)), [len(p) for p in places])
    at = np.concatenate(places)
    scale = np.sqrt(np.bincount(at, minlength=BUCKETS) + 1.0)
    for _ in range(rounds):
        score = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights[at], len(places)), -30, 30)))
        slope = np.bincount(at, (target - score)[row], BUCKETS)
        weights += rate * (slope / scale**2 - decay * weights)
    return weights


def fit(found: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The classifier of spans, from `candidates` of a whole corpus."""
    spans = found.select("doc_id", F.inline("spans"))
    counts = spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).orderBy("kind", "votes").toArrow()
    kind, votes, n = (counts[c].to_numpy() for c in ("kind", "votes", "n"))  # at most 5 * 3 ** 6 rows
    if not len(n):
        return np.zeros(BUCKETS)
    labelers = reliabilities(kind, votes, n.astype(float))
    # Equal shares by a hash of the place, whatever the number of spans; copies hash apart by their ids.
    share = min(1.0, sample / n.sum())
    drawn = F.pmod(F.xxhash64("doc_id", "kind", "start", "end"), F.lit(1 << 30)) < int(share * (1 << 30))
    chosen = spans.where(drawn).select("kind", "votes", "places").limit(2 * sample).toArrow()
    places = [np.array(p, np.int64) for p in chosen["places"].to_pylist()]
    return train(places, labelers.posterior(chosen["kind"].to_numpy(), chosen["votes"].to_numpy()))


def _decided(spans: list[dict], weights: np.ndarray) -> tuple[list[tuple], list[tuple]]:
    """Base spans, and all spans, as (start, kind, end) in order."""
    base = sorted((s["start"], s["kind"], s["end"]) for s in spans if s["base"])
    taken = sorted((start, end) for start, _, end in base)
    added, free, at = [], 0, 0
    busy = 0  # end of the base spans that start before the one looked at
    for s in sorted((s for s in spans if not s["base"]), key=lambda s: (s["start"], s["kind"], s["end"])):
        if weights[s["places"]].sum() < 0 or s["start"] < free:
            continue
        while at < len(taken) and taken[at][0] < s["end"]:
            busy = max(busy, taken[at][1])
            at += 1
        if busy > s["start"]:
            continue
        free = s["end"]
        added.append((s["start"], s["kind"], s["end"]))
    return base, sorted(base + added)


def _text(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def decide(found: DataFrame, weights: np.ndarray) -> DataFrame:
    """Counts of base spans, their digest, and all spans of every row of `candidates`."""
    names = [f.split()[0] for f in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc_id, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, everything = _decided(spans, weights)
                counts = np.bincount([k for _, k, _ in base], minlength=len(KINDS))[:SECRET] if base else [0] * SECRET
                digest = hashlib.sha256(_text(base).encode()).hexdigest()
                for column, value in zip(rows, [doc_id, *map(int, counts), digest, _text(everything)], strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=names)

    return found.select("doc_id", "spans").mapInArrow(run, FOUND)


def personal_data(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """`doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans` of every row of `docs`."""
    found = materialize(candidates(docs), "candidates")
    return decide(found, fit(found, sample))
