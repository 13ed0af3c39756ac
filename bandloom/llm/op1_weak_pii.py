"""Personal data by weak supervision.

Strict patterns give the base spans, which always stay. Candidates are what looser patterns find, and long numbers that
only fail the check digit (the sceptic's vote). Labelers (regex shape, gazetteer, context words, company of other personal data, and a
sceptic) vote on base spans and candidates alike: yes, no or nothing. Votes are counted by pattern over all documents;
from the counts, expectation-maximisation estimates how reliable each labeler is per kind, with the base spans as known
true ones. The posteriors are soft labels for the final classifier, a logistic regression on what a span looks like,
and the classifier decides about the candidates. Both fits see only pattern counts: at most
kinds x 3^LABELERS x 2^BITS rows, whatever the number of documents.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize

KINDS = ("email", "ip", "card", "phone")
LABELERS, BITS = 5, 10
ACCEPT = 0.9
#: Characters within which other base spans keep a span company.
NEAR = 2_000
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
LOOSE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{2,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?|\.)[A-Za-z]{2,12}\b"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+(.-])(?:00[1-9][0-9]{0,2}[\x20.-])?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20./-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])"),
}
# Words beside a span that speak for it, and that speak against it; endings and first digits in use.
CUES = {
    "email": "mail e-mail email contact write courriel correo kontakt",
    "ip": "ip host server address addr login adresse",
    "card": "card visa mastercard amex credit payment karte carte tarjeta",
    "phone": "phone tel telephone call mobile fax cell dial telefon fon appelez móvil llame",
}
AGAINST = frozenset("version ver v order ref isbn id no number page section invoice sku part build".split())
ENDINGS = frozenset("com org net edu gov io info biz de fr es uk eu ch at nl it us co example".split())
CARD_HEADS = re.compile(r"4|5[1-5]|3[47]|6011|65|2[2-7]")
CUE_SETS = [frozenset(CUES[kind].split()) for kind in KINDS]
WORD = re.compile(r"[^\W\d_][\w-]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def emails(text: str):
    """What the email pattern finds, in time linear in the text: from each @ to both sides."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(kind, start, end) of what the contract names, by kind, then start; and numbers that only fail Luhn's check."""
    out, failed = [(0, s, e) for s, e in emails(text)], []
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = digits_of(m[0])
        if 13 <= len(d) <= 19 and (luhn(d) or d[0] != "0"):
            (out if luhn(d) else failed).append((2, *m.span()))
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out, failed


def loose_spans(text: str, base: list[tuple[int, int, int]], failed: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates (kind, start, end) that overlap no base span and no candidate that starts earlier: one sorted sweep."""
    some = failed + [(k, *m.span()) for k, kind in enumerate(KINDS) for m in LOOSE[kind].finditer(text)]
    out, taken = [], sorted((s, e) for _, s, e in base)
    at = last = 0
    for k, s, e in sorted(some, key=lambda x: (x[1], x[0], x[2])):
        while at < len(taken) and taken[at][0] < e:
            last = max(last, taken[at][1])
            at += 1
        # Base spans that start before e end after s at the latest if one overlaps.
        if last <= s:
            out.append((k, s, e))
            last = e
    return out


def votes(text: str, k: int, start: int, end: int, company: bool) -> int:
    """The labelers' votes in base 3: 0 nothing, 1 yes, 2 no."""
    s, kind = text[start:end], KINDS[k]
    d = digits_of(s)
    near = [w.lower() for w in WORD.findall(text[max(0, start - 40) : start])[-4:]]
    tail = re.split(r"[.\x20\])]", s)[-1].lower()
    shape = {"email": "@" in s or "at" in s.lower(), "ip": all(len(p) <= 3 for p in s.split(".")) or s.count(":") == 7, "card": len(d) in (14, 15, 16), "phone": 9 <= len(d) <= 13}[kind]
    listed = {"email": tail in ENDINGS, "ip": s.count(":") == 7 or s.split(".")[0] not in ("0", "255"), "card": bool(CARD_HEADS.match(d)), "phone": s[:1] == "+" or s[:2] == "00" or s[:1] == "("}[kind]
    cue = 2 if near and near[-1] in AGAINST else 1 if CUE_SETS[k].intersection(near) else 0
    inside = text[start - 1 : start].isalnum() or text[end : end + 1].isalnum() or text[start - 1 : start] == "." or bool(re.match("[.,][0-9]", text[end : end + 2]))
    sceptic = 2 if inside or d and (len(set(d)) <= 2 or d in "01234567890123456789") or kind == "card" and not luhn(d) else 0
    return (1 if shape else 2) + 3 * (1 if listed else 0) + 9 * cue + 27 * (1 if company else 0) + 81 * sceptic


def features(text: str, k: int, start: int, end: int) -> int:
    """What a span looks like, as BITS bits."""
    s, d = text[start:end], digits_of(text[start:end])
    before, after = text[max(0, start - 12) : start], text[end : end + 2]
    seps = set(re.sub("[A-Za-z0-9]", "", s))
    bits = (
        not before[-1:].isalnum() and not after[:1].isalnum(), before[-1:] not in (".", ",", "#", "/") and not re.match("[.,][0-9]", after),
        len(seps) <= 1, KINDS[k] != "card" or luhn(d), s[:1] in "+(", len(d) >= 10, len(d) in (15, 16), "@" in s or " " in s,
        bool(WORD.search(before)) and WORD.findall(before)[-1].lower() not in AGAINST, len(set(d)) >= min(5, len(d)),
    )
    return sum(1 << i for i, b in enumerate(bits) if b)


SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32()), ("looks", pa.int32())])
SPAN_SQL = "array<struct<kind int, start int, stop int, base boolean, votes int, looks int>>"


def _scan(batches):
    for b in batches:
        rows = []
        for text in b.column(1).to_pylist():
            base, failed = base_spans(text) if text else ([], [])
            loose = loose_spans(text, base, failed) if text else []
            starts = sorted(s for _, s, _ in base)
            # Another base span that starts within NEAR characters; a base span itself is one of them.
            beside = lambda s, own: bisect_left(starts, s + NEAR) - bisect_left(starts, s - NEAR) > own
            rows.append([{"kind": k, "start": s, "stop": e, "base": i < len(base), "votes": votes(text, k, s, e, beside(s, i < len(base))), "looks": features(text, k, s, e)} for i, (k, s, e) in enumerate(base + loose)])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(SPAN))], ["doc_id", "found"])


def reliabilities(table: list[tuple[int, int]], known: list[int] | None = None, rounds: int = 60) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over (vote pattern, count): the share of true spans, P(vote | class) per labeler, P(true | pattern).

    ``known`` are the counts of spans known to be true, by pattern; they only teach what true spans' votes are.
    """
    v = np.array([[p // 3**j % 3 for j in range(LABELERS)] for p, _ in table])
    n = np.array([c for _, c in table], float)
    sure = np.zeros(len(n)) if known is None else np.array(known, float)
    post = np.clip(0.5 + 0.2 * ((v == 1).sum(1) - (v == 2).sum(1)), 0.05, 0.95)
    for _ in range(rounds):
        prior = np.clip((n @ post + 1) / (n.sum() + 2), 1e-3, 1 - 1e-3)
        like = np.array([[[(w[v[:, j] == a]).sum() + 0.5 for a in range(3)] for w in (n * (1 - post), n * post + sure)] for j in range(LABELERS)])
        like /= like.sum(2, keepdims=True)
        logs = [np.log(q) + sum(np.log(like[j, c, v[:, j]]) for j in range(LABELERS)) for c, q in enumerate((1 - prior, prior))]
        post = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return float(prior), like, post


def classifier(table: list[tuple[int, float, float]], rounds: int = 400) -> np.ndarray:
    """Weights (bias first) of a ridge logistic regression on (looks, soft label, count)."""
    x = np.array([[1, *(p >> i & 1 for i in range(BITS))] for p, _, _ in table], float)
    y, n = np.array([t[1] for t in table]), np.array([t[2] for t in table], float)
    n, w = n / n.sum(), np.zeros(BITS + 1)
    for _ in range(rounds):
        w -= 2.0 * (x.T @ (n * (1 / (1 + np.exp(-x @ w)) - y)) + 1e-4 * w)
    return w


def chances(patterns: list[tuple[int, int, int, int, int]]) -> dict[tuple[int, int], float]:
    """From (kind, votes, looks, candidates, base spans): the classifier's P(true) by kind and looks."""
    out = {}
    for k in range(len(KINDS)):
        own = [p[1:] for p in patterns if p[0] == k]
        by_votes: dict[int, list[int]] = {}
        for v, _, n, sure in own:
            held = by_votes.setdefault(v, [0, 0])
            held[0], held[1] = held[0] + n, held[1] + sure
        table = sorted(by_votes.items())
        if sum(n for _, (n, _) in table):
            post = dict(zip((v for v, _ in table), reliabilities([(v, n) for v, (n, _) in table], [s for _, (_, s) in table])[2].tolist(), strict=True))
            # Each look is also given once with an even label, so that rare ones decide nothing.
            rows = [(f, post[v], n) for v, f, n, _ in own if n] + [(f, 1.0, sure) for _, f, _, sure in own if sure] + [(f, 0.5, 1) for _, f, _, _ in own]
            w = classifier(rows)
            for _, f, n, _ in own:
                if n:
                    out[k, f] = float(1 / (1 + np.exp(-(w[0] + sum(w[i + 1] for i in range(BITS) if f >> i & 1)))))
    return out


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``found``, all spans ``(kind, start, stop, base)`` by kind and start.

    Places are code points, stop exclusive; a null text is empty. Base spans stay whatever the classifier says;
    a candidate is added if the classifier gives what it looks like ``ACCEPT`` at least. Rows that repeat a doc_id or a
    text each have their own spans, and count as often. The time taken is proportional to the length of a text.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seen = materialize(docs.mapInArrow(_scan, f"doc_id long, found {SPAN_SQL}"), "spans")
    base = F.sum(F.col("f.base").cast("long"))
    counted = seen.select(F.explode("found").alias("f")).groupBy("f.kind", "f.votes", "f.looks").agg((F.count("*") - base).alias("n"), base.alias("sure")).collect()
    told = chances(sorted((r.kind, r.votes, r.looks, r.n, r.sure) for r in counted))
    keep = F.array(*[F.lit(k << BITS | f) for (k, f), p in sorted(told.items()) if p >= ACCEPT]).cast("array<int>")
    code = lambda s: F.shiftleft(s["kind"], BITS).bitwiseOR(s["looks"])
    return seen.select("doc_id", F.array_sort(F.filter("found", lambda s: s["base"] | F.array_contains(keep, code(s)))).alias("found"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = F.array(*[F.lit(k) for k in KINDS])
    is_kind = lambda k: lambda s: s["kind"] == k
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")
    base = F.filter("found", lambda s: s["base"])
    number = [F.size(F.filter(base, is_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return df.select("doc_id", *number, F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("found")).alias("spans"))
