"""Personal data: fixed patterns, and beside them a semi-Markov conditional random field.

The field scores whole candidate segments (digits, groups, separators, checksum, what stands around), and one dynamic
program over segments of bounded length chooses boundaries and kinds together, numbers and mail addresses alike. Text
outside any candidate scores zero, so text far from digits and at-signs needs no work. The number of candidates grows with the
text and no faster: a segment has a bounded number of groups or labels.
"""

from __future__ import annotations

import bisect
import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

KINDS = ("email", "ip", "card", "phone")
#: Groups of digits and digits in a segment, and letters of a mail address before its at-sign, at most.
MOST_GROUPS, MOST_DIGITS, MOST_LOCAL = 8, 19, 64

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at-sign outwards, so that long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _HOST.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, kind by kind, each kind from left to right."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# The field.

_REGION = re.compile(r"[+(]{0,2}[0-9][0-9 ()\[\].\-/_\u00a0\u2013\u2014]{5,}")
_GROUP = re.compile(r"[0-9]+")
_AT = re.compile(r"(?: ?@ ?| ?[(\[{<] ?at ?[)\]}>] ?| at )(?=[A-Za-z0-9])", re.I)
_HOST_AFTER = re.compile(r"(?:[A-Za-z0-9-]{1,63}(?: ?\. ?| ?[(\[{<] ?dot ?[)\]}>] ?| dot )){1,6}[A-Za-z]{2,12}", re.I)
# Common top-level domains.
_TLDS = frozenset("biz co com de edu es eu fr gov info io it net nl org uk us".split())

N_DIGIT, N_MAIL = 22, 12
SLOTS = {"ip": 0, "card": N_DIGIT, "phone": 2 * N_DIGIT, "email": 3 * N_DIGIT}
WEIGHTS = 3 * N_DIGIT + N_MAIL


def digit_features(text: str, start: int, end: int) -> tuple[int, ...]:
    return _digit_facts(text[max(0, start - 2) : start], text[start:end], text[end : end + 2])


@functools.lru_cache(1 << 16)
def _digit_facts(before: str, span: str, after: str) -> tuple[int, ...]:
    groups, seps = re.findall(r"[0-9]+", span), [s for s in re.split(r"[0-9]+", span)[1:-1]]
    digits, sizes, kinds = "".join(groups), [len(g) for g in groups], set(seps)
    n = len(digits)
    left, right = before[-1:], after[:1]
    near = re.search(r"[0-9][ .\-]?$", before), re.match(r"[ .\-]?[0-9]", after)
    ip = len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups) and all(s.strip(" []()") == "." for s in seps)
    facts = (
        True, 13 <= n <= 19 and luhn(digits), n in (15, 16), 13 <= n <= 19, len(sizes) > 2 and set(sizes[:-1]) == {4}, len(groups) == 1, ip,
        span.startswith(("+", "00")), n <= 8, 9 <= n <= 11, 12 <= n <= 15, "(" in span, len(sizes) > 1 and sizes[-1] == 4 and sizes[-2] == 3,
        len(kinds) == 1, bool(left) and left.isalnum() or bool(right) and right.isalnum(), bool(near[0]) or bool(near[1]),
        any("/" in s for s in seps), sizes in ([4, 2, 2], [2, 2, 4]) or len(sizes) > 4 and sizes[:3] == [4, 2, 2], bool(seps) and all("." in s for s in seps),
        span.count("(") != span.count(")") or span.count("[") != span.count("]"), any(len(s) > 2 for s in seps), len(groups) > 5,
    )
    return tuple(i for i, fact in enumerate(facts) if fact)


def mail_features(text: str, start: int, end: int) -> tuple[int, ...]:
    span = text[start:end]
    low, tail = span.lower(), re.split(r"[^a-z]+", span.lower())[-1]
    facts = (
        True, bool(re.search(r"[(\[{<] ?at ?[)\]}>]", low)), bool(re.search(r"[(\[{<] ?dot ?[)\]}>]", low)), " at " in low and "@" not in low, " dot " in low,
        "@" in span, " @" in span or "@ " in span, tail in _TLDS, 2 <= len(tail) <= 4, bool(re.match(r"[A-Za-z0-9]*[0-9._]", span)), "." in span, text[end : end + 1].isalnum(),
    )
    return tuple(i for i, fact in enumerate(facts) if fact)


Segment = tuple[int, int, str, tuple[int, ...]]


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _numbers(text: str, a: int, b: int) -> Iterator[Segment]:
    """Candidates inside text[a:b]; each starts at a group of digits, or one or two signs ahead of it."""
    groups = [(m.start() + a, m.end() + a) for m in _GROUP.finditer(text[a:b])]
    for i, (first, _) in enumerate(groups):
        n = 0
        signs = next(k for k in range(3) if k == 2 or first - k - 1 < a or text[first - k - 1] not in "+(")
        for x, end in groups[i : i + MOST_GROUPS]:
            n += end - x
            if n > MOST_DIGITS:
                break
            for start in range(first, first - signs - 1, -1) if n >= 4 else ():
                f = digit_features(text, start, end)
                if 6 in f:
                    yield start, end, "ip", f
                if n >= 13:
                    yield start, end, "card", f
                if 7 <= n <= 15:
                    yield start, end, "phone", f


def candidates(text: str, taken: list[tuple[int, int]]) -> Iterator[Segment]:
    """Segments (start, end, kind, features) that keep clear of the spans taken."""
    starts, ends = _merged(taken)
    for region in _REGION.finditer(text):
        at, k = region.start(), bisect.bisect_right(ends, region.start())
        while at < region.end():  # the region less what is taken
            stop = min(region.end(), starts[k]) if k < len(starts) else region.end()
            if stop - at >= 7 and len(_digits(text[at:stop])) >= 4:
                yield from _numbers(text, at, stop)
            if k == len(starts) or starts[k] >= region.end():
                break
            at, k = ends[k], k + 1
    for at in _AT.finditer(text):
        host = _HOST_AFTER.match(text, at.end())
        start = at.start()
        while host and start > 0 and at.start() - start < MOST_LOCAL and text[start - 1] in _LOCAL:
            start -= 1
        if host and start < at.start():
            k = bisect.bisect_right(ends, start)
            if k == len(starts) or starts[k] >= host.end():
                yield start, host.end(), "email", mail_features(text, start, host.end())


def _scores(segments, weights: np.ndarray) -> list[float]:
    w = weights.tolist()
    return [sum(w[SLOTS[k] + i] for i in f) for _, _, k, f in segments]


def _before(segments) -> list[int]:
    """For each segment, how many segments end at or before its start."""
    ends = np.array([s[1] for s in segments])
    return np.searchsorted(ends, [s[0] for s in segments], side="right").tolist()


def decode(segments, weights: np.ndarray) -> list[tuple[str, int, int]]:
    """The best set of segments that don't overlap; the empty set scores zero."""
    scores, before = _scores(segments, weights), _before(segments)
    best, take = [0.0], []
    for k, s in enumerate(scores):
        with_it = best[before[k]] + s
        take.append(with_it > best[-1])
        best.append(max(best[-1], with_it))
    out, k = [], len(segments)
    while k:
        if take[k - 1]:
            a, b, kind, _ = segments[k - 1]
            out.append((kind, a, b))
            k = before[k - 1]
        else:
            k -= 1
    return out[::-1]


def gradient(segments, gold: set[tuple[str, int, int]], weights: np.ndarray) -> np.ndarray:
    """Of the log-likelihood: features of the true segments less their expectation, by sums over all segmentations."""
    scores, before = np.array(_scores(segments, weights)), _before(segments)
    n = len(segments)
    ahead = np.zeros(n + 1)
    for k in range(n):
        ahead[k + 1] = np.logaddexp(ahead[k], ahead[before[k]] + scores[k])
    # outside[k]: log-sum of all ways to go on once the first k segments are dealt with
    outside = np.full(n + 1, -np.inf)
    outside[n] = 0.0
    for k in range(n - 1, -1, -1):
        outside[k] = np.logaddexp(outside[k], outside[k + 1])
        outside[before[k]] = np.logaddexp(outside[before[k]], outside[k + 1] + scores[k])
    out = np.zeros(WEIGHTS)
    for k, (a, b, kind, f) in enumerate(segments):
        p = np.exp(ahead[before[k]] + scores[k] + outside[k + 1] - ahead[n])
        out[[SLOTS[kind] + i for i in f]] += float((kind, a, b) in gold) - p
    return out


def _card_number(r: random.Random) -> str:
    body = "".join(r.choices("0123456789", k=15))
    return next(body + c for c in "0123456789" if luhn(body + c))


def examples(n: int, seed: int) -> Iterator[tuple[str, set[tuple[str, int, int]]]]:
    """Made-up lines with personal data written in unusual ways, and lines with other numbers."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("aeinorstlu", k=r.randint(2, 8)))
    num = lambda k: "".join(r.choices("0123456789", k=k))
    for _ in range(n):
        pick, kind = r.randrange(16), None
        if pick < 2:
            c = _card_number(r)
            said, kind = r.choice((c, r.choice((".", "/", "_", "–", " ")).join(c[i : i + 4] for i in range(0, 16, 4)), " - ".join(c[i : i + 4] for i in range(0, 16, 4)))), "card"
        elif pick < 4:
            p = (num(3), num(3), num(4))
            said, kind = r.choice(("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "00{} {} {}", "({}){}-{}")).format(*p), "phone"
        elif pick == 4:
            said, kind = "0{} {}{}{}".format(num(2), num(3), r.choice(("-", " ")), num(4)), "phone"
        elif pick < 7:
            dot = r.choice(("[.]", "(.)", " . "))
            said, kind = dot.join(str(r.randrange(256)) for _ in range(4)), "ip"
        elif pick < 10:
            at, dot = r.choice(((" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" @ ", "."), ("(at)", "."), (" [at] ", " [dot] "), (" @ ", " . ")))
            said, kind = f"{word()}{r.choice(('', '.' + word(), num(2)))}{at}{word()}{dot}{r.choice(sorted(_TLDS))}", "email"
        elif pick == 10:
            said = r.choice(("{}-{}-{}", "{}/{}/{}", "{}.{}.{}")).format(num(4), num(2), num(2))
        elif pick == 11:
            said = num(r.choice((7, 8, 9, 10, 12, 16, 17, 18, 20)))
            said = said if len(said) < 13 or not luhn(said) else said[:-1] + str((int(said[-1]) + 1) % 10)
        elif pick == 12:
            said = " ".join(num(r.randint(1, 3)) for _ in range(r.randint(4, 10)))
        elif pick == 13:
            said = r.choice((f"look at the {word()} dot on {word()}", f"stay at {word()} dot. {word()}", f"{word()} @ {word()}", f"{word()} dot {word()} at home"))
        elif pick == 14:
            said = ".".join(str(r.randrange(256 if i else 20)) for i in range(r.choice((3, 5, 6))))
        else:
            c, d = _card_number(r), _card_number(r)
            lead = f"{word()} "
            yield f"{lead}{c} {d} {word()}", {("card", len(lead), len(lead) + 16), ("card", len(lead) + 17, len(lead) + 33)}
            continue
        lead = r.choice(("", f"{word()} ", f"{word()} {word()}: "))
        yield f"{lead}{said}{r.choice(('', f' {word()}', f', {word()} {word()}.', '.'))}", {(kind, len(lead), len(lead) + len(said))} if kind else set()


@functools.cache
def train(n: int = 900, rounds: int = 12, seed: int = 5) -> tuple[float, ...]:
    """Weights by AdaGrad ascent of the likelihood with a small ridge, on made-up lines."""
    cases = []
    for text, gold in examples(n, seed):
        segments = sorted(candidates(text, [(a, b) for _, a, b in base_spans(text)]), key=lambda s: s[1])
        cases += [(segments, gold)] if segments else []
    weights, squares, order = np.zeros(WEIGHTS), np.full(WEIGHTS, 1e-6), random.Random(seed)
    weights[[SLOTS[k] for k in KINDS]] = -1.0
    for _ in range(rounds):
        order.shuffle(cases)
        for segments, gold in cases:
            g = gradient(segments, gold, weights) - 2e-4 * weights
            squares += g * g
            weights += 0.5 * g / np.sqrt(squares)
    return tuple(weights)


def added_spans(text: str, base: list[tuple[str, int, int]], weights: np.ndarray) -> list[tuple[str, int, int]]:
    """The best set of segments over the whole text; one that scores nothing by itself is never in it."""
    w = weights.tolist()
    worth = [s for s in candidates(text, [(a, b) for _, a, b in base]) if sum(w[SLOTS[s[2]] + i] for i in s[3]) > 0]
    return decode(sorted(worth, key=lambda s: s[1]), weights) if worth else []


def join_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def _find(weights: tuple[float, ...]):
    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = np.array(weights)
        for frame in frames:
            rows = []
            for doc_id, text in frame[["doc_id", "body"]].itertuples(index=False):
                base = base_spans(text)
                more = added_spans(text, base, w)
                count = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((doc_id, *count, join_spans(base), join_spans(base + more), len(more)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans", "n_added"]).astype({"doc_id": frame["doc_id"].dtype})

    return find


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans, n_added for every row of docs.

    The counts and base_spans are of the fixed patterns' spans; spans has these and those the field adds (n_added), which
    never overlap the fixed ones. Positions are code points, ends exclusive. Null text counts as empty: no spans and
    empty lists. Added spans never overlap each other either. The work grows with the length of a text and no faster, whatever
    it holds. Null ids are kept; repeated rows are reported each. An empty table gives an empty
    result. Other columns play no part. Kinds may overlap among the fixed patterns, as these are matched kind by kind.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("body"))
    return slim.mapInPandas(_find(train()), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string, n_added long")
